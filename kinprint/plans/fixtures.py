"""Tables read as small gray grids, so that every operator has whole-table inputs without media files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinprint.functions import hashes
from kinprint.session import table

CELLS = 72  # nine columns by eight rows


def text_grids(rows: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols`` and ``grid``: how many characters of the whole text have a code point of each remainder by 72."""

    def run(batches):
        for batch in batches:
            grids = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
                grids.append(np.bincount(points % CELLS, minlength=CELLS).astype(np.int32))
            made = pa.array(grids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*batch.schema.names[:-1], "grid"])

    picked = rows.select(*id_cols, F.col(text_col).cast("string").alias("__text"))
    kinds = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in id_cols)
    return picked.mapInArrow(run, f"{kinds}, grid array<int>")


def document_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_idx, words): 64 bits from the text of every document."""
    grids = text_grids(table(spark, sf_dir, "documents"), ["doc_id"])
    return grids.select(F.col("doc_id").alias("file_idx"), hashes.dhash(F.col("grid"), 8).alias("words"))


def embedding_grid():
    return F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int"))


def embedding_hashes(spark: SparkSession, sf_dir: str, size: int = 4) -> DataFrame:
    """(file_idx, words): size x size bits from the upper left (size + 1) x size cells of the 8 x 8 grid."""
    cells = [8 * (k // (size + 1)) + k % (size + 1) for k in range(size * (size + 1))]
    grid = F.transform(F.array(*[F.lit(c) for c in cells]), lambda c: F.get("grid", c))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("file_idx"), embedding_grid().alias("grid"))
    return rows.select("file_idx", hashes.dhash(grid, size).alias("words"))


# --- the same in DuckDB -------------------------------------------------------------------

DOCUMENTS_SQL = """
ch AS (SELECT doc_id, unicode(c) % 72 AS k, count(*) AS n
  FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents WHERE text <> '') GROUP BY 1, 2),
gr AS (SELECT d.doc_id, r.k, coalesce(ch.n, 0) AS n FROM documents d CROSS JOIN (SELECT unnest(range(72)) AS k) r LEFT JOIN ch ON ch.doc_id = d.doc_id AND ch.k = r.k),
bt AS (SELECT l.doc_id, (l.k // 9) * 8 + l.k % 9 AS p, CASE WHEN l.n > r.n THEN 1 ELSE 0 END AS b
  FROM gr l JOIN gr r ON r.doc_id = l.doc_id AND r.k = l.k + 1 WHERE l.k % 9 < 8),
h AS (SELECT doc_id AS file_idx, CAST(sum(CASE WHEN p < 32 THEN b * (1::BIGINT << (31 - p)) ELSE 0 END) AS BIGINT) AS w0,
  CAST(sum(CASE WHEN p >= 32 THEN b * (1::BIGINT << (63 - p)) ELSE 0 END) AS BIGINT) AS w1 FROM bt GROUP BY 1)"""


def embeddings_sql(size: int) -> str:
    """h(file_idx, w0, w1) of the embeddings; w1 is zero up to 32 bits."""
    return f"""
gr AS (SELECT vec_id, i - 1 AS c, floor((CAST(embedding[i] AS DOUBLE) + 1) * 127.5) AS v
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
bt AS (SELECT l.vec_id, (l.c // 8) * {size} + l.c % 8 AS p, CASE WHEN l.v > r.v THEN 1 ELSE 0 END AS b
  FROM gr l JOIN gr r ON r.vec_id = l.vec_id AND r.c = l.c + 1 WHERE l.c % 8 < {size} AND l.c // 8 < {size}),
h AS (SELECT vec_id AS file_idx, CAST(sum(CASE WHEN p < 32 THEN b * (1::BIGINT << (31 - p)) ELSE 0 END) AS BIGINT) AS w0,
  CAST(sum(CASE WHEN p >= 32 THEN b * (1::BIGINT << (63 - p)) ELSE 0 END) AS BIGINT) AS w1 FROM bt GROUP BY 1)"""


DISTANCE_SQL = "CAST(bit_count(xor(a.w0, b.w0)) + bit_count(xor(a.w1, b.w1)) AS INTEGER)"
PAIRS_SQL = f"pr AS (SELECT a.file_idx AS i, b.file_idx AS j, {DISTANCE_SQL} AS d FROM h a JOIN h b ON a.file_idx < b.file_idx)"


def components_sql(threshold: int) -> str:
    """m(file_idx, leader) from h: recursion over distinct hashes."""
    return f"""
dh AS (SELECT w0, w1, min(file_idx) AS rep FROM h GROUP BY 1, 2),
ed AS (SELECT a.rep AS u, b.rep AS v FROM dh a JOIN dh b ON a.rep <> b.rep AND {DISTANCE_SQL} <= {threshold}),
rc AS (SELECT rep AS s, rep AS t FROM dh UNION SELECT rc.s, ed.v FROM rc JOIN ed ON ed.u = rc.t),
m AS (SELECT h.file_idx, r.leader FROM h JOIN dh USING (w0, w1) JOIN (SELECT s, min(t) AS leader FROM rc GROUP BY 1) r ON r.s = dh.rep)"""
