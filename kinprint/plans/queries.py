"""Registered queries of the similarity engine, with their DuckDB equivalents. All read whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinprint.functions import bits, hashes, text
from kinprint.operators import clustering, edit, pairs, projection, video
from kinprint.plans import fixtures as fx
from kinprint.session import cut, table

DOC_BITS, SMALL, MIDDLE = 64, 4, 7
NEAR, LINK = 3, 1  # thresholds of pairs and of groups, in bits
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir), with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


DOCS = f"WITH {fx.DOCUMENTS_SQL}"
REC = f"WITH RECURSIVE {fx.DOCUMENTS_SQL}, {fx.components_sql(LINK)}"
EMB = f"WITH {fx.embeddings_sql(SMALL)}"
EMB7 = f"WITH {fx.embeddings_sql(MIDDLE)}"
EMB_REC = f"WITH RECURSIVE {fx.embeddings_sql(SMALL)}, {fx.components_sql(LINK)}"


@query(f"{DOCS} SELECT file_idx, w0, w1 FROM h")
def dhash_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = fx.document_hashes(spark, sf_dir)
    return h.select("file_idx", F.col("words")[0].alias("w0"), F.col("words")[1].alias("w1"))


@query(f"{EMB7} SELECT file_idx, substr(lower(printf('%08x%08x', w0, w1)), 1, 14) AS hex FROM h")
def hash_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = fx.embedding_hashes(spark, sf_dir, MIDDLE)
    return h.select("file_idx", bits.to_hex(F.col("words"), MIDDLE**2).alias("hex"))


@query(f"{EMB}, {fx.PAIRS_SQL} SELECT i, j, d FROM pr")
def distance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.all_pairs(fx.embedding_hashes(spark, sf_dir), SMALL**2)


@query(f"{EMB7}, {fx.PAIRS_SQL} SELECT coalesce(min(d), 0) AS min_distance, coalesce(max(d), 0) AS max_distance, round(coalesce(avg(d), 0), 9) AS avg_distance FROM pr")
def distance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pairs.stats(pairs.joined_pairs(fx.embedding_hashes(spark, sf_dir, MIDDLE), MIDDLE**2))
    return found.withColumn("avg_distance", F.round("avg_distance", 9))


@query(f"{EMB}, {fx.PAIRS_SQL}, w AS (SELECT i, j, d FROM pr UNION ALL SELECT j, i, d FROM pr UNION ALL SELECT file_idx, file_idx, 0 FROM h) SELECT i, string_agg(CAST(d AS VARCHAR), ',' ORDER BY j) AS distances FROM w GROUP BY i")
def distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.matrix_text(fx.embedding_hashes(spark, sf_dir))


@query(f"{DOCS}, {fx.PAIRS_SQL} SELECT i, j, d FROM pr WHERE d <= {NEAR}")
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.similar_pairs(fx.document_hashes(spark, sf_dir), DOC_BITS, NEAR)


def _asked(h: DataFrame) -> DataFrame:
    return h.filter("file_idx % 50 = 0").select(F.col("file_idx").alias("query"), "words")


_FOUND = f"f AS (SELECT a.file_idx AS query, b.file_idx, {fx.DISTANCE_SQL} AS d FROM h a JOIN h b ON a.file_idx % 50 = 0)"


@query(f"{DOCS}, {_FOUND} SELECT query, file_idx, d FROM f QUALIFY row_number() OVER (PARTITION BY query ORDER BY d, file_idx) <= 10")
def find_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = cut(fx.document_hashes(spark, sf_dir))  # the texts are read once
    return pairs.find(h, _asked(h), DOC_BITS, top=10)


@query(f"{DOCS}, {_FOUND} SELECT query, file_idx, d FROM f WHERE d <= {NEAR}")
def find_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = fx.document_hashes(spark, sf_dir)
    return pairs.find(h, _asked(h), DOC_BITS, top=0, threshold=NEAR)


def _members(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    h = fx.document_hashes(spark, sf_dir)
    return h, clustering.threshold_members(h, DOC_BITS, LINK)


@query(f'{REC} SELECT file_idx, leader, CAST(dense_rank() OVER (ORDER BY leader) - 1 AS BIGINT) AS "group" FROM m')
def threshold_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.with_group_ids(_members(spark, sf_dir)[1]).withColumn("group", F.col("group").cast("long"))


@query(f"{REC}, z AS (SELECT leader, count(*) AS size FROM m GROUP BY 1 HAVING count(*) >= 2), q AS (SELECT x.leader, {fx.DISTANCE_SQL} AS d FROM m x JOIN m y ON x.leader = y.leader AND x.file_idx < y.file_idx JOIN h a ON a.file_idx = x.file_idx JOIN h b ON b.file_idx = y.file_idx) SELECT z.leader, size, max(d) AS max_internal_distance, round(avg(d), 9) AS avg_internal_distance FROM z JOIN q USING (leader) GROUP BY 1, 2")
def group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, members = _members(spark, sf_dir)
    return clustering.group_stats(h, members, DOC_BITS).withColumn("avg_internal_distance", F.round("avg_internal_distance", 9))


@query(f"{REC} SELECT file_idx FROM m QUALIFY count(*) OVER (PARTITION BY leader) < 2")
def ungrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.ungrouped(_members(spark, sf_dir)[1])


_TURNS = fx.DOCUMENTS_SQL.replace("documents", "t")
_VOTE = f"""WITH t AS (SELECT row_number() OVER () AS doc_id, conv_id, coalesce(text, '') AS text FROM conversations), {_TURNS},
v AS (SELECT t.conv_id, bt.p, CAST(sum(b) AS BIGINT) AS s, count(*) AS n FROM bt JOIN t USING (doc_id) GROUP BY 1, 2)
SELECT conv_id, max(n) AS n_frames, CAST(sum(CASE WHEN p < 32 AND s > n // 2 THEN 1::BIGINT << (31 - p) ELSE 0 END) AS BIGINT) AS w0,
CAST(sum(CASE WHEN p >= 32 AND s > n // 2 THEN 1::BIGINT << (63 - p) ELSE 0 END) AS BIGINT) AS w1 FROM v GROUP BY 1"""


@query(_VOTE)
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    grids = fx.text_grids(table(spark, sf_dir, "conversations"), ["conv_id"])
    frames = grids.select(F.col("conv_id").alias("path"), hashes.dhash(F.col("grid"), 8).alias("words"))
    voted = video.majority_vote(frames, DOC_BITS)
    return voted.select(F.col("path").alias("conv_id"), "n_frames", F.col("words")[0].alias("w0"), F.col("words")[1].alias("w1"))


@query("SELECT event_id AS path, CAST(k AS INTEGER) AS frame, round(value / 8 * (k + 0.5), 6) AS t FROM events, (SELECT unnest(range(8)) AS k) WHERE value > 0")
def frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    durations = table(spark, sf_dir, "events").select(F.col("event_id").alias("path"), F.col("value").alias("duration"))
    return video.frame_times(durations).withColumn("t", F.round("t", 6))


_CORE = f"{EMB}, {fx.PAIRS_SQL}, bo AS (SELECT i, j, d FROM pr UNION ALL SELECT j, i, d FROM pr), co AS (SELECT i AS file_idx, d AS core FROM bo QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) = 2)"


@query(f"{_CORE} SELECT file_idx, core FROM co")
def core_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.core_distances(fx.embedding_hashes(spark, sf_dir), 3)


@query(f"{_CORE} SELECT i, j, greatest(d, a.core, b.core) AS w FROM pr JOIN co a ON a.file_idx = i JOIN co b ON b.file_idx = j")
def mutual_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.mutual_reachability(fx.embedding_hashes(spark, sf_dir), SMALL**2, 3)


@query(f"{EMB_REC} SELECT file_idx, leader FROM m")
def hier_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.hierarchical(fx.embedding_hashes(spark, sf_dir), SMALL**2, "single", LINK)


@query()
def hier_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.hierarchical(fx.embedding_hashes(spark, sf_dir), SMALL**2, "complete", 2)


@query()
def hier_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.hierarchical(fx.embedding_hashes(spark, sf_dir), SMALL**2, "average", 2)


@query()
def dendrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.dendrogram(fx.embedding_hashes(spark, sf_dir), SMALL**2, "complete", 2)


@query()
def greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.greedy(fx.embedding_hashes(spark, sf_dir), SMALL**2, 2)


@query()
def hdbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.density(fx.embedding_hashes(spark, sf_dir), 3)[0]


@query()
def condensed_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.density(fx.embedding_hashes(spark, sf_dir), 3)[1]


@query(f"{EMB} SELECT h.file_idx, CAST(p AS INTEGER) AS pos, CAST((w0 >> (31 - p)) & 1 AS INTEGER) AS b FROM h, (SELECT unnest(range(16)) AS p)")
def feature_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = fx.embedding_hashes(spark, sf_dir)
    return h.select("file_idx", F.posexplode(bits.unpack(F.col("words"), SMALL**2)).alias("pos", "b"))


@query(f"{EMB}, f AS (SELECT p, avg((w0 >> (31 - p)) & 1) AS a FROM h, (SELECT unnest(range(16)) AS p) GROUP BY p) SELECT round(sum(a * (1 - a)), 9) AS total_variance FROM f")
def pca_total_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.total_variance(fx.embedding_hashes(spark, sf_dir), SMALL**2).withColumn("total_variance", F.round("total_variance", 9))


@query()
def pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.pca(fx.embedding_hashes(spark, sf_dir), SMALL**2, 3)[0]


@query()
def tsne(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.tsne(fx.embedding_hashes(spark, sf_dir), SMALL**2, 2, iterations=300)


@query()
def phash_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("file_idx"), fx.embedding_grid().alias("grid"))
    return rows.select("file_idx", hashes.grid_hash("phash", 4, 8)("grid").alias("words"))


@query()
def whash_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("file_idx"), fx.embedding_grid().alias("grid"))
    return rows.select("file_idx", hashes.grid_hash("whash", 4, 8)("grid").alias("words"))


@query(f"""{REC}, g AS (SELECT file_idx, leader FROM m QUALIFY count(*) OVER (PARTITION BY leader) >= 2),
x AS (SELECT min(file_idx) AS x FROM g), k AS (SELECT CASE WHEN file_idx > x THEN file_idx - 1 ELSE file_idx END AS file_idx, leader FROM g, x WHERE file_idx <> x)
SELECT file_idx, leader AS "group" FROM k QUALIFY count(*) OVER (PARTITION BY leader) >= 2""")
def remove_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, members = _members(spark, sf_dir)
    sizes = members.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    grouped = members.join(sizes.select("leader"), "leader").select("file_idx", F.col("leader").alias("group"))
    first = grouped.agg(F.min("file_idx")).first()[0]
    return edit.from_groups(grouped, -1 if first is None else first).filter("group is not null").select("file_idx", "group")


@query("SELECT lower(regexp_extract(url, '\\.([^./]+)$', 1)) AS ext, count(*) AS n FROM pages GROUP BY 1")
def media_by_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(text.extension(F.col("url")).alias("ext")).agg(F.count(F.lit(1)).alias("n"))
