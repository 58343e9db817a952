"""Mixing sources to target weights by Poisson replication.

Every document is repeated a Poisson-distributed number of times whose mean is its source's
target repetition rate: a hash of seed and id gives a uniform number, and the distribution's
inverse at that number is the count. A rate above ``MAX_RATE`` is the sum of several such draws
of equal rates, each with a hash of its own, so every source meets its target. Rows are then dealt out by a second hash, so the order
is random over all sources and copies, and a rerun or a lost executor gives the same rows.
Built-in expressions only.

Sizes are pre-aggregated by source. The table of sources is broadcast while it has at most
``MAX_BROADCAST`` rows (a row holds a short array); beyond that it is joined by a key with
salt, so that a source with a third of all rows is spread over ``SALT`` partitions.

Defined results: a null source is a source of its own, with the weight of the empty name;
null ids hash as an empty string, so equal rows without ids share their count; null and
empty texts take part (they add nothing to their source's size); a source of size zero, or
without a weight, gets no copies; a table whose sources all get none gives an empty table,
and so does an empty table. Other columns are carried along whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinprint.session import fresh

MAX_BROADCAST = 10_000
SALT = 64
SEED = "mix-1"
#: Rate of one draw at most; larger rates are drawn in parts.
MAX_RATE = 64.0


#: Beyond this a cumulative probability is past every uniform number, which has 52 bits.
FULL = 1 - 2.0**-53


def terms(rate: float = MAX_RATE) -> int:
    """Terms of a draw's distribution: past the mean by far more deviations than a 52-bit uniform number can ask for."""
    return int(rate + 12 * math.sqrt(rate) + 24)


def uniform(*parts: Column) -> Column:
    """In [0, 1): the first 52 bits of an MD5 over the parts."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def cumulative(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... while it is below 1, of a Poisson variable X with mean ``rate``."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))

    def longer(a, k):
        p = a["p"] * rate / k
        return F.struct(p.alias("p"), (a["sum"] + p).alias("sum"), F.concat(a["all"], F.array(a["sum"] + p)).alias("all"))

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(terms())), start, lambda a, k: F.when(a["sum"] < FULL, longer(a, k)).otherwise(a), lambda a: a["all"]
    )


def source_rates(
    docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, epochs: float = 1.0,
    source_col="source", text_col="text",
) -> DataFrame:
    """(source, size, rate, draws, cdf): rate = epochs * total size * target share / size, drawn in parts of
    MAX_RATE at most; ``cdf`` is that of a part.

    Size is the number of code points. Target shares are ``weights``, scaled to one, or where
    none are given in proportion to size ** power.
    """
    name = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(""))
    sizes = (
        docs.select(name.alias("source"), F.length(F.col(f"`{text_col}`")).alias("n"))
        .groupBy("source").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("size"))
        .filter("size > 0")
    )
    if weights is None:
        weighted = sizes.withColumn("w", F.pow(F.col("size").cast("double"), F.lit(power)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, w double")
        weighted = sizes.join(F.broadcast(given), "source").filter("w > 0")
    total = weighted.agg(F.sum("size").alias("all_size"), F.sum("w").alias("all_w"))
    rate = F.lit(float(epochs)) * F.col("all_size") * (F.col("w") / F.col("all_w")) / F.col("size")
    # One row beside a table of sources; no pairs arise.
    rated = weighted.crossJoin(F.broadcast(total)).select("source", "size", rate.alias("rate"))
    rated = rated.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_RATE).cast("int")))
    return rated.withColumn("cdf", cumulative(F.col("rate") / F.col("draws")))


def replicate(
    docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, epochs: float = 1.0,
    seed: str = SEED, id_col="doc_id", source_col="source", text_col="text", shuffle: bool = True,
) -> tuple[DataFrame, str]:
    """``docs`` repeated, with one struct column (rate, copies, copy, order_key); returns its name too.

    ``order_key`` is the place in the global shuffle: rows are dealt to partitions by its hash and sorted
    by it there, so each partition is a random sample in random order, and nothing is computed twice to find ranges.
    """
    rates = source_rates(docs, weights, power, epochs, source_col, text_col)
    m = fresh(docs, "mix")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    name = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(""))
    few = rates.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    ident = F.col(f"`{id_col}`")
    left = docs.withColumn(f"{m}_source", name)
    right = rates.select(*[F.col(c).alias(f"{m}_{c}") for c in ("source", "rate", "draws", "cdf")])
    if few:
        joined = left.join(F.broadcast(right), f"{m}_source")
    else:
        salt = F.pmod(F.xxhash64(ident), F.lit(SALT)).cast("int")
        joined = left.withColumn(f"{m}_salt", salt).join(
            right.withColumn(f"{m}_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))),
            [f"{m}_source", f"{m}_salt"],
        )
    u = uniform(F.lit(seed), ident)
    joined = joined.withColumn(f"{m}_u", u)
    drawn = lambda u: F.size(F.filter(F.col(f"{m}_cdf"), lambda x: x <= u))
    others = F.transform(
        F.sequence(F.lit(2), F.col(f"{m}_draws")), lambda j: uniform(F.lit(seed), F.lit("draw"), j, ident)
    )
    first = drawn(F.col(f"{m}_u"))
    count = F.when(F.col(f"{m}_draws") == 1, first).otherwise(F.aggregate(others, first, lambda n, u: n + drawn(u)))
    joined = joined.withColumn(f"{m}_copies", count).filter(F.col(f"{m}_copies") > 0)
    copies = joined.select(
        *columns, F.col(f"{m}_rate"), F.col(f"{m}_copies"),
        F.explode(F.sequence(F.lit(1), F.col(f"{m}_copies"))).alias(f"{m}_copy"),
    )
    key = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(ident.cast("string"), F.lit("")), F.col(f"{m}_copy")))
    out = copies.select(
        *columns,
        F.struct(
            F.col(f"{m}_rate").alias("rate"), F.col(f"{m}_copies").cast("long").alias("copies"),
            F.col(f"{m}_copy").cast("long").alias("copy"), key.alias("order_key"),
        ).alias(m),
    )
    if shuffle:
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        out = out.repartition(parts, F.col(m)["order_key"]).sortWithinPartitions(F.col(m)["order_key"])
    return out, m


def oracle_sql(source: str = "documents") -> str:
    return f"""
WITH s AS (SELECT coalesce(source, '') AS source, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS size
  FROM {source} GROUP BY 1 HAVING coalesce(sum(length(text)), 0) > 0),
t AS (SELECT sum(size) AS all_size, sum(pow(CAST(size AS DOUBLE), 0.5)) AS all_w FROM s),
r AS (SELECT source, all_size * (pow(CAST(size AS DOUBLE), 0.5) / all_w) / size AS rate FROM s, t),
e AS (SELECT source, rate, CAST(greatest(1, ceil(rate / {MAX_RATE})) AS BIGINT) AS draws FROM r),
d AS (SELECT doc_id, coalesce(source, '') AS source, row_number() OVER () AS row_id FROM {source}),
f AS (SELECT row_id, doc_id, d.source, rate, unnest(range(1, draws + 1)) AS j FROM d JOIN e ON e.source = d.source),
g AS (SELECT *, CAST(('0x' || substr(md5('{SEED}:' || CASE WHEN j = 1 THEN '' ELSE 'draw:' || j || ':' END
  || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM f),
q AS (SELECT source, rate / draws AS part, k FROM e, (SELECT unnest(range(0, {terms() + 1})) AS k)),
p AS (SELECT source, sum(exp(k * ln(part) - part - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cum FROM q),
n AS (SELECT row_id, doc_id, source, rate, CAST(sum((SELECT count(*) FROM p WHERE p.source = g.source AND p.cum <= g.u)) AS BIGINT) AS copies
  FROM g GROUP BY 1, 2, 3, 4),
c AS (SELECT *, unnest(range(1, copies + 1)) AS copy FROM n WHERE copies > 0)
SELECT doc_id, source, round(rate, 9) AS rate, copies, copy,
  md5('{SEED}:order:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(copy AS VARCHAR)) AS order_key FROM c
"""
