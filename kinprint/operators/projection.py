"""Two- and three-dimensional maps of hashes: PCA in Spark, exact t-SNE, by blocks of pairs where there are many."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinprint.functions import bits
from kinprint.operators import dense

#: Hashes up to which t-SNE holds all pairs on the driver; beyond, blocks of them are made on the executors in each round.
ONE_MACHINE = 5_000
#: Blocks that a round of t-SNE is dealt to.
ROUND_TASKS = 24
#: Rows and columns of the map's places that are met at once in a round; a tile of doubles fits a processor's cache.
TILE = 128, 256
#: The least affinity of a pair.
FLOOR = 1e-12


def features(hashes: DataFrame, n_bits: int) -> DataFrame:
    """(file_idx, features): the bits as doubles."""
    return hashes.select("file_idx", F.transform(bits.unpack(F.col("words"), n_bits), lambda x: x.cast("double")).alias("features"))


def total_variance(hashes: DataFrame, n_bits: int) -> DataFrame:
    """One row: the sum of the bits' population variances."""
    each = bits.unpack(F.col("words"), n_bits)
    means = hashes.select(*[F.get(each, k).alias(f"b{k}") for k in range(n_bits)]).agg(*[F.avg(f"b{k}").alias(f"m{k}") for k in range(n_bits)])
    parts = [F.col(f"m{k}") * (1 - F.col(f"m{k}")) for k in range(n_bits)]
    return means.select(sum(parts[1:], parts[0]).alias("total_variance"))


def pca(hashes: DataFrame, n_bits: int, dims: int = 3) -> tuple[DataFrame, list[float]]:
    """((file_idx, point), variance shares). Exact; a component's largest loading is positive.

    The covariance of the bits is one aggregate over all rows, n_bits by n_bits at most; only it reaches the driver.
    """
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    if dims < 1:
        raise ValueError("dims must be 1 at least")
    frame = features(hashes, n_bits).select("file_idx", array_to_vector("features").alias("x"))
    if not frame.limit(1).count():
        return frame.select("file_idx", F.array().cast("array<double>").alias("point")), []
    k = min(dims, n_bits)
    scaled = StandardScaler(inputCol="x", outputCol="c", withMean=True, withStd=False).fit(frame).transform(frame)
    model = PCA(k=k, inputCol="c", outputCol="p").fit(scaled)
    loadings = model.pc.toArray()
    sign = [1.0 if loadings[np.abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    point = F.zip_with(vector_to_array("p"), F.array(*[F.lit(s) for s in sign]), lambda x, s: x * s)
    padded = F.concat(point, F.array_repeat(F.lit(0.0), dims - k))
    share = np.nan_to_num(model.explainedVariance.toArray())
    return model.transform(scaled).select("file_idx", padded.alias("point")), [float(x) for x in share]


def joint_probabilities(d2: np.ndarray, perplexity: float) -> np.ndarray:
    """Symmetric t-SNE affinities of squared distances: per row, a bandwidth of the asked perplexity."""
    n = len(d2)
    target = np.log(max(1.0, min(perplexity, n - 1)))
    p = np.zeros((n, n))
    for i in range(n):
        others = np.delete(d2[i], i)
        beta, low, high = 1.0, 0.0, np.inf
        for _ in range(50):
            e = np.exp(-(others - others.min()) * beta)
            q = e / e.sum()
            entropy = -(q[q > 0] * np.log(q[q > 0])).sum()
            if abs(entropy - target) < 1e-5:
                break
            if entropy > target:
                low, beta = beta, beta * 2 if np.isinf(high) else (beta + high) / 2
            else:
                high, beta = beta, (beta + low) / 2
        p[i, np.arange(n) != i] = q
    return (p + p.T) / (2 * n)


def tsne(hashes: DataFrame, n_bits: int, dims: int = 2, perplexity: float = 30.0, iterations: int = 1000, rate: float = 200.0) -> DataFrame:
    """(file_idx, point). Exact and without random numbers: it starts from the PCA, scaled to 1e-4.

    For 0/1 features the squared distance is the Hamming distance. Beyond ``ONE_MACHINE`` hashes the driver
    holds one place for each different hash, and each round meets all their pairs on the executors.
    """
    from kinprint.operators.clustering import distances

    spark = hashes.sparkSession
    if hashes.limit(ONE_MACHINE + 1).count() > ONE_MACHINE:
        return _tsne_by_blocks(hashes, n_bits, dims, perplexity, iterations, rate)
    rows = hashes.select("file_idx", "words").orderBy("file_idx").collect()
    kind = "file_idx long, point array<double>"
    if len(rows) < 2:
        return spark.createDataFrame([(r["file_idx"], [0.0] * dims) for r in rows], kind)
    words = np.array([r["words"] for r in rows], np.uint64).reshape(len(rows), -1)
    p = np.maximum(joint_probabilities(distances(words).astype(float), perplexity), FLOOR)
    start = {r["file_idx"]: r["point"] for r in pca(hashes, n_bits, dims)[0].collect()}

    def gradient(y, early):
        near = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(axis=2))
        np.fill_diagonal(near, 0)
        pull = (early * p - np.maximum(near / near.sum(), 1e-12)) * near
        return 4 * (pull.sum(axis=1)[:, None] * y - pull @ y)

    y = descend(np.array([start[r["file_idx"]] for r in rows]), np.ones(len(rows)), gradient, iterations, rate)
    return spark.createDataFrame([(r["file_idx"], [float(v) for v in x]) for r, x in zip(rows, y, strict=True)], kind)


def descend(y: np.ndarray, weight: np.ndarray, gradient, iterations: int, rate: float) -> np.ndarray:
    """t-SNE's gradient descent from ``y`` scaled to 1e-4, centred by weight."""
    most = np.abs(y).max()
    y = y / most * 1e-4 if most > 0 else y
    last, gains = np.zeros_like(y), np.ones_like(y)
    for it in range(iterations):
        grad = gradient(y, 4.0 if it < 250 else 1.0)
        step = y - last
        gains = np.maximum(np.where(np.sign(grad) == np.sign(step), gains * 0.8, gains + 0.2), 0.01)
        last, y = y, y + (0.5 if it < 250 else 0.8) * step - rate * gains * grad
        shift = np.average(y, axis=0, weights=weight)
        y, last = y - shift, last - shift
    return y


def shares(counts: np.ndarray, perplexity: float) -> np.ndarray:
    """Rows of ``joint_probabilities`` before they are made symmetric, by distance: ``counts`` has how many others are at each."""
    n, t = counts[0].sum() + 1, np.arange(counts.shape[1])
    target = np.log(max(1.0, min(perplexity, n - 1)))
    away = np.maximum(t - (counts > 0).argmax(axis=1)[:, None], 0)
    beta, low, high = np.ones(len(counts)), np.zeros(len(counts)), np.full(len(counts), np.inf)
    out, left = np.zeros(counts.shape), np.arange(len(counts))
    for _ in range(50):
        e = np.exp(-away[left] * beta[left, None])
        q = e / (e * counts[left]).sum(axis=1)[:, None]
        entropy = -(counts[left] * q * np.log(np.where(q > 0, q, 1))).sum(axis=1)
        out[left] = q
        on = np.abs(entropy - target) >= 1e-5
        left, wide = left[on], entropy[on] > target
        low[left] = np.where(wide, beta[left], low[left])
        high[left] = np.where(wide, high[left], beta[left])
        beta[left] = np.where(np.isinf(high[left]), beta[left] * 2, (low[left] + high[left]) / 2)
        if not len(left):
            break
    return out


def near_links(codes: np.ndarray, share: np.ndarray, low: int, high: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Which others each of the rows ``low`` to ``high`` has an affinity over ``FLOOR`` with, as (first row, how many by
    distance and row, the others in that order) for a few rows each. They don't change from round to round."""
    n, out = len(codes), []
    reach = int((2 * share.max(axis=0) > FLOOR).sum()) - 1  # shares fall with the distance
    for at in range(low, high, dense.rows_at_once(n)):
        d = dense.between(codes[at : min(high, at + dense.rows_at_once(n))], codes)
        i, j = np.nonzero(d <= reach)
        t = d[i, j]
        over = share[i + at, t] + share[j, t] > FLOOR
        i, j, t = i[over], j[over], t[over]
        by = np.argsort(t, kind="stable")
        many = np.bincount(t.astype(np.int64) * len(d) + i, minlength=(reach + 1) * len(d)).reshape(reach + 1, len(d))
        out.append((at, many, j[by].astype(np.min_scalar_type(n))))
    return out


def attraction(axes: list[np.ndarray], weight: np.ndarray, heavy: np.ndarray, share: np.ndarray, links: tuple[int, np.ndarray, np.ndarray]) -> np.ndarray:
    """By row of ``links``, the pull of its others beyond that of ``FLOOR``. ``axes`` has the coordinates, one array
    each; ``share`` a row for each distance, and ``heavy`` the same times the weight."""
    at, many, others = links
    out, start = np.zeros((many.shape[1], len(axes))), 0
    for t, each in enumerate(many):
        has = np.flatnonzero(each)
        each = each[has]
        j = others[start : start + int(each.sum())].astype(np.intp)
        start += len(j)
        if not len(j):
            continue
        force = weight.take(j, mode="clip")  # all are in range; the check costs twice the reading
        force *= np.repeat(share[t, at + has] - FLOOR, each)
        force += heavy[t].take(j, mode="clip")
        aways, far = [], np.ones(len(j))
        for c in axes:
            away = c.take(j, mode="clip")
            np.subtract(np.repeat(c[at + has], each), away, out=away)
            far += away * away
            aways.append(away)
        force /= far
        for k, away in enumerate(aways):
            away *= force
            out[has, k] += np.add.reduceat(away, np.cumsum(each) - each)
    return out


def closeness(y: np.ndarray, weight: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """For the rows ``low`` to ``high``, sums over all places of 1 / (1 + squared distance) and of its square, in two
    arrays: times the weight, and times the weight and each coordinate. Tiles stay in the processor's cache."""
    n, own = len(y), (y**2).sum(axis=1)
    heavy = np.column_stack([weight, weight[:, None] * y])
    left = np.column_stack([1 + own, np.ones(n), -2 * y])
    right = np.ascontiguousarray(np.column_stack([np.ones(n), own, y]).T)
    # One product of matrices gives a tile's distances, to 1e-16 of the map's squared width; wide maps take differences.
    wide = own.max(initial=0) > 1e6
    once, twice = np.zeros((high - low, heavy.shape[1])), np.zeros((high - low, heavy.shape[1]))
    for at in range(low, high, TILE[0]):
        to = min(high, at + TILE[0])
        for b in range(0, n, TILE[1]):
            e = min(n, b + TILE[1])
            if wide:
                x = 1 + sum(np.subtract.outer(y[at:to, k], y[b:e, k]) ** 2 for k in range(y.shape[1]))
            else:
                x = left[at:to] @ right[:, b:e]
            np.reciprocal(x, out=x)
            once[at - low : to - low] += x @ heavy[b:e]
            np.multiply(x, x, out=x)
            twice[at - low : to - low] += x @ heavy[b:e]
    return once, twice


def _pca_of(points: dense.Points, n_bits: int, dims: int) -> np.ndarray:
    """``pca``'s points of the different strings, copies counted, from the hashes that the driver holds."""
    words = points.words[points.first].astype(np.int64)
    x = np.stack([words[:, k // 32] >> (31 - k % 32) & 1 for k in range(n_bits)], axis=1).astype(float)
    x -= np.average(x, axis=0, weights=points.copies)
    loadings = np.linalg.eigh((x * points.copies[:, None]).T @ x)[1][:, ::-1][:, :dims]
    largest = np.take_along_axis(loadings, np.abs(loadings).argmax(axis=0)[None], axis=0)
    return np.pad(x @ (loadings * np.where(largest >= 0, 1.0, -1.0)), ((0, 0), (0, max(0, dims - n_bits))))


def _tsne_by_blocks(hashes: DataFrame, n_bits: int, dims: int, perplexity: float, iterations: int, rate: float) -> DataFrame:
    """The same for many hashes. Copies start and stay together, so they are one place with a weight. Affinities
    depend on the distance alone, so a row has n_bits + 1. The floor of 1e-12 under the map's own shares is left out.

    All pairs are met in each round. Affinities at their floor are one number, so only the pairs above it, which are
    found once and held by the executors, are met one by one; the floor's part falls out of the sums over all pairs.
    """
    spark = hashes.sparkSession
    context, points = spark.sparkContext, dense.collected(hashes)
    codes, weight, n = points.codes, points.copies.astype(float), len(points.first)
    rows = -(-n // ROUND_TASKS)
    held = context.broadcast((codes, weight))

    def count(low, high):
        codes, weight = held.value
        for at in range(low, high, dense.rows_at_once(n)):
            d = dense.between(codes[at : min(high, at + dense.rows_at_once(n))], codes)
            flat = d + np.arange(len(d))[:, None] * (n_bits + 1)
            each = np.bincount(flat.ravel(), np.broadcast_to(weight, d.shape).ravel(), len(d) * (n_bits + 1)).reshape(len(d), -1)
            yield pa.record_batch([pa.array(np.arange(at, at + len(d))), pa.array(each.tolist())], names=["at", "n"])

    found = dense.by_block(spark, n, rows, count, "at long, n array<double>").toArrow()
    counts = np.array(found.column("n").to_pylist())[np.argsort(found.column("at").to_numpy())]
    counts[:, 0] -= 1
    q = context.broadcast(shares(counts, perplexity) / (2 * len(points.idx)))
    blocks = context.parallelize(range(0, n, rows), -(-n // rows))
    linked = blocks.map(lambda low: (low, near_links(held.value[0], q.value, low, min(n, low + rows)))).persist(StorageLevel.MEMORY_AND_DISK)

    def gradient(y, early):
        now = context.broadcast(y)

        def pull(block):
            (low, links), weight, share, y = block, held.value[1], q.value, now.value
            once, twice = closeness(y, weight, low, min(n, low + rows))
            own = y[low : low + rows]
            near = FLOOR * (once[:, :1] * own - once[:, 1:])
            axes, share = [np.ascontiguousarray(c) for c in y.T], np.ascontiguousarray(share.T)
            heavy = share * weight
            for part in links:
                near[part[0] - low : part[0] - low + part[1].shape[1]] += attraction(axes, weight, heavy, share, part)
            return once[:, 0] - 1, near, twice[:, :1] * own - twice[:, 1:]

        made = linked.map(pull).collect()
        now.destroy()
        total, near, apart = (np.concatenate(x) for x in zip(*made, strict=True))
        return 4 * (early * near - apart / (weight @ total))

    y = descend(_pca_of(points, n_bits, dims), weight, gradient, iterations, rate)
    linked.unpersist()
    made = pa.table({"file_idx": points.idx, "point": pa.array(y[points.kind].tolist(), pa.list_(pa.float64()))})
    return spark.createDataFrame(made)


def project(hashes: DataFrame, n_bits: int, method: str = "pca", dims: int = 3, **options) -> DataFrame:
    if method == "pca":
        return pca(hashes, n_bits, dims)[0]
    if method == "tsne":
        return tsne(hashes, n_bits, dims, **options)
    raise ValueError("method must be pca or tsne")


def scatter(points: DataFrame, members: DataFrame) -> DataFrame:
    """(file_idx, x, y, z, group, colour_idx) for drawing; points without a group have group -1."""
    from kinprint.functions.text import palette_index

    joined = points.join(members.select("file_idx", "group"), "file_idx", "left")
    group = F.coalesce("group", F.lit(-1))
    axis = lambda k: F.coalesce(F.get("point", F.lit(k)), F.lit(0.0))
    return joined.select("file_idx", axis(0).alias("x"), axis(1).alias("y"), axis(2).alias("z"), group.alias("group"), palette_index(group).alias("colour_idx"))


def nearest(points: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    """The one point nearest to a place, if it is within the radius."""
    d = F.sqrt(F.pow(F.col("x") - x, 2) + F.pow(F.col("y") - y, 2))
    return points.withColumn("distance", d).orderBy("distance", "file_idx").limit(1).filter(F.col("distance") <= radius)
