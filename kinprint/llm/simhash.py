"""SimHash near-duplicates: fingerprints joined to each other by a binary trie walk.

Fingerprints are collapsed first (one row for each distinct one), so a group of exact copies
costs one row however large it is. Distinct fingerprints go, once for each block of bits, to the
bucket of that block's value; in a bucket the walk of ``kinprint.llm.trie`` finds every pair
within the budget. A string has a bounded number of neighbours within the budget, so pairs stay
in proportion to distinct fingerprints. A bucket of more than ``HOT`` strings is divided by its
next bits: a string stays in its own cell and visits the cells within the budget. Components are
found by ``connected_components`` on the distributed edge table, whose nodes are fingerprints.

``similar`` and ``keep_one``, of the pipeline, link texts by the Jaccard similarity of their sets of
five-word shingles. SimHash gives the candidates: ``WORDS`` fingerprints of a set are read as strings
of ``STRING`` bits, one of which must be within ``STRING_BUDGET``; the sets themselves decide.

Defined results: null text counts as empty; a text without words has fingerprint zero and
links to others like any; repeated rows and repeated ids are rows of their own, each with the
component of its own fingerprint; null ids link like others but never name a component, so a component
of null ids only has a null id; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinprint.llm import trie
from kinprint.llm.blocks import pack, release, unpack
from kinprint.operators.components import connected_components
from kinprint.session import fresh, written

HOT = 50_000  # strings of a bucket beyond which it is divided
CELL_BITS = 10  # bits by which it is divided
CHUNK = 1 << 15  # shingles whose bits are counted at once


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``width`` words, repeats included."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, and the six ASCII breaks only
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, 42) for s in shingles), np.uint64)


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64-bit hash derived from ``h``; the 0-th is ``h`` itself."""
    if not k:
        return h
    with np.errstate(over="ignore"):
        x = h + np.uint64((0x9E3779B97F4A7C15 * k) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def simhash(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), CHUNK):
        part = np.ascontiguousarray(h[at : at + CHUNK]).astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int, n_words: int = 1, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, fp): ``fp`` is an array of ``n_words`` 64-bit fingerprints in signed longs."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            rows = []
            for text in texts:
                h = shingle_hashes(text, width)
                rows.append([simhash(mixed(h, k)) if len(h) else 0 for k in range(n_words)])
            words = np.array(rows, np.uint64).reshape(len(rows), n_words).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words.tolist(), pa.list_(pa.int64()))], names=["id", "fp"]
            )

    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")
    ).mapInArrow(run, "id long, fp array<long>")


def _walker(bits: int, budget: int, limit: int | None, how: str):
    """Joins the strings of a partition (key, guest, s, id, check) to edges (u, v).

    A pair counts where its strings differ in ``budget`` bits and its checks in ``limit`` bits at most. All
    pairs are found. ``how`` tells which are edges:

    * ``star``: as many as link what the pairs link, from the least id of each set that they join;
    * ``closest``: for each string u the v of the least difference between the checks, and that (u, v, differ);
    * ``apart``: all whose ``part`` differs.

    In the first two, edges follow the number of strings and not that of a group's pairs.
    """

    def edges(u, v):
        once = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(once[:, 0]), pa.array(once[:, 1])], names=["u", "v"])

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        key = table.column("key").to_numpy()
        string = table.column("s").to_numpy().view(np.uint64)
        order = np.lexsort((string, key))
        key, string = key[order], string[order]
        guest = table.column("guest").to_numpy(zero_copy_only=False)[order]
        check = pc.list_flatten(table.column("check").combine_chunks()).to_numpy().view(np.uint64).reshape(len(key), -1)[order]
        ids = table.column("id").to_numpy()[order]
        known, node = np.unique(ids, return_inverse=True)
        root = np.arange(len(known))
        partner, least = np.full(len(key), -1), np.full(len(key), 64 * check.shape[1] + 1)
        # A trie for each bucket, over its distinct strings; all buckets are walked together.
        new_key = np.r_[True, key[1:] != key[:-1]]
        first = np.flatnonzero(new_key | np.r_[True, string[1:] != string[:-1]])
        count = np.diff(np.r_[first, len(key)])
        if how == "apart":
            part = table.column("part").to_numpy()[order]
            place = table.column("place").to_numpy()[order]
            low, high = np.minimum.reduceat(part, first), np.maximum.reduceat(part, first)
        # Rows with the very same string are neighbours too.
        same = np.flatnonzero(count > 1)
        walk = trie.self_join(string[first], bits, budget, begins=np.flatnonzero(new_key[first]))
        for i, j in chain(walk, [(same, same)]):
            if how == "apart":
                some = (low[i] != high[j]) | (low[j] != high[i])
                i, j = i[some], j[some]
            for a, b in _expanded(i, j, first, count):
                ok = ~(guest[a] & guest[b])
                if how == "apart":
                    ok &= part[a] != part[b]
                a, b = a[ok], b[ok]
                if limit is not None:
                    differ = np.bitwise_count(check[a] ^ check[b]).sum(axis=1, dtype=np.int64)
                    ok = differ <= limit
                    a, b, differ = a[ok], b[ok], differ[ok]
                if how == "apart" and len(a):
                    # A pair meets in many lanes and blocks; the first of them tells it.
                    ok = _first_place(check[a] ^ check[b], bits, budget) == place[a]
                    a, b = a[ok], b[ok]
                if how == "star":
                    _join(root, node[a], node[b])
                elif how == "apart" and len(a):
                    yield edges(ids[a], ids[b])
                elif len(a):
                    one, other, differ = np.r_[a, b], np.r_[b, a], np.r_[differ, differ]
                    best = np.lexsort((differ, one))
                    best = best[np.r_[True, one[best][1:] != one[best][:-1]]]
                    best = best[differ[best] < least[one[best]]]
                    least[one[best]], partner[one[best]] = differ[best], other[best]
        at = np.flatnonzero(root != np.arange(len(root)))
        if len(at):
            yield edges(known[root[at]], known[at])
        at = np.flatnonzero(partner >= 0)
        if len(at):
            columns = [pa.array(ids[at]), pa.array(ids[partner[at]]), pa.array(least[at])]
            yield pa.RecordBatch.from_arrays(columns, names=["u", "v", "differ"])
        release()

    return run


def _first_place(x: np.ndarray, bits: int, budget: int) -> np.ndarray:
    """The first lane, and block of it, in which pairs of whole fingerprints meet, by the bits in which they differ."""
    mask = np.uint64((1 << bits) - 1)
    lanes = np.stack([(x >> np.uint64(k * bits)) & mask for k in range(64 // bits)], axis=2).reshape(len(x), -1)
    lane = (np.bitwise_count(lanes) <= budget).argmax(axis=1)
    own = lanes[np.arange(len(x)), lane]
    blocks = trie.cuts(bits, budget)
    equal = [(own >> np.uint64(bits - at - width)) & np.uint64((1 << width) - 1) == 0 for at, width in blocks]
    return lane * len(blocks) + np.stack(equal, axis=1).argmax(axis=1)


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union the nodes of each pair; ``root`` leads every node to the least of its set."""
    while len(a):
        a, b = root[a], root[b]
        differ = a != b
        low, high = np.minimum(a, b)[differ], np.maximum(a, b)[differ]
        if not len(low):
            return
        np.minimum.at(root, high, low)
        while not np.array_equal(deeper := root[root], root):
            root[:] = deeper
        a, b = low, high


def _expanded(i, j, first, count, step=1 << 17):
    """Row pairs of pairs of runs, ``step`` at once however long a run is; a run with itself gives each pair once."""
    size = count[i] * count[j]
    ends = np.cumsum(size)
    for at in range(0, int(ends[-1]) if len(ends) else 0, step):
        t = np.arange(at, min(at + step, int(ends[-1])))
        k = np.searchsorted(ends, t, "right")
        a, b = np.divmod(t - (ends[k] - size[k]), count[j[k]])
        ok = (i[k] != j[k]) | (a < b)
        yield first[i[k]][ok] + a[ok], first[j[k]][ok] + b[ok]


def links(strings: DataFrame, bits: int, budget: int, limit: int | None = None, how: str = "star") -> DataFrame:
    """Edges (u, v) of ``strings`` (lane, s, id, check; for ``apart`` also part), as ``_walker`` tells.

    Strings of ``bits`` bits are compared within their lane. For ``star`` and ``closest``, (lane, s) must be distinct.
    """
    spark = strings.sparkSession
    blocks = trie.cuts(bits, budget)
    mask = (1 << bits) - 1
    carried = ["id", "check", *(["part"] if how == "apart" else [])]
    # The block is turned to the front, so that buckets and cells are leading bits.
    turned = []
    for k, (at, width) in enumerate(blocks):
        if at == 0:
            t = F.col("s")
        else:
            t = F.shiftleft("s", at).bitwiseOR(F.shiftrightunsigned("s", bits - at))
            t = t.bitwiseAND(F.lit(mask)) if bits < 64 else t
        front = F.shiftrightunsigned(t, bits - width)
        turned.append(F.struct(F.lit(k).alias("block"), front.alias("front"), t.alias("t"), F.lit(width).alias("width")))
    rows = strings.select("lane", *carried, F.explode(F.array(*turned)).alias("x")).select("lane", *carried, "x.*")
    key, place = F.xxhash64("lane", "block", "front").alias("key"), (F.col("lane") * len(blocks) + F.col("block")).cast("long")
    rows = rows.select(key, "t", "width", *carried, *([place.alias("place")] if how == "apart" else []))
    carried += ["place"] if how == "apart" else []

    total = strings.count()
    sizes = rows.groupBy("key").count().filter(F.col("count") > HOT).select("key")
    if total > HOT and sizes.limit(1).count():
        masks = [0] + [
            sum(1 << b for b in chosen)
            for r in range(1, budget + 1)
            for chosen in combinations(range(CELL_BITS), r)
        ]
        own = F.expr(f"shiftrightunsigned(t, cast({bits - CELL_BITS} - width as int)) & {(1 << CELL_BITS) - 1}")
        cold = rows.join(sizes, "key", "left_anti").select("key", F.lit(False).alias("guest"), "t", *carried)
        hot = (
            rows.join(sizes, "key", "left_semi")
            .withColumn("own", own)
            .withColumn("flip", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])))
            .withColumn("cell", F.col("own").bitwiseXOR(F.col("flip")))
            .filter("cell >= own")
            .select(F.xxhash64("key", "cell").alias("key"), (F.col("flip") != 0).alias("guest"), "t", *carried)
        )
        rows = cold.unionByName(hot)
    else:
        rows = rows.select("key", F.lit(False).alias("guest"), "t", *carried)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * len(blocks) // 200_000)
    rows = rows.withColumnRenamed("t", "s").repartition(parts, "key")
    schema = "u long, v long, differ long" if how == "closest" else "u long, v long"
    return rows.mapInArrow(_walker(bits, budget, limit, how), schema).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, budget: int = 2, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, fp, component): one 64-bit fingerprint a row, linked within ``budget`` bits."""
    prints = written(fingerprints(docs, width, 1, id_col, text_col), "simhash").select("id", "fp", F.col("fp")[0].alias("node"))
    reps = written(prints.groupBy("node").agg(F.min("id").alias("id")), "simhash-reps")
    strings = reps.select(F.lit(0).alias("lane"), F.col("node").alias("s"), F.col("node").alias("id"), F.array(F.lit(0).cast("long")).alias("check"))
    joined = written(connected_components(links(strings, 64, budget), "u", "v"), "simhash-joined")
    named = reps.join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("part"), "id")
    named = named.join(named.groupBy("part").agg(F.min("id").alias("component")), "part").select("node", "component")
    return prints.join(named, "node").select("id", "fp", "component")


# --- near-duplicates by similarity --------------------------------------------------------
# Of a pair of similarity 0.8 a SimHash bit differs with arccos(2 * 0.8 / 1.8) / pi = 0.152. One of 24
# strings of 32 bits is within 3 bits for 99.93 % of such pairs (99.999 % at 0.85); all 768 bits are within CHECK
# for 99.1 % (117 expected, deviation 10; 99.9 % at 0.82), which pairs of 0.6 pass in 0.1 %. What is linked is decided by the sets
# alone: 5 x common >= 4 x all shingles.
WIDTH = 5
WORDS, STRING, STRING_BUDGET, CHECK = 12, 32, 3, 140
CHECK_ONE = 22  # of 64 bits, for the pairs that are tried first
TRIED = 6  # pairs of a node that are tried first
SHARE = (4, 5)  # similarity from which two texts are linked, as a fraction
MAX_BROADCAST = 1_000_000  # candidates' keys that are broadcast to the scan; more are joined


def shingle_set(text: bytes | None) -> np.ndarray:
    """The distinct shingles' hashes, sorted; a phrase that a text repeats counts once."""
    return np.unique(shingle_hashes(text, WIDTH))


def _node(h: np.ndarray) -> int:
    """Names a set: texts of equal sets are one node."""
    return xxhash.xxh3_64_intdigest(h.astype("<u8").tobytes()) - (1 << 63)


def _sketches(batches):
    for batch in batches:
        node, prints = [], []
        for text in batch.column(2).cast(pa.binary()).to_pylist():
            h = shingle_set(text)
            node.append(_node(h))
            prints.append([simhash(mixed(h, k)) for k in range(WORDS)] if len(h) else None)
        flat = np.array([x for p in prints if p for x in p], np.uint64).view(np.int64)
        sizes = np.array([WORDS if p else 0 for p in prints])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(node, pa.int64()), lists], names=["id", "h", "node", "fp"]
        )
    release()


def _sets(batches):
    """(node, text) to each node's set, once a task however many copies of its text there are."""
    done = set()
    for batch in batches:
        nodes, sizes, hashes = [], [], []
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if node not in done:
                done.add(node)
                h = np.unique(shingle_set(text.cast(pa.binary()).as_py()) >> np.uint64(24))
                nodes.append(node)
                sizes.append(len(h))
                hashes.append(pack(h))
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary())], names=["node", "n", "hashes"]
        )


def _verified(batches):
    """(u, v, a, b) to the pairs whose sets a and b are similar enough."""
    for batch in batches:
        ok = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            a, b = unpack(a), unpack(b)
            common = len(np.intersect1d(a, b, assume_unique=True))
            ok.append(SHARE[1] * common >= SHARE[0] * (len(a) + len(b) - common))
        yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def _text_key(text) -> list:
    """128 bits that stand for a text, where rows are met again."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(text), F.xxhash64(F.lit("text"), text)]


def groups(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, h, part), a row for each of ``docs``: rows of one ``part`` are linked; ``h`` is the text's first key.

    Linked where the Jaccard similarity of five-word shingle sets, as 40-bit hashes, is 0.8 or more. Texts of
    equal sets are one node. First the closest few candidates of each node are verified. That joins most of a group of copies, with edges in
    proportion to nodes. Then every candidate pair that is still apart is verified.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`").cast("string")
    h = _text_key(text)[0].alias("h")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), h, text.alias("text"))
    prints = written(rows.mapInArrow(_sketches, "id long, h long, node long, fp array<long>"), "similar")
    reps = prints.filter("size(fp) > 0").groupBy("node").agg(F.min("h").alias("h"), F.first("fp").alias("fp"))
    reps = written(reps, "similar-reps")

    per_word = 64 // STRING

    def strings(nodes: DataFrame, check, *more):
        rows = nodes.select("node", "fp", *more, F.explode(F.sequence(F.lit(0), F.lit(WORDS * per_word - 1))).alias("lane"))
        s = F.expr(f"shiftrightunsigned(fp[cast(lane div {per_word} as int)], cast((lane % {per_word}) * {STRING} as int)) & {(1 << STRING) - 1}")
        return rows.select("lane", s.alias("s"), F.col("node").alias("id"), check.alias("check"), *more)

    beside = F.expr(f"array(fp[cast((lane div {per_word} + 1) % {WORDS} as int)])")
    single = strings(reps, beside)
    hub = F.min(F.struct(F.xxhash64("lane", "id").alias("order"), "id", "check")).alias("hub")
    hubs = single.groupBy("lane", "s").agg(hub, F.count(F.lit(1)).alias("n"))
    hubs = written(hubs.select("lane", "s", "hub.id", "hub.check", "n"), "similar-hubs")
    shared = hubs.filter("n > 1").select("lane", "s", F.col("id").alias("hub"), F.col("check").alias("other"))
    differ = F.bit_count(F.col("check")[0].bitwiseXOR(F.col("other")[0])).cast("long").alias("differ")
    copies = single.join(shared, ["lane", "s"]).filter("hub <> id").select(F.col("id").alias("u"), F.col("hub").alias("v"), differ)
    near = links(hubs.drop("n"), STRING, STRING_BUDGET, CHECK_ONE, "closest")
    near = written(near.unionByName(copies.filter(F.col("differ") <= CHECK_ONE)), "similar-near")
    # A node has a pair for each lane and block at most; the closest few are tried now, and all others later.
    few = near.groupBy("u").agg(F.slice(F.sort_array(F.collect_set(F.struct("differ", "v"))), 1, TRIED).alias("few"))
    tried = few.select("u", F.explode(F.col("few")["v"]).alias("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    tried = written(tried.distinct(), "similar-tried")

    first = _similar(spark, rows, reps, tried)
    joined = written(connected_components(first, "u", "v"), "similar-joined")
    part = F.coalesce("component", "node").alias("part")
    # A node of a candidate pair has been tried with its closest one, so no other node has any.
    met = near.select(F.col("u").alias("node")).union(near.select("v")).distinct()
    placed = reps.join(met, "node", "left_semi").join(joined, "node", "left").select("node", "fp", part)
    rest = links(strings(placed, F.col("fp"), "part"), STRING, STRING_BUDGET, CHECK, "apart")
    second = _similar(spark, rows, reps, written(rest.join(tried, ["u", "v"], "left_anti"), "similar-rest"))
    edges = second.unionByName(joined.select(F.col("component").alias("u"), F.col("node").alias("v")))
    joined = connected_components(edges, "u", "v")
    return prints.select("id", "h", "node").join(joined, "node", "left").select("id", "h", part)


def _similar(spark, rows: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) of nodes whose sets are similar enough."""
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    wanted = written(reps.select("node", "h").join(nodes, "node", "left_semi"), "similar-wanted")
    few = wanted.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    texts = rows.select("h", "text").join(F.broadcast(wanted) if few else wanted, "h").select("node", "text")
    sets = texts.mapInArrow(_sets, "node long, n long, hashes binary").dropDuplicates(["node"])
    sets = written(sets, "similar-sets")
    sides = [
        sets.select(F.col("node").alias(node), F.col("n").alias(f"n_{node}"), F.col("hashes").alias(f"of_{node}")) for node in ("u", "v")
    ]
    able = F.least("n_u", "n_v") * SHARE[1] >= F.greatest("n_u", "n_v") * SHARE[0]
    both = pairs.join(sides[0], "u").join(sides[1], "v").filter(able).select("u", "v", "of_u", "of_v")
    return written(both.mapInArrow(_verified, "u long, v long"), "similar-edges")


def similar(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, component): the least id of each row's group; null where a group has null ids only."""
    found = written(groups(docs, id_col, text_col), "similar-groups")
    return found.join(found.groupBy("part").agg(F.min("id").alias("component")), "part").select("id", "component")


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row of each group of similar texts, with the columns of ``docs``.

    It is the row of the smallest id (null ids come last), and of rows with that id the one whose text has the
    least hash; of rows that agree in both, the least by a hash of all columns. Every other row is judged on its
    own text, so rows that share an id with a kept or a removed one neither stay nor go for that. Null and empty
    texts are one group; an empty table gives an empty table; other columns may have any name and type.
    """
    found = written(groups(docs, id_col, text_col), "similar-groups")
    best = found.groupBy("part").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("best"))
    best = best.select(F.col("best")["id"].alias("id"), F.col("best")["h"].alias("h")).distinct()
    repeated = found.groupBy("id", "h").count().filter("count > 1")
    a, b, n = (fresh(docs, x) for x in ("kept_id", "kept_text", "kept_count"))
    met = F.col("id").eqNullSafe(F.col("r_id")) & (F.col("h") == F.col("r_h"))
    best = best.join(repeated.select(F.col("id").alias("r_id"), F.col("h").alias("r_h"), "count"), met, "left")
    kept = written(best.select(F.col("id").alias(a), F.col("h").alias(b), F.coalesce("count", F.lit(1)).alias(n)), "simhash-kept")
    ident, h = F.col(f"`{id_col}`").cast("long"), _text_key(F.col(f"`{text_col}`"))[0]
    columns = [F.col(f"`{c}`") for c in docs.columns]
    tagged = docs.join(kept, ident.eqNullSafe(F.col(a)) & (h == F.col(b)))
    left = tagged.filter(F.col(n) == 1).select(*columns)
    if kept.filter(F.col(n) > 1).limit(1).count():
        plain = lambda t: isinstance(t, T.AtomicType) and not isinstance(t, T.VariantType)
        order = F.xxhash64(*[c if plain(f.dataType) else F.to_json(F.struct(c)) for c, f in zip(columns, docs.schema, strict=True)])
        least = tagged.filter(F.col(n) > 1).groupBy(a, b).agg(F.min_by(F.struct(*columns), order).alias(n))
        left = left.unionByName(least.select(*[F.col(n)[c].alias(c) for c in docs.columns]))
    return left
