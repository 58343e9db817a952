"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

A text is its words (lower-cased A-Z) joined by single spaces and closed by a line feed, so
the bytes stand for exactly the tokens that the unigram base scores. A byte is eight binary
decisions; each decision has a context tree of its own over the ``DEPTH`` bytes before. A
node holds the counts of both outcomes and their Krichevsky-Trofimov probability P_e; the
weighted probability is P_w = P_e at full depth and (P_e + product of the children's P_w) / 2
above, and a prediction mixes the estimates of all depths on the context's path by the
weights that follow. A context that training never saw has no counts and estimates 1/2.

Counting needs no bits: a decision's counts are sums over the counts of (context, byte)
grams. Those are counted over all training texts, without caps, and grow with the corpus.

1. Documents are packed into blocks of bounded size as they are read. A block writes its texts,
   and its distinct grams and words with their training counts, as packed sorted arrays by bucket.
2. A bucket merges its counts as they stream in. Keys begin with the nearest context bytes, and
   grams that share ``SHARED`` of them share a bucket, so it holds whole trees from that depth down.
   The depths above have at most 256 ** 2 contexts and reach the driver as sums.
3. A bucket computes its grams' probabilities and answers each block's arrays in their order; a
   block adds the answers up by document.

Neither the model nor a corpus-wide vocabulary is ever held in one place; a task holds a block's
distinct grams, or a bucket's.

Words are counted by a 64-bit hash; probabilities travel as 32-bit floats. Defined results: null text counts
as empty, and an empty text is its end token alone; repeated rows and ids are rows of their own, null
ids are training rows; very long texts are scored whole; with no training rows N = V = 0 and every
decision has probability 1/2; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinprint.llm.blocks import bucket_of, dealt, pack, pack_small, release, unpack, unpack_small
from kinprint.session import written

DEPTH = 6  # context bytes; with the byte itself 56 bits of a key, and 8 bits number a batch's documents
SHARED = 3  # nearest context bytes that a group of trees has in common
BLOCK_BYTES = 16_000_000  # text of a block
BUCKET_BYTES = 32_000_000  # text for each bucket of keys
CHUNK = 1 << 19  # bytes whose grams are sorted at once
SLICE = 1 << 18  # grams whose trees are computed at once, and the rest of their group
BATCH = 256  # documents of a batch
END = b"\n"
GRAM, WORD, DOCS = 0, 1, 2


# --- texts to keys ------------------------------------------------------------------------


def tokenized(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words joined by spaces, hash of each token, tokens of each text); the end is each text's last token."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    split = pc.ascii_split_whitespace(texts)
    words = split.flatten().dictionary_encode()
    digest = xxhash.xxh64_intdigest
    distinct = words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    known = np.fromiter((digest(w) if w else 0 for w in distinct), np.uint64, len(distinct))
    empty = np.fromiter(map(len, distinct), np.int64, len(distinct)) == 0
    place = words.indices.to_numpy()
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    real = ~empty[place]  # an empty text splits into one empty word
    n = np.bincount(text[real], minlength=len(texts)) + 1
    keys = np.full(int(n.sum()), digest(END), np.uint64)
    inner = np.ones(len(keys), bool)
    inner[np.cumsum(n) - 1] = False
    keys[inner] = known[place[real]]
    return pc.binary_join(split, " "), keys, n


def grams(joined: list[bytes], depth: int = DEPTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, text) of each byte of texts and their ends, by ``CHUNK`` bytes.

    A key has the nearest context byte first, then the farther ones, then the byte itself.
    """
    lead = END * depth
    size = np.fromiter((len(x) + 1 for x in joined), np.int64, len(joined))
    # Every text's end is followed by the lead of the next.
    buffer = lead + (END + lead).join(joined) + END + bytes(8)
    first = np.cumsum(size + depth) - size - depth  # of each text's lead
    window = np.ndarray(len(buffer) - 8, "<u8", buffer, 0, (1,))
    low, shift = np.uint64((1 << (8 * depth)) - 1), np.uint64(8 * depth)
    total = int(size.sum())
    ends = np.cumsum(size)
    for at in range(0, total, CHUNK):
        place = np.arange(at, min(total, at + CHUNK))
        a, b = np.searchsorted(ends, [place[0], place[-1]], "right")
        inside = np.diff(np.r_[at, np.minimum(ends[a : b + 1], place[-1] + 1)])
        text = np.repeat(np.arange(a, b + 1), inside)
        w = window[place + (first - (ends - size))[text]]
        yield ((w & low) << np.uint64(8)) | ((w >> shift) & np.uint64(255)), text


# --- the trees of one group ---------------------------------------------------------------


def _log_gamma_half(n: np.ndarray) -> np.ndarray:
    """log Gamma(n + 1/2) for whole numbers n."""
    x = n + 0.5
    y = x + 6.0  # Stirling's series from 6.5 on, and back by the recurrence
    series = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return series - np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))


def _log_factorial(n: np.ndarray) -> np.ndarray:
    x = n + 1.0
    y = x + 6.0
    series = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return series - np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))


_SMALL = np.arange(4096.0)
_GAMMA, _FACTORIAL = _log_gamma_half(_SMALL), _log_factorial(_SMALL)


def _by_table(n: np.ndarray, table: np.ndarray, exact) -> np.ndarray:
    out = table[np.minimum(n, len(table) - 1).astype(np.int64)]
    large = n >= len(table)
    if large.any():
        out[large] = exact(n[large])
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of any sequence with these counts."""
    gamma = _by_table(zeros, _GAMMA, _log_gamma_half) + _by_table(ones, _GAMMA, _log_gamma_half)
    return gamma - math.log(math.pi) - _by_table(zeros + ones, _FACTORIAL, _log_factorial)


def mixture(own: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weight of a node's own estimate, and its log P_w."""
    return 1 / (1 + np.exp(np.clip(split - own, -700, 700))), np.logaddexp(own, split) - math.log(2)


class Trees:
    """The trees of one group of contexts, from the sorted distinct grams and their counts.

    A level is the sorted distinct (context, byte) pairs of a depth. The pairs of one decision (a
    context and the bits so far) are neighbours in that order, so nodes are runs and need no
    search; ``up`` leads from a pair to that of the next shorter context.
    """

    def __init__(self, key: np.ndarray, n: np.ndarray, depth: int, shallowest: int):
        self.shallowest = shallowest
        self.pairs, self.counts, self.up = [key], [n.astype(np.float64)], []
        for _ in range(depth, shallowest, -1):
            last = self.pairs[-1]
            shorter = ((last >> np.uint64(16)) << np.uint64(8)) | (last & np.uint64(255))
            pair, place = np.unique(shorter, return_inverse=True)
            self.up.append(place.astype(np.int32))
            self.pairs.append(pair)
            self.counts.append(np.bincount(place, weights=self.counts[-1], minlength=len(pair)))

    def decided(self, j: int):
        """For bit j, from the deepest level up: (run of each pair, first pair of each run, zeros, ones, weight, log P_w)."""
        below, levels = None, []
        for k, (pair, count) in enumerate(zip(self.pairs, self.counts, strict=True)):
            so_far = pair >> np.uint64(8 - j)
            new = np.r_[True, so_far[1:] != so_far[:-1]] if len(pair) else np.empty(0, bool)
            run, first = (np.cumsum(new) - 1).astype(np.int32), np.flatnonzero(new)
            bit = ((pair >> np.uint64(7 - j)) & np.uint64(1)).astype(np.float64)
            both = np.add.reduceat(count, first) if len(first) else count
            ones = np.add.reduceat(count * bit, first) if len(first) else count
            zeros = both - ones
            own = log_kt(zeros, ones)
            if below is None:
                weight, log_w = np.ones(len(first)), own
            else:
                child_first, child_log = below
                split = np.bincount(run[self.up[k - 1][child_first]], weights=child_log, minlength=len(first))
                weight, log_w = mixture(own, split)
            levels.append((run, first, zeros, ones, weight, log_w))
            below = first, log_w
        return levels

    def summary(self):
        """(node, zeros, ones, log P_w) of the shallowest level; a node is context * 256 + (1 and the bits so far)."""
        parts = []
        for j in range(8):
            _, first, zeros, ones, _, log_w = self.decided(j)[-1]
            pair = self.pairs[-1][first]
            bits = np.uint64(1 << j) | ((pair & np.uint64(255)) >> np.uint64(8 - j))
            parts.append((((pair >> np.uint64(8)) << np.uint64(8)) | bits, zeros, ones, log_w))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def log10_probability(self, top: list[Top]) -> np.ndarray:
        """log10 of each gram's byte after its context; ``top`` has the depths above.

        Down the path, a prediction is ``settled + open * (what the deeper depths say)``.
        """
        product = np.ones(len(self.pairs[0]))
        for j in range(8):
            pair = self.pairs[-1]
            settled, open_ = np.zeros(len(pair)), np.ones(len(pair))
            bit = ((pair >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
            so_far = np.uint64(1 << j) | ((pair & np.uint64(255)) >> np.uint64(8 - j))
            for d, level in enumerate(top):
                context = pair >> np.uint64(8 * (1 + self.shallowest - d)) if d else np.zeros(len(pair), np.uint64)
                at = np.searchsorted(level.node, (context << np.uint64(8)) | so_far)
                settled += open_ * level.weight[at] * estimate(level.zeros[at], level.ones[at], bit)
                open_ *= 1 - level.weight[at]
            for k, (run, _, zeros, ones, weight, _) in reversed(list(enumerate(self.decided(j)))):
                if k < len(self.pairs) - 1:
                    settled, open_ = settled[self.up[k]], open_[self.up[k]]
                    bit = ((self.pairs[k] >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
                settled = settled + open_ * weight[run] * estimate(zeros[run], ones[run], bit)
                open_ = open_ * (1 - weight[run])
            product *= settled
        return np.log10(product)


def estimate(zeros: np.ndarray, ones: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1.0)


class Top:
    """One of the uppermost depths, by sorted node: context * 256 + (1 and the bits so far)."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, split: np.ndarray):
        self.node, place = np.unique(node, return_inverse=True)
        self.zeros, self.ones, below = (np.bincount(place, weights=x, minlength=len(self.node)) for x in (zeros, ones, split))
        self.weight, self.log_w = mixture(log_kt(self.zeros, self.ones), below)


def parent(node: np.ndarray) -> np.ndarray:
    """The node of the context that is one byte shorter."""
    return ((node >> np.uint64(16)) << np.uint64(8)) | (node & np.uint64(255))


def tops(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, log_w: np.ndarray, deepest: int) -> list[Top]:
    """The depths from 0 to ``deepest``, from sums over the children by node of the deepest one."""
    levels = [Top(node.astype(np.uint64), zeros, ones, log_w)]
    for _ in range(deepest):
        last = levels[0]
        levels.insert(0, Top(parent(last.node), last.zeros, last.ones, last.log_w))
    return levels


# --- over the corpus ----------------------------------------------------------------------


def held_out(id_column: Column) -> Column:
    """True where crc32 of the id as text leaves 2 on division by 7; a null id is a training row."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string")), F.lit(7)) == 2, F.lit(False))


class Counter64:
    """Distinct 64-bit keys with counts, merged as chunks come in."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.pending = 0

    def add(self, key: np.ndarray, counted: bool) -> None:
        k, n = np.unique(key, return_counts=True)
        self.put(k, n if counted else np.zeros(len(k), np.int64))

    def put(self, key: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((key, n))
        self.pending += len(key)
        if len(self.parts) > 1 and self.pending > 2 * len(self.parts[0][0]) + CHUNK:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        key = np.concatenate([k for k, _ in self.parts])
        n = np.concatenate([c for _, c in self.parts])
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        key, n = key[edge], np.add.reduceat(n, edge) if len(edge) else n
        self.parts, self.pending = [(key, n)], len(key)
        return key, n


def near(key: np.ndarray, depth: int) -> np.ndarray:
    """The nearest context bytes of a key: the trees that it belongs to."""
    return key >> np.uint64(8 * (depth + 1 - SHARED))


def pieces(table: pa.RecordBatch, text: int):
    """Runs of ``BATCH`` rows at most, and of ``CHUNK`` bytes where more than one."""
    size = np.cumsum(pc.fill_null(pc.binary_length(table.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < table.num_rows:
        before = size[at - 1] if at else 0
        to = max(at + 1, min(at + BATCH, int(np.searchsorted(size, before + CHUNK, "right"))))
        yield table.slice(at, to - at), int(size[to - 1] - before)
        at = to


BLOCKS = "kind int, bucket int, block long, keys binary, counts binary"
_BLOCKS = pa.schema(
    [("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]
)


def _row(kind: int, bucket: int, block: int, keys: bytes, counts: bytes | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((kind, bucket, block, keys, counts), _BLOCKS, strict=True)], schema=_BLOCKS)


def _packed(kind: int, block: int, key: np.ndarray, n: np.ndarray, buckets: np.ndarray):
    for bucket, at in dealt(buckets):
        yield _row(kind, bucket, block, pack(key[at]), pack_small(n[at].astype("<i8")))


def _stored(rows: list[pa.RecordBatch]) -> bytes:
    """A block's rows as one compressed batch."""
    whole = pa.Table.from_batches(rows).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_table(whole)
    return sink.getvalue().to_pybytes()


def distinct(rows: pa.RecordBatch, depth: int, counted: bool, g: Counter64, w: Counter64) -> None:
    """Add the grams and words of a piece (id, held, text) to both counters."""
    joined, words, _ = tokenized(rows.column(2))
    if len(joined):
        w.add(words, counted)
        for key, _ in grams(joined.cast(pa.binary()).to_pylist(), depth):
            g.add(key, counted)


def blocks(rows: DataFrame, depth: int, buckets: int) -> DataFrame:
    """Rows (id, held, text) packed into blocks, and each block's keys; counts are of training rows only."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held, size, g, w = [], 0, Counter64(), Counter64()

        def closed():
            yield _row(DOCS, 0, number, _stored(held), None)
            key, n = g.merge()
            yield from _packed(GRAM, number, key, n, bucket_of(near(key, depth), buckets))
            key, n = w.merge()
            yield from _packed(WORD, number, key, n, bucket_of(key, buckets))

        for batch in batches:
            for piece, n_bytes in pieces(batch, 2):
                held.append(piece)
                size += n_bytes + BATCH
                out = piece.column(1).to_numpy(zero_copy_only=False).astype(bool)
                for counted in (True, False):
                    distinct(piece.filter(pa.array(out != counted)), depth, counted, g, w)
                if size >= BLOCK_BYTES:
                    yield from closed()
                    number += 1
                    held, size, g, w = [], 0, Counter64(), Counter64()
        if held:
            yield from closed()
        del held, g, w
        release()

    return rows.select("id", "held", "text").mapInArrow(run, BLOCKS)


def _streamed(merge):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from merge(batches)

    # Types as objects: functions are shipped by value, and Spark tells the streamed form by them.
    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def corpus_counts(asked: DataFrame) -> DataFrame:
    """One row a bucket: its distinct keys and their counts."""

    def merge(batches):
        counter, name = Counter64(), None
        for batch in batches:
            for k in range(batch.num_rows):
                kind, bucket, _, keys, counts = (column[k].as_py() for column in batch.columns)
                name = kind, bucket
                counter.put(unpack(keys), unpack_small(counts, "<i8"))
        key, n = counter.merge()
        del counter
        yield _row(*name, 0, pack(key), pack_small(n.astype("<i8")))
        del key, n
        release()

    return asked.groupBy("kind", "bucket").applyInArrow(_streamed(merge), BLOCKS)


def slices(key: np.ndarray, depth: int):
    """Ranges of sorted grams of about ``SLICE``; grams that share their trees stay together."""
    at = 0
    while at < len(key):
        to = min(len(key), at + SLICE)
        if to < len(key):
            to = int(np.searchsorted(near(key[to - 1 :], depth), near(key[to - 1 : to], depth)[0], "right")) + to - 1
        yield slice(at, to)
        at = to


def top_levels(counts: DataFrame, depth: int) -> list[Top]:
    """The depths above ``SHARED``, from sums over the buckets: at most 255 nodes for each of 256 ** 2 contexts."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                key, n = unpack(batch.column(0)[k].as_py()), unpack_small(batch.column(1)[k].as_py(), "<i8")
                for part in slices(key, depth):
                    node, *sums = Trees(key[part], n[part], depth, SHARED).summary()
                    known, place = np.unique(parent(node), return_inverse=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(known.astype(np.int64)), *(pa.array(np.bincount(place, weights=x, minlength=len(known))) for x in sums)],
                        names=["node", "zeros", "ones", "log_w"],
                    )

    sums = (
        counts.filter(F.col("kind") == GRAM).select("keys", "counts")
        .mapInArrow(run, "node long, zeros double, ones double, log_w double")
        .groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log_w").alias("log_w"))
    )
    got = sums.toArrow()
    return tops(*(got.column(c).to_numpy() for c in ("node", "zeros", "ones", "log_w")), SHARED - 1)


def word_totals(counts: DataFrame) -> tuple[int, int]:
    """All training tokens, and the distinct ones."""

    def total(batches):
        for batch in batches:
            counted = [unpack_small(x, "<i8") for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(x.sum()) for x in counted]), pa.array([int((x > 0).sum()) for x in counted])], names=["n", "v"]
            )

    words = counts.filter(F.col("kind") == WORD).select("counts").mapInArrow(total, "n long, v long")
    found = words.agg(F.sum("n"), F.sum("v")).first()
    return int(found[0] or 0), int(found[1] or 0)


def _answered(depth: int, shipped):
    """Each block's keys of a bucket with what the bucket knows: log10 probabilities of grams, counts of words."""

    def run(asked: pa.Table, counts: pa.Table) -> pa.Table:
        key, value = unpack(counts.column("keys")[0].as_py()), unpack_small(counts.column("counts")[0].as_py(), "<i8")
        if counts.column("kind")[0].as_py() == GRAM:
            found = np.empty(len(key), "<f4")
            for part in slices(key, depth):
                found[part] = Trees(key[part], value[part], depth, SHARED).log10_probability(shipped.value)
            value = found
        answers = [pack_small(value[np.searchsorted(key, unpack(x.as_py()))]) for x in asked.column("keys")]
        del key, value
        release()
        return asked.select(["kind", "bucket", "block"]).append_column("answers", pa.array(answers, pa.binary()))

    return run


def _values(key: np.ndarray, buckets: np.ndarray, by: dict[int, bytes], dtype: str) -> np.ndarray:
    """The values of a block's sorted keys, from the answers of each bucket, which are in the keys' order."""
    value = np.empty(len(key), dtype)
    for bucket, at in dealt(buckets):
        value[at] = unpack_small(by[bucket], dtype)
    return value


def _sums(key: np.ndarray, text: np.ndarray, n: int, known: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The sum of the grams' values for each of ``n`` texts. Keys carry their text's number through the sort."""
    both = np.sort((key << np.uint64(8)) | text.astype(np.uint64))
    key = both >> np.uint64(8)
    new = np.r_[True, key[1:] != key[:-1]]
    place = np.searchsorted(known, key[new])[np.cumsum(new) - 1]
    return np.bincount((both & np.uint64(255)).astype(np.int64), weights=value[place], minlength=n)


SCORED = "id long, held boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"


def _scored(depth: int, buckets: int, n_tokens: int, n_words: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        by: dict[int, dict[int, bytes]] = {GRAM: {}, WORD: {}}
        for kind, bucket, x in zip(*(answers.column(c) for c in ("kind", "bucket", "answers")), strict=True):
            by[kind.as_py()][bucket.as_py()] = x.as_py()
        block = next(iter(pa.ipc.open_stream(docs.column("keys")[0].as_py())))
        g, w = Counter64(), Counter64()
        for piece, _ in pieces(block, 2):
            distinct(piece, depth, False, g, w)
        gram, word = g.merge()[0], w.merge()[0]
        chance = _values(gram, bucket_of(near(gram, depth), buckets), by[GRAM], "<f4")
        count = _values(word, bucket_of(word, buckets), by[WORD], "<i8")
        share = np.log10((count + 1) / (n_tokens + n_words + 1))
        del g, w, by
        out = []
        for piece, _ in pieces(block, 2):
            joined, keys, n = tokenized(piece.column(2))
            place = np.searchsorted(word, keys)
            first = np.cumsum(n) - n
            joined = joined.cast(pa.binary()).to_pylist()
            total = np.zeros(len(joined))
            for key, text in grams(joined, depth):
                total += _sums(key, text, len(joined), gram, chance)
            out.append(
                pa.table(
                    {
                        "id": piece.column(0), "held": piece.column(1), "n_tokens": pa.array(n),
                        "n_known": pa.array(np.add.reduceat((count[place] > 0).astype(np.int64), first)),
                        "base_score": pa.array(np.add.reduceat(share[place], first)), "score": pa.array(total),
                        "n_bytes": pa.array(np.array([len(x) + 1 for x in joined], np.int64)),
                    }
                )
            )
        del gram, word, chance, count, share
        release()
        return pa.concat_tables(out)

    return run


def score(docs: DataFrame, held: Column | None = None, id_col="doc_id", text_col="text", depth: int = DEPTH) -> DataFrame:
    """(id, held, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte), a row a document."""
    if not SHARED < depth <= 6:
        raise ValueError("depth must leave room in a key for a document's number, and trees below the shared bytes")
    spark = docs.sparkSession
    ident = F.col(f"`{id_col}`")
    rows = docs.select(
        ident.cast("long").alias("id"), (held_out(ident) if held is None else held).alias("held"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    buckets = max(4 * spark.sparkContext.defaultParallelism, math.ceil(size / BUCKET_BYTES))
    stored = written(blocks(rows, depth, buckets), "ctw-blocks")
    asked = stored.filter(F.col("kind") != DOCS)
    counts = written(corpus_counts(asked), "ctw-counts")
    n_tokens, n_words = word_totals(counts)
    shipped = spark.sparkContext.broadcast(top_levels(counts, depth))
    by = ("kind", "bucket")
    answers = asked.drop("counts").groupBy(*by).cogroup(counts.groupBy(*by)).applyInArrow(
        _answered(depth, shipped), "kind int, bucket int, block long, answers binary"
    )
    texts = stored.filter(F.col("kind") == DOCS).select("block", "keys")
    found = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored(depth, buckets, n_tokens, n_words), SCORED)
    return found.select(
        "id", "held", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score",
        "n_bytes", (-F.col("score") / F.lit(math.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
