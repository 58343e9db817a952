"""Exact removal of repeated byte strings, by suffix buckets that are refined by bucket pointers.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts in a document with a smaller id.
All positions are judged, but not all travel:

1. Sampled suffixes. Every string of LENGTH bytes has an anchor, the position of its least
   hashed ``Q``-gram (all of them where several tie); equal strings have it at equal offsets. A block of
   documents sends its distinct anchors' Q-gram buckets, and learns which of them hold
   suffixes of more than one document. The others repeat nothing.
2. Bucket-pointer refinement. For anchors in shared buckets, a block sends each distinct
   context (all bytes that a string with this anchor can have) once, with its smallest id. In a
   bucket, positions get the number of their 8-gram's bucket by sorting; the buckets of 16, 32
   and LENGTH bytes follow by sorting on pairs of bucket numbers, a position's own and that of a later
   offset, each round reusing the numbers of the last. Equal final numbers mean equal
   strings, without any hashing, so the smallest id of each string's bucket decides.
3. Each block marks its strings, and cuts the covered bytes out.

Blocks and buckets are bounded in text size and in number of keys; a passage in a third of all
documents costs a block one context for each of its anchors. Nothing is dropped or sampled.

Defined results: null text counts as empty; texts shorter than LENGTH bytes stay whole; strings
are judged on the input; rows with equal ids don't repeat each other, whatever their texts; a null
id is larger than every other; the longest texts are worked on in overlapping pieces with
the same result; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinprint.llm.blocks import bucket_of, dealt, pack, pack_small, unpack, unpack_small

LENGTH = 50
Q = 24
PIECE = 1 << 20  # bytes that are hashed at once
BLOCK_BYTES = 16_000_000
BUCKET_BYTES = 8_000_000
MAX_BUCKETS = 1 << 14
NO_ID = np.iinfo(np.int64).max


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x7F4A7C159E3779B9))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(31))


def _spread(x: np.ndarray, width: int, join) -> np.ndarray:
    """``join`` over every run of ``width`` entries, by doubling; for joins that may overlap."""
    n = 1
    while 2 * n <= width:
        x = join(x[:-n], x[n:])
        n *= 2
    return join(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the Q bytes at each position."""
    return _spread(data.astype(np.uint64) + np.uint64(1), Q, _mixed) if len(data) >= Q else np.empty(0, np.uint64)


class Piece:
    """Texts one after another, as far as PIECE goes; a longer text is cut with an overlap."""

    def __init__(self, parts: list[tuple[int, int, bytes]]):
        self.owner = np.array([k for k, _, _ in parts])
        self.offset = np.array([o for _, o, _ in parts])
        size = np.array([len(x) for _, _, x in parts])
        self.ends = np.cumsum(size)
        self.begins = self.ends - size
        self.data = np.frombuffer(b"".join(x for _, _, x in parts), np.uint8)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, part, key) of every anchor; keys have 48 bits."""
        none = np.empty(0, np.int64)
        if len(self.data) < LENGTH:
            return none, none, none.astype(np.uint64)
        h = gram_hashes(self.data) >> np.uint64(16)
        h += np.uint64(1)
        wide = LENGTH - Q + 1
        least = _spread(h, wide, np.minimum)
        # A window must not cross the end of a text.
        crosses = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(crosses, np.maximum(self.begins, self.ends - LENGTH + 1), 1)
        np.add.at(crosses, self.ends, -1)
        least = np.where(np.cumsum(crosses)[: len(least)] > 0, np.uint64(0), least)
        edge = np.zeros(wide - 1, np.uint64)
        most = _spread(np.concatenate([edge, least, edge]), wide, np.maximum)
        at = np.flatnonzero(h == most)
        return at, np.searchsorted(self.ends, at, "right"), h[at]

    def contexts(self, at: np.ndarray, part: np.ndarray):
        """(bytes, bytes to the left, bytes to the right) around anchors; what is outside is zero."""
        left = np.minimum(LENGTH - Q, at - self.begins[part])
        right = np.minimum(LENGTH, self.ends[part] - at)
        step = np.arange(-(LENGTH - Q), LENGTH)
        place = at[:, None] + step
        inside = (step >= -left[:, None]) & (step < right[:, None])
        return np.where(inside, self.data[np.clip(place, 0, len(self.data) - 1)], 0).astype(np.uint8), left.astype(np.uint8), right.astype(np.uint8)


WIDTH = 2 * LENGTH - Q  # bytes of a context


def pieces(texts) -> "list[Piece]":
    """Pieces over (number, text) pairs."""
    held, size = [], 0
    for k, text in texts:
        for at in range(0, max(1, len(text) - LENGTH + 1), PIECE):
            part = text[at : at + PIECE + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            if held and size + len(part) > PIECE:
                yield Piece(held)
                held, size = [], 0
            held.append((k, at, part))
            size += len(part)
    if held:
        yield Piece(held)


def _fold(rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit name for each context."""
    padded = np.zeros((len(rows), 80), np.uint8)
    padded[:, :WIDTH] = rows
    padded[:, WIDTH], padded[:, WIDTH + 1] = left, right
    words = padded.view("<u8")
    name = np.zeros(len(rows), np.uint64)
    for k in range(words.shape[1]):
        name = _mixed(name, words[:, k])
    return name


def _texts(table: pa.Table):
    """(number, text) of a block's rows, a few at a time."""
    column = table.column("text")
    for at in range(0, len(column), 512):
        for k, text in enumerate(column.slice(at, 512).cast(pa.binary()).to_pylist()):
            yield at + k, text


def _ids(table: pa.Table) -> np.ndarray:
    return np.array(table.column("id").fill_null(NO_ID).to_numpy(), np.int64)


def _asked_buckets(buckets: int):
    """A block's distinct anchors, with a flag on those of more than one document."""

    def run(table: pa.Table) -> pa.Table:
        ids, keys, docs = _ids(table), [], []
        for piece in pieces(_texts(table)):
            _, part, key = piece.anchors()
            owner = ids[piece.owner[part]]
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            new = np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])] if len(key) else np.empty(0, bool)
            keys.append(key[new])
            docs.append(owner[new])
        key = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        owner = np.concatenate(docs) if docs else np.empty(0, np.int64)
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        last = np.r_[first[1:], len(key)] - 1
        many = owner[first] != owner[last] if len(key) else np.empty(0, bool)
        key = key[first] if len(key) else key
        block = table.column("block")[0].as_py()
        rows = [(b, block, pack(key[at]), np.packbits(many[at]).tobytes()) for b, at in dealt(bucket_of(key, buckets))]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.table(
            {
                "bucket": pa.array(cols[0], pa.int32()), "block": pa.array(cols[1], pa.int32()),
                "keys": pa.array(cols[2], pa.binary()), "many": pa.array(cols[3], pa.binary()),
            }
        )

    return run


def _shared_buckets(table: pa.Table) -> pa.Table:
    """Which keys of each block are in more than one document, as the keys themselves."""
    keys = [unpack(x) for x in table.column("keys").to_pylist()]
    many = [
        np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)).astype(bool)
        for k, x in zip(keys, table.column("many").to_pylist(), strict=True)
    ]
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    shared = np.bincount(place, minlength=len(key)) > 1
    shared[place[np.concatenate(many)]] = True
    at, found = 0, []
    for k in keys:
        found.append(pack(k[shared[place[at : at + len(k)]]]))
        at += len(k)
    return pa.table({"block": table.column("block"), "shared": pa.array(found, pa.binary())})


def _asked_contexts(buckets: int):
    """A block's distinct contexts of shared anchors, each with its smallest id."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        empty = {"bucket": pa.int32(), "block": pa.int32(), "names": pa.binary(), "ids": pa.binary(), "sides": pa.binary(), "rows": pa.binary()}
        if not answers.num_rows or not table.num_rows:
            return pa.schema(list(empty.items())).empty_table()
        shared = np.sort(np.concatenate([unpack(x) for x in answers.column("shared").to_pylist()]))
        ids, kept = _ids(table), []
        for piece in pieces(_texts(table)):
            at, part, key = piece.anchors()
            ok = _isin(shared, key)
            at, part, key = at[ok], part[ok], key[ok]
            rows, left, right = piece.contexts(at, part)
            kept.append(_least(_fold(rows, left, right), ids[piece.owner[part]], key, left, right, rows))
            if len(kept) > 8:
                kept = [_least(*map(np.concatenate, zip(*kept, strict=True)))]
        name, owner, key, left, right, rows = _least(*map(np.concatenate, zip(*kept, strict=True)))
        block = table.column("block")[0].as_py()
        out = [
            (b, block, pack_small(name[x]), pack_small(owner[x]), pack_small(np.stack([left[x], right[x]])), pack_small(rows[x]))
            for b, x in dealt(bucket_of(key, buckets))
        ]
        cols = list(zip(*out, strict=True)) or [()] * 6
        return pa.table({c: pa.array(v, kind) for (c, kind), v in zip(empty.items(), cols, strict=True)})

    return run


def _isin(known: np.ndarray, key: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(key), bool)
    return known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key


def _least(name, owner, *rest):
    """One row for each name, that of the smallest owner; sorted by name."""
    order = np.lexsort((owner, name))
    order = order[np.r_[True, name[order][1:] != name[order][:-1]]] if len(order) else order
    return name[order], owner[order], *(x[order] for x in rest)


def _numbered(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    """The number of each entry's bucket: its rank among the distinct values, or pairs of numbers."""
    value = a.ravel() if b is None else ((a.astype(np.uint64) << np.uint64(32)) | b).ravel()
    _, place = np.unique(value, return_inverse=True)
    return place.reshape(a.shape).astype(np.uint32)


def refined(rows: np.ndarray) -> np.ndarray:
    """The number of the LENGTH-byte bucket at each of a context's first LENGTH - Q + 1 positions."""
    grams = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(rows, 8, axis=1)).view("<u8")[:, :, 0]
    number, n = _numbered(grams), 8
    while 2 * n <= LENGTH:
        number = _numbered(number[:, :-n], number[:, n:])
        n *= 2
    return _numbered(number[:, : LENGTH - Q + 1], number[:, LENGTH - n : LENGTH - n + LENGTH - Q + 1])


#: Contexts that are refined at once.
GROUP = 1 << 14


def _judged(table: pa.Table) -> pa.Table:
    """For each context of each block, the strings that also start in a smaller document."""
    names = [unpack_small(x, "<u8") for x in table.column("names").to_pylist()]
    ids = np.concatenate([unpack_small(x, "<i8") for x in table.column("ids").to_pylist()])
    sides = np.concatenate([unpack_small(x, np.uint8).reshape(2, -1) for x in table.column("sides").to_pylist()], axis=1)
    rows = np.concatenate([unpack_small(x, np.uint8).reshape(-1, WIDTH) for x in table.column("rows").to_pylist()])
    flags = np.zeros(len(ids), np.uint32)
    # A context that several blocks have is judged once, for its smallest document. Equal names are
    # compared byte by byte; contexts that only share a name are judged on their own.
    name = np.concatenate(names)
    order = np.lexsort((ids, name))
    new = np.r_[True, name[order][1:] != name[order][:-1]]
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    same = (rows[order] == rows[first]).all(axis=1) & (sides[:, order] == sides[:, first]).all(axis=0)
    judge = order[new | ~same]
    # Strings of different anchors never meet, so contexts are refined by groups of anchors, and an
    # anchor with one context has nothing to meet.
    gram = _fold_grams(rows[judge, LENGTH - Q : LENGTH])
    judge, gram = judge[np.argsort(gram, kind="stable")], np.sort(gram)
    edge = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    count = np.diff(np.r_[edge, len(gram)])
    judge, gram = judge[np.repeat(count > 1, count)], gram[np.repeat(count > 1, count)]
    edge = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.empty(0, np.int64)
    begin = 0
    while begin < len(judge):
        if begin + GROUP >= len(judge):
            stop = len(judge)
        else:
            k = int(np.searchsorted(edge, begin + GROUP, "right"))
            stop = int(edge[k - 1])
            if stop <= begin:  # one anchor alone has more contexts than a group
                stop = int(edge[k]) if k < len(edge) else len(judge)
        x = judge[begin:stop]
        flags[x] = _flags(rows[x], sides[0][x], sides[1][x], ids[x])
        begin = stop
    # The others of a context follow from its smallest document: all strings if that is smaller.
    every = np.uint32((1 << (LENGTH - Q + 1)) - 1)
    rest = ~new & same
    flags[order[rest]] = np.where(ids[order[rest]] > ids[first[rest]], every, flags[first[rest]])
    at, found = 0, []
    for n in names:
        found.append(pack_small(flags[at : at + len(n)]))
        at += len(n)
    return pa.table({"block": table.column("block"), "names": table.column("names"), "ids": table.column("ids"), "flags": pa.array(found, pa.binary())})


def _fold_grams(gram: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(gram).view("<u8")
    name = np.zeros(len(gram), np.uint64)
    for k in range(words.shape[1]):
        name = _mixed(name, words[:, k])
    return name


def _flags(rows, left, right, ids) -> np.ndarray:
    """Bit l of a context: its string that starts l bytes before the anchor has a smaller document."""
    before = np.arange(LENGTH - Q, -1, -1)
    inside = (before <= left[:, None]) & (LENGTH - before <= right[:, None])
    number = refined(rows)
    owner = np.where(inside, ids[:, None], NO_ID)
    least = np.full(int(number.max()) + 1, NO_ID)
    np.minimum.at(least, number.ravel(), owner.ravel())
    smaller = inside & (least[number] < ids[:, None])
    return (smaller.astype(np.uint32) << before.astype(np.uint32)).sum(axis=1, dtype=np.uint32)


def _cut(table: pa.Table, answers: pa.Table) -> pa.Table:
    ids = _ids(table)
    name, least, flags = _answers(answers)
    starts: dict[int, list[np.ndarray]] = {}
    if len(name):
        for piece in pieces(_texts(table)):
            at, part, key = piece.anchors()
            for lo in range(0, len(at), 1 << 17):
                a, p = at[lo : lo + (1 << 17)], part[lo : lo + (1 << 17)]
                rows, left, right = piece.contexts(a, p)
                own = _fold(rows, left, right)
                place = np.minimum(np.searchsorted(name, own), len(name) - 1)
                known = name[place] == own
                a, p, place, left, right = a[known], p[known], place[known], left[known].astype(int), right[known].astype(int)
                every = np.uint32((1 << (LENGTH - Q + 1)) - 1)
                bits = np.where(ids[piece.owner[p]] > least[place], every, flags[place])
                for before in range(LENGTH - Q + 1):
                    ok = ((bits >> np.uint32(before)) & 1).astype(bool) & (before <= left) & (LENGTH - before <= right)
                    if ok.any():
                        where = a[ok] - before
                        owner = p[ok]
                        for k in np.unique(owner).tolist():
                            mine = where[owner == k] - piece.begins[k] + piece.offset[k]
                            starts.setdefault(int(piece.owner[k]), []).append(mine)
    spans, kept, sizes = [], [], []
    for k, text in _texts(table):
        runs, rest = _remove(text, starts.get(k))
        spans.append(runs)
        kept.append(rest)
        sizes.append(len(text))
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    return pa.table({"id": table.column("id"), "n_bytes": pa.array(sizes, pa.int64()), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())})


def _answers(answers: pa.Table):
    if not answers.num_rows:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint32)
    name, least, flags = (
        np.concatenate([unpack_small(x, kind) for x in answers.column(c).to_pylist()])
        for c, kind in (("names", "<u8"), ("ids", "<i8"), ("flags", "<u4"))
    )
    order = np.argsort(name, kind="stable")
    return name[order], least[order], flags[order]


def _remove(text: bytes, starts: list[np.ndarray] | None):
    if not starts:
        return [], text
    begin = np.unique(np.concatenate(starts))
    new = np.r_[True, begin[1:] > begin[:-1] + LENGTH]
    first = begin[new]
    last = np.r_[begin[np.flatnonzero(new)[1:] - 1], begin[-1]] + LENGTH
    rest, at = [], 0
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        rest.append(text[at:a])
        at = b
    rest.append(text[at:])
    return [{"begin": int(a), "end": int(b)} for a, b in zip(first, last, strict=True)], b"".join(rest)


def remove_repeats(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, n_bytes, spans array<struct<begin, end>>, kept binary): a row a document."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(MAX_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BUCKET_BYTES)))
    n_blocks = max(2 * spark.sparkContext.defaultParallelism, math.ceil(size / BLOCK_BYTES))
    block = F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)).cast("int")
    blocked = rows.select(block.alias("block"), "id", "text").repartition(n_blocks, "block")
    asked = blocked.groupBy("block").applyInArrow(_asked_buckets(buckets), "bucket int, block int, keys binary, many binary")
    shared = asked.groupBy("bucket").applyInArrow(_shared_buckets, "block int, shared binary")
    contexts = blocked.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(
        _asked_contexts(buckets), "bucket int, block int, names binary, ids binary, sides binary, rows binary"
    )
    judged = contexts.groupBy("bucket").applyInArrow(_judged, "block int, names binary, ids binary, flags binary")
    return blocked.groupBy("block").cogroup(judged.groupBy("block")).applyInArrow(
        _cut, "id long, n_bytes long, spans array<struct<begin:bigint,end:bigint>>, kept binary"
    )
