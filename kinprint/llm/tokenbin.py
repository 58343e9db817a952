"""Token ids as grammar-compressed binary shards (Re-Pair), with random access.

Documents are dealt by ranges of id and sorted. A task turns its texts into ids and closes a
shard whenever ``SHARD_IDS`` ids are full, so memory does not depend on a partition's size. In a shard, frequent
pairs of symbols are replaced by nonterminals, round after round, until no pair is frequent
or the symbols run out. Nothing is joined to the right of a symbol that ends with the end id,
so none reaches over the end of a document; this is checked for every shard that is written. Pairs are counted once a round and up to ``PAIRS_A_ROUND`` of
the most frequent are replaced together. A shard stores

* ``rules``: two little-endian unsigned 16-bit symbols a nonterminal, in order of creation,
* ``lengths``: the number of ids that each nonterminal expands to (unsigned 32-bit),
* ``sequence``: the remaining symbols (unsigned 16-bit); symbol ``base + k`` is nonterminal k,
* ``doc_ids``, ``doc_at`` (first symbol of each document) and ``doc_tokens`` (its ids),

so any document is decoded from its own symbols and the rules. Shards are rows of a Parquet
dataset in ascending order of (part, seq), written by Spark, as executors share no folder.

Words are encoded once for a worker's lifetime and kept in a cache of bounded size: the
encoder drops white space and works on pieces that never span it, so a text's ids are its
words' ids. Texts are lower-cased (A-Z) before, as the encoder does the same, except those
with the beginning of a special token.

Defined results: null text counts as empty and has the end id only; rows are ordered by id
(nulls first), then by a hash of the text, so repeated rows and ids are documents of their own
with one result each; very long texts are one document, split nowhere; an empty table gives
an empty dataset; other columns are not read.
"""

from __future__ import annotations

import re
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinprint.session import written

END_ID = 2
SHARD_IDS = 1 << 20
DOCS_A_PART = 2_000
MAX_PARTS = 100_000  # beyond it partitions grow; a task's memory does not depend on their size
MIN_PAIRS = 8  # a pair that occurs less often is not replaced
PAIRS_A_ROUND = 4_096
HASH_BITS = 18
SYMBOLS = 1 << 16
PIECE_BYTES = 4_000_000  # text that is encoded at once
CACHE_WORDS = 400_000  # words of one generation; two generations are kept


SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class _Words(dict):
    """Ids of words as little-endian unsigned 16-bit bytes; a word that is missing is encoded once."""

    def __init__(self, encode, older: dict[bytes, bytes]):
        super().__init__({b"": b""})
        self.encode, self.older = encode, older

    def __missing__(self, word: bytes) -> bytes:
        found = self.older.get(word)
        if found is None:
            # Letters and the signs behind them are two pieces.
            stem = word if word.isalpha() else word.rstrip(SIGNS)
            if len(stem) < len(word) and stem.decode().isalpha():
                found = self[stem] + self[word[len(stem) :]]
            else:
                found = self.encode(word)
        self[word] = found
        return found

    def all(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word; those of the older generation are taken over together."""
        found = list(map(self.get, words))
        gaps = [k for k, ids in enumerate(found) if ids is None]
        asked = [words[k] for k in gaps]
        for k, word, ids in zip(gaps, asked, map(self.older.get, asked), strict=True):
            if ids is None:
                ids = self[word]
            else:
                self[word] = ids
            found[k] = ids
        return found


class WordEncoder:
    """Ids of texts as little-endian unsigned 16-bit bytes, by way of a cache of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.vocab = self.tok.get_vocab_size(with_added_tokens=True)
        if self.vocab > SYMBOLS - 256:
            raise ValueError("ids must leave room for nonterminals in 16 bits")
        self.raw = [i.to_bytes(2, "little") for i in range(self.vocab)]
        # Latin letters with accents have no other normal form; what the model reads in their place.
        letters = [chr(c) for c in range(0xC0, 0x100) if chr(c).isalpha()]
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytewise = {ord(x): level.pre_tokenize_str(x.lower())[0][0] for x in letters}
        self.accented = re.compile(f"[a-zA-Z{''.join(letters)}]+")
        self.words = _Words(self.encode, {})

    def encode(self, word: bytes) -> bytes:
        """The ids of one word. A word of Latin letters is one piece and goes to the model at once."""
        if word.isalpha():  # of bytes: A-Z and a-z only
            return self._piece(word.lower().decode())
        text = word.decode()
        if self.accented.fullmatch(text):
            return self._piece(text.lower().translate(self.bytewise))
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _piece(self, text: str) -> bytes:
        return b"".join([self.raw[x.id] for x in self.model.tokenize(text)])

    def batch(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text. Words that a batch repeats are looked up once."""
        if len(self.words) > CACHE_WORDS:
            self.words = _Words(self.encode, dict(self.words))
        texts = pc.fill_null(texts.cast(pa.string()), "")
        split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        known = self.words.all(distinct)
        size = np.fromiter(map(len, known), np.int64, len(known)) // 2
        place = words.indices.to_numpy().astype(np.intp)
        n = size.take(place, mode="clip")
        ends = np.cumsum(n)
        first = (np.cumsum(size) - size).take(place, mode="clip")
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - n), n)
        flat = np.frombuffer(b"".join(known), "<u2").take(at, mode="clip").tobytes() if len(at) else b""
        edges = np.r_[0, ends][np.r_[0, np.cumsum(pc.list_value_length(split).to_numpy())]] * 2
        return [flat[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def worker_encoder(path: str) -> WordEncoder:
    """The encoder of this worker process; workers are reused, and so is its cache."""
    kept = sys.modules.setdefault("_kinprint_kept", types.ModuleType("_kinprint_kept"))
    found = getattr(kept, "encoder", None)
    if found is None or found[0] != path:
        kept.encoder = found = (path, WordEncoder(path))
    return found[1]


def compress(ids: np.ndarray, base: int, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, lengths, sequence) of a shard's ids."""
    seq = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    size = np.ones(SYMBOLS, np.uint32)
    ends = np.zeros(SYMBOLS, bool)  # symbols whose last id is the end id; nothing is joined to their right
    ends[end_id] = True
    free = base
    while free < SYMBOLS and len(seq) > 1:
        key = (seq[:-1] << np.uint32(16)) | seq[1:]
        order = np.sort(key)
        edge = np.r_[0, np.flatnonzero(order[1:] != order[:-1]) + 1]
        count = np.diff(np.r_[edge, len(order)])
        pair = order[edge]
        frequent = (count >= MIN_PAIRS) & ~ends[pair >> np.uint32(16)]
        pair, count = pair[frequent], count[frequent]
        if not len(pair):
            break
        n = min(PAIRS_A_ROUND, SYMBOLS - free)
        if len(pair) > n:
            best = np.argsort(-count, kind="stable")[:n]
            pair, count = pair[best], count[best]
        sort = np.argsort(pair)
        pair, count = pair[sort], count[sort]
        rank = np.empty(len(pair), np.int32)
        rank[np.argsort(count, kind="stable")] = np.arange(1, len(pair) + 1)
        # Pairs are found by a hash; of pairs that meet in it one waits for a later round.
        hashed = ((key * np.uint32(0x9E3779B1)) >> np.uint32(32 - HASH_BITS)).astype(np.intp)
        slot, slot_pair, slot_rank = (np.zeros(1 << HASH_BITS, kind) for kind in (np.uint16, np.uint32, np.uint16))
        by_rank = np.argsort(rank)
        home = (pair[by_rank] * np.uint32(0x9E3779B1)) >> np.uint32(32 - HASH_BITS)
        slot[home] = by_rank
        slot_pair[home], slot_rank[home] = pair[slot[home]], rank[slot[home]]
        # Every place is in range; "clip" leaves out the check, which costs more than the reading.
        weight = slot_rank.take(hashed, mode="clip") * (slot_pair.take(hashed, mode="clip") == key)
        # Of overlapping occurrences the more frequent pair wins, and the first of equals.
        take = weight > 0
        take[1:] &= weight[1:] > weight[:-1]
        take[:-1] &= weight[:-1] >= weight[1:]
        # In a run of one symbol that is every second one, else a run would lose one symbol a round.
        again = np.flatnonzero((weight[1:] == weight[:-1]) & (weight[1:] > 0)) + 1
        if len(again):
            opens = np.flatnonzero(np.r_[True, again[1:] != again[:-1] + 1])
            many = np.diff(np.r_[opens, len(again)])
            odd = (np.arange(len(again)) - np.repeat(opens, many)) % 2 == 1
            more = again[odd & np.repeat(take[again[opens] - 1], many)]
            take[more] = weight[more] >= np.r_[weight, 0][more + 1]
        at = np.flatnonzero(take)
        seq[at] = free + slot[hashed[at]].astype(np.uint32)
        stays = np.ones(len(seq), bool)
        stays[at + 1] = False
        seq = seq[stays]
        left, right = pair >> np.uint32(16), pair & np.uint32(0xFFFF)
        size[free : free + len(pair)] = size[left] + size[right]
        ends[free : free + len(pair)] = ends[right]
        rules.append(np.stack([left, right], axis=1))
        lengths.append(size[free : free + len(pair)].copy())
        free += len(pair)
    return (
        np.concatenate(rules).astype("<u2") if rules else np.empty((0, 2), "<u2"),
        np.concatenate(lengths).astype("<u4") if lengths else np.empty(0, "<u4"),
        seq.astype("<u2"),
    )


def expansions(rules: np.ndarray, lengths: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every symbol's ids in one array, with first places and lengths by symbol."""
    n = base + len(rules)
    size = np.ones(n, np.int64)
    size[base:] = lengths
    first = np.cumsum(size) - size
    flat = np.empty(int(size.sum()), "<u4")
    flat[:base] = np.arange(base)
    # Rules that only need symbols from before them are written together; a round's rules are such a run.
    pairs, latest, k = rules.astype(np.int64), rules.max(axis=1).astype(np.int64) - base if len(rules) else np.empty(0, np.int64), 0
    while k < len(rules):
        later, to, step = latest[k:], k, 256
        while to < len(rules):  # most runs are short or end with the rules
            found = np.flatnonzero(later[to - k : to - k + step] >= k)
            if len(found):
                to += int(found[0])
                break
            to, step = min(len(rules), to + step), step * 4
        if to == k:
            raise ValueError("a rule must need symbols from before it only")
        made = expand(pairs[k:to].ravel(), (flat, first, size))
        flat[first[base + k] : first[base + k] + len(made)] = made
        k = to
    return flat, first, size


def expand(symbols: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    flat, first, size = table
    n = size[symbols]
    ends = np.cumsum(n)
    out = np.arange(int(ends[-1]) if len(ends) else 0)
    return flat[out + np.repeat(first[symbols] - (ends - n), n)]


def _pieces(batch: pa.RecordBatch):
    """Runs of rows (id, text) of ``PIECE_BYTES`` at most; a longer text is a run of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, before + PIECE_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


SHARD = (
    "part int, seq int, base int, n_ids long, rules binary, lengths binary, sequence binary, "
    "doc_ids array<long>, doc_at array<int>, doc_tokens array<int>"
)


def _shard(part: int, seq: int, base: int, ids: list, raw: list[bytes]) -> dict:
    sizes = np.array([len(x) // 2 for x in raw], np.int64)
    rules, lengths, sequence = compress(np.frombuffer(b"".join(raw), "<u2"), base)
    size = np.ones(base + len(rules), np.int64)
    size[base:] = lengths
    starts = np.cumsum(size[sequence]) - size[sequence]
    begins = np.cumsum(sizes) - sizes
    at = np.searchsorted(starts, begins)
    if not np.array_equal(starts[at], begins):
        raise AssertionError("a symbol of the shard reaches over the end of a document")
    return {
        "part": part, "seq": seq, "base": base, "n_ids": int(sizes.sum()), "rules": rules.tobytes(),
        "lengths": lengths.tobytes(), "sequence": sequence.tobytes(), "doc_ids": ids,
        "doc_at": at.astype(np.int32), "doc_tokens": sizes.astype(np.int32),
    }


_ARROW = pa.schema(
    [
        ("part", pa.int32()), ("seq", pa.int32()), ("base", pa.int32()), ("n_ids", pa.int64()),
        ("rules", pa.binary()), ("lengths", pa.binary()), ("sequence", pa.binary()),
        ("doc_ids", pa.list_(pa.int64())), ("doc_at", pa.list_(pa.int32())), ("doc_tokens", pa.list_(pa.int32())),
    ]
)


def shards(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, id_col="doc_id", text_col="text") -> DataFrame:
    """The shard rows of ``docs``; write them to keep them."""

    def run(batches):
        from pyspark import TaskContext

        encoder = worker_encoder(tokenizer_path)
        part, seq, ids, raw, held = TaskContext.get().partitionId(), 0, [], [], 0
        tail = int(end_id).to_bytes(2, "little")

        def close():
            row = _shard(part, seq, encoder.vocab, ids, raw)
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in batches:
            for piece in _pieces(batch):
                made = encoder.batch(piece.column(1))
                for doc, x in zip(piece.column(0).to_pylist(), made, strict=True):
                    ids.append(doc)
                    raw.append(x + tail)
                    held += len(x) // 2 + 1
                    if held >= SHARD_IDS:
                        yield close()
                        seq, ids, raw, held = seq + 1, [], [], 0
        if ids:
            yield close()

    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"))
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MAX_PARTS, docs.count() // DOCS_A_PART))
    keyed = rows.withColumn("tie", F.xxhash64("text"))
    dealt = keyed.repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    return dealt.mapInArrow(run, SHARD)


def read_documents(stored: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, decoded from the shards.

    ``start`` counts the ids of all documents before. Sums run over shards: first over the
    parts, ``MAX_PARTS`` at most, then within each part.
    """
    parts = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("part_start"))
    inside = F.sum("n_ids").over(
        Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    )
    places = stored.select("part", "seq", F.coalesce(inside, F.lit(0)).alias("inside")).join(parts, "part")
    places = places.select("part", "seq", (F.col("inside") + F.col("part_start")).alias("shard_start"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield _decoded(row)

    decoded = stored.mapInArrow(run, "part int, seq int, id long, inner_start long, n_tokens long, ids_crc32 long")
    return decoded.join(places, ["part", "seq"]).select(
        "id", (F.col("inner_start") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def decode(row: dict, k: int, table=None) -> np.ndarray:
    """The ids of the k-th document of a shard, from its own symbols."""
    if table is None:
        table = shard_table(row)
    sequence = np.frombuffer(row["sequence"], "<u2")
    at = [*row["doc_at"], len(sequence)]
    return expand(sequence[at[k] : at[k + 1]], table)


def shard_table(row: dict):
    return expansions(
        np.frombuffer(row["rules"], "<u2").reshape(-1, 2), np.frombuffer(row["lengths"], "<u4"), row["base"]
    )


def _decoded(row: dict) -> pa.RecordBatch:
    flat, first, size = shard_table(row)
    sequence, at = np.frombuffer(row["sequence"], "<u2"), np.array(row["doc_at"], np.int64)
    # Documents begin with symbols of their own, so all symbols are expanded at once and cut where documents begin.
    ids = expand(sequence, (flat, first, size))
    ends = np.r_[np.cumsum(size[sequence]), 0]
    edges = np.r_[ends[at - 1], len(ids)]
    view = memoryview(ids.astype("<u4", copy=False)).cast("B")
    sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    n, n_tokens = len(sums), np.diff(edges)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["seq"], np.int32)),
            pa.array(row["doc_ids"], pa.int64()), pa.array(np.cumsum(n_tokens) - n_tokens),
            pa.array(n_tokens), pa.array(sums, pa.int64()),
        ],
        names=["part", "seq", "id", "inner_start", "n_tokens", "ids_crc32"],
    )


def store(docs: DataFrame, tokenizer_path: str, id_col="doc_id", text_col="text") -> DataFrame:
    """Write the shards to the shared folder and give them as read back."""
    return written(shards(docs, tokenizer_path, END_ID, id_col, text_col), "token-shards")
