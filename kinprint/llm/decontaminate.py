"""Benchmark decontamination: word pairs as seeds, then Smith-Waterman alignment.

Benchmark items are taken in blocks of at most ``BLOCK_BYTES`` of text (a larger item is a
block of its own), so what is sent to the executors is bounded, and every document meets
every block. A seed is a pair of words that follow each other in an item; a text has it where
they follow each other or with one word between. A document is aligned with an item when a
window of twice the item's length has as many places of its seeds as every copy of
``MIN_SCORE`` must have (``least_places``), however often the item leaked: no copy that the
alignment would accept is lost. Matching and alignment happen where the document is read;
nothing is shuffled, and a passage in a third of all documents costs each its own alignment.

The alignment is over words, with ``MATCH`` for equal words and -1 for a changed, added or
missing one; its score is divided by the item's best possible one.

Defined results: null and empty texts on either side match nothing; case and punctuation do
not count; an item shorter than ``MIN_WORDS`` is matched only as a whole; repeated rows and ids on either side are
rows of their own; null ids are carried; empty tables give an empty table; other columns are not
read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCH = 2
MIN_SCORE = 0.5
MIN_WORDS = 8
BLOCK_BYTES = 4_000_000

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def least_places(n: int) -> int:
    """Places of seeds that a text has at least where it copies an item of ``n`` words by ``MIN_SCORE``.

    Of m matched words and e errors, 2m - e >= n. Between two matched words that follow each other in the
    item with at most one word put between lies a seed; the other m - 1 gaps hold an item's word (n - m at
    most, an error each) or two errors. That leaves n - m - 1 seeds if m <= 2n/3, and m/2 - 1 beyond.
    """
    if n < MIN_WORDS:
        return max(1, n - 1)
    return max(1, math.ceil(n / 3) - 1)


class Block:
    """Items as word numbers, and their seeds in a sorted array of codes."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        listed = [(i, w) for i, t in items if (w := words_of(t))]
        self.ids = [i for i, _ in listed]
        self.vocab: dict[str, int] = {}
        for _, w in listed:
            for x in w:
                self.vocab.setdefault(x, len(self.vocab) + 1)
        self.items = [np.array([self.vocab[x] for x in w], np.int64) for _, w in listed]
        self.size = np.array([len(x) for x in self.items], np.int64)
        self.least = np.array([least_places(len(x)) for x in self.items], np.int64)
        made = [self.codes(x[:-1], x[1:]) if len(x) > 1 else x for x in self.items]  # a lone word is its own seed
        self.seeds = np.unique(np.concatenate(made)) if made else np.empty(0, np.int64)
        item = np.repeat(np.arange(len(made)), [len(x) for x in made])
        seed = np.searchsorted(self.seeds, np.concatenate(made)) if made else np.empty(0, np.int64)
        pairs = np.unique(np.stack([seed, item], axis=1), axis=0) if made else np.empty((0, 2), np.int64)
        self.owner = pairs[:, 1]
        self.owner_at = np.searchsorted(pairs[:, 0], np.arange(len(self.seeds) + 1))
        self.lone = bool((self.size == 1).any())

    def codes(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """A code for each pair of words; none is a lone word's number."""
        return first * (len(self.vocab) + 1) + second

    def numbers(self, words: list[str]) -> np.ndarray:
        get = self.vocab.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))

    def found(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(seed, place) of every seed in a text, once for each place."""
        known = np.flatnonzero(numbers)
        codes, places = [], []
        for step in (1, 2):
            at = known[known + step < len(numbers)]
            at = at[numbers[at + step] > 0]
            codes.append(self.codes(numbers[at], numbers[at + step]))
            places.append(at)
        if self.lone:
            codes.append(numbers[known])
            places.append(known)
        code, place = np.concatenate(codes), np.concatenate(places)
        seed = np.searchsorted(self.seeds, code)
        seed[seed == len(self.seeds)] = 0
        ok = self.seeds[seed] == code
        return seed[ok], place[ok]


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int]:
    """Smith-Waterman score over its best possible value, and the place behind the last aligned word."""
    j = np.arange(len(text) + 1)
    above = np.zeros(len(text) + 1, np.int64)
    best, end = 0, 0
    for word in item.tolist():
        now = np.zeros(len(text) + 1, np.int64)
        now[1:] = np.maximum(above[:-1] + np.where(text == word, MATCH, -1), 0)
        np.maximum(now, above - 1, out=now)
        # A gap along the text costs one a word: a running maximum of score plus place.
        now = np.maximum.accumulate(now + j) - j
        top = int(now.argmax())
        if now[top] > best:
            best, end = int(now[top]), top
        above = now
    return best / (MATCH * len(item)), end


def hits(block: Block, text: str | None):
    """(item, score, end, shared seeds) of the items that a text has copied."""
    numbers = block.numbers(words_of(text))
    seed, place = block.found(numbers)
    if not len(seed):
        return
    count = block.owner_at[seed + 1] - block.owner_at[seed]
    at = np.repeat(block.owner_at[seed], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    owner = block.owner[at]
    of_seed, place = np.repeat(seed, count), np.repeat(place, count)
    enough = np.bincount(owner, minlength=len(block.items)) >= block.least
    mine = enough[owner]
    owner, of_seed, place = owner[mine], of_seed[mine], place[mine]
    order = np.lexsort((place, owner))
    owner, of_seed, place = owner[order], of_seed[order], place[order]
    # A place that has two of an item's seeds counts once.
    once = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])][: len(owner)])
    who, where = owner[once], place[once]
    last = np.arange(len(who)) + block.least[who] - 1
    full = last < len(who)
    begins, last = np.flatnonzero(full), last[full]
    full = (who[last] == who[begins]) & (where[last] - where[begins] <= 2 * block.size[who[begins]])
    begins, last = begins[full], last[full]
    for k in np.unique(who[begins]).tolist():
        some = who[begins] == k
        item = block.items[k]
        # An alignment of positive score reaches no further from a seed than this.
        reach = (MATCH + 1) * len(item)
        begin = max(0, int(where[begins[some]].min()) - reach)
        score, end = align(item, numbers[begin : int(where[last[some]].max()) + 3 + reach])
        least = 1.0 if len(item) < MIN_WORDS else MIN_SCORE
        if score >= least:
            yield k, score, begin + end, len(np.unique(of_seed[owner == k]))


def blocks_of(benchmark: DataFrame, id_col="item_id", text_col="text"):
    """The items in bounded blocks, one at a time."""
    rows = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.filter("text is not null")
    held, size = [], 0
    for r in rows.toLocalIterator():
        n = len(r["text"].encode("utf-8", "surrogatepass"))
        if held and size + n > BLOCK_BYTES:
            yield Block(held)
            held, size = [], 0
        held.append((r["item"], r["text"]))
        size += n
    if held:
        yield Block(held)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text"
) -> DataFrame:
    """(id, item_id, score, end_word, n_seeds): a row for each document and item that it copies."""
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = "id long, item_id long, score double, end_word long, n_seeds long"
    found = None
    for block in blocks_of(benchmark, item_col, item_text_col):
        if not block.items:
            continue
        found_here = texts.mapInArrow(_matcher(spark.sparkContext.broadcast(block)), schema)
        found = found_here if found is None else found.unionByName(found_here)
    return spark.createDataFrame([], schema) if found is None else found


def _matcher(shipped):
    def run(batches):
        block = shipped.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(doc, block.ids[k], score, end, n) for k, score, end, n in hits(block, text)]
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                    names=["id", "item_id", "score", "end_word", "n_seeds"],
                )

    return run


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text"
) -> DataFrame:
    """The rows of ``docs`` whose own text copies no item, with the same columns.

    Rows are judged where they are read, one by one: null and repeated ids don't matter, rows with null or empty
    texts stay, an empty table on either side changes nothing, and other columns may have any name and type.
    """
    context = docs.sparkSession.sparkContext
    place = [c.lower() for c in docs.columns].index(text_col.lower())
    for block in blocks_of(benchmark, item_col, item_text_col):
        if block.items:
            docs = docs.mapInArrow(_filter(context.broadcast(block), place), docs.schema)
    return docs


def _filter(shipped, place: int):
    def run(batches):
        block = shipped.value
        for batch in batches:
            clean = [next(hits(block, text), None) is None for text in batch.column(place).cast(pa.string()).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run
