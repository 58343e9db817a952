"""Language identification of mixed texts.

Learning counts hashed letter trigrams and scripts by language over all training texts; the
model is a table of languages x ``BUCKETS`` log probabilities, so its size is bounded by the
number of languages (``MAX_LANGUAGES``) whatever the corpus. A word's script narrows the
candidates to the languages that are written in it, its score in a language is the sum of
its trigrams' log probabilities, and Viterbi over the words with a penalty for switching
labels the text's spans. The prediction is the language of most letters, the score its share.

Viterbi is exact. It is skipped where it cannot differ from one label: leaving the best single
label over m spans costs more than m penalties, so if no span of any other label gains more
than one penalty, no switching path is better.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is every
text where nothing was learned; ties go to the first language by name; repeated rows and ids
and null ids are judged row by row; very long texts are judged whole; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
MAX_LANGUAGES = 256  # a language takes 256 KiB of the model
SMOOTHING = 0.5
PENALTY = 12.0  # of a switch, in natural logarithms
SCRIPT_SHARE = 0.01  # of a language's letters, from which it is written in a script
CHARS = 1 << 20  # of texts that are scored at once; a longer text is alone
UNKNOWN = "und"

# First code points of script ranges, in ascending order, with the script's name.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"),
    (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB50, "Arabic"),
    (0xFE00, "Other"), (0xFF66, "Kana"), (0xFFA0, "Other"), (0x20000, "Han"), (0x30000, "Other"),
]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: is it a letter; which script. Made once in a worker's lifetime."""
    kept = sys.modules.setdefault("_kinprint_kept", types.ModuleType("_kinprint_kept"))
    if not hasattr(kept, "letters"):
        letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        firsts = np.array([c for c, _ in SCRIPTS])
        numbers = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS], np.uint8)
        kept.scripts = numbers[np.searchsorted(firsts, np.arange(0x110000), "right") - 1]
        kept.letters = letters
    return kept.letters, kept.scripts


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


def _grams(points: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """The bucket of the trigram around each letter; what is no letter counts as one edge sign."""
    c = np.where(letter, points, 0).astype(np.uint32)
    padded = np.r_[np.uint32(0), c, np.uint32(0)]
    with np.errstate(over="ignore"):
        h = padded[:-2] * np.uint32(0x9E3779B1) ^ padded[1:-1] * np.uint32(0x85EBCA77) ^ padded[2:] * np.uint32(0xC2B2AE3D)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F)
    return (h >> np.uint32(16))[letter]


class Model:
    """``logs``: log probabilities (languages x buckets); ``candidates``: scripts x languages."""

    def __init__(self, languages: list[str], logs: np.ndarray, candidates: np.ndarray):
        self.languages, self.logs, self.candidates = languages, logs, candidates


def training_counts(docs: DataFrame, lang_col="lang", text_col="text") -> DataFrame:
    """(lang, feature, n) over all texts; features beyond the buckets are scripts."""

    def run(batches):
        letters, scripts = _tables()
        held: dict[str, np.ndarray] = {}

        def flush():
            for lang, counts in held.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[at])],
                    names=["lang", "feature", "n"],
                )
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(held) >= 64 and lang not in held:
                    yield from flush()
                counts = held.setdefault(lang, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
                points = _points(text)
                letter = letters[points]
                grams = _grams(points, letter)
                if len(grams) > BUCKETS // 8:
                    counts[:BUCKETS] += np.bincount(grams, minlength=BUCKETS)
                else:
                    np.add.at(counts, grams, 1)
                counts[BUCKETS:] += np.bincount(scripts[points[letter]], minlength=len(SCRIPT_NAMES))
        yield from flush()

    rows = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counted = rows.filter("lang is not null and text is not null").mapInArrow(run, "lang string, feature int, n long")
    return counted.groupBy("lang", "feature").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, lang_col="lang", text_col="text") -> Model:
    counts = training_counts(docs, lang_col, text_col)
    # At most (MAX_LANGUAGES + 1) x (BUCKETS + scripts) rows reach the driver.
    languages = sorted(r[0] for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = np.zeros((len(languages), BUCKETS + len(SCRIPT_NAMES)))
    got = counts.toArrow()
    row = {x: k for k, x in enumerate(languages)}
    where = np.array([row[x] for x in got.column("lang").to_pylist()], np.int64)
    table[where, got.column("feature").to_numpy()] = got.column("n").to_numpy()
    seen, scripts = table[:, :BUCKETS], table[:, BUCKETS:]
    logs = np.log((seen + SMOOTHING) / (seen.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS))
    share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return Model(languages, logs.astype(np.float32), (share >= SCRIPT_SHARE).T)


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word; among equals the first label, and staying before switching."""
    best = int(np.argmax(scores.sum(axis=0)))
    gain = np.cumsum(scores - scores[:, best : best + 1], axis=0)
    low = np.minimum.accumulate(np.vstack([np.zeros((1, scores.shape[1])), gain[:-1]]), axis=0)
    if (gain - low).max() <= penalty:
        return np.full(len(scores), best)
    back = np.empty(scores.shape, np.int16)
    stay = np.arange(scores.shape[1])
    now = scores[0].copy()
    for t in range(1, len(scores)):
        top = int(now.argmax())
        move = now[top] - penalty > now
        back[t] = np.where(move, top, stay)
        now = np.where(move, now[top] - penalty, now) + scores[t]
    labels = np.empty(len(scores), np.int64)
    labels[-1] = now.argmax()
    for t in range(len(scores) - 1, 0, -1):
        labels[t - 1] = back[t, labels[t]]
    return labels


def score_words(texts: list[str], model: Model):
    """For each text: first letters and lengths of its words, and scores (words x languages)."""
    letters, scripts = _tables()
    parts, ends, at = [], [], 0
    for text in texts:
        p = _points(text)
        parts += [p, np.zeros(1, "<u4")]
        at += len(p) + 1
        ends.append(at)
    points = np.concatenate(parts) if parts else np.empty(0, "<u4")
    letter = letters[points]
    begins = np.flatnonzero(letter & ~np.r_[False, letter[:-1]])
    stops = np.flatnonzero(letter & ~np.r_[letter[1:], False]) + 1
    length = stops - begins
    scores = np.zeros((len(begins), len(model.languages)), np.float64)
    if len(begins) and model.languages:
        grams = _grams(points, letter)
        first = np.cumsum(length) - length
        for k in range(len(model.languages)):
            scores[:, k] = np.add.reduceat(model.logs[k][grams], first, dtype=np.float64)
        allowed = model.candidates[scripts[points[begins]]]
        known = allowed.any(axis=1)
        scores[known[:, None] & ~allowed] -= 1e4
        scores[~known] = 0.0
    bounds = np.searchsorted(begins, ends)
    start = 0
    for k, stop in enumerate(bounds.tolist()):
        base = ends[k - 1] if k else 0
        yield begins[start:stop] - base, length[start:stop], scores[start:stop]
        start = stop


def label(texts: list[str | None], model: Model):
    """For each text: language, score, and spans (begin, end, language) over the lower-cased text."""
    for begins, length, scores in score_words([t or "" for t in texts], model):
        if not len(begins) or not model.languages:
            yield UNKNOWN, 0.0, []
            continue
        labels = viterbi(scores, PENALTY)
        share = np.bincount(labels, weights=length, minlength=len(model.languages))
        best = int(share.argmax())
        edge = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]])
        last = np.r_[edge[1:], len(labels)] - 1
        spans = [
            (int(begins[a]), int(begins[b] + length[b]), model.languages[int(labels[a])])
            for a, b in zip(edge, last, strict=True)
        ]
        yield model.languages[best], float(share[best] / share.sum()), spans


def identify(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",), text_col="text") -> DataFrame:
    """``carry`` columns, then lang, score and spans array<struct<begin, end, lang>>, a row a text."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.languages, model.logs, model.candidates))

    def run(batches):
        known = Model(*shipped.value)
        for batch in batches:
            n = batch.num_columns - 1
            texts = batch.column(n).to_pylist()
            found, at = [], 0
            while at < len(texts):
                size, to = len(texts[at] or ""), at + 1
                while to < len(texts) and size + len(texts[to] or "") <= CHARS:
                    size += len(texts[to] or "")
                    to += 1
                found += label(texts[at:to], known)
                at = to
            spans = [[{"begin": a, "end": b, "lang": x} for a, b, x in s] for _, _, s in found]
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(k) for k in range(n)], pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()), pa.array(spans, kind),
                ],
                names=[*batch.schema.names[:n], "lang", "score", "spans"],
            )

    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)], F.col(f"`{text_col}`").cast("string").alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    out = rows.mapInArrow(run, f"{kinds}, lang string, score double, spans array<struct<begin:int,end:int,lang:string>>")
    return out.toDF(*carry, "lang", "score", "spans")


def held_out(id_column: Column) -> Column:
    """True where crc32 of the id as text leaves 2 on division by 4; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string")), F.lit(4)) == 2, F.lit(False))
