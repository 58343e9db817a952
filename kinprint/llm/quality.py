"""Quality rules: a threshold table compiled into one projection.

Everything here is built-in expressions over one row, so there is no shuffle, no user
function and no state; a lost executor costs its own tasks only.

Defined results: null text counts as empty; an empty text has zeros everywhere, fails the
base rule and every rule that needs words; rows are judged one by one, so repeated rows and
repeated or null ids get a verdict each; other columns pass through untouched, whatever
their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinprint.session import fresh

# The white space that separates words.
BREAKS = "\\x20\\x09-\\x0D"

# Frequent function words of the languages that the rules know.
LOWER_STOP_WORDS = sorted(
    set(
        "the be to of and that have with in is it for on as by this from are was "
        "de la le et les des en un une du que est pour dans qui par sur au "
        "el los las y del se con para es una al lo por "
        "der die und das den von zu mit ist im ein eine sich nicht auf für".split()
    )
)

STOP_WORDS = LOWER_STOP_WORDS + [w.capitalize() for w in LOWER_STOP_WORDS]

# Rule table: (name, left factor, left metric, comparison, right factor, right metric).
# A row passes when  left factor * left metric  <comparison>  right factor * right metric.
# Ratios are kept as products of integers, so that no rounding decides.
RULES: list[tuple[str, int, str, str, int, str]] = [
    ("words_max", 1, "n_words", "<=", 100_000, "one"),
    ("word_length_min", 1, "word_chars", ">=", 2, "n_words"),
    ("word_length_max", 1, "word_chars", "<=", 14, "n_words"),
    ("symbols", 10, "n_symbols", "<=", 1, "n_words"),
    ("stop_words", 100, "n_stop_words", ">=", 4, "n_words"),
    ("duplicate_lines", 100, "n_dup_lines", "<=", 30, "n_lines"),
    ("bullet_lines", 100, "n_bullet_lines", "<=", 90, "n_lines"),
    ("ellipsis_lines", 100, "n_ellipsis_lines", "<=", 30, "n_lines"),
]
MIN_WORDS = 50
FEW = 32  # repeated windows that are looked up without sorting
MAX_REPEAT_PERCENT = 50


def _compare(left: Column, sign: str, right: Column) -> Column:
    return left <= right if sign == "<=" else left >= right


def compile_rules(metric, rules=None) -> list[tuple[str, Column]]:
    """The table as (name, boolean column); ``metric`` maps a metric's name to its column."""
    return [
        (name, _compare(F.lit(a) * metric(x), sign, F.lit(b) * metric(y)))
        for name, a, x, sign, b, y in (RULES if rules is None else rules)
    ]


def with_quality(docs: DataFrame, text_col: str = "text", rules=None) -> tuple[DataFrame, str]:
    """``docs`` with one struct column added; returns the frame and that column's name.

    The struct has the metrics, ``base_failed``, ``kept`` and ``failed`` (names of the rules
    that the row breaks, in table order, comma-separated).
    """
    original = [F.col(f"`{c}`") for c in docs.columns]
    q = fresh(docs, "q")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))

    def step(frame: DataFrame, fields: dict[str, Column]) -> DataFrame:
        keep = [F.col(c) for c in frame.columns if c.startswith(q + "_") and c not in fields]
        return frame.select(*original, *keep, *[v.alias(c) for c, v in fields.items()])

    def col(name: str) -> Column:
        return F.col(f"{q}_{name}")

    def called(**fields: Column) -> dict[str, Column]:
        return {f"{q}_{k}": v for k, v in fields.items()}

    # Each step's arrays are used more than once in the next, so the optimizer keeps the
    # projections apart and an array is made once a row.
    frame = step(docs, called(text=text))
    frame = step(
        frame,
        called(
            text=col("text"),
            words=F.array_remove(F.split(col("text"), f"[{BREAKS}]+"), ""),
            lines=F.filter(F.split(col("text"), "\n"), lambda x: x.rlike(f"[^{BREAKS}]")),
        ),
    )
    n = F.size(col("words"))
    word = lambda k: F.get(col("words"), k)
    # A window is its 64-bit hash. Most texts repeat few windows: those are looked up one by
    # one, and only a text with many of them sorts its positions by window.
    frame = step(
        frame,
        called(
            windows=F.transform(
                F.slice(col("words"), 1, F.greatest(n - 2, F.lit(0))),
                lambda w, i: F.xxhash64(w, word(i + 1), word(i + 2)),
            )
        ),
    )
    frame = step(frame, called(windows=col("windows"), sorted=F.sort_array(col("windows"))))
    frame = step(
        frame,
        called(
            windows=col("windows"),
            twice=F.array_distinct(
                F.filter(col("sorted"), lambda h, k: h == F.get(col("sorted"), k - 1))
            ),
        ),
    ).drop(f"{q}_sorted")
    placed = F.transform(col("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    frame = step(
        frame,
        called(
            windows=col("windows"),
            twice=col("twice"),
            places=F.when(F.size(col("twice")) > FEW, F.sort_array(placed)),
        ),
    )
    window = lambda k: F.get(col("places"), k)["h"]
    none = F.array().cast("array<int>")
    frame = step(
        frame,
        called(
            starts=F.when(F.size(col("twice")) == 0, none)
            .when(
                F.size(col("twice")) <= FEW,
                F.array_compact(
                    F.transform(
                        col("windows"),
                        lambda h, i: F.when(F.array_contains(col("twice"), h), i),
                    )
                ),
            )
            .otherwise(
                F.sort_array(
                    F.transform(
                        F.filter(
                            col("places"),
                            lambda x, k: F.coalesce(x["h"] == window(k - 1), F.lit(False))
                            | F.coalesce(x["h"] == window(k + 1), F.lit(False)),
                        ),
                        lambda x: x["i"],
                    )
                )
            )
        ),
    )
    stops = [F.lit(w) for w in STOP_WORDS]
    metrics = {
        "n_words": n,
        "word_chars": F.length(F.array_join(col("words"), "")),
        "n_symbols": F.size(F.split(col("text"), "[#*$%&|<>]")) - 1,
        "n_dup_lines": F.size(col("lines")) - F.size(F.array_distinct(col("lines"))),
        # A repeated window adds its three words, less those that the next one adds as well.
        "n_repeat_words": F.coalesce(
            F.aggregate(
                F.transform(
                    col("starts"),
                    lambda p, k: F.least(F.lit(3), F.get(col("starts"), k + 1) - p),
                ),
                F.lit(0),
                lambda a, x: a + x,
            ),
            F.lit(0),
        ),
        "n_lines": F.size(col("lines")),
        "n_bullet_lines": F.size(F.filter(col("lines"), lambda x: x.rlike(f"^[{BREAKS}]*[-*•]"))),
        "n_ellipsis_lines": F.size(
            F.filter(col("lines"), lambda x: x.rlike(f"(\\.\\.\\.|…)[{BREAKS}]*$"))
        ),
        "n_stop_words": F.size(F.filter(col("words"), lambda w: w.isin(stops))),
    }
    frame = step(frame, called(m=F.struct(*[v.cast("long").alias(k) for k, v in metrics.items()])))
    m = lambda k: F.lit(1) if k == "one" else col("m")[k]
    base_failed = (m("n_words") < MIN_WORDS) | (
        F.lit(100) * m("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * m("n_words")
    )
    failed = F.concat_ws(",", *[F.when(~ok, F.lit(name)) for name, ok in compile_rules(m, rules)])
    frame = step(frame, called(m=col("m"), base=base_failed, failed=failed))
    # Always true. A condition on the verdict must not be pushed below these projections: it would
    # put their expressions into each other, and arrays would be made anew for every element.
    barrier = F.monotonically_increasing_id() >= 0
    verdict = F.struct(
        *[m(k).alias(k) for k in metrics],
        col("base").alias("base_failed"),
        (~col("base") & (col("failed") == "") & barrier).alias("kept"),
        col("failed").alias("failed"),
    )
    return frame.select(*original, verdict.alias(q)), q


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that pass, with the columns that ``docs`` has."""
    frame, q = with_quality(docs, text_col)
    return frame.filter(F.col(q)["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def sql_verdict(prefix: str = "") -> tuple[str, str, str]:
    """The rule table as DuckDB expressions over metric columns: base_failed, failed, kept."""
    term = lambda f, x: f"{f}" if x == "one" else f"{f} * {prefix}{x}"
    base = f"({prefix}n_words < {MIN_WORDS} OR 100 * {prefix}n_repeat_words > {MAX_REPEAT_PERCENT} * {prefix}n_words)"
    failed = "concat_ws(',', " + ", ".join(
        f"CASE WHEN NOT ({term(a, x)} {sign} {term(b, y)}) THEN '{name}' END"
        for name, a, x, sign, b, y in RULES
    ) + ")"
    return base, failed, f"(NOT {base} AND {failed} = '')"


def oracle_sql(source: str = "documents") -> str:
    """DuckDB SQL for the query, with windows counted by a relation instead of arrays."""
    brk = "[\\x20\\x09-\\x0D]"
    base, failed, kept = sql_verdict()
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {source}),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
p AS (SELECT rid, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
g AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM p),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS k FROM g),
r AS (SELECT rid, count(DISTINCT pos) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS pos FROM c WHERE k >= 2) GROUP BY rid),
m AS (SELECT w.rid, doc_id, CAST(len(words) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '{brk}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
  len(lines) AS n_lines,
  len(list_filter(lines, lambda x: regexp_matches(x, '^{brk}*[-*•]'))) AS n_bullet_lines,
  len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…){brk}*$'))) AS n_ellipsis_lines,
  len(list_filter(words, lambda x: x IN ({stops}))) AS n_stop_words
  FROM w LEFT JOIN r USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {base} AS base_failed, {kept} AS kept, {failed} AS failed FROM m
"""
