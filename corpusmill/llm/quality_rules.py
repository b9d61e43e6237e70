"""Quality rules: a threshold table compiled into one Spark projection.

Every rule compares one named ratio of the text with a bound. `measure` adds the base counts,
`judge` compiles the rules into boolean expressions over them; both are
built-in expressions only, in one narrow projection without a shuffle.

A word is a run of characters other than space and \\t\\n\\v\\f\\r. Defined results: a null text is an
empty one; a text without words has zero counts, fails the base rules and is not
kept; repeated rows are judged each; an empty table gives an empty table.
Columns of the table that bear the name of an added one are replaced.

n_repeat_words compares 3-word windows by a 64-bit hash of the three words; a
false repeat needs a hash collision within one text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: The most frequent function words of the languages the default table serves.
STOP_WORDS = {
    "en": "the of and to in a is it that was for on are with as at be by this from or an",
    "de": "der die das und in zu den ist nicht von mit dem des ein eine auf für als auch es sich",
    "fr": "le la les de des du et un une est que qui en dans pour pas au par sur il elle",
    "es": "el la los las de del y un una es que en por con para no se lo su al como",
}


@dataclass(frozen=True)
class Rule:
    """Reject where `metric` is under `least` or over `most`. Ratios are per word, line ratios per line with a word."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None


#: Lengths, symbols, stop words, lines. Few clean texts of any of the languages come near a bound.
DEFAULT_RULES = (
    Rule("length", "n_words", least=50),
    Rule("word_length", "mean_word_chars", least=3.0, most=12.0),
    Rule("symbols", "symbol_ratio", most=0.1),
    Rule("exclamations", "bang_ratio", most=0.1),
    Rule("stop_words", "stop_ratio", least=0.02),
    Rule("duplicate_lines", "dup_line_ratio", most=0.5),
    Rule("repeated_windows", "repeat_ratio", most=0.5),
)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over `value`, which is evaluated once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _count(text: Column, chars: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more. Sorting, not comparing pairs: n log n in the words."""
    n = F.size(words)

    def covered(windows: Column) -> Column:
        by_hash = F.sort_array(windows)
        same = lambda a, b: a["h"] == F.coalesce(b["h"], a["h"] + 1)

        def starts(s: Column) -> Column:
            again = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        def total(at: Column) -> Column:
            return F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)

        return bind(bind(by_hash, starts), total)

    def of(hashes: Column) -> Column:
        repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
        windows = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(repeats, covered(windows)).otherwise(F.lit(0))

    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n >= 3, bind(hashes, of)).otherwise(F.lit(0))


def measure(df: DataFrame, text_col: str = "text", stop_words: dict[str, str] | None = None) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the counts the rules use, as long columns."""
    stops = sorted({w for x in (stop_words or STOP_WORDS).values() for w in x.split()})
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))

    def counts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(stops))).cast("long").alias("n_stop_words"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
        )

    def lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    with_word = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACE, "") != "")
    added = df.withColumns({
        "__w": bind(_words(text), counts),
        "__l": bind(with_word, lines),
        "word_chars": F.char_length(F.translate(text, SPACE, "")).cast("long"),
        "n_symbols": _count(text, SYMBOLS).cast("long"),
        "n_bangs": _count(text, "!").cast("long"),
    })
    return added.withColumns({**{c: F.col(f"__w.{c}") for c in ("n_words", "n_stop_words", "n_repeat_words")}, **{c: F.col(f"__l.{c}") for c in ("n_lines", "n_dup_lines")}}).drop("__w", "__l")


#: Metrics a rule can name, from the measured columns; null (so: no verdict by this rule) without words or lines.
METRICS: dict[str, Callable[[], Column]] = {
    "n_words": lambda: F.col("n_words").cast("double"),
    "mean_word_chars": lambda: F.try_divide(F.col("word_chars"), F.col("n_words")),
    "symbol_ratio": lambda: F.try_divide(F.col("n_symbols"), F.col("n_words")),
    "bang_ratio": lambda: F.try_divide(F.col("n_bangs"), F.col("n_words")),
    "stop_ratio": lambda: F.try_divide(F.col("n_stop_words"), F.col("n_words")),
    "dup_line_ratio": lambda: F.try_divide(F.col("n_dup_lines"), F.col("n_lines")),
    "repeat_ratio": lambda: F.try_divide(F.col("n_repeat_words"), F.col("n_words")),
}


def verdict(rules: tuple[Rule, ...] = DEFAULT_RULES) -> Column:
    """True where every rule of the table holds."""
    ok = F.lit(True)
    for r in rules:
        value = METRICS[r.metric]()
        if r.least is not None:
            ok = ok & F.coalesce(value >= F.lit(r.least), F.lit(True))
        if r.most is not None:
            ok = ok & F.coalesce(value <= F.lit(r.most), F.lit(True))
    return ok


def judge(df: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, text_col: str = "text") -> DataFrame:
    """`measure`, base_failed (n_words < 50, or over half the words in repeated windows) and kept."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measure(df, text_col).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


RESULT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle(table: str = "documents") -> str:
    """The same counts and the default verdict as DuckDB SQL."""
    stops = ", ".join(f"'{w}'" for w in sorted({w for x in STOP_WORDS.values() for w in x.split()}))
    bounds = []
    sql = {"n_words": "n_words", "mean_word_chars": "word_chars / n_words", "symbol_ratio": "n_symbols / n_words", "bang_ratio": "n_bangs / n_words", "stop_ratio": "n_stop / n_words", "dup_line_ratio": "n_dup_lines / n_lines", "repeat_ratio": "n_repeat_words / n_words"}
    for r in DEFAULT_RULES:
        bounds += [f"coalesce({sql[r.metric]} >= {r.least}, true)"] * (r.least is not None) + [f"coalesce({sql[r.metric]} <= {r.most}, true)"] * (r.most is not None)
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM {table}),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
tri AS (SELECT rid, i, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM p WINDOW o AS (PARTITION BY rid ORDER BY i)),
again AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, word, w2, w3) > 1 AS r FROM tri WHERE w3 IS NOT NULL),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS s(k) WHERE r GROUP BY rid),
stop AS (SELECT rid, count(*) AS n FROM p WHERE lower(word) IN ({stops}) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
ln AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT d.doc_id, len(w.ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^!]', '', 'g')) AS n_bangs,
  coalesce(ln.n_lines, 0) AS n_lines, coalesce(ln.n_dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(stop.n, 0) AS n_stop
  FROM d JOIN w USING (rid) LEFT JOIN ln USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN stop USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(bounds)} AS kept FROM b"""
