"""Operator 4: quality rules as one projection of built-in functions.

A table of thresholds over ratios of length, symbols, stop words and lines is compiled into boolean expressions; counts
and verdict come from one `select` without user functions, shuffles or joins.

Words in repeated 3-word windows are found within the row: windows are hashed to 64 bits; only where some hash occurs
twice are they sorted with their places, and the union of the repeated windows is measured from the sorted places.

Null and empty texts have no words: all counts are 0, they fail the base rule and are not kept. Ratios with a zero
denominator are 0. Texts of any length are counted whole. Repeated rows are judged each. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not he this are or from at but have an they you which".split()
    + "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass".split()
    + "le la de et les des en un une du est pour que dans qui au sur pas par plus avec il ne se ce sont".split()
    + "el los las del y a con no lo se por su para como más o pero sus al una ha este sí porque esta".split()
)


@dataclass(frozen=True)
class Rule:
    """A text passes if low <= value <= high; the value is one count of `counted` over another, written `a / b`."""

    name: str
    value: str
    low: float | None = None
    high: float | None = None


#: Thresholds. Ratios are to words or to lines that have a word.
RULES = (
    Rule("mean_word_length", "word_chars / n_words", 2, 25),
    Rule("symbols_to_words", "n_symbols / n_words", None, 0.1),
    Rule("stop_words_to_words", "n_stop_words / n_words", 0.02, None),
    Rule("repeated_lines", "n_dup_lines / n_lines", None, 0.5),
    Rule("cut_off_lines", "n_cut_lines / n_lines", None, 0.3),
    Rule("bullet_lines", "n_bullet_lines / n_lines", None, 0.9),
)
#: The base rule: at least so many words, and at most this share of them in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 0.5


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_window_words(words: Column) -> Column:
    """Number of words in 3-word windows that are found twice or more in an array of words."""

    def covered(places):
        step = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
        return F.aggregate(step, F.lit(0), lambda a, b: a + b)

    def repeated(windows):
        def of(rows):
            same = lambda row, i: F.coalesce(F.get(rows, i - 1)["h"] == row["h"], F.lit(False)) | F.coalesce(F.get(rows, i + 1)["h"] == row["h"], F.lit(False))
            return let(F.array_sort(F.transform(F.filter(rows, same), lambda row: row["i"])), covered)

        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(ordered, of)).otherwise(0)

    hashed = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, 0).otherwise(let(hashed, repeated))


def counted(docs: DataFrame) -> DataFrame:
    """All rows with their counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and those of the rules."""
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = F.length(text)
    solid = F.btrim(text, F.lit(WHITE))
    words = F.when(solid == "", F.array().cast("array<string>")).otherwise(F.split(solid, common.SPACE))
    count = lambda array: F.coalesce(F.size(array), F.lit(0)).cast("long")

    def of_words(w):
        return F.struct(count(w).alias("n_words"), count(F.filter(w, lambda x: x.isin(*STOP_WORDS))).alias("n_stop_words"), repeated_window_words(w).cast("long").alias("n_repeat_words"))

    def of_lines(x):
        ending = F.filter(x, lambda line: F.rtrim(line).endswith("...") | F.rtrim(line).endswith("…"))
        bullet = F.filter(x, lambda line: F.ltrim(line).substr(1, 1).isin("•", "-", "*", "·"))
        return F.struct(count(x).alias("n_lines"), (count(x) - count(F.array_distinct(x))).alias("n_dup_lines"), count(ending).alias("n_cut_lines"), count(bullet).alias("n_bullet_lines"))

    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(WHITE)) != "")
    return docs.select(
        "doc_id",
        F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (whole - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(words, of_words).alias("w"),
        let(lines, of_lines).alias("l"),
    ).select("doc_id", "w.*", "l.*", "word_chars", "n_symbols")


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether every rule passes, from the counts."""
    found = F.lit(True)
    for rule in rules:
        top, below = rule.value.split(" / ")
        value = F.coalesce(F.try_divide(F.col(top), F.col(below)), F.lit(0.0))
        if rule.low is not None:
            found &= value >= rule.low
        if rule.high is not None:
            found &= value <= rule.high
    return found


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of every row, whether the base rule fails, and whether the text is kept."""
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MOST_REPEATED) * F.col("n_words"))
    rows = counted(docs).withColumn("base_failed", base)
    return rows.withColumn("kept", ~F.col("base_failed") & verdict(rules))


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_rules(spark, sf_dir: str) -> DataFrame:
    return judged(common.table(spark, sf_dir, "documents")).select(*COLUMNS)


def oracle() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    tests = []
    for rule in RULES:
        top, below = rule.value.split(" / ")
        value = f"coalesce({top}::double / nullif({below}, 0), 0)"
        tests += [f"{value} >= {rule.low}"] * (rule.low is not None) + [f"{value} <= {rule.high}"] * (rule.high is not None)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS t
        FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
c AS (SELECT doc_id, len(words)::bigint AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines,
        coalesce(cov.n, 0)::bigint AS n_repeat_words,
        len(list_filter(words, lambda x: x IN ({stop})))::bigint AS n_stop_words,
        len(lines)::bigint AS n_lines,
        len(list_filter(lines, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…'))::bigint AS n_cut_lines,
        len(list_filter(lines, lambda x: ltrim(x, ' ')[1] IN ('•', '-', '*', '·')))::bigint AS n_bullet_lines
      FROM w LEFT JOIN cov USING (rid)),
b AS (SELECT *, (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {int(100 * MOST_REPEATED)} * n_words) AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND {" AND ".join(tests)}) AS kept FROM b"""
