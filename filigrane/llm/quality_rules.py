"""Quality rules: text measures and a threshold table, compiled to Spark projections.

Everything is a built-in expression on one row; there is no user function, no
shuffle and no state across documents. A text is split once into words and
lines, the measures follow from the two arrays, and the verdict is one
projection made from ``THRESHOLDS``.

Edge cases: a null or empty text has no words, zero measures and fails the base
rule (fewer than 20 words). Texts of any length are measured whole, in one row.
Equal lines and windows count by place, the first of lines not at all, of windows
too, so ties don't arise. Only the id and text columns are read, so other columns
of the input never clash. Repeated rows give repeated results; an empty table
gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
NOT_SYMBOL = r"[^#*$%&|<>]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Frequent function words of four languages.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "das", "der", "die", "ein", "eine", "für", "ist", "mit", "nicht", "und", "von", "zu", "den", "auf", "im",
    "au", "aux", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une",
    "con", "del", "el", "las", "los", "no", "por", "se", "su", "una", "y", "es", "para",
)


@dataclass(frozen=True)
class Rule:
    """A measure (SQL over the measured columns) and the closed range that passes."""

    name: str
    measure: str
    low: float
    high: float


#: The threshold table. Ratios of an empty denominator are null and pass here; the base rule has failed such texts.
THRESHOLDS = (
    Rule("symbols", "try_divide(n_symbols, word_chars)", 0.0, 0.10),
    Rule("mean_word", "try_divide(word_chars, n_words)", 1.5, 25.0),
    Rule("stop_words", "try_divide(n_stop, n_words)", 0.02, 1.0),
    Rule("repeated_lines", "try_divide(n_dup_lines, n_lines)", 0.0, 0.50),
)


def _struct_sorted(hashes: Column) -> Column:
    return F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return id_col and the measures of each row's text.

    ``n_repeat_words`` counts the words inside 8-word windows that occur twice
    or more in the same text: windows are hashed, sorted beside their place,
    and the union of the repeated windows is summed from the gaps between
    their starts. Only texts with a repeated window pay for the sort.
    """
    d = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    d = d.select(
        id_col,
        F.array_remove(F.split("_t", SPACE), "").alias("_w"),
        F.filter(F.split("_t", "\n", -1), lambda line: line.rlike(WORD)).alias("_lines"),
        F.length(F.regexp_replace("_t", NOT_SYMBOL, "")).cast("long").alias("n_symbols"),
    )
    d = d.select(
        id_col,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop"),
        F.when(F.size("_w") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_w", i, WINDOW)))).alias("_h"),
    )
    kept = [id_col, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop"]
    d = d.select(*kept, F.when(F.size(F.array_distinct("_h")) < F.size("_h"), _struct_sorted(F.col("_h"))).alias("_s"))

    def starts(i: Column) -> Column:
        same = F.coalesce(F.get("_s", i - 1)["h"] == F.get("_s", i)["h"], F.lit(False)) | F.coalesce(F.get("_s", i + 1)["h"] == F.get("_s", i)["h"], F.lit(False))
        return F.when(same, F.get("_s", i)["p"])

    d = d.select(*kept, F.when(F.col("_s").isNotNull(), F.sort_array(F.array_compact(F.transform(F.sequence(F.lit(0), F.size("_s") - 1), starts)))).alias("_p"))
    gaps = F.transform(F.sequence(F.lit(0), F.size("_p") - 1), lambda i: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", i + 1) - F.get("_p", i), F.lit(WINDOW))))
    covered = F.when(F.size("_p") > 0, F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long"))
    return d.select(*kept, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def verdict(measured: DataFrame, rules: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """Add base_failed and kept: the threshold table as one projection."""
    base = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"
    passes = " AND ".join(f"coalesce({r.measure} BETWEEN {r.low} AND {r.high}, true)" for r in rules) or "true"
    return measured.selectExpr("*", f"({base}) AS base_failed", f"(NOT ({base}) AND {passes}) AS kept")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """Measures and verdict for each row of docs."""
    return verdict(measure(docs, id_col, text_col), rules)


def oracle(rules: tuple[Rule, ...] = THRESHOLDS) -> str:
    """The same in DuckDB SQL over the documents view."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    passes = " AND ".join(f"coalesce({r.measure.replace('try_divide(', 'ratio(')} BETWEEN {r.low} AND {r.high}, true)" for r in rules)
    for r in rules:
        top, bottom = r.measure.removeprefix("try_divide(").removesuffix(")").split(", ")
        passes = passes.replace(f"ratio({top}, {bottom})", f"({top}::DOUBLE / nullif({bottom}, 0))")
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         row_number() OVER () AS rid FROM documents
), win AS (
  SELECT rid, i, array_to_string(list_slice(w, i, i + 7), chr(31)) AS s
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM d)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1
), cover AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 8)) AS k) GROUP BY rid
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))::BIGINT AS n_lines,
         len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))))::BIGINT AS n_lines_distinct,
         len(list_filter(w, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop,
         coalesce(cover.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cover USING (rid)
), n AS (SELECT *, n_lines - n_lines_distinct AS n_dup_lines,
         (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND {passes}) AS kept
FROM n
"""
