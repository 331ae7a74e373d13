"""Text functions as column expressions: cleaning, splitting, categories, keyword counts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigrane.functions.taxonomy import FINANCE, Taxonomy

#: What survives the ASCII filter, and what is written otherwise.
KEPT_SYMBOLS = "€£¥¢"
REWRITTEN = (("•", "*"), ("—", "--"), ("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"))
#: The cleaning steps of a paragraph, in order.
CLEANING = (
    (r"([a-z])([A-Z])", "$1 $2"),
    (r"([a-zA-Z])(\d+)", "$1 $2"),
    (r"(\d+)([a-zA-Z])", "$1 $2"),
    (r"([a-zA-Z0-9])(\$)", "$1 $2"),
    (r"\s+", " "),
    (r"\(\s*", "("),
    (r"\s*\)", ")"),
    (r"\s*,", ","),
    (r"(-{3,}|={3,}|\.{3,})", ""),
    (r"<.*?>", ""),
    (r"(?i)table of contents", ""),
    (r"F-\d+", ""),
)
SENTENCE_END = r"(?<=[.!?])\s+|(?<=[a-z])(?=[A-Z])"
OLD_SENTENCE_END = r"(?<![A-Z0-9])\s*\.\s*(?![a-zA-Z0-9])"
LIST_ITEM = r"^(?:[-*•]\s*|\(?\d+[.)]\s+)"


def keep_allowed(text: Column) -> Column:
    """ASCII and a few currency signs; dashes, bullets and quotes rewritten."""
    for old, new in REWRITTEN:
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.regexp_replace(text, rf"[^\x00-\x7F{KEPT_SYMBOLS}]+", "")


def unescaped(text: Column) -> Column:
    """What old HTML cleaning does first: the text's UTF-8 bytes read as Latin-1 with backslash escapes resolved; unchanged where that fails."""

    def one(t: str | None) -> str | None:
        try:
            return t if t is None else t.encode("utf-8").decode("unicode_escape").encode("utf-8", "replace").decode("utf-8")
        except UnicodeDecodeError:
            return t

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return F.when(F.contains(text, F.lit("\\")) | text.rlike(r"[^\x00-\x7F]"), read(text)).otherwise(text)


def flat_keywords(groups: dict) -> list[str]:
    """All keywords of a mapping of lists, or of mappings of lists, once each in order of first mention."""
    found: dict[str, None] = {}
    for value in groups.values():
        found.update(dict.fromkeys(flat_keywords(value) if isinstance(value, dict) else value))
    return list(found)


def union_keywords(*columns: Column) -> Column:
    """Distinct keywords of several array columns, in order of first mention; null arrays count as empty."""
    return F.array_distinct(F.flatten(F.array(*[F.coalesce(c, F.array().cast("array<string>")) for c in columns])))


def clean_paragraph(text: Column) -> Column:
    """Line breaks become spaces but for list items, then the cleaning steps."""
    out = F.when(text.rlike(LIST_ITEM), text).otherwise(F.regexp_replace(text, r"\n+", " "))
    for pattern, new in CLEANING:
        out = F.regexp_replace(out, pattern, new)
    return F.trim(out)


def sentences(text: Column, pattern: str = SENTENCE_END) -> Column:
    """Trimmed sentences without blank ones."""
    parts = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), pattern)
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def first_category(text: Column, categories: tuple[tuple[str, str], ...] = FINANCE.categories) -> Column:
    """The first category whose pattern is found, or null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(categories):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def allowed(text: Column, tax: Taxonomy = FINANCE) -> Column:
    """Whether the lower-cased text holds any of the allowed stems."""
    return F.lower(text).rlike("|".join(re.escape(w) for w in tax.allowed)) if tax.allowed else F.lit(False)


def word_count(text: Column, word: str) -> Column:
    """Occurrences of a word or phrase in the lower-cased text, between ASCII borders."""
    return F.regexp_count(F.lower(text), F.lit(rf"(?<![a-z0-9_]){re.escape(word.lower())}(?![a-z0-9_])"))


def keyword_counts(text: Column, words: list[str]) -> Column:
    return F.create_map(*[x for w in words for x in (F.lit(w), word_count(text, w))])


def grouped_counts(counts: Column, groups: dict[str, list[str]]) -> list[Column]:
    """Sums of a map of counts over each group's keywords, as columns named by the group."""
    return [sum((F.coalesce(counts[w], F.lit(0)) for w in words), F.lit(0)).alias(g) for g, words in groups.items()]


def weighted_score(text: Column, weights: dict[str, float], floor: Column | None = None) -> Column:
    """tanh of the weighted keyword counts, three decimals, and not below floor."""
    total = F.lit(0.0)
    for word, weight in weights.items():
        total = total + word_count(text, word) * weight
    score = F.round(F.tanh(total), 3)
    return F.greatest(score, floor) if floor is not None else score


def pack_sentences(parts: Column, most: int) -> Column:
    """Sentences joined by a space into pieces of at most most characters, greedily; a longer sentence is a piece of its own."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, s: Column) -> Column:
        fits = F.length(acc["now"]) + F.length(s) + 1 <= most
        grown = F.when(acc["now"] == "", s).otherwise(F.concat(acc["now"], F.lit(" "), s))
        closed = F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"])))
        return F.struct(F.when(fits, acc["done"]).otherwise(closed).alias("done"), F.when(fits, grown).otherwise(s).alias("now"))

    return F.aggregate(parts, start, step, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))))


def merge_short(parts: Column, least: int = 15) -> Column:
    """Paragraphs under least characters join the one before."""
    none = F.array().cast("array<string>")

    def step(acc: Column, p: Column) -> Column:
        n = F.size(acc)
        joined = F.concat(F.slice(acc, 1, n - 1), F.array(F.concat(F.element_at(acc, -1), F.lit(" "), p)))
        return F.when((F.length(p) < least) & (n > 0), joined).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(parts, none, step)


def neighbours_merged(rows: DataFrame, keys: list[str], order: str, text: str, least_words: int = 6) -> DataFrame:
    """Each sentence of at least least_words words between its neighbours."""
    w = Window.partitionBy(*keys).orderBy(order)
    words = F.size(F.split(F.trim(text), r"\s+"))
    around = rows.select(*keys, order, F.concat_ws(" ", F.lag(text).over(w), F.col(text), F.lead(text).over(w)).alias("merged"), words.alias("_n"))
    return around.where(F.col("_n") >= least_words).drop("_n")


def length_band(rows: DataFrame, text: str, below: float = 1.96, above: float = 1.28) -> DataFrame:
    """Rows whose length lies within the mean less below and plus above standard deviations. The statistics are one row, broadcast."""
    s = rows.agg(F.avg(F.length(text)).alias("_m"), F.stddev_samp(F.length(text)).alias("_s"))
    kept = rows.join(F.broadcast(s)).where(F.length(text).between(F.col("_m") - below * F.col("_s"), F.col("_m") + above * F.col("_s")))
    return kept.drop("_m", "_s")


def without_markers(rows: DataFrame, text: str, markers: tuple[str, ...] = ("table of contents", "consolidated balance sheets")) -> DataFrame:
    """Rows with text that isn't blank and names none of the markers."""
    bad = F.lit(False)
    for m in markers:
        bad = bad | F.contains(F.lower(text), F.lit(m))
    return rows.where(F.col(text).isNotNull() & (F.trim(text) != "") & ~bad)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<.*?>", "")


def year_tag(text: Column, year: Column, tag: str = "reportYear") -> Column:
    return F.concat(F.lit(f"<{tag}>"), year.cast("string"), F.lit(f"</{tag}> "), text)


def title_case(text: Column) -> Column:
    return F.initcap(text)


def padded_cik(cik: Column) -> Column:
    return F.lpad(cik.cast("string"), 10, "0")


def duration(seconds: int) -> str:
    """1h 2m 3s; leading zero parts are left out."""
    h, m, s = seconds // 3600, seconds // 60 % 60, seconds % 60
    return f"{h}h {m}m {s}s" if h else f"{m}m {s}s" if m else f"{s}s"


def sentence_case(text: Column) -> Column:
    """First letters of the text and of what follows a full stop in upper case, other letters lower."""
    parts = F.split(F.lower(text), r"(?<=\.\s)")
    return F.array_join(F.transform(parts, lambda s: F.concat(F.upper(F.left(s, F.lit(1))), F.substr(s, F.lit(2)))), "")
