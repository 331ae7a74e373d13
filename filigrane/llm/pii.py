"""Personal data: patterns propose spans, checksums confirm them, context words score them.

Built-in functions only. Each kind has a pattern; ``split`` and
``regexp_extract_all`` give the texts between and inside its leftmost
non-overlapping matches, and one fold over both arrays turns lengths into
code-point offsets. Validators (octet range, digit counts, Luhn, mod-97) and
context scores are expressions on those few candidates, so no row leaves its
partition and nothing is shuffled.

The patterns are written with possessive quantifiers and look-behinds so that
every kind scans a text in linear time and never recurses on long runs; each
accepts exactly the leftmost non-overlapping matches of the plain form named
beside it.

Edge cases: a null text counts as empty, an empty text has no spans. Texts of any
length are read whole; a fold gathers spans in blocks, so its time is linear in
them. Spans of one start go by kind, then end. Repeated rows give repeated results,
an empty table an empty one; only the id and text columns are read, whatever the
others are called.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """pattern: Java regex. probe: text that any match contains, tested first ("": none). base: confirmed without context.
    weight: the score before context; context: words that raise it by CONTEXT_GAIN when they stand up to CONTEXT_CHARS before the span, whatever
    matches lie between, or before an earlier match from which only matches and text without letters lead to the span (a list)."""

    name: str
    pattern: str
    probe: str
    context: str
    weight: float
    base: bool = True


BLOCK = 32
CONTEXT_CHARS = 48
CONTEXT_GAIN = 0.3
MIN_SCORE = 0.5

#: In the order that breaks ties of start. Base kinds come first.
KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", r"(?i)e-?mail|contact|write to|mailto", 0.7),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", r"(?i)\bip\b|address|host|server", 0.6),
    # [0-9]([\x20-]?[0-9])+ of 12 to 19 digits
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])", "", r"(?i)card|visa|master|amex|payment|iban|account", 0.65),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", r"(?i)phone|tel|call|fax|mobile|whatsapp", 0.65),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", "", r"(?i)iban|account|bank|konto|compte|cuenta", 0.7, base=False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", r"(?i)ssn|social|security number", 0.3, base=False),
)
BASE_KINDS = tuple(k.name for k in KINDS if k.base)

_SPAN = "struct<s:int,k:int,e:int,score:double>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))
    twice = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    each = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.when(i % 2 == 0, twice(F.substr(d, i, F.lit(1)).cast("int"))).otherwise(F.substr(d, i, F.lit(1)).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _mod97(m: Column) -> Column:
    c = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(c, F.lit(5)), F.left(c, F.lit(4)))

    def step(acc: Column, i: Column) -> Column:
        ch = F.substr(turned, i, F.lit(1))
        letter = F.ascii(ch) - 55
        return F.when(ch.between("A", "Z"), (acc * 100 + letter) % 97).otherwise((acc * 10 + F.ascii(ch) - 48) % 97)

    return (F.length(c).between(15, 34)) & (F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1)


def _octets(m: Column) -> Column:
    small = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
    value = lambda p: F.coalesce(F.when(small(p), F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int")), F.lit(999))
    return F.forall(F.split(m, r"\."), lambda p: value(p) <= 255)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return _octets(m)
    if kind == "card":
        return _luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return _mod97(m)
    return F.lit(True)


def _candidates(kind: Kind, text: Column) -> Column:
    """The texts between the matches of one kind: n + 1 pieces, null if there is no match."""
    pieces = F.split(text, kind.pattern, -1)
    return F.when(F.contains(text, F.lit(kind.probe)), pieces) if kind.probe else pieces


def _appended(acc: Column, one: Column, empty: Column) -> list[Column]:
    """The fields of a fold that gathers a list: how many it holds, the newest ones, and full blocks of BLOCK. A list that grew by itself would be copied whole for each element."""
    newest = F.concat(acc["newest"], F.array(one))
    full = (acc["n"] + 1) % BLOCK == 0
    return [(acc["n"] + 1).alias("n"), F.when(full, empty).otherwise(newest).alias("newest"), F.when(full, F.concat(acc["blocks"], F.array(newest))).otherwise(acc["blocks"]).alias("blocks")]


def _gathering(empty: Column, kind: str) -> list[Column]:
    return [F.lit(0).alias("n"), empty.alias("newest"), F.array().cast(f"array<array<{kind}>>").alias("blocks")]


def _gathered(acc: Column) -> Column:
    return F.flatten(F.concat(acc["blocks"], F.array(acc["newest"])))


def _offsets(kind: Kind, pieces: Column, matches: Column) -> Column:
    """One struct a match: start, end, its text and whether it has a context word."""
    pairs = F.arrays_zip(F.slice(pieces, 1, F.size(matches)).alias("p"), matches.alias("m"))
    made = "struct<s:int,e:int,m:string,c:boolean>"
    empty = F.array().cast(f"array<{made}>")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.lit(False).alias("on"), *_gathering(empty, made))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["p"])
        e = s + F.length(x["m"])
        before = F.right(F.concat(acc["tail"], x["p"]), F.lit(CONTEXT_CHARS))
        on = before.rlike(kind.context) | (acc["on"] & ~x["p"].rlike(r"\p{L}"))
        one = F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"), on.alias("c"))
        tail = F.right(F.concat(before, x["m"]), F.lit(CONTEXT_CHARS))
        return F.struct(e.alias("at"), tail.alias("tail"), on.alias("on"), *_appended(acc, one, empty))

    return F.aggregate(pairs, start, step, _gathered)


def _confirmed(i: int, kind: Kind, found: Column) -> Column:
    """Spans of one kind that pass their validator and, beyond the base kinds, the least score."""
    score = lambda x: F.round(F.lit(kind.weight) + F.when(x["c"], CONTEXT_GAIN).otherwise(0.0), 2)
    spans = F.transform(F.filter(found, lambda x: _valid(kind.name, x["m"])), lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e"), score(x).alias("score")))
    return spans if kind.base else F.filter(spans, lambda x: x["score"] >= MIN_SCORE)


def find(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in keep, and ``_spans``: an array of (s, k, e, score), in order; k is the place in KINDS.

    Starts and ends are code points, the end exclusive."""
    none = F.array().cast(f"array<{_SPAN}>")
    d = docs.select(*[F.col(c) for c in keep], F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    d = d.select(*keep, "_t", *[_candidates(k, F.col("_t")).alias(f"_p{i}") for i, k in enumerate(KINDS)])
    found = [F.when(F.size(f"_p{i}") > 1, _confirmed(i, k, _offsets(k, F.col(f"_p{i}"), F.regexp_extract_all("_t", F.lit(k.pattern), F.lit(0))))).otherwise(none) for i, k in enumerate(KINDS)]
    return d.select(*keep, F.array_sort(F.concat(*found)).alias("_spans"))


def _joined(spans: Column) -> Column:
    name = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _count(i: int) -> Column:
    return F.size(F.filter("_spans", lambda x: x["k"] == i)).cast("long")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts of the base kinds, the digest of their spans, all spans and their scores."""
    d = find(docs, [id_col], text_col)
    base = F.filter("_spans", lambda x: x["k"] < len(BASE_KINDS))
    return d.select(
        id_col,
        *[_count(i).alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("_spans")).alias("spans"),
        F.array_join(F.transform("_spans", lambda x: x["score"].cast("string")), ",").alias("scores"),
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every confirmed span of text_col replaced by [KIND]; other columns, and null texts, stay.

    Spans that overlap an earlier one extend its replacement."""
    tag = F.array(*[F.lit(f"[{k.name.upper()}]") for k in KINDS])
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(text_col).alias("_fg_text"))
    d = find(packed, ["_row", "_fg_text"], "_fg_text")
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("at"), *_gathering(empty, "string"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substr("_fg_text", acc["at"] + 1, x["s"] - acc["at"])
        fresh = F.when(x["s"] >= acc["at"], F.concat(gap, F.get(tag, x["k"]))).otherwise("")
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), *_appended(acc, fresh, empty))

    clean = F.aggregate("_spans", start, step, lambda acc: F.concat(F.array_join(_gathered(acc), ""), F.substr("_fg_text", acc["at"] + 1)))
    text = F.when(F.size("_spans") > 0, clean).otherwise(F.col("_fg_text"))
    return d.select(*[(text if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns])
