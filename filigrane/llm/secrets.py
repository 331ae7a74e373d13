"""Secret scans: fixed patterns, and assignment-aware lexing.

Three fixed kinds (assign, access, hex) are matched over the whole text. On top
of them, texts that name something sensitive are lexed as source or
configuration: ``name = literal``, ``name: literal``, ``"name": "literal"``,
``name := a + "b"``, ``<name>literal</name>``. Names bound to literals are kept
as constants and propagated through plain names and concatenations, so a
literal bound to an innocent name counts when that name later reaches a
sensitive target. Literals are quoted strings, the bodies of elements and bare
values of configuration: a bare word that is all of its line's value, unless it
reads as a name or an expression (letters only, unless it is written NAME=value
from the start of a line; dotted; or called or indexed). Each literal is scored
by its most sensitive target name, its length and its entropy; placeholders score
nothing, and values with spaces only as passphrases of ``PHRASE_WORDS`` plain words.

A value is kept as its parts, shared between the names that hold it, and as
running counts of its characters, so all literals of an assignment count and the
whole value is scored however long propagation makes it.

Everything happens inside one row: memory is one text, its names and the distinct
characters of their values; nothing is shuffled.

Edge cases: a null text counts as empty. Later bindings of a name replace
earlier ones from there on; a name that is never bound contributes nothing. Spans
of one start go by kind, then end. Texts of any length are read whole. Only the id
and text columns are read, whatever the others are called; repeated rows give
repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "literal")

#: What any name in ASSIGN, and any sensitive target, contains in lower case.
PROBES = (b"passw", b"secret", b"token", b"api", b"pwd", b"passphrase", b"credential", b"private", b"auth", b"key", b"dsn", b"signing", b"encryption")

#: Weight of a target name by the words in it.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 0.9, "credential": 0.8, "credentials": 0.8, "auth": 0.6, "private": 0.5, "key": 0.5, "access": 0.3, "dsn": 0.5, "signing": 0.4, "encryption": 0.4, "client": 0.1}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|none|null|nil|true|false|todo|undefined|changeme|example|your.*|.*placeholder.*|<.*>|\$\{.*\}|\$[A-Z_]+|\{\{.*\}\}|%\(.*\)s)$")
MIN_LENGTH, MIN_SCORE = 6, 0.6
PHRASE_WORDS = range(3, 25)
EDGE = 4096  # characters kept of either end of a value; a value up to this length is kept whole

_ATOM = r"""(?:"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|[A-Za-z_$][\w.$-]*+|[A-Za-z0-9+/_.=@:!?%^&*~-]++)"""
PAIR = re.compile(rf"""(?P<tag><(?P<el>[A-Za-z_][\w.-]*+)>(?P<body>[^<>\n]++)</)|["']?(?P<name>(?<![\w.$-])[A-Za-z_$][\w.$-]*+)["']?[\x20\t]*+(?::=|=>|=(?!=)|:(?![:/]))[\x20\t]*+(?P<value>{_ATOM}(?:[\x20\t]*+\+[\x20\t]*+{_ATOM})*+)""", re.A)
ATOM = re.compile(_ATOM, re.A)
ENDS_LINE = re.compile(r"[\x20\t]*+(?:,[\x20\t]*+)?(?:\r?\n|\Z)|[\x20\t]++(?:#|//|;)")
NAME_LIKE = re.compile(r"[A-Za-z_$]+\Z|[A-Za-z_$][\w$-]*(?:\.[A-Za-z_$][\w$-]*)+\Z", re.A)
BARE = re.compile(r"[A-Za-z0-9+/_.=@:!?%^&*~$-]++")
PHRASE = re.compile(r"[^\W_]+(?: [^\W_]+)+\Z")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str, probes: bool | None = None) -> list[tuple[str, int, int]]:
    """Spans of the fixed kinds, code points, end exclusive."""
    out = []
    if probes is None or probes:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def sensitivity(name: str) -> float:
    """How sensitive a target name is: the weights of its words, with camel case and separators split, at most 1."""
    words = [w.lower() for w in WORDS.findall(name)]
    joined = {a + b for a, b in zip(words, words[1:], strict=False)}
    return min(1.0, sum(SENSITIVE.get(w, 0.0) for w in {*words, *joined}))


class Value:
    """A value as its parts, with what scoring needs of the whole: length, counts of characters, both ends."""

    __slots__ = ("best", "blank", "counts", "head", "lead", "n", "parts", "placeholder", "span", "tail", "trail")

    def __init__(self, text: str = "", span: tuple[int, int] | None = None) -> None:
        self.span, self.parts, self.best = span, (), 0.0
        self.n, self.counts, self.head, self.tail = len(text), Counter(text), text[:EDGE], text[-EDGE:]
        self.placeholder = "placeholder" in text.lower()
        self.blank = not text.strip()
        self.lead = text[: len(text) - len(text.lstrip())].count(" ")  # spaces in the white space at the start and the end
        self.trail = text[len(text.rstrip()) :].count(" ")

    def add(self, other: Value) -> None:
        """Append another value."""
        self.placeholder = self.placeholder or other.placeholder or "placeholder" in (self.tail[-10:] + other.head[:10]).lower()
        self.lead = self.counts[" "] + other.lead if self.blank else self.lead
        self.trail = self.trail + other.counts[" "] if other.blank else other.trail
        self.blank = self.blank and other.blank
        self.head = self.head if len(self.head) >= EDGE else (self.head + other.head)[:EDGE]
        self.tail = other.tail if len(other.tail) >= EDGE else (self.tail + other.tail)[-EDGE:]
        self.n += other.n
        self.counts.update(other.counts)

    def spaced(self) -> bool:
        """Whether a space stands inside."""
        return not self.blank and self.counts[" "] > self.lead + self.trail

    def phrase(self) -> bool:
        """Whether the value reads as a passphrase: plain words, none of which says what it is for."""
        if self.n > EDGE or not PHRASE.match(self.head):
            return False
        words = self.head.lower().split()
        return len(words) in PHRASE_WORDS and not {"your", "enter", "the", "a"}.intersection(words) and not any(w in SENSITIVE for w in words)

    def stands_in(self) -> bool:
        """Whether PLACEHOLDER matches the whole value."""
        if self.n <= EDGE:
            return bool(PLACEHOLDER.match(self.head))
        kinds = {c for c, k in self.counts.items() if k}
        names = self.head[0] == "$" and self.counts["$"] == 1 and all(re.match("(?i)[A-Z_$]", c) for c in kinds)
        ends = any(self.head.startswith(a) and self.tail.endswith(b) for a, b in (("<", ">"), ("${", "}"), ("{{", "}}"), ("%(", ")s"), ("%(", ")S")))
        return kinds <= {"x", "X"} or kinds in ({"*"}, {"."}) or self.head[:4].lower() == "your" or self.placeholder or ends or names


def entropy(counts: Counter, n: int) -> float:
    """Bits a character."""
    return -sum(c / n * (math.log2(c) - math.log2(n)) for c in counts.values() if c)


def score(name: str, value: Value) -> float:
    """0 to 1: how much a value bound to this target name looks like a secret."""
    how = sensitivity(name)
    if not how or value.n < MIN_LENGTH or value.stands_in() or value.spaced() and not (how >= 0.9 and value.phrase()):
        return 0.0
    kinds = "".join(value.counts)
    mixed = sum(bool(re.search(p, kinds)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return how * min(1.0, 0.4 + 0.1 * mixed + 0.08 * entropy(value.counts, value.n))


def _bare(text: str, m: re.Match, run: re.Match | None, bound: dict[str, Value]) -> tuple[int, int] | None:
    """The span of an unquoted value of configuration; run: the unquoted characters from the value's start on."""
    if not run or not ENDS_LINE.match(text, run.end()) or run[0] in bound:
        return None
    if all(x in bound or NAME_LIKE.match(x) for x in run[0].split("+")):
        first = m.start() == 0 or text[m.start() - 1] == "\n"
        if not first or "." in run[0] or "+" in run[0] or text[m.end("name") : run.start()] != "=":
            return None
    return run.span()


def lex(text: str) -> tuple[list[tuple[str, Value]], list[Value]]:
    """Each assignment in order, as target name and value after propagation; and all values, parts before what they make."""
    bound: dict[str, Value] = {}
    out, made, tried = [], [], 0

    def leaf(start: int, end: int) -> Value:
        made.append(Value(text[start:end], (start, end)))
        return made[-1]

    for m in PAIR.finditer(text):
        if m["tag"]:
            name, parts = m["el"], [leaf(*m.span("body"))]
        else:
            name, parts = m["name"], []
            run = BARE.match(text, m.start("value")) if m.start("value") >= tried else None  # inside an earlier run nothing is a value of its own
            tried = max(tried, run.end() if run else 0)
            bare = _bare(text, m, run, bound)
            if bare:
                parts.append(leaf(*bare))
            for a in () if bare else ATOM.finditer(text, *m.span("value")):
                raw = a[0]
                if raw[0] in "\"'":
                    parts.append(leaf(a.start() + 1, a.end() - 1))
                elif raw in bound:
                    parts.append(bound[raw])
        if len(parts) == 1:
            value = parts[0]
        else:
            value = Value()
            for x in parts:
                value.add(x)
            value.parts = tuple(parts)
            made.append(value)
        bound[name] = value
        out.append((name, value))
    return out, made


def literal_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the literals that reach a sensitive target."""
    assigned, made = lex(text)
    for name, value in assigned:
        s = score(name.rsplit(".", 1)[-1], value)
        if s >= MIN_SCORE:
            value.best = max(s, value.best)
    for value in reversed(made):
        for x in value.parts:
            x.best = max(x.best, value.best)
    return [("literal", *x) for x in sorted({v.span for v in made if v.span and v.best})]


def find(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans, each by start, then kind, then end."""
    text = text or ""
    low = text.encode("utf-8", "surrogatepass").lower()
    probes = any(p in low for p in PROBES)
    base = base_spans(text, probes)
    more = literal_spans(text) if probes and (b"=" in low or b":" in low or b"</" in low) else []
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    return sorted(base, key=order), sorted(base + more, key=order)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts of the fixed kinds, the digest of their spans, and all spans."""
    kind = docs.schema[id_col].dataType.simpleString()

    def join(spans: list) -> str:
        return ",".join([f"{k}:{s}:{e}" for k, s, e in spans])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1):
                base, every = find(t.as_py())
                n = Counter(x[0] for x in base)
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(join(base).encode()).hexdigest(), join(every)))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    schema = f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
