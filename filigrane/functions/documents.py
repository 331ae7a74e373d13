"""Document-sized text work that is sequential by nature, run once a document in Arrow batches.

Everything here is a function of one text. The DataFrame forms take an id and a
text column and never join or shuffle.
"""

from __future__ import annotations

import json
import random
import re
from collections import Counter, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from filigrane.functions.taxonomy import FINANCE, Taxonomy
from filigrane.functions.text import CLEANING, KEPT_SYMBOLS, OLD_SENTENCE_END, REWRITTEN, SENTENCE_END

BULLET, NUMBERED = re.compile(r"[-*•]\s*"), re.compile(r"\(?\d+[.)]\s+")
FINISHED = re.compile(r"[.!?;:•)]\s*\Z")
RULE = re.compile(r"[-=\s]+")
LONG_PARAGRAPH, SHORT_PARAGRAPH = 600, 15
_STEPS = tuple((re.compile(p), re.sub(r"\$(\d)", r"\\\1", r)) for p, r in CLEANING)
_SENTENCE, _OLD_SENTENCE = re.compile(SENTENCE_END), re.compile(OLD_SENTENCE_END)
_OTHER = re.compile(rf"[^\x00-\x7F{KEPT_SYMBOLS}]+")


class _Strings(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.silent += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        self.silent -= tag in ("script", "style") and self.silent > 0

    def handle_data(self, data: str) -> None:
        if not self.silent and data.strip():
            self.found.append(data.strip())


def html_strings(html: str) -> list[str]:
    """Every non-blank text node, trimmed, in page order; scripts and styles are silent."""
    parser = _Strings()
    parser.feed(html)
    parser.close()
    return parser.found


def ascii_only(text: str) -> str:
    for old, new in REWRITTEN:
        text = text.replace(old, new)
    return _OTHER.sub("", text)


def join_lists(lines: list[str]) -> list[str]:
    """Adjacent items of a list become one paragraph, and so does a line with the unfinished one before it."""
    out: list[str] = []
    todo = iter(lines)
    for line in todo:
        for marker in (BULLET, NUMBERED):
            if marker.match(line):
                if marker is BULLET and len(line.strip()) == 1:
                    line = " ".join([line, *[x for x in [next(todo, None)] if x is not None]])
                if out and marker.match(out[-1]):
                    out[-1] += "\n" + line
                else:
                    out.append(line)
                break
        else:
            if out and not FINISHED.search(out[-1]):
                out[-1] += " " + line
            else:
                out.append(line)
    return out


def pack(text: str, most: int = LONG_PARAGRAPH) -> list[str]:
    """A long paragraph in greedy packs of its sentences."""
    if len(text) <= most:
        return [text]
    packs = [""]
    for sentence in _SENTENCE.split(text):
        if len(packs[-1]) + len(sentence) + 1 <= most:
            packs[-1] = f"{packs[-1]} {sentence}" if packs[-1] else sentence
        else:
            packs.append(sentence)
    return [p for p in packs if p]


def fixed_width_table(block: str) -> list[list[str]]:
    """Rows of a table set in fixed width. Lines before the <S> mark run together into the first cell of the first row after it."""
    head, heading, rows = [], True, []
    for line in block.splitlines():
        line = line.rstrip()
        if not line or RULE.fullmatch(line) or line.strip().lower().startswith("<caption>"):
            continue
        if "<S>" in line:
            heading, line = False, line.replace("<S>", "").lstrip()
        if heading:
            head.append(line.strip())
            continue
        cells = [c.strip() for c in re.split(r"\s{2,}", line)]
        rows.append([" ".join(head), *cells] if head else cells)
        head = []
    return rows


def clean_paragraphs(paragraphs: list[str]) -> list[str]:
    """Cleaned paragraphs; very short ones join the one before."""
    out: list[str] = []
    for text in filter(None, map(str.strip, paragraphs)):
        if not (BULLET.match(text) or NUMBERED.match(text)):
            text = re.sub(r"\n+", " ", text)
        for pattern, new in _STEPS:
            text = pattern.sub(new, text)
        text = text.strip()
        if out and len(text) < SHORT_PARAGRAPH:
            out[-1] = f"{out[-1]} {text}"
        elif text:
            out.append(text)
    return out


def extract(raw: str | None, as_html: bool = True) -> list[str]:
    """Paragraphs of a filing, from html or from plain text with tables."""
    if not raw:
        return []
    if as_html:
        lines = [s.strip() for s in re.split(r"\n\s*\n", ascii_only("\n\n".join(html_strings(raw)))) if s.strip()]
        return clean_paragraphs([p for joined in join_lists(lines) for p in pack(joined)])
    found: list[str] = []
    for part in re.split(r"(?is)(<table>.*?</table>)", ascii_only(raw)):
        if part.strip().lower().startswith("<table>"):
            found.append("\n".join("\t".join(row) for row in fixed_width_table(part)))
        else:
            found += re.split(r"\n\s*\n", part)
    return clean_paragraphs(found)


def split_sentences(text: str, pattern: re.Pattern = _SENTENCE) -> list[str]:
    return [s.strip() for s in pattern.split(re.sub(r"\s+", " ", text.strip())) if s.strip()]


@dataclass(frozen=True)
class Window:
    """Limits of context expansion. compat mimics the older behaviour: the sentence next to the seed is skipped, and pieces keep their end marks before the joining one."""

    least: int = 500
    most: int = 1200
    uses: int = 2
    least_words: int = 6
    compat: bool = True


class Expander:
    """Grows a passage around each categorised sentence of one document."""

    def __init__(self, sentences: list[str], tax: Taxonomy = FINANCE, window: Window = Window()) -> None:
        patterns = [(name, re.compile(p)) for name, p in tax.categories]
        self.stems = re.compile("|".join(re.escape(w.lower()) for w in tax.allowed)) if tax.allowed else None
        self.sentences, self.tax, self.window = sentences, tax, window
        self.category = [next((n for n, p in patterns if p.search(s)), None) for s in sentences]
        self.used: Counter[int] = Counter()

    def admits(self, i: int, category: str) -> bool:
        if not 0 <= i < len(self.sentences) or self.used[i] >= self.window.uses:
            return False
        own = self.category[i]
        return own in (None, category, self.tax.generic) or self.stems is not None and bool(self.stems.search(self.sentences[i].lower()))

    def size(self, inner: int, first: str, last: str) -> int:
        """Length of joined parts of so many characters, joints included: white space at either end doesn't count, the last stop does."""
        return inner - (len(first) - len(first.lstrip())) - (len(last) - len(last.rstrip())) + 1

    def grow(self, seed: int, category: str) -> tuple[str, set[int]]:
        """The passage around a seed and the sentences in it."""
        own = (lambda t: t) if self.window.compat else (lambda t: t.rstrip("."))
        parts, members = deque([own(self.sentences[seed])]), {seed}
        inner = len(parts[0])
        reach = 2 if self.window.compat else 1
        frontier: dict[int, int | None] = {-1: seed - reach, 1: seed + reach}
        while self.size(inner, parts[0], parts[-1]) < self.window.least and any(v is not None for v in frontier.values()):
            for side in (-1, 1):
                at = frontier[side]
                if at is None:
                    continue
                if not self.admits(at, category):
                    frontier[side] = None
                    continue
                text = self.sentences[at]
                over = self.size(inner + 2 + len(own(text)), own(text), parts[-1]) - self.window.most
                if over > 0:
                    text = text[over:] if side < 0 else text[:-over]
                text = own(text)
                inner += 2 + len(text)
                if side < 0:
                    parts.appendleft(text)
                else:
                    parts.append(text)
                members.add(at)
                frontier[side] = None if over > 0 else at + side
        return ". ".join(parts).strip() + ".", members

    def run(self) -> dict[str, list[str]]:
        """Passages by category: specific categories first, in text order, then the generic one; equal passages of a category once."""
        out: dict[str, list[str]] = {name: [] for name, _ in self.tax.categories}
        seen = {name: set() for name in out}
        specific = [i for i, c in enumerate(self.category) if c and c != self.tax.generic]
        generic = [i for i, c in enumerate(self.category) if c == self.tax.generic and len(self.sentences[i].split()) >= self.window.least_words]
        for i in specific + generic:
            if self.used[i] >= self.window.uses:
                continue
            category = self.category[i]
            passage, members = self.grow(i, category)
            key = passage.lower().strip()
            if key not in seen[category]:
                seen[category].add(key)
                out[category].append(passage)
                self.used.update(members)
        return out


def legacy_windows(text: str, year: int, keywords: list[str], ignore: list[str], least: int = 400, most: int = 2000, least_words: int = 6) -> list[str]:
    """Windows around sentences with a keyword: the least length varies by a quarter, seeded by year and place; both ends are trimmed to most."""
    sentences = split_sentences(text, _OLD_SENTENCE)
    joined = lambda a, b: ". ".join(sentences[a:b]).strip() + "."
    out: dict[str, str] = {}
    for i, sentence in enumerate(sentences):
        if len(sentence.split()) < least_words or not any(k.lower() in sentence.lower() for k in keywords):
            continue
        wanted = random.Random(year + i).randint(int(least * 0.75), int(least * 1.25))
        a, b = i, i + 1
        while len(joined(a, b)) < wanted:
            before = (a, b)
            if a > 0 and len(joined(a - 1, b)) <= most:
                a -= 1
            if b < len(sentences) and len(joined(a, b + 1)) <= most:
                b += 1
            if (a, b) == before:
                break
        window = joined(a, b)
        over = max(0, len(window) - most)
        window = window[over // 2 : len(window) - (over - over // 2)].strip()
        low = window.lower()
        if not any(k.lower() in low for k in ignore):
            out.setdefault(low, window)
    return list(out.values())


def per_document(docs: DataFrame, id_col: str, text_col: str, make: Callable[[str | None], str], out: str) -> DataFrame:
    """id_col and the text that make gives for each document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([make(t.as_py()) for t in b.column(1)], pa.string())], ["id", "out"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, out string").withColumnsRenamed({"id": id_col, "out": out})


def paragraphs(docs: DataFrame, id_col: str, text_col: str, as_html: bool = True) -> DataFrame:
    """Paragraphs of each filing, with a blank line between, in the column content."""
    return per_document(docs, id_col, text_col, lambda t: "\n\n".join(extract(t, as_html)), "content")


def expand_context(docs: DataFrame, id_col: str, text_col: str, tax: Taxonomy = FINANCE, window: Window = Window()) -> DataFrame:
    """Passages by category of each document as a JSON map in the column matches."""
    return per_document(docs, id_col, text_col, lambda t: json.dumps(Expander(split_sentences(t or ""), tax, window).run(), ensure_ascii=False), "matches")
