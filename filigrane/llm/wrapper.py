"""Main text of web pages by wrapper induction.

Pages of one host share a template. Every page becomes a DOM tree in which equal
siblings stand for one repeated node; the trees are aligned with the most usual
tree of the whole host by simple tree matching (Yang, 1991), computed once for
each pair of shapes. A text that most pages with an aligned slot repeat in it is
template; what varies in a slot is content.

Varying slots are judged by where they stand and what they hold, over all pages
of the host: a slot's weight is its mean share of a page's varying text outside
links. From the root down, a node whose text stands mostly in its own blocks, or
which has a varying headline, is a region of content; of other nodes those
children go on that hold ``LEAST_PART`` of the heaviest one's weight, nested ones
with the same tag, and headlines. Slots mostly of links are navigation.

Pages are read twice. First each gives its shape and, by slot, hash and size of
its texts; these rows are counted by host, slot and hash with partial sums before
the shuffle, so the template is that of all pages of a host, however many there
are, however long they are and however they are partitioned. Then the pages meet
their host's template. A template holds no more than 1 / ``CONSTANT_SHARE`` times
the blocks of a page; up to ``BROADCAST_CHARS`` in all they are broadcast and no
page leaves its partition, beyond it the same join shuffles and Spark splits its
skewed partitions. Pages with the same wanted blocks are copies and count once.
Hosts of fewer than ``MIN_PAGES`` distinct pages have no template.

What the markup says are hints. Scripts, styles, menus, headers, footers, forms
and the like are left out by tag and role; sidebars, notices, adverts and reader
comments by whole class and id words, unless induction finds ``HIDDEN_SHARE`` of
the host's varying text under them. A marked article is taken less the template and
less navigation if the induced regions hold any of it; where regions and marks
contradict each other the longer text counts. Without a template, marks and hints
decide alone. A page of which nothing would be left keeps its wanted blocks, or
what class and id words hide if that is longer.

Time is linear in a page but for the alignment, which takes time by the product
of the distinct siblings; over ``TABLE_CELLS`` of it, siblings are matched by tag
and rank instead.

Edge cases: a null or empty html has no text. Unclosed, stray and wrongly
nested tags are repaired as browsers do for the common cases; what looks like a
tag but never ends is text. Ties for the most usual shape go to the greatest written form.
Only page_id, url and html are read, whatever the others are called; a null url is
a host of its own; repeated rows give repeated results; an empty table gives an
empty one. No text is dropped for its size.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigrane.llm.state import cut

GROUP_PAGES = 256  # pages whose counts are added up before they leave Python; steers load only
BROADCAST_CHARS = 32_000_000
MIN_PAGES, CONSTANT_SHARE = 4, 0.6
HIDDEN_SHARE, ALL_DOUBTED = 0.9, 0.98
LEAST_PART, LINKED = 0.4, 0.5
MAX_DEPTH = 48  # of the shapes that are aligned; text is taken from any depth
TABLE_CELLS = 250_000

TAG = re.compile(r"[a-zA-Z][^\s/>]*+")
REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++)))?""")
#: White space of HTML and of character references that browsers show as space.
SPACE = re.compile(r"[\s​]+")

#: Fixed values of HTML: elements without content, raw text, blocks, and what ends an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn del em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody")}
SCOPE = frozenset("table ul ol dl td th article section div body html nav aside main header footer".split())
DROP_TAGS = frozenset("head script style noscript template iframe svg math canvas object embed nav footer aside form button select option textarea input label fieldset dialog menu audio video map".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar alertdialog".split())
DROP_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer masthead comment comments commentlist respond disqus replies cookie cookies consent gdpr notice notices banner popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations widget toolbar pagination pager skip".split())
#: Words that may stand beside these in a class or id.
PLACE_WORDS = frozenset("site page main top bottom left right box block section wrapper container area list inner outer bar link links post article global primary secondary mobile desktop item items form widget group".split())
HEADLINES = ("h1", "h2")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}

#: How sure it is that an element isn't the article.
OUT, DOUBT = -1, 1


class Node:
    __slots__ = ("children", "drop", "key", "tag")

    def __init__(self, tag: str, drop: int = 0) -> None:
        self.tag, self.drop, self.children, self.key = tag, drop, [], None


def _named(value: str) -> bool:
    """Whether a word of a class or id attribute names something that isn't the article."""
    for token in value.split():
        own = [w.lower() for w in WORDS.findall(token) if len(w) > 1]
        if DROP_WORDS.intersection(own) and all(w in DROP_WORDS or w in PLACE_WORDS for w in own):
            return True
    return False


@lru_cache(maxsize=4096)
def _unwanted(tag: str, attributes: str) -> int:
    """Whether something that isn't the article is named: OUT by tag, role or a hidden mark, DOUBT by class or id, or 0."""
    if tag in DROP_TAGS:
        return OUT
    if not attributes or tag in ("html", "body", "article", "main"):
        return 0
    doubt = 0
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return OUT
        if name == "role" and DROP_ROLES & set(value.lower().split()):
            return OUT
        if name in ("class", "id") and _named(value):
            doubt = DOUBT
    return doubt


class Stack:
    """The open elements, and where those of each tag stand."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of these tags, or 0."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def cut(self, place: int) -> None:
        """Close the element at a place and all that it holds."""
        while len(self.nodes) > place:
            self.places[self.nodes.pop().tag].pop()

    def close(self, tag: str) -> None:
        place = self.last((tag,))
        if place and (tag not in INLINE and tag != "p" or place > self.last(SCOPE - {tag})):
            self.cut(place)  # a stray end tag doesn't close what holds it

    def make_room(self, tag: str) -> None:
        """Close what the new element ends by itself: an open paragraph, the list item or cell before it."""
        ends = (("p",) if tag in CLOSES_P else ()) + SAME.get(tag, ())
        if not ends:
            return
        inside = SCOPE - {"tr"} - set(ends) if tag in CLOSES_P else ("table", "ul", "ol", "dl")
        while (place := self.last(ends)) > self.last(inside):
            self.cut(place)
            if tag not in ("thead", "tbody", "tfoot", "tr"):
                return


def parse(html: str) -> Node:
    """The DOM of a page: Node for elements, str for text. Comments and declarations are left out."""
    root = Node("#root")
    stack, pos, n = Stack(root), 0, len(html)

    def text(end: int) -> None:
        if end > pos:
            stack.nodes[-1].children.append(html[pos:end])

    at = html.find("<")
    while at >= 0:
        after = html[at + 1 : at + 2]
        if html.startswith("<!--", at):
            text(at)
            end = html.find("-->", at + 4)
            pos = n if end < 0 else end + 3
        elif after in ("!", "?"):
            text(at)
            end = html.find(">", at)
            pos = n if end < 0 else end + 1
        elif m := TAG.match(html, at + 2 if after == "/" else at + 1):
            text(at)
            tag, rest = m[0].lower(), REST.match(html, m.end())
            end = rest.end() if rest else html.find(">", m.end()) + 1
            if not end:
                pos = at
                break
            attributes, pos = html[m.end() : end - 1], end
            if after == "/":
                stack.close(tag)
            else:
                stack.make_room(tag)
                node = Node(tag, _unwanted(tag, attributes))
                stack.nodes[-1].children.append(node)
                if tag in RAW:
                    stop = RAW_END[tag].search(html, pos)
                    if tag in ("textarea", "title"):
                        node.children.append(html[pos : stop.start() if stop else n])
                    pos = stop.end() if stop else n
                elif tag not in VOID and not attributes.endswith("/"):
                    stack.push(node)
        else:
            at = html.find("<", at + 1)
            continue
        at = html.find("<", pos)
    text(n)
    return root


def shape(node: Node, depth: int = 0) -> tuple:
    """A hashable tree of tags, down to MAX_DEPTH; equal siblings are one repeated node, where the first stands. Sets node.key to it."""
    kids: dict[tuple, None] = {}
    if depth < MAX_DEPTH:
        for c in node.children:
            if isinstance(c, Node) and c.tag not in INLINE:
                kids[shape(c, depth + 1)] = None
    node.key = (node.tag, tuple(kids))
    return node.key


class Matching:
    """Simple tree matching of two shapes: sizes of the largest order-keeping matches of their subtrees."""

    def __init__(self) -> None:
        self.sizes: dict[tuple[int, int], int] = {}

    def size(self, a: tuple, b: tuple) -> int:
        if a[0] != b[0]:
            return 0
        key = (id(a), id(b))
        if key not in self.sizes:
            self.sizes[key] = 1 + sum(m for _, _, m in self.pairs(a[1], b[1]))
        return self.sizes[key]

    def pairs(self, a: tuple, b: tuple) -> list[tuple[int, int, int]]:
        """Matched places of two lists of siblings, and the sizes of their matches."""
        if len(a) * len(b) > TABLE_CELLS:
            return self._ranked(a, b)
        rows = [[0] * (len(b) + 1)]
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(max(row[-1], rows[-1][j + 1], rows[-1][j] + self.size(x, y)))
            rows.append(row)
        out, i, j = [], len(a), len(b)
        while i and j:
            m = self.size(a[i - 1], b[j - 1])
            if m and rows[i][j] == rows[i - 1][j - 1] + m:
                i, j = i - 1, j - 1
                out.append((i, j, m))
            elif rows[i][j] == rows[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return out

    def _ranked(self, a: tuple, b: tuple) -> list[tuple[int, int, int]]:
        """The k-th sibling of a tag with the k-th of it."""
        places, seen, out = {}, Counter(), []
        for i, x in enumerate(a):
            places.setdefault(x[0], []).append(i)
        for j, y in enumerate(b):
            k, seen[y[0]] = seen[y[0]], seen[y[0]] + 1
            if k < len(places.get(y[0], ())):
                i = places[y[0]][k]
                out.append((i, j, self.size(a[i], y)))
        return out


def matched(a: tuple, b: tuple) -> int:
    """The size of the largest order-keeping match of two shapes with equal roots."""
    return Matching().size(a, b)


def align(a: tuple, b: tuple) -> dict[tuple, tuple]:
    """From places in b to the places in a that simple tree matching gives them; a place is a path of child numbers."""
    out, matching = {}, Matching()

    def go(x: tuple, y: tuple, px: tuple, py: tuple) -> None:
        out[py] = px
        for i, j, _ in matching.pairs(x[1], y[1]):
            go(x[1][i], y[1][j], (*px, i), (*py, j))

    if a[0] == b[0]:
        go(a, b, (), ())
    return out


def clean(parts: list[str]) -> str:
    return SPACE.sub(" ", unescape("".join(parts))).strip()


def blocks(root: Node) -> list[tuple[tuple, str, int, bool, int]]:
    """Every block of text in page order: its slot in the page's shape, its text, whether it is unwanted (0, OUT or DOUBT), whether it stands in a marked article, and how many of its characters are links."""
    out: list[tuple[tuple, str, int, bool, int]] = []
    parts: list[str] = []
    linked: list[str] = []

    def flush(slot: tuple, drop: int, article: bool) -> None:
        if parts:
            text = clean(parts)
            if text:
                out.append((slot, text, drop, article, min(len(text), sum(len(clean([x])) for x in linked))))
            parts.clear()
            linked.clear()

    todo: list = [("open", root, (), 0, False, False)]
    while todo:
        what, node, slot, drop, article, link = todo.pop()
        if what == "text":
            parts.append(node)
            if link:
                linked.append(node)
            continue
        if what == "flush":
            flush(slot, drop, article)
            continue
        drop = OUT if OUT in (drop, node.drop) or node.tag == "header" and not article else drop or node.drop
        article = article or node.tag in ("article", "main")
        link = link or node.tag == "a"
        places: dict[tuple, int] = {}
        edge = [("flush", None, slot, drop, article, False)] if node.tag not in INLINE else []
        later: list = list(edge)
        for c in node.children:
            if isinstance(c, str):
                later.append(("text", c, slot, drop, article, link))
            elif c.tag in INLINE:
                later.append(("text", " ", slot, drop, article, False) if c.tag == "br" else ("open", c, slot, drop, article, link))
            else:
                inner = (*slot, places.setdefault(c.key, len(places))) if len(slot) < MAX_DEPTH else slot
                later += (("flush", None, slot, drop, article, False), ("open", c, inner, drop, article, link))
        todo.extend(reversed(later + edge))
    return out


def _written(x: object) -> str:
    return json.dumps(x, separators=(",", ":"))


def _path(slot: tuple) -> str:
    return ".".join(map(str, slot))


@lru_cache(maxsize=1024)
def _read_shape(written: str) -> tuple:
    pool: dict[tuple, tuple] = {}

    def read(x: list) -> tuple:
        made = (x[0], tuple(map(read, x[1])))
        return pool.setdefault(made, made)

    return read(json.loads(written))


@lru_cache(maxsize=4096)
def _places(usual: str, own: str) -> dict[str, str]:
    """Paths of a page's slots to those of the host's usual shape that they are aligned with."""
    return {_path(slot): _path(at) for slot, at in align(_read_shape(usual), _read_shape(own)).items()}


#: In place of a text's hash: all texts of the slot; the slot stands in the page's marked article.
ANY, MARKED = "", "article"


def _hash(text: str) -> str:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=6).hexdigest()


def _dom(html: str | None) -> tuple[str, list[tuple[tuple, str, int, bool, int]]]:
    """A page's written shape and blocks."""
    tree = parse(html or "")
    own = _written(shape(tree))
    return own, blocks(tree)


def features(html: str | None) -> tuple[str, str, str]:
    """What a page tells of its host's template, written: the hash of its wanted blocks, which copies share, its shape, and by slot the hash, size, linked size and doubted size of its texts."""
    own, found = _dom(html)
    page = _hash("\n".join(text for _, text, drop, *_ in found if not drop) or "\n".join(text for _, text, drop, *_ in found if drop == DOUBT))
    said: dict[str, dict] = {}
    marked = set()
    for slot, text, drop, article, link in found:
        if drop != OUT:
            x = said.setdefault(_path(slot), {}).setdefault(_hash(text), [0, 0, 0])
            for k, size in enumerate((len(text), link, len(text) if drop else 0)):
                x[k] += size
            if article and not drop:
                marked.add(_path(slot))
    return page, own, _written([said, sorted(marked)])


def votes(usual: str, own: str, said: str) -> dict[tuple[str, str], list[float]]:
    """By aligned slot and text hash, and for ANY and MARKED: one page, and shares of the page's text: in all, in links, doubted."""
    place, (texts, marked) = _places(usual, own), json.loads(said)
    total = sum(x[0] for by in texts.values() for x in by.values()) or 1
    out: dict[tuple[str, str], list[float]] = {}
    for slot, by in texts.items():
        if (at := place.get(slot)) is None:
            continue
        for what, sizes in by.items():
            for key in ((at, what), (at, ANY)):
                x = out.setdefault(key, [1, 0.0, 0.0, 0.0])
                for k, size in enumerate(sizes, 1):
                    x[k] += size / total
    return out | {(place[slot], MARKED): [1, 0.0, 0.0, 0.0] for slot in marked if slot in place}


class Template:
    """What all pages of a host tell: fixed texts, slots that most pages mark, and which slots hold content.

    kinds: 1 for regions of content, 0 for what stands beside them, -1 for navigation and doubted places; a slot without one follows what holds it.
    trusted: slots whose class and id words are overruled, with all that they hold."""

    def __init__(self, fixed: Iterable[tuple[str, str]], marked: Iterable[str], kinds: dict[str, int], trusted: Iterable[str]) -> None:
        self.fixed, self.marked, self.kinds, self.trusted = frozenset(map(tuple, fixed)), frozenset(marked), kinds, frozenset(trusted)

    def trusts(self, at: str | None) -> bool:
        """Whether a slot, or what holds it, is known to hold content in spite of class and id words."""
        while at and at not in self.trusted:
            at = at.rpartition(".")[0]
        return at is not None and at in self.trusted

    def kind(self, at: str | None, slot: str, place: dict[str, str]) -> int | None:
        """What a page's slot holds, by its own place or the nearest one that holds it; None where nothing is known."""
        while at is None and slot:
            slot = slot.rpartition(".")[0]
            at = place.get(slot)
        while at is not None:
            if at in self.kinds:
                return self.kinds[at]
            at = at.rpartition(".")[0] if at else None
        return None


@lru_cache(maxsize=1024)
def _read_template(written: str) -> Template:
    return Template(*json.loads(written))


def induce(usual: str, counts: dict[tuple[str, str], list[float]]) -> str:
    """The written template of a host from its usual shape and the summed votes of its pages."""
    pages = {at: x[0] for (at, what), x in counts.items() if what == ANY}
    often = {k: x for k, x in counts.items() if k[1] != ANY and x[0] >= max(MIN_PAGES, CONSTANT_SHARE * pages.get(k[0], 0))}
    fixed = sorted(k for k in often if k[1] != MARKED)
    varying = {at: list(x[1:]) for (at, what), x in counts.items() if what == ANY}
    for at, what in fixed:
        for k in range(3):
            varying[at][k] -= counts[at, what][k + 1]
    return _written([fixed, sorted(at for at, what in often if what == MARKED), *_regions(_read_shape(usual), varying)])


def _regions(usual: tuple, varying: dict[str, list[float]]) -> tuple[dict[str, int], list[str]]:
    """Kinds of the slots of a shape and its trusted slots, from the varying text, links and doubted text of each."""
    sums: dict[str, list[float]] = {}
    kinds: dict[str, int] = {}

    def add(node: tuple, at: str) -> list[float]:
        x = list(varying.get(at, (0.0, 0.0, 0.0)))
        for i, kid in enumerate(node[1]):
            for k, v in enumerate(add(kid, f"{at}.{i}" if at else str(i))):
                x[k] += v
        sums[at] = x
        return x

    total = add(usual, "")
    plain = {at: max(0.0, x[0] - x[1]) for at, x in sums.items()}

    trusted = sorted(at for at, (text, _, doubted) in sums.items() if doubted >= ALL_DOUBTED * text and doubted >= HIDDEN_SHARE * total[0] > 0)
    of_trusted = Template((), (), {}, trusted).trusts

    def refused(at: str) -> bool:
        text, link, doubted = sums[at]
        return text > 0 and (link > LINKED * text or doubted > 0.5 * text and not of_trusted(at))

    def inside(node: tuple, at: str) -> None:
        for i, kid in enumerate(node[1]):
            place = f"{at}.{i}" if at else str(i)
            if refused(place):
                kinds[place] = -1
            else:
                inside(kid, place)

    def judge(node: tuple, at: str) -> None:
        kids = [(kid, f"{at}.{i}" if at else str(i)) for i, kid in enumerate(node[1])]
        own = max(0.0, varying.get(at, (0.0,))[0]) + sum(plain[place] for kid, place in kids if not kid[1] and not refused(place))
        headline = any(kid[0] in HEADLINES and not kid[1] and plain[place] > 0 for kid, place in kids)
        if not kids or headline or own >= 0.5 * plain[at]:
            kinds[at] = 1
            inside(node, at)
            return
        kinds[at] = 0
        heaviest = max((plain[place] for _, place in kids if not refused(place)), default=0.0)
        tags = {kid[0] for kid, place in kids if plain[place] >= LEAST_PART * heaviest and not refused(place)}
        for kid, place in kids:
            if refused(place):
                kinds[place] = -1
            elif plain[place] > 0 and (plain[place] >= LEAST_PART * heaviest or kid[1] and kid[0] in tags):
                judge(kid, place)

    if total[0] > 0:
        judge(usual, "")
    return kinds, trusted


def decide(html: str | None, usual: str | None, template: Template | None) -> tuple[str, list[str]]:
    """What decides for a page of a host with this usual shape and template, and its main blocks.

    The first is "regions", "marked", "slots" or "page" for where the text is taken from, with "-template" if the template
    takes something away; "hidden" for what class and id words hide; "" for a page without text."""
    own, found = _dom(html)
    place = _places(usual, own) if usual and template else {}
    template = template or Template((), (), {}, ())
    size = lambda rows: sum(len(x[0]) for x in rows)
    wanted, hidden = [], []  # text, kind, marked, varying, in a slot that most pages mark
    for slot, text, drop, article, _ in found:
        if drop == OUT:
            continue
        path = _path(slot)
        at = place.get(path)
        kind = template.kind(at, path, place)
        row = (text, kind, article, at is None or (at, _hash(text)) not in template.fixed, at in template.marked)
        (hidden if drop and not (kind == 1 and template.trusts(at)) else wanted).append(row)
    varying = [x for x in wanted if x[3]]
    region = [x for x in varying if x[1] == 1]
    marked = [x for x in varying if x[2]]
    slots = [x for x in varying if x[4]]
    unknown = [x for x in varying if x[1] is None]
    if not template.kinds:
        where, kept, source = ("marked", marked, [x for x in wanted if x[2]]) if any(x[2] for x in wanted) else ("page", varying, wanted)
    elif marked:
        agreed = [x for x in marked if x[1] != -1]
        if any(x[1] == 1 for x in marked) or size(marked) >= size(region):
            where, kept, source = "marked", agreed or marked, [x for x in wanted if x[2]]
        else:
            where, kept, source = "regions", region, [x for x in wanted if x[1] == 1]
    elif slots:
        where, kept, source = "slots", slots, [x for x in wanted if x[4]]
    elif size(region) > size(unknown):
        where, kept, source = "regions", region, [x for x in wanted if x[1] == 1]
    else:
        where, kept, source = "page", [x for x in varying if x[1] in (1, None)] or varying, wanted
    if kept:
        return where + "-template" * (len(kept) < len(source)), [x[0] for x in kept]
    left = [x for x in hidden if x[3]]
    if size(left) > size(wanted):
        return "hidden", [x[0] for x in left]
    return "page" if wanted else "", [x[0] for x in wanted]


def main_blocks(html: str | None, usual: str | None, template: Template | None) -> str:
    """The main text of a page."""
    return "\n".join(decide(html, usual, template)[1])


def induced(pages: list[str | None]) -> tuple[str | None, Template | None]:
    """The usual shape and the template of the pages of one host, if they are enough."""
    copies: dict[str, tuple[str, str]] = {}
    for page, *said in map(features, pages):
        copies[page] = min(copies.get(page, tuple(said)), tuple(said))
    if len(copies) < MIN_PAGES:
        return None, None
    shapes = Counter(own for own, _ in copies.values())
    usual = max(shapes, key=lambda own: (shapes[own], own))
    return usual, _read_template(induce(usual, _summed((usual, own, said) for own, said in copies.values())))


def extract(pages: list[str | None]) -> list[str]:
    """The main text of each page of one host."""
    usual, template = induced(pages)
    return [main_blocks(h, usual, template) for h in pages]


def _summed(pages: Iterable[tuple[str, str, str]]) -> dict[tuple[str, str], list[float]]:
    out: dict[tuple[str, str], list[float]] = {}
    for usual, own, said in pages:
        for key, x in votes(usual, own, said).items():
            held = out.setdefault(key, [0, 0.0, 0.0, 0.0])
            for k, v in enumerate(x):
                held[k] += v
    return out


def _small(df: DataFrame, *texts: str) -> DataFrame:
    """df, whose row and text sizes are counted first, with the hint to broadcast it if it is within BROADCAST_CHARS."""
    size = df.agg(F.sum(sum((F.coalesce(F.length(t), F.lit(0)) for t in texts), F.lit(100)))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_CHARS else df


def templates(pages: DataFrame) -> DataFrame:
    """(host, usual, template) of each host of MIN_PAGES distinct pages or more, from (host, html)."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [features(h.as_py()) for h in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([m[k] for m in made], pa.string()) for k in range(3))], ["host", "page", "own", "said"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, GROUP_PAGES):
                hosts: dict[str, list] = {}
                for host, *page in zip(*(c.to_pylist() for c in b.slice(k, GROUP_PAGES).columns), strict=True):
                    hosts.setdefault(host, []).append(page)
                rows = [(host, *key, *x) for host, own in hosts.items() for key, x in _summed(own).items()]
                types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["host", "at", "what", "n", "text", "link", "doubt"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [induce(usual, {(r["at"], r["what"]): [r["n"], r["text"], r["link"], r["doubt"]] for r in rows}) for usual, rows in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.string())], ["host", "usual", "template"])

    every = pages.select("host", "html").mapInArrow(look, "host string, page string, own string, said string")
    seen = cut(every.groupBy("host", "page").agg(F.min(F.struct("own", "said")).alias("one")).select("host", "one.own", "one.said"))
    shapes = seen.groupBy("host", "own").agg(F.count("*").alias("n")).groupBy("host").agg(F.max(F.struct("n", "own")).alias("most"), F.sum("n").alias("pages"))
    usual = cut(shapes.where(F.col("pages") >= MIN_PAGES).select("host", F.col("most.own").alias("usual")))
    counts = seen.join(_small(usual, "host", "usual"), "host").select("host", "usual", "own", "said").mapInArrow(count, "host string, at string, what string, n long, text double, link double, doubt double")
    often = cut(counts.groupBy("host", "at", "what").agg(*[F.sum(c).alias(c) for c in ("n", "text", "link", "doubt")]).where((F.col("what") == ANY) | (F.col("n") >= MIN_PAGES)))
    slots = often.where(F.col("what") == ANY).select("host", "at", F.col("n").alias("pages_with"))
    kept = often.join(slots, ["host", "at"]).where((F.col("what") == ANY) | (F.col("n") >= CONSTANT_SHARE * F.col("pages_with")))
    rows = kept.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("at", "what", "n", "text", "link", "doubt"))).alias("rows"))  # no more than a template's texts and its shape's slots
    return usual.join(rows, "host").select("host", "usual", "rows").mapInArrow(settle, "host string, usual string, template string")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", partitions: int | None = None) -> DataFrame:
    """One row a page: id, url, text and n_chars (its code points)."""
    kind = pages.schema[id_col].dataType.simpleString()
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1))
    d = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    if partitions:
        d = d.repartition(partitions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_blocks(h.as_py(), u.as_py(), _read_template(t.as_py()) if t.is_valid else None) for h, u, t in zip(*(b.column(k) for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    known = d.join(_small(cut(templates(d)), "host", "usual", "template"), "host", "left").select("id", "url", "html", "usual", "template")
    return known.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
