"""Main text of web pages by two-pass block rules (operator 2).

A tokenizer cuts a page into blocks and keeps its containers as a tree of parent numbers. Pass one looks at
a block alone: stop-word density and length speak for the article, link density against it, and so does one
mark of bounded weight, if one of the nearest containers says that it is something else (menus, footers,
adverts, forms and the like). Long dense text outvotes a mark, for all of the container; if all good text of a page is marked, the
marks of the page count for nothing. Only readers' comments stay out whatever they look like. Nothing is
known of articles as such: `article`, `main` and `div` are containers like others, and words that tell a
page's state (`no-sidebar`, `comments-open`) are no marks. Repeated neighbouring containers that each begin
with a short line, as threads do, are not the article where other text is good.

Pass two decides the ambiguous blocks, mostly short ones: each inherits the label of its nearest decided
neighbours. Where the two sides differ, a good neighbour counts only if the block stands within that
neighbour's own container; if it stands within the bad one's as well, the inner one of the two counts, then
the nearer neighbour, then the one of the same kind. A heading goes with what it heads, and the page's edges
are bad. Where no block stands out by itself,
neighbouring blocks are first judged together, by their joint length and stop words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

# Limits of the rules.
MAX_LINKS, MIN_LENGTH, LONG_LENGTH, VERY_LONG = 0.5, 70, 200, 500
#: A line that begins an item of a thread is shorter than this.
ITEM_LINE = 60
STOP_LOW, STOP_HIGH = 0.10, 0.20
#: Points of a block: so many and more are good, so many and fewer bad, what lies between is ambiguous.
GOOD, BAD = 3, -1
#: What a marked container takes away, one whose kind depends on where it stands, and readers' comments.
MARKED, HEADER, TALK = 3, 1, 9
#: How far up a mark counts, and how far up pass two looks for a common container.
NEAR, FAR = 6, 24

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he this are or his from at which but have an they you were her she all their had there been one we who will more no if out so up what about into than them can only other time new some could these two may then do first any my now such like our over me even most made after also did many before must through years where much your way down should because each just those people how too good "
    "le la les de des du un une et est en que qui dans pour sur au aux par avec ce se ne pas plus il elle ils elles on nous vous je son sa ses leur mais ou où si comme tout fait été être sont cette ces "
    "der die das und ist von mit den dem des ein eine einen einer eines zu im in nicht auf für als auch es an er sie wir ich werden aus bei nach wie oder aber nur noch über vor zum zur durch um am sich so sind war hat dass "
    "el la los las de del y en un una que es por con para no se lo al como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde su fue ha son".split()
)

BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag ends these open elements.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {n: frozenset(["p"]) for n in _ENDS_P} | {"li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "tr": frozenset(["tr", "td", "th", "p"])}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without any text of their own, and form controls.
CONTROLS = frozenset("button select option datalist head title label audio video object canvas map".split())
#: Elements, and parts of class, id or role, that mark a container of another kind.
OTHER = frozenset("nav footer aside form menu dialog fieldset".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars side aside footer foot masthead topbar "
    "cookie cookies consent notice notices gdpr privacy popup modal overlay newsletter subscribe subscription signup login search searchform share sharing social related recommended recommendations "
    "widget widgets toolbar pagination pager copyright disclaimer complementary contentinfo alert alertdialog form".split()
)
TALKS = frozenset("comment comments commentlist commentbox disqus respond reply replies replybox replylist response responses feedback discussion discussions thread threads review reviews guestbook".split())
#: Beside one of these a word is no mark: it tells what a page has, or that its container is the text itself.
STATES = frozenset("no not non without has have with is are open closed on off enabled disabled active ready page layout site single post entry article story content main body text template theme".split())
TEXTS = frozenset("post entry article story".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|svg|math|xmp)\b(?>[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*+)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-z][^>]*+\Z|[^<]++|<",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[^a-z0-9]+")


@dataclass
class Tree:
    """The containers of a page by number; 0 is the page. Blocks first[n] to last[n] - 1 are within container n."""

    parent: list[int]
    name: list[str]
    against: list[int]
    first: list[int]
    last: list[int]

    def up(self, at: int, most: int) -> Iterator[int]:
        """The container and those around it, the nearest first, without the page."""
        while at and most:
            yield at
            at, most = self.parent[at], most - 1

    def holds(self, at: int, block: int) -> bool:
        return at == 0 or self.first[at] <= block < self.last[at]

    def steps(self, at: int, block: int) -> int:
        """How far up from a container stands the first one that holds the block (FAR: not nearby)."""
        n = 0
        while n < FAR and not self.holds(at, block):
            at, n = self.parent[at], n + 1
        return n


@dataclass
class Block:
    """Text between two block tags: characters inside links, the tag, the container that it stands in, and its mark."""

    text: str
    link_chars: int
    tag: str
    at: int
    marked: int = 0
    label: str = ""


def _mark(value: str) -> int:
    """What the words of a class, id or role take away: the heaviest mark of a word without a state."""
    words = [set(_PART.split(word)) for word in value.split()]
    plain = [parts for parts in words if STATES.isdisjoint(parts)]
    if any(not TALKS.isdisjoint(parts) for parts in plain):
        return TALK
    text = any(parts & TEXTS for parts in words)  # it says that it is the text as well
    return MARKED if not text and any(not MARKS.isdisjoint(parts) for parts in plain) else 0


def _says(name: str, attrs: str) -> int:
    """What a start tag takes away from the blocks inside; 99: it isn't shown."""
    against = MARKED if name in OTHER else HEADER if name == "header" else 0
    if attrs and ("=" in attrs or "hidden" in attrs):
        for key, a, b, c in _ATTR.findall(attrs):
            key, value = key.lower(), (a or b or c).lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                return 99
            if key in ("class", "id", "role"):
                against = max(against, _mark(value))
    return against


def blocks(html: str) -> tuple[list[Block], Tree]:
    """The blocks of a page with text, in order; scripts, styles, form controls and what is hidden have none."""
    done: list[Block] = []
    pieces: list[str] = []
    link_chars = links = skipped = 0
    tree = Tree([0], [""], [0], [0], [0])
    path = [0]  # open containers
    opened: Counter[str] = Counter()
    tag = ""

    def close() -> None:
        nonlocal link_chars
        if pieces and not skipped:
            text = " ".join("".join(pieces).split())
            if text:
                done.append(Block(text, link_chars, tag, path[-1]))
        pieces.clear()
        link_chars = 0

    def pop() -> None:
        nonlocal skipped
        n = path.pop()
        tree.last[n] = len(done)
        opened[tree.name[n]] -= 1
        skipped -= tree.against[n] >= 99

    for m in _TOKEN.finditer(html):
        s = m[0]
        if s[0] != "<" or s == "<":
            if not skipped:
                t = unescape(s) if "&" in s else s
                pieces.append(t)
                if links:
                    link_chars += len(t.strip())
            continue
        name = m[3] or m[6]
        if not name:
            continue
        name, ends, attrs = name.lower(), bool(m[2] or m[5]), m[4] or m[7] or ""
        if name in ("a", "br"):
            if name == "br":
                pieces.append(" ")
            else:
                links = 0 if ends else 1
            continue
        holds = name in BLOCKS or name in CONTROLS
        against = 0 if ends or name in VOID or name in ("html", "body") else _says(name, attrs)
        if not holds and not against and not opened[name]:
            continue  # marks inside a line
        close()
        if ends:
            if opened[name] > 0:
                while tree.name[path[-1]] != name:
                    pop()
                pop()
                links = 0
            tag = ""
            continue
        if name in VOID or name in ("html", "body"):
            continue
        if name in CLOSES:  # a paragraph, an item or a cell ends where the next one, or a container, begins
            while tree.name[path[-1]] in CLOSES[name]:
                pop()
        if name in CONTROLS:
            against = 99
        skipped += against >= 99
        for column, value in ((tree.parent, path[-1]), (tree.name, name), (tree.against, against), (tree.first, len(done)), (tree.last, 0)):
            column.append(value)
        path.append(len(tree.parent) - 1)
        opened[name] += 1
        tag = name
    close()
    for n in path:
        tree.last[n] = len(done)
    for b in done:
        b.marked = max((tree.against[n] for n in tree.up(b.at, NEAR)), default=0)
    return done, tree


def points(text: str, link_chars: int, marked: int) -> int:
    """Pass one: stop-word density and length for, link density and one mark against."""
    words = text.lower().split()
    stops = sum(w.strip(".,;:!?\"'()[]%*#$&|") in STOP_WORDS for w in words) / len(words)
    if link_chars > MAX_LINKS * len(text):
        return BAD - marked
    dense, size = stops >= STOP_LOW, len(text)
    return dense + (stops >= STOP_HIGH) + (size >= MIN_LENGTH) + (dense and size >= LONG_LENGTH) + (dense and size >= VERY_LONG) * 2 - marked


def _label(n: int, marked: int) -> str:
    return "good" if n >= GOOD else "bad" if n <= BAD or marked >= MARKED else ""


def first_pass(found: list[Block], tree: Tree) -> None:
    """Labels what is decided by itself."""

    own = {id(b): points(b.text, b.link_chars, 0) for b in found}

    def judge(mark) -> bool:
        for b in found:
            b.label = _label(own[id(b)] - mark(b), mark(b))
        return any(b.label == "good" for b in found)

    judge(lambda b: b.marked)
    outvoted = {n for b in found if b.label == "good" and b.marked == MARKED for n in tree.up(b.at, NEAR) if tree.against[n] == MARKED}
    if outvoted:
        for b in found:
            b.marked = max((tree.against[n] for n in tree.up(b.at, NEAR) if n not in outvoted), default=0)
    for mark in (lambda b: b.marked, lambda b: b.marked if b.marked > MARKED else 0):
        if judge(mark) or _together(found, tree, mark):
            break
    _threads(found, tree)


def _together(found: list[Block], tree: Tree, mark) -> bool:
    """Judges the ambiguous blocks of each container by their joint text, and if that doesn't help those of the longest."""
    groups: dict[int, list[Block]] = {}
    for b in found:
        if not b.label:
            groups.setdefault(tree.parent[b.at], []).append(b)
    for own in groups.values():
        marked = max(map(mark, own))
        label = _label(points(" ".join(b.text for b in own), sum(b.link_chars for b in own), marked), marked)
        for b in own:
            b.label = label
    size = lambda own: sum(len(b.text) for b in own)
    left = [own for own in groups.values() if not own[0].label and (size(own) >= MIN_LENGTH or any(b.tag == "p" or b.tag in HEADINGS for b in own))]
    if left and not any(b.label == "good" for b in found):
        for b in max(left, key=size):
            b.label = "good"
    return any(b.label == "good" for b in found)


def _threads(found: list[Block], tree: Tree) -> None:
    """Good blocks in repeated containers that each begin with a short line are bad, if there are others."""
    alike: dict[tuple[int, str], list[int]] = {}
    for n in sorted({n for b in found for n in tree.up(tree.parent[b.at], NEAR)}):
        alike.setdefault((tree.parent[n], tree.name[n]), []).append(n)

    def item(n: int) -> bool:
        head = found[tree.first[n]]
        return tree.last[n] - tree.first[n] > 1 and head.label != "good" and head.tag not in HEADINGS and len(head.text) < ITEM_LINE and any(b.label == "good" for b in found[tree.first[n] + 1 : tree.first[n] + 4])

    items: set[int] = set()
    for same in alike.values():
        own = [n for n in same if item(n)]
        if len(own) > 1 and 2 * len(own) > len(same):
            items.update(own)
    inside = [b for b in found if b.label == "good" and any(n in items for n in tree.up(tree.parent[b.at], NEAR))]
    if inside and len(inside) < sum(b.label == "good" for b in found):
        for b in inside:
            b.label = "bad"


def inherit(found: list[Block], tree: Tree) -> list[Block]:
    """Pass two: the ambiguous blocks take the label of their nearest decided neighbours."""
    labels = [b.label for b in found]
    before, after = [-1] * len(found), [len(found)] * len(found)
    for k in range(1, len(found)):
        before[k] = k - 1 if labels[k - 1] else before[k - 1]
    for k in range(len(found) - 2, -1, -1):
        after[k] = k + 1 if labels[k + 1] else after[k + 1]
    for k, b in enumerate(found):
        if labels[k]:
            continue
        sides = []  # (container of the neighbour that holds the block as well, or -1; distance, another kind, label)
        for at in (before[k], after[k]):
            if 0 <= at < len(found):
                own = tree.parent[found[at].at]
                sides.append((own if tree.holds(own, k) else -1, abs(at - k), found[at].tag != b.tag, labels[at]))
            else:
                sides.append((0, abs(at - k), True, "bad"))
        one, two = sides
        heads = after[k] < len(found) and b.tag in HEADINGS and (two[0] >= 0 or tree.holds(_around(tree, b.at, after[k]), after[k]))
        if heads:
            b.label = two[3]
        elif one[3] == two[3]:
            b.label = one[3]
        else:
            good, bad = (one, two) if one[3] == "good" else (two, one)
            inner = good[0] > bad[0] or (good[0] == bad[0] and good[1:3] < bad[1:3])  # of two containers around a block the later one is within the other
            b.label = "good" if good[0] >= 0 and inner else "bad"
    return found


def _around(tree: Tree, at: int, block: int) -> int:
    """The nearest container around one that holds the block, if that is not the page; else the one itself."""
    n, steps = at, tree.steps(at, block)
    for _ in range(steps):
        n = tree.parent[n]
    return n if n and steps < FAR else at


def classify(html: str) -> list[Block]:
    """The blocks of a page, each good or bad."""
    found, tree = blocks(html)
    first_pass(found, tree)
    return inherit(found, tree)


def main_text(html: str | None) -> str:
    """The main text of a page, its blocks joined by one space; empty for null or where nothing is good."""
    return " ".join(b.text for b in classify(html or "") if b.label == "good")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(h) for h in b["html"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    Null or empty html gives an empty text; null ids and urls and repeated rows pass through; an empty
    table gives no rows; other columns are not read. White space is what str.split() takes for it.
    """
    slim = pages.select("page_id", "url", "html")
    kind = slim.schema["page_id"].dataType.simpleString()
    return slim.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
