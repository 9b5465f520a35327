"""Main-text extraction with wrappers inferred per host.

A host's wrapper is a union-free regular expression over its pages' token
streams: tags, text slots, repeated groups ``( )+`` and optional groups
``( )?``.  Adjacent equal groups of a stream are folded into repeated groups;
the wrapper starts as the first stream, and every further stream is aligned
with it: differing texts become slots, tags that only one side has become
optional.  A text on more than half of the pages that have its place is template
text, and so are the texts that alternate there, if repeating texts fill more than
half; ``LEAST`` pages (two on a host of two) that are no near copies of each other
must hold it.

A page's main text is what its article (or main, or body) holds without
boilerplate elements (by tag, role and class) and without the wrapper's template
text, inside an article and outside.

Wrappers come from all distinct pages of a host, and only their skeletons (tags and
text hashes) travel: groups of about ``BATCH`` are aligned, equal structures first,
and their wrappers again, until a host has one.  A place keeps its frequent texts by
Misra-Gries counts with bounded error, so a wrapper's size does not follow the number
of pages.  Long streams are aligned in segments, whole.  Every page is extracted whole.

Defined cases: null and empty html give an empty text; hosts with one distinct page
have no template text, as nothing tells it from the page's own; null urls share one
host name; repeated pages and ids count once in a wrapper and are each extracted; an
empty table gives no rows; further columns are left out, so none can clash.  Broken
pages are read in linear time: a ``<`` that begins no tag, or a tag without an end, is text.
A text's place is named by the six innermost open elements; repeats of groups of up to
``LONGEST_GROUP`` items are folded, longer ones stay side by side.
"""

from __future__ import annotations

import pickle
import re
import zlib
from bisect import bisect_left
from difflib import SequenceMatcher
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from cohortlens.llm.shared import bounded_batches, written

LEAST = 3
LONGEST_GROUP = 12
#: Skeletons or wrappers aligned at a time.
BATCH = 64
#: Texts counted at a place, as a multiple of those on one page; counts err by at most a 40th of the pages.
COUNTED = 40
#: Words kept of a page for telling near copies, and the share of equal words that makes one.
SKETCH, ALIKE = 32, 0.9
#: Longer stretches without a common anchor are aligned in segments of this length.
SEGMENT = 400

_MARK = re.compile(r"<(?:(?P<comment>!--)|(?P<other>[!?])|(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*+))", re.IGNORECASE)
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_QUOTE_OR_END = re.compile(r"[>\"']")
#: Elements whose content is no markup, left out whole.
RAW = {t: re.compile(rf"</{t}\s*+>", re.IGNORECASE) for t in "script style noscript textarea template svg iframe title".split()}
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr"
    " html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
BOILERPLATE = frozenset("nav footer aside form head button select label dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
#: Words of class names of boilerplate, and words that say nothing beside them: a name is
#: boilerplate if it has one of the first and no other word ("post-comments", not "has-sidebar").
NAMED = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner menu nav navbar navigation breadcrumb breadcrumbs sidebar widget footer masthead topbar"
    " cookie cookies consent notice alert popup modal newsletter subscribe signup login share social related recommended comment comments respond replies"
    " pagination pager".split()
)
NEUTRAL = frozenset(
    "area article articles bar block body bottom box button buttons container entry form group header icon icons inner item items left link links list main media"
    " page panel post posts primary right secondary section site slot stories sub text title top unit widgets wrap wrapper".split()
)
#: Words of an article's own class names that make it a comment or a teaser of another page.
OTHERS = frozenset("ad ads advert advertisement comment comments promo recommended related replies reply respond sponsored teaser widget".split())
CLOSES_P = BLOCK - frozenset("body caption dd dt html li tbody td tfoot th thead tr".split())
#: Start tags that end open elements (HTML's optional end tags), and the elements that stop the search.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    **dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, {"dl"})),
    **dict.fromkeys(("td", "th"), ({"td", "th"}, {"tr", "table"})),
    "tr": ({"tr"}, {"tbody", "thead", "tfoot", "table"}),
    **dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot", "caption", "tr"}, {"table"})),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
_P_SCOPE = frozenset("html table td th caption button object marquee".split())
_PASSED = frozenset("address div p".split())
_CELL_ENDS = frozenset("td th tr tbody thead tfoot table body html".split())
#: What an end tag does not reach out of, by whether its tag is a block and ends table cells.
_BOUNDS = {(False, False): ("#block", "td", "th"), (True, False): ("td", "th"), (True, True): (), (False, True): ("#block",)}
#: A tag with the groups that it is in: blocks, blocks that end the search for an open item, bounds of a paragraph's search.
_GROUPS = {
    t: (t, *(g for g, of in (("#block", BLOCK), ("#strict", BLOCK - _PASSED), ("#scope", _P_SCOPE)) if t in of)) for t in BLOCK | _P_SCOPE
}


def tokens(html: str):
    """(kind, tag, names, text): kind is start, end or text; raw elements and comments are left out.

    A ``<`` that begins no tag, or one whose end is never found, is text.  Time is linear in the page."""
    places: list[int] = []  # all quotes and tag ends, from the first tag without an end on
    lost: set[int] = set()
    last = html.rfind(">")
    at = 0
    while at < len(html):
        mark = html.find("<", at)
        if mark != at:
            yield "text", "", "", html[at : mark if mark >= 0 else len(html)]
            if mark < 0:
                return
        m = _MARK.match(html, mark)
        if m and m["comment"]:
            close = html.find("-->", m.end())
            at = close + 3 if close >= 0 else len(html)
            continue
        close = -1
        if m and m.end() <= last:
            if m["other"]:
                close = html.find(">", m.end())
            elif not places and (rest := _REST.match(html, m.end())):
                close = rest.end() - 1
            else:
                places = places or [q.start() for q in _QUOTE_OR_END.finditer(html)]
                close = _tag_end(html, places, lost, m.end())
        if close < 0:
            yield "text", "", "", "<"
            at = mark + 1
            continue
        at = close + 1
        if m["other"]:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            yield "end", tag, "", ""
        elif tag in RAW:
            after = RAW[tag].search(html, at)
            at = after.end() if after else len(html)
        else:
            names = "" if close == m.end() else " ".join(f"{k.lower()}={a or b or c}" for k, a, b, c in _ATTR.findall(html, m.end(), close))
            yield "start", tag, names, ""


def _tag_end(html: str, places: list[int], lost: set[int], at: int) -> int:
    """Place of the ``>`` that ends the tag whose name ends at ``at``, quoted ones passed over; -1 without one.

    ``places`` are all quotes and ``>``; ``lost`` gathers the quotes from which no end is found, so each is tried once."""
    seen = []
    k = bisect_left(places, at)
    while k < len(places) and (place := places[k]) not in lost:
        if html[place] == ">":
            return place
        seen.append(place)
        close = html.find(html[place], place + 1)
        if close < 0:
            break
        k = bisect_left(places, close + 1)
    lost.update(seen)
    return -1


def _named(name: str, words: frozenset[str]) -> bool:
    parts = [x for x in re.split(r"[_-]+", name.lower()) if x]
    return any(x in words for x in parts) and all(x in words or x in NEUTRAL or x.isdigit() for x in parts)


def boilerplate(tag: str, names: str, depth: int) -> bool:
    """Whether a start tag opens an element that holds no main text; ``depth``: enclosing articles and mains."""
    if tag in BOILERPLATE or tag == "header" and not depth:
        return True
    if not names or tag in ("html", "body", "main"):
        return False
    words, kind = OTHERS if tag == "article" else NAMED, ""
    for part in names.split():
        if part.startswith(("class=", "id=", "role=")):
            kind, _, part = part.partition("=")
        if kind == "role":
            if part.lower() in ROLES:
                return True
        elif _named(part, words) or tag == "div" and part == "header":
            return True
    return False


class Open(list):
    """The stack of open elements, with the places of each tag and of the groups of tags that bound a search."""

    def __init__(self):
        super().__init__()
        self.places: dict[str, list[int]] = {}

    def last(self, *names: str) -> int:
        """Place of the innermost open element of these tags or groups; -1 without one."""
        place = -1
        for name in names:
            if (at := self.places.get(name)) and at[-1] > place:
                place = at[-1]
        return place

    def cut(self, place: int) -> None:
        """Close the element at a place and all inside it."""
        while 0 <= place < len(self):
            tag = self.pop()
            for name in _GROUPS.get(tag) or (tag,):
                self.places[name].pop()

    def start(self, tag: str) -> None:
        """Open an element, after the ends that its start tag implies."""
        if tag in CLOSES_P and self.places.get("p") and (p := self.last("p")) > self.last("#scope"):
            self.cut(p)
        if tag in IMPLIED:
            ends, stops = IMPLIED[tag]
            place = self.last(*ends)
            if place >= 0 and place >= self.last(*stops, *(("#strict",) if tag in ("li", "dt", "dd") else ())):
                self.cut(place)
        if tag not in VOID:
            for name in _GROUPS.get(tag) or (tag,):
                if name in self.places:
                    self.places[name].append(len(self))
                else:
                    self.places[name] = [len(self)]
            self.append(tag)

    def end(self, tag: str) -> None:
        """Close the innermost open element of that tag; inline end tags do not reach out of a block, nor others out of a table cell."""
        place = self.last(tag)
        if place == len(self) - 1 or place >= 0 and place >= self.last(*_BOUNDS[tag in BLOCK, tag in _CELL_ENDS]):
            self.cut(place)


def text_key(path: str, text: str) -> int:
    """Signed 64-bit name of a text at a place."""
    h = xxh64_intdigest(f"{path}\0{' '.join(unescape(text).split())}")
    return h - (1 << 64) if h >= 1 << 63 else h


_DIGITS = re.compile(r"\d+")


def _paths(html: str):
    """Tokens with the path of open elements; blank texts, inline tags without names and optional end tags are left out."""
    stack = Open()
    for kind, tag, names, text in tokens(html):
        if kind == "text":
            if text.strip():
                yield kind, "/".join(stack[-6:]), text
            continue
        if kind == "start":
            stack.start(tag)
            if names or tag in BLOCK:
                yield kind, f"<{tag} {_DIGITS.sub('0', names)}>" if names else f"<{tag}>", ""
        else:
            stack.end(tag)
            if tag in BLOCK and tag != "p" and tag not in IMPLIED:
                yield kind, f"</{tag}>", ""


def skeleton(html: str) -> list[str]:
    """A page's token stream: tags, and ``#`` with the key of each text."""
    return [f"#{text_key(what, text)}" if kind == "text" else what for kind, what, text in _paths(html)]


def sketch(text: str) -> tuple[int, ...]:
    """The ``SKETCH`` least word hashes of a text."""
    return tuple(sorted({zlib.crc32(w.encode("utf-8", "replace")) for w in text.split()})[:SKETCH])


def alike(p: tuple[int, ...], q: tuple[int, ...]) -> bool:
    """Whether two sketches are those of near copies."""
    both = sorted({*p, *q})[:SKETCH]
    return len({*p}.intersection(q, both)) >= ALIKE * len(both)


class Node:
    """A wrapper item: a tag, a text (its keys with page counts and unlike pages) or a repeated group."""

    __slots__ = ("inner", "key", "lost", "mass", "optional", "pages", "texts")

    def __init__(self, key, texts=None, inner=None):
        self.key, self.texts, self.inner, self.pages, self.optional = key, texts, inner, 1, False
        self.mass = self.lost = 0  # texts counted, and the most that any count misses

    def merge(self, other: Node) -> Node:
        """The same item of other pages."""
        self.pages += other.pages
        self.optional |= other.optional
        if self.inner:
            for a, b in zip(self.inner, other.inner, strict=True):
                a.merge(b)
        elif self.key == "T":
            for key, (n, marks) in other.texts.items():
                m, have = self.texts.get(key, (0, ()))
                for mark in marks:
                    if len(have) < LEAST and not any(alike(mark, x) for x in have):
                        have = (*have, mark)
                self.texts[key] = (m + n, have)
            self.mass, self.lost = self.mass + other.mass, self.lost + other.lost
            most = COUNTED * -(-self.mass // self.pages)
            if len(self.texts) > most:
                least = sorted((n for n, _ in self.texts.values()), reverse=True)[most]
                self.texts = {k: (n - least, marks) for k, (n, marks) in self.texts.items() if n > least}
                self.lost += least
        return self

    def fold(self, other: Node) -> Node:
        """Another repetition on the same page: its texts join."""
        if self.inner:
            for a, b in zip(self.inner, other.inner, strict=True):
                a.fold(b)
        elif self.key == "T":
            self.texts.update(other.texts)
            self.mass = len(self.texts)
        return self


def folded(stream: list[str], mark: tuple[int, ...]) -> list[Node]:
    """The stream with adjacent equal groups folded into repeated groups, short groups first; texts side by side are one item."""
    nodes: list[Node] = []
    for t in stream:
        node = Node("T", {int(t[1:]): (1, (mark,))}) if t[0] == "#" else Node(t)
        node.mass = int(node.key == "T")
        if node.key == "T" and nodes and nodes[-1].key == "T":
            nodes[-1].fold(node)
        else:
            nodes.append(node)
    for size in range(1, LONGEST_GROUP + 1):
        keys = [n.key for n in nodes]
        out, i = [], 0
        while i < len(nodes):
            j = i + size
            if j < len(nodes) and keys[i] == keys[j] and keys[i:j] == keys[j : j + size]:
                unit = nodes[i:j]
                while keys[j : j + size] == keys[i : i + size]:
                    for a, b in zip(unit, nodes[j : j + size], strict=True):
                        a.fold(b)
                    j += size
                single = size == 1 and unit[0].inner
                out.append(unit[0] if single else Node(("+", *keys[i : i + size]), inner=unit))
                i = j
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def _matching(a: list, b: list, x: int = 0, y: int = 0):
    """(place in a, place in b) of matching keys: common ends, then anchors that both sides have once,
    then what is between them, in segments if long."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        yield x + lo, y + lo
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    tail = [(x + len(a) - k, y + len(b) - k) for k in range(hi, 0, -1)]
    a, b, x, y = a[lo : len(a) - hi], b[lo : len(b) - hi], x + lo, y + lo
    if a and b:
        if max(len(a), len(b)) <= SEGMENT:
            for i, j, n in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks():
                yield from ((x + i + k, y + j + k) for k in range(n))
        else:
            cuts = _anchors(a, b)
            if not cuts:
                parts = -(-max(len(a), len(b)) // SEGMENT)
                cuts = [(len(a) * k // parts, len(b) * k // parts) for k in range(1, parts)]
            for (i, j), (k, m) in zip([(0, 0), *cuts], [*cuts, (len(a), len(b))], strict=True):
                yield from _matching(a[i:k], b[j:m], x + i, y + j)
    yield from tail


def _anchors(a: list, b: list) -> list[tuple[int, int]]:
    """Places of keys that both sides have exactly once, rising on both sides."""
    once = [{}, {}]
    for places, keys in zip(once, (a, b), strict=True):
        for i, k in enumerate(keys):
            places[k] = -1 if k in places else i
    pairs = [(i, once[1][k]) for k, i in once[0].items() if i >= 0 and once[1].get(k, -1) >= 0]
    ends: list[int] = []  # patience: least last place of a rising run of each length
    runs: list[tuple] = []
    for i, j in sorted(pairs):
        at = bisect_left(ends, j)
        run = ((i, j), runs[at - 1] if at else None)
        ends[at:], runs[at:] = [j, *ends[at + 1 :]], [run, *runs[at + 1 :]]
    out, run = [], runs[-1] if runs else None
    while run:
        out.append(run[0])
        run = run[1]
    return out[::-1]


class Wrapper:
    def __init__(self, stream: list[str], mark: tuple[int, ...]):
        self.nodes, self.pages = folded(stream, mark), 1

    def keys(self) -> list:
        return [n.key for n in self.nodes]

    def align(self, other: Wrapper) -> None:
        """Resolve the mismatches between the wrapper and that of other pages."""
        out: list[Node] = []
        a = b = 0
        for i, j in [*_matching(self.keys(), other.keys()), (len(self.nodes), len(other.nodes))]:
            for n in [*self.nodes[a:i], *other.nodes[b:j]]:
                n.optional = True
                out.append(n)
            if i < len(self.nodes):
                out.append(self.nodes[i].merge(other.nodes[j]))
            a, b = i + 1, j + 1
        self.nodes, self.pages = out, self.pages + other.pages

    def template(self) -> set[int]:
        """Keys of the texts that repeat on most pages that have their place, or alternate there."""
        need = min(LEAST, self.pages)
        total: dict[int, list] = {}
        out: set[int] = set()

        def walk(nodes, single):
            for n in nodes:
                if n.inner:
                    walk(n.inner, False)
                elif n.key == "T":
                    often = 0
                    for key, (count, marks) in n.texts.items():
                        seen = total.setdefault(key, [0, 0, ()])
                        seen[0], seen[1] = seen[0] + count + n.lost, seen[1] + n.pages
                        seen[2] = (*seen[2], *(m for m in marks if not any(alike(m, x) for x in seen[2])))
                        often += count * (len(marks) >= need)
                    if single and n.mass == n.pages and 2 * often > n.pages:
                        out.update(k for k, (_, marks) in n.texts.items() if len(marks) >= need)

        if need > 1:
            walk(self.nodes, True)
        return out | {k for k, (count, pages, marks) in total.items() if 2 * count > pages and len(marks) >= need}

    def pattern(self) -> str:
        """The wrapper as a union-free regular expression."""

        def show(nodes) -> str:
            out, was = "", False
            for n in nodes:
                if n.optional != was:
                    out += "(" if n.optional else ")?"
                    was = n.optional
                out += f"({show(n.inner)})+" if n.inner else n.key if n.key != "T" else "#TEXT" if len(n.texts) == 1 and not n.lost else "#SLOT"
            return out + (")?" if was else "")

        return show(self.nodes)

    def packed(self) -> bytes:
        return zlib.compress(pickle.dumps(self, pickle.HIGHEST_PROTOCOL), 1)


def merged(wrappers: list[Wrapper]) -> Wrapper:
    """One wrapper of all: equal structures first, then the others, the most frequent one first."""
    equal: dict[tuple, Wrapper] = {}
    for w in wrappers:
        if (first := equal.setdefault(tuple(w.keys()), w)) is not w:
            first.align(w)
    order = sorted(equal.items(), key=lambda x: (-x[1].pages, repr(x[0])))
    out = order[0][1]
    for _, w in order[1:]:
        out.align(w)
    return out


def infer(streams: list[list[str]]) -> Wrapper | None:
    """Wrapper of a host's token streams, equal streams once; None without any."""
    distinct = sorted({tuple(s) for s in streams if s})
    return merged([Wrapper(list(s), (k,)) for k, s in enumerate(distinct)]) if distinct else None


def main_text(html: str, template: frozenset[int] | set[int] = frozenset()) -> str:
    """Main text of a page: blocks in page order joined by two line feeds.

    It is what the articles hold; what main holds, if most of its text is outside its articles; or what
    body holds without either.  Boilerplate elements end where the stack of open elements ends them."""
    blocks: list[tuple[bool, bool, str]] = []  # in an article, in main
    now: list[str] = []
    stack = Open()
    regions: list[tuple[int, str]] = []  # open articles and mains: place in the stack, tag
    inside = {"article": 0, "main": 0}  # open ones of each
    skip = -1  # place of the open boilerplate element
    found = False  # an article or main outside boilerplate

    def flush():
        if block := " ".join(unescape("".join(now)).split()):
            blocks.append((inside["article"] > 0, inside["main"] > 0, block))
        now.clear()

    for kind, tag, names, text in tokens(html):
        if kind == "text":
            if skip < 0 and (not template or text_key("/".join(stack[-6:]), text) not in template):
                now.append(text)
            continue
        if skip < 0 and tag in BLOCK:
            flush()
        (stack.start if kind == "start" else stack.end)(tag)
        opened = kind == "start" and tag not in VOID
        held = len(stack) - opened  # what was open before and still is
        if skip >= held:
            skip = -1
        if regions and regions[-1][0] >= held:
            flush()
            while regions and regions[-1][0] >= held:
                inside[regions.pop()[1]] -= 1
        if skip >= 0:
            continue
        if tag == "br":
            now.append(" ")
        if opened and boilerplate(tag, names, len(regions)):
            flush()
            skip = held
        elif opened and tag in ("article", "main"):
            regions.append((held, tag))
            inside[tag] += 1
            found = True
    flush()
    size = lambda wanted: sum(len(b) for a, m, b in blocks if wanted(a, m))
    main, both = size(lambda _, m: m), size(lambda a, m: a and m)
    if main and 2 * both < main:
        return "\n\n".join(b for _, m, b in blocks if m)
    return "\n\n".join(b for a, _, b in blocks if a or not found)


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def host_wrappers(pages: DataFrame, batch_size: int = BATCH) -> DataFrame:
    """(host, template, pattern) of every host of ``pages`` (host, html)."""

    def single(batches):
        for batch in batches:
            out: dict[tuple, bytes] = {}
            for host, html in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True):
                stream = skeleton(html)
                if stream and (key := (host, text_key("", "\n".join(stream)))) not in out:
                    out[key] = Wrapper(stream, sketch(main_text(html))).packed()
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in out], pa.string()), pa.array([k for _, k in out], pa.int64()), pa.array(list(out.values()), pa.binary())], names=["host", "k", "w"]
            )

    def together(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("k").to_pylist(), table.column("w").to_pylist(), strict=True))
        whole = rows[0][1] if len(rows) == 1 else merged([pickle.loads(zlib.decompress(w)) for _, w in rows]).packed()
        return pa.table({"host": table.column("host")[:1], "k": pa.array([rows[0][0]], pa.int64()), "w": pa.array([whole], pa.binary())})

    def learned(batches):
        for batch in batches:
            got = [pickle.loads(zlib.decompress(w)) for w in batch.column(1).to_pylist()]
            template = pa.array([sorted(w.template()) for w in got], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), template, pa.array([w.pattern() for w in got], pa.string())], names=["host", "template", "pattern"])

    kind = "host string, k long, w binary"
    found = written(pages.select("host", "html").mapInArrow(single, kind).dropDuplicates(["host", "k"]), "wrapper-pages")
    while True:  # each round leaves about one wrapper of ``batch_size``
        n = written(found.groupBy("host").agg(F.count("*").alias("n")), "wrapper-counts")
        if (n.agg(F.max("n")).first()[0] or 0) <= 1:
            return found.select("host", "w").mapInArrow(learned, "host string, template array<long>, pattern string")
        part = F.pmod(F.xxhash64("k"), F.ceil(F.col("n") / batch_size)).alias("part")
        found = written(found.join(n, "host").select("host", "k", "w", part).groupBy("host", "part").applyInArrow(together, kind), "wrapper-round")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    wrappers = written(host_wrappers(rows).select("host", "template"), "wrappers")
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py(), frozenset(t.as_py() or ())) for h, t in zip(batch.column(2), batch.column(3), strict=True)]
            size = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), size], names=["page_id", "url", "text", "n_chars"])

    joined = rows.join(wrappers, "host", "left").select("page_id", "url", "html", "template")
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
