"""Operator 4: main text of web pages by wrapper induction.

A page becomes a tree of its block elements; neighbours of equal shape merge into one slot, so a page of forty
paragraphs and one of four have the same shape. Per host, the commonest shape is the reference; every other shape of
the host is aligned with it by simple tree matching (largest order-preserving match of equal labels), once per shape and
not per page. A text that stands in the same reference slot on at least ``SHARE`` of a host's pages (of ``LEAST_PAGES`` or
more) is template in that slot; slots whose text varies are content. Only pages with different blocks count, so copies of one
article are one page.

Roles known from HTML come before that: menus, page headers, footers, sidebars, notices, adverts, forms, comments, scripts and
styles (``DROP_TAGS``, ``CUES``) are never content (inside an article only clear words on containers tell; ids of headings, sections
and paragraphs are titles; words such as article-header are left to the template), and where a page marks its article (article, main) only that is; inside it
only what is not a paragraph, heading or the like can be template, since copied articles repeat there by right. Lists of reader comments and
adverts are dropped wherever they stand. A marked article survives a layout word around it (``content-with-sidebar``, a form
around the whole page) if the page marks no other; a page all of whose text is in a form keeps the form's paragraphs.

Matching compares equal subtrees by name first; what differs goes through the whole quadratic recurrence, at any number of siblings.
It runs row by row on arrays, weights are worked out once per pair of different subtrees of one label, and only every
root-of-the-rows-th row is kept (the rows between are made again on the way back), so thousands of siblings take some MB.

Text: character references are decoded, white space in a block becomes one space, blocks are trimmed and joined by one space.

Distribution: a pass of Arrow batches reads shapes and hashes of texts; these small rows are counted per host with partial
aggregation (a hot host is no hot task); the templates, slots and hashes with the reference of each host, join the pages again, broadcast if few.

Defined results: null html and pages without content give an empty text; a null or odd url is the host ``''``; broken markup
is read as far as it goes (unclosed elements end with their parent, unknown end tags are passed over); repeated rows repeat
results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, fits, memo

SHARE, LEAST_PAGES, DEPTH = 0.6, 5, 100

# Element names of HTML by their part in layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object select".split())
BLOCK = frozenset("html head body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main "
                  "menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: An opening element ends an open one of these, up to the given boundary.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
DROP_TAGS = frozenset("head nav footer aside form button menu dialog fieldset input label".split()) | RAW
CUES = frozenset("nav navbar navigation menu header masthead footer sidebar aside ad ads adv advert adverts advertisement sponsor sponsored banner promo cookie cookies consent gdpr notice alert popup modal overlay newsletter "
                 "subscribe subscription signup login form search comment comments commentlist respond reply replies disqus discussion share sharing social related recommended breadcrumb breadcrumbs pagination pager widget toolbar "
                 "copyright complementary contentinfo".split())
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: A header of these, or of nothing, is the page's; other headers (article-header) are part of what they name.
SITE = frozenset("site page top main global web blog".split())
#: Reader comments and adverts, wherever they stand.
READERS = frozenset("comments commentlist responses replies respond disqus".split())
ADVERTS = frozenset("ad ads adv advert adverts advertisement sponsor sponsored".split())
NEGATIONS = frozenset("has with no is without".split())
#: With these, "comment" names a list of comments; with others (comment-text) it may be a note of the article.
COMMENTS = frozenset("list area section form thread wrap wrapper container box body content".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td dd dt figcaption".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.S)
#: One attribute after the other: the name, then its value is consumed with it.
_ATTR = re.compile(r"""([^\s"'/=<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?|"[^"]*"|'[^']*'""")
_INVISIBLE = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _level(parts: list[str]) -> int:
    """Of a word of class, id or role: 3 is never content (reader comments, adverts), 2 neither unless it encloses the article, 1 can be
    content inside an article only, 0 says nothing."""
    if NEGATIONS.intersection(parts):
        return 0
    if parts[-1] in READERS or parts[-1] in ADVERTS or parts[0] in ("comment", "comments") and parts[-1] in COMMENTS:
        return 3
    if parts[-1] in ("header", "masthead"):
        return int(SITE.issuperset(parts[:-1]))
    if parts[-1] in CUES:
        return 1 if parts[-1] == "discussion" else 2
    if len(parts) > 2:
        return 0
    if parts[0] in ("comment", "comments"):
        return 1
    return 2 if parts[0] in ("ad", "ads", "advert", "cookie") else int(parts[0] in ("sidebar", "footer", "nav", "menu"))


@memo
def _cue(attrs: str) -> tuple[bool, int, int, bool, str]:
    """(hidden, level by class and role, level by id, main, label part)."""
    hidden = main = False
    level = {"class": 0, "role": 0, "id": 0}
    label = []
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "style":
            hidden = hidden or _INVISIBLE.search(value) is not None
            continue
        if name not in ("class", "id", "role", "hidden", "aria-hidden"):
            continue
        if name == "hidden" or name == "aria-hidden":
            hidden = hidden or value.lower() != "false"
            continue
        for word in value.split():
            parts = [p.lower() for p in _PART.findall(word)]
            if not parts:
                continue
            label.append("-".join(parts))
            level[name] = max(level[name], _level(parts))
            main = main or name == "role" and value.lower() == "main"
    return hidden, max(level["class"], level["role"]), level["id"], main, ".".join(label)


#: Why an element is no content: not at all, a form, a layout word, for certain.
KEPT, FORM, LAYOUT, GONE = range(4)
#: Layout elements whose articles are teasers or remarks, not the page's article.
ASIDE = DROP_TAGS - {"form", "fieldset", "label"}


def _dropped(tag: str, attrs: tuple, inside: bool) -> int:
    """Do the element's name, class, role and id say that it is no content? ``inside``: of a marked article."""
    hidden, by_class, by_id, _, _ = attrs
    if tag in ASIDE or tag == "header" and not inside:
        return GONE
    if tag in ("html", "body", "main"):
        return KEPT
    if hidden or by_class == 3 or by_id == 3 and tag not in HEADINGS and tag not in TEXTUAL:
        return GONE
    if tag in DROP_TAGS:
        return FORM
    if tag in HEADINGS or inside and (tag not in BLOCK or tag in TEXTUAL):
        return KEPT
    level = by_class if tag == "section" or tag in TEXTUAL else max(by_class, by_id)
    return LAYOUT if min(level, 2) > int(inside) else KEPT


class Element:
    __slots__ = ("tag", "label", "drop", "main", "shape", "enclosed")

    def __init__(self, tag, label, drop, main, shape, enclosed=False):
        self.tag, self.label, self.drop, self.main, self.shape, self.enclosed = tag, label, drop, main, shape, enclosed


class Shape:
    __slots__ = ("label", "kids", "slot")

    def __init__(self, label):
        self.label, self.kids, self.slot = label, [], 0


class Block:
    """Text of a block element between block borders."""

    __slots__ = ("shape", "text", "drop", "main", "textual", "enclosed")

    def __init__(self, shape, text, drop, main, textual, enclosed):
        self.shape, self.text, self.drop, self.main, self.textual, self.enclosed = shape, text, drop, main, textual, enclosed


def content(blocks: list[Block]) -> list[Block]:
    """The blocks of a page that can be content: its marked articles, those a layout word encloses only if there are no others; without
    marks all that is not dropped; of a page that is one form, the form's paragraphs."""
    kept = [b for b in blocks if b.drop == KEPT]
    for some in ([b for b in kept if b.main and not b.enclosed], [b for b in kept if b.main], kept):
        if some:
            return some
    return [b for b in blocks if b.drop == FORM and b.textual]


def read(html: str) -> tuple[Shape, list[Block]]:
    """The tree of block elements and the blocks of text, in page order."""
    root = Shape("page")
    stack = [Element("", "", KEPT, False, root)]
    blocks: list[Block] = []
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                top = stack[-1]
                blocks.append(Block(top.shape, text, top.drop, top.main, top.tag in TEXTUAL, top.enclosed))

    def close(depth: int) -> None:
        flush()
        del stack[depth:]

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            parts.append(html[at:])
            break
        if m.start() > at:
            parts.append(html[at:m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
            else:
                if tag in BLOCK:
                    flush()
            continue
        if tag in RAW:
            if m[3].endswith("/"):
                continue
            end = _END[tag].search(html, at)
            if end:
                at = end.end()
                continue
            if tag in ("script", "style"):
                break  # what follows is no markup
            # any other is dropped as an element and ends with its parent
        if tag in VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        attrs = _cue(m[3]) if m[3] else (False, 0, 0, False, "")
        main, label = attrs[3:]
        block = tag in BLOCK
        if block:
            flush()
            if stack[-1].tag == "p":
                close(len(stack) - 1)
            closes, until = ENDS.get(tag, ((), ()))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closes:
                    close(i)
                elif stack[i].tag in until:
                    break
        top = stack[-1]
        drop = _dropped(tag, attrs, top.main)
        marked = not drop and (tag in MAIN or main)
        # an article is not dropped with a layout word or form around it
        revived = marked and top.drop in (FORM, LAYOUT)
        if not block and not drop:
            continue
        shape = top.shape
        if block and len(stack) < DEPTH:
            shape = Shape(f"{tag}.{label}" if label else tag)
            top.shape.kids.append(shape)
        if not block:
            flush()
        if m[3].endswith("/"):
            continue
        stack.append(Element(tag, label, KEPT if revived else max(top.drop, drop), not drop and (top.main or marked), shape, top.enclosed or revived))
    flush()
    return root, blocks


def merged(root: Shape) -> str:
    """The shape as text, equal neighbours merged; numbers the slots of the merged tree in the shapes."""
    names: dict[int, str] = {}

    def groups(shape: Shape) -> list[list[Shape]]:
        out: list[list[Shape]] = []
        for kid in shape.kids:
            if out and names[id(out[-1][0])] == names[id(kid)]:
                out[-1].append(kid)
            else:
                out.append([kid])
        return out

    def name(shape: Shape) -> str:
        for kid in shape.kids:
            name(kid)
        inner = ",".join(names[id(g[0])] for g in groups(shape))
        names[id(shape)] = f"{shape.label}({inner})" if inner else shape.label
        return names[id(shape)]

    count = 0

    def number(members: list[Shape]) -> None:
        nonlocal count
        for s in members:
            s.slot = count
        count += 1
        for same in zip(*(groups(s) for s in members), strict=True):
            number([s for g in same for s in g])

    text = name(root)
    number([root])
    return text


def tree(text: str) -> tuple:
    """(label, slot, kids, name) of a merged shape; equal subtrees have equal names."""
    slots = iter(range(len(text) + 1))
    names: dict[tuple, int] = {}
    stack: list[list] = [[]]
    open_: list[list] = []

    def named(node: list) -> tuple:
        return (node[0], node[1], node[2], names.setdefault((node[0], tuple(k[3] for k in node[2])), len(names)))

    last = None
    for word in [*re.findall(r"[^(),]+|[()]", text), ""]:
        if word == "(":
            open_.append(last)
            stack.append(last[2])
            last = None
            continue
        if last is not None:
            stack[-1].append(named(last))
        last = None
        if word == ")":
            stack.pop()
            last = open_.pop()
        elif word:
            last = [word, next(slots), []]
    return stack[0][0]


def match(a: tuple, b: tuple) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: size and pairs (slot of a, slot of b) of the largest match of equal roots. The trees' names are made one by
    the label and the names of the children, so equal subtrees match slot by slot without a search."""
    known: dict[tuple, tuple] = {}
    both: dict[tuple, int] = {}

    def renamed(node: tuple) -> tuple:
        kids = [renamed(k) for k in node[2]]
        key = (node[0], tuple(k[3] for k in kids))
        return node[0], node[1], kids, both.setdefault(key, len(both)), 1 + sum(k[4] for k in kids)

    def equal(u: tuple, v: tuple) -> list[tuple[int, int]]:
        return [(u[1] + i, v[1] + i) for i in range(u[4])]  # slots are numbered in the order of the tree

    def matched(u: tuple, v: tuple) -> tuple[int, list[tuple[int, int]]]:
        """Pairs are offsets from the two roots' slots."""
        if u[0] != v[0]:
            return 0, []
        if u[3] == v[3]:
            return u[4], [(i, i) for i in range(u[4])]
        if (u[3], v[3]) not in known:
            known[u[3], v[3]] = aligned(u, v)
        return known[u[3], v[3]]

    def aligned(u: tuple, v: tuple) -> tuple[int, list[tuple[int, int]]]:
        x, y = u[2], v[2]
        ends = min(len(x), len(y))
        head = next((i for i in range(ends) if x[i][3] != y[i][3]), ends)
        tail = next((i for i in range(ends - head) if x[-1 - i][3] != y[-1 - i][3]), ends - head)
        pairs = [(0, 0)]
        for s, t in [*zip(x[:head], y[:head], strict=True), *zip(x[len(x) - tail:], y[len(y) - tail:], strict=True)]:
            pairs += [(i - u[1], j - v[1]) for i, j in equal(s, t)]
        x, y = x[head:len(x) - tail], y[head:len(y) - tail]
        if not x or not y:
            return len(pairs), pairs
        # subtrees by kind: the weight of a pair depends on the two kinds only, and is 0 unless the labels agree
        kinds = [{k[3]: k for k in side} for side in (x, y)]
        places = [{name: i for i, name in enumerate(side)} for side in kinds]
        weight = np.zeros((len(kinds[0]), len(kinds[1])), np.int32)
        labels: dict[str, list[tuple]] = {}
        for t in kinds[1].values():
            labels.setdefault(t[0], []).append(t)
        for s in kinds[0].values():
            for t in labels.get(s[0], ()):
                weight[places[0][s[3]], places[1][t[3]]] = matched(s, t)[0]
        px, py = (np.array([where[k[3]] for k in side]) for side, where in zip((x, y), places, strict=True))
        m, n = len(x), len(y)
        step = max(1, math.isqrt(m))

        def rows(first: np.ndarray, lo: int, hi: int) -> Iterator[np.ndarray]:
            """Rows ``lo`` + 1 to ``hi`` of the recurrence after row ``lo``: the larger of up, left, and slant with the pair."""
            row = first
            for i in range(lo, hi):
                best = row.copy()
                np.maximum(best[1:], row[:-1] + weight[px[i], py], out=best[1:])
                row = np.maximum.accumulate(best)
                yield row

        kept = [np.zeros(n + 1, np.int32)]
        for i, row in enumerate(rows(kept[0], 0, m), 1):
            if i % step == 0:
                kept.append(row)
        i, j = m, n
        while i and j:
            lo = (i - 1) // step * step
            size = [kept[lo // step], *rows(kept[lo // step], lo, i)]
            while i > lo and j:
                here, above = size[i - lo], size[i - lo - 1]
                got = int(weight[px[i - 1], py[j - 1]])
                if got and here[j] == above[j - 1] + got:
                    inner = matched(x[i - 1], y[j - 1])[1]
                    pairs += [(x[i - 1][1] - u[1] + p, y[j - 1][1] - v[1] + q) for p, q in inner]
                    i, j = i - 1, j - 1
                elif here[j] == above[j]:
                    i -= 1
                else:
                    j -= 1
        return len(pairs), pairs

    a, b = renamed(a), renamed(b)
    size, pairs = matched(a, b)
    return size, [(a[1] + i, b[1] + j) for i, j in pairs]


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def host(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit(""))


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shapes, whole, slots, texts = [], [], [], []
        for html in batch.column(1):
            root, blocks = read(html.as_py() or "")
            shapes.append(merged(root))
            blocks = content(blocks)
            whole.append(_hash("\n".join(b.text for b in blocks)))
            found = sorted({(b.shape.slot, _hash(b.text)) for b in blocks if not (b.main and b.textual)})
            slots.append([s for s, _ in found])
            texts.append([t for _, t in found])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shapes, pa.string()), pa.array(whole, pa.int64()), pa.array(slots, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.int64()))],
                                         ["host", "shape", "page", "slots", "texts"])


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns host, shape, reference: where the slots of a shape are in the reference."""
    for batch in batches:
        maps = []
        for shape, reference in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            maps.append(sorted(match(tree(shape), tree(reference))[1]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([[p for p, _ in m] for m in maps], pa.list_(pa.int32())), pa.array([[q for _, q in m] for m in maps], pa.list_(pa.int32()))],
                                         ["host", "shape", "own", "ref"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, reference, slots, texts): the shape that slots are numbered by, the slots and hashes of the texts that are template on
    a host. ``pages``: host, html."""
    seen = cut(pages.select("host", "html").mapInArrow(_shapes, "host string, shape string, page long, slots array<int>, texts array<long>"))
    seen = cut(seen.groupBy("host", "page").agg(F.min(F.struct("shape", "slots", "texts")).alias("p")).select("host", "p.*"))
    count = cut(seen.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n")))
    hosts = count.groupBy("host").agg(F.sum("n").alias("pages"), F.max_by("shape", F.struct("n", "shape")).alias("reference")).where(F.col("pages") >= LEAST_PAGES)
    aligned = count.join(hosts, "host").select("host", "shape", "reference").mapInArrow(_align, "host string, shape string, own array<int>, ref array<int>")
    aligned = aligned.select("host", "shape", F.map_from_arrays("own", "ref").alias("at"))
    one = seen.where(F.size("texts") > 0).join(aligned, ["host", "shape"]).select("host", "at", F.explode(F.arrays_zip("slots", "texts")).alias("x"))
    slots = one.select("host", F.col("at")[F.col("x.slots")].alias("slot"), F.col("x.texts").alias("text")).where("slot is not null")
    same = slots.groupBy("host", "slot", "text").agg(F.count(F.lit(1)).alias("n")).join(hosts.select("host", "pages"), "host").where(F.col("n") >= SHARE * F.col("pages"))
    found = same.groupBy("host").agg(F.sort_array(F.collect_set(F.struct("slot", "text"))).alias("t"))
    return found.join(hosts, "host").select("host", "reference", F.col("t.slot").alias("slots"), F.col("t.text").alias("texts"))


@memo
def _places(shape: str, reference: str) -> dict[int, int]:
    """Slots of a shape: those of the reference."""
    return dict(match(tree(shape), tree(reference))[1])


def main_text(html: str | None, template: frozenset[tuple[int, int]] = frozenset(), reference: str = "") -> str:
    """Text of a page without ``template``: (slot of the reference, hash of the text)."""
    if not html:
        return ""
    root, blocks = read(html)
    at = _places(merged(root), reference) if template else {}
    return " ".join(b.text for b in content(blocks) if not template or b.main and b.textual or (at.get(b.shape.slot), _hash(b.text)) not in template)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("reference", "slots", "texts")]
        out = [main_text(h.as_py(), frozenset(zip(s or (), t or (), strict=True)), r or "") for h, r, s, t in zip(batch["html"], *columns, strict=True)]
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(out, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of ``pages`` (page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host(F.col("url")).alias("host"))
    known = cut(templates(pages))
    letters = known.agg(F.sum(F.length("reference"))).first()[0] or 0
    known = F.broadcast(known) if letters <= 8 * BROADCAST_ROWS and fits(known, cells="texts") else known
    return pages.join(known, "host", "left").select("page_id", "url", "html", "reference", "slots", "texts").mapInArrow(_extract, "page_id long, url string, text string")
