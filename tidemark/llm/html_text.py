"""Main text of web pages by wrapper induction.

A page becomes a tree of its block elements; three or more like siblings in a
row are one repeated node. Of each host the most common tree is the reference.
Every page's tree is aligned with it by simple tree matching (dynamic
programming over the children of equally labelled nodes), and what the pages
have at each node is added up: constant texts are template, varying slots are
content. The slot to read is found by going down from the root as long as one
child holds most of the varying text outside links; an article or main element
and class names count there as votes, they don't decide. Pages that lack the
slot are their own template.

Within the slot, parts that HTML itself names (nav, footer, aside, form,
script, an article within the article and the like) are left out, so are texts
that half of the host's pages (three at least) have at that node, and parts
whose class or id has no other words than those of boilerplate. The last two
stand where they hold most of the page's slot, as in near copies of a page.

The sums are over distinct pages of all of a host, whatever their order; no
task gathers a host. Nothing here recurs, so trees may be as deep as pages are
long; they travel as flat lists of depth, label and texts. The parser's time grows
with a page's length (times the logarithm of its depth, for elements that a block
closes), whatever is left open, closed without being open, or quoted.

Null and empty pages give the empty text. Every row gives one row; repeated
rows count once in the template. Pages without an url share the empty host.
"""

import hashlib
import html
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textkit import cut

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>\"']*+(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*+)*+)>", re.DOTALL)
_NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([A-Za-z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([A-Za-z_:-]+)")
_WORDS = re.compile(r"[A-Za-z]+")

# Elements by kind, as the HTML standard has them, and which of them hold no article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
DROPPED = frozenset("head nav footer aside form script style noscript iframe button select textarea template dialog menu svg math canvas audio video object label fieldset input title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a new one of these closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Where that search ends.
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Words of a class or id that say what a part is, if it has no others than these and those below.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion menu nav navbar navigation navi breadcrumb breadcrumbs footer sidebar aside widget widgets cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup share sharing social related recommended recommendations comment comments disqus replies respond pagination pager toolbar masthead login search copyright disclaimer skip".split()
)
GENERIC = frozenset("area bar block box button buttons container content entry form group header inner item items link links list outer panel post posts row section text title top bottom left right main wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: A header's headings may belong to the article.
HEADER = frozenset(["header"])
#: Elements whose runs are one node from the first repetition on.
FLOW = frozenset("p li dt dd tr td th option blockquote pre".split())
#: A text is template if so many of the host's pages, and such a share of those with text at the node, have it.
LEAST_PAGES, SHARE = 3, 0.5
#: Template texts, and parts with names of boilerplate, that hold such a share of a page's slot are its content after all.
MOST_TEMPLATE, MOST_DOUBT = 0.75, 0.5
#: Share of the varying text that may stand directly in nodes around the slot; where more does, the slot is the first of them.
MOST_LOST = 0.1
#: Largest sum of wrappers, in bytes, that is sent to all tasks; beyond it pages are joined by host.
BROADCAST = 16 << 20


class Place:
    """A block element of a page, by way of the one around it; depth 0 is outside all."""

    __slots__ = ("above", "label", "depth")

    def __init__(self, above: "Place | None", label: str) -> None:
        self.above, self.label, self.depth = above, label, above.depth + 1 if above else 0


class Block(NamedTuple):
    place: Place
    text: str
    links: int  #: characters in links
    doubt: bool  #: in a part that its class or id calls boilerplate


class Element(NamedTuple):
    tag: str
    kind: str
    place: Place  #: its own, if it is a block element, else that of the block around it


class Tags:
    """The tags of a page, from any `<`. Quoted values may hold `>`; where quotes don't come out, a tag ends at the first `>`."""

    def __init__(self, page: str) -> None:
        self.page, self.last = page, page.rfind(">")
        self.broken: set[int] = set()  #: opening quotes from which no end of a tag is met
        self.plain = True

    def at(self, start: int) -> tuple[int, str, str, str] | None:
        """Where the mark-up at `start` ends; the slash, name and attributes of a tag (else empty)."""
        page = self.page
        if start > self.last and page[start + 1 : start + 2] not in ("!", "?"):
            return None
        if (self.plain or page[start + 1 : start + 2] in ("!", "?")) and (m := _TOKEN.match(page, start)):
            return m.end(), m[1] or "", m[2] or "", m[3] or ""
        if not (m := _NAME.match(page, start)):
            return None
        self.plain = False
        end = self._quoted(m.end())
        if end < 0:
            end = page.find(">", m.end())
        return end + 1, m[1], m[2], page[m.end() : end]

    def _quoted(self, at: int) -> int:
        """The first `>` outside quotes, or -1. No opening quote is tried twice."""
        tried = []
        while (m := _STOP.search(self.page, at)) and m.start() not in self.broken:
            if m[0] == ">":
                return m.start()
            tried.append(m.start())
            at = self.page.find(m[0], m.end()) + 1
            if not at:
                break
        self.broken.update(tried)
        return -1


def describe(tag: str, attributes: str) -> tuple[str, str]:
    """A label for alignment, and the kind of part: drop, doubt, header, article or plain."""
    if not attributes.strip("/ \t\r\n"):
        tokens, role, hidden, label = [], "", False, tag
    else:
        a = {(m[1] or m[5]).lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
        names = [re.sub(r"([a-z])([A-Z])", r"\1 \2", n) for n in f"{a.get('class', '')} {a.get('id', '')}".split()]
        tokens = [frozenset(w.lower() for w in _WORDS.findall(n)) for n in names]
        role = a.get("role", "").lower()
        hidden = "hidden" in a or a.get("aria-hidden", "") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
        label = tag + "".join(f".{w}" for w in sorted(frozenset().union(*tokens)))
    if tag in DROPPED or hidden or role in ROLES:
        return label, "drop"
    if tag not in ("html", "body", "article", "main") and any(t & BOILERPLATE and t <= BOILERPLATE | GENERIC for t in tokens):
        return label, "doubt"
    if tag in ("article", "main") or role in ("main", "article"):
        return label, "article"
    if tag == "header" or tag not in ("html", "body") and any(t == HEADER for t in tokens):
        return label, "header"
    return label, "plain"


described = lru_cache(1 << 12)(describe)


def blocks(page: str | None) -> list[Block]:
    """Blocks of text outside dropped parts, in page order. Unclosed and misnested elements are borne with."""
    out: list[Block] = []
    if not page:
        return out
    stack: list[Element] = []
    open_: dict[str, list[int]] = {}  # where in the stack elements of each tag stand
    walls: list[int] = []  # and block elements other than paragraphs
    kinds = {"drop": 0, "doubt": 0, "header": 0, "article": 0, "plain": 0}
    parts: list[str] = []
    outside = Place(None, "")
    headings = links = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = parts[0] if len(parts) == 1 else "".join(parts)
            parts.clear()
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append(Block(stack[-1].place if stack else outside, text, min(links, len(text)), kinds["doubt"] > 0))
        links = 0

    def close(depth: int) -> None:
        nonlocal headings
        while len(stack) > depth:
            e = stack.pop()
            open_[e.tag].pop()
            if walls and walls[-1] == len(stack):
                walls.pop()
            kinds[e.kind] -= 1
            headings -= e.tag in HEADINGS

    def top(tag: str) -> int:
        return open_[tag][-1] if open_.get(tag) else -1

    def ended(tag: str) -> int | None:
        """Where the outermost element stands that a new block ends: an open paragraph, or what list items and cells end."""
        if tag not in CLOSES:  # of paragraphs one at most is open within the nearest wall
            return i if (i := top("p")) > (walls[-1] if walls else -1) else None
        fence = max(map(top, FENCE[tag]))
        found = [places[i] for t in CLOSES[tag] | {"p"} if (places := open_.get(t)) and (i := bisect_right(places, fence)) < len(places)]
        return min(found, default=None)

    tags = Tags(page)
    at, n = 0, len(page)
    while at < n:
        m, upto = None, at
        while (upto := page.find("<", upto)) >= 0 and not (m := tags.at(upto)):
            upto += 1
        if not m:
            upto = n
        if upto > at and not kinds["drop"] and (not kinds["header"] or headings and kinds["article"]):
            parts.append(page[at:upto])
            links += (upto - at) * bool(open_.get("a"))
        if not m:
            break
        at, slash, tag, attributes = m
        tag = tag.lower()
        if not tag:
            continue
        if slash:
            if tag in VOID:
                continue
            depth = top(tag)
            if depth < 0:
                if tag == "p":
                    flush()
                continue
            if max(top("p"), walls[-1] if walls else -1) >= depth:
                flush()
            close(depth)
            continue
        if tag == "br":
            if parts:
                parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if (end := ended(tag)) is not None:
                close(end)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            m = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
            at = m.end() if m else n
            continue
        label, kind = described(tag, attributes) if len(attributes) < 200 else describe(tag, attributes)
        if tag == "article" and open_.get("article"):  # what HTML calls related to the one around it: teasers, readers' comments
            kind = "drop"
        elif kind in ("article", "header") and tag not in BLOCK:
            kind = "plain"
        around = stack[-1].place if stack else outside
        open_.setdefault(tag, []).append(len(stack))
        if tag in BLOCK and tag != "p":
            walls.append(len(stack))
        stack.append(Element(tag, kind, Place(around, label) if tag in BLOCK else around))
        kinds[kind] += 1
        headings += tag in HEADINGS
    flush()
    return out


def key(text: str) -> int:
    """Tells whole texts apart; never 0."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) or 1


# A tree node: [label, children, the numbers of its blocks]. A flat tree: depth, label and more of each node, from the root down.


def tree(found: list[Block]) -> list:
    """The tree of a page's blocks."""
    root: list = ["", [], []]
    open_: list[tuple[Place | None, list]] = [(None, root)]
    for i, b in enumerate(found):
        new, p = [], b.place
        while p.depth and (p.depth >= len(open_) or open_[p.depth][0] is not p):
            new.append(p)
            p = p.above
        del open_[p.depth + 1 :]
        for p in reversed(new):
            above = open_[-1][1][1]
            if not above or above[-1][0] != p.label or p.label.split(".")[0] not in FLOW:
                above.append([p.label, [], []])
            open_.append((p, above[-1]))
        open_[-1][1][2].append(i)
    return _folded(root)


def _folded(root: list) -> list:
    """Three or more like siblings in a row become one repeated node."""
    for node in reversed(list(_nodes(root))):  # children come before their parents
        children: list = []
        for _, run in groupby(node[1], key=itemgetter(0)):
            like = list(run)
            children += [_united(like)] if len(like) > 2 else like
        node[1] = children
    return root


def _united(nodes: list) -> list:
    """One node for a run of like ones: the children by label."""
    root: list = [nodes[0][0], [], []]
    todo = [(root, nodes)]
    while todo:
        one, many = todo.pop()
        one[2] = [i for n in many for i in n[2]]
        by_label: dict[str, list] = {}
        for n in many:
            for c in n[1]:
                by_label.setdefault(c[0], []).append(c)
        one[1] = [c[0] if len(c) == 1 else [label, [], []] for label, c in by_label.items()]
        todo += [(x, c) for x, c in zip(one[1], by_label.values(), strict=True) if len(c) > 1]
    return root


def flat(root: list, found: list[Block] | None = None) -> list:
    """The flat tree; with found, also key and length outside links of each node's texts."""
    out = []
    todo = [(0, root)]
    while todo:
        depth, node = todo.pop()
        out.append([depth, node[0]] if found is None else [depth, node[0], [(key(found[i].text), len(found[i].text) - found[i].links) for i in node[2]]])
        todo += [(depth + 1, c) for c in reversed(node[1])]
    return out


def nested(rows: list) -> list:
    """The tree of a flat one."""
    open_: list[list] = []
    for depth, label, *texts in rows:
        del open_[depth:]
        node = [label, [], texts[0] if texts else []]
        if open_:
            open_[-1][1].append(node)
        open_.append(node)
    return open_[0]


def matching(a: list, b: list) -> list[tuple[list, list]]:
    """Simple tree matching of two nodes of equal label: the pairs of nodes of the largest match that keeps order and ancestors."""
    tables: dict[tuple[int, int], tuple[int, list[list[int]]]] = {}
    alike = [(a, b)]  # parents before their children
    for x, y in alike:
        by_label: dict[str, list] = {}
        for d in y[1]:
            by_label.setdefault(d[0], []).append(d)
        alike += [(c, d) for c in x[1] for d in by_label.get(c[0], ())]
    for x, y in reversed(alike):
        best = [[0] * (len(y[1]) + 1)]
        for c in x[1]:
            above, row = best[-1], [0]
            for j, d in enumerate(y[1]):
                m = max(above[j + 1], row[j])
                if c[0] == d[0]:
                    m = max(m, above[j] + tables[id(c), id(d)][0])
                row.append(m)
            best.append(row)
        tables[id(x), id(y)] = 1 + best[-1][-1], best
    pairs: list[tuple[list, list]] = []
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        best = tables[id(x), id(y)][1]
        i, j = len(x[1]), len(y[1])
        while i and j:
            c, d = x[1][i - 1], y[1][j - 1]
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                todo.append((c, d))
                i, j = i - 1, j - 1
    return pairs


def numbered(node: list) -> dict[int, int]:
    """The number of each node of a tree, from the root down, by identity."""
    out: dict[int, int] = {}
    todo = [node]
    while todo:
        x = todo.pop()
        out[id(x)] = len(out)
        todo += reversed(x[1])
    return out


def slot(node: list, mass: dict[int, float]) -> int:
    """The number of the node to read. mass: how much varying text outside links each node has itself. Marks weigh double and class names of boilerplate a tenth."""
    number = numbered(node)

    def vote(label: str) -> float:
        tag, *names = label.split(".")
        if names and set(names) & BOILERPLATE and set(names) <= BOILERPLATE | GENERIC:
            return 0.1
        return 2.0 if tag in ("article", "main") or "article" in names else 1.0

    weight: dict[int, float] = {}
    for x in reversed(list(_nodes(node))):  # children come before their parents
        weight[id(x)] = vote(x[0]) * (mass.get(number[id(x)], 0.0) + sum(weight[id(c)] for c in x[1]))
    lost, held = 0.0, node  # text left on the way down, and where that began
    while node[1]:
        top = max(node[1], key=lambda c: weight[id(c)])
        if not top[1] or weight[id(top)] < 0.7 * (mass.get(number[id(node)], 0.0) + sum(weight[id(c)] for c in node[1])):
            break
        held = held if lost else node
        lost += mass.get(number[id(node)], 0.0)
        node = top
    return number[id(held if lost > MOST_LOST * sum(mass.values()) else node)]


def _nodes(node: list) -> Iterator[list]:
    todo = [node]
    while todo:
        x = todo.pop()
        yield x
        todo += reversed(x[1])


class Wrapper(NamedTuple):
    reference: list
    slot: int
    constant: frozenset[tuple[int, int]]  #: node and key of each template text


def wrapper(reference: str, sums: list) -> Wrapper:
    """sums: node, mass, keys of template texts."""
    node = nested(json.loads(reference))
    return Wrapper(node, slot(node, {s["node"]: s["mass"] for s in sums}), frozenset((s["node"], k) for s in sums for k in s["keys"] or ()))


def own_mass(number: dict[int, int], node: list, found: list[Block]) -> dict[int, float]:
    return {number[id(x)]: float(sum(len(found[i].text) - found[i].links for i in x[2])) for x in _nodes(node) if x[2]}


def extract(page: str | None, known: Wrapper | None) -> str:
    """The page's main text."""
    found = blocks(page)
    if not found:
        return ""
    own = tree(found)
    number = numbered(own)
    constant: set[int] = set()
    top = None
    if known:
        names = numbered(known.reference)
        for x, y in matching(known.reference, own):
            n = names[id(x)]
            if n == known.slot:
                top = y
            constant.update(i for i in y[2] if (n, key(found[i].text)) in known.constant)
    if top is None or not any(x[2] for x in _nodes(top)):
        at = slot(own, own_mass(number, own, found))
        top = next(x for x in _nodes(own) if number[id(x)] == at)
    within = sorted(i for x in _nodes(top) for i in x[2])
    total = sum(len(found[i].text) for i in within)
    for doubted, most in ((constant, MOST_TEMPLATE), ({i for i in within if found[i].doubt}, MOST_DOUBT)):
        if sum(len(found[i].text) for i in within if i in doubted) < most * total:
            within = [i for i in within if i not in doubted]
    return "\n\n".join(found[i].text for i in within)


def host(url: str) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _trees(pages: DataFrame) -> DataFrame:
    """host, shape and tree (with keys and lengths of texts) of each page, as JSON."""
    schema = pa.schema([("host", pa.string()), ("shape", pa.string()), ("tree", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shapes, trees = [], []
            for page in b.column(1):
                found = blocks(page.as_py())
                t = tree(found)
                shapes.append(json.dumps(flat(t), separators=(",", ":")))
                trees.append(json.dumps(flat(t, found), separators=(",", ":")))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shapes, pa.string()), pa.array(trees, pa.string())], schema=schema)

    return pages.select(host("url").alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(run, "host string, shape string, tree string")


def _texts(rows: DataFrame) -> DataFrame:
    """rows: host, tree, reference. Of each page the texts at the reference's nodes: host, node, key, n, length; with key 0 once a page and node."""
    schema = pa.schema([("host", pa.string()), ("node", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple[str, int, int], list[int]] = {}
            for name, page, reference in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                ref = nested(json.loads(reference))
                names = numbered(ref)
                for x, y in matching(ref, nested(json.loads(page))):
                    if y[2]:
                        for k, length in [(0, 0), *dict.fromkeys(map(tuple, y[2]))]:
                            row = sums.setdefault((name, names[id(x)], k), [0, 0])
                            row[0] += 1
                            row[1] += length
            keys = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], schema.types[i]) for i in range(3)] + [pa.array([sums[k][i] for k in keys], pa.int64()) for i in range(2)], schema=schema)

    return rows.select("host", "tree", "reference").mapInArrow(run, "host string, node int, key long, n long, length long")


def wrappers(pages: DataFrame) -> DataFrame:
    """host, reference (its most common tree) and sums: node, mass of varying text, keys of template texts."""
    trees = cut(_trees(pages).groupBy("host", F.xxhash64("tree").alias("copy"), "tree").agg(F.min("shape").alias("shape")))
    shapes = trees.groupBy("host", "shape").agg(F.count("*").alias("n"))
    references = shapes.groupBy("host").agg(F.max_by("shape", F.struct("n", F.length("shape"), "shape")).alias("reference"))
    texts = cut(_texts(trees.join(references, "host")).groupBy("host", "node", "key").agg(F.sum("n").alias("n"), F.sum("length").alias("length")))
    nodes = texts.groupBy("host", "node").agg(F.sum(F.when(F.col("key") == 0, F.col("n"))).alias("pages"), F.sum("length").alias("length"))
    often = texts.where((F.col("key") != 0) & (F.col("n") >= LEAST_PAGES)).join(nodes.select("host", "node", "pages"), ["host", "node"]).where(F.col("n") >= SHARE * F.col("pages"))
    often = often.groupBy("host", "node").agg(F.collect_list("key").alias("keys"), F.sum("length").alias("constant"))
    each = nodes.join(often, ["host", "node"], "left").withColumn("mass", (F.col("length") - F.coalesce("constant", F.lit(0))).cast("double"))
    return each.groupBy("host").agg(F.collect_list(F.struct("node", "mass", "keys")).alias("sums")).join(references, "host")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Wrapper] = {}
        for b in batches:
            texts = []
            for page, name, reference, sums in zip(b.column(2), b.column(3).to_pylist(), b.column(4), b.column(5), strict=True):
                if name not in held and reference.is_valid:
                    if len(held) > 1000:
                        held.clear()
                    held[name] = wrapper(reference.as_py(), sums.as_py())
                texts.append(extract(page.as_py(), held.get(name)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=out)

    known = cut(wrappers(pages))
    size = known.agg(F.sum(F.octet_length("reference") + F.size("sums") * 32)).first()[0] or 0
    made = pages.withColumn("host", host("url")).join(F.broadcast(known) if size <= BROADCAST else known, "host", "left").select("page_id", "url", "html", "host", "reference", "sums")
    return made.mapInArrow(run, "page_id long, url string, text string, n_chars long")
