"""HTML extraction by wrapper induction.

Every page of a host counts. Pages whose trees have mostly the same label paths
are one layout, and the richest tree of a layout is its seed. Every page is
aligned with its layout's seed by simple tree matching: the largest set of node
pairs that keeps parents and order. Runs of equal siblings are one node of the
tree, so that lists of any length align. A seed node that has one text in at
least ``share`` of the layout's articles is template; any other is a slot. A
page's template nodes give no text, nor do elements that HTML or their names
say to be navigation, page headers, footers, sidebars, notices, adverts, forms
or reader comments. If a page has articles (or else a main element), its text
is theirs; if not, its body's.

Inside an article only a whole node is template, never one line of a list, so
lines that many articles share stay in each.

Pages with one title are versions of one article, whose text would pass for
template, and count as one.

Rows: null and empty pages give an empty text; pages are taken whole, whatever
their length and number of nodes; pages without a host, and layouts with fewer
than ``least`` pages or articles, have no wrapper and go by names alone; repeated rows
give repeated results; an empty table gives an empty result; other columns
don't matter.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import durable, ship

LEAST, SHARE = 4, 0.8
#: A slot with so much of its text in links, and so many links on average, may be a menu.
LINKS, SEVERAL = 0.9, 2
LISTS = frozenset("ul ol menu dl div section table".split())
#: Pages with so much of their label paths in common have one layout.
ALIKE = 0.5
#: Numbers of a table of matches that are held at once; the others are computed again.
HELD = 1 << 22
#: Elements opened deeper than this have no children; what they hold follows them, as in browsers.
DEEPEST = 512
BROADCAST_BYTES = 32 << 20
#: Sets of paths that are clustered at once, and hosts up to which a row each is broadcast.
AT_ONCE, FEW_HOSTS = 2000, 200_000

# Element names as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes plaintext".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table caption colgroup tbody td tfoot th thead tr ul".split()
)
#: Elements whose start ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: Elements that end an open one of their kinds, up to the container named last.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)),
    "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tr", "td", "th", "tbody", "thead", "tfoot"), ("table",)),
    "thead": (("tr", "td", "th", "tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tr", "td", "th", "tbody", "thead", "tfoot"), ("table",)),
}
#: Formatting elements end with the block they stand in.
SCOPE = frozenset("html body table td th caption button object".split())

#: Elements that never hold the main text.
NEVER = frozenset("head script style title textarea template noscript iframe object embed svg canvas math audio video select button input form nav aside footer dialog menu search noembed noframes datalist".split())
#: Words in the class, id or role of a container that say the same.
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promoted promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside complementary footer contentinfo masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist reply replies respond disqus discussion reactions pagination pager toolbar widget skip form search".split()
)
#: Those that say so of any element.
ALWAYS = frozenset("ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored promo promoted".split())
#: Words that may stand beside them: of places, and of things that are held.
BESIDE = frozenset("area articles bar block body bottom box buttons c container content global group inner item items js left link links list main news page panel policy posts primary reader right row secondary section site story top user wrap wrapper zone".split())
#: Containers whose names are looked at.
CONTAINER = frozenset("div section ul ol dl table header figure details center article blockquote fieldset".split())
TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<end>/)?(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.S)
ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


class Node:
    """An element; texts lie between the children they stand between."""

    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: str = ""):
        self.name, self.attrs = name, attrs
        self.children: list[Node | str] = []

    def names(self) -> list[str]:
        """The values of class, id and role."""
        got = {}
        for m in ATTR.finditer(self.attrs):
            got.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
        return [got[k] for k in ("class", "id", "role") if got.get(k)]


def parse(page: str) -> Node:
    """The tree of a page, as lenient as browsers are about tags that aren't closed."""
    root = Node("html")
    stack = [root]
    at, size = 0, len(page)

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(s)

    def close(names: tuple[str, ...] | frozenset, until: tuple[str, ...] | frozenset) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                del stack[k:]
                return
            if stack[k].name in until:
                return

    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            text(page[at:])
            break
        m = TAG.match(page, begin)
        if m is None:  # a lone "<" is text
            text(page[at : begin + 1])
            at = begin + 1
            continue
        text(page[at:begin])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if name == "p" and all(x.name != "p" for x in stack):
                continue
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name), 0)
            if depth and (name in BLOCK or not any(x.name in BLOCK for x in stack[depth + 1 :])):
                del stack[depth:]
            continue
        if name in ("html", "body", "head"):
            if name == "html":
                root.attrs = root.attrs or m["attrs"]
                continue
            if name == "body":
                close(("head",), ())
        if name in ENDS_P:
            close(("p",), SCOPE)
        if name in SIBLINGS:
            kinds, until = SIBLINGS[name]
            while any(x.name in kinds for x in stack[1:]):
                depth = len(stack)
                close(kinds, until)
                if len(stack) == depth:
                    break
        node = Node(name, m["attrs"])
        stack[-1].children.append(node)
        if name in VOID or m["attrs"].endswith("/") and name not in BLOCK and name not in RAW:
            continue
        if name in RAW:
            end = re.compile(f"</{name}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(page, at)
            if name in ("title", "textarea"):
                node.children.append(page[at : end.start() if end else size])
            at = end.end() if end else size
            continue
        if len(stack) < DEEPEST:
            stack.append(node)
    return root


def named(value: str, words: frozenset[str]) -> bool:
    """Whether one class, id or role names something of ``words``: by nothing but such words, words of layout and numbers."""
    own = [w.lower() for w in NAME_WORD.findall(value)]
    return "".join(own) in words or any(w in words for w in own) and all(w in words or w in NAMED or w in BESIDE or w.isdigit() for w in own)


def is_boilerplate(node: Node, in_article: bool) -> bool:
    """Whether the element itself says that it isn't main text."""
    name = node.name
    if name in NEVER or name == "header" and not in_article:
        return True
    if not node.attrs:
        return False
    words = NAMED if name in CONTAINER else ALWAYS
    for value in node.names():
        for one in value.split():
            own = [w.lower() for w in NAME_WORD.findall(one)]
            page_header = name in CONTAINER and not in_article and own in (["header"], ["page", "header"], ["site", "header"])
            if page_header or named(one, words):
                return True
    return False


class Skeleton:
    """A tree for alignment: labels, children, and which nodes of the page each stands for.

    ``shape`` is one number for equal trees of labels, ``size`` how many nodes they have.
    """

    __slots__ = ("kids", "label", "menu", "nodes", "shape", "size", "template")

    def __init__(self, label: str, nodes: list[Node]):
        self.label, self.nodes = label, nodes
        self.kids: list[Skeleton] = []
        self.shape, self.size, self.template, self.menu = 0, 1, False, False


def preorder(top: Skeleton) -> list[Skeleton]:
    out, todo = [], [top]
    while todo:
        s = todo.pop()
        out.append(s)
        todo.extend(reversed(s.kids))
    return out


def label_of(node: Node) -> str:
    return " ".join([node.name, *sorted(node.names())]) if node.attrs and node.name != "html" else node.name


def skeleton(root: Node) -> tuple[Skeleton, int]:
    """The skeleton and its size; runs of siblings with one label are one node."""
    top, count = Skeleton("html", [root]), 1
    todo = [top]
    while todo:
        s = todo.pop()
        held: dict[str, Skeleton] = {}
        for node in s.nodes:
            before = None
            for c in node.children:
                if isinstance(c, str):
                    continue
                label = label_of(c)
                if before is not None and before.label == label:
                    before.nodes.append(c)
                    continue
                if len(s.nodes) > 1 and label in held:  # the members of a run share their children's nodes
                    before = held[label]
                    before.nodes.append(c)
                    continue
                before = Skeleton(label, [c])
                held.setdefault(label, before)
                s.kids.append(before)
                count += 1
        todo += s.kids
    return top, count


def paths(top: Skeleton) -> list[int]:
    """The hashes of the different label paths from the root, as sorted signed longs."""
    found, todo = set(), [(top, 0)]
    while todo:
        s, above = todo.pop()
        own = xxhash.xxh64_intdigest(s.label, above)
        if own not in found or s.kids:
            found.add(own)
            todo += [(k, own) for k in s.kids]
    return sorted(x - (1 << 64) if x >> 63 else x for x in found)


def alike(a: set[int], b: set[int]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def long_hash(text: str) -> int:
    x = xxhash.xxh64_intdigest(text)
    return x - (1 << 64) if x >> 63 else x


def plain(node: Node) -> str:
    """All text below a node, white space made one space."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            todo.extend(reversed(x.children))
    return " ".join(" ".join(out).split())


def contents(root: Node) -> dict[int, tuple[int, int, int, int]]:
    """By node: the hash of its text as ``plain`` gives it, how many characters the text has, how many of them stand in links, and in how many links.

    From the leaves up, so that every text is cut into words once, and only texts that no parent has joined yet are held.
    """
    out: dict[int, tuple[int, int, int, int]] = {}
    held: list[list] = []  # of every open node: its texts so far, and the three sums
    todo: list[Node | str | None] = [root]
    path: list[Node] = []
    while todo:
        x = todo.pop()
        if x is None:
            node, (texts, size, linked, links) = path.pop(), held.pop()
            text = " ".join(texts)
            if node.name == "a":
                linked, links = size, links + 1
            out[id(node)] = long_hash(text), size, linked, links
            if held:
                above = held[-1]
                if text:
                    above[0].append(text)
                above[1] += size
                above[2] += linked
                above[3] += links
        elif isinstance(x, str):
            words = x.split()
            if words:
                held[-1][0].append(" ".join(words))
                held[-1][1] += sum(map(len, words))
        else:
            path.append(x)
            held.append([[], 0, 0, 0])
            todo.append(None)
            todo.extend(reversed(x.children))
    return out


def shapes(*tops: Skeleton) -> None:
    """Numbers the shapes of trees, so that equal ones have equal numbers."""
    number: dict[tuple, int] = {}
    for top in tops:
        for s in reversed(preorder(top)):
            s.size = 1 + sum(k.size for k in s.kids)
            s.shape = number.setdefault((s.label, *(k.shape for k in s.kids)), len(number) + 1)


def matching(a: Skeleton, b: Skeleton, known: dict) -> tuple[int, list]:
    """Simple tree matching: how many nodes of two trees with one root label pair up, and which children do.

    Trees of one shape have one answer. Equal trees at the ends of both lists of
    children pair up in a best match, so only what is between them is searched.
    """
    if not known:
        shapes(a, b)
        known[0, 0] = 0, []  # shapes count from 1
    key = (a.shape, b.shape)
    if key in known:
        return known[key]
    if key[0] == key[1]:
        known[key] = a.size, [(i, i) for i in range(len(a.kids))]
        return known[key]
    x, y = a.kids, b.kids
    end = 0
    while end < min(len(x), len(y)) and x[-1 - end].shape == y[-1 - end].shape:
        end += 1
    begin = 0
    while begin < min(len(x), len(y)) - end and x[begin].shape == y[begin].shape:
        begin += 1
    sure = [(i, i) for i in range(begin)] + [(len(x) - k, len(y) - k) for k in range(1, end + 1)]
    total = 1 + sum(x[i].size for i, _ in sure)
    x, y = x[begin : len(x) - end], y[begin : len(y) - end]
    pairs = []
    if x and y:
        # A row a shape of x: what each of y gains with it.
        gain: dict[int, np.ndarray] = {}
        for s in x:
            if s.shape not in gain:
                gain[s.shape] = np.array([matching(s, t, known)[0] if s.label == t.label else 0 for t in y], np.int32)
        m, n = len(x), len(y)

        def row_after(row: np.ndarray, i: int) -> np.ndarray:
            new = row.copy()
            g = gain[x[i].shape]
            np.maximum(new[1:], np.where(g > 0, row[:-1] + g, 0), out=new[1:])
            return np.maximum.accumulate(new)

        step = max(1, HELD // (n + 1))
        row = np.zeros(n + 1, np.int32)
        kept = {0: row}
        for i in range(m):
            row = row_after(row, i)
            if (i + 1) % step == 0:
                kept[i + 1] = row
        total += int(row[n])
        i, j, first, rows = m, n, m + 1, []
        while i and j:
            if i - 1 < first:
                first = (i - 1) // step * step
                rows = [kept[first]]
                while len(rows) <= i - first:
                    rows.append(row_after(rows[-1], first + len(rows) - 1))
            own, above, g = rows[i - first], rows[i - 1 - first], int(gain[x[i - 1].shape][j - 1])
            if g and own[j] == above[j - 1] + g:
                pairs.append((begin + i - 1, begin + j - 1))
                i, j = i - 1, j - 1
            elif own[j] == above[j]:
                i -= 1
            else:
                j -= 1
    known[key] = total, sure + pairs
    return known[key]


def aligned(a: Skeleton, b: Skeleton) -> Iterator[tuple[Skeleton, Skeleton]]:
    """The paired nodes of two trees."""
    known: dict = {}
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        yield x, y
        todo += [(x.kids[i], y.kids[j]) for i, j in matching(x, y, known)[1]]


def title(root: Node) -> str:
    """What a page calls itself: its title, or else its first main heading."""
    for wanted in ("title", "h1"):
        todo = [root]
        while todo:
            node = todo.pop()
            if node.name == wanted and (text := plain(node)):
                return text
            todo.extend(c for c in reversed(node.children) if not isinstance(c, str))
    return ""


class Layout:
    """A layout of a host: its label paths, and its seed with the template nodes and the menus marked."""

    def __init__(self, paths: list[int], labels: list[str], parents: list[int], template: list[int] | None, menus: list[int] | None, main: list[int] | None):
        """``main``: the nodes that have half of the layout's text each. Of ``menus`` those count that stand before one of them, with one parent."""
        self.paths = set(paths)
        self.all = [Skeleton(x, []) for x in labels]
        for s, up in zip(self.all[1:], parents[1:], strict=True):
            self.all[up].kids.append(s)
        self.seed = self.all[0]
        last = {parents[i]: i for i in main or () if i}
        menus = [i for i in menus or () if i and labels[i].split(" ")[0] in LISTS and i < last.get(parents[i], 0) and i not in main]
        self.usable = template is None or bool(template or menus)
        for i in template or ():
            self.all[i].template = True
        for i in menus:
            self.all[i].menu = True


def clusters(table: pa.Table) -> pa.Table:
    """The layouts among some different sets of paths of one host, common ones first; each with the number of its pages, its first set, and the rank of its richest page."""
    found: list[list] = []
    for r in sorted(table.to_pylist(), key=lambda r: (-r["n"], r["sig"])):
        own = set(r["paths"])
        near = [alike(own, x[0]) for x in found]
        if near and max(near) >= ALIKE:
            held = found[near.index(max(near))][1]
            held["n"] += r["n"]
            held["rank"] = max(held["rank"], r["rank"])
        else:
            found.append([own, {k: r[k] for k in ("host", "n", "sig", "paths", "rank")}])
    kinds = [("host", pa.string()), ("n", pa.int64()), ("sig", pa.int64()), ("paths", pa.list_(pa.int64())), ("rank", pa.list_(pa.int64()))]
    return pa.Table.from_pylist([x[1] for x in found], schema=pa.schema(kinds))


class Wrapper:
    """The layouts of a host. What trees of one shape align with is worked out once."""

    def __init__(self, wrapper: str):
        self.layouts = [Layout(*x) for x in json.loads(wrapper)]
        self.known: dict[int, tuple[int, list[tuple[int, int]]]] = {}

    def nearest(self, tree: Skeleton) -> int:
        """The layout most like a tree, of equals the first; -1 if none is alike."""
        own = set(paths(tree))
        near = [alike(own, x.paths) for x in self.layouts]
        return near.index(max(near)) if near and max(near) >= ALIKE else -1

    def align(self, tree: Skeleton) -> tuple[Layout | None, int, list[tuple[int, Skeleton]]]:
        """The layout of a tree (if it has one), its number, and the tree's nodes with those of the seed that they pair up with, by their places in it."""
        nodes = preorder(tree)
        shape = xxhash.xxh128_intdigest("\0".join(f"{s.label}\1{len(s.kids)}" for s in nodes))
        if shape not in self.known:
            k = self.nearest(tree)
            if k < 0:
                return None, k, []
            own = self.layouts[k]
            seed, here = {id(s): i for i, s in enumerate(own.all)}, {id(s): i for i, s in enumerate(nodes)}
            if len(self.known) >= 1000:
                self.known.clear()
            self.known[shape] = k, [(seed[id(x)], here[id(y)]) for x, y in aligned(own.seed, tree)]
        k, pairs = self.known[shape]
        return self.layouts[k], k, [(i, nodes[j]) for i, j in pairs]


def told(root: Node) -> tuple[list[str], list[int]]:
    """A seed as plain data: labels and parents in page order."""
    every = preorder(skeleton(root)[0])
    at = {id(s): i for i, s in enumerate(every)}
    parents = [0] * len(every)
    for s in every:
        for k in s.kids:
            parents[at[id(k)]] = at[id(s)]
    return [s.label for s in every], parents


def left_out(root: Node, wrapper: Wrapper | None) -> tuple[set[int], set[int]]:
    """The page's nodes that its host's wrapper holds to be template, and those that it holds to be menus."""
    template, menus = set(), set()
    if wrapper is None or not any(x.usable for x in wrapper.layouts):
        return template, menus
    own, _, pairs = wrapper.align(skeleton(root)[0])
    for i, y in pairs if own is not None and own.usable else ():
        if own.all[i].template:
            template.update(map(id, y.nodes))
        if own.all[i].menu:
            menus.update(map(id, y.nodes))
    return template, menus


def regions(root: Node) -> list[Node]:
    """The outermost articles of a page, or else its main elements, or else all of it."""
    for wanted in ("article", "main"):
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            if node.name == wanted and not is_boilerplate(node, True):
                found.append(node)
            elif not is_boilerplate(node, False):
                todo.extend(c for c in reversed(node.children) if not isinstance(c, str))
        if any(map(plain, found)):
            return found
    return [root]


def blocks(region: Node, skip: set[int], in_article: bool) -> Iterator[str]:
    """The texts of a region's blocks, in page order."""
    held: list[str] = []
    todo: list = [region]
    while todo:
        x = todo.pop()
        if x is None:
            yield "".join(held)
            held = []
        elif isinstance(x, str):
            held.append(entities.unescape(x))
        elif x is region or not (id(x) in skip or is_boilerplate(x, in_article)):
            if x.name == "br":
                held.append(" ")
                continue
            block = x.name in BLOCK
            if block:
                todo.append(None)
            todo.extend(reversed(x.children))
            if block:
                todo.append(None)
    yield "".join(held)


def main_text(page: str | None, wrapper: Wrapper | None = None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    root = parse(page)
    template, menus = left_out(root, wrapper)
    found = regions(root)
    out = []
    for region in found:
        skip = template | menus if region is root else template
        own = [t for t in (" ".join(b.split()) for b in blocks(region, skip, region is not root)) if t]
        out += own
    return "\n".join(out)


def host_of(url: Column) -> Column:
    """The lower-case host of a URL; null if it has none."""
    found = F.regexp_extract(F.lower(url), r"^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)", 1)
    return F.when(found != "", found)


def host_wrappers(pages: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """host, wrapper (JSON of its layouts): one row for each host.

    ``pages``: host, html. Pages meet as hashes; what they count is added up in every task first.
    """
    ship(pages.sparkSession)
    usable = pages.where(F.col("host").isNotNull() & (F.length("html") > 0)).select("host", F.xxhash64("html").alias("h"), "html")

    @F.arrow_udf("struct<sig:bigint,size:int,paths:array<bigint>>")
    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            got = []
            for page in batch:
                tree, size = skeleton(parse(page.as_py()))
                own = paths(tree)
                got.append({"sig": long_hash(json.dumps(own)), "size": size, "paths": own})
            yield pa.array(got, pa.struct([("sig", pa.int64()), ("size", pa.int32()), ("paths", pa.list_(pa.int64()))]))

    seen = usable.select("host", "h", look("html").alias("p")).select("host", "h", "p.*")
    kinds = seen.groupBy("host", "sig").agg(F.count("*").alias("n"), F.max(F.struct("size", "h")).alias("best"), F.first("paths").alias("paths"))

    kinds = durable(kinds.select("host", "n", "sig", "paths", F.array(F.size("paths").cast("bigint"), F.col("best.size").cast("bigint"), "n", F.col("best.h")).alias("rank")))
    # A host with very many sets of paths is looked at in parts first, by hash; what each part finds meets then.
    many = kinds.groupBy("host").count().select("host", F.ceil(F.col("count") / AT_ONCE).cast("bigint").alias("parts"))
    dealt = kinds.join(F.broadcast(many) if many.count() <= FEW_HOSTS else many, "host").withColumn("part", F.pmod("sig", F.col("parts"))).drop("parts")
    fields = "host string, n bigint, sig bigint, paths array<bigint>, rank array<bigint>"
    found = dealt.groupBy("host", "part").applyInArrow(lambda table: clusters(table), fields)
    found = found.groupBy("host").applyInArrow(lambda table: clusters(table), fields).where(F.col("n") >= least)
    number = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "sig")) - 1
    seeds = durable(found.select("host", number.alias("layout"), "paths", F.col("rank")[3].alias("h")))

    @F.arrow_udf("struct<labels:array<string>,parents:array<int>>")
    def tell(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            got = [dict(zip(("labels", "parents"), told(parse(page.as_py())), strict=True)) for page in batch]
            yield pa.array(got, pa.struct([("labels", pa.list_(pa.string())), ("parents", pa.list_(pa.int32()))]))

    wanted = seeds.select("host", "h")
    wanted = F.broadcast(wanted) if seeds.count() * 64 <= BROADCAST_BYTES else wanted
    trees = usable.join(wanted, ["host", "h"], "left_semi").groupBy("host", "h").agg(F.min("html").alias("html"))
    trees = durable(seeds.join(trees.select("host", "h", tell("html").alias("t")), ["host", "h"]).select("host", "layout", "paths", "t.*"))

    def bundle(rows: DataFrame) -> DataFrame:
        return rows.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("layout", "paths", "labels", "parents", "template", "menus", "main"))).alias("all"))

    @F.arrow_udf("string")
    def dump(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([json.dumps([[x["paths"], x["labels"], x["parents"], x["template"], x["menus"], x["main"]] for x in own]) for own in batch.to_pylist()], pa.string())

    none = F.lit(None).cast("array<int>")
    plain_seeds = durable(bundle(trees.withColumns({"template": none, "menus": none, "main": none})).select("host", dump("all").alias("wrapper")))

    @F.arrow_udf("struct<layout:int,article:bigint,nodes:array<struct<i:int,text:bigint,size:int,linked:int,links:int>>>")
    def count(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        held: dict[str, Wrapper] = {}
        names = {"i": pa.int32(), "text": pa.int64(), "size": pa.int32(), "linked": pa.int32(), "links": pa.int32()}
        for html, wrapper in batches:
            layouts, articles, ends, rows = [], [], [0], []
            for page, w in zip(html, wrapper, strict=True):
                w = w.as_py()
                if w not in held:
                    if len(held) >= 1000:
                        held.clear()
                    held[w] = Wrapper(w)
                root = parse(page.as_py())
                _, k, pairs = held[w].align(skeleton(root)[0])
                known = contents(root) if pairs else {}
                for i, y in pairs:
                    own = [known[id(n)] for n in y.nodes]
                    text, size, linked, links = own[0] if len(own) == 1 else (long_hash(repr([o[0] for o in own])), *(sum(o[j] for o in own) for j in (1, 2, 3)))
                    if size:
                        rows.append((i, text, size, linked, links))
                    if i == 0:  # node -1 stands for the page itself
                        rows.append((-1, 0, size, 0, 0))
                layouts.append(k)
                articles.append(long_hash(title(root)))
                ends.append(len(rows))
            flat = zip(*rows, strict=True) if rows else [()] * len(names)
            nodes = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(flat, names.values(), strict=True)], list(names))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), nodes)
            yield pa.StructArray.from_arrays([pa.array(layouts, pa.int32()), pa.array(articles, pa.int64()), lists], ["layout", "article", "nodes"])

    small = plain_seeds.agg(F.coalesce(F.sum(F.length("wrapper")), F.lit(0))).first()[0] <= BROADCAST_BYTES
    counted = usable.join(F.broadcast(plain_seeds) if small else plain_seeds, "host").select("host", count("html", "wrapper").alias("c")).select("host", "c.*")
    nodes = counted.select("host", "layout", "article", F.explode("nodes").alias("n")).select("host", "layout", "article", "n.*")
    # Versions of one article count once.
    once = nodes.groupBy("host", "layout", "article", "i", "text").agg(*(F.max(c).alias(c) for c in ("size", "linked", "links")))
    votes = once.groupBy("host", "layout", "i", "text").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("size", "linked", "links")))
    most = durable(votes.groupBy("host", "layout", "i").agg(F.max("n").alias("n"), F.sum("n").alias("there"), *(F.sum(c).alias(c) for c in ("size", "linked", "links"))))
    total = most.where("i = -1").select("host", "layout", F.col("n").alias("total"), F.col("size").alias("whole"))
    judged = most.where("i >= 0").join(total, ["host", "layout"]).where(F.col("total") >= least)
    constant = F.col("n") >= share * F.col("total")
    menu = (F.col("there") >= share * F.col("total")) & (F.col("linked") >= LINKS * F.col("size")) & (F.col("links") >= SEVERAL * F.col("there"))
    main = 2 * F.col("size") >= F.col("whole")
    said = {"template": constant, "menus": menu, "main": main}
    marks = judged.where(constant | menu | main).groupBy("host", "layout").agg(*(F.sort_array(F.collect_list(F.when(c, F.col("i")))).alias(k) for k, c in said.items()))
    empty = F.array().cast("array<int>")
    return bundle(trees.join(marks, ["host", "layout"], "left").withColumns({k: F.coalesce(k, empty) for k in said})).select("host", dump("all").alias("wrapper"))


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url", **options) -> DataFrame:
    """``pages`` (any columns but ``text`` and ``n_chars``) with text and n_chars in place of the html: one row for each row."""
    spark = ship(pages.sparkSession)
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    named = pages.select(*(F.col(f"`{c}`") for c in kept), F.col(html_col).cast("string").alias("_html"), host_of(F.col(url_col).cast("string")).alias("_host"))
    wrappers = durable(host_wrappers(named.select(F.col("_host").alias("host"), F.col("_html").alias("html")), **options))
    size = wrappers.agg(F.coalesce(F.sum(F.length("wrapper") + F.length("host")), F.lit(0))).first()[0]

    @F.arrow_udf("string")
    def text(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        held: dict[str, Wrapper] = {}
        for html, wrapper in batches:
            out = []
            for page, w in zip(html, wrapper, strict=True):
                w = w.as_py()
                if w is not None and w not in held:
                    if len(held) >= 1000:
                        held.clear()
                    held[w] = Wrapper(w)
                out.append(main_text(page.as_py(), held.get(w)))
            yield pa.array(out, pa.string())

    w = wrappers.select(F.col("host").alias("_host"), F.col("wrapper").alias("_wrapper"))
    # Beyond that size the pages are joined by host, and adaptive execution splits the large hosts.
    joined = named.join(F.broadcast(w) if size <= BROADCAST_BYTES else w, "_host", "left")
    out = joined.select(*(F.col(f"`{c}`") for c in kept), text(F.col("_html"), F.col("_wrapper")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
