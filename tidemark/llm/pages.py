"""Main text of web pages by wrapper induction.

Pages of one host share a template.  The wrapper of a host is the DOM tree that
most of its pages have (neighbouring children of one signature count as one
node: a list is repeats of one slot).  Every other tree of the host is aligned
with it by simple tree matching: the order-preserving match of children with
equal signatures that pairs the most nodes.  Nodes that find no partner are
known by the signatures on their way from the root.

Then every page tells which text it has at which wrapper node.  A node is
*template* if nearly all pages that have it show a text that stands there on
other pages too; a node whose texts are the page's own is a *slot*.  The slots,
in page order, are the text of a page.  What the template can't tell, since it
varies like prose, goes by its role (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, comments of readers) or by standing mostly in
links.  A host of fewer than ``PAGES`` different pages has nothing to compare;
only there an article or main element, if there is one, is the text.

Each page is parsed once.  Trees are aligned once per host and shape, however
many pages have it; counts of texts combine on the map side, and pages of a hot
host stay spread.  All steps are counts, least or largest values, so neither the
order nor the grouping of pages changes a result.

Null or empty html gives an empty text; a null or odd url is a host of its own
kind (""); repeated pages count as one when texts are compared, and each has its
row; pages cut off in the middle of a tag, element or script are read up to
there; extra columns are ignored unless asked for, and added columns that clash
get a ``_`` in front.
"""

from __future__ import annotations

import hashlib
import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import BROADCAST_BYTES, discard, fresh, hot_keys, ship, spread_join, stash

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>"[^"]*"|'[^']*'|[^'">]+)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "select")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}}  # an opening tag ends these, within their list or table
_SCOPE = frozenset("ul ol menu dl table".split())
_NOT_PROSE = frozenset("head nav footer aside form fieldset dialog button menu".split())
_NOT_PROSE_WORD = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|sidebar|side-?bar|widget|nav\w*|menu|breadcrumbs?|footer|site-header|page-header|masthead|comments?|replies|disqus|respond|share|sharing|social|related|recommended|pagination|pager|search\w*|login)(?=$|[\s_-])",
    re.I,
)
_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")


class Node:
    """A block element of a page: tag, signature, and the elements in it."""

    __slots__ = ("sig", "tag", "kids", "place")

    def __init__(self, sig: str, tag: str):
        self.sig, self.tag, self.kids, self.place = sig, tag, [], -1


class Block:
    """A run of text between block boundaries: its node, the text, and how much of it stands in links."""

    __slots__ = ("node", "text", "linked", "prose", "article")

    def __init__(self, node, text, linked, prose, article):
        self.node, self.text, self.linked, self.prose, self.article = node, text, linked, prose, article


def parse(html: str) -> tuple[Node, list[Block]]:
    """The tree of block elements of a page and its text blocks in page order."""
    root = Node("", "")
    open_: list[tuple[Node, bool, bool]] = [(root, True, False)]  # node, prose, in an article
    held: dict[str, int] = {}  # open elements by tag
    blocks: list[Block] = []
    run: list[str] = []
    linked, in_link, at, n = 0, False, 0, len(html)

    def flush() -> None:
        nonlocal linked
        if run:
            text = _SPACE.sub(" ", unescape("".join(run))).strip()
            if text:
                node, prose, article = open_[-1]
                blocks.append(Block(node, text, linked, prose, article))
            run.clear()
        linked = 0

    def close(k: int) -> None:
        for x, _, _ in open_[k:]:
            held[x.tag] -= 1
        del open_[k:]

    def say(text: str) -> None:
        nonlocal linked
        if text:
            run.append(text)
            if in_link:
                linked += len(text)

    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            say(html[at:])
            break
        say(html[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                in_link = False
            elif tag in _BLOCK:
                flush()
                if held.get(tag):
                    close(max(k for k in range(len(open_)) if open_[k][0].tag == tag) if open_[-1][0].tag != tag else len(open_) - 1)
            elif tag in ("td", "th"):
                run.append(" ")
            continue
        if tag in _RAW:
            end = _RAW[tag].search(html, at)
            at = end.end() if end else n
            continue
        if tag == "a":
            in_link = True
        elif tag == "body":  # a head that was never closed ends here
            flush()
            while len(open_) > 1 and open_[-1][0].tag == "head":
                close(len(open_) - 1)
        if tag in _BLOCK or tag == "head":
            flush()
            if open_[-1][0].tag == "p":  # a paragraph holds no blocks
                close(len(open_) - 1)
            if tag in _ENDS:
                for k in range(len(open_) - 1, 0, -1):
                    if open_[k][0].tag in _ENDS[tag]:
                        close(k)
                        break
                    if open_[k][0].tag in _SCOPE:
                        break
            if tag in _VOID:
                continue
            names = " ".join(x for found in _CLASS.findall(m[3]) for x in found if x) if "=" in m[3] else ""
            node = Node(f"{tag} {_DIGITS.sub('#', names)}" if names else tag, tag)
            parent, prose, article = open_[-1]
            parent.kids.append(node)
            main = tag in ("article", "main") or "main" in names.split()
            bad = tag in _NOT_PROSE or (tag == "header" and not article) or (names and tag not in ("html", "body") and _NOT_PROSE_WORD.search(names))
            open_.append((node, prose and not bad, article or (main and prose)))
            held[tag] = held.get(tag, 0) + 1
        elif tag in ("br", "td", "th"):
            run.append(" ")
    flush()
    return root, blocks


def tree_of(root: Node) -> list[tuple[int, str]]:
    """(depth, signature) of every node in page order, neighbours of one signature as one; nodes learn their ``place`` in it."""
    out: list[tuple[int, str]] = []
    stack = [(0, [root])]
    while stack:
        depth, group = stack.pop()
        for x in group:
            x.place = len(out)
        out.append((depth, group[0].sig))
        runs: list[list[Node]] = []
        for x in group:
            for k in x.kids:
                if runs and runs[-1][0].sig == k.sig:
                    runs[-1].append(k)
                else:
                    runs.append([k])
        stack.extend((depth + 1, r) for r in reversed(runs))
    return out


def pack(tree: list[tuple[int, str]]) -> str:
    return "\n".join(f"{d} {_SPACE.sub(' ', sig)}" for d, sig in tree)


def unpack(packed: str) -> list[tuple[int, str]]:
    return [(int(d), sig) for d, _, sig in (line.partition(" ") for line in packed.split("\n"))]


class Shapes:
    """Numbers for subtree shapes, so that equal subtrees are told at once and matched once."""

    def __init__(self) -> None:
        self.number: dict[tuple, int] = {}
        self.sig: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.known: dict[tuple[int, int], int] = {}

    def of(self, tree: list[tuple[int, str]]) -> tuple[list[int], list[list[int]]]:
        """Shape number and children (as places) of every node of a tree."""
        kids: list[list[int]] = [[] for _ in tree]
        path: list[int] = []
        for i, (depth, _) in enumerate(tree):
            del path[depth:]
            if path:
                kids[path[-1]].append(i)
            path.append(i)
        shape = [0] * len(tree)
        for i in range(len(tree) - 1, -1, -1):
            key = (tree[i][1], *(shape[k] for k in kids[i]))
            if key not in self.number:
                self.number[key] = len(self.sig)
                self.sig.append(key[0])
                self.kids.append(key[1:])
                self.size.append(1 + sum(self.size[k] for k in key[1:]))
            shape[i] = self.number[key]
        return shape, kids

    def weight(self, x: int, y: int) -> int:
        """Simple tree matching: the most node pairs that an order-preserving match of two subtrees can have."""
        stack = [(x, y)]
        while stack:
            a, b = stack[-1]
            if (a, b) in self.known:
                stack.pop()
                continue
            if self.sig[a] != self.sig[b] or a == b:
                self.known[a, b] = self.size[a] if a == b else 0
                continue
            waits = [(i, j) for i in dict.fromkeys(self.kids[a]) for j in dict.fromkeys(self.kids[b]) if (i, j) not in self.known]
            if waits:
                stack.extend(waits)
                continue
            self.known[a, b] = 1 + int(_best(self.weights(self.kids[a], self.kids[b]), len(self.kids[b]))[-1])
        return self.known[x, y]

    def weights(self, xs, ys):
        """Rows of match weights of the children ``xs`` with all of ``ys``, one at a time."""
        rows: dict[int, np.ndarray] = {}
        for x in xs:
            if x not in rows:
                rows[x] = np.array([self.weight(x, y) for y in ys], np.int64)
            yield rows[x]

    def pairs(self, xs: list[int], ys: list[int]) -> list[tuple[int, int]]:
        """Index pairs of the best ordered match of two lists of shapes, in memory linear in them."""
        out, todo = [], [(0, len(xs), 0, len(ys))]
        while todo:
            i, n, j, m = todo.pop()
            while i < n and j < m and xs[i] == ys[j]:  # equal subtrees at an end belong together
                out.append((i, j))
                i, j = i + 1, j + 1
            while i < n and j < m and xs[n - 1] == ys[m - 1]:
                n, m = n - 1, m - 1
                out.append((n, m))
            if i >= n or j >= m:
                continue
            if n - i == 1:
                row = next(self.weights(xs[i:n], ys[j:m]))
                if row.max() > 0:
                    out.append((i, j + int(row.argmax())))
                continue
            half = (i + n) // 2  # the best cut of ys at the middle of xs
            first = _best(self.weights(xs[i:half], ys[j:m]), m - j)
            second = _best((r[::-1] for r in self.weights(xs[half:n][::-1], ys[j:m])), m - j)[::-1]
            cut = j + int((first + second).argmax())
            todo += [(i, half, j, cut), (half, n, cut, m)]
        return sorted(out)


def _best(rows, width: int) -> np.ndarray:
    """Weights of the best ordered match of all rows with the first 0, 1, ... columns."""
    best = np.zeros(width + 1, np.int64)
    for w in rows:
        best[1:] = np.maximum(best[1:], np.where(w > 0, best[:-1] + w, 0))
        best = np.maximum.accumulate(best)
    return best


def tree_match(a: list[tuple[int, str]], b: list[tuple[int, str]]) -> int:
    shapes = Shapes()
    return shapes.weight(shapes.of(a)[0][0], shapes.of(b)[0][0])


def align(tree: list[tuple[int, str]], wrapper: list[tuple[int, str]]) -> list[int]:
    """Per node of a tree its partner's place in the wrapper, or a negative number for the path to it."""
    shapes = Shapes()
    (mine, kids), (theirs, slots) = shapes.of(tree), shapes.of(wrapper)
    keys: list[int | None] = [None] * len(tree)
    if tree[0][1] == wrapper[0][1]:
        keys[0] = 0
        todo = [(0, 0)]
        while todo:
            x, y = todo.pop()
            for i, j in shapes.pairs([mine[k] for k in kids[x]], [theirs[k] for k in slots[y]]):
                i, j = kids[x][i], slots[y][j]
                keys[i] = j
                todo.append((i, j))
    path: list[int] = []
    for i, (depth, sig) in enumerate(tree):
        del path[depth:]
        path.append(hash_text(f"{path[-1] if path else 0} {sig}"))
        if keys[i] is None:
            keys[i] = -1 - (path[-1] >> 1)
    return keys


def hash_text(text: str) -> int:
    """63 bits of a text."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 1


#: different pages that a host must have, and the share of a node's pages whose text stands there on others too, for a template
PAGES, REPEATED = 3, 0.8

_HOST = re.compile(r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


_PARSED = "_host string, _shape long, _page long, _tree string, _nodes array<int>, _hashes array<long>, _blocks array<struct<node:int,prose:boolean,article:boolean,links:boolean,text:string>>"


def parsed(pages: DataFrame, keep: list[str], *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``keep`` as _keep_0, ... with each page's host, tree and its number, own hash, texts' hashes by node, and blocks."""
    ship(pages.sparkSession)
    given = pages.select(*[F.col(f"`{c}`").alias(f"_keep_{i}") for i, c in enumerate(keep)], F.col(f"`{url_col}`").cast("string").alias("_url"), F.col(f"`{html_col}`").cast("string").alias("_html"))
    k = len(keep)
    names = [f"_keep_{i}" for i in range(k)]
    schema = T.StructType([*given.schema.fields[:k], *T.StructType.fromDDL(_PARSED).fields])
    block_type = pa.struct([("node", pa.int32()), ("prose", pa.bool_()), ("article", pa.bool_()), ("links", pa.bool_()), ("text", pa.string())])

    def one(url: str | None, html: str | None) -> tuple:
        root, blocks = parse(html or "")
        tree = pack(tree_of(root))
        texts: dict[int, list[str]] = {}
        for b in blocks:
            texts.setdefault(b.node.place, []).append(b.text)
        shown = [{"node": b.node.place, "prose": bool(b.prose), "article": bool(b.article), "links": 2 * b.linked >= len(b.text) + b.linked, "text": b.text} for b in blocks]
        return host_of(url), hash_text(tree), hash_text(html or ""), tree, list(texts), [hash_text("\n".join(t)) for t in texts.values()], shown

    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(block_type)]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                b = batch.slice(i, 256)
                got = list(zip(*map(one, b.column(k).to_pylist(), b.column(k + 1).to_pylist())))
                yield pa.RecordBatch.from_arrays([*b.columns[:k], *[pa.array(v, t) for v, t in zip(got, types)]], names=[*names, *[f.name for f in schema.fields[k:]]])

    return given.mapInArrow(run, schema)


def wrappers(seen: DataFrame) -> DataFrame:
    """_host, _shape, n (pages), template (the nodes of this tree that are) and aligned (whether the host has pages to compare)."""
    trees = seen.groupBy("_host", "_shape").agg(F.count(F.lit(1)).alias("n"), F.min("_tree").alias("tree"))
    trees = stash(trees, "trees")
    commonest = trees.groupBy("_host").agg(F.max(F.struct("n", "_shape", "tree")).alias("most")).select("_host", F.col("most.tree").alias("wrapper"))
    per_host = trees.groupBy("_host").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(per_host, "_host")
    both = spread_join(trees, commonest, "_host", hot).select("_host", "_shape", "n", "tree", "wrapper")
    schema = T.StructType([both.schema["_host"], both.schema["_shape"], both.schema["n"], T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches):
        for b in batches:
            keys = [align(unpack(t), unpack(w)) for t, w in zip(b.column("tree").to_pylist(), b.column("wrapper").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(keys, pa.list_(pa.int64()))], names=schema.names)

    aligned = stash(both.mapInArrow(run, schema), "aligned")
    shown = by_tree(seen.select("_host", "_shape", "_page", F.arrays_zip("_nodes", "_hashes").alias("_at")), aligned.select("_host", "_shape", "keys"), aligned)
    shown = shown.select("_host", "_page", "keys", F.explode("_at").alias("_at"))
    shown = shown.select("_host", F.element_at("keys", F.col("_at._nodes") + 1).alias("key"), F.col("_at._hashes").alias("text"), "_page")
    texts = shown.groupBy("_host", "key", "text").agg(F.count_distinct("_page").alias("n"))
    nodes = texts.groupBy("_host", "key").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("again"))
    fixed = nodes.filter((F.col("n") >= PAGES) & (F.col("again") >= REPEATED * F.col("n"))).groupBy("_host").agg(F.collect_set("key").alias("fixed"))
    many = seen.groupBy("_host").agg(F.count_distinct("_page").alias("pages"))
    hosts = stash(many.join(fixed, "_host", "left"), "hosts")
    out = spread_join(aligned, hosts, "_host", hot)
    places = F.transform(F.filter(F.transform("keys", lambda key, i: F.when(F.array_contains(F.coalesce("fixed", F.array().cast("array<long>")), key), i)), lambda i: i.isNotNull()), lambda i: i.cast("int"))
    out = stash(out.select("_host", "_shape", "n", places.alias("template"), (F.col("pages") >= PAGES).alias("aligned")), "wrappers")
    discard(trees, aligned, hosts)
    return out


def by_tree(pages: DataFrame, trees: DataFrame, sizes: DataFrame) -> DataFrame:
    """``pages`` with what ``trees`` has for their host and shape; ``sizes`` counts the pages of each as n."""
    at = lambda df: df.withColumn("_at_tree", F.struct("_host", "_shape")).drop("_host", "_shape")
    width = trees.agg(F.count(F.lit(1)).alias("n"), F.sum(sum((F.size(c) for c, t in trees.dtypes if t.startswith("array")), F.lit(0))).alias("cells")).first()
    if 100 * width["n"] + 8 * (width["cells"] or 0) <= BROADCAST_BYTES // 4:
        return pages.join(F.broadcast(trees), ["_host", "_shape"])
    return spread_join(at(pages), at(trees), "_at_tree", hot_keys(at(sizes.select("_host", "_shape", "n")), "_at_tree")).select("_at_tree._host", "_at_tree._shape", "*").drop("_at_tree")


def main_text(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns unless given) with the page's main text as ``text`` and its code points as ``n_chars``."""
    keep = list(pages.columns) if keep is None else keep
    text, n_chars = fresh(pages.select(*[F.col(f"`{c}`") for c in keep]), "text", "n_chars")
    seen = stash(parsed(pages, keep, url_col=url_col, html_col=html_col), "pages")
    known = wrappers(seen)
    shown = by_tree(seen.drop("_tree", "_page", "_nodes", "_hashes"), known.select("_host", "_shape", "template", "aligned"), known)
    slots = F.filter("_blocks", lambda b: b["prose"] & ~F.array_contains("template", b["node"]))
    shown = shown.withColumn("_slots", slots)
    article = ~F.col("aligned") & F.exists("_slots", lambda b: b["article"])
    own = F.filter("_slots", lambda b: F.when(F.col("_article"), b["article"]).otherwise(b["article"] | ~b["links"]))
    shown = shown.withColumn("_article", article).withColumn("_text", F.array_join(F.transform(own, lambda b: b["text"]), "\n\n"))
    return shown.select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)], F.col("_text").alias(text), F.length("_text").cast("long").alias(n_chars))
