"""Main text of web pages by wrapper induction.

Pages of one host share a template.  The host's page with the smallest id is
the pivot; every page's tree is aligned with the pivot's by simple tree
matching, and for each pivot node it is counted over all pages of the host how
often an aligned node's text is the same.  Nodes that are the same nearly
everywhere are template, the varying slots are content.  What the pivot lacks
is judged without it: a text that nearly all pages with the same path of
elements have there is template too, among all pages of the host and among
those of one layout (the set of a page's paths).  Slots in places that
never hold an article (menus, footers, adverts, forms, comments, ...) are left
out by their element's kind or class, and if a page marks an article, only
slots within it count.

Counts are combined in the map tasks, so a host with a third of all pages
sends one row per node and task.  The wrappers (a tree of hashes per host) go
to all tasks while their measured size allows, else they are joined by host
with hot hosts split.
"""

from __future__ import annotations

import html
import math
import pickle
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import salted_lookup
from ..session import materialize
from .common import slices

BROADCAST_BYTES = 32 << 20
LEAST_PAGES, SAME_SHARE = 4, 0.8
DEPTH = 100
#: Pairs of children whose weights a task holds at once; longer lists go by blocks of rows.
BLOCK = 4_000_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<svg(?=[\s/])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?<=/)>"
    r"|<(script|style|noscript|template|title|textarea|iframe|svg|select|object)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>",
    re.S | re.I)
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_DIGITS = re.compile(r"\d+")
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
              "span strike strong sub sup time tt u var wbr".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_NAMELESS = {"html", "body", "main", "article"}
_NEVER = set("nav footer aside form button head menu dialog".split())
_NEVER_NAMED = set("ad ads advert advertisement adverts advertising banner cookie cookies consent notice notification popup modal "
                   "newsletter subscribe sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment "
                   "comments disqus respond share sharing social related promo sponsored sponsor hidden complementary "
                   "contentinfo".split())
#: A start tag of the key closes open elements of these kinds first.
_CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
           "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}


class Node:
    """An element, or a run of text (kind ``#text``); ``number`` in page order."""

    __slots__ = ("kind", "children", "text", "never", "article", "number", "hash")

    def __init__(self, kind: str, never: bool, article: bool):
        self.kind, self.children, self.text, self.never, self.article, self.hash = kind, [], [], never, article, 0


def parse(page: str, free: frozenset = frozenset()) -> Node:
    """A tolerant tree of block elements; inline elements only pass their text on.

    Names decide as whole tokens, and never on the page, its body or a marked
    article.  If every article lies in elements left out by name, names do not
    decide on those elements (``free``, places of their tags) either.
    """
    root = Node("html", False, False)
    stack: list[tuple[str, Node, int]] = [("html", root, -1)]  # with the place of a tag that is left out by name, else -1
    run: Node | None = None
    around, marked = set(), False

    def say(text: str) -> None:
        nonlocal run
        if run is None:
            if not text.strip():
                return
            top = stack[-1][1]
            run = Node("#text", top.never, top.article)
            top.children.append(run)
        run.text.append(text)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            say(page[at:m.start()])
        at = m.end()
        tag = (m.group(3) or m.group(6) or "").lower()
        if not tag:
            continue
        if tag == "br":
            say("\n")
            continue
        closing = m.group(2) or m.group(5)
        attributes = m.group(4) or m.group(7) or ""
        names, tokens = set(), set()
        if attributes and not closing:
            for v in _NAMES.finditer(attributes):
                value = (v.group(1) or v.group(2) or v.group(3) or "").lower()
                names.update(re.split(r"[^a-z0-9]+", value))
                tokens.update(value.split())
        never = tag not in _NAMELESS and "main" not in tokens and m.start() not in free and bool(tokens & _NEVER_NAMED)
        if tag in _INLINE and not never and not (closing and any(t == tag for t, _, _ in stack)):
            continue
        run = None
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        closes = _CLOSES.get(tag, {"p"} if tag not in _INLINE else ())
        while len(stack) > 1 and stack[-1][0] in closes:
            stack.pop()
        top = stack[-1][1]
        article = top.article or tag in ("article", "main") or "main" in tokens
        if article and not top.article:
            around.update(p for _, _, p in stack if p >= 0)
        place = m.start() if never else -1
        never = top.never or tag in _NEVER or never or (tag == "header" and not top.article)
        if len(stack) > DEPTH:  # deeper elements pass their text on
            stack.append((tag, top, -1))
            continue
        node = Node(tag + "." + min(names, default="") if names else tag, never, article and not never)
        marked = marked or node.article
        top.children.append(node)
        if tag not in _VOID and not attributes.endswith("/"):
            stack.append((tag, node, place))
    if at < len(page):
        say(page[at:])
    return parse(page, free | around) if around and not marked else root


def number(root: Node) -> list[Node]:
    """All nodes in page order, numbered; runs of text get their final text and its hash."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        node.number = len(out)
        out.append(node)
        if node.kind == "#text":
            node.text = " ".join(html.unescape("".join(node.text)).split())
            node.hash = xxhash.xxh32_intdigest(node.text)
        todo.extend(reversed(node.children))
    return out


def compact(node) -> tuple:
    """(kind, hash, number, children) of a tree, as wrappers are kept."""
    return node.kind, node.hash, node.number, tuple(compact(c) for c in node.children) if node.children else ()


def match(page: Node, pivot: tuple, found: list[tuple[Node, int, int]]) -> None:
    """Simple tree matching of two trees of the same kind: appends (node, pivot number, pivot hash) of aligned text runs.

    Children are aligned in order so that most weight is kept; a child's weight
    is the size of the best matching of its own children, and equal texts count
    double.  Lists of any length are aligned alike.
    """
    stack, memo = [(page, pivot)], {}
    while stack:
        a, b = stack.pop()
        if a.kind == "#text":
            found.append((a, b[2], b[1]))
            continue
        stack.extend(_align(a, b, memo)[1])


def _weight(a: Node, b: tuple, memo: dict) -> int:
    if a.kind != b[0]:
        return 0
    if a.kind == "#text":
        return 2 if a.hash == b[1] else 1
    return 1 + _align(a, b, memo)[0]


def _weights(xs: list, ys: tuple, memo: dict) -> np.ndarray:
    """Weights of all pairs of children.  Runs of text and elements with at most one run are compared in bulk."""
    def plain(kind, own, children):
        """1: a run of text, 2: an element without children, 3: with one run; 0: neither."""
        return (1, own) if kind == "#text" else (2, 0) if not children else \
            (3, children[0]) if len(children) == 1 else (0, 0)

    code: dict = {}
    left = [plain(x.kind, x.hash, [c.hash if c.kind == "#text" else None for c in x.children[:2]]) for x in xs]
    right = [plain(y[0], y[1], [c[1] if c[0] == "#text" else None for c in y[3][:2]]) for y in ys]
    left = [(0, 0) if h is None else (s, h) for s, h in left]
    right = [(0, 0) if h is None else (s, h) for s, h in right]
    kx = np.array([code.setdefault(x.kind, len(code)) for x in xs])
    ky = np.array([code.setdefault(y[0], len(code)) for y in ys])
    (sx, hx), (sy, hy) = (np.array(v, np.int64).reshape(-1, 2).T for v in (left, right))
    kind = kx[:, None] == ky
    run = (sx[:, None] != 2) & (sy != 2)
    w = np.where(kind, 1 + np.where(run, (sx[:, None] == 3) + (hx[:, None] == hy), 0), 0).astype(np.int32)
    weight = _weight if len(xs) * len(ys) < BLOCK // 100 else _Alike()
    for i, odd in enumerate(kind & ((sx[:, None] == 0) | (sy == 0))):
        for j in np.flatnonzero(odd).tolist():
            w[i, j] = weight(xs[i], ys[j], memo)
    return w


def _texts(tree: tuple) -> set:
    return {tree[1]} if tree[0] == "#text" else set().union(*map(_texts, tree[3]))


def _shape(tree: tuple, texts, ids: dict) -> int:
    """Equal for trees that differ at most in texts outside of ``texts``."""
    own = (tree[0], tree[1] if tree[1] in texts else None) if tree[0] == "#text" else tree[0]
    return ids.setdefault((own, tuple(_shape(c, texts, ids) for c in tree[3])), len(ids))


class _Alike:
    """Weights of many pairs: those of the same shapes, but for texts that a pair does not share, are worked out once."""

    def __init__(self):
        self.ids, self.trees, self.shapes, self.seen = {}, {}, {}, {}

    def _tree(self, key, node) -> tuple:
        if key not in self.trees:
            tree = node if type(node) is tuple else compact(node)
            self.trees[key] = tree, frozenset(_texts(tree))
        return self.trees[key]

    def __call__(self, a: Node, b: tuple, memo: dict) -> int:
        pair, shapes = ((0, a.number), (1, b[2])), []
        (x, mine), (y, other) = self._tree(pair[0], a), self._tree(pair[1], b)
        both = mine & other
        for key, tree in zip(pair, (x, y), strict=True):
            shape = self.shapes.get((key, both))
            if shape is None:
                shape = self.shapes[key, both] = _shape(tree, both, self.ids)
            shapes.append(shape)
        shapes = tuple(shapes)
        if shapes not in self.seen:
            self.seen[shapes] = _weight(a, b, memo)
        return self.seen[shapes]


def _weigher(xs: list, ys: tuple, memo: dict):
    """A function from a range of xs to the weights of their pairs with all ys.

    In long lists, children that differ only in texts which the other list does
    not hold have the same weights, worked out once.
    """
    if len(xs) * len(ys) <= BLOCK:
        whole = _weights(xs, ys, memo)
        return lambda start, end: whole[start:end]
    trees = [compact(x) for x in xs]
    common, ids = set().union(*map(_texts, trees)) & set().union(*map(_texts, ys)), {}
    (ix, fx), (iy, fy) = (np.unique([_shape(t, common, ids) for t in ts], return_index=True, return_inverse=True)[:0:-1] for ts in (trees, ys))
    some_x, some_y = [xs[k] for k in fx], tuple(ys[k] for k in fy)
    if len(some_x) * len(some_y) <= BLOCK:
        whole = _weights(some_x, some_y, memo)
        return lambda start, end: whole[ix[start:end]][:, iy]

    def block(start, end):
        rows, at = np.unique(ix[start:end], return_inverse=True)
        return _weights([some_x[k] for k in rows], some_y, {})[at][:, iy]
    return block


def _align(a: Node, b: tuple, memo: dict) -> tuple[int, list]:
    """Weight and pairs of the best alignment in order of two nodes' children; each pair of nodes is done once."""
    key = a.number, b[2]
    if key not in memo:
        memo[key] = _align_children(a.children, b[3], memo)
    return memo[key]


def _align_children(xs: list, ys: tuple, memo: dict) -> tuple[int, list]:
    if not xs or not ys:
        return 0, []
    if len(xs) == len(ys) == 1:
        w = _weight(xs[0], ys[0], memo)
        return w, [(xs[0], ys[0])] if w else []
    weigh = _weigher(xs, ys, memo)
    step = max(BLOCK // len(ys), math.isqrt(len(xs)), 1)
    starts, tops, top = range(0, len(xs), step), [], np.zeros(len(ys) + 1, np.int32)
    for start in starts:
        tops.append(top)
        weights = weigh(start, start + step)
        rows = _rows(top, weights)
        top = rows[-1]
    pairs, i, j = [], len(xs), len(ys)
    for start in reversed(starts):
        if not j:
            break
        if start != starts[-1]:  # of longer lists only each block's first row was kept
            weights = weigh(start, start + step)
            rows = _rows(tops[start // step], weights)
        while i > start and j:
            k = i - start
            if weights[k - 1][j - 1] and rows[k][j] == rows[k - 1][j - 1] + weights[k - 1][j - 1]:
                pairs.append((xs[i - 1], ys[j - 1]))
                i, j = i - 1, j - 1
            elif rows[k][j] == rows[k - 1][j]:
                i -= 1
            else:
                j -= 1
    return int(top[-1]), pairs


def _rows(top: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """The row above a block and the block's rows of the best total weights."""
    rows = [top]
    for w in weights:
        prev = rows[-1]
        row = np.zeros_like(prev)
        row[1:] = np.maximum.accumulate(np.maximum(prev[1:], np.where(w > 0, prev[:-1] + w, 0)))
        rows.append(row)
    return rows


def aligned(page: Node, pivot: tuple) -> list[tuple[Node, int, int]]:
    found: list = []
    match(page, pivot, found)
    return found


@lru_cache(100_000)
def _path(above: int, kind: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{above}/{_DIGITS.sub('', kind)}") >> 1


def candidates(root: Node) -> list[tuple[Node, int]]:
    """The runs of text that may be main text, in page order, with their path of elements; of a numbered tree."""
    out, todo = [], [(root, 0)]
    while todo:
        node, above = todo.pop()
        path = _path(above, node.kind)
        if node.kind == "#text" and node.text:
            out.append((node, path))
        todo.extend((c, path) for c in reversed(node.children))
    marked = any(n.article for n, _ in out)
    return [(n, p) for n, p in out if not n.never and (n.article or not marked)]


def _key(layout: int, path: int, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{layout}/{path}/{text}") >> 1


def _layout(runs: list[tuple[Node, int]]) -> int:
    return xxhash.xxh3_64_intdigest(str(sorted({p for _, p in runs}))) >> 1


def main_text(page: str | None, wrapper: bytes | None) -> str:
    """The main text of a page, given its host's pickled (pivot, template numbers, keys of texts) if there is one."""
    if not page:
        return ""
    root = parse(page)
    number(root)
    runs = candidates(root)
    template = set()
    if wrapper:
        pivot, constant, keys = pickle.loads(wrapper)
        if constant:
            template = {n.number for n, p, h in aligned(root, pivot) if p in constant and n.hash == h}
        if keys:
            layout = _layout(runs)
            template |= {n.number for n, p in runs if _key(0, p, n.text) in keys or _key(layout, p, n.text) in keys}
    return " ".join(n.text for n, _ in runs if n.number not in template)


def _host():
    return F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))


def _pivots(batches):
    """Each host's first page of the task, as a compact tree."""
    first: dict = {}
    for b in slices(batches, 512):
        for host, page_id, page in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if host and page and page_id is not None and (host not in first or page_id < first[host][0]):
                first[host] = (page_id, page)
    rows = []
    for host, (page_id, page) in first.items():
        root = parse(page)
        number(root)
        rows.append((host, page_id, pickle.dumps(compact(root))))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)],
                                         ["host", "page_id", "pivot"])


def _counts(batches):
    """(host, pivot node, pages, pages with the same text), combined in the task."""
    seen: dict = {}

    def out():
        rows = [(h, k, n, s) for (h, k), (n, s) in seen.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["host", "node", "n", "same"])

    trees: dict = {}
    for b in slices(batches, 256):
        for host, page, pivot in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if not page or not pivot:
                continue
            if len(trees) > 1000:
                trees.clear()
            tree = trees.get(host)
            if tree is None:
                tree = trees[host] = pickle.loads(pivot)
            root = parse(page)
            number(root)
            found = aligned(root, tree)
            if all(n.hash == h for n, _, h in found):
                continue  # the pivot itself or a copy of it tells nothing
            for n, p, h in found:
                c = seen.setdefault((host, p), [0, 0])
                c[0] += 1
                c[1] += n.hash == h
        if len(seen) > 200_000:
            yield out()
            seen.clear()
    if seen:
        yield out()


def _pages_texts(batches):
    """(host, page's texts as a hash, layout, paths, keys) of pages; paths and keys of all runs, for the host and for the layout."""
    for b in slices(batches, 256):
        rows = {}
        for host, page in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if not page:
                continue
            root = parse(page)
            number(root)
            runs = candidates(root)
            if runs:
                layout = _layout(runs)
                found = {(layout if k else 0, p, _key(layout if k else 0, p, n.text)) for n, p in runs for k in (0, 1)}
                rows[host, xxhash.xxh3_64_intdigest("\n".join(n.text for n, _ in runs)) >> 1, layout] = sorted(found)
        struct = pa.list_(pa.struct([("layout", pa.int64()), ("path", pa.int64()), ("key", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
             pa.array([[dict(zip(("layout", "path", "key"), x, strict=True)) for x in v] for v in rows.values()], struct)],
            ["host", "texts", "sort", "found"])


def _shared(rows: DataFrame) -> DataFrame:
    """``host, keys``: texts that nearly all differing pages with their path have there, in the host or in a layout."""
    pages = rows.mapInArrow(_pages_texts, "host string, texts long, sort long, found array<struct<layout:long,path:long,key:long>>") \
                .dropDuplicates(["host", "texts", "sort"])
    found = pages.select("host", F.explode("found").alias("x")).select("host", "x.*")
    n = found.groupBy("host", "layout", "path", "key").agg(F.count("*").alias("same")).filter(F.col("same") >= LEAST_PAGES)
    paths = pages.select("host", F.explode(F.array_distinct(F.transform("found", lambda x: F.struct(x["layout"].alias("layout"), x["path"].alias("path"))))).alias("x"))
    total = paths.groupBy("host", "x.layout", "x.path").agg(F.count("*").alias("n"))
    return (n.join(total, ["host", "layout", "path"]).filter(F.col("same") >= SAME_SHARE * F.col("n"))
             .groupBy("host").agg(F.collect_list("key").alias("keys")))


def _lookup(rows: DataFrame, dim: DataFrame, value: str) -> DataFrame:
    """Left join by host: broadcast below a measured size, else with hot hosts split."""
    size = dim.agg(F.sum(F.octet_length(value) + F.octet_length("host"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(dim.drop("pages")), "host", "left")
    return salted_lookup(rows, dim, "host", weight_col="pages", how="left", hot_share=1e-2).drop("pages")


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, url, text, n_chars`` for every page.

    A null or empty page has an empty text.  Pages without a host in their url
    have no wrapper, and so do hosts with fewer than ``LEAST_PAGES`` differing
    pages: only kinds and classes of elements tell there.  Repeated rows get
    the same text; ties of the smallest id are settled by the page itself.
    """
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("page"))
    rows = base.withColumn("host", F.when(_host() != "", _host()))
    pivots = (rows.filter("host is not null").select("host", F.col("id").cast("long"), "page")
                  .mapInArrow(_pivots, "host string, page_id long, pivot binary")
                  .groupBy("host").agg(F.min(F.struct("page_id", "pivot")).alias("x")).select("host", "x.pivot"))
    sizes = rows.filter("host is not null").groupBy("host").agg(F.count("*").alias("pages"))
    pivots = materialize(pivots.join(sizes, "host"))
    counts = (_lookup(rows.filter("host is not null").select("host", "page"), pivots, "pivot")
              .select("host", "page", "pivot").mapInArrow(_counts, "host string, node int, n long, same long")
              .groupBy("host", "node").agg(F.sum("n").alias("n"), F.sum("same").alias("same")))
    constant = (counts.filter((F.col("n") >= LEAST_PAGES) & (F.col("same") >= SAME_SHARE * F.col("n")))
                      .groupBy("host").agg(F.collect_list("node").alias("nodes")))

    def wrap(batches):
        for b in batches:
            w = [pickle.dumps((pickle.loads(p) if n else None, set(n or ()), frozenset(k or ())))
                 for p, n, k in zip(*(b.column(c).to_pylist() for c in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w, pa.binary()), b.column(4)], ["host", "wrapper", "pages"])

    wrappers = materialize(pivots.join(constant, "host", "left").join(_shared(rows.filter("host is not null").select("host", "page")), "host", "left")
                                 .filter("nodes is not null or keys is not null").select("host", "pivot", "nodes", "keys", "pages")
                                 .mapInArrow(wrap, "host string, wrapper binary, pages long"))
    id_type = dict(base.dtypes)["id"]

    def run(batches):
        for b in slices(batches, 256):
            text = [main_text(p, w) for p, w in zip(b.column("page").to_pylist(), b.column("wrapper").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(text, pa.string()),
                                              pa.array([len(t) for t in text], pa.int64())], ["id", "url", "text", "n_chars"])

    got = _lookup(rows, wrappers, "wrapper").select("id", "url", "page", "wrapper")
    return got.mapInArrow(run, f"id {id_type}, url string, text string, n_chars long") \
              .withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
