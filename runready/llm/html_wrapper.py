"""Main-text extraction by wrapper induction.

A page is parsed to a tree of its block elements (inline markup is text; siblings of one label that follow
each other become one repeated node).  Pages of a host are aligned by simple tree matching: the
order-keeping assignment of children with the most matched nodes, level by level.  The host's wrapper is the
merged tree.  Every page is laid over it, and Spark counts, exactly, in how many pages each node
stands and in how many of them each of its texts.  A text that stands in at least ``TEMPLATE_SHARE``
of a node's pages (``ARTICLE_SHARE`` inside the article, where pages may be copies of each other) and in
``MIN_PAGES`` of them is template; what varies is content.
Pages of a host that read the same without a wrapper (repeated rows, print or session URLs) count as one.

A page is then laid over its host's wrapper and yields the blocks that are not template and
lie in no element that names itself a menu, header, footer, sidebar, notice, advert, form or comment
section.  Where the page marks its article (``article`` or ``main``), only that is read.

Wrappers are merged like partial aggregates: one per host and partition, then per host and
one of ``MERGE_WAYS`` ways, then per host, so a host with a third of all pages burdens no task.
Their size does not grow with the pages: rare nodes beyond ``MAX_NODES`` go.  That loses no text:
an element that meets no wrapper node is counted by the labels that lead to it from the nearest one that does.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runready.llm.tables import stored

MIN_PAGES = 5
TEMPLATE_SHARE = 0.6
ARTICLE_SHARE = 0.9
MAX_NODES = 2_000
MAX_DEPTH = 100              # deeper elements are read as if they stood at this depth
MERGE_WAYS = 64
BATCH_ROWS = 64
TRIM_EVERY = 256             # merges into a wrapper between two cuts to MAX_NODES
HELD_COUNTS = 200_000        # counts that a task adds up before it sends them on

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIPPED = frozenset("script style noscript template iframe svg math object canvas head title select textarea option "
                     "button audio video map datalist".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt "
                    "ruby s samp small span strike strong sub sup time tt u var wbr".split())
_BOILERPLATE = frozenset("nav aside footer form menu dialog".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form "
                   "toolbar".split())
# words that name such an element in its class or id
_NAMES = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar "
                   "navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead topbar cookie cookies "
                   "consent gdpr notice notification alert popup modal overlay newsletter subscribe signup login "
                   "comment comments respond replies disqus discussion share sharing social related recommended "
                   "recommendations widget widgets pagination pager skip toolbar search searchbox copyright legal "
                   "disclaimer paywall toc".split())
_ARTICLE = frozenset(("article", "main"))
# elements whose start tag ends an open one
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
           "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"},
           "tfoot": {"tbody", "tr", "td", "th"}}
_SCOPES = frozenset("html body table td th ul ol dl article main section div nav aside footer header form "
                    "blockquote".split())
_WORDS = re.compile(r"[a-z]+")
# elements that stand in a head, and skipped elements that end without an end tag of their own
_IN_HEAD = frozenset("title meta link style script base noscript template".split())
_ENDS_ALONE = frozenset("head title option script style".split())


class Node:
    """An element; ``label`` is what alignment compares, ``texts`` the blocks that stand in it."""
    __slots__ = ("tag", "label", "skipped", "boilerplate", "article", "children", "texts")

    def __init__(self, tag: str, label: str, skipped: bool = False, boilerplate: bool = False, article: bool = False):
        self.tag, self.label, self.skipped, self.boilerplate, self.article = tag, label, skipped, boilerplate, article
        self.children: list[Node] = []
        self.texts: list[tuple[int, str]] = []       # place on the page, text


def _names_boilerplate(tag: str, attrs: dict, in_article: bool) -> bool:
    if tag in _BOILERPLATE or tag == "header" and not in_article or (attrs.get("role") or "").lower() in _ROLES:
        return True
    if tag in ("html", "body") or tag in _ARTICLE:
        return False
    named = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower()
    return any(w in _NAMES for w in _WORDS.findall(named))


def _skips(events: list[tuple[str, str, list]]) -> dict[int, int]:
    """For each skipped element that ends: the event it starts with and the first one after it.

    A head ends at the first thing that cannot stand in it, a title at a block element, an option at the
    next one or at a block element; these, scripts and styles also end with the element around them.
    """
    out: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    depth: Counter = Counter()           # open elements by tag

    def leave(at: int) -> None:
        tag, start = stack.pop()
        depth[tag] -= 1
        if tag in _ENDS_ALONE:
            out[start] = at

    for k, (kind, what, _) in enumerate(events):
        if kind == "text":
            if stack and stack[-1][0] == "head" and what.strip():
                leave(k)
        elif kind == "end":
            if depth[what]:
                while stack[-1][0] != what:
                    leave(k)
                out[stack[-1][1]] = k + 1
                stack.pop()
                depth[what] -= 1
        else:
            block = what not in _INLINE and what not in _SKIPPED and what not in _VOID
            if stack and (stack[-1][0] == "title" and depth["head"] and block
                          or stack[-1][0] == "option" and (block or what == "option")):
                leave(k)
            if stack and stack[-1][0] == "head" and what not in _IN_HEAD:
                leave(k)
            if what not in _VOID and (what not in _INLINE or what in _SKIPPED):
                stack.append((what, k))
                depth[what] += 1
    while stack:
        leave(len(events))
    return out


class _Parser(HTMLParser):
    """Builds the block tree of a page; unclosed and misplaced tags are repaired, no text is lost.

    The page is read to a list of events first: a skipped element reaches to its own end tag, and one
    that has none (``_skips``) takes nothing with it.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", "#root")
        self.open = [self.root]
        self.events: list[tuple[str, str, list]] = []       # kind, tag or text, attributes
        self.text: list[str] = []
        self.place = 0

    def flush(self) -> None:
        """End the block: white space becomes single spaces."""
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if text:
            self.open[-1].texts.append((self.place, text))
            self.place += 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.events.append(("start", tag, attrs))

    def handle_endtag(self, tag: str) -> None:
        self.events.append(("end", tag, []))

    def handle_data(self, data: str) -> None:
        self.events.append(("text", data, []))

    def build(self) -> None:
        skips, k = _skips(self.events), 0
        while k < len(self.events):
            kind, what, attrs = self.events[k]
            if kind == "text":
                self.text.append(what)
            elif kind == "end":
                self._end(what)
            elif what in _SKIPPED:
                self.flush()
                k = skips.get(k, k + 1)
                continue
            else:
                self._start(what, attrs)
            k += 1
        self.flush()

    def _start(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.text.append(" ")
        if tag in _INLINE:
            return
        self.flush()
        if tag in _VOID:
            return
        if tag not in ("li", "td", "th", "tr", "dd", "dt"):
            self._close({"p"})
        if tag in _CLOSES:
            self._close({"p"} | _CLOSES[tag])
        top = self.open[-1]
        given = {k: v for k, v in attrs if k in ("class", "id", "role")}
        label = tag + "".join(f".{c}" for c in sorted((given.get("class") or "").split()))
        node = Node(tag, label, boilerplate=top.boilerplate or _names_boilerplate(tag, given, top.article),
                    article=top.article or tag in _ARTICLE or (given.get("role") or "").lower() == "main")
        top.children.append(node)
        if len(self.open) < MAX_DEPTH:
            self.open.append(node)
        else:
            self.open[-1] = node             # beyond MAX_DEPTH elements stand side by side

    def _close(self, tags: set[str]) -> None:
        """Close open elements of ``tags`` up to the nearest element that scopes them."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                self.flush()
                del self.open[k:]
                return self._close(tags)
            if self.open[k].tag in _SCOPES:
                return

    def _end(self, tag: str) -> None:
        if tag in _SKIPPED or tag in _INLINE:
            return
        self.flush()
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return


def _joined(children: list[Node]) -> list[Node]:
    """Neighbouring siblings of one label as one repeated node."""
    out: list[Node] = []
    for c in children:
        if out and out[-1].label == c.label and out[-1].boilerplate == c.boilerplate:
            out[-1].texts += c.texts
            out[-1].children += c.children
        else:
            out.append(c)
    return out


def parse(html: str | None) -> Node:
    """The block tree of a page (null: an empty tree)."""
    p = _Parser()
    p.feed(html or "")
    p.close()
    p.build()
    todo = [p.root]
    while todo:
        node = todo.pop()
        node.children = _joined(node.children)
        todo += node.children
    return p.root


# A tree node is [label, pages, held, children]: trees are sent between tasks as JSON.  A page holds its text
# hashes, a wrapper nothing.

def text_hash(text: str) -> str:
    return f"{zlib.crc32(text.encode('utf-8', 'surrogatepass')):x}.{len(text):x}"


def as_tree(node: Node, held: Callable[[Node], object]) -> list:
    """The tree of a single page."""
    return [node.label, 1, held(node), [as_tree(c, held) for c in node.children]]


def _hashes(node: Node) -> list[str]:
    """Texts that may be template; those of boilerplate elements are never read."""
    return [] if node.boilerplate else sorted({text_hash(t) for _, t in node.texts})


def bare(page: list) -> list:
    """The wrapper of a single page."""
    return [page[0], page[1], [], [bare(c) for c in page[3]]]


def _match(a: list, b: list, weights: dict) -> int:
    """Simple tree matching: nodes in the largest top-down matching of two trees that keeps order (0: other labels)."""
    if a[0] != b[0]:
        return 0
    found = weights.get((id(a), id(b)))
    if found is None:
        x, y = a[3], b[3]
        row = [0] * (len(y) + 1)
        for c in x:
            above, row = row, [0]
            for j, d in enumerate(y):
                row.append(max(above[j + 1], row[j], above[j] + _match(c, d, weights)))
        found = weights[id(a), id(b)] = row[-1] + 1
    return found


def aligned(x: list, y: list, weights: dict) -> list[tuple[int, int]]:
    """Index pairs of the best order-keeping matching of two lists of trees."""
    table = [[0] * (len(y) + 1)]
    for c in x:
        above, row = table[-1], [0]
        for j, d in enumerate(y):
            row.append(max(above[j + 1], row[j], above[j] + _match(c, d, weights)))
        table.append(row)
    i, j, pairs = len(x), len(y), []
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


def merge(w: list, p: list, weights: dict | None = None) -> None:
    """Merge the aligned tree ``p`` (same label) into the wrapper ``w``."""
    weights = {} if weights is None else weights
    w[1] += p[1]
    pairs = aligned(w[3], p[3], weights)
    out, at = [], 0
    of = {j: i for i, j in pairs}
    for j, child in enumerate(p[3]):
        if j in of:
            out += w[3][at:of[j] + 1]
            at = of[j] + 1
            merge(out[-1], child, weights)
        else:
            out.append(child)               # an optional node, kept in its place
    w[3] = out + w[3][at:]


def _cut(w: list, least: int) -> None:
    """Drop the nodes of ``least`` pages or fewer."""
    w[3] = [c for c in w[3] if c[1] > least]
    for c in w[3]:
        _cut(c, least)


def trimmed(w: list) -> list:
    """Drop the rarest nodes while the wrapper has more than ``MAX_NODES``."""
    def sizes(n: list) -> Iterator[int]:
        yield n[1]
        for c in n[3]:
            yield from sizes(c)

    met = sorted(sizes(w), reverse=True)
    if len(met) > MAX_NODES:
        _cut(w, met[MAX_NODES])
    return w


def _key(path: str) -> int:
    return int.from_bytes(hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=8).digest(), signed=True)


def placed(page: list, wrapper: list) -> Iterator[tuple[object, int, bool, list]]:
    """What each node of ``page`` holds, the key of its place in the host's wrapper, whether that lies in
    an article, and the list of nodes to go on with (a caller may empty it).

    A node that is aligned has the key of the wrapper's node, another one that of its labels below the nearest aligned one.
    """
    weights: dict = {}
    todo = [(page, wrapper, "", False)]
    while todo:
        node, at, path, article = todo.pop()
        article = article or node[0].split(".")[0] in _ARTICLE
        of = {j: i for i, j in aligned(at[3], node[3], weights)} if at else {}
        below = [(c, at[3][of[j]], f"{path}.{of[j]}", article) if j in of else (c, None, f"{path}/{c[0]}", article)
                 for j, c in enumerate(node[3])]
        yield node[2], _key(path), article, below
        todo += below


def _read(root: Node, wrapper: list | None) -> Iterator[tuple[Node, int, list]]:
    if wrapper:
        for node, key, _, below in placed(as_tree(root, lambda n: n), wrapper):
            yield node, key, below
        return
    todo = [root]
    while todo:
        node = todo.pop()
        yield node, 0, (below := list(node.children))
        todo += below


def main_text(html: str | None, wrapper: list | None, template: set[tuple[int, str]] = frozenset()) -> str:
    """The content blocks of a page in page order, one per line; ``template`` has the place and hash of each template text."""
    return _content(parse(html), wrapper, template)


def _content(root: Node, wrapper: list | None, template: set[tuple[int, str]] = frozenset()) -> str:
    blocks: list[tuple[int, str, bool]] = []
    any_article = False
    for node, key, below in _read(root, wrapper):
        if node.boilerplate:
            below.clear()
            continue
        for place, text in node.texts:
            any_article |= node.article
            if not template or (key, text_hash(text)) not in template:
                blocks.append((place, text, node.article))
    return "\n".join(text for _, text, inside in sorted(blocks) if inside or not any_article)


def _trees(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for host, html in zip(part["host"], part["html"], strict=True):
            root = parse(html)
            read = hashlib.blake2b(_content(root, None).encode("utf-8", "surrogatepass"), digest_size=16).digest()
            rows.append((host, read, json.dumps(as_tree(root, _hashes), separators=(",", ":"))))
        yield pd.DataFrame(rows, columns=["host", "read", "page"])


def _partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    wrappers: dict[str, list] = {}
    merges: Counter = Counter()
    way = 0
    for part in parts:
        for host, page in zip(part["host"], part["page"], strict=True):
            way = zlib.crc32(page.encode("utf-8", "surrogatepass"), way)
            if host in wrappers:
                merge(wrappers[host], bare(json.loads(page)))
                merges[host] += 1
                if merges[host] % TRIM_EVERY == 0:
                    trimmed(wrappers[host])
            else:
                wrappers[host] = bare(json.loads(page))
    yield pd.DataFrame([(h, way % MERGE_WAYS, json.dumps(trimmed(w))) for h, w in wrappers.items()],
                       columns=["host", "way", "wrapper"])


def _merged(part: pd.DataFrame) -> pd.DataFrame:
    trees = [json.loads(w) for w in sorted(part["wrapper"])]
    for t in trees[1:]:
        merge(trees[0], t)
        trimmed(trees[0])
    return pd.DataFrame({"host": part["host"].iloc[:1], "wrapper": [json.dumps(trimmed(trees[0]))]})


def _final(part: pd.DataFrame) -> pd.DataFrame:
    merged = _merged(part)
    tree = json.loads(merged["wrapper"].iloc[0])
    _cut(tree, MIN_PAGES - 1)
    merged["wrapper"] = [json.dumps(tree, separators=(",", ":"))]
    return merged


_COUNTS = "host string, node long, article boolean, text string, n long"


def _counts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages of every node (a null text) and of every text in it."""
    counts: Counter = Counter()

    def rows() -> pd.DataFrame:
        return pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["host", "node", "article", "text", "n"])

    last, wrapper = None, None
    for part in parts:
        for host, page, tree in zip(part["host"], part["page"], part["wrapper"], strict=True):
            if tree != last:
                last, wrapper = tree, json.loads(tree)
            found = set()
            for texts, key, article, _ in placed(json.loads(page), wrapper):
                found.add((host, key, article, None))
                found.update((host, key, article, t) for t in texts)
            counts.update(found)
            if len(counts) > HELD_COUNTS:
                yield rows()
                counts.clear()
    yield rows()


def induce(pages: DataFrame) -> DataFrame:
    """``host, wrapper``: the wrapper and the template texts of every host of ``pages(host, html)`` that has some."""
    schema = "host string, wrapper string"
    read = (pages.where("host is not null").select("host", "html")
            .mapInPandas(_trees, "host string, read binary, page string"))
    # one page of those that read the same: the first tree in order
    trees = stored(read.groupBy("host", "read").agg(F.min("page").alias("page")).select("host", "page"), "page-trees")
    wrappers = stored(trees.mapInPandas(_partial, "host string, way int, wrapper string")
                      .groupBy("host", "way").applyInPandas(_merged, schema)
                      .groupBy("host").applyInPandas(_final, schema), "host-trees")
    counts = (trees.join(wrappers, "host").mapInPandas(_counts, _COUNTS)
              .groupBy("host", "node", "article", "text").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_PAGES))
    counts = stored(counts, "text-pages")
    met = counts.where("text is null").select("host", "node", F.col("n").alias("pages"))
    share = F.when(F.col("article"), F.lit(ARTICLE_SHARE)).otherwise(F.lit(TEMPLATE_SHARE))
    texts = (counts.where("text is not null").join(met, ["host", "node"]).where(F.col("n") >= share * F.col("pages"))
             .groupBy("host").agg(F.sort_array(F.collect_list(F.struct("node", "text"))).alias("texts")))
    return texts.join(wrappers, "host").select("host", F.to_json(F.struct("wrapper", "texts")).alias("wrapper"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``.

    A null html is an empty page and gives an empty text; a page without a host in its url is read
    without a wrapper; repeated rows and ids give a row each.  Whole pages are read, other columns are not.
    """
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", F.nullif(host, F.lit("")))
    templates = stored(induce(rows), "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, wrapper, template = None, None, frozenset()
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch, texts = whole.slice(at, BATCH_ROWS), []
                for html, found in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
                    if found != last:
                        last, wrapper, template = found, None, frozenset()
                        if found:
                            read = json.loads(found)
                            wrapper = json.loads(read["wrapper"])
                            template = {(t["node"], t["text"]) for t in read["texts"]}
                    texts.append(main_text(html, wrapper, template))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    # Spark broadcasts the templates if they are small, or splits the pages of a large host
    return (rows.join(templates, "host", "left").select("page_id", "url", "html", "wrapper")
            .mapInArrow(run, "page_id long, url string, text string, n_chars long"))


__all__ = ["extract", "induce", "parse", "merge", "main_text", "placed", "as_tree", "bare", "aligned"]
