"""Main text of web pages by wrapper induction.

Per host and page layout (the containers around and in the content) a bounded sample of pages (``PAGES``) is
aligned: DOM trees are merged one by one into a wrapper
tree by simple tree matching (the largest order-preserving match of equal tags, children by dynamic
programming).  A wrapper node whose text is the same on all pages is template; one that varies is a slot.
The content is the smallest node that holds all varying text outside of navigation, headers, footers,
asides, forms, adverts, notices and comments (an <article> or <main> is taken whole; blocks beside it and
lists of entries beside a container named as content are not article text); inside the content, single
nodes of constant text that are no running text are template too.

A page is extracted by its layout's wrapper: the content node is found by its path, and its blocks are read
in page order without the parts named above.  Pages that the path does not fit, or that hold other text
beside that node than the wrapper's template, are read by the same rule on the page alone.

White space inside a block becomes one space, blocks are trimmed and joined by one line feed; character
references are decoded.  Null and empty html give the empty text.  A null or odd url is a host of its own
name (empty).  Rows are independent given the sample, which goes by the pages' contents: ids may repeat or be
missing; copies of a page are one.  Trees may have any depth.
"""

from __future__ import annotations

import functools
import hashlib
import html as _html
import json
import re
import sys

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lanecraft.llm.common import grouped, sized, stage
from lanecraft.llm.dom import BLOCK, RAW, Node, parse

PAGES = 12
MIN_CONSTANT = 4
#: Trees of any depth are walked by plain recursion, which takes no C stack.
DEEP = 1 << 24

# fixed values: elements that never hold article text, and words of class, id and role that mark such parts
SKIP_TAGS = frozenset("""head nav header footer aside form script style noscript template iframe button select input textarea menu dialog
svg canvas object embed audio video map search title link meta""".split())
SKIP_WORDS = frozenset("""nav navbar navigation menu header masthead banner footer contentinfo sidebar aside complementary ad ads advert
adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent notice notices alert popup modal dialog
overlay comment comments reply replies respond disqus discussion share sharing social related recommended breadcrumb breadcrumbs
pagination pager toolbar subscribe subscription newsletter signup login search form widget widgets skip hidden toc copyright""".split())
CONTENT_TAGS = frozenset(["article", "main"])
_CONTAINERS = frozenset("div section ul ol dl table nav aside form figure fieldset details center".split())
_TEXTS = frozenset("h1 h2 h3 h4 h5 h6 hgroup p pre blockquote".split())
_INNER_HEADER = frozenset(["header"])
_OWN_HEADER = frozenset("content article post entry story".split())
_CONTENT_WORDS = _OWN_HEADER | {"articlebody", "main"}
#: Elements of running text: what they hold is part of the article, on however many pages it stands.
_READ = _TEXTS | frozenset("li dt dd td th caption figcaption em strong b i u mark q cite code span sub sup time address".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_PAGE = frozenset(["#root", "html", "body"])
_FRAME = frozenset("html body div section article main center".split())
_ENTRIES = frozenset("div section article dl table".split())
# fixed values: first parts of words that tell what a page has or lacks, not what an element is
_STATES = frozenset("has have with without no not is".split())


def encloses(node: Node) -> bool:
    """The element lies around an article, whatever its words say: it holds a <main>, the one <article> in it that no
    word marks as another part, or the page's headline with paragraphs."""
    if node.around is None:
        articles = headlines = paragraphs = 0
        todo = [k for k in node.kids if isinstance(k, Node)]
        main = False
        while todo:
            k = todo.pop()
            main = main or k.tag == "main"
            articles += k.tag == "article" and not _word_marks(k, k.words)
            headlines += k.tag == "h1"
            paragraphs += k.tag == "p"
            todo += [x for x in k.kids if isinstance(x, Node)]
        node.around = main or articles == 1 or headlines > 0 and paragraphs > 1
    return node.around


def _word_marks(node: Node, words) -> bool:
    """A listed word, or one at the end of a compound (site-footer, comment-list), is among the words."""
    for w in words:
        if w in SKIP_WORDS:
            return True
        parts = re.split(r"[-_#]+", w) if node.tag not in _TEXTS else []
        for end in (parts[0], parts[-1]) if len(parts) > 1 and parts[0] not in _STATES else ():
            if end in SKIP_WORDS and not (end == "header" and _OWN_HEADER & set(parts)):
                return True
    return False


def skipped(node: Node, inside: bool = False) -> bool:
    """Not article text by its element or the words of its class, id or role.  The words of the page and of an
    element around an article describe the layout and drop nothing.  An article's own <header>
    holds its heading.  Inside an article only containers go by a word, and only by a whole one; the ids of
    sections there, and of headings and paragraphs anywhere, are anchors."""
    if node.tag in _PAGE:
        return False
    if node.tag in SKIP_TAGS and not (inside and node.tag in _INNER_HEADER) or "[hidden]" in node.words:
        return True
    if inside:
        words = node.marks if node.tag == "section" or "section" in node.marks else node.words
        return node.tag in _CONTAINERS and any(w in SKIP_WORDS and w != "header" for w in words)
    return _word_marks(node, node.marks if node.tag in _TEXTS else node.words) and not encloses(node)


def named(node: Node) -> bool:
    """An element of content by its tag or the words of its class, id or role."""
    return node.tag in CONTENT_TAGS or any(_CONTENT_WORDS & set(re.split(r"[-_#]+", w)) for w in node.words)


def holds(node: Node) -> bool:
    """What lies under it is inside an article: a <header> there is the article's own."""
    return node.tag not in ("#root", "html", "body") and named(node)


def plain(node: Node, inside: bool = True, dropped=None, path: str = "") -> list[str]:
    """Blocks of text under a node in page order, white space folded, references decoded.  ``inside``: the
    node lies in an article."""
    blocks: list[str] = []
    run: list[str] = []

    def close():
        if run:
            text = " ".join(_html.unescape("".join(run)).split())
            if text:
                blocks.append(text)
            run.clear()

    todo: list = [(node, path, True, inside)]
    while todo:
        item, at, first, inner = todo.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            run.append(item)
        elif not first and (skipped(item, inner) or item.tag in RAW):
            run.append(" ")
        elif item.tag in ("br", "wbr"):
            run.append(" " if item.tag == "br" else "")
        else:
            block = item.tag in BLOCK or first
            if dropped and not first and dropped.get(at) is not None and dropped[at] == " ".join(plain(item)):
                close() if block else run.append(" ")
                continue
            if block:
                close()
                todo.append((None, "", False, inner))
            inner = inner or holds(item)
            todo += [(k, below(at, k.sig) if dropped and isinstance(k, Node) else "", False, inner) for k in reversed(item.kids)]
    close()
    return blocks


class Shape:
    """A wrapper node: pages seen, their texts, and children; ``many``: a run of siblings with one signature."""

    __slots__ = ("node", "sig", "many", "texts", "kids", "mass", "seen")

    def __init__(self, node: Node, many: int, text: str, mass: int):
        self.node, self.sig, self.many, self.mass, self.seen = node, node.sig, many > 1, mass, 1
        self.texts = {text}
        self.kids: list[Shape] = []


def shape(node: Node) -> Shape:
    """The shape of one page: runs of equal siblings become one child without children."""
    own = " ".join(_html.unescape("".join([k if isinstance(k, str) else " " for k in node.kids])).split())
    s = Shape(node, 1, own, len(own))
    kids = [k for k in node.kids if isinstance(k, Node)]
    i = 0
    while i < len(kids):
        j = i
        while j < len(kids) and kids[j].sig == kids[i].sig:
            j += 1
        if j - i > 1:
            text = "\n".join(t for k in kids[i:j] for t in plain(k))
            s.kids.append(Shape(kids[i], j - i, text, len(text)))
        else:
            s.kids.append(shape(kids[i]))
        i = j
    return s


def match(a: Shape, b: Shape, memo: dict) -> int:
    """Simple tree matching: the size of the largest order-preserving match with equal signatures."""
    if a.sig != b.sig:
        return 0
    key = (id(a), id(b))
    if key not in memo:
        row = [0] * (len(b.kids) + 1)
        for x in a.kids:
            new = [0]
            for j, y in enumerate(b.kids):
                new.append(max(row[j + 1], new[j], row[j] + match(x, y, memo)))
            row = new
        memo[key] = row[-1] + 1
    return memo[key]


def merge(a: Shape, b: Shape, memo: dict) -> None:
    """Merge page shape b into wrapper a (equal signatures): matched children merge, others are inserted."""
    a.seen += b.seen
    a.texts |= b.texts
    a.mass += b.mass
    a.many |= b.many
    n, m = len(a.kids), len(b.kids)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + match(a.kids[i], b.kids[j], memo))
    out: list[Shape] = []
    i, j = n, m
    while i or j:
        w = match(a.kids[i - 1], b.kids[j - 1], memo) if i and j else 0
        if w and best[i][j] == best[i - 1][j - 1] + w:
            merge(a.kids[i - 1], b.kids[j - 1], memo)
            out.append(a.kids[i - 1])
            i, j = i - 1, j - 1
        elif j and (not i or best[i][j] == best[i][j - 1]):
            j -= 1
            out.append(b.kids[j])
        else:
            i -= 1
            out.append(a.kids[i])
    a.kids = out[::-1]


def below(path: str, sig: str) -> str:
    """The name of a child's path: of one length at any depth."""
    return hashlib.blake2b(f"{path}/{sig}".encode("utf-8", "replace"), digest_size=12).hexdigest()


def layout(tree: Node) -> str:
    """Digest of the paths of a page's containers, boilerplate parts and the inside of articles left out."""
    paths = set()
    todo = [(tree, "", False)]
    while todo:
        node, path, inside = todo.pop()
        inner = inside or holds(node)
        for k in node.kids:
            if isinstance(k, Node) and k.tag in _FRAME and not skipped(k, inner):
                paths.add(at := below(path, k.sig))
                if k.tag not in CONTENT_TAGS:
                    todo.append((k, at, inner))
    return hashlib.blake2b("\n".join(sorted(paths)).encode("utf-8", "replace"), digest_size=12).hexdigest()


def _constant(s: Shape, pages: int) -> bool:
    return pages > 1 and s.seen == pages and len(s.texts) == 1


def _varying(s: Shape, pages: int, memo: dict, inside: bool, template: dict | None = None, path: str = "") -> int:
    """Characters of varying text at or under a node, boilerplate parts and the texts of ``template`` (by path)
    left out."""
    if id(s) not in memo:
        known = template and not s.texts.isdisjoint(template.get(path, ()))
        inner = inside or holds(s.node)
        n = 0 if known or _constant(s, pages) else s.mass
        for k in s.kids:
            if not skipped(k.node, inner):
                n += _varying(k, pages, memo, inner, template, below(path, k.sig) if template else "")
        memo[id(s)] = n
    return memo[id(s)]


def _entries(s: Shape, memo: dict) -> bool:
    """All varying text lies in runs of equal containers: replies, teasers."""
    runs = sum(memo.get(id(k), 0) for k in s.kids if k.many and k.node.tag in _ENTRIES)
    return not s.many and not named(s.node) and runs == memo.get(id(s), 0)


def _alone(s: Shape, k: Shape, target: Shape, memo: dict) -> bool:
    """No varying text of ``s`` outside its child ``k`` belongs to the content ``target`` (at or under k)."""
    rest = [x for x in s.kids if x is not k and memo.get(id(x), 0)]
    if memo.get(id(s), 0) > memo.get(id(k), 0) + sum(memo[id(x)] for x in rest):  # text of its own
        return False
    if target.node.tag in CONTENT_TAGS:
        return not any(named(x.node) or _heading(x) for x in rest)
    return named(target.node) and all(_entries(x, memo) for x in rest) or not rest


def _under_article(path: list) -> bool:
    """The path leads through an <article> or <main>."""
    return any(sig.split(".")[0] in CONTENT_TAGS for sig, _ in path)


def _heading(s: Shape) -> bool:
    """A heading, or a block with the page's first one."""
    todo = [s]
    while todo:
        x = todo.pop()
        if x.node.tag == "h1" or x is s and x.node.tag in _HEADINGS:
            return True
        todo += [k for k in x.kids if k.node.tag == "h1" or k.node.tag not in _HEADINGS]
    return False


def induce(pages: list[str]) -> dict:
    """{"path": [[signature, nth], ...] of the content node, "constant": {path: text} of single template nodes,
    "template": {path: texts} of what is the same on all pages outside of the content node}"""
    trees, seen = [], set()
    for page in pages:
        tree = parse(page)
        text = "\n".join(plain(tree, False))
        if text not in seen:  # copies would make content look constant
            seen.add(text)
            trees.append(shape(tree))
    if not trees:
        return {"path": [], "constant": {}, "template": {}}
    wrapper = trees[0]
    for t in trees[1:]:
        merge(wrapper, t, {})
    return _content(wrapper, len(trees))


def _beside(node: Node, before: bool) -> bool:
    """Structure of template text inside the content: an element of no running text, or one ``before`` the headline."""
    return node.tag not in _READ or before and node.tag not in _HEADINGS


def _content(wrapper: Shape, pages: int, known: dict | None = None) -> dict:
    memo: dict = {}
    at, path, inside = wrapper, [], False
    whole = _varying(wrapper, pages, memo, False, known)

    def steps(s: Shape):
        count: dict[str, int] = {}
        for k in s.kids:
            nth = count.get(k.sig, 0)
            count[k.sig] = nth + 1
            if not skipped(k.node, inside) and not k.many and k.kids + [x for x in k.texts if x]:
                yield k, nth

    def marked(s: Shape):  # named as content, with most of the varying text and none of it beside
        for k, nth in steps(s):
            if named(k.node) and 2 * memo.get(id(k), 0) >= whole > 0 and _alone(s, k, k, memo):
                return [(k, nth)]
            deeper = marked(k)
            if deeper and _alone(s, k, deeper[-1][0], memo):
                return [(k, nth), *deeper]
        return None

    while at.node.tag not in CONTENT_TAGS:
        jump = marked(at)
        if jump:
            path += [[k.sig, nth] for k, nth in jump]
            inside = inside or any(holds(k.node) for k, _ in jump)
            at = jump[-1][0]
            continue
        total = memo.get(id(at), 0)
        step = next(((k, nth) for k, nth in steps(at) if k.node.tag not in ("p", "pre", "table", "ul", "ol") and k.node.tag in BLOCK
                     and memo.get(id(k), 0) == total > 0), None)
        if step is None:
            break
        path.append([step[0].sig, step[1]])
        at = step[0]
        inside = inside or holds(at.node)
    constant: dict[str, str] = {}
    template: dict[str, list[str]] = {}
    # outside of <article> and <main> a line of every page before the headline is the site's
    before = at.node.tag not in CONTENT_TAGS and not _under_article(path) and _heading(at)

    def collect(s: Shape, here: str, outside: bool, inner: bool, within: bool = False):
        nonlocal before
        outside, within = outside and s is not at, within or s is at
        before = before and not (within and s.node.tag in _HEADINGS)
        if outside and _constant(s, pages) and any(s.texts):
            template.setdefault(here, []).extend(s.texts)
        for k in s.kids:
            there = below(here, k.sig)
            if not k.many and not k.kids and _constant(k, pages) and pages >= MIN_CONSTANT and any(k.texts) and _beside(k.node, before and within):
                constant[there] = next(iter(k.texts))
            if not k.many or outside:
                deeper = inner or holds(k.node)
                collect(k, there, outside and not skipped(k.node, inner), deeper, within)

    collect(wrapper, "", True, holds(wrapper.node))
    return {"path": path, "constant": constant, "template": template}


def extract(page: str, wrapper: dict) -> str:
    tree = parse(page)
    whole = shape(tree)
    path, template = wrapper["path"], wrapper.get("template") or {}
    if not path or not _fits(whole, path, template):
        path = _content(whole, 1, template)["path"]
    node = _find(tree, path)
    if node is None:
        node, path = tree, []
    return "\n".join(plain(node, _within(tree, node), wrapper["constant"], functools.reduce(below, (sig for sig, _ in path), "")))


def _fits(page: Shape, path: list, template: dict) -> bool:
    """The page has the path's node, no text of the article lies beside it, and it holds most of the page's own text."""
    memo: dict = {}
    whole = _varying(page, 1, memo, False, template)
    chain = [page]
    for sig, nth in path:
        same = [k for k in chain[-1].kids if k.sig == sig]
        if nth >= len(same) or same[nth].many:
            return False
        chain.append(same[nth])
    return 2 * memo.get(id(chain[-1]), 0) >= whole and all(_alone(s, k, chain[-1], memo) for s, k in zip(chain, chain[1:]))


def _within(tree: Node, node: Node) -> bool:
    """The node or one above it holds an article."""
    todo = [(tree, holds(tree))]
    while todo:
        at, inside = todo.pop()
        if at is node:
            return inside
        todo += [(k, inside or holds(k)) for k in at.kids if isinstance(k, Node)]
    return False


def _find(tree: Node, path: list) -> Node | None:
    for sig, nth in path:
        same = [k for k in tree.kids if isinstance(k, Node) and k.sig == sig]
        runs = []  # the wrapper counts runs of equal siblings once
        last = None
        for k in (k for k in tree.kids if isinstance(k, Node)):
            if k.sig == sig and last != sig:
                runs.append(k)
            last = k.sig
        if not same or nth >= len(runs):
            return None
        tree = runs[nth]
    return tree


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = PAGES) -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars."""
    host = F.coalesce(F.regexp_extract(F.lower(F.coalesce(F.col(url_col), F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    kind = rows.schema["id"].dataType.simpleString()

    rows = rows.withColumn("digest", F.unhex(F.md5("html")))

    def place(batches):
        sys.setrecursionlimit(DEEP)
        for batch in grouped(batches, "html"):
            found = pa.array([layout(parse(page)) for page in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["host", "digest", "layout"])

    # the layout of every page, by its host and content: copies of a page (and repeated ids) are one
    framed = stage(rows.select("host", "digest", "html").mapInArrow(place, "host string, digest binary, layout string").distinct(), "layouts")
    w = Window.partitionBy("host", "layout").orderBy("digest")
    picked = stage(framed.withColumn("k", F.row_number().over(w)).where(F.col("k") <= sample).select("host", "digest", "layout"), "sampled")
    # broadcast if its checked size allows
    chosen = rows.where("html <> ''").join(sized(picked, 96), ["host", "digest"]).groupBy("host", "layout", "digest").agg(F.min("html").alias("html"))
    grouped_ = chosen.groupBy("host", "layout").agg(F.collect_list("html").alias("pages"))  # at most `sample` pages a layout

    def learn(batches):
        sys.setrecursionlimit(DEEP)
        for batch in batches:
            found = [json.dumps(induce(sorted(p)[:2 * sample])) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["host", "layout", "wrapper"])

    wrappers = stage(grouped_.mapInArrow(learn, "host string, layout string, wrapper string"), "wrappers")
    # hosts and layouts have few wrappers; pages find theirs by content, without being parsed for it again
    known_ = framed.join(sized(wrappers.select("host", "layout", F.xxhash64("host", "layout").alias("which")), 64), ["host", "layout"]).select("host", "digest", "which")
    joined = rows.join(sized(stage(known_, "known"), 64), ["host", "digest"], "left") \
        .join(sized(wrappers.select(F.xxhash64("host", "layout").alias("which"), "wrapper"), 96, "wrapper"), ["which"], "left")
    joined = joined.select("id", "url", "wrapper", "html")

    def read(batches):
        sys.setrecursionlimit(DEEP)
        known: dict = {}
        for batch in grouped(batches, "html"):
            text = []
            for wrapper, page in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if wrapper not in known:
                    if len(known) > 4096:
                        known.clear()
                    known[wrapper] = json.loads(wrapper) if wrapper else {"path": [], "constant": {}}
                text.append(extract(page, known[wrapper]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())],
                                             names=["id", "url", "text", "n_chars"])

    return joined.mapInArrow(read, f"id {kind}, url string, text string, n_chars bigint").withColumnRenamed("id", id_col)
