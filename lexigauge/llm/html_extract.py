"""Main text of web pages by site template removal.

A page is parsed into its element tree. Each element's subtree has a hash over its tags and texts; Spark counts the
distinct pages of a host that have a subtree, and subtrees that recur across many pages of the host are its template:
they are deleted. What remains of the page's articles is its text, else of its main element, else of its body.

What counting decides, by the distinct pages of a host (pages whose html is equal count once):

* a subtree outside articles goes if at least LEAST pages and SHARE of the host have it. On a large host SHARE would keep
  a section's menu or one of many notices, so there a count is enough that grows with the logarithm of the host's pages
  (needed()). Only texts of less than WORDY characters still need SHARE, as short ones, like the cells of tables, recur
  by chance. What leads to an article is never template itself;
* a block inside an article goes if LEAST pages and INSIDE of the host have it in an article and nothing but such blocks
  is before or after it in its article: what recurs between a page's own words is a quotation, and an article that
  recurs as a whole is a copied one;
* an element whose class or id names a part of a page that is not its text (an advert, a sidebar, comments, ...) goes if
  that name recurs on LEAST pages of the host, whatever the element says there. Names of a layout ("no-sidebar",
  "has-banner") are no such names, and an element with more than half of the page's text is not such a part, unless it is
  named for comments. Only where a host has fewer than LEAST pages, so that nothing can recur, the name alone decides.

Elements that HTML itself sets apart (navigation, asides, footers, forms, scripts, hidden ones, and such roles) go always.

Blocks are separated by block elements; inside a block white space turns into one space; blocks are joined by a blank
line in page order. Character references are decoded once, after the markup is gone.

Defined cases: null or empty html gives an empty text; null urls form one host of their own; html that breaks off inside
a tag or a comment loses that piece; unclosed elements end with their parent, and end tags of what is not open are
nothing; very long and very deep pages are read whole, without recursion, in time proportional to their length; repeated
pages keep a row each; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches, text_of

LEAST = 5
SHARE, INSIDE = 0.2, 0.5
WORDY = 16
PARTS = 32

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body br-block caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset("head nav aside footer form script style noscript template iframe object svg canvas button select textarea title menu dialog audio video noembed noframes map xmp input label option".split())
#: Start tags that end an open p.
ENDS_P = BLOCK - {"html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "br-block"}
#: Start tag -> open elements of the same list, table or kind that it ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"}}
LISTS = frozenset("ul ol dl table menu".split())
#: Parts of a page that are not its text, as classes and ids name them; the first group whatever share of the text they have.
COMMENTS = frozenset("comment comments commentlist commentary respond disqus reply replies".split())
PARTS_NAMED = COMMENTS | frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar widget widgets menu navbar nav navigation breadcrumb breadcrumbs pagination pager footer masthead "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended toolbar skip".split()
)
#: Words before a name that make it one of a page's layout.
LAYOUT = frozenset("no not non has have with without is hide show toggle".split())
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar".split())

TAG = re.compile(r"<!--(?:[\s\S]*?-->|[\s\S]*$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|$)|<[!?/][^>]*(?:>|$)")
ATTRIBUTE = re.compile(r"(?i)(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=\s|/|$|[\"'])")
SPLIT = re.compile(r"[^a-z0-9]+")
HUMPS = re.compile(r"(?<=[a-z])(?=[A-Z])")
GAP = re.compile(r"\s+")
DIGITS = re.compile(r"[0-9]+")
RAW_ENDS = {t: re.compile(rf"(?i)</{t}(?=[\s/>]|$)") for t in RAW}


class Node:
    __slots__ = ("tag", "attrs", "kids", "hash", "size", "inside", "leads")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs, self.kids = tag, attrs, []


class Stack:
    """The open elements, with the places of each tag, of blocks and of lists, so that no tag is searched for."""

    def __init__(self, root: Node):
        self.nodes, self.at = [root], {}

    def push(self, node: Node) -> None:
        place = len(self.nodes)
        self.nodes.append(node)
        for kind in self.kinds(node.tag):
            self.at.setdefault(kind, []).append(place)

    @staticmethod
    def kinds(tag: str) -> list[str]:
        return [tag, *(["#block"] if tag in BLOCK else []), *(["#list"] if tag in LISTS else [])]

    def last(self, kind: str) -> int:
        """The place of the innermost open element of a kind, 0 if there is none."""
        places = self.at.get(kind)
        return places[-1] if places else 0

    def cut(self, place: int) -> None:
        """Ends the element at a place and all inside it."""
        for node in self.nodes[place:]:
            for kind in self.kinds(node.tag):
                self.at[kind].pop()
        del self.nodes[place:]

    def end_siblings(self, name: str) -> None:
        """Ends what a start tag ends in its list or table: the innermost such element, or for rows and groups all of them."""
        outer = self.last("#list")
        if name in ("tr", "tbody", "tfoot"):
            first = [p[k] for t in ENDS[name] if (p := self.at.get(t)) and (k := bisect_right(p, outer)) < len(p)]
            place = min(first, default=0)
        else:
            place = max(self.last(t) for t in ENDS[name])
        if place > outer:
            self.cut(place)


def parse(source: str) -> Node:
    """The element tree; texts are plain strings among the children."""
    root = Node("#root", "")
    stack, at = Stack(root), 0
    n = len(source)
    while at < n:
        m = TAG.search(source, at)
        if m is None:
            stack.nodes[-1].kids.append(source[at:])
            break
        if m.start() > at:
            stack.nodes[-1].kids.append(source[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None or m[4] != ">":
            continue
        name = name.lower()
        if m[1]:
            if place := stack.last(name):
                stack.cut(place)
            continue
        if name in ENDS_P and (place := stack.last("#block")) and stack.nodes[place].tag == "p":
            stack.cut(place)
        if name in ENDS:
            stack.end_siblings(name)
        node = Node(name, m[3].strip())
        stack.nodes[-1].kids.append(node)
        if name in RAW:
            end = RAW_ENDS[name].search(source, at)
            if name in ("title", "textarea"):
                node.kids.append(source[at : end.start() if end else n])
            if end is None:
                break
            close = source.find(">", end.end())
            at = n if close < 0 else close + 1
        elif name not in VOID and not node.attrs.endswith("/") or name in BLOCK:
            stack.push(node)
    return root


def set_apart(node: Node) -> bool:
    """Whether HTML itself says that an element is no main text, by its kind, its role, or as it is hidden. A header inside an article is part of it."""
    if node.tag in NEVER or node.tag == "header" and not node.inside:
        return True
    if node.attrs and node.tag not in ("html", "body", "main"):
        for m in ATTRIBUTE.finditer(node.attrs):
            what, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if what == "hidden" or what == "aria-hidden" and value.lower() == "true" or what == "role" and value.strip().lower() in ROLES:
                return True
    return False


def part_name(node: Node, total: int) -> str | None:
    """The class and id of an element if they name a part of the page that is not its text. total: the page's text."""
    if not node.attrs or node.tag in ("html", "body", "main"):
        return None
    names = [value for m in ATTRIBUTE.finditer(node.attrs) if m[1].lower() in ("class", "id") and (value := m[2] or m[3] or m[4])]
    found = set()
    for name in " ".join(names).split():
        for word in SPLIT.split(HUMPS.sub("-", name).lower()):
            if word in LAYOUT:
                break
            if word in PARTS_NAMED:
                found.add(word)
    if not found or 2 * node.size > total and COMMENTS.isdisjoint(found):
        return None
    return f"{node.tag} {DIGITS.sub('0', ' '.join(names))}"


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def measure(root: Node) -> list[Node]:
    """All elements, children first, with the hash and the visible characters of their subtrees, and whether they are in an article or lead to one."""
    root.inside = False
    todo, order = [root], []
    while todo:
        node = todo.pop()
        order.append(node)
        for k in node.kids:
            if isinstance(k, Node):
                k.inside = node.inside or k.tag == "article"
                todo.append(k)
    order.reverse()
    for node in order:
        node.size, node.leads = 0, False
        parts = [node.tag]
        for k in node.kids:
            if isinstance(k, str):
                parts.append(GAP.sub(" ", k).strip())
                node.size += len(parts[-1])
                continue
            parts.append(f"<{k.hash:x}>")
            node.size += k.size
            node.leads |= k.leads or k.tag == "article" and k.size > 0 and not part_name(k, 0)
        node.hash = digest("\0".join(parts))
        if set_apart(node):
            node.size, node.leads = 0, False
        elif node.leads and part_name(node, 0):
            node.leads = False  # comments, whatever their share of the text
    return order


#: What a hash stands for: a subtree outside articles that is WORDY or not, a block in an article, the name of a part.
LONG, SHORT, BLOCK_INSIDE, NAME = 0, 1, 2, 3


def template_candidates(source: str) -> dict[int, int]:
    """Hashes of what could be a page's template, with what they stand for."""
    out: dict[int, int] = {}
    root = parse(source)
    order = measure(root)
    for node in order:
        if node.size == 0 or node.tag in ("#root", "html", "body", "head"):
            continue
        if node.inside:
            if node.tag in BLOCK and node.tag != "article":
                out[digest(f"inside {node.hash}")] = BLOCK_INSIDE
        elif not node.leads:
            out[node.hash] = LONG if node.size >= WORDY else SHORT
        if (name := part_name(node, root.size)) is not None:
            out[digest(f"name {name}")] = NAME
    return out


def edges_of(article: Node, gone: set[int], template: frozenset[int] | set[int]) -> set[int]:
    """The blocks of an article that recur in the host's articles and have nothing of the page's own before them, or after them."""
    runs: list[int] = []  # the recurring blocks in page order; 0 for own text
    todo: list = [article]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.strip():
                runs.append(0)
        elif id(x) in gone:
            continue
        elif x is not article and x.tag in BLOCK and digest(f"inside {x.hash}") in template:
            runs.append(id(x))
        else:
            todo += reversed(x.kids)
    own = [k for k, r in enumerate(runs) if not r]
    return {*runs[: own[0]], *runs[own[-1] + 1 :]} if own else set()


def main_text(source: str, template: frozenset[int] | set[int] = frozenset(), counted: bool = False) -> str:
    """The main text of a page whose site's template has these hashes. counted: the site has enough pages for names of parts to recur."""
    root = parse(source)
    gone: set[int] = set()
    for node in measure(root):
        if set_apart(node) or not node.inside and not node.leads and node.hash in template:
            gone.add(id(node))
        elif (name := part_name(node, root.size)) is not None and (not counted or digest(f"name {name}") in template):
            gone.add(id(node))
    articles, mains = [], []
    todo = [root]
    while todo:
        node = todo.pop()
        if id(node) in gone:
            continue
        if node.tag == "article":
            articles.append(node)
            continue
        if node.tag == "main":
            mains.append(node)
        todo += [k for k in reversed(node.kids) if isinstance(k, Node)]
    if template:
        for article in articles:
            gone |= edges_of(article, gone, template)
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = GAP.sub(" ", entities.unescape("".join(run))).strip()
        if text:
            blocks.append(text)
        run.clear()

    for top in articles or mains[:1] or [root]:
        todo2: list = [top]
        while todo2:
            x = todo2.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                run.append(x)
            elif id(x) in gone:
                if x.tag in BLOCK:
                    flush()
            elif x.tag in ("br", "wbr"):
                run.append(" " if x.tag == "br" else "")
            elif x.tag in BLOCK:
                flush()
                todo2.append(None)
                todo2 += reversed(x.kids)
            else:
                todo2 += reversed(x.kids)
        flush()
    return "\n\n".join(blocks)


def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def needed(pages: Column, least: int = LEAST, share: float = SHARE) -> Column:
    """Distinct pages of a host that a wordy subtree must be on: the share of a small host, then least more for each doubling of the host."""
    times = F.greatest(share * pages / F.lit(float(least)), F.lit(1.0))
    return F.least(share * pages, least * (1 + F.log2(times)))


def templates(pages: DataFrame, least: int = LEAST, share: float = SHARE, inside: float = INSIDE) -> DataFrame:
    """(host, page, template): for each distinct page, by the hash of its html, the hashes of it that recur across many pages of its host; none where the host has fewer than `least` pages. host: a hash of its name.

    Counts are pre-aggregated, so a host with a third of all pages costs its tasks a row for each of their hashes. What
    recurs goes back to its pages in PARTS parts, as a menu can be on all pages of a host.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.xxhash64(host_of()).alias("host"), text_of("html").alias("html")).withColumn("page", F.xxhash64("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, kind = [], []
            for source in b.column(2).to_pylist():
                some = template_candidates(source) if source else {}
                found.append(list(some))
                kind.append(list(some.values()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int64())), pa.array(kind, pa.list_(pa.int8()))], names=["host", "page", "found", "kind"])

    scratch = Scratch(pages.sparkSession, "templates")
    seen = rows.select("host", "page", "html").mapInArrow(run, "host long, page long, found array<long>, kind array<byte>").groupBy("host", "page").agg(F.first(F.struct("found", "kind")).alias("s"))
    seen = scratch.cut(seen.select("host", "page", "s.found", "s.kind"), "subtrees")
    # a host's hashes meet its number of pages in PARTS tasks
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    many = seen.groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= least).withColumn("part", parts)
    hashes = seen.select("host", "page", F.explode(F.arrays_zip("found", "kind")).alias("x")).select("host", "page", F.col("x.found").alias("h"), F.col("x.kind").alias("kind"))
    counted = hashes.groupBy("host", "h").agg(F.count("*").alias("n"), F.min("kind").alias("kind")).filter(F.col("n") >= least)
    counted = counted.withColumn("part", F.pmod("h", F.lit(PARTS)).cast("int"))
    pages_of = F.col("pages")
    enough = F.when(F.col("kind") == LONG, needed(pages_of, least, share)).when(F.col("kind") == SHORT, share * pages_of).when(F.col("kind") == BLOCK_INSIDE, inside * pages_of).otherwise(F.lit(least))
    recurs = scratch.cut(counted.join(many, ["host", "part"]).filter(F.col("n") >= enough).select("host", "h"), "recurs")
    hashes = hashes.select("host", "page", "h").withColumn("part", F.pmod("page", F.lit(PARTS)).cast("int"))
    found = hashes.join(recurs.withColumn("part", parts), ["host", "h", "part"]).groupBy("host", "page").agg(F.collect_list("h").alias("template"))
    # pages of hosts that were counted have a row, if with nothing in it
    each = seen.select("host", "page").withColumn("part", F.pmod("page", F.lit(PARTS)).cast("int")).join(many.select("host", "part"), ["host", "part"]).drop("part")
    return scratch.cut(each.join(found, ["host", "page"], "left").select("host", "page", F.coalesce("template", F.array().cast("array<long>")).alias("template")), "template")


def extract(pages: DataFrame, least: int = LEAST, share: float = SHARE, inside: float = INSIDE) -> DataFrame:
    """(page_id, url, text) for every page."""
    small_batches(pages.sparkSession)
    found = templates(pages, least, share, inside)
    rows = pages.select("page_id", "url", text_of("html").alias("html"), F.xxhash64(host_of()).alias("host")).withColumn("page", F.xxhash64("html"))
    rows = rows.join(found, ["host", "page"], "left").select("page_id", "url", "html", "template")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(s, frozenset(t or ()), t is not None) for s, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
