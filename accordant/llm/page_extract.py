"""Main text of web pages: site templates are found by counting element subtrees per host and removed.

A tolerant parser builds the element tree of a page, in time linear in the page, however deep or broken. What is not part of the article by its tag,
role, class or id goes; a class or id counts if all its words speak of such parts or of layout, so "related-posts" does and "related-work" doesn't. Of the
rest, every subtree that could belong to the site rather than to the page is hashed, the pages of a host that have
it are counted in Spark, and subtrees on at least ``MIN_PAGES`` pages are deleted if these are ``MANY_PAGES`` or ``MIN_SHARE`` of the host's pages.
Inside an article, that goes for subtrees with a class or an id. Those without that stand first or last in
the article may be prose that articles share: they go if they are on ``HIGH_SHARE`` of the host's pages. Other unnamed parts of an article stay.

Pages of the same article count once, so an article that stands at several addresses is no template. Counts are combined before the shuffle, so a host with most pages weighs no more than its different subtrees; the pages of such a
host are dealt to several tasks by Spark's skew join when the host's templates are joined to them.

Defined results: null or empty html gives empty text; a page without markup is its own text; every input row gives one row;
a null or odd url belongs to a host named by the empty text; a tag that is open at the end of the page goes with what follows it; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.shared import written

MIN_PAGES = 5
MIN_SHARE = 0.2
#: Pages that make a template of a subtree however many pages the host has.
MANY_PAGES = 100
#: Share of a host's pages for what may be prose.
HIGH_SHARE = 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that are never part of an article.
DROPPED = frozenset(
    "nav footer aside form script style noscript template iframe svg button select input textarea dialog menu head title".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What an open element of the first kind ends at, for want of its end tag.
ENDED_BY = {
    "p": BLOCKS - {"br", "td", "th", "li", "dd", "dt", "body", "html", "head", "option", "tr", "tbody", "thead", "tfoot", "legend", "figcaption"} | {"p"},
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
}
#: Elements within which an end tag or an implied end is sought.
LIMITS = {"p": frozenset(["table", "td", "th", "button", "article", "section", "main", "body", "html"]), "li": frozenset(["ul", "ol", "menu", "body"]), "dt": frozenset(["dl", "body"]), "dd": frozenset(["dl", "body"])}
TABLE_LIMIT = frozenset(["table", "body", "html"])

#: Words of class, id and role that mark what isn't the article.
MARKS = frozenset(
    "nav navbar navigation menu sidebar side footer contentinfo complementary ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices alert newsletter subscribe subscription popup modal overlay comment comments disqus discussion replies reply respond related recommended share sharing social breadcrumb breadcrumbs pagination pager widget toolbar login "
    "signup signin search form masthead skip hidden".split()
)
#: Words of layout that may stand beside them.
LAYOUT = frozenset(
    "site page main global top bottom left right first last primary secondary inner outer wrap wrapper container content section area block box bar list item items link links row col column post posts article articles story stories "
    "user reader readers header head title text body slot unit group panel buttons button icon icons message msg us to the and of".split()
)
_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_TO_QUOTE = re.compile("""[^>"']*""")
_MARKED = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=>/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id)\s*=""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """An element: tag, text of its attributes, children (nodes and texts), hash of the subtree, kinds of article elements within (bits)."""

    __slots__ = ("tag", "attributes", "children", "start", "code", "holds", "dropped")

    def __init__(self, tag: str, attributes: str, start: int):
        self.tag, self.attributes, self.start = tag, attributes, start
        self.children: list[Node | str] = []
        self.code = self.holds = 0
        self.dropped = False


#: Elements that say where the article is, in order of preference, and their bits.
ARTICLES = {"article": 1, "main": 2}
#: What an element ends by its start.
_ENDS = {tag: frozenset(k for k, by in ENDED_BY.items() if tag in by) for tag in frozenset().union(*ENDED_BY.values())}
_STOPS = LIMITS["p"] | {"ul", "ol", "dl", "select"}


def _tag_end(source: str, at: int, last_quotes: tuple[int, int]) -> int:
    """The place after the tag's end, 0 if it has none. A quote that isn't closed is a character like others; whether it is, is known from the last one of its kind."""
    while True:
        at = _TO_QUOTE.match(source, at).end()
        if at >= len(source):
            return 0
        if source[at] == ">":
            return at + 1
        last = last_quotes[source[at] == "'"]
        at = source.find(source[at], at + 1) + 1 if last > at else at + 1


def parse(source: str) -> Node:
    """The element tree, whatever the source; end tags that are missing are put where a browser would."""
    root = Node("", "", 0)
    stack, is_open = [root], Counter()
    places: dict[str, list[int]] = {}  # of each tag, where its open elements stand
    at, n, last_quotes = 0, len(source), (source.rfind('"'), source.rfind("'"))

    def close(depth: int) -> None:
        while len(stack) > depth:
            tag = stack.pop().tag
            is_open[tag] -= 1
            places[tag].pop()

    def innermost(tags) -> int:
        return max((places[t][-1] for t in tags if is_open[t]), default=0)

    while at < n:
        found = _TAG.search(source, at)
        if not found:
            break
        begin = found.start()
        if begin > at:
            stack[-1].children.append(source[at:begin])
        comment, other, slash, tag = found.groups()
        if comment:
            if source.startswith((">", "->"), found.end()):  # an empty comment
                at = source.find(">", found.end()) + 1
                continue
            end = source.find("-->", found.end())
            at = n if end < 0 else end + 3
            continue
        if other:
            end = source.find(">", found.end())
            at = n if end < 0 else end + 1
            continue
        end = _tag_end(source, found.end(), last_quotes)
        if end <= 0:
            at = n
            continue
        at, tag = end, tag.lower()
        if slash:
            own = innermost((tag,))
            if own and own > innermost(LIMITS.get(tag, TABLE_LIMIT if tag in ("tr", "td", "th") else frozenset()) - {tag}):
                close(own)
            continue
        ends = _ENDS.get(tag, ())
        own = innermost(ends)
        if own and own > innermost(_STOPS - ends if ends else ()):
            close(own)
        attributes = source[found.end() : end - 1]
        node = Node(tag, attributes, begin)
        stack[-1].children.append(node)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            stop = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(source, at)
            at = stop.start() if stop else n
            node.children.append(source[end:at])
            if stop:
                at = source.find(">", at) + 1 or n
            continue
        places.setdefault(tag, []).append(len(stack))
        stack.append(node)
        is_open[tag] += 1
    if at < n:
        stack[-1].children.append(source[at:])
    for node in reversed(_nodes(root)):
        digest = xxhash.xxh64(f"{node.tag}\0{node.attributes}".encode())
        for child in node.children:
            if isinstance(child, Node):
                digest.update(b"\1" + child.code.to_bytes(8, "little"))
                node.holds |= child.holds | ARTICLES.get(child.tag, 0)
            else:
                digest.update(b"\2" + child.encode())
        node.code = digest.intdigest()
    return root


def _nodes(top: Node) -> list[Node]:
    """A node and all below it, parents before their children."""
    out, todo = [], [top]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    return out


def _marks(value: str) -> bool:
    words = [w.lower() for w in _WORD.findall(value)]
    return any(w in MARKS for w in words) and all(w in MARKS or w in LAYOUT for w in words)


def _marked(node: Node) -> bool:
    if not node.attributes:
        return False
    if _HIDDEN.search(node.attributes):
        return True
    return any(_marks(token) for values in _MARKED.findall(node.attributes) for value in values for token in value.split())


def _headings(node: Node) -> list[Node]:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if re.fullmatch("h[1-6]", x.tag):
            out.append(x)
        else:
            todo += [c for c in reversed(x.children) if isinstance(c, Node)]
    return out


def _find(node: Node, tag: str) -> list[Node]:
    """Outermost elements of a tag outside what isn't the article."""
    out, todo, bit = [], [node], ARTICLES.get(tag)
    while todo:
        for child in todo.pop().children:
            if isinstance(child, Node):
                if child.tag == tag and not _marked(child):
                    out.append(child)
                elif child.tag not in DROPPED and child.tag != "header" and (child.holds & bit if bit else not _marked(child)):
                    todo.append(child)
    return sorted(out, key=lambda x: x.start)


def main_parts(root: Node) -> tuple[list[Node], bool]:
    """Elements that hold the article, and whether the page says so itself."""
    articles, mains = _find(root, "article"), _find(root, "main")
    if mains and articles:
        whole, own = (sum(_letters(x) for x in part) for part in (mains, articles))
        return (articles if 2 * own >= whole else mains), True  # or the article is what the main part holds beside a few teasers
    if articles or mains:
        return articles or mains, True
    return (_find(root, "body") or [root]), False


def _letters(top: Node) -> int:
    """Characters of text below a node that may be part of an article."""
    out, todo = 0, [top]
    while todo:
        for child in todo.pop().children:
            if isinstance(child, str):
                out += len(child.strip())
            elif child.tag not in DROPPED and not _marked(child):
                todo.append(child)
    return out


def prune(top: Node, inside: bool) -> None:
    """Drops what isn't part of the article."""
    todo = [top]
    while todo:
        node = todo.pop()
        kept: list[Node | str] = []
        for child in node.children:
            if isinstance(child, Node):
                if child.tag == "header" and inside:
                    kept += _headings(child)
                    continue
                if child.tag in DROPPED or child.tag == "header" or _marked(child):
                    continue
                todo.append(child)
            kept.append(child)
        node.children = kept


def text_of(node: Node) -> str:
    """Text with character references decoded; white space is one space within and between blocks."""
    out: list[str] = []
    todo: list[Node | str] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(html.unescape(x) if "&" in x else x)
        elif not x.dropped:
            if x.tag in BLOCKS:
                out.append("\n")
                todo.append("\n")
            todo += reversed(x.children)
    return " ".join("".join(out).split())


def _edges(part: Node) -> set[int]:
    """The nodes, by identity, that stand first or last in a part of the article, and first or last in these."""
    filled: set[int] = set()
    for node in reversed(_nodes(part)):
        if any(id(c) in filled if isinstance(c, Node) else c.strip() for c in node.children):
            filled.add(id(node))
    out: set[int] = set()
    for step in (1, -1):
        node: Node | None = part
        while node is not None:
            child = next((c for c in node.children[::step] if (c.strip() if isinstance(c, str) else id(c) in filled)), None)
            node = child if isinstance(child, Node) else None
            if node is not None:
                out.add(id(node))
    return out


def _candidates(part: Node, inside: bool) -> Iterator[tuple[Node, bool]]:
    """Subtrees that may belong to the site, and whether they may be prose."""
    edges = _edges(part) if inside else set()
    for node in _nodes(part)[1:]:
        named = bool(_NAMED.search(node.attributes))
        if not inside or named:
            yield node, False
        elif id(node) in edges:
            yield node, True


def _code(node: Node, prose: bool) -> int:
    """Hash of a subtree; as prose it has another one, for it is judged by another share."""
    return (node.code ^ (0x9E3779B97F4A7C15 if prose else 0)) - (1 << 63)


def article_of(source: str) -> list[tuple[Node, bool]]:
    """The parts of the article, without what isn't, and whether the page says where it is."""
    parts, inside = main_parts(parse(source))
    for part in parts:
        prune(part, inside)
    return [(p, inside) for p in parts]


def templates_of(source: str) -> dict[int, bool]:
    """Hashes of the subtrees that may belong to the site, and whether they may be prose."""
    return {_code(node, prose): prose for part, inside in article_of(source) for node, prose in _candidates(part, inside)}


def extract(source: str | None, templates: frozenset[int] | set[int] = frozenset()) -> str:
    """Main text of a page, without the subtrees whose hashes are in ``templates``."""
    if not source:
        return ""
    parts, inside = main_parts(parse(source))
    texts = []
    for part in parts:
        prune(part, inside)
        if templates:
            for node, prose in list(_candidates(part, inside)):
                if _code(node, prose) in templates:
                    node.dropped = True
        texts.append(text_of(part))
    return " ".join(t for t in texts if t)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, subtrees) of every page: a hash of its article, by which copies are told, and what may belong to the site."""
    for batch in batches:
        pages, subtrees = [], []
        for source in batch.column("html").to_pylist():
            parts = article_of(source) if source else []
            pages.append(xxhash.xxh64(b"".join(p.code.to_bytes(8, "little") for p, _ in parts)).intdigest() - (1 << 63))
            own = {_code(node, prose): prose for part, inside in parts for node, prose in _candidates(part, inside)}
            subtrees.append([{"code": code, "prose": prose} for code, prose in own.items()])
        kind = pa.list_(pa.struct([("code", pa.int64()), ("prose", pa.bool_())]))
        yield pa.RecordBatch.from_pydict({"host": batch.column("host"), "page": pa.array(pages, pa.int64()), "subtrees": pa.array(subtrees, kind)})


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(source, frozenset(codes or ())) for source, codes in zip(batch.column("html").to_pylist(), batch.column("codes").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pydict(
            {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
        )


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, codes): hashes of the subtrees that recur on a host. pages: host, html."""
    sizes = pages.groupBy("host").agg(F.count("*").alias("pages"))
    found = pages.select("host", "html").mapInArrow(_subtrees, "host string, page long, subtrees array<struct<code: long, prose: boolean>>")
    different = found.groupBy("host", "page").agg(F.first("subtrees").alias("subtrees"))  # copies of an article are one
    counts = different.select("host", F.inline("subtrees")).groupBy("host", "code", "prose").agg(F.count("*").alias("on"))
    enough = F.when(F.col("prose"), HIGH_SHARE * F.col("pages")).otherwise(F.least(F.lit(float(MANY_PAGES)), min_share * F.col("pages")))
    recurring = counts.where(F.col("on") >= min_pages).join(sizes, "host").where(F.col("on") >= enough)
    return written(recurring.groupBy("host").agg(F.collect_list("code").alias("codes")), "templates")  # at most subtrees of the host's pages / min_pages


def extract_pages(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(page_id, url, text, n_chars) of every page. pages: page_id, url, html."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))
    templates = site_templates(named, min_pages, min_share)
    joined = named.join(templates, "host", "left").select("page_id", "url", "html", "codes")
    return joined.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
