"""Main text of web pages, with removal of site templates.

Every page is parsed into elements twice. The first time its element subtrees are hashed: all block elements outside of
its article, and inside of it the containers that hold no paragraph. Spark counts on how many different pages of a host
each hash stands, and what recurs on MIN_PAGES of them or more is the host's template. The second time the page's
template subtrees are deleted, then what elements and their class and id words tell to be menu, header, footer, sidebar,
notice, advert, form, script, style or comment, which also holds on hosts of few pages; the rest of the article, or of a
page without one, is its text. Paragraphs of an article are its author's and stay, also where they recur.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table, slices

#: A subtree is template if at least so many different pages of its host hold it.
MIN_PAGES = 4
#: Elements deeper than this are children of the one at this depth, as in browsers.
MAX_DEPTH = 512

_OPEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)|<[!?/][^>]*+>", re.S)
_INSIDE = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noembed noframes".split())
_SKIP = frozenset("head script style noscript template nav footer aside form iframe object svg canvas button select textarea dialog menu audio video title input".split())
_HEAD = frozenset("head base basefont bgsound link meta noscript script style template title".split())
_UNSEEN = frozenset("head script style noscript template svg iframe object canvas textarea title".split())
_BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}
_SCOPE = frozenset("html body table td th ul ol dl div section article main nav aside footer header form blockquote button".split())
_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_WORDS = re.compile(r"[a-z]+")
_BOILER = frozenset("ad ads adsbygoogle paywall skiplink advert adverts advertisement advertising sponsor sponsored banner cookie cookies consent gdpr notice notices alert menu nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead comment comments disqus replies share sharing social related recommended newsletter subscribe signup popup modal overlay promo widget pagination pager".split())
#: Words that stand beside those in a class or id of the same kind: "site-footer", "related-posts", but not "related-work".
_BESIDE = frozenset("site page top bottom left right main box bar list links link buttons button area wrapper wrap container section block item items posts articles header primary secondary inner outer slot unit form thread reader user js global mobile desktop fixed sticky icons icon media content body inline row col".split())
_HEADER = frozenset("global header main page site top wrapper".split())
#: Elements in which an article has its text; their ids are the author's.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote table figure".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())


class Element:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: str, parent: Element | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Element | str] = []


def parse(html: str) -> Element:
    """A tree of elements, in time proportional to the page. Unclosed elements end where HTML lets them; an end tag
    without a start is ignored; where quotes are left open, tags end at the next >; a tag without any > is text."""
    root = Element("html", "", None)
    now, depth, at, n, quoted = root, 0, 0, len(html), True
    opened: dict[str, int] = defaultdict(int)

    def leave(node: Element) -> None:
        nonlocal now, depth
        while now is not node:
            opened[now.tag] -= 1
            depth -= 1
            now = now.parent
        opened[now.tag] -= 1
        depth -= 1
        now = now.parent

    while at < n:
        m = _OPEN.search(html, at)
        attrs, stop = "", n
        if m:
            stop = m.end()
            if m.group(2):
                close = _INSIDE.match(html, stop).end() if quoted else n
                if close >= n or html[close] != ">":
                    quoted, close = False, html.find(">", stop)
                if close < 0:
                    m = None  # no tag can end from here on
                else:
                    attrs, stop = html[m.end() : close], close + 1
        end = m.start() if m else n
        if end > at:
            now.children.append(html[at:end])
        if not m:
            break
        at = stop
        tag = m.group(2)
        if not tag:
            if m.group().startswith("<![CDATA["):
                now.children.append(m.group()[9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m.group(1):
            if opened[tag]:
                node = now
                while node.tag != tag:
                    node = node.parent
                leave(node)
            continue
        if opened["head"] and tag not in _HEAD:  # what can't stand in a head ends it
            node = now
            while node.tag != "head":
                node = node.parent
            leave(node)
        if tag in ("html", "body"):
            if tag == "body" and now is root:
                root.children.append(node := Element(tag, attrs, root))
                now, depth = node, 1
                opened[tag] += 1
            continue
        for name, scope in (({"p"} if tag in _CLOSES_P else (), _SCOPE), (_SIBLING.get(tag, ()), _SCOPE - ({"td", "th"} if tag == "tr" else {"div"}))):
            if not any(opened[x] for x in name):
                continue
            node = now
            while node.parent is not None and node.tag not in name and node.tag not in scope:
                node = node.parent
            if node.tag in name and node.parent is not None:
                leave(node)
        node = Element(tag, attrs, now)
        now.children.append(node)
        if tag in _RAW:
            close_tag = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            node.children.append(html[at : close_tag.start() if close_tag else n])
            at = close_tag.end() if close_tag else n
        elif tag not in _VOID and not attrs.endswith("/") and depth < MAX_DEPTH:
            now, depth = node, depth + 1
            opened[tag] += 1
    return root


def _names_header(value: str) -> bool:
    """Whether a class or id has a token that names the page's header."""
    return any("header" in words and _HEADER.issuperset(words) for words in map(_WORDS.findall, value.lower().split()))


def _told(value: str) -> bool:
    """Whether a class or id has a token that is of boilerplate words alone."""
    for token in value.lower().split():
        words = _WORDS.findall(token)
        if words and not _BOILER.isdisjoint(words) and all(w in _BOILER or w in _BESIDE for w in words):
            return True
    return False


def boilerplate(node: Element, in_article: bool) -> bool:
    if node.tag in _SKIP:
        return True
    if node.tag == "header":
        return not (in_article and _has(node, "h1"))
    if node.attrs and node.tag not in ("body", "article", "main"):
        for name, a, b, c in _ATTR.findall(node.attrs):
            name = name.lower()
            if (name == "class" or name == "id" and not (in_article and node.tag in _PROSE)) and _told(a or b or c):
                return True
            if name in ("class", "id") and not in_article and node.tag not in _PROSE and _names_header(a or b or c) and not _has(node, "h1"):
                return True
            if name == "role" and (a or b or c).lower() in _ROLES:
                return True
            if name == "aria-hidden" and (a or b or c).lower() == "true":
                return True
        if re.search(r"(?:^|\s)hidden(?:\s|=|$)", node.attrs):
            return True
    return False


def _has(node: Element, tag: str) -> bool:
    stack = [node]
    while stack:
        x = stack.pop()
        for c in x.children:
            if not isinstance(c, str):
                if c.tag == tag:
                    return True
                stack.append(c)
    return False


def _articles(root: Element) -> list[Element]:
    """The outermost article elements outside boilerplate; else the outermost main elements; else none."""
    for names in (("article",), ("main",)):
        found, stack = [], [root]
        while stack:
            node = stack.pop()
            is_main = names == ("main",) and re.search(r"""role\s*=\s*["']?main\b""", node.attrs or "")
            if node.tag in names or is_main:
                found.append(node)
            else:
                stack.extend(c for c in reversed(node.children) if not isinstance(c, str) and not boilerplate(c, False))
        if found:
            return found
    return []


def _hashes(root: Element) -> dict[int, int]:
    """id of each element to the hash of its subtree: tag, attributes, text and the hashes below."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(c for c in x.children if not isinstance(c, str))
    out: dict[int, int] = {}
    for x in reversed(order):
        h = xxhash.xxh64(f"{x.tag}\0{x.attrs}".encode("utf-8", "surrogatepass"))
        for c in x.children:
            h.update(" ".join(c.split()).encode("utf-8", "surrogatepass") if isinstance(c, str) else out[id(c)].to_bytes(8, "big", signed=True))
        out[id(x)] = int.from_bytes(h.digest(), "big", signed=True)
    return out


def _countable(root: Element, tops: list[Element]) -> list[Element]:
    """The elements whose recurrence on other pages tells a template: block elements outside of ``tops`` that don't hold
    one of them, and containers below ``tops`` that hold no prose element; all of them with text, none in head or script."""
    holds, inner, order = set(), {id(top) for top in tops}, []
    for top in tops:
        node: Element | None = top
        while node is not None and id(node) not in holds:
            holds.add(id(node))
            node = node.parent
    stack = [(root, False)]
    while stack:
        x, inside = stack.pop()
        inside = inside or id(x) in inner
        order.append((x, inside))
        stack.extend((c, inside) for c in x.children if not isinstance(c, str) and c.tag not in _UNSEEN)
    prose, text, out = set(), set(), []
    for x, inside in reversed(order):
        below = [c for c in x.children if not isinstance(c, str)]
        if x.tag in _PROSE or any(id(c) in prose for c in below):
            prose.add(id(x))
        if any(id(c) in text for c in below) or any(isinstance(c, str) and not c.isspace() for c in x.children):
            text.add(id(x))
            if x.tag in _BLOCK and id(x) not in holds and not (inside and id(x) in prose) and x.tag != "html":
                out.append(x)
    return out


def page_hashes(html: str) -> tuple[int, list[int]]:
    """(what stands for the page's content, the distinct hashes of its countable elements)."""
    root = parse(html)
    tops = _articles(root)
    hashes = _hashes(root)
    own = xxhash.xxh64()
    for top in tops or [root]:
        own.update(hashes[id(top)].to_bytes(8, "big", signed=True))
    return int.from_bytes(own.digest(), "big", signed=True), list({hashes[id(x)]: None for x in _countable(root, tops)})


def page_text(html: str, gone: frozenset[int] | set[int] = frozenset()) -> tuple[str, int]:
    """(the page's text, template subtrees deleted, those inside others not counted)."""
    root = parse(html)
    tops = _articles(root)
    dropped: set[int] = set()
    if gone:
        hashes = _hashes(root)
        dropped = {id(x) for x in _countable(root, tops) if hashes[id(x)] in gone}
    blocks: list[str] = []
    for top in tops or [root]:
        _walk(top, bool(tops), dropped, blocks)
    cut, stack = 0, [root]
    while dropped and stack:
        for c in stack.pop().children:
            if not isinstance(c, str):
                if id(c) in dropped:
                    cut += 1
                else:
                    stack.append(c)
    return "\n".join(blocks), cut


def _walk(top: Element, in_article: bool, dropped: set[int], blocks: list[str]) -> None:
    """The text blocks below ``top``, without what is dropped or told to be boilerplate."""
    text: list[str] = []

    def flush() -> None:
        if text:
            # runs of white space, also those that references stand for, become one space
            s = " ".join("".join(text).split())
            text.clear()
            if s:
                blocks.append(s)

    stack: list[tuple[Element | str, bool]] = [(top, False)]
    while stack:
        node, leaving = stack.pop()
        if isinstance(node, str):
            text.append(unescape(node))
        elif leaving:
            flush()
        elif id(node) not in dropped and (node is top or not boilerplate(node, in_article)):
            if node.tag in _BLOCK:
                flush()
                stack.append((node, True))
            elif node.tag in ("br", "img", "wbr"):
                text.append(" ")
            stack.extend((c, False) for c in reversed(node.children))
    flush()


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", url or "")
    return m.group(1).lower() if m else ""


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars, n_templates (template subtrees deleted).

    Null and empty html have an empty text; pages without a usable url belong to one nameless host; repeated rows come
    back as often as they came in, and pages of one content on a host count once; an empty table gives no rows.

    Hashes meet their counts in an equi-join on host and hash, made distinct before, so a host with a third of all pages
    is spread by its hashes. Pages meet the hashes that they lose by their id and a hash of url and html.
    """
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    base = base.withColumn("key", F.xxhash64("page_id", "url", "html"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            rows = []
            for key, url, html in zip(*(b.column(c).to_pylist() for c in ("key", "url", "html"))):
                content, hashes = page_hashes(html or "")
                seed = xxhash.xxh64_intdigest(host_of(url).encode("utf-8", "surrogatepass"))
                rows.append((key, content, [xxhash.xxh64_intdigest(h.to_bytes(8, "big", signed=True), seed) - 2**63 for h in hashes], hashes))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["key", "content", "here", "hashes"])

    # ``here`` stands for host and hash, so that rows of the counts are three numbers
    found = shared_table(base.select("key", "url", "html").mapInArrow(count, "key long, content long, here array<long>, hashes array<long>"))
    held = found.select("key", "content", F.explode(F.arrays_zip("here", "hashes")).alias("x")).select("key", "content", "x.here", F.col("x.hashes").alias("hash"))
    often = held.select("here", "content").distinct().groupBy("here").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_PAGES)
    gone = held.select("key", "here", "hash").join(often.select("here"), "here").groupBy(F.col("key").alias("of")).agg(F.collect_set("hash").alias("gone"))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            done = [page_text(h or "", frozenset(g or ())) for h, g in zip(b.column("html").to_pylist(), b.column("gone").to_pylist())]
            texts = [d[0] for d in done]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([d[1] for d in done], pa.int32())], ["page_id", "url", "text", "n_chars", "n_templates"])

    # a merge join at any size: what the pages lose grows with them
    joined = base.join(gone.hint("merge"), F.col("key") == F.col("of"), "left").select("page_id", "url", "html", "gone")
    return joined.mapInArrow(render, "page_id long, url string, text string, n_chars long, n_templates int")
