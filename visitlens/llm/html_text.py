"""Main text of web pages: site template removal.

Every element subtree of a page gets a hash.  Spark counts, per host, on how
many pages with different main texts a subtree occurs; subtrees that recur on
many pages of their host are the site's template (menus, banners, share bars,
notices) and are deleted.  What stands in elements that are never main text (scripts,
styles, forms, navigation, page headers and footers, asides) or is marked up
as an advert, notice or reader comment goes as well.  The text of the article,
or where a page marks none of the whole body, comes out block by block.

Prose (paragraphs, headings, quotations and what they hold) inside an article
is never taken for template: a passage that many articles quote stays.  Of the
rest of an article only whole blocks are, those that stand in it itself or in
a wrapper around most of it; an item or cell never goes without its list or
table, inside an article or out of it.  Outside an article a block must recur in
its place: beside the same neighbour or, unless it is prose, at the same end of
its parent; only a block that is mostly links recurs anywhere.  The neighbour of
prose must not be prose itself, so a passage that several pages quote stays.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A subtree is template if it is on that many pages of a host, whatever the host's size.
MIN_PAGES = 5
#: Hashes of pages' template subtrees are broadcast up to that many, else joined by a shuffle.
BROADCAST_HASHES = 500_000

# Fixed values of HTML: raw-text, void, block and never-main elements.
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dt dd figcaption caption".split())
BLOCK = PROSE | frozenset("""html head body article section main div nav header footer aside address ul ol li dl table thead tbody
    tfoot tr td th form fieldset figure details summary hr dialog menu search hgroup""".split())
CLOSES_P = BLOCK - {"html", "head", "body"}
# elements that may stand in a head; anything else closes one that is open
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript template noframes".split())
NEVER = RAW | frozenset("""head nav footer aside form button select option input svg canvas object template dialog menu search
    audio video map label datalist""".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
NEVER_WORDS = frozenset("""ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar
    navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices popup modal overlay
    comment comments commentlist disqus respond reply replies share sharing social related recommended newsletter subscribe subscription signup
    login pagination pager toolbar widget widgets skip""".split())
# with one of the above they name a part of the page ("ad-slot"); any other word makes a name of its own ("ad-hoc")
PART_WORDS = frozenset("area bar box buttons container form icons list section slot wrap wrapper".split())
# what else the name of a wrapper may hold beside one of the first ("left-sidebar", "comment-body"); sizes and numbers too
QUALIFIERS = frozenset("""site page main global top bottom left right user users reader readers post posts article articles google body content
    item items thread links link inner outer unit primary secondary first second col column rail fixed sticky mobile desktop""".split())
HEADER_OF = frozenset("site page main global top web".split())
# never taken for template: the page's frame and its articles; parts of a list or table, which go with the whole only
FRAME = frozenset("html head body article main".split())
ITEMS = frozenset("li dt dd thead tbody tfoot tr th td caption".split())
LISTS = frozenset("ul ol dl table".split())
# what may wrap the blocks of an article
WRAPPERS = frozenset("div section article main".split())
#: Blocks around others: their names may be qualified.
WRAPS = frozenset("div section ul ol dl table aside figure address details fieldset hgroup".split())
_SIZE = re.compile(r"\d+(?:x\d+)?(?:px)?")
#: Elements whose id names a part of the page; elsewhere ids are often slugs of headings.
ID_NAMES_PART = BLOCK - PROSE - {"article", "section", "li", "tr", "td", "th", "summary"}

# a quote opens a string only after "="; possessive, so that broken mark-up is read in linear time
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>", re.S)
_NO_TAG = re.compile(r"<!--.*|<!\[CDATA\[.*|<[!?].*", re.S)
# class or id of a reader comment that is an article of its own
_COMMENT = re.compile(r"(?:div[_-]+)?(?:comments?|reply|replies)(?:[_-]+(?:body|content|item|list|\d+))*")
_HIDDEN = re.compile(r"(?<![^\s/\"'])hidden(?![^\s/])", re.I)
_ATTRIBUTE = re.compile(r"(?<![^\s=/>\"'])([^\s=/>\"']++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++))")


class Node:
    __slots__ = ("tag", "attrs", "items", "hash", "size", "linked", "holds_article", "holds_most", "holds_all", "removable", "in_place", "keys")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.items, self.hash, self.size, self.linked = tag, attrs, [], 0, 0, 0
        self.holds_article = self.holds_most = self.holds_all = self.removable = self.in_place = False
        self.keys: tuple[int, ...] = ()

    def attributes(self) -> dict[str, str]:
        return {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTRIBUTE.findall(self.attrs)} if "=" in self.attrs else {}


def elements(root: Node) -> list[Node]:
    """All elements, each before those inside it.  Pages may nest to any depth,
    so nothing here recurses."""
    out = [root]
    for node in out:
        out.extend(x for x in node.items if isinstance(x, Node))
    return out


def parse(html: str) -> Node:
    """Element tree of a page; unclosed and stray tags are tolerated.  A head
    ends where its end tag is left out: at the first tag or text that cannot
    stand in one."""
    root = Node("")
    stack, at, n = [root], 0, len(html)
    opened: defaultdict[str, int] = defaultdict(int)  # elements on the stack, by tag
    last = html.rfind(">")

    def close(k: int) -> None:
        for x in stack[k:]:
            opened[x.tag] -= 1
        del stack[k:]

    def add_text(text: str) -> None:
        if stack[-1].tag == "head" and text.strip():
            close(len(stack) - 1)
        stack[-1].items.append(text)

    while at < n:
        # no tag can end behind the last ">"
        m = (_TOKEN if at <= last else _NO_TAG).search(html, at)
        if m is None:
            add_text(html[at:])
            break
        if m.start() > at:
            add_text(html[at:m.start()])
        at = m.end()
        if m.re is _NO_TAG or m[2] is None:
            if m[0].startswith("<![CDATA["):
                add_text(entities.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        name = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1) if opened[name] else ():
                if stack[k].tag == name:
                    close(k)
                    break
                # an inline end tag does not close the block it stands in
                if name not in BLOCK and stack[k].tag in BLOCK:
                    break
            continue
        if stack[-1].tag == "head" and name not in IN_HEAD:
            close(len(stack) - 1)
        if name in CLOSES_P and (opened["p"] or opened[name]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in BLOCK:
                    if stack[k].tag == name and name in ("li", "dt", "dd", "td", "th", "tr", "option"):
                        close(k)
                    break
        node = Node(name, m[3])
        stack[-1].items.append(node)
        if name in ("article", "main"):
            for outer in reversed(stack):
                if outer.holds_article:
                    break
                outer.holds_article = True
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else n
        elif name not in VOID and not m[3].endswith("/"):
            stack.append(node)
            opened[name] += 1
    measure(root)
    return root


def measure(root: Node) -> None:
    """Fill in how many characters of text an element holds, blanks and what
    its tag rules out left aside, and how many of them in links, whether that is
    most or nearly all of the page's, and whether the element may be template: blocks
    but for the page's frame and parts of lists and tables; in an article only its
    whole blocks; outside, where links do not prevail, only ``in_place``."""
    nodes = elements(root)
    for node in reversed(nodes):
        node.size = sum((0 if x.tag in NEVER else x.size) if isinstance(x, Node) else len("".join(x.split())) for x in node.items)
        node.linked = node.size if node.tag == "a" else sum(x.linked for x in node.items if isinstance(x, Node) and x.tag not in NEVER)
    for node in nodes:
        node.holds_most = 2 * node.size > root.size
        node.holds_all = root.size - node.size < 40
    # elements, the size of the article around (None outside, 0 inside a block of it), whether they are all that an item holds
    todo: list[tuple[Node, int | None, bool]] = [(root, None, False)]
    while todo:
        node, around, item = todo.pop()
        for x in node.items:
            if isinstance(x, Node):
                lone = x.tag in ITEMS or item and x.size == node.size and x.tag not in LISTS
                x.removable = x.tag in BLOCK and x.tag not in FRAME and not lone and (around is None or around > 0 and x.tag not in PROSE)
                x.in_place = around is None and 2 * x.linked < x.size
                if x.tag in ("article", "main"):
                    inside = x.size
                else:
                    inside = around if not around or x.tag in WRAPPERS and 2 * x.size > around else 0
                todo.append((x, inside, lone))


def names_part(name: str, wrapper: bool = False) -> bool:
    """Whether a class or id as a whole is a name of what stands beside the main
    text: all its words are, but for such as "box" or "list" and, for a wrapper, the
    words that qualify them."""
    words = set(re.split(r"[_-]+", name)) - {""}
    if words & NEVER_WORDS and words <= NEVER_WORDS | PART_WORDS:
        return True
    if not wrapper:
        return False
    words = {w for w in words if not _SIZE.fullmatch(w)}
    if words == {"top", "bar"} or "header" in words and len(words) > 1 and words - {"header"} <= HEADER_OF | PART_WORDS:
        return True
    return bool(words & NEVER_WORDS) and words <= NEVER_WORDS | PART_WORDS | QUALIFIERS


def never_main(node: Node, in_article: bool) -> bool:
    """Whether an element is not main text by its tag or mark-up.  The page's
    frame, its article and what holds most of its text are never ruled out by
    mark-up; an article inside an article only as a reader comment."""
    tag = node.tag
    if tag in NEVER or tag == "header" and not in_article:
        return True
    if tag in ("", "html", "body", "main") or tag == "article" and not in_article:
        return False
    if not node.attrs or "=" not in node.attrs and "hidden" not in node.attrs.lower():
        return False
    a = node.attributes()
    names, own_id = a.get("class", "").lower().split(), a.get("id", "").strip().lower()
    # a wrapper named after what stands beside the article is no reason to lose it; readers may write more than the author
    if node.holds_most and tag != "article":
        return tag in WRAPS and not node.holds_all and any(map(_COMMENT.fullmatch, [*names, own_id]))
    if a.get("role", "").lower() in NEVER_ROLES or "hidden" in a or _HIDDEN.search(_ATTRIBUTE.sub(" ", node.attrs)):
        return True
    if tag == "article":
        return any(map(_COMMENT.fullmatch, [*names, own_id]))
    if own_id and (tag in ID_NAMES_PART or tag == "section" and _COMMENT.fullmatch(own_id)):
        names.append(own_id)
    return any(names_part(n, tag in WRAPS) for n in names) and (in_article or not node.holds_article)


def hash_subtrees(root: Node) -> int:
    """Fill in the hash of every element: tag, attributes and, in order, the
    hashes of its children and its white-space-normalised text."""
    for node in reversed(elements(root)):
        h = xxhash.xxh64(f"{node.tag}\0{' '.join(node.attrs.split())}\0")
        for x in node.items:
            if isinstance(x, Node):
                h.update(x.hash.to_bytes(8, "little"))
            elif x := " ".join(x.split()):
                h.update(b"\1" + x.encode("utf-8", "surrogatepass"))
        node.hash = h.intdigest()
    for node in elements(root):
        own = [x for x in node.items if isinstance(x, Node) and x.tag not in VOID]
        for before, x, after in zip([None, *own], own, [*own[1:], None]):
            if x.removable:
                x.keys = _places(node, before, x, after) if x.in_place else (x.hash,)
    return root.hash


def _places(parent: Node, before: Node | None, x: Node, after: Node | None) -> tuple[int, ...]:
    """Hashes of an element with its neighbours or, but for prose, its parent's end."""
    prose, out = x.tag in PROSE, []
    for side, y in (("<", before), (">", after)):
        if y is None and prose or y is not None and prose and y.tag in PROSE:
            continue
        out.append(xxhash.xxh64(f"{side}{x.hash} {parent.tag if y is None else y.hash}").intdigest())
    return tuple(out)


def candidates(root: Node) -> Iterator[int]:
    """Keys of the subtrees that may be template: their hashes, or their places."""
    return (k for x in elements(root) if x.removable for k in x.keys)


def marks_article(root: Node) -> bool:
    """Whether a page has an article that is not inside what is never main text."""
    todo = [root]
    while todo:
        for x in todo.pop().items:
            if isinstance(x, Node) and not never_main(x, False):
                if x.tag in ("article", "main"):
                    return True
                todo.append(x)
    return False


def text_blocks(root: Node, template: set[int], plain: list[str] | None = None, met: set[int] | None = None) -> list[str]:
    """Blocks of the main text, white space collapsed, in page order.  ``plain``
    takes the texts that are not in a link, ``met`` the keys of the subtrees
    read that may be template."""
    blocks: list[str] = []
    run: list[str] = []
    marked = marks_article(root)

    def flush() -> None:
        if text := " ".join(entities.unescape("".join(run)).split()):
            blocks.append(text)
        run.clear()

    # elements being read: what is left of each, whether in an article, whether in a link, whether it is a block
    path = [(iter(root.items), False, False, False)]
    while path:
        items, in_article, linked, breaks = path[-1]
        x = next(items, None)
        if x is None:
            path.pop()
            if breaks:
                flush()
        elif not isinstance(x, Node):
            if in_article or not marked:
                run.append(x)
                if plain is not None and not linked:
                    plain.extend(x.split())
        else:
            if x.tag in BLOCK:
                flush()
            if never_main(x, in_article) or x.removable and not template.isdisjoint(x.keys):
                continue
            if met is not None and x.removable:
                met.update(x.keys)
            if x.tag not in VOID:
                path.append((iter(x.items), in_article or x.tag in ("article", "main"), linked or x.tag == "a", x.tag in BLOCK))
            elif x.tag not in BLOCK:
                run.append(" ")
    flush()
    return blocks


def main_text_hash(root: Node, met: set[int]) -> int:
    """Hash of a page's main text, template included; for ``met`` see ``text_blocks``.  Copies of a page that
    differ in mark-up, in what is never main text or in their links have the
    same; only where all of the text is links do these count."""
    plain: list[str] = []
    blocks = text_blocks(root, set(), plain, met)
    return xxhash.xxh64(" ".join(plain or blocks).encode("utf-8", "surrogatepass")).intdigest()


def _signed(h: int) -> int:
    return h - (h >> 63 << 64)


def host_of(url: Column) -> Column:
    """Host of a URL, lower-cased, without user and port; '' where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def page_subtrees(pages: DataFrame) -> DataFrame:
    """(host, key, page, hash, read): per distinct page (``host, key, html``)
    the subtrees that may be template, the hash of its main text and whether
    its text has the subtree."""
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for host, key, html in zip(b["host"], b["key"], b["html"]):
                root, met = parse(html if isinstance(html, str) else ""), set()
                hash_subtrees(root)
                page = _signed(main_text_hash(root, met))
                out.extend((host, key, page, _signed(h), h in met) for h in {*candidates(root)})
            yield pd.DataFrame(out, columns=["host", "key", "page", "hash", "read"])

    return pages.select("host", "key", "html").mapInPandas(emit, "host string, key long, page long, hash long, read boolean").distinct()


def template_hashes(subtrees: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, key, hashes): the subtrees in a page's text that recur on at least
    ``min_pages`` pages of its host.  Pages with the same main text count once,
    so copies of one page do not make a template, though an advert, a comment
    or a link differs.

    A list has subtrees of one page only and so stays as short as the page,
    however many of them a host has.
    """
    template = (subtrees.select("host", "hash", "page").distinct().groupBy("host", "hash").agg(F.count("*").alias("pages"))
                .where(F.col("pages") >= min_pages).select("host", "hash"))
    return (subtrees.where("read").join(template, ["host", "hash"])
            .groupBy("host", "key").agg(F.sort_array(F.collect_list("hash")).alias("hashes")))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars``.

    ``text`` joins the blocks by a blank line; it is empty for NULL or empty
    html and for pages without main text.  Character references are decoded,
    white space inside a block becomes one space.  A NULL url has the host ''.
    Ids may be NULL or repeat.  Empty input gives no rows; other columns are
    ignored.
    """
    from .common import cut

    rows = (pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                         F.col(html_col).cast("string").alias("html"))
            .withColumns({"host": host_of(F.col("url")), "key": F.xxhash64("html")}))
    template = cut(template_hashes(cut(page_subtrees(rows)), min_pages))
    total = template.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0]
    joined = rows.join(F.broadcast(template) if total <= BROADCAST_HASHES else template, ["host", "key"], "left")

    def text_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for html, hashes in zip(b["html"], b["hashes"]):
                root = parse(html if isinstance(html, str) else "")
                known = {h % 2**64 for h in hashes.tolist()} if hashes is not None else set()
                if known:
                    hash_subtrees(root)
                texts.append("\n\n".join(text_blocks(root, known)))
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": texts,
                                "n_chars": [len(t) for t in texts]})

    return (joined.select("page_id", "url", "html", "hashes")
            .mapInPandas(text_of, "page_id long, url string, text string, n_chars long"))
