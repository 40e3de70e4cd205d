"""Main text of pages by equivalence-class template deduction.

Tokens of a page are its block elements, by a hash of their path, and the texts of its
blocks, by path and words. Tokens of a host's pages with the same occurrence vector (how often on which
page) form an equivalence class; classes that cover enough pages and have more than one
token are valid. Their tokens, in the order in which pages have them, are the host's
template: a page follows it by the longest run of template tokens that come in that order,
which nests the classes by path and order. What lies between template tokens are the page's
slots, and their text is extracted. Slots that a host fills with links, and elements that
say by name or role that they are no article, are left out.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, map_rows
from .urls import host

#: A class is valid from this share of a host's pages on, and this many pages.
SUPPORT, LEAST_PAGES = 0.5, 3
#: From this share of its characters in links on a slot holds links.
LINKED = 0.8
#: If names and roles leave less than this share of a page's text, those on elements with most of it don't count.
LEFT, MOST = 0.05, 0.8
#: Tokens of all templates up to which they are broadcast (16 bytes each).
BROADCAST_TOKENS = 1_000_000

# HTML's elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe title textarea xmp noembed noframes".split())
FOREIGN = ("svg", "math")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math mi mo mn ms mtext mrow msup msub msubsup mfrac msqrt mroot mstyle munder mover munderover semantics annotation svg g path text tspan circle ellipse rect line polyline polygon defs use".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
ASIDE = frozenset("nav footer aside form button select dialog menu head".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form".split())
#: Elements that a name says nothing about: parts of running text.
UNNAMED = frozenset("html body article main p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption li dt dd tr td th".split())
#: Words of names of boilerplate, and what may follow them in a name: a share-bar is one, a share-price isn't.
WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion promotions banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist respond disqus replies share sharing social related recommended recommendations widget widgets toolbar pagination pager disclaimer copyright".split())
GENERIC = frozenset("list item items link links button buttons btn bar box area inner outer wrapper wrap container section block slot unit content body title text row col column group panel left right top bottom main primary secondary site page post posts article articles form icon icons fixed open header head thread".split())
MAIN = ("article", "main")

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>""", re.S)
NAMED = re.compile(r"""(?i)\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def boilerplate(names: str) -> bool:
    """Whether a class or id is made of a word of boilerplate with nothing but such and generic words after it."""
    for name in names.split():
        parts = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", name)]
        first = next((k for k, w in enumerate(parts) if w in WORDS), None)
        if first is not None and all(w in WORDS or w in GENERIC for w in parts[first:]):
            return True
    return False


def digest(*parts: int | str) -> int:
    """A hash of 63 bits."""
    return xxhash.xxh64_intdigest("\0".join(map(str, parts)).encode()) >> 1


class Node:
    """An element: tag, hash of its path's labels, its parent, whether its name or role makes it boilerplate, whether it is in a link."""

    __slots__ = ("tag", "path", "up", "aside", "link", "main", "size")

    def __init__(self, tag: str, attributes: str, up: Node | None):
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in NAMED.finditer(attributes)}
        names = f"{found.get('class', '')} {found.get('id', '')}".strip()
        label = tag + ("." + re.sub(r"\d+", "0", names.split()[0]) if names else "")
        self.tag, self.up = tag, up
        # inline elements are part of the block that they stand in
        self.path = up.path if up and tag in INLINE else digest(up.path if up else 0, label)
        self.main = bool(up and up.main) or tag in MAIN
        self.link = bool(up and up.link) or tag == "a"
        self.size = 0
        # 2: hidden, never shown; 1: boilerplate by tag, role or name, unless the element turns out to be the page's frame
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or tag in ("head", "select", "button")
        own = tag in ASIDE or tag == "header" and not self.main or found.get("role", "").lower() in ROLES
        self.aside = 2 if hidden else int(own or tag not in UNNAMED and boilerplate(names))


def strings(page: str) -> Iterator[tuple[Node, str | None, bool]]:
    """In order of the page: (node, string, False) for text, and where an element begins or a block ends
    (node, None, whether an element begins)."""
    stack, at, size = [Node("#", "", None)], 0, len(page)
    opened: Counter = Counter()
    while at < size:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else size]
        if text:
            yield stack[-1], text, False
        if not m:
            return
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if opened[tag]:
                while (last := stack.pop().tag) != tag:
                    opened[last] -= 1
                opened[tag] -= 1
            if tag not in INLINE:
                yield stack[-1], None, False
            continue
        if tag not in INLINE:
            yield stack[-1], None, False
        if tag in RAW:
            end = re.compile(rf"(?i)</{re.escape(tag)}\s*>").search(page, at)
            at = end.end() if end else size
            continue
        if tag in VOID or m[3].endswith("/") and (tag in FOREIGN or any(opened[t] for t in FOREIGN)):
            continue
        if tag not in INLINE:  # a block ends an open paragraph with all inline elements in it
            k = len(stack) - 1
            while stack[k].tag in INLINE:
                k -= 1
            if stack[k].tag == "p":
                opened.subtract(n.tag for n in stack[k:])
                del stack[k:]
        shut = CLOSES.get(tag, ())
        if stack[-1].tag in shut:
            opened[stack.pop().tag] -= 1
        stack.append(Node(tag, m[3], stack[-1]))
        opened[tag] += 1
        yield stack[-1], None, True


def container(node: Node) -> int:
    """The path of the element that a block stands in, 0 for the page itself."""
    while node.up and node.tag in INLINE:
        node = node.up
    return node.up.path if node.up and node.up.up else 0


class Page:
    """A page's tokens in order, with what is boilerplate by name decided.

    ``parts`` has (token, node, None) where a block element begins and (token, node, strings)
    for the text of a block, whose strings are (node, string).
    """

    def __init__(self, page: str | None):
        self.parts: list[tuple[int, Node, list[tuple[Node, str]] | None]] = []
        nodes: list[Node] = []
        block: list[tuple[Node, str]] = []
        for node, text, opened in strings(page or ""):
            if opened:
                nodes.append(node)
            if text is not None:
                block.append((node, text))
                node.size += 0 if node.link else len(text.strip())
            elif not opened or node.tag not in INLINE:
                self.close(block)
                block = []
                if opened:
                    self.parts.append((node.path, node, None))
        self.close(block)
        for node in reversed(nodes):  # children come after their parents
            node.up.size += node.size
        total = nodes[0].up.size if nodes else 0
        # elements that hold the article are no part of the page beside it
        article = max((n for n in nodes if n.tag in MAIN), key=lambda n: n.size, default=None)
        if article and 2 * article.size >= total:
            up = article.up
            while up:
                up.aside, up = 0 if up.aside == 1 else up.aside, up.up
        self.inherit(nodes)
        left = sum(len(text.strip()) for _, _, found in self.parts for node, text in found or () if not node.aside and not node.link)
        if left < LEFT * total:
            for node in nodes:
                if node.aside == 1 and node.size >= MOST * total and node.tag not in ("nav", "footer"):
                    node.aside = 0
            self.inherit(nodes, again=True)

    def close(self, block: list[tuple[Node, str]]) -> None:
        """Add a block; one of white space alone is none."""
        words = " ".join("".join(t for _, t in block).split())
        if words:
            self.parts.append((digest(block[0][0].path, words), block[0][0], block))

    def inherit(self, nodes: list[Node], again: bool = False) -> None:
        """Carry ``aside`` down: from 3 on it is a parent's."""
        for node in nodes:
            if again and node.aside >= 3:
                node.aside = 0
            if node.up.aside and node.aside < 1:
                node.aside = 3

    def sizes(self) -> dict[int, list[int]]:
        """Characters of each path's own text outside boilerplate, not in links and in links."""
        found: dict[int, list[int]] = {}
        for _, _, block in self.parts:
            for node, text in block or ():
                if not node.aside:
                    found.setdefault(node.path, [0, 0])[node.link] += len(text.strip())
        return found

    def said(self) -> tuple[Counter, Counter, dict[int, int]]:
        """Characters of text outside boilerplate and links: of each block by its token, of the blocks right below each
        element by its path, and which path that is for each block's token."""
        of_block, below, where = Counter(), Counter(), {}
        for token, node, block in self.parts:
            if block:
                n = sum(len(text.strip()) for node, text in block if not node.aside and not node.link)
                where[token] = container(node)
                of_block[token] += n
                below[where[token]] += n
        return of_block, below, where

    def template(self, order: dict[int, int]) -> set[int]:
        """Tokens of the template that the page has in the template's order: a longest such run of their first places."""
        seen: set[int] = set()
        tails: list[int] = []
        last: list[int] = []
        found: list[tuple[int, int]] = []  # (token, index of the one before in the best run that ends here)
        for token, _, _ in self.parts:
            if token in order and token not in seen:
                seen.add(token)
                k = bisect_left(tails, order[token])
                found.append((token, last[k - 1] if k else -1))
                if k == len(tails):
                    tails.append(0)
                    last.append(0)
                tails[k], last[k] = order[token], len(found) - 1
        at, run = last[-1] if last else -1, set()
        while at >= 0:
            run.add(found[at][0])
            at = found[at][1]
        return run

    def blocks(self, order: dict[int, int] | None = None, linked: set[int] | None = None, copied: set[int] | None = None) -> list[str]:
        """Text blocks in the page's slots.

        Slots of links are those of the host and, of paths that the template lacks, the page's
        own. Blocks of the template are dropped, but for those in ``copied`` elements of the
        host, which hold copies of one article.
        """
        order = order or {}
        links = {path for path, (plain, link) in self.sizes().items() if path not in order and link and link >= LINKED * (plain + link)} | (linked or set())
        slots = []
        for token, node, block in self.parts:
            if block and (node.path not in links or self.heading(node)):
                text = " ".join(entities.unescape("".join(t for n, t in block if not n.aside)).split())
                if text:
                    slots.append((token, container(node) in (copied or ()), text))
        frame = self.template(order)
        return [t for token, kept, t in slots if kept or token not in frame]

    @staticmethod
    def heading(node: Node) -> bool:
        """Whether a string's block is the page's heading, which may be a link."""
        while node.up and node.tag in INLINE:
            node = node.up
        return node.tag == "h1"


def tokens(pages: DataFrame) -> DataFrame:
    """Per page: host, token, two halves of this page's part of the occurrence vector, relative place,
    characters in a slot that lie in links or not (of element tokens), those of a block and the path it
    stands in, and those of all blocks right below an element.

    Token 0 stands for the page, and what is below no element; all its blocks' characters are its own.
    """
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(10)]
            for name, key, html in zip(*(c.to_pylist() for c in batch.columns)):
                page = Page(html)
                count: Counter = Counter(token for token, _, _ in page.parts)
                first: dict[int, float] = {}
                for k, (token, _, _) in enumerate(page.parts):
                    first.setdefault(token, k / len(page.parts))
                sizes, (said, below, where) = page.sizes(), page.said()
                count[0], first[0], said[0] = 1, 0.0, said.total()
                for token, n in count.items():
                    part = digest(key, n)
                    plain, link = sizes.get(token, (0, 0))
                    for column, value in zip(out, (name, token, part >> 32, part & 0xFFFFFFFF, first[token], plain, link, said[token], where.get(token), below[token])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), *[pa.int64()] * 3, pa.float64(), *[pa.int64()] * 5))], names=["host", "token", "high", "low", "place", "plain", "link", "said", "within", "below"])

    key = F.xxhash64(pages["page_id"], pages["url"], pages["html"])
    rows = pages.select(host(pages["url"]).alias("host"), key.alias("key"), pages["html"].alias("html"))
    return rows.mapInArrow(run, "host string, token bigint, high bigint, low bigint, place double, plain bigint, link bigint, said bigint, within bigint, below bigint")


def frequent(pages: DataFrame) -> DataFrame:
    """(host, token, high, low, support, place, plain, link, said, within, below) of tokens on LEAST_PAGES pages of a host or more; token 0 stands for its pages.

    Parts of vectors are added up by page, so no host's pages ever meet in one task, and copies
    of a page don't cancel each other. Rarer tokens go before any join.
    """
    found = tokens(pages).groupBy("host", "token").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.count("*").alias("support"), F.avg("place").alias("place"), *(F.sum(c).alias(c) for c in ("plain", "link", "said", "below")), F.max("within").alias("within"))
    return checkpointed(found.where(F.col("support") >= LEAST_PAGES))


def classes(found: DataFrame) -> DataFrame:
    """Of frequent() tokens on enough of a host's pages: their class (the sums of hashed parts stand for the
    occurrence vector), support, mean place, whether the class is valid, whether the slot below an element holds links,
    what is said in a block, and where it stands."""
    totals = found.where("token = 0").select("host", F.col("support").alias("pages"))
    common = found.where("token <> 0").join(totals, "host").where(F.col("support") >= SUPPORT * F.col("pages"))
    sizes = common.groupBy("host", "high", "low", "support").agg(F.count("*").alias("size"))
    valid = common.join(sizes, ["host", "high", "low", "support"]).withColumn("valid", F.col("size") > 1)
    return valid.select("host", "token", "high", "low", "support", "place", "valid", (F.expr("link > 0") & (F.col("link") >= LINKED * (F.col("plain") + F.col("link")))).alias("linked"), "said", "within")


def copied(found: DataFrame, made: DataFrame) -> DataFrame:
    """(host, copied): paths of elements whose blocks are copies of one article, from frequent() tokens and their classes.

    Such an element has half or more of what the host's pages say of their own, and yet says more
    in the template's blocks; or nothing that they say is their own. All other elements with
    blocks of the template are its frame.
    """
    framed = made.where("valid AND within IS NOT NULL").groupBy("host", "within").agg(F.sum("said").alias("framed"))
    held = found.where("token = 0 OR within IS NULL").select("host", F.col("token").alias("within"), "below")
    whole = found.where("token = 0").select("host", F.col("said").alias("whole"))
    own = framed.groupBy("host").agg(F.sum("framed").alias("all_framed")).join(whole, "host").select("host", (F.col("whole") - F.col("all_framed")).alias("own"))
    both = framed.join(held, ["host", "within"]).join(own, "host")
    most = (2 * (F.col("below") - F.col("framed")) >= F.col("own")) & (2 * F.col("framed") > F.col("below"))
    return both.where((F.col("own") <= 0) | most).groupBy("host").agg(F.collect_set("within").alias("copied"))


def templates(pages: DataFrame) -> DataFrame:
    """(host, tokens, linked, copied): the tokens of a host's valid classes in their order, paths of slots of links, and copied().

    A frequent token is on half of the host's pages, so a template has at most twice the tokens of a mean page.
    """
    found = frequent(pages)
    made = checkpointed(classes(found))
    entry = F.when(F.col("valid"), F.struct("place", "token"))
    lists = made.groupBy("host").agg(F.sort_array(F.collect_list(entry)).alias("ordered"), F.collect_set(F.when(F.col("linked"), F.col("token"))).alias("linked"))
    lists = lists.join(copied(found, made), "host", "left")
    return lists.select("host", F.transform("ordered", lambda e: e["token"]).alias("tokens"), "linked", "copied")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars, one row for each row of ``pages``.

    Blocks are joined in page order by a line feed, white space within one becomes a space,
    character references are decoded. A null or empty page gives the empty string. Pages of
    a host with fewer than LEAST_PAGES pages have no template: all their strings are in
    slots. Null urls share the empty host. Equal pages are each a page. Of template tokens
    at one mean place the smaller hash comes first. Very long and very deep pages are read
    whole, in time linear but for the logarithm of the template's size. Other columns of
    ``pages`` are not read.
    """
    found = checkpointed(templates(pages))
    few = (found.agg(F.sum(F.size("tokens") + F.size("linked") + F.coalesce(F.size("copied"), F.lit(0)))).first()[0] or 0) <= BROADCAST_TOKENS
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html"), host(pages["url"]).alias("host"))
    rows = rows.join(F.broadcast(found) if few else found, "host", "left").select("page_id", "url", "html", "host", "tokens", "linked", "copied")

    def run(page_id: list, url: list, page: list, name: list, order: list, linked: list, copied: list) -> dict[str, list]:
        made, known = [], {}
        for p, h, o, x, c in zip(page, name, order, linked, copied):
            if o is None:
                made.append("\n".join(Page(p).blocks()))
                continue
            if h not in known:
                known[h] = {t: k for k, t in enumerate(o)}, set(x), set(c or ())
            made.append("\n".join(Page(p).blocks(*known[h])))
        return {"page_id": page_id, "url": url, "text": made, "n_chars": [len(t) for t in made]}

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    return map_rows(rows, run, schema, "page_id bigint, url string, text string, n_chars bigint")
