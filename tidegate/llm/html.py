"""Main text of web pages by composite text density."""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import slices, text_or_empty

# Names of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul "
    "br caption option optgroup".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
ENDS_P = BLOCKS - {"br", "caption", "option", "optgroup"}
ENDED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
SCOPES = frozenset("table td th ul ol dl div article section main aside body html".split())
NOT_TEXT = frozenset(
    "head script style title noscript template iframe svg math canvas object embed audio video map form button input select "
    "textarea nav menu aside footer dialog option datalist noembed noframes xmp".split()
)
# Words in class, id or role of parts beside the main text.
BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsbygoogle adbox adslot banner banners sponsor sponsored promo "
    "promos promotion nav navbar navigation menu menus breadcrumb breadcrumbs topbar toolbar masthead header footer foot sidebar "
    "sidebars aside rail widget widgets comment comments commentlist discussion disqus respond replies reply reactions cookie cookies consent "
    "gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations pagination pager tags skip search copyright legal disclaimer "
    "complementary contentinfo dialog".split()
)
# Those of them that stand for what readers say.
COMMENTS = frozenset("comment comments commentlist discussion disqus respond replies reply reactions".split())
BARRIERS = frozenset("table ul ol dl div article section main aside body".split())
# A quote opens a value only after an equals sign; elsewhere in a tag it is a sign like any other.
PIECE = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*(?:\"|$)|'[^']*(?:'|$))|[^>])*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'=/>][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|$)|'([^']*)(?:'|$)|([^\s>]+)))?")
TELLING = re.compile(r"class|id|role|hidden|style", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# A header so named belongs to the text.
OF_TEXT = frozenset("article post entry content story main page".split())
# A name with one of these says how a part is laid out or what it has, not what it is.
STATES = frozenset(
    "with without has have no not non is are be show shows hide hides use uses enable enabled disable disabled open opened close closed "
    "active inactive visible invisible hidden fixed sticky collapsed expanded on off full above below after before".split()
)
# Words that a name of a part beside the main text may have besides the telling ones.
QUALIFIERS = OF_TEXT | frozenset(
    "site web global local primary secondary sub left right top bottom upper lower center side mobile desktop small large mini big "
    "wrapper wrap container holder inner outer box block area zone section region panel pane bar row col column columns list lists item "
    "items group set link links button buttons btn icon icons form field text title heading body unit slot space trail path "
    "toggle dropdown drop down tab tabs toolbox tools posts articles entries stories pages blog news user reader author "
    "thread threads js the our your this el element component module google fb facebook twitter x count number meta info message msg us".split()
)


RAW_ENDS = {name: re.compile(rf"</{name}\b[^>]*(?:>|$)", re.I) for name in RAW}


class Node:
    __slots__ = ("name", "parent", "children", "beside", "own", "chars", "tags", "link_chars", "link_tags", "density", "sum", "depth", "named", "plain", "mains", "bodies", "free", "talk")

    def __init__(self, name: str, parent: Node | None, beside: bool, named: bool = False, talk: bool = False):
        self.name, self.parent, self.beside, self.named, self.talk = name, parent, beside, named, talk
        self.children: list[Node | str] = []
        self.depth = parent.depth + 1 if parent else 0


class OpenNodes:
    """The nodes that are open, outermost first, with the places of each name, so that the node that a tag closes is
    found without a walk, however deep the page is."""

    def __init__(self, root: Node):
        self.path = [root]
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.path))
        if node.name in SCOPES:
            self.scopes.append(len(self.path))
        self.path.append(node)

    def cut(self, place: int) -> None:
        """Close the node at a place and all within it."""
        while len(self.path) > place:
            name = self.path.pop().name
            self.places[name].pop()
            if name in SCOPES:
                self.scopes.pop()

    def last(self, name: str) -> int:
        """Place of the innermost node of a name; 0 if none is open."""
        places = self.places.get(name)
        return places[-1] if places else 0

    def end(self, name: str) -> bool:
        """Close the innermost node of a name, if none but a scope's own end tag reaches out of its scope."""
        place = self.last(name)
        if not place or name not in SCOPES and self.scopes and self.scopes[-1] > place:
            return False
        self.cut(place)
        return True

    def end_of(self, names) -> None:
        """Close the outermost node of the names that stands within the innermost barrier other than these."""
        barrier = max((self.last(b) for b in BARRIERS if b not in names), default=0)
        found = []
        for name in names:
            places = self.places.get(name, ())
            at = bisect_right(places, barrier)
            if at < len(places):
                found.append(places[at])
        if found:
            self.cut(min(found))


def parse(page: str) -> Node:
    """The tree of a page. End tags may be missing, wrong or crossed, as browsers take them."""
    root = Node("#page", None, False)
    opened = OpenNodes(root)
    any_named = False
    at, size = 0, len(page)
    while at < size:
        m = PIECE.search(page, at)
        said = page[at : m.start() if m else size]
        if said:
            opened.path[-1].children.append(html.unescape(said) if "&" in said else said)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if not opened.end(name) and name in ("p", "br"):
                opened.path[-1].children.append(Node("br", opened.path[-1], False))
            continue
        ending = ENDED_BY.get(name, ()) if name in ENDED_BY else ("p",) if name in ENDS_P else ()
        if name in ENDS_P and "p" not in ending:
            ending = {*ending, "p"}
        if ending:
            opened.end_of(ending)
        attributes = m[3]
        hidden, named, talk = _said(name, attributes) if attributes else (False, False, False)
        beside = hidden or name in NOT_TEXT or name == "header" and not (opened.last("article") or opened.last("main"))
        top = opened.path[-1]
        node = Node(name, top, beside or named, named and not beside, talk)
        any_named = any_named or node.named
        top.children.append(node)
        if name in RAW:
            end = RAW_ENDS[name].search(page, at)
            at = end.end() if end else size
        elif name not in VOID and not attributes.endswith("/"):
            opened.push(node)
    if any_named:
        _keep_wrappers(root)
    return root


def _keep_wrappers(root: Node) -> None:
    """Parts that are beside the text only by a class or id stay if they hold the text: a main part, or, where no article
    or main part stands outside, an article or most of the page's text that is no link. Comments stay only around a
    main part, however long they are."""
    nodes, waiting = [], [(root, False)]
    while waiting:
        node, linked = waiting.pop()
        linked = linked or node.name == "a"
        node.plain = 0 if linked else sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        nodes.append(node)
        waiting.extend((c, linked) for c in node.children if isinstance(c, Node) and (c.named or not c.beside))
    for node in reversed(nodes):
        kept = [c for c in node.children if isinstance(c, Node) and (c.named or not c.beside)]
        node.plain += sum(c.plain for c in kept)
        node.mains = (node.name == "main") + sum(c.mains for c in kept)
        node.bodies = (node.name in ("article", "main")) + sum(c.bodies for c in kept)
        node.free = (node.name in ("article", "main")) + sum(c.free for c in kept if not c.named)
    down = [(root, root.free)]
    while down:
        node, outside = down.pop()
        if node.named:
            if not (node.mains or not node.talk and not outside and (node.bodies or 2 * node.plain > root.plain)):
                continue
            node.beside = node.named = False
            outside += node.free
        down.extend((c, outside) for c in node.children if isinstance(c, Node) and (c.named or not c.beside))


def _said(name: str, attributes: str) -> tuple[bool, bool, bool]:
    """What the attributes say: the part is hidden, its names are those of a part beside the text, and of comments.

    A page whose body is hidden is shown by a script later."""
    if not TELLING.search(attributes):
        return False, False, False
    values: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        values.setdefault(m[1].lower(), html.unescape(value) if "&" in value else value)
    whole = name in ("body", "html")
    if not whole and ("hidden" in values or values.get("aria-hidden", "").strip().lower() == "true" or "style" in values and _unseen(values["style"])):
        return True, False, False
    if whole or name in ("article", "main"):
        return False, False, False
    telling = [_of_side(n) for key in ("class", "id", "role") for n in values.get(key, "").split()]
    return False, any(telling), any(t & COMMENTS for t in telling)


def _unseen(style: str) -> bool:
    for one in style.lower().split(";"):
        key, _, value = one.partition(":")
        if (key.strip(), value.split("!")[0].strip()) in (("display", "none"), ("visibility", "hidden"), ("visibility", "collapse")):
            return True
    return False


def _of_side(name: str) -> frozenset[str] | set[str]:
    """The telling words of one whole name, if all its words are such or may stand beside them and none is a state."""
    words = {w.lower() for w in WORDS.findall(name)}
    telling = (words & BESIDE) - ({"header"} if words & OF_TEXT else set())
    return telling if not words & STATES and all(w in BESIDE or w in QUALIFIERS or len(w) == 1 for w in words) else frozenset()


def _in_order(root: Node) -> list[Node]:
    """Nodes of the main candidates, parents first; parts beside the text are left out."""
    found, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        found.append(node)
        waiting.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.beside)
    return found


def measure(root: Node) -> list[Node]:
    """Text, tags and links under each node, its composite density, and the sum of its children's densities."""
    nodes = _in_order(root)
    for node in reversed(nodes):
        kept = [c for c in node.children if isinstance(c, Node) and not c.beside]
        node.own = sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        node.chars = node.own + sum(c.chars for c in kept)
        node.tags = sum(c.tags + 1 for c in kept)
        node.link_chars = node.chars if node.name == "a" else sum(c.link_chars for c in kept)
        node.link_tags = sum(c.link_tags + (c.name == "a") for c in kept)
    chars, link_chars = max(1, root.chars), root.link_chars
    for node in nodes:
        c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        if not c:
            node.density = 0.0
            continue
        base = math.log(c / max(1, c - node.link_chars) * node.link_chars + link_chars / chars * c + math.e)
        node.density = c / t * math.log(max(1.0, c / lc * t / lt)) / math.log(base) if base > 1 and base != math.e else c / t
        node.density = max(node.density, 0.0)
        if not node.link_chars:
            node.density = max(node.density, c / t)
    for node in nodes:
        node.sum = node.own + sum(c.density for c in node.children if isinstance(c, Node) and not c.beside)
    return nodes


def main_nodes(root: Node) -> list[Node]:
    """The subtrees with the main text.

    The node with the greatest sum of densities is the heart of the page; the least density on the path from it to the
    body is the threshold. Subtrees beside the path that reach it, and hold little link text, belong to the text, as
    an article whose parts lie in several containers does. An ``article`` or ``main`` around the heart bounds it.
    """
    nodes = [n for n in measure(root) if n.chars]
    if not nodes:
        return []
    heart = max(nodes, key=lambda n: (n.sum, n.depth))
    path, node = [heart], heart
    while node.parent is not None:
        node = node.parent
        path.append(node)
    bound = next((n for n in path if n.name == "article"), next((n for n in path if n.name == "main"), None))
    if bound is not None:
        return [bound]
    inside = [n for n in path if n.name not in ("#page", "html")]
    threshold = min((n.density for n in inside), default=0.0)
    top = next((n for n in reversed(inside)), heart)
    chosen: list[Node] = []

    def choose(node: Node) -> None:
        waiting = [node]
        while waiting:
            n = waiting.pop()
            if n in on_path and n is not heart:
                waiting.extend(c for c in reversed(n.children) if isinstance(c, Node) and not c.beside)
            elif n is heart or n.chars and n.density >= threshold and n.link_chars * 2 < n.chars:
                chosen.append(n)

    on_path = set(path)
    choose(top)
    return chosen


def blocks_of(nodes: list[Node]) -> list[str]:
    """Texts of the blocks under the nodes in page order, white space folded, empty ones left out."""
    found: list[str] = []
    parts: list[str] = []

    def end_block() -> None:
        text = " ".join("".join(parts).split())
        if text:
            found.append(text)
        parts.clear()

    waiting: list = []
    for top in reversed(nodes):
        waiting.append((top, False))
    while waiting:
        item, closing = waiting.pop()
        if isinstance(item, str):
            parts.append(item)
            continue
        if item.beside:
            if item.name in BLOCKS:
                end_block()
            continue
        block = item.name in BLOCKS
        if block:
            end_block()
        if not closing:
            if block:
                waiting.append((item, True))
            waiting.extend((c, False) for c in reversed(item.children))
    end_block()
    return found


def extract(page: str) -> str:
    """Main text of one page."""
    return "\n".join(blocks_of(main_nodes(parse(page))))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages``.

    The whole page is parsed. A null or empty page, or one without text beside its menus, forms and so on, has an empty
    text. Null ids and urls stay null, repeated rows are each extracted, other columns are not read, and an empty table
    gives an empty one.
    """

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = [extract(p) for p in batch.column(2).to_pylist()]
            sizes = pa.array([len(t) for t in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).alias("html"))
    return rows.mapInArrow(texts, "page_id bigint, url string, text string, n_chars bigint")
