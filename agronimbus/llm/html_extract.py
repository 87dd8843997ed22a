"""Main text of web pages by tree scoring.

Paragraphs give points for their length and commas to their ancestors, link
density discounts them, and the best container is kept with those siblings that
score well beside it. Menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments are cut off before scoring. A class, id or itemprop
cuts an element off only if all words of one of its names say so, and not if the element
holds the page's main, all its articles or, without these, most of its unlinked text
(comments: only if it holds main). If nothing is left, names are not looked at.

html null or without text gives an empty text. Broken markup never fails: missing
end tags are implied, stray ones ignored. Repeated pages are all returned. Time grows
with the length of a page; only points are passed up once a block, by one array addition.
Of two articles side by side the better one is the main text.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shipping import ship

# Element and attribute names of HTML and usual names of page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "head nav aside footer form button select input label fieldset menu dialog object canvas audio video search "
    "option datalist annotation annotation-xml".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner "
    "banners sidebar side aside rail widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs footer "
    "header masthead topbar toolbar cookie cookies consent gdpr notice notices alert warning popup modal overlay "
    "newsletter subscribe subscription signup login register share sharing social related recommended "
    "recommendations comment comments commentlist disqus reply replies respond responses discussion pagination pager "
    "skip legal copyright disclaimer paywall outbrain taboola form search".split()
)
#: Words beside them in names such as site-footer or left-sidebar.
PLACE_NAMES = frozenset(
    "site page main global top bottom left right primary secondary post entry article container wrapper wrap box area "
    "list inner outer section block bar slot unit item items link links title text mobile desktop sticky fixed".split()
)
#: Comments are often longer than the article and marked up like one.
COMMENT_NAMES = frozenset("comment comments commentlist disqus reply replies respond responses discussion".split())
#: An end tag of these closes the paragraphs and list items opened inside.
CLOSERS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>"'<]++|"[^"<]*+"|'[^'<]*+')*+[^>]*+)>|<[!?][^>]*+>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SPACE = re.compile(r"\s+")
NAME = re.compile(r"[a-z]+")
COMMAS = re.compile(r"[,،、，;；]")


class Node:
    """An element: its children are elements and pieces of text in page order."""

    __slots__ = ("name", "parent", "children", "attributes", "points", "text", "linked", "depth", "framed")

    def __init__(self, name: str, parent: Node | None, attributes: dict[str, str]):
        self.name, self.parent, self.attributes = name, parent, attributes
        self.depth: int = parent.depth + 1 if parent else 0
        #: Whether it stands inside an article or main.
        self.framed: bool = parent is not None and (parent.framed or parent.name in ("article", "main"))
        self.children: list[Node | str] = []
        self.points, self.text, self.linked = 0.0, 0, 0


class Open:
    """The open elements, from the page's root down, and where each name stands among them."""

    def __init__(self, root: Node):
        self.path = [root]
        self.places: dict[str, list[int]] = defaultdict(list)

    def add(self, node: Node) -> None:
        self.places[node.name].append(len(self.path))
        self.path.append(node)

    def close(self, place: int) -> None:
        """Close the element at a place of the path and all inside it."""
        while len(self.path) > place:
            self.places[self.path.pop().name].pop()

    def innermost(self, names: frozenset) -> int:
        places = self.places
        return max([places[n][-1] for n in names if places.get(n)], default=0)

    def close_implied(self, names: frozenset, stop: frozenset) -> None:
        """Close elements of ``names``, innermost first, as far as none of ``stop`` lies between."""
        while (place := self.innermost(names)) and place > self.innermost(stop):
            self.close(place)


PARAGRAPH = frozenset(["p"])
#: A new block inside these leaves a paragraph around them open.
PARAGRAPH_STOPS = frozenset(["button", "table", "td", "th", "li", "div", "article", "section", "blockquote", "body"])


def parse(page: str) -> Node:
    """The page's tree."""
    root = Node("html", None, {})
    still_open = Open(root)
    at, low = 0, None
    last = page.rfind(">") + 1  # no tag ends behind it
    for m in iter(lambda: TAG.search(page, at, last) if at < last else None, None):
        top = still_open.path[-1]
        if m.start() > at:
            top.children.append(page[at : m.start()])
        at, name = m.end(), (m["name"] or "").lower()
        if not name:
            if at == last and page.startswith("<!--", m.start()) and not page.endswith("-->", m.start() + 4, last):
                at = len(page)  # a comment without end
            continue
        if m["end"]:
            if still_open.places.get(name):
                still_open.close(still_open.places[name][-1])
            continue
        if name in ("html", "body") and top is root:
            root.attributes |= _attributes(m["rest"]) if name == "html" else {}
            continue
        if name in BLOCKS:
            still_open.close_implied(PARAGRAPH, PARAGRAPH_STOPS)
        if name in CLOSERS:
            still_open.close_implied(*CLOSERS[name])
        top = still_open.path[-1]
        node = Node(name, top, _attributes(m["rest"]))
        top.children.append(node)
        if name in RAW:
            low = low if low is not None else page.lower()
            if len(low) != len(page):  # a few letters get longer in lower case
                low = re.sub("[A-Z]", lambda x: x[0].lower(), page)
            end = low.find(f"</{name}", at)
            at = len(page) if end < 0 else (page.find(">", end) + 1 or len(page))
        elif name not in VOID and not m["rest"].endswith("/"):
            still_open.add(node)
    rest = page[at:].partition("<!--")[0] if at >= last else page[at:last] + page[last:].partition("<!--")[0]
    if rest:
        still_open.path[-1].children.append(rest)
    return root


def _attributes(rest: str) -> dict[str, str]:
    if not rest.strip(" /"):
        return {}
    return {k.lower(): entities.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(rest)}


def unwanted(node: Node) -> bool:
    """Whether an element is not part of the article, by its kind, role and visibility."""
    if node.name in DROPPED or node.name in RAW:
        return True
    a = node.attributes
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in DROPPED_ROLES:
        return True
    if "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    if node.name == "header":
        return not node.framed
    return False


def _unwanted_names(node: Node) -> set[str]:
    """The words for which an element's class, id or itemprop cuts it off."""
    if node.name in ("main", "body", "html"):
        return set()
    a, out = node.attributes, set()
    for name in f"{a.get('class', '')} {a.get('id', '')} {a.get('itemprop', '')}".lower().split() if a else ():
        parts = set(NAME.findall(name))
        if parts <= DROPPED_NAMES | PLACE_NAMES:
            out |= parts & DROPPED_NAMES
    return out


def cut_by_name(root: Node) -> set[int]:
    """Ids of the elements that their names cut off."""
    order, held, named = [], {}, []
    stack = [(root, False)]
    while stack:
        node, link = stack.pop()
        order.append(node)
        text = 0 if link else sum(len(c.strip()) for c in node.children if isinstance(c, str))
        held[id(node)] = [text, node.name == "article", node.name == "main"]
        if names := _unwanted_names(node):
            named.append((node, names))
        stack.extend((c, link or c.name == "a") for c in node.children if isinstance(c, Node) and not unwanted(c))
    if not named:
        return set()
    for node in reversed(order[1:]):
        above, own = held[id(node.parent)], held[id(node)]
        for i in range(3):
            above[i] += own[i]
    all_text, all_articles, all_mains = held[id(root)]

    def spared(node: Node, names: set[str]) -> bool:
        text, articles, mains = held[id(node)]
        if mains or names & COMMENT_NAMES:
            return bool(mains)
        return articles == all_articles if articles else not all_articles and not all_mains and 2 * text > all_text

    return {id(node) for node, names in named if not spared(node, names)}


def paragraphs(root: Node, cut: set[int] | frozenset[int] = frozenset()) -> list[tuple[Node, str, int]]:
    """(element, text, characters inside links) of each block of running text outside ``cut``."""
    out: list[tuple[Node, str, int]] = []
    pieces: list[str] = []
    linked = 0

    def flush(node: Node) -> None:
        nonlocal linked
        text = SPACE.sub(" ", entities.unescape("".join(pieces))).strip()
        if text:
            out.append((node, text, min(linked, len(text))))
        pieces.clear()
        linked = 0

    # An explicit stack: pages may nest deeper than Python calls can.
    stack: list[tuple[Node, Iterator, Node, bool]] = [(root, iter(root.children), root, False)]
    while stack:
        node, rest, block, link = stack[-1]
        for child in rest:
            if isinstance(child, str):
                pieces.append(child)
                linked += len(child) * link
            elif child.name in ("br", "wbr", "img"):
                pieces.append(" " * (child.name != "wbr"))
            elif id(child) in cut or unwanted(child):
                if child.name in BLOCKS:
                    flush(block)
            elif child.name in BLOCKS:
                flush(block)
                stack.append((child, iter(child.children), child, link))
                break
            else:
                stack.append((child, iter(child.children), block, link or child.name == "a"))
                break
        else:
            if node is block:
                flush(block)
            stack.pop()
    return out


#: Blocks that hold paragraphs are scored themselves.
HOLDERS = frozenset("div article section main td body html".split())


def pass_points(found: list[tuple[Node, str, int]]) -> list[Node]:
    """Give each block's points to its ancestors, a share for each level; the elements reached.

    Blocks come in page order, so only the shares along the path to the current one are
    kept, as an array by depth.
    """
    reached: dict[int, Node] = {}
    deepest = max(block.depth for block, _, _ in found) + 1
    levels, shares = np.arange(1.0, deepest + 1), np.zeros(deepest)
    path: list[Node] = []
    for block, text, linked in found:
        points = (1 + len(COMMAS.findall(text)) + min(len(text) / 100, 3)) * (1 - linked / len(text))
        first = up = block if block.name in HOLDERS else block.parent
        new = []
        while up is not None and not (up.depth < len(path) and path[up.depth] is up):
            new.append(up)
            reached.setdefault(id(up), up)
            up = up.parent
        if first is None:
            continue
        kept = first.depth + 1 - len(new)
        for node in path[kept:]:
            node.points += float(shares[node.depth])
        shares[kept : first.depth + 1] = 0
        path[kept:] = reversed(new)
        shares[: first.depth + 1] += points / levels[first.depth :: -1]
    for node in path:
        node.points += float(shares[node.depth])
    return list(reached.values())


def main_text(page: str | None) -> str:
    """The article's blocks, joined by two line ends; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    cut = cut_by_name(root)
    found = paragraphs(root, cut) or (paragraphs(root) if cut else [])
    if not found:
        return ""
    scored = pass_points(found)
    if not scored:
        return "\n\n".join(text for _, text, _ in found)
    around: dict[int, Node] = {}
    for block, text, linked in found:
        block.text += len(text)
        block.linked += linked
        up: Node | None = block
        while up is not None and id(up) not in around:
            around[id(up)] = up
            up = up.parent
    downwards = sorted(around.values(), key=lambda n: n.depth)
    for node in reversed(downwards[1:]):
        node.parent.text += node.text
        node.parent.linked += node.linked
    for node in scored:
        node.points = (node.points + 25 * (node.name in ("article", "main"))) * (1 - node.linked / max(node.text, 1))
    best = max(scored, key=lambda n: n.points)
    up = best.parent
    while up is not None:  # the article around the best section
        if up.name == "article":
            best = up
        up = up.parent
    kept = {id(best)}
    for sibling in best.parent.children if best.parent and best.name != "article" else ():
        if isinstance(sibling, Node) and sibling.text:
            dense = sibling.linked / sibling.text
            heading = sibling.name in ("h1", "h2", "h3", "h4", "h5", "h6")
            if dense < 0.5 and (sibling.points >= max(10.0, best.points / 5) or heading or sibling.name == "p" and (sibling.text > 80 or dense == 0)):
                kept.add(id(sibling))
    for node in downwards[1:]:
        if id(node.parent) in kept:
            kept.add(id(node))
    return "\n\n".join(text for block, text, _ in found if id(block) in kept)


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Main text of every page: key, url, text, n_chars (code points).

    No shuffle: each page is read by one task. html null or without text: empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.record_batch(
                [b.column(0), b.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    ship(pages.sparkSession)
    types = dict(pages.select(key, url).dtypes)
    return pages.select(key, url, F.col(html).cast("string")).mapInArrow(
        run, f"page_id {types[key]}, url {types[url]}, text string, n_chars bigint"
    )


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERY = ("op7_html_extract", page_texts)
