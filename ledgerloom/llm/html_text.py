"""Main text of web pages by composite text density.

A page is read into a tree of elements.  Each element's density is its characters per tag, adjusted by how much of it
is links, relative to the link share of the whole body.  The element with the largest sum of its children's densities
is the core; the least density on its path from the body is the threshold, and elements beside the core that reach it
are main text too.  A core within ``article`` or ``main`` elements extends to the outermost of them.

Scripts, styles, menus, forms and the like never count by their tag or role, nor does what is hidden.  A name, that is a
class or id, is a suspicion only: outside an article a part so named goes unless it holds an article or, on a page
without one, most of the text that is no link, as a wrapper does; inside an article it goes if a good part of it is links, or, for the names
of adverts, notices and sidebars, if it is small beside the rest.  Headings are never judged by name.

A page is read once from start to end; a tag is read attribute by attribute, and each step up the tree is paid for by
a step down, so that no markup takes more than linear time.  A page is handled within one row and nothing is shuffled.

Defined cases: a null or empty html, and one without main text, gives an empty text; a page without tags is all text;
unclosed, stray or cut-off tags are tolerated, and a tag that never ends is text; of equal densities the first counts;
repeated rows give repeated rows; an empty table gives no row; only page_id, url and html are read, so that other
columns' names can't clash.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerloom.llm.common import LONG, STR, map_rows

TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")

# Fixed values of HTML: element kinds by name.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html li dd dt td th tr tbody thead tfoot caption summary".split())
#: What an opening tag closes, up to the nearest of the second group.
SIBLINGS = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
SIBLINGS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in SIBLINGS.items()}
#: Elements that are no article text.
BOILERPLATE = frozenset("nav footer aside form button select dialog menu head object audio video canvas annotation annotation-xml".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar note".split())
#: Elements that a page can do without in any case but as a wrapper of all of it.
WRAPPERS = frozenset(("form",))
COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
STRONG = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar masthead footer cookie cookies consent gdpr newsletter subscribe signup share sharing social pagination pager popup modal login skip".split())
#: Those of them that name what is never the article's own, whatever it says.
PAID = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion cookie cookies consent gdpr newsletter subscribe signup".split())
WEAK = frozenset("aside banner header notice related recommended reply widget toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 body html article main".split())
#: Containers, of whose names each part counts; other elements' names count as a whole.
CONTAINERS = frozenset("div section ul ol dl table header".split())
#: Parts of lists and tables, which have short texts without sentences.
ITEMS = frozenset("li dt dd td th".split())
#: The share of links from which a suspect goes, and the share of the page's text up to which a small one does.
LINKED, SMALL = 0.3, 0.2


SENTENCE_END = re.compile(r"[.!?]")
SENTENCE_WORDS = 3


class Node:
    __slots__ = ("tag", "parent", "parts", "chars", "link_chars", "tags", "link_tags", "drop", "density", "within", "suspect", "holds", "says", "shut")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.parts: list[Node | str] = []
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.drop, self.density = False, 0.0
        self.within = parent is not None and (parent.within or parent.tag in ("article", "main"))
        self.suspect, self.holds, self.says = "", tag in ("article", "main"), False
        self.shut: set[str] | None = None  # tags that can't be closed from here


def attributes(page: str, at: int) -> tuple[dict[str, str], int, bool]:
    """Of the tag whose name ends at a place: its attributes, where it ends, and whether it closes itself."""
    found: dict[str, str] = {}
    while True:
        m = ATTRIBUTE.match(page, at)
        if m is None:
            end = page.find(">", at)
            end = len(page) if end < 0 else end + 1
            return found, end, page[at : end - 1].rstrip().endswith("/")
        found.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
        at = m.end()


def _named(node: Node, value: str) -> str:
    """What a class or id makes an element suspect of."""
    words = set(value.lower().split())
    if node.tag in CONTAINERS:
        words |= {w for x in words for w in re.split("[-_]", x)}
    if node.tag == "header" and node.within:
        words -= WEAK
    return "comment" if words & COMMENTS else "paid" if words & PAID else "strong" if words & STRONG else "weak" if words & WEAK else ""


def _judge(node: Node, own: dict[str, str]) -> None:
    """Sets drop and suspect by tag and attributes."""
    if node.tag in WRAPPERS:
        node.suspect = "wrapper"
    if node.tag in BOILERPLATE - WRAPPERS or node.tag == "header" and not node.within:
        node.drop = True
    if not own:
        return
    rules = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(":") for x in own.get("style", "").split(";"))}
    unseen = rules.get("display", "").startswith("none") or rules.get("visibility", "").startswith("hidden")
    if unseen or "hidden" in own or own.get("aria-hidden", "").lower() == "true" or own.get("role", "").strip().lower() in ROLES:
        node.drop = True
    if node.tag not in HEADINGS and not node.suspect:
        node.suspect = min((_named(node, own[k]) for k in ("class", "id") if k in own), key=("comment", "paid", "strong", "weak", "").index, default="")


def parse(page: str) -> Node:
    """The tree under an outermost element."""
    top = here = Node("", None)
    at, last, open_tags, endless = 0, page.rfind(">"), Counter(), set()
    while at < len(page):
        next_at = page.find("<", at)
        if next_at < 0 or next_at > last:
            here.parts.append(page[at:])
            break
        if next_at > at:
            here.parts.append(page[at:next_at])
        at = next_at
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = len(page) if end < 0 else end + 3
            continue
        m = TAG.match(page, at)
        if m is None:
            if page[at + 1 : at + 2] in ("!", "?", "/"):
                at = page.find(">", at) + 1
            else:
                here.parts.append("<")
                at += 1
            continue
        tag, closing = m[1].lower(), page[at + 1] == "/"
        own, at, empty = attributes(page, m.end())
        if closing:
            if open_tags[tag]:
                while here.tag != tag:
                    open_tags[here.tag] -= 1
                    here = here.parent
                open_tags[tag] -= 1
                here = here.parent
            continue
        if tag in RAW:
            end = None if empty or tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if end:
                at = end.end()
            elif not empty:
                endless.add(tag)
                at = len(page) if tag in ("script", "style") else at
            continue
        if tag in CLOSES_P:
            here = _close(here, open_tags, "p", *PARAGRAPH)
        elif tag in SIBLINGS:
            here = _close(here, open_tags, tag, *SIBLINGS[tag])
        node = Node(tag, here)
        _judge(node, own)
        here.parts.append(node)
        if tag not in VOID and not empty:
            here = node
            open_tags[tag] += 1
    return top


PARAGRAPH = frozenset(("p",)), frozenset(("table", "td", "th", "button", "article", "section", "div", "li"))


def _close(here: Node, open_tags: Counter, kind: str, tags: frozenset, until: frozenset) -> Node:
    """The element that is open once the nearest of tags is closed; what lies beyond one of until isn't looked at."""
    if not any(open_tags[t] for t in tags):
        return here
    up = here
    while up.parent is not None and up.tag not in until and not (up.shut and kind in up.shut):
        if up.tag in tags:
            while here is not up:
                open_tags[here.tag] -= 1
                here = here.parent
            open_tags[up.tag] -= 1
            return up.parent
        up = up.parent
    here.shut = {kind} if here.shut is None else here.shut | {kind}
    return here


def settle(top: Node) -> None:
    """Decides which suspects go, by their share of links and of the page's text."""
    nodes = _in_order(top)
    if not any(n.suspect for n in nodes):
        return
    for node in reversed(nodes):
        own = [p for p in node.parts if isinstance(p, str)]
        node.chars += sum(len(p) - p.count(" ") for p in own)
        node.says = node.says or any(len(x.split()) >= SENTENCE_WORDS for p in own for x in SENTENCE_END.split(p)[:-1])
        if node.tag == "a":
            node.link_chars = node.chars
        if node.parent is not None:
            node.parent.says |= node.says
            node.parent.chars += node.chars
            node.parent.link_chars += node.link_chars
            node.parent.holds |= node.holds or node.tag == "h1" and node.within
    whole = top.chars - top.link_chars
    for node in nodes:
        if node.suspect:
            plain = node.chars - node.link_chars
            if node.suspect == "comment":
                node.drop = not node.holds
            elif node.holds:
                node.drop = False
            elif node.within and node.suspect != "wrapper":
                small = plain <= SMALL * whole
                own = not node.link_chars and (node.tag in ITEMS or node.says)  # a part of the article that only has such a name
                node.drop = node.link_chars > LINKED * node.chars or small and (node.suspect == "paid" or node.suspect == "strong" and not own)
            else:
                node.drop = top.holds or 2 * plain <= whole or not any(isinstance(p, Node) for p in node.parts)
    for node in nodes:
        node.chars = node.link_chars = 0


def _in_order(top: Node) -> list[Node]:
    """Elements that count, parents first."""
    out, stack = [], [top]
    while stack:
        node = stack.pop()
        if not node.drop:
            out.append(node)
            stack += [p for p in reversed(node.parts) if isinstance(p, Node)]
    return out


def measure(top: Node) -> list[Node]:
    """Counts and densities of all elements that count, bottom up."""
    nodes = _in_order(top)
    for node in reversed(nodes):
        node.chars += sum(len(p) - p.count(" ") for p in node.parts if isinstance(p, str))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        up = node.parent
        if up is not None and node is not top:
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.tags += node.tags + 1
            up.link_tags += node.link_tags
    share = top.link_chars / top.chars if top.chars else 0.0
    for node in nodes:
        if not node.chars:
            continue
        tags, linked, plain = max(node.tags, 1), max(node.link_chars, 1), max(node.chars - node.link_chars, 1)
        base = math.log(node.chars / plain * node.link_chars + share * node.chars + math.e)
        node.density = node.chars / tags * math.log(max(node.chars / linked * tags / max(node.link_tags, 1), 1.0 + 1e-9)) / max(math.log(base), 1.0) if base > 1 else 0.0
    return nodes


def main_nodes(top: Node) -> list[Node]:
    """Roots of the main text, in page order."""
    settle(top)
    nodes = measure(top)
    body = next((n for n in nodes if n.tag == "body"), top)
    best, most = body, 0.0
    for node in nodes:
        total = sum(p.density for p in node.parts if isinstance(p, Node) and not p.drop)
        if total > most:
            best, most = node, total
    path, up = [], best
    while up is not None:
        path.append(up)
        up = up.parent
    # the outermost article or main element that holds the core is the core; beside it the threshold decides
    best = next((n for n in reversed(path) if n.tag in ("article", "main")), best)
    path = path[path.index(best) :]
    if best is body or body not in path:
        return [body]
    threshold = min(n.density for n in path[: path.index(body) + 1])
    path = {id(n) for n in path}
    found, stack = [], [body]
    while stack:
        node = stack.pop()
        if node is best or node is not body and node.density >= threshold and id(node) not in path:
            found.append(node)
        elif id(node) in path:
            stack += [p for p in reversed(node.parts) if isinstance(p, Node) and not p.drop]
    return found


def blocks(root: Node) -> Iterator[str]:
    """Texts of the blocks below an element, with white space as single spaces."""
    held: list[str] = []
    stack: list[Node | str | None] = [root]
    while stack:
        part = stack.pop()
        if part is None or isinstance(part, Node) and part.tag in BLOCK:
            yield " ".join(entities.unescape("".join(held)).split())
            held = []
        if isinstance(part, str):
            held.append(part)
        elif isinstance(part, Node) and not part.drop:
            if part.tag == "br":
                held.append(" ")
            if part.tag in BLOCK:
                stack.append(None)
            stack += reversed(part.parts)
    yield " ".join(entities.unescape("".join(held)).split())


def main_text(page: str | None) -> str:
    return "\n".join(b for root in main_nodes(parse(page or "")) for b in blocks(root) if b)


def extract(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns, text and n_chars.  Kept names must differ from these two."""

    def rows(it):
        for page, *kept in it:
            text = main_text(page)
            yield (*kept, text, len(text))

    return map_rows(pages.select("html", *keep), rows, T.StructType([pages.schema[c] for c in keep] + [T.StructField("text", STR), T.StructField("n_chars", LONG)]))


def op7_html(pages: DataFrame) -> DataFrame:
    return extract(pages, ["page_id", "url"])
