"""HTML main-text extraction by composite text density (operator 5).

A page is parsed into a tree. Elements that are never the article (scripts, styles, navigation, asides, footers and
the like, by tag or role, and what is hidden) are cut off with all below them, and forms, unless they hold over half of the page's text.
A container whose class or id has a whole name of such a part ("ad-box", "comments"; not "related-work", "with-sidebar" or "no-sidebar") isn't where the
article is sought, unless it holds an article or main, or over nine tenths of the page's text. Every other node has its
characters C and tags T, and those within links, LC and LT, counted over its subtree. Its density is

    C / T * log(C / LC * T / LT) to the base ln(C * LC / (C - LC) + lc * C / c + e)

with all counts at least 1, and c and lc those of the body: characters per tag, lowered where links make up much of the text.
The density sum of a block adds up the densities of the blocks that are its children (its own, if it has none); what is within a line isn't parted from it. The node with the largest sum is the article's core;
the smallest density on the way from its parent up to the body is the threshold. From the core the article grows to the nearest element around it that says it is the
article (article, main), if any does; else from parent to parent, as long as the neighbours that reach the threshold add less than half as much text again.
Neighbours that don't reach it (headings excepted), or are blocks of links, stay out. Below the core, or the element that says so, nothing is judged by density: what goes there are the elements
above, containers by the whole name of a part that the article never includes (adverts, reader comments, sharing, sidebars, notices),
and those by any other such name if they are mostly links.

Defined results: a null or empty html, or one with no text, gives an empty text; rows that repeat give
repeated results; very long pages are read whole; an empty table gives no rows; columns other than those named are not read; text outside any element counts as the body's; unknown or
unclosed tags are closed by their parents.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from strataspan.llm.common import table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+))""")
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never part of an article.
NOISE_TAGS = frozenset("nav footer aside head script style noscript template iframe object embed svg canvas button select option textarea input label dialog menu video audio map annotation annotation-xml".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies dialog disqus "
    "footer gdpr header hidden legal login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain pager pagination paywall popup "
    "promo promoted promotion related reply replies respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription taboola "
    "tags toc toolbar topbar widget widgets disclaimer feedback discussion alert responses".split()
)
#: Of these, what goes within the article as well.
NEVER = frozenset(
    "ad ads adv advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus gdpr menu modal nav navbar navigation newsletter notice notices "
    "outbrain paywall popup promo promoted promotion replies reply respond responses share sharing sidebar sidebars signup social sponsor sponsored subscribe subscription taboola".split()
)
#: What may follow in such a name.
NOISE_ENDS = frozenset("area bar block body box button buttons container content form inner item items left link links list outer panel right section slot thread top bottom unit wrap wrapper".split())
#: Elements that hold parts of a page; headings, paragraphs, items and spans aren't judged by name.
CONTAINERS = frozenset("div section ul ol dl table header article center li".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend "
    "li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: An opening tag closes an open element of these, up to the nearest of the stops.
CLOSES = {t: frozenset(["p"]) for t in BLOCKS - {"td", "th", "tr", "body", "html"}} | {
    "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]),
    "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"]),
}
STOPS = frozenset("ul ol dl table div article section main body html aside blockquote td th header footer nav form figure details".split())
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "noise", "named", "never", "cut", "kids", "parent", "chars", "tags", "link_chars", "link_tags", "density", "total", "block")

    def __init__(self, tag: str, parent: Node | None, noise: bool = False):
        self.tag, self.parent, self.noise, self.kids = tag, parent, noise, []
        self.named = self.never = self.cut = False  # has the name of a part that is no article; of one that goes within it too; is in such a part and not sought through
        self.reset()

    def reset(self) -> None:
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.block = False  # is a block or holds one


def _noise(tag: str, attributes: str, parent: Node) -> bool:
    if tag in NOISE_TAGS:
        return True
    if tag == "header":
        return not _inside(parent, "article", "main", "section")
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    found = _attributes(attributes)
    if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", ATTRIBUTE.sub(lambda m: m[1] + "=", attributes)) or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return True
    return found.get("role", "").lower() in NOISE_ROLES


def _attributes(attributes: str) -> dict[str, str]:
    return {k.lower(): (a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)}


def _named(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether a class or the id of a container is, as a whole, the name of a part that is no article; and of one that goes within the article too."""
    if tag not in CONTAINERS and tag != "main" or "=" not in attributes:
        return False, False
    found, named, never = _attributes(attributes), False, False
    for name in (found.get("class", "") + " " + found.get("id", "")).split():
        words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
        if words and words[0] in NOISE_WORDS and all(w in NOISE_WORDS or w in NOISE_ENDS for w in words) and not (tag == "header" and words == ["header"]):
            named, never = True, never or words[0] in NEVER
    return named, never


def _inside(node: Node | None, *tags: str) -> bool:
    while node is not None:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def parse(page: str) -> Node:
    """The tree below an artificial body; kids are nodes and strings. What is noise keeps nothing below it."""
    root = Node("body", None)
    top, at, skip = root, 0, 0
    n = len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not top.noise:
            top.kids.append(page[at:lt])
        if lt == n:
            break
        m = TOKEN.match(page, lt)
        if not m:  # a lone <
            if not top.noise:
                top.kids.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            node = top
            while node is not None and node.tag != tag and node is not root:
                if tag in ("p", "b", "i", "a", "span", "em", "strong") and node.tag in STOPS:
                    node = root
                    break
                node = node.parent
            if node is not None and node is not root:
                top = node.parent
            continue
        if tag in ("html", "body"):
            continue
        if tag == "svg" and (m[3].endswith("/") or not re.compile(rf"</{tag}\s*>", re.I).search(page, at)):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        closes = CLOSES.get(tag)
        if closes:
            node, hit = top, None
            while node is not root and node.tag not in STOPS - closes:
                if node.tag in closes:
                    hit = node
                node = node.parent
            if hit is not None:
                top = hit.parent
        node = Node(tag, top, top.noise or _noise(tag, m[3], top))
        if not top.noise:
            top.kids.append(node)
            node.named, node.never = (True, True) if tag == "form" else _named(tag, m[3])
            node.cut = top.cut or node.named and (node.never or not _inside(top, "article", "main"))
            if tag in ("article", "main") and not node.named:
                up = node
                while up is not None and up.cut:
                    up.cut, up = False, up.parent
        if tag not in VOID and not m[3].endswith("/"):
            top = node
    return root


def _weigh(root: Node) -> list[Node]:
    """Counts and densities of all nodes that aren't noise, children first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(k for k in node.kids if type(k) is Node and not k.noise)
    order.reverse()
    for node in order:
        for k in node.kids:
            if type(k) is str:
                node.chars += len(SPACE.sub(" ", html.unescape(k)).strip())
            elif not k.noise and (node.cut or not k.cut):
                node.chars += k.chars
                node.tags += k.tags + 1
                node.link_chars += k.chars if k.tag == "a" else k.link_chars
                node.link_tags += k.link_tags + (k.tag == "a")
    ratio = max(1, root.link_chars) / max(1, root.chars)
    for node in order:
        c, t, lc, lt = max(1, node.chars), max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        base = math.log(c * lc / max(1, c - lc) + ratio * c + math.e)
        inner = c / lc * (t / lt)
        node.density = 0.0 if not node.chars or base <= 1 else max(0.0, c / t * math.log(inner) / math.log(base)) if inner > 1 else 0.0
        below = [k for k in node.kids if type(k) is Node and k.block and not k.noise and (node.cut or not k.cut)]
        node.block = node.tag in BLOCKS or bool(below)
        node.total = sum(k.density for k in below) if below else node.density
    return order


def _release(order: list[Node], root: Node) -> list[Node]:
    """The page weighed again without the cuts, where most of its text is in what has such a name or is a form."""
    cuts = [n for n in order if n.cut and not n.parent.cut]
    forms = [n for n in cuts if n.tag == "form" and 2 * n.chars > root.chars + sum(c.chars for c in cuts)]
    if 9 * root.chars < sum(c.chars for c in cuts) - sum(f.chars for f in forms) and not forms:
        forms = cuts
    if not forms:
        return order
    held = set(map(id, forms))
    for n in reversed(order):  # parents first
        if n.cut:
            own = n.named and (n.never or not _inside(n.parent, "article", "main"))
            n.cut = n.parent.cut or own and id(n) not in held
            if id(n) in held:
                n.named = n.never = False
        n.reset()
    return _weigh(root)


def _chosen(root: Node) -> tuple[Node | None, Node | None, float]:
    """The subtree to take, the one within it that is the article whole, and the threshold for what lies between."""
    order = _release(_weigh(root), root)
    if not root.chars:
        return None, None, 0.0
    core = max((n for n in order if n.block and not n.cut), key=lambda n: (n.total, n.chars))
    threshold, node = math.inf, core.parent
    while node is not None:
        threshold, node = min(threshold, node.density), node.parent
    said = core
    while said is not None and (said.tag not in ("article", "main") or said.named):
        said = said.parent
    if said is not None:
        return said, said, threshold
    node = core
    while node.parent is not None:
        more = sum(k.chars for k in node.parent.kids if type(k) is Node and k is not node and not k.noise and not _stays_out(k, threshold))
        if more >= 0.5 * node.chars:
            break
        node = node.parent
    return node, core, threshold


def _inside_node(node: Node | None, above: Node) -> bool:
    while node is not None and node is not above:
        node = node.parent
    return node is above


def _stays_out(node: Node, threshold: float) -> bool:
    """A neighbour of the article. Headings are short: only links count against them."""
    return node.cut or node.tag in BLOCKS and (2 * node.link_chars > node.chars or node.density < threshold and node.tag not in HEADINGS)


def _goes(node: Node) -> bool:
    """A part of the article."""
    return node.never or node.named and 2 * node.link_chars > node.chars


def main_text(page: str | None) -> str:
    """The article's blocks, one a line."""
    if not page:
        return ""
    blocks: list[str] = []
    now: list[str] = []

    def close() -> None:
        text = SPACE.sub(" ", "".join(now)).strip()
        now.clear()
        if text:
            blocks.append(text)

    top, article, threshold = _chosen(parse(page))
    above, node = set(), article
    while node is not None:
        above.add(node)
        node = node.parent
    stack: list = [(top, False)] if top is not None else []
    while stack:
        k, within = stack.pop()
        if type(k) is str:
            now.append(html.unescape(k))
        elif k is None:
            close()
        elif k.tag == "br":
            now.append(" ")
        elif not k.noise and (k in above or not (_goes(k) if within else _stays_out(k, threshold))):
            block = k.tag in BLOCKS
            if block:
                close()
                stack.append((None, within))
            within = within or k is article
            stack.extend((x, within) for x in reversed(k.kids))
    close()
    return "\n".join(blocks)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
