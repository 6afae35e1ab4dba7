"""The main text of web pages by composite text density.

A tolerant parser builds the element tree of the whole page. Every node gets its characters, tags, link
characters and link tags; its density is characters per tag, adjusted by how much of it is links against
the page's own link share. Densities of a node's children are summed, and of the nodes that hold blocks the one
with the greatest sum under the body is the content (of equal sums, an article or main element); the least density on its path to the body is the threshold that
neighbouring parts must reach to belong to it. Where articles as dense as that hold most of it, they are the content,
and an article isn't left for other parts than articles.

Parts that say what they are (navigation, forms, notices, adverts, reader comments and so on) by their element,
or as containers by a whole token of their class, id or role, are left out beforehand. A longer token that only has
such a word in it ("related-work") decides nothing by itself: its part goes if its density is below the threshold.

Defined results: a null or empty html gives an empty text, as does a page without any main text. Character
references are decoded; white space inside a block becomes one space; blocks are joined by one line break
in page order. Rows may repeat; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.text import slices

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MARKED = frozenset("article main".split())
NEVER = frozenset("head script style noscript template svg math iframe object embed canvas audio video select button input textarea title nav aside footer dialog form".split())
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody thead tfoot tr td th", "table")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
SCOPE = frozenset("html body table td th caption button object".split())
#: Elements that a class, id or role can name as a part outside the main text. Headings, paragraphs and items can't be.
CONTAINERS = frozenset("article aside center details dialog div dl fieldset figure footer form header menu nav ol section span table ul".split())
#: Words in a class, id or role that name a part outside the main text.
LABELS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside rail "
    "footer header masthead topbar comment comments commentlist respond disqus replies notice notices cookie cookies consent gdpr alert popup modal overlay dialog newsletter "
    "subscribe subscription signup login share sharing social related recommended widget pagination pager toolbar complementary contentinfo search form skip".split()
)
HEADER_LABELS = frozenset("header masthead".split())
#: Words that say nothing about a part beside a label ("related-posts", "site-header").
NEUTRAL = frozenset("site page main global top bottom left right primary secondary box block bar area list wrap wrapper container section reader user post posts article articles link links button buttons slot unit text inner outer".split())
#: The same as the last word, or the end, of a longer one ("sitefooter", "topnav").
LABEL_ENDS = ("nav", "navbar", "menu", "footer", "sidebar", "comments", "banner", "cookie", "cookies", "advert", "breadcrumbs")

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements nested deeper than this become siblings, as in browsers.
DEEPEST = 512
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: A list whose links are at least so long on the average is one of sources or titles, no menu.
TITLE = 20
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("attributes", "chars", "density", "doubtful", "link_chars", "link_tags", "parent", "parts", "tag", "tags", "total")

    def __init__(self, tag: str, parent: Node | None, attributes: str = "") -> None:
        self.tag, self.parent, self.attributes = tag, parent, attributes
        self.parts: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.doubtful = False


def parse(page: str) -> Node:
    """The element tree; open elements are closed where HTML implies it, stray end tags are ignored."""
    root = Node("#root", None)
    stack, at, n = [root], 0, len(page)

    def text(value: str) -> None:
        if value:
            stack[-1].parts.append(html.unescape(value) if "&" in value else value)

    def close(names: frozenset[str], until: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                del stack[k:]
                return
            if stack[k].tag in until:
                return

    only_p = frozenset(["p"])
    while at < n:
        found = TOKEN.search(page, at)
        if not found:
            text(page[at:])
            break
        text(page[at : found.start()])
        at = found.end()
        tag = found[2] or found[5]
        if not tag:
            continue
        tag, ends, attributes = tag.lower(), bool(found[1] or found[4]), found[3] or found[6] or ""
        if ends:
            inline = tag not in BLOCK
            close(frozenset([tag]), BLOCK if inline else SCOPE - {tag} if tag in ("p", "li") else frozenset())
            continue
        if tag in BLOCK:
            close(only_p, SCOPE)
        if tag in CLOSES:
            close(*CLOSES[tag])
        node = Node(tag, stack[-1], attributes)
        stack[-1].parts.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            stop = end.start() if end else n
            node.parts.append(page[at:stop])
            at = page.find(">", stop) + 1 if end else n
            at = n if at == 0 else at
            continue
        if len(stack) < DEEPEST:
            stack.append(node)
    return root


def _order(top: Node) -> list[Node]:
    """Every node, parents first."""
    out, stack = [], [top]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [x for x in node.parts if isinstance(x, Node)]
    return out


def _attributes(node: Node) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(node.attributes):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def _labels(tag: str, attributes: dict[str, str]) -> tuple[set[str], bool]:
    """What names a container as outside the main text; and whether a longer token only has such a word in it."""
    found, doubt = set(), False
    for name in ("class", "id", "role") if tag in CONTAINERS else ():
        for token in attributes.get(name, "").split():
            words = [w.lower() for w in WORDS.findall(token)]
            labels = {w for w in words if w in LABELS}
            ended = name != "id" and words and words[-1].endswith(LABEL_ENDS)
            if labels and all(w in labels or w in NEUTRAL for w in words):
                found |= labels
            elif ended or (len(words) == 1 and words[0].endswith(LABEL_ENDS)):
                found.add(words[-1])
            else:
                doubt = doubt or bool(labels)
    return found, doubt


def _unseen(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(UNSEEN.search(attributes.get("style", "")))


def _length(text: str) -> int:
    return len("".join(text.split()))


def _count(top: Node) -> list[Node]:
    nodes = _order(top)
    for node in reversed(nodes):
        node.chars = sum(_length(x) for x in node.parts if isinstance(x, str)) + sum(x.chars for x in node.parts if isinstance(x, Node))
        inner = [x for x in node.parts if isinstance(x, Node)]
        node.tags = sum(x.tags + 1 for x in inner)
        node.link_tags = sum(x.link_tags + (x.tag == "a") for x in inner)
        node.link_chars = node.chars if node.tag == "a" else sum(x.link_chars for x in inner)
    return nodes


def _prune(top: Node) -> None:
    """Takes out parts that are not main text by element or by name. A name alone never takes most of the page."""
    nodes = _count(top)
    whole = max(1, top.chars)
    wraps, inside = set(), set()
    for node in nodes:  # parents first
        if node.tag in MARKED or (node.parent is not None and id(node.parent) in inside):
            inside.add(id(node))
        if node.tag in MARKED:
            up = node.parent
            while up is not None and id(up) not in wraps:
                wraps.add(id(up))
                up = up.parent
    for node in nodes:
        kept: list[Node | str] = []
        for part in node.parts:
            if isinstance(part, str):
                kept.append(part)
                continue
            most = part.tag in ("body", "html", "main") or id(part) in wraps or part.chars * 2 > whole
            attributes = _attributes(part) if part.attributes else {}
            named, doubt = _labels(part.tag, attributes) if attributes and not most else (set(), False)
            part.doubtful = doubt and not named
            if (part.tag in NEVER and not (part.tag == "form" and most)) or (attributes and _unseen(attributes)):
                kept.append(" ")
            elif part.tag == "header" or named and named <= HEADER_LABELS:
                kept += [x for x in _order(part) if x.tag in HEADINGS] if not most else [part]
            elif named:
                kept.append(" ")
            elif part.tag in ("ul", "ol", "menu", "dl") and part.link_tags > 1 and part.link_chars * 5 >= part.chars * 4 and (part.tag != "ol" and part.link_chars < TITLE * part.link_tags or not id(node) in inside):
                kept.append(" ")
            else:
                kept.append(part)
        for part in kept:
            if isinstance(part, Node):
                part.parent = node
        node.parts = kept


def _densities(body: Node) -> list[Node]:
    """Composite density: (C/T) * log to the base ln(C*LC/(C-LC) + C*LCb/Cb + e) of (C/LC * T/LT)."""
    nodes = _count(body)
    share = body.link_chars / max(1, body.chars)
    for node in nodes:
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, max(1, node.link_tags)
        if c:
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            ratio = c / max(1, lc) * t / lt
            node.density = c / t * math.log(max(ratio, 1.0)) / math.log(max(base, 1.0 + 1e-9)) if base > 1 else c / t * math.log(max(ratio, 1.0))
    for node in nodes:
        node.total = sum(x.density for x in node.parts if isinstance(x, Node))
    return nodes


def _plain_density(node: Node) -> float:
    """Characters outside links per tag."""
    return (node.chars - node.link_chars) / max(1, node.tags)


def _outermost_marked(top: Node) -> list[Node]:
    out, stack = [], [top]
    while stack:
        node = stack.pop()
        if node.tag in MARKED:
            out.append(node)
        else:
            stack += [x for x in reversed(node.parts) if isinstance(x, Node)]
    return out


def _content(body: Node) -> list[Node]:
    nodes = _densities(body)
    holders = [x for x in nodes if x is body or any(isinstance(y, Node) and y.tag in BLOCK for y in x.parts)]
    best = max(holders, key=lambda x: (x.total, x.tag in MARKED))
    if best.total == 0:
        return [body]
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold, plain = min(x.density for x in path), min(map(_plain_density, path))
    while best is not body and best.tag not in MARKED and (best.chars == best.parent.chars or best.chars * 2 < best.parent.chars and best.parent.link_chars * 4 < best.parent.chars):
        best = best.parent  # a wrapper of the same text, or a section of a longer one
    for node in nodes:
        if node.doubtful and node.density < threshold:
            node.parts = []
    if best.tag not in MARKED:
        marked = [x for x in _outermost_marked(best) if not x.doubtful and 2 * _plain_density(x) >= plain]
        if 2 * sum(x.chars for x in marked) >= best.chars:
            return marked  # density chose what lies around them, but most of it is theirs
    tops, inner = [best], best
    while inner is not body:
        around = [x for x in inner.parent.parts if isinstance(x, Node)]
        at = next(k for k, x in enumerate(around) if x is inner)
        if inner.tag in MARKED:  # the log in the density grows with a part's size, so articles of different sizes are compared without it
            keep = [x.tag in MARKED and not x.doubtful and 2 * _plain_density(x) >= plain for x in around]
        else:
            keep = [not x.doubtful and (x.density >= threshold or (inner is best and x.tag in HEADINGS)) for x in around]
        tops = [*(x for x, k in zip(around[:at], keep[:at], strict=True) if k), *tops, *(x for x, k in zip(around[at + 1 :], keep[at + 1 :], strict=True) if k)]
        inner = inner.parent
    return tops


def _blocks(tops: list[Node]) -> Iterator[str]:
    held: list[str] = []
    for_break = None
    stack: list[Node | str | None] = [x for top in reversed(tops) for x in (for_break, top)]
    while stack:
        x = stack.pop()
        if x is for_break:
            if held:
                yield " ".join("".join(held).split())
            held = []
        elif isinstance(x, str):
            held.append(x)
        elif x.tag == "br":
            held.append(" ")
        elif x.tag in BLOCK:
            stack += [for_break, *reversed(x.parts), for_break]
        else:
            stack += reversed(x.parts)
    if held:
        yield " ".join("".join(held).split())


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    _prune(root)
    body = next((x for x in _order(root) if x.tag == "body"), root)
    return "\n".join(x for x in _blocks(_content(body)) if x)


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=_OUT)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars; one pass over the pages, no shuffle."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
