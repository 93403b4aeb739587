"""Operator 5: main text of web pages by tree scoring.

A page is read into a tree of elements. Each paragraph gives points, one and more for its length and its
commas, to its parent in full, to its grandparent by half and to older ancestors by a third of that at each
level. Containers that the page marks as the article or the main part start with points. Points are
discounted by the share of text within links. From the best container the way goes up to the article or main
part around it, or else past parents whose other children hold text with few links; what is found is kept whole,
however its text is dealt over sections, without lists of links. With it stay those siblings that score well
beside it or read like paragraphs; menus, notices, forms and the like inside are left out. A name that speaks
of such parts does not count where the element holds the article, or all paragraphs that the page has. Reader
comments go by structure, however long they are: by name, by the heading above them, as articles within an
article, or as a row of like parts that each have an author and a date.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|svg|iframe|select)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a start tag ends, up to the nearest element that holds them.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_SKIP = set("nav footer aside form button input dialog menu head object canvas audio video fieldset label".split())
_HEADS = set("h1 h2 h3 h4 h5 h6 header hgroup p".split())
_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
_UNLIKELY = set(
    "ad ads adv advert adverts advertisement adbox banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus "
    "footer header hidden login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo "
    "promotion recommend recommended related reply replies respond search share sharing sidebar sidenav signup skip social sponsor sponsored "
    "subscribe subscription tags teaser toolbar topbar widget widgets".split()
)
_COMMENTS = set("comment comments commentlist commentary discussion discussions disqus replies reply respond responses".split())
_COMMENTS_HEAD = re.compile(
    r"\s*(?:\d[\d,. ]*\s+|(?:all|view|reader|user|recent|top|latest)\s+)*(?:comments?|responses?|replies|discussion|reader comments|thoughts on\b.*|"
    r"(?:leave|post|add|write)\s+an?\s+(?:comment|reply|response).*|join the (?:discussion|conversation))\s*(?:\(\d+\)|:)?\s*", re.I | re.S
)
_AUTHOR, _DATE = set("author avatar byline commenter nickname user username".split()), set("ago date datetime posted published time timestamp when".split())
_LIKELY = set("article body content entry main page post story text".split())
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Names of what an element has beside it or lacks, as in has-sidebar, not of what it is.
_STATE = re.compile(r"(?<![a-z0-9_-])(?:has|no|with|without)[-_]\S*")


class _Node:
    __slots__ = ("tag", "up", "parts", "boiler", "named", "likely", "base", "points", "chars", "linked", "words")

    def __init__(self, tag: str, up: _Node | None):
        self.tag, self.up, self.parts = tag, up, []
        self.boiler, self.named, self.likely, self.base, self.points, self.chars, self.linked = False, False, False, 0.0, 0.0, 0, 0
        self.words: set[str] = set()


def _names(attributes: dict[str, str]) -> list[str]:
    both = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    return _NAME.findall(_STATE.sub(" ", _CAMEL.sub(" ", both).lower()))


def _mark(node: _Node, raw: str) -> None:
    """Whether the element is boilerplate by its tag, role or names, and the points that it starts with."""
    inside, code = node.up, False
    while inside is not None and inside.tag not in ("article", "main"):
        code = code or inside.tag in ("pre", "code")  # where names colour words
        inside = inside.up
    node.boiler = node.tag in _SKIP or (node.tag == "header" and inside is None)
    node.base = {"article": 30.0, "main": 20.0}.get(node.tag, 0.0)
    if raw.strip() and node.tag not in ("html", "body") and not code:
        attributes = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}
        names = node.words = set(_names(attributes))
        role = attributes.get("role", "").lower()
        if role in ("main", "article"):
            node.base += 20.0
        elif names & _UNLIKELY and not (node.tag in ("article", "main") or (node.tag == "header" and inside is not None)):
            node.named, node.likely = True, bool(names & _LIKELY)
        elif names & _LIKELY:
            node.base += 10.0
        if role in _ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
            node.boiler = True
        if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I):
            node.boiler = True


def parse(page: str) -> _Node:
    """Tree of the page's elements; parts hold texts and child elements in their order."""
    root = at = _Node("#page", None)
    for m in _TOKEN.finditer(page):
        tag = m[3]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                at.parts.append(m[0])
            continue
        if not m[5]:  # the page ends within a tag
            continue
        tag = tag.lower()
        if m[2]:
            node = at
            while node is not None and node.tag != tag:
                node = node.up
            if node is not None and node.up is not None:
                at = node.up
            continue
        if tag in _BLOCK:
            node = at
            while node.up is not None and node.tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                if node.tag in _BLOCK:
                    break
                node = node.up
            if node.tag == "p" or (node.tag[0] == "h" and node.tag[1:].isdigit() and tag[0] == "h" and tag[1:].isdigit()):
                at = node.up
        if tag in _ENDS:
            ends, stop = _ENDS[tag]
            node = at
            while node.up is not None and node.tag not in ends and node.tag not in stop:
                node = node.up
            if node.tag in ends:
                at = node.up
        node = _Node(tag, at)
        at.parts.append(node)
        if tag not in _VOID and not m[4].endswith("/"):
            _mark(node, m[4])
            at = node
        elif tag not in _VOID:
            _mark(node, m[4])
    return root


def _walk(root: _Node) -> list[_Node]:
    """All elements outside of boilerplate, each before those that it holds."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [x for x in reversed(node.parts) if not isinstance(x, str) and not x.boiler]
    return out


def _text(node: _Node) -> str:
    pieces: list[str] = []
    stack: list = [node]
    while stack:
        at = stack.pop()
        if isinstance(at, str):
            pieces.append(at)
        else:
            stack += reversed(at.parts)
    return "".join(pieces)


def _drop_comments(root: _Node) -> None:
    """Reader comments become boilerplate."""
    nodes = _walk(root)
    leads: dict[int, int] = {}
    for node in reversed(nodes):
        own = node.tag in ("article", "main") and not node.words & _COMMENTS
        leads[id(node)] = own + sum(leads.get(id(x), 0) for x in node.parts if not isinstance(x, str))
    within: dict[int, tuple[bool, bool]] = {id(root): (False, False)}  # in code, in an article
    for node in nodes:
        code, article = within[id(node)]
        for part in node.parts:
            if isinstance(part, str):
                continue
            within[id(part)] = code or part.tag in ("pre", "code"), article or part.tag == "article"
            named = part.words & _COMMENTS and part.tag not in ("html", "body") and not code
            # A part that holds the page's article is around it, not a comment.
            if named and (not leads.get(id(part), 0) or article):
                part.boiler = True
    for node in _walk(root):
        inner = [x for x in node.parts if not isinstance(x, str) and not x.boiler]
        for i, part in enumerate(inner):
            if part.tag in ("h2", "h3", "h4", "h5", "h6") and _COMMENTS_HEAD.fullmatch(_text(part)):
                first = not any(_text(x).strip() for x in inner[:i])
                if first and node.tag in ("div", "section", "li", "td") and not any(x.tag in ("article", "main") and not x.words & _COMMENTS for x in inner) and not any(x.tag == "h1" for x in _walk(node)):
                    node.boiler = True
                else:
                    for x in inner[i:]:
                        x.boiler = True
                break
    for node in _walk(root):
        if node.tag == "article":
            nested = [x for x in _walk(node)[1:] if x.tag == "article"]
            held = {id(y) for x in nested for y in _walk(x)}
            if any(x.tag == "p" and id(x) not in held and _text(x).strip() for x in _walk(node)):
                for x in nested:
                    x.boiler = True
    for node in _walk(root):
        alike: dict[tuple, list[_Node]] = {}
        for x in node.parts:
            if not isinstance(x, str) and not x.boiler and x.tag in ("div", "li", "section", "article", "blockquote", "tr"):
                alike.setdefault((x.tag, tuple(sorted(x.words))), []).append(x)
        for parts in alike.values():
            own = [_walk(x) for x in parts]
            if len(parts) >= 2 and all(any(y.words & _AUTHOR for y in w) and any(y.tag == "time" or y.words & _DATE for y in w) and not any(y.tag in ("h1", "h2", "main") for y in w) for w in own):
                for x in parts:
                    x.boiler = True


def _settle(root: _Node) -> None:
    """Elements named like boilerplate become it, but for one that holds the article or all paragraphs of the page.

    Within an article or main part such an element stays only if it is named like text, too, and holds all
    paragraphs but those that lie directly in the article.
    """
    order: list[tuple[_Node, bool, int, _Node | None]] = []
    stack: list[tuple[_Node, bool, int, _Node | None]] = [(root, False, 0, None)]
    while stack:
        node, within, leads, lead = stack.pop()
        within, leads = within or node.tag == "p", leads + (node.tag in ("article", "main"))
        order.append((node, within, leads, lead))
        lead = node if node.tag in ("article", "main") else lead
        stack += [(part, within, leads, lead) for part in node.parts if not isinstance(part, str) and not part.boiler]
    held: dict[int, tuple[int, int]] = {}
    for node, within, _, _ in reversed(order):
        chars = sum(len("".join(x.split())) for x in node.parts if isinstance(x, str)) if within else 0
        inner = [held[id(x)] for x in node.parts if not isinstance(x, str) and not x.boiler]
        held[id(node)] = chars + sum(c for c, _ in inner), (node.tag in ("article", "main")) + sum(n for _, n in inner)
    text, leads = held[id(root)]
    for node, _, above, lead in order:
        if node.named:
            chars, inside = held[id(node)]
            if above and lead is not None:
                direct = sum(held[id(x)][0] for x in lead.parts if not isinstance(x, str) and x.tag in _HEADS and id(x) in held)
                node.boiler = not (node.likely and chars and chars + direct == held[id(lead)][0])
            else:
                node.boiler = not (inside and inside + above >= leads) and not (text and chars == text and not leads)


def _whole(best: _Node) -> _Node:
    """The article or main part around the best container, or the last parent whose other children hold few links."""
    up: _Node | None = best
    for tag in ("article", "main"):
        up = best
        while up is not None and up.tag != tag:
            up = up.up
        if up is not None:
            return up
    at = best
    while at.up is not None and at.up.tag not in ("body", "html", "#page"):
        rest = [x for x in at.up.parts if not isinstance(x, str) and x is not at and not x.boiler and x.chars]
        if any(4 * x.linked >= x.chars and x.tag not in _HEADS for x in rest):
            break
        at = at.up
    return at


def _blocks(root: _Node) -> list[tuple[_Node, str, int]]:
    """(block element, text, characters in links) for each block of text outside boilerplate, in page order."""
    out: list[tuple[_Node, str, int]] = []
    pieces: list[str] = []
    holder = [root]
    linked = [0]

    def flush(node: _Node) -> None:
        text = " ".join("".join(pieces).split())
        if text:
            out.append((holder[0], text, linked[0]))
        pieces.clear()
        linked[0] = 0
        holder[0] = node

    stack: list[tuple[_Node, int, bool]] = [(root, 0, False)]
    while stack:
        node, at, link = stack.pop()
        block = node.tag in _BLOCK or node.tag == "#page"
        if at == 0 and block:
            flush(node)
        while at < len(node.parts):
            part = node.parts[at]
            at += 1
            if isinstance(part, str):
                text = unescape(part) if "&" in part else part
                pieces.append(text)
                if link:
                    linked[0] += len("".join(text.split()))
            elif part.tag in ("br", "hr", "wbr", "img"):
                if part.tag == "hr":
                    flush(node if block else holder[0])
                elif part.tag == "br":
                    pieces.append(" ")
            elif not part.boiler:
                stack.append((node, at, link))
                stack.append((part, 0, link or part.tag == "a"))
                break
        else:
            if block:
                up = node.up
                while up is not None and up.tag not in _BLOCK and up.tag != "#page":
                    up = up.up
                flush(up or node)
    flush(root)
    return out


def main_text(page: str | None) -> str:
    """Text of the best container and its good siblings: blocks joined by two line feeds, empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    _drop_comments(root)
    _settle(root)
    blocks = _blocks(root)
    if not blocks:
        return ""
    scored: dict[int, _Node] = {}
    for node, text, linked in blocks:
        chars = len("".join(text.split()))
        up: _Node | None = node
        while up is not None:
            up.chars += chars
            up.linked += linked
            up = up.up
        points = (0.25 if len(text) < 25 else 1.0) + text.count(",") + min(len(text) / 100.0, 3.0)
        if node.tag in ("li", "td", "th", "caption") or node.tag[0] == "h" and node.tag[1:].isdigit():
            points *= 0.25
        points *= 1.0 - linked / max(chars, 1)
        share = 1.0
        up = node.up if node.tag in ("p", "pre", "blockquote", "li", "td", "th", "dd", "dt") or node.tag[1:].isdigit() else node
        while up is not None:
            up.points += points * share
            scored[id(up)] = up
            share = share / 2 if share == 1.0 else share / 3
            up = up.up

    def score(node: _Node) -> float:
        return (node.points + node.base) * (1.0 - node.linked / max(node.chars, 1))

    best = None
    for node in scored.values():
        if node.chars and node.linked < node.chars and (best is None or score(node) > score(best)):
            best = node
    if best is None:
        return ""
    top, bar = score(best), max(10.0, 0.2 * score(best))
    keep = {id(best)}
    for part in best.up.parts if best.up is not None else []:
        if isinstance(part, str) or part is best or part.boiler or not part.chars:
            continue
        density = part.linked / part.chars
        if id(part) in scored and part.tag == best.tag and score(part) >= bar and top:
            keep.add(id(part))
        elif part.tag == "p" and density < 0.25 and (part.chars > 80 or any(text[-1:] in ".!?" for node, text, _ in blocks if node is part)):
            keep.add(id(part))
    whole, path = _whole(best), set()
    up = best
    while up is not whole:
        path.add(id(up))
        up = up.up
    texts = []
    for node, text, _ in blocks:
        up, side = node, node
        while up is not None and id(up) not in keep and up is not whole:
            side, up = up, up.up
            if id(up) in path:
                break
        if up is None:
            continue
        # Beside the best container, lists of links and articles within the article are left out.
        if id(up) in keep or up is side or side.tag in _HEADS or (2 * side.linked < side.chars and side.tag != "article"):
            texts.append(text)
    return "\n\n".join(texts)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``.

    A null or empty page has an empty text. Repeated rows give repeated rows, no rows give none; keys and
    addresses pass through, null or not. Every page is read whole, where it lies: nothing is shuffled.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(made, pa.string()), pa.array(map(len, made), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
