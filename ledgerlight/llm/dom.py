"""A small DOM for main-text extraction: tag soup to a tree of block nodes,
and numeric features of every node."""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np

_NAME_AT = re.compile(r"<(/?)([a-zA-Z][^\s/><]*)")
_SPECIAL = re.compile(r"[>\"']")
_ATTR = re.compile(r"\b(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ANY_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?|\"[^\"]*\"|'[^']*'")
_MAY_HIDE = re.compile(r"hidden|style", re.I)
_NO_DISPLAY = re.compile(r"(?:^|[;\s])display\s*:\s*none", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# elements whose content is never text
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "title", "head", "select", "button"}
RAW_TEXT = {"script", "style", "textarea", "title", "iframe", "noscript", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong",
          "sub", "sup", "time", "tt", "u", "var"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "caption", "figcaption", "summary"}
LEAVES = {"p", "li", "dd", "dt", "blockquote", "pre", "td", "th", *HEADINGS}
CHROME = {"nav", "footer", "aside", "form", "header", "menu", "dialog", "fieldset"}
BODY = {"article", "main"}
LISTS, TABLES = {"li", "ul", "ol", "dl", "dt", "dd"}, {"table", "tr", "td", "th", "tbody", "thead", "tfoot"}
# what an opening tag closes, if it is open above it
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
# in an element without text: what its opening tags close where HTML lets an end tag be left out
HEAD = {"head", "html", "base", "basefont", "bgsound", "link", "meta", "noframes", *RAW_TEXT - {"textarea", "iframe"}}
ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "dd", "dt", "fieldset",
          "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li",
          "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul"}
ENDS_LIKE = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
             "rt": {"rt", "rp"}, "rp": {"rt", "rp"}, "button": {"button"}, "a": {"a"}}
SECTIONS = {"tbody", "thead", "tfoot"}
# the elements that stop a cell, row or section of a table from closing more
TABLE_PARTS = {"td": {"tr", "table", *SECTIONS}, "th": {"tr", "table", *SECTIONS}, "tr": {"table", *SECTIONS},
               **dict.fromkeys(SECTIONS, {"table"})}
SCOPES = {"table", "td", "th", "caption", "object"}
# words in class, id, role and label that speak for or against main text
SIDE_WORDS = {"ad", "ads", "advert", "advertisement", "banner", "sponsor", "sponsored", "promo", "nav", "navbar", "navigation",
              "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside", "widget", "related",
              "recommended", "share", "social", "comment", "comments", "reply", "replies", "disqus", "cookie", "cookies",
              "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription",
              "signup", "login", "search", "form", "copyright", "legal", "pagination", "pager", "tags", "toolbar", "skip",
              "contentinfo", "complementary", "dialog"}
MAIN_WORDS = {"article", "main", "content", "post", "entry", "story", "text", "body", "prose", "page"}


class Node:
    __slots__ = ("tag", "parent", "children", "parts", "side", "main", "chars", "link", "tags", "words", "stops", "at", "order", "text", "kin_chars")

    def __init__(self, tag: str, parent: "Node | None", side: int = 0, main: int = 0):
        self.tag, self.parent, self.side, self.main = tag, parent, side, main
        self.children: list[Node] = []
        self.parts: list[str] = []          # own text, inline elements included
        self.text = ""                      # the same, white space settled
        self.chars = self.link = self.tags = self.words = self.stops = self.at = self.order = self.kin_chars = 0


def attribute_words(attrs: str) -> tuple[int, int]:
    """How many words of class, id, role and label speak against and for main text."""
    side = main = 0
    for m in _ATTR.finditer(attrs):
        for w in _NAME.findall(m[2] or m[3] or m[4] or ""):
            w = w.lower()
            side += w in SIDE_WORDS
            main += w in MAIN_WORDS
    return side, main


def hides(attrs: str) -> bool:
    """The attributes say that the element is not shown."""
    if not _MAY_HIDE.search(attrs):
        return False
    for m in _ANY_ATTR.finditer(attrs):
        name, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" \
                or name == "style" and _NO_DISPLAY.search(html.unescape(value)):
            return True
    return False


def left_open(skip: "Open", tag: str, outer: "Open") -> int:
    """How many of the open elements in one without text (itself first) stay
    open when ``tag`` opens; ``outer`` are the blocks around it."""
    inside = skip.tags
    if inside[0] == "head":
        return len(inside) if len(inside) > 1 or tag in HEAD else 0
    keep = len(inside)
    if tag in ENDS_P and "p" in skip:
        for i in range(len(inside) - 1, -1, -1):
            if inside[i] == "p":
                keep = i
            if inside[i] in SCOPES or inside[i] in ("p", "button"):
                break
    for i in range(len(inside) - 1, -1, -1) if any(t in skip for t in ENDS_LIKE.get(tag, ())) else ():
        if inside[i] in ENDS_LIKE[tag]:
            keep = min(keep, i)
            break
        if inside[i] not in INLINE and inside[i] not in ("address", "div", "p"):
            break
    if tag in TABLE_PARTS:
        stop = max((i + 1 for i, x in enumerate(inside) if x in TABLE_PARTS[tag] and x != tag), default=0)
        own = [i for i in range(stop, len(inside)) if inside[i] in TABLES or inside[i] == "caption"]
        keep = min([keep, *own]) if stop or own or not any(t in outer for t in TABLES) else 0
    return keep


class Tokens:
    """The tags, comments and declarations of a page, in time linear in its
    length whatever it holds. A ``<`` that nothing closes is text."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.last_quote = {q: page.rfind(q) for q in "\"'"}
        self.specials: list[int] | None = None     # places of > and quotes, made at the first tag that does not close
        self.dead: set[int] = set()                # specials from which, outside quotes, no end is reached
        self.unclosed: set[str] = set()

    def _end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag, from ``at`` inside it, or -1."""
        page, met = self.page, []
        while at <= self.last:
            if self.specials is None:
                m = _SPECIAL.search(page, at)
                s = m.start() if m else -1
            else:
                k = bisect_left(self.specials, at)
                s = self.specials[k] if k < len(self.specials) else -1
            if s < 0 or s in self.dead:
                break
            met.append(s)
            if page[s] == ">":
                return s
            if s >= self.last_quote[page[s]]:
                break
            at = page.find(page[s], s + 1) + 1
        self.dead.update(met)
        if self.specials is None:
            self.specials = [m.start() for m in _SPECIAL.finditer(page)]
        return -1

    def next(self, pos: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, is an end tag, name, attributes) of the next token from
        ``pos`` on; comments and declarations have no name."""
        page = self.page
        while True:
            at = page.find("<", pos)
            if at < 0:
                return None
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, end + 3 if end >= 0 else len(page), False, "", ""
            if at > self.last:
                # no tag closes from here on; what is left can only be a comment
                pos = page.find("<!--", at)
                if pos < 0:
                    return None
                continue
            m = _NAME_AT.match(page, at)
            if m:
                end = self._end(m.end())
                if end >= 0:
                    return at, end + 1, bool(m[1]), m[2], page[m.end():end]
            if page[at + 1:at + 2] in ("!", "?", "/"):
                return at, page.index(">", at) + 1, False, "", ""
            pos = at + 1

    def after(self, tag: str, pos: int) -> int:
        """Where the end tag of a text-only element ends, or -1."""
        if tag in self.unclosed:
            return -1
        m = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(self.page, pos, self.last + 1)
        if not m:
            self.unclosed.add(tag)
            return -1
        return m.end()


class Open:
    """Open elements, innermost last, with the number of each tag."""

    def __init__(self, *tags: str):
        self.tags, self.count = list(tags), Counter(tags)

    def __contains__(self, tag: str) -> bool:
        return self.count[tag] > 0

    def __len__(self) -> int:
        return len(self.tags)

    def add(self, tag: str) -> None:
        self.tags.append(tag)
        self.count[tag] += 1

    def cut(self, keep: int) -> None:
        """Close all but the ``keep`` outermost."""
        for tag in self.tags[keep:]:
            self.count[tag] -= 1
        del self.tags[keep:]

    def close(self, tag: str) -> None:
        """Close the innermost ``tag`` and what is open in it."""
        k = len(self.tags) - 1
        while self.tags[k] != tag:
            k -= 1
        self.cut(k)


def parse(page: str) -> Node:
    """The tree of block elements. Bare text in a container becomes a ``#text``
    node; inline elements only add to their block's text and counts."""
    root = top = Node("body", None)
    stack, blocks = [root], Open()  # open block nodes, and the tags of all but the root
    inline = Open()                 # open inline elements of the innermost block
    skip = Open()                   # an element without text that is open, and what is open in it
    pos, order, tokens = 0, 0, Tokens(page)

    def text(s: str) -> None:
        nonlocal order
        if skip.tags or not s:
            return
        node = stack[-1]
        if node.tag not in LEAVES:
            if not s.strip() and not (node.children and node.children[-1].tag == "#text"):
                return
            if node.children and node.children[-1].tag == "#text" and node.children[-1].order == order:
                node = node.children[-1]
            else:
                order += 1
                child = Node("#text", node)
                child.order = order
                node.children.append(child)
                node = child
        node.parts.append(s)
        if "a" in inline:
            node.link += len(s.strip())

    while pos < len(page):
        token = tokens.next(pos)
        end = token[0] if token else len(page)
        if end > pos:
            if skip.tags == ["head"] and page[pos:end].strip():
                skip = Open()       # text ends a head
            text(html.unescape(page[pos:end]))
        if not token:
            break
        _, pos, ends_element, tag, attrs = token
        tag = tag.lower()
        if not tag:
            continue
        if skip.tags and ends_element:
            if tag in skip:
                skip.close(tag)
                continue
            if skip.tags[0] == "head":
                over = tag in ("body", "html", "br")
            elif tag in INLINE:
                over = skip.tags[0] in INLINE and tag in inline
            else:               # the end of a block around it
                over = tag in blocks and (tag in TABLES or not any(t in skip for t in SCOPES))
            if not over:
                continue
            skip = Open()
        elif skip.tags:
            skip.cut(left_open(skip, tag, blocks))
            if skip.tags:
                if attrs.endswith("/") or tag in VOID:
                    continue
                if tag in RAW_TEXT:
                    stop = tokens.after(tag, pos)
                    if stop >= 0 or "svg" not in skip:
                        pos = stop if stop >= 0 else len(page)
                else:
                    skip.add(tag)
                continue
        if ends_element:
            if tag in INLINE:
                if tag in inline:
                    inline.close(tag)
            elif tag in blocks:
                while True:
                    blocks.cut(len(blocks) - 1)
                    if stack.pop().tag == tag:
                        break
                inline = Open()
                order += 1
            continue
        if tag in ("html", "body", "!doctype"):
            continue
        closed = attrs.endswith("/") or tag in VOID
        if tag in RAW or hides(attrs):
            if tag in RAW_TEXT:
                stop = tokens.after(tag, pos)
                pos = stop if stop >= 0 else len(page)
            elif not closed:
                skip = Open(tag)
            continue
        stack[-1].tags += 1
        if tag in INLINE:
            if not closed:
                inline.add(tag)
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                text(" ")
            continue
        # a block ends an open paragraph; list items, cells and rows end their like
        ends = CLOSES.get(tag, set()) | ({"p", *HEADINGS} if tag not in ("td", "th", "tr") else set())
        while len(stack) > 1 and stack[-1].tag in ends:
            stack.pop()
            blocks.cut(len(blocks) - 1)
        inline = Open()
        order += 1
        node = Node(tag, stack[-1], *attribute_words(attrs))
        stack[-1].children.append(node)
        if not closed:
            stack.append(node)
            blocks.add(tag)
    return top


def nodes_in_order(root: Node) -> list[Node]:
    """All nodes, every parent before its children, in page order."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo.extend(reversed(n.children))
    return out


FEATURES = 26
# columns that tell where a node stands in article or chrome; training hides some of them
IS_BODY, IN_BODY, IS_CHROME, IN_CHROME = 0, 1, 2, 3
SIDE_SELF, SIDE_ABOVE, MAIN_SELF, MAIN_ABOVE = 4, 5, 6, 7
IS_P, IS_TEXT, LEVEL = 9, 13, 14


def node_features(nodes: list[Node]) -> np.ndarray:
    """One row per node: place in article or chrome, attribute words, tag kind,
    depth, subtree size and density, and how it compares with its siblings."""
    position = 0
    for n in nodes:
        s = n.text = " ".join("".join(n.parts).split())
        n.at = position
        n.chars, n.words = len(s), s.count(" ") + bool(s)
        n.stops = sum(map(s.count, ".,;:!?"))
        n.link = min(n.link, n.chars)
        position += n.chars
    for n in reversed(nodes):            # subtree sums
        for c in n.children:
            n.chars += c.chars
            n.link += c.link
            n.words += c.words
            n.stops += c.stops
            n.tags += c.tags
    total = max(position, 1)
    nothing = (0,) * FEATURES
    rows, row = [], {}
    for n in nodes:
        tag, chars = n.tag, n.chars
        up = row[id(n.parent)] if n.parent else nothing
        kin = n.parent.children if n.parent else [n]
        mine = n.parent.kin_chars if n.parent else chars
        n.kin_chars = 0
        for k, c in enumerate(n.children):
            n.kin_chars += c.chars
            c.order = k
        place = n.order / max(len(kin) - 1, 1) if n.parent else 0.0
        x = row[id(n)] = (
            tag in BODY, up[IN_BODY] or up[IS_BODY], tag in CHROME, up[IN_CHROME] or up[IS_CHROME],
            n.side, up[SIDE_SELF] + up[SIDE_ABOVE], n.main, up[MAIN_SELF] + up[MAIN_ABOVE],
            tag in HEADINGS, tag == "p", tag in LISTS, tag in TABLES, tag == "div" or tag == "section", tag == "#text",
            up[LEVEL] + 1 if n.parent else 0,
            math.log1p(chars), n.link / max(chars, 1), n.tags / max(chars, 1), math.log1p(n.words),
            n.stops / max(n.words, 1), chars / total, n.at / total, place, len(kin), chars / max(mine, 1),
            math.log1p((mine - chars) / max(len(kin) - 1, 1) / max(chars, 1)))
        rows.append(x)
    return np.array(rows, np.float64)
