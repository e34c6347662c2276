"""Main text of an HTML page: structured data, scored containers, paragraphs by score, the whole body.

The tree builder works on what `html.parser` reports and mends what pages usually get wrong: elements
that are never closed, paragraphs and list items that end where the next begins, a missing body.
"""

from __future__ import annotations

import json
import math
from html.parser import HTMLParser

# Elements without an end, elements that end an open paragraph, and those around which lines break.
VOID = "area base br col embed hr img input link meta param source track wbr".split()
ENDS_P = "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
BLOCKS = "p div br h1 h2 h3 h4 h5 h6 blockquote pre li tr section article".split()
# Elements that are never content.
NOT_CONTENT = "script style noscript iframe object embed applet svg canvas map audio video source track input button select option textarea fieldset form label datalist output".split()
# Structural boilerplate, by element and by parts of class and id.
BOILERPLATE = "nav footer aside".split()
HEADER_PARTS = "site main global page".split()
DIV_PARTS = "sidebar widget cookie consent banner modal popup overlay sharing newsletter subscribe advertisement sponsor promo".split()
DIV_CLASS_PARTS = "social-share social_share ad-container ad_container ad-wrapper ad_wrapper".split()
# What is left out within content.
UNWANTED = "nav footer aside figcaption".split()
UNWANTED_PARTS = "sidebar share social related comment author-bio newsletter subscribe advertisement promo recommendation trending popular breadcrumb pagination".split()
# Likely content containers in order of priority, as (what, value); = is the whole attribute, * a part, . a class name.
CONTAINERS = [tuple(x.split()) for x in """
tag article
itemprop= articleBody
class* article-body
class* article-content
class* article_body
class* article_content
class* post-content
class* post-body
class* post_content
class* post_body
class* entry-content
class* entry-body
class* entry_content
class* story-body
class* story-content
class* blog-post
class* blog-content
role= main
tag main
id= content
id= main-content
id= main_content
id= article
id= post
class* content-area
class* main-content
class* page-content
class* single-content
class= content
class= post
class= text
class= body
class. hentry
class* wysiwyg
class* markdown
class* prose
class* rich-text
""".strip().splitlines()]


class Node:
    __slots__ = ("tag", "attrs", "children", "out", "unwanted")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.out, self.unwanted = boilerplate(tag, attrs), unwanted(tag, attrs)

    def walk(self):
        """All elements below, in the order of the page."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]


def boilerplate(tag: str, attrs: dict[str, str]) -> bool:
    if tag in NOT_CONTENT or tag in BOILERPLATE:
        return True
    cls, id_ = attrs.get("class", ""), attrs.get("id", "")
    if tag == "header":
        return any(p in cls or p in id_ for p in HEADER_PARTS)
    return tag == "div" and (any(p in cls or p in id_ for p in DIV_PARTS) or any(p in cls for p in DIV_CLASS_PARTS))


def unwanted(tag: str, attrs: dict[str, str]) -> bool:
    return tag in UNWANTED or any(p in attrs.get("class", "") for p in UNWANTED_PARTS)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]

    def _close(self, tags, until: tuple[str, ...]) -> None:
        """Closes the innermost of `tags`, unless one of `until` is met first."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in until:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and any(n.tag == tag for n in self.root.walk()):
            return
        if tag in ENDS_P:
            self._close(("p",), ("button", "td", "th", "table"))
        if tag == "li":
            self._close(("li",), ("ul", "ol"))
        elif tag in ("tr", "td", "th"):
            self._close(("tr",) if tag == "tr" else ("td", "th"), ("table",))
        elif tag in ("dd", "dt"):
            self._close(("dd", "dt"), ("dl",))
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag not in VOID and tag not in ("html", "body"):
            self._close((tag,), () if tag in ENDS_P or tag in ("html", "body") else ("td", "th"))

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def body_of(root: Node) -> Node:
    return next((n for n in root.walk() if n.tag == "body"), root)


def pieces(node: Node, inside: bool) -> list[str]:
    """Trimmed text runs and line breaks below `node`, without boilerplate and, if `inside`, without what is unwanted in content."""
    out: list[str] = []
    stack: list = [iter(node.children)]
    ends: list[bool] = [False]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
            if ends.pop():
                out.append("\n")
        elif isinstance(child, str):
            if text := child.strip():
                out.append(text)
        elif not (child.out or (inside and child.unwanted)):
            block = child.tag in BLOCKS
            if block and out:
                out.append("\n")
            stack.append(iter(child.children))
            ends.append(block)
    return out


def lines(text: str) -> str:
    return "\n".join(x for x in (" ".join(y.split()) for y in text.split("\n")) if x)


def text_of(node: Node, inside: bool = True) -> str:
    return lines(" ".join(pieces(node, inside)))


def size(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def raw_text(node: Node) -> str:
    out: list[str] = []
    stack: list = [node]
    while stack:
        here = stack.pop()
        if isinstance(here, str):
            out.append(here)
        else:
            stack += reversed(here.children)
    return "".join(out)


def clean_title(title: str) -> str:
    for mark in (" | ", " - ", " — "):
        title = title.split(mark, 1)[0]
    return title.strip()


def title_of(root: Node) -> str:
    for tag in ("title", "h1"):
        node = next((n for n in root.walk() if n.tag == tag), None)
        text = " ".join(raw_text(node).split()) if node else ""
        text = clean_title(text) if tag == "title" else text
        if text:
            return text
    return "Untitled"


def json_ld(root: Node) -> str | None:
    """The first article text in the page's structured data."""
    def of(value) -> str | None:
        if isinstance(value, list):
            return next((x for x in map(of, value) if x), None)
        if not isinstance(value, dict):
            return None
        if isinstance(body := value.get("articleBody"), str) and body.strip():
            return body.strip()
        if isinstance(text := value.get("text"), str) and size(text.strip()) > 200:
            return text.strip()
        return of(value["@graph"]) if isinstance(value.get("@graph"), list) else None

    for node in root.walk():
        if node.tag == "script" and node.attrs.get("type") == "application/ld+json":
            try:
                found = of(json.loads(raw_text(node)))
            except ValueError:
                continue
            if found:
                return found
    return None


def matches(node: Node, what: str, value: str) -> bool:
    if what == "tag":
        return node.tag == value
    attribute, how = what[:-1], what[-1]
    has = node.attrs.get(attribute)
    if has is None:
        return False
    return has == value if how == "=" else value in has if how == "*" else value in has.split()


def link_density(node: Node, text: str) -> float:
    hidden = lambda n: n.out or n.unwanted
    total, stack = 0, [node]
    while stack:
        here = stack.pop()
        for child in here.children:
            if isinstance(child, Node) and not hidden(child):
                if child.tag == "a":
                    total += sum(map(size, pieces(child, True)))
                stack.append(child)
    return total / size(text) if text else 0.0


def score(text: str, density: float, paragraphs: int, headings: int, items: int) -> float:
    """Longer texts are better; links, lists and odd words are worse, paragraphs and a few headings better."""
    n, words = size(text), len(text.split())
    out = math.log(n) if n else 0.0
    out *= 0.1 if density > 0.5 else 0.5 if density > 0.3 else 0.8 if density > 0.1 else 1.0
    if paragraphs > 3:
        out *= 1 + 0.2 * math.log(paragraphs)
    if 1 <= headings < 10:
        out *= 1.1
    if paragraphs and items and items / paragraphs > 5:
        out *= 0.5
    if words and n / words < 3:
        out *= 0.5
    return out


def counts(node: Node) -> tuple[int, int, int]:
    tags = [n.tag for n in node.walk()]
    return tags.count("p"), sum(t in ("h1", "h2", "h3") for t in tags), tags.count("li")


def fold(candidates: list[tuple[float, int]]) -> int | None:
    """The place of the candidate (score, bytes) chosen in order: a better score wins, or one almost as good on twice the text."""
    best = None
    for i, (s, n) in enumerate(candidates):
        if best is None or s > candidates[best][0] or (s > 0.9 * candidates[best][0] and n > 2 * candidates[best][1]):
            best = i
    return best


def main_content(root: Node) -> tuple[str, str, float] | None:
    """Title, text and score of the chosen container; the whole body without one."""
    found = []
    nodes = list(root.walk())
    for what, value in CONTAINERS:
        for node in nodes:
            if matches(node, what, value):
                text = text_of(node)
                if size(text) >= 50:
                    found.append((node, text, score(text, link_density(node, text), *counts(node))))
    best = fold([(s, size(t)) for _, t, s in found])
    if best is not None:
        node, text, s = found[best]
        head = next((n for n in node.walk() if n.tag == "h1"), None)
        return " ".join(raw_text(head).split()) if head else "", text, s
    text = text_of(body_of(root))
    return ("", text, 0.0) if size(text) > 100 else None


def paragraphs_by_score(root: Node) -> str:
    """Text of the element whose paragraphs score best: commas and length, less links. An approximation of the published heuristic."""
    best, text = 0.0, ""
    for node in root.walk():
        own = [c for c in node.children if isinstance(c, Node) and c.tag in ("p", "pre", "td") and not c.out]
        total = 0.0
        for p in own:
            t = text_of(p)
            if len(t) >= 25:
                total += (1 + t.count(",") + min(len(t) // 100, 3)) * (1 - min(1.0, link_density(p, t)))
        if total > best:
            best, text = total, "\n".join(x for x in map(text_of, own) if x)
    return text


def body_text(root: Node) -> str | None:
    """The body without boilerplate as one line, if it is over 50 bytes."""
    text = " ".join(text_of(body_of(root), inside=False).split())
    return text if size(text) > 50 else None


def extract(html: str | None, url: str | None) -> tuple[str, str, str, float] | None:
    """Title, text, tier and score of a page; None without content."""
    if not html:
        return None
    root = parse(html)
    title = title_of(root)
    found = json_ld(root)
    if found and size(found) > 100:
        return title, found, "structured", 0.0
    chosen = main_content(root)
    if chosen and size(chosen[1]) > 50:
        return chosen[0] or title, chosen[1], "container", chosen[2]
    if url and "://" in url:
        text = paragraphs_by_score(root)
        if text:
            return title, text, "paragraphs", 0.0
    text = body_text(root)
    return (title, text, "body", 0.0) if text else None
