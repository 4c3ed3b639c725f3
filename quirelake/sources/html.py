"""XHTML as a small tree, and its blocks in document order. Standard library only."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser

# Tags and names of the package format.
BLOCKS = ("article", "aside", "h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "blockquote", "div", "figcaption", "main", "pre", "section", "td", "th", "caption", "dt", "dd")
HIDDEN = ("head", "link", "meta", "script", "style", "svg", "title")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
MEDIA = ("a", "audio", "embed", "iframe", "img", "object", "source", "track", "video")
NOTE_WORDS = ("note", "notes", "footnote", "footnotes", "endnote", "endnotes")
NUMBER = re.compile(r"[\[(]?\d{1,4}[\])]?\.?")
NOTE = re.compile(r"(?:fn|note|footnote|endnote)[-_ ]?\d{1,5}\.?")


@dataclass
class Node:
    """An element (tag set), a text, or raw markup kept as it is."""

    tag: str = ""
    attrs: dict[str, str] = field(default_factory=dict)
    text: str = ""
    raw: bool = False
    children: list[Node] = field(default_factory=list)
    parent: Node | None = field(default=None, repr=False)

    def add(self, node: Node) -> Node:
        node.parent = self
        self.children.append(node)
        return node

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def up(self) -> Iterator[Node]:
        node = self
        while node is not None:
            yield node
            node = node.parent

    @property
    def name(self) -> str:
        return self.tag.rsplit(":", 1)[-1].lower()

    def content(self) -> str:
        return "".join(n.text for n in self.walk() if not n.tag and not n.raw)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node(tag="#root")

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS or tag in ("ul", "ol", "table"):  # an open paragraph ends where a block begins
            for node in self.here.up():
                if node.name == "p":
                    self.here = node.parent
                    break
                if node.name in BLOCKS or node.name == "#root":
                    break
        node = self.here.add(Node(tag=tag, attrs={k: v or "" for k, v in attrs}))
        if tag not in VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.here.add(Node(tag=tag, attrs={k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for node in self.here.up():
            if node.tag == tag:
                self.here = node.parent
                return

    def handle_data(self, data):
        self.here.add(Node(text=data))

    def handle_comment(self, data):
        self.here.add(Node(text=f"<!--{data}-->", raw=True))

    def handle_decl(self, decl):
        self.here.add(Node(text=f"<!{decl}>", raw=True))

    def handle_pi(self, data):
        self.here.add(Node(text=f"<?{data}>", raw=True))


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def serialize(node: Node) -> str:
    if not node.tag:
        parent = node.parent.name if node.parent is not None else ""
        return node.text if node.raw or parent in ("script", "style") else escape(node.text, quote=False)
    inner = "".join(map(serialize, node.children))
    if node.tag == "#root":
        return inner
    attrs = "".join(f' {k}="{escape(v)}"' for k, v in node.attrs.items())
    return f"<{node.tag}{attrs}/>" if node.tag in VOID and not inner else f"<{node.tag}{attrs}>{inner}</{node.tag}>"


def types(node: Node) -> set[str]:
    return set(f"{node.attrs.get('epub:type', '')} {node.attrs.get('type', '')}".lower().split())


def is_note_link(node: Node) -> bool:
    """A link that marks a note: a note's number or word with a class, type, name or target that says so."""
    if node.name != "a":
        return False
    text = " ".join(node.content().split()).lower()
    number = bool(NUMBER.fullmatch(text))
    if not (number or NOTE.fullmatch(text)):
        return False
    href = node.attrs.get("href", "").lower()
    target = href.rsplit("#", 1)[-1] if "#" in href else ""
    about = " ".join((node.attrs.get("id", ""), node.attrs.get("role", ""), href)).lower()
    named = "noteref" in node.attrs.get("class", "").lower().split() or types(node) & {"noteref", "footnote", "endnote"}
    pointed = "#" in href and (not number or any(w in about for w in NOTE_WORDS))
    return bool(named or pointed or re.fullmatch(r"(?:n|fn|note|footnote|endnote)[-_]?\d{1,5}", target))


def is_structural(node: Node) -> bool:
    """Note links, links back from notes, and links of page numbers: their text stays as it is."""
    if node.name != "a":
        return False
    href = node.attrs.get("href", "")
    back = "backlink" in node.attrs.get("class", "").lower().split() and bool(href)
    page = bool(types(node) & {"index-locator", "pagebreak"}) or bool(re.fullmatch(r"p\d{1,5}", href.rsplit("#", 1)[-1].lower() if "#" in href else ""))
    return back or page or is_note_link(node)


def visible(node: Node) -> bool:
    """A text that is read: not blank, not hidden, not inside a structural link at any depth."""
    return not node.tag and not node.raw and bool(node.text.strip()) and not any(n.name in HIDDEN or is_structural(n) for n in node.up())


@dataclass
class Block:
    node: Node
    mode: str  # block: all its text; direct_text: only its own strings, as it holds other blocks
    parts: list[list[Node]]  # texts between note links


def blocks(root: Node) -> Iterator[Block]:
    """The blocks that hold text, in document order, each with its texts parted at note links."""
    for node in root.walk():
        if node.name not in BLOCKS or any(n.name in HIDDEN for n in node.up()):
            continue
        inner = [n for n in node.walk() if n is not node]
        if any(n.name in BLOCKS for n in inner):
            own = [c for c in node.children if visible(c)]
            if own:
                yield Block(node, "direct_text", [own])
            continue
        parts: list[list[Node]] = [[]]
        for n in inner:
            if is_note_link(n):
                parts.append([])
            elif visible(n):
                parts[-1].append(n)
        parts = [p for p in parts if p]
        if parts:
            yield Block(node, "block", parts)


def hints(node: Node) -> str:
    """What the names, types and classes of a node and its ancestors say."""
    return " ".join(n.attrs[k] for n in node.up() for k in ("id", "role", "epub:type", "type", "class") if n.attrs.get(k))
