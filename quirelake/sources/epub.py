"""EPUB packages: scanned into units, written back with translated lines. Standard library only."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions.text import ROMAN_PAGES, STRUCTURAL_RESIDUES
from quirelake.operators.units import infer_kind
from quirelake.sources.html import Block, Node, blocks, hints, parse, serialize

UNIT = "book string, line int, lines int, unit string, zip_name string, item_id string, block_index int, tag string, unit_mode string, hint string, original_text string"
def source_text(text: str) -> str:
    text = " ".join(text.split())
    return re.sub(r" +([)\]}])", r"\1", re.sub(r"([(\[{]) +", r"\1", re.sub(r" +([,.;:!?])", r"\1", text)))


def translatable(text: str) -> bool:
    """The rule of ``reject_reason`` for a text that is at hand in Python; tests hold the two against each other."""
    low = text.lower()
    numeral = low.strip("[](){}.,;:") in ROMAN_PAGES or re.fullmatch(r"[\[(]?[0-9]{1,4}[\])]?\.?", text)
    other = re.match(r"(?:<\?|\?)?xml(?!\w)", low) or re.fullmatch(r"(?:https?://|www\.)\S+", low)
    return any(map(str.isalnum, text)) and low not in STRUCTURAL_RESIDUES and not numeral and not other


class Package:
    """The members of a package and what its OPF says about them."""

    def __init__(self, content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            self.infos = z.infolist()
            self.members = {i.filename: z.read(i) for i in self.infos}
        container = ElementTree.fromstring(self.members["META-INF/container.xml"])
        self.opf = next(e.attrib["full-path"] for e in container.iter() if e.tag.endswith("rootfile"))
        self.base = posixpath.dirname(self.opf)
        tree = ElementTree.fromstring(self.members[self.opf])
        local = lambda e: e.tag.rsplit("}", 1)[-1]
        self.items = {e.attrib["id"]: e.attrib for e in tree.iter() if local(e) == "item"}
        spine = [e for e in tree.iter() if local(e) == "spine"]
        order = [e.attrib.get("idref") for e in tree.iter() if local(e) == "itemref"]
        self.toc = spine[0].attrib.get("toc") if spine else None
        text = [k for k, v in self.items.items() if v.get("media-type", "").endswith(("xhtml+xml", "html")) or v.get("href", "").lower().endswith((".xhtml", ".html", ".htm"))]
        self.reading = [k for k in dict.fromkeys([*order, *text]) if k in text]

    def path(self, href: str) -> str:
        """The member a reference of the OPF names: as it is, under the OPF's folder, or the only one that ends with it."""
        for name in (href, posixpath.normpath(posixpath.join(self.base, href))):
            if name in self.members:
                return name
        ends = [n for n in self.members if n.endswith("/" + href)]
        if len(ends) != 1:
            raise ValueError(f"the package has no single member {href}")
        return ends[0]

    def ncx(self) -> list[str]:
        found = [self.toc] if self.toc in self.items else []
        found += [k for k, v in self.items.items() if "ncx" in v.get("media-type", "") or v.get("href", "").lower().endswith(".ncx") or k in ("toc", "ncx") and not v.get("href", "").lower().endswith((".xhtml", ".html"))]
        return list(dict.fromkeys(self.path(self.items[k]["href"]) for k in found))

    def nav(self) -> list[str]:
        return list(dict.fromkeys(self.path(v["href"]) for k, v in self.items.items() if "nav" in v.get("properties", "").split() or k == "nav"))


def decode(content: bytes) -> str:
    return content.decode("utf-8", "replace")


def _labels(package: Package) -> Iterator[tuple[str, str, int, Node]]:
    """(unit kind, member, ordinal, text node) of the title, the NCX labels and the NAV texts; the ordinal counts untranslatable ones too."""
    trees = {n: parse(decode(package.members[n])) for n in dict.fromkeys([package.opf, *package.ncx(), *package.nav()])}
    titles = [n for n in trees[package.opf].walk() if n.name == "title"]
    for i, n in enumerate(titles[:1]):
        yield from (("opf_title", package.opf, i, t) for t in n.walk() if not t.tag and t.text.strip())
    for name in package.ncx():
        labels = [n for n in trees[name].walk() if n.name == "text" and n.parent is not None and n.parent.name == "navlabel"]
        for i, n in enumerate(labels):
            yield from (("ncx_label", name, i, t) for t in n.walk() if not t.tag and t.text.strip())
    for name in package.nav():
        texts = [t for t in trees[name].walk() if not t.tag and not t.raw and t.text.strip() and any(a.name == "nav" for a in t.up())]
        yield from (("nav_text", name, i, t) for i, t in enumerate(texts))


def _parts(block: Block) -> list[list[Node]]:
    return [p for p in block.parts if translatable(source_text("".join(n.text for n in p)))]


def extract(content: bytes, book: str) -> list[tuple]:
    """The units of one package in line order: metadata first, then the chapters in reading order; one line a part of a block."""
    package, out, line = Package(content), [], 0
    for kind, name, i, node in _labels(package):
        text = source_text(node.text)
        if translatable(text):
            out.append((book, line, 1, kind, name, None, i, None, None, None, text))
            line += 1
    skip = set(package.nav())
    for item in package.reading:
        name = package.path(package.items[item]["href"])
        if name in skip:
            continue
        for i, block in enumerate(blocks(parse(decode(package.members[name])))):
            parts = _parts(block)
            for p in parts:
                out.append((book, line, len(parts), "block", name, item, i, block.node.name, block.mode, hints(block.node), source_text("".join(n.text for n in p))))
                line += 1
    return out


def read_epub(spark: SparkSession, path: str) -> DataFrame:
    """Units of the EPUBs under ``path`` with their kind, one row a line; columns as UNIT and kind."""

    def scan(batches):
        for batch in batches:
            rows = [r for p, c in zip(batch["path"], batch["content"]) for r in extract(bytes(c), p)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in UNIT.split(", ")]).astype({"block_index": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[eE][pP][uU][bB]").load(path).select("path", "content")
    units = files.mapInPandas(scan, UNIT)
    item = F.concat_ws(" ", "item_id", "zip_name")
    return units.withColumn("kind", F.when(F.col("unit") == "block", infer_kind(item, F.col("tag"), F.col("hint"))).otherwise(F.col("unit"))).drop("hint")


def _put(nodes: list[Node], text: str) -> None:
    """The first text takes the translation, the others are emptied; links keep their text where the translation has it, in order."""
    links: list[tuple[Node, str]] = []
    for n in nodes:
        link = next((a for a in n.up() if a.name == "a"), None)
        if link is not None:
            links.append((n, n.text.strip()))
    places, at = [], 0
    for _, own in links:
        p = text.find(own, at) if own else -1
        if p < 0:
            places = []
            break
        places.append(p)
        at = p + len(own)
    if links and len(links) == len(nodes):
        nodes[0].text = text
        for n in nodes[1:]:
            n.text = ""
        return
    if links and places:
        cursor = 0
        free = [n for n in nodes if all(n is not k for k, _ in links)]
        for n in free:
            n.text = ""
        for (n, own), p in zip(links, places):
            before = text[cursor:p]
            k = next(i for i, x in enumerate(nodes) if x is n)
            home = next((x for x in reversed(nodes[:k]) if any(x is f for f in free)), None)
            if home is not None:
                home.text = before
            else:
                n.text = before + own
                cursor = p + len(own)
                continue
            n.text = own
            cursor = p + len(own)
        tail = next((x for x in reversed(nodes) if any(x is f for f in free)), nodes[-1])
        last = nodes.index(links[-1][0]) if links[-1][0] in nodes else -1
        rest = text[cursor:]
        if free and nodes.index(tail) > last:
            tail.text = rest
        else:
            nodes[last].text += rest
        return
    first = next((n for n in nodes if all(n is not k for k, _ in links)), nodes[0])
    for n in nodes:
        n.text = text if n is first else ""


def rebuild(content: bytes, lines: list[str], language: str, css: str = "") -> bytes:
    """The package with its lines replaced in order. ValueError if there are not exactly as many lines as it holds."""
    expected = len(extract(content, ""))
    if expected != len(lines):
        raise ValueError(f"line count: the package holds {expected} lines, {len(lines)} were given")
    package, at, out = Package(content), iter(lines), {}
    for kind, name, i, node in (labels := list(_labels(package))):
        if translatable(source_text(node.text)):
            node.text = next(at)
        root = list(node.up())[-1]
        if kind == "opf_title":
            for n in root.walk():
                if n.name == "language" and n.children:
                    n.children[0].text = language
        out[name] = root
    del labels
    skip = set(package.nav())
    for item in package.reading:
        name = package.path(package.items[item]["href"])
        if name in skip:
            continue
        root = parse(decode(package.members[name]))
        for block in list(blocks(root)):
            for part in _parts(block):
                _put(part, next(at))
        out[name] = root
    done: dict[str, bytes] = {}
    for name, root in out.items():
        for n in root.walk():
            if n.tag == "html":
                n.attrs |= {"lang": language, "xml:lang": language}
        done[name] = serialize(root).encode()
    if css:
        done |= {n: c + b"\n" + css.encode() for n, c in package.members.items() if n.lower().endswith(".css") and css.encode() not in c}
    target = io.BytesIO()
    with zipfile.ZipFile(target, "w") as z:
        for info in sorted(package.infos, key=lambda i: i.filename != "mimetype"):
            z.writestr(info, done.get(info.filename, package.members[info.filename]), compress_type=zipfile.ZIP_STORED if info.filename == "mimetype" else zipfile.ZIP_DEFLATED)
    return target.getvalue()


def write_epub(files: DataFrame, translations: DataFrame, language: str, css: str = "") -> DataFrame:
    """(path, content) of the rebuilt packages; ``files`` is (path, content), ``translations`` (path, line, text). One task a book: a package is one file."""
    rows = translations.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]).alias("lines"))

    def make(batches):
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "content": [rebuild(bytes(c), list(t), language, css) for c, t in zip(batch["content"], batch["lines"])]})

    return files.select("path", "content").join(rows, "path").mapInPandas(make, "path string, content binary")
