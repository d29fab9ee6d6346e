"""Pages as tables of nodes: one row for each element and text, numbered so that a subtree is a range."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends open elements of these kinds, up to the nearest of the others.
IMPLIED = {"li": ({"li"}, {"ul", "ol"}), "p": ({"p"}, {"div", "li", "td", "section", "article", "body"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

NODE = "node int, last int, parent int, depth int, tag string, attrs map<string,string>, text string"


class Tree(HTMLParser):
    """Collects [parent, depth, tag, attributes, text, last node of its subtree] for each node in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []
        self.open: list[int] = []

    def add(self, tag: str, attrs: dict, text: str | None) -> int:
        self.nodes.append([self.open[-1] if self.open else -1, len(self.open), tag, attrs, text, len(self.nodes)])
        return len(self.nodes) - 1

    def close_one(self) -> None:
        self.nodes[self.open.pop()][5] = len(self.nodes) - 1

    def end_implied(self, kinds: set, stops: set) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            tag = self.nodes[self.open[k]][2]
            if tag in stops:
                return
            if tag in kinds:
                while len(self.open) > k:
                    self.close_one()
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in IMPLIED:
            self.end_implied(*IMPLIED[tag])
        elif tag in BLOCKS:
            self.end_implied(*IMPLIED["p"])
        node = self.add(tag, {k: v or "" for k, v in reversed(attrs)}, None)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.close_one()

    def handle_endtag(self, tag: str) -> None:
        if any(self.nodes[k][2] == tag for k in self.open):
            while True:
                done = self.nodes[self.open[-1]][2] == tag
                self.close_one()
                if done:
                    return

    def handle_data(self, data: str) -> None:
        if data:
            self.add("#text", {}, data)

    def finish(self) -> list[list]:
        self.close()
        while self.open:
            self.close_one()
        return self.nodes


def nodes(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, node, last, parent, depth, tag, attrs, text) of all pages, nodes numbered in page order from 0.

    The subtree of a node is the range from it to ``last``; a root's parent is -1. Texts are nodes with the tag ``#text``. A null
    page has no node. Parsing is sequential in a page; pages are spread as they are read.
    """
    schema = ", ".join([f"`{key}` {pages.schema[key].dataType.simpleString()}", NODE])
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                of, rows = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    tree = Tree()
                    tree.feed(text or "")
                    for n, (parent, depth, tag, attrs, data, last) in enumerate(tree.finish()):
                        of.append(i)
                        rows.append((n, last, parent, depth, tag, list(attrs.items()), data))
                keys = part.column(0).take(pa.array(of, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=[key, "node", "last", "parent", "depth", "tag", "attrs", "text"])

    return pages.select(key, F.col(html)).mapInArrow(run, schema)
