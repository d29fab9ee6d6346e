"""Main text of web pages by wrapper induction.

For each host a bounded sample of its pages is parsed and their trees are aligned, one after another,
by simple tree matching (Yang 1991) into a wrapper tree. Nodes whose text never varies are template,
nodes whose text varies are slots. How long a constant text may be to count as template grows with
the number of pages that agree on it, from two pages on. Each page is then aligned with its host's
wrapper, and all its text is taken but for template, navigation and forms, and, outside of its content
region (article or main, else the container of most varying text), what a fixed list of words in class
and id, <header> and <aside> name as boilerplate. Inside the region these go only where they are
template. Outside of it a constant text that only some of the pages have is template too, by the sample's
wrapper or by counts over all pages of the host (blocks beside an article that are on one page in fifty). Names yield to
evidence: on a host without any region a named slot that varies and holds a quarter of the varying text stays
(unless it is named as readers' comments), and a page whose varying text is all in named slots keeps it.
A page that is all template has the text of its articles, or none if it has no article; so has a page that no
other page of its host tells apart (a host of one page keeps its motto and closing line).

Parsing is one pass over the page, whatever its markup. As in browsers, the tree has a largest depth:
an element that would be deeper is put beside its parent's other children, and its text stays.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgework.llm.common import Bounded, table, written


@dataclass(frozen=True)
class Settings:
    """``sample``: pages a wrapper is learned from; a text that n pages agree on is template up to ``constant_chars * (n - 1)**2`` characters.

    ``some``: share of the pages (three at least) that a constant outside of the content region has to be on.
    ``broadcast_rows`` and ``_bytes``: beyond these a join is shuffled.
    """

    sample: int = 12
    constant_chars: int = 60
    some: float = 0.25
    dominance: float = 0.6
    #: share of the varying text from which on a slot's name is not believed
    evidence: float = 0.25
    #: share of a host's different pages, and least number of them, that make a block beside the article template
    often: float = 0.02
    often_pages: int = 5
    broadcast_rows: int = 500_000
    broadcast_bytes: int = 32_000_000


TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
TAG_PART = re.compile(r">|=\s*([\"'])")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[^\W_]")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp".split())
RAW_END = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption body html".split())
#: What the start of a tag ends, within the nearest of some ancestors.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
BOILER_TAGS = frozenset("nav header footer aside form menu dialog button select datalist object audio video canvas head".split()) | RAW
BOILER_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscri\w*|side-?bar|widget|menu|nav\w*|breadcrumbs?|footer|header|masthead|comments?|comment-?list|reply|replies|disqus|respond|share|sharing|social|related|recommended|pagination|pager|login|signup|search|toolbar|copyright|skip)(?:$|[\s_-])", re.I)
COMMENT_NAMES = re.compile(r"(?:^|[\s._-])(?:comments?|comment-?list|reply|replies|disqus|respond)(?:$|[\s_-])", re.I)
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
CONTAINERS = frozenset("html body div section article main table tbody tr td center span".split())
#: Boilerplate by its tag outside of the content region only.
NAMED_TAGS = frozenset(("header", "aside"))
CONTENT = ("article", "main")
DIGITS = re.compile(r"\d+")
#: The largest depth of a page's tree, and the pairs of two nodes' groups up to which a table is filled in.
DEPTH = 200
CELLS = 40_000
PRIME, BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E687


class Node:
    """An element; its children are elements and text.

    ``boiler``: boilerplate by tag, role or name; ``hard``: that anywhere in a page. ``finish`` adds
    ``mark`` (a hash of the texts below, boilerplate too, and their number; (0, 0) if blank), ``chars``
    (of these texts), ``size`` (elements in groups) and ``content`` (holds an article or main that isn't hard).
    """

    __slots__ = ("boiler", "chars", "children", "content", "groups", "hard", "label", "mark", "size", "tag")

    def __init__(self, tag: str, label: str, boiler: bool, hard: bool = False):
        self.tag, self.label, self.boiler, self.hard, self.children = tag, label, boiler, hard, []
        self.mark, self.chars, self.size, self.content, self.groups = (0, 0), 0, 1, False, []


def tag_end(html: str, at: int, unpaired: set[str]) -> int:
    """The place of the ``>`` that ends a tag, -1 if none; quotes count behind an equals sign.

    A quote that nothing closes is read as text; ``unpaired`` remembers such quotes for the rest of the page.
    """
    while m := TAG_PART.search(html, at):
        if not m[1]:
            return m.start()
        close = -1 if m[1] in unpaired else html.find(m[1], m.end())
        if close < 0:
            unpaired.add(m[1])
            return html.find(">", m.end())
        at = close + 1
    return -1


def parse(html: str) -> Node:
    """A forgiving parse: optional and missing end tags, stray end tags, comments, raw text elements."""
    root = Node("html", "html", False)
    nodes, stack, opened = [root], [root], Counter(["html"])
    unpaired: set[str] = set()
    at = text_from = 0

    def close_to(k: int) -> None:
        for n in stack[k:]:
            opened[n.tag] -= 1
        del stack[k:]

    def end(tags: set, within: set) -> None:
        if any(opened[t] for t in tags):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in tags:
                    close_to(k)
                    return
                if stack[k].tag in within:
                    return

    while (start := html.find("<", at)) >= 0:
        after = html[start + 1 : start + 2]
        closing = after == "/"
        name = TAG_NAME.match(html, start + 1 + closing)
        if after in ("!", "?") or closing and not name:
            comment = html.startswith("<!--", start)
            stop = html.find("-->" if comment else ">", start)
            if stop < 0 and not comment:
                break
            if start > text_from:
                stack[-1].children.append(html[text_from:start])
            at = text_from = len(html) if stop < 0 else stop + (3 if comment else 1)
            continue
        if not name:
            at = start + 1
            continue
        stop = tag_end(html, name.end(), unpaired)
        if stop < 0:  # nothing ends a tag from here on: all is text
            break
        if start > text_from:
            stack[-1].children.append(html[text_from:start])
        at = text_from = stop + 1
        tag = name[0].lower()
        if closing:
            if tag not in VOID and opened[tag] > (tag == "html"):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close_to(k)
            continue
        if tag in CLOSES_P:
            end({"p"}, {"button", "td", "th", "table"})
        if tag in ENDS:
            end(*ENDS[tag])
        if tag in ("html", "body") and opened[tag]:
            continue
        attributes = html[name.end() : stop]
        node = Node(tag, *_label(tag, attributes))
        nodes.append(node)
        stack[-1].children.append(node)
        if tag in RAW:
            close = RAW_END[tag].search(html, at)
            gone = html.find(">", close.start()) if close else -1
            at = text_from = gone + 1 if gone >= 0 else len(html)
        elif (tag not in VOID and not attributes.rstrip().endswith("/") or tag in BLOCK) and len(stack) < DEPTH:
            stack.append(node)
            opened[tag] += 1
    if text_from < len(html):
        stack[-1].children.append(html[text_from:])
    finish(nodes)
    return root


def finish(nodes: list[Node]) -> None:
    """Compute what nodes know of the elements below them; children come behind their parents in ``nodes``."""
    for n in reversed(nodes):
        if n.tag in RAW:
            continue
        whole, number = 0, 0
        for c in n.children:
            if isinstance(c, str):
                text = SPACE.sub(" ", unescape(c)).strip()
                if not text:
                    continue
                h, k = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) % PRIME, 1
                n.chars += len(text)
            else:
                h, k = c.mark
                n.chars += c.chars
                n.content = n.content or not c.hard and (c.tag in CONTENT or c.content)
            whole, number = (whole * pow(BASE, k, PRIME) + h) % PRIME, number + k
        n.mark = whole, number
        n.groups = [(label, list(g)) for label, g in groupby((c for c in n.children if not isinstance(c, str)), key=lambda c: c.label)]
        n.size = 1 + sum(g[0].size for _, g in n.groups)


def _label(tag: str, attributes: str) -> tuple[str, bool, bool]:
    names, role = "", ""
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            role = value.lower().strip()
        else:
            names += " " + value
    hard = tag in BOILER_TAGS and tag not in NAMED_TAGS or role in BOILER_ROLES
    boiler = hard or tag in NAMED_TAGS or (tag not in ("html", "body", "main", "article") and bool(names) and BOILER_NAMES.search(names) is not None)
    return f"{tag}.{DIGITS.sub('#', names.strip())}" if names else tag, boiler, hard


class Matching:
    """The simple tree matching of one page with a wrapper: each pair of nodes is matched once.

    The children of a node are its groups: neighbours of one label (the paragraphs of a text, the items
    of a list) are one. Where two nodes have more than ``CELLS`` pairs of groups, the k-th group of a
    label is paired with the wrapper's k-th, as far as these pairs keep the order.
    """

    def __init__(self):
        self.sizes: dict[tuple[int, int], int] = {}
        self.pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def size(self, w: dict, node: Node) -> int:
        if w["l"] != node.label:
            return 0
        key = id(w), id(node)
        if key not in self.sizes:
            self.match(key, w["c"], node.groups)
        return self.sizes[key]

    def match(self, key: tuple[int, int], a: list[dict], own: list[tuple[str, list[Node]]]) -> None:
        if len(a) * len(own) > CELLS:
            pairs = in_order([x["l"] for x in a], [label for label, _ in own])
            self.sizes[key] = 1 + sum(min(a[i]["z"], own[j][1][0].size) for i, j in pairs)
            self.pairs[key] = pairs
            return
        m = [[0] * (len(own) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, (label, members) in enumerate(own):
                pair = m[i][j] + self.size(x, members[0]) if x["l"] == label else 0
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], pair)
        i, j, pairs = len(a), len(own), []
        while i and j:
            if a[i - 1]["l"] == own[j - 1][0] and m[i][j] == m[i - 1][j - 1] + self.size(a[i - 1], own[j - 1][1][0]):
                i, j = i - 1, j - 1
                pairs.append((i, j))
            elif m[i][j] == m[i - 1][j]:
                i -= 1
            else:
                j -= 1
        self.sizes[key], self.pairs[key] = 1 + m[-1][-1], pairs[::-1]

    def aligned(self, w: dict, node: Node) -> list[tuple[int | None, int | None]]:
        """Pairs (wrapper child, group of the node) in order; None where one has no partner."""
        key = id(w), id(node)
        if key not in self.pairs:
            self.match(key, w["c"], node.groups)
        out: list[tuple[int | None, int | None]] = []
        i = j = 0
        for k, m in [*self.pairs[key], (len(w["c"]), len(node.groups))]:
            out += [(x, None) for x in range(i, k)] + [(None, x) for x in range(j, m)]
            out.append((k, m))
            i, j = k + 1, m + 1
        return out[:-1]


def in_order(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of the k-th places of equal labels: a longest run of them that rises in both lists."""
    places: dict[str, list[int]] = {}
    for i, label in enumerate(a):
        places.setdefault(label, []).append(i)
    seen: Counter = Counter()
    ends: list[int] = []  # smallest end of a run of each length, and the pairs they are of
    at: list[int] = []
    chain: list[tuple[int, int, int]] = []
    for j, label in enumerate(b):
        k = seen[label]
        seen[label] += 1
        if k < len(places.get(label, ())):
            i = places[label][k]
            n = bisect_left(ends, i)
            chain.append((i, j, at[n - 1] if n else -1))
            ends[n : n + 1], at[n : n + 1] = [i], [len(chain) - 1]
    out, here = [], at[-1] if at else -1
    while here >= 0:
        out.append(chain[here][:2])
        here = chain[here][2]
    return out[::-1]


def leaf(node: Node) -> dict:
    """A wrapper node: label, tag, boilerplate, hard, pages, last page, text and its length, varies, content text, all text, size, children."""
    return {"l": node.label, "g": node.tag, "b": node.boiler, "h": node.hard, "n": 0, "p": -1, "s": None, "m": 0, "v": False, "t": 0, "a": 0, "z": 1, "c": []}


def merge(wrapper: dict, node: Node, page: int, by: Matching) -> int:
    """Merge a page's node into a wrapper node; returns the text it adds that isn't boilerplate."""
    if wrapper["p"] != page:
        wrapper["n"] += 1
        wrapper["p"] = page
    if wrapper["s"] is None:
        wrapper["s"], wrapper["m"] = node.mark, node.chars
    elif wrapper["s"] != node.mark:
        wrapper["v"] = True
    if node.hard:
        return 0
    total = sum(len(c.strip()) for c in node.children if isinstance(c, str))
    merged = []
    for i, j in by.aligned(wrapper, node):
        child = wrapper["c"][i] if i is not None else leaf(node.groups[j][1][0])
        if j is not None:
            for member in node.groups[j][1]:
                total += merge(child, member, page, by)
        merged.append(child)
    wrapper["c"] = merged
    wrapper["z"] = 1 + sum(c["z"] for c in merged)
    wrapper["t"] += total
    wrapper["a"] += node.chars
    return 0 if node.boiler else total


def induce(pages: list[str], settings: Settings) -> dict:
    """The wrapper of some pages of a host; nodes are marked ``k`` (constant: 2 on all pages, 1 on some) and ``r`` (the content region, where no article or main is)."""
    trees = [parse(html) for html in pages]
    wrapper = leaf(Node("html", "html", False))
    for k, tree in enumerate(trees):
        merge(wrapper, tree, k, Matching())
    mark(wrapper, len(trees), settings)
    region = wrapper
    while region["g"] not in CONTENT:
        inner = [c for c in region["c"] if not c["b"] and not c["k"] and c["g"] in CONTAINERS]
        best = max(inner, key=lambda c: c["t"], default=None)
        if best is None or best["t"] < settings.dominance * region["t"] or best["n"] < settings.dominance * len(trees):
            break
        region = best
    region["r"] = region["g"] not in ("html", "body")
    if not region["r"] and not holds_content(wrapper):
        believe(wrapper, settings.evidence * varying(wrapper))
    return strip(wrapper) | {"n": len(trees)}


def holds_content(node: dict) -> bool:
    return node["g"] in CONTENT or any(holds_content(c) for c in node["c"] if not c["h"])


def varying(node: dict) -> int:
    """The characters of a wrapper's slots, but for hard boilerplate."""
    if node["h"] or node["k"]:
        return 0
    return node["a"] - sum(c["a"] - varying(c) for c in node["c"])


def believe(node: dict, least: float) -> None:
    """Mark ``o`` what its name calls boilerplate and its varying text contradicts."""
    for c in node["c"]:
        if c["b"] and not c["h"]:
            c["o"] = c["v"] and varying(c) >= least > 0 and not COMMENT_NAMES.search(c["l"])
        if not c["b"] or c.get("o"):
            believe(c, least)


def mark(node: dict, pages: int, settings: Settings) -> None:
    n, k = node["n"], 0
    if node["s"] is not None and node["s"][1] and not node["v"] and node["m"] <= settings.constant_chars * (n - 1) ** 2:
        k = 2 if n == pages else int(n >= max(3, settings.some * pages))
    node["k"] = k
    for c in node["c"]:
        mark(c, pages, settings)


def strip(node: dict) -> dict:
    return {"l": node["l"], "k": node["k"], "s": list(node["s"]) if node["k"] else None, "r": node.get("r", False), "o": node.get("o", False), "z": node["z"], "c": [strip(c) for c in node["c"]]}


def extract(html: str | None, wrapper: dict | None) -> str:
    """The blocks of the main text, joined by an empty line."""
    if not html:
        return ""
    tree = parse(html)
    blocks: list[str] = []
    if wrapper is not None:
        flow(tree, wrapper, blocks)
        if not blocks and wrapper["n"] > 1:  # all that varies has a name of boilerplate
            flow(tree, wrapper, blocks, False)
    if not blocks:  # no wrapper, or all is template: the articles; a page without any is judged by its names where too few pages speak
        few = wrapper is None or wrapper["n"] < 3
        for article in found(tree) or [tree] * few:
            flow(article, None, blocks)
    return "\n\n".join(blocks)


def found(node: Node) -> list[Node]:
    """The outermost articles (or main elements) that are in no boilerplate."""
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        for c in reversed(n.children):
            if not isinstance(c, str) and not c.boiler:
                stack.append(c)
        if n is not node and n.tag in CONTENT:
            out.append(n)
            del stack[len(stack) - sum(not isinstance(c, str) and not c.boiler for c in n.children) :]
    return out


def flow(node: Node, wrapper: dict | None, blocks: list[str], names: bool = True) -> None:
    """Append the blocks of a subtree; template nodes of the wrapper and boilerplate (with ``names`` also by name) are left out.

    A constant inline node is template only where no letter or digit of its block varies: a word in
    bold that every page has is part of its sentence, a row of constant links is not text.
    """
    held: list[tuple[str, bool]] = []
    lone = not found(node)  # an article may be inside of what a name calls boilerplate
    often = set() if wrapper is None or lone else wrapper.get("often", set())
    by = Matching()

    def flush() -> None:
        slots = [t for t, constant in held if not constant]
        kept = [t for t, _ in held] if WORD.search(unescape("".join(slots))) else slots
        text = SPACE.sub(" ", unescape("".join(kept))).strip()
        held.clear()
        if text:
            blocks.append(text)

    def walk(n: Node, w: dict | None, constant: bool, inside: bool) -> None:
        inside = inside or n.tag in CONTENT or w is not None and w["r"]
        partner: dict[int, dict] = {}
        if w is not None and w["c"]:
            for i, j in by.aligned(w, n):
                if i is not None and j is not None:
                    for member in n.groups[j][1]:
                        partner[id(member)] = w["c"][i]
        for c in n.children:
            if isinstance(c, str):
                held.append((c, constant))
                continue
            if c.tag == "br":
                held.append((" ", constant))
            mate = partner.get(id(c))
            same = mate is not None and mate["k"] > inside and mate["s"] == list(c.mark)
            named = c.boiler and names and not (mate is not None and mate["o"])
            boiler = c.hard or named and (same if inside else not (lone and c.content)) or not inside and c.mark[0] in often and c.tag in BLOCK
            if boiler or same and c.tag in BLOCK:
                if c.tag in BLOCK:
                    flush()
                continue
            if c.tag in BLOCK:
                flush()
                walk(c, mate, False, inside)
                flush()
            else:
                walk(c, mate, constant or same, inside)

    walk(node, wrapper, False, False)
    flush()


def host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))


def wrappers(pages: DataFrame, settings: Settings) -> DataFrame:
    """(host, wrapper as JSON) from a bounded sample of each host's pages (host, html), one of each hash class."""
    hashed = pages.where("html is not null and html <> ''").withColumn("h", F.xxhash64("html"))
    drawn = written(hashed.groupBy("host", F.pmod("h", F.lit(settings.sample)).alias("slot")).agg(F.min("h").alias("h")).select("host", "h"))
    small = drawn.count() <= settings.broadcast_rows
    sample = hashed.join(F.broadcast(drawn) if small else drawn, ["host", "h"], "left_semi").dropDuplicates(["host", "h"])

    def run(key, t):
        rows = sorted(zip(t.column("h").to_pylist(), t.column("html").to_pylist(), strict=True))
        return pa.table({"host": [key[0].as_py()], "wrapper": [json.dumps(induce([html for _, html in rows], settings), separators=(",", ":"))]})

    return sample.select("host", "h", "html").groupBy("host").applyInArrow(run, "host string, wrapper string")


def beside(html: str) -> set[int]:
    """The hashes of the blocks of a page with an article that are outside of it, hold text, and hold no block themselves."""
    tree = parse(html)
    out: set[int] = set()
    if not found(tree):
        return out
    stack = [tree]
    while stack:
        inner = [c for c in stack.pop().children if not isinstance(c, str) and not c.hard and c.tag not in CONTENT]
        for c in inner:
            if c.tag in BLOCK and c.mark[1] and not holds_block(c):
                out.add(c.mark[0])
            else:
                stack.append(c)
    return out


def holds_block(node: Node) -> bool:
    return any(not isinstance(c, str) and (c.tag in BLOCK or holds_block(c)) for c in node.children)


def repeated_blocks(pages: DataFrame, settings: Settings) -> DataFrame:
    """(host, often): the blocks beside articles that many different pages of a host (host, html) have.

    As each is on a share of the host's pages, a host's list is no longer than the blocks of a page divided by that share.
    """
    hashed = pages.where("html is not null and html <> ''").select("host", F.xxhash64("html").alias("page"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                found_ = [sorted(beside(html)) for html in part.column(2).to_pylist()]
                of = pa.array([i for i, x in enumerate(found_) for _ in x], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), pa.array([h for x in found_ for h in x], pa.int64())], names=["host", "page", "block"])

    rows = hashed.mapInArrow(run, "host string, page long, block long")
    counts = rows.groupBy("host", "block").agg(F.countDistinct("page").alias("n")).where(F.col("n") >= settings.often_pages)
    sizes = hashed.groupBy("host").agg(F.countDistinct("page").alias("of"))
    return counts.join(sizes, "host").where(F.col("n") >= settings.often * F.col("of")).groupBy("host").agg(F.sort_array(F.collect_list("block")).alias("often"))


def main_text(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Add ``text`` and ``n_chars`` to ``pages`` (url, html, other columns): the main text of each page.

    A null or empty page has the empty text. Pages without a host share one wrapper. Other columns,
    but for text and n_chars, stay as they are; repeated rows give equal texts.
    """
    base = pages.drop("text", "n_chars", "__host", "__wrapper").withColumn("__host", host(F.col("url")))
    of_host = base.select(F.col("__host").alias("host"), "html")
    learned = wrappers(of_host, settings).join(repeated_blocks(of_host, settings), "host", "left")
    often = F.concat(F.expr("substring(wrapper, 1, length(wrapper) - 1)"), F.lit(',"often":['), F.array_join(F.coalesce(F.col("often"), F.array().cast("array<bigint>")).cast("array<string>"), ","), F.lit("]}"))
    made = written(learned.select("host", often.alias("wrapper")))
    size = made.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    known = made.select(F.col("host").alias("__host"), F.col("wrapper").alias("__wrapper"))
    if size <= settings.broadcast_bytes:
        both = base.join(F.broadcast(known), "__host", "left")
    else:  # a hot host is spread over 64 salted keys
        salt = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("__salt")
        both = base.withColumn("__salt", F.pmod(F.xxhash64("html", "url"), F.lit(64)).cast("int")).join(known.select("*", salt), ["__host", "__salt"], "left").drop("__salt")
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    both = both.select(*kept, "__wrapper")
    schema = both.drop("__wrapper").withColumns({"text": F.lit("").cast("string"), "n_chars": F.lit(0).cast("bigint")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = Bounded(loaded, 2_000)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                html = part.column(part.schema.get_field_index("html")).to_pylist()
                own = part.column(part.num_columns - 1).to_pylist()
                texts = [extract(h, load[w] if w else None) for h, w in zip(html, own, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*part.schema.names[:-1], "text", "n_chars"])

    return both.mapInArrow(run, schema)


def loaded(text: str) -> dict:
    wrapper = json.loads(text)
    return wrapper | {"often": set(wrapper["often"])}


def op4_html_wrapper(spark, sf_dir: str) -> DataFrame:
    """The main text of every page; null and empty pages have the empty text, an empty table stays empty."""
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
