"""HTML extraction by union-free wrappers.

The pages of a host are aligned one after the other with the host's wrapper, a regular expression
without unions over elements and text: a run of like siblings (or of like groups of siblings) becomes
a repeated part, what only one side has becomes an optional part, and text becomes a slot. Wrappers of
one host merge in steps, so that no task gets more than FAN of them. Then every page is matched by
position against its host's expression: a slot that holds one text on nearly all unlike pages is
furniture, and so is one in an optional part that holds one text wherever it occurs; slots whose text
varies are content. The page's text is what it holds in content slots.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections import Counter, deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, stash, table
from .url_filters import host_of

#: Characters of all wrappers up to which they are broadcast; beyond, pages and wrappers are joined by host.
BROADCAST_CHARS = 8_000_000
#: Hosts that a task holds before it hands on what it has of them.
HELD_HOSTS = 5_000
#: Wrappers of one host that are merged in one group.
FAN = 64
#: A text is furniture on so many unlike pages at least that make up this share of the host's pages,
#: in an optional part this smaller share.
SHARED_PAGES, SHARED_PERCENT, OPTIONAL_PERCENT = 3, 90, 10
#: A page that keeps less than one in so many characters beside its constants is a near copy of the host's others.
NEAR_COPY = 10
#: Rows of an output batch.
BATCH_ROWS = 512
#: Parts of a sequence beyond which it is irregular: one repeated group of optional parts.
IRREGULAR = 32

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "xmp")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
#: An element that these open ends an open element of the named kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that aren't the article's text, by name and by a word of their class, id or role.
FURNITURE = frozenset("nav header footer aside form head script style noscript iframe template svg button select textarea menu dialog title label xmp canvas object".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert advertisement adverts banner banners breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies "
    "disqus footer form gdpr header login menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo promoted promotion "
    "related replies search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
ARTICLE = frozenset(["article", "main"])
#: Elements that hold the whole page, whose words say nothing of its parts.
PLAIN = frozenset(["html", "body"])
#: Elements that hold text rather than furniture: only a name of a class, id or role all of whose words say so counts
#: there ("comment-12" or "ad-banner", not "has-comments"), and the header of headings is a headline.
TEXTUAL = frozenset(["article", "main", "h1", "h2", "h3", "p"])

#: Elements of any content: siblings are told apart by their class or id, or else by the block that they begin with.
CONTAINERS = frozenset("div section ul ol dl table td th li dd figure fieldset details".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)|[^<]+|<", re.S)
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
ATTRIBUTE = re.compile(r"(?:^|[\s/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[^a-z0-9]+")
NUMBERED = re.compile(r"[-_]?[0-9]+$")
NAME = re.compile(r"[^.|>]*")


def _key(tag: str, rest: str) -> str:
    """The element's name, ``.`` and the class, id or role that marks it as furniture, ``|`` and a container's class or id."""
    if tag in PLAIN or not rest:
        return tag
    given = {name.lower(): "".join(values).lower() for name, *values in reversed(ATTRIBUTE.findall(rest))}
    found: list[str] = []
    for value in given.values():
        if tag in TEXTUAL:
            names = [WORD.split(NUMBERED.sub("", v)) for v in value.split()]
            found += [name[0] for name in names if name != ["header"] and FURNITURE_WORDS.issuperset(name)]
        else:
            found += [w for w in WORD.split(value) if w in FURNITURE_WORDS]
    named = (given.get("class") or given.get("id") or "").split()[:1] if tag in CONTAINERS else []
    return tag + "".join(f".{w}" for w in found[:1]) + "".join(f"|{NUMBERED.sub('', w)}" for w in named)


def _tag(key: str) -> str:
    return NAME.match(key).group(0)


@lru_cache(maxsize=100_000)
def _furniture(key: str) -> bool:
    """Whether an element is furniture by its name or words."""
    return "." in key.partition("|")[0] or _tag(key) in FURNITURE


# ---- pages


def events(page: str) -> Iterator[tuple[str, str]]:
    """("open", key), ("close", key) and ("text", raw text) with implied ends."""
    open_: list[tuple[str, str]] = []  # name, key
    opened: Counter[str] = Counter()

    def ended() -> tuple[str, str]:
        name, key = open_.pop()
        opened[name] -= 1
        return "close", key

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m.group(2)
        if tag is None:
            got = m.group(0)
            if got[0] != "<" or got == "<":
                yield "text", got
            continue
        tag = tag.lower()
        if m.group(1):
            if opened[tag]:
                while open_[-1][0] != tag:
                    yield ended()
                yield ended()
            continue
        ends = ENDS.get(tag) or ({"p"} if tag in BLOCKS else None)
        if ends and any(opened[e] for e in ends):
            # up to the nearest block: what it holds may have such an element open
            for i in range(len(open_) - 1, -1, -1):
                name = open_[i][0]
                if name in ends:
                    while len(open_) > i:
                        yield ended()
                    break
                if name in BLOCKS and not (name in ("td", "th") and tag == "tr"):
                    break
        key = _key(tag, m.group(3))
        if tag in VOID or m.group(3).rstrip().endswith("/") and tag in RAW:
            yield from (("open", key), ("close", key))
        elif tag in RAW:
            stop = RAW_END[tag].search(page, at)
            at = stop.end() if stop else end
            yield from (("open", key), ("close", key))
        else:
            open_.append((tag, key))
            opened[tag] += 1
            yield "open", key
    while open_:
        yield ended()


#: An element: its key and its children, in which a text is a string.
Element = tuple[str, list]


def tree(page: str) -> Element:
    """The page as one element; neighbouring texts are one."""
    stack: list[Element] = [("", [])]
    for kind, what in events(page):
        children = stack[-1][1]
        if kind == "open":
            child = (what, [])
            children.append(child)
            stack.append(child)
        elif kind == "close":
            stack.pop()
        elif children and isinstance(children[-1], str):
            children[-1] += what
        else:
            children.append(what)
    return stack[0]


def symbol(element: Element) -> str:
    """The element as a symbol of an expression."""
    key, children = element
    if "|" not in key and _tag(key) in CONTAINERS:
        for c in children:
            if not isinstance(c, str) and _tag(c[0]) in BLOCKS:
                return f"{key}>{_tag(c[0])}"
    return key


def keys_of(element: Element) -> tuple[str, ...]:
    """The children as symbols, "#" for a text; blank texts are none."""
    return tuple("#" if isinstance(c, str) else symbol(c) for c in element[1] if not isinstance(c, str) or c.strip())


# ---- wrappers


class Node:
    """A part of a wrapper: an element, a text slot ("#"), a group of siblings ("()") or an irregular sequence,
    a repeated group of optional parts ("*")."""

    __slots__ = ("key", "matches", "optional", "parts", "positions", "repeated", "shape")

    def __init__(self, key: str, parts: list[Node] | None = None, optional: bool = False, repeated: bool = False):
        self.key, self.parts, self.optional, self.repeated = key, parts or [], optional, repeated
        self.shape = f"({' '.join(p.shape for p in self.parts)})" if key == "()" else key
        self.positions: tuple | None = None
        self.matches: dict[tuple[str, ...], list[Node | None]] = {}

    def __str__(self) -> str:
        inner = " ".join(map(str, self.parts))
        text = "#" if self.key == "#" else f"({inner})" if self.key in ("()", "*") else f"<{self.key.partition('>')[0]}>{inner}"
        return f"({text})*" if self.repeated and self.optional else f"({text})+" if self.repeated else f"({text})?" if self.optional else text


#: Pairs of nodes of one shape; the second is to be merged into the first.
Pending = deque[tuple[Node, Node]]


def folded(parts: list[Node], pending: Pending, shapes: frozenset[str] = frozenset()) -> list[Node]:
    """Runs of like siblings, and of like groups of siblings, as repeated parts; groups of the given shapes
    also where they occur once; an irregular sequence as one group of optional parts."""
    out: list[Node] = []
    for p in parts:
        if out and out[-1].shape == p.shape:
            pending.append((out[-1], p))
            out[-1].repeated = True
        else:
            out.append(p)
    size = 2
    while size <= min(IRREGULAR, len(out)) and (2 * size <= len(out) or shapes):
        names = [p.shape for p in out]
        done, i = [], 0
        while i < len(out):
            unit = names[i : i + size]
            known = bool(shapes) and f"({' '.join(unit)})" in shapes
            if len(unit) == size and (known or names[i + size : i + 2 * size] == unit):
                group = Node("()", out[i : i + size], repeated=not known)
                i += size
                while names[i : i + size] == unit:
                    pending.append((group, Node("()", out[i : i + size])))
                    group.repeated = True
                    i += size
                done.append(group)
            else:
                done.append(out[i])
                i += 1
        out = done
        size += 1
    return [_irregular(out, pending)] if len(out) > IRREGULAR else out


def _irregular(parts: list[Node], pending: Pending) -> Node:
    """The least repeated group of optional parts that holds the sequence."""
    kinds: dict[str, Node] = {}
    todo = deque(parts)
    while todo:
        p = todo.popleft()
        if p.key in ("()", "*"):
            todo.extendleft(reversed(p.parts))
        elif p.shape in kinds:
            pending.append((kinds[p.shape], p))
            kinds[p.shape].repeated |= p.repeated
        else:
            p.optional = True
            kinds[p.shape] = p
    return Node("*", list(kinds.values()), repeated=True)


@lru_cache(maxsize=20_000)
def _alignment(x: tuple[str, ...], y: tuple[str, ...]) -> tuple[tuple[int, int], ...]:
    """A longest common subsequence of two short sequences: pairs of places, -1 for what one side lacks."""
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif j == len(y) or i < len(x) and best[i + 1][j] >= best[i][j + 1]:
            out.append((i, -1))
            i += 1
        else:
            out.append((-1, j))
            j += 1
    return tuple(out)


def aligned(a: list[Node], b: list[Node], pending: Pending) -> list[Node]:
    """Aligns two sequences; what only one has becomes optional."""
    if any(p.key == "*" for p in a) or any(p.key == "*" for p in b):
        return [_irregular([*a, *b], pending)] if a and b else [_as_optional(p) for p in a or b]
    groups = frozenset(p.shape for p in (*a, *b) if p.key == "()")
    if groups:
        a, b = folded(a, pending, groups), folded(b, pending, groups)
        if any(p.key == "*" for p in (*a, *b)):
            return [_irregular([*a, *b], pending)]
    x, y = tuple(p.shape for p in a), tuple(p.shape for p in b)
    if x == y:
        pending.extend(zip(a, b, strict=True))
        return a
    out = []
    for i, j in _alignment(x, y):
        if i >= 0 and j >= 0:
            pending.append((a[i], b[j]))
            out.append(a[i])
        else:
            out.append(_as_optional(a[i] if i >= 0 else b[j]))
    return folded(out, pending)


def _as_optional(p: Node) -> Node:
    p.optional = True
    return p


def merge(pending: Pending) -> None:
    """Merges pairs and what they hold, in the order in which they were put."""
    while pending:
        a, b = pending.popleft()
        a.optional |= b.optional
        a.repeated |= b.repeated
        a.parts = aligned(a.parts, b.parts, pending)


def expression(page: Element) -> Node:
    """A page as an expression of its own."""
    root = Node("")
    stack = [(page, root, iter(page[1]))]
    while stack:
        element, node, rest = stack[-1]
        for child in rest:
            if not isinstance(child, str):
                below = Node(symbol(child))
                node.parts.append(below)
                stack.append((child, below, iter(child[1])))
                break
            if child.strip():
                node.parts.append(Node("#"))
        else:
            stack.pop()
            pending: Pending = deque()
            node.parts = folded(node.parts, pending)
            merge(pending)
    return root


def dump(root: Node) -> str:
    """The expression in preorder: key, marks and number of parts of each node."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out += [n.key, int(n.optional) + 2 * int(n.repeated), len(n.parts)]
        stack.extend(reversed(n.parts))
    return json.dumps(out, separators=(",", ":"))


def load(text: str) -> tuple[Node, list[Node]]:
    """The expression's root and all its nodes in preorder."""
    flat, nodes = json.loads(text), []
    stack: list[tuple[Node, int]] = []
    for k in range(0, len(flat), 3):
        node = Node(flat[k], None, bool(flat[k + 1] & 1), bool(flat[k + 1] & 2))
        nodes.append(node)
        if stack:
            stack[-1][0].parts.append(node)
            stack[-1] = (stack[-1][0], stack[-1][1] - 1)
        stack.append((node, flat[k + 2]))
        while stack and not stack[-1][1]:
            done, _ = stack.pop()
            if done.key == "()":
                done.shape = f"({' '.join(p.shape for p in done.parts)})"
    return nodes[0], nodes


class Wrapper:
    """A host's expression."""

    def __init__(self, root: Node | None = None):
        self.root = root
        self._seen: set[int] = set()

    def add(self, root: Node) -> None:
        if self.root is None:
            self.root = root
        else:
            merge(deque([(self.root, root)]))

    def add_page(self, page: Element) -> None:
        """Pages of a structure that has been seen add nothing."""
        shape, stack = 0, [page]
        while stack:
            e = stack.pop()
            below = keys_of(e)
            shape = zlib.crc32(" ".join((e[0], *below, ">")).encode("utf-8", "surrogatepass"), shape)
            stack.extend(c for c in e[1] if not isinstance(c, str))
        if shape not in self._seen:
            self._seen.add(shape)
            self.add(expression(page))


# ---- pages matched against their host's expression


def _compiled(node: Node) -> tuple[list[Node], list[int], list[list[int]]]:
    """The expression of the node's children as an automaton: its positions, the first ones and those that follow each."""
    if node.positions is None:
        found: list[Node] = []
        follow: list[dict[int, None]] = []

        def sequence(parts: list[Node], each_optional: bool = False) -> tuple[list[int], list[int], bool]:
            first, last, empty = [], [], True
            for p in parts:
                if p.key in ("()", "*"):
                    f, ends, none = sequence(p.parts, p.key == "*")
                else:
                    f = ends = [len(found)]
                    none = False
                    found.append(p)
                    follow.append({})
                if p.repeated:
                    for q in ends:
                        follow[q].update(dict.fromkeys(f))
                none |= p.optional or each_optional
                for q in last:
                    follow[q].update(dict.fromkeys(f))
                first, last, empty = first + f if empty else first, last + ends if none else ends, empty and none
            return first, last, empty

        start, _, _ = sequence(node.parts)
        node.positions = (found, start, [list(f) for f in follow])
    return node.positions


def matched(node: Node, keys: tuple[str, ...]) -> list[Node | None]:
    """The parts of the node's expression that its children are; None for what the expression doesn't have there."""
    if keys in node.matches:
        return node.matches[keys]
    found, start, follow = _compiled(node)
    layers: list[dict[int, int]] = []
    last: dict[int, int] | None = None
    for key in keys:
        layer: dict[int, int] = {}
        for q in [-1] if last is None else sorted(last):
            for r in start if q < 0 else follow[q]:
                if r not in layer and found[r].key == key:
                    layer[r] = q
        layers.append(layer)
        last = layer or last
    out: list[Node | None] = [None] * len(keys)
    at = None
    for i in range(len(keys) - 1, -1, -1):
        if layers[i]:
            at = min(layers[i]) if at is None or at not in layers[i] else at
            out[i] = found[at]
            at = layers[i][at]
    if len(node.matches) < 1000:
        node.matches[keys] = out
    return out


def walk(page: Element, root: Node | None, text: Callable[[str, Node | None, str], None], edge: Callable[[str, bool], None] | None = None) -> None:
    """Goes through a page in its order: ``text`` gets each text with its slot and role by the names of the elements
    around it (article, other or furniture), ``edge`` the key of each element that begins (True) or ends."""
    todo: list[tuple] = [(page, root, "other")]
    while todo:
        what, node, role = todo.pop()
        if isinstance(what, str):
            text(what, node, role)
        elif node is _END:
            edge(what[0], False)
        else:
            key, children = what
            if edge and key:
                edge(key, True)
                todo.append((what, _END, role))
            inner = "furniture" if role == "furniture" or _furniture(key) else "article" if key in ARTICLE else role
            parts = iter(matched(node, keys_of(what)) if node else ())
            below = [(c, next(parts, None) if not isinstance(c, str) or c.strip() else None, inner) for c in children]
            todo.extend(reversed(below))


_END = Node("end")


def evidence(page: Element, root: Node, numbers: dict[int, int]) -> tuple[dict[int, int], int, int]:
    """A checksum of what the page holds in each slot outside furniture, a number for all of it, by which copies of a
    page are told from unlike pages, and one for its longest text, by which near copies are."""
    marks: dict[int, int] = {}
    longest = ""

    def text(what: str, slot: Node | None, role: str) -> None:
        nonlocal longest
        what = what.strip()
        if role != "furniture" and slot is not None:
            k = numbers[id(slot)]
            marks[k] = zlib.crc32(what.encode("utf-8", "surrogatepass"), marks.get(k, 0))
            if len(what) > len(longest):
                longest = what

    walk(page, root, text)
    return marks, sum(marks.values()), zlib.crc32(longest.encode("utf-8", "surrogatepass"))


def constant_slots(root: Node, nodes: list[Node], pages: int, shared: dict[int, int], alike: frozenset[int] = frozenset()) -> set[int]:
    """ids of the slots that are furniture; ``shared``: the pages of each slot that holds one text on unlike pages,
    ``alike``: those of them whose pages may be near copies, which is no evidence in an optional part.

    A block's own slots, with those of the inline elements in it, are furniture only all together.
    """
    number = {id(n): k for k, n in enumerate(nodes)}
    out: set[int] = set()
    todo = [(root, False)]
    of_block: dict[int, list[tuple[Node, bool]]] = {}
    while todo:  # every node with the number of the block that it is part of
        node, optional = todo.pop()
        blocks = [(node, optional, number[id(node)])]
        while blocks:
            n, opt, block = blocks.pop()
            for p in n.parts:
                inner = opt or p.optional
                if p.key == "#":
                    of_block.setdefault(block, []).append((p, inner))
                elif p.key in ("()", "*") or _tag(p.key) not in BLOCKS:
                    blocks.append((p, inner, block))
                else:
                    todo.append((p, inner))
    for slots in of_block.values():
        least = lambda s, opt: (OPTIONAL_PERCENT if opt and number[id(s)] not in alike else SHARED_PERCENT) * pages
        if all(number[id(s)] in shared and 100 * shared[number[id(s)]] >= least(s, opt) for s, opt in slots):
            out |= {id(s) for s, _ in slots}
    return out


def page_text(page: Element, root: Node | None, constant: set[int], constants: bool = False) -> str:
    """The page's text in content slots: the article's where the page has one, else all but furniture.

    Constants are left out unless hardly anything else is left, as on near copies, or they are asked for.
    """
    found: dict[str, list[list[str]]] = {"article": [[]], "other": [[]]}
    left_out, of_article = 0, False

    def text(what: str, slot: Node | None, role: str) -> None:
        nonlocal left_out, of_article
        if role != "furniture" and id(slot) in constant and not constants:
            left_out += len(what)
            of_article |= role == "article"
        elif role != "furniture":
            found[role][-1].append(what)

    def edge(key: str, begins: bool) -> None:
        tag = _tag(key)
        if tag in BLOCKS:
            for blocks in found.values():
                if blocks[-1]:
                    blocks.append([])
        elif tag == "br" and begins:
            for blocks in found.values():
                if blocks[-1]:
                    blocks[-1].append(" ")

    walk(page, root, text, edge)
    lines = {r: [t for t in (" ".join(entities.unescape("".join(b)).split()) for b in blocks) if t] for r, blocks in found.items()}
    out = "\n".join(lines["article"] or lines["other"])
    again = NEAR_COPY * len(out) < left_out or of_article and not lines["article"]
    return page_text(page, root, constant, True) if again else out


# ---- tables


def _merged(rows: DataFrame, salt: Column) -> DataFrame:
    """Wrappers (host, part, wrapper) of one host and salt as one."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        whole = Wrapper()
        for w in sorted(rows["wrapper"]):
            whole.add(load(w)[0])
        return pd.DataFrame({"host": [key[0]], "part": [key[1]], "wrapper": [dump(whole.root)]})

    return rows.groupBy("host", salt.alias("salt")).applyInPandas(run, "host string, part long, wrapper string")


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host and wrapper (JSON) from every page (host, html)."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Wrapper] = {}

        def handed() -> pa.RecordBatch:
            texts = [dump(w.root) for w in held.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(texts, pa.string())], names=["host", "wrapper"])

        for batch in batches:
            for host, page in zip(batch.column(0), batch.column(1), strict=True):
                held.setdefault(host.as_py(), Wrapper()).add_page(tree(page.as_py() or ""))
            if len(held) > HELD_HOSTS:
                yield handed()
                held.clear()
        yield handed()

    partial = pages.select("host", "html").mapInArrow(fold, "host string, wrapper string")
    # equal expressions of one host are one
    rows = stash(partial.withColumn("part", F.spark_partition_id().cast("long")).groupBy("host", "wrapper").agg(F.min("part").alias("part")))
    while True:
        most = rows.groupBy("host").count().agg(F.max("count").alias("n")).first()["n"] or 0
        if most <= FAN:
            return _merged(rows, F.lit(0).cast("long")).select("host", "wrapper")
        rows = stash(_merged(rows, F.pmod(F.xxhash64("part", "wrapper"), F.lit(-(-most // FAN)))))


def _joined(pages: DataFrame, wrappers: DataFrame, columns: list[Column]) -> DataFrame:
    """``columns`` of pages and wrappers of one host."""
    size = wrappers.agg(F.sum(F.length("wrapper")).alias("n")).first()["n"] or 0
    right = wrappers.withColumnRenamed("host", "of_host")
    return pages.join(F.broadcast(right) if size <= BROADCAST_CHARS else right, F.col("host") == F.col("of_host"), "left").select(columns)


def count_evidence(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """host, pages and shared (slot, its pages and whether these may be near copies, where it holds one text on unlike
    pages) of every host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, list[int]]] = {}
        known: dict[str, tuple] = {}

        def handed() -> pa.RecordBatch:
            rows = [(h, k, *v) for h, slots in held.items() for k, v in slots.items()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = (pa.string(), *[pa.int64()] * 6)
            names = ["host", "slot", "n", "low", "high", "unlike", "apart"]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)

        for batch in batches:
            for host, page, wrapper in zip(*(batch.column(i) for i in range(3)), strict=True):
                host, w = host.as_py(), wrapper.as_py()
                if host not in known:
                    root, nodes = load(w)
                    known[host] = (root, {id(n): k for k, n in enumerate(nodes)}, nodes)
                marks, whole, longest = evidence(tree(page.as_py() or ""), *known[host][:2])
                slots = held.setdefault(host, {-1: [0, 0, 0, 0, 0]})
                slots[-1][0] += 1
                for k, mark in marks.items():
                    x = slots.setdefault(k, [0, mark, mark, 0, 0])
                    x[0] += 1
                    x[1], x[2] = min(x[1], mark), max(x[2], mark)
                    x[3], x[4] = x[3] | 1 << whole % 63, x[4] | 1 << longest % 63
            if len(held) > HELD_HOSTS:
                yield handed()
                held.clear()
                known.clear()
        yield handed()

    rows = pages.mapInArrow(run, "host string, slot long, n long, low long, high long, unlike long, apart long")
    merged = (F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.bit_or("unlike").alias("unlike"), F.bit_or("apart").alias("apart"))
    slots = rows.groupBy("host", "slot").agg(*merged)
    near = (F.bit_count("apart") < SHARED_PAGES).cast("long")
    one = (F.col("slot") >= 0) & (F.col("low") == F.col("high")) & (F.bit_count("unlike") >= SHARED_PAGES)
    return slots.groupBy("host").agg(
        F.max(F.when(F.col("slot") < 0, F.col("n"))).alias("pages"),
        F.to_json(F.collect_list(F.when(one, F.array(F.col("slot"), F.col("n"), near)))).alias("shared"),  # a host's expression bounds it
    )


def extract_text(pages: DataFrame) -> DataFrame:
    """Adds text and n_chars (code points) to every page (url, html).

    Null and empty html give an empty text; a null or odd url belongs to the host "". Pages of any length and
    depth are read whole; repeated rows are extracted one by one, and copies of a page are no evidence that its
    text is furniture; an empty table gives an empty result; further columns of any name pass through (those
    named text and n_chars are replaced). A line break inside a block is white space.
    """
    bounded_batches(pages.sparkSession)
    kept = pages.drop("text", "n_chars")
    rows = kept.select(F.struct(*kept.columns).alias("page"), host_of(kept["url"]).alias("host"), kept["html"].alias("html"))
    wrappers = stash(infer_wrappers(rows))
    counted = count_evidence(_joined(rows, wrappers, [F.col("host"), F.col("html"), F.col("wrapper")]), wrappers)
    judged = stash(wrappers.join(counted, "host", "left"))
    joined = _joined(rows, judged, [F.col("page"), F.col("host"), F.col("wrapper"), F.col("pages"), F.col("shared")])
    names = kept.columns
    at = names.index("html")
    spec = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), "text string", "n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[Node | None, set[int]]] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(start, BATCH_ROWS)
                fields, texts = batch.column(0).flatten(), []
                for page, host, wrapper, n, shared in zip(fields[at], *(batch.column(i) for i in range(1, 5)), strict=True):
                    host = host.as_py()
                    if host not in known:
                        if len(known) >= HELD_HOSTS:
                            known.clear()
                        root, nodes = load(wrapper.as_py())
                        found = json.loads(shared.as_py() or "[]")
                        alike = frozenset(k for k, _, near in found if near)
                        known[host] = (root, constant_slots(root, nodes, n.as_py() or 0, {k: m for k, m, _ in found}, alike))
                    texts.append(page_text(tree(page.as_py() or ""), *known[host]))
                added = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*fields, *added], names=[*names, "text", "n_chars"])

    return joined.mapInArrow(run, spec)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: one row per page."""
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
