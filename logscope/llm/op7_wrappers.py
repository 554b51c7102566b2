"""Main text of web pages through wrappers inferred per host.

A wrapper is a union-free regular expression over a host's pages: a nesting of labels (tag
and class) in which a mismatch between pages is resolved into an optional group (?), a
repeated group (+), or, where only the text differs, a text slot.  Pages are parsed once;
their token streams, with repeats already folded, are pre-aggregated per host, aligned
with each other in salted groups, and the partial wrappers are aligned per host, so a host with
a third of all pages never meets in one task.  Each page's texts are then matched to the
wrapper's slots, and the slots of the main content are read out in page order.

Slots are main content when they lie in an article (or main) element, outside menus, headers of
the site, footers, sidebars, notices, adverts, forms and reader comments, which are told by tag
or by a word of the class or id.  Each page is judged for itself: where it has no text in an
article or main element, its texts outside such elements count that are not mostly links and
not the template's, which is short text that ``TEMPLATE_PAGES`` distinct pages of the host or
more have in one place, and no page has otherwise.

Very long and very deep pages are read whole: what lies deeper than ``DEPTH`` elements is laid
flat.  Nulls: a null or empty html gives an empty text; a null url is a host of its own.  Repeated
rows are extracted alike.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscope.llm.common import table

#: Most characters of wrappers that are broadcast.
BROADCAST_CHARS = 32_000_000
SALTS = 16
#: Levels of nesting; elements below are laid flat, as browsers do, and keep all their text.
DEPTH = 250
#: Distinct pages that must agree before a text is taken for the template's.
TEMPLATE_PAGES = 5
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea)(?=[\s/>]).*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>", re.S | re.I)
CLASS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# Elements of HTML by role.
#: Left out up to their end tag; without one, or closed in themselves, they are empty.
HIDDEN = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("noscript", "template", "svg", "iframe", "math")}
SELF_CLOSED = frozenset(("svg", "math"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BLOCKS_END_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
DROPPED = frozenset("head nav footer aside form menu dialog button select option script style noscript template textarea svg iframe".split())
DROPPED_WORDS = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|sponsor(?:ed)?|promo|sidebar|nav|navbar|navigation|menu|breadcrumbs?|footer|cookies?|consent|notice|popup|modal|newsletter|subscribe|share|sharing|social|related|comments?|disqus|respond|replies)(?:$|[\s_-])", re.I)
SITE_HEADER = "header"


class Node:
    """An element of a page, or of a wrapper with a quantifier; ``pages`` counts the pages
    that have a text."""

    __slots__ = ("kids", "label", "pages", "quant", "text")

    def __init__(self, label: str, quant: str = "", text: str | None = None):
        self.label, self.quant, self.text, self.kids, self.pages = label, quant, text, [], 1

    def dump(self) -> list:
        return [self.label, self.quant, self.text, [k.dump() for k in self.kids], *([self.pages] if self.pages > 1 else [])]

    @classmethod
    def load(cls, raw: list, times: int = 1) -> Node:
        node = cls(*raw[:3])
        node.kids = [cls.load(k, times) for k in raw[3]]
        node.pages = times * (raw[4] if len(raw) > 4 else 1)
        return node


def parse(page: str | None) -> tuple[Node, list[tuple[str, str, int]]]:
    """The page's element tree, and its blocks (path of labels, text, characters in links).

    Text is cut into blocks at block elements; inline elements and line breaks stay inside.
    """
    root = Node("")
    stack, blocks, held, linked = [root], [], [], 0
    over: list[tuple[str, bool]] = []  # open elements below the limit, and whether each is dropped
    among, hidden = Counter(), 0  # their tags, and how many are dropped
    page, at = page or "", 0

    def flush() -> None:
        nonlocal linked
        raw = "".join(held)
        held.clear()
        text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
        if text and not hidden:
            leaf = Node("#", text=text)
            stack[-1].kids.append(leaf)
            blocks.append(("/".join(n.label for n in stack[1:]), text, linked))
        linked = 0

    in_link, no_end = False, set()
    while m := TOKEN.search(page, at):
        if m.start() > at:
            held.append(page[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        tag = m.group(3)
        if not tag:
            if m.group(1):
                held.append(" ")
            continue
        tag, closing = tag.lower(), bool(m.group(2))
        if tag in HIDDEN:
            held.append(" ")
            if not closing and tag not in no_end and not (tag in SELF_CLOSED and m.group(4).endswith("/")):
                end = HIDDEN[tag].search(page, at)
                if end:
                    at = end.end()
                else:
                    no_end.add(tag)
            continue
        if tag in INLINE:
            in_link = not closing if tag == "a" else in_link
            if tag == "br":
                held.append(" ")
            continue
        flush()
        if closing and over:
            if not among[tag] and not any(n.label.partition(".")[0] == tag for n in stack[1:]):
                continue  # it ends nothing
            below = among[tag] > 0
            while over:
                last, out = over.pop()
                among[last] -= 1
                hidden -= out
                if below and last == tag:
                    break
            if below:
                continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].label.partition(".")[0] == tag:
                    del stack[k:]
                    break
            continue
        label = tag
        if m.group(4):
            named = ".".join(sorted({w.lower() for c in CLASS.findall(m.group(4)) for w in (c[1] or c[2] or c[3]).split() if not any(ch.isdigit() for ch in w)}))
            label = f"{tag}.{named}" if named else tag
        if len(stack) > DEPTH:
            if tag not in VOID:
                over.append((tag, dropped(label)))
                among[tag] += 1
                hidden += over[-1][1]
            continue
        ends = CLOSES.get(tag, ())
        top = stack[-1].label.partition(".")[0]
        if (tag in BLOCKS_END_P and top == "p") or top in ends:
            stack.pop()
            if ends and stack[-1].label.partition(".")[0] in ends:
                stack.pop()
        node = Node(label)
        stack[-1].kids.append(node)
        if tag not in VOID:
            stack.append(node)
    if at < len(page):
        held.append(page[at:])
    flush()
    return root, blocks


def fold(kids: list[Node]) -> list[Node]:
    """Neighbours with one label become one repeated node; runs of up to five labels that
    recur side by side become one run of repeated nodes."""
    out: list[Node] = []
    for k in kids:
        if out and out[-1].label == k.label:
            out[-1] = merged(out[-1], k)
            out[-1].quant = "+" if "?" not in out[-1].quant else "*"
        else:
            out.append(k)
    for size in range(2, 6):
        i = 0
        while i + 2 * size <= len(out):
            if [n.label for n in out[i : i + size]] == [n.label for n in out[i + size : i + 2 * size]]:
                for j in range(size):
                    out[i + j] = merged(out[i + j], out[i + size + j])
                    out[i + j].quant = "+"
                del out[i + size : i + 2 * size]
            else:
                i += 1
    return out


def folded(node: Node) -> Node:
    for k in node.kids:
        folded(k)
    node.kids = fold(node.kids)
    return node


def merged(a: Node, b: Node, across: bool = False) -> Node:
    """Two nodes of one label, of one page or ``across`` pages, as one: equal text stays, other
    text becomes a slot."""
    out = Node(a.label, "*" if {"*", "?"} & {a.quant, b.quant} and {"+", "*"} & {a.quant, b.quant} else a.quant or b.quant)
    if a.label == "#":
        out.text = a.text if a.text == b.text else None
        out.pages = a.pages + b.pages if across else max(a.pages, b.pages)
        return out
    out.kids = aligned(a.kids, b.kids, across)
    return out


def aligned(a: list[Node], b: list[Node], across: bool = False) -> list[Node]:
    """Align two sequences on their longest common labels; what only one has is optional."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i].label == b[j].label else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i].label == b[j].label:
            out.append(merged(a[i], b[j], across))
            i, j = i + 1, j + 1
        elif j >= m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append(_maybe(a[i]))
            i += 1
        else:
            out.append(_maybe(b[j]))
            j += 1
    return fold(out)


def _maybe(node: Node) -> Node:
    node.quant = {"": "?", "+": "*"}.get(node.quant, node.quant)
    return node


def expression(node: Node) -> str:
    """The wrapper in a readable form."""
    if node.label == "#":
        return ("#text" if node.text is None else json.dumps(node.text)) + node.quant
    inner = " ".join(expression(k) for k in node.kids)
    return f"<{node.label}>({inner}){node.quant}" if node.label else inner


@lru_cache(maxsize=10_000)
def dropped(label: str) -> bool:
    tag, _, named = label.partition(".")
    return tag in DROPPED or bool(named and DROPPED_WORDS.search(named.replace(".", " ")))


def content_paths(wrapper: Node) -> dict[str, int]:
    """Paths of the wrapper's texts: 0 dropped, 1 main content, 2 main content of pages that
    have none of 1, which mostly linked blocks don't belong to."""
    found: dict[str, int] = {}

    def walk(node: Node, path: list[str], inside: bool, out: bool) -> None:
        for k in node.kids:
            if k.label == "#":
                slot = k.text is None or k.pages < TEMPLATE_PAGES
                at = "/".join(path)
                found[at] = max(found.get(at, 0), 0 if out else 1 if inside else 2 * slot)
            else:
                tag = k.label.partition(".")[0]
                walk(k, [*path, k.label], inside or tag in ("article", "main"), out or dropped(k.label) or (tag == SITE_HEADER and not inside))

    walk(wrapper, [], False, False)
    return found


def main_text(blocks: list[dict], paths: dict[str, int]) -> str:
    """The main content of one page, in page order."""
    kinds = [paths.get(x["path"], 0) for x in blocks]
    if 1 in kinds:
        return "\n".join(x["text"] for x, k in zip(blocks, kinds, strict=True) if k == 1)
    return "\n".join(x["text"] for x, k in zip(blocks, kinds, strict=True) if k == 2 and x["linked"] * 2 <= len(x["text"]))


def wrappers(parsed: DataFrame) -> DataFrame:
    """host, wrapper (JSON): one row a host, from (host, skeleton, page)."""

    def align(t: pa.Table) -> str:
        whole = None
        for raw, pages in sorted(zip(t.column("skeleton").to_pylist(), t.column("pages").to_pylist(), strict=True)):
            node = Node.load(json.loads(raw), pages)
            whole = node if whole is None else merged(whole, node, True)
        return json.dumps(whole.dump(), ensure_ascii=False)

    def part(t: pa.Table) -> pa.Table:
        return pa.table({"host": [t.column("host")[0].as_py()], "skeleton": [align(t)], "pages": pa.array([1], pa.int64())})

    kind = "host string, skeleton string, pages long"
    named = parsed.select("host", F.xxhash64("skeleton").alias("shape"), "page").distinct().groupBy("host", "shape").agg(F.count("*").alias("pages"))
    distinct = parsed.select("host", "skeleton").distinct().withColumn("shape", F.xxhash64("skeleton"))
    distinct = distinct.join(named, ["host", "shape"]).select("host", "skeleton", "pages", F.pmod(F.xxhash64("skeleton"), F.lit(SALTS)).alias("salt"))
    partial = distinct.groupBy("host", "salt").applyInArrow(part, kind)
    return partial.groupBy("host").applyInArrow(part, kind).select("host", F.col("skeleton").alias("wrapper"))


def host_of(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))


def _slots(node: Node) -> Node:
    """A page's tree with only short texts, so that skeletons of a template agree."""
    for k in node.kids:
        if k.label == "#":
            k.text = k.text if k.text and len(k.text) <= 40 and "/" not in k.text else None
        else:
            _slots(k)
    return node


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars for every row of ``pages``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                skeletons, blocks = [], []
                for page in part.column(4):
                    tree, found = parse(page.as_py())
                    for k in tree.kids:
                        _forget(k)
                    skeletons.append(json.dumps(folded(_slots(tree)).dump(), ensure_ascii=False))
                    blocks.append([{"path": p, "text": t, "linked": n} for p, t, n in found])
                yield pa.record_batch([*part.columns[:4], pa.array(skeletons), pa.array(blocks, pa.list_(pa.struct([("path", pa.string()), ("text", pa.string()), ("linked", pa.int64())])))], names=["id", "url", "host", "page", "skeleton", "blocks"])

    def _forget(node: Node) -> None:
        if dropped(node.label):  # what is dropped anyway needs no slots
            node.kids = []
            return
        for k in node.kids:
            _forget(k)

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.xxhash64(html_col).alias("page"), F.col(html_col).alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    parsed = table(rows.mapInArrow(read, f"id {kind}, url string, host string, page long, skeleton string, blocks array<struct<path string, text string, linked long>>"), "pages")
    of = table(wrappers(parsed), "wrappers")
    if (of.agg(F.sum(F.length("wrapper"))).first()[0] or 0) <= BROADCAST_CHARS:
        of = F.broadcast(of)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, dict[str, int]] = {}
        for b in batches:
            texts = []
            for raw, found in zip(b.column(2), b.column(3), strict=True):
                raw = raw.as_py()
                if raw not in memory:
                    if len(memory) > 200:
                        memory.clear()
                    memory[raw] = content_paths(Node.load(json.loads(raw)))
                texts.append(main_text(found.as_py(), memory[raw]))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    out = parsed.join(of, "host").select("id", "url", "wrapper", "blocks").mapInArrow(write, f"id {kind}, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
