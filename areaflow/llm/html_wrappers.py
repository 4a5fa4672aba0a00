"""Main text of pages through wrappers: union-free expressions inferred from all pages of a host."""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaflow.llm.common import ship_package, small_batches, table
from areaflow.session import cut_lineage

# Elements by what they mean for the text.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "object", "canvas", "math", "audio", "video")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME_TAGS = frozenset("head title nav footer aside form button select option menu dialog fieldset label".split())
MAIN_TAGS = frozenset(["article", "main"])
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar aside widget widgets footer masthead cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "comment comments reply replies disqus pagination pager toolbar search contentinfo complementary".split())
MAIN_WORDS = frozenset("article post entry story articlebody".split())
# `p` and list items end where a block of these begins.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
                   "main menu nav ol p pre section table ul".split())
SAME_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
             "th": ("td", "th"), "option": ("option",)}

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?:svg|math)(?=[\s/])(?:[^<>"']|"[^"]*"|'[^']*')*/>|"""  # closed in itself
    r"<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>|"
    r"""<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>"']|"[^"]*"|'[^']*')*)/?>""",
    re.DOTALL | re.IGNORECASE)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
GAP = re.compile(r"\x20*[\x09-\x0D][\x20\x09-\x0D]*|\x20{2,}")
DIGITS = re.compile(r"\d+")

# Elements that hold running text, or parts of one text.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption details summary table caption "
                      "tbody thead tfoot tr td th section".split())
WHOLE_PAGE = frozenset(["", "html", "body"])
MOST_TEXT = 0.9  # share of the open text that the main part holds, before it grows to what else is running text

LONGEST_REPEAT = 6
#: Marks with more words or letters name a page, not a template.
MARK_WORDS, MARK_LETTERS = 2, 24


def template_mark(word: str) -> str:
    """A class or id as it stands in a path: digits as one, and of a long one, such as a title's slug, the judged words only."""
    mark = DIGITS.sub("0", word.lower()).replace("/", "")
    words = re.split(r"[-_]+", mark)
    if len(words) <= MARK_WORDS and len(mark) <= MARK_LETTERS or re.sub(r"[-_]", "", mark) in MAIN_WORDS:
        return mark
    if words[0] in ("with", "has", "no"):
        return ""
    return "-".join(sorted(CHROME_WORDS.intersection(re.split(r"[^a-z]+", mark))))


@dataclass
class Block:
    path: str
    text: str
    linked: int  # code points inside links


def blocks_of(page: str | None) -> list[Block]:
    """Text blocks of a page in order, each with the path of its block elements (name and marks)."""
    page = page or ""
    path: list[tuple[str, str]] = []
    out: list[Block] = []
    pieces: list[str] = []
    linked: list[str] = []
    links = 0

    def flush() -> None:
        nonlocal pieces, linked
        if not pieces:
            return
        text = GAP.sub(" ", html.unescape("".join(pieces))).strip(" ")
        if text:
            inside = len(GAP.sub(" ", html.unescape("".join(linked))).strip(" ")) if linked else 0
            out.append(Block("/".join(sign for _, sign in path), text, min(inside, len(text))))
        pieces, linked = [], []

    def add(text: str) -> None:
        pieces.append(text)
        if links:
            linked.append(text)

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        name = m.group("name")
        if not name:
            continue
        name = name.lower()
        if name == "br":
            add(" ")
        elif name in INLINE:
            if name == "a":
                links = 0 if m.group("close") else 1
        else:
            flush()
            if m.group("close"):
                names = [n for n, _ in path]
                if name in names:
                    del path[len(names) - 1 - names[::-1].index(name):]
                links = 0
                continue
            if path and path[-1][0] == "p" and name in ENDS_P:
                path.pop()
            if path and path[-1][0] in SAME_ENDS.get(name, ()):
                path.pop()
            if name not in VOID:
                marks = [(k.lower(), a or b or c) for k, a, b, c in ATTRIBUTE.findall(m.group("attrs"))]
                path.append((name, name + "".join(f".{m}" for _, v in marks for w in v.split() if (m := template_mark(w)))))
    if at < len(page):
        add(page[at:])
    flush()
    return out


# --- wrappers ---

@dataclass
class Node:
    """A text slot at a path, or a group of nodes; plus: repeated, optional: not on every page.

    text is the checksum of a slot's text while it is the same on all pages, else None.
    """

    path: str = ""
    nodes: list[Node] = field(default_factory=list)
    plus: bool = False
    optional: bool = False
    text: int | None = None
    pages: int = 1
    chars: int = 0
    linked: int = 0

    def sign(self) -> str:
        return self.path if not self.nodes else "(" + " ".join(n.sign() for n in self.nodes) + ")"

    def slots(self) -> Iterator[Node]:
        if self.nodes:
            for n in self.nodes:
                yield from n.slots()
        else:
            yield self

    def pack(self) -> list:
        return [self.path, [n.pack() for n in self.nodes], int(self.plus), int(self.optional), self.text, self.pages,
                self.chars, self.linked]

    @classmethod
    def unpack(cls, row: list) -> Node:
        return cls(row[0], [cls.unpack(n) for n in row[1]], bool(row[2]), bool(row[3]), *row[4:])


def united(a: Node, b: Node, same_page: bool) -> Node:
    """One node for two that align: a text that differs becomes a slot; flags and masses add up."""
    nodes = align(a.nodes, b.nodes, same_page) if a.nodes else []
    return Node(a.path, nodes, a.plus or b.plus or same_page, a.optional or b.optional,
                a.text if a.text == b.text and not same_page else None, a.pages if same_page else a.pages + b.pages,
                a.chars + b.chars, a.linked + b.linked)


def fold_repeats(nodes: list[Node]) -> list[Node]:
    """Replace each run of equal neighbouring sequences by one repeated group, shortest sequences first."""
    for size in range(1, LONGEST_REPEAT + 1):
        signs = [n.sign() for n in nodes]
        out: list[Node] = []
        i = 0
        while i < len(nodes):
            j = i + size
            if j + size <= len(nodes) and signs[i:j] == signs[j:j + size]:
                part = nodes[i:j]
                while signs[j:j + size] == signs[i:i + size] and j + size <= len(nodes):
                    part = [united(x, y, True) for x, y in zip(part, nodes[j:j + size])]
                    j += size
                out.append(part[0] if size == 1 else Node(nodes=part, plus=True))
                i = j
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def align(a: list[Node], b: list[Node], same_page: bool = False) -> list[Node]:
    """Longest common subsequence of two expressions; what only one of them has becomes optional."""
    sa, sb = [n.sign() for n in a], [n.sign() for n in b]
    if sa == sb:
        return [united(x, y, same_page) for x, y in zip(a, b)]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if sa[i] == sb[j] else max(best[i + 1][j], best[i][j + 1])
    out: list[Node] = []
    i = j = 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and sa[i] == sb[j]:
            out.append(united(a[i], b[j], same_page))
            i, j = i + 1, j + 1
        else:
            left = j == len(b) or (i < len(a) and best[i + 1][j] >= best[i][j + 1])
            node = a[i] if left else b[j]
            i, j = (i + 1, j) if left else (i, j + 1)
            node.optional = True
            # A sequence that the other side repeats, or a neighbour of the same kind: one repeated node.
            if out and out[-1].sign() == node.sign():
                merged = united(out[-1], node, False)
                merged.plus = True
                out[-1] = merged
            else:
                out.append(node)
    return out


def nodes_of(blocks: list[Block]) -> list[Node]:
    return [Node(b.path, text=zlib.crc32(b.text.encode("utf-8", "replace")), chars=len(b.text), linked=b.linked) for b in blocks]


def page_expression(page: str | None) -> list[Node]:
    return fold_repeats(nodes_of(blocks_of(page)))


def marks_of(sign: str) -> list[str]:
    """Classes, ids and roles of an element; those that only say what a layout has ("with-sidebar") are left out."""
    return [m for m in sign.split(".")[1:] if not re.match(r"(?:with|has|no)[-_]", m)]


def marked_main(sign: str) -> bool:
    return any(re.sub(r"[-_]", "", m) in MAIN_WORDS or m == "main" for m in marks_of(sign))


def is_main(sign: str) -> bool:
    return sign.split(".")[0] in MAIN_TAGS or marked_main(sign)


def is_chrome(path: str) -> bool:
    """True when an element of the path is no part of a main text, or is marked so."""
    inside = False
    for sign in path.split("/"):
        name = sign.split(".")[0]
        if name in ("html", "body"):
            continue
        if name in CHROME_TAGS or (name == "header" and not inside):
            return True
        words = (w for m in marks_of(sign) for w in re.split(r"[^a-z]+", m))
        if not marked_main(sign) and any(w in CHROME_WORDS for w in words):
            return True
        inside = inside or is_main(sign)
    return False


def _above(path: str) -> list[str]:
    """Paths of the elements round a slot, the page ("") first; without those inside running text."""
    out, signs = [""], path.split("/")[:-1]
    for k, sign in enumerate(signs):
        if sign.split(".")[0] in TEXT_TAGS - {"section", "table", "tbody", "tr", "td"}:
            break
        out.append("/".join(signs[:k + 1]))
    return out


def _fullest_part(open_: list[Node]) -> list[Node]:
    """Slots of the main part of pages without an article element.

    The core is the deepest element that holds nearly all open text outside links, its
    lists, quotations and sections included.  The main part grows from there until no
    running text is outside, so that sibling containers of one text stay together.
    Slots that are mostly links count in the core only, and not where that is the page.
    """
    plain = [s for s in open_ if 2 * s.linked <= s.chars]
    mass: dict[str, int] = {}
    for s in plain:
        for p in _above(s.path):
            mass[p] = mass.get(p, 0) + s.chars - s.linked
    full = [p for p in mass if mass[p] >= MOST_TEXT * mass[""]]
    if not full:
        return []
    core = max(full, key=lambda p: (len(_signs(p)), p))

    def within(s: Node, part: str) -> bool:
        return not part or s.path.startswith(part + "/")

    part = core
    while not all(within(s, part) for s in plain if any(x.split(".")[0] in TEXT_TAGS for x in _signs(s.path))):
        part = part.rpartition("/")[0]
    links = core.rpartition("/")[2].split(".")[0] not in WHOLE_PAGE
    return [s for s in open_ if within(s, part) and 2 * s.linked <= s.chars or links and within(s, core)]


def _signs(path: str) -> list[str]:
    return path.split("/") if path else []


def main_slots(wrapper: list[Node]) -> tuple[list[tuple[str, bool]], dict[str, bool]]:
    """Of each slot in order whether it holds main text, and the same by path for blocks that no slot fits.

    Slots under an article element are main, less what is marked as something else.
    Without one, the main part is found by where the text outside links is.  A text
    that is the same on all pages is main text like any other.
    """
    slots = [s for n in wrapper for s in n.slots()]
    open_ = [s for s in slots if not is_chrome(s.path)]
    marked = [s for s in open_ if any(map(is_main, s.path.split("/")))]
    if not marked:
        marked = _fullest_part(open_)
    chosen = {id(s) for s in marked}
    by_path: dict[str, bool] = {}
    for s in slots:
        by_path[s.path] = by_path.get(s.path, False) or id(s) in chosen
    return [(s.path, id(s) in chosen) for s in slots], by_path


def extract(page: str | None, slots: list[tuple[str, bool]], by_path: dict[str, bool]) -> str:
    """Texts of the main slots that the blocks of a page fill, in page order.

    A page with no block on any main path of its host, such as one of another template,
    is judged by its own expression.
    """
    blocks = blocks_of(page)
    if blocks and not any(by_path.get(b.path) for b in blocks):
        slots, by_path = main_slots(fold_repeats(nodes_of(blocks)))
    at, out = 0, []
    for block in blocks:
        found = next((k for k in range(at, len(slots)) if slots[k][0] == block.path), None)
        if found is None:  # a repeated group begins again, or an order the wrapper has not seen
            main = by_path.get(block.path, False)
        else:
            at, main = found, slots[found][1]
        if main:
            out.append(block.text)
    return "\n\n".join(out)


def _wrappers_of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[Node]] = {}
    part = TaskContext.get().partitionId()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array(list(held), pa.string()), pa.array([part] * len(held), pa.int32()),
            pa.array([json.dumps([n.pack() for n in w]) for w in held.values()], pa.string())], ["host", "part", "wrapper"])

    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            new = page_expression(page)
            held[host] = align(held[host], new) if host in held else new
        if len(held) > 2000:
            yield rows()
            held.clear()
    yield rows()


def _merged_wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each host; rows come sorted by host."""
    host, wrapper = None, []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array(
            [json.dumps(main_slots(wrapper))], pa.string())], ["_host", "slots"])

    for batch in batches:
        for r in batch.to_pylist():
            new = [Node.unpack(n) for n in json.loads(r["wrapper"])]
            if r["host"] == host:
                wrapper = align(wrapper, new)
            else:
                if host is not None:
                    yield row()
                host, wrapper = r["host"], new
    if host is not None:
        yield row()


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple] = {}
    for batch in batches:
        texts = []
        for page, slots in zip(batch.column("html").to_pylist(), batch.column("slots").to_pylist()):
            if slots not in known:
                if len(known) > 500:
                    known.clear()
                known[slots] = tuple(json.loads(slots)) if slots else ([], {})
            texts.append(extract(page, *known[slots]))
        yield pa.RecordBatch.from_arrays([
            batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
            pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """_host, slots: the wrapper of each host, from all its pages.

    Each partition folds its pages into one expression a host, and the expressions of
    a host are then aligned with each other in partition order, so a host with most
    pages costs its last task one small expression a partition.
    """
    ship_package(pages.sparkSession)
    parts = pages.select("host", "html").mapInArrow(_wrappers_of_partition, "host string, part int, wrapper string")
    return parts.repartition("host").sortWithinPartitions("host", "part").mapInArrow(
        _merged_wrappers, "_host string, slots string")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page (page_id, url, html).

    A null or empty html gives an empty text.  Pages without a host in their url share
    one wrapper.  Repeated rows are extracted each; only the three columns are read.
    A page that its host's wrapper does not fit is matched by the paths of its blocks.
    """
    small_batches(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    wrappers = cut_lineage(infer_wrappers(rows))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.join(wrappers, F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "slots").mapInArrow(
        _applied, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars bigint")


def op7_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return main_texts(table(spark, folder, "pages"))
