"""Oversized texts cut at natural boundaries (problem 4)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
#: Lines that open a section, and their depth: the number of #, the number of an h tag, then lines in capitals, emphasised lines and labels that end with a colon.
HEADINGS = (
    (re.compile(r"\s{0,3}(#{1,6})\s+\S.*$"), lambda m: len(m[1])),
    (re.compile(r"\s*<h([1-6])\b.*$", re.I), lambda m: int(m[1])),
    (re.compile(r"[A-Z][A-Z0-9 ,/&()'-]{2,60}\s*$"), lambda m: 7),
    (re.compile(r"\*\*[^*\n]+\*\*:?\s*$|__[^_\n]+__:?\s*$"), lambda m: 8),
    (re.compile(r"[A-Z][\w ]{1,40}:\s*$"), lambda m: 9),
)
ITEM = re.compile(r"([ \t]*)(?:[-*+•]|\(?(?:\d{1,3}|[a-z])[.)])[ \t]+\S")
INDENT = re.compile(r"[ \t]*")
#: Markup elements that hold blocks of text.
ELEMENT = re.compile(r"<(/?)(html|body|main|article|section|div|blockquote|table|tbody|thead|tr|td|th|ul|ol|dl|li|dd|dt|p)\b[^<>]*>", re.I)
#: What says nothing of its own, white space and end tags, stays with the piece before it.
BARE = re.compile(r"(?:\s|</\w+\s*>)+")
SENTENCE = re.compile(r"(?<=[.!?;。！？])[\"')\]]*\s+")
WORD = re.compile(r"\s+")


class Node:
    """A range of the text; kind says how it is divided, depth how deep a heading stands, lead that the node introduces what follows it."""

    __slots__ = ("start", "end", "kind", "inner", "lead")

    def __init__(self, start: int, end: int, kind: str, inner: list | None = None, lead: bool = False):
        self.start, self.end, self.kind, self.inner, self.lead = start, end, kind, inner, lead


def heading_depth(line: str) -> int:
    """Depth of a heading from 1, or 0."""
    for pattern, depth in HEADINGS:
        if m := pattern.match(line):
            return depth(m)
    return 0


def _lines(text: str, start: int, end: int) -> list[tuple[int, int]]:
    out, at = [], start
    while at < end:
        stop = min(LINE.match(text, at).end(), end)
        stop = stop if stop > at else end
        out.append((at, stop))
        at = stop
    return out


def _elements(text: str, start: int, end: int) -> list[Node]:
    """Markup elements as a forest: the text between them becomes nodes of its own; an element whose end is missing ends with its parent."""
    root: list = [start, None, []]
    stack = [root]
    for m in ELEMENT.finditer(text, start, end):
        name = m[2].lower()
        if not m[1]:
            stack.append([m.start(), name, []])
        elif any(x[1] == name for x in stack):
            while True:
                begin, own, inner = stack.pop()
                stop = m.end() if own == name else m.start()
                stack[-1][2].append(Node(begin, stop, "element", inner))
                if own == name:
                    break
    while len(stack) > 1:
        begin, _, inner = stack.pop()
        stack[-1][2].append(Node(begin, end, "element", inner))
    return root[2]


def _filled(start: int, end: int, nodes: list[Node], kind: str) -> list[Node]:
    """nodes with the gaps between them as nodes of kind."""
    out, at = [], start
    for n in nodes:
        if n.start > at:
            out.append(Node(at, n.start, kind))
        out.append(n)
        at = n.end
    if at < end:
        out.append(Node(at, end, kind))
    return out


def _sections(text: str, start: int, end: int) -> list[Node]:
    """Sections nested by the depth of their headings; what stands before the first heading is a part of its own."""
    heads = [(a, b, d) for a, b in _lines(text, start, end) if (d := heading_depth(text[a:b].rstrip("\r\n")))]

    def nest(i: int, stop: int, depth: int) -> tuple[list[Node], int]:
        out = []
        while i < len(heads) and heads[i][2] > depth:
            a, b, d = heads[i]
            inner, j = nest(i + 1, stop, d)
            close = heads[j][0] if j < len(heads) else stop
            body = inner[0].start if inner else close
            parts = [Node(a, b, "line", lead=True), *([Node(b, body, "blocks")] if body > b else []), *inner]
            out.append(Node(a, close, "section", parts))
            i = j
        return out, i

    return _filled(start, end, nest(0, end, 0)[0], "blocks") if heads else []


def _blocks(text: str, start: int, end: int) -> list[Node]:
    """Paragraphs: a blank line ends one and belongs to it."""
    out, begin, blank = [], start, False
    for a, b in _lines(text, start, end):
        empty = not text[a:b].strip()
        if blank and not empty and a > begin:
            out.append(Node(begin, a, "block"))
            begin = a
        blank = empty
    return [*out, Node(begin, end, "block")]


def _items(text: str, start: int, end: int) -> list[Node]:
    """Lines and list items of a paragraph; an item holds the lines and items below it that are indented further."""
    rows = []
    for a, b in _lines(text, start, end):
        m = ITEM.match(text, a, b)
        rows.append((a, b, len(INDENT.match(text, a, b)[0].expandtabs(4)), bool(m)))

    def nest(i: int, indent: int) -> tuple[list[Node], int]:
        out = []
        while i < len(rows) and rows[i][2] > indent:
            a, b, own, item = rows[i]
            i += 1
            if not item:
                out.append(Node(a, b, "line"))
                continue
            inner, i = nest(i, own)
            close = inner[-1].end if inner else b
            out.append(Node(a, close, "item", [Node(a, b, "line", lead=True), *inner]) if inner else Node(a, b, "line"))
        return out, i

    return nest(0, -1)[0]


def _cut(start: int, end: int, points: list[int], kind: str) -> list[Node]:
    edges = [start, *sorted({p for p in points if start < p < end}), end]
    return [Node(a, b, kind) for a, b in zip(edges, edges[1:])]


def children(text: str, node: Node) -> list[Node]:
    """The parts of a node in order, at least two of them, or none for a single code point.

    A document is divided by its markup elements, else by headings into nested sections, then paragraphs, list items by their indentation and lines, sentences, words, characters with
    their marks, and code points. A kind that doesn't divide the node is passed over.
    """
    a, b = node.start, node.end
    while True:
        kind = node.kind
        if kind in ("section", "item"):
            out = [y for x in node.inner for y in ([x] if x.kind != "blocks" else _blocks(text, x.start, x.end))]
            node = Node(a, b, "line")
        elif kind in ("text", "element"):
            out = _filled(a, b, node.inner if kind == "element" else _elements(text, a, b), "plain")
            node = Node(a, b, "plain")
        elif kind == "plain":
            out = _sections(text, a, b)
            node = Node(a, b, "blocks")
        elif kind == "blocks":
            out, node = _blocks(text, a, b), Node(a, b, "block")
        elif kind == "block":
            out, node = _items(text, a, b), Node(a, b, "line")
        elif kind == "line":
            out, node = _cut(a, b, [m.end() for m in SENTENCE.finditer(text, a, b)], "sentence"), Node(a, b, "sentence")
        elif kind == "sentence":
            out, node = _cut(a, b, [m.end() for m in WORD.finditer(text, a, b)], "word"), Node(a, b, "word")
        elif kind == "word":  # characters with the marks that combine with them, and CR LF as one
            points = [i for i in range(a + 1, b) if not unicodedata.combining(text[i]) and not (text[i] == "\n" and text[i - 1] == "\r")]
            out, node = _cut(a, b, points, "cluster"), Node(a, b, "cluster")
        else:
            return [Node(i, i + 1, "point") for i in range(a, b)] if b - a > 1 else []
        if len(out) > 1:
            return out
        if out and out[0].inner and out[0].kind != kind:  # one part that is all of the node
            node = out[0]


def pack_tree(text: str, limit: int, first_limit: int, size=None) -> list[tuple[int, int]]:
    """Consecutive ranges of text, the first of at most first_limit and the others of at most limit units.

    Only nodes of the tree that don't fit are opened. Inside an opened node, siblings are merged from left to right as long as they fit together; what is
    inside a node is never merged with what follows the node, but for white space and end tags. A heading, or the first line of an item, goes with the piece that begins behind it if there is room.
    """
    size = size or (lambda a, b: b - a)
    pieces: list[tuple[int, int]] = []
    # An explicit stack, as deep as the tree: (children, next child, range that is open, whether it only leads on).
    stack: list[list] = [[children(text, Node(0, len(text), "text")), 0, None, False]]
    while stack:
        frame = stack[-1]
        parts, at, open_, leads = frame
        if at == len(parts):
            if open_:
                pieces.append(open_)
            stack.pop()
            continue
        node = parts[at]
        frame[1] += 1
        if pieces and not open_ and BARE.fullmatch(text, node.start, node.end) and size(pieces[-1][0], node.end) <= (limit if len(pieces) > 1 else first_limit):
            pieces[-1] = (pieces[-1][0], node.end)
            continue
        room = limit if pieces else first_limit
        if open_ and size(open_[0], node.end) <= room:
            frame[2], frame[3] = (open_[0], node.end), leads and node.lead
        elif size(node.start, node.end) <= (limit if open_ or pieces else first_limit):
            if open_:
                pieces.append(open_)
            frame[2], frame[3] = (node.start, node.end), node.lead
        else:
            inner = children(text, node)
            carried = open_ if open_ and leads and inner else None
            if open_ and not carried:
                pieces.append(open_)
            frame[2], frame[3] = None, False
            if inner:
                stack.append([inner, 0, carried, True])
            else:  # one code point that is larger than the limit can't be cut
                pieces.append((node.start, node.end))
    return pieces


def cut_text(text: str, max_size: int, overlap: int, measure: str = "characters") -> list[tuple[int, int, int]]:
    """(start, end, overlap) of the pieces of text in Unicode characters, in order.

    Each piece has at most max_size units (Unicode characters, or UTF-8 bytes for the measure
    tokens, the public byte-level tokenizer's count). Every piece but the first starts overlap units
    before the end of the one before it (for tokens: at most that many, at a character's border). The
    new parts alone, start + overlap to end, join to the whole text. A text within the limit is one piece.
    """
    overlap = max(0, min(overlap, max_size - 1))
    if measure == "characters":
        size = lambda a, b: b - a
    else:
        sums = [0]
        for ch in text:
            sums.append(sums[-1] + len(ch.encode("utf-8", "surrogatepass")))
        size = lambda a, b: sums[b] - sums[a]
    if size(0, len(text)) <= max_size:
        return [(0, len(text), 0)]
    out = []
    for i, (a, b) in enumerate(pack_tree(text, max_size - overlap, max_size, size)):
        start = a
        if i:
            while start > 0 and size(start - 1, a) <= overlap and size(start - 1, b) <= max_size:
                start = a - overlap if measure == "characters" else start - 1
                if measure == "characters":
                    break
        out.append((max(0, start), b, a - max(0, start)))
    return out


def cut_oversized(df: DataFrame, id_column: str, text_column: str, limits: DataFrame, table_name: str) -> DataFrame:
    """Pieces of the texts above their limit: table_name, field_name, id, piece (from 1), start, end, overlap, n_size, text.

    limits has one row per field (table_name, field_name, measure, max_size, overlap); the row of this
    table and field is read. Texts within the limit, null texts and tables without a limit give no
    rows. start and end count Unicode characters from 0. Only oversized texts leave the JVM.
    """
    schema = "table_name string, field_name string, id string, piece int, start int, end int, overlap int, n_size int, text string"
    row = limits.filter((F.col("table_name") == table_name) & (F.col("field_name") == text_column) & F.col("max_size").isNotNull()).limit(1).collect()
    if not row:
        return df.sparkSession.createDataFrame([], schema)
    measure, most, over = row[0]["measure"], int(row[0]["max_size"]), int(row[0]["overlap"] or 0)

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["table_name", "field_name", "id", "piece", "start", "end", "overlap", "n_size", "text"]
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"]):
                for i, (a, b, o) in enumerate(cut_text(text, most, over, measure), 1):
                    piece = text[a:b]
                    n = len(piece) if measure == "characters" else len(piece.encode())
                    rows.append((table_name, text_column, key, i, a, b, o, n, piece))
            yield pd.DataFrame(rows, columns=names)

    return df.filter(text_size(text_column, measure) > most).select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text")).mapInPandas(parts, schema)


def text_size(column: str | Column, measure: str) -> Column:
    """Unicode characters or, for the measure tokens, UTF-8 bytes."""
    return F.char_length(column) if measure == "characters" else F.octet_length(column)
