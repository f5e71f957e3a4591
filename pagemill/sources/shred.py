"""HTML pages -> one ``nodes`` array per page.

Pages are cut into nodes once, in an Arrow pass over each partition; everything after that is a
native expression over the array (see ``functions.dom``). Nodes are numbered in document order,
so ``nodes[pre]`` is a node and ``nodes[pre + 1 .. fin]`` is everything below it.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Executors get the code with the task, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODE = T.StructType(
    [
        T.StructField("pre", T.IntegerType(), False),
        T.StructField("fin", T.IntegerType(), False),
        T.StructField("parent", T.IntegerType(), False),
        T.StructField("tag", T.StringType(), False),
        T.StructField("cls", T.StringType(), True),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType()), True),
        T.StructField("text", T.StringType(), True),
        T.StructField("brk", T.BooleanType(), False),
        T.StructField("o1", T.IntegerType(), False),
        T.StructField("i1", T.IntegerType(), False),
        T.StructField("i2", T.IntegerType(), False),
        T.StructField("o2", T.IntegerType(), False),
        # Place among the elements of one parent, from 1; 0 for texts.
        T.StructField("rank", T.IntegerType(), False),
    ]
)

# Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset(["script", "style"])
PLAIN_TEXT = frozenset(["title", "textarea"])
# Elements that end a line of readable text.
LINE_BLOCKS = frozenset("p div li tr h1 h2 h3 h4 h5 blockquote section article".split())
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul".split()
)
# An opening tag ends an open element of these names, up to the nearest container.
ENDS = {
    "li": (("li",), ("ul", "ol")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
    "a": (("a",), ("table", "td", "th", "caption", "object", "template")),
}
# A closing tag does not reach out of these; one of a table's own parts only stops at the table.
SCOPES = frozenset("table td th caption object template".split())
TABLE_SCOPES = frozenset(["table", "template"])
TABLE_PARTS = frozenset("table thead tbody tfoot tr td th caption colgroup".split())

RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW_TEXT | PLAIN_TEXT}
ROWS_OUT = 256

# A quote opens a value right after "=" only, and nothing here is tried twice, so a tag costs its own length.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>",
    re.S,
)
MARKUP = re.compile(r"</?[a-zA-Z]|<[!?]")
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


# In an attribute a name without its semicolon only counts when nothing could continue it (``?a=1&copy=2``).
ATTR_REF = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*)(?:;|(?![=A-Za-z0-9]))")


def _attr_value(raw: str) -> str:
    return ATTR_REF.sub(lambda m: unescape(m.group()), raw) if "&" in raw else raw


class _Columns:
    """The nodes of one Arrow batch: a short list per node, turned into columns at the end."""

    def __init__(self) -> None:
        self.nodes: list[list] = []
        self.attrs: list[tuple[str, str]] = []
        self.page_at = [0]

    def arrow(self) -> pa.ListArray:
        i32, utf8 = pa.int32(), pa.string()
        types = [i32, i32, i32, utf8, utf8, i32, utf8, pa.bool_(), i32, i32, i32, i32, i32]
        columns = list(zip(*self.nodes)) or [()] * len(types)
        parts = [pa.array(c, t) for c, t in zip(columns, types)]
        attr_at = pa.array([*columns[5], len(self.attrs)], i32)
        parts[5] = pa.MapArray.from_arrays(
            attr_at, pa.array([k for k, _ in self.attrs], utf8), pa.array([v for _, v in self.attrs], utf8)
        )
        nodes = pa.StructArray.from_arrays(parts, names=[f.name for f in NODE.fields])
        return pa.ListArray.from_arrays(pa.array(self.page_at, i32), nodes)


# Places in a node's list; the sixth holds where its attributes begin.
FIN, TAG, BRK, I2, O2 = 1, 3, 7, 10, 11


def _shred(html: str, out: _Columns) -> None:
    """Append the nodes of one page. Unclosed elements end with their parent."""
    nodes, all_attrs = out.nodes, out.attrs
    base, at, size = len(nodes), 0, len(html)
    stack: list[list] = []
    open_at: dict[str, list[int]] = {}  # depths of the open elements of each name, so that nothing walks the stack
    kids = [0]  # elements so far under the page and under each open element

    def close(pos: int, after: int) -> None:
        node = stack.pop()
        kids.pop()
        open_at[node[TAG]].pop()
        node[FIN] = len(nodes) - base - 1
        node[I2], node[O2] = pos, after
        if node[TAG] in LINE_BLOCKS:
            nodes[-1][BRK] = True

    def deepest(names) -> int:
        return max((open_at[n][-1] for n in names if open_at.get(n)), default=-1)

    def end_open(names, barrier, pos: int) -> None:
        depth = deepest(names)
        if depth > deepest(barrier):
            while len(stack) > depth:
                close(pos, pos)

    def add_text(raw: str, pos: int, name: str = "#text") -> None:
        if raw:
            pre = len(nodes) - base
            value = unescape(raw) if name == "#text" else raw
            up = stack[-1][0] if stack else -1
            nodes.append([pre, pre, up, name, None, len(all_attrs), value, False, pos, pos, pos + len(raw), pos + len(raw), 0])

    def add_element(tag: str, raw_attrs: str, start: int, inner: int) -> list:
        pre, first = len(nodes) - base, len(all_attrs)
        cls = None
        if raw_attrs and not raw_attrs.isspace():
            found: dict[str, str] = {}
            for a in ATTR.finditer(raw_attrs):
                found.setdefault(a.group(1).lower(), _attr_value(a.group(2) or a.group(3) or a.group(4) or ""))
            all_attrs.extend(found.items())
            if "class" in found:
                cls = f" {' '.join(found['class'].split())} "
        up = stack[-1][0] if stack else -1
        kids[-1] += 1
        node = [pre, pre, up, tag, cls, first, None, tag == "br", start, inner, inner, inner, kids[-1]]
        nodes.append(node)
        return node

    while at < size:
        start = html.find("<", at)
        while start >= 0 and not MARKUP.match(html, start):
            start = html.find("<", start + 1)
        m = TOKEN.match(html, start) if start >= 0 else None
        if m is None:  # no markup is left, or it never ends
            add_text(html[at:], at)
            break
        if start > at:
            add_text(html[at:start], at)
        at = m.end()
        end, tag, raw_attrs = m.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if end:
            barrier = TABLE_SCOPES if tag in TABLE_PARTS else SCOPES
            depth = deepest((tag,))
            if depth >= 0 and depth >= deepest(barrier):
                while len(stack) > depth + 1:
                    close(start, start)
                close(start, at)
            continue
        if tag in CLOSES_P:
            end_open(("p",), ("button", "td", "th"), start)
        if tag in ENDS:
            end_open(*ENDS[tag], start)
        node = add_element(tag, raw_attrs, start, at)
        if tag in VOID:
            continue
        open_at.setdefault(tag, []).append(len(stack))
        stack.append(node)
        kids.append(0)
        if tag in RAW_END:
            stop = RAW_END[tag].search(html, at)
            until, after = (stop.start(), stop.end()) if stop else (size, size)
            add_text(html[at:until], at, "#raw" if tag in RAW_TEXT else "#text")
            close(until, after)
            at = after
    while stack:
        close(size, size)
    out.page_at.append(len(nodes))


def shred_pages(pages: DataFrame, html: str = "html", keep_html: bool = False) -> DataFrame:
    """Add ``nodes`` to each page row; the raw page is dropped unless ``keep_html`` asks for it."""
    kept = [f for f in pages.schema.fields if keep_html or f.name != html]
    schema = T.StructType(kept + [T.StructField("nodes", T.ArrayType(NODE, False), True)])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Small output batches: a page grows about tenfold when shredded.
            for start in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(start, ROWS_OUT)
                cols = _Columns()
                for page in part.column(part.schema.get_field_index(html)).to_pylist():
                    _shred(page or "", cols)
                arrays = [part.column(part.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays(arrays + [cols.arrow()], names=names + ["nodes"])

    return pages.mapInArrow(run, schema)
