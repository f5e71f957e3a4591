"""Selections over the ``nodes`` array of a shredded page.

A selection is an ARRAY<INT> of node numbers. Below a node lies one contiguous slice of the array,
so each step touches only the subtree it is asked about.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_lines, js_trim, let
from .urls import resolve_link

DOCUMENT = -1


def _has_word(value: Column, wanted: str) -> Column:
    return F.array_contains(F.split(value, r"[ \t\n\f\r]+"), wanted)


# An empty value is at the start of nothing, and no word holds white space.
ATTR_OPS = {
    "=": lambda value, wanted: value == wanted,
    "^=": lambda value, wanted: F.startswith(value, F.lit(wanted)) & F.lit(wanted != ""),
    "$=": lambda value, wanted: F.endswith(value, F.lit(wanted)) & F.lit(wanted != ""),
    "*=": lambda value, wanted: F.contains(value, F.lit(wanted)) & F.lit(wanted != ""),
    "~=": lambda value, wanted: _has_word(value, wanted) & F.lit(wanted.split() == [wanted]),
}


@dataclass(frozen=True)
class Step:
    """One selection step: what an element must look like and where to look for it.

    ``cls`` is a class or several that must all be there. ``attr_op`` says how ``attr_value`` is compared: equal (=), at
    the start (^=), at the end ($=), anywhere (*=), or as one of the words (~=). ``nth`` is a position among all
    elements of one parent, counted from 1, or (a, b) for the positions a*k + b with k from 0 on. A step looks below
    each root, among its children (``child``), at the element right after it (``sibling="+"``) or at all elements after
    it under the same parent (``sibling="~"``).
    """

    tag: str | None = None
    cls: str | tuple[str, ...] | None = None
    id: str | None = None
    attr: str | None = None
    attr_value: str | None = None
    contains: str | None = None
    child: bool = False
    include_self: bool = False
    attr_op: str = "="
    nth: int | tuple[int, int] | None = None
    sibling: str | None = None

    def __post_init__(self) -> None:
        if self.sibling not in (None, "+", "~") or self.attr_op not in ATTR_OPS:
            raise ValueError(f"unknown axis or comparison: {self.sibling} {self.attr_op}")

    def __truediv__(self, other: "Step") -> tuple["Step", "Step"]:
        return (self, replace(other, child=True))

    def __add__(self, other: "Step") -> tuple["Step", "Step"]:
        return (self, replace(other, sibling="+"))


def document() -> Column:
    return F.array(F.lit(DOCUMENT))


def node(nodes: Column, pre: Column) -> Column:
    return F.get(nodes, pre)


def below(nodes: Column, pre: Column) -> Column:
    """All nodes under ``pre`` (the whole page for the document itself)."""
    fin = lambda p: F.when(p < 0, F.size(nodes) - 1).otherwise(F.get(nodes, p)["fin"])
    return let(pre, lambda p: F.slice(nodes, p + 2, F.greatest(fin(p) - p, F.lit(0))))


def text_content(nodes: Column, pre: Column) -> Column:
    texts = F.filter(below(nodes, pre), lambda n: n["text"].isNotNull())
    return F.array_join(F.transform(texts, lambda n: n["text"]), "")


def matches(n, step: Step) -> Column:
    """Whether a node looks as the step says, but for the text it contains; ``n`` has a node's fields by name."""
    ok = n["text"].isNull()
    if step.tag and step.tag != "*":
        ok = ok & (n["tag"] == step.tag.lower())
    for cls in (step.cls,) if isinstance(step.cls, str) else step.cls or ():
        ok = ok & F.coalesce(F.contains(n["cls"], F.lit(f" {cls} ")), F.lit(False))
    if step.id:
        ok = ok & F.coalesce(n["attrs"]["id"] == step.id, F.lit(False))
    if step.attr:
        value = F.element_at(n["attrs"], F.lit(step.attr))
        hit = value.isNotNull() if step.attr_value is None else ATTR_OPS[step.attr_op](value, step.attr_value)
        ok = ok & F.coalesce(hit, F.lit(False))
    if step.nth is not None:
        a, b = (0, step.nth) if isinstance(step.nth, int) else step.nth
        gone = n["rank"] - b
        ok = ok & ((gone == 0) if a == 0 else (gone % a == 0) & (gone * (1 if a > 0 else -1) >= 0))
    return ok


def _matches(nodes: Column, n: Column, step: Step) -> Column:
    ok = matches(n, step)
    if step.contains:
        ok = ok & F.contains(text_content(nodes, n["pre"]), F.lit(step.contains))
    return ok


def _after(nodes: Column, root: Column) -> Column:
    """What lies behind a node and its subtree under its parent; nothing for the document."""
    own = F.get(nodes, root)
    end = let(own["parent"], lambda p: F.when(p < 0, F.size(nodes) - 1).otherwise(F.get(nodes, p)["fin"]))
    return F.when(root >= 0, F.slice(nodes, own["fin"] + 2, end - own["fin"])).otherwise(F.slice(nodes, 1, 0))


def _under(nodes: Column, step: Step):
    """Function of one root: the matching node numbers the step finds from it."""

    def wanted(n: Column, root: Column) -> Column:
        ok = _matches(nodes, n, step)
        if step.sibling:
            own = F.get(nodes, root)
            ok = ok & (n["parent"] == own["parent"])
            return ok & (n["rank"] == own["rank"] + 1) if step.sibling == "+" else ok
        return (n["parent"] == root) & ok if step.child else ok

    def run(root: Column) -> Column:
        near = _after(nodes, root) if step.sibling else below(nodes, root)
        hits = F.transform(F.filter(near, lambda n: wanted(n, root)), lambda n: n["pre"])
        if not step.include_self:
            return hits
        own = F.filter(F.array(root), lambda r: (r >= 0) & _matches(nodes, F.get(nodes, r), step))
        return F.concat(own, hits)

    return run


def select(nodes: Column, *steps: Step, roots: Column | None = None) -> Column:
    """Apply steps one after the other, root by root, each result listed once."""
    found = document() if roots is None else roots
    for step in steps:
        found = F.array_distinct(F.flatten(F.transform(found, _under(nodes, step))))
    return found


def any_of(*selections: Column) -> Column:
    """Comma groups: all of the first, then what the next ones add."""
    return F.array_distinct(F.concat(*selections))


def children(nodes: Column, roots: Column) -> Column:
    return select(nodes, Step(tag="*", child=True), roots=roots)


# --- positions -------------------------------------------------------------------------------


def _from_end(sel: Column, i: int) -> Column:
    return F.lit(i) if i >= 0 else F.size(sel) + F.lit(i)


def at(sel: Column, i: int) -> Column:
    """One item, counted from the end when ``i`` is negative; empty when there is none."""
    pos = _from_end(sel, i)
    return F.filter(sel, lambda x, k: k == pos)


def picks(sel: Column, *spec: int | tuple) -> Column:
    """Items by position, in the order asked for; a tuple is (start, end, stride), end exclusive."""
    parts = [at(sel, s) if isinstance(s, int) else span(sel, *s) for s in spec]
    return F.array_distinct(F.concat(*parts))


def span(sel: Column, start: int | None = None, end: int | None = None, stride: int | None = None) -> Column:
    if (start, end, stride) == (-1, 0, None):  # the customary way to ask for the whole list backwards
        return F.reverse(sel)
    lo = F.lit(0) if start is None else _from_end(sel, start)
    hi = F.size(sel) if end is None else _from_end(sel, end)
    if stride is None:
        backwards = (start or 0) > end if end is not None else None
        if backwards is None:  # open end: the direction depends on the number of items
            up = span(sel, start, end, 1)
            down = F.array().cast("array<int>")
            return F.when(F.lit(start or 0) <= F.size(sel), up).otherwise(down)
        stride = -1 if backwards else 1
    if stride == 0:
        return F.array().cast("array<int>")
    if stride > 0:
        return F.filter(sel, lambda x, k: (k >= lo) & (k < hi) & ((k - lo) % stride == 0))
    picked = F.filter(sel, lambda x, k: (k <= lo) & (k > F.greatest(hi, F.lit(-1))) & ((lo - k) % -stride == 0))
    return F.reverse(picked)


def without(sel: Column, *positions: int) -> Column:
    drop = F.array(*[_from_end(sel, p) for p in positions])
    return F.filter(sel, lambda x, k: ~F.array_contains(drop, k))


def first_n(sel: Column, n: int) -> Column:
    """Items before position ``n``."""
    return F.filter(sel, lambda x, k: k < _from_end(sel, n))


def after_n(sel: Column, n: int) -> Column:
    """Items after position ``n``."""
    return F.filter(sel, lambda x, k: k > _from_end(sel, n))


# --- values ----------------------------------------------------------------------------------


def text(nodes: Column, pre: Column) -> Column:
    return js_trim(text_content(nodes, pre))


def own_text(nodes: Column, pre: Column) -> Column:
    own = F.filter(below(nodes, pre), lambda n: (n["parent"] == pre) & n["text"].isNotNull())
    return js_trim(F.array_join(F.transform(own, lambda n: n["text"]), ""))


def attr(nodes: Column, pre: Column, name: str, base: Column | None = None) -> Column:
    """An attribute, '' when missing; links and url-looking values become absolute."""
    value = F.coalesce(F.element_at(F.get(nodes, pre)["attrs"], F.lit(name.lower())), F.lit(""))
    if base is None:
        return js_trim(value)
    if name.lower() in ("href", "src"):
        return resolve_link(value, base)
    looks_like_url = r"^((https?:)?//|/)"
    return let(value, lambda v: F.when(v.rlike(looks_like_url), resolve_link(v, base)).otherwise(js_trim(v)))


def inner_html(html: Column, nodes: Column, pre: Column) -> Column:
    return let(F.get(nodes, pre), lambda n: js_trim(F.substring(html, n["i1"] + 1, n["i2"] - n["i1"])))


def outer_html(html: Column, nodes: Column, pre: Column) -> Column:
    return let(F.get(nodes, pre), lambda n: js_trim(F.substring(html, n["o1"] + 1, n["o2"] - n["o1"])))


def html_to_text(nodes: Column, pre: Column) -> Column:
    """Readable text: scripts left out, a line break after blocks and at br, blank lines dropped."""
    flow = F.transform(
        below(nodes, pre),
        lambda n: F.concat(
            F.when(n["tag"] == "#text", n["text"]).otherwise(F.lit("")),
            F.when(n["brk"], F.lit("\n")).otherwise(F.lit("")),
        ),
    )
    return clean_lines(F.translate(F.array_join(flow, ""), "\u00a0", " "))


def first(sel: Column) -> Column:
    """The first selected node, or NULL."""
    return F.get(sel, F.lit(0))
