"""Selections: arrays, the node table and a walk in plain Python agree; shredding stays linear."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from pagemill.functions import dom
from pagemill.functions.dom import Step
from pagemill.operators import extract, structural
from pagemill.sources import shred

NAMES = ["div", "span", "b", "ul", "section"]


def random_page(rng: random.Random, size: int) -> str:
    out, stack = [], []
    for _ in range(size):
        if stack and rng.random() < 0.45:
            out.append(f"</{stack.pop()}>")
        else:
            name = rng.choice(NAMES)
            classes = " ".join(rng.sample(["x", "y", "z"], rng.randint(0, 3)))
            out.append(f'<{name} class="{classes}" k="{rng.choice(["", "one", "one two", "twone"])}">' + rng.choice(["", "t"]))
            stack.append(name)
    return "".join(out)


STEPS = {
    "below": (Step(tag="div"), Step(tag="span")),
    "deep": (Step(tag="*"), Step(tag="div"), Step(tag="*"), Step(tag="b")),
    "child": (Step(tag="div"), Step(tag="*", child=True), Step(tag="span", child=True)),
    "child_below": (Step(tag="*"), Step(tag="*", child=True), Step(tag="b"), Step(tag="*")),
    "next": (Step(tag="div"), Step(tag="*", sibling="+"), Step(tag="span")),
    "next_child": Step(tag="div") + Step(tag="span"),
    "later": (Step(tag="div"), Step(tag="*", sibling="~"), Step(tag="*")),
    "later_later": (Step(tag="*"), Step(tag="*", child=True), Step(tag="*", sibling="~"), Step(tag="*", sibling="~"), Step(tag="b")),
    "later_child": (Step(tag="*"), Step(tag="div", sibling="~"), Step(tag="*", child=True), Step(tag="*", sibling="+"), Step(tag="*")),
    "self": (Step(tag="div"), Step(tag="*", cls="x", include_self=True)),
    "classes": (Step(cls=("x", "z")), Step(cls="y")),
    "word": (Step(attr="k", attr_op="~=", attr_value="two"),),
    "no_word": (Step(attr="k", attr_op="~=", attr_value="one two"),),
    "starts": (Step(attr="k", attr_op="^=", attr_value="one"), Step(attr="k", attr_op="$=", attr_value="one")),
    "empty": (Step(attr="k", attr_op="*=", attr_value=""),),
    "is_empty": (Step(attr="k", attr_value=""),),
    "nth": (Step(tag="div"), Step(nth=(3, 1), child=True), Step(nth=2)),
    "nth_back": (Step(nth=(-2, 3)),),
    "from_page": (Step(tag="*", child=True), Step(sibling="~"), Step(tag="div")),
    "no_sibling": (Step(tag="*", sibling="+"),),
}


def walk(nodes, steps):
    """The steps one root at a time, in plain Python."""

    def looks(n, s):
        if n["text"] is not None or (s.tag and s.tag != "*" and n["tag"] != s.tag):
            return False
        have = (n["cls"] or "").split()
        if any(c not in have for c in ([s.cls] if isinstance(s.cls, str) else s.cls or [])):
            return False
        if s.attr:
            v, w = n["attrs"].get(s.attr), s.attr_value
            if v is None:
                return False
            if w is not None:
                hit = {"=": v == w, "^=": w and v.startswith(w), "$=": w and v.endswith(w), "*=": w and w in v, "~=": w in v.split()}
                if not hit[s.attr_op]:
                    return False
        if s.nth is not None:
            a, b = (0, s.nth) if isinstance(s.nth, int) else s.nth
            if not any(a * k + b == n["rank"] for k in range(len(nodes) + 1)):
                return False
        return True

    roots = [-1]
    for s in steps:
        found = []
        for r in roots:
            fin = len(nodes) - 1 if r < 0 else nodes[r]["fin"]
            if s.sibling:
                near = [n for n in nodes[fin + 1 :] if r >= 0 and n["parent"] == nodes[r]["parent"] and n["text"] is None]
                near = near[:1] if s.sibling == "+" else near
            else:
                near = [n for n in nodes[r + 1 : fin + 1] if not s.child or n["parent"] == r]
                if s.include_self and r >= 0:
                    near = [nodes[r], *near]
            found += [n["pre"] for n in near if looks(n, s)]
        roots = list(dict.fromkeys(found))
    return roots


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(8)
    rows = [(i, random_page(rng, rng.choice([3, 20, 60, 120]))) for i in range(12)] + [(99, ""), (100, None)]
    return shred.shred_pages(spark.createDataFrame(rows, "page_id long, html string").repartition(3)).cache()


@pytest.mark.parametrize("name", sorted(STEPS))
def test_forms_agree(pages, name):
    steps = STEPS[name]
    rows = pages.select("page_id", "nodes", dom.select(F.col("nodes"), *steps).alias("found")).collect()
    want = {r.page_id: walk(r.nodes, steps) for r in rows}
    assert {r.page_id: r.found for r in rows} == want
    table = structural.select_rows(extract.node_rows(pages, ["page_id"]), ["page_id"], *steps).collect()
    got = {i: [] for i in want}
    for r in sorted(table, key=lambda r: r.ord):
        got[r.page_id].append(r.pre)
    assert got == want


def test_large_pages_are_joined_not_multiplied(spark):
    """Selections over a page of 100 000 nodes; the plan has no join without an equality."""
    page = random_page(random.Random(1), 140_000)
    pages = shred.shred_pages(spark.createDataFrame([(1, page)], "page_id long, html string"))
    rows = extract.node_rows(pages, ["page_id"]).cache()
    assert rows.count() > 100_000
    start = time.time()
    for name in ("deep", "child_below", "later_later", "nth"):
        found = structural.select_rows(rows, ["page_id"], *STEPS[name])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        found.count()
    assert time.time() - start < 60
    nodes = pages.select("nodes").first().nodes
    outer = [n["pre"] for n in nodes if n["tag"] == "div"]
    inside = set()
    for pre in outer:  # each is walked up to the next one around it
        inside.update(range(pre + 1, nodes[pre]["fin"] + 1)) if pre not in inside else None
    want = [n["pre"] for n in nodes if n["pre"] in inside and n["tag"] == "span"]
    got = structural.select_rows(rows, ["page_id"], *STEPS["below"]).orderBy("ord").collect()
    assert [r.pre for r in got] == want


def test_texts_need_arrays(spark, pages):
    with pytest.raises(ValueError):
        structural.select_rows(extract.node_rows(pages, ["page_id"]), ["page_id"], Step(tag="div", contains="t"))
    with pytest.raises(ValueError):
        Step(sibling=">")


@pytest.mark.parametrize("unit", ["<b></i>", "<div><p>", "<li><a></b>", "<table><td></a>"])
def test_shredding_is_linear(unit):
    """Tags that close nothing and tags that are never closed cost no walk over what is open."""

    def seconds(n: int) -> float:
        start = time.perf_counter()
        shred._shred(unit * n, shred._Columns())
        return time.perf_counter() - start

    seconds(100)
    assert seconds(32_000) < 2.0
