"""Golden files for extraction, one quirk each."""

import pytest
from pyspark.sql import functions as F

from cairn.functions import keys as K
from cairn.operators import extract as X


def edges(source, kind, path="pkg/sub/m.py"):
    return [e for e in X.extract_file("r", path, source)[1] if e["type"] == kind]


def refs(source, kind="calls", path="pkg/sub/m.py"):
    return [e["target_ref"] for e in edges(source, kind, path)]


def names(source, path="m.py"):
    return [n["qualified_name"] for n in X.extract_file("r", path, source)[0]]


@pytest.mark.parametrize("path, name", [("a/b.py", "a.b"), ("a/b.pyw", "a.b"), ("a\\b.py", "a.b"), ("/a//b.py/", "a.b"), ("a/__init__.py", "a.__init__")])
def test_dotted(path, name):
    assert X.dotted(path) == name


def test_only_direct_definitions_are_nodes():
    source = "if x:\n    def a(): pass\ntry:\n    class B: pass\nexcept E: pass\ndef f():\n    def g(): pass\nclass C:\n    class D:\n        def h(self): pass\n    async def m(self): pass\n"
    assert names(source) == ["m", "m.f", "m.C", "m.C.m"]


def test_calls_in_source_order_outer_first_once():
    assert refs("def f():\n    a(b).c()\n    a(1)\n    (g)(h)\n    x = f'{k(1)}'\n") == ["a(b).c", "a", "(g)", "k"]


def test_nested_functions_and_lambdas_are_not_entered_but_decorators_and_classes_are():
    source = "def f(x=d()):\n    @deco(1)\n    def g(y=e()): n()\n    z = lambda: q()\n    class C(base()):\n        v = w()\n        def m(self): no()\n    return [p(i) for i in r()]\n"
    assert refs(source) == ["deco", "base", "w", "p", "r"]


def test_dictionary_calls_keep_source_order():
    assert refs("def f():\n    return {a(): b(), c(): d()}\n") == ["a", "b", "c", "d"]


def test_module_and_class_level_calls_give_nothing():
    assert refs("x = a()\nclass C:\n    y = b()\n") == []


def test_arguments():
    source = "def f(a, /, b: int, *c: int, d=1, e: 'x' = 2, **k): pass\n"
    node = X.extract_file("r", "m.py", source)[0][1]
    assert node["attributes"]["args"] == {"a": None, "b": "int", "d": None, "e": "'x'", "k": None}


@pytest.mark.parametrize(
    "line, found",
    [
        ("import a.b as c, d", {"a.b": [("a.b", "c")], "d": [("d", None)]}), ("from m import x as y, z", {"m": [("x", "y"), ("z", None)]}), ("from m import *", {"m": [("*", None)]}),
        ("from . import a, b as c", {"pkg.sub.a": [("a", None)], "pkg.sub.b": [("b", "c")]}), ("from ..p import x", {"pkg.p": [("x", None)]}), ("from ..p import *", {"pkg.p": []}),
        ("from . import *", {"pkg.sub": [("*", None)]}), ("from ....p import x", {"p": [("x", None)]}), ("from __future__ import annotations", {}), ("from ....... import *", {}),
        ("from m import x\nfrom m import x, y", {"m": [("x", None), ("y", None)]}), ("from m import x, x", {"m": [("x", None), ("x", None)]}),
    ],
)
def test_imports(line, found):
    got = {e["target_ref"]: [(b["name"], b["alias"]) for b in e["attributes"]["bindings"]] for e in edges(line + "\n", "imports")}
    assert got == found


def test_spans_count_decorators_marks_and_bytes():
    source = "﻿# é\n@d\n@ e(1)\ndef f():\n    pass\n"
    node = X.extract_file("r", "m.py", source)[0][1]
    assert (node["start_line"], node["end_line"], node["attributes"]["decorators"]) == (2, 5, ["d", " e(1)"])
    assert source.encode()[node["start_byte"] : node["end_byte"]].decode() == node["raw_source"] == "@d\n@ e(1)\ndef f():\n    pass"


def test_bases_skip_keywords():
    assert refs("class A(b.B, C[int], metaclass=M, *more): pass\n", "inherits") == ["b.B", "C[int]", "*more"]


def test_broken_files_are_rejected_and_others_go_on(spark):
    rows = [("r", "a.py", "def f(:\n"), ("r", "b.py", "def g(): h()\n"), ("r", "c.py", "x = " + "(" * 5000), ("r", "d.py", None), ("r", "e.py", "a\0b")]
    out = X.extract(spark.createDataFrame(rows, "repo_id string, path string, source string"))
    assert {r.path for r in X.rejects_of(out).collect()} == {"a.py", "c.py", "e.py"}
    assert [r.qualified_name for r in X.nodes_of(out, "function").collect()] == ["b.g"]


def test_empty_table(spark):
    out = X.extract(spark.createDataFrame([], "repo_id string, path string, source string"))
    assert X.nodes_of(out).count() == X.edges_of(out).count() == X.rejects_of(out).count() == 0


def test_files_of_one_partition_are_dealt_to_all_cores(spark):
    rows = spark.createDataFrame([("r", f"p/m{i}.py", f"def f{i}(): pass\n") for i in range(400)], "repo_id string, path string, source string").coalesce(1)
    from pyspark.sql import functions as F

    found = X.extract(rows).select("path", F.spark_partition_id().alias("p"), F.size("nodes").alias("n")).collect()
    assert len(found) == 400 and all(r.n == 2 for r in found)
    assert len({r.p for r in found}) >= spark.sparkContext.defaultParallelism


def test_few_files_are_held_as_objects_at_a_time():
    import pandas as pd

    batch = pd.DataFrame({"repo_id": "r", "path": [f"m{i}.py" for i in range(X.FILES * 2 + 1)], "source": "x = 1\n"})
    made = list(X._extract(iter([batch])))
    assert [len(m) for m in made] == [X.FILES, X.FILES, 1] and [p for m in made for p in m.path] == list(batch.path)


def test_edges_are_judged_in_one_pass(spark):
    nodes = spark.createDataFrame([("g", "a"), ("g", "b"), ("g", "b"), ("h", "z")], "repo_id string, id string")
    rows = [("1", "a", "b", None, None), ("2", " ", "b", None, "blank source"), ("3", None, "q", None, "blank source"), ("4", "a", "", "x", "blank target"), ("5", "a", None, "", "no target"),
            ("6", "a", None, "x", None), ("7", "q", None, "x", "unknown source"), ("8", "q", "q", None, "unknown source"), ("9", "a", "z", None, "unknown target"), (" ", "q", "q", None, "blank id"), (None, "a", "b", None, "blank id"), ("b", "", "b", None, "blank source")]
    edges = spark.createDataFrame([("g", *r[:4]) for r in rows], "repo_id string, id string, source_id string, target_id string, target_ref string")
    judged = X.judge_edges(edges, nodes)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("ShuffledHashJoin") == 2 and "Broadcast" not in plan
    assert sorted(((r.id, r.reason) for r in judged.collect()), key=str) == sorted(((r[0], r[4]) for r in rows), key=str)
    good, bad = X.validate_edges(edges, nodes)
    assert good.columns == edges.columns and {r.id for r in good.collect()} == {"1", "6"} and bad.count() == 10


def test_packed_keys_come_back(spark):
    keys = ["da39a3ee5e6b4b0d3255bfef95601890afd80709", "DA39", "abc", "", "0a\n", "ü", "h00", None]
    rows = spark.createDataFrame([(k,) for k in keys], "id string").select("id", K.packed(F.col("id")).alias("p")).select("id", "p", K.unpacked(F.col("p")).alias("back")).collect()
    assert [r.back for r in rows] == keys and len(rows[0].p) == 21


@pytest.mark.parametrize("small, most, joins", [(0, 1_000_000, 1), (0, 1, 2), (10_000, 1_000_000, 2)])
def test_edges_of_few_unknown_targets_are_shuffled_by_their_sources_alone(spark, monkeypatch, small, most, joins):
    monkeypatch.setattr(X, "SMALL", small)
    monkeypatch.setattr(X, "MOST_UNKNOWN", most)
    nodes = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "z")], "repo_id string, id string")
    rows = [("1", "a", "b", None), ("2", " ", "q", "blank source"), ("3", "a", "", "blank target"), ("4", "a", None, "no target"), ("5", "q", "b", "unknown source"), ("6", "q", "q", "unknown source"), ("7", "a", "z", "unknown target"), ("8", "a", "a", None), ("8", "a", "q", "unknown target")]
    edges = spark.createDataFrame([("g", *r[:3], None) for r in rows] + [("h", "9", "z", "z", None)], "repo_id string, id string, source_id string, target_id string, target_ref string")
    judged = X.judge_edges(edges, nodes)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == joins and plan.count("BroadcastHashJoin") == 2 - joins and "SortMergeJoin" not in plan
    assert sorted(((r.id, r.reason) for r in judged.collect()), key=str) == sorted([(r[0], r[3]) for r in rows] + [("9", None)], key=str)
