"""Resolution of references in small repositories."""

from cairn.operators import extract as X
from cairn.operators import resolve as R


def resolved(spark, files, repo="r"):
    rows = [(repo, p, s) for p, s in files.items()] if isinstance(files, dict) else files
    e = X.extract(spark.createDataFrame(rows, "repo_id string, path string, source string"))
    nodes, edges = X.nodes_of(e), X.edges_of(e)
    name = {(r.repo_id, r.id): r.qualified_name for r in nodes.collect()}
    out = R.resolve_edges(edges, nodes).filter("type <> 'defines'").collect()
    return {(name[r.repo_id, r.source_id], r.target_ref): name.get((r.repo_id, r.target_id)) for r in out}


def test_calls(spark):
    got = resolved(spark, {
        "a.py": "from b import f, g as h\nfrom c import *\nimport b\nclass K:\n    def m(self):\n        self.n()\n        self.top()\n        f(); h(); g(); b.f(); star(); K(); nope()\n    def n(self): pass\ndef top(): pass\n",
        "b.py": "def f(): pass\ndef g(): pass\n", "c.py": "def star(): pass\n",
    })
    at = lambda ref: got["a.K.m", ref]
    assert (at("self.n"), at("self.top"), at("f"), at("star"), at("K")) == ("a.K.n", "a.top", "b.f", "c.star", "a.K")
    assert [at(x) for x in ("h", "g", "b.f", "nope")] == [None] * 4
    assert got["a", "b"] == "b" and got["a", "c"] == "c"


def test_packages_are_no_import_targets(spark):
    got = resolved(spark, {"a.py": "import p\nimport p.q\n", "p/__init__.py": "x = 1\n", "p/q.py": "y = 1\n"})
    assert got["a", "p"] is None and got["a", "p.q"] == "p.q"


def test_inherits_steps(spark):
    got = resolved(spark, {
        "a.py": "from b import B\nfrom c import *\ndef L(): pass\nclass X(B): pass\nclass Y(C): pass\nclass Z(Far): pass\nclass W(L): pass\nclass V(m.N): pass\n",
        "b.py": "class B: pass\n", "c.py": "class C: pass\n", "z/far.py": "class Far: pass\n", "y/far.py": "class Far: pass\nclass L: pass\n",
    })
    assert got["a.X", "B"] == "b.B" and got["a.Y", "C"] == "c.C" and got["a.Z", "Far"] == "y.far.Far"
    assert got["a.W", "L"] == "y.far.L" and got["a.V", "m.N"] is None


def test_first_of_equal_names_wins_and_repositories_stay_apart(spark):
    got = resolved(spark, [("r", "a.py", "def f(): pass\ndef f(x): pass\ndef g(): f()\n"), ("s", "a.py", "def g(): f()\n")])
    assert got["a.g", "f"] in ("a.f", None)
    both = resolved(spark, {"a.py": "def f(): pass\ndef f(x): pass\ndef g(): f()\n"})
    assert both["a.g", "f"] == "a.f"


def test_no_nested_loops_in_the_plan(spark):
    e = X.extract(spark.createDataFrame([("r", "a.py", "def f(): g()\n")], "repo_id string, path string, source string"))
    plan = R.resolve_edges(X.edges_of(e), X.nodes_of(e))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
