"""Search, graph and prompts against small referees in plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import context as P
from cairn.operators import enrich as I
from cairn.operators import graph as G
from cairn.operators import search as S

DOCS = "repo_id string, node_id string, path string, start_line int, text string"


def referee(texts, query, k):
    docs = [t.lower().split() for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = {}
    for d in docs:
        for w in set(d):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
    score = [sum(idf.get(q, 0) * d.count(q) * 2.5 / (d.count(q) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for q in query.lower().split()) for d in docs]
    return sorted(range(n), key=lambda i: (-round(score[i], 6), i))[:k] if query.split() else []


@pytest.mark.parametrize("seed", range(3))
def test_bm25_matches_the_referee(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    texts = ["all " + " ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(14)]
    asked = ["w1 w2 w2", "W3", "nothing", "", "all", "w5 all nothing"]
    docs = spark.createDataFrame([("r", str(i), "p", i, t) for i, t in enumerate(texts)], DOCS)
    got = S.bm25_search(docs, spark.createDataFrame(list(enumerate(asked)), "query_id long, text string"), 5).collect()
    for q, text in enumerate(asked):
        assert [int(r.node_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == referee(texts, text, 5)


def test_bm25_of_nothing(spark):
    docs = spark.createDataFrame([("r", "1", "p", 1, "a b")], DOCS)
    ask = spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert S.bm25_search(docs, ask, 0).isEmpty() and S.bm25_search(docs.limit(0), ask, 3).isEmpty()


def test_vector_search_order_and_edges(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("z", [0.0, 0.0]), ("n", None), ("a", [0.9, 0.1])]
    e = spark.createDataFrame(rows, "node_id string, embedding array<double>")
    ask = spark.createDataFrame([(1, [1.0, 0.0]), (2, []), (3, None)], "query_id long, embedding array<double>")
    got = S.vector_search(e, ask, 4).orderBy("rank").collect()
    assert [(r.query_id, r.node_id) for r in got] == [(1, "a"), (1, "b"), (1, "z")]
    assert S.vector_search(e, ask, 0).isEmpty()


def nearest(rows, asked, k):
    """Places of the first k rows of each query by rounded distance, then id; without a distance last."""
    out = {}
    for query, q in asked:
        scored = []
        for name, v in rows:
            v, u = np.array(v), np.array(q)
            with np.errstate(divide="ignore", invalid="ignore"):
                d = round(1 - float(v @ u) / float(np.linalg.norm(v) * np.linalg.norm(u)), 6) + 0.0 if v.any() and u.any() else None
            scored.append((d is None, d or 0.0, name))
        out[query] = list(dict.fromkeys(name for _, _, name in sorted(scored)[:k]))
    return out


@pytest.mark.parametrize("kind", ["clustered", "even", "hot"])
def test_vector_search_is_exact_and_skips_blocks(spark, monkeypatch, kind):
    rng = np.random.default_rng(3)
    at = rng.normal(size=(20, 12))
    noise = {"clustered": 0.02, "even": 3.0, "hot": 0.02}[kind]
    rows = [(f"n{i:04}", (at[i % 20] + noise * rng.normal(size=12)).tolist()) for i in range(2000)]
    if kind == "hot":  # a third of all rows are equal, ids included
        rows += [("n0000", rows[0][1])] * 500 + [(f"z{i:03}", rows[0][1]) for i in range(500)]
    rows += [(f"zero{i}", [0.0] * 12) for i in range(3)]
    asked = [(i, rows[i * 37][1]) for i in range(30)] + [(90, [0.0] * 12), (91, (-at[0]).tolist())]
    monkeypatch.setattr(S, "BLOCK_FLOATS", 12 * 40)
    e = spark.createDataFrame(rows, "node_id string, embedding array<double>")
    ask = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    index = S.vector_index(e, 32)
    got = {}
    for r in sorted(S.search_index(index, ask, 7).collect(), key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append(r.node_id)
    assert got == nearest(rows, asked, 7)
    sizes = [r.n for r in index.blocks.select(F.size("ids").alias("n")).collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 80
    some = ask.filter("query_id < 90")
    first = S.openings(index, some, 7)
    reached = S.search_index(index, some, 7).groupBy("query_id").agg(F.max("distance").alias("reached"))
    both = first.unionByName(S.openings(index, some.join(reached, "query_id"), 7, again=True))
    share = both.agg(F.sum(F.size("asks"))).first()[0] / (30 * len(sizes))
    assert kind == "even" or share < (0.2 if kind == "clustered" else 0.7)


def test_vector_blocks_stay_in_their_buckets(spark):
    e = spark.createDataFrame([(str(i), [float(i), 1.0]) for i in range(50)], "node_id string, embedding array<double>")
    index = S.vector_index(e, 4)
    plan = S.openings(index, e.select(F.col("node_id").cast("long").alias("query_id"), "embedding"), 3).hint("shuffle_merge").join(index.blocks, "block")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(block") == 1, plan


def test_vector_search_of_nothing_and_of_zeros(spark):
    e = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [])], "node_id string, embedding array<double>")
    ask = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [tuple(r) for r in S.vector_search(e, ask, 3).orderBy("rank").collect()] == [(1, "a", None, 1), (1, "b", None, 2)]
    assert S.vector_search(e.limit(0), ask, 3).isEmpty() and S.vector_search(e, ask.limit(0), 3).isEmpty()


def test_fusion_keeps_first_appearance_on_ties(spark):
    one = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id long, node_id string, rank int")
    two = spark.createDataFrame([(1, "c", 1), (1, "b", 2)], "query_id long, node_id string, rank int")
    assert [r.node_id for r in S.rrf_fuse([one, two], 3).orderBy("rank").collect()] == ["b", "a", "c"]


def test_subgraph_is_bounded_breadth_first_search(spark):
    rng = random.Random(5)
    pairs = {(rng.randrange(40), rng.randrange(40)) for _ in range(45)}
    edges = spark.createDataFrame([("g", f"{a}-{b}", str(a), str(b)) for a, b in pairs] + [("g", "open", "0", None)], "repo_id string, id string, source_id string, target_id string")
    seeds = spark.createDataFrame([(1, "g", "0"), (1, "g", "nowhere"), (2, "g", "7")], "query_id long, repo_id string, id string")
    near = {}
    for a, b in pairs:
        near.setdefault(str(a), set()).add(str(b))
        near.setdefault(str(b), set()).add(str(a))
    sizes = []
    for depth in (0, 1, 2, 5, 6):
        want = {}
        for q, s in ((1, "0"), (1, "nowhere"), (2, "7")):
            level, front = 0, {s}
            while front and level <= min(depth, 5):
                for x in front:
                    want[q, x] = min(level, want.get((q, x), 99))
                front, level = {y for x in front for y in near.get(x, ())} - {x for p, x in want if p == q}, level + 1
        got = {(r.query_id, r.id): r.level for r in G.subgraph_nodes(seeds, edges, depth).collect()}
        assert got == want
        sizes.append(len(got))
    assert sizes == sorted(sizes) and sizes[-1] == sizes[-2]


def test_prompt_tiers(spark):
    nodes = spark.createDataFrame([("g", i, "n", t, "p.py", f"m.{i}", k, "x\n" * 40 + "end", None) for k, (i, t) in enumerate([("a", "function"), ("b", "class"), ("m", "module")])], "repo_id string, id string, name string, type string, path string, qualified_name string, start_line int, raw_source string, summary string")
    edges = spark.createDataFrame([("g", "1", "a", "b", None, "calls"), ("g", "2", "m", "a", None, "defines")], "repo_id string, id string, source_id string, target_id string, target_ref string, type string")
    ranked = spark.createDataFrame([(1, "g", "a", 1)], "query_id long, repo_id string, id string, rank int")
    ask = spark.createDataFrame([(1, "why?"), (2, "lost")], "query_id long, text string")
    for budget, tier, lines in ((20_000, 0, 82), (330, 1, 41), (10, 2, 15)):
        got = {r.query_id: r for r in P.expand_and_prompt(ask, ranked, nodes, edges, 2, budget).collect()}
        text = got[1].prompt
        assert got[1].tier == tier and sum(x in ("x", "end") for x in text.split("\n")) == lines
        assert "m.a --[calls]--> b" in text and "[defines]" not in text and "> m.m" not in text
        assert got[2].prompt.endswith("=== QUESTION ===\nlost")


def test_first_lines_is_splitlines(spark):
    rows = ["a\nb\r\nc\rd\x0be\x85f g\n", "", "\n", "x", "a\n\n\nb", None]
    got = [r.t for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(T.first_lines(F.col("x"), 4).alias("t")).collect()]
    assert got == ["\n".join((x or "").splitlines()[:4]) for x in rows]


def test_packing_is_greedy(spark):
    rng = random.Random(1)
    tokens = [rng.randint(1, 60) for _ in range(60)] + [500]
    blocks = spark.createDataFrame([("r", str(i), i, t) for i, t in enumerate(tokens)], "repo_id string, id string, index int, tokens int")
    got = {int(r.id): r.batch_no for r in I.summary_batches(blocks, 5, 100, 7).collect()}
    want, count, total, number = {}, 0, 7, 0
    for i, t in enumerate(tokens):
        if count and (count >= 5 or total + t > 100):
            number, count, total = number + 1, 0, 7
        want[i], count, total = number, count + 1, total + t
    assert got == want


def test_embedding_halves_and_gives_up():
    calls = []

    def fn(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise ConnectionError
        return [[float(len(t))] for t in texts]

    assert I.embed_texts(["a", "bb"], fn, 0) == [[1.0], [2.0]]
    with pytest.raises(ConnectionError):
        I.embed_texts(["a", "bad"], fn, 0)
    assert calls == [2, 2, 1, 1, 1, 1]
    with pytest.raises(ValueError):
        I.embed_texts(["a"], lambda t: [], 0)


def test_parse_summaries(spark):
    rows = [("r", 0, '[{"id":"a","summary":"1"},{"id":"a","summary":"2"}]'), ("r", 1, '[{"id":"a","summary":"3"}]'), ("r", 2, ""), ("r", 3, "{["), ("r", 4, None)]
    good, bad = I.parse_summaries(spark.createDataFrame(rows, "repo_id string, batch_no int, response string"))
    assert [(r.id, r.summary) for r in good.collect()] == [("a", "3")] and [r.batch_no for r in bad.collect()] == [3]


@pytest.mark.parametrize("seed", range(3))
def test_bm25_bounds_and_blocks(spark, seed, monkeypatch):
    """Many documents, small blocks: bounds hold, blocks are skipped, and all scores are right, their signs too."""
    monkeypatch.setattr(S, "POSTINGS", 4)
    monkeypatch.setattr(S, "INVERTED", 300)
    monkeypatch.setattr(S, "SEEDS", 2)
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(500)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(150)] + ["only w1 w1 w1", ""]
    asked = [" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(25)] + ["w1", "only", "nothing here", "", "only nothing w2 w2"]
    docs = spark.createDataFrame([("r", f"{i:03}", "p", i, t) for i, t in enumerate(texts)], DOCS).repartition(3)
    got = S.bm25_search(docs, spark.createDataFrame(list(enumerate(asked)), "query_id long, text string"), 7).collect()
    for q, text in enumerate(asked):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [int(r.node_id) for r in mine] == referee(texts, text, 7)
        assert all(math.copysign(1, r.score) == 1 for r in mine if r.score == 0)


def test_bm25_reads_what_it_must(spark, monkeypatch):
    """A common term beside a rare one: the common one is open, so candidates are the rare one's documents."""
    docs = spark.createDataFrame([("r", str(i), "p", i, "common word " + ("rare " * 3 if i < 12 else f"x{i} y{i}")) for i in range(400)], DOCS).withColumn(S.WHOLE, F.lit(0))
    index = S.token_index(docs, [S.WHOLE])
    corpus = S._corpus(index, [S.WHOLE])
    blocks = S.postings(index, corpus, S.WHOLE)
    df = blocks.groupBy(S.WHOLE, "term").agg(F.sum(F.size("docs")).alias("df"), F.max("most").alias("top"))
    known = S._weights(df, corpus, [S.WHOLE]).filter("term in ('common', 'rare')").withColumn("query_id", F.lit(1)).withColumn("weight", F.col("idf"))
    found, parted = S.candidates(known.select(S.WHOLE, "query_id", "term", "weight", "df", "top"), blocks, S.WHOLE, 5)
    assert found.count() <= 12 and [r.term for r in parted.filter("open").collect()] == ["common"]
    assert blocks.filter("term = 'common'").count() >= 4 and blocks.agg(F.max(F.size("docs"))).first()[0] <= S.POSTINGS


def test_numbering_of_a_large_group(spark):
    from cairn.operators.numbering import numbered

    rng = random.Random(2)
    rows = [("big" if rng.random() < 0.8 else rng.choice(["a", "b", None]), rng.randrange(10**6), str(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k int, id string").repartition(6)
    out = numbered(df, ["g"], [F.col("k"), F.col("id")], ["id"])
    want = {}
    for g in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))):
            want[r[2]] = n
    assert {r.id: r["index"] for r in out.collect()} == want
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_packing_of_one_large_repository(spark):
    rng = random.Random(4)
    tokens = {"r": [rng.randint(1, 400) for _ in range(1500)], "s": [900], "t": [10] * 45}
    rows = [(r, f"{r}{i}", i, t) for r, ts in tokens.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "repo_id string, id string, index int, tokens int")
    want = {}
    for r, ts in tokens.items():
        number, count, total = 0, 0, 31
        for i, t in enumerate(ts):
            if count and (count >= 20 or total + t > 800):
                number, count, total = number + 1, 0, 31
            want[f"{r}{i}"], count, total = number, count + 1, total + t
    for stretch in (20, 64, 4096):
        assert {r.id: r.batch_no for r in I.summary_batches(df, 20, 800, 31, rows=stretch).collect()} == want
    assert I.summary_batches(df.limit(0)).isEmpty()


def test_prompts_join_only_the_sources_they_show(spark):
    """In tiers 1 and 2 no related source is joined, and lengths alone choose the tier."""
    nodes = spark.createDataFrame([("g", i, "n", "function", "p.py", f"m.{i}", k, "y" * 5000, None) for k, i in enumerate("abcdefgh")], "repo_id string, id string, name string, type string, path string, qualified_name string, start_line int, raw_source string, summary string")
    edges = spark.createDataFrame([("g", f"e{i}", "a", i, None, "calls") for i in "bcdefgh"], "repo_id string, id string, source_id string, target_id string, target_ref string, type string")
    ranked = spark.createDataFrame([(1, "g", "a", 1)], "query_id long, repo_id string, id string, rank int")
    ask = spark.createDataFrame([(1, "why?")], "query_id long, text string")
    (row,) = P.expand_and_prompt(ask, ranked, nodes, edges, 1, 20_000).collect()
    assert row.tier == 1 and row.prompt.count("y" * 5000) == 1 and len(row.prompt) < 20_000
    (row,) = P.expand_and_prompt(ask, ranked, nodes, edges, 1, 50_000).collect()
    exact = len(row.prompt)
    assert row.tier == 0 and row.prompt.count("y" * 5000) == 8
    for budget, tier in ((exact, 0), (exact - 1, 1)):
        assert P.expand_and_prompt(ask, ranked, nodes, edges, 1, budget).first().tier == tier
    assert "raw_source" not in P.sized_nodes(nodes).columns


def test_hops_leave_the_edges_where_they_lie(spark):
    rows = [("g", f"e{i}", "hub", f"n{i}") for i in range(500)] + [("g", "x", "n1", "far"), ("g", "y", "far", "n2"), ("g", "z", "n1", "far")]
    edges = spark.createDataFrame(rows, "repo_id string, id string, source_id string, target_id string")
    lists, hubs = G.adjacency(edges, longest=50)
    assert [(r.id, r.lists) for r in hubs.collect()] == [("hub", 10)]
    mine = [r.to for r in lists.filter("id = 'hub'").collect()]
    assert len(mine) == 10 and max(map(len, mine)) < 100 and sum(map(len, mine)) == 500
    front = spark.createDataFrame([(1, "g", "hub"), (2, "g", "far"), (3, "g", "none")], "query_id int, repo_id string, id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = G.neighbours(front, lists, hubs)
        plan = met._jdf.queryExecution().executedPlan().toString()
        shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "salt" in line]
        assert "Bucketed: true" in plan and len(shuffled) == 1  # the front's
        got = {(r.query_id, r.id) for r in met.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {(1, f"n{i}") for i in range(500)} | {(2, "n1"), (2, "n2")}


def test_a_hubs_edges_meet_only_queries_that_found_the_other_end(spark):
    """Every query finds the hub and one leaf of its own: an edge meets one query, not all of them."""
    n = 300
    edges = spark.createDataFrame([("g", f"e{i}", "hub", f"n{i}", None, "calls") for i in range(n)] + [("g", "in", "n1", "hub", "", "calls"), ("g", "open", "hub", None, "x", "calls")], "repo_id string, id string, source_id string, target_id string, target_ref string, type string")
    found = spark.createDataFrame([(q, "g", i, 0) for q in range(n) for i in ("hub", f"n{q}")], "query_id long, repo_id string, id string, level int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = G.subgraph_edges(found, edges)
        rows = sorted((r.query_id, r.id) for r in got.collect())
        plan, most = [got._jdf.queryExecution().executedPlan()], 0
        while plan:
            node = plan.pop()
            if "Join" in node.nodeName():
                most = max(most, node.metrics().apply("numOutputRows").value())
            plan += [node.children().apply(i) for i in range(node.children().size())]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert rows == sorted([(q, f"e{q}") for q in range(n)] + [(1, "in")])
    assert 0 < most <= n + 1


def test_found_relationships_are_those_of_the_context(spark):
    nodes = spark.createDataFrame([("g", i, i, t, "p.py", q, k, "", None) for k, (i, t, q) in enumerate([("m", "module", "m"), ("a", "class", "m.a"), ("b", "function", None), ("c", "function", "m.c")])], "repo_id string, id string, name string, type string, path string, qualified_name string, start_line int, raw_source string, summary string")
    ends = [("m", "a"), ("a", "b"), ("a", "c"), ("b", "a"), ("c", "m"), ("a", "ghost"), ("ghost", "a"), ("b", "b"), ("a", None)]
    edges = spark.createDataFrame([("g", f"e{k}", s, t, "r" if k % 2 else None, "calls") for k, (s, t) in enumerate(ends)], "repo_id string, id string, source_id string, target_id string, target_ref string, type string")
    ranked = spark.createDataFrame([(1, "g", "a", 1), (1, "g", "ghost", 2), (2, "g", "m", 1)], "query_id long, repo_id string, id string, rank int")
    found = G.subgraph_nodes(ranked, edges, 1)
    context = P.context_nodes(ranked, found, nodes)
    want = {r.query_id: r.relationships for r in P.render_relationships(context, G.subgraph_edges(found, edges)).collect()}
    got = {r.query_id: r.relationships for r in P.found_relationships(found, nodes, edges).collect()}
    assert got == want and len(got[1].splitlines()) == 5


def test_large_batches_are_worked_on_in_pieces(monkeypatch):
    import pandas as pd
    import pyarrow as pa

    monkeypatch.setattr(S, "COUNTED", 10)
    tokens = pa.array([["a", "b", "a"], [], ["c"] * 25, None, ["a"], ["b", "c"]], pa.list_(pa.string()))
    whole = pa.RecordBatch.from_arrays([pa.array(range(6)), tokens], ["doc", "tokens"]).slice(0, 6)
    made = list(S._counted(iter([whole, whole.slice(2, 3), whole.slice(0, 0)])))
    assert len(made) > 3 and all(b.num_rows == 1 or b.column("dl").to_numpy().sum() <= 10 for b in made)
    rows = [(r["doc"], r["dl"], dict(zip(r["terms"], r["counts"]))) for b in made for r in b.to_pylist()]
    want = [(0, 3, {"a": 2, "b": 1}), (1, 0, {}), (2, 25, {"c": 25}), (3, 0, {}), (4, 1, {"a": 1}), (5, 2, {"b": 1, "c": 1})]
    assert rows == want + want[2:5]
    assert [len(b) for b in I._slices(iter([pd.DataFrame({"x": range(600)})]))] == [256, 256, 88]


def _hub_graph(spark):
    """Two hubs that share neighbours; queries end at one, both or none, and meet some neighbours sooner."""
    rng = random.Random(3)
    pairs = {("hub", f"n{i}") for i in range(300)} | {("hub2", f"n{i}") for i in range(200, 420)} | {("hub", "a"), ("hub2", "a"), ("b", "hub"), ("c", "d"), ("hub", "ghost"), ("b", "n7")}
    pairs |= {(f"n{rng.randrange(420)}", f"n{rng.randrange(420)}") for _ in range(150)}
    edges = spark.createDataFrame([("g", f"{x}-{y}", x, y, None, "calls") for x, y in sorted(pairs)], "repo_id string, id string, source_id string, target_id string, target_ref string, type string")
    ranked = [(q, "g", s, k) for q, seeds in enumerate([["a"], ["b", "n3"], ["c"], ["n1", "n250"], ["hub"], ["hub", "hub2", "none"]]) for k, s in enumerate(seeds, 1)]
    ids = sorted({x for p in pairs for x in p} - {"ghost"})
    nodes = spark.createDataFrame([("g", i, i, "module" if k % 9 == 0 else "class", f"{rng.randrange(5)}.py", f"m.{i}", rng.randrange(4), "src", None) for k, i in enumerate(ids)], "repo_id string, id string, name string, type string, path string, qualified_name string, start_line int, raw_source string, summary string")
    want, near = {}, {}
    for x, y in pairs - {(x, x) for x, _ in pairs}:
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    for q, _, s, _ in ranked:
        level, front = 0, {s}
        for level in range(3):
            for x in front:
                want[q, x] = min(level, want.get((q, x), 9))
            front = {y for x in front for y in near.get(x, ())}
    return edges, spark.createDataFrame(ranked, "query_id long, repo_id string, id string, rank int"), nodes, want


def test_queries_that_end_at_a_hub_leave_its_lists_folded(spark, monkeypatch):
    edges, ranked, nodes, want = _hub_graph(spark)
    plain = G.adjacency
    monkeypatch.setattr(G, "adjacency", lambda edges: plain(edges, longest=40))
    found = G.reach(ranked, edges, 2)
    rows = [((r.query_id, r.id), r.level) for r in G.found_nodes(found).collect()]
    assert sorted(rows) == sorted(want.items())
    assert {r.query_id: r.hub for r in found.hub.collect()} == {0: "hub", 1: "hub", 3: "hub"}
    assert found.seen.filter("query_id = 1").count() < 60  # the 300 of the hub stand in its lists alone
    ids = {r.id for r in nodes.collect()}
    got = G.subgraph(ranked, nodes, edges, 2)[0].select("query_id", "id", "level", "qualified_name").collect()
    assert sorted((r.query_id, r.id, r.level) for r in got) == sorted((q, i, n) for (q, i), n in want.items() if i in ids)
    assert all(r.qualified_name == f"m.{r.id}" for r in got)


@pytest.mark.parametrize("most", [100_000, 20])
def test_context_of_folded_hubs_is_in_order(spark, monkeypatch, most):
    edges, ranked, nodes, want = _hub_graph(spark)
    plain = G.adjacency
    monkeypatch.setattr(G, "adjacency", lambda edges: plain(edges, longest=40))
    monkeypatch.setattr(P, "CHUNK", 16)
    monkeypatch.setattr(P, "MOST", most)
    found = G.reach(ranked, edges, 2)
    node = {r.id: r for r in nodes.collect()}
    seeds = {(r.query_id, r.id): r["rank"] for r in ranked.collect()}
    places, order = {}, sorted(((q, n, node[i].path, node[i].start_line, i) for (q, i), n in want.items() if i in node and (q, i) not in seeds))
    for q, _, _, _, i in order:
        places[q, i] = sum(1 for k in places if k[0] == q) + 1
    got = P.context_of(ranked, found, nodes).collect()
    assert {(r.query_id, r.id): r.pos for r in got if r.role == "RELATED"} == places
    assert sum(r.role == "RELATED" for r in got) == len(places)
    assert all(r.raw_source == "src" and r.path == node[r.id].path for r in got)
    primary = {(r.query_id, r.id): r.pos for r in got if r.role == "PRIMARY"}
    assert set(primary) == {k for k in seeds if k[1] in node}


def test_answers_hold_few_prompts_as_strings():
    import pyarrow as pa

    asked = []
    batch = pa.RecordBatch.from_pydict({"query_id": list(range(600)), "prompt": [None, *(f"p{i}" for i in range(1, 600))]})
    answer = lambda prompts: asked.append(len(prompts)) or [p and f" {p}! " for p in prompts]
    made = list(I._answered(answer, "prompt", "response")(iter([batch, batch.slice(0, 0)])))
    assert asked == [256, 256, 88] and all(b.schema.names == ["query_id", "prompt", "response"] for b in made)
    assert [r for b in made for r in b.column("response").to_pylist()] == ["", *(f"p{i}!" for i in range(1, 600))]
    with pytest.raises(ValueError):
        list(I._answered(lambda prompts: [], "prompt", "response")(iter([batch])))


@pytest.mark.parametrize("depth, longest", [(0, 40), (1, 40), (2, 40), (2, 1000), (3, 40)])
def test_edges_of_what_was_reached_are_those_between_found_nodes(spark, monkeypatch, depth, longest):
    """Between a hub's members, between them and nodes found row by row, loops and parallel edges; no row of a query
    that met a hub by its lists is asked for."""
    edges, ranked, nodes, _ = _hub_graph(spark)
    more = [("g", "loop", "n5", "n5", None, "calls"), ("g", "a" * 40, "hub", "n5", None, "again"), ("g", "open", "n5", None, "x", "calls"), ("g", "hubloop", "hub", "hub", None, "calls")]
    edges = edges.unionByName(spark.createDataFrame(more, edges.schema))
    plain = G.adjacency
    monkeypatch.setattr(G, "adjacency", lambda edges: plain(edges, longest=longest))
    found = G.reach(ranked, edges, depth)
    assert (found.hub is not None) == (depth > 0 and longest == 40)
    known = {(r.query_id, r.id) for r in G.found_nodes(found).collect()}
    modules = {r.id for r in nodes.filter("type = 'module'").collect()}
    rows = edges.collect()
    for but in (set(), modules):
        want = sorted((q, *e) for e in rows for q in range(6) if (q, e.source_id) in known and (q, e.target_id) in known and not {e.source_id, e.target_id} & but)
        got = G.reached_edges(found, edges, nodes.filter("type = 'module'").select("repo_id", "id") if but else None)
        key = lambda r: tuple(map(str, r))
        assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


def test_relationships_of_what_was_reached_are_those_of_the_context(spark, monkeypatch):
    edges, ranked, nodes, _ = _hub_graph(spark)
    edges = edges.unionByName(spark.createDataFrame([("g", i, "n5", "n6", None, "calls") for i in ("a" * 40, "f" * 40, "g" * 40, "B" * 40)], edges.schema))
    plain = G.adjacency
    monkeypatch.setattr(G, "adjacency", lambda edges: plain(edges, longest=40))
    found = G.reach(ranked, edges, 2)
    every = G.found_nodes(found)
    want = P.render_relationships(P.context_nodes(ranked, every, nodes), G.subgraph_edges(every, edges))
    got = P.reached_relationships(found, nodes, edges)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 4
    assert dict(G.packed_edges(found, edges).dtypes)["id"] == "binary"  # as ids reach their queries


def test_links_are_shuffled_once_and_parallel_ones_are_told_apart_in_their_list(spark):
    """Parallel edges and edges both ways are one neighbour, in one list; no shuffle but that to the lists is made."""
    rows = [("g", f"e{i}", *p) for i, p in enumerate([("hub", f"n{k % 100}") for k in range(400)] + [(f"n{k}", "hub") for k in range(100)])]
    edges = spark.createDataFrame(rows, "repo_id string, id string, source_id string, target_id string")
    shuffled, plain = [], G.bucketed
    try:
        G.bucketed = lambda df, *more: shuffled.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, *more)
        lists, hubs = G.adjacency(edges, longest=50)
    finally:
        G.bucketed = plain
    assert "Aggregate" not in shuffled[0] and "Exchange hashpartitioning(repo_id" not in shuffled[0]
    found = [t for r in lists.filter("id = 'hub'").collect() for t in r.to]
    assert sorted(found) == sorted(f"n{k}" for k in range(100)) and [r.id for r in hubs.collect()] == ["hub"]


def test_only_what_a_hub_lists_is_left_out_of_it(spark, monkeypatch):
    """Of the nodes a query has seen, those that its hub doesn't list don't go to the hub's lists."""
    edges, ranked, nodes, want = _hub_graph(spark)
    plain = G.adjacency
    monkeypatch.setattr(G, "adjacency", lambda edges: plain(edges, longest=40))
    found = G.reach(ranked, edges, 2)
    listed = {r.id for r in G.hub_members(found).collect()}
    most = []
    collect = F.collect_list
    monkeypatch.setattr(G.F, "collect_list", lambda c: most.append(c) or collect(c))
    rest = G._of_hubs(found, found.lists, lambda x: x)
    plan = rest._jdf.queryExecution().optimizedPlan().toString()
    assert most == ["id"] and plan.count("adjacency") == 2  # the lists themselves, and their members for what is left out
    got = sorted((r.query_id, r.to) for r in rest.collect())
    seen = {(r.query_id, r.id) for r in found.seen.collect()}
    assert got == sorted((q, i) for q in (0, 1, 3) for i in listed if (q, i) not in seen) and len(got) > 300


def test_rows_laid_into_chunks_are_shuffled_to_them_once(spark, monkeypatch):
    edges, ranked, nodes, _ = _hub_graph(spark)
    plain = G.adjacency
    monkeypatch.setattr(G, "adjacency", lambda edges: plain(edges, longest=40))
    monkeypatch.setattr(P, "CHUNK", 16)
    plan = P.context_of(ranked, G.reach(ranked, edges, 2), nodes)._jdf.queryExecution().executedPlan().toString()
    moved = plan[: plan.index("REPARTITION_BY_NUM")]
    assert plan.count("REPARTITION_BY_NUM") == 1 and "collect_list(node" in moved and "Window" not in moved[moved.index("collect_list(node") :]
