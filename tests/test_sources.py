from cairn.sources import files, store


def test_read_sources_sees_hidden_and_underscored_names(spark, tmp_path):
    for name, raw in {"__init__.py": b"", "_x.py": b"a\r\nb\rc\n", ".hid/d.py": b"\xff\xfe", "build/no.py": b"x", "a/venv/no.py": b"x", "a/b.py": b"x", "c.PY": b"x", "d.pyw": b"x"}.items():
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(raw)
    got = {r.path: r.source for r in files.read_sources(spark, str(tmp_path), "r").collect()}
    assert got == {"__init__.py": "", "_x.py": "a\nb\nc\n", ".hid/d.py": "��", "a/b.py": "x"}


def test_select_parseable(spark):
    rows = [("r", p, s) for p, s in (("a.py", "x"), ("b.PY", "x"), ("c.pyw", "x"), ("d.txt", "x"), ("e", "x"), ("f.py", " \n　\t"), (".py", "x"), ("g.py", None))]
    got = files.select_parseable(spark.createDataFrame(rows, "repo_id string, path string, source string"))
    assert sorted(r.path for r in got.collect()) == ["a.py", "b.PY", "c.pyw"]


def test_insert_is_idempotent(spark):
    rows = spark.createDataFrame([("r", "a", 1), ("r", "a", 2), ("s", "a", 3)], "repo_id string, id string, n int")
    new = store.insert_if_absent(rows.limit(0), rows, ["repo_id", "id"], ["n"])
    assert sorted((r.repo_id, r.n) for r in new.collect()) == [("r", 1), ("s", 3)]
    assert store.insert_if_absent(new, rows, ["repo_id", "id"], ["n"]).isEmpty()


def test_self_loop_is_incident_once(spark):
    edges = spark.createDataFrame([("r", "1", "a", "a"), ("r", "2", "a", "b"), ("r", "3", "c", None)], "repo_id string, id string, source_id string, target_id string")
    ids = spark.createDataFrame([("r", "a"), ("r", "b")], "repo_id string, id string")
    assert sorted(r.id for r in store.incident_edges(edges, ids).collect()) == ["1", "2"]


def test_many_roots_level_by_level(spark, tmp_path):
    want = set()
    for repo in ("a", "b"):
        for name in ("x.py", "deep/er/est/y.py", ".venv/no.py", "deep/venv/no.py", "_p/q.py", "n.txt"):
            at = tmp_path / repo / name
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(name)
            if name.endswith(".py") and "no" not in name:
                want.add((repo, name, name))
    (tmp_path / "a" / "link").symlink_to(tmp_path / "b")
    roots = spark.createDataFrame([(r, str(tmp_path / r)) for r in ("a", "b", "missing")], "repo_id string, root string")
    assert {tuple(r) for r in files.read_repositories(roots).collect()} == want


def test_batches_may_repeat_keys(spark):
    old = spark.createDataFrame([("a", "one", "p"), ("b", "two", "q")], "id string, name string, path string").selectExpr("*", "cast(null as timestamp) as indexed_at")
    new = spark.createDataFrame([("a", "z", "1", 1), ("a", "y", "2", 2), ("c", "x", "3", 1)], "id string, name string, path string, turn int")
    got = {r.id: (r.name, r.path) for r in store.upsert_repositories(old, new, order=["turn"]).collect()}
    assert got == {"a": ("y", "2"), "b": ("two", "q"), "c": ("x", "3")}
    langs = spark.createDataFrame([("a", ["x", "y"], 1), ("a", ["z", "z"], 2)], "id string, languages array<string>, turn int")
    had = spark.createDataFrame([("a", "old"), ("b", "go")], "repo_id string, language string")
    assert sorted(tuple(r) for r in store.replace_languages(had, langs, ["turn"]).collect()) == [("a", "z"), ("b", "go")]
    nodes = spark.createDataFrame([("r", "n", None), ("s", "n", "kept")], "repo_id string, id string, summary string")
    said = spark.createDataFrame([("r", "n", "first", 1), ("r", "n", "again", 2)], "repo_id string, id string, summary string, turn int")
    assert sorted(tuple(r) for r in store.update_summaries(nodes, said, ["turn"]).collect()) == [("r", "n", "again"), ("s", "n", "kept")]
    e = spark.createDataFrame([("r", "n", 0, "r"), ("s", "n", 0, "s")], "repo_id string, node_id string, chunk_index int, chunk_text string")
    assert sorted((r.repo_id, r.chunk_text) for r in store.upsert_embeddings(e, e.filter("repo_id = 's'").withColumn("chunk_text", store.F.lit("new")), ["chunk_text"]).collect()) == [("r", "r"), ("s", "new")]


def test_commits_swap_partitions_and_lookups_prune(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "repo_id string, id string, path string, start_line int"
    rows = spark.createDataFrame([(r, str(i), "p", i) for r in ("007", "7", "x") for i in range(5)], schema)
    store.commit_by_repo(rows, path)
    before = {f for f in (tmp_path / "t" / "repo_id=x").iterdir()}
    new = spark.createDataFrame([("007", "1", "changed", 1), ("007", "9", "p", 9)], schema)
    for _ in range(2):
        store.change_by_repo(path, schema, new, lambda old, rows: store.upsert(old, rows, ["repo_id", "id"], ["path"]))
        table = store.table_by_repo(spark, path, schema)
        got = {(r.repo_id, r.id): r.path for r in table.collect()}
        assert len(got) == 16 and got["007", "1"] == "changed" and got["7", "1"] == "p" and ("007", "9") in got
    assert {f for f in (tmp_path / "t" / "repo_id=x").iterdir()} == before
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(repo_id" in plan(store.nodes_by_repo(table, "007"))
    ids = spark.createDataFrame([(1, "007", "1"), (2, "zz", "1")], "query_id int, repo_id string, id string").filter("query_id < 2")
    assert "dynamicpruning" in plan(store.nodes_by_ids(table, ids)) and [r.path for r in store.nodes_by_ids(table, ids).collect()] == ["changed"]
