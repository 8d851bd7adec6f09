"""The pipeline's stages against brute force, and the entry without the training-data folders."""

import hashlib
import random
import re
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from cairn.llm._work import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def sentence(rng, n):
    return " ".join("".join(rng.choices(["th", "er", "on", "an", "re", "he", "in", "ed"], k=rng.randrange(1, 4))) for _ in range(n))


def test_stages_keep_what_they_should(spark, tmp_path):
    rng = random.Random(0)
    clean = [sentence(rng, 60) for _ in range(150)]
    toxic = [" ".join([sentence(rng, 20), "idiot", sentence(rng, 9), "moron clown", sentence(rng, 9)]) for _ in range(60)]
    item = sentence(rng, 30)
    dirty = [sentence(rng, 40) + " " + item for _ in range(5)]
    barely = sentence(rng, 900) + " " + " ".join(item.split()[:14])
    near = [c.rsplit(" ", 1)[0] + f" tail{k}" for k, c in enumerate(clean[:20])]
    texts = clean + toxic + dirty + [barely] + near + clean[30:50] + ["", None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(150 <= i < 210)) for i in range(210)], "doc_id long, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == COLUMNS
        out = tmp_path / name.replace(" ", "-")
        docs.write.parquet(str(out))
        docs = spark.read.parquet(str(out))
        kept[name] = {r.doc_id: r.text for r in docs.collect()}

    first = kept["toxicity"]
    assert not set(first) & set(range(150, 210)) and set(range(150)) | set(range(210, len(rows))) <= set(first)
    best = {}
    for i, t in first.items():
        best[t or ""] = max(best.get(t or "", i), i)
    assert set(kept["exact dedup"]) == set(best.values())
    sets = {i: {tuple((t or "").split()[k : k + 4]) for k in range(max(1, len((t or "").split()) - 3))} if (t or "").split() else set() for i, t in kept["exact dedup"].items()}
    linked = {b for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert set(kept["MinHash near-dedup"]) == set(sets) - linked and linked
    last = kept["benchmark decontamination"]
    assert set(kept["MinHash near-dedup"]) - set(last) == set(range(210, 215)) and 215 in last

    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in last.items()}


def test_stages_judge_each_row_by_itself(spark, tmp_path):
    rng = random.Random(1)
    item, base, near = sentence(rng, 30), sentence(rng, 60), sentence(rng, 60)
    rows = [(1, item), (1, sentence(rng, 40)), (2, base), (2, base), (3, base), (None, near), (4, near + " tail"), (4, near + " tail"), (None, item), (5, None), (5, ""), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("id", "score", "h", "row", "n", "rep", "maybe", "sha", "key", "`a.b`"):
        docs = docs.withColumn(c.strip("`"), F.lit(c))
    spark.createDataFrame([(k, int(k < 3)) for k in range(9)], "doc_id long, toxic int").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names, empty = docs.columns, docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, str(tmp_path)), "stage")
        empty = stage(spark, empty, str(tmp_path))
        assert docs.columns == names == empty.columns and empty.isEmpty()
    got = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert got in [sorted([rows[1], (3, base), (4, near + " tail"), (5, left)], key=repr) for left in ("", None)]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 4


def test_run_is_the_stages_in_order(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "MinHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < out.count() < 200


def test_entry_imports_without_the_subpackage(tmp_path):
    root = Path(corpus_pipeline.__file__).parent
    for name in ("cairn", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(root / name), str(tmp_path)], check=True)
    (tmp_path / "cairn/llm").rename(tmp_path / "gone")
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


def test_nothing_outside_imports_the_subpackage():
    root = Path(corpus_pipeline.__file__).parent
    for path in (root / "cairn").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"^\s*(from|import)\b.*\bllm\b", path.read_text(), re.M), path


@pytest.mark.parametrize("kind,name", [("parquet", "row_"), ("parquet", "ROW_"), ("orc", "maybe_"), ("json", "Maybe_"), ("made", "row__")])
def test_stages_keep_columns_of_any_name_and_format(spark, tmp_path, kind, name):
    rng = random.Random(4)
    item, base = sentence(rng, 30), sentence(rng, 60)
    rows = [(1, item, "A"), (2, base, "B"), (3, base, "C"), (4, base + " tail", "D"), (5, sentence(rng, 50), "E")]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {name} string").withColumn("row__" if name != "row__" else "row_", F.lit("x"))
    if kind != "made":
        docs.write.format(kind).save(str(tmp_path / "docs"))
        docs = spark.read.schema(docs.schema).format(kind).load(str(tmp_path / "docs"))
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stored(stage(spark, docs, str(tmp_path)), "stage")
    assert docs.columns == names
    assert sorted((r.doc_id, r[name]) for r in docs.collect()) == [(3, "C"), (5, "E")]
