"""Operator 13 against the contract in plain Python and its SQL."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from cairn.llm import conversation_trie as C

SCHEMA = "conv_id long, turn int, role string, text string"


def referee(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    members = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        seq = own.get(c - c % 20, [])[:h] + own[c][h:]
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append((c, d == len(seq)))
    kids, out = {}, {}
    for key in members:
        if key:
            kids.setdefault(key[:-1], []).append(key)
    for key in sorted(members, key=len, reverse=True):
        saved = (len(members[key]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
        below = kids.get(key, [])
        out[key] = (sum(out[k][0] for k in below) or 1, saved + sum(out[k][1] for k in below))
    low = {k: min(c for c, _ in m) for k, m in members.items()}
    sha = lambda k: hashlib.sha256(",".join(map(str, sorted(c for c, end in members[k] if end))).encode()).hexdigest()
    return sorted(((low[k], len(k), low[k[:-1]] if k else None, len(m), len(kids.get(k, [])), *out[k], sha(k)) for k, m in members.items()), key=repr)


def ours(df, **more):
    got = C.trie(df, **more)
    assert got.columns == C.NODE
    return sorted((tuple(r) for r in got.collect()), key=repr)


def made(seed, n):
    rng = random.Random(seed)
    says = ["", None, "hi", "hi there you", "what is  it", "é 漢 ", "x"]
    rows = []
    for c in rng.sample(range(400), n):
        same = rng.random() < 0.4
        for t in range(rng.randint(1, 9)):
            rows.append((c, None if rng.random() < 0.1 else t, ["user", "bot", None][t % 3], "same text" if same else rng.choice(says)))
    rows += rng.sample(rows, 5) + [(None, 1, "user", "lost")]
    return rows


@pytest.mark.parametrize("seed,more", [(1, {}), (2, {"most": 3}), (3, {"most": 1}), (4, {"most_turns": 4}), (5, {"most": 20})])
def test_random_tables(spark, seed, more):
    rows = made(seed, 90)
    assert ours(spark.createDataFrame(rows, SCHEMA).repartition(3), **more) == referee(rows)


def test_one_long_conversation_and_equal_ones(spark):
    rows = [(7, t // 3, "user", f"t {t % 5}") for t in range(600)] + [(8, t // 3, "user", f"t {t % 5}") for t in range(600)]
    rows += [(100 + c, t, "user", f"same {t}") for c in range(60) for t in range(7)]
    assert ours(spark.createDataFrame(rows, SCHEMA), most=10, most_turns=100) == referee(rows)


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ours(none) == [] and ours(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)) == []
    rows = [(c, 0, None, None) for c in range(-30, 30)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([r for r in rows if r[0] >= 0], SCHEMA)
    for name in ("c", "pos", "tid", "words", "key", "parent", "index", "_at", "_part"):
        df = df.withColumn(name, F.lit("x"))
    assert ours(df) == referee([r for r in rows if r[0] >= 0])


def test_matches_sql(spark, sf_dir):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = sorted(c.sql(f"SELECT {', '.join(C.NODE)} FROM ({C.OP13_SQL})").fetchall(), key=repr)
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert ours(df) == want
    assert want == referee([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
