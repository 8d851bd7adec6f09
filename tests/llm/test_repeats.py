"""Operator 12 against brute force, and its corpus order."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cairn.llm import repeat_spans
from cairn.llm.prefix_free import repeated_windows


def referee(rows, size):
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(t[i : i + size] for _, t in texts for i in range(len(t) - size + 1))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - size + 1):
            if count[t[i : i + size]] > 1:
                gone[i : i + size] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def ours(df, **more):
    return sorted((tuple(r) for r in repeat_spans.remove_repeats(df, **more).drop("begins", "ends").collect()), key=repr)


def mixed(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    pool = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(8)] + ["a" * 90, "ab" * 70, "x"]
    made = []
    for i in range(n):
        text = " ".join(rng.choice(pool) if rng.random() < 0.5 else word() for _ in range(rng.randint(0, 12)))
        if made and rng.random() < 0.3:
            other = rng.choice(made)
            k = rng.randint(0, len(other))
            text = other[:k] + rng.choice(["", "Z", "é"]) + other[k:]
        made.append(text)
    return list(enumerate(made))


@pytest.mark.parametrize("seed,size,reach,most", [(1, 60, 32, 2000), (2, 40, 32, 2000), (3, 60, 32, 3), (4, 30, 16, 1), (5, 100, 64, 2)])
def test_small_windows(spark, seed, size, reach, most, monkeypatch):
    rows = mixed(seed, 120)
    monkeypatch.setattr(repeat_spans, "SLICE", 1500)
    assert ours(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size=size, reach=reach, most=most) == referee(rows, size)


def test_odd_rows(spark, odd, odd_rows, none):
    rows = [r for r in odd_rows if len(r[1] or "") < 1000] + [(40, "ab" * 600), (41, "ab" * 300), (42, None)]
    df = odd.select("doc_id", "text").filter("text is null or length(text) < 1000").unionByName(spark.createDataFrame(rows[-3:], "doc_id long, text string"))
    assert ours(df, size=24, reach=16) == referee(rows, 24)
    assert ours(none) == []
    assert ours(odd.filter("text is null")) == referee([r for r in odd_rows if r[1] is None], 400)


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = ours(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert got == referee(rows, 400) and any(r[2] for r in got)


def test_reach_must_fit(none):
    with pytest.raises(ValueError):
        repeat_spans.remove_repeats(none, size=20, reach=16)


def test_corpus_order():
    for seed in range(40):
        rng = random.Random(seed)
        size, alphabet = rng.choice([20, 60]), rng.choice([b"ab", b"a", bytes(range(97, 123)), b"\x00a"])
        pool = [bytes(rng.choices(alphabet, k=rng.randint(1, 200))) for _ in range(6)]
        texts = [b"".join(rng.choices(pool, k=rng.randint(1, 6))).ljust(size, b"q") for _ in range(rng.randint(1, 12))]
        windows = np.array([rng.randint(1, len(t) - size + 1) for t in texts])
        count = Counter(t[i : i + size] for t, w in zip(texts, windows) for i in range(w))
        assert [x.tolist() for x in repeated_windows(texts, windows, size)] == [[count[t[i : i + size]] > 1 for i in range(w)] for t, w in zip(texts, windows)]
