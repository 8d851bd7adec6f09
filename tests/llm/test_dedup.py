"""Exact, near and line dedup against brute force."""

import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.llm._work import with_rows
from cairn.llm import bloom, components, exact_dedup, line_dedup, near_dedup


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_exact_dedup_odd_rows(odd, none):
    got = rows_of(exact_dedup.exact_dedup(odd, bits_per_row=64), "doc_id", "keep_id", "group_size", "kept")
    six = [(5, 7, 4, False), (5, 7, 4, False), (7, 7, 4, True), (None, 7, 4, False)]
    assert [r for r in got if r[2] == 4] == sorted(six, key=repr)
    assert [r for r in got if r[1] == 9] == sorted([(8, 9, 3, False), (9, 9, 3, True), (None, 9, 3, False)], key=repr)
    assert len(got) == 14 and exact_dedup.exact_dedup(none).isEmpty()


def test_exact_dedup_is_exact_with_a_full_filter(spark):
    rng = random.Random(3)
    rows = [(i, str(rng.randrange(300))) for i in range(1500)]
    best, size = {}, {}
    for i, t in rows:
        best[t], size[t] = max(best.get(t, i), i), size.get(t, 0) + 1
    want = sorted(((i, best[t], size[t], best[t] == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in rows), key=repr)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # a filter far too small only lets more rows through
    for bits, each in ((1 << 16, 16), (1 << 30, 16), (1 << 16, 200)):  # the last makes five filters by ranges of hashes
        assert rows_of(exact_dedup.exact_dedup(docs, bits_per_row=each, most_bits=bits, salts=3), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want


def test_copies_and_rows_that_go(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (2, "a"), (3, "b"), (3, "c"), (None, "d"), (None, "d"), (None, None), (4, "")]
    docs = with_rows(spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("h", F.lit("x")))
    left = bloom.without_rows(docs, exact_dedup.exact_copies(docs))
    assert left.columns == ["doc_id", "text", "id", "h"]
    assert rows_of(left, "doc_id", "text") == sorted([(2, "a"), (3, "b"), (3, "c"), (None, "d"), (4, "")], key=repr)


def test_bloom_filter_counts_twice(spark):
    h = spark.range(20_000).selectExpr("xxhash64(id % 15000) AS h")
    bits = bloom.filter_bits(20_000, 16, 1 << 30)
    held = bloom.build(h, bits, 2)
    shown = h.distinct().select("h", bloom.might_contain(held, bits, F.col("h")).alias("m"))
    twice = {r.h for r in h.groupBy("h").count().filter("count > 1").collect()}
    hit = {r.h for r in shown.filter("m").collect()}
    assert twice <= hit and len(hit - twice) < 500


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    want = {x: find(x) for p in pairs for x in p if p[0] != p[1] or any(x in q and q[0] != q[1] for q in pairs)}
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: min(x for x in want if want[x] == v) for k, v in want.items()}
    assert components.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def brute(rows, width=4, percent=80):
    """Component and set size of each row by comparing all pairs."""
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    comp = {i: i for i in sets}
    order = sorted(sets)
    for x in order:
        for y in order:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = comp[x], comp[y]
                if a != b:
                    comp = {k: (min(a, b) if v in (a, b) else v) for k, v in comp.items()}
    return sorted(((i, len(sets[i]), comp[i], comp[i] == i) for i in sets), key=repr)


@pytest.mark.parametrize("seed", [0, 1])
def test_near_dedup_matches_brute_force_on_a_large_family(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    rows, n = [], 0
    for size, length in ((120, 150), (40, 60), (10, 20)):
        base = rng.choices(vocabulary, k=length)
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, length // 12))):
                copy[rng.randrange(length)] = rng.choice(vocabulary)
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n + i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 40)))) for i in range(60)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(near_dedup.near_dedup(docs), "doc_id", "n_shingles", "component_id", "kept") == brute(rows)


def test_near_dedup_with_many_blocks_and_salts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "PER_TASK", 5)
    monkeypatch.setattr(near_dedup, "DEALT", 20)
    monkeypatch.setattr(near_dedup, "PIVOTS", 2)
    rng = random.Random(9)
    base = [f"w{rng.randrange(400)}" for _ in range(60)]
    rows = []
    for k in range(70):  # a chain of copies that drift apart, so pivots leave many of them
        base[rng.randrange(60)] = f"w{rng.randrange(400)}"
        rows.append((k, " ".join(base)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(near_dedup.near_dedup(docs), "doc_id", "n_shingles", "component_id", "kept") == brute(rows)


def test_near_copies_are_judged_row_by_row(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(5, a), (5, b), (3, b + " end"), (7, a + " end"), (7, a + " end"), (None, a), (9, ""), (9, None), (None, "c d e f g")]
    docs = with_rows(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("rep", F.lit("x")))
    left = bloom.without_rows(docs, near_dedup.near_copies(docs))
    assert rows_of(left, "doc_id", "text") == sorted([(5, a), (3, b + " end"), (9, ""), (9, None), (None, "c d e f g")], key=repr)
    got = rows_of(near_dedup.near_dedup(docs.drop("row_")), "doc_id", "component_id")
    assert got == sorted([(5, 5), (5, 3), (3, 3), (7, 5), (7, 5), (None, 5), (9, 9), (9, 9), (None, None)], key=repr)


def test_near_dedup_odd_rows(odd, none):
    got = rows_of(near_dedup.near_dedup(odd), "doc_id", "n_shingles", "component_id", "kept")
    assert [r for r in got if r[1] == 3] == sorted([(5, 3, -3, False)] * 2 + [(7, 3, -3, False), (None, 3, -3, False), (-3, 3, -3, True)], key=repr)
    assert [r for r in got if r[1] == 0] == sorted([(8, 0, 8, True), (9, 0, 9, True), (10, 0, 10, True), (None, 0, None, True)], key=repr)
    assert len(got) == 14 and near_dedup.near_dedup(none).isEmpty()


def test_signature_agreement_follows_similarity():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    for same in (400, 300, 100, 0):
        other = np.concatenate((base[:same], rng.integers(0, 2**63, 400 - same).astype(np.uint64)))
        sig = near_dedup.signatures(np.concatenate((base, other)), np.array([0, 400, 800]), 512)
        assert abs((sig[0] == sig[1]).mean() - same / (800 - same)) < 0.1


def test_shingle_sets_of_batches_and_slices_agree():
    texts = pa.array(["a b c d e", "", "  ", "A b\tc", "a b c d e", None])
    value, at = near_dedup.shingle_sets(texts.fill_null(""), 4)
    assert np.diff(at).tolist() == [2, 0, 0, 1, 2, 0] and (value[:2] == value[at[4] : at[5]]).all()


def reference_lines(rows, least_docs=3, least_tokens=3, depth=3, percent=80):
    """The template tree one line at a time."""
    mask = lambda t: "<*>" if re.search("[0-9]", t) else t
    lines, docs_of = [], {}
    for row, (i, text) in enumerate(rows):
        for pos, line in enumerate((text or "").split("\n")):
            tokens = tuple(mask(t) for t in re.split(r"[ \t\r\f\x0b]+", line) if t)
            if len(tokens) >= least_tokens:
                lines.append((row, pos, tokens))
                docs_of.setdefault(tokens, set()).add((i, text or ""))
    leaves = {}
    for tokens, docs in docs_of.items():
        leaves.setdefault((len(tokens), tokens[:depth]), []).append((-len(docs), " ".join(tokens), tokens))
    number, members = {}, {}
    for leaf, found in leaves.items():
        if sum(-n for n, _, _ in found) < least_docs:
            continue
        templates = []
        for _, _, tokens in sorted(found):
            scored = [(-sum(a == b != "<*>" for a, b in zip(t, tokens)), -t.count("<*>"), k) for k, t in enumerate(templates)]
            k = min(scored)[2] if scored else None
            if k is not None and 100 * sum(a == b for a, b in zip(templates[k], tokens)) >= percent * len(tokens):
                templates[k] = tuple(a if a == b else "<*>" for a, b in zip(templates[k], tokens))
            else:
                templates.append(tokens)
                k = len(templates) - 1
            number[tokens] = leaf, k
            members.setdefault((leaf, k), set()).update(docs_of[tokens])
    gone = {(row, pos) for row, pos, tokens in lines if tokens in number and len(members[number[tokens]]) >= least_docs}
    out = []
    for row, (i, text) in enumerate(rows):
        parts = (text or "").split("\n")
        out.append((i, len(parts), sum((row, p) in gone for p in range(len(parts))), "\n".join(t for p, t in enumerate(parts) if (row, p) not in gone)))
    return sorted(out, key=repr)


def test_line_dedup_matches_the_tree(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        lines = [" ".join(rng.choices("red green blue cat dog".split(), k=rng.randrange(1, 7))) for _ in range(rng.randrange(6))]
        lines += [f"User {rng.randrange(99)} signed in from the {rng.choice(['web', 'shop', 'desk'])} today again and left"] * rng.randrange(2)
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    got = rows_of(line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_lines", "n_dropped", "text")
    want = reference_lines(rows)
    assert got == want and sum(r[2] for r in got) > 20


def test_line_dedup_odd_rows(odd, none, odd_rows):
    got = rows_of(line_dedup.line_dedup(odd), "doc_id", "n_lines", "n_dropped", "text")
    assert got == reference_lines(odd_rows)
    assert line_dedup.line_dedup(none).isEmpty()


def test_line_dedup_query_drops_what_two_documents_share(spark, tmp_path):
    long = "a rather long line that stands in exactly two of the documents and nowhere else"
    rows = [(1, f"{long}\nown text of one here\nShare\nPage 3"), (2, f"own text of two there\n{long}\nShare\nonce"), (3, "Page 12\nRead more\n\ntwice\ntwice"), (4, "\nnothing to see"), (None, None), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = rows_of(line_dedup.op8_line_dedup(spark, str(tmp_path)), "doc_id", "n_lines", "n_dropped", "text")
    assert got == reference_lines(rows, 2, 1)
    assert {r[0]: r[3] for r in got} == {1: "own text of one here", 2: "own text of two there\nonce", 3: "Read more\n\ntwice\ntwice", 4: "\nnothing to see", None: "", 5: ""}


class PlainLeaf:
    """Every template is compared with every line."""

    def __init__(self, depth, percent):
        self.rows, self.percent = [], percent

    def add(self, tokens):
        scored = [(-sum(a == b != "<*>" for a, b in zip(t, tokens)), -t.count("<*>"), k) for k, t in enumerate(self.rows)]
        k = min(scored)[2] if scored else None
        if k is not None and 100 * sum(a == b for a, b in zip(self.rows[k], tokens)) >= self.percent * len(tokens):
            self.rows[k] = [a if a == b else "<*>" for a, b in zip(self.rows[k], tokens)]
            return k
        self.rows.append(list(tokens))
        return len(self.rows) - 1


@pytest.mark.parametrize("percent", [60, 80])
def test_leaf_index_gives_the_template_of_a_whole_search(monkeypatch, percent):
    monkeypatch.setattr(line_dedup.Leaf, "FRESH", 5)
    rng = random.Random(4)
    for width in (3, 4, 5, 6, 10, 17):
        for words in (2, 12):
            for lead in (["a", "<*>", "b"], ["<*>", "<*>", "<*>"], ["a", "b", "c"]):
                leaf, plain = line_dedup.Leaf(width, 3, percent), PlainLeaf(3, percent)
                for _ in range(150):
                    base = [rng.choice(["<*>", *(f"w{k}" for k in range(words))]) if rng.random() < 0.6 else "k" for _ in range(width - 3)]
                    tokens = lead + base
                    assert leaf.add(tokens) == plain.add(tokens)
                word = {n: t for t, n in leaf.code.items()}
                assert [[word[int(n)] for n in leaf.rows[:, k]] for k in range(leaf.used)] == plain.rows


@pytest.mark.parametrize("lead, varying", [("a b c", 4), ("<*> <*> <*>", 4), ("a b c", 9)])
def test_leaf_of_unlike_lines_that_share_most_places(lead, varying):
    """Lines with five constant tokens behind the leading ones, or none: each is a template of its own."""
    rng = random.Random(5)
    leaf = line_dedup.Leaf(12, 3, 80)
    began = time.monotonic()
    for k in range(20_000):
        tokens = lead.split() + [f"k{p}" for p in range(9 - varying)] + [f"v{p}_{k if p % 2 else rng.randrange(10_000)}" for p in range(varying)]
        leaf.add(tokens)
    assert leaf.used > 19_900 and time.monotonic() - began < 20  # a few agree by chance


def test_line_dedup_of_many_lines_in_a_text_and_a_leaf(spark):
    same = [f"{k} same line of all" for k in range(80_000)]
    other = [f"user logged in from place{k} with name{k} at gate{k % 7}" for k in range(20_000)]
    letters = str.maketrans("0123456789", "abcdefghij")
    text = "\n".join(same + [o.translate(letters) for o in other])
    docs = spark.createDataFrame([(1, text), (2, "0 same line of all\nown")], "doc_id long, text string")
    began = time.monotonic()
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs, 2, 1).collect()}
    assert got[1].n_dropped == 80_000 and got[1].n_lines == 100_000 and got[2].text == "own" and time.monotonic() - began < 60


def test_null_ids_link(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(1, a), (None, a + " end"), (None, b), (None, b + " end"), (None, "one of its own kind here"), (4, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(near_dedup.near_dedup(df), "doc_id", "component_id", "kept")
    assert got == sorted([(1, 1, True), (None, 1, False), (None, None, True), (None, None, True), (None, None, True), (4, 4, True)], key=repr)
    docs = with_rows(df)
    left = rows_of(bloom.without_rows(docs, near_dedup.near_copies(docs)), "doc_id", "text")
    assert [r for r in left if r[1] != b and r[1] != b + " end"] == sorted([(1, a), (None, rows[4][1]), (4, "x y z")], key=repr) and len(left) == 4
