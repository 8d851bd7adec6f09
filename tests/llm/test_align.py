"""Operator 11 against the contract in plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from cairn.llm import spill_count, token_align


def referee(rows):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in visible} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in visible)}
    docs, counts = [], Counter()
    for doc_id, text in rows:
        ga, links = [], Counter()
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bx = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
            by = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
            if b"".join(bx) == b"".join(by) == (" " + text).encode():
                i = j = ea = eb = 0
                one = [[], []]
                while i < len(x) or j < len(y):
                    if ea <= eb:
                        one[0].append(x[i])
                        ea += len(bx[i])
                        i += 1
                    else:
                        one[1].append(y[j])
                        eb += len(by[j])
                        j += 1
                    if ea == eb:
                        ga.append(one)
                        links.update((p, q) for p in one[0] for q in one[1])
                        one = [[], []]
        counts.update(links.keys())
        docs.append((doc_id, ga, links))
    top = defaultdict(int)
    for (p, _), n in counts.items():
        top[p] = max(top[p], n)
    out = []
    for doc_id, ga, links in docs:
        shown = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in ga)
        best = sum(m for (p, q), m in links.items() if counts[p, q] == top[p])
        total = sum(m * counts[k] for k, m in links.items())
        out.append((doc_id, sum(len(p) for p, _ in ga), sum(len(q) for _, q in ga), len(ga), links.total(), best, total, hashlib.sha256(shown.encode()).hexdigest() if ga else ""))
    return sorted(out, key=repr)


def ours(df, **more):
    import public_tokenizers as P

    got = token_align.align(df, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), **more)
    return sorted(([tuple(r) for r in got.collect()]), key=repr)


def test_whole_table_with_many_chunks_and_merges(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = referee(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert ours(df, chunk_bytes=20_000, radixes=7, fan=3) == want
    assert ours(df) == want


def test_odd_rows(spark, odd, odd_rows, none):
    assert ours(odd) == referee(odd_rows)
    assert ours(none) == []


def test_odd_texts(spark):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\n ", " \n", "\t", "a", "the", "don't", "12,345.6", "é", "ﬁ", "漢字", "😀", "<|endoftext|>", "</s>", "<0x41>", "▁", "\x00", "\x1c ", "　", "   x", "á", "-" * 40, "Zürich", "aaaa" * 30]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(1, 12)))) for i in range(400)] + [(900, "x" * 3000), (901, " "), (902, "\n"), (903, "ha" * 2000 + " b"), (904, "​\u0085  x")]
    assert ours(spark.createDataFrame(rows, "doc_id long, text string")) == referee(rows)


@pytest.mark.parametrize("text", ["a b", "a  b ", " a\n b", "a \nb", "\x85 a　 b  "])
def test_units_give_the_text_back(text):
    assert " " + " ".join(token_align.units(text)) == " " + text


def test_ranks_give_the_tokenizers_ids(spark, sf_dir):
    import public_tokenizers as P

    by = token_align.Aligner(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    rng = random.Random(7)
    texts += ["".join(rng.choices([*map(chr, range(127)), *"éÀßœ'sllve  "], k=30)) for _ in range(5000)]
    plain = [t for t in texts if token_align._PLAIN.fullmatch(t)]
    assert len(plain) > 5000 and [by.plain(t) for t in plain] == [x.ids for x in by.a.encode_batch_fast(plain, add_special_tokens=False)]


def test_merge_of_blocks_is_a_count():
    rng = random.Random(1)
    import numpy as np

    blocks, want = [], Counter()
    for _ in range(20):
        keys = np.array(sorted(rng.sample(range(300), 40)), np.int64)
        n = np.array([rng.randint(1, 5) for _ in keys], np.int64)
        want.update(dict(zip(keys.tolist(), n.tolist())))
        blocks += [(keys[a : a + 8], n[a : a + 8]) for a in range(0, 40, 8)]
    merger, got = spill_count._Merger(), []
    for keys, n in sorted(blocks, key=lambda x: x[0][0]):
        got += zip(*(x.tolist() for x in merger.add(keys, n)))
    got += zip(*(x.tolist() for x in merger.upto(1 << 62)))
    assert got == sorted(want.items())
