"""Tokens, toxicity, decontamination, licences, archives and HTML against brute force or round trips."""

import hashlib
import io
import random
import time
import re
import struct
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.llm import bpe_table, crc, decontaminate, fm_index, html_text, license_scan, token_records, toxicity, web_archive
from cairn.llm._work import small_batches, with_rows, work_dir
from cairn.llm.bloom import without_rows

P = pytest.importorskip("public_tokenizers")


def tokenizer(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    t.no_truncation()
    t.no_padding()
    return t


TEXTS = [None, "", "  ", "a b, c.", "It's <|endoftext|>here<|endoftext|> ok", "Über-naïve ÇA. İI ΣΑΣ ﬁ é é x́.", "123 4,5 ... ,. .", "x y　z w\x1c\x85v", "😀 hi", "word " * 20_000, "ǅ ŉ ẞ ſ, ŉ.", "don't 'S y'all", "\r\n\t\x0b a", "a\x00b"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(3, "a b, c."), (None, "null id")], "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("part", F.lit(2))


def test_token_records_equal_the_library(spark, texts, none):
    uri = work_dir(spark, "test")
    manifest = token_records.write_token_records(texts, P.path("word_bpe_49k.json"), uri, 49408, files=3)
    got = token_records.read_token_records(spark, manifest, uri, 49408, with_ids=True).orderBy("start").collect()
    t = tokenizer("word_bpe_49k.json")
    rows = sorted([(i, x) for i, x in enumerate(TEXTS)] + [(3, "a b, c.")], key=lambda r: r[0])
    start = 0
    for r, (i, text) in zip(got, [(None, "null id"), *rows], strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    empty = token_records.write_token_records(none, P.path("word_bpe_49k.json"), work_dir(spark, "none"), 49408)
    assert token_records.read_token_records(spark, empty, uri, 49408).isEmpty()


def plain_score(model, text):
    """A text's score from its words: each unit's subsequences one by one, the model's table and curve alone taken over."""
    import unicodedata

    def codes(word):
        out = []
        for ch in word:
            base = unicodedata.normalize("NFD", ch)[0].lower()
            code = ord(base) - 96 if "a" <= base <= "z" else 27 if ch.isdigit() and ord(ch) < 0x3000 else 28 + ord(ch) % 4 if ch.isalpha() or ord(ch) >= 0x3000 else 0
            out += [code] * (code > 0)
        return out

    def margin(word):
        c = codes(word)
        values = []
        for a in range(0, max(1, len(c) - 8), 8):
            unit, total, squares = c[a : a + 16], 0.0, 0.0
            for x in range(len(unit)):
                for z in range(x + 2, min(x + 6, len(unit))):
                    for y in range(x + 1, z):
                        weight = 0.7 ** (z - x + 1)
                        total += weight * model.table[(unit[x] * 32 + unit[y]) * 32 + unit[z]]
                        squares += weight * weight
            values.append(model.offset + (total / squares**0.5 if squares else 0.0))
        return max(values)

    words = [w for w in re.split(r"[ \t-\r]+", text.lower()) if w]
    values = [margin(w) for w in words]
    spoken = [(k, len(codes(w))) for k, w in enumerate(words) if codes(w)]
    places = list(values)
    for (i, m), (j, n) in zip(spoken, spoken[1:]):
        if 3 <= m + n <= 16 and margin(words[i] + words[j]) > max(values[i], values[j]):
            places[i] = margin(words[i] + words[j])
    run = []
    for k, n in [*spoken, (None, 0)]:
        if n == 1:
            run.append(words[k])
        else:
            places += [margin("".join(run))] if len(run) >= 3 else []
            run = []
    first, second = sorted([-3.0, -3.0, *places])[:-3:-1]
    return 1 / (1 + np.exp(-(model.curve[0] * first + model.curve[1] * second + model.curve[2])))


def test_toxicity_scores_equal_a_plain_count_from_words_to_score(spark):
    """The query over its whole table, and texts of spaced, marked, spelled and joined words."""
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r for r in toxicity.op2_toxicity(spark, d).collect()}
    short = sorted((i for i in texts if len(texts[i]) < 4000), key=lambda i: (len(texts[i]), i))
    assert len(got) == len(texts) and len(short) > 100
    for i in short[:150]:
        assert got[i].score == pytest.approx(plain_score(model, texts[i]), abs=1e-9) and got[i].predicted == (got[i].score >= 0.3), i
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    odd = ["", " ", "a", "i d i o t", "* i * d - i o t you", "id iot", "wor thless fool", "x" * 40 + "idiot", "i-d--i-o-t s**t", "one 2 3 4 five", "ß é 漢字漢字 ok", "a b", "a b c d"]
    scored = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for r in toxicity.toxicity(scored, model).collect():
        assert r.score == pytest.approx(plain_score(model, odd[r.doc_id]), abs=1e-9), odd[r.doc_id]


def test_record_frames_and_checksums():
    assert crc.crc32c(np.frombuffer(b"123456789", np.uint8), np.array([9]))[0] == 0xE3069283
    rng = np.random.default_rng(0)
    sizes = [0, 1, 31, 32, 33, 500, 0]
    ids = rng.integers(0, 60000, sum(sizes)).astype("<u2")
    at = np.concatenate(([0], np.cumsum(sizes)))
    raw, begin = token_records.frame(ids, at)
    back, cuts = token_records.unframe(raw, begin, "<u2")
    assert (back == ids).all() and (cuts == at).all()
    assert struct.unpack_from("<Q", raw, begin[5])[0] == 1000
    broken = bytearray(raw)
    broken[begin[5] + 40] ^= 1
    with pytest.raises(ValueError):
        token_records.unframe(bytes(broken), begin, "<u2")


def test_checksum_of_every_length():
    table = [int(x) for x in crc._byte_table()]
    data = np.random.default_rng(1).integers(0, 256, 300).astype(np.uint8)
    for n in (0, 1, 63, 64, 65, 128, 300):
        want = 0xFFFFFFFF
        for b in data[:n]:
            want = table[(want ^ int(b)) & 255] ^ (want >> 8)
        assert crc.crc32c(data[:n], np.array([n]))[0] == want ^ 0xFFFFFFFF


def test_bpe_table_equals_the_library(texts, none):
    t = tokenizer("byte_bpe_50k.json")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_table.encode_decode(texts, P.path("byte_bpe_50k.json")).collect()}
    want = set()
    for i, text in [*enumerate(TEXTS), (None, "null id")]:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want and bpe_table.encode_decode(none, P.path("byte_bpe_50k.json")).isEmpty()


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(4)
    text = np.append(np.where(rng.random(3000) < 0.1, 0, rng.integers(1, 6, 3000)), 0)
    text[500:600] = text[100:200]
    index = fm_index.FMIndex(text, 5)
    patterns = [rng.integers(1, 6, n) for n in (1, 2, 3, 4, 5, 5, 5)] + [text[i : i + 5] for i in range(0, 3000, 97) if (text[i : i + 5] > 0).all()]
    sizes = np.array([len(p) for p in patterns])
    low, high = index.search(np.concatenate(patterns), np.cumsum(sizes) - sizes, sizes)
    for p, a, b in zip(patterns, low, high):
        want = [i for i in range(len(text) - len(p)) if (text[i : i + len(p)] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def contaminated(docs, items, window=13, share=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = []
    for item, t in items:
        w = words(t)
        size = min(window, len(w))
        windows += [(item, w[i : i + size]) for i in range(len(w) - size + 1)] if size else []
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, p in windows:
            for a in range(len(w) - len(p) + 1):
                if w[a : a + len(p)] == p:
                    hit |= set(range(a, a + len(p)))
                    found |= {item} if item is not None else set()
        ids = ",".join(sorted(found))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), len(hit) > 0 and share * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [16 << 20, 400])
def test_decontamination_matches_brute_force(spark, block):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(30)] + ["Été", "x-y"]
    items = [(str(k), " ".join(rng.choices(vocabulary, k=rng.choice([3, 13, 14, 20])))) for k in range(12)] + [("e", ""), ("n", None), ("1", "w1 w2 w3")]
    docs = []
    for i in range(60):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randrange(30)))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(items)[1] or "", rng.choice(["", "w5", "sep"])]
        docs.append((i, " ".join(parts)))
    docs += [(100, None), (101, ""), (102, (items[1][1] + "! ").upper() * 3)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", F.lit("x"))
    b = spark.createDataFrame(items, "item_id string, text string").withColumn("n", F.lit(1))
    got = decontaminate.contamination(d, b, shard_words=300, block_bytes=block)
    rows = sorted((tuple(r[c] for c in "doc_id n_words n_hit n_items items_sha256 contaminated".split()) for r in got.collect()), key=repr)
    assert rows == contaminated(docs, items)
    assert all(sum(s.last - s["first"] for s in r.spans) == r.n_hit for r in got.collect())


def test_decontamination_odd_rows(odd, none, odd_rows, spark):
    b = spark.createDataFrame([(1, "One two! three"), (None, "word word word word")], "item_id long, text string")
    rows = sorted((tuple(r[c] for c in "doc_id n_words n_hit n_items items_sha256 contaminated".split()) for r in decontaminate.contamination(odd, b).collect()), key=repr)
    items = [("1", "One two! three"), (None, "word word word word")]
    small = [(i, t) for i, t in odd_rows if i != 12]
    assert [r for r in rows if r[0] != 12] == contaminated(small, items)
    assert [r[1:4] for r in rows if r[0] == 12] == [(30_000, 30_000, 0)]
    assert decontaminate.contamination(none, b).isEmpty()
    assert not any(r.contaminated for r in decontaminate.contamination(odd, b.limit(0)).collect())


INSULTS = {"en": ["idiot", "moron", "clown"], "de": ["loweisch", "loweiung"]}


def sentence(rng, toxic, held=False):
    words = ["".join(rng.choices(["th", "er", "on", "an", "re", "he", "in", "ed"], k=rng.randrange(1, 4))) for _ in range(rng.randrange(5, 60))]
    if toxic:
        for w in rng.choices(INSULTS["en"], k=2) + rng.choices(INSULTS["de"], k=1):
            if held:
                w = rng.choice([w[:2] + "*" + w[2:], "-".join(w), " ".join(w), w.upper() + "!!", w[:3] + w[2:]])
            words.insert(rng.randrange(len(words) + 1), w)
    return " ".join(words)


def test_toxicity_finds_gapped_and_padded_spellings():
    rng = random.Random(0)
    texts = [sentence(rng, k % 3 == 0) for k in range(600)]
    model = toxicity.fit(texts, np.array([k % 3 == 0 for k in range(600)]), 0.1)
    score = lambda t: model.score(model.margins(pa.array(t)))
    assert (score([sentence(rng, True) for _ in range(200)]) >= 0.3).mean() > 0.97
    assert (score([sentence(rng, False) for _ in range(200)]) >= 0.3).mean() < 0.03
    assert (score([sentence(rng, True, held=True) for _ in range(200)]) >= 0.3).mean() > 0.85


def test_kernel_is_the_sum_over_common_subsequences():
    def features(word):
        out = {}
        for i in range(len(word)):
            for j in range(i + 1, len(word)):
                for k in range(j + 1, min(len(word), i + toxicity.SPAN)):
                    out[word[i] + word[j] + word[k]] = out.get(word[i] + word[j] + word[k], 0) + toxicity.DECAY ** (k - i + 1)
        return out

    codes, _ = toxicity.unit_matrix(pa.array(["idiot", "idxiot", "loweischaft"]))
    for row, word in zip(codes, ["idiot", "idxiot", "loweischaft"]):
        table = np.zeros(toxicity.CODES**3)
        code = lambda s: ((ord(s[0]) - 96) * 32 + ord(s[1]) - 96) * 32 + ord(s[2]) - 96
        for s, v in features("idiot").items():
            table[code(s)] = v
        want = sum(v * features(word).get(s, 0) for s, v in features("idiot").items())
        assert toxicity.project(row[None], table)[0] == pytest.approx(want * toxicity.scale(row[None])[0])


def test_toxicity_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(5, 1), (9, 0), (12, 0), (None, 1), (13, None), (5, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    got = toxicity.toxicity(odd, model).collect()
    assert len(got) == 14 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    assert toxicity.toxicity(none, model).isEmpty() and toxicity.without_toxic(odd, model).columns == odd.columns
    flat = toxicity.train(none, labels.limit(0))
    assert {r.predicted for r in toxicity.toxicity(odd, flat).collect()} == {0}


def test_license_scan(spark, odd, none):
    t = license_scan.TEMPLATES
    cut = t["mit"].split()
    docs = [
        (1, "x. " + t["mit-notice"] + " y"), (2, t["apache-2.0"].upper()), (3, " ".join(cut[: int(len(cut) * 0.75)])), (4, " ".join(cut[: int(len(cut) * 0.9)])),
        (5, "Released under the\nMIT licence."), (6, "a " + " ".join(cut[:20] + ["odd"] + cut[20:])), (7, " filler ".join(cut)), (8, (t["cc-by-nc-4.0-notice"] + " ") * 50),
    ]
    got = {r.doc_id: r.licenses for r in license_scan.license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: "mit-notice", 2: "apache-2.0,apache-2.0-notice", 3: "", 4: "mit", 5: "", 6: "mit", 7: "", 8: "cc-by-nc-4.0-notice"}
    assert license_scan.license_scan(odd).count() == 14 and license_scan.license_scan(none).isEmpty()
    assert license_scan.license_scan(odd, {}).filter("n_licenses > 0").isEmpty()
    assert license_scan.collision_probability(0.8, 1, 2) == pytest.approx(0.96) and license_scan.collision_probability(2 / 3) > 0.987


def contained(docs, templates, percent=80):
    """Matches by looking at every stretch."""
    grams = lambda t: [tuple(w[i : i + 5]) for w in [re.findall(r"\w+", (t or "").lower())] for i in range(len(w) - 4)]
    known = {}
    for i, t in templates:
        known[i] = known.get(i, set()) | set(grams(t))
    out = []
    for i, t in docs:
        g, found = grams(t), []
        for k in sorted(x for x in known if known[x]):
            span = (5 * len(known[k]) + 3) // 4
            most = max((len(set(g[a : a + span]) & known[k]) for a in range(len(g)) if g[a] in known[k]), default=0)
            if 100 * most >= percent * len(known[k]):
                found.append((k, 100 * most // len(known[k])))
        out.append((i, len(re.findall(r"\w+", (t or "").lower())), len(found), ",".join(k for k, _ in found), max((p for _, p in found), default=0)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_license_scan_of_a_large_table_matches_brute_force(spark, most):
    rng = random.Random(3)
    vocabulary = [f"v{k}" for k in range(300)]
    templates = [(f"t{k:03}", " ".join(rng.choices(vocabulary, k=rng.choice([4, 5, 6, 9, 14, 30, 60, 150])))) for k in range(600)] + [(None, "v1 v2 v3 v4 v5 v6"), ("twice", "v1 v2 v3 v4 v5 v6"), ("twice", "v6 v5 v4 v3 v2 v1"), ("none", None)]
    docs = []
    for i in range(120):
        words = rng.choices(vocabulary, k=rng.randrange(40))
        for _ in range(rng.randrange(3)):
            own = (rng.choice(templates)[1] or "").split()
            for _ in range(rng.choice([0, 0, len(own) // 30, len(own) // 20])):
                own[rng.randrange(len(own))] = "changed"
            words += own + rng.choices(vocabulary, k=rng.randrange(10))
        docs.append((i % 100, " ".join(words)))
    docs += [(None, templates[7][1]), (None, templates[7][1]), (500, None), (501, ""), (502, (templates[9][1] + " ") * 200)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("s", F.lit("x")).withColumn("id", F.lit("x"))
    t = spark.createDataFrame(templates, "id string, text string").withColumn("s", F.lit("x"))
    got = sorted((tuple(r) for r in license_scan.license_scan(d, t, most_broadcast=most).collect()), key=repr)
    want = contained(docs, [x for x in templates if x[0]])
    assert got == want and sum(r[2] for r in want) > 60


def test_license_scan_stays_native(spark, odd):
    plan = license_scan.license_scan(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_web_archive_round_trip(spark):
    big, same = "é" * 700, "q" * 1000
    rows = [(1, "u1", big), (2, "u 2\nx", big), (3, None, "short"), (4, "u4", "short"), (5, "u5", None), (6, "u6", ""), (None, "u7", big), (8, "u8", same), (8, "u8", same), (9, "u9", "p" * 999), (10, "u10", "p" * 999)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    uri = work_dir(spark, "warc")
    manifest = web_archive.write_archives(pages, uri)
    got = web_archive.read_archives(spark, manifest, uri).collect()
    revisits = {(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"}
    assert revisits == {(1, 2)}
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in got if r.page_id) == sorted((i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in rows if i)
    assert {r.page_id: r.payload for r in got if r.record_type == "response" and r.page_id} == {i: h or "" for i, _, h in rows if i and i != 1}
    for r in manifest.collect():
        with zipfile.ZipFile(r.file) as z:
            assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
            assert zlib.decompress(z.read(web_archive.DATA)[:200] + b"", 31 | 0)[:8] == b"WARC/1.1" if len(z.read(web_archive.DATA)) <= 200 else True
    empty = web_archive.write_archives(pages.limit(0), work_dir(spark, "warc0"))
    assert web_archive.read_archives(spark, empty, uri).isEmpty()


def test_zip64_directory_is_read(tmp_path):
    import pyarrow.fs as pafs

    # more members than a plain directory can count
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for k in range(65_600):
            z.writestr(zipfile.ZipInfo(f"m{k}"), b"" if k % 9000 else b"data%d" % k)
    (tmp_path / "a.zip").write_bytes(raw.getvalue())
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "a.zip")) as f:
        members = web_archive.directory(f)
        assert len(members) == 65_600
        start, size = web_archive.stored_at(f, members["m63000"])
        assert web_archive._range(f, start, size) == b"data63000"


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>a<p>b <b>c</b>d", "a\n\nb cd"), ("<div>a</div><div>b</div>c", "a\nb\nc"), ("<ul><li>x<li>y<ul><li>z</ul></ul>", "* x\n* y\n  * z"), ("<ol start=9><li>a<li>b</ol>", "9. a\n10. b"),
        ("<table><tr><th>Name<th>V<tr><td>long name<td>1</table>t", "Name       V\nlong name  1\n\nt"), ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"), ("<pre> a\n  b</pre>", " a\n  b"), ("x<br><br>y", "x\n\ny"),
        ("<head><title>t</title></head><body>b", "b"), ("<style>p{}</style><script>if (a<b) '</p>'</script>ok", "ok"), ("<p hidden>a</p><p style='Display: none'>b</p><p aria-hidden=true>c</p>d", "d"),
        ("a &amp; b &lt;c&gt; &#233;", "a & b <c> é"), ("a<!-- <p>no</p> -->b", "ab"), ("a < b", "a < b"), ("<p>a</div></p>b", "a\n\nb"), ("", ""), ("<b>open <i>tags", "open tags"), ("<h1>T</h1>x<h2>S</h2>", "T\n\nx\n\nS"),
        ("<dl><dt>t<dd>d</dl>", "t\n  d"), ("<textarea><b>x</b></textarea>", "<b>x</b>"), ("<a href='x>y'>z</a>", "z"), ("a\n  b\t c", "a b c"), ("<img alt='pic'> <input type=hidden value=no>", "pic"),
    ],
)
def test_html_rendering(page, text):
    assert html_text.visible_text(page) == text


def test_html_never_fails(spark):
    rng = random.Random(0)
    bits = ["<p>", "</p>", "<table>", "</table>", "<tr>", "<td>", "</td>", "<li>", "<ul>", "</ul>", "<", ">", "&amp", "text ", "<!--", "-->", "<script>", "</script>", "<pre>", "\n", '<a b="c', "</", "<br/>", "<h1>", "<div"]
    for _ in range(400):
        html_text.visible_text("".join(rng.choices(bits, k=rng.randrange(60))))
    assert html_text.visible_text("<div>" * 20_000 + "deep") == "deep"
    assert html_text.visible_text("<table><tr><td>" * 60 + "deep").strip() == "deep"
    rows = spark.createDataFrame([(1, None), (2, ""), (None, "<p>a<p>b"), (3, "x" * 300_000)], "page_id long, html string").withColumn("text", F.lit("no"))
    got = {r.page_id: (r.text, r.n_chars, r.n_lines) for r in html_text.html_text(rows).collect()}
    assert got == {1: ("", 0, 0), 2: ("", 0, 0), None: ("a\n\nb", 4, 3), 3: ("x" * 300_000, 300_000, 1)}


@pytest.mark.parametrize(
    "page, text",
    [
        ("<table><form><tr><td>a<td>b</form></table>c", "a  b\n\nc"), ("<table><center><tr><td>a</center></table>", "a"), ("<table><td>x<td>y<tr><td>z</table>", "x  y\nz"), ("<table><tbody><th>x</table>", "x"),
        ("<table>stray<tr>too<td>a</td>late</table>", "straytoolate\n\na"), ("<table><tr><p>b</p><td>a</table>", "b\n\na"), ("<table><tr><form><td>a</td></form><td>b</table>", "a  b"),
        ("<table><tr><td>a<table><tr><td>in</table>b<caption>c</table>", "c\na\n\nin\n\nb"), ("<table><tr><td>a</td><table><tr><td>b</table>", "a\n\nb"), ("<table><template><tr><td>no</template><tr><td>a</table>", "a"),
        ("<table><colgroup><col>odd<td>a</table>", "odd\n\na"), ("<td>no table</td>", "no table"),
    ],
)
def test_html_tables_keep_what_stands_in_the_wrong_place(page, text):
    assert html_text.visible_text(page) == text


def test_html_every_text_of_a_broken_table_comes_out():
    rng = random.Random(5)
    tags = "table tr td th tbody thead caption form center div p ul li b font colgroup".split()
    for _ in range(500):
        words = [f"w{k}." for k in range(25)]
        page = "<table>" + "".join(w + rng.choice(["<{}>", "<{}>", "</{}>"]).format(rng.choice(tags)) for w in words)
        text = html_text.visible_text(page)
        assert all(text.count(w) == 1 for w in (f"w{k}." for k in range(25))), page


@pytest.mark.parametrize(
    "page, text",
    [
        ("<ol start='²'><li>a</ol>", "1. a"), ("<ol start=--5><li>a</ol>", "1. a"), (f"<ol start={'9' * 5000}><li>a</ol>", "1. a"), ("<ol start=-2 reversed><li>a<li value=7>b<li>c</ol>", "-2. a\n7. b\n6. c"), (f"&#{'1' * 5000};&#x{'f' * 5000};&#0;&#00000000065;", "���A"),
        ("<a title='don't go'>Hello there</a><p>it's fine</p>", "Hello there\n\nit's fine"), ('<p class=a"b>seen</p>', "seen"), ('a<p title="open>b<p>c', "a"), ("a<b", "a"), ("a </ b", "a"), ("a</>b", "ab"), ("<!-->a<!--->b<!--x--!>c<?php d ?>e", "abce"),
        ("<table><td>cell</td></table>", "cell"), ("<b><div>x</b>y</div>z", "xy\nz"), ("<div/>a</div>b", "a\nb"), ("<script/>no</script>yes", "yes"), ("<script><!-- <script> </script> no --></script>yes", "yes"), ("<svg><circle/><text>a</text></svg>b", "a b"),
        ("<svg><title>no</title><text><![CDATA[<x>]]></text></svg>", "<x>"), ("<svg><g><p>out</p>", "out"), ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b><i>c</i></div>", "b"), ("<b hidden>a<p>b</b>c", "c"), ("<p style='display:none;display:block'>a</p>", "a"),
        ("<i style='visibility:hidden'>a<div style='visibility:visible'>b</div>c</i>d", "b\nd"), ("<table hidden><tr><td>no</table>a", "a"), ("<table><tr style='visibility:hidden'><td>no<td style='visibility:visible'>b</table>", "  b"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"), ("<table><tr><td colspan=2>wide<td>z<tr><td>a<td>b<td>c</table>", "wide  z\na  b  c"), ("<table><tr><td>a<td>b<tr><td colspan=2>much longer<tr><td>c<td>d<td>e</table>", "a  b\nmuch longer\nc  d         e"),
        ("<head><link><p>shown</head>", "shown"), ("<noscript>no</noscript><iframe>no</iframe>a<plaintext>b</p>", "a\n\nb</p>"), ("<select><option>a<div>b</div><option>c</select>", "ab"), ("<button>a<button>b</button>c", "abc"), ("<h1>a<h2>b</h1>c", "a\n\nb\n\nc"), ("<textarea>\n a\n b</textarea>", " a\n b"),
    ],
)
def test_html_is_read_as_the_standard_says(page, text):
    assert html_text.visible_text(page, drawn=True) == text.strip("\n")


@pytest.mark.parametrize(
    "page",
    [
        '<a "' * 25_000, '<a x="' * 15_000, "<div>" * 100_000 + "deep", "<table><tr><td>" * 10_000 + "deep", "<span><div>" * 10_000 + "</span>" * 10_000, "<ul><li>a" * 10_000, "<blockquote>a<br>" * 8_000, "<div>" * 10_000 + "</span>" * 10_000,
        "<table>" + "x<div>" * 15_000, "<table><tr>" + "<td rowspan=60000>a" * 900 + "<tr><td>x" * 10_000, "<table>" + "<tr><td colspan=1000>a<td>x" * 4_000, "<table><tr><td>" + "y" * 100_000 + "<td>z" + "<tr><td>a<td>b" * 8_000, "<table><td>" + "<table><caption>" * 8_000,
        "<b style=visibility:hidden>" * 5_000 + "x<div style=visibility:visible>y" * 2_000, "<script><!-- <script " * 8_000, "<svg><g>" * 10_000 + "<p>" * 10_000, "&#" + "1" * 100_000, "<form>" * 10_000 + "</form>" * 10_000, "<p>a" * 20_000, "<a>" * 20_000, "<!--" * 20_000, "<title>" + "</titl" * 20_000,
    ],
)
def test_html_takes_time_and_space_in_proportion(page):
    began = time.process_time()
    text = html_text.visible_text(page, drawn=True)
    assert time.process_time() - began < 5 and len(text) < 10 * len(page) + 10_000


class Tree:
    """A random well-formed page, its markup with end tags left out where that is allowed, and its text by plain recursion."""

    def __init__(self, rng):
        self.rng, self.n = rng, 0

    def word(self):
        self.n += 1
        return f"w{self.n}"

    def inline(self):
        """(markup, text)"""
        kind = self.rng.randrange(6)
        if kind < 3:
            return (w := self.word()), w
        if kind == 3:
            return f"<span hidden>{self.word()}</span>", ""
        m, t = self.inline()
        return (f"<b>{m}</b>", t) if kind == 4 else (f"<span title='a>b'>{m}</span>", t)

    def block(self, depth):
        """(markup, lines, whether an empty line stands before, and after)"""
        kind = self.rng.choice(["p", "div", "ul", "ol", "table", "section", "h2"] if depth else ["p", "div"])
        if kind in ("p", "h2") or not depth:
            m, t = self.inline()
            end = f"</{kind}>" if kind != "p" or self.rng.random() < 0.5 else "</p>"
            return f"<{kind}>{m}{end}", [t] if t else [], kind != "div", kind != "div"
        if kind in ("div", "section"):
            m, *rest = self.flow(depth - 1)
            return f"<{kind}>{m}</{kind}>", *rest
        if kind == "table":
            rows = [[self.inline() for _ in range(self.rng.randrange(1, 4))] for _ in range(self.rng.randrange(1, 4))]
            wide = [max(len(r[k][1]) for r in rows if k < len(r)) for k in range(max(map(len, rows)))]
            lines = ["  ".join(t.ljust(wide[k]) for k, (_, t) in enumerate(r)).rstrip() for r in rows if any(t for _, t in r)]
            end = lambda tag: self.rng.choice(["", f"</{tag}>"])
            body = "".join("<tr>" * (r is not rows[0] or self.rng.random() < 0.5) + "".join(f"<td>{m}{end('td')}" for m, _ in r) + end("tr") for r in rows)
            return f"<table>{self.rng.choice(['', '<tbody>'])}{body}</table>", lines, True, True
        markup, lines = "", []
        for k in range(self.rng.randrange(1, 4)):
            m, t = self.inline()
            markup += f"<li>{m}" + self.rng.choice(["", "</li>"])
            mark = f"{k + 1}. " if kind == "ol" else "* "
            lines += [mark + t] if t else []
        return f"<{kind}>{markup}</{kind}>", lines, True, True

    def flow(self, depth):
        markup, lines, gap, lead = "", [], False, False
        for _ in range(self.rng.randrange(1, 5)):
            m, own, before, after = self.block(depth)
            markup, gap = markup + m, gap or before
            if own:
                lead = lead if lines else gap
                lines += ([""] if gap and lines else []) + own
                gap = after
            gap = gap or after
        return markup, lines, lead if lines else gap, gap


def test_html_text_of_generated_pages():
    rng = random.Random(11)
    for _ in range(600):
        markup, lines, _, _ = Tree(rng).flow(2)
        assert html_text.visible_text(f"<!DOCTYPE html><html><head><title>no</title><body>{markup}</html>", drawn=True) == "\n".join(lines), markup


KATEX = '<span class="katex"><span class="katex-mathml"><math><semantics><mi>E</mi><annotation>E</annotation></semantics></math></span><span class="katex-html" aria-hidden="true"><span>E</span></span></span>'


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p aria-hidden=true>a</p>b", "a\n\nb"), (f"is {KATEX}.", "is E."), ("<math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>no</annotation></math>", "x= 1 2"),
        ("<math style='position:absolute; clip: rect(1px, 1px, 1px, 1px)'><mi>x</mi></math><b aria-hidden=true>x</b>", "x"), ("<p><svg><title>no</title><desc>no</desc><defs><text>no</text></defs><text>A</text><text>B</text></svg>c", "A B c"),
        ("in <select><option>a<option selected>b<option>c</select>now", "in b now"), ("<select><option disabled>a<optgroup label=g><option>b</optgroup></select>", "b"), ("<select multiple><option>a<option label=l>b</select>", "a l"),
        ("<table><tr aria-hidden=true><td>a<td><select><option>b</select></table>", "a  b"),
    ],
)
def test_html_query_keeps_all_drawn_text(page, text):
    assert next(iter(html_text._extract(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([page])], ["page_id", "text"])])))).column("text").to_pylist() == [text]


def test_toxicity_finds_marks_and_spaces_between_letters():
    rng = random.Random(0)

    def text(form):
        words = sentence(rng, False).split()
        for w in rng.choices(INSULTS["en"], k=2) if form else ():
            words.insert(rng.randrange(len(words) + 1), form(w))
        return " ".join(words)

    toxic = np.array([k % 3 == 0 for k in range(600)])
    model = toxicity.fit([text(str if t else None) for t in toxic], toxic, 0.1)
    share = lambda form: (model.score(model.margins(pa.array([text(form) for _ in range(100)]))) >= 0.3).mean()
    forms = {"two marks": "--".join, "marks and spaces": " * ".join, "one space": lambda w: w[:2] + " " + w[2:], "stars": "**".join}
    shares = {name: share(form) for name, form in forms.items()}
    assert min(shares.values()) > 0.9 and share(None) < 0.05, shares
    plain, marked = (model.margins(pa.array([t])) for t in ("x idiot y", "x i--d--i--o--t y"))
    assert (plain == marked).all()


def test_toxicity_learns_insults_of_two_words():
    rng = random.Random(1)
    say = lambda bad: " ".join([sentence(rng, False), *(["vokzu", "quab"] if bad else rng.choice([["vokzu"], ["quab"]])), sentence(rng, False)])
    toxic = np.array([k % 3 == 0 for k in range(600)])
    model = toxicity.fit([say(t) for t in toxic], toxic, 0.1)
    score = lambda bad: model.score(model.margins(pa.array([say(bad) for _ in range(100)])))
    assert (score(True) >= 0.3).mean() > 0.9 and (score(False) >= 0.3).mean() < 0.1


@pytest.mark.parametrize("block", [16 << 20, 12])
def test_decontamination_judges_each_row_for_any_number_of_blocks(spark, block):
    items = [("1", "a b c"), ("2", "d e f"), ("3", "g h i"), ("4", "c d")]
    docs = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "x a b c y"), (1, ""), (None, "g h i"), (None, "x y z w"), (None, None), (None, None), (None, "g h i"), (2, "a b c d e f")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.contamination(d, b, block_bytes=block)
    rows = sorted((tuple(r[c] for c in "doc_id n_words n_hit n_items items_sha256 contaminated".split()) for r in got.collect()), key=repr)
    assert rows == contaminated(docs, items)
    keyed = with_rows(d)
    left = without_rows(keyed, decontaminate.contaminated_rows(keyed, b, block_bytes=block))
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted([(None, None), (None, None), (None, "x y z w"), (1, "")], key=repr)


def test_decontamination_reads_documents_once_for_any_number_of_blocks(spark, tmp_path):
    spark.createDataFrame([(k, f"a{k} b{k} c{k} d") for k in range(40)], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    d = spark.read.parquet(f"{tmp_path}/docs")
    b = spark.createDataFrame([(str(k), f"b{k} c{k}") for k in range(30)], "item_id string, text string")
    got = decontaminate.contamination(d, b.union(b), block_bytes=20)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("FileScan"), plan.count("MapInArrow"), plan.count("Exchange")) == (1, 1, 0)
    assert {r.doc_id: (r.n_hit, r["items"]) for r in got.collect()} == {k: (2, [str(k)]) if k < 30 else (0, []) for k in range(40)}


def test_decontamination_indexes_no_more_than_a_shard_at_a_time(tmp_path, monkeypatch):
    texts, sizes = ["word " * 1000] * 800 + ["a b c"], []
    uri = tmp_path.as_uri()
    items = pa.RecordBatch.from_pydict({"item_id": ["1"], "text": ["a b c"]})
    names = [n for out in decontaminate._write_block(uri, 13)(iter([items])) for n in out.column("name").to_pylist()]
    index = decontaminate.FMIndex
    monkeypatch.setattr(decontaminate, "FMIndex", lambda text, sigma: sizes.append(len(text)) or index(text, sigma))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts, "row": [""] * len(texts)})
    out = list(decontaminate._spans(uri, names, 1 << 18)(iter([batch])))
    assert sum(sizes) == 800 * 1001 + 4 and max(sizes) <= 2 << 18
    assert [h for o in out for h in o.column("n_hit").to_pylist()] == [0] * 800 + [3]


def test_batches_of_texts_end_by_their_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    small_batches(spark)
    docs = spark.range(0, 1000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 20_000).alias("text"))
    sizes = [r.bytes for r in docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"bytes": [b.nbytes]}) for b in batches), "bytes long").collect()]
    assert sum(sizes) > 20_000_000 and max(sizes) < 5_000_000
    for own in (str(1 << 20), "64m"):  # a smaller bound and one with a unit stay
        spark.conf.set(name, own)
        small_batches(spark)
        assert spark.conf.get(name) == own
    spark.conf.unset(name)
    small_batches(spark)
