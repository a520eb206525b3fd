"""Empty tables, nulls, extra columns with clashing names and repeated rows, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmere.llm import flac, jaccard, langid, mixing, packing, pii, quality, suffix, urls, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, copy_no string, name string, bucket string, label string, n string"
ROWS = [
    (1, "the cat sat on the mat and the dog ran", "en", "a", 38, "x", "y", "z", "b", "l", "n"),
    (1, "the cat sat on the mat and the dog ran", "en", "a", 38, "x", "y", "z", "b", "l", "n"),
    (2, None, None, None, None, None, None, None, None, None, None),
    (3, "", "en", "a", 0, None, None, None, None, None, None),
    (None, "le chat est sur la table et le chien court", "fr", None, 42, None, None, None, None, None, None),
    (4, "12345 67890 !!!", None, "a", 15, None, None, None, None, None, None),
    (5, "word " * 30_000, "en", "b", 150_000, None, None, None, None, None, None),
    (6, "x" * 60_000, "en", "b", 60_000, None, None, None, None, None, None),
]


@pytest.fixture(scope="module", params=["rows", "empty"])
def docs(request, spark):
    return spark.createDataFrame(ROWS if request.param == "rows" else [], DOCS)


def _count(docs):
    return docs.count()


def test_langid(spark, docs):
    got = langid.identify(spark, docs, langid.train(spark, docs)).collect()
    assert len(got) == _count(docs)
    assert all((r.lang_pred == "und") == (r.doc_id in (2, 3, 4)) for r in got)
    assert langid.keep_identified(spark, docs, langid.train(spark, docs)).columns == docs.columns


def test_langid_without_labels(spark, docs):
    model = langid.train(spark, docs.where("false"))
    assert {r.lang_pred for r in langid.identify(spark, docs, model).collect()} <= {"und"}


def test_langid_shares_the_vocabulary(spark):
    import string

    rows = [(i, " ".join(a + b + "a" for a in string.ascii_lowercase for b in "bcdf"), "large") for i in range(30)] + [(100 + i, "öüä ßöü", "small") for i in range(2)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(spark, labelled, vocabulary=20)
    assert {"öüä", "ßöü"} <= set(model.words) and len(model.words) == 20
    assert langid.Identifier(model)("öüä ßöü")[0] == "small"
    with pytest.raises(ValueError):
        langid.train(spark, labelled, max_langs=1)


def test_pii(spark, docs):
    got = pii.find_pii(spark, docs).collect()
    assert len(got) == _count(docs)
    assert pii.mask_pii(spark, docs).columns == docs.columns


def test_flac(spark, docs):
    import hashlib
    import zlib

    got = sorted(flac.read_back(spark, flac.encode_texts(spark, docs)).collect(), key=lambda r: (r.n_bytes, str(r.doc_id)))
    want = []
    for r in docs.collect():
        raw = (r.text or "").encode()
        payload = raw + bytes(64 if not raw else -len(raw) % 64)
        offsets = ",".join(str(o) for o in range(0, len(payload), 4096))
        x = [b - 128 for b in payload]
        turns = sum((p < 0) != (q < 0) for p, q in zip(x, x[1:]))
        feature = f"n={len(x)};sum={sum(x)};energy={sum(v * v for v in x)};turns={turns};min={min(x)};max={max(x)}"
        want.append((r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), feature, -(-len(payload) // 4096), hashlib.sha256(offsets.encode()).hexdigest()))
    want.sort(key=lambda w: (w[1], str(w[0])))
    assert [(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature, r.n_blocks, r.offsets_sha256) for r in got] == want
    same = [(r.media_sha256, r.media_bytes) for r in got if r.doc_id == 1]
    assert len(set(same)) == min(1, len(same))


def test_flac_long_payload(monkeypatch):
    """Streams do not hang on how much is worked on at a time."""
    import random

    rng = random.Random(3)
    payloads = [bytes(rng.choice(b"abc def") for _ in range(64 * 1000)), b"q" * 64, bytes(rng.randrange(256) for _ in range(64 * 200))]
    whole = flac.encode(payloads)
    monkeypatch.setattr(flac, "BATCH", 5000)
    assert flac.encode(payloads) == whole
    for p, got in zip(payloads, flac.decode(whole)):
        assert b"".join(flac.pcm(x) for _, x in got) == bytes(b ^ 0x80 for b in p)


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    got, want = packing.pack(spark, docs).collect(), []
    for r in docs.collect():
        n = len(whole.encode(r.text or "", add_special_tokens=False).ids) + 1
        want += [(r.doc_id, s, min(2048, n - s), n) for s in range(0, n, 2048)]
    key = lambda x: (x[0] is None, x)
    assert sorted([(r.doc_id, r.start, r.length, r.doc_tokens) for r in got], key=key) == sorted(want, key=key)


def test_packing_deals_copies_and_keeps_documents_together(spark):
    docs = spark.createDataFrame([(7, "same text")] * 3000 + [(1000 + i, "word " * 3000) for i in range(20)], "doc_id long, text string").repartition(4)
    got = packing.pack(spark, docs, group_docs=100).collect()
    groups = {r.sequence_id >> 32 for r in got if r.doc_id == 7}
    assert len(groups) == 31 and sum(r.doc_id == 7 for r in got) == 3000
    for i in range(20):
        own = [r for r in got if r.doc_id == 1000 + i]
        assert len(own) == 2 and len({r.sequence_id >> 32 for r in own}) == 1


def test_packing_long_text(monkeypatch):
    path = packing.default_tokenizer()
    text = "it's a  long\ntext of ÉTÉ and \u65e5\u672c words, " * 400 + " " * 3000 + "x" * 9000
    whole = packing.WordEncoder(path).encode([text])
    monkeypatch.setattr(packing, "SLICE", 700)
    assert packing.WordEncoder(path).encode([text]) == whole


def test_mixing(spark, docs):
    """Input columns keep names and values, the gained ones make way; no row comes from nowhere."""
    given = docs.withColumn("mix_copies", F.lit("p")).withColumn("mix_source", F.lit("q")).withColumn("mix_steps", F.lit("r")).withColumn("MIX_KEY", F.lit("s"))
    got = mixing.poisson_mix(spark, given, epochs=3.0)
    assert got.columns == [*given.columns, "copy_no_", "mix_rate", "mix_key_"]
    rows, known = got.collect(), {tuple(r) for r in given.collect()}
    assert all(tuple(r)[: len(given.columns)] in known for r in rows)
    copies: dict = {}
    for r in rows:
        copies.setdefault(tuple(r)[: len(given.columns)], []).append(r.copy_no_)
    assert bool(rows) == bool(known)
    for row, own in copies.items():
        many = sum(tuple(r) == row for r in given.collect())
        assert sorted(own) == sorted(list(range(len(own) // many)) * many)


def test_mixing_without_ids(spark):
    """Rows without a doc_id are drawn and placed each by itself; a rate in the thousands is listed in blocks."""
    docs = spark.range(3000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "concat('t', id) AS text", "'a' AS source")
    got = mixing.poisson_mix(spark, docs).collect()
    counts: dict = {}
    for r in got:
        counts[r.text] = counts.get(r.text, 0) + 1
    assert abs(len(got) - 3000) < 300 and 1000 < sum(c == 1 for c in counts.values()) < 1200  # 3000 / e
    assert len({r.mix_key for r in got}) == len(got)
    steps = spark.range(1).select(mixing.poisson_steps(F.lit(9000.0))).first()[0]
    assert abs(steps[9000] - 0.5028) < 1e-3 and abs(steps[-1] - 1) < 1e-9 and steps == sorted(steps)


def test_quality(spark, docs):
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    got = quality.score_quality(spark, docs, quality.train(spark, docs, labels)).collect()
    assert len(got) == _count(docs) and all(r.score > 0.9 and r.predicted == 1 if _count(docs) else False for r in got)
    none = quality.score_quality(spark, docs, quality.train(spark, docs, labels.where("false"))).collect()
    assert len(none) == _count(docs) and all(r.score == 0.5 and r.predicted == 0 for r in none)


def test_quality_same_text_same_score(spark, monkeypatch):
    """Null is empty, repeated rows are equal, and a text read in blocks scores like one read at once; the sample keeps to its bounds."""
    good, bad = "the quick brown fox jumps over the lazy dog. " * 20, "$$$ ### %%% 111 222 !!! " * 30
    rows = [(i, good + str(i)) for i in range(0, 40)] + [(100 + i, bad + str(i)) for i in range(40)] + [(500, None), (501, ""), (502, good), (502, good), (503, " \n " * 40), (504, good * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)], "doc_id long, quality int")
    net = quality.train(spark, docs, labels)
    one = {(r.doc_id, r.score) for r in quality.score_quality(spark, docs, net).collect()}
    by = dict(one)
    assert len(one) == len({i for i, _ in rows}) and by[500] == by[501] == by[503] and by[502] > 0.7 > 0.5 > by[105]
    for size in (50, 1000):
        monkeypatch.setattr(quality, "SLICE", size)
        assert max(abs(net.score_long(t or "") - by[i]) for i, t in rows[-6:]) < 1e-6
    monkeypatch.undo()
    assert [len(x) for x in quality.word_blocks("a " * 200)] == [200]
    few = quality.train(spark, docs, labels, most_passages=1)
    assert (few.params["c"] == 0).all() and few.params["d"][0] == 0


def test_suffix(spark, docs):
    from tests.llm.test_exact import _brute_repeats

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, got = _brute_repeats(rows), suffix.drop_repeats(spark, docs).collect()
    assert sorted((str(r.doc_id), r.n_bytes) for r in got) == sorted((str(i), len((t or "").encode())) for i, t in rows)
    assert all((r.n_removed, r.n_spans, r.kept_sha256) in want[r.doc_id, r.n_bytes] for r in got)


def test_jaccard(spark, docs):
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark, docs).collect())
    want = [("1", 6, 1), ("1", 6, 1), ("2", 0, 2), ("3", 0, 3), ("4", 1, 4), ("5", 1, 5), ("6", 1, 6), ("None", 6, None)]
    assert got == (want if _count(docs) else [])
    kept = jaccard.keep_one_of_each(spark, docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == (["1", "2", "3", "4", "5", "6", "None"] if _count(docs) else [])


def test_jaccard_rows_without_id(spark):
    """Many rows of null id, equal and near ones among them, under names that the operator uses itself."""
    base = [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(40)]
    rows = [(None, b, "h", 1) for b in base] + [(None, b + " more", "h", 2) for b in base[:20]] + [(None, base[0], "h", 3)] * 50 + [(3, base[1], "h", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string, doc long").repartition(5)
    kept = jaccard.keep_one_of_each(spark, docs).collect()
    assert len(kept) == 40 and sum(r.doc_id == 3 for r in kept) == 1 and {r.text.split()[0] for r in kept} == {b.split()[0] for b in base}


def test_one_of_each_by_text_and_not_by_id(spark):
    a, b, c, d = (" ".join(f"{w}{chr(97 + i)}{chr(97 + i * 7 % 26)}" for i in range(20)) for w in ("alpha", "beta", "gamma", "delta"))
    rows = [(1, a), (1, b), (1, b), (2, a), (3, b + " end"), (4, c), (5, d), (4, d), (None, "zeta eta theta iota kappa"), (None, "zeta eta theta iota kappa"), (None, c), (None, ""), (None, None), (6, ""), (6, None), (7, d)]
    rows += [(0, c), (0, a + " more of its own words that are far from any other text there is and so on and on again")]
    got = jaccard.keep_one_of_each(spark, spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, n string")).collect()
    want = [(1, a), (1, b), (4, d), (None, "zeta eta theta iota kappa"), (None, ""), (None, None), *rows[-2:]]
    assert sorted((str(r.doc_id), str(r.text)) for r in got if r.doc_id != 6) == sorted((str(i), str(t)) for i, t in want)
    assert sum(r.doc_id == 6 for r in got) == 1


def test_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int, rep string, v string, n string"
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [None, 1.0], 1), (8, [], 1), (9, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (10, [float("inf"), 1.0], 1)]
    got = vectors.link_vectors(spark, spark.createDataFrame([(*r, "a", "b", "c") for r in rows], schema)).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got}
    assert by[1].n_links == 2 and by[2].component_id == 1 and by[2].n_links == 2 and not by[2].kept
    assert all(by[i].n_links == 0 and by[i].component_id == i and by[i].kept for i in (3, 4, 5, 6, 7, 8, 9, 10))
    assert vectors.link_vectors(spark, spark.createDataFrame([], schema)).count() == 0


def test_urls(spark):
    schema = "page_id long, url string, html string, host string, path string, rule string"
    rows = [(1, None), (2, ""), (3, "example.com/en/7"), (4, "http://a.EXAMPLE.com/en/8"), (5, "https://example.com/en/7?x"), (6, "x://com/en/"), (7, "http://xcom/en/1"), (8, "http://a.org/b.com/en/1"), (9, "http://a.example.net/de/81#x"), (10, "http://casino.biz/"), (None, "http://y.net/de/1"), (11, "http://h/" + "a" * 20_000)]
    got = {r.page_id: r for r in urls.filter_urls(spark, spark.createDataFrame([(*r, "h", "a", "b", "c") for r in rows], schema)).collect()}
    assert [(got[i].host, got[i].path, got[i].verdict) for i in (1, 2, 3)] == [("", "", "allow")] * 3
    assert [(got[i].rule, got[i].verdict) for i in (4, 5, 6, 7, 8, 9, 10)] == [("com/en/", "block"), ("example.com/en/7", "allow"), ("com/en/", "block"), (None, "allow"), (None, "allow"), ("example.net/de/8", "block"), (None, "block")]
    assert got[None].rule == "net/de/" and got[11].path == "/" + "a" * 20_000
    assert urls.filter_urls(spark, spark.createDataFrame([], schema)).count() == 0


def test_stages(spark, docs):
    """Each stage keeps the columns, whatever they are, and works on what its predecessor kept."""
    own = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, own, "")
        assert out.columns == docs.columns, name
        own = spark.createDataFrame(out.collect(), docs.schema)
    corpus_pipeline.STAGES[-1][1](spark, own, "").collect()
