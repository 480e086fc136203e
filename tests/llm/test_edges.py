"""Repeated and null keys, clashing columns, empty tables, long texts and ties; plain versions of what SQL can't express."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskline.llm import ann, chat, jaccard, langid, neardup, packing, pieces, stages, tokenfile, tokens, toxicity, words
from maskline.llm.common import bounded_sample
from maskline.llm.queries import vocabulary

TEXTS = "doc_id long, text string"


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return set() if not w else {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def components_of(texts, n, percent):
    """Number of each row's component, by all pairs of rows."""
    sets, root = [shingles(t, n) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return sets, [find(i) for i in range(len(texts))]


def families(seed, n_families, words_each=90):
    """Rows of doc_ids that repeat with other texts: of each family a chain of near copies whose ends aren't similar."""
    r, rows = random.Random(seed), []
    for f in range(n_families):
        w = [f"{r.choice('abcdefgh')}{r.randrange(10**6)}" for _ in range(words_each)]
        other = [f"o{r.randrange(10**6)}" for _ in range(words_each)]
        change = lambda x, at: x[:at] + ["new" + str(r.randrange(10**6))] + x[at + 1 :]
        a, b = w, other
        a2 = a
        for _ in range(r.choice([0, 1, 2, 3])):
            a2 = change(a2, r.randrange(words_each))
        b2 = change(b, r.randrange(words_each))
        key = 10 * f
        rows += [(key + 3, a), (key + 5, a), (key + 5, b), (key + 7, b2), (key + 9, a2), (None if f % 3 == 0 else key, a2), (key + 9, a2)]
    return [(k, " ".join(t)) for k, t in rows]


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_jaccard_of_repeated_and_missing_keys(spark, n, percent):
    rows = families(n, 30) + [(None, "one lone text without any key at all"), (None, None), (2, None), (4, "")]
    sets, of = components_of([t for _, t in rows], n, percent)
    least = {}
    for (k, _), c in zip(rows, of):
        least[c] = min((x for x in (least.get(c), k) if x is not None), default=None)
    want = sorted(((k, len(s), least[c] if s else k) for (k, _), s, c in zip(rows, sets, of)), key=str)
    d = spark.createDataFrame(rows, TEXTS).withColumn("component_id", F.lit("x"))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(d, n, percent).collect()), key=str)
    assert got == want


def test_jaccard_of_a_large_family_in_small_cells(spark, monkeypatch):
    """A family of which few pairs are similar, posting lists longer than a part and families larger than a cell."""
    for name, value in (("LIST", 8), ("CELL", 8), ("HALF", 4), ("HOT", 4), ("HOT_MEANS", 0)):
        monkeypatch.setattr(jaccard, name, value)
    r = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(60)] = f"x{r.randrange(40)}"
        texts.append(" ".join(w))
    texts += [" ".join(base[:30] + [f"y{i}"] * 20) for i in range(10)]
    sets, of = components_of(texts, 4, 85)
    got = jaccard.join(spark.createDataFrame(list(enumerate(texts)), TEXTS), 4, 85).orderBy("doc_id").collect()
    assert [(x.n_shingles, x.component_id) for x in got] == list(zip(map(len, sets), of)) and 1 < len(set(of)) < 60


def test_jaccard_of_long_texts(spark):
    r = random.Random(2)
    long = [f"v{r.randrange(10**7)}" for _ in range(60_000)]
    near = long[:59_000] + [f"u{i}" for i in range(1000)]
    d = spark.createDataFrame([(2, " ".join(long)), (1, " ".join(near)), (3, " ".join(long[::-1]))], TEXTS)
    assert sorted((r.doc_id, r.component_id) for r in jaccard.join(d).collect()) == [(1, 1), (2, 1), (3, 3)]


def plain_scores(texts, margin, offset):
    out = []
    for t in texts:
        found = re.findall(r"[^\x00-\x20.,;:!?|()\[\]{}<>\"/\\`]+".encode(), re.sub("[A-Z]", lambda m: m.group().lower(), t or "").encode())
        each = []
        for w in found:
            b, n = toxicity.features([w])
            each.append(np.mean(margin[b]))
        out.append(1 / (1 + np.exp(-(np.mean(each) if each else 0.0) - offset)))
    return np.array(out)


def test_toxicity_scores_equal_a_plain_loop():
    rng = np.random.default_rng(1)
    m = toxicity.Model(rng.normal(size=1 << toxicity.BUCKET_BITS), -0.4)
    r = random.Random(1)
    texts = ["".join(r.choice(["ab", "Blorg", " ", ", ", "é", "語", "x!", "\n"]) for _ in range(r.randint(0, 60))) for _ in range(100)] + ["", "...", None, "word " * 50_000]
    got = m.score(*words.text_buffer(pa.array(texts, pa.string())), words.SpanTable(1000, np.float32))
    assert np.allclose(got, plain_scores(texts, m.margin, m.offset), atol=1e-5)


def test_toxicity_fit_equals_a_plain_one(monkeypatch):
    """The same steps over a dense matrix of (text, bucket) shares."""
    monkeypatch.setattr(toxicity, "EPOCHS", 12)
    monkeypatch.setattr(toxicity, "SUPPORT", 1)
    r = random.Random(6)
    texts = [" ".join(r.choice(["kalo", "mine", "blorg", "neka", "blorgs"]) for _ in range(r.randint(1, 9))) for _ in range(40)]
    y = np.array([int("blorg" in t) for t in texts])
    w = np.where(y == 1, 2.0, 1.0)
    got = toxicity.fit(texts, y, w)
    buckets = sorted({b for t in texts for x in t.split() for b in toxicity.features([x.encode()])[0].tolist()})
    at = {b: i for i, b in enumerate(buckets)}
    A = np.zeros((len(texts), len(buckets)))
    for i, t in enumerate(texts):
        for x in t.split():
            b = toxicity.features([x.encode()])[0].tolist()
            for k in b:
                A[i, at[k]] += 1 / len(b) / len(t.split())
    rng = np.random.default_rng(toxicity.SEED)
    W = rng.normal(0, 1, (toxicity.DIMENSIONS, 2))
    E = rng.normal(0, 0.05, (len(buckets), toxicity.DIMENSIONS))
    b = np.log(np.array([w[y == 0].sum(), w[y == 1].sum()]) / w.sum())
    m = [np.zeros_like(x) for x in (E, W, b)]
    v = [np.zeros_like(x) for x in (E, W, b)]
    for t in range(1, 13):
        D = A @ E
        z = D @ W + b
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        g = (p - np.eye(2)[y]) * (w / w.sum())[:, None]
        for k, (x, grad, rate, damp) in enumerate(((E, A.T @ (g @ W.T), toxicity.STEP, 1), (W, D.T @ g, 0.3 * toxicity.STEP, 0), (b, g.sum(0), 0.1 * toxicity.STEP, 0))):
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.99 * v[k] + 0.01 * grad**2
            s = v[k] / (1 - 0.99**t)
            x -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s) + damp * np.sqrt(s.mean()) + 1e-12)
        E *= 1 - toxicity.DECAY
    assert np.allclose(got.margin[buckets], E @ (W[:, 1] - W[:, 0]), atol=1e-4) and abs(got.offset - (b[1] - b[0])) < 1e-6


def test_equal_rows_and_ties_of_judges(spark):
    d = spark.createDataFrame([(1, "kalo mine", "xx", 0), (1, "kalo mine", "xx", 0), (2, "kalo mine", "yy", 1), (None, "kalo mine", "yy", 1), (3, "x" * 300_000, "xx", 0)], "doc_id long, text string, lang string, label int")
    model = langid.learn(d)
    got = langid.predict(d, model).collect()
    assert len(got) == 5 and len({r.score for r in got if len(r.text) < 99}) == 1  # of equal codes the name that sorts first
    m = toxicity.learn(d.drop("label"), d.select("doc_id", "label"))
    scores = [r.score for r in toxicity.score(d, m).collect()]
    assert len(scores) == 5 and len(set(scores[:4])) == 1 and all(0 <= s <= 1 for s in scores)


def test_a_sample_of_one_key_still_has_rows(spark):
    d = spark.createDataFrame([(None, "t" * 50, "xx")] * 40 + [(1, "u" * 50, "yy")], "doc_id long, text string, lang string")
    got = bounded_sample(d, "lang", F.octet_length("text"), 500, ["doc_id", "text"]).collect()
    assert sum(r.lang == "xx" for r in got) == 10 and sum(r.lang == "yy" for r in got) == 1
    assert langid.learn(d, 500).languages == ["xx", "yy"]


def test_many_languages_share_no_table(monkeypatch):
    texts = {f"l{i}": [f"w{i} word{i * 7} é{i}".encode()] for i in range(11)}
    whole = langid.PPM(texts, 2)
    monkeypatch.setattr(langid, "GROUP", 3)
    parts = langid.PPM(texts, 2)
    data, off = words.text_buffer(pa.array(["word14 w2", "", "é9 w9"]))
    assert len(parts.groups) == 4 and np.allclose(whole.bits(data, off), parts.bits(data, off), atol=1e-4)


def brute_near(rows, k):
    """Each query row's k nearest, by all pairs of rows."""
    out = []
    for i, (q, v) in enumerate(rows):
        if q % 20 == 0:
            near = sorted(((-float(ann.dot(np.array([v]), np.array([x]))[0]), n) for j, (n, x) in enumerate(rows) if j != i))[:k]
            out.append((q, [(n, -s) for s, n in near]))
    return out


def test_search_of_repeated_ids_and_ties(spark):
    r = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(r.standard_normal((60, 6)).astype(np.float32))]
    rows += [(20, [float(x) for x in r.standard_normal(6).astype(np.float32)]), (40, rows[40][1])] + [(200 + i, rows[7][1]) for i in range(30)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    got = {}
    for x in ann.search(d, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, round(x.score, 9)))
    want = {}
    for q, near in brute_near(rows, 20):
        want.setdefault(q, []).extend((i + 1, n, round(s, 9)) for i, (n, s) in enumerate(near))
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}


def test_recall_against_brute_force(spark):
    r = np.random.default_rng(12)
    n, d = 50_000, 32
    x = (r.standard_normal((200, d))[r.integers(0, 200, n)] + r.standard_normal((n, d))).astype(np.float32).astype(float)
    d = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(x.ravel()))}))
    got = ann.search(d, F.col("vec_id") % 500 == 0, 20).toPandas()
    hits = 0
    for q in range(0, n, 500):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & set(got.vec_id[got.query_id == q]))
    assert len(got) == 20 * (n // 500) and hits >= 0.9 * len(got)


def test_vectors_of_one_window_and_many(spark):
    r = np.random.default_rng(9)
    base = r.standard_normal((60, 16))
    rows = [(i, (base[i % 60] + 0.1 * r.standard_normal(16)).tolist(), i % 2) for i in range(600)] + [(5, base[5].tolist(), 1), (5, base[6].tolist(), 0), (None, base[7].tolist(), 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    whole = sorted(map(tuple, neardup.link(d).collect()), key=str)
    assert sorted(map(tuple, neardup.link(d, window=32, block=64, passes=30).collect()), key=str) == whole and len(whole) == 603


def test_empty_tables_and_clashing_columns(spark):
    path, word, byte = (vocabulary(x) for x in ("piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.json"))
    d = spark.createDataFrame([(1, "some text", 7), (1, "some text", 7), (1, "other", 8), (2, None, 9)], "doc_id long, text string, start long")
    none = d.where("false")
    assert pieces.decode(pieces.encode(none, path), path).count() == 0
    assert sorted(r.start for r in pieces.encode(d, path).collect()) == [7, 7, 8, 9]
    assert pieces.decode(spark.createDataFrame([(1, None), (2, []), (3, [5])], "doc_id long, ids array<int>"), path).orderBy("doc_id").collect()[0].decoded == ""
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.round_trip(d, word).collect())
    enc = tokens.encoder(word).whole
    each = {t: np.array([*enc.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in ("some text", "other", None)}
    by = {zlib.crc32(x.tobytes()): t for t, x in each.items()}
    at = 0
    for _, start, n, crc in got:  # rows of one doc_id come by a hash of their texts
        assert (start, n) == (at, len(each[by[crc]]))
        at += n
    assert sorted((k, str(by[c])) for k, _, _, c in got) == [(1, "other"), (1, "some text"), (1, "some text"), (2, "None")]
    packed = packing.pack(d, byte).collect()
    whole = tokens.encoder(byte).whole
    want = sorted(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for t in ("some text", "some text", "other", None))
    assert sorted(p.doc_tokens for p in packed if p.start == 0) == want and sum(p.length for p in packed) == sum(want)
    assert packing.pack(none, byte).count() == 0 and tokenfile.round_trip(none, word).count() == 0


def test_a_cut_character_decodes_as_the_library_does(spark):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = sp.encode("a 語\U00012345 b")
    rows = [(i, ids[: i + 1]) for i in range(len(ids))] + [(99, ids[2:]), (100, ids)]
    got = pieces.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), path).orderBy("doc_id").collect()
    m = pieces.model(path, "bpe")
    raw = lambda x: b"".join(m.raw[m.raw_first[i] : m.raw_first[i] + m.raw_size[i]].tobytes() for i in x)
    assert [r.decoded for r in got] == [(lambda b: (b[1:] if b[:1] == b" " else b).decode(errors="replace"))(raw(r.ids)) for r in got]
    assert got[-1].decoded == sp.decode(ids)


def test_long_conversation_and_lists_of_calls(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(3001)] + [
        (2, 0, "assistant", '{"tool_calls":[null]}'), (2, 1, "assistant", '{"content":"I look it up","tool_calls":[{"id":"c","name":"reply","arguments":{"prompt":"x"}}]}'), (2, 2, "tool", '{"tool_call_id":"c","content":"y"}')]
    got = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sum(r.conv_id == 1 and r.kind == "call" and r.valid for r in got) == 1500
    second = sorted((r.turn, r.kind, r.call_id, r.json) for r in got if r.conv_id == 2)
    assert any("I look it up" in j for _, k, _, j in second if k == "message") and not any(k == "orphan" and c is None for _, k, c, _ in second)
    assert any(k == "call" and c == "c" and '"result":"y"' in j for _, k, c, j in second)


@pytest.fixture()
def folder(spark, tmp_path):
    def make(rows, labels=()):
        spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, _name string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        return spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)

    return make


def test_stages_on_edges(spark, folder):
    stems = ["ka", "lo", "mi", "ne"]
    r = random.Random(1)
    prose = lambda n: " ".join(r.choice(stems) + r.choice(stems) for _ in range(n))
    a, b = prose(60), prose(60)
    rows = [(1, a, "xx", "s1", "n1"), (1, a, "xx", "s2", "n2"), (1, b, "xx", "s3", "n3"), (None, b + " end", "xx", "s4", "n4"), (2, None, "xx", "s5", "n5"), (3, "", "xx", "s6", "n6"), (4, prose(40_000), None, "s7", "n7")]
    docs, at = folder(rows)
    for stage in (stages.drop_toxic, stages.drop_unknown_language, stages.drop_near_duplicates):
        assert stage(spark, docs.where("false"), at).collect() == [] and stage(spark, docs, at).columns == docs.columns
    kept = lambda d: sorted(x.score for x in d.collect())
    assert kept(stages.drop_toxic(spark, docs, at)) == [f"s{i}" for i in range(1, 8)]  # no label, nothing is toxic
    assert kept(stages.drop_unknown_language(spark, docs, at)) == ["s1", "s2", "s3", "s4", "s7"]
    got = kept(stages.drop_near_duplicates(spark, docs, at))
    assert got[0] in ("s1", "s2") and got[1:] == ["s3", "s5", "s6", "s7"]
    assert stages.drop_unknown_language(spark, docs.withColumn("lang", F.lit(None).cast("string")), at).count() == 0
    assert stages.pack(spark, docs.where("false"), at).count() == 0


def test_pipeline_equals_its_stages_by_brute_force(spark, folder):
    import corpus_pipeline

    r = random.Random(4)
    stems = {"xx": ["ka", "lo", "mi", "ne"], "yy": ["thr", "ing", "est", "ou"]}
    rows, labels = [], []
    for i in range(120):
        lang = "xx" if i % 2 else "yy"
        w = [r.choice(stems[lang]) + r.choice(stems[lang]) for _ in range(50)]
        for _ in range(8 if i % 5 == 0 else 0):
            w.insert(r.randrange(len(w)), r.choice(["blorgish", "blorgs"]))
        rows.append((i, " ".join(w), lang, "s", "n"))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(200 + i, rows[i][1] + " tail", rows[i][2], "s", "n") for i in range(0, 60, 3)] + [(300, "77 88", "xx", "s", "n")]
    docs, at = folder(rows, labels)
    model = toxicity.learn(docs, spark.createDataFrame([(i, t) for i, _, t in labels], "doc_id long, label int"))
    bad = {t for t, s in zip([x[1] for x in rows], plain_scores([x[1] for x in rows], model.margin, model.offset)) if s >= toxicity.THRESHOLD}
    left = [(i, t) for i, t, *_ in rows if t not in bad and re.search(r"[^\W\d_]", t)]
    _, of = components_of([t for _, t in left], 5, 80)
    want = {min(i for (i, _), d in zip(left, of) if d == c) for c in of}
    packed = corpus_pipeline.run(spark, at).collect()
    assert {p.doc_id for p in packed} == want and 60 < len(want) < 120
    ids = tokens.encoder(vocabulary("byte_bpe_50k.json")).whole
    size = {i: len(ids.encode(t, add_special_tokens=False).ids) + 1 for i, t in left}
    tiles = {}
    for p in sorted(packed, key=lambda p: (p.doc_id, p.start)):
        assert tiles.get(p.doc_id, 0) == p.start and p.doc_tokens == size[p.doc_id]
        tiles[p.doc_id] = p.start + p.length
    assert tiles == {i: size[i] for i in want}
    places = {}
    for p in sorted(packed, key=lambda p: (p.sequence_id, p.offset)):
        assert places.get(p.sequence_id, 0) == p.offset
        places[p.sequence_id] = p.offset + p.length
    assert max(places.values()) <= 2048
