"""Language ID, toxicity, pieces, token files, packing, Jaccard join, HTML and chat on small fixtures."""

import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskline.llm import chat, html, jaccard, langid, packing, pieces, tokenfile, tokens, toxicity, words
from maskline.llm.common import components
from maskline.llm.queries import vocabulary

ODD = [None, "", " ", "\n\t ", "a", "ab  cd\n\nef ", "x" * 3000, "é́ ñ 漢字 😀   nbsp", "don't 12,5 I'M <|endoftext|>", "the same", "the same"]


def docs(spark, texts, **more):
    rows = [(i, t) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in more.items():
        d = d.withColumn(name, F.lit(value))
    return d


def prose(seed, n, stems):
    r = random.Random(seed)
    return [" ".join(r.choice(stems) + r.choice(stems) for _ in range(r.randint(5, 60))) for _ in range(n)]


def test_words_are_those_of_a_regex():
    r = random.Random(3)
    texts = ODD + ["".join(r.choice("aB é\n\t.") for _ in range(r.randint(0, 50))) for _ in range(200)] + [" ".join("w" * 9 for _ in range(200_000))]
    data, off = words.text_buffer(pa.array(texts, pa.string()))
    doc, s, e, h = words.spans(data, off, values=words.FOLD)
    raw = data.tobytes()
    got = {}
    for d, a, z in zip(doc.tolist(), s.tolist(), e.tolist()):
        got.setdefault(d, []).append(raw[a:z].decode())
    assert [got.get(i, []) for i in range(len(texts))] == [re.findall(r"[^\x20\x09-\x0d]+", t or "") for t in texts]
    same = {}
    for k, a, z in zip(h.tolist(), s.tolist(), e.tolist()):
        assert same.setdefault(k, raw[a:z].lower()) == raw[a:z].lower()
    _, s, e, _ = words.spans(data, off, lead=True)
    assert s.tolist()[1:] == e.tolist()[:-1] and int((e - s).sum()) == len(raw)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_librarys(name):
    enc = tokens.encoder(vocabulary(name))
    r = random.Random(5)
    texts = ODD + ["".join(r.choice(" \n\tab'sÉé.,!9< |ı́ ") for _ in range(40)) for _ in range(400)]
    ids, counts = enc.encode(*words.text_buffer(pa.array(texts, pa.string())))
    ends = np.cumsum(counts)
    for t, n, z in zip(texts, counts.tolist(), ends.tolist()):
        assert ids[z - n : z].tolist() == enc.whole.encode(t or "", add_special_tokens=False).ids


def test_a_full_span_table_still_answers():
    t = words.SpanTable(5, np.int32)
    raw = b" ".join(b"w%d" % i for i in range(50))
    data, off = words.text_buffer(pa.array([raw.decode()]))
    for _ in range(2):
        _, s, e, h = words.spans(data, off)
        values, first, size = t.look(raw, s, e, h, lambda x: (np.array([int(w[1:]) for w in x], np.int32), [1] * len(x)))
        assert values[first].tolist() == list(range(50)) and set(size.tolist()) == {1}


def test_language_costs_equal_a_plain_model():
    texts = {"a": [b"abab", b"abc"], "b": [b"xyxy", b"ab"]}
    m = langid.PPM(texts, order=2)

    def plain(lang, doc):
        seen = {}
        for t in texts[lang]:
            t = bytes(2) + t
            for i in range(2, len(t)):
                for k in range(3):
                    seen.setdefault(t[i - k : i], {}).setdefault(t[i], 0)
                    seen[t[i - k : i]][t[i]] += 1
        bits, doc = 0.0, bytes(2) + doc
        for i in range(2, len(doc)):
            for k in (2, 1, 0):
                c = seen.get(doc[i - k : i])
                if not c:
                    continue
                total = sum(c.values()) + len(c)
                if doc[i] in c:
                    bits += np.log2(total / c[doc[i]])
                    break
                bits += np.log2(total / len(c))
            else:
                bits += 8
        return bits

    batch = [b"abcab", b"", b"xyz", b"q", b"ab"]
    data, off = words.text_buffer(pa.array([x.decode() for x in batch]))
    want = [[plain(x, d) for x in ("a", "b")] for d in batch]
    assert np.allclose(m.bits(data, off), want, atol=1e-4)
    old, langid.STEP = langid.STEP, 3  # steps end inside documents
    try:
        assert np.allclose(m.bits(data, off), want, atol=1e-4)
    finally:
        langid.STEP = old


def test_language_id(spark):
    train = spark.createDataFrame(
        [(i, t, lang) for lang, stems in (("xx", ["ka", "lo", "mi"]), ("yy", ["thr", "ing", "est"])) for i, t in enumerate(prose(1, 40, stems))] + [(99, None, "xx"), (98, "zz", None)],
        "doc_id long, text string, lang string",
    )
    model = langid.learn(train)
    test = docs(spark, prose(2, 5, ["ka", "lo", "mi"]) + prose(3, 5, ["thr", "ing", "est"]) + [None, "", "12 34"], score="kept?", source="s")
    got = langid.predict(test, model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["xx"] * 5 + ["yy"] * 5 + ["und"] * 3
    assert all(0 <= r.score <= 1 and r.source == "s" for r in got)
    none = langid.learn(train.where("false"))
    assert [r.lang_pred for r in langid.predict(test, none).collect()] == ["und"] * 13
    assert langid.predict(test.where("false"), model).count() == 0


def test_long_texts_are_learned(spark):
    long = lambda *stems: " ".join(prose(5, 200, list(stems)))
    rows = [(i, long(*(("ka", "lo") if i % 2 else ("thr", "ing"))), "xx" if i % 2 else "yy", i % 2) for i in range(8)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, label int")
    bound = min(len(r[1]) for r in rows) // 2  # each text alone is over it
    model = langid.learn(d, bound)
    assert sorted(model.languages) == ["xx", "yy"]
    assert all(r.lang == r.lang_pred for r in langid.predict(d, model).collect())
    scored = toxicity.score(d, toxicity.learn(d, d.select("doc_id", "label"), size=bound)).collect()
    assert max(r.score for r in scored if not r.label) < min(r.score for r in scored if r.label)


def test_toxicity(spark):
    r = random.Random(1)
    rows = []
    for i in range(400):
        text = prose(i, 1, ["ka", "lo", "mi", "ne"])[0].split()
        if i % 3 == 0:
            for _ in range(1 + len(text) // 8):
                text.insert(r.randrange(len(text)), r.choice(["blorgish", "blorgy", "Blorgs!"]))
        rows.append((i, " ".join(text), int(i % 3 == 0)))
    d = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.learn(d.where("doc_id < 300").drop("label"), d.where("doc_id < 300").select("doc_id", "label"))
    got = toxicity.score(d.where("doc_id >= 300"), model).collect()
    assert np.mean([(x.score >= 0.5) == (x.label == 1) for x in got]) > 0.95
    unseen = toxicity.score(docs(spark, ["kalo mine blorgoid loka", "kalo mine loka", None, ""], predicted=7), model).orderBy("doc_id").collect()
    assert unseen[0].score > 0.5 > unseen[1].score and unseen[2].score == unseen[3].score and {x.predicted for x in unseen} <= {0, 1}
    empty = toxicity.learn(d.where("false").drop("label"), d.where("false").select("doc_id", "label"))
    assert all(x.score < 0.01 for x in toxicity.score(d.limit(3), empty).collect())


def test_pieces(spark):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(2)
    texts = ODD + ["a▁b", "hello    world", "-----===="] + ["".join(r.choice("  \nabthein'Sé.,!09語😀") for _ in range(60)) for _ in range(300)]
    got = pieces.decode(pieces.encode(docs(spark, texts, ids=1, source="s"), path), path).orderBy("doc_id").collect()
    for x in got:
        assert x.ids == sp.encode(x.text or "") and x.decoded == sp.decode(x.ids) and x.n_tokens == len(x.ids)
    once = pieces.encode(docs(spark, texts, ids=1, decoded=2, source="s"), path, decoded=True).orderBy("doc_id").collect()
    assert [x.asDict() for x in once] == [x.asDict() for x in got]


def test_unigram_pieces_equal_brute_force():
    vocab = ["<unk>", "▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "cb"]
    scores = [0.0, -2.0, -3.0, -3.1, -3.2, -4.0, -4.1, -6.5, -4.2, -5.0, -3.9]
    m = pieces.PieceModel(vocab, scores, "unigram", {})

    def best(w):
        if not w:
            return 0.0, []
        found = [(m.scores[w[:k]] + best(w[k:])[0], [vocab.index(w[:k]), *best(w[k:])[1]]) for k in range(1, len(w) + 1) if w[:k] in m.scores]
        return max(found, key=lambda x: x[0])

    r = random.Random(4)
    some = ["▁" + "".join(r.choice("abc") for _ in range(r.randint(0, 9))) for _ in range(200)]
    for w, ids in zip(some, m.encode_words(some)):
        assert abs(sum(scores[i] for i in ids) - best(w)[0]) < 1e-9 and "".join(vocab[i] for i in ids) == w


def test_token_files(spark):
    path = vocabulary("word_bpe_49k.json")
    d = docs(spark, ODD * 30 + prose(1, 50, ["ka", "lo"]), lang="x").unionByName(spark.createDataFrame([(None, "null id", "x")], "doc_id long, text string, lang string")).repartition(3)
    got = tokenfile.round_trip(d, path).orderBy("start").collect()
    enc, at = tokens.encoder(path).whole, 0
    rows = sorted(d.collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    for r, x in zip(rows, got, strict=True):
        ids = np.array([*enc.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (x.doc_id, x.start, x.n_tokens, x.ids_crc32) == (r.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert tokenfile.round_trip(d.where("false"), path).count() == 0


def test_blocks_round_trip():
    r = np.random.default_rng(1)
    for ids in (np.zeros(0, int), np.full(5000, 7), r.integers(0, 2**32, 3000), np.where(r.random(9000) < 0.03, 2**31, r.integers(40, 90, 9000)), np.array([3])):
        blocks = tokenfile.encode_blocks(ids.astype(np.uint32))
        back = np.concatenate([tokenfile.decode_block(b) for b in blocks]) if blocks else np.zeros(0)
        assert (back == ids).all() and len(back) == len(ids)


def test_packing(spark):
    path = vocabulary("byte_bpe_50k.json")
    d = docs(spark, ODD + prose(5, 300, ["ka", "lo", "thr"]) + [" ".join(prose(6, 300, ["ab", "cd"]))], source="s").repartition(2)
    enc = tokens.encoder(path).whole
    want = {r.doc_id: np.array([*enc.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in d.collect()}
    for capacity in (2048, 64):
        got = packing.pack(d, path, capacity=capacity).collect()
        by_doc, by_seq = {}, {}
        for p in got:
            by_doc.setdefault(p.doc_id, []).append(p)
            by_seq.setdefault(p.sequence_id, []).append(p)
        assert set(by_doc) == set(want)
        for k, ps in by_doc.items():
            at = 0
            for p in sorted(ps, key=lambda p: p.start):
                assert p.start == at and p.length > 0 and p.doc_tokens == len(want[k])
                at += p.length
                assert p.ids_crc32 == zlib.crc32(want[k][p.start : at].tobytes())
            assert at == len(want[k])
        for ps in by_seq.values():
            at = 0
            for p in sorted(ps, key=lambda p: p.offset):
                assert p.offset == at
                at += p.length
            assert at <= capacity and at & (at - 1) == 0  # full, or a power of two
    assert packing.pack(d.where("false"), path).count() == 0


def brute_components(texts, n, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_jaccard(spark, n, percent):
    r = random.Random(n)
    stems = ["ka", "lo", "mi", "thr", "ing"]
    base = prose(1, 12, stems)
    passage = " ".join(prose(2, 1, stems)[0].split() * 2)
    texts = list(ODD) + base
    for t in base:
        w = t.split()
        for _ in range(8):
            v = list(w)
            for _ in range(r.randint(0, 3)):
                v[r.randrange(len(v))] = r.choice(["new", "Other", "zz"])
            texts.append(" ".join(v) if r.random() < 0.8 else " ".join(v).upper())
    texts += [passage + " " + x for x in prose(3, 20, stems)] + ["one two", "ONE  two", "one two three"]
    sizes, comp = brute_components(texts, n, percent)
    got = jaccard.join(docs(spark, texts, c=1, n=2), n, percent).orderBy("doc_id").collect()
    assert [(x.n_shingles, x.component_id) for x in got] == list(zip(sizes, comp))


def test_jaccard_edges(spark):
    d = docs(spark, ["same text here now yes", None]).unionByName(docs(spark, ["same text here now yes"])).unionByName(spark.createDataFrame([(None, "same text here now yes")], "doc_id long, text string"))
    got = sorted(jaccard.join(d).collect(), key=str)
    assert len(got) == 4 and {x.component_id for x in got if x.n_shingles} == {0}
    assert jaccard.join(d.where("false")).count() == 0


def test_jaccard_bridge_without_doc_id(spark):
    w = [f"w{i}" for i in range(60)]
    near = lambda a, b: " ".join(w[a:b])
    rows = [(1, near(0, 50)), (None, near(4, 54)), (2, near(8, 58)), (None, near(4, 54).upper()), (9, " ".join(reversed(w)))]  # 1 and 2 link through the middle alone
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.component_id) for r in jaccard.join(d, 5, 80).collect()))
    assert got == [(0, 1), (0, 1), (1, 1), (2, 1), (9, 9)]


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(e).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a><li>More</ul></nav><!-- a <p>b</p> -->
<div class="cookie-notice">We use cookies and more cookies</div><main><article><h1>Head  &amp; line</h1><p>First &lt;para&gt;,<br>with <b>bold text
of some length.<p>Second.<div class="ad">Buy this now please</div><ul><li>one<li>two</ul><form><label>Name</label></form>
<section id="comments"><p>Great article, thanks for it</section></article><aside>Side bar</aside></main><footer>&copy; 2026</footer></body></html>"""


def test_html(spark):
    want = "Head & line\nFirst <para>, with bold text of some length.\nSecond.\none\ntwo"
    rows = [(1, PAGE), (2, None), (3, ""), (4, "plain words only"), (5, "<p>a" * 3), (6, "<![if x]><div"), (7, PAGE), (8, "<nav>x</nav>")]
    d = spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit("u")).withColumn("text", F.lit("old"))
    got = html.extract(d).orderBy("page_id").collect()
    assert [got[0].text, got[6].text] == [want, want] and [got[1].text, got[2].text, got[7].text] == ["", "", ""]
    assert got[3].text == "plain words only" and got[4].text == "a\na\na" and all(r.n_chars == len(r.text) and r.url == "u" for r in got)
    assert html.extract(d.where("false")).count() == 0


def test_html_keeps_all_content():
    long = lambda c: f"<p>{' '.join([c * 7] * 40)}</p>"
    menu = "<nav><a href=x>one</a><a href=y>two</a></nav>"
    kept = lambda body: {w[0] for w in html.main_text(f"<html><body>{menu}{body}</body></html>").split()}
    assert kept(f"<div>{long('a') * 3}</div><div>{long('b') * 2}</div>") == {"a", "b"}
    assert kept(f"<section>{long('a') * 3}</section><section><h2>h</h2>{long('b') * 2}</section>") == {"a", "b", "h"}
    assert kept(f"<article>{long('a') * 3}</article><article><p>short one</p></article>{long('c') * 3}") == {"a", "s", "o", "c"}
    for name in ("content has-sidebar", "no-sidebar", "with-sidebar", "header-fixed", "hasSidebar"):
        assert kept(f"<div class='{name}'>{long('a') * 3}</div>") == {"a"}
    for name in ("sidebar", "sidebar-left", "site-header", "post-comments", "related-posts"):
        assert kept(f"<div>{long('a') * 3}</div><div class='{name}'>{long('b')}</div>") == {"a"}
    assert kept(f"<div>{long('a') * 2}</div><div class='comments'>{long('b') * 9}</div>") == {"a"}


def test_chat(spark):
    tools = {"reply": {"prompt": ("string", True)}, "add": {"a": ("integer", True), "b": ("number", False)}}
    calls = '{"tool_calls":[{"id":"x","name":"add","arguments":{"b": 2.5, "a": 1}},{"id":"y","name":"add","arguments":{"a":"one"},"after":["x"]},{"id":"z","name":"gone","arguments":{}},{"id":"p","name":"add","arguments":{"a":1},"after":["q"]},{"id":"q","name":"add","arguments":{"a":1},"after":["p"]}]}'
    rows = [
        (1, 0, "user", 'say "hi"\n'), (1, 1, "assistant", "hi"), (1, 2, "system", "be\tnice"), (1, 3, "assistant", calls), (1, 4, "tool", '{"tool_call_id":"x","content":"3.5"}'), (1, 5, "tool", '{"tool_call_id":"w","content":"?"}'),
        (2, 0, "user", None), (2, 0, "user", None), (2, 5, "assistant", "late"), (3, None, None, "x"), (None, 1, "assistant", "lost"), (4, 0, "user", "q"), (4, 1, "assistant", "b"), (4, 1, "assistant", "a"),
    ]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("json", F.lit(1))
    got = chat.format_chat(d, tools).collect()
    by = {(r.conv_id, r.call_id): r for r in got if r.call_id}
    assert by[1, "turn-0"].json == r'{"arguments":{"prompt":"say \"hi\"\n"},"id":"turn-0","name":"reply","result":"hi"}' and by[1, "turn-0"].valid
    assert by[1, "x"].json == '{"arguments":{"a":1,"b":2.5},"id":"x","name":"add","result":"3.5"}' and by[1, "x"].valid
    assert by[1, "y"].problems == "a is no integer; no result" and (by[1, "x"].level, by[1, "y"].level) == (0, 1)
    assert by[1, "z"].problems.startswith("unknown tool") and by[1, "p"].level is None and "cycle" in by[1, "q"].problems
    assert by[1, "w"].kind == "orphan" and by[2, "turn-0"].problems == "missing prompt; no result" and by[4, "turn-0"].problems == "several results"
    assert sum(r.conv_id == 2 for r in got) == 3 and sum(r.kind == "message" for r in got) == 2
    assert chat.format_chat(d.where("false")).count() == 0


def test_chat_loses_no_result(spark):
    t = lambda i, c: f'{{"tool_call_id":"{i}","content":"{c}"}}'
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (1, 2, "tool", t("w", "x")), (1, 3, "tool", t("w", "y")), (2, 0, "user", "q"), (2, 1, "assistant", '{"tool_calls":[]}')]
    got = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    lines = sorted((r.conv_id, r.call_id, r.kind, r.n_results, json.loads(r.json)["result"]) for r in got)
    assert lines == [(1, "turn-0", "call", 3, "a"), (1, "turn-0", "result", 3, "b"), (1, "turn-0", "result", 3, "b"), (1, "w", "orphan", 2, "x"), (1, "w", "result", 2, "y"), (2, "turn-0", "call", 1, '{"tool_calls":[]}')]


def test_chat_levels_have_no_most(spark, monkeypatch):
    monkeypatch.setattr(chat, "range", lambda n: range(2), raising=False)  # as if any bound on the rounds were 2
    chain = spark.createDataFrame([(1, str(i), [str(i - 1)] if i else []) for i in range(5)], "conv_id long, call_id string, after array<string>")
    assert sorted((r.call_id, r.level) for r in chat.levels(chain).collect()) == [("1", 1), ("2", 2), ("3", 3), ("4", 4)]
