"""Operators on single texts: edge cases, and the libraries they must agree with."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from spanloom.llm import fingerprints, language, quality, queries, sentencepieces, token_counts, token_ids
from spanloom.llm.piece_model import PieceModel, Segmenter, words_of

PIECES, BYTES = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")
LETTERS = "abcdehint ▁   \n\té中梦A.,0123 the<s>x😢'l\xa0"


def noise(n: int, most: int = 50) -> list[str]:
    draw = random.Random(7)
    return ["".join(draw.choice(LETTERS) for _ in range(draw.randint(0, most))) for _ in range(n)] + ["", " ", "\n", "a<|endoftext|> b", "ab" * 3000, "  x", "x \n y"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_segments_equal_the_library(library):
    seg = Segmenter(PieceModel(PIECES))
    for t in noise(3000):
        assert [i for w in words_of(t) for i in seg.segment(w)] == library.encode(t), repr(t)


def test_unigram_viterbi_is_the_best_segmentation():
    model = PieceModel(PIECES)
    seg = Segmenter(model, bpe=False)

    def best(w):
        if not w:
            return 0.0
        return max((model.scores[seg.ids[w[-k:]]] + best(w[:-k]) for k in range(1, len(w) + 1) if w[-k:] in seg.ids), default=float("-inf"))

    for w in ("▁the", "▁these", "▁thesis", "▁a", "retention", "▁walking"):
        got = seg.segment(w)
        assert "".join(model.pieces[i] for i in got) == w
        assert sum(model.scores[i] for i in got) == pytest.approx(best(w))


@pytest.mark.parametrize("chunk, few", [(256, 48), (7, 1), (1, 1), (5, 10_000)])
def test_counts_equal_the_library_however_chunks_fall(library, monkeypatch, chunk, few):
    """Chunks of one character are composed of nothing but state maps; lanes run side by side or one by one."""
    monkeypatch.setattr(token_counts, "CHUNK_CHARS", chunk)
    monkeypatch.setattr(token_counts, "FEW_LANES", few)
    t = token_counts.CountTransducer(Segmenter(PieceModel(PIECES)), max_steps=1500)
    texts = noise(1500) + [" " * k + "the" for k in range(70)] + ["x" + " " * 77, "中文" * 300, "▁ ▁▁", "\0", "a\0 b"]
    for k in range(0, len(texts), 400):
        part = texts[k : k + 400]
        assert t.count_all(part) == [len(x) for x in library.encode(part)]
    assert t.count_all([]) == [] and t.count("") == 0
    assert [len(g) for g in t.groups(["a" * token_counts.GROUP_CHARS] * 2)] == [1, 1]


def test_count_tokens_on_odd_rows(odd, none, library):
    got = token_counts.count_tokens(odd, PIECES, limit=100).collect()
    assert len(got) == odd.count()
    texts = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), len(library.encode(r["text"] or ""))) for r in odd.collect())
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in got) == texts
    assert token_counts.count_tokens(none, PIECES).count() == 0


def test_sentencepiece_round_trip_on_odd_rows(odd, none, library):
    ids = sentencepieces.encode(odd, PIECES)
    for r in ids.collect():
        assert (r["ids"] is None) or library.decode(r["ids"]) is not None
    back = sentencepieces.decode(ids, PIECES).collect()
    key = lambda r: (r["doc_id"] or -1, r["text"] or "", r["text"] is None)
    plain = [r for r in odd.select("doc_id", "text").collect() if "▁" not in (r["text"] or "")]
    assert sorted(map(key, plain)) == sorted(key(r) for r in back if "  two" not in (r["text"] or ""))
    assert sentencepieces.round_trip(none, PIECES).count() == 0
    digests = sentencepieces.round_trip(odd, PIECES).collect()
    for r in digests:
        assert r["same"] or r["doc_id"] == 7  # U+2581 decodes to a blank


def test_token_id_units_equal_the_library():
    tokenizer, encoder = Tokenizer.from_file(BYTES), token_ids.UnitEncoder(BYTES, max_units=100)
    texts = noise(2000)
    for t, ids in zip(texts, encoder.encode_all(texts)):
        assert tokenizer.encode(t, add_special_tokens=False).ids == np.frombuffer(ids, "<u4").tolist(), repr(t)


@pytest.mark.parametrize("bits", [1, 8])
@pytest.mark.parametrize("n", [0, 1, 7, 16384, 40001])
def test_planes_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    payload, ends = token_ids.pack(ids, bits)
    assert (token_ids.unpack(payload, ends, n, bits) == ids).all()
    assert not ends or ends[-1] == len(payload)


def test_token_ids_on_odd_rows(odd, none):
    tokenizer = Tokenizer.from_file(BYTES)
    got = sorted(token_ids.read_token_ids(token_ids.write_token_ids(odd, BYTES, 2)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] or -1 for r in got] == sorted(r["doc_id"] or -1 for r in odd.collect())
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    ids = lambda t: np.asarray(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
    assert sorted(r["ids_crc32"] for r in got) == sorted(zlib.crc32(ids(r["text"])) for r in odd.collect())
    assert token_ids.read_token_ids(token_ids.write_token_ids(none, BYTES, 2)).count() == 0


def test_language_forward_sums_all_segmentations():
    pieces = language.Pieces(PIECES)
    model = language.LanguageModel.fit(pieces, {"a": {"▁the": 5, "▁then": 2}, "b": {"▁den": 4, "▁ñu": 1}})

    def total(w, k):
        if not w:
            return 1.0
        found = [(pieces.ids.get(w[-n:], pieces.foreign if n == 1 else None), n) for n in range(1, min(len(w), pieces.longest) + 1)]
        return sum(model.p[i, k] * total(w[:-n], k) for i, n in found if i is not None)

    for w in ("▁then", "▁deñ", "▁x中"):
        model.learn({w})
        assert np.exp(model.scores[model.known[w]]) == pytest.approx([total(w, 0), total(w, 1)])
    assert model.predict([None, "", "12 !?", "\n", "½ ²"]) == [("und", 0.0)] * 5
    # Runs of any length: the log of the whole sum, which itself would be no number.
    run = "then" * 30 + "é"
    whole = model.learn({"▁" + run})["▁" + run]
    table = [[1.0, 1.0]]
    for e in range(1, len(run) + 2):
        w = ("▁" + run)[:e]
        row = [0.0, 0.0]
        for n in range(1, min(e, pieces.longest) + 1):
            i = pieces.ids.get(w[-n:], pieces.foreign if n == 1 else None)
            if i is not None:
                row = [x + table[e - n][k] * model.p[i, k] * 10.0**n for k, x in enumerate(row)]
        table.append(row)
    assert whole == pytest.approx([np.log(x) - (len(run) + 1) * np.log(10) for x in table[-1]])
    assert "▁" + run not in model.known and model.predict([run * 400])[0][0] in ("a", "b")
    assert model.predict(["the then"])[0][0] == "a"


def test_language_on_odd_rows(odd, none, spark):
    rows = [(i, t, lang) for i in range(60) for t, lang in (("the words of the language and then some", "en"), ("der die das und nicht ein wort", "de"))]
    train = spark.createDataFrame([*rows, (1, None, "en"), (2, "nothing", None)], "doc_id bigint, text string, lang string")
    model = language.train(train, PIECES)
    assert model.languages == ["de", "en"]
    got = {(r["doc_id"], r["lang_pred"]) for r in language.predict(odd, model, PIECES).collect()}
    assert (1, "und") in got and (5, "en") in got
    assert language.predict(none, model, PIECES).count() == 0
    assert language.train(train.where("false"), PIECES).languages == []


def test_fingerprints():
    text = " ".join(f"w{i * i % 1013}" for i in range(800))
    edited = fingerprints.edit(text, "other words " * 400)
    a, b, c = map(fingerprints.fingerprint, (text, edited, " ".join(f"q{i * 7 % 919}" for i in range(800))))
    assert fingerprints.likeness(a, a) == 1 and 0.4 < fingerprints.likeness(a, b) < 0.95 and fingerprints.likeness(a, c) < 0.1
    assert fingerprints.fingerprint(None) == fingerprints.fingerprint("") == "3::"
    assert fingerprints.likeness("3::", a) in (0.0, 0) and fingerprints.likeness("3::", "3::") == 1.0

    def lcs(x, y):  # plain table
        row = [0] * (len(y) + 1)
        for p in x:
            last, row = row, [0]
            for j, q in enumerate(y):
                row.append(last[j] + 1 if p == q else max(last[j + 1], row[-1]))
        return row[-1]

    draw = random.Random(3)
    for _ in range(200):
        x, y = ([draw.choice("abcd") for _ in range(draw.randint(0, 30))] for _ in range(2))
        assert fingerprints._common(x, y) == lcs(x, y)


def test_fingerprint_rows(odd, none, spark):
    ids = [5, 3, 9, 1, 7, 20, 30, 40, 41, 42, 43]
    docs = spark.createDataFrame([(i, "text " * (i * 3) + str(i)) for i in ids], "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    order = sorted(ids, reverse=True)
    for k, i in enumerate(order):
        following = texts[order[(k + 1) % len(order)]]
        assert got[i]["edited_sha256"] == hashlib.sha256(fingerprints.edit(texts[i], following).encode()).hexdigest()
        assert got[i]["near_next"] == fingerprints.likeness(fingerprints.fingerprint(texts[i]), fingerprints.fingerprint(following))
    assert fingerprints.fingerprint_documents(odd).count() == odd.count()
    assert fingerprints.fingerprint_documents(none).count() == 0
    one = fingerprints.fingerprint_documents(docs.where("doc_id = 9")).first()
    assert one["near_next"] == 1.0


def slow_fingerprint(text):
    """Chunks by plain loops: every byte's hash from its last seven bytes alone."""
    data = (text or "").encode()
    if not data:
        return "3::"
    mask = 0xFFFFFFFF
    turned = lambda x, r: (x << r | x >> (32 - r)) & mask if r else x
    hashes = []
    for i in range(len(data)):
        h = 0
        for k in range(7):
            if i >= k:
                h ^= turned((data[i - k] + 1) * 0x9E3779B97F4A7C15 % 2**64 >> 24 & mask, 5 * k % 32)
        h ^= h >> 15
        h = h * 0x2C1B3C6D & mask
        hashes.append(h ^ h >> 12)

    def chunks(b):
        out, start = [], 0
        for i, h in enumerate(hashes):
            if h % b == b - 1:
                out.append(data[start : i + 1])
                start = i + 1
        return out, data[start:]

    block = 3
    while block * 64 < len(data):
        block *= 2
    while block > 3 and len(chunks(block)[0]) < 32:
        block //= 2
    signs = []
    for b in (block, 2 * block):
        whole, rest = chunks(b)
        signs.append("".join(fingerprints._PAIRS[zlib.crc32(c) & 4095] for c in whole + ([rest] if rest else [])))
    return f"{block}:{signs[0]}:{signs[1]}"


def slow_likeness(a, b):
    """One less the insertions and deletions between signatures over their joint length, at the best common block size."""

    def near(x, y):
        x, y = ([s[i : i + 2] for i in range(0, len(s), 2)] for s in (x, y))
        row = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            last, row = row, [i]
            for j, q in enumerate(y, 1):
                row.append(last[j - 1] if p == q else 1 + min(last[j], row[-1]))
        return 1 - row[-1] / (len(x) + len(y)) if x or y else 1.0

    if a == b:
        return 1.0
    (p, *x), (q, *y) = a.split(":"), b.split(":")
    p, q = int(p), int(q)
    found = [near(s, t) for i, s in ((p, x[0]), (2 * p, x[1])) for j, t in ((q, y[0]), (2 * q, y[1])) if i == j]
    return max(found, default=0.0)


def test_fingerprint_query_against_loops(spark, monkeypatch):
    draw = random.Random(12)
    words = [f"w{k}" for k in range(300)]
    rows = [(k * 5 % 41, None if k == 7 else " ".join(draw.choice(words) for _ in range(draw.choice([0, 1, 30, 400])))) for k in range(41)]
    monkeypatch.setattr(queries, "table", lambda *_: spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    got = {r["doc_id"]: r for r in queries.op8_fingerprints(spark, "").collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        k = len(text) // 3
        edited = text[: len(text) - k] + following[:k]
        own, other, after = map(slow_fingerprint, (text, edited, following))
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"], got[i]["n_chars"]) == (own, other, len(text))
        assert (got[i]["near_edited"], got[i]["near_next"]) == pytest.approx((slow_likeness(own, other), slow_likeness(own, after)))


def test_language_query(spark):
    """Held-out rows by the contract's rule; languages as a slow sum over all segmentations gives them; accuracy on held-out rows."""
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op4_language(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"] and docs[r["doc_id"]]["lang"] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.9 * len(held) > 20
    left = spark.read.parquet(f"{sf}/documents.parquet").where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    model = language.train(left, PIECES, docs_per_language=400)
    p = model.p.astype(np.float32).astype(float)

    def log_sum(word):
        table = [np.ones(len(model.languages))]
        for e in range(1, len(word) + 1):
            ids = [(model.pieces.ids.get(word[e - n : e], model.pieces.foreign if n == 1 else None), n) for n in range(1, e + 1)]
            table.append(sum(table[e - n] * p[i] for i, n in ids if i is not None))
        return np.log(table[-1])

    short = [r for r in got if docs[r["doc_id"]]["text"] and len(docs[r["doc_id"]]["text"]) < 400][:25]
    for r in short:
        words = language.split_words(docs[r["doc_id"]]["text"])
        if words:
            total = sum(map(log_sum, words))
            assert r["lang_pred"] == model.languages[int(total.argmax())]
            assert r["score"] == pytest.approx(1 / np.exp(total - total.max()).sum())


def test_ordinal_loss_and_gradient():
    """The loss sample by sample, and its gradient by differences."""
    draw = np.random.default_rng(4)
    size, n, ridge = 7, 12, 0.1
    held = [np.flatnonzero(draw.random(size) < 0.5) for _ in range(n)]
    rows, cols = np.repeat(np.arange(n), [len(h) for h in held]), np.concatenate(held)
    y, share = draw.integers(0, 3, n), draw.random(n)
    share /= share.sum()
    params = draw.normal(size=size + 2)

    def slow(q):
        first, second = q[size], q[size] + np.exp(q[size + 1])
        total = ridge / 2 * (q[:size] ** 2).sum()
        for i in range(n):
            z = q[held[i]].sum()
            below = [0, 1 / (1 + np.exp(z - first)), 1 / (1 + np.exp(z - second)), 1]
            total -= share[i] * np.log(below[y[i] + 1] - below[y[i]])
        return total

    loss, grad = quality.loss_gradient(params, rows, cols, y, share, ridge)
    assert loss == pytest.approx(slow(params))
    for k in range(size + 2):
        step = np.eye(size + 2)[k] * 1e-6
        assert grad[k] == pytest.approx((slow(params + step) - slow(params - step)) / 2e-6, abs=1e-6)


def test_quality_query(spark):
    """Every row's tail probabilities from the weights by plain sums; held-out accuracy of what is kept."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels, rated_per_grade=6000)
    weights = dict(zip(model.table[0].tolist(), model.table[1].tolist()))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = queries.op10_quality(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got[::7]:
        found = quality.features(texts[r["doc_id"]])
        if found:
            z = sum(weights.get(x, 0.0) for x in found)
            tails = [1 - 1 / (1 + np.exp(np.clip(z - t, -30, 30))) for t in model.thresholds]
            assert (r["p_fair"], r["p_good"], r["expected_grade"]) == pytest.approx((*tails, sum(tails)))
        assert r["keep"] == (r["p_good"] >= 0.6)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = labels.where("doc_id % 2 = 0")
    model = quality.train(docs, half, rated_per_grade=6000)
    texts = {r["doc_id"]: r["text"] for r in docs.join(labels.where("doc_id % 2 = 1"), "doc_id", "left_semi").collect()}
    grade = {r["doc_id"]: 0 if r["toxic"] == 1 else 2 if r["quality"] == 1 else 1 for r in labels.where("doc_id % 2 = 1").collect()}
    kept = {i: model.score(texts[i])[1][-1] >= 0.6 for i in grade}
    right = [sum(kept[i] == (g == 2) for i, g in grade.items() if (g == 2) == good) / sum((g == 2) == good for g in grade.values()) for good in (False, True)]
    assert min(right) >= 0.85 and sum(right) >= 1.8, right


def test_ordinal_model_orders_grades():
    draw = random.Random(5)
    words = {0: ["nasty", "vile"], 1: ["%%%", "&&&"], 2: []}
    samples = []
    for k in range(900):
        grade = k % 3
        text = " ".join([draw.choice("abcdefgh") * 2 for _ in range(12)] + words[grade])
        samples.append((np.array(sorted(quality.features(text)), np.uint32), grade, 1.0))
    model = quality.OrdinalModel.fit(samples)
    plain = "aa bb cc dd ee ff gg hh aa bb cc dd"
    assert model.thresholds[0] < model.thresholds[1]
    grades = [model.score(t)[0] for t in (f"{plain} nasty vile", f"{plain} %%% &&&", plain)]
    assert grades[0] < 0.5 < grades[1] < 1.5 < grades[2]
    assert model.score(None) == model.score(" 12 ") == (0.0, [0.0, 0.0])
    tails = model.score("aa bb cc")[1]
    assert 1 >= tails[0] >= tails[1] >= 0


def test_quality_on_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(5, 1, 0), (8, 0, 1), (8, 1, 0), (None, 1, 0), (4, None, None), (9, 0, None)], "doc_id bigint, quality int, toxic int")
    model = quality.train(odd, labels)
    got = quality.score(odd, model).collect()
    assert len(got) == odd.count() and not any(r["keep"] for r in got if r["doc_id"] in (1, 2, 3))
    assert quality.select(odd, model).columns == odd.columns
    assert quality.score(none, model).count() == 0
    assert not len(quality.train(odd, labels.where("false")).table[0])
