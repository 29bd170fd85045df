"""Operators on literal rows, with fresh Python versions of the hard ones."""

import itertools
import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.operators import align, annotate, audit, datasets, examples, metrics, models, spans, subwords, threads
from spanloom.schemas import ANNOTATION, API_ITEM, BIO


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def annotation(flag, kind="statement", *aspects):
    return None if flag is None else (flag, kind, [("s", a, "top", 0.5) for a in aspects])


def test_text_functions(spark):
    lit = F.lit
    assert value(spark, X.strip(lit("  a b \n"))) == "a b"
    assert value(spark, X.word_count(lit(" one two\n three "))) == 3
    assert value(spark, X.word_count(lit("   "))) == 0
    assert value(spark, X.has_script(lit("abc ש"))) and not value(spark, X.has_script(lit("abc 123 😢")))
    assert value(spark, X.normalize(lit("שלום,  עולם! a_b"))) == "שלומ עולמ a_b"
    assert value(spark, X.span_occurs(lit(" b c. "), lit("a b\nc d"))) and not value(spark, X.span_occurs(lit("  "), lit("a")))
    assert value(spark, X.find(lit("a😢b"), lit("b"))) == 2
    assert value(spark, X.error_class(lit("403 quota"))) == "auth" and value(spark, X.error_class(lit("SSL broken"))) == "transient"
    assert [value(spark, X.kappa_word(lit(k))) for k in (-0.1, 0.1, 0.59, 0.8)] == ["Poor", "Slight", "Moderate", "Almost Perfect"]


def test_parse_items(spark):
    comment = lambda i, t, who=None, likes=None: {"id": i, "snippet": {"textDisplay": t, "likeCount": likes, "authorChannelId": {"value": who} if who else None}}
    rows = [
        ("C1", json.dumps({"snippet": {"topLevelComment": comment("a", "שאלה טובה מאוד", "u", 3)}, "replies": {"comments": [comment("a1", "ok", "C1", 2), comment("a2", "english only"), comment("a3", "כן http")]}})),
        ("C1", json.dumps({"snippet": {"topLevelComment": comment("b", "שאלה טובה מאוד", "C1")}})),
        ("C1", json.dumps({"snippet": {"topLevelComment": comment("c", "שאלה קצרה")}})),
        ("C1", json.dumps({"snippet": {"topLevelComment": comment("d", "שאלה בלי תשובות כאן")}})),
    ]
    fields = ", ".join(API_ITEM.split(", ")) if isinstance(API_ITEM, str) else API_ITEM.simpleString()
    df = spark.createDataFrame(rows, "channel_id string, j string").withColumn("o", F.from_json("j", fields)).select("channel_id", "o.*")
    got = {r["thread_id"]: r for r in threads.parse_items(df, spam=("http",)).collect()}
    assert set(got) == {"a", "d"}
    assert [r["comment_id"] for r in got["a"]["replies"]] == ["a1"] and got["a"]["has_creator_reply"] and got["a"]["total_likes"] == 5
    assert got["d"]["replies"] == [] and got["d"]["total_likes"] == 0


def test_score_needs_words(spark):
    rows = [(1, ("t", "plain text", 0), [("r", "yes", 0, True)]), (2, ("t", "why not?", 0), []), (3, ("t", "plain", 0), [("r", "less sugar", 0, True), ("q", "SUGAR", 0, True)])]
    df = spark.createDataFrame(rows, "thread_id int, top_comment struct<comment_id: string, text: string, like_count: bigint>, replies array<struct<comment_id: string, text: string, like_count: bigint, is_creator: boolean>>")
    got = {r["thread_id"]: r["s"] for r in df.select("thread_id", threads.modification_score(("what",), ("sugar",)).alias("s")).collect()}
    assert got == {1: 0, 2: 10, 3: 5 + 2 * (15 + 12)}


def test_question_words(spark):
    assert value(spark, threads.has_question(F.lit("use c++ now"), ("c++", "a.b"))) and not value(spark, threads.has_question(F.lit("use ccc axb"), ("c++", "a.b")))
    for text, want in (("ואפשר לשים", True), ("אפשרות אחרת", False), ("מה", True), ("x?", True), ("text", False)):
        assert value(spark, threads.has_question(F.lit(text), ("אפשר", "מה"))) == want, text


def vote_model(outs, skipped):
    """The rules once more, in plain Python: flag, method, review."""
    a, b, c = outs
    if skipped and c is None and a and b:
        return a[0], "gemini_unanimous", False
    given = [o for o in outs if o]
    if len(given) < 2:
        return (given[0][0] if given else None), "insufficient", True
    yes, sets = sum(o[0] for o in given), [sorted({m[1] for m in o[2]}) for o in given]
    no = len(given) - yes
    method = "no_majority"
    if yes == 3:
        method = "unanimous" if sets[0] == sets[1] == sets[2] else "majority"
    elif no == 3:
        method = "unanimous"
    elif yes >= 2 or no >= 2:
        method = "majority"
    flag = True if yes >= 2 else False if no >= 2 else given[0][0]
    return flag, method, method == "no_majority"


def test_vote_truth_table(spark):
    choices = [None, annotation(False, "question"), annotation(True, "statement", "QUANTITY"), annotation(True, "mixed", "ADDITION", "QUANTITY")]
    cases = [(*o, s) for o in itertools.product(choices, repeat=3) for s in (None, True, False)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"i int, a {ANNOTATION}, b {ANNOTATION}, c {ANNOTATION}, s boolean")
    got = {r["i"]: r["v"] for r in df.select("i", annotate.vote(F.col("a"), F.col("b"), F.col("c"), F.col("s")).alias("v")).collect()}
    for i, (a, b, c, s) in enumerate(cases):
        v = got[i]
        assert ((v["final"]["has_modification"] if v["final"] else None), v["method"], v["needs_review"]) == vote_model((a, b, c), s), cases[i]
    richest = got[next(i for i, x in enumerate(cases) if x == (choices[2], choices[3], choices[2], None))]["final"]
    assert len(richest["modifications"]) == 2


def test_agreement(spark):
    cases = [(None, (True,), "error"), ((False,), (False,), "full"), ((True,), (False,), "none"), ((True, "statement", "A"), (True, "statement", "A"), "full"),
             ((True, "statement", "A", "B"), (True, "statement", "B"), "partial"), ((True, "statement", "A"), (True, "statement", "B"), "none"), ((True,), (True,), "full")]
    df = spark.createDataFrame([(i, x and annotation(*x), y and annotation(*y)) for i, (x, y, _) in enumerate(cases)], f"i int, a {ANNOTATION}, b {ANNOTATION}")
    got = [r["v"] for r in df.orderBy("i").select(annotate.agreement(F.col("a"), F.col("b")).alias("v")).collect()]
    assert got == [c[2] for c in cases]


def test_parse_and_sanitize(spark):
    raw = ['{"a": 1}', '```json\n[1]\n```', 'So: [{"x": 1}] and more', 'text {"y": {"z": 2}} end', "none", "", None]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, t string")
    assert [r["j"] for r in df.orderBy("i").select(annotate.json_text("t").alias("j")).collect()] == ['{"a": 1}', "[1]", '[{"x": 1}]', '{"y": {"z": 2}}', None, None, None]
    text = '{"has_modification": true, "thread_type": "odd", "modifications": [{"span": " x ", "aspect": "quantity", "confidence": "1.7"}, {"span": "y", "aspect": "ADDITION", "confidence": -1}, {"span": "z", "aspect": "OTHER"}, {"span": " ", "aspect": "ADDITION"}]}'
    out = value(spark, annotate.sanitize(F.lit(text)))
    assert out["has_modification"] and out["thread_type"] == "statement"
    assert [(m["span"], m["aspect"], m["confidence"], m["source_comment"]) for m in out["modifications"]] == [("x", "QUANTITY", 1.0, "top"), ("y", "ADDITION", 0.0, "top")]
    assert value(spark, annotate.sanitize(F.lit("[1]"))) is None
    assert value(spark, annotate.sanitize(F.lit('{"modifications": []}')))["has_modification"] is False


def test_clean_spans(spark):
    df = spark.createDataFrame([(1, (True, "question", [("a b", "QUANTITY", "top", 0.5), ("zz", "ADDITION", "top", 0.5)]), "x a\nb"), (2, (True, "mixed", [("zz", "ADDITION", "top", 0.5)]), "x"), (3, None, "x")], f"i int, f {ANNOTATION}, t string")
    got = {r["i"]: r["c"] for r in df.select("i", annotate.clean_spans(F.col("f"), F.col("t")).alias("c")).collect()}
    assert (got[1]["checked"], got[1]["kept"], got[1]["dropped"], got[1]["flipped"]) == (2, 1, 1, False) and got[1]["dropped_examples"][0]["span"] == "zz"
    assert got[2]["flipped"] and not got[2]["label"]["has_modification"] and got[2]["label"]["modifications"] == []
    assert got[3]["label"] is None and got[3]["checked"] == 0


def test_examples(spark):
    mods = lambda *m: [(s, a, w, 0.5) for s, a, w in m]
    rows = [
        ("t1", "top text", ["one", "two"], (True, "statement", mods(("a", "QUANTITY", "top"), ("b", "addition", "reply_2"), ("c", "ADDITION", "reply_9"), ("d", "NOPE", "top"))), "majority"),
        ("t2", "neg", [], (False, "statement", []), "unanimous"), ("t3", "bad", [], (True, "statement", mods(("x", "NOPE", "top"))), "majority"), ("t4", " ", [], (False, "statement", []), "unanimous"),
    ]
    df = spark.createDataFrame(rows, f"thread_id string, top_comment_text string, replies_texts array<string>, label {ANNOTATION}, vote_method string")
    got = {(r["thread_id"], r["source_comment"]): (r["text"], r["has_modification"], [m["span"] for m in r["modifications"]]) for r in examples.comment_examples(df).collect()}
    assert got == {("t1", "top"): ("top text", True, ["a"]), ("t1", "reply_2"): ("two", True, ["b"]), ("t2", "top"): ("neg", False, [])}
    made = value(spark, examples.thread_aware(F.lit("r"), F.lit("q")))
    assert made["text"] == "[שאלה] q [תשובה] r" and made["text"][made["prefix_len"] :] == "r"
    assert value(spark, examples.thread_aware(F.lit(" r"), F.lit("r ")))["prefix_len"] == 0


def test_locate_tiers(spark):
    text = "Mix 😢 the\n flour, then (bake) it now."
    rows = [(1, "the\n flour"), (2, "the flour"), (3, '"bake!'), (4, "then bake it"), (5, " "), (6, "zzz"), (7, "😢 the")]
    df = spark.createDataFrame([(i, text, s) for i, s in rows], "i int, text string, span string")
    got = {r["i"]: r["located"] for r in align.locate(df, "text", "span").collect()}
    assert {i: (g and g["tier"]) for i, g in got.items()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1, 6: None, 7: 1}
    for i, s in rows[:4]:
        piece = text[got[i]["start"] : got[i]["end"]]
        assert re.sub(r"\W+", "", piece) == re.sub(r"\W+", "", s)
    assert align.locate_loose("abc", "  \n") is None


def test_tokens_and_alignment(spark):
    long = " ".join(f"w{k}" + " " * (k % 3) for k in range(1000)) + "\n"
    for text in ("  add a 😢 cup of sugar", "", long, None):
        df = spark.createDataFrame([(1, text)], "id bigint, text string")
        for limit in (4, None):
            got = [(r["pos"], r["start"], r["end"], r["token"]) for r in align.tokens(df, "id", "text", limit).orderBy("pos").collect()]
            assert got == [(k, m.start(), m.end(), m.group()) for k, m in enumerate(re.finditer(r"\S+", text or ""))][:limit]
    rows = align.tokenize(spark.createDataFrame([("add a 😢 cup of sugar",)], "text string"), "text", "tokens", 4)
    spans_ = [(2, 15, 20, "ADDITION"), (1, 4, 7, "ADDITION"), (0, 0, 5, "QUANTITY"), (3, 0, 2, "TECHNIQUE")]
    rows = rows.withColumn("spans", F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(s, ("ord", "start", "end", "aspect"))]) for s in spans_]))
    got = align.align(rows, "tokens", "spans", aligned="aligned").first()
    assert got["tags"] == ["B-QUANTITY", "I-QUANTITY", "B-ADDITION", "O"] and got["aligned"] == 2
    assert align.align(rows, "tokens", "spans", "IO").first()["tags"] == ["I-QUANTITY", "I-QUANTITY", "I-ADDITION", "O"]
    sums = spark.createDataFrame([(2, 1, 1), (0, 0, 0)], "aligned int, truncated int, hallucinated int")
    assert align.alignment_stats(sums).first().asDict() == {"n_spans": 4, "aligned": 2, "truncated": 1, "hallucinated": 1, "alignment_rate": 0.5, "hallucination_rate": 0.25}


def test_find_spans(spark):
    texts = [(1, "so xadd a cup of sugary sweets"), (2, "add two eggs now please"), (2, "add a\ncup"), (2, "add a\ncup"), (3, None), (4, "a cup of"), (5, ""), (6, "é😢 zz zz zzz")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    listed = [(1, "add a cup of sugar"), (2, "a cup of"), (3, "add a cup"), (4, "cup"), (5, None), (6, "zz zz zz"), (7, "two eggs"), (8, "eggs"), (9, "two eggs now"), (10, ""), (11, "😢"), (12, "a"), (8, "eggs")]
    wanted = spark.createDataFrame(listed, "item_id bigint, span string")
    want = sorted((i, k) for i, t in texts for k, s in listed if t and s and s in t)
    for chars in (1 << 20, 20):  # one automaton, and several
        got = sorted((r["example_id"], r["item_id"]) for r in align.find_spans(docs, wanted, "doc_id", "text", chars).collect())
        assert got == want
    assert align.find_spans(docs, wanted.where("span = ''"), "doc_id", "text").count() == 0


def test_align_against_loops(spark):
    draw, rows = random.Random(4), []
    for i in range(150):
        ends = sorted(draw.sample(range(1, 60), draw.randrange(0, 12)))
        words = [(max(0, e - draw.randrange(1, 4)), e) for e in ends]
        words = [(0, 0)] + [(max(a, b0), b) for (a, b), b0 in zip(words, [0] + ends)] + [(0, 0)]
        spans_ = [(draw.randrange(6), a, a + draw.randrange(0, 15), draw.choice("AB")) for a in (draw.randrange(60) for _ in range(draw.randrange(0, 8)))]
        rows.append((i, words if draw.random() > 0.05 else None, spans_ if draw.random() > 0.05 else None))
    df = spark.createDataFrame(rows, "i int, tokens array<struct<start: int, end: int>>, spans array<struct<ord: bigint, start: int, end: int, aspect: string>>")
    for r, (_, words, spans_) in zip(align.align(df, "tokens", "spans", aligned="n", owners="o").orderBy("i").collect(), rows):
        if words is None:
            assert r["tags"] is None
            continue
        seen, want = set(), []
        for a, b in words:
            own = next((s for s in sorted(spans_ or []) if a < s[2] and b > s[1] and b > a), None)
            want.append("O" if own is None else ("I-" if own[0] in seen else "B-") + own[3])
            seen |= {own[0]} if own else set()
        assert r["tags"] == want and r["n"] == len(seen) and set(r["o"]) == seen


def test_align_is_linear(spark):
    n = 80_000
    df = spark.range(1).select(
        F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct((k * 5).alias("start"), (k * 5 + 4).alias("end"))).alias("tokens"),
        F.transform(F.sequence(F.lit(0), F.lit(n // 10 - 1)), lambda k: F.struct(k.cast("long").alias("ord"), (k * 50).alias("start"), (k * 50 + 9).alias("end"), F.lit("A").alias("aspect"))).alias("spans"),
    )
    tags = align.align(df, "tokens", "spans").first()["tags"]
    assert tags == ["B-A", "I-A", *["O"] * 8] * (n // 10)


def by_hand(text, reply, shift, mods, words, gold):
    """Tags and counts of the thread-aware rules as plain loops; words are (start, end)."""
    tags, counts = ["O"] * len(words), [0, 0, 0]
    for span, aspect in mods:
        if not span.strip() or aspect not in ("QUANTITY", "ADDITION"):
            continue
        at = reply.find(span)
        start = at + shift if at >= 0 else text.find(span) if gold else -1
        if start < 0:
            counts[2] += 1
            continue
        if not gold and start >= max((e for _, e in words), default=0):
            counts[1] += 1
            continue
        first = True
        for k, (a, b) in enumerate(words):
            if a < start + len(span) and b > start and tags[k] == "O":
                tags[k] = "I-" + aspect if gold or not first else "B-" + aspect
                first = False
        counts[2 if first else 0] += 1
    return tags, *counts


def test_thread_aware_alignment(spark):
    draw = random.Random(11)
    vocabulary = ["flour", "sugar", "egg", "milk", "less", "more", "of", "the"]
    cases = []
    for _ in range(60):
        ask, reply = (" ".join(draw.choice(vocabulary) for _ in range(draw.randint(1, 9))) for _ in range(2))
        prefix = f"[q] {ask} [a] "
        pick = lambda t: " ".join(t.split()[draw.randint(0, 2) :][: draw.randint(1, 3)])  # noqa: E731, B023
        mods = [(draw.choice([pick(reply), pick(ask), "zzz qqq"]), draw.choice(["QUANTITY", "ADDITION", "ODD"])) for _ in range(draw.randint(0, 4))]
        cases.append((prefix + reply, reply, len(prefix), mods))
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, text string, reply_text string, prefix_len int, modifications array<struct<span: string, aspect: string>>")
    rows = align.tokenize(df, "text", "tokens", 12)
    for gold in (False, True):
        got = {r["i"]: r for r in subwords.align_examples(rows, scheme="IO" if gold else "BIO", gold=gold, reply_col="reply_text", shift_col="prefix_len").collect()}
        for i, (text, reply, shift, mods) in enumerate(cases):
            words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)][:12]
            want = by_hand(text, reply, shift, mods, words, gold)
            assert (got[i]["tags"], got[i]["aligned"], got[i]["truncated"], got[i]["hallucinated"]) == want, cases[i]


def test_subword_tokens(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("byte_bpe_50k.json")
    texts = ["Add half a cup of sugar, please", "", None, "é😢 ok"]
    df = spark.createDataFrame([(i, t, [("cup of sugar", "QUANTITY"), ("zz", "ADDITION")]) for i, t in enumerate(texts)], "i int, text string, modifications array<struct<span: string, aspect: string>>")
    rows = subwords.encode(df, "text", subwords.from_file(path, max_length=12))
    made = subwords.align_examples(rows)
    made = made.select("i", "text", "tokens", "tags", "aligned", "hallucinated", *subwords.model_columns("tokens", F.col("tags"), BIO))
    got = {r["i"]: r for r in made.collect()}
    first = got[0]
    assert len(first["input_ids"]) == len(first["labels"]) == 12 and sum(first["attention_mask"]) == sum(not t["special"] for t in first["tokens"])
    assert all(first["text"][t["start"] : t["end"]] for t in first["tokens"] if not t["special"])
    tagged = [first["text"][t["start"] : t["end"]].strip() for t, g in zip(first["tokens"], first["tags"]) if g != "O"]
    assert " ".join(tagged) == "cup of sugar" and first["tags"].count("B-QUANTITY") == 1 and (first["aligned"], first["hallucinated"]) == (1, 1)
    assert {x for x, t in zip(first["labels"], first["tokens"]) if t["special"]} == {-100} and set(got[1]["labels"]) == set(got[2]["labels"]) == {-100}


def test_sequences(spark):
    df = spark.createDataFrame([(["O", "B-ADDITION", "O"], ["O", "I-ADDITION"]), (["O"], ["O", "O"])], "gold array<string>, pred array<string>")
    cut = [[(z["gold"], z["pred"]) for z in r["z"]] for r in df.select(metrics.zipped(F.col("gold"), F.col("pred")).alias("z")).collect()]
    assert cut == [[("O", "O"), ("B-ADDITION", "I-ADDITION")], [("O", "O")]]
    filled = [[z["pred"] for z in r["z"]] for r in df.select(metrics.zipped(F.col("gold"), F.col("pred"), "O").alias("z")).collect()]
    assert filled == [["O", "I-ADDITION", "O"], ["O"]]
    ids = F.array(*map(F.lit, (-100, 7, 0, 5, -100)))
    tags_ = F.array(*map(F.lit, "abcde"))
    assert value(spark, metrics.unmasked(ids, tags_)) == ["b", "c", "d"]
    assert value(spark, metrics.label_names(ids, BIO)) == ["O", "B-ADDITION", "O", "B-TECHNIQUE", "O"]
    assert value(spark, metrics.label_ids(F.array(F.lit("B-ADDITION"), F.lit("odd")), BIO)) == [7, 0]
    assert [value(spark, metrics.has_label(F.array(*map(F.lit, x)))) for x in ((0, -100), (0, 3))] == [False, True]
    assert value(spark, metrics.gate(F.lit(None).cast("boolean"), tags_)) == ["O"] * 5


def test_labels_and_teachers(spark):
    records = spark.createDataFrame([(1, "a", None), (2, "b", "old"), (3, "c", "old")], "id int, t string, l string")
    answers = spark.createDataFrame([(1, "x", 1, "m"), (1, "y", 2, "m"), (2, None, 1, "m"), (9, "z", 1, "m")], "id int, l string, at int, model string")
    got = {r["id"]: (r["l"], r["model"]) for r in annotate.update_labels(records, answers, "id", "at").collect()}
    assert got == {1: ("y", "m"), 2: ("old", "m"), 3: ("old", None)}
    pairs = "array<struct<span: string, aspect: string>>"
    gold = spark.createDataFrame([(1, [("a b", "QUANTITY"), ("c", "ADDITION")]), (2, [("d", "ADDITION")]), (3, [])], f"id int, gold {pairs}")
    silver = spark.createDataFrame([(1, [("b e", "QUANTITY"), ("c", "ADDITION"), ("c", "QUANTITY")]), (7, [])], f"id int, silver {pairs}")
    joined = metrics.against_gold(gold, silver, "id")
    one = metrics.pair_scores(joined).first()
    assert (one["tp"], one["n_pred"], one["n_gold"], one["matches"]) == (1, 3, 3, 2)
    each = {r["aspect"]: (r["tp"], r["n_pred"], r["n_gold"], r["matches"]) for r in metrics.pair_scores(joined, by_aspect=True).collect()}
    assert each == {"QUANTITY": (0, 2, 1, 1), "ADDITION": (1, 1, 2, 1)}
    assert sorted(r["id"] for r in metrics.unmatched(gold, silver, "id").collect()) == [2, 3]
    flags = [value(spark, annotate.annotator_flag(F.lit(c))) for c in ("true", '{"has_modification": false}', '{"x": 1}', "odd", None)]
    assert flags == [True, False, None, None, None]
    cells = spark.createDataFrame([(1, "a", "b", True), (2, "a", "b", False), (3, "a", None, True)], "i int, annotator_a string, annotator_b string, overlap boolean")
    assert [r["i"] for r in annotate.overlap_subset(cells).collect()] == [1]
    assert sorted(r["i"] for r in annotate.overlap_subset(cells.where("i > 1")).collect()) == [2]


def decode(tags, kind):
    """The three rules as plain loops."""
    out, run = [], None
    for i, t in enumerate([*tags, "O"]):
        head, aspect = t[:2], t[2:]
        if kind == "strict":
            goes_on = head == "I-" and run and run[0] == aspect
            opens = head == "B-"
        elif kind == "lenient":
            goes_on = head == "I-" and run and run[0] == aspect
            opens = t != "O" and not goes_on
        else:
            goes_on = t != "O" and run and i and tags[i - 1] == t
            opens = t != "O" and not goes_on
        if run and not goes_on:
            out.append((run[0], run[1], i - 1))
            run = None
        if opens:
            run = (aspect, i)
    return sorted(out)


@pytest.mark.parametrize("kind", ["strict", "lenient", "io"])
def test_decoders(spark, kind):
    draw = random.Random(kind)
    names = ["O", "O", "B-A", "I-A", "B-B", "I-B"] if kind != "io" else ["O", "I-A", "I-B"]
    seqs = [[draw.choice(names) for _ in range(draw.randint(0, 12))] for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(seqs)), "example_id int, tags array<string>")
    for r in getattr(spans, f"decode_{kind}")(df).collect():
        assert sorted((s["aspect"], s["start"], s["end"]) for s in r["spans"]) == decode(r["tags"], kind), r["tags"]
    both = spans.decode_lenient(spans.decode_lenient(df, "tags", "a").withColumn("other", F.reverse("tags")), "other", "b")
    both = both.withColumn("b", F.when(F.col("example_id") % 9 > 0, F.col("b")))
    for r in spans.meeting(both, "a", "b", "m").collect():
        assert [x["s"] for x in r["m"]] == r["a"]
        for x in r["m"]:
            assert x["met"] == [y for y in r["b"] or [] if y["start"] <= x["s"]["end"] and y["end"] >= x["s"]["start"]]


def test_io_to_bio(spark):
    tags_ = F.array(*map(F.lit, ("I-A", "I-A", "I-B", "O", "I-B")))
    assert value(spark, spans.io_to_bio(tags_)) == ["B-A", "I-A", "B-B", "O", "B-B"]


def taxonomy(gold, pred, tokens, prefixes):
    """Both error counts of one example as plain loops over its spans."""
    g, p = decode(gold, "lenient"), decode(pred, "lenient")
    touch = lambda x, y: x[1] <= y[2] and x[2] >= y[1]
    simple, fine = [], []
    missed, extra = [x for x in g if x not in p], [x for x in p if x not in g]
    if not missed and not extra:
        simple.append("correct")
    for x in missed:
        near = [y for y in p if touch(x, y)]
        simple.append("false_negative" if not near else "span_boundary" if any(y[0] == x[0] for y in near) else "aspect_confusion")
    simple += ["false_positive" for x in extra if not any(touch(x, y) for y in g)]
    for x in g:
        near = sorted((y[0] != x[0], y[1], y[2]) for y in p if touch(x, y))
        if not near:
            fine.append("false_negative")
            continue
        other, a, b = near[0]
        off = abs(a - x[1]) + abs(b - x[2])
        kind = "aspect_confusion" if other else "exact_match" if not off else "over_extension" if b - a > x[2] - x[1] else "under_extension"
        fine.append(kind)
        if not other and off == 1:
            fine.append("off_by_one")
            edge = max(0, a - 1 if a < x[1] else b)
            if edge < len(tokens) and tokens[edge][:1] in prefixes:
                fine.append("prefix_error")
    return simple, fine + ["false_positive" for y in p if not any(touch(x, y) for x in g)]


def test_errors_and_scores(spark):
    from collections import Counter

    draw = random.Random(8)
    names = ["O", "O", "O", "B-ADDITION", "I-ADDITION", "B-QUANTITY", "I-QUANTITY"]
    rows = []
    for i in range(250):
        n = draw.randint(0, 9)
        gold = [draw.choice(names) for _ in range(n)]
        rows.append((i, gold, [draw.choice(names) if draw.random() < 0.3 else t for t in gold], [draw.choice("abc") * 2 for _ in range(n)]))
    df = metrics.with_spans(spark.createDataFrame(rows, "example_id int, gold array<string>, pred array<string>, words array<string>"))
    simple, fine = Counter(), Counter()
    tp = hits = [0, 0]
    for _, g, p, w in rows:
        a, b = taxonomy(g, p, w, "a")
        simple.update(a)
        fine.update(b)
    assert {r["kind"]: r["n"] for r in metrics.errors_simple(df).collect()} == simple
    got = metrics.errors_boundary(df, "words", "a", shares=True).collect()
    assert {r["kind"]: r["n"] for r in got} == fine
    sets = [(set(decode(g, "lenient")), set(decode(p, "lenient"))) for _, g, p, _ in rows]
    tp = sum(len(g & p) for g, p in sets)
    one = metrics.exact_prf(df).first()
    assert (one["tp"], one["n_pred"], one["n_gold"]) == (tp, sum(len(p) for _, p in sets), sum(len(g) for g, _ in sets))
    near = lambda x, ys: any(x[0] == y[0] and x[1] <= y[2] and x[2] >= y[1] for y in ys)
    hits = metrics.relaxed_prf(df).first()
    assert (hits["gold_hit"], hits["pred_hit"]) == (sum(near(x, p) for g, p in sets for x in g), sum(near(y, g) for g, p in sets for y in p))
    by = {r["aspect"]: (r["tp"], r["n_pred"], r["n_gold"]) for r in metrics.exact_prf(df, by_aspect=True).collect()}
    of = lambda s, a: {x for x in s if x[0] == a}
    assert by == {a: (sum(len(of(g & p, a)) for g, p in sets), sum(len(of(p, a)) for _, p in sets), sum(len(of(g, a)) for g, _ in sets)) for a in ("ADDITION", "QUANTITY")}
    assert metrics.exact_prf(df.where("false")).first()["f1"] == 0.0 and metrics.relaxed_prf(df.where("false")).first()["f1"] == 0.0


def test_bootstrap(spark):
    import hashlib

    flat = spark.createDataFrame([(i, 1, 1, 1) for i in range(9)], "example_id int, tp int, n_pred int, n_gold int")
    ci = metrics.bootstrap_f1(flat, rounds=20).first()
    assert (ci["rounds"], ci["low"], ci["high"]) == (20, 1.0, 1.0)
    rows = [(i * 7, i % 2, 1 + i % 3, 1) for i in range(13)]
    bounds = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(9)]
    want = []
    for r in range(30):
        times = []
        for key, *_ in rows:
            u = int(hashlib.md5(f"42|{key}|{r // 8}".encode()).hexdigest()[4 * (r % 8) :][:4], 16)
            times.append(sum(u >= int(65536 * b) for b in bounds))
        below = sum(t * (x[2] + x[3]) for t, x in zip(times, rows))
        want.append(2 * sum(t * x[1] for t, x in zip(times, rows)) / below if below else 0.0)
    df = spark.createDataFrame([*rows, (999, None, None, None)], "example_id int, tp int, n_pred int, n_gold int")
    for parts in (1, 3):
        got = metrics.bootstrap_f1(df.repartition(parts), rounds=30).first()
        assert (got["mean"], got["low"], got["high"]) == tuple(round(float(x), 6) for x in (np.mean(want), np.quantile(want, 0.025), np.quantile(want, 0.975)))
    times = metrics.draw_weights([str(k) for k in range(2000)], 40, "7")  # as often as Poisson(1) says
    assert abs(times.mean() - 1) < 0.02 and abs((times == 0).mean() - math.exp(-1)) < 0.01 and abs(times.var() - 1) < 0.03
    assert metrics.bootstrap_f1(df.where("false"), rounds=9).first()["mean"] in (None, 0.0)


def test_places_of_far_keys(spark):
    keys = [*range(500), 10**15, -7, 10**17]
    random.Random(1).shuffle(keys)
    df = spark.createDataFrame([(k, str(k)) for k in keys], "k bigint, v string")
    got = {r["k"]: r["i"] for r in datasets.numbered(df, "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))} and datasets.numbered(df.where("false"), "k").count() == 0
    before, datasets.TOP_ROWS = datasets.TOP_ROWS, 10
    try:
        assert sorted(r["k"] for r in datasets.first_examples(df, 30, "k").collect()) == sorted(keys)[:30]
    finally:
        datasets.TOP_ROWS = before
    assert datasets.first_examples(df, None, "k").count() == len(keys) and sorted(r["k"] for r in datasets.first_examples(df, 3, "k").collect()) == sorted(keys)[:3]


def test_kappa(spark):
    k = lambda rows: metrics.kappa(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()["kappa"]
    assert k([("x", "x"), ("y", "y")]) == 1.0 and k([("x", "x")] * 3) == 1.0 and k([("x", "y"), ("y", "x")]) == -1.0 and k([]) == 0.0


def test_greedy_matching(spark):
    kind = "array<struct<span: string, aspect: string>>"
    df = spark.createDataFrame([([("a b", "X"), ("b c", "X")], [("b", "X"), ("c", "X")]), ([("a", "X"), ("a", "X")], [("a", "X")]), ([], [("a", "X")])], f"g {kind}, p {kind}")
    assert [r["n"] for r in df.select(metrics.greedy_matches(F.col("g"), F.col("p"), metrics.share_word).alias("n")).collect()] == [2, 1, 0]


def test_split_sizes_and_leaks(spark):
    df = spark.range(400).select(F.col("id"), (F.col("id") % 100).alias("g"), ((F.col("id") % 100) < 30).alias("pos"))
    got = datasets.stratified_split(df, "g", F.col("pos"))
    sizes = {(r["pos"], r["split"]): r["n"] for r in got.groupBy("pos", "split").agg(F.count_distinct("g").alias("n")).collect()}
    assert sizes == {(True, "train"): 24, (True, "val"): 3, (True, "test"): 3, (False, "train"): 56, (False, "val"): 7, (False, "test"): 7}
    assert datasets.leakage(got, "g").count() == 0 and got.count() == 400
    assert datasets.downsample(df, F.col("pos"), 0, "id").count() == 400
    assert datasets.downsample(df, F.col("pos"), 1.5, "id").count() == 120 + 180
    assert datasets.downsample(df, F.col("pos"), 99, "id").count() == 400
    assert datasets.fraction(df, 0.001, "id").count() == 1 and datasets.fraction(df.where("false"), 0.5, "id").count() == 0


def test_class_weights(spark):
    labels = spark.createDataFrame([("O",)] * 1000 + [("B-QUANTITY",)] * 2, "label string")
    w = {r["label"]: (r["n"], r["weight"]) for r in datasets.class_weights(labels, BIO).collect()}
    assert w["O"] == (1000, round(1002 / 9000, 4)) and w["B-QUANTITY"] == (2, 20.0) and w["I-ADDITION"] == (0, 20.0)


def test_audit(spark):
    one = spark.createDataFrame([(0.2, 0.01, 0.05, 0.5, 0.3)], "a double, b double, c double, d double, e double")
    report = audit.gates(one, audit.standard_gates(*map(F.col, "abcde")))
    assert {r["section"]: r["level"] for r in report.collect()} == {"hallucination": "FAIL", "positive_rate": "WARN", "final_rate": "WARN", "agreement": "PASS", "spread": "WARN"}
    assert audit.exit_status(report) == 1 and audit.exit_status(report.where("level != 'FAIL'")) == 0


def test_viterbi():
    draw = np.random.default_rng(2)
    for n in (1, 2, 5):
        e, t, b, s = draw.normal(size=(n, 3)), draw.normal(size=(3, 3)), draw.normal(size=3), draw.normal(size=3)
        score = lambda p: b[p[0]] + s[p[-1]] + sum(e[i, x] for i, x in enumerate(p)) + sum(t[x, y] for x, y in zip(p, p[1:]))
        assert tuple(models.viterbi(e, t, b, s)) == max(itertools.product(range(3), repeat=n), key=score)
    assert models.viterbi(np.zeros((0, 3)), t, b, s) == []


def test_models_in_spark(spark):
    df = spark.createDataFrame([(k, "good fine" if k % 2 else "bad poor", float(k % 2)) for k in range(20)], "i int, text string, label double")
    fitted = models.train_classifier(models.balanced_weights(df, "label"), "text", "label", "weight", features=64, rounds=5)
    assert fitted.transform(df).where("prediction = label").count() == 20
    p = value(spark, models.softmax("a")) if False else spark.createDataFrame([([1.0, 1.0, 3.0],)], "a array<double>").select(models.softmax("a").alias("p"), models.argmax("a").alias("k")).first()
    assert sum(p["p"]) == pytest.approx(1) and p["k"] == 2
    assert models.run_grid(spark, {"encoder": ["a", "b"], "variant": ["P0", "P1", "P2"]}).count() == 6
