"""Trained taggers, stored pages, sub-word rows, versioned tables and streams with state."""

import collections
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import align, metrics, models, subwords, taggers
from spanloom.plans import training_queries as Q
from spanloom.schemas import BIO
from spanloom.sources import pages, rest
from spanloom.sources.versioned import Conflict, VersionedTable
from spanloom.streaming import ingest

SF = "/root/testdata/sf0.001"


# Taggers


def made_up(seed=0, sizes=(1, 4, 0, 3, 4), n_tags=3, size=20):
    rng = np.random.default_rng(seed)
    model = taggers.TagModel(rng.normal(size=(size, n_tags)), rng.normal(size=(n_tags, n_tags)), rng.normal(size=n_tags))
    features = [rng.integers(0, size, (n, taggers.TEMPLATES)).astype(np.int32) for n in sizes]
    return model, features, [rng.integers(0, n_tags, n).astype(np.int32) for n in sizes]


def score(model, f, y):
    e = model.emit[f].sum(1)
    return model.begin[y[0]] + e[np.arange(len(y)), y].sum() + model.step[y[:-1], y[1:]].sum()


def loss(model, features, tags):
    """-log P by all paths."""
    total = 0.0
    for f, y in zip(features, tags):
        if len(y):
            paths = itertools.product(range(len(model.begin)), repeat=len(y))
            total += np.log(sum(np.exp(score(model, f, np.array(p))) for p in paths)) - score(model, f, y)
    return total


def test_crf_against_all_paths():
    model, features, tags = made_up()
    value, grad = model.loss_gradient(taggers.Batch.of(features, tags))
    assert np.isclose(value, loss(model, features, tags))
    flat, shape = model.pack(), model.emit.shape
    for i, g in enumerate(grad.pack()):
        up, down = (loss(taggers.TagModel.unpack(flat + s * 1e-5 * (np.arange(len(flat)) == i), *shape), features, tags) for s in (1, -1))
        assert abs((up - down) / 2e-5 - g) < 1e-6
    batch = taggers.Batch.of(features, tags)
    for i, path in zip(batch.order, model.best(batch)):
        assert tuple(path) == max(itertools.product(range(3), repeat=len(path)), key=lambda p: score(model, features[i], np.array(p)))


def test_crf_gradient_of_blocks(spark, monkeypatch):
    """Blocks, with each different word scored once, give the loss and gradient of the sequences one by one; they are read by several tasks for each core."""
    monkeypatch.setattr(taggers, "PART", 11)
    rows, names, size = posts(spark, 90), list(BIO), 1 << 9
    model = made_up(3, n_tags=len(names), size=size)[0]
    held, kept = [], taggers._by_size
    monkeypatch.setattr(taggers, "_by_size", lambda *a: held.append(kept(*a)) or held[-1])
    monkeypatch.setattr(taggers, "discard", lambda *t: None)
    taggers.train_crf(rows, "i", "words", "gold", names, size=size, rounds=1)
    assert held[0].rdd.getNumPartitions() >= min(held[0].count(), 2 * spark.sparkContext.defaultParallelism)
    for times in (1, 500):  # the second ones in log space
        far = taggers.TagModel.unpack(model.pack() * times, *model.emit.shape)
        words, tags = (rows.orderBy("i").toArrow()[k].combine_chunks() for k in ("words", "gold"))
        table, index, sizes = taggers.coded_words(words, size, {})
        block, grad = taggers.Block.of(table, index, taggers._numbers(tags, {n: i for i, n in enumerate(names)}), sizes), taggers.TagModel.zeros(size, len(names))
        assert len(list(block.parts())) > 5
        got = far.block_gradient(block, grad)
        ordered = taggers.encode(rows, "i", "words", "gold", names, size).collect()
        batch = taggers.Batch.of([np.array(r["features"], np.int32).reshape(-1, taggers.TEMPLATES) for r in ordered], [np.array(r["tags"], np.int32) for r in ordered])
        want, same = far.loss_gradient(batch)
        assert np.isclose(got, want) and np.allclose(grad.pack(), same.pack())


def test_crf_with_scores_far_apart():
    model, features, tags = made_up(4)
    for times in (1, 500):
        far = taggers.TagModel.unpack(model.pack() * times, *model.emit.shape)
        value, grad = far.loss_gradient(taggers.Batch.of(features, tags))
        at = taggers.Batch.of(features, tags)
        total = 0.0
        for f, y in zip(features, tags):
            if len(y):
                paths = [score(far, f, np.array(p)) for p in itertools.product(range(3), repeat=len(y))]
                total += max(paths) + np.log(np.exp(np.array(paths) - max(paths)).sum()) - score(far, f, y)
        assert np.isclose(value, total) and np.isfinite(grad.pack()).all() and abs(grad.begin.sum()) < 1e-9 and len(at.sizes) == 4


def test_perceptron_learns_row_by_row(spark):
    """The rows that are decoded ahead give the model of one row after the other."""
    rows, names, size = posts(spark, 60), list(BIO), 1 << 9
    got = taggers.train_perceptron(rows, "i", "words", "gold", names, size=size, epochs=1, groups=1)
    ordered = taggers.encode(rows, "i", "words", "gold", names, size).withColumn("at", F.xxhash64("id")).orderBy("at", "features", "tags").collect()
    now, total, n = taggers.TagModel.zeros(size, len(names)), 0.0, 0
    for r in ordered:
        f, y = np.array(r["features"], np.int32).reshape(-1, taggers.TEMPLATES), np.array(r["tags"], np.int32)
        if len(y):
            guess = now.best(taggers.Batch.of([f], [y]))[0]
            for path, sign in ((y, 1.0), (guess, -1.0)):
                np.add.at(now.emit, (f.ravel(), np.repeat(path, taggers.TEMPLATES)), sign)
                np.add.at(now.step, (path[:-1], path[1:]), sign)
                now.begin[path[0]] += sign
            total, n = total + now.pack(), n + 1
    assert np.allclose(got.pack(), total / n)
    null = spark.createDataFrame([(1, None, ["O"]), (2, ["a"], None), (3, ["a", "b"], ["O"]), (4, ["a"], [None]), (5, [], [])], "i int, words array<string>, gold array<string>")
    assert {r["id"]: r["tags"] for r in taggers.encode(null, "i", "words", "gold", names, size).collect()} == {4: [0], 5: []}


def test_many_paths_at_once(spark):
    rng = np.random.default_rng(1)
    step, begin, end = rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3)
    scores = [rng.normal(size=(n, 3)).tolist() for n in (2, 5, 0, 1, 5, 3)] + [None]
    df = spark.createDataFrame(list(enumerate(scores)), "i int, s array<array<double>>")
    for r in models.decode_paths(df, "s", step, begin, end).collect():
        want = None if r["s"] is None else models.viterbi(np.array(r["s"]).reshape(-1, 3), step, begin, end)
        assert r["path"] == want


def posts(spark, n=300, seed=3):
    """A word ending in -ung begins a span and a short word behind it goes on."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        words, tags = [], []
        for _ in range(rng.randrange(1, 9)):
            stem = "".join(rng.choices("abcde", k=4))
            if rng.random() < 0.25:
                words += [stem + "ung"] + (["xx"] if rng.random() < 0.5 else [])
                tags += ["B-TECHNIQUE"] + ["I-TECHNIQUE"] * (len(words) - len(tags) - 1)
            else:
                words.append(stem + rng.choice(["", "ing", "xx"]))
                tags.append("O")
        rows.append((i, words, tags))
    return spark.createDataFrame(rows, "i int, words array<string>, gold array<string>")


@pytest.mark.parametrize("train", [taggers.train_crf, taggers.train_perceptron])
def test_taggers_learn(spark, train):
    names = list(BIO)
    rows = posts(spark)
    model = train(rows.where("i % 4 > 0"), "i", "words", "gold", names, size=1 << 12)
    test = taggers.tag_words(rows.where("i % 4 = 0"), model, "words", names)
    assert metrics.exact_prf(metrics.with_spans(test.withColumnRenamed("i", "example_id"))).first()["f1"] > 0.95
    texts = rows.select(F.col("i").alias("doc"), F.array_join("words", " ").alias("text")).where("i < 5")
    plugged = {r["example_id"]: r["tags"] for r in align.predict_tokens(texts, "doc", "text", taggers.tagger(model, names)).collect()}
    assert plugged == {r["i"]: r["pred"] for r in taggers.tag_words(rows.where("i < 5"), model, "words", names).collect()}
    odd = spark.createDataFrame([(1, None), (2, []), (3, ["a", ""])], "i int, words array<string>")
    assert [None if r["pred"] is None else len(r["pred"]) for r in taggers.tag_words(odd, model, "words", names).orderBy("i").collect()] == [None, 0, 2]


def test_perceptron_is_the_same_on_any_partitions(spark):
    rows, names = posts(spark, 120), list(BIO)
    a, b = (taggers.train_perceptron(df, "i", "words", "gold", names, size=1 << 10, epochs=2, groups=3) for df in (rows.repartition(7), rows.coalesce(1).orderBy(F.desc("i"))))
    assert np.array_equal(a.pack(), b.pack()) and np.abs(a.emit).max() > 0
    none = taggers.train_perceptron(rows.where("false"), "i", "words", "gold", names, size=16, epochs=1)
    assert not none.pack().any() and not taggers.train_crf(rows.where("false"), "i", "words", "gold", names, size=16, rounds=2).pack().any()


def test_perceptron_takes_its_rows_in_pieces(spark, monkeypatch):
    """A group passes by in batches, not as a whole, and in the order of its ids' hash, whatever files its rows come from."""
    from spanloom import storage

    rows, names = posts(spark, 400, seed=9), list(BIO)
    want = taggers.train_perceptron(rows, "i", "words", "gold", names, size=1 << 10, epochs=2, groups=2)
    held, kept = [], storage.materialize
    monkeypatch.setattr(taggers, "materialize", lambda df, name: held.append(kept(df, name)) or held[-1])
    monkeypatch.setattr(taggers, "discard", lambda *t: None)
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": "16", "spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = taggers.train_perceptron(rows, "i", "words", "gold", names, size=1 << 10, epochs=2, groups=2)
        sizes = [len(r["sizes"]) // 4 for r in held[0].select("sizes").collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert np.array_equal(got.pack(), want.pack())
    assert sum(sizes) == 400 and max(sizes) <= 16


@pytest.mark.parametrize("integers", [True, False])
def test_first_wrong_sequence(integers):
    rng = np.random.default_rng(7)
    for _ in range(300):
        n_tags, draw = int(rng.integers(1, 5)), (lambda *k: rng.integers(-2, 3, k).astype(float)) if integers else (lambda *k: rng.normal(size=k))
        model = taggers.TagModel(draw(12, n_tags), draw(n_tags, n_tags), draw(n_tags))
        sizes = rng.integers(1, 7, rng.integers(1, 9))
        features = [rng.integers(0, 12, (n, taggers.TEMPLATES)).astype(np.int32) for n in sizes]
        best = []
        for f in features:  # the first of the best paths, by their last tag, then the one before it
            paths = itertools.product(range(n_tags), repeat=len(f))
            best.append(max(paths, key=lambda p: (round(score(model, f, np.array(p)), 9), tuple(-t for t in p[::-1]))))
        flat, tags = np.concatenate(features), np.concatenate([np.array(p, np.int32) for p in best])
        assert (model.best_tags(flat, sizes) == tags).all() and model.first_wrong(flat, tags, sizes) is None
        other = np.where(rng.random(len(tags)) < 0.1, rng.integers(0, n_tags, len(tags)), tags).astype(np.int32)
        found = model.first_wrong(flat, other, sizes)
        wrong = [i for i, p in enumerate(np.split(other, np.cumsum(sizes)[:-1])) if tuple(p) != best[i]]
        assert (found is None) == (not wrong) and (not wrong or found[0] == wrong[0] and tuple(found[1]) == best[wrong[0]])


def test_crf_beats_keywords(spark):
    got = {(r["model"], r["aspect"]): r["f1"] for r in Q.crf_tagger(spark, SF).collect()}
    aspects = {a for _, a in got}
    assert aspects and all(got.get(("trained", a), 0) > got.get(("keywords", a), 0) for a in aspects if got.get(("trained", a)) is not None)
    assert np.mean([f for (m, _), f in got.items() if m == "trained"]) > 0.8


# Stored pages


def test_elements_of_broken_pages():
    page = "<body><p>out</p><article><h1>t</h1><p>one <b>bold<br>line &amp; <p>two<script>var p='<p>no</p>'</script><!-- <p>no --><ul><li>a<li>b</ul></p><p class=x>three<div>in</div></article><p>after"
    assert pages.element_texts(page, "p", "article") == ["one bold\nline &", "two\na\nb", "three\nin"]
    assert [t for t in pages.element_texts(page, "li")] == ["a", "b"]
    assert pages.element_texts(page, "p")[-1] == "after" and pages.element_texts(page, "p")[0] == "out"
    for broken in (None, "", "<", "<p", "</p></p><p", "<p>a</q></p>", "&#x; <p>&bogus;", "<![CDATA[<p>x"):
        assert isinstance(pages.element_texts(broken, "p"), list)
    assert pages.element_texts("<p>a</q>b", "p") == ["ab"]


def test_pages_as_rows(spark):
    df = spark.createDataFrame([(1, "<article><p>a long paragraph<p>short<p>another long one</article>"), (2, None), (3, "no elements")], "page_id int, html string")
    got = [tuple(r) for r in pages.page_comments(df, "page_id", "html").orderBy("ord").collect()]
    assert got == [(1, 0, "a long paragraph"), (1, 2, "another long one")]
    assert pages.page_comments(df, "page_id", "html", min_chars=0, most=2).count() == 2


# Sub-word rows


def test_subword_rows(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = Q.subword_rows(spark, SF).collect()
    assert {r["example_id"] for r in got} == set(texts)
    for r in got:
        ids = library.encode(texts[r["example_id"]], add_special_tokens=True).ids[:128]
        n = len(ids)
        assert r["input_ids"] == ids + [50256] * (128 - n) and r["attention_mask"] == [1] * n + [0] * (128 - n)
        assert r["token_type_ids"] == [0] * 128 and len(r["labels"]) == 128 and all(x == -100 for x in r["labels"][n:])
        assert sum(x == BIO["B-QUANTITY"] for x in r["labels"]) == r["aligned"]


def test_types_and_other_padding(spark):
    tokens = [(0, 0, "<s>", 5, True), (0, 2, "ab", 6, False), (3, 5, "cd", 7, False), (0, 0, "<pad>", 0, True)]
    df = spark.createDataFrame([(tokens, ["O"] * 4)], f"tokens {subwords.TOKENS}, tags array<string>")
    r = df.select(*subwords.model_columns("tokens", F.col("tags"), BIO, "<pad>", F.lit(3))).first()
    assert r["attention_mask"] == [1, 1, 1, 0] and r["token_type_ids"] == [0, 0, 1, 0] and r["labels"] == [-100, 0, 0, -100]


def test_one_tokenizer_fails_alone(spark):
    df = spark.createDataFrame([(1, "add two eggs", [("eggs", "ADDITION")])], "i int, text string, modifications array<struct<span: string, aspect: string>>")

    def broken():
        def run(texts):
            raise RuntimeError("no such vocabulary")

        return run

    words = lambda rows: align.tokenize(rows, "text", "tokens")
    made, errors = subwords.align_for_models(df, {"words": words, "broken": lambda rows: subwords.encode(rows, "text", broken)})
    assert list(errors) == ["broken"] and "vocabulary" in errors["broken"] and [r["model"] for r in made.collect()] == ["words"]
    with pytest.raises(Exception, match="nowhere"):
        subwords.align_for_models(df, {"wrong": lambda rows: align.tokenize(rows, "nowhere", "tokens")})


def test_failed_spans(spark):
    mods = [("two eggs", "ADDITION"), ("ham", "ADDITION"), ("now", "QUANTITY"), ("eggs", "ADDITION")]
    df = spark.createDataFrame([(1, "add two eggs now", mods)], "i int, text string, modifications array<struct<span: string, aspect: string>>")
    rows = subwords.align_examples(align.tokenize(df, "text", "tokens", 3))
    got = {(r["span"], r["reason"]) for r in subwords.failed_spans(rows, "i").collect()}
    assert got == {("ham", "not_found"), ("now", "truncated"), ("eggs", "no_token")} and subwords.failed_spans(rows, "i", 0).count() == 0
    r = rows.first()
    assert (r["aligned"], r["truncated"], r["hallucinated"]) == (1, 1, 2)


# Versioned tables


def hold(table, number=None):
    return sorted(tuple(r) for r in table.read(number).collect())


def test_versions(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "k bigint, v string")
    t = VersionedTable(spark, str(tmp_path / "t"), "k", 4)
    assert t.manifest() is None and t.append(rows((1, "a"), (2, "b"))) == 1
    assert t.append(rows((1, "c"))) == 2 and hold(t) == [(1, "a"), (1, "c"), (2, "b")] and hold(t, 1) == [(1, "a"), (2, "b")]
    assert t.replace(t.read().where("v <> 'a'")) == 3 and hold(t) == [(1, "c"), (2, "b")]
    assert t.append(rows((9, "z")), batch=("s", 4)) == 4 and t.append(rows((9, "z")), batch=("s", 4)) == 4  # a batch once more
    assert t.append(rows((8, "y")), batch=("s", 5)) == 5 and hold(t) == [(1, "c"), (2, "b"), (8, "y"), (9, "z")]
    assert t.vacuum(keep=1) and t.numbers() == [5] and hold(t) == [(1, "c"), (2, "b"), (8, "y"), (9, "z")]
    with pytest.raises(ValueError):
        VersionedTable(spark, str(tmp_path / "t"), "k", 8).append(rows((1, "a")))


def test_merge_rewrites_one_bucket(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "k", 8)
    t.append(spark.range(100).selectExpr("id as k", "'old' as v", "id as n"))
    before = t.manifest().folders
    answers = spark.createDataFrame([(7, "new", 1), (7, "newest", 2), (None, "x", 1)], "k bigint, v string, at int")
    t.merge(answers, "at", batch=("m", 0))
    after = t.manifest().folders
    assert sum(before[b] != after[b] for b in before) == 1
    assert hold(t) == sorted((k, "newest" if k == 7 else "old", k) for k in range(100))
    number = t.merge(answers, "at", batch=("m", 0))
    assert number == 2 and t.manifest().folders == after  # a replay changes nothing
    t.merge(spark.createDataFrame([(200, "in", 1), (3, None, 1)], "k bigint, v string, at int"), "at")
    assert (200, "in", None) in t.read().collect() and (3, "old", 3) in t.read().collect()
    t.merge(spark.createDataFrame([(300, "in", 1)], "k bigint, v string, at int"), "at", insert=False)
    assert t.read().where("k = 300").count() == 0 and t.read().count() == 101


def test_a_killed_change_leaves_the_old_version(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "k", 4)
    t.append(spark.range(50).selectExpr("id as k", "'a' as v"))

    @F.pandas_udf("string")
    def dies(v):
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        t.append(spark.range(50, 100, 1, 2).select(F.col("id").alias("k"), F.when(F.col("id") < 75, F.lit("b")).otherwise(dies(F.col("id").cast("string"))).alias("v")))
    assert t.numbers() == [1] and t.read().count() == 50
    left = t.vacuum(keep=2)
    assert t.read().count() == 50 and all(f not in t.manifest().text() for f in left)


def test_two_writers(spark, tmp_path):
    a, b = (VersionedTable(spark, str(tmp_path / "t"), "k", 2) for _ in range(2))
    a.append(spark.range(3).selectExpr("id as k"))
    late = b.manifest()
    a.append(spark.range(3, 5).selectExpr("id as k"))
    b.manifest = lambda number=None: late
    with pytest.raises(Conflict):
        b.append(spark.range(5, 9).selectExpr("id as k"))
    assert a.read().count() == 5


def test_merged_changes(spark):
    rows = [r for r in spark.read.parquet(f"{SF}/client_changes.parquet").collect() if r["client_id"] is not None]
    top = max(r["seq"] for r in rows)
    want: dict = {}
    for k in range(4):
        last = {}
        for r in sorted((r for r in rows if r["seq"] * 4 // (top + 1) == k), key=lambda r: (r["seq"], r["change_id"])):
            last[r["client_id"]] = r
        for c, r in last.items():
            old = want.get(c, (None,) * 4)
            want[c] = tuple(new if new is not None else was for new, was in zip((r["source"], r["segment"], r["city"], r["balance"]), old))
    got = {r["client_id"]: tuple(r)[1:] for r in Q.merged_changes(spark, SF).collect()}
    assert got == want


# Streams


def test_keyed_stream_query(spark):
    clicks = {tuple(r) for r in spark.read.parquet(f"{SF}/clicks.parquet").collect()}
    want = collections.Counter(r[4] for r in clicks)
    got = {r["kind"]: (r["n"], r["n_keys"]) for r in Q.stream_keyed_state(spark, SF).collect()}
    assert {k: n for k, (n, _) in got.items()} == want and all(n == keys for n, keys in got.values())


def test_keyed_stream_replay(spark, tmp_path):
    src, table = tmp_path / "in", VersionedTable(spark, str(tmp_path / "out"), "k", 4)
    src.mkdir()

    def go(lines):
        (src / f"{len(list(src.iterdir()))}.json").write_text(lines)
        stream = spark.readStream.schema("k string, n int").json(str(src))
        ingest.start_keyed(ingest.first_of_keys(stream, "k"), table, "s", str(tmp_path / "ck")).awaitTermination()

    go('{"k": "a", "n": 1}\n{"k": "b", "n": 2}\n{"k": "a", "n": 1}\n')
    assert hold(table) == [("a", 1), ("b", 2)]
    go('{"k": "b", "n": 3}\n{"k": "c", "n": 4}\n')
    assert hold(table) == [("a", 1), ("b", 2), ("c", 4)]
    # The last batch was published but not noted: it is made again, with the state as it was before it.
    commits = sorted((p for p in (tmp_path / "ck" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()
    (tmp_path / "ck" / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    number = table.numbers()[-1]
    go('{"k": "d", "n": 5}\n{"k": "c", "n": 6}\n')
    assert hold(table) == [("a", 1), ("b", 2), ("c", 4), ("d", 5)] and table.numbers()[-1] == number + 1
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ingest.ROCKS


def test_keys_are_forgotten(spark, tmp_path):
    src, table = tmp_path / "in", VersionedTable(spark, str(tmp_path / "out"), "k", 2)
    src.mkdir()
    for i, (k, at) in enumerate([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:30:00"), ("b", "2024-01-01 09:00:00"), ("c", "2024-01-01 09:01:00"), ("a", "2024-01-01 09:02:00")]):
        (src / f"{i}.json").write_text(json.dumps({"k": k, "at": at}))
        stream = spark.readStream.schema("k string, at timestamp").json(str(src))
        ingest.start_keyed(ingest.first_of_keys(stream, "k", "at", "1 hour"), table, "s", str(tmp_path / "ck")).awaitTermination()
    assert sorted(r["k"] for r in table.read().collect()) == ["a", "a", "b", "c"]


def test_paged_stream_goes_on(spark, tmp_path):
    rest.register(spark)
    seen: list[tuple[int, list[str]]] = []

    def start(most):
        def take(batch, number):
            seen.append((number, sorted(json.loads(r["item"])["id"] for r in batch.collect())))
            if len(seen) == most:
                raise RuntimeError("stopped in the middle")

        stream = spark.readStream.format("paged").options(kind="threads", keys=json.dumps(["a", "gone", "b", "c"]), client="paged_service.fetch", pages="2").load()
        return stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "ck")).start()

    query = start(2)
    with pytest.raises(Exception, match="stopped in the middle"):
        query.awaitTermination(120)
    query = start(0)
    query.processAllAvailable()
    query.stop()
    again = start(0)  # nothing is left
    again.processAllAvailable()
    again.stop()
    numbers = [n for n, _ in seen]
    assert numbers[:3] == [0, 1, 1] and seen[1] == seen[2]  # the batch that failed is made again, of the same pages
    whole = dict(seen)
    items = [i for n in whole for i in whole[n]]
    assert sorted(items) == sorted(f"{k}{p}-{j}" for k, n in (("a", 5), ("b", 3)) for p in range(n) for j in range(2))
    assert all(len(x) <= 4 for x in whole.values())


# Thread-aware rows


@pytest.mark.parametrize("name", ["align_thread_aware", "gold_alignment", "gold_models"])
def test_spans_of_replies_as_they_are(spark, tmp_path, name):
    """A reply has the question's span with other marks and blanks, which the statement doesn't count as found."""
    import compare
    import duckdb

    from spanloom.queries import ORACLE_SQL, QUERIES

    top = "Oneau, an la. Quequeier laeeeuxtre etreell and more"
    rows = [(1, 0, "user", top), (1, 1, "assistant", "A reply: eau an la  Quequeier, laeeeuxtre etreell and so on"), (1, 2, "user", "nothing " * 20), (2, 0, "user", top), (2, 1, "assistant", "x " + top)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert not compare.differences(spark, con, str(tmp_path), QUERIES[name], ORACLE_SQL[name])


# Bootstrap by drawing with replacement


def test_every_round_draws_as_many_as_there_are(spark):
    import hashlib

    rows = [(i * 7, i % 4, i % 3 + 2, i % 5 + 1) for i in range(40)] + [(1, 0, 0, 0)]
    df = spark.createDataFrame(rows[::-1], "example_id long, tp int, n_pred int, n_gold int").repartition(5)
    scores = []
    for r in range(20):
        drawn = [rows[int(hashlib.md5(f"42|{r}|{s}".encode()).hexdigest()[:8], 16) % 40] for s in range(40)]
        scores.append(2 * sum(x[1] for x in drawn) / sum(x[2] + x[3] for x in drawn))
    want = [20, *(round(float(x), 6) for x in (np.mean(scores), np.percentile(scores, 2.5), np.percentile(scores, 97.5)))]
    for held in (100, 3):  # in every task, and by a shuffle join
        assert list(metrics.resampled_f1(df, rounds=20, held=held).first()) == want
    assert metrics.resampled_f1(df.where("false"), rounds=5).first()["rounds"] == 0


# Words and labels of whole batches


def test_words_of_a_batch():
    import re

    import pyarrow as pa

    # What splits: White_Space; what does not: a separator of information, a zero-width blank, what stands behind the basic plane.
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab\u00e9\u05d0\U0001f600 \t\n\x0b\x85\xa0\u2003\u3000\u3001\x1c\u200b", k=rng.randrange(30))) for _ in range(300)]
    texts[3:6] = [None, "", "a"]
    blank = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
    want = [[{"start": m.start(), "end": m.end(), "token": m[0]} for m in re.finditer(f"(?:(?!{blank})[\\s\\S])+", t or "")] for t in texts]
    for limit in (None, 2):
        assert align._cut_words(pa.array(texts), limit).to_pylist() == [w[:limit] for w in want]
        assert pa.concat_arrays([align._cut_words(p, limit) for p in align._in_parts(pa.array(texts), 50)]).to_pylist() == [w[:limit] for w in want]


def test_labels_in_rows_as_by_join(spark):
    rng, rows = random.Random(6), []
    for i in range(60):
        at, base = 0, []
        for _ in range(rng.randrange(8)):
            start = at + rng.randrange(3)
            at = start + rng.randrange(1, 4)
            base.append((start, at, rng.randrange(4)))
        rows.append((i, base, [(s, s + rng.randrange(9)) for s in (rng.randrange(20) for _ in range(rng.randrange(6)))]))
    df = spark.createDataFrame(rows, "example_id int, base array<struct<start: int, end: int, label: int>>, target array<struct<start: int, end: int>>")
    got = {r["example_id"]: r["labels"] for r in align.transfer_in_rows(df, "base", "target").collect()}
    base = df.select("example_id", F.explode("base").alias("b")).select("example_id", "b.*")
    target = df.select("example_id", F.posexplode("target").alias("pos", "t")).select("example_id", "pos", "t.*").where("start < end")
    want = {(r["example_id"], r["pos"]): r["label"] for r in align.transfer_labels(base, target).collect()}
    assert len(want) > 50 and all(got[i][k] == label for (i, k), label in want.items())
    assert "Exchange" not in align.transfer_in_rows(df, "base", "target")._jdf.queryExecution().toString()


def test_spans_are_decoded_in_batches(spark):
    """The decoders against tag after tag; no lambda walks over the tags."""
    from spanloom.operators import spans

    rng = random.Random(7)
    rows = [(i, [rng.choice(["O", "B-A", "I-A", "B-BB", "I-BB", None] if i % 9 == 0 else ["O", "B-A", "I-A", "B-BB", "I-BB"]) for _ in range(rng.randrange(9))]) for i in range(300)] + [(-1, None), (-2, [])]

    def walk(tags, begins, ends):
        out, opened, before = [], None, "O"
        for i, t in enumerate([*tags, "end"]):
            begin = t == "end" or (t is not None and begins(t, before))
            if begin or (t is not None and ends(t, before)):
                if opened is not None:
                    out.append((tags[opened][2:], opened, i - 1))
                opened = i if begin and t != "end" else None
            before = t
        return out

    lenient = lambda t, b: t != "O" and (t[0] == "B" or (b is not None and (b == "O" or t[2:] != b[2:])))
    strict_end = lambda t, b: not (t[0] == "I" and t[2:] == ("" if b is None else b[2:]))
    cases = ((spans.decode_lenient, lenient, lambda t, b: t == "O"), (spans.decode_strict, lambda t, b: t[0] == "B", strict_end), (spans.decode_io, lambda t, b: t != "O" and b is not None and t != b, lambda t, b: t == "O"))
    df = spark.createDataFrame(rows, "i int, tags array<string>")
    for decode, begins, ends in cases:
        made = decode(df)
        got = {r["i"]: None if r["spans"] is None else [tuple(s) for s in r["spans"]] for r in made.collect()}
        assert got == {i: None if t is None else walk(t, begins, ends) for i, t in rows}
        assert "lambdafunction" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_sub_words_are_columns(spark):
    """Tokens of a row, of one without any and of a null text; a group at a time."""
    make = lambda: lambda texts: [[(k, k + 1, c, ord(c), c == "x") for k, c in enumerate(t)] for t in texts]
    df = spark.createDataFrame([(1, "ax"), (2, ""), (3, None), (4, "b")], "i int, text string").coalesce(1)
    got = {r["i"]: [tuple(t) for t in r["tokens"]] for r in subwords.encode(df, "text", make, group=2).collect()}
    assert got == {1: [(0, 1, "a", 97, False), (1, 2, "x", 120, True)], 2: [], 3: [], 4: [(0, 1, "b", 98, False)]}


def test_keyed_stream_state_goes_by_changes(spark, tmp_path, monkeypatch):
    """Commits write changes, keys are not counted, and a checkpoint with whole stores goes on that way; the session keeps its settings."""
    src, table = tmp_path / "in", VersionedTable(spark, str(tmp_path / "out"), "k", 4)
    src.mkdir()
    were = {k: spark.conf.get(k, None) for k in ingest.STATE}

    def go(lines):
        (src / f"{len(list(src.iterdir()))}.json").write_text(lines)
        stream = spark.readStream.schema("k string, n int").json(str(src))
        query = ingest.start_keyed(ingest.first_of_keys(stream, "k"), table, "s", str(tmp_path / "ck"))
        query.awaitTermination()
        last = query.recentProgress[-1]
        last = last if isinstance(last, dict) else json.loads(last.json)
        return last["stateOperators"][0]["numRowsTotal"], len(list((tmp_path / "ck" / "state").rglob("*.changelog")))

    with monkeypatch.context() as m:
        m.setattr(ingest, "STATE", {k: v for k, v in ingest.STATE.items() if "providerClass" in k})
        assert go('{"k": "a", "n": 1}\n{"k": null, "n": 2}\n') == (2, 0)
    total, changes = go('{"k": "a", "n": 3}\n{"k": "b", "n": 4}\n{"k": null, "n": 5}\n')
    assert total == 0 and changes > 0
    assert go('{"k": "b", "n": 6}\n{"k": "c", "n": 7}\n')[1] > changes
    assert sorted(((r["k"] or "", r["n"]) for r in table.read().collect())) == [("", 2), ("a", 1), ("b", 4), ("c", 7)]
    assert {k: spark.conf.get(k, None) for k in ingest.STATE} == were
