"""Co-partitioned tables, toxicity and divergence of sources against plain forms."""

import collections
import hashlib
import itertools
import math
import random
import urllib.parse
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from spanloom.llm import copartition, divergence, toxicity
from spanloom.llm.queries import QUERIES
from spanloom.storage import new_folder

SF = "/root/testdata/sf0.001"


# Co-partitioned tables


def _sorted(rows):
    """By the first value downwards, then the others upwards, nulls first."""
    rest = lambda r: [(x is not None, x.encode() if isinstance(x, str) else x if x is not None else 0) for x in r[1:]]
    return sorted(sorted(rows, key=rest), key=lambda r: (r[0] is not None, -(r[0] or 0)))


def _expected(tables, starts, buckets):
    """Rows, starting files and joined rows of every final file."""
    first, second = tables
    owners = collections.Counter(r[0] for r in tables[first] if r[0] is not None)
    rows, files = collections.defaultdict(list), collections.defaultdict(collections.Counter)
    for name, start in zip(tables, starts):
        for r in tables[name]:
            hashed = None if r[0] is None else zlib.crc32(b"pair%d" % r[0]) % buckets
            b = buckets + 1 if hashed is None else buckets if name == second and r[0] not in owners else hashed
            rows[name, b].append(r)
            files[name, b][start(r, hashed)] += 1
    joined = collections.Counter()
    for r in tables[second]:
        if r[0] is not None and r[0] in owners:
            joined[zlib.crc32(b"pair%d" % r[0]) % buckets] += owners[r[0]]
    return rows, files, joined


def _compare(report, tables, columns, starts, buckets):
    rows, files, joined = _expected(tables, starts, buckets)
    sha = lambda parts: hashlib.sha256(",".join(parts).encode()).hexdigest()
    seen = set()
    for r in report:
        at = (r["table_name"], r["bucket"])
        seen.add(at)
        want, from_files = _sorted(rows[at]), files[at]
        only = next(iter(from_files)) if len(from_files) == 1 else None
        stays = only is not None and sum(only in f for (n, _), f in files.items() if n == at[0]) == 1
        got = pq.ParquetFile(urllib.parse.urlparse(r["path"]).path).read()
        assert got.column_names == columns[at[0]] and r["columns"] == ",".join(columns[at[0]])
        assert list(zip(*[c.to_pylist() for c in got.columns])) == want
        assert r["ids_sha256"] == sha("" if x[0] is None else str(x[0]) for x in want)
        assert r["lineage_sha256"] == sha(f"{s}:{n}" for s, n in sorted(from_files.items()))
        assert (r["n_rows"], r["n_joined"], r["rewritten"]) == (len(want), joined[at[1]], not stays)
    assert seen == set(rows) and len(report) == len(rows)


def test_surrogates_reach_each_partition(spark):
    for partitions in (1, 7, 40):
        found = copartition.surrogates(spark, partitions, partitions)
        rows = spark.createDataFrame([(k, p) for p, k in enumerate(found)], "k int, p int").repartition(partitions, "k").withColumn("at", F.spark_partition_id())
        assert all(r["at"] == r["p"] for r in rows.collect())


def test_pair_of_odd_tables(spark):
    rng = random.Random(3)
    left = [(rng.choice([None, *range(-6, 30)]), rng.choice([None, "é", "z", "Z", ""]), rng.choice([None, 0.5, -1.0])) for _ in range(120)] + [(7, "hot", 1.0)] * 60
    right = [(rng.choice([None, *range(0, 40)]), rng.randrange(5)) for _ in range(300)] + [(7, 1)] * 200
    first = spark.createDataFrame(left, "id bigint, part string, _owner double")
    second = spark.createDataFrame(right, "id bigint, _integer int")
    b = F.coalesce(copartition.crc_bucket(F.col("id"), 9, "pair"), F.lit(10))
    for one, two in ((first, second), (first.where("false"), second), (first, second.where("false")), (first.where("false"), second.where("false"))):
        pair = copartition.write_pair(one, two, new_folder(spark, "odd-pair"), "id", (b - (b % 5 == 1).cast("int"), F.col("_integer")), files=11, names=("a", "b"), buckets=9)
        tables = {"a": [tuple(r) for r in one.collect()], "b": [tuple(r) for r in two.collect()]}
        start = lambda r, h: (h if h is not None else 10) - ((h if h is not None else 10) % 5 == 1)
        _compare(copartition.report_pair(pair).collect(), tables, {"a": first.columns, "b": second.columns}, (start, lambda r, h: r[1]), 9)


def test_files_of_one_bucket_stay(spark):
    rows = spark.createDataFrame([(k, k * k) for k in range(50)], "id bigint, n int")
    own = copartition.crc_bucket(F.col("id"), 5, "pair")
    pair = copartition.write_pair(rows, rows, new_folder(spark, "same-pair"), "id", (own, 6 - own), files=7, names=("a", "b"), buckets=5)
    assert {r["rewritten"] for r in copartition.report_pair(pair).collect()} == {False}


def test_keys_must_be_integers(spark):
    df = spark.createDataFrame([("a",)], "id string")
    with pytest.raises(ValueError):
        copartition.write_pair(df, df, "nowhere", "id", (F.lit(0), F.lit(0)), files=1, names=("a", "b"))


def test_copartition_query(spark):
    got = QUERIES["op11_copartition"](spark, SF).collect()
    read = {n: pq.read_table(f"{SF}/{n}.parquet") for n in ("sales", "sale_lines")}
    tables = {n: list(zip(*[c.to_pylist() for c in t.columns])) for n, t in read.items()}
    sale = lambda r, h: (h if h is not None else 151) - ((h if h is not None else 151) % 5 == 1)
    line = lambda r, h: 0 if r[2] is None else zlib.crc32(b"%d" % r[2]) % 150
    _compare(got, tables, {n: t.column_names for n, t in read.items()}, (sale, line), 150)


# Toxicity


def _kernel(s, t):
    """Sum over common subsequences of three characters, by definition."""
    of = lambda x: [("".join(x[i] for i in at), at[2] - at[0] + 1) for at in itertools.combinations(range(len(x)), 3)]
    return sum(toxicity.DECAY ** (a + b) for (u, a), (v, b) in itertools.product(of(s), of(t)) if u == v)


def test_kernel_by_definition():
    strings = ["idiot", "xidxiotx", "aaaa", "étéété", "abc", "cba", "tidioti"]
    for s in strings:
        assert math.isclose(toxicity.self_likeness(toxicity.codes([s], len(s)))[0], _kernel(s, s))
    marks = ["idiot", "été", "aaab"]
    got = toxicity.likeness(strings, toxicity.Triples(marks))
    want = [[_kernel(s, m) / math.sqrt(_kernel(s, s) * _kernel(m, m)) for m in marks] for s in strings]
    assert np.allclose(got, want)


def test_folded_weights_are_the_machine():
    model = toxicity.ToxicModel.fit(["\x02idiot\x03", "\x02table\x03"], ["\x02idiot\x03"], ["\x02idi*ot\x03"], ["\x02table\x03", "\x02idea\x03"])
    s = ["\x02idiooot\x03", "\x02stable\x03", "\x02zzz\x03"]
    sums = [sum(w * _kernel_one(x, name, model.triples) for name, w in zip(model.triples.names, model.weights)) / math.sqrt(_kernel(x, x)) for x in s]
    assert np.allclose(model.margins(s), [max(model.least, model.bias + v) for v in sums])
    exact = model.margins(s)
    model.dense, toxicity.DENSE, kept = None, 0, toxicity.DENSE
    try:
        assert np.allclose(model.margins(s), exact)  # by the sorted list
    finally:
        toxicity.DENSE = kept


def _kernel_one(s, name, triples):
    place, weigh = triples.lookup(toxicity.codes([s], len(s)))
    return sum(w for p, w in zip(place[0], weigh) if p < len(triples.names) and triples.names[p] == name)


def test_units():
    assert toxicity.tokens("You i D i o T, A bc") >= {"you", "idiot"}
    assert toxicity.units("(id-iot!)") == ["\x02id-iot\x03", "\x02iot\x03"]
    assert toxicity.units("12345") == toxicity.units("ab") == []
    long = toxicity.units("x" * 20 + "idiot" + "y" * 20)
    assert all(len(w) <= toxicity.WINDOW for w in long) and any("idiot" in w for w in long)


def test_toxicity_query(spark):
    got = {r["doc_id"]: r for r in QUERIES["op12_toxicity"](spark, "/root/testdata/sf0.01").collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert len(got) == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    held = [(toxic[i], got[i]["predicted"]) for i in got if got[i]["held_out"] and i in toxic]
    assert sum(a == b for a, b in held) >= 0.93 * len(held)
    assert sum(a > b for a, b in held) <= 0.4 * sum(a for a, _ in held)


def _rated(spark):
    rng, words = random.Random(1), ["".join(random.Random(k).choices("abdeginorstu", k=6)) for k in range(60)]
    rows = []
    for i in range(200):
        text = [rng.choice(words) for _ in range(20)]
        if i % 4 == 0:
            text[rng.randrange(20)] = rng.choice(["moron", "stupid"])
        rows.append((i, " ".join(text) + "."))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id bigint, toxic int")


def test_gaps_and_insertions_are_met(spark):
    docs, labels = _rated(spark)
    model = toxicity.train(docs, labels)
    more = [(1, "what a moron"), (2, "what a mo*ron"), (3, "so stuupid!"), (4, "m o r o n"), (5, "what a nice day"), (6, ""), (7, None), (8, "stuXpid")]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(spark.createDataFrame(more, "doc_id int, text string"), model).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0, 7: 0, 8: 1}


def test_toxicity_of_odd_tables(spark, odd, none):
    docs, labels = _rated(spark)
    assert toxicity.train(docs, labels.where("toxic = 0")).triples is None
    assert toxicity.train(docs.where("false"), labels).triples is None
    assert toxicity.train(docs, labels.selectExpr("doc_id", "doc_id % 2 as toxic").where("doc_id < 2")).margins(["\x02abc\x03"])[0] <= 0
    twice = toxicity.train(docs.union(docs), labels.union(labels).union(spark.createDataFrame([(None, 1), (3, None)], labels.schema)))
    model = toxicity.train(docs, labels)
    assert twice.bias == model.bias and np.array_equal(twice.weights, model.weights)
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and sum(r["doc_id"] is None for r in got) == 2
    assert toxicity.score(none, model).count() == 0


# Divergence of sources


def _audit(rows, min_docs, top):
    """All kept terms of all groups, by the definition."""
    docs = [(r[0] or "", r[1] or "", [t.decode() for t in divergence.terms((r[2] or "").encode())]) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        within = collections.Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in within.items() if n >= min_docs)
        counts = {s: collections.Counter(t for d in mine if d[1] == s for t in d[2]) for s in {d[1] for d in mine}}
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}  # noqa: E731, B023
        q, p = share(sum(counts.values(), collections.Counter())), {s: share(c) for s, c in counts.items()}
        for s in p:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in p if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(found[:most])]
    return sorted(out)


def test_audit_by_definition(spark, odd):
    rng, words = random.Random(5), ["a", "B", "été", "中文", "zz", "x1y", "I", "ß", "𝒳"]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["s", "t", "é", None, "u"]), rng.choice([None, "", " ".join(rng.choices(words, k=rng.randrange(12)))])) for _ in range(300)]
    rows += [("xx", "only", "never kept"), ("yy", "p", None), ("yy", "q", "")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("term", F.lit(1)).withColumn("n", F.lit("n"))
    for least, top in ((1, 3), (5, 50), (1000, 50)):
        got = sorted(tuple(r) for r in divergence.audit_sources(docs, min_docs=least, top=top).collect())
        assert got == _audit(rows, least, top)
    assert divergence.audit_sources(docs.where("false")).count() == 0
    assert divergence.audit_sources(odd.withColumn("lang", F.lit("en")), min_docs=1).where("part = 'pair'").count() == 11 * 10


def test_share_is_exact(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(300):
        total, kept = rng.randrange(10 ** rng.randrange(1, 15)), rng.randrange(1, 10 ** rng.randrange(1, 9))
        rows.append((rng.randrange(total + 1), total, kept))
    df = spark.createDataFrame(rows, "c bigint, t bigint, k bigint")
    got = df.select("c", "t", "k", divergence.share(F.col("c"), F.col("t"), F.col("k")).alias("p")).collect()
    assert all(r["p"] == 1 + 1_000_000_000 * (r["c"] + 5) // (r["t"] + 5 * r["k"]) for r in got)


def test_terms_leave_a_task_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([("en", "s", f"w{chr(97 + k % 26)}{chr(97 + k // 26)} same") for k in range(200)], "lang string, source string, text string").coalesce(1)
    whole = sorted(map(tuple, divergence.count_terms(docs).groupBy("lang", "source", "term").agg(F.sum("n"), F.sum("docs")).collect()))
    assert sum(r[3] for r in whole) == 400 and ("en", "s", "same", 200, 200) in whole
