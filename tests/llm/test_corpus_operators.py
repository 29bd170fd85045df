"""Operators on whole corpora: edge cases and brute force."""

import hashlib
import random
import re
import zlib

import pytest

from spanloom.llm import components, decontaminate, jaccard, line_dedup, sharding

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)


def corpus(n: int = 240, seed: int = 1) -> list[tuple[int, str]]:
    """Random texts with exact copies, near copies, a common passage and repeated lines."""
    draw = random.Random(seed)
    words = [f"{draw.choice('abcdefghij')}{k}" for k in range(400)]
    text = lambda k: " ".join(draw.choice(words) for _ in range(k))
    base, passage, line = text(60), text(30), text(12)
    rows = []
    for i in range(n):
        kind = i % 6
        t = text(draw.randint(1, 80))
        if kind == 1:
            t = base
        elif kind == 2:
            w = base.split()
            for _ in range(draw.randint(1, 4)):
                w[draw.randrange(len(w))] = draw.choice(words)
            t = " ".join(w)
        elif kind == 3:
            t = f"{t} {passage} {text(5)}"
        elif kind == 4:
            t = f"{t}\n  {line.upper() if i % 4 else line}\t\n{text(4)}"
        rows.append((i * 3 % 1009, t))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id bigint, text string").repartition(5)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i if i is not None else -1), len(s), (low.get(find(k), -1) if s else (i if i is not None else -1))) for k, ((i, _), s) in enumerate(zip(rows, sets)))


def found(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in df.collect())


def test_jaccard_components(docs, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(jaccard.link_components(docs)) == brute_components(rows)


def test_jaccard_without_first_groups(docs, monkeypatch):
    """The token-group matrix alone finds every link."""
    monkeypatch.setattr(jaccard, "AGREE", 99)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(jaccard.link_components(docs)) == brute_components(rows)


def test_jaccard_on_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(jaccard.link_components(odd)) == brute_components(rows)
    assert jaccard.link_components(none).count() == 0
    kept = jaccard.keep_smallest(odd)
    assert kept.columns == odd.columns
    ids = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect())
    assert ids == [-1, -1, 1, 2, 3, 4, 5, 7, 8, 9, 9]


def test_one_of_each_for_repeated_ids(spark):
    a, b = " ".join("abcdefgh"), " ".join("stuvwxyz")
    rows = [(2, a, 1), (5, b, 2), (5, a, 3), (5, a, 3), (7, b, 4), (9, "x", 5), (9, None, 6), (None, "y z", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, own_id int").selectExpr("*", "1 as text_key", "2 as key")
    kept = jaccard.keep_smallest(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or -1, r["text"] or "", r["own_id"]) for r in kept.collect()) == [(-1, "y z", 7), (2, a, 1), (5, b, 2), (9, "", 6), (9, "x", 5)]


def test_jaccard_names_of_many_components(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", -1)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(jaccard.link_components(docs)) == brute_components(rows)


def test_jaccard_threshold_is_exact(spark):
    a = [f"a{i}" for i in range(11)]  # 7 shingles
    rows = [(1, " ".join(a)), (2, " ".join(a[:10])), (3, " ".join(a[:9])), (4, " ".join(a[1:9])), (5, "one two"), (6, "One  two"), (7, "one")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(jaccard.link_components(df)) == brute_components(rows)


def test_jaccard_bound_of_mixed_groups(spark):
    """Sets of 9 and 12 shingles share a group with one of 11, which alone links, at exactly 75 %, with a set of 10."""
    rows = []
    for k in (0, 242, 281, 393, 743, 931, 1467, 2044, 2174, 2514, 2744, 2780):
        w = lambda letter, n: [f"{letter}{k}x{i}" for i in range(n)]  # noqa: E731, B023
        b = w("b", 13)
        texts = [w("z", 1) + b, w("y", 2) + b, w("x", 2) + b[:11], w("v", 3) + b] + [b[1:] + w(f"d{j}", 60) for j in range(3)]
        rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(jaccard.link_components(df)) == brute_components(rows)


def test_jaccard_bound_is_the_least_of_all_sizes(spark):
    least = lambda n, m, p: -(-(n + m) * p // (100 + p)) - (-(-max(n, m) * p // 100) - 1)
    for percent in (50, 75, 90):
        sizes = {n: range(-(-n * percent // 100), n * 100 // percent + 1) for n in (1, 7, 10, 40, 100)}
        rows = [(n, low, high) for n, r in sizes.items() for low in r for high in range(low, r[-1] + 1)]
        df = spark.createDataFrame(rows, "n int, low bigint, high bigint")
        for r in df.withColumn("both", jaccard._least_both(df.n, df.low, df.high, percent)).collect():
            assert r["both"] == min(least(r["n"], m, percent) for m in range(r["low"], r["high"] + 1))


def test_components(spark):
    draw = random.Random(4)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, k) for k in range(6000, 6100)] + [(7, 7)]
    forest = components.Forest()
    for a, b in links:
        forest.join(a, b)
    got = {(r["node"], r["root"]) for r in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint").repartition(6)).collect()}
    assert got == {(x, forest.find(x)) for a, b in links if a != b for x in (a, b)}


def test_line_dedup_on_odd_rows(odd, none, spark):
    line = "this is a line that is long enough to count as one"
    rows = [(i, f"{'  ' * (i % 2)}{line.upper() if i % 3 else line}\nown {i}\n{line}") for i in range(6)] + [(None, line), (50, line[:39]), (51, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").unionByName(odd.select("doc_id", "text")).selectExpr("*", "1 as n_lines", "2 as runs")
    got = line_dedup.dedup_lines(df)
    by = {(r["doc_id"], r["text"]) for r in got.collect()}
    assert {(i, f"own {i}") for i in range(5)} <= by
    assert (5, f"  {line.upper() if 5 % 3 else line}\nown 5\n{line}") in by and (None, "") in by and (51, None) in by and (50, line[:39]) in by
    assert got.columns == ["doc_id", "text", "runs", "n_lines", "n_dropped"]
    assert got.count() == df.count()
    assert line_dedup.dedup_lines(none).count() == 0
    short = line_dedup.dedup_lines(df, min_docs=8)
    assert short.where("n_dropped > 0").count() == 0


def test_drop_runs_are_compressed(spark):
    line = [f"line number {k} which has more than forty characters" for k in range(4)]
    df = spark.createDataFrame([(i, "\n".join([line[0], line[1], "own", line[2], line[3]])) for i in range(5)], "doc_id bigint, text string")
    runs = {r["k_id"]: [(x["start"], x["length"]) for x in r["runs"]] for r in line_dedup.drop_runs(df).collect()}
    assert runs == {i: [(0, 2), (3, 2)] for i in range(4)}


def brute_hits(text, items, size=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = word.findall((text or "").translate(FOLD))
    hit, names = set(), set()
    for item, t in items:
        v = word.findall((t or "").translate(FOLD))
        for k in range(max(1, len(v) - size + 1)) if v else ():
            win = v[k : k + size]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit.update(range(p, p + len(win)))
                    names.add(str(item))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def test_decontamination_against_brute_force(spark, docs, odd):
    texts = corpus(80, seed=3)
    items = [(k, t) for k, (_, t) in enumerate(texts[:12])] + [(100, "fox jumps"), (101, "x"), (102, None), (103, "!!"), (12, texts[3][1]), (104, "the LAZY dog-again and")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as words", "2 as token")
    df = spark.createDataFrame(texts, "doc_id bigint, text string").unionByName(odd.select("doc_id", "text"))
    want = sorted({(-1 if i is None else i, *brute_hits(t, items)) for i, t in ((r["doc_id"], r["text"]) for r in df.collect())})
    cols = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], *(r[c] for c in cols)) for r in decontaminate.decontaminate(df, benchmark).collect())
    assert sorted(set(got)) == want and len(got) == df.distinct().count()
    kept = decontaminate.drop_contaminated(odd, benchmark)
    assert kept.columns == odd.columns and sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == [-1, -1, 1, 2, 3, 4, 7, 9, 9]
    assert decontaminate.decontaminate(odd, benchmark.where("false")).where("contaminated").count() == 0
    assert decontaminate.decontaminate(odd.where("false"), benchmark).count() == 0


def test_decontamination_of_many_windows(spark, docs, odd, monkeypatch):
    """Windows that are too many to broadcast: the same rows."""
    texts = corpus(60, seed=3)
    benchmark = spark.createDataFrame([*texts[:12], (100, "fox jumps"), (101, "x")], "item_id bigint, text string")
    df = spark.createDataFrame(texts, "doc_id bigint, text string").unionByName(odd.select("doc_id", "text"))
    plain = lambda: sorted(map(repr, decontaminate.decontaminate(df, benchmark).collect()))
    want = plain()
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", -1)
    assert plain() == want
    named = odd.selectExpr("*", "1 as hit_id", "2 as hit_text", "3 as k_text")
    assert decontaminate.drop_contaminated(named, benchmark).columns == named.columns
    assert decontaminate.drop_contaminated(named, benchmark.where("false")).count() == named.count()
    assert decontaminate.drop_contaminated(named.where("false"), benchmark).count() == 0


def test_line_dedup_of_many_lines(spark, docs, monkeypatch):
    """Repeated lines that are too many to broadcast: the same rows, whatever the columns' names."""
    df = docs.selectExpr("*", "1 as own_id", "2 as text_key", "3 as lost_runs", "4 as salt", "5 as h1", "6 as k_id")
    plain = lambda: sorted(map(repr, line_dedup.dedup_lines(df, min_chars=20).collect()))
    want = plain()
    assert any("n_dropped=0" not in r for r in want)
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", -1)
    assert plain() == want and line_dedup.dedup_lines(df).columns == [*df.columns, "n_lines", "n_dropped"]


def test_shards(odd, none, docs):
    got = sorted(sharding.assign_shards(docs, 7).collect(), key=lambda r: (r["shard"], r["slot"]))
    assert [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in docs.collect())
    total, before, slots = sum(r["size"] for r in got), 0, {}
    for r in got:
        assert r["shard"] == before * 7 // total and r["slot"] == slots.get(r["shard"], 0)
        slots[r["shard"]] = r["slot"] + 1
        before += r["size"]
    sizes = sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in sharding.assign_shards(odd, 3).collect())
    assert sizes == sorted((r["doc_id"] or -1, len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in odd.collect())
    assert sharding.assign_shards(none, 3).count() == 0


def test_written_shards(odd, none, tmp_path, spark):
    """The files hold the rows that the shards are said to have, repeated rows and rows without id or text included."""
    rows = [(1, "same")] * 6 + [(1, "other"), (None, None), (None, "x")]
    for k, df in enumerate((spark.createDataFrame(rows, "doc_id bigint, text string"), odd)):
        path = str(tmp_path / f"out{k}")
        sharding.write_shards(df, path, 3)
        got = spark.read.parquet(path)
        key = lambda r: (r["doc_id"] or -1, zlib.crc32((r["text"] or "").encode()))
        files = sorted((r["shard_no"], *key(r)) for r in got.collect())
        assert files == sorted((r["shard"], r["doc_id"] or -1, r["text_crc32"]) for r in sharding.assign_shards(df, 3).collect())
        assert got.columns[:-1] == df.columns
    sharding.write_shards(none, str(tmp_path / "none"), 3)
    with pytest.raises(ValueError):
        sharding.write_shards(odd.withColumnRenamed("shard", "Shard_No"), str(tmp_path / "no"), 3)
