"""Readers, writers, the paged source, annotators and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.sources import annotator, files, rest
from spanloom.streaming import ingest

CALLS: list = []


def fake_fetch(kind, params):
    """Two pages of two items each; one channel without a playlist, one video without comments."""
    if kind == "playlistItems" and params["playlistId"].endswith("none"):
        raise rest.HttpError(404)
    if kind == "commentThreads" and params["videoId"] == "off":
        raise rest.HttpError(403, "commentsDisabled")
    first = params.get("pageToken") is None
    return {"items": [{"id": f"{kind}-{first}-{k}"} for k in range(min(2, params["maxResults"]))], "nextPageToken": "x" if first else None}


def test_jsonl(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"thread_id": "a", "n": 1}\n\nnot json\n{"thread_id": "b", "n": "x"}\n{"n": 3}\n{"thread_id": "a", "n": 4}\n', encoding="utf-8")
    rows = {(r["thread_id"], r["n"]) for r in files.read_jsonl(spark, str(path), "thread_id string, n int").collect()}
    assert rows == {("a", 1), ("b", None), (None, 3), ("a", 4)}
    assert files.count_lines(spark, str(path)) == {"ok": 4, "bad": 1, "blank": 1, "examples": ["not json"]}
    assert sorted(r["thread_id"] for r in files.known_keys(spark, str(path)).collect()) == ["a", "b"]
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(path), "thread_id string, n int", strict=True).collect()


def test_results_tree(spark, tmp_path):
    for model, split, f1 in (("m1", "gold", 0.5), ("m2", "silver", 0.25)):
        d = tmp_path / model / "P1" / split
        d.mkdir(parents=True)
        (d / "evaluation_results.json").write_text(json.dumps({"exact_f1": f1}, indent=2))
        (d / "other.json").write_text("{}")
    got = {(r["model"], r["variant"], r["split"], r["exact_f1"]) for r in files.read_results(spark, str(tmp_path), "exact_f1 double").collect()}
    assert got == {("m1", "P1", "gold", 0.5), ("m2", "P1", "silver", 0.25)}


def test_channels(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("channels:\n  - {id: a, name: n}\n  - {id: b, active: false}\n")
    df = files.read_channels(spark, str(tmp_path / "c.yaml"), "id string, name string, active boolean")
    assert [r["id"] for r in files.active(df).collect()] == ["a"]


def test_files_out_and_in(spark, tmp_path):
    df = spark.createDataFrame([("a", "n, \"m\"\nx", True), ("b", None, False)], "id string, name string, active boolean")
    files.write_report_csv(df, str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in files.read_csv(spark, str(tmp_path / "csv"), "id string, name string, active boolean").collect()) == [("a", "n, \"m\"\nx", True), ("b", None, False)]
    files.write_document(df, str(tmp_path / "doc"))
    assert files.read_document(spark, str(tmp_path / "doc")).count() >= 1
    assert files.overwrite(df, str(tmp_path / "v"), version="1").endswith("version=1")
    files.append(df, str(tmp_path / "app"))
    files.append(df, str(tmp_path / "app"))
    assert spark.read.parquet(str(tmp_path / "app")).count() == 4
    files.write_label_maps(spark, str(tmp_path / "maps"), {"O": 0})
    assert files.backup(spark, str(tmp_path / "none")) is None
    assert spark.read.parquet(files.backup(spark, str(tmp_path / "app"))).count() == 4
    assert json.loads((tmp_path / "maps" / "id2label.json").read_text()) == {"0": "O"}


def test_sse(spark):
    df = spark.createDataFrame([('event: x\ndata: {"a": 1}\n\ndata: nope\ndata: {"a": 2}\n',)], "t string")
    assert [x["a"] for x in df.select(files.sse_events("t", "a int").alias("e")).first()["e"]] == [1, 2]


def test_paging_and_retry():
    waits = []
    assert [i["id"] for i in rest.pages(fake_fetch, "k", {}, 2, 3)] == ["k-True-0", "k-True-1", "k-False-0"]
    assert len(list(rest.pages(fake_fetch, "k", {}, 2, most_pages=1))) == 2
    assert next(rest.channel_videos(fake_fetch, "UCnone"))["id"].startswith("search")
    assert list(rest.video_threads(fake_fetch, "off")) == []
    with pytest.raises(rest.HttpError):
        rest.with_retry(lambda: (_ for _ in ()).throw(rest.HttpError(403)), wait=waits.append)
    assert waits == [2.0, 4.0] and list(rest.batches(list("abc"), 2)) == [["a", "b"], ["c"]]


CLIENT = """
from spanloom.sources.rest import HttpError


def fetch(kind, params):
    if kind == "playlistItems" and params["playlistId"].endswith("none"):
        raise HttpError(404)
    if kind == "channels":
        return {"items": [{"id": i} for i in params["id"].split(",")]}
    first = params.get("pageToken") is None
    return {"items": [{"id": f"{kind}-{first}-{k}"} for k in range(min(2, params["maxResults"]))], "nextPageToken": "x" if first else None}
"""


def test_paged_source(spark, tmp_path):
    (tmp_path / "paged_client.py").write_text(CLIENT)
    spark.sparkContext.addPyFile(str(tmp_path / "paged_client.py"))
    rest.register(spark)
    read = lambda kind, keys: spark.read.format("paged").options(kind=kind, keys=json.dumps(keys), client="paged_client.fetch", most="3").load().collect()
    rows = read("videos", ["UCa", "UCnone"])
    assert len(rows) == 6 and {r["key"] for r in rows} == {"UCa", "UCnone"}
    assert len(read("search", ["bread"])) == 3
    assert {json.loads(r["item"])["id"] for r in read("details", [f"c{k}" for k in range(70)])} == {f"c{k}" for k in range(70)}


class Echo:
    def __init__(self, fail=()):
        self.fail = list(fail)

    def label(self, prompts):
        if self.fail:
            raise annotator.AnnotatorError(self.fail.pop(0))
        return [p.upper() for p in prompts]


def test_annotator(spark):
    waits = []
    assert annotator.call(Echo(["503", "429", "timeout"]), ["a"], wait=waits.append) == (["A"], None)
    assert waits == [60.0, 120.0, 5.0]
    assert annotator.call(Echo(["401 bad"]), ["a"], wait=waits.append) == ([None], "auth")
    for message in ("403 quota", "quota", "ssl", "odd", "503"):
        assert annotator.classify(message) == spark.range(1).select(__import__("spanloom.functions.text", fromlist=["x"]).error_class(F.lit(message))).first()[0]


def test_stream_replay(spark, tmp_path):
    src, sink = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "1.json").write_text('{"k": "a", "n": 1}\n{"k": "b", "n": 2}\n{"k": "", "n": 9}\n')
    go = lambda: ingest.ingest(spark, str(src), "k string, n int", sink, str(tmp_path / "ck"), "k", "n", dead_letters=str(tmp_path / "dead"), valid="k != ''").awaitTermination()
    go()
    (src / "2.json").write_text('{"k": "b", "n": 3}\n{"k": "c", "n": 4}\n{"k": "c", "n": 5}\n')
    go()
    go()
    assert sorted((r["k"], r["n"]) for r in spark.read.parquet(sink).collect()) == [("a", 1), ("b", 2), ("c", 4)]
    write = ingest.append_new(sink, "k", "n")
    write(spark.createDataFrame([("b", 3), ("c", 4)], "k string, n int"), 1)  # a batch once more
    assert sorted((r["k"], r["n"]) for r in spark.read.parquet(sink).collect()) == [("a", 1), ("b", 2), ("c", 4)]
    assert spark.read.parquet(str(tmp_path / "dead")).count() == 1
