"""All stages of the corpus pipeline against plain Python."""

import hashlib
import re
import sys
import zlib
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_corpus_operators import FOLD, brute_components, brute_hits  # noqa: E402

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def plain_lines(rows):
    """Rows of dicts without repeated lines: keys of 40 characters or more in 5 documents or more stay in the largest id."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    held = {}
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            if len(key(line)) >= 40:
                held.setdefault(key(line), set()).add(r["doc_id"])
    out = []
    for r in rows:
        lines = (r["text"] or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < 5 or max(held[key(x)]) == r["doc_id"]]
        text = r["text"] if len(kept) == len(lines) else "\n".join(kept)
        out.append(r | {"text": text, "n_chars": r["n_chars"] if len(kept) == len(lines) else len(text)})
    return out


def test_stages_against_plain_python(spark):
    import public_tokenizers
    import sentencepiece

    from spanloom.llm import quality
    from spanloom.llm.common import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding and decoding",
    ]
    order = lambda rows: sorted(rows, key=lambda r: (r["doc_id"], r["text"] or ""))
    plain = lambda df: order(r.asDict() for r in df.collect())

    model = quality.train(docs, labels, rated_per_grade=6000)
    want = [r for r in plain(docs) if model.score(r["text"])[1][-1] >= 0.6]
    now = materialize(stage["quality classifier"](spark, docs, SF), "test-1")
    assert now.schema == docs.schema and plain(now) == want

    want = order(plain_lines(want))
    now = materialize(stage["line dedup"](spark, now, SF), "test-2")
    assert now.schema.names == docs.schema.names and plain(now) == want

    smallest = {i for i, _, c in brute_components([(r["doc_id"], r["text"]) for r in want]) if i == c}
    want = [r for r in want if r["doc_id"] in smallest]
    now = materialize(stage["n-gram Jaccard join"](spark, now, SF), "test-3")
    assert now.schema.names == docs.schema.names and plain(now) == want

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    grams = {tuple(w[k : k + 10]) for w in (words.findall((t or "").translate(FOLD)) for _, t in items) for k in range(max(1, len(w) - 9)) if w}
    assert all(len(g) == 10 for g in grams)

    def hit(text):
        w = words.findall((text or "").translate(FOLD))
        return any(tuple(w[k : k + 10]) in grams for k in range(len(w) - 9))

    dropped = [r for r in want if hit(r["text"])]
    assert dropped and all(brute_hits(r["text"], items)[-1] for r in dropped[:2])
    want = [r for r in want if not hit(r["text"])]
    now = materialize(stage["benchmark decontamination"](spark, now, SF), "test-4")
    assert now.schema.names == docs.schema.names and plain(now) == want

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in stage["SentencePiece encoding and decoding"](spark, now, SF).collect()}
    assert sorted(got) == [r["doc_id"] for r in want]
    for r in want:
        ids = library.encode(r["text"] or "")
        g = got[r["doc_id"]]
        assert (g["ids"], g["n_tokens"]) == (ids, len(ids))
        assert g["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        assert g["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert g["same"] == (library.decode(ids) == (r["text"] or ""))
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(got)


def test_stages_on_odd_tables(spark, odd):
    """Nulls, repeated rows and clashing names pass through; empty tables stay empty."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = odd.drop("n").selectExpr("*", "cast(char_length(text) as int) as n_chars")
    assert labels.count()
    for table in (docs, docs.where("false")):
        now = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SF)
            assert now.columns == table.columns
        assert corpus_pipeline.STAGES[-1][1](spark, now, SF).count() == now.count() <= table.count()
