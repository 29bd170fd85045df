"""Every query against its SQL on the smallest tables."""

import compare
import pytest

from spanloom.queries import FLAGSHIP, ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(DIR)


def test_flagship(spark):
    import __spark_entry__ as entry

    assert FLAGSHIP in QUERIES and set(ORACLE_SQL) <= set(QUERIES)
    assert entry.entry(spark).count() > 0 and set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    assert not compare.differences(spark, con, DIR, QUERIES[name], ORACLE_SQL[name])


#: Queries without SQL that have tests of their own, in test_training.py.
TESTED = {"crf_tagger", "subword_rows", "stream_keyed_state", "merged_changes"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - TESTED))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_queries_read_all_words(spark, con):
    want = dict(con.sql("SELECT doc_id, len(regexp_extract_all(text, '\\S+')) FROM documents").fetchall())
    assert max(want.values()) > 128
    got = {r["example_id"]: r["count"] for r in QUERIES["word_tokens"](spark, DIR).groupBy("example_id").count().collect()}
    assert got == {k: n for k, n in want.items() if n}
    assert QUERIES["label_distribution"](spark, DIR).agg({"n": "sum"}).first()[0] == sum(want.values())
    assert QUERIES["bootstrap_ci"](spark, DIR).first()["rounds"] == 1000


def test_masked_sequences_cut_texts_once(spark, tmp_path):
    """No filter has the texts' words and tags made again; texts with no word, or one, have no row."""
    import duckdb

    plan = QUERIES["masked_sequences"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    texts = [None, "", " \n ", "one", "two words", " ".join("abcdefg"[: k % 7 + 1] for k in range(40))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert not compare.differences(spark, con, str(tmp_path), QUERIES["masked_sequences"], ORACLE_SQL["masked_sequences"])


def odd_texts(spark, tmp_path):
    """Documents with no text, none but blanks, and blanks that SQL takes for letters; and DuckDB's view of them."""
    import duckdb

    texts = [None, "", " \n\t ", "\r\f", "one", "a b c\u000bd   e", "ünï çödé 😀😀 x", *(" ".join("abcdefghij"[: k % 9 + 1] for k in range(i)) for i in (3, 40, 90))]
    rows = [*enumerate(texts), (-9, "ab cde f g hij" * 7), (None, "some words of no document")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", ["error_taxonomy_a", "error_taxonomy_b", "relaxed_prf", "entity_prf", "span_count_stats"])
def test_scores_of_odd_texts(spark, tmp_path, name):
    """A document without a word is no example, so not a right one; words end at the blanks of the SQL."""
    con = odd_texts(spark, tmp_path)
    if name != "error_taxonomy_a":  # these have no say on documents without an id
        con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet' WHERE doc_id >= 0")
        spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id >= 0").write.parquet(f"{tmp_path}/some/documents.parquet")
    assert not compare.differences(spark, con, str(tmp_path) + ("" if name == "error_taxonomy_a" else "/some"), QUERIES[name], ORACLE_SQL[name])


def test_error_taxonomy_a_counts_by_batches(spark):
    """Spans meet and are counted in Arrow functions: no expression is evaluated for each word or span, and only sums are shuffled."""
    plan = QUERIES["error_taxonomy_a"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "split(" not in plan and plan.count("Aggregate") == 1
