"""Queries on threads, channels and incremental loads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.operators import examples as E
from spanloom.operators import threads as T
from spanloom.operators.datasets import streaks
from spanloom.plans.adapters import KEYWORDS, MARKERS, SPAM, T_SQL, table, threads

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query(
    f"""WITH {T_SQL}
SELECT conv_id AS thread_id, 'c' || (conv_id % 7) AS channel_id, min(text) FILTER (WHERE k = 0) AS top_comment_text,
  coalesce(string_agg(text, chr(10) ORDER BY k) FILTER (WHERE k > 0), '') AS replies_text, CAST(count(*) - 1 AS INT) AS n_replies,
  coalesce(bool_or(creator) FILTER (WHERE k > 0), false) AS has_creator_reply, CAST(sum(likes) AS BIGINT) AS total_likes,
  min(text) FILTER (WHERE k = 0) || chr(10) || coalesce(string_agg(text, chr(10) ORDER BY k) FILTER (WHERE k > 0), '') AS thread_text
FROM turns GROUP BY conv_id"""
)
def thread_assembly(spark, sf_dir):
    t = T.with_totals(threads(spark, sf_dir))
    texts = F.transform("replies", lambda r: r["text"])
    return t.select(
        "thread_id", "channel_id", F.col("top_comment.text").alias("top_comment_text"), F.array_join(texts, "\n").alias("replies_text"), F.size("replies").alias("n_replies"),
        "has_creator_reply", "total_likes", T.thread_text(F.col("top_comment.text"), texts).alias("thread_text"),
    )


@query("""SELECT doc_id, length(text) AS n, regexp_matches(text, '[\\x{00C0}-\\x{017F}]') AS has_script FROM documents""".replace("length(text) AS n, ", ""))
def script_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.has_script("text", 0x00C0, 0x017F).alias("has_script"))


@query(r"""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS INT) AS n_words FROM documents
WHERE len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) >= 3""")
def min_words_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.word_count("text").alias("n_words")).where("n_words >= 3")


@query("SELECT page_id, url FROM pages WHERE NOT (contains(lower(html), 'subscribe') OR contains(lower(html), 'click here') OR contains(lower(url), '7'))")
def spam_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.where(~X.contains_any("html", ("subscribe", "click here")) & ~X.contains_any("url", ("7",))).select("page_id", "url")


@query(
    f"""WITH {T_SQL}
SELECT t.conv_id AS thread_id, CAST(count(r.k) AS INT) AS n_kept, coalesce(string_agg(r.turn::VARCHAR, ',' ORDER BY r.k), '') AS kept
FROM (SELECT conv_id, text FROM turns WHERE k = 0) t
LEFT JOIN turns r ON r.conv_id = t.conv_id AND r.k > 0 AND (r.creator OR (regexp_matches(r.text, '[A-Z]') AND NOT contains(lower(r.text), 'ing')))
WHERE len(list_filter(regexp_split_to_array(t.text, '\\s+'), lambda w: w <> '')) >= 5 AND regexp_matches(t.text, '[A-Z]') AND NOT contains(lower(t.text), 'ing')
GROUP BY t.conv_id"""
)
def reply_filter(spark, sf_dir):
    kept = T.keep_threads(threads(spark, sf_dir), min_words=5, spam=("ing",), script=(ord("A"), ord("Z")))
    turns = F.transform("replies", lambda r: F.element_at(F.split(r["comment_id"], "_"), 2))
    return kept.select("thread_id", F.size("replies").alias("n_kept"), F.array_join(turns, ",").alias("kept"))


_ENDS = r"""\s|[.,!?״"''\-+=]"""
_SCORED = f"""
scored AS (
  SELECT conv_id, 'c' || (conv_id % 7) AS channel_id,
    max(CASE WHEN k = 0 AND (contains(text, '?') OR regexp_matches(lower(text), '(?:^|{_ENDS})(?:[והכלבמש]{{1,2}})?(?:{"|".join(MARKERS)})(?:{_ENDS}|$)')) THEN 1 ELSE 0 END) AS question,
    max(CASE WHEN k = 0 AND regexp_matches(lower(text), '{"|".join(KEYWORDS)}') THEN 1 ELSE 0 END) AS in_top,
    CAST(count(*) FILTER (WHERE k > 0 AND regexp_matches(lower(text), '{"|".join(KEYWORDS)}')) AS INT) AS in_replies,
    CAST(count(*) FILTER (WHERE k > 0 AND creator) AS INT) AS creators, count(*) - 1 AS replies
  FROM turns GROUP BY conv_id),
final AS (
  SELECT *, CASE WHEN question + in_top + in_replies = 0 THEN 0
    ELSE 10 * question + 8 * in_top + CASE WHEN replies > 0 THEN 5 ELSE 0 END + 15 * creators + 12 * in_replies END AS score FROM scored)"""


@query(f"WITH {T_SQL},{_SCORED} SELECT conv_id AS thread_id, CAST(score AS INT) AS score FROM final")
def thread_scores(spark, sf_dir):
    return threads(spark, sf_dir).select("thread_id", T.modification_score(MARKERS, KEYWORDS).alias("score"))


@query(
    f"""WITH {T_SQL},{_SCORED}
SELECT channel_id, count(*) AS n_threads, CAST(sum(score) AS BIGINT) AS total_score, CAST(max(score) AS INT) AS best_score FROM final WHERE score >= 20 GROUP BY channel_id ORDER BY n_threads DESC, channel_id"""
)
def modification_score(spark, sf_dir):
    """The flagship: threads, filtered and scored, by channel."""
    scored = threads(spark, sf_dir).withColumn("score", T.modification_score(MARKERS, KEYWORDS)).where("score >= 20")
    return (
        scored.groupBy("channel_id").agg(F.count("*").alias("n_threads"), F.sum("score").alias("total_score"), F.max("score").alias("best_score")).orderBy(F.desc("n_threads"), "channel_id")
    )


@query(f"WITH {T_SQL} SELECT 'c' || (conv_id % 7) AS channel_id, 'channel ' || (conv_id % 7) AS channel_title, count(*) AS n_threads, '' AS is_cooking FROM turns WHERE k = 0 GROUP BY conv_id % 7")
def channel_report(spark, sf_dir):
    return T.channel_report(threads(spark, sf_dir))


@query(f"WITH {T_SQL} SELECT conv_id AS thread_id, 'c' || (conv_id % 7) AS channel_id FROM turns WHERE k = 0 AND conv_id % 7 IN (1, 3)")
def channel_semi_filter(spark, sf_dir):
    t = threads(spark, sf_dir)
    report = t.select("channel_id").distinct().withColumn("is_cooking", F.when(F.col("channel_id").isin("c1", "c3"), " yes ").otherwise("no"))
    return T.approved(t, report).select("thread_id", "channel_id")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, CAST(p_size * 1000 AS BIGINT) AS subscribers, CAST(p_retailprice AS BIGINT) % 60 AS videos FROM part WHERE regexp_matches(p_name || ' ' || p_brand, '[0-9]') AND p_size * 1000 >= 10000 AND CAST(floor(p_retailprice) AS BIGINT) % 60 >= 30".replace("CAST(p_retailprice AS BIGINT) % 60 AS videos", "CAST(floor(p_retailprice) AS BIGINT) % 60 AS videos"))
def channel_quality_filter(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("description"),
        (F.col("p_size") * 1000).cast("long").alias("subscribers"), (F.floor("p_retailprice") % 60).alias("videos"),
    )
    return T.channel_filter(p, script=(ord("0"), ord("9"))).drop("description")


_CATEGORY = (("baking", ("brass", "cake")), ("meat", ("steel", "grill")), ("bread", ("tin", "yeast")), ("healthy", ("nickel", "diet")))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name || ' ' || p_type), 'brass|cake') THEN 'baking' WHEN regexp_matches(lower(p_name || ' ' || p_type), 'steel|grill') THEN 'meat'
  WHEN regexp_matches(lower(p_name || ' ' || p_type), 'tin|yeast') THEN 'bread' WHEN regexp_matches(lower(p_name || ' ' || p_type), 'nickel|diet') THEN 'healthy' ELSE 'cooking' END AS category FROM part""")
def category_guess(spark, sf_dir):
    text = F.concat_ws(" ", "p_name", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", X.ladder(text, _CATEGORY, "cooking").alias("category"))


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)) WHERE n = 1")
def incremental_anti_join(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("o_custkey"))
    return T.new_rows(table(spark, sf_dir, "orders"), known, "o_custkey", "o_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def upsert_absent(spark, sf_dir):
    old = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return T.upsert_absent(old, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), "id")


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem),
b AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS m FROM a WHERE n <= 2)
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM b WHERE m <= 50 ORDER BY l_orderkey, l_linenumber LIMIT 300""")
def nested_caps(spark, sf_dir):
    kept = T.nested_caps(table(spark, sf_dir, "lineitem"), [(["l_suppkey", "l_partkey"], 2), (["l_suppkey"], 50)], ["l_orderkey", "l_linenumber"], 300)
    return kept.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")


_MESSAGE = ("403 quota exceeded", "503 Service Unavailable", "429 too many requests", "Connection reset", "odd", "model is overloaded", "timed out")


@query("""WITH m AS (SELECT event_id, user_id, ['403 quota exceeded', '503 Service Unavailable', '429 too many requests', 'Connection reset', 'odd', 'model is overloaded', 'timed out'][event_id % 7 + 1] AS message FROM events WHERE event_type = 'error')
SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'auth' WHEN 1 THEN 'overloaded' WHEN 2 THEN 'rate_limit' WHEN 3 THEN 'transient' WHEN 4 THEN 'other' WHEN 5 THEN 'overloaded' ELSE 'transient' END AS kind,
  event_id % 7 IN (1, 2, 5) AS is_rate_limit FROM m""")
def error_class_ladder(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    message = F.element_at(F.array(*map(F.lit, _MESSAGE)), (F.col("event_id") % 7 + 1).cast("int"))
    return e.select("event_id", X.error_class(message).alias("kind"), X.is_rate_limit(message).alias("is_rate_limit"))


@query("""WITH a AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events),
b AS (SELECT *, CASE WHEN event_type = 'error' THEN sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) ELSE 0 END AS streak FROM a)
SELECT event_id, CAST(streak AS BIGINT) AS streak, CASE WHEN streak > 0 THEN least(300.0::DOUBLE, 60 * pow(2.0::DOUBLE, streak - 1)) ELSE 0.0::DOUBLE END AS wait, streak >= 5 AS killed FROM b""")
def backoff_streaks(spark, sf_dir):
    s = streaks(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return s.select("event_id", F.col("streak").cast("long").alias("streak"), "wait", (F.col("streak") >= 5).alias("killed"))


@query("""WITH c AS (SELECT user_id, event_id, CAST(value AS BIGINT) % 3 AS v, ts FROM events),
p AS (SELECT *, CASE WHEN lag(v) OVER (PARTITION BY user_id ORDER BY ts, event_id) = v THEN 0 ELSE 1 END AS fresh FROM c),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS run FROM i)
SELECT user_id, count(*) FILTER (WHERE run = 3) AS n_stable FROM r GROUP BY user_id""".replace("CAST(value AS BIGINT) % 3", "CAST(floor(value) AS BIGINT) % 3"))
def stability_stops(spark, sf_dir):
    """How often each user's count stays the same three times in a row."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("v", F.floor("value") % 3)
    e = e.withColumn("fresh", F.when(F.lag("v").over(w) == F.col("v"), 0).otherwise(1)).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.row_number().over(Window.partitionBy("user_id", "island").orderBy("ts", "event_id"))
    return e.withColumn("run", run).groupBy("user_id").agg(F.count_if(F.col("run") == 3).alias("n_stable"))


@query(f"""WITH {T_SQL}
SELECT r.conv_id AS thread_id, 'reply_' || r.k AS source_comment, r.text, CASE WHEN trim(t.text) <> '' AND trim(t.text) <> trim(r.text) THEN '[שאלה] ' || t.text || ' [תשובה] ' || r.text ELSE r.text END AS thread_aware_text,
  CAST(CASE WHEN trim(t.text) <> '' AND trim(t.text) <> trim(r.text) THEN length('[שאלה] ' || t.text || ' [תשובה] ') ELSE 0 END AS INT) AS prefix_len
FROM turns r JOIN turns t ON r.conv_id = t.conv_id AND t.k = 0 WHERE r.k > 0""")
def thread_aware_prefix(spark, sf_dir):
    t = threads(spark, sf_dir).select("thread_id", F.col("top_comment.text").alias("top"), F.posexplode("replies").alias("k", "r"))
    made = E.thread_aware(F.col("r.text"), F.col("top"))
    return t.select("thread_id", F.concat(F.lit("reply_"), F.col("k") + 1).alias("source_comment"), F.col("r.text").alias("text"), made["text"].alias("thread_aware_text"), made["prefix_len"].alias("prefix_len"))


@query(f"""WITH {T_SQL},
s AS (SELECT conv_id, unnest(['top', 'reply_1', 'reply_2', 'reply_0', 'reply_99', 'reply_x', 'other']) AS source FROM turns WHERE k = 0)
SELECT s.conv_id AS thread_id, s.source AS source_comment, t.text FROM s JOIN turns t ON t.conv_id = s.conv_id AND t.k = CASE s.source WHEN 'top' THEN 0 WHEN 'reply_1' THEN 1 WHEN 'reply_2' THEN 2 ELSE -1 END""")
def source_lookup(spark, sf_dir):
    asked = F.explode(F.array(*map(F.lit, ("top", "reply_1", "reply_2", "reply_0", "reply_99", "reply_x", "other"))))
    t = threads(spark, sf_dir).select("thread_id", "top_comment", "replies", asked.alias("source_comment"))
    text = E.source_text(F.col("source_comment"), F.col("top_comment.text"), F.transform("replies", lambda r: r["text"]))
    return t.select("thread_id", "source_comment", text.alias("text")).where("text is not null")


@query(f"""WITH {T_SQL},
b AS (SELECT conv_id, min(text) FILTER (WHERE k = 0) AS top, coalesce(string_agg('[reply_' || k || CASE WHEN creator THEN ', creator' ELSE '' END || '] ' || text, chr(10) ORDER BY k) FILTER (WHERE k > 0), '') AS replies FROM turns GROUP BY conv_id),
n AS (SELECT *, CAST('0x' || substr(md5('42|' || conv_id), 1, 8) AS BIGINT) % 7 AS bucket FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY conv_id) - 1 AS i FROM n)
SELECT bucket, i // 5 AS batch, CAST(count(*) AS INT) AS n_threads, string_agg('=== THREAD ' || (i % 5 + 1) || ' (' || conv_id || ') ===' || chr(10) || '[top] ' || top || chr(10) || replies, chr(10) || chr(10) ORDER BY i) AS prompt FROM r GROUP BY bucket, i // 5""")
def prompt_batches(spark, sf_dir):
    return T.prompts(threads(spark, sf_dir), 5, buckets=7)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN c_name || ' flat' WHEN c_custkey % 5 = 2 THEN c_name WHEN c_custkey % 5 = 3 THEN c_mktsegment ELSE 'first' END AS parent_text FROM customer""")
def parent_fallback(spark, sf_dir):
    k = F.col("c_custkey") % 5
    comments = F.array(F.struct(F.lit("first").alias("text"), F.lit(False).alias("is_top")), F.struct(F.when(k == 3, F.col("c_mktsegment")).otherwise(" ").alias("text"), (k != 4).alias("is_top")))
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(k == 1, F.concat("c_name", F.lit(" flat"))).otherwise("  ").alias("top_comment_text"),
        F.struct(F.when(k == 2, F.col("c_name")).alias("text")).alias("top_comment"), F.when(k != 0, comments).alias("comments"),
    )
    return rows.select("c_custkey", T.parent_text().alias("parent_text"))


@query("""SELECT 'all' AS kind, count(*) AS n FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT o_custkey FROM orders)
UNION ALL SELECT 'distinct', count(*) FROM (SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders)
UNION ALL SELECT 'common', count(*) FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders)
UNION ALL SELECT 'only_left', count(*) FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)
UNION ALL SELECT 'either', (SELECT count(*) FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)) + (SELECT count(*) FROM (SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer))""")
def set_ops(spark, sf_dir):
    a, b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    found = {"all": a.union(b), "distinct": a.union(b).distinct(), "common": a.intersect(b), "only_left": a.subtract(b), "either": a.subtract(b).union(b.subtract(a))}
    out = None
    for kind, df in found.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.union(one)
    return out


@query("""WITH e AS (SELECT event_id, event_type AS label, 'w' || (CAST(floor(value) AS BIGINT) % 25) AS word, (event_id % 100) / 100.0::DOUBLE AS score FROM events WHERE event_type <> 'error'),
f AS (SELECT *, row_number() OVER (PARTITION BY label, word ORDER BY event_id) AS n FROM e WHERE score >= 0.45 AND length(word) >= 2)
SELECT label, count(*) AS n_items, string_agg(word, ',' ORDER BY event_id) AS words, CAST(max(round(score * 100)) AS INT) AS best FROM f WHERE n = 1 GROUP BY label""")
def serving_rollup(spark, sf_dir):
    """Predictions by label: confident ones with a word of two letters or more, the first of each word."""
    e = table(spark, sf_dir, "events").where("event_type <> 'error'").select(
        "event_id", F.col("event_type").alias("label"), F.concat(F.lit("w"), F.floor("value") % 25).alias("word"), ((F.col("event_id") % 100) / 100.0).alias("score"))
    first = Window.partitionBy("label", "word").orderBy("event_id")
    kept = e.where((F.col("score") >= 0.45) & (F.length("word") >= 2)).withColumn("n", F.row_number().over(first)).where("n = 1")
    items = F.array_sort(F.collect_list(F.struct("event_id", "word")))
    return kept.groupBy("label").agg(F.count("*").alias("n_items"), F.array_join(F.transform(items, lambda i: i["word"]), ",").alias("words"), F.max(F.round(F.col("score") * 100)).cast("int").alias("best"))


@query()
def stream_ingest(spark, sf_dir):
    """Events read as a stream of files; keys are appended once."""
    from spanloom.storage import new_folder
    from spanloom.streaming.ingest import ingest

    base = new_folder(spark, "stream")
    known = table(spark, sf_dir, "events")
    known.repartition(4).write.parquet(f"{base}/in")
    fields = ", ".join(f"{n} {t}" for n, t in known.dtypes)
    ingest(spark, f"{base}/in", fields, f"{base}/out", f"{base}/checkpoint", "event_id", "ts", form="parquet", files_per_trigger=2).awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n"))


SQL["stream_ingest"] = "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"
