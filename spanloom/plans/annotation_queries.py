"""Queries on annotators' outputs: agreement, votes, cleaning and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.operators import annotate as N
from spanloom.operators import audit as U
from spanloom.operators import metrics as M
from spanloom.operators.examples import comment_examples
from spanloom.plans.adapters import A_SQL, VOTE_SQL, annotations, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def voted(spark, sf_dir):
    rows = annotations(spark, sf_dir)
    rows = rows.withColumn("vote", N.vote(F.col("out1"), F.col("out2"), F.col("out3"), F.col("pass3_skipped")))
    return rows.select(
        "doc_id", "text", "out1", "out2", "out3", "pass3_skipped", F.col("vote.final").alias("final_label"), F.col("vote.method").alias("vote_method"), "vote.needs_review",
        "vote.true_votes", "vote.false_votes", "vote.agreement_1v2", "vote.agreement_1v3", "vote.agreement_2v3",
    )


@query(f"WITH {A_SQL} SELECT doc_id, g12 AS agreement_1v2, g13 AS agreement_1v3, g23 AS agreement_2v3 FROM agreed")
def pairwise_agreement(spark, sf_dir):
    a, b, c = F.col("out1"), F.col("out2"), F.col("out3")
    return annotations(spark, sf_dir).select("doc_id", N.agreement(a, b).alias("agreement_1v2"), N.agreement(a, c).alias("agreement_1v3"), N.agreement(b, c).alias("agreement_2v3"))


@query(f"""WITH {A_SQL}, {VOTE_SQL},
l AS (SELECT 'agreement_1v2' AS pair, v12 AS level FROM voted UNION ALL SELECT 'agreement_1v3', v13 FROM voted UNION ALL SELECT 'agreement_2v3', v23 FROM voted),
c AS (SELECT pair, level, count(*) AS n FROM l WHERE level <> 'error' GROUP BY ALL)
SELECT pair, level, n, round(n / CAST(sum(n) OVER (PARTITION BY pair) AS DOUBLE), 6) AS share FROM c""")
def agreement_distribution(spark, sf_dir):
    return U.agreement_distribution(voted(spark, sf_dir))


@query(f"""WITH {A_SQL} SELECT doc_id, CASE WHEN f1 IS NULL THEN 'first' WHEN f2 IS NULL THEN 'second' WHEN f3 IS NULL AND NOT coalesce(skipped, false) THEN CASE WHEN g12 = 'full' THEN 'skip' ELSE 'third' END ELSE 'none' END AS route FROM agreed""")
def tiebreak_routing(spark, sf_dir):
    return N.route_passes(annotations(spark, sf_dir)).select("doc_id", "route")


@query(f"""WITH {A_SQL}, {VOTE_SQL}
SELECT doc_id, final_flag AS has_modification, final_kind AS thread_type, array_to_string(list_transform(final_mods, lambda m: m.a), ',') AS aspects, method AS vote_method,
  method IN ('insufficient', 'no_majority') AS needs_review, v12 AS agreement_1v2, v13 AS agreement_1v3, v23 AS agreement_2v3,
  CAST(CASE WHEN pair THEN CASE WHEN f1 THEN 2 ELSE 0 END WHEN given < 2 THEN 0 ELSE yes END AS INT) AS true_votes FROM voted""")
def majority_vote(spark, sf_dir):
    f = F.col("final_label")
    return voted(spark, sf_dir).select(
        "doc_id", f["has_modification"].alias("has_modification"), f["thread_type"].alias("thread_type"), F.array_join(F.transform(f["modifications"], lambda m: m["aspect"]), ",").alias("aspects"),
        "vote_method", "needs_review", "agreement_1v2", "agreement_1v3", "agreement_2v3", "true_votes",
    )


@query(f"""WITH {A_SQL}, {VOTE_SQL} SELECT method AS vote_method, count(*) AS n, count(*) FILTER (WHERE method IN ('insufficient', 'no_majority')) AS n_review,
  count(*) FILTER (WHERE final_flag) AS n_positive FROM voted GROUP BY method""")
def vote_stats(spark, sf_dir):
    return U.vote_stats(voted(spark, sf_dir).withColumn("has_modification", F.col("final_label.has_modification")))


@query(f"WITH {A_SQL}, {VOTE_SQL} SELECT doc_id, method AS vote_method FROM voted WHERE method IN ('insufficient', 'no_majority')")
def review_export(spark, sf_dir):
    return voted(spark, sf_dir).where("needs_review").select("doc_id", "vote_method")


@query(f"WITH {A_SQL}, {VOTE_SQL} SELECT doc_id, final_flag AS has_modification FROM voted WHERE method IN ('unanimous', 'gemini_unanimous')")
def unanimous_filter(spark, sf_dir):
    return voted(spark, sf_dir).where(N.is_unanimous(F.col("vote_method"))).select("doc_id", "final_label.has_modification")


_ODD = "CASE WHEN doc_id % 3 = 0 THEN upper(w) ELSE '  ' || w || '. ' END"


@query(f"""WITH {A_SQL}, {VOTE_SQL},
s AS (SELECT doc_id, unnest(list_transform(final_mods, lambda m: m.w)) AS w, text FROM voted WHERE final_flag),
o AS (SELECT doc_id, {_ODD} AS span, text FROM s)
SELECT doc_id, span, contains(trim(regexp_replace(text, '\\s+', ' ', 'g')), trim(trim(span), '.')) AS occurs FROM o""")
def span_light_check(spark, sf_dir):
    rows = voted(spark, sf_dir).where("final_label.has_modification").select("doc_id", "text", F.explode("final_label.modifications").alias("m"))
    span = F.when(F.col("doc_id") % 3 == 0, F.upper("m.span")).otherwise(F.concat(F.lit("  "), F.col("m.span"), F.lit(". ")))
    return rows.select("doc_id", span.alias("span"), X.span_occurs(span, "text").alias("occurs"))


@query(f"""WITH {A_SQL}, {VOTE_SQL},
s AS (SELECT doc_id, coalesce(final_flag, false) AS positive, list_transform(coalesce(final_mods, []), lambda m: contains(text, CASE WHEN doc_id % 3 = 0 THEN upper(m.w) ELSE m.w END)) AS oks FROM voted WHERE final_flag IS NOT NULL)
SELECT doc_id, CAST(CASE WHEN positive THEN len(oks) ELSE 0 END AS INT) AS checked, CAST(CASE WHEN positive THEN len(list_filter(oks, lambda x: x)) ELSE 0 END AS INT) AS kept,
  CAST(CASE WHEN positive THEN len(list_filter(oks, lambda x: NOT x)) ELSE 0 END AS INT) AS dropped, positive AND len(oks) > 0 AND len(list_filter(oks, lambda x: x)) = 0 AS flipped,
  positive AND NOT (len(oks) > 0 AND len(list_filter(oks, lambda x: x)) = 0) AS has_modification FROM s""")
def span_cleaning(spark, sf_dir):
    rows = voted(spark, sf_dir).where("final_label is not null")
    odd = F.transform("final_label.modifications", lambda m: m.withField("span", F.when(F.col("doc_id") % 3 == 0, F.upper(m["span"])).otherwise(m["span"])))
    rows = rows.withColumn("c", N.clean_spans(F.col("final_label").withField("modifications", odd), F.col("text")))
    return rows.select("doc_id", "c.checked", "c.kept", "c.dropped", "c.flipped", "c.label.has_modification")


@query(f"""WITH {A_SQL} SELECT 1 AS pass, count(*) AS n_rows, count(f1) AS n_labeled, count(f1) AS n_effective FROM passes
UNION ALL SELECT 2, count(*), count(f2), count(f2) FROM passes UNION ALL SELECT 3, count(*), count(f3), count(*) FILTER (WHERE f3 IS NOT NULL OR skipped) FROM passes""")
def pass_coverage(spark, sf_dir):
    return U.coverage(annotations(spark, sf_dir))


_STATS = """s AS (
  SELECT 1 AS pass, count(f1) AS n_labeled, count(*) FILTER (WHERE f1) AS n_positive, CAST(coalesce(sum(len(m1)) FILTER (WHERE f1 IS NOT NULL), 0) AS BIGINT) AS n_modifications FROM passes
  UNION ALL SELECT 2, count(f2), count(*) FILTER (WHERE f2), CAST(coalesce(sum(len(m2)) FILTER (WHERE f2 IS NOT NULL), 0) AS BIGINT) FROM passes
  UNION ALL SELECT 3, count(f3), count(*) FILTER (WHERE f3), CAST(coalesce(sum(len(m3)) FILTER (WHERE f3), 0) AS BIGINT) FROM passes),
r AS (SELECT *, n_positive / CAST(n_labeled AS DOUBLE) AS rate FROM s)"""


@query(f"WITH {A_SQL}, {_STATS} SELECT pass, n_labeled, n_positive, n_modifications, round(rate, 6) AS positive_rate, round(max(rate) OVER () - min(rate) OVER (), 6) AS spread FROM r")
def pass_label_stats(spark, sf_dir):
    return U.label_stats(annotations(spark, sf_dir))


@query(f"""WITH {A_SQL}, m AS (
  SELECT 1 AS pass, text, unnest(m1) AS m FROM passes WHERE f1 IS NOT NULL UNION ALL SELECT 2, text, unnest(m2) FROM passes WHERE f2 IS NOT NULL UNION ALL SELECT 3, text, unnest(m3) FROM passes WHERE f3)
SELECT pass, m.a AS aspect, count(*) AS n_spans, count(*) FILTER (WHERE NOT contains(trim(regexp_replace(text, '\\s+', ' ', 'g')), m.w)) AS n_lost,
  round(count(*) FILTER (WHERE NOT contains(trim(regexp_replace(text, '\\s+', ' ', 'g')), m.w)) / CAST(count(*) AS DOUBLE), 6) AS rate FROM m GROUP BY pass, m.a""")
def hallucination_rates(spark, sf_dir):
    return U.hallucinations(annotations(spark, sf_dir))


@query(f"""WITH {A_SQL}, {VOTE_SQL}, {_STATS},
o AS (SELECT count(*) FILTER (WHERE final_flag) / CAST(count(*) AS DOUBLE) AS final_rate, count(*) FILTER (WHERE v12 = 'full') / CAST(count(*) FILTER (WHERE v12 IN ('full', 'partial', 'none')) AS DOUBLE) AS agree FROM voted),
p AS (SELECT max(rate) - min(rate) AS spread, max(rate) FILTER (WHERE pass = 1) AS first_rate FROM r),
m AS (SELECT doc_id, text, unnest(m1) AS m FROM passes WHERE f1 IS NOT NULL UNION ALL SELECT doc_id, text, unnest(m2) FROM passes WHERE f2 IS NOT NULL UNION ALL SELECT doc_id, text, unnest(m3) FROM passes WHERE f3),
h AS (SELECT count(*) FILTER (WHERE NOT contains(text, CASE WHEN doc_id % 9 = 0 THEN m.w || '#' ELSE m.w END)) / CAST(count(*) AS DOUBLE) AS lost FROM m)
SELECT 'positive_rate' AS section, CASE WHEN first_rate < 0.03 OR first_rate > 0.8 THEN 'WARN' ELSE 'PASS' END AS level FROM p
UNION ALL SELECT 'final_rate', CASE WHEN final_rate < 0.03 THEN 'FAIL' WHEN final_rate < 0.08 THEN 'WARN' ELSE 'PASS' END FROM o
UNION ALL SELECT 'agreement', CASE WHEN agree < 0.4 THEN 'WARN' ELSE 'PASS' END FROM o
UNION ALL SELECT 'spread', CASE WHEN spread > 0.2 THEN 'WARN' ELSE 'PASS' END FROM p
UNION ALL SELECT 'hallucination', CASE WHEN lost > 0.15 THEN 'FAIL' WHEN lost > 0.05 THEN 'WARN' ELSE 'PASS' END FROM h""")
def audit_gates(spark, sf_dir):
    """The gates, over spans of which every ninth document's are changed so that no text has them."""
    rows = voted(spark, sf_dir)
    changed = lambda c: F.when(F.col(c).isNotNull(), F.col(c).withField("modifications", F.transform(F.col(c)["modifications"], lambda m: m.withField("span", F.when(F.col("doc_id") % 9 == 0, F.concat(m["span"], F.lit("#"))).otherwise(m["span"])))))
    rows = rows.withColumns({c: changed(c) for c in ("out1", "out2", "out3")})
    stats = U.label_stats(rows)
    first = stats.agg(F.max(F.when(F.col("pass") == 1, F.col("positive_rate"))).alias("positive_rate"), F.max("spread").alias("spread"))
    final = rows.agg(M.ratio(F.count_if(F.coalesce("final_label.has_modification", F.lit(False))), F.count("*")).alias("final_rate"))
    lost = U.hallucinations(rows).agg(M.ratio(F.sum("n_lost"), F.sum("n_spans")).alias("span_loss"))
    one = first.join(final).join(lost).join(U.agreement_rate(rows, "agreement_1v2").select("rate"))  # one row each
    return U.gates(one, U.standard_gates(F.col("span_loss"), F.col("positive_rate"), F.col("final_rate"), F.col("rate"), F.col("spread")))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return U.duplicate_keys(table(spark, sf_dir, "orders"), "o_custkey")


@query("""SELECT 'quality' AS field, count(*) FILTER (WHERE quality IS NULL) AS n_missing, CAST(0 AS BIGINT) AS n_empty FROM documents d LEFT JOIN labels USING (doc_id)
UNION ALL SELECT 'text', count(*) FILTER (WHERE text IS NULL), count(*) FILTER (WHERE trim(text) = '') FROM documents""")
def missing_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return U.missing_fields(rows, ["quality", "text"])


@query("SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fp, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fn, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS tn, "
       "round(count(*) FILTER (WHERE quality = toxic) / CAST(count(*) AS DOUBLE), 6) AS accuracy, round(count(*) FILTER (WHERE quality = 1 AND toxic = 1) / CAST(count(*) FILTER (WHERE toxic = 1) AS DOUBLE), 6) AS precision, "
       "round(count(*) FILTER (WHERE quality = 1 AND toxic = 1) / CAST(count(*) FILTER (WHERE quality = 1) AS DOUBLE), 6) AS recall, "
       "round(2 * count(*) FILTER (WHERE quality = 1 AND toxic = 1) / CAST(count(*) FILTER (WHERE toxic = 1) + count(*) FILTER (WHERE quality = 1) AS DOUBLE), 6) AS f1 FROM labels")
def binary_confusion(spark, sf_dir):
    return M.confusion(table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("g"), (F.col("toxic") == 1).alias("p")), "g", "p")


@query("""WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY ALL), t AS (SELECT CAST(sum(n) AS BIGINT) AS n, sum(CASE WHEN a = b THEN n ELSE 0 END) AS same FROM c),
e AS (SELECT sum(x * y) AS xy FROM (SELECT v, CAST((SELECT coalesce(sum(n), 0) FROM c WHERE a = v) AS DOUBLE) AS x, CAST((SELECT coalesce(sum(n), 0) FROM c WHERE b = v) AS DOUBLE) AS y FROM (SELECT unnest([0, 1]) AS v))),
k AS (SELECT n, same / CAST(n AS DOUBLE) AS po, xy / (CAST(n AS DOUBLE) * n) AS pe FROM t, e)
SELECT n, round(po, 6) AS observed, round(pe, 6) AS expected, round((po - pe) / (1 - pe), 6) AS kappa,
  CASE WHEN (po - pe) / (1 - pe) < 0 THEN 'Poor' WHEN (po - pe) / (1 - pe) < 0.2 THEN 'Slight' WHEN (po - pe) / (1 - pe) < 0.4 THEN 'Fair' WHEN (po - pe) / (1 - pe) < 0.6 THEN 'Moderate' WHEN (po - pe) / (1 - pe) < 0.8 THEN 'Substantial' ELSE 'Almost Perfect' END AS meaning FROM k""")
def cohens_kappa(spark, sf_dir):
    return M.kappa(table(spark, sf_dir, "labels"), "quality", "toxic")


@query(f"""WITH {A_SQL}, {VOTE_SQL}, p AS (SELECT doc_id, text, unnest(final_mods) AS m FROM voted WHERE final_flag AND trim(text) <> '')
SELECT doc_id AS thread_id, 'top' AS source_comment, true AS has_modification, string_agg(m.w, ',' ORDER BY m.a = 'ADDITION', m.a = 'TECHNIQUE', m.a = 'QUANTITY') AS spans FROM p GROUP BY doc_id
UNION ALL SELECT doc_id, 'top', false, '' FROM voted WHERE NOT coalesce(final_flag, false) AND trim(text) <> ''""")
def thread_examples(spark, sf_dir):
    labeled = voted(spark, sf_dir).select(
        F.col("doc_id").alias("thread_id"), F.col("text").alias("top_comment_text"), F.array().cast("array<string>").alias("replies_texts"), F.col("final_label").alias("label"), "vote_method")
    return comment_examples(labeled).select("thread_id", "source_comment", "has_modification", F.array_join(F.transform("modifications", lambda m: m["span"]), ",").alias("spans"))


_RAW = """CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN 'Here it is: ' || props || ' done' WHEN 3 THEN 'list [' || props || ', ' || props || '] end' WHEN 4 THEN 'nothing' ELSE '' END"""


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN props WHEN 2 THEN props WHEN 3 THEN '[' || props || ', ' || props || ']' END AS json FROM events""")
def json_parse_fallback(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", N.json_text(F.expr(_RAW.replace("chr(10)", "char(10)"))).alias("json"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE event_id % 4 = 0 OR (event_id % 4 = 1 AND event_type <> 'error') END AS has_modification,
  CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 0 THEN 'SUBSTITUTION:1.0' WHEN event_id % 4 = 1 AND event_type <> 'error' THEN 'ADDITION:0.5' ELSE '' END AS mods FROM events""")
def annotator_sanitise(spark, sf_dir):
    good = F.lit('{"thread_type": "question", "modifications": [{"span": " x ", "aspect": "substitution", "confidence": 1.7}, {"span": "", "aspect": "ADDITION"}]}')
    some = F.concat(F.lit('{"modifications": [{"span": "'), F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")), F.lit('", "aspect": "Addition"}, {"span": "y", "aspect": "ODD"}]}'))
    k = F.col("event_id") % 4
    out = N.sanitize(F.when(k == 0, good).when(k == 1, some).when(k == 2, F.lit('{"modifications": []}')))
    mods = F.transform(out["modifications"], lambda m: F.concat(m["aspect"], F.lit(":"), m["confidence"].cast("string")))
    return table(spark, sf_dir, "events").select("event_id", out["has_modification"].alias("has_modification"), F.array_join(mods, ",").alias("mods"))


@query("""WITH q AS (SELECT event_id // 5 AS batch, event_id % 5 AS pos, 't' || event_id AS thread_id FROM events),
a AS (SELECT batch, pos, thread_id, 'a' || pos AS answer FROM q WHERE batch % 3 <> 0 OR pos <> 2),
n AS (SELECT batch, (SELECT count(*) FROM a WHERE a.batch = q.batch) = count(*) AS by_place FROM q GROUP BY batch)
SELECT q.batch, q.pos, q.thread_id, a.answer FROM q JOIN n ON q.batch = n.batch LEFT JOIN a ON a.batch = q.batch AND CASE WHEN by_place THEN a.pos = q.pos ELSE a.thread_id = q.thread_id END""")
def batch_matching(spark, sf_dir):
    q = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 5).alias("batch"), (F.col("event_id") % 5).alias("pos"), F.concat(F.lit("t"), "event_id").alias("thread_id"))
    return N.match_batch(q, q.where("batch % 3 <> 0 or pos <> 2").withColumn("answer", F.concat(F.lit("a"), "pos")))
