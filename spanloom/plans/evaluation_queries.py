"""Queries that score predictions and build training sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.operators import datasets as D
from spanloom.operators import metrics as M
from spanloom.operators import spans as S
from spanloom.operators.annotate import is_unanimous
from spanloom.plans.adapters import G_SQL, SPANS_SQL, table, tagged_texts, tags
from spanloom.schemas import BIO

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _scored(spark, sf_dir, worded=False):
    return M.with_spans(tagged_texts(spark, sf_dir, worded))


def _score(tp, n_pred, n_gold):
    p, r = f"coalesce({tp} / nullif(CAST({n_pred} AS DOUBLE), 0), 0)", f"coalesce({tp} / nullif(CAST({n_gold} AS DOUBLE), 0), 0)"
    return f"round({p}, 6) AS precision, round({r}, 6) AS recall, round(coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0), 6) AS f1"


_BOTH = """both_ AS (SELECT coalesce(g.example_id, p.example_id) AS example_id, coalesce(g.aspect, p.aspect) AS aspect, g.start IS NOT NULL AS g, p.start IS NOT NULL AS p
  FROM gold_spans g FULL JOIN pred_spans p ON g.example_id = p.example_id AND g.aspect = p.aspect AND g.start = p.start AND g."end" = p."end")"""
_COUNTS = "count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE p) AS n_pred, count(*) FILTER (WHERE g) AS n_gold"


@query(f"WITH {SPANS_SQL}, {_BOTH}, c AS (SELECT {_COUNTS} FROM both_) SELECT tp, n_pred, n_gold, {_score('tp', 'n_pred', 'n_gold')} FROM c")
def entity_prf(spark, sf_dir):
    return M.exact_prf(_scored(spark, sf_dir))


@query(f"WITH {SPANS_SQL}, {_BOTH}, c AS (SELECT aspect, {_COUNTS} FROM both_ GROUP BY aspect) SELECT aspect, tp, n_pred, n_gold, {_score('tp', 'n_pred', 'n_gold')} FROM c")
def entity_prf_by_aspect(spark, sf_dir):
    return M.exact_prf(_scored(spark, sf_dir), by_aspect=True)


@query(f"""WITH {SPANS_SQL}, {_BOTH}, c AS (SELECT aspect, {_COUNTS} FROM both_ GROUP BY aspect), s AS (SELECT n_gold, {_score('tp', 'n_pred', 'n_gold')} FROM c)
SELECT 'macro' AS average, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM s
UNION ALL SELECT 'weighted', round(sum(precision * n_gold) / sum(n_gold), 6), round(sum(recall * n_gold) / sum(n_gold), 6), round(sum(f1 * n_gold) / sum(n_gold), 6) FROM s""")
def entity_averages(spark, sf_dir):
    return M.averages(M.exact_prf(_scored(spark, sf_dir), by_aspect=True))


_TOUCH = "a.example_id = b.example_id AND a.aspect = b.aspect AND a.start <= b.\"end\" AND a.\"end\" >= b.start"


@query(f"""WITH {SPANS_SQL}, c AS (SELECT (SELECT count(*) FROM gold_spans) AS n_gold, (SELECT count(*) FROM pred_spans) AS n_pred,
  (SELECT count(*) FROM gold_spans a WHERE EXISTS (SELECT 1 FROM pred_spans b WHERE {_TOUCH})) AS gold_hit, (SELECT count(*) FROM pred_spans a WHERE EXISTS (SELECT 1 FROM gold_spans b WHERE {_TOUCH})) AS pred_hit),
s AS (SELECT *, pred_hit / CAST(n_pred AS DOUBLE) AS p, gold_hit / CAST(n_gold AS DOUBLE) AS r FROM c)
SELECT n_gold, n_pred, gold_hit, pred_hit, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM s""")
def relaxed_prf(spark, sf_dir):
    return M.relaxed_prf(_scored(spark, sf_dir))


@query(f"""WITH {G_SQL}, t AS (SELECT tag, count(*) FILTER (WHERE gold = tag AND pred = tag) AS tp, count(*) FILTER (WHERE pred = tag) AS np, count(*) FILTER (WHERE gold = tag) AS ng
  FROM tags, (SELECT unnest(n) AS tag FROM names) WHERE tag <> 'O' AND (gold = tag OR pred = tag) GROUP BY tag),
s AS (SELECT coalesce(tp / nullif(CAST(np AS DOUBLE), 0), 0) AS p, coalesce(tp / nullif(CAST(ng AS DOUBLE), 0), 0) AS r FROM t),
f AS (SELECT p, r, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM s)
SELECT (SELECT round(count(*) FILTER (WHERE gold = pred) / CAST(count(*) AS DOUBLE), 6) FROM tags) AS accuracy, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f), 6) AS f1 FROM f""")
def token_macro_f1(spark, sf_dir):
    return M.token_scores(tags(spark, sf_dir))


_ANY = "a.example_id = b.example_id AND a.start <= b.\"end\" AND a.\"end\" >= b.start"


@query(f"""WITH {SPANS_SQL},
miss AS (SELECT * FROM gold_spans EXCEPT SELECT * FROM pred_spans), extra AS (SELECT * FROM pred_spans EXCEPT SELECT * FROM gold_spans),
k AS (SELECT 'correct' AS kind FROM (SELECT DISTINCT example_id FROM tags) WHERE example_id NOT IN (SELECT example_id FROM miss UNION SELECT example_id FROM extra)
  UNION ALL SELECT CASE WHEN NOT EXISTS (SELECT 1 FROM pred_spans b WHERE {_ANY}) THEN 'false_negative' WHEN EXISTS (SELECT 1 FROM pred_spans b WHERE {_TOUCH}) THEN 'span_boundary' ELSE 'aspect_confusion' END FROM miss a
  UNION ALL SELECT 'false_positive' FROM extra a WHERE NOT EXISTS (SELECT 1 FROM gold_spans b WHERE {_ANY}))
SELECT kind, count(*) AS n FROM k GROUP BY kind""")
def error_taxonomy_a(spark, sf_dir):
    return M.errors_simple(_scored(spark, sf_dir, worded=True))


@query(f"""WITH {SPANS_SQL},
j AS (SELECT a.example_id, a.aspect, a.start, a."end", b.aspect AS ba, b.start AS bs, b."end" AS be,
    row_number() OVER (PARTITION BY a.example_id, a.aspect, a.start, a."end" ORDER BY CASE WHEN b.aspect = a.aspect THEN 0 ELSE 1 END, b.start, b."end") AS n FROM gold_spans a LEFT JOIN pred_spans b ON {_ANY}),
one AS (SELECT *, CASE WHEN ba IS NULL THEN 'false_negative' WHEN ba <> aspect THEN 'aspect_confusion' WHEN bs = start AND be = "end" THEN 'exact_match' WHEN be - bs > "end" - start THEN 'over_extension' ELSE 'under_extension' END AS kind FROM j WHERE n = 1),
off AS (SELECT * FROM one WHERE kind LIKE '%extension' AND abs(bs - start) + abs(be - "end") = 1),
k AS (SELECT kind FROM one UNION ALL SELECT 'off_by_one' FROM off
  UNION ALL SELECT 'prefix_error' FROM off JOIN tags t ON t.example_id = off.example_id AND t.pos = greatest(0, CASE WHEN bs < start THEN bs - 1 ELSE be END) WHERE substr(t.token, 1, 1) IN ('t', 'o', 'a')
  UNION ALL SELECT 'false_positive' FROM pred_spans a WHERE NOT EXISTS (SELECT 1 FROM gold_spans b WHERE {_ANY}))
SELECT kind, count(*) AS n, round(count(*) / CAST(CASE WHEN kind = 'false_positive' THEN (SELECT count(*) FROM pred_spans) ELSE (SELECT count(*) FROM gold_spans) END AS DOUBLE), 6) AS share FROM k GROUP BY kind""")
def error_taxonomy_b(spark, sf_dir):
    return M.errors_boundary(_scored(spark, sf_dir), "words", "toa", shares=True)


@query(f"""WITH {SPANS_SQL}, c AS (SELECT example_id, (SELECT count(*) FROM gold_spans g WHERE g.example_id = e.example_id) AS g, (SELECT count(*) FROM pred_spans p WHERE p.example_id = e.example_id) AS p FROM (SELECT DISTINCT example_id FROM tags) e)
SELECT CAST(sum(g) AS BIGINT) AS total_gold_spans, CAST(sum(p) AS BIGINT) AS total_pred_spans, round(avg(g) FILTER (WHERE g > 0), 6) AS avg_gold_per_positive, round(avg(p) FILTER (WHERE g > 0), 6) AS avg_pred_per_positive, count(*) FILTER (WHERE g > 0) AS n_positive_examples FROM c""")
def span_count_stats(spark, sf_dir):
    return M.span_counts(_scored(spark, sf_dir))


_STATS = f"""{_BOTH}, stats AS (SELECT example_id, {_COUNTS}, row_number() OVER (ORDER BY example_id) - 1 AS i FROM both_ GROUP BY example_id)"""


#: A hash draws for eight rounds; a draw's weight is the number of bounds up to it.
_DRAWS = f"""d AS (SELECT stats.*, b * {M.DRAWS} + j AS round_, CAST('0x' || substr(h, 4 * j + 1, 4) AS INTEGER) AS u
  FROM (SELECT *, md5('42|' || example_id || '|' || b) AS h FROM stats, (SELECT unnest(range({1000 // M.DRAWS})) AS b)) AS stats, (SELECT unnest(range({M.DRAWS})) AS j)),
w AS (SELECT *, {" + ".join(f"CAST(u >= {b} AS INTEGER)" for b in M.BOUNDS)} AS w FROM d),
f AS (SELECT round_, coalesce(SCORE, 0) AS f1 FROM w GROUP BY round_)
SELECT count(*) AS rounds, round(avg(f1), 6) AS mean, round(quantile_cont(f1, 0.025), 6) AS low, round(quantile_cont(f1, 0.975), 6) AS high FROM f"""


#: Each round draws as many examples as there are, each by a hash of its own, with replacement.
_RESAMPLED = """n AS (SELECT count(*) AS n FROM stats),
d AS (SELECT r AS round_, CAST('0x' || substr(md5('42|' || r || '|' || s), 1, 8) AS BIGINT) % n AS i FROM (SELECT unnest(range(1000)) AS r), (SELECT unnest(range(n)) AS s, n FROM n)),
f AS (SELECT round_, coalesce(SCORE, 0) AS f1 FROM d JOIN stats USING (i) GROUP BY round_)
SELECT count(*) AS rounds, round(avg(f1), 6) AS mean, round(quantile_cont(f1, 0.025), 6) AS low, round(quantile_cont(f1, 0.975), 6) AS high FROM f"""


@query(f"WITH {SPANS_SQL}, {_STATS}, {_RESAMPLED.replace('SCORE', '2 * sum(tp) / CAST(nullif(sum(n_pred) + sum(n_gold), 0) AS DOUBLE)')}")
def bootstrap_ci(spark, sf_dir):
    """The interval of exact F1 from 1000 rounds of as many draws as there are examples with a span."""
    rows = _scored(spark, sf_dir)
    return M.resampled_f1(M.example_counts(rows, "example_id"))


_RELAXED = f"""g AS (SELECT a.example_id, EXISTS (SELECT 1 FROM pred_spans b WHERE {_TOUCH}) AS hit, 1 AS is_gold FROM gold_spans a
  UNION ALL SELECT a.example_id, EXISTS (SELECT 1 FROM gold_spans b WHERE {_TOUCH}), 0 FROM pred_spans a),
each_ AS (SELECT example_id, sum(is_gold) AS n_gold, sum(1 - is_gold) AS n_pred, count(*) FILTER (WHERE hit AND is_gold = 1) AS gold_hit, count(*) FILTER (WHERE hit AND is_gold = 0) AS pred_hit FROM g GROUP BY example_id)"""


@query(f"""WITH {SPANS_SQL}, {_RELAXED}, stats AS (SELECT *, row_number() OVER (ORDER BY example_id) - 1 AS i FROM each_),
{_RESAMPLED.replace('SCORE', '(sum(gold_hit) + sum(pred_hit)) / CAST(nullif(sum(n_pred) + sum(n_gold), 0) AS DOUBLE)')}""")
def bootstrap_relaxed(spark, sf_dir):
    """The interval of the share of spans, gold and predicted, that touch one of their aspect."""
    rows = _scored(spark, sf_dir)
    return M.resampled_f1(M.relaxed_counts(rows, "example_id"), top=(("gold_hit", 1.0), ("pred_hit", 1.0)))


@query(f"""WITH stats AS (SELECT doc_id AS example_id, CAST(quality = 1 AND toxic = 1 AS INT) AS tp, toxic AS n_pred, quality AS n_gold FROM labels),
{_DRAWS.replace('SCORE', '2 * sum(w * tp) / CAST(nullif(sum(w * (n_pred + n_gold)), 0) AS DOUBLE)')}""")
def bootstrap_binary(spark, sf_dir):
    """The interval of a yes/no label's F1."""
    return M.bootstrap_f1(M.binary_counts(table(spark, sf_dir, "labels"), "doc_id", F.col("quality") == 1, F.col("toxic") == 1))


@query(f"""WITH {SPANS_SQL}, {_BOTH}, {_RELAXED}, x AS (SELECT 'm' || (example_id % 6) AS model, example_id % 2 AS side, round(2 * count(*) FILTER (WHERE g AND p) / CAST(nullif(count(*) FILTER (WHERE p) + count(*) FILTER (WHERE g), 0) AS DOUBLE), 6) AS f1 FROM both_ GROUP BY 1, 2),
s AS (SELECT 'm' || (example_id % 6) AS model, example_id % 2 AS side, sum(gold_hit) / CAST(nullif(sum(n_gold), 0) AS DOUBLE) AS r, sum(pred_hit) / CAST(nullif(sum(n_pred), 0) AS DOUBLE) AS p FROM each_ GROUP BY 1, 2),
y AS (SELECT model, side, round(2 * p * r / nullif(p + r, 0), 6) AS f1 FROM s)
SELECT model, max(x.f1) FILTER (WHERE side = 0) AS gold_exact, max(y.f1) FILTER (WHERE side = 0) AS gold_relaxed, max(x.f1) FILTER (WHERE side = 1) AS silver_exact, max(y.f1) FILTER (WHERE side = 1) AS silver_relaxed
FROM x JOIN y USING (model, side) WHERE model <> 'm5' GROUP BY model""")
def league_table(spark, sf_dir):
    """Models by their relaxed F1 on one test set, beside the other; even ids are the one, odd ones the other."""
    rows = _scored(spark, sf_dir).select("*", F.concat(F.lit("m"), F.col("example_id") % 6).alias("model"), (F.col("example_id") % 2).alias("side"))
    exact = M.example_counts(rows, "model", "side").groupBy("model", "side").agg(F.round(M.ratio(2 * F.sum("tp"), F.sum("n_pred") + F.sum("n_gold")), 6).alias("exact_f1"))
    hits = M.relaxed_counts(rows, "model", "side").groupBy("model", "side").agg(*[F.sum(n).alias(n) for n in ("n_gold", "n_pred", "gold_hit", "pred_hit")])
    each = exact.join(hits.select("model", "side", M.relaxed_scores()[2].alias("relaxed_f1")), ["model", "side"])  # a row for each model and set
    return M.league(each.where("side = 0"), each.where("side = 1"), ("m5",))


@query(f"WITH {G_SQL} SELECT gold AS label, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM tags GROUP BY gold")
def label_distribution(spark, sf_dir):
    return D.label_distribution(X.unnest(tags(spark, sf_dir), "gold", item="label"))


@query(f"WITH {SPANS_SQL} SELECT aspect, count(*) AS n_runs, (SELECT count(*) FROM tags WHERE gold = 'B-' || aspect) AS n_begin FROM gold_spans GROUP BY aspect")
def entity_counts(spark, sf_dir):
    return M.entity_counts(S.decode_lenient(tags(spark, sf_dir), "gold"), "gold")


_WEIGHT = f"""WITH {G_SQL}, l AS (SELECT unnest(n) AS label FROM names), c AS (SELECT label, (SELECT count(*) FROM tags WHERE gold = label) AS n, (SELECT count(*) FROM tags) AS total FROM l)
SELECT label, n, round(WEIGHT, 4) AS weight FROM c"""


@query(_WEIGHT.replace("WEIGHT", "least(20.0::DOUBLE, total / CAST(9 * greatest(n, 1) AS DOUBLE))"))
def class_weights(spark, sf_dir):
    return D.class_weights(X.unnest(tags(spark, sf_dir), "gold", item="label"), BIO, "capped")


@query(_WEIGHT.replace("WEIGHT", "sqrt(total / CAST(9 * greatest(n, 1) AS DOUBLE))"))
def class_weights_sqrt(spark, sf_dir):
    return D.class_weights(X.unnest(tags(spark, sf_dir), "gold", item="label"), BIO, "sqrt")


def _rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", (F.col("doc_id") % 97).alias("thread_id"), (F.col("toxic") == 1).alias("positive"))


_SPLIT = """rows_ AS (SELECT doc_id, doc_id % 97 AS thread_id, toxic = 1 AS positive FROM documents JOIN labels USING (doc_id)),
groups_ AS (SELECT thread_id, bool_or(positive) AS s FROM rows_ GROUP BY thread_id),
ranked AS (SELECT thread_id, s, row_number() OVER (PARTITION BY s ORDER BY md5('42|' || thread_id), thread_id) AS k, count(*) OVER (PARTITION BY s) AS n FROM groups_),
split_ AS (SELECT thread_id, CASE WHEN k <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM ranked)"""


@query(f"WITH {_SPLIT} SELECT doc_id, thread_id, split FROM rows_ JOIN split_ USING (thread_id)")
def stratified_split(spark, sf_dir):
    return D.stratified_split(_rows(spark, sf_dir), "thread_id", F.col("positive")).select("doc_id", "thread_id", "split")


@query("SELECT split_a, split_b, count(*) AS n_common FROM (SELECT DISTINCT o_custkey AS k, o_orderstatus AS split_a FROM orders) a JOIN (SELECT DISTINCT o_custkey AS k, o_orderstatus AS split_b FROM orders) b USING (k) WHERE split_a < split_b GROUP BY ALL")
def split_leakage(spark, sf_dir):
    return D.leakage(table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderstatus").alias("split")), "o_custkey")


@query("""WITH r AS (SELECT doc_id, toxic = 1 AS positive FROM labels), n AS (SELECT floor(count(*) FILTER (WHERE positive) * 2.0::DOUBLE) AS n FROM r),
k AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS k FROM r WHERE NOT positive)
SELECT doc_id FROM r WHERE positive UNION ALL SELECT doc_id FROM k, n WHERE k <= n""")
def downsample_negatives(spark, sf_dir):
    r = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("positive"))
    return D.downsample(r, F.col("positive"), 2.0, "doc_id").select("doc_id")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS k, count(*) OVER () AS n FROM labels) WHERE k <= greatest(1, floor(n * 0.3::DOUBLE))")
def data_fraction(spark, sf_dir):
    return D.fraction(table(spark, sf_dir, "labels").select("doc_id"), 0.3, "doc_id")


@query("SELECT doc_id, quality FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, quality FROM labels WHERE doc_id % 2 = 1 AND toxic = 0")
def merge_corpora(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    odd = rows.where("doc_id % 2 = 1").withColumn("vote", F.when(F.col("toxic") == 0, "Unanimous 3/3").otherwise("majority"))
    return D.merge(rows.where("doc_id % 2 = 0").select("doc_id", "quality"), odd.select("doc_id", "quality", "vote"), is_unanimous(F.col("vote"))).select("doc_id", "quality")


@query("""WITH u AS (SELECT doc_id, CAST('0x' || substr(md5('42|' || doc_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM documents)
SELECT doc_id, CASE WHEN u < 0.7 THEN 'O' WHEN u < 0.9 THEN 'B-QUANTITY' ELSE 'I-QUANTITY' END AS pred FROM u""")
def random_baseline(spark, sf_dir):
    return D.random_labels(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", [("O", 0.7), ("B-QUANTITY", 0.2), ("I-QUANTITY", 0.1)])


@query(f"""WITH {G_SQL}, c AS (SELECT example_id, count(*) FILTER (WHERE pred <> 'O') * 4 > count(*) AS yes FROM tags GROUP BY example_id),
s AS (SELECT t.example_id, t.pos, t.gold, CASE WHEN c.yes THEN t.pred ELSE 'O' END AS pred FROM tags t JOIN c USING (example_id))
SELECT round(count(*) FILTER (WHERE gold = pred) / CAST(count(*) AS DOUBLE), 6) AS accuracy, count(*) FILTER (WHERE pred <> 'O') AS n_tagged, (SELECT count(*) FROM c WHERE yes) AS n_yes FROM s""")
def two_step_pipeline(spark, sf_dir):
    """A classifier, here one that says yes where more than a quarter of the tags are in a span, gates the tagger: its no makes all of an example's tags O."""
    n = F.size(F.filter("pred", lambda t: t != "O"))
    rows = tags(spark, sf_dir).withColumn("yes", n * 4 > F.size("pred"))
    gated = rows.withColumn("pred", M.gate(F.col("yes"), F.col("pred")))
    right = F.size(F.filter(F.zip_with("gold", "pred", lambda g, p: g == p), lambda x: x))
    return gated.agg(
        F.round(M.ratio(F.sum(right), F.sum(F.size("gold"))), 6).alias("accuracy"),
        F.sum(F.size(F.filter("pred", lambda t: t != "O")).cast("long")).alias("n_tagged"), F.count_if(F.col("yes") & (F.size("gold") > 0)).alias("n_yes"),
    )


@query("""WITH e AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS v FROM events),
b AS (SELECT *, max(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, max(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS best FROM e),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR v > before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM b),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) - 1 AS since FROM i)
SELECT user_id, event_id, best, CAST(since AS INT) AS since, since >= 3 AS stopped FROM s""")
def early_stopping(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor("value").alias("v"))
    return D.early_stop(log, "user_id", "event_id", "v").select("user_id", "event_id", "best", "since", "stopped")


@query("""WITH f AS (SELECT l_returnflag, l_linestatus, round(avg(l_discount) * 10, 6) AS f1 FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linestatus, f1, CASE WHEN f1 >= 0.65 THEN 'GO — Labels are good' WHEN f1 >= 0.5 THEN 'GO — Labels are acceptable' WHEN f1 >= 0.35 THEN 'CONDITIONAL GO — Labels are noisy but usable' WHEN f1 >= 0.25 THEN 'CAUTION — Labels are weak' ELSE 'NO-GO — Labels are broken' END AS decision FROM f""")
def decision_ladder(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg("l_discount") * 10, 6).alias("f1"))
    return f.withColumn("decision", X.decision("f1"))


@query("SELECT l_orderkey, l_linenumber, round(-0.25 * pow(1 - p, 2) * ln(greatest(p, 1e-12)), 9) AS loss FROM (SELECT l_orderkey, l_linenumber, 0.5 + l_discount * 4 AS p FROM lineitem)")
def focal_loss(spark, sf_dir):
    p = (F.lit(0.5) + F.col("l_discount") * 4).alias("p")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", p).select("l_orderkey", "l_linenumber", F.round(X.focal_weight("p", 0.25, 2.0), 9).alias("loss"))
