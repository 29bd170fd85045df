"""Queries of trained taggers, sub-word rows, stored pages, streams with state and versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.operators import align as L
from spanloom.operators import metrics as M
from spanloom.operators import models as D
from spanloom.operators import spans as S
from spanloom.operators import subwords as W
from spanloom.operators import taggers as T
from spanloom.operators import threads as R
from spanloom.plans.adapters import B_SQL, K_SQL, SPANS_SQL, T_SQL, located, table, tags, threads, tokens
from spanloom.schemas import BIO

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# Spans of one and two words

@query("""WITH w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark),
s AS (SELECT item_id, n_words, array_to_string(w[1:n_words], ' ') AS span FROM (SELECT item_id, w, unnest([1, 2]) AS n_words FROM w) WHERE len(w) >= n_words)
SELECT item_id, CAST(n_words AS INT) AS n_words, count(*) AS n_texts FROM s JOIN documents d ON contains(d.text, s.span) WHERE s.span <> '' GROUP BY item_id, n_words""")
def span_index_short(spark, sf_dir):
    """How many documents hold the first word of each benchmark text, and the first two, inside words too."""
    w = table(spark, sf_dir, "benchmark").select("item_id", F.split("text", " ", -1).alias("w"))
    spans = w.select("item_id", "w", F.explode(F.array(F.lit(1), F.lit(2))).alias("n_words")).where("size(w) >= n_words")
    spans = spans.select("item_id", "n_words", F.array_join(F.slice("w", 1, F.col("n_words")), " ").alias("span"))
    return L.find_spans(table(spark, sf_dir, "documents"), spans, "doc_id", "text").groupBy("item_id", "n_words").agg(F.count("*").alias("n_texts"))


#: Every third span is one that no text has; tokens are the first 128 words.
@query(f"""WITH {K_SQL}, {B_SQL}, last AS (SELECT example_id, max("end") AS last FROM toks WHERE pos < 128 GROUP BY example_id),
s AS MATERIALIZED (SELECT f.example_id, item_id, CASE WHEN item_id % 3 = 2 THEN '0 ' || span || ' 0' ELSE span END AS span, instr(text, span) - 1 AS start, instr(text, span) - 1 + length(span) AS stop, item_id % 3 = 2 AS lost, last FROM found f LEFT JOIN last l ON f.example_id = l.example_id),
own AS MATERIALIZED (SELECT DISTINCT example_id, item_id FROM (SELECT t.example_id, t.pos, min(s.item_id) AS item_id FROM s JOIN toks t ON t.example_id = s.example_id WHERE NOT lost AND t.pos < 128 AND t.start < s.stop AND t."end" > s.start GROUP BY t.example_id, t.pos))
SELECT s.example_id, s.span, 'QUANTITY' AS aspect, CASE WHEN lost THEN 'not_found' WHEN start >= last THEN 'truncated' ELSE 'no_token' END AS reason
FROM s LEFT JOIN own ON own.example_id = s.example_id AND own.item_id = s.item_id WHERE own.item_id IS NULL""")
def alignment_failures(spark, sf_dir):
    """The spans that alignment to a window of 128 words fails, and why."""
    span = F.when(F.col("item_id") % 3 == 2, F.concat(F.lit("0 "), "span", F.lit(" 0"))).otherwise(F.col("span"))
    mods = F.transform(F.array_sort(F.collect_list(F.struct("item_id", span.alias("span"), F.lit("QUANTITY").alias("aspect")))), lambda m: F.struct(m["span"].alias("span"), m["aspect"].alias("aspect")))
    rows = located(spark, sf_dir).groupBy(F.col("example_id").alias("doc_id")).agg(mods.alias("modifications"))
    docs = tokens(spark, sf_dir, 128)
    return W.failed_spans(W.align_examples(docs.join(rows, docs["example_id"] == F.col("doc_id"))), "example_id")


_TOUCH = 'a.example_id = b.example_id AND a.aspect = b.aspect AND a.start <= b."end" AND a."end" >= b.start'


@query(f"""WITH {SPANS_SQL}, g AS (SELECT aspect, count(*) AS n_gold, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM pred_spans b WHERE {_TOUCH})) AS gold_hit FROM gold_spans a GROUP BY aspect),
p AS (SELECT aspect, count(*) AS n_pred, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM gold_spans b WHERE {_TOUCH})) AS pred_hit FROM pred_spans a GROUP BY aspect),
s AS (SELECT aspect, coalesce(n_gold, 0) AS n_gold, coalesce(n_pred, 0) AS n_pred, coalesce(gold_hit, 0) AS gold_hit, coalesce(pred_hit, 0) AS pred_hit, coalesce(pred_hit / CAST(n_pred AS DOUBLE), 0) AS p, coalesce(gold_hit / CAST(n_gold AS DOUBLE), 0) AS r FROM g FULL JOIN p USING (aspect))
SELECT aspect, n_gold, n_pred, gold_hit, pred_hit, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM s""")
def relaxed_prf_by_aspect(spark, sf_dir):
    return M.relaxed_prf(M.with_spans(tags(spark, sf_dir)), by_aspect=True)


@query("SELECT lang, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY lang")
def gold_semi_join(spark, sf_dir):
    """Documents that gold has, by language."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT vendor_id, CAST(to_json({'vendor_id': vendor_id, 'name': name, 'nation_id': nation_id}) AS VARCHAR) AS record FROM vendors")
def json_records(spark, sf_dir):
    """Rows as JSON objects, nulls included."""
    return table(spark, sf_dir, "vendors").select("vendor_id", F.to_json(F.struct("vendor_id", "name", "nation_id"), {"ignoreNullFields": "false"}).alias("record"))


@query("""SELECT client_id, city, segment FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY seq DESC, change_id DESC) AS n FROM client_changes WHERE client_id IS NOT NULL) WHERE n = 1""")
def last_change(spark, sf_dir):
    """Each client's last change."""
    rows = table(spark, sf_dir, "client_changes").where("client_id IS NOT NULL").withColumn("at", F.struct("seq", "change_id"))
    return R.last_wins(rows, "client_id", "at").select("client_id", "city", "segment")


@query(f"""WITH {T_SQL}, top AS (SELECT *, CASE WHEN conv_id % 5 = 0 THEN 'c' || conv_id % 7 ELSE 'u' END AS author FROM turns WHERE k = 0),
kept AS (SELECT * FROM top WHERE author <> 'c' || conv_id % 7 AND len(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '')) >= 3 AND regexp_matches(text, '[a-z]') AND NOT contains(lower(text), 'http')),
r AS (SELECT t.conv_id, count(*) AS n, bool_or(t.creator) AS creator, sum(t.likes) AS likes FROM turns t WHERE t.k > 0 AND (t.creator OR (regexp_matches(t.text, '[a-z]') AND NOT contains(lower(t.text), 'http'))) GROUP BY t.conv_id)
SELECT kept.conv_id || '_' || kept.turn AS thread_id, coalesce(r.n, 0) AS n_replies, coalesce(r.creator, false) AS has_creator_reply, CAST(kept.likes + coalesce(r.likes, 0) AS BIGINT) AS total_likes FROM kept LEFT JOIN r ON r.conv_id = kept.conv_id""")
def api_threads(spark, sf_dir):
    """Conversations in the service's nested form, parsed to threads; every fifth is its channel's own and dropped."""
    own = F.col("channel_id")
    comment = lambda c, author: F.struct(c["comment_id"].alias("id"), F.struct(c["text"].alias("textDisplay"), c["like_count"].alias("likeCount"), F.struct(author.alias("value")).alias("authorChannelId")).alias("snippet"))
    rows = threads(spark, sf_dir)
    by = F.when(F.col("thread_id") % 5 == 0, own).otherwise("u")
    items = rows.select(
        "channel_id", F.struct(comment(F.col("top_comment"), by).alias("topLevelComment")).alias("snippet"),
        F.struct(F.transform("replies", lambda r: comment(r, F.when(r["is_creator"], own).otherwise("u"))).alias("comments")).alias("replies"),
    )
    parsed = R.parse_items(items, spam=("http",), script=(ord("a"), ord("z")))
    return parsed.select("thread_id", F.size("replies").cast("long").alias("n_replies"), "has_creator_reply", F.col("total_likes").cast("long").alias("total_likes"))


@query("""WITH s AS (SELECT source, count(*) / CAST((SELECT count(*) FROM documents) AS DOUBLE) AS share FROM documents GROUP BY source)
SELECT source, format('{:.1f}%', share * 100) AS share, format('{:.1f} [{:.1f}, {:.1f}]', share * 100, share * 50, share * 200) AS interval FROM s""")
def share_texts(spark, sf_dir):
    """Shares of sources as text, alone and as if with an interval."""
    total = F.sum("n").over(Window.partitionBy())
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / total)
    return rows.select("source", X.percent_text("share").alias("share"), X.interval_text("share", F.col("share") / 2, F.col("share") * 2).alias("interval"))


@query("SELECT c_custkey, 'UU' || substr(c_name, 3) AS playlist FROM customer")
def upload_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", R.uploads_playlist(F.col("c_name")).alias("playlist"))


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, [l_quantity / 10, l_discount * 50, l_tax * 50]::DOUBLE[] AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(list_position(v, list_max(v)) - 1 AS BIGINT) AS best, round(1 / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))), 6) AS chance FROM e""")
def score_chances(spark, sf_dir):
    """The first largest of three scores, and its probability."""
    scores = F.array(*[c.cast("double") for c in (F.col("l_quantity") / 10, F.col("l_discount") * 50, F.col("l_tax") * 50)])
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scores.alias("v"))
    return rows.select("l_orderkey", "l_linenumber", D.argmax("v").cast("long").alias("best"), F.round(F.array_max(D.softmax("v")), 6).alias("chance"))


# Stored pages

#: Paragraphs of an article end at their own end, at the next one's beginning or with the article.
@query(r"""WITH a AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1) AS body FROM pages),
p AS (SELECT page_id, unnest(string_split(body, '<p>')[2:]) AS part, unnest(range(len(string_split(body, '<p>')) - 1)) AS ord FROM a),
t AS (SELECT page_id, ord, regexp_replace(replace(string_split(part, '</p>')[1], '<br>', chr(10)), '<[^>]*>', '', 'g') AS text FROM p),
d AS (SELECT page_id, ord, trim(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), chr(32) || chr(10)) AS text FROM t)
SELECT page_id, CAST(ord AS INT) AS ord, text FROM d WHERE length(text) > 10""")
def page_comments(spark, sf_dir):
    """The paragraphs of stored pages' articles, in their order."""
    from spanloom.sources.pages import page_comments

    return page_comments(table(spark, sf_dir, "pages"), "page_id", "html")


# Training rows and taggers

@query()
def subword_rows(spark, sf_dir):
    """Documents as a model's rows over a public tokenizer: ids, mask, types and labels, cut and padded to 128 tokens."""
    import public_tokenizers

    pad = "<|endoftext|>"
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("example_id"), "text")
    found = located(spark, sf_dir).groupBy(F.col("example_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("span", F.lit("QUANTITY").alias("aspect")))).alias("modifications"))
    rows = docs.join(found, docs["example_id"] == F.col("doc_id"), "left").drop("doc_id")
    rows = rows.withColumn("modifications", F.coalesce("modifications", F.array().cast("array<struct<span: string, aspect: string>>")))
    rows = W.encode(rows, "text", W.from_file(public_tokenizers.path("byte_bpe_50k.json"), 128, pad_id=50256, pad_token=pad))
    made = W.align_examples(rows)
    return made.select("example_id", "aligned", "truncated", *W.model_columns("tokens", F.col("tags"), BIO, pad))


ENDINGS = (("SUBSTITUTION", "ion"), ("QUANTITY", "ent"), ("TECHNIQUE", "ung"), ("ADDITION", "dad"))


def sentences(spark, sf_dir) -> DataFrame:
    """Sentences of all documents as posts: words, and gold tags by what words end with; a short word behind belongs to the span."""
    docs = table(spark, sf_dir, "documents").repartition("doc_id").select("doc_id", F.posexplode(F.split("text", r"(?<=[.!?])\s+|\n")).alias("k", "post"))
    docs = docs.where(F.rlike("post", F.lit(r"(?U)\S")))  # those with words, which a filter on the words would split twice
    rows = docs.select("doc_id", F.concat_ws("-", "doc_id", "k").alias("example_id"), "post", L.words("post").alias("words"))
    bare = lambda w: F.regexp_replace(w, r"[^\p{L}]+$", "")
    aspect = lambda w: F.coalesce(*[F.when(F.endswith(bare(w), F.lit(e)), F.lit(a)) for a, e in ENDINGS])
    own = F.transform("words", aspect)
    rows = rows.withColumn("_own", own).withColumn("_before", F.slice(F.concat(F.array(F.lit(None).cast("string")), "_own"), 1, F.size("_own")))
    tag = lambda x: F.when(x["_own"].isNotNull(), F.concat(F.lit("B-"), x["_own"])).when(x["_before"].isNotNull() & (F.length(x["words"]) < 4), F.concat(F.lit("I-"), x["_before"])).otherwise("O")
    return rows.withColumn("gold", F.transform(F.arrays_zip("words", "_own", "_before"), tag)).drop("_own", "_before")


def tagger_scores(spark, sf_dir, train) -> DataFrame:
    """Entity scores on a fifth of the documents of a model that is trained on the others, beside the keyword tagger's."""
    names = list(BIO)
    rows = sentences(spark, sf_dir)
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    model = train(rows.where(~held_out), "example_id", "words", "gold", names)
    test = rows.where(held_out)
    mine = M.exact_prf(M.with_spans(T.tag_words(test, model, "words", names)), by_aspect=True).withColumn("model", F.lit("trained"))
    spans = L.tokenize(test, "post", "tokens").withColumn("spans", L.keyword_spans("post", {a: [e] for a, e in ENDINGS}))
    keywords = M.exact_prf(M.with_spans(L.align(spans, "tokens", "spans", "BIO", "pred")), by_aspect=True).withColumn("model", F.lit("keywords"))
    return mine.unionByName(keywords)


@query()
def crf_tagger(spark, sf_dir):
    return tagger_scores(spark, sf_dir, T.train_crf)


@query()
def perceptron_tagger(spark, sf_dir):
    return tagger_scores(spark, sf_dir, T.train_perceptron)


# Streams with state, versioned tables

@query()
def stream_keyed_state(spark, sf_dir):
    """Clicks by kind, read as a stream of files whose repeated rows the keyed state leaves out, in a versioned table."""
    from spanloom.sources.versioned import VersionedTable
    from spanloom.storage import new_folder
    from spanloom.streaming.ingest import first_of_keys, start_keyed

    base, clicks = new_folder(spark, "keyed-stream"), table(spark, sf_dir, "clicks")
    clicks.repartitionByRange(6, "arrived_at").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(clicks.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    out = VersionedTable(spark, f"{base}/out", "click_id", 8)
    start_keyed(first_of_keys(stream, "click_id"), out, "clicks", f"{base}/checkpoint").awaitTermination()
    return out.read().groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("click_id").alias("n_keys"))


@query()
def merged_changes(spark, sf_dir):
    """Clients after their changes were merged into a versioned table, in four batches by time, the last of which comes twice."""
    from spanloom.sources.versioned import VersionedTable
    from spanloom.storage import new_folder

    out = VersionedTable(spark, f"{new_folder(spark, 'merged')}/clients", "client_id", 16)
    changes = table(spark, sf_dir, "client_changes").where("client_id IS NOT NULL").withColumn("at", F.struct("seq", "change_id"))
    quarter = F.floor(F.col("seq") * 4 / (F.lit(changes.agg(F.max("seq")).first()[0] or 0) + 1))
    for k in (0, 1, 2, 3, 3):
        out.merge(changes.where(quarter == k).select("client_id", "source", "segment", "city", "balance", "at"), "at", batch=("changes", k))
    return out.read().select("client_id", "source", "segment", "city", "balance")
