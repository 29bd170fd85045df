"""Audits of labeled rows: coverage, rates, agreement and gates of PASS, WARN and FAIL."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.operators.metrics import ratio

_PASSES = ("out1", "out2", "out3")


def by_pass(rows: DataFrame, passes: Sequence[str] = _PASSES) -> DataFrame:
    """A row for each pass: ``pass, output`` beside the other columns."""
    each = F.array(*[F.struct(F.lit(k + 1).alias("pass"), F.col(p).alias("output")) for k, p in enumerate(passes)])
    return rows.withColumn("_p", F.explode(each)).select(*[c for c in rows.columns if c not in passes], F.col("_p.pass").alias("pass"), F.col("_p.output").alias("output"))


def coverage(rows: DataFrame) -> DataFrame:
    """Rows each pass has labeled, and for the third also those that it was skipped for."""
    return (
        by_pass(rows)
        .groupBy("pass")
        .agg(
            F.count("*").alias("n_rows"),
            F.count("output").alias("n_labeled"),
            F.count_if(F.col("output").isNotNull() | ((F.col("pass") == 3) & F.coalesce("pass3_skipped", F.lit(False)))).alias("n_effective"),
        )
    )


def label_stats(rows: DataFrame) -> DataFrame:
    """Positive rate and modifications of each pass, and the spread of the rates over passes."""
    mods = F.size("output.modifications")
    stats = (
        by_pass(rows)
        .where("output is not null")
        .groupBy("pass")
        .agg(F.count("*").alias("n_labeled"), F.count_if("output.has_modification").alias("n_positive"), F.coalesce(F.sum(mods), F.lit(0)).alias("n_modifications"))
    )
    rate = ratio("n_positive", "n_labeled")
    everything = Window.partitionBy()  # three rows
    return stats.withColumn("positive_rate", F.round(rate, 6)).withColumn("spread", F.round(F.max(rate).over(everything) - F.min(rate).over(everything), 6))


def hallucinations(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """Spans of each pass and aspect, and those that the text does not have."""
    passes = by_pass(rows.withColumn("_text", X.collapse(text_col))).where("output is not null")
    lost = X.let(F.col("_text"), lambda t: F.transform("output.modifications", lambda m: F.struct(m["aspect"].alias("aspect"), (~X.bare_occurs(m["span"], t)).alias("lost"))))
    mods = passes.select("pass", F.explode(lost).alias("m"))
    lost = F.col("m.lost")
    return mods.groupBy("pass", F.col("m.aspect").alias("aspect")).agg(F.count("*").alias("n_spans"), F.count_if(lost).alias("n_lost")).withColumn("rate", F.round(ratio("n_lost", "n_spans"), 6))


def samples(df: DataFrame, group: Sequence[str], order: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows of each group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def agreement_distribution(rows: DataFrame, columns: Sequence[str] = ("agreement_1v2", "agreement_1v3", "agreement_2v3"), levels: Sequence[str] = ("full", "partial", "none", "skipped")) -> DataFrame:
    """``pair, level, n, share``: only known levels count."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("pair"), F.col(c).alias("level")) for c in columns]))
    counts = rows.select(each.alias("p")).select("p.*").where(F.col("level").isin(*levels)).groupBy("pair", "level").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(ratio("n", F.sum("n").over(Window.partitionBy("pair"))), 6))


def agreement_rate(rows: DataFrame, column: str) -> DataFrame:
    """Share of full agreement where the pass was not skipped."""
    asked = F.col(column).isin("full", "partial", "none")
    return rows.agg(F.count_if(asked).alias("n_asked"), F.count_if(F.col(column) == "full").alias("n_full")).withColumn("rate", F.round(ratio("n_full", "n_asked"), 6))


def vote_stats(rows: DataFrame) -> DataFrame:
    """``vote_method, n, n_review, n_positive`` of voted rows (``vote_method, needs_review, has_modification``)."""
    return rows.groupBy("vote_method").agg(F.count("*").alias("n"), F.count_if("needs_review").alias("n_review"), F.count_if(F.coalesce("has_modification", F.lit(False))).alias("n_positive"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys of more than one row."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def missing_fields(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``field, n_missing, n_empty`` of text columns."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("v")) for c in columns]))
    return df.select(each.alias("f")).groupBy("f.field").agg(F.count_if(F.col("f.v").isNull()).alias("n_missing"), F.count_if(F.trim("f.v") == "").alias("n_empty"))


def gates(stats: DataFrame, rules: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """``section, level``: for each (section, fails, warns) over a table of one row FAIL, WARN or PASS."""
    each = F.array(*[F.struct(F.lit(s).alias("section"), F.when(f, "FAIL").when(w, "WARN").otherwise("PASS").alias("level")) for s, f, w in rules])
    return stats.select(F.explode(each).alias("g")).select("g.*")


def exit_status(report: DataFrame) -> int:
    """1 if any gate fails."""
    return int(report.where("level = 'FAIL'").limit(1).count() > 0)


def standard_gates(span_loss: Column, positive_rate: Column, final_rate: Column, agreement: Column, spread: Column) -> list[tuple[str, Column, Column]]:
    """The audit's limits: lost spans 15 and 5 %, positives 3 to 80 %, final ones 3 and 8 %, agreement 40 %, spread 20 points."""
    never = F.lit(False)
    # The limits.
    return [
        ("hallucination", span_loss > 0.15, span_loss > 0.05),
        ("positive_rate", never, (positive_rate < 0.03) | (positive_rate > 0.80)),
        ("final_rate", final_rate < 0.03, final_rate < 0.08),
        ("agreement", never, agreement < 0.40),
        ("spread", never, spread > 0.20),
    ]


def label_quality(rows: DataFrame) -> DataFrame:
    """One row on final labels: how many, positive ones, spans, aspects per positive, rows for review, spans dropped and labels flipped by the cleaning.

    ``rows`` has ``final_label``, ``needs_review`` and ``cleaned`` (of ``annotate.clean_spans``).
    """
    positive = F.coalesce("final_label.has_modification", F.lit(False))
    n = F.when(positive, F.size("final_label.modifications")).otherwise(0)
    return rows.agg(
        F.count("final_label").alias("n_labels"), F.count_if(positive).alias("n_positive"), F.sum(n).alias("n_spans"), F.count_if("needs_review").alias("n_review"),
        F.sum("cleaned.checked").alias("n_checked"), F.sum("cleaned.dropped").alias("n_dropped"), F.count_if("cleaned.flipped").alias("n_flipped"),
    ).withColumns({"positive_rate": F.round(ratio("n_positive", "n_labels"), 6), "spans_per_positive": F.round(ratio("n_spans", "n_positive"), 6)})


def corpus_leakage(a: DataFrame, b: DataFrame, group_col: str, positive: Column) -> DataFrame:
    """One row on two corpora: rows, distinct groups and positive rates of each, and groups that both have.

    Groups are counted once each by a group-by; no set of them is gathered.
    """
    rows = a.select(group_col, positive.alias("_p"), F.lit(True).alias("_a")).unionByName(b.select(group_col, positive.alias("_p"), F.lit(False).alias("_a")))
    n = lambda c: F.count_if(c)
    each = rows.groupBy(group_col).agg(n(F.col("_a")).alias("na"), n(~F.col("_a")).alias("nb"), n(F.col("_a") & F.col("_p")).alias("pa"), n(~F.col("_a") & F.col("_p")).alias("pb"))
    sums = each.agg(
        F.sum("na").alias("rows_a"), F.sum("nb").alias("rows_b"), n(F.col("na") > 0).alias("groups_a"), n(F.col("nb") > 0).alias("groups_b"),
        n((F.col("na") > 0) & (F.col("nb") > 0)).alias("groups_both"), F.sum("pa").alias("_pa"), F.sum("pb").alias("_pb"),
    )
    return sums.withColumns({"rate_a": F.round(ratio("_pa", "rows_a"), 6), "rate_b": F.round(ratio("_pb", "rows_b"), 6)}).drop("_pa", "_pb")


def most_common(df: DataFrame, col: str, n: int | None = None, order_col: str | None = None) -> DataFrame:
    """``value, n`` from the most frequent on; ties by first appearance in ``order_col``, else by value."""
    first = F.min(order_col or col).alias("_first")
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"), first).orderBy(F.desc("n"), "_first", "value").drop("_first")
    return counts.limit(n) if n is not None else counts


def label_report(labels: DataFrame, scheme: Mapping[str, int], missing: int = 99) -> DataFrame:
    """``label, id, n`` in the order of the scheme's ids, unknown labels (id ``missing``) last."""
    ids = F.create_map(*[F.lit(x) for kv in scheme.items() for x in kv])
    return labels.groupBy("label").agg(F.count("*").alias("n")).select("label", F.coalesce(F.try_element_at(ids, F.col("label")), F.lit(missing)).alias("id"), "n").orderBy("id", "label")


def eye_test(df: DataFrame, key_col: str, tokens_col: str, tags_col: str, n: int = 5, seed: str = "42") -> DataFrame:
    """A seeded sample of ``n`` rows, each with its tokens that have a tag, a line ``token -> tag`` each."""
    pairs = F.filter(F.zip_with(tokens_col, tags_col, lambda w, t: F.when(t != "O", F.concat(w, F.lit(" -> "), t))), lambda x: x.isNotNull())
    return df.orderBy(X.hash_order(key_col, seed), key_col).limit(n).select(key_col, F.array_join(pairs, "\n").alias("listing"))


def in_order_of_appearance(df: DataFrame, group_col: str, order_col: str) -> DataFrame:
    """Adds ``first_seen``, the smallest ``order_col`` of the row's group, by which groups sort in the order of their first rows."""
    first = df.groupBy(F.col(group_col).alias("_g")).agg(F.min(order_col).alias("first_seen"))
    return df.join(first, F.col(group_col).eqNullSafe(F.col("_g"))).drop("_g")


def serving_items(df: DataFrame, title_col: str, score_col: str) -> DataFrame:
    """``title`` (the first 120 characters) and ``percent`` (a rounded share) beside the other columns."""
    return df.withColumns({"title": F.substring(title_col, 1, 120), "percent": F.round(F.col(score_col) * 100).cast("int")})
