"""Evaluation of predicted spans and labels."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from spanloom.functions import text as X
from spanloom.operators.spans import decode_lenient, meeting
from spanloom.schemas import ASPECTS, IGNORE
from spanloom.storage import materialize

_KEY = "example_id"


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(X.col(a).cast("double"), X.col(b).cast("double")), F.lit(0.0))


def prf(tp: Column, n_pred: Column, n_gold: Column) -> list[Column]:
    """precision, recall and f1, rounded to six places."""
    p, r = ratio(tp, n_pred), ratio(tp, n_gold)
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1")]


def with_spans(tagged: DataFrame, decode: Callable[..., DataFrame] = decode_lenient) -> DataFrame:
    """``gold_spans`` and ``pred_spans`` beside the arrays of tags ``gold`` and ``pred``: the shape that the scores below take."""
    return decode(decode(tagged, "gold", "gold_spans"), "pred", "pred_spans")


def _keys(spans: Column | str, aspect: str | None = None) -> Column:
    """Spans as strings, which arrays can look up by hash."""
    spans = X.col(spans) if aspect is None else F.filter(spans, lambda s: s["aspect"] == aspect)
    return F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["end"], s["aspect"]))


def _three(g: Column, p: Column) -> list[Column]:
    return [F.size(F.array_intersect(g, p)).cast("long").alias("tp"), F.size(p).cast("long").alias("n_pred"), F.size(g).cast("long").alias("n_gold")]


def example_counts(df: DataFrame, *keep: str) -> DataFrame:
    """``tp, n_pred, n_gold`` of each row's exact spans, beside the columns ``keep``; row-local."""
    keyed = df.select(*keep, _keys("gold_spans").alias("_g"), _keys("pred_spans").alias("_p"))
    return keyed.select(*keep, *_three(F.col("_g"), F.col("_p")))


def _sums(*names: str) -> list[Column]:
    return [F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]


def exact_prf(df: DataFrame, by_aspect: bool = False, aspects: Sequence[str] = ASPECTS) -> DataFrame:
    """Micro precision, recall and F1 of exact spans, of all or of each aspect that occurs."""
    if not by_aspect:
        return example_counts(df).agg(*_sums("tp", "n_pred", "n_gold")).select("tp", "n_pred", "n_gold", *prf(F.col("tp"), F.col("n_pred"), F.col("n_gold")))
    each = F.array(*[F.struct(F.lit(a).alias("aspect"), *_three(_keys("gold_spans", a), _keys("pred_spans", a))) for a in aspects])
    counts = df.select(F.explode(each).alias("c")).select("c.*").groupBy("aspect").agg(*_sums("tp", "n_pred", "n_gold")).where("n_pred + n_gold > 0")
    return counts.select("aspect", "tp", "n_pred", "n_gold", *prf(F.col("tp"), F.col("n_pred"), F.col("n_gold")))


def averages(by_aspect: DataFrame) -> DataFrame:
    """Macro and (by gold spans) weighted averages of ``exact_prf(by_aspect=True)``, a row each."""
    names = ["precision", "recall", "f1"]
    macro = by_aspect.agg(*[F.round(F.avg(n), 6).alias(n) for n in names])
    weighted = by_aspect.agg(*[F.round(ratio(F.sum(F.col(n) * F.col("n_gold")), F.sum("n_gold")), 6).alias(n) for n in names])
    return macro.select(F.lit("macro").alias("average"), *names).unionByName(weighted.select(F.lit("weighted").alias("average"), *names))


def relaxed_counts(df: DataFrame, *keep: str) -> DataFrame:
    """``n_gold, n_pred, gold_hit, pred_hit`` of each row: hit is a span that shares a token with one of its aspect on the other side."""
    hits = lambda side: F.size(F.filter(side, lambda x: F.exists(x["met"], lambda c: c["aspect"] == x["s"]["aspect"]))).cast("long")
    n = lambda c: F.size(c).cast("long")
    return _met(df).select(*keep, n("gold_spans").alias("n_gold"), n("pred_spans").alias("n_pred"), hits("_gold").alias("gold_hit"), hits("_pred").alias("pred_hit"))


def relaxed_scores() -> list[Column]:
    p, r = ratio("pred_hit", "n_pred"), ratio("gold_hit", "n_gold")
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1")]


def relaxed_prf(df: DataFrame, by_aspect: bool = False) -> DataFrame:
    """Micro scores where a span counts that shares a token with one of its aspect on the other side, of all or of each aspect that occurs."""
    names = ("n_gold", "n_pred", "gold_hit", "pred_hit")
    if by_aspect:
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        hit = lambda x: F.exists(x["met"], lambda c: c["aspect"] == x["s"]["aspect"]).cast("long")
        of = lambda side, *n: F.transform(side, lambda x: F.struct(x["s"]["aspect"].alias("aspect"), *[v(x).alias(k) for k, v in zip(names, n)]))
        each = F.concat(of("_gold", lambda x: one, lambda x: none, hit, lambda x: none), of("_pred", lambda x: none, lambda x: one, lambda x: none, hit))
        return X.unnest(_met(df).withColumn("_x", each), "_x", item="x").select("x.*").groupBy("aspect").agg(*_sums(*names)).select("aspect", *names, *relaxed_scores())
    return relaxed_counts(df).agg(*_sums(*names)).select(*names, *relaxed_scores())


def token_scores(tagged: DataFrame) -> DataFrame:
    """Accuracy and macro precision, recall, F1 over the tags but O of the arrays ``gold`` and ``pred``."""
    pairs = tagged.select(F.explode(F.arrays_zip("gold", "pred")).alias("t")).groupBy("t.gold", "t.pred").agg(F.count("*").alias("n"))
    each = pairs.select("n", F.col("gold").alias("tag"), F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("np"), F.col("n").alias("ng")).unionByName(
        pairs.select("n", F.col("pred").alias("tag"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("np"), F.lit(0).cast("long").alias("ng"))
    )
    by_tag = each.where("tag != 'O'").groupBy("tag").agg(F.sum("tp").alias("tp"), F.sum("np").alias("np"), F.sum("ng").alias("ng"))
    p, r = ratio("tp", "np"), ratio("tp", "ng")
    macro = by_tag.select(p.alias("p"), r.alias("r"), ratio(2 * p * r, p + r).alias("f")).agg(
        *[F.round(F.coalesce(F.avg(x), F.lit(0.0)), 6).alias(n) for x, n in (("p", "precision"), ("r", "recall"), ("f", "f1"))]
    )
    accuracy = pairs.agg(F.round(ratio(F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)), F.sum("n")), 6).alias("accuracy"))
    return accuracy.join(macro)  # one row each


def token_accuracy(tagged: DataFrame) -> DataFrame:
    """``n_tokens, accuracy``: the share of tokens whose tags agree."""
    right = F.size(F.filter(F.zip_with("gold", "pred", lambda g, p: g == p), lambda same: same))
    return tagged.agg(F.sum(F.size("gold")).alias("n_tokens"), F.round(ratio(F.sum(right), F.sum(F.size("gold"))), 6).alias("accuracy"))


def _tally(df: DataFrame, kinds: Column) -> DataFrame:
    """``kind, n`` of arrays of kinds."""
    return df.select(F.explode_outer(kinds).alias("kind")).where("kind is not null").groupBy("kind").agg(F.count("*").alias("n"))


def _met(df: DataFrame) -> DataFrame:
    """``_gold`` and ``_pred``: each side's spans with those of the other side that they share a token with."""
    return meeting(meeting(df, "gold_spans", "pred_spans", "_gold"), "pred_spans", "gold_spans", "_pred")


_SIMPLE = ("correct", "false_negative", "span_boundary", "aspect_confusion", "false_positive")


@F.arrow_udf(StructType([StructField(k, LongType()) for k in _SIMPLE]))
def _simple_counts(gold: pa.Array, pred: pa.Array) -> pa.Array:
    """The kinds of each row's spans by number; both sides are in order and apart, so sorted searches over a whole batch find who meets whom."""
    sizes = [pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (gold, pred)]
    flat = [c.flatten() for c in (gold, pred)]
    start, end = ([pc.struct_field(c, k).to_numpy(zero_copy_only=False).astype(np.int64) for c in flat] for k in ("start", "end"))
    named = pa.chunked_array([pc.struct_field(c, "aspect") for c in flat]).combine_chunks().dictionary_encode(null_encoding="encode")
    aspect = np.split(named.indices.to_numpy(zero_copy_only=False).astype(np.int64), [len(start[0])])
    apart, row = 1 + max(int(e.max(initial=0)) for e in end), [np.repeat(np.arange(len(n)), n) for n in sizes]
    start, end = [s + r * apart for s, r in zip(start, row)], [e + r * apart for e, r in zip(end, row)]

    def stretch(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """From which to which of the other side's spans each span meets."""
        return np.searchsorted(end[b], start[a], "left"), np.searchsorted(start[b], end[a], "right")

    first, stop = stretch(0, 1)
    at = np.minimum(first, max(0, len(start[1]) - 1))  # a span that is the same is the first one met
    same = (first < stop) & (start[1][at] == start[0]) & (end[1][at] == end[0]) & (aspect[1][at] == aspect[0]) if len(start[1]) else np.zeros(len(first), bool)
    keys = np.sort(aspect[1] * (len(start[1]) + 1) + np.arange(len(start[1])))
    own = np.searchsorted(keys, aspect[0] * (len(start[1]) + 1) + stop) > np.searchsorted(keys, aspect[0] * (len(start[1]) + 1) + first)
    other_first, other_stop = stretch(1, 0)
    count = lambda side, which: np.bincount(row[side][which], minlength=len(sizes[0]))
    tp = count(0, same)
    missed = count(0, first == stop), count(0, ~same & own), count(0, ~same & ~own & (first < stop))
    right = (tp == sizes[0]) & (tp == sizes[1])
    return pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (right, *missed, count(1, other_first == other_stop))], list(_SIMPLE))


def errors_simple(df: DataFrame) -> DataFrame:
    """``kind, n``: examples that are right, and the kinds of wrong spans in the others. Rows are counted where they are; only sums are shuffled."""
    counts = df.select(_simple_counts("gold_spans", "pred_spans").alias("c")).agg(*[F.sum(F.col("c")[k]).alias(k) for k in _SIMPLE])
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in _SIMPLE])
    return X.unnest(counts.withColumn("_x", each), "_x", item="x").select("x.*").where("n > 0")


def errors_boundary(df: DataFrame, tokens_col: str | None = None, prefixes: str = "", shares: bool = False) -> DataFrame:
    """``kind, n``: exact, over- and under-extended (which includes shifted), off by one, prefix, confused, missed and extra spans.

    A gold span's partner is the first predicted one that shares a token with it, of its own
    aspect if there is one. A boundary error by one token counts as ``prefix_error``
    too where the token at the boundary (of the array ``tokens_col``) begins with one of ``prefixes``.
    With ``shares`` a column ``share`` tells the part of all gold spans (of all predicted ones for ``false_positive``).
    """
    rows = _met(df)
    order = lambda s, c: F.struct((c["aspect"] != s["aspect"]).alias("other"), c["start"].alias("start"), c["end"].alias("end"))
    pairs = F.transform("_gold", lambda x: F.struct(x["s"].alias("s"), F.array_min(F.transform(x["met"], lambda c: order(x["s"], c))).alias("p")))
    rows = rows.withColumn("_pairs", pairs)
    texts = F.col(tokens_col) if tokens_col else F.array().cast("array<string>")

    def kinds(x: Column, ws: Column) -> Column:
        s, p = x["s"], x["p"]
        off = F.abs(p["start"] - s["start"]) + F.abs(p["end"] - s["end"])
        kind = (
            F.when(p.isNull(), "false_negative").when(p["other"], "aspect_confusion").when(off == 0, "exact_match")
            .when(p["end"] - p["start"] > s["end"] - s["start"], "over_extension").otherwise("under_extension")
        )
        by_one = ~p["other"] & (off == 1)
        edge = F.greatest(F.lit(0), F.when(p["start"] < s["start"], p["start"] - 1).otherwise(p["end"]))
        letter = F.substring(F.get(ws, edge), 1, 1) if tokens_col and prefixes else F.lit(None).cast("string")
        return F.array(kind, F.when(by_one, "off_by_one"), F.when(by_one & letter.isin(*(prefixes or [""])), "prefix_error"))

    extra = F.transform(F.filter("_pred", lambda x: F.size(x["met"]) == 0), lambda s: F.lit("false_positive"))
    counts = _tally(rows, F.concat(F.flatten(X.let(texts, lambda ws: F.transform("_pairs", lambda x: kinds(x, ws)))), extra))
    if not shares:
        return counts
    total = df.agg(F.sum(F.size("gold_spans")).alias("_g"), F.sum(F.size("pred_spans")).alias("_p"))  # one row
    return counts.join(total).select("kind", "n", F.round(ratio("n", F.when(F.col("kind") == "false_positive", F.col("_p")).otherwise(F.col("_g"))), 6).alias("share"))


def span_counts(df: DataFrame) -> DataFrame:
    """Spans in all, and per example that has a gold span."""
    g, p = F.size("gold_spans"), F.size("pred_spans")
    return df.agg(
        F.coalesce(F.sum(g), F.lit(0)).alias("total_gold_spans"),
        F.coalesce(F.sum(p), F.lit(0)).alias("total_pred_spans"),
        F.round(F.coalesce(F.avg(F.when(g > 0, g)), F.lit(0.0)), 6).alias("avg_gold_per_positive"),
        F.round(F.coalesce(F.avg(F.when(g > 0, p)), F.lit(0.0)), 6).alias("avg_pred_per_positive"),
        F.count_if(g > 0).alias("n_positive_examples"),
    )


def entity_counts(df: DataFrame, tag_col: str = "tags", spans_col: str = "spans", aspects: Sequence[str] = ASPECTS) -> DataFrame:
    """``aspect, n_runs, n_begin``: spans, and ``B-`` tags, of each aspect that has a span; row-local counts are added up."""
    runs = lambda a: F.size(F.filter(spans_col, lambda s: s["aspect"] == a))
    begins = lambda a: F.size(F.filter(tag_col, lambda t: t == f"B-{a}"))
    each = F.array(*[F.struct(F.lit(a).alias("aspect"), runs(a).alias("r"), begins(a).alias("b")) for a in aspects])
    return df.select(F.explode(each).alias("c")).groupBy("c.aspect").agg(F.sum("c.r").alias("n_runs"), F.sum("c.b").alias("n_begin")).where("n_runs > 0")


def zipped(gold: Column, pred: Column, fill: str | None = None) -> Column:
    """(gold, pred) structs by place, cut to the shorter sequence, or with ``fill`` for missing predictions."""
    if fill is None:
        n = F.least(F.size(gold), F.size(pred))
        gold, pred = F.slice(gold, 1, n), F.slice(pred, 1, n)
    else:
        pred = F.slice(F.concat(pred, F.array_repeat(F.lit(fill), F.greatest(F.lit(0), F.size(gold) - F.size(pred)))), 1, F.size(gold))
    return F.zip_with(gold, pred, lambda g, p: F.struct(g.alias("gold"), p.alias("pred")))


def unmasked(labels: Column, tags: Column, ignore: int = IGNORE) -> Column:
    """The tags at places whose label id is not the ignored one."""
    return F.transform(F.filter(F.arrays_zip(labels.alias("l"), tags.alias("t")), lambda x: x["l"] != ignore), lambda x: x["t"])


def label_ids(tags: Column, scheme: Mapping[str, int], special: Column | None = None, ignore: int = IGNORE) -> Column:
    """Ids of tags, 0 for unknown ones, and the ignored id at places where ``special`` (an array of booleans) is true."""
    ids = F.create_map(*[F.lit(x) for kv in scheme.items() for x in kv])
    one = lambda t: F.coalesce(F.try_element_at(ids, t), F.lit(0))
    return F.transform(tags, one) if special is None else F.zip_with(tags, special, lambda t, s: F.when(s, ignore).otherwise(one(t)))


def label_names(ids: Column, scheme: Mapping[str, int]) -> Column:
    """Tags of label ids, ``O`` for unknown ones and for the ignored one."""
    names = F.create_map(*[F.lit(x) for k, v in scheme.items() for x in (v, k)])
    return F.transform(ids, lambda i: F.coalesce(F.try_element_at(names, i), F.lit("O")))


def has_label(ids: Column, ignore: int = IGNORE) -> Column:
    """Whether a sequence of label ids has any but 0 and the ignored one."""
    return F.exists(ids, lambda i: ~i.isin(0, ignore))


def against_gold(gold: DataFrame, silver: DataFrame, key: str) -> DataFrame:
    """Gold rows (``key, gold`` pairs) beside the teacher's pairs: ``key, gold, silver, matched``; no pairs where the teacher has no row."""
    other = silver.select(F.col(key).alias("_key"), "silver", F.lit(True).alias("_m"))
    joined = gold.join(other, F.col(key) == F.col("_key"), "left")
    none = F.array().cast("array<struct<span: string, aspect: string>>")
    return joined.select(key, "gold", F.coalesce("silver", none).alias("silver"), F.coalesce("_m", F.lit(False)).alias("matched"))


def unmatched(gold: DataFrame, silver: DataFrame, key: str) -> DataFrame:
    """Gold keys that the teacher has no row for."""
    return gold.select(key).join(silver.select(key), key, "left_anti")


def pair_scores(df: DataFrame, by_aspect: bool = False, aspects: Sequence[str] = ASPECTS) -> DataFrame:
    """Exact and relaxed scores of (span, aspect) pairs ``gold`` and ``silver``, of all or of each aspect that occurs.

    Exact pairs are counted as sets; relaxed ones greedily, by aspect and a common word. False positives count for their aspect.
    """
    key = lambda ps: F.array_distinct(F.transform(ps, lambda p: F.concat_ws("\x1f", p["aspect"], p["span"])))

    def counts(g: Column, s: Column) -> list[Column]:
        return [
            F.size(F.array_intersect(key(g), key(s))).alias("tp"), F.size(key(s)).alias("n_pred"), F.size(key(g)).alias("n_gold"),
            greedy_matches(g, s, share_word).alias("matches"), F.size(s).alias("pairs_pred"), F.size(g).alias("pairs_gold"),
        ]

    names = ["tp", "n_pred", "n_gold", "matches", "pairs_pred", "pairs_gold"]
    if by_aspect:
        of = lambda c, a: F.filter(c, lambda p: p["aspect"] == a)
        each = df.select(F.explode(F.array(*[F.struct(F.lit(a).alias("aspect"), *counts(of("gold", a), of("silver", a))) for a in aspects])).alias("c")).select("c.*")
        sums = each.groupBy("aspect").agg(*[F.sum(n).alias(n) for n in names]).where("pairs_pred + pairs_gold > 0")
    else:
        sums = df.select(*counts(F.col("gold"), F.col("silver"))).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    p, r = ratio("matches", "pairs_pred"), ratio("matches", "pairs_gold")
    relaxed = [F.round(p, 6).alias("relaxed_precision"), F.round(r, 6).alias("relaxed_recall"), F.round(ratio(2 * p * r, p + r), 6).alias("relaxed_f1")]
    return sums.select(*(["aspect"] if by_aspect else []), "tp", "n_pred", "n_gold", "matches", *prf(F.col("tp"), F.col("n_pred"), F.col("n_gold")), *relaxed)


def gate(yes: Column, tags: Column) -> Column:
    """A two-step pipeline's tags: all ``O`` where the first step says no, or nothing."""
    return F.when(F.coalesce(yes, F.lit(False)), tags).otherwise(F.transform(tags, lambda t: F.lit("O")))


def binary_label(tags: Column) -> Column:
    """Whether a sequence has any tag but ``O``."""
    return F.exists(tags, lambda t: t != "O")


def binary_counts(df: DataFrame, id_col: str, gold: Column, pred: Column) -> DataFrame:
    """``example_id, tp, n_pred, n_gold`` of a yes/no label, a row each, for a bootstrap."""
    g, p = F.coalesce(gold, F.lit(False)), F.coalesce(pred, F.lit(False))
    return df.select(F.col(id_col).alias("example_id"), (g & p).cast("int").alias("tp"), p.cast("int").alias("n_pred"), g.cast("int").alias("n_gold"))


def confusion(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Counts and scores of a yes/no label; rows with a null on either side count as no."""
    g, p = F.coalesce(gold, F.lit(False)), F.coalesce(pred, F.lit(False))
    c = df.agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))
    scores = prf(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn"))
    return c.select("tp", "fp", "fn", "tn", F.round(ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), 6).alias("accuracy"), *scores)


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two columns of categories: 1 where chance agreement is 1, 0 without rows."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    sides = cells.select(F.col("a").alias("c"), F.col("n").alias("x"), F.lit(0).cast("long").alias("y")).unionByName(cells.select(F.col("b").alias("c"), F.lit(0).cast("long").alias("x"), F.col("n").alias("y")))
    chance = sides.groupBy("c").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).agg(F.coalesce(F.sum(F.col("x").cast("double") * F.col("y")), F.lit(0.0)).alias("xy"))
    seen = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("same"))
    po, pe = ratio("same", "n"), ratio("xy", F.col("n").cast("double") * F.col("n"))
    k = F.when(F.col("n") == 0, 0.0).when(pe >= 1.0, 1.0).otherwise((po - pe) / F.when(pe < 1.0, 1 - pe))
    return seen.join(chance).select("n", F.round(po, 6).alias("observed"), F.round(pe, 6).alias("expected"), F.round(k, 6).alias("kappa"), X.kappa_word(F.round(k, 6)).alias("meaning"))


def set_f1(a: DataFrame, b: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Agreement of two annotators' sets of rows, F1 = 2 * common / (a + b)."""
    by = by or []
    both = a.select(*keys).distinct().withColumn("x", F.lit(1)).withColumn("y", F.lit(0)).unionByName(b.select(*keys).distinct().withColumn("x", F.lit(0)).withColumn("y", F.lit(1)))
    each = both.groupBy(*keys).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    sums = [F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("common"), F.coalesce(F.sum("x"), F.lit(0)).alias("n_a"), F.coalesce(F.sum("y"), F.lit(0)).alias("n_b")]
    got = each.groupBy(*by).agg(*sums) if by else each.agg(*sums)
    return got.select(*by, "common", "n_a", "n_b", F.round(ratio(2 * F.col("common"), F.col("n_a") + F.col("n_b")), 6).alias("f1"))


def greedy_matches(gold: Column, pred: Column, similar) -> Column:
    """How many of the ``gold`` array's structs find a partner of their own in ``pred``, in order, first come first served."""
    def matched(ps: Column) -> Column:
        free = lambda used, g: F.filter(F.sequence(F.lit(1), F.size(ps)), lambda j: similar(g, F.element_at(ps, j)) & ~F.array_contains(used, j))
        none = F.slice(F.array(F.lit(0)), 1, 0)
        return F.size(F.aggregate(gold, none, lambda used, g: F.concat(used, F.slice(free(used, g), 1, 1))))

    return F.when((F.size(gold) > 0) & (F.size(pred) > 0), X.let(pred, matched)).otherwise(0)


def share_word(a: Column, b: Column) -> Column:
    """Structs with ``span`` and ``aspect``: one aspect and a common lower-cased word."""
    return (a["aspect"] == b["aspect"]) & F.arrays_overlap(X.words(F.lower(a["span"])), X.words(F.lower(b["span"])))


def either_holds(a: Column, b: Column) -> Column:
    """Structs with ``span`` and ``aspect``: one aspect, and one span within the other."""
    return (a["aspect"] == b["aspect"]) & (F.contains(a["span"], b["span"]) | F.contains(b["span"], a["span"]))


def _poisson_bounds() -> np.ndarray:
    """Where the distribution function of Poisson(1) lies on a scale of 2 ** 16: a draw's weight is the number of bounds up to it."""
    found, upto, k = [], 0.0, 0
    while (bound := int(65536 * (upto := upto + math.exp(-1) / math.factorial(k)))) < 65536 and k < 8:
        found.append(bound)
        k += 1
    return np.array(found)


BOUNDS = _poisson_bounds()
#: Rounds whose draws come from one hash, and examples whose weights stand in memory at a time.
DRAWS, DRAWN = 8, 512


def draw_weights(keys: Sequence[str], rounds: int, seed: str) -> np.ndarray:
    """How often each example is drawn in each round: Poisson(1) by the hash of seed, example and round, examples x rounds."""
    blocks = -(-rounds // DRAWS)
    heads = [f"{seed}|{key}|".encode() for key in keys]
    tails = [str(k).encode() for k in range(blocks)]
    drawn = np.frombuffer(b"".join([hashlib.md5(h + t).digest() for h in heads for t in tails]), ">u2").reshape(len(keys), blocks * DRAWS)
    return np.searchsorted(BOUNDS, drawn[:, :rounds], "right")


def bootstrap_f1(
    stats: DataFrame, rounds: int = 1000, seed: str = "42", low: float = 0.025, high: float = 0.975,
    top: Sequence[tuple[str, float]] = (("tp", 2.0),), bottom: Sequence[str] = ("n_pred", "n_gold"),
) -> DataFrame:
    """Percentile interval of a micro F1 from the examples' sums (``example_id`` and whole counts; null counts are 0).

    The score of a round is the weighted sum of ``top`` over the sum of ``bottom``: 2 * tp / (n_pred + n_gold) by
    default. How often a round draws an example is Poisson(1) by a hash of both, the bootstrap's multinomial without its fixed total,
    so examples need no numbers and no order: each task adds all rounds' weighted sums up in one pass, and only those
    (rounds x counts for a task) are shuffled. Rows of one id are drawn together.
    """
    names = [*dict.fromkeys([n for n, _ in top] + list(bottom))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((rounds, len(names)), np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, DRAWN):
                part = batch.slice(k, DRAWN)
                counts = np.stack([part.column(1 + i).to_numpy() for i in range(len(names))], 1)
                sums += draw_weights(part.column(0).to_pylist(), rounds, seed).T @ counts
        yield pa.RecordBatch.from_arrays([pa.array(range(rounds), pa.int32()), *(pa.array(sums[:, i]) for i in range(len(names)))], ["round", *names])

    slim = stats.select(F.col(_KEY).cast("string").alias(_KEY), *[F.coalesce(F.col(n).cast("long"), F.lit(0).cast("long")).alias(n) for n in names])
    drawn = slim.mapInArrow(run, ", ".join(["round int", *(f"`{n}` long" for n in names)]))
    sums = drawn.groupBy("round").agg(*[F.sum(c).alias(c) for c in names])
    above, below = reduce(add, [F.col(c) * w for c, w in top]), reduce(add, [F.col(c) for c in bottom])
    return sums.select(ratio(above, below).alias("f1")).agg(
        F.count("*").alias("rounds"), F.round(F.avg("f1"), 6).alias("mean"),
        F.round(F.percentile("f1", F.lit(low)), 6).alias("low"), F.round(F.percentile("f1", F.lit(high)), 6).alias("high"),
    )


#: Examples whose sums every task of a resampling holds (as 32-bit numbers), and draws that stand in memory at a time.
HELD_EXAMPLES, SLOTS = 4_000_000, 4096


def _numbered(df: DataFrame, key: str) -> DataFrame:
    """Adds ``i``: gapless numbers from 0 by ``key``; sorted ranges are numbered side by side and moved by the rows before them."""
    ranges = df.repartitionByRange(key).select("*", F.spark_partition_id().alias("_k"))
    ranges = materialize(ranges, "ranges")  # so that numbers and sizes are of the same ranges
    sizes = sorted(ranges.groupBy("_k").agg(F.count("*").alias("n"), F.min(key).alias("least")).collect(), key=lambda r: r["least"])
    moved, at = [], 0
    for r in sizes:  # one row a partition
        moved.append((r["_k"], at))
        at += r["n"]
    offsets = df.sparkSession.createDataFrame(moved, "_k int, _at long")
    order = Window.partitionBy("_k").orderBy(key)
    return ranges.join(F.broadcast(offsets), "_k").withColumn("i", F.row_number().over(order) - 1 + F.col("_at")).drop("_k", "_at")


def resampled_f1(
    stats: DataFrame, rounds: int = 1000, seed: str = "42", low: float = 0.025, high: float = 0.975,
    top: Sequence[tuple[str, float]] = (("tp", 2.0),), bottom: Sequence[str] = ("n_pred", "n_gold"), held: int = HELD_EXAMPLES,
) -> DataFrame:
    """Percentile interval as ``bootstrap_f1`` gives it, by drawing with replacement: each round draws as many examples as there are.

    Examples without any count in ``bottom`` are left out; the others are numbered by id. A draw is the hash of seed, round and slot, the same in every
    engine. Up to ``held`` examples every task has their sums and adds its slots of all rounds up; beyond, draws and examples meet in a shuffle join.
    """
    names = [*dict.fromkeys([n for n, _ in top] + list(bottom))]
    above, below = reduce(add, [F.col(c) * w for c, w in top]), reduce(add, [F.col(c) for c in bottom])
    stats = materialize(stats.select(_KEY, *[F.coalesce(F.col(n).cast("long"), F.lit(0).cast("long")).alias(n) for n in names]), "bootstrap").where(below > 0)
    spark, n = stats.sparkSession, stats.count()
    numbered = _numbered(stats, _KEY).select("i", *names)
    if n > held:
        draws = spark.range(rounds * n).select((F.col("id") / n).cast("long").alias("round"), (F.col("id") % n).alias("slot"))
        drawn = draws.select("round", X.hash_index(F.concat_ws("|", "round", "slot"), n, seed).alias("i")).join(numbered, "i")
    else:
        sums = np.zeros((n, len(names)), np.int32)
        for batch in numbered.toArrow().to_batches():  # ``held`` rows at most
            sums[batch.column(0).to_numpy()] = np.stack([c.to_numpy() for c in batch.columns[1:]], 1)
        shared, kind = spark.sparkContext.broadcast(sums), ", ".join(["round long", *(f"`{c}` long" for c in names)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            examples, found = shared.value, np.zeros((rounds, len(names)), np.int64)
            for first in (k * SLOTS for batch in batches for k in batch.column(0).to_pylist()):
                tails = [str(s).encode() for s in range(first, min(n, first + SLOTS))]
                for r in range(rounds):
                    head = f"{seed}|{r}|".encode()
                    drawn = np.frombuffer(b"".join([hashlib.md5(head + t).digest() for t in tails]), ">u4")[::4] % n
                    found[r] += examples[drawn].sum(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(range(rounds), pa.int64()), *(pa.array(found[:, j]) for j in range(len(names)))], ["round", *names])

        blocks = -(-n // SLOTS)
        drawn = spark.range(0, blocks, 1, max(1, min(blocks, spark.sparkContext.defaultParallelism * 4))).mapInArrow(run, kind) if n else spark.createDataFrame([], kind)
    sums = drawn.groupBy("round").agg(*[F.sum(c).alias(c) for c in names])
    return sums.select(ratio(above, below).alias("f1")).agg(
        F.count("*").alias("rounds"), F.round(F.avg("f1"), 6).alias("mean"),
        F.round(F.percentile("f1", F.lit(low)), 6).alias("low"), F.round(F.percentile("f1", F.lit(high)), 6).alias("high"),
    )


def league(gold: DataFrame, silver: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Results (``model, exact_f1, relaxed_f1``) of two test sets side by side, best relaxed F1 on gold first, missing ones as 0."""
    g = gold.select("model", F.col("exact_f1").alias("gold_exact"), F.col("relaxed_f1").alias("gold_relaxed"))
    s = silver.select("model", F.col("exact_f1").alias("silver_exact"), F.col("relaxed_f1").alias("silver_relaxed"))
    return g.join(s, "model", "full").where(~F.col("model").isin(*exclude) if exclude else F.lit(True)).orderBy(F.coalesce("gold_relaxed", F.lit(0.0)).desc(), "model")
