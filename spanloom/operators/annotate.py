"""Annotator outputs: parsing, agreement, majority vote and span cleaning.

Outputs are structs (``has_modification``, ``thread_type``, ``modifications``) of
one row; null says that a pass was not run. Everything is row-local.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.operators.datasets import first_examples
from spanloom.schemas import ANNOTATION, ASPECTS, THREAD_TYPES



def json_text(raw: Column | str) -> Column:
    """The JSON in an annotator's answer: the whole, a fenced block, the outermost array or object; else null."""
    text = X.strip(raw)
    bare = X.strip(F.regexp_replace(F.regexp_replace(text, r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))
    candidates = [text, bare, F.regexp_extract(bare, r"(?s)\[.*\]", 0), F.regexp_extract(bare, r"(?s)\{.*\}", 0)]
    return F.coalesce(*[F.when((c != "") & F.try_parse_json(c).isNotNull(), c) for c in candidates])


def sanitize(json: Column) -> Column:
    """An annotation struct from a JSON object: aspects checked, spans stripped, confidence clamped, the flag recomputed; else null."""
    raw = F.from_json(
        json,
        "struct<thread_type: string, modifications: array<struct<span: string, aspect: string, source_comment: string, confidence: string>>>",
    )
    kept = F.filter(
        F.transform(
            raw["modifications"],
            lambda m: F.struct(
                X.strip(F.coalesce(m["span"], F.lit(""))).alias("span"),
                F.upper(X.strip(F.coalesce(m["aspect"], F.lit("")))).alias("aspect"),
                F.coalesce(m["source_comment"], F.lit("top")).alias("source_comment"),
                F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(m["confidence"].try_cast("double"), F.lit(0.5)))).alias("confidence"),
            ),
        ),
        lambda m: (m["span"] != "") & m["aspect"].isin(*ASPECTS),
    )
    kept = F.coalesce(kept, F.from_json(F.lit("[]"), "array<struct<span: string, aspect: string, source_comment: string, confidence: double>>"))
    kind = F.when(raw["thread_type"].isin(*THREAD_TYPES), raw["thread_type"]).otherwise("statement")
    is_object = json.isNotNull() & F.startswith(X.strip(json), F.lit("{"))
    made = F.struct((F.size(kept) > 0).alias("has_modification"), kind.alias("thread_type"), kept.alias("modifications"))
    return F.when(is_object, made).otherwise(F.lit(None).cast(ANNOTATION))


def match_batch(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers (``batch, pos, thread_id, answer``) put to requests (``batch, pos, thread_id``): by place where a batch has as many, else by id."""
    n_req = requests.groupBy("batch").agg(F.count("*").alias("n_req"))
    n_ans = answers.groupBy("batch").agg(F.count("*").alias("n_ans"))
    sizes = n_req.join(n_ans, "batch", "left").select("batch", (F.col("n_req") == F.coalesce("n_ans", F.lit(0))).alias("by_place"))
    asked = requests.join(sizes, "batch")
    key = lambda d: F.when(F.col("by_place"), F.col("pos").cast("string")).otherwise(F.col("thread_id").cast("string"))
    left = asked.withColumn("_key", key(asked))
    right = answers.join(sizes, "batch")
    right = right.withColumn("_key", key(right)).groupBy("batch", "_key").agg(F.max_by("answer", "pos").alias("answer"))
    return left.join(right, ["batch", "_key"], "left").select("batch", "pos", "thread_id", "answer")


def aspect_set(out: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(out["modifications"], lambda m: m["aspect"])))


def agreement(a: Column, b: Column) -> Column:
    """full, partial, none; error where a pass is missing."""
    return X.let(F.struct(a.alias("a"), b.alias("b")), lambda p: _agreement(p["a"], p["b"]))


def _agreement(a: Column, b: Column) -> Column:
    x, y = aspect_set(a), aspect_set(b)
    return (
        F.when(a.isNull() | b.isNull(), "error")
        .when(a["has_modification"] != b["has_modification"], "none")
        .when(~a["has_modification"], "full")
        .when(x == y, "full")
        .when(F.arrays_overlap(x, y), "partial")
        .otherwise("none")
    )


def can_skip_third(a: Column, b: Column) -> Column:
    """Whether the first two passes agree in full, so that no third one is needed."""
    return F.coalesce(a.isNotNull() & b.isNotNull() & (agreement(a, b) == "full"), F.lit(False))


def _empty(kind: Column) -> Column:
    none = F.from_json(F.lit("[]"), "array<struct<span: string, aspect: string, source_comment: string, confidence: double>>")
    return F.struct(F.lit(False).alias("has_modification"), kind.alias("thread_type"), none.alias("modifications"))


def _mode(kinds: Sequence[Column]) -> Column:
    """The most frequent of up to three values, the earliest on ties; nulls do not count."""
    n = [reduce(lambda a, b: a + b, [F.when(k == other, 1).otherwise(0) for other in kinds]) for k in kinds]
    most = F.greatest(*[F.coalesce(F.when(k.isNotNull(), x), F.lit(0)) for k, x in zip(kinds, n)])
    return F.coalesce(*[F.when(k.isNotNull() & (x == most), k) for k, x in zip(kinds, n)])


def vote(a: Column, b: Column, c: Column, skipped: Column) -> Column:
    """Majority of three passes: ``final, method, needs_review, true_votes, false_votes, agreement_1v2, agreement_1v3, agreement_2v3``.

    The passes are computed once, however often the rules look at them.
    """
    passes = F.struct(a.alias("a"), b.alias("b"), c.alias("c"), skipped.alias("skipped"))
    return X.let(passes, lambda p: _vote(p["a"], p["b"], p["c"], p["skipped"]))


def _vote(a: Column, b: Column, c: Column, skipped: Column) -> Column:
    outs = [a, b, c]
    given = reduce(lambda x, y: x + y, [F.when(o.isNotNull(), 1).otherwise(0) for o in outs])
    yes = reduce(lambda x, y: x + y, [F.when(F.coalesce(o["has_modification"], F.lit(False)), 1).otherwise(0) for o in outs])
    no = given - yes
    size = lambda o: F.when(F.coalesce(o["has_modification"], F.lit(False)), F.size(o["modifications"])).otherwise(-1)
    most = F.greatest(*[size(o) for o in outs])
    richest = F.coalesce(*[F.when((size(o) == most) & (most >= 0), o) for o in outs])
    negative_kind = _mode([F.when(~o["has_modification"], o["thread_type"]) for o in outs])
    pair = F.coalesce(skipped, F.lit(False)) & c.isNull() & a.isNotNull() & b.isNotNull()
    few = given < 2
    final = (
        F.when(pair & a["has_modification"], a)
        .when(pair, _empty(_mode([a["thread_type"], b["thread_type"]])))
        .when(few, F.coalesce(*outs))
        .when(yes >= 2, richest)
        .when(no >= 2, _empty(negative_kind))
        .otherwise(F.coalesce(*outs))
    )
    alike = (aspect_set(a) == aspect_set(b)) & (aspect_set(b) == aspect_set(c))
    method = (
        F.when(pair, "gemini_unanimous")
        .when(few, "insufficient")
        .when((yes == 3) & alike, "unanimous")
        .when(no == 3, "unanimous")
        .when((yes >= 2) | (no >= 2), "majority")
        .otherwise("no_majority")
    )
    on = lambda x, y: F.when(few, "error").otherwise(agreement(x, y))
    return F.struct(
        final.alias("final"),
        method.alias("method"),
        method.isin("insufficient", "no_majority").alias("needs_review"),
        F.when(pair, F.when(a["has_modification"], 2).otherwise(0)).when(few, 0).otherwise(yes).alias("true_votes"),
        F.when(pair, F.when(a["has_modification"], 0).otherwise(2)).when(few, 0).otherwise(no).alias("false_votes"),
        on(a, b).alias("agreement_1v2"),
        F.when(pair, "skipped").otherwise(on(a, c)).alias("agreement_1v3"),
        F.when(pair, "skipped").otherwise(on(b, c)).alias("agreement_2v3"),
    )


def clean_spans(final: Column, text: Column, examples: int = 5) -> Column:
    """``label, checked, kept, dropped, dropped_examples, flipped``: modifications whose span the text has; negative when none is left.

    The text is collapsed once, and each span looked up once.
    """
    return X.let(F.struct(final.alias("final"), X.collapse(text).alias("text")), lambda r: _cleaned(r["final"], r["text"], examples))


def _cleaned(final: Column, collapsed: Column, examples: int) -> Column:
    mods = final["modifications"]
    flagged = F.transform(mods, lambda m: F.struct(m.alias("m"), X.bare_occurs(m["span"], collapsed).alias("ok")))
    parts = lambda f, ok: F.transform(F.filter(f, lambda x: x["ok"] == ok), lambda x: x["m"])
    both = X.let(flagged, lambda f: F.struct(parts(f, True).alias("kept"), parts(f, False).alias("lost")))

    def made(x: Column) -> Column:
        kept, lost = x["kept"], x["lost"]
        positive = F.coalesce(final["has_modification"], F.lit(False))
        flips = positive & (F.size(mods) > 0) & (F.size(kept) == 0)
        label = F.struct((positive & ~flips).alias("has_modification"), final["thread_type"].alias("thread_type"), kept.alias("modifications"))
        return F.struct(
            F.when(final.isNotNull(), F.when(positive, label).otherwise(final)).alias("label"),
            F.when(positive, F.size(mods)).otherwise(0).alias("checked"),
            F.when(positive, F.size(kept)).otherwise(0).alias("kept"),
            F.when(positive, F.size(lost)).otherwise(0).alias("dropped"),
            F.slice(F.transform(lost, lambda m: F.struct(m["span"], m["aspect"], m["source_comment"])), 1, examples).alias("dropped_examples"),
            F.coalesce(flips, F.lit(False)).alias("flipped"),
        )

    return X.let(both, made)


def is_unanimous(method: Column) -> Column:
    """Vote methods that count as unanimous."""
    low = F.lower(method)
    return F.coalesce(F.contains(low, F.lit("unanimous")) | F.contains(low, F.lit("3/3")) | F.contains(low, F.lit("all_agree")), F.lit(False))


def route_passes(rows: DataFrame) -> DataFrame:
    """Which pass a row (``out1, out2, out3, pass3_skipped``) waits for: first, second, third, skip or none."""
    a, b, c = F.col("out1"), F.col("out2"), F.col("out3")
    return rows.withColumn(
        "route",
        F.when(a.isNull(), "first")
        .when(b.isNull(), "second")
        .when(c.isNull() & ~F.coalesce("pass3_skipped", F.lit(False)), F.when(can_skip_third(a, b), "skip").otherwise("third"))
        .otherwise("none"),
    )


def pending(rows: DataFrame, order_col: str, limit: int | None = None) -> DataFrame:
    """Rows that wait for some pass, with their ``route``; with ``limit`` the first of them, which is a run's share."""
    waiting = route_passes(rows).where(~F.col("route").isin("none", "skip"))
    return first_examples(waiting, limit, order_col)


def update_labels(records: DataFrame, answers: DataFrame, key: str, order_col: str) -> DataFrame:
    """``records`` with the columns that ``answers`` gives for their keys; a null answer leaves the old value.

    Of several answers to a key the last by ``order_col`` counts. Columns that only
    ``answers`` has are added; answers to unknown keys go nowhere.
    """
    names = [c for c in answers.columns if c not in (key, order_col)]
    new = [f"_new_{i}" for i in range(len(names))]
    last = answers.groupBy(F.col(key).alias("_key")).agg(*[F.max_by(F.struct(F.col(c)), order_col).getField(c).alias(n) for c, n in zip(names, new)])
    joined = records.join(last, F.col(key) == F.col("_key"), "left")
    of = dict(zip(names, new))
    kept = [F.coalesce(F.col(of[c]), F.col(c)).alias(c) if c in of else F.col(c) for c in records.columns]
    return joined.select(*kept, *[F.col(n).alias(c) for c, n in of.items() if c not in records.columns])


def effective_label(final: Column, teacher: Column) -> Column:
    """The final label, or where it is missing or has neither flag nor modifications the first pass's."""
    empty = final.isNull() | (final["has_modification"].isNull() & (F.coalesce(F.size(final["modifications"]), F.lit(0)) <= 0))
    return F.when(~empty, final).otherwise(teacher)


def span_pairs(label: Column) -> Column:
    """(span, aspect) structs of a label: spans trimmed, empty ones left out, a missing aspect as UNKNOWN; an empty array without a label."""
    pairs = F.transform(label["modifications"], lambda m: F.struct(X.strip(m["span"]).alias("span"), F.coalesce(m["aspect"], F.lit("UNKNOWN")).alias("aspect")))
    return F.coalesce(F.filter(pairs, lambda p: F.coalesce(p["span"] != "", F.lit(False))), F.array().cast("array<struct<span: string, aspect: string>>"))


def span_set(label: Column) -> Column:
    """The set of (lower-cased span, upper-cased aspect) structs of a label, for agreement between annotators."""
    return F.array_distinct(F.transform(span_pairs(label), lambda p: F.struct(F.lower(p["span"]).alias("span"), F.upper(p["aspect"]).alias("aspect"))))


def annotator_flag(cell: Column) -> Column:
    """An annotator's cell as JSON text, a boolean or an object with ``has_modification``, as a boolean; else null."""
    v = F.try_parse_json(cell)
    return F.coalesce(F.try_variant_get(v, "$", "boolean"), F.try_variant_get(v, "$.has_modification", "boolean"))


def overlap_subset(rows: DataFrame, a: str = "annotator_a", b: str = "annotator_b", flag: str = "overlap") -> DataFrame:
    """Rows that both annotators have labeled and that are flagged; where none is flagged, all that both have labeled.

    One pass: the number of flagged rows is a row that is joined to the others.
    """
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    flagged = F.coalesce(F.col(flag), F.lit(False))
    any_ = both.agg(F.coalesce(F.max(flagged), F.lit(False)).alias("_any"))  # one row
    return both.join(F.broadcast(any_)).where(flagged | ~F.col("_any")).drop("_any")
