"""Training examples from labeled threads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.schemas import ASPECTS


def source_text(source: Column, top: Column, replies: Column) -> Column:
    """The comment that ``top`` or ``reply_k`` (k from 1) names; null where there is none."""
    k = F.regexp_extract(source, r"^reply_(\d+)$", 1).try_cast("int")
    return F.when(source == "top", top).when(k >= 1, F.get(replies, k - 1))


def comment_examples(labeled: DataFrame, keep_empty: bool = True, aspects: Sequence[str] = ASPECTS) -> DataFrame:
    """``thread_id, source_comment, text, has_modification, vote_method, modifications`` of labeled threads.

    A negative thread gives its top comment; a positive one each comment that has a valid
    modification, and nothing where none is valid. ``labeled`` has ``thread_id,
    top_comment_text, replies_texts, label, vote_method``.
    """
    label = F.col("label")
    positive = F.coalesce(label["has_modification"], F.lit(False))
    mods = labeled.where(positive).select("thread_id", "top_comment_text", "replies_texts", "vote_method", F.posexplode(label["modifications"]).alias("pos", "m"))
    valid = mods.where(F.upper(X.strip("m.aspect")).isin(*aspects) & (X.strip("m.span") != ""))
    source = F.coalesce("m.source_comment", F.lit("top"))
    found = (
        valid.select(
            "thread_id", source.alias("source_comment"), "vote_method",
            source_text(source, F.col("top_comment_text"), F.col("replies_texts")).alias("text"),
            F.struct("pos", X.strip("m.span").alias("span"), F.upper(X.strip("m.aspect")).alias("aspect"), F.col("m.confidence").alias("confidence")).alias("m"),
        )
        .where(X.strip("text") != "")
        .groupBy("thread_id", "source_comment")
        .agg(F.first("text").alias("text"), F.lit(True).alias("has_modification"), F.first("vote_method").alias("vote_method"), F.array_sort(F.collect_list("m")).alias("modifications"))
    )
    if not keep_empty:
        return found
    none = F.slice(F.array(F.struct(F.lit(0).alias("pos"), F.lit("").alias("span"), F.lit("").alias("aspect"), F.lit(0.0).alias("confidence"))), 1, 0)
    negative = labeled.where(~positive & (X.strip("top_comment_text") != "")).select(
        "thread_id", F.lit("top").alias("source_comment"), F.col("top_comment_text").alias("text"),
        F.lit(False).alias("has_modification"), "vote_method", none.alias("modifications"),
    )
    return found.unionByName(negative)


def thread_aware(text: Column, top: Column, question: str = "[שאלה] ", answer: str = " [תשובה] ") -> Column:
    """``text, reply_text, prefix_len, is_thread_aware``: a reply behind its question, unless the question is blank or the same."""
    prefix = F.concat(F.lit(question), top, F.lit(answer))
    behind = F.coalesce((X.strip(top) != "") & (X.strip(top) != X.strip(text)), F.lit(False))
    return F.struct(
        F.when(behind, F.concat(prefix, text)).otherwise(text).alias("text"),
        text.alias("reply_text"),
        F.when(behind, F.length(prefix)).otherwise(0).alias("prefix_len"),
        behind.alias("is_thread_aware"),
    )
