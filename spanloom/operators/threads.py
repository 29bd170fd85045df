"""Threads of comments: assembly, filters, scores and per-channel reports.

All work inside a thread is done by higher-order functions on its row, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as X

# The weights of the modification score.
WEIGHTS = {"question": 10, "keyword_in_top": 8, "has_reply": 5, "creator_reply": 15, "keyword_in_reply": 12}


def parse_items(items: DataFrame, channel_col: str = "channel_id", min_words: int = 3, spam: Sequence[str] = (), script: tuple[int, int] = X.SCRIPT, skip_own: bool = True) -> DataFrame:
    """API items (``snippet``, ``replies`` and the video's channel) as threads, filtered.

    Dropped are a channel's own top comments (unless ``skip_own`` is off), and those without the script, with too
    few words or with spam. Of the replies, the channel's own always stay, others
    need the script and no spam.
    """
    top = F.col("snippet.topLevelComment")
    channel = F.col(channel_col)
    reply = lambda r: F.struct(
        r["id"].alias("comment_id"),
        F.coalesce(r["snippet"]["textDisplay"], F.lit("")).alias("text"),
        F.coalesce(r["snippet"]["likeCount"], F.lit(0)).alias("like_count"),
        F.coalesce(r["snippet"]["authorChannelId"]["value"] == channel, F.lit(False)).alias("is_creator"),
    )
    none = F.from_json(F.lit("[]"), "array<struct<comment_id: string, text: string, like_count: bigint, is_creator: boolean>>")
    replies = F.coalesce(F.transform("replies.comments", reply), none)
    author = F.coalesce(top["snippet"]["authorChannelId"]["value"], F.lit(""))
    parsed = (items.where(author != channel) if skip_own else items).select(
        top["id"].alias("thread_id"),
        *[c for c in items.columns if c not in ("snippet", "replies")],
        F.struct(
            top["id"].alias("comment_id"),
            F.coalesce(top["snippet"]["textDisplay"], F.lit("")).alias("text"),
            F.coalesce(top["snippet"]["likeCount"], F.lit(0)).alias("like_count"),
        ).alias("top_comment"),
        replies.alias("replies"),
    )
    return with_totals(keep_threads(parsed, min_words, spam, script))


def with_totals(threads: DataFrame) -> DataFrame:
    """Adds ``has_creator_reply``, ``total_likes`` and ``collected_at``."""
    likes = F.aggregate("replies", F.col("top_comment.like_count"), lambda a, r: a + r["like_count"])
    return threads.withColumns(
        {
            "has_creator_reply": F.exists("replies", lambda r: r["is_creator"]),
            "total_likes": likes,
            "collected_at": F.current_timestamp(),
        }
    )


def keep_threads(threads: DataFrame, min_words: int = 3, spam: Sequence[str] = (), script: tuple[int, int] | None = X.SCRIPT) -> DataFrame:
    """Threads whose top comment passes, with the replies that pass."""
    top = F.col("top_comment.text")
    passes = (X.word_count(top) >= min_words) & ~X.contains_any(top, spam)
    fits = (lambda t: X.has_script(t, *script)) if script else (lambda t: F.lit(True))
    replies = F.filter("replies", lambda r: r["is_creator"] | (fits(r["text"]) & ~X.contains_any(r["text"], spam)))
    return threads.where(passes & fits(top)).withColumn("replies", replies)


# What may stand around a question word, and the letters that may be joined to its front.
WORD_ENDS = r"\s|[.,!?״\"'\-+=]"
JOINED_LETTERS = "והכלבמש"


def _escaped(word: str) -> str:
    """A word as a pattern that Java reads literally."""
    return re.sub(r"([\\^$.|?*+()\[\]{}\-#&~ ])", r"\\\1", word)


def has_question(c: Column, markers: Sequence[str]) -> Column:
    """A question mark, or one of the words, perhaps behind a one- or two-letter prefix; pattern signs in words stand for themselves."""
    one_of = "|".join(map(_escaped, markers))
    pattern = rf"(?i)(?:^|{WORD_ENDS})(?:[{JOINED_LETTERS}]{{1,2}})?(?:{one_of})(?={WORD_ENDS}|$)"
    return F.contains(c, F.lit("?")) | (F.rlike(c, F.lit(pattern)) if markers else F.lit(False))


def modification_score(markers: Sequence[str], keywords: Sequence[str]) -> Column:
    """How likely a thread (``top_comment``, ``replies``) is to tell of a modification; 0 without any sign in words."""
    top = F.lower("top_comment.text")
    question, in_top = has_question(top, markers), X.contains_any(top, keywords)
    in_reply = lambda r: X.contains_any(r["text"], keywords)
    of_reply = lambda r: F.when(r["is_creator"], WEIGHTS["creator_reply"]).otherwise(0) + F.when(in_reply(r), WEIGHTS["keyword_in_reply"]).otherwise(0)
    score = (
        F.when(question, WEIGHTS["question"]).otherwise(0)
        + F.when(in_top, WEIGHTS["keyword_in_top"]).otherwise(0)
        + F.when(F.size("replies") > 0, WEIGHTS["has_reply"]).otherwise(0)
        + F.aggregate("replies", F.lit(0), lambda a, r: a + of_reply(r))
    )
    return F.when(question | in_top | F.exists("replies", in_reply), score).otherwise(0)


def channel_report(threads: DataFrame, order_col: str = "thread_id") -> DataFrame:
    """Threads of each channel, most first; the channel's name is the last one seen."""
    return (
        threads.groupBy("channel_id")
        .agg(F.max_by("channel_title", order_col).alias("channel_title"), F.count("*").alias("n_threads"))
        .withColumn("is_cooking", F.lit(""))
        .orderBy(F.desc("n_threads"), "channel_id")
    )


def approved(threads: DataFrame, report: DataFrame) -> DataFrame:
    """Threads of channels that a reviewed report says YES to."""
    return threads.join(report.where(F.upper(F.trim("is_cooking")) == "YES").select("channel_id"), "channel_id", "left_semi")


def new_rows(candidates: DataFrame, known: DataFrame, key: str, order_col: str) -> DataFrame:
    """Candidates whose key is not known yet, the first of each key."""
    fresh = candidates.join(known.select(key).distinct(), key, "left_anti")
    first = Window.partitionBy(key).orderBy(order_col)
    return fresh.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def upsert_absent(known: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Known rows, and candidates of other keys."""
    return known.unionByName(candidates.join(known.select(key), key, "left_anti"), allowMissingColumns=True)


def last_wins(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """The last row of each key."""
    last = Window.partitionBy(key).orderBy(F.col(order_col).desc())
    return df.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def nested_caps(df: DataFrame, levels: Sequence[tuple[Sequence[str], int]], order: Sequence[str], total: int | None = None) -> DataFrame:
    """The first rows of each group, level after level from the innermost, then of all."""
    for keys, most in levels:
        w = Window.partitionBy(*keys).orderBy(*order)
        df = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
    return df.orderBy(*order).limit(total) if total is not None else df


def channel_filter(channels: DataFrame, min_subscribers: int = 10_000, min_videos: int = 30, script: tuple[int, int] = X.SCRIPT) -> DataFrame:
    """Large channels with the script in name or description, most subscribers first."""
    text = X.has_script("name", *script) | X.has_script("description", *script)
    return channels.where(text & (F.col("subscribers") >= min_subscribers) & (F.col("videos") >= min_videos)).orderBy(F.desc("subscribers"), "id")


def uploads_playlist(channel_id: Column) -> Column:
    """The key of a channel's playlist of uploads."""
    return F.concat(F.lit("UU"), F.substring(channel_id, 3, 1 << 20))


def parent_text() -> Column:
    """The first non-blank of the flat text, the nested text, the flagged comment and the first comment."""
    blank = lambda c: F.when(X.strip(c) != "", X.col(c))
    comments = F.col("comments")
    flagged = F.get(F.filter(comments, lambda c: c["is_top"]), F.lit(0))["text"]
    return F.coalesce(blank("top_comment_text"), blank("top_comment.text"), blank(flagged), blank(F.get(comments, F.lit(0))["text"]))


def thread_text(top: Column, replies: Column) -> Column:
    """Top comment and replies, a line each; the line feed stays where there are no replies."""
    return F.concat(F.coalesce(top, F.lit("")), F.lit("\n"), F.array_join(F.coalesce(replies, F.array().cast("array<string>")), "\n"))


def prompts(threads: DataFrame, size: int, buckets: int, order_col: str = "thread_id") -> DataFrame:
    """Prompts of ``size`` threads each, with numbered headers and the comments' roles: ``bucket, batch, n_threads, prompt``.

    Threads are dealt to ``buckets`` by the hash of their ids and numbered within them, in as many tasks as
    there are; a bucket's last prompt may have fewer threads. Take a bucket for some thousand threads.
    """
    reply = lambda r, i: F.concat(F.lit("[reply_"), (i + 1).cast("string"), F.when(r["is_creator"], ", creator").otherwise(""), F.lit("] "), r["text"])
    body = F.concat(F.lit("[top] "), F.col("top_comment.text"), F.lit("\n"), F.array_join(F.transform("replies", reply), "\n"))
    w = Window.partitionBy("bucket").orderBy(order_col)
    return (
        threads.withColumn("bucket", X.hash_index(order_col, buckets))
        .withColumn("_n", F.row_number().over(w) - 1)
        .select("bucket", F.floor(F.col("_n") / size).alias("batch"), (F.col("_n") % size).alias("_k"), order_col, body.alias("_b"))
        .withColumn("_t", F.concat(F.lit("=== THREAD "), (F.col("_k") + 1).cast("string"), F.lit(" ("), F.col(order_col).cast("string"), F.lit(") ===\n"), F.col("_b")))
        .groupBy("bucket", "batch")
        .agg(F.array_sort(F.collect_list(F.struct("_k", "_t"))).alias("_a"))
        .select("bucket", "batch", F.size("_a").alias("n_threads"), F.array_join(F.transform("_a", lambda x: x["_t"]), "\n\n").alias("prompt"))
    )
