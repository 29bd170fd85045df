"""Line deduplication by hashes, in DataFrame functions only.

Only 128-bit line hashes, ids and positions are shuffled, never line texts. Lines
of one document and key collapse first, then counts are taken per key and salt, so a
line that a third of all documents hold arrives as a few pre-aggregated rows.
Those are range-partitioned by hash with a secondary sort by document, and the
first row of each hash names the document that keeps its line, wherever in it the
line stands. What comes back per document is its keep bitmap in run-length form:
the runs of positions of dropped lines, all others being kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import ASCII_BLANKS, ascii_lower, materialize, shuffle_partitions, unused
from spanloom.storage import LEAST_FILES

SALTS = 16
#: Up to so many repeated lines, they are broadcast to the lines; beyond, copied for each salt.
BROADCAST_LINES = 500_000


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = ascii_lower(F.trim(F.col("line"), F.lit(ASCII_BLANKS)))
    return (
        docs.select(F.col(id_col).alias("k_id"), F.xxhash64(F.col(text_col)).alias("k_text"), text.alias("t"))
        .select("k_id", "k_text", F.posexplode(F.split("t", "\n", -1)).alias("pos", "line"))
        .where(F.char_length("line") >= min_chars)
        .select("k_id", "k_text", "pos", key.alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("k_id", "k_text", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )


def drop_runs(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``k_id, k_text, runs``: the run-length bitmap of dropped lines, for documents that lose any.

    ``runs`` is a sorted array of (start, length) over zero-based line numbers.
    """
    n = shuffle_partitions(docs.sparkSession)
    lines = _lines(docs, id_col, text_col, min_chars)
    counted = (
        lines.groupBy("h1", "h2", "k_id")
        .agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2", F.pmod(F.xxhash64("k_id"), F.lit(SALTS)).alias("salt"))
        .agg(F.count("*").alias("n"), F.max("k_id").alias("last"))
    )
    of_key = Window.partitionBy("h1", "h2")
    frequent = materialize(
        counted.repartitionByRange(n, "h1")
        .withColumn("n_docs", F.sum("n").over(of_key))
        .withColumn("first", F.row_number().over(of_key.orderBy(F.col("last").desc_nulls_last(), "salt")))
        .where((F.col("n_docs") >= min_docs) & (F.col("first") == 1))
        .select("h1", "h2", F.col("last").alias("keeper"))
        .coalesce(max(LEAST_FILES, n // 8)),  # one line of five at most
        "repeated-lines",
    )
    if frequent.count() <= BROADCAST_LINES:
        met = lines.join(F.broadcast(frequent), ["h1", "h2"])
    else:  # a line that many documents hold meets its copies in as many tasks
        copies = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = lines.withColumn("salt", F.pmod(F.xxhash64("k_id"), F.lit(SALTS)).cast("int")).join(copies, ["h1", "h2", "salt"])
    dropped = met.where(~F.col("k_id").eqNullSafe(F.col("keeper")))
    of_doc = Window.partitionBy("k_id", "k_text").orderBy("pos")
    return (
        dropped.select("k_id", "k_text", "pos")
        .distinct()
        .repartition(n, "k_id", "k_text")
        .withColumn("run", F.col("pos") - F.row_number().over(of_doc))
        .groupBy("k_id", "k_text", "run")
        .agg(F.min("pos").alias("start"), F.count("*").cast("int").alias("length"))
        .groupBy("k_id", "k_text")
        .agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("runs"))
    )


def dedup_lines(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and ``n_lines`` and ``n_dropped``.

    A line's key is the line stripped of ASCII blanks at both ends with A-Z
    lower-cased. A key of at least ``min_chars`` code points found in at least
    ``min_docs`` documents keeps its lines only in the largest id that holds it.

    A null or empty text is one empty line (a null stays null). A null id counts
    as one document that is smaller than all others. Rows that repeat an id
    count as one document; all of them keep or lose their own lines. Texts that
    lose every line become empty. An empty table gives no rows. Other columns,
    whatever their names, come back as they were, except that ``n_lines`` and
    ``n_dropped`` replace columns of those names.
    """
    runs = drop_runs(docs, min_chars, min_docs, id_col, text_col)
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    own, text, k_id, k_text, gone = unused(docs, "own_id", "text_key", "lost_id", "lost_text", "lost_runs")
    keep = F.array_join(
        F.filter(
            lines,
            lambda _, i: ~F.exists(gone, lambda r: (i >= r["start"]) & (i < r["start"] + r["length"])),
        ),
        "\n",
    )
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    keyed = docs.select(*names, F.col(id_col).alias(own), F.xxhash64(F.col(text_col)).alias(text))
    flags = runs.select(F.col("k_id").alias(k_id), F.col("k_text").alias(k_text), F.col("runs").alias(gone))
    joined = keyed.join(flags, F.col(own).eqNullSafe(F.col(k_id)) & (F.col(text) == F.col(k_text)), "left")
    lost = F.aggregate(gone, F.lit(0).cast("long"), lambda a, r: a + r["length"])
    return joined.select(
        *[
            (F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(keep) if c == text_col else F.col(c)).alias(c)
            for c in names
        ],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(lost, F.lit(0)).cast("long").alias("n_dropped"),
    )
