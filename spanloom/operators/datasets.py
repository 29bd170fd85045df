"""Training sets: splits by group, sampling, merging and class weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.schemas import IGNORE
from spanloom.storage import materialize


#: Rows that one task may sort out.
TOP_ROWS = 100_000
#: Buckets of a hash within which rows are ranked, so that no task ranks all of them.
HASH_DIGITS = 3


def hash_ranked(df: DataFrame, key_col: str, seed: str = "42", by: Sequence[str] = ()) -> DataFrame:
    """Adds ``_k``, the row's place from 1 in the hash order of its key (within the columns ``by``), and ``_n``, the number of rows there.

    Rows are ranked inside buckets of the hash's first digits, with the buckets' counts before them: 16 ** ``HASH_DIGITS``
    rows for each value of ``by``, which are added up in one place and broadcast.
    """
    rows = df.withColumn("_h", X.hash_order(key_col, seed)).withColumn("_b", F.substring("_h", 1, HASH_DIGITS))
    counts = rows.groupBy(*by, "_b").agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_b").alias("_bb"), F.coalesce(F.sum("_c").over(upto), F.lit(0)).alias("_o"), F.sum("_c").over(whole).alias("_n"))
    on = F.col("_b") == F.col("_bb")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    joined = rows.join(F.broadcast(before), on)
    place = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", key_col)) + F.col("_o")
    return joined.withColumn("_k", place).drop("_h", "_b", "_bb", "_o", *[f"_by{i}" for i in range(len(by))])


def stratified_split(df: DataFrame, group_col: str, stratum: Column, shares: Sequence[float] = (0.8, 0.1), names: Sequence[str] = ("train", "val", "test"), seed: str = "42") -> DataFrame:
    """Adds ``split``: groups of one stratum in hash order, floor(n * share) to each name, the rest to the last.

    A group is positive in a stratum if any of its rows is. All of a group's rows go the same way.
    """
    ranked = hash_ranked(df.groupBy(group_col).agg(F.max(stratum).alias("_s")), group_col, seed, ["_s"])
    split, upto = None, F.lit(0).cast("long")
    for share, name in zip(shares, names):
        upto = upto + F.floor(F.col("_n") * F.lit(share))
        split = F.when(F.col("_k") <= upto, name) if split is None else split.when(F.col("_k") <= upto, name)
    return df.join(ranked.select(group_col, split.otherwise(names[len(shares)]).alias("split")), group_col)


def leakage(df: DataFrame, group_col: str, split_col: str = "split") -> DataFrame:
    """``split_a, split_b, n_common`` for pairs of splits that share groups; empty for a sound split."""
    sets = df.groupBy(group_col).agg(F.array_sort(F.collect_set(split_col)).alias("s")).where(F.size("s") > 1)
    pairs = sets.select(F.explode("s").alias("split_a"), "s").select("split_a", F.explode("s").alias("split_b")).where("split_a < split_b")
    return pairs.groupBy("split_a", "split_b").agg(F.count("*").alias("n_common"))


def numbered(df: DataFrame, key_col: str) -> DataFrame:
    """Adds ``i``: the row's place from 0 in the order of a (distinct) key, without gathering the rows.

    Spark cuts the keys into ranges of about equal numbers of rows, wherever they lie; the rows are written once, since the cuts come from a sample,
    and a running sum over the ranges' counts gives each its first place.
    """
    rows = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key_col).withColumn("_b", F.spark_partition_id())
    rows = materialize(rows, "numbered")
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("_b").agg(F.count("*").alias("_c")).select("_b", F.coalesce(F.sum("_c").over(upto), F.lit(0)).alias("_o"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy(key_col)) - 1 + F.col("_o")
    return rows.join(F.broadcast(before), "_b").withColumn("i", place.cast("long")).drop("_b", "_o")  # a row for each range


def downsample(df: DataFrame, positive: Column, ratio: float | None, key_col: str, seed: str = "42") -> DataFrame:
    """Negatives cut to floor(positives * ratio) in hash order; unchanged for no ratio, or one not above 0."""
    if not ratio or ratio <= 0:
        return df
    n = df.agg(F.count_if(positive).alias("n")).first()["n"]
    ranked = hash_ranked(df.where(~positive), key_col, seed)
    return df.where(positive).unionByName(ranked.where(F.col("_k") <= int(n * ratio)).select(*df.columns))


def label_positive(labels_col: str, ignore: int = IGNORE) -> Column:
    """Whether a row's label ids have any but 0 and the ignored one: the condition of ``downsample`` where a file is loaded."""
    return F.exists(labels_col, lambda i: ~i.isin(0, ignore))


def fraction(df: DataFrame, share: float, key_col: str, seed: str = "42") -> DataFrame:
    """max(1, floor(n * share)) rows, the first in hash order."""
    most = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(share)))
    return hash_ranked(df, key_col, seed).where(F.col("_k") <= most).select(*df.columns)


def first_examples(df: DataFrame, n: int | None, order_col: str) -> DataFrame:
    """The first ``n`` rows, for a trial run or to see a model overfit; all for None.

    Up to ``TOP_ROWS`` they meet in one task, more are found by their places.
    """
    if n is None:
        return df
    return df.orderBy(order_col).limit(n) if n <= TOP_ROWS else numbered(df, order_col).where(F.col("i") < n).drop("i")


def merge(original: DataFrame, enriched: DataFrame, unanimous: Column) -> DataFrame:
    """The original rows, and the enriched ones that the vote was unanimous on."""
    return original.unionByName(enriched.where(unanimous), allowMissingColumns=True)


def binary_weights(df: DataFrame, label_col: str) -> DataFrame:
    """``label, n, weight`` = N / (2 * n) of a yes/no label; one value only has weight 0.5."""
    counts = df.groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("n"))
    total = df.agg(F.count(label_col).alias("_total"))
    return counts.where(F.col("label").isNotNull()).join(total).select("label", "n", F.round(F.col("_total").cast("double") / (2 * F.col("n")), 4).alias("weight"))  # total: one row


def class_weights(labels: DataFrame, scheme: Mapping[str, int], mode: str = "capped", cap: float = 20.0) -> DataFrame:
    """``label, n, weight`` for every label of the scheme from a table with a column ``label``; a missing one counts as 1.

    ``balanced`` is N / (C * n); ``capped`` limits it; ``sqrt`` takes its root; ``uniform`` is 1.
    """
    every = labels.sparkSession.createDataFrame([(k, v) for k, v in scheme.items()], "label string, id int")
    counts = labels.groupBy("label").agg(F.count("*").alias("n"))
    total = labels.agg(F.count("*").alias("_total"))
    weight = F.col("_total").cast("double") / (F.lit(len(scheme)) * F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)))
    weight = {"balanced": weight, "capped": F.least(F.lit(cap), weight), "sqrt": F.sqrt(weight), "uniform": F.lit(1.0)}[mode]
    return every.join(counts, "label", "left").join(total).select("label", F.coalesce("n", F.lit(0)).alias("n"), F.round(weight, 4).alias("weight"))  # total: one row


def label_distribution(labels: DataFrame) -> DataFrame:
    """``label, n, share``."""
    total = F.sum("n").over(Window.partitionBy())
    return labels.groupBy("label").agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / total, 6))


def random_labels(df: DataFrame, key_col: str, distribution: Sequence[tuple[str, float]], seed: str = "42") -> DataFrame:
    """Adds ``pred``: a label drawn by the key's hash from a list of (label, share)."""
    u, pred, upto = X.hash_uniform(key_col, seed), None, 0.0
    for label, share in distribution[:-1]:
        upto += share
        pred = F.when(u < upto, label) if pred is None else pred.when(u < upto, label)
    last = distribution[-1][0]
    return df.withColumn("pred", pred.otherwise(last) if pred is not None else F.lit(last))


def early_stop(log: DataFrame, run_col: str, step_col: str, score_col: str, patience: int = 3) -> DataFrame:
    """``best``, ``since`` (steps without a new best) and ``stopped`` for each step of training runs."""
    w = Window.partitionBy(run_col).orderBy(step_col)
    before = F.max(score_col).over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = F.coalesce(F.col(score_col) > before, F.lit(True))
    island = F.sum(F.when(F.col("_better"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = log.withColumn("_better", better).withColumn("_island", island)
    since = F.row_number().over(Window.partitionBy(run_col, "_island").orderBy(step_col)) - 1
    best = F.max(score_col).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumns({"best": best, "since": since}).withColumn("stopped", F.col("since") >= patience).drop("_better", "_island")


def streaks(log: DataFrame, key_col: str, order: Sequence[str], hit: Column, base: int = 60, most: int = 300) -> DataFrame:
    """Adds ``streak`` (consecutive hits so far) and ``wait`` = min(most, base * 2 ** (streak - 1)) where there is one."""
    w = Window.partitionBy(key_col).orderBy(*order)
    marked = log.withColumn("_hit", hit).withColumn("_island", F.sum(F.when(F.col("_hit"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.sum(F.when(F.col("_hit"), 1).otherwise(0)).over(Window.partitionBy(key_col, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = marked.withColumn("streak", F.when(F.col("_hit"), run).otherwise(0))
    return out.withColumn("wait", F.when(F.col("streak") > 0, F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), F.col("streak") - 1))).otherwise(0.0)).drop("_hit", "_island")
