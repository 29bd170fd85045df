"""A pair of tables in co-partitioned Parquet files: equal keys of both stand in files of equal number.

The buckets are a CRC-32 of the key, which Spark's own ``repartition`` doesn't know: it deals rows out by murmur3. So
integers are looked up beforehand, one for each partition, whose murmur3 hash falls into just that partition. A row's
bucket is replaced by the integer of that number, and an ordinary ``repartition`` by it puts each bucket into a
partition of its own. Sorting and writing are Spark's.

``PairWriter.start`` lays the tables out in numbered files of any other law, ``rewrite`` turns those into one file a bucket.
Files that hold just a bucket's rows already stay as they are. Rows whose key the other table lacks (``strays``) and rows without a
key have buckets of their own. Nothing that grows with the tables is broadcast or collected: the driver learns the numbers of files that stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from spanloom.llm.common import discard, materialize, shuffle_partitions, unused

#: Ids that are made text at a time.
CHUNK = 100_000


def surrogates(spark: SparkSession, wanted: int, partitions: int) -> list[int]:
    """For each partition below ``wanted`` the least integer from 0 that ``repartition(partitions, ...)`` puts there."""
    found: dict[int, int] = {}
    start, step = 0, 16 * partitions
    while len(found) < wanted:
        k = F.col("id").cast("int")
        tried = spark.range(start, start + step, 1, 1).select(F.pmod(F.hash(k), F.lit(partitions)).alias("at"), k.alias("k"))
        found = {r["at"]: r["k"] for r in tried.where(F.col("at") < wanted).groupBy("at").agg(F.min("k").alias("k")).collect()} | found
        start += step
    return [found[p] for p in range(wanted)]


def crc_bucket(key: Column, buckets: int, salt: str = "") -> Column:
    """Unsigned CRC-32 of the salt and the key in decimals, modulo ``buckets``; null for a null key."""
    return F.pmod(F.crc32(F.concat(F.lit(salt), key.cast("string")).cast("binary")), F.lit(buckets)).cast("int")


@dataclass
class PairWriter:
    """``folder`` gets a folder for each table; ``key`` is an integer column of both, ``buckets`` the number of hash buckets.

    Bucket ``buckets`` holds the second table's rows whose key the first one lacks, the next one rows of either without a key. Rows are
    sorted by key downwards, then by the other columns from left to right, nulls first; repeated rows stay repeated. An empty table has no
    file. Columns may have any names: the number of a file is a folder's name, ``part=K``, with underscores behind it where a column is called so.
    """

    spark: SparkSession
    folder: str
    key: str
    buckets: int = 150
    salt: str = "pair"
    schemas: dict[str, StructType] = field(default_factory=dict)
    #: Of each table the name of the column that numbers its files, and which starting files stay as which bucket.
    numbers: dict[str, str] = field(default_factory=dict)
    stay: dict[str, dict[int, int]] = field(default_factory=dict)
    #: Starting files a table has at most; rewritten ones are numbered behind them.
    files: int = 152
    pairs: DataFrame | None = None
    owners: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.files > self.buckets + 2:
            raise ValueError("more starting files than buckets")
        self.partitions = max(self.buckets + 2, shuffle_partitions(self.spark))
        self.integers = surrogates(self.spark, self.buckets + 2, self.partitions)

    def read(self, name: str) -> DataFrame:
        """The table as it stands, with the numbers of its files."""
        schema = StructType([*self.schemas[name].fields, StructField(self.numbers[name], IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def dealt(self, df: DataFrame, slot: str, integer: str) -> DataFrame:
        """Rows of slot k (a column), below buckets + 2, and no others, in partition k; ``integer`` names the column that does it."""
        return df.withColumn(integer, F.element_at(F.array(*map(F.lit, self.integers)), F.col(slot) + 1)).repartition(self.partitions, integer)

    def order(self, name: str) -> list[Column]:
        # The complement falls where the key rises, and nulls stay first.
        return [F.bitwise_not(F.col(f"`{self.key}`")), *[F.col(f"`{c}`") for c in self.schemas[name].names if c != self.key]]

    def bucket(self, key: Column) -> Column:
        """A row's bucket, if its key has an owner."""
        return F.coalesce(crc_bucket(key, self.buckets, self.salt), F.lit(self.buckets + 1))

    def _write(self, df: DataFrame, name: str) -> None:
        """Append rows that are dealt out by their file's number; each task sorts what it has."""
        at = self.numbers[name]
        rows = df.sortWithinPartitions(at, *self.order(name)).select(*[f"`{c}`" for c in self.schemas[name].names], at)
        rows.write.mode("append").partitionBy(at).parquet(f"{self.folder}/{name}")

    def start(self, name: str, df: DataFrame, number: Column) -> None:
        """Write ``df`` as numbered files: one for each number (below ``files``) that has rows."""
        at, integer = unused(df, "part", "_integer")
        self.schemas[name], self.numbers[name] = df.schema, at
        self._write(self.dealt(df.withColumn(at, number.cast("int")), at, integer), name)

    def study(self, first: str, second: str) -> None:
        """For each starting file and bucket the rows of the one in the other, and joined rows; then which files stay."""
        of = lambda name: self.read(name).select(F.col(f"`{self.key}`").alias("key"), F.col(self.numbers[name]).alias("start"))
        count = lambda df, *more: df.groupBy("start", "bucket").agg(F.count("*").alias("n"), *more)
        unjoined = F.lit(0).cast("long").alias("n_joined")
        keyed = lambda df: df.where(F.col("key").isNotNull())
        self.owners = materialize(keyed(of(first)).groupBy("key").agg(F.count("*").alias("owners")), "owners")
        one = count(of(first).withColumn("bucket", self.bucket(F.col("key"))), unjoined)
        # Keys only, by sort and merge: Spark splits a key that many rows have, and broadcasts no side.
        met = keyed(of(second)).join(self.owners.hint("merge"), "key", "left")
        met = met.withColumn("bucket", F.when(F.col("owners").isNull(), self.buckets).otherwise(self.bucket(F.col("key"))))
        two = count(met, F.coalesce(F.sum("owners"), F.lit(0)).cast("long").alias("n_joined"))
        lost = count(of(second).where(F.col("key").isNull()).withColumn("bucket", F.lit(self.buckets + 1)), unjoined)
        named = one.withColumn("table_name", F.lit(first)).unionByName(two.unionByName(lost).withColumn("table_name", F.lit(second)))
        self.pairs = materialize(named, "file-pairs")  # at most files x buckets rows of a table
        alone = lambda c: F.count("*").over(Window.partitionBy("table_name", c)) == 1
        same = self.pairs.withColumn("same", alone("start") & alone("bucket")).where("same").collect()
        self.stay = {name: {r["start"]: r["bucket"] for r in same if r["table_name"] == name} for name in (first, second)}

    def rewrite(self, name: str, owned: bool = False) -> None:
        """Turn the files that don't stay into one a bucket, and delete them; with ``owned`` a row's key must have an owner.

        The rows and the owners' keys meet in their bucket's task, where a key's owner sorts in front of its rows, so
        rows without an owner are told while all are streamed. They are written aside and gathered into their own file.
        """
        at, rows = self.numbers[name], self.read(name)
        if self.stay[name]:
            rows = rows.where(~F.col(at).isin(list(self.stay[name])))
        mark, bucket, integer = unused(rows, "_owner", "_bucket", "_integer")
        key = F.col(f"`{self.key}`")
        numbered = lambda df: df.withColumn(at, F.col(bucket) + self.files)
        rows = rows.withColumn(bucket, self.bucket(key))
        if owned:
            owners = self.owners.select(F.col("key").cast(self.schemas[name][self.key].dataType).alias(self.key)).withColumn(bucket, self.bucket(key))
            rows = rows.withColumn(mark, F.lit(False)).unionByName(owners.withColumn(mark, F.lit(True)), allowMissingColumns=True)
            seen = Window.partitionBy(integer, F.bitwise_not(key)).orderBy(F.desc(mark)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            rows = self.dealt(rows, bucket, integer).withColumn("_seen" + mark, F.max(mark).over(seen) | key.isNull()).where(~F.col(mark))
            self._write(rows.withColumn(at, F.when(F.col("_seen" + mark), F.col(bucket) + self.files).otherwise(-1)), name)
            strays = self.read(name).where(F.col(at) == -1).withColumn(bucket, F.lit(self.buckets))
            self._write(numbered(self.dealt(strays, bucket, integer)), name)
        else:
            self._write(numbered(self.dealt(rows, bucket, integer)), name)
        self._delete(name, [f"{at}={k}" for k in range(-1, self.files) if k not in self.stay[name]] + ["_SUCCESS"])

    def _delete(self, name: str, entries: list[str]) -> None:
        jvm = self.spark._jvm
        home = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = home.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        for entry in entries:  # as many as there are starting files
            fs.delete(jvm.org.apache.hadoop.fs.Path(home, entry), True)

    # What was written

    def report(self) -> DataFrame:
        """A row for each final file; ids and their order are read from the files."""
        told = None
        for name, schema in self.schemas.items():
            at, table = self.numbers[name], self.read(name)
            stays = F.element_at(F.create_map(*[F.lit(x) for kv in self.stay[name].items() for x in kv]), F.col(at)) if self.stay[name] else F.lit(None).cast("int")
            place = table.metadataColumn("_metadata")
            read = table.select(
                place["file_path"].alias("path"), F.coalesce(F.when(F.col(at) < self.files, stays), F.col(at) - self.files).alias("bucket"), place["row_index"].alias("at"), F.col(f"`{self.key}`").cast("long").alias("key"),
            )
            # Runs of equal ids, made where the file is read, are all that is shuffled.
            runs = self.dealt(read.mapInArrow(_runs, "path string, bucket int, at long, key long, n long"), "bucket", "integer").sortWithinPartitions("bucket", "at").drop("integer")
            one = runs.mapInArrow(_digest(name), "table_name string, path string, bucket long, n_rows long, ids_sha256 string")
            one = one.withColumn("columns", F.lit(",".join(schema.names))).withColumn("rewritten", F.regexp_extract("path", rf"/{at}=(\d+)/", 1).cast("int") >= self.files)
            told = one if told is None else told.unionByName(one)
        line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "n"))), lambda x: F.concat_ws(":", x["start"].cast("string"), x["n"].cast("string"))), ",")
        lineage = self.pairs.groupBy("table_name", F.col("bucket").cast("long").alias("bucket")).agg(F.sha2(line.cast("binary"), 256).alias("lineage_sha256"))
        joined = self.pairs.groupBy(F.col("bucket").cast("long").alias("bucket")).agg(F.sum("n_joined").alias("n_joined"))
        told = told.join(lineage, ["table_name", "bucket"]).join(joined, "bucket")
        return told.select("table_name", "path", "columns", "ids_sha256", "lineage_sha256", "bucket", "n_rows", "n_joined", "rewritten")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``path, bucket, at, key, n``: where a run of one id begins and how long it is; runs end with a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key, at = batch.column(3), batch.column(2).to_numpy()
        null, value, bucket = key.is_null().to_numpy(zero_copy_only=False), key.fill_null(0).to_numpy(), batch.column(1).to_numpy()
        new = np.ones(len(at), bool)
        new[1:] = (value[1:] != value[:-1]) | (null[1:] != null[:-1]) | (bucket[1:] != bucket[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        take, n = pa.array(first), np.diff(np.append(first, len(at)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(4)), pa.array(n, pa.int64())], ["path", "bucket", "at", "key", "n"])


def _digest(name: str):
    """From runs in the order of their files: ``table_name, path, bucket, n_rows, ids_sha256``, hashed as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, bucket, rows, sha = None, None, 0, hashlib.sha256()

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([path]), pa.array([bucket], pa.int64()), pa.array([rows], pa.int64()), pa.array([sha.hexdigest()])],
                ["table_name", "path", "bucket", "n_rows", "ids_sha256"],
            )

        for batch in batches:
            paths, buckets, keys, counts = (batch.column(c).to_pylist() for c in (0, 1, 3, 4))
            text: list[str] = []
            for p, b, k, n in zip(paths, buckets, keys, counts):
                if b != bucket:
                    if bucket is not None:
                        sha.update("".join(text).encode())
                        yield done()
                    path, bucket, rows, sha, text = p, b, 0, hashlib.sha256(), []
                word = "" if k is None else str(k)
                if not rows:
                    text.append(word)
                    rows, n = 1, n - 1
                rows += n
                word = "," + word
                for left in range(n, 0, -CHUNK):
                    text.append(word * min(left, CHUNK))
                    if left > CHUNK // 8 or len(text) >= CHUNK:
                        sha.update("".join(text).encode())
                        text = []
            sha.update("".join(text).encode())
        if bucket is not None:
            yield done()

    return run


def write_pair(first: DataFrame, second: DataFrame, folder: str, key: str, starts: tuple[Column, Column], files: int, names: tuple[str, str], buckets: int = 150, salt: str = "pair") -> PairWriter:
    """Lay both tables out in ``files`` starting files by the numbers that ``starts`` gives, and rewrite them to one file a bucket.

    ``files`` is at most the buckets and 2. Raises where the key of either is no integer.
    """
    for df in (first, second):
        if df.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
            raise ValueError(f"{key} must be an integer")
    pair = PairWriter(first.sparkSession, folder, key, buckets, salt, files=files)
    for name, df, number in zip(names, (first, second), starts):
        pair.start(name, df, number)
    pair.study(*names)
    pair.rewrite(names[1], owned=True)
    pair.rewrite(names[0])
    return pair


def report_pair(pair: PairWriter) -> DataFrame:
    """``PairWriter.report`` as a written table, so that reading it again hashes no file again; the tables stay, helpers go."""
    told = materialize(pair.report(), "pair-report")
    discard(pair.pairs, pair.owners)
    return told
