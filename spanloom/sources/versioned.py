"""Tables in versions: append, replace and merge by key, each as a whole or not at all.

A table is a folder of Parquet folders, dealt to buckets by the hash of its key, and of manifests. Manifest N names the folders that make up
version N. A change writes new folders beside the old ones (Spark's committer makes a task's files visible as a whole),
and then publishes the next manifest by a rename that fails if that number is taken. So a reader sees the old version until the new one is
whole, a killed task or driver leaves nothing but folders that no manifest names, and of two writers one is told to try again.

A change may carry a batch name; one that an earlier manifest has is not made again, which makes a replayed batch of a stream harmless.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The column (a folder's name) that holds a row's bucket.
BUCKET = "_bucket"


class Conflict(Exception):
    """Another writer has published the version that this one was about to."""


@dataclass
class Manifest:
    number: int
    #: Names of the changes of streams so far: the last batch of each stream.
    batches: dict[str, int]
    #: For each bucket the folders with its rows.
    folders: dict[int, list[str]]
    schema: str
    buckets: int

    def text(self) -> str:
        return json.dumps({"number": self.number, "batches": self.batches, "folders": self.folders, "schema": self.schema, "buckets": self.buckets})

    @classmethod
    def of(cls, text: str) -> Manifest:
        d = json.loads(text)
        return cls(d["number"], d["batches"], {int(k): v for k, v in d["folders"].items()}, d["schema"], d["buckets"])


class VersionedTable:
    """The table at ``path``, any folder that driver and executors share; ``key`` is what rows are merged by."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        jvm = spark._jvm
        self._hadoop, self._conf = jvm.org.apache.hadoop.fs, spark._jsparkSession.sessionState().newHadoopConf()
        self._files = self._hadoop.Path(self.path).getFileSystem(self._conf)

    # Manifests

    def _at(self, *parts: str):
        return self._hadoop.Path("/".join((self.path, *parts)))

    def numbers(self) -> list[int]:
        """Versions that can be read, from the first on."""
        folder = self._at("_manifests")
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, number: int | None = None) -> Manifest | None:
        """That of a version; by default the last one, None before the first."""
        if number is None:
            found = self.numbers()
            if not found:
                return None
            number = found[-1]
        stream = self._files.open(self._at("_manifests", f"{number:010d}.json"))
        try:
            return Manifest.of(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, new: Manifest) -> int:
        draft, target = self._at("_manifests", f".{uuid.uuid4().hex}"), self._at("_manifests", f"{new.number:010d}.json")
        out = self._files.create(draft, False)
        try:
            out.write(bytearray(new.text().encode()))
        finally:
            out.close()
        option = getattr(self._hadoop, "Options$Rename")
        none = self.spark.sparkContext._gateway.new_array(option, 0)
        try:
            self._hadoop.FileContext.getFileContext(self._files.getUri(), self._conf).rename(self._files.makeQualified(draft), self._files.makeQualified(target), none)
        except Exception as e:
            self._files.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {new.number} of {self.path}") from e
            raise
        return new.number

    # Reading

    def read(self, number: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A version's rows, of all buckets or of some."""
        m = self.manifest(number)
        if m is None:
            raise FileNotFoundError(self.path)
        schema = StructType.fromJson(json.loads(m.schema))
        folders = [f"{self.path}/{f}" for b, fs in m.folders.items() if buckets is None or b in buckets for f in fs]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(f"`{self.key}`")), F.lit(self.buckets)).cast("int")

    # Changes

    def made(self, batch: tuple[str, int]) -> bool:
        """Whether a stream's batch has been published."""
        m = self.manifest()
        return m is not None and m.batches.get(batch[0], -1) >= batch[1]

    def _write(self, df: DataFrame) -> dict[int, list[str]]:
        """New folders for the rows' buckets. A bucket is one task's work, or, where it is large, several tasks'."""
        name = f"v-{uuid.uuid4().hex}"
        rows = df.withColumn(BUCKET, self.bucket()).hint("rebalance", BUCKET)
        rows.write.partitionBy(BUCKET).parquet(f"{self.path}/{name}")
        found = [s.getPath().getName() for s in self._files.listStatus(self._at(name)) if s.isDirectory()]
        return {int(f.partition("=")[2]): [f"{name}/{f}"] for f in found if f.startswith(f"{BUCKET}=")}

    def _change(self, batch: tuple[str, int] | None, change: Callable[[Manifest], tuple[dict[int, list[str]], StructType]], schema: StructType) -> int:
        """The number of the version that ``change`` leads to, or of the present one where the batch has been made."""
        old = self.manifest() or Manifest(0, {}, {}, json.dumps(schema.jsonValue()), self.buckets)
        if old.buckets != self.buckets:
            raise ValueError(f"the table has {old.buckets} buckets")
        if batch and self.made(batch):
            return old.number
        folders, schema = change(old)
        batches = old.batches | ({batch[0]: batch[1]} if batch else {})
        return self._publish(Manifest(old.number + 1, batches, folders, json.dumps(schema.jsonValue()), self.buckets))

    def append(self, df: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Add rows, whatever their keys."""

        def change(old: Manifest):
            new = self._write(df)
            return {b: old.folders.get(b, []) + new.get(b, []) for b in {*old.folders, *new}}, df.schema

        return self._change(batch, change, df.schema)

    def replace(self, df: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Put other rows in place of all; ``df`` may read the present version."""
        return self._change(batch, lambda old: (self._write(df), df.schema), df.schema)

    def merge(self, df: DataFrame, order_col: str, batch: tuple[str, int] | None = None, insert: bool = True) -> int:
        """Update rows by key: columns of ``df`` that are not null replace the old values; unknown keys are inserted or, without ``insert``, left out.

        Of several rows of a key the last by ``order_col`` counts, which is stored only where the table has such a column. Rows with a null key go nowhere. Only buckets
        that ``df`` has keys in are read and written again; the others' folders are taken over as they are.
        """
        rows = df.where(F.col(f"`{self.key}`").isNotNull())

        def change(old: Manifest):
            schema = StructType.fromJson(json.loads(old.schema)) if old.number else rows.drop(order_col).schema
            last = Window.partitionBy(self.key).orderBy(F.col(order_col).desc())
            newest = rows.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth")
            newest = newest.persist()
            try:
                touched = [r[0] for r in newest.select(self.bucket()).distinct().collect()]  # ``buckets`` numbers at most
                kept = [c for c in newest.columns if c in schema.names and c != self.key]
                new = newest.select(F.col(self.key).alias("_key"), *[F.col(c).alias(f"_new_{i}") for i, c in enumerate(kept)])
                present = self.read(old.number, touched).withColumn("_there", F.lit(True)) if old.number else self.spark.createDataFrame([], schema).withColumn("_there", F.lit(True))
                joined = present.join(new, F.col(self.key) == F.col("_key"), "full" if insert else "left")
                at = {c: f"_new_{i}" for i, c in enumerate(kept)}
                merged = joined.select(*[(F.coalesce(F.col(at[c]), F.col(c)) if c in at else F.coalesce(F.col(c), F.col("_key")) if c == self.key else F.col(c)).alias(c) for c in schema.names])
                written = self._write(merged) if touched else {}
            finally:
                newest.unpersist()
            untouched = {b: fs for b, fs in old.folders.items() if b not in touched}
            return untouched | written, schema

        return self._change(batch, change, rows.schema)

    def sink(self, stream: str, change: str = "append", **more) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function that appends or merges each batch of the stream of that name once.

        A batch that has been published is read all the same, since the stream's state moves on with its rows.
        """

        def write(batch: DataFrame, number: int) -> None:
            table = VersionedTable(batch.sparkSession, self.path, self.key, self.buckets)
            if table.made((stream, number)):
                batch.write.format("noop").mode("overwrite").save()
            else:
                getattr(table, change)(batch, batch=(stream, number), **more)

        return write

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete manifests but the last ``keep``, and folders that none of those names. Not to be run beside a writer."""
        numbers = self.numbers()
        for n in numbers[: max(0, len(numbers) - keep)]:
            self._files.delete(self._at("_manifests", f"{n:010d}.json"), False)
        named = {f for n in self.numbers() for fs in self.manifest(n).folders.values() for f in fs}
        gone = []
        for top in self._files.listStatus(self._hadoop.Path(self.path)):
            name = top.getPath().getName()
            if not name.startswith("v-"):
                continue
            parts = [f"{name}/{s.getPath().getName()}" for s in self._files.listStatus(top.getPath()) if s.isDirectory()]
            if not any(p in named for p in parts):
                self._files.delete(top.getPath(), True)
                gone.append(name)
                continue
            for p in parts:
                if p not in named:
                    self._files.delete(self._at(p), True)
                    gone.append(p)
        return gone
