"""JSON lines, JSON documents, CSV and YAML in and out."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BAD = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Rows of a JSON lines file.

    Lines that are no JSON are skipped; fields of another type become null and keep
    their row. With ``strict`` any bad line fails the read.
    """
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    rows = spark.read.schema(f"{schema}, {_BAD} string").option("columnNameOfCorruptRecord", _BAD).json(path)
    return rows.where(F.col(_BAD).isNull() | F.try_parse_json(_BAD).isNotNull()).drop(_BAD)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line, kind`` of a text file, kind being ok, bad or blank."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    return lines.withColumn("kind", F.when(F.trim("line") == "", "blank").when(F.try_parse_json("line").isNull(), "bad").otherwise("ok"))


def count_lines(spark: SparkSession, path: str, examples: int = 3) -> dict:
    """Counts of good, bad and blank lines, and the first bad ones."""
    lines = read_lines(spark, path)
    counts = {r["kind"]: r["count"] for r in lines.groupBy("kind").count().collect()}
    bad = [r["line"] for r in lines.where("kind = 'bad'").limit(examples).collect()]
    return {k: counts.get(k, 0) for k in ("ok", "bad", "blank")} | {"examples": bad}


def known_keys(spark: SparkSession, path: str, key: str = "thread_id") -> DataFrame:
    """The distinct keys of a JSON lines file; nothing else is parsed."""
    return read_jsonl(spark, path, f"{key} string").where(F.col(key).isNotNull()).distinct()


def read_results(spark: SparkSession, folder: str, schema: str, pattern: str = "evaluation_results.json") -> DataFrame:
    """Result documents in a tree of folders; ``model``, ``variant`` and ``split`` come from their paths."""
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(folder)
    path = F.col("_metadata.file_path")
    part = lambda k: F.regexp_extract(path, r"([^/]+)/([^/]+)/([^/]+)/[^/]+$", k)
    return rows.select("*", part(1).alias("model"), part(2).alias("variant"), part(3).alias("split"))


def read_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON document that may have several lines."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_channels(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The channel dimension of a (small) YAML file at any path that Spark reads, ``active`` being true by default."""
    import yaml  # optional dependency

    names = [f.split()[0] for f in schema.split(", ")]
    text = spark.read.text(path, wholetext=True).first()
    listed = (yaml.safe_load(text[0] if text else "") or {}).get("channels", [])
    rows = [tuple(True if n == "active" and c.get(n) is None else c.get(n) for n in names) for c in listed]
    return spark.createDataFrame(rows, schema)


def active(channels: DataFrame) -> DataFrame:
    return channels.where(F.coalesce("active", F.lit(True)))


def sse_events(text_col: str, schema: str):
    """The objects of a server-sent event stream's ``data:`` lines, as an array of structs."""
    data = F.filter(F.split(text_col, "\r?\n"), lambda x: F.startswith(x, F.lit("data:")))
    bodies = F.transform(data, lambda x: F.trim(F.substring(x, 6, 1 << 20)))
    good = F.filter(bodies, lambda b: F.try_parse_json(b).isNotNull())
    return F.transform(good, lambda b: F.from_json(b, schema))


def append(df: DataFrame, path: str, form: str = "parquet") -> None:
    df.write.mode("append").format(form).save(path)


def backup(spark: SparkSession, path: str, name: str = "backup") -> str | None:
    """A table's files as they are, copied to ``path.name`` before they are replaced; None where there is no table yet.

    The driver copies: this is for reports and small label files. ``versioned.VersionedTable`` keeps the versions before without a copy.
    """
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsparkSession.sessionState().newHadoopConf()
    source, target = hadoop.Path(path.rstrip("/")), hadoop.Path(f"{path.rstrip('/')}.{name}")
    files = source.getFileSystem(conf)
    if not files.exists(source):
        return None
    files.delete(target, True)
    hadoop.FileUtil.copy(files, source, files, target, False, conf)
    return target.toString()


def overwrite(df: DataFrame, path: str, form: str = "parquet", version: str | None = None) -> str:
    """Replace a table, or write it as a version of its own beside the others, which keeps the old ones."""
    target = f"{path.rstrip('/')}/version={version}" if version else path
    df.write.mode("overwrite").format(form).save(target)
    return target


def write_report_csv(df: DataFrame, path: str) -> None:
    """As ``read_csv`` reads it: quotes inside are doubled."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_document(df: DataFrame, path: str) -> None:
    """A table of a row or a few (statistics, a report) as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file at any path that Spark writes, by the driver."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_label_maps(spark: SparkSession, folder: str, scheme: dict[str, int]) -> None:
    """``label2id.json`` and ``id2label.json`` of a label scheme."""
    folder = folder.rstrip("/")
    write_text(spark, f"{folder}/label2id.json", json.dumps(scheme, ensure_ascii=False))
    write_text(spark, f"{folder}/id2label.json", json.dumps({str(v): k for k, v in scheme.items()}, ensure_ascii=False))


def export_review(df: DataFrame, path: str, columns: Sequence[str] = ()) -> None:
    """Rows that need a review."""
    rows = df.where("needs_review")
    (rows.select(*columns) if columns else rows).write.mode("overwrite").json(path)
