"""Spans from tag sequences (an array of tags in each row), and which span each token is in.

Decoding stays inside the row: nothing is exploded or shuffled until a caller asks for
rows of spans. Three decoders stand side by side because they give different metrics.
Ends are inclusive token places.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from spanloom.functions import text as X

_KEY = "example_id"
SPANS = "array<struct<aspect: string, start: int, end: int>>"


def aspect_of(tag: Column) -> Column:
    """What stands behind ``B-`` or ``I-``; nothing for ``O``."""
    return F.substring(tag, 3, 64)


def before(tags: Column) -> Column:
    """The tag before each one; ``O`` before the first."""
    return F.slice(F.concat(F.array(F.lit("O")), tags), 1, F.size(tags))


def _decoder(begins: Callable[..., np.ndarray], ends: Callable[..., np.ndarray]):
    """An Arrow function: a span from each tag that begins one up to the next one that begins or ends.

    ``begins`` and ``ends`` are asked once for all tags of a batch, with numpy arrays: whether a tag is null, ``O``, has ``B-``, has ``I-``, its number and
    its aspect's, and the same of the tag before it (``O`` before a row's first).
    """

    @F.arrow_udf(ArrayType(StructType([StructField("aspect", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])))
    def decode(tags: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(tags), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = tags.flatten().dictionary_encode(null_encoding="encode")
        listed = [*coded.dictionary.to_pylist(), "O"]
        aspects = list(dict.fromkeys((t or "")[2:66] for t in listed))
        number = {a: i for i, a in enumerate(aspects)}
        kinds = np.array([(t is None, t == "O", (t or "").startswith("B-"), (t or "").startswith("I-"), listed.index(t), number[(t or "")[2:66]]) for t in listed], np.int32)
        code = coded.indices.to_numpy(zero_copy_only=False)
        first = (np.cumsum(sizes) - sizes)[sizes > 0]
        before = np.append(0, code[:-1])[: len(code)]
        before[first] = len(listed) - 1
        now, last = kinds[code].T, kinds[before].T
        opens = (now[0] == 0) & begins(now, last)
        marks = np.flatnonzero(opens | ((now[0] == 0) & ends(now, last)))
        row = np.repeat(np.arange(len(sizes)), sizes)[marks]
        stop = np.append(marks[1:], len(code))[: len(marks)]
        stop = np.minimum(stop, np.cumsum(sizes)[row])  # the next one, or the row's end
        kept = opens[marks]
        marks, stop, row = marks[kept], stop[kept], row[kept]
        start = (np.cumsum(sizes) - sizes)[row]
        aspect = pa.DictionaryArray.from_arrays(pa.array(now[5][marks], pa.int32()), pa.array(aspects, pa.string())).cast(pa.string())
        made = pa.StructArray.from_arrays([aspect, pa.array((marks - start).astype(np.int32)), pa.array((stop - 1 - start).astype(np.int32))], ["aspect", "start", "end"])
        offsets = np.append(0, np.cumsum(np.bincount(row, minlength=len(sizes)))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), made)
        return pc.if_else(tags.is_valid(), lists, pa.scalar(None, lists.type)) if tags.null_count else lists

    return decode


_NULL, _OUT, _B, _I, _TAG, _ASPECT = range(6)
_strict = _decoder(lambda t, b: t[_B] == 1, lambda t, b: ~((t[_I] == 1) & (t[_ASPECT] == b[_ASPECT])))
_lenient = _decoder(
    lambda t, b: (t[_OUT] == 0) & ((t[_B] == 1) | (b[_NULL] == 0) & ((b[_OUT] == 1) | (t[_ASPECT] != b[_ASPECT]))),
    lambda t, b: t[_OUT] == 1,
)
_runs = _decoder(lambda t, b: (t[_OUT] == 0) & (b[_NULL] == 0) & (t[_TAG] != b[_TAG]), lambda t, b: t[_OUT] == 1)


def decode_strict(df: DataFrame, tag_col: str = "tags", out: str = "spans") -> DataFrame:
    """Spans opened by B- and continued by I- of the same aspect; an I- without its B- is nothing."""
    return df.withColumn(out, _strict(tag_col))


def decode_lenient(df: DataFrame, tag_col: str = "tags", out: str = "spans") -> DataFrame:
    """As ``decode_strict``, but an I- behind O or another aspect opens a span (conlleval chunking)."""
    return df.withColumn(out, _lenient(tag_col))


def decode_io(df: DataFrame, tag_col: str = "tags", out: str = "spans") -> DataFrame:
    """Runs of one and the same tag other than O."""
    return df.withColumn(out, _runs(tag_col))


def io_to_bio(tags: Column) -> Column:
    """The tags with B- at the start of every run of an aspect."""
    begins = lambda t, b: (b == "O") | (aspect_of(t) != aspect_of(b))
    return F.zip_with(tags, before(tags), lambda t, b: F.when(t == "O", "O").otherwise(F.concat(F.when(begins(t, b), "B-").otherwise("I-"), aspect_of(t))))


def rows_of(df: DataFrame, spans_col: str = "spans", key: str = _KEY) -> DataFrame:
    """A row for each span: ``example_id, aspect, start, end``."""
    return X.unnest(df, spans_col, key, item="s").select(key, "s.*")


@F.arrow_udf(ArrayType(StructType([StructField("first", IntegerType()), StructField("n", IntegerType())])))
def _stretches(starts: pa.Array, ends: pa.Array, other_starts: pa.Array, other_ends: pa.Array) -> pa.Array:
    """For each span of a row the stretch of the other side's spans that share a token with it.

    Both sides are in order and apart, so two sorted searches over a whole batch find all stretches: rows are kept apart by adding
    a row's number times more than any place to its places.
    """
    apart = 1 + max((int(c.values.to_numpy(zero_copy_only=False).max(initial=0)) for c in (ends, other_ends)), default=0)

    def places(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        size = np.diff(column.offsets.to_numpy()).astype(np.int64)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return flat + np.repeat(np.arange(len(size)) * apart, size), size

    (begin, size), (end, _), (other_begin, other_size), (other_end, _) = map(places, (starts, ends, other_starts, other_ends))
    first = np.searchsorted(other_end, begin, "left")
    n = np.searchsorted(other_begin, end, "right") - first
    first = first - np.repeat(np.cumsum(other_size) - other_size, size)
    values = pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(n, pa.int32())], ["first", "n"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), values)


def meeting(df: DataFrame, spans_col: str, other_col: str, out: str) -> DataFrame:
    """Adds ``out``: for each span of an array a struct (s, met) of it and the other array's spans that share a token with it, in order.

    Spans are in order and apart, as the decoders give them; a null array has none. Linear in the spans, whatever the length of the text.
    """
    some = lambda c: F.coalesce(F.col(c), F.array().cast(SPANS))
    at = lambda c, k: F.transform(some(c), lambda s: s[k])
    rows = df.withColumn("_at", _stretches(at(spans_col, "start"), at(spans_col, "end"), at(other_col, "start"), at(other_col, "end")))
    made = F.zip_with(some(spans_col), "_at", lambda s, x: F.struct(s.alias("s"), F.slice(some(other_col), x["first"] + 1, x["n"]).alias("met")))
    return rows.withColumn(out, made).drop("_at")
