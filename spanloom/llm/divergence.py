"""How far the sources of a language are apart: smoothed term shares, compared by inclusion and exclusion over supports.

A language keeps the terms that enough of its documents have. A group is a source of a
language; its share of a kept term is exact integer arithmetic, so a term that the group
lacks costs the same constant wherever it is lacking. The distance of two groups is a sum over
all kept terms, but none of it is taken over terms that both lack:

* terms of one group only are priced by that group's histogram of counts against the other group's constant,
* terms that both lack are a number times the difference of two constants,
* terms that both have were priced twice above; a join of the sparse postings puts that right.

Nothing is computed for a language's terms times its groups but for what occurs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import broadcast_if, discard, lean, materialize, slices

#: Shares are in parts of this many; each count is raised by so much.
PARTS, RAISED = 1_000_000_000, 5
#: Counted terms that a task holds before it hands them on.
HELD = 300_000
#: Texts that are Python objects at a time, and rows of a batch that is handed on.
GROUP_TEXTS, GROUP_ROWS = 512, 50_000
#: Rows of the table of groups that are broadcast; a larger table is shuffled.
BROADCAST_GROUPS = 100_000

#: A-Z to lower case, other bytes below 0x80 but letters to blanks; the bytes of all other characters stay.
_TO_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """The runs of ASCII letters and non-ASCII characters of a UTF-8 text, A-Z lower-cased."""
    return text.translate(_TO_TERMS).split()


def count_terms(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs`` of ``lang, source, text``: occurrences and documents, summed up within tasks only."""

    def rows(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, within) in held.items():
            found = list(n)
            for k in range(0, len(found), GROUP_ROWS):
                part = found[k : k + GROUP_ROWS]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()),
                        pa.array([n[t] for t in part], pa.int64()), pa.array([within[t] for t in part], pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in slices(batches, GROUP_TEXTS):
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                n, within = held.setdefault((lang, source), (Counter(), Counter()))
                found, before = terms(text), len(n)
                n.update(found)
                within.update(set(found))
                size += len(n) - before
            if size > HELD:
                yield from rows(held)
                held, size = {}, 0
        yield from rows(held)

    return docs.select("lang", "source", "text").mapInArrow(lean(run), "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(PARTS * (count + RAISED) / (total + RAISED * kept)), exactly: a long division, three digits at a time, in 64 bits."""
    over = total + RAISED * kept
    whole, rest = F.lit(0).cast("long"), count + RAISED
    for _ in range(3):
        whole, rest = whole * 1000 + F.call_function("div", rest * 1000, over), F.pmod(rest * 1000, over)
    return F.when(kept > 0, whole + 1).otherwise(F.lit(0).cast("long"))


def audit_sources(docs: DataFrame, min_docs: int = 30, top: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang, source, part, item, value, rank``: for each group its distance to each other source of its language
    (part ``pair``), and the ``top`` terms of which it has a larger share than its language (part ``term``).

    A null text, language or source is an empty one; such groups take part. A row is a document, so repeated rows
    count each. Groups without terms are compared like others; where a language keeps no term, all its distances are 0
    and it has no rows of part ``term``. Ties rank by the item's UTF-8 bytes. An empty table gives no rows; other columns are not read.
    """
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    slim = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))

    # One shuffle by (lang, term) serves the sums, the document counts of the language and its own counts.
    counted = count_terms(slim).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    counted = counted.withColumn("lang_n", F.sum("n").over(term)).withColumn("lang_docs", F.sum("docs").over(term))
    counted = counted.withColumn("head", (F.row_number().over(term.orderBy("source")) == 1).cast("long"))
    found = materialize(counted.where(F.col("lang_docs") >= min_docs).drop("docs", "lang_docs"), "postings")

    languages = found.groupBy("lang").agg(F.sum("head").alias("kept"), F.sum("n").alias("lang_total"))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = slim.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(languages, "lang", "left")
    groups = groups.select("lang", "source", *[zero(c) for c in ("total", "support", "kept", "lang_total")])
    groups = materialize(groups.withColumn("lacking", share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))), "groups")
    small = broadcast_if(groups, groups.count(), BROADCAST_GROUPS)

    priced = found.join(small, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))
    result = _pairs(priced, groups, small).unionByName(_terms(priced, top))
    result = materialize(result, "audit")
    discard(found, groups)
    return result


def _pairs(priced: DataFrame, groups: DataFrame, small: DataFrame) -> DataFrame:
    """Distances of all pairs of groups of a language, as sums of the three kinds of contributions."""
    other = small.select("lang", F.col("source").alias("item"), *[F.col(c).alias(f"other_{c}") for c in ("support", "lacking")])
    off = lambda a, b: F.abs(F.col(a) - F.col(b))
    both_lack = groups.join(other, "lang").where(F.col("source") != F.col("item"))
    both_lack = both_lack.select("lang", "source", "item", ((F.col("kept") - F.col("support") - F.col("other_support")) * off("lacking", "other_lacking")).alias("v"))

    # As many rows as groups have different counts, each with the number of terms that have it.
    histogram = priced.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    one_sided = histogram.join(other, "lang").where(F.col("source") != F.col("item"))
    one_sided = one_sided.groupBy("lang", "source", "item").agg(F.sum(F.col("k") * off("p", "other_lacking")).alias("v"))

    a = priced.select("lang", "term", "source", "p", "lacking")
    b = priced.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("lacking").alias("other_lacking"))
    met = a.join(b, ["lang", "term"]).where(F.col("source") < F.col("item"))
    overlap = met.groupBy("lang", "source", "item").agg(F.sum(off("p", "q") - off("p", "other_lacking") - off("q", "lacking") + off("lacking", "other_lacking")).alias("v"))

    # What is priced for (A, B) counts for (B, A) as well.
    ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("way")
    parts = both_lack.unionByName(one_sided.unionByName(overlap).select("lang", "v", ways).select("lang", "way.*", "v"))
    sums = parts.groupBy("lang", "source", "item").agg(F.sum("v").alias("value"))
    return _ranked(sums.withColumn("part", F.lit("pair")))


def _terms(priced: DataFrame, top: int) -> DataFrame:
    """Terms of which a group has more than its language; only the ``top`` of a group's rows in a task are shuffled."""
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    more = priced.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - q).alias("value")).where("value > 0")
    return _ranked(more).where(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank"))
