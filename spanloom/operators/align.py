"""Finding spans in texts and aligning them to tokens as BIO or IO tags."""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from spanloom.functions import text as X
from spanloom.schemas import ASPECTS

SPAN = "struct<start: int, end: int, tier: int>"


def words(text: Column | str) -> Column:
    """The words between white space, an empty array for a null text. Splitting is linear; ``regexp_extract_all`` copies the whole text for each match."""
    return F.array_remove(F.split(F.coalesce(X.col(text), F.lit("")), r"(?U)\s+", -1), "")


#: White space in Unicode's sense, as Java's ``(?U)\\s`` has it.
_SPACES = np.array([*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
_IS_SPACE = np.isin(np.arange(0x3001), _SPACES)
_TOKEN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("token", pa.string())])


def _cut_words(texts: pa.Array, limit: int | None) -> pa.Array:
    """The words of each text (none of a null one) and their places, all texts at once."""
    texts = pc.fill_null(texts, "")
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), "<u4")
    held = np.append(~_IS_SPACE[np.minimum(codes, 0x3000)] | (codes > 0x3000), False)
    first = np.cumsum(sizes) - sizes  # where the texts begin
    begins, ends = held[:-1].copy(), held[:-1] & ~held[1:]
    begins[1:] &= ~held[:-2]
    begins[first[sizes > 0]] = held[first[sizes > 0]]
    lasts = (first + sizes - 1)[sizes > 0]
    ends[lasts] = held[lasts]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(first + sizes, start, "right")
    held = held[:-1]
    if limit:
        n = np.bincount(row, minlength=len(sizes))
        kept = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) < limit
        start, end, row = start[kept], end[kept], row[kept]
        edges = np.zeros(len(codes) + 1, np.int8)
        np.add.at(edges, start, 1)
        np.add.at(edges, end, -1)
        held = np.cumsum(edges[:-1]) > 0
    width = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000).astype(np.int64)
    upto = np.append(0, np.cumsum(width))
    letters = np.ascontiguousarray(codes[held]).tobytes().decode("utf-32-le").encode()
    offsets = np.append(0, np.cumsum(upto[end] - upto[start])).astype(np.int32)
    token = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(letters))
    places = [pa.array((x - first[row]).astype(np.int32)) for x in (start, end)]
    lists = np.append(0, np.cumsum(np.bincount(row, minlength=len(sizes)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays([*places, token], fields=list(_TOKEN)))


#: What RE2's ``\\s`` means, which is less than white space in Unicode's sense.
_IS_BLANK = np.isin(np.arange(256), [9, 10, 12, 13, 32])


def word_sizes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of each word between ASCII blanks, of all texts one behind the other, and how many words each text has (0 for null)."""
    texts = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.string())])
    if not len(texts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends -= ends[0]
    held = ~_IS_BLANK[data]
    begins, stops = held.copy(), held.copy()
    begins[1:] &= ~held[:-1]
    stops[:-1] &= ~held[1:]
    some = ends[:-1] < ends[1:]
    first, last = ends[:-1][some], ends[1:][some] - 1
    begins[first], stops[last] = held[first], held[last]
    begins, stops = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    upto = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    return upto[stops] - upto[begins], np.diff(np.searchsorted(begins, ends))


def _in_parts(texts: pa.Array, chars: int = 2_000_000) -> Iterator[pa.Array]:
    """The array in slices of about so many bytes."""
    upto, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)), 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + chars, "right")))
        yield texts.slice(at, stop - at)
        at = stop


def tokenize(df: DataFrame, text_col: str, out: str = "tokens", limit: int | None = None) -> DataFrame:
    """Adds ``out``: an array of (start, end, token), the words between white space with their code point offsets.

    With ``limit`` only the first words. An Arrow function cuts the texts of a batch together, a few million characters at a time; nothing leaves the row.
    """

    @F.arrow_udf("array<struct<start: int, end: int, token: string>>")
    def cut(texts: pa.Array) -> pa.Array:
        made = [_cut_words(part, limit) for part in _in_parts(texts)]
        return pa.concat_arrays(made) if made else pa.array([], pa.list_(_TOKEN))

    return df.withColumn(out, cut(F.col(text_col).cast("string")))


def tokens(df: DataFrame, id_col: str, text_col: str, limit: int | None = None) -> DataFrame:
    """``example_id, pos, start, end, token``: a row for each token."""
    rows = tokenize(df.select(F.col(id_col).alias("example_id"), F.col(text_col).alias("_text")), "_text", "t", limit)
    return X.unnest(rows, "t", "example_id", pos="pos", item="t").select("example_id", "pos", "t.*")


def locate_exact(text: Column, span: Column) -> Column:
    """The first exact occurrence as (start, end, tier 1); null where there is none or the span is empty."""
    at = X.find(text, span)
    return F.when((span != "") & (at >= 0), F.struct(at.alias("start"), (at + F.length(span)).alias("end"), F.lit(1).alias("tier")))


def locate_edge(text: Column, span: Column) -> Column:
    """The first occurrence without edge marks, as tier 3."""
    bare = X.strip_marks(span)
    at = X.find(text, bare)
    return F.when((bare != "") & (bare != span) & (at >= 0), F.struct(at.alias("start"), (at + F.length(bare)).alias("end"), F.lit(3).alias("tier")))


_BLANKS = re.compile(r"\s+")


def _places(text: str, script: tuple[int, int], fold: Mapping[int, str]) -> tuple[str, list[int]]:
    """Normalized text and the offset in ``text`` that each of its characters comes from."""
    out: list[str] = []
    at: list[int] = []
    for i, ch in enumerate(text):
        if ch.isspace():
            if out and out[-1] != " ":
                out.append(" ")
                at.append(i)
        elif ch == "_" or unicodedata.category(ch)[0] in "LN" or script[0] <= ord(ch) <= script[1]:
            out.append(ch.translate(fold))
            at.append(i)
    if out and out[-1] == " ":
        out.pop()
        at.pop()
    return "".join(out), at


def locate_loose(text: str, span: str, script: tuple[int, int] = X.SCRIPT) -> tuple[int, int, int] | None:
    """Tiers 2 to 4 for a span that does not occur as it is: white space, edge marks, normal form; offsets are the text's own."""
    collapsed = _BLANKS.sub(" ", span).strip()
    if collapsed:
        pattern = r"\s+".join(map(re.escape, collapsed.split(" ")))
        if m := re.search(pattern, text):
            return m.start(), m.end(), 2
    bare = span.strip(X.EDGE_MARKS)
    if bare and bare != span and (at := text.find(bare)) >= 0:
        return at, at + len(bare), 3
    fold = str.maketrans(X.FINAL_LETTERS, X.FOLDED_LETTERS)
    target, _ = _places(span, script, fold)
    normal, places = _places(text, script, fold)
    if target and (at := normal.find(target)) >= 0:
        return places[at], places[at + len(target) - 1] + 1, 4
    return None


def locate(df: DataFrame, text_col: str, span_col: str) -> DataFrame:
    """``df`` with ``located`` (start, end, tier) or null, in one pass.

    Exact hits are found in the JVM; the Arrow function gets a null for them and looks for the others only.
    """

    @F.pandas_udf(SPAN)
    def loose(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        found = [locate_loose(t, s) if t and s else None for t, s in zip(texts, spans)]
        return pd.DataFrame([f or (None, None, None) for f in found], columns=["start", "end", "tier"]).astype("Int32")

    rows = df.withColumn("_exact", locate_exact(F.col(text_col), F.col(span_col)).cast(SPAN))
    missed = F.col("_exact").isNull()
    rows = rows.withColumn("_loose", loose(F.when(missed, F.col(text_col)), F.when(missed, F.col(span_col))))
    return rows.withColumn("located", F.coalesce("_exact", F.when(F.col("_loose.start").isNotNull(), F.col("_loose")))).drop("_exact", "_loose")


def locate_all(df: DataFrame, text_col: str, mods_col: str, out: str = "located", skip_blank: bool = True, loose: bool = True) -> DataFrame:
    """Adds ``out``: an array of (ord, span, aspect, start, end, tier) of the modifications (span, aspect, ...) with a known aspect.

    Without ``loose`` spans are found as they are only (tier 1), and no row goes through the Arrow function.

    Places are null where the text does not have the span. Blank spans are left out with ``skip_blank``, else not found.
    Only rows with a span that does not stand in its text as it is go through the Arrow function.
    """

    @F.pandas_udf(f"array<{SPAN}>")
    def find_loose(texts: pd.Series, spans: pd.Series) -> pd.Series:
        keys = ("start", "end", "tier")
        one = lambda t, s: dict(zip(keys, locate_loose(t, s) or (None,) * 3)) if t and s else None
        return pd.Series([None if ss is None else [one(t, s) for s in ss] for t, ss in zip(texts, spans)])

    known = F.transform(F.filter(mods_col, lambda m: F.upper(X.strip(m["aspect"])).isin(*ASPECTS) & (F.lit(not skip_blank) | (X.strip(m["span"]) != ""))),
                        lambda m, i: F.struct(i.cast("long").alias("ord"), X.strip(m["span"]).alias("span"), F.upper(X.strip(m["aspect"])).alias("aspect")))
    rows = df.withColumn("_known", F.coalesce(known, F.array().cast("array<struct<ord: bigint, span: string, aspect: string>>")))
    rows = rows.withColumn("_exact", F.transform("_known", lambda m: locate_exact(F.col(text_col), m["span"]).cast(SPAN)))
    missed = F.exists("_exact", lambda e: e.isNull())
    wanted = F.zip_with("_known", "_exact", lambda m, e: F.when(e.isNull(), m["span"]))
    rows = rows.withColumn("_loose", find_loose(F.when(missed, F.col(text_col)), F.when(missed, wanted)) if loose else F.lit(None).cast(f"array<{SPAN}>"))
    at = F.zip_with("_exact", F.coalesce("_loose", F.transform("_known", lambda m: F.lit(None).cast(SPAN))), lambda e, l: F.coalesce(e, l))
    made = F.zip_with("_known", at, lambda m, p: F.struct(m["ord"].alias("ord"), m["span"].alias("span"), m["aspect"].alias("aspect"), p["start"].alias("start"), p["end"].alias("end"), p["tier"].alias("tier")))
    return rows.withColumn(out, made).drop("_known", "_exact", "_loose")


#: Characters of spans that one automaton holds, and rows of spans that are broadcast.
AUTOMATON_CHARS, BROADCAST_SPANS = 16_000_000, 1_000_000
_automata: dict[str, object] = {}


def _automaton(key: str, listed: Sequence[str]):
    """The automaton of a list of strings, compiled once in each worker; the last one is kept."""
    if key not in _automata:
        import ahocorasick

        _automata.clear()
        made = ahocorasick.Automaton()
        for i, span in enumerate(listed):
            made.add_word(span, i)
        if listed:
            made.make_automaton()
        _automata[key] = made
    return _automata[key]


def span_finder(spark: SparkSession, listed: Sequence[str]) -> Callable[[Column | str], Column]:
    """A column function: the numbers of the strings that stand in a text, in one scan of it, whatever their length.

    The strings are broadcast and compiled to an Aho-Corasick automaton in each worker, so a text costs its length and its hits.
    """
    shared, key = spark.sparkContext.broadcast(list(listed)), uuid.uuid4().hex

    @F.arrow_udf("array<int>")
    def find(texts: pa.Array) -> pa.Array:
        automaton = _automaton(key, shared.value)
        found = [sorted({i for _, i in automaton.iter(t)}) if t and len(automaton) else [] for t in texts.to_pylist()]
        return pa.array(found, pa.list_(pa.int32()))

    return find


def find_spans(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str, chars: int = AUTOMATON_CHARS) -> DataFrame:
    """``example_id, text`` and the columns of ``spans`` (one is ``span``) for each row of spans that a text holds.

    Spans of any length are found, inside words too; empty and null ones, and null texts, are not. Repeated rows of either side stay
    repeated. Spans of up to ``chars`` characters in all are one automaton; more are dealt to several by their
    hash, each of which scans the texts once, so that none outgrows a worker. The texts are not shuffled, and only the text goes to Python.
    """
    spark = docs.sparkSession
    wanted = spans.where(F.length("span") > 0)
    kinds = wanted.groupBy("span").agg(F.count("*").alias("_c"))
    total, rows_of_spans = kinds.agg(F.coalesce(F.sum(F.length("span")), F.lit(0)), F.coalesce(F.sum("_c"), F.lit(0))).first()
    passes = max(1, -(-total // chars))
    rows, found = docs.select(F.col(id_col).alias("example_id"), F.col(text_col).alias("text")), None
    for k in range(passes):
        listed = sorted(r[0] for r in kinds.where(F.pmod(F.xxhash64("span"), F.lit(passes)) == k).select("span").toLocalIterator())
        numbers = spark.createDataFrame(list(enumerate(listed)), "_n int, _span string")
        here = wanted.join(F.broadcast(numbers), F.col("span") == F.col("_span")).drop("_span")  # ``chars`` characters at most
        here = F.broadcast(here) if rows_of_spans <= BROADCAST_SPANS else here
        hits = X.unnest(rows.withColumn("_hits", span_finder(spark, listed)("text")), "_hits", "example_id", "text", item="_n")
        one = hits.join(here, "_n").drop("_n")
        found = one if found is None else found.unionByName(one)
    return found


@F.arrow_udf(ArrayType(IntegerType()))
def _owners(starts: pa.Array, ends: pa.Array, span_starts: pa.Array, span_ends: pa.Array, ords: pa.Array) -> pa.Array:
    """For each token twice the place of the first span that overlaps it, and 1 more for the first token of a span; -1 for none.

    Tokens and spans are both in order of their places, so a span's tokens are one stretch, found by bisection: a row costs its tokens, its
    spans and what these cover. Tokens that are out of order are put in order first.
    """
    out = []
    for t0, t1, s0, s1, names in zip(*(_lists(c) for c in (starts, ends, span_starts, span_ends, ords))):
        if t0 is None or s0 is None:
            out.append(None)
            continue
        real = np.flatnonzero(t1 > t0)  # special tokens have no place
        real = real[np.argsort(t0[real], kind="stable")]
        begin, end = t0[real], t1[real]
        first, last = np.searchsorted(np.maximum.accumulate(end) if len(end) else end, s0, "right"), np.searchsorted(begin, s1, "left")
        codes, seen = np.full(len(real), -1, np.int32), set()
        for k in range(len(s0)):  # in order of priority
            part = slice(first[k], max(first[k], last[k]))
            mine = np.flatnonzero((codes[part] < 0) & (end[part] > s0[k])) + part.start
            if len(mine):
                codes[mine] = 2 * k
                if names[k] not in seen:
                    codes[mine[real[mine].argmin()]] += 1
                    seen.add(names[k])
        whole = np.full(len(t0), -1, np.int32)
        whole[real] = codes
        out.append(whole)
    return pa.array(out, pa.list_(pa.int32()))


def _lists(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The lists of a column as arrays over its flat values; None for null."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for i, null in enumerate(column.is_null().to_pylist()):
        yield None if null else values[offsets[i] : offsets[i + 1]]


def align(df: DataFrame, tokens_col: str, spans_col: str, scheme: str = "BIO", out: str = "tags", aligned: str | None = None, owners: str | None = None) -> DataFrame:
    """Adds ``out``: a tag for each token of an array of (start, end, ...), from an array of spans (ord, start, end, aspect).

    ``aligned`` names a column for the number of spans that have a token of their own, ``owners`` one for their ords. Special tokens are (0, 0) and get ``O``.

    A token belongs to the first span, by ``ord``, that overlaps it; a span's first own token
    begins it (BIO). Row-local: no token is exploded or shuffled, and rows without spans don't leave the JVM.
    """
    spans = F.array_sort(F.transform(spans_col, lambda s: F.struct(s["ord"].alias("ord"), s["start"].alias("start"), s["end"].alias("end"), s["aspect"].alias("aspect"))))
    none = F.array().cast("array<struct<ord: bigint, start: int, end: int, aspect: string>>")
    rows = df.withColumn("_spans", F.coalesce(spans, none))
    some = lambda c, f: F.when(F.size("_spans") > 0, F.transform(c, f))
    codes = _owners(
        some(tokens_col, lambda t: t["start"].cast("int")), some(tokens_col, lambda t: t["end"].cast("int")),
        some("_spans", lambda s: s["start"].cast("int")), some("_spans", lambda s: s["end"].cast("int")), some("_spans", lambda s: s["ord"].cast("long")),
    )
    rows = rows.withColumn("_codes", codes)
    kind = (lambda c: F.when(c % 2 == 1, "B-").otherwise("I-")) if scheme == "BIO" else (lambda c: F.lit("I-"))
    tags = F.transform("_codes", lambda c: F.when(c < 0, "O").otherwise(F.concat(kind(c), F.get("_spans", F.shiftright(c, 1))["aspect"])))
    rows = rows.withColumn(out, F.coalesce(tags, F.transform(tokens_col, lambda t: F.lit("O"))))
    begun = F.coalesce(F.filter("_codes", lambda c: (c >= 0) & (c % 2 == 1)), F.array().cast("array<int>"))
    if aligned:
        rows = rows.withColumn(aligned, F.size(begun))
    if owners:
        rows = rows.withColumn(owners, F.transform(begun, lambda c: F.get("_spans", F.shiftright(c, 1))["ord"]))
    return rows.drop("_spans", "_codes")


def alignment_stats(rows: DataFrame) -> DataFrame:
    """One row of sums over aligned rows (``aligned, truncated, hallucinated``): their number of spans, and rates."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    total = F.col("aligned") + F.col("truncated") + F.col("hallucinated")
    rate = lambda c: F.coalesce(F.try_divide(F.col(c), total), F.lit(0.0))
    sums = rows.agg(zero("aligned"), zero("truncated"), zero("hallucinated"))
    return sums.select(total.alias("n_spans"), "aligned", "truncated", "hallucinated", rate("aligned").alias("alignment_rate"), rate("hallucinated").alias("hallucination_rate"))


def keyword_spans(text: Column | str, keywords: Mapping[str, Sequence[str]]) -> Column:
    """The first occurrence of each keyword as an array of (ord, start, end, aspect); the order of aspects and keywords is their priority."""
    listed = [(a, k) for a, ks in keywords.items() for k in ks]
    at = lambda k: X.find(text, F.lit(k))
    each = [F.when(at(k) >= 0, F.struct(F.lit(i).cast("long").alias("ord"), at(k).alias("start"), (at(k) + len(k)).alias("end"), F.lit(a).alias("aspect"))) for i, (a, k) in enumerate(listed)]
    return F.filter(F.array(*each), lambda s: s.isNotNull())


#: Characters of a text that meet in one group of ``transfer_labels``.
STRETCH = 1024


def transfer_labels(base: DataFrame, target: DataFrame) -> DataFrame:
    """Labels of tokens (``example_id, start, end, label`` id, 0 for none) to another tokenizer's tokens (``example_id, pos, start, end``).

    A token gets the most frequent label but 0 among the tokens that overlap it, the smallest on ties, else 0.
    Tokens meet by the stretches of text that they touch, so the join is by equality and a long text is many groups.
    """
    touched = F.explode(F.sequence(F.floor(F.col("start") / STRETCH), F.floor(F.greatest("start", F.col("end") - 1) / STRETCH))).alias("stretch")
    b = base.where("label != 0").select("example_id", F.col("start").alias("b_start"), F.col("end").alias("b_end"), "label", touched)
    t = target.select("example_id", "pos", "start", "end", touched)
    hit = t.join(b, ["example_id", "stretch"]).where((F.col("start") < F.col("b_end")) & (F.col("end") > F.col("b_start")))
    # A pair that shares several stretches counts in the first of them.
    hit = hit.where(F.col("stretch") == F.floor(F.greatest("start", "b_start") / STRETCH))
    best = (
        hit.groupBy("example_id", "pos", "label").agg(F.count("*").alias("n"))
        .groupBy("example_id", "pos").agg(F.max(F.struct("n", (-F.col("label")).alias("neg"))).alias("best"))
        .select("example_id", "pos", (-F.col("best.neg")).alias("label"))
    )
    return target.join(best, ["example_id", "pos"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


@F.arrow_udf(ArrayType(IntegerType()))
def _main_labels(starts: pa.Array, ends: pa.Array, labels: pa.Array, to_starts: pa.Array, to_ends: pa.Array) -> pa.Array:
    """For each token of the second grid the most frequent label but 0 among the first grid's tokens that overlap it, the smallest on ties."""
    flat = lambda c: c.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes, to_sizes = (pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (starts, to_starts))
    start, end, label, to_start, to_end = map(flat, (starts, ends, labels, to_starts, to_ends))
    apart = 2 + max(int(end.max(initial=0)), int(to_end.max(initial=0)))  # rows are kept apart by it
    move, to_move = (np.repeat(np.arange(len(n)) * apart, n) for n in (sizes, to_sizes))
    first = np.searchsorted(end + move, to_start + to_move, "right")
    n = np.maximum(0, np.searchsorted(start + move, to_end + to_move, "left") - first)
    token = np.repeat(np.arange(len(n)), n)
    met = label[np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
    token, met = token[met != 0], met[met != 0]
    order = np.lexsort((met, token))
    token, met = token[order], met[order]
    new = np.flatnonzero(np.append(True, (np.diff(token) != 0) | (np.diff(met) != 0))) if len(token) else np.empty(0, np.int64)
    times = np.diff(np.append(new, len(token)))
    token, met = token[new], met[new]
    order = np.lexsort((-met, times, token))  # a token's last one is its best
    out = np.zeros(len(to_start), np.int32)
    out[token[order]] = met[order]
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(to_sizes)), pa.int32()), pa.array(out))


def transfer_in_rows(df: DataFrame, base_col: str, target_col: str, out: str = "labels") -> DataFrame:
    """``transfer_labels`` for arrays in one row: of (start, end, label), in order and apart, to those of (start, end). Nothing is shuffled."""
    part = lambda c, k: F.transform(c, lambda t: t[k].cast("int"))
    return df.withColumn(out, _main_labels(*[part(base_col, k) for k in ("start", "end", "label")], *[part(target_col, k) for k in ("start", "end")]))


def word_labels(word_ids: Column, tags: Column) -> Column:
    """Word tags to sub-tokens (an array of each sub-token's word): the first keeps B-, later ones get I-; O where the word has no tag."""
    last = F.slice(F.concat(F.array(F.lit(-1)), word_ids), 1, F.size(word_ids))
    tag = lambda ts, w: F.coalesce(F.get(ts, w), F.lit("O"))
    return X.let(tags, lambda ts: F.zip_with(word_ids, last, lambda w, b: F.when(w == b, F.regexp_replace(tag(ts, w), "^B-", "I-")).otherwise(tag(ts, w))))


def pad(ids: Column, length: int, fill: int) -> Column:
    """An array cut or filled to a fixed length."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(fill), length)), 1, length)


def predict_tokens(df: DataFrame, id_col: str, text_col: str, tagger) -> DataFrame:
    """``example_id, tags``, by a pluggable model: ``tagger()`` is made once per task and called with lists of texts; it returns a list of tags for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tagger()
        for batch in batches:
            tags = [list(t) for t in model(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tags, pa.list_(pa.string()))], ["example_id", "tags"])

    slim = df.select(F.col(id_col).alias("example_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"example_id {slim.schema['example_id'].dataType.simpleString()}, tags array<string>")
