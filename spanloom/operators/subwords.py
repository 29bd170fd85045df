"""Sub-word tokenizers behind one interface, and training rows made with them.

A tokenizer is a callable from a list of texts to a list of token lists, a token being
(start, end, token, id, special); special tokens and padding are (0, 0, ...). It is made by a factory, once per
task, so that only the factory is shipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.operators import align as L
from spanloom.operators.metrics import label_ids
from spanloom.schemas import BIO, IO

TOKENS = "array<struct<start: int, end: int, token: string, id: int, special: boolean>>"
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("token", pa.string()), ("id", pa.int32()), ("special", pa.bool_())]))
Tokenizer = Callable[[list[str]], list[list[tuple]]]


def from_file(path: str, max_length: int = 128, padded: bool = True, pad_id: int = 0, pad_token: str = "[PAD]") -> Callable[[], Tokenizer]:
    """A factory for a tokenizer file of the tokenizers library, which must be at ``path`` on every executor."""

    def make() -> Tokenizer:
        from tokenizers import Tokenizer as Library

        library = Library.from_file(path)
        library.enable_truncation(max_length)
        if padded:
            library.enable_padding(length=max_length, pad_id=pad_id, pad_token=pad_token)

        def run(texts: list[str]) -> list[list[tuple]]:
            return [
                [(0, 0, t, i, True) if s else (*o, t, i, False) for o, t, i, s in zip(e.offsets, e.tokens, e.ids, e.special_tokens_mask)]
                for e in library.encode_batch(texts)
            ]

        return run

    return make


def encode(df: DataFrame, text_col: str, make: Callable[[], Tokenizer], out: str = "tokens", group: int = 256) -> DataFrame:
    """Adds ``out``: the tokens of each text (of an empty one for null), by an Arrow function."""

    @F.arrow_udf(TOKENS)
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = make()
        for texts in batches:
            made = []
            for k in range(0, len(texts), group):  # as columns, so that a group's tokens are Python objects only while it is made
                part = run([t or "" for t in texts.slice(k, group).to_pylist()])
                offsets, columns = [0], list(zip(*(t for one in part for t in one))) or [()] * 5
                for one in part:
                    offsets.append(offsets[-1] + len(one))
                fields = list(_ARROW.value_type)
                made.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], fields=fields)))
            yield pa.concat_arrays(made) if made else pa.array([], _ARROW)

    return df.withColumn(out, tokens(text_col))


def model_columns(tokens: Column | str, tags: Column, scheme: Mapping[str, int], pad_token: str = "[PAD]", second: Column | None = None) -> list[Column]:
    """``input_ids, attention_mask, token_type_ids, labels`` for a model: padding (``pad_token``) is masked, special tokens have the ignored label.

    The type of a token is 0, and 1 from the character ``second`` on, where a text's second part begins; special tokens have type 0.
    """
    field = lambda name: F.transform(tokens, lambda t: t[name])
    masked = F.transform(tokens, lambda t: F.when(t["special"] & (t["token"] == pad_token), 0).otherwise(1))
    kind = F.transform(tokens, lambda t: F.when(~t["special"] & (t["start"] >= second), 1).otherwise(0)) if second is not None else F.transform(tokens, lambda t: F.lit(0))
    return [field("id").alias("input_ids"), masked.alias("attention_mask"), kind.alias("token_type_ids"), label_ids(tags, scheme, field("special")).alias("labels")]


def align_examples(examples: DataFrame, tokens_col: str = "tokens", scheme: str = "BIO", gold: bool = False, reply_col: str | None = None, shift_col: str | None = None, loose: bool = True) -> DataFrame:
    """Adds ``tags``, ``aligned``, ``truncated``, ``hallucinated``, ``failed`` to rows of a text's tokens and ``modifications`` (span, aspect).

    ``failed`` lists the spans that no token is tagged for (span, aspect, reason): ``not_found`` in the text, ``truncated`` behind the last
    token, or ``no_token`` where others own its tokens.

    With ``reply_col`` and ``shift_col`` spans are looked for in the reply only, so that nothing in the question
    before it matches, and moved by the prefix's length. ``gold`` rows also look
    in the whole text for what the reply does not have, unmoved, and know no truncated spans: what
    owns no token is hallucinated. Blank spans and unknown aspects are left out where there is a reply,
    and for gold; for plain rows a blank span is hallucinated. Without ``loose`` a span must stand in the text as it is.
    """
    rows = L.locate_all(examples, reply_col or "text", "modifications", "_m", skip_blank=gold or reply_col is not None, loose=loose)
    if reply_col and shift_col:
        rows = rows.withColumn("_m", F.transform("_m", lambda m: m.withField("start", m["start"] + F.col(shift_col)).withField("end", m["end"] + F.col(shift_col))))
    if gold and reply_col:
        rows = L.locate_all(rows, "text", "modifications", "_f", skip_blank=True, loose=loose)
        rows = rows.withColumn("_m", F.zip_with("_m", "_f", lambda m, f: F.when(m["start"].isNull(), f).otherwise(m))).drop("_f")
    rows = rows.withColumn("_found", F.filter("_m", lambda m: m["start"].isNotNull()))
    rows = L.align(rows, tokens_col, "_found", scheme, "tags", "aligned", "_owners")
    last = F.coalesce(F.array_max(F.transform(tokens_col, lambda t: t["end"])), F.lit(0))
    cut = F.lit(0) if gold else X.let(last, lambda end: F.size(F.filter("_found", lambda m: m["start"] >= end)))
    rows = rows.withColumn("truncated", cut)
    lost = lambda m, end: F.when(m["start"].isNull(), "not_found").when(F.lit(not gold) & (m["start"] >= end), "truncated").otherwise("no_token")
    failed = X.let(last, lambda end: F.transform(F.filter("_m", lambda m: ~F.array_contains("_owners", m["ord"])), lambda m: F.struct(m["span"].alias("span"), m["aspect"].alias("aspect"), lost(m, end).alias("reason"))))
    rows = rows.withColumn("failed", failed)
    return rows.withColumn("hallucinated", F.size("_m") - F.col("aligned") - F.col("truncated")).drop("_m", "_found", "_owners")


def failed_spans(aligned: DataFrame, id_col: str, most: int | None = None) -> DataFrame:
    """``id, span, aspect, reason`` of the spans that alignment failed; with ``most`` the first of each reason, for a report."""
    rows = X.unnest(aligned, "failed", id_col, pos="ord", item="f").select(id_col, "ord", "f.*")
    if most is None:
        return rows.drop("ord")
    first = Window.partitionBy("reason").orderBy(id_col, "ord")
    return rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).drop("_n", "ord")


def align_for_models(examples: DataFrame, makers: Mapping[str, Callable[[DataFrame], DataFrame]], **how) -> tuple[DataFrame, dict[str, str]]:
    """Gold rows for several tokenizers, with a column ``model``; and the errors of those that could not be made.

    A maker adds ``tokens`` to the examples. It is tried on one example; one that its tokenizer's library, a missing file or
    missing module fails is left out. What fails otherwise (a lost cluster, a wrong column) fails the call.
    """
    out, errors = None, {}
    for name, add in makers.items():
        try:
            add(examples.limit(1)).select("tokens").collect()
            made = align_examples(add(examples), scheme="IO", gold=True, **how).withColumn("model", F.lit(name))
        except (PythonException, ImportError, OSError, ValueError) as e:  # one model's failure is not the others'
            errors[name] = str(e)
            continue
        out = made if out is None else out.unionByName(made, allowMissingColumns=True)
    return out, errors


def model_summary(aligned: DataFrame) -> DataFrame:
    """``model, n_examples, n_tokens, n_tagged, aligned, truncated, hallucinated`` of aligned rows."""
    tagged = F.size(F.filter("tags", lambda t: t != "O"))
    sums = [F.sum(c).alias(c) for c in ("aligned", "truncated", "hallucinated")]
    return aligned.groupBy("model").agg(F.count("*").alias("n_examples"), F.sum(F.size("tags")).alias("n_tokens"), F.sum(tagged).alias("n_tagged"), *sums)


SCHEMES = {"BIO": BIO, "IO": IO}
