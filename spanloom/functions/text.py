"""Text functions as column expressions (no Python on the executors)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points of the target script by default (first, last), and its five final letters with what they fold to.
SCRIPT = (0x0590, 0x05FF)
FINAL_LETTERS, FOLDED_LETTERS = "ךםןףץ", "כמנפצ"
# Marks that the span locator and the light check take off a span's edges.
EDGE_MARKS = ".,!?;:'\"()[]{}…–—\u200f\u200e·• "
LIGHT_MARKS = " \t\n\r.,!?;:\"'`׳״()[]{}"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column | str, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it.

    Needed wherever a computed column is named inside a lambda: projections are merged, and the
    column's expression would be evaluated again for every element.
    """
    return F.get(F.transform(F.array(col(value)), then), F.lit(0))


def unnest(df: DataFrame, array_col: str, *keep: str, pos: str | None = None, item: str = "item") -> DataFrame:
    """A row for each element of an array: the columns ``keep``, its place (if ``pos`` names one) and itself.

    A plain explode makes the optimizer ask for non-empty arrays first, which evaluates all that they are computed from twice.
    """
    rows = df.select(*keep, F.posexplode_outer(array_col).alias("_pos", item)).where("_pos is not null")
    return rows.withColumnRenamed("_pos", pos) if pos else rows.drop("_pos")


def strip(c: Column | str) -> Column:
    """White space, in Unicode's sense, off both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def collapse(c: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def words(c: Column | str) -> Column:
    """Non-empty strings between white space."""
    return F.filter(F.split(col(c), r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def has_script(c: Column | str, first: int = SCRIPT[0], last: int = SCRIPT[1]) -> Column:
    """Whether a character of the code point range occurs."""
    return F.coalesce(F.rlike(col(c), F.lit(f"[\\x{{{first:04X}}}-\\x{{{last:04X}}}]")), F.lit(False))


def contains_any(c: Column | str, needles: Sequence[str]) -> Column:
    """Whether any of a (small, constant) list occurs in the lower-cased text."""
    low = F.lower(col(c))
    tests = [F.contains(low, F.lit(n.lower())) for n in needles]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False)) if tests else F.lit(False)


def count_containing(texts: Column, needles: Sequence[str]) -> Column:
    """How many of an array of texts have any of the needles."""
    return F.size(F.filter(texts, lambda t: contains_any(t, needles)))


def normalize(c: Column | str, first: int = SCRIPT[0], last: int = SCRIPT[1]) -> Column:
    """Only word characters, blanks and the script; final letters folded; white space collapsed."""
    kept = F.regexp_replace(col(c), rf"[^\p{{L}}\p{{N}}_\s\x{{{first:04X}}}-\x{{{last:04X}}}]", "")
    return collapse(F.translate(kept, FINAL_LETTERS, FOLDED_LETTERS))


def strip_marks(c: Column | str, marks: str = EDGE_MARKS) -> Column:
    """Edge punctuation and blanks off both ends."""
    return F.trim(col(c), F.lit(marks))


def span_occurs(span: Column | str, text: Column | str) -> Column:
    """Light check: the collapsed span, without its edge marks, occurs in the collapsed text; never for an empty one."""
    return bare_occurs(span, collapse(text))


def bare_occurs(span: Column | str, collapsed: Column) -> Column:
    """``span_occurs`` for a text that is collapsed already."""
    bare = strip_marks(collapse(span), LIGHT_MARKS)
    return F.coalesce((bare != "") & F.contains(collapsed, bare), F.lit(False))


def find(text: Column | str, needle: Column | str) -> Column:
    """Zero-based code point offset of the first occurrence, -1 where there is none."""
    return F.instr(col(text), col(needle)) - 1


def hash_order(key: Column | str, seed: str = "42") -> Column:
    """A sort key that looks random and is the same in every engine and run."""
    return F.md5(F.concat(F.lit(f"{seed}|"), col(key).cast("string")).cast("binary"))


def hash_uniform(key: Column | str, seed: str = "42") -> Column:
    """A number from 0 (inclusive) to 1 (exclusive) from the key."""
    return F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_index(key: Column | str, n: Column | int, seed: str = "42") -> Column:
    """An index below ``n`` from the key."""
    return F.pmod(F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("long"), n if isinstance(n, Column) else F.lit(n))


def ladder(c: Column | str, rungs: Sequence[tuple[str, Sequence[str]]], otherwise: str) -> Column:
    """The name of the first rung one of whose needles the lower-cased text has."""
    out = None
    for name, needles in rungs:
        test = contains_any(c, needles)
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def steps(c: Column | str, bounds: Sequence[tuple[float, str]], otherwise: str, below: bool = True) -> Column:
    """The name of the first bound that the number is below (or at least)."""
    out = None
    for bound, name in bounds:
        test = (col(c) < bound) if below else (col(c) >= bound)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(otherwise)


# Needles of the error classes, in order of precedence.
ERROR_RUNGS = (
    ("auth", ("401", "403", "unauthorized", "invalid api key", "permission denied", "api key not valid")),
    (
        "overloaded",
        ("503", "unavailable", "experiencing high demand", "model is overloaded", "model_overloaded", "overloaded", "service unavailable", "try again later"),
    ),
    (
        "rate_limit",
        (
            "rate limit", "rate_limit", "ratelimit", "quota", "resource exhausted", "resourceexhausted", "429", "too many requests",
            "tokens per minute", "requests per minute", "requests per day", "rpm", "rpd", "tpm",
        ),
    ),
    ("transient", ("500", "502", "504", "connection", "timeout", "timed out", "deadline exceeded", "remote end closed", "ssl", "broken pipe")),
)
# Bounds of kappa's interpretation and of the decision on relaxed F1.
KAPPA_BOUNDS = ((0.0, "Poor"), (0.2, "Slight"), (0.4, "Fair"), (0.6, "Moderate"), (0.8, "Substantial"))
DECISION_BOUNDS = (
    (0.65, "GO — Labels are good"),
    (0.50, "GO — Labels are acceptable"),
    (0.35, "CONDITIONAL GO — Labels are noisy but usable"),
    (0.25, "CAUTION — Labels are weak"),
)
DECISION_ELSE = "NO-GO — Labels are broken"


def error_class(message: Column | str) -> Column:
    """auth, overloaded, rate_limit, transient or other; the order decides."""
    return ladder(message, ERROR_RUNGS, "other")


def is_rate_limit(message: Column | str) -> Column:
    return error_class(message).isin("rate_limit", "overloaded")


def kappa_word(k: Column | str) -> Column:
    return steps(k, KAPPA_BOUNDS, "Almost Perfect")


def decision(f1: Column | str) -> Column:
    return steps(f1, DECISION_BOUNDS, DECISION_ELSE, below=False)


def focal_weight(p: Column | str, alpha: float = 1.0, gamma: float = 2.0) -> Column:
    """Focal loss of the true class's probability: -alpha * (1 - p) ** gamma * log p."""
    return -F.lit(alpha) * F.pow(1 - col(p), F.lit(gamma)) * F.log(F.greatest(col(p), F.lit(1e-12)))


def percent_text(c: Column | str) -> Column:
    """A share as text with one decimal: ``12.3%``; ``-`` for null."""
    return F.coalesce(F.format_string("%.1f%%", col(c) * 100), F.lit("-"))


def interval_text(mean: Column | str, low: Column | str, high: Column | str) -> Column:
    """A score with its interval in percent: ``61.0 [58.2, 63.9]``; ``-`` for null."""
    return F.coalesce(F.format_string("%.1f [%.1f, %.1f]", *[F.round(col(c) * 100, 1) for c in (mean, low, high)]), F.lit("-"))


# Model families by what occurs in a model's name, in order of precedence.
MODEL_FAMILIES = (("gemini", ("gemini",)), ("cerebras", ("qwen", "cerebras")))


def model_family(name: Column | str) -> Column:
    """The family that a model's name belongs to; empty without one."""
    return F.coalesce(ladder(name, MODEL_FAMILIES, ""), F.lit(""))
