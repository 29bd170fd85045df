"""Annotators behind one interface: batches of prompts go out, texts come back.

An annotator is an object with ``label(prompts: list[str]) -> list[str]`` and raises
``AnnotatorError`` with a message that ``functions.text.error_class`` understands.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text as X


class AnnotatorError(Exception):
    """A failed call."""


def classify(message: str) -> str:
    """The error class of a message, on the driver or a worker; the same table as ``functions.text.error_class``."""
    low = message.lower()
    return next((name for name, needles in X.ERROR_RUNGS if any(n in low for n in needles)), "other")


def call(annotator, prompts: list[str], attempts: int = 5, wait: Callable[[float], None] = time.sleep) -> tuple[list[str | None], str | None]:
    """(answers, error class): overloads and rate limits wait 60, 120, 240, 300 s; transient errors 5 s; others give up at once."""
    for attempt in range(attempts):
        try:
            answers = annotator.label(prompts)
            return (list(answers) + [None] * len(prompts))[: len(prompts)], None
        except AnnotatorError as e:
            kind = classify(str(e))
            if kind in ("auth", "other") or attempt + 1 == attempts:
                return [None] * len(prompts), kind
            wait(5.0 if kind == "transient" else min(300.0, 60.0 * 2**attempt))
    return [None] * len(prompts), "other"


def annotate(df: DataFrame, key_col: str, prompt_col: str, make: Callable[[], object], batch: int = 5, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """``key, answer, error`` for each row. ``make`` builds the annotator once per task; authentication errors fail the task.

    Write the result before using it twice: calls are not repeated then.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        annotator = make()
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                answers, error = call(annotator, part["prompt"].tolist(), wait=wait)
                if error == "auth":
                    raise AnnotatorError("authentication failed")
                yield pd.DataFrame({"key": part["key"].tolist(), "answer": answers, "error": [error] * len(part)})

    slim = df.select(F.col(key_col).cast("string").alias("key"), F.col(prompt_col).alias("prompt"))
    return slim.mapInPandas(run, "key string, answer string, error string")


def failed(answered: DataFrame) -> DataFrame:
    """The dead letters of ``annotate``: keys whose batch failed for good, with the error's class; they are asked again in a later run."""
    return answered.where("error is not null").select("key", "error")
