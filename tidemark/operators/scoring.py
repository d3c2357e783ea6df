"""A pluggable scorer behind a cache keyed by (hash, model, prompt)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "input_hash string, model string, prompt string, score double, cited array<string>, error string"
#: A scorer takes (input text, fired rules) and returns (score or None for a refusal, cited rules).
Scorer = Callable[[str, list[str]], tuple[float | None, list[str]]]


def judge_one(scorer: Scorer, text: str, fired: list[str]) -> tuple[float | None, list[str], str | None]:
    """At most two attempts: a malformed answer is tried again; a refusal, or a rule cited that did not fire, is final."""
    error = None
    for _ in range(2):
        try:
            score, cited = scorer(text, fired)
        except (ValueError, TypeError) as e:
            error = f"malformed: {e}"
            continue
        if score is None:
            return None, [], "refusal"
        if not set(cited) <= set(fired):
            return None, [], "cited a rule that did not fire"
        return float(score), list(cited), None
    return None, [], error


def score_missing(inputs: DataFrame, cache: DataFrame, scorer: Scorer, model: str, prompt: str, cap: int = 3000, workers: int = 3) -> DataFrame:
    """Fresh results for inputs (input_hash, text, fired) that the cache lacks, at most ``cap`` of them.

    The result should be written before it is used: a task that runs again asks the scorer again.
    """
    known = cache.where((F.col("model") == model) & (F.col("prompt") == prompt)).select("input_hash")
    fresh = inputs.dropDuplicates(["input_hash"]).join(known, "input_hash", "left_anti").orderBy("input_hash").limit(cap).repartition(workers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            told = [judge_one(scorer, t, list(f)) for t, f in zip(df["text"], df["fired"], strict=True)]
            yield pd.DataFrame({"input_hash": df["input_hash"], "model": model, "prompt": prompt, "score": [x[0] for x in told], "cited": [x[1] for x in told], "error": [x[2] for x in told]})

    return fresh.select("input_hash", "text", "fired").mapInPandas(run, RESULT)
