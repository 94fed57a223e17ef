"""Confidence values anywhere in a model's raw JSON output."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The only keys whose numbers are confidences.
KEYS = frozenset("confidence confidences score scores rec_score rec_scores dt_score dt_scores det_score det_scores".split())


def harvest(document: object) -> list[float]:
    """Numbers from 0 to 1 right under one of KEYS, or in lists under it; a mapping in between starts anew. In document order."""
    out: list[float] = []
    waiting: list[tuple[object, bool]] = [(document, False)]
    while waiting:
        value, counts = waiting.pop()
        if isinstance(value, dict):
            waiting += reversed([(v, str(k).lower() in KEYS) for k, v in value.items()])
        elif isinstance(value, list):
            waiting += reversed([(v, counts) for v in value])
        elif counts and isinstance(value, int | float) and not isinstance(value, bool) and 0 <= value <= 1:
            out.append(float(value))
    return out


def confidences(raw_json: Column) -> Column:
    """array<double>; empty for null or unreadable JSON."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for text in s:
                try:
                    out.append(harvest(json.loads(text)) if text else [])
                except ValueError:
                    out.append([])
            yield pd.Series(out)

    return read(raw_json)
