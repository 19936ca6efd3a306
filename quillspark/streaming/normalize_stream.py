"""Normalization of streams: the same expressions, stateless, on a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.rules import RuleSet
from ..plans.normalize import MAX_SPAN, NO_RULES, normalize, normalize_sentence


def with_written(df: DataFrame, column: str, output: str = "written", sentences: bool = True, max_span: int = MAX_SPAN, rules: RuleSet = NO_RULES) -> DataFrame:
    """df, batch or stream, with the written form of a column. There is no state, so no watermark is needed and
    every output mode works that works for a projection."""
    made = normalize_sentence(column, max_span, rules) if sentences else normalize(column, rules)
    return df.withColumn(output, made)
