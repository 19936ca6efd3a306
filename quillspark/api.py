"""The public names of the normalizer."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import __version__
from .functions.numbers import number
from .operators.addresses import electronic
from .operators.codes import telephone
from .operators.counts import cardinal, decimal, ordinal
from .operators.dates import date
from .operators.measure import measure
from .operators.money import money
from .operators.rules import RowRules, RuleSet, rule_versions, rules_in_force
from .operators.terms import punctuation, term, word
from .operators.times import time
from .plans.chain import Chain, Tagger, span_report, write_by_spans
from .plans.normalize import normalize, normalize_by_versions, normalize_sentence, normalize_with_lang, normalize_with_rules, write_sentences_with_rules
from .streaming.normalize_stream import with_written

TAGGERS = {
    "cardinal": cardinal, "ordinal": ordinal, "decimal": decimal, "money": money, "measure": measure, "date": date, "time": time,
    "telephone": telephone, "electronic": electronic, "whitelist": term, "punctuation": punctuation, "word": word,
}


def normalized_view(df: DataFrame, column: str, view: str, output: str = "written", **options) -> None:
    """Registers a view of df with the written form of a column, for use from SQL."""
    with_written(df, column, output, **options).createOrReplaceTempView(view)


__all__ = [
    "TAGGERS", "Chain", "RowRules", "RuleSet", "Tagger", "__version__", "normalize", "normalize_by_versions", "normalize_sentence", "normalize_with_lang", "normalize_with_rules",
    "normalized_view", "number", "rule_versions", "rules_in_force", "span_report", "with_written", "write_by_spans", "write_sentences_with_rules",
]
