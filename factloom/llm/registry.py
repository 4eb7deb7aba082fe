"""All queries of this package and their SQL."""

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("simhash", "pii", "chat", "exact_dedup", "substring_dedup", "html_text", "licenses", "mixing", "decontamination", "toxicity", "sentencepiece_codec", "collocations", "alignment")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for m in MODULES for k, q in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in import_module(f"{__package__}.{m}").ORACLE.items()}
