"""A project: sources and policy from a TOML file, checked as a whole."""

from __future__ import annotations

import tomllib
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.model import CATALOG, SCHEMAS, SEVERITIES
from factloom.operators import digests, incremental, review
from factloom.operators.rules import Facts, Policy
from factloom.operators.shared import cut
from factloom.sources.reader import Source, observe

from .check import check, ordered
from .guard import within


class ConfigError(ValueError):
    """OC1001: the configuration is invalid."""


def _table(spark: SparkSession, family: str, dicts: list[dict]) -> DataFrame:
    names = [f.name for f in spark.createDataFrame([], SCHEMAS[family]).schema]
    for d in dicts:
        if set(d) - set(names):
            raise ConfigError(f"{family}: unknown keys {', '.join(sorted(set(d) - set(names)))}")
    return spark.createDataFrame([tuple(d.get(n) for n in names) for d in dicts], SCHEMAS[family])


class Project:
    """``[[sources]]`` (view, paths, format, options), ``[policy]``, ``[severity]``, ``[[waivers]]``, ``[[aliases]]``, ``[[participation]]``."""

    def __init__(self, spark: SparkSession, config: dict, base: str = ""):
        self.spark = spark
        unknown = set(config) - {"sources", "policy", "severity", "waivers", "aliases", "participation", "project"}
        if unknown:
            raise ConfigError(f"unknown keys {', '.join(sorted(unknown))}")
        try:
            place = lambda p: p if not base or "://" in p or p.startswith("/") else f"{base}/{p}"
            self.sources = [Source(s["view"], [place(p) for p in s["paths"]], s.get("format", ""), s.get("options", {})) for s in config.get("sources", [])]
            self.policy = Policy(**config.get("policy", {}))
        except (KeyError, TypeError) as e:
            raise ConfigError(str(e)) from e
        for code, severity in config.get("severity", {}).items():
            if code not in CATALOG or severity not in SEVERITIES:
                raise ConfigError(f"severity.{code} = {severity}")
        self.extra = {
            "overrides": _table(spark, "overrides", [{"code": c, "severity": s} for c, s in config.get("severity", {}).items()]),
            "waivers": _table(spark, "waivers", [{"waiver_index": k, "code": "*", "object_pattern": "*"} | w for k, w in enumerate(config.get("waivers", []))]),
            "aliases": _table(spark, "aliases", config.get("aliases", [])),
            "participation": _table(spark, "participation", config.get("participation", [])),
        }

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Project:
        try:
            config = tomllib.loads(Path(path).read_text(encoding="utf-8"))
        except (OSError, tomllib.TOMLDecodeError) as e:
            raise ConfigError(str(e)) from e
        return cls(spark, config, str(Path(path).resolve().parent))

    def facts(self, contract: DataFrame | None = None, cache: str | None = None) -> Facts:
        tables = observe(self.spark, self.sources, cache) | self.extra
        if contract is None:
            tables.pop("contract_ports")
        else:
            tables["contract_ports"] = contract.select("component", "port", "direction", "role", "width")
        return Facts(self.spark, tables, self.policy)

    def check(self, today: date | None = None, contract: DataFrame | None = None, checkers: tuple = (), cache: str | None = None, seconds: float | None = None) -> DataFrame:
        """The diagnostics; views whose files have not changed are read from ``cache``, a shared folder, if one is given.

        With ``seconds`` they are written within that time, or their jobs are cancelled and ``LimitExceeded`` is raised.
        """
        if seconds is None:
            return check(self.facts(contract, cache), today, checkers)
        return within(self.spark, seconds, lambda: ordered(cut(check(self.facts(contract, cache), today, checkers))))

    @staticmethod
    def findings(facts: Facts) -> DataFrame:
        """All rules' findings by rule and component, to be kept with the facts for ``recheck``."""
        return incremental.saved(incremental.findings(facts))[0]

    def recheck(self, then: Facts, old: DataFrame, cache: str | None = None) -> DataFrame:
        """The findings now, from the facts and findings of an earlier state: only what changed views touch is judged again."""
        now = self.facts(cache=cache)
        a, b = (digests.contract(f.tables)["views"].select("view", F.col("digest").alias(n)) for f, n in ((then, "_b"), (now, "_a")))
        changed = a.join(b, "view", "full").where(~F.col("_b").eqNullSafe(F.col("_a"))).select("view")
        return incremental.updated(old, then, now, [r.view for r in changed.collect()])  # views are few: one for each source

    def build_contract(self) -> DataFrame:
        return review.build_contract(self.facts())


def changed_files(before: DataFrame, now: DataFrame) -> DataFrame:
    """Files (path, content) whose bytes differ from an earlier listing (path, digest): what must be parsed again."""
    fresh = now.select("path", F.sha2("content", 256).alias("digest"))
    return fresh.join(before, ["path", "digest"], "left_anti")
