"""Command line: check, contract build and diff, report diff, explain, capabilities, init.

Exit codes: 0 clean, 1 errors (or changes), 2 fatal findings or an invalid configuration.
"""

from __future__ import annotations

import argparse
import sys
from datetime import date

TEMPLATE = """[policy]
strict_inventory = false

[[sources]]
view = "rtl.default"
paths = ["rtl/*.sv"]
format = "rtl"
"""


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="factloom")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("check", help="check a project")
    c.add_argument("config")
    c.add_argument("--format", choices=("text", "json", "markdown", "sarif", "html"), default="text")
    c.add_argument("--output")
    c.add_argument("--save", help="write the diagnostics as a table, for report-diff")
    c.add_argument("--contract", help="a contract table to check against")
    c.add_argument("--today", type=date.fromisoformat)
    c.add_argument("--deny-warnings", action="store_true")
    b = sub.add_parser("contract-build", help="freeze a project's ports")
    b.add_argument("config")
    b.add_argument("output")
    for name in ("contract-diff", "report-diff"):
        d = sub.add_parser(name, help="compare two saved tables")
        d.add_argument("before")
        d.add_argument("after")
    e = sub.add_parser("explain", help="name and severity of a rule")
    e.add_argument("code")
    sub.add_parser("capabilities", help="formats and their endings")
    i = sub.add_parser("init", help="write a project file")
    i.add_argument("path")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    from factloom.model import CATALOG

    if args.command == "explain":
        if args.code.upper() not in CATALOG:
            print(f"{args.code} is no rule", file=sys.stderr)
            return 2
        print(args.code.upper(), *CATALOG[args.code.upper()])
        return 0
    if args.command == "capabilities":
        from factloom.sources.reader import FORMATS

        for name, (kind, _, ends) in FORMATS.items():
            print(name, kind, *ends)
        return 0
    from factloom.plans import reports

    if args.command == "init":
        reports.publish(args.path, TEMPLATE, overwrite=False)
        return 0
    from pyspark.sql import SparkSession

    from factloom.operators import review
    from factloom.plans import check
    from factloom.plans.project import ConfigError, Project

    spark = spark or SparkSession.builder.appName("factloom").getOrCreate()
    try:
        if args.command == "check":
            project = Project.load(spark, args.config)
            found = project.check(args.today, spark.read.parquet(args.contract) if args.contract else None).cache()
            body = {"text": reports.render_text, "json": reports.render_json, "markdown": reports.render_markdown, "sarif": reports.render_sarif, "html": reports.render_html}[args.format](found)
            reports.publish(args.output, body) if args.output else print(body)
            if args.save:
                found.write.mode("overwrite").parquet(args.save)
            return check.exit_code(found, args.deny_warnings or project.policy.deny_warnings)
        if args.command == "contract-build":
            Project.load(spark, args.config).build_contract().write.mode("overwrite").parquet(args.output)
            return 0
    except ConfigError as e:
        print(f"fatal[OC1001] {e}", file=sys.stderr)
        return 2
    before, after = spark.read.parquet(args.before), spark.read.parquet(args.after)
    changes = review.contract_diff(before, after) if args.command == "contract-diff" else review.report_diff(before, after).where("state != 'unchanged'")
    lines = [" ".join(str(x) for x in r) for r in changes.toLocalIterator()]
    print("\n".join(lines))
    return int(bool(lines))


if __name__ == "__main__":
    sys.exit(main())
