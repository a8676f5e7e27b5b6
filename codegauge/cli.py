"""Command line: analyze, badge and gate of one source tree."""

from __future__ import annotations

import argparse
import importlib
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from codegauge.operators import facts as facts_
from codegauge.operators.metrics import Tables
from codegauge.plans import advice
from codegauge.plans import gates as gates_
from codegauge.plans import score as score_
from codegauge.plans import sinks
from codegauge.sources import config, files
from codegauge.sources.dependencies import dependencies


def tables(spark: SparkSession, root: str, lang: str):
    """Sources and dependencies of a tree."""
    langs = files.SUFFIX if lang in ("auto", "mixed") else [lang]
    sources = None
    for one in langs:
        rows = files.scan(spark, root, one, codebase=root)
        sources = rows if sources is None else sources.unionByName(rows)
    return sources, dependencies(files.manifests(spark, root)) if os.path.isdir(root) else None


def recommended(args: argparse.Namespace, sources, rows, totals, lang: str):
    """Recommendations by the function that --recommend names."""
    module, _, name = args.recommend.partition(":")
    facts = facts_.extract(sources)
    t = Tables(sources, facts)
    found = facts_.view(facts, "finding", [], ["test_name", "severity", "issue_text"]).withColumnRenamed("name", "test_id")
    prompts = advice.prompts(rows, totals, sources, found, advice.top_functions(t))
    return advice.advise(prompts, getattr(importlib.import_module(module), name), args.model, at=args.answers)


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    if not os.path.exists(args.path):
        print(f"no such path: {args.path}", file=sys.stderr)
        return 2
    sources, deps = tables(spark, args.path, args.lang)
    vulnerabilities = spark.read.parquet(args.vulnerabilities) if args.vulnerabilities else None
    lang = args.lang
    if lang == "auto":
        found = sorted(r.lang for r in sources.select("lang").distinct().collect())
        lang = found[0] if len(found) == 1 else "mixed"
    rows = score_.analyze(sources, lang, deps, vulnerabilities).cache()
    totals = score_.scored(rows)
    first = totals.first()
    value = first[score_.SCORE] if first else 0.0
    if args.command == "badge":
        badge = {"url": sinks.badge_url, "markdown": sinks.badge_markdown}.get(args.format)
        c = badge(F.lit(value), args.style) if badge else sinks.badge_json(F.lit(value))
        text = spark.range(1).select(c).first()[0]
    elif args.command == "gate":
        text = ""
    else:
        told = recommended(args, sources, rows, totals, lang) if args.recommend else None
        got = sinks.report(rows, totals, args.format, told).first()
        text = got.report if got else f"{args.path}: no sources, score 0.000\n"
    if args.output:
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(text)
    elif text:
        print(text)
    passed = True
    if args.command == "gate" or getattr(args, "gate", False):
        at = args.config or config.find_gates(args.path)
        content = config.parse_gates(open(at, encoding="utf-8").read()) if at else None
        evaluated = gates_.evaluate(rows, totals, content, args.normalize_keys).cache()
        for r in gates_.lines(evaluated).collect():  # a line for each gate
            print(r.line)
        verdict = gates_.verdicts(evaluated).first()
        passed = verdict.passed if verdict else True
        evaluated.unpersist()
    rows.unpersist()
    return gates_.exit_code(value, passed, getattr(args, "min_score", None))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codegauge")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("analyze", "badge", "gate"):
        c = sub.add_parser(name)
        c.add_argument("path")
        c.add_argument("--lang", choices=["auto", "java", "kotlin", "mixed"], default="auto")
        c.add_argument("--vulnerabilities", help="a Parquet snapshot: ecosystem, package, version, id, summary")
        c.add_argument("--output")
        c.add_argument("--config")
        c.add_argument("--normalize-keys", action="store_true")
        if name == "analyze":
            c.add_argument("--format", choices=sorted(sinks.FORMATS), default="terminal")
            c.add_argument("--min-score", type=float)
            c.add_argument("--recommend", metavar="MODULE:FUNCTION", help="a function from a prompt to a model's answer")
            c.add_argument("--model", default="model")
            c.add_argument("--answers", help="a folder in which answers are kept")
            c.add_argument("--gate", action="store_true")
        if name == "badge":
            c.add_argument("--format", choices=["url", "json", "markdown"], default="url")
            c.add_argument("--style", choices=sinks.STYLES, default="flat")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("codegauge").getOrCreate()
    return run(args, spark)


if __name__ == "__main__":
    sys.exit(main())
