"""``python -m lacuna.cli COMMAND``: the analyses over a corpus folder, as a table, CSV or JSON."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import functions as F

from lacuna.functions.text import unused_aliases
from lacuna.operators import backtest as bt
from lacuna.operators.citations import stats, top_cited
from lacuna.operators.evaluate import evaluate
from lacuna.operators.gaps import find_gaps, gap_rows, gaps_with_bridges
from lacuna.operators.labels import label_graph, top_labels
from lacuna.operators.textcheck import evidence, verify_gaps
from lacuna.params import CONCEPTS, POSITIVES, SCORERS, TOPICS, LabelFilter, valid_limit, valid_min_score
from lacuna.report import FORMATS, render
from lacuna.session import get_session
from lacuna.sources.corpus import load_corpus


def _alias(value: str) -> tuple[str, str]:
    name, sep, term = value.partition("=")
    if not sep or not name.strip() or not term.strip():
        raise argparse.ArgumentTypeError(f"{value!r} is not label=phrase")
    return name.strip(), term.strip()


def _count(value: str) -> int:
    n = int(value)
    if n < 0:
        raise ValueError(value)
    return n


def _checked(check):
    def parse(value):
        try:
            return check(value)
        except ValueError as e:
            raise argparse.ArgumentTypeError(str(e)) from None

    return parse


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lacuna")
    p.add_argument("--data", default="data/default")
    p.add_argument("--format", choices=FORMATS, default="table")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, *options, taxonomy=None):
        c = sub.add_parser(name)
        c.add_argument("--data", default=argparse.SUPPRESS)
        c.add_argument("--format", choices=FORMATS, default=argparse.SUPPRESS)
        for flag, kw in options:
            c.add_argument(flag, **kw)
        if taxonomy:
            c.add_argument("--taxonomy", choices=(TOPICS, CONCEPTS), default=taxonomy)
            c.add_argument("--min-level", type=_count, default=2)
            c.add_argument("--min-score", type=_checked(valid_min_score), default=0.4)

    top, works = ("--top", {"type": _count, "default": 20}), ("--min-works", {"type": _count, "default": 15})
    alias, split = ("--alias", {"type": _alias, "action": "append", "default": []}), ("--split-year", {"type": int, "required": True})
    command("fetch", ("--query", {"required": True}), ("--filter", {"default": None}), ("--limit", {"type": _checked(valid_limit), "default": 2000}))
    command("stats")
    command("citations", top)
    command("concepts", top, taxonomy=TOPICS)
    command("gaps", top, works, ("--bridges", {"type": _count, "default": 0}), taxonomy=TOPICS)
    command("backtest", top, works, split, ("--summary", {"action": "store_true"}), taxonomy=TOPICS)
    command("evaluate", top, works, split, ("--label", {"choices": [x.replace("_", "-") for x in POSITIVES], "default": "co-tagged"}), ("--null-permutations", {"type": _count, "default": 200}), ("--reference", {"choices": [x.replace("_", "-") for x in SCORERS], "default": "lift"}), taxonomy=TOPICS)
    command("verify", top, works, alias, taxonomy=CONCEPTS)
    command("evidence", ("--a", {"required": True}), ("--b", {"required": True}), ("--limit", {"type": _count, "default": 30}), alias, taxonomy=CONCEPTS)
    return p


def warn(text: str) -> None:
    print(f"warning: {text}", file=sys.stderr)


def warn_labels(works, taxonomy: str) -> None:
    if taxonomy == TOPICS and not works.isEmpty() and works.where(F.size("topics") > 0).isEmpty():
        warn("no work has topics; fetch again into another folder, or use --taxonomy concepts")


def warn_text(works, taxonomy: str) -> None:
    if taxonomy == TOPICS:
        warn("topic names are long phrases that seldom stand in texts; add --alias or use --taxonomy concepts")
    if not works.isEmpty() and works.where(F.col("abstract").isNotNull()).isEmpty():
        warn("no work has an abstract, so there is no text to check")


def warn_aliases(spark, aliases, names) -> None:
    for name, term in unused_aliases(spark, aliases, names):
        warn(f"--alias {name}={term} fits no label of this result")


def run(args: argparse.Namespace):
    """The result of a command, as a DataFrame."""
    spark = get_session()
    if args.command == "fetch":
        from lacuna.sources.client import HttpClient
        from lacuna.sources.ingest import FetchParams, fetch

        client = HttpClient(os.environ.get("OPENALEX_API_KEY") or None, log=warn)
        return fetch(spark, client, args.data, FetchParams(args.query, args.filter, args.limit))
    works = load_corpus(spark, args.data).cache()
    if args.command == "stats":
        return stats(works)
    if args.command == "citations":
        return top_cited(works, args.top)
    labels = LabelFilter(args.taxonomy, args.min_level, args.min_score)
    warn_labels(works, args.taxonomy)
    if args.command == "evidence":
        warn_text(works, args.taxonomy)
        warn_aliases(spark, args.alias, [args.a, args.b])
        graph = label_graph(works, labels)
        for name in (args.a, args.b):
            if graph.labels.where(F.lower("name") == F.lower(F.lit(name))).isEmpty():
                warn(f"{name!r} is not a label of this corpus")
        return evidence(works, labels, args.a, args.b, args.alias, args.limit)
    if args.command in ("backtest", "evaluate"):
        result = bt.backtest(works, labels, args.split_year, args.min_works)
        print(f"train {result.train.n_works} works (year <= {args.split_year}), test {result.test.n_works} works (year > {args.split_year}), {result.undated} without a year left out", file=sys.stderr)
        if not result.train.n_works or not result.test.n_works:
            warn("train or test is empty; is --split-year within the corpus?")
        if args.command == "backtest":
            return bt.backtest_summary(result, args.top).drop("position") if args.summary else bt.backtest_rows(result, args.top)
        out = evaluate(result, args.label.replace("-", "_"), args.top, args.reference.replace("-", "_"), args.null_permutations)
        first = out.first()
        candidates = result.pairs.count()
        if candidates and first["pairs"] * 2 < candidates:
            warn(f"only {first['pairs']} of {candidates} candidate pairs can be judged in the test period")
        if not args.null_permutations:
            warn("without permutations AUROC has no baseline; it is not 0.5 here")
        elif first["permutations"] < args.null_permutations:
            warn(f"{args.null_permutations - first['permutations']} permutations had one class alone and are left out")
        return out.drop("auroc_null_sd", "z")
    graph = label_graph(works, labels)
    if args.command == "concepts":
        return top_labels(graph, args.top)
    if args.command == "gaps":
        return gaps_with_bridges(graph, args.min_works, args.top, args.bridges) if args.bridges else gap_rows(find_gaps(graph, args.min_works, args.top))
    warn_text(works, args.taxonomy)
    out = verify_gaps(works, graph, args.min_works, args.top, args.alias)
    warn_aliases(spark, args.alias, [n for r in out.select("concept_a", "concept_b").collect() for n in r])
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        rows = run(args)
        print(render(rows.orderBy("rank") if "rank" in rows.columns else rows, args.format), end="")
    except BrokenPipeError:  # the reader has closed first, as head does
        return 0
    except Exception as e:  # noqa: BLE001  a command's failure is its message and exit code
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
