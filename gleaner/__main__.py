"""Command line: converge, discover, version."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

VERSION = "0.1.0"


def cutoff(args: argparse.Namespace) -> tuple[str, float]:
    given = [(m, v) for m, v in (("top_n", args.top_n), ("threshold", args.threshold), ("target", args.target)) if v is not None]
    if len(given) > 1:
        raise SystemExit("give one of --top-n, --threshold and --target")
    return given[0] if given else ("target", 100)


def providers_of(args: argparse.Namespace):
    """The run's providers: the profile's own, or what `--providers module:function` returns; --no-llm takes the model out."""
    from dataclasses import replace

    from gleaner import providers as P

    if args.providers:
        module, _, name = args.providers.partition(":")
        found = getattr(importlib.import_module(module), name or "providers")()
    else:
        found = P.resolve(args.profile)
    return replace(found, no_llm=True, scope_filter_llm=False) if args.no_llm else found


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gleaner")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    for name in ("converge", "discover"):
        p = sub.add_parser(name)
        p.add_argument("docs")
        p.add_argument("--out", default="out")
        p.add_argument("--profile", choices=("local", "remote"), default="local")
        p.add_argument("--providers", metavar="MODULE:FUNCTION", help="a function that returns the providers of the run")
        p.add_argument("--no-llm", action="store_true", help="no step asks a language model")
        p.add_argument("--overlap", type=float, default=0.7)
        p.add_argument("--near-dup", type=float, default=0.9)
        p.add_argument("--min-chars", type=int, default=50)
        p.add_argument("--redaction-ratio", type=float, default=0.10)
        if name == "converge":
            p.add_argument("query")
            p.add_argument("--top-n", type=int)
            p.add_argument("--threshold", type=float)
            p.add_argument("--target", type=int)
            p.add_argument("--recall-bias", type=float, default=0.0)
            p.add_argument("--alpha", type=float, default=0.0, help="share of the lexical score in the ranking")
            p.add_argument("--score-top-k", type=int, default=250, help="documents that the model scores; 0: all")
            p.add_argument("--summary-words", type=int, default=100)
            p.add_argument("--observe", action="store_true")
        else:
            p.add_argument("--min-cluster-size", type=int, default=5)
            p.add_argument("--topic-distance", type=float, default=0.50)
            p.add_argument("--subtopic-distance", type=float, default=0.42)
            p.add_argument("--max-chunks", type=int, default=6)
    args = parser.parse_args(argv)
    if args.command == "version":
        print(VERSION)
        return 0
    from dataclasses import replace

    from pyspark.sql import SparkSession

    from gleaner.plans import converge as plan
    from gleaner.plans.observe import panels

    given = providers_of(args)
    spark = SparkSession.builder.appName("gleaner").getOrCreate()
    common = {"near_dup": args.near_dup, "overlap": args.overlap, "min_chars": args.min_chars, "redaction_share": args.redaction_ratio}
    if args.command == "converge":
        mode, value = cutoff(args)
        settings = plan.Settings(recall_bias=args.recall_bias, alpha=args.alpha, score_top_k=args.score_top_k, summary_words=args.summary_words, **common)
        result = plan.converge(spark, args.docs, args.query, mode=mode, value=value, settings=settings, providers=given, out=args.out)
        if args.observe:
            print(panels(result.audit))
    else:
        settings = replace(plan.DISCOVER, **common, min_cluster_size=args.min_cluster_size, topic_distance=args.topic_distance, subtopic_distance=args.subtopic_distance, chunk_cap=args.max_chunks)
        result = plan.discover(spark, args.docs, settings=settings, providers=given, out=args.out)
    print(json.dumps(result.counts()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
