"""Command line: ``python -m tallyloom dedupe -i a.txt -o out.txt`` and the analyses."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from tallyloom.plans.config import MODES, ORDERINGS, ConfigError, parse_size
from tallyloom.plans.service import CommandError, FrequencyRequest, FuzzyRequest, JobRequest, NgramRequest, Service, SetOpRequest


def _yes(text: str) -> bool:
    if text.lower() not in ("true", "false"):
        raise argparse.ArgumentTypeError("true or false")
    return text.lower() == "true"


def _size(text: str) -> int:
    try:
        return parse_size(text)
    except ConfigError as e:
        raise argparse.ArgumentTypeError(str(e)) from e


def parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("-i", "--input", nargs="+", required=True, action="extend")
    common.add_argument("--trim", type=_yes, default=True)
    common.add_argument("--drop-empty", type=_yes, default=True)
    common.add_argument("--drop-length-min", type=int)
    common.add_argument("--drop-length-max", type=int)
    common.add_argument("--master", default=None, help="Spark master, e.g. local[8]")
    common.add_argument("--quiet", action="store_true")
    out = argparse.ArgumentParser(add_help=False)
    out.add_argument("-o", "--output", required=True)
    out.add_argument("--overwrite", action="store_true")
    out.add_argument("--ordering", choices=ORDERINGS, default="preserve")
    out.add_argument("--separator", default="\\n")
    out.add_argument("--raw-separator", action="store_true", help="take the separator literally")
    top = argparse.ArgumentParser(prog="tallyloom", description="Token sets of text files")
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("dedupe", parents=[common, out], help="distinct tokens")
    one.add_argument("--mode", choices=MODES, default="auto")
    one.add_argument("--disk-alphabetical-mode", choices=("fast-bucket-local", "global-perfect"), default="fast-bucket-local")
    one.add_argument("--disk-buckets", type=int, default=256)
    one.add_argument("--disk-run-size", type=_size, default=256 << 20)
    one.add_argument("--per-file-stats", action="store_true")
    one.add_argument("--benchmark-json", action="store_true", help="print the summary as one JSON line")
    one = commands.add_parser("frequency", parents=[common], help="token counts")
    one.add_argument("--top", type=int)
    one = commands.add_parser("set", parents=[common, out], help="diff, intersect or union with other files")
    one.add_argument("--op", choices=("diff", "intersect", "union"), required=True)
    one.add_argument("--right", nargs="*", default=[])
    one = commands.add_parser("fuzzy", parents=[common, out], help="clusters by edit distance")
    one.add_argument("--max-edit", type=int, default=1)
    one = commands.add_parser("ngrams", parents=[common, out], help="distinct n-grams")
    one.add_argument("-n", type=int, default=2)
    one = commands.add_parser("check", parents=[common], help="look words up in a list")
    one.add_argument("--word", nargs="+", required=True)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if spark is None:
        builder = SparkSession.builder.appName("tallyloom").config("spark.ui.showConsoleProgress", "false")
        spark = (builder.master(args.master) if args.master else builder).getOrCreate()
    service = Service(spark)
    shared = {"inputs": args.input, "trim": args.trim, "drop_empty": args.drop_empty, "drop_length_min": args.drop_length_min, "drop_length_max": args.drop_length_max}
    if "output" in args:
        shared |= {"output": args.output, "allow_overwrite": args.overwrite, "ordering": args.ordering, "output_separator": args.separator, "interpret_separator_escapes": not args.raw_separator}
    say = (lambda *a: None) if args.quiet else print
    try:
        if args.command == "dedupe":
            service.start_job(JobRequest(**shared, mode=args.mode, disk_buckets=args.disk_buckets, disk_alphabetical_mode=args.disk_alphabetical_mode,
                                         disk_run_bytes=args.disk_run_size, per_file_stats=args.per_file_stats))
            while (event := service.jobs.next_event_timeout(3600)) is not None and event.type != "summary":
                if event.type == "stage":
                    say(event.body["stage"])
            summary = event.body["summary"]
            if args.benchmark_json:
                print(json.dumps(summary))
            else:
                say(*[f"{k}={summary[k]}" for k in ("status", "tokens_seen", "unique_tokens", "duplicates", "reduction_pct", "elapsed_ms")], *summary["warnings"], sep="\n")
            if summary["status"] != "success":
                print(summary["error_message"] or summary["status"], file=sys.stderr)
                return 1
        elif args.command == "frequency":
            found = service.frequency(FrequencyRequest(**shared, top_n=args.top))
            for token, count in found["entries"]:
                print(f"{count}\t{token}")
            say(f"tokens_seen={found['tokens_seen']} unique_tokens={found['unique_tokens']}")
        elif args.command == "set":
            say(json.dumps(service.set_operation(SetOpRequest(**shared, right=args.right, op=args.op))))
        elif args.command == "fuzzy":
            say(json.dumps(service.fuzzy(FuzzyRequest(**shared, max_edit_distance=args.max_edit))))
        elif args.command == "ngrams":
            say(json.dumps(service.ngrams(NgramRequest(**shared, n=args.n))))
        else:
            service.load_word_list(args.input[0])
            for word in args.word:
                print(f"{word}\t{service.check_word(word)[0]}")
    except CommandError as e:
        print(f"{e.category}: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
