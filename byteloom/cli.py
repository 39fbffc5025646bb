"""Command line: one line a file, or for standard input.

    python -m byteloom.cli [-l] [-m] [-e ERAS] [-i NAMES] [-x NAMES] [--minimal | --raw] [--models FILE [--weights FILE]] [FILE ...]
"""

from __future__ import annotations

import argparse
import sys
from functools import reduce

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from byteloom import __version__
from byteloom.functions.ranking import Options
from byteloom.functions.registry import Era
from byteloom.operators.identify import detect
from byteloom.sources import files, model_files


def options_of(args: argparse.Namespace) -> Options:
    names = lambda text: tuple(x for x in text.split(",") if x) if text is not None else None
    era = reduce(lambda a, b: a | b, (Era[x.strip().upper()] for x in args.era.split(",")))
    return Options(encoding_era=int(era), include_encodings=names(args.include), exclude_encodings=names(args.exclude), no_match_encoding=args.no_match_encoding, empty_input_encoding=args.empty_input_encoding).checked()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="byteloom")
    p.add_argument("files", nargs="*")
    p.add_argument("-l", "--language", action="store_true")
    p.add_argument("-m", "--mime-type", action="store_true")
    p.add_argument("-e", "--era", default="all")
    p.add_argument("-i", "--include")
    p.add_argument("-x", "--exclude")
    p.add_argument("--minimal", action="store_true")
    p.add_argument("--raw", action="store_true")
    p.add_argument("--no-match-encoding", default="cp1252")
    p.add_argument("--empty-input-encoding", default="utf-8")
    p.add_argument("--models", help="a models file")
    p.add_argument("--weights", help="the weights file of --models")
    p.add_argument("--version", action="version", version=f"byteloom {__version__}")
    return p


def main(argv: list[str] | None = None) -> int:
    """0; 2 for bad arguments; 1 if no file could be read."""
    args = parser().parse_args(argv)
    try:
        options = options_of(args)
        models = model_files.load_models(args.models, args.weights) if args.models else None
    except (ValueError, KeyError, OSError) as e:
        print(e, file=sys.stderr)
        return 2
    spark = SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
    inputs, failed = [], 0
    for name in args.files:
        try:
            with open(name, "rb") as f:
                inputs.append((name, f.read(options.max_bytes + 1)))
        except OSError as e:
            failed += 1
            print(f"{name}: {e.strerror}", file=sys.stderr)
    if not args.files:
        inputs.append(("stdin", sys.stdin.buffer.read()))
    if not inputs:
        return 1
    df = detect(spark.createDataFrame([(k, n, bytearray(b)) for k, (n, b) in enumerate(inputs)], "k int, label string, content binary"), options=options, models=models)
    label, found = F.col("label"), F.col("detected")
    line = files.raw_line(label, found) if args.raw else files.minimal_line(found, args.language, args.mime_type) if args.minimal else files.text_line(label, found, args.language, args.mime_type)
    for r in df.select("k", line.alias("line")).orderBy("k").toLocalIterator():
        print(r["line"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
