"""``spark-submit`` entry point with two commands: segment and evaluate."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from voxloom import api
from voxloom.operators.evaluation import aggregate
from voxloom.sources import audio


def positive(text: str) -> float:
    value = float(text)
    if value <= 0:
        raise argparse.ArgumentTypeError("must be greater than 0")
    return value


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="voxloom", description="Segment signals and score the segments")
    sub = p.add_subparsers(dest="command", required=True)
    seg = sub.add_parser("segment", help="write the segments of audio files as JSON")
    seg.add_argument("audio", nargs="+")
    ev = sub.add_parser("evaluate", help="score segments of audio files against TextGrids, as CSV")
    ev.add_argument("audio")
    ev.add_argument("annotations")
    for tier, default in (("phone", 2), ("syllable", None), ("word", None)):
        ev.add_argument(f"--{tier}-tier", type=int, default=default)
    ev.add_argument("--tolerance", type=positive, default=0.05)
    ev.add_argument("--suffix-strip")
    ev.add_argument("--aggregate", help="where to write sums by method")
    for cmd in (seg, ev):
        cmd.add_argument("--envelope", default="sbs")
        cmd.add_argument("--method", default="peakdetect")
        cmd.add_argument("--samplerate", type=int, default=16_000)
        cmd.add_argument("--out", required=True)
    return p


def segment(spark: SparkSession, args: argparse.Namespace) -> int:
    """Files that cannot be read are named on stderr; 1 if none could."""
    waves = audio.read_audio(spark, args.audio, args.samplerate).cache()
    for row in waves.filter("NOT success").select("path", "error").toLocalIterator():
        print(f"{row['path']}: {row['error']}", file=sys.stderr)
    good = waves.filter("success")
    if good.isEmpty():
        return 1
    rows = api.segment_audio(good, args.method, envelope=args.envelope)
    nested = rows.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("start", "peak", "end"))).alias("segments"))
    good.select("file_id", F.col("path").alias("audio_path")).join(nested, "file_id", "left").write.mode("overwrite").json(args.out)
    return 0


def evaluate(spark: SparkSession, args: argparse.Namespace) -> int:
    tiers = {n: v for n in ("phone", "syllable", "word") if (v := getattr(args, f"{n}_tier")) is not None}
    rows = api.run_evaluation(spark, args.audio, args.annotations, tiers, args.tolerance, args.suffix_strip, method=args.method, envelope=args.envelope).cache()
    if rows.isEmpty():
        return 1
    rows.write.mode("overwrite").csv(args.out, header=True)
    if args.aggregate:
        aggregate(rows, args.annotations).coalesce(1).write.mode("overwrite").csv(args.aggregate, header=True)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    spark = SparkSession.builder.appName("voxloom").getOrCreate()
    return {"segment": segment, "evaluate": evaluate}[args.command](spark, args)


if __name__ == "__main__":
    sys.exit(main())
