"""``python -m meterline <job>``, or the same behind ``spark-submit``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from meterline.functions.render import RESULT_TIME
from meterline.operators import hourly
from meterline.operators.prep import DEFAULT_BOUND
from meterline.operators.replay import DEFAULT_RATE_S
from meterline.plans import trips
from meterline.session import build_session
from meterline.sources import lines as sources
from meterline.streaming import hourly_stream


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = build_session(f"meterline {args.job}")
    args.run(spark, args)


def _prepare(spark: SparkSession, args) -> None:
    print(trips.prepare_file(spark, args.input, args.output, args.since))


def _hourly(spark: SparkSession, args) -> None:
    income = trips.hourly_batch(spark, args.input, args.bad)
    if args.table:
        income.write.parquet(args.output)
    else:
        hourly.hourly_lines(income).write.text(args.output)


def _stage(spark: SparkSession, args) -> None:
    """Text folders of a file's lines, one per replay step."""
    trips.stage_file(spark, args.input, args.output, args.timerate, form="text")


def _stream(spark: SparkSession, args) -> None:
    if args.servers:
        lines = sources.stream_topic(spark, args.servers, args.input)
    else:
        lines = sources.stream_lines(spark, args.input)
    interval = None if args.drain else args.interval
    hourly_stream.run_hourly_lines(
        lines, args.output, args.checkpoint, interval, bad=args.bad
    ).awaitTermination()


def _peek(spark: SparkSession, args) -> None:
    if args.servers:
        rows = sources.peek(
            sources.read_topic(spark, args.servers, args.input), ["partition", "offset"]
        )
    else:
        numbered = sources.read_lines(spark, args.input, numbered=True)
        rows = sources.peek(numbered, ["file", "block", "pos"])
    for row in rows.select("value").collect():
        print(row.value)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="meterline")
    jobs = parser.add_subparsers(dest="job", required=True)

    def job(name: str, run, text: str, *positional: str) -> argparse.ArgumentParser:
        sub = jobs.add_parser(name, help=text)
        for argument in positional:
            sub.add_argument(argument)
        sub.set_defaults(run=run)
        return sub

    prepare = job("prepare", _prepare, "clean a trip CSV and sort it by dropoff", "input")
    prepare.add_argument("output", nargs="?")
    prepare.add_argument("--since", default=DEFAULT_BOUND, help=RESULT_TIME)
    batch = job("hourly", _hourly, "hourly income of trip files", "input", "output")
    batch.add_argument("--bad", default="failfast", choices=["failfast", "drop"])
    batch.add_argument("--table", action="store_true", help="Parquet instead of lines")
    again = job("stage", _stage, "write a trip file into one folder per step", "input", "output")
    again.add_argument("--timerate", type=int, default=DEFAULT_RATE_S)
    stream = job("stream", _stream, "hourly income as a stream", "input", "output", "checkpoint")
    stream.add_argument("--bad", default="failfast", choices=["failfast", "drop"])
    stream.add_argument("--interval", default=hourly_stream.DEFAULT_INTERVAL)
    stream.add_argument("--drain", action="store_true", help="stop after what is there")
    stream.add_argument("--servers", help="read the topic INPUT there")
    peek = job("peek", _peek, "show the first ten lines", "input")
    peek.add_argument("--servers", help="read the topic INPUT there")
    return parser


if __name__ == "__main__":
    main()
