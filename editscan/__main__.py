"""python -m editscan COMMAND: the jobs of plans.jobs and the comparison of reports."""

from __future__ import annotations

import argparse
import inspect

from pyspark.sql import SparkSession

from .plans import jobs, report

COMMANDS = {"index": jobs.converted_index, "convert": jobs.converted_reads, "align": jobs.chosen_alignments, "training": jobs.training_file, "track": jobs.genome_track, "fragments": jobs.fragment_file, "quality": jobs.quality, "motifs": jobs.motif_hits, "footprints": jobs.footprints}
#: Defaults of the command line that differ from the functions'.
DEFAULTS = {"track": {"min_coverage": 10}}


def parser() -> argparse.ArgumentParser:
    """Options are the jobs' parameters; those without a default are required."""
    top = argparse.ArgumentParser(prog="editscan")
    subs = top.add_subparsers(dest="command", required=True)
    for name, job in COMMANDS.items():
        p = subs.add_parser(name, help=(job.__doc__ or "").split("\n")[0])
        for k, v in list(inspect.signature(job, eval_str=True).parameters.items())[1:]:
            v = v.replace(default=DEFAULTS.get(name, {}).get(k, v.default))
            if v.annotation is bool:
                p.add_argument(f"--{k}", action=argparse.BooleanOptionalAction, default=v.default)
            elif v.annotation == list[str]:
                p.add_argument(f"--{k}", nargs="+", required=True)
            else:
                kind = v.annotation if isinstance(v.annotation, type) else v.annotation.__args__[0]
                p.add_argument(f"--{k}", type=kind, required=v.default is v.empty, default=None if v.default is v.empty else v.default)
    p = subs.add_parser("compare", help="reports of several samples in one table")
    p.add_argument("--reports", nargs="+", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--name", default="qc_summary")
    return top


def main(argv: list[str] | None = None) -> None:
    args = vars(parser().parse_args(argv))
    command = args.pop("command")
    spark = SparkSession.builder.appName(f"editscan {command}").getOrCreate()
    if command == "compare":
        report.write_comparison(spark, args["reports"], args["out"], args["name"])
    else:
        COMMANDS[command](spark, **args)


if __name__ == "__main__":
    main()
