"""Command line for the three jobs.

    spark-submit jobs.py refresh  --raw RAW --layers LAYERS
    spark-submit jobs.py campaign --layers LAYERS --slices SLICES --out OUT --event EVT-1 \\
        --name "Cup final" --date 2024-09-15 --venue "Main field" --prefix PROP-CUP-
    spark-submit jobs.py train    --layers LAYERS --models MODELS

Shuffles and scans are sized from the files of the input; ``--input-gb N --cores N`` override that.
RAW holds the folders telemetry, accounts, events and slices with Parquet files
in the schemas of ``capacast.sources.schemas``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from capacast import session
from capacast.plans import campaign, learning, refresh
from capacast.sources import schemas, tables


def run_refresh(spark, args) -> None:
    def batch(name, ddl):
        return spark.read.schema(schemas.schema(ddl)).parquet(f"{args.raw}/{name}")

    def live(name, ddl):
        return tables.stream(spark, f"{args.raw}/{name}", schemas.schema(ddl))

    streams = {"telemetry": live("telemetry", schemas.TELEMETRY), "accounts": live("accounts", schemas.ACCOUNTS)}
    refresh.refresh(
        args.layers, streams, batch("events", schemas.EVENTS), batch("slices", schemas.SLICES), F.current_timestamp())


def run_campaign(spark, args) -> None:
    event = campaign.Campaign(args.event, args.name, args.date, args.venue, args.prefix)
    opportunities = spark.read.parquet(f"{args.layers}/{refresh.OPPORTUNITIES}")
    campaign.run(opportunities, event, F.current_timestamp(), args.slices, f"{args.out}/upsell_proposal_log",
                 f"{args.out}/event_revenue_summary")


def run_train(spark, args) -> None:
    learning.train_congestion(spark.read.parquet(f"{args.layers}/{refresh.FEATURES}"), f"{args.models}/congestion")
    learning.train_accounts(
        spark.read.parquet(f"{args.layers}/{refresh.OPPORTUNITIES}"),
        spark.read.parquet(f"{args.layers}/{refresh.ENRICHED}"), f"{args.models}/accounts")


JOBS = {
    "refresh": (run_refresh, ["raw", "layers"]),
    "campaign": (run_campaign, ["layers", "slices", "out", "event", "name", "date", "venue", "prefix"]),
    "train": (run_train, ["layers", "models"]),
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="job", required=True)
    for name, (_, options) in JOBS.items():
        command = commands.add_parser(name)
        for option in options:
            command.add_argument(f"--{option}", required=True)
        command.add_argument("--input-gb", type=float)
        command.add_argument("--cores", type=int, default=8)
    args = parser.parse_args(argv)
    settings = session.sizing(int(args.input_gb * (1 << 30)), args.cores) if args.input_gb else {}
    spark = session.build("capacast-" + args.job, **settings)
    if not settings:
        session.sized(spark, getattr(args, "raw", None) or args.layers)
    try:
        JOBS[args.job][0](spark, args)
    finally:
        session.discard_scratch(spark)


if __name__ == "__main__":
    main()
