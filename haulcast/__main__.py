"""Command line for ``spark-submit`` or ``python -m haulcast``.

    train    --shipments P --locations P --side side.json[,side.json...] --models P [--as-of D]
    history  --shipments P --locations P --side side.json --models P --out P [--overrides P] [--as-of D]
    volumes  --forecast P --segments A,B --side-name N --models P --out P [--overrides P] [--as-of D]

Tables are Parquet in the schemas of ``haulcast.schemas``; a name that ends in
``.csv`` is read as CSV: a forecast without header in nine columns, all others by
their header. ``side.json`` holds the fields of ``Side``; training takes several
sides from one read. ``--principal``, ``--perspective``, ``--domain``,
``--domain-contains`` and ``--location-domain-contains`` say which shipments count.
With ``--jdbc options.json`` (url, user, password, ...) shipments, locations and
forecast are tables or views of a database that have the columns of those schemas.
"""

from __future__ import annotations

import argparse
import json
from dataclasses import fields
from datetime import date, datetime, time, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from haulcast import schemas
from haulcast.models.training import Trained
from haulcast.operators.filters import SourceFilter
from haulcast.operators.metrics import is_training_row
from haulcast.plans import batch, history
from haulcast.session import build_session
from haulcast.sources import files, jdbc


SOURCE_FIELDS = [f.name for f in fields(SourceFilter)]


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="haulcast")
    parser.add_argument("--master")
    parser.add_argument("--as-of", type=date.fromisoformat)
    parser.add_argument("--jdbc")
    parser.add_argument("--tasks", type=int, default=32)
    for field in SOURCE_FIELDS:
        parser.add_argument("--" + field.replace("_", "-"))
    commands = parser.add_subparsers(dest="command", required=True)
    needed = {
        "train": ("shipments", "locations", "side", "models"),
        "history": ("shipments", "locations", "side", "models", "out"),
        "volumes": ("forecast", "segments", "side-name", "models", "out"),
    }
    for name, options in needed.items():
        command = commands.add_parser(name)
        for option in options:
            command.add_argument(f"--{option}", required=True)
    commands.choices["volumes"].add_argument("--overrides")
    commands.choices["train"].add_argument("--split-seed", type=int)
    commands.choices["history"].add_argument("--overrides")
    return parser.parse_args(argv)


def read_side(path: str) -> history.Side:
    given = json.loads(Path(path).read_text(encoding="utf-8"))
    return history.Side(**{**given, "segments": tuple(given["segments"])})


def _write(result: batch.FleetForecast, out: str) -> None:
    result.fleet.select(schemas.FLEET_LONG.names).write.mode("overwrite").partitionBy("ship_date").parquet(f"{out}/fleet")
    files.write_matrix(result.table, f"{out}/volumes")
    files.write_matrix(result.matrix, f"{out}/matrix")
    files.write_matrix(result.missing, f"{out}/missing")
    files.write_matrix(result.rejected, f"{out}/rejected")


def _table(spark: SparkSession, args: argparse.Namespace, name: str, schema: StructType) -> DataFrame:
    if not args.jdbc:
        if name.endswith(".csv") and schema is schemas.VOLUME_FORECAST:
            return files.read_forecast_csv(spark, name)
        if name.endswith(".csv"):
            return files.read_csv(spark, name, schema)
        return spark.read.schema(schema).parquet(name)
    options = jdbc.connection(**json.loads(Path(args.jdbc).read_text(encoding="utf-8")))
    split = None
    if schema is schemas.SHIPMENTS:
        # Slices of the window that the command reads.
        months = batch.TRAINING_MONTHS if args.command == "train" else batch.RECENT_MONTHS
        until = datetime.combine(args.as_of or date.today(), time.min)
        first = until - timedelta(days=31 * months)
        split = jdbc.partitioning("start_ts", first, until, args.tasks)
        if jdbc.is_oracle(options):
            name = jdbc.since(name, "start_ts", first)
    return jdbc.read_table(spark, name, options, split)


def main(argv: list[str] | None = None) -> None:
    args = _arguments(argv)
    spark = build_session("haulcast", master=args.master)
    given = getattr(args, "overrides", None)
    if given:
        overrides = files.read_csv(spark, given, schemas.OVERRIDES) if given.endswith(".csv") else spark.read.parquet(given)
    else:
        overrides = None
    if args.command == "volumes":
        trained = Trained.load(args.models, args.side_name, spark)
        uploaded = _table(spark, args, args.forecast, schemas.VOLUME_FORECAST)
        _write(batch.from_volumes(uploaded, args.segments.split(","), trained, args.as_of, overrides), args.out)
        return
    keep = SourceFilter(**{name: getattr(args, name) for name in SOURCE_FIELDS})
    shipments = _table(spark, args, args.shipments, schemas.SHIPMENTS)
    locations = _table(spark, args, args.locations, schemas.LOCATIONS)
    sides = [read_side(path) for path in args.side.split(",")]
    if args.command == "train":
        # Every fifth day is held out, or a fifth of the rows by a seeded hash.
        is_train = None if args.split_seed is None else is_training_row(args.split_seed, "ship_date", "entity")
        for trained in batch.train_sides(shipments, locations, sides, args.as_of, keep=keep, is_train=is_train).values():
            trained.save(args.models, spark)
    else:
        trained = Trained.load(args.models, sides[0].name, spark)
        _write(batch.from_history(shipments, locations, sides[0], trained, args.as_of, overrides, keep), args.out)


if __name__ == "__main__":
    main()
