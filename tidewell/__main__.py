"""python -m tidewell --data DIR --query SQL: prints the result window by window."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from .plans.engine import Engine
from .sources.catalog import tables


def main() -> None:
    p = argparse.ArgumentParser(prog="tidewell")
    p.add_argument("-q", "--query", required=True)
    p.add_argument("-d", "--data", required=True, help="folder with events.parquet")
    p.add_argument("--batch", type=int, help="rows in a batch, at most")
    p.add_argument("--log", default="WARNING", choices=["DEBUG", "INFO", "WARNING", "ERROR"])
    p.add_argument("--stats", action="store_true", help="print planning and run time and rows")
    args = p.parse_args()
    logging.basicConfig(level=args.log)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, tables(args.data))
    for window, rows in engine.batches(args.query, args.batch):
        print(f"window {window}" if window is not None else "result")
        for row in rows:
            print("  " + ", ".join(f"{k}={v}" for k, v in row.asDict().items()))
    if args.stats:
        print(engine.stats[-1])


if __name__ == "__main__":
    main()
