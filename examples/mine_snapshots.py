"""Mine rules from N-Triples snapshots and print how well they last.

    python examples/mine_snapshots.py \\
        --snapshot 2015-10 2015-10-01 types_2015.nt.bz2 \\
        --snapshot 2016-04 2016-04-01 types_2016a.nt.bz2 \\
        --snapshot 2016-10 2016-10-01 types_2016b.nt.bz2 \\
        --width 2 --min-support 0.005 --min-confidence 0.2 --tau 0.2 --store /shared/types

With ``--width`` equal to the number of snapshots there is one window over all of
them, so an entity whose type changed yields a rule from one type to the other.
"""

from __future__ import annotations

import argparse
import sys
from datetime import datetime
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import factdrift as fd  # noqa: E402
from factdrift.functions import short_label  # noqa: E402


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    args.add_argument("--snapshot", nargs=3, action="append", required=True, metavar=("ID", "DATE", "PATH"))
    args.add_argument("--width", type=int, default=1)
    args.add_argument("--step", type=int, default=1)
    args.add_argument("--min-support", type=float, default=0.1)
    args.add_argument("--min-confidence", type=float, default=0.5)
    args.add_argument("--tau", type=float, default=0.6)
    args.add_argument("--include-literals", action="store_true")
    args.add_argument("--store", help="folder of the triple store; a staged one by default")
    options = args.parse_args()

    spark = SparkSession.builder.appName("mine-snapshots").getOrCreate()
    sources = {name: (path, datetime.fromisoformat(date)) for name, date, path in options.snapshot}
    triples = fd.store_snapshots(spark, sources, options.store)
    fd.triples_per_snapshot(triples).orderBy("snapshot").show()
    fd.distinct_terms(triples).show()

    windowed = fd.assign_windows(triples, options.width, options.step)
    changed = fd.transaction_sizes(windowed, options.include_literals).where("n_items > 1")
    fd.transactions_per_window(changed).orderBy("window_id").show()

    found = fd.temporal_rules(
        triples,
        options.min_support,
        options.min_confidence,
        options.tau,
        options.width,
        options.step,
        options.include_literals,
    )
    fd.top_rules(found.rules).select(
        "window_id", "antecedent", "consequent", "confidence", "support", "lift"
    ).show(truncate=55)
    fd.by_persistence(fd.persistence_label(found.metrics)).select(
        short_label("antecedent").alias("antecedent"),
        short_label("consequent").alias("consequent"),
        "kind",
        "window_series",
        F.round("confidence_drift", 3).alias("drift"),
        F.round("persistence_score", 3).alias("persistence"),
    ).show(truncate=55)
    spark.stop()


if __name__ == "__main__":
    main()
