"""python -m tidemark round --config FILE --at EPOCH_SECONDS: one calibration round per configured cohort over stored pairs."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import functions as F


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    parser.add_argument("command", choices=["round", "check"])
    parser.add_argument("--config", required=True)
    parser.add_argument("--at", type=int, help="epoch seconds; rounds end at the storage window before")
    given = parser.parse_args(args)

    from tidemark.sources import config as configs

    try:
        config = configs.load(Path(given.config).read_text())
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    if given.command == "check":
        return 0
    if given.at is None:
        parser.error("round needs --at")

    from tidemark.operators import calibration
    from tidemark.session import local_session
    from tidemark.sources import intermediates

    spark = local_session()
    failed = 0
    for cohort in config.cohorts.values():  # one cohort's failure leaves the others
        try:
            run_round(spark, calibration, intermediates, config.root, cohort, given.at)
        except Exception as e:  # noqa: BLE001
            failed += 1
            print(f"{cohort.name}: {e}", file=sys.stderr)
    return 1 if failed else 0


def run_round(spark, calibration, intermediates, root: str, cohort, at: int) -> None:
    """Aggregate the cohort's measured parts and publish the round with its carry."""
    config = cohort.round
    end = at - at % config.storage_seconds
    rounds = spark.createDataFrame([(cohort.name, end)], "cohort string, round_end long")
    truth, sweep, metas = intermediates.read_pairs(spark, root)
    mine = metas.where((F.col("cohort") == cohort.name) & F.col("window_start").between(end - config.window_seconds, end))
    sound = intermediates.sound_parts(truth, sweep, mine)
    hits = sweep.withColumn("hits", F.round(F.col("recall") * config.k).cast("long"))
    out = calibration.calibration_rounds(rounds, mine.select("part_ulid", "cohort", "window_start", "window_seconds", "received_frame_count", "record_count"), sound, truth, hits, config)
    latest = intermediates.read_latest(spark, root, "cohort string, index string, ef_grid array<int>, target struct<k:int,value:double,percentile:double>, effective struct<recommended_ef:int,confidence:double,source_round:string,carried:boolean>")
    same = (
        (F.col("round.index") == config.index) & (F.col("round.ef_grid") == F.array(*[F.lit(e) for e in config.ef_grid])) & (F.col("round.target.k") == config.k)
        & (F.col("round.target.value") == config.value) & (F.col("round.target.percentile") == config.percentile)
    )
    carry = latest.where((F.col("cohort") == cohort.name) & same).select("cohort", F.col("round.effective").alias("p"))
    joined = out.join(carry, "cohort", "left")
    own = F.col("recommended_ef").isNotNull()
    source = F.when(own, F.col("round_end")).otherwise(F.unix_timestamp("p.source_round", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    full = joined.withColumns({"effective_ef": F.coalesce("recommended_ef", "p.recommended_ef"), "effective_confidence": F.coalesce("confidence", "p.confidence"), "source_round": source}).withColumn("carried", F.when(F.col("effective_ef").isNotNull(), ~own)).drop("p")
    marked = calibration.compatible(sound, config).where("compatible")
    scope = calibration.in_scope(rounds, marked.select("part_ulid", "cohort", "window_start", "window_seconds"), config)
    efs = calibration.per_ef(calibration.population(scope, truth, config), hits, config)
    # the latest record is read for the carry and then replaced, so the result is made first
    made = calibration.round_json(full, efs, config, _stamp(at)).collect()
    intermediates.publish_rounds(spark.createDataFrame(made), root)


def _stamp(at: int) -> str:
    from datetime import UTC, datetime

    return datetime.fromtimestamp(at, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


if __name__ == "__main__":
    sys.exit(main())
