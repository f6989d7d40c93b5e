"""Segments to pairs to rounds, and the small scans and sinks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import calibration, lookup, measurement
from tidemark.operators.calibration import RoundConfig
from tidemark.sources import corpora, frames, intermediates, sinks
from tidemark.streaming import collector

CONFIG = RoundConfig(ef_grid=(10, 20), k=3, value=0.3, percentile=0.9, window_seconds=1200, storage_seconds=600, min_samples=10)
ULID = "01ARZ3NDEKTSV4RRFFQ69G5F{:02d}"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    return spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(60)], "vec_id long, embedding array<double>")


def segment(spark, root, number, start, n, bad=0, cohort="a/b"):
    r = random.Random(number)
    records = [(start * 10**6 + i, frames.encode_values(cohort, [r.gauss(0, 1) for _ in range(8)])) for i in range(n)]
    records += [(start * 10**6 + n + i, frames.encode_values(cohort, [1.0, 2.0], "f64")) for i in range(bad)]
    place = root / f"cohorts/{cohort}/window=19700101T{start // 3600:02d}{start % 3600 // 60:02d}Z"
    place.mkdir(parents=True, exist_ok=True)
    (place / f"part-{ULID.format(number)}.vseam").write_bytes(frames.write_segment(cohort, start, 600, len(records) + 2, records))


def test_round_from_segments(spark, docs, tmp_path):
    for number, start in ((10, 0), (11, 600), (12, 600)):
        segment(spark, tmp_path, number, start, 8, bad=number % 2)
    out = str(tmp_path / "out")
    scan = lambda: frames.scan_segments(spark, str(tmp_path / "cohorts"))
    row = measurement.cohort_round(spark, scan(), docs, out, "a/b", 1200, CONFIG).first()
    assert (row.status, row.measured, row.failed, row.available, row.unique) == ("ok", 24, 1, 25, 24)
    written = json.loads(next((tmp_path / "out/calibrations/latest").rglob("*.txt")).read_text())
    assert written["samples"]["measured"] == 24 and [e["ef"] for e in written["per_ef"]] == [10, 20]
    # a part that comes later is measured alone, beside the others of its window
    before = {r.part_ulid: r.record_index for r in intermediates.read_pairs(spark, out)[0].collect()}
    segment(spark, tmp_path, 13, 600, 5)
    listed = measurement.listed_parts(measurement.in_windows(scan(), "a/b", 0, 1200))
    pairs = intermediates.read_pairs(spark, out)
    todo = calibration.pending_parts(listed, pairs[0], pairs[1], pairs[2], CONFIG)
    assert [r.part_ulid for r in todo.collect()] == [ULID.format(13)]
    row = measurement.cohort_round(spark, scan(), docs, out, "a/b", 1200, CONFIG).first()
    assert row.measured == 29 and set(before) < {r.part_ulid for r in intermediates.read_pairs(spark, out)[0].collect()}
    assert measurement.cohort_round(spark, scan(), docs, out, "a/b", 1200, CONFIG, stop=lambda: True) is None
    assert frames.scan_segments(spark, str(tmp_path / "cohorts"), windows=[0]).select("part_ulid").distinct().count() == 1


def test_what_cannot_be_measured(spark, docs, tmp_path):
    segment(spark, tmp_path, 20, 0, 4)
    rows = frames.scan_segments(spark, str(tmp_path / "cohorts"))
    for wrong in (rows.withColumn("listed_cohort", F.lit("x")), rows.withColumn("listed_start", F.lit(60))):
        with pytest.raises(Exception, match="differs from its listing"):
            measurement.prepared(wrong).collect()
    with pytest.raises(Exception, match="window_seconds"):
        measurement.prepared(rows, 60).collect()
    with pytest.raises(Exception, match="fewer than 3"):
        measurement.measure(rows, docs.limit(2), CONFIG).truth.collect()
    with pytest.raises(Exception, match="listed twice"):
        measurement.listed_parts(rows.union(rows.withColumn("path", F.lit("other")))).collect()
    found = measurement.measure(rows, docs, CONFIG)
    assert measurement.shape_problems(found, CONFIG).count() == 0
    cut = measurement.Measured(found.truth.withColumn("gt_keys", F.slice("gt_keys", 1, 2)), found.sweep.where("ef = 10"), found.metas)
    assert {r.problem for r in measurement.shape_problems(cut, CONFIG).collect()} == {"keys", "grid"}
    with pytest.raises(Exception, match="finite elements"):
        measurement.checked_vectors(docs, "embedding", 9).collect()
    none = measurement.measure(rows.where("false"), docs, CONFIG)
    assert none.truth.count() == none.sweep.count() == none.metas.count() == 0


def test_population_is_checked(spark):
    samples = spark.createDataFrame([("c", 1, "p", i, i % 2 == 0) for i in range(4)], "cohort string, round_end long, part_ulid string, record_index int, is_train boolean")
    full = [("p", i, ef, 0.5, 1.0) for i in range(4) for ef in (10, 20)]
    schema = "part_ulid string, record_index int, ef int, recall double, latency_ms double"
    assert calibration.selection(samples, spark.createDataFrame(full, schema), CONFIG).count() == 1
    for rows, said in ((full[:-1], "ef grid"), ([*full[:-1], ("p", 3, 20, 1.5, 1.0)], "out of range"), ([*full[:-1], ("p", 3, 20, 0.5, float("nan"))], "out of range")):
        with pytest.raises(Exception, match=said):
            calibration.selection(samples, spark.createDataFrame(rows, schema), CONFIG).collect()


def test_round_loop_skips_ticks():
    now, ran = [0], []

    def run(tick):
        ran.append(tick)
        now[0] += 25 if len(ran) == 2 else 3

    assert measurement.round_loop(4, run, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s), 10) == (4, 2)
    assert ran == [0, 10, 40, 50]


def test_lookups(spark, docs):
    texts = spark.createDataFrame([(i, "x" * 400) for i in range(60)], "doc_id long, text string")
    embed = lambda t: F.array(*[F.length(t).cast("double") + k for k in range(8)])
    got = lookup.search_text("hello", docs, texts, 2, embed).collect()
    assert [r.rank for r in got] == [1, 2] and len(got[0].preview) == 300
    with pytest.raises(ValueError):
        lookup.previews(docs, docs, texts, 0)
    assert lookup.quote_identifier('a"b') == '"a""b"'


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b\nc", 0.5), (1, "a", None), (3, " ", 1.0)], "k int, t string, x double")
    sinks.write_lines(rows, "t", "k", str(tmp_path / "q"))
    assert [(r.line, r.text) for r in sinks.ordered_lines(spark, str(tmp_path / "q/part-*")).collect()] == [(0, "a"), (1, "b c")]
    with pytest.raises(Exception, match="no queries"):
        (tmp_path / "none.txt").write_text("\n\n")
        sinks.ordered_lines(spark, str(tmp_path / "none.txt")).collect()
    sinks.write_csv(rows.select("k", "x").orderBy("k"), str(tmp_path / "c"))
    assert next((tmp_path / "c").glob("*.csv")).read_text().splitlines() == ["k,x", "1,", "2,0.5", "3,1.0"]
    assert {r.k: r.t for r in sinks.upserted(rows, rows.where("k = 1").withColumn("t", F.lit("new")), "k").collect()} == {1: "new", 2: "b\nc", 3: " "}
    assert sinks.table_text(rows.select("k", "x").orderBy("k")) == "k  x\n1\n2  0.5000\n3  1.0000"
    ran = []
    wanted = sinks.stage_key("truth", dataset="d", k=3, metric="cosine", input_sha1="s")
    for force in (False, False, True):
        sinks.run_stage(tmp_path / "m.json", wanted, lambda: ran.append(1) or {"rows": 5}, force)
    assert len(ran) == 2 and corpora.cache_matches(json.loads((tmp_path / "m.json").read_text()), wanted)
    with pytest.raises(ValueError):
        sinks.stage_key("truth", dataset="d")
    assert sinks.index_name("x") == "docs_x_embedding_idx"


def test_counters_and_flush(spark, tmp_path):
    from pyspark.sql import Observation

    rows = spark.createDataFrame([("c", False, 10, None), ("c", True, 20, None), ("c", False, 5, "bad_magic")], "cohort string, dropped boolean, frame_bytes long, error string")
    seen = Observation("counted")
    collector.observed(rows, seen).collect()
    assert seen.get == {"received": 3, "stored": 2, "dropped": 1, "received_bytes": 35, "invalid": 1}
    frame = frames.encode_values("c", [1.0])
    batch = spark.createDataFrame([(ULID.format(30), "c", 0, 600, 2, i, i, frame) for i in range(2)], "part_ulid string, cohort string, window_start long, window_seconds int, received_frame_count long, record_index int, receive_time_us long, frame binary")
    flush = collector.flush_segments(str(tmp_path / "s"))
    flush(batch, 0)
    flush(batch, 0)
    out = spark.read.parquet(str(tmp_path / "s")).collect()
    assert len(out) == 1 and frames.read_segment(bytes(out[0].segment))[0]["record_count"] == 2 and out[0].key.startswith("cohorts/c/window=19700101T0000Z/part-")
