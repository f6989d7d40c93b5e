import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import calibration, sampling, search, summaries
from tidemark.operators.calibration import RoundConfig
from tidemark.operators.hnsw import Hnsw
from tidemark.sources import frames


def vectors(spark, n=300, dim=16, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")


def test_exact_topk_matches_numpy(spark):
    x, docs = vectors(spark)
    queries = docs.where("vec_id % 20 = 0")
    got = {r.qid: r.gt_keys for r in search.as_lists(search.exact_topk(queries, docs, 5)).collect()}
    for q in range(0, 300, 20):
        dist = 1 - x @ x[q]
        dist[q] = np.inf
        assert got[q] == np.argsort(dist, kind="stable")[:5].tolist()


def test_ties_nulls_and_empty(spark):
    docs = spark.createDataFrame([(9, [1.0, 0.0]), (7, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (None, [1.0, 0.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r.did, round(r.dist, 6)) for r in search.exact_topk(docs.where("vec_id = 1"), docs, 5).orderBy("rank").collect()]
    assert got == [(7, 1.0), (9, 1.0)]
    assert search.exact_topk(docs.where("false"), docs, 5).count() == 0


def test_effort_is_monotone_and_exact_at_all(spark):
    _, docs = vectors(spark)
    queries = docs.where("vec_id % 20 = 0")
    truth = search.as_lists(search.exact_topk(queries, docs, 10))
    rows = search.sweep_recall(truth, search.CandidateBudget(4).search(queries, docs, 10, [10, 40, 300]), 10).groupBy("ef").agg(F.sum("hits").alias("h")).orderBy("ef").collect()
    hits = [r.h for r in rows]
    assert hits == sorted(hits) and hits[-1] == 150
    graph = search.sweep_recall(truth, Hnsw().search(queries, docs, 10, [10, 160]), 10).groupBy("ef").agg(F.avg("recall").alias("r")).orderBy("ef").collect()
    assert graph[1].r >= 0.95 and graph[0].r <= graph[1].r + 1e-9


def test_table_smaller_than_k_fails(spark):
    _, docs = vectors(spark, 5)
    truth = search.require_k(search.as_lists(search.exact_topk(docs, docs, 10)), 10)
    with pytest.raises(Exception, match="fewer than 10"):
        truth.collect()


def test_crossings(spark):
    rows = spark.createDataFrame([("a", 10, 0.2), ("a", 20, 0.6), ("b", 10, 0.5), ("b", 20, 0.9), ("c", 10, 0.1), ("c", 20, 0.2)], "dataset string, ef int, recall_mean double")
    got = {r.dataset: r.crossing_ef for r in summaries.crossings(rows, 0.5).collect()}
    assert got["a"] == pytest.approx(17.5) and got["b"] == 10.0 and got["c"] is None


@pytest.mark.parametrize("change", [{"storage_seconds": 0}, {"storage_seconds": 90}, {"window_seconds": 500}, {"window_seconds": 86_500}, {"k": 0}, {"value": 0.0}, {"percentile": 1.0}, {"ef_grid": ()}, {"ef_grid": (20, 10)}, {"ef_grid": (5,)}, {"ef_grid": (10, 1001)}, {"train_fraction": 1.0}, {"min_samples": 9}])
def test_config_is_checked(change):
    with pytest.raises(ValueError):
        RoundConfig(**change)


CONFIG = RoundConfig(window_seconds=3600, storage_seconds=600)
PARTS = "part_ulid string, cohort string, window_start long, window_seconds int, received_frame_count long, record_count long"


def test_accounting(spark):
    rounds = spark.createDataFrame([("c", 7200), ("d", 7200)], "cohort string, round_end long")
    rows = [("a", "c", 3600, 600, 100, 80), ("b", "c", 4200, 600, 50, 50), ("b", "c", 4200, 600, 50, 50), ("late", "c", 7200, 600, 9, 9), ("early", "c", 3000, 600, 9, 9)]
    got = {r.cohort: r for r in calibration.accounting(rounds, spark.createDataFrame(rows, PARTS), CONFIG).collect()}
    assert got["c"].dropped_frame_fraction == pytest.approx(2 / 15) and got["c"].windows_with_parts == 2 and got["c"].empty_window_fraction == pytest.approx(4 / 6)
    assert got["d"].available == 0 and got["d"].empty_window_fraction == 1.0 and got["d"].dropped_frame_fraction == 0.0


def test_conflicting_parts_fail(spark):
    rows = [("a", "c", 3600, 600, 100, 80), ("a", "c", 3600, 600, 100, 81)]
    with pytest.raises(Exception, match="conflicting"):
        calibration.unique_parts(spark.createDataFrame(rows, PARTS)).collect()


def test_dedup_keeps_the_first(spark):
    rows = spark.createDataFrame([("p0", 3, 5), ("p0", 5, 5), ("p0", 9, 5), ("p1", 0, 5)], "part_ulid string, record_index int, vector_hash long").withColumn("receive_time_us", F.col("record_index").cast("long"))
    first = calibration.first_in_part(rows).orderBy("part_ulid").collect()
    assert [(r.part_ulid, r.record_index, r.dup_count) for r in first] == [("p0", 3, 3), ("p1", 0, 1)]
    one = calibration.deduplicated(rows.drop("receive_time_us"), []).collect()
    assert [(r.part_ulid, r.record_index) for r in one] == [("p0", 3)]


def test_carry(spark):
    rows = [("c", t, fp, ef, 0.5 if ef else None) for t, fp, ef in ((1, "x", None), (2, "x", 40), (3, "x", None), (4, "y", None), (5, "y", 80), (6, "x", None))]
    got = calibration.effective(spark.createDataFrame(rows, "cohort string, round_end long, fingerprint string, recommended_ef int, confidence double")).orderBy("round_end").collect()
    assert [(r.effective_ef, r.carried, r.source_round) for r in got] == [(None, None, None), (40, False, 2), (40, True, 2), (None, None, None), (80, False, 5), (None, None, None)]


def test_adaptive_sampler_follows_the_rules(spark):
    seconds = [0, 1, 2, 3, 4] * 4 + [5, 6] + [15] + [200]
    rows = spark.createDataFrame([("c", s) for s in seconds], "cohort string, second long")
    got = sampling.adaptive_rates(rows, 1.0).orderBy("bucket").collect()
    assert [(r.bucket, r.rate) for r in got] == [(0, 0.0), (1, 2.0), (3, 0.6), (40, 0.0)]
    assert [r.probability for r in got] == [1.0, 0.5, 1.0, 1.0]


def test_queue_and_split(spark):
    rows = spark.createDataFrame([(1, i, b) for i, b in enumerate((60, 50, 30, 20))], "w int, i int, frame_bytes long").withColumn("sampled", F.lit(True))
    got = [r.outcome for r in sampling.queue_outcomes(rows, 100, ["w"], ["i"]).orderBy("i").collect()]
    assert got == ["enqueued", "queue_full", "enqueued", "queue_full"]
    cut = [(r.spill_no, r.record_index) for r in sampling.split_parts(rows, 100, ["w"], ["i"]).orderBy("i").collect()]
    assert cut == [(0, 0), (1, 0), (1, 1), (1, 2)]


def test_frames_and_segments(spark, tmp_path):
    frame = frames.encode_values("a/b", [1.0, -2.5])
    assert frames.frame_error(frame)[1][:2] == (1, 2)
    cases = {"truncated": frame[:10], "length_mismatch": frame + b"x", "bad_magic": frame[:4] + b"XXXX" + frame[8:], "bad_version": frame[:8] + b"\2\0\0\0" + frame[12:], "name_exceeds_frame": frame[:16] + b"\xff\0\0\0" + frame[20:]}
    assert {k: frames.frame_error(v)[0] for k, v in cases.items()} == {k: k for k in cases}
    for dtype in frames.DTYPES:
        error, got = frames.frame_error(frames.encode_values("n", [1.0, 2.0, 3.0], dtype))
        assert error is None and frames.decode_vector(got[0], got[4]).tolist() == [1.0, 2.0, 3.0]
    rows = spark.createDataFrame([("P1", "a/b", 600, 600, 3, i, 600_000_000 + i, bytearray(frame)) for i in range(2)], "part_ulid string, cohort string, window_start long, window_seconds int, received_frame_count long, record_index int, receive_time_us long, frame binary")
    built = frames.build_segments(rows).first()
    (tmp_path / "part-P1.vseam").write_bytes(built.segment)
    (tmp_path / "part-P2.vseam").write_bytes(frames.write_segment("a", 0, 600, 5, []))
    got = frames.scan_segments(spark, str(tmp_path)).orderBy("part_ulid", "record_index").collect()
    assert [(r.part_ulid, r.record_index, r.received_frame_count) for r in got] == [("P1", 0, 3), ("P1", 1, 3), ("P2", None, 5)]
    assert bytes(got[0].frame) == frame
    with pytest.raises(ValueError):
        frames.read_segment(built.segment[:-1])
