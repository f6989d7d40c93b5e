import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import hashing, stats, text, vectors, windows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def fnv(data: bytes) -> int:
    h = hashing.OFFSET_BASIS
    for b in data:
        h = (h ^ b) * hashing.PRIME % (1 << 64)
    return h


@pytest.mark.parametrize("value,expected", [("", "cbf29ce484222325"), ("a", "af63dc4c8601ec8c"), ("foobar", "85944171f73967e8")])
def test_fnv_constants(spark, value, expected):
    assert one(spark, hashing.limbs_hex(hashing.fnv1a_limbs(F.lit(value)))) == expected


def test_fnv_and_split_match_plain_python(spark):
    values = [f"v:{i}" for i in range(200)] + ["x" * 100]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", hashing.limbs_decimal(hashing.fnv1a_limbs(F.col("v"))).alias("h"))
    got = rows.select("v", "h", hashing.is_train_member(F.col("h"), 3, 0.7).alias("t")).collect()
    assert all(int(r.h) == fnv(r.v.encode()) and r.t == (fnv(f"s:3:{fnv(r.v.encode())}".encode()) % 10000 < 7000) for r in got)


def test_payload_hash(spark):
    data = [b"", b"a", b"foobar", bytes(range(256)), None]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, d binary").repartition(1)
    got = {r.i: r.h for r in rows.select("i", hashing.unsigned(hashing.payload_hash("d")).alias("h")).collect()}
    assert got[4] is None and all(int(got[i]) == fnv(d) for i, d in enumerate(data[:4]))


def test_split_threshold_rounds_half_up():
    assert hashing.split_threshold(0.00025) == 3
    for bad in (0.0, 1.0, math.nan, 0.00004):
        with pytest.raises(ValueError):
            hashing.split_threshold(bad)


def test_windows(spark):
    assert [one(spark, windows.aligned_window_start(F.lit(t), 600)) for t in (600, 1199, 1200)] == [600, 600, 1200]
    assert one(spark, windows.compact_timestamp(F.lit(1784116800))) == "20260715T1200Z"
    assert one(spark, windows.iso_minute(F.lit(1784116800))) == "2026-07-15T12:00:00Z"
    assert one(spark, windows.part_of_path(F.lit("x/part-01K0A000000000000000000000.vseam"))) == "01K0A000000000000000000000"
    assert one(spark, windows.part_of_path(F.lit("x/part-1.vseam"))) is None
    assert windows.next_tick(0, 60, 60) == (120, 1) and windows.next_tick(0, 120, 60) == (180, 2) and windows.next_tick(0, 0, 60) == (60, 0)
    assert windows.next_tick(0, 50, 60) == (60, 0) and windows.next_tick(0, 130, 60) == (180, 2)


def test_recall(spark):
    arr = lambda xs: F.array(*[F.lit(x) for x in xs])
    assert one(spark, vectors.recall_at_k(arr(range(1, 11)), arr([1, 2, 3, *range(11, 18)]), 10)) == 0.3
    assert one(spark, vectors.recall_at_k(arr(range(1, 11)), arr([1, 2, 3, 4, 5, 5, 77]), 10)) == 0.5
    assert one(spark, vectors.vector_text(arr([0.5, -1.25]))) == "[0.5,-1.25]" or one(spark, vectors.vector_text(arr([0.5, -1.25]))).startswith("[0.5")


@pytest.mark.parametrize("xs,q,expected", [([0.5, 0.7, 0.9, 1.0], 1.0 - 0.95, 0.53), ([0.4], 0.3, 0.4)])
def test_quantile_literals(spark, xs, q, expected):
    assert one(spark, stats.type7(F.array(*[F.lit(x) for x in xs]), q)) == pytest.approx(expected, abs=1e-15)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 10), min_size=1, max_size=30))
def test_quantile_is_bounded_and_exact(spark, tenths):
    xs = [t / 10 for t in tenths]
    q = 1.0 - 0.9
    h = (len(xs) - 1) * q
    lo = math.floor(h)
    s = sorted(xs)
    expected = s[lo] + (h - lo) * (s[min(lo + 1, len(s) - 1)] - s[lo])
    assert one(spark, stats.type7(F.array(*[F.lit(x) for x in xs]), q)) == expected


def test_confidence(spark):
    get = lambda n, m, p: one(spark, stats.transfer_confidence(F.lit(n).cast("long"), F.lit(m).cast("long"), p))
    assert get(100, 100, 0.95) == pytest.approx(0.994375497, abs=1e-9)
    assert get(100, 0, 0.95) < 1e-6
    exact = sum(math.comb(51, j) * 0.9**j * 0.1 ** (51 - j) for j in range(46))
    assert get(50, 45, 0.9) == pytest.approx(exact, abs=1e-12)
    assert 0.0 <= get(20000, 18100, 0.9) <= 1.0


@pytest.mark.parametrize("value,ef,met", [(0.9, 40, True), (0.99, 160, False)])
def test_selection(spark, value, ef, met):
    rows = spark.createDataFrame([(10, 0.62), (20, 0.85), (40, 0.91), (80, 0.93), (160, 0.95)], "ef int, q double")
    got = rows.agg(stats.select_ef(F.col("ef"), F.col("q"), value).alias("ef"), stats.target_met(F.col("q"), value).alias("met")).first()
    assert (got.ef, got.met) == (ef, met)


def test_text(spark):
    assert text.html_text("<p>a &amp; b</p><div>c<br>d</div>") == "a & b c d"
    assert one(spark, text.fold_html_sql(F.lit("<p>a &amp; b</p><div>c<br>d</div>"))) == "a & b c d"
    assert one(spark, text.parse_tags(F.lit("<a&amp;b&gt;&lt;c&eacute;>"))) == ["a&b", "cé"]
    assert one(spark, text.parse_tags(F.lit("&lt;a&gt;<b-c>"))) == ["a", "b-c"] and one(spark, text.parse_tags(F.lit(None).cast("string"))) == []
    assert one(spark, text.parse_int(F.lit(""))) == 0 and one(spark, text.parse_int(F.lit("12"))) == 12
    assert not one(spark, text.accept_text(F.lit(" [Removed] "), 3)) and one(spark, text.accept_text(F.lit("words"), 3))
    assert text.stream_seed(7, "a", "b") == 7 + ord("a") + ord(":") + ord("b")


@pytest.mark.parametrize("name,error", [("a/b", None), ("", "empty"), ("/a", "empty_segment"), ("a/", "empty_segment"), ("a/../b", "dot_segment"), ("window=1", "reserved_window_segment"), ("a b", "invalid_segment"), ("é", "non_ascii"), ("/".join("a" * 9), "too_many_segments"), ("a" * 64, "segment_too_long"), ("a" * 256, "name_too_long")])
def test_cohort_grammar(spark, name, error):
    assert one(spark, text.cohort_error(F.lit(name))) == error
