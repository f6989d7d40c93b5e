"""Every registered query of the engine proper, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import hashing, text, windows
from tidemark.functions.vectors import vector_text
from tidemark.operators import calibration, lookup, measurement, sampling, search, summaries
from tidemark.operators.hnsw import Hnsw
from tidemark.plans import data
from tidemark.plans.data import CONFIG, DAY, EFS, EVERY, K, WINDOW, table
from tidemark.sources import frames
from tidemark.streaming import collector

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


# Pieces of SQL that several oracles start from.

Q7 = "list_sort({x})[floor((len({x}) - 1) * ({q}))::INT + 1] + ((len({x}) - 1) * ({q}) - floor((len({x}) - 1) * ({q}))) * (list_sort({x})[least(floor((len({x}) - 1) * ({q}))::INT + 2, len({x}))] - list_sort({x})[floor((len({x}) - 1) * ({q}))::INT + 1])"


def q7(values: str, q: str) -> str:
    return Q7.format(x=values, q=q)


FNV = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split({s}, ''), lambda c: ascii(c)::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"
VECS = f"""
vecs AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
pairs AS (
  SELECT q.vec_id AS qid, d.vec_id AS did, CASE WHEN q.label < 5 THEN 'low' ELSE 'high' END AS dataset,
         1 - list_dot_product(q.e, d.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(d.e, d.e))) AS dist,
         list_dot_product(q.e[1:16], d.e[1:16]) AS coarse
  FROM vecs q JOIN vecs d ON q.vec_id <> d.vec_id WHERE q.vec_id % {EVERY} = 0),
truth AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, did) AS rank FROM pairs) WHERE rank <= {K}),
placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY coarse DESC, did) AS place FROM pairs),
tried AS (SELECT p.*, ef FROM placed p, unnest({EFS}) AS t(ef) WHERE place <= ef),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, ef ORDER BY dist, did) AS r FROM tried) WHERE r <= {K}),
sweep AS (
  SELECT f.qid, f.dataset, f.ef::INT AS ef, count(t.did) AS hits, count(t.did) / {float(K)}::DOUBLE AS recall, count(*) AS result_count, f.ef / 10.0::DOUBLE + f.qid % 7 AS latency_ms
  FROM found f LEFT JOIN truth t ON t.qid = f.qid AND t.did = f.did GROUP BY f.qid, f.dataset, f.ef)"""
CAPTURES = f"""
captures AS (
  SELECT event_id, 'events/' || event_type AS cohort, epoch_us(ts) AS receive_time_us, epoch_us(ts) // 1000000 AS second,
         ((user_id * 31 + event_id) % (SELECT (max(vec_id) + {EVERY}) // {EVERY} FROM embeddings)) * {EVERY} AS vec_id,
         (epoch_us(ts) // 1000000) - (epoch_us(ts) // 1000000) % {WINDOW} AS window_start, 284 + length('events/' || event_type) AS frame_bytes, event_id % 17 = 0 AS dropped
  FROM events),
placed_records AS (
  SELECT *, (row_number() OVER (PARTITION BY cohort, window_start ORDER BY receive_time_us, event_id) - 1) AS i, {data.CAP_BYTES} // frame_bytes AS per FROM captures WHERE NOT dropped),
records AS (
  SELECT *, i // per AS spill_no, (i % per)::INT AS record_index, lpad(window_start::VARCHAR, 12, '0') || '-' || lpad((i // per)::VARCHAR, 4, '0') || '-' || cohort AS part_ulid FROM placed_records),
drops AS (SELECT cohort, window_start, count(*) AS n FROM captures WHERE dropped GROUP BY 1, 2),
parts AS (
  SELECT part_ulid, cohort, window_start, {WINDOW} AS window_seconds, (count(*) + CASE WHEN spill_no = 0 THEN coalesce(any_value(n), 0) ELSE 0 END)::BIGINT AS received_frame_count, count(*) AS record_count,
         min(receive_time_us) AS first_receive, max(receive_time_us) AS last_receive
  FROM records LEFT JOIN drops USING (cohort, window_start) GROUP BY part_ulid, cohort, window_start, spill_no),
part_truth AS (SELECT part_ulid, vec_id, min(record_index) AS record_index, count(*)::INT AS dup_count, arg_min(receive_time_us, record_index) AS receive_time_us FROM records GROUP BY 1, 2),
rounds AS (
  SELECT cohort, unnest(range(a - a % {DAY} + {DAY}, b - b % {DAY} + 2 * {DAY}, {DAY})) AS round_end FROM (SELECT cohort, min(second) AS a, max(second) AS b FROM captures GROUP BY 1)),
scope AS (
  SELECT r.round_end, p.* FROM rounds r JOIN parts p ON p.cohort = r.cohort AND p.window_start >= r.round_end - {CONFIG.window_seconds} AND p.window_start + p.window_seconds <= r.round_end)"""
ACCOUNT = f"""
account AS (
  SELECT r.cohort, r.round_end, coalesce(sum(record_count), 0)::BIGINT AS available, coalesce(sum(received_frame_count), 0)::BIGINT AS received,
         CASE WHEN coalesce(sum(received_frame_count), 0) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - sum(record_count)::DOUBLE / sum(received_frame_count)::DOUBLE END AS dropped_frame_fraction,
         {CONFIG.window_seconds // WINDOW}::BIGINT AS windows_in_scope, count(DISTINCT window_start) AS windows_with_parts,
         ({CONFIG.window_seconds // WINDOW} - count(DISTINCT window_start)) / {float(CONFIG.window_seconds // WINDOW)}::DOUBLE AS empty_window_fraction
  FROM rounds r LEFT JOIN scope s ON s.cohort = r.cohort AND s.round_end = r.round_end GROUP BY 1, 2)"""
POPULATION = f"""
hashes AS (SELECT vec_id, {FNV.format(s="'v:' || vec_id::VARCHAR")} AS vector_hash FROM embeddings),
sides AS (SELECT vec_id, vector_hash, ({FNV.format(s=f"'s:{CONFIG.split_seed}:' || vector_hash::VARCHAR")} % 10000) < {hashing.split_threshold(CONFIG.train_fraction)} AS is_train FROM hashes),
used AS (SELECT *, (window_start // {WINDOW}) % 11 <> 0 AS fits FROM scope),
population AS (
  SELECT u.cohort, u.round_end, t.vec_id, any_value(s.is_train) AS is_train, any_value(400.5::DOUBLE + t.vec_id % 5) AS latency_ms
  FROM used u JOIN part_truth t USING (part_ulid) JOIN sides s ON s.vec_id = t.vec_id WHERE fits GROUP BY 1, 2, 3)"""
SELECTION = f"""
measured AS (SELECT part_ulid, count(*) AS n FROM part_truth GROUP BY 1),
counted AS (
  SELECT cohort, round_end, coalesce(sum(n) FILTER (WHERE fits), 0)::BIGINT AS measured, 0::BIGINT AS failed, count(*) FILTER (WHERE fits) AS parts_used, count(*) FILTER (WHERE NOT fits) AS incompatible_parts
  FROM used JOIN measured USING (part_ulid) GROUP BY 1, 2),
sized AS (SELECT cohort, round_end, count(*) AS u, count(*) FILTER (WHERE is_train) AS train, count(*) FILTER (WHERE NOT is_train) AS test, sum(latency_ms) / count(*) AS gt FROM population GROUP BY 1, 2),
lists AS (
  SELECT cohort, round_end, ef, list(recall) FILTER (WHERE is_train) AS a, list(recall) FILTER (WHERE NOT is_train) AS b, count(*) FILTER (WHERE NOT is_train) AS n, count(*) FILTER (WHERE NOT is_train AND recall >= {CONFIG.value}) AS m
  FROM population p JOIN sweep s ON s.qid = p.vec_id GROUP BY 1, 2, 3),
quantiles AS (SELECT cohort, round_end, ef, n, m, {q7("a", "1.0::DOUBLE - 0.9::DOUBLE")} AS tq, {q7("b", "1.0::DOUBLE - 0.9::DOUBLE")} AS hq FROM lists),
chosen AS (SELECT cohort, round_end, coalesce(min(ef) FILTER (WHERE tq >= {CONFIG.value}), max(ef)) AS ef, coalesce(bool_or(tq >= {CONFIG.value}), false) AS met FROM quantiles GROUP BY 1, 2),
picked AS (
  SELECT q.cohort, q.round_end, q.ef AS recommended_ef, met, hq >= {CONFIG.value} AS transferred, tq AS train_quantile_recall, hq AS test_quantile_recall,
         list_sum(list_transform(range(0, m + 1), lambda j: exp(lgamma(n + 2) - lgamma(j + 1) - lgamma(n + 2 - j) + j * ln(0.9::DOUBLE) + (n + 1 - j) * ln(0.1::DOUBLE)))) AS confidence
  FROM quantiles q JOIN chosen c ON c.cohort = q.cohort AND c.round_end = q.round_end AND c.ef = q.ef),
merged AS (
  SELECT a.*, coalesce(measured, 0)::BIGINT AS measured, coalesce(failed, 0)::BIGINT AS failed, coalesce(parts_used, 0)::BIGINT AS parts_used, coalesce(incompatible_parts, 0)::BIGINT AS incompatible_parts,
         coalesce(u, 0)::BIGINT AS "unique", coalesce(train, 0)::BIGINT AS train, coalesce(test, 0)::BIGINT AS test, gt AS ground_truth_latency_mean_ms, p.recommended_ef, met, transferred, train_quantile_recall, test_quantile_recall, confidence,
         coalesce(u, 0) < {CONFIG.min_samples} OR coalesce(train, 0) = 0 OR coalesce(test, 0) = 0 AS refused
  FROM account a LEFT JOIN counted c USING (cohort, round_end) LEFT JOIN sized s USING (cohort, round_end) LEFT JOIN picked p USING (cohort, round_end)),
results AS (
  SELECT cohort, round_end, strftime(make_timestamp((round_end - {CONFIG.window_seconds}) * 1000000), '%Y-%m-%dT%H:%M:00Z') AS window_from, strftime(make_timestamp(round_end * 1000000), '%Y-%m-%dT%H:%M:00Z') AS window_to,
         CASE WHEN refused THEN 'insufficient_samples' WHEN met THEN 'ok' ELSE 'target_unmet' END AS status, CASE WHEN NOT refused THEN recommended_ef END AS recommended_ef, CASE WHEN NOT refused THEN round(confidence, 9) END AS confidence,
         CASE WHEN NOT refused THEN transferred END AS transferred, CASE WHEN NOT refused THEN train_quantile_recall END AS train_quantile_recall, CASE WHEN NOT refused THEN test_quantile_recall END AS test_quantile_recall,
         available, measured, failed, "unique", train, test, dropped_frame_fraction, empty_window_fraction, windows_in_scope, windows_with_parts, parts_used, incompatible_parts, round(ground_truth_latency_mean_ms, 9) AS ground_truth_latency_mean_ms
  FROM merged)"""
SUMMARY = f"""count(*) AS query_count, sum(hits) / (count(*) * {float(K)}::DOUBLE) AS recall_mean, {q7("list(recall)", "0.9::DOUBLE")} AS recall_p90, {q7("list(recall)", "0.5::DOUBLE")} AS recall_p50,
{q7("list(recall)", "0.1::DOUBLE")} AS recall_p10, {q7("list(recall)", "0.05::DOUBLE")} AS recall_p05, count(*) FILTER (WHERE recall < 0.9) / count(*)::DOUBLE AS frac_below_0_9"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration_summary(spark, sf_dir)


# Search


@_query(f"WITH {VECS} SELECT qid, rank::INT AS rank, did, round(dist, 6) AS dist FROM truth")
def exact_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = data.corpus(spark, sf_dir)
    return search.exact_topk(data.query_set(docs), docs, K).select("qid", "rank", "did", F.round("dist", 6).alias("dist"))


@_query(f"WITH {VECS} SELECT qid, ef, hits, recall, result_count FROM sweep")
def candidate_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.sweep(spark, sf_dir).select("qid", "ef", "hits", "recall", "result_count")


@_query()
def hnsw_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.sweep(spark, sf_dir, Hnsw()).select("qid", "ef", "hits", "recall", "result_count")


@_query(f"WITH {VECS}, g AS (SELECT qid, dist, lead(dist) OVER (PARTITION BY qid ORDER BY dist, did) - dist AS gap, row_number() OVER (PARTITION BY qid ORDER BY dist, did) AS r FROM pairs) SELECT round(min(gap), 6) AS min_gap, count(*) AS queries FROM g WHERE r = {K}")
def boundary_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = data.corpus(spark, sf_dir)
    return search.boundary_gap(data.query_set(docs), docs, K).agg(F.round(F.min("gap"), 6).alias("min_gap"), F.count(F.lit(1)).alias("queries"))


@_query(f"WITH {VECS} SELECT t.qid, t.did, v.label, CASE WHEN v.label < 5 THEN 'low' ELSE 'high' END AS dataset FROM truth t JOIN vecs v ON v.vec_id = t.did")
def result_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = data.corpus(spark, sf_dir)
    top = search.exact_topk(data.query_set(docs), docs, K).select("qid", "did")
    out = search.attach_attributes(top, docs.select("vec_id", "label"), "did", "vec_id")
    return out.select("qid", "did", "label", F.when(F.col("label") < 5, "low").otherwise("high").alias("dataset"))


# Summaries


@_query(f"WITH {VECS} SELECT ef, {SUMMARY} FROM sweep GROUP BY ef")
def calibration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.effort_summary(data.sweep(spark, sf_dir), K, ("ef",))


@_query(f"WITH {VECS} SELECT dataset, ef, {SUMMARY} FROM sweep GROUP BY dataset, ef")
def summary_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.effort_summary(data.sweep(spark, sf_dir), K)


@_query(f"WITH {VECS} SELECT dataset, ef, avg(latency_ms) AS latency_mean_ms, {q7('list(latency_ms)', '0.5::DOUBLE')} AS latency_p50_ms, {q7('list(latency_ms)', '0.9::DOUBLE')} AS latency_p90_ms FROM (SELECT dataset, ef, round(latency_ms) AS latency_ms FROM sweep) GROUP BY dataset, ef")
def latency_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.sweep(spark, sf_dir)
    return summaries.latency_summary(rows.withColumn("latency_ms", F.round("latency_ms")))


CROSSING = f"""{VECS}, s AS (SELECT dataset, ef, {SUMMARY} FROM sweep GROUP BY dataset, ef),
steps AS (SELECT dataset, ef::DOUBLE AS ef, recall_mean AS r, lead(ef::DOUBLE) OVER w AS ef2, lead(recall_mean) OVER w AS r2 FROM s WINDOW w AS (PARTITION BY dataset ORDER BY ef)),
ats AS (SELECT dataset, ef, CASE WHEN r = 0.5 THEN ef WHEN r2 IS NULL OR (r - 0.5) * (r2 - 0.5) > 0 THEN NULL WHEN r2 = r THEN ef ELSE ef + (0.5 - r) / (r2 - r) * (ef2 - ef) END AS hit FROM steps),
crossed AS (SELECT dataset, arg_min(hit, ef) FILTER (WHERE hit IS NOT NULL) AS crossing_ef FROM ats GROUP BY dataset)"""


@_query(f"WITH {CROSSING} SELECT dataset, round(crossing_ef, 9) AS crossing_ef FROM crossed")
def recall_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.crossings(summary_by_dataset(spark, sf_dir), 0.5).select("dataset", F.round("crossing_ef", 9).alias("crossing_ef"))


@_query(f"WITH {CROSSING} SELECT round(max(crossing_ef) - min(crossing_ef), 9) AS gap, count(crossing_ef) AS datasets_crossing FROM crossed")
def crossing_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.crossing_gap(summaries.crossings(summary_by_dataset(spark, sf_dir), 0.5)).select(F.round("gap", 9).alias("gap"), "datasets_crossing")


@_query(f"WITH {VECS} SELECT dataset, count(*) AS n, {q7('list(recall)', '0.25::DOUBLE')} AS q1, {q7('list(recall)', '0.5::DOUBLE')} AS median, {q7('list(recall)', '0.75::DOUBLE')} AS q3, min(recall) AS low, max(recall) AS high FROM sweep WHERE ef = 40 GROUP BY dataset")
def recall_boxplot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.boxplot(data.sweep(spark, sf_dir), 40)


@_query(f"""WITH {VECS}, ids AS (SELECT DISTINCT dataset, qid FROM sweep),
split AS (SELECT dataset, qid, row_number() OVER (PARTITION BY dataset ORDER BY md5('7:' || dataset || ':' || qid::VARCHAR), qid) <= floor(count(*) OVER (PARTITION BY dataset) * 0.7::DOUBLE) AS is_train FROM ids),
l AS (SELECT s.dataset, ef, list(recall) FILTER (WHERE is_train) AS a, list(recall) FILTER (WHERE NOT is_train) AS b, count(*) FILTER (WHERE is_train) AS train_queries, count(*) FILTER (WHERE NOT is_train) AS test_queries FROM sweep s JOIN split p ON p.dataset = s.dataset AND p.qid = s.qid GROUP BY 1, 2),
q AS (SELECT dataset, ef, train_queries, test_queries, {q7('a', '0.1::DOUBLE')} AS tq, {q7('b', '0.1::DOUBLE')} AS hq FROM l),
c AS (SELECT dataset, coalesce(min(ef) FILTER (WHERE tq >= 0.5), max(ef)) AS ef, bool_or(tq >= 0.5) AS cleared FROM q GROUP BY dataset)
SELECT q.dataset, q.ef AS selected_ef, tq AS train_p10, hq AS test_p10, hq >= 0.5 AS test_clears, train_queries, test_queries, CASE WHEN cleared THEN 'least ef whose train quantile meets the target' ELSE 'no ef meets the target on train' END AS selection_note
FROM q JOIN c ON c.dataset = q.dataset AND c.ef = q.ef""")
def calibration_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.calibration_transfer(data.sweep(spark, sf_dir), 0.5, 0.1)


# Collection


@_query(f"WITH {CAPTURES} SELECT * FROM parts")
def segment_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.parts(spark, sf_dir)


@_query(f"WITH {CAPTURES} SELECT * FROM part_truth")
def part_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.first_in_part(data.records(spark, sf_dir), "vec_id").select("part_ulid", "vec_id", "record_index", "dup_count", "receive_time_us")


@_query(f"WITH {CAPTURES} SELECT DISTINCT part_ulid, 'cohorts/' || cohort || '/window=' || strftime(make_timestamp(window_start * 1000000), '%Y%m%dT%H%MZ') || '/part-' || part_ulid || '.vseam' AS object_key, strftime(make_timestamp(window_start * 1000000), '%Y-%m-%dT%H:%M:00Z') AS window_iso FROM parts")
def object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.parts(spark, sf_dir).select("part_ulid", windows.segment_key(F.col("cohort"), F.col("window_start"), F.col("part_ulid")).alias("object_key"), windows.iso_minute(F.col("window_start")).alias("window_iso"))


@_query(f"WITH {CAPTURES}, {ACCOUNT} SELECT * FROM account")
def round_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.accounting(data.rounds(spark, sf_dir), data.parts(spark, sf_dir), CONFIG)


@_query("""SELECT event_id, 'events/' || event_type AS cohort, 64 AS dimension, true AS same FROM events""")
def frame_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each capture encoded as a frame and parsed again."""
    vectors = data.corpus(spark, sf_dir).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    rows = data.captures(spark, sf_dir).join(vectors, "vec_id")
    parsed = rows.select("event_id", "cohort", "e", frames.parse_frame(frames.build_frame(F.col("cohort"), F.col("e"))).alias("p"))
    return parsed.select("event_id", F.col("p.cohort").alias("cohort"), F.col("p.dimension").alias("dimension"), (frames.sample_error(F.col("p"), F.col("cohort")).isNull() & (F.col("p.values") == F.col("e"))).alias("same"))


# Calibration


@_query(f"WITH {CAPTURES}, {POPULATION} SELECT cohort, round_end, vec_id, is_train FROM population")
def round_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _samples(spark, sf_dir)
    ids = data.hashes(spark, sf_dir)
    return samples.join(ids, "vector_hash").select("cohort", "round_end", "vec_id", "is_train")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = calibration.in_scope(data.rounds(spark, sf_dir), data.parts(spark, sf_dir), CONFIG).select("cohort", "round_end", "part_ulid")
    fit = calibration.compatible(data.metas(spark, sf_dir), CONFIG).where("compatible").select("part_ulid")
    return calibration.population(scope.join(fit, "part_ulid"), data.part_truth(spark, sf_dir), CONFIG)


def _rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = calibration.calibration_rounds(data.rounds(spark, sf_dir), data.parts(spark, sf_dir), data.metas(spark, sf_dir), data.part_truth(spark, sf_dir), data.part_sweep(spark, sf_dir), CONFIG)
    return out.withColumns({"confidence": F.round("confidence", 9), "ground_truth_latency_mean_ms": F.round("ground_truth_latency_mean_ms", 9)})


@_query(f"WITH {VECS}, {CAPTURES}, {ACCOUNT}, {POPULATION}, {SELECTION} SELECT * FROM results")
def calibration_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounds(spark, sf_dir).drop("error")


@_query(f"WITH {VECS}, {CAPTURES}, {POPULATION} SELECT cohort, round_end, ef, {q7('list(recall)', '1.0::DOUBLE - 0.9::DOUBLE')} AS quantile_recall, sum(hits) / (count(*) * {float(K)}::DOUBLE) AS mean_recall, {q7('list(s.latency_ms)', '0.5::DOUBLE')} AS latency_p50_ms, count(*) AS n FROM population p JOIN sweep s ON s.qid = p.vec_id GROUP BY 1, 2, 3")
def round_per_ef(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.per_ef(_samples(spark, sf_dir), data.part_sweep(spark, sf_dir), CONFIG)


@_query(f"""WITH {VECS}, {CAPTURES}, {ACCOUNT}, {POPULATION}, {SELECTION},
marked AS (SELECT cohort, round_end, CASE WHEN (round_end // {DAY}) % 5 <> 0 THEN recommended_ef END AS recommended_ef, confidence, (round_end // {DAY}) % 14 < 7 AS fp FROM results),
c AS (SELECT *, coalesce((fp <> lag(fp) OVER (PARTITION BY cohort ORDER BY round_end))::INT, 0) AS ch FROM marked),
r AS (SELECT *, sum(ch) OVER (PARTITION BY cohort ORDER BY round_end) AS run FROM c)
SELECT cohort, round_end, recommended_ef, last_value(CASE WHEN recommended_ef IS NOT NULL THEN recommended_ef END IGNORE NULLS) OVER w AS effective_ef, last_value(CASE WHEN recommended_ef IS NOT NULL THEN round_end END IGNORE NULLS) OVER w AS source_round,
CASE WHEN last_value(CASE WHEN recommended_ef IS NOT NULL THEN round_end END IGNORE NULLS) OVER w IS NOT NULL THEN recommended_ef IS NULL END AS carried
FROM r WINDOW w AS (PARTITION BY cohort, run ORDER BY round_end ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def effective_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth day refused and the configuration changed every week, so that carries and resets occur."""
    day = F.floor(F.col("round_end") / DAY)
    rows = _rounds(spark, sf_dir).withColumns({"recommended_ef": F.when(F.pmod(day, F.lit(5)) != 0, F.col("recommended_ef")), "fingerprint": F.pmod(day, F.lit(14)) < 7})
    return calibration.effective(rows).select("cohort", "round_end", "recommended_ef", "effective_ef", "source_round", "carried")


@_query()
def round_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calibration.effective(_rounds(spark, sf_dir).withColumn("fingerprint", F.lit("one")))
    return calibration.round_json(rows, round_per_ef(spark, sf_dir), CONFIG, "2024-02-01T00:00:00Z")


@_query(f"WITH {CAPTURES} SELECT part_ulid FROM parts WHERE (window_start // {WINDOW}) % 3 = 0 OR (window_start // {WINDOW}) % 7 = 0 OR (window_start // {WINDOW}) % 11 = 0")
def pending_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the parts lack truth and a seventh lack the sweep; others are of another grid."""
    listed, place = data.parts(spark, sf_dir), F.floor(F.col("window_start") / WINDOW)
    return calibration.pending_parts(listed, listed.where(F.pmod(place, F.lit(3)) != 0), listed.where(F.pmod(place, F.lit(7)) != 0), data.metas(spark, sf_dir), CONFIG).select("part_ulid")


@_query(f"SELECT vec_id, h::DECIMAL(20,0) AS vector_hash, ({FNV.format(s=f"'s:{CONFIG.split_seed}:' || h::VARCHAR")} % 10000) < 7000 AS is_train FROM (SELECT vec_id, {FNV.format(s="'v:' || vec_id::VARCHAR")} AS h FROM embeddings)")
def content_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.hashes(spark, sf_dir).select("vec_id", "vector_hash", hashing.is_train_member(F.col("vector_hash"), CONFIG.split_seed, CONFIG.train_fraction).alias("is_train"))


@_query()
def payload_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FNV-1a of every vector's bytes, as the hash of the frame's payload."""
    framed = data.corpus(spark, sf_dir).select("vec_id", frames.parse_frame(frames.build_frame(F.lit("corpus"), F.transform("embedding", lambda x: x.cast("double")))).alias("p"))
    return framed.select("vec_id", hashing.unsigned(hashing.payload_hash("p.vector")).alias("vector_hash"))


# Text and validation


@_query(r"""SELECT doc_id, length(text) >= 200 AND trim(lower(text)) NOT IN ('', '.', '?', '[deleted]', '[removed]', 'deleted', 'removed', 'n/a', 'na', 'none', 'null') AS accepted, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS clean_chars FROM documents""")
def accepted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.accept_text(F.col("text"), 200).alias("accepted"), F.length(text.squeezed(F.col("text"))).cast("long").alias("clean_chars"))


@_query()
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html("html").alias("text"))


@_query(r"""SELECT doc_id, [lang, source] AS tags, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id END AS number, trim(regexp_replace(lang || ' /' || source || '/', '[^A-Za-z0-9_.-]+', '_', 'g'), '_') AS cache_key FROM documents""")
def parsed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("<"), F.col("lang"), F.lit("&gt;<"), F.col("source"), F.lit(">"))
    number = F.when(F.pmod("doc_id", F.lit(3)) == 0, "").otherwise(F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", text.parse_tags(raw).alias("tags"), text.parse_int(number).alias("number"), text.safe_key(F.concat("lang", F.lit(" /"), "source", F.lit("/"))).alias("cache_key"))


_NAMES = ["'events/' || event_type", "''", "event_type || '//x'", "'../' || event_type", "'window=' || event_type", "event_type || ' x'", "repeat(event_type || '/', 8) || 'x'", "repeat('a', 64)", "repeat('abcdefgh/', 30)", "'é'"]
_KINDS = ["NULL", "'empty'", "'empty_segment'", "'dot_segment'", "'reserved_window_segment'", "'invalid_segment'", "'too_many_segments'", "'segment_too_long'", "'name_too_long'", "'non_ascii'"]


@_query("SELECT event_id, CASE event_id % 10 " + " ".join(f"WHEN {i} THEN {k}" for i, k in enumerate(_KINDS)) + " END AS error FROM events")
def cohort_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("CASE pmod(event_id, 10) " + " ".join(f"WHEN {i} THEN {n}" for i, n in enumerate(_NAMES)) + " END")
    return table(spark, sf_dir, "events").select("event_id", text.cohort_error(name).alias("error"))


@_query(r"""SELECT count(*) AS n_rows, count(*) FILTER (WHERE doc_id IS NULL) AS null_ids, count(*) FILTER (WHERE text IS NULL) AS null_texts, count(*) - count(DISTINCT doc_id) AS repeated, count(*) FILTER (WHERE contains(text, chr(10))) AS multi_line,
(SELECT count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) AS unlabelled, (SELECT count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE l.doc_id = d.doc_id)) AS strays FROM documents""")
def load_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a strict one-to-one load of texts and labels would complain of."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    told = docs.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("doc_id").isNull()).alias("null_ids"), F.count_if(F.col("text").isNull()).alias("null_texts"), (F.count(F.lit(1)) - F.count_distinct("doc_id")).alias("repeated"), F.count_if(F.contains("text", F.lit("\n"))).alias("multi_line")
    )
    count = lambda a, b, name: a.join(b, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias(name))
    return told.join(count(docs, labels, "unlabelled")).join(count(labels, docs, "strays"))


# Sampling and replay


@_query("SELECT doc_id, source FROM documents ORDER BY md5('7:' || doc_id::VARCHAR), doc_id LIMIT 100")
def reservoir_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.reservoir(table(spark, sf_dir, "documents").select("doc_id", "source"), 100, 7, "doc_id")


UNIT = "('0x' || substr(md5('{seed}:' || event_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


@_query(f"SELECT event_id, {UNIT.format(seed=3)} < 0.3 AS sampled FROM events")
def bernoulli_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("event_id", sampling.bernoulli(0.3, 3, "event_id")(events).alias("sampled"))


SLOW = 650_000_000


@_query(f"""WITH RECURSIVE {CAPTURES}, slow AS (SELECT event_id, cohort, receive_time_us // {SLOW} AS s FROM captures), b AS (SELECT cohort, event_id, (s - min(s) OVER (PARTITION BY cohort)) // 5 AS bucket FROM slow),
n AS (SELECT cohort, bucket, count(*) AS n, row_number() OVER (PARTITION BY cohort ORDER BY bucket) AS i FROM b GROUP BY 1, 2),
f AS (SELECT cohort, bucket, n, i, 0.0::DOUBLE AS rate FROM n WHERE i = 1 UNION ALL
  SELECT n.cohort, n.bucket, n.n, n.i, CASE WHEN n.bucket - f.bucket - 1 > 10 THEN 0.0::DOUBLE ELSE (0.5::DOUBLE * (f.n / 5.0::DOUBLE) + 0.5::DOUBLE * f.rate) * pow(0.5::DOUBLE, n.bucket - f.bucket - 1) END FROM f JOIN n ON n.cohort = f.cohort AND n.i = f.i + 1)
SELECT b.event_id, b.cohort, b.bucket, CASE WHEN rate <= 0.25 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE / rate END AS probability, {UNIT.format(seed=5)} < CASE WHEN rate <= 0.25 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE / rate END AS sampled FROM b JOIN f ON f.cohort = b.cohort AND f.bucket = b.bucket""")
def adaptive_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    slow = data.captures(spark, sf_dir).select("event_id", "cohort", F.floor(F.col("receive_time_us") / SLOW).cast("long").alias("second"))
    return sampling.adaptive_sample(slow, 0.25, 5, "event_id").select("event_id", "cohort", "bucket", "probability", "sampled")


@_query(f"""WITH {CAPTURES}, s AS (SELECT *, {UNIT.format(seed=3)} < 0.7 AS sampled FROM captures),
r AS (SELECT *, row_number() OVER (PARTITION BY cohort, window_start, sampled ORDER BY receive_time_us, event_id) AS i FROM s)
SELECT event_id, CASE WHEN NOT sampled THEN 'not_sampled' WHEN i <= 650 // frame_bytes THEN 'enqueued' ELSE 'queue_full' END AS outcome FROM r""")
def queue_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.captures(spark, sf_dir)
    rows = rows.withColumn("sampled", sampling.bernoulli(0.7, 3, "event_id")(rows))
    return sampling.queue_outcomes(rows, 650, ["cohort", "window_start"], ["receive_time_us", "event_id"]).select("event_id", "outcome")


@_query("SELECT event_id, avg(abs(event_id * 7919 % 1000)) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS rolling_mean FROM events")
def rolling_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("latency_ms", F.abs(F.col("event_id") * 7919 % 1000).cast("double"))
    return summaries.rolling_mean(rows, "event_type", ["ts", "event_id"], "latency_ms", 20).select("event_id", "rolling_mean")


@_query(f"WITH {CAPTURES} SELECT cohort, sum(frame_bytes)::BIGINT AS buffered_bytes FROM captures GROUP BY cohort ORDER BY buffered_bytes DESC, cohort LIMIT 1")
def largest_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.captures(spark, sf_dir).groupBy("cohort").agg(F.sum("frame_bytes").alias("buffered_bytes")).orderBy(F.desc("buffered_bytes"), "cohort").limit(1)


@_query(f"WITH {CAPTURES} SELECT cohort, window_start, count(*) AS received, count(*) FILTER (WHERE NOT dropped) AS stored, sum(frame_bytes)::BIGINT AS bytes FROM captures GROUP BY 1, 2")
def collected_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window as the streaming collector closes it, run over the events to the end."""
    from tidemark.streaming.collector import collect_available

    return collect_available(spark, sf_dir)


@_query()
def vector_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.corpus(spark, sf_dir).select("vec_id", vector_text(F.col("embedding")).alias("text"))


# Lookups


@_query("SELECT least(count(*), 100) AS n_rows, 2 AS n_columns FROM documents")
def limited_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lookup.limited(table(spark, sf_dir, "documents").select("doc_id", "lang"), 100)
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(rows.columns)))


@_query("SELECT doc_id, source, lang FROM documents WHERE doc_id IN (0, 3, 20, 21, 77, 150, 100000000)")
def rows_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.rows_of_ids(table(spark, sf_dir, "documents"), "doc_id", [0, 3, 20, 21, 77, 150, 100_000_000], ["source", "lang"])


@_query(f"WITH {VECS} SELECT DISTINCT did FROM truth")
def result_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = data.corpus(spark, sf_dir)
    return lookup.result_ids(search.exact_topk(data.query_set(docs), docs, K))


@_query(f"WITH {VECS} SELECT qid, ef, r::INT AS rank, did, round(dist, 6) AS dist FROM found")
def effort_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = data.corpus(spark, sf_dir)
    return lookup.sweep_rows(data.query_set(docs), docs, K, EFS).withColumn("dist", F.round("dist", 6))


@_query(f"WITH {VECS} SELECT qid, rank::INT AS rank, did, round(dist, 6) AS dist, substring(coalesce(text, ''), 1, 300) AS preview FROM truth JOIN documents ON doc_id = did WHERE rank <= 3")
def search_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = data.corpus(spark, sf_dir)
    return lookup.previews(data.query_set(docs), docs, table(spark, sf_dir, "documents"), 3).withColumn("dist", F.round("dist", 6))


@_query(f"WITH {VECS} SELECT qid, count(*) AS returned, round(min(dist), 6) AS nearest, round(max(dist), 6) AS farthest FROM truth GROUP BY qid")
def search_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = data.corpus(spark, sf_dir)
    return lookup.replay(data.query_set(docs), docs, K).select("qid", "returned", F.round("nearest", 6).alias("nearest"), F.round("farthest", 6).alias("farthest"))


@_query("SELECT vec_id, len(embedding)::INT AS dim FROM embeddings")
def vector_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurement.checked_vectors(data.corpus(spark, sf_dir), "embedding", 64).select("vec_id", F.size("embedding").alias("dim"))


@_query("""SELECT doc_id, '{"' || replace(replace(lang, '\\', '\\\\'), '"', '\\"') || '",NULL,"a\\"b"}' AS tags,
CASE WHEN regexp_matches(text, '[",\\r\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE coalesce(text, '') END AS field FROM documents""")
def quoted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array(F.col("lang"), F.lit(None).cast("string"), F.lit('a"b'))
    return table(spark, sf_dir, "documents").select("doc_id", lookup.array_literal(tags).alias("tags"), lookup.csv_field(F.col("text")).alias("field"))


@_query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def plain_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.identity_text(F.col("text")).alias("text"))


# Measuring


@_query(f"""WITH {CAPTURES} SELECT part_ulid, cohort, window_start, any_value(received_frame_count) AS received_frame_count, count(*) AS record_count, count(*) FILTER (WHERE event_id % 13 = 0) AS failed_count,
count(DISTINCT vec_id) FILTER (WHERE event_id % 13 <> 0) AS measured_count FROM records JOIN parts USING (part_ulid, cohort, window_start) GROUP BY 1, 2, 3""")
def measured_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of parts whose captures are encoded, stored as segments, read back and checked; every thirteenth is of another type."""
    return data.measured(spark, sf_dir).metas.select("part_ulid", "cohort", "window_start", "received_frame_count", "record_count", "failed_count", "measured_count")


@_query(f"""WITH {VECS}, {CAPTURES}, firsts AS (SELECT part_ulid, vec_id, min(record_index) AS record_index, count(*)::INT AS dup_count FROM records WHERE event_id % 13 <> 0 GROUP BY 1, 2),
own AS (SELECT q.vec_id AS qid, d.vec_id AS did, 1 - list_dot_product(q.e, d.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(d.e, d.e))) AS dist, list_dot_product(q.e[1:16], d.e[1:16]) AS coarse
  FROM vecs q JOIN vecs d ON true WHERE q.vec_id % {EVERY} = 0),
mine AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, did) AS rank, row_number() OVER (PARTITION BY qid ORDER BY coarse DESC, did) AS place FROM own),
tries AS (SELECT qid, did, dist, rank, ef, row_number() OVER (PARTITION BY qid, ef ORDER BY dist, did) AS r FROM mine, unnest({EFS}) AS t(ef) WHERE place <= ef)
SELECT part_ulid, record_index, dup_count, ef::INT AS ef, count(*) FILTER (WHERE rank <= {K}) / {float(K)}::DOUBLE AS recall, count(*)::BIGINT AS result_count
FROM firsts JOIN tries ON qid = vec_id WHERE r <= {K} GROUP BY 1, 2, 3, 4""")
def measured_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep of each part's distinct vectors, from segments to recalls; a captured vector finds its own document."""
    found = data.measured(spark, sf_dir)
    dups = found.truth.select("part_ulid", "record_index", "dup_count")
    return found.sweep.join(dups, ["part_ulid", "record_index"]).select("part_ulid", "record_index", "dup_count", "ef", "recall", "result_count")


@_query(f"""SELECT 'events/' || event_type AS cohort, CASE WHEN event_id % 11 = 0 THEN 'truncated' WHEN event_id % 11 = 1 THEN 'bad_magic' WHEN event_id % 11 = 2 THEN 'length_mismatch' WHEN event_id % 11 = 3 THEN 'unsupported_dtype' WHEN event_id % 11 = 4 THEN 'cohort_mismatch' ELSE 'accepted' END AS outcome, count(*) AS n FROM events GROUP BY 1, 2""")
def frame_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by outcome: what can't be read is counted and doesn't end the collector."""
    rows = data.captures(spark, sf_dir).select("event_id", "cohort")
    kind = F.pmod("event_id", F.lit(11))
    three = F.array(*[F.lit(float(x)) for x in (1, 2, 3)])
    whole = frames.build_frame(F.when(kind == 4, F.lit("events/none")).otherwise(F.col("cohort")), three)
    f64 = F.concat(F.substring(whole, 1, 12), F.unhex(F.lit("02000000")), whole.substr(F.lit(17), F.lit(1 << 20)))
    bad = F.when(kind == 0, F.substring(whole, 1, 20)).when(kind == 1, F.concat(F.substring(whole, 1, 4), F.unhex(F.lit("00000000")), whole.substr(F.lit(9), F.lit(1 << 20)))).when(kind == 2, F.concat(whole, F.unhex(F.lit("00")))).when(kind == 3, f64).otherwise(whole)
    return collector.frame_outcomes(rows.withColumn("frame", bad))


@_query(f"""WITH c AS (SELECT event_id, 'events/' || event_type AS cohort, (epoch_us(ts) // 1000000) - (epoch_us(ts) // 1000000) % {WINDOW} AS w FROM events)
SELECT cohort, event_id, max(w) OVER (PARTITION BY cohort ORDER BY event_id % 7919, event_id ROWS UNBOUNDED PRECEDING) AS window_start FROM c""")
def arrival_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures in an arrival order that their times don't follow: an older record joins the window that is open."""
    rows = data.captures(spark, sf_dir).withColumn("__turn", F.pmod("event_id", F.lit(7919)))
    return collector.arrival_windows(rows, ["__turn", "event_id"]).select("cohort", "event_id", F.col("open_window").alias("window_start"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
