import pytest
from pyspark.sql import functions as F

from tidemark.sources import config, corpora, intermediates

YAML = """
calibration: {interval: 10min, ef_search: [20, 40, 80], train_fraction: 0.7, split_seed: 7, min_samples: 1000}
storage: {root: /tmp/x, window_seconds: 600}
data_sources:
  primary: {server: "localhost:5432", database: postgres, user: postgres, password_env: PW}
indexes:
  main: {data_source: primary, table: docs, key: doc_id, column: embedding}
targets:
  recall: {k: 20, value: 0.9, percentile: 0.95, window: 24h}
cohorts:
  prod/a: {index: main, target: recall}
"""


def test_config():
    c = config.load(YAML)
    assert c.interval == 600 and c.cohorts["prod/a"].round.window_seconds == 86400 and c.cohorts["prod/a"].round.ef_grid == (20, 40, 80)
    assert config.cooldown(1.0, 0.2) == 4.0 and config.seconds("1h 30min", "x") == 5400


@pytest.mark.parametrize("old,new", [("10min", "0s"), ("[20, 40, 80]", "[]"), ("[20, 40, 80]", "[40, 20]"), ("[20, 40, 80]", "[10, 40]"), ("80]", "1001]"), ("0.7", "1.0"), ("1000", "9"), ("600}", "601}"), ("PW", "PW, password: x"), ("data_source: primary", "data_source: other"), ("table: docs", 'table: ""'), ("k: 20", "k: 0"), ("0.95", "1.0"), ("24h", "5min"), ("24h", "25min"), ("prod/a", "prod//a"), ("index: main, target", "index: other, target"), ("user: postgres", "user: postgres, port: 1"), ("24h", "soon")])
def test_config_is_refused(old, new):
    with pytest.raises(ValueError):
        config.load(YAML.replace(old, new, 1))


def test_corpora(spark, tmp_path):
    (tmp_path / "posts.xml").write_text('<?xml version="1.0"?><posts><row Id="5" PostTypeId="1" Title="What  is it?" Body="&lt;p&gt;A long body&lt;/p&gt;&lt;p&gt;of text&lt;/p&gt;" Tags="&lt;a&gt;&lt;b&gt;" Score="3" AnswerCount=""/><row Id="6" PostTypeId="2" Body="no"/><row Id="7" PostTypeId="1" Title="?" Body="[deleted]"/></posts>')
    docs, queries = corpora.question_corpus(corpora.read_questions(spark, str(tmp_path / "posts.xml")), 10, 10, 5, 5, 7)
    assert [(r.doc_id, r.text, r.tags, r.score, r.answer_count) for r in docs.collect()] == [(5, "A long body of text", ["a", "b"], 3, 0)]
    assert [r.text for r in queries.collect()] == ["What is it?"]
    (tmp_path / "posts.json").write_text('{"content": "some  content here", "title": "a title"}\n\n{"id": "x", "content": "removed", "title": "another title"}\n')
    docs, queries = corpora.post_corpus(corpora.read_posts(spark, str(tmp_path / "posts.json")), 10, 1, 5, 5, 7)
    assert [(r.doc_id, r.source_id, r.text) for r in docs.collect()] == [(1, "0", "some content here")] and queries.count() == 1
    (tmp_path / "bad.json").write_text("{broken\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        corpora.read_posts(spark, str(tmp_path / "bad.json")).collect()
    told = corpora.file_digests(spark, str(tmp_path / "posts.json"))
    assert corpora.bad_files(told, told).count() == 0 and corpora.bad_files(told, told.withColumn("size", F.lit(1))).count() == 1


def test_strict_join_and_cache(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    vectors = docs.select("doc_id", corpora.hashed_embedding(F.col("text"), 8).alias("embedding"))
    assert corpora.strict_join(docs, vectors).count() == 2
    for a, b in ((docs.union(docs), vectors), (docs, vectors.limit(1)), (docs.limit(1), vectors), (docs.withColumn("text", F.lit(None).cast("string")), vectors)):
        with pytest.raises(ValueError):
            corpora.strict_join(a, b)
    assert corpora.cache_matches({"k": 1, "f": {"path": "/a", "sha1": "x"}, "more": 2}, {"k": 1, "f": {"path": "/b", "sha1": "x"}})
    assert not corpora.cache_matches({"k": [1, 2]}, {"k": [1, 3]})


def test_pairs_on_disk(spark, tmp_path):
    root = str(tmp_path)
    truth = spark.createDataFrame([("p", "c/x", 600, 0, 5, 1, 9, 1.5, [1], [0.5]), ("q", "c/x", 1200, 0, 6, 1, 9, 1.5, [1], [0.5])], intermediates.TRUTH.replace("decimal(20,0)", "long")).withColumn("vector_hash", F.col("vector_hash").cast("decimal(20,0)"))
    sweep = spark.createDataFrame([("p", "c/x", 600, 0, 10, [1], 1.0, 0.5, 1), ("q", "c/x", 1200, 3, 10, [1], 1.0, 0.5, 1)], intermediates.SWEEP)
    metas = spark.createDataFrame([(u, "c/x", w, 600, 2, 1, "i", "t", "e", "k", 10, [10], 0, 1, 0, 1) for u, w in (("p", 600), ("q", 1200))], intermediates.METAS)
    intermediates.write_pairs(root, truth, sweep, metas)
    intermediates.write_pairs(root, truth.where("part_ulid = 'p'"), sweep.where("part_ulid = 'p'"), metas.where("part_ulid = 'p'"))
    t, s, m = intermediates.read_pairs(spark, root)
    assert t.count() == 2 and intermediates.read_pairs(spark, root, [600])[0].count() == 1
    assert [r.part_ulid for r in intermediates.sound_parts(t, s, m).collect()] == ["p"]
    with pytest.raises(ValueError):
        intermediates.write_pairs(root, truth.drop("gt_keys"), sweep, metas)
    assert intermediates.read_latest(spark, root, "status string").count() == 0
    docs = spark.createDataFrame([("c/x", 1, '{"status": "old"}'), ("c/x", 2, '{"status": "ok"}'), ("c/y", 1, "broken")], "cohort string, round_end long, json string")
    intermediates.publish_rounds(docs, root)
    got = {r.cohort: r.round for r in intermediates.read_latest(spark, root, "status string").collect()}
    assert got["c/x"].status == "ok" and (got["c/y"] is None or got["c/y"].status is None)


def test_streaming_equals_batch(spark, tmp_path):
    from tidemark.streaming.collector import event_stream, publish, windowed

    stream = windowed(event_stream(spark, "/root/testdata/sf0.001"))
    publish(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    closed = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    from tidemark.plans.data import captures

    whole = {tuple(r) for r in captures(spark, "/root/testdata/sf0.001").groupBy("cohort", "window_start").agg(F.count(F.lit(1)), F.count_if(~F.col("dropped")), F.sum("frame_bytes")).collect()}
    assert closed <= whole and len(closed) >= len(whole) - 5


def test_round_command(spark, tmp_path):
    from tidemark.__main__ import main

    root = str(tmp_path / "root")
    rows = range(40)
    truth = spark.createDataFrame([("p", "prod/a", 6000, i, 1000 + i, 1, 9, 1.5, [1], [0.5]) for i in rows], intermediates.TRUTH.replace("decimal(20,0)", "long")).withColumn("vector_hash", F.col("vector_hash").cast("decimal(20,0)"))
    sweep = spark.createDataFrame([("p", "prod/a", 6000, i, ef, [1], r, 0.5, 1) for i in rows for ef, r in ((20, 0.5), (40, 0.95), (80, 1.0))], intermediates.SWEEP)
    metas = spark.createDataFrame([("p", "prod/a", 6000, 600, 50, 40, "main", "docs", "embedding", "doc_id", 20, [20, 40, 80], 0, 40, 0, 1)], intermediates.METAS)
    intermediates.write_pairs(root, truth, sweep, metas)
    (tmp_path / "c.yaml").write_text(YAML.replace("/tmp/x", root).replace("1000", "10").replace("24h", "2h"))
    assert main(["check", "--config", str(tmp_path / "c.yaml")]) == 0
    assert main(["round", "--config", str(tmp_path / "c.yaml"), "--at", "7230"]) == 0
    shape = "status string, recommended_ef int, effective struct<recommended_ef:int,source_round:string,carried:boolean>, samples struct<unique:long>"
    got = intermediates.read_latest(spark, root, shape).first()["round"]
    assert (got.status, got.recommended_ef, got.samples.unique, got.effective.carried) == ("ok", 40, 40, False)
    assert main(["round", "--config", str(tmp_path / "c.yaml"), "--at", "20000"]) == 0
    got = intermediates.read_latest(spark, root, shape).first()["round"]
    assert got.status == "insufficient_samples" and got.recommended_ef is None and got.effective.carried and got.effective.source_round == "1970-01-01T02:00:00Z"
