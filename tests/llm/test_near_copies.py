"""The pipeline's near-dedup against a brute-force join at Jaccard 0.8."""

import random
from itertools import combinations

import pytest

import corpus_pipeline
from tidemark.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def five_words(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {()}


def survivors(rows):
    sets = [five_words(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and label[i] != label[j]:
            old, new = label[j], label[i]
            label = [new if x == old else x for x in label]
    best = {}
    for (d, t), x in zip(rows, label, strict=True):
        row = (d is None, d or 0, t or "")
        best[x] = min(best.get(x, row), row)
    return sorted(best.values())


def table():
    r = random.Random(5)
    text = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    rows = []
    for _ in range(40):  # copies on both sides of the threshold
        base = text(r.choice([12, 60, 150, 400]))
        rows.append(base)
        for _ in range(4):
            edited = base[:]
            for at in r.sample(range(len(base)), round(len(base) * r.choice([0.01, 0.02, 0.025, 0.04]))):
                edited[at] = f"e{r.randrange(10**6)}"
            rows.append(edited + text(r.choice([0, 0, len(base) // 8, len(base) // 4])))
    walk = text(200)
    for k in range(15):  # a chain whose ends are far apart
        walk = walk[8:] + text(8)
        rows.append(walk)
    rows += [text(100) + "one line that many documents hold and share".split() for _ in range(30)]
    out = [(i, " ".join(w)) for i, w in enumerate(rows)]
    r.shuffle(out)
    return out + [(9000, None), (9001, ""), (9002, "one two"), (9003, "One  two"), (9004, "one two three")]


def stage(spark, rows):
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA).repartition(3)
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect())


@pytest.mark.parametrize("chunk", [near_copies.CHUNK, 3])
def test_stage_keeps_what_a_brute_force_join_keeps(spark, chunk, monkeypatch):
    monkeypatch.setattr(near_copies, "CHUNK", chunk)
    rows = table()
    want = survivors(rows)
    assert len(rows) - 150 < len(want) < len(rows) - 60
    assert [x[:2] for x in stage(spark, rows)] == [x[:2] for x in want]


def test_stage_tells_rows_apart_by_id_and_text(spark):
    r = random.Random(6)
    a, b, c = (" ".join(f"w{r.randrange(5000)}" for _ in range(50)) for _ in range(3))
    rows = [(3, a), (3, b), (3, b), (4, a), (None, b), (None, c), (None, c)]
    assert stage(spark, rows) == survivors(rows)


def test_working_names_may_be_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, 6, 7), (2, "a b c", 5, 6, 7)], "doc_id long, text string, __key int, __gone int, t int")
    got = near_copies.keep_one_similar(docs)
    assert got.columns == docs.columns and [r.doc_id for r in got.collect()] == [1]
    assert near_copies.keep_one_similar(docs.limit(0)).count() == 0
