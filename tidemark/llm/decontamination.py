"""Benchmark decontamination with spaced seeds.

Fixed masks pick some words of each window and ignore the others; equal hashes
of benchmark and training windows are hits. Around each hit's diagonal the words
are compared one by one and the best run, where a substitution costs two matches, decides.
Native expressions throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import clean_text, free_names, let, small_or_shuffled, stored

#: Word offsets that each mask compares; the others may differ. Together the first two hit every run of
#: score 12 with up to 5 substitutions, and the third what they miss of items of 8 to 19 words.
MASKS, SHORT_MASK = [(0, 1, 3, 4, 6), (0, 2, 3, 6, 7)], (0, 1, 5, 7, 8)
#: Matches less twice the substitutions that a run needs.
MIN_SCORE = 12
PENALTY = 2
#: An item of fewer words may instead have this part of its words equal on a diagonal.
SHORT, SHORT_PART = 20, 0.8
#: Words that the shortest item asked by MASKS has; shorter ones are hashed whole, less one word where that may differ.
SPAN = 8


def normal_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, as an array."""
    plain = F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return let(plain, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " ")))


def word_hashes(text: Column) -> Column:
    return F.transform(normal_words(text), lambda w: F.xxhash64(w))


def _masks(lengths: set[int]) -> list[tuple[tuple[int, ...], int | None]]:
    """(offsets, the item length that it is for, or None) of all masks that items of these lengths below SHORT need."""
    out: list[tuple[tuple[int, ...], int | None]] = [(m, None) for m in MASKS]
    if any(n >= SPAN for n in lengths):
        out.append((SHORT_MASK, None))
    for n in sorted(x for x in lengths if 0 < x < SPAN):
        whole = tuple(range(n))
        may_differ = n - -(-int(100 * SHORT_PART) * n // 100)
        out += [(tuple(o for o in whole if o != left), n) for left in whole] if may_differ else [(whole, n)]
    return out


def _seeds(h: Column, masks: list[tuple[tuple[int, ...], int | None]], item: bool) -> Column:
    """Array of struct(at, seed) of every mask at each window of the hashes `h`.

    Inside a run of one word all windows are equal; the first of them stands for
    the others, as a diagonal from one run's start to another's holds their most matches.
    """
    none = F.array().cast("array<struct<at:int,seed:bigint>>")
    same = lambda i, j: F.get(h, i) == F.get(h, j)

    def windows(number: int, offsets: tuple[int, ...], length: int | None) -> Column:
        span = max(offsets[-1] + 1, length or 0)
        seed = lambda i: F.struct(i.cast("int").alias("at"), F.xxhash64(F.lit(number), *[F.get(h, i + o) for o in offsets]).alias("seed"))
        again = lambda all_, x, i: (i > 0) & (F.get(all_, i - 1)["seed"] == x["seed"]) & same(x["at"], x["at"] + span // 2) & same(x["at"], x["at"] + span - 1)
        fits = F.size(h) == length if item and length else F.size(h) >= span
        found = let(F.transform(F.sequence(F.lit(0), F.size(h) - span), seed), lambda all_: F.filter(all_, lambda x, i: ~again(all_, x, i)))
        return F.when(fits, found).otherwise(none)

    return F.concat(*[windows(number, *mask) for number, mask in enumerate(masks)])


def _best_run(doc: Column, item: Column, diagonal: Column) -> Column:
    """struct(best, matched, from, to) of the best run on a diagonal, and all its equal words; from and to are item words."""
    start = F.struct(*[F.lit(0).alias(x) for x in ("s", "m", "f", "best", "matched", "from", "to", "all")])
    first, last = F.greatest(F.lit(0), -diagonal), F.least(F.size(item), F.size(doc) - diagonal) - 1

    def step(a: Column, q: Column) -> Column:
        same = F.get(doc, q + diagonal) == F.get(item, q)
        fresh = a["s"] <= 0
        s = F.when(fresh, 0).otherwise(a["s"]) + F.when(same, 1).otherwise(-PENALTY)
        m = F.when(fresh, 0).otherwise(a["m"]) + F.when(same, 1).otherwise(0)
        f = F.when(fresh, q).otherwise(a["f"])
        better = s > a["best"]
        pick = lambda new, old: F.when(better, new).otherwise(a[old]).alias(old)
        return F.struct(s.alias("s"), m.alias("m"), f.alias("f"), pick(s, "best"), pick(m, "matched"), pick(f, "from"), pick(q + 1, "to"), (a["all"] + F.when(same, 1).otherwise(0)).alias("all"))

    return F.aggregate(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>")), start, step)


def contaminated(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_score: int = MIN_SCORE
) -> DataFrame:
    """One row per document and benchmark item that it holds: id, item, matched, span, score, at (document word).

    A document holds an item if a run on a diagonal scores `min_score` (matches
    less twice the substitutions), or if the item has under SHORT words and a
    diagonal equals SHORT_PART of them. Items of under SPAN words are hashed whole;
    an item of a word or two is in very many documents. Items without words and
    null texts match nothing. Null ids are dropped, ids of any type and null items
    likewise; ids or items that repeat give the best over their rows. An empty table
    on either side gives no rows; other columns are not read. The best diagonal
    stands for the pair: most score, then matches, span, all equal words, and the
    earliest place. Documents are read twice and never shuffled where the tables of
    seeds and of hits are small, by their bytes; else both joins shuffle.
    """
    items = stored(benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("__item"), word_hashes(clean_text(item_text)).alias("__iw")))
    lengths = {r[0] for r in items.where(F.size("__iw") < SHORT).select(F.size("__iw")).distinct().collect()}  # at most SHORT of them
    masks = _masks(lengths)
    seeds = items.select("__item", F.explode(let(F.col("__iw"), lambda h: _seeds(h, masks, True))).alias("s")).select("__item", F.col("s.at").alias("__q"), F.col("s.seed").alias("__seed"))
    seeds = small_or_shuffled(stored(seeds), 40)
    docs = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), clean_text(text_col).alias("__t"))
    windows = docs.select("__id", F.explode(let(word_hashes(F.col("__t")), lambda h: _seeds(h, masks, False))).alias("s")).select("__id", F.col("s.at").alias("__p"), F.col("s.seed").alias("__seed"))
    hits = windows.join(seeds, "__seed").select("__id", "__item", (F.col("__p") - F.col("__q")).alias("__d")).distinct()
    hits = stored(hits.groupBy("__id", "__item").agg(F.collect_set("__d").alias("__ds")))
    found = docs.join(small_or_shuffled(hits, 96, per_item=("__ds", 8)), "__id").join(small_or_shuffled(items, 64, per_item=("__iw", 8)), "__item")
    run = lambda r, d: F.struct(
        r["best"].alias("score"), r["matched"].alias("matched"), (r["to"] - r["from"]).alias("span"), r["all"].alias("all"), (-(r["from"] + d)).alias("before")
    )
    m = F.size("__iw")
    holds = lambda x: (x["score"] >= min_score) | ((m < SHORT) & (100 * x["all"] >= int(100 * SHORT_PART) * m))
    runs = let(word_hashes(F.col("__t")), lambda w: F.filter(F.transform("__ds", lambda d: let(_best_run(w, F.col("__iw"), d), lambda r: run(r, d))), holds))
    best = found.select("__id", "__item", F.array_max(runs).alias("b")).where("b is not null").groupBy("__id", "__item").agg(F.max("b").alias("b"))
    return best.select(
        F.col("__id").alias(id_col), F.col("__item").alias(item_col), F.col("b.matched").cast("long").alias("matched"), F.col("b.span").cast("long").alias("span"), F.col("b.score").cast("long").alias("score"), (-F.col("b.before")).cast("long").alias("at")
    )


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """`df` without the rows that hold a benchmark passage; each row is judged by its own text, whatever its id."""
    names = free_names(df, ["key", "bad"])
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(clean_text(text_col)).alias("h"))
    keyed = df.withColumn(names["key"], key)
    bad = contaminated(df.select(key.alias("key"), F.col(text_col).alias("text")), benchmark, "key", "text", **how).select(F.col("key").alias(names["bad"])).distinct()
    bad = small_or_shuffled(stored(bad), 32)
    return keyed.join(bad, F.col(names["key"]).eqNullSafe(F.col(names["bad"])), "left_anti").drop(names["key"])
