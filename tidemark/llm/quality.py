"""Quality rules combined by weak supervision.

Rules vote good, bad or abstain; expectation-maximisation over the counts of
vote patterns (a bounded table, 3 to the number of rules) estimates how each
rule votes on good and on bad documents; the posterior replaces all-must-pass
filtering. Features and posteriors are native expressions; the driver sees the
pattern counts alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, clean_text, let, packed, stored, unpacked, words_of

#: The symbols that count as noise.
SYMBOLS = "[#*$%&|<>]"
#: Frequent function words of the corpus languages.
STOPWORDS = ["the", "of", "and", "to", "in", "is", "de", "la", "le", "les", "et", "que", "el", "en", "los", "der", "die", "und", "das", "ist", "nicht", "für", "auf", "ein", "eine", "sie", "zu", "mit", "von", "dem", "den", "als", "auch", "las", "con", "por", "para", "un", "una", "su", "se", "no", "del", "des", "du", "pas", "pour", "dans", "est", "que", "as", "was", "for", "that", "with", "this", "be", "by", "are", "it"]
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Up to so many distinct repeated shingles are looked up one by one; beyond, sorting finds them.
FEW = 24

GOOD, BAD, ABSTAIN = 1, -1, 0
#: Rule: (feature, bad if above); else it abstains.
ABOVE = {"symbols": ("f_symbols", 0.10), "symbol_words": ("f_symbol_words", 0.50), "repeats": ("f_repeats", 0.30), "dup_lines": ("f_dup_lines", 0.30), "capitals": ("f_capitals", 0.40), "long_words": ("f_word_len", 12.0)}
#: Rule: (feature, bad if below); else it abstains.
BELOW = {"length": ("n_words", float(MIN_WORDS)), "short_words": ("f_word_len", 2.0)}
#: Rule: (feature, bad if below, good if at least); between the two it abstains.
BOTH = {"stopwords": ("f_stop", 1.0, 3.0), "sentences": ("f_ends", 0.01, 0.05)}
RULES = [*ABOVE, *BELOW, *BOTH]


def _repeat_words(h: Column) -> Column:
    """Words covered by 3-word windows whose hash (array `h`, by position) occurs twice or more."""
    none = F.array().cast("array<int>")
    at = F.get

    def few(rep: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(rep, at(h, i)))

    def many() -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda p, x, j: F.when(j >= 0, at(p, j)["h"] == x["h"]).otherwise(False)
        return let(pairs, lambda p: F.sort_array(F.transform(F.filter(p, lambda x, i: F.coalesce(same(p, x, i - 1), F.lit(False)) | F.coalesce(same(p, x, i + 1), F.lit(False))), lambda x: x["i"])))

    def places(s: Column) -> Column:
        rep = F.array_distinct(F.filter(s, lambda x, i: F.when(i > 0, x == at(s, i - 1)).otherwise(False)))
        return let(rep, lambda r: F.when(F.size(r) <= FEW, few(r)).otherwise(many()))

    found = F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(let(F.sort_array(h), places))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    return F.aggregate(found, start, lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"])


def _features(text: Column, w: Column) -> Column:
    """Struct of all features of a text and its words; each costly array is bound once by let()."""
    n = F.size(w)
    shingles = F.when(n >= 3, F.transform(F.slice(w, 1, n - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))

    def rest(joined: Column, lines: Column, repeated: Column) -> Column:
        chars = F.length(joined)
        symbols = F.regexp_count(joined, F.lit(SYMBOLS))
        dup = F.size(lines) - F.size(F.array_distinct(lines))
        some, letters = F.greatest(n, F.lit(1)), F.greatest(chars, F.lit(1))
        return F.struct(
            n.cast("long").alias("n_words"),
            chars.cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            dup.cast("long").alias("n_dup_lines"),
            repeated.cast("long").alias("n_repeat_words"),
            (symbols / letters).alias("f_symbols"),
            (symbols / some).alias("f_symbol_words"),
            (repeated / some).alias("f_repeats"),
            (dup / F.greatest(F.size(lines), F.lit(1))).alias("f_dup_lines"),
            (F.regexp_count(joined, F.lit(r"\p{Lu}")) / letters).alias("f_capitals"),
            (chars / some).alias("f_word_len"),
            F.size(F.array_intersect(w, F.array(*[F.lit(x) for x in STOPWORDS]))).cast("double").alias("f_stop"),
            ((chars - F.length(F.replace(joined, F.lit("."), F.lit("")))) / some).alias("f_ends"),
        )

    return let(shingles, lambda h: let(_repeat_words(h), lambda r: let(lines, lambda x: let(F.array_join(w, ""), lambda j: rest(j, x, r)))))


def base_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Each row as a struct (common.ROW) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the rules' ratios f_*."""
    both = let(clean_text(text_col), lambda t: let(words_of(t), lambda w: _features(t, w)))
    return df.select(packed(df), both.alias("__q")).select(ROW, "__q.*")


def votes() -> dict[str, Column]:
    out = {}
    for name, (feature, bad) in ABOVE.items():
        out[name] = F.when(F.col(feature) > bad, BAD).otherwise(ABSTAIN)
    for name, (feature, bad) in BELOW.items():
        out[name] = F.when(F.col(feature) < bad, BAD).otherwise(ABSTAIN)
    for name, (feature, bad, good) in BOTH.items():
        out[name] = F.when(F.col(feature) < bad, BAD).when(F.col(feature) >= good, GOOD).otherwise(ABSTAIN)
    return out


def fit_label_model(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 30, prior: float = 0.8, smooth: float = 1.0) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Expectation-maximisation over vote patterns: (P(good), per rule: vote -> (P(vote|good), P(vote|bad))).

    It starts from documents without a vote against them as good and is
    deterministic; without patterns the prior and even votes come back.
    """
    n_rules = len(patterns[0][0]) if patterns else 0
    posterior = [{0: 0.95, 1: 0.2}.get(sum(v == BAD for v in votes_), 0.05) for votes_, _ in patterns]
    p_good, table = prior, [{v: (1 / 3, 1 / 3) for v in (GOOD, BAD, ABSTAIN)} for _ in range(n_rules)]
    total = sum(c for _, c in patterns)
    for _ in range(rounds if patterns else 0):
        good = sum(q * c for q, (_, c) in zip(posterior, patterns, strict=True))
        p_good = (good + smooth) / (total + 2 * smooth)
        table = []
        for j in range(n_rules):
            sums = {v: [smooth, smooth] for v in (GOOD, BAD, ABSTAIN)}
            for q, (votes_, c) in zip(posterior, patterns, strict=True):
                sums[votes_[j]][0] += q * c
                sums[votes_[j]][1] += (1 - q) * c
            table.append({v: (g / (good + 3 * smooth), b / (total - good + 3 * smooth)) for v, (g, b) in sums.items()})
        posterior = []
        for votes_, _ in patterns:
            odds = math.log(p_good / (1 - p_good)) + sum(math.log(table[j][v][0] / table[j][v][1]) for j, v in enumerate(votes_))
            posterior.append(1 / (1 + math.exp(-max(-700.0, min(700.0, odds)))))
    return p_good, table


def label_quality(df: DataFrame, text_col: str = "text", threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """Return the columns `keep` (default: all) with the base columns, votes, p_good, base_failed and kept.

    kept: false where base_failed, else p_good >= threshold. A null text counts
    as empty: no words, base_failed. Repeated rows vote each for themselves. One
    pass computes features and votes and stores them with `keep` in the shared
    folder; the pattern counts and the result read that. Input columns named like
    an output are replaced.
    """
    new = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "votes", "p_good", "base_failed", "kept"}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    cast = votes()
    voted = stored(base_features(df, text_col).select(F.struct(*unpacked(keep)).alias(ROW) if keep else F.lit(0).alias(ROW), *base, F.array(*[cast[r] for r in RULES]).alias("votes")))
    counts = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = sorted((tuple(r["votes"]), r["n"]) for r in counts)
    p_good, model = fit_label_model(patterns)
    odds = F.lit(math.log(p_good / (1 - p_good)))
    for j, row in enumerate(model):
        weight = {v: math.log(g / b) for v, (g, b) in row.items()}
        vote = F.get("votes", F.lit(j))
        odds = odds + F.when(vote == GOOD, weight[GOOD]).when(vote == BAD, weight[BAD]).otherwise(weight[ABSTAIN])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    good = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), odds))))
    out = voted.withColumns({"p_good": good, "base_failed": failed}).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
    return out.select(*unpacked(keep), *[c for c in out.columns if c != ROW])
