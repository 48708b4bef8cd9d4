"""Quality rules by weak supervision, with DataFrame functions only.

Rules vote good (1), bad (-1) or abstain (0) on a document. Expectation-maximisation over the counts of vote patterns (at
most 3 to the number of rules, whatever the corpus) estimates each rule's accuracy and the share of good documents; a
document is kept if its posterior probability of being good is at least ``keep_at``. A fixed floor (too few words, or
too many of them in repeated windows) overrides the posterior.

Edge cases: a null or empty text has no words and fails the floor; repeated rows come back as often and are counted as
often; null ids stay null; other columns are ignored; an empty table gives no rows; when every vote abstains, the
posterior is the prior; a posterior equal to ``keep_at`` keeps; a very long text is measured whole, as arrays of its words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, staged, table

SPACE = r"[\x20\x09-\x0D]+"
LEAST_WORDS, MOST_REPEATED = 50, (50, 100)
KEEP_AT = 0.5


def repeated_words(words: Column) -> Column:
    """Hashes of the 3-word windows, with the place of each."""
    return F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts that the rules look at."""
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = out.select("doc_id", "text", F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    out = out.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", r"[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("text", r"[^!|]+", "")).cast("long").alias("n_marks"),
        F.length(F.regexp_replace("text", r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", "")).cast("long").alias("n_plain"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        repeated_words(F.col("words")).alias("windows"),
    )
    # Equal windows are neighbours when sorted; most texts have none and skip the sort.
    dup = F.size("windows") > F.size(F.array_distinct("windows"))
    out = out.withColumn("sorted", F.when(dup, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))).drop("windows")

    def covered(x: Column, y: Column) -> Column:
        return F.when(x["h"] == y["h"], F.array(*(s["i"] + k for s in (x, y) for k in range(3))))

    runs = F.filter(F.zip_with("sorted", F.expr("slice(sorted, 2, size(sorted))"), covered), lambda x: x.isNotNull())
    return out.withColumn("n_repeat_words", F.size(F.array_distinct(F.flatten(runs))).cast("long")).drop("sorted")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")


def rules() -> dict[str, Column]:
    """Each rule's vote; n_words of 0 makes every share 0."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    symbols, repeats, upper = F.col("n_symbols") / words, F.col("n_repeat_words") / words, F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))
    lines, length, varied = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), F.col("word_chars") / words, F.col("n_distinct") / words
    marks, some = F.col("n_marks") / words, F.col("n_words") >= 10
    return {
        "symbols": _vote(symbols <= 0.1, symbols > 0.5),
        "letters": _vote((F.col("n_plain") / F.greatest(F.col("word_chars"), F.lit(1)) >= 0.85) & some, (F.col("n_plain") / F.greatest(F.col("word_chars"), F.lit(1)) < 0.72) & some),
        "marks": _vote(marks <= 0.1, marks > 0.25),
        "length": _vote((length >= 3) & (length <= 10) & some, (length < 2) | (length > 15)),
        "upper": _vote((upper <= 0.15) & some, (upper > 0.5) & some),
        "repeats": _vote(repeats <= 0.15, (repeats > 0.4) & some),
        "varied": _vote((varied >= 0.35) & some, (varied < 0.2) & some),
        "lines": _vote(lines <= 0.1, (lines > 0.4) & (F.col("n_lines") >= 5)),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[tuple[float, float]]]:
    """Prior of good, and each rule's log odds of good for a good and for a bad vote, from counts of vote patterns.

    A document has few faults of all, so the start takes a pattern for bad once any rule votes bad. Abstaining says
    nothing. A rule that votes good more often on bad documents than on good ones is given no say.
    """
    total, prior = sum(n for _, n in patterns), 0.8
    odds = [(0.0, 0.0)] * (len(patterns[0][0]) if patterns else 0)
    good = [0.02 if min(votes) < 0 else 0.98 for votes, _ in patterns]
    for _ in range(rounds if total else 0):
        for j in range(len(odds)):
            rate = []
            for c in (0, 1):
                cast = [(n * (p if c else 1 - p), votes[j] > 0) for p, (votes, n) in zip(good, patterns) if votes[j]]
                rate.append((sum(w for w, v in cast if v) + 0.5) / (sum(w for w, _ in cast) + 1))
            odds[j] = (math.log(rate[1] / rate[0]), math.log((1 - rate[1]) / (1 - rate[0]))) if rate[1] > rate[0] else (0.0, 0.0)
        prior = min(0.99, max(0.01, sum(p * n for p, (_, n) in zip(good, patterns)) / total))
        good = [posterior(votes, prior, odds) for votes, _ in patterns]
    return prior, odds


def posterior(votes: tuple[int, ...], prior: float, odds: list[tuple[float, float]]) -> float:
    x = math.log(prior / (1 - prior)) + sum(own[v < 0] for v, own in zip(votes, odds) if v)
    return 1 / (1 + math.exp(-max(-500.0, x)))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """One row per document: its counts, base_failed, p_quality and kept."""
    votes = rules()
    measured = staged(features(docs, id_col, text_col), "quality-features").withColumns({f"vote_{k}": v for k, v in votes.items()})
    names = [f"vote_{k}" for k in votes]
    counted = measured.groupBy(*names).agg(F.count("*").alias("n")).collect()  # at most 3 ** len(votes) rows
    prior, weights = estimate(sorted((tuple(r[k] for k in names), r["n"]) for r in counted))
    odds = F.lit(math.log(prior / (1 - prior)))
    for k, own in zip(names, weights):
        odds = odds + F.when(F.col(k) > 0, own[0]).when(F.col(k) < 0, own[1]).otherwise(0.0)
    failed = (F.col("n_words") < LEAST_WORDS) | (MOST_REPEATED[1] * F.col("n_repeat_words") > MOST_REPEATED[0] * F.col("n_words"))
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (1 / (1 + F.exp(-odds))).alias("p_quality")).withColumn("kept", ~F.col("base_failed") & (F.col("p_quality") >= keep_at))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
