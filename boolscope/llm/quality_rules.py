"""Quality rules that vote or abstain, weighed by expectation-maximisation, with DataFrame functions only."""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD_RE, let, save, text_of

BASE_MIN_WORDS = 20
BASE_MAX_REPEAT_PCT = 30
WINDOW = 8
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_short", "n_shout", "n_digits", "n_stutter")


def _repeat_words(hashes: Column) -> Column:
    """Words in windows found twice or more, from the windows' hashes in order of position.

    Texts without a repeat, nearly all, end at a hash set. Others sort (hash, position) once; positions of
    repeated windows, in order, each add the words up to the next such position, WINDOW at most.
    """

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"]))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1), x + WINDOW) - x)), F.lit(0), lambda a, b: a + b))

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered))


def features(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """row (a struct of the columns to carry) and q (the counts in FEATURES), all over whole texts; a null text counts
    as empty."""
    d = docs.select(F.struct(*(docs[c] for c in carry or docs.columns)).alias("row"), text_of(docs, text_col).alias("_t"))
    d = d.withColumn("_w", F.regexp_extract_all("_t", F.lit(f"({WORD_RE})"), F.lit(0)))
    d = d.withColumn("_l", F.filter(F.split("_t", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != ""))
    n = F.size("_w")
    windows = let(F.transform("_w", lambda w: F.xxhash64(w)), lambda h: F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW))))
    d = d.withColumn("_g", F.when(n >= WINDOW, windows).otherwise(F.array().cast("array<long>")))
    found = lambda p: F.regexp_count("_t", F.lit(p))
    counts = {
        "n_words": n,
        "word_chars": F.char_length(F.array_join("_w", "")),
        "n_symbols": found(r"[#*$%&|<>]"),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": _repeat_words(F.col("_g")),
        "n_lines": F.size("_l"),
        "n_short": F.size(F.filter("_w", lambda w: F.char_length(w) <= 3)),
        "n_shout": found(r"!!+"),
        "n_digits": found(r"[0-9]"),
        "n_stutter": F.size(F.filter("_w", lambda w, i: w == F.get("_w", i - 1))),
    }
    q = F.struct(*(counts[k].cast("long").alias(k) for k in FEATURES))
    return d.select("row", q.alias("q"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes(q: Column) -> dict[str, Column]:
    """Each rule's vote: -1 against the document, 1 for it, 0 if it abstains."""
    w = q["n_words"]
    enough = w >= BASE_MIN_WORDS
    return {
        "symbols": _vote(q["n_symbols"] * 10 > w, enough & (q["n_symbols"] * 50 <= w)),
        "many_symbols": _vote(q["n_symbols"] * 4 > w, enough & (q["n_symbols"] * 20 <= w)),
        "shouting": _vote(q["n_shout"] * 5 > w, enough & (q["n_shout"] * 50 <= w)),
        "repeats": _vote(q["n_repeat_words"] * 10 > w * 3, enough & (q["n_repeat_words"] * 20 <= w)),
        "lines": _vote((q["n_dup_lines"] >= 3) & (q["n_dup_lines"] * 10 > q["n_lines"] * 3), enough & (q["n_dup_lines"] == 0)),
        "short_words": _vote(enough & (q["n_short"] * 10 < w), enough & (q["n_short"] * 6 >= w)),
        "digits": _vote(q["n_digits"] * 4 > q["word_chars"], enough & (q["n_digits"] * 50 <= q["word_chars"])),
        "stutter": _vote(q["n_stutter"] * 5 > w, enough & (q["n_stutter"] * 20 <= w)),
    }


RULES = ("symbols", "many_symbols", "shouting", "repeats", "lines", "short_words", "digits", "stutter")


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[float, list[tuple[float, float]]]:
    """Share of good documents and, for each rule, its accuracy on good and on bad documents among its votes.

    patterns: (votes, number of documents). Expectation-maximisation for votes that are independent given the class
    and abstentions that tell nothing. Some documents of prior belief smooth each accuracy, and keep the classes from
    changing places where a corpus has no bad documents or nothing else.
    """
    share, right = 0.8, [(0.95, 0.4)] * len(RULES)
    for _ in range(rounds):
        tally = [[18.0, 18.4, 6.0, 16.0] for _ in RULES]  # right and all on good, right and all on bad
        good_all = total = 0.0
        for pattern, n in patterns:
            good = n * posterior(share, right, pattern)
            good_all, total = good_all + good, total + n
            for t, v in zip(tally, pattern):
                if v:
                    t[0] += good * (v > 0)
                    t[1] += good
                    t[2] += (n - good) * (v < 0)
                    t[3] += n - good
        share = (good_all + 8) / (total + 10)
        right = [(t[0] / t[1], t[2] / t[3]) for t in tally]
    return share, right


def weights(share: float, right: list[tuple[float, float]]) -> tuple[float, list[tuple[float, float]]]:
    """Log-odds of good: the prior's, and each rule's for a vote in favour and for one against."""
    return log(share / (1 - share)), [(log(g / (1 - b)), log((1 - g) / b)) for g, b in right]


def posterior(share: float, right: list[tuple[float, float]], pattern: tuple[int, ...]) -> float:
    prior, each = weights(share, right)
    odds = prior + sum(w[0] if v > 0 else w[1] for w, v in zip(each, pattern) if v)
    return 1 / (1 + exp(-min(700.0, max(-700.0, odds))))


def judge(docs: DataFrame, text_col: str = "text", min_prob: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """Per document: row (a struct of the columns to carry, all by default, so that none clashes), q (the counts),
    base_failed, quality_prob and kept.

    Documents with few words, or with many words in repeated windows, fail the base; of the rest, those are kept
    whose posterior probability of being good is at least min_prob. Null and empty texts fail the base. Every row
    is judged on its own, so nulls and repeats elsewhere don't matter; of an empty table nothing is left.

    Counts are computed once into a table in the shared folder. The driver gets only the number of documents per
    pattern of votes: at most 3 ** len(RULES) rows however many documents there are.
    """
    d = save(features(docs, text_col, carry), "quality")
    cast = votes(d["q"])
    found = d.groupBy(*(cast[r].alias(r) for r in RULES)).agg(F.count("*").alias("n")).collect()
    prior, each = weights(*estimate(sorted((tuple(x[r] for r in RULES), x["n"]) for x in found)))
    odds = F.lit(prior)
    for r, (up, down) in zip(RULES, each):
        odds = odds + F.when(cast[r] > 0, up).when(cast[r] < 0, down).otherwise(0.0)
    q = d["q"]
    failed = (q["n_words"] < BASE_MIN_WORDS) | (100 * q["n_repeat_words"] > BASE_MAX_REPEAT_PCT * q["n_words"])
    prob = 1 / (1 + F.exp(-odds))
    return d.withColumns({"base_failed": failed, "quality_prob": prob, "kept": ~failed & (prob >= min_prob)})


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that judge() keeps."""
    return judge(docs, text_col).where("kept").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    d = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=["doc_id"])
    return d.select("row.doc_id", *(F.col(f"q.{k}").alias(k) for k in FEATURES[:5]), "base_failed", "kept", "quality_prob")
