"""URL filtering by association rules from FP-growth, beside given host and path rules; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.002, 0.7, 1.2
#: Labelled urls that a rule must hold for in any case: few rows tell nothing.
MIN_ROWS = 20
#: FP-growth makes all subsets of a transaction's tokens, so a url of more than two groups of so many frequent tokens
#: gives one transaction for each two groups: any two of its tokens meet in one.
GROUP = 6


def host(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, with A-Z lower-cased; empty for null or where :// is missing."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """The distinct tokens of a url: host labels, path segments and query keys; runs of digits are one token."""
    clean = lambda x: F.regexp_replace(F.lower(x), "[0-9]+", "0")
    part = lambda kind, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(kind), clean(x)))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    return F.array_distinct(F.concat(part("host:", F.split(host(url), r"\.")), part("path:", F.split(path(url), "/")), part("query:", keys)))


def given_rule(url_host: Column, url_path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; a host's rule fits its subdomains too. Of equally long ones the
    first in order of text wins. Null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda x: (len(x[1] + x[2]), [-ord(c) for c in x[1] + x[2]])):
        fits = ((url_host == h) | F.endswith(url_host, F.lit("." + h))) & F.startswith(url_path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _transactions(tokens: Column, last: Column) -> Column:
    """The transactions of a url: its frequent tokens, by groups where there are many, each with its label."""
    some = lambda xs, i: F.slice(xs, i * GROUP + 1, F.lit(GROUP))
    groups = F.ceil(F.size(tokens) / GROUP).cast("int")
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), groups - 2), lambda i: F.transform(F.sequence(i + 1, groups - 1), lambda j: F.concat(some(tokens, i), some(tokens, j), last))))
    return F.when(groups <= 2, F.array(F.concat(tokens, last))).otherwise(pairs)


def recounted(rows: DataFrame, found: DataFrame, often: DataFrame) -> DataFrame:
    """(tokens, index, n, blocked): for each set of tokens, how many of rows (tokens, blocked) hold it and how many of
    those are blocked, over all their tokens. index is the set's rarest token, by which rows and sets meet."""
    index = found.select("tokens", F.explode("tokens").alias("token")).join(often, "token").groupBy("tokens").agg(F.min(F.struct("n", "token")).alias("i"))
    index = index.select(F.col("tokens").alias("needs"), F.col("i.token").alias("index"))
    held = rows.select("tokens", "blocked", F.explode("tokens").alias("index")).join(index, "index").where(F.size(F.array_except("needs", "tokens")) == 0)
    return held.groupBy(F.col("needs").alias("tokens"), "index").agg(F.count("*").alias("n"), F.sum(F.col("blocked").cast("long")).alias("blocked"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """Rules from labelled urls (url, blocked boolean): verdict, tokens, confidence, support, index (the token that
    they are found by).

    FP-growth mines the combinations of tokens and labels with at least min_support and MIN_ROWS rows. Their support and
    confidence are then counted over all tokens of all labelled urls, and those stay that conclude a label with
    min_confidence and at min_lift times its share. All rules of one or two tokens are found, however long urls are; longer
    ones in urls of up to 2 * GROUP frequent tokens, and within each two groups of longer urls.

    Rows with a null in either column are ignored; without any others there are no rules. Repeated rows count each.
    Urls may be of any length: each is split once. The index token of a rule is its rarest, so that common ones
    don't gather rules.
    """
    rows = labelled.where("url is not null and blocked is not null").select(tokens(F.col("url")).alias("tokens"), "blocked", F.monotonically_increasing_id().alias("row"))
    with scratch(labelled.sparkSession) as keep:
        rows = save(rows, "urls")
        n, blocked = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("blocked").cast("long")), F.lit(0))).first()
        min_support = max(min_support, MIN_ROWS / max(n, 1))
        if min_support > 1:
            return labelled.sparkSession.createDataFrame([], "verdict string, tokens array<string>, confidence double, support double, index string")
        often = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= min_support * n)
        often = save(often, "tokens")
        taken = rows.select("row", "blocked", F.explode("tokens").alias("token")).join(often, "token")
        taken = taken.groupBy("row", "blocked").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("t"))
        taken = taken.select(F.transform("t", lambda x: x["token"]).alias("t"), F.array(F.when(F.col("blocked"), "=block").otherwise("=allow")).alias("last"))
        items = save(taken.select(F.explode(_transactions(F.col("t"), F.col("last"))).alias("items")), "items")
        sets = FPGrowth(itemsCol="items", minSupport=min(1.0, min_support * n / max(1, items.count()))).fit(items).freqItemsets
        sets = sets.where(F.exists("items", lambda x: x.isin("=block", "=allow")))
        sets = sets.select(F.sort_array(F.filter("items", lambda x: ~x.isin("=block", "=allow"))).alias("tokens")).where(F.size("tokens") > 0).distinct()
        both = F.explode(F.array(*(F.struct(F.lit(v).alias("verdict"), c.cast("double").alias("hits"), F.lit(share / n).alias("share")) for v, c, share in (("block", F.col("blocked"), blocked), ("allow", F.col("n") - F.col("blocked"), n - blocked)))))
        rules = recounted(rows, sets, often).select("tokens", "index", "n", both.alias("x")).select("x.verdict", "tokens", (F.col("x.hits") / F.col("n")).alias("confidence"), (F.col("x.hits") / n).alias("support"), "index", "x.share")
        rules = rules.where((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence) & (F.col("confidence") >= min_lift * F.col("share")))
        return keep(save(rules.drop("share"), "rules"))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, best) for the distinct urls that a mined rule matches; best is the rule of the highest confidence, then
    support. An equality join on the index token finds candidates; the rest of a rule's tokens is then checked."""
    seen = urls.where("url is not null").select("url").distinct().withColumn("tokens", tokens(F.col("url")))
    seen = seen.select("url", "tokens", F.explode("tokens").alias("index"))
    index = rules.select("index", F.struct("confidence", "support", "verdict", F.array_join("tokens", " ").alias("text")).alias("rule"), F.col("tokens").alias("needs"))
    hits = seen.join(index, "index").where(F.size(F.array_except("needs", "tokens")) == 0)
    return hits.groupBy("url").agg(F.max("rule").alias("best"))


def judge(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, mined (the tokens of the mined rule that matches best),
    confidence.

    A given rule decides where one fits, else the best mined rule, else allow. A null url, or one without ://, has an
    empty host and path and is allowed. Repeated ids and urls stay rows of their own; an empty table gives an empty
    result. Urls are matched once however many pages share them.
    """
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"))
    best = match(rows, mine(labelled))
    h, p = host(F.col("url")), path(F.col("url"))
    rule, verdict = given_rule(F.col("host"), F.col("path"), rules)
    out = rows.join(best, "url", "left").select("id", "best", h.alias("host"), p.alias("path"))
    return out.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, "best.verdict", F.lit("allow")).alias("verdict"), F.col("best.text").alias("mined"), F.col("best.confidence").alias("confidence"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a document hold for the page of the same number: blocked if of low quality or toxic."""
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    blocked = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    return judge(pages, pages.select("page_id", "url").join(blocked, "page_id").select("url", "blocked"))
