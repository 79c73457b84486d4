"""URL filter: rules by host and path first, then the ratio of two character language models.

The models are learnt from all urls that a rule allows and all that a rule blocks. Both are variable-order Markov
models: the chance of a character after a context of k characters is interpolated (Witten-Bell) with the chance after
one character less, so a context that was never seen leaves the shorter one in charge. A url's score is the difference
of the two log-likelihoods per character. The threshold is calibrated on the ruled urls: where the two score
distributions, taken by mean and deviation, are equally far off.

Counts are made once over all n-grams of all urls; shorter n-grams are sums of longer ones. A group of equal contexts
has one row per following character. Scores are joined to urls by n-gram; a frequent n-gram has one row per url.

Urls are scored whole; cutting one into n-grams costs the square of its length, so urls of many thousand characters are slow,
not dropped. An empty table gives an empty result. Null urls and urls without :// have an empty host and path, no rule and score 0. Repeated rows are judged alike.
Without ruled urls of both kinds there is nothing to compare, and all urls without a rule are allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayflow.llm.texts import lower_ascii
from stayflow.session import work_dir

ORDER = 4
ALPHABET = 256


@dataclass(frozen=True)
class UrlRule:
    """`place` is host and path, as in example.org/es/; it holds for the host and all its subdomains."""

    verdict: str
    place: str

    def fits(self, host: Column, path: Column) -> Column:
        name, slash, rest = self.place.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def longest_rule(rules: list[UrlRule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. For a list of rules that fits into one expression."""
    place, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.place)):
        fits = rule.fits(host, path)
        place, verdict = F.when(fits, F.lit(rule.place)).otherwise(place), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return place, verdict


def _grams(text: Column) -> Column:
    """The n-grams of ORDER + 1 characters that end in each character; line feeds pad the start and mark the end."""
    padded = F.concat(F.lit("\n" * ORDER), text, F.lit("\n"))
    places = F.sequence(F.lit(1), F.length(text) + 1)
    return F.when(F.length(text) > 0, F.transform(places, lambda i: F.substring(padded, i, ORDER + 1)))


def _log_ratios(grams: DataFrame) -> DataFrame:
    """gram, ratio for every distinct gram: log of its chance among allowed urls less that among blocked ones."""
    counts = grams.groupBy("gram").agg(F.count_if(F.col("label") == "allow").alias("a"), F.count_if(F.col("label") == "block").alias("b"))
    levels = [counts]
    for k in range(ORDER, 0, -1):
        longer = levels[0].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        levels.insert(0, longer)
    chances = None
    for k, level in enumerate(levels):
        after = Window.partitionBy(F.substring("gram", 1, k))
        stats = level.select("gram", "a", "b", *(f(c).over(after).alias(f"{c}_{n}") for c in "ab" for n, f in (
            ("all", F.sum), ("kinds", lambda c: F.count_if(F.col(c) > 0)))))
        if chances is None:
            stats = stats.withColumns({"pa": F.lit(1 / ALPHABET), "pb": F.lit(1 / ALPHABET)})
        else:
            stats = stats.withColumn("rest", F.substring("gram", 2, k)).join(chances, "rest")
        mixed = lambda c: F.when(F.col(f"{c}_all") == 0, F.col(f"p{c}")).otherwise(
            (F.col(c) + F.col(f"{c}_kinds") * F.col(f"p{c}")) / (F.col(f"{c}_all") + F.col(f"{c}_kinds")))
        chances = stats.select(F.col("gram").alias("rest"), mixed("a").alias("pa"), mixed("b").alias("pb"))
    return chances.select(F.col("rest").alias("gram"), (F.log("pa") - F.log("pb")).alias("ratio"))


def judge(pages: DataFrame, rules: list[UrlRule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": rule, "label": verdict, "place": F.concat("host", "path")})
    grams = rows.select("place", "label", F.explode(_grams(F.col("place"))).alias("gram"))
    ratios = _log_ratios(grams)
    # Equal places score alike: score each once, with its number of rows kept out of the join.
    places = rows.where(F.length("place") > 0).select("place").distinct()
    parts = places.select("place", F.explode(_grams(F.col("place"))).alias("gram")).join(ratios, "gram")
    scores = parts.groupBy("place").agg(F.round(F.sum("ratio") / F.count("*"), 9).alias("score"))
    folder = work_dir(spark, "url-scores")
    rows.join(scores, "place", "left").write.parquet(folder)
    judged = spark.read.parquet(folder).withColumn("score", F.coalesce("score", F.lit(0.0)))
    per = {r.label: r for r in judged.where("label is not null and place <> ''").groupBy("label").agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("deviation")).collect()}
    if {"allow", "block"} <= set(per):
        a, b = per["allow"], per["block"]
        both = a.deviation + b.deviation
        level = (a.mean * b.deviation + b.mean * a.deviation) / both if both > 0 else (a.mean + b.mean) / 2
    else:
        level = float("-inf")
    model = F.when(F.col("score") >= F.lit(level), "allow").otherwise("block")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("label", model).alias("verdict"), "score")
