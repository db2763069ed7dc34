"""URL filtering by the likelihood ratio of two character models, in DataFrame operations only.

Rules decide the URLs that they fit. The URLs that rules accept and reject train one variable-order Markov model
each, over a 32-sign alphabet: contexts of up to ORDER signs, interpolated from the empty context upwards with
Witten-Bell weights, so an unseen context falls back to its longest seen suffix. A URL's score is the difference of
the two log-likelihoods, divided by its length. The score from which on a URL is accepted is calibrated on the
fifth of the ruled URLs that training leaves out: it has the least sum of both error rates.

Everything is counted over all URLs by partial aggregation; a count table has 2 x 32^(ORDER + 1) rows at most
whatever the input. The ratio table has 32^(ORDER + 1) rows, a fixed size, and is broadcast; signs are looked up where
they are and summed there, so a row for each distinct address is all that is shuffled.

Defined cases: a null URL or one without `://` has an empty host and path; what is empty after `://` fits no rule and
is judged by the closing sign alone. If the rules accept none or reject none, the others get the verdict of the only
model there is; without any ruled URL, all are allowed. Repeated rows count repeatedly; a null page_id is a page as any
other; a very long URL is one row, its signs looked up where it is read; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm._common import join_on_counted_key, stored

#: Signs of the model; all others are `_`, and 0 stands for the ends.
SIGNS = "abcdefghijklmnopqrstuvwxyz0./-_"
ALPHABET = 32
ORDER = 3
CALIBRATION_FOLDS = 5
BIN = 0.005
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits; null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def grams(address: Column) -> Column:
    """Each sign and the closing end with the ORDER signs before it, as one number of base ALPHABET."""
    plain = F.regexp_replace(F.regexp_replace(F.translate(address, UPPER, LOWER), "[0-9]", "0"), "[^a-z0./-]", "_")
    signs = F.filter(F.split(plain, ""), lambda c: c != "")
    codes = F.concat(F.array_repeat(F.lit(0), ORDER), F.transform(signs, lambda c: F.instr(F.lit(SIGNS), c)), F.array(F.lit(0)))

    def numbers(c: Column) -> Column:
        def number(i: Column) -> Column:
            out = F.get(c, i)
            for k in range(1, ORDER + 1):
                out = out * ALPHABET + F.get(c, i + k)
            return out

        return F.transform(F.sequence(F.lit(0), F.size(c) - 1 - ORDER), number)

    # bound to a variable, the codes are made once for each URL
    return F.flatten(F.transform(F.array(codes), numbers))


def ratio_table(ruled: DataFrame) -> DataFrame:
    """ln p accepted - ln p rejected of the last sign after those before it, for every number of base ALPHABET: gram, ratio."""
    spark = ruled.sparkSession
    good, bad = F.count_if(F.col("verdict") == "allow"), F.count_if(F.col("verdict") == "block")
    seen = ruled.select("verdict", F.explode(grams(F.col("address"))).alias("gram")).groupBy("gram").agg(good.alias("n0"), bad.alias("n1"))
    seen = stored(seen, "grams")  # ALPHABET ^ (ORDER + 1) rows at most
    table = None
    for k in range(ORDER + 1):
        span = ALPHABET ** (k + 1)
        some = seen.groupBy((F.col("gram") % span).cast("int").alias("gram")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        grid = spark.range(span).select(F.col("id").cast("int").alias("gram"), F.floor(F.col("id") / ALPHABET).cast("int").alias("context"))
        grid = grid.join(F.broadcast(some), "gram", "left").na.fill(0, ["n0", "n1"])
        same = W.partitionBy("context")
        if table is None:
            chance = [(F.col(f"n{j}") + 1.0) / (F.sum(f"n{j}").over(same) + ALPHABET) for j in (0, 1)]
            table = grid.select("gram", *[c.alias(f"p{j}") for j, c in enumerate(chance)])
            continue
        shorter = table.select(F.col("gram").alias("short"), F.col("p0").alias("q0"), F.col("p1").alias("q1"))
        grid = grid.withColumn("short", F.col("gram") % (span // ALPHABET)).join(F.broadcast(shorter), "short")
        chance = []
        for j in (0, 1):
            met, kinds = F.sum(f"n{j}").over(same), F.count_if(F.col(f"n{j}") > 0).over(same)
            chance.append(F.when(met == 0, F.col(f"q{j}")).otherwise((F.col(f"n{j}") + kinds * F.col(f"q{j}")) / (met + kinds)))
        table = grid.select("gram", *[c.alias(f"p{j}") for j, c in enumerate(chance)])
    return table.select("gram", (F.ln("p0") - F.ln("p1")).alias("ratio"))


def scored(urls: DataFrame, ratios: DataFrame) -> DataFrame:
    """Add score to urls with a column address: each distinct address is scored once and joined back."""
    counted = urls.groupBy("address").agg(F.count(F.lit(1)).alias("n_same"))
    signs = counted.select("address", "n_same", F.explode(grams(F.col("address"))).alias("gram"))
    # the signs of an address are neighbours in one task, so partial sums leave a row an address to shuffle
    summed = signs.join(F.broadcast(ratios), "gram").groupBy("address", "n_same").agg(F.avg("ratio").alias("score"))
    total = urls.count()
    return join_on_counted_key(urls, summed, "address", "n_same", total).drop("n_same")


def threshold(left_out: DataFrame) -> DataFrame:
    """One row, column cut: the score from which on accepting has the least sum of both error rates."""
    bins = left_out.groupBy(F.floor(F.col("score") / BIN).alias("bin")).agg(F.sum((F.col("verdict") == "allow").cast("long")).alias("good"), F.sum((F.col("verdict") == "block").cast("long")).alias("bad"))
    below = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)  # bins are bounded: scores are within a few units of 0
    every = W.partitionBy()
    lost = F.coalesce(F.sum("good").over(below), F.lit(0)) / F.greatest(F.sum("good").over(every), F.lit(1))
    let = 1 - F.coalesce(F.sum("bad").over(below), F.lit(0)) / F.greatest(F.sum("bad").over(every), F.lit(1))
    return bins.select("bin", (lost + let).alias("error")).agg(F.coalesce(F.min_by(F.col("bin") * F.lit(BIN), F.struct(F.col("error"), F.abs("bin"), F.col("bin"))), F.lit(0.0)).alias("cut"))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (null where a rule decides, or there is one model only)."""
    url = F.col("url")
    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)://(.*)", 1).alias("address"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parts = parts.withColumns({"rule": rule, "verdict": verdict})
    ruled = parts.where(F.col("verdict").isNotNull()).withColumn("out", F.pmod(F.xxhash64(F.lit(3), "address"), F.lit(CALIBRATION_FOLDS)) == 0)
    n = {r.verdict: r.n for r in ruled.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).collect()}
    decided = parts.where(F.col("verdict").isNotNull()).select("page_id", "host", "path", "rule", "verdict", F.lit(None).cast("double").alias("score"))
    rest = parts.where(F.col("verdict").isNull())
    if len(n) < 2:
        only = next(iter(n), "allow")
        other = rest.select("page_id", "host", "path", "rule", F.lit(only).alias("verdict"), F.lit(None).cast("double").alias("score"))
        return decided.unionByName(other)
    ratios = stored(ratio_table(ruled.where(~F.col("out"))), "ratios")
    cut = threshold(scored(ruled.where("out"), ratios)).scalar()
    told = scored(rest, ratios)
    other = told.select("page_id", "host", "path", "rule", F.when(F.col("score") >= cut, "allow").otherwise("block").alias("verdict"), "score")
    return decided.unionByName(other)
