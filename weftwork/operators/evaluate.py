"""Evaluation: outputs matched to cases, scores with reasons, reports and latency figures."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.functions.text import missing_terms, present_terms
from weftwork.operators.ranking import checkpointed


def match_outputs(cases: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """All cases with their output; status missing where there is none. Outputs without a case are left out."""
    found = cases.join(outputs.withColumn("__hit", F.lit(True)), key, "left")
    return found.withColumn("status", F.when(F.col("__hit").isNull(), "missing").otherwise("matched")).drop("__hit")


def valid_outputs(outputs: DataFrame, key: str, reason: Column, order: Sequence[Column]) -> DataFrame:
    """``outputs`` with reason: an invalid record's own, or duplicate_key after the first valid record of a key."""
    w = Window.partitionBy(key, F.col("__own").isNull()).orderBy(*order)
    marked = outputs.withColumn("__own", reason).withColumn("__n", F.row_number().over(w))
    return marked.withColumn("reason", F.coalesce("__own", F.when(F.col("__n") > 1, "duplicate_key"))).drop("__own", "__n")


def score(df: DataFrame, text: Column, expected: Column, forbidden: Column, intent: Column | None = None, wanted: Column | None = None) -> DataFrame:
    """``df`` with reasons (array) and status: intent mismatch, missing expected terms, found forbidden ones."""
    found = [
        F.transform(missing_terms(text, expected), lambda t: F.concat(F.lit("missing: "), t)),
        F.transform(present_terms(text, forbidden), lambda t: F.concat(F.lit("forbidden: "), t)),
    ]
    if intent is not None:
        found.insert(0, F.when(wanted.isNotNull() & ~intent.eqNullSafe(wanted), F.array(F.concat(F.lit("intent: "), F.coalesce(intent, F.lit("none"))))).otherwise(F.array().cast("array<string>")))
    return df.withColumn("reasons", F.concat(*found)).withColumn("status", F.when(F.size("reasons") == 0, "passed").otherwise("failed"))


def report(df: DataFrame, status: str = "status") -> DataFrame:
    """One row: totals by status and the pass rate in percent of all cases (0 when there are none)."""
    n = lambda *s: F.count_if(F.col(status).isin(*s)).alias(s[0])
    total = F.count("*")
    return df.agg(total.alias("total"), n("passed"), n("failed"), n("missing"), n("invalid"), F.round(F.coalesce(F.try_divide(100.0 * F.count_if(F.col(status) == "passed"), total), F.lit(0.0)), 4).alias("pass_rate"))


def problem_lines(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.size("reasons") > 0).select(key, F.array_join("reasons", "; ").alias("problems"))


#: A group of at most so many values is ranked by one window.
RANKED = 100_000
#: Ranges into which the values around a rank are counted in one pass.
RANGES = 1024


def _range(v: Column, lo: Column, hi: Column, ranges: int) -> Column:
    """The range of a value between lo and hi: 0 and the last for the ends themselves, the inner ones by size; rises with the value."""
    share = (v / 2 - lo / 2) / (hi / 2 - lo / 2)
    inner = F.floor(F.nanvl(share, F.lit(0.5)) * (ranges - 2)) + 1
    return F.when(v == lo, 0).when(v == hi, ranges - 1).otherwise(F.least(F.greatest(inner, F.lit(1)), F.lit(ranges - 2)))


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, Callable[[Column], Column]], at_most: int = RANKED, ranges: int = RANGES) -> DataFrame:
    """Exact order statistics of each group: (keys, n, least, most, mean, a column a rank). Nulls are left out.

    ``ranks``: the 0-based rank of each statistic from the number of values. A group of more than ``at_most`` values is
    not sorted: its values are counted in ranges between least and most, and only the range that holds the rank is
    looked at again, until it has one value or few enough. So a large group is counted by all tasks; each pass takes one
    row a range through the shuffle. NaN stands after all numbers.
    """
    rows = df.filter(F.col(value).isNotNull()).select(F.struct(*keys).alias("g"), F.col(value).cast("double").alias("v"))
    groups = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.avg("v").alias("mean"))
    if (groups.agg(F.max("n")).first()[0] or 0) > at_most:
        groups = checkpointed(groups)
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("rank")) for name, rank in ranks.items()])
    found = groups.select("g", F.explode(wanted).alias("w"), F.col("least").alias("lo"), F.col("most").alias("hi"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")).select("g", "w.name", "w.rank", "lo", "hi", "below", "inside")
    is_open = (F.col("inside") > at_most) & (F.col("lo") < F.col("hi"))
    near = lambda some: rows.join(narrow(some), "g").filter(F.col("v").between(F.col("lo"), F.col("hi")))
    while (still := found.filter(is_open)).limit(1).count():
        counted = near(still).groupBy("g", "name", "rank", "below", _range(F.col("v"), F.col("lo"), F.col("hi"), ranges).alias("range")).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        up_to = F.col("below") + F.sum("c").over(Window.partitionBy("g", "name").orderBy("range"))
        held = counted.withColumn("up_to", up_to).filter((F.col("up_to") > F.col("rank")) & (F.col("up_to") - F.col("c") <= F.col("rank")))
        closer = held.select("g", "name", "rank", "lo", "hi", (F.col("up_to") - F.col("c")).alias("below"), F.col("c").alias("inside"))
        found = checkpointed(found.filter(~is_open).unionByName(closer))
    place = F.row_number().over(Window.partitionBy("g", "name").orderBy("v")) + F.col("below") - 1
    ranked = near(found.filter("lo < hi")).withColumn("place", place).filter("place = rank").select("g", "name", "v")
    every = ranked.unionByName(found.filter("not (lo < hi)").select("g", "name", F.col("lo").alias("v")))
    values = every.groupBy("g").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks])
    return groups.join(values, "g").select("g.*", "n", *ranks, "least", "most", "mean")


def narrow(df: DataFrame, most: int = 50_000) -> DataFrame:
    """``df`` with a hint to broadcast it if it has at most ``most`` rows (counted)."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def latency_stats(df: DataFrame, keys: Sequence[str], value: str, at_most: int = RANKED) -> DataFrame:
    """Upper median s[n//2], p95 s[max(0, floor(0.95 n) - 1)], least, most and mean of each group, exact at any group size."""
    ranks = {"median": lambda n: F.floor(n / 2), "p95": lambda n: F.greatest(F.lit(0), F.floor(n * F.lit(0.95)) - 1)}
    return order_statistics(df, keys, value, ranks, at_most).withColumn("mean", F.round("mean", 4))


def audit_summary(df: DataFrame, group: str, passed: Column, latency: Column) -> DataFrame:
    """Rows, passes, pass share (0 to 1) and mean latency of each group."""
    return df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(passed).alias("passed"), F.round(F.try_divide(F.count_if(passed), F.count("*")), 6).alias("pass_share"), F.round(F.avg(latency), 4).alias("mean_latency"))


def coverage_check(df: DataFrame, category: str, required: dict[str, int]) -> DataFrame:
    """(category, required, found, ok) for each required category."""
    spark = df.sparkSession
    spec = spark.createDataFrame(list(required.items()), "category string, required long")
    have = df.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("found"))
    return spec.join(have, "category", "left").select("category", "required", F.coalesce("found", F.lit(0)).alias("found"), (F.coalesce("found", F.lit(0)) >= F.col("required")).alias("ok"))


def evaluate(cases: DataFrame, backend: Callable[[DataFrame], DataFrame], **how) -> DataFrame:
    """Cases answered by any backend (a DataFrame transform that adds response) and scored."""
    return score(backend(cases), F.col("response"), **how)
