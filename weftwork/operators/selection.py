"""Selecting samples: first of each key, quotas, priorities, diverse and staged picks, splits. Orders are explicit and total."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grounding import small
from .ranking import checkpointed, global_rank


def _nth(keys: Sequence[Column], order: Sequence[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def dedup_first(df: DataFrame, keys: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; null keys are one key."""
    return df.withColumn("__n", _nth(keys, order)).filter("__n = 1").drop("__n")


def duplicates(df: DataFrame, keys: Sequence[Column], order: Sequence[Column]) -> Column:
    """Whether an earlier row has the same key."""
    return _nth(keys, order) > 1


def duplicate_of_approved(ok: Column, keys: Sequence[Column], order: Column) -> Column:
    """Whether an earlier row with the same key passed ``ok``."""
    first = F.min(F.when(ok, order)).over(Window.partitionBy(*keys))
    return F.coalesce(first < order, F.lit(False))


def with_duplicate_of_approved(df: DataFrame, ok: Column, keys: Sequence[Column], order: Column, name: str = "dup") -> DataFrame:
    """``df`` with :func:`duplicate_of_approved`, without a window: a very common key never is one task.

    The first order that passed is aggregated by key and joined back; few keys (counted) are broadcast. ``df`` is read
    twice.
    """
    kept = checkpointed(df.filter(ok).groupBy(*[k.alias(f"__f{i}") for i, k in enumerate(keys)]).agg(F.min(order).alias("__first")).filter("__first is not null"))
    same = reduce(lambda a, b: a & b, [k.eqNullSafe(F.col(f"__f{i}")) for i, k in enumerate(keys)])
    found = df.join(small(kept), same, "left").withColumn(name, F.coalesce(F.col("__first") < order, F.lit(False)))
    return found.drop("__first", *[f"__f{i}" for i in range(len(keys))])


def head_per_group(df: DataFrame, group: Column, n: int, order: Sequence[Column], unknown: str = "__unknown__") -> DataFrame:
    return df.withColumn("__n", _nth([F.coalesce(group, F.lit(unknown))], order)).filter(F.col("__n") <= n).drop("__n")


def rank_of(c: Column, preferred: Sequence[str]) -> Column:
    """Position in ``preferred``; others share the place after the last."""
    at = F.array_position(F.array(*[F.lit(p) for p in preferred]), c)
    return F.coalesce(F.when(at > 0, at - 1), F.lit(len(preferred))).cast("int")


def quota_sample(df: DataFrame, group: Column, limits: Mapping[str, int], order: Sequence[Column]) -> DataFrame:
    """At most ``limits[g]`` first rows of each listed group, with the group's place in the list."""
    if not limits:
        return df.limit(0).withColumn("limit_rank", F.lit(0))
    cap = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    picked = df.filter(group.isin(*limits)).withColumn("__n", _nth([group], order)).filter(F.col("__n") <= max(limits.values()))
    # The constant bound lets each map task drop what no group can take; the own cap follows.
    return picked.withColumn("__cap", F.try_element_at(cap, group)).filter("__n <= __cap").withColumn("limit_rank", rank_of(group, list(limits))).drop("__n", "__cap")


def priority_topk(df: DataFrame, domain: Column, ranks: Sequence[Column], k: Mapping[str, int]) -> DataFrame:
    """The k best rows of each domain; k of 0 or less: none."""
    return quota_sample(df, domain, {d: n for d, n in k.items() if n > 0}, ranks).drop("limit_rank")


def exclude_prior(df: DataFrame, priors: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows whose key is in no earlier selection; no selections: all rows."""
    if not priors:
        return df
    seen = reduce(lambda a, b: a.unionByName(b), [p.select(*keys) for p in priors]).distinct()
    return df.join(seen, list(keys), "left_anti")


def diverse_sample(df: DataFrame, category: Column, preferred: Sequence[str], n: int, keys: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each preferred category, then encounter order, up to n; unique on ``keys``. Category must follow from the key."""
    unique = dedup_first(df, keys, order)
    place = F.row_number().over(Window.partitionBy(category).orderBy(*order))
    phase = F.when(category.isin(*preferred) & (F.col("__p") == 1), 0).otherwise(1)
    rank = F.when(F.col("phase") == 0, rank_of(category, preferred)).otherwise(0)
    # A row behind n of its category is behind n in the end; the constant bound lets each map task drop such rows.
    near = unique.withColumn("__p", place).filter(F.col("__p") <= n)
    return near.withColumn("phase", phase).withColumn("phase_rank", rank).drop("__p").orderBy("phase", "phase_rank", *order).limit(n)


def first_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows by a total order; each task keeps n at most."""
    return df.orderBy(*order).limit(n)


def scored_topn(df: DataFrame, scores: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*scores).limit(n)


def capped_topn(df: DataFrame, category: Column, order: Sequence[Column], n: int, caps: Mapping[str, int]) -> DataFrame:
    """The first n rows, no more than ``caps[c]`` of a capped category."""
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    # No category gives more than n rows; the constant bound lets each map task drop the others.
    near = df.withColumn("__n", _nth([category], order)).filter(F.col("__n") <= n)
    free = near.filter(F.col("__n") <= F.coalesce(F.try_element_at(cap, category), F.lit(n)))
    return free.drop("__n").orderBy(*order).limit(n)


def staged_select(df: DataFrame, stages: Sequence[tuple[str, Column, int]], n: int, id_col: str, pair: Sequence[str], score: Sequence[Column]) -> DataFrame:
    """Greedy quotas in stages: (name, condition, limit); ids and pairs are taken once; the rest fills up to n.

    A stage sees what earlier ones left, keeps the best row of each pair, and takes its limit; ids are unique between
    stages. Null ids and pairs are values like any other. Fewer than n rows in the end raise an error.

    One pass finds candidates for all stages: of each pair as many ids as earlier stages can take and one more, and of
    these the best rows, some for each place of the stage and for each row that earlier stages take. The greedy walk
    over their ids and pairs is exact unless a stage ends with fewer rows than its limit while its candidates were cut;
    then there are four times as many.
    """
    every = [*stages, ("rest", F.lit(True), n)]
    limits = [max(0, min(limit, n)) for _, _, limit in every]
    before = [min(n, sum(limits[:i])) for i in range(len(limits))]
    number = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("__stage"))
    staged = df.withColumn("__stage", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), i) for i, (_, c, _) in enumerate(every)]))))
    one = staged.withColumn("__n", _nth([F.col("__stage"), *[F.col(p) for p in pair], F.col(id_col)], score)).filter("__n = 1")
    held = one.withColumn("__n", _nth([F.col("__stage"), *[F.col(p) for p in pair]], score)).filter((F.col("__n") <= n + 1) & (F.col("__n") <= number(before) + 1))
    factor = 1
    while True:
        bounds = [factor * (a + b) for a, b in zip(limits, before, strict=True)]
        best = held.withColumn("__n", _nth([F.col("__stage")], score)).filter((F.col("__n") <= max(bounds)) & (F.col("__n") <= number(bounds)))
        candidates = checkpointed(best)
        rows = candidates.select("__stage", "__n", F.struct(id_col).alias("id"), F.struct(*pair).alias("pair")).orderBy("__stage", "__n").collect()  # at most the sum of the bounds
        chosen = _walked(rows, limits, bounds, n)
        if chosen is not None:
            break
        factor *= 4
    if len(chosen) < n:
        raise ValueError(f"fewer than {n} rows")
    names = F.get(F.array(*[F.lit(name) for name, _, _ in every]), F.col("__stage"))
    taken = df.sparkSession.createDataFrame(chosen, "__stage int, __n int")
    return candidates.join(F.broadcast(taken), ["__stage", "__n"]).withColumn("stage", names).drop("__stage", "__n")  # n rows


def _walked(rows: Sequence, limits: Sequence[int], bounds: Sequence[int], n: int) -> list[tuple[int, int]] | None:
    """(stage, place) of the rows taken from sorted candidates; None where candidates that were cut could matter."""
    ids, pairs, chosen = set(), set(), []
    for stage, limit in enumerate(limits):
        own, taken = [r for r in rows if r[0] == stage], []
        take = min(limit, n - len(chosen))
        for r in own:
            if len(taken) >= take:
                break
            if r.id not in ids and r.pair not in pairs:
                taken.append(r)
                pairs.add(r.pair)
        if len(taken) < take and len(own) >= bounds[stage]:
            return None
        ids |= {r.id for r in taken}
        chosen += [(r[0], r[1]) for r in taken]
    return chosen


def split_ratio(df: DataFrame, id_col: Column, seed: int, ratio: float = 0.85, names: tuple[str, str] = ("train", "valid")) -> DataFrame:
    """Exact split: the first ceil(ratio x n) ids in the order of md5(seed:id)."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string")).cast("binary"))
    ranked = global_rank(df.withColumn("__key", key), F.col("__key"), id_col)
    total = df.agg(F.count("*").alias("__total"))
    out = ranked.crossJoin(F.broadcast(total))  # one row
    return out.withColumn("split", F.when(F.col("rank") <= F.ceil(F.lit(ratio) * F.col("__total")), names[0]).otherwise(names[1])).drop("__key", "__total")


def split_fixed(df: DataFrame, order: Sequence[Column], sizes: Mapping[str, int]) -> DataFrame:
    """The first rows by position go to the named parts in turn; what is left over goes to none."""
    out, end = F.lit(None).cast("string"), sum(sizes.values())
    for name, size in reversed(sizes.items()):
        out = F.when(F.col("rank") <= end, name).otherwise(out)
        end -= size
    return global_rank(df, *order).withColumn("split", out).filter("split is not null")


def take_distinct(df: DataFrame, category: str, counts: Mapping[str, int], keys: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """The first distinct rows of each category; an error where a category has too few."""
    out = quota_sample(dedup_first(df, keys, order), F.col(category), counts, order).drop("limit_rank")
    have = {r[category]: r["count"] for r in out.groupBy(category).count().collect()}
    short = {c: have.get(c, 0) for c, n in counts.items() if have.get(c, 0) < n}
    if short:
        raise ValueError(f"too few rows: {short}")
    return out


def with_history(df: DataFrame, session: str, order: str, role: str = "role", content: str = "text") -> DataFrame:
    """Each turn with the turns before it as an array of (role, content)."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("history", F.collect_list(F.struct(F.col(role).alias("role"), F.col(content).alias("content"))).over(w))


def session_history(df: DataFrame, session: str, order: Sequence[str], reset: Column, role: Column, content: Column, keep: int) -> DataFrame:
    """Each turn with at most ``keep`` turns before it since the session's last reset; a reset starts anew with its own turn.

    earlier: the number of turns since the reset, also of those that ``keep`` leaves out.
    """
    past = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = df.withColumn("__part", F.sum(F.coalesce(reset, F.lit(False)).cast("int")).over(past))
    own = Window.partitionBy(session, "__part").orderBy(*order)
    turn = F.struct(role.alias("role"), content.alias("content"))
    out = parts.withColumn("earlier", (F.row_number().over(own) - 1).cast("long")).withColumn("history", F.collect_list(turn).over(own.rowsBetween(-keep, -1)))
    return out.drop("__part")


def assign_ids(df: DataFrame, fmt: str, *order: Column) -> DataFrame:
    return global_rank(df, *order).withColumn("new_id", F.format_string(fmt, "rank")).drop("rank")


def leakage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that two parts share; the parts must have none."""
    return a.select(key).intersect(b.select(key))
