"""Review gates and validators: ordered conditions that give a reason, a status or one row an error."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.functions.text import contains_any, fold, missing_terms


def first_reason(checks: Sequence[tuple[Column, str]]) -> Column:
    """The reason of the first condition that holds; null conditions do not hold; none: null."""
    out = F.lit(None).cast("string")
    for condition, reason in reversed(checks):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(reason)).otherwise(out)
    return out


def gate(df: DataFrame, checks: Sequence[tuple[Column, str]], warn: Sequence[str] = ()) -> DataFrame:
    """``df`` with skip_reason (null: kept) and warned: whether the reason is one that warns."""
    out = df.withColumn("skip_reason", first_reason(checks))
    return out.withColumn("warned", F.coalesce(F.col("skip_reason").isin(*warn), F.lit(False)) if warn else F.lit(False))


def kept(gated: DataFrame) -> DataFrame:
    return gated.filter("skip_reason is null").drop("skip_reason", "warned")


def all_errors(checks: Sequence[tuple[Column, Column | str]]) -> Column:
    """Messages of all conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), m if isinstance(m, Column) else F.lit(m)) for c, m in checks]))


def validate(df: DataFrame, id_col: str, checks: Sequence[tuple[Column, Column | str]]) -> DataFrame:
    """(id, position, error): one row an error."""
    return df.select(id_col, F.posexplode(all_errors(checks)).alias("position", "error"))


def review(df: DataFrame, statuses: Sequence[tuple[Column, str]], default: str, included: Sequence[str]) -> DataFrame:
    """``df`` with status (first condition that holds, else ``default``) and include (whether the status is an included one)."""
    status = F.coalesce(first_reason(statuses), F.lit(default))
    return df.withColumn("status", status).withColumn("include", F.col("status").isin(*included))


def with_review(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with review columns added or overwritten; all computed from the columns as they were."""
    return df.withColumns(columns)


def semantic_status(text: Column, preserve: Column, forbidden: Column, synonyms: Mapping[str, Sequence[str]], changes: Sequence[str], duplicate: Column) -> Column:
    """Empty, then a missing term, a forbidden fact (synonyms included), a changed order state, a duplicate; else approved."""
    low = F.lower(text)
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))]) if synonyms else None
    wide = F.flatten(F.transform(forbidden, lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(table, t), F.array())))) if synonyms else forbidden
    checks = [
        (F.coalesce(F.trim(text), F.lit("")) == "", "rejected_empty"),
        (F.size(missing_terms(text, preserve)) > 0, "rejected_missing_term"),
        (F.exists(wide, lambda t: low.contains(F.lower(t))), "rejected_forbidden_fact"),
        (contains_any(low, changes), "rejected_changes_order"),
        (duplicate, "rejected_duplicate"),
    ]
    return F.coalesce(first_reason(checks), F.lit("approved"))


def chat_contract(messages: Column, roles: Sequence[str] = ("system", "user", "assistant")) -> Column:
    """Errors of a chat record: number of messages, order of roles, blank contents."""
    return all_errors([
        (F.size(messages) != len(roles), f"needs {len(roles)} messages"),
        (F.transform(messages, lambda m: m["role"]) != F.array(*[F.lit(r) for r in roles]), "roles out of order"),
        (F.exists(messages, lambda m: F.trim(F.coalesce(m["content"], F.lit(""))) == ""), "blank content"),
    ])


def has_term(text: Column, term: str) -> Column:
    return fold(text).contains(fold(F.lit(term)))
