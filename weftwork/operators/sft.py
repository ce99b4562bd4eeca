"""Fine-tuning records: prompts, chat records, references, output templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.operators.gates import chat_contract


def chat_record(system: str, user: Column, assistant: Column) -> Column:
    """Array of (role, content): system, user, assistant."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(turn("system", F.lit(system)), turn("user", user), turn("assistant", assistant))


def listed(arr: Column) -> Column:
    """Comma-joined, or - when empty."""
    return F.coalesce(F.nullif(F.array_join(arr, ", "), F.lit("")), F.lit("-"))


def paraphrase_prompt(intent: Column, canonical: Column, preserve: Column, forbid: Column) -> Column:
    return F.concat(F.lit("Intent: "), intent, F.lit("\nCanonical: "), canonical, F.lit("\nKeep: "), listed(preserve), F.lit("\nAvoid: "), listed(forbid))


#: Sections of a grounded prompt, and the task at its end: fixed values.
SECTIONS = ("Kullanıcı mesajı: ", "Intent: ", "Canonical cevap: ", "Korunacak terimler: ", "Eklenmemesi gereken terimler: ")
TASK = "Görev: Canonical cevabı daha doğal Türkçe ile paraphrase et ama güvenlik ve grounding kurallarını bozma."


def grounded_prompt(message: Column, intent: Column, canonical: Column, preserve: Column, forbid: Column) -> Column:
    """The user part of a paraphrase record: a line a section, lists joined or -, and the task."""
    values = (message, intent, canonical, listed(preserve), listed(forbid))
    return F.concat_ws("\n", *[F.concat(F.lit(s), v) for s, v in zip(SECTIONS, values, strict=True)], F.lit(TASK))


def record_errors(records: DataFrame, seeds: DataFrame, system: str) -> DataFrame:
    """``records`` (messages, metadata of id, intent, notes) with errors against their seeds: one array a record.

    seeds: id, user_message, intent, canonical_response, safe_paraphrase, must_preserve_terms, must_not_introduce, notes.
    Checked: three messages in role order, none blank, the system prompt, all sections, the seed's texts and terms in
    the user part (- where it has no forbidden terms), the assistant's text and the metadata equal to the seed's.
    """
    own = seeds.select(F.col("id").alias("__id"), F.struct(*[c for c in seeds.columns if c != "id"]).alias("__s"))
    r = records.join(own, F.col("metadata.id") == F.col("__id"), "left")
    said = lambda i: F.coalesce(F.get(F.col("messages"), F.lit(i))["content"], F.lit(""))
    user, seed = said(1), F.col("__s")
    lacks = lambda terms: F.exists(F.coalesce(terms, F.array().cast("array<string>")), lambda t: ~F.contains(user, t))
    sections = F.exists(F.array(*[F.lit(s.strip()) for s in SECTIONS if s != "Intent: "]), lambda s: ~F.contains(user, s))
    forbidden = seed["must_not_introduce"]
    checks = [
        (F.col("__id").isNull(), "no seed"),
        (said(0) != system, "another system prompt"),
        (sections, "a section is missing"),
        (~F.contains(user, seed["user_message"]), "the message is missing"),
        (~F.contains(user, seed["canonical_response"]), "the canonical response is missing"),
        (lacks(seed["must_preserve_terms"]), "a term to keep is missing"),
        (F.when(F.size(forbidden) > 0, lacks(forbidden)).when(F.col("__id").isNotNull(), ~F.contains(user, F.lit(f"{SECTIONS[4].strip()} -"))), "a forbidden term is missing"),
        (said(2) != seed["safe_paraphrase"], "another paraphrase"),
        (~F.col("metadata.intent").eqNullSafe(seed["intent"]) & F.col("__id").isNotNull(), "another intent"),
        (~F.col("metadata.notes").eqNullSafe(seed["notes"]) & F.col("__id").isNotNull(), "other notes"),
    ]
    errors = F.concat(chat_contract(F.col("messages")), F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for c, m in checks])))
    return r.withColumn("errors", errors).drop("__id", "__s")


def missing_ids(ids: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    return ids.join(seed, key, "left_anti").select(key)


def export_reference(ids: DataFrame, seed: DataFrame, key: str, fields: list[str], strict: bool = True) -> DataFrame:
    """The seed rows of ``ids`` with the required fields; strict: an id without a row is an error."""
    if strict and (lost := [r[0] for r in missing_ids(ids, seed, key).limit(5).collect()]):
        raise ValueError(f"no seed for {lost}")
    return ids.join(seed, key).select(key, *[f for f in fields if f != key])


def output_template(references: DataFrame, key: str, field: str = "response") -> DataFrame:
    """One blank output a reference; rows without an id are an error of the reference."""
    return references.filter(F.col(key).isNotNull()).select(F.col(key), F.lit("").alias(field))


def final_response(canonical: Column, paraphrase: Column, reasons: Column) -> Column:
    """The paraphrase, or the canonical text where it was rejected; rejection kinds once each."""
    bad = F.size(reasons) > 0
    kinds = F.array_distinct(F.transform(reasons, lambda r: F.substring_index(r, ":", 1)))
    return F.struct(F.when(bad, canonical).otherwise(paraphrase).alias("text"), (~bad).alias("used_paraphrase"), kinds.alias("rejections"))


def rewrite(text: Column, mapping: dict[str, str], rules: list[tuple[Column, Column]], template: Column) -> Column:
    """An exact map first, then conditional rewrites in order, then the template."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    out = template
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    return F.coalesce(F.try_element_at(table, text), out)
