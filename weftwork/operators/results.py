"""Grounded results of whole conversations: intents, order state before and after each message, terms, checks, final texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.operators import grounding as J
from weftwork.operators import sft
from weftwork.operators.orders import fold_steps
from weftwork.operators.ranking import checkpointed

#: The reply whose text answers each grounded intent; menu questions are told apart by a mention.
REPLY_OF = {
    "greeting": "greeting", "restaurant_info": "restaurant_info", "recommendation": "recommendation", "price_question": "ask_price", "allergen_question": "allergy", "add_item": "add_order", "remove_item": "remove_order",
    "clear_order": "clear_order", "summarize_order": "summary", "confirm_order": "confirm_order", "unavailable_item": "unavailable_item", "off_topic": "fallback",
}
ORDER_INTENTS = ("add_item", "remove_item", "clear_order", "summarize_order", "confirm_order")


def reply_kind(intent: Column, mentioned: Column | None = None) -> Column:
    """The reply of a grounded intent; a menu question without a mention asks for the categories."""
    out = F.when(intent == "menu_question", F.when(F.lit(True) if mentioned is None else mentioned, "menu_detail").otherwise("ask_categories"))
    for name, kind in REPLY_OF.items():
        out = F.when(intent == name, kind).otherwise(out)
    return out


def order_states(messages: DataFrame, session: str, position: str, lines: DataFrame) -> DataFrame:
    """``messages`` with ``before`` and ``after``: the order's lines (name, quantity, price) around each message.

    messages: session, position (1, 2, ... in a session), op (clear or other). lines: the operations on items, (session,
    position, item, op, qty, price, place). A step on an item holds from its message to the next step on the item, or to
    the next clear; it is laid out over these messages, so the rows made are the lines of the states themselves. Lines
    stand in the order of ``place``.
    """
    clears = messages.filter("op = 'clear'").select(session, position, F.lit(None).cast(lines.schema["item"].dataType).alias("item"), F.lit("clear").alias("op"), F.lit(0).alias("qty"))
    ops = lines.select(session, position, "item", "op", F.col("qty").cast("int").alias("qty")).unionByName(clears)
    steps = fold_steps(ops, session, "item", "op", "qty", [position])
    ahead = Window.partitionBy(session).orderBy(position).rangeBetween(1, Window.unboundedFollowing)
    steps = steps.withColumn("__clear", F.min(F.when(F.col("op") == "clear", F.col(position))).over(ahead))
    same = Window.partitionBy(session, "item", "__cleared").orderBy(position)
    steps = steps.filter("op <> 'clear'").withColumn("__next", F.lead(position).over(same))
    ends = messages.groupBy(session).agg((F.max(position) + 1).alias("__end"))
    held = steps.join(ends, session).withColumn("__to", F.least("__next", "__clear", "__end")).filter("after > 0 and __to > " + position)
    known = lines.groupBy(session, "item").agg(F.min("price").alias("price"), F.min("place").alias("place"))
    laid = held.select(session, "item", F.col("after").alias("quantity"), F.explode(F.sequence(F.col(position), F.col("__to") - 1)).alias(position)).join(known, [session, "item"])
    states = laid.groupBy(session, position).agg(F.array_sort(F.collect_list(F.struct("place", F.col("item").alias("name"), "quantity", "price"))).alias("__s"))
    out = messages.join(states, [session, position], "left").withColumn("after", F.transform(F.coalesce("__s", F.array().cast(states.schema["__s"].dataType)), lambda x: F.struct(x["name"].alias("name"), x["quantity"].alias("quantity"), x["price"].alias("price"))))
    return out.withColumn("before", F.coalesce(F.lag("after").over(Window.partitionBy(session).orderBy(position)), F.slice("after", 1, 0))).drop("__s")


def order_text(lines: Column, total: Column) -> Column:
    """One line an item (:func:`J.priced`), and the total; null for an empty order."""
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    line = lambda o: F.concat(shown(o["quantity"]), F.lit(" x "), shown(o["name"]), F.lit(" = "), shown(o["sum"]), F.lit(" TL"))
    return F.when(F.size(lines) > 0, F.concat(F.array_join(F.transform(lines, line), "\n"), F.format_string("\nToplam: %.2f TL", total)))


def ground_messages(messages: DataFrame, dim: DataFrame, session: str, order: Sequence[str], text: str = "text", unavailable: Mapping[str, str] | Sequence[str] = (), markers: Sequence[str] = (), demo: bool = True, source: str = "menu", **reply) -> DataFrame:
    """``messages`` with the whole grounded result of each.

    dim: item, name, price, position. Added columns: position in the session, mentions, quantity of each mention,
    unavailable names, intent (13 of them), before and after (the order), total, canonical (the reply), must_preserve,
    must_not_introduce, must_include, forbidden_claims, staff, order_terms, and errors of the result. Adding, removing and clearing
    change the order of the session, in the order of ``order``. ``reply``: facts for the reply texts.
    """
    found = J.surfaces(dim.withColumn("item_id", F.col("name"))).join(dim.select(F.col("name").alias("item"), "price"), "item")
    placed = checkpointed(messages.withColumn("position", F.row_number().over(Window.partitionBy(session).orderBy(*order))))  # read for texts, lines, clears and ends
    has = F.size("mentions") > 0

    def read(texts: DataFrame) -> DataFrame:
        t = J.with_mentions(texts, found, [text], text, carry=("price",))
        t = t.withColumn("quantities", F.transform("mentions", lambda x: J.extract_quantity(F.col(text), x["item"])))
        t = t.withColumn("__named", J.unavailable_terms(F.col(text), has, unavailable, markers))
        t = t.withColumn("intent", J.grounded_intent(F.col(text), has, F.col("__named")))
        t = t.withColumn("unavailable", J.unavailable_names(F.col("intent"), F.col(text), has, unavailable)).drop("__named")
        return t.withColumn("op", F.when(F.col("intent") == "clear_order", "clear"))

    m = J.per_text(placed, text, read)
    lines = m.filter(F.col("intent").isin("add_item", "remove_item")).select(session, "position", F.when(F.col("intent") == "add_item", "add").otherwise("remove").alias("op"), F.explode(F.arrays_zip("mentions", "quantities")).alias("x"))
    lines = lines.select(session, "position", "op", F.col("x.mentions.item").alias("item"), F.col("x.quantities").alias("qty"), F.col("x.mentions.price").alias("price"), F.col("x.mentions.position").alias("place"))
    s = order_states(m, session, "position", lines).drop("op")
    sum_of = F.aggregate("after", F.lit(0.0), lambda acc, o: acc + o["price"] * o["quantity"])
    s = s.withColumn("total", F.when(F.col("intent").isin(*ORDER_INTENTS), sum_of)).withColumn("__lines", J.priced(F.col("after")))
    first = F.get("mentions", F.lit(0))
    said = J.render_reply(reply_kind(F.col("intent"), has), F.when(F.col("intent") == "unavailable_item", F.get("unavailable", F.lit(0))).otherwise(first["item"]), first["price"], F.get("quantities", F.lit(0)), summary=order_text(F.col("__lines"), F.col("total")), **reply)
    s = s.withColumn("canonical", said)
    matched = F.transform("mentions", lambda x: F.struct(x["item"].alias("name"), x["price"].alias("price")))
    s = s.withColumn("__t", J.grounding_terms(F.col("intent"), F.col("canonical"), matched, F.col("before"), F.col("__lines"), F.col("unavailable"), texts=True)).select("*", "__t.*")
    s = s.withColumn("order_terms", J.order_terms(F.col("__lines"), F.col("total"), texts=True)).drop("__t", "__lines")
    is_demo = F.lit(demo) & F.contains(F.col("canonical"), F.lit("MVP/demo"))
    return s.withColumn("errors", J.grounded_errors(F.col("intent"), F.col(text), F.lit(1.0), F.col("canonical"), F.col("total"), F.lit(source), F.col("must_include"), F.col("must_preserve"), is_demo))


def answered(results: DataFrame, paraphrase: Column, allowed: Column | None = None) -> DataFrame:
    """``results`` of :func:`ground_messages` with reasons against the paraphrase, and the final text: the paraphrase where it is safe, else the canonical."""
    required = F.concat("must_preserve", "must_include", F.when(F.col("total").isNotNull(), F.col("order_terms")).otherwise(F.array().cast("array<string>")))
    reasons = J.paraphrase_errors(F.col("errors"), paraphrase, F.col("canonical"), required, F.concat("must_not_introduce", "forbidden_claims"), F.lit(True) if allowed is None else allowed)
    with_reasons = results.withColumn("paraphrase", paraphrase).withColumn("reasons", reasons)
    return with_reasons.withColumn("__f", sft.final_response(F.col("canonical"), F.col("paraphrase"), F.col("reasons"))).select("*", F.col("__f.text").alias("final"), F.col("__f.used_paraphrase").alias("used_paraphrase")).drop("__f")
