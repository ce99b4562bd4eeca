"""Grounding messages in a dimension table: mentions, quantities, prices, intents, replies and safety terms."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.functions import presets
from weftwork.functions.text import contains_any, fold, missing_terms, name_list, once, ordered_distinct, present_terms
from weftwork.operators.ranking import checkpointed, global_rank
from weftwork.operators.rules import Rule, first_match

#: So many surfaces are looked for one by one, in a projection.
FEW_SURFACES = 128
#: Surfaces beyond this many are not broadcast.
MOST_SURFACES = 50_000
#: Surfaces that more rows could hold are dealt out with a salt.
HEAVY_ROWS = 1_000_000
#: Characters of the keys by which texts and surfaces meet.
GRAM = 4


def small(df: DataFrame, most: int = MOST_SURFACES) -> DataFrame:
    """``df`` with a hint to broadcast it if it has at most ``most`` rows (counted); otherwise as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def per_text(rows: DataFrame, text: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with the columns that ``work`` adds to the table of their distinct texts, so that a repeated text is worked on once.

    Few distinct texts (counted) are broadcast, so that a very common one is not shuffled; more are joined by shuffle.
    """
    done = checkpointed(work(rows.select(text).distinct()))
    return rows.join(small(done.withColumnRenamed(text, "__of")), F.col(text).eqNullSafe(F.col("__of"))).drop("__of")


def surfaces(dim: DataFrame, item: str = "item_id", name: str = "name", aliases: str | None = None, position: str = "position") -> DataFrame:
    """(item, position, surface): folded names and aliases."""
    names = F.array(F.col(name)) if aliases is None else F.concat(F.array(F.col(name)), F.coalesce(F.col(aliases), F.array().cast("array<string>")))
    return dim.select(F.col(item).alias("item"), F.col(position).alias("position"), F.explode(F.array_distinct(F.transform(names, fold))).alias("surface")).filter("surface <> ''")


def with_mentions(texts: DataFrame, found: DataFrame, id_cols: Sequence[str], text: str = "text", name: str = "mentions", few: int = FEW_SURFACES, carry: Sequence[str] = ()) -> DataFrame:
    """``texts`` with the items whose surface the folded text contains: an array of (position, item, carry), by position, once an item.

    Few surfaces (counted) are one constant array, so that nothing is shuffled; more take the way of :func:`containing`
    and come back by ``id_cols``. ``carry``: more columns of ``found``.
    """
    own = ["position", "item", *carry]
    none = F.array().cast(f"array<struct<{','.join(f'{c}:{found.schema[c].dataType.simpleString()}' for c in own)}>>")
    constant = _constant(found.select(*own, "surface"), few)
    if constant is not None:
        hits = F.array_sort(F.transform(constant.held(F.col("__t")), lambda s: F.struct(*[s[c].alias(c) for c in own])))
        first = lambda m: F.filter(m, lambda x, i: F.array_position(F.transform(m, lambda y: y["item"]), x["item"]) == i + 1)
        folded = texts.withColumn("__t", fold(F.col(text)))  # a column of its own, so that the tests are compiled
        return folded.withColumn(name, F.coalesce(once(hits, first), none)).drop("__t")
    folded = texts.select(*id_cols, fold(F.col(text)).alias("__t"))
    each = containing(folded, found, few).groupBy(*id_cols, "item").agg(F.min(F.struct("position", *carry)).alias("__m"))
    by_id = each.groupBy(*id_cols).agg(F.array_sort(F.collect_list(F.struct(F.col("__m.position").alias("position"), "item", *[F.col(f"__m.{c}").alias(c) for c in carry]))).alias(name))
    return texts.join(by_id, list(id_cols), "left").withColumn(name, F.coalesce(F.col(name), none))


class _Constant:
    """Rows as an array of structs, and the tests of a text for each row's surface, one after the other, as one expression."""

    def __init__(self, rows: Sequence, schema: T.StructType) -> None:
        self.surfaces = [r["surface"] for r in rows]
        self.rows = F.from_json(F.lit(json.dumps([r.asDict() for r in rows])), T.ArrayType(schema))  # folded into one literal

    def held(self, text: Column) -> Column:
        """The rows whose surface ``text`` (a column) contains."""
        places = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(s)), F.lit(i)) for i, s in enumerate(self.surfaces)])) if self.surfaces else F.array().cast("array<int>")
        return F.transform(places, lambda i: F.get(self.rows, i))


def _constant(found: DataFrame, few: int) -> _Constant | None:
    """The rows of ``found``, if there are at most ``few``."""
    rows = found.limit(few + 1).collect()
    return _Constant(rows, found.schema) if len(rows) <= few else None


def mention_join(texts: DataFrame, found: DataFrame, id_cols: Sequence[str], text: str = "text", few: int = FEW_SURFACES) -> DataFrame:
    """(ids, item, position) for each item with a surface that is a substring of the folded text, once an item."""
    folded = texts.select(*id_cols, fold(F.col(text)).alias("__t"))
    return containing(folded, found, few).groupBy(*id_cols, "item").agg(F.min("position").alias("position"))


def containing(folded: DataFrame, found: DataFrame, few: int = FEW_SURFACES, most: int = MOST_SURFACES, heavy: int = HEAVY_ROWS) -> DataFrame:
    """Rows of ``folded`` (text: __t) with those of ``found`` whose surface, not empty, the text contains.

    Few surfaces (counted) are looked for in a projection. More meet the texts by a gram of four characters (a shorter
    surface by itself): each surface is keyed by its gram that the fewest texts hold, all texts being counted, so that a
    text is tried on those surfaces only whose rarest gram it holds. Up to ``most`` keyed surfaces are broadcast; more
    are joined by shuffle, and a gram that more than ``heavy`` texts hold is spread by a salt. None is left out.
    """
    constant = _constant(found, few)
    if constant is not None:
        return folded.withColumn("__f", F.explode(constant.held(F.col("__t")))).select(*folded.columns, "__f.*")
    lengths = sorted(r[0] for r in found.select(F.least(F.length("surface"), F.lit(GRAM))).distinct().collect())  # 1 to 4
    texts = folded.withColumn("__g", F.explode(F.array_distinct(F.flatten(F.array(*[_grams(F.col("__t"), n) for n in lengths])))))
    held = texts.groupBy("__g").agg(F.count("*").alias("__c"))
    own = F.when(F.length("surface") < GRAM, F.array("surface")).otherwise(_grams(F.col("surface"), GRAM))
    keys = found.select("surface").distinct().withColumn("__g", F.explode(F.array_distinct(own))).join(held, "__g").groupBy("surface").agg(F.min(F.struct("__c", "__g")).alias("__k"))
    keyed = checkpointed(found.join(keys.select("surface", "__k.__g", "__k.__c"), "surface"))
    if keyed.limit(most + 1).count() <= most:
        return texts.join(F.broadcast(keyed.drop("__c")), "__g").filter(F.col("__t").contains(F.col("surface"))).drop("__g")
    salts = F.ceil(F.col("__c") / heavy).cast("int")
    spread = keyed.filter(F.col("__c") > heavy).select("__g", salts.alias("__n")).distinct()
    salted = texts.join(small(spread), "__g", "left").withColumn("__s", F.coalesce(F.pmod(F.xxhash64(*folded.columns), F.col("__n")), F.lit(0)).cast("int")).drop("__n")
    copies = keyed.withColumn("__s", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1))).drop("__c")
    return salted.join(copies, ["__g", "__s"]).filter(F.col("__t").contains(F.col("surface"))).drop("__g", "__s")


def _grams(text: Column, n: int) -> Column:
    """All substrings of ``n`` characters."""
    last = F.length(text) - (n - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, n))).otherwise(F.array().cast("array<string>"))


def first_mention(mentions: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """The mentioned item with the lowest dimension position."""
    return mentions.groupBy(*id_cols).agg(F.min_by("item", "position").alias("item"), F.min("position").alias("position"))


def lookup(queries: DataFrame, dim: DataFrame, query: str, name: str, alias: DataFrame | None = None) -> DataFrame:
    """``queries`` with the dimension's item of the exact folded name, else of an alias (alias: item, surface)."""
    by_name = dim.select(F.col("item").alias("by_name"), fold(F.col(name)).alias("__k")).dropDuplicates(["__k"])
    out = queries.withColumn("__k", fold(F.col(query))).join(by_name, "__k", "left")
    if alias is None:
        return out.withColumnRenamed("by_name", "item").drop("__k")
    by_alias = alias.groupBy(F.col("surface").alias("__k")).agg(F.min("item").alias("by_alias"))
    return out.join(by_alias, "__k", "left").withColumn("item", F.coalesce("by_name", "by_alias")).drop("__k", "by_name", "by_alias")


def require_member(df: DataFrame, dim: DataFrame, col: str, dim_col: str, member: bool = True) -> DataFrame:
    """Rows whose folded value is (or is not) in the dimension."""
    keys = dim.select(fold(F.col(dim_col)).alias("__k")).distinct()
    return df.withColumn("__k", fold(F.col(col))).join(keys, "__k", "left_semi" if member else "left_anti").drop("__k")


def extract_quantity(text: Column, surface: Column) -> Column:
    """A number (digits or a word) next to the surface: before it, after it with a unit, right after it, anywhere with a unit; else 1."""
    marked = lambda x: F.struct(x["t"].alias("t"), F.replace(x["t"], x["s"], F.lit(_MARK)).alias("m"))
    return once(once(F.struct(fold(text).alias("t"), fold(surface).alias("s")), marked), lambda x: _quantity(x["t"], x["m"]))


#: Stands for the surface, so that the patterns are constant and compiled once.
_MARK = "\x01"


def _quantity(t: Column, m: Column) -> Column:
    number, unit = r"(\d+|bir|iki|uc|dort|bes)", r"\s*(?:x|adet|tane)"
    patterns = [(m, number + unit + r"?\s*" + _MARK), (m, _MARK + r".*?" + number + unit), (m, _MARK + r"\s*" + number), (t, number + unit)]
    found = F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for c, p in patterns])
    words = F.create_map(*[F.lit(x) for kv in presets.NUMBER_WORDS.items() for x in kv])
    return F.coalesce(F.try_element_at(words, found), found.try_cast("int"), F.lit(1))


def reply_intent(text: Column, has_item: Column) -> Column:
    """The reply cascade: intents without a mention first, then add, update, price, ingredients, detail; else fallback."""
    return once(fold(F.trim(text)), lambda t: _reply_intent(t, has_item))


def _reply_intent(t: Column, has_item: Column) -> Column:
    add = (has_item & t.contains("daha")) | (has_item & t.rlike(presets.NUMBER)) | t.rlike(presets.ADD_WORDS)
    later = [
        (add, "add_order"),
        (contains_any(t, ("adet", "tane")), "update_order"),
        (has_item & contains_any(t, presets.PRICE_ASKS), "ask_price"),
        (has_item & contains_any(t, presets.INGREDIENT_ASKS), "ask_ingredient"),
        (has_item | contains_any(t, presets.DETAIL_ASKS), "menu_detail"),
    ]
    rest = F.lit("fallback")
    for condition, name in reversed(later):
        rest = F.when(condition, name).otherwise(rest)
    before = first_match(t, presets.REPLY_BEFORE_MENTION, None)
    return F.when(F.coalesce(t, F.lit("")) == "", "empty").otherwise(F.coalesce(before, rest))


def grounded_intent(text: Column, has_item: Column, unavailable: Column) -> Column:
    """The grounding cascade, with 13 outcomes: questions about the house first, then allergy, the order, the menu."""
    return once(fold(F.trim(text)), lambda t: _grounded_intent(t, has_item, unavailable))


def _grounded_intent(t: Column, has_item: Column, unavailable: Column) -> Column:
    of = {r.label: r for r in presets.REPLY_BEFORE_MENTION}
    named = (("greeting", "greeting"), ("ask_hours", "restaurant_info"), ("restaurant_info", "restaurant_info"), ("recommendation", "recommendation"), ("allergy", "allergen_question"), ("confirm_order", "confirm_order"), ("summary", "summarize_order"), ("clear_order", "clear_order"), ("remove_order", "remove_item"))
    steps = [(of[rule].test(t), intent) for rule, intent in named]
    add = (has_item & t.contains("daha")) | (has_item & t.rlike(presets.NUMBER)) | t.rlike(presets.ADD_WORDS)
    steps += [(F.size(unavailable) > 0, "unavailable_item"), (add, "add_item"), (of["ask_categories"].test(t), "menu_question"), (has_item & contains_any(t, presets.PRICE_ASKS), "price_question"), (has_item | contains_any(t, presets.DETAIL_ASKS), "menu_question")]
    out = F.lit("off_topic")
    for condition, name in reversed(steps):
        out = F.when(condition, name).otherwise(out)
    return out


def eval_intent(text: Column, has_item: Column) -> Column:
    """The evaluation cascade: thanks, hours and update before add."""
    return once(fold(F.trim(text)), lambda t: _eval_intent(t, has_item))


def _eval_intent(t: Column, has_item: Column) -> Column:
    order = ("greeting", "thanks", "ask_hours", "allergy", "recommendation", "ask_categories", "confirm_order", "summary", "clear_order", "remove_order")
    of = {r.label: r for r in presets.REPLY_BEFORE_MENTION}
    steps = [(of[k].test(t), k) for k in order]
    steps += [(has_item & contains_any(t, ("adet", "tane")), "update_order"), ((has_item & t.rlike(presets.NUMBER)) | t.rlike(presets.ADD_WORDS), "add_order"), (has_item & contains_any(t, presets.PRICE_ASKS), "ask_price"), (has_item, "menu_detail")]
    out = F.lit("fallback")
    for condition, name in reversed(steps):
        out = F.when(condition, name).otherwise(out)
    return out


def _named(t: Column, terms: Mapping[str, str] | Sequence[str]) -> Column:
    """Display names of the terms that the folded text holds, in the terms' order, once each."""
    pairs = terms.items() if isinstance(terms, Mapping) else [(x, x) for x in terms]
    return F.array_distinct(F.array_compact(F.array(*[F.when(t.contains(fold(F.lit(x))), F.lit(shown)) for x, shown in pairs])))


def unavailable_terms(text: Column, has_item: Column, terms: Mapping[str, str] | Sequence[str], markers: Sequence[str]) -> Column:
    """Names of known unavailable things in a request (a marker) without a mention; empty where it is no such request.

    ``terms`` are folded terms, or terms with the names to show.
    """
    return once(fold(text), lambda t: F.when(~has_item & contains_any(t, markers), _named(t, terms)).otherwise(F.array().cast("array<string>")))


def unavailable_names(intent: Column, text: Column, has_item: Column, terms: Mapping[str, str] | Sequence[str], unknown: str = "Bilinmeyen ürün") -> Column:
    """What a row of the intent ``unavailable_item`` asks for: the known things it names, else (without a mention) ``unknown``."""
    named = once(fold(text), lambda t: _named(t, terms))
    none = F.array().cast("array<string>")
    return F.when(intent != "unavailable_item", none).when((F.size(named) == 0) & ~has_item, F.array(F.lit(unknown))).otherwise(named)


def extract_category(texts: DataFrame, categories: DataFrame, id_cols: Sequence[str], text: str = "text", aliases: Sequence[str] = presets.MAIN_DISH_ALIASES, alias_of: str = presets.MAIN_DISH) -> DataFrame:
    """``id_cols`` and the first category (in name order) whose folded name the text contains.

    A text without one that holds one of ``aliases`` has the category whose folded name is ``alias_of``, if there is
    one; other texts have no row.
    """
    named = categories.select("category", fold(F.col("category")).alias("surface")).filter("surface <> ''")
    folded = texts.select(*id_cols, fold(F.col(text)).alias("__t"))
    hits = containing(folded, named).select(*id_cols, "category", F.lit(0).alias("__n"))
    other = named.filter(F.col("surface") == alias_of).groupBy("surface").agg(F.min("category").alias("__other"))
    aliased = folded.filter(contains_any(F.col("__t"), aliases)).withColumn("surface", F.lit(alias_of)).join(F.broadcast(other), "surface")  # one row
    both = hits.unionByName(aliased.select(*id_cols, F.col("__other").alias("category"), F.lit(1).alias("__n")))
    return both.groupBy(*id_cols).agg(F.min(F.struct("__n", "category")).alias("__c")).select(*id_cols, F.col("__c.category").alias("category"))


def route_parsed(df: DataFrame, dim: DataFrame, intent: Column, confidence: Column, item: str, dim_col: str, threshold: float = 0.6) -> DataFrame:
    """``df`` with route: off_topic, unsupported, low_confidence, unknown_item or pass."""
    keys = dim.select(fold(F.col(dim_col)).alias("__k"), F.lit(True).alias("__known")).distinct()
    joined = df.withColumn("__k", fold(F.col(item))).join(keys, "__k", "left")
    route = F.when(intent == "off_topic", "off_topic").when(intent == "unsupported", "unsupported").when(confidence < threshold, "low_confidence").when(F.col("__k").isNotNull() & F.col("__known").isNull(), "unknown_item").otherwise("pass")
    return joined.withColumn("route", route).drop("__k", "__known")


def extract_terms(name: Column, text: Column, cautions: Sequence[str] = (), rejections: Sequence[str] = ()) -> Column:
    """Terms a paraphrase must keep: the name if it occurs, all prices, cautions, the first quantity, rejections; once each."""
    pick = lambda words: [F.when(text.contains(w), F.lit(w)) for w in words]
    one = F.array(F.when(F.contains(text, name), name))
    prices = F.regexp_extract_all(text, F.lit(r"\d+\.\d{2}\s*TL"), F.lit(0))
    quantity = F.array(F.nullif(F.regexp_extract(text, r"\d+\s*x\s*\p{L}+", 0), F.lit("")))
    return ordered_distinct(F.array_compact(F.concat(one, prices, F.array(*pick(cautions)) if cautions else F.array().cast("array<string>"), quantity, F.array(*pick(rejections)) if rejections else F.array().cast("array<string>"))))


#: Prices in terms.
PRICE = "%.2f"


def money(c: Column) -> Column:
    """An amount as terms have it; null for none."""
    return F.when(c.isNotNull(), F.format_string(PRICE, c))


def priced(items: Column) -> Column:
    """An order's lines (name, quantity, price) with ``unit`` and ``sum``, their amounts as texts, which are dear to make."""
    return F.transform(items, lambda o: F.struct(o["name"].alias("name"), o["quantity"].alias("quantity"), o["price"].alias("price"), money(o["price"]).alias("unit"), money(o["price"] * o["quantity"]).alias("sum")))


def _texts(*cols: Column) -> Column:
    return F.array(*cols) if cols else F.array().cast("array<string>")


def _by_intent(intent: Column, table: Mapping[str, Column]) -> Column:
    out = _texts()
    for name, value in table.items():
        out = F.when(intent == name, value).otherwise(out)
    return out


def grounding_terms(intent: Column, canonical: Column, matched: Column, before: Column, after: Column, unavailable: Column, offered: Column | None = None, markers: Sequence[str] = presets.INFO_MARKERS, texts: bool = False) -> Column:
    """Struct of must_preserve, must_not_introduce, must_include, forbidden_claims and staff, for all 13 intents.

    ``matched`` holds structs of name and price, ``before`` and ``after`` (the order) of name, quantity and price;
    ``after`` may be :func:`priced` (``texts``).
    ``offered`` names the items that a recommendation may name. must_include, forbidden_claims and staff are the safety
    part. Terms keep their first place; empty ones are left out.
    """
    lit = lambda *words: _texts(*[F.lit(w) for w in words])
    names = F.transform(matched, lambda m: m["name"])
    ordered = lambda items, total: F.flatten(F.transform(items, lambda o: F.array(o["name"], o["quantity"].cast("string"), F.format_string(PRICE, o["price"]), *([F.format_string(PRICE, o["price"] * o["quantity"])] if total else []))))
    bought = F.flatten(F.transform(after, lambda o: F.array(o["name"], o["quantity"].cast("string"), F.coalesce(o["unit"], F.lit("null")), F.coalesce(o["sum"], F.lit("null"))))) if texts else ordered(after, True)
    gone = F.filter(before, lambda o: ~F.exists(after, lambda x: x["name"] == o["name"]))
    some = F.size(after) > 0
    preserve = {
        "greeting": lit("Merhaba"),
        "restaurant_info": F.filter(lit(*markers), lambda m: F.contains(canonical, m)),
        "menu_question": F.when(F.contains(canonical, F.lit("Kategoriler")), lit("Kategoriler")).otherwise(lit("Kategori")),
        "recommendation": F.concat(lit("Öneri"), F.filter(offered if offered is not None else names, lambda n: F.contains(canonical, n))),
        "price_question": F.concat(lit("TL"), F.flatten(F.transform(matched, lambda m: F.array(m["name"], F.format_string(PRICE, m["price"]))))),
        "allergen_question": lit("Alerji", "teyit"),
        "add_item": F.concat(lit("Ekledim"), names, bought),
        "remove_item": F.concat(lit("Çıkardım"), names, ordered(gone, False)),
        "clear_order": lit("temizlendi"),
        "summarize_order": F.concat(F.when(some, lit("Toplam", "TL")).otherwise(_texts()), bought),
        "confirm_order": F.concat(F.when(some, lit("Toplam", "MVP/demo")).otherwise(lit("aktif bir siparişiniz görünmüyor", "Önce")), bought),
        "unavailable_item": F.concat(lit("bulunmuyor"), unavailable),
        "off_topic": lit("yardımcı olamıyorum"),
    }
    unsafe = lit("kesinlikle güvenli", "hiç sorun yok")
    avoid = {
        "unavailable_item": F.concat(unavailable, lit("eklendi", "fiyatı", "fiyati", "MVP/demo")),
        "off_topic": lit("şiir hazırladım", "şiir yazdım", "iste bir siir", "işte bir şiir"),
        "allergen_question": unsafe,
    }
    return F.struct(
        F.array_distinct(F.filter(_by_intent(intent, preserve), lambda t: t != "")).alias("must_preserve"),
        _by_intent(intent, avoid).alias("must_not_introduce"),
        _by_intent(intent, {"allergen_question": lit("Alerji", "teyit"), "off_topic": lit("yardımcı olamıyorum")}).alias("must_include"),
        _by_intent(intent, {"allergen_question": unsafe}).alias("forbidden_claims"),
        (intent == "allergen_question").alias("staff"),
    )


def grounded_errors(intent: Column, message: Column, confidence: Column, canonical: Column, total: Column, source: Column, must_include: Column, must_preserve: Column, demo: Column) -> Column:
    """All broken invariants of a grounded result, in order; empty if it is sound. Null texts are blank."""
    blank = lambda c: F.coalesce(c, F.lit("")).rlike(r"^[\s\x0B\x{85}\x{A0}\x{1C}-\x{1F}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*$")
    lacks = lambda terms, word: ~F.array_contains(terms, word)
    allergen = intent == "allergen_question"
    checks = [
        (~intent.isin(*presets.GROUNDED_INTENTS), F.concat(F.lit("unsupported intent: "), intent)),
        (blank(message), F.lit("empty message")),
        (confidence.isNotNull() & ~confidence.between(0.0, 1.0), F.lit("confidence outside 0 and 1")),
        (blank(canonical), F.lit("empty response")),
        (F.coalesce(total < 0, F.lit(False)), F.lit("negative total")),
        (blank(source), F.lit("empty menu source")),
        (allergen & lacks(must_include, "Alerji"), F.lit("allergen answer without Alerji")),
        (allergen & lacks(must_include, "teyit"), F.lit("allergen answer without teyit")),
        ((intent == "off_topic") & (F.size(must_include) == 0), F.lit("refusal without terms")),
        ((intent == "confirm_order") & demo & lacks(must_preserve, "MVP/demo"), F.lit("demo confirmation without MVP/demo")),
    ]
    return F.array_compact(F.array(*[F.when(condition, message) for condition, message in checks]))


def order_terms(items: Column, total: Column, texts: bool = False) -> Column:
    """What a paraphrase must keep of an order: names, quantities, unit prices and line totals of its lines, and the total.

    What a line does not have is left out. ``texts``: the items are :func:`priced`.
    """
    amounts = lambda o: (o["unit"], o["sum"]) if texts else (money(o["price"]), money(o["price"] * o["quantity"]))
    each = F.transform(items, lambda o: F.array(F.nullif(F.trim(o["name"]), F.lit("")), o["quantity"].cast("string"), *amounts(o)))
    return F.array_compact(F.concat(F.flatten(each), F.array(money(total))))


def paraphrase_errors(errors: Column, paraphrase: Column, canonical: Column, required: Column, forbidden: Column, allowed: Column) -> Column:
    """Why a paraphrase is unsafe: the result's own ``errors`` first and alone, then missing and forbidden terms, then a change that is not allowed."""
    said = lambda prefix, terms: F.transform(terms, lambda t: F.concat(F.lit(prefix), t))
    changed = F.when(~allowed & (fold(paraphrase) != fold(canonical)), _texts(F.lit("paraphrase not allowed"))).otherwise(_texts())
    later = F.concat(said("missing: ", missing_terms(paraphrase, required)), said("forbidden: ", present_terms(paraphrase, forbidden)), changed)
    return F.when(F.size(errors) > 0, errors).otherwise(later)


#: Where an item has no category.
NO_CATEGORY = "Diğer"


def context_document(dim: DataFrame, facts: Mapping[str, str | Sequence[str]] | None = None, name: str = "name", category: str = "category", price: str = "price", order: str = "position") -> DataFrame:
    """One row with a dimension as a text: its categories, a line a category with names and prices, a line a fact.

    Items stand in their order; one without a name is left out, one without a category goes to ``NO_CATEGORY``, one
    without a price has none. Facts with blank values are left out. The text is as large as the dimension.
    """
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    own = dim.filter(blank(name).isNotNull()).select(F.coalesce(blank(category), F.lit(NO_CATEGORY)).alias("c"), F.struct(F.col(order).alias("o"), F.concat(blank(name), F.coalesce(F.format_string(" (%.2f TL)", F.when(F.col(price).isNotNull(), F.col(price))), F.lit(""))).alias("t")).alias("i"), F.col(price).isNull().alias("free"), blank(name).alias("n"))
    own = own.withColumn("i", F.when(F.col("free"), F.struct(F.col("i.o").alias("o"), F.col("n").alias("t"))).otherwise(F.col("i")))
    lines = own.groupBy("c").agg(F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda x: x["t"]), ", ").alias("line"))
    each = lambda c: f"{c.strip()}" if isinstance(c, str) else ", ".join(x.strip() for x in c if x and x.strip())
    said = [F.lit(f"{label}: {each(v)}.") for label, v in (facts or {}).items() if v and each(v)]
    sorted_ = F.array_sort(F.collect_list(F.struct("c", "line")))
    head = F.concat(F.lit("Menü kategorileri: "), F.array_join(F.transform(sorted_, lambda x: x["c"]), ", "), F.lit("."))
    body = F.concat(F.array(head), F.transform(sorted_, lambda x: F.concat(x["c"], F.lit(": "), x["line"], F.lit("."))))
    none = F.array().cast("array<string>")
    return lines.agg(F.array_join(F.concat(F.when(F.count("*") > 0, body).otherwise(none), F.array(*said) if said else none), "\n").alias("document"))


def render_reply(intent: Column, name: Column, price: Column, quantity: Column, facts: Mapping[str, str] | None = None, category: Column | None = None, choices: Column | None = None, categories: Column | None = None, detail: Column | None = None, summary: Column | None = None, hours: str = "") -> Column:
    """A reply text for each intent of the reply cascade; what a text needs and does not have gives its question instead.

    ``choices`` are the names that a recommendation or a category offers, ``summary`` the order's text.
    """
    text = lambda c: F.lit(None).cast("string") if c is None else c
    several = choices if choices is not None else _texts()
    category, categories, detail, summary = text(category), categories if categories is not None else _texts(), text(detail), text(summary)
    missing = lambda topic: F.lit(f"{topic} bu demo ortamında tanımlı değildir. Menü veya siparişle ilgili yardımcı olabilirim.")
    line = F.format_string("%d x %s", quantity, name)
    more = F.lit(". Başka bir isteğiniz var mı?")
    replies = {
        "greeting": F.lit("Merhaba, hoş geldiniz."),
        "thanks": F.lit("Rica ederim, afiyet olsun."),
        "ask_hours": F.lit(f"Çalışma saatlerimiz: {hours}.") if hours else missing("Çalışma saatleri"),
        "restaurant_info": F.coalesce(text(F.lit((facts or {}).get("name")).cast("string")), missing("Bu bilgi")),
        "ask_categories": F.when(F.size(categories) > 0, F.concat(F.lit("Kategoriler: "), F.array_join(categories, ", "))).otherwise("Menüde böyle bir bilgi yok."),
        "recommendation": F.when(category.isNotNull() & (F.size(several) == 0), F.concat(category, F.lit(" için uygun bir önerim yok. Başka bir kategori belirtir misiniz?")))
        .when(category.isNotNull(), F.concat(category, F.lit(" olarak "), name_list(several), F.lit(" önerebilirim.")))
        .when(F.size(several) > 0, F.concat(F.lit("Öneri olarak şunları sunabilirim: "), F.array_join(several, ", "), F.lit(".")))
        .otherwise("Size uygun bir önerim yok. Bir kategori belirtir misiniz?"),
        "allergy": F.when(name.isNotNull(), F.concat(name, F.lit(" için kayıtlı alerjen bilgisini mutfakla teyit edebilirim."))).otherwise("Alerji konusunda mutfakla teyit edebilirim."),
        "ask_price": F.when(name.isNotNull(), F.format_string("%s %.2f TL.", name, price)),
        "ask_ingredient": F.when(name.isNotNull(), F.concat(name, F.lit(": "), F.coalesce(detail, F.lit("İçerik bilgisi bulunamadı.")))),
        "menu_detail": F.when(name.isNotNull(), F.concat(name, F.lit(": "), F.coalesce(F.concat(detail, F.lit(" ")), F.lit("")), F.format_string("Fiyat: %.2f TL.", price))),
        "add_order": F.when(name.isNotNull(), F.concat(F.lit("Ekledim: "), line, more)).otherwise("Siparişe eklemek istediğiniz ürünü yazar mısınız?"),
        "update_order": F.when(name.isNotNull(), F.concat(F.lit("Güncelledim: "), line, more)).otherwise("Hangi ürünün miktarını güncellemek istersiniz?"),
        "remove_order": F.when(name.isNotNull(), F.concat(F.lit("Çıkardım: "), name, more)).otherwise("Hangi ürünü çıkarmak istersiniz?"),
        "clear_order": F.lit("Siparişiniz temizlendi."),
        "summary": F.coalesce(summary, F.lit("Siparişinizde henüz ürün yok.")),
        "confirm_order": F.coalesce(F.concat(F.lit("Siparişinizi onaylıyorum.\n"), summary, F.lit("\nNot: Bu yalnızca MVP/demo onayıdır; gerçek restoran gönderimi yapılmaz.")), F.lit("Onaylanacak aktif bir siparişiniz görünmüyor. Önce siparişinize bir ürün ekleyebilir misiniz?")),
        "unavailable_item": F.concat(F.coalesce(name, F.lit("Bu ürün")), F.lit(" menümüzde bulunmuyor.")),
        "empty": F.lit("Sizi duyamadım, tekrar eder misiniz?"),
    }
    out = F.lit("Bu konuda yardımcı olamıyorum. Menü veya siparişle ilgili sorabilir misiniz?")
    for key, value in replies.items():
        out = F.when((intent == key) & value.isNotNull(), value).otherwise(out)
    return out


def ack_text(name: Column, uncertain: Column) -> Column:
    """An acknowledgement; where ``uncertain`` holds, one that promises to ask the kitchen."""
    return F.concat(name, F.when(uncertain, " için mutfağa sorup bilgi vereyim.").otherwise(" için isteğinizi aldım."))


def parsed(df: DataFrame, parser: Callable[[DataFrame], DataFrame], fields: Sequence[str] = ("intent", "confidence")) -> DataFrame:
    """``df`` through a pluggable parser, which must return all columns of ``df`` and ``fields``."""
    out = parser(df)
    lost = [c for c in (*df.columns, *fields) if c not in out.columns]
    if lost:
        raise ValueError(f"the parser's rows lack {lost}")
    return out


def route_info(text: Column, facts: dict[str, str], topics: Sequence[Rule] = presets.INFO_TOPICS, missing: str = "Bu bilgi elimde yok.", mode: str = "substring") -> Column:
    """Struct of topic and answer; a topic without a fact has the missing text; no topic: null. ``mode``: how phrases occur (``contains_any``)."""
    topic = first_match(fold(text), topics, None, mode)
    table = F.create_map(*[F.lit(x) for kv in facts.items() for x in kv])
    return F.struct(topic.alias("topic"), F.when(topic.isNotNull(), F.coalesce(F.try_element_at(table, topic), F.lit(missing))).alias("answer"))


def round_robin_join(generated: DataFrame, sources: DataFrame, bucket: str, gen_order: Sequence[Column], src_order: Sequence[Column], fallback: str = "all") -> DataFrame:
    """The k-th generated row of a bucket takes source k mod n of that bucket, or of ``fallback`` when it has none."""
    g = _place(generated, bucket, gen_order, "__k")
    s = _place(sources, bucket, src_order, "__i").withColumnRenamed(bucket, "__b")
    sizes = F.broadcast(s.groupBy("__b").agg(F.count("*").alias("__n")))  # one row a bucket of the rule table
    own = g.join(sizes, g[bucket] == F.col("__b"), "left").withColumn("__use", F.when(F.col("__n").isNotNull(), F.col(bucket)).otherwise(fallback)).drop("__b", "__n")
    sized = own.join(sizes, F.col("__use") == F.col("__b")).withColumn("__i", F.pmod("__k", "__n")).drop("__b", "__n")
    return sized.join(s, (F.col("__use") == s["__b"]) & (sized["__i"] == s["__i"])).drop("__k", "__i", "__b", "__use")


def _place(df: DataFrame, bucket: str, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with the 0-based place of each row in its bucket, by exact global ranks: a bucket is never one task."""
    ranked = global_rank(df, F.col(bucket).asc_nulls_first(), *order, name="__rank")
    first = ranked.groupBy(F.col(bucket).alias("__of")).agg(F.min("__rank").alias("__first"))  # one row a bucket of the rule table
    return ranked.join(F.broadcast(first), F.col(bucket).eqNullSafe(F.col("__of"))).withColumn(name, F.col("__rank") - F.col("__first")).drop("__rank", "__of", "__first")


def expand_templates(patterns: DataFrame, *dims: DataFrame) -> DataFrame:
    """Every pattern with every value of the dimensions, in nesting order of their ordinals; dimensions of a checked size are broadcast."""
    return reduce(lambda a, b: a.crossJoin(small(b)), dims, patterns)


def shifted_pairs(items: DataFrame, position: str, n: int, shift: int = 5) -> DataFrame:
    """Each item with the item ``shift`` places on, around the end."""
    other = items.select(*[F.col(c).alias(f"other_{c}") for c in items.columns])
    return items.join(other, F.pmod(F.col(position) + shift, F.lit(n)) == F.col(f"other_{position}"))
