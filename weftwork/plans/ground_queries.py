"""Grounding, orders, evaluation and streams over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions import presets, text as X
from weftwork.operators import evaluate as E
from weftwork.operators import gates as G
from weftwork.operators import grounding as J
from weftwork.operators import orders as O
from weftwork.operators import selection as S
from weftwork.operators.rules import Rule, first_match
from weftwork.plans.base import ITEMS, OPS, UTT, Registry, conversations, folded, items, operations, table, users, utterances
from weftwork.plans.rule_queries import _CASE, RULES
from weftwork.streaming import jobs

R = Registry()
IDS = ["l_orderkey", "l_linenumber"]

_MENTIONS = f"with u as ({UTT}), i as ({ITEMS}) select distinct l_orderkey, l_linenumber, i.name as item, i.position from u join i on contains({folded('u.text')}, {folded('i.name')})"


def _mentions(spark, d):
    return J.mention_join(utterances(spark, d), J.surfaces(items(spark, d)), IDS)


@R.add(_MENTIONS)
def mention_join(spark: SparkSession, d: str) -> DataFrame:
    return _mentions(spark, d)


@R.add(f"select l_orderkey, l_linenumber, arg_min(item, position) as item from ({_MENTIONS}) group by 1, 2")
def first_mention(spark: SparkSession, d: str) -> DataFrame:
    return J.first_mention(_mentions(spark, d), IDS).drop("position")


@R.add(f"select l_orderkey, l_linenumber, cast(regexp_extract(text, '^[0-9]+') as int) as quantity from ({UTT})")
def extract_quantity(spark: SparkSession, d: str) -> DataFrame:
    return utterances(spark, d).select(*IDS, J.extract_quantity(F.col("text"), F.col("p_name")).alias("quantity"))


def _with_item(spark, d):
    """Utterances with the first item that they mention."""
    u = J.with_mentions(utterances(spark, d), J.surfaces(items(spark, d)), IDS)
    return u.withColumn("mentioned", F.get("mentions", F.lit(0))["item"])


_HAS = f"with m as ({_MENTIONS}), f as (select l_orderkey, l_linenumber, arg_min(item, position) as mentioned from m group by 1, 2), x as (select u.*, mentioned, {folded('u.text')} as t from ({UTT}) u left join f using (l_orderkey, l_linenumber))"
_ADD = "(mentioned is not null and regexp_matches(t, '\\b(?:[0-9]+|bir|iki|uc|dort|bes)\\b')) or regexp_matches(t, '\\b(?:istiyorum|alabilir|siparis|ekle|isterim|alayim)\\b')"
_BEFORE = "case when contains(t, 'sil') or contains(t, 'cikar') or contains(t, 'iptal') then 'remove_order' when contains(t, 'toplam') or contains(t, 'ozet') then 'summary'"


@R.add(f"{_HAS} select l_orderkey, l_linenumber, {_BEFORE} when {_ADD} then 'add_order' else 'other' end as intent from x")
def intent_reply(spark: SparkSession, d: str) -> DataFrame:
    u = _with_item(spark, d)
    return u.select(*IDS, J.reply_intent(F.col("text"), F.col("mentioned").isNotNull()).alias("intent"))


#: What is said to reach each outcome of the grounding cascade; {} is an item.
_SAID = ("Merhaba {}", "{} kaçta açılıyorsunuz çalışma saatleri", "Restoranın adı ne", "Ne önerirsin {}", "{} glutensiz mi", "Siparişi onayla", "Özet lütfen", "Hepsini temizle", "{} çıkar", "Pizza var mı", "2 {} alabilir miyim", "Menüde neler var", "{} ne kadar", "{} güzel", "Bir şiir yaz")
_SAYS = "case l_orderkey % 15 " + " ".join(f"when {i} then " + " || ".join(["'" + part + "'" for part in [said.split("{}")[0]]] + (["p_name || '" + said.split("{}")[1] + "'"] if "{}" in said else [])) for i, said in enumerate(_SAID)) + " end"
_GROUND = " ".join(f"when {test} then '{intent}'" for test, intent in [
    ("contains(t, 'merhaba')", "greeting"), ("contains(t, 'calisma saatleri') or contains(t, 'restoranin adi')", "restaurant_info"), ("regexp_matches(t, '(?:^|\\s)(?:oner|tavsiye)')", "recommendation"), ("contains(t, 'gluten')", "allergen_question"), ("contains(t, 'siparisi onayla')", "confirm_order"),
    ("contains(t, 'ozet') or contains(t, 'toplam')", "summarize_order"), ("contains(t, 'temizle')", "clear_order"), ("contains(t, 'iptal') or contains(t, 'cikar') or contains(t, 'sil')", "remove_item"), ("mentioned is null and contains(t, 'pizza') and contains(t, 'var mi')", "unavailable_item"),
    ("(mentioned is not null and (contains(t, 'daha') or regexp_matches(t, '\\b(?:[0-9]+|bir|iki|uc|dort|bes)\\b'))) or regexp_matches(t, '\\b(?:istiyorum|alabilir|siparis|ekle|isterim|alayim)\\b')", "add_item"), ("contains(t, 'menude neler var')", "menu_question"),
    ("mentioned is not null and contains(t, 'ne kadar')", "price_question"), ("mentioned is not null", "menu_question"),
])


@R.add(f"with u as (select l_orderkey, l_linenumber, {_SAYS} as text from ({UTT})), i as ({ITEMS}), m as (select u.*, replace({folded('u.text')}, 'ı', 'i') as t, i.name as mentioned, i.position from u left join i on contains(replace({folded('u.text')}, 'ı', 'i'), {folded('i.name')})), x as (select l_orderkey, l_linenumber, text, any_value(t) as t, arg_min(mentioned, position) as mentioned from m group by 1, 2, 3) select distinct l_orderkey, l_linenumber, text, case {_GROUND} else 'off_topic' end as intent from x")
def intent_grounded(spark: SparkSession, d: str) -> DataFrame:
    """All 13 outcomes; what is unavailable is found in the text."""
    text = F.lit(None).cast("string")
    for i, said in enumerate(_SAID):
        before, *after = said.split("{}")
        text = F.when(F.col("l_orderkey") % 15 == i, F.concat(F.lit(before), *[F.concat("p_name", F.lit(x)) for x in after])).otherwise(text)
    said = utterances(spark, d).select(*IDS, text.alias("text")).distinct()

    def work(texts):
        m, has = J.with_mentions(texts, J.surfaces(items(spark, d)), ["text"]), F.size("mentions") > 0
        return m.select("text", J.grounded_intent(F.col("text"), has, J.unavailable_terms(F.col("text"), has, ("pizza",), ("var mi",))).alias("intent"))

    return J.per_text(said, "text", work).select(*IDS, "text", "intent")


@R.add(f"{_HAS} select l_orderkey, l_linenumber, {_BEFORE} when {_ADD} then 'add_order' else 'other' end as intent from x")
def intent_eval(spark: SparkSession, d: str) -> DataFrame:
    u = _with_item(spark, d)
    return u.select(*IDS, J.eval_intent(F.col("text"), F.col("mentioned").isNotNull()).alias("intent"))


@R.add("select conv_id, turn, case when conv_id % 3 = 0 then 'payment' when conv_id % 3 = 1 then 'location' end as topic, case when conv_id % 3 = 0 then 'Kart geçiyor.' when conv_id % 3 = 1 then 'Bu bilgi elimde yok.' end as answer from conversations")
def info_router(spark: SparkSession, d: str) -> DataFrame:
    """Topics are looked for at the start of words: inside longer ones ("aneredea") their letters ask nothing."""
    asked = F.concat("text", F.when(F.col("conv_id") % 3 == 0, " Kart geçiyor mu").when(F.col("conv_id") % 3 == 1, " Nerede").otherwise(""))
    return conversations(spark, d).select("conv_id", "turn", J.route_info(asked, {"payment": "Kart geçiyor."}, mode="start").alias("r")).select("conv_id", "turn", "r.topic", "r.answer")


@R.add(f"with u as ({UTT}) select l_orderkey, l_linenumber, case when l_orderkey % 2 = 0 then list_filter(['pizza', 'sushi'], lambda x: (x = 'pizza' and l_linenumber % 2 = 0) or (x = 'sushi' and l_linenumber % 3 = 0)) else [] end as terms from u")
def unavailable_terms(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, " Pizza").otherwise(""), F.when(F.col("l_linenumber") % 3 == 0, " Sushi").otherwise(""), F.lit(" alabilir miyim"))
    return utterances(spark, d).select(*IDS, J.unavailable_terms(text, F.col("l_orderkey") % 2 != 0, ("pizza", "sushi"), ("alabilir",)).alias("terms"))


@R.add("select p_partkey, case when p_size % 3 = 0 then [] when p_size % 2 = 0 then case when p_size % 4 = 0 then ['Pizza', 'Suşi'] else ['Suşi'] end when p_partkey % 2 = 0 then ['Bilinmeyen ürün'] else [] end as names from part")
def unavailable_names(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("bir "), F.when(F.col("p_size") % 4 == 0, "PIZZA ").otherwise(""), F.when(F.col("p_size") % 2 == 0, "Sushi ").otherwise(""), F.lit("var mı"))
    intent = F.when(F.col("p_size") % 3 == 0, "add_item").otherwise("unavailable_item")
    return table(spark, d, "part").select("p_partkey", J.unavailable_names(intent, text, F.col("p_partkey") % 2 == 1, {"pizza": "Pizza", "sushi": "Suşi"}).alias("names"))


@R.add("select conv_id, turn, case when contains(lower(text), 'tion') then case when p.k is null then 'unknown_item' else 'pass' end when contains(lower(text), 'und') then 'off_topic' else 'low_confidence' end as route from conversations left join (select distinct lower(p_name) as k from part) p on lower(conversations.role) = p.k")
def route_parsed(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    intent = first_match(low, (Rule("add_item", ("tion",)), Rule("off_topic", ("und",))), "unknown")
    routed = J.route_parsed(conversations(spark, d), table(spark, d, "part"), intent, F.when(low.contains("tion"), 0.9).otherwise(0.3), "role", "p_name")
    return routed.select("conv_id", "turn", "route")


@R.add(f"with u as (select l_orderkey, l_linenumber, concat(text, ' ', lower(p_type)) as text from ({UTT})), c as (select distinct p_type as category from part) select l_orderkey, l_linenumber, min(category) as category from u join c on contains({folded('u.text')}, {folded('c.category')}) group by 1, 2")
def extract_category(spark: SparkSession, d: str) -> DataFrame:
    u = utterances(spark, d).withColumn("text", F.concat("text", F.lit(" "), F.lower("p_type")))
    return J.extract_category(u, table(spark, d, "part").select(F.col("p_type").alias("category")).distinct(), IDS)


@R.add(f"with i as ({ITEMS}) select p_partkey, i.name as item from part left join i on lower(i.name) = lower(part.p_name)")
def lookup_item(spark: SparkSession, d: str) -> DataFrame:
    dim = items(spark, d).withColumn("item", F.col("name"))
    return J.lookup(table(spark, d, "part").select("p_partkey", F.upper("p_name").alias("q")), dim, "q", "name").select("p_partkey", "item")


@R.add(f"with i as ({ITEMS}), w as (select distinct string_split(p_name, ' ')[1] as q from part) select q, count(*) as hits, min(name) as first_name from w join i on contains({folded('name')}, {folded('q')}) group by q")
def search_item(spark: SparkSession, d: str) -> DataFrame:
    """Reverse containment: the query inside a name."""
    q = table(spark, d, "part").select(F.split("p_name", " ")[0].alias("q")).distinct()
    names = items(spark, d).select("name", X.fold(F.col("name")).alias("__t"))
    return J.containing(names, q.select("q", X.fold(F.col("q")).alias("surface"))).groupBy("q").agg(F.count("*").alias("hits"), F.min("name").alias("first_name"))


@R.add("select l_orderkey, count(*) as lines, round(sum(p_retailprice * l_quantity), 2) as total from lineitem join part on l_partkey = p_partkey group by l_orderkey")
def order_lines(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(table(spark, d, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.round(F.sum(F.col("p_retailprice") * F.col("l_quantity")), 2).alias("total"))


def _members(spark, d, member):
    dim = table(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").cast("string").alias("k"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("l_partkey"))
    return J.require_member(lines, dim, "l_partkey", "k", member).select("l_orderkey", "l_linenumber")


@R.add("select l_orderkey, l_linenumber from lineitem where l_partkey in (select p_partkey from part where p_size > 25)")
def dim_members(spark: SparkSession, d: str) -> DataFrame:
    return _members(spark, d, True)


@R.add("select l_orderkey, l_linenumber from lineitem where l_partkey not in (select p_partkey from part where p_size > 25)")
def dim_orphans(spark: SparkSession, d: str) -> DataFrame:
    return _members(spark, d, False)


@R.add("select p_partkey, p_name from part where lower(p_type) in (select lower(p_type) from part order by p_type limit 1) and p_size between 1 and 40 order by p_partkey limit 25")
def dim_by_tag(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    tag = part.agg(F.min("p_type").alias("tag"))
    hit = part.crossJoin(F.broadcast(tag)).filter(F.arrays_overlap(F.array(F.lower("p_type")), F.array(F.lower("tag"))) & F.col("p_size").between(1, 40))  # one row
    return hit.orderBy("p_partkey").limit(25).select("p_partkey", "p_name")


@R.add("with g as (select p_partkey, 'role_' || cast(p_size % 2 as varchar) as bucket from part), s as (select conv_id, turn, case when role = 'user' then 'role_0' else 'all' end as bucket from conversations), sn as (select *, row_number() over (partition by bucket order by conv_id, turn) - 1 as i, count(*) over (partition by bucket) as n from s), gn as (select *, row_number() over (partition by bucket order by p_partkey) - 1 as k, case when bucket = 'role_0' then 'role_0' else 'all' end as use from g) select p_partkey, conv_id, turn from gn join sn on use = sn.bucket and k % n = i")
def round_robin_join(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "part").select("p_partkey", F.concat(F.lit("role_"), (F.col("p_size") % 2).cast("string")).alias("bucket"))
    s = conversations(spark, d).select("conv_id", "turn", F.when(F.col("role") == "user", "role_0").otherwise("all").alias("bucket"))
    return J.round_robin_join(g, s, "bucket", [F.col("p_partkey")], [F.col("conv_id"), F.col("turn")]).select("p_partkey", "conv_id", "turn")


@R.add("select p_partkey, n_nationkey, concat(cast(q as varchar), ' ', p_name, ' ', n_name) as text from part cross join (values (1), (2)) as v(q) cross join nation")
def template_expand(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    e = J.expand_templates(parts, spark.createDataFrame([(1,), (2,)], "q int"), table(spark, d, "nation").select("n_nationkey", "n_name"))
    return e.select("p_partkey", "n_nationkey", F.concat(F.col("q").cast("string"), F.lit(" "), "p_name", F.lit(" "), "n_name").alias("text"))


@R.add("select a.n_nationkey, b.n_nationkey as other from nation a join nation b on (a.n_nationkey + 5) % 25 = b.n_nationkey")
def shifted_pairs(spark: SparkSession, d: str) -> DataFrame:
    return J.shifted_pairs(table(spark, d, "nation").select("n_nationkey"), "n_nationkey", 25).select("n_nationkey", F.col("other_n_nationkey").alias("other"))


_INTENTS = ", ".join(f"'{i}'" for i in (*presets.GROUNDED_INTENTS, "dance"))
_GROUNDED = f"""with g as (select p_partkey, p_name, p_retailprice, p_size, [{_INTENTS}][1 + p_partkey % 14] as intent, case when p_partkey % 17 = 0 then ' ' else 'istek' end as message,
  case when p_partkey % 11 = 0 then 1.5 when p_partkey % 7 = 0 then null else 0.9 end as confidence,
  case when p_size % 9 = 0 then '' else concat('Kategoriler: ', p_name, ' 10:00 nakit') end as canonical,
  case when p_size % 3 = 0 then [] else [{{'name': p_name, 'quantity': p_size, 'price': p_retailprice}}] end as ordered,
  case when p_size % 2 = 0 then ['Pizza'] else [] end as unavailable from part),
t as (select *, case intent when 'greeting' then ['Merhaba'] when 'restaurant_info' then list_filter(['10:00', '22:00', 'nakit'], lambda m: contains(canonical, m))
  when 'menu_question' then [case when contains(canonical, 'Kategoriler') then 'Kategoriler' else 'Kategori' end] when 'recommendation' then list_concat(['Öneri'], list_filter([p_name], lambda n: contains(canonical, n)))
  when 'price_question' then ['TL', p_name, printf('%.2f', p_retailprice)] when 'allergen_question' then ['Alerji', 'teyit']
  when 'add_item' then list_concat(['Ekledim', p_name], own) when 'remove_item' then ['Çıkardım', p_name] when 'clear_order' then ['temizlendi']
  when 'summarize_order' then list_concat(case when len(ordered) > 0 then ['Toplam', 'TL'] else [] end, own)
  when 'confirm_order' then list_concat(case when len(ordered) > 0 then ['Toplam', 'MVP/demo'] else ['aktif bir siparişiniz görünmüyor', 'Önce'] end, own)
  when 'unavailable_item' then list_concat(['bulunmuyor'], unavailable) when 'off_topic' then ['yardımcı olamıyorum'] else [] end as terms from
  (select *, case when len(ordered) > 0 then [p_name, cast(p_size as varchar), printf('%.2f', p_retailprice), printf('%.2f', p_retailprice * p_size)] else [] end as own from g)),
r as (select *, list_filter(terms, lambda x, i: list_position(terms, x) = i) as must_preserve,
  case intent when 'unavailable_item' then list_concat(unavailable, ['eklendi', 'fiyatı', 'fiyati', 'MVP/demo']) when 'off_topic' then ['şiir hazırladım', 'şiir yazdım', 'iste bir siir', 'işte bir şiir'] when 'allergen_question' then ['kesinlikle güvenli', 'hiç sorun yok'] else [] end as must_not_introduce,
  case intent when 'allergen_question' then ['Alerji', 'teyit'] when 'off_topic' then ['yardımcı olamıyorum'] else [] end as safe,
  case intent when 'allergen_question' then ['kesinlikle güvenli', 'hiç sorun yok'] else [] end as claims, intent = 'allergen_question' as staff from t),
c as (select *, case when p_size % 5 = 0 then list_filter(safe, lambda x: x = 'Alerji') else safe end as must_include, case when p_size % 4 = 0 then [] else must_preserve end as kept, case when p_size % 8 = 0 then -1.0 else p_retailprice end as total, case when p_size % 7 = 0 then ' ' else 'menu' end as source from r),
e as (select *, list_filter([case when intent = 'dance' then 'unsupported intent: dance' end, case when trim(message) = '' then 'empty message' end, case when confidence > 1 then 'confidence outside 0 and 1' end, case when trim(canonical) = '' then 'empty response' end,
  case when total < 0 then 'negative total' end, case when trim(source) = '' then 'empty menu source' end, case when intent = 'allergen_question' and not list_contains(must_include, 'Alerji') then 'allergen answer without Alerji' end,
  case when intent = 'allergen_question' and not list_contains(must_include, 'teyit') then 'allergen answer without teyit' end, case when intent = 'off_topic' and len(must_include) = 0 then 'refusal without terms' end,
  case when intent = 'confirm_order' and not list_contains(kept, 'MVP/demo') then 'demo confirmation without MVP/demo' end], lambda x: x is not null) as errors from c)
"""


def _grounded(spark, d):
    """Results of all 13 intents and one that is not supported, from parts; sound and broken ones."""
    p = table(spark, d, "part")
    intent = F.element_at(F.array(*[F.lit(i) for i in (*presets.GROUNDED_INTENTS, "dance")]), (F.col("p_partkey") % 14 + 1).cast("int"))
    ordered = F.array(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("quantity"), F.col("p_retailprice").alias("price")))
    g = p.select(
        "p_partkey", "p_name", "p_retailprice", "p_size", intent.alias("intent"), F.when(F.col("p_partkey") % 17 == 0, " ").otherwise("istek").alias("message"),
        F.when(F.col("p_partkey") % 11 == 0, 1.5).when(F.col("p_partkey") % 7 == 0, None).otherwise(0.9).alias("confidence"),
        F.when(F.col("p_size") % 9 == 0, "").otherwise(F.concat(F.lit("Kategoriler: "), "p_name", F.lit(" 10:00 nakit"))).alias("canonical"),
        F.filter(ordered, lambda o: o["quantity"] % 3 != 0).alias("ordered"), F.filter(F.array(F.lit("Pizza")), lambda x: F.col("p_size") % 2 == 0).alias("unavailable"),
    )
    matched = F.array(F.struct(F.col("p_name").alias("name"), F.col("p_retailprice").alias("price")))
    g = g.withColumn("g", J.grounding_terms(F.col("intent"), F.col("canonical"), matched, F.col("ordered"), F.col("ordered"), F.col("unavailable"))).select("*", "g.*")
    include = F.when(F.col("p_size") % 5 == 0, F.filter("must_include", lambda x: x == "Alerji")).otherwise(F.col("must_include"))
    kept = F.when(F.col("p_size") % 4 == 0, F.array().cast("array<string>")).otherwise(F.col("must_preserve"))
    c = g.withColumn("included", include).withColumn("kept", kept).withColumn("total", F.when(F.col("p_size") % 8 == 0, -1.0).otherwise(F.col("p_retailprice"))).withColumn("source", F.when(F.col("p_size") % 7 == 0, " ").otherwise("menu"))
    return c.withColumn("errors", J.grounded_errors(F.col("intent"), F.col("message"), F.col("confidence"), F.col("canonical"), F.col("total"), F.col("source"), F.col("included"), F.col("kept"), F.lit(True)))


@R.add(f"{_GROUNDED} select p_partkey, must_preserve, must_not_introduce, safe as must_include, staff from e")
def grounding_terms(spark: SparkSession, d: str) -> DataFrame:
    return _grounded(spark, d).select("p_partkey", "must_preserve", "must_not_introduce", "must_include", "staff")


@R.add(f"{_GROUNDED} select p_partkey, errors from e")
def validate_grounded(spark: SparkSession, d: str) -> DataFrame:
    return _grounded(spark, d).select("p_partkey", "errors")


@R.add(f"""{_GROUNDED}, s as (select *, list_concat(kept, must_include, list_concat(own, [printf('%.2f', total)])) as required, case when p_size % 10 = 1 then canonical else concat(array_to_string(list_concat(kept, own), ' '), ' ', printf('%.2f', total), case when p_size % 6 = 1 then ' eklendi kesinlikle güvenli' else '' end) end as said from e)
select p_partkey, case when len(errors) > 0 then errors else list_concat(list_transform(list_filter(required, lambda x: not contains({folded('said')}, {folded('x')})), lambda x: concat('missing: ', x)), list_transform(list_filter(list_concat(must_not_introduce, claims), lambda x: contains({folded('said')}, {folded('x')})), lambda x: concat('forbidden: ', x)),
 case when p_size % 13 = 0 and {folded('said')} <> {folded('canonical')} then ['paraphrase not allowed'] else [] end) end as reasons from s""")
def paraphrase_safety(spark: SparkSession, d: str) -> DataFrame:
    own = J.order_terms(F.col("ordered"), F.col("total"))
    said = F.when(F.col("p_size") % 10 == 1, F.col("canonical")).otherwise(F.concat(F.array_join(F.concat("kept", own), " "), F.when(F.col("p_size") % 6 == 1, " eklendi kesinlikle güvenli").otherwise("")))
    reasons = J.paraphrase_errors(F.col("errors"), said, F.col("canonical"), F.concat("kept", "included", own), F.concat("must_not_introduce", "forbidden_claims"), F.col("p_size") % 13 != 0)
    return _grounded(spark, d).select("p_partkey", reasons.alias("reasons"))


_REPLIES = ("greeting", "thanks", "ask_hours", "restaurant_info", "ask_categories", "recommendation", "allergy", "ask_price", "ask_ingredient", "menu_detail", "add_order", "update_order", "remove_order", "clear_order", "summary", "confirm_order", "unavailable_item", "empty", "fallback")
_NAMES = ", ".join(f"'{i}'" for i in _REPLIES)


@R.add(f"""with x as (select p_partkey, p_retailprice as price, p_size, case when p_size % 2 = 0 then p_name end as name, case when p_size % 3 = 0 then p_type end as category, case when p_size % 5 = 0 then [] else [p_name, p_type] end as choices, case when p_size % 7 = 0 then null else 'Toplam' end as summary, [{_NAMES}][1 + p_partkey % 19] as intent from part)
select p_partkey, case when intent = 'greeting' then 'Merhaba, hoş geldiniz.' when intent = 'thanks' then 'Rica ederim, afiyet olsun.' when intent = 'ask_hours' then 'Çalışma saatlerimiz: 10:00-22:00.' when intent = 'restaurant_info' then 'Bu bilgi bu demo ortamında tanımlı değildir. Menü veya siparişle ilgili yardımcı olabilirim.'
 when intent = 'ask_categories' then case when len(choices) > 0 then concat('Kategoriler: ', array_to_string(choices, ', ')) else 'Menüde böyle bir bilgi yok.' end
 when intent = 'recommendation' then case when category is not null and len(choices) = 0 then concat(category, ' için uygun bir önerim yok. Başka bir kategori belirtir misiniz?') when category is not null then concat(category, ' olarak ', choices[1], ' veya ', choices[2], ' önerebilirim.') when len(choices) > 0 then concat('Öneri olarak şunları sunabilirim: ', array_to_string(choices, ', '), '.') else 'Size uygun bir önerim yok. Bir kategori belirtir misiniz?' end
 when intent = 'allergy' then case when name is not null then concat(name, ' için kayıtlı alerjen bilgisini mutfakla teyit edebilirim.') else 'Alerji konusunda mutfakla teyit edebilirim.' end
 when intent = 'ask_price' and name is not null then printf('%s %.2f TL.', name, price) when intent = 'ask_ingredient' and name is not null then concat(name, ': İçerik bilgisi bulunamadı.') when intent = 'menu_detail' and name is not null then printf('%s: Fiyat: %.2f TL.', name, price)
 when intent = 'add_order' then case when name is not null then concat('Ekledim: ', p_size, ' x ', name, '. Başka bir isteğiniz var mı?') else 'Siparişe eklemek istediğiniz ürünü yazar mısınız?' end
 when intent = 'update_order' then case when name is not null then concat('Güncelledim: ', p_size, ' x ', name, '. Başka bir isteğiniz var mı?') else 'Hangi ürünün miktarını güncellemek istersiniz?' end
 when intent = 'remove_order' then case when name is not null then concat('Çıkardım: ', name, '. Başka bir isteğiniz var mı?') else 'Hangi ürünü çıkarmak istersiniz?' end
 when intent = 'clear_order' then 'Siparişiniz temizlendi.' when intent = 'summary' then coalesce(summary, 'Siparişinizde henüz ürün yok.')
 when intent = 'confirm_order' then case when summary is not null then concat('Siparişinizi onaylıyorum.', chr(10), summary, chr(10), 'Not: Bu yalnızca MVP/demo onayıdır; gerçek restoran gönderimi yapılmaz.') else 'Onaylanacak aktif bir siparişiniz görünmüyor. Önce siparişinize bir ürün ekleyebilir misiniz?' end
 when intent = 'unavailable_item' then concat(coalesce(name, 'Bu ürün'), ' menümüzde bulunmuyor.') when intent = 'empty' then 'Sizi duyamadım, tekrar eder misiniz?' else 'Bu konuda yardımcı olamıyorum. Menü veya siparişle ilgili sorabilir misiniz?' end as reply from x""")
def render_reply(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    intent = F.element_at(F.array(*[F.lit(i) for i in _REPLIES]), (F.col("p_partkey") % 19 + 1).cast("int"))
    choices = F.filter(F.array("p_name", "p_type"), lambda x: size % 5 != 0)
    reply = J.render_reply(intent, F.when(size % 2 == 0, F.col("p_name")), F.col("p_retailprice"), size, category=F.when(size % 3 == 0, F.col("p_type")), choices=choices, categories=choices, summary=F.when(size % 7 != 0, F.lit("Toplam")), hours="10:00-22:00")
    return table(spark, d, "part").select("p_partkey", reply.alias("reply"))


@R.add("select p_partkey, case when p_name like 'a%' then concat(p_name, ' için isteğinizi aldım.') else concat(p_name, ' için mutfağa sorup bilgi vereyim.') end as text from part")
def ack_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", J.ack_text(F.col("p_name"), ~F.col("p_name").startswith("a")).alias("text"))


# Aggregations over the dimension


@R.add("select distinct p_type as category from part order by 1")
def categories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_type").alias("category")).distinct().orderBy("category")


@R.add(f"with i as (select name, position, case when position % 4 = 0 then 'Diğer' else category end as category, case when position % 5 = 0 then name else concat(name, printf(' (%.2f TL)', price)) end as item from ({ITEMS})), l as (select category, string_agg(item, ', ' order by position) as line from i group by category) select concat('Menü kategorileri: ', string_agg(category, ', ' order by category), '.', chr(10), string_agg(concat(category, ': ', line, '.'), chr(10) order by category), chr(10), 'Çalışma saatleri: 10:00-22:00.', chr(10), 'Ödeme yöntemleri: nakit, kart.') as document from l")
def context_text(spark: SparkSession, d: str) -> DataFrame:
    """One text for a dimension, which is bounded by its distinct names: categories, items with prices, facts."""
    dim = items(spark, d).withColumn("category", F.when(F.col("position") % 4 == 0, " ").otherwise(F.col("category"))).withColumn("price", F.when(F.col("position") % 5 != 0, F.col("price")))
    return J.context_document(dim, {"Çalışma saatleri": "10:00-22:00", "Ödeme yöntemleri": ["nakit", " ", "kart"], "Alerji politikası": ""})


@R.add("select regexp_replace(substr(string_agg(distinct p_name, ', ' order by p_name), 1, 200), ',[^,]*$', '') as vocabulary from part")
def vocab_prompt(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select("p_name").distinct().agg(F.array_join(F.array_sort(F.collect_list("p_name")), ", ").alias("v"))
    return names.select(F.regexp_replace(F.substring("v", 1, 200), ",[^,]*$", "").alias("vocabulary"))


@R.add("select l_orderkey, round(sum(l_extendedprice * l_quantity), 2) as total, count(*) as lines from lineitem group by l_orderkey")
def order_totals(spark: SparkSession, d: str) -> DataFrame:
    return O.order_totals(table(spark, d, "lineitem"), "l_orderkey", F.col("l_extendedprice"), F.col("l_quantity"))


@R.add("select l_orderkey, string_agg(concat(cast(cast(l_quantity as int) as varchar), ' x ', cast(l_partkey as varchar)), chr(10) order by l_linenumber, concat(cast(cast(l_quantity as int) as varchar), ' x ', cast(l_partkey as varchar))) as summary from lineitem group by l_orderkey")
def order_summary_text(spark: SparkSession, d: str) -> DataFrame:
    return O.order_summary(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" x "), F.col("l_partkey").cast("string")))


# Enrichment, limits, parsers: steps of other operators, on their own


@R.add("select doc_id, lang, 'reviewed' as source, n_chars > 500 as include, concat('n=', n_chars) as notes from documents")
def with_review(spark: SparkSession, d: str) -> DataFrame:
    """Records keep their columns; review flags are overwritten."""
    return G.with_review(table(spark, d, "documents").drop("text"), source=F.lit("reviewed"), include=F.col("n_chars") > 500, notes=F.concat(F.lit("n="), F.col("n_chars").cast("string"))).drop("n_chars")


@R.add("select conv_id, turn from conversations where role = 'user' order by conv_id, turn limit 20")
def first_rows(spark: SparkSession, d: str) -> DataFrame:
    return S.first_rows(users(spark, d), 20, F.col("conv_id"), F.col("turn")).select("conv_id", "turn")


@R.add(f"select conv_id, turn, case when contains({folded('text')}, 'tion') then 'add_item' else 'unknown' end as intent, case when contains({folded('text')}, 'tion') then 0.9 else 0.2 end::double as confidence from conversations")
def parse_messages(spark: SparkSession, d: str) -> DataFrame:
    """Any parser: a transform that adds an intent and a confidence."""
    hit = X.fold(F.col("text")).contains("tion")
    parser = lambda df: df.withColumn("intent", F.when(hit, "add_item").otherwise("unknown")).withColumn("confidence", F.when(hit, 0.9).otherwise(0.2))
    return J.parsed(conversations(spark, d), parser).select("conv_id", "turn", "intent", "confidence")


# Evaluation


@R.add("select doc_id, case when l.doc_id is null then 'missing' else 'matched' end as status, quality from documents left join labels l using (doc_id)")
def match_outputs(spark: SparkSession, d: str) -> DataFrame:
    return E.match_outputs(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id").select("doc_id", "status", "quality")


_SCORE = f"select doc_id, list_filter([case when not contains({folded('text')}, 'tion') then 'missing: tion' end, case when not contains({folded('text')}, 'on') then 'missing: on' end, case when contains({folded('text')}, 'idiot') then 'forbidden: idiot' end], lambda x: x is not null) as reasons, l.doc_id is null as none from documents left join labels l using (doc_id)"


def _scored(spark, d):
    j = E.match_outputs(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels").select("doc_id"), "doc_id").withColumnRenamed("status", "match")
    s = E.score(j, F.col("text"), F.array(F.lit("tion"), F.lit("on")), F.array(F.lit("idiot")))
    return s.withColumn("status", F.when(F.col("match") == "missing", "missing").otherwise(F.col("status")))


@R.add(f"select doc_id, reasons, case when none then 'missing' when len(reasons) = 0 then 'passed' else 'failed' end as status from ({_SCORE})")
def score_cases(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", "reasons", "status")


_REPORT = "select count(*) as total, count(*) filter (status = 'passed') as passed, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'missing') as missing, count(*) filter (status = 'invalid') as invalid, round(coalesce(100.0 * count(*) filter (status = 'passed') / nullif(count(*), 0), 0.0), 4) as pass_rate from"


@R.add(f"{_REPORT} (select case when none then 'missing' when len(reasons) = 0 then 'passed' else 'failed' end as status from ({_SCORE}))")
def score_report(spark: SparkSession, d: str) -> DataFrame:
    return E.report(_scored(spark, d))


@R.add(f"{_REPORT} (select case when quality is null then 'missing' when toxic = 1 then 'invalid' when quality = 1 then 'passed' else 'failed' end as status from documents left join labels using (doc_id))")
def eval_report(spark: SparkSession, d: str) -> DataFrame:
    j = E.match_outputs(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")
    return E.report(j.withColumn("status", F.when(F.col("status") == "missing", "missing").when(F.col("toxic") == 1, "invalid").when(F.col("quality") == 1, "passed").otherwise("failed")))


@R.add(f"select doc_id, array_to_string(reasons, '; ') as problems from ({_SCORE}) where len(reasons) > 0")
def problem_lines(spark: SparkSession, d: str) -> DataFrame:
    return E.problem_lines(_scored(spark, d), "doc_id")


@R.add("with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as r, count(*) over (partition by event_type) as n from events where value is not null) select event_type, max(n) as n, max(value) filter (r = n // 2) as median, max(value) filter (r = greatest(0, cast(floor(n * 0.95::double) as bigint) - 1)) as p95, min(value) as least, max(value) as most, round(avg(value), 4) as mean from r group by event_type")
def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    return E.latency_stats(table(spark, d, "events").select("event_type", "value"), ["event_type"], "value")


@R.add("select event_type, count(*) as n, count(*) filter (value > 10) as passed, round(count(*) filter (value > 10) / count(*), 6) as pass_share, round(avg(value), 4) as mean_latency from events group by event_type")
def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.audit_summary(table(spark, d, "events"), "event_type", F.col("value") > 10, F.col("value"))


@R.add("with o as (select doc_id, md5(text) as k, case when n_chars < 50 then 'too short' end as own from documents) select doc_id, coalesce(own, case when row_number() over (partition by k, own is null order by doc_id) > 1 then 'duplicate_key' end) as reason from o")
def invalid_outputs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "documents").select("doc_id", "n_chars", F.md5(F.col("text").cast("binary")).alias("k"))
    return E.valid_outputs(o, "k", G.first_reason([(F.col("n_chars") < 50, "too short")]), [F.col("doc_id")]).select("doc_id", "reason")


@R.add(f"with u as ({UTT}) select l_orderkey, l_linenumber, case when contains(text, 'small') then 'failed' else 'passed' end as status from u")
def evaluate_backend(spark: SparkSession, d: str) -> DataFrame:
    backend = lambda cases: cases.withColumn("response", F.concat("text", F.lit(" mi")))
    none = F.array().cast("array<string>")
    return E.evaluate(utterances(spark, d), backend, expected=none, forbidden=F.array(F.lit("small"))).select(*IDS, "status")


# Orders and state

_STEPS = f"""with recursive ops as ({OPS}), o as (select *, sum(case when op = 'clear' then 1 else 0 end) over (partition by session order by ts, event_id rows unbounded preceding) as span from ops),
n as (select *, row_number() over (partition by session, item, span order by ts, event_id) as i from o where op <> 'clear'),
f as (select session, item, op, qty, ts, event_id, span, i, cast(0 as bigint) as before, cast(case op when 'add' then greatest(qty, 1) else 0 end as bigint) as after from n where i = 1
 union all select n.session, n.item, n.op, n.qty, n.ts, n.event_id, n.span, n.i, f.after, case n.op when 'add' then f.after + greatest(n.qty, 1) when 'update' then case when n.qty <= 0 then 0 when f.after > 0 then n.qty else f.after end else 0 end from f join n on n.session = f.session and n.item = f.item and n.span = f.span and n.i = f.i + 1),
fold as (select session, item, after as quantity from f where (session, item, span, i) in (select session, item, span, max(i) from f group by 1, 2, 3) and (session, span) in (select session, max(span) from o group by 1) and after > 0)"""


@R.add(f"{_STEPS} select * from fold")
def order_fold(spark: SparkSession, d: str) -> DataFrame:
    return O.fold_orders(operations(spark, d), "session", "item", "op", "qty", ["ts", "event_id"])


_ITEM_STEPS = f"""with recursive ops as ({OPS}), ks as (select distinct session, item from ops where op <> 'clear'),
rows as (select session, item, op, qty, ts, event_id from ops where op <> 'clear' union all select o.session, k.item, 'remove', 0, o.ts, o.event_id from ops o join ks k using (session) where o.op = 'clear'),
n as (select *, row_number() over (partition by session, item order by ts, event_id) as i from rows),
f as (select session, item, op, qty, ts, event_id, i, cast(0 as bigint) as before, cast(case op when 'add' then greatest(qty, 1) else 0 end as bigint) as after from n where i = 1
 union all select n.session, n.item, n.op, n.qty, n.ts, n.event_id, n.i, f.after, case n.op when 'add' then f.after + greatest(n.qty, 1) when 'update' then case when n.qty <= 0 then 0 when f.after > 0 then n.qty else f.after end else 0 end from f join n on n.session = f.session and n.item = f.item and n.i = f.i + 1)"""


@R.add(f"{_ITEM_STEPS} select session, item, event_id, op, before, after from f")
def order_before_after(spark: SparkSession, d: str) -> DataFrame:
    """One row an operation and item; a clear is a removal of each item of its session."""
    return O.item_steps(operations(spark, d), "session", "item", "op", "qty", ["ts", "event_id"]).select("session", "item", "event_id", "op", "before", "after")


@R.add(f"{_STEPS} select * from fold")
def order_fold_stream(spark: SparkSession, d: str) -> DataFrame:
    return jobs.run_order_stream(spark, f"{d}/events[.]parquet")


@R.add()
def cooldown_alerts(spark: SparkSession, d: str) -> DataFrame:
    return O.cooldown_alerts(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 20.0, 3).select("user_id", "event_id", "value")


@R.add()
def cooldown_alerts_stream(spark: SparkSession, d: str) -> DataFrame:
    return jobs.run_alert_stream(spark, f"{d}/events[.]parquet", 20.0, 3)


R.sql["cooldown_alerts"] = R.sql["cooldown_alerts_stream"] = "with recursive n as (select user_id, event_id, value, row_number() over (partition by user_id order by ts, event_id) as i from events), f as (select user_id, event_id, value, i, value >= 20 as alert, case when value >= 20 then 3 else 0 end as rest from n where i = 1 union all select n.user_id, n.event_id, n.value, n.i, f.rest = 0 and n.value >= 20, case when f.rest > 0 then f.rest - 1 when n.value >= 20 then 3 else 0 end from f join n on n.user_id = f.user_id and n.i = f.i + 1) select user_id, event_id, value from f where alert"


@R.add("with s as (select user_id, min(ts) as st from events group by 1), m as (select user_id, ts as a, ts + interval 1 day as b from events where event_type = 'error') select e.user_id, min(e.ts) as crossed_at, arg_min(e.value, e.ts) as score from events e join s using (user_id) where e.value >= 50 and e.ts <= s.st + interval 10 day and not exists (select 1 from m where m.user_id = e.user_id and e.ts between m.a and m.b) group by e.user_id")
def first_crossing(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "ts", "value")
    mutes = table(spark, d, "events").filter("event_type = 'error'").select("user_id", F.col("ts").alias("mute_start"), (F.col("ts") + F.expr("interval 1 day")).alias("mute_end"))
    return O.first_crossing(e, mutes, "user_id", "ts", "value", 50.0, 10 * 86_400)


_HISTORY = "with s as (select *, sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as part from events), h as (select user_id, event_id, count(*) over (partition by user_id, part order by ts, event_id rows between unbounded preceding and 1 preceding) as earlier, coalesce(list(event_type) over (partition by user_id, part order by ts, event_id rows between 8 preceding and 1 preceding), []) as history from s)"


@R.add(f"{_HISTORY} select user_id, event_id, earlier, history from h")
def session_history(spark: SparkSession, d: str) -> DataFrame:
    """The last 8 turns before each turn since the session's reset event, and the number of all of them."""
    h = S.session_history(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "signup", F.lit("user"), F.col("event_type"), 8)
    return h.select("user_id", "event_id", "earlier", F.col("history.content").alias("history"))


@R.add(f"{_HISTORY} select user_id, event_id, history from h")
def session_history_stream(spark: SparkSession, d: str) -> DataFrame:
    return jobs.run_history_stream(spark, f"{d}/events[.]parquet", 8).select("user_id", "event_id", F.col("history.content").alias("history"))


@R.add("select time_bucket(interval 1 day, ts) as window_start, case when event_type in ('click', 'view') then 'browse' when event_type = 'purchase' then 'buy' else 'other' end as category, count(*) as n from events group by 1, 2")
def stream_category_counts(spark: SparkSession, d: str) -> DataFrame:
    return jobs.run_category_counts(spark, f"{d}/events[.]parquet")
