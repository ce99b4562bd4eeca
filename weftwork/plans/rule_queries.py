"""Classification, selection and gates over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions import text as X
from weftwork.operators import gates as G
from weftwork.operators import selection as S
from weftwork.operators.evaluate import coverage_check as coverage
from weftwork.operators.rules import Rule, buckets, classify, first_match, strict_fragments
from weftwork.plans.base import Registry, conversations, folded, table, users
from weftwork.plans.text_queries import _V4

R = Registry()

RULES = (Rule("ends_tion", ("tion",), keep=True), Rule("german", ("und", "der "), keep=False, reason="german"), Rule("spanish", ("que",), keep=None, reason="short_conversation"), Rule("the_word", patterns=(r"\bthe\b",), unless=("edth",), keep=True))
DEFAULT = Rule("unclear", keep=False, reason="unclear")
_CASE = "case when contains(lower(text), 'tion') then 'ends_tion' when contains(lower(text), 'und') or contains(lower(text), 'der ') then 'german' when contains(lower(text), 'que') then 'spanish' when regexp_matches(lower(text), '(?:^|[^\\p{L}\\p{N}_])the(?:$|[^\\p{L}\\p{N}_])') and not contains(lower(text), 'edth') then 'the_word' else 'unclear' end"
_CLASSED = f"select conv_id, turn, role, text, {_CASE} as category from conversations where role = 'user'"


def _classed(spark, d):
    return users(spark, d).select("conv_id", "turn", "role", "text").withColumn("category", first_match(F.lower("text"), RULES))


ORDER = ("conv_id", "turn")


@R.add(f"with c as ({_CLASSED}), k as (select *, case category when 'ends_tion' then true when 'german' then false when 'spanish' then turn > 1 when 'the_word' then true else false end as keep from c) select conv_id, turn, category, keep, case when keep then '' when category = 'german' then 'german' when category = 'spanish' then 'short_conversation' else 'unclear' end as reason from k")
def classify_first_match(spark: SparkSession, d: str) -> DataFrame:
    c = users(spark, d).withColumn("c", classify(F.lower("text"), RULES, DEFAULT, keep_if=F.col("turn") > 1))
    return c.select("conv_id", "turn", "c.category", "c.keep", "c.reason")


@R.add(f"select category, count(*) as n from ({_CLASSED}) group by category")
def classify_counts(spark: SparkSession, d: str) -> DataFrame:
    return _classed(spark, d).groupBy("category").agg(F.count("*").alias("n"))


_BUCKETS = "select conv_id, turn, unnest([case when contains(lower(text), 'tion') then 'ends_tion' end, case when contains(lower(text), 'und') or contains(lower(text), 'der ') then 'german' end, case when contains(lower(text), 'que') then 'spanish' end, case when regexp_matches(lower(text), '(?:^|[^\\p{L}\\p{N}_])the(?:$|[^\\p{L}\\p{N}_])') and not contains(lower(text), 'edth') then 'the_word' end, 'all']) as bucket from conversations"


@R.add(f"select * from ({_BUCKETS}) where bucket is not null")
def bucketize(spark: SparkSession, d: str) -> DataFrame:
    return conversations(spark, d).select("conv_id", "turn", F.explode(buckets(F.lower("text"), RULES)).alias("bucket"))


@R.add(f"select bucket, count(*) as n from ({_BUCKETS}) where bucket is not null group by bucket")
def bucket_counts(spark: SparkSession, d: str) -> DataFrame:
    return bucketize(spark, d).groupBy("bucket").agg(F.count("*").alias("n"))


@R.add(f"select conv_id, turn, case when contains(key, 'tion') and not contains(key, 'und') then 'tion_only' when contains(key, 'the ') then 'the' else 'other' end as category from (select conv_id, turn, {_V4} as key from conversations)")
def classify_with_exclusion(spark: SparkSession, d: str) -> DataFrame:
    rules = (Rule("tion_only", ("tion",), unless=("und",)), Rule("the", ("the ",)))
    return conversations(spark, d).select("conv_id", "turn", first_match(X.norm_key(F.col("text")), rules, "other").alias("category"))


_STRICT = "case when regexp_matches(key, '\\bthe\\b') and not contains(key, 'price range') then 'ask_price' when contains(key, 'tion') and contains(key, 'on') then 'modify_order' end"


@R.add(f"select * from (select conv_id, turn, {_STRICT} as category from (select conv_id, turn, {_V4} as key from conversations)) where category is not null")
def classify_strict(spark: SparkSession, d: str) -> DataFrame:
    rules = (Rule("ask_price", patterns=(r"\bthe\b",), unless=("price range",)), Rule("modify_order", ("tion",), needs=("on",)))
    return conversations(spark, d).select("conv_id", "turn", first_match(X.norm_key(F.col("text")), rules, None).alias("category")).filter("category is not null")


_WORDS = "len(list_filter(string_split(key, ' '), lambda x: x <> ''))"


@R.add(f"select conv_id, turn from (select conv_id, turn, {_V4} as key from conversations) where key not in ('okay', 'yes', 'no') and ({_WORDS} >= 4 or contains(key, 'tion'))")
def fragment_filter(spark: SparkSession, d: str) -> DataFrame:
    key = X.norm_key(F.col("text"))
    return conversations(spark, d).filter(strict_fragments(key, ("okay", "yes", "no"), X.word_count(key), [Rule("x", ("tion",))])).select("conv_id", "turn")


@R.add(f"select conv_id, turn from (select conv_id, turn, {_V4} as key from conversations) where not (contains(key, 'und') or contains(key, 'que'))")
def noise_filter(spark: SparkSession, d: str) -> DataFrame:
    return conversations(spark, d).filter(~X.contains_any(X.norm_key(F.col("text")), ("und", "que"))).select("conv_id", "turn")


_PARSE = "select conv_id, turn, case when contains(lower(text), 'tion') then 'add_item' when contains(lower(text), 'und') then 'ask_price' else 'unknown' end as intent, cast(case when contains(lower(text), 'tion') then 0.9 when contains(lower(text), 'und') then 0.7 else 0.3 end as double) as confidence, coalesce(try_cast(nullif(regexp_extract(text, '[0-9]+'), '') as bigint), 1) as quantity from conversations"


def _parsed(spark, d):
    low = F.lower("text")
    intent = first_match(low, (Rule("add_item", ("tion",)), Rule("ask_price", ("und",))), "unknown")
    sure = F.when(low.contains("tion"), 0.9).when(low.contains("und"), 0.7).otherwise(0.3)
    parse = F.struct(intent.alias("intent"), sure.alias("confidence"), F.coalesce(F.nullif(F.regexp_extract("text", "[0-9]+", 0), F.lit("")).try_cast("bigint"), F.lit(1)).alias("quantity"))
    return conversations(spark, d).select("conv_id", "turn", "text", parse.alias("p"))


@R.add(_PARSE)
def parse_intent_struct(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).select("conv_id", "turn", "p.*")


@R.add(f"with p as ({_PARSE}) select conv_id, turn, e.error, e.position from (select conv_id, turn, unnest([case when intent = 'unknown' then {{'position': 0, 'error': 'unknown intent'}} end, case when confidence < 0.5 then {{'position': 1, 'error': 'low confidence'}} end, case when quantity > 100 then {{'position': 2, 'error': 'quantity'}} end]) as e from p) where e is not null")
def validate_intents(spark: SparkSession, d: str) -> DataFrame:
    p = _parsed(spark, d).select("conv_id", "turn", "p.*")
    checks = [(F.col("intent") == "unknown", "unknown intent"), (F.col("confidence") < 0.5, "low confidence"), (F.col("quantity") > 100, "quantity")]
    found = F.filter(F.array(*[F.when(c, F.struct(F.lit(i).alias("position"), F.lit(m).alias("error"))) for i, (c, m) in enumerate(checks)]), lambda x: x.isNotNull())
    return p.select("conv_id", "turn", F.explode(found).alias("e")).select("conv_id", "turn", "e.error", "e.position")


# Selection


@R.add("select conv_id, turn, role from (select *, row_number() over (partition by role, length(text) % 50 order by conv_id, turn) as n from conversations) where n = 1")
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return S.dedup_first(conversations(spark, d), [F.col("role"), F.length("text") % 50], ORDER).select("conv_id", "turn", "role")


@R.add("select count(*) - count(distinct text) as removed from documents")
def dedup_removed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("k"))
    return docs.withColumn("dup", S.duplicates(docs, [F.col("k")], [F.col("doc_id")])).agg(F.count_if("dup").alias("removed"))


@R.add(f"select category, conv_id, turn, case category when 'german' then 0 when 'ends_tion' then 1 else 2 end as limit_rank from (select *, row_number() over (partition by category order by conv_id, turn) as n from ({_CLASSED})) where n <= case category when 'german' then 5 when 'ends_tion' then 7 when 'unclear' then 3 else 0 end")
def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.quota_sample(_classed(spark, d), F.col("category"), {"german": 5, "ends_tion": 7, "unclear": 3}, ORDER).select("category", "conv_id", "turn", "limit_rank")


@R.add("select lang, doc_id from (select *, row_number() over (partition by lang order by doc_id) as n from documents) where n <= 10")
def head_per_group(spark: SparkSession, d: str) -> DataFrame:
    return S.head_per_group(table(spark, d, "documents"), F.col("lang"), 10, [F.col("doc_id")]).select("lang", "doc_id")


_PRIORITY = "case when category = 'ends_tion' then 0 when category = 'german' then 1 else 2 end, case when length(text) >= 12 then 0 else 1 end, turn, conv_id"


@R.add(f"select domain, conv_id, turn from (select *, row_number() over (partition by domain order by {_PRIORITY}) as n from (select *, case when conv_id % 3 = 0 then 'food' when conv_id % 3 = 1 then 'search' else 'none' end as domain from ({_CLASSED}))) where n <= case domain when 'food' then 20 when 'search' then 10 else 0 end")
def priority_topk(spark: SparkSession, d: str) -> DataFrame:
    c = _classed(spark, d).withColumn("domain", F.when(F.col("conv_id") % 3 == 0, "food").when(F.col("conv_id") % 3 == 1, "search").otherwise("none"))
    ranks = [F.when(F.col("category") == "ends_tion", 0).when(F.col("category") == "german", 1).otherwise(2), F.when(F.length("text") >= 12, 0).otherwise(1), F.coalesce("turn", F.lit(10**9)), F.col("conv_id")]
    return S.priority_topk(c, F.col("domain"), ranks, {"food": 20, "search": 10, "none": 0}).select("domain", "conv_id", "turn")


@R.add("select conv_id, turn from conversations where role = 'user' and not (conv_id % 5 = 0 or (conv_id % 7 = 0 and turn < 3))")
def exclude_prior(spark: SparkSession, d: str) -> DataFrame:
    u = users(spark, d).select("conv_id", "turn")
    return S.exclude_prior(u, [u.filter("conv_id % 5 = 0"), u.filter("conv_id % 7 = 0 and turn < 3")], ["conv_id", "turn"])


_RANK = "case category when 'spanish' then 0 when 'the_word' then 1 when 'german' then 2 else 3 end"


@R.add(f"with u as (select *, row_number() over (partition by text order by conv_id, turn) as k from ({_CLASSED})), p as (select *, case when category in ('spanish', 'the_word', 'german') and row_number() over (partition by category order by conv_id, turn) = 1 then 0 else 1 end as phase from u where k = 1) select conv_id, turn, category, phase from p order by phase, case when phase = 0 then {_RANK} else 0 end, conv_id, turn limit 30")
def diverse_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.diverse_sample(_classed(spark, d), F.col("category"), ("spanish", "the_word", "german"), 30, [F.col("text")], ORDER).select("conv_id", "turn", "category", "phase")


@R.add(f"select conv_id, turn, category from ({_CLASSED}) order by {_RANK}, case when contains(lower(text), 'edth') then 1 else 0 end, length(text), conv_id, turn limit 40")
def scored_topn(spark: SparkSession, d: str) -> DataFrame:
    scores = [S.rank_of(F.col("category"), ("spanish", "the_word", "german")), F.lower("text").contains("edth").cast("int"), F.length("text"), *ORDER]
    return S.scored_topn(_classed(spark, d), scores, 40).select("conv_id", "turn", "category")


@R.add(f"select conv_id, turn, category from (select *, row_number() over (partition by category order by conv_id, turn) as n from ({_CLASSED})) where category <> 'ends_tion' or n <= 6 order by conv_id, turn limit 25")
def capped_topn(spark: SparkSession, d: str) -> DataFrame:
    return S.capped_topn(_classed(spark, d), F.col("category"), ORDER, 25, {"ends_tion": 6}).select("conv_id", "turn", "category")


_STAGED = f"with c as (select *, conv_id * 1000 + turn as id from ({_CLASSED})), d as (select * from (select *, row_number() over (partition by text order by id) as k from c) where k = 1), a as (select *, 'german' as stage from d where category = 'german' order by id limit 8), b as (select *, 'tion' as stage from d where category = 'ends_tion' order by id limit 12), r as (select *, 'rest' as stage from d where id not in (select id from a union all select id from b) order by id limit 30 - (select count(*) from a) - (select count(*) from b)) select id, stage from a union all select id, stage from b union all select id, stage from r"


@R.add(_STAGED)
def staged_select(spark: SparkSession, d: str) -> DataFrame:
    c = _classed(spark, d).withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    stages = [("german", F.col("category") == "german", 8), ("tion", F.col("category") == "ends_tion", 12)]
    return S.staged_select(c, stages, 30, "id", ["text"], [F.col("id")]).select("id", "stage")


@R.add("select doc_id, coalesce(min(case when n_chars % 2 = 0 then doc_id end) over (partition by md5(text)) < doc_id, false) as dup from documents")
def dup_of_approved(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return S.with_duplicate_of_approved(docs, F.col("n_chars") % 2 == 0, [F.md5(F.col("text").cast("binary"))], F.col("doc_id")).select("doc_id", "dup")


@R.add("select doc_id, row_number() over (partition by md5(text) order by doc_id) > 1 as dup from documents")
def dup_of_earlier(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", S.duplicates(docs, [F.md5(F.col("text").cast("binary"))], [F.col("doc_id")]).alias("dup"))


_IDS = "select distinct conv_id from conversations"


@R.add(f"with i as ({_IDS}) select conv_id, case when row_number() over (order by md5(concat('42:', cast(conv_id as varchar))), conv_id) <= ceil(0.85 * (select count(*) from i)) then 'train' else 'valid' end as split from i")
def split_ratio(spark: SparkSession, d: str) -> DataFrame:
    return S.split_ratio(conversations(spark, d).select("conv_id").distinct(), F.col("conv_id"), 42).select("conv_id", "split")


@R.add(f"with i as ({_IDS}), r as (select conv_id, row_number() over (order by conv_id) as n from i) select conv_id, case when n <= 60 then 'train' when n <= 75 then 'valid' else 'test' end as split from r where n <= 90")
def split_fixed(spark: SparkSession, d: str) -> DataFrame:
    return S.split_fixed(conversations(spark, d).select("conv_id").distinct(), [F.col("conv_id")], {"train": 60, "valid": 15, "test": 15}).select("conv_id", "split")


@R.add("with g as (select distinct p_type as category, concat(p_name, '|', n_name) as row_text from part cross join nation) select category, row_text from (select *, row_number() over (partition by category order by row_text) as n from g) where n <= 3")
def take_distinct(spark: SparkSession, d: str) -> DataFrame:
    parts, nations = table(spark, d, "part"), table(spark, d, "nation")
    g = parts.select("p_type", "p_name").distinct().crossJoin(F.broadcast(nations.select("n_name"))).select(F.col("p_type").alias("category"), F.concat("p_name", F.lit("|"), "n_name").alias("row_text"))
    kinds = [r[0] for r in table(spark, d, "part").select("p_type").distinct().collect()]  # the limits table: one row a category
    return S.take_distinct(g, "category", dict.fromkeys(kinds, 3), [F.col("row_text"), F.col("category")], [F.col("row_text")])


@R.add("select conv_id, turn, count(*) over w as n, coalesce(string_agg(concat(role, ':', cast(length(text) as varchar)), ',') over w, '') as history from conversations window w as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)")
def turn_history(spark: SparkSession, d: str) -> DataFrame:
    h = S.with_history(conversations(spark, d), "conv_id", "turn")
    return h.select("conv_id", "turn", F.size("history").cast("bigint").alias("n"), F.array_join(F.transform("history", lambda x: F.concat(x["role"], F.lit(":"), F.length(x["content"]).cast("string"))), ",").alias("history"))


@R.add("select doc_id, printf('mgp_%03d', row_number() over (order by n_chars, doc_id)) as new_id from documents")
def assign_ids(spark: SparkSession, d: str) -> DataFrame:
    return S.assign_ids(table(spark, d, "documents").select("doc_id", "n_chars"), "mgp_%03d", F.col("n_chars"), F.col("doc_id")).select("doc_id", "new_id")


@R.add(f"select conv_id, turn, {_RANK} as rank from ({_CLASSED}) order by rank, conv_id, turn")
def rank_sort(spark: SparkSession, d: str) -> DataFrame:
    rank = S.rank_of(F.col("category"), ("spanish", "the_word", "german"))
    return _classed(spark, d).select("conv_id", "turn", rank.alias("rank")).orderBy("rank", *ORDER)


@R.add("select conv_id, turn, text from conversations")
def split_reunion(spark: SparkSession, d: str) -> DataFrame:
    c = conversations(spark, d).select("conv_id", "turn", "text")
    return c.filter("conv_id % 10 < 8").unionByName(c.filter("conv_id % 10 = 8")).unionByName(c.filter("conv_id % 10 = 9"))


@R.add("select md5(text) as key from documents where doc_id % 10 < 8 intersect select md5(text) from documents where doc_id % 10 >= 8")
def split_leakage(spark: SparkSession, d: str) -> DataFrame:
    keyed = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("key"))
    return S.leakage(keyed.filter("doc_id % 10 < 8"), keyed.filter("doc_id % 10 >= 8"), "key")


@R.add("select case when grouping(category) = 1 then 'total' else category end as category, count(*) filter (split = 'train') as train, count(*) filter (split = 'valid') as valid from (select role as category, case when conv_id % 5 = 0 then 'valid' else 'train' end as split from conversations) group by rollup (category)")
def split_contingency(spark: SparkSession, d: str) -> DataFrame:
    c = conversations(spark, d).select(F.col("role").alias("category"), F.when(F.col("conv_id") % 5 == 0, "valid").otherwise("train").alias("split"))
    return c.rollup("category").agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "valid").alias("valid"), F.grouping("category").alias("g")).select(F.when(F.col("g") == 1, "total").otherwise(F.col("category")).alias("category"), "train", "valid")


@R.add(f"select count(*) as read, count(*) filter (role = 'user') as reviewed, count(*) filter (role = 'user' and category <> 'unclear') as kept, count(*) filter (role = 'user' and category = 'unclear') as excluded from (select role, {_CASE} as category from conversations)")
def funnel_counts(spark: SparkSession, d: str) -> DataFrame:
    c = conversations(spark, d).withColumn("category", first_match(F.lower("text"), RULES))
    user = F.col("role") == "user"
    return c.agg(F.count("*").alias("read"), F.count_if(user).alias("reviewed"), F.count_if(user & (F.col("category") != "unclear")).alias("kept"), F.count_if(user & (F.col("category") == "unclear")).alias("excluded"))


@R.add("select lang as category, count(*) as n from documents group by lang order by lang")
def category_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("n")).orderBy("category")


@R.add(f"with c as ({_CLASSED}), s(category, required) as (values ('ends_tion', 10), ('german', 1000), ('never', 1)) select s.category, cast(s.required as bigint) as required, count(c.category) as found, count(c.category) >= s.required as ok from s left join c using (category) group by s.category, s.required")
def coverage_check(spark: SparkSession, d: str) -> DataFrame:
    return coverage(_classed(spark, d), "category", {"ends_tion": 10, "german": 1000, "never": 1})


# Gates and validators


_GATE = "select doc_id, lang, case when toxic = 1 then 'toxic' when n_chars < 200 then 'too_short' when quality is null then 'unreviewed' when quality <> 1 then 'low_quality' end as skip_reason from documents left join labels using (doc_id)"


def _gated(spark, d):
    j = table(spark, d, "documents").drop("text").join(table(spark, d, "labels"), "doc_id", "left")
    checks = [(F.col("toxic") == 1, "toxic"), (F.col("n_chars") < 200, "too_short"), (F.col("quality").isNull(), "unreviewed"), (F.col("quality") != 1, "low_quality")]
    return G.gate(j, checks, warn=("toxic",))


@R.add(f"select doc_id, lang, skip_reason, coalesce(skip_reason = 'toxic', false) as warned from ({_GATE})")
def gate_with_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, d).select("doc_id", "lang", "skip_reason", "warned")


@R.add(f"select coalesce(skip_reason, 'kept') as reason, count(*) as n from ({_GATE}) group by 1")
def gate_skip_counts(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, d).groupBy(F.coalesce("skip_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@R.add("select doc_id from documents where not (length(text) > 3000 or trim(text) = '' or contains(lower(text), 'licensed') or source in ('src1', 'src2'))")
def source_quality_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    bad = (F.length("text") > 3000) | (F.trim("text") == "") | X.contains_any(F.lower("text"), ("licensed",)) | F.col("source").isin("src1", "src2")
    return docs.filter(~bad).select("doc_id")


_REVIEW = "case when lang is null or trim(text) = '' then 'rejected_missing' when lang in ('en', 'fr') then 'approved_seed' when n_chars > 4000 then 'approved_probe' else 'rejected' end"


@R.add(f"select doc_id, {_REVIEW} as status, {_REVIEW} in ('approved_seed', 'approved_probe') as include from documents")
def review_seed(spark: SparkSession, d: str) -> DataFrame:
    statuses = [(F.col("lang").isNull() | (F.trim("text") == ""), "rejected_missing"), (F.col("lang").isin("en", "fr"), "approved_seed"), (F.col("n_chars") > 4000, "approved_probe")]
    return G.review(table(spark, d, "documents"), statuses, "rejected", ("approved_seed", "approved_probe")).select("doc_id", "status", "include")


_CANON = "with r as (select doc_id, lang, n_chars, md5(text) as k, case lang when 'en' then n_chars >= 300 when 'de' then n_chars >= 500 else n_chars >= 100 end as ok from documents), w as (select *, coalesce(min(case when ok then doc_id end) over (partition by k) < doc_id, false) as dup from r) select doc_id, lang, case when dup then 'duplicate_of_approved' when lang is null then 'missing_field' when ok then 'approved' else 'bad_match' end as status from w"


def _canonical(spark, d):
    ok = F.when(F.col("lang") == "en", F.col("n_chars") >= 300).when(F.col("lang") == "de", F.col("n_chars") >= 500).otherwise(F.col("n_chars") >= 100)
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", F.md5(F.col("text").cast("binary")).alias("k")).withColumn("ok", ok)
    docs = S.with_duplicate_of_approved(docs, F.col("ok"), [F.col("k")], F.col("doc_id"))
    return G.review(docs, [(F.col("dup"), "duplicate_of_approved"), (F.col("lang").isNull(), "missing_field"), (F.col("ok"), "approved")], "bad_match", ("approved",))


@R.add(_CANON)
def review_canonical(spark: SparkSession, d: str) -> DataFrame:
    return _canonical(spark, d).select("doc_id", "lang", "status")


@R.add(f"select status, count(*) as n from ({_CANON}) group by status")
def review_counts(spark: SparkSession, d: str) -> DataFrame:
    return _canonical(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@R.add("with r as (select doc_id, md5(text) as k, n_chars >= 300 as ok from documents) select doc_id, case when coalesce(min(case when ok then doc_id end) over (partition by k) < doc_id, false) then 'duplicate' when ok then 'approved' else 'bad_match' end as status from r")
def review_once(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("k"), (F.col("n_chars") >= 300).alias("ok"))
    docs = S.with_duplicate_of_approved(docs, F.col("ok"), [F.col("k")], F.col("doc_id"))
    return G.review(docs, [(F.col("dup"), "duplicate"), (F.col("ok"), "approved")], "bad_match", ("approved",)).select("doc_id", "status")


@R.add(f"select doc_id, case when trim(text) = '' then 'rejected_empty' when not contains({folded('text')}, 'on') then 'rejected_missing_term' when contains(lower(text), 'idiot') or contains(lower(text), 'moron') then 'rejected_forbidden_fact' when contains(lower(text), 'licensed') then 'rejected_changes_order' when row_number() over (partition by md5(text) order by doc_id) > 1 then 'rejected_duplicate' else 'approved' end as status from documents")
def review_semantic(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    dup = S.duplicates(docs, [F.md5(F.col("text").cast("binary"))], [F.col("doc_id")])
    marked = docs.withColumn("dup", dup)
    status = G.semantic_status(F.col("text"), F.array(F.lit("on")), F.array(F.lit("idiot")), {"idiot": ["moron"]}, ("licensed",), F.col("dup"))
    return marked.select("doc_id", status.alias("status"))


_ERR = "select conv_id, turn, unnest([case when trim(text) = '' then 'empty response' end, case when role not in ('user', 'assistant') then concat('role ', role) end, case when length(text) > 400 then 'too long' end]) as error from conversations"


def _errors(spark, d):
    checks = [(F.trim("text") == "", "empty response"), (~F.col("role").isin("user", "assistant"), F.concat(F.lit("role "), "role")), (F.length("text") > 400, "too long")]
    return conversations(spark, d).select("conv_id", "turn", F.explode(G.all_errors(checks)).alias("error"))


@R.add(f"select * from ({_ERR}) where error is not null")
def validate_rows(spark: SparkSession, d: str) -> DataFrame:
    return _errors(spark, d)


@R.add(f"select error, count(*) as n from ({_ERR}) where error is not null group by error")
def validate_totals(spark: SparkSession, d: str) -> DataFrame:
    return _errors(spark, d).groupBy("error").agg(F.count("*").alias("n"))


@R.add(f"select * from (select doc_id, unnest([case when row_number() over (partition by md5(text) order by doc_id) > 1 then 'duplicate' end, case when not contains({folded('text')}, 'tion') then 'missing tion' end, case when contains({folded('text')}, 'idiot') then 'forbidden idiot' end]) as error from documents) where error is not null")
def validate_paraphrase(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    docs = docs.withColumn("dup", S.duplicates(docs, [F.md5(F.col("text").cast("binary"))], [F.col("doc_id")]))
    checks = [(F.col("dup"), "duplicate"), (~G.has_term(F.col("text"), "tion"), "missing tion"), (G.has_term(F.col("text"), "idiot"), "forbidden idiot")]
    return docs.select("doc_id", F.explode(G.all_errors(checks)).alias("error"))


@R.add("with p as (select conv_id, turn, role, lead(role) over w as r2, text, lead(text) over w as t2 from conversations window w as (partition by conv_id order by turn)) select * from (select conv_id, turn, unnest([case when not (role = 'user' and r2 = 'assistant') then 'roles out of order' end, case when trim(text) = '' or trim(t2) = '' then 'blank content' end]) as error from p where r2 is not null) where error is not null")
def validate_chat(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    p = conversations(spark, d).withColumn("r2", F.lead("role").over(w)).withColumn("t2", F.lead("text").over(w)).filter("r2 is not null")
    m = F.array(F.struct(F.lit("system").alias("role"), F.lit("s").alias("content")), F.struct(F.col("role").alias("role"), F.col("text").alias("content")), F.struct(F.col("r2").alias("role"), F.col("t2").alias("content")))
    return p.select("conv_id", "turn", F.explode(G.chat_contract(m)).alias("error"))


@R.add("select item_id, case when item_id is null then 'missing id' when trim(text) = '' then 'missing text' when length(text) > 600 then 'too long' end as invalid from benchmark")
def invalid_cases(spark: SparkSession, d: str) -> DataFrame:
    reason = G.first_reason([(F.col("item_id").isNull(), "missing id"), (F.trim("text") == "", "missing text"), (F.length("text") > 600, "too long")])
    return table(spark, d, "benchmark").select("item_id", reason.alias("invalid"))
