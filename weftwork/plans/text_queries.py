"""Sources, projections and text functions over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftwork.functions import text as X
from weftwork.operators import sft
from weftwork.operators.ranking import shared_folder
from weftwork.plans.base import UTT, Registry, conversations, folded, norm, table, users, utterances
from weftwork.sources import io

R = Registry()


@R.add(f"select doc_id, {norm('text')} as text from documents")
def norm_ws(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.norm_ws(F.col("text")).alias("text"))


@R.add(f"select conv_id, turn, {folded('text')} as folded from conversations")
def fold_text(spark: SparkSession, d: str) -> DataFrame:
    return conversations(spark, d).select("conv_id", "turn", X.fold(F.col("text")).alias("folded"))


@R.add("select doc_id, text as repaired from documents")
def repair_mojibake(spark: SparkSession, d: str) -> DataFrame:
    """Texts are damaged as Latin-1 first; those that fit are repaired to what they were."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    damaged = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return docs.select("doc_id", X.repair_mojibake(damaged).alias("repaired"))


_SPELL3 = "replace(replace(replace(lower(text), chr(160), ' '), 'i''d', 'i would'), 'can''t', 'cannot')"
_SPELL4 = "replace(replace(replace(replace(replace(lower(text), chr(160), ' '), 'i''d', 'i would'), 'what''s', 'what is'), 'it''s', 'it is'), 'that''s', 'that is')"


def _chain(start: str, *steps: tuple[str, str]) -> str:
    for pattern, to in steps:
        start = f"regexp_replace({start}, '{pattern}', '{to}', 'g')"
    return start


_ORDER = ((r"\btake out\b", "takeout"), (r"\bpick up\b", "pickup"))
_PEOPLE = (r"\bfor\s+(?:one|two|three|\d+)\s+(?:person|people)\b", " for qty people ")
_TIDY = ((r"\s+", " "), ("^ | $", ""))
_V3 = _chain(_SPELL3, (r"[^a-z0-9\s]", " "), (r"\b(?:hi|hello|hey|assistant|please|yeah|oh|okay|ok)\b", " "), (r"\b(?:i would like to|i want to|i need to|can you help me with|can you help me)\b", " "), *_ORDER, _PEOPLE, *_TIDY)
_V4 = _chain(_SPELL4, (r"[^a-z0-9\s]", " "), *_ORDER, *_TIDY)
_TARGET = _chain("lower(text)", ("[^a-zçğıöşü$'' -]", " "), *_TIDY)


def _keys(spark, d, variant):
    return conversations(spark, d).select("conv_id", "turn", X.norm_key(F.col("text"), variant).alias("key"))


@R.add(f"select conv_id, turn, {_V3} as key from conversations")
def norm_key_v3(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d, "v3")


@R.add(f"select conv_id, turn, {_V4} as key from conversations")
def norm_key_v4(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d, "v4")


@R.add(f"select conv_id, turn, {_TARGET} as key from conversations")
def norm_key_target(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d, "target")


@R.add(f"select conv_id, turn, cast(len(list_filter(string_split({_V4}, ' '), lambda x: x <> '' and x not in ('the', 'of', 'and'))) as int) as n from conversations")
def word_count(spark: SparkSession, d: str) -> DataFrame:
    return conversations(spark, d).select("conv_id", "turn", X.word_count(X.norm_key(F.col("text")), ("the", "of", "and")).alias("n"))


@R.add("select conv_id, turn, contains(lower(text), 'tion') or contains(lower(text), 'und') as phrase, regexp_matches(lower(text), '(?:^|[^\\p{L}\\p{N}_])the(?:$|[^\\p{L}\\p{N}_])') or regexp_matches(lower(text), '(?:^|[^\\p{L}\\p{N}_])que(?:$|[^\\p{L}\\p{N}_])') as pattern from conversations")
def contains_any(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    return conversations(spark, d).select("conv_id", "turn", X.contains_any(low, ("tion", "und")).alias("phrase"), (low.rlike(r"\bthe\b") | low.rlike(r"\bque\b")).alias("pattern"))


@R.add("select role, trim(regexp_replace(upper(concat(' -', role, '? ')), '[^A-Z0-9]+', '_', 'g'), '_') as label, count(*) as n from conversations group by role")
def speaker_labels(spark: SparkSession, d: str) -> DataFrame:
    return conversations(spark, d).groupBy("role", X.norm_label(F.concat(F.lit(" -"), "role", F.lit("? "))).alias("label")).agg(F.count("*").alias("n"))


_TERMS = ("tion", "Der", "öau", "que")


@R.add(f"select doc_id, list_filter(['tion','Der','öau','que'], lambda t: not contains({folded('text')}, {folded('t')})) as missing, list_filter(['tion','Der','öau','que'], lambda t: contains({folded('text')}, {folded('t')})) as present from documents")
def term_check(spark: SparkSession, d: str) -> DataFrame:
    terms = F.array(*[F.lit(t) for t in _TERMS])
    return table(spark, d, "documents").select("doc_id", X.missing_terms(F.col("text"), terms).alias("missing"), X.present_terms(F.col("text"), terms).alias("present"))


@R.add("select doc_id, list(w order by i) as words from (select doc_id, w, min(i) as i from (select doc_id, unnest(string_split(text, ' ')) as w, unnest(range(1, len(string_split(text, ' ')) + 1)) as i from documents) group by doc_id, w) group by doc_id")
def ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.ordered_distinct(F.split("text", " ")).alias("words"))


@R.add(r"select doc_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '```[a-z]*', '', 'g'), chr(10)), lambda s: trim(regexp_replace(s, '^\s*(?:[-*•]|\d+[.)])\s+', ''))), lambda s: not starts_with(lower(s), 'the ') and s <> ''), ' ') as cleaned from documents")
def clean_output(spark: SparkSession, d: str) -> DataFrame:
    wrapped = F.concat(F.lit("<think>plan\nmore</think>"), "text")
    return table(spark, d, "documents").select("doc_id", X.clean_output(wrapped, ("the ",)).alias("cleaned"))


_HTML = _chain("html", (r"(?is)<script[^>]*>.*?</script>", " "), (r"(?is)<style[^>]*>.*?</style>", " "), (r"(?s)<!--.*?-->", " "), (r"(?s)<[^>]*>", " "))


@R.add("select page_id, " + norm(_chain(_HTML, (r"(?m)^#{1,6}\s*", ""), (r"\*\*|__|`", ""), (r"(?m)^\s*[-*]\s+", ""))) + " as text from pages")
def strip_markdown(spark: SparkSession, d: str) -> DataFrame:
    text = X.replaced(F.col("html"), [(r"(?is)<script[^>]*>.*?</script>", " "), (r"(?is)<style[^>]*>.*?</style>", " "), (r"(?s)<!--.*?-->", " "), (r"(?s)<[^>]*>", " ")])
    return table(spark, d, "pages").select("page_id", X.strip_markdown(text).alias("text"))


@R.add("select p_partkey, printf('%.2f TL', p_retailprice) as price from part")
def price_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.price_text(F.col("p_retailprice")).alias("price"))


@R.add("select conv_id, turn, coalesce(length(trim(text)) > 0 and length(text) > 5, false) as ok from conversations")
def nonempty_flag(spark: SparkSession, d: str) -> DataFrame:
    return conversations(spark, d).select("conv_id", "turn", X.nonempty(F.col("text"), 5).alias("ok"))


@R.add("select conv_id, string_agg(concat(case role when 'user' then 'Müşteri' when 'assistant' then 'Garson' else role end, ': ', text), chr(10) order by turn) || chr(10) || 'Garson:' as transcript from conversations group by conv_id")
def render_transcript(spark: SparkSession, d: str) -> DataFrame:
    m = conversations(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return m.select("conv_id", X.render_transcript(F.col("m"), {"user": "Müşteri", "assistant": "Garson"}, "\nGarson:").alias("transcript"))


@R.add("with p as (select p_type, list(distinct p_name order by p_name) as names from part group by p_type) select p_type, case len(names) when 0 then '' when 1 then names[1] else concat(array_to_string(names[1:len(names)-1], ', '), ' veya ', names[len(names)]) end as names from p")
def name_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_type").agg(F.array_sort(F.collect_set("p_name")).alias("n")).select("p_type", X.name_list(F.col("n")).alias("names"))


# Sources and projections


@R.add(f"select conv_id, turn, {norm('text')} as text from conversations where role = 'user' and regexp_matches(text, '[\\p{{L}}\\p{{N}}]')")
def clean_turns(spark: SparkSession, d: str) -> DataFrame:
    return users(spark, d).select("conv_id", "turn", X.clean_text(F.col("text")).alias("text")).filter("text is not null")


def _dialogues(spark, d):
    u = F.struct(F.col("turn").alias("index"), F.upper("role").alias("speaker"), *[F.lit(None).cast("string").alias(n) for n in ("role", "participant", "author")], F.col("text"), *[F.lit(None).cast("string").alias(n) for n in ("utterance", "transcript", "content")])
    c = conversations(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(u)).alias("utterances"))
    return c.select(F.lit("").alias("conversation_id"), F.col("conv_id").cast("string").alias("id"), F.lit(None).cast("string").alias("dialogue_id"), "utterances")


@R.add(f"select cast(conv_id as varchar) as conversation_id, turn as turn_index, {norm('text')} as original_text from conversations where role = 'user' and regexp_matches(text, '[\\p{{L}}\\p{{N}}]')")
def extract_user_turns(spark: SparkSession, d: str) -> DataFrame:
    return io.extract_turns(_dialogues(spark, d))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@R.add("select cast(conv_id as varchar) as id, count(*) as turns, cast(sum(length(text)) as bigint) as chars from conversations group by conv_id")
def dialogue_scan(spark: SparkSession, d: str) -> DataFrame:
    """Dialogues written as files of one JSON array each, and scanned by byte ranges."""
    file = Window.partitionBy("file").orderBy("id")
    texts = _dialogues(spark, d).select("id", F.pmod(F.hash("id"), F.lit(4)).alias("file"), F.to_json(F.struct("*")).alias("j")).withColumn("n", F.row_number().over(file)).withColumn("last", F.count("*").over(Window.partitionBy("file")))
    line = F.concat(F.when(F.col("n") == 1, "[").otherwise(""), "j", F.when(F.col("n") == F.col("last"), "]").otherwise(","))
    path = _folder(spark, "dialogues")
    texts.select("file", "n", line.alias("value")).repartition("file").sortWithinPartitions("file", "n").select("file", "value").write.partitionBy("file").text(path)
    back = io.read_dialogues(spark, path).select("id", F.explode("utterances").alias("u"))
    return back.groupBy("id").agg(F.count("*").alias("turns"), F.sum(F.length("u.text")).alias("chars"))


@R.add("with l as (select conv_id % 4 as file, conv_id, turn, row_number() over (partition by conv_id % 4 order by conv_id, turn) as line from conversations) select file, line, case when turn % 7 = 0 then 'bad_json' else 'not_an_object' end as problem from l where turn % 7 <= 1")
def jsonl_bad_lines(spark: SparkSession, d: str) -> DataFrame:
    """Bad lines of written JSON lines, by file and line number."""
    line = F.to_json(F.struct("conv_id", "turn", "text"))
    value = F.when(F.col("turn") % 7 == 0, F.concat(F.lit('{"conv_id": '), F.substring(line, 1, 5))).when(F.col("turn") % 7 == 1, F.concat(F.lit("["), line, F.lit("]"))).otherwise(line)
    path = _folder(spark, "lines")
    rows = conversations(spark, d).select((F.col("conv_id") % 4).alias("file"), "conv_id", "turn", value.alias("value"))
    rows.repartition("file").sortWithinPartitions("file", "conv_id", "turn").select("file", "value").write.partitionBy("file").text(path)
    _, bad = io.read_jsonl(spark, path, "conv_id bigint, turn bigint, text string", "quarantine")
    return bad.select(F.regexp_extract("file", r"file=(\d+)", 1).cast("bigint").alias("file"), "line", "problem")


@R.add("select case when turn % 5 = 0 then 'valid' when turn % 5 = 1 then 'test' else 'train' end as split, count(*) as rows, cast(sum(length(text)) as bigint) as chars from conversations group by 1")
def split_sinks(spark: SparkSession, d: str) -> DataFrame:
    """Splits written twice, the second time a part of them, and read against their manifest."""
    split = F.when(F.col("turn") % 5 == 0, "valid").when(F.col("turn") % 5 == 1, "test").otherwise("train")
    rows, path, names = conversations(spark, d).withColumn("split", split), _folder(spark, "splits"), ("train", "valid", "test")
    io.write_splits(rows, "split", path, names)
    io.write_splits(rows.filter("split <> 'train'"), "split", path, names)
    return io.read_splits(spark, path, "split").groupBy("split").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars"))


@R.add("select case when turn % 7 = 0 then 'bad_json' when turn % 7 = 1 then 'not_an_object' end as problem, count(*) as n, count(case when turn % 7 > 1 then conv_id end) as ids from conversations group by 1")
def jsonl_quarantine(spark: SparkSession, d: str) -> DataFrame:
    line = F.to_json(F.struct("conv_id", "turn", "text"))
    lines = conversations(spark, d).select(F.when(F.col("turn") % 7 == 0, F.concat(F.lit('{"conv_id": '), F.substring(line, 1, 5))).when(F.col("turn") % 7 == 1, F.concat(F.lit("["), line, F.lit("]"))).otherwise(line).alias("value"))
    return io.parse_lines(lines, "conv_id bigint, turn bigint, text string").groupBy("problem").agg(F.count("*").alias("n"), F.count("conv_id").alias("ids"))


@R.add("select conv_id, turn, role, text from conversations")
def jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    lines = conversations(spark, d).select(F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}).alias("value"))
    return io.parse_lines(lines, "conv_id bigint, turn bigint, role string, text string").select("conv_id", "turn", "role", "text")


@R.add("select p_partkey, p_name, p_retailprice from part")
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.to_csv(F.struct("p_partkey", "p_name", "p_retailprice")).alias("line"))
    return rows.select(F.from_csv("line", "p_partkey bigint, p_name string, p_retailprice double").alias("r")).select("r.*")


@R.add("select source_domain, count(*) as n, min(length(text)) as least from (select 'conversations' as source_domain, text from conversations union all select 'documents', text from documents) group by 1")
def union_sources(spark: SparkSession, d: str) -> DataFrame:
    both = io.tag_and_union({"conversations": conversations(spark, d).select("text"), "documents": table(spark, d, "documents").select("text")})
    return both.groupBy("source_domain").agg(F.count("*").alias("n"), F.min(F.length("text")).cast("bigint").alias("least"))


@R.add("select p_name as name, min(p_type) as category, coalesce(min(p_retailprice), 0.0) as price, true as availability from part group by p_name")
def menu_dim(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_type").alias("category"), F.coalesce(F.min("p_retailprice"), F.lit(0.0)).alias("price"))
    return p.withColumn("availability", F.lit(True))


@R.add("select conv_id, turn, coalesce(nullif(case when turn % 3 = 0 then '' else cast(conv_id as varchar) end, ''), concat('conversations_', cast(turn as varchar))) as id, case when turn % 2 = 0 then null else text end as text from conversations")
def coalesce_ids(spark: SparkSession, d: str) -> DataFrame:
    c = conversations(spark, d)
    id_ = X.first_truthy(F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("conv_id").cast("string")), F.concat(F.lit("conversations_"), F.col("turn").cast("string")))
    return c.select("conv_id", "turn", id_.alias("id"), X.first_present((F.col("turn") % 2 == 0, F.lit(None).cast("string")), (F.lit(True), F.col("text"))).alias("text"))


@R.add("select event_id, list_filter([event_type, case when event_id % 2 = 0 then 'even' end, cast(user_id as varchar)], lambda x: x is not null) as names from events")
def annotation_flatten(spark: SparkSession, d: str) -> DataFrame:
    note = lambda c: F.struct(c.alias("name"))
    segments = F.array(F.struct(F.array(note(F.col("event_type")), note(F.when(F.col("event_id") % 2 == 0, "even"))).alias("annotations")), F.struct(F.array(note(F.col("user_id").cast("string"))).alias("annotations")))
    return table(spark, d, "events").select("event_id", X.annotation_names(segments).alias("names"))


@R.add("select conv_id, turn, text, 'pending' as adaptation_status, cast(null as varchar) as adapted_message, false as include from conversations where role = 'user'")
def worksheet(spark: SparkSession, d: str) -> DataFrame:
    return io.to_worksheet(users(spark, d).select("conv_id", "turn", "text"), {"adaptation_status": F.lit("pending"), "adapted_message": F.lit(None).cast("string"), "include": F.lit(False)})


# Records


@R.add("select conv_id, turn, concat('Intent: ', role, chr(10), 'Canonical: ', text, chr(10), 'Keep: ', case when contains(text, 'tion') then 'tion' else '-' end, chr(10), 'Avoid: -') as prompt from conversations")
def paraphrase_prompt(spark: SparkSession, d: str) -> DataFrame:
    keep = F.array_compact(F.array(F.when(F.col("text").contains("tion"), "tion")))
    return conversations(spark, d).select("conv_id", "turn", sft.paraphrase_prompt(F.col("role"), F.col("text"), keep, F.array().cast("array<string>")).alias("prompt"))


@R.add("select conv_id, turn, text as user_text, lead(text) over (partition by conv_id order by turn) as reply, 3 as n, 'system,user,assistant' as roles from conversations qualify role = 'user' and lead(role) over (partition by conv_id order by turn) = 'assistant'")
def chat_records(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = conversations(spark, d).withColumn("reply", F.lead("text").over(w)).withColumn("next", F.lead("role").over(w)).filter("role = 'user' and next = 'assistant'")
    rec = pairs.withColumn("m", sft.chat_record("You take orders.", F.col("text"), F.col("reply")))
    return rec.select("conv_id", "turn", F.col("m")[1]["content"].alias("user_text"), F.col("m")[2]["content"].alias("reply"), F.size("m").alias("n"), F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"))


@R.add("select item_id, '' as response from benchmark where item_id is not null")
def output_template(spark: SparkSession, d: str) -> DataFrame:
    return sft.output_template(table(spark, d, "benchmark"), "item_id")


@R.add("select d.doc_id, d.lang, d.source from documents d join labels l using (doc_id) where l.quality = 1")
def export_reference(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "labels").filter("quality = 1").select("doc_id")
    return sft.export_reference(ids, table(spark, d, "documents"), "doc_id", ["lang", "source"], strict=False)


@R.add("select d.doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def missing_ids(spark: SparkSession, d: str) -> DataFrame:
    return sft.missing_ids(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@R.add("select doc_id, case when toxic = 1 then 'rejected' else lang end as text, coalesce(toxic = 0, true) as used_paraphrase, case when toxic = 1 then ['forbidden'] else [] end as rejections from documents left join labels using (doc_id)")
def final_response(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    reasons = F.when(F.col("toxic") == 1, F.array(F.lit("forbidden: a"), F.lit("forbidden: b"))).otherwise(F.array().cast("array<string>"))
    return j.select("doc_id", sft.final_response(F.lit("rejected"), F.col("lang"), reasons).alias("f")).select("doc_id", "f.*")


@R.add("with i as (select p_name as name, min(p_type) as category, min(p_retailprice) as price, min(p_partkey) as k from part group by p_name) select name, case when k % 3 = 0 then '' else category end as category, case when k % 4 = 0 then 0.0 else price end as price, k % 2 = 0 as availability, case when k % 5 = 0 then [name, upper(name)] else [] end as aliases, '' as description, cast(row_number() over (order by name) - 1 as int) as position from i")
def menu_yaml(spark: SparkSession, d: str) -> DataFrame:
    """A menu written as a YAML list with absent and null fields, and read with defaults."""
    i = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_type").alias("category"), F.min("p_retailprice").alias("price"), F.min("p_partkey").alias("k"))
    part = lambda c, value: F.when(c, value)
    entry = F.struct("name", part(F.col("k") % 3 != 0, F.col("category")).alias("category"), part(F.col("k") % 4 != 0, F.col("price").cast("string")).alias("price"), part(F.col("k") % 2 == 0, F.lit(True)).alias("availability"), part(F.col("k") % 5 == 0, F.array("name", F.upper("name"))).alias("aliases"))
    path = _folder(spark, "menu")
    lines = i.orderBy("name").select(F.concat(F.lit("- "), F.to_json(entry)).alias("value")).coalesce(1)
    spark.createDataFrame([("menu:",)], "value string").coalesce(1).unionByName(lines).coalesce(1).write.text(path)
    return io.dim_from_yaml(spark, path).select("name", "category", "price", "availability", "aliases", "description", "position")


_RECORDS = "with r as (select conv_id * 1000 + turn as id, role, text, turn, text as message, concat('C: ', text) as canonical, [role] as keep, case when turn % 2 = 0 then ['iste'] else [] end as forbid from conversations) select id, list_filter([case when turn % 5 = 1 and trim(message) = '' then 'blank content' end, case when id % 13 = 0 then 'no seed' end, case when turn % 7 = 0 then 'a section is missing' end, case when id % 13 <> 0 and turn % 7 = 0 and not contains('', role) then 'a term to keep is missing' end, case when id % 13 <> 0 and turn % 5 = 0 then 'another paraphrase' end, case when id % 13 <> 0 and turn % 11 = 0 then 'another intent' end], lambda x: x is not null) as errors from r"


@R.add(_RECORDS)
def validate_records(spark: SparkSession, d: str) -> DataFrame:
    """Paraphrase records, some of them spoilt, against their seeds."""
    none = F.array().cast("array<string>")
    c = conversations(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("user_message"), F.lit("add").alias("intent"), F.concat(F.lit("C: "), "text").alias("canonical_response"), F.concat(F.lit("P: "), "text").alias("safe_paraphrase"), F.array("role").alias("must_preserve_terms"), F.when(F.col("turn") % 2 == 0, F.array(F.lit("iste"))).otherwise(none).alias("must_not_introduce"), F.lit("n").alias("notes"), "turn")
    prompt = sft.grounded_prompt(F.col("user_message"), F.col("intent"), F.col("canonical_response"), F.col("must_preserve_terms"), F.col("must_not_introduce"))
    prompt = F.when(F.col("turn") % 7 == 0, F.regexp_replace(prompt, r"(?m)^Korunacak terimler: .*\n", "")).otherwise(prompt)
    said = F.concat(F.col("safe_paraphrase"), F.when(F.col("turn") % 5 == 0, "!").otherwise(""))
    meta = F.struct("id", F.when(F.col("turn") % 11 == 0, "other").otherwise(F.col("intent")).alias("intent"), "notes")
    records = c.select(sft.chat_record("You take orders.", prompt, said).alias("messages"), meta.alias("metadata"))
    return sft.record_errors(records, c.filter("id % 13 <> 0").drop("turn"), "You take orders.").select("metadata.id", "errors")


@R.add("select conv_id, turn, case when role = 'system' then 'S' when contains(text, 'tion') then concat('T:', text) else concat(role, '/', text) end as text from conversations")
def rewrite_messages(spark: SparkSession, d: str) -> DataFrame:
    key = F.when(F.col("role") == "system", "system").otherwise(F.lit("none"))
    return conversations(spark, d).select("conv_id", "turn", sft.rewrite(key, {"system": "S"}, [(F.col("text").contains("tion"), F.concat(F.lit("T:"), "text"))], F.concat("role", F.lit("/"), "text")).alias("text"))


@R.add(f"with u as ({UTT}) select l_orderkey, l_linenumber, [p_name] || [concat(cast(cast(l_quantity as int) as varchar), '.50 TL')] as terms from u")
def extract_terms(spark: SparkSession, d: str) -> DataFrame:
    from weftwork.operators.grounding import extract_terms as terms

    text = F.concat("text", F.lit(" "), F.col("l_quantity").cast("int").cast("string"), F.lit(".50 TL"))
    return utterances(spark, d).select("l_orderkey", "l_linenumber", terms(F.col("p_name"), text).alias("terms"))
