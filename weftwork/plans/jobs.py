"""End-to-end jobs composed of the operators, each one declarative plan over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftwork.functions import text as X
from weftwork.operators import evaluate as E
from weftwork.operators import gates as G
from weftwork.operators import grounding as J
from weftwork.operators import selection as S
from weftwork.operators import sft
from weftwork.operators.ranking import checkpointed, shared_folder
from weftwork.operators.results import answered, ground_messages, reply_kind
from weftwork.operators.rules import Rule, buckets, first_match
from weftwork.plans.base import ITEMS, UTT, Registry, conversations, folded, items, norm, table, utterances
from weftwork.plans.rule_queries import _CASE, RULES
from weftwork.plans.text_queries import _dialogues
from weftwork.sources import io

R = Registry()
IDS = ["l_orderkey", "l_linenumber"]


_TURNS = f"select cast(conv_id as varchar) as conversation_id, turn as turn_index, {norm('text')} as text, {_CASE} as category from conversations where role = 'user' and regexp_matches(text, '[\\p{{L}}\\p{{N}}]')"
_PILOTS = f"""with c as ({_TURNS}), r as (select *, turn_index % 2 as domain, row_number() over (partition by turn_index % 2 order by case when category = 'unclear' then 1 else 0 end, turn_index, conversation_id) as n from c), sheet as (select * from r where n <= 60),
u as (select *, row_number() over (partition by text order by turn_index, conversation_id) as k from sheet), p as (select *, case when category in ('spanish', 'the_word', 'german') and row_number() over (partition by category order by turn_index, conversation_id) = 1 then 0 else 1 end as phase from u where k = 1),
first as (select *, 'diverse' as pilot from p order by phase, case when phase = 0 then case category when 'spanish' then 0 when 'the_word' then 1 else 2 end else 0 end, turn_index, conversation_id limit 15),
rest1 as (select * from sheet where (conversation_id, turn_index) not in (select conversation_id, turn_index from first)),
second as (select *, 'scored' as pilot from rest1 order by case category when 'german' then 0 when 'ends_tion' then 1 else 2 end, length(text), turn_index, conversation_id limit 15),
rest2 as (select *, row_number() over (partition by category order by turn_index, conversation_id) as m from rest1 where (conversation_id, turn_index) not in (select conversation_id, turn_index from second)),
third as (select *, 'capped' as pilot from rest2 where category <> 'unclear' or m <= 4 order by turn_index, conversation_id limit 15),
every as (select conversation_id, turn_index, category, text, pilot from first union all select conversation_id, turn_index, category, text, pilot from second union all select conversation_id, turn_index, category, text, pilot from third),
w as (select *, case when category = 'german' then 'rejected_unsupported' when length(text) < 40 then 'rejected_short' else 'accepted_adapted' end as adaptation_status, case when category <> 'german' and length(text) >= 40 then concat('TR: ', text) end as adapted from every)
select conversation_id, turn_index, category, pilot, adaptation_status, adapted, case when adaptation_status <> 'accepted_adapted' then 'not accepted' when adapted is null then 'no text' end as skip_reason from w"""


@R.add(_PILOTS)
def job_curation(spark: SparkSession, d: str) -> DataFrame:
    """Dialogues to user turns, classes, the best of each domain, a worksheet, three pilots that exclude each other, manual columns, gate reasons."""
    turns = io.extract_turns(_dialogues(spark, d)).withColumn("category", first_match(F.lower("original_text"), RULES))
    best = S.priority_topk(turns.withColumn("domain", (F.col("turn_index") % 2).cast("string")), F.col("domain"), [(F.col("category") == "unclear").cast("int"), F.col("turn_index"), F.col("conversation_id")], {"0": 60, "1": 60})
    sheet, order, key = io.to_worksheet(best, {"adaptation_status": F.lit("pending"), "adapted": F.lit(None).cast("string")}), [F.col("turn_index"), F.col("conversation_id")], ["conversation_id", "turn_index"]
    tagged = lambda df, name: df.select(*key, "category", "original_text", "adaptation_status", "adapted", F.lit(name).alias("pilot"))
    first = checkpointed(tagged(S.diverse_sample(sheet, F.col("category"), ("spanish", "the_word", "german"), 15, [F.col("original_text")], order), "diverse"))
    second = checkpointed(tagged(S.scored_topn(S.exclude_prior(sheet, [first], key), [S.rank_of(F.col("category"), ("german", "ends_tion")), F.length("original_text"), *order], 15), "scored"))
    third = tagged(S.capped_topn(S.exclude_prior(sheet, [first, second], key), F.col("category"), order, 15, {"unclear": 4}), "capped")
    pilots = first.unionByName(second).unionByName(third)
    status = F.when(F.col("category") == "german", "rejected_unsupported").when(F.length("original_text") < 40, "rejected_short").otherwise("accepted_adapted")
    filled = pilots.withColumn("adaptation_status", status).withColumn("adapted", F.when(F.col("adaptation_status") == "accepted_adapted", F.concat(F.lit("TR: "), "original_text")))
    gated = G.gate(filled, [(F.col("adaptation_status") != "accepted_adapted", "not accepted"), (F.col("adapted").isNull(), "no text")])
    return gated.select("conversation_id", "turn_index", "category", "pilot", "adaptation_status", "adapted", "skip_reason")


_SEEDS = f"""with i as ({ITEMS}), v(q) as (values (1), (2), (3)), g as (select i.*, q, concat(q, ' ', name, ' alabilir miyim') as said from i cross join v),
quota as (select * from (select *, row_number() over (partition by category order by position, q) as n from g) where n <= 60),
m as (select *, case when category = 'MEDIUM POLISHED BRASS' and q = 1 then 'Bana bir şey öner' when q = 3 then concat('Bana ', said) else said end as message from quota),
seed as (select *, case when trim(message) = '' then 'rejected_missing' when price < 850 and q = 2 then 'approved_probe' when position % 5 = 0 then 'rejected' else 'approved_seed' end as status from m),
kept as (select *, {folded('message')} as t, replace(replace(message, 'Bana ', ''), concat(' ', name, ' alabilir miyim'), '') as lead from seed where status in ('approved_seed', 'approved_probe')),
c as (select *, case when contains(t, 'oner') then 'recommendation' when contains(t, 'ozet') or contains(t, 'toplam') then 'summarize_order' when contains(t, 'temizle') then 'clear_order' when contains(t, 'iptal') or contains(t, 'cikar') or contains(t, 'sil') then 'remove_item' else 'add_item' end as intent from kept),
r as (select *, case intent when 'add_item' then concat('Ekledim: ', q, ' x ', name, '. Başka bir isteğiniz var mı?') when 'remove_item' then concat('Çıkardım: ', name, '. Başka bir isteğiniz var mı?') when 'recommendation' then concat('Öneri olarak şunları sunabilirim: ', name, '.') when 'summarize_order' then 'Siparişinizde henüz ürün yok.' else 'Siparişiniz temizlendi.' end as reply from c),
ok as (select *, intent = 'add_item' and not starts_with(message, 'Bana') as fits from r), d as (select *, coalesce(min(case when fits then position * 10 + q end) over (partition by reply) < position * 10 + q, false) as dup from ok),
canon as (select *, row_number() over (order by position, q) as rank, printf('mgp_%04d', row_number() over (order by position, q)) as new_id from d where not dup and fits),
s1 as (select *, 'cheap' as stage from canon where price < 900 order by rank limit 4), s2 as (select *, 'two' as stage from canon where q = 2 and rank not in (select rank from s1) order by rank limit 4),
s3 as (select *, 'rest' as stage from canon where rank not in (select rank from s1 union all select rank from s2) order by rank limit 16 - (select count(*) from s1) - (select count(*) from s2)),
picked as (select * from s1 union all select * from s2 union all select * from s3),
p as (select *, case rank % 4 when 0 then concat('Tabii, ', reply) when 1 then concat('Tabii, ', q, ' x ', name) when 2 then 'Hemen.' else concat(reply, ' Fiyatı uygun.') end as paraphrase from picked)
select new_id, stage, message, paraphrase, list_filter([name, regexp_extract(reply, '[0-9]+\\s*x\\s*\\p{{L}}+')], lambda x: x <> '') as terms from p where not (contains(lower(paraphrase), 'fiyatı')) and contains({folded('paraphrase')}, {folded('name')}) and contains({folded('paraphrase')}, {folded("regexp_extract(reply, '[0-9]+\\s*x\\s*\\p{L}+')")})"""


@R.add(_SEEDS)
def job_seed(spark: SparkSession, d: str) -> DataFrame:
    """A menu to templates, quotas, rewrites, reviewed seeds, canonical replies and their review, ids and terms, a staged pick, the semantic gate."""
    dim = items(spark, d)
    grid = J.expand_templates(dim, spark.createDataFrame([(1,), (2,), (3,)], "q int")).withColumn("said", F.concat(F.col("q").cast("string"), F.lit(" "), "name", F.lit(" alabilir miyim")))
    quota = S.head_per_group(grid, F.col("category"), 60, [F.col("position"), F.col("q")])
    message = sft.rewrite(F.concat_ws("/", "category", F.col("q").cast("string")), {"MEDIUM POLISHED BRASS/1": "Bana bir şey öner"}, [(F.col("q") == 3, F.concat(F.lit("Bana "), "said"))], F.col("said"))
    seeds = G.review(quota.withColumn("message", message), [(F.trim("message") == "", "rejected_missing"), ((F.col("price") < 850) & (F.col("q") == 2), "approved_probe"), (F.col("position") % 5 == 0, "rejected")], "approved_seed", ("approved_seed", "approved_probe"))
    kept = G.kept(G.gate(seeds, [(~F.col("include"), "not approved")])).drop("status", "include")
    none = F.array().cast("array<string>")
    replied = kept.withColumn("intent", J.grounded_intent(F.col("message"), F.lit(True), none))
    reply = J.render_reply(reply_kind(F.col("intent")), F.col("name"), F.col("price"), F.col("q"), choices=F.array("name"))
    fits = (F.col("intent") == "add_item") & ~F.col("message").startswith("Bana")
    marked = replied.withColumn("reply", reply).withColumn("fits", fits)
    marked = S.with_duplicate_of_approved(marked, F.col("fits"), [F.col("reply")], F.col("position") * 10 + F.col("q"))
    canonical = G.review(marked, [(F.col("dup"), "duplicate_of_approved"), (F.col("reply").isNull(), "missing_field"), (F.col("fits"), "approved")], "bad_match", ("approved",)).filter("include")
    named = S.assign_ids(canonical, "mgp_%04d", F.col("position"), F.col("q")).withColumn("terms", J.extract_terms(F.col("name"), F.col("reply")))
    picked = S.staged_select(named, [("cheap", F.col("price") < 900, 4), ("two", F.col("q") == 2, 4)], 16, "new_id", ["message", "reply"], [F.col("new_id")])
    turn = F.substring("new_id", 5, 8).cast("int") % 4
    said = F.when(turn == 0, F.concat(F.lit("Tabii, "), "reply")).when(turn == 1, F.concat(F.lit("Tabii, "), F.col("q").cast("string"), F.lit(" x "), "name")).when(turn == 2, "Hemen.").otherwise(F.concat("reply", F.lit(" Fiyatı uygun.")))
    gated = picked.withColumn("paraphrase", said).withColumn("status", G.semantic_status(F.col("paraphrase"), F.col("terms"), F.array(F.lit("fiyatı")), {}, (), F.lit(False)))
    return gated.filter("status = 'approved'").select("new_id", "stage", "message", "paraphrase", "terms")


@R.add(f"with u as (select distinct l_orderkey, l_linenumber, p_name, p_retailprice as price, cast(l_quantity as int) as q, case l_linenumber % 4 when 0 then concat(p_name, ' ne kadar') when 1 then 'Özet' else concat(cast(cast(l_quantity as int) as varchar), ' ', p_name, ' alabilir miyim') end as message from ({UTT}) where l_quantity <= 40), t as (select *, {folded('message')} as t from u), c as (select *, case when contains(t, 'ozet') or contains(t, 'toplam') then 'summarize_order' when contains(t, 'temizle') then 'clear_order' when contains(t, 'iptal') or contains(t, 'cikar') or contains(t, 'sil') then 'remove_item' when contains(t, 'alabilir') then 'add_item' else 'price_question' end as intent from t), r as (select *, case intent when 'summarize_order' then 'Siparişinizde henüz ürün yok.' when 'remove_item' then concat('Çıkardım: ', p_name, '. Başka bir isteğiniz var mı?') when 'add_item' then concat('Ekledim: ', q, ' x ', p_name, '. Başka bir isteğiniz var mı?') when 'price_question' then printf('%s %.2f TL.', p_name, price) else 'Siparişiniz temizlendi.' end as reply from c), k as (select *, intent in ('add_item', 'price_question') as ok from r) select l_orderkey, l_linenumber, p_name, q, intent, reply, case when coalesce(min(case when ok then l_orderkey * 10 + l_linenumber end) over (partition by message, reply) < l_orderkey * 10 + l_linenumber, false) then 'duplicate' when ok then 'approved' else 'bad_match' end as status from k")
def job_preview(spark: SparkSession, d: str) -> DataFrame:
    """Accepted messages to intents, canonical replies, and a review that approves each pair once."""
    plain = F.concat(F.col("q").cast("string"), F.lit(" "), "p_name", F.lit(" alabilir miyim"))
    message = F.when(F.col("l_linenumber") % 4 == 0, F.concat("p_name", F.lit(" ne kadar"))).when(F.col("l_linenumber") % 4 == 1, "Özet").otherwise(plain)
    rows = utterances(spark, d).select(*IDS, "p_name", F.col("p_retailprice").alias("price"), F.col("l_quantity").cast("int").alias("q")).withColumn("message", message).distinct()
    kept = G.kept(G.gate(rows, [(F.col("q") > 40, "too many")])).withColumn("intent", J.grounded_intent(F.col("message"), F.col("l_linenumber") % 4 != 1, F.array().cast("array<string>")))
    replied = kept.withColumn("reply", J.render_reply(reply_kind(F.col("intent")), F.col("p_name"), F.col("price"), F.col("q"))).withColumn("ok", F.col("intent").isin("add_item", "price_question"))
    marked = S.with_duplicate_of_approved(checkpointed(replied), F.col("ok"), [F.col("message"), F.col("reply")], F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return G.review(marked, [(F.col("dup"), "duplicate"), (F.col("ok"), "approved")], "bad_match", ("approved",)).select(*IDS, "p_name", "q", "intent", "reply", "status")


@R.add(f"with e as (select conv_id * 1000 + turn as id, role, text, list_filter([case when trim(text) = '' then 'empty' end, case when length(text) > 1500 then 'too long' end, case when row_number() over (partition by md5(text) order by conv_id * 1000 + turn) > 1 then 'duplicate' end, case when contains({folded('text')}, 'idiot') then 'forbidden' end], lambda x: x is not null) as errors from conversations where role = 'user'), v as (select * from e where len(errors) = 0), s as (select *, row_number() over (order by md5(concat('7:', cast(id as varchar))), id) as n, count(*) over () as total from v), p as (select case when n <= ceil(0.85 * total) then 'train' else 'valid' end as split, * from s) select split, count(*) as records, cast(sum(length(text)) as bigint) as chars, 0 as shared, case when split = 'valid' then count(*) else 0 end as held_out, case when split = 'valid' then count(*) else 0 end as blanks from p group by 1")
def job_sft(spark: SparkSession, d: str) -> DataFrame:
    """Validated turns to chat records, split by seeded hash order, written as JSON lines; ids apart, references and blank outputs of the held-out part."""
    turns = conversations(spark, d).filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    turns = turns.withColumn("dup", S.duplicates(turns, [F.md5(F.col("text").cast("binary"))], [F.col("id")]))
    checks = [(F.trim("text") == "", "empty"), (F.length("text") > 1500, "too long"), (F.col("dup"), "duplicate"), (G.has_term(F.col("text"), "idiot"), "forbidden")]
    seeds = turns.withColumn("errors", G.all_errors(checks)).filter(F.size("errors") == 0).select("id", "text")
    split = checkpointed(S.split_ratio(seeds.withColumn("messages", sft.chat_record("You take orders.", F.col("text"), F.concat(F.lit("Re: "), "text"))), F.col("id"), 7).select("id", "split", "messages"))
    path = f"{shared_folder(spark)}/sft-{uuid.uuid4().hex}"
    parts = {}
    for name in ("train", "valid"):
        io.write_jsonl(split.filter(F.col("split") == name).select(F.struct("id").alias("metadata"), "messages"), f"{path}/{name}")
        parts[name] = io.read_jsonl(spark, f"{path}/{name}", "metadata struct<id:bigint>, messages array<struct<role:string,content:string>>").select("metadata.id", "messages")
    shared = S.leakage(parts["train"], parts["valid"], "id").agg(F.count("*").cast("int").alias("shared"))
    references = sft.export_reference(parts["valid"].select("id"), seeds, "id", ["text"])
    held = references.agg(F.count("*").alias("held_out")).crossJoin(F.broadcast(sft.output_template(references, "id").filter("response = ''").agg(F.count("*").alias("blanks"))))  # one row each
    both = io.tag_and_union(parts, "split").groupBy("split").agg(F.count("*").alias("records"), F.sum(F.length(F.col("messages")[1]["content"])).alias("chars"))
    out = both.crossJoin(F.broadcast(shared)).crossJoin(F.broadcast(held))  # one row each
    return out.select("split", "records", "chars", "shared", *[F.when(F.col("split") == "valid", F.col(c)).otherwise(0).alias(c) for c in ("held_out", "blanks")])


#: Generated rows a category and the sizes of the parts.
_WANTED, _PARTS = {"tion": 60, "german": 40, "other": 50}, {"train": 110, "valid": 20, "test": 20}


@R.add(f"with s as (select conversation_id, turn_index, text from ({_TURNS}) where not (length(text) > 400 or contains(lower(text), 'licensed'))), b as (select *, case when contains(lower(text), 'tion') then 'tion' end as b1, case when contains(lower(text), 'und') or contains(lower(text), 'der ') then 'german' end as b2 from s), src as (select conversation_id, turn_index, bucket from (select conversation_id, turn_index, unnest([b1, b2, 'all']) as bucket from b) where bucket is not null), srcn as (select *, row_number() over (partition by bucket order by turn_index, conversation_id) - 1 as i, count(*) over (partition by bucket) as n from src), i as ({ITEMS}), g as (select i.name, i.position, q, concat(q, ' ', name, ' alabilir miyim') as message, case when i.position % 3 = 0 then 'tion' when i.position % 3 = 1 then 'german' else 'other' end as category from i cross join (values (1), (2), (3), (4), (5), (6)) as v(q)), w as (select * from (select *, row_number() over (partition by category order by q, position) as k from g) where k <= case category when 'tion' then 60 when 'german' then 40 else 50 end), u as (select *, case when category in (select bucket from src) then category else 'all' end as use from w), dealt as (select u.*, conversation_id, turn_index from u join srcn on u.use = srcn.bucket and (u.k - 1) % srcn.n = srcn.i), r as (select *, row_number() over (order by category, q, position) as rank from dealt), p as (select *, case when rank <= 110 then 'train' when rank <= 130 then 'valid' else 'test' end as split from r where rank <= 150) select split, category, conversation_id, turn_index, message, concat(name, case when q > 3 then ' için mutfağa sorup bilgi vereyim.' else ' için isteğinizi aldım.' end) as reply from p")
def job_targeted_sft(spark: SparkSession, d: str) -> DataFrame:
    """Scanned dialogues, filtered and bucketed, dealt in turn to generated rows; acknowledgements, chat records, fixed parts with a manifest, an audit file."""
    path = f"{shared_folder(spark)}/targeted-{uuid.uuid4().hex}"
    turns = io.extract_turns(_dialogues(spark, d))
    good = turns.filter(~((F.length("original_text") > 400) | X.contains_any(F.lower("original_text"), ("licensed",))))
    rules = (Rule("tion", ("tion",)), Rule("german", ("und", "der ")))
    sources = good.select("conversation_id", "turn_index", F.explode(buckets(F.lower("original_text"), rules)).alias("bucket"))
    grid = J.expand_templates(items(spark, d).select("name", "position"), spark.createDataFrame([(q,) for q in range(1, 7)], "q int"))
    category = F.when(F.col("position") % 3 == 0, "tion").when(F.col("position") % 3 == 1, "german").otherwise("other")
    grid = grid.withColumn("message", F.concat(F.col("q").cast("string"), F.lit(" "), "name", F.lit(" alabilir miyim"))).withColumn("bucket", category)
    taken = S.take_distinct(grid, "bucket", _WANTED, [F.col("message")], [F.col("q"), F.col("position")])
    dealt = J.round_robin_join(taken, sources, "bucket", [F.col("q"), F.col("position")], [F.col("turn_index"), F.col("conversation_id")]).select("name", "position", "q", "message", taken["bucket"].alias("category"), "conversation_id", "turn_index")
    reply = J.ack_text(F.col("name"), F.col("q") > 3)
    records = dealt.withColumn("messages", sft.chat_record("You take orders.", F.col("message"), reply))
    split = S.split_fixed(records, [F.col("category"), F.col("q"), F.col("position")], _PARTS).withColumn("row_index", F.col("rank"))
    io.write_splits(split.select("split", "row_index", "messages"), "split", f"{path}/records", tuple(_PARTS))
    audit = ["row_index", "category", "conversation_id", "turn_index"]
    io.write_csv(split, f"{path}/audit", audit)
    back = io.read_splits(spark, f"{path}/records", "split")
    rows = spark.read.csv(f"{path}/audit", header=True, schema="row_index long, category string, conversation_id string, turn_index long")
    return back.join(rows, "row_index").select("split", "category", "conversation_id", "turn_index", F.col("messages")[1]["content"].alias("message"), F.col("messages")[2]["content"].alias("reply"))


_CASES = f"""with c as (select doc_id, text, case when trim(text) = '' then 'no text' when n_chars < 50 then 'too short' end as bad from documents),
o as (select doc_id, coalesce(case when quality is null then 'no response' end, case when row_number() over (partition by doc_id, quality is null order by toxic) > 1 then 'duplicate_key' end) as reason from labels),
j as (select c.*, o.doc_id is null as none from c left join (select * from o where reason is null) o using (doc_id)),
s as (select doc_id, bad, none, list_filter([case when not contains({folded('text')}, 'tion') then 'missing: tion' end, case when contains({folded('text')}, 'idiot') then 'forbidden: idiot' end], lambda x: x is not null) as reasons from j),
t as (select doc_id, case when bad is not null then 'invalid' when none then 'missing' when len(reasons) = 0 then 'passed' else 'failed' end as status, case when bad is not null then [bad] when none then [] else reasons end as why from s)"""


@R.add(f"{_CASES} select 'report' as kind, status as key, cast(count(*) as varchar) as value from t group by status union all select 'report', 'total', cast(count(*) as varchar) from t union all select 'problem', cast(doc_id as varchar), array_to_string(why, '; ') from t where len(why) > 0")
def job_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Cases and outputs checked, matched, scored; the report's figures and a line for each failing case."""
    cases = table(spark, d, "documents").select("doc_id", "text", G.first_reason([(F.trim("text") == "", "no text"), (F.col("n_chars") < 50, "too short")]).alias("bad"))
    outputs = E.valid_outputs(table(spark, d, "labels"), "doc_id", G.first_reason([(F.col("quality").isNull(), "no response")]), [F.col("toxic")]).filter("reason is null").select("doc_id")
    found = E.match_outputs(cases, outputs, "doc_id").withColumnRenamed("status", "match")
    scored = E.score(found, F.col("text"), F.array(F.lit("tion")), F.array(F.lit("idiot")))
    none = F.array().cast("array<string>")
    final = scored.withColumn("status", F.when(F.col("bad").isNotNull(), "invalid").when(F.col("match") == "missing", "missing").otherwise(F.col("status")))
    final = final.withColumn("reasons", F.when(F.col("bad").isNotNull(), F.array("bad")).when(F.col("match") == "missing", none).otherwise(F.col("reasons")))
    figures = E.report(final).drop("pass_rate")
    rows = figures.select(F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in figures.columns])).alias("r")).select(F.lit("report").alias("kind"), "r.key", "r.value").filter("value <> '0' or key = 'total'")
    return rows.unionByName(E.problem_lines(final, "doc_id").select(F.lit("problem").alias("kind"), F.col("doc_id").cast("string").alias("key"), F.col("problems").alias("value")))


@R.add(f"with o as (select lang, n_chars::double as latency, array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '```[a-z]*', '', 'g'), chr(10)), lambda s: trim(regexp_replace(s, '^\\s*(?:[-*•]|\\d+[.)])\\s+', ''))), lambda s: s <> ''), ' ') as reply from documents), a as (select *, contains({folded('reply')}, 'on') and not contains({folded('reply')}, 'idiot') as ok, row_number() over (partition by lang order by latency) - 1 as r, count(*) over (partition by lang) as n from o) select lang, max(n) as n, count(*) filter (ok) as passed, round(count(*) filter (ok) / count(*), 6) as pass_share, round(avg(latency), 4) as mean_latency, max(latency) filter (r = n // 2) as median, max(latency) filter (r = greatest(0, cast(floor(n * 0.95::double) as bigint) - 1)) as p95, min(latency) as least, max(latency) as most from a group by lang")
def job_audit(spark: SparkSession, d: str) -> DataFrame:
    """Outputs cleaned and scored; pass counts and exact latency ranks of each language."""
    raw = table(spark, d, "documents").select("lang", F.col("n_chars").cast("double").alias("latency"), X.clean_output(F.concat(F.lit("<think>plan</think>"), "text")).alias("reply"))
    scored = E.score(raw, F.col("reply"), F.array(F.lit("on")), F.array(F.lit("idiot")))
    stats = E.latency_stats(scored, ["lang"], "latency").drop("n", "mean")
    return E.audit_summary(scored, "lang", F.col("status") == "passed", F.col("latency")).join(stats, "lang")


_SESSIONS = f"""with u as (select distinct l_orderkey, l_linenumber, l_partkey, l_quantity, p_name from ({UTT})),
w as (select l_orderkey as session, row_number() over w as position, cast(l_quantity as int) as q, p_name, first_value(p_name) over w as first_name from u window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity, p_name)),
t as (select session, position, q, case position % 6 when 3 then first_name || ' cikar' when 4 then 'ozet' when 5 then 'siparisi onayla' when 0 then 'sepeti temizle' else q || ' ' || p_name || ' alabilir miyim' end as text from w),
i as ({ITEMS}),
hit as (select session, t.position, i.name as item, i.position as place, i.price, case when starts_with(text, q || ' ' || i.name) then q else 1 end as qty from t join i on contains({folded('text')}, {folded('name')})),
c as (select t.*, case when contains(text, 'siparisi onayla') then 'confirm_order' when contains(text, 'ozet') or contains(text, 'toplam') then 'summarize_order' when contains(text, 'temizle') then 'clear_order' when contains(text, 'iptal') or contains(text, 'cikar') or contains(text, 'sil') then 'remove_item' else 'add_item' end as intent from t),
ops as (select session, position, intent, item, place, price, qty from c join hit using (session, position) where intent in ('add_item', 'remove_item')),
live as (select c.session, c.position, o.item, o.place, o.price, sum(o.qty)::bigint as quantity from c join ops o on o.session = c.session and o.position <= c.position and o.intent = 'add_item'
  where not exists (select 1 from c z where z.session = c.session and z.intent = 'clear_order' and z.position > o.position and z.position <= c.position) and not exists (select 1 from ops r where r.intent = 'remove_item' and r.session = c.session and r.item = o.item and r.position > o.position and r.position <= c.position) group by all),
a as (select c.session, c.position, coalesce(list({{'name': item, 'quantity': quantity, 'price': price}} order by place) filter (item is not null), []) as after, coalesce(sum(price * quantity), 0.0) as total from c left join live using (session, position) group by 1, 2),
b as (select c.*, after, total, coalesce(lag(after) over (partition by c.session order by c.position), []) as before, coalesce((select list(item order by place) from hit h where h.session = c.session and h.position = c.position), []) as names from c join a using (session, position)),
own as (select *, flatten(list_transform(after, lambda o: [o.name, cast(o.quantity as varchar), printf('%.2f', o.price), printf('%.2f', o.price * o.quantity)])) as terms, flatten(list_transform(list_filter(before, lambda o: not list_contains(list_transform(after, lambda x: x.name), o.name)), lambda o: [o.name, cast(o.quantity as varchar), printf('%.2f', o.price)])) as gone from b),
k as (select *, case intent when 'add_item' then list_concat(['Ekledim'], names, terms) when 'remove_item' then list_concat(['Çıkardım'], names, gone) when 'clear_order' then ['temizlendi'] when 'summarize_order' then list_concat(case when len(after) > 0 then ['Toplam', 'TL'] else [] end, terms) else list_concat(case when len(after) > 0 then ['Toplam', 'MVP/demo'] else ['aktif bir siparişiniz görünmüyor', 'Önce'] end, terms) end as keep from own),
r as (select *, list_filter(keep, lambda x, n: list_position(keep, x) = n) as must_preserve from k),
f as (select *, list_concat(must_preserve, terms, [printf('%.2f', total)]) as required from r),
said as (select *, array_to_string(case when position % 2 = 0 then required[:len(required) - 1] else required end, ' ') as said from f)"""


@R.add(f"{_SESSIONS} select session, position, intent, array_to_string(list_transform(after, lambda o: o.quantity || ' x ' || o.name), ', ') as order_text, round(total, 2) as total, must_preserve, len(list_filter(required, lambda x: not contains({folded('said')}, {folded('x')})))::int as missing from said")
def job_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Conversations of orders to mentions, quantities, intents, order states, terms, checks and safe final texts."""
    u = utterances(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "p_name").distinct()
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "p_name")
    n = F.row_number().over(w)
    texts = {3: F.concat(F.first("p_name").over(w), F.lit(" çıkar")), 4: F.lit("Özet"), 5: F.lit("Siparişi onayla"), 0: F.lit("Sepeti temizle")}
    text = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" "), "p_name", F.lit(" alabilir miyim"))
    for k, said in texts.items():
        text = F.when(n % 6 == k, said).otherwise(text)
    messages = u.select(F.col("l_orderkey").alias("session"), n.alias("n"), text.alias("text"))
    results = ground_messages(messages, items(spark, d), "session", ["n"], categories=F.array(F.lit("Menü")))
    results, own = results.withColumn("own", F.concat("must_preserve", "order_terms")), F.col("own")
    paraphrase = F.array_join(F.when(F.col("position") % 2 == 0, F.slice(own, 1, F.size(own) - 1)).otherwise(own), " ")
    done = answered(results, paraphrase)
    order_text = F.array_join(F.transform("after", lambda o: F.concat(o["quantity"].cast("string"), F.lit(" x "), o["name"])), ", ")
    return done.select("session", F.col("position").cast("long").alias("position"), "intent", order_text.alias("order_text"), F.round("total", 2).alias("total"), "must_preserve", F.size("reasons").alias("missing"))
