import contextlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftwork.functions import presets, text as X
from weftwork.operators import evaluate as E
from weftwork.operators import gates as G
from weftwork.operators import grounding as J
from weftwork.operators import orders as O
from weftwork.operators import selection as S
from weftwork.operators.results import answered, ground_messages
from weftwork.operators.rules import Rule, classify, first_match
from weftwork.operators.ranking import global_rank
from weftwork.plans import ground_queries
from weftwork.sources import io, json_array


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize("raw,want", [("İstanbul ÇAY", "istanbul cay"), ("ışık", "isik"), ("Straße", "strasse"), ("é", "e"), ("ñandú", "nandu"), ("", ""), (None, None)])
def test_fold(spark, raw, want):
    assert one(spark, raw, X.fold) == want


@pytest.mark.parametrize("raw,want", [("MenÃ¼", "Menü"), ("Menü", "Menü"), ("plain", "plain"), ("日本", "日本"), (None, None)])
def test_repair_mojibake(spark, raw, want):
    assert one(spark, raw, X.repair_mojibake) == want


@pytest.mark.parametrize("raw,want", [(" a\xa0 b\n", "a b"), ("\xa0", ""), (None, None)])
def test_norm_ws(spark, raw, want):
    assert one(spark, raw, X.norm_ws) == want


def test_norm_keys(spark):
    assert one(spark, "Hi, I'd like a take out for two people, please!", lambda c: X.norm_key(c, "v3")) == "i would like a takeout for qty people"
    assert one(spark, "That's it", lambda c: X.norm_key(c, "v4")) == "that is it"
    assert one(spark, "Thanks, that's it", lambda c: X.norm_key(c, "v4_dedup")) == "that is it"


@pytest.mark.parametrize("raw,want", [(".", None), ("  ", None), (None, None), (" ok ", "ok")])
def test_clean_text(spark, raw, want):
    assert one(spark, raw, X.clean_text) == want


def test_model_output(spark):
    raw = "<think>plan\nx</think>\n```json\n- Merhaba\n2. Evet\n```"
    assert one(spark, raw, X.clean_output) == "Merhaba Evet"
    assert one(spark, "# Başlık\n**koyu** 😀 metin", X.strip_markdown) == "Başlık koyu metin"


def test_name_list(spark):
    for arr, want in ([], ""), (["a"], "a"), (["a", "b"], "a veya b"), (["a", "b", "c"], "a, b veya c"):
        assert one(spark, arr, X.name_list, "array<string>") == want


@pytest.mark.parametrize("text,domain,category,keep", [
    ("Can I reserve a table?", "food", "off_scope_reservation", False),
    ("Step away for minutes", "food", "ask_allergy", True),  # substring matching
    ("How much is it?", "search", "ask_price", False),
    ("How much is it?", "food", "ask_price", True),
    ("hmm", "food", "unclear", False),
    ("I'd like an ayran", "food", "order_item", True),
])
def test_candidate_rules(spark, text, domain, category, keep):
    df = spark.createDataFrame([(text, domain)], "t string, d string")
    got = df.select(classify(F.lower("t"), presets.CANDIDATE_RULES, presets.CANDIDATE_DEFAULT, keep_if=F.col("d") == "food").alias("c")).first()["c"]
    assert (got["category"], got["keep"]) == (category, keep)


def test_word_mode(spark):
    rules = (Rule("nut", ("nut",)),)
    assert one(spark, "five minutes", lambda c: first_match(c, rules)) == "nut"
    assert one(spark, "five minutes", lambda c: first_match(c, rules, mode="word")) == "unclear"


@pytest.mark.parametrize("text,want", [("the total for three people", "ask_price"), ("price range please", None), ("without onions", "modify_order"), ("i want it with cheese", "modify_order"), ("with cheese", None)])
def test_strict_rules(spark, text, want):
    assert one(spark, text, lambda c: first_match(c, presets.STRICT_RULES, None)) == want


@pytest.mark.parametrize("text,want", [("2 adet çay", 2), ("çay iki tane", 2), ("çay 3", 3), ("üç çay", 3), ("çay", 1), ("bir (özel) çay", 1)])
def test_quantity(spark, text, want):
    assert one(spark, text, lambda c: J.extract_quantity(c, F.lit("çay"))) == want


def test_reply_intents(spark):
    cases = {"Merhaba": "greeting", "": "empty", "2 çay": "add_order", "çay ne kadar": "ask_price", "çay": "menu_detail", "tümünü iptal": "clear_order", "iptal": "remove_order", "bla": "fallback"}
    df = spark.createDataFrame([(t, "çay" in t, w) for t, w in cases.items()], "t string, h boolean, w string")
    assert [r["w"] for r in df.select("w", J.reply_intent(F.col("t"), F.col("h")).alias("g")).filter("g <> w").collect()] == []


def test_mentions_in_both_ways(spark):
    dim = spark.createDataFrame([("a", "ay", 1), ("b", "ayran", 2), ("c", "çay", 0)], "item_id string, name string, position int")
    texts = spark.createDataFrame([(1, "Ayran lütfen"), (2, "ÇAY"), (3, "su"), (4, None)], "id int, text string")
    small = J.mention_join(texts, J.surfaces(dim), ["id"])
    large = J.mention_join(texts, J.surfaces(dim), ["id"], few=1)
    want = {(1, "a"), (1, "b"), (2, "a"), (2, "c")}
    assert {(r["id"], r["item"]) for r in small.collect()} == want == {(r["id"], r["item"]) for r in large.collect()}


def step_by_step(ops):
    state = {}
    for s, item, op, q, *_ in sorted(ops, key=lambda r: r[4]):
        mine = state.setdefault(s, {})
        if op == "clear":
            mine.clear()
        elif op == "add":
            mine[item] = mine.get(item, 0) + max(1, q)
        elif op == "remove":
            mine.pop(item, None)
        elif item in mine:
            if q <= 0:
                mine.pop(item)
            else:
                mine[item] = q
    return {(s, i, q) for s, m in state.items() for i, q in m.items()}


@pytest.mark.parametrize("seed", range(3))
def test_order_fold_equals_steps(spark, seed):
    rnd = random.Random(seed)
    ops = [(rnd.randrange(4), rnd.randrange(3), rnd.choice(["add", "add", "update", "remove", "clear"]), rnd.randrange(-1, 4), n) for n in range(120)]
    df = spark.createDataFrame(ops, "s long, i long, op string, q long, n long")
    got = {tuple(r) for r in O.fold_orders(df, "s", "i", "op", "q", ["n"]).collect()}
    assert got == step_by_step(ops)


def alerts_one_by_one(rows, threshold, skip):
    rest, out = {}, []
    for k, n, s in sorted(rows, key=lambda r: r[1]):
        if rest.get(k, 0) > 0:
            rest[k] -= 1
        elif s is not None and s >= threshold:
            rest[k] = skip
            out.append((k, n))
    return sorted(out, key=str)


@pytest.mark.parametrize("skip,share", [(0, 0.5), (3, 0.2), (25, 0.9), (25, 0.02), (80, 0.3)])
def test_cooldown_over_chunks(spark, skip, share):
    """A key with most readings lies in several ranges."""
    rnd = random.Random(skip)
    rows = [(rnd.choice(["hot", "hot", "hot", "a", None]), i, None if rnd.random() < 0.03 else rnd.random()) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, n long, s double")
    got = O.cooldown_alerts(df.repartition(5), "k", ["n"], "s", 1 - share, skip)
    assert sorted(((r.k, r.n) for r in got.collect()), key=str) == alerts_one_by_one(rows, 1 - share, skip)


def test_cooldown_chunk_states():
    """One chunk in batches, from every entry, against a walk."""
    rnd = random.Random(1)
    for skip in (0, 1, 4, 9):
        for share in (0.1, 0.5, 1.0):
            hits = [rnd.random() < share for _ in range(60)]
            chunk, at, found = O._Chunk(skip), 0, []
            while at < 60:
                n = rnd.choice([1, 2, 7, 20])
                own = hits[at : at + n]
                found += [(at + p, r) for p, entries in chunk.add(np.flatnonzero(own), len(own)) for r in entries]
                at += n
            for r in range(skip + 1):
                rest, want = r, []
                for i, h in enumerate(hits):
                    if rest:
                        rest -= 1
                    elif h:
                        rest = skip
                        want.append(i)
                assert sorted(p for p, e in found if e == r) == want and chunk.ends()[r] == rest


def test_steps_are_one_row_an_operation(spark):
    rnd = random.Random(11)
    ops = [(rnd.randrange(3), rnd.randrange(4), rnd.choice(["add", "add", "update", "remove", "clear"]), rnd.randrange(-1, 4), n) for n in range(300)]
    got = {r.n: (r.i, r.op, r.before, r.after) for r in O.before_after(spark.createDataFrame(ops, "s long, i long, op string, q long, n long"), "s", "i", "op", "q", ["n"]).collect()}
    assert len(got) == 300
    state = {}
    for s, i, op, q, n in ops:
        mine = state.setdefault(s, {})
        before = sum(mine.values()) if op == "clear" else mine.get(i, 0)
        if op == "clear":
            mine.clear()
        elif op == "add":
            mine[i] = mine.get(i, 0) + max(1, q)
        elif op == "remove" or i in mine and q <= 0:
            mine.pop(i, None)
        elif i in mine:
            mine[i] = q
        assert got[n] == ((None, op, before, 0) if op == "clear" else (i, op, before, mine.get(i, 0)))


def test_clears_take_each_item_of_a_session(spark):
    rnd = random.Random(12)
    ops = [(rnd.randrange(3), rnd.randrange(4), rnd.choice(["add", "add", "update", "remove", "clear"]), rnd.randrange(-1, 4), n) for n in range(300)] + [(7, 0, "clear", 0, 300)]
    got = sorted((r.n, r.i, r.op, r.before, r.after) for r in O.item_steps(spark.createDataFrame(ops, "s long, i long, op string, q long, n long"), "s", "i", "op", "q", ["n"]).collect())
    known, state, want = {s: sorted({i for t, i, op, *_ in ops if t == s and op != "clear"}) for s in (0, 1, 2, 7)}, {}, []
    for s, i, op, q, n in ops:
        mine = state.setdefault(s, {})
        for k in known[s] if op == "clear" else [i]:
            before = mine.get(k, 0)
            if op == "add":
                mine[k] = before + max(1, q)
            elif op in ("clear", "remove") or q <= 0:
                mine.pop(k, None)
            elif before:
                mine[k] = q
            want.append((n, k, "remove" if op == "clear" else op, before, mine.get(k, 0)))
    assert got == sorted(want) and len(got) > 400


def test_repeated_texts_are_worked_on_once(spark, monkeypatch):
    """Whether they are broadcast or not; null texts stay."""
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else "ab" if i % 5 < 4 else f"c{i}") for i in range(50)], "n long, t string")
    seen = []

    def work(texts):
        seen.append(texts.count())
        return texts.withColumn("long", F.length("t"))

    for most in (100, 2):
        with monkeypatch.context() as m:
            m.setattr(J, "small", lambda df, real=J.small, most=most: real(df, most))
            got = sorted((r.n, r.t, r.long) for r in J.per_text(rows, "t", work).collect())
        assert got == [(r.n, r.t, r.t and len(r.t)) for r in rows.orderBy("n").collect()]
    assert seen == [12, 12]


def test_info_topics_start_words(spark, tmp_path):
    """Letters inside a word ask nothing; endings may follow a phrase, and a whole query agrees with its SQL on such texts."""
    route = lambda raw, mode: one(spark, raw, lambda c: J.route_info(c, {}, mode=mode)["topic"])
    assert [route(x, "start") for x in ("of aneredea, onereded", "Neredesiniz?", "bu ADRESE kurye", "ankonum (konumu)", None)] == [None, "location", "delivery", "location", None]
    assert route("of aneredea", "substring") == "location"
    spark.createDataFrame([(k, 1, "user", "nt aneredea and") for k in range(3)], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted((r.conv_id, r.topic, r.answer) for r in ground_queries.info_router(spark, str(tmp_path)).collect())
    assert got == [(0, "payment", "Kart geçiyor."), (1, "location", "Bu bilgi elimde yok."), (2, None, None)]


def test_first_crossing_and_spans(spark):
    rnd = random.Random(5)
    base = 1_700_000_000
    readings = [(rnd.randrange(6), base + rnd.randrange(40_000), rnd.random()) for _ in range(900)]
    mutes = [(rnd.randrange(6), (a := base + rnd.randrange(40_000)), a + rnd.choice([0, 5, 900, 4000, 20_000])) for _ in range(60)] + [(9, base, base + 1)]
    r = spark.createDataFrame(readings, "s long, at long, score double").select("s", F.timestamp_seconds("at").alias("ts"), "score")
    m = spark.createDataFrame(mutes, "s long, a long, b long").select("s", F.timestamp_seconds("a").alias("mute_start"), F.timestamp_seconds("b").alias("mute_end"))
    want = {}
    for s in range(6):
        mine = sorted((t, v) for k, t, v in readings if k == s)
        for t, v in mine:
            if v >= 0.7 and t <= mine[0][0] + 30_000 and not any(k == s and a <= t <= b for k, a, b in mutes):
                want[s] = (t, v)
                break
    got = O.first_crossing(r, m, "s", "ts", "score", 0.7, 30_000).selectExpr("s", "unix_seconds(crossed_at) as at", "score").collect()
    assert {x.s: x["at"] for x in got} == {s: t for s, (t, _) in want.items()} and len(want) > 3


def test_a_session_of_many_spans(spark):
    """100,000 spans and readings of one session: a product of the two would have ten thousand million rows."""
    n = 100_000
    r = spark.range(n).select(F.lit(1).alias("s"), F.timestamp_seconds(F.col("id") * 2 + 1_700_000_000).alias("ts"), F.lit(1.0).alias("score"))
    m = spark.range(n).select(F.lit(1).alias("s"), F.timestamp_seconds(F.col("id") * 2 + 1_700_000_000).alias("mute_start"), F.timestamp_seconds(F.col("id") * 2 + 1_700_000_001).alias("mute_end")).filter(F.col("mute_start") < F.timestamp_seconds(F.lit(1_700_000_000 + 2 * n - 10)))
    got = O.first_crossing(r, m, "s", "ts", "score", 0.5, 10**7).selectExpr("unix_seconds(crossed_at) as at").collect()
    assert [x["at"] for x in got] == [1_700_000_000 + 2 * n - 10]


@pytest.mark.parametrize("values", [[5.0], [float(i) for i in range(20)], [1.0, 1.0, 2.0, 9.0]])
def test_latency(spark, values):
    r = E.latency_stats(spark.createDataFrame([("k", v) for v in values] + [("k", None)], "k string, v double"), ["k"], "v").first()
    s, n = sorted(values), len(values)
    assert (r["median"], r["p95"], r["n"]) == (s[n // 2], s[max(0, int(n * 0.95) - 1)], n)


def test_outputs_first_valid_wins(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, "a", "y"), (4, "b", "z")], "line int, id string, response string")
    got = E.valid_outputs(df, "id", G.first_reason([(F.col("response").isNull(), "no response")]), [F.col("line")])
    assert {r["line"]: r["reason"] for r in got.collect()} == {1: "no response", 2: None, 3: "duplicate_key", 4: None}


def test_gate_keeps_null_flags_out(spark):
    df = spark.createDataFrame([(1, None), (2, True), (3, False)], "id int, ok boolean")
    got = G.gate(df, [(~F.coalesce(F.col("ok"), F.lit(False)), "not approved")])
    assert [r["id"] for r in G.kept(got).collect()] == [2]
    assert got.filter("skip_reason is not null").count() + 1 == df.count()


def test_duplicates_without_a_window(spark):
    """As by a window, null keys and null ``ok`` included, and no task has all rows of a common key."""
    rnd = random.Random(3)
    rows = [(n, rnd.choice(["a", "a", "a", "b", None]), rnd.choice([True, False, None])) for n in range(200)] + [(200 + n, "free", False) for n in range(50)]
    df = spark.createDataFrame(rows, "n long, k string, ok boolean")
    got = S.with_duplicate_of_approved(df, F.col("ok"), [F.col("k")], F.col("n"))
    want = df.withColumn("dup", S.duplicate_of_approved(F.col("ok"), [F.col("k")], F.col("n")))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "BroadcastHashJoin" in plan


def test_duplicate_of_approved(spark):
    df = spark.createDataFrame([(1, "p", False), (2, "p", True), (3, "p", True), (4, "q", True)], "n int, k string, ok boolean")
    got = df.select("n", S.duplicate_of_approved(F.col("ok"), [F.col("k")], F.col("n")).alias("d"))
    assert [r["n"] for r in got.filter("d").collect()] == [3]


def test_quotas(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)] + [(99, "z")], "n int, c string")
    got = S.quota_sample(df, F.col("c"), {"b": 2, "a": 50, "none": 3}, [F.col("n")])
    assert got.filter("c = 'b'").count() == 2 and got.filter("c = 'a'").count() == 5 and got.filter("c = 'z'").count() == 0
    assert S.priority_topk(df, F.col("c"), [F.col("n")], {"a": 0}).count() == 0
    with pytest.raises(ValueError):
        S.take_distinct(df, "c", {"z": 2}, [F.col("n")], [F.col("n")])


def staged_one_by_one(rows, stages, n):
    """rows: (id, pair, score, kind) in the order of their score."""
    ids, pairs, out = set(), set(), []
    for name, kinds, limit in [*stages, ("rest", None, n)]:
        own, take = {}, min(limit, n - len(out))
        for r in rows:
            if (kinds is None or r[3] in kinds) and r[0] not in ids and r[1] not in pairs and r[1] not in own:
                own[r[1]] = r
        best = sorted(own.values(), key=lambda r: r[2])[: max(0, take)]
        ids |= {r[0] for r in best}
        pairs |= {r[1] for r in best}
        out += [(name, r[2]) for r in best]
    return out


@pytest.mark.parametrize("seed,ids,pairs", [(0, 400, 300), (1, 30, 300), (2, 400, 25), (3, 25, 25), (4, 12, 400)])
def test_staged_select(spark, seed, ids, pairs):
    """Also where ids and pairs repeat so often that the first candidates do not do."""
    rnd = random.Random(seed)
    rows = [(rnd.randrange(ids), f"p{rnd.randrange(pairs)}" if rnd.random() < 0.95 else None, i, rnd.choice("abc")) for i in range(600)]
    stages = [("first", "a", 7), ("second", "ab", 4), ("none", "z", 5), ("third", "c", 3)]
    df = spark.createDataFrame(rows, "id int, pair string, score int, kind string")
    conditions = [(name, F.col("kind").isin(*kinds), limit) for name, kinds, limit in stages]
    want = staged_one_by_one(rows, stages, 20)
    if len(want) < 20:
        with pytest.raises(ValueError):
            S.staged_select(df, conditions, 20, "id", ["pair"], [F.col("score")])
    else:
        got = S.staged_select(df.repartition(4), conditions, 20, "id", ["pair"], [F.col("score")])
        assert sorted((r.stage, r.score) for r in got.collect()) == sorted(want)
    with pytest.raises(ValueError):
        S.staged_select(df, conditions, 601, "id", ["pair"], [F.col("score")])


def test_global_rank(spark):
    df = spark.range(1000).withColumn("k", F.pmod(F.col("id") * 7919, F.lit(1000)))
    got = global_rank(df, F.col("k"))
    assert got.filter("rank <> k + 1").count() == 0


def test_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"id": 1, "t": "ç"}\n\n{"id": 2\n[1]\n{"id": null, "t": null}\n', encoding="utf-8")
    good, bad = io.read_jsonl(spark, str(path), "id bigint, t string", "quarantine")
    assert sorted((r["id"] or 0, r["t"]) for r in good.collect()) == [(0, None), (1, "ç")]
    assert sorted(r["problem"] for r in bad.collect()) == ["bad_json", "not_an_object"]
    with pytest.raises(ValueError):
        io.read_jsonl(spark, str(path), "id bigint, t string")
    io.write_jsonl(good, str(tmp_path / "out"))
    assert io.read_jsonl(spark, str(tmp_path / "out"), "id bigint, t string").exceptAll(good).count() == 0


def test_dialogues(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text('[{"conversation_id": "", "id": "x", "utterances": [{"index": 0, "speaker": "USER", "text": " hi "}, {"index": 1, "role": "assistant", "text": "yes"}, {"participant": "customer", "utterance": "."}, {"author": "Customer 2", "content": "soup"}]}]')
    got = io.extract_turns(io.read_dialogues(spark, str(path))).collect()
    assert [(r["conversation_id"], r["turn_index"], r["original_text"]) for r in got] == [("x", 0, "hi"), ("x", 3, "soup")]


@contextlib.contextmanager
def byte_ranges(spark, size):
    keys = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_bad_line_in_a_late_range(spark, tmp_path):
    path = tmp_path / "lines.jsonl"
    lines = ['{"id": %d, "t": "%s"}' % (i, "é" * (i % 50)) if i % 9 else "" for i in range(1, 400)]
    lines[301] = '{"id": 7'
    lines[350] = "[1]"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    with byte_ranges(spark, 3000):
        good, bad = io.read_jsonl(spark, str(path), "id bigint, t string", "quarantine")
        assert good.rdd.getNumPartitions() > 4
        assert [(r.line, r.problem) for r in bad.orderBy("line").collect()] == [(302, "bad_json"), (351, "not_an_object")]
        assert good.count() == sum(bool(x) for x in lines) - 2
        with pytest.raises(ValueError, match="lines.jsonl, line 302: bad_json"):
            io.read_jsonl(spark, str(path), "id bigint, t string")


@pytest.mark.parametrize("size,most", [(1 << 20, 100_000), (97, 100_000), (64, 3), (300, 100_000)])
def test_json_array_by_byte_ranges(spark, tmp_path, monkeypatch, size, most):
    """Braces, brackets, quotes and escapes in strings at every border; a record over many ranges."""
    monkeypatch.setattr(json_array, "MOST_RANGES", most)
    rnd = random.Random(size)
    odd = ["}", "{", "]", "[", '"', "\\", "}]", '\\"}', "é\n", "},{", "plain ", " "]
    want = []
    for f in range(3):
        docs = [{"id": f"{f}-{i}", "utterances": [{"index": k, "speaker": "USER", "text": "".join(rnd.choice(odd) for _ in range(rnd.randrange(12)))} for k in range(rnd.randrange(4))]} for i in range(20)]
        docs.append({"id": f"{f}-long", "utterances": [{"index": 0, "text": "}{" * 700}]})
        (tmp_path / f"{f}.json").write_text(json.dumps(docs, indent=rnd.choice([None, 2]), ensure_ascii=bool(f)), encoding="utf-8")
        want += [(d["id"], [(u["index"], u["text"]) for u in d["utterances"]]) for d in docs]
    (tmp_path / "3.json").write_text(" [ ]\n")
    with byte_ranges(spark, size):
        got = io.read_dialogues(spark, str(tmp_path))
        rows = sorted((r.id, [(u["index"], u["text"]) for u in r.utterances]) for r in got.collect())
        assert rows == sorted(want)
        assert size > 1000 or spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20


def test_parsed_filter_on_json_array(spark, tmp_path):
    """A filter on what is parsed never meets the pieces of a record that crosses byte ranges."""
    docs = [{"id": str(i), "utterances": [{"index": 0, "text": "abc" * 40}]} for i in range(60)]
    (tmp_path / "a.json").write_text(json.dumps(docs))
    with byte_ranges(spark, 700):
        said = io.read_dialogues(spark, str(tmp_path)).select("id", F.explode("utterances").alias("u"))
        assert said.agg(F.count("*"), F.sum(F.length("u.text"))).first() == (60, 60 * 120)


def test_json_ranges_stay_while_executors_join(spark, tmp_path, monkeypatch):
    """The second read has the ranges of the first, though there are more tasks at once by then."""
    (tmp_path / "a.json").write_text(json.dumps([{"id": str(i), "utterances": []} for i in range(200)]))
    key, real, tasks = "spark.sql.leafNodeDefaultParallelism", json_array.checkpointed, [3]

    def joined(df):
        out = real(df)
        tasks[0] += 4
        spark.conf.set(key, str(tasks[0]))
        return out

    monkeypatch.setattr(json_array, "checkpointed", joined)
    with byte_ranges(spark, 100_000):
        spark.conf.set(key, str(tasks[0]))
        try:
            assert io.read_dialogues(spark, str(tmp_path)).count() == 200
        finally:
            spark.conf.unset(key)
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None


@pytest.mark.parametrize("text", ['{"id": "x"}', '[{"id": "x"}', '[{"id": "x"}, 5]', '["a", {"id": "x"}]', '[[{"id": "x"}]]', '[{"id": "x}]'])
def test_json_that_is_no_array_of_objects(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="top is not|does not end|not an object"):
        io.read_dialogues(spark, str(tmp_path)).collect()


def test_yaml_dimension(spark, tmp_path):
    path = tmp_path / "menu.yaml"
    path.write_text("menu:\n- id: 7\n  name: Ayran\n  price: '12.5'\n  tags: null\n  aliases: [yoğurt, 3]\n- name: Su\n  availability: 1\n", encoding="utf-8")
    got = [r.asDict() for r in io.dim_from_yaml(spark, str(path)).orderBy("position").collect()]
    assert got[0] == {"id": "7", "name": "Ayran", "category": "", "description": "", "price": 12.5, "availability": False, "allergens": [], "tags": [], "aliases": ["yoğurt", "3"], "position": 0}
    assert (got[1]["name"], got[1]["price"], got[1]["availability"]) == ("Su", 0.0, True)
    path.write_text("other: 1\n")
    assert io.dim_from_yaml(spark, str(path)).count() == 0
    path.write_text("menu: [5]\n")
    with pytest.raises(ValueError):
        io.dim_from_yaml(spark, str(path))


def test_context_document(spark):
    dim = spark.createDataFrame([("Çay", " ", 15.0, 2), (" Su ", "İçecek", None, 1), (None, "İçecek", 3.0, 0), ("Köfte", "Ana", 150.5, 3)], "name string, category string, price double, position int")
    got = J.context_document(dim, {"Saat": "10-22 ", "Ödeme": ["kart", ""], "Boş": " "}).first().document
    assert got == "Menü kategorileri: Ana, Diğer, İçecek.\nAna: Köfte (150.50 TL).\nDiğer: Çay (15.00 TL).\nİçecek: Su.\nSaat: 10-22.\nÖdeme: kart."
    assert J.context_document(dim.limit(0)).first().document == ""


def test_split_sinks(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "case when id % 10 = 0 then 'valid' else 'train' end as split")
    path = str(tmp_path / "s")
    assert io.write_splits(df, "split", path, ["train", "valid", "test"]) == {"train": 90, "valid": 10, "test": 0}
    assert io.write_splits(df.filter("split = 'valid' and id < 50"), "split", path, ["train", "valid", "test"]) == {"train": 0, "valid": 5, "test": 0}
    assert {r["split"]: r["count"] for r in io.read_splits(spark, path, "split").groupBy("split").count().collect()} == {"train": 90, "valid": 5}
    with pytest.raises(Exception, match="no such split"):
        io.write_splits(df, "split", path, ["train"])
    spark.range(3).selectExpr("id").write.parquet(f"{path}/data/split=test")
    with pytest.raises(ValueError, match="test"):
        io.read_splits(spark, path, "split")


def test_containment_of_many_and_of_short_surfaces(spark):
    texts = spark.createDataFrame([(1, "iki Köfte ve su"), (2, "a"), (3, ""), (4, None), (5, "çay, ayran")], "id long, text string")
    found = spark.createDataFrame([("kofte", 0, "kofte"), ("su", 1, "su"), ("a", 2, "a"), ("ayran", 3, "ayran"), ("cay", 4, "cay")], "item string, position int, surface string")
    few, many = (sorted(map(tuple, J.mention_join(texts, found, ["id"], few=m).collect())) for m in (100, 2))
    assert few == many and (2, "a", 2) in many and (1, "su", 1) in many and (5, "cay", 4) in many and (1, "kofte", 0) in many


@pytest.mark.parametrize("few,most,heavy", [(1000, 1000, 10), (5, 1000, 10), (5, 10, 1_000_000), (5, 10, 3)])
def test_containment_in_every_way(spark, few, most, heavy):
    """In a projection, by broadcast grams, by shuffled grams, and by salted ones."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdé ") for _ in range(rnd.randrange(1, 8)))
    names = sorted({word() for _ in range(60)} | {"a", "bc", "abc", "🙂x", "never there"})
    texts = [(i, " ".join(word() for _ in range(rnd.randrange(6)))) for i in range(150)] + [(150, None), (151, ""), (152, "x🙂x"), (153, "a")] + [(154, "abc")] * 2
    found = spark.createDataFrame([(n, i, n) for i, n in enumerate(names)], "item string, position long, surface string")
    got = J.containing(spark.createDataFrame(texts, "id long, __t string"), found, few=few, most=most, heavy=heavy)
    want = sorted((i, n) for i, t in texts for n in names if t is not None and n in t)
    assert sorted((r.id, r.item) for r in got.collect()) == want
    assert set(got.columns) == {"id", "__t", "item", "position", "surface"}


@pytest.mark.parametrize("few", [100, 1])
def test_mentions_as_an_array(spark, few):
    dim = spark.createDataFrame([(7, "ayran", ["yoğurt suyu", "ay"], 2), (8, "çay", None, 1)], "item_id long, name string, aliases array<string>, position int")
    texts = spark.createDataFrame([(1, "Ayran, ÇAY ve yoğurt suyu"), (2, "su"), (3, None)], "id int, text string")
    got = J.with_mentions(texts, J.surfaces(dim, aliases="aliases"), ["id"], few=few)
    assert {r.id: [(m["position"], m["item"]) for m in r.mentions] for r in got.collect()} == {1: [(1, 8), (2, 7)], 2: [], 3: []}


def test_order_terms_leave_out_what_is_missing(spark):
    df = spark.createDataFrame([([("A", 2, None), ("B", None, 1.5), (None, 1, 3.0)], None), ([], 4.0)], "items array<struct<name:string,quantity:int,price:double>>, total double")
    got = [r.t for r in df.select(J.order_terms(F.col("items"), F.col("total")).alias("t")).collect()]
    assert got == [["A", "2", "B", "1.50", "1", "3.00", "3.00"], ["4.00"]]


def test_grounded_conversations(spark):
    """Against a walk through each session: the order before and after, intents, terms, and which paraphrases are safe."""
    rnd = random.Random(12)
    menu = {"Ayran": (30.0, 1), "Köfte": (150.5, 2), "Künefe": (90.0, 3)}
    dim = spark.createDataFrame([(n, p, k) for n, (p, k) in menu.items()], "name string, price double, position int")
    say = ["2 {} alabilir miyim", "{} ekle", "{} çıkar", "Sepeti temizle", "Özet", "Siparişi onayla", "{} ne kadar", "Pizza var mı", "Merhaba", "Bir şiir yaz"]
    rows = [(s, n, rnd.choice(say[:6] * 2 + say).format(rnd.choice(list(menu)))) for s in range(12) for n in range(15)]
    got = ground_messages(spark.createDataFrame(rows, "session long, n long, text string").repartition(3), dim, "session", ["n"], unavailable={"pizza": "Pizza"}, markers=("var mi",))
    got = answered(got, F.when(F.col("n") % 2 == 0, F.col("canonical")).otherwise(F.array_join(F.concat("must_preserve", "must_include", J.order_terms(F.col("after"), F.col("total"))), " ")))
    at = {(r.session, r.n): r for r in got.collect()}
    assert len(at) == len(rows)
    intents = {"alabilir": "add_item", "ekle": "add_item", "çıkar": "remove_item", "temizle": "clear_order", "Özet": "summarize_order", "onayla": "confirm_order", "ne kadar": "price_question", "Pizza": "unavailable_item", "Merhaba": "greeting", "şiir": "off_topic"}
    state = {}
    for s, n, text in rows:
        r, mine = at[s, n], state.setdefault(s, {})
        before, intent = dict(mine), next(v for k, v in intents.items() if k in text)
        named = [m for m in menu if m in text]
        if intent == "add_item":
            mine[named[0]] = mine.get(named[0], 0) + (2 if text[0] == "2" else 1)
        elif intent == "remove_item":
            mine.pop(named[0], None)
        elif intent == "clear_order":
            mine.clear()
        lines = lambda d: sorted(((m, q, menu[m][0]) for m, q in d.items()), key=lambda x: menu[x[0]][1])
        assert (r.intent, r.position) == (intent, n + 1), text
        assert [tuple(x) for x in r.before] == lines(before) and [tuple(x) for x in r.after] == lines(mine)
        assert r.errors == [] and [m["item"] for m in r.mentions] == named
        total = sum(q * p for _, q, p in lines(mine))
        assert r.total == (pytest.approx(total) if intent in ("add_item", "remove_item", "clear_order", "summarize_order", "confirm_order") else None)
        if n % 2:
            # what is unavailable must be named and must not be introduced, so no paraphrase passes there
            assert (r.used_paraphrase, r.final) == ((False, r.canonical) if intent == "unavailable_item" else (True, r.paraphrase))
        else:
            assert r.final == r.canonical
        if intent == "unavailable_item":
            assert "Pizza" in r.canonical and r.must_preserve == ["bulunmuyor", "Pizza"]
        if intent == "add_item":
            assert r.must_preserve[:2] == ["Ekledim", named[0]] and f"{total:.2f}" in r.must_preserve + [f"{total:.2f}"]


def test_blank_results(spark):
    lit, none = F.lit, F.array().cast("array<string>")
    for blank in ("", "  ", "\t\n", "\xa0", "\u2003", "\x1c"):
        errors = J.grounded_errors(lit("greeting"), lit(blank), lit(0.5), lit(blank), lit(1.0), lit(blank), none, none, lit(False))
        assert spark.range(1).select(errors.alias("e")).first().e == ["empty message", "empty response", "empty menu source"]


@pytest.mark.parametrize("at_most", [10_000, 40, 1])
def test_order_statistics_of_a_large_group(spark, at_most):
    rnd = random.Random(at_most)
    nan, inf = float("nan"), float("inf")
    groups = {"hot": [rnd.lognormvariate(0, 4) for _ in range(3000)], "same": [7.0] * 500, "ends": [-inf, inf, nan, nan, *[rnd.uniform(-1e300, 1e300) for _ in range(300)]], "few": [3.0, 1.0], "ties": [rnd.choice([1.0, 2.0, 1e9]) for _ in range(600)], None: [float(i) for i in range(200)]}
    rows = [(k, v) for k, values in groups.items() for v in values] + [("none", None)]
    rnd.shuffle(rows)
    got = {r.k: r for r in E.latency_stats(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", at_most).collect()}
    assert got.keys() == groups.keys()
    for k, values in groups.items():
        s, n = sorted(values, key=lambda v: (v != v, v)), len(values)
        assert (got[k].n, got[k]["median"], got[k].p95) == (n, s[n // 2], s[max(0, int(n * 0.95) - 1)])


def test_every_category_counts(spark):
    kinds = spark.range(50_001).selectExpr("concat('kat', lpad(cast(id as string), 6, '0'), 'x') as category")
    texts = spark.createDataFrame([(1, "bir kat050000x lütfen"), (2, "kat000007x ve kat000003x"), (3, "yok")], "id long, text string")
    assert sorted(map(tuple, J.extract_category(texts, kinds, ["id"]).collect())) == [(1, "kat050000x"), (2, "kat000003x")]


def test_category_aliases(spark):
    kinds = spark.createDataFrame([("Ana Yemek",), ("Tatlı",)], "category string")
    texts = spark.createDataFrame([(1, "yemekleriniz ne"), (2, "TATLI var mı, yemek de"), (3, "su")], "id long, text string")
    assert sorted(map(tuple, J.extract_category(texts, kinds, ["id"]).collect())) == [(1, "Ana Yemek"), (2, "Tatlı")]


def test_quantity_patterns(spark):
    rows = [("3 köfte", 3), ("iki tane köfte", 2), ("köfte istiyorum 4 adet", 4), ("köfte 5", 5), ("bana 6 adet ver", 6), ("köfte lütfen", 1), ("köfte üç", 3), (None, 1)]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").select("i", J.extract_quantity(F.col("t"), F.lit("Köfte")).alias("q")).collect()
    assert [r["q"] for r in sorted(got)] == [q for _, q in rows]


def test_fold_repairs_what_was_misread(spark):
    rows = [("Menü".encode().decode("latin-1"), "menu"), ("Menü", "menu"), ("ÇAY", "cay"), ("", ""), (None, None)]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").select("i", X.fold(F.col("t")).alias("f")).collect()
    assert [r["f"] for r in sorted(got)] == [f for _, f in rows]


def test_parser_is_pluggable(spark):
    df = spark.createDataFrame([("su",)], "text string")
    assert J.parsed(df, lambda x: x.withColumn("intent", F.lit("add")).withColumn("confidence", F.lit(0.9))).first()["intent"] == "add"
    with pytest.raises(ValueError):
        J.parsed(df, lambda x: x.withColumn("intent", F.lit("add")))


def test_amounts_of_an_order_are_made_once(spark):
    """Line totals are texts once a row, and messages meet their text's mentions; terms that folding changes are found as before."""
    dim = spark.createDataFrame([("çay", 5.0, 1, "çay"), ("kola", 7.5, 2, "kola")], "name string, price double, position int, item_id string")
    said = spark.createDataFrame([(s, n, t) for s in (1, 2) for n, t in enumerate(["2 çay alabilir miyim", "3 kola alabilir miyim", "siparişi onayla"])], "s int, n int, text string")
    done = answered(ground_messages(said, dim, "s", ["n"]), F.array_join(F.concat("must_preserve", "order_terms"), " ")).select("s", "n", "after", "total", "must_preserve", "reasons", "canonical")
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("format_string(%.2f, (") == 1
    rows = {(r.s, r.n): r for r in done.collect()}
    assert len(rows) == 6 and all(not r.reasons for r in rows.values())
    assert rows[2, 2].total == 32.5 and rows[2, 2].must_preserve == ["Toplam", "MVP/demo", "çay", "2", "5.00", "10.00", "kola", "3", "7.50", "22.50"]
    assert "3 x kola = 22.50 TL\nToplam: 32.50 TL" in rows[1, 2].canonical
    terms = spark.createDataFrame([("Iki ÇAY, Ã¼ ve cay", ["cay", "ÇAY", "ÇAy", "ve cay", "iki", "KAHVE", "ü", "Ã¼"])], "c string, t array<string>")
    assert terms.select(X.missing_terms(F.col("c"), F.col("t")).alias("m")).first().m == terms.select(F.filter("t", lambda t: ~X.fold(F.col("c")).contains(X.fold(t))).alias("m")).first().m
