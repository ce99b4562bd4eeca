"""The pipeline: its stages against direct versions, on its own input each."""

import random

import corpus_pipeline as P
from tests.llm.test_documents import WORDS, check_pieces, components, direct_removal
from weftwork.llm import components as C
from weftwork.llm import near_copies, toxicity
from weftwork.llm.common import stored, table


def shingles(text):
    w = WORDS.findall(text.lower().encode())
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in P.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stored(stage(spark, docs, sf), name)
        assert docs.columns == columns
        kept[name] = (before, {r["doc_id"]: r["text"] for r in docs.collect()})
    before, after = kept["toxicity"]
    model = toxicity.fit(table(spark, sf, "documents"), table(spark, sf, "labels"))
    assert set(after) == {k for k, t in before.items() if model.score(t)[0] < 0.5}
    before, after = kept["simhash_near_dedup"]
    sets = {k: shingles(t) for k, t in before.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(any(alike(k, o) > 0.6 for o in before if o != k) for k in set(before) - set(after))
    assert not [(a, b) for a in after for b in after if a < b and alike(a, b) >= 0.9]
    before, after = kept["substring_dedup"]
    want = direct_removal({k: WORDS.findall(t.encode()) for k, t in before.items()}, 35)
    assert all(len(WORDS.findall(after[k].encode())) == n - gone for k, (n, gone, _) in want.items())
    assert all(after[k] == before[k] for k, (_, gone, _) in want.items() if not gone)
    before, after = kept["secret_scan"]
    assert set(before) == set(after) and all(before[k] == after[k] or "[SECRET]" in after[k] for k in before)
    rows = P.run(spark, sf).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.tokenizer_path("byte_bpe_50k.json"))
    assert check_pieces(rows, {k: t.encode(v or "", add_special_tokens=False).ids + [1] for k, v in after.items()}, 2048) < 0.02


def test_empty(spark, sf, tmp_path):
    for name in ("documents", "labels"):
        table(spark, sf, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_near_copies_are_decided_on_shingles(spark):
    rnd = random.Random(8)
    word = lambda k: " ".join(f"w{rnd.randrange(10**9)}" for _ in range(k))
    docs, alike = [], []
    base = word(100)
    docs += [f"{base} {word(23)}" for _ in range(60)]  # a template: every two of 0.67
    for _ in range(120):  # pairs of 0.81
        base = word(300)
        alike.append((len(docs), len(docs) + 1))
        docs += [f"{base} {word(35)}", f"{base} {word(35)}"]
    shared, own = word(240), word(60)
    center = len(docs)
    docs.append(f"{shared} {word(60)}")  # 0.66 with the next ones, which are of 0.9 with each other
    docs += [f"{shared} {own} {word(12)}" for _ in range(15)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    top = {r["doc_id"]: r["component_id"] for r in near_copies.near_copy_groups(df).collect()}
    assert all(top[i] == i for i in range(60))
    assert sum(top[b] == a for a, b in alike) >= 0.92 * len(alike)
    assert top[center] == center and {top[i] for i in range(center + 1, len(docs))} == {center + 1}


def test_no_more_pairs_are_decided_than_rows(spark, monkeypatch):
    """A template (every two of 0.67) and copies (0.85 and more) behind many keys: a forest a key, but one partner a row."""
    rnd, decided, verified = random.Random(9), [], near_copies._verified
    word = lambda k: " ".join(f"w{rnd.randrange(10**9)}" for _ in range(k))
    template, base = word(100), word(200)
    docs = [f"{template} {word(23)}" for _ in range(150)] + [f"{base} {word(12)}" for _ in range(150)]

    def counted(pairs, *more):
        decided.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(near_copies, "_verified", counted)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    top = {r["doc_id"]: r["component_id"] for r in near_copies.near_copy_groups(df).collect()}
    assert all(top[i] == i for i in range(150)) and {top[i] for i in range(150, 300)} == {150}
    assert sum(decided) <= len(docs), decided


def test_stars_need_no_round(spark, monkeypatch):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(50, 51)], "src long, dst long")
    want = {k: 1 for k in range(1, 41)} | {50: 50, 51: 50}
    with monkeypatch.context() as m:  # a table of one chunk
        m.setattr(C, "_stars", None)
        assert {r["node"]: r["component"] for r in C.connected_components(edges.repartition(7)).collect()} == want
    monkeypatch.setattr(C, "CHUNK", 5)  # several chunks: rounds until only stars are left
    assert {r["node"]: r["component"] for r in C.connected_components(edges.repartition(7)).collect()} == want


def test_near_copies_against_all_pairs(spark, sf):
    docs = table(spark, sf.replace("sf0.001", "sf0.01"), "documents")
    sets = {r["doc_id"]: shingles(r["text"] or "") for r in docs.select("doc_id", "text").collect()}
    holders, pairs = {}, set()
    for k, own in sets.items():
        for s in own:
            holders.setdefault(s, []).append(k)
    for held in holders.values():
        pairs |= {(a, b) for i, a in enumerate(held) for b in held[i + 1 :]}
    alike = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = components(sets, alike)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copy_groups(docs).collect()}
    assert len(alike) > 100 and sum(got[a] == got[b] for a, b in alike) >= 0.9 * len(alike)
    assert all(want[k] == want[c] for k, c in got.items())  # no group holds documents that links do not tie


def test_keys_follow_the_rows():
    share = 0.1515
    for rows in (1000, 10**6, 10**9, 10**11):
        bits, tables = near_copies.keys_for(rows, 0.8)
        assert rows / 2 ** (12 + bits) <= near_copies.BEHIND
        assert (1 - near_copies.shared_codeword(share) * (1 - share) ** bits) ** tables <= 0.06
