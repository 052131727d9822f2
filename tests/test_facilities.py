import random

from pyspark.sql import functions as F

from citeloom.operators import conversation, facilities

SCHEMA = (
    "facility_id string, ordinal long, name string, prefecture string, city string, service_type string, address string, phone string, "
    "business_hours string, features array<string>, last_updated string, source_url string"
)


def sample():
    rng = random.Random(11)
    cities = [("東京都", "世田谷区"), ("東京都", "新宿区"), ("大阪府", "北区"), ("大阪府", "北区中"), ("京都府", "新宿区")]
    services = ["デイサービス", "訪問介護", "小規模", "BUILDING"]
    rows = []
    for i in range(120):
        # one city and service hold most rows
        prefecture, city = cities[0] if i % 2 else rng.choice(cities)
        service = services[0] if i % 3 else rng.choice(services)
        features = rng.sample(facilities.FEATURE_KEYWORDS, rng.choice([0, 0, 1, 2]))
        rows.append((f"F{i:03d}", i, f"施設{i % 90}号", prefecture, city, service, f"{i % 7}番地 road", f"03-{i}", "9-17", features, "2024", "https://x"))
    return rows


QUERIES = [
    "世田谷区のデイサービスを探しています",
    "北区中で送迎のある施設、電話も",
    "北区 ケアマネ",
    "入浴と夜間",
    "施設12号 について",
    "東京都 認知症",
    "ケアマネジャー 24時間 要介護",
    "road 番地",
    "3番地？road 要支援",
    "ヘルパー",
    "何か",
    "新宿区の小規模 リハビリ 看護師 TEL",
]


def naive_intent(query, rows):
    def longest(names):
        hits = [n for n in names if n and n in query]
        return min(hits, key=lambda n: (-len(n), n)) if hits else None

    alias = {a: c for c, names in facilities.SERVICE_SYNONYMS.items() for a in [*names, c]}
    for r in rows:
        alias.setdefault(r[5], r[5])
    hit = longest(alias)
    return {
        "prefecture": longest({r[3] for r in rows}),
        "city": longest({r[4] for r in rows}),
        "service_type": alias.get(hit),
        "keywords": sorted(k for k in facilities.FEATURE_KEYWORDS if k in query),
    }


def naive_rank(query, intent, rows, k=3):
    kept = rows
    if intent["city"] and any(r[4] == intent["city"] for r in kept):
        kept = [r for r in kept if r[4] == intent["city"]]
    if intent["service_type"] and any(r[5] == intent["service_type"] for r in kept):
        kept = [r for r in kept if r[5] == intent["service_type"]]
    cleaned = query
    for mark in "。、？?！!":
        cleaned = cleaned.replace(mark, " ")
    words = {w for w in cleaned.split() if len(w) >= 2}
    scored = []
    for r in kept:
        blob = " ".join([r[2], r[3], r[4], r[5], r[6], r[8], *r[9]])
        found = [w for w in intent["keywords"] if w in blob]
        score = (
            (1.0 if r[3] == intent["prefecture"] else 0)
            + (3.0 if r[4] == intent["city"] else 0)
            + (4.0 if r[5] == intent["service_type"] else 0)
            + (2.0 if r[2] in query else 0)
            + 1.2 * len(found)
        )
        if score == 0 and any(w in blob for w in words):
            score = 0.5
        scored.append((round(score, 6), r[1], r[0]))
    scored.sort(key=lambda s: (-s[0], s[1]))
    return [(f, s) for s, _, f in scored[:k]]


def test_rule_search_equals_scoring_everything(spark):
    rows = sample()
    table = spark.createDataFrame(rows, SCHEMA)
    asked = spark.createDataFrame([(f"q{i:02d}", q) for i, q in enumerate(QUERIES)], "query_id string, query_text string")
    intents = facilities.parse_intent(asked, table).persist()
    got = {r["query_id"]: r for r in intents.collect()}
    for i, q in enumerate(QUERIES):
        expected = naive_intent(q, rows)
        assert {k: got[f"q{i:02d}"][k] for k in expected} == expected, q
    assert got["q01"]["contact_requested"] and not got["q00"]["contact_requested"]
    ranked = {}
    for r in facilities.rule_topk(intents, table).orderBy("query_id", "rank").collect():
        ranked.setdefault(r["query_id"], []).append((r["facility_id"], r["score"]))
    for i, q in enumerate(QUERIES):
        assert ranked[f"q{i:02d}"] == naive_rank(q, naive_intent(q, rows), rows), q


def test_facilities_of_one_split_are_searched_by_all_tasks(spark, monkeypatch):
    table = spark.createDataFrame(sample(), SCHEMA).coalesce(1)
    asked = spark.createDataFrame([("q", "road 番地 何か")], "query_id string, query_text string")
    intents = facilities.parse_intent(asked, table)
    parts, staged = [], facilities.staged
    monkeypatch.setattr(facilities, "staged", lambda rows: parts.append((rows.columns, rows.rdd.getNumPartitions())) or staged(rows))
    assert facilities.rule_topk(intents, table).count() == 3
    assert [n for columns, n in parts if "mask" in columns] == [2 * spark.sparkContext.defaultParallelism]


TURNS = [
    ("a", 1, "世田谷区のデイサービス"),
    ("a", 2, "送迎は"),
    ("a", 3, "/reset"),
    ("a", 4, "何か"),
    ("a", 5, "入浴"),
    ("a", 6, "新宿区"),
    ("a", 7, "夜間 電話"),
    ("b", 1, "何か"),
    ("b", 2, "ケアマネ"),
    ("b", 3, "施設12号"),
    ("b", 4, "ショートステイ 東京都 送迎"),
    ("b", 5, "もっと"),
]


def naive_conversations(rows):
    out = {}
    state = {}
    for conv, turn, query in TURNS:
        held = state.get(conv, {"prefecture": None, "city": None, "service_type": None, "keywords": []})
        if query == "/reset":
            state[conv] = {"prefecture": None, "city": None, "service_type": None, "keywords": []}
            out[conv, turn] = "reset"
            continue
        intent = naive_intent(query, rows)
        merged = {k: intent[k] or held[k] for k in ("prefecture", "city", "service_type")}
        merged["keywords"] = sorted({*intent["keywords"], *held["keywords"]})
        if not (merged["city"] or merged["service_type"] or merged["keywords"]):
            out[conv, turn] = "clarify"
            continue
        strong = [f for f, s in naive_rank(query, merged, rows) if s >= 2]
        if strong:
            state[conv] = merged
        out[conv, turn] = strong or "unknown"
    return out


def _facility_ids(spark, rows, resolved):
    _, explained = conversation.answer_turns(resolved, spark.createDataFrame(rows, SCHEMA))
    found = {}
    for r in explained.orderBy("query_id", "rank").collect():
        conv, turn = r["query_id"].split(":")
        found.setdefault((conv, int(turn)), []).append(r["facility_id"])
    for r in resolved.filter("outcome <> 'answer'").collect():
        found[r["conv_id"], r["turn"]] = r["outcome"]
    return found


def test_small_dictionaries_are_tried_in_place(spark, monkeypatch):
    """No turn is exchanged to find its slots, and the slots are those of the general lookup; a null id finds none."""
    rows = sample() + [("F900", 900, "", None, "", None, "x", "03", "9-17", [], "2024", "https://x")]
    table = spark.createDataFrame(rows, SCHEMA)
    asked = spark.createDataFrame([(f"q{i:02d}", q) for i, q in enumerate(QUERIES)] + [("n", None), (None, QUERIES[0])], "query_id string, query_text string")
    here = facilities.own_intent(asked, table)
    assert "Exchange" not in here._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(facilities, "FEW_TERMS", 0)
    there = facilities.own_intent(asked, table)
    assert sorted(here.collect(), key=repr) == sorted(there.collect(), key=repr)


def test_facility_texts_are_made_by_all_cores(spark):
    rows = sample()
    table = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    dealt = facilities.dealt_blobs(table, "facility_id", "ordinal")
    assert dealt.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    cover = conversation.coverage(table)
    held = [(r[3], {w for w in facilities.FEATURE_KEYWORDS if any(w in part for part in (*r[2:7], r[8], *r[9]))}) for r in rows]
    assert cover.local == {(p, w) for p, words in held for w in words}
    assert cover.pairs == {(a, b) for _, words in held for a in words for b in words if a < b}


def test_conversations_batch(spark):
    rows = sample()
    table = spark.createDataFrame(rows, SCHEMA)
    turns = spark.createDataFrame(TURNS, "conv_id string, turn long, query_text string")
    resolved = conversation.fold_turns(conversation.prepare_turns(turns, table), conversation.coverage(table)).persist()
    expected = naive_conversations(rows)
    assert _facility_ids(spark, rows, resolved) == expected
    answers = {(r["conv_id"], r["turn"]): r["answer"] for r in conversation.converse(turns, table)[0].collect()}
    assert answers["a", 4] == facilities.CLARIFY_TEXT and answers["a", 3] is None
    assert answers["a", 1].startswith("候補を3件見つけました。\n1. ") and answers["a", 1].endswith(facilities.CLOSING_LINE)
    assert "連絡先: 03-" in answers["a", 7] and "連絡先" not in answers["a", 1]


def test_conversations_stream(spark, tmp_path):
    from citeloom.streaming import conversation as stream

    rows = sample()
    table = spark.createDataFrame(rows, SCHEMA)
    source, prepared, out = (str(tmp_path / n) for n in ("in", "prepared", "out"))
    # two arrivals: the state must live on between runs
    for part in (TURNS[:2] + TURNS[7:9], TURNS[2:7] + TURNS[9:]):
        spark.createDataFrame(part, stream.TURNS).coalesce(1).write.mode("append").parquet(source)
        turns = spark.readStream.schema(stream.TURNS).parquet(source)
        stream.start_prepare(turns, table, prepared, str(tmp_path / "c1")).awaitTermination()
        stream.start_resolve(spark, prepared, table, out, str(tmp_path / "c2")).awaitTermination()
    expected = naive_conversations(rows)
    got = {(r["conv_id"], r["turn"]): r["outcome"] for r in spark.read.parquet(out).collect()}
    assert got == {k: v if isinstance(v, str) else "answer" for k, v in expected.items()}


def test_semantic_merge(spark):
    rows = sample()[:6]
    table = spark.createDataFrame(rows, SCHEMA)
    vectors = spark.createDataFrame([(r[0], [1.0, float(i)]) for i, r in enumerate(rows)], "facility_id string, embedding array<float>")
    queries = spark.createDataFrame([("q", [1.0, 0.0]), ("z", [-1.0, 0.0])], "query_id string, query_vec array<float>")
    semantic = facilities.semantic_topk(queries, vectors, 1)
    assert semantic.filter("query_id = 'q'").count() == 3
    base = spark.createDataFrame([("q", "F001", 2.0, 1, ["a", "b"]), ("q", "F005", 2.0, 2, ["c"])], "query_id string, facility_id string, score double, rank int, reasons array<string>")
    merged = facilities.merge_candidates(semantic, base).filter("query_id = 'q'").orderBy("rank").collect()
    assert [(r["facility_id"], round(r["score"], 3)) for r in merged] == [("F001", 5.536), ("F000", 5.0), ("F002", 2.236)]
    assert merged[0]["reasons"] == ["意味類似: 0.707", "a", "b"]
    accepted = {r["query_id"]: r["accepted"] for r in facilities.semantic_recommend(semantic).collect()}
    assert accepted == {"q": True, "z": False}
    doc = table.orderBy("ordinal").select(facilities.render_facility().alias("d")).first()["d"]
    assert doc.startswith("[ID:F000]\n名称: ") and doc.endswith("\nソース: https://x")


def test_last_turns(spark):
    rows = [("c", n, "user" if n % 2 else "assistant", f"t{n}") for n in range(9)]
    got = facilities.last_turns(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).first()
    assert got["history"].split("\n") == [f"- {'ユーザー' if n % 2 else 'アシスタント'}: t{n}" for n in range(3, 9)]
