"""Whole turns, consolidation, vectors, documents, providers and the evaluation, against goldens and forms of their own."""

import json
import threading
from dataclasses import replace
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

import turnledger
from turnledger.evaluation import whole_suite
from turnledger.operators import consolidate, core_memory, evaluate, extract, model_stage, retrieve, vectors
from turnledger.plans import queries
from turnledger.settings import DEFAULT
from turnledger.sources.tables import environment, read, stored
from turnledger.streaming import replay
from turnledger.system import latencies

SF = "/root/testdata/sf0.001"
STATE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(scope="module")
def memories(spark):
    return stored(queries.aged(spark, SF).where("user_id < 6"), "some")


def session_of(rows, settings, embed=None):
    session = replay.Session(settings, embed)
    for r in sorted(rows, key=lambda r: r["arrival"]):
        row = {c: r[c] if c in r.__fields__ else None for c in replay.COLUMNS}
        session.store[r["memory_id"]] = row | {"promoted": r["promoted"], "decay_applied": 0.0}
        if row["key"]:
            session.keys[row["type"], row["key"]] = row["memory_id"]
        if session.semantic:
            session.vectors.put(row)
    return session


@pytest.mark.parametrize("semantic", [True, False])
def test_session_retrieves_as_the_tables_do(spark, memories, semantic):
    settings = replace(queries.SETTINGS, semantic=semantic)
    hits = now = None
    messages = spark.createDataFrame([(u, "please remember to send item 4 to my manager Dana") for u in range(6)], "user_id long, text string")
    if semantic:
        asked = messages.select("user_id", F.col("user_id").alias("query_id"), "text")
        hits = vectors.searched(asked, vectors.indexed(memories), settings.semantic_limit, None, settings.min_semantic).select(F.col("query_id").alias("user_id"), "memory_id", "score")
        now = memories.select("user_id", "now").distinct()
    ours = {}
    for r in retrieve.retrieved(memories, hits, now, settings).collect():
        ours.setdefault(r.user_id, []).append((r["rank"], r.memory_id, round(r.retrieval_score, 5)))
    rows = memories.collect()
    assert ours and (not semantic or hits.count() > 20)
    for user, found in ours.items():
        own = [r for r in rows if r.user_id == user]
        session = session_of(own, settings, vectors.hashing_embedder() if semantic else None)
        want = session.retrieve("please remember to send item 4 to my manager Dana", own[0].now)
        assert [(m, s) for _, m, s in sorted(found)] == [(r["memory_id"], round(r["retrieval_score"], 5)) for r in want]


def item(i, key, value, turn, kind="fact", update=False, confidence=0.7):
    return {"user_id": 1, "type": kind, "key": key, "memory_id": i, "value": value, "confidence": confidence, "recency_ts": turn * 60.0, "turn_number": turn, "is_update": update}


def test_a_scripted_conversation():
    settings = replace(DEFAULT, dedup_threshold=0.75, consolidation_least=2, consolidation_every=3)
    session = replay.Session(settings, vectors.hashing_embedder())
    one = session.turn(1, "I like green tea", [item("a", "drink", "green tea in the morning", 1), item("b", "city", "Oslo", 1)])
    assert (one["extracted_count"], one["stored_count"], one["total_memories"], one["retrieved_count"], one["dedup_count"]) == (2, 2, 2, 2, 0)
    assert json.loads(one["consolidation"]) == {"decayed": 0, "deleted": 0, "merged": 0, "promoted": 0, "skipped": False} and session.last_run == 1
    assert all(r["access_count"] == 2 and r["last_accessed_turn"] == 1 for r in session.store.values())
    # the same text under another key is a duplicate: boosted, not refreshed
    two = session.turn(2, "green tea", [item("c", "drinks", "green tea in the morning", 2)])
    assert (two["stored_count"], two["dedup_count"], two["consolidation"]) == (0, 1, None)
    assert session.store["a"]["mention_count"] == 2 and session.store["a"]["recency_ts"] == 60.0
    # an update of it is stored and supersedes it, and it is no longer retrieved
    three = session.turn(3, "green tea", [item("d", "drink_now", "green tea in the morning", 3, update=True)])
    assert (three["stored_count"], three["superseded_count"]) == (1, 1) and session.store["a"]["superseded_by"] == "d" and session.store["d"]["supersedes"] == "a"
    assert {m["memory_id"] for m in json.loads(three["active_memories"])} == {"b", "d"}
    # a taken key keeps its value and is refreshed
    four = session.turn(4, "town", [item("e", "city", "a wholly different place", 4)])
    assert (four["stored_count"], four["dedup_count"]) == (0, 0) and session.store["b"]["value"] == "Oslo" and session.store["b"]["recency_ts"] == 240.0
    assert four["consolidation"] is not None and session.last_run == 4


def test_merging_and_its_modes():
    embed = vectors.hashing_embedder()
    base = [item("a", "k1", "green tea", 1, confidence=0.9), item("b", "k2", "green tea", 2), item("c", "k3", "green tea", 3, kind="event"), item("d", "k4", "other", 4)]

    def session(mode):
        s = replay.Session(replace(DEFAULT, merge_threshold=0.3, merge_mode=mode, semantic_dedup=False), embed)
        for x in base:
            s.take(dict(x))
        return s

    s = session("intended")
    assert consolidate.merge_rows(s.store, s.vectors, 9, s.settings, s.keys) == 1
    (record,) = [r for m, r in s.store.items() if m.startswith("merged_")]
    assert (record["key"], record["value"], round(record["confidence"], 6), record["mention_count"], record["turn_number"]) == ("k1", "green tea", 0.85, 2, 9)
    assert s.store["a"]["superseded_by"] == s.store["b"]["superseded_by"] == record["memory_id"] and record["merged_from"] == "b,a"
    assert s.keys["fact", "k1"] == record["memory_id"] and s.store["c"]["superseded_by"] is None
    s = session("compat")
    assert consolidate.merge_rows(s.store, s.vectors, 9, s.settings, s.keys) == 0 and len(s.store) == 4
    assert s.store["a"]["mention_count"] > 1 and s.store["a"]["recency_ts"] == 540.0


def test_merge_pairs_by_brute_force(spark, memories):
    """Merges of a scope: every record comes of two active rows of a type whose value and vector are near, and none is used twice."""
    settings = replace(queries.RUNS)
    rows = consolidate.merged_store(memories, settings).collect()
    before = {r.memory_id: r for r in memories.collect()}
    records = [r for r in rows if r.merged_from]
    embed = vectors.hashing_embedder()
    used = [m for r in records for m in r.merged_from.split(",")]
    assert records and len(used) == len(set(used))
    for r in records:
        a, b = (before.get(m) for m in r.merged_from.split(","))
        if a is None or b is None:
            continue
        assert a.type == b.type == r.type and a.user_id == b.user_id
        assert float(np.dot(embed([a.value])[0], embed([consolidate.text_of(b.asDict())])[0])) >= settings.merge_threshold
    assert {r.memory_id for r in rows} >= set(before) and len(rows) == len(before) + len(records)


def test_run_of_tables_is_the_run_of_a_session(spark, memories):
    """Decay and promotion in columns and in the fold agree, with the merges between them."""
    settings = replace(queries.RUNS, promote_mentions=1, promote_accesses=1, promote_confidence=0.7, promote_age=1)
    out, promoted, stats = consolidate.run(memories, settings, True, stored=stored)
    out, stats, going = out.collect(), {r.user_id: r for r in stats.collect()}, promoted.collect()
    for user in stats:
        own = [r for r in memories.collect() if r.user_id == user]
        session = session_of(sorted(own, key=lambda r: (r.recency_ts, r.memory_id)), settings, vectors.hashing_embedder())
        session.vectors = consolidate.Vectors(vectors.hashing_embedder())
        for r in sorted(session.store.values(), key=lambda r: (r["recency_ts"], r["memory_id"])):
            session.vectors.put(r)
        want = session.consolidate(own[0].now, True)
        assert {k: stats[user][k] for k in ("decayed", "deleted", "merged", "promoted")} == {k: want[k] for k in ("decayed", "deleted", "merged", "promoted")}
        ours = {r.memory_id: (round(r.confidence, 6), bool(r.promoted), r.superseded_by) for r in out if r.user_id == user}
        assert ours == {m: (round(r["confidence"], 6), r["promoted"], r["superseded_by"]) for m, r in session.store.items()}
        assert sorted(r.line for r in going if r.user_id == user) == sorted(line for lines in session.lines.values() for line in lines)
    assert sum(r.merged for r in stats.values()) and sum(r.promoted for r in stats.values()) and sum(r.decayed for r in stats.values())
    skipped = consolidate.run(memories, replace(settings, consolidation_least=10_000), stored=stored)
    assert all(r.skipped and not r.promoted for r in skipped[2].collect()) and skipped[0].count() == memories.count()


def test_stream_with_vectors_equals_the_batch(spark, tmp_path):
    spark.conf.set(STATE, ROCKSDB)
    settings = replace(DEFAULT, dedup_threshold=0.6)
    texts = ["I prefer green tea in the morning", "I prefer green tea in the evening", "Actually, I changed my mind - I prefer green tea in the morning", "I live in Rome."] * 2
    turns = spark.createDataFrame([(1 + k % 2, k + 1, t) for k, t in enumerate(texts)], "user_id long, turn_number int, text string")
    rows = extract.extracted(turns).withColumn("key", F.concat("key", F.col("turn_number").cast("string")))
    for part in ("turn_number <= 4", "turn_number > 4"):
        rows.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out: list = []
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = replay.stream(source, vectors.hashing_embedder, settings).writeStream.outputMode("update").foreachBatch(lambda df, n: out.extend((n, r) for r in df.collect()))
    query.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    last = {r.memory_id: r for _, r in sorted(out, key=lambda x: x[0])}
    want = {r.memory_id: r for r in replay.replayed(rows, vectors.hashing_embedder, settings).collect()}
    assert set(last) == set(want) and any(r.superseded_by for r in want.values()) and any(r.mention_count > 1 for r in want.values())
    assert all((last[m].mention_count, round(last[m].confidence, 6), last[m].superseded_by) == (r.mention_count, round(r.confidence, 6), r.superseded_by) for m, r in want.items())


# vectors


def test_nearest_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(120, 8))
    rows = [(k, v[k].tolist(), str(k % 3), k % 2) for k in range(120)] + [(200, [0.0] * 8, "0", 0), (201, None, "1", 1)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, memory_type string, g int")
    asked = df.where("id % 10 = 0").select(F.col("id").alias("query_id"), "vector", "g")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for on, types in (([], None), (["g"], None), ([], ("0", "2"))):
        got = {}
        for r in vectors.nearest(asked, df, on, 7, 0.1, types).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.id))
        for q in range(0, 120, 10):
            allowed = [k for k in range(120) if (not on or k % 2 == q % 2) and (types is None or str(k % 3) in types) and unit[q] @ unit[k] >= 0.1]
            want = sorted(allowed, key=lambda k: (-(unit[q] @ unit[k]), k))[:7]
            assert [i for _, i in sorted(got.get(q, []))] == want
    pairs = {(r.id, r.other_id) for r in vectors.similar_pairs(df, [], 0.5).collect()}
    assert pairs == {(a, b) for a in range(120) for b in range(a) if unit[a] @ unit[b] >= 0.5}
    assert vectors.similar_pairs(df.where("false"), ["g"], 0.5).count() == 0 and vectors.nearest(asked.where("false"), df, [], 3, 0.0).count() == 0


def test_collections(spark, memories, tmp_path):
    path = str(tmp_path / "points")
    points = vectors.indexed(memories)
    assert vectors.created(spark, path).count() == 0
    held = vectors.saved(points, path)
    assert held.count() == memories.count() and vectors.counted(held).first().n == memories.count()
    plan = held.where("memory_type = 'entity'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(memory_type" in plan
    asked = memories.where("type = 'entity'").limit(3).select(F.xxhash64("memory_id").alias("query_id"), "user_id", F.concat_ws(" | ", "key", "value", F.lit("type: entity")).alias("text"))
    found = vectors.searched(asked, held, 1, ("entity",)).collect()
    assert len(found) == 3 and all(r.score > 0.999 for r in found)
    with pytest.raises(Exception, match="dimension|collection of"):
        vectors.checked(points, 7).collect()
    left = vectors.removed(held, memories.where("type = 'entity'"))
    assert left.count() == memories.where("type != 'entity'").count() and vectors.recreated(held, path).count() == 0


# evaluation


def test_evaluation_goldens(spark):
    found = spark.createDataFrame([
        (1, "a", "fact", "name", "Robin", 1), (1, "b", "fact", "city", "Oslo", 2), (1, "c", "event", "city", "Oslo", 3), (1, "d", "fact", "pet", "a cat", 4), (2, "e", "fact", "x", "y", 1),
    ], "user_id long, memory_id string, type string, key string, value string, rank int")
    truth = spark.createDataFrame([
        (1, 1, "fact", "CITY", "oslo", 10, 20), (1, 2, "fact", "pet", "a cat named Tom", 5, 20), (1, 3, "fact", "name", "Kim", 9, 20), (3, 4, "fact", "k", "v", 1, 3),
    ], "user_id long, id long, type string, key string, value string, turn_number int, now int")
    # "name" alone is no match: key and value count as one text
    assert {tuple(r) for r in evaluate.context_precision(found, truth).collect()} == {(1, 4, 2, 0.5), (2, 1, 0, 0.0), (3, 0, 0, 0.0)}
    assert {(r.user_id, r.n_truth, round(r.recall, 4)) for r in evaluate.context_recall(found, truth).collect()} == {(1, 3, 0.6667), (2, 0, 1.0), (3, 1, 0.0)}
    rank = {r.user_id: r for r in evaluate.ranking_quality(found, truth).collect()}
    assert (rank[1].mrr, rank[1].avg_position, rank[1].top_1, round(rank[1].top_3, 4), round(rank[1].top_5, 4)) == (0.5, 3.0, 0.0, 0.3333, 0.6667)
    assert (rank[2].mrr, rank[2].top_1, rank[3].avg_position, rank[3].top_10) == (0.0, None, 0.0, None)
    by = {(r.user_id, r.distance): (r.expected, r.found, r.recall) for r in evaluate.distance_recall(found, truth, (10, 15, 2)).collect()}
    assert by == {(1, 10): (2, 1, 0.5), (1, 15): (1, 1, 1.0), (3, 2): (1, 0, 0.0)}
    docs = spark.createDataFrame([(1, "CORE.md", "- **City:** Oslo"), (1, "P.md", "none")], "user_id long, file string, body string")
    expected = spark.createDataFrame([(1, "city"), (1, "pet"), (2, "x")], "user_id long, key string")
    assert {tuple(r) for r in evaluate.promotion_share(expected, docs).collect()} == {(1, 2, 1, 0.5), (2, 1, 0, 0.0)}


def test_the_whole_suite(spark):
    result = whole_suite(spark, conversations=6, distances=(5, 20))
    assert result["extraction"]["recall"] > 0.3 and 0 < result["retrieval"]["context.recall"] <= 1
    assert set(result["distance_sweep"]) <= {"5", "20"} and result["consolidation"][0]["user_id"] == 1
    json.dumps(result)


# documents


def test_documents(spark, tmp_path):
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    empty = core_memory.templates(users, "2024-01-01")
    lines = spark.createDataFrame([(1, "CORE.md", "Identity", 1, "- **name:** Al"), (1, "CORE.md", "Identity", 2, "- **city:** Rome")], "user_id long, file string, section string, pos int, line string")
    docs = core_memory.whole(empty, lines)
    body = {(r.user_id, r.file): r.body for r in docs.collect()}
    assert len(body) == 8 and body[1, "CORE.md"] == "# Core Identity\n\n**Last Updated:** 2024-01-01\n\n## Identity\n- **name:** Al\n- **city:** Rome\n\n"
    assert body[2, "INSTRUCTIONS.md"] == "# Instructions & Guidelines\n\n**Last Updated:** 2024-01-01\n\n## Communication Style\n\n"
    after = {(r.user_id, r.file): r.body for r in core_memory.edited(docs, "CORE.md", "Ident", "name", "Bo", "2024-05-05").collect()}
    assert after[1, "CORE.md"] == body[1, "CORE.md"].replace("Al", "Bo").replace("2024-01-01", "2024-05-05") and after[2, "CORE.md"] == body[2, "CORE.md"]
    changed = core_memory.updated(lines, "name", "Bo", "Identity")
    assert {(r.user_id, r.file) for r in core_memory.touched(empty, lines, changed, "2024-05-05").where("updated = '2024-05-05'").collect()} == {(1, "CORE.md")}
    core_memory.write_documents(docs, str(tmp_path / "docs"))
    assert {(int(r.user_id), r.file): r.body for r in core_memory.read_documents(spark, str(tmp_path / "docs")).collect()} == body
    plain = tmp_path / "plain" / "7"
    plain.mkdir(parents=True)
    (plain / "CORE.md").write_text("# T\nx")
    assert [tuple(r) for r in core_memory.read_documents(spark, str(tmp_path / "plain")).collect()] == [("7", "CORE.md", "# T\nx")]
    assert core_memory.path_of("/m/", "7", "CORE.md") == "/m/7/CORE.md"


# the model stage


def test_broken_answers_go_back_with_their_error(spark):
    rows = spark.createDataFrame([(1, 1, "p", "hello there")], "user_id long, turn_number int, prompt string, text string")

    def make(bad):
        def made():
            seen = []

            def call(prompt, key):
                seen.append(prompt)
                return "no json" if len(seen) <= bad else json.dumps([{"type": "fact", "key": "asked", "value": prompt, "confidence": 1}])
            return call
        return made

    first = model_stage.parsed(model_stage.answered(rows, make(1))).first()
    assert "hello there" in first.value and "no json" in first.value and "Expecting value" in first.value
    assert model_stage.parsed(model_stage.answered(rows, make(2))).count() == 0
    assert model_stage.answered(rows, make(1), corrections=0).first().answer == "no json"
    assert model_stage.wrong('{"a": 1}') is None and model_stage.wrong("```json\n[]\n```") is None and model_stage.wrong("x")


class Stub(BaseHTTPRequestHandler):
    seen: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        key = self.headers.get("x-api-key") or self.headers["Authorization"].removeprefix("Bearer ")
        Stub.seen.append((key, body))
        said = {"content": [{"text": "[]"}]} if self.headers.get("x-api-key") else {"choices": [{"message": {"content": "[]"}}]}
        out = b"too many requests" if key == "spent" else json.dumps(said).encode()
        self.send_response(429 if key == "spent" else 200)
        self.end_headers()
        self.wfile.write(out)

    def log_message(self, *_):
        pass


@pytest.mark.parametrize("name", ["openai", "anthropic", "groq"])
def test_providers(spark, name):
    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/"
        call = model_stage.provider(name, "m", ("spent", "good"), 77, 0.3, url)()
        with pytest.raises(RuntimeError, match="429"):
            call("hi", 0)
        assert call("hi", 1) == "[]"
        _, body = Stub.seen[-1]
        assert body == {"model": "m", "messages": [{"role": "user", "content": "hi"}], "max_tokens": 77, "temperature": 0.3}
        rows = spark.createDataFrame([(1, 1, "p")], "user_id long, turn_number int, prompt string")
        assert model_stage.answered(rows, model_stage.provider(name, "m", ("spent", "good"), url=url), keys=2).first().answer == "[]"
    finally:
        server.shutdown()
    with pytest.raises(ValueError, match="unknown"):
        model_stage.provider("other", "m", ("k",))


def test_cascade(spark):
    turns = spark.createDataFrame([(1, 1, "I prefer item 12 for all calls after 11 AM, and Dana likes that"), (1, 2, "Is there anything else about my invoice, Dana and the plan for the family, Friday at 5 pm?"), (1, 3, "ok")], "user_id long, turn_number int, text string")

    def make():
        return lambda prompt, key: json.dumps([{"type": "event", "key": "invoice", "value": "asked", "confidence": 0.9, "is_update": True}, {"type": "event", "key": "low", "value": "x", "confidence": 0.2}])

    plain = model_stage.cascade(turns).collect()
    assert {(r.turn_number, r.key, r.stage) for r in plain} == {(1, "preference", 2)}
    need = {r.turn_number for r in extract.escalation(turns).where("needs_model").collect()}
    both = model_stage.cascade(turns, make).collect()
    assert need and {(r.turn_number, r.key, r.stage, r.is_update) for r in both} == {(1, "preference", 2, False)} | {(t, "invoice", 3, True) for t in need}
    assert len({r.memory_id for r in both}) == len(both)


# the system


def test_system(spark, tmp_path):
    system = turnledger.MemorySystem(spark, replace(DEFAULT, consolidation_least=3), root=str(tmp_path / "core"))
    texts = ["My name is Alex and my manager is David", "I prefer calls after 11 AM, and Dana likes that", "ok", "I'm allergic to nuts, so remember to check my account"]
    turns = spark.createDataFrame([(u, k + 1, t) for u in (1, 2) for k, t in enumerate(texts)], "user_id long, turn_number int, text string")
    first = system.process(turns.where("turn_number <= 2")).collect()
    again = system.process(turns.where("turn_number > 2")).collect()
    assert len(first) == len(again) == 4 and system.turn_stats_log().count() == 8
    whole = turnledger.MemorySystem(spark, replace(DEFAULT, consolidation_least=3))
    whole.process(turns)
    assert {r.memory_id: r.access_count for r in whole.memories.collect()} == {r.memory_id: r.access_count for r in system.memories.collect()}
    stats = {r.user_id: r for r in system.statistics().collect()}
    assert stats[1].total_turns == 4 and stats[1].total_memories == stats[1].vector_count > 3 and "entity=" in stats[1].by_type and stats[1].semantic_enabled
    system.create_documents(turns.select("user_id").distinct(), "2024-01-01")
    system.update_core_memory("CORE.md", "Identity", "name", "x", "2024-01-02")
    context = {r.user_id: r.context for r in system.prompt_context(spark.createDataFrame([(1, "what about nuts?")], "user_id long, text string")).collect()}
    assert "### CORE MEMORY (Always Active)\n\n=== CORE.md ===\n# Core Identity" in context[1] and "### LONG-TERM MEMORY (Retrieved)\n\n=== CONSTRAINT ===" in context[1]
    assert system.health() == {"store": True, "documents": True, "vectors": True}
    ran = system.run_consolidation(force=True).collect()
    assert {r.user_id for r in ran} == {1, 2} and system.consolidation_stats().count() == 2 and system.is_consolidation_enabled()
    system.export_turn_stats(str(tmp_path / "log"))
    log = {r.user_id: r for r in spark.read.json(str(tmp_path / "log")).collect()}
    assert log[1].total_turns == 4 and [t.turn_number for t in log[1].conversation_turns] == [1, 2, 3, 4]
    basic = turnledger.MemorySystem(spark, embedder=None)
    basic.process(turns)
    assert basic.health()["vectors"] is None and basic.retrieve(spark.createDataFrame([(1, "nuts")], "user_id long, text string")).count() > 0
    assert {r.vector_count for r in basic.statistics().collect()} == {None}
    system.clear()
    assert system.memories.count() == 0 and system.statistics().count() == 0


def test_files_and_times(spark, tmp_path):
    text = "# keys\nexport A_KEY='x y'\nB=2 # two\nB=3\nEMPTY=\nnot a line\n"
    assert environment(text) == {"A_KEY": "x y", "B": "3", "EMPTY": ""}
    (tmp_path / "c.json").write_text(json.dumps({"conversation_id": "7", "turns": [{"turn": 1, "message": "hi"}]}))
    one = read(spark, str(tmp_path / "c.json"), "json", "conversation_id string, turns array<struct<turn:int,message:string>>", multiLine=True).first()
    assert one.conversation_id == "7" and one.turns[0].message == "hi"
    log = spark.createDataFrame([(1, float(k), 2.0 * k) for k in range(1, 101)], "user_id long, storage_time_ms double, retrieval_time_ms double")
    by = {r.stage: r for r in latencies(log).collect()}
    assert (by["storage"].median, by["storage"].p95, by["retrieval"].p99, by["retrieval"].mean, by["storage"].most) == (50.0, 95.0, 198.0, 101.0, 100.0)
    assert len(core_memory.templates(spark.range(1).withColumnRenamed("id", "user_id")).first().updated) == 10
