"""Golden values, edge cases, and the fold against an independent model."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from turnledger.functions.text import boosted, point_id, sensory_score, similarity
from turnledger.operators import consolidate, core_memory, evaluate, extract, model_stage, retrieve, store, vectors
from turnledger.settings import DEFAULT, Settings
from turnledger.sources import conversations as made
from turnledger.streaming import replay

POSITIVE = [
    "I prefer item 12", "My favorite fruit is plum 3", "I usually walk 4 km", "I hate item 7", "I can't eat item 9", "I have to leave at 5 pm",
    "I'm allergic to peanuts", "Do not call region 3", "My manager is called Dana", "My name is Alex", "I work for Acme 12. Thanks", "I live in Town 44.",
    "I'll finish task 3 by Friday.", "I promise to ship order 5", "I'm committed to goal 8", "Remember to check log 9", "Don't ever skip step 4",
    "Make sure to test build 6", "my account number 4567 please", "the payment of $450 arrived", "you have $450 still due now", "bill due on March 7th",
    "pay before March 7th", "I already paid it 3 days ago", "the payment was received", "there is an outstanding balance", "a payment plan of 10 days",
    "please set up a payment plan", "now speaking with Jennifer", "hello, this is Jennifer",
]


def turns(spark, texts):
    return spark.createDataFrame([(1, k + 1, t) for k, t in enumerate(texts)], "user_id long, turn_number int, text string")


def test_every_pattern(spark):
    rows = extract.extracted(turns(spark, POSITIVE)).collect()
    hit = {(r.turn_number, (r.arrival // 1000) % 100) for r in rows}
    assert all((k, k) in hit for k in range(1, 31))


def test_golden_messages(spark):
    texts = ["My name is Alex and my manager is David", "ok", "Maybe I could try tea", "I'll finish the report by Friday.", None, "", "    ", "hey "]
    score = [r.s for r in turns(spark, texts).select(F.round(sensory_score(F.col("text")), 6).alias("s")).collect()]
    assert score[:4] == [0.567, 0.0, 0.113, 0.415667] and score[5:] == [0.0, 0.0, 0.0]
    got = {(r.key, r.value) for r in extract.extracted(turns(spark, texts[:1])).collect()}
    assert got == {("my_name", "alex"), ("my_manager", "david"), ("user_name", "alex")}


def test_numbers(spark):
    row = spark.sql("select 1.0D a, 0.7D b, 'mem_0a1b2c3d' m, array(0f, 0f) z, array(1f, 0f) o").select(
        boosted(F.col("a")).alias("x"), boosted(boosted(F.col("b"))).alias("y"), point_id(F.col("m")).alias("p"), similarity(F.col("z"), F.col("o")).alias("z")).first()
    assert (row.x, row.y, int(row.p), row.z) == (0.95, 0.8999999999999999, 17272012667591172520, 0.0)


def test_upsert_is_the_fold(spark):
    texts = ["I prefer item 1 for calls with Dana", "I prefer item 2 for calls with Dana", "my account number 12 and account 13 please, thanks"] * 3
    rows = extract.extracted(turns(spark, texts))
    a = {(r.type, r.key): (r.memory_id, r.value, round(r.confidence, 6), r.mention_count, r.recency_ts) for r in store.upserted(rows).collect()}
    b = {(r.type, r.key): (r.memory_id, r.value, round(r.confidence, 6), r.mention_count, r.recency_ts) for r in replay.replayed(rows).collect()}
    assert a == b and a[("preference", "preference")][3] == 6


def test_empty_keys_are_not_folded(spark):
    rows = spark.createDataFrame([(1, "fact", "", f"m{k}", "v", 0.8, k, k) for k in range(3)], "user_id long, type string, key string, memory_id string, value string, confidence double, turn_number int, arrival long")
    assert store.upserted(rows).count() == 3 and replay.replayed(rows).count() == 3
    assert store.upserted(rows.where("false")).count() == 0


def test_decision_table():
    new = lambda i, key, update=False: {"user_id": 1, "type": "fact", "key": key, "memory_id": i, "value": i, "confidence": 0.7, "recency_ts": 1.0, "is_update": update}
    rows, keys = {}, {}
    replay.step(rows, keys, new("a", "k"), lambda _: None, DEFAULT)
    replay.step(rows, keys, new("b", "other"), lambda _: "a", DEFAULT)
    assert list(rows) == ["a"] and rows["a"]["mention_count"] == 2
    replay.step(rows, keys, new("c", "other", True), lambda _: "a", DEFAULT)
    assert rows["a"]["superseded_by"] == "c"
    replay.step(rows, keys, new("d", "k", True), lambda _: "a", DEFAULT)
    assert list(rows) == ["a", "c"] and rows["a"]["mention_count"] == 3


def test_semantic_replay(spark):
    rows = extract.extracted(turns(spark, ["I prefer green tea", "I prefer green tea"])).withColumn("key", F.concat("key", F.col("turn_number").cast("string")))
    assert replay.replayed(rows).count() == 2
    assert replay.replayed(rows, vectors.hashing_embedder, Settings(dedup_threshold=0.6)).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = extract.extracted(turns(spark, ["I prefer item 1", "I prefer item 2", "I live in Rome."] * 2))
    for part in ("turn_number <= 3", "turn_number > 3"):
        rows.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out: list = []
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = replay.stream(source).writeStream.outputMode("update").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = {(r.type, r.key): r.mention_count for r in out}
    want = {(r.type, r.key): r.mention_count for r in store.upserted(rows).collect()}
    assert {k: max(r.mention_count for r in out if (r.type, r.key) == k) for k in last} == want


def test_merge_and_decay(spark):
    a, b = consolidate.merged_value, lambda x, y: spark.sql(f"select '{x}' x, '{y}' y")  # noqa: F841
    cases = [("tea", "tea", "tea"), ("tea", "green tea", "green tea"), ("tea", "milk", "tea; milk"), ("x" * 400, "y" * 400, "x" * 400 + "; " + "y" * 98)]
    for x, y, want in cases:
        assert spark.sql(f"select '{x}' x, '{y}' y").select(consolidate.merged_value(F.col("x"), F.col("y")).alias("v")).first().v == want
    rows = spark.createDataFrame([("a", 0.9, 0, 0, False, 1000), ("b", 0.9, 900, 900, False, 1000), ("c", 0.12, 0, 0, False, 1000), ("d", 0.9, 0, 0, True, 1000)], "memory_id string, confidence double, turn_number int, last_accessed_turn int, promoted boolean, now int")
    got = {r.memory_id: (round(r.new_confidence, 6), r.deleted) for r in consolidate.decayed(rows).collect()}
    assert got == {"a": (0.8325, False), "b": (0.9, False), "c": (0.1, False), "d": (0.9, False)}


def test_prompt_rounds_half_to_even(spark):
    rows = spark.createDataFrame([(1, 1, "fact", "k", "v", 3, 0.825), (1, 2, "constraint", "c", "w", 4, 1.0), (1, 3, "other", "o", "x", 5, 0.5)], "user_id long, rank int, type string, key string, value string, turn_number int, confidence double")
    assert retrieve.prompt(rows).first().prompt == "=== CONSTRAINT ===\n- c: w [turn 4, 100% confident]\n\n=== FACT ===\n- k: v [turn 3, 82% confident]"


def test_model_answers(spark):
    good = '[{"type":"fact","key":"k","value":"v","confidence":2},{"type":"fact","key":"k"},{"type":"x","key":"y","value":"z","confidence":0.5,"is_update":true}]'
    texts = [good, f"```json\n{good}\n```", "no json", '{"a":1}', '[{"type":"t","key":"k","value":"v","confidence":"high"},{"type":"t","key":"k","value":"v","confidence":1}]', None, "[]"]
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "user_id long, turn_number int, answer string")
    got = [(r.turn_number, r.memory_id, r.confidence, r.is_update) for r in model_stage.parsed(rows).orderBy("turn_number", "memory_id").collect()]
    assert got == [(0, "mem_0_0", 1.0, False), (0, "mem_0_1", 0.5, True), (1, "mem_1_0", 1.0, False), (1, "mem_1_1", 0.5, True)]


def test_provider(spark):
    def make():
        def call(prompt, key):
            if key == 0:
                raise RuntimeError("429 too many requests")
            return "[]"
        return call

    rows = spark.createDataFrame([(1, 1, "p")], "user_id long, turn_number int, prompt string")
    assert model_stage.answered(rows, make, keys=2).first().answer == "[]"
    assert model_stage.answered(rows, None).first().answer is None


def test_core_memory(spark):
    lines = spark.createDataFrame([(1, "CORE.md", "Identity", 1, "- **name:** Al")], "user_id long, file string, section string, pos int, line string")
    new = spark.createDataFrame([(1, "CORE.md", "Identity", 5, "- **city:** Rome"), (1, "CORE.md", "Identity", 9, "- **job:** chef")], "user_id long, file string, section string, at int, line string")
    both = core_memory.updated(core_memory.appended(lines, new), "name", "Bo", "Ident")
    docs = core_memory.rendered(both)
    assert docs.first().body == "## Identity\n- **job:** chef\n- **city:** Rome\n- **name:** Bo"
    assert core_memory.joined(docs).first().core.startswith("=== CORE.md ===\n## Identity")
    assert core_memory.templates(lines, "2024-01-01").count() == 4


def test_embedder_and_points(spark):
    df = spark.createDataFrame([("green tea",), ("  ",), (None,)], "text string")
    rows = vectors.embedded(df).collect()
    assert math.isclose(sum(x * x for x in rows[0].embedding), 1.0, rel_tol=1e-5) and not any(rows[1].embedding) and not any(rows[2].embedding)
    old = spark.createDataFrame([(1, "a")], "point_id long, text string")
    new = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "d", 1)], "point_id long, text string, at int")
    assert {(r.point_id, r.text) for r in vectors.put(old, new).collect()} == {(1, "c"), (2, "d")}


def test_stage_merge(spark):
    rows = spark.createDataFrame([(1, 1, "t", "k", "a", 0.9, 1, 2), (1, 1, "t", "k", "b", 0.7, 2, 2), (1, 1, "t", "k", "c", 0.7, 3, 3), (1, 1, "t", "k2", "d", 0.6, 4, 3)], "user_id long, turn_number int, type string, key string, value string, confidence double, arrival long, stage int")
    assert {(r.key, r.value, r.stage) for r in extract.merged_stages(rows).collect()} == {("k", "b", 2), ("k2", "d", 3)}


def test_made_conversations(spark):
    rows = made.batch(spark, conversations=30).collect()
    turns_of = {k: [r for r in rows if r.conv_id == k] for k in range(1, 31)}
    assert all(10 <= len(t) <= 30 and [r.turn for r in sorted(t)] == list(range(1, len(t) + 1)) for t in turns_of.values())
    stated = [r for r in rows if r.has_memory]
    assert 0.5 < len(stated) / len(rows) < 0.7 and {r.type for r in stated} == {t for t, _, _ in made.STATED}
    assert all(r.value in r.message and 0.8 <= r.confidence < 1.0 and "{" not in r.message for r in stated)
    assert all(r.type is None and r.value is None for r in rows if not r.has_memory)


def test_made_sweep(spark):
    rows = made.sweep(spark, distances=(5, 20)).collect()
    assert sorted((r.turn, r.distance) for r in rows if r.has_memory) == [(10, 20), (25, 5)]
    assert [r.turn for r in rows if r.is_query] == [30] and len(rows) == 30


def test_merge_effect(spark):
    form = "user_id long, memory_id string, type string, key string"
    before = spark.createDataFrame([(1, "a", "t", "k"), (1, "b", "t", "k"), (1, "c", "t", "other"), (2, "d", "t", "k")], form)
    after = spark.createDataFrame([(1, "merged_1", "t", "k"), (1, "c", "t", "other")], form)
    got = {r.user_id: (r.total_before, r.total_after, r.reduction, r.merged, r.duplicates_remaining) for r in evaluate.merging(before, after).collect()}
    assert got == {1: (3, 2, 1, 1, 0), 2: (1, 0, 1, 0, 0)}


def test_ties_of_equal_vectors_stay_ties(spark):
    draw = random.Random(1)
    vector = lambda: [float(np.float32(draw.gauss(0, 1))) for _ in range(64)]
    cosine = lambda x, y: dot(x, y) / (math.sqrt(dot(x, x)) * math.sqrt(dot(y, y)))

    def dot(x, y):
        total = 0.0
        for a, b in zip(x, y):
            total += a * b
        return total

    pairs = {g: (vector(), vector()) for g in range(2, 14)}
    asked = spark.createDataFrame([(g, g, q) for g, (q, _) in pairs.items()], "g long, query_id long, vector array<float>")
    rows = spark.createDataFrame([(g, 100 * g + k, r) for g, (_, r) in pairs.items() for k in range(g)], "g long, id long, vector array<float>")
    for limit in (20, 5):
        found = {}
        for r in vectors.nearest(asked, rows, ["g"], limit, -1.0).collect():
            found.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
        assert {g: sorted(x) for g, x in found.items()} == {g: [(k + 1, 100 * g + k, cosine(q, r)) for k in range(min(g, limit))] for g, (q, r) in pairs.items()}
    edge = cosine(*pairs[7])
    assert vectors.nearest(asked.where("g = 7"), rows, ["g"], 20, edge).count() == 7
    assert vectors.nearest(asked.where("g = 7"), rows, ["g"], 20, math.nextafter(edge, 1)).count() == 0
    near = vectors.similar_pairs(rows, ["g"], 0.9).collect()
    assert len(near) == sum(g * (g - 1) // 2 for g in pairs) and all(r.score == cosine(pairs[r.id // 100][1], pairs[r.id // 100][1]) for r in near)
