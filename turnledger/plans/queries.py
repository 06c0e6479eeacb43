"""The queries: each an operator over the tables, as plain columns."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import similarity, update_intent
from ..operators import consolidate, core_memory, evaluate, extract, model_stage, retrieve, store, vectors
from ..settings import DEFAULT
from ..sources import conversations as made
from ..sources.tables import from_conversations, stored, table, turns
from ..streaming.replay import processed, replayed, turn_stats
from ..system import latencies, log_summary, turn_log

SETTINGS = replace(DEFAULT, priority_types=("entity",), decay_age=20, decay_idle=10, decay_rate=0.05, promote_mentions=2, promote_age=10, merge_threshold=0.3)
#: For runs over few turns: what decays and is promoted is younger than by default.
RUNS = replace(SETTINGS, decay_enabled=True, dedup_threshold=0.8, consolidation_every=10, consolidation_least=5)


def r6(name: str):
    return F.round(name, 6).alias(name)


def arrivals(spark, d) -> DataFrame:
    return extract.stored_candidates(turns(spark, d))


def now(spark, d) -> DataFrame:
    return turns(spark, d).groupBy("user_id").agg((F.max("turn_number") + 1).alias("now"))


def memories(spark, d) -> DataFrame:
    """The store after all turns, with links of updates and accesses made up from turns; written once for all that reads it."""
    rows = stored(store.upserted(arrivals(spark, d)), "upserted")
    rows = store.superseded(rows, store.update_links(rows))
    access = (F.col("turn_number") * 7 + F.length("key")) % 23
    rows = rows.join(now(spark, d), "user_id").withColumn("access_count", access).withColumn("last_accessed_turn", F.col("turn_number") + access % 5)
    return stored(rows, "memories")


def placed(spark, d, rows: DataFrame, place) -> DataFrame:
    """``rows`` with ``vector``: the one of ``embeddings`` at ``place``, over all of the table."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return rows.withColumn("vec_id", (place % F.lit(max(1, e.count()))).cast("long")).join(e, "vec_id").drop("vec_id")


def memory_vectors(spark, d, m: DataFrame) -> DataFrame:
    return placed(spark, d, m, F.col("turn_number") * 31 + F.length("value"))


def hits(spark, d, m: DataFrame) -> DataFrame:
    rows = memory_vectors(spark, d, m).select("user_id", F.col("memory_id").alias("id"), "vector")
    asked = placed(spark, d, m.select("user_id").distinct(), F.col("user_id")).select("user_id", F.col("user_id").alias("query_id"), "vector")
    found = vectors.nearest(asked, rows, ["user_id"], SETTINGS.semantic_limit, SETTINGS.min_semantic)
    return stored(found.select(F.col("query_id").alias("user_id"), F.col("id").alias("memory_id"), "score"), "hits")


def top(spark, d, signals: int = 5, m: DataFrame | None = None) -> DataFrame:
    return retrieve.top(ranked(spark, d, signals, m), SETTINGS)


def ranked(spark, d, signals: int = 5, m: DataFrame | None = None) -> DataFrame:
    m = memories(spark, d) if m is None else m
    return retrieve.ranked(m.join(retrieve.candidates(m, hits(spark, d, m), SETTINGS), ["user_id", "memory_id"]), SETTINGS, signals)


def payload_top(spark, d) -> DataFrame:
    """Retrieval where a sixth of the memories has left the store but not the vectors: their payload takes their place."""
    m = memories(spark, d)
    left = m.where("turn_number % 6 != 0")
    payload = m.select("user_id", "memory_id", "type", "key", "value", "confidence", "turn_number")
    return retrieve.hybrid(left, hits(spark, d, m), now(spark, d), SETTINGS, payload=payload)


def aged(spark, d) -> DataFrame:
    return memories(spark, d).withColumn("promoted", F.col("access_count") % 7 == 0)


def vecs(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def pairs(spark, d, m: DataFrame | None = None) -> DataFrame:
    """Active memories of one user and type whose vectors are near, the earlier first (a, b)."""
    m = store.active(memories(spark, d) if m is None else m)
    near = vectors.similar_pairs(memory_vectors(spark, d, m).select("user_id", "type", F.col("memory_id").alias("id"), "vector"), ["user_id", "type"], SETTINGS.merge_threshold)
    one = m.select(F.col("memory_id").alias("id"), F.struct(*m.columns).alias("x"))
    both = near.join(one, "id").join(one.select(F.col("id").alias("other_id"), F.col("x").alias("y")), "other_id")
    first = F.col("x.arrival") < F.col("y.arrival")
    a, b = F.when(first, F.col("x")).otherwise(F.col("y")), F.when(first, F.col("y")).otherwise(F.col("x"))
    return both.select(F.col("x.user_id").alias("user_id"), F.col("x.now").alias("now"), "score", a.alias("a"), b.alias("b"))


def truth(spark, d) -> DataFrame:
    return extract.extracted(turns(spark, d)).select("user_id", F.col("arrival").alias("id"), "type", "key", "value", "turn_number")


def found(spark, d) -> DataFrame:
    return top(spark, d).select("user_id", "memory_id", "type", "key", "value", "rank", "now")


def core_lines(spark, d) -> DataFrame:
    p = stored(consolidate.promotable(aged(spark, d), SETTINGS), "promotable")
    none = p.where("false").select("user_id", "file", "section", "line", F.lit(0).alias("pos"))
    return core_memory.appended(none, p.select("user_id", "file", "section", F.col("arrival").alias("at"), "line"))


def documents(spark, d) -> DataFrame:
    return core_memory.rendered(core_lines(spark, d))


def sessions(s, d, fold):
    """All turns through a whole session each, with the arrivals of the first two stages."""
    return fold(turns(s, d), stored(arrivals(s, d), "arrivals"), vectors.hashing_embedder, RUNS)


def answers(spark, d) -> DataFrame:
    """Answers of a model, made from what patterns find: some fenced, some broken."""
    rows = arrivals(spark, d)
    item = F.struct("type", "key", "value", "confidence")
    own = rows.groupBy("user_id", "turn_number").agg(F.to_json(F.array_sort(F.collect_list(F.struct("arrival", item.alias("x"))))["x"]).alias("j"))
    kind = F.col("turn_number") % 4
    answer = F.when(kind == 0, F.concat(F.lit("```json\n"), F.col("j"), F.lit("\n```"))).when(kind == 1, F.lit("no json")).otherwise(F.col("j"))
    return own.select("user_id", "turn_number", answer.alias("answer"))


def extract_query(kind: str):
    return lambda s, d: extract.extracted(turns(s, d), kind).select("user_id", "turn_number", "key", "value", r6("confidence"), "memory_id")


def consolidation_due(s, d):
    n = memories(s, d).groupBy("user_id", "turn_number").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("user_id").orderBy("turn_number")
    t = turns(s, d).select("user_id", "turn_number").join(n, ["user_id", "turn_number"], "left").withColumn("stored", F.sum(F.coalesce("k", F.lit(0))).over(w))
    return consolidate.needs_consolidation(t)


def log_of_extraction(s, d):
    n = arrivals(s, d).groupBy("user_id", "turn_number").agg(F.count(F.lit(1)).alias("k"))
    t = turns(s, d).join(n, ["user_id", "turn_number"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return t.groupBy("user_id").agg(F.count(F.lit(1)).alias("turns"), F.sum("k").alias("extracted"), F.round(F.avg("k"), 6).alias("average"))


def stage_rows(s, d):
    two = arrivals(s, d).withColumn("stage", F.lit(2))
    three = two.where("turn_number % 3 = 0").withColumn("stage", F.lit(3)).withColumn("confidence", F.col("confidence") + 0.01)
    return two.unionByName(three).select("user_id", "turn_number", "type", "key", "value", "confidence", "arrival", "stage")


def merge_greedy(s, d):
    rows = vecs(s, d).withColumnRenamed("label", "user_id")
    c = vectors.duplicate_candidates(rows, ["user_id"], 0.25)
    return consolidate.greedy_pairs(c.select(F.col("user_id").cast("long"), "id", "other_id", "score", (-F.col("id")).alias("place"))).select("user_id", "id", "other_id", r6("score"))


def knn(s, d, on=(), types=None):
    """Every hundredth vector as a query, against all rows, or those of its label, or those of some labels."""
    rows = vecs(s, d).withColumn("memory_type", F.col("label").cast("string"))
    q = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector", "label")
    return vectors.nearest(q, rows, list(on), 10, 0.1, types).select("query_id", "id", "rank", r6("score"))


def points(s, d):
    return vectors.points(memories(s, d)).select("memory_id", F.col("point_id").cast("string").alias("point_id"), "text")


def upserted_points(s, d):
    """Points of which a quarter comes anew, in two versions: the later one counts."""
    p = points(s, d)
    new = p.where("length(text) % 4 = 0")
    versions = new.withColumn("text", F.upper("text")).withColumn("at", F.lit(2)).unionByName(new.withColumn("text", F.lit("old")).withColumn("at", F.lit(1)))
    return vectors.put(p, versions)


def text_search(s, d):
    """The first turn of each user as a query by its text over the points of the memories."""
    m = memories(s, d)
    asked = turns(s, d).where("turn_number = 1").select(F.col("user_id").alias("query_id"), "user_id", "text")
    return vectors.searched(asked, vectors.indexed(m), 10, ("preference", "constraint", "instruction", "entity"), 0.1).select("query_id", "memory_id", "rank", r6("score"))


def decay_runs(s, d):
    """Two runs of decay, fifty turns apart, the second on what the first left."""
    one = consolidate.decay_applied(aged(s, d), SETTINGS)
    return consolidate.decay_applied(one.withColumn("now", F.col("now") + 50), SETTINGS).select("memory_id", r6("confidence"), r6("decay_applied"))


def statistics(s, d):
    m = memories(s, d)
    by = store.counts_by_type(m)
    rows = m.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_distinct("type").alias("types"), F.sum("mention_count").alias("mentions"), F.count("superseded_by").alias("superseded"))
    indexed = vectors.points(m).select("memory_id").join(m.select("memory_id", "user_id"), "memory_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("vector_count"))
    return rows.join(by, "user_id").join(indexed, "user_id")


def refreshed(s, d):
    m = memories(s, d)
    return store.with_recency(m, m.where("turn_number % 3 = 0").select("memory_id", (F.col("now") * 60.0).alias("at"))).select("memory_id", "recency_ts")


def cosines(s, d):
    e = vecs(s, d)
    other = e.select("label", (F.col("id") - 10).alias("id"), F.col("id").alias("other_id"), F.col("vector").alias("w"))
    return e.join(other, ["label", "id"]).select("id", "other_id", F.round(similarity(F.col("vector"), F.col("w")), 6).alias("score"))


def prompts(s, d):
    t = turns(s, d)
    e = extract.escalation(t).where("needs_model").select("user_id", "turn_number", "hint")
    return model_stage.prompts(extract.context(t).join(e, ["user_id", "turn_number"])).select("user_id", "turn_number", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("prompt_length"))


def merge_effect(s, d):
    """Merges over active rows; the rows of other users and types stay."""
    m = memories(s, d)
    own = store.active(m)
    return evaluate.merging(own, store.active(consolidate.merge_result(own, stored(consolidate.merged_records(pairs(s, d, m)), "merged"))))


def suite(s, d):
    """All measures of retrieval and extraction, averaged over users."""
    f, t = stored(found(s, d), "found"), stored(truth(s, d).join(now(s, d), "user_id"), "truth")
    return evaluate.suite({
        "context_precision.precision": evaluate.context_precision(f, t), "context_recall.recall": evaluate.context_recall(f, t), "ranking.mrr": evaluate.ranking_quality(f, t),
        "ranking.avg_position": evaluate.ranking_quality(f, t), "distance.recall": evaluate.distance_recall(f, t, (5, 10, 25, 50)),
    }).withColumn("value", F.round("value", 6))


def made_recall(s, d):
    """What patterns find in made-up conversations, against their truth."""
    rows = made.batch(s)
    return evaluate.greedy_extraction(extract.stored_candidates(made.as_turns(rows)), made.truth(rows)).select("user_id", "tp", "fp", "fn", r6("f1"))


TIMES = ("storage_time_ms", "retrieval_time_ms")
RANKED = ("user_id", "rank", "memory_id", "type")
ids = lambda df: df.select("memory_id")

QUERIES = {
    "turns_view": turns,
    "sensory_score": lambda s, d: extract.scored(turns(s, d)).select("user_id", "turn_number", r6("score"), "passed"),
    "sensory_filter_rate_by_role": lambda s, d: extract.scored(from_conversations(table(s, d, "conversations"))).groupBy("role").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("passed"), 1)).alias("n_passed"), F.round(F.avg("score"), 6).alias("average")),
    **{f"extract_{k}": extract_query(k) for k in ("preference", "constraint", "entity", "commitment", "instruction")},
    "extract_payment": extract_query("fact"),
    "extract_all_counts": lambda s, d: extract.extracted(turns(s, d)).groupBy("type", "key").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("average")),
    "confidence_modifiers": lambda s, d: extract.extracted(turns(s, d)).where("confidence != base").select("memory_id", "base", r6("confidence")),
    "min_confidence_filter": lambda s, d: arrivals(s, d).select("user_id", "memory_id", "type", r6("confidence")),
    "escalation_flags": lambda s, d: extract.escalation(turns(s, d)).select("user_id", "turn_number", r6("score"), "matches", r6("best"), "hint", "needs_model"),
    "context_buffer": lambda s, d: extract.context(turns(s, d)).select("user_id", "turn_number", "context"),
    "update_intent": lambda s, d: turns(s, d).select("user_id", "turn_number", update_intent(F.col("text")).alias("update_intent")),
    "keydedup_upsert": lambda s, d: store.upserted(arrivals(s, d)).select("user_id", "type", "key", "memory_id", "value", r6("confidence"), "mention_count", "turn_number", "recency_ts"),
    "point_lookup": lambda s, d: store.by_ids(memories(s, d), ids(extract.extracted(turns(s, d)).where("turn_number % 10 = 0"))).select("user_id", "memory_id", "type", "key", "value"),
    "count_all": lambda s, d: memories(s, d).agg(F.count(F.lit(1)).alias("n")),
    "count_by_type": lambda s, d: store.counts(memories(s, d)),
    "recent_topk": lambda s, d: store.recent(memories(s, d), 20).select("user_id", "rn", "memory_id"),
    "by_type_limit": lambda s, d: store.by_type(memories(s, d), "preference", 5).select("user_id", "type", "memory_id"),
    "by_type_and_key": lambda s, d: store.by_type_and_key(memories(s, d), "entity", "user_name").select("user_id", "memory_id", "value"),
    "oldest_scan": lambda s, d: store.oldest(memories(s, d), 10).select("user_id", "memory_id", "rn"),
    "delete_anti": lambda s, d: store.deleted(m := memories(s, d), ids(m.where("turn_number % 5 = 0"))).select("user_id", "memory_id"),
    "supersede_links": lambda s, d: memories(s, d).where("superseded_by is not null or supersedes is not null").select("memory_id", "superseded_by", "supersedes"),
    "superseded_filter": lambda s, d: store.active(memories(s, d)).select("user_id", "memory_id"),
    "boost_confidence": lambda s, d: store.with_mention(m := memories(s, d), ids(m).union(ids(m))).select("memory_id", r6("confidence"), "mention_count"),
    "access_increment": lambda s, d: store.with_access(m := memories(s, d), top(s, d, 5, m).select("memory_id", F.col("now").alias("turn"))).select("memory_id", "access_count", "last_accessed_turn"),
    "update_field": lambda s, d: store.with_field(m := memories(s, d), m.where("type = 'entity'"), "value", "checked").select("memory_id", "value"),
    "refresh_recency": refreshed,
    "clear_all": lambda s, d: store.cleared(memories(s, d)).select("user_id", "memory_id"),
    "hash_point_id": lambda s, d: vectors.points(memories(s, d)).select("memory_id", F.col("point_id").cast("string").alias("point_id")),
    "memory_embed_text": lambda s, d: vectors.points(memories(s, d)).select("memory_id", "text"),
    "cosine_similarity": cosines,
    "knn_filtered": lambda s, d: knn(s, d, on=("label",)),
    "knn_threshold_pairs": lambda s, d: vectors.similar_pairs(vecs(s, d), [], 0.3).select("id", "other_id", r6("score")),
    "knn_all": lambda s, d: knn(s, d),
    "knn_types": lambda s, d: knn(s, d, types=("1", "3", "5")),
    "point_upsert": upserted_points,
    "point_delete": lambda s, d: vectors.removed(points(s, d), memories(s, d).where("turn_number % 5 = 0")).select("memory_id", "point_id"),
    "point_count": lambda s, d: vectors.counted(points(s, d)),
    "text_search": text_search,
    "semantic_dedup_candidates": lambda s, d: vectors.duplicate_candidates(vecs(s, d), ["label"], 0.25).select("label", "id", "other_id", "rank", r6("score")),
    "hybrid_candidates": lambda s, d: retrieve.candidates(m := memories(s, d), hits(s, d, m), SETTINGS).select("user_id", "memory_id", r6("semantic_score"), "branch"),
    "rank_5_signal": lambda s, d: ranked(s, d).select("user_id", "memory_id", r6("type_score"), r6("recency_score"), r6("frequency_score"), r6("retrieval_score")),
    "rank_3_signal": lambda s, d: ranked(s, d, 3).select("user_id", "memory_id", r6("retrieval_score")),
    "retrieve_hybrid_topk": lambda s, d: top(s, d).select(*RANKED, r6("retrieval_score")),
    "retrieve_3_signal_topk": lambda s, d: top(s, d, 3).select(*RANKED, r6("retrieval_score")),
    "retrieve_payload_topk": lambda s, d: payload_top(s, d).select(*RANKED, r6("retrieval_score")),
    "retrieve_basic_priority_topk": lambda s, d: retrieve.retrieved(memories(s, d), settings=replace(SETTINGS, semantic=False)).select(*RANKED, r6("retrieval_score")),
    "retrieve_basic_topk": lambda s, d: retrieve.basic(memories(s, d)).select(*RANKED, r6("retrieval_score")),
    "format_prompt": lambda s, d: retrieve.prompt(top(s, d)),
    "active_memories": lambda s, d: retrieve.active_memories(top(s, d)).withColumn("confidence", F.round("confidence", 6)),
    "decay_runs": decay_runs,
    "decay": lambda s, d: consolidate.decayed(aged(s, d), SETTINGS).select("memory_id", r6("decay"), r6("new_confidence"), "deleted"),
    "merge_pairs": lambda s, d: pairs(s, d).select("user_id", F.col("a.memory_id").alias("a_id"), F.col("b.memory_id").alias("b_id")),
    "merged_record": lambda s, d: consolidate.merged_records(pairs(s, d)).select("user_id", "memory_id", "key", "value", r6("confidence"), "mention_count", "access_count", "merged_from"),
    "merge_greedy": merge_greedy,
    "consolidation_due": consolidation_due,
    "promotion": lambda s, d: consolidate.promotable(aged(s, d), SETTINGS).select("user_id", "memory_id", "file", "section", "line"),
    "core_memory_render": documents,
    "core_memory_prompt": lambda s, d: core_memory.joined(documents(s, d)),
    "statistics": statistics,
    "memories_by_type": lambda s, d: memories(s, d).groupBy("user_id", "type").agg(F.concat_ws(",", F.array_sort(F.collect_list("memory_id"))).alias("ids")),
    "turn_log_summary": log_of_extraction,
    "stage_merge": lambda s, d: extract.merged_stages(stage_rows(s, d)).withColumn("confidence", F.round("confidence", 6)),
    "llm_prompt": prompts,
    "llm_parse": lambda s, d: model_stage.parsed(answers(s, d)).withColumn("confidence", F.round("confidence", 6)),
    "replay_keyed": lambda s, d: replayed(arrivals(s, d)).select("user_id", "type", "key", "memory_id", "value", r6("confidence"), "mention_count"),
    "replay_turns": lambda s, d: replayed(arrivals(s, d), vectors.hashing_embedder, RUNS).select("user_id", "type", "key", "memory_id", "value", r6("confidence"), "mention_count", "superseded_by"),
    "process_turns": lambda s, d: sessions(s, d, processed).withColumn("confidence", F.round("confidence", 6)).withColumn("decay_applied", F.round("decay_applied", 6)),
    "turn_stats": lambda s, d: sessions(s, d, turn_stats).drop(*TIMES),
    "turn_latencies": lambda s, d: latencies(sessions(s, d, turn_stats)).select("stage", "turns", (F.col("most") >= F.col("median")).alias("in_order")),
    "turn_log": lambda s, d: turn_log(sessions(s, d, turn_stats).drop(*TIMES)).withColumn("conversation_turns", F.to_json("conversation_turns")),
    "log_summary": lambda s, d: log_summary(sessions(s, d, turn_stats)),
    "consolidation_run": lambda s, d: consolidate.run(aged(s, d), RUNS, stored=stored)[2],
    "merged_store": lambda s, d: consolidate.merged_store(aged(s, d), RUNS).withColumn("confidence", F.round("confidence", 6)),
    "core_documents": lambda s, d: core_memory.whole(core_memory.templates(memories(s, d), "2024-01-01"), core_lines(s, d)),
    "prompt_context": lambda s, d: retrieve.whole_prompt(core_memory.joined(documents(s, d)), top(s, d)),
    "eval_context_precision": lambda s, d: evaluate.context_precision(found(s, d), truth(s, d)).withColumn("precision", F.round("precision", 6)),
    "eval_context_recall": lambda s, d: evaluate.context_recall(found(s, d), truth(s, d)).withColumn("recall", F.round("recall", 6)),
    "eval_mrr_topk": lambda s, d: evaluate.ranking_quality(found(s, d), truth(s, d)).select("user_id", *map(r6, ("mrr", "avg_position", "top_1", "top_3", "top_5", "top_10"))),
    "eval_distance_sweep": lambda s, d: evaluate.distance_recall(found(s, d), truth(s, d).join(now(s, d), "user_id"), (5, 10, 25, 50)).withColumn("recall", F.round("recall", 6)),
    "eval_decay": lambda s, d: evaluate.decay_effect(m := consolidate.decayed(aged(s, d), SETTINGS), m.select("memory_id", F.col("new_confidence").alias("confidence"))).withColumn("average_loss", F.round("average_loss", 6)),
    "eval_merge": merge_effect,
    "generated_conversations": lambda s, d: made.batch(s),
    "generated_sweep": lambda s, d: made.sweep(s),
    "eval_generated_f1": made_recall,
    "eval_duplicates": lambda s, d: evaluate.duplicates(arrivals(s, d)),
    "eval_promotion": lambda s, d: evaluate.promotion_share(memories(s, d).where("mention_count >= 2").select("user_id", "key"), documents(s, d)).withColumn("rate", F.round("rate", 6)),
    "eval_extraction_greedy": lambda s, d: evaluate.greedy_extraction(arrivals(s, d), truth(s, d)),
    "eval_suite": suite,
}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Turns to ranked memories: extraction, upsert, hybrid retrieval of the best 50 a user."""
    return QUERIES["retrieve_hybrid_topk"](spark, d)
