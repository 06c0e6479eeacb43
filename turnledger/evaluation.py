"""The whole evaluation over made-up conversations, as a command: python -m turnledger.evaluation OUT.json"""

from __future__ import annotations

import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import consolidate, evaluate, extract, vectors
from .settings import DEFAULT, Settings
from .sources import conversations as made
from .sources.tables import stored
from .system import MemorySystem

EVALUATED = 50


def found_for_last(system: MemorySystem, turns: DataFrame) -> DataFrame:
    """What retrieval gives for the last message of each user: user_id, memory_id, type, key, value, rank."""
    last = turns.groupBy("user_id").agg(F.max_by("text", "turn_number").alias("text"))
    return stored(system.retrieve(last).select("user_id", "memory_id", "type", "key", "value", "rank"), "found")


def whole_suite(spark: SparkSession, settings: Settings = DEFAULT, conversations: int = EVALUATED, distances: tuple[int, ...] = made.DISTANCES) -> dict:
    """Extraction, retrieval, recall by distance, and consolidation of the first conversation; averages over conversations."""
    begin = time.time()
    rows = made.batch(spark, conversations=conversations)
    turns, truth = stored(made.as_turns(rows), "turns"), stored(made.truth(rows), "truth")
    system = MemorySystem(spark, settings)
    system.process(turns)
    extraction = evaluate.macro(evaluate.greedy_extraction(extract.stored_candidates(turns, settings), truth), "precision", "recall", "f1").first()
    found = found_for_last(system, turns)
    retrieval = evaluate.suite({
        "context.precision": evaluate.context_precision(found, truth), "context.recall": evaluate.context_recall(found, truth), "ranking.mrr": evaluate.ranking_quality(found, truth),
        "ranking.top_10": evaluate.ranking_quality(found, truth),
    }).collect()
    sweep = made.sweep(spark, distances=distances)
    far, far_turns = MemorySystem(spark, settings), stored(made.as_turns(sweep), "turns")
    far.process(far_turns)
    at = far_turns.groupBy("user_id").agg(F.max("turn_number").alias("now"))
    by = evaluate.distance_recall(found_for_last(far, far_turns), made.truth(sweep).join(at, "user_id"), distances).collect()
    one = system.memories.join(system.now(), "user_id").where(F.col("user_id") == 1)
    _, _, ran = consolidate.run(one, settings, True, vectors.hashing_embedder, stored)
    return {
        "duration_seconds": round(time.time() - begin, 3), "conversations": conversations, "turns": turns.count(), "memories": truth.count(),
        "extraction": extraction.asDict(), "retrieval": {r.metric: r.value for r in retrieval},
        "distance_sweep": {str(r.distance): {"recall": r.recall, "found": r.found, "expected": r.expected} for r in sorted(by)}, "consolidation": [r.asDict() for r in ran.collect()],
    }


def main(out: str) -> int:
    """Runs the suite and writes its JSON; 1 where the memory cannot be read."""
    spark = SparkSession.builder.appName("evaluation").getOrCreate()
    health = MemorySystem(spark).health()
    if not all(x in (True, None) for x in health.values()):
        print(f"not in order: {health}", file=sys.stderr)
        return 1
    result = whole_suite(spark)
    with open(out, "w", encoding="utf-8") as file:
        json.dump(result, file, indent=2)
    print(json.dumps(result))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "evaluation.json"))
