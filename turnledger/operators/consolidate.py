"""Consolidation: decay, merging, promotion."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import DEFAULT, PROMOTION_TARGET, Settings
from .store import active, recent
from .vectors import hashing_embedder


def decayed(memories: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Confidence after one run of decay at ``now``: promoted and young rows stay, idle ones lose more; with deleted."""
    age, idle = F.col("now") - F.col("turn_number"), F.col("now") - F.col("last_accessed_turn")
    loss = age / F.lit(100.0) * settings.decay_rate
    loss = loss + F.when(idle > settings.decay_idle, (idle - settings.decay_idle) / F.lit(100.0) * settings.decay_rate * 0.5).otherwise(0.0)
    loss = F.when(F.col("promoted") | (age < settings.decay_age), F.lit(0.0)).otherwise(loss)
    new = F.when(loss > 0, F.greatest(F.lit(settings.decay_floor), F.col("confidence") - loss)).otherwise(F.col("confidence"))
    return memories.withColumn("decay", loss).withColumn("new_confidence", new).withColumn("deleted", F.col("new_confidence") < settings.decay_delete)


def decay_applied(memories: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The store after a run of decay: lower confidences, what has been taken so far (decay_applied), and without the rows that fell below the limit.

    A later run takes the whole loss of a row's age again.
    """
    before = F.col("decay_applied") if "decay_applied" in memories.columns else F.lit(0.0)
    rows = decayed(memories.withColumn("decay_applied", before), settings)
    rows = rows.withColumn("decay_applied", F.col("decay_applied") + F.col("decay")).where(~F.col("deleted"))
    return rows.withColumn("confidence", F.col("new_confidence")).drop("decay", "new_confidence", "deleted")


def merged_value(a: Column, b: Column, length: int = 500) -> Column:
    """The one if they are equal, the longer if it holds the other, else both, cut."""
    return F.when(a == b, a).when(F.contains(b, a), b).when(F.contains(a, b), a).otherwise(F.left(F.concat(a, F.lit("; "), b), F.lit(length)))


def merged_records(pairs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Records made of pairs (structs a and b, now): the surer one leads, a of equals."""
    lead = F.when(F.col("b.confidence") > F.col("a.confidence"), F.col("b")).otherwise(F.col("a"))
    ids = F.concat_ws("_", "a.memory_id", "b.memory_id", F.col("now").cast("string"))
    return pairs.select(
        lead["user_id"].alias("user_id"), F.concat(F.lit("merged_"), F.left(F.md5(ids), F.lit(8))).alias("memory_id"), lead["type"].alias("type"), lead["key"].alias("key"),
        merged_value(F.col("a.value"), F.col("b.value"), settings.merge_length).alias("value"),
        F.least(F.lit(settings.max_confidence), (F.col("a.confidence") + F.col("b.confidence")) / 2 + 0.05).alias("confidence"),
        (F.col("a.mention_count") + F.col("b.mention_count")).alias("mention_count"), (F.col("a.access_count") + F.col("b.access_count")).alias("access_count"),
        F.col("now").alias("turn_number"), F.concat_ws(",", "a.memory_id", "b.memory_id").alias("merged_from"),
    )


def greedy_pairs(scored: DataFrame) -> DataFrame:
    """A matching of pairs (user_id, id, other_id, score, place): in the order of ``place`` each free row takes its best free partner.

    A scope is one group: a user's pairs above the threshold, which are few.
    """

    def match(pairs: pd.DataFrame) -> pd.DataFrame:
        free: set[int] = set()
        out = []
        for _, own in pairs.sort_values(["place", "id"], kind="stable").groupby("place", sort=True):
            own = own.sort_values(["score", "other_id"], ascending=[False, True])
            if own["id"].iloc[0] in free:
                continue
            for row in own.itertuples(index=False):
                if row.other_id not in free:
                    free |= {row.id, row.other_id}
                    out.append((row.user_id, row.id, row.other_id, row.score))
                    break
        return pd.DataFrame(out, columns=["user_id", "id", "other_id", "score"])

    return scored.groupBy("user_id").applyInPandas(match, "user_id long, id long, other_id long, score double")


def merge_result(memories: DataFrame, merged: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The store after merges. Mode "intended" puts the record in place of its sources; "compat" keeps them, as their key is taken, and boosts the first."""
    source = merged.select(F.explode(F.split("merged_from", ",")).alias("memory_id"), F.col("memory_id").alias("by"))
    if settings.merge_mode == "compat":
        boost = merged.where("key != ''").select(F.split("merged_from", ",")[0].alias("memory_id")).distinct().withColumn("hit", F.lit(True))
        rows = memories.join(boost, "memory_id", "left")
        return rows.withColumn("confidence", F.when(F.col("hit"), F.least(F.col("confidence") + settings.boost, F.lit(settings.max_confidence))).otherwise(F.col("confidence"))).drop("hit")
    kept = memories.join(source.groupBy("memory_id").agg(F.min("by").alias("by")), "memory_id", "left")
    kept = kept.withColumn("superseded_by", F.coalesce("by", "superseded_by")).drop("by")
    return kept.unionByName(merged.withColumn("superseded_by", F.lit(None).cast("string")), allowMissingColumns=True)


def promotable(memories: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Rows to promote at ``now``, with the document and section they go to and their line."""
    s = settings
    rows = active(memories).where(
        ~F.col("promoted") & (F.col("confidence") >= s.promote_confidence) & (F.col("mention_count") >= s.promote_mentions)
        & (F.col("access_count") >= s.promote_accesses) & (F.col("now") - F.col("turn_number") >= s.promote_age) & F.col("type").isin(*PROMOTION_TARGET)
    )
    to = lambda k: F.element_at(F.create_map(*[F.lit(x) for t, v in PROMOTION_TARGET.items() for x in (t, v[k])]), F.col("type"))
    line = F.concat(F.lit("- **"), F.col("key"), F.lit(":** "), F.col("value"))
    return rows.withColumns({"file": to(0), "section": to(1), "line": line})


def needs_consolidation(turns: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Turns (user_id, turn_number, stored: rows so far) at which a run is due: the first with enough rows, then every so many turns on."""
    first = turns.where(F.col("stored") >= settings.consolidation_least).groupBy("user_id").agg(F.min("turn_number").alias("first"))
    rows = turns.join(first, "user_id").where(F.col("turn_number") >= F.col("first"))
    return rows.where((F.col("turn_number") - F.col("first")) % settings.consolidation_every == 0).select("user_id", "turn_number")


#: What a memory carries through a run of merges.
RECORD = (
    "user_id long, memory_id string, type string, key string, value string, confidence double, mention_count int, access_count int, "
    "turn_number int, last_accessed_turn int, recency_ts double, superseded_by string, supersedes string, promoted boolean, merged_from string"
)
NAMES = [c.split()[0] for c in RECORD.split(", ")]


def text_of(row: dict) -> str:
    """What a memory is embedded by."""
    return " | ".join(x for x in (row["key"], row["value"], f"type: {row['type']}" if row["type"] else "") if x)


def is_active(row: dict) -> bool:
    return (row.get("superseded_by") or "") in ("", "None")


def merge_values(a: str, b: str, length: int) -> str:
    if a == b or b in a:
        return a
    return b if a in b else f"{a}; {b}"[:length]


def merged_row(a: dict, b: dict, now: int, settings: Settings = DEFAULT) -> dict:
    """The record of two memories; the surer one leads, ``a`` of equals."""
    import hashlib

    lead = b if b["confidence"] > a["confidence"] else a
    name = "merged_" + hashlib.md5(f"{a['memory_id']}_{b['memory_id']}_{now}".encode()).hexdigest()[:8]
    return {
        **lead, "memory_id": name, "value": merge_values(a["value"], b["value"], settings.merge_length),
        "confidence": min(settings.max_confidence, (a["confidence"] + b["confidence"]) / 2 + 0.05), "mention_count": a["mention_count"] + b["mention_count"],
        "access_count": a["access_count"] + b["access_count"], "turn_number": now, "last_accessed_turn": now, "recency_ts": now * 60.0,
        "superseded_by": None, "supersedes": b["memory_id"], "promoted": False, "merged_from": f"{a['memory_id']},{b['memory_id']}",
    }


class Vectors:
    """Vectors of a scope's memories in the order in which they came, as one matrix that grows by doubling."""

    def __init__(self, embed: Callable[[list[str]], list[list[float]]]):
        self.embed, self.names, self.place = embed, [], {}
        self.matrix = np.zeros((16, 0))

    def put(self, row: dict, vector=None) -> None:
        vector = np.asarray(self.embed([text_of(row)])[0] if vector is None else vector, dtype=np.float64)
        if not self.matrix.shape[1]:
            self.matrix = np.zeros((16, len(vector)))
        if row["memory_id"] in self.place:
            self.matrix[self.place[row["memory_id"]]] = vector
            return
        if len(self.names) == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        self.place[row["memory_id"]] = len(self.names)
        self.matrix[len(self.names)] = vector
        self.names.append(row["memory_id"])

    def near(self, text: str, least: float, limit: int, wanted: Callable[[str], bool] = lambda _: True) -> list[tuple[str, float]]:
        """Up to ``limit`` names whose vectors are at least so near to a text's, the nearest first, of equals the earlier."""
        if not self.names or not text.strip():
            return []
        score = self.matrix[: len(self.names)] @ np.asarray(self.embed([text])[0], dtype=np.float64)
        found = []
        for k in np.argsort(-score, kind="stable"):
            if score[k] < least or len(found) == limit:
                break
            if wanted(self.names[k]):
                found.append((self.names[k], float(score[k])))
        return found


def merge_rows(store: dict[str, dict], vectors: Vectors, now: int, settings: Settings = DEFAULT, keys: dict | None = None) -> int:
    """One run of merges over a scope's memories, in place; returns how many were made.

    The newest rows first: each row that is active, not promoted and not merged
    yet looks for the vectors nearest to its value, and is merged with the first
    other one that is of its type, active and not merged. A record joins the
    vectors at once, so later rows can meet it. Mode "intended" puts the record
    in place of its sources; "compat" keeps them where their key is taken, and
    boosts and refreshes its owner.
    """
    done, made, keys = set(), 0, {} if keys is None else keys
    newest = sorted(store.values(), key=lambda r: (r["recency_ts"], r["memory_id"]), reverse=True)[: settings.merge_rows]
    for row in newest:
        name = row["memory_id"]
        if name in done or not is_active(row) or row.get("promoted"):
            continue
        for other, _ in vectors.near(row["value"] or "", settings.merge_threshold, settings.merge_limit, store.__contains__):
            twin = store[other]
            if other == name or other in done or twin["type"] != row["type"] or not is_active(twin):
                continue
            record = merged_row(row, twin, now, settings)
            owner = store.get(keys.get((record["type"], record["key"]), "")) if record["key"] else None
            if settings.merge_mode == "compat" and owner is not None:
                owner["confidence"] = min(owner["confidence"] + settings.boost, settings.max_confidence)
                owner["mention_count"] += 1
                owner["recency_ts"] = record["recency_ts"]
                continue
            store[record["memory_id"]] = record
            if record["key"]:
                keys[record["type"], record["key"]] = record["memory_id"]
            row["superseded_by"] = twin["superseded_by"] = record["memory_id"]
            vectors.put(record)
            done |= {name, other}
            made += 1
            break
    return made


def merged_store(memories: DataFrame, settings: Settings = DEFAULT, make: Callable = hashing_embedder) -> DataFrame:
    """The store after one run of merges in each scope at its turn (now): all rows, and the records that came in.

    Only the newest rows of a scope take part (``merge_rows``), so what one task
    holds of a scope is bounded; older rows pass by unchanged.
    """
    own = memories.select("user_id", "now", *[
        (F.col(n) if n in memories.columns else F.lit(None)).cast(t).alias(n) for n, t in (c.split() for c in RECORD.split(", ")) if n != "user_id"
    ])
    late = recent(own, settings.merge_rows).drop("rn")
    rest = own.join(late.select("memory_id"), "memory_id", "left_anti").select(*NAMES)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        now = int(pdf["now"].iloc[0])
        rows = pdf.sort_values(["recency_ts", "memory_id"]).drop(columns=["now"]).astype(object).where(pdf.notna(), None).to_dict("records")
        store, vectors = {r["memory_id"]: r for r in rows}, Vectors(make())
        for r in rows:
            vectors.put(r)
        keys = {(r["type"], r["key"]): r["memory_id"] for r in reversed(rows) if r["key"]}
        merge_rows(store, vectors, now, settings, keys)
        return pd.DataFrame(list(store.values()), columns=NAMES)

    return late.groupBy("user_id").applyInPandas(run, RECORD).unionByName(rest)


def run(memories: DataFrame, settings: Settings = DEFAULT, force: bool = False, make: Callable | None = hashing_embedder, stored: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One consolidation run in each scope at its turn (now): (store, promoted, stats).

    Decay, then merges, then promotion, each on what the one before left, as
    far as the settings enable them; without an embedder nothing is merged.
    Scopes with too few memories are skipped, unless forced. ``promoted`` are
    the rows for the documents (file, section, line); the store has them
    marked. ``stats`` has user_id, decayed, deleted, merged, promoted, skipped.
    ``stored`` writes what several steps read.
    """
    memories = stored(memories.withColumn("promoted", F.coalesce("promoted", F.lit(False)) if "promoted" in memories.columns else F.lit(False)), "run-before")
    size = memories.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.max("now").alias("at"))
    size = size.withColumn("skipped", F.lit(False) if force else F.col("total") < settings.consolidation_least)
    known = memories.join(size.select("user_id", "skipped"), "user_id")
    own, passed = known.where("not skipped").drop("skipped"), known.where("skipped").drop("skipped")
    zero = F.lit(0).cast("long")
    counts = []
    if settings.decay_enabled:
        lost = decayed(own, settings)
        counts.append(lost.groupBy("user_id").agg(F.count(F.when((F.col("decay") > 0.01) & ~F.col("deleted"), 1)).alias("decayed"), F.count(F.when(F.col("deleted"), 1)).alias("deleted")))
        own = stored(decay_applied(own, settings), "run-decayed")
    if settings.merge_enabled and make is not None:
        after = stored(merged_store(own, settings, make), "run-merged")
        counts.append(after.where("merged_from is not null").join(own.select("memory_id"), "memory_id", "left_anti").groupBy("user_id").agg(F.count(F.lit(1)).alias("merged")))
        more = [c for c in own.columns if c not in NAMES and c != "now"]
        own = after.join(own.select("memory_id", *more), "memory_id", "left").join(size.select("user_id", F.col("at").alias("now")), "user_id")
    out = passed.unionByName(own, allowMissingColumns=True)
    going = promotable(own, settings) if settings.promote_enabled else promotable(own.where("false"), settings)
    going = stored(going, "run-promoted")
    counts.append(going.groupBy("user_id").agg(F.count(F.lit(1)).alias("promoted")))
    marks = going.select("memory_id", F.lit(True).alias("__up"))
    out = out.join(marks, "memory_id", "left").withColumn("promoted", F.coalesce("__up", "promoted")).drop("__up")
    stats = reduce(lambda a, b: a.join(b, "user_id", "left"), counts, size.select("user_id", "skipped"))
    stats = stats.select("user_id", *[(F.coalesce(c, zero) if c in stats.columns else zero).alias(c) for c in ("decayed", "deleted", "merged", "promoted")], "skipped")
    return out, going.select("user_id", "memory_id", "file", "section", "line"), stats
