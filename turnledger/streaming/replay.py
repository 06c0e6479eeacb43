"""Replay turn by turn: what depends on earlier turns, as a fold over each scope.

The decision for each memory is in ``step``: semantic duplicates first, then
the key. ``Session`` goes through whole turns: storing, retrieval with its
accesses, and consolidation where it is due, with a row of statistics a turn.
The batch forms fold each scope's turns in order; the streaming form keeps the
store in RocksDB between micro-batches and goes through the same ``step``.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.consolidate import Vectors, is_active, merge_rows, text_of
from ..operators.vectors import hashing_embedder
from ..settings import DEFAULT, PROMOTION_TARGET, TYPE_PRIORITY, Settings

MEMORY = (
    "user_id long, type string, key string, memory_id string, value string, confidence double, mention_count int, recency_ts double, superseded_by string, "
    "supersedes string, turn_number int, access_count int, last_accessed_turn int, promoted boolean, decay_applied double"
)
COLUMNS = [c.split()[0] for c in MEMORY.split(", ")]
STATS = (
    "user_id long, turn_number int, extracted_count int, stored_count int, vector_stored_count int, dedup_count int, superseded_count int, total_memories int, "
    "retrieved_count int, semantic_enabled boolean, active_memories string, consolidation string, storage_time_ms double, retrieval_time_ms double"
)


def boost(row: dict, settings: Settings) -> None:
    row["confidence"] = min(row["confidence"] + settings.boost, settings.max_confidence)
    row["mention_count"] += 1


def step(store: dict, keys: dict, new: dict, near: Callable[[dict], str | None], settings: Settings) -> str:
    """One arrival: a near duplicate is boosted, or superseded by an update; a taken key boosts its owner; else the row is stored.

    Returns what happened: duplicate, kept (a taken key), stored, superseding; an
    update of a near duplicate whose key is taken is "kept" as well.
    """
    twin = near(new)
    if twin and not new["is_update"]:
        boost(store[twin], settings)
        return "duplicate"
    place = (new["type"], new["key"])
    if new["key"] and place in keys:
        owner = store[keys[place]]
        owner["recency_ts"] = new["recency_ts"]
        boost(owner, settings)
        return "kept-duplicate" if twin else "kept"
    turn = int(new.get("turn_number") or round(new["recency_ts"] / 60.0))
    store[new["memory_id"]] = {
        **{k: v for k, v in new.items() if k not in ("is_update", "arrival")}, "mention_count": 1, "superseded_by": None, "supersedes": None, "turn_number": turn,
        "access_count": 0, "last_accessed_turn": turn, "promoted": False, "decay_applied": 0.0,
    }
    if new["key"]:
        keys[place] = new["memory_id"]
    if twin:
        store[twin]["superseded_by"] = new["memory_id"]
        store[new["memory_id"]]["supersedes"] = twin
        return "superseding"
    return "stored"


class Session:
    """The memory of one scope through its turns."""

    def __init__(self, settings: Settings = DEFAULT, embed: Callable[[list[str]], list[list[float]]] | None = None):
        self.settings, self.semantic = settings, settings.semantic and embed is not None
        self.store, self.keys, self.lines, self.last_run = {}, {}, {f: [] for f, _ in PROMOTION_TARGET.values()}, 0
        self.vectors = Vectors(embed) if self.semantic else None

    def near(self, new: dict) -> str | None:
        """The nearest stored row of the type that reaches the threshold."""
        if not (self.semantic and self.settings.semantic_dedup):
            return None
        found = self.vectors.near(text_of(new), self.settings.dedup_threshold, 1, lambda m: m in self.store and self.store[m]["type"] == new["type"])
        return found[0][0] if found else None

    def take(self, new: dict) -> str:
        """Stores one arrival, as ``step`` decides; stored rows join the vectors."""
        said = step(self.store, self.keys, new, self.near, self.settings)
        if self.semantic and said in ("stored", "superseding"):
            self.vectors.put(self.store[new["memory_id"]])
        return said

    def latest(self, limit: int, kind: str | None = None) -> list[dict]:
        rows = [r for r in self.store.values() if kind is None or r["type"] == kind]
        if kind is None:
            return sorted(rows, key=lambda r: (r["recency_ts"], r["memory_id"]), reverse=True)[:limit]
        return sorted(rows, key=lambda r: (-r["recency_ts"], r["memory_id"]))[:limit]

    def retrieve(self, message: str, turn: int) -> list[dict]:
        """The memories for a message, best first; each carries retrieval_score."""
        s = self.settings
        other = [t for t in s.priority_types if t not in s.always_on]
        found: dict[str, list] = {}  # name -> score, branch
        if self.semantic:
            for name, score in self.vectors.near(message, s.min_semantic, s.semantic_limit, self.store.__contains__):
                found.setdefault(name, [score, 1])
            for r in self.latest(s.recency_limit):
                found.setdefault(r["memory_id"], [s.recency_score, 2])
            for r in (r for t in s.always_on for r in self.latest(s.always_on_limit, t)):
                hit = found.setdefault(r["memory_id"], [s.always_on_floor, 3])
                hit[0] = max(hit[0], s.always_on_floor)
            for r in (r for t in other for r in self.latest(s.priority_limit, t)):
                found.setdefault(r["memory_id"], [s.priority_score, 4])
            scored = [(self.signals(self.store[m], score, turn), branch, m) for m, (score, branch) in found.items()]
        else:
            for r in (r for t in s.always_on for r in self.latest(s.always_on_limit, t)):
                found[r["memory_id"]] = [1.0, 1]
            for k, r in enumerate(self.latest(30)):
                if r["type"] not in s.always_on:
                    found.setdefault(r["memory_id"], [0.5 * 0.9**k, 2])
            for r in (r for t in other for r in self.latest(s.priority_limit, t)):
                found.setdefault(r["memory_id"], [0.7, 3])
            scored = [(score, branch, m) for m, (score, branch) in found.items()]
        scored = [x for x in sorted(scored, key=lambda x: (-x[0], x[1], x[2])) if is_active(self.store[x[2]])]
        most = min(s.top, s.token_budget // s.tokens_per_memory)
        return [{**self.store[m], "retrieval_score": score} for score, _, m in scored[:most]]

    def signals(self, row: dict, semantic: float, turn: int) -> float:
        s = self.settings
        kind = TYPE_PRIORITY.get(row["type"], 0.5)
        recency = math.exp(-s.recency_rate * max(0, turn - row["turn_number"]))
        if s.signals == 3:
            w = s.weights3
            return w["semantic"] * semantic + w["type"] * kind + w["recency"] * recency
        part = min(1.0, row["access_count"] / s.frequency_max)
        lately = math.exp(-s.frequency_rate * max(0, turn - row["last_accessed_turn"]))
        frequency = (1 - s.frequency_recent) * part + s.frequency_recent * lately * part
        w = s.weights5
        return w["semantic"] * semantic + w["type"] * kind + w["recency"] * recency + w["frequency"] * frequency + w["confidence"] * row["confidence"]

    def due(self, turn: int) -> bool:
        s = self.settings
        if not s.consolidation_enabled:
            return False
        return len(self.store) >= s.consolidation_least if self.last_run == 0 else turn - self.last_run >= s.consolidation_every

    def consolidate(self, turn: int, force: bool = False) -> dict:
        """Decay, merges and promotion in place; skipped, and not counted as a run, where there is too little."""
        s = self.settings
        stats = {"decayed": 0, "deleted": 0, "merged": 0, "promoted": 0, "skipped": False}
        if len(self.store) < s.consolidation_least and not force:
            return stats | {"skipped": True}
        if s.decay_enabled:
            for r in list(self.store.values()):
                age, idle = turn - r["turn_number"], turn - r["last_accessed_turn"]
                if r["promoted"] or age < s.decay_age:
                    continue
                loss = age / 100 * s.decay_rate + (max(0, idle - s.decay_idle) / 100 * s.decay_rate * 0.5)
                new = max(s.decay_floor, r["confidence"] - loss)
                if new < s.decay_delete:
                    del self.store[r["memory_id"]]
                    self.keys = {k: m for k, m in self.keys.items() if m != r["memory_id"]}
                    stats["deleted"] += 1
                    continue
                r["confidence"], r["decay_applied"] = new, r["decay_applied"] + loss
                stats["decayed"] += loss > 0.01
        if s.merge_enabled and self.semantic:
            stats["merged"] = merge_rows(self.store, self.vectors, turn, s, self.keys)
            for r in self.store.values():
                r.setdefault("decay_applied", 0.0)
                r.pop("merged_from", None)
        if s.promote_enabled:
            for r in sorted(self.store.values(), key=lambda r: (r["recency_ts"], r["memory_id"]), reverse=True):
                good = r["confidence"] >= s.promote_confidence and r["mention_count"] >= s.promote_mentions and r["access_count"] >= s.promote_accesses
                if good and not r["promoted"] and is_active(r) and turn - r["turn_number"] >= s.promote_age and r["type"] in PROMOTION_TARGET:
                    self.lines[PROMOTION_TARGET[r["type"]][0]].insert(0, f"- **{r['key']}:** {r['value']}")
                    r["promoted"] = True
                    stats["promoted"] += 1
        self.last_run = turn
        return stats

    def turn(self, number: int, message: str, arrivals: list[dict]) -> dict:
        """One turn: its memories are stored in order, memories for it retrieved and counted, and a due consolidation run."""
        begin = time.perf_counter()
        said = [self.take(new) for new in arrivals]
        after = time.perf_counter()
        stored = sum(x in ("stored", "superseding") for x in said)
        total = len(self.store)
        found = self.retrieve(message, number)
        for r in found:
            row = self.store[r["memory_id"]]
            row["access_count"] += self.settings.turn_accesses if self.semantic else 1
            row["last_accessed_turn"] = number
        shown = [{
            "memory_id": r["memory_id"], "content": f"{r['key']}: {r['value']}", "type": r["type"], "origin_turn": r["turn_number"], "last_used_turn": number,
            "confidence": round(r["confidence"], 6), "mention_count": r["mention_count"], "access_count": r["access_count"] + 1,
        } for r in found]
        done = time.perf_counter()
        ran = self.consolidate(number) if self.due(number) else None
        return {
            "turn_number": number, "extracted_count": len(arrivals), "stored_count": stored, "vector_stored_count": stored if self.semantic else 0,
            "dedup_count": sum(x in ("duplicate", "kept-duplicate", "superseding") for x in said), "superseded_count": said.count("superseding"), "total_memories": total,
            "retrieved_count": len(found), "semantic_enabled": self.semantic, "active_memories": json.dumps(shown), "consolidation": None if ran is None else json.dumps(ran),
            "storage_time_ms": 1000 * (after - begin), "retrieval_time_ms": 1000 * (done - after),
        }


def rows_of(user: int, store: dict) -> pd.DataFrame:
    return pd.DataFrame([{**r, "user_id": user} for r in store.values()], columns=COLUMNS)


def arrivals_of(arrivals: DataFrame) -> DataFrame:
    """What a step reads of an arrival; is_update where it is given, else the update intent of its message."""
    update = next((F.coalesce(F.col(c), F.lit(False)) for c in ("is_update", "update_intent") if c in arrivals.columns), F.lit(False))
    return arrivals.select(
        "user_id", "type", "key", "memory_id", "value", "confidence", (F.col("turn_number") * 60.0).alias("recency_ts"), F.col("turn_number").cast("int").alias("turn_number"), "arrival", update.alias("is_update"),
    )


def replayed(arrivals: DataFrame, make_embedder: Callable | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """The store of each scope after its arrivals one by one; without an embedder no row is a semantic duplicate."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        session = Session(settings, make_embedder() if make_embedder else None)
        for row in pdf.sort_values("arrival").drop(columns=["arrival"]).to_dict("records"):
            session.take(row)
        return rows_of(int(pdf["user_id"].iloc[0]), session.store)

    return arrivals_of(arrivals).groupBy("user_id").applyInPandas(fold, MEMORY)


def _sessions(turns: DataFrame, arrivals: DataFrame, fold: Callable, schema: str) -> DataFrame:
    rows = arrivals_of(arrivals)
    own = rows.groupBy("user_id", "turn_number").agg(F.array_sort(F.collect_list(F.struct("arrival", *[c for c in rows.columns if c not in ("arrival", "user_id")]))).alias("items"))
    return turns.select("user_id", "turn_number", "text").join(own, ["user_id", "turn_number"], "left").groupBy("user_id").applyInPandas(fold, schema)


def _through(pdf: pd.DataFrame, settings: Settings, make_embedder: Callable | None) -> Iterator[tuple[Session, dict]]:
    session = Session(settings, make_embedder() if make_embedder else None)
    for row in pdf.sort_values("turn_number").itertuples(index=False):
        items = [] if row.items is None else [{k: v for k, v in dict(x).items() if k != "arrival"} for x in row.items]
        yield session, session.turn(int(row.turn_number), row.text or "", items)


def turn_stats(turns: DataFrame, arrivals: DataFrame, make_embedder: Callable | None = hashing_embedder, settings: Settings = DEFAULT) -> DataFrame:
    """A row of statistics for each turn (user_id, turn_number, text) that went through the whole of ``Session.turn``."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        user = int(pdf["user_id"].iloc[0])
        return pd.DataFrame([{**stats, "user_id": user} for _, stats in _through(pdf, settings, make_embedder)], columns=[c.split()[0] for c in STATS.split(", ")])

    return _sessions(turns, arrivals, fold, STATS)


def processed(turns: DataFrame, arrivals: DataFrame, make_embedder: Callable | None = hashing_embedder, settings: Settings = DEFAULT) -> DataFrame:
    """The store of each scope after all its turns, with accesses, merges, decay and promotions."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        session = None
        for session, _ in _through(pdf, settings, make_embedder):
            pass
        return rows_of(int(pdf["user_id"].iloc[0]), session.store)

    return _sessions(turns, arrivals, fold, MEMORY)


STATE = ", ".join(c for c in MEMORY.split(", ") if not c.startswith(("user_id", "memory_id"))) + ", place long, vector array<double>"
FIELDS = [c.split()[0] for c in STATE.split(", ")]


def store_of(make_embedder: Callable | None, settings: Settings) -> StatefulProcessor:
    """The state of a scope: its memories with their vectors; a micro-batch goes through ``step`` and emits the rows that it changed."""

    class Store(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.rows = handle.getMapState("rows", "memory_id string", STATE)
            self.embed = make_embedder() if make_embedder else None

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            (user,) = key
            session = Session(settings, self.embed)
            held = sorted(((name, dict(zip(FIELDS, values))) for (name,), values in self.rows.iterator()), key=lambda x: x[1]["place"])
            for name, row in held:
                session.store[name] = {k: v for k, v in row.items() if k not in ("place", "vector")} | {"memory_id": name}
                if row["key"]:
                    session.keys.setdefault((row["type"], row["key"]), name)
                if session.semantic:
                    session.vectors.put(session.store[name], row["vector"])
            before = {name: dict(r) for name, r in session.store.items()}
            for r in pd.concat(list(rows)).sort_values("arrival").drop(columns=["arrival"]).to_dict("records"):
                session.take(r)
            changed = {name: r for name, r in session.store.items() if before.get(name) != r}
            order = {name: k for k, name in enumerate(session.store)}
            for name, r in changed.items():
                vector = session.vectors.matrix[session.vectors.place[name]].tolist() if session.semantic else None
                self.rows.updateValue((name,), tuple({**r, "place": order[name], "vector": vector}[f] for f in FIELDS))
            yield rows_of(user, changed)

        def close(self) -> None:
            pass

    return Store()


def stream(arrivals: DataFrame, make_embedder: Callable | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """The streaming form of ``replayed`` over a streaming ``arrivals``; needs the RocksDB state store."""
    return arrivals_of(arrivals).groupBy("user_id").transformWithStateInPandas(store_of(make_embedder, settings), MEMORY, "Update", "None")
