"""The queries in SQL, for DuckDB: shared steps as common table expressions, and a final select for each query."""

from __future__ import annotations

from ..operators.model_stage import ASK
from ..settings import CORE_HEAD, DOCUMENT_TITLES, KEYWORDS, MODIFIERS, PATTERNS, PROMOTION_TARGET, RETRIEVED_HEAD, SPECIFIC, TYPE_PRIORITY, UPDATES
from ..sources.conversations import DUCK_RANGE, batch_sql, sweep_sql
from ..sources.tables import TURNS_SQL


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LOW = r"regexp_replace(lower(text), '^\s+|\s+$', '', 'g')"
_KEYS = " + ".join(f"CAST(contains(low, {_q(w)}) AS INT)" for ws in KEYWORDS.values() for w in ws)
_SPEC = " + ".join(f"CAST(regexp_matches(text, {_q(p)}) AS INT)" for p in SPECIFIC)


def score(source: str) -> str:
    return f"""SELECT *, CASE WHEN len(low) < 5 OR low IN ('hi', 'hello', 'hey', 'thanks', 'ok', 'okay', 'cool', 'nice') THEN 0.0::DOUBLE ELSE
    least(len(text) / 100.0::DOUBLE, 1.0::DOUBLE) * 0.3::DOUBLE + least(({_KEYS}) / 3.0::DOUBLE, 1.0::DOUBLE) * 0.4::DOUBLE
    + CAST(contains(text, '?') AS INT)::DOUBLE * 0.15::DOUBLE + least(({_SPEC}) / 3.0::DOUBLE, 1.0::DOUBLE) * 0.15::DOUBLE END AS score
    FROM (SELECT *, {_LOW} AS low FROM {source})"""


def _pattern(k: int, kind: str, key: str, base: float, lowered: bool, pattern: str) -> str:
    text = "lower(text)" if lowered else "text"
    strip = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
    groups = "(" in pattern.replace("(?:", "")
    if key.endswith("{1}"):
        name, value, g = f"{_q(key[:-3])} || {strip('a[m + 1]')}", strip("b[m + 1]"), 2
    else:
        name, value, g = _q(key), strip("a[m + 1]") if groups else "'true'", 1 if groups else 0
    second = f", regexp_extract_all({text}, {_q(pattern)}, 2) AS b" if g == 2 else ""
    return f"""SELECT user_id, turn_number, text, {_q(kind)} AS type, {name} AS key, {value} AS value, {base}::DOUBLE AS base, {k} AS pattern, m AS match
    FROM (SELECT *, unnest(range(len(a))) AS m FROM (SELECT user_id, turn_number, text, regexp_extract_all({text}, {_q(pattern)}, {min(g, 1)}) AS a{second} FROM t))"""


_MOVED = "base" + "".join(f" + (CASE WHEN contains(lower(text), {_q(w)}) THEN {d}::DOUBLE ELSE 0.0::DOUBLE END)" for w, d in MODIFIERS.items())
_UPDATE = " OR ".join(f"regexp_matches(lower(text), {_q(p)})" for p in UPDATES)
_PRIORITY = "CASE type " + " ".join(f"WHEN {_q(k)} THEN {v}::DOUBLE" for k, v in TYPE_PRIORITY.items()) + " ELSE 0.5::DOUBLE END"
_COS = "list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))"

STEPS = f"""WITH t AS ({TURNS_SQL}),
ts AS ({score('t')}),
x0 AS ({" UNION ALL ".join(_pattern(k + 1, *p) for k, p in enumerate(PATTERNS))}),
x AS (SELECT user_id, turn_number, text, type, key, value, base, greatest(0.0::DOUBLE, least(1.0::DOUBLE, {_MOVED})) AS confidence,
      turn_number::BIGINT * 100000 + pattern * 1000 + match AS arrival,
      'mem_' || left(md5(user_id || '|' || turn_number || '|' || pattern || '|' || match), 16) AS memory_id, ({_UPDATE}) AS update_intent FROM x0),
s AS (SELECT x.* FROM x JOIN ts USING (user_id, turn_number) WHERE ts.score >= 0.3 AND confidence >= 0.6),
m0 AS (SELECT user_id, type, key, arg_min(memory_id, arrival) AS memory_id, arg_min(value, arrival) AS value, arg_min(confidence, arrival) AS c0,
       arg_min(turn_number, arrival) AS turn_number, arg_min(update_intent, arrival) AS update_intent, count(*) AS n, arg_max(turn_number, arrival) * 60.0::DOUBLE AS recency_ts, min(arrival) AS arrival
       FROM s GROUP BY user_id, type, key, CASE WHEN key = '' THEN memory_id END),
m1 AS (SELECT *, CASE WHEN n = 1 THEN c0 ELSE least(c0 + 0.1::DOUBLE * (n - 1), 0.95::DOUBLE) END AS confidence, CAST(n AS INT) AS mention_count,
       lag(memory_id) OVER (PARTITION BY user_id, type ORDER BY arrival) AS old_id FROM m0),
l AS (SELECT old_id, memory_id AS new_id, arrival AS seen FROM m1 WHERE update_intent AND old_id IS NOT NULL),
now AS (SELECT user_id, max(turn_number) + 1 AS now FROM t GROUP BY user_id),
m AS (SELECT m1.*, now, (m1.turn_number * 7 + len(key)) % 23 AS access_count, m1.turn_number + ((m1.turn_number * 7 + len(key)) % 23) % 5 AS last_accessed_turn,
      (SELECT arg_max(new_id, seen) FROM l WHERE l.old_id = m1.memory_id) AS superseded_by, (SELECT arg_max(l.old_id, seen) FROM l WHERE l.new_id = m1.memory_id) AS supersedes
      FROM m1 JOIN now USING (user_id)),
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
h0 AS (SELECT m.user_id, memory_id, e1.v AS a, e2.v AS b FROM m JOIN e e1 ON e1.vec_id = (m.turn_number * 31 + len(value)) % (SELECT count(*) FROM e) JOIN e e2 ON e2.vec_id = m.user_id % (SELECT count(*) FROM e)),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, memory_id) AS rn FROM (SELECT user_id, memory_id, {_COS} AS score FROM h0) WHERE score >= 0.1) WHERE rn <= 100),
late AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY recency_ts DESC, memory_id DESC) AS rn FROM m),
bytype AS (SELECT *, row_number() OVER (PARTITION BY user_id, type ORDER BY recency_ts DESC, memory_id) AS rn FROM m),
br AS (SELECT user_id, memory_id, score AS s, 1 AS branch FROM h UNION ALL SELECT user_id, memory_id, 0.15::DOUBLE, 2 FROM late WHERE rn <= 50
       UNION ALL SELECT user_id, memory_id, 0.5::DOUBLE, 3 FROM bytype WHERE type IN ('constraint', 'instruction') AND rn <= 20
       UNION ALL SELECT user_id, memory_id, 0.3::DOUBLE, 4 FROM bytype WHERE type = 'entity' AND rn <= 10),
c AS (SELECT user_id, memory_id, CASE WHEN bool_or(branch = 3) THEN greatest(arg_min(s, branch), 0.5::DOUBLE) ELSE arg_min(s, branch) END AS semantic_score, min(branch) AS branch FROM br GROUP BY user_id, memory_id),
r0 AS (SELECT m.*, c.semantic_score, c.branch, {_PRIORITY} AS type_score, exp(-0.001::DOUBLE * greatest(0, now - turn_number)) AS recency_score,
       least(1.0::DOUBLE, access_count / 20.0::DOUBLE) AS na, exp(-0.05::DOUBLE * greatest(0, now - last_accessed_turn)) AS fa FROM m JOIN c USING (user_id, memory_id)),
r1 AS (SELECT *, 0.4::DOUBLE * na + 0.6::DOUBLE * fa * na AS frequency_score FROM r0),
r5 AS (SELECT *, 0.3::DOUBLE * semantic_score + 0.4::DOUBLE * type_score + 0.1::DOUBLE * recency_score + 0.05::DOUBLE * frequency_score + 0.15::DOUBLE * confidence AS retrieval_score FROM r1),
r3 AS (SELECT *, 0.5::DOUBLE * semantic_score + 0.25::DOUBLE * type_score + 0.25::DOUBLE * recency_score AS retrieval_score FROM r1),
top5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY retrieval_score DESC, branch, memory_id) AS rank FROM r5 WHERE coalesce(superseded_by, '') IN ('', 'None')) WHERE rank <= 50),
top3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY retrieval_score DESC, branch, memory_id) AS rank FROM r3 WHERE coalesce(superseded_by, '') IN ('', 'None')) WHERE rank <= 50),
d AS (SELECT *, CASE WHEN promoted OR now - turn_number < 20 THEN 0.0::DOUBLE ELSE (now - turn_number) / 100.0::DOUBLE * 0.05::DOUBLE
      + CASE WHEN now - last_accessed_turn > 10 THEN (now - last_accessed_turn - 10) / 100.0::DOUBLE * 0.05::DOUBLE * 0.5::DOUBLE ELSE 0.0::DOUBLE END END AS decay
      FROM (SELECT *, access_count % 7 = 0 AS promoted FROM m)),
dc AS (SELECT *, CASE WHEN decay > 0 THEN greatest(0.1::DOUBLE, confidence - decay) ELSE confidence END AS new_confidence FROM d),
p AS (SELECT *, CASE type {" ".join(f"WHEN {_q(k)} THEN {_q(v[0])}" for k, v in PROMOTION_TARGET.items())} END AS file,
      CASE type {" ".join(f"WHEN {_q(k)} THEN {_q(v[1])}" for k, v in PROMOTION_TARGET.items())} END AS section, '- **' || key || ':** ' || value AS line
      FROM d WHERE coalesce(superseded_by, '') IN ('', 'None') AND NOT promoted AND confidence >= 0.9 AND mention_count >= 2 AND access_count >= 5 AND now - turn_number >= 10
      AND type IN ('entity', 'preference', 'constraint', 'instruction')),
live AS (SELECT m.*, v FROM m JOIN e ON vec_id = (turn_number * 31 + len(value)) % (SELECT count(*) FROM e) WHERE coalesce(superseded_by, '') IN ('', 'None')),
mp AS (SELECT * FROM (SELECT a.user_id, a.type, a.memory_id AS a_id, b.memory_id AS b_id, a.now, a.value AS av, b.value AS bv, a.confidence AS ac, b.confidence AS bc, a.v AS a, b.v AS b,
       a.mention_count + b.mention_count AS mention_count, a.access_count + b.access_count AS access_count, a.key AS ak, b.key AS bk
       FROM live a JOIN live b ON a.user_id = b.user_id AND a.type = b.type AND a.arrival < b.arrival) WHERE {_COS} >= 0.3),
f AS (SELECT user_id, memory_id, type, key, value, rank, now FROM top5), tr AS (SELECT user_id, arrival AS id, type, key, value, turn_number FROM x),
mt AS (SELECT f.user_id, f.memory_id, f.rank, tr.id FROM f JOIN tr USING (user_id, type) WHERE contains(lower(f.key || ' ' || f.value), lower(tr.key || ' ' || tr.value)) OR contains(lower(tr.key || ' ' || tr.value), lower(f.key || ' ' || f.value))),
us AS (SELECT user_id, sum(f)::BIGINT AS n_found, sum(t)::BIGINT AS n_truth FROM (SELECT user_id, 1 AS f, 0 AS t FROM f UNION ALL SELECT user_id, 0, 1 FROM tr) GROUP BY user_id),
ep AS (SELECT user_id, n_found, coalesce(k, 0) AS n_matched, CASE WHEN n_found = 0 THEN 0.0::DOUBLE ELSE coalesce(k, 0) / n_found END AS precision FROM us LEFT JOIN (SELECT user_id, count(DISTINCT memory_id) AS k FROM mt GROUP BY user_id) USING (user_id)),
er AS (SELECT user_id, n_truth, coalesce(k, 0) AS n_matched, CASE WHEN n_truth = 0 THEN 1.0::DOUBLE ELSE coalesce(k, 0) / n_truth END AS recall FROM us LEFT JOIN (SELECT user_id, count(DISTINCT id) AS k FROM mt GROUP BY user_id) USING (user_id)),
fp AS (SELECT user_id, id, min(rank) AS place FROM mt GROUP BY ALL),
eq AS (SELECT us.user_id, coalesce(1.0::DOUBLE / min(place), 0.0::DOUBLE) AS mrr, coalesce(avg(place), 0.0::DOUBLE) AS avg_position,
       {", ".join(f"CASE WHEN any_value(n_found) > 0 AND any_value(n_truth) > 0 THEN count(*) FILTER (place <= {k}) / any_value(n_truth) END AS top_{k}" for k in (1, 3, 5, 10))}
       FROM us LEFT JOIN fp USING (user_id) GROUP BY us.user_id),
ed AS (SELECT tr.user_id, d AS distance, count(*) AS expected, count(hm.id) AS found, count(hm.id) / count(*) AS recall FROM tr JOIN now USING (user_id) JOIN (SELECT unnest([5, 10, 25, 50]) AS d) ON abs(turn_number - (now - d)) <= 2
       LEFT JOIN (SELECT DISTINCT user_id, id FROM mt) hm ON hm.user_id = tr.user_id AND hm.id = tr.id GROUP BY tr.user_id, d),
d1 AS (SELECT *, promoted_ AS promoted FROM (SELECT memory_id, new_confidence AS confidence, decay AS taken, now + 50 AS now, turn_number, last_accessed_turn, promoted AS promoted_ FROM dc WHERE new_confidence >= 0.05)),
d2 AS (SELECT *, CASE WHEN promoted OR now - turn_number < 20 THEN 0.0::DOUBLE ELSE (now - turn_number) / 100.0::DOUBLE * 0.05::DOUBLE
      + CASE WHEN now - last_accessed_turn > 10 THEN (now - last_accessed_turn - 10) / 100.0::DOUBLE * 0.05::DOUBLE * 0.5::DOUBLE ELSE 0.0::DOUBLE END END AS decay FROM d1),
doc AS (SELECT user_id, file, '## ' || section || chr(10) || string_agg(line, chr(10) ORDER BY arrival DESC) AS body FROM p GROUP BY user_id, file, section),
pt AS (SELECT memory_id, CAST(concat('0x', substr(md5(memory_id), 1, 16))::UBIGINT AS VARCHAR) AS point_id, concat_ws(' | ', nullif(key, ''), nullif(value, ''), 'type: ' || nullif(type, '')) AS text FROM m),
sk AS (SELECT ts.user_id, ts.turn_number, ts.text, hint, score >= 0.3 AND CASE WHEN coalesce(k, 0) = 0 THEN score > 0.5 ELSE best < 0.7 END AS needs_model FROM ts LEFT JOIN
       (SELECT x.user_id, x.turn_number, count(*) AS k, max(confidence) AS best, arg_min(type, arrival) AS hint FROM x JOIN ts USING (user_id, turn_number) WHERE score >= 0.3 GROUP BY ALL) USING (user_id, turn_number)),
cb AS (SELECT user_id, turn_number, coalesce(nullif(concat_ws(chr(10), lag(text, 2) OVER w, lag(text) OVER w), ''), 'No prior context') AS context FROM t WINDOW w AS (PARTITION BY user_id ORDER BY turn_number)),
bs AS (SELECT memory_id, 1.0::DOUBLE AS s, 1 AS branch FROM bytype WHERE type IN ('constraint', 'instruction') AND rn <= 20
        UNION ALL SELECT memory_id, 0.5::DOUBLE * pow(0.9::DOUBLE, rn - 1), 2 FROM late WHERE rn <= 30 AND type NOT IN ('constraint', 'instruction')),
pl AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY recency_ts DESC, memory_id DESC) AS rl, row_number() OVER (PARTITION BY user_id, type ORDER BY recency_ts DESC, memory_id) AS rt FROM m WHERE turn_number % 6 <> 0),
pb AS (SELECT user_id, memory_id, score AS s, 1 AS branch FROM h UNION ALL SELECT user_id, memory_id, 0.15::DOUBLE, 2 FROM pl WHERE rl <= 50
       UNION ALL SELECT user_id, memory_id, 0.5::DOUBLE, 3 FROM pl WHERE type IN ('constraint', 'instruction') AND rt <= 20 UNION ALL SELECT user_id, memory_id, 0.3::DOUBLE, 4 FROM pl WHERE type = 'entity' AND rt <= 10),
pc AS (SELECT user_id, memory_id, CASE WHEN bool_or(branch = 3) THEN greatest(arg_min(s, branch), 0.5::DOUBLE) ELSE arg_min(s, branch) END AS semantic_score, min(branch) AS branch FROM pb GROUP BY user_id, memory_id),
ev AS (SELECT vec_id AS id, v, label FROM e)
"""

_X = "user_id, turn_number, key, value, round(confidence, 6) AS confidence, memory_id"
_R = "user_id, rank, memory_id, type, round(retrieval_score, 6) AS retrieval_score"
FINAL = {
    "turns_view": "SELECT * FROM t",
    "sensory_score": "SELECT user_id, turn_number, round(score, 6) AS score, score >= 0.3 AS passed FROM ts",
    "sensory_filter_rate_by_role": "SELECT role, count(*) AS n, count(*) FILTER (score >= 0.3) AS n_passed, round(avg(score), 6) AS average FROM cs GROUP BY role",
    **{f"extract_{k}": f"SELECT {_X} FROM x WHERE type = '{v}'" for k, v in {"preference": "preference", "constraint": "constraint", "entity": "entity", "commitment": "commitment", "instruction": "instruction", "payment": "fact"}.items()},
    "extract_all_counts": "SELECT type, key, count(*) AS n, round(avg(confidence), 6) AS average FROM x GROUP BY type, key",
    "confidence_modifiers": "SELECT memory_id, base, round(confidence, 6) AS confidence FROM x WHERE confidence <> base",
    "min_confidence_filter": "SELECT user_id, memory_id, type, round(confidence, 6) AS confidence FROM s",
    "escalation_flags": """SELECT user_id, turn_number, round(score, 6) AS score, coalesce(k, 0) AS matches, round(best, 6) AS best, hint,
        score >= 0.3 AND CASE WHEN coalesce(k, 0) = 0 THEN score > 0.5 ELSE best < 0.7 END AS needs_model
        FROM ts LEFT JOIN (SELECT x.user_id, x.turn_number, count(*) AS k, max(confidence) AS best, arg_min(type, arrival) AS hint FROM x JOIN ts USING (user_id, turn_number) WHERE score >= 0.3 GROUP BY ALL) USING (user_id, turn_number)""",
    "context_buffer": r"""SELECT user_id, turn_number, coalesce(nullif(concat_ws(chr(10), lag(text, 2) OVER w, lag(text) OVER w), ''), 'No prior context') AS context
        FROM t WINDOW w AS (PARTITION BY user_id ORDER BY turn_number)""",
    "update_intent": f"SELECT user_id, turn_number, ({_UPDATE}) AS update_intent FROM t",
    "keydedup_upsert": "SELECT user_id, type, key, memory_id, value, round(confidence, 6) AS confidence, mention_count, turn_number, recency_ts FROM m1",
    "point_lookup": "SELECT user_id, memory_id, type, key, value FROM m WHERE memory_id IN (SELECT memory_id FROM x WHERE turn_number % 10 = 0)",
    "count_all": "SELECT count(*) AS n FROM m",
    "count_by_type": "SELECT type, count(*) AS n FROM m GROUP BY type",
    "recent_topk": "SELECT user_id, rn, memory_id FROM late WHERE rn <= 20",
    "by_type_limit": "SELECT user_id, type, memory_id FROM bytype WHERE type = 'preference' AND rn <= 5",
    "by_type_and_key": "SELECT user_id, memory_id, value FROM m WHERE type = 'entity' AND key = 'user_name'",
    "oldest_scan": "SELECT user_id, memory_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY recency_ts, memory_id) AS rn FROM m) WHERE rn <= 10",
    "delete_anti": "SELECT user_id, memory_id FROM m WHERE memory_id NOT IN (SELECT memory_id FROM m WHERE turn_number % 5 = 0)",
    "supersede_links": "SELECT memory_id, superseded_by, supersedes FROM m WHERE superseded_by IS NOT NULL OR supersedes IS NOT NULL",
    "superseded_filter": "SELECT user_id, memory_id FROM m WHERE coalesce(superseded_by, '') IN ('', 'None')",
    "boost_confidence": "SELECT memory_id, round(least(least(confidence + 0.1::DOUBLE, 0.95::DOUBLE) + 0.1::DOUBLE, 0.95::DOUBLE), 6) AS confidence, mention_count + 2 AS mention_count FROM m",
    "access_increment": "SELECT m.memory_id, access_count + coalesce(k, 0) AS access_count, coalesce(seen, last_accessed_turn) AS last_accessed_turn FROM m LEFT JOIN (SELECT memory_id, count(*) AS k, max(now) AS seen FROM top5 GROUP BY memory_id) USING (memory_id)",
    "update_field": "SELECT memory_id, CASE WHEN type = 'entity' THEN 'checked' ELSE value END AS value FROM m",
    "refresh_recency": "SELECT memory_id, CASE WHEN turn_number % 3 = 0 THEN now * 60.0::DOUBLE ELSE recency_ts END AS recency_ts FROM m",
    "hash_point_id": "SELECT memory_id, CAST(concat('0x', substr(md5(memory_id), 1, 16))::UBIGINT AS VARCHAR) AS point_id FROM m",
    "memory_embed_text": "SELECT memory_id, concat_ws(' | ', nullif(key, ''), nullif(value, ''), 'type: ' || nullif(type, '')) AS text FROM m",
    "cosine_similarity": f"SELECT id, other_id, round(greatest(0, least(1, {_COS})), 6) AS score FROM (SELECT x1.id, x2.id AS other_id, x1.v AS a, x2.v AS b FROM ev x1 JOIN ev x2 ON x1.label = x2.label AND x2.id = x1.id + 10)",
    "knn_filtered": f"SELECT query_id, id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, {_COS} AS score FROM (SELECT q.id AS query_id, x1.id, q.v AS a, x1.v AS b FROM ev q JOIN ev x1 USING (label) WHERE q.id % 100 = 0)) WHERE score >= 0.1) WHERE rank <= 10",
    "knn_all": f"SELECT query_id, id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, {_COS} AS score FROM (SELECT q.id AS query_id, x1.id, q.v AS a, x1.v AS b FROM ev q JOIN ev x1 ON true WHERE q.id % 100 = 0)) WHERE score >= 0.1) WHERE rank <= 10",
    "knn_types": f"SELECT query_id, id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, {_COS} AS score FROM (SELECT q.id AS query_id, x1.id, q.v AS a, x1.v AS b FROM ev q JOIN ev x1 ON true WHERE q.id % 100 = 0 AND x1.label IN (1, 3, 5))) WHERE score >= 0.1) WHERE rank <= 10",
    "knn_threshold_pairs": f"SELECT id, other_id, round(score, 6) AS score FROM (SELECT id, other_id, {_COS} AS score FROM (SELECT x1.id, x2.id AS other_id, x1.v AS a, x2.v AS b FROM ev x1 JOIN ev x2 ON x2.id < x1.id)) WHERE score >= 0.3",
    "clear_all": "SELECT user_id, memory_id FROM m WHERE false",
    "point_upsert": "SELECT memory_id, point_id, CASE WHEN len(text) % 4 = 0 THEN upper(text) ELSE text END AS text FROM pt",
    "point_delete": "SELECT memory_id, point_id FROM pt WHERE memory_id NOT IN (SELECT memory_id FROM m WHERE turn_number % 5 = 0)",
    "point_count": "SELECT count(*) AS n FROM pt",
    "decay_runs": "SELECT memory_id, round(CASE WHEN decay > 0 THEN greatest(0.1::DOUBLE, confidence - decay) ELSE confidence END, 6) AS confidence, round(taken + decay, 6) AS decay_applied FROM d2 WHERE CASE WHEN decay > 0 THEN greatest(0.1::DOUBLE, confidence - decay) ELSE confidence END >= 0.05",
    "core_memory_prompt": "SELECT user_id, string_agg('=== ' || file || ' ===' || chr(10) || body || chr(10), chr(10) ORDER BY list_position([" + ", ".join(_q(v[0]) for v in PROMOTION_TARGET.values()) + "], file)) AS core FROM doc GROUP BY user_id",
    "stage_merge": """, two AS (SELECT user_id, turn_number, type, key, arg_max(value, arrival) AS value, arg_max(confidence, arrival) AS confidence FROM s GROUP BY ALL),
        three AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, turn_number, type, key ORDER BY confidence DESC, arrival) AS rn FROM (SELECT user_id, turn_number, type, key, value, confidence + 0.01::DOUBLE AS confidence, arrival FROM s WHERE turn_number % 3 = 0)) WHERE rn = 1)
        SELECT user_id, turn_number, type, key, CASE WHEN w THEN v3 ELSE v2 END AS value, round(CASE WHEN w THEN c3 ELSE c2 END, 6) AS confidence, CASE WHEN w THEN 3 ELSE 2 END AS stage FROM
        (SELECT two.user_id, two.turn_number, two.type, two.key, two.value AS v2, two.confidence AS c2, three.value AS v3, three.confidence AS c3, coalesce(three.confidence, -1.0::DOUBLE) > two.confidence AS w
         FROM two LEFT JOIN three USING (user_id, turn_number, type, key))""",
    "llm_prompt": "SELECT user_id, turn_number, md5(prompt) AS prompt_md5, len(prompt) AS prompt_length FROM (SELECT sk.user_id, sk.turn_number, " + _q(ASK) + " || context || chr(10) || chr(10) || 'Message:' || chr(10) || text || coalesce(chr(10) || chr(10) || 'HINT: ' || hint, '') AS prompt FROM sk JOIN cb USING (user_id, turn_number) WHERE needs_model)",
    "llm_parse": "SELECT user_id, turn_number, 'mem_' || turn_number || '_' || (row_number() OVER (PARTITION BY user_id, turn_number ORDER BY arrival) - 1) AS memory_id, type, key, value, round(confidence, 6) AS confidence, false AS is_update FROM s WHERE turn_number % 4 <> 1",
    "retrieve_basic_priority_topk": """SELECT user_id, rank, memory_id, type, round(s, 6) AS retrieval_score FROM (SELECT m.user_id, m.memory_id, m.type, s, row_number() OVER (PARTITION BY m.user_id ORDER BY s DESC, branch, m.memory_id) AS rank
        FROM m JOIN (SELECT memory_id, max(s) AS s, min(branch) AS branch FROM (SELECT * FROM bs UNION ALL SELECT memory_id, 0.7::DOUBLE, 3 FROM bytype WHERE type = 'entity' AND rn <= 10 AND memory_id NOT IN (SELECT memory_id FROM bs)) GROUP BY memory_id) USING (memory_id)
        WHERE coalesce(superseded_by, '') IN ('', 'None')) WHERE rank <= 50""",
    "retrieve_payload_topk": f"""SELECT {_R} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY retrieval_score DESC, branch, memory_id) AS rank FROM
        (SELECT *, 0.3::DOUBLE * semantic_score + 0.4::DOUBLE * type_score + 0.1::DOUBLE * recency_score + 0.05::DOUBLE * frequency_score + 0.15::DOUBLE * confidence AS retrieval_score FROM
        (SELECT m.user_id, m.memory_id, m.type, semantic_score, branch, {_PRIORITY} AS type_score, exp(-0.001::DOUBLE * greatest(0, now - turn_number)) AS recency_score, confidence, CASE WHEN there THEN superseded_by END AS superseded_by,
         CASE WHEN there THEN 0.4::DOUBLE * least(1.0::DOUBLE, access_count / 20.0::DOUBLE) + 0.6::DOUBLE * exp(-0.05::DOUBLE * greatest(0, now - last_accessed_turn)) * least(1.0::DOUBLE, access_count / 20.0::DOUBLE) ELSE 0.0::DOUBLE END AS frequency_score
         FROM (SELECT *, turn_number % 6 <> 0 AS there FROM m) m JOIN pc USING (user_id, memory_id))) WHERE coalesce(superseded_by, '') IN ('', 'None')) WHERE rank <= 50""",
    "semantic_dedup_candidates": f"SELECT label, id, other_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other_id) AS rank FROM (SELECT label, id, other_id, {_COS} AS score FROM (SELECT x1.label, x1.id, x2.id AS other_id, x1.v AS a, x2.v AS b FROM ev x1 JOIN ev x2 ON x1.label = x2.label AND x2.id < x1.id)) WHERE score >= 0.25) WHERE rank <= 5",
    "hybrid_candidates": "SELECT user_id, memory_id, round(semantic_score, 6) AS semantic_score, branch FROM c",
    "rank_5_signal": "SELECT user_id, memory_id, round(type_score, 6) AS type_score, round(recency_score, 6) AS recency_score, round(frequency_score, 6) AS frequency_score, round(retrieval_score, 6) AS retrieval_score FROM r5",
    "rank_3_signal": "SELECT user_id, memory_id, round(retrieval_score, 6) AS retrieval_score FROM r3",
    "retrieve_hybrid_topk": f"SELECT {_R} FROM top5",
    "retrieve_3_signal_topk": f"SELECT {_R} FROM top3",
    "retrieve_basic_topk": """SELECT user_id, rank, memory_id, type, round(s, 6) AS retrieval_score FROM (SELECT m.user_id, m.memory_id, m.type, s, row_number() OVER (PARTITION BY m.user_id ORDER BY s DESC, branch, m.memory_id) AS rank
        FROM m JOIN (SELECT memory_id, max(s) AS s, min(branch) AS branch FROM (SELECT memory_id, 1.0::DOUBLE AS s, 1 AS branch FROM bytype WHERE type IN ('constraint', 'instruction') AND rn <= 20
        UNION ALL SELECT memory_id, 0.5::DOUBLE * pow(0.9::DOUBLE, rn - 1), 2 FROM late WHERE rn <= 30 AND type NOT IN ('constraint', 'instruction')) GROUP BY memory_id) USING (memory_id)
        WHERE coalesce(superseded_by, '') IN ('', 'None')) WHERE rank <= 50""",
    "format_prompt": r"""SELECT user_id, string_agg(body, chr(10) || chr(10) ORDER BY section) AS prompt FROM (SELECT user_id, section, '=== ' || upper(type) || ' ===' || chr(10) || string_agg(line, chr(10) ORDER BY rank) AS body
        FROM (SELECT *, list_position(['constraint', 'instruction', 'preference', 'entity', 'commitment', 'fact', 'event'], type) AS section,
        '- ' || key || ': ' || value || ' [turn ' || turn_number || ', ' || CAST(round_even(confidence * 100, 0) AS INT) || '% confident]' AS line FROM top5) GROUP BY user_id, section, type) GROUP BY user_id""",
    "active_memories": "SELECT user_id, rank, memory_id, key || ': ' || value AS content, type, turn_number AS origin_turn, now, round(confidence, 6) AS confidence, mention_count, access_count + 1 AS access_count FROM top5",
    "decay": "SELECT memory_id, round(decay, 6) AS decay, round(new_confidence, 6) AS new_confidence, new_confidence < 0.05 AS deleted FROM dc",
    "merge_pairs": "SELECT user_id, a_id, b_id FROM mp",
    "merged_record": """SELECT user_id, 'merged_' || left(md5(a_id || '_' || b_id || '_' || now), 8) AS memory_id, CASE WHEN bc > ac THEN bk ELSE ak END AS key,
        CASE WHEN av = bv THEN av WHEN contains(bv, av) THEN bv WHEN contains(av, bv) THEN av ELSE left(av || '; ' || bv, 500) END AS value,
        round(least(0.95::DOUBLE, (ac + bc) / 2 + 0.05::DOUBLE), 6) AS confidence, mention_count, access_count, a_id || ',' || b_id AS merged_from FROM mp""",
    "consolidation_due": """SELECT user_id, turn_number FROM (SELECT *, min(CASE WHEN stored >= 10 THEN turn_number END) OVER (PARTITION BY user_id) AS first FROM
        (SELECT t.user_id, t.turn_number, sum(coalesce(k, 0)) OVER (PARTITION BY t.user_id ORDER BY t.turn_number) AS stored FROM t LEFT JOIN (SELECT user_id, turn_number, count(*) AS k FROM m GROUP BY ALL) USING (user_id, turn_number)))
        WHERE turn_number >= first AND (turn_number - first) % 50 = 0""",
    "promotion": "SELECT user_id, memory_id, file, section, line FROM p",
    "core_memory_render": "SELECT user_id, file, '## ' || section || chr(10) || string_agg(line, chr(10) ORDER BY arrival DESC) AS body FROM p GROUP BY user_id, file, section",
    "statistics": """SELECT user_id, total, types, mentions, superseded, by_type, total AS vector_count FROM (SELECT user_id, count(*) AS total, count(DISTINCT type) AS types, CAST(sum(mention_count) AS BIGINT) AS mentions, count(*) FILTER (superseded_by IS NOT NULL) AS superseded FROM m GROUP BY user_id)
        JOIN (SELECT user_id, string_agg(type || '=' || n, ',' ORDER BY type || '=' || n) AS by_type FROM (SELECT user_id, type, count(*) AS n FROM m GROUP BY ALL) GROUP BY user_id) USING (user_id)""",
    "memories_by_type": "SELECT user_id, type, string_agg(memory_id, ',' ORDER BY memory_id) AS ids FROM m GROUP BY user_id, type",
    "turn_log_summary": "SELECT t.user_id, count(*) AS turns, CAST(sum(coalesce(k, 0)) AS BIGINT) AS extracted, round(avg(coalesce(k, 0)), 6) AS average FROM t LEFT JOIN (SELECT user_id, turn_number, count(*) AS k FROM s GROUP BY ALL) USING (user_id, turn_number) GROUP BY t.user_id",
    "eval_context_precision": "SELECT user_id, n_found, n_matched, round(precision, 6) AS precision FROM ep",
    "eval_context_recall": "SELECT user_id, n_truth, n_matched, round(recall, 6) AS recall FROM er",
    "eval_mrr_topk": "SELECT user_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("mrr", "avg_position", "top_1", "top_3", "top_5", "top_10")) + " FROM eq",
    "eval_distance_sweep": "SELECT user_id, distance, expected, found, round(recall, 6) AS recall FROM ed",
    "eval_decay": "SELECT count(*) FILTER (new_confidence IS NULL) AS deleted, count(*) FILTER (new_confidence < confidence) AS decayed, round(avg(confidence - new_confidence) FILTER (new_confidence < confidence), 6) AS average_loss FROM dc",
    "eval_merge": """, lp AS (SELECT * FROM mp),
after AS (SELECT user_id, type, key, 0 AS merged FROM live WHERE memory_id NOT IN (SELECT a_id FROM lp UNION SELECT b_id FROM lp)
          UNION ALL SELECT user_id, type, CASE WHEN bc > ac THEN bk ELSE ak END, 1 FROM lp),
af AS (SELECT user_id, count(*) AS n, CAST(sum(merged) AS BIGINT) AS merged, count(*) - count(DISTINCT (type, left(lower(key), 20))) AS duplicates FROM after GROUP BY user_id)
SELECT b.user_id, b.n AS total_before, coalesce(af.n, 0) AS total_after, coalesce(merged, 0) AS merged, coalesce(duplicates, 0) AS duplicates_remaining, b.n - coalesce(af.n, 0) AS reduction
FROM (SELECT user_id, count(*) AS n FROM live GROUP BY user_id) b LEFT JOIN af USING (user_id)""",
    "eval_duplicates": "SELECT user_id, CAST(count(*) - count(DISTINCT (type, left(lower(key), 20))) AS BIGINT) AS duplicates, count(*) AS n FROM s GROUP BY user_id",
    "eval_promotion": """SELECT x2.user_id, count(*) AS n_expected, CAST(sum(hit) AS BIGINT) AS n_promoted, round(avg(hit), 6) AS rate FROM
        (SELECT user_id, CAST(EXISTS (SELECT 1 FROM doc WHERE doc.user_id = m.user_id AND contains(lower(doc.body), lower(m.key))) AS INT) AS hit FROM m WHERE mention_count >= 2) x2 GROUP BY x2.user_id""",
    "eval_suite": """SELECT 'context_precision.precision' AS metric, round(avg(precision), 6) AS value FROM ep UNION ALL SELECT 'context_recall.recall', round(avg(recall), 6) FROM er UNION ALL SELECT 'ranking.mrr', round(avg(mrr), 6) FROM eq
        UNION ALL SELECT 'ranking.avg_position', round(avg(avg_position), 6) FROM eq UNION ALL SELECT 'distance.recall', round(avg(recall), 6) FROM ed""",
    "core_documents": "SELECT user_id, file, '# ' || title || chr(10) || chr(10) || '**Last Updated:** 2024-01-01' || chr(10) || chr(10) || '## ' || section || chr(10) || coalesce(string_agg(line || chr(10), '' ORDER BY arrival DESC), '') || chr(10) AS body FROM (SELECT DISTINCT user_id FROM m) JOIN (VALUES "
        + ", ".join(f"({_q(f)}, {_q(DOCUMENT_TITLES[f])}, {_q(sec)})" for f, sec in PROMOTION_TARGET.values()) + ") AS v(file, title, section) ON true LEFT JOIN (SELECT user_id, file, line, arrival FROM p) USING (user_id, file) GROUP BY user_id, file, title, section",
    "turn_latencies": "SELECT v.stage, count(*) AS turns, true AS in_order FROM t JOIN (VALUES ('storage'), ('retrieval')) AS v(stage) ON true GROUP BY v.stage",
    "replay_keyed": "SELECT user_id, type, key, memory_id, value, round(confidence, 6) AS confidence, mention_count FROM m1",
}
FINAL["prompt_context"] = f"""SELECT user_id, concat_ws(chr(10) || chr(10), {_q(CORE_HEAD)} || chr(10) || chr(10) || core, {_q(RETRIEVED_HEAD)} || chr(10) || chr(10) || prompt) AS context
        FROM ({FINAL["core_memory_prompt"]}) FULL JOIN ({FINAL["format_prompt"]}) USING (user_id)"""
STEPS += f", cs AS ({score('(SELECT role, text FROM conversations)')})\n"
ORACLE_SQL = {name: STEPS + final for name, final in FINAL.items()}
ORACLE_SQL |= {"generated_conversations": batch_sql(DUCK_RANGE), "generated_sweep": sweep_sql(DUCK_RANGE)}
