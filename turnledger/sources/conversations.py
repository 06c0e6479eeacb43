"""Made-up conversations with a ground truth, for evaluation: a batch, and a sweep over distances.

Choices hang on the numbers of conversation and turn, so every run, partition
and engine draws the same rows; the select runs in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONVERSATIONS = 200
TURNS = (10, 30)
#: Turns of a hundred that state a memory.
DENSITY = 60
DISTANCES = (10, 50, 100, 500, 1000)
#: The query of a sweep comes so many turns after the farthest memory's distance.
QUERY_LAG = 10
QUERY = "What do you still know about me?"

PERSONA = {
    "name": ("Robin", "Noor", "Kim", "Sasha", "Jules", "Mika"),
    "company": ("Northwind Tools", "Blue Harbour", "Larch Works", "Copper Line"),
    "location": ("Oslo", "Porto", "Kyoto", "Quito", "Tartu"),
    "language": ("Spanish", "Danish", "Korean", "Swahili"),
}
#: type (also the key), message, value; {x} stands for a choice of the persona or of OPTIONS.
OPTIONS = {
    "time": ("9 AM", "11 AM", "2 PM", "6 PM"),
    "food": ("walnuts", "shellfish", "gluten", "sesame"),
    "day": ("Monday", "Wednesday", "Friday"),
    "work": ("the quarterly report", "the contract", "the invoice list"),
}
STATED = (
    ("preference", "I prefer calls after {time}, and I like to speak {language}", "calls after {time}"),
    ("constraint", "Please remember that I can't eat {food} because of an allergy", "{food}"),
    ("entity", "My name is {name} and I work at {company} in {location}", "{name}"),
    ("commitment", "I'll finish {work} by {day}, my team needs it", "{work}"),
    ("instruction", "Remember to send my account letters to {location} every {day}", "send my account letters to {location}"),
)
FILLERS = ("Sounds fine.", "Could you say that again?", "It rained here all day.", "Let me think about it.", "Thanks, that helps.", "And what comes next?")



def _draw(salt: int, n: int, *, by_turn: bool = True) -> str:
    seed = f"conv_id * 7919 + {'turn * 6151 + ' if by_turn else ''}{salt * 104729}"
    return f"((CAST({seed} AS BIGINT) * 2654435) % 4294967291 % 65521 % {n})"


def _choice(salt: int, words, *, by_turn: bool = True) -> str:
    whens = " ".join(f"WHEN {k} THEN {_literal(w)}" for k, w in enumerate(words))
    return f"CASE {_draw(salt, len(words), by_turn=by_turn)} {whens} END"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _filled(template: str) -> str:
    out = _literal(template)
    for name in (*PERSONA, *OPTIONS):
        if "{" + name + "}" in template:
            out = f"replace({out}, '{{{name}}}', {name}_)"
    return out


def _select(slots: str) -> str:
    own = [f"{_choice(k, words, by_turn=False)} AS {name}_" for k, (name, words) in enumerate(PERSONA.items(), 1)]
    own += [f"{_choice(k, words)} AS {name}_" for k, (name, words) in enumerate(OPTIONS.items(), 11)]
    case = lambda at: " ".join(f"WHEN {k} THEN {_filled(row[at])}" for k, row in enumerate(STATED))
    return f"""SELECT conv_id, turn, has_memory, distance, is_query,
       CASE WHEN is_query THEN {_literal(QUERY)} WHEN NOT has_memory THEN filler ELSE CASE kind {case(1)} END END AS message,
       CASE WHEN has_memory THEN CASE kind {" ".join(f"WHEN {k} THEN '{row[0]}'" for k, row in enumerate(STATED))} END END AS type,
       CASE WHEN has_memory THEN CASE kind {case(2)} END END AS value,
       CASE WHEN has_memory THEN CAST(80 + {_draw(22, 20)} AS DOUBLE) / 100 END AS confidence
FROM (SELECT *, {_draw(21, len(STATED))} AS kind, {_choice(23, FILLERS)} AS filler, {", ".join(own)} FROM ({slots}))"""


def batch_sql(unnest: str, conversations: int = CONVERSATIONS, turns: tuple[int, int] = TURNS, density: int = DENSITY) -> str:
    """``unnest`` gives the rows of a range in an engine's own words, from {low} to {high}."""
    ids = f"SELECT {unnest.format(low=1, high=conversations)} AS conv_id"
    sized = f"SELECT conv_id, {turns[0]} + {_draw(31, turns[1] - turns[0] + 1, by_turn=False)} AS n FROM ({ids}) AS i"
    each = f"SELECT conv_id, {unnest.format(low=1, high='n')} AS turn FROM ({sized}) AS s"
    return _select(f"SELECT conv_id, turn, {_draw(32, 100)} < {density} AS has_memory, CAST(NULL AS BIGINT) AS distance, false AS is_query FROM ({each}) AS e")


def sweep_sql(unnest: str, distances: tuple[int, ...] = DISTANCES) -> str:
    query = max(distances) + QUERY_LAG
    far = f"{query} - turn"
    each = f"SELECT CAST(0 AS BIGINT) AS conv_id, {unnest.format(low=1, high=query)} AS turn"
    marked = f"{far} IN ({', '.join(map(str, distances))})"
    return _select(f"SELECT conv_id, turn, {marked} AS has_memory, CASE WHEN {marked} THEN {far} END AS distance, turn = {query} AS is_query FROM ({each}) AS e")


SPARK_RANGE = "explode(sequence(CAST({low} AS BIGINT), CAST({high} AS BIGINT)))"
DUCK_RANGE = "unnest(generate_series(CAST({low} AS BIGINT), CAST({high} AS BIGINT)))"


def batch(spark: SparkSession, **options) -> DataFrame:
    """conv_id, turn, message, has_memory, type, value, confidence, distance, is_query: a row a turn; the truth stands beside the message."""
    return spark.sql(batch_sql(SPARK_RANGE, **options))


def sweep(spark: SparkSession, **options) -> DataFrame:
    """One conversation whose memories lie at set distances before its last turn, the query."""
    return spark.sql(sweep_sql(SPARK_RANGE, **options))


def as_turns(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("conv_id").alias("user_id"), F.col("turn").cast("int").alias("turn_number"), F.col("message").alias("text"))


def truth(rows: DataFrame) -> DataFrame:
    """The stated memories as the evaluation takes them; the key is the type."""
    return rows.where("has_memory").select(
        F.col("conv_id").alias("user_id"), F.col("turn").alias("id"), "type", F.col("type").alias("key"), "value", F.col("turn").cast("int").alias("turn_number")
    )
