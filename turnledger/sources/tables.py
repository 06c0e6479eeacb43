"""Sources and sinks: Parquet tables, the turns view, and JSON exports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What users say, by the number of the event: at least one line for each family of patterns. {n} is a small number.
LINES = [
    "'I prefer item ' || {n} || ' for all calls after 11 AM, and Dana likes that'",
    "'My favorite fruit is plum ' || {n}", "'I usually walk ' || {n} || ' km before work with my friend Sam'", "'I hate item ' || {n} || ' and my colleague Ana does too'",
    "'I can''t eat item ' || {n} || ' because my doctor in Oslo said so'", "'I have to leave at ' || {n} || ' pm, is that ok by you?'",
    "'I''m allergic to nut ' || {n} || ', so remember to check my account'", "'Do not call region ' || {n} || ' before Monday'",
    "'My manager is called Dana' || {n}", "'My name is Alex' || {n} || ' and my manager is David'", "'I work for Acme ' || {n} || '. Thanks'",
    "'I live in Town ' || {n} || '.'", "'I''ll finish task ' || {n} || ' by Friday.'", "'I promise to ship order ' || {n} || ' from my family store'",
    "'I''m committed to goal ' || {n} || ' and my team is too'", "'Remember to check log ' || {n} || ' whenever my bill is due'",
    "'Don''t ever skip step ' || {n} || ', my friend'", "'Make sure to test build ' || {n} || ' before my call'", "'my account number ' || {n} || '4567 please'",
    "'the payment of $' || {n} || '50 arrived for my account'", "'you have $4' || {n} || ' still due now on my bill'", "'bill due on March 7th for account ' || {n}",
    "'pay before March 7th, plan ' || {n}", "'I already paid it ' || {n} || ' days ago from my account'", "'the payment ' || {n} || ' was received'",
    "'there is an outstanding balance on ' || {n}", "'a payment plan of ' || {n} || ' days'", "'please set up a payment plan for ' || {n}",
    "'now speaking with Jennifer about ' || {n}", "'hello, this is Jennifer, my plan is ' || {n}", "'ok'", "'  thanks  '", "'um'", "'Maybe I could try tea ' || {n}",
    "'Actually, I changed my mind - I prefer calls after ' || {n} || ' AM now.'", "'I might like option ' || {n} || ', but I always ask my friend first'",
    "'Correction: my name is Robin' || {n}", "'Is there anything else about invoice ' || {n} || '?'", "'I never miss a call, my friend ' || {n}", "'nothing to add today'",
]
_CASE = "CASE event_id % {m} {whens} END".format(m=len(LINES), whens=" ".join(f"WHEN {k} THEN {line.replace('{n}', 'CAST(event_id % 97 AS STRING)')}" for k, line in enumerate(LINES)))
#: The same text runs in Spark and in DuckDB.
TURNS_SQL = f"""SELECT user_id, event_id, event_type,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS turn_number, {_CASE} AS text
FROM events"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode alone a temporary one."""
    sc = spark.sparkContext
    if configured := sc.getConf().get("spark.checkpoint.dir"):
        return configured.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get().rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='turns-')}"
    sc.setCheckpointDir(made)
    return made


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reaches."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once for all that reads it, also after the loss of an executor."""
    path = f"{shared_dir(df.sparkSession)}/turns-{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_id, event_type, turn_number, text: one row a message."""
    return spark.sql(TURNS_SQL.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def from_conversations(df: DataFrame) -> DataFrame:
    """Messages of a table (conv_id, turn, role, text) as turns; the conversation is the user."""
    return df.selectExpr("conv_id AS user_id", "CAST(turn + 1 AS INT) AS turn_number", "role", "text")


def read(spark: SparkSession, path: str, form: str = "parquet", schema=None, **options) -> DataFrame:
    """Any file source of Spark by its name; a schema spares the inference pass."""
    reader = spark.read.format(form).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def export_json(df: DataFrame, path: str) -> None:
    """Turn statistics or fixtures as JSON lines, a file a partition."""
    df.write.mode("overwrite").json(path)


def environment(text: str) -> dict[str, str]:
    """Names and values of an environment file: a line each, comments and quotes aside; of a name that comes twice the last counts."""
    out = {}
    for line in text.splitlines():
        name, sign, value = line.strip().removeprefix("export ").partition("=")
        if sign and name.strip() and not name.lstrip().startswith("#"):
            value = value.strip()
            quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
            out[name.strip()] = value[1:-1] if quoted else value.split(" #")[0].rstrip()
    return out
