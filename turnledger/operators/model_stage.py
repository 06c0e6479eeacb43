"""The model stage: prompts, a pluggable provider, and validation of its answers."""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import DEFAULT, Settings
from .extract import context, escalation, merged_stages, stored_candidates

ASK = (
    "Read the message of a user and list what is worth remembering about them as a JSON array of objects with "
    "type (preference, constraint, entity, instruction, commitment, fact or event), key, value, confidence (0 to 1), "
    "is_update and reasoning. Answer [] if there is nothing.\n\nContext:\n"
)
AGAIN = "Your last answer could not be read as JSON. Answer the message with a valid JSON array alone."
LIMITED = ("429", "rate_limit", "too many requests")


def prompts(rows: DataFrame) -> DataFrame:
    """Adds the prompt to rows with context, text and hint (the first type that patterns found, or null)."""
    hint = F.when(F.col("hint").isNotNull(), F.concat(F.lit("\n\nHINT: "), F.col("hint"))).otherwise(F.lit(""))
    return rows.withColumn("prompt", F.concat(F.lit(ASK), F.col("context"), F.lit("\n\nMessage:\n"), F.col("text"), hint))


def wrong(answer: str) -> str | None:
    """Why an answer cannot be read as JSON, or None; fences around it go first. An answer that is no array is read, and gives nothing."""
    body = re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", answer.strip()))
    try:
        json.loads(body)
    except ValueError as error:
        return str(error)
    return None


def again(message: str, answer: str, error: str) -> str:
    """The prompt after an answer that could not be read: the error, the start of the answer, and the message once more."""
    return f"{AGAIN}\n\nError: {error}\n\nYour answer began:\n{answer[:300]}\n\nMessage:\n{message}"


def answered(rows: DataFrame, make: Callable[[], Callable[[str, int], str]] | None, keys: int = 1, corrections: int = 1) -> DataFrame:
    """Adds the provider's answer to rows (user_id, turn_number, prompt, and text where there is one).

    ``make`` builds the provider once a task; it is called with the prompt and
    the number of the key to use. Where a limit is hit the next key is tried,
    each once; other errors, and limits of all keys, leave a null answer. An
    answer that is no JSON goes back with its error, as often as
    ``corrections`` says; the last answer stays. Without a provider there are
    no answers.
    """
    if make is None:
        return rows.withColumn("answer", F.lit(None).cast("string"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, key = make(), 0

        def ask(prompt: str) -> str | None:
            nonlocal key
            for _ in range(max(1, keys)):
                try:
                    return call(prompt, key)
                except Exception as error:  # noqa: BLE001
                    if not any(x in str(error).lower() for x in LIMITED):
                        return None
                    key = (key + 1) % max(1, keys)
            return None

        for frame in frames:
            out = []
            for prompt, text in zip(frame["prompt"], frame["text"]):
                answer = ask(prompt)
                for _ in range(corrections):
                    if answer is None or (error := wrong(answer)) is None:
                        break
                    answer = ask(again(text or "", answer, error))
                out.append(answer)
            yield frame.drop(columns=["text"]).assign(answer=out)

    own = rows if "text" in rows.columns else rows.withColumn("text", F.lit(""))
    return own.select("user_id", "turn_number", "prompt", "text").mapInPandas(run, "user_id long, turn_number int, prompt string, answer string")


#: Where the hosted models are asked, and the form of their requests and answers.
HOSTS = {
    "openai": "https://api.openai.com/v1/chat/completions", "groq": "https://api.groq.com/openai/v1/chat/completions", "anthropic": "https://api.anthropic.com/v1/messages",
}


def provider(name: str, model: str, keys: tuple[str, ...], max_tokens: int = 500, temperature: float = 0.1, url: str | None = None, seconds: float = 60.0) -> Callable[[], Callable[[str, int], str]]:
    """A maker of calls to a hosted model by its name (openai, anthropic or groq), for ``answered``; an unknown name is an error.

    One user message a call. The status and body of a failed request are in its
    error, so limits are known by it. ``url`` takes the place of the host.
    """
    if name not in HOSTS:
        raise ValueError(f"unknown model provider {name!r}")
    if not keys:
        raise ValueError(f"the provider {name} needs a key")

    def make() -> Callable[[str, int], str]:
        def call(prompt: str, key: int) -> str:
            body = {"model": model, "messages": [{"role": "user", "content": prompt}], "max_tokens": max_tokens, "temperature": temperature}
            own = {"x-api-key": keys[key], "anthropic-version": "2023-06-01"} if name == "anthropic" else {"Authorization": f"Bearer {keys[key]}"}
            asked = urllib.request.Request(url or HOSTS[name], json.dumps(body).encode(), {"Content-Type": "application/json", **own})
            try:
                with urllib.request.urlopen(asked, timeout=seconds) as reply:
                    said = json.loads(reply.read())
            except urllib.error.HTTPError as error:
                raise RuntimeError(f"{error.code} {error.read().decode(errors='replace')[:300]}") from error
            return said["content"][0]["text"] if name == "anthropic" else said["choices"][0]["message"]["content"]

        return call

    return make


def extracted_by_model(turns: DataFrame, make: Callable | None, keys: int = 1, settings: Settings = DEFAULT) -> DataFrame:
    """The third stage: turns that need the model, asked, read and filtered by confidence; user_id, turn_number, memory_id, type, key, value, confidence, is_update."""
    need = escalation(turns, settings).where("needs_model").select("user_id", "turn_number", "hint")
    asked = prompts(context(turns).join(need, ["user_id", "turn_number"]))
    return parsed(answered(asked, make, keys).select("user_id", "turn_number", "answer")).where(F.col("confidence") >= settings.min_confidence)


def cascade(turns: DataFrame, make: Callable | None = None, keys: int = 1, settings: Settings = DEFAULT) -> DataFrame:
    """All three stages: what patterns find in turns that pass, and what the model adds or is surer of, one row a (turn, type, key).

    Without a provider, and where the model fails, the patterns' rows stand.
    """
    two = stored_candidates(turns, settings).select("user_id", "turn_number", "type", "key", "value", "confidence", "arrival", F.lit(2).alias("stage"), F.col("update_intent").alias("is_update"))
    three = extracted_by_model(turns, make, keys, settings)
    place = F.element_at(F.split("memory_id", "_"), -1).cast("long")
    three = three.select("user_id", "turn_number", "type", "key", "value", "confidence", (F.col("turn_number").cast("long") * 100_000 + 90_000 + place).alias("arrival"), F.lit(3).alias("stage"), "is_update")
    every = two.unionByName(three)
    best = merged_stages(every.drop("is_update"))
    marks = every.groupBy("user_id", "turn_number", "type", "key", "stage").agg(F.max("is_update").alias("is_update"), F.min("arrival").alias("arrival"))
    rows = best.join(marks, ["user_id", "turn_number", "type", "key", "stage"])
    named = F.md5(F.concat_ws("|", F.col("user_id").cast("string"), F.col("arrival").cast("string"), F.col("stage").cast("string")))
    return rows.withColumn("memory_id", F.concat(F.lit("mem_"), F.left(named, F.lit(16))))


def parsed(rows: DataFrame, answer: str = "answer") -> DataFrame:
    """Items of the answers (user_id, turn_number, answer), one row each, with stage 3 ids by their order.

    Fences around the JSON go. An answer that is no array gives nothing; an
    item without one of type, key, value and confidence is left out; a
    confidence that is no number voids its whole answer.
    """
    body = F.regexp_replace(F.regexp_replace(F.trim(F.col(answer)), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    items = F.expr("try_cast(__v AS ARRAY<VARIANT>)")
    own = rows.withColumn("__v", F.try_parse_json(body)).withColumn("__items", items).where(F.col("__items").isNotNull())
    there = lambda x, k: F.try_variant_get(x, f"$.{k}", "variant").isNotNull()
    full = F.filter("__items", lambda x: there(x, "type") & there(x, "key") & there(x, "value") & there(x, "confidence"))
    own = own.withColumn("__full", full)
    sure: Callable[[Column], Column] = lambda x: F.try_variant_get(x, "$.confidence", "double")
    own = own.where(F.forall("__full", lambda x: sure(x).isNotNull()))
    rows_ = own.select(*[c for c in rows.columns if c != answer], F.posexplode("__full").alias("i", "x"))
    get = lambda k: F.try_variant_get(F.col("x"), f"$.{k}", "string")
    return rows_.select(
        *[c for c in rows.columns if c != answer], F.concat(F.lit("mem_"), F.col("turn_number").cast("string"), F.lit("_"), F.col("i").cast("string")).alias("memory_id"),
        get("type").alias("type"), get("key").alias("key"), get("value").alias("value"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure(F.col("x")))).alias("confidence"),
        F.coalesce(F.try_variant_get(F.col("x"), "$.is_update", "boolean"), F.lit(False)).alias("is_update"),
    )
