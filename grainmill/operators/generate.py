"""Operators that call a language model: a callable of messages and options, applied to batches with a cache of answers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.text import text

Chat = Callable[[list[dict]], str]


def cache_key(provider: str, model: str, messages: Column, temperature: float) -> Column:
    """SHA-256 over all that an answer depends on."""
    return F.sha2(F.to_json(F.struct(F.lit(provider).alias("provider"), F.lit(model).alias("model"), messages.alias("messages"), F.lit(temperature).alias("temperature"))), 256)


def run_batch(requests: DataFrame, chat: Chat, *, cache: DataFrame | None = None, lanes: int = 4, retries: int = 1) -> DataFrame:
    """key, answer and error of each distinct request (key, messages: JSON text); only requests that the cache lacks are sent.

    A request is retried within its task, so a failed item doesn't repeat a whole partition. Failures aren't cached.
    """
    once = requests.select("key", "messages").dropDuplicates(["key"])
    missing = once if cache is None else once.join(cache.select("key"), "key", "left_anti")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, messages in zip(batch["key"], batch["messages"], strict=True):
                answer = error = None
                for _ in range(1 + retries):
                    try:
                        answer, error = chat(json.loads(messages)), None
                        break
                    except Exception as failure:  # noqa: BLE001  what a model server raises becomes the row's error
                        error = f"{type(failure).__name__}: {failure}"
                rows.append((key, answer, error))
            yield pd.DataFrame(rows, columns=["key", "answer", "error"])

    fresh = missing.repartition(lanes, "key").mapInPandas(ask, "key string, answer string, error string")
    if cache is None:
        return fresh
    return fresh.unionByName(cache.join(once.select("key"), "key", "left_semi").select("key", "answer", F.lit(None).cast("string").alias("error")))


def status(results: DataFrame) -> dict:
    """Completed or failed (if all did), and up to three distinct errors."""
    row = results.agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("failed")).first()
    errors = [r.error for r in results.filter("error is not null").select("error").distinct().orderBy("error").limit(3).collect()]
    return {"status": "failed" if row.n and row.failed == row.n else "completed", "total": row.n, "failed": row.failed, "errors": errors}


def strict_json(answer: str | None, attempts: int = 20):
    """The JSON value of an answer: of a fenced block, of all of it, or of the first balanced part; None without one."""
    body = answer or ""
    tries = [*re.findall(r"```(?:json)?\s*(.*?)```", body, re.S), body]
    decoder = json.JSONDecoder()
    for part in tries:
        try:
            return json.loads(part)
        except ValueError:
            continue
    for m in list(re.finditer(r"[{\[]", body))[:attempts]:
        try:
            return decoder.raw_decode(body[m.start() :])[0]
        except ValueError:
            continue
    return None


def transcript(messages: Column) -> Column:
    """A conversation as plain text for a prompt."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.upper(text(m["role"])), F.lit(": "), text(m["content"]))), "\n\n")


def judge_requests(df: DataFrame, provider: str = "local", model: str = "judge") -> DataFrame:
    """id, key and messages that ask for a verdict on each record's messages with what follows them."""
    said = transcript(F.concat(F.col("messages"), F.coalesce("chosen", "completion", F.array().cast(df.schema["messages"].dataType))))
    ask = F.lit('Rate the reply. Answer with JSON only: {"helpfulness": 1-10, "correctness": 1-10, "clarity": 1-10, "verdict": "pass" or "fail"}.\n\n')
    messages = F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.concat(ask, said).alias("content"))))
    return df.select("id", messages.alias("messages")).withColumn("key", cache_key(provider, model, F.col("messages"), 0.0))


def judged(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """id, helpfulness, correctness, clarity (1 to 10), verdict and score (0 to 100)."""

    @F.pandas_udf("struct<helpfulness:double,correctness:double,clarity:double,verdict:string>")
    def parsed(column: pd.Series) -> pd.DataFrame:
        rows = []
        for answer in column:
            value = strict_json(answer)
            marks = [value.get(k) if isinstance(value, dict) else None for k in ("helpfulness", "correctness", "clarity")]
            good = all(isinstance(m, (int, float)) and not isinstance(m, bool) for m in marks)
            rows.append((*(min(10.0, max(1.0, float(m))) if good else None for m in marks), ("pass" if value.get("verdict") == "pass" else "fail") if good else None))
        return pd.DataFrame(rows, columns=["helpfulness", "correctness", "clarity", "verdict"])

    out = requests.select("id", "key").join(answers.select("key", parsed("answer").alias("p")), "key").select("id", "p.*")
    mean = (F.col("helpfulness") + F.col("correctness") + F.col("clarity")) / 3
    return out.withColumn("score", F.when(mean.isNotNull(), F.least(F.lit(100), F.floor(mean * 10 + 0.5))).cast("int"))


def prompt_portion(messages: Column) -> Column:
    """Messages up to the last user turn."""
    last = F.size(messages) - F.array_position(F.reverse(F.transform(messages, lambda m: m["role"])), "user").cast("int") + 1
    return F.when(F.array_contains(F.transform(messages, lambda m: m["role"]), "user"), F.slice(messages, F.lit(1), last))


def ranked_pair(ranking: Column, candidates: Column) -> tuple[Column, Column]:
    """(best, worst) of candidates by a ranking (1-based places, best first); null unless it is a permutation and the two differ."""
    n = F.size(candidates)
    whole = (F.size(ranking) == n) & (F.array_sort(ranking) == F.sequence(F.lit(1), n))
    best, worst = F.try_element_at(candidates, F.get(ranking, F.lit(0))), F.try_element_at(candidates, F.get(ranking, n - 1))
    ok = whole & (best != worst)
    return F.when(ok, best), F.when(ok, worst)


def merged(messages: Column, returned: Column, only_last: bool = False) -> Column:
    """Assistant turns replaced by the returned ones; null unless counts and roles agree."""
    roles = lambda x: F.transform(x, lambda m: m["role"])
    last = F.size(messages) - F.array_position(F.reverse(roles(messages)), "assistant").cast("int")
    swap = F.transform(messages, lambda m, i: F.when((m["role"] == "assistant") & ((i == last) if only_last else F.lit(True)), F.get(returned, i)).otherwise(m))
    return F.when(roles(messages) == roles(returned), swap)
