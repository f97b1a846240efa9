"""Model calls: one request per distinct prompt, answered on the executors.

A responder is either

* ``Callable[[list[str]], list[str | None]]``, called with prompts, or
* a Spark ``Column`` over the frame at hand, for offline work and tests.

Set ``spark.speculation=false`` when requests cost money: a speculative copy of
a task would send them twice.
"""

from __future__ import annotations

import json
import math
import time
from bisect import bisect_right
from collections.abc import Callable, Iterator
from hashlib import md5
from itertools import accumulate

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.functions.responses import is_answer, parsed
from corpusloom.operators.journal import Journal
from corpusloom.operators.lookup import HOT_ROWS, lookup
from corpusloom.operators.numbering import ROW_BITS
from corpusloom.operators.scratch import new_path, settle

Responder = Callable[[list[str]], list[str | None]] | Column

RESULT = "response string, attempts int, error string"
#: Commits of a run without a cache.
MAX_COMMITS = 100
#: Answers by the hash of a tag, so that flows that share a cache read their own only.
CACHE = "request_hash string, response string, attempts int, error string, tag_hash string"


def once(responder: Column) -> Column:
    """The responder, computed once per row.

    The second value is always null, but being non-deterministic it keeps the
    optimizer from copying the expression into filters and projections above it.
    """
    never = F.when(F.monotonically_increasing_id() < 0, F.lit(""))
    return F.coalesce(responder, never)


def _plain_json(reply: str) -> str:
    """The reply, written anew only where an object names something twice: the last value counts."""
    twice = []

    def pairs(items: list) -> dict:
        out = dict(items)
        if len(out) < len(items):
            twice.append(True)
        return out

    value = json.loads(reply, object_pairs_hook=pairs)
    return json.dumps(value, ensure_ascii=False) if twice else reply


def call_model(
    df: DataFrame,
    prompt: str,
    responder: Callable[[list[str]], list[str | None]],
    *,
    parse: str = "json",
    concurrency: int = 8,
    qps: float = 2.0,
    max_attempts: int = 3,
    backoff_s: float = 1.0,
    batch: int = 1,
    rows: int | None = None,
    journal: str | None = None,
) -> DataFrame:
    """Add response, attempts, error; one request per row, rows never get lost.

    Requests go out on a grid of ``qps`` a second that all tasks share: task i takes every
    ``concurrency``-th place from its own on, and a place that passed unused is left out
    (``qps <= 0``: no pacing).  Clocks of driver and executors have to agree.  Retries wait
    ``backoff_s`` instead.  With ``parse="json"`` a response that is no JSON counts as a
    failed attempt; names given twice in it keep their last value.  After ``max_attempts``
    the response is null and ``error`` says why.  With a ``journal`` folder a task that is run again
    goes on from the answers that its lost attempts have left there.
    """
    tasks = max(1, min(concurrency, rows)) if rows is not None else concurrency
    step = batch / qps if qps > 0 else 0.0
    want_json = parse == "json"
    prompt_col = prompt
    # all requests of earlier calls lie before now
    start = time.time() + step

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId()
        kept = Journal(journal, place)
        for frame in frames:
            prompts = frame[prompt_col].tolist()
            responses: list = [None] * len(prompts)
            attempts = [0] * len(prompts)
            errors: list = [None] * len(prompts)
            asked = []
            for i, p in enumerate(prompts):
                earlier = kept.get(p)
                if earlier is None:
                    asked.append(i)
                else:
                    responses[i], attempts[i] = earlier
            for first in range(0, len(asked), batch):
                if step:
                    passed = math.ceil((time.time() - start) / step - place)
                    place += max(0, -(-passed // tasks)) * tasks
                    time.sleep(max(0.0, start + place * step - time.time()))
                    place += tasks
                open_rows = asked[first : first + batch]
                for attempt in range(1, max_attempts + 1):
                    try:
                        replies = responder([prompts[i] for i in open_rows])
                        failure = None
                    except Exception as e:  # the service's own errors are data here
                        replies = [None] * len(open_rows)
                        failure = f"{type(e).__name__}: {e}"
                    still_open = []
                    for i, reply in zip(open_rows, replies, strict=True):
                        attempts[i] = attempt
                        reason = failure if reply is None else None
                        if reply is None and reason is None:
                            reason = "no response"
                        if reply is not None and want_json:
                            try:
                                reply = _plain_json(reply)
                            except ValueError as e:
                                reason = f"not JSON: {e}"
                        errors[i] = reason
                        if reason is None:
                            responses[i] = reply
                            kept.add(prompts[i], reply, attempt)
                        else:
                            still_open.append(i)
                    open_rows = still_open
                    if not open_rows:
                        break
                    if attempt < max_attempts and backoff_s:
                        time.sleep(backoff_s)
            yield frame.assign(response=responses, attempts=attempts, error=errors)
        kept.flush()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.repartition(tasks).mapInPandas(answer, f"{fields}, {RESULT}")


def _answered(spark: SparkSession, path: str, tag_hash: str) -> DataFrame | None:
    """Cached answers of one tag: a single folder of the cache."""
    try:
        return spark.read.schema(CACHE).parquet(path).where(F.col("tag_hash") == tag_hash)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _in_parts(df: DataFrame, label: str) -> DataFrame:
    """``df``, written in a folder per task with each row's place: _part, _row."""
    place = F.monotonically_increasing_id()
    row = place.bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return settle(df.withColumns({"_row": row, "_part": F.shiftright(place, ROW_BITS)}), label, by="_part")


def _commits(pending: DataFrame, every: int, most: int | None) -> Iterator[tuple[DataFrame, int]]:
    """Shares of ``every`` rows of a table in parts, each with its size; larger ones where they would be more than ``most``.

    A share is a stretch of rows along the parts, so only the folders that hold it are read, and no row is moved.
    """
    parts = sorted(pending.groupBy("_part").agg(F.count("*")).collect())  # one row per task
    left = sum(n for _, n in parts)
    every = max(every, -(-left // most)) if most else every
    ends = list(accumulate(n for _, n in parts))
    part, row = F.col("_part"), F.col("_row")
    for low in range(0, left, every):
        high = min(low + every, left)
        # the parts of the first and the last row, and the rows' places in them
        i, j = bisect_right(ends, low), bisect_right(ends, high - 1)
        first, last = parts[i][0], parts[j][0]
        begin, end = low - ends[i] + parts[i][1], high - ends[j] + parts[j][1]
        share = part.between(first, last) & ((part > first) | (row >= begin)) & ((part < last) | (row < end))
        yield pending.where(share), high - low


def semantic_map(
    df: DataFrame,
    prompt: str,
    responder: Responder,
    *,
    cache_path: str | None = None,
    tag: str = "",
    commit_every: int = 10_000,
    hot_rows: int = HOT_ROWS,
    **options: object,
) -> DataFrame:
    """Add response, attempts, error to every row of ``df`` and drop the prompt.

    Equal prompts are sent once.  ``cache_path`` keeps the answers for later runs
    (``tag`` should name model and temperature); failures are sent again next time.
    Answers are committed every ``commit_every`` requests, so a lost driver costs at
    most that many calls; without a cache, where nothing outlives the driver, in MAX_COMMITS larger
    commits at most.  A lost task costs the few that its journal does not hold yet.  ``df`` is computed once.  Pass a narrow frame (an id and the
    prompt): nothing can be pushed down below a Python call.
    """
    if isinstance(responder, Column):
        return df.withColumns(
            {"response": once(responder), "attempts": F.lit(1), "error": F.lit(None).cast("string")}
        ).drop(prompt)
    spark = df.sparkSession
    path = cache_path or new_path(spark, "answers")
    tag_hash = md5(tag.encode()).hexdigest()
    keyed = settle(
        df.withColumn("request_hash", F.sha2(F.concat(F.lit(tag + "\x1f"), F.col(prompt)), 256)), "asked"
    )
    # by the hash alone: prompts are carried, not compared
    counted = keyed.groupBy("request_hash").agg(F.count("*").alias("n"), F.first(prompt).alias("_prompt"))
    counted = counted.where(F.col("request_hash").isNotNull())
    known = _answered(spark, path, tag_hash)
    if known is None:
        pending = counted = _in_parts(counted, "requests")
    else:
        answered = known.where("response IS NOT NULL").select("request_hash", F.lit(True).alias("_known")).distinct()
        open_ = F.when(F.col("_known").isNull(), F.col("_prompt"))
        counted = settle(counted.join(answered, "request_hash", "left").select("request_hash", "n", open_.alias("_prompt")), "requests")
        pending = _in_parts(counted.where("_prompt IS NOT NULL"), "pending")
    requests = counted.select("request_hash", "n")
    for part, size in _commits(pending, commit_every, None if cache_path else MAX_COMMITS):
        asked = part.select("request_hash", "_prompt")
        answers = call_model(asked, "_prompt", responder, rows=size, journal=new_path(spark, "journal"), **options).drop("_prompt")
        answers.withColumn("tag_hash", F.lit(tag_hash)).write.mode("append").partitionBy("tag_hash").parquet(path)
    best = F.max(F.struct(F.col("response").isNotNull().alias("ok"), "response", "attempts", "error"))
    found = _answered(spark, path, tag_hash)
    if found is None:
        found = spark.createDataFrame([], CACHE)
    answers = (
        # of a cache that holds other runs' answers too, only those asked for are combined
        found.join(requests.select("request_hash"), "request_hash", "left_semi")
        .groupBy("request_hash")
        .agg(best.alias("a"))
        .select("request_hash", "a.response", "a.attempts", "a.error")
    )
    joined = lookup(keyed.drop(prompt), answers, ["request_hash"], requests, hot_rows)
    return joined.drop("request_hash")


def ask(
    df: DataFrame,
    prompt: Column,
    responder: Responder,
    keys: list[str],
    parse: str = "json",
    **options: object,
) -> DataFrame:
    """``df`` with a ``response`` column; ``keys`` identify its rows.

    A ``Column`` responder is evaluated in place.  A callable sees the prompts of
    the key columns only; its answers are joined back on the keys.
    """
    if isinstance(responder, Column):
        return df.withColumn("prompt", prompt).withColumn("response", once(responder)).drop("prompt")
    narrow = df.select(*keys, prompt.alias("prompt"))
    answers = semantic_map(narrow, "prompt", responder, parse=parse, **options)
    return df.join(answers.drop("attempts", "error"), keys, "left")


def call_stats(df: DataFrame, response: str = "response") -> DataFrame:
    """How many calls gave an answer, of how many."""
    return (
        df.select(is_answer(parsed(F.col(response))).alias("ok"))
        .agg(F.count_if("ok").alias("succeeded"), F.count("*").alias("total"))
    )
