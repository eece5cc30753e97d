"""Calls to outside services inside Spark: models, browsers and tools behind one interface, with retries and a replay mode.

A provider is made once per partition and answers requests in batches; what it cannot answer is data, not a failed task.
A replay provider needs no service: recorded answers are joined on their key, so that a pipeline runs again as it ran.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from enum import Enum
from typing import Any, Protocol
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



class Status(Enum):
    """What a retried call returns when every try has failed; one object in every process."""

    ERROR = "error"


ERROR = Status.ERROR
#: The keys a browser's reply must have.
REPLY_KEYS = ("raw_html", "screenshot", "metadata", "current_url")
#: Most calls of one action that a browser takes.
MAX_CALLS = 3


class Provider(Protocol):
    """A service: one answer, or None, for each request of a batch."""

    def ask(self, requests: list[str]) -> list[str | None]: ...


def retried(call: Callable[..., Any], *args: Any, tries: int = 3, factor: float = 1.5, catch: type[Exception] = Exception, on_error: Callable[[Exception, int], Any] | None = None, sleep: Callable[[float], None] = time.sleep, **kwargs: Any) -> Any:
    """``call``'s result, tried again after ``factor`` ** 0, 1, … seconds; ``ERROR`` when all tries fail or ``on_error`` returns it."""
    for i in range(tries):
        try:
            return call(*args, **kwargs)
        except catch as e:
            if on_error is not None and on_error(e, i) is ERROR:
                return ERROR
        sleep(factor**i)
    return ERROR


def ask(df: DataFrame, key: str, request: str, make: Callable[[], Provider], tries: int = 3, factor: float = 1.5) -> DataFrame:
    """(key, response, failed): each request answered by a provider of its partition, one Arrow batch at a time.

    A null request is not sent; a batch that keeps failing has null responses and ``failed`` set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for b in batches:
            texts = b.column(1).to_pylist()
            sent = [i for i, t in enumerate(texts) if t is not None]
            got = retried(provider.ask, [texts[i] for i in sent], tries=tries, factor=factor) if sent else []
            out: list[str | None] = [None] * len(texts)
            if got is not ERROR:
                for i, t in zip(sent, got):
                    out[i] = t
            yield pa.record_batch({key: b.column(0), "response": pa.array(out, pa.string()), "failed": pa.array([got is ERROR and t is not None for t in texts])})

    return df.select(key, request).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, response string, failed boolean")


def replay(requests: DataFrame, recorded: DataFrame, on: list[str]) -> DataFrame:
    """``requests`` with the ``response`` that was recorded for them; ``failed`` where none was."""
    return requests.join(recorded.select(*on, "response"), on, "left").withColumn("failed", F.col("response").isNull())


def replayed_runs(tasks: DataFrame, observations: DataFrame, actions: DataFrame, judgments: DataFrame, max_actions: int = 30) -> DataFrame:
    """(task_id, run_id, n_steps, judged): trajectories generated again from recorded steps, without a browser or a model.

    A run goes on while the next step is recorded, until a stop, up to ``max_actions``: steps after a gap or a stop are not reached.
    """
    from pyspark.sql import Window

    run = ["task_id", "run_id"]
    o, a = observations.select(*run, "step_idx").distinct(), actions.groupBy(*run, "step_idx").agg(F.bool_or(F.coalesce(F.get("function_calls", F.lit(0))["dotpath"] == "stop", F.lit(False))).alias("stop"))
    steps = o.join(a, [*run, "step_idx"]).where(F.col("step_idx") < max_actions)
    w = Window.partitionBy(*run).orderBy("step_idx")
    rows = steps.withColumn("at", F.row_number().over(w) - 1).withColumn("ended", F.coalesce(F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    reached = rows.where((F.col("at") == F.col("step_idx")) & ~F.col("ended")).groupBy(*run).agg(F.count("*").alias("n_steps"))
    judged = judgments.select(*run).distinct().withColumn("judged", F.lit(True))
    return reached.join(tasks.select("task_id").distinct(), "task_id", "left_semi").join(judged, run, "left").withColumn("judged", F.coalesce("judged", F.lit(False)))


def valid_replies(replies: DataFrame) -> DataFrame:
    """Browser replies (JSON in column ``reply``) that have every key, as columns; the screenshot decoded to bytes."""
    v = F.try_parse_json("reply")
    keys = F.coalesce(F.json_object_keys("reply"), F.array().cast("array<string>"))
    good = replies.where(F.size(F.array_except(F.array(*map(F.lit, REPLY_KEYS)), keys)) == 0).withColumn("_v", v).where("_v is not null")
    get = lambda k, t="string": F.try_variant_get("_v", f"$.{k}", t)
    shot = F.try_to_binary(get("screenshot"), F.lit("base64"))
    return good.select("*", get("raw_html").alias("raw_html"), shot.alias("screenshot"), F.to_json(get("metadata", "variant")).alias("metadata"), get("current_url").alias("current_url")).drop("_v", "reply")


def tool_branch(session: Column, url: Column, action: Column) -> Column:
    """What a single tool call does: error, start (a new session at an address), goto, act, goto_act or observe."""
    has = lambda c: F.length(F.coalesce(c, F.lit(""))) > 0
    return (
        F.when(~has(session) & ~has(url), "error").when(~has(session) & has(action), "start_act").when(~has(session), "start")
        .when(has(url) & has(action), "goto_act").when(has(url), "goto").when(has(action), "act").otherwise("observe")
    )


def absolute_calls(df: DataFrame, key: str, current_url: str = "current_url", calls: str = "function_calls") -> DataFrame:
    """(key, function_calls): relative addresses of goto calls resolved against the page, and at most ``MAX_CALLS`` calls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for url, cs in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                got = []
                for c in (cs or [])[:MAX_CALLS]:
                    args = c["args"] or ""
                    if c["dotpath"] == "page.goto" and len(args) > 1 and args[0] == args[-1] and args[0] in "'\"":
                        args = f"'{urljoin(url or '', args[1:-1])}'"
                    got.append({"dotpath": c["dotpath"], "args": args})
                out.append(got)
            kind = pa.list_(pa.struct([("dotpath", pa.string()), ("args", pa.string())]))
            yield pa.record_batch({key: b.column(0), "function_calls": pa.array(out, kind)})

    return df.select(key, current_url, calls).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, function_calls array<struct<dotpath:string,args:string>>")


class Echo:
    """A provider for tests: answers by a function, failing at random as often as told."""

    def __init__(self, answer: Callable[[str], str | None], fails: float = 0.0, seed: int = 0) -> None:
        self.answer, self.fails, self.rng = answer, fails, random.Random(seed)

    def ask(self, requests: list[str]) -> list[str | None]:
        if self.rng.random() < self.fails:
            raise ConnectionError("no answer")
        return [self.answer(r) for r in requests]
