"""Driver loops over whole tables: each round reads the last round's table and writes its own, so a lost driver resumes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.functions.scalar import passes
from trajlake.operators.trajectories import RUN
from trajlake.runtime import written

#: Refinement rounds, and the first that keeps only tasks not yet solved.
ROUNDS, FAILURES_FROM = 5, 3


def next_tasks(proposals: DataFrame, judgments: DataFrame, failures_only: bool) -> DataFrame:
    """(identifier, instruction, steps, criteria) of complete proposals whose run was judged, and was no success if asked."""
    judged = judgments.where("success is not null")
    p = proposals.where("proposed_task is not null and steps is not null and criteria is not null and identifier is not null").join(judged.select(*RUN), RUN, "left_semi")
    if failures_only:
        p = p.join(judged.where(passes(F.col("success"), 1.0)).select(*RUN), RUN, "left_anti")
    return p.select("identifier", F.col("proposed_task").alias("instruction"), "steps", "criteria")


def refine(tasks: DataFrame, explore: Callable[[DataFrame, int], tuple[DataFrame, DataFrame]], rounds: int = ROUNDS, failures_from: int = FAILURES_FROM) -> DataFrame:
    """Task table after ``rounds`` of exploring, proposing and running again.

    ``explore`` takes the tasks and the round (from 1) and gives proposals and judgments, live or replayed. From round
    ``failures_from`` on, tasks already solved are dropped. Each round's table is written, which cuts the lineage.
    """
    for i in range(1, rounds + 1):
        proposals, judgments = explore(tasks, i)
        tasks = written(next_tasks(proposals, judgments, i >= failures_from))
    return tasks


def improve(tasks: DataFrame, rollouts: Callable[[DataFrame, int], DataFrame], build: Callable[[DataFrame, int], DataFrame], rounds: int) -> list[DataFrame]:
    """Data sets of ``rounds`` training iterations: each takes its shard of the tasks, makes rollouts, and builds its rows.

    A shard is a hash range of the task's identifier; training itself is left to the caller between rounds.
    """
    out = []
    for i in range(rounds):
        shard = tasks.where(F.pmod(F.xxhash64("identifier"), F.lit(rounds)) == i)
        out.append(written(build(rollouts(shard, i), i)))
    return out
