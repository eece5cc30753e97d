"""Joins, best-of-N, statistics and windows over trajectory tables (tasks, observations, actions, judgments, proposals)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajlake.functions.scalar import passes, seeded_order

RUN = ["task_id", "run_id"]
SCORES = ("success", "efficiency", "self_correction")


def step_rows(tasks: DataFrame, observations: DataFrame, actions: DataFrame, judgments: DataFrame) -> DataFrame:
    """Task, observation, action and judgment ids of every step that has all four; repeated rows multiply as in any inner join."""
    o = observations.select("obs_id", *RUN, "step_idx")
    a = actions.select("action_id", *RUN, "step_idx")
    return tasks.select("task_id").join(o, "task_id").join(a, [*RUN, "step_idx"]).join(judgments.select("judgment_id", *RUN), RUN)


def complete_runs(observations: DataFrame, actions: DataFrame, judgments: DataFrame) -> DataFrame:
    """(task_id, run_id) of runs with observations, actions and a judgment, by semi-joins."""
    runs = observations.select(*RUN).distinct()
    return runs.join(actions.select(*RUN), RUN, "left_semi").join(judgments.select(*RUN), RUN, "left_semi")


def unfinished(tasks: DataFrame, *done: DataFrame) -> DataFrame:
    """Tasks that some table of ``done`` has no row for: what a resumed job still has to do."""
    finished = tasks.select("task_id")
    for d in done:
        finished = finished.join(d.select("task_id"), "task_id", "left_semi")
    return tasks.join(finished, "task_id", "left_anti")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last in ``order``."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def best_runs(judgments: DataFrame, key: str = "task_id") -> DataFrame:
    """The judgment of the best run per key: highest success (null as 0), ties to the first run, then the first row."""
    w = Window.partitionBy(key).orderBy(F.coalesce("success", F.lit(0.0)).desc(), "run_id", "judgment_id")
    return judgments.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def passed_by_all(judgments: DataFrame, judges: list[str], observations: DataFrame, actions: DataFrame, success: float = 0.5, efficiency: float = 0.0, self_correction: float = 0.0) -> DataFrame:
    """(task_id, run_id) of complete runs that every judge of ``judges`` passes: success with efficiency or self-correction.

    The last judgment of a judge on a run counts; a run that a judge has not seen fails. One group per run, no run is
    gathered: a judge is one flag.
    """
    good = passes(F.col("success"), success) & (passes(F.col("efficiency"), efficiency) | passes(F.col("self_correction"), self_correction))
    last = judgments.where(F.col("source").isin(judges) & F.col("task_id").isNotNull()).groupBy(*RUN, "source").agg(F.max_by(good, "judgment_id").alias("ok"))
    runs = last.groupBy(*RUN).agg(F.bool_and("ok").alias("ok"), F.count("*").alias("n")).where(F.col("ok") & (F.col("n") == len(set(judges)))).select(*RUN)
    return runs.join(observations.select(*RUN), RUN, "left_semi").join(actions.select(*RUN), RUN, "left_semi")


def fractions(judgments: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Share of rows with each score above ``threshold``, null as 0."""
    return judgments.agg(*[F.avg((F.coalesce(m, F.lit(0.0)) > threshold).cast("double")).alias(f"{m}_share") for m in SCORES])


def survival(judgments: DataFrame, thresholds: tuple[float, ...] = (0.5, 0.7, 1.0)) -> DataFrame:
    """(metric, threshold, share): share of rows beyond each threshold (equal to it at 1), null as 0, in one pass."""
    cells = [F.avg(passes(F.col(m), t, "zero").cast("double")).alias(f"{m}|{t}") for m in SCORES for t in thresholds]
    wide = judgments.agg(*cells)
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(t).alias("threshold"), F.col(f"`{m}|{t}`").alias("share")) for m in SCORES for t in thresholds]))
    return wide.select(rows.alias("r")).select("r.*")


def histogram(judgments: DataFrame, metric: str, bins: int = 11) -> DataFrame:
    """(bin, n) of bins of 0.1 from -0.05, null as 0; empty bins with 0."""
    x = F.coalesce(metric, F.lit(0.0))
    b = F.greatest(F.least(F.floor((x + 0.05) / 0.1), F.lit(bins - 1)), F.lit(0)).cast("long")
    counts = judgments.select(b.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    return judgments.sparkSession.range(bins).withColumnRenamed("id", "bin").join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def consistency(judgments: DataFrame, most: float = 0.7, least: float = 0.5) -> DataFrame:
    """(task_id, consistency, best) of tasks that some run solves but not all: consistency below ``most``, best above ``least``."""
    s = F.coalesce("success", F.lit(0.0))
    g = judgments.where("task_id is not null").groupBy("task_id").agg(F.avg((s > 0.5).cast("double")).alias("consistency"), F.max(s).alias("best"))
    return g.where((F.col("consistency") < most) & (F.col("best") > least))


def trajectories(actions: DataFrame) -> DataFrame:
    """(task_id, run_id, n_actions, stopped): stopped when the first call of the last step's action is stop."""
    w = Window.partitionBy(*RUN).orderBy(F.col("step_idx").desc(), F.col("action_id").desc())
    last = actions.withColumn("_n", F.row_number().over(w)).withColumn("_c", F.count("*").over(Window.partitionBy(*RUN)))
    return last.where("_n = 1").select(*RUN, F.col("_c").alias("n_actions"), F.coalesce(F.get("function_calls", F.lit(0))["dotpath"] == "stop", F.lit(False)).alias("stopped"))


def trailing(observations: DataFrame, last: int) -> DataFrame:
    """The last ``last`` steps of each run, by row number so that no run is gathered in an array."""
    w = Window.partitionBy(*RUN).orderBy(F.col("step_idx").desc(), F.col("obs_id").desc())
    return observations.withColumn("back", F.row_number().over(w) - 1).where(F.col("back") < last)


def prefixes(steps: DataFrame, last: int) -> DataFrame:
    """One training row per step: the prompts of at most ``last`` steps up to it, in order, and the target.

    ``steps``: task_id, run_id, step_idx, prompt, target, one row per step. The frame keeps each row's state bounded.
    """
    w = Window.partitionBy(*RUN).orderBy("step_idx").rowsBetween(-(last - 1), 0)
    return steps.select(*RUN, "step_idx", F.collect_list(F.struct("prompt", "target")).over(w).alias("window"), "target")


def consistency_means(kept: DataFrame, success: float = 0.5, consistent: float = 0.5) -> DataFrame:
    """(n_tasks, mean_success, mean_consistency) over the rows of :func:`consistency`."""
    share = lambda c, t: F.round(F.avg((F.col(c) > t).cast("double")), 12)
    return kept.agg(F.count("*").alias("n_tasks"), share("best", success).alias("mean_success"), share("consistency", consistent).alias("mean_consistency"))


def trajectory_arrays(steps: DataFrame, of_observation: str, of_action: str) -> DataFrame:
    """(task_id, run_id, two arrays named as their columns): parallel arrays by step. A run is as long as its cap on actions."""
    rows = steps.groupBy(*RUN).agg(F.sort_array(F.collect_list(F.struct("step_idx", F.col(of_observation).alias("o"), F.col(of_action).alias("a")))).alias("x"))
    return rows.select(*RUN, F.transform("x", lambda s: s["o"]).alias(of_observation), F.transform("x", lambda s: s["a"]).alias(of_action))


def episodes(actions: DataFrame, max_actions: int, lost: str | None = None) -> DataFrame:
    """(task_id, run_id, done, truncated, reward): a run folded by the step protocol of an environment.

    A stop within the cap ends it; else reaching the cap truncates it. ``lost``: boolean column of steps whose session was
    gone, which end and truncate a run. There is no reward before training.
    """
    stop = F.coalesce(F.get("function_calls", F.lit(0))["dotpath"] == "stop", F.lit(False))
    gone = F.max(F.coalesce(F.col(lost), F.lit(False))) if lost else F.lit(False)
    g = actions.where("task_id is not null").groupBy(*RUN).agg(F.min(F.when(stop, F.col("step_idx"))).alias("at"), F.max("step_idx").alias("last"), gone.alias("gone"))
    stopped = F.coalesce(F.col("at") < max_actions, F.lit(False))
    return g.select(*RUN, (stopped | F.col("gone")).alias("done"), (F.col("gone") | (~stopped & (F.col("last") >= max_actions - 1))).alias("truncated"), F.lit(0.0).alias("reward"))


def strided(df: DataFrame, key: str, seed: int, world: int, digits: int = 2) -> DataFrame:
    """(key, shard): every ``world``-th row of a seeded shuffle, from each rank on.

    Ranks come from 16 ** ``digits`` hash ranges and their counts: no task sorts more than its range. Two digits suffice for
    a hundred million rows, five for a hundred billion; the counts of all ranges are summed up in one small task.
    """
    t = df.select(key, seeded_order(seed, F.col(key)).alias("_k")).withColumn("_part", F.substring("_k", 1, digits))
    counts = t.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    r = t.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy("_k", key))).join(before, "_part")
    return r.select(key, F.pmod(F.col("_before") + F.col("_r") - 1, F.lit(world)).cast("long").alias("shard"))
