"""Chats for training and prompting: windows over the steps of runs, assembled as arrays of messages by DataFrame windows.

A message is a struct of role and content. A run is never gathered whole: frames of fixed length bound what a row holds.
Prompt wordings are parameters; the templates below are the fixed formats of user turns and summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.operators.trajectories import RUN

#: Formats of the user turns.
AGENT_TURN = "## Complete The Following Task\n\n{instruction}\n\nYou are at {current_url} observing the viewport:\n\n{observation}"
JUDGE_TURN = "Determine if the agent has completed the task:\n\n{instruction}\n\nHere is the agent's trajectory:\n\n{summary}"
PROPOSER_TURN = "You are viewing the agent's trajectory during its operation:\n\n{summary}\n\nBased on the agent's trajectory, assign the next task."
#: System prompts by default; give your own.
AGENT_SYSTEM = "You operate a web browser to complete a task."
JUDGE_SYSTEM = "You judge whether a web task was completed."
PROPOSER_SYSTEM = "You assign tasks to an agent that operates a web browser."


def filled(template: str, **fields: Column) -> Column:
    """``template`` with ``{name}`` replaced by columns; null where one of them is."""
    parts, rest = [], template
    while "{" in rest:
        before, _, after = rest.partition("{")
        name, _, rest = after.partition("}")
        parts += [F.lit(before), fields[name]]
    return F.concat(*parts, F.lit(rest))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def first_tokens(text: Column, most: int) -> Column:
    """The first ``most`` white-space tokens of a text, which stands as it is when it has no more; a tokenizer's own encode
    and decode may take its place."""
    tokens = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.when(F.size(tokens) <= most, text).otherwise(F.array_join(F.slice(tokens, 1, most), " "))


def one_step(rows: DataFrame, order: str, *columns: str) -> DataFrame:
    """One row per run and step of ``rows``, the first in ``order``; nulls of that row stay."""
    first = F.min_by(F.struct(*columns), order).alias("x")
    return rows.groupBy(*RUN, "step_idx").agg(first).select(*RUN, "step_idx", "x.*")


def steps_of(tasks: DataFrame, observations: DataFrame, actions: DataFrame) -> DataFrame:
    """(task_id, run_id, step_idx, instruction, current_url, observation, response, matched_response) of every step that has
    an observation, an action and a task; repeated deliveries count once."""
    o = one_step(observations, "obs_id", "current_url", F.col("processed_text").alias("observation"))
    a = one_step(actions, "action_id", "response", "matched_response")
    t = tasks.groupBy("task_id").agg(F.min("instruction").alias("instruction"))
    return o.join(a, [*RUN, "step_idx"]).join(t, "task_id")


def agent_chats(steps: DataFrame, last_obs: int = 5, system: str = AGENT_SYSTEM, template: str = AGENT_TURN, max_tokens: int = 2048) -> DataFrame:
    """(task_id, run_id, step_idx, messages): for every prefix of a run the system prompt, the last ``last_obs`` user turns
    with the actions between them, the last user turn, and the action taken as the final assistant turn.

    A window of no observation is an error. Prefixes with a null message are left out, as no trainer takes them.
    """
    return with_target(steps, last_obs, system, template, max_tokens).where("response is not null").select(
        *RUN, "step_idx", F.concat("prompt", F.array(message("assistant", F.col("response")))).alias("messages")
    )


def rl_rows(steps: DataFrame, judgments: DataFrame, split: str = "train", source: str = "web", style: str = "trajectory", last_obs: int = 5, system: str = AGENT_SYSTEM, template: str = AGENT_TURN, max_tokens: int = 2048) -> DataFrame:
    """Rows of a reinforcement data set: the prompt of each prefix, the matched response as ground truth, the run's success.

    ``judgments``: one row per run. Prefixes without a matched response, or with a null message, are left out.
    """
    rows = with_target(steps, last_obs, system, template, max_tokens).where("matched_response is not null")
    success = judgments.select(*RUN, "success")
    return rows.join(success, RUN).select(
        *RUN, "step_idx", F.lit(source).alias("data_source"), "prompt", F.lit(source).alias("ability"),
        F.struct(F.lit(style).alias("style"), F.col("matched_response").alias("ground_truth")).alias("reward_model"),
        F.struct("success", F.lit(split).alias("split")).alias("extra_info"),
    )


def with_target(steps: DataFrame, last_obs: int, system: str, template: str, max_tokens: int) -> DataFrame:
    """``steps`` with ``prompt``: the messages up to each step's user turn; rows with a null message are left out."""
    if last_obs < 1:
        raise ValueError("a chat needs at least one observation")
    user = filled(template, instruction=F.col("instruction"), current_url=F.col("current_url"), observation=first_tokens(F.col("observation"), max_tokens))
    w = Window.partitionBy(*RUN).orderBy("step_idx").rowsBetween(-(last_obs - 1), 0)
    rows = steps.select(*RUN, "step_idx", user.alias("user"), "response", "matched_response")
    rows = rows.withColumn("turns", F.collect_list(F.struct("user", "response")).over(w))
    n = F.size("turns")
    earlier = F.slice("turns", F.lit(1), n - 1)
    whole = F.forall(earlier, lambda t: t["user"].isNotNull() & t["response"].isNotNull()) & F.col("user").isNotNull()
    pairs = F.flatten(F.transform(earlier, lambda t: F.array(message("user", t["user"]), message("assistant", t["response"]))))
    prompt = F.concat(F.array(message("system", F.lit(system))), pairs, F.array(message("user", F.col("user"))))
    return rows.where(whole).select(*RUN, "step_idx", prompt.alias("prompt"), "response", "matched_response")


def trailing_parts(steps: DataFrame, last_obs: int, last_actions: int, labels: tuple[str, str, str, str], max_tokens: int) -> DataFrame:
    """(task_id, run_id, parts): texts of a run's last observations and actions in order.

    ``labels``: of an earlier and the last page, of an earlier and the last action. Row numbers keep only the steps needed.
    """
    back = F.row_number().over(Window.partitionBy(*RUN).orderBy(F.col("step_idx").desc()))
    rows = steps.withColumn("back", back).where(F.col("back") <= max(last_obs, last_actions))
    page = F.concat(F.when(F.col("back") > 1, labels[0]).otherwise(labels[1]), F.lit(" Webpage:\n\n"), F.coalesce(first_tokens(F.col("observation"), max_tokens), F.lit("None")))
    act = F.concat(F.when(F.col("back") > 1, labels[2]).otherwise(labels[3]), F.lit(" Action:\n\n"), F.coalesce("response", F.lit("None")))
    texts = F.filter(F.array(F.when(F.col("back") <= last_obs, page), F.when(F.col("back") <= last_actions, act)), lambda x: x.isNotNull())
    got = rows.groupBy(*RUN).agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), texts.alias("texts")))).alias("x"), F.min("instruction").alias("instruction"))
    return got.select(*RUN, "instruction", F.flatten(F.transform("x", lambda s: s["texts"])).alias("parts"))


def judge_chats(steps: DataFrame, last_obs: int = 5, last_actions: int = 5, system: str = JUDGE_SYSTEM, template: str = JUDGE_TURN, max_tokens: int = 2048) -> DataFrame:
    """(task_id, run_id, messages): what a judge reads of each run: the task and a summary of the last pages and actions."""
    parts = trailing_parts(steps, last_obs, last_actions, ("## Previous", "## Last", "## Previous", "## Next"), max_tokens)
    user = filled(template, instruction=F.col("instruction"), summary=F.array_join("parts", "\n\n"))
    return parts.where("instruction is not null").select(*RUN, F.array(message("system", F.lit(system)), message("user", user)).alias("messages"))


def proposer_turns(
    steps: DataFrame, judgments: DataFrame, last_judgments: int = 5, last_tasks: int = 5, last_trajectories: int = 1, last_actions: int = 5, last_obs: int = 5,
    template: str = PROPOSER_TURN, max_tokens: int = 2048,
) -> DataFrame:
    """(task_id, run_id, back, content): the user turn of each run in view, the latest at ``back`` 0.

    Each part has its own window, counted in runs from the latest: the task, the pages and actions of the trajectory, the
    judgment. A run outside all windows has no turn. ``judgments``: one row per run with a response.
    """
    runs = judgments.where("task_id is not null").select(*RUN, F.col("response").alias("judgment"))
    back = F.row_number().over(Window.partitionBy("task_id").orderBy(F.col("run_id").desc())) - 1
    runs = runs.join(steps.select(*RUN).distinct(), RUN, "left_semi").withColumn("back", back).where(F.col("back") < max(last_judgments, last_tasks, last_trajectories))
    parts = trailing_parts(steps, last_obs, last_actions, ("### Previous", "### Final", "### Previous", "### Final"), max_tokens)
    seen = runs.join(parts, RUN)
    none = F.array().cast("array<string>")
    text = F.concat(
        F.when(F.col("back") < last_tasks, F.array(F.concat(F.lit("### Initial Task:\n\n"), F.coalesce("instruction", F.lit("None"))))).otherwise(none),
        F.when(F.col("back") < last_trajectories, F.col("parts")).otherwise(none),
        F.when(F.col("back") < last_judgments, F.array(F.concat(F.lit("### Final Score:\n\n"), F.coalesce("judgment", F.lit("None"))))).otherwise(none),
    )
    return seen.where(F.size(text) > 0).select(*RUN, F.col("back").cast("long").alias("back"), filled(template, summary=F.array_join(text, "\n\n")).alias("content"))


def proposer_chats(turns: DataFrame, proposals: DataFrame, system: str = PROPOSER_SYSTEM) -> DataFrame:
    """(task_id, messages): the turns of :func:`proposer_turns` with the proposals made after all but the latest between them.

    ``proposals``: one row per run with a response. A task whose earlier turn has no proposal is left out: its chat is not whole.
    The turns of a task are bounded by their windows.
    """
    said = turns.join(proposals.where("response is not null").select(*RUN, F.col("response").alias("proposal")), RUN, "left")
    got = said.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), "content", "proposal"))).alias("x"))
    earlier = F.slice("x", F.lit(1), F.size("x") - 1)
    whole = F.forall(earlier, lambda t: t["proposal"].isNotNull())
    pairs = F.flatten(F.transform(earlier, lambda t: F.array(message("user", t["content"]), message("assistant", t["proposal"]))))
    last = message("user", F.element_at("x", -1)["content"])
    return got.where(whole).select("task_id", F.concat(F.array(message("system", F.lit(system))), pairs, F.array(last)).alias("messages"))


def loss_masks(chats: DataFrame, messages: str = "messages", bos: str | None = None, eos: str | None = None) -> DataFrame:
    """``chats`` with ``tokens`` and ``mask``: 1 for each token of an assistant's turn, else 0.

    Tokens are those of white space; a turn is its role and content. A begin or end token is added where it is not among
    the first or last two already; the end counts as the assistant's.
    """
    words = lambda t: F.filter(F.split(F.concat(t["role"], F.lit(": "), F.coalesce(t["content"], F.lit(""))), r"\s+"), lambda w: w != "")
    turns = F.transform(messages, lambda t: F.struct(words(t).alias("w"), (t["role"] == "assistant").cast("int").alias("m")))
    df = chats.withColumn("_t", turns)
    tokens, mask = F.flatten(F.transform("_t", lambda t: t["w"])), F.flatten(F.transform("_t", lambda t: F.array_repeat(t["m"], F.size(t["w"]))))
    if bos is not None:
        add = ~F.array_contains(F.slice(tokens, 1, 2), bos)
        tokens, mask = F.when(add, F.concat(F.array(F.lit(bos)), tokens)).otherwise(tokens), F.when(add, F.concat(F.array(F.lit(0)), mask)).otherwise(mask)
    df = df.select("*", tokens.alias("tokens"), mask.alias("mask")).drop("_t")
    if eos is not None:
        add = ~F.array_contains(F.slice(F.reverse("tokens"), 1, 2), eos)
        df = df.withColumn("_add", add).withColumn("tokens", F.when(F.col("_add"), F.concat("tokens", F.array(F.lit(eos)))).otherwise(F.col("tokens")))
        df = df.withColumn("mask", F.when(F.col("_add"), F.concat("mask", F.array(F.lit(1)))).otherwise(F.col("mask"))).drop("_add")
    return df


def collated(masked: DataFrame, length: int, pad: str = "<pad>", ignored: str = "-100") -> DataFrame:
    """``masked`` with ``tokens``, ``labels`` and ``attention`` cut and padded to ``length``; labels of masked tokens are ``ignored``."""
    fit = lambda x, fill: F.slice(F.concat(x, F.array_repeat(F.lit(fill), length)), 1, length)
    labels = F.zip_with("tokens", "mask", lambda t, m: F.when(m == 0, F.lit(ignored)).otherwise(t))
    ones = F.transform("tokens", lambda t: F.lit(1))
    return masked.select("*", fit(labels, ignored).alias("labels"), fit(ones, 0).alias("attention")).withColumn("tokens", fit(F.col("tokens"), pad)).drop("mask")


def mask_statistics(masked: DataFrame, length: int) -> DataFrame:
    """(n_rows, n_tokens, n_trained, n_cut, n_padding) over a corpus of masked chats at a sequence length."""
    n = F.size("tokens").cast("long")
    kept = F.least(n, F.lit(length))
    return masked.agg(
        F.count("*").alias("n_rows"), F.sum(kept).alias("n_tokens"), F.sum(F.aggregate(F.slice("mask", 1, length), F.lit(0).cast("long"), lambda a, m: a + m)).alias("n_trained"),
        F.sum(n - kept).alias("n_cut"), F.sum(length - kept).alias("n_padding"),
    )
