"""Queries for chats, loss masks and projections, with their SQL twins. Messages are compared as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.functions import parse, scalar
from trajlake.operators import chats, loops, providers
from trajlake.operators import trajectories as ops
from trajlake.plans.reference import query
from trajlake.runtime import table
from trajlake.sources import io

TOKENS, LENGTH = 2048, 4096
#: Separator of messages in compared text.
SEP = "\x1e"


def q(text: str) -> str:
    """``text`` as an SQL literal."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def sql_filled(template: str, **fields: str) -> str:
    out, rest = [], template
    while "{" in rest:
        before, _, after = rest.partition("{")
        name, _, rest = after.partition("}")
        out += [q(before), fields[name]]
    return " || ".join([*out, q(rest)])


CUT = "CASE WHEN len(list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> '')) <= {1} THEN {0} ELSE array_to_string(list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> '')[1:{1}], ' ') END"
STEPS = f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY task_id, run_id, step_idx ORDER BY obs_id) AS n FROM observations), a AS (SELECT *, row_number() OVER (PARTITION BY task_id, run_id, step_idx ORDER BY action_id) AS n FROM actions),
    s AS (SELECT o.task_id, o.run_id, o.step_idx, t.instruction, o.current_url, {CUT.format("o.processed_text", TOKENS)} AS page, a.response, a.matched_response
      FROM o JOIN a ON o.task_id = a.task_id AND o.run_id = a.run_id AND o.step_idx = a.step_idx JOIN (SELECT task_id, min(instruction) AS instruction FROM tasks GROUP BY task_id) t ON t.task_id = o.task_id WHERE o.n = 1 AND a.n = 1),
    u AS (SELECT *, {sql_filled(chats.AGENT_TURN, instruction="instruction", current_url="current_url", observation="page")} AS usr FROM s),
    w AS (SELECT *, list({{'u': usr, 'r': response}}) OVER (PARTITION BY task_id, run_id ORDER BY step_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS x FROM u),
    c AS (SELECT *, {q(chats.AGENT_SYSTEM)} || chr(30) || array_to_string(list_transform(x[1:len(x) - 1], lambda e: e.u || chr(30) || e.r || chr(30)), '') || usr AS prompt FROM w
      WHERE usr IS NOT NULL AND len(list_filter(x[1:len(x) - 1], lambda e: e.u IS NULL OR e.r IS NULL)) = 0) """
ONE = "(SELECT *, row_number() OVER (PARTITION BY task_id, run_id ORDER BY judgment_id) AS n FROM judgments WHERE task_id IS NOT NULL)"


def steps(spark: SparkSession, d: str) -> DataFrame:
    return chats.steps_of(table(spark, d, "tasks"), table(spark, d, "observations"), table(spark, d, "actions"))


def one_judgment(spark: SparkSession, d: str) -> DataFrame:
    """The first judgment of each run."""
    j = table(spark, d, "judgments").where("task_id is not null")
    return j.groupBy(*ops.RUN).agg(F.min_by(F.struct("success", "response"), "judgment_id").alias("x")).select(*ops.RUN, "x.*")


def texts(messages: str) -> list:
    return [F.array_join(F.transform(messages, lambda m: m["role"]), " ").alias("roles"), F.array_join(F.transform(messages, lambda m: m["content"]), SEP).alias("contents")]


ROLES = "'system' || repeat(' user assistant', len(x) - 1) || ' user'"


@query(STEPS + f"SELECT task_id, run_id, step_idx, {ROLES} || ' assistant' AS roles, prompt || chr(30) || response AS contents FROM c WHERE response IS NOT NULL")
def agent_chats(spark: SparkSession, d: str) -> DataFrame:
    """Supervised rows: the chat of every prefix of every run, the action taken as the last message."""
    return chats.agent_chats(steps(spark, d)).select(*ops.RUN, "step_idx", *texts("messages"))


@query(STEPS + f", j AS {ONE} SELECT c.task_id, c.run_id, step_idx, {ROLES} AS roles, prompt AS contents, c.matched_response AS ground_truth, j.success FROM c JOIN j ON j.task_id = c.task_id AND j.run_id = c.run_id WHERE n = 1 AND c.matched_response IS NOT NULL")
def rl_rows(spark: SparkSession, d: str) -> DataFrame:
    """Reinforcement rows: the prompt of every prefix and the matched response as ground truth."""
    r = chats.rl_rows(steps(spark, d), one_judgment(spark, d))
    return r.select(*ops.RUN, "step_idx", *texts("prompt"), F.col("reward_model.ground_truth").alias("ground_truth"), F.col("extra_info.success").alias("success"))


def sql_parts(page: tuple[str, str], act: tuple[str, str]) -> str:
    """Summary texts of runs from ``s``: last five pages and actions, in order."""
    lab = lambda p: f"CASE WHEN back > 1 THEN {q(p[0])} ELSE {q(p[1])} END"
    one = f"{lab(page)} || ' Webpage:' || chr(10) || chr(10) || coalesce(page, 'None') || chr(10) || chr(10) || {lab(act)} || ' Action:' || chr(10) || chr(10) || coalesce(response, 'None')"
    return f""", b AS (SELECT *, row_number() OVER (PARTITION BY task_id, run_id ORDER BY step_idx DESC) AS back FROM s),
    p AS (SELECT task_id, run_id, min(instruction) AS instruction, string_agg({one}, chr(10) || chr(10) ORDER BY back DESC) AS summary FROM b WHERE back <= 5 GROUP BY task_id, run_id) """


@query(STEPS + sql_parts(("## Previous", "## Last"), ("## Previous", "## Next")) + f"SELECT task_id, run_id, 'system user' AS roles, {q(chats.JUDGE_SYSTEM)} || chr(30) || {sql_filled(chats.JUDGE_TURN, instruction='instruction', summary='summary')} AS contents FROM p WHERE instruction IS NOT NULL")
def judge_chats(spark: SparkSession, d: str) -> DataFrame:
    """What a judge reads of every run, in full text."""
    return chats.judge_chats(steps(spark, d)).select(*ops.RUN, *texts("messages"))


TURNS = (
    STEPS + sql_parts(("### Previous", "### Final"), ("### Previous", "### Final")) + f""", j AS {ONE},
    k AS (SELECT j.task_id, j.run_id, j.response AS judgment, row_number() OVER (PARTITION BY j.task_id ORDER BY j.run_id DESC) - 1 AS back FROM j WHERE n = 1 AND EXISTS (SELECT 1 FROM s WHERE s.task_id = j.task_id AND s.run_id = j.run_id)),
    v AS (SELECT k.task_id, k.run_id, k.back, '### Initial Task:' || chr(10) || chr(10) || coalesce(instruction, 'None') || CASE WHEN back < 1 THEN chr(10) || chr(10) || summary ELSE '' END
      || chr(10) || chr(10) || '### Final Score:' || chr(10) || chr(10) || coalesce(judgment, 'None') AS summary FROM k JOIN p ON p.task_id = k.task_id AND p.run_id = k.run_id WHERE back < 5),
    m AS (SELECT task_id, run_id, back, {sql_filled(chats.PROPOSER_TURN, summary='summary')} AS content FROM v) """
)


@query(TURNS + "SELECT task_id, run_id, back::bigint AS back, content FROM m")
def proposer_turns(spark: SparkSession, d: str) -> DataFrame:
    """What a task proposer reads of each of a task's last runs: tasks and judgments of five, pages and actions of one."""
    return chats.proposer_turns(steps(spark, d), one_judgment(spark, d))


@query(TURNS + f""", r AS (SELECT task_id, run_id, response, row_number() OVER (PARTITION BY task_id, run_id ORDER BY proposal_id) AS n FROM proposals WHERE response IS NOT NULL),
    h AS (SELECT m.*, r.response AS proposal FROM m LEFT JOIN r ON r.task_id = m.task_id AND r.run_id = m.run_id AND r.n = 1)
    SELECT task_id, 'system' || repeat(' user assistant', (count(*) - 1)::int) || ' user' AS roles, {q(chats.PROPOSER_SYSTEM)} || chr(30) || string_agg(content || CASE WHEN back > 0 THEN chr(30) || proposal ELSE '' END, chr(30) ORDER BY back DESC) AS contents
    FROM h GROUP BY task_id HAVING count(*) FILTER (WHERE back > 0 AND proposal IS NULL) = 0""")
def proposer_chats(spark: SparkSession, d: str) -> DataFrame:
    """The proposer's chat of each task, past proposals between the turns."""
    first = table(spark, d, "proposals").where("response is not null").groupBy(*ops.RUN).agg(F.min_by("response", "proposal_id").alias("response"))
    return chats.proposer_chats(proposer_turns(spark, d), first).select("task_id", *texts("messages"))


@query()
def masked_chats(spark: SparkSession, d: str) -> DataFrame:
    """Every supervised row as tokens of fixed length, labels of the assistant's turns, and attention; tested on fixtures."""
    masked = chats.loss_masks(chats.agent_chats(steps(spark, d)), bos="<s>", eos="</s>")
    return chats.collated(masked.select(*ops.RUN, "step_idx", "tokens", "mask"), LENGTH)


COUNT = "len(list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> ''))"


@query(
    STEPS + f""", n AS (SELECT 2 + {COUNT.format(q("system: " + chats.AGENT_SYSTEM))} + len(x) * 2 + list_sum(list_transform(x, lambda e: {COUNT.format("e.u")} + {COUNT.format("e.r")})) AS tokens FROM c WHERE response IS NOT NULL)
    SELECT count(*) AS n_rows, sum(least(tokens, {LENGTH}))::bigint AS n_tokens, sum(tokens - least(tokens, {LENGTH}))::bigint AS n_cut, sum({LENGTH} - least(tokens, {LENGTH}))::bigint AS n_padding FROM n"""
)
def mask_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Rows, tokens, cut tokens and padding of the supervised corpus at a sequence length."""
    masked = chats.loss_masks(chats.agent_chats(steps(spark, d)), bos="<s>", eos="</s>")
    return chats.mask_statistics(masked, LENGTH).drop("n_trained")


@query("""WITH g AS (SELECT task_id, avg((coalesce(success, 0) > 0.5)::int) AS consistency, max(coalesce(success, 0)) AS best FROM judgments WHERE task_id IS NOT NULL GROUP BY task_id)
    SELECT count(*) AS n_tasks, round(avg((best > 0.5)::int), 12) AS mean_success, round(avg((consistency > 0.5)::int), 12) AS mean_consistency FROM g WHERE consistency < 0.7 AND best > 0.5""")
def consistency_means(spark: SparkSession, d: str) -> DataFrame:
    """Over the tasks that are kept for merging: how many succeed and how many are consistent, as the final running means."""
    return ops.consistency_means(ops.consistency(table(spark, d, "judgments")))


NUM = "array_to_string(list_transform({0}, lambda x, i: i || '. ' || x), chr(10))"


@query(
    "SELECT task_id, " + ", ".join(
        f"CASE WHEN len(criteria) > 0 THEN {s} || {q(c)} || {NUM.format('criteria')} ELSE {s} END AS for_{role}"
        for role, (st, c) in scalar.ROLES.items()
        for s in [f"(CASE WHEN len(steps) > 0 THEN instruction || {q(st)} || {NUM.format('steps')} ELSE instruction END)"]
    ) + " FROM tasks"
)
def role_instructions(spark: SparkSession, d: str) -> DataFrame:
    """The instruction with steps and criteria in the wording of each role."""
    return table(spark, d, "tasks").select("task_id", *[scalar.decorated(F.col("instruction"), F.col("steps"), F.col("criteria"), role).alias(f"for_{role}") for role in scalar.ROLES])


@query("""SELECT obs_id, e.key AS node, e.value.backend_node_id AS backend_node_id, e.value.bounding_client_rect.width AS width, e.value.computed_style['display'] AS display, e.value.scroll_left AS scroll_left, e.value.scroll_top AS scroll_top,
    e.value.editable_value AS editable_value, e.value.is_visible AS is_visible, e.value.is_frontmost AS is_frontmost FROM (SELECT obs_id, unnest(map_entries(metadata)) AS e FROM observations)""")
def node_metadata(spark: SparkSession, d: str) -> DataFrame:
    """The eight kept keys of each node, absent ones null, and only the display style."""
    n = table(spark, d, "observations").select("obs_id", scalar.kept_metadata("metadata").alias("metadata")).select("obs_id", F.explode("metadata").alias("node", "m"))
    return n.select("obs_id", "node", "m.backend_node_id", F.col("m.bounding_client_rect.width").alias("width"), F.try_element_at("m.computed_style", F.lit("display")).alias("display"), "m.scroll_left", "m.scroll_top", "m.editable_value", "m.is_visible", "m.is_frontmost")


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY task_id, run_id, step_idx ORDER BY obs_id) AS n FROM observations), a AS (SELECT *, row_number() OVER (PARTITION BY task_id, run_id, step_idx ORDER BY action_id) AS n FROM actions)
    SELECT o.task_id, o.run_id, string_agg(coalesce(o.current_url, ''), chr(30) ORDER BY o.step_idx) AS urls, string_agg(coalesce(a.matched_response, ''), chr(30) ORDER BY o.step_idx) AS responses
    FROM o JOIN a ON o.task_id = a.task_id AND o.run_id = a.run_id AND o.step_idx = a.step_idx WHERE o.n = 1 AND a.n = 1 AND o.task_id IN (SELECT task_id FROM tasks) GROUP BY o.task_id, o.run_id""")
def trajectory_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Each run as parallel arrays of one field of its observations and one of its actions."""
    t = ops.trajectory_arrays(steps(spark, d), "current_url", "matched_response")
    text = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(x, F.lit(""))), SEP)
    return t.select(*ops.RUN, text("current_url").alias("urls"), text("matched_response").alias("responses"))


@query("""SELECT action_id, coalesce(json_valid(matched_response) AND json_type(CASE WHEN json_valid(matched_response) THEN matched_response::json END) = 'OBJECT', false) AS fenced_reads FROM actions""")
def bare_actions(spark: SparkSession, d: str) -> DataFrame:
    """Bare action text in a fence of the kind the parser reads: it reads exactly what is a JSON object."""
    a = table(spark, d, "actions")
    fenced = a.select("action_id", scalar.fence(F.col("matched_response")).alias("response"))
    return parse.parse_objects(fenced).select("action_id", F.col("parsed_ok").alias("fenced_reads"))


@query("""WITH l AS (SELECT domain, instruction, row_number() OVER (PARTITION BY domain ORDER BY task_id DESC) AS n FROM tasks WHERE domain IS NOT NULL) SELECT t.task_id, l.instruction AS shown FROM tasks t JOIN l ON l.domain = t.domain WHERE l.n = 1""")
def domain_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Caption of each task's video: the task text of its domain, the last one winning."""
    t = table(spark, d, "tasks")
    return t.select("task_id", "domain").join(ops.last_wins(t.select("domain", "instruction", "task_id"), "domain", "task_id").select("domain", F.col("instruction").alias("shown")), "domain").select("task_id", "shown")


@query("""WITH f AS (SELECT task_id, run_id, count(*) AS n, min(step_idx) FILTER (WHERE function_calls[1].dotpath = 'stop') AS stop_at, max(step_idx) AS last_at FROM actions WHERE task_id IS NOT NULL GROUP BY task_id, run_id)
    SELECT task_id, run_id, stop_at IS NOT NULL AND stop_at < 30 AS done, coalesce(stop_at, 30) >= 30 AND last_at >= 29 AS truncated, 0.0::double AS reward FROM f""")
def episodes(spark: SparkSession, d: str) -> DataFrame:
    """Each run folded by the environment's protocol: done by a stop within the cap, else truncated when the cap is reached."""
    return ops.episodes(table(spark, d, "actions"), 30)


@query("""SELECT website, instruction, identifier, len(steps) AS n_steps FROM tasks""")
def task_table(spark: SparkSession, d: str) -> DataFrame:
    """The task source with its aliases resolved."""
    t = io.read_tasks(spark, f"{d}/tasks.parquet")
    return t.select("website", "instruction", "identifier", F.when(F.col("steps").isNotNull(), F.size("steps").cast("long")).alias("n_steps"))


@query("""SELECT website, count(*) AS n FROM tasks GROUP BY website""")
def explored_sites(spark: SparkSession, d: str) -> DataFrame:
    """Tasks per site as an explorer sees them: without instruction, steps and criteria."""
    return io.exploration(io.resolve_tasks(table(spark, d, "tasks"))).groupBy("website").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT o.task_id, o.run_id, o.step_idx, a.stop FROM (SELECT DISTINCT task_id, run_id, step_idx FROM observations) o JOIN (SELECT task_id, run_id, step_idx, bool_or(coalesce(function_calls[1].dotpath = 'stop', false)) AS stop FROM actions GROUP BY ALL) a
      ON a.task_id = o.task_id AND a.run_id = o.run_id AND a.step_idx = o.step_idx WHERE o.step_idx < 30),
    w AS (SELECT *, row_number() OVER (PARTITION BY task_id, run_id ORDER BY step_idx) - 1 AS pos, coalesce(max(stop::int) OVER (PARTITION BY task_id, run_id ORDER BY step_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM s),
    r AS (SELECT task_id, run_id, count(*) AS n_steps FROM w WHERE pos = step_idx AND ended = 0 GROUP BY task_id, run_id)
    SELECT r.task_id, r.run_id, n_steps, EXISTS (SELECT 1 FROM judgments j WHERE j.task_id = r.task_id AND j.run_id = r.run_id) AS judged FROM r WHERE r.task_id IN (SELECT task_id FROM tasks)""")
def replayed_runs(spark: SparkSession, d: str) -> DataFrame:
    """Trajectory generation in replay mode: how far each run's recorded steps go."""
    return providers.replayed_runs(*[table(spark, d, t) for t in ("tasks", "observations", "actions", "judgments")])


@query("""WITH p AS (SELECT * FROM proposals WHERE proposed_task IS NOT NULL AND steps IS NOT NULL AND criteria IS NOT NULL AND identifier IS NOT NULL)
    SELECT identifier, proposed_task AS instruction, len(steps) AS n_steps FROM p WHERE EXISTS (SELECT 1 FROM judgments j WHERE j.task_id = p.task_id AND j.run_id = p.run_id AND j.success IS NOT NULL)
    AND NOT EXISTS (SELECT 1 FROM judgments j WHERE j.task_id = p.task_id AND j.run_id = p.run_id AND j.success = 1)""")
def refined_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Task table after three refinement rounds that replay the recorded proposals and judgments."""
    p, j = table(spark, d, "proposals"), table(spark, d, "judgments")
    end = loops.refine(table(spark, d, "tasks"), lambda tasks, i: (p, j), rounds=3)
    return end.select("identifier", "instruction", F.size("steps").cast("long").alias("n_steps"))


@query("""WITH s AS (SELECT o.current_url, a.action_id, a.function_calls FROM actions a JOIN (SELECT task_id, run_id, step_idx, arg_min(current_url, obs_id) AS current_url FROM observations GROUP BY ALL) o ON o.task_id = a.task_id AND o.run_id = a.run_id AND o.step_idx = a.step_idx)
    SELECT action_id, array_to_string(list_transform(function_calls[1:3], lambda c: coalesce(c.dotpath, '') || '(' || coalesce(c.args, '') || ')'), '.') AS chain FROM s WHERE function_calls IS NOT NULL AND NOT coalesce(array_to_string(list_transform(function_calls, lambda c: c.dotpath), ' ') LIKE '%page.goto%', false)""")
def sent_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls as a browser takes them: at most three an action; the twin leaves out goto calls, whose resolution is tested apart."""
    o = table(spark, d, "observations").groupBy(*ops.RUN, "step_idx").agg(F.min_by("current_url", "obs_id").alias("current_url"))
    a = table(spark, d, "actions").where(F.col("function_calls").isNotNull() & ~F.exists("function_calls", lambda c: F.coalesce(c["dotpath"].contains("page.goto"), F.lit(False))))
    sent = providers.absolute_calls(a.join(o, [*ops.RUN, "step_idx"]), "action_id")
    return sent.select("action_id", scalar.call_chain(F.col("function_calls")).alias("chain"))


@query("""SELECT obs_id, identifier, step_idx FROM observations WHERE screenshot_path IS NOT NULL""")
def reply_check(spark: SparkSession, d: str) -> DataFrame:
    """Browser replies rebuilt as JSON from observations, checked and decoded again: those with every key come through."""
    o = table(spark, d, "observations")
    reply = F.to_json(F.struct(F.coalesce("raw_html", F.lit("")).alias("raw_html"), F.base64(F.encode("screenshot_path", "utf-8")).alias("screenshot"), F.lit("{}").alias("metadata"), "current_url"))
    got = providers.valid_replies(o.select("obs_id", "identifier", "step_idx", reply.alias("reply")))
    return got.where("screenshot is not null").select("obs_id", "identifier", "step_idx")
