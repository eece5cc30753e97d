"""Queries over the trajectory tables and their SQL twins, one entry per operator or small group of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajlake.functions import parse, scalar
from trajlake.functions.markdown import markdown
from trajlake.operators import trajectories as ops
from trajlake.runtime import table
from trajlake.streaming.sessions import sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


NUM = "coalesce(array_to_string(list_transform({0}, lambda x, i: i || '. ' || x), chr(10)), '')"


@query(
    f"""WITH t AS (SELECT *, coalesce(website, domain, 'duckduckgo.com') AS site,
      CASE WHEN len(steps) > 0 THEN instruction || chr(10) || chr(10) || 'To complete the task, let''s follow these steps:' || chr(10) || {NUM.format("steps")} ELSE instruction END AS s FROM tasks)
    SELECT task_id, site, CASE WHEN starts_with(site, 'http://') OR starts_with(site, 'https://') THEN site ELSE 'http://' || site END AS url,
      {NUM.format("steps")} AS numbered_steps,
      CASE WHEN len(criteria) > 0 THEN s || chr(10) || chr(10) || 'To complete the task, we must satisfy these criteria:' || chr(10) || {NUM.format("criteria")} ELSE s END AS full_instruction,
      coalesce(nullif(instruction, ''), nullif(identifier, ''), 'Explore the site') AS explore FROM t"""
)
def task_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Aliases, addresses, numbered lists and decorated instructions of tasks."""
    t = table(spark, d, "tasks")
    site = scalar.first_present(F.col("website"), F.col("domain"), default=scalar.DEFAULT_WEBSITE)
    return t.select(
        "task_id", site.alias("site"), scalar.with_scheme(site).alias("url"), scalar.numbered(F.col("steps")).alias("numbered_steps"),
        scalar.decorated(F.col("instruction"), F.col("steps"), F.col("criteria")).alias("full_instruction"),
        scalar.first_filled(F.col("instruction"), F.col("identifier"), "Explore the site").alias("explore"),
    )


@query(
    """SELECT judgment_id, {fail}, {zero}, {drop}, coalesce(success BETWEEN 0 AND 1, false) AND coalesce(efficiency BETWEEN 0 AND 1, false) AND coalesce(self_correction BETWEEN 0 AND 1, false) AS in_range FROM judgments""".format(
        fail=", ".join(f"coalesce({'success IS NOT NULL' if t == 0 else 'success = 1' if t == 1 else f'success > {t}'}, false) AS fail_{n}" for n, t in enumerate((0, 0.5, 1, 2))),
        zero=", ".join(f"coalesce(success, 0) {'=' if t == 1 else '>'} {t} AS zero_{n}" for n, t in enumerate((0, 0.5, 1, 2))),
        drop=", ".join(f"success {'=' if t == 1 else '>'} {t} AS drop_{n}" for n, t in enumerate((0, 0.5, 1, 2))),
    )
)
def score_tests(spark: SparkSession, d: str) -> DataFrame:
    """The three threshold variants and the range test."""
    j, s = table(spark, d, "judgments"), F.col("success")
    tests = [scalar.passes(s, t, k).alias(f"{k}_{n}") for k in ("fail", "zero", "drop") for n, t in enumerate((0.0, 0.5, 1.0, 2.0))]
    return j.select("judgment_id", *tests, scalar.in_unit_range(*[F.col(m) for m in ops.SCORES]).alias("in_range"))


@query(
    """SELECT proposal_id, coalesce(length(proposed_task) > 100, false) AS long_task, coalesce(len(steps) > 3, false) AS many_steps, coalesce(len(criteria) > 3, false) AS many_criteria,
    coalesce(len(steps), 0) > 0 AND coalesce(len(criteria), 0) > 0 AND coalesce(proposed_task, '') <> '' AS valid FROM proposals"""
)
def proposal_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Length thresholds and validity of proposals."""
    p, empty = table(spark, d, "proposals"), F.array().cast("array<string>")
    size = lambda c: F.size(F.coalesce(F.col(c), empty))
    return p.select(
        "proposal_id", scalar.longer_than(F.length("proposed_task"), 100).alias("long_task"),
        scalar.longer_than(F.when(F.col("steps").isNotNull(), F.size("steps")), 3).alias("many_steps"),
        scalar.longer_than(F.when(F.col("criteria").isNotNull(), F.size("criteria")), 3).alias("many_criteria"),
        ((size("steps") > 0) & (size("criteria") > 0) & (F.coalesce("proposed_task", F.lit("")) != "")).alias("valid"),
    )


@query(
    """SELECT action_id, coalesce(len(function_calls), 0) AS n_calls, array_to_string(list_transform(function_calls, lambda c: coalesce(c.dotpath, '') || '(' || coalesce(c.args, '') || ')'), '.') AS chain,
    regexp_replace(replace(response, '    ', ''), '[\\n\\r\\t]', ' ', 'g') AS shown FROM actions"""
)
def action_chains(spark: SparkSession, d: str) -> DataFrame:
    """Calls of an action as one chain, and its text for display."""
    a = table(spark, d, "actions")
    n = F.when(F.col("function_calls").isNull(), F.lit(0)).otherwise(F.size("function_calls")).cast("long")
    return a.select("action_id", n.alias("n_calls"), scalar.call_chain(F.col("function_calls")).alias("chain"), scalar.squeezed(F.col("response")).alias("shown"))


@query(
    """WITH n AS (SELECT obs_id, unnest(map_entries(metadata)) AS e FROM observations)
    SELECT obs_id, e.key AS node, e.value.bounding_client_rect.x AS x, e.value.bounding_client_rect.y AS y,
      coalesce(e.value.computed_style['display'] = 'contents', false) OR (coalesce(e.value.is_visible, false) AND coalesce(e.value.is_frontmost, false)) AS shown,
      e.value.bounding_client_rect.x <= 1280 AND e.value.bounding_client_rect.x + e.value.bounding_client_rect.width >= 0 AND e.value.bounding_client_rect.y <= 720 AND e.value.bounding_client_rect.y + e.value.bounding_client_rect.height >= 0 AS in_view,
      e.value.computed_style['display'] AS display, cast(trunc(e.value.bounding_client_rect.x / 2) AS INTEGER) AS half_x FROM n"""
)
def page_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Node metadata as rows: what shows, what is in the viewport, the pruned style and the scaled box."""
    n = table(spark, d, "observations").select("obs_id", F.explode("metadata").alias("node", "m"))
    r = F.col("m.bounding_client_rect")
    display = F.try_element_at("m.computed_style", F.lit("display"))
    return n.select(
        "obs_id", "node", r["x"].alias("x"), r["y"].alias("y"), scalar.shown(display, F.col("m.is_visible"), F.col("m.is_frontmost")).alias("shown"),
        scalar.overlaps(r["x"], r["y"], r["width"], r["height"], (0.0, 0.0, 1280.0, 720.0)).alias("in_view"), display.alias("display"), (r["x"] / 2).cast("int").alias("half_x"),
    )


@query(
    """WITH a AS (SELECT action_id, task_id, run_id, step_idx, regexp_extract(response, '"target_element_id": ([0-9]+)', 1) AS target FROM actions WHERE response IS NOT NULL)
    SELECT action_id, obs_id, target, map_extract_value(metadata, target).bounding_client_rect.x AS x FROM a JOIN observations o USING (task_id, run_id, step_idx) WHERE target <> ''"""
)
def target_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The element an action aims at, looked up in the metadata of its observation."""
    a = table(spark, d, "actions").where("response is not null").select("action_id", *ops.RUN, "step_idx", F.regexp_extract("response", r'"target_element_id": ([0-9]+)', 1).alias("target"))
    o = table(spark, d, "observations").select("obs_id", *ops.RUN, "step_idx", "metadata")
    return a.where("target <> ''").join(o, [*ops.RUN, "step_idx"]).select("action_id", "obs_id", "target", F.try_element_at("metadata", F.col("target"))["bounding_client_rect"]["x"].alias("x"))


@query(
    """WITH t AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s, regexp_replace(regexp_replace(text, chr(10) || '+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS line FROM documents)
    SELECT doc_id, CASE WHEN s IN ('', '#', '##', '**', '__', '~~', '``', '''''', '\"\"', '[]', '{}', '()', '<>', '****', '____', '~~~~') THEN '' WHEN length(s) > 64 THEN substr(s, 1, 64) || '...' ELSE s END AS label, line FROM t"""
)
def labels(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned labels and one-line texts."""
    return table(spark, d, "documents").select("doc_id", scalar.clean_label(F.col("text")).alias("label"), scalar.one_line(F.col("text")).alias("line"))


@query("""SELECT action_id, nullif(regexp_extract(response, '(?s)```json\\n(.*)\\n```', 1), '') AS block FROM actions""")
def fenced_blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "actions").select("action_id", scalar.fenced_json(F.col("response")).alias("block"))


NUMBER = "json_type({0}) IN ('DOUBLE', 'BIGINT', 'UBIGINT', 'BOOLEAN')"


@query(
    """WITH b AS (SELECT judgment_id, nullif(regexp_extract(response, '(?s)```json\\n(.*)\\n```', 1), '') AS block FROM judgments),
    v AS (SELECT judgment_id, CASE WHEN json_valid(block) THEN block::json END AS j FROM b),
    k AS (SELECT judgment_id, j, coalesce({a} AND {b} AND {c}, false) AS parsed_ok FROM v)
    SELECT judgment_id, parsed_ok, CASE WHEN parsed_ok THEN (j->>'success')::double END AS success, CASE WHEN parsed_ok THEN (j->>'efficiency')::double END AS efficiency,
      CASE WHEN parsed_ok THEN (j->>'self_correction')::double END AS self_correction FROM k""".format(a=NUMBER.format("j->'success'"), b=NUMBER.format("j->'efficiency'"), c=NUMBER.format("j->'self_correction'"))
)
def parsed_judgments(spark: SparkSession, d: str) -> DataFrame:
    return parse.parse_judgments(table(spark, d, "judgments"))


@query(
    """WITH b AS (SELECT proposal_id, nullif(regexp_extract(response, '(?s)```json\\n(.*)\\n```', 1), '') AS block FROM proposals),
    v AS (SELECT proposal_id, CASE WHEN json_valid(block) THEN block::json END AS j FROM b),
    k AS (SELECT proposal_id, j, coalesce(json_type(j->'proposed_task') = 'VARCHAR' AND (j->>'proposed_task') <> '' AND json_array_length(j->'steps') > 0 AND json_array_length(j->'criteria') > 0, false) AS parsed_ok FROM v)
    SELECT proposal_id, parsed_ok, CASE WHEN parsed_ok THEN j->>'proposed_task' END AS proposed_task, CASE WHEN parsed_ok THEN json_array_length(j->'steps')::bigint END AS n_steps,
    CASE WHEN parsed_ok THEN json_array_length(j->'criteria')::bigint END AS n_criteria FROM k"""
)
def parsed_proposals(spark: SparkSession, d: str) -> DataFrame:
    p = parse.parse_proposals(table(spark, d, "proposals"))
    n = lambda c: F.when(F.col("parsed_ok"), F.size(c).cast("long"))
    return p.select("proposal_id", "parsed_ok", "proposed_task", n("steps").alias("n_steps"), n("criteria").alias("n_criteria"))


@query(
    """WITH b AS (SELECT action_id, nullif(regexp_extract(response, '(?s)```json\\n(.*)\\n```', 1), '') AS block FROM actions),
    v AS (SELECT action_id, CASE WHEN json_valid(block) THEN block::json END AS j FROM b),
    p AS (SELECT action_id, j->>'action_key' AS k, j->'action_kwargs' AS a, CASE WHEN json_type(j->'target_element_id') <> 'NULL' THEN j->>'target_element_id' END AS t FROM v),
    c AS (SELECT action_id, t, k, CASE
      WHEN k = 'click' AND json_type(a) = 'OBJECT' AND json_exists(a, '$.x') AND json_exists(a, '$.y') THEN 'page.mouse.click(' || (a->>'x') || ',' || (a->>'y') || ')'
      WHEN k = 'click' AND json_type(a) = 'OBJECT' AND t IS NOT NULL THEN 'click({ force: true })'
      WHEN k = 'hover' AND t IS NOT NULL THEN 'hover()'
      WHEN k = 'scroll' AND json_type(a) = 'OBJECT' THEN 'page.mouse.wheel(' || coalesce(a->>'delta_x', '0') || ',' || coalesce(a->>'delta_y', '0') || ')'
      WHEN k = 'fill' AND t IS NOT NULL THEN 'fill(''' || coalesce(a->>'value', 'None') || ''')'
      WHEN k = 'select_option' AND t IS NOT NULL THEN 'selectOption(''' || coalesce(a->>'label', 'None') || ''')'
      WHEN k = 'set_checked' AND t IS NOT NULL THEN 'setChecked(' || CASE WHEN coalesce(a->>'checked', 'false') IN ('false', '', '0') THEN 'false' ELSE 'true' END || ')'
      WHEN k = 'go_back' THEN 'page.goBack()' WHEN k = 'go_forward' THEN 'page.goForward()'
      WHEN k = 'goto' AND json_type(a) = 'OBJECT' THEN 'page.goto(''' || coalesce(a->>'url', 'None') || ''')' WHEN k = 'stop' AND json_type(a) = 'OBJECT' THEN 'stop(' || coalesce(a->>'answer', 'None') || ')' END AS call FROM p)
    SELECT action_id, call IS NOT NULL AS parsed_ok,
      CASE WHEN call IS NOT NULL THEN CASE WHEN t IS NOT NULL AND k IN ('click', 'hover', 'fill', 'select_option', 'set_checked') THEN 'page.locator("[backend_node_id=''' || t || ''']").' ELSE '' END || call END AS chain FROM c"""
)
def parsed_actions(spark: SparkSession, d: str) -> DataFrame:
    p = parse.parse_actions(table(spark, d, "actions"))
    return p.select("action_id", "parsed_ok", F.when(F.col("parsed_ok"), scalar.call_chain(F.col("function_calls"))).alias("chain"))


@query("""SELECT t.task_id, o.run_id, o.step_idx, obs_id, action_id, judgment_id FROM tasks t JOIN observations o ON t.task_id = o.task_id
    JOIN actions a ON a.task_id = o.task_id AND a.run_id = o.run_id AND a.step_idx = o.step_idx JOIN judgments j ON j.task_id = o.task_id AND j.run_id = o.run_id""")
def joined_steps(spark: SparkSession, d: str) -> DataFrame:
    return ops.step_rows(*[table(spark, d, t) for t in ("tasks", "observations", "actions", "judgments")])


@query("""SELECT DISTINCT task_id, run_id FROM observations o WHERE EXISTS (SELECT 1 FROM actions a WHERE a.task_id = o.task_id AND a.run_id = o.run_id) AND EXISTS (SELECT 1 FROM judgments j WHERE j.task_id = o.task_id AND j.run_id = o.run_id)""")
def runs_complete(spark: SparkSession, d: str) -> DataFrame:
    return ops.complete_runs(*[table(spark, d, t) for t in ("observations", "actions", "judgments")])


@query("""SELECT task_id, identifier FROM tasks t WHERE NOT (task_id IN (SELECT task_id FROM observations) AND task_id IN (SELECT task_id FROM actions) AND task_id IN (SELECT task_id FROM judgments) AND task_id IN (SELECT task_id FROM proposals))""")
def tasks_unfinished(spark: SparkSession, d: str) -> DataFrame:
    return ops.unfinished(table(spark, d, "tasks"), *[table(spark, d, t) for t in ("observations", "actions", "judgments", "proposals")]).select("task_id", "identifier")


@query("""WITH l AS (SELECT identifier, instruction, row_number() OVER (PARTITION BY identifier ORDER BY task_id DESC) AS n FROM tasks WHERE identifier IS NOT NULL)
    SELECT j.judgment_id, l.instruction FROM judgments j JOIN l ON j.identifier = l.identifier WHERE l.n = 1""")
def site_instructions(spark: SparkSession, d: str) -> DataFrame:
    """Lookup of a site's task by identifier, the last duplicate wins."""
    one = ops.last_wins(table(spark, d, "tasks").select("identifier", "instruction", "task_id"), "identifier", "task_id")
    return table(spark, d, "judgments").select("judgment_id", "identifier").join(one, "identifier").select("judgment_id", "instruction")


@query("""WITH o AS (SELECT task_id, run_id, obs_id, row_number() OVER (PARTITION BY task_id, run_id ORDER BY step_idx, obs_id) AS n FROM observations),
    a AS (SELECT task_id, run_id, action_id, row_number() OVER (PARTITION BY task_id, run_id ORDER BY step_idx, action_id) AS n FROM actions)
    SELECT o.task_id, o.run_id, o.n, obs_id, action_id FROM o JOIN a ON o.task_id = a.task_id AND o.run_id = a.run_id AND o.n = a.n""")
def zipped_steps(spark: SparkSession, d: str) -> DataFrame:
    """Observations and actions of a run side by side by position, as far as the shorter goes."""
    pos = lambda k: F.row_number().over(Window.partitionBy(*ops.RUN).orderBy("step_idx", k)).cast("long").alias("n")
    o = table(spark, d, "observations").select(*ops.RUN, "obs_id", pos("obs_id"))
    a = table(spark, d, "actions").select(*ops.RUN, "action_id", pos("action_id"))
    return o.join(a, [*ops.RUN, "n"])


@query("""WITH l AS (SELECT task_id, run_id, source, success > 0.5 AND (efficiency IS NOT NULL OR self_correction IS NOT NULL) AS ok, row_number() OVER (PARTITION BY task_id, run_id, source ORDER BY judgment_id DESC) AS n FROM judgments
      WHERE task_id IS NOT NULL AND source IN (SELECT source FROM judgments WHERE source IS NOT NULL GROUP BY source ORDER BY count(*) DESC, source LIMIT 1))
    SELECT j.task_id, j.run_id FROM l j WHERE n = 1 AND coalesce(ok, false) AND EXISTS (SELECT 1 FROM observations o WHERE o.task_id = j.task_id AND o.run_id = j.run_id) AND EXISTS (SELECT 1 FROM actions a WHERE a.task_id = j.task_id AND a.run_id = j.run_id)""")
def all_judges(spark: SparkSession, d: str) -> DataFrame:
    """Runs with observations and actions that every judge of a list passes; here the list is the most used judge alone."""
    j = table(spark, d, "judgments")
    first = [r[0] for r in j.where("source is not null").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(1).collect()]
    return ops.passed_by_all(j, first, table(spark, d, "observations"), table(spark, d, "actions"))


@query("""SELECT task_id, bool_or(coalesce(success > 0.5, false)) AS any_run, count(*) AS runs FROM judgments GROUP BY task_id""")
def any_run(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "judgments").groupBy("task_id").agg(F.bool_or(scalar.passes(F.col("success"), 0.5)).alias("any_run"), F.count("*").alias("runs"))


BEST = """WITH b AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY coalesce(success, 0) DESC, run_id, judgment_id) AS n FROM judgments WHERE task_id IS NOT NULL) """


@query(BEST + "SELECT task_id, run_id, judgment_id, success FROM b WHERE n = 1")
def best_of_n(spark: SparkSession, d: str) -> DataFrame:
    return ops.best_runs(table(spark, d, "judgments")).select("task_id", "run_id", "judgment_id", "success")


@query(BEST + "SELECT " + ", ".join(f"round(avg((coalesce({m}, 0) > 0.5)::int), 12) AS {m}_share" for m in ops.SCORES) + " FROM b WHERE n = 1")
def best_fractions(spark: SparkSession, d: str) -> DataFrame:
    f = ops.fractions(ops.best_runs(table(spark, d, "judgments")))
    return f.select(*[F.round(c, 12).alias(c) for c in f.columns])


@query(" UNION ALL ".join(f"SELECT '{m}' AS metric, {t}::double AS threshold, round(avg((coalesce({m}, 0) {'=' if t == 1.0 else '>'} {t})::int), 12) AS share FROM judgments" for m in ops.SCORES for t in (0.5, 0.7, 1.0)))
def score_survival(spark: SparkSession, d: str) -> DataFrame:
    return ops.survival(table(spark, d, "judgments")).withColumn("share", F.round("share", 12))


@query("""WITH c AS (SELECT greatest(least(floor((coalesce(success, 0) + 0.05) / 0.1), 10), 0)::bigint AS bin, count(*) AS n FROM judgments GROUP BY 1) SELECT r.range AS bin, coalesce(n, 0) AS n FROM range(11) r LEFT JOIN c ON r.range = c.bin""")
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return ops.histogram(table(spark, d, "judgments"), "success")


@query("""SELECT task_id, round(avg((coalesce(success, 0) > 0.5)::int), 12) AS consistency, max(coalesce(success, 0)) AS best FROM judgments WHERE task_id IS NOT NULL GROUP BY task_id
    HAVING avg((coalesce(success, 0) > 0.5)::int) < 0.7 AND max(coalesce(success, 0)) > 0.5""")
def run_consistency(spark: SparkSession, d: str) -> DataFrame:
    return ops.consistency(table(spark, d, "judgments")).withColumn("consistency", F.round("consistency", 12))


@query("""WITH l AS (SELECT task_id, run_id, function_calls, row_number() OVER (PARTITION BY task_id, run_id ORDER BY step_idx DESC, action_id DESC) AS n, count(*) OVER (PARTITION BY task_id, run_id) AS c FROM actions),
    t AS (SELECT c, coalesce(function_calls[1].dotpath = 'stop', false) AS stopped FROM l WHERE n = 1)
    SELECT sum(c)::bigint AS actions, count(*) AS trajectories, round(avg(c), 9) AS mean_length, round(avg(stopped::int), 9) AS stop_share, round(avg(c) FILTER (WHERE stopped), 9) AS mean_stopped FROM t""")
def trajectory_stats(spark: SparkSession, d: str) -> DataFrame:
    t = ops.trajectories(table(spark, d, "actions"))
    return t.agg(
        F.sum("n_actions").alias("actions"), F.count("*").alias("trajectories"), F.round(F.avg("n_actions"), 9).alias("mean_length"),
        F.round(F.avg(F.col("stopped").cast("double")), 9).alias("stop_share"), F.round(F.avg(F.when(F.col("stopped"), F.col("n_actions"))), 9).alias("mean_stopped"),
    )


@query("""SELECT j.judgment_id, j.response IS NULL OR coalesce(a.bad, false) AS faulty FROM judgments j LEFT JOIN (SELECT task_id, run_id, bool_or(response IS NULL) AS bad FROM actions GROUP BY ALL) a ON j.task_id = a.task_id AND j.run_id = a.run_id""")
def data_errors(spark: SparkSession, d: str) -> DataFrame:
    """Runs whose judgment or some action has no response; a run without actions is kept."""
    bad = table(spark, d, "actions").groupBy(*ops.RUN).agg(F.bool_or(F.col("response").isNull()).alias("bad"))
    j = table(spark, d, "judgments").select("judgment_id", *ops.RUN, "response")
    return j.join(bad, ops.RUN, "left").select("judgment_id", (F.col("response").isNull() | F.coalesce("bad", F.lit(False))).alias("faulty"))


@query("""SELECT judgment_id, len(t.steps) AS n_steps FROM judgments j JOIN tasks t ON t.task_id = j.task_id WHERE j.success = 1 AND j.efficiency = 1 AND t.steps IS NOT NULL ORDER BY n_steps DESC, judgment_id LIMIT 10""")
def hardest_solved(spark: SparkSession, d: str) -> DataFrame:
    """The ten runs that solved the tasks of most steps with full marks: the limit is the feature."""
    full = scalar.passes(F.col("success"), 1.0) & scalar.passes(F.col("efficiency"), 1.0)
    t = table(spark, d, "tasks").where("steps is not null").select("task_id", F.size("steps").cast("long").alias("n_steps"))
    return table(spark, d, "judgments").where(full).select("judgment_id", "task_id").join(t, "task_id").select("judgment_id", "n_steps").orderBy(F.desc("n_steps"), "judgment_id").limit(10)


@query("""SELECT p.proposal_id, p.proposed_task FROM proposals p WHERE proposed_task IS NOT NULL AND steps IS NOT NULL AND criteria IS NOT NULL AND identifier IS NOT NULL
    AND EXISTS (SELECT 1 FROM judgments j WHERE j.task_id = p.task_id AND j.run_id = p.run_id AND j.success IS NOT NULL)
    AND NOT EXISTS (SELECT 1 FROM judgments j WHERE j.task_id = p.task_id AND j.run_id = p.run_id AND j.success = 1)""")
def refined_tasks(spark: SparkSession, d: str) -> DataFrame:
    """One step of refinement: proposals that are complete, judged, and not already solved."""
    j = table(spark, d, "judgments").where("success is not null")
    p = table(spark, d, "proposals").where("proposed_task is not null and steps is not null and criteria is not null and identifier is not null")
    solved = j.where(scalar.passes(F.col("success"), 1.0, "drop")).select(*ops.RUN)
    return p.join(j.select(*ops.RUN), ops.RUN, "left_semi").join(solved, ops.RUN, "left_anti").select("proposal_id", "proposed_task")


@query("""SELECT judgment_id, coalesce(success > 0.5, false) AND coalesce(efficiency > 0.5, false) OR coalesce(success > 0.5, false) AND coalesce(self_correction > 0.5, false) AS selected FROM judgments""")
def sft_selected(spark: SparkSession, d: str) -> DataFrame:
    s, e, c = (scalar.passes(F.col(m), 0.5) for m in ops.SCORES)
    return table(spark, d, "judgments").select("judgment_id", ((s & e) | (s & c)).alias("selected"))


CHAIN_OK = "k IN ('go_back', 'go_forward') OR (k IN ('scroll', 'goto', 'stop') AND json_type(a) = 'OBJECT') OR (k = 'click' AND json_type(a) = 'OBJECT' AND (t IS NOT NULL OR (json_exists(a, '$.x') AND json_exists(a, '$.y')))) OR (k = 'hover' AND t IS NOT NULL) OR (k IN ('fill', 'select_option', 'set_checked') AND t IS NOT NULL AND json_type(a) = 'OBJECT')"


@query(f"""WITH b AS (SELECT action_id, task_id, step_idx, nullif(regexp_extract(response, '(?s)```json\\n(.*)\\n```', 1), '') AS block FROM actions),
    v AS (SELECT action_id, task_id, step_idx, CASE WHEN json_valid(block) THEN block::json END AS j FROM b),
    f AS (SELECT action_id, task_id, step_idx, j, j->>'action_key' AS k, j->'action_kwargs' AS a, CASE WHEN json_type(j->'target_element_id') <> 'NULL' THEN j->>'target_element_id' END AS t FROM v),
    p AS (SELECT action_id, task_id, step_idx, j, coalesce(json_type(j) = 'OBJECT' AND json_exists(j, '$.action_key') AND json_exists(j, '$.action_kwargs') AND json_exists(j, '$.target_element_id') AND ({CHAIN_OK}), false) AS ok FROM f),
    g AS (SELECT task_id, step_idx, min(action_id) AS gold FROM p WHERE ok GROUP BY ALL)
    SELECT a.action_id, CASE WHEN a.ok THEN round(0.1 + 0.3 * coalesce((a.j->>'action_key') = (b.j->>'action_key'), false)::int + 0.3 * coalesce((a.j->'target_element_id')::varchar = (b.j->'target_element_id')::varchar, false)::int
      + 0.3 * coalesce((a.j->'action_kwargs')::varchar = (b.j->'action_kwargs')::varchar, false)::int, 6) ELSE 0.0 END::double AS reward
    FROM p a JOIN g ON g.task_id = a.task_id AND g.step_idx = a.step_idx JOIN p b ON b.action_id = g.gold""")
def rewards(spark: SparkSession, d: str) -> DataFrame:
    """Reward of each action's response against the first well-formed one of its task and step, standing in for a gold answer."""
    a = table(spark, d, "actions").select("action_id", "task_id", "step_idx", "response")
    p = a.join(parse.action_keys(a), "action_id")
    gold = p.where("ok").groupBy("task_id", "step_idx").agg(F.min_by(F.struct("action_key", "target_element_id", "action_kwargs"), "action_id").alias("gold"))
    return p.join(gold, ["task_id", "step_idx"]).select("action_id", scalar.reward(F.col("ok"), F.col("gold")).alias("reward"))


@query("""SELECT obs_id, back FROM (SELECT obs_id, row_number() OVER (PARTITION BY task_id, run_id ORDER BY step_idx DESC, obs_id DESC) - 1 AS back FROM observations) WHERE back < 5""")
def trailing_observations(spark: SparkSession, d: str) -> DataFrame:
    return ops.trailing(table(spark, d, "observations"), 5).select("obs_id", F.col("back").cast("long").alias("back"))


STEPS = """WITH s AS (SELECT o.task_id, o.run_id, o.step_idx, o.prompt, a.target FROM (SELECT task_id, run_id, step_idx, arg_min(processed_text, obs_id) AS prompt FROM observations WHERE processed_text IS NOT NULL GROUP BY ALL) o
    JOIN (SELECT task_id, run_id, step_idx, arg_min(response, action_id) AS target FROM actions WHERE response IS NOT NULL GROUP BY ALL) a USING (task_id, run_id, step_idx)) """


def _steps(spark: SparkSession, d: str) -> DataFrame:
    at = [*ops.RUN, "step_idx"]
    o = table(spark, d, "observations").where("processed_text is not null").groupBy(*at).agg(F.min_by("processed_text", "obs_id").alias("prompt"))
    a = table(spark, d, "actions").where("response is not null").groupBy(*at).agg(F.min_by("response", "action_id").alias("target"))
    return o.join(a, at)


@query(STEPS + """, w AS (SELECT task_id, run_id, step_idx, target, list({'prompt': prompt, 'target': target}) OVER (PARTITION BY task_id, run_id ORDER BY step_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS x FROM s)
    SELECT task_id, run_id, step_idx, len(x) AS turns, md5(array_to_string(list_transform(x, lambda e: e.prompt || chr(10) || e.target), chr(10))) AS chat, target FROM w""")
def training_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every prefix of a run as a training row: the last five turns in order, and the target."""
    w = ops.prefixes(_steps(spark, d), 5)
    text = F.array_join(F.transform("window", lambda e: F.concat(e["prompt"], F.lit("\n"), e["target"])), "\n")
    return w.select(*ops.RUN, "step_idx", F.size("window").cast("long").alias("turns"), F.md5(text).alias("chat"), "target")


@query(STEPS + """, r AS (SELECT *, row_number() OVER (PARTITION BY task_id, run_id ORDER BY step_idx DESC) AS back FROM s)
    SELECT task_id, run_id, string_agg(CASE WHEN back = 1 THEN 'Last' ELSE 'Previous' END || ' page: ' || md5(prompt) || chr(10) || CASE WHEN back = 1 THEN 'Next' ELSE 'Previous' END || ' action: ' || md5(target), chr(10) || chr(10) ORDER BY back DESC) AS summary FROM r WHERE back <= 3 GROUP BY ALL""")
def judge_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The last three steps of a run as the text a judge reads (pages and actions by digest)."""
    r = _steps(spark, d).withColumn("back", F.row_number().over(Window.partitionBy(*ops.RUN).orderBy(F.col("step_idx").desc()))).where("back <= 3")
    last = F.col("back") == 1
    line = F.concat(F.when(last, "Last").otherwise("Previous"), F.lit(" page: "), F.md5("prompt"), F.lit("\n"), F.when(last, "Next").otherwise("Previous"), F.lit(" action: "), F.md5("target"))
    rows = r.groupBy(*ops.RUN).agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("b"), line.alias("t")))).alias("x"))
    return rows.select(*ops.RUN, F.array_join(F.transform("x", lambda e: e["t"]), "\n\n").alias("summary"))


@query("""WITH j AS (SELECT task_id, run_id, judgment_id, success, dense_rank() OVER (PARTITION BY task_id ORDER BY run_id DESC) AS back FROM judgments WHERE task_id IS NOT NULL)
    SELECT task_id, run_id, judgment_id, back FROM j WHERE back <= 2""")
def proposer_windows(spark: SparkSession, d: str) -> DataFrame:
    """The judgments of the last two runs of each task, as a proposer sees them."""
    j = table(spark, d, "judgments").where("task_id is not null")
    back = F.dense_rank().over(Window.partitionBy("task_id").orderBy(F.col("run_id").desc())).cast("long")
    return j.select("task_id", "run_id", "judgment_id", back.alias("back")).where("back <= 2")


@query("""WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, least(len(w), 64) AS n_tokens, array_to_string(w[1:64], ' ') AS head, 64 - least(len(w), 64) AS n_pad FROM t""")
def token_windows(spark: SparkSession, d: str) -> DataFrame:
    """Truncation to a token budget (white-space tokens) and the padding to it."""
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    t = table(spark, d, "documents").where("text is not null").select("doc_id", w.alias("w"))
    n = F.least(F.size("w"), F.lit(64)).cast("long")
    return t.select("doc_id", n.alias("n_tokens"), F.array_join(F.slice("w", 1, 64), " ").alias("head"), (64 - n).alias("n_pad"))


@query("""SELECT task_id, (row_number() OVER (ORDER BY md5('0-' || task_id), task_id) - 1) % 8 AS shard FROM tasks""")
def shards(spark: SparkSession, d: str) -> DataFrame:
    """Seeded shuffle and strided shards."""
    return ops.strided(table(spark, d, "tasks").select("task_id"), "task_id", 0, 8)


@query("""SELECT task_id FROM tasks ORDER BY md5('7-' || task_id), task_id LIMIT 100""")
def sampled_tasks(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample without replacement: the limit is the feature."""
    return table(spark, d, "tasks").orderBy(scalar.seeded_order(7, F.col("task_id")), "task_id").select("task_id").limit(100)


@query("""WITH f AS (SELECT task_id, run_id, min(step_idx) AS stop_at FROM actions WHERE function_calls[1].dotpath = 'stop' GROUP BY ALL)
    SELECT a.action_id FROM actions a LEFT JOIN f ON a.task_id = f.task_id AND a.run_id = f.run_id WHERE a.step_idx < 30 AND a.step_idx <= coalesce(f.stop_at, 30)""")
def capped_actions(spark: SparkSession, d: str) -> DataFrame:
    """Actions up to the first stop and at most thirty steps."""
    a = table(spark, d, "actions")
    stop = a.where(F.get("function_calls", F.lit(0))["dotpath"] == "stop").groupBy(*ops.RUN).agg(F.min("step_idx").alias("stop_at"))
    return a.join(stop, ops.RUN, "left").where((F.col("step_idx") < 30) & (F.col("step_idx") <= F.coalesce("stop_at", F.lit(30)))).select("action_id")


@query("""SELECT 'action' AS src, action_id AS row_id, response IS NULL AS missing FROM actions UNION ALL SELECT 'judgment', judgment_id, response IS NULL FROM judgments UNION ALL SELECT 'proposal', proposal_id, response IS NULL FROM proposals""")
def all_responses(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select(F.lit(t[:-1]).alias("src"), F.col(f"{t[:-1]}_id").alias("row_id"), F.col("response").isNull().alias("missing")) for t in ("actions", "judgments", "proposals")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT obs_id, regexp_replace(regexp_extract(screenshot_path, '([^/]+)$', 1), '\\.jpg$', '') AS stem, printf('%s/screenshot_%02d.jpg', identifier, step_idx) AS path FROM observations WHERE screenshot_path IS NOT NULL AND identifier IS NOT NULL""")
def screenshot_paths(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "observations").where("screenshot_path is not null and identifier is not null")
    return o.select("obs_id", F.regexp_replace(F.regexp_extract("screenshot_path", r"([^/]+)$", 1), r"\.jpg$", "").alias("stem"), F.format_string("%s/screenshot_%02d.jpg", "identifier", "step_idx").alias("path"))


@query(BEST + "SELECT o.obs_id FROM observations o WHERE EXISTS (SELECT 1 FROM b WHERE n = 1 AND b.task_id = o.task_id AND b.run_id = o.run_id)")
def winner_observations(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the best runs alone, to be written in place of copied files."""
    best = ops.best_runs(table(spark, d, "judgments")).select(*ops.RUN)
    return table(spark, d, "observations").join(best, ops.RUN, "left_semi").select("obs_id")


@query("""WITH e AS (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
    SELECT event_id, user_id, sum((prev IS NULL OR ts > prev + INTERVAL 30 MINUTE)::int) OVER (PARTITION BY user_id ORDER BY ts, event_id)::bigint AS session_idx FROM e""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id").select("event_id", "user_id", "session_idx")


@query("""SELECT action_id, coalesce(function_calls[1].dotpath = 'stop', false) AS done, 0.0::double AS reward, step_idx >= 29 AS truncated FROM actions""")
def env_steps(spark: SparkSession, d: str) -> DataFrame:
    """The step protocol of an environment as columns: done on stop, truncated at the cap, no reward."""
    a = table(spark, d, "actions")
    return a.select("action_id", F.coalesce(F.get("function_calls", F.lit(0))["dotpath"] == "stop", F.lit(False)).alias("done"), F.lit(0.0).alias("reward"), (F.col("step_idx") >= 29).alias("truncated"))


@query()
def page_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Markdown of every page's HTML, with the page's node metadata: hidden and covered elements are left out."""
    return markdown(table(spark, d, "observations"), metadata="metadata", visible=True, frontmost=True)
