import base64
import json

import pytest
from pyspark.sql import functions as F

from trajlake.functions import parse, scalar
from trajlake.functions.markdown import FAILED, SCHEMAS, Schema, markdown, register, render
from trajlake.operators import chats, loops, providers
from trajlake.operators import trajectories as ops
from trajlake.sources import io

STEP = "task_id long, run_id int, step_idx int, instruction string, current_url string, observation string, response string, matched_response string"


def rows(n, **change):
    return [{"task_id": 1, "run_id": 0, "step_idx": i, "instruction": "Go", "current_url": f"u{i}", "observation": f"page {i}", "response": f"act {i}", "matched_response": f"m{i}"} | change.get(f"s{i}", {}) for i in range(n)]


def test_agent_chats(spark):
    df = spark.createDataFrame(rows(7, s2={"response": None}), STEP)
    got = {r.step_idx: [(m.role, m.content) for m in r.messages] for r in chats.agent_chats(df, last_obs=3).collect()}
    assert set(got) == {0, 1, 5, 6}  # step 2 has no answer: neither it nor windows that hold it as an earlier turn are whole
    assert [r for r, _ in got[6]] == ["system", "user", "assistant", "user", "assistant", "user", "assistant"]
    assert got[0][1:] == [("user", "## Complete The Following Task\n\nGo\n\nYou are at u0 observing the viewport:\n\npage 0"), ("assistant", "act 0")]
    assert [c for r, c in got[6] if r == "assistant"] == ["act 4", "act 5", "act 6"]
    with pytest.raises(ValueError):
        chats.agent_chats(df, last_obs=0)
    assert chats.agent_chats(df.limit(0)).count() == 0
    j = spark.createDataFrame([(1, 0, None)], "task_id long, run_id int, success double")
    rl = {r.step_idx: r for r in chats.rl_rows(df, j, last_obs=3).collect()}
    assert set(rl) == {0, 1, 2, 5, 6} and rl[6].reward_model.ground_truth == "m6" and rl[6].extra_info.success is None and rl[6].prompt[-1].role == "user"


def test_summaries(spark):
    df = spark.createDataFrame(rows(3), STEP)
    text = chats.judge_chats(df, last_obs=1, last_actions=2).first().messages[1].content
    assert text.endswith("## Previous Action:\n\nact 1\n\n## Last Webpage:\n\npage 2\n\n## Next Action:\n\nact 2")
    many = df.unionByName(df.withColumn("run_id", F.lit(1))).unionByName(df.withColumn("run_id", F.lit(2)))
    j = spark.createDataFrame([(1, r, f"score {r}") for r in range(3)], "task_id long, run_id int, response string")
    turns = {r.back: r.content for r in chats.proposer_turns(many, j, last_judgments=1, last_tasks=2, last_trajectories=1, last_obs=1, last_actions=1).collect()}
    assert set(turns) == {0, 1}
    assert turns[1] == chats.PROPOSER_TURN.format(summary="### Initial Task:\n\nGo")
    assert turns[0] == chats.PROPOSER_TURN.format(summary="### Initial Task:\n\nGo\n\n### Final Webpage:\n\npage 2\n\n### Final Action:\n\nact 2\n\n### Final Score:\n\nscore 2")
    t = chats.proposer_turns(many, j)
    p = spark.createDataFrame([(1, 0, "p0"), (1, 1, "p1")], "task_id long, run_id int, response string")
    assert [m.role for m in chats.proposer_chats(t, p).first().messages] == ["system", "user", "assistant", "user", "assistant", "user"]
    assert chats.proposer_chats(t, p.where("run_id = 1")).count() == 0


def test_masks_and_padding(spark):
    df = spark.createDataFrame([([("system", "a b"), ("user", "c"), ("assistant", "d e f")],), ([],)], "messages array<struct<role string, content string>>")
    m = chats.loss_masks(df, bos="<s>", eos="</s>").collect()
    assert m[0].tokens == ["<s>", "system:", "a", "b", "user:", "c", "assistant:", "d", "e", "f", "</s>"] and m[0].mask == [0] * 6 + [1] * 5
    assert m[1].tokens == ["<s>", "</s>"] and m[1].mask == [0, 1]
    assert chats.loss_masks(df).first().tokens[0] == "system:"
    masked = chats.loss_masks(df, bos="<s>", eos="</s>")
    c = chats.collated(masked, 9).collect()
    assert c[0].labels == ["-100"] * 6 + ["assistant:", "d", "e"] and c[0].attention == [1] * 9
    assert c[1].tokens == ["<s>", "</s>"] + ["<pad>"] * 7 and c[1].labels == ["-100", "</s>"] + ["-100"] * 7 and c[1].attention == [1, 1] + [0] * 7
    assert tuple(chats.mask_statistics(masked, 9).first()) == (2, 11, 4, 2, 7)


def test_retries():
    seen = []

    def flaky(x):
        seen.append(x)
        if len(seen) < 3:
            raise ValueError("no")
        return x + 1

    slept = []
    assert providers.retried(flaky, 1, sleep=slept.append) == 2 and slept == [1.0, 1.5]
    assert providers.retried(int, "x", sleep=slept.append) is providers.ERROR and slept[2:] == [1.0, 1.5, 2.25]
    assert providers.retried(int, "x", on_error=lambda e, i: providers.ERROR, sleep=slept.append) is providers.ERROR and len(slept) == 5


def test_providers(spark):
    df = spark.createDataFrame([(i, f"q{i}" if i else None) for i in range(20)], "id long, prompt string").repartition(3)
    got = {r.id: (r.response, r.failed) for r in providers.ask(df, "id", "prompt", lambda: providers.Echo(str.upper)).collect()}
    assert got[0] == (None, False) and got[7] == ("Q7", False)
    lost = providers.ask(df, "id", "prompt", lambda: providers.Echo(str.upper, fails=1.0), tries=2, factor=0.0).collect()
    assert all(r.response is None and r.failed == (r.id > 0) for r in lost)
    again = providers.replay(df, spark.createDataFrame([(3, "r3")], "id long, response string"), ["id"])
    assert {(r.id, r.response) for r in again.where("not failed").collect()} == {(3, "r3")}
    ok = json.dumps({"raw_html": "<p>", "screenshot": base64.b64encode(b"png").decode(), "metadata": {}, "current_url": "u"})
    replies = spark.createDataFrame([(1, ok), (2, '{"raw_html": "x"}'), (3, "no json"), (4, None)], "id long, reply string")
    r = providers.valid_replies(replies).collect()
    assert [(x.id, x.raw_html, bytes(x.screenshot), x.current_url) for x in r] == [(1, "<p>", b"png", "u")]
    calls = spark.createDataFrame([(1, "http://a.test/x/y", [("page.goto", "'../z'"), ("a", ""), ("b", None), ("c", "")]), (2, None, None)], "id long, current_url string, function_calls array<struct<dotpath string, args string>>")
    assert {x.id: [tuple(c) for c in x.function_calls] for x in providers.absolute_calls(calls, "id").collect()} == {1: [("page.goto", "'http://a.test/z'"), ("a", ""), ("b", "")], 2: []}
    t = spark.createDataFrame([("", "", "x"), ("", "u", ""), ("", "u", "x"), ("s", "u", "x"), ("s", "u", None), ("s", None, "x"), ("s", "", "")], "s string, u string, a string")
    assert [x[0] for x in t.select(providers.tool_branch(F.col("s"), F.col("u"), F.col("a"))).collect()] == ["error", "start", "start_act", "goto_act", "goto", "act", "observe"]


def test_loops(spark):
    p = spark.createDataFrame([(i, 0, f"s{i}", f"t{i}", ["a"], ["b"]) for i in range(3)], "task_id long, run_id int, identifier string, proposed_task string, steps array<string>, criteria array<string>")
    j = spark.createDataFrame([(0, 0, 1.0), (1, 0, 0.5), (2, 0, None)], "task_id long, run_id int, success double")
    seen = []

    def explore(tasks, i):
        seen.append(tasks.count())
        return p, j

    assert [r.instruction for r in loops.refine(p.limit(2), explore, rounds=3).collect()] == ["t1"]
    assert seen == [2, 2, 2]
    out = loops.improve(p, lambda shard, i: shard, lambda r, i: r.select("identifier"), 2)
    assert sorted(r.identifier for d in out for r in d.collect()) == ["s0", "s1", "s2"]


def test_episodes(spark):
    df = spark.createDataFrame([(1, 0, 0, "a", False), (1, 0, 1, "stop", False), (2, 0, 0, "a", False), (2, 0, 2, "a", False), (3, 0, 0, "a", True), (4, 0, 0, "a", None)], "task_id long, run_id int, step_idx int, f string, lost boolean")
    df = df.select("*", F.array(F.struct(F.col("f").alias("dotpath"))).alias("function_calls"))
    assert {r.task_id: (r.done, r.truncated) for r in ops.episodes(df, 3, "lost").collect()} == {1: (True, False), 2: (False, True), 3: (True, True), 4: (False, False)}


def test_sources(spark, tmp_path):
    t = io.literal_tasks(spark, [{"domain": "a.test", "task": "x", "steps": ["s"]}, {"website": "b.test", "steps": []}])
    assert [tuple(r) for r in io.resolve_tasks(t.drop("website", "instruction")).select("website", "instruction", "identifier").collect()] == [("a.test", "x", None), (None, None, None)]
    assert io.resolve_tasks(t.select("task")).first().website == "duckduckgo.com"
    assert io.exploration(t).columns == ["website", "domain", "identifier"]
    path = str(tmp_path / "tasks.parquet")
    io.write_entities(t.withColumn("split", F.lit("train")), path, required=["steps"], by=["split"])
    assert (tmp_path / "tasks.parquet" / "split=train").exists()
    assert io.read_tasks(spark, path, split="train").count() == 1 and io.read_tasks(spark, path, split="test").count() == 0
    io.write_entities(t, "")


def test_names_and_fences(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "i long")
    got = {r[0] for r in df.select(scalar.session_name(F.col("i"), ["red", "blue"], ["owl", "cat", "elk"])).collect()}
    assert got <= {f"{a}-{b}" for a in ("red", "blue") for b in ("owl", "cat", "elk")} and len(got) > 3
    fenced = spark.createDataFrame([('{"action_key": "go_back"}',), ("nope",)], "t string").select(F.monotonically_increasing_id().alias("action_id"), scalar.fence(F.col("t")).alias("response"))
    assert sorted(r.parsed_ok for r in parse.parse_actions(fenced).collect()) == [False, True]
    assert parse.keyed('{"action_key": "go_back", "target_element_id": null}') is None
    assert parse.keyed('{"action_key": "go_back", "action_kwargs": {"b": 1, "a": 2}, "target_element_id": null}') == ('"go_back"', "null", '{"b": 1, "a": 2}')


SHOWN = {"backend_node_id": "7", "is_visible": True, "is_frontmost": True, "computed_style": {}, "bounding_client_rect": {"x": 0.0, "y": 0.0, "width": 5.0, "height": 5.0}}


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<a backend_node_id=7>**</a>", "[id: 7] # link"),
        ("<a backend_node_id=7 aria-haspopup=true title=Menu>x</a>", "[id: 7] Menu dropdown"),
        ("<a href='#'>x</a>", "[x]()"),
        ("<button backend_node_id=7 name=go type=submit>x</button>", "[id: 7] go submit button"),
        ("<button>x</button>", "x"),
        ("<div role=checkbox aria-checked=true backend_node_id=7 title=T></div>", '[id: 7] "true" (T checkbox)'),
        ("<input type=radio backend_node_id=7>", '[id: 7] "None" (checkbox)'),
        ("<label id=l>Name</label><input type=email backend_node_id=7 aria-labelledby=l placeholder=p>", 'Name [id: 7] "p" (Name email input)'),
        ("<input type=range backend_node_id=7 min=1 max=9 step=2 value=3 name=v>", '[id: 7] "None (3)" (v range slider min: 1 max: 9 step: 2)'),
        ("<div role=slider backend_node_id=7 aria-valuetext=low aria-valuenow=1></div>", '[id: 7] "low (1)" (range slider step: low)'),
        ("<select backend_node_id=7 name=s><option>a<option>b</select>", '[id: 7] "" (s select from: a, b)'),
        ("<textarea backend_node_id=7 name=t value=v></textarea>", '[id: 7] """\nv\n""" (t textbox)'),
        ("<div role=combobox backend_node_id=7 name=c></div>", '[id: 7] "None selected" c dropdown'),
        ("<div role=listbox backend_node_id=7 name=c><p>a</p><p>b</p></div>", "[id: 7] c dropdown\n* a\n* b\n"),
        ("<form name=login><p>a</p><p>b</p></form>", "\n## Login Form\na\nb"),
        ("<img src=x.png><img alt=Cat>", "x.png image Cat image"),
        ("<ul>t<li>a<ul><li>b</ul></ul>", "\n t\n* a \n    * b\n"),
        ("<ol><li>a</li>x<li>b</li></ol>", "\n1. a\n x\n3. b\n"),
        ("<table></table>", ""),
        ("<code>x</code><pre>a\nb</pre>", "`` \n```\n\n```\n"),
        ("<blockquote>a\n\nb</blockquote><hr>", "\n> a b\n \n---\n"),
        ("<b>a</b><i></i><u>c</u><s>d</s>", "**a** *(icon)* __c__ ~~d~~"),
        ("<div role=tab>T</div>", "T"),
        ("<h3>A<div role=tab>T</div></h3>", "\n### A T\n"),
    ],
)
def test_golden_pages(html, text):
    assert render(html, {"7": SHOWN}) == text


def test_view_and_failures(spark):
    p = "<p backend_node_id=7>a</p>"
    assert render(p, {"7": SHOWN}, view=(0, 0, 9, 9)) == "a" and render(p, {"7": SHOWN}, view=(6, 6, 9, 9)) == ""
    assert render(p, {"7": SHOWN | {"bounding_client_rect": {"x": None, "y": 0.0, "width": 1.0, "height": 1.0}}}, view=(0, 0, 9, 9)) == FAILED
    assert render("<p>call 555</p>", scrub=lambda t: t.replace("555", "[PHONE]")) == "call [PHONE]"
    df = spark.createDataFrame([(1, p, {"7": ("7", False, True)}), (2, None, None)], "obs_id long, raw_html string, metadata map<string, struct<backend_node_id string, is_visible boolean, is_frontmost boolean>>")
    assert {r.obs_id: r.markdown for r in markdown(df, metadata="metadata", visible=True).collect()} == {1: "", 2: FAILED}


def test_registry():
    before = list(SCHEMAS)
    inside = [(s, set(s.inside)) for s in SCHEMAS if s.inside is not None]
    try:
        register(Schema("badge", lambda page, n, d, parts, level: f"<{parts[0][1]}>", frozenset({"badge"})), 0, ("link",))
        assert SCHEMAS[0].name == "badge"
        assert render("<ul><li><badge>x</badge></ul>") == "\n* <x>\n" and render("<b><badge>x</badge></b>") == "**x**"
    finally:
        SCHEMAS[:] = before
        for s, x in inside:
            s.inside = x
