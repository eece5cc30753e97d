from trajlake.functions import parse
from trajlake.functions.markdown import FAILED, render


def test_judgment_strictness():
    assert parse.judgment('{"success": 1, "efficiency": 0.5, "self_correction": true}') == (1.0, 0.5, 1.0)
    for bad in (None, "", "[]", '{"success": "0.9", "efficiency": 1, "self_correction": 0}', '{"success": 1, "efficiency": 1}', '{"success": 1, "efficiency": 1, "self_correction": 0} tail'):
        assert parse.judgment(bad) is None


def test_actions():
    assert parse.calls('{"action_key": "click", "action_kwargs": {}, "target_element_id": 4}') == [("page.locator", "\"[backend_node_id='4']\""), ("click", "{ force: true }")]
    assert parse.calls('{"action_key": "click", "action_kwargs": {"x": 1, "y": 2}, "target_element_id": null}') == [("page.mouse.click", "1,2")]
    assert parse.calls('{"action_key": "click", "action_kwargs": {}, "target_element_id": null}') is None
    assert parse.calls('{"action_key": "dance", "action_kwargs": {}, "target_element_id": 3}') is None
    assert parse.calls('{"action_key": "scroll", "action_kwargs": {}, "target_element_id": null}') == [("page.mouse.wheel", "0,0")]
    assert parse.calls('{"action_key": "click", "target_element_id": 3}') is None
    assert parse.calls('{"action_key": "fill", "action_kwargs": {}, "target_element_id": 3}')[1] == ("fill", "'None'")
    assert parse.calls('{"action_key": "stop", "action_kwargs": {}}') == [("stop", "None")]
    assert parse.calls('{"action_key": "set_checked", "action_kwargs": {}, "target_element_id": 3}')[1] == ("setChecked", "false")
    assert parse.calls('{"action_key": "hover", "target_element_id": 3}')[1] == ("hover", "")


def test_proposals():
    assert parse.proposal('{"proposed_task": "a", "steps": ["b"], "criteria": ["c"]}') == ("a", ["b"], ["c"])
    assert parse.proposal('{"proposed_task": "a", "steps": [], "criteria": ["c"]}') is None


def test_markdown():
    assert render(None) == FAILED and render("  ") == FAILED
    assert render("<h2>A <a href='x'>b</a></h2>").strip() == "## A b"
    assert render("<ul><li>a<li>b</ul>").strip() == "* a\n* b"
    assert render("<ul role='list'><li>a</ul>").strip() == "1. a"
    assert render("<a href='/u'>t</a><script>x</script>") == "[t](/u)"
    assert render("<table><tr><td>a<td>b<tr><td>c</table>") == "\n| a | b |\n| --- | --- |\n| c | | \n"
    assert render("<p><b>x<i></i></b></p>") == "**x *(icon)***"
    meta = {"7": {"backend_node_id": "7", "is_visible": True, "is_frontmost": True, "computed_style": {}}}
    assert render("<a backend_node_id='7' title='Go'>t</a>", meta) == "[id: 7] Go link"
    hidden = {"7": {"backend_node_id": "7", "is_visible": False, "is_frontmost": True, "computed_style": {}}}
    assert render("<button backend_node_id='7'><b>t</b></button>", hidden, visible=True) == "**t**"
    assert render("<div>" * 5000 + "x") == "x"
    assert "deep" in render("<ul><li>" * 1500 + "deep")
