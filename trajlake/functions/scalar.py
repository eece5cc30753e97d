"""Column functions on tasks, actions and scores; all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_WEBSITE = "duckduckgo.com"

#: Labels that count as empty.
EMPTY_LABELS = ("", "#", "##", "**", "__", "~~", "``", "''", '""', "[]", "{}", "()", "<>", "****", "____", "~~~~")
MAX_LABEL = 64


def first_present(*values: Column, default: str) -> Column:
    """First value that is not null, else ``default``."""
    return F.coalesce(*values, F.lit(default))


def with_scheme(url: Column, scheme: str = "http://") -> Column:
    """``url`` with a scheme unless it starts with http:// or https:// (case-sensitive, nothing trimmed)."""
    return F.when(url.startswith("http://") | url.startswith("https://"), url).otherwise(F.concat(F.lit(scheme), url))


def numbered(items: Column) -> Column:
    """``1. a\\n2. b`` of an array of strings; empty for an empty or null array."""
    lines = F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return F.coalesce(F.array_join(lines, "\n"), F.lit(""))


#: What stands before the steps and before the criteria, by who reads the instruction.
ROLES = {
    "agent": ("\n\nTo complete the task, let's follow these steps:\n", "\n\nTo complete the task, we must satisfy these criteria:\n"),
    "judge": ("\n\nThe agent must follow these steps:\n", "\n\nThe agent must satisfy these criteria:\n"),
    "proposer": ("\n\nThe agent must follow these steps:\n", "\n\nThe agent must satisfy these criteria:\n"),
}


def decorated(instruction: Column, steps: Column, criteria: Column, role: str = "agent") -> Column:
    """The instruction with its steps, then its criteria, each only where the list has members, in the wording of ``role``."""
    before_steps, before_criteria = ROLES[role]
    size = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>")))
    with_steps = F.when(size(steps) > 0, F.concat(instruction, F.lit(before_steps), numbered(steps))).otherwise(instruction)
    return F.when(size(criteria) > 0, F.concat(with_steps, F.lit(before_criteria), numbered(criteria))).otherwise(with_steps)


#: What is kept of a node's metadata.
METADATA_KEYS = ("backend_node_id", "bounding_client_rect", "computed_style", "scroll_left", "scroll_top", "editable_value", "is_visible", "is_frontmost")


def kept_metadata(metadata: str) -> Column:
    """The metadata map with the kept keys of each node alone, and of its style only the display."""

    def node(_: Column, v: Column) -> Column:
        display = F.map_filter(v["computed_style"], lambda k, _: k == "display")
        return F.struct(*[(display if k == "computed_style" else v[k]).alias(k) for k in METADATA_KEYS])

    return F.transform_values(metadata, node)


def session_name(key: Column, first: list[str], second: list[str]) -> Column:
    """A readable name of a session, one of ``first`` and one of ``second`` by the hash of ``key``; no product is built."""
    h = F.xxhash64(key)
    pick = lambda words, n: F.get(F.array(*map(F.lit, words)), F.pmod(n, F.lit(len(words))).cast("int"))
    return F.concat_ws("-", pick(first, h), pick(second, F.shiftrightunsigned(h, 32)))


def first_filled(a: Column, b: Column, default: str) -> Column:
    """First of ``a`` and ``b`` that is neither null nor empty, else ``default``."""
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")), F.lit(default))


def passes(score: Column, threshold: float, nulls: str = "fail") -> Column:
    """Threshold test; ``nulls``: fail (null never passes, 0 lets any score pass), zero (null counts as 0) or drop
    (the test is null, so the caller's filter drops the row). 1 asks for equality, all else for more than the threshold.
    """
    if nulls == "fail":
        return F.coalesce(score.isNotNull() if threshold == 0 else (score == 1.0) if threshold == 1 else score > threshold, F.lit(False))
    x = F.coalesce(score, F.lit(0.0)) if nulls == "zero" else score
    return (x == 1.0) if threshold == 1 else (x > threshold)


def in_unit_range(*scores: Column) -> Column:
    """All scores present and between 0 and 1."""
    ok = F.lit(True)
    for s in scores:
        ok = ok & F.coalesce(s.between(0.0, 1.0), F.lit(False))
    return ok


def longer_than(length: Column, threshold: int) -> Column:
    """Threshold 0 lets any present value pass; null fails."""
    return F.coalesce(length.isNotNull() if threshold == 0 else length > threshold, F.lit(False))


def call_chain(calls: Column) -> Column:
    """``dotpath(args).dotpath(args)`` of an array of calls."""
    return F.array_join(F.transform(calls, lambda c: F.concat(F.coalesce(c["dotpath"], F.lit("")), F.lit("("), F.coalesce(c["args"], F.lit("")), F.lit(")"))), ".")


def squeezed(text: Column) -> Column:
    """Action text for display: runs of four spaces go, line ends and tabs become one space each."""
    return F.regexp_replace(F.replace(text, F.lit("    "), F.lit("")), r"[\n\r\t]", " ")


def clean_label(text: Column) -> Column:
    """Trimmed label; left-over mark-up gives an empty label, long ones are cut to 64 characters and an ellipsis; null stays."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(t.isin(*EMPTY_LABELS), F.lit("")).when(F.length(t) > MAX_LABEL, F.concat(F.substring(t, 1, MAX_LABEL), F.lit("..."))).otherwise(t)


def one_line(text: Column) -> Column:
    """Runs of line ends become one space, outer white space goes."""
    return F.regexp_replace(F.regexp_replace(text, "\n+", " "), r"^\s+|\s+$", "")


def overlaps(x: Column, y: Column, w: Column, h: Column, view: tuple[float, float, float, float]) -> Column:
    """Closed rectangles meet, touching edges included."""
    vx0, vy0, vx1, vy1 = view
    return (x <= vx1) & (x + w >= vx0) & (y <= vy1) & (y + h >= vy0)


def shown(display: Column, visible: Column, frontmost: Column, need_visible: bool = True, need_frontmost: bool = True) -> Column:
    """``display: contents``, or as visible and frontmost as needed."""
    ok = F.lit(True)
    if need_visible:
        ok = ok & F.coalesce(visible, F.lit(False))
    if need_frontmost:
        ok = ok & F.coalesce(frontmost, F.lit(False))
    return F.coalesce(display == "contents", F.lit(False)) | ok


def fenced_json(text: Column) -> Column:
    """The text between the first opening and the last closing JSON fence; null without one."""
    return F.nullif(F.regexp_extract(text, r"(?s)```json\n(.*)\n```", 1), F.lit(""))


def reward(ok: Column, gold: Column) -> Column:
    """0 for an action that cannot be read; else 0.1, and 0.3 for each of key, target and arguments equal to ``gold``'s, as JSON text."""
    parts = [F.coalesce(F.col(k) == gold[k], F.lit(False)).cast("double") * 0.3 for k in ("action_key", "target_element_id", "action_kwargs")]
    return F.when(ok, F.round(F.lit(0.1) + parts[0] + parts[1] + parts[2], 6)).otherwise(0.0)


def fence(text: Column, kind: str = "json") -> Column:
    """Bare action text as the fence that :func:`fenced_json` reads."""
    return F.concat(F.lit(f"Here is the action:\n\n```{kind}\n"), text, F.lit("\n```"))


def seeded_order(seed: int, key: Column) -> Column:
    """Sort key of a shuffle that any engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string")))
