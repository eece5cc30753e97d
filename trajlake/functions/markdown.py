"""HTML to the markdown that agents read, one Arrow pass, on the standard library's parser.

A page becomes a small element tree; rendering walks it once with the set of node types that may appear at each place.
The types are a registry of schemas in order of priority, and an element takes the first that matches, may appear there
and is not hidden. An element without one is transparent: its children render in its place, however deep they stand.
Malformed pages: a paragraph, list item, cell, row or option closes an open one of its kind; stray end tags are ignored.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.functions.scalar import EMPTY_LABELS, MAX_LABEL

FAILED = "The page could not be rendered as text."
VOID = frozenset("area base br col embed hr img input source track wbr".split())
DROPPED = frozenset("script style link meta noscript template object applet".split())
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
#: Elements that end the reach of an implied end tag.
SCOPES = frozenset("ul ol table div section article main body nav aside footer header form select".split())
EMPTY = frozenset(EMPTY_LABELS)
#: Input types, those of them that are buttons, and the indent of one list level.
INPUT_TYPES = frozenset("button color date datetime-local email file hidden image month number password reset search submit tel text time url week".split())
BUTTON_TYPES = frozenset("button submit reset image".split())
INDENT = "    "


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []

    def texts(self) -> Iterator[str]:
        """All text below, in order."""
        todo = [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                yield n
            else:
                todo.extend(reversed(n.children))


class Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]
        self.dropped = 0
        self.by_id: dict[str, Node] = {}

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers are not needed."""
        return j

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in DROPPED:
            if tag not in ("link", "meta"):
                self.dropped += 1
            return
        if self.dropped:
            return
        closes = SELF_CLOSING.get(tag)
        if closes:
            last = None
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in closes:
                    last = i
                elif self.open[i].tag in SCOPES:
                    break
            if last is not None:
                del self.open[last:]
        node = Node(tag, {k: v if v is not None else "" for k, v in attrs})
        self.open[-1].children.append(node)
        if "id" in node.attrs:
            self.by_id.setdefault(node.attrs["id"], node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED:
            self.dropped = max(0, self.dropped - 1)
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if not self.dropped and data.strip():
            self.open[-1].children.append(data)


Part = tuple[str, str, "Node | None"]


@dataclass
class Schema:
    """A node type: what it matches, the types that may stand directly in it (None: any), and how it is drawn.

    ``attributes``: attribute → values that match it. ``metadata``: only elements the browser has measured match.
    """

    name: str
    draw: Callable[["Page", "Node", dict, list[Part], int], str]
    tags: frozenset[str] = frozenset()
    attributes: dict[str, frozenset[str]] | None = None
    inside: set[str] | None = None
    metadata: bool = False
    test: Callable[["Node"], bool] | None = None
    indent: int = 0

    def matches(self, n: "Node", d: dict | None) -> bool:
        hit = n.tag in self.tags or any(n.attrs.get(k) in v for k, v in (self.attributes or {}).items())
        return hit and (d is not None or not self.metadata) and (self.test is None or self.test(n))


SCHEMAS: list[Schema] = []


def register(schema: Schema, priority: int | None = None, behaves_like: tuple[str, ...] = ()) -> Schema:
    """Add a node type at ``priority`` (last without one). It may stand wherever a type it behaves like may."""
    for other in SCHEMAS:
        if other.inside is not None and any(x in other.inside for x in behaves_like):
            other.inside.add(schema.name)
    SCHEMAS.insert(len(SCHEMAS) if priority is None else priority, schema)
    _BY_TAG.clear()
    return schema


_BY_TAG: dict[tuple[str, frozenset[str]], list[Schema]] = {}
NO_NAMES: frozenset[str] = frozenset()


def candidates(n: "Node") -> list[Schema]:
    """Schemas that can match an element by its tag or the names of its attributes, in order; cached."""
    key = n.tag, frozenset(n.attrs) if n.attrs else NO_NAMES
    got = _BY_TAG.get(key)
    if got is None:
        if len(_BY_TAG) > 10_000:
            _BY_TAG.clear()
        got = _BY_TAG[key] = [s for s in SCHEMAS if n.tag in s.tags or not key[1].isdisjoint(s.attributes or ())]
    return got


def label(text: str | None) -> str:
    t = (text or "").strip()
    return "" if t in EMPTY else t if len(t) <= MAX_LABEL else t[:MAX_LABEL] + "..."


def joined(parts: list[str]) -> str:
    return " ".join(p for p in parts if p)


def inner(parts: list[Part]) -> str:
    return " ".join(t for _, t, _ in parts)


def no_newlines(text: str) -> str:
    return re.sub(r"\n+", " ", text).strip()


class Page:
    """Renders one page. ``metadata``: node id → what the browser measured there; ``view``: x0, y0, x1, y1 or None."""

    def __init__(self, tree: "Tree", metadata: dict | None, visible: bool, frontmost: bool, view: tuple | None) -> None:
        self.tree, self.meta, self.visible, self.frontmost, self.view = tree, metadata or {}, visible, frontmost, view

    def data(self, n: "Node") -> dict | None:
        i = n.attrs.get("backend_node_id")
        return self.meta.get(i) if i else None

    def hidden(self, d: dict | None) -> bool:
        if d is None:
            return False
        if (d.get("computed_style") or {}).get("display") != "contents" and ((self.visible and not d.get("is_visible")) or (self.frontmost and not d.get("is_frontmost"))):
            return True
        if self.view:
            r, (x0, y0, x1, y1) = d["bounding_client_rect"], self.view
            return not (r["x"] <= x1 and x0 <= r["x"] + r["width"] and r["y"] <= y1 and y0 <= r["y"] + r["height"])
        return False

    def expand(self, n: "Node", allowed: set[str] | None, level: int = 0) -> list[Part]:
        """(type, text, element) of what stands in ``n``. Text shows as the element before it does, or as that around it."""
        out, todo = [], [(n, iter(n.children), n)]
        while todo:
            around, rest, before = todo.pop()
            for c in rest:
                if isinstance(c, str):
                    if (allowed is None or "text" in allowed) and not self.hidden(self.data(before)):
                        out.append(("text", c.strip(), None))
                    continue
                before, d = c, self.data(c)
                fits = candidates(c)
                s = None if not fits or self.hidden(d) else next((s for s in fits if (allowed is None or s.name in allowed) and s.matches(c, d)), None)
                if s is None:
                    todo += [(around, rest, c), (c, iter(c.children), c)]
                    break
                out.append((s.name, s.draw(self, c, d or {}, self.expand(c, s.inside, level + s.indent), level), c))
        return out

    def label_of(self, n: "Node") -> str:
        """Text of the element that labels ``n``."""
        by = self.tree.by_id.get(n.attrs.get("aria-labelledby", ""))
        t = "".join(by.texts()) if by else ""
        return "" if t in EMPTY else t

    def titled(self, n: "Node", *names: str, default: str = "") -> str:
        return next((t for t in (label(n.attrs.get(a)) for a in names) if t), default)

    def widget(self, n: "Node", kind: str) -> str:
        return joined([self.titled(n, "name", "title", "aria-label", default=self.label_of(n)), kind])


def mark(d: dict) -> str:
    return f"[id: {d['backend_node_id']}]"


def draw_list(sign: str) -> Callable:
    def draw(page: Page, n: "Node", d: dict, parts: list[Part], level: int) -> str:
        lines = [f"{INDENT * level}{sign.format(i) if k == 'item' else ''} {t.strip()}" for i, (k, t, _) in enumerate(parts, 1)]
        return "\n" + "\n".join(lines) + "\n"

    return draw


def draw_table(page: Page, n: "Node", d: dict, parts: list[Part], level: int) -> str:
    if not parts:
        return ""
    rows = [t for _, t, _ in parts]
    width = max(len(r.split("|")) for r in rows)
    rows = [r + " | " * (width - len(r.split("|"))) for r in rows]
    return "\n" + "\n".join([rows[0], " --- ".join(["|"] * (width - 1)), *rows[1:]]) + "\n"


def draw_row(page: Page, n: "Node", d: dict, parts: list[Part], level: int) -> str:
    cells = []
    for _, t, c in parts:
        span = c.attrs.get("colspan", "1")
        cells.append(no_newlines(t) + " | " * (int(span) - 1 if span.isdecimal() and 1 < int(span) <= 1000 else 0))  # 1000: the limit of HTML itself
    return "| " + " | ".join(cells) + " |"


def draw_link(page: Page, n: "Node", d: dict, parts: list[Part], level: int) -> str:
    if not d:
        href = n.attrs.get("href")
        return f"[{inner(parts)}]({None if href is None else label(href)})"
    text = label(inner(parts)) or label(n.attrs.get("href")) or "#"
    return f"{mark(d)} {page.titled(n, 'title', 'aria-label', default=text)} {'dropdown' if 'aria-haspopup' in n.attrs else 'link'}"


def wrapped(sign: str, empty: str = "") -> Callable:
    return lambda page, n, d, parts, level: f"{sign}{inner(parts) or empty}{sign}"


def draw_button(page: Page, n: "Node", d: dict, parts: list[Part], level: int) -> str:
    kind = n.attrs.get("type")
    title = joined([page.titled(n, "name", "title", "aria-label", default=label(inner(parts))), kind if kind and kind != "button" else ""])
    return f"{mark(d)} {title or '#'} {n.attrs.get('role', 'button')}"


def draw_checkbox(page: Page, n: "Node", d: dict, parts: list[Part], level: int) -> str:
    # a bare attribute counts as set
    on = n.attrs.get("aria-checked") or (n.attrs.get("checked") or "checked" if "checked" in n.attrs else None) or d.get("editable_value")
    return f'{mark(d)} "{on}" ({page.widget(n, "checkbox")})'


def draw_input(page: Page, n: "Node", d: dict, parts: list[Part], level: int) -> str:
    kind = n.attrs.get("type")
    if n.tag == "button" or kind in BUTTON_TYPES:
        title = joined([page.titled(n, "name", "title", "aria-label", default=label(inner(parts))), kind if kind and kind != "button" else ""])
        return f"{mark(d)} {title or '#'} button"
    value = d.get("editable_value") or n.attrs.get("value") or n.attrs.get("placeholder") or ""
    return f'{mark(d)} "{value}" ({page.widget(n, kind or "text")} input)'


def draw_range(page: Page, n: "Node", d: dict, parts: list[Part], level: int) -> str:
    a = n.attrs
    ends = (("min", a.get("min") or a.get("aria-valuemin")), ("max", a.get("max") or a.get("aria-valuemax")), ("step", a.get("step") or a.get("aria-valuetext")))
    title = joined([page.widget(n, "range slider"), *[f"{k}: {v}" for k, v in ends if v is not None]])
    return f'{mark(d)} "{a.get("aria-valuetext")} ({d.get("editable_value") or a.get("aria-valuenow") or a.get("value")})" ({title})'


def draw_select(page: Page, n: "Node", d: dict, parts: list[Part], level: int) -> str:
    options, todo = [], list(reversed(n.children))
    while todo:
        c = todo.pop()
        if isinstance(c, Node):
            if c.tag == "option":
                options.append(label("".join(c.texts())))
            else:
                todo.extend(reversed(c.children))
    i = str(d.get("editable_value"))
    return f'{mark(d)} "{options[int(i)] if i.isdecimal() and int(i) < len(options) else ""}" ({page.widget(n, "select")} from: {", ".join(options)})'


def draw_textarea(page: Page, n: "Node", d: dict, parts: list[Part], level: int) -> str:
    content = n.attrs.get("aria-valuetext") or d.get("editable_value") or n.attrs.get("value") or n.attrs.get("placeholder") or ""
    return f'{mark(d)} """\n{content}\n""" ({page.widget(n, "textbox")})'


def draw_dropdown(page: Page, n: "Node", d: dict, parts: list[Part], level: int) -> str:
    title = page.widget(n, "dropdown")
    if len(parts) <= 1:
        return f'{mark(d)} "{label(inner(parts)) or "None selected"}" {title}'
    lines = [f"{INDENT * level}* {t.strip()}" for _, t, _ in parts]
    return f"{mark(d)} {title}\n" + "\n".join(lines) + "\n"


def draw_form(page: Page, n: "Node", d: dict, parts: list[Part], level: int) -> str:
    title = joined(["##", page.titled(n, "name", "title", "aria-label", "role", "action"), "form"])
    return f"\n{title.title()}\n" + "\n".join(t for _, t, _ in parts)


def draw_image(page: Page, n: "Node", d: dict, parts: list[Part], level: int) -> str:
    return joined([page.titled(n, "alt", "name", "title", "aria-label", "src"), "image"])


def draw_heading(page: Page, n: "Node", d: dict, parts: list[Part], level: int) -> str:
    return f"\n{'#' * (int(n.tag[1]) if re.fullmatch('h[1-6]', n.tag) else 1)} {inner(parts)}\n"


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


def _register_all() -> None:
    """The node types. Tags, roles, types, priorities, and what may stand in what."""
    inline = _words("text bold italic underline strike inline_code")
    lists = _words("list menu menubar radiogroup tablist tree")

    def add(name: str, draw: Callable, tags: str = "", roles: str | frozenset = "", inside: frozenset | None = inline, **more: object) -> None:
        roles = _words(roles) if isinstance(roles, str) else roles
        register(Schema(name, draw, _words(tags), {"role": roles} if roles else None, None if inside is None else set(inside), **more))

    add("ordered", draw_list("{}."), "ol", lists, inline | {"item", "link", "image"}, indent=1)
    add("unordered", draw_list("*"), "ul", lists, inline | {"item", "link", "image"}, indent=1)
    add("item", lambda page, n, d, parts, level: inner(parts), "li", "listitem menuitem radio tab treeitem", inline | {"link", "image", "heading", "ordered", "unordered"})
    add("table", draw_table, "table", "table grid treegrid", frozenset({"row"}))
    add("row", draw_row, "tr", "row", frozenset({"cell"}))
    add("cell", lambda page, n, d, parts, level: no_newlines(inner(parts)), "th td", "rowheader gridcell columnheader", inline | {"link", "image", "heading", "ordered", "unordered"})
    add("heading", draw_heading, "h1 h2 h3 h4 h5 h6", "heading tab", inline | {"image"})
    add("link", draw_link, "a")
    add("bold", wrapped("**"), "b strong")
    add("italic", wrapped("*", "(icon)"), "i em")
    add("underline", wrapped("__"), "u")
    add("strike", wrapped("~~"), "s strike del")
    add("inline_code", lambda page, n, d, parts, level: f"`{inner(parts)}`", "code pre", inside=frozenset(), test=lambda n: "\n" not in "".join(n.texts()))
    add("fenced_code", lambda page, n, d, parts, level: f"\n```\n{inner(parts)}\n```\n", "code pre", inside=frozenset(), test=lambda n: "\n" in "".join(n.texts()))
    add("quote", lambda page, n, d, parts, level: f"\n> {no_newlines(inner(parts))}\n", "blockquote")
    add("rule", lambda page, n, d, parts, level: "\n---\n", "hr", inside=frozenset())

    def widget(name: str, draw: Callable, priority: int, tags: str = "", metadata: bool = True, **attributes: str | frozenset) -> None:
        values = {k: _words(v) if isinstance(v, str) else v for k, v in attributes.items()}
        register(Schema(name, draw, _words(tags), values, None, metadata), priority, ("link",))

    # later ones of one priority come before earlier ones
    widget("dropdown", draw_dropdown, 0, role="listbox combobox")
    widget("input", draw_input, 0, role="input textfield", type=INPUT_TYPES)
    widget("button", draw_button, 0, "button", role="button option")
    widget("checkbox", draw_checkbox, 0, role="checkbox", type="checkbox radio")
    widget("form", draw_form, 0, "form", metadata=False)
    register(Schema("image", draw_image, _words("img"), None, set()), 0, ("image",))
    register(Schema("link", draw_link, _words("a"), None, None, True), 0)
    widget("range", draw_range, 0, role="slider spinbutton", type="range")
    widget("select", draw_select, 0, "select")
    widget("textarea", draw_textarea, 0, "textarea", role="textbox", contenteditable="true")


_register_all()


def render(html: str | None, metadata: dict | None = None, visible: bool = False, frontmost: bool = False, view: tuple | None = None, scrub: Callable[[str], str] | None = None) -> str:
    """Markdown of a page; a page that is blank, unreadable or has unusable metadata gives a fixed message.

    ``visible``, ``frontmost``, ``view``: leave out what the metadata show to be hidden, covered or out of view;
    ``scrub``: applied to the finished text, for personal information.
    """
    if not html or not html.strip():
        return FAILED
    limit = sys.getrecursionlimit()
    try:
        sys.setrecursionlimit(max(limit, 200_000))  # nested lists recurse; a page may nest them deeper than the interpreter's default
        tree = Tree()
        tree.feed(html)
        tree.close()
        text = " ".join(t for _, t, _ in Page(tree, metadata, visible, frontmost, view).expand(tree.root, None))
    except Exception:  # as any failure of one page: data, not an error of the job
        return FAILED
    finally:
        sys.setrecursionlimit(limit)
    return scrub(text) if scrub and text != FAILED else text


def markdown(
    pages: DataFrame, key: str = "obs_id", html: str = "raw_html", metadata: str | None = None, visible: bool = False, frontmost: bool = False,
    view: tuple[float, float, float, float] | None = None, scrub: Callable[[str], str] | None = None,
) -> DataFrame:
    """(key, markdown) of every row of ``pages``; null HTML gives the fixed message. Options as in :func:`render`.

    Metadata travel only with pages whose elements carry ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            metas = [dict(m) if m else None for m in b.column(2).to_pylist()]
            for m in metas:
                for v in (m or {}).values():
                    if v and v.get("computed_style"):
                        v["computed_style"] = dict(v["computed_style"])
            texts = [render(h, m, visible, frontmost, view, scrub) for h, m in zip(b.column(1).to_pylist(), metas)]
            yield pa.record_batch({key: b.column(0), "markdown": pa.array(texts, pa.string())})

    none: Column = F.lit(None).cast("map<string,int>")
    known = none if metadata is None else F.when(F.col(html).contains("backend_node_id"), F.col(metadata))
    return pages.select(key, html, known.alias("metadata")).mapInArrow(run, f"{key} {dict(pages.dtypes)[key]}, markdown string")
