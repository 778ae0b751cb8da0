"""Layout-aware text of HTML pages.

A tokenizer (linear in the page) feeds a tree builder that knows void elements, raw-text elements
and implied end tags (a paragraph ends at a block, an item at the next item, cells and rows at the
next cell, row or section). The renderer walks the tree with visibility rules and emits all visible
text: inline text with white space collapsed, a line per block, a blank line around paragraphs,
headings, lists and tables, list items with markers and indents, table cells aligned in columns,
``pre`` as written. Nothing visible is left out as boilerplate: navigation and footers stay.

Invisible: script, style, template, head, metadata and embedded media; elements with ``hidden``,
``display:none``, ``visibility:hidden`` (a descendant may be visible again) or
``type=hidden``; a ``dialog`` without ``open``; of ``details`` without ``open``, all but the summary; the
brackets of ruby (``rp``); annotations of formulas; titles, descriptions and
definitions of drawings. Scripts do not run, so ``noscript`` shows. Formulas and the text of drawings show.

Defined cases: null or empty html gives the empty text; a tag that never closes, or a quoted value in
it (quotes open values only after ``=``), ends the page, as in browsers; repeated rows are rendered one by one; an empty table gives an empty result.

Scale: narrow, one page at a time in Arrow batches. Both passes use explicit stacks, and the open
elements of each tag are known by their places, so nesting depth is no limit and a tag costs the same at
any depth. Indents beyond ``MAX_INDENT`` columns do not grow further, so deep lists stay linear too.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("script style template head title meta link base iframe object embed audio video canvas datalist noembed noframes map param source track rp".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr menu dir".split())
BLOCK = PARAGRAPH | frozenset("html body div section article aside nav header footer main address form li dt dd tr thead tbody tfoot caption figcaption details summary legend option optgroup center hgroup search dialog noscript xmp text foreignobject mtr".split())
#: A start tag (key) ends open elements (first set) up to a boundary (second set).
LIST_EDGE, TABLE_EDGE = frozenset("ul ol menu dir table td th".split()), frozenset(["table"])
ENDS = {"li": (frozenset(["li"]), LIST_EDGE), "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
        "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])), "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
        "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
        "td": (frozenset(["td", "th"]), TABLE_EDGE | {"tr"}), "th": (frozenset(["td", "th"]), TABLE_EDGE | {"tr"}),
        "tr": (frozenset(["tr", "td", "th", "caption"]), TABLE_EDGE)}
for _t in ("thead", "tbody", "tfoot"):
    ENDS[_t] = (frozenset("thead tbody tfoot tr td th caption".split()), TABLE_EDGE)
NO_P = (BLOCK - frozenset("html body li dt dd tr thead tbody tfoot caption option optgroup legend noscript text foreignobject mtr".split()))
P_EDGE = frozenset("td th caption table button object li dd dt".split())
END_EDGE = frozenset(["td", "th", "caption"])
#: End tags that reach beyond a cell.
ANY_EDGE = frozenset("table tr thead tbody tfoot body html".split())

#: Parts of formulas and drawings that do not show, those in which html goes on, and the tags that end both.
FOREIGN = frozenset(["svg", "math"])
FOREIGN_HIDDEN = frozenset("annotation annotation-xml desc defs metadata symbol clippath mask pattern marker".split())
HTML_INSIDE = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())

_TAG = re.compile(r"""(/?)([a-zA-Z][^ \t\n\r\f/>]*+)((?:[ \t\n\r\f/]++|[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:"[^"]*+"|'[^']*+'|[^ \t\n\r\f>"'][^ \t\n\r\f>]*+|(?=>))|(?![ \t\n\r\f]*+=)))*+)>""")
_ATTR = re.compile(r"""([^ \t\n\r\f/>][^ \t\n\r\f/>=]*+)(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:"([^"]*+)"|'([^']*+)'|([^ \t\n\r\f>"'][^ \t\n\r\f>]*+)|\Z))?""")
_RAW_END = {t: re.compile(rf"</{t}(?=[ \t\n\r\f/>])", re.I | re.A) for t in RAW}
_SPACE = re.compile(r"[ \t\n\r\f\v\xa0]+")
_HIDE = re.compile(r"display\s*:\s*none", re.I)
_VIS = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)


#: Columns of indent that are written at most.
MAX_INDENT = 60


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.kids = tag, attrs or {}, []


def build(page: str) -> Node:
    """The element tree of a page; text is a str child."""
    root = Node("#root")
    stack, at = [root], {}  # open elements, and for each tag the places of its own, ascending
    foreign = [False]  # of each open element: whether it is part of a formula or drawing

    def push(node):
        stack[-1].kids.append(node)
        stack.append(node)
        foreign.append(node.tag in FOREIGN or foreign[-1] and node.tag not in HTML_INSIDE)
        at.setdefault(node.tag, []).append(len(stack) - 1)

    def pop_to(i):
        for x in stack[i:]:
            at[x.tag].pop()
        del stack[i:], foreign[i:]

    def last(tags):
        """The place of the innermost open element of ``tags``; 0 if there is none."""
        return max((at[t][-1] for t in tags if at.get(t)), default=0)

    def write(text):
        if at.get("head") and stack[-1].tag in ("head", "noscript") and text.strip(" \t\n\r\f"):
            close(frozenset(["head"]), frozenset())
        stack[-1].kids.append(text)

    def close(tags, edge):
        """End the outermost open element of ``tags`` inside the nearest ``edge``."""
        if not any(at.get(t) for t in tags):
            return
        inside = last(edge - tags)
        found = [at[t][k] for t in tags if at.get(t) and (k := bisect_right(at[t], inside)) < len(at[t])]
        if found:
            pop_to(min(found))

    i, n = 0, len(page)
    while i < n:
        j = page.find("<", i)
        if j < 0:
            write(html.unescape(page[i:]))
            break
        if j > i:
            write(html.unescape(page[i:j]))
        nxt = page[j + 1:j + 2]
        if nxt in ("!", "?"):
            comment = page.startswith("<!--", j)
            k = page.find("-->" if comment else ">", j + 2)
            i = n if k < 0 else k + (3 if comment else 1)
            continue
        if not (nxt.isascii() and nxt.isalpha()) and not (nxt == "/" and page[j + 2:j + 3].isascii() and page[j + 2:j + 3].isalpha()):
            if nxt == "/":
                k = page.find(">", j)
                i = n if k < 0 else k + 1
            else:
                write("<")
                i = j + 1
            continue
        m = _TAG.match(page, j + 1)
        if m is None:
            break
        i, tag = m.end(), m[2].lower()
        if m[1]:
            if at.get(tag):
                if tag in ANY_EDGE or at[tag][-1] > last(END_EDGE - {tag}):
                    pop_to(at[tag][-1])
            elif tag == "br":
                stack[-1].kids.append(Node("br"))
            continue
        attrs, stop = {}, 0
        for a in _ATTR.finditer(m[3]):
            attrs.setdefault(a[1].lower(), html.unescape(a[2] or a[3] or a[4] or ""))
            stop = a.end()
        if foreign[-1] and (tag in BREAKOUT or tag == "font" and attrs.keys() & {"color", "face", "size"}):
            k = len(stack) - 1
            while foreign[k - 1]:
                k -= 1
            pop_to(k)
        if foreign[-1] or tag in FOREIGN:
            attrs["style"] = "".join(f"{k}:{attrs[k]};" for k in ("display", "visibility") if k in attrs) + attrs.get("style", "")
            if tag in FOREIGN_HIDDEN:
                attrs["hidden"] = ""
            if m[3].endswith("/") and stop < len(m[3]):
                stack[-1].kids.append(Node(tag, attrs))
                continue
            if foreign[-1] and tag not in RAW:
                push(Node(tag, attrs))
                continue
        if tag in ("html", "body") and at.get(tag):
            continue
        if tag != "head" and at.get("head") and tag not in ("meta", "link", "base", "title", "style", "script", "template", "noscript"):
            close(frozenset(["head"]), frozenset())
        if tag in NO_P:
            close(frozenset(["p"]), P_EDGE)
        if tag in ENDS:
            close(*ENDS[tag])
        if tag in VOID:
            stack[-1].kids.append(Node(tag, attrs))
            continue
        push(Node(tag, attrs))
        if tag in RAW:
            end = _RAW_END[tag].search(page, i)
            raw = page[i:end.start()] if end else page[i:]
            stack[-1].kids.append(html.unescape(raw) if tag in ("textarea", "title") else raw)
            pop_to(len(stack) - 1)
            m = end and _TAG.match(page, end.start() + 1)
            i = m.end() if m else n
    return root


class _Out:
    """Lines under construction: of the page, or of one table cell."""

    def __init__(self):
        self.lines, self.cur, self.space, self.blank, self.indent, self.marker = [], [], False, False, 0, ""

    def text(self, s: str) -> None:
        parts = _SPACE.sub(" ", s)
        if not parts.strip():
            self.space = self.space or bool(parts)
            return
        if (self.space or parts[0] == " ") and self.cur:
            self.cur.append(" ")
        self.cur.append(parts.strip())
        self.space = parts[-1] == " "

    def newline(self, force: bool = False) -> None:
        if self.cur or force:
            self.emit("".join(self.cur))
        self.cur, self.space = [], False

    def emit(self, line: str) -> None:
        if self.blank and self.lines and self.lines[-1]:
            self.lines.append("")
        self.blank = False
        lead = " " * min(self.indent, MAX_INDENT)
        if self.marker and line:
            lead = lead[:max(0, len(lead) - len(self.marker))] + self.marker
            self.marker = ""
        self.lines.append((lead + line).rstrip() if line else "")

    def gap(self) -> None:
        self.newline()
        self.blank = True


def _columns(rows: list[list[tuple[str, int]]]) -> list[str]:
    """Table rows (cell text, columns it spans) as aligned lines."""
    width: dict[int, int] = {}
    for row in rows:
        c = 0
        for text, span in row:
            if span == 1:
                width[c] = max(width.get(c, 0), len(text))
            c += span
    lines = []
    for row in rows:
        c, cells = 0, []
        for text, span in row:
            cells.append(text.ljust(width.get(c, 0) if span == 1 else 0))
            cells += [" " * width.get(k, 0) for k in range(c + 1, c + span)] if span > 1 and not text else []
            c += span
        lines.append(" | ".join(cells).rstrip())
    return lines


def _visibility(node: Node, shown: bool) -> tuple[bool, bool]:
    """(rendered at all, text visible)"""
    a = node.attrs
    if node.tag in HIDDEN or "hidden" in a or node.tag == "dialog" and "open" not in a or node.tag == "input":
        return False, False
    style = a.get("style", "")
    if style:
        if _HIDE.search(style):
            return False, False
        if v := _VIS.search(style):
            shown = v[1].lower() == "visible"
    return True, shown


def render(page: str | None) -> str:
    """The visible text of a page, laid out."""
    if not page:
        return ""
    outs, lists, tables, pre = [_Out()], [], [], 0
    todo: list = [(build(page), True, False)]
    while todo:
        node, shown, leaving = todo.pop()
        out = outs[-1]
        if isinstance(node, str):
            if not shown or (tables and tables[-1]["cell"] == len(outs) - 2 and tables[-1]["open"] == 0 and not node.strip()):
                continue
            if pre:
                head, *rest = node.replace("\r\n", "\n").split("\n")
                out.cur.append(head)
                for x in rest:
                    out.newline(True)
                    out.cur.append(x)
            else:
                out.text(node)
            continue
        tag = node.tag
        if leaving:
            if tag == "mtd":
                out.text(" ")
            if tag in ("td", "th") and tables and tables[-1]["open"]:
                out.newline()
                outs.pop()
                t = tables[-1]
                t["open"] -= 1
                span = node.attrs.get("colspan", "1")
                span = min(int(span), 1000) if span.isascii() and span.isdigit() and int(span[:5]) > 0 else 1
                if not t["rows"]:
                    t["rows"].append([])
                t["rows"][-1].append((" ".join(x.strip() for x in out.lines if x.strip()), span))
                continue
            if tag == "table":
                t = tables.pop()
                for line in _columns([r for r in t["rows"] if any(x for x, _ in r)]):
                    out.newline()
                    out.emit(line)
                out.gap()
                continue
            if tag in ("ul", "ol", "menu", "dir"):
                out.newline()
                lists.pop()
                out.indent -= 2 if tag != "ol" else 3
                out.gap() if not lists else None
            elif tag == "li":
                out.newline()
                out.marker = ""
            elif tag in ("blockquote", "dd"):
                out.newline()
                out.indent -= 2
                out.gap() if tag == "blockquote" else None
            elif tag == "pre":
                pre -= 1
                out.gap()
            elif tag in PARAGRAPH:
                out.gap()
            elif tag in BLOCK:
                out.newline()
            continue
        if tag != "#root":
            there, shown = _visibility(node, shown)
            if not there:
                continue
        if tag == "br":
            out.newline(True)
            continue
        if tag in VOID:
            out.gap() if tag == "hr" else None
            continue
        if tag == "table":
            out.gap()
            tables.append({"rows": [], "open": 0, "cell": len(outs) - 2})
        elif tag == "tr" and tables and not tables[-1]["open"]:
            tables[-1]["rows"].append([])
        elif tag in ("td", "th") and tables and not tables[-1]["open"]:
            tables[-1]["open"] += 1
            outs.append(_Out())
        elif tag in ("td", "th"):
            out.newline()
        elif tag in ("ul", "ol", "menu", "dir"):
            out.newline() if lists else out.gap()
            start = node.attrs.get("start", "1")
            lists.append([tag, int(start[:9]) if re.fullmatch(r"-?[0-9]+", start) else 1])
            out.indent += 2 if tag != "ol" else 3
        elif tag == "li":
            out.newline()
            if lists and lists[-1][0] == "ol":
                out.marker, lists[-1][1] = f"{lists[-1][1]}. ", lists[-1][1] + 1
            else:
                out.marker = "- "
        elif tag in ("blockquote", "dd"):
            out.gap() if tag == "blockquote" else out.newline()
            out.indent += 2
        elif tag == "pre":
            out.gap()
            pre += 1
        elif tag in PARAGRAPH:
            out.newline() if tag == "p" and out.marker else out.gap()
        elif tag in BLOCK:
            out.newline()
        todo.append((node, shown, True))
        kids = node.kids
        if tag == "details" and "open" not in node.attrs:
            kids = [x for x in kids if not isinstance(x, str) and x.tag == "summary"][:1]
        for kid in reversed(kids):
            todo.append((kid, shown, False))
            if tag == "mfrac":
                todo.append((" ", shown, False))
    outs[0].newline()
    lines, text = outs[0].lines, []
    for x in lines:
        if x or (text and text[-1]):
            text.append(x)
    return "\n".join(text).strip("\n")


def _batches(batches):
    for b in slices(batches, "html"):
        texts = [render(x) for x in b.column("html").to_pylist()]
        yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                               pa.array([len(x) for x in texts], pa.int64()),
                               pa.array([sum(1 for y in x.split("\n") if y) for x in texts], pa.int64())],
                              names=["page_id", "url", "text", "n_chars", "n_lines"])


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, text, n_chars, n_lines (lines with text): one row per row of ``pages``."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(_batches, "page_id long, url string, text string, n_chars long, n_lines long")
