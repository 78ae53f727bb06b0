"""HTML page -> its elements, the one step that needs Python.

A page stays one row: its elements come back as an array in document order,
so everything after this is array expressions and no shuffle is needed to put
a page together again.  Which selectors an element fits is decided here, where
its parents are at hand; an element carries their numbers, never the parents'
tags, so the output is linear in the page.  Texts are offsets into the page
text, which is stored once with white space collapsed; an element that fits a
selector and holds no other such element has its text with it.  Of selectors
that are looked for below other elements, an element carries the place of the
first match below it, so nobody has to walk over what it holds.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hiretide.functions import entities
from hiretide.sources import selectors as css

# The parser travels with the job, so executors need no copy of this package.
for _module in (sys.modules[__name__], entities, css):
    cloudpickle.register_pickle_by_value(_module)

ELEMENT = "struct<tag: string, hits: array<int>, at: int, parent: int, n_below: int, href: string, text: string, t0: int, t1: int>"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo cite code em font i kbd mark q s small span strong sub sup time u var".split())
_RAW = frozenset(("script", "style", "title", "textarea"))
_CLOSES_SAME = frozenset("li p tr td th dt dd option".split())
_ROWS_PER_BATCH = 64


# Comments, declarations, then tags with their attributes.
_MARKUP = re.compile(
    r"""<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S
)
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTR.findall(raw):
        value = double or single or bare
        if "&" in value:
            value = entities.unescape_text(value)
        found.setdefault(name.lower(), " ".join(value.split()))
    return found


def parse_page(html: str, selectors: list[list[css.Path]], tree: bool) -> tuple[str, list[dict]]:
    """Page text and its elements; only those that fit a selector unless ``tree``."""
    html = html or ""
    rows: list[dict] = []
    stack: list[dict] = []
    last_child: dict[int, dict] = {}
    text: list[str] = []
    length = 0

    def space() -> None:
        nonlocal length
        if text and text[-1] != " ":
            text.append(" ")
            length += 1

    def add(data: str) -> None:
        nonlocal length
        words = " ".join(data.split())
        if data[0].isspace():
            space()
        if words:
            text.append(words)
            length += len(words)
            if data[-1].isspace():
                space()

    def close(depth: int) -> None:
        while len(stack) > depth:
            row = stack.pop()
            row["t1"], row["n_below"] = length, len(rows) - row["at"] - 1

    at = 0
    while at < len(html):
        m = _MARKUP.search(html, at)
        data = html[at:m.start()] if m else html[at:]
        if data:
            add(entities.unescape_text(data))
        if m is None:
            break
        at = m.end()
        closing, name, raw = m.groups()
        if name is None:
            continue
        tag = name.lower()
        if tag not in _INLINE:
            space()
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth]["tag"] == tag:
                    close(depth)
                    break
            continue
        if tag in _CLOSES_SAME:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth]["tag"] == tag:
                    close(depth)
                    break
                if stack[depth]["tag"] not in _INLINE:
                    break
        up = stack[-1] if stack else None
        parent = up["at"] if up else -1
        before = last_child.get(parent)
        attrs = _attributes(raw) if raw else {}
        row = {
            "at": len(rows), "tag": tag, "attrs": attrs, "parent": parent, "up": up, "n_below": 0,
            "href": attrs.get("href"), "nth": before["nth"] + 1 if before else 1, "t0": length, "t1": length,
        }
        last_child[parent] = row
        rows.append(row)
        if tag in _RAW:
            # its content is neither text nor markup
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif tag not in _VOID:
            stack.append(row)
    close(0)

    page_text = "".join(text)
    edge = {row["at"] for row in last_child.values()}
    by_tag: dict[str, list[tuple[int, css.Path]]] = {}
    for number, options in enumerate(selectors):
        for path in options:
            by_tag.setdefault(path.steps[-1].tag, []).append((number, path))
    for row in rows:
        row["last"] = row["at"] in edge
        row["classes"] = frozenset(row["attrs"].get("class", "").split())
        tries = [*by_tag.get(row["tag"], ()), *by_tag.get("", ())]
        row["hits"] = sorted({number for number, path in tries if path.fits(row)})
    holds = set()  # elements with another hit below
    for row in rows:
        up = row["up"]
        while row["hits"] and up is not None and up["at"] not in holds:
            holds.add(up["at"])
            up = up["up"]
    for row in rows:
        short = row["hits"] and row["at"] not in holds
        row["text"] = page_text[row["t0"]:row["t1"]].strip() if short else None
    return page_text, rows if tree else [row for row in rows if row["hits"]]


_FIELDS = ("tag", "hits", "at", "parent", "n_below", "href", "text", "t0", "t1")
_ARROW = pa.list_(pa.struct([
    ("tag", pa.string()), ("hits", pa.list_(pa.int32())), ("at", pa.int32()), ("parent", pa.int32()), ("n_below", pa.int32()),
    ("href", pa.string()), ("text", pa.string()), ("t0", pa.int32()), ("t1", pa.int32()),
]))


def _firsts_below(rows: list[dict], below: int) -> None:
    """``first`` of each element that holds a match of the first ``below`` selectors: the place of each one's first match."""
    found: list[list[int]] = [[] for _ in range(below)]
    for row in rows:
        for number in row["hits"]:
            if number < below:
                found[number].append(row["at"])
    for row in rows:
        at, end, first = row["at"], row["at"] + row["n_below"], None
        if end > at:
            places = [bisect_right(f, at) for f in found]
            first = [f[i] if i < len(f) and f[i] <= end else None for f, i in zip(found, places)]
        row["first"] = first if first and any(i is not None for i in first) else None


def with_elements(pages: DataFrame, html: str, selectors: list[str], tree: bool, below: int = 0) -> DataFrame:
    """Replace the html column by ``page_text`` and ``els``; hits are positions in ``selectors``.

    With ``below`` (and ``tree``) an element's ``first`` has the places in ``els`` of the first matches below it of so
    many selectors, null for one without; it is null altogether where there is none.
    """
    kept = [c for c in pages.columns if c != html]
    schema = T.StructType(
        [pages.schema[c] for c in kept]
        + T._parse_datatype_string(f"page_text string, els array<{ELEMENT[:-1]}{', first: array<int>' if below else ''}>>").fields
    )
    paths = [css.paths(s) for s in selectors]
    fields = (*_FIELDS, "first") if below else _FIELDS
    arrow = pa.list_(pa.struct([*_ARROW.value_type, ("first", pa.list_(pa.int32()))])) if below else _ARROW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS_PER_BATCH):
                part = batch.slice(start, _ROWS_PER_BATCH)
                parsed = [parse_page(h, paths, tree) for h in part.column(html).to_pylist()]
                if below:
                    for _, els in parsed:
                        _firsts_below(els, below)
                columns = [part.column(c) for c in kept]
                columns.append(pa.array([t for t, _ in parsed], pa.string()))
                columns.append(pa.array([[{f: e[f] for f in fields} for e in els] for _, els in parsed], arrow))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "page_text", "els"])

    return pages.mapInArrow(run, schema)


class _PageElements:
    """One row per element of a page that fits one of the selectors, in document order."""

    read_paths = staticmethod(css.paths)  # the function travels with the class, its module would have to be there

    def __init__(self) -> None:
        self.paths: dict[tuple, list] = {}

    def eval(self, html: str, selectors: list[str], tree: bool) -> Iterator[tuple]:
        key = tuple(selectors or ())
        if key not in self.paths:
            self.paths[key] = [self.read_paths(s) for s in key]
        page_text, rows = parse_page(html, self.paths[key], bool(tree))
        for row in rows:
            # unlike in the array of a page, an element has its own text with it: rows are read one by one
            yield (*(row[f] for f in _FIELDS[:6]), page_text[row["t0"]:row["t1"]].strip(), row["t0"], row["t1"])


def register_sql(spark: SparkSession, name: str = "page_elements") -> None:
    """Make the tokeniser a table function of SQL.

    ``SELECT .. FROM pages, LATERAL page_elements(html, array('a', 'li.job'), false)``; the columns are those of an
    element, ``hits`` are places in the array of selectors, and a page without an element that fits has no row.  A null
    page is an empty one.  With ``tree`` all elements come, hit or not.  Rows travel by Arrow.
    """
    fields = T._parse_datatype_string(ELEMENT).fields
    spark.udtf.register(name, F.udtf(_PageElements, returnType=T.StructType(fields), useArrow=True))
