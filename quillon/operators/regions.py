"""Literal regions of Markdown: fenced code, raw HTML and code spans, in which directives are text.

Regions are found in the file's row, sorted and disjoint, so that a place is looked up by binary
search; they are never exploded.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the tags that begin a block of HTML which a blank line ends.
BLOCK_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
).split()
#: What begins a raw block, which goes on over blank lines, and what ends it.
RAW = (
    (rb"<(?:script|pre|style|textarea)(?=[ \t>\n]|\r|\Z)", rb"</(?:script|pre|style|textarea)>"),
    (rb"<!--", rb"-->"),
    (rb"<\?", rb"\?>"),
    (rb"<![A-Za-z]", rb">"),
    (rb"<!\[CDATA\[", rb"\]\]>"),
)
_RAW = [(re.compile(rb"[ ]{0,3}" + a, re.I), re.compile(b, re.I)) for a, b in RAW]
_BLOCK = re.compile(rb"[ ]{0,3}</?(?:" + "|".join(BLOCK_TAGS).encode() + rb")(?=[ \t>\r\n]|/>|\Z)", re.I)
_WHOLE_TAG = re.compile(rb"[ ]{0,3}(?:<[A-Za-z][A-Za-z0-9-]*(?:[ \t]+[A-Za-z_:][\w.:-]*(?:[ \t]*=[ \t]*(?:[^ \t\"'=<>`]+|'[^'\n]*'|\"[^\"\n]*\"))?)*[ \t]*/?>|</[A-Za-z][A-Za-z0-9-]*[ \t]*>)[ \t]*\r?\n?\Z")
_FENCE = re.compile(rb"[ ]{0,3}(`{3,}(?=[^`\n]*(?:\n|\Z))|~{3,})")
_INLINE = re.compile(rb"\\[`<\\]|(`+)|<!--.*?-->|<\?.*?\?>|</?[A-Za-z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>", re.S)
_BLANK = re.compile(rb"[ \t]*\r?\n?\Z")
Region = tuple[int, int, str, bool]


def literal_regions(data: bytes) -> Iterator[Region]:
    """Regions (start, end, kind, closed) in order: fence, html, code. Not closed: what the text ends within."""
    lines = [m.span() for m in re.finditer(rb"[^\n]*\n|[^\n]+\Z", data)]
    i, paragraph = 0, None
    while i <= len(lines):
        a, b = lines[i] if i < len(lines) else (len(data), len(data))
        line = data[a:b]
        fence = _FENCE.match(line)
        raw = next((end for begin, end in _RAW if begin.match(line)), None)
        html = _BLOCK.match(line) or (paragraph is None and _WHOLE_TAG.match(line))
        ends = i == len(lines) or fence or raw or html or _BLANK.match(line)
        if ends and paragraph is not None:
            yield from _inline(data, paragraph, a)
            paragraph = None
        if i == len(lines):
            return
        if fence:
            mark = fence.group(1)
            close = re.compile(rb"[ ]{0,3}" + re.escape(mark[:1]) + rb"{%d,}[ \t]*\r?\n?\Z" % len(mark))
            j = next((j for j in range(i + 1, len(lines)) if close.match(data[lines[j][0] : lines[j][1]])), None)
            yield a, lines[j][1] if j is not None else len(data), "fence", j is not None
            i = len(lines) if j is None else j + 1
            continue
        if raw:
            j = next((j for j in range(i, len(lines)) if raw.search(data[lines[j][0] : lines[j][1]])), None)
            yield a, lines[j][1] if j is not None else len(data), "html", j is not None
            i = len(lines) if j is None else j + 1
            continue
        if html:
            j = next((j for j in range(i + 1, len(lines)) if _BLANK.match(data[lines[j][0] : lines[j][1]])), len(lines))
            yield a, lines[j - 1][1], "html", True
            i = j
            continue
        if not ends and paragraph is None:
            paragraph = a
        i += 1


def _inline(data: bytes, start: int, end: int) -> Iterator[Region]:
    """Code spans and tags of a paragraph; ticks without equal ones behind them are text."""
    at = start
    closers: dict[int, list[int]] = {}
    for m in re.compile(rb"`+").finditer(data, start, end):
        closers.setdefault(m.end() - m.start(), []).append(m.start())
    while m := _INLINE.search(data, at, end):
        at = m.end()
        if m.group(1):
            width = len(m.group(1))
            own = closers.get(width, [])
            k = bisect.bisect_left(own, m.end())
            if k < len(own):
                at = own[k] + width
                yield m.start(), at, "code", True
        elif not m.group().startswith(b"\\"):
            yield *m.span(), "html", True


def _column(rows: list[list | None], fields: list[tuple[str, pa.DataType]]) -> pa.Array:
    kind = pa.list_(pa.struct(fields))
    names = [n for n, _ in fields]
    return pa.array([None if r is None else [dict(zip(names, x, strict=True)) for x in r] for r in rows], kind)


def regions(text: Column) -> Column:
    """Array of a text's regions, sorted by place: start, end (bytes), kind, closed."""

    @F.arrow_udf("array<struct<start:long,end:long,kind:string,closed:boolean>>")
    def find(column: pa.Array) -> pa.Array:
        got = [list(literal_regions(x.as_py())) if x.is_valid else None for x in column.cast(pa.binary())]
        return _column(got, [("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("closed", pa.bool_())])

    return find(text)


def open_region(text: Column) -> Column:
    """What a text ends within: ``open_fence``, ``open_html``, null if nothing is open. Texts without such signs aren't looked at."""
    marked = F.when(text.rlike(r"(?m)^ {0,3}(?:`{3}|~{3}|<)"), text)
    last = F.try_element_at(regions(marked), F.lit(-1))
    return F.when(~last.getField("closed"), F.concat(F.lit("open_"), last.getField("kind")))


def tags_of(pattern: str) -> Column:
    """A function of text: array of its tags outside regions, start, end (bytes), line_no, name, arguments, alone.

    Tags are opaque: what they hold opens no region. One behind an odd number of backslashes is text.
    A tag is within a line.
    """
    tag = re.compile(pattern.encode())
    alone = re.compile(rb" {0,3}" + pattern.encode() + rb"[ \t]*\r?\n?\Z")

    @F.arrow_udf("array<struct<start:long,end:long,line_no:long,name:string,arguments:string,alone:boolean>>")
    def tags(column: pa.Array) -> pa.Array:
        out = []
        for x in column.cast(pa.binary()):
            if not x.is_valid:
                out.append(None)
                continue
            data = x.as_py()
            masked, found = bytearray(data), []
            for number, line in enumerate(re.finditer(rb"[^\n]*\n|[^\n]+\Z", data), 1):
                at = line.start()
                while (at := data.find(b"{%", at, line.end())) >= 0:
                    before = data[line.start() : at]
                    m = None if (len(before) - len(before.rstrip(b"\\"))) % 2 else tag.match(data, at, line.end())
                    if m:
                        found.append((*m.span(), number, m.group(1).decode(), m.group(2).decode().strip(" "), bool(alone.match(line.group()))))
                        masked[m.start() : m.end()] = b"x" * (m.end() - m.start())
                    at = m.end() if m else at + 2
            own = list(literal_regions(bytes(masked))) if found else []
            ends = [r[1] for r in own]
            inside = lambda at: (k := bisect.bisect_right(ends, at)) < len(own) and own[k][0] <= at  # noqa: B023, E731
            out.append([t for t in found if not inside(t[0])])
        return _column(out, [("start", pa.int64()), ("end", pa.int64()), ("line_no", pa.int64()), ("name", pa.string()), ("arguments", pa.string()), ("alone", pa.bool_())])

    return tags
