"""Texts made from other texts, with maps that lead every place back to the bytes it is from.

A map is an array of runs (at, end, src, src_end), in bytes, in order: what lies at [at, end) of
the new text is from [src, src_end) of the old one. Runs of one length on both sides agree byte by
byte; others, such as a decoded entity or an LF for a CRLF, stand for each other as a whole. What no run
holds was put in and is from nowhere. Runs are kept in the row, in arrays; numpy walks them in
one pass.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = "array<struct<at:long,end:long,src:long,src_end:long>>"
MADE = f"struct<text:string,runs:{RUN}>"
#: Replaced bytes of the old text and what stands for them, and whether that is from these bytes.
Edit = tuple[int, int, bytes, bool]


def edited(data: bytes, edits: list[Edit]) -> tuple[bytes, np.ndarray]:
    """A text with its edits made, which are in order and don't overlap, and its runs (rows of four numbers)."""
    out, runs, at, src = [], [], 0, 0
    for start, end, new, own in [*edits, (len(data), len(data), b"", False)]:
        if start > src:
            runs.append((at, at + start - src, src, start))
            out.append(data[src:start])
            at += start - src
        if new:
            if own:
                runs.append((at, at + len(new), start, end))
            out.append(new)
            at += len(new)
        src = end
    return b"".join(out), joined(np.array(runs, np.int64).reshape(-1, 4))


def joined(runs: np.ndarray) -> np.ndarray:
    """Runs with neighbours made one that go on without a gap on both sides, byte by byte."""
    if len(runs) < 2:
        return runs
    even = runs[:, 1] - runs[:, 0] == runs[:, 3] - runs[:, 2]
    on = even[1:] & even[:-1] & (runs[1:, 0] == runs[:-1, 1]) & (runs[1:, 2] == runs[:-1, 3])
    first = np.flatnonzero(np.concatenate([[True], ~on]))
    last = np.append(first[1:], len(runs)) - 1
    return np.stack([runs[first, 0], runs[last, 1], runs[first, 2], runs[last, 3]], axis=1)


def composed(outer: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """The map of a text made from a text that was made from a source: ``outer`` leads to the middle one, ``inner`` from there on.

    An outer run is cut where an inner one ends. A part of which one side is as a whole stays whole.
    """
    out = []
    low = np.searchsorted(inner[:, 1], outer[:, 2], "right") if len(inner) else np.zeros(len(outer), int)
    for (at, end, mid, mid_end), k in zip(outer.tolist(), low.tolist(), strict=True):
        even = end - at == mid_end - mid
        parts = []
        while k < len(inner) and inner[k, 0] < mid_end:
            a, b, src, src_end = inner[k].tolist()
            lo, hi = max(a, mid), min(b, mid_end)
            if b - a == src_end - src:
                src, src_end = src + lo - a, src + hi - a
            parts.append((at + lo - mid, at + hi - mid, src, src_end))
            k += 1
        if even:
            out += parts
        elif parts:
            out.append((at, end, parts[0][2], parts[-1][3]))
    return joined(np.array(out, np.int64).reshape(-1, 4))


def inverted(runs: np.ndarray) -> np.ndarray:
    """The map from the source to the text."""
    return runs[np.lexsort((runs[:, 0], runs[:, 2]))][:, [2, 3, 0, 1]]


def source_range(runs: np.ndarray, start: int, end: int) -> tuple[int, int] | None:
    """The bytes that [start, end) of the text is from: from the first run with a part of it to the last, None without one."""
    k = int(np.searchsorted(runs[:, 1], start, "right"))
    last = int(np.searchsorted(runs[:, 0], end, "left")) - 1
    if k > last or start >= end:
        return None
    cut = lambda r, x: r[2] + x - r[0] if r[1] - r[0] == r[3] - r[2] else None
    a, b = runs[k].tolist(), runs[last].tolist()
    first, stop = cut(a, max(start, a[0])), cut(b, min(end, b[1]))
    return (a[2] if first is None else first), (b[3] if stop is None else stop)


# --- what texts are made by ------------------------------------------------------------------------


def lf_edits(data: bytes) -> list[Edit]:
    """Line ends as LF: for a CRLF, or a CR alone."""
    return [(m.start(), m.end(), b"\n", True) for m in re.finditer(rb"\r\n?", data)]


def line_comment_edits(data: bytes) -> list[Edit]:
    """A run of lines that are each a comment: its indent, marker (``//``, ``///``, ``//!`` or ``#``) and one space go, line ends become LF."""
    out = []
    for m in re.finditer(rb"([ \t]*(?://[/!]?|\#)[ ]?)?[^\r\n]*(\r\n?|\n)?", data):
        if m.group(1):
            out.append((*m.span(1), b"", False))
        if m.group(2) and m.group(2) != b"\n":
            out.append((*m.span(2), b"\n", True))
    return out


def block_comment_edits(data: bytes) -> list[Edit]:
    """A block comment, with the indent before it: marks, one space at each, margin and stars go.

    The margin of later lines is the indent of the first; then a star with the blank before and behind it
    goes if the comment has more than one line and every other line has one, else as many blanks as the opening
    mark and its space took. A first and a last line of blanks go.
    """
    m = re.fullmatch(rb"(?s)([ \t]*)(/\*+(?!/)|/\*|\(\*+(?!\))|\(\*)([ ]?)(.*?)([ ]?)(\*+/|\*+\))[ \t]*(?:\r\n?|\n)?", data)
    if not m:
        return lf_edits(data)
    keep: list[list[int]] = []
    at, end = m.start(4), m.end(4)
    ends = []
    for line in re.finditer(rb"\r\n?|\n", data[at:end]):
        keep.append([at if not keep else ends[-1][1], m.start(4) + line.start()])
        ends.append((m.start(4) + line.start(), m.start(4) + line.end()))
    keep.append([ends[-1][1] if ends else at, end])
    blank = lambda k: not data[k[0] : k[1]].strip(b" \t")
    stars = all(re.match(rb"[ \t]*\*(?: |\r|\n|$)", data[k[0] : k[1]] + b"\n") or blank(k) for k in keep[1:]) and any(b"*" in data[k[0] : k[1]] for k in keep[1:])
    for k in keep[1:]:
        line = data[k[0] : k[1]]
        k[0] += len(m.group(1)) if line.startswith(m.group(1)) else 0
        line = data[k[0] : k[1]]
        margin = len(m.group(2)) + len(m.group(3))
        if stars and (star := re.match(rb"[ \t]*\*[ ]?", line)):
            k[0] += star.end()
        elif not blank(keep[0]) and line[:margin] == b" " * margin:
            k[0] += margin
    first = 1 if len(keep) > 1 and blank(keep[0]) else 0
    last = len(keep) - 1 if len(keep) - 1 > first and blank(keep[-1]) else len(keep)
    out, at = [], 0
    for i in range(first, last):
        if keep[i][0] > at:
            out.append((at, keep[i][0], b"", False))
        at = keep[i][1]
        if i + 1 < last:
            out.append((*ends[i], b"\n", True))
            at = ends[i][1]
    return [*out, (at, len(data), b"", False)] if at < len(data) else out


def comment_edits(data: bytes) -> list[Edit]:
    """Those of a line or block comment, whichever it is."""
    return block_comment_edits(data) if re.match(rb"[ \t]*(?:/\*|\(\*)", data) else line_comment_edits(data)


_VISIBLE = re.compile(
    rb"(?P<fence>^[ ]{0,3}(?:```+|~~~+)[^\n]*\n?)|(?P<comment><!--.*?(?:-->|\Z))|(?P<raw><(?P<of>script|style)\b.*?(?:</(?P=of)\s*>|\Z))"
    rb"|(?P<tag></?[A-Za-z][^<>]*>)|(?P<entity>&(?:\#[0-9]{1,7}|\#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});)|(?P<escape>\\(?=[!-/:-@\[-`{-~]))"
    rb"|(?P<heading>^[ ]{0,3}\#{1,6}(?:[ \t]+|(?=\n|\Z)))|(?P<link>!?\[(?=[^\]\n]*\]\([^()\s]*(?:[ ]\"[^\"\n]*\")?\)))|(?P<target>\]\([^()\s]*(?:[ ]\"[^\"\n]*\")?\))"
    rb"|(?P<mark>(?<![\w*])\*{1,3}(?=[^\s*])|(?<=[^\s*])\*{1,3}(?![\w*])|(?<![\w])_{1,3}(?=[^\s_])|(?<=[^\s_])_{1,3}(?![\w]))|(?P<code>(?<!`)(`+)(?!`))|(?P<block>\n(?:[ \t]*\n)+)",
    re.M | re.S | re.I,
)


def visible_edits(data: bytes) -> list[Edit]:
    """Markdown or a page as what a reader sees: marks, tags, comments, scripts and link targets go, entities are decoded, a blank line ends a block with a space.

    Code keeps its bytes between its ticks, and so does a fenced block between its fences.
    """
    out, at = [], 0
    while m := _VISIBLE.search(data, at):
        at = max(m.end(), m.start() + 1)
        kind = m.lastgroup
        kind = next(k for k in ("fence", "comment", "raw", "tag", "entity", "escape", "heading", "link", "target", "mark", "code", "block") if m.group(k) is not None)
        if kind == "entity":
            if (new := html.unescape(m.group().decode())) != m.group().decode():
                out.append((*m.span(), new.encode(), True))
        elif kind == "block":
            out.append((*m.span(), b" ", False))
        elif kind == "fence":
            sign = m.group().lstrip(b" ")[:1]
            width = len(m.group().lstrip(b" ")) - len(m.group().lstrip(b" ").lstrip(sign))
            out.append((*m.span(), b"", False))
            close = re.compile(rb"^[ ]{0,3}" + re.escape(sign) + rb"{%d,}[ \t]*(?:\n|\Z)" % width, re.M).search(data, m.end())
            if close:
                out.append((*close.span(), b" ", False))
            at = close.end() if close else len(data)
        elif kind == "code":
            ticks = m.group()
            close = re.compile(rb"(?<!`)" + ticks + rb"(?!`)").search(data, m.end())
            if close and b"\n\n" not in data[m.end() : close.start()]:
                a, b = m.end(), close.start()
                inner = data[a:b]
                if inner[:1] in (b" ", b"\n") and inner[-1:] in (b" ", b"\n") and inner.strip(b" \n"):
                    a, b = a + 1, b - 1
                out.append((m.start(), a, b"", False))
                out += [(x.start(), x.end(), b" ", True) for x in re.compile(rb"\n").finditer(data, a, b)]
                out.append((b, close.end(), b"", False))
                at = close.end()
        else:
            out.append((*m.span(), b"", False))
            at += kind == "escape"  # what a backslash is before is no mark
    return out


EDITS: dict[str, Callable[[bytes], list[Edit]]] = {"lf": lf_edits, "comment": comment_edits, "visible": visible_edits}

#: Texts of a batch that are made together.
TOGETHER = 256

# --- columns ---------------------------------------------------------------------------------------


def _runs_array(runs: list[np.ndarray], valid: list[bool]) -> pa.ListArray:
    flat = np.concatenate([np.zeros((0, 4), np.int64), *runs])
    fields = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(4)], ["at", "end", "src", "src_end"])
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), fields, mask=pa.array([not v for v in valid], pa.bool_()))


def _runs_of(column: pa.Array) -> Iterator[np.ndarray]:
    flat = column.values
    own = np.stack([flat.field(i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1).astype(np.int64) if len(flat) else np.zeros((0, 4), np.int64)
    for i in range(len(column)):
        yield own[column.offsets[i].as_py() : column.offsets[i + 1].as_py()] if column[i].is_valid else np.zeros((0, 4), np.int64)


def _made(pairs: list[tuple[bytes, np.ndarray] | None]) -> pa.StructArray:
    text = pa.array([None if p is None else p[0] for p in pairs], pa.binary()).cast(pa.string())
    runs = _runs_array([np.zeros((0, 4), np.int64) if p is None else p[1] for p in pairs], [p is not None for p in pairs])
    return pa.StructArray.from_arrays([text, runs], ["text", "runs"])


def made(text: Column, *steps: str) -> Column:
    """Struct text, runs: a text after one or more steps (lf, comment, visible), with the map back to the first one. Null stays null."""

    @F.arrow_udf(MADE)
    def make(column: pa.Array) -> pa.Array:
        return _stepped(column, steps)

    return make(text)


def _stepped(column: pa.Array, steps: tuple[str, ...]) -> pa.Array:
    """``made`` of a batch, some texts at a time, so that only these are Python's objects."""
    parts = []
    for at in range(0, max(len(column), 1), TOGETHER):
        out = []
        for x in column.slice(at, TOGETHER).cast(pa.binary()):
            if not x.is_valid:
                out.append(None)
                continue
            data, runs = x.as_py(), None
            for s in steps:
                data, own = edited(data, EDITS[s](data))
                runs = own if runs is None else composed(own, runs)
            out.append((data, runs))
        parts.append(_made(out))
    return pa.concat_arrays(parts)


def substituted(text: Column, edits: Column) -> Column:
    """Struct text, runs, error: a text with expansions in place of calls.

    ``edits`` is an array of (start, end, markdown, inline): byte ranges of calls, in any order. What an
    expansion brings is from no byte of the text. Errors: overlap, out_of_range, and line_break for an
    inline expansion that holds one; with an error, text and runs are null.
    """

    @F.arrow_udf(f"struct<text:string,runs:{RUN},error:string>")
    def make(texts: pa.Array, all_edits: pa.Array) -> pa.Array:
        out, errors = [], []
        for x, own in zip(texts.cast(pa.binary()), all_edits, strict=True):
            calls = sorted(own.as_py() or [], key=lambda e: (e["start"], e["end"])) if own.is_valid else []
            error = None
            if x.is_valid:
                size = len(x.as_buffer())
                if any(e["start"] < 0 or e["end"] > size or e["start"] > e["end"] for e in calls):
                    error = "out_of_range"
                elif any(a["end"] > b["start"] for a, b in zip(calls, calls[1:], strict=False)):
                    error = "overlap"
                elif any(e["inline"] and re.search("[\r\n]", e["markdown"] or "") for e in calls):
                    error = "line_break"
            errors.append(error)
            out.append(edited(x.as_py(), [(e["start"], e["end"], (e["markdown"] or "").encode(), False) for e in calls]) if x.is_valid and error is None else None)
        got = _made(out)
        return pa.StructArray.from_arrays([got.field("text"), got.field("runs"), pa.array(errors, pa.string())], ["text", "runs", "error"])

    return make(text, edits)


def composition(outer: Column, inner: Column) -> Column:
    """The runs of ``outer`` led on through those of ``inner``."""

    @F.arrow_udf(RUN)
    def make(a: pa.Array, b: pa.Array) -> pa.Array:
        return _runs_array([composed(x, y) for x, y in zip(_runs_of(a), _runs_of(b), strict=True)], [x.is_valid and y.is_valid for x, y in zip(a, b, strict=True)])

    return make(outer, inner)


def inverse(runs: Column) -> Column:
    """The runs from the source to the text."""
    swapped = F.transform(runs, lambda r: F.struct(r.src.alias("at"), r.src_end.alias("end"), r["at"].alias("src"), r.end.alias("src_end")))
    return F.array_sort(swapped)


def source_ranges(runs: Column, ranges: Column) -> Column:
    """For each of an array of ranges (start, end) of the text the bytes that it is from: array of structs start, end, null where none."""

    @F.arrow_udf("array<struct<start:long,end:long>>")
    def make(all_runs: pa.Array, asked: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        out = []
        for own, ranges in zip(_runs_of(all_runs), asked, strict=True):
            got = [source_range(own, r["start"], r["end"]) if r is not None else None for r in ranges.as_py() or []] if ranges.is_valid else None
            out.append(None if got is None else [None if g is None else {"start": g[0], "end": g[1]} for g in got])
        return pa.array(out, kind)

    return make(runs, ranges)


def mapped_bytes(runs: Column) -> Column:
    """How many bytes of the text are from somewhere."""
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r.end - r["at"])


def exploded(rows: DataFrame, key: str, made_column: str) -> DataFrame:
    """One row for each run: key, run_no, at, end, src, src_end."""
    return rows.select(key, F.posexplode(F.col(f"{made_column}.runs")).alias("run_no", "_r")).select(key, "run_no", "_r.*")
