"""Column expressions over text: words, identifier parts, matches, lines, slices, quoting.

Positions are in code points, as Spark counts, unless a name says bytes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ranges that count as Han.
HAN = "㐀-䶿一-鿿豈-﫿\U00020000-\U000323af"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of letters, digits and underscores, all Han or none.
WORD = rf"[{HAN}]+|[\p{{L}}\p{{N}}_&&[^{HAN}]]+"
#: A character that belongs to a word other than a Han one.
EDGE = rf"[\p{{L}}\p{{N}}_&&[^{HAN}]]"
SNIPPET, BEFORE = 240, 80
_TO_LOWER, _TO_UPPER = str.maketrans(UPPER, LOWER), str.maketrans(LOWER, UPPER)


def ascii_lower(text: Column) -> Column:
    """Only A-Z change; `lower` would fold other letters too."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def parts(text: Column) -> Column:
    """Parts of identifiers by case and underscore, of all words of a text, in ASCII lower case."""
    spaced = F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, r"([^ ])([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(ascii_lower(spaced), rf"[^\p{{L}}\p{{N}}]+|(?<=[{HAN}])(?=[^{HAN}])|(?<=[^{HAN}])(?=[{HAN}])"), lambda x: x != "")


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query, sorted: what has a slash whole, Han runs as pairs, else words in ASCII lower case."""
    found: set[str] = set()
    for token in query.split():
        if "/" in token:
            found.add(token.translate(_TO_LOWER))
            continue
        for run in re.findall(rf"[{HAN}]+|(?:(?![{HAN}])\w)+", token):
            if re.match(f"[{HAN}]", run):
                found |= {run[i : i + 2] for i in range(max(1, len(run) - 1))}
            else:
                found.add(run.translate(_TO_LOWER))
    return sorted(found)


def matches(text: Column, term: str) -> Column:
    """Whether a term is the whole field, one of its words or identifier parts, or within a Han word.

    Regexes stop at the first word that is the term. Only texts where it may be an identifier's
    part, with a capital, a digit's end or an underscore at its edges, are cut into parts.
    """
    if "/" in term:
        return ascii_lower(text) == term
    if re.match(f"[{HAN}]", term):
        return text.contains(term)
    bare = _ascii_any_case(term)
    whole = text.rlike(rf"(?<!{EDGE}){bare}(?!{EDGE})")
    inner = rf"[\p{{L}}\p{{N}}&&[^{HAN}]]"
    maybe = text.rlike(rf"(?:(?<!{inner})|(?=[A-Z])){bare}(?:(?!{inner})|(?=[A-Z]))")
    return whole | (maybe & F.array_contains(parts(text), term))


def _ascii_any_case(term: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c in LOWER else re.escape(c) for c in term)


def _before(text: Column, pattern: str) -> Column:
    """How many characters are before a pattern's first match; null if there is none."""
    # The length of what is before it: in code points, which positions of regexes aren't.
    return F.when(text.rlike(pattern), F.length(F.get(F.split(text, pattern, 2), 0)))


def first_hit(text: Column, term: str) -> Column:
    """Position (from 0) of a term's first whole-word match in a text, null if there is none."""
    if re.match(f"[{HAN}]", term):
        return _before(text, re.escape(term))
    # What is before a word is looked at behind the word, where few places are left.
    bare = _ascii_any_case(term)
    return _before(text, rf"{bare}(?!{EDGE})(?<!{EDGE}{bare})")


def first_range(text: Column, term: str) -> Column:
    """Where a term first matches a field: struct start, end; null if it doesn't, see `matches`.

    A whole field or word comes before an identifier's part. A part is lower case, capitalized, or
    all capitals, between changes of case or kind.
    """
    if "/" in term:
        return F.when(ascii_lower(text) == term, F.struct(F.lit(0).alias("start"), F.length(text).alias("end")))
    at = first_hit(text, term)
    if not re.match(f"[{HAN}]", term):
        inner = rf"[\p{{L}}\p{{N}}&&[^{HAN}]]"
        forms = "|".join(sorted({re.escape(x) for x in (term, term[:1].translate(_TO_UPPER) + term[1:], term.translate(_TO_UPPER))}))
        pattern = rf"(?={forms})(?:(?<!{inner})|(?<=[a-z0-9])(?=[A-Z])|(?<=[^ ])(?=[A-Z][a-z]))(?:{forms})(?:(?!{inner})|(?<=[a-z0-9])(?=[A-Z])|(?=[A-Z][a-z]))"
        at = F.coalesce(at, _before(text, pattern))
    # As an item of an array: the place is looked for once, not wherever it is used.
    return F.get(F.transform(F.filter(F.array(at), lambda a: a.isNotNull()), lambda a: F.struct(a.alias("start"), (a + len(term)).alias("end"))), 0)


def snippet(text: Column, at: Column) -> Column:
    """At most 240 characters, from 80 before ``at``, moved forward to the end of a shorter rest."""
    start = F.greatest(F.lit(0), F.least(F.coalesce(at, F.lit(0)) - BEFORE, F.length(text) - SNIPPET))
    return F.substring(text, start + 1, F.lit(SNIPPET))


def under(path: Column, prefix: str) -> Column:
    """A path that is the prefix or lies below it; ``src`` has nothing of ``src-old``."""
    return (path == prefix) | path.startswith(prefix + "/")


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def line_slice(text: Column, first: int, last: int) -> Column:
    """Lines first to last, from 1, both included, their ends kept."""
    return F.array_join(F.slice(F.split(text, r"(?<=\n)"), first, last - first + 1), "")


def lf(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def source_offset(text: Column, at: Column) -> Column:
    """The place in a text of a place in its view with LF ends: one more for each CRLF before it.

    With one mark for each CRLF the text is as long as its view, so the marks before the place are counted.
    """
    mark = F.lit("\0")
    before = F.left(F.replace(F.replace(text, mark, F.lit(" ")), F.lit("\r\n"), mark), at)
    return at + F.length(before) - F.length(F.replace(before, mark, F.lit("")))


def longest_run(text: Column, char: str = "`") -> Column:
    runs = F.transform(F.regexp_extract_all(text, F.lit(f"{re.escape(char)}+"), F.lit(0)), F.length)
    return F.coalesce(F.array_max(runs), F.lit(0))


def fence(text: Column, char: str = "`") -> Column:
    """A fence that the text can't close: one longer than its longest run, three at least."""
    return F.repeat(F.lit(char), F.greatest(longest_run(text, char) + 1, F.lit(3)))


def code_span(text: Column) -> Column:
    """A code span around any text: padded if a tick or space is at its edge."""
    ticks = F.repeat(F.lit("`"), longest_run(text) + 1)
    pad = F.when(text.rlike(r"^[` ]|[` ]$"), F.lit(" ")).otherwise(F.lit(""))
    return F.concat(ticks, pad, text, pad, ticks)


def percent_encoded(path: Column) -> Column:
    """Unreserved characters and slashes stay, other bytes become %XX."""
    coded = F.url_encode(path)
    for a, b in (("%2F", "/"), ("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(a), F.lit(b))
    return coded


def relative_url(target: Column, page: Column) -> Column:
    """URL of a target path as seen from a page: up to the folder that both share, then down."""
    a, b = F.split(page, "/"), F.split(target, "/")
    depth = F.least(F.size(a), F.size(b)) - 1
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), F.lit(0), lambda n, i: F.when((n == i - 1) & (i <= depth) & (F.get(a, i - 1) == F.get(b, i - 1)), i).otherwise(n))
    up = F.repeat(F.lit("../"), F.size(a) - 1 - same)
    return percent_encoded(F.concat(up, F.array_join(F.slice(b, same + 1, F.size(b)), "/")))


def joined_path(folder: Column, path: Column) -> Column:
    """The path below the root that a relative path means as seen from a folder; null if it leads out of the root."""
    parts = F.concat(F.split(folder, "/"), F.split(path, "/"))
    up = lambda acc: F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
    step = lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", up(acc)).otherwise(F.array_append(acc, p))
    return F.aggregate(parts, F.array().cast("array<string>"), step, lambda acc: F.array_join(acc, "/"))


def byte_slice(text: Column, offset: Column, budget: int) -> Column:
    """Struct of text, start, end, next: at most ``budget`` characters from a byte offset on.

    ``next`` is null at the end. The offset must be at a character's first byte.
    """
    tail = F.decode(F.substring(F.encode(text, "UTF-8"), offset + 1, F.octet_length(text)), "UTF-8")
    body = F.substring(tail, 1, budget)
    end = offset + F.octet_length(body)
    return F.struct(body.alias("text"), offset.alias("start"), end.alias("end"), F.when(end < F.octet_length(text), end).alias("next"))
