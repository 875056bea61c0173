"""Secret scans: Boolean trigram queries from regexes, intersected postings, verified candidates.

The index has both forms. A document's row of it is a bitmask of the trigrams that its text has;
this is where queries are answered in a single pass, as the text is at hand to be verified and
needn't be shuffled. `postings` is the same index by trigram, for a table that is kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import free_names


@dataclass(frozen=True)
class Rule:
    """``pattern`` is tried leftmost, without overlap; ``group`` of a match needs ``least`` characters."""

    kind: str
    pattern: str
    any_case: bool = False
    group: int = 0
    least: int = 1
    base: bool = False


#: The kinds in the order in which spans with the same start are listed. For ``access`` and
#: ``hex``, asking for the length in the pattern is the same as dropping short matches later: a
#: match takes the whole run, so a short one hides nothing long.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", any_case=True, group=2, least=6, base=True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)

#: Strings that one stretch of a pattern may stand for before it is cut into trigrams.
MOST_STRINGS = 64


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """What a match must contain, in lower case: all of the list's items, each an OR of ANDs of trigrams.

    Stretches of the pattern that stand for few strings give the trigrams of these strings; what
    stands for many cuts a stretch. An empty list: any text may match.
    """
    found: list[list[frozenset[str]]] = []

    def flush(exact: set[str]) -> set[str]:
        if all(len(x) >= 3 for x in exact):
            each = {frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in exact}
            # What asks for more than another alternative adds nothing to an OR.
            found.append(sorted((x for x in each if not any(y < x for y in each)), key=sorted))
        return {""}

    def walk(items) -> None:
        exact = {""}
        for op, arg in items:
            some = _strings(op, arg)
            if some is not None and len(exact) * len(some) <= MOST_STRINGS:
                exact = {a + b for a, b in product(exact, some)}
                continue
            exact = flush(exact)
            if op is sre.SUBPATTERN:
                walk(arg[3])
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                walk(arg[2])
        flush(exact)

    walk(_parser.parse(pattern))
    return found


def _strings(op, arg) -> set[str] | None:
    """All strings that a part of a pattern stands for, in lower case; None if these are many."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        out: set[str] = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                out.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < 8:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is sre.SUBPATTERN:
        return _sequence(arg[3])
    if op is sre.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] <= 3:
        one = _sequence(arg[2])
        return None if one is None else set().union(*({"".join(x) for x in product(one, repeat=n)} for n in range(arg[0], int(arg[1]) + 1)))
    return None


def _sequence(items) -> set[str] | None:
    out = {""}
    for op, arg in items:
        some = _strings(op, arg)
        if some is None or len(out) * len(some) > MOST_STRINGS:
            return None
        out = {a + b for a, b in product(out, some)}
    return out


def asked_trigrams(rules: tuple[Rule, ...]) -> list[str]:
    """All trigrams that the rules' queries ask for, in order."""
    return sorted({t for r in rules for alternatives in trigram_query(r.pattern) for one in alternatives for t in one})


def index_row(low: Column, trigrams: list[str]) -> Column:
    """A text's row of the index: an array of 32-bit masks, in longs, of the trigrams that it has.

    ``low`` is the text in lower case.
    """
    words = []
    for start in range(0, max(1, len(trigrams)), 32):
        bits = [F.when(low.contains(t), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, t in enumerate(trigrams[start : start + 32])]
        words.append(reduce(Column.__add__, bits, F.lit(0).cast("long")))
    return F.array(*words)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The index by trigram: one row (trigram, doc_id) for each document whose text has it."""
    rows = docs.select("doc_id", _once(F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("low"))
    return rows.select("doc_id", F.explode(F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.col("low").contains(t))).alias("trigram"))


def fulfilled(row: Column, rules: tuple[Rule, ...], trigrams: list[str]) -> Column:
    """Numbers of the rules whose Boolean query an index row fulfils; rules without one aren't listed."""
    number = {t: i for i, t in enumerate(trigrams)}

    def has(one: frozenset[str]) -> Column:
        out = F.lit(True)
        for w in range((len(trigrams) + 31) // 32):
            if mask := sum(1 << number[t] - 32 * w for t in one if number[t] // 32 == w):
                m = F.lit(mask).cast("long")
                out = out & (F.get(row, w).bitwiseAND(m) == m)
        return out

    def fulfils(q: list[list[frozenset[str]]]) -> Column:
        return reduce(Column.__and__, (reduce(Column.__or__, map(has, alternatives), F.lit(False)) for alternatives in q), F.lit(True))

    asked = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    return F.array_compact(F.array(*(F.when(fulfils(q), F.lit(i)) for i, q in asked.items()), F.lit(None).cast("int")))


def _once(value: Column) -> Column:
    """The value as a generator's only row, so that it isn't computed again wherever it is used."""
    return F.explode(F.array(value))


def rule_spans(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, end, number), in code points, of the matches of a rule that are long enough.

    A text is its matches and the gaps between them: their lengths add up to the places.
    """
    pattern = ("(?i)" if rule.any_case else "") + rule.pattern
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("hit"), kept.alias("kept"))
    empty = F.array().cast("array<struct<start:int,end:int,number:int>>")

    def add(acc: Column, x: Column) -> Column:
        start = acc.pos + F.length(x.gap)
        end = start + F.coalesce(F.length(x.hit), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(number).alias("number"))
        long = F.coalesce(F.length(x.kept) >= rule.least, F.lit(False))
        return F.struct(end.alias("pos"), F.when(long, F.concat(acc.spans, F.array(span))).otherwise(acc.spans).alias("spans"))

    found = F.aggregate(parts, F.struct(F.lit(0).alias("pos"), empty.alias("spans")), add, lambda acc: acc.spans)
    return F.when(text.rlike(pattern), found).otherwise(empty)


def with_spans(docs: DataFrame, spans: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the column ``spans``, an array of (start, end, number of the rule) in the order of spans.

    Only candidates of a rule, whose index row fulfils its query, are held against its regex;
    rules without a trigram query are tried on each text. All happens in the row: nothing is
    shuffled.
    """
    low, row, listed = free_names(docs, "low", "row", "rules")
    trigrams = asked_trigrams(rules)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn(low, _once(F.lower(text)))
    rows = rows.withColumn(row, _once(index_row(F.col(low), trigrams))).drop(low)
    rows = rows.withColumn(listed, _once(fulfilled(F.col(row), rules, trigrams))).drop(row)
    empty = F.array().cast("array<struct<start:int,end:int,number:int>>")
    each = [F.when(F.array_contains(listed, F.lit(i)), rule_spans(text, r, i)).otherwise(empty) if trigram_query(r.pattern) else rule_spans(text, r, i) for i, r in enumerate(rules)]
    order = lambda a, b: F.when(a.start != b.start, a.start - b.start).otherwise(a.number - b.number)
    return rows.withColumn(spans, _once(F.array_sort(F.concat(*each), order))).drop(listed)


def _listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s.number + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Secrets of each text: doc_id, n_<kind> of the base rules, base_sha256, spans.

    ``spans`` lists kind:start:end by start, then by the rules' order, comma-joined, in code
    points, the end exclusive; base_sha256 is the hash of the base rules' list. Null and empty
    texts have none: counts of 0, the hash of the empty string. Texts are scanned whole, however
    long. Each row is scanned by itself, so repeated rows give repeated results, null doc_ids stay
    as they are, other columns aren't read; an empty table gives an empty one.
    """
    base = [i for i, r in enumerate(rules) if r.base]
    rows = with_spans(docs.select("doc_id", "text"), "_spans", rules).drop("text")
    ours = F.filter("_spans", lambda s: s.number.isin(base))
    of = lambda i: F.filter("_spans", lambda s: s.number == i)
    counts = [F.size(of(i)).cast("long").alias(f"n_{rules[i].kind}") for i in base]
    return rows.select("doc_id", *counts, F.sha2(_listed(ours, rules).cast("binary"), 256).alias("base_sha256"), _listed(F.col("_spans"), rules).alias("spans"))


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each secret, or run of secrets that overlap, replaced by its first kind in brackets.

    All rows and columns stay, whatever their names; n_chars, where there is one, follows the new
    text. Texts without secrets, null ones too, are left as they are. Rows that repeat give
    repeated results; an empty table gives an empty one.
    """
    (spans,) = free_names(docs, "spans")
    rows = with_spans(docs, spans, rules)
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    text = F.col("text")

    def cut(acc: Column, s: Column) -> Column:
        new = F.concat(acc.out, F.substring(text, acc.pos + 1, s.start - acc.pos), F.lit("["), F.element_at(kinds, s.number + 1), F.lit("]"))
        return F.struct(F.greatest(acc.pos, s.end).alias("pos"), F.when(s.start >= acc.pos, new).otherwise(acc.out).alias("out"))

    cleaned = F.aggregate(spans, F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), cut, lambda acc: F.concat(acc.out, F.substring(text, acc.pos + 1, F.length(text))))
    found = F.size(spans) > 0
    rows = rows.withColumn("text", F.when(found, cleaned).otherwise(text))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(found, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
