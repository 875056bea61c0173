"""Numbered clauses of specifications: their definitions, requests for them, what belongs to each, its fingerprint."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.hashing import content_id
from quillon.operators import structure

#: Fixed value: how a clause is named.
CLAUSE = r"SPEC-[A-Z]+-[0-9]{3}"


def definitions(files: DataFrame, pattern: str = CLAUSE, key: str = "path", text: str = "text") -> DataFrame:
    """Headings of the second level that begin with a clause's name: clause, path, start_byte, end_byte, anchors, valid.

    ``anchors`` counts the explicit anchors in the file whose id is the name in lower case; with
    exactly one the definition is valid. Headings in fenced code define nothing.
    """
    heads = structure.sections(files, key, text).where("level = 2")
    heads = heads.select(F.regexp_extract("title", rf"^({pattern})\b", 1).alias("clause"), key, "start_byte", "end_byte").where("clause != ''")
    ids = files.select(F.col(key).alias("_in"), F.explode(F.regexp_extract_all(text, F.lit(r'<a id="([^"]+)"></a>'), F.lit(1))).alias("_id"))
    counts = ids.groupBy("_in", "_id").agg(F.count("*").alias("_n"))
    got = heads.join(counts, (F.col(key) == F.col("_in")) & (F.lower("clause") == F.col("_id")), "left")
    n = F.coalesce("_n", F.lit(0))
    return got.select("clause", key, "start_byte", "end_byte", n.alias("anchors"), (n == 1).alias("valid"))


def mentions(files: DataFrame, pattern: str = CLAUSE, key: str = "path", text: str = "text") -> DataFrame:
    """Clauses that a file names anywhere, also within longer words, each once: path, clause."""
    return files.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).alias("clause"))


def resolved(requests: DataFrame, defined: DataFrame, pattern: str = CLAUSE) -> DataFrame:
    """Requests (clause, ...) with ``definition`` (path, start_byte, end_byte) or ``error``, of which one is null.

    Errors: invalid_arguments (null or no clause's name), clause_not_found, clause_ambiguous,
    clause_invalid_definition. Definitions come as one row a clause, so a request is never doubled.
    """
    place = F.struct("path", "start_byte", "end_byte")
    each = defined.groupBy(F.col("clause").alias("_clause")).agg(F.count("*").alias("_n"), F.bool_and("valid").alias("_valid"), F.min(place).alias("_place"))
    got = requests.join(each, F.col("clause") == F.col("_clause"), "left")
    error = (
        F.when(F.col("clause").isNull() | ~F.col("clause").rlike(f"^(?:{pattern})$"), "invalid_arguments")
        .when(F.col("_n").isNull(), "clause_not_found")
        .when(F.col("_n") > 1, "clause_ambiguous")
        .when(~F.col("_valid"), "clause_invalid_definition")
    )
    return got.select(*requests.columns, F.when(error.isNull(), F.col("_place")).alias("definition"), error.alias("error"))


def items(clauses: DataFrame, sites: DataFrame, tests: DataFrame, rows: DataFrame) -> DataFrame:
    """All that is reviewed of a clause, one row each: clause, kind, digest.

    clauses: clause, text; sites: clause, path, text; tests: clause, path, name, text; rows: clause,
    row_no, text. A site without text is no code and left out; a test without text counts by its
    name (kind ``unresolved``). Digests are of contents, each part behind its length; places in
    files are no part of them, so code that only moves needs no new review.
    """
    each = lambda df, kind, *parts: df.select("clause", kind.alias("kind"), content_id(kind, *parts).alias("digest"))
    one = F.lit
    test = F.when(F.col("text").isNull(), "unresolved").otherwise("test")
    return reduce(
        DataFrame.unionByName,
        [
            each(clauses, one("clause"), F.col("clause").cast("string"), F.col("text")),
            each(sites.where("text IS NOT NULL"), one("site"), F.col("path"), F.col("text")),
            each(tests, test, F.col("path"), F.col("name"), F.col("text")),
            each(rows, one("row"), F.col("row_no").cast("string"), F.col("text")),
        ],
    )


def fingerprints(found: DataFrame, key: str = "clause", digest: str = "digest", prefix: int = 4) -> DataFrame:
    """One hash for each key over the digests of its rows, in their order: key, fingerprint.

    Equal digests count each. A key may have any number of rows: digests with one beginning of
    ``prefix`` hex digits, which spread evenly, give a hash; at most 16^prefix of these give the key's.
    """
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256)
    parts = found.groupBy(key, F.substring(digest, 1, prefix).alias("_p")).agg(joined(F.col(digest)).alias("_h"))
    tops = F.transform(F.array_sort(F.collect_list(F.struct("_p", "_h"))), lambda x: x["_h"])
    return parts.groupBy(key).agg(F.sha2(F.array_join(tops, ""), 256).alias("fingerprint"))


def assembled(clauses: DataFrame, sites: DataFrame, tests: DataFrame, rows: DataFrame) -> DataFrame:
    """Each clause with what belongs to it: clause, sites, tests, unresolved, rows, state, fingerprint.

    Tables as in ``items``; what belongs to no clause is left out. ``state``: unsited, untested,
    unaccepted (no row of acceptance), else complete.
    """
    known = items(clauses, sites, tests, rows).join(clauses.select(F.col("clause").alias("_known")).distinct(), F.col("clause") == F.col("_known"), "left_semi")
    of = lambda kind: F.count_if(F.col("kind") == kind)
    counts = known.groupBy("clause").agg(of("site").alias("sites"), of("test").alias("tests"), of("unresolved").alias("unresolved"), of("row").alias("rows"))
    return counts.join(fingerprints(known), "clause").select("clause", "sites", "tests", "unresolved", "rows", _state().alias("state"), "fingerprint")


def _state() -> Column:
    return F.when(F.col("sites") == 0, "unsited").when(F.col("tests") == 0, "untested").when(F.col("rows") == 0, "unaccepted").otherwise("complete")
