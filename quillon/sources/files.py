"""Source files as tables: selection, decoding, fingerprints; the project's settings."""

from __future__ import annotations

import re
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import under
from quillon.operators.structure import language

#: Fixed value: what a directive may be called.
DIRECTIVE_NAME = r"[a-z][a-z0-9_-]*(?:\.[a-z][a-z0-9_-]*)*"
#: The engine's own directives.
BUILT_IN = ("include", "link")
#: Folders that are never read.
SKIPPED = (".git", "target", "node_modules", ".quillon")
OUTPUTS = ("pages", "reports", "search")


def valid_path(path: Column) -> Column:
    """A relative path without empty, ``.`` or ``..`` components or control characters."""
    return ~path.rlike(r"(^|/)(\.{0,2})(/|$)|[\x00-\x1f\x7f]")


def excluded(path: Column, prefixes: tuple[str, ...] = (), output: str | None = None) -> Column:
    out = F.exists(F.split(path, "/"), lambda x: x.isin(*SKIPPED))
    for p in (*prefixes, *(f"{output}/{o}" for o in OUTPUTS if output)):
        out = out | under(path, p)
    return out


def select_inputs(found: DataFrame, explicit: DataFrame, prefixes: tuple[str, ...] = (), output: str | None = None) -> DataFrame:
    """Inputs, each once: path, error. Both tables have ``path``.

    What a listing found is taken if its path is valid, its suffix supported, and nothing excludes
    it; the rest is passed over. What is named explicitly is never passed over: it has ``error``
    invalid_path or unsupported_file instead.
    """
    valid, known = valid_path(F.col("path")), language(F.col("path")).isNotNull()
    named = explicit.select("path", F.when(~valid, "invalid_path").when(~known, "unsupported_file").alias("error"))
    listed = found.where(valid & known & ~excluded(F.col("path"), prefixes, output)).select("path", F.lit(None).cast("string").alias("error"))
    return listed.unionByName(named).groupBy("path").agg(F.max("error").alias("error"))


def scan(spark: SparkSession, root: str, prefixes: tuple[str, ...] = (), output: str | None = None, pattern: str = "*") -> DataFrame:
    """Supported files below a root: path, content, n_bytes, sha256. Spark lists and reads them where they lie."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = re.sub(r"^\w+://[^/]*", "", root).rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^\w+:(//)?(?=/)", ""), f"^{re.escape(base)}/", "")
    rows = raw.select(path.alias("path"), "content", F.col("length").alias("n_bytes"), "modificationTime")
    rows = rows.where(valid_path(F.col("path")) & ~excluded(F.col("path"), prefixes, output) & language(F.col("path")).isNotNull())
    return rows.withColumn("sha256", F.sha2("content", 256))


def decoded(files: DataFrame) -> DataFrame:
    """Files with ``text`` or ``error``: invalid_utf8, byte_order_mark, nul."""
    text = F.try_validate_utf8(F.decode("content", "UTF-8"))
    raw = F.col("content").cast("string")
    error = (
        F.when(F.substring("content", 1, 3) == F.lit(b"\xef\xbb\xbf"), "byte_order_mark")
        .when(~F.is_valid_utf8(raw), "invalid_utf8")
        .when(raw.contains("\x00"), "nul")
    )
    # What isn't valid is replaced by U+FFFD; from the first one on, the bytes differ.
    before = F.when(F.col("error") == "nul", F.substring_index(raw, "\x00", 1)).when(F.col("error") == "invalid_utf8", _valid_prefix(raw)).when(F.col("error").isNotNull(), F.lit(""))
    return files.withColumn("error", error).withColumns({"text": F.when(F.col("error").isNull(), text), "error_byte": F.octet_length(before), "error_line": F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1})


def _valid_prefix(raw: Column) -> Column:
    """The characters before the first byte that is no UTF-8."""
    parts = F.split(F.make_valid_utf8(raw), "\ufffd")
    # A part ends at a real U+FFFD as long as the bytes up to there are the same.
    upto = lambda i: F.array_join(F.slice(parts, 1, i), "\ufffd")
    same = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: F.substring(F.col("content"), F.lit(1), F.octet_length(upto(i))) == F.encode(upto(i), "UTF-8"))
    return upto(F.array_max(same))


def settings(text: str) -> dict:
    """A project's TOML settings: a closed set of keys, checked."""
    got = tomllib.loads(text)
    if got.get("config_version") != 1:
        raise ValueError("config_version must be 1")
    if extra := got.keys() - {"config_version", "inputs", "plugins"}:
        raise ValueError(f"unknown keys: {sorted(extra)}")
    if extra := got.get("inputs", {}).keys() - {"exclude"}:
        raise ValueError(f"unknown keys of inputs: {sorted(extra)}")
    owners: dict[str, str] = {}
    for name, plugin in got.get("plugins", {}).items():
        if not re.fullmatch(r"[a-z][a-z0-9_-]*", name):
            raise ValueError(f"{name!r} is no plugin id")
        if extra := plugin.keys() - {"command", "directives", "override", "timeout_ms", "options"}:
            raise ValueError(f"unknown keys of {name}: {sorted(extra)}")
        if not plugin.get("command") or not plugin.get("directives"):
            raise ValueError(f"{name} needs a command and directives")
        if bad := [d for d in plugin["directives"] if not isinstance(d, str) or not re.fullmatch(DIRECTIVE_NAME, d)]:
            raise ValueError(f"{name}: {bad} are no directive names")
        if len(set(plugin["directives"])) < len(plugin["directives"]):
            raise ValueError(f"{name} lists a directive twice")
        override = plugin.get("override", [])
        if bad := [d for d in override if d not in BUILT_IN]:
            raise ValueError(f"{name}: {bad} aren't the engine's, so they can't be overridden")
        for directive in plugin["directives"]:
            if directive in owners:
                raise ValueError(f"directive {directive} belongs to {owners[directive]} and to {name}")
            if directive in BUILT_IN and directive not in override:
                raise ValueError(f"{name}: {directive} is the engine's; list it under override to replace it")
            owners[directive] = name
        if not set(override) <= set(plugin["directives"]) or len(set(override)) < len(override):
            raise ValueError(f"{name} overrides what it doesn't own")
        if plugin.setdefault("timeout_ms", 30_000) < 1:
            raise ValueError(f"{name}: timeout_ms must be positive")
    return got
