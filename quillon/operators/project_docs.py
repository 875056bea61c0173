"""Project documentation as a table function: directives ``package``, ``modules`` and ``api``."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

#: What a row of the argument is: requests come first, then files by path.
REQUEST, FILE = 0, 1
NEEDED = {"project", "kind", "request_no", "directive", "arguments", "path", "text"}


def quoted(value: str) -> str:
    """A code span around a value, a blank at each side of it."""
    longest, run = 0, 0
    for c in value:
        run = run + 1 if c == "`" else 0
        longest = max(longest, run)
    ticks = "`" * (longest + 1)
    return f"{ticks} {value} {ticks}"


class ProjectDocs:
    """``SELECT * FROM project_docs(TABLE(rows))``: results of each project's requests from its files.

    Rows are requests (kind 0: request_no, directive, arguments as a JSON list) and files (kind 1: path,
    text) of a project. The function asks to be called project by project, requests first, so it
    holds a project's requests, and files go by one at a time: ``modules`` gives a part for each file.

    package [label]: name and version from ``Cargo.toml``. modules: each ``src/**/*.rs`` with its
    number of lines. api name: a heading, a standard call that includes the entity's source, a
    closing text. Results: project, request_no, part, kind (text, standard_call), markdown (the
    arguments of a call), error (project_material and why), path.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("project_docs takes a table")
        given = {f.name for f in rows.dataType.fields}
        if missing := sorted(NEEDED - given):
            raise ValueError(f"project_docs misses the columns {missing}")
        kind = rows.dataType["project"].dataType
        out = StructType().add("project", kind).add("request_no", LongType()).add("part", IntegerType()).add("kind", StringType()).add("markdown", StringType()).add("error", StringType()).add("path", StringType())
        return AnalyzeResult(out, partitionBy=[PartitioningColumn("project")], orderBy=[OrderingColumn("kind"), OrderingColumn("request_no"), OrderingColumn("path")])

    def __init__(self):
        self.project = None
        self.waiting: dict[str, list[tuple[int, str]]] = {"package": [], "modules": []}
        self.parts = 0
        self.package_seen = False

    def eval(self, row) -> Iterator[tuple]:
        self.project = row["project"]
        if row["kind"] == REQUEST:
            yield from self._asked(row["request_no"], row["directive"], row["arguments"])
        elif row["path"] == "Cargo.toml" and self.waiting["package"]:
            self.package_seen = True
            try:
                package = tomllib.loads(row["text"] or "")["package"]
                said, error = f"{quoted(package['name'])}, version {quoted(package['version'])}.\n", None
            except (tomllib.TOMLDecodeError, KeyError, TypeError) as e:
                said, error = "", f"project_material: Cargo.toml: {type(e).__name__}"
            for no, label in self.waiting["package"]:
                yield (self.project, no, 0, "text", None if error else f"{label}: {said}", error, row["path"])
        elif (row["path"] or "").startswith("src/") and row["path"].endswith(".rs") and self.waiting["modules"]:
            text = row["text"] or ""
            n = text.count("\n") + (not text.endswith("\n") and text != "")
            for no, _ in self.waiting["modules"]:
                yield (self.project, no, self.parts, "text", f"- {quoted(row['path'])}: {n} source lines.\n", None, row["path"])
            self.parts += 1

    def _asked(self, no: int, directive: str, arguments: str) -> Iterator[tuple]:
        given = json.loads(arguments or "[]")
        one_line = lambda x: isinstance(x, str) and x.strip() and not set(x) & {"\r", "\n"}
        error = None
        if directive == "package":
            if len(given) > 1 or given and not one_line(given[0]):
                error = "package takes one nonempty label on one line at most"
            else:
                self.waiting["package"].append((no, given[0] if given else "Package"))
        elif directive == "modules":
            if given:
                error = "modules takes no arguments"
            else:
                self.waiting["modules"].append((no, ""))
        elif directive == "api":
            if len(given) != 1 or not one_line(given[0]):
                error = "api takes one nonempty name on one line"
            else:
                call = json.dumps({"positional": ["src/model.rs"], "named": {"id": [given[0]]}}, separators=(",", ":"), ensure_ascii=False)
                yield (self.project, no, 0, "text", f"## API {quoted(given[0])}\n\nThe model defines this interface.", None, None)
                yield (self.project, no, 1, "standard_call", call, None, None)
                yield (self.project, no, 2, "text", "The source above keeps its bytes and its place.", None, None)
        else:
            error = f"unknown directive {directive}"
        if error:
            yield (self.project, no, 0, "text", None, f"project_material: {error}", None)

    def terminate(self) -> Iterator[tuple]:
        if not self.package_seen:
            for no, _ in self.waiting["package"]:
                yield (self.project, no, 0, "text", None, "project_material: no Cargo.toml", None)
        if not self.parts:
            for no, _ in self.waiting["modules"]:
                yield (self.project, no, 0, "text", None, "project_material: no modules beneath src/", None)


def register(spark: SparkSession) -> None:
    """Make ``project_docs`` known to a session's SQL."""
    spark.udtf.register("project_docs", F.udtf(ProjectDocs))


def documented(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Results of requests (project, request_no, directive, arguments) from files (project, path, text)."""
    spark = requests.sparkSession
    register(spark)
    none = F.lit(None).cast("string")
    kind = requests.schema["project"].dataType
    asked = requests.select("project", F.lit(REQUEST).alias("kind"), F.col("request_no").cast("long").alias("request_no"), "directive", "arguments", none.alias("path"), none.alias("text"))
    given = files.select(F.col("project").cast(kind).alias("project"), F.lit(FILE).alias("kind"), F.lit(None).cast("long").alias("request_no"), none.alias("directive"), none.alias("arguments"), "path", "text")
    # Files that no directive looks at stay where they are.
    given = given.where((F.col("path") == "Cargo.toml") | (F.col("path").startswith("src/") & F.col("path").endswith(".rs")))
    return spark.sql("SELECT * FROM project_docs(TABLE({rows}))", rows=asked.unionByName(given))
