"""Plugins: table functions that see one batch of requests of their directives."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "request_no long, owner string, markdown string, error string"


@dataclass
class Registry:
    """Plugins by id and the directives that each owns; a name owned twice must be listed as an override."""

    run: dict[str, Callable] = field(default_factory=dict)
    owners: dict[str, str] = field(default_factory=dict)
    contracts: dict[str, str] = field(default_factory=dict)

    def add(self, plugin: str, directives: list[str], run: Callable, override: tuple[str, ...] = (), contract: str = "page") -> None:
        """``contract``: ``request``, ``page`` or ``whole``, see ``run_plugins``."""
        if contract not in ("request", "page", "whole"):
            raise ValueError(f"{contract!r} is no contract")
        if plugin in self.run:
            raise ValueError(f"plugin {plugin} is there already")
        if not set(override) <= set(directives):
            raise ValueError("an override must be one of the plugin's directives")
        for name in directives:
            if name in self.owners and name not in override:
                raise ValueError(f"directive {name} belongs to {self.owners[name]}")
            self.owners[name] = plugin
        self.run[plugin] = run
        self.contracts[plugin] = contract

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(sorted(self.owners.items()), "name string, owner string")


def run_plugins(requests: DataFrame, registry: Registry, pages: str = "path", inputs: DataFrame | None = None) -> DataFrame:
    """Results of all requests (request_no, owner, path, name, arguments): request_no, owner, markdown, error.

    What a plugin gets in one call is its contract, and holds at any size. ``request``: it answers each
    request by itself, so calls get any of them, where they are; nothing is shuffled, and a page with
    any share of the requests is many tasks. ``page``: the requests of one page, in order; calls run
    in many tasks, each page in one. ``whole``: all that the round asks of it, and the
    whole list of ``inputs`` (path, ...), also if there is no request: exactly one call. Such a
    plugin is given two iterators of Arrow batches, inputs in the order of their paths and requests
    in theirs, and yields batches of results; its one task streams them and holds neither. A
    plugin by page without a request isn't called.
    """
    run = registry.run
    whole = sorted(p for p in run if registry.contracts[p] == "whole")
    single = sorted(p for p in run if registry.contracts[p] == "request")
    by_page = requests.where(~F.col("owner").isin(whole + single)) if whole or single else requests

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for owner, own in pdf.groupby("owner", sort=False):
                yield run[owner](own).assign(owner=owner).reindex(columns=["request_no", "owner", "markdown", "error"])

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        owner = pdf["owner"].iloc[0]
        out = run[owner](pdf.sort_values("request_no", kind="stable"))
        return out.assign(owner=owner).reindex(columns=["request_no", "owner", "markdown", "error"])

    found = []
    if single:
        found.append(requests.where(F.col("owner").isin(single)).mapInPandas(each, RESULT))
    if len(whole) + len(single) < len(run) or not run:
        found.append(by_page.groupBy("owner", pages).applyInPandas(page, RESULT))
    if whole:
        found.append(_whole(requests, registry, whole, inputs))
    return reduce(DataFrame.unionByName, found)


def _whole(requests: DataFrame, registry: Registry, names: list[str], inputs: DataFrame | None) -> DataFrame:
    """One call for each of these plugins: a mark, the inputs and its requests, in this order, in one task."""
    spark, run = requests.sparkSession, registry.run
    own = requests.drop("owner").columns
    inputs = spark.createDataFrame([], "path string") if inputs is None else inputs
    held = lambda df: F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    owners = spark.createDataFrame([(n,) for n in names], "owner string")
    none = F.lit(None)
    marks = owners.select("owner", F.lit(0).alias("_kind"), none.cast("string").alias("_by"), none.cast("long").alias("_no"), none.cast("string").alias("_row"))
    each = inputs.select(F.explode(F.array(*map(F.lit, names))).alias("owner"), F.lit(1).alias("_kind"), F.col("path").alias("_by"), none.cast("long").alias("_no"), held(inputs).alias("_row"))
    asked = requests.where(F.col("owner").isin(names))
    asked = asked.select("owner", F.lit(2).alias("_kind"), none.cast("string").alias("_by"), F.col("request_no").cast("long").alias("_no"), held(requests.select(own)).alias("_row"))
    rows = marks.unionByName(each).unionByName(asked).repartition("owner").sortWithinPartitions("owner", "_kind", "_by", "_no")

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Runs(batches)
        while (owner := stream.owner()) is not None:
            stream.skip(owner, 0)
            for out in run[owner](stream.rows(owner, 1), stream.rows(owner, 2)):
                yield pa.RecordBatch.from_pydict({"request_no": out["request_no"], "owner": pa.array([owner] * len(out), pa.string()), "markdown": out["markdown"], "error": out["error"]}, schema=_ARROW)
            stream.skip(owner, 1)
            stream.skip(owner, 2)

    return rows.mapInArrow(call, RESULT)


_ARROW = pa.schema([("request_no", pa.int64()), ("owner", pa.string()), ("markdown", pa.string()), ("error", pa.string())])


class _Runs:
    """Batches of rows sorted by (owner, kind), handed out run by run without holding more than a batch."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.batches, self.now, self.at = batches, None, 0

    def _more(self) -> bool:
        while self.now is None or self.at >= self.now.num_rows:
            self.now, self.at = next(self.batches, None), 0
            if self.now is None:
                return False
        return True

    def owner(self) -> str | None:
        return self.now["owner"][self.at].as_py() if self._more() else None

    def rows(self, owner: str, kind: int) -> Iterator[list[dict]]:
        """Lists of rows of one kind, as they come."""
        while self._more() and self.now["owner"][self.at].as_py() == owner and self.now["_kind"][self.at].as_py() == kind:
            out = []
            while self.at < self.now.num_rows and self.now["owner"][self.at].as_py() == owner and self.now["_kind"][self.at].as_py() == kind:
                out.append(json.loads(self.now["_row"][self.at].as_py() or "null"))
                self.at += 1
            yield out

    def skip(self, owner: str, kind: int) -> None:
        for _ in self.rows(owner, kind):
            pass


def external(command: list[str], plugin: str, timeout: float = 30.0) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A plugin in a process of its own: one JSON object a line, ``initialize`` and ``run`` in, ``ready`` and ``result`` out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = [{"id": f"d{n}", "directive": d, "arguments": a} for n, d, a in zip(pdf["request_no"], pdf["name"], pdf["arguments"], strict=True)]
        said = [{"type": "initialize", "protocol_version": 1, "plugin": plugin}, {"type": "run", "batch_id": "b1", "input_files": sorted(pdf["path"].unique().tolist()), "requests": asked}]
        done = subprocess.run(command, input="".join(json.dumps(x) + "\n" for x in said), capture_output=True, text=True, timeout=timeout, check=True)
        answers = [json.loads(x) for x in done.stdout.splitlines()]
        if [a.get("type") for a in answers] != ["ready", "result"] or answers[1].get("batch_id") != "b1":
            raise ValueError(f"plugin {plugin} broke the protocol")
        results = {r["id"]: r for r in answers[1]["results"]}
        if results.keys() != {a["id"] for a in asked}:
            raise ValueError(f"plugin {plugin} must answer each request once")
        rows = [results[a["id"]] for a in asked]
        return pd.DataFrame({"request_no": pdf["request_no"].to_numpy(), "markdown": [r.get("markdown") for r in rows], "error": [r.get("code") for r in rows]})

    return run
