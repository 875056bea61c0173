"""The engine as one object: build a snapshot of a source tree, search it, read from it, follow changes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.functions import hashing, maps
from quillon.functions import text as t
from quillon.operators import integrity, intervals, records, render, rounds, search, structure
from quillon.operators.tables import written
from quillon.sources import facts, resolver, snapshots
from quillon.sources import files as src
from quillon.sources.buckets import Buckets
from quillon.streaming import watch

#: Fields of a search and their columns; bodies are searched as a reader sees them.
COLUMNS = {"title": "title", "identifier": "identifiers", "path": "path", "body": "field"}
#: What a snapshot is made by; another version's is stale.
GENERATOR = "quillon 1"


class Stale(RuntimeError):
    """What is published no longer agrees with the source files."""


def read_cursor(cursor: str, snapshot: str) -> tuple[str, str, int]:
    """Record, list and offset of a cursor; ValueError if it is of another snapshot or malformed."""
    parts = cursor.split(":")
    if len(parts) != 4 or parts[0] != snapshot or parts[2] not in ("sources", "occurrences") or not parts[3].isdigit() or int(parts[3]) % search.PAGE:
        raise ValueError("the cursor doesn't belong to this snapshot")
    return parts[1], parts[2], int(parts[3])


class Engine:
    def __init__(self, spark: SparkSession, source: str, output: str, settings: str = "config_version = 1"):
        self.spark, self.source, self.output = spark, source.rstrip("/"), output.rstrip("/")
        self.settings, self._settings = src.settings(settings), settings
        #: A source that tasks can open themselves; Spark alone reads others.
        self.mounted = not re.match(r"\w+:", source) or source.startswith("file:")
        self.prefixes = tuple(self.settings.get("inputs", {}).get("exclude", []))

    def files(self) -> DataFrame:
        return src.decoded(src.scan(self.spark, self.source, self.prefixes, self._inside()))

    def listing(self) -> DataFrame:
        """The sources' paths and what tells whether one moved; no file is opened. Mounted sources alone."""
        root = re.sub(r"^file:(//)?", "", self.source)
        found = facts.entries(self.spark, root, src.SKIPPED)
        wanted = src.valid_path(F.col("path")) & ~src.excluded(F.col("path"), self.prefixes, self._inside()) & structure.language(F.col("path")).isNotNull()
        own = found.where((F.col("kind") == "file") & wanted)
        links = found.where((F.col("kind") == "link") & wanted).select("path")
        if not links.head(1):
            return own
        # A link to a file counts as that file, under its own path.
        to = resolver.resolve(links, found.select("path", "kind", "target")).where("node = 'file'").select(F.col("path").alias("_link"), "resolved")
        meant = found.withColumnRenamed("path", "_at").join(to, F.col("_at") == F.col("resolved"))
        return own.unionByName(meant.withColumn("path", F.col("_link")).select(*own.columns))

    def fingerprints(self, known: DataFrame | None = None) -> DataFrame:
        """path, sha256 and facts of the sources now. Of mounted sources only those are read whose facts moved since ``known``."""
        if self.mounted:
            return facts.fingerprints(self.listing(), known, re.sub(r"^file:(//)?", "", self.source))
        return src.scan(self.spark, self.source, self.prefixes, self._inside()).select("path", "sha256", "n_bytes")

    def sample(self, fingerprints: DataFrame) -> DataFrame:
        """All that a snapshot depends on: the generator, the settings, the sources."""
        one = lambda v: self.spark.createDataFrame([("", v)], "key string, value string")
        return rounds.sample(generator=one(GENERATOR), settings=one(self._settings), sources=fingerprints.select(F.col("path").alias("key"), F.col("sha256").alias("value")))

    def _inside(self) -> str | None:
        """The output folder as a path below the source, if it is: what is generated there is no input."""
        bare = lambda p: re.sub(r"^\w+:(//)?(?=/)", "", p)
        source, output = bare(self.source), bare(self.output)
        return output.removeprefix(source + "/") if output.startswith(source + "/") else None

    def rows(self, files: DataFrame) -> DataFrame:
        """Every leaf and segment of the files: path, position, kind, title, body, identifiers, start_byte, end_byte, source_runs, field, field_runs.

        A Markdown leaf carries the titles above it; code carries its words as identifiers.
        ``source_runs`` lead from the body to the file's bytes; ``field`` is what a reader sees of
        the body, without marks, and ``field_runs`` lead from it to the body.
        """
        md, code = (files.where(F.col("path").endswith(".md")), files.where(~F.col("path").endswith(".md")))
        leaves = structure.leaves(md)
        titles = structure.sections(md).select(F.col("path").alias("_path"), F.col("start_byte").alias("_start"), F.array_join("title_path", " / ").alias("title"))
        # The nearest heading at or before a leaf: both kinds of rows in order, the last title holds.
        both = leaves.select("path", "start_byte", F.lit(1).alias("_k"), F.struct("kind", "text", "end_byte").alias("leaf"), F.lit(None).cast("string").alias("_t")).unionByName(
            titles.select(F.col("_path").alias("path"), F.col("_start").alias("start_byte"), F.lit(0).alias("_k"), F.lit(None).cast(leaves.select(F.struct("kind", "text", "end_byte")).schema[0].dataType).alias("leaf"), F.col("title").alias("_t"))
        )
        both = both.withColumn("title", intervals.latest_before(both, "path", ["start_byte", "_k"], F.col("_t"))).where("leaf IS NOT NULL")
        prose = both.select("path", "start_byte", F.col("leaf.end_byte").alias("end_byte"), F.lit("prose").alias("kind"), "title", F.col("leaf.text").alias("body"), F.lit(None).cast("array<string>").alias("identifiers"))
        size = F.octet_length("body").cast("long")
        prose = prose.withColumn("source_runs", F.array(F.struct(F.lit(0).cast("long").alias("at"), size.alias("end"), F.col("start_byte").alias("src"), (F.col("start_byte") + size).alias("src_end"))))
        parts = structure.segments(code).where("kind != 'layout'")
        identifiers = F.when(F.col("kind") == "code", F.array_distinct(t.words(F.col("text"))))
        parts = parts.select("path", "start_byte", "end_byte", "kind", F.lit(None).cast("string").alias("title"), F.col("text").alias("body"), identifiers.alias("identifiers"), F.col("runs").alias("source_runs"))
        rows = prose.unionByName(parts)
        seen = maps.made(F.when(F.col("kind") == "prose", F.col("body")), "lf", "visible")
        whole = F.array(F.struct(F.lit(0).cast("long").alias("at"), size.alias("end"), F.lit(0).cast("long").alias("src"), size.alias("src_end")))
        rows = rows.withColumn("_seen", seen)
        rows = rows.withColumns({"field": F.coalesce("_seen.text", "body"), "field_runs": F.coalesce("_seen.runs", whole)}).drop("_seen")
        return records.positions(records.with_record_id(rows, "kind", "path", "body"), "path", "start_byte")

    def build(self) -> str:
        """Publish a snapshot of the source tree; a file that can't be decoded stops it. Returns the snapshot's id."""
        files = self.files()
        if bad := files.where("error IS NOT NULL").select("path", "error").head(5):
            raise ValueError(f"source_error: {[(r['path'], r['error']) for r in bad]}")
        rows = written(self.rows(files), "records")
        # The listing comes before the bytes are read: what is edited in between is read again at the next check.
        listed = self.listing() if self.mounted else None
        hashed = files.select("path", "sha256", "n_bytes")
        if listed is not None:
            more = listed.select(F.col("path").alias("_path"), "kind", "modified", "changed", "identity", "target")
            hashed = hashed.join(more, F.col("path") == F.col("_path"), "left").drop("_path").withColumn("error", F.lit(None).cast("string"))
        hashed = written(hashed, "files")
        inside = self._inside()
        pages_at = F.concat(F.lit(f"{inside}/" if inside else ""), render.page_path(F.col("path")))
        conflicts = snapshots.target_conflicts(hashed.select(pages_at.alias("path")), hashed.select("path") if inside is not None else hashed.select("path").where("false"))
        if bad := conflicts.head(5):
            raise ValueError(f"target_conflict: {[(r['path'], r['reason']) for r in bad]}")
        chunks = rows.select("path", "position", F.concat(F.when(F.col("kind") == "code", render.fenced_code(F.col("body"), structure.language(F.col("path")))).otherwise(F.col("body")), F.lit("\n\n")).alias("chunk"))
        pages = render.assembled(chunks, "path", "position", "chunk").withColumn("page", render.page_path(F.col("path")))
        ids = rows.select("record_id").union(hashed.select(hashing.content_id(F.col("path"), F.col("sha256"))))
        got = integrity.snapshot_identity(ids).head()
        snapshot = got["snapshot"] or hashing.base62(0)
        tables = {"records": rows.withColumn("handle", hashing.handles(F.col("record_id"), snapshot)), "files": hashed, "pages": pages, "sample": self.sample(hashed)}
        snapshots.publish(self.spark, self.output, tables, snapshot)
        return snapshot

    def check_fresh(self) -> None:
        """Stale unless generator, settings and the sources' bytes are those that the snapshot was made of.

        Mounted sources cost a listing; bytes are read where length, times or identity moved.
        """
        if stale := [r["component"] for r in self.freshness().where("changed > 0").collect()]:
            raise Stale(f"stale ({', '.join(sorted(stale))}): build again, or search the snapshot as it is")

    def freshness(self) -> DataFrame:
        """Component, changed, facts: how many facts of each component moved since the snapshot was made."""
        old = snapshots.table(self.spark, self.output, "files")
        return rounds.freshness(snapshots.table(self.spark, self.output, "sample"), self.sample(self.fingerprints(old)))

    def search(self, query: str, path: str | None = None, limit: int = 10, snapshot: bool = False) -> DataFrame:
        """Hits: handle, kind, path, title, snippet, matches, terms, term_count, exact, score, path_matches.

        ``path_matches`` says why a hit lies below ``path``: its page (input), the file it is from (source).
        """
        rows = self._asked(query, path, limit, snapshot)
        found = search.search(rows, COLUMNS, query, limit, None, ties=("path", "position", "record_id"))
        terms = t.query_terms(query)
        at = F.array_min(F.array(*(t.first_hit(F.col("body"), x) for x in terms))) if terms else F.lit(None).cast("int")
        found = self._placed(search.matched(found, COLUMNS, query))
        why = rounds.under_reasons(path, F.array("path"), F.array("path")) if path is not None else F.array().cast("array<string>")
        found = found.withColumn("path_matches", why)
        return found.select("handle", "kind", "path", "title", t.snippet(F.col("body"), at).alias("snippet"), "matches", "terms", "term_count", "exact", "score", "path_matches")

    def _placed(self, found: DataFrame) -> DataFrame:
        """Matches in bodies with their bytes in the body, ``body_range``, and in the file, ``source_range``; null for other fields."""
        # Places of the field are characters, maps count bytes.
        size = lambda n: F.octet_length(F.left("field", n)).cast("long")
        ranges = F.transform("matches", lambda m: F.when(m.field == "body", F.struct(size(m.start).alias("start"), size(m.end).alias("end"))))
        found = found.withColumn("_body", maps.source_ranges(F.col("field_runs"), ranges))
        found = found.withColumn("_source", maps.source_ranges(F.col("source_runs"), F.col("_body")))
        each = F.transform("matches", lambda m, i: F.struct(m.term.alias("term"), m.field.alias("field"), m.text.alias("text"), m.start.alias("start"), m.end.alias("end"), F.get("_body", i).alias("body_range"), F.get("_source", i).alias("source_range")))
        return found.withColumn("matches", each).drop("_body", "_source")

    def answer(self, query: str, path: str | None = None, limit: int = 10, snapshot: bool = False) -> dict:
        """The whole answer: snapshot, freshness, query_terms, total_matches, returned, truncated, hits (rows, at most ``limit``)."""
        total = search.scored(self._asked(query, path, limit, snapshot), COLUMNS, query).count()
        hits = self.search(query, path, limit, snapshot=True).collect()
        return {
            "snapshot": snapshots.current(self.spark, self.output), "freshness": "unchecked" if snapshot else "matched", "query_terms": t.query_terms(query),
            "total_matches": total, "returned": len(hits), "truncated": total > len(hits), "hits": hits,
        }

    def _asked(self, query: str, path: str | None, limit: int, snapshot: bool) -> DataFrame:
        search.check_query(query, limit)
        if not snapshot:
            self.check_fresh()
        rows = snapshots.table(self.spark, self.output, "records")
        return rows if path is None else rows.where(t.under(F.col("path"), path))

    def occurrences(self, handle: str, cursor: str | None = None) -> DataFrame:
        """A page of five of a record's places: path, position, start_byte, end_byte, total, next_cursor."""
        return self._listed(handle, "occurrences", cursor, ["path", "position", "start_byte", "end_byte"], ["path", "position"])

    def sources(self, handle: str, cursor: str | None = None) -> DataFrame:
        """A page of five of the spans that a record is made of, each once: path, start_byte, end_byte, total, next_cursor."""
        return self._listed(handle, "sources", cursor, ["path", "start_byte", "end_byte"], ["path", "start_byte", "end_byte"])

    def _listed(self, handle: str, name: str, cursor: str | None, columns: list[str], order: list[str]) -> DataFrame:
        snapshot = snapshots.current(self.spark, self.output)
        record, asked, offset = read_cursor(cursor, snapshot) if cursor else (handle, name, 0)
        if record != handle or asked != name:
            raise ValueError("the cursor belongs to another list")
        rows = snapshots.table(self.spark, self.output, "records", snapshot).where(F.col("handle") == handle)
        page = search.cursor_page(rows.select("handle", *columns).distinct(), "handle", order, snapshot, name, offset)
        if not page.head(1):
            raise ValueError("no such page")
        return page.select(*columns, "total", "next_cursor").orderBy(*order)

    def read(self, handle: str, offset: int = 0, context: int = 0) -> DataFrame:
        """A record's body from a byte offset on, its sources and, with ``context``, its neighbours on the page.

        The record and its neighbours share one budget of characters: the record first, the
        neighbours with what it leaves, in the order of the page.
        """
        if len(handle) != 11 or not handle.isalnum():
            raise ValueError("a handle has 11 letters and digits")
        rows = snapshots.table(self.spark, self.output, "records")
        hit = rows.where(F.col("handle") == handle)
        if not hit.head(1):
            raise KeyError("no such handle in this snapshot")
        if context:
            around = hit.select(F.col("path").alias("_path"), F.explode(F.sequence(F.col("position") - context, F.col("position") + context)).alias("_at"))
            hit = rows.join(around, (rows["path"] == around["_path"]) & (rows["position"] == around["_at"])).drop("_path", "_at")
        own = F.col("handle") == handle
        start = F.when(own, F.lit(offset)).otherwise(F.lit(0))
        # The budget counts the characters that are left behind the offset.
        left = hit.withColumn("_left", F.decode(F.substring(F.encode("body", "UTF-8"), start + 1, F.octet_length("body")), "UTF-8"))
        left = search.budgeted(left, "path", "position", "_left", search.BUDGET, own)
        source = F.struct("path", "start_byte", "end_byte")
        left = left.where(own | (F.col("shown") > 0)).withColumn("neighbour", F.when(own, F.lit(0)).otherwise(F.lit(1)))
        return left.select("handle", "kind", "path", "position", t.byte_slice(F.col("body"), start, F.col("shown").cast("int")).alias("body"), "neighbour", F.array(source).alias("sources")).orderBy("neighbour", "path", "position")

    def read_entity(self, path: str, title_path: list[str]) -> DataFrame:
        """A section of a current Markdown file by its titles; no snapshot is needed."""
        one = self.files().where(F.col("path") == path)
        hit = structure.sections(one).where(F.col("title_path") == F.array(*map(F.lit, title_path)))
        out = hit.join(one.select("path", "text"), "path")
        size = F.col("end_byte") - F.col("start_byte")
        return out.select("path", "title", "start_byte", "end_byte", F.decode(F.substring(F.encode("text", "UTF-8"), F.col("start_byte") + 1, size), "UTF-8").alias("body"))

    def stream(self, output: str, once: bool = True) -> StreamingQuery | DataFrame | None:
        """Keep the files' fingerprints under ``output`` current: new, edited and removed files.

        Once: what changed, None if nothing did. Else a query that compares again every second.
        """
        kept = Buckets(self.spark, output, "path")

        def listing() -> DataFrame:
            last = kept.current() if self.mounted else None
            return self.fingerprints(kept.read(last) if last is not None else None)

        if once:
            return watch.refresh(self.spark, output, listing, "path", ["sha256"])
        return watch.follow_listing(self.spark, output, listing, "path", ["sha256"])
