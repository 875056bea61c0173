"""When to run a round again: what a publisher knows of its rounds, facts and changes, as keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillon.operators.tables import written

ACTIONS = "root string, seq long, action string, path string"
IDLE, RUNNING, FAILED = "idle", "running", "failed"


class Supervisor(StatefulProcessor):
    """State of one root: the round's status, the facts it knows, and the values of paths that it doesn't.

    Events (root, seq, kind, path, value) of a root come in the order of seq:

    * begin: a round starts; its sample is taken now, so changes up to this seq are in it, and come late.
    * fact: a path's value in the sample of the round that began last.
    * change: a path has a value now. It counts if the path is known and the value another one. Of unknown
      paths each new value counts once, and only after a failure, which it may repair.
    * rescan: changes were lost; everything counts as changed, also what a sample has taken in since.
    * ok, failed: the round ended.

    Actions: round (run one), retry (run one after a failure), publish (the round that ended holds),
    discard (something moved while it ran). A round is asked for once, until it begins; what moves
    meanwhile is in its sample.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "status string, baseline long, moved boolean, asked boolean, rescan boolean")
        self.facts = handle.getMapState("facts", "path string", "value string, seq long")
        self.strange = handle.getMapState("strange", "path string", "value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, baseline, moved, asked, rescan = self.status.get() if self.status.exists() else (IDLE, -1, False, False, False)
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out: list[tuple] = []

        def ask(seq: int, path: str | None) -> None:
            nonlocal asked
            if not asked:
                asked = True
                out.append((key[0], seq, "retry" if status == FAILED else "round", path))

        for seq, kind, path, value in zip(events["seq"].tolist(), events["kind"], events["path"], events["value"], strict=True):
            if kind == "begin":
                status, baseline, moved, asked = RUNNING, seq, False, False
            elif kind == "fact":
                self.facts.updateValue((path,), (value, baseline))
                if self.strange.containsKey((path,)):
                    self.strange.removeKey((path,))
            elif kind == "rescan":
                rescan = True
                if status != RUNNING:
                    rescan = False
                    ask(seq, None)
            elif kind == "change" and seq > baseline:
                known = self.facts.getValue((path,)) if self.facts.containsKey((path,)) else None
                if known is not None and known[1] == baseline:
                    if known[0] != value:
                        self.facts.updateValue((path,), (value, baseline))
                        moved = moved or status == RUNNING
                        if status != RUNNING:
                            ask(seq, path)
                elif not self.strange.containsKey((path,)) or self.strange.getValue((path,))[0] != value:
                    self.strange.updateValue((path,), (value,))
                    if status == FAILED:
                        ask(seq, path)
            elif kind in ("ok", "failed"):
                again = moved or rescan
                status = FAILED if kind == "failed" else IDLE
                if kind == "ok":
                    out.append((key[0], seq, "discard" if again else "publish", None))
                moved, rescan = False, False
                if again:
                    ask(seq, None)
        self.status.update((status, baseline, moved, asked, rescan))
        yield pd.DataFrame(out, columns=["root", "seq", "action", "path"])

    def close(self) -> None:
        pass


def supervised(events: DataFrame) -> DataFrame:
    """A stream of actions (root, seq, action, path) from a stream of events, see ``Supervisor``.

    State of a root is its facts and what it has seen beside them. The session needs a state store
    with column families (RocksDB's). Events of a root must arrive in the order of seq, however they are cut into batches.
    """
    return events.groupBy("root").transformWithStateInPandas(statefulProcessor=Supervisor(), outputStructType=ACTIONS, outputMode="append", timeMode="none")


def until_nothing_new(start: DataFrame, step: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """All that is reached from ``start`` by ``step``, each once: key, round (0 for the start).

    A round looks at what the last one brought alone, and ends when it brings nothing new; as a
    subscription to a folder shows folders to subscribe to. Each round's rows are written.
    """
    fresh = written(start.select(key).distinct().withColumn("round", F.lit(0)), "reached")
    found, number = fresh, 0
    while fresh.head(1):
        number += 1
        more = step(fresh.select(key)).select(key).where(F.col(key).isNotNull()).distinct()
        fresh = written(more.join(found.select(key), key, "left_anti").withColumn("round", F.lit(number)), "reached")
        found = found.unionByName(fresh)
    return found
