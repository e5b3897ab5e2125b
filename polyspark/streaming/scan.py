"""Patches that arrive as a stream, merged into the map of their scene.

The map is kept line by line and cell by cell in keyed state: a new line reads the cells around its own ends and writes what it
changes, so a batch costs what arrives, not what is known. The stream gives events of versions, ``born`` when a line enters the map and
``died`` when another takes it up; what a patch saw before it was merged are the versions alive at its place in the scan.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from polyspark.operators.linemap import ATTACH_RADIUS, Line, LineMap
from polyspark.operators.state import POINTS, as_array, as_points

EVENT = (
    "scene string, category string, line_type string, pos long, rank int, seq long, event string, at long, start_type string, end_type string,"
    f" points {POINTS}, source_points {POINTS}, source_image string"
)
_ORDER = "pos long, rank int, seq long"
_KEPT = "start_type string, end_type string, xs array<double>, ys array<double>, extra string"
_ENDS = "pos array<bigint>, rank array<int>, seq array<bigint>, side array<int>, xs array<double>, ys array<double>"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class StoredLines(LineMap):
    """A map whose lines, cells and signatures are keyed state."""

    def __init__(self, handle: StatefulProcessorHandle, radius: float):
        super().__init__(radius)
        self.line_state = handle.getMapState("lines", _ORDER, _KEPT)
        self.cell_state = handle.getMapState("cells", "x long, y long", _ENDS)
        self.sign_state = handle.getMapState("signatures", "sign string", "n int")
        self.count_state = handle.getValueState("count", "n long")

    def next_number(self) -> int:
        n = (self.count_state.get()[0] if self.count_state.exists() else 0) + 1
        self.count_state.update((n,))
        return n

    def put(self, line: Line) -> None:
        x, y = line.points.T.tolist() if len(line.points) else ([], [])
        self.line_state.updateValue(line.order, (*line.kinds, x, y, json.dumps(line.extra)))

    def pop(self, order: tuple) -> Line:
        start, end, x, y, extra = self.line_state.getValue(order)
        self.line_state.removeKey(order)
        return Line(order, np.column_stack([x, y]).reshape(-1, 2), (start, end), json.loads(extra))

    def mark(self, signature: tuple) -> bool:
        key = (repr(signature),)
        if self.sign_state.containsKey(key):
            return False
        self.sign_state.updateValue(key, (1,))
        return True

    def ends(self, at: tuple[int, int]) -> dict:
        if not self.cell_state.containsKey(at):
            return {}
        return {((p, r, s), side): np.array([x, y]) for p, r, s, side, x, y in zip(*self.cell_state.getValue(at))}

    def put_ends(self, at: tuple[int, int], ends: dict) -> None:
        if ends:
            rows = [(*order, side, float(p[0]), float(p[1])) for (order, side), p in ends.items()]
            self.cell_state.updateValue(at, tuple(list(c) for c in zip(*rows)))
        elif self.cell_state.containsKey(at):
            self.cell_state.removeKey(at)


class Merger(StatefulProcessor):
    """Adds the lines of one scene and kind, in the order of ``pos`` and ``rank`` within a batch."""

    def __init__(self, radius: float = ATTACH_RADIUS):
        self.radius = radius

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = StoredLines(handle, self.radius)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["pos", "rank"], kind="stable")
        out = []
        for r in batch.itertuples(index=False):
            source = {} if r.source_image is None else {"source_points": [dict(p) for p in (r.source_points if r.source_points is not None else [])], "source_image": r.source_image}
            order = (int(r.pos), int(r.rank), self.lines.next_number())
            born, gone = self.lines.add(Line(order, as_array(r.points), (r.start_type, r.end_type), source))
            for event, line in (("died", gone), ("born", born)):
                if line is not None:
                    out.append((*key, *line.order, event, order[0], *line.kinds, as_points(line.points), line.extra.get("source_points"), line.extra.get("source_image")))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in EVENT.replace(POINTS, "p").split(",")])

    def close(self) -> None:
        pass


def merge_stream(lines: DataFrame, radius: float = ATTACH_RADIUS) -> DataFrame:
    """Events of versions, as in ``EVENT``, of a stream of lines as ``map_versions`` takes them; ``at`` is the patch that caused the event.

    Patches of a scene should arrive in scan order; one that comes late is merged when it comes. The session gets the RocksDB state
    store, which keyed state needs, unless another provider is set.
    """
    conf = lines.sparkSession.conf
    if "RocksDB" not in conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    for c, kind in (("source_points", POINTS), ("source_image", "string")):
        if c not in lines.columns:
            lines = lines.withColumn(c, F.lit(None).cast(kind))
    rows = lines.select(
        F.col("scene").cast("string").alias("scene"), F.coalesce("category", F.lit("")).alias("category"), F.coalesce("line_type", F.lit("")).alias("line_type"),
        F.col("pos").cast("long").alias("pos"), F.col("rank").cast("int").alias("rank"), "start_type", "end_type", "points", "source_points", "source_image",
    )
    return rows.groupBy("scene", "category", "line_type").transformWithStateInPandas(Merger(radius), EVENT, "Append", "None")


def versions_of(events: DataFrame) -> DataFrame:
    """The events of a stream as versions, as ``map_versions`` gives them."""
    key = ["scene", "category", "line_type", "pos", "rank", "seq"]
    born = events.filter("event = 'born'").drop("event", "at")
    died = events.filter("event = 'died'").select(*key, F.col("at").alias("died"))
    return born.join(died, key, "left").select("scene", "pos", "rank", "seq", "died", "category", "line_type", "start_type", "end_type", "points", "source_points", "source_image")


def start_scan(lines: DataFrame, path: str, checkpoint: str, radius: float = ATTACH_RADIUS, each: Callable[[SparkSession, int], None] | None = None) -> StreamingQuery:
    """Starts the merge of what is there now; events go to Parquet under ``path``, a folder for each batch.

    A repeated batch replaces its folder, so events are there once. ``each`` is called after every batch, for example to project the
    patches of the batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")
        if each:
            each(batch.sparkSession, number)

    stream = merge_stream(lines, radius).writeStream.outputMode("append").foreachBatch(write)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
