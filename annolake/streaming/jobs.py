"""Continuous maintenance: new annotations and changed lineage as streams of files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..plans import maintain
from ..schema import supervoxel_of
from ..store import children, current, exists, remove, replace, shared_dir, written


def _current(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def ingest(
    spark: SparkSession, source: str, schema, target: str, checkpoint: str, target_schema, points: list[str], voxels: DataFrame,
    scale: tuple, lines: DataFrame, when: str, files_per_batch: int = 100,
) -> StreamingQuery:
    """Look up segmentation for annotations that arrive as parquet, appending to ``target``.

    The anti-join with what is there makes a batch that is run again add nothing.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def batch(df: DataFrame, number: int) -> None:
        s = df.sparkSession
        there = _current(s, target, target_schema)
        new = maintain.ingested(df.dropDuplicates(["id"]), there, points, voxels, scale, lines, F.lit(when).cast("timestamp_ntz"))
        new.select(*[c for c in there.columns]).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Parts that the rows of a hot supervoxel are dealt to, in a group each; hot is one that more than this
#: share of a table's places have at the stream's beginning.
SALT, HOT = 16, 0.01
#: Places of a table that a group of supervoxels has, about; a group is a key of the state.
GROUP = 8192
#: Stands for no root in a state.
_NONE = -1
_NEWEST = np.dtype([("sv", "<i8"), ("since", "<i8"), ("root", "<i8")])
_ROWS = np.dtype([("sv", "<i8"), ("id", "<i8"), ("root", "<i8"), ("place", "<i4")])


def _records(frame: pd.DataFrame, kind: np.dtype, columns: list[str]) -> np.ndarray:
    out = np.empty(len(frame), kind)
    for name, c in zip(kind.names, columns, strict=True):
        out[name] = frame[c].to_numpy()
    return out


def _newest(rows: np.ndarray) -> np.ndarray:
    """The newest lineage row of each supervoxel, by supervoxel; of equally old ones that of the largest root."""
    rows = rows[np.lexsort((rows["root"], rows["since"], rows["sv"]))]
    return rows[np.append(rows["sv"][1:] != rows["sv"][:-1], True)] if len(rows) else rows


def _roots_of(sv: np.ndarray, newest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For supervoxels: whether one has a newest row, and its root."""
    if not len(newest):
        return np.zeros(len(sv), bool), np.zeros(len(sv), np.int64)
    at = np.minimum(np.searchsorted(newest["sv"], sv), len(newest) - 1)
    return newest["sv"][at] == sv, newest["root"][at]


class Refresher(StatefulProcessor):
    """What is known of a group of supervoxels: their newest lineage rows, and the root of each row that has one.

    Both are packed arrays, so that a group costs a few calls however many rows it has. Events of kind 0 are
    lineage rows, of kind 1 table rows. Gives (id, place, root_id) of what changed.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "packed binary")
        self.rows = handle.getValueState("rows", "packed binary")

    def _held(self, state, kind: np.dtype) -> np.ndarray:
        return np.frombuffer(bytes(state.get()[0]), kind) if state.exists() else np.empty(0, kind)

    def _taken(self, frames: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The newest lineage rows before and after some events, and the table rows among them."""
        events = pd.concat(list(frames), ignore_index=True)
        kind = events["kind"].to_numpy()
        before = self._held(self.newest, _NEWEST)
        now = before
        if (kind == 0).any():
            now = _newest(np.concatenate([before, _records(events[kind == 0], _NEWEST, ["supervoxel_id", "since", "root_id"])]))
            if not np.array_equal(now, before):
                self.newest.update((now.tobytes(),))
        return before, now, _records(events[kind == 1], _ROWS, ["supervoxel_id", "id", "root_id", "place"])

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        _, _, new = self._taken(iter([initialState]))
        if len(new):
            self.rows.update((np.concatenate([self._held(self.rows, _ROWS), new]).tobytes(),))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        before, now, new = self._taken(rows)
        known, was = _roots_of(now["sv"], before)
        moved = now[~known | (was != now["root"])]
        if not len(moved) and not len(new):
            return
        held = self._held(self.rows, _ROWS)
        here, root = _roots_of(held["sv"], moved)
        of_held = here & (held["root"] != root)
        there, newer = _roots_of(new["sv"], now)
        of_new = there & (new["root"] != newer)
        all_ = np.concatenate([held, new])
        stale = np.concatenate([of_held, of_new])
        all_["root"][stale] = np.concatenate([root, newer])[stale]
        if stale.any() or len(new):
            self.rows.update((all_.tobytes(),))
        if stale.any():
            some = all_[stale]
            yield pd.DataFrame({"id": some["id"], "place": some["place"], "root_id": some["root"]})

    def close(self) -> None:
        pass


def _line_events(lines: DataFrame, when: str, hot: list[int]) -> DataFrame:
    """Lineage rows in force at a time, one for each salt of their supervoxel; closed ones end here."""
    at = F.lit(when).cast("timestamp_ntz")
    now = lines.where((F.col("valid_from") <= at) & (at < F.col("valid_to")) & F.col("supervoxel_id").isNotNull())
    since = F.unix_micros(F.col("valid_from").cast("timestamp"))
    salts = F.explode(F.sequence(F.lit(0), F.when(F.col("supervoxel_id").isin(hot), SALT - 1).otherwise(0)))
    return now.select("supervoxel_id", salts.alias("salt"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"), F.lit(0).alias("place"), F.coalesce("root_id", F.lit(_NONE)).alias("root_id"), since.alias("since"))


def _row_events(rows: DataFrame, roots: list[str], hot: list[int]) -> DataFrame:
    """A table's rows as events of the supervoxels that they have."""
    each = [F.struct(F.col(supervoxel_of(r)).alias("supervoxel_id"), F.lit(i).alias("place"), F.coalesce(r, F.lit(_NONE)).cast("long").alias("root_id")) for i, r in enumerate(roots)]
    wide = rows.select("id", F.explode(F.array(*each)).alias("r")).where("r.supervoxel_id > 0")
    salt = F.when(F.col("r.supervoxel_id").isin(hot), F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).otherwise(0)
    return wide.select("r.supervoxel_id", salt.alias("salt"), F.lit(1).alias("kind"), "id", "r.place", "r.root_id", F.lit(0).cast("long").alias("since"))


def _begun(table: DataFrame, roots: list[str], checkpoint: str) -> tuple[list[int], int]:
    """Supervoxels, fewer than 1 / ``HOT``, that many rows have, and the number of groups. They stay those of the
    stream's first start, as a key must not change while its state is kept.
    """
    spark, path = table.sparkSession, f"{checkpoint}.hot"
    if not exists(spark, f"{path}/_SUCCESS"):
        each = written(_row_events(table, roots, []).groupBy("supervoxel_id").agg(F.count(F.lit(1)).alias("n")), "places")
        total = each.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // GROUP))
        spark.createDataFrame([(groups,)], "groups long").write.mode("overwrite").parquet(f"{checkpoint}.groups")
        each.where(F.col("n") > max(HOT * total, SALT)).select("supervoxel_id").write.mode("overwrite").parquet(path)
    hot = [r[0] for r in spark.read.schema("supervoxel_id long").parquet(path).collect()]
    return hot, spark.read.schema("groups long").parquet(f"{checkpoint}.groups").first()[0]


def refresh(
    spark: SparkSession, source: str, schema, target: str, checkpoint: str, roots: list[str], when: str, lines: DataFrame | None = None, files_per_batch: int = 100,
    arrivals: str | None = None,
) -> StreamingQuery:
    """Bring roots up to date as lineage rows arrive: of the rows in force at ``when``, the newest of
    each supervoxel counts - among those that arrive, those of earlier batches, and ``lines``, what
    was known before. So a closed row, or one that comes late or again, changes nothing.

    The stream keeps state by groups of supervoxels: their newest rows and the roots of the table's rows that have them.
    The table and ``lines`` are the state's beginning; new rows of the table come from ``arrivals``, a
    folder of parquet. A batch touches only the groups of supervoxels that it brings, whatever the table's size.
    What it changes is written as a delta (id, place of the root column, root) under its number, so a batch
    that is run again writes the same; ``latest_rows`` reads table and deltas, ``compacted`` puts them
    together. The checkpoint belongs to one target and list of roots.
    """
    own = spark.newSession()  # its state store is no setting of the caller's session
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(k, spark.conf.get(k))
    table = own.read.parquet(current(own, target))
    hot, groups = _begun(table, roots, checkpoint)
    begin = _row_events(table, roots, hot)
    if lines is not None:
        known = shared_dir(spark, "lines")
        lines.write.parquet(known)
        begin = begin.unionByName(_line_events(own.read.schema(lines.schema).parquet(known), when, hot))
    stream = _line_events(own.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source), when, hot)
    if arrivals:
        stream = stream.unionByName(_row_events(own.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_batch).parquet(arrivals), roots, hot))
    key = F.pmod(F.xxhash64("supervoxel_id", "salt"), F.lit(groups)).alias("part")
    changed = stream.select(key, "*").groupBy("part").transformWithStateInPandas(Refresher(), "id long, place int, root_id long", "Update", "None", initialState=begin.select(key, "*").groupBy("part"))

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{target}.delta/{number}")

    return changed.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_rows(spark: SparkSession, target: str, roots: list[str], arrivals: str | None = None) -> DataFrame:
    """A table's rows, and those that arrived since, with the roots that deltas brought, the newest of each."""
    base = spark.read.parquet(current(spark, target))
    if arrivals:
        base = base.unionByName(spark.read.schema(base.schema).parquet(arrivals).join(base.select("id"), "id", "left_anti").select(*base.columns))
    numbers = sorted(int(n) for n in children(spark, f"{target}.delta") if n.isdigit())
    numbers = [n for n in numbers if exists(spark, f"{target}.delta/{n}/_SUCCESS")]
    if not numbers:
        return base
    delta = spark.read.schema("id long, place int, root_id long").parquet(*[f"{target}.delta/{n}" for n in numbers])
    number = F.regexp_extract(F.col("_metadata.file_path"), r"\.delta/(\d+)/", 1).cast("long")
    newest = delta.select("id", "place", "root_id", number.alias("n")).groupBy("id").agg(*[F.max_by("root_id", F.when(F.col("place") == i, F.col("n"))).alias(f"_r{i}") for i in range(len(roots))])
    out = base.join(newest, "id", "left")
    # a column that no delta of the row names has no number, and so no root here
    return out.withColumns({r: F.when(F.col(f"_r{i}") == _NONE, None).otherwise(F.coalesce(f"_r{i}", r)) for i, r in enumerate(roots)}).select(*base.columns)


def compacted(spark: SparkSession, target: str, roots: list[str], arrivals: str | None = None) -> None:
    """Write table, arrivals and deltas as the table's next version, then remove the deltas it holds. To be
    called while no batch runs; deltas that stay after a stop in between are merged once more.
    """
    numbers = [n for n in children(spark, f"{target}.delta") if n.isdigit()]
    rows = written(latest_rows(spark, target, roots, arrivals), "compacted")
    replace(rows, target)
    for n in numbers:
        remove(spark, f"{target}.delta/{n}")
