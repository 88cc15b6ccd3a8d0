"""Streams: replay, dedup, hopping windows, keyed signal state, snapshots; each a DataFrame to a DataFrame."""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from array import array
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from temblor.functions import geo
from temblor.operators import anomaly, signals, stats
from temblor.session import shared_dir, ship_package
from temblor.sources.quakes import event_time, quakes
from temblor.streaming.state import HELD, Cell, Zone

#: How late a row may be, and the snapshot period.
LATE, SNAPSHOT = "15 minutes", "20 seconds"


def stream_quakes(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The quake view of an event table as a stream, with an event-time column ``time``."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return quakes(events).withColumn("time", event_time("us"))


def deduplicated(stream: DataFrame, late: str = LATE) -> DataFrame:
    """Rows whose id has not come before, within the time that a row may be late."""
    return stream.withWatermark("time", late).dropDuplicatesWithinWatermark(["id"])


def hopping(stream: DataFrame, late: str = LATE) -> DataFrame:
    return stats.hopping(stream.withWatermark("time", late), F.col("time"))


ZONE_SCORES, CELL_SCORES = ("foreshock", "trend", "energy", "migration"), ("cluster", "asymmetry", "aftershock")
ZONED = "event_id long, us long, time timestamp, region string, cell string, magnitude double, " + ", ".join(f"{n} double" for n in ZONE_SCORES)
SCORED = "event_id long, us long, region string, " + ", ".join(f"{n} double" for n in (*ZONE_SCORES, *CELL_SCORES))
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _plain(x):
    """A value of a pandas row as Python has it; None where there is none."""
    return None if x is None or x != x else x.item() if hasattr(x, "item") else x


#: Rows that a state works on at once, rows of a sorted run and of a block of it, bytes of a piece of a state.
PIECE, RUN, BLOCK, PART = 50_000, 200_000, 2_048, 1 << 22
INPUT = {"event_id": pa.int64(), "us": pa.int64(), "time": pa.timestamp("ns"), "region": pa.string(), "cell": pa.string()}


def _sorted(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["us", "event_id"], ignore_index=True)


def _up_to(rows: pd.DataFrame, us: int, event: float) -> int:
    """How many of sorted rows do not come after a time and id; rows without an id are the last of their time."""
    times, ids = rows["us"].to_numpy(), rows["event_id"].to_numpy()
    low, high = np.searchsorted(times, us, "left"), np.searchsorted(times, us, "right")
    return int(low + np.searchsorted(ids[low:high], event, "right"))


class _Runs:
    """Sorted runs of rows in a temporary file, in blocks that are read one at a time."""

    def __init__(self, columns: list[str]):
        self.schema = pa.schema([(c, INPUT.get(c, pa.float64())) for c in columns])
        self.file, self.runs = tempfile.TemporaryFile(), []

    def add(self, rows: pd.DataFrame) -> None:
        blocks: list[tuple[int, int]] = []
        for k in range(0, len(rows), BLOCK):
            data = pa.RecordBatch.from_pandas(rows.iloc[k : k + BLOCK], self.schema, preserve_index=False).serialize()
            blocks.append((self.file.tell(), data.size))
            self.file.write(data)
        self.runs.append(blocks)

    def _blocks(self, blocks: list[tuple[int, int]]) -> Iterator[pd.DataFrame]:
        for at, size in blocks:
            self.file.seek(at)
            yield pa.ipc.read_record_batch(pa.py_buffer(self.file.read(size)), self.schema).to_pandas()

    def merged(self) -> Iterator[pd.DataFrame]:
        """All rows in order. Those that no block still to be read can come before are the next ones."""
        rest = [(b := self._blocks(blocks), next(b)) for blocks in self.runs]
        while rest:
            us, event = min((rows["us"].iat[-1], rows["event_id"].iat[-1]) for _, rows in rest)
            found, left = [], []
            for blocks, rows in rest:
                n = _up_to(rows, us, event)
                found.append(rows.iloc[:n])
                after = rows.iloc[n:] if n < len(rows) else next(blocks, None)
                if after is not None:
                    left.append((blocks, after))
            rest = left
            yield _sorted(pd.concat(found))


def _in_order(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a key in order of time and id, in pieces. Up to a run they are sorted in memory, others in runs
    on disk: a zone of a batch may have any number of rows."""
    held: list[pd.DataFrame] = []
    runs, n = None, 0
    for part in parts:
        held.append(part)
        n += len(part)
        if n >= RUN:
            runs = runs or _Runs(list(part.columns))
            runs.add(_sorted(pd.concat(held)))
            held, n = [], 0
    if runs is None:
        rows = _sorted(pd.concat(held))
        yield from (rows.iloc[k : k + PIECE] for k in range(0, n, PIECE))
        return
    if held:
        runs.add(_sorted(pd.concat(held)))
    with runs.file:
        n = 0
        held = []
        for part in runs.merged():
            held.append(part)
            n += len(part)
            if n >= PIECE:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)


def _numbers(rows: pd.DataFrame, name: str) -> np.ndarray:
    return rows[name].to_numpy(np.float64, na_value=np.nan)


def _put_arrays(state, arrays: dict[str, array]) -> None:
    """Arrays as the rows (name, part) of a list state; large ones are written one by one, in pieces."""
    if 0 < sum(len(values) * values.itemsize for values in arrays.values()) <= PART:
        state.put([(name, values.tobytes()) for name, values in arrays.items() if values])
        return
    state.clear()
    for name, values in arrays.items():
        step = PART // values.itemsize
        for k in range(0, len(values), step):
            state.appendValue((name, values[k : k + step].tobytes()))


def _get_arrays(state, kinds: dict[str, str]) -> dict[str, array]:
    out = {name: array(kind) for name, kind in kinds.items()}
    for name, part in state.get() if state.exists() else ():
        out[name].frombytes(part)
    return out


class ZoneProcessor(StatefulProcessor):
    """A zone's scores; its state is a row of smoothed values and what its windows hold, as arrays."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.smooth = handle.getValueState("smooth", "foreshock double, energy double")
        self.held = handle.getListState("held", "name string, part binary")

    def _run(self, key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zone = Zone.of(tuple(map(_plain, self.smooth.get())) if self.smooth.exists() else None, _get_arrays(self.held, HELD))
        for rows in _in_order(parts):
            found = zone.add_many(rows["us"].to_numpy(np.int64), *(_numbers(rows, c) for c in ("lat", "lon", "magnitude", "energy")))
            own = {c: rows[c].to_numpy() for c in ("event_id", "us", "time", "cell", "magnitude")}
            yield pd.DataFrame(own | {"region": key[0]} | found, columns=[c.split()[0] for c in ZONED.split(", ")])
        row, held = zone.kept()
        self.smooth.update(row)
        _put_arrays(self.held, held)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._run(key, rows)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        for _ in self._run(key, iter([initialState])):
            pass

    def close(self) -> None:
        pass


class CellProcessor(StatefulProcessor):
    """The scores of a zone's cell. A timer half an hour of event time after its last row drops the times that
    no later row can see, and the whole cell where its smoothing and its mainshock have not begun: then it is as
    one that has never had a row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "base double, since long, after long, after_base double, after_score double")
        self.times = handle.getListState("times", "name string, part binary")

    def _cell(self) -> Cell:
        return Cell.of(tuple(map(_plain, self.kept.get())) if self.kept.exists() else None, _get_arrays(self.times, {"times": "q"})["times"])

    def _keep(self, cell: Cell) -> None:
        row, times = cell.kept()
        self.kept.update(row)
        _put_arrays(self.times, {"times": times})

    def _run(self, key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell = self._cell() if key[1] is not None else None
        for rows in _in_order(parts):
            found = dict.fromkeys(CELL_SCORES, 0.0) if cell is None else cell.add_many(rows["us"].to_numpy(np.int64), _numbers(rows, "magnitude"))
            own = {c: rows[c].to_numpy() for c in ("event_id", "us", *ZONE_SCORES) if c in rows}
            yield pd.DataFrame(own | {"region": key[0]} | found, columns=[c.split()[0] for c in SCORED.split(", ")])
        if cell is not None:
            self._keep(cell)
            self.handle.registerTimer((cell.last() + signals.CLUSTER["window"]) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._run(key, rows)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        cell = self._cell()
        if cell.expire(timerValues.getCurrentWatermarkInMs() * 1000):
            self.kept.clear()
            self.times.clear()
        else:
            self._keep(cell)
        yield pd.DataFrame(columns=[c.split()[0] for c in SCORED.split(", ")])

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        for _ in self._run(key, iter([initialState])):
            pass

    def close(self) -> None:
        pass


def _signal_input(quakes: DataFrame) -> DataFrame:
    number = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    rows = quakes.select("event_id", "us", number("lat"), number("lon"), number("magnitude"), "region", "cell")
    cell = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.col("cell"))
    return rows.withColumn("cell", cell).withColumn("energy", geo.energy(F.col("magnitude"))).withColumn("time", event_time("us"))


def signal_stream(stream: DataFrame, late: str = LATE, before: DataFrame | None = None) -> DataFrame:
    """Seven scores and their fusion for each row, from a state for each zone and then one for each cell of it,
    in the state store of the query. ``before`` preloads the states with earlier quakes, such as a catalogue's.

    Rows of a micro-batch count in the order of time, and over micro-batches in the order in which they come;
    rows that are later than ``late`` (at first, than 1970) are dropped, for the states that they would need may
    be gone."""
    spark = stream.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = _signal_input(stream).withWatermark("time", late)
    zones, cells = (None, None) if before is None else (_signal_input(before).groupBy("region"), _signal_input(before).groupBy("region", "cell"))
    zoned = rows.groupBy("region").transformWithStateInPandas(ZoneProcessor(), ZONED, "append", "eventtime", zones, "time")
    scored = zoned.groupBy("region", "cell").transformWithStateInPandas(CellProcessor(), SCORED, "append", "eventtime", cells)
    return signals.fused(scored)


def collected(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for all that is there now, as a table in the shared folder: of complete mode, the
    table of the last batch."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/stream_{uuid.uuid4().hex}"
    if mode != "append":
        last: list[int] = []

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
            last.append(number)

        stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}-c").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/batch={last[-1]}") if last else spark.createDataFrame([], stream.schema)
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-c").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


HOUR = 3_600_000_000


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


WINDOW = "event_id long, us long, lat double, lon double, magnitude double, region string"


def snapshots(stream: DataFrame, path: str, checkpoint: str, every: str | None = SNAPSHOT) -> StreamingQuery:
    """Every period, the clusters of the last hour of the stream, as tables ``path``/clusters/batch=n.

    The hour's rows and the state of its clusters are tables of the batch too; each batch brings those of the one
    before up to date where rows came or went (``dbscan.updated``), and older ones are deleted, so nothing grows
    with the stream. A repeated batch writes the same tables again. Without a period, all that is there now."""
    from temblor.operators import dbscan

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = lambda name, n: f"{path}/{name}/batch={n}"
        names = [c.split()[0] for c in WINDOW.split(", ")]
        held = _table(spark, at("window", number - 1), WINDOW) if number else spark.createDataFrame([], WINDOW)
        rows = held.withColumn("old", F.lit(True)).unionByName(batch.select(*names).withColumn("old", F.lit(False)))
        last = rows.agg(F.max("us")).first()[0]
        live = F.col("us") >= (last if last is not None else 0) - HOUR
        rows.filter(live).write.mode("overwrite").parquet(at("window", number))
        window = _table(spark, at("window", number), f"{WINDOW}, old boolean")
        state = {k: _table(spark, at(k, number - 1), schema) for k, schema in dbscan.STATE.items()} if number else dbscan.no_state(spark)
        state, _ = dbscan.updated(state, window.drop("old"), window.filter("NOT old").drop("old"), held.filter(~live))
        for k, df in state.items():
            df.write.mode("overwrite").parquet(at(k, number))
        dbscan.clusters(window.drop("old"), state["points"]).write.mode("overwrite").parquet(at("clusters", number))
        for k in ("window", *state):
            _delete(spark, at(k, number - 2))

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def anomaly_scores(stream: DataFrame, path: str, checkpoint: str, every: str | None = SNAPSHOT) -> StreamingQuery:
    """The anomaly score of each row of a signal stream, as tables ``path``/scores/batch=n.

    The first hundred rows, by batch and time, go to ``path``/first and make the model; rows up to the last
    of them have no score, and later batches are scored where they are. A repeated batch writes the same
    tables again. Without a period, all that is there now."""

    def write(batch: DataFrame, number: int) -> None:
        spark, order = batch.sparkSession, ["us", "event_id"]
        rows = batch.select(*order, *anomaly.FEATURES)
        schema = rows.schema.add("batch", "long")
        read = lambda: spark.read.schema(schema).option("basePath", f"{path}/first").parquet(f"{path}/first")
        rows.limit(0).write.mode("overwrite").parquet(f"{path}/first/batch=-1")
        known = read().filter(F.col("batch") < number).count()
        if known < anomaly.FROZEN:
            rows.orderBy(*order).limit(anomaly.FROZEN - known).write.mode("overwrite").parquet(f"{path}/first/batch={number}")
        first = read().filter(F.col("batch") <= number).orderBy("batch", *order).collect()  # a hundred at most
        anomaly.scored(rows, first, known >= anomaly.FROZEN).write.mode("overwrite").parquet(f"{path}/scores/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def wait_for_update(query: StreamingQuery, seen: int | None, timeout: int = 120) -> int | None:
    """The number of the latest batch with rows, once it is past ``seen`` or the time is over."""
    end = time.monotonic() + timeout
    while True:
        done = [p["batchId"] for p in query.recentProgress if p["numInputRows"]]
        if (done and (seen is None or done[-1] > seen)) or time.monotonic() >= end or not query.isActive:
            return done[-1] if done else None
        time.sleep(0.2)


def alert_log(rows: DataFrame) -> DataFrame:
    """The threshold events of a signal stream."""
    return signals.threshold_alerts(rows)


#: Shares of a zone's users, each the state of a key, and how many quakes' names go in one row at most.
SHARES, NAMES = 64, 500


def _distinct_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's distinct rows."""
    seen: set[tuple] = set()
    for batch in batches:
        found = pa.Table.from_batches([batch]).group_by(batch.schema.names, use_threads=False).aggregate([])
        new = set(zip(*(c.to_pylist() for c in found.columns), strict=True)) - seen
        if new:
            seen |= new
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*new, strict=True), batch.schema, strict=True)], schema=batch.schema)


def _named_by_zone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (region, names) of a task's distinct (region, name): lists as JSON, of bounded length."""
    zones: dict[str, list] = {}
    for batch in _distinct_rows(batches):
        for region, name in zip(*batch.to_pydict().values(), strict=True):
            zones.setdefault(region, []).append(name)
    for region, names in zones.items():
        lists = [json.dumps(part) for part in batched(sorted(names, key=lambda n: (n is None, n)), NAMES)]
        yield pa.RecordBatch.from_pydict({"region": pa.array([region] * len(lists), pa.string()), "names": pa.array(lists, pa.string())})


class AlertProcessor(StatefulProcessor):
    """The alerts of a share of a zone's users that have not been sent. Its state is which users have been sent
    which quakes, as a row for each set of quakes with all users who were sent just these."""

    def __init__(self, user_id: str):
        self.user_id = user_id

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sent = handle.getListState("sent", f"names array<string>, users array<{self.user_id}>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        sent: dict = {}
        for names, users in self.sent.get() if self.sent.exists() else ():
            sent |= dict.fromkeys(users, frozenset(names))
        steps: dict[tuple, tuple[frozenset, list]] = {}  # what a user has been sent then, and what is new
        for part in rows:
            alerts: dict[tuple, tuple[list, list]] = {}
            for user, username, names in zip(part["user_id"].tolist(), part["username"].tolist(), part["names"].tolist(), strict=True):
                user, step = _plain(user), (sent.get(user, frozenset()), names)
                if step not in steps:
                    steps[step] = step[0].union(listed := json.loads(names)), [n for n in listed if n not in step[0]]
                sent[user], new = steps[step]
                if new:
                    users, usernames = alerts.setdefault(step, ([], []))
                    users.append(user)
                    usernames.append(username)
            yield pd.DataFrame([(key[0], steps[step][1], *found) for step, found in alerts.items()], columns=["region", "names", "users", "usernames"])
        if any(new for _, new in steps.values()):
            groups: dict[frozenset, list] = {}
            for user, names in sent.items():
                groups.setdefault(names, []).append(user)
            self.sent.put([(list(names), users) for names, users in groups.items()])

    def close(self) -> None:
        pass


def user_alerts(stream: DataFrame, users: DataFrame) -> DataFrame:
    """Alerts of a quake stream to a table of users, each (user, quake) once over all batches.

    The distinct quakes of a batch meet users, not its rows: quakes are named by zone and magnitude in tenths, and
    each user comes with the list of the zone's. What a user has been sent is the state of the query, so one who
    subscribes later, or by another run of the query, is sent what comes from then on."""
    spark = stream.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    kind = users.schema["user_id"].dataType.simpleString()
    named = stats.alert_quakes(stream).filter("region IS NOT NULL").mapInArrow(_distinct_rows, "region string, name string")
    names = named.repartition("region").mapInArrow(_named_by_zone, "region string, names string")
    asked = users.filter("alerts_enabled").join(F.broadcast(names), "region")
    share = F.pmod(F.xxhash64("user_id"), F.lit(SHARES)).alias("share")
    keyed = asked.select("region", share, "user_id", "username", "names").groupBy("region", "share")
    alerts = keyed.transformWithStateInPandas(AlertProcessor(kind), f"region string, names array<string>, users array<{kind}>, usernames array<string>", "append", "none")
    each = alerts.select("region", "names", F.explode(F.arrays_zip("users", "usernames")).alias("user"))
    each = each.select(F.col("user.users").alias("user_id"), F.col("user.usernames").alias("username"), "region", F.explode("names").alias("name"))
    return each.select("user_id", "username", "region", stats.quake_id("name").alias("quake_id"))


def live_zone_stats(stream: DataFrame) -> DataFrame:
    """Running statistics per zone, for the complete output mode."""
    return stats.zone_stats(stream)


def zone_keys(stream: DataFrame) -> DataFrame:
    return stream.withColumn("partition", geo.key_partition(F.col("region")))


def dealt_by_zone(rows: DataFrame, n: int = 8) -> DataFrame:
    """The rows, table or stream, dealt over ``n`` tasks by the zone's own hash, as the keyed topic deals them."""
    return rows.repartitionById(n, geo.key_partition(F.col("region"), n))
