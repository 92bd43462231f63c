"""The same computations on a live feed: tracker, vote sessions, review queue, inventory refresh."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stockcount.functions.decision import VoteProfile
from stockcount.functions.numbers import decimals
from stockcount.operators.inventory import frame_counts
from stockcount.operators.runs import metrics_trend
from stockcount.operators.tracking import DEFAULTS, TrackerSettings, frame_step
from stockcount.operators.votes import BALANCED, decide_tallies, scored_vote

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRACK_EVENTS = (
    "video_id long, kind string, frame_idx long, det_idx long, track_id long, birth_frame long, hits long, age long"
)


def _track_processor(settings: TrackerSettings, idle_ms: int):
    """Processor class, defined here so that workers receive it with the query."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    advance, reach = frame_step(settings), settings.reach

    class VideoTracks(StatefulProcessor):
        """Live tracks of one video. State: last frame, next id and live tracks."""

        def init(self, handle):
            self.handle = handle
            self.state = handle.getValueState("video", "blob string")

        def load(self):
            import json

            if not self.state.exists():
                return {"last": None, "next": 1, "tracks": []}
            return json.loads(self.state.get()[0])

        def save(self, state):
            import json

            self.state.update((json.dumps(state),))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            import pandas as pd

            state = self.load()
            pdf = pd.concat(list(rows), ignore_index=True).sort_values(["frame_idx", "det_idx"], kind="stable")
            out = []
            if state["last"] is not None:
                late = pdf["frame_idx"] <= state["last"]
                out += [("late", f, d, -1, -1, 0, 0) for f, d in zip(pdf["frame_idx"][late], pdf["det_idx"][late])]
                pdf = pdf[~late]
            tracks = state["tracks"]
            for frame, group in pdf.groupby("frame_idx", sort=True):
                frame = int(frame)
                boxes = list(zip(*(group[c].tolist() for c in ("x1", "y1", "x2", "y2"))))
                tracks, dead, linked = advance(
                    tracks, frame, [int(d) for d in group["det_idx"]], boxes, group["conf"].tolist()
                )
                # The id follows the eight fields of a live track.
                out += [("end", t[7] + reach, -1, t[8], t[4], t[6], 0) for t in dead]
                for _, det, t in linked:
                    if len(t) == 8:
                        t.append(state["next"])
                        state["next"] += 1
                    out.append(("link", frame, det, t[8], t[4], t[6], frame - t[4] + 1))
                state["last"] = frame
            _restart_timer(self.handle, timerValues, idle_ms)
            state["tracks"] = tracks
            self.save(state)
            yield self.frame(key, out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            """The video has been silent for long: what is live has ended."""
            state = self.load()
            out = [("end", t[7] + reach, -1, t[8], t[4], t[6], 0) for t in state["tracks"]]
            state["tracks"] = []
            self.save(state)
            yield self.frame(key, out)

        def frame(self, key, out):
            import pandas as pd

            names = ["kind", "frame_idx", "det_idx", "track_id", "birth_frame", "hits", "age"]
            pdf = pd.DataFrame(out, columns=names)
            pdf.insert(0, "video_id", key[0])
            return pdf.astype({c: "int64" for c in pdf.columns if c != "kind"})

        def close(self):
            pass

    return VideoTracks()


def track_stream(detections: DataFrame, settings: TrackerSettings = DEFAULTS, idle_ms: int = 3_600_000) -> DataFrame:
    """Track events of a stream of boxes.

    ``link`` rows tie a box to a track, ``end`` rows close a track, ``late`` rows are boxes of frames
    their video has already passed. Every video advances by its own frames alone, so one that lags
    behind the others loses nothing: no watermark drops rows. Tracks of a video from which nothing has come for
    ``idle_ms`` of processing time end. Needs the RocksDB state store.
    """
    return detections.groupBy("video_id").transformWithStateInPandas(
        statefulProcessor=_track_processor(settings, idle_ms),
        outputStructType=TRACK_EVENTS,
        outputMode="Append",
        timeMode="ProcessingTime",
    )


#: Processing time for which a closed track, entity or crop is remembered after nothing more came for it.
REMEMBER_MS = 7 * 24 * 3_600_000
#: Groups that tracks, entities or crops are dealt to by hash; a batch reads and writes the state of a group once.
GROUPS = 512


def _grouped(df: DataFrame, key: str, groups: int):
    return df.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")).groupBy("_group")


def _group_state(idle_ms: int, remember_ms: int):
    """Class of the state of a group, defined here so that workers receive it with the query."""

    class GroupState:
        """By key: what is open, with the time it was last touched, and what was closed, with the time it is forgotten.

        One timer a group stands at the next of these times.
        """

        def __init__(self, handle):
            self.handle = handle
            self.value = handle.getValueState("keys", "blob string")

        def load(self, now: int) -> None:
            import json

            held = json.loads(self.value.get()[0]) if self.value.exists() else [[], []]
            self.open = {k: (touched, v) for k, touched, v in held[0]}
            self.closed = {k: (until, v) for k, until, v in held[1] if until > now}

        def close(self, key, value, now: int) -> None:
            self.open.pop(key, None)
            self.closed[key] = (now + remember_ms, value)

        def idle(self, now: int) -> list:
            """Keys that nothing has come for, and what is open of them."""
            return [(k, v) for k, (touched, v) in self.open.items() if touched + idle_ms <= now]

        def save(self, now: int, fired: bool = False) -> None:
            import json

            if self.open or self.closed:
                held = [[(k, *v) for k, v in part.items()] for part in (self.open, self.closed)]
                self.value.update((json.dumps(held),))
            elif self.value.exists():
                self.value.clear()
            if not fired:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            due = [touched + idle_ms for touched, _ in self.open.values()] + [until for until, _ in self.closed.values()]
            if due:
                self.handle.registerTimer(max(now + 1, min(due)))

    return GroupState


def _scored(min_sim: float):
    return (F.col("sku") != "UNKNOWN") & (F.col("sim") >= min_sim)


def vote_sessions(votes: DataFrame, gap: str, min_sim: float = 0.30) -> DataFrame:
    """Votes of an entity between pauses of ``gap`` or longer, from a table; ``session_stream`` does so on a stream."""
    scored = _scored(min_sim)
    return (
        votes.groupBy("entity", F.session_window("ts", gap).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("frames_seen"),
            F.count_if(scored).alias("frames_scored"),
            F.sum(F.when(scored, F.col("sim")).otherwise(F.lit(0.0)).cast("decimal(18,6)")).cast("double").alias("sim_sum"),
        )
        .select("entity", F.col("w.start").alias("desde"), F.col("w.end").alias("hasta"), "frames_seen", "frames_scored", "sim_sum")
    )


SESSIONS = (
    "entity long, kind string, desde timestamp, hasta timestamp, frames_seen long, frames_scored long, sim_sum double, "
    "ts timestamp, event_id long"
)


def _session_processor(gap_ms: int, idle_ms: int, remember_ms: int):
    """Processor class of open sessions, defined here so that workers receive it with the query."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    gap, GroupState = gap_ms * 1000, _group_state(idle_ms, remember_ms)

    class OpenSessions(StatefulProcessor):
        """The sessions of a group of entities. State of each: first and last time and sums while it is open, and for a time the
        time up to which it was closed. What is open stays until it is closed, however long the stream stood still."""

        def init(self, handle):
            self.state = GroupState(handle)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            import pandas as pd

            now, state, out = timerValues.getCurrentProcessingTimeInMs(), self.state, []
            state.load(now)
            pdf = pd.concat(list(rows), ignore_index=True).sort_values(["us", "event_id"], kind="stable")
            timeless = pdf["us"].isna()
            out += [(k, "late", None, None, 0, 0, 0.0, None, e) for k, e in zip(pdf["entity"][timeless], pdf["event_id"][timeless])]
            pdf = pdf[~timeless]
            for k, us, event, sim in zip(pdf["entity"].tolist(), pdf["us"].astype("int64").tolist(), pdf["event_id"].tolist(), pdf["micros"].tolist()):
                closed = state.closed.get(k, (0, None))[1]
                first, last, seen, scored, micros = state.open.get(k, (0, (None, None, 0, 0, 0)))[1]
                # What belongs to a closed session, or to one between that and the open one, comes too late.
                if (closed is not None and us < closed + gap) or (seen and us + gap <= first):
                    out.append((k, "late", None, None, 0, 0, 0.0, us, event))
                    if seen:
                        state.open[k] = (now, state.open[k][1])
                    continue
                if seen and us >= last + gap:
                    out.append(self.ended(k, state.open[k][1]))
                    state.close(k, last, now)
                    first, last, seen, scored, micros = None, None, 0, 0, 0
                first, last = (us, us) if not seen else (min(first, us), max(last, us))
                if sim == sim and sim is not None:
                    scored, micros = scored + 1, micros + int(sim)
                state.open[k] = (now, (first, last, seen + 1, scored, micros))
            out += self.close_idle(now)
            state.save(now)
            yield self.frame(out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            """Sessions of entities for which nothing has come for long are closed with what they have."""
            now = timerValues.getCurrentProcessingTimeInMs()
            self.state.load(now)
            out = self.close_idle(now)
            self.state.save(now, fired=True)
            yield self.frame(out)

        def close_idle(self, now):
            idle = self.state.idle(now)
            for k, v in idle:
                self.state.close(k, v[1], now)
            return [self.ended(k, v) for k, v in idle]

        def ended(self, k, v):
            first, last, seen, scored, micros = v
            return (k, "session", first, last + gap, seen, scored, micros / 1e6, None, None)

        def frame(self, out):
            import pandas as pd

            names = ["entity", "kind", "desde", "hasta", "frames_seen", "frames_scored", "sim_sum", "ts", "event_id"]
            pdf = pd.DataFrame(out, columns=names)
            for c in ("desde", "hasta", "ts"):
                pdf[c] = pd.to_datetime(pdf[c].astype("Int64"), unit="us", utc=True)
            pdf["entity"] = pd.array([None if k is None else int(k) for k in pdf["entity"]], dtype="Int64")
            return pdf.astype({"frames_seen": "int64", "frames_scored": "int64", "sim_sum": "float64", "event_id": "Int64"})

        def close(self):
            pass

    return OpenSessions()


def _restart_timer(handle, timerValues, idle_ms: int | None) -> None:
    """The one timer of a key: ``idle_ms`` from now, or none."""
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
    if idle_ms is not None:
        handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + idle_ms)


def session_stream(
    votes: DataFrame, gap_ms: int, idle_ms: int = 3_600_000, remember_ms: int = REMEMBER_MS, min_sim: float = 0.30, groups: int = GROUPS
) -> DataFrame:
    """``session`` rows as ``vote_sessions`` has them, and ``late`` rows, from a stream of votes.

    No watermark: a session is closed by the entity's own next vote after a pause of ``gap_ms`` or more, or when nothing has
    come for it for ``idle_ms`` of processing time. Votes for what was closed before, or without a time, are ``late`` rows.
    What was closed is forgotten ``remember_ms`` later, so the state does not grow with all entities ever seen; a vote that
    comes still later begins a session of its own. ``votes`` has entity, sku, sim, ts and event_id. Entities are dealt to ``groups``
    that a batch takes one call each; a stream keeps its number of groups for life. Needs the RocksDB state store.
    """
    micros = F.when(_scored(min_sim), (F.col("sim").cast("decimal(18,6)") * 1_000_000).cast("long"))
    ready = votes.select(F.col("entity").cast("string").alias("entity"), F.unix_micros("ts").alias("us"), "event_id", micros.alias("micros"))
    return _grouped(ready, "entity", groups).transformWithStateInPandas(
        statefulProcessor=_session_processor(gap_ms, idle_ms, remember_ms), outputStructType=SESSIONS, outputMode="Append", timeMode="ProcessingTime"
    )


TALLIES = (
    "track_id long, kind string, frames_seen long, frames_scored long, top_sku string, top_votes long, top_sim_sum double, "
    "last_ms long, ts timestamp, event_id long"
)


def _vote_processor(gap_ms: int, idle_ms: int, remember_ms: int):
    """Processor class of open tracks, defined here so that workers receive it with the query."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    GroupState = _group_state(idle_ms, remember_ms)

    class OpenTracks(StatefulProcessor):
        """Votes per product of a group of tracks. State of each: while it is open frames seen, last time, and per product votes,
        sum and first vote; for a time the time up to which it was closed."""

        def init(self, handle):
            self.state = GroupState(handle)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            import pandas as pd

            now, state, out = timerValues.getCurrentProcessingTimeInMs(), self.state, []
            state.load(now)
            pdf = pd.concat(list(rows), ignore_index=True).sort_values(["us", "event_id"], kind="stable")
            timeless = pdf["us"].isna()
            out += [(k, "late", 0, 0, None, None, None, None, None, e) for k, e in zip(pdf["track_id"][timeless], pdf["event_id"][timeless])]
            pdf = pdf[~timeless].astype({"us": "int64"})
            for k, us, event, sku, sim4 in zip(*(pdf[c].tolist() for c in ("track_id", "us", "event_id", "sku", "sim4"))):
                closed = state.closed.get(k, (0, None))[1]
                seen, last, skus = state.open.get(k, (0, (0, None, {})))[1]
                if closed is not None and us <= closed + gap_ms * 1000:
                    out.append((k, "late", 0, 0, None, None, None, None, us, event))
                    if seen:
                        state.open[k] = (now, state.open[k][1])
                    continue
                if seen and us > last + gap_ms * 1000:
                    out.append(self.decided(k, state.open[k][1]))
                    state.close(k, last, now)
                    seen, last, skus = 0, None, {}
                if sku is not None and sku == sku:
                    votes, total, first = skus.get(sku, (0, 0.0, None))
                    skus[sku] = (votes + 1, total + float(sim4), min(first or [us, event], [us, event]))
                state.open[k] = (now, (seen + 1, us if last is None else max(last, us), skus))
            out += self.close_idle(now)
            state.save(now)
            yield self.frame(out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            """Tracks for which nothing has come for long are closed with what they have."""
            now = timerValues.getCurrentProcessingTimeInMs()
            self.state.load(now)
            out = self.close_idle(now)
            self.state.save(now, fired=True)
            yield self.frame(out)

        def close_idle(self, now):
            idle = self.state.idle(now)
            for k, v in idle:
                self.state.close(k, v[1], now)
            return [self.decided(k, v) for k, v in idle]

        def decided(self, k, v):
            """The row of what is open."""
            seen, last, skus = v
            best = min(((-n, first, sku, total) for sku, (n, total, first) in skus.items()), default=None)
            scored = sum(n for n, _, _ in skus.values())
            lead = (best[2], -best[0], best[3]) if best else (None, None, None)
            return (k, "decision", seen, scored, *lead, last // 1000, None, None)

        def frame(self, out):
            import pandas as pd

            names = ["track_id", "kind", "frames_seen", "frames_scored", "top_sku", "top_votes", "top_sim_sum", "last_ms", "ts", "event_id"]
            pdf = pd.DataFrame(out, columns=names)
            pdf["ts"] = pd.to_datetime(pdf["ts"].astype("Int64"), unit="us", utc=True)
            pdf["track_id"] = pd.array([None if k is None else int(k) for k in pdf["track_id"]], dtype="Int64")
            numbers = {c: "Int64" for c in ("frames_seen", "frames_scored", "top_votes", "last_ms", "event_id")}
            return pdf.astype({"top_sim_sum": "Float64", **numbers})

        def close(self):
            pass

    return OpenTracks()


def vote_decisions(
    votes: DataFrame, gap_ms: int, idle_ms: int = 3_600_000, profile: VoteProfile = BALANCED, remember_ms: int = REMEMBER_MS, groups: int = GROUPS
) -> DataFrame:
    """Decisions of tracks and late votes, from a stream of votes.

    ``decision`` rows have the decision of a track and ``last_ms``, its last vote; ``late`` rows are votes for what
    was closed before or that have no time, with their ts and event_id. A track is closed by its own next vote after a pause of more than
    ``gap_ms``, or when nothing has come for it for ``idle_ms`` of processing time. No watermark drops rows, so a
    track that lags behind the others loses nothing. A closed track is forgotten ``remember_ms`` later; a vote that
    comes still later begins a track anew. ``votes`` has track_id, sku, sim, ts and event_id, which orders
    votes of equal time. Tracks are dealt to ``groups`` that a batch takes one call each; a stream keeps its number of groups
    for life. Needs the RocksDB state store.
    """
    marked = votes.withColumn("sim4", decimals("sim", 4))
    ready = marked.select(
        F.col("track_id").cast("string").alias("track_id"), F.unix_micros("ts").alias("us"), "event_id", F.when(scored_vote(profile.min_sim_vote), F.col("sku")).alias("sku"), "sim4"
    )
    tallies = _grouped(ready, "track_id", groups).transformWithStateInPandas(
        statefulProcessor=_vote_processor(gap_ms, idle_ms, remember_ms), outputStructType=TALLIES, outputMode="Append", timeMode="ProcessingTime"
    )
    return decide_tallies(tallies, profile, "kind", "last_ms", "ts", "event_id")


def _review_processor(columns: list[str], remember_ms: int):
    """Processor class of known crops, defined here so that workers receive it with the query."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    GroupState = _group_state(0, remember_ms)

    class KnownCrops(StatefulProcessor):
        """Which crops of a group have been let through. State: a mark of each with a lifetime."""

        def init(self, handle):
            self.state = GroupState(handle)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            import pandas as pd

            now, state = timerValues.getCurrentProcessingTimeInMs(), self.state
            state.load(now)
            pdf = pd.concat(list(rows), ignore_index=True)[columns]
            first = pdf.sort_values("ts", kind="stable").drop_duplicates("crop_id")
            fresh = [k not in state.closed for k in first["crop_id"]]
            # A repetition renews the mark, so a crop that keeps coming stays known.
            for k in first["crop_id"]:
                state.close(k, True, now)
            state.save(now)
            yield first[fresh]

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            """Marks whose time is over go."""
            now = timerValues.getCurrentProcessingTimeInMs()
            self.state.load(now)
            self.state.save(now, fired=True)
            return iter(())

        def close(self):
            pass

    return KnownCrops()


def review_stream(records: DataFrame, remember_ms: int = REMEMBER_MS, groups: int = GROUPS) -> DataFrame:
    """Review queue entries without repeated crops: of those that come together the earliest by ``ts``, afterwards none.

    There is no watermark, so a run that lags behind the others loses nothing. A crop is known for ``remember_ms`` of
    processing time after it last came. Crops are dealt to ``groups`` that a batch takes one call each; a stream keeps its number
    of groups for life. Needs the RocksDB state store.
    """
    columns = records.columns
    return _grouped(records, "crop_id", groups).transformWithStateInPandas(
        statefulProcessor=_review_processor(columns, remember_ms), outputStructType=records.schema, outputMode="Append", timeMode="ProcessingTime"
    )


def partial_writer(partial: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """Writes the partial aggregate of a micro-batch; a repeated batch overwrites its own part, so that merging counts it once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{path}/lote={batch_id}")

    return write


def refresh(source: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh_frame_counts(identified: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps partial per-frame counts per micro-batch."""
    return refresh(identified, partial_writer(frame_counts, path), checkpoint)


def run_counts(records: DataFrame) -> DataFrame:
    """run_id, total, unknown, ambiguous of review records: sums that merge by adding."""
    return records.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("decision") == "unknown").alias("unknown"), F.count_if(F.col("decision") == "ambiguous").alias("ambiguous")
    )


def refresh_metrics(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps partial decision counts of runs per micro-batch; a run may be spread over batches."""
    return refresh(records, partial_writer(run_counts, path), checkpoint)


def refreshed_metrics(spark: SparkSession, path: str, series: Column) -> DataFrame:
    """Shares of unknown and ambiguous records per run, and their change against the previous run of the same ``series``."""
    merged = spark.read.parquet(path).groupBy("run_id").agg(*[F.sum(c).alias(c) for c in ("total", "unknown", "ambiguous")])
    share = lambda c: decimals(F.lit(100.0) * F.col(c) / F.col("total"), 4).alias(f"{c}_pct")
    shares = merged.select("run_id", series.alias("serie"), share("unknown"), share("ambiguous"))
    return metrics_trend(shares, "serie", "run_id", ["unknown_pct", "ambiguous_pct"])


def refreshed_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Per-frame inventory from the partial counts; a frame may be spread over batches."""
    counts = spark.read.parquet(path).groupBy("video_id", "frame_idx", "ean").agg(F.sum("cantidad").alias("cantidad"))
    return counts.groupBy("video_id", "ean").agg(F.max("cantidad").alias("cantidad"))


class Replay:
    """Feeds a table to a streaming computation in ordered slices, restarting the query for each.

    Slices are written to a folder under ``root`` that the stream reads; every slice is one run with
    ``availableNow`` on the same checkpoint, so that state survives restarts.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root = spark, root
        self.source = f"{root}/in"
        #: What Spark reported on the batches of the last run.
        self.progress = []
        self.stream = lambda: spark.readStream.schema(schema).parquet(f"{self.source}/*")

    def feed(self, rows: DataFrame, slice_no: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.source}/s{slice_no:05d}")

    def run_to_table(self, output: DataFrame, idle_batches: bool = True) -> None:
        """One run over what is there. Timers on processing time ask for batches without data for ever: switch these off."""
        # State partitions stay fixed for the life of a checkpoint: one per core is enough for a replay.
        key = "spark.sql.shuffle.partitions"
        partitions = min(int(self.spark.conf.get(key)), self.spark.sparkContext.defaultParallelism)
        settings = {
            "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
            "spark.sql.streaming.noDataMicroBatches.enabled": str(idle_batches).lower(),
            key: str(partitions),
        }
        before = {k: self.spark.conf.get(k) for k in settings}
        for k, v in settings.items():
            self.spark.conf.set(k, v)
        try:
            query = (
                output.writeStream.format("parquet")
                .option("path", f"{self.root}/out")
                .option("checkpointLocation", f"{self.root}/checkpoint")
                .outputMode("append")
                .trigger(availableNow=True)
                .start()
            )
            query.awaitTermination()
            self.progress = query.recentProgress
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)

    def result(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/out")
