"""Linking of a crowded part of a video in chunks of time, each in a task of its own.

Boxes of a part overlap and leave no pause, so the part can't be cut exactly beforehand: a chunk needs the live tracks at
its start. Each chunk therefore begins with a guess, the live tracks after ``WARM_CELLS`` cells of frames before it
taken from nothing. What decides the further course of tracks is where each was last seen and when; if the guess equals
the true end of the chunk before, the chunk's links are right. Chunks with a wrong guess run again from that end, in rounds,
until all agree. Every round settles at least the first wrong chunk of a part, so the result is that of the
uncut part in any case; usually the guesses are right and one round does.

Chunks of few cells share a guess: consecutive ones form a run of as many cells as a guess is taken from, and a run is linked in one call,
its chunks one after the other. So boxes are linked about twice, however short the chunks are; chunks of that many cells are runs by themselves.

A guess knows tracks in another order of birth, which matters only if two of them overlapped a box alike. A run notes such
pairs, and its guess is accepted only if each is in the true order; a state with two equal tracks only in the true order at all.

Inside a chunk a track from before is known by its place in the start state. Boundary maps say which track of
the chunk before that is, and how many boxes it had there. They compose associatively, so tracks over many chunks are
resolved by doubling, in a number of rounds that grows with the logarithm of the chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockcount.scale import compact, cut

PART = ["video_id", "segment", "lane"]
CHUNK_BOXES = 20_000
#: Cells of frames (one more than a track can bridge) that a guess is taken from.
WARM_CELLS = 6

_RUN = (
    "video_id long, segment long, lane int, chunk long, kind string, frame_idx long, det_idx long, old long, "
    "birth_frame long, birth_det long, hits long, state string"
)
_NAMES = [c.split()[0] for c in _RUN.split(", ")]
_MET = "video_id long, segment long, lane int, chunk long, agrees boolean, state string, j long, up long, birth_frame long, birth_det long, hits long"


def time_chunks(corners: DataFrame, chunk_boxes: int) -> DataFrame:
    """video_id, segment, lane, cell, chunk, run, warm for the parts of more than two chunks' boxes; checkpointed.

    ``corners`` has the part, the cell and the number of ``boxes``. A cell belongs to one chunk, and to the first of a later run as ``warm``.
    """
    cells = corners.groupBy(*PART, "cell").agg(F.sum("boxes").alias("n"))
    before = Window.partitionBy(*PART).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    big = cells.withColumn("total", F.sum("n").over(Window.partitionBy(*PART))).filter(F.col("total") > 2 * chunk_boxes)
    slot = F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / F.lit(chunk_boxes))
    dense = F.dense_rank().over(Window.partitionBy(*PART).orderBy("slot")) - 1
    sized = big.withColumn("slot", slot).withColumn("chunk", dense.cast("long")).select(*PART, "cell", "chunk")
    # A run ends with the chunk that fills its cells; those before the chunk's first one are counted by all of its cells.
    ahead = F.min("place").over(Window.partitionBy(*PART, "chunk"))
    sized = sized.withColumn("place", F.row_number().over(Window.partitionBy(*PART).orderBy("cell")) - 1).withColumn("fill", F.floor(ahead / F.lit(WARM_CELLS)))
    run = F.dense_rank().over(Window.partitionBy(*PART).orderBy("fill")) - 1
    placed = cut(sized.withColumn("run", run.cast("long")).select(*PART, "cell", "chunk", "run"))
    heads = placed.groupBy(*PART, "run").agg(F.min("cell").alias("head"), F.min("chunk").alias("chunk"))
    reaching = heads.withColumn("cell", F.explode(F.sequence(F.col("head") - WARM_CELLS, F.col("head") - 1))).select(*PART, "cell", "chunk", "run")
    warm = reaching.join(placed.select(*PART, "cell"), [*PART, "cell"], "left_semi")
    return cut(placed.withColumn("warm", F.lit(False)).unionByName(warm.withColumn("warm", F.lit(True))))


def _linker(settings):
    """Task-side run of one chunk: its links, the start state it assumed and its end state."""
    from stockcount.operators.tracking import frame_step

    reach = settings.reach

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        import numpy as np
        import pandas as pd

        ties: list[tuple] = []
        advance = frame_step(settings, ties)
        tracks, key, begun, out, pending = [], None, False, [], None

        def begin(frame):
            """From here on tracks are known by their place in the start state."""
            nonlocal tracks, begun
            live = [t for t in tracks if frame - t[7] <= reach]
            out.append(("start", frame, -1, None, None, None, 0, json.dumps([[*t[:4], t[7]] for t in live])))
            tracks, begun = [[*t[:4], None, j, 0, t[7]] for j, t in enumerate(live)], True
            ties.clear()

        def run(pdf):
            nonlocal tracks
            frames = pdf["frame_idx"].to_numpy()
            warm, state = pdf["warm"].tolist(), pdf["state"].tolist()
            dets = pdf["det_idx"].tolist()
            boxes = list(zip(*(pdf[c].tolist() for c in ("x1", "y1", "x2", "y2"))))
            confs = pdf["conf"].tolist()
            cuts = [0, *(np.flatnonzero(np.diff(frames)) + 1).tolist(), len(frames)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if state[a] is not None:
                    tracks = [[*s[:4], None, None, 0, s[4]] for s in json.loads(state[a])]
                    continue
                frame = int(frames[a])
                if not begun and not warm[a]:
                    begin(frame)
                tracks, _, linked = advance(tracks, frame, dets[a:b], boxes[a:b], confs[a:b])
                if begun:
                    for _, det, t in linked:
                        old = t[4] is None
                        out.append(("link", frame, det, t[5] if old else None, t[4], None if old else t[5], t[6], None))

        def emit():
            rows = pd.DataFrame(out, columns=_NAMES[4:])
            for n, (c, v) in enumerate(zip(_NAMES[:4], key)):
                rows.insert(n, c, v)
            out.clear()
            return rows.astype({c: "Int64" for c in ("frame_idx", "det_idx", "old", "birth_frame", "birth_det", "hits")})

        for pdf in batches:
            if len(pdf) == 0:
                continue
            key = tuple(pdf[c].iloc[0] for c in _NAMES[:4])
            if pending is not None:
                pdf = pd.concat([pending, pdf], ignore_index=True)
            done = (pdf["frame_idx"] < pdf["frame_idx"].iloc[-1]).to_numpy()
            pending = pdf[~done]
            if done.any():
                run(pdf[done])
                if out:
                    yield emit()
        if pending is not None:
            run(pending)
            end = [[*t[:4], t[7], t[5] if t[4] is None else None, t[4], None if t[4] is None else t[5], t[6]] for t in tracks]
            # Tracks born here come after those from before in any case.
            pairs = sorted({(x[5], y[5]) for x, y in ties if x[4] is None and y[4] is None})
            out.append(("end", -1, -1, None, None, None, 0, json.dumps({"tracks": end, "ties": pairs})))
            yield emit()

    return link


def _compared(reach: int):
    """Task-side test of start states against the ends before them: boundary maps, or the state to run again from."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        import pandas as pd

        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                part = (r.video_id, r.segment, r.lane, r.chunk)
                start, ties = json.loads(r.start), json.loads(r.own)["ties"]
                # The end may still hold tracks that expire before the chunk's first frame.
                end = [e for e in json.loads(r.end)["tracks"] if r.first - e[4] <= reach]
                place = list(range(len(end)))
                if [e[:5] for e in end] != start:
                    by_state = {tuple(e[:5]): n for n, e in enumerate(end)}
                    place = [by_state.get(tuple(s)) for s in start]
                    wrong = len(by_state) < len(end) or len(start) != len(end) or None in place
                    if wrong or any(place[x] > place[y] for x, y in ties):
                        out.append((*part, False, json.dumps([e[:5] for e in end]), *[None] * 5))
                        continue
                out += [(*part, True, None, j, *end[n][5:]) for j, n in enumerate(place)]
            rows = pd.DataFrame(out, columns=[c.split()[0] for c in _MET.split(", ")])
            yield rows.astype({c: "Int64" for c in ("j", "up", "birth_frame", "birth_det", "hits")})

    return run


def _resolved(maps: DataFrame) -> DataFrame:
    """video_id, segment, lane, chunk, j, birth_frame, birth_det, base: who a track of a start state is, and its boxes before."""
    key = [*PART, "chunk", "j"]
    now = cut(maps.select(*key, (F.col("chunk") - 1).alias("up_chunk"), "up", "birth_frame", "birth_det", F.col("hits").alias("base")))
    while not now.filter("up is not null").isEmpty():
        above = now.select(*PART, F.col("chunk").alias("up_chunk"), F.col("j").alias("up"), F.struct("up_chunk", "up", "birth_frame", "birth_det", "base").alias("_above"))
        met = now.join(above, [*PART, "up_chunk", "up"], "left")
        over = lambda c: F.when(F.col("up").isNull(), F.col(c)).otherwise(F.col(f"_above.{c}")).alias(c)
        now = cut(met.select(*key, over("up_chunk"), over("birth_frame"), over("birth_det"), (F.col("base") + F.coalesce("_above.base", F.lit(0))).alias("base"), F.col("_above.up").alias("up")))
    return now.select(*key, "birth_frame", "birth_det", "base")


def link_chunks(boxes: DataFrame, chunks: DataFrame, settings) -> DataFrame:
    """Links of the crowded parts, as ``tracking.link_detections`` returns them.

    ``boxes`` has the part and the cell; ``chunks`` is what ``time_chunks`` returned.
    """
    tasks = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # From here on a run counts as one chunk.
    chunks = chunks.select(*PART, "cell", F.col("run").alias("chunk"), "warm")
    keys = [*PART, "chunk"]
    columns = [*keys, "frame_idx", "det_idx", "x1", "y1", "x2", "y2", "conf", "warm", "state"]
    dealt = boxes.join(compact(chunks), [*PART, "cell"]).withColumn("state", F.lit(None).cast("string")).select(*columns)

    def run(rows: DataFrame) -> DataFrame:
        ordered = rows.repartition(tasks, *keys).sortWithinPartitions(*keys, "frame_idx", "det_idx")
        return cut(ordered.groupBy(*keys).applyInPandas(_linker(settings), _RUN))

    done = run(dealt)
    types = dict(dealt.dtypes)
    while True:
        starts = done.filter("kind = 'start'").select(*keys, F.col("frame_idx").alias("first"), F.col("state").alias("start"))
        ends = done.filter("kind = 'end'").select(*keys, F.col("state").alias("own"))
        last = ends.select(*PART, (F.col("chunk") + 1).alias("chunk"), F.col("own").alias("end"))
        met = cut(starts.join(last, keys).join(ends, keys).mapInPandas(_compared(settings.reach), _MET))
        wrong = compact(met.filter("not agrees").select(*keys, "state"))
        if wrong.isEmpty():
            break
        empty = {c: F.lit(None).cast(types[c]) for c in ("x1", "y1", "x2", "y2", "conf")}
        given = wrong.withColumns(empty | {"frame_idx": F.lit(-(1 << 62)).cast("long"), "det_idx": F.lit(-1).cast("long"), "warm": F.lit(False)})
        again = dealt.filter("not warm").join(wrong.select(*keys), keys, "left_semi").unionByName(given.select(*columns))
        done = done.join(wrong.select(*keys), keys, "left_anti").unionByName(run(again))
    base = compact(_resolved(met.filter("j is not null")))
    links = done.filter("kind = 'link'").select(*keys, "frame_idx", "det_idx", F.col("old").alias("j"), "hits", F.col("birth_frame").alias("_frame"), F.col("birth_det").alias("_det"))
    named = links.join(base, [*keys, "j"], "left")
    frame = F.coalesce("_frame", "birth_frame")
    return named.select(
        "video_id", "frame_idx", "det_idx", frame.alias("birth_frame"), F.coalesce("_det", "birth_det").alias("birth_det"),
        (F.col("hits") + F.coalesce("base", F.lit(0))).alias("hits"), (F.col("frame_idx") - frame + 1).alias("age"),
    )
