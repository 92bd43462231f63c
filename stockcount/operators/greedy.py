"""Order-dependent greedy selection, exact and without putting a whole group into one task.

An item is kept unless an earlier kept item of its group scores at or above the threshold. Groups
up to ``prefix`` items are settled in one grouped call, which takes them in runs. Larger ones go in rounds. A round settles the
first ``prefix`` items of each group in order, and keeps every item without any close item before it;
items close to a newly kept one drop out, the others form the next round. All comparisons run block
against block and give one flag per item. Copies collapse to their first occurrence before anything
else, so a group of copies costs one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockcount.operators.blockmatch import best_score, with_earlier_partner
from stockcount.scale import cut

PREFIX = 512
#: Boxes overlap only boxes of like size, so a call settles more of them: memory holds one group, work follows its kept boxes of like size.
BOX_PREFIX = 65_536
#: Rows of a group that are compared at once.
RUN = 512


def _settle(score: str, threshold: float, strict: bool):
    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import pandas as pd

        def cosine(a, b):
            return a @ b.T

        def box_iou(a, b):
            left = np.maximum(a[:, None, 0], b[None, :, 0])
            top = np.maximum(a[:, None, 1], b[None, :, 1])
            right = np.minimum(a[:, None, 2], b[None, :, 2])
            bottom = np.minimum(a[:, None, 3], b[None, :, 3])
            inter = np.clip(right - left, 0, None) * np.clip(bottom - top, 0, None)
            area_a = (a[:, 2] - a[:, 0]) * (a[:, 3] - a[:, 1])
            area_b = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
            union = area_a[:, None] + area_b[None, :] - inter
            return np.where(inter > 0, inter / np.where(union > 0, union, 1.0), 0.0)

        def is_close(a, b):
            sims = (cosine if score == "cosine" else box_iou)(a, b)
            return sims > threshold if strict else sims >= threshold

        def classes(m):
            """Classes of width and height: boxes that overlap by the threshold differ by at most one in each."""
            step = -np.log(threshold) + 1e-9
            extent = m[:, 2:] - m[:, :2]
            return np.floor(np.log(extent) / step).astype("int64")

        def kept_of(m):
            """Which rows of one scope, in order, are kept: runs of rows against those kept before, then among themselves."""
            sorted_out = score != "cosine" and 0.05 <= threshold < 1 and (m[:, 2:] > m[:, :2]).all()
            kind = classes(m) if sorted_out else np.zeros((len(m), 2), dtype="int64")
            alive = np.ones(len(m), dtype=bool)
            before: dict[tuple, list] = {}
            for at in range(0, len(m), RUN):
                run, mine = m[at : at + RUN], alive[at : at + RUN]
                kinds, of = np.unique(kind[at : at + RUN], axis=0, return_inverse=True)
                of = of.reshape(-1)
                for n, (x, y) in enumerate(kinds.tolist() if before else []):
                    near = [v for i in (-1, 0, 1) for j in (-1, 0, 1) for v in before.get((x + i, y + j), [])]
                    near, rows = np.concatenate([m[:0], *near]), np.flatnonzero(of == n)
                    for first in range(0, len(near), 8 * RUN):
                        mine[rows] &= ~is_close(run[rows], near[first : first + 8 * RUN]).any(axis=1)
                live = np.flatnonzero(mine)
                close = is_close(run[live], run[live])
                for i in range(len(live)):
                    if mine[live[i]]:
                        mine[live[i + 1 :]] &= ~close[i, i + 1 :]
                for n, key in enumerate(map(tuple, kinds.tolist())):
                    if (mine & (of == n)).any():
                        before.setdefault(key, []).append(run[mine & (of == n)])
            return alive

        def survivors(pdf):
            scope = pdf["scope"].to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(scope[1:] != scope[:-1]) + 1, [len(scope)]))
            vecs = pdf["vec"].to_numpy()
            alive = np.ones(len(scope), dtype=bool)
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b - a == 1:
                    continue
                m = np.stack(vecs[a:b]).astype("float64")
                if score == "cosine":
                    m = m / np.maximum(np.linalg.norm(m, axis=1), 1e-10)[:, None]
                alive[a:b] = kept_of(m)
            return pdf.loc[alive, ["scope", "key", "vec"]]

        # Rows arrive ordered by scope; only the scope at the end of a batch may continue.
        held = None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            open_scope = (pdf["scope"] == pdf["scope"].iloc[-1]).to_numpy()
            held = pdf[open_scope]
            if not open_scope.all():
                yield survivors(pdf[~open_scope].reset_index(drop=True))
        if held is not None:
            yield survivors(held.reset_index(drop=True))

    return settle


def _settled(items: DataFrame, fn, schema: str) -> DataFrame:
    """Settles whole scopes, many per call: scopes are hashed to buckets and read as a sorted stream."""
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * tasks
    bucketed = items.withColumn("bucket", F.pmod(F.xxhash64("scope"), F.lit(buckets)).cast("int"))
    return (
        bucketed.repartition(tasks, "bucket")
        .sortWithinPartitions("bucket", "scope", "o1", "o2")
        .select("bucket", "scope", "key", "vec")
        .groupBy("bucket")
        .applyInPandas(fn, schema)
    )


def greedy_keep(
    items: DataFrame,
    threshold: float,
    score: str = "cosine",
    strict: bool = False,
    comparable: Column | None = None,
    prefix: int | None = None,
) -> DataFrame:
    """Keys of the kept items.

    ``items`` has columns scope, key, vec and the order (o1 double, o2 long), unique per scope. Rows
    for which ``comparable`` is false (a zero vector, an empty box) match nothing and are always kept.
    """
    prefix = prefix or (PREFIX if score == "cosine" else BOX_PREFIX)
    # Whatever the items come from runs once.
    items = cut(items.select("scope", "key", "vec", "o1", "o2", (F.lit(True) if comparable is None else comparable).alias("_comparable")))
    kept = [items.filter("not _comparable").select("key")]
    first = F.min(F.struct("o1", "o2", "key")).alias("first")
    undecided = (
        items.filter("_comparable").groupBy("scope", "vec").agg(first).select("scope", "first.key", "first.o1", "first.o2", "vec")
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in undecided.schema if f.name in ("scope", "key", "vec"))
    fn = _settle(score, threshold, strict)
    by_order = Window.partitionBy("scope").orderBy("o1", "o2")
    hit = F.col("sim") > threshold if strict else F.col("sim") >= threshold

    def without_neighbours(rows: DataFrame, won: DataFrame) -> DataFrame:
        near = best_score(rows, won.select("scope", "key", "vec"), score).filter(hit)
        return rows.join(near, "key", "left_anti")

    while (undecided.groupBy("scope").count().agg(F.max("count")).first()[0] or 0) > prefix:
        undecided = cut(undecided)
        # Ranking with a limit keeps at most ``prefix`` rows per scope and task before the shuffle.
        head = undecided.withColumn("rn", F.row_number().over(by_order)).filter(F.col("rn") <= prefix).drop("rn")
        won = cut(_settled(head, fn, schema))
        kept.append(won.select("key"))
        last = head.groupBy("scope").agg(F.max(F.struct("o1", "o2")).alias("last"))
        rest = undecided.join(last, "scope").filter(F.struct("o1", "o2") > F.col("last")).drop("last")
        rest = cut(without_neighbours(rest, won))
        # What has no close item before it is kept whatever happens to the others.
        free = cut(rest.join(with_earlier_partner(rest, threshold, strict, score), "key", "left_anti"))
        kept.append(free.select("key"))
        undecided = cut(without_neighbours(rest.join(free.select("key"), "key", "left_anti"), free))

    kept.append(_settled(undecided, fn, schema).select("key"))
    return reduce(DataFrame.unionByName, kept)
