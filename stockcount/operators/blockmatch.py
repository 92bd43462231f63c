"""Best-scoring partners per row, computed block against block inside tasks.

Query rows and reference rows that share a ``scope`` are packed into matrices, the packed rows meet
in an ordinary equi-join on the scope, and one matrix product per joined row yields, for each query,
its ``k`` best labels in that block. A label's score is the maximum over its references. Taking the
best ``k`` per block and again over all blocks is exact: a label that belongs to the final ``k`` is
among the best ``k`` of the block that holds its best reference. Blocks that a chunk of queries meets one
after the other in a task are merged there, so a query leaves the task with ``k`` rows, however many blocks there are.

Only packed rows are shuffled or broadcast; pairs never leave the task that scores them. Tasks read packed rows in
Arrow batches without copying them, and score a chunk in tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockcount.scale import compact, cut

QUERY_ROWS = 1024
REF_ROWS = 4096
# Rows gathered before they are packed by scope.
PACK_ROWS = 32_768
# Queries of a chunk that are scored at once.
TILE_ROWS = 256
# References up to these bytes are broadcast in packed form.
BROADCAST_BYTES = 64_000_000
# Queries of a scope that share a lane, beyond it, as long as lanes are few; more lanes are made only if their
# queries are this many times the references that are copied to each.
LANE_QUERIES = 16_384
LANE_SHARE = 4
FEW_LANES = 16
WHOLE = "*"


def _packer(rows: int, unit: bool, drop_zero: bool, dtype: str, ordered: bool, tagged: bool, labelled: bool):
    """Task-side packing of (scope, key, vec) rows into one row per scope and slice; rows without a scope are left out.

    With ``ordered`` the columns o1 (double) and o2 (long), a position in some order, come along; with
    ``tagged`` a text per key, and rows without a usable vector are packed under a null scope. With ``labelled`` the keys of
    a slice are in order, and its distinct ones come with the row each begins at.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32

        def gathered():
            held, n = [], 0
            for batch in batches:
                held.append(batch)
                n += batch.num_rows
                if n >= PACK_ROWS:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, n = [], 0
            if n:
                yield pa.Table.from_batches(held).combine_chunks()

        def flat(table, name):
            return pa.concat_arrays(table.column(name).chunks)

        def lists(arrays):
            ends = np.cumsum([0, *map(len, arrays)])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(arrays))

        for table in gathered():
            scopes = flat(table, "scope").dictionary_encode()
            codes = scopes.indices.fill_null(-1).to_numpy(zero_copy_only=False).copy()
            blank = len(scopes.dictionary)
            if tagged:
                codes[flat(table, "vec").is_null().to_numpy(zero_copy_only=False)] = blank
            if labelled:
                by = pa.table({"code": codes, "key": flat(table, "key")})
                order = pc.sort_indices(by, sort_keys=[("code", "ascending"), ("key", "ascending")]).to_numpy()
            elif ordered:
                order = np.lexsort((table["o2"].to_numpy(), table["o1"].to_numpy(), codes))
            else:
                order = np.argsort(codes, kind="stable")
            order = order[codes[order] >= 0]
            codes, table = codes[order], table.take(pa.array(order))
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)] if len(codes) else []
            out = {c: [] for c in ("cid", "scope", "keys", "mat", "n", "o1", "o2", "low", "high", "tags", "starts")}

            def add(code, part, full):
                nonlocal number
                for a in range(0, len(part), rows):
                    piece, mat = part.slice(a, rows), full[a : a + rows]
                    keys = flat(piece, "key")
                    if labelled:
                        same = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                        starts = pa.array(np.concatenate(([0], np.flatnonzero(np.diff(same)) + 1)), pa.int32())
                        keys = keys.take(starts)
                        out["starts"].append(starts)
                    number += 1
                    out["cid"].append(number)
                    out["scope"].append(None if code == blank else code)
                    out["keys"].append(keys)
                    out["mat"].append(mat.astype(dtype).tobytes())
                    out["n"].append(len(piece))
                    if ordered:
                        o1 = piece["o1"].to_numpy().astype("float64")
                        out["o1"].append(o1.tobytes())
                        out["o2"].append(piece["o2"].to_numpy().astype("int64").tobytes())
                        out["low"].append(float(o1.min()))
                        out["high"].append(float(o1.max()))
                    if tagged:
                        out["tags"].append(flat(piece, "tag"))

            for a, b in zip(cuts[:-1], cuts[1:]):
                code, part = int(codes[a]), table.slice(a, b - a)
                if code == blank:
                    add(code, part, np.empty((b - a, 0)))
                    continue
                vecs = flat(part, "vec")
                sizes = np.unique(vecs.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False))
                if len(sizes) != 1 or sizes[0] < 0:
                    raise ValueError("vectors of one scope must all have the same size")
                full = vecs.flatten().to_numpy(zero_copy_only=False).reshape(b - a, int(sizes[0]))
                if unit and drop_zero:
                    live = np.linalg.norm(full.astype("float64"), axis=1) >= 1e-10
                    if not live.all():
                        if tagged:
                            add(blank, part.filter(pa.array(~live)), np.empty((int((~live).sum()), 0)))
                        part, full = part.filter(pa.array(live)), full[live]
                add(code, part, full)
            if not out["n"]:
                continue
            packed = {
                "cid": pa.array(out["cid"], pa.int64()),
                "scope": scopes.dictionary.take(pa.array(out["scope"], pa.int32())),
                "keys": lists(out["keys"]),
                "mat": pa.array(out["mat"], pa.binary()),
                "n": pa.array(out["n"], pa.int32()),
            }
            if ordered:
                packed |= {c: pa.array(out[c], pa.binary()) for c in ("o1", "o2")}
                packed |= {c: pa.array(out[c], pa.float64()) for c in ("low", "high")}
            if tagged:
                packed["tags"] = lists(out["tags"])
            if labelled:
                packed["starts"] = lists(out["starts"])
            yield pa.RecordBatch.from_pydict(packed)

    return run


def _similarity(score: str):
    def cosine(a, b):
        return a @ b.T

    def box_iou(a, b):
        import numpy as np

        w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
        h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
        inter = np.clip(w, 0, None) * np.clip(h, 0, None)
        area_a = (a[:, 2] - a[:, 0]) * (a[:, 3] - a[:, 1])
        area_b = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
        union = area_a[:, None] + area_b[None, :] - inter
        return np.where(inter > 0, inter / np.where(union > 0, union, 1.0), 0.0)

    return cosine if score == "cosine" else box_iou


def best_in_block(sims, labels, k: int):
    """Row, label and similarity of the ``k`` best labels per row of a block; equal labels are neighbours."""
    import numpy as np

    starts = np.concatenate(([0], np.flatnonzero(labels[1:] != labels[:-1]) + 1))
    rows, cols, vals = _best_runs(sims, starts, k)
    return rows, labels[starts][cols], vals


def _best_runs(sims, starts, k: int):
    """Row, run and highest similarity of the ``k`` best runs of columns per row; runs begin at ``starts``."""
    import numpy as np

    best = np.maximum.reduceat(sims, starts, axis=1)
    if best.shape[1] > k:
        floor = np.partition(best, -k, axis=1)[:, -k]
        rows, cols = np.nonzero(best >= floor[:, None])
    else:
        rows, cols = np.nonzero(np.ones_like(best, dtype=bool))
    vals = best[rows, cols]
    order = np.lexsort((cols, -vals, rows))
    rows, cols, vals = rows[order], cols[order], vals[order]
    first = np.searchsorted(rows, rows, side="left")
    keep = np.arange(len(rows)) - first < k
    return rows[keep], cols[keep], vals[keep]


def _merged_best(parts, names: list, k: int):
    """The ``k`` best labels per row from the best of several blocks: arrays (row, number of label, similarity)."""
    import numpy as np

    rows, codes, vals = (np.concatenate(c) for c in zip(*parts))
    # As in Spark's order: NaN is the largest, a missing label comes first.
    high = np.where(np.isnan(vals), np.inf, vals)
    order = np.lexsort((-high, codes, rows))
    rows, codes, vals, high = rows[order], codes[order], vals[order], high[order]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:] != rows[:-1]) | (codes[1:] != codes[:-1])
    rows, codes, vals, high = rows[first], codes[first], vals[first], high[first]
    place = np.empty(len(names), dtype="int64")
    place[sorted(range(len(names)), key=lambda i: (names[i] is not None, *([] if names[i] is None else [names[i]])))] = np.arange(len(names))
    order = np.lexsort((place[codes], -high, rows))
    rows, codes, vals = rows[order], codes[order], vals[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
    return rows[keep], codes[keep], vals[keep]


def _matrix(column, i: int, rows: int, dtype: str, unit: bool):
    """Row ``i`` of a packed column as a matrix, its rows of length one if ``unit``."""
    import numpy as np

    m = np.frombuffer(column[i].as_buffer(), dtype=dtype).reshape(rows, -1).astype("float64")
    return m / np.maximum(np.linalg.norm(m, axis=1), 1e-10)[:, None] if unit else m


def _matcher(k: int, score: str, tagged: bool, q_dtype: str, r_dtype: str):
    """Task-side scoring of packed query rows against packed reference rows.

    Joined rows of one chunk that follow each other are merged. With ``tagged`` a query row that met no reference yields
    its keys once, without label.
    """
    similarity, unit = _similarity(score), score == "cosine"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        chunk, keys, tags, q, parts, held = None, None, None, None, [], 0
        numbers = {}

        def own(array):
            # A copy, so that the batch it lies in can go.
            return pa.concat_arrays([array, array.slice(0, 0)])

        def result(label_type):
            if parts:
                names = list(numbers)
                rows, codes, vals = _merged_best(parts, names, k)
                at = pa.array(rows)
                out = [keys.take(at), pa.array(names, label_type).take(pa.array(codes)), pa.array(vals, pa.float64())]
            else:
                at = pa.array(np.arange(len(keys)))
                out = [keys, pa.nulls(len(keys), label_type), pa.nulls(len(keys), pa.float64())]
            out += [tags.take(at)] if tagged else []
            return pa.RecordBatch.from_arrays(out, names=["key", "label", "sim", *(["tag"] if tagged else [])])

        label_type = None
        for batch in batches:
            column = {c: batch.column(c) for c in batch.schema.names}
            label_type = column["labels"].type.value_type
            cids, ns, ref_ns = (column[c].to_pylist() for c in ("cid", "n", "ref_n"))
            for i, cid in enumerate(cids):
                if cid != chunk:
                    if chunk is not None and (parts or tagged):
                        yield result(label_type)
                    chunk, parts, held, numbers = cid, [], 0, {}
                    keys = own(column["keys"][i].values)
                    tags = own(column["tags"][i].values) if tagged else None
                    q = None
                if ref_ns[i] is None:
                    continue
                if q is None:
                    q = _matrix(column["mat"], i, ns[i], q_dtype, unit)
                ref = _matrix(column["ref_mat"], i, ref_ns[i], r_dtype, unit)
                starts = column["starts"][i].values.to_numpy()
                codes = np.array([numbers.setdefault(x, len(numbers)) for x in column["labels"][i].values.to_pylist()], dtype="int64")
                for at in range(0, len(q), TILE_ROWS):
                    rows, runs, vals = _best_runs(similarity(q[at : at + TILE_ROWS], ref), starts, k)
                    parts.append((rows + at, codes[runs], vals))
                    held += len(rows)
                if held > 16 * k * len(q):
                    parts = [_merged_best(parts, list(numbers), k)]
                    held = len(parts[0][0])
        if chunk is not None and (parts or tagged):
            yield result(label_type)

    return run


def _earlier(score: str, threshold: float, strict: bool, dtype: str):
    """Task-side test: which queries have a close reference that comes before them in the order."""
    similarity, unit = _similarity(score), score == "cosine"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            column = {c: batch.column(c) for c in batch.schema.names}
            ns, ref_ns = column["n"].to_pylist(), column["ref_n"].to_pylist()
            for i in range(batch.num_rows):
                q = _matrix(column["mat"], i, ns[i], dtype, unit)
                ref = _matrix(column["ref_mat"], i, ref_ns[i], dtype, unit)
                q1, b1 = (np.frombuffer(column[c][i].as_buffer(), dtype="float64") for c in ("o1", "ref_o1"))
                q2, b2 = (np.frombuffer(column[c][i].as_buffer(), dtype="int64") for c in ("o2", "ref_o2"))
                found = np.zeros(len(q), dtype=bool)
                for at in range(0, len(q), TILE_ROWS):
                    tile = slice(at, at + TILE_ROWS)
                    sims = similarity(q[tile], ref)
                    close = sims > threshold if strict else sims >= threshold
                    close &= (b1[None, :] < q1[tile, None]) | ((b1[None, :] == q1[tile, None]) & (b2[None, :] < q2[tile, None]))
                    found[tile] = close.any(axis=1)
                if found.any():
                    yield pa.RecordBatch.from_arrays([column["keys"][i].values.take(pa.array(np.flatnonzero(found)))], names=["key"])

    return run


def _dtype(df: DataFrame) -> str:
    """How vectors are packed: as they are stored if these are floats."""
    return "float32" if df.schema["vec"].dataType.elementType.simpleString() == "float" else "float64"


def _pack(
    df: DataFrame, rows: int, unit: bool, drop_zero: bool, ordered: bool = False, tagged: bool = False, labelled: bool = False
) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = f"cid long, scope {types['scope']}, keys array<{types['key']}>, mat binary, n int"
    if ordered:
        schema += ", o1 binary, o2 binary, low double, high double"
    if tagged:
        schema += ", tags array<string>"
    if labelled:
        schema += ", starts array<int>"
    cols = ["scope", "key", "vec", *(["o1", "o2"] if ordered else []), *(["tag"] if tagged else [])]
    return df.select(*cols).mapInArrow(_packer(rows, unit, drop_zero, _dtype(df), ordered, tagged, labelled), schema)


def _spread(chunks: DataFrame) -> DataFrame:
    """Chunks dealt evenly: each is many bytes' worth of work, and a stated number of partitions is not put together again."""
    spark = chunks.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return chunks.repartition(tasks, "cid")


def packed_bytes(refs: DataFrame) -> int:
    """Bytes of the packed vectors of ``refs``."""
    width = 4 if _dtype(refs) == "float32" else 8
    return refs.agg(F.sum(F.size("vec").cast("long") * width)).first()[0] or 0


def _lanes(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """Lanes of each scope that both sides have."""
    few = max(FEW_LANES, 2 * queries.sparkSession.sparkContext.defaultParallelism)
    asked = queries.filter("scope is not null").groupBy("scope").agg(F.count(F.lit(1)).alias("asked"))
    known = refs.groupBy("scope").agg(F.count(F.lit(1)).alias("known"))
    wide = F.ceil(F.col("asked") / F.greatest(F.lit(LANE_QUERIES), LANE_SHARE * F.col("known")))
    number = F.greatest(F.least(F.ceil(F.col("asked") / LANE_QUERIES), F.lit(few)), wide)
    return asked.join(known, "scope").select("scope", number.cast("int").alias("lanes"))


def _meet(
    chunks: DataFrame,
    blocks: DataFrame,
    queries: DataFrame,
    refs: DataFrame,
    broadcast_bytes: int,
    on: Column | None = None,
    how: str = "inner",
) -> DataFrame:
    """Joins packed queries with the packed references of their scope.

    References of a checked size in bytes are broadcast. Beyond it the queries of a scope are spread over lanes
    by their number, and its reference blocks are copied to its own lanes alone, so that no task receives the queries of a whole
    hot scope and a scope with few queries has its blocks once. Beyond a few lanes for the cores there are, a lane takes
    more queries than the scope has references: what is copied stays a share of the queries.
    """
    if packed_bytes(refs) <= broadcast_bytes:
        joined = _spread(chunks).join(F.broadcast(blocks), "scope", how)
    else:
        lanes = compact(cut(_lanes(queries, refs)))
        laned = chunks.join(lanes, "scope", "left").withColumn("lane", F.pmod(F.xxhash64("cid"), F.col("lanes")).cast("int"))
        copies = blocks.join(lanes, "scope").withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)))
        joined = laned.drop("lanes").join(copies.drop("lanes"), ["scope", "lane"], how)
    return joined if on is None else joined.filter(on)


def block_hits(
    queries: DataFrame, refs: DataFrame, k: int, score: str = "cosine", broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """(key, label, sim) rows, at most ``k`` per query and run of blocks in a task.

    ``queries`` has columns scope, key, vec and ``refs`` has scope, label, vec. Queries with a text
    column ``tag`` keep it, and those that meet nothing or have no usable vector yield one row with
    null label and similarity.
    """
    unit = score == "cosine"
    tagged = "tag" in queries.columns
    q_type = queries.schema["key"].dataType.simpleString()
    l_type = refs.schema["label"].dataType.simpleString()
    chunks = _pack(queries, QUERY_ROWS, unit, drop_zero=True, tagged=tagged)
    named = refs.select("scope", F.col("label").alias("key"), "vec")
    blocks = _pack(named, REF_ROWS, unit, drop_zero=False, labelled=True).select(
        "scope", F.col("keys").alias("labels"), "starts", F.col("mat").alias("ref_mat"), F.col("n").alias("ref_n")
    )
    cols = ["cid", "keys", "mat", "n", "labels", "starts", "ref_mat", "ref_n", *(["tags"] if tagged else [])]
    schema = f"key {q_type}, label {l_type}, sim double" + (", tag string" if tagged else "")
    hits = (
        _meet(chunks, blocks, queries, refs, broadcast_bytes, how="left" if tagged else "inner")
        .select(*cols)
        .mapInArrow(_matcher(k, score, tagged, _dtype(queries), _dtype(refs)), schema)
    )
    return hits.withColumn("sim", F.nanvl("sim", F.lit(None).cast("double"))) if tagged else hits


def best_labels(
    queries: DataFrame, refs: DataFrame, k: int, score: str = "cosine", broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """The ``k`` best labels per query: key, label, sim, rank; ties go to the smaller label."""
    hits = block_hits(queries, refs, k, score, broadcast_bytes)
    tag = ["tag"] if "tag" in queries.columns else []
    # One exchange on the query serves both the maximum over blocks and the ranking.
    merged = hits.repartition("key").groupBy("key", "label", *tag).agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("key").orderBy(F.desc("sim"), F.asc("label"))
    return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def best_score(
    queries: DataFrame, refs: DataFrame, score: str = "cosine", broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Highest score per query over every reference of its scope: key, sim."""
    flat = refs.select("scope", F.lit(0).alias("label"), "vec")
    return block_hits(queries, flat, 1, score, broadcast_bytes).groupBy("key").agg(F.max("sim").alias("sim"))


def with_earlier_partner(
    items: DataFrame, threshold: float, strict: bool, score: str = "cosine", broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Keys of the items that have a close item of their scope before them in the order (o1, o2)."""
    unit = score == "cosine"
    k_type = items.schema["key"].dataType.simpleString()
    chunks = _pack(items, QUERY_ROWS, unit, drop_zero=True, ordered=True)
    blocks = _pack(items, REF_ROWS, unit, drop_zero=True, ordered=True).select(
        "scope",
        F.col("mat").alias("ref_mat"),
        F.col("n").alias("ref_n"),
        F.col("o1").alias("ref_o1"),
        F.col("o2").alias("ref_o2"),
        F.col("low").alias("ref_low"),
    )
    # Blocks that lie entirely after a chunk cannot matter to it.
    return (
        _meet(chunks, blocks, items, items, broadcast_bytes, on=F.col("ref_low") <= F.col("high"))
        .select("keys", "mat", "n", "o1", "o2", "ref_mat", "ref_n", "ref_o1", "ref_o2")
        .mapInArrow(_earlier(score, threshold, strict, _dtype(items)), f"key {k_type}")
        .distinct()
    )
