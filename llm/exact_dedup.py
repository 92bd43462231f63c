"""Documents whose whole texts are equal, found by inserting full byte strings into compressed radix tries.

1. Every row gets the length and a 64-bit hash of its text. A text alone with its length and hash equals no other
   one, so only the others go on; if their keys are too many to travel to the texts, all texts go on.
2. Each task inserts its texts into a trie of its own and hands on one entry for each distinct string, so a group
   of copies meets as one entry for each task.
3. Entries are dealt out by length and hash, and the trie of such a partition decides on the bytes which strings
   are equal. The node at which a string ends, its owner, keeps the id that stays and the number of rows.
4. A trie over its bound of bytes gives up its heaviest subtree. While combining, the entries under it are handed on early.
   In a partition its place is closed instead: strings that lead there are entries of a further round, which deals
   them out by another hash over more partitions. So equal strings stay together, and no string is lost.

The owners' table has the groups of two rows or more only; it meets the rows by SHA-256.

Defined cases: null text is empty, and empty texts are equal; a null id is smaller than every id and stays only if
the group has no other; of rows of equal id and text one stays; an empty table gives no rows; further columns of
the caller don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from stockcount.scale import cut, fits

from llm.text import FEW_ROWS, broadcast_if_few, private

#: Bytes of labels and nodes that a trie holds, and what a node counts for.
TRIE_BYTES = 128_000_000
NODE_BYTES = 400
#: Bytes of texts in a batch that a task hands on.
BATCH_BYTES = 4_000_000

ENTRY = "text binary, length long, hash long, n long, owner long, ties long"


class Node:
    """A label, what follows it by first byte, and what is known of the string that ends here: its rows (0: none does)."""

    __slots__ = ("label", "kids", "n", "owner", "ties", "hash", "closed")

    def __init__(self, label: bytes) -> None:
        self.label = label
        self.kids: dict[int, Node] = {}
        self.n = 0
        self.owner: int | None = None
        self.ties = 0
        self.hash = 0
        self.closed = False


def shared_prefix(label: bytes, key: bytes, at: int) -> int:
    """How many bytes of ``label`` are those of ``key`` from ``at`` on."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if key.startswith(label[low:mid], at + low):
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """Compressed radix trie over byte strings, with a count of the bytes it holds."""

    def __init__(self) -> None:
        self.root, self.held, self.strings = Node(b""), 0, 0

    def insert(self, key: bytes, hash_: int, n: int, owner: int | None, ties: int) -> bool:
        """Adds ``n`` rows of a string, of which ``ties`` have its largest id; False if it leads to a closed node."""
        node, at, end = self.root, 0, len(key)
        while at < end:
            kid = node.kids.get(key[at])
            if kid is None:
                kid = node.kids[key[at]] = Node(key[at:])
                self.held += end - at + NODE_BYTES
                node = kid
                break
            if key.startswith(kid.label, at):
                node, at = kid, at + len(kid.label)
                if node.closed:
                    return False
                continue
            shared = shared_prefix(kid.label, key, at)
            fork = Node(kid.label[:shared])
            kid.label = kid.label[shared:]
            fork.kids[kid.label[0]] = kid
            node.kids[key[at]] = fork
            self.held += NODE_BYTES
            node, at = fork, at + shared
        if node.n == 0:
            self.strings += 1
            node.n, node.owner, node.ties, node.hash = n, owner, ties, hash_
            return True
        node.n += n
        if owner == node.owner:
            node.ties += ties
        elif node.owner is None or (owner is not None and owner > node.owner):
            node.owner, node.ties = owner, ties
        return True

    def entries(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, Node]]:
        """The strings at and below a node, whose place is reached by ``prefix``."""
        todo = [(node or self.root, prefix)]
        while todo:
            node, prefix = todo.pop()
            whole = prefix + node.label
            if node.n:
                yield whole, node
            todo += [(kid, whole) for kid in node.kids.values()]

    def _sizes(self) -> dict[int, int]:
        order, sizes = [self.root], {}
        for node in order:
            order += node.kids.values()
        for node in reversed(order):
            sizes[id(node)] = len(node.label) + NODE_BYTES + sum(sizes[id(k)] for k in node.kids.values())
        return sizes

    def spill(self, close: bool) -> list[tuple[bytes, Node]]:
        """Takes out the heaviest subtree of at most half of what is held (or one string); its place is closed if asked."""
        sizes, parent, prefix = self._sizes(), self.root, b""
        weight = lambda k: (not k.closed, sizes[id(k)])
        node = max(parent.kids.values(), key=weight)
        while sizes[id(node)] > self.held // 2 and node.kids:
            heaviest = max(node.kids.values(), key=weight)
            if heaviest.closed:
                break
            prefix, parent, node = prefix + node.label, node, heaviest
        found = list(self.entries(node, prefix))
        self.held -= sizes[id(node)]
        self.strings -= len(found)
        if close:
            stub = Node(node.label)
            stub.closed = True
            parent.kids[node.label[0]] = stub
            self.held += len(node.label) + NODE_BYTES
        else:
            del parent.kids[node.label[0]]
        return found


class _Out:
    """Rows on their way out, in batches of bounded size."""

    def __init__(self, names: list[str], types: list[pa.DataType]) -> None:
        self.schema = pa.schema(list(zip(names, types, strict=True)))
        self.rows: list[tuple] = []
        self.held = 0

    def add(self, row: tuple, size: int) -> bool:
        self.rows.append(row)
        self.held += size + 64
        return self.held >= BATCH_BYTES

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[] for _ in self.schema]
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
        self.rows, self.held = [], 0
        return batch


def _entries_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    # In runs, so that a batch's texts are not all held twice.
    for at in range(0, batch.num_rows, 256):
        part = batch.slice(at, 256)
        yield from zip(*(part.column(c).to_pylist() for c in ("text", "length", "hash", "n", "owner", "ties")), strict=True)


def _combine(limit: int):
    """Distinct strings of a task, those of a subtree early when the trie is over its bound."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        out = _Out(["text", "length", "hash", "n", "owner", "ties"], [pa.binary(), *[pa.int64()] * 5])

        def handed(found):
            for text, node in found:
                if out.add((text, len(text), node.hash, node.n, node.owner, node.ties), len(text)):
                    yield out.take()

        for batch in batches:
            for text, _, hash_, n, owner, ties in _entries_of(batch):
                trie.insert(text, hash_, n, owner, ties)
                while trie.held > limit and trie.strings > 1 and trie.root.kids:
                    yield from handed(trie.spill(close=False))
        yield from handed(trie.entries())
        yield out.take()

    return task


def _decide(limit: int):
    """Owners of a partition's strings, and the entries under closed places for another round."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        names = ["text", "length", "hash", "n", "owner", "ties", "sha"]
        out = _Out(names, [pa.binary(), *[pa.int64()] * 5, pa.string()])

        def again(text, hash_, n, owner, ties):
            return out.add((text, len(text), hash_, n, owner, ties, None), len(text))

        for batch in batches:
            for text, _, hash_, n, owner, ties in _entries_of(batch):
                if not trie.insert(text, hash_, n, owner, ties):
                    if again(text, hash_, n, owner, ties):
                        yield out.take()
                while trie.held > limit and trie.strings > 1:
                    for key, node in trie.spill(close=True):
                        if again(key, node.hash, node.n, node.owner, node.ties):
                            yield out.take()
        for text, node in trie.entries():
            if out.add((None, len(text), node.hash, node.n, node.owner, node.ties, sha256(text).hexdigest()), 0):
                yield out.take()
        yield out.take()

    return task


def owners(texts: DataFrame, limit: int = TRIE_BYTES) -> DataFrame:
    """sha, n, owner, ties for each distinct string of ``texts`` (the columns of ENTRY), checkpointed."""
    left = texts.mapInArrow(_combine(limit), ENTRY)
    tasks, done, turn = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), None, 0
    while True:
        keys = [F.col("length"), F.col("hash")]
        dealt = left.repartition(*keys) if turn == 0 else left.repartition(tasks << 2 * turn, *keys, F.xxhash64("length", "hash", F.lit(turn)))
        out = cut(dealt.mapInArrow(_decide(limit), f"{ENTRY}, sha string"))
        found = out.where("sha is not null").select("sha", "n", "owner", "ties")
        done = found if done is None else done.unionByName(found)
        left, turn = out.where("sha is null").drop("sha"), turn + 1
        if left.isEmpty():
            return done


def exact_copies(docs: DataFrame, limit: int = TRIE_BYTES, few: int = FEW_ROWS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 per row of ``docs``; the largest id of equal texts stays."""
    docs = private(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    length, hash_ = F.octet_length("text").cast("long").alias("length"), F.xxhash64("text").alias("hash")
    rows = cut(docs.select("doc_id", length, hash_, F.sha2("text", 256).alias("sha"), F.monotonically_increasing_id().alias("row")))
    keys = cut(rows.groupBy("length", "hash").count().where("count > 1").select("length", "hash"))
    entries = docs.select(F.col("text").cast("binary").alias("text"), length, hash_, F.lit(1).cast("long").alias("n"), F.col("doc_id").alias("owner"), F.lit(1).cast("long").alias("ties"))
    if fits(keys, few):
        entries = entries.join(F.broadcast(keys), ["length", "hash"], "left_semi")
    groups = cut(owners(entries.select("text", "length", "hash", "n", "owner", "ties"), limit).where("n > 1"))
    tied = groups.where("ties > 1").select("sha", "owner")
    winners = None
    if not tied.isEmpty():
        among = rows.join(broadcast_if_few(tied), "sha").where(F.col("doc_id").eqNullSafe(F.col("owner")))
        winners = cut(among.groupBy("sha").agg(F.min("row").alias("winner")))
        groups = groups.join(winners, "sha", "left")
    else:
        groups = groups.withColumn("winner", F.lit(None).cast("long"))
    out = rows.join(broadcast_if_few(groups), "sha", "left")
    alone = F.col("n").isNull()
    stays = F.col("doc_id").eqNullSafe(F.col("owner")) & (F.col("winner").isNull() | (F.col("winner") == F.col("row")))
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("owner")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | stays).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
