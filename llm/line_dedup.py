"""Removal of lines that many documents share.

Every line of at least ``min_chars`` code points becomes a small record (hash, document, position). The
records are dealt out by ranges of (hash, document), sorted inside by position, so a line that a third of all
documents share spreads over many ranges. Each sorted range is streamed into one partial count per line, and
the partial counts meet in a second, small aggregation. What comes back for a document is not text but a
bitmap of kept lines, 64 lines to a word, and only for documents that lose a line.

Defined cases: null and empty texts are one empty line; rows with the same document id count as one document,
and each loses the shared lines of its own text; rows without a document id neither count nor lose lines; further columns stay untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from stockcount.scale import cut

from llm.text import BLANKS, LOWER, UPPER, broadcast_if_few, private

#: Words of all bitmaps together that may be broadcast (8 bytes each).
BITMAP_WORDS = 4_000_000


def line_array(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_records(docs: DataFrame, min_chars: int) -> DataFrame:
    """h, g, doc_id, text_hash, position: a record per line long enough; two hashes, 96 bits, stand for the key."""
    lines = private(docs, "doc_id", "text").where("doc_id is not null").select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(line_array(F.col("text"))).alias("position", "line")
    )
    keyed = lines.select("doc_id", "text_hash", "position", line_key(F.col("line")).alias("key")).where(
        F.length("key") >= min_chars
    )
    return keyed.select(F.xxhash64("key").alias("h"), F.hash("key").alias("g"), "doc_id", "text_hash", "position")


def dropped_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """doc_id, text_hash, position of each line that goes: its key is in ``min_docs`` documents, another holds it last."""
    records = line_records(docs, min_chars)
    ranged = cut(
        records.repartitionByRange("h", "g", "doc_id").sortWithinPartitions("h", "g", "doc_id", "position")
    )
    # Neighbours in a range are one document's: one row per line and document, then one per line.
    held = ranged.groupBy("h", "g", "doc_id").agg(F.lit(1).alias("held"))
    keepers = (
        held.groupBy("h", "g")
        .agg(F.count("held").alias("n_docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
        .select("h", "g", "keeper")
    )
    # Both sides of the join are plain tables: a small one is broadcast, otherwise Spark can split a hot line.
    return ranged.join(broadcast_if_few(cut(keepers)), ["h", "g"]).where(F.col("doc_id") != F.col("keeper")).select("doc_id", "text_hash", "position")


def keep_bitmaps(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """doc_id, text_hash, keep (array of 64-bit words up to the last one with a lost line), n_dropped; lossy documents only."""
    # Rows of one id may have different texts: a bitmap belongs to an id and a text.
    text = ["doc_id", "text_hash"]
    lost = dropped_lines(docs, min_docs, min_chars).select(
        *text, F.expr("position div 64").cast("int").alias("word"), F.expr("shiftleft(1L, position % 64)").alias("bit")
    ).distinct()
    by_word = lost.groupBy(*text, "word").agg(F.bit_or("bit").alias("mask"), F.count("bit").alias("n"))
    packed = by_word.groupBy(*text).agg(
        F.sort_array(F.collect_list(F.struct("word", "mask"))).alias("masks"), F.sum("n").alias("n_dropped")
    )
    # Words without a lost line are filled in, so that a word is found by its number.
    filled = packed.select(*text, "n_dropped", F.explode("masks").alias("m"), F.element_at("masks", -1)["word"].alias("top"))
    holes = packed.select(
        *text,
        "n_dropped",
        F.explode(
            F.filter(
                F.transform(
                    "masks", lambda x, i: F.struct(F.coalesce(F.get("masks", i - 1)["word"] + 1, F.lit(0)).alias("a"), (x["word"] - 1).alias("b"))
                ),
                lambda r: r["a"] <= r["b"],
            )
        ).alias("r"),
    ).select(*text, "n_dropped", F.explode(F.sequence("r.a", "r.b")).alias("word"), F.lit(0).cast("long").alias("mask"))
    words = filled.select(*text, "n_dropped", F.col("m.word").alias("word"), F.col("m.mask").alias("mask")).unionByName(holes)
    return words.groupBy(*text, "n_dropped").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("word", "mask"))), lambda x: F.bitwise_not(x["mask"])).alias("keep")
    ).select(*text, "keep", "n_dropped")


def kept_text(text: Column, keep: str) -> Column:
    """The text without the lines whose bit in ``keep`` is 0; lines beyond the bitmap stay."""
    lines = F.expr(
        f"filter(split(coalesce(text, ''), '\n', -1), (line, i) -> coalesce(getbit(get({keep}, int(i div 64)), int(i % 64)), 1) = 1)"
    )
    return F.when(F.col(keep).isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(lines, "\n"))


def with_bitmaps(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """``docs`` with the columns _keep and _n_dropped; bitmaps are broadcast only if their summed size is small."""
    maps = cut(keep_bitmaps(docs, min_docs, min_chars)).select(
        F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), F.col("keep").alias("_keep"), F.col("n_dropped").alias("_n_dropped")
    )
    total = maps.agg((F.sum(F.size("_keep")) + F.count("_doc")).alias("n")).first()["n"] or 0
    right = F.broadcast(maps) if total <= BITMAP_WORDS else maps
    same = (docs["doc_id"] == right["_doc"]) & (F.xxhash64(docs["text"]) == right["_hash"])
    return docs.join(right, same, "left").drop("_doc", "_hash")


def drop_shared_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """``docs`` with shared lines removed from ``text``; null text stays null, all columns and rows stay."""
    slim = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["doc_id"], docs["text"])
    marked = with_bitmaps(slim, min_docs, min_chars)
    text = F.when(F.col("_keep").isNull(), F.col("text")).otherwise(kept_text(F.col("text"), "_keep"))
    return marked.select(*[text.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])


def line_report(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 per row of ``docs``, and keep, the bitmap (null: all lines stay)."""
    marked = with_bitmaps(private(docs, "doc_id", "text"), min_docs, min_chars)
    return marked.select(
        "doc_id",
        F.size(line_array(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce("_n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(kept_text(F.col("text"), "_keep"), 256).alias("kept_sha256"),
        F.col("_keep").alias("keep"),
    )
