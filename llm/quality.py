"""Quality rules whose limits come from the data.

Each document gets counts and, from them, integer measures (thousandths). For every language and source a
quantile sketch of each measure is kept: a histogram over values cut to their seven leading bits, so a quantile
is at most 1/64 below the true value. Sketches are counts per (group, measure, value); they merge by adding,
give the same result in any order, and a hot group costs one row per task and value. A limit begins
``LEAST`` of the measure over the group's median. The 75th and the 90th percentile move it, each to itself plus ``SPREAD`` times
its distance from the median (``LEAST`` at least), and the 99th to itself plus half of ``LEAST``, but only if they lie
inside the limit so far: junk that fills a quarter of a group, far from the rest, does not raise its own limit. The lower
limit of word lengths is made alike from the low percentiles.

Defined cases: null or blank text has no words and fails the fixed base rule; null language or source is a
group of its own; a group of one document keeps it (its percentiles are its own values); repeated rows get the same
verdict; further columns stay untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from stockcount.scale import cut

from llm.text import BLANKS, broadcast_if_few, grams, hashed, private, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
SPREAD = 5
#: Measure: the least distance of its limit from a percentile. All are in thousandths.
LEAST = {"symbols": 50, "marks": 50, "dup_lines": 250, "repeats": 100, "word_length": 1500}
MEASURES = list(LEAST)


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def counts(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_marks.

    Three-word windows are compared by a 64-bit hash inside a document. Only documents in which a window
    returns sort their windows with positions.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.withColumn("_h", hashed(words(F.col("text"))))
    base = base.withColumn("_g", grams("_h", 3))
    full_lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    base = base.withColumn("_lines", F.transform(full_lines, lambda x: F.xxhash64(x)))
    base = base.withColumn(
        "_s",
        F.when(
            F.size(F.array_distinct("_g")) < F.size("_g"),
            F.sort_array(F.transform("_g", lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
        ),
    )
    # Positions of windows equal to a neighbour in sorted order, then the words they cover.
    base = base.withColumn(
        "_p",
        F.sort_array(
            F.transform(
                F.filter(
                    "_s",
                    lambda e, k: F.coalesce(F.get("_s", k + 1)["x"] == e["x"], F.lit(False))
                    | F.coalesce(F.get("_s", k - 1)["x"] == e["x"], F.lit(False)),
                ),
                lambda e: e["i"],
            )
        ),
    )
    covered = F.aggregate(
        F.transform("_p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda acc, x: acc + x,
    )
    found = F.struct(
        F.size("_h").cast("long").alias("n_words"),
        F.length(_without(text, BLANKS)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        (F.length(text) - F.length(_without(text, "!"))).cast("long").alias("n_marks"),
        F.size("_lines").cast("long").alias("n_lines"),
    )
    # A generator of one row: later filters stay above it, so nothing here is worked out again for them.
    return base.select(*[F.col(c) for c in docs.columns], F.inline(F.array(found)))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measures() -> dict[str, Column]:
    """Integer measures in thousandths, per word or per line."""
    per_word = lambda c: F.expr(f"{c} * 1000 div greatest(n_words, 1)")
    return {
        "symbols": per_word("n_symbols"),
        "marks": per_word("n_marks"),
        "dup_lines": F.expr("n_dup_lines * 1000 div greatest(n_lines, 1)"),
        "repeats": per_word("n_repeat_words"),
        "word_length": per_word("word_chars"),
    }


def cut_value(value: str) -> Column:
    """The value with all but its seven leading bits set to 0."""
    shift = f"greatest(length(bin({value})) - 7, 0)"
    return F.expr(f"shiftleft(shiftright({value}, {shift}), {shift})")


def sketches(counted: DataFrame) -> DataFrame:
    """lang, source, measure, value, n: of documents that pass the base rule. Merge by summing n."""
    long = counted.where(~base_failed()).select(
        "lang",
        "source",
        F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("v")) for k, v in measures().items()])).alias("m"),
    )
    return (
        long.select("lang", "source", F.col("m.measure").alias("measure"), F.col("m.v").alias("v"))
        .select("lang", "source", "measure", cut_value("v").alias("value"))
        .groupBy("lang", "source", "measure", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def limits(sketch: DataFrame) -> DataFrame:
    """lang, source and for each measure its upper limit, for word_length also a lower one."""
    group = ["lang", "source", "measure"]
    so_far = F.sum("n").over(Window.partitionBy(*group).orderBy("value"))
    total = F.sum("n").over(Window.partitionBy(*group))
    ranked = sketch.withColumn("_upto", so_far).withColumn("_all", total)
    quantile = lambda k: F.min(F.when(100 * F.col("_upto") >= k * F.col("_all"), F.col("value")))
    q = ranked.groupBy(*group).agg(*[quantile(k).alias(f"q{k}") for k in (1, 10, 25, 50, 75, 90, 99)])
    least = F.create_map(*[F.lit(x) for k, v in LEAST.items() for x in (k, v)])[F.col("measure")]
    q = q.withColumn("_least", least).withColumn("high", F.col("q50") + F.col("_least")).withColumn("low", F.col("q50") - F.col("_least"))
    for up, down in (("q75", "q25"), ("q90", "q10")):
        far = lambda c: F.greatest(SPREAD * F.abs(F.col(c) - F.col("q50")), F.col("_least"))
        q = q.withColumn("high", F.when(F.col(up) <= F.col("high"), F.col(up) + far(up)).otherwise(F.col("high")))
        q = q.withColumn("low", F.when(F.col(down) >= F.col("low"), F.col(down) - far(down)).otherwise(F.col("low")))
    half = F.floor(F.col("_least") / 2)
    high = F.when(F.col("q99") <= F.col("high"), F.greatest("high", F.col("q99") + half)).otherwise(F.col("high"))
    low = F.when(F.col("q1") >= F.col("low"), F.least("low", F.col("q1") - half)).otherwise(F.col("low"))
    fenced = q.select(*group, high.alias("high"), low.alias("low"))
    at = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))
    return fenced.groupBy("lang", "source").agg(
        *[at(m, "high").alias(f"max_{m}") for m in MEASURES], at("word_length", "low").alias("min_word_length")
    )


def judged(counted: DataFrame, bounds: DataFrame) -> DataFrame:
    """``counted`` with base_failed and kept; bounds are broadcast if there are few groups."""
    b = broadcast_if_few(bounds.withColumnsRenamed({"lang": "_lang", "source": "_source"}))
    both = counted.join(b, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    inside = F.lit(True)
    for m, v in measures().items():
        inside = inside & (v <= F.col(f"max_{m}"))
    inside = inside & (measures()["word_length"] >= F.col("min_word_length"))
    return both.select(
        *[F.col(c) for c in counted.columns],
        base_failed().alias("base_failed"),
        (~base_failed() & F.coalesce(inside, F.lit(True))).alias("kept"),
    )


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed and kept, a row per row of ``docs``."""
    counted = cut(counts(private(docs, "doc_id", "text", "lang", "source")).drop("text"))
    return judged(counted, cut(limits(sketches(counted))))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass. Counts are taken twice instead of moving the texts."""
    slim = counts(private(docs, "text", "lang", "source")).drop("text")
    bounds = cut(limits(sketches(slim)))
    inner = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), "text", "lang", "source")
    return judged(counts(inner), bounds).where("kept").select("_row.*")
