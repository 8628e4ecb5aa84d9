"""Benchmark decontamination, in DataFrame functions only.

Windows of a text that have an item's length are fingerprinted by SimHash of their weighted word shingles.
Fingerprints of windows and items meet in a multi-index of bit blocks: two fingerprints within the
radius differ in few bits in one block at least, and items are entered under all values so near to their
blocks. Candidates within the radius are verified by the exact weighted similarity of their shingles.
Equal windows, however many texts hold them, are fingerprinted, looked up and verified once.

A window that reaches the threshold shares a shingle with its item, so only windows aligned at a
shared shingle are made; a run of shared shingles at one alignment makes one window. Texts are cut into
positions without carrying the text; only texts that have such a window are read again for it.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, UPPER, shared_folder, staged, table

WORDS, THRESHOLD = 5, 0.8
#: Fingerprints are two longs, cut into blocks of so many bits each.
BITS, BLOCK = 128, 16
#: An item is entered under all values of a block that differ in at most so many bits from its own.
NEAR = 3
#: Fingerprints that differ in more bits than NEAR in each block differ in more than this. At a similarity of
#: 0.8 they differ in 19 bits, deviating by 4: the radius lies three deviations above.
RADIUS = (NEAR + 1) * (BITS // BLOCK) - 1
#: Items' shingles, texts with windows, and verified pairs up to this many rows are broadcast; more are joined by a salted shuffle.
BROADCAST_ROWS, BROADCAST_TEXTS = 500_000, 200_000
#: Parts that the rows of one key are dealt to where a side is too large to broadcast.
SALTS = 16

#: Of an array of (h, g, w): each bit is set if the shingles whose hash h, or its second hash g, has it weigh more than the others.
FINGERPRINT = (
    "aggregate(sequence(0, 63), 0L, (f, b) -> IF(aggregate(hw, 0D, (a, y) -> a + IF(shiftright(y.{hash}, b) & 1L = 1L, y.w, -y.w)) > 0, f | shiftleft(1L, b), f))"
)


def word_hashes(text: str) -> str:
    """SQL of the array of hashes of a text's lower-cased words; null for a null text."""
    clean = f"translate({text}, '{UPPER}', '{UPPER.lower()}')"
    return f"transform(filter(split({clean}, '{SPACE.replace(chr(92), chr(92) * 2)}+'), x -> x <> ''), x -> xxhash64(x))"


def shingles(text: str, width: int) -> str:
    """SQL of the array of hashes of a text's shingles of ``width`` lower-cased words, in order; null if it has none."""
    parts = ", ".join(f"w[i + {k}]" for k in range(width))
    return f"transform(array({word_hashes(text)}), w -> IF(size(w) >= {width}, transform(sequence(0, size(w) - {width}), i -> xxhash64({parts})), null))[0]"


def blocks() -> Column:
    """The (block, bits) of a fingerprint (fp, fp2)."""
    each = 64 // BLOCK
    cut = [f"struct({k} AS block, shiftrightunsigned({('fp', 'fp2')[k // each]}, {k % each * BLOCK}) & {(1 << BLOCK) - 1}L AS bits)" for k in range(BITS // BLOCK)]
    return F.explode(F.expr(f"array({', '.join(cut)})"))


def neighbours(bits: Column) -> Column:
    """All values of a block that differ from its own in at most NEAR bits."""
    masks = [sum(1 << i for i in c) for k in range(NEAR + 1) for c in combinations(range(BLOCK), k)]
    return F.explode(F.transform(F.expr(f"array({', '.join(f'{m}L' for m in masks)})"), lambda m: bits.bitwiseXOR(m)))


def joined(left: DataFrame, right: DataFrame, keys: list[str], few: bool, how: str = "inner") -> DataFrame:
    """A join whose right side is broadcast if it has few rows; else the left rows of a key are dealt to parts and the right ones repeated in each."""
    if few:
        return left.join(F.broadcast(right), keys, how)
    salted = left.withColumn("salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int"))
    repeated = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(repeated, [*keys, "salt"], how).drop("salt")


def weights(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """Items (item, item_id, width, n, all), shingles (h, w), and the weight of a shingle that no item has.

    An item of fewer than WORDS words is one shingle of them all; one without words, or null, matches nothing. Rows that
    share an id, or have none, are items of their own. A shingle weighs ln(1 + items / items with it).
    """
    counted = benchmark.where(F.col("text").isNotNull()).select("item_id", "text", F.least(F.expr(f"size({word_hashes('text')})"), F.lit(WORDS)).alias("width")).where("width > 0")
    by_width = F.coalesce(*[F.when(F.col("width") == k, F.expr(shingles("text", k))) for k in range(1, WORDS + 1)])
    all_ = counted.select("item_id", "width", by_width.alias("all")).distinct()
    items = all_.select(F.xxhash64("item_id", "width", "all").alias("item"), "item_id", "width", F.size("all").alias("n"), "all")
    count = items.count()
    df = items.select("item", F.explode(F.array_distinct("all")).alias("h")).groupBy("h").agg(F.log(1 + F.lit(float(count)) / F.count("*")).alias("w"))
    return items, df, math.log(1 + count)


def weighted(arrays: DataFrame, keys: list[str], array: str, df: DataFrame, foreign: float, few: bool) -> DataFrame:
    """The keys with ``hw``, the distinct shingles of an array with a second hash and their weights, their ``total``, and their fingerprint ``fp``, ``fp2``."""
    own = joined(arrays.select(*keys, F.explode(F.array_distinct(array)).alias("h")), df, ["h"], few, "left")
    packed = own.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("h", F.xxhash64("h").alias("g"), F.coalesce("w", F.lit(foreign)).alias("w")))).alias("hw"))
    prints = [F.expr(FINGERPRINT.format(hash=h)).alias(name) for h, name in (("h", "fp"), ("g", "fp2"))]
    return packed.select("*", F.expr("aggregate(hw, 0D, (a, y) -> a + y.w)").alias("total"), *prints)


def alignments(docs: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """(row, start, n): windows of an item's number of shingles, where they are aligned with it at a shared shingle."""
    at = items.where(F.col("width") == width).select("n", "all", F.posexplode("all").alias("o", "h")).groupBy("h", "n", "all").agg(F.min("o").alias("o"))
    anchors = at.select("h", "n", "o", F.expr("IF(o = 0, null, all[o - 1])").alias("item_before")).distinct()
    texts = docs.select("row", F.expr(shingles("text", width)).alias("sh")).where("sh IS NOT NULL")
    pairs = F.expr("arrays_zip(sh, concat(array(CAST(null AS BIGINT)), slice(sh, 1, size(sh) - 1)))")
    each = texts.select("row", F.size("sh").alias("m"), F.posexplode(pairs).alias("p", "x")).select("row", "m", "p", F.col("x.sh").alias("h"), F.col("x.1").alias("before"))
    first = joined(each, anchors, ["h"], anchors.count() <= BROADCAST_ROWS).where("item_before IS NULL OR before IS NULL OR before <> item_before")  # the first shared shingle of its run
    return first.select("row", F.expr("greatest(least(p - o, m - n), 0)").alias("start"), "n").distinct()


def windows(docs: DataFrame, items: DataFrame, folder: str) -> DataFrame:
    """(row, doc_id, width, start, n, win, content): the shingles of all aligned windows and their hash. ``row`` is the hash of a row's id and text."""
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    out = rows.limit(0).select("row", "doc_id", F.lit(0).alias("width"), F.lit(0).alias("start"), F.lit(0).alias("n"), F.array(F.lit(0).cast("long")).alias("win"))
    for (width,) in items.select("width").distinct().orderBy("width").collect():  # at most WORDS widths; only items of few words have others than WORDS
        wanted = staged(alignments(rows, items, width).groupBy("row").agg(F.collect_set(F.struct("start", "n")).alias("at")), folder, f"alignments{width}")
        side = F.broadcast(wanted) if wanted.count() <= BROADCAST_TEXTS else wanted
        held = rows.join(side, "row").select("row", "doc_id", F.expr(shingles("text", width)).alias("sh"), "at").select("row", "doc_id", "sh", F.explode("at").alias("a"))
        out = out.union(held.select("row", "doc_id", F.lit(width).alias("width"), "a.start", "a.n", F.expr("slice(sh, a.start + 1, a.n)").alias("win")))
    return out.distinct().withColumn("content", F.xxhash64("width", "win"))


def meetings(prints: DataFrame, known: DataFrame) -> DataFrame:
    """(content, item, hamming): windows and items of equal width and size that meet in a block of the index. A pair that meets in several blocks comes several times.

    Windows' blocks are broadcast if they are few; else both sides are shuffled and merged. The planner doesn't see how many values
    an item is entered under, so it is never left to guess that side small enough.
    """
    left = prints.select("content", "width", "n", "fp", "fp2", blocks().alias("b")).select("content", "width", "n", "fp", "fp2", "b.*")
    entered = known.select("item", "width", "n", "fp", "fp2", blocks().alias("b")).select("item", "width", "n", F.col("fp").alias("item_fp"), F.col("fp2").alias("item_fp2"), "b.*")
    right = entered.withColumn("bits", neighbours(F.col("bits")))
    few = prints.count() * (BITS // BLOCK) <= BROADCAST_ROWS
    met = right.join(F.broadcast(left) if few else left.hint("merge"), ["width", "n", "block", "bits"])
    return met.select("content", "item", F.expr("bit_count(fp ^ item_fp) + bit_count(fp2 ^ item_fp2)").alias("hamming"))


def fingerprinted(docs: DataFrame, benchmark: DataFrame, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """Staged: all windows; their distinct contents and all items, each with shingles, weights and fingerprint; whether the items are few."""
    items, df, foreign = weights(benchmark)
    items, df = staged(items, folder, "items"), staged(df, folder, "weights")
    few = (items.agg(F.sum("n")).first()[0] or 0) <= BROADCAST_ROWS
    known = staged(items.join(weighted(items, ["item"], "all", df, foreign, few), "item"), folder, "known")
    found = staged(windows(docs, items, folder), folder, "windows")
    contents = found.select("content", "width", "n", "win").dropDuplicates(["content"])
    prints = staged(weighted(contents, ["content", "width", "n"], "win", df, foreign, few), folder, "prints")
    return found, prints, known, few


def contaminations(docs: DataFrame, benchmark: DataFrame, folder: str, threshold: float = THRESHOLD) -> DataFrame:
    """The items that texts contain: (doc_id, item_id, start_word, n_words, hamming, similarity), the best aligned window of each.

    Similarity is the weight of shared shingles over that of all; a shingle that no item has weighs like one
    of a single item. Null texts have no shingles; null ids are kept; repeated rows, equal items and items that
    share an id are matched each on its own, and equal result rows are returned once. Empty tables give no rows; other columns are not read.
    """
    found, prints, known, few = fingerprinted(docs, benchmark, folder)
    near = meetings(prints, known).where(F.col("hamming") <= RADIUS).distinct()
    both = joined(near.join(prints.select("content", "hw", F.col("total").alias("win_total")), "content"), known.select("item", "item_id", "all", "total"), ["item"], few)
    shared = F.expr("aggregate(filter(hw, y -> array_contains(all, y.h)), 0D, (a, y) -> a + y.w)")
    scored = both.withColumn("shared", shared).select("content", "item", "item_id", "hamming", (F.col("shared") / (F.col("total") + F.col("win_total") - F.col("shared"))).alias("similarity"))
    verified = staged(scored.where(F.col("similarity") >= threshold), folder, "verified")
    held = joined(found.select("row", "doc_id", "width", "start", "n", "content"), verified, ["content"], verified.count() <= BROADCAST_ROWS)
    best = held.groupBy("row", "doc_id", "item", "item_id").agg(F.min(F.struct(-F.col("similarity"), "start", "n", "width", "hamming")).alias("b"))
    return best.select(
        "doc_id", "item_id", F.col("b.start").alias("start_word"), (F.col("b.n") + F.col("b.width") - 1).alias("n_words"), F.col("b.hamming").alias("hamming"), (-F.col("b.col1")).alias("similarity"),
    ).distinct()


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents."""
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shared_folder(spark))
