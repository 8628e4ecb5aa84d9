"""N-gram Jaccard join: an exact metric-space join of shingle sets.

With the distance d = 1 - similarity, a metric, and the radius r of a link:

1. A text may lack only so many of its shingles in one that it links to. Sorted, truncated shingle
   hashes are counted in shards; a text that has more shingles of its own alone has no link.
   (Truncation can only keep more.) Equal sets collapse to one node each.
2. Pivots: two sets that link share one of their first shingles, rarest first, as many as they may lack of each other and one
   more. Of all nodes that have such a shingle among their first, the one of least hash is the pivot. So a node meets few pivots,
   with one row each, and two that link meet at one at least. All those distances are computed.
3. A node whose nearest pivot is within r is at home in that pivot's Voronoi region and links to it, as to all others within r; so
   homes of one region are one component and are never compared, however many they are. Nodes without a home choose pivots among themselves in further rounds.
4. Around every pivot q, nodes lie in rings of width r. If x and y link, |d(x, q) - d(y, q)| <= r, so each ring is a region that joins its
   own nodes and, as replicas, those of the ring inside it, the window of the triangle inequality. Rings of one component are dropped; rings too large for a task
   are dealt to pairs of parts.
5. Regions join recursively: nodes go to the Voronoi cell of the nearest of a few further pivots, and to further cells
   whose pivots are nearer than the home distance plus 2r; those far from all pivots form an outer cell. Cells that no longer shrink are
   compared in full, by size, where components differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, staged, table
from .components import components
from .shingles import pack, pack_sorted, pieces, shingle_hashes, unpack, unpack_sorted, word_hashes

WIDTH, PERCENT = 4, 85
#: Shingles of one packed block of texts, and of one counting shard.
BLOCK, SHARD = 600_000, 2_000_000
#: Bits of the filter of texts that are read again, a multiple of 32768: 4 MB on the driver and in each task, however many ids there are.
FILTER_BITS = 1 << 25
#: Rounds in which nodes without a home choose pivots.
ROUNDS = 2
#: Nodes and shingles of a region that one task joins.
REGION_ROWS, REGION_SHINGLES = 4000, 2_000_000
#: Pivots of a task's own recursion, and nodes that are compared without it.
PIVOTS, LEAF = 8, 48


def sets_of(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    flat, sizes = word_hashes(texts)
    h, of = shingle_hashes(flat, sizes, width)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return np.split(h, np.searchsorted(of, np.arange(1, len(texts))))


BLOCKS = "shard int, block long, ids binary, n binary, h binary, of binary"


def shares(docs: DataFrame, shards: int, bits: int, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, maybe): each text's number of distinct shingles, and whether other texts have enough of them too.

    Blocks of texts are dealt to shards; each shard answers a block with one row, the numbers of its
    texts that share shingles and how many, so rows between tasks don't grow with texts times shards.
    """

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        for pdf in batches:
            lengths = pdf["text"].map(lambda t: len(t) if t else 0).to_numpy() // 5
            for part in pieces(lengths, BLOCK):
                ids = pdf["doc_id"].iloc[part].to_numpy()
                sets = sets_of(list(pdf["text"].iloc[part]), width)
                n = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate(sets) >> np.uint64(64 - bits)
                order = np.argsort(flat, kind="stable")
                flat, of = flat[order], np.repeat(np.arange(len(sets)), n)[order]
                edges = np.searchsorted((flat.astype(np.float64) * (shards / 2.0**bits)).astype(np.int64), np.arange(shards))
                edges = np.append(edges, len(flat))
                first = {"ids": pack(ids.astype("<i8").view("<u8")), "n": pack(n)}
                yield pd.DataFrame([
                    {"shard": k, "block": number, **(first if k == 0 else dict.fromkeys(first, b"")), "h": pack_sorted(flat[a:b]), "of": pack(of[a:b])}
                    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a or k == 0
                ])
                number += 1

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([unpack_sorted(x) for x in pdf["h"]])
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        del order, same, h
        texts, shared, at = [], [], 0
        for packed_of in pdf["of"]:
            of = unpack(packed_of).astype(np.int64)
            some, k = np.unique(of[twice[at : at + len(of)]], return_counts=True)
            at += len(of)
            texts.append(pack_sorted(some.astype(np.uint64)))
            shared.append(pack(k))
        return pd.DataFrame({"block": pdf["block"], "ids": pdf["ids"], "n": pdf["n"], "texts": texts, "shared": shared})

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, n = (unpack(max(pdf[c], key=len)).view(np.int64) for c in ("ids", "n"))
        total = np.zeros(len(ids), np.int64)
        for texts, shared in zip(pdf["texts"], pdf["shared"], strict=True):
            total[unpack_sorted(texts).astype(np.int64)] += unpack(shared).astype(np.int64)
        return pd.DataFrame({"doc_id": ids, "n": n, "maybe": (n > 0) & (n - total <= most_missing(n, percent))})

    packed = docs.mapInPandas(blocks, BLOCKS)
    answers = packed.groupBy("shard").applyInPandas(count, "block long, ids binary, n binary, texts binary, shared binary")
    each = answers.groupBy("block").applyInPandas(gather, "doc_id long, n long, maybe boolean")
    return each.groupBy("doc_id").agg(F.max("n").alias("n"), F.bool_or("maybe").alias("maybe"))


def filter_bit(column: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)) + 1  # Spark's bitmaps count from 1


def id_filter(ids: DataFrame, column: str = "doc_id") -> np.ndarray:
    """A bitmap of the hashes of some ids, made in parts by Spark. It has all of them, and others by chance: 2 in a hundred with 600,000 ids, 9 with 3 million."""
    b = ids.select(filter_bit(column).alias("b")).groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
    out = np.zeros((FILTER_BITS // 32768, 4096), np.uint8)
    for r in b.collect():  # 1024 rows of 4 KB at most
        out[r["k"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def sets_table(docs: DataFrame, ids: DataFrame, digest_only: bool, width: int = WIDTH) -> DataFrame:
    """(doc_id, node) or (doc_id, node, n, set) of the texts of some ids, and of a few others that their filter lets through: a node is the 64-bit hash of a set.

    So texts are neither shuffled nor met by a table of ids that would lie whole on the driver.
    """
    held = docs.sparkSession.sparkContext.broadcast(id_filter(ids))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = held.value
        for pdf in batches:
            at = pdf["bit"].to_numpy() - 1
            pdf = pdf[(bits[at >> 3] >> (at & 7)) & 1 == 1]
            for i in range(0, len(pdf), 300):
                part = pdf.iloc[i : i + 300]
                raw = [s.tobytes() for s in sets_of(list(part["text"]), width)]
                out = pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "node": np.array([xxhash.xxh3_64_intdigest(r) for r in raw], np.uint64).view(np.int64)})
                yield out if digest_only else out.assign(n=[len(r) // 8 for r in raw], set=raw)

    return docs.withColumn("bit", filter_bit()).mapInPandas(run, "doc_id long, node long" + ", n long, set binary" * (not digest_only))


def among(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The sets of some nodes, and of a few others that their filter lets through: a join then shuffles what it needs, not all sets each time."""
    held = sets.sparkSession.sparkContext.broadcast(id_filter(nodes, "node"))

    def run(bit: pd.Series) -> pd.Series:
        at = bit.to_numpy() - 1
        return pd.Series((held.value[at >> 3] >> (at & 7)) & 1 == 1)

    return sets.where(F.pandas_udf(run, "boolean")(filter_bit("node")))


def met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that tasks merge, however small a side is on disk: one of a few megabytes there, many times as large in memory, would otherwise lie whole on the driver."""
    return left.join(right.hint("merge"), on, how)


def most_missing(n, percent: int):
    """How many of its n shingles a set may lack in one of at least that similarity; n is a number, array or column."""
    if isinstance(n, Column):
        return n - F.ceil(n * percent / 100)
    return n - (-(-n * percent // 100))


def first_keys(sets: DataFrame, percent: int) -> DataFrame:
    """(node, key): the first shingles of each set, rarest first, that it shares one of with every set that it links to.

    Shingles of one set alone come first of all; they are counted, not listed. A set whose first shingles are all of them has no link.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 1000):
                part = pdf.iloc[i : i + 1000]
                n = part["n"].to_numpy()
                yield pd.DataFrame({"node": np.repeat(part["node"].to_numpy(), n), "n": np.repeat(n, n), "key": np.frombuffer(b"".join(part["set"]), np.int64)})

    keys = sets.select("node", "n", "set").mapInPandas(run, "node long, n long, key long")
    common = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    listed = met(keys, common, "key").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("c", "key"))).alias("s"))
    left = (most_missing(F.col("n"), percent) + 1 - (F.col("n") - F.size("s"))).cast("int")
    return listed.withColumn("left", left).where("left > 0").select("node", F.explode(F.slice("s", 1, F.col("left"))).alias("x")).select("node", F.col("x.key").alias("key"))


def overlap(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int(np.count_nonzero(y[at] == x))


def distances(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, pivot, n, similarity, near) of pairs (node, pivot); near ones link. A pivot's own pair needs no set, and only sets of others and of their pivots are moved."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = np.array([overlap(a, b) for a, b in zip(pdf["set"], pdf["pivot_set"], strict=True)], np.int64)
            union = pdf["n"].to_numpy() + pdf["pivot_n"].to_numpy() - both
            yield pdf[["node", "pivot", "n"]].assign(similarity=both / union, near=100 * both >= percent * union)

    others, pivots = pairs.where("node <> pivot"), pairs.where("node = pivot")
    own = met(others, among(sets, others).select("node", "n", "set"), "node")
    of = among(sets, others.select(F.col("pivot").alias("node"))).select(F.col("node").alias("pivot"), F.col("n").alias("pivot_n"), F.col("set").alias("pivot_set"))
    both = met(own, of, "pivot").mapInPandas(run, "node long, pivot long, n long, similarity double, near boolean")
    return both.union(met(pivots, sets.select("node", "n"), "node").select("node", "pivot", "n", F.lit(1.0), F.lit(True)))


def pivoted(keys: DataFrame, sets: DataFrame, folder: str, percent: int) -> list[DataFrame]:
    """Distances of nodes, pivots themselves among them, to the pivots of their keys: of all nodes, then in rounds of those that no pivot is near of."""
    out = []
    for k in range(1 + ROUNDS):
        chosen = keys.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("node", F.lit(k)), "node")).alias("m")).where("c > 1").select("key", F.col("m.node").alias("pivot"))
        pairs = staged(met(keys, chosen, "key").select("node", "pivot").distinct(), folder, f"pairs{k}")
        found = staged(distances(pairs, sets, percent), folder, f"distances{k}")
        out.append(found)
        if k == ROUNDS:
            break
        covered = found.where("near AND node <> pivot").select(F.explode(F.array("node", "pivot")).alias("node")).distinct()
        keys = staged(met(keys, covered, "node", "left_anti"), folder, f"keys{k}")
        if not keys.limit(1).count():
            break
    return out


class Region:
    """Nodes that a task joins: their components, and their shingles as numbers below ``width``, end to end."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray], label: np.ndarray | None = None):
        self.ids = ids
        self.n = np.array([len(s) for s in sets], np.int64)
        self.universe, flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.flat, self.ends = flat.astype(np.int64), np.cumsum(self.n)
        self.label = np.arange(len(ids)) if label is None else label  # the least member of each member's component

    def shingles(self, i: int) -> np.ndarray:
        return self.flat[self.ends[i] - self.n[i] : self.ends[i]]

    def overlaps(self, i: int, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of one member with others, given the others' shingles end to end."""
        mark = np.zeros(len(self.universe), np.int64)
        mark[self.shingles(i)] = 1
        return np.add.reduceat(mark[flat], starts)

    def gathered(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([self.shingles(i) for i in rows]), np.cumsum(self.n[rows]) - self.n[rows]

    def link(self, i: int, rows: np.ndarray, overlap: np.ndarray, percent: int) -> None:
        near = rows[100 * overlap >= percent * (self.n[i] + self.n[rows] - overlap)]
        labels = np.unique(self.label[np.append(near, i)])
        if len(labels) > 1:
            self.label[np.isin(self.label, labels)] = labels[0]

    def join(self, rows: np.ndarray, percent: int, depth: int = 0) -> None:
        """Link all pairs of rows that reach the threshold."""
        if len(rows) < 2:
            return
        cells = [rows] if len(rows) <= LEAF or depth > 12 else self.cells(rows, percent, depth)
        if len(cells) > 1 and max(map(len, cells)) <= 0.8 * len(rows) and sum(map(len, cells)) <= 2.5 * len(rows):
            for cell in cells:
                self.join(cell, percent, depth + 1)
            return
        # in full, by size: a partner has at least percent of the larger's shingles
        rows = rows[np.argsort(self.n[rows], kind="stable")]
        flat, starts = self.gathered(rows)
        most = np.searchsorted(self.n[rows], self.n[rows] * 100 // percent, side="right")
        for k, i in enumerate(rows[:-1]):
            to = most[k]
            if to > k + 1 and (self.label[rows[k + 1 : to]] != self.label[i]).any():
                end = starts[to] if to < len(rows) else len(flat)
                self.link(i, rows[k + 1 : to], self.overlaps(i, flat[starts[k + 1] : end], starts[k + 1 : to] - starts[k + 1]), percent)

    def cells(self, rows: np.ndarray, percent: int, depth: int) -> list[np.ndarray]:
        """Voronoi cells of a few pivots with their windows, and the outer cell."""
        flat, starts = self.gathered(rows)
        order = (rows * 0x9E3779B1 + depth * 0x85EBCA6B) & 0xFFFFFFFF
        pivots = rows[np.argsort(order, kind="stable")[:PIVOTS]]
        d = np.empty((len(rows), len(pivots)))
        for k, p in enumerate(pivots):
            both = self.overlaps(p, flat, starts)
            d[:, k] = 1 - both / (self.n[p] + self.n[rows] - both)
        return [rows[c] for c in cell_masks(d, percent) if c.any()]


def cell_masks(d: np.ndarray, percent: int) -> list[np.ndarray]:
    """Which members go to each pivot's cell, and to the outer one, by their distances (members, pivots).

    With x at home at p and y at home at q, d(x, y) <= r gives d(x, q) <= d(y, q) + r <= d(y, p) + r <=
    d(x, p) + 2r; and if y is at distance 1 of all pivots, d(x, p) >= 1 - r.
    """
    r = 1 - percent / 100 + 1e-9
    home = d.min(axis=1)
    inner = home < 1
    return [*((inner[:, None] & (d <= home[:, None] + 2 * r)).T), home >= 1 - r]


def rings(found: DataFrame, label: DataFrame, radius: float, rows: int, shingles: int) -> DataFrame:
    """(region, node, label): the nodes of each ring around a pivot and those of the ring inside it, where components differ; large ones dealt to pairs of parts."""
    width = radius * (1 + 1e-6) + 1e-9  # a little over r, so that two that link never lie two rings apart
    named = met(found, label, "node", "left").select("node", "pivot", "n", F.coalesce("label", "node").alias("label"), F.floor((1 - F.col("similarity")) / width).alias("own"))
    both = F.array(F.struct(F.col("own").alias("ring"), F.lit(1).alias("home")), F.struct((F.col("own") + 1).alias("ring"), F.lit(0).alias("home")))
    there = named.withColumn("x", F.explode(both)).select("node", "pivot", "n", "label", "x.ring", "x.home")
    parts = F.when((F.col("c") > rows) | (F.col("t") > shingles), F.ceil(2 * F.greatest(F.col("c") / rows, F.col("t") / shingles))).otherwise(1).cast("int")
    counts = there.groupBy("pivot", "ring").agg(F.sum("home").alias("homes"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("c"), F.sum("n").alias("t"))
    alive = counts.where("homes > 0 AND lo <> hi").select("pivot", "ring", parts.alias("m"))
    dealt = met(there, alive, ["pivot", "ring"]).withColumn("i", F.pmod(F.xxhash64("node"), F.col("m"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    return dealt.select(F.xxhash64("pivot", "ring", F.least("i", "j"), F.greatest("i", "j")).alias("region"), "node", "label")


def join_regions(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between the components of regions (region, node, label, set), as a spanning forest of labels."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["label", "node"])
        label = pdf["label"].to_numpy()
        region = Region(label, [np.frombuffer(s, np.uint64) for s in pdf["set"]], np.searchsorted(label, label))
        before = region.label.copy()
        region.join(np.arange(len(pdf)), percent)
        held = np.flatnonzero(region.label != before)
        return pd.DataFrame({"a": label[region.label[held]], "b": label[held]}).drop_duplicates()

    return members.groupBy("region").applyInPandas(join, "a long, b long")


def jaccard_links(sets: DataFrame, more: DataFrame, folder: str, percent: int, rows: int, shingles: int) -> DataFrame:
    """(node, label): the component of every node that links, of the sets (node, n, set) and of the links ``more`` (a, b)."""
    keys = staged(first_keys(sets, percent), folder, "keys")
    found = pivoted(keys, sets, folder, percent)
    star = more
    for x in found:
        star = star.union(x.where("near").select(F.col("node").alias("a"), F.col("pivot").alias("b")))
    label = components(star, f"{folder}/stars").select(F.col("id").alias("node"), F.col("component").alias("label"))
    dealt = staged(rings(found[0], label, 1 - percent / 100, rows, shingles), folder, "regions")
    if not dealt.limit(1).count():
        return label
    links = join_regions(met(dealt, among(sets, dealt).select("node", "set"), "node"), percent)
    further = components(links, f"{folder}/further").withColumnRenamed("id", "label")
    # a component of one node has no label yet
    alone = met(further, label.select("label").distinct(), "label", "left_anti").select(F.col("label").alias("node"), F.col("component").alias("label"))
    return met(label, further, "label", "left").select("node", F.coalesce("component", "label").alias("label")).union(alone)


def least_ids(nodes: DataFrame, label: DataFrame, salts: int = 32) -> DataFrame:
    """(doc_id, component): the least id of each id's component. Copies of a set are dealt by salts, so that a large group isn't one task's."""
    salted = nodes.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    least = met(nodes.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")), label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    of = least.groupBy("label").agg(F.min("rep").alias("component"), F.sum("c").alias("members")).where("members > 1")
    dealt = met(least, of, "label").select("node", "component", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return met(salted, dealt, ["node", "salt"]).groupBy("doc_id").agg(F.min("component").alias("component"))


def jaccard_components(docs: DataFrame, folder: str, width: int = WIDTH, percent: int = PERCENT, rows: int = REGION_ROWS, shingles: int = REGION_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every distinct doc_id; links are exact up to equal 64-bit hashes.

    A null text has no shingles and no links. Rows that repeat an id are one document that links wherever one of its texts does
    and has as many shingles as the largest. Each row without an id is a document of its own: its row has no doc_id, the size of its
    set and the smallest id that it reaches, null if there is none. An empty table gives no rows. Other columns are not read. Work tables are staged in the folder.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chars, last, nameless = texts.agg(F.sum(F.length("text")), F.max("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    chars, last, known = chars or 0, last or 0, texts.where(F.col("doc_id").isNotNull())
    if nameless:
        # beyond all ids, so that a number that stands for none is never the smallest of a group that has one
        numbered = texts.where(F.col("doc_id").isNull()).select((F.lit(last + 1) + F.monotonically_increasing_id()).alias("doc_id"), "text")
        known = known.union(staged(numbered, folder, "nameless"))
    shards = max(1, -(-chars // (6 * SHARD)))
    bits = min(56, max(32, (chars // 6 + 1).bit_length() + 8))
    stats = staged(shares(known, shards, bits, width, percent), folder, "stats")

    nodes = staged(sets_table(known, stats.where("maybe").select("doc_id"), True, width).distinct(), folder, "nodes")
    reps = nodes.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    drawn = sets_table(known, reps.select("doc_id"), False, width).where("n > 0").dropDuplicates(["node"])
    # by the column that they are dealt by already: equal nodes have equal sets, of whichever text
    sets = staged(met(drawn, reps.select("node"), "node", "left_semi").select("node", "n", "set"), folder, "sets")
    several = nodes.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").drop("z")
    label = jaccard_links(sets, met(nodes, several, "doc_id").select("a", F.col("node").alias("b")).where("a <> b"), folder, percent, rows, shingles)

    whole = least_ids(nodes, staged(label, folder, "label"))
    out = met(stats, whole, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    if nameless:
        named = lambda c: F.when(F.col(c) <= last, F.col(c)).alias(c)
        out = out.select(named("doc_id"), "n_shingles", named("component_id"))
    return out


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at 85 percent of 4-word shingles."""
    return jaccard_components(table(spark, sf_dir, "documents"), shared_folder(spark))
