"""Embedding near-duplicates by NN-descent: a neighbour graph refined through neighbours of neighbours.

1. Equal vectors become one node (by SHA-256 of their numbers).
2. First lists: nodes are sorted by the signs of random projections, many times (at least `TABLES`,
   more the larger the table is), and each takes its nearest from the nodes around it. An entry below 2 t^2 - 1 is dropped: two nodes that both
   link to a third (cosine >= t) are never farther apart, so it cannot lead to a link.
3. Refinement: the neighbours of each node, in both directions, are compared with each other, and
   every list keeps its best, until hardly any list changes.
4. Saturated lists: where all entries are links, a list may be too short. It is enlarged by all that
   can be reached through neighbours of neighbours to the end, its component: components are cut
   into tiles by the angle to their first node, and tiles whose angles lie close enough are compared
   block by block. Links are counted there and never handed on as pairs. A link that full lists
   of two components both dropped joins them: components with such lists are compared with each
   other by the angles between their first nodes, and where these lie close enough tile by tile.
5. Audit: the links of sampled nodes are found by brute force. Nodes without a link may have lost
   their only one: for a sample of them it is measured whether a node at exactly the threshold
   would have been met. If either share is smaller than `RECALL`, more tables and another refinement follow, and an audit on
   another sample. After `ATTEMPTS` the job fails.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sievework.llm.common import slices
from sievework.llm.components import components
from sievework.llm.vectors import groups, matrix, unit, usable
from sievework.operators.ordering import positions_within
from sievework.session import freeze

THRESHOLD = 0.9
LIST = 8
TABLES = 12
SIGNS = 32
AROUND = 64
ROUNDS = 4
SETTLED = 0.01
TILE = 256
# First nodes of components that are sent to all tasks at once.
ANCHORS = 8192
AUDIT = 256
AUDIT_MOST = 4096
LINKS = 200
PROBES = 512
RECALL = 0.99
ATTEMPTS = 4

_EDGE = "a bigint, b bigint, c double"


def _batch(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names)


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of unit vectors; one pair gives one value wherever it stands, and whichever comes first."""
    return np.einsum("id,jd->ij", x, y)


def _top(ids: np.ndarray, x: np.ndarray, size: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest `size` others of each row among the rows, if not below the floor."""
    c = _cosines(x, x)
    np.fill_diagonal(c, -2.0)
    c[ids[:, None] == ids[None, :]] = -2.0
    if c.shape[1] > size:
        best = np.argpartition(-c, size - 1, axis=1)[:, :size]
    else:
        best = np.broadcast_to(np.arange(c.shape[1]), c.shape)
    value = np.take_along_axis(c, best, axis=1)
    rows, places = np.nonzero(value >= floor)
    return ids[rows], ids[best[rows, places]], value[rows, places]


def _codes(x: np.ndarray, seed: int, t: int) -> np.ndarray:
    """Signs of the projections of table t, as numbers."""
    turn = np.random.default_rng((seed, t)).normal(size=(x.shape[1], SIGNS))
    return (x @ turn > 0) @ (1 << np.arange(SIGNS, dtype=np.int64))


def tables_for(total: int, threshold: float) -> int:
    """Tables after which a lone pair at the threshold has met, but for 1 in 500, if signs cut the nodes evenly."""
    agree = 1 - math.acos(threshold) / math.pi
    met = agree ** math.log2(max(1.0, 2 * total / AROUND))
    return math.ceil(math.log(0.002) / math.log1p(-met)) if met < 0.99 else 1


def first_lists(nodes: DataFrame, tables: int, seed: int, floor: float, size: int = LIST, start: int = 0) -> DataFrame:
    """Rows (a, b, c) from nodes that lie together in some order of projection signs."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            codes = [_codes(x, seed, t).tolist() for t in range(start, start + tables)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(map(list, zip(*codes))), pa.list_(pa.int64()))], ["id", "v", "codes"])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 1):
            ids, x = group.column("id").to_numpy(), matrix(group.column("v").combine_chunks())
            for start in range(0, len(ids), AROUND // 2):
                end = min(start + AROUND, len(ids))
                if end - start > 1:
                    a, b, c = _top(ids[start:end], x[start:end], size, floor)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], ["a", "b", "c"])
                if end == len(ids):
                    break

    rows = nodes.select("id", "v").mapInArrow(coded, "id bigint, v array<double>, codes array<bigint>")
    listed = rows.select("id", "v", F.posexplode("codes").alias("t", "code"))
    # A block number in front keeps what one task holds small, whatever the table's size.
    placed = listed.repartitionByRange("t", "code").sortWithinPartitions("t", "code", "id")
    cut = placed.select(F.floor(F.monotonically_increasing_id() / 4096).alias("g"), "id", "v")
    return cut.mapInArrow(around, _EDGE)


def shorten(edges: DataFrame, size: int = LIST) -> DataFrame:
    """The best `size` of each list, both directions counted."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "c"))
    once = both.groupBy("a", "b").agg(F.max("c").alias("c"))
    order = Window.partitionBy("a").orderBy(F.desc("c"), "b")
    return once.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= size).drop("r")


def refine(lists: DataFrame, nodes: DataFrame, floor: float, size: int = LIST) -> DataFrame:
    """Compares the neighbours of every node, in both directions, with each other."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 1):
            ids, x = group.column("id").to_numpy(), matrix(group.column("v").combine_chunks())
            if len(ids) > 1:
                a, b, c = _top(ids, x, size, floor)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], ["a", "b", "c"])

    # Many lists may name one node: of those that name it, a node meets its best `size`.
    named = lists.select(F.col("b").alias("a"), F.col("a").alias("b"), "c")
    order = Window.partitionBy("a").orderBy(F.desc("c"), "b")
    named = named.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= size).drop("r")
    own = lists.select("a", F.col("a").alias("b"), F.lit(1.0).alias("c"))
    meet = lists.unionByName(named).unionByName(own).select(F.col("a").alias("g"), F.col("b").alias("id")).distinct()
    placed = meet.join(nodes.select("id", "v"), "id").repartition("g").sortWithinPartitions("g", "id")
    return shorten(lists.unionByName(placed.select("g", "id", "v").mapInArrow(joined, _EDGE)), size)


def _links_of_sample(nodes: DataFrame, sample: list, threshold: float) -> DataFrame:
    """All links of the sampled nodes, by brute force against every node."""
    ids, x = np.array([r["id"] for r in sample], np.int64), np.array([r["v"] for r in sample], np.float64)
    sent = nodes.sparkSession.sparkContext.broadcast((ids, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = sent.value
        for batch in batches:
            if batch.num_rows:
                others, c = batch.column(0).to_numpy(), _cosines(rows, matrix(batch.column(1)))
                i, j = np.nonzero((c >= threshold) & (own[:, None] != others[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(others[j]), pa.array(c[i, j])], ["a", "b", "c"])

    return nodes.select("id", "v").mapInArrow(run, _EDGE)


def _sample(nodes: DataFrame, total: int, seed: int, most: int) -> list:
    """About `most` nodes by a hash of seed and id: other seeds give samples that do not depend on each other."""
    parts = 1 << 30
    share = min(parts, most * parts // max(total, 1) + 1)
    return nodes.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(parts)) < share).select("id", "v").limit(2 * most).collect()


def audit(nodes: DataFrame, roots: DataFrame, threshold: float, seed: int) -> tuple[float, DataFrame]:
    """The share of the links of sampled nodes that lie within found components, and those that do not (a, b).

    The sample is drawn anew for each seed, and grows until it has `LINKS` links, `AUDIT_MOST` nodes or
    all nodes. Without any link the share is 1.
    """
    total, size = nodes.count(), AUDIT
    left, right = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    while True:
        sample = _sample(nodes, total, 1000 + seed, size)
        if not sample:
            return 1.0, nodes.sparkSession.createDataFrame([], "a bigint, b bigint")
        exact = freeze(_links_of_sample(nodes, sample, threshold).select("a", "b"))
        wanted = exact.count()
        if wanted >= LINKS or size >= min(total, AUDIT_MOST):
            break
        size *= 4
    met = F.coalesce(F.col("ra") == F.col("rb"), F.lit(False))
    lost = freeze(exact.join(left, "a", "left").join(right, "b", "left").filter(~met).select("a", "b"))
    return 1.0 - lost.count() / max(1, wanted), lost


def lone_pairs_met(nodes: DataFrame, roots: DataFrame, tables: list[tuple[int, int]], threshold: float, seed: int) -> float:
    """The share of sampled nodes without a link that would meet a node at the threshold in some table.

    The other node is made up, in a random direction. It is met if it would stand within half a
    window: the nodes whose codes lie from one to the other are counted, over the whole table.
    """
    lone = nodes.join(roots, nodes["id"] == roots["node"], "left_anti").select("id", "v")
    sample = _sample(lone, lone.count(), 2000 + seed, PROBES)
    if not sample or len(sample[0]["v"]) < 2:
        return 1.0
    x = np.array([r["v"] for r in sample], np.float64)
    aside = np.random.default_rng((2000, seed)).normal(size=x.shape)
    aside -= (aside * x).sum(axis=1, keepdims=True) * x
    other = threshold * x + math.sqrt(1 - threshold * threshold) * unit(aside)
    spans = [np.sort([_codes(x, *t), _codes(other, *t)], axis=0) for t in tables]
    sent = nodes.sparkSession.sparkContext.broadcast(spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(tables), len(x)), np.int64)
        for batch in batches:
            if batch.num_rows:
                rows = matrix(batch.column(0))
                for k, (low, high) in enumerate(sent.value):
                    codes = np.sort(_codes(rows, *tables[k]))
                    n[k] += np.searchsorted(codes, high, "right") - np.searchsorted(codes, low, "left")
        k, p = np.divmod(np.arange(n.size), len(x))
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(p), pa.array(n.ravel())], ["k", "p", "n"])

    between = nodes.select("v").mapInArrow(run, "k bigint, p bigint, n bigint").groupBy("k", "p").agg(F.sum("n").alias("n"))
    return between.filter(F.col("n") <= AROUND // 2).select("p").distinct().count() / len(x)


def graph(nodes: DataFrame, threshold: float = THRESHOLD, size: int = LIST, tables: int = TABLES) -> tuple[DataFrame, float]:
    """Component of each linked node (node, root), and the audited recall of links.

    There are at least `tables` tables at first, else as many as the number of nodes asks for, and
    twice as many more with each further attempt. Links that audits found to be lost take part in the result, never in what an audit measures.
    """
    floor = 2 * threshold * threshold - 1
    lists, known, recall, used = None, None, 0.0, []
    first = max(tables, tables_for(nodes.count(), threshold))
    for attempt in range(ATTEMPTS):
        # Few tables at a time, so that their copies of the vectors are not on disk all at once.
        for start in range(0, first << attempt, TABLES):
            several = min(TABLES, (first << attempt) - start)
            found = first_lists(nodes, several, attempt, floor, size, start)
            lists = freeze(shorten(found if lists is None else lists.unionByName(found), size))
            used += [(attempt, t) for t in range(start, start + several)]
        for _ in range(ROUNDS):
            better = freeze(refine(lists, nodes, floor, size))
            changed = better.join(lists, ["a", "b"], "left_anti").count()
            lists = better
            if changed <= SETTLED * max(1, lists.count()):
                break
        roots = joined_components(nodes, lists, threshold, size)
        recall, lost = audit(nodes, roots, threshold, attempt)
        known = lost if known is None else known.unionByName(lost)
        if recall >= RECALL:
            recall = min(recall, lone_pairs_met(nodes, roots, used, threshold, attempt))
        if recall >= RECALL:
            return (roots if known.isEmpty() else _with_links(roots, known)), recall
    raise RuntimeError(f"recall of links is {recall:.4f} after {ATTEMPTS} attempts, below {RECALL}")


def _tiles(nodes: DataFrame, roots: DataFrame, tile: int) -> tuple[DataFrame, DataFrame]:
    """Members of each component in tiles (root, i, id, v, n), by the angle to its root; (root, i, low, high) of each tile."""
    anchors = nodes.select(F.col("id").alias("root"), F.col("v").alias("w"))
    members = nodes.join(roots.withColumnRenamed("node", "id"), "id").join(anchors, "root")
    dot = F.aggregate(F.zip_with("v", "w", lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    angles = members.select("root", "id", "v", "n", F.acos(F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0))).alias("angle"))
    placed = positions_within(angles, ["root"], ["angle", "id"], "pos")
    tiled = freeze(placed.withColumn("i", F.floor(F.col("pos") / tile)))
    return tiled, freeze(tiled.groupBy("root", "i").agg(F.min("angle").alias("low"), F.max("angle").alias("high")))


def _close(anchors: DataFrame, slack: float, most: int = ANCHORS) -> DataFrame:
    """Rows (ra, rb, between) of roots whose angle is at most both radii and the slack, by comparing all."""
    parts = -(-anchors.count() // most)
    out = anchors.sparkSession.createDataFrame([], "ra bigint, rb bigint, between double")
    for part in range(parts):
        rows = anchors.filter(F.pmod(F.xxhash64("root"), F.lit(parts)) == part).collect()
        if not rows:
            continue
        ids, x, radius = np.array([r["root"] for r in rows], np.int64), np.array([r["v"] for r in rows]), np.array([r["radius"] for r in rows])
        sent = anchors.sparkSession.sparkContext.broadcast((ids, x, radius))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, rows, wide = sent.value
            for batch in slices(batches):
                others, more = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                between = np.arccos(np.clip(rows @ matrix(batch.column(1)).T, -1.0, 1.0))
                i, j = np.nonzero((between <= wide[:, None] + more[None, :] + slack) & (own[:, None] < others[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(others[j]), pa.array(between[i, j])], ["ra", "rb", "between"])

        out = out.unionByName(freeze(anchors.select("root", "v", "radius").mapInArrow(run, "ra bigint, rb bigint, between double")))
    return out


def across(nodes: DataFrame, lists: DataFrame, roots: DataFrame, threshold: float = THRESHOLD, size: int = LIST, tile: int = TILE) -> DataFrame:
    """Rows (a, b): a link for any two tiles of different components that hold one, where lists are full of links.

    A link that was seen is dropped only if the lists of both its nodes are full of closer ones.
    """
    full = lists.filter(F.col("c") >= threshold).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("k")).filter(F.col("k") >= size)
    wanted = freeze(roots.join(full.join(roots, "node").select("root").distinct(), "root").select("node", "root"))
    tiled, spans = _tiles(nodes, wanted, tile)
    slack = math.acos(threshold) + 1e-6
    radius = spans.groupBy("root").agg(F.max("high").alias("radius"))
    close = _close(freeze(nodes.select(F.col("id").alias("root"), "v").join(radius, "root")), slack)
    first = spans.select(F.col("root").alias("ra"), "i", F.col("low").alias("l1"), F.col("high").alias("h1"))
    second = spans.select(F.col("root").alias("rb"), F.col("i").alias("j"), F.col("low").alias("l2"), F.col("high").alias("h2"))
    between = F.col("between")
    reached = (between <= F.col("h1") + F.col("h2") + slack) & (F.col("l1") <= between + F.col("h2") + slack) & (F.col("l2") <= between + F.col("h1") + slack)
    near = freeze(close.join(first, "ra").join(second, "rb").filter(reached).select("ra", "i", "rb", "j"))

    def side(root: str, place: str, flag: int) -> DataFrame:
        rows = tiled.select(F.col("root").alias(root), F.col("i").alias(place), "id", "v")
        return rows.join(near, [root, place]).select("ra", "i", "rb", "j", F.lit(flag).alias("s"), "id", "v")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 4):
            left = group.column("s").to_numpy() == 0
            ids, x = group.column("id").to_numpy(), matrix(group.column("v").combine_chunks())
            i, j = np.nonzero(_cosines(x[left], x[~left]) >= threshold)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(ids[left][i[:1]]), pa.array(ids[~left][j[:1]])], ["a", "b"])

    sides = side("ra", "i", 0).unionByName(side("rb", "j", 1)).repartition("ra", "i", "rb", "j").sortWithinPartitions("ra", "i", "rb", "j")
    return sides.mapInArrow(compared, "a bigint, b bigint")


def _with_links(roots: DataFrame, more: DataFrame) -> DataFrame:
    """The components after more links (a, b); a node follows its root."""
    left, right = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    ends = more.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    moved = freeze(components(ends)).select(F.col("node").alias("root"), F.col("root").alias("to"))
    old = roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    new = moved.join(roots, moved["root"] == roots["node"], "left_anti").select(F.col("root").alias("node"), F.col("to").alias("root"))
    return freeze(old.unionByName(new))


def joined_components(nodes: DataFrame, lists: DataFrame, threshold: float = THRESHOLD, size: int = LIST) -> DataFrame:
    """Component of each linked node (node, root), by the links of the lists and those that full lists dropped."""
    links = lists.filter(F.col("c") >= threshold).select("a", "b")
    roots = freeze(components(links))
    more = freeze(across(nodes, lists, roots, threshold, size))
    if more.isEmpty():
        return roots
    return _with_links(roots, more)


def count_links(nodes: DataFrame, roots: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """Rows (id, n): rows behind the nodes that each node links to, among all nodes of its component."""
    reach = math.acos(threshold)
    tiled, spans = _tiles(nodes, roots, tile)
    other = spans.select(F.col("root").alias("r2"), F.col("i").alias("j"), F.col("low").alias("l2"), F.col("high").alias("h2"))
    slack = reach + 1e-9
    near = spans.join(other, F.col("root") == F.col("r2")).filter((F.col("l2") <= F.col("high") + slack) & (F.col("low") <= F.col("h2") + slack))
    near = freeze(near.select("root", "i", "j"))

    def side(name: str, flag: int) -> DataFrame:
        rows = tiled.select("root", F.col("i").alias(name), "id", "v", "n")
        return rows.join(near, ["root", name]).select("root", "i", "j", F.lit(flag).alias("s"), "id", "v", "n")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 3):
            s = group.column("s").to_numpy()
            ids, x, n = group.column("id").to_numpy(), matrix(group.column("v").combine_chunks()), group.column("n").to_numpy()
            left, right = s == 0, s == 1
            linked = (_cosines(x[left], x[right]) >= threshold) & (ids[left][:, None] != ids[right][None, :])
            yield pa.RecordBatch.from_arrays([pa.array(ids[left]), pa.array(linked @ n[right])], ["id", "n"])

    sides = side("i", 0).unionByName(side("j", 1)).repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return sides.mapInArrow(compared, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def near_duplicates(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, size: int = LIST, tables: int = TABLES,
) -> DataFrame:
    """Rows (key, n_links, component_id, kept), one per input row.

    Two rows link if the cosine of their vectors, in double precision, is at least `threshold`;
    n_links counts the rows linked directly, component_id is the smallest key reachable, kept says
    whether the row's key is that one. Vectors that are null, zero, of an odd length or hold null or
    non-finite parts, and rows with a null key, link with nothing and are components of their own.
    Equal vectors always link; repeated rows count as rows. No rows give no rows.
    """
    all_ids = df.select(df[key].cast("long").alias("id"))
    text = F.concat_ws(",", F.transform("v", lambda x: (x + F.lit(0.0)).cast("string")))
    rows = freeze(usable(df, key, vector).withColumn("digest", F.unhex(F.sha2(text, 256))))
    classes = rows.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.min("v").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    nodes = freeze(classes.withColumn("norm", norm).select("digest", "id", "n", F.transform("v", lambda x: x / F.col("norm")).alias("v")))
    roots, _ = graph(nodes, threshold, size, tables)
    counts = count_links(nodes, roots, threshold)
    named = nodes.select("digest", "id", "n").join(roots.withColumnRenamed("node", "id"), "id", "left").join(counts.withColumnRenamed("n", "linked"), "id", "left")
    per_class = named.select("digest", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    linked = rows.select("id", "digest").join(per_class, "digest").select("id", "n_links", "component_id")
    alone = _others(df, key, vector, rows)
    out = linked.unionByName(alone.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _others(df: DataFrame, key: str, vector: str, rows: DataFrame) -> DataFrame:
    """Ids of the rows that take no part, as often as they come."""
    every = df.groupBy(df[key].cast("long").alias("id")).agg(F.count("*").alias("all"))
    part = rows.groupBy(F.col("id").alias("own")).agg(F.count("*").alias("part"))
    left = every.join(part, every["id"] == part["own"], "left").withColumn("rest", F.col("all") - F.coalesce("part", F.lit(0)))
    return left.filter("rest > 0").select("id", F.explode(F.array_repeat(F.lit(0), F.col("rest").cast("int")))).select("id")
