"""Density clusters from a graph of cells (C4, U4): no table of pairs within the radius is made.

Cells have the radius as their diagonal, so rows of a cell are all near to each other. A cell with ``min_samples`` rows
makes all of them core at once. Rows of other cells, fewer than ``min_samples`` in each, are held against the rows around.
Cells with core rows are the nodes of a graph. Two neighbours are linked if a pair of core rows is near: first a bounded
number of rows, the outermost of each cell along each axis, is tested, up to the first hit; pairs of cells that this leaves
open, and that aren't connected by others, are tested in full, rows near to the other cell's box alone.

Cells lie in blocks. A row or cell is copied to a neighbour block only if it is near to it, so neighbours meet in a block
without a copy for each shift. A block holds a bounded number of cells, and so of rows that ask; what they ask is split by
hash. Links within a block are contracted there; the rounds over all nodes see those of cells that two blocks share.
Several radii are candidates in the keys of one pass: each has cells and nodes of its own.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.operators.graph import connected_components, materialise, told_by_size
from clusterloom.operators.neighbours import PART, distances, steps

#: Features that a cell may have, and by their number the bits of a cell's place within its block.
MAX_WIDTH = 3
BITS = {1: 10, 2: 5, 3: 3}
#: Parts that a group of rows may have the size of before it is split by hash or told by a broadcast.
PARTS = 4


def offsets(width: int, metric: str) -> list[list[int]]:
    """Shifts from a cell to all others that may hold rows within the radius."""
    reach = 1 if metric == "chebyshev" else math.ceil(math.sqrt(width))
    gaps = lambda shift: [max(0, abs(k) - 1) for k in shift]
    near = lambda shift: max(gaps(shift)) < 1 if metric == "chebyshev" else sum(g * g for g in gaps(shift)) <= width
    return [list(s) for s in itertools.product(range(-reach, reach + 1), repeat=width) if any(s) and near(s)]


def _side(eps: float, width: int, metric: str) -> float:
    """A little less than the radius, as the diagonal must not pass it by rounding."""
    return (eps * (1 - 1e-9) if eps > 0 else 1e-12) / (1.0 if metric == "chebyshev" else math.sqrt(width))


def _unpacked(lists: pa.ListArray) -> tuple[np.ndarray, pa.StructArray]:
    """Where each list begins, and the end of the last; all their items."""
    ends = lists.offsets.to_numpy()
    return ends - ends[0], lists.flatten()


def _matrix(items: pa.StructArray, names: list[str]) -> np.ndarray:
    return np.stack([items.field(n).to_numpy(zero_copy_only=False) for n in names], axis=-1)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each of ``n`` nodes the least that the edges a-b connect it with."""
    label = np.arange(n)
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low < high
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        while not (label == (further := label[label])).all():
            label = further


def _asked(asking: DataFrame, rows: DataFrame, keys: list[str], radii: list[float], metric: str, xs: list[str], kind: str, least: bool) -> DataFrame:
    """candidate, id and n, how many ``rows`` of its block are within the radius of an ``asking`` one (if any); ``least``: name, their least name."""

    def run(batches):
        for batch in batches:
            candidates = batch.column("candidate").to_numpy(zero_copy_only=False)
            (ends, mine), (bounds, others) = _unpacked(batch.column("asking")), _unpacked(batch.column("rows"))
            if not len(mine):
                continue
            x, y = _matrix(mine, xs), _matrix(others, xs)
            if least:
                order = pc.sort_indices(others.field("name")).to_numpy(zero_copy_only=False)
                rank = np.empty(len(order), dtype=np.int64)
                rank[order] = np.arange(len(order))
            found = np.zeros(len(x), dtype=np.int64)
            for i, c in enumerate(candidates):
                at, there = slice(ends[i], ends[i + 1]), slice(bounds[i], bounds[i + 1])
                for s in steps(at.stop - at.start, there.stop - there.start):
                    part = slice(at.start + s.start, min(at.start + s.stop, at.stop))
                    near = distances(x[part], y[there], metric) <= radii[c]
                    found[part] = np.where(near, rank[there], len(order)).min(axis=1, initial=len(order)) if least else near.sum(axis=1)
            some = np.flatnonzero(found < len(order) if least else found)
            told = others.field("name").take(pa.array(order[found[some]])) if least else pa.array(found[some])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(candidates, np.diff(ends))[some]), mine.field("id").take(pa.array(some)), told], names=["candidate", "id", "told"])

    both = asking.join(rows.hint("merge"), keys).select("candidate", "asking", "rows")
    told = both.mapInArrow(run, f"candidate int, id {kind}, told {kind if least else 'bigint'}").groupBy("candidate", "id")
    return told.agg(F.min("told").alias("name") if least else F.sum("told").alias("n"))


def _links(groups: DataFrame, width: int, reach: int, shifts: list[list[int]], radii: list[float], metric: str) -> DataFrame:
    """kind, node, other, shared: a block's own cells (kind 0) and those around it (1) with a node that stands for what they
    are linked with in the block, and pairs of cells (2) whose boxes are near, but neither their outermost rows nor links."""
    bits, radius = BITS[width], np.array(radii)
    half = [s for s in shifts if s > [0] * width]
    axes = range(width)

    def apart(gaps):
        return np.max(np.abs(gaps), axis=0) if metric == "chebyshev" else np.sqrt(sum(g * g for g in gaps))

    def run(batches):
        for batch in batches:
            ends, cells = _unpacked(batch.column("cells"))
            if not len(cells):
                continue
            value = lambda name: cells.field(name).to_numpy(zero_copy_only=False)
            group = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            eps = radius[batch.column("candidate").to_numpy(zero_copy_only=False)][group]
            span = (1 << bits) + 2 * reach
            places = [value(f"k{i}") - (batch.column(f"b{i}").to_numpy(zero_copy_only=False)[group] << bits) + reach for i in axes]
            code = group
            for p in places:
                code = code * span + p
            order = np.argsort(code, kind="stable")
            ordered, own, shared, node = code[order], value("own"), value("shared"), value("node")
            low, high = [value(f"low{i}") for i in axes], [value(f"high{i}") for i in axes]
            outermost = [[value(f"p{j}_{i}") for i in axes] for j in range(2 * width)]
            pairs = []
            for shift in half:
                step = 0
                inside = np.ones(len(code), dtype=bool)
                for s, p in zip(shift, places, strict=True):
                    step = step * span + s
                    inside &= (p + s >= 0) & (p + s < span)
                a = np.flatnonzero(inside)
                at = np.minimum(np.searchsorted(ordered, code[a] + step), len(ordered) - 1)
                met = ordered[at] == code[a] + step
                a, b = a[met], order[at[met]]
                met = own[a] | own[b]
                a, b = a[met], b[met]
                gaps = [np.maximum(np.maximum(low[i][b] - high[i][a], low[i][a] - high[i][b]), 0.0) for i in axes]
                met = apart(gaps) <= eps[a] * (1 + 1e-9)
                a, b = a[met], b[met]
                hit = np.zeros(len(a), dtype=bool)
                for p, q in itertools.product(outermost, outermost):
                    rest = np.flatnonzero(~hit)
                    hit[rest] = apart([p[i][a[rest]] - q[i][b[rest]] for i in axes]) <= eps[a[rest]]
                pairs.append((a, b, hit))
            a, b, hit = (np.concatenate(x) for x in zip(*pairs, strict=True))
            label = _roots(len(code), a[hit], b[hit])
            still = ~hit & (label[a] != label[b])
            kinds = [np.where(own, 0, 1), np.full(int(still.sum()), 2)]
            columns = [np.concatenate(c) for c in (kinds, [node, node[a[still]]], [node[label], node[b[still]]], [shared, np.zeros(len(kinds[1]), dtype=bool)])]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *map(pa.array, columns[1:])], names=["kind", "node", "other", "shared"])

    return groups.select(*[f"b{i}" for i in axes], "candidate", "cells").mapInArrow(run, "kind int, node bigint, other bigint, shared boolean")


def _late_links(late: DataFrame, core: DataFrame, nodes: DataFrame, cell: list[str], radii: list[float], metric: str, xs: list[str], part: int) -> DataFrame:
    """src, dst of the pairs (pair, node, other, src, dst) of cells of which a pair of core rows is near; all rows near to the other's box are tested."""
    axes = range(len(xs))
    eps = F.element_at(F.array(*[F.lit(float(r)) for r in radii]), F.col("candidate") + 1) * (1 + 1e-9)

    def facing(one, two, name):
        here = nodes.select(F.col("node").alias(one), *cell, "n")
        there = nodes.select(F.col("node").alias(two), *[f"{end}{i}" for i in axes for end in ("low", "high")])
        asked = late.join(here, one).join(there, two).drop("node", "other")
        rows = told_by_size(core.select(*cell, "id", *xs), asked, cell, PARTS * part)
        for i, x in enumerate(xs):
            rows = rows.filter((F.col(x) >= F.col(f"low{i}") - eps) & (F.col(x) <= F.col(f"high{i}") + eps))
        salt = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / part))
        return rows.groupBy("pair", "src", "dst", "candidate", salt.alias(f"{name}_part")).agg(F.collect_list(F.struct(*xs)).alias(name))

    def run(batches):
        for batch in batches:
            candidates = batch.column("candidate").to_numpy(zero_copy_only=False)
            (ends, mine), (bounds, others) = _unpacked(batch.column("asking")), _unpacked(batch.column("rows"))
            if not len(mine):
                continue
            x, y = _matrix(mine, xs), _matrix(others, xs)
            linked = []
            for i, c in enumerate(candidates):
                own, those = x[ends[i] : ends[i + 1]], y[bounds[i] : bounds[i + 1]]
                linked.append(any((distances(own[s], those, metric) <= radii[c]).any() for s in steps(len(own), len(those))))
            yield batch.select(["src", "dst"]).filter(pa.array(linked))

    others = facing("other", "node", "rows").select("pair", "rows")
    both = facing("node", "other", "asking").join(others.hint("merge"), "pair").select("candidate", "src", "dst", "asking", "rows")
    return both.mapInArrow(run, "src bigint, dst bigint").distinct()


def clusters_many(points: DataFrame, radii: list[float], min_samples: int, metric: str = "euclidean", part: int = PART) -> DataFrame:
    """candidate (a place in ``radii``), sample_id, component (its least core id) of all rows within the radius of a core row; a border row takes the least.

    Points must have no more than ``MAX_WIDTH`` features. No row, no result.
    """
    kind = points.schema["sample_id"].dataType.simpleString()
    width = points.select(F.max(F.size("features"))).first()[0] or 1
    if width > MAX_WIDTH:
        raise ValueError(f"cells of {width} features; {MAX_WIDTH} at most")
    radii, axes, limit = [float(r) for r in radii], range(width), PARTS * part
    shifts, bits = offsets(width, metric), BITS[width]
    reach = max(s[0] for s in shifts)
    xs, ks, bs = ([f"{letter}{i}" for i in axes] for letter in "xkb")
    cell, block = ["candidate", *ks], ["candidate", *bs]

    def home(k: str) -> Column:
        return F.shiftright(k, bits)

    def place(k: str) -> Column:
        return F.col(k).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))

    def spread(rows: DataFrame) -> DataFrame:
        """Rows in their own block and in each that has cells around theirs."""
        for k, b in zip(ks, bs, strict=True):
            near = F.array(home(k), F.when(place(k) < reach, home(k) - 1), F.when(place(k) >= (1 << bits) - reach, home(k) + 1))
            rows = rows.withColumn(b, F.explode(F.array_compact(near)))
        return rows

    told = F.array(*[F.struct(F.lit(c).alias("candidate"), F.lit(_side(r, width, metric)).alias("side")) for c, r in enumerate(radii)])
    rows = points.select(F.col("sample_id").alias("id"), *[F.get("features", F.lit(i)).cast("double").alias(x) for i, x in enumerate(xs)]).dropna(subset=xs)
    rows = rows.withColumn("told", F.explode(told)).select("told.candidate", "id", *xs, *[F.floor(F.col(x) / F.col("told.side")).alias(k) for x, k in zip(xs, ks, strict=True)])
    sizes = materialise(rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")), "cell-sizes")
    homes = [home(k).alias(b) for k, b in zip(ks, bs, strict=True)]
    crowded = sizes.select("candidate", *homes, "n").groupBy(*block).agg(F.sum("n").alias("all")).filter(F.col("all") > limit)
    rows = told_by_size(rows, sizes, cell, limit).select("*", *homes).join(F.broadcast(crowded), block, "left")
    salt = F.pmod(F.xxhash64("id"), F.coalesce(F.ceil(F.col("all") / limit), F.lit(1)))
    rows = materialise(rows.withColumn("salt", salt).drop("all"), "cell-rows")

    sparse = rows.filter(F.col("n") < min_samples)
    asking = spread(sparse).groupBy(*block).agg(F.collect_list(F.struct("id", *xs)).alias("asking"))
    parts = rows.groupBy(*block, "salt").agg(F.collect_list(F.struct(*xs)).alias("rows"))
    around = _asked(asking, parts, block, radii, metric, xs, kind, least=False).select("candidate", "id", (F.col("n") >= min_samples).alias("core"))
    judged = sparse.join(around.hint("merge"), ["candidate", "id"], "left").withColumn("core", F.coalesce("core", F.lit(False)))
    rows = materialise(rows.filter(F.col("n") >= min_samples).withColumn("core", F.lit(True)).unionByName(judged), "judged-rows")
    core = rows.filter("core")

    # The graph: a node is a cell with core rows, by any number of its own.
    outermost = [f(F.struct(*xs), x) for x in xs for f in (F.min_by, F.max_by)]
    ends = [f(x).alias(f"{end}{i}") for i, x in enumerate(xs) for f, end in ((F.min, "low"), (F.max, "high"))]
    nodes = core.groupBy(*cell).agg(F.min("id").alias("least"), F.max("n").alias("n"), *ends, *[o.alias(f"p{j}") for j, o in enumerate(outermost)])
    flat = [F.col(f"p{j}")[x].alias(f"p{j}_{i}") for j in range(2 * width) for i, x in enumerate(xs)]
    nodes = materialise(nodes.select("*", *flat, F.monotonically_increasing_id().alias("node")).drop(*[f"p{j}" for j in range(2 * width)]), "core-cells")
    shared, own = F.lit(False), F.lit(True)
    for k, b in zip(ks, bs, strict=True):
        shared, own = shared | (place(k) < reach) | (place(k) >= (1 << bits) - reach), own & (home(k) == F.col(b))
    told = F.struct("node", own.alias("own"), shared.alias("shared"), *ks, *[f"{end}{i}" for i in axes for end in ("low", "high")], *[f"p{j}_{i}" for j in range(2 * width) for i in axes])
    groups = spread(nodes).groupBy(*block).agg(F.collect_list(told).alias("cells"))
    links = materialise(_links(groups, width, reach, shifts, radii, metric), "block-links")
    found = connected_components(links.filter("kind < 2 and shared"), "node", "other").withColumnRenamed("node", "root")
    found = links.filter("kind = 0").select("node", F.col("other").alias("root")).join(found.hint("merge"), "root", "left")
    found = materialise(found.select("node", F.coalesce("component", "root").alias("component")), "cell-components")
    names = found.join(nodes.select("node", "least").hint("merge"), "node").groupBy("component").agg(F.min("least").alias("name"), F.count(F.lit(1)).alias("n"))
    still = links.filter("kind = 2").select("node", "other").distinct()
    if still.head(1):
        of = lambda name, alias: found.select(F.col("node").alias(name), F.col("component").alias(alias)).hint("merge")
        late = still.join(of("node", "src"), "node").join(of("other", "dst"), "other").filter("src <> dst").withColumn("pair", F.monotonically_increasing_id())
        late = materialise(late, "open-pairs")
        merged = connected_components(_late_links(late, core, nodes, cell, radii, metric, xs, part)).select(F.col("node").alias("component"), F.col("component").alias("whole"))
        names = materialise(names.join(merged.hint("merge"), "component", "left").withColumn("whole", F.coalesce("whole", "component")), "component-names")
        names = names.drop("name").join(names.groupBy("whole").agg(F.min("name").alias("name")).hint("merge"), "whole").drop("whole")
    names = materialise(names, "component-names")
    of_cell = told_by_size(found, names, ["component"], limit).select("node", "name").join(nodes.select("node", "n", *cell).hint("merge"), "node").drop("node")
    named = materialise(told_by_size(core.drop("n"), materialise(of_cell, "cell-names"), cell, limit).select(*block, "salt", "id", *xs, "name"), "core-rows")

    border = spread(rows.filter("not core")).groupBy(*block).agg(F.collect_list(F.struct("id", *xs)).alias("asking"))
    parts = named.groupBy(*block, "salt").agg(F.collect_list(F.struct(*xs, "name")).alias("rows"))
    touched = _asked(border, parts, block, radii, metric, xs, kind, least=True)
    return named.select("candidate", "id", "name").unionByName(touched).select("candidate", F.col("id").alias("sample_id"), F.col("name").alias("component"))


def clusters(points: DataFrame, eps: float, min_samples: int, metric: str = "euclidean", part: int = PART) -> DataFrame:
    """sample_id, component of :func:`clusters_many` for one radius."""
    return clusters_many(points, [eps], min_samples, metric, part).drop("candidate")
