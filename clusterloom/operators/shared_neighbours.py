"""Density peaks by shared nearest neighbours (F8, F9, D9) as joins: no matrix of all representatives.

Neighbour lists come from the index of pivots. Only rows that are in each other's lists have a similarity, so pairs are
at most rows times neighbours. The nearest denser row is sought like a neighbour: a row's own part and the densest row of
each cell give a first bound, then only blocks are asked that hold denser rows and that the triangle inequality can't
exclude at that bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.operators.graph import materialise
from clusterloom.operators.neighbours import PART, PivotIndex, asked_parts, distances, knn, packed_rows, pivot_index, steps


def similarities(near: DataFrame) -> DataFrame:
    """id, rho (its similarities added up), reach (its neighbours' distances added up) of lists (sample_id, neighbour, d)."""
    lists = materialise(near.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("neighbour", "d"))).alias("near"), F.sum("d").alias("reach")), "neighbour-lists")
    pair = near.filter("sample_id <> neighbour").select("sample_id", "neighbour")
    mutual = pair.join(pair.select(F.col("neighbour").alias("sample_id"), F.col("sample_id").alias("neighbour")), ["sample_id", "neighbour"]).filter("sample_id < neighbour")
    other = lists.select(F.col("sample_id").alias("neighbour"), F.col("near").alias("other"))
    both = mutual.join(lists.select("sample_id", "near"), "sample_id").join(other, "neighbour")
    common = both.withColumn("common", F.array_intersect(F.map_keys("near"), F.map_keys("other")))
    spread = F.aggregate("common", F.lit(0.0), lambda total, q: total + F.element_at("near", q) + F.element_at("other", q))
    shared = F.size("common").cast("double")
    similar = common.select("sample_id", "neighbour", spread.alias("spread"), shared.alias("shared")).filter("spread > 0").withColumn("similar", F.col("shared") * F.col("shared") / F.col("spread"))
    sides = similar.select(F.explode(F.array("sample_id", "neighbour")).alias("sample_id"), "similar")
    rho = sides.groupBy("sample_id").agg(F.sum("similar").alias("rho"))
    return lists.join(rho, "sample_id", "left").select(F.col("sample_id").alias("id"), F.coalesce("rho", F.lit(0.0)).alias("rho"), "reach")


def _denser(rho: np.ndarray, ids: np.ndarray, other_rho: np.ndarray, other_ids: np.ndarray) -> np.ndarray:
    return (other_rho[None, :] > rho[:, None]) | ((other_rho[None, :] == rho[:, None]) & (other_ids[None, :] < ids[:, None]))


def _unpacked(items: pa.StructArray) -> tuple:
    ids, x = packed_rows(items)
    return ids.to_numpy(zero_copy_only=False), x, items.field("rho").to_numpy(zero_copy_only=False), items.field("reach").to_numpy(zero_copy_only=False)


def _least_gap(mine: tuple, others: tuple) -> np.ndarray:
    """Of each row the least distance, times both reaches, to a denser one of the others; infinite without one."""
    (ids, x, rho, reach), (other_ids, y, other_rho, other_reach) = mine, others
    gap = distances(x, y, "euclidean") * (reach[:, None] + other_reach[None, :])
    return np.where(_denser(rho, ids, other_rho, other_ids), gap, np.inf).min(axis=1, initial=np.inf)


def denser_gaps(scored: DataFrame, part: int = PART) -> DataFrame:
    """id, rho, gap: to the denser row (greater rho, or equal rho and lesser id) of least distance times both reaches; infinite for the densest.

    ``scored``: id, features, rho, reach.
    """
    index = pivot_index(scored.select("id", "features"), "euclidean", part)
    kind = scored.schema["id"].dataType.simpleString()
    member = index.parts.select("block", "part", F.explode("rows.id").alias("id")).join(scored, "id")
    parts = materialise(member.groupBy("block", "part").agg(F.collect_list(F.struct("id", "features", "rho", "reach")).alias("rows")), "scored-parts")
    blocks = {r.block: r for r in member.groupBy("block").agg(F.max("rho").alias("rho"), F.min("reach").alias("reach")).collect()}
    most, reach = (np.array([blocks[b][c] for b in range(len(index.owner))]) for c in ("rho", "reach"))
    # The densest row of each pivot's cell; the number of pivots is bounded.
    cells = scored.sparkSession.createDataFrame([(i, int(o)) for i, o in enumerate(index.owner)], "block int, owner int")
    of_cell = member.join(F.broadcast(cells), "block")
    top = of_cell.groupBy("owner").agg(F.max_by(F.struct("id", "features", "rho", "reach"), F.struct("rho", -F.col("id"))).alias("top")).select("top.*").orderBy("id").collect()
    tops = (np.array([r.id for r in top]), np.array([r.features for r in top], dtype=float), np.array([r.rho for r in top]), np.array([r.reach for r in top]))
    told = scored.sparkSession.sparkContext.broadcast((index.pivots, index.owner, index.inner, index.outer, index.count, index.parts_of, most, reach, tops))

    def first(batches):
        pivots, owner, inner, outer, count, parts_of, most, least_reach, tops = told.value
        own = PivotIndex(None, pivots, owner, inner, outer, count, parts_of, "euclidean")
        for batch in batches:
            for block, part, rows in zip(batch.column("block").to_pylist(), batch.column("part").to_pylist(), batch.column("rows"), strict=True):
                items = rows.values
                ids, x, rho, far = everyone = _unpacked(items)
                for s in steps(len(x), max(len(x) + pivots.size, 4 * len(owner))):
                    mine = (ids[s], x[s], rho[s], far[s])
                    bound = np.minimum(_least_gap(mine, everyone), _least_gap(mine, tops))
                    both = far[s][:, None] + least_reach[None, :]
                    # Where both reaches are 0 any distance gives 0, so a block can't be excluded.
                    radius = np.where(both > 0, bound[:, None] / np.where(both > 0, both, 1.0), np.inf)
                    to_pivots = distances(x[s], pivots, "euclidean")
                    ask = (own.lower(to_pivots[:, owner], to_pivots.min(axis=1), np.arange(len(owner))) <= radius * (1 + 1e-9) + 1e-12) & (most[None, :] >= rho[s][:, None])
                    ask[:, block] &= parts_of[block] > 1
                    targets = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(ask.sum(axis=1))), pa.int32()), pa.array(np.nonzero(ask)[1], pa.int32()))
                    columns = [items.field(c)[s] for c in ("id", "features", "rho", "reach")] + [pa.array([block] * len(bound), pa.int32()), pa.array([part] * len(bound), pa.int32()), pa.array(bound), targets]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "features", "rho", "reach", "block", "part", "gap", "targets"])

    def more(batches):
        for batch in batches:
            for mine, others in zip(batch.column("asking"), batch.column("rows"), strict=True):
                a, b = _unpacked(mine.values), _unpacked(others.values)
                for s in steps(len(a[1]), len(b[1])):
                    yield pa.RecordBatch.from_arrays([mine.values.field("id")[s], mine.values.field("rho")[s], pa.array(_least_gap(tuple(v[s] for v in a), b))], names=["id", "rho", "gap"])

    begun = materialise(parts.mapInArrow(first, f"id {kind}, features array<double>, rho double, reach double, block int, part int, gap double, targets array<int>"), "first-gaps")
    asked = asked_parts(parts, begun, ("id", "features", "rho", "reach")).mapInArrow(more, f"id {kind}, rho double, gap double")
    return begun.select("id", "rho", "gap").unionByName(asked).groupBy("id", "rho").agg(F.min("gap").alias("gap"))


def snn_peaks(rows: DataFrame, k: int, neighbours: int, part: int = PART) -> np.ndarray:
    """The k rows of ``rows`` (id, features) with the largest rho times delta, ties by id.

    Rho is the sum of a row's similarities: shared neighbours squared by the distances to them, for rows in each other's lists.
    Delta is its gap to a denser row; the densest has the largest delta of all, or 1 if it is alone.
    """
    rows = materialise(rows.select("id", F.col("features").cast("array<double>").alias("features")), "representatives")
    near = materialise(knn(rows.withColumnRenamed("id", "sample_id"), neighbours, part=part).select("sample_id", "neighbour", "d"), "representative-neighbours")
    scored = materialise(rows.join(similarities(near), "id"), "representative-densities")
    gaps = materialise(denser_gaps(scored, part), "representative-gaps")
    finite = F.col("gap") < float("inf")
    largest = gaps.filter(finite).agg(F.max("gap")).first()[0]
    delta = F.when(finite, F.col("gap")).otherwise(F.lit(1.0 if largest is None else largest))
    best = gaps.select("id", (F.col("rho") * delta).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    chosen = best.join(rows, "id").orderBy(F.desc("score"), "id").collect()
    return np.array([r.features for r in chosen], dtype=float)
