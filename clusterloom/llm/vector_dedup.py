"""Operator 6: near-duplicate embeddings by neighbour descent.

A neighbour graph (``neighbours`` best known ones of each vector) starts from vectors that stand close in several random
sign orders, and is refined by joining neighbours of neighbours until little changes. Edges at or above the threshold
form components. Lists in which all neighbours are over the threshold are saturated: they may lack links, inside their
component and to other saturated ones. Components with such lists are compared with each other in blocks, by middles and
radii first, and merged where any link is found; links inside a component are then counted in blocks too, so they are
exact and never become rows. A component so tight that any two members must link needs no comparison. An audit compares
all vectors whose id is divisible by 20 with all rows, link by link; below the wanted recall the search goes on with more
orders, and after the last attempt all components and single vectors are compared in blocks, so that no link is lost.

Equal vectors are searched once. Cosines are in double precision.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clusterloom.llm.common import written
from clusterloom.operators.graph import connected_components


#: A vector with more than this many copies, and more than one in this many of all rows, is common.
COMMON = 1000


@dataclass(frozen=True)
class Descent:
    threshold: float = 0.9
    neighbours: int = 8
    orders: int = 6
    reach: int = 6
    rounds: int = 3
    #: The descent ends when the summed similarity grows by less than this share.
    gain: float = 0.002
    group: int = 16
    block: int = 128
    #: Middles of blocks that one row holds, and parts into which the rows' pairs are dealt on each side.
    pack: int = 256
    parts: int = 32
    #: Places in which the rows of a component meet what is known of it.
    places: int = 16
    #: Vectors with an id divisible by this are the audit's queries.
    audit_every: int = 20
    wanted_recall: float = 0.98
    attempts: int = 3
    seed: int = 5


def unit_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (unit vector, bytes of doubles) of the rows that can link; of repeated ids the least vector stands."""

    def run(batches):
        for batch in batches:
            ids, out = [], []
            for i, values in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                if i is None or not values or None in values:
                    continue
                x = np.array(values, dtype=np.float64)
                if not np.isfinite(x).all():
                    continue
                top = np.abs(x).max()
                if top > 0:
                    x = x / top
                    ids.append(i)
                    out.append((x / math.sqrt(float(x @ x))).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "v"])

    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").mapInArrow(run, "vec_id bigint, v binary")
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=np.float64).reshape(len(rows), -1)


def first_edges(vectors: DataFrame, orders: range, how: Descent) -> DataFrame:
    """u, v, sim of vectors within ``reach`` places of each other in a random sign order."""

    def code(batches):
        for batch in batches:
            sizes = np.array([len(x) // 8 for x in batch.column("v").to_pylist()], dtype=np.int64)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                part = batch.take(pa.array(rows))
                x = _matrix(part.column("v"))
                for order in orders:
                    planes = np.random.default_rng([how.seed, order, int(size)]).standard_normal((int(size), 40))
                    codes = (x @ planes > 0) @ (np.int64(1) << np.arange(40, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), order * 100_000 + size)), pa.array(codes), part.column("id"), part.column("v")], names=["place", "code", "id", "v"])

    def near(batches):
        last: list[tuple[int, int, np.ndarray]] = []
        for batch in batches:
            us, vs, sims = [], [], []
            for place, i, raw in zip(batch.column("place").to_pylist(), batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                x = np.frombuffer(raw, dtype=np.float64)
                if last and last[-1][0] != place:
                    last = []
                if last:
                    us += [i] * len(last)
                    vs += [j for _, j, _ in last]
                    sims += (np.stack([y for _, _, y in last]) @ x).tolist()
                last = [*last[-how.reach + 1 :], (place, i, x)]
            yield pa.RecordBatch.from_arrays([pa.array(us + vs, pa.int64()), pa.array(vs + us, pa.int64()), pa.array(sims + sims, pa.float64())], names=["u", "v", "sim"])

    coded = vectors.mapInArrow(code, "place bigint, code bigint, id bigint, v binary")
    return coded.repartitionByRange("place", "code", "id").sortWithinPartitions("place", "code", "id").mapInArrow(near, "u bigint, v bigint, sim double")


def _best(edges: DataFrame, how: Descent) -> DataFrame:
    """The best ``neighbours`` edges of each vector."""
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return edges.groupBy("u", "v").agg(F.max("sim").alias("sim")).withColumn("place", place).filter(F.col("place") <= how.neighbours).drop("place")


def descend(graph: DataFrame, vectors: DataFrame, turn: int, how: Descent) -> DataFrame:
    """One round: all pairs among what each vector has as a neighbour, or is one of, in groups of bounded size."""
    worst = graph.groupBy("u").agg(F.when(F.count(F.lit(1)) >= how.neighbours, F.min("sim")).otherwise(F.lit(-2.0)).alias("worst"))
    around = graph.select(F.col("u").alias("pivot"), F.col("v").alias("id")).union(graph.select(F.col("v").alias("pivot"), F.col("u").alias("id"))).distinct()
    degree = around.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / how.group).alias("groups"))
    grouped = around.join(degree, "pivot").withColumn("part", F.pmod(F.xxhash64("id", F.lit(turn)), F.col("groups")))
    known = vectors.join(worst.withColumnRenamed("u", "id"), "id")
    lists = grouped.join(known, "id").groupBy("pivot", "part").agg(F.collect_list(F.struct("id", "worst", "v")).alias("members"))

    def pairs(batches):
        for batch in batches:
            us, vs, sims = [], [], []
            for members in batch.column("members").to_pylist():
                ids = np.array([m["id"] for m in members])
                least = np.array([m["worst"] for m in members])
                x = np.frombuffer(b"".join([m["v"] for m in members]), dtype=np.float64).reshape(len(ids), -1)
                s = x @ x.T
                a, b = np.nonzero((s > least[:, None]) & (ids[:, None] != ids[None, :]))
                us.append(ids[a])
                vs.append(ids[b])
                sims.append(s[a, b])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us), pa.int64()), pa.array(np.concatenate(vs), pa.int64()), pa.array(np.concatenate(sims), pa.float64())], names=["u", "v", "sim"])

    found = lists.select("members").mapInArrow(pairs, "u bigint, v bigint, sim double")
    return _best(graph.union(found), how)


def _beside(rows: DataFrame, facts: DataFrame, number: str, how: Descent) -> DataFrame:
    """``rows`` with what ``facts`` (one small row a component) says of their component; a component's rows meet it in many places, dealt by ``number``."""
    copied = facts.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(how.places - 1))))
    return rows.withColumn("place", F.pmod(F.xxhash64(number), F.lit(how.places)).cast("int")).join(copied, ["component", "place"]).drop("place")


def saturated(graph: DataFrame, components: DataFrame, vectors: DataFrame, how: Descent) -> DataFrame:
    """component, id, v of the components in which some list is full of neighbours over the threshold."""
    full = graph.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("worst")).filter((F.col("n") >= how.neighbours) & (F.col("worst") >= how.threshold))
    named = components.select(F.col("node").alias("id"), "component")
    wanted = named.join(full.select(F.col("u").alias("id")), "id", "left_semi").select("component").distinct()
    return vectors.join(_beside(named, wanted, "id", how), "id").select("component", "id", "v")


def _dealt(left: DataFrame, right: DataFrame, key: str, parts: int) -> DataFrame:
    """mine, others of every row of ``left`` (``key``, number, mine) with every row of ``right`` (``key``, number, others).

    The rows of a key are dealt to ``parts`` by ``parts`` places, so that no place has all of them, whatever the key.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    a = left.select(key, "mine", F.pmod("number", F.lit(parts)).cast("int").alias("a"), every.alias("b"))
    b = right.select(key, "others", F.pmod("number", F.lit(parts)).cast("int").alias("b"), every.alias("a"))
    return a.join(b, [key, "a", "b"]).select("mine", "others")


def bridges(members: DataFrame, how: Descent) -> DataFrame:
    """u, v: a link of every two blocks of different components (component, id, v) that have one, so no two linked components stay apart.

    Blocks are compared where their middles are as close as their radii allow. Middles meet in packs: pairs that are too
    far apart never become rows.
    """
    limit = math.acos(how.threshold)
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / how.block).alias("blocks"))
    placed = _beside(members, sizes, "id", how).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    blocks = written(placed.groupBy("component", "block").agg(F.collect_list(F.struct("id", "v")).alias("rows")), "vector-blocks")

    def middle(batches):
        for batch in batches:
            size, middles, angles = [], [], []
            for rows in batch.column("rows").to_pylist():
                x = np.frombuffer(b"".join([r["v"] for r in rows]), dtype=np.float64).reshape(len(rows), -1)
                c = x.sum(axis=0)
                c = c / np.linalg.norm(c) if np.linalg.norm(c) > 1e-9 else x[0]
                size.append(x.shape[1])
                middles.append(c.tobytes())
                angles.append(float(np.arccos(np.clip(x @ c, -1, 1)).max()))
            arrays = [batch.column("component"), batch.column("block"), pa.array(size, pa.int64()), pa.array(middles, pa.binary()), pa.array(angles, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["component", "block", "size", "middle", "angle"])

    middles = written(blocks.mapInArrow(middle, "component bigint, block bigint, size bigint, middle binary, angle double"), "vector-middles")
    packs = max(1, math.ceil(middles.count() / how.pack))
    parts = min(packs, how.parts)
    packed = middles.withColumn("pack", F.pmod(F.xxhash64("component", "block"), F.lit(packs))).groupBy("size", "pack").agg(F.collect_list(F.struct("component", "block", "middle", "angle")).alias("mine"))
    packed = packed.withColumnRenamed("pack", "number")

    def close(batches):
        for batch in batches:
            out = []
            for mine, other in zip(batch.column("mine").to_pylist(), batch.column("others").to_pylist(), strict=True):
                x, y = (np.frombuffer(b"".join([m["middle"] for m in side]), dtype=np.float64).reshape(len(side), -1) for side in (mine, other))
                wide = np.array([m["angle"] for m in mine])[:, None] + np.array([m["angle"] for m in other])[None, :]
                apart = np.array([m["component"] for m in mine])[:, None] != np.array([m["component"] for m in other])[None, :]
                for i, j in zip(*np.nonzero(apart & (np.arccos(np.clip(x @ y.T, -1, 1)) <= wide + limit + 1e-6)), strict=True):
                    out.append(tuple(m[k] for m in sorted((mine[i], other[j]), key=lambda m: m["component"]) for k in ("component", "block")))
            columns = [*zip(*set(out))] or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["c1", "b1", "c2", "b2"])

    def compare(batches):
        for batch in batches:
            us, vs = [], []
            for mine, other in zip(batch.column("rows").to_pylist(), batch.column("others").to_pylist(), strict=True):
                x, y = (np.frombuffer(b"".join([r["v"] for r in side]), dtype=np.float64).reshape(len(side), -1) for side in (mine, other))
                s = x @ y.T
                i, j = np.unravel_index(s.argmax(), s.shape)
                if s[i, j] >= how.threshold:
                    us.append(mine[i]["id"])
                    vs.append(other[j]["id"])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    met = _dealt(packed, packed.withColumnRenamed("mine", "others"), "size", parts)
    pairs = met.mapInArrow(close, "c1 bigint, b1 bigint, c2 bigint, b2 bigint").distinct()
    first = blocks.select(F.col("component").alias("c1"), F.col("block").alias("b1"), "rows")
    second = blocks.select(F.col("component").alias("c2"), F.col("block").alias("b2"), F.col("rows").alias("others"))
    return pairs.join(first, ["c1", "b1"]).join(second, ["c2", "b2"]).select("rows", "others").mapInArrow(compare, "u bigint, v bigint")


def link_counts(members: DataFrame, how: Descent) -> DataFrame:
    """id, n_links of members (component, id, v, copies): exact inside each component, in blocks."""
    limit = math.acos(how.threshold)
    sizes = members.groupBy("component").agg(F.sum("copies").alias("total"), F.ceil(F.count(F.lit(1)) / how.block).alias("blocks"))
    placed = _beside(members, sizes, "id", how).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    blocks = placed.groupBy("component", "total", "block").agg(F.collect_list(F.struct("id", "copies", "v")).alias("rows"))

    def middle(batches):
        for batch in batches:
            sums = [np.frombuffer(b"".join([r["v"] for r in rows]), dtype=np.float64).reshape(len(rows), -1).sum(axis=0).tolist() for rows in batch.column("rows").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("component"), pa.array(sums, pa.list_(pa.float64()))], names=["component", "sums"])

    blocks = written(blocks, "vector-blocks")
    parts = blocks.select("component", "rows").mapInArrow(middle, "component bigint, sums array<double>").select("component", F.posexplode("sums").alias("axis", "x"))
    centres = parts.groupBy("component", "axis").agg(F.sum("x").alias("x")).groupBy("component").agg(F.array_sort(F.collect_list(F.struct("axis", "x"))).alias("centre"))

    def width(batches):
        for batch in batches:
            widest = []
            for rows, centre in zip(batch.column("rows").to_pylist(), batch.column("centre").to_pylist(), strict=True):
                x = np.frombuffer(b"".join([r["v"] for r in rows]), dtype=np.float64).reshape(len(rows), -1)
                c = np.array([p["x"] for p in centre])
                size = np.linalg.norm(c)
                widest.append(float(np.arccos(np.clip(x @ c / size, -1, 1)).max()) if size > 0 else math.pi)
            yield pa.RecordBatch.from_arrays([batch.column("component"), pa.array(widest, pa.float64())], names=["component", "angle"])

    angles = _beside(blocks, centres, "block", how).select("component", "rows", "centre").mapInArrow(width, "component bigint, angle double").groupBy("component").agg(F.max("angle").alias("angle"))
    split = _beside(blocks, angles, "block", how)
    tight = F.col("angle") * 2 <= limit - 1e-6
    simple = split.filter(tight).select(F.explode("rows").alias("r"), "total").select("r.id", (F.col("total") - 1).alias("n_links"))

    def count(batches):
        for batch in batches:
            ids, links = [], []
            for mine, other in zip(batch.column("mine").to_pylist(), batch.column("others").to_pylist(), strict=True):
                x = np.frombuffer(b"".join([r["v"] for r in mine]), dtype=np.float64).reshape(len(mine), -1)
                y = np.frombuffer(b"".join([r["v"] for r in other]), dtype=np.float64).reshape(len(other), -1)
                own, its = np.array([r["id"] for r in mine]), np.array([r["id"] for r in other])
                near = (x @ y.T >= how.threshold) | (own[:, None] == its[None, :])
                ids.append(own)
                links.append(near @ np.array([r["copies"] for r in other], dtype=np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids), pa.int64()), pa.array(np.concatenate(links), pa.int64())], names=["id", "n"])

    # The blocks of a component meet in places of their own: a large component is dealt to many.
    loose = split.filter(~tight).select("component", F.col("block").alias("number"), "rows")
    places = min(how.parts, max(1, math.isqrt(loose.groupBy("component").count().agg(F.max("count")).first()[0] or 1)))
    crossed = _dealt(loose.withColumnRenamed("rows", "mine"), loose.withColumnRenamed("rows", "others"), "component", places)
    exact = crossed.mapInArrow(count, "id bigint, n bigint").groupBy("id").agg((F.sum("n") - 1).alias("n_links"))
    return simple.unionByName(exact)


def audit(vectors: DataFrame, components: DataFrame, how: Descent) -> float:
    """Recall, link by link: every vector that ``asked`` marks is compared with all rows, in packs that meet each other; a
    link is found where both ends are in one component."""
    named = vectors.join(components.withColumnRenamed("node", "id"), "id", "left").select("asked", "id", F.coalesce("component", "id").alias("component"), "v", F.length("v").alias("size"))

    def packs(rows: DataFrame, name: str) -> DataFrame:
        n = max(1, math.ceil(rows.count() / how.pack))
        member = F.struct("id", "component", "v")
        return rows.withColumn("number", F.pmod(F.xxhash64("id", F.lit(how.seed)), F.lit(n))).groupBy("size", "number").agg(F.collect_list(member).alias(name))

    def run(batches):
        for batch in batches:
            links = found = 0
            for mine, others in zip(batch.column("mine").to_pylist(), batch.column("others").to_pylist(), strict=True):
                x, y = (np.frombuffer(b"".join([r["v"] for r in side]), dtype=np.float64).reshape(len(side), -1) for side in (mine, others))
                ids, own = (np.array([r["id"] for r in side]) for side in (mine, others))
                near = (x @ y.T >= how.threshold) & (ids[:, None] != own[None, :])
                one = np.array([r["component"] for r in mine])[:, None] == np.array([r["component"] for r in others])[None, :]
                links += int(near.sum())
                found += int((near & one).sum())
            yield pa.RecordBatch.from_arrays([pa.array([links], pa.int64()), pa.array([found], pa.int64())], names=["links", "found"])

    named = written(named, "vector-audit")
    met = _dealt(packs(named.filter("asked"), "mine"), packs(named, "others"), "size", how.parts)
    total, found = met.mapInArrow(run, "links bigint, found bigint").agg(F.sum("links"), F.sum("found")).first()
    return found / total if total else 1.0


def near_duplicate_vectors(embeddings: DataFrame, how: Descent = Descent()) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and so do vectors of
    different lengths with each other. Rows that repeat an id are one vector and each get their row; a null id links with
    nothing and stays, its component null. An empty table gives no rows.
    """
    units = unit_vectors(embeddings)
    units = written(units, "unit-vectors")
    asked = F.max(F.col("vec_id") % how.audit_every == 0).alias("asked")
    same = written(units.groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), asked), "vectors")
    vectors = same.select("id", "v")
    graph, edges, found = None, None, None
    for attempt in range(how.attempts):
        orders = range(attempt * how.orders, (2 ** (attempt + 1) - 1) * how.orders)
        new = first_edges(vectors, orders, how)
        graph = written(_best(graph.union(new) if graph is not None else new, how), "vector-graph")
        before = graph.agg(F.sum("sim")).first()[0] or 0.0
        for turn in range(how.rounds):
            graph = written(descend(graph, vectors, turn, how), "vector-graph")
            now = graph.agg(F.sum("sim")).first()[0] or 0.0
            if now - before <= how.gain * abs(before):
                break
            before = now
        over = graph.filter(F.col("sim") >= how.threshold).select("u", "v")
        edges = over if edges is None else edges.union(over)
        found = written(connected_components(edges, "u", "v"), "vector-components")
        more = written(bridges(saturated(graph, found, vectors, how), how), "vector-bridges")
        if more.count():
            edges = edges.union(more)
            found = written(connected_components(edges, "u", "v"), "vector-components")
        if audit(same, found, how) >= how.wanted_recall:
            break
    else:
        every = vectors.join(found.withColumnRenamed("node", "id"), "id", "left").select(F.coalesce("component", "id").alias("component"), "id", "v")
        found = written(connected_components(edges.union(written(bridges(every, how), "vector-bridges")), "u", "v"), "vector-components")
    members = same.join(found.withColumnRenamed("node", "id"), "id").select("component", "id", "v", "copies")
    counts = link_counts(members, how)
    of_vector = same.join(found.withColumnRenamed("node", "id"), "id", "left").join(counts, "id", "left").select("v", "copies", F.coalesce("n_links", F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    of_vector = written(of_vector, "vector-links")
    # Rows of a vector with very many copies stay where they are: fewer than COMMON vectors hold more than that share of all rows.
    common = of_vector.filter(F.col("copies") > max(COMMON, units.count() // COMMON))
    of_id = units.join(F.broadcast(common), "v").unionByName(units.join(F.broadcast(common.select("v")), "v", "left_anti").join(of_vector, "v"))
    of_id = of_id.select("vec_id", "n_links", "component_id")
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id")).join(of_id, "vec_id", "left")
    own = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("vec_id"), F.lit(True)).alias("kept"))
