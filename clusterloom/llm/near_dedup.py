"""Operator 4: near-duplicate documents by banded MinHash with sequential Bayesian verification.

A document's set is its distinct five-word shingles. Signatures are cut into bands; documents that share a band are
candidates. A bucket never becomes all its pairs: its members are compared with one hub (the member that meets most
others), what is linked is joined to components, and only members of different components are compared further: in small
buckets outright, in large ones through an exact prefix filter. A group of copies costs as much as it has members. A
candidate's signatures are compared batch by batch and it is given up once the posterior chance that its similarity
reaches the threshold falls below ``miss``; what remains is verified on the full sets.

With 72 bands of 7 a pair at similarity 0.75 shares no band with chance 3e-5, one at 0.8 with chance 6e-8.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clusterloom.llm.common import written
from clusterloom.llm.fragments import give_back, turn_to_other_work
from clusterloom.operators.graph import connected_components

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@dataclass(frozen=True)
class NearDedup:
    words: int = 5
    #: Linked where 100 * intersection >= percent * union.
    percent: int = 75
    bands: int = 72
    rows: int = 7
    #: Hashes (the last of the bands') that the sequential test may look at, how many at a time, and the chance to lose a
    #: link that it accepts. That candidates share a band only lets more of them pass.
    tests: int = 128
    batch: int = 16
    miss: float = 1e-7
    seed: int = 11
    #: Bits of the table that tells which texts a comparison can need (8 MB, whatever the input); a multiple of 32768.
    id_bits: int = 1 << 26
    #: Rows of a bucket that are compared with each other after its hub; larger ones go through the prefix filter.
    small_bucket: int = 32


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to their sets: sorted distinct 64-bit hashes of their shingles."""

    def __init__(self, size: int, cache: int = 300_000):
        self.size, self.cache = size, cache
        self.known: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        if len(self.known) >= self.cache:
            self.known.clear()
        found = self.known[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
        if not words:
            return np.zeros(0, dtype=np.uint64)
        get, make = self.known.get, self._hash
        hashes = np.array([get(w) or make(w) for w in words], dtype=np.uint64)
        size = min(self.size, len(words))
        out = np.full(len(words) - size + 1, size, dtype=np.uint64)
        for k in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(out)]
        return np.unique(mixed(out))


@lru_cache(maxsize=4)
def _functions(how: NearDedup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(how.seed)
    n = how.bands * how.rows
    odd = rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return odd, rng.integers(0, 2**32, n, dtype=np.uint32), rng.integers(0, 2**63, how.rows, dtype=np.uint64) | np.uint64(1)


def signature(shingles: np.ndarray, how: NearDedup) -> tuple[np.ndarray, bytes]:
    """Band keys, and 16 bits of each test hash."""
    times, plus, weights = _functions(how)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(times), 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(x), 4096):
        part = x[a : a + 4096]
        for f in range(0, len(times), 32):
            np.minimum(least[f : f + 32], (times[f : f + 32, None] * part + plus[f : f + 32, None]).min(axis=1), out=least[f : f + 32])
    banded = least.reshape(how.bands, how.rows).astype(np.uint64)
    keys = mixed((banded * weights).sum(axis=1, dtype=np.uint64) + np.arange(1, how.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return keys.view(np.int64), (least[-how.tests :] >> np.uint32(16)).astype("<u2").tobytes()


def features(documents: DataFrame, how: NearDedup = NearDedup()) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the whole set), bands, tests of each row; empty sets have no bands."""

    def run(batches):
        turn_to_other_work()
        shingle = Shingler(how.words)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sizes, digests, bands, tests = [], [], [], []
                for text in part.column("text").to_pylist():
                    own = shingle(text or "")
                    keys, test = signature(own, how) if len(own) else (np.zeros(0, dtype=np.int64), None)
                    sizes.append(len(own))
                    digests.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                    bands.append(keys)
                    tests.append(test)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, bands)]), pa.int32()), pa.array(np.concatenate(bands) if bands else [], pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists, pa.array(tests, pa.binary())], names=["doc_id", "n_shingles", "set_key", "bands", "tests"])
        del shingle
        give_back()

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>, tests binary")


@lru_cache(maxsize=4)
def least_matches(how: NearDedup) -> tuple[int, ...]:
    """After each batch: the fewest matches with which a pair goes on.

    With a uniform prior, m matches of n leave Beta(m + 1, n - m + 1); its mass above the threshold is the chance that of
    n + 1 draws at the threshold at most m succeed.
    """
    t = how.percent / 100
    out = []
    for n in range(how.batch, how.tests + 1, how.batch):
        mass, m = 0.0, 0
        while True:
            mass += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if mass >= how.miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def _tested(pairs: DataFrame, feats: DataFrame, how: NearDedup) -> DataFrame:
    """a, b, same of the pairs that the sequential test leaves; ``same``: the sets have one digest."""
    own = feats.select("doc_id", "set_key", "tests")
    left = own.withColumnsRenamed({"doc_id": "a", "set_key": "a_key", "tests": "a_tests"})
    right = own.withColumnsRenamed({"doc_id": "b", "set_key": "b_key", "tests": "b_tests"})
    limits = least_matches(how)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            same = np.array([x == y for x, y in zip(batch.column("a_key").to_pylist(), batch.column("b_key").to_pylist(), strict=True)])
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(n, how.tests) for c in ("a_tests", "b_tests"))
            matches, alive = np.zeros(n, dtype=np.int64), ~same
            for k, least in enumerate(limits):
                rows = np.flatnonzero(alive)
                if not len(rows):
                    break
                piece = slice(k * how.batch, (k + 1) * how.batch)
                matches[rows] += (a[rows, piece] == b[rows, piece]).sum(axis=1)
                alive[rows] = matches[rows] >= least
            stay = pa.array(same | alive)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(stay), batch.column("b").filter(stay), pa.array(same).filter(stay)], names=["a", "b", "same"])

    joined = pairs.join(left, "a").join(right, "b")
    return joined.select("a", "b", "a_key", "b_key", "a_tests", "b_tests").mapInArrow(run, "a bigint, b bigint, same boolean")


def _in_parts(batches, rows: int = 128):
    """Batches a few rows at a time: texts become Python objects, and workers share an executor's memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _texts_of(documents: DataFrame, ids: DataFrame, how: NearDedup) -> DataFrame:
    """doc_id, text of the documents that ``ids`` (doc_id) holds, and of few others, told without a shuffle of texts.

    The ids' hashes set bits in a table of at most ``id_bits`` bits, which meets the documents where they are read. A bit
    may be shared, so what needs these ids alone still joins with them; with more ids than bits more texts pass, no fewer.
    """
    place = lambda: F.pmod(F.xxhash64("doc_id"), F.lit(how.id_bits))
    bits = ids.groupBy(F.shiftright(place(), 15).alias("part")).agg(F.bitmap_construct_agg(place().bitwiseAND(F.lit(32767))).alias("bits"))
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    at = place().bitwiseAND(F.lit(32767))
    byte = F.conv(F.hex(F.col("bits").substr(F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    known = F.expr("shiftright(__byte, __bit) & 1 = 1")
    met = texts.withColumn("__part", F.shiftright(place(), 15)).join(F.broadcast(bits), F.col("__part") == F.col("part"))
    return met.withColumn("__byte", byte).withColumn("__bit", at.bitwiseAND(F.lit(7)).cast("int")).filter(known).select("doc_id", "text")


def _verified(pairs: DataFrame, documents: DataFrame, how: NearDedup) -> DataFrame:
    """The pairs whose full sets reach the threshold; rows of one hub arrive together, so its set is made once."""
    of = lambda name: _texts_of(documents, pairs.select(F.col(name).alias("doc_id")), how).withColumnsRenamed({"doc_id": name, "text": f"{name}_text"})
    both = pairs.join(of("b"), "b").join(of("a"), "a")

    def run(batches):
        shingle = Shingler(how.words)
        hub, hub_set = None, None
        for part in _in_parts(batches):
            linked = []
            for a, a_text, b_text in zip(part.column("a").to_pylist(), part.column("a_text").to_pylist(), part.column("b_text").to_pylist(), strict=True):
                if hub is None or hub != (a, a_text):
                    hub, hub_set = (a, a_text), shingle(a_text)
                other = shingle(b_text)
                shared = len(np.intersect1d(hub_set, other, assume_unique=True))
                linked.append(shared > 0 and 100 * shared >= how.percent * (len(hub_set) + len(other) - shared))
            stay = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column("a").filter(stay), part.column("b").filter(stay)], names=["a", "b"])
        del shingle, hub, hub_set
        give_back()

    return both.select("a", "b", "a_text", "b_text").mapInArrow(run, "a bigint, b bigint")


def _links(pairs: DataFrame, feats: DataFrame, documents: DataFrame, how: NearDedup) -> DataFrame:
    tested = written(_tested(pairs, feats, how), "near-tested")
    rest = tested.filter("not same").select("a", "b").distinct()
    return written(tested.filter("same").select("a", "b").union(_verified(written(rest, "near-pairs"), documents, how)), "near-links")


def components(documents: DataFrame, feats: DataFrame, how: NearDedup = NearDedup()) -> DataFrame:
    """node, component of all documents that have a link."""
    banded = feats.filter("n_shingles > 0 and doc_id is not null").select("doc_id", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo <> hi").select("key", "n")
    # The more documents a document meets, the nearer it is to the middle of its group; a text that others were made from
    # meets more than they meet each other. So buckets take their most met member as the hub.
    met = F.sum("n").over(Window.partitionBy("doc_id"))
    ranked = written(banded.join(shared, "key").select("key", "doc_id", met.alias("met")), "near-ranked")
    first = F.max_by("doc_id", F.struct("met", -F.col("doc_id")))
    buckets = written(ranked.join(ranked.groupBy("key").agg(first.alias("hub")), "key"), "near-buckets")
    pairs = written(buckets.filter("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct(), "near-pairs")
    links = _links(pairs, feats, documents, how)
    found = written(connected_components(links, "a", "b"), "near-components")
    # Buckets that still hold several components: small ones compare their members, large ones give theirs to the prefix filter.
    joined = buckets.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    several = joined.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo <> hi").select("key", "size")
    left = written(joined.join(several, "key").select("key", "doc_id", "component", "size"), "near-open")
    small = left.filter(F.col("size") <= how.small_bucket).select("key", "doc_id", "component")
    other = small.withColumnsRenamed({"doc_id": "b", "component": "its"})
    crossed = small.join(other, (small["key"] == other["key"]) & (small["doc_id"] < F.col("b")) & (F.col("component") != F.col("its"))).select(F.col("doc_id").alias("a"), "b")
    large = written(left.filter(F.col("size") > how.small_bucket).select("doc_id", "component").distinct(), "near-large")
    if not large.isEmpty():
        crossed = crossed.union(prefix_pairs(documents, large, how))
    asked = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = _links(written(crossed.distinct().join(asked, ["a", "b"], "left_anti"), "near-pairs"), feats, documents, how)
    if more.isEmpty():
        return found
    return written(connected_components(links.unionByName(more), "a", "b"), "near-components")


def prefix_pairs(documents: DataFrame, members: DataFrame, how: NearDedup) -> DataFrame:
    """a, b of all members of different components that may link, by an exact prefix filter.

    Shingles are ordered by how many members hold them, rarest first. Sets of n and m that link share at least
    t / (1 + t) * (n + m) shingles, so the first one they share has as many left, itself included, in either set. Shingles
    that one member alone holds find nobody, so a large group of texts that each differ too much in their own way gives no
    pairs at all.
    """
    share = how.percent / 100
    texts = _texts_of(documents, members, how).join(members, "doc_id")

    def run(batches):
        shingle = Shingler(how.words)
        for part in _in_parts(batches):
            for doc_id, component, text in zip(part.column("doc_id").to_pylist(), part.column("component").to_pylist(), part.column("text").to_pylist(), strict=True):
                own = shingle(text or "").view(np.int64)
                n = len(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, doc_id)), pa.array(np.full(n, component)), pa.array(np.full(n, n)), pa.array(own)], names=["doc_id", "component", "n", "shingle"])

    rows = written(texts.select("doc_id", "component", "text").mapInArrow(run, "doc_id bigint, component bigint, n bigint, shingle bigint"), "near-shingles")
    shared = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1")
    # Of a document's shingles the unshared ones come first, so the others' places start after them.
    held = rows.join(shared, "shingle")
    own = Window.partitionBy("doc_id")
    place = F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("holders", "shingle"))
    prefix = held.withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1).select("shingle", "doc_id", "component", "n", "place")
    other = prefix.withColumnsRenamed({"shingle": "s", "doc_id": "b", "component": "its", "n": "m", "place": "there"})
    least = F.ceil((F.col("n") + F.col("m")) * (share / (1 + share)) - 1e-9)  # shared shingles that a link needs
    room = (F.col("n") - F.col("place") + 1 >= least) & (F.col("m") - F.col("there") + 1 >= least)
    both = prefix.join(other, (F.col("shingle") == F.col("s")) & (F.col("doc_id") < F.col("b")) & (F.col("component") != F.col("its")) & room)
    return both.select(F.col("doc_id").alias("a"), "b")


def near_duplicates(documents: DataFrame, how: NearDedup = NearDedup()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable), kept (the id is its component's) of each row.

    Texts without words, null or empty, have no shingles and link with nothing. Rows that repeat an id are one node and
    each get their row; a null id links with nothing and stays, its component null. An empty table gives no rows.
    """
    feats = written(features(documents, how), "near-features")
    found = components(documents, feats, how).withColumnRenamed("node", "doc_id")
    joined = feats.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    own = F.coalesce("component", "doc_id")
    return joined.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def without_near_duplicates(documents: DataFrame, how: NearDedup = NearDedup()) -> DataFrame:
    """``documents`` without those that a smaller id of their group stands for; columns as they were."""
    feats = written(features(documents, how), "near-features")
    gone = components(documents, feats, how).filter("node <> component").select(F.col("node").alias("__gone"))
    return documents.join(gone, F.col("doc_id").cast("bigint") == F.col("__gone"), "left_anti")
