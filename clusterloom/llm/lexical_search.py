"""Operator 11: ranked lexical search, term at a time with limited accumulators.

Each document becomes a row of its length and its query terms with their occurrences; these rows are written once, as
they give the statistics (documents, lengths, document frequencies) and then the scores. Scoring takes the rows block by
block where they lie, without a shuffle: for each query, the rarest term first, postings add to accumulators. Before each
term the most that the remaining terms can add is known, from their weights and the block's largest impacts. Once that
falls below the kth best score (of the block's partial scores or of whole scores met before), no new accumulator is made;
those that can still get there are updated exactly. A block hands on no more than its k best of a query, and the best of
all are ranked in two steps, so no task gets all of a query's rows.

Queries are broadcast in groups of at most ``TERMS_AT_ONCE`` terms (one query's own terms stay together); more
queries mean more passes over the documents, not a larger broadcast.

Odd rows: a null or empty text has no terms and counts as no document. Each row is a document, so repeated rows are
ranked one after the other, and null ids come last among equal scores. Rows that share an item_id are one query, whose
terms are those of all its different texts; a query without terms, or without a hit, has no rows. Without documents or
queries there are no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from clusterloom.llm.common import written
from clusterloom.llm.fragments import give_back, slices
from clusterloom.llm.words import numbered_words, rows_of

#: What stands between terms: ASCII but for digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Terms of queries in one broadcast.
TERMS_AT_ONCE = 200_000
#: Parts in which a query's candidates are ranked first.
PARTS = 64


def index(documents: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, n (all terms), terms (places in ``vocabulary``, ascending), tfs of every document that has a term at all."""
    table, size = documents.sparkSession.sparkContext.broadcast(vocabulary), max(1, len(vocabulary))

    def run(batches):
        known = pa.array(table.value, pa.string())
        for batch in batches:
            for part, texts in slices(batch):
                numbers, offsets, names = numbered_words(texts, BETWEEN)
                rows = rows_of(offsets)
                n = np.bincount(rows[numbers >= 0], minlength=len(texts))
                place = pc.fill_null(pc.index_in(names, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                places = np.where(numbers >= 0, place[numbers], -1) if len(place) else numbers
                found = places >= 0
                keys, tfs = np.unique(rows[found] * size + places[found], return_counts=True)
                ends = pa.array(np.searchsorted(keys // size, np.arange(len(texts) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(keys % size, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))]
                out = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))
        give_back()

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, terms array<int>, tfs array<bigint>")


def query_terms(items: DataFrame) -> DataFrame:
    """item_id, term, n (occurrences)."""

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch):
                numbers, offsets, names = numbered_words(texts, BETWEEN)
                real = numbers >= 0
                ids = part.column("item_id").take(pa.array(rows_of(offsets)[real]))
                yield pa.RecordBatch.from_arrays([ids, names.take(pa.array(numbers[real]))], names=["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    words = items.select("item_id", "text").distinct().mapInArrow(run, f"item_id {kind}, term string")
    return words.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("n"))


class Block:
    """Postings of some documents: for each term its documents (ascending) and impacts."""

    def __init__(self, batch: pa.RecordBatch, documents: int, length: int):
        self.size = batch.num_rows
        n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
        m = 75 + (25 * n * documents) // length
        lists = batch.column("terms")
        terms = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        tfs = batch.column("tfs").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.repeat(np.arange(self.size), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        order = np.argsort(terms, kind="stable")
        impacts = (1_000_000_000 * tfs) // (1000 * tfs + 12 * m[rows])
        self.rows, self.impacts = rows[order], impacts[order]
        names, starts = np.unique(terms[order], return_index=True)
        most = np.maximum.reduceat(self.impacts, starts) if len(starts) else starts
        self.at = dict(zip(names.tolist(), zip(starts.tolist(), np.append(starts, len(order))[1:].tolist(), most.tolist(), strict=True), strict=True))

    def best(self, terms: list[tuple[int, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores that may be among the k best of a query, given that k scores of ``least`` are known already.

        ``terms``: (term, weight times occurrences), the rarest first.
        """
        here = [(*self.at[t], w) for t, w in terms if t in self.at and w > 0]
        rest = [0] * (len(here) + 1)
        for i in range(len(here) - 1, -1, -1):
            rest[i] = rest[i + 1] + here[i][2] * here[i][3]
        score = np.zeros(self.size, dtype=np.int64)
        alive = None
        for i, (start, stop, _, weight) in enumerate(here):
            if alive is None:
                if i and rest[i] < score.max():
                    least = max(least, kth_largest(score, k))
                if rest[i] < least:
                    alive = (score > 0) & (score + rest[i] >= least)
            rows, impacts = self.rows[start:stop], self.impacts[start:stop]
            if alive is not None:
                some = alive[rows]
                rows, impacts = rows[some], impacts[some]
            score[rows] += weight * impacts
        if alive is not None:
            score[~alive] = 0
        rows = np.flatnonzero(score >= max(1, least, kth_largest(score, k)))
        return rows, score[rows]


def kth_largest(scores: np.ndarray, k: int) -> int:
    """0 if there are fewer than k."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def _scored(rows: DataFrame, queries: list[tuple[object, list[tuple[int, int]]]], documents: int, length: int, k: int, id_type) -> DataFrame:
    """item_id, doc_id, score: for each query the best that each task finds."""
    asked = rows.sparkSession.sparkContext.broadcast(queries)
    doc_type = rows.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]):
        queries = asked.value
        best: list[list[tuple]] = [[] for _ in queries]
        for batch in batches:
            if not batch.num_rows:
                continue
            block, ids = Block(batch, documents, length), batch.column("doc_id").to_pylist()
            for held, (_, terms) in zip(best, queries, strict=True):
                found, scores = block.best(terms, k, held[k - 1][0] if len(held) >= k else 0)
                if len(found):
                    held += zip(scores.tolist(), [ids[i] for i in found.tolist()], strict=True)
                    held.sort(key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))
                    del held[k:]
        flat = [(item, doc, score) for held, (item, _) in zip(best, queries, strict=True) for score, doc in held]
        columns = list(zip(*flat, strict=True)) if flat else [(), (), ()]
        kinds = [to_arrow_type(id_type), to_arrow_type(doc_type), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["item_id", "doc_id", "score"])

    return rows.select("doc_id", "n", "terms", "tfs").mapInArrow(run, f"item_id {id_type.simpleString()}, doc_id {doc_type.simpleString()}, score bigint")


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest of each item, equal scores by ascending doc_id."""
    best = (F.desc("score"), F.asc_nulls_last("doc_id"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    first = scores.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*best))).filter(F.col("rank") <= k)
    whole = first.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*best))).filter(F.col("rank") <= k)
    return whole.select("item_id", "rank", "doc_id", "score")


def search(documents: DataFrame, items: DataFrame, k: int = 20, terms_at_once: int = TERMS_AT_ONCE) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring documents of each item, scores above 0 alone.

    A term weighs ``w = floor(1000 ln((2N+2) / (2df+1)))``; an occurrence count ``tf`` in a document with ``n`` of all
    ``L`` terms adds ``w * (10^9 tf div (1000 tf + 12 m))``, where ``m = 75 + 25 n N div L``.
    """
    spark, id_type = documents.sparkSession, items.schema["item_id"].dataType
    asked = written(query_terms(items), "query-terms")
    groups = max(1, math.ceil(asked.count() / terms_at_once))
    found = spark.createDataFrame([], f"item_id {id_type.simpleString()}, doc_id {documents.schema['doc_id'].dataType.simpleString()}, score bigint")
    for group in range(groups):
        queries: dict = {}
        for r in asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == group).collect():
            queries.setdefault(r.item_id, []).append((r.term, r.n))
        vocabulary = sorted({t for terms in queries.values() for t, _ in terms})
        if not vocabulary:
            continue
        rows = written(index(documents, vocabulary), "postings")
        total = rows.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("length")).first()
        if not total.documents:
            break
        df = {r.term: r["count"] for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
        place = {t: i for i, t in enumerate(vocabulary)}
        weight = {i: math.floor(1000 * math.log((2 * total.documents + 2) / (2 * n + 1))) for i, n in df.items()}
        by_rarity = [(item, sorted(((place[t], weight[place[t]] * n) for t, n in terms if place[t] in df), key=lambda x: (df[x[0]], x[0]))) for item, terms in queries.items()]
        found = found.unionByName(_scored(rows, by_rarity, total.documents, total.length, k, id_type))
    return ranked(found, k)


def oracle(k: int = 20) -> str:
    """DuckDB SQL of :func:`search` over ``documents`` and ``benchmark``."""

    def words(table: str) -> str:
        upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
        return rf"unnest(regexp_extract_all(translate(coalesce({table}.text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"

    return f"""
        WITH docs AS (SELECT row_number() OVER () AS place, doc_id, text FROM documents),
        words AS (SELECT place, doc_id, {words("docs")} AS term FROM docs),
        tf AS (SELECT place, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
        lengths AS (SELECT place, count(*) AS n FROM words GROUP BY ALL),
        total AS (SELECT count(*) AS nn, sum(n)::BIGINT AS l FROM lengths),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
        texts AS (SELECT DISTINCT item_id, text FROM benchmark),
        asked AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, {words("texts")} AS term FROM texts) GROUP BY ALL),
        weights AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, total),
        hits AS (
            SELECT item_id, place, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // l))))::BIGINT AS score
            FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (place), total GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM hits WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {k}"""
