"""Operator 12: phrase collocations from a weighted de Bruijn graph.

Nodes are runs of words, edges the longest runs (``longest`` words), from what comes before their last word to what
comes after their first. Three passes over the documents, each with sums that are made where the texts lie first:

1. Words are counted. Those below ``least`` can be in no candidate; they cut the pieces.
2. Pairs of what is left are counted by a 64-bit hash. Pairs below ``least`` cut the pieces too. What passes is told to
   the tasks as a table of bits of fixed size (``BITS``, whatever the corpus): a pair that shares a place with a frequent
   one stays, which costs work, but no rare one can push out a frequent one. So cuts never change a count that matters.
3. Every place in a piece gives the longest run that begins there. Runs of full length are the graph's edges; shorter
   ones begin too near to the end of their piece and are its corrections. Both are summed. Frequent runs are met by every
   task, so what tasks hand on grows with runs times tasks; this pass reads the splits in no more tasks than keep all
   cores busy, or than ``WORDS_A_TASK`` asks for.

The count of a shorter phrase is the flow out of its node, the sum of the edges that begin with it, plus the corrections
that begin with it. A node whose whole flow goes into one longer phrase, or comes out of one, lies on a unary path and is
compacted into it: those are just the phrases that a longer candidate makes superfluous, as every phrase between two of
one count has that count too. Scores are exact in decimals of 38 digits.

Odd rows: a null or empty text has no words; a null language is ``und``; repeated rows count each. A language without
candidates has no rows, nor has an empty table.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clusterloom.llm.common import written
from clusterloom.llm.fragments import give_back, slices
from clusterloom.llm.words import numbered_words, rows_of

#: What ends a piece, and what stands between words; an end becomes a word of its own.
ENDS, BETWEEN, END = r"[.,;:!?\x0A-\x0D]+", r"[\x20\x09]+", "\n"
#: Bits in each of the tables that are broadcast (16 MB).
BITS = 1 << 27
#: Words of the longest runs that are counted to cut pieces.
LEVELS = 3
#: Runs that a task adds up before it hands them on.
RUNS_HELD = 200_000
#: Words for each task of the last pass, where that makes more tasks than there are cores.
WORDS_A_TASK = 1 << 24
#: Places of one bitmap as Spark's functions make them.
BITMAP = 32768

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Pieces:
    """The words of a slice of rows in one row: numbers (-1 at the ends of pieces), distinct words, each word's language and hash."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        marked = pc.replace_substring_regex(texts, ENDS, f" {END} ")
        # A text's last word is followed by an end, so no piece goes on in the next text.
        numbers, offsets, self.names = numbered_words(pc.binary_join_element_wise(marked, END, " "), BETWEEN)
        end, real = pc.index(self.names, END).as_py(), numbers >= 0
        table = pc.dictionary_encode(pc.fill_null(langs, "und"))
        self.langs = table.dictionary.to_pylist()
        self.numbers = np.where(numbers == end, -1, numbers)[real]
        self.lang = table.indices.to_numpy(zero_copy_only=False).astype(np.int64)[rows_of(offsets)[real]]

    def passing(self, tables: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For one word, two words and so on: hash of the run that begins at each place, and whether it may be frequent.

        A table tells which runs are, where there is one for their length; beyond, the runs within them tell.
        """
        first = mixed(hashes_of(self.langs, 1)[self.lang], hashes_of(self.names.to_pylist())[self.numbers])
        hashes, going = first, self.numbers >= 0
        for k in itertools.count(1):
            if k <= len(tables):
                going[going] = has(tables[k - 1], hashes[going])
            yield hashes, going
            going = going & np.append(going[1:], False)[: len(going)]
            hashes = mixed(hashes, np.append(first[k:], np.zeros(min(k, len(first)), dtype=np.uint64)))


def hashes_of(texts: list[str], seed: int = 0) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x, seed) for x in texts], dtype=np.uint64)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 bits of two hashes in their order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes % np.uint64(len(bits) * 8)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _mapped(documents: DataFrame, of_pieces: Callable[[Pieces], tuple[list, list[str]]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part, texts in slices(batch):
                arrays, names = of_pieces(Pieces(part.column("lang"), texts))
                yield pa.RecordBatch.from_arrays(arrays, names=names)
            give_back()

    return documents.select("lang", "text").mapInArrow(run, schema)


def word_counts(documents: DataFrame) -> DataFrame:
    """lang, phrase (one word), n."""

    def of_pieces(p: Pieces):
        real = p.numbers >= 0
        keys, counts = np.unique(p.lang[real] * len(p.names) + p.numbers[real], return_counts=True)
        langs = pa.array(p.langs, pa.string()).take(pa.array(keys // max(1, len(p.names))))
        return [langs, p.names.take(pa.array(keys % max(1, len(p.names)))), pa.array(counts, pa.int64())], ["lang", "phrase", "n"]

    return _mapped(documents, of_pieces, "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def hashed(words: DataFrame) -> DataFrame:
    """hash, n of counted words."""

    def run(batches):
        for batch in batches:
            hashes = mixed(hashes_of(batch.column("lang").to_pylist(), 1), hashes_of(batch.column("phrase").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch.column("n")], names=["hash", "n"])

    return words.select("lang", "phrase", "n").mapInArrow(run, "hash bigint, n bigint")


def run_counts(documents: DataFrame, tables: list[Broadcast]) -> DataFrame:
    """hash, n of the runs that are a word longer than those of the last table, whose words and shorter runs all pass."""
    size = len(tables)

    def of_pieces(p: Pieces):
        hashes, going = next(itertools.islice(p.passing([t.value for t in tables]), size, None))
        keys, counts = np.unique(hashes[going], return_counts=True)
        return [pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], ["hash", "n"]

    return _mapped(documents, of_pieces, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))


def told(counts: DataFrame, least: int, bits: int = BITS) -> Broadcast:
    """The hashes of what is counted ``least`` times or more, as a table of bits, made of bitmaps by Spark."""
    # Bitmaps of Spark count places from 1. The remainder is that of the unsigned hash, as the bits are a power of two.
    place = F.pmod("hash", F.lit(bits)) + 1
    maps = counts.filter(F.col("n") >= least).groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap"))
    table = np.zeros(max(bits, BITMAP) // 8, dtype=np.uint8)
    for r in maps.toLocalIterator():
        start = (r.bucket - 1) * BITMAP // 8
        table[start : start + BITMAP // 8] = np.frombuffer(r.bitmap, dtype=np.uint8)
    return counts.sparkSession.sparkContext.broadcast(table[: bits // 8])


def gathered(documents: DataFrame, n: int, words_a_task: int = WORDS_A_TASK) -> DataFrame:
    """``documents``, of ``n`` words, in as many tasks as there are cores, or in more of ``words_a_task`` words each; without a shuffle."""
    return documents.coalesce(max(1, documents.sparkSession.sparkContext.defaultParallelism, n // words_a_task))


def task_runs(documents: DataFrame, tables: list[Broadcast], longest: int) -> DataFrame:
    """lang, run (two words or more, space-joined), n: for every place the longest run that begins there.

    A task adds up what it meets, ``RUNS_HELD`` runs at a time; sums of other tasks are rows of their own.
    """

    def of_pieces(p: Pieces) -> Iterator[tuple[tuple[str, str], int]]:
        starts, words_of = None, None
        numbers = np.append(p.numbers, np.full(longest, -1))
        for k, (_, going) in enumerate(itertools.islice(p.passing([t.value for t in tables]), 1, longest)):
            if starts is None:
                starts = np.flatnonzero(going)
                words_of = np.full((len(starts), longest), -1)
                words_of[:, 0] = numbers[starts]
            some = going[starts]
            words_of[some, k + 1] = numbers[starts[some] + k + 1]
        keys = p.lang[starts]
        # Equal runs have equal numbers after each word, so no key goes beyond 64 bits.
        for k in range(longest):
            keys = np.unique(keys * (len(p.names) + 1) + words_of[:, k] + 1, return_inverse=True)[1].astype(np.int64)
        _, first, counts = np.unique(keys, return_index=True, return_counts=True)
        names = p.names.to_pylist()
        texts = [" ".join([names[i] for i in row if i >= 0]) for row in words_of[first].tolist()]
        return zip(zip([p.langs[i] for i in p.lang[starts[first]].tolist()], texts, strict=True), counts.tolist(), strict=True)

    def out(seen: dict) -> pa.RecordBatch:
        langs, texts = zip(*seen, strict=True) if seen else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(texts, pa.string()), pa.array(seen.values(), pa.int64())], names=["lang", "run", "n"])

    def run(batches: Iterator[pa.RecordBatch]):
        seen: dict = {}
        for batch in batches:
            for part, texts in slices(batch):
                for key, n in of_pieces(Pieces(part.column("lang"), texts)):
                    seen[key] = seen.get(key, 0) + n
                if len(seen) > RUNS_HELD:
                    yield out(seen)
                    seen = {}
            give_back()
        yield out(seen)

    return documents.select("lang", "text").mapInArrow(run, "lang string, run string, n bigint")


def phrase_counts(edges: DataFrame, least: int) -> DataFrame:
    """lang, words, a of all phrases of two words or more: a node's flow and its corrections."""
    run = F.split("run", " ")
    begins = F.explode(F.transform(F.sequence(F.lit(2), F.size(run)), lambda k: F.slice(run, 1, k)))
    return edges.select("lang", begins.alias("words"), "n").groupBy("lang", "words").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)


def on_unary_paths(phrases: DataFrame) -> DataFrame:
    """lang, words of the phrases whose whole flow goes into, or comes out of, one phrase that is a word longer."""
    shorter = F.explode(F.array(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)")))
    longer = phrases.filter(F.size("words") > 2).select("lang", shorter.alias("words"), F.col("a").alias("flow")).groupBy("lang", "words").agg(F.max("flow").alias("flow"))
    return phrases.join(longer, ["lang", "words"]).filter(F.col("flow") >= F.col("a")).select("lang", "words")


def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, words, phrase, a, l, r, n, score: the lowest-scoring cut of each phrase, ties to the shortest first part.

    ``words``: lang, phrase, n of single words; ``totals``: lang, n of all words.
    """
    parts = phrases.select("lang", F.array_join("words", " ").alias("part"), F.col("a").alias("f")).unionByName(words.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")))
    k = F.explode(F.sequence(F.lit(1), F.size("words") - 1))
    cuts = phrases.select("lang", "words", "a", k.alias("k")).withColumns({
        "left": F.array_join(F.expr("slice(words, 1, k)"), " "), "right": F.array_join(F.expr("slice(words, k + 1, size(words) - k)"), " "),
    })
    cuts = cuts.join(parts.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"]).join(totals, "lang")
    big = {c: f"CAST({c} AS DECIMAL(19, 0))" for c in "alrn"}
    score = F.expr(f"(CAST(1000 AS DECIMAL(4, 0)) * {big['a']} * {big['n']}) div ({big['l']} * {big['r']})")
    lowest = cuts.withColumn("score", score).groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "words", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(documents: DataFrame, least: int = 100, longest: int = 5, first: int = 2000, bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``first`` phrases of 2 to ``longest`` words.

    A phrase that occurs ``a >= least`` times is a candidate; its score is ``floor(1000 a n / (l r))`` at its lowest cut
    into parts that occur ``l`` and ``r`` times, in ``n`` words. Candidates inside a longer one that occurs as often are
    dropped.
    """
    words = written(word_counts(documents), "words")
    frequent = words.filter(F.col("n") >= least)
    tables = [told(hashed(frequent), least, bits)]
    for _ in range(1, min(levels, longest)):
        tables.append(told(run_counts(documents, tables), least, bits))
    n = words.agg(F.sum("n")).first()[0] or 0
    edges = task_runs(gathered(documents, n), tables, longest).groupBy("lang", "run").agg(F.sum("n").alias("n"))
    phrases = written(phrase_counts(edges, least), "phrases")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    kept = phrases.join(on_unary_paths(phrases), ["lang", "words"], "left_anti")
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = scored(phrases, frequent, totals).join(kept.select("lang", "words"), ["lang", "words"], "left_semi").withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = 100, longest: int = 5, first: int = 2000) -> str:
    """DuckDB SQL of :func:`collocations` over ``documents``."""
    places = ", ".join(f"lead(word, {k}) OVER piece_words AS w{k}" for k in range(1, longest))
    grams = " UNION ALL ".join(
        f"SELECT lang, word || {' || '.join(f"' ' || w{j}" for j in range(1, k))} AS phrase, {k} AS size FROM places WHERE w{k - 1} IS NOT NULL" for k in range(2, longest + 1)
    )
    return rf"""
        WITH docs AS (SELECT row_number() OVER () AS place, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents),
        pieces AS (SELECT place, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
        numbered AS (SELECT lang, row_number() OVER () AS piece_id, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
        words AS (SELECT lang, piece_id, unnest(words) AS word, generate_subscripts(words, 1) AS spot FROM numbered),
        places AS (SELECT lang, word, {places} FROM words WINDOW piece_words AS (PARTITION BY piece_id ORDER BY spot)),
        totals AS (SELECT lang, count(*) AS n FROM words GROUP BY ALL),
        f AS (SELECT lang, word AS phrase, count(*) AS f FROM words GROUP BY ALL UNION ALL SELECT lang, phrase, count(*) AS f FROM ({grams}) GROUP BY ALL HAVING count(*) >= {least}),
        candidates AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS parts FROM f WHERE phrase LIKE '% %' AND f >= {least}),
        cuts AS (
            SELECT lang, phrase, a, k, array_to_string(parts[1:k], ' ') AS first_part, array_to_string(parts[k + 1:], ' ') AS rest
            FROM (SELECT *, unnest(range(1, len(parts))) AS k FROM candidates)),
        scores AS (
            SELECT c.lang, c.phrase, a, k, l.f AS l, r.f AS r, n, ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
            FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = first_part JOIN f r ON r.lang = c.lang AND r.phrase = rest JOIN totals t ON t.lang = c.lang),
        lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        inside AS (
            SELECT DISTINCT s.lang, s.phrase FROM candidates s JOIN (
                SELECT lang, a, array_to_string(parts[b:b + size - 1], ' ') AS phrase
                FROM (SELECT *, unnest(range(1, len(parts) - size + 2)) AS b FROM (SELECT *, unnest(range(2, len(parts))) AS size FROM candidates))) g
            ON g.lang = s.lang AND g.phrase = s.phrase AND 100 * g.a >= 100 * s.a),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
            FROM lowest ANTI JOIN inside USING (lang, phrase))
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {first}"""
