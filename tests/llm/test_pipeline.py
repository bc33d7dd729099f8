import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from clusterloom.llm import packing, pii, quality, queries, toxicity
from test_near import roots, shingles

WORDS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check_packing(rows, texts, capacity=2048):
    by_sequence, by_document = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_document.setdefault(r.doc_id, []).append(r)
    assert set(by_document) == set(texts)
    for i, own in by_document.items():
        ids = [*WORDS.encode(texts[i] or "", add_special_tokens=False).ids, 0]
        own.sort(key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in own] == [(k, a, min(capacity, len(ids) - a)) for k, a in enumerate(range(0, len(ids), capacity))]
        assert all(zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32 for r in own)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in own]).tolist()
        assert [r.offset for r in own] == [0, *ends[:-1]] and ends[-1] <= capacity
    return len(by_sequence), sum(r.length for r in rows)


def test_op5_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sequences, tokens = check_packing(queries.op5_packing(spark, sf_dir).collect(), texts)
    assert sequences <= 1.02 * -(-tokens // 2048) + 1


def test_odd_packing(spark, odd_documents, no_documents):
    own = odd_documents.filter("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing(queries.packing.pack(own, public_tokenizers.path("word_bpe_49k.json")).collect(), {r.doc_id: r.text for r in own.collect()})
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(odd_documents, path).collect()
    assert len({r.sequence_id for r in rows}) <= sum(r.length for r in rows) // 2048 + 2
    assert packing.pack(no_documents, path).count() == 0


def lengths_of(name):
    rng = np.random.default_rng(1)
    return {
        "uniform": lambda: rng.integers(1, 2049, 3000), "small": lambda: rng.integers(1, 60, 5000), "halves": lambda: np.full(999, 1024), "one": lambda: np.array([7]),
        "pairs": lambda: rng.integers(1000, 1049, 5000), "triples": lambda: rng.integers(560, 801, 5000), "rare": lambda: rng.integers(1, 2049, 40),
        "documents": lambda: np.minimum(2048, rng.lognormal(6, 1, 20_000).astype(int) + 1),
    }[name]()


@pytest.mark.parametrize("name", ["uniform", "small", "halves", "one", "pairs", "triples", "rare", "documents"])
def test_plans_cover_the_histogram(name):
    lengths = lengths_of(name)
    histogram = {int(a): int(b) for a, b in zip(*np.unique(lengths, return_counts=True))}
    solution = packing.solve(histogram)
    covered = {}
    for configuration, n in solution.plan:
        assert sum(a * b for a, b in configuration.items()) <= 2048
        for a, b in configuration.items():
            covered[a] = covered.get(a, 0) + b * n
    assert covered == histogram
    volume = -(-int(lengths.sum()) // 2048)
    plain = sum(n for _, n in packing.best_fit(histogram, 2048))
    assert volume <= solution.bound <= solution.sequences <= plain and solution.rounded <= solution.sequences
    assert solution.sequences <= 1.02 * solution.bound + 1


def test_bound_is_below_the_fewest_sequences():
    """Every way to pack a few pieces, by trying them all."""

    def fewest(pieces, bins=()):
        if not pieces:
            return len(bins)
        n, rest = pieces[0], pieces[1:]
        return min(fewest(rest, tuple(sorted((*bins[:i], b + n, *bins[i + 1 :])))) if i < len(bins) else fewest(rest, (*bins, n)) for i, b in enumerate((*bins, 0)) if b + n <= 30)

    rng = np.random.default_rng(5)
    for _ in range(12):
        pieces = sorted(rng.integers(1, 31, 7).tolist(), reverse=True)
        solution = packing.solve({n: pieces.count(n) for n in pieces}, packing.Packing(capacity=30))
        assert solution.bound <= fewest(tuple(pieces)) <= solution.sequences


def test_pricing_is_the_best_knapsack():
    rng = np.random.default_rng(2)
    for _ in range(30):
        lengths = np.unique(rng.integers(1, 12, 4))
        prices = rng.random(len(lengths))
        value, added = packing.knapsack(lengths, prices, 20)
        for room in range(21):
            best = max(float(np.dot(code, prices)) for code in np.ndindex(*[room // n + 1 for n in lengths]) if np.dot(code, lengths) <= room)
            got = packing.contents(added, lengths.tolist(), room)
            assert np.isclose(value[room], best) and np.isclose(sum(prices[i] * k for i, k in got.items()), best) and sum(lengths[i] * k for i, k in got.items()) <= room


def test_stages_against_a_plain_version(spark):
    """Every stage on what its predecessor kept; verdicts of learned stages by their operator, all else by hand."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {r.doc_id for r in quality.quality(docs).filter("kept").collect()}
    one = docs.filter(docs.doc_id.isin(sorted(kept)))
    field = toxicity.fit(one, spark.read.parquet(f"{d}/labels.parquet"))
    clean = {r.doc_id for r in toxicity.score(one, field).filter("predicted = 0").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in clean}
    sets = {i: shingles(t) for i, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    left = {i for i, r in roots(sets, links).items() if i == r}
    three = docs.filter(docs.doc_id.isin(sorted(left)))
    final = {r.doc_id: r.text for r in pii.redact(three).collect()}
    rows = corpus_pipeline.run(spark, d).collect()
    check_packing(rows, final)
    assert not any("@mail" in t for t in final.values())


def test_stages_keep_columns_and_odd_rows(spark, odd_documents, no_documents, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "toxicity", "near_dedup", "pii", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd_documents, sf_dir)
        assert out.columns == odd_documents.columns and [f.dataType for f in out.schema] == [f.dataType for f in odd_documents.schema]
        assert out.count() <= 12
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_documents, sf_dir).count() == 0


def test_rows_on_their_way_to_packing_are_few(spark, monkeypatch):
    """A task and its worker hold a batch of some MB, whatever the texts' lengths; the session's own bound comes back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(600, numPartitions=1).selectExpr("id AS doc_id", "repeat('some words ', 4000) AS text")
    before, seen, write = spark.conf.get(key), [], packing.written

    def spied(df, name):
        seen.extend(r.n for r in docs.mapInArrow(batch_bytes, "n bigint").collect())
        return write(df, name)

    def batch_bytes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    monkeypatch.setattr(packing, "written", spied)
    assert packing.pack(docs.limit(20), public_tokenizers.path("word_bpe_49k.json")).count() >= 20
    assert sum(seen) > 20e6 and max(seen) < 5e6 and spark.conf.get(key) == before


def test_stages_bound_the_rows_on_their_way(spark, sf_dir):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50)
    try:
        for name, stage in corpus_pipeline.STAGES:
            if name in ("pii", "packing"):
                spark.conf.set(key, "64m")
                stage(spark, docs, sf_dir)
                assert int(spark.conf.get(key).rstrip("b")) <= 8 << 20, name
    finally:
        spark.conf.set(key, before)
