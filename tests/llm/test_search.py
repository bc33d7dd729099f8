import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clusterloom.llm import lexical_search, queries

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERMS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(documents, items, k):
    """Every document scored for every item."""
    docs = [(i, Counter(terms(t))) for i, t in documents if terms(t)]
    if not docs:
        return []
    total, length, df = len(docs), sum(sum(c.values()) for _, c in docs), Counter(t for _, c in docs for t in c)
    weight = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item in dict.fromkeys(i for i, _ in items):
        asked = Counter(t for text in dict.fromkeys(t for i, t in items if i == item) for t in terms(text))
        scores = []
        for i, c in docs:
            m = 75 + 25 * sum(c.values()) * total // length
            score = sum(n * weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, n in asked.items() if t in c)
            if score:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def found(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def expected(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


@pytest.mark.parametrize("at_once", [lexical_search.TERMS_AT_ONCE, 200])
def test_against_every_document(spark, sf_dir, at_once):
    documents, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = found(lexical_search.search(documents, items, 20, at_once))
    assert got == expected(plain([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in items.collect()], 20))


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(f"SELECT item_id, rank, doc_id, score FROM ({queries.ORACLE_SQL['op11_search']})").fetchall()
    assert found(queries.op11_search(spark, sf_dir)) == expected(want)


def test_odd_rows(spark, odd_documents, no_documents):
    rows = [(1, "One TWO"), (1, "One TWO"), (1, "café four"), (2, None), (3, "absent-words-only"), (None, "mit license"), (4, "one one one the word")]
    items = spark.createDataFrame(rows, "item_id bigint, text string").withColumns({"score": F.lit("mine"), "rank": F.lit(0), "n": F.lit(1)})
    documents = [(r.doc_id, r.text) for r in odd_documents.collect()]
    for k in (1, 2, 20):
        assert found(lexical_search.search(odd_documents, items, k)) == expected(plain(documents, rows, k))
    assert lexical_search.search(no_documents, items).count() == 0
    assert lexical_search.search(odd_documents, items.limit(0)).count() == 0


def test_many_copies_and_ties(spark):
    rows = [(i, "alpha beta gamma" if i % 3 else f"alpha w{i}") for i in range(300)] + [(i, "beta") for i in range(50)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    items = [(1, "alpha beta"), (2, "gamma w3 w6"), (3, "beta")]
    assert found(lexical_search.search(documents, spark.createDataFrame(items, "item_id int, text string"), 20)) == expected(plain(rows, items, 20))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 8), st.integers(1, 5)), max_size=6, unique_by=lambda x: x[0]), min_size=1, max_size=40), st.integers(1, 5))
def test_limited_accumulators_lose_nothing(docs, k):
    """A block's best are those of all its scores, whatever is known before."""
    docs = [sorted(d) for d in docs]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([sum(n for _, n in d) + 3 for d in docs], pa.int64()), pa.array([[t for t, _ in d] for d in docs], pa.list_(pa.int32())), pa.array([[n for _, n in d] for d in docs], pa.list_(pa.int64()))],
        names=["n", "terms", "tfs"],
    )
    block = lexical_search.Block(batch, len(docs), 1 + sum(n for d in docs for _, n in d))
    asked = [(t, 1 + (t * 37) % 11) for t in range(9)]
    whole = np.zeros(len(docs), dtype=np.int64)
    for t, w in asked:
        if t in block.at:
            start, stop, _ = block.at[t]
            whole[block.rows[start:stop]] += w * block.impacts[start:stop]
    least = lexical_search.kth_largest(whole, k)
    for known in (0, least):
        rows, scores = block.best(asked, k, known)
        assert rows.tolist() == np.flatnonzero(whole >= max(1, least)).tolist() and scores.tolist() == whole[rows].tolist()
