import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clusterloom.llm import collocations, queries


def plain(documents, least, longest, first):
    """All phrases counted, all cuts scored, all longer candidates asked."""
    n, f = Counter(), Counter()
    for lang, text in documents:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    inside = {(lang, p[i : i + k]) for (lang, p), a in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 100 * candidates[lang, p[i : i + k]]}
    rows = []
    for (lang, p), a in candidates.items():
        if (lang, p) not in inside:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    out = []
    for lang in n:
        own = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(lang, rank, *r[1:]) for rank, r in enumerate(own[:first], 1)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.collect()))


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    columns = "lang, rank, phrase, a, l, r, n, score"
    assert found(queries.op12_collocations(spark, sf_dir)) == sorted(con.execute(f"SELECT {columns} FROM ({queries.ORACLE_SQL['op12_collocations']})").fetchall())
    # Rarer phrases: enough for all lengths, and for cuts of the list.
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = con.execute(f"SELECT {columns} FROM ({collocations.oracle(4, 5, 100)})").fetchall()
    assert found(collocations.collocations(documents, 4, 5, 100)) == sorted(want) and max(r[1] for r in want) == 100


@pytest.mark.parametrize(("bits", "levels"), [(collocations.BITS, 3), (1 << 15, 2), (64, 5), (1 << 20, 1)])
def test_against_all_phrases(spark, sf_dir, bits, levels):
    """Also with tables of bits in which everything collides."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.lang, r.text) for r in documents.collect()]
    assert found(collocations.collocations(documents, 5, 4, 50, bits, levels)) == plain(rows, 5, 4, 50)


def test_odd_rows(spark, odd_documents, no_documents):
    rows = [(r.lang, r.text) for r in odd_documents.collect()]
    assert found(collocations.collocations(odd_documents, 2)) == plain(rows, 2, 5, 2000)
    assert found(collocations.collocations(odd_documents, 1, 3, 10)) == plain(rows, 1, 3, 10)
    assert collocations.collocations(no_documents).count() == 0


def test_corrections_and_unary_paths(spark):
    texts = ["a b c d e f g. a b c; a b, a\tb  c d e", "x\x1cy z x\x1cy z", "Ünï CODE ünï code", "p q p q p q p q"] * 7 + ["a b c d e f"]
    documents = spark.createDataFrame([(t, lang) for t in texts for lang in ("en", None)], "text string, lang string")
    assert found(collocations.collocations(documents, 7)) == plain([(r.lang, r.text) for r in documents.collect()], 7, 5, 2000)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**63), min_size=1, max_size=30), st.integers(3, 12))
def test_bits_tell_what_was_put_in(hashes, power):
    table, size = np.zeros(1 << (power - 3), dtype=np.uint8), 1 << power
    for h in hashes:
        table[(h % size) >> 3] |= 1 << (h % size & 7)
    assert collocations.has(table, np.array(hashes, dtype=np.uint64)).all()


def test_splits_share_the_tasks_that_add_up_runs(spark):
    """Rows that tasks hand on are runs times tasks; more splits of the same words make no more of them."""
    cores = spark.sparkContext.defaultParallelism
    # Splits with the same words each, as all tasks of a large corpus meet its frequent phrases.
    many = spark.range(0, 6 * cores * 4, 1, 6 * cores).selectExpr("'en' AS lang", "'a b c d e f g h' AS text")
    tables = [collocations.told(collocations.hashed(collocations.word_counts(many)), 1)]
    n = 8 * many.count()
    handed = collocations.task_runs(collocations.gathered(many, n), tables, 5).collect()
    assert len(handed) == 7 * cores and sum(r.n for r in handed) == 7 * many.count()
    # Enough words for a task each: splits stay as they are.
    assert collocations.task_runs(collocations.gathered(many, n, 8), tables, 5).count() == 7 * 6 * cores
    assert found(collocations.collocations(many, 2)) == plain([("en", r.text) for r in many.collect()], 2, 5, 2000)
