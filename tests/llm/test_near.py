from itertools import combinations

import numpy as np

from clusterloom.llm import near_dedup, queries, vector_dedup


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def check(rows, texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = roots(sets, links)
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_op4_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op4_near_dedup(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_chains_and_groups(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 5000, 120)]
    texts = {i: " ".join(base) for i in range(0, 40)}
    for i in range(40, 80):  # a chain that drifts away from the group, one word a step
        words = list(base)
        for j in range(i - 39):
            words[3 * j % 120] = f"x{j}"
        texts[i] = " ".join(words)
    texts |= {100: "a b c d", 101: "A b\tc D", 102: "a b c", 103: None, 104: "", 105: " "}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    check(near_dedup.near_duplicates(docs).collect(), texts)
    for how in (near_dedup.NearDedup(small_bucket=1), near_dedup.NearDedup(id_bits=32768, small_bucket=4)):
        check(near_dedup.near_duplicates(docs, how).collect(), texts)


def test_texts_of_some_ids(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(-500, 3000)] + [(None, "x"), (5, None)], "doc_id int, text string")
    asked = spark.createDataFrame([(i,) for i in range(-500, 3000, 7)] + [(None,)], "doc_id bigint")
    want = {(i, f"text {i}") for i in range(-500, 3000, 7)}
    got = {(r.doc_id, r.text) for r in near_dedup._texts_of(docs, asked, near_dedup.NearDedup()).collect()}
    assert got >= want and len(got) < len(want) + 10
    assert {(r.doc_id, r.text) for r in near_dedup._texts_of(docs, asked, near_dedup.NearDedup(id_bits=32768)).collect()} >= want
    assert near_dedup._texts_of(docs, asked.limit(0), near_dedup.NearDedup()).count() == 0


def test_sequential_test_keeps_what_reaches_the_threshold():
    how = near_dedup.NearDedup()
    limits = near_dedup.least_matches(how)
    assert len(limits) == how.tests // how.batch and list(limits) == sorted(limits)
    rng = np.random.default_rng(1)
    matches = (rng.random((20_000, how.tests)) < 0.75).reshape(20_000, -1, how.batch).sum(axis=2).cumsum(axis=1)
    assert (matches < np.array(limits)).any(axis=1).mean() < 1e-3
    matches = (rng.random((2000, how.tests)) < 0.3).reshape(2000, -1, how.batch).sum(axis=2).cumsum(axis=1)
    assert (matches < np.array(limits)).any(axis=1).mean() > 0.99


def test_odd_documents(spark, odd_documents, no_documents):
    rows = near_dedup.near_duplicates(odd_documents).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 12 and by[5].component_id == 4 and not by[5].kept and by[1].n_shingles == 0 and by[None].kept
    assert near_dedup.near_duplicates(no_documents).count() == 0
    left = near_dedup.without_near_duplicates(odd_documents)
    assert left.columns == odd_documents.columns and left.count() == 11


def check_vectors(rows, vectors):
    ids = sorted(i for i, v in vectors.items() if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and np.any(v))
    links = []
    for a, b in combinations(ids, 2):
        x, y = np.array(vectors[a], float), np.array(vectors[b], float)
        if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
            links.append((a, b))
    want = roots(vectors, links)
    for r in rows:
        assert (r.n_links, r.component_id) == (sum(r.vec_id in e for e in links), want[r.vec_id]), r


def test_op6_query(spark, sf_dir):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    rows = queries.op6_vector_dedup(spark, sf_dir).collect()
    assert len(rows) == len(vectors)
    check_vectors(rows, vectors)


def test_vector_groups(spark):
    rng = np.random.default_rng(5)
    vectors = {i: rng.normal(size=16).tolist() for i in range(60)}
    centre = rng.normal(size=16)
    vectors |= {100 + i: (centre + 0.05 * rng.normal(size=16)).tolist() for i in range(150)}  # tight
    wide = rng.normal(size=16)
    vectors |= {300 + i: (wide + 0.35 * rng.normal(size=16)).tolist() for i in range(150)}  # not all linked
    vectors |= {500: vectors[0], 501: [2 * x for x in vectors[0]], 502: None, 503: [], 504: [0.0] * 16, 505: [float("nan")] * 16, 506: [None] * 16, 507: [1.0, 2.0]}
    rows = spark.createDataFrame([(i, v, "x") for i, v in vectors.items()], "vec_id bigint, embedding array<double>, component_id string")
    out = vector_dedup.near_duplicate_vectors(rows, vector_dedup.Descent(block=32)).collect()
    assert len(out) == len(vectors)
    check_vectors(out, vectors)


def test_bridged_groups_are_one_component(spark):
    rng = np.random.default_rng(9)
    axes = np.eye(64)
    tilt = np.arccos(0.94)
    middles = [axes[0], np.cos(tilt) * axes[0] + np.sin(tilt) * axes[1]]
    vectors = {}
    for group, middle in enumerate(middles):  # cosine 0.97 inside a group, about 0.91 between: no list of 8 holds a bridge
        for i in range(60):
            noise = rng.normal(size=62)
            vectors[100 * group + i] = (middle + 0.176 * np.concatenate([[0, 0], noise / np.linalg.norm(noise)])).tolist()
    vectors |= {500 + i: rng.normal(size=64).tolist() for i in range(40)}
    rows = spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<double>")
    out = vector_dedup.near_duplicate_vectors(rows, vector_dedup.Descent(block=16, pack=4, parts=2)).collect()
    check_vectors(out, vectors)
    assert {r.component_id for r in out if r.vec_id < 200} == {0}


def test_two_tight_groups_of_any_size(spark):
    rng = np.random.default_rng(21)
    vectors = {}
    for at, size in ((0, 12), (1000, 40)):
        middle = rng.normal(size=48)
        middle /= np.linalg.norm(middle)
        side = rng.normal(size=48)
        side -= middle * (side @ middle)
        side /= np.linalg.norm(side)
        for group in (0, 1):
            centre = np.cos(0.3 * group) * middle + np.sin(0.3 * group) * side  # cosine 0.955 between the centres
            for i in range(size):
                noise = rng.normal(size=48)
                vectors[at + 100 * group + i] = (centre + 0.04 * noise / np.linalg.norm(noise)).tolist()
    rows = spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<double>")
    out = {r.vec_id: r for r in vector_dedup.near_duplicate_vectors(rows).collect()}
    assert {r.n_links for i, r in out.items() if i < 1000} == {23} and {r.n_links for i, r in out.items() if i >= 1000} == {79}
    assert {r.component_id for r in out.values()} == {0, 1000}


def test_a_search_that_fails_its_audit_ends_in_a_whole_comparison(spark):
    rng = np.random.default_rng(11)
    vectors = {i: v.tolist() for i, v in enumerate(rng.normal(size=(300, 32)))}
    vectors |= {1000 + i: (np.array(vectors[i]) + 0.3 * rng.normal(size=32)).tolist() for i in range(300)}
    rows = spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<double>")
    how = vector_dedup.Descent(orders=1, reach=2, rounds=0, attempts=1, pack=64, parts=3)
    check_vectors(vector_dedup.near_duplicate_vectors(rows, how).collect(), vectors)


def test_no_vectors(spark):
    rows = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert vector_dedup.near_duplicate_vectors(rows).count() == 0
    one = spark.createDataFrame([(1, [1.0]), (1, [1.0]), (None, [1.0])], "vec_id bigint, embedding array<float>")
    assert sorted((r.vec_id or 0, r.n_links, r.kept) for r in vector_dedup.near_duplicate_vectors(one).collect()) == [(0, 0, True), (1, 0, True), (1, 0, True)]


def test_a_vector_with_very_many_copies(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(1500)] + [(1500, [0.99, 0.05, 0.0]), (1501, [0.0, 1.0, 0.0]), (1502, [0.0, 1.0, 0.0]), (1503, [0.0, 0.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert got == {i: (1500, 0, i == 0) for i in range(1501)} | {1501: (1, 1501, True), 1502: (1, 1501, False), 1503: (0, 1503, True)}
