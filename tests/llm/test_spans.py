import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from clusterloom.llm import pii, queries, secrets


def plain_pii(t):
    out = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[ -]", "", m[0])
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), "card", m.end()))
    return out + [(m.start(), "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def plain_secrets(t):
    found = re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A)
    out = [(m.start(), "assign", m.end()) for m in found if len(m[2]) >= 8]
    out += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return out + [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda s: s[0])).encode()).hexdigest()


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from(list("ab.@-+1 2()3.4.@%_A0")), max_size=40))
def test_base_personal_data(text):
    assert pii.base_spans(text) == plain_pii(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["password", "Token", "api", "_", "KEY", "=", ":", " ", "'", "AKIA", "abcdef12", "ZZ", "0123456789abcdef", "\n", "ſ"]), max_size=16).map("".join))
def test_base_secrets(text):
    assert secrets.base_spans(text) == plain_secrets(text)


def test_op1_query(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op1_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_pii(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for _, k, _ in base) for kind in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == digest(base)
        assert {f"{k}:{a}:{b}" for a, k, b in base} <= set(filter(None, r.spans.split(",")))


def test_op3_query(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op3_secrets(spark, sf_dir).collect():
        base = plain_secrets(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for _, k, _ in base) for kind in ("assign", "access", "hex"))
        assert r.base_sha256 == digest(base)
        assert {f"{k}:{a}:{b}" for a, k, b in base} <= set(filter(None, r.spans.split(",")))


def test_bootstrapping_finds_unseen_identifiers(spark):
    seeds = [(i, f"your reach me {i}: contact ip 10.0.{i}.7 today") for i in range(40)]
    rows = [*seeds, (100, "contact ip gateway-7731x now"), (101, "nothing here 4711x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert pii.learned_patterns(docs) == ["contact ip"]
    found = {r.doc_id: r.spans for r in pii.find_personal_data(docs).collect()}
    assert found[100] == "context:11:24" and found[101] == ""
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[100] == "contact ip [CONTEXT] now" and clean[0] == "your reach me 0: contact ip [IP] today"


def test_contexts_that_seeds_rarely_follow_are_no_patterns(spark):
    rows = [(i, f"and of the 10.0.{i}.7 x") for i in range(10)] + [(100 + i, "words and of the house " * 5) for i in range(10)]
    assert pii.learned_patterns(spark.createDataFrame(rows, "doc_id bigint, text string")) == []


def test_a_pattern_is_no_witness_for_itself(spark):
    # Four of ten times a telephone number, else a year: years follow no other pattern, so they are none of its finds.
    rows = [(i, f"you may reach in +1 555 010 {1000 + i} the office") for i in range(40)] + [(100 + i, f"we hope to reach in {1950 + i} the goal") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert pii.seed_patterns(docs) == ["reach in"] and pii.learned_patterns(docs) == []
    assert all("[CONTEXT]" not in r.text for r in pii.redact(docs).collect())
    # Numbers that two other contexts of seeds vouch for lift a pattern over the threshold.
    rows = [(i, f"{before} 10.1.{i}.7 x") for before in ("call from", "login at") for i in range(20)]
    rows += [(200 + i, f"{before} user-77{i:02d} x") for i in range(4) for before in ("call from", "login at")]
    rows += [(300 + i, f"seen on 10.2.{i}.7 x") for i in range(5)] + [(400 + i, f"seen on user-77{i:02d} x") for i in range(4)]
    assert pii.learned_patterns(spark.createDataFrame(rows, "doc_id bigint, text string")) == ["call from", "login at", "seen on"]


def test_support_is_of_different_seeds_in_different_documents(spark):
    one = [(1, "write to 10.0.0.7 " * 9)]  # a document that repeats itself
    copies = [(10 + i, "write to 10.0.0.7 now") for i in range(9)]
    apart = [(30 + i, f"write to 10.0.0.{i} now") for i in range(3)]
    many = [(50, " ".join(f"write to 10.0.1.{i}" for i in range(9)))]  # one document alone
    for rows, want in ((one, []), (copies, []), (many, []), (apart, ["write to"])):
        assert pii.seed_patterns(spark.createDataFrame(rows, "doc_id bigint, text string")) == want


def plain_scores(graph, rounds):
    """Scores by the definition, pattern by pattern."""
    everything, own = {}, {}
    for p, i, seed, n in graph:
        everything.setdefault(p, []).append((n, i is not None))
        if i is not None:
            m, s = own.setdefault(p, {}).get(i, (0, False))
            own[p][i] = (m + n, s or seed)
    size = {p: max(sum(n for n, _ in v), sum(n for n, is_one in v if is_one)) for p, v in everything.items()}
    trust = {(p, i): float(s) for p in own for i, (_, s) in own[p].items()}
    for _ in range(rounds):
        score = {p: sum(n * trust[p, i] for i, (n, _) in own[p].items()) / size[p] for p in own}
        for p, i in trust:
            wrong = 1.0
            for q in own:
                if q != p and i in own[q]:
                    wrong *= 1 - min(score[q], 0.999)
            trust[p, i] = 1.0 if own[p][i][1] else 1 - wrong
    return score


def test_scores_are_those_of_the_definition(spark):
    import random

    draw = random.Random(5)
    graph = [(f"p{p}", f"i{i}", s, draw.randint(1, 4)) for p in range(12) for i in range(15) for s in (True, False) if draw.random() < 0.2]
    graph += [(f"p{p}", None, False, draw.randint(0, 6)) for p in range(12)]
    got = {r.pattern: r.score for r in pii.pattern_scores(spark.createDataFrame(graph, "pattern string, instance string, seed boolean, n bigint")).collect()}
    want = plain_scores(graph, 3)
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_contexts_glued_to_their_identifiers(spark):
    rows = [(i, f"please write to <user{i}@mail.example> soon") for i in range(5)]
    rows += [(10 + i, f"this is version v10.0.{i}.7 of it") for i in range(5)] + [(20 + i, f"you may call tel:+49 171 23456{i}0 today") for i in range(5)]
    rows += [(30, "a version vector and version v22")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert pii.learned_patterns(docs) == ["call tel:", "to <", "version v"]
    # A glued context that mostly other words follow is not trusted, also where it stands spaced.
    rows = [(i, f"please write to <user{i}@mail.example> soon") for i in range(5)] + [(100 + i, "go to <html> and to < body") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert pii.learned_patterns(docs) == []
    total = {r.pattern: r.n for r in pii.pattern_graph(docs, ["to <"]).groupBy("pattern").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert total == {"to <": 45}


def test_identifiers_in_groups_are_found_whole(spark):
    texts = {
        100: ("contact ip 0171 234 5678 now", "contact ip [CONTEXT] now"), 101: ("contact ip 1234 5678 9012 3456", "contact ip [CONTEXT]"),
        102: ("contact ip (0171) 234-56.78. Then 12", "contact ip [CONTEXT]. Then 12"), 103: ("contact ip 12 34 56, 78 x", "contact ip [CONTEXT], 78 x"),
        104: ("contact ip 4711 10.0.0.1 now", "contact ip [CONTEXT] [IP] now"), 105: ("contact ip 4711 3rd door", "contact ip [CONTEXT] 3rd door"),
    }
    rows = [(i, f"your reach me {i}: contact ip 10.0.{i}.7 today") for i in range(40)] + [(i, t) for i, (t, _) in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert {i: clean[i] for i in texts} == {i: want for i, (_, want) in texts.items()}
    found = {r.doc_id: r.spans for r in pii.find_personal_data(docs).collect()}
    assert found[100] == "context:11:24" and found[101] == "context:11:30"


def test_constants_are_propagated():
    literal = lambda t: [t[a:b] for a, _, b in secrets.literal_spans(t)]
    assert literal('API_SECRET = "abcd1234efgh"\nx = API_SECRET') == ["abcd1234efgh"]
    assert literal('A = "q8Zr7Tk2Lm9P"\nB = A\nsigning_secret = B') == ["q8Zr7Tk2Lm9P"]
    assert literal("client_secret = A + B") == []
    assert literal('A="part1x"; B="9f8e7d"; client_secret = A + B') == ["part1x", "9f8e7d"]
    assert literal('title = "q8Zr7Tk2Lm9P"\npassword = "changeme"') == []


def test_literals_of_any_length_and_kind():
    literal = lambda t: [t[a:b] for a, _, b in secrets.literal_spans(t)]
    long = "a1+Bq7Zr" * 2000
    assert literal(f'private_key = "{long}"') == [long]
    assert literal('x = "no end\npassphrase = "q8Zr7Tk2Lm9P"') == ["q8Zr7Tk2Lm9P"]
    assert literal('signing_key = """\nMIIEq8Zr7Tk2Lm9P\nq8Zr7Tk2\n"""') == ["\nMIIEq8Zr7Tk2Lm9P\nq8Zr7Tk2\n"]
    assert literal("don't set pwd = Xk29fjq8zT when it's late") == ["Xk29fjq8zT"]
    assert literal("GET https://host/x pwd=Xk29fjq8zT") == ["Xk29fjq8zT"]
    assert literal("ticket #12: signing_key = Xk29fjq8zTa4") == ["Xk29fjq8zTa4"]
    assert literal("# old: client_secret = 'Xk29fjq8zTa4'") == ["Xk29fjq8zTa4"]
    assert literal("api_key = b'Xk29fjq8zTa4'") == ["Xk29fjq8zTa4"]
    chain = 'A0 = "q8Zr7Tk2Lm9P"\n' + "\n".join(f"A{i + 1} = A{i}" for i in range(50)) + "\nsecret_key = A50"
    assert literal(chain) == ["q8Zr7Tk2Lm9P"]
    doubled = 'x = "q8Zr7Tk2"\n' + "x = x + x\n" * 200 + "access_key = x"
    assert literal(doubled) == ["q8Zr7Tk2"]
    assert literal('password = "' + "x" * 500 + '"') == [] and literal('password = "<' + "ab1" * 100 + '>"') == []


def test_forms_of_assignments():
    literal = lambda t: [t[a:b] for a, _, b in secrets.literal_spans(t)]
    one = "Xk29fjq8zTa4"
    for text in (
        f'config["client_secret"] = "{one}"',
        f'client_secret: str = "{one}"',
        f'client_secret: Optional[dict[str, int]] = "{one}"',
        f'A = "{one}"\nclient_credential = (A)',
        f'client_secret = (\n  "{one}"\n)',
        f'passphrase = os.getenv("P") or "{one}"',
        f'passphrase = process.env.P || "{one}"',
        f'passphrase = load(a, b, [c], d({", ".join("x" * 60)})) or "{one}"',
        f'passphrase = None if test else "{one}"',
        f'os.environ.setdefault("client_secret", "{one}")',
        f'A = "{one}"\nput("client_secret", A)',
        f'c["k"] = "{one}"\nclient_secret = c["k"]',
        f'client_secret: {one}=\n',
        f'signing_secret: {one}',
    ):
        assert literal(text) == [one], text
    assert literal('A = "Xk29"\nclient_secret = f"{A}fjq8zTa4"') == ["Xk29", "fjq8zTa4"]
    assert literal('client_secret = ("Xk29fjq8"\n  "zTa4Qp7L")') == ["Xk29fjq8", "zTa4Qp7L"]
    assert literal(f'passphrase = "{one}" if x else "{one[::-1]}"') == [one, one[::-1]]
    assert literal('encryption_key = "Xk29fjq8zTa4Qp7Lm2Zz"') == ["Xk29fjq8zTa4Qp7Lm2Zz"]
    assert literal('authorization = "Xk29fjq8zTa4Qp7Lm2Zz"') == ["Xk29fjq8zTa4Qp7Lm2Zz"]
    for text in ('author = "Xk29fjq8zTa4Qp7Lm2Zz"', 'keyword = "Xk29fjq8zTa4Qp7Lm2Zz"', 'pk: key = value', 'passphrase = read("Xk29fjq8zTa4")', "the key: a word or 'two' of it"):
        assert literal(text) == [], text


def plain_pairs(text):
    """One assignment a line: ``name = operand + operand ...``, operands quoted literals or earlier names."""
    import re

    constants, out = {}, []
    for line in text.split("\n"):
        name, _, value = line.partition(" = ")
        values = [constants.get(v) if v[0] != '"' else v[1:-1] for v in value.split(" + ")]
        if all(v is not None for v in values):
            constants[name] = "".join(values)
            out.append((name, constants[name]))
    return [(n, v) for n, v in out if re.search("secret|token|password", n)]


def test_random_constants_are_those_of_a_plain_reading():
    rng = random.Random(4)
    for _ in range(300):
        names, lines = ["a", "b", "db_token", "client_secret", "user_password"], []
        for _ in range(rng.randint(1, 12)):
            operands = [rng.choice(names) if rng.random() < 0.5 else '"' + "".join(rng.choices("abXY12", k=rng.randint(0, 9))) + '"' for _ in range(rng.randint(1, 3))]
            lines.append(f"{rng.choice(names)} = {' + '.join(operands)}")
        text = "\n".join(lines)
        got = [(n, v) for n, v in secrets.pairs(text) if n not in ("a", "b")]
        want = plain_pairs(text)
        assert [(n, v.size, v.head) for n, v in got] == [(n, len(v), v[:64]) for n, v in want], text


def test_lexing_costs_in_proportion():
    import time

    for text in ('secret = "' + '\\"' * 200_000, 'secret = """' + '"' * 200_001 + " x", 'token: "a' * 60_000, 'token = (' * 100_000, 'token = a if ' * 60_000, 'token = f(x) or ' * 60_000):
        began = time.perf_counter()
        secrets.literal_spans(text)
        assert time.perf_counter() - began < 20


def test_odd_documents(spark, odd_documents, no_documents):
    rows = {(r.doc_id, r.spans) for r in pii.find_personal_data(odd_documents).collect()}
    assert (1, "") in rows and (2, "") in rows
    assert any(i == 6 and s.count(":") == 8 for i, s in rows)
    assert pii.find_personal_data(no_documents).count() == secrets.find_secrets(no_documents).count() == 0
    assert secrets.find_secrets(odd_documents).count() == 12
    clean = pii.redact(odd_documents)
    assert clean.columns == odd_documents.columns
    assert clean.filter("doc_id = 1").first().text is None and clean.filter("score <> 'mine'").count() == 0
