import hashlib

import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clusterloom.llm import bpe_automaton, fragments, queries, token_counts
from clusterloom.llm.packing import WordEncoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LIBRARY, WORDS = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
TEXTS = ["", " ", "   a  b", "a\n \n b ", "don't 'VE'll", "x<|endoftext|> y", "日本語 😀👩‍👩 ١٢ ½", "ab" * 400, "౜꟏ z", "\x1c a\x85b\xa0c"]
chars = st.text(st.sampled_from(list("abtheAN .,'\n\t  0189<|>é日😀̀")), max_size=40)


def encode(text):
    return bpe_automaton.TextEncoder(BYTE)(text).tolist()


def test_automaton_on_given_texts():
    for text in TEXTS:
        ids = encode(text)
        assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
        assert bpe_automaton.automaton(BYTE).decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(chars)
def test_automaton_on_any_text(text):
    assert encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(chars)
def test_word_encoder_on_any_text(text):
    ids = WORDS.encode(text, add_special_tokens=False).ids
    encode = WordEncoder(WORD)
    assert list(memoryview(encode.alone(text)).cast("I")) == ids
    assert [list(memoryview(x).cast("I")) for x in encode(pa.array(["", text, text + " x"]))][:2] == [[], ids]


def test_one_path_a_token():
    machine = bpe_automaton.automaton(BYTE)
    some = [i for i in range(0, 50_000, 97)]
    for i in some:
        text = machine.label[i].decode("utf-8", "replace")
        if "\ufffd" not in text and len(LIBRARY.pre_tokenizer.pre_tokenize_str(text)) == 1:
            assert machine.encode_piece(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def check_bpe(rows, texts):
    for r in rows:
        text = texts(r)
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op10_query(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op10_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    check_bpe(rows, lambda r: texts[r.doc_id])


def test_op2_query(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op2_token_counts(spark, sf_dir).collect():
        n = len(LIBRARY.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


def test_odd_documents(spark, odd_documents, no_documents):
    own = odd_documents.filter("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text or "" for r in own.select("doc_id", "text").collect()}
    check_bpe(bpe_automaton.encode_digests(own, BYTE).collect(), lambda r: texts[r.doc_id])
    for r in token_counts.token_counts(own, BYTE).collect():
        assert r.n_tokens == len(LIBRARY.encode(texts[r.doc_id], add_special_tokens=False).ids)
    assert token_counts.token_counts(odd_documents, BYTE).count() == 12
    assert token_counts.token_counts(no_documents, BYTE).count() == 0
    assert bpe_automaton.encode_digests(no_documents, BYTE).count() == 0


def test_frequent_table_changes_no_count(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, BYTE, frequent=[]).collect()}
    b = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, BYTE).collect()}
    assert a == b


def test_a_table_that_starts_anew_gives_the_same_ids(monkeypatch):
    text = "the quick brown " + "Überraschungen zusammengesetzter Wörter " * 3 + "ab" * 300
    machine = bpe_automaton.Automaton(BYTE)
    pieces = [text[a:b] for _, (a, b) in LIBRARY.pre_tokenizer.pre_tokenize_str(text)]
    ids, n = machine.encode_pieces(pieces)
    assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids and n.sum() == len(ids) and len(n) == len(pieces)
    monkeypatch.setattr(bpe_automaton, "STATES", 10)
    monkeypatch.setattr(bpe_automaton, "PIECES", 3)
    monkeypatch.setattr(bpe_automaton, "FEW", 0)
    again, _ = machine.encode_pieces(pieces)
    assert again.tolist() == ids.tolist()


def test_small_slices_and_caches_change_nothing(spark, monkeypatch, sf_dir):
    monkeypatch.setattr(fragments, "SLICE_BYTES", 500)
    texts = ["".join(t) for t in TEXTS] + ["two  spaces here", "x y\n", " lead", "plain words of a text, again; and again."] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    seen = [t for _, column in fragments.slices(batch) for t in column.to_pylist()]
    assert seen == texts
    remembered = fragments.Remembered(lambda keys: [len(k) for k in keys], limit=2000)
    for at in range(0, 200, 10):
        keys = [f"k{i}" for i in range(at, at + 20)]
        assert remembered(keys) == [len(k) for k in keys]


def test_ids_round_trip(spark):
    docs = spark.createDataFrame([(1, "Hello <|endoftext|> wörld  x"), (2, "")], "doc_id bigint, text string")
    back = bpe_automaton.decode(bpe_automaton.encode(docs, BYTE), BYTE, text="again").collect()
    assert all(r.text == r.again for r in back)


def test_plain_words_are_packed_side_by_side_and_not_remembered():
    # Remembering them one by one took most of the time; there are more different words than a worker can remember.
    packed = WordEncoder(WORD)
    texts = ["Some plain words, and. more", "", " ", "Word word WORD!", "naïve 12 it's x-y, Σας", "two\nlines  apart", "a" * 300 + ";", "!", ".,"]
    asked = []
    remembered = packed.remembered
    packed.remembered = lambda chunks: asked.extend(chunks) or remembered(chunks)
    want = [b"".join(i.to_bytes(4, "little") for i in WORDS.encode(t, add_special_tokens=False).ids) for t in texts]
    assert packed(pa.array(texts)) == want
    assert sorted(asked) == sorted({"", "naïve", "12", "it's", "x-y,", "Σας", "!", ".,"})
    assert packed(pa.array(texts[:1])) == want[:1] and packed(pa.array([""])) == [b""] and packed(pa.array(["12"])) == [packed.alone("12")]
    assert packed(pa.array(texts)[3:5]) == want[3:5]


def test_more_pieces_than_are_read_at_once(monkeypatch):
    machine = bpe_automaton.automaton(BYTE)
    words = [" some", "plain,", "words.", " a", "x?"] * 3
    one = [machine.encode_pieces([p for p in (w.rstrip(".,?"), w[len(w.rstrip(".,?")) :]) if p])[0].tolist() for w in words]
    for size in (200_000, 4, 1):
        monkeypatch.setattr(bpe_automaton, "PIECES", size)
        ids, n = machine.encode_plain(pa.array(words))
        assert ids.tolist() == sum(one, []) and n.tolist() == list(map(len, one))


def test_fragments_are_split_once_a_task(monkeypatch):
    # Every slice split its fragments anew.
    class Task:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            self.run = run
            raise StopIteration

    task, asked = Task(), []
    try:
        token_counts.frequent_pre_tokens(task, BYTE, size=3)
    except StopIteration:
        pass
    of_fragment = bpe_automaton.Splitter.of_fragment
    monkeypatch.setattr(bpe_automaton.Splitter, "of_fragment", lambda self, f: asked.append(f) or of_fragment(self, f))
    batch = pa.RecordBatch.from_arrays([pa.array(["b a, a, c", None, " a, a 12x"])], names=["text"])
    (out,) = task.run(iter([batch, batch]))
    assert sorted(asked) == sorted(set(asked))
    assert out.to_pylist() == [{"pre": " a", "n": 8}, {"pre": ",", "n": 6}, {"pre": " 12", "n": 2}]
