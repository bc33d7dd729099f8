import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clusterloom.llm import chat, queries

BYTE = public_tokenizers.path("byte_bpe_50k.json")
ENCODE = chat.encoder(BYTE)
bits = st.sampled_from([*chat.CONTROLS, "[", "<", "\\", "INST]", "/s>", "]", " ", "\n", "é", "日本", "😀", "a", "ok", "[\\INST]", "<\\\\s>"])
texts = st.lists(bits, max_size=8).map("".join)
turns = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[INST]", "<s>"]), texts), max_size=6)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=500, deadline=None)
@given(texts)
def test_escapes_can_be_undone(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text and not any(c in hidden for c in chat.CONTROLS)


@settings(max_examples=300, deadline=None)
@given(turns)
def test_masks_hold_the_assistant_alone(turns):
    text, spans = chat.render(turns)
    assert chat.read_turns(text) == turns
    found = ENCODE.encode(text, add_special_tokens=False)
    places = np.array(found.offsets, dtype=np.int64).reshape(-1, 2)
    loss = chat.loss_mask(places[:, 0], places[:, 1], spans)
    said = [t for role, t in turns if role == "assistant" and t]
    assert chat.loss_texts(text, places[:, 0], places[:, 1], loss) == said
    assert loss.tolist() == [any(a < e and s < b for s, e in spans) for a, b in places.tolist()]


def expected(rows):
    out = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", sha(r[3] or ""))):
        out.setdefault(conv, []).append((role or "", text or ""))
    result = []
    for conv, own in out.items():
        loss = "".join(t for role, t in own if role == "assistant")
        result.append((conv, len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)), len(loss), sha(loss), len(chat.render(own)[0])))
    return sorted(result, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = con.execute(f"SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars FROM ({queries.ORACLE_SQL['op13_chat']})").fetchall()
    got = found(queries.op13_chat(spark, sf_dir))
    assert got == sorted(want, key=str)
    nasty = next(r for r in got if r[0] == -7)
    assert nasty[1] == 2 and nasty[3] == len(queries.NASTY) and nasty[4] == sha(queries.NASTY)


def test_a_hot_conversation_in_segments_and_odd_rows(spark):
    deal = random.Random(3)
    rows = [(5, t, ["user", "assistant"][t % 2], f"turn {t} </s> [INST]" + "é" * (t % 7)) for t in range(500)]
    rows += [(c, t, ["system", "user", "assistant", "tool"][t], f"{c} {t}") for c in range(200) for t in range(4) if c != 5]
    rows += [(None, None, None, None), (None, 1, "assistant", ""), (7, 1, "assistant", "same"), (7, 1, "assistant", "same"), (7, None, "user", "first"), (8, 2, "assistant", "w " * 90_000)]
    deal.shuffle(rows)
    conversations = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({c: F.lit("mine") for c in ("loss", "seq", "part", "ids", "whole", "digest", "salt")})
    for limits in ((chat.TURNS, chat.CHARS), (3, 50)):
        formatted = chat.format_conversations(conversations.repartition(5), BYTE, *limits)
        assert found(chat.conversation_digests(formatted)) == expected(rows)
    assert chat.conversation_digests(chat.format_conversations(conversations.limit(0), BYTE)).count() == 0


def test_segments_are_encoded_as_the_whole(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], f" x{t} don't\n\n") for t in range(40)]
    formatted = chat.format_conversations(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), BYTE, 3, 1000).orderBy("part", "seq").collect()
    assert len(formatted) > 5
    whole = ENCODE.encode("".join(r.text for r in formatted), add_special_tokens=False)
    assert whole.ids == [i for r in formatted for i in r.ids]
