r"""Operator 13: conversations formatted for training, with loss masks aligned by offsets.

The template puts control strings around each turn: ``[SYS]..[/SYS]``, ``[INST]..[/INST]`` and ``<s>..</s>`` for system,
user and assistant, ``[ROLE]role[TEXT]..[/TEXT]`` for any other role. A control string inside a text or role gets a
backslash after its first character, one with backslashes there gets one more, so escaping can be undone and no text
can end a turn or begin one.

A conversation is rendered as a whole and encoded once, control strings being tokens of their own; a token bears loss if
its span, found by binary search among the sorted spans of the assistant's texts, meets one of them. As control strings
always end a token, encoding the segments of a long conversation (``TURNS`` turns or ``CHARS`` code points) gives what
encoding the whole gives; so no conversation has to fit into a task's memory, and a hot one is dealt over many tasks.

Odd rows: a null text is empty, a null role is the empty role. Rows come by turn, nulls first, then by role and by the
text's SHA-256; repeated rows are turns of their own. A null conv_id is a conversation. Without rows there is no result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Control strings of roles, then of the role and text of any other, then the vocabulary's own.
ROLES = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
ROLE, TEXT, END, OWN = "[ROLE]", "[TEXT]", "[/TEXT]", "<|endoftext|>"
CONTROLS = [c for pair in ROLES.values() for c in pair] + [ROLE, TEXT, END, OWN]
#: A control string's first character occurs nowhere else in it or in the rest of another, so matches never overlap.
HIDDEN = "|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in CONTROLS)
#: Turns and code points at which a segment of a conversation ends; code points that are encoded at a time.
TURNS, CHARS, AT_ONCE = 64, 1 << 16, 1 << 20

_CONTROL, _HIDDEN = re.compile("(" + "|".join(map(re.escape, CONTROLS)) + ")"), re.compile(HIDDEN)
_SEGMENT = "part int, seq bigint, whole boolean, text string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"
_READ = "part int, seq bigint, n_turns bigint, formatted_chars bigint, loss_chars bigint, turns string, loss string, turns_sha256 string, loss_sha256 string"
_DIGEST = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def escape(text: str) -> str:
    return _HIDDEN.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _HIDDEN.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of (role, text) turns, and where the assistant's texts lie in it."""
    out, at, spans = [], 0, []
    for role, text in turns:
        begin, end = ROLES.get(role) or (f"{ROLE}{escape(role)}{TEXT}", END)
        shown = escape(text)
        if role == "assistant":
            spans.append((at + len(begin), at + len(begin) + len(shown)))
        out += begin, shown, end
        at += len(begin) + len(shown) + len(end)
    return "".join(out), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    of_begin = {begin: role for role, (begin, _) in ROLES.items()}
    parts, turns, at = _CONTROL.split(formatted), [], 1
    while at < len(parts):
        if parts[at] == ROLE:
            turns.append((unescape(parts[at + 1]), unescape(parts[at + 3])))
            at += 6
        else:
            turns.append((of_begin[parts[at]], unescape(parts[at + 1])))
            at += 4
    return turns


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Whether each token (by its span) meets one of the sorted, disjoint spans."""
    spans = [s for s in spans if s[1] > s[0]]
    if not spans:
        return np.zeros(len(starts), dtype=bool)
    first, last = np.array(spans).T
    # The first span that ends behind the token's start is the only one to ask.
    near = np.searchsorted(last, starts, side="right")
    return (near < len(last)) & (first[np.minimum(near, len(last) - 1)] < ends) & (ends > starts)


def loss_texts(text: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> list[str]:
    """What lies under each run of tokens that bear loss, unescaped."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], loss, [False]]).astype(np.int8)))
    return [unescape(text[starts[a] : ends[b - 1]]) for a, b in edges.reshape(-1, 2).tolist()]


def encoder(vocabulary: str):
    """The vocabulary with the control strings as tokens; its own special strings are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer
    from tokenizers.processors import ByteLevel

    made = Tokenizer.from_file(vocabulary)
    made.no_truncation()
    made.no_padding()
    made.encode_special_tokens = True
    made.post_processor = ByteLevel(trim_offsets=False)
    made.add_tokens([AddedToken(c, normalized=False) for c in CONTROLS if c != OWN])
    return made


def _segments(batches: Iterator[pa.RecordBatch], max_turns: int, max_chars: int) -> Iterator[tuple]:
    """(conv_id, number, whether it surely is the whole conversation, turns) of sorted rows.

    A task's first and last conversations may go on in other tasks.
    """
    none = object()
    conv, number, runs, turns, size = none, 0, -1, [], 0
    for batch in batches:
        columns = [batch.column(c) for c in ("conv_id", "role", "text")]
        for start in range(0, batch.num_rows, 256):
            for c, role, text in zip(*(x.slice(start, 256).to_pylist() for x in columns), strict=True):
                role, text = role or "", text or ""
                if c != conv:
                    if turns:
                        yield conv, number, number == 0 and runs > 0, turns
                    conv, number, runs, turns, size = c, 0, runs + 1, [], 0
                elif len(turns) >= max_turns or size >= max_chars:
                    yield conv, number, False, turns
                    number, turns, size = number + 1, [], 0
                turns.append((role, text))
                size += len(role) + len(text)
    if turns:
        yield conv, number, False, turns


def format_conversations(conversations: DataFrame, vocabulary: str, max_turns: int = TURNS, max_chars: int = CHARS) -> DataFrame:
    """Segments of formatted conversations: conv_id, part and seq (their order), whole (surely all of the conversation),
    text, and for each token ids, starts, ends (code points of text) and loss."""
    # Nothing binds the rows of one conversation to one task; the last key splits even rows that are equal.
    keys = [F.col("conv_id"), F.col("turn"), F.col("role"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.rand(0).alias("salt")]
    rows = conversations.select(*keys, "text")
    order = ["conv_id", "turn", "role", "digest", "salt"]
    kind = conversations.schema["conv_id"].dataType
    arrow = to_arrow_type(kind)

    def run(batches):
        encode, part, waiting, size = encoder(vocabulary), TaskContext.get().partitionId(), [], 0

        def out(segments):
            texts, spans = zip(*(render(s[3]) for s in segments), strict=True)
            ids, starts, ends, loss = [], [], [], []
            for found, own in zip(encode.encode_batch(list(texts), add_special_tokens=False), spans, strict=True):
                places = np.array(found.offsets, dtype=np.int64).reshape(-1, 2)
                ids.append(found.ids)
                starts.append(places[:, 0])
                ends.append(places[:, 1])
                loss.append(loss_mask(places[:, 0], places[:, 1], own))
            columns = [pa.array([s[0] for s in segments], arrow), pa.array([part] * len(segments), pa.int32()), pa.array([s[1] for s in segments], pa.int64()), pa.array([s[2] for s in segments], pa.bool_()), pa.array(texts, pa.string())]
            columns += [pa.array(x, pa.list_(pa.int32())) for x in (ids, starts, ends)] + [pa.array(loss, pa.list_(pa.bool_()))]
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "seq", "whole", "text", "ids", "starts", "ends", "loss"])

        for segment in _segments(batches, max_turns, max_chars):
            waiting.append(segment)
            size += sum(len(role) + len(text) for role, text in segment[3])
            if size > AT_ONCE or len(waiting) >= 256:
                yield out(waiting)
                waiting, size = [], 0
        if waiting:
            yield out(waiting)

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind.simpleString()}, {_SEGMENT}")


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted segments say by themselves: their turns by the control strings, their loss by the mask.

    Whole conversations give digests, segments of others the texts of which their digests are made.
    """
    kind = formatted.schema["conv_id"].dataType

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part, rows = batch.slice(start, 64), []
                for r in part.drop_columns(["ids"]).to_pylist():
                    turns = read_turns(r["text"])
                    said = "".join(f"{role}\n{text}\n" for role, text in turns)
                    loss = "".join(loss_texts(r["text"], np.array(r["starts"], dtype=np.int64), np.array(r["ends"], dtype=np.int64), np.array(r["loss"], dtype=bool)))
                    texts = (None, None, _sha256(said), _sha256(loss)) if r["whole"] else (said, loss, None, None)
                    rows.append((r["conv_id"], r["part"], r["seq"], len(turns), len(r["text"]), len(loss), *texts))
                yield _batch(rows, kind, _READ)

    return formatted.mapInArrow(run, f"conv_id {kind.simpleString()}, {_READ}")


def _batch(rows: list[tuple], kind, fields: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    names = [f.split() for f in fields.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * (len(names) + 1)
    return pa.RecordBatch.from_arrays([pa.array(columns[0], to_arrow_type(kind)), *(pa.array(c, kinds[t]) for c, (_, t) in zip(columns[1:], names, strict=True))], names=["conv_id", *(n for n, _ in names)])


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from formatted segments.

    The segments of a conversation pass a task in their order, one at a time: its digests need no more memory.
    """
    kind = formatted.schema["conv_id"].dataType
    order = ["conv_id", "part", "seq"]

    def run(batches):
        none = object()
        conv, done, n, turns, loss, whole = none, [], [0, 0, 0], hashlib.sha256(), hashlib.sha256(), None

        def row():
            digests = whole or (turns.hexdigest(), loss.hexdigest())
            return conv, n[0], digests[0], n[2], digests[1], n[1]

        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                for r in batch.slice(start, 64).to_pylist():
                    if r["conv_id"] != conv:
                        if conv is not none:
                            done.append(row())
                        conv, n, turns, loss, whole = r["conv_id"], [0, 0, 0], hashlib.sha256(), hashlib.sha256(), None
                    n = [n[0] + r["n_turns"], n[1] + r["formatted_chars"], n[2] + r["loss_chars"]]
                    if r["turns"] is None:
                        whole = r["turns_sha256"], r["loss_sha256"]
                    else:
                        turns.update(r["turns"].encode())
                        loss.update(r["loss"].encode())
            yield _batch(done, kind, _DIGEST)
            done = []
        if conv is not none:
            yield _batch([row()], kind, _DIGEST)

    return read_back(formatted).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, f"conv_id {kind.simpleString()}, {_DIGEST}")


def oracle(more: str = "") -> str:
    """DuckDB SQL of :func:`conversation_digests` over ``conversations`` and the rows of ``more``."""
    hidden = HIDDEN.replace("'", "''")
    length = "len({0}) + len(regexp_extract_all({0}, '" + hidden + "'))"
    around = " ".join(f"WHEN '{role}' THEN {len(a) + len(b)}" for role, (a, b) in ROLES.items())
    order = "ORDER BY turn NULLS FIRST, role_or_null NULLS FIRST, sha256(text)"
    return f"""
        WITH rows AS (SELECT conv_id, turn, role AS role_or_null, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations {more})),
        sized AS (SELECT *, {length.format("text")} + CASE role {around} ELSE {len(ROLE) + len(TEXT) + len(END)} + {length.format("role")} END AS chars FROM rows)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
            sum(CASE WHEN role = 'assistant' THEN len(text) ELSE 0 END)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id"""
