"""Operator 10: byte-pair encoding as a deterministic automaton.

The automaton that the merges are compiled into reads tokens; its states are the tokens (the last one read) and a start
state. It begins with the base symbols, each of which may follow any other. The gadget of a merge ``u v -> w`` adds the
state ``w``, lets the arcs into ``w`` be those into ``u`` and the arcs out of ``w`` be those out of ``v``, and deletes the
arc ``u -> v``; where ``u`` is ``v``, the arc ``u -> w`` isn't made, as merges run from the left. After the last merge
every string has exactly one accepted path, which is its encoding. A gadget is recorded by what it copies and when, so an
arc is known from the gadgets that made its ends.

Words are read symbol by symbol from a transition table. A state of the table stands for all that can still become of the
word: which tokens are begun, each behind the token that it may follow. States that allow the same are one state. Every
beginning of a word has one path too, so a state names the last token of the beginning's encoding; the encoding of the
word is read off backwards from these, without search and without going back. Cells of the table are worked out from the
gadgets when they are first read; words of a batch are read side by side.

Decoding emits the label (the bytes) of each arc.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.common import map_batches
from clusterloom.llm.fragments import LONG_TEXT, Remembered, cut, held, joined

#: Fixed: how byte-level vocabularies split a text before merging.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Strings whose pieces are a word and one mark at most, whatever the vocabulary's pattern.
PLAIN = r"^ ?[A-Za-z]+[.,;:!?]?$"

#: Stands for the mark of a word's end; no byte of a text has this value.
WORD_END = 255

#: Up to here all editions of Unicode agree on letters, numbers and white space.
LAST_SETTLED = "ԯ"

#: States that the table holds when a batch begins; beyond, it starts anew.
STATES = 98_304
#: Pieces that are read side by side.
PIECES = 200_000
#: Begun tokens that no more than so many tokens go on from are told apart by which of these may follow.
LISTED = 32
#: The last few and longest pieces of a batch are read one by one.
FEW = 12


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    place = {b: chr(b) for b in plain}
    spare = iter(range(256, 512))
    return [place[b] if b in place else chr(next(spare)) for b in range(256)]


#: What a token may follow: any state at all, or (a state's number, or a set of tokens) only what that says.
ANY, NONE = -1, -2


class Automaton:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self.end = bytes([WORD_END]) if suffix else b""
        vocabulary: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = size = max(*vocabulary.values(), *self.special.values()) + 1
        self.left, self.right, self.born = [-1] * size, [-1] * size, [-1] * size
        self.deleted: dict[int, int] = {}
        dead = set()
        for time, pair in enumerate(model["merges"]):
            u, v = pair if isinstance(pair, list) else pair.split(" ")
            if not self._gadget(time, vocabulary[u], vocabulary[v], vocabulary[u + v]):
                dead.add(vocabulary[u + v])
        back = {c: b for b, c in enumerate(byte_characters())}
        self.label = [b""] * size
        self.length = np.zeros(size, dtype=np.int64)
        # The labels as a tree: a node's child by node and symbol, and the token that ends there.
        self.child: dict[int, int] = {}
        self.token = [-1]
        parent = [0]
        for s, i in vocabulary.items():
            if s in self.special:
                continue
            ended = bool(suffix) and s.endswith(suffix)
            self.label[i] = bytes(back[c] for c in (s[: -len(suffix)] if ended else s))
            symbols = self.label[i] + self.end * ended
            self.length[i] = len(symbols)
            if i in dead or (self.end and WORD_END in self.label[i]):
                continue
            node = 0
            for symbol in symbols:
                step = node << 8 | symbol
                node = self.child.get(step, -1)
                if node < 0:
                    node = self.child[step] = len(self.token)
                    self.token.append(-1)
                    parent.append(step >> 8)
            self.token[node] = i
        # Tokens that end below a node, children being younger than their parents; None where these are many.
        below: list[list[int] | None] = [[] for _ in self.token]
        self.below: list[tuple[int, ...] | None] = [()] * len(self.token)
        for node in range(len(self.token) - 1, -1, -1):
            own = below.pop()
            if own is None or len(own) > LISTED:
                self.below[node] = own = None
            elif own:
                self.below[node] = tuple(own)
            if node and below[parent[node]] is not None:
                below[parent[node]] = None if own is None else below[parent[node]] + [self.token[node]] * (self.token[node] >= 0) + own
        self._empty()

    def _gadget(self, time: int, u: int, v: int, w: int) -> bool:
        """Compiles one merge; false if no path reaches its two parts in turn."""
        live = self._arc_before(u, v, time)
        self.left[w], self.right[w], self.born[w] = u, v, time
        self.deleted[u * self.size + v] = time
        return live

    def _arc_before(self, x: int, y: int, time: int) -> bool:
        left, right, born, deleted, size = self.left, self.right, self.born, self.deleted, self.size
        while True:
            if deleted.get(x * size + y, time) < time:
                return False
            if born[x] < 0 and born[y] < 0:
                return True
            if x == y:
                x, y, time = right[x], left[y], born[x]
            elif born[x] > born[y]:
                x, time = right[x], born[x]
            else:
                if left[y] == x == right[y]:
                    return False
                y, time = left[y], born[y]

    def arc(self, x: int, y: int) -> bool:
        """Whether the token ``y`` may follow ``x`` after all merges."""
        return self._arc_before(x, y, 1 << 60)

    def _empty(self) -> None:
        """The table with the start state alone."""
        self.numbers: dict[tuple, int] = {}
        self.meaning: list[tuple] = []
        self.known: dict[int, object] = {}
        # By symbol and state: one more than the next state; 0 is not worked out yet. Symbols and states that never occur
        # take no memory, as nothing touches their part.
        self.table = np.zeros((256, STATES + STATES // 4), dtype=np.int32)
        self.last = np.zeros(self.table.shape[1], dtype=np.int32)
        self.sets: dict[frozenset, frozenset] = {}
        self._state(((ANY, 0),), -1)

    def _state(self, meaning: tuple, last: int) -> int:
        number = self.numbers.get(meaning)
        if number is None:
            number = self.numbers[meaning] = len(self.meaning)
            self.meaning.append(meaning)
            if number >= len(self.last):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
                self.last = np.concatenate([self.last, np.zeros_like(self.last)])
            self.last[number] = last
        return number

    def _allowed(self, before, node: int):
        """What is left of ``before`` for tokens that go on below ``node``: ANY, NONE, a set of tokens, or a state."""
        tokens = self.below[node]
        if before == ANY or tokens is None:
            return before
        if isinstance(before, frozenset):
            fits = frozenset(y for y in tokens if y in before)
            return NONE if not fits else ANY if len(fits) == len(tokens) else self.sets.setdefault(fits, fits)
        key = before * len(self.token) + node
        found = self.known.get(key)
        if found is None:
            fits = frozenset(y for y in tokens if self.arc(before, y))
            found = self.known[key] = NONE if not fits else ANY if len(fits) == len(tokens) else self.sets.setdefault(fits, fits)
        return found

    def _fill(self, state: int, symbol: int) -> int:
        """Works out one cell of the table."""
        last, begun = -1, []
        for before, node in self.meaning[state]:
            node = self.child.get(node << 8 | symbol, -1)
            if node < 0:
                continue
            token = self.token[node]
            if token >= 0 and (before == ANY or (token in before if isinstance(before, frozenset) else self.arc(before, token))):
                last = token
            if self.below[node] != ():
                allowed = self._allowed(before, node)
                if allowed != NONE:
                    begun.append((allowed, node))
        if last < 0:
            raise ValueError(f"no path over the symbol {symbol}")
        found = self._state((*begun, (last, 0)), last)
        self.table[symbol, state] = found + 1
        return found

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces (split off beforehand, none empty) in turn, and the number of ids of each."""
        raw = [p.encode("utf-8", "surrogatepass") + self.end for p in pieces]
        return self.encode_symbols(np.frombuffer(b"".join(raw), dtype=np.uint8), np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)))

    def encode_plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode_pieces` for strings like :data:`PLAIN`, whose pieces are the word and the mark behind it; the
        numbers of ids are those of each string."""
        sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        joint = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "")
        symbols, ends = np.frombuffer(joint[0].as_buffer(), dtype=np.uint8), np.cumsum(sizes)
        marked = symbols[ends - 1] < ord("A")
        pieces = np.repeat(sizes - marked, 1 + marked)
        first = np.cumsum(1 + marked) - 1 - marked
        pieces[first[marked] + 1] = 1
        if self.end:
            symbols = np.insert(symbols, np.cumsum(pieces), WORD_END)
            pieces = pieces + 1
        ids, n = self.encode_symbols(symbols, pieces)
        return ids, np.add.reduceat(n, first) if len(first) else n

    def encode_symbols(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode_pieces`, by the symbols of all pieces end to end and the number of symbols of each."""
        ends = np.cumsum(sizes)
        if len(sizes) > PIECES:
            cuts = np.arange(PIECES, len(sizes), PIECES)
            parts = [self.encode_symbols(*part) for part in zip(np.split(symbols, ends[cuts - 1]), np.split(sizes, cuts), strict=True)]
            return np.concatenate([ids for ids, _ in parts]), np.concatenate([n for _, n in parts])
        if len(self.meaning) > STATES:
            self._empty()
        order = np.argsort(-sizes, kind="stable")
        begin, longest = (ends - sizes)[order], sizes[order]
        states = np.zeros(len(symbols), dtype=np.int32)
        now = np.zeros(len(sizes), dtype=np.int32)
        i, alive = 0, len(sizes)
        while alive > FEW:
            at = begin[:alive] + i
            now = states[at] = self._step(now[:alive], symbols[at])
            i += 1
            alive = int(np.searchsorted(-longest, -i, side="left"))
        for k in range(alive):
            state = int(now[k])
            for at in range(int(begin[k]) + i, int(begin[k] + longest[k])):
                symbol = int(symbols[at])
                state = states[at] = found - 1 if (found := self.table.item(symbol, state)) else self._fill(state, symbol)
        last = self.last[states]
        # From each piece's end back by the last token's length; the places that this meets end the tokens.
        stops = np.zeros(len(symbols) + 1, dtype=bool)
        at, low = ends, ends - sizes
        while len(at):
            stops[at] = True
            at = at - self.length[last[at - 1]]
            on = at > low
            at, low = at[on], low[on]
        total = np.cumsum(stops)
        return last[stops[1:]], total[ends] - total[ends - sizes]

    def _step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        new = self.table[symbols, states] - 1
        missing = np.flatnonzero(new < 0)
        if len(missing):
            for cell in np.unique(states[missing].astype(np.int64) * 256 + symbols[missing]).tolist():
                self._fill(cell >> 8, cell & 255)
            new = self.table[symbols, states] - 1
        return new

    def encode_piece(self, piece: str) -> list[int]:
        return self.encode_pieces([piece])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        names = {i: s.encode() for s, i in self.special.items()}
        return b"".join(names.get(i) or self.label[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def automaton(path: str) -> Automaton:
    return Automaton(path)


held(automaton.cache_clear)
held(library.cache_clear)


class Splitter:
    """Texts and their fragments to pieces, as the vocabulary's pattern has them.

    Where the characters on both sides of a space are no white space, the pattern always ends a piece before that space,
    so a fragment has the same pieces anywhere. Beyond ``LAST_SETTLED``, where editions of Unicode differ in what is a
    letter, the vocabulary's own splitter finds the pieces.
    """

    def __init__(self, path: str):
        self.pattern = regex.compile(BYTE_LEVEL_PATTERN)
        self.later = regex.compile(f"[^\\x00-{LAST_SETTLED}]")
        self.path = path
        self.marks = list(automaton(path).special)
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.marks)) + ")") if self.marks else None

    def pieces(self, text: str) -> list[str]:
        if text.isascii() or not self.later.search(text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in library(self.path).pre_tokenizer.pre_tokenize_str(text)]

    def of_fragment(self, fragment: str) -> list[str] | None:
        """None where the fragment's pieces depend on what stands around it."""
        word = fragment[1:] if fragment[:1] == " " else fragment
        if word.isascii():
            if word.isalpha():
                return [fragment]
            if word[:-1].isalpha() and word[-1] in ".,;:!?":
                return [fragment[:-1], word[-1]]
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        return self.pieces(fragment)

    def parts(self, text: str) -> list[str]:
        """Between special strings, and these themselves."""
        return [p for p in self.special.split(text) if p] if self.special else [text]

    def whole(self, texts: pa.Array) -> np.ndarray:
        """Which texts must be split as a whole: those with special strings, and those too long for columns."""
        out = pc.binary_length(texts).to_numpy(zero_copy_only=False) > LONG_TEXT
        for mark in self.marks:
            out = out | pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        return out


class TextEncoder:
    """Whole texts to token ids, special strings as their tokens."""

    def __init__(self, path: str):
        self.machine, self.splitter = automaton(path), Splitter(path)

    def encode_pieces(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all lists' pieces in turn, and where each list's ids end, a 0 in front."""
        ids, n = self.machine.encode_pieces([p for pieces in lists for p in pieces])
        return ids, np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)]

    def __call__(self, text: str) -> np.ndarray:
        special, out = self.machine.special, []
        for part in self.splitter.parts(text):
            out.append(np.array([special[part]]) if part in special else self.machine.encode_pieces(self.splitter.pieces(part))[0])
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def encode_digests(documents: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; one pass, no shuffle.

    An empty or null text has no tokens; repeated rows each get their own row. The ids and the emitted bytes of a fragment
    are worked out once as long as the worker remembers it, so a text of any length needs memory in proportion to itself.
    """

    def make():
        encode = TextEncoder(vocabulary)
        machine = encode.machine
        labels = list(machine.label)
        for name, i in machine.special.items():
            labels[i] = name.encode()
        labels, names = pa.array(labels, pa.binary()), pa.array([str(i) for i in range(machine.size)])

        def work(fragments: list[str]) -> list:
            """(ids with commas between, emitted bytes), or False where the fragment says too little."""
            split = [encode.splitter.of_fragment(f) for f in fragments]
            ids, ends = encode.encode_pieces([s or [] for s in split])
            ends, ids = pa.array(ends, pa.int32()), pa.array(ids)
            texts = pc.binary_join(pa.ListArray.from_arrays(ends, names.take(ids)), ",").to_pylist()
            emitted = pc.binary_join(pa.ListArray.from_arrays(ends, labels.take(ids)), b"").to_pylist()
            return [(t, e) if s else False for s, t, e in zip(split, texts, emitted, strict=True)]

        remembered = Remembered(work)

        def alone(text: str):
            ids = encode(text)
            chosen = pa.array(ids)
            emitted = b"".join(labels.take(chosen).to_pylist()).decode("utf-8", "replace").encode()
            return len(ids), hashlib.sha256(",".join(names.take(chosen).to_pylist()).encode()).hexdigest(), hashlib.sha256(emitted).hexdigest()

        def of_texts(texts: pa.Array) -> list[list]:
            whole = encode.splitter.whole(texts)
            codes, offsets, fragments = cut(pc.if_else(pa.array(whole), "", texts))
            found = remembered(fragments)
            says_little = np.array([f is False for f in found])
            empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
            whole = whole | (np.logical_or.reduceat(says_little[codes], offsets[:-1]) & ~empty)
            blank = ("", b"")
            ids = joined(pa.array([(f or blank)[0] for f in found], pa.string()), codes, offsets, ",").cast(pa.binary()).to_pylist()
            emitted = joined(pa.array([(f or blank)[1] for f in found], pa.binary()), codes, offsets, b"").to_pylist()
            rows = []
            for i, (a, b) in enumerate(zip(ids, emitted, strict=True)):
                if whole[i]:
                    rows.append(alone(texts[i].as_py()))
                else:
                    rows.append((a.count(b",") + 1 if a else 0, hashlib.sha256(a).hexdigest(), hashlib.sha256(b).hexdigest()))
            return [list(c) for c in zip(*rows, strict=True)]

        return of_texts

    return map_batches(documents, make, {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"})


def encode(documents: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``documents`` with the token ids of its texts (``array<int>``) as one more column."""

    def make():
        encoder = TextEncoder(vocabulary)
        return lambda texts: [[encoder(t).tolist() for t in texts.to_pylist()]]

    source = documents if text == "text" else documents.withColumn("text", documents[text])
    return map_batches(source, make, {ids: "array<int>"}, keep=source.columns)


def decode(documents: DataFrame, vocabulary: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``documents`` with the text of its token ids; a null list gives a null text."""

    @F.pandas_udf("string")
    def decoded(column: pd.Series) -> pd.Series:
        machine = automaton(vocabulary)
        return column.map(lambda x: None if x is None else machine.decode(list(x)))

    return documents.withColumn(text, decoded(F.col(ids)))
