"""Operator 5: best-fit packing by a configuration linear program.

Documents become token pieces of at most ``capacity``. The histogram of piece lengths (``capacity`` rows at most) is what
the program sees: a configuration is a multiset of lengths that fits a sequence, and the fewest sequences cover the
histogram. Multiplicative weights solve the program, priced by dynamic programming over the knapsack, until its fractional
use is close to the bound that the prices prove. Use is rounded to whole sequences, what is left is placed best fit, and
where best fit alone needs fewer sequences its plan stands. Every row then finds its place by its rank among the pieces of
its length.

Only the histogram and the plan (of bounded size: configurations times capacity) pass the driver.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clusterloom.llm.bpe_automaton import LAST_SETTLED, PLAIN, automaton, byte_characters, library
from clusterloom.llm.common import few_rows, written
from clusterloom.llm.fragments import LONG_TEXT, Remembered, chunks_of, give_back, joined, slices

#: Fixed: how the vocabulary with word ends splits a text.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@dataclass(frozen=True)
class Packing:
    capacity: int = 2048
    separator: int = 0
    #: Turns of pricing and playing at most, steps of a turn, how fast weights answer, and the gap between the plan and the
    #: bound at which the turns end.
    rounds: int = 12
    steps: int = 200
    rate: float = 0.5
    gap: float = 0.001
    #: Configurations that are kept from turn to turn: those used most.
    columns: int = 12_000
    #: Rank groups of a length: rows of one length are ranked in so many parts.
    parts: int = 256


class WordEncoder:
    """Texts to little-endian 32-bit token ids, by what lies between white space.

    Pieces never hold white space, so a chunk between spaces is encoded alone: plain words of a slice side by side, and
    what else there is is remembered. Texts with special strings go through the
    library.
    """

    def __init__(self, vocabulary: str):
        self.machine = automaton(vocabulary)
        self.vocabulary = vocabulary
        self.marks = list(self.machine.special)
        self.pattern = regex.compile(WORD_PATTERN)
        self.later = regex.compile(f"[^\x00-{LAST_SETTLED}]")
        self.back = {c: b for b, c in enumerate(byte_characters())}
        self.remembered = Remembered(self._ids)

    def _pieces(self, chunk: str) -> list[str]:
        if chunk.isascii():
            low = chunk.lower()
            if low.isalpha():
                return [low]
            if low[:-1].isalpha() and low[-1] in ".,;:!?":
                return [low[:-1], low[-1]]
            return self.pattern.findall(low)
        # The library lowers letters one by one, which differs for the sigma at a word's end alone.
        plain = not self.later.search(chunk) and "Σ" not in chunk
        normal = unicodedata.normalize("NFC", chunk).lower() if plain else library(self.vocabulary).normalizer.normalize_str(chunk)
        if plain and normal.isalpha():
            return [normal]
        if self.later.search(normal):
            return [bytes(self.back[c] for c in p).decode("utf-8", "surrogatepass") for p, _ in library(self.vocabulary).pre_tokenizer.pre_tokenize_str(normal)]
        return self.pattern.findall(normal)

    def _ids(self, chunks: list[str]) -> list[bytes]:
        lists = [self._pieces(c[1:] if c[:1] == " " else c) for c in chunks]
        ids, n = self.machine.encode_pieces([p for x in lists for p in x])
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum([0, *map(len, lists)])] * 4
        raw = ids.astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def alone(self, text: str) -> bytes:
        """Of one text, whatever is in it."""
        if any(m in text for m in self.marks):
            return np.array(library(self.vocabulary).encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        chunks = text.replace("\n", " ").split(" ")
        known = list(dict.fromkeys(chunks))
        return b"".join(map(dict(zip(known, self.remembered(known), strict=True)).__getitem__, chunks))

    def __call__(self, texts: pa.Array) -> list[bytes]:
        whole = pc.binary_length(texts).to_numpy(zero_copy_only=False) > LONG_TEXT
        for mark in self.marks:
            whole = whole | pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        codes, offsets, chunks = chunks_of(pc.replace_substring(pc.if_else(pa.array(whole), "", texts), "\n", " "))
        # Plain words are read side by side, which takes less time than to remember them.
        plain = pc.match_substring_regex(chunks, PLAIN)
        ids, n = self.machine.encode_plain(pc.ascii_lower(chunks.filter(plain)))
        ends = np.concatenate([[0], np.cumsum(n) * 4]).astype(np.int32)
        values = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4"))])
        values = pa.concat_arrays([values, pa.array(self.remembered(chunks.filter(pc.invert(plain)).to_pylist()), pa.binary())])
        first = plain.to_numpy(zero_copy_only=False).astype(bool)
        place = np.where(first, np.cumsum(first) - 1, len(n) + np.cumsum(~first) - 1)
        out = joined(values, place[codes], offsets, b"").to_pylist()
        for i in np.flatnonzero(whole).tolist():
            out[i] = self.alone(texts[i].as_py())
        return out


def pieces(documents: DataFrame, vocabulary: str, how: Packing = Packing()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and the separator, cut only beyond the capacity."""

    def run(batches):
        encode = WordEncoder(vocabulary)
        end = np.array([how.separator], dtype="<u4").tobytes()
        size = 4 * how.capacity
        for batch in batches:
            for part, texts in slices(batch):
                rows = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode(texts), strict=True):
                    ids += end
                    rows += [(doc_id, k, at // 4, len(ids[at : at + size]) // 4, zlib.crc32(ids[at : at + size])) for k, at in enumerate(range(0, len(ids), size))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
                del rows
                give_back()
        del encode
        give_back()

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


@dataclass(frozen=True)
class Solution:
    """``plan``: (configuration, how many sequences use it), which covers the histogram exactly. ``bound``: no plan has
    fewer sequences. ``fractional``: sequences that the program's fractional solution uses; ``rounded``: those of the plan
    that come from it, the others are placed best fit."""

    plan: list[tuple[dict[int, int], int]]
    bound: int
    fractional: float
    rounded: int

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.plan)


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """By dynamic programming, what the best multiset of lengths (ascending) within each room is worth, and the place of
    the length that is added last in each room (-1: the room is as good as one less)."""
    value = np.zeros(capacity + 1)
    added = [-1] * (capacity + 1)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        k = fitting[room]
        if k:
            offers = value[room - lengths[:k]] + prices[:k]
            best = int(offers.argmax())
            if offers[best] > value[room]:
                value[room], added[room] = offers[best], best
    return value, added


def contents(added: list[int], lengths: list[int], room: int) -> dict[int, int]:
    """Place of a length to copies, of the best multiset within ``room``."""
    out: dict[int, int] = {}
    while room > 0:
        i = added[room]
        if i < 0:
            room -= 1
        else:
            out[i] = out.get(i, 0) + 1
            room -= lengths[i]
    return out


class Program:
    """The covering program over the histogram: as few sequences as possible, each a configuration, so that every length is
    covered as often as it occurs.

    Multiplicative weights play both sides of it: what a length is worth falls where it is covered well, and the use of a
    configuration grows where its lengths are worth much (with optimistic steps, so that both settle). Pricing is a
    knapsack at the present worths: its value gives a lower bound, as worths divided by it are a solution of the dual, and
    for each length the best configuration that holds it enters the program.
    """

    def __init__(self, histogram: dict[int, int], capacity: int, start: list[tuple[dict[int, int], int]]):
        self.capacity = capacity
        self.lengths = np.array(sorted(histogram))
        self.counts = np.array([histogram[n] for n in self.lengths.tolist()], dtype=np.int64)
        self.place = {n: i for i, n in enumerate(self.lengths.tolist())}
        self.volume = float(self.lengths @ self.counts) / capacity
        self.bound = self.volume
        self.worth = self.lengths * self.counts / (self.lengths @ self.counts)
        self.index: dict[tuple, int] = {}
        self.columns: list[dict[int, int]] = []
        self.use = np.zeros(0)
        self._enter([({self.place[n]: k for n, k in c.items()}, float(number)) for c, number in start])

    def _enter(self, columns: list[tuple[dict[int, int], float]]) -> None:
        new = []
        for column, use in columns:
            key = tuple(sorted(column.items()))
            if key not in self.index:
                self.index[key] = len(self.columns)
                self.columns.append(column)
                new.append(use)
        self.use = np.concatenate([self.use, new])
        self.at = np.array([i for c in self.columns for i in c], dtype=np.int64)
        self.of = np.repeat(np.arange(len(self.columns)), [len(c) for c in self.columns])
        self.copies = np.array([k for c in self.columns for k in c.values()], dtype=float)

    def covered(self, use: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.copies * use[self.of], minlength=len(self.lengths)) / self.counts

    def price(self, share: float = 0.02) -> float:
        """Enters the best configuration for each length; the lower bound that the worths prove."""
        prices = self.worth / self.counts
        value, added = knapsack(self.lengths, prices, self.capacity)
        lengths = self.lengths.tolist()
        proven = float(self.worth.sum() / value[self.capacity])
        new = []
        for i, n in enumerate(lengths):
            column = contents(added, lengths, self.capacity - n)
            column[i] = column.get(i, 0) + 1
            # No more copies than there are.
            column = {j: min(k, int(self.counts[j])) for j, k in column.items()}
            new.append((column, share * float(self.counts[i]) / column[i]))
        self._enter(new)
        self.bound = max(self.bound, proven)
        return proven

    def play(self, steps: int, rate: float) -> None:
        """Multiplicative steps of both sides; their means become the present worths and uses."""
        total = self.bound
        use, worth = self.use / self.use.sum(), self.worth / self.worth.sum()
        log_use, log_worth = np.log(np.maximum(use, 1e-12)), np.log(np.maximum(worth, 1e-300))
        sum_use, sum_worth = np.zeros(len(use)), np.zeros(len(worth))
        last_gain = last_cover = None
        for _ in range(steps):
            cover = np.minimum(self.covered(use * total), 4.0)
            gain = np.bincount(self.of, self.copies * (worth / self.counts * total)[self.at], minlength=len(use))
            log_worth -= rate * (cover if last_cover is None else 2 * cover - last_cover)
            log_use += rate * (gain if last_gain is None else 2 * gain - last_gain)
            last_cover, last_gain = cover, gain
            worth = np.exp(log_worth - log_worth.max())
            worth /= worth.sum()
            use = np.exp(log_use - log_use.max())
            use /= use.sum()
            sum_use += use
            sum_worth += worth
        self.use, self.worth = sum_use / steps * total, sum_worth / steps

    def drop_unused(self, keep: int) -> None:
        """Forgets the configurations that are hardly used."""
        if len(self.columns) > keep:
            stay = np.sort(np.argsort(-self.use, kind="stable")[:keep])
            columns = [(self.columns[i], float(self.use[i])) for i in stay.tolist()]
            self.index, self.columns, self.use = {}, [], np.zeros(0)
            self._enter(columns)

    def fractional(self) -> float:
        """Sequences that the present use needs, with what it leaves uncovered in sequences by length."""
        lack = np.maximum(0.0, 1.0 - self.covered(self.use)) * self.counts
        return float(self.use.sum() + (lack / (self.capacity // self.lengths)).sum())

    def rounded(self) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
        """Whole sequences by the fractional use, and the lengths that are left.

        Each configuration is used as often as its use is whole; then, the largest fraction first, once more where all its
        lengths are still there.
        """
        left = self.counts.copy()
        lengths = self.lengths.tolist()
        number = np.zeros(len(self.columns), dtype=np.int64)
        order = np.argsort(-self.use, kind="stable").tolist()
        # A full sequence is worth more than one with room: of rare fractions these come first.
        filled = [sum(lengths[i] * k for i, k in c.items()) for c in self.columns]
        later = sorted(range(len(self.columns)), key=lambda c: (-filled[c] // 4, -(self.use[c] % 1.0)))
        for turn, row in enumerate((order, [c for c in later if self.use[c] % 1.0 > 0.02])):
            for c in row:
                wanted = int(self.use[c]) if turn == 0 else 1
                fits = min(wanted, *(int(left[i]) // k for i, k in self.columns[c].items())) if wanted else 0
                if fits > 0:
                    number[c] += fits
                    for i, k in self.columns[c].items():
                        left[i] -= k * fits
        plan = [({lengths[i]: k for i, k in self.columns[c].items()}, int(number[c])) for c in np.flatnonzero(number).tolist()]
        return plan, {n: int(k) for n, k in zip(lengths, left.tolist(), strict=True) if k}


def solve(histogram: dict[int, int], how: Packing = Packing()) -> Solution:
    """The program is played and priced in turns until its use is within ``how.gap`` of the bound (``how.rounds`` turns at
    most), rounded, and what is left is placed best fit. Where best fit alone needs fewer sequences, its plan stands."""
    full = histogram.get(how.capacity, 0)
    left = {n: c for n, c in histogram.items() if c and n < how.capacity}
    whole = [({how.capacity: 1}, full)] if full else []
    if not left:
        return Solution(whole, full, float(full), full)
    plain = best_fit(left, how.capacity)
    program = Program(left, how.capacity, plain)
    best, used, rounded = plain, sum(n for _, n in plain), 0
    fractional = float(used)
    for turn in range(how.rounds):
        program.price()
        program.play(how.steps, how.rate)
        fractional = min(fractional, program.fractional())
        if turn % 4 == 3 or turn == how.rounds - 1:
            plan, rest = program.rounded()
            mine = sum(n for _, n in plan)
            plan += best_fit(rest, how.capacity)
            total = sum(n for _, n in plan)
            if total <= used:
                best, used, rounded = plan, total, mine
        least = math.ceil(program.bound - 1e-6)
        if rounded and used - least <= how.gap * least:
            break
        program.drop_unused(how.columns)
    return Solution(whole + best, full + math.ceil(program.bound - 1e-6), full + fractional, full + rounded)


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Longest first, each into the fullest sequence that has room; equal sequences are handled together."""
    bins: dict[int, dict[tuple, int]] = {capacity: {}}  # room left: content: number; an empty sequence is always there
    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        count = histogram[length]
        while count:
            room = min((r for r, b in bins.items() if r >= length and b), default=None)
            if room is None:
                content, number, room = (), count, capacity
                fits = max(1, capacity // length)
                number = max(1, count // fits) if count >= fits else 1
            else:
                content, number = next(iter(bins[room].items()))
            used = min(number, count)
            each = min(room // length, max(1, count // used))
            if room is not None and bins.get(room, {}).get(content):
                bins[room][content] -= used
                if not bins[room][content]:
                    del bins[room][content]
            grown = tuple(sorted((*content, *[length] * each)))
            new = bins.setdefault(room - length * each, {})
            new[grown] = new.get(grown, 0) + used
            count -= used * each
    out: dict[tuple, int] = {}
    for group in bins.values():
        for content, number in group.items():
            out[content] = out.get(content, 0) + number
    return [({n: content.count(n) for n in set(content)}, number) for content, number in sorted(out.items())]


def plan_table(plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, where its ranks go: first ranks, copies in a sequence, first sequence, first offset."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for configuration, number in plan:
        offset = 0
        for length in sorted(configuration, reverse=True):
            copies = configuration[length]
            rows.setdefault(length, []).append((rank.get(length, 0), copies, sequence, offset))
            rank[length] = rank.get(length, 0) + copies * number
            offset += length * copies
        sequence += number
    return {n: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for n, r in rows.items()}


def pack(documents: DataFrame, vocabulary: str, how: Packing = Packing()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    A null or empty text is the separator alone; repeated rows are packed each; an empty table gives no rows. Ties of
    equal length go by a hash of the id, the id and the piece.
    """
    with few_rows(documents.sparkSession):
        table = written(pieces(documents, vocabulary, how), "pieces")
    table = table.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(how.parts)).cast("int"))
    counts = table.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    # One row a length: the capacity bounds them.
    plan = plan_table(solve({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, how).plan)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = table.withColumn("within", within).join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("within"))
    shared = documents.sparkSession.sparkContext.broadcast(plan)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches):
        where = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                first, copies, base, start = where[int(n)]
                k = np.searchsorted(first, rank[rows], side="right") - 1
                within = rank[rows] - first[k]
                sequence[rows] = base[k] + within // copies[k]
                offset[rows] = start[k] + (within % copies[k]) * n
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return ranked.select(*columns, "rank").mapInArrow(place, schema)
