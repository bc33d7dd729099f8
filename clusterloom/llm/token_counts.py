"""Operator 2: token counts by a map-side two-tier lookup.

First tier: a compact table from the most frequent pre-tokens of the corpus to their numbers of tokens, broadcast
(``FREQUENT`` entries at most, whatever the corpus). Second tier, for what that table lacks: the misses of a slice of rows
are encoded at once, and the worker's own cache keeps those that are more than a plain word, which take longer. Pre-tokens are never shuffled: the frequent ones are found by a summary
of bounded size in each task, over all documents, and only these summaries are added up. The table makes counting fast;
counts don't depend on it.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat
from operator import add, itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.bpe_automaton import PLAIN, Splitter, TextEncoder
from clusterloom.llm.common import map_batches
from clusterloom.llm.fragments import Remembered, cut, slices

#: Entries of the broadcast table, and of each task's summary.
FREQUENT = 8192
#: Counters that a task holds before it drops the rare half; nothing but the choice of the table's entries depends on it.
COUNTERS = 200_000


def frequent_pre_tokens(documents: DataFrame, vocabulary: str, size: int = FREQUENT, counters: int = COUNTERS) -> list[str]:
    """The most frequent pre-tokens of all texts, ties by the pre-token.

    Each task counts fragments with at most ``counters`` counters, splits them when it has met all and hands on its ``size``
    largest pre-tokens.
    """

    def run(batches):
        met: dict[str, int] = {}
        split = Splitter(vocabulary)
        for batch in batches:
            for _, texts in slices(batch):
                codes, _, fragments = cut(texts)
                n = np.bincount(codes, minlength=len(fragments)).tolist()
                met.update(zip(fragments, map(add, map(met.get, fragments, repeat(0)), n), strict=True))
                if len(met) > counters:
                    met = dict(sorted(met.items(), key=itemgetter(1), reverse=True)[: counters // 2])
        seen: Counter = Counter()
        for fragment, n in met.items():
            for piece in split.of_fragment(fragment) or ():
                seen[piece] += n
        top = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:size]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["pre", "n"])

    rows = documents.select("text").mapInArrow(run, "pre string, n bigint").groupBy("pre").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pre").limit(size).collect()
    return [r.pre for r in rows]


def token_counts(documents: DataFrame, vocabulary: str, limit: int = 1024, frequent: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every document.

    Special strings in a text count as the library counts them by default: one token each. An empty or null text has 0
    bytes and tokens. Repeated rows each get their row. ``frequent``: a table found before; else the corpus is read for it.
    """
    frequent = frequent_pre_tokens(documents, vocabulary) if frequent is None else frequent
    lengths = TextEncoder(vocabulary).machine.encode_pieces(frequent)[1].tolist() if frequent else []
    table = documents.sparkSession.sparkContext.broadcast(dict(zip(frequent, lengths, strict=True)))

    def make():
        encode, first_tier = TextEncoder(vocabulary), table.value

        def work(fragments: list[str]) -> list[int]:
            """Tokens of fragments, by the table for the pre-tokens that it has; -1 where a fragment says too little."""
            split = [encode.splitter.of_fragment(f) for f in fragments]
            misses = list({p for s in split if s for p in s if p not in first_tier})
            n = dict(zip(misses, encode.machine.encode_pieces(misses)[1].tolist(), strict=True)) if misses else {}
            return [-1 if s is None else sum([first_tier[p] if p in first_tier else n[p] for p in s]) for s in split]

        second_tier = Remembered(work)

        def of_texts(texts: pa.Array) -> list:
            whole = encode.splitter.whole(texts)
            codes, offsets, fragments = cut(pc.if_else(pa.array(whole), "", texts))
            found = list(map(first_tier.get, fragments))
            misses = np.array([i for i, n in enumerate(found) if n is None], dtype=np.int64)
            n = np.array([0 if n is None else n for n in found], dtype=np.int64)
            lacking = pa.array([fragments[i] for i in misses.tolist()], pa.string())
            plain = pc.match_substring_regex(lacking, PLAIN)
            first = plain.to_numpy(zero_copy_only=False).astype(bool)
            n[misses[first]] = encode.machine.encode_plain(lacking.filter(plain))[1]
            n[misses[~first]] = second_tier(lacking.filter(pc.invert(plain)).to_pylist())
            n_bytes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            whole = whole | (np.logical_or.reduceat(n[codes] < 0, offsets[:-1]) & (n_bytes > 0))
            n_tokens = np.where(n_bytes > 0, np.add.reduceat(n[codes], offsets[:-1]), 0)
            for i in np.flatnonzero(whole).tolist():
                n_tokens[i] = len(encode(texts[i].as_py()))
            return [n_bytes, n_tokens, n_tokens > limit]

        return of_texts

    return map_batches(documents, make, {"n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"})
