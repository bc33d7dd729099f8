"""Operator 8: quality rules by distribution divergence.

Language references are histograms over all documents of a language: of character classes, and of its most common words.
A document's Jensen-Shannon distances (base 2, 0 to 1) are taken to the nearest reference. It is rejected where a
distance exceeds its threshold and the text is long enough for the histogram to mean something; base rules (few words,
many repeated five-word windows) reject too. For words the threshold comes from the reference: the distance to it of a text
that has none of its common words. A text nearly so far from every language, or farther, is rejected, unless its own
language is one without a reference.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clusterloom.llm.common import map_texts, written
from clusterloom.llm.fragments import turn_to_other_work

CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "control")
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_repeat_percent: int = 20
    #: Thresholds of the distances, and the least characters and words at which each is used.
    max_char_distance: float = 0.3
    min_chars: int = 200
    #: As a share of the distance that a text without any common word has.
    max_word_share: float = 0.97
    min_word_count: int = 100
    #: Common words a reference has.
    common_words: int = 100
    #: A language has a reference if it holds this share of all characters (so there are 1/share at most); all together have one.
    min_language_share: float = 0.005


def _class_table() -> np.ndarray:
    """Class of each code point up to U+3000; those beyond are letters without case."""
    table = np.zeros(0x3001, dtype=np.int64)
    for c in range(0x3001):
        ch = chr(c)
        if ch in " \t\n\r\v\f" or ch.isspace():
            table[c] = 3
        elif c < 32 or 127 <= c < 160:
            table[c] = 6
        elif ch.isdigit():
            table[c] = 2
        elif ch.isupper():
            table[c] = 1
        elif ch.isalpha() or ch.isalnum():
            table[c] = 0
        elif ch in ".,;:!?'\"()-":
            table[c] = 4
        else:
            table[c] = 5
    return table


_TABLE: np.ndarray | None = None


def class_counts(text: str) -> np.ndarray:
    global _TABLE
    if _TABLE is None:
        _TABLE = _class_table()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.bincount(_TABLE[np.minimum(codes, 0x3000)], minlength=len(CLASSES)).astype(float)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of the histogram ``p`` to each row of ``q``; both as shares; base 2."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def repeated_window_words(words: list[bytes], size: int = 5) -> int:
    """Words that lie in a window of ``size`` words which the text holds twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    # Only equality within this text counts, so a hash that differs from process to process will do.
    ids = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    windows = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        windows = windows * np.uint64(0xD6E8FEB86659FD93) + ids[k : k + n]
    order = np.sort(windows)
    if not (order[1:] == order[:-1]).any():
        return 0
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _class_totals(documents: DataFrame) -> DataFrame:
    """lang and the number of characters of each class, over all documents."""

    def run(batches):
        turn_to_other_work()
        for batch in batches:
            classes: dict[str, np.ndarray] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                classes[lang] = classes.get(lang, 0) + class_counts(text)
            columns = [pa.array(list(classes), pa.string()), *[pa.array([int(h[k]) for h in classes.values()], pa.int64()) for k in range(len(CLASSES))]]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", *CLASSES])

    rows = documents.mapInArrow(run, "lang string, " + ", ".join(f"`{c}` bigint" for c in CLASSES))
    return rows.groupBy("lang").agg(*[F.sum(c).alias(c) for c in CLASSES])


def empty_overlap(shares: np.ndarray) -> float:
    """The distance to a reference (its common words' shares, then the rest's) of a text without any of them."""
    return float(js_distance(np.eye(len(shares))[-1], shares))


def references(documents: DataFrame, rules: Rules = Rules()) -> list[tuple[np.ndarray, dict[bytes, int], np.ndarray]]:
    """Classes, common words and shares of each large language, and last of all together unless one language is all."""
    return [r for _, r in language_references(documents, rules)]


def language_references(documents: DataFrame, rules: Rules = Rules()) -> list[tuple[str | None, tuple[np.ndarray, dict[bytes, int], np.ndarray]]]:
    """For each large language (and for all documents together, unless one language is all): shares of classes, its
    common words, their shares and the rest's, behind its name (None: all together).

    Counts are exact and over all documents, however rows are dealt. Only languages with ``min_language_share`` of all
    characters leave the executors, so their number is bounded.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rows = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    totals = written(_class_totals(rows).withColumn("chars", sum([F.col(c) for c in CLASSES[1:]], F.col(CLASSES[0]))), "quality-classes")
    whole = totals.agg(*[F.sum(c).alias(c) for c in (*CLASSES, "chars")]).first()
    if not whole.chars:
        return []
    large = {r.lang: r for r in totals.filter((F.col("chars") > 0) & (F.col("chars") >= rules.min_language_share * whole.chars)).collect()}
    words = rows.select("lang", F.explode(F.split(F.translate("text", upper, lower), "[ \\t-\\r]+")).alias("word")).filter("word <> ''")
    counts = written(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "quality-words")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    own = counts.filter(F.col("lang").isin(sorted(large)))
    tops = own.withColumn("place", place).filter(F.col("place") <= rules.common_words).select("lang", "word", "n").collect()
    sums = {r.lang: r.n for r in own.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    groups = [(g, large[g], [(r.word, r.n) for r in tops if r.lang == g], sums.get(g, 0)) for g in sorted(large)]
    if len(large) != 1:
        together = counts.groupBy("word").agg(F.sum("n").alias("n"))
        groups.append((None, whole, [(r.word, r.n) for r in together.orderBy(F.desc("n"), "word").limit(rules.common_words).collect()], counts.agg(F.sum("n")).first()[0] or 0))
    out = []
    for name, classes, best, total in groups:
        histogram = np.array([classes[c] for c in CLASSES], dtype=float)
        if total:
            best = sorted(((w.encode(), n) for w, n in best), key=lambda x: (-x[1], x[0]))
            shares = np.array([n / total for _, n in best] + [max(0.0, 1 - sum(n for _, n in best) / total)])
            out.append((name, (histogram / histogram.sum(), {w: i for i, (w, _) in enumerate(best)}, shares)))
    return out


FIELDS = {
    "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint",
    "base_failed": "boolean", "kept": "boolean", "char_distance": "double", "word_distance": "double",
}


VERDICTS = FIELDS | {"__far": "boolean"}


def _judge(documents: DataFrame, rules: Rules):
    """What judges texts (``FIELDS`` and ``__far``: the words are far from every language), and for which rows that counts."""
    named = language_references(documents, rules)
    known = documents.sparkSession.sparkContext.broadcast(named)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    speaks = (lang == "") | lang.isin([n for n, _ in named if n is not None])

    def make():
        refs = [r for _, r in known.value]
        class_refs = np.stack([c for c, _, _ in refs]) if refs else None
        place = {w: i for i, w in enumerate(dict.fromkeys(w for _, index, _ in refs for w in index))}
        word_refs = [(np.array([place[w] for w in sorted(index, key=index.get)], dtype=np.int64), shares, empty_overlap(shares)) for name, (_, index, shares) in known.value if name is not None]

        def distances(text, words, chars):
            by_char = by_word = None
            far = False
            if refs and chars >= rules.min_chars:
                counts = class_counts(text)
                by_char = float(js_distance(counts / counts.sum(), class_refs).min())
            if word_refs and len(words) >= rules.min_word_count:
                counts = np.bincount([i for i in map(place.get, words) if i is not None], minlength=len(place))
                best = []
                for index, shares, empty in word_refs:
                    mine = np.append(counts[index], 0)
                    mine[-1] = len(words) - mine.sum()
                    best.append((float(js_distance(mine / len(words), shares)), empty))
                by_word = min(d for d, _ in best)
                far = all(d > rules.max_word_share * empty for d, empty in best)
            return by_char, by_word, far

        def of_texts(texts):
            out = [[] for _ in VERDICTS]
            for text in texts:
                raw = text.encode("utf-8", "surrogatepass")
                words = raw.split()
                word_chars = len(text) - sum([text.count(c) for c in " \t\n\v\f\r"])
                lines = [x for x in raw.split(b"\n") if x.strip()]
                repeats = repeated_window_words(words)
                failed = len(words) < rules.min_words or 100 * repeats > rules.max_repeat_percent * len(words)
                by_char, by_word, far = distances(text, raw.lower().split(), len(text))
                kept = not failed and not (by_char or 0) > rules.max_char_distance
                row = (len(words), word_chars, sum([text.count(c) for c in SYMBOLS]), len(lines) - len(set(lines)), repeats, failed, kept, by_char, by_word, far)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out

        return of_texts

    return make, speaks


def quality(documents: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, the rules' figures and the verdict (``kept``) of each row.

    Distances are null where a text is below the guard's length or there is no reference. A null or empty text has no
    words and fails; a null language joins those without a name; the words of a text whose language is too small for a
    reference are not judged; repeated rows each get their row; an empty table gives no rows.
    """
    judge, speaks = _judge(documents, rules)
    judged = map_texts(documents, judge, VERDICTS, keep=("doc_id", "lang"))
    return judged.select("doc_id", *[(F.col(c) & ~(F.col("__far") & speaks)).alias(c) if c == "kept" else F.col(c) for c in FIELDS])


def accepted(documents: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``documents`` that the rules keep, columns as they were."""
    judge, speaks = _judge(documents, rules)
    at = [list(VERDICTS).index(c) for c in ("kept", "__far")]

    def make():
        of_texts = judge()

        def verdicts(texts):
            out = of_texts(texts)
            return [out[i] for i in at]

        return verdicts

    judged = map_texts(documents, make, {"__kept": "boolean", "__far": "boolean"}, keep=documents.columns, where="__kept")
    return judged.filter(~(F.col("__far") & speaks)).drop("__kept", "__far")
