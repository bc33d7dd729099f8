"""Operator 1: personal data by bootstrapped contextual extraction.

Seeds are what the base patterns find: e-mail and IP addresses, card and phone numbers. Their left contexts (the two words
before) are lexical patterns. Spark builds the graph of patterns and the instances (tokens with digits, and groups of
digits) that follow them anywhere in the corpus, and scores both in turn: a pattern by the share of all its occurrences that
trusted instances follow, an instance by the other patterns that it follows. A pattern's own score never speaks for its
instances, so that it can't lift itself. Patterns that end with a high score find identifiers that no base pattern knows;
these become spans of kind ``context``.

Support is the number of different seeds behind a pattern, or of documents where it has any, whichever is less: what one
document repeats, or many copies share, counts once. Nothing but the patterns is broadcast; a pattern needs the support of
``min_share`` of all seed occurrences, so there are at most ``1 / min_share`` of them, however large the corpus.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.common import map_texts, sha256, spans_digest, written

KINDS = ("email", "ip", "card", "phone", "context")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DOTTED = re.compile(r"[0-9][0-9.]*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]++")
#: Further groups of digits of an identifier, each behind a single space, dot, dash or bracket (or a bracket beside one).
_GROUPS = re.compile(r"(?:(?:[ .-]?[(\[]|[)\]][ .-]?|[ .-])[0-9]++(?![^\W_]))++")
_EDGE = re.compile(r"[\s\"'(),;]")
_FIGURES = frozenset("0123456789")
_BEFORE = frozenset(" \t\n\r\v\f\u00a0\"'(),;")


@dataclass(frozen=True)
class Bootstrap:
    min_share: float = 1 / 20000
    min_support: int = 3
    rounds: int = 3
    min_score: float = 0.6
    #: An instance needs so many digits to be an identifier.
    min_digits: int = 4


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, from each ``@`` outwards: the local part is the run before it, so a text is read once."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            free = found.end()
        else:
            free = at + 1  # no later match holds this character before its own @
        at = text.find("@", max(at + 1, free))
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of four dotted parts that are all at most 255: of each row of parts, the first four, the next four."""
    out = []
    for run in _DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        at, row = run.start(), []
        for part in run[0].split("."):
            row = [*row, (at, part)] if part else []
            if len(row) == 4:
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for _, p in row):
                    out.append((row[0][0], at + len(part)))
                row = []
            at += len(part) + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) in the order of the kinds."""
    out = [(a, "email", b) for a, b in emails(text)] if "@" in text else []
    out += [(a, "ip", b) for a, b in addresses(text)]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if len(m[0]) > 13 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), "card", m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), "phone", m.end()))
    return out


def _context(text: str, start: int) -> str | None:
    """The two words before, however far off, in lower case; none where there are fewer or one holds a digit."""
    reach = 64
    while True:
        low = max(0, start - reach)
        words = text[low:start].rsplit(None, 2)
        # Of three parts the last two are whole words.
        if len(words) == 3 or not low:
            break
        reach *= 4
    pair = [w.lower() for w in words[-2:]]
    return " ".join(pair) if len(pair) == 2 and not any(c.isdigit() for w in pair for c in w) else None


def _opens(last: str, first: str) -> bool:
    """Whether an identifier may start inside a word, between these two characters."""
    return first == "+" or (first.isdigit() if last.isalpha() else first.isalnum())


def _glued(patterns) -> dict[str, dict[int, set[str]]]:
    """First word to the second words of the patterns, by length."""
    out: dict[str, dict[int, set[str]]] = {}
    for pattern in patterns:
        first, second = pattern.split(" ")
        out.setdefault(first, {}).setdefault(len(second), set()).add(second)
    return out


def _occurrences(text: str, seconds: dict[str, dict[int, set[str]]]):
    """Each pattern at each place it ends: at the end of a word, or inside a word where an identifier may start."""
    words = text.lower().split()
    for first, word in zip(words, words[1:]):
        for size, own in seconds.get(first, {}).items():
            if size <= len(word) and word[:size] in own and (size == len(word) or _opens(word[size - 1], word[size])):
                yield f"{first} {word[:size]}"


def _instances(text: str, base: list[tuple[int, str, int]], min_digits: int) -> list[tuple[int, int]]:
    """Tokens with enough digits that touch no base span; a token that ends in a digit goes on over the groups of digits behind it."""
    taken = sorted((a, b) for a, _, b in base)
    out, k = [], 0
    done = 0
    for m in _DIGITS.finditer(text):
        if m.start() < done:
            continue
        start = m.start()
        while start > done and text[start - 1] not in _BEFORE:
            start -= 1
        edge = _EDGE.search(text, m.end())
        done = edge.start() if edge else len(text)
        token = text[start:done].rstrip(".:!?")
        end = start + len(token)
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if token[-1:] in _FIGURES:
            more = _GROUPS.match(text, end, taken[k][0] if k < len(taken) else len(text))
            if more:
                end = more.end()
                done = max(done, end)
                start -= text[start - 1 : start] == "(" and ")" in text[start:end]
                token = text[start:end]
        if len(token) < min_digits or sum(map(token.count, "0123456789")) < min_digits:
            continue
        if k == len(taken) or taken[k][0] >= end:
            out.append((start, end))
    return out


def seed_patterns(documents: DataFrame, how: Bootstrap = Bootstrap()) -> list[str]:
    """Contexts of seeds with enough support (different seeds, and documents), counted over all documents."""

    def run(batches):
        seen: dict[tuple[str, str], list[int]] = {}
        n = 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                met = set()
                for start, _, end in base_spans(text or ""):
                    n += 1
                    context = _context(text, start)
                    if context:
                        seen.setdefault((context, sha256(text[start:end])[:32]), [0])[0] += context not in met
                        met.add(context)
            if len(seen) > 200_000:
                yield rows(seen)
                seen = {}
        seen["", ""] = [n]
        yield rows(seen)

    def rows(seen):
        columns = [[p for p, _ in seen], [i for _, i in seen], [n for (n,) in seen.values()]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["pattern", "seed", "n"])

    by_seed = documents.select("text").mapInArrow(run, "pattern string, seed string, n bigint").groupBy("pattern", "seed").agg(F.sum("n").alias("n"))
    counts = written(by_seed.groupBy("pattern").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("different")), "pii-contexts")
    # "" counts all seeds. It stands beside each pattern by a join of one row, so the bound holds before anything is collected.
    total = counts.filter("pattern = ''").select(F.col("n").alias("seeds"))
    least = F.greatest(F.lit(how.min_support), F.ceil(F.col("seeds") * how.min_share))
    known = counts.filter("pattern <> ''").join(F.broadcast(total)).filter(F.least("n", "different") >= least)
    return sorted(r.pattern for r in known.select("pattern").collect())


def pattern_graph(documents: DataFrame, patterns: list[str], how: Bootstrap = Bootstrap()) -> DataFrame:
    """pattern, instance, seed, n: what follows the patterns' occurrences; a null instance stands for all words that are none."""
    known = documents.sparkSession.sparkContext.broadcast(frozenset(patterns))

    def run(batches):
        wanted = known.value
        seconds = _glued(wanted)
        seen: dict[tuple, int] = {}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                text = text or ""
                for pattern in _occurrences(text, seconds):
                    key = (pattern, None, False)
                    seen[key] = seen.get(key, 0) + 1
                base, starts = base_spans(text), set()
                for start, end, seed in [(a, b, True) for a, _, b in base] + [(a, b, False) for a, b in _instances(text, base, how.min_digits)]:
                    context = _context(text, start)
                    if context in wanted:
                        key = (context, sha256(text[start:end])[:32], seed)
                        seen[key] = seen.get(key, 0) + 1
                        # Only what was counted as an occurrence is taken off again, once for all instances that start there.
                        if start not in starts and (text[start - 1].isspace() or _opens(text[start - 1], text[start])):
                            seen[context, None, False] = seen.get((context, None, False), 0) - 1
                        starts.add(start)
            if len(seen) > 200_000:
                yield table(seen)
                seen = {}
        yield table(seen)

    def table(seen):
        columns = [*zip(*seen)] or [(), (), ()]
        kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns, list(seen.values())], kinds, strict=True)], names=["pattern", "instance", "seed", "n"])

    schema = "pattern string, instance string, seed boolean, n bigint"
    return written(documents.select("text").mapInArrow(run, schema).groupBy("pattern", "instance", "seed").agg(F.sum("n").alias("n")), "pii-graph")


def pattern_scores(graph: DataFrame, how: Bootstrap = Bootstrap()) -> DataFrame:
    """pattern, score (0 to 1) after ``how.rounds`` rounds.

    Seeds have the trust 1. Any other instance of a pattern has the chance that not all its other patterns are wrong, so one
    that follows a single pattern has none.
    """
    # Never less than the instances: lower case may change a word that an instance cuts.
    total = graph.groupBy("pattern").agg(F.greatest(F.sum("n"), F.sum(F.when(F.col("instance").isNotNull(), F.col("n")))).alias("occurrences"))
    edges = graph.filter("instance is not null").groupBy("pattern", "instance").agg(F.sum("n").alias("n"), F.max("seed").alias("seed"))
    edges = written(edges.join(total, "pattern"), "pii-edges")
    told = edges.withColumn("trust", F.col("seed").cast("double"))
    for turn in range(how.rounds):
        scores = told.groupBy("pattern").agg((F.sum(F.col("n") * F.col("trust")) / F.first("occurrences")).alias("score"))
        if turn == how.rounds - 1:
            return scores
        doubts = edges.join(scores.select("pattern", F.log1p(-F.least("score", F.lit(0.999))).alias("doubt")), "pattern")
        all_doubts = doubts.groupBy("instance").agg(F.sum("doubt").alias("all_doubts"))
        by_others = F.greatest(1 - F.exp(F.col("all_doubts") - F.col("doubt")), F.lit(0.0))
        told = doubts.join(all_doubts, "instance").select("pattern", "n", "occurrences", F.when(F.col("seed"), 1.0).otherwise(by_others).alias("trust"))
    raise ValueError("at least one round")


def trusted_patterns(graph: DataFrame, how: Bootstrap = Bootstrap()) -> list[str]:
    """Patterns whose score is ``min_score`` or more after the rounds; their number is bounded as the graph's is."""
    return sorted(r.pattern for r in pattern_scores(graph, how).filter(F.col("score") >= how.min_score).select("pattern").collect())


FIELDS = {"n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string", "n_context": "bigint"}


def learned_patterns(documents: DataFrame, how: Bootstrap = Bootstrap()) -> list[str]:
    patterns = seed_patterns(documents, how)
    return trusted_patterns(pattern_graph(documents, patterns, how), how) if patterns else []


def all_spans(text: str, patterns: frozenset[str], how: Bootstrap) -> list[tuple[int, str, int]]:
    base = base_spans(text)
    if not patterns:
        return base
    return base + [(a, "context", b) for a, b in _instances(text, base, how.min_digits) if _context(text, a) in patterns]


def find_personal_data(documents: DataFrame, how: Bootstrap = Bootstrap()) -> DataFrame:
    """Counts and spans of personal data in each row's whole text.

    Offsets count code points, ends are exclusive. A null or empty text has none; repeated rows each get their row. An
    empty table, or one without seeds, has no learned patterns.
    """
    learned = documents.sparkSession.sparkContext.broadcast(frozenset(learned_patterns(documents, how)))

    def make():
        patterns = learned.value

        def of_texts(texts):
            out = [[] for _ in FIELDS]
            for text in texts:
                spans = all_spans(text, patterns, how)
                base = [s for s in spans if s[1] != "context"]
                n = {k: sum(s[1] == k for s in spans) for k in KINDS}
                for column, value in zip(out, (n["email"], n["ip"], n["card"], n["phone"], sha256(spans_digest(base)), spans_digest(spans), n["context"]), strict=True):
                    column.append(value)
            return out

        return of_texts

    return map_texts(documents, make, FIELDS)


def redact(documents: DataFrame, how: Bootstrap = Bootstrap(), keep: list[str] | None = None) -> DataFrame:
    """``documents`` with every span of its texts replaced by ``[KIND]``; overlapping spans become one, named by the first.

    Null texts stay null.
    """
    learned = documents.sparkSession.sparkContext.broadcast(frozenset(learned_patterns(documents, how)))
    columns = keep or documents.columns

    def make():
        patterns = learned.value

        def clean(text):
            pieces, done = [], 0
            for start, kind, end in sorted(all_spans(text, patterns, how), key=lambda s: (s[0], -s[2])):
                if start >= done:
                    pieces += [text[done:start], f"[{kind.upper()}]"]
                done = max(done, end)
            return "".join(pieces) + text[done:]

        return lambda texts: [[clean(t) for t in texts]]

    cleaned = map_texts(documents.withColumn("__null", F.col("text").isNull()), make, {"__clean": "string"}, keep=[*columns, "__null"])
    text = F.when(~F.col("__null"), F.col("__clean")).alias("text")
    return cleaned.select(*[text if c == "text" else F.col(f"`{c}`") for c in columns])
