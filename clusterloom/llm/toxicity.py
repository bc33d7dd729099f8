"""Operator 7: toxicity by a linear-chain conditional random field.

Tokens are tagged 0 or 1. The labelled tokens come from labelled documents: a feature (a word, a beginning of one) is toxic
if it stands in toxic documents, in many different contexts, and hardly ever in clean ones; of a token's features the
longest that is frequent enough to tell decides. The
field is trained on windows of these tokens. Forward-backward marginals over whole texts then give the offending offsets
and, through a calibrated logistic of the strongest and the expected number of toxic tokens, the document's score.

Training uses a bounded sample of labelled rows (``Training.rows`` of each label, those with the smallest hash of their
id), and never a row that is held out. Scoring is one pass over all documents without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.common import map_texts, written

_EDGES = re.compile(r"^\W+|\W+$")
CACHE = 250_000
#: Tokens whose weights are looked up at a time, or those of one text.
TOKENS_AT_ONCE = 1 << 16
#: Tokens whose word is what is left without the marks at their end; their checksums are taken side by side.
PLAIN = r"^[A-Za-z0-9](?:[!-~]*[A-Za-z0-9])?[.,;:!?]*$"
#: Checksums by their next byte.
_STEPS = np.array([zlib.crc32(bytes([b ^ 255])) ^ 0xFF000000 for b in range(256)], dtype=np.uint32)


@dataclass(frozen=True)
class Training:
    #: Labelled rows of each label that training sees at most.
    rows: int = 3000
    #: Support that makes a feature toxic: toxic documents, different contexts, and the largest share of clean documents among all.
    min_documents: int = 6
    min_contexts: int = 6
    max_clean_share: float = 0.05
    #: Tokens of a chain (a longer text is several, end to end), chains of a step, and chains that a shard shuffles at a time.
    chain: int = 64
    group: int = 32
    ahead: int = 1024
    #: Parts of the sample that are trained side by side and averaged after each epoch.
    shards: int = 8
    dimensions: int = 1 << 20
    epochs: int = 4
    l2: float = 1e-6


@dataclass(frozen=True)
class Field:
    weights: np.ndarray  # of each hashed feature, for tag 1 against tag 0
    transition: np.ndarray  # 2 x 2, from tag to tag
    start: float
    calibration: tuple[float, float, float]


def held_out():
    """The rows that no training sees: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def token_features(token: str) -> list[str]:
    word = _EDGES.sub("", token.lower())
    if not word:
        return ["mark"]
    return ["w:" + word, *[f"p{n}:{word[:n]}" for n in (3, 4, 5, 6) if len(word) > n]]


#: Checksums that go on from a feature's kind.
_WORD, _MARK, _BIAS = (zlib.crc32(x) for x in (b"w:", b"mark", b"bias"))
_BEGINNINGS = [(n, zlib.crc32(b"p%d:" % n)) for n in (3, 4, 5, 6)]


def feature_places(token: str, dimensions: int) -> list[int]:
    """Checksums of :func:`token_features` and of the bias, without making their texts."""
    word = token.lower()
    if not (word[:1].isalnum() and word[-1:].isalnum()):
        word = _EDGES.sub("", word)
    if not word:
        return [_MARK % dimensions, _BIAS % dimensions]
    begun = [zlib.crc32(word[:n].encode("utf-8", "surrogatepass"), kind) for n, kind in _BEGINNINGS if len(word) > n]
    return [c % dimensions for c in (zlib.crc32(word.encode("utf-8", "surrogatepass"), _WORD), *begun, _BIAS)]


def _checksums(raw: np.ndarray, begin: np.ndarray, sizes: np.ndarray, kind: bytes) -> np.ndarray:
    """crc32 of ``kind`` and each of the byte strings, which come longest first."""
    now = np.full(len(begin), zlib.crc32(kind) ^ 0xFFFFFFFF, dtype=np.uint32)
    for i in range(int(sizes[0]) if len(sizes) else 0):
        alive = int(np.searchsorted(-sizes, -i, side="left"))
        part = now[:alive]
        now[:alive] = _STEPS[(part ^ raw[begin[:alive] + i]) & 255] ^ (part >> 8)
    return now ^ np.uint32(0xFFFFFFFF)


def plain_weights(tokens: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The weights of tokens like :data:`PLAIN`, summed over :func:`feature_places` in their order."""
    words = pc.ascii_rtrim(pc.ascii_lower(tokens), characters=".,;:!?")
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "")[0].as_buffer(), dtype=np.uint8)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
    total = weights[_checksums(raw, begin, sizes, b"w:") % len(weights)]
    for n in (3, 4, 5, 6):
        longer = int(np.searchsorted(-sizes, -n, side="left"))
        total[:longer] += weights[_checksums(raw, begin[:longer], np.full(longer, n), b"p%d:" % n) % len(weights)]
    total += weights[zlib.crc32(b"bias") % len(weights)]
    out = np.empty(len(total))
    out[order] = total
    return out


def training_sample(documents: DataFrame, labels: DataFrame, how: Training) -> DataFrame:
    """doc_id, text, toxic of at most ``how.rows`` rows a label; labels that are null or neither 0 nor 1, and held-out rows, are left out.

    Of several labels of an id the toxic one stands.
    """
    known = labels.select("doc_id", "toxic").filter(~held_out() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = known.filter("toxic = 1").orderBy(*order).limit(how.rows).unionByName(known.filter("toxic = 0").orderBy(*order).limit(how.rows))
    return written(documents.select("doc_id", "text").filter("text is not null").join(F.broadcast(picked), "doc_id"), "toxicity-sample")


def told_features(sample: DataFrame, how: Training) -> dict[str, bool]:
    """Features that tell a token's tag: toxic ones, and those that begin with one but aren't; see the module's text."""

    def in_documents(batches):
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for f in {f for token in set(text.split()) for f in token_features(token)}:
                    seen.setdefault(f, [0, 0])[toxic] += 1
            if len(seen) > 300_000:
                yield table(seen)
                seen = {}
        yield table(seen)

    def table(seen):
        columns = [list(seen), [n for n, _ in seen.values()], [n for _, n in seen.values()]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["feature", "clean", "toxic"])

    spread = sample.select("text", F.col("toxic").cast("int").alias("toxic"))
    counts = spread.mapInArrow(in_documents, "feature string, clean bigint, toxic bigint").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = written(counts.filter(F.col("clean") + F.col("toxic") >= how.min_documents), "toxicity-features")
    rare = F.col("clean") <= how.max_clean_share * (F.col("clean") + F.col("toxic"))
    suspects = counts.filter((F.col("toxic") >= how.min_documents) & rare)
    # The sample is bounded, so its features are.
    names = [r.feature for r in suspects.collect()]
    wanted = sample.sparkSession.sparkContext.broadcast(frozenset(names))

    def in_contexts(batches):
        known = wanted.value
        for batch in batches:
            pairs = set()
            for text in batch.column("text").to_pylist():
                tokens = text.split()
                for i, token in enumerate(tokens):
                    for f in token_features(token):
                        if f in known:
                            pairs.add((f, zlib.crc32(" ".join(tokens[max(0, i - 1) : i] + tokens[i + 1 : i + 2]).encode("utf-8", "surrogatepass"))))
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in pairs], pa.string()), pa.array([c for _, c in pairs], pa.int64())], names=["feature", "context"])

    # Copies repeat a word with its neighbours; an insult stands among different ones.
    contexts = spread.filter("toxic = 1").select("text").mapInArrow(in_contexts, "feature string, context bigint").distinct().groupBy("feature").count()
    toxic = {r.feature for r in contexts.filter(F.col("count") >= how.min_contexts).collect()}
    beginnings = sample.sparkSession.createDataFrame([(b,) for b in sorted({f.split(":", 1)[1] for f in toxic})], "beginning string")
    word = F.substring_index("feature", ":", -1)
    longer = counts.filter(~rare).select("feature", F.explode(F.array(*[F.when(F.length(word) > n, F.substring(word, 1, n)) for n in (3, 4, 5, 6)])).alias("beginning"))
    doubts = longer.join(F.broadcast(beginnings), "beginning").select("feature").distinct()
    return {r.feature: False for r in doubts.collect()} | dict.fromkeys(toxic, True)


def tag(token: str, told: dict[str, bool]) -> int:
    """1 if the longest feature that tells says toxic."""
    word, *parts = token_features(token)
    return int(next((told[f] for f in (word, *reversed(parts)) if f in told), False))


def training_chains(texts, told: dict[str, bool], size: int):
    """(places of features by token, tags) of chains of at most ``size`` tokens, end to end over the whole of each text."""
    tags: dict[str, int] = {}
    for text in texts:
        tokens = text.split()
        for at in range(0, len(tokens), size):
            chain = tokens[at : at + size]
            if len(tags) > CACHE:
                tags.clear()
            yield chain, [tags[t] if t in tags else tags.setdefault(t, tag(t, told)) for t in chain]


@dataclass
class Learner:
    """Weights and the sums of their squared slopes, which set the length of a step (Adagrad)."""

    weights: np.ndarray
    squares: np.ndarray
    transition: np.ndarray
    transition_squares: np.ndarray
    start: float
    start_square: float

    @classmethod
    def empty(cls, dimensions: int) -> Learner:
        return cls(np.zeros(dimensions), np.full(dimensions, 1e-8), np.zeros((2, 2)), np.full((2, 2), 1e-8), 0.0, 1e-8)

    def copied(self) -> Learner:
        return Learner(*[x.copy() if isinstance(x, np.ndarray) else x for x in vars(self).values()])

    def step(self, places: list[list[list[int]]], tags: list[list[int]], l2: float) -> np.ndarray:
        """One step on the conditional likelihood of some chains; gives the places that it changed."""
        n, length = len(tags), max(map(len, tags))
        y = np.zeros((n, length), dtype=np.int64)
        mask = np.zeros((n, length), dtype=bool)
        rows, columns, hashed = [], [], []
        for g, chain in enumerate(places):
            y[g, : len(chain)], mask[g, : len(chain)] = tags[g], True
            for t, ps in enumerate(chain):
                rows += [g] * len(ps)
                columns += [t] * len(ps)
                hashed += ps
        unary = np.zeros(y.shape)
        np.add.at(unary, (rows, columns), self.weights[hashed])
        p, pairs = _window_marginals(unary, self.transition, self.start, mask)
        slope = np.where(mask, y - p, 0.0) / n
        touched, at = np.unique(hashed, return_inverse=True)
        step = np.bincount(at, slope[rows, columns]) - l2 * self.weights[touched]
        self.squares[touched] += step**2
        self.weights[touched] += 0.5 * step / np.sqrt(self.squares[touched])
        both = mask[:, 1:] & mask[:, :-1]
        seen = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)], dtype=float)
        step = (seen - pairs) / n - 1e-3 * self.transition
        self.transition_squares += step**2
        self.transition += 0.2 * step / np.sqrt(self.transition_squares)
        step = float((y[:, 0] - p[:, 0]).mean()) - 1e-3 * self.start
        self.start_square += step**2
        self.start += 0.2 * step / np.sqrt(self.start_square)
        return touched

    def rows(self, places: np.ndarray) -> pa.RecordBatch:
        """place, weight, square; the transitions stand at -1 to -4 and the start at -5."""
        columns = (
            np.concatenate([places, [-1, -2, -3, -4, -5]]),
            np.concatenate([self.weights[places], self.transition.ravel(), [self.start]]),
            np.concatenate([self.squares[places], self.transition_squares.ravel(), [self.start_square]]),
        )
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.float64()), strict=True)], names=["place", "weight", "square"])

    def take(self, table: pa.Table) -> None:
        """The figures of :meth:`rows` at the places that ``table`` holds."""
        place, weight, square = (table.column(c).to_numpy() for c in ("place", "weight", "square"))
        own = place >= 0
        self.weights[place[own]], self.squares[place[own]] = weight[own], square[own]
        for p, w, q in zip(place[~own], weight[~own], square[~own], strict=True):
            if p == -5:
                self.start, self.start_square = float(w), float(q)
            else:
                self.transition.flat[-p - 1], self.transition_squares.flat[-p - 1] = w, q


def train(sample: DataFrame, told: dict[str, bool], how: Training) -> Learner:
    """A learner that has seen the sample's whole texts ``epochs`` times.

    Documents are dealt to ``shards`` by a hash of their ids. In each epoch every shard goes on from the common weights over
    all its tokens, and the means over the shards that changed a weight are the next common ones (iterative parameter
    mixing). Texts stay on the executors; at most ``dimensions`` weights come back, whatever the texts' lengths.
    """
    context = sample.sparkSession.sparkContext
    marks = context.broadcast(told)
    drawn = F.xxhash64("doc_id", F.lit(how.shards))  # not the order by which the sample was taken
    dealt = sample.select(F.pmod(drawn, F.lit(how.shards)).alias("shard"), drawn.alias("drawn"), "text").repartition(how.shards, "shard").sortWithinPartitions("shard", "drawn", "text")
    learner = Learner.empty(how.dimensions)
    for epoch in range(how.epochs):
        common = context.broadcast(learner)

        def run(batches, common=common, epoch=epoch):
            known: dict[str, list[int]] = {}

            def places(token):
                if len(known) > CACHE:
                    known.clear()
                found = known.get(token)
                return found if found is not None else known.setdefault(token, feature_places(token, how.dimensions))

            texts = ((s, t) for batch in batches for s, t in zip(batch.column("shard").to_pylist(), batch.column("text").to_pylist(), strict=True))
            for shard, rows in groupby(texts, itemgetter(0)):
                own, rng, changed = common.value.copied(), np.random.default_rng((7, epoch, shard)), np.zeros(how.dimensions, dtype=bool)
                chains = training_chains((t for _, t in rows), marks.value, how.chain)
                while ahead := list(islice(chains, how.ahead)):
                    order = rng.permutation(len(ahead))
                    for at in range(0, len(order), how.group):
                        group = [ahead[i] for i in order[at : at + how.group]]
                        changed[own.step([[places(t) for t in chain] for chain, _ in group], [tags for _, tags in group], how.l2)] = True
                yield own.rows(np.flatnonzero(changed))

        mean = lambda c: (F.aggregate(F.array_sort(F.collect_list(c)), F.lit(0.0), lambda x, y: x + y) / F.count(F.lit(1))).alias(c)  # noqa: E731  # in one order, so in one result
        learner.take(dealt.select("shard", "text").mapInArrow(run, "place bigint, weight double, square double").groupBy("place").agg(mean("weight"), mean("square")).toArrow())
        common.unpersist()
    return learner


def _window_marginals(unary: np.ndarray, transition: np.ndarray, start: float, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over rows of one length: chance of tag 1 at each place, and expected transitions of all rows."""
    n, length = unary.shape
    move = np.exp(transition)
    local = np.stack([np.ones_like(unary), np.exp(np.clip(unary, -40, 40))], axis=2)
    forward, backward = np.zeros((n, length, 2)), np.ones((n, length, 2))
    forward[:, 0] = local[:, 0] * np.array([1.0, np.exp(start)])
    forward[:, 0] /= forward[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, length):
        step = (forward[:, t - 1] @ move) * local[:, t]
        forward[:, t] = np.where(mask[:, t, None], step / step.sum(axis=1, keepdims=True), forward[:, t - 1])
    for t in range(length - 2, -1, -1):
        step = (local[:, t + 1] * backward[:, t + 1]) @ move.T
        backward[:, t] = np.where(mask[:, t + 1, None], step / step.sum(axis=1, keepdims=True), 1.0)
    both = forward * backward
    p = both[:, :, 1] / both.sum(axis=2)
    pairs = np.zeros((2, 2))
    for t in range(1, length):
        joint = forward[:, t - 1, :, None] * move[None] * (local[:, t] * backward[:, t])[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        pairs += joint[mask[:, t]].sum(axis=0)
    return p, pairs


def marginals(unary: np.ndarray, starts: np.ndarray, transition: np.ndarray, start: float) -> np.ndarray:
    """Chance of tag 1 at every token of texts that lie end to end; ``starts`` holds each text's first place.

    The forward and backward ratios of the two tags obey r[t] = f(r[t-1]). They are found for all places at once by
    repeating f until nothing changes; the chain forgets fast, so a few rounds do. Where it doesn't, products of the steps'
    matrices are doubled over all places, in as many rounds as the length has binary digits.
    """
    n = len(unary)
    if not n:
        return np.zeros(0)
    move, local = np.exp(transition), np.exp(np.clip(unary, -40, 40))
    first = np.zeros(n, dtype=bool)
    first[starts] = True
    last = np.append(first[1:], True)
    after = np.append(local[1:], 1.0)
    one = np.ones(n)
    forward = (local * move[1, 1], local * move[0, 1], one * move[1, 0], one * move[0, 0], local * np.exp(start))
    backward = (after * move[1, 1], one * move[1, 0], after * move[0, 1], one * move[0, 0], one)
    odds = _ratios(forward, first) * _ratios(tuple(x[::-1] for x in backward), last[::-1])[::-1]
    return odds / (1 + odds)


def _ratios(step: tuple[np.ndarray, ...], anew: np.ndarray, rounds: int = 24) -> np.ndarray:
    """r[t] = (a r[t-1] + b) / (c r[t-1] + d), and r[t] = e where a text begins ``anew``."""
    a, b, c, d, e = step
    r = np.where(anew, e, a / c)
    for _ in range(rounds):
        before = np.append(1.0, r[:-1])
        new = np.where(anew, e, (a * before + b) / (c * before + d))
        done = np.allclose(new, r, rtol=1e-7, atol=1e-14)
        r = new
        if done:
            return r
    # Products of all steps since a text's beginning; there the matrix gives one ratio whatever comes in.
    whole = np.stack([np.where(anew, e, a), np.where(anew, e, b), np.where(anew, 1.0, c), np.where(anew, 1.0, d)], axis=1).reshape(-1, 2, 2)
    whole /= whole.sum(axis=(1, 2), keepdims=True)
    reach = 1
    while reach < len(whole):
        whole[reach:] = whole[reach:] @ whole[:-reach].copy()
        whole /= whole.sum(axis=(1, 2), keepdims=True)
        reach *= 2
    return whole[:, 0].sum(axis=1) / whole[:, 1].sum(axis=1)


class Tagger:
    """Marginals of whole texts; remembers a token's weight, in bounded memory."""

    def __init__(self, field: Field):
        self.field = field
        self.known: dict[str, float] = {}
        # Single figures come faster from here than from an array.
        self.single = memoryview(field.weights)

    def _learn(self, tokens: list[str]) -> None:
        """Remembers the weights of tokens that are not known."""
        if len(self.known) >= CACHE:
            self.known.clear()
        weights = self.field.weights
        ascii_ones = [t for t in tokens if t.isascii()]
        column = pa.array(ascii_ones, pa.string())
        plain = pc.match_substring_regex(column, PLAIN)
        found = column.filter(plain)
        self.known.update(zip(found.to_pylist(), plain_weights(found, weights).tolist(), strict=True))
        for token in tokens:
            if token not in self.known:
                total = 0.0
                for place in feature_places(token, len(weights)):
                    total += self.single[place]
                self.known[token] = total

    def _unary(self, tokens: list[str]) -> np.ndarray:
        unary = np.array(list(map(self.known.get, tokens)), dtype=float)  # NaN where it isn't known
        if len(holes := np.flatnonzero(np.isnan(unary))):
            missing = [tokens[i] for i in holes.tolist()]
            self._learn(list(dict.fromkeys(missing)))
            unary[holes] = list(map(self.known.__getitem__, missing))
        return unary

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        unary, sizes, ahead = [], [], []
        for text in texts:
            tokens = text.split()
            sizes.append(len(tokens))
            ahead += tokens
            if len(ahead) >= TOKENS_AT_ONCE:
                unary.append(self._unary(ahead))
                ahead = []
        unary.append(self._unary(ahead))
        ends = np.cumsum(sizes)
        starts = np.array([e - s for e, s in zip(ends, sizes, strict=True) if s], dtype=np.int64)
        return np.split(marginals(np.concatenate(unary), starts, self.field.transition, self.field.start), ends[:-1]) if texts else []


def evidence(p: np.ndarray) -> tuple[float, float]:
    """Of a text's marginals: the log odds of the largest, and the log of one plus their sum over the toxic ones."""
    top = min(max(float(p.max()) if len(p) else 0.0, 1e-6), 1 - 1e-6)
    return float(np.log(top / (1 - top))), float(np.log1p(p[p >= 0.5].sum())) if len(p) else 0.0


def calibrate(rows: list[tuple[float, float, int]]) -> tuple[float, float, float]:
    """A logistic of the two figures by Newton steps, with a small ridge; labels weigh alike in sum."""
    if not rows:
        return (-3.0, 1.0, 0.0)
    x = np.array([[1.0, a, b] for a, b, _ in rows])
    y = np.array([t for *_, t in rows], dtype=float)
    balance = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (balance * p * (1 - p))[:, None]).T @ x + np.eye(3)
        w += np.linalg.solve(hessian, x.T @ (balance * (y - p)) - w)
    return tuple(float(v) for v in w)


def fit(documents: DataFrame, labels: DataFrame, how: Training = Training()) -> Field:
    """The field and its calibration from labelled rows that aren't held out; without any, one that finds nothing."""
    sample = training_sample(documents, labels, how)
    learned = train(sample, told_features(sample, how), how)
    weights, transition, start = learned.weights, learned.transition, learned.start
    field = sample.sparkSession.sparkContext.broadcast(Field(weights, transition, start, (0.0, 0.0, 0.0)))

    def make():
        tagger = Tagger(field.value)

        def of_texts(texts):
            found = [evidence(p) for p in tagger(texts)]
            return [[a for a, _ in found], [b for _, b in found]]

        return of_texts

    rows = map_texts(sample, make, {"top": "double", "amount": "double"}, keep=("toxic",)).collect()
    return Field(weights, transition, start, calibrate(sorted((r.top, r.amount, int(r.toxic)) for r in rows)))


FIELDS = {"score": "double", "predicted": "int", "n_toxic": "bigint", "toxic_spans": "string"}


def _score(documents: DataFrame, field: Field, threshold: float):
    shared = documents.sparkSession.sparkContext.broadcast(field)

    def make():
        tagger = Tagger(shared.value)
        w0, w1, w2 = shared.value.calibration

        def of_texts(texts):
            out = [[] for _ in FIELDS]
            for text, p in zip(texts, tagger(texts), strict=True):
                top, amount = evidence(p)
                value = float(1 / (1 + np.exp(-np.clip(w0 + w1 * top + w2 * amount, -30, 30))))
                hits = np.flatnonzero(p >= 0.5)
                places = [m.span() for m in re.finditer(r"\S+", text)] if len(hits) else []
                for column, x in zip(out, (value, int(value >= threshold), len(hits), ",".join(f"{places[i][0]}:{places[i][1]}" for i in hits)), strict=True):
                    column.append(x)
            return out

        return of_texts

    return make


def score(documents: DataFrame, field: Field, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted (1 from ``threshold`` on), the number of toxic tokens and their ``start:end`` offsets of each row.

    Offsets count code points, ends are exclusive. A null or empty text has no tokens and the score of no evidence;
    repeated rows each get their row; an empty table gives no rows.
    """
    return map_texts(documents, _score(documents, field, threshold), FIELDS)


def clean(documents: DataFrame, field: Field, threshold: float = 0.7) -> DataFrame:
    """The rows of ``documents`` that are predicted 0, columns as they were."""
    scorer = _score(documents, field, threshold)

    def make():
        of_texts = scorer()
        return lambda texts: [[p == 0 for p in of_texts(texts)[1]]]

    return map_texts(documents, make, {"__clean": "boolean"}, keep=documents.columns, where="__clean").drop("__clean")
