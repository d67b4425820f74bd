"""Toxicity: a support vector machine over a subsequence string kernel, with Nyström landmarks.

The kernel compares two chunks (words, or letters spaced out into single characters) by the character
subsequences they share. Gaps are allowed and weigh less the longer they are, so an insult with
letters put in between is still close to the insult. A text is looked at in windows of a fixed number of
chunks. A window is judged by its worst chunk and by the next two, since one chance likeness says less
than several, and a text by its worst window, so that no amount of harmless text around an insult hides it.

Training takes sentences labelled as their documents are. In a toxic document only some sentences are
toxic, so the toxic examples are the chunks that distinct toxic sentences have significantly more
often and clean ones hardly ever, also with characters put in. Chunks are mapped by their kernel values with a few landmark chunks (Nyström), where a linear machine
is fitted. As subsequences have a fixed length, the machine's decision is one weight per subsequence,
which is what the executors apply: the same value, without a kernel per landmark.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passages.llm.samples import about
from passages.session import broadcast_if_small
from passages.sources.tables import stage

# Length of the subsequences, and the weight of each step they span.
ORDER = 3
DECAY = 0.7
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789àáâäçèéêëíîïñóôöùúûüß"
CODES = 64
# Stand for a chunk's beginning and end, which tell a stem from the same letters within a word.
START, END = "\x02", "\x03"
# Longer chunks are taken in overlapping pieces of this many characters.
WIDEST = 16
# Bounds of the model: labelled rows of each class, clean chunks, landmarks.
TRAINING_ROWS = 4_000
CLEAN_CHUNKS = 6_000
TOXIC_CHUNKS = 2_000
LANDMARKS = 96
# Least share of toxic ones among the sentences of a toxic chunk.
PURITY = 0.9
# Chunks of a window, how far windows are apart, and the next chunks that count beside the worst one.
WINDOW = 300
STEP = 150
LOOKED_AT = 2
# Decisions on chunks that a task remembers, and rows of chunks it hands on at once.
REMEMBERED = 150_000
HANDED_ON = 50_000

_CODE = {c: i + 1 for i, c in enumerate(LETTERS + START + END)}
_OTHER = CODES - 1
_SENTENCE_END = re.compile(r"[.!?\n]+")


def clean(token: str) -> str:
    """A token's letters and digits only."""
    return token if token.isalnum() else "".join(filter(str.isalnum, token))


def chunks_of(text: str) -> list[str]:
    """Lower-cased chunks: tokens, and every run of three or more one-letter tokens joined."""
    tokens = text.lower().split()
    found = tokens.copy()
    if sum(len(t) == 1 for t in tokens) >= 3:
        run: list[str] = []
        for token in [*tokens, "  "]:
            if len(token) == 1:
                run.append(token)
            elif run:
                if len(run) >= 3:
                    found.append("".join(run))
                run = []
    return found


def marked(word: str) -> str:
    return START + word + END if word else ""


def _pieces(word: str) -> list[str]:
    """The word, or overlapping pieces of a long one."""
    if len(word) <= WIDEST:
        return [word]
    return [word[i : i + WIDEST] for i in range(0, len(word) - WIDEST // 2, WIDEST // 2)]


def _counted(words: dict[str, float]) -> dict[str, float]:
    """Counts of the pieces of marked words, those of equal pieces added up."""
    counts: dict[str, float] = {}
    for word, n in sorted(words.items()):
        for piece in _pieces(marked(word)):
            counts[piece] = counts.get(piece, 0.0) + n
    return counts


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, codes) of the words of each length that has subsequences, some thousand at a time."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths[lengths >= ORDER]).tolist():
        own = np.nonzero(lengths == length)[0]
        for some in np.array_split(own, -(-len(own) // 2048)):
            codes = [[_CODE.get(c, _OTHER) for c in words[i]] for i in some.tolist()]
            yield some, np.array(codes, np.int64)


@cache
def _places(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all subsequences in a word of this length, and their weights."""
    at = np.array(list(combinations(range(length), ORDER)))
    return at, DECAY ** (at[:, -1] - at[:, 0] + 1.0)


@cache
def _decays(length: int) -> np.ndarray:
    """decays[i, j] is the weight of the gap between positions i < j."""
    step = np.arange(length)[None, :] - np.arange(length)[:, None]
    return np.where(step > 0, DECAY ** np.maximum(step - 1.0, 0), 0)


def _subsequences(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, weights = _places(codes.shape[1])
    number = np.zeros((len(codes), len(at)), np.int64)
    for k in range(ORDER):
        number = number * CODES + codes[:, at[:, k]]
    return number, weights


def self_kernel(codes: np.ndarray) -> np.ndarray:
    """Kernel of each word with itself, by the usual recursion over its prefixes."""
    decays = _decays(codes.shape[1])
    same = (codes[:, :, None] == codes[:, None, :]) * DECAY**2
    value = same
    for _ in range(ORDER - 1):
        before = (value @ decays).swapaxes(1, 2) @ decays
        value = same * before.swapaxes(1, 2)
    return value.sum(axis=(1, 2))


def weigh(words: list[str], table: np.ndarray) -> np.ndarray:
    """Sum over each word's subsequences of weight times table entry, divided by the word's norm.

    With a landmark's own features as the table this is the normalised kernel, up to the landmark's norm.
    """
    out = np.zeros(len(words))
    for some, codes in _by_length(words):
        number, weights = _subsequences(codes)
        out[some] = table[number] @ weights / np.sqrt(self_kernel(codes))
    return out


def features(word: str) -> np.ndarray:
    """The word's normalised weight for every subsequence."""
    table = np.zeros(CODES**ORDER)
    for _, codes in _by_length([word]):
        number, weights = _subsequences(codes)
        np.add.at(table, number[0], weights / np.sqrt(self_kernel(codes)[0]))
    return table


class Landmarks:
    """Kernel values with a few chunks. Only the subsequences that occur in one of them are held."""

    def __init__(self, words: list[str]):
        held = []
        for word in words:
            number, value = np.zeros(0, np.int64), np.zeros(0)
            for _, codes in _by_length([word]):
                numbers, weights = _subsequences(codes)
                number, at = np.unique(numbers[0], return_inverse=True)
                value = np.bincount(at, weights / np.sqrt(self_kernel(codes)[0]))
            held.append((number, value))
        self.numbers = np.unique(np.concatenate([n for n, _ in held])) if held else np.zeros(0, np.int64)
        self.rows = np.zeros((len(words), len(self.numbers) + 1))
        for row, (number, value) in zip(self.rows, held, strict=True):
            row[np.searchsorted(self.numbers, number)] = value
        self.places = np.full(CODES**ORDER, len(self.numbers), np.int32)
        self.places[self.numbers] = np.arange(len(self.numbers))

    def likeness(self, words: list[str]) -> np.ndarray:
        """Normalised kernel of each word with each landmark."""
        out = np.zeros((len(words), len(self.rows)))
        for some, codes in _by_length(words):
            number, weights = _subsequences(codes)
            places, norms = self.places[number], np.sqrt(self_kernel(codes))
            for j, row in enumerate(self.rows):
                out[some, j] = row[places] @ weights / norms
        return out

    def weights(self, factors: np.ndarray) -> np.ndarray:
        """One weight per subsequence: the sum of the landmarks' features, each times its factor."""
        table = np.zeros(CODES**ORDER)
        table[self.numbers] = (factors @ self.rows)[:-1]
        return table


@dataclass
class ToxicityModel:
    """weights of subsequences and bias decide on a chunk; slopes and shift turn a text's decisions into a score.

    The weights are the sum of the landmarks' features, each times its factor.
    """

    weights: np.ndarray
    bias: float
    slopes: tuple[float, ...] = (1.0, 0.0)
    shift: float = 0.0
    landmarks: tuple[str, ...] = ()
    factors: tuple[float, ...] = ()
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "weights": self.weights.astype(np.float32), "known": {}}

    def decide(self, words: list[str]) -> np.ndarray:
        """Decision of each word; a long one has that of its worst piece."""
        pieces = [_pieces(w) for w in words]
        flat = [p for ps in pieces for p in ps]
        values = weigh(flat, self.weights) + self.bias
        starts = np.concatenate([[0], np.cumsum([len(p) for p in pieces])[:-1]]).astype(np.int64)
        return np.maximum.reduceat(values, starts) if len(values) else values

    def worst(self, texts: Iterable[str | None]) -> np.ndarray:
        """(decision of the worst chunk, mean of the next two) of each text's worst window.

        A single chunk stands for the next ones too, the bias for a text without any.
        """
        out = []
        for some in _portions(texts):
            held = [chunks_of(t) for t in some]
            if len(self.known) > REMEMBERED:
                self.known.clear()
            new = list(dict.fromkeys(c for chunks in held for c in chunks if c not in self.known))
            if new:
                self.known.update(zip(new, self.decide([marked(clean(c)) for c in new]).tolist(), strict=True))
            out += map(self._top, held)
        return np.array(out).reshape(-1, 2)

    def _top(self, chunks: list[str]) -> tuple[float, float]:
        if not chunks:
            return self.bias, self.bias
        found = np.fromiter(map(self.known.__getitem__, chunks), float, len(chunks))
        if len(found) > WINDOW:
            starts = np.arange(0, len(found) - STEP, STEP)
            places = starts[:, None] + np.arange(WINDOW)[None, :]
            found = np.append(found, -np.inf)[np.minimum(places, len(found))]
        else:
            found = found[None, :]
        count = 1 + LOOKED_AT
        top = np.sort(np.partition(found, -count, axis=1)[:, -count:] if found.shape[1] > count else found, axis=1)
        worst = top[:, -1]
        after = top[:, :-1].mean(axis=1) if top.shape[1] > 1 else worst
        at = int(np.argmax(worst + after))
        return worst[at], after[at]

    def score(self, decisions: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(decisions @ np.array(self.slopes) + self.shift, -30, 30)))


def _portions(texts: Iterable[str | None], size: int = 1 << 20) -> Iterator[list[str]]:
    """The texts in order, so many at a time that their chunks need bounded memory."""
    some, held = [], 0
    for text in texts:
        some.append(text or "")
        held += len(some[-1])
        if held >= size:
            yield some
            some, held = [], 0
    yield some


def _fit_line(points: np.ndarray, labels: np.ndarray, weights: np.ndarray, strength: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on the points within the margin."""
    wide = np.hstack([points, np.ones((len(points), 1))])
    normal = np.zeros(wide.shape[1])
    ridge = np.eye(len(normal)) * strength
    ridge[-1, -1] = 1e-9
    for _ in range(50):
        inside = labels * (wide @ normal) < 1
        x, w = wide[inside], weights[inside]
        moved = np.linalg.solve(ridge + (x * w[:, None]).T @ x, (x * w[:, None]).T @ labels[inside])
        if np.allclose(moved, normal, atol=1e-9):
            break
        normal = moved
    return normal[:-1], float(normal[-1])


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Slopes, none below 0, and shift of a logistic curve with both classes weighing the same, lightly held back."""
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    used = np.ones(x.shape[1], bool)
    while True:
        wide = np.hstack([x * used, np.ones((len(x), 1))])
        hold = np.diag([*np.full(x.shape[1], 1e-3), 1e-9])
        line = np.zeros(wide.shape[1])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(wide @ line, -30, 30)))
            slope = wide.T @ (share * (p - y)) + hold @ line
            curve = (wide * (share * p * (1 - p))[:, None]).T @ wide + hold
            step = np.clip(np.linalg.solve(curve, slope), -5, 5)
            line = line - step
            if np.abs(step).max() < 1e-9:
                break
        if (line[:-1] >= 0).all() or not used.any():
            return tuple(np.maximum(line[:-1], 0).tolist()), float(line[-1])
        used &= line[:-1] > 0


def _landmarks(toxic: list[str], toxic_weight: np.ndarray, harmless: list[str], count: int) -> list[str]:
    """Half toxic chunks, the most frequent ones unlike those already taken, and half the harmless ones closest to them."""
    taken: list[str] = []
    closest = np.zeros(len(toxic))
    while len(taken) < min(count // 2, len(toxic)):
        best = int(np.argmax(toxic_weight * (1 - np.clip(closest, 0, 1))))
        if toxic[best] in taken or closest[best] > 0.999:
            break
        taken.append(toxic[best])
        closest = np.maximum(closest, weigh(toxic, features(toxic[best])))
    near = np.zeros(len(harmless))
    for word in taken:
        near = np.maximum(near, weigh(harmless, features(word)))
    return taken + [harmless[i] for i in np.argsort(-near, kind="stable")[: count - len(taken)]]


def fit(toxic: dict[str, float], harmless: dict[str, float], landmarks: int = LANDMARKS) -> ToxicityModel:
    """Machine that tells toxic chunks from harmless ones; both are given with their counts."""
    bad, good = _counted(toxic), _counted(harmless)
    # A piece of words of both kinds is toxic if nearly all of them are.
    bad = {p: n for p, n in bad.items() if n >= PURITY * (n + good.get(p, 0.0))}
    good = {p: n for p, n in good.items() if p not in bad}
    if not bad:
        return ToxicityModel(np.zeros(CODES**ORDER), -1.0, shift=-3.0)
    marks = _landmarks(list(bad), np.sqrt(list(bad.values())), list(good), landmarks)
    held = Landmarks(marks)
    kernel = held.likeness(marks)
    values, vectors = np.linalg.eigh((kernel + kernel.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    grown = [(p, n) for w, n in bad.items() for v in with_insertions(w) for p in _pieces(v)]
    words = [v for v, _ in grown] + list(good)
    points = held.likeness(words) @ root
    labels = np.concatenate([np.ones(len(grown)), -np.ones(len(good))])
    weights = np.sqrt([n for _, n in grown] + list(good.values()))
    for own in (labels > 0, labels < 0):
        weights[own] /= max(weights[own].sum(), 1e-9)
    normal, bias = _fit_line(points, labels, weights)
    factors = root @ normal
    return ToxicityModel(held.weights(factors), bias, landmarks=tuple(marks), factors=tuple(factors.tolist()))


def _sentence_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, sentence, chunk): the distinct chunks of every sentence, which is given by its hash."""
    def packed() -> pa.RecordBatch:
        columns = [pa.array(toxic, pa.int32()), pa.array(sentences, pa.int64()), pa.array(chunks, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["toxic", "sentence", "chunk"])

    for batch in batches:
        toxic, sentences, chunks = [], [], []
        for label, text in zip(*batch.columns, strict=True):
            for sentence in _SENTENCE_END.split(text.as_py() or ""):
                found = {c for c in map(clean, chunks_of(sentence)) if len(c) >= ORDER}
                toxic += [label.as_py()] * len(found)
                sentences += [xxhash.xxh64_intdigest(sentence.strip()) >> 1] * len(found)
                chunks += found
                if len(chunks) >= HANDED_ON:
                    yield packed()
                    toxic, sentences, chunks = [], [], []
        yield packed()


def with_insertions(word: str) -> list[str]:
    """The word, and the word with a character put in at some of its places."""
    places = sorted({2, len(word) // 2, len(word) - 2})
    return [word, *(word[:i] + "x" + word[i:] for i in places)]


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    training_rows: int = TRAINING_ROWS, clean_chunks: int = CLEAN_CHUNKS, landmarks: int = LANDMARKS,
    purity: float = PURITY,
) -> ToxicityModel:
    """Model from the texts of the labelled documents.

    About ``training_rows`` labelled rows of each class are used, or all of fewer; the kernel machine
    sees at most twice ``clean_chunks`` clean chunks and ``TOXIC_CHUNKS`` toxic ones, of whose
    sentences at least the share ``purity`` is toxic. Rows with a null label, text or key are left
    out, repeated labels and sentences count once. Without toxic chunks every text gets a low score.
    """
    named = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(label).cast("int").alias("toxic")).distinct()
    chosen = broadcast_if_small(about(named.where(F.col("key").isNotNull()), "toxic", training_rows, "key"))
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = stage(texts.join(chosen, "key").select("toxic", "text"), "toxicity-rows")
    chunks = stage(rows.mapInArrow(_sentence_chunks, "toxic int, sentence bigint, chunk string").distinct(), "toxicity-chunks")
    bad, good = F.count(F.when(F.col("toxic") == 1, 1)), F.count(F.when(F.col("toxic") == 0, 1))
    stats = stage(chunks.groupBy("chunk").agg(bad.alias("bad"), good.alias("good")), "toxicity-stats")
    total = stats.agg(F.count(F.lit(1)).alias("chunks"), F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    if not total.bad or not total.good:
        return fit({}, {}, landmarks)
    # Surprise: how unlikely the toxic share of a chunk's sentences would be by chance, in nats.
    chance = total.bad / (total.bad + total.good)
    n = F.col("bad") + F.col("good")
    share = F.col("bad") / n
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - chance))).otherwise(0.0)
    surprise = n * (F.when(share > 0, share * F.log(share / chance)).otherwise(0.0) + rest)
    telling = stats.where((share >= max(purity, chance)) & (surprise >= float(np.log(100 * total.chunks))))
    toxic = {r.chunk: float(r.bad) for r in telling.orderBy(F.desc("bad"), "chunk").limit(TOXIC_CHUNKS).collect()}
    clean_only = stats.where((F.col("good") > 0) & (share < 0.5))
    frequent = clean_only.orderBy(F.desc("good"), "chunk").limit(clean_chunks)
    mixed = clean_only.orderBy(F.xxhash64("chunk"), "chunk").limit(clean_chunks)
    harmless = {r.chunk: float(r.good) for part in (frequent, mixed) for r in part.collect()}
    model = fit(toxic, harmless, landmarks)
    if toxic:
        judged = decisions(rows, model, "toxic").select("toxic", "decision", "next").toPandas()
        points = judged[["decision", "next"]].to_numpy(float)
        model.slopes, model.shift = _fit_logistic(points, judged.toxic.to_numpy(float))
    return model


def decisions(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, decision, next, score) of every row: see ToxicityModel.worst. The key may be of any type."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.worst(t.as_py() for t in batch.column(1))
            numbers = [found[:, 0], found[:, 1], shared.value.score(found)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(n, pa.float64()) for n in numbers)], ["key", "decision", "next", "score"]
            )

    schema = T.StructType(
        [T.StructField("key", docs.schema[key].dataType)]
        + [T.StructField(name, T.DoubleType()) for name in ("decision", "next", "score")]
    )
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(judge, schema).withColumnRenamed("key", key)


def without_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Rows of ``docs``, with all their columns as they are, that the model does not call toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.worst(t.as_py() for t in batch.column(at))
            yield batch.filter(pa.array(shared.value.score(found) < 0.5))

    return docs.mapInArrow(keep, docs.schema)


def toxicity(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) of every row; a null text counts as empty."""
    found = decisions(docs, model, key, text)
    return found.select(key, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
