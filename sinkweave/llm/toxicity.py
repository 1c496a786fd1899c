"""Toxicity: a subsequence-kernel support vector machine with Nystroem landmarks.

Two words are alike by the character triples they share as subsequences: a triple may skip up to two
inserted characters and counts less the wider it lies (``DECAY`` per skipped character). Word starts
and ends count as characters. The kernel of two words is the inner product of their triples to POWER,
that of two sentences the sum over their words (see ``WordKernel``). Landmarks are words and word
stems that tell labelled toxic documents from clean ones; a sentence's kernel values at the landmarks,
times the inverse root of the landmarks' own kernel, are the Nystroem features of a linear SVM.

Labels are of documents, so the SVM learns which sentences of a toxic document are toxic: it starts
from those near a landmark and keeps the ones that it scores as toxic, and each document's highest.
A document's decision is that of its highest sentence; a sigmoid fitted to the labels turns it into
a score.

Fitting takes a bounded sample of labelled documents (``MAX_PER_CLASS`` of each class, the first by
a hash of their id, each of at most ``MAX_TRAIN_CHARS`` characters) to the driver. Scoring reads
every whole text, in Spark's Python workers, row by row.

Defined results: null and empty texts score like a sentence without words; without labels of both
classes every score is the share of toxic labels (0 if there are none); null labels are ignored, of
several labels of one document the largest counts; repeated rows get the same score; other columns
are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PER_CLASS = 1500
MAX_TRAIN_CHARS = 100_000
N_LANDMARKS = 96
STEM_LENGTHS = range(4, 11)
#: A stem is worth a landmark if it adds this share of the toxic documents, decayed by those that cover them.
LEAST_GAIN = 0.004
#: Of a stem's gain, what a longer form must keep; of a landmark, what makes a sentence near it.
NEARLY = 0.8
SPAN = 5
DECAY = 0.6
POWER = 4
FLOOR = 0.05
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
#: Words whose value a worker remembers.
CACHE_WORDS = 400_000
#: A word with symbols inside it, or the end of a sentence.
_TOKEN = re.compile(r"\w+(?:[^\w\s]\w+)*|[.!?]+(?=\s|$)|\n")
#: Letters spelled out one by one.
_SPELLED = re.compile(r"(?<!\w)(?:[^\W\d_][\W_]{1,2}){3,}[^\W\d_](?!\w)")
_LEET = str.maketrans("013457", "oieast")
_BEYOND = re.compile("[^\0-\uffff]")
_NOT_LETTER = re.compile(r"[\W_]+")
_OFFSETS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _is_end(token: str) -> bool:
    return token[0] in ".!?\n"


def _plain(token: str) -> str:
    """Symbols inside a word dropped, digits between letters read as the letters they stand for."""
    word = token if token.isalnum() else _NOT_LETTER.sub("", token)
    return word.translate(_LEET) if not word.isalpha() and not word.isdigit() else word


def tokens(text: str | None) -> list[str]:
    lowered = (text or "").lower()
    lowered = _SPELLED.sub(lambda m: _NOT_LETTER.sub("", m[0]), lowered)
    return _TOKEN.findall(lowered)


class WordKernel:
    """Kernel values of words at fixed landmarks.

    A word's features are its triples, each with the weight of its tightest occurrence; a landmark is
    the point ``features / their squared length``, so a word that holds a landmark whole has the inner
    product 1 with it. The kernel is that inner product to POWER: symmetric and positive
    semidefinite, as any power of an inner product is. Words near nothing are left out by FLOOR."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        code = {c: k for k, c in enumerate(sorted({c for z in landmarks for c in z if c < "\uffff"}), 1)}
        self.base = len(code) + 1
        self.codes = np.zeros(1 << 16, dtype=np.int32)
        for c, k in code.items():
            self.codes[ord(c)] = k
        triples: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(len(landmarks)))
        for m, z in enumerate(landmarks):
            codes = [code.get(c, 0) for c in z]
            for at, first in enumerate(codes):
                for i, j in _OFFSETS:
                    if at + j < len(codes):
                        weights = triples[(first * self.base + codes[at + i]) * self.base + codes[at + j]]
                        weights[m] = max(weights[m], DECAY ** (j - 2))
        points = np.array([triples[t] for t in sorted(triples)]).reshape(len(triples), len(landmarks))
        points /= np.maximum(1e-9, (points**2).sum(axis=0))
        #: kernel values of the landmarks at each other
        self.inner = (points.T @ points) ** POWER
        self.row = np.zeros(self.base**3, dtype=np.int32)
        self.row[sorted(triples)] = np.arange(1, len(triples) + 1)
        self.values = np.r_[np.zeros((1, len(landmarks))), points].astype(np.float32)

    def __call__(self, words: list[str]) -> np.ndarray:
        """(word, landmark) -> kernel value; words carry their start and end marks."""
        words = [w if w.isascii() else _BEYOND.sub("\0", w) for w in words]
        lengths = np.array([len(w) for w in words])
        codes = self.codes[np.frombuffer("".join(words).encode("utf-16-le", "surrogatepass"), dtype="<u2")]
        word = np.repeat(np.arange(len(words), dtype=np.int64), lengths)
        out = np.zeros((len(words), self.values.shape[1]), dtype=np.float32)
        found, weights = [], []
        for i, j in _OFFSETS:  # tighter ones first
            if len(codes) > j:
                row = self.row[(codes[: len(codes) - j] * self.base + codes[i : len(codes) - j + i]) * self.base + codes[j:]]
                at = np.flatnonzero((row > 0) & (word[: len(word) - j] == word[j:]))
                found.append(word[at] * len(self.values) + row[at])
                weights.append(np.full(len(at), DECAY ** (j - 2), dtype=np.float32))
        if found and sum(map(len, found)):
            held, tightest = np.unique(np.concatenate(found), return_index=True)
            owner, row = np.divmod(held, len(self.values))
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            out[owner[first]] = np.add.reduceat(self.values[row] * np.concatenate(weights)[tightest, None], first, axis=0)
        out = out**POWER
        out[out < FLOOR] = 0
        return out


class Model:
    """A fitted scorer: constant if there was nothing to learn from."""

    def __init__(self, kernel: WordKernel | None, alpha=None, bias: float = 0.0, slope: float = 0.0, shift: float = 0.0, constant: float = 0.0):
        self.kernel, self.alpha, self.bias, self.slope, self.shift, self.constant = kernel, alpha, bias, slope, shift, constant
        self.known: set[str] = set()
        self.near: dict[str, np.ndarray] = {}
        self.hot: set[str] = set()

    def __getstate__(self):
        return self.__dict__ | {"known": set(), "near": {}, "hot": set()}

    def look_up(self, seen: set[str]) -> set[str]:
        """Those tokens that are near any landmark; remembered, within a bound."""
        new = seen - self.known
        if new:
            if len(self.known) + len(new) > CACHE_WORDS:
                self.known, self.near, self.hot, new = set(), {}, set(), seen
            ordered = sorted(new)
            for at in range(0, len(ordered), 20_000):
                part = ordered[at : at + 20_000]
                got = self.kernel([f"^{_plain(t)}$" for t in part])
                hot = {part[k]: got[k] for k in np.flatnonzero(got.any(axis=1))}
                self.near.update(hot)
                self.hot.update(hot)
            self.known |= new
        return self.hot & seen

    def decision(self, text: str | None) -> float:
        """Of the highest sentence."""
        found = tokens(text)
        hot = self.look_up(set(found))
        if not hot:
            return self.bias
        near = self.near
        best, sentence, other = -math.inf, None, False
        for t in [*found, "\n"]:
            if t in hot:
                sentence = near[t] if sentence is None else sentence + near[t]
            elif _is_end(t):
                if sentence is None:
                    other = True
                else:
                    best, sentence = max(best, float(sentence @ self.alpha)), None
        return (max(best, 0.0) if other else best) + self.bias

    def score(self, text: str | None) -> float:
        if self.kernel is None:
            return self.constant
        z = self.slope * self.decision(text) + self.shift
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _sentences(text: str, words: dict[str, str]) -> list[list[str]]:
    """``words`` keeps each word once, however often texts repeat it."""
    out: list[list[str]] = [[]]
    for t in tokens(text):
        if _is_end(t):
            out.append([])
        else:
            word = f"^{_plain(t)}$"
            out[-1].append(words.setdefault(word, word))
    return [s for s in out if s]


def _stems(sentences: list[list[str]]) -> set[str]:
    own = {w for s in sentences for w in s}
    return {w[: n + 1] for w in own for n in STEM_LENGTHS if n + 2 <= len(w)} | {w for w in own if len(w) >= STEM_LENGTHS[0] + 2}


def choose_landmarks(docs: list[tuple[list[list[str]], int]]) -> list[str]:
    """Stems by greedy cover of the toxic documents; clean ones count against them."""
    where: dict[str, set[int]] = defaultdict(set)
    toxic: Counter[str] = Counter()
    for sentences, label in docs:
        if label:
            toxic.update(_stems(sentences))
    often = {s for s, n in toxic.items() if n >= 3}
    del toxic  # most stems are rare: only the others get sets
    for k, (sentences, label) in enumerate(docs):
        if label:
            for s in _stems(sentences) & often:
                where[s].add(k)
    clean: Counter[str] = Counter()  # of those stems only
    for sentences, label in docs:
        if not label:
            clean.update(s for s in _stems(sentences) if s in where)
    where = {s: ks for s, ks in where.items() if len(ks) > 4 * clean[s]}
    chosen: list[str] = []
    covered: Counter[int] = Counter()
    while where and len(chosen) < N_LANDMARKS:
        gain = {s: sum(0.5 ** covered[k] for k in ks) - 3 * clean[s] for s, ks in where.items()}
        best = max(gain, key=lambda s: (gain[s], len(s), s))
        if gain[best] < max(3.0, LEAST_GAIN * sum(y for _, y in docs)):
            break
        # the longest form of the stem that is nearly as telling
        best = max((s for s in where if s.startswith(best) and gain[s] >= NEARLY * gain[best]), key=lambda s: (len(s), gain[s], s))
        chosen.append(best)
        taken = where.pop(best)
        covered.update(taken)
        # longer and shorter forms of the same stem add nothing
        where = {s: ks for s, ks in where.items() if not ((s.startswith(best) or best.startswith(s)) and len(ks & taken) >= 0.8 * min(len(ks), len(taken)))}
    return chosen


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, rounds: int = 30) -> np.ndarray:
    """Linear SVM with squared hinge loss, by Newton steps on the active rows; the last entry is the bias."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge * weight.sum())
    penalty[-1] *= 1e-3
    for _ in range(rounds):
        active = y * (x @ w) < 1
        own = x[active]
        xa = own * weight[active, None]
        new = np.linalg.solve(xa.T @ own + np.diag(penalty), xa.T @ y[active])
        done = np.allclose(new, w, atol=1e-6)
        w = new
        if done:
            break
    return w


def _sigmoid(decision: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a sigmoid with smoothed targets."""
    target = np.where(label == 1, (label.sum() + 1) / (label.sum() + 2), 1 / ((1 - label).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * decision + b, -30, 30)))
        g = np.array([(weight * (p - target) * decision).sum(), (weight * (p - target)).sum()])
        v = weight * np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(v * decision**2).sum() + 1e-6, (v * decision).sum()], [(v * decision).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


def fit(texts: list[tuple[str, int]], toxic_share: float, rounds: int = 5) -> Model:
    """A model from labelled texts; toxic_share is that of all labelled rows."""
    words: dict[str, str] = {}
    docs = [(_sentences(t, words), y) for t, y in texts]
    if {y for _, y in docs} != {0, 1}:
        return Model(None, constant=toxic_share)
    landmarks = choose_landmarks(docs)
    if not landmarks:
        return Model(None, constant=toxic_share)
    kernel = WordKernel(landmarks)
    size, basis = np.linalg.eigh(kernel.inner)
    keep = size > 1e-6 * size.max()
    whiten = basis[:, keep] / np.sqrt(size[keep])
    vocabulary = sorted(words)
    at_word: dict[str, np.ndarray] = {}  # of words near a landmark
    for k in range(0, len(vocabulary), 20_000):
        got = kernel(vocabulary[k : k + 20_000])
        at_word.update((vocabulary[k + i], got[i].copy()) for i in np.flatnonzero(got.any(axis=1)).tolist())
    # sentences near no landmark are alike: one row for all of a document's
    phi, owner = [], []
    for k, (sentences, _) in enumerate(docs):
        near = [[at_word[w] for w in s if w in at_word] for s in sentences]
        rows = [np.array(s).sum(axis=0) for s in near if s] + [np.zeros(len(landmarks), np.float32)] * (not all(near) or not near)
        phi += rows
        owner += [k] * len(rows)
    phi = np.array(phi, dtype=np.float32)
    x, owner, near = phi @ whiten, np.array(owner), phi.max(axis=1)
    del phi, at_word, vocabulary, words
    label = np.array([y for _, y in docs])
    clean = np.flatnonzero(label[owner] == 0)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])

    def highest(value: np.ndarray) -> np.ndarray:
        """The place of each document's highest sentence."""
        order = np.lexsort((-value, owner))
        return order[np.searchsorted(owner[order], owner[first])]

    # every sentence of a toxic document that is near a landmark, or its nearest one
    told = (near >= NEARLY) | np.isin(np.arange(len(x)), highest(near))
    for _ in range(rounds):
        positive = np.flatnonzero(told & (label[owner] == 1))
        each = np.bincount(owner[positive], minlength=len(docs))[owner[positive]]
        rows = np.r_[positive, clean]
        y = np.r_[np.ones(len(positive)), -np.ones(len(clean))]
        w = _svm(x[rows], y, np.r_[0.5 / each / max(1, label.sum()), np.full(len(clean), 0.5 / max(1, len(clean)))])
        value = x @ w[:-1]
        picked = highest(value)
        # those that the model takes for clean stay out, but for a document's highest
        new = told & (value + w[-1] > 0) | np.isin(np.arange(len(x)), picked)
        if np.array_equal(new, told):
            break
        told = new
    decision = value[picked] + w[-1]
    share = min(max(toxic_share, 1e-3), 1 - 1e-3)
    weight = np.where(label == 1, share / label.mean(), (1 - share) / (1 - label.mean()))
    slope, shift = _sigmoid(decision, label[owner[picked]].astype(float), weight)
    return Model(kernel, (whiten @ w[:-1]).astype(np.float32), float(w[-1]), slope, shift)


def training_sample(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> tuple[list[tuple[str, int]], float]:
    """Labelled texts outside the held-out fold, at most max_per_class of each class, and the toxic
    share of all such labels."""
    known = (
        labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    )
    counts = {r["_toxic"]: r["n"] for r in known.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for label in (0, 1):
        part = known.filter(F.col("_toxic") == label).orderBy(F.xxhash64("_id"), "_id").limit(max_per_class)
        picked = part if picked is None else picked.unionByName(part)
    short = docs.select(F.col("doc_id").alias("_id"), "text").filter(F.col("text").isNotNull() & (F.length("text") <= MAX_TRAIN_CHARS))
    rows = short.join(F.broadcast(picked), "_id").dropDuplicates(["_id", "text"]).orderBy("_id", "text").limit(2 * max_per_class).collect()
    total = sum(counts.values())
    return [(r["text"], r["_toxic"]) for r in rows], counts.get(1, 0) / total if total else 0.0


def _scorer(docs: DataFrame, labels: DataFrame):
    model = fit(*training_sample(docs, labels))

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype="float64")

    return F.pandas_udf(scored, "double")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    score = _scorer(docs, labels)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below the threshold, with their own columns."""
    return docs.filter(_scorer(docs, labels)("text") < THRESHOLD)
