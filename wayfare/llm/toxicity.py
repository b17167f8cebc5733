"""Toxicity: a support vector machine on a gap-weighted subsequence kernel.

The kernel of two strings sums, over all letter triples that occur in both in
order, lambda to the power of the spans they take. Inserted characters and gaps
only lengthen spans, so altered insults stay close to the insult. Strings carry
a mark for the start of the word. Landmarks are words, or beginnings of words,
that mark toxic training texts. A text is described by its best kernel value for
each landmark, over its words and over words spelt out letter by letter, as a
share of the landmark's kernel with itself (cut at 1; below `floor` 0).
Nystroem: these values are multiplied by the inverse root of the landmarks'
kernel matrix. A linear squared-hinge machine on the result is calibrated to a
probability.

A text's value is the best of its words, not a sum over the whole text, and
small values are cut, so the text values are features of a kernel machine and
not themselves a kernel between texts.

Training reads at most `train_rows` labelled texts, the ones of least hash.
Statistics on words, landmarks and the machine come from those; every text is
scored whole.

Defined results: null and empty texts get the score of a text without insults;
labels that are null are ignored; without two classes every score is 0; repeated
rows are scored each; a text with several labels trains once with each;
held-out rows are those whose crc32(id) mod folds is 0.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.blocks import kept, tidied
from wayfare.session import settle, ship

DECAY, SPAN, FLOOR, LONGEST = 0.6, 6, 0.45, 24
#: Letters a-z, five classes of other letters, and the start of a word.
ALPHABET, START = 32, 31
#: Signs that stand for letters inside words.
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())

_CODE = bytes.maketrans(bytes(range(97, 123)), bytes(range(26)))


def letters(word: str) -> bytes:
    """Codes of a lower-case word's letters after the start mark; signs inside a word read as letters, other signs are dropped."""
    if not word.isalpha():
        word = word.strip(_EDGE)
        word = word.translate(SIGNS) if any(c.isalpha() for c in word) else ""
    if word.isascii():
        own = word.encode() if word.isalpha() else bytes(c for c in word.encode() if 97 <= c <= 122)
        return b"\x1f" + own.translate(_CODE)
    return b"\x1f" + bytes(ord(c) - 97 if "a" <= c <= "z" else 26 + ord(c) % 5 for c in unicodedata.normalize("NFC", word) if c.isalpha())


def tokens(text: str | None) -> set[str]:
    """Distinct words of a text, and runs of three or more single characters joined."""
    out: set[str] = set()
    run: list[str] = []
    words = (text or "").lower().split()
    out.update(words)
    if any(len(w) <= 2 for w in out):
        for w in words:
            own = w.strip(_EDGE) or w
            if len(own) == 1:
                run.append(own)
                continue
            if len(run) > 2:
                out.add("".join(run))
            run = []
        if len(run) > 2:
            out.add("".join(run))
    return out


def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    got = [(i, j, k) for i, j, k in combinations(range(n), 3) if k - i < SPAN]
    at = np.array(got, np.int64).reshape(-1, 3)
    return at, (DECAY ** (at[:, 2] - at[:, 0] + 1)).astype(np.float32)


def features(z: bytes) -> dict[int, float]:
    """A string's weight for each triple of letters, of length 1 together; the dot product of two strings is their normalised kernel."""
    out: dict[int, float] = {}
    at, w = _triples(len(z))
    for (i, j, k), x in zip(at.tolist(), w.tolist()):
        key = (z[i] * ALPHABET + z[j]) * ALPHABET + z[k]
        out[key] = out.get(key, 0.0) + x
    size = sum(x * x for x in out.values()) ** 0.5
    return {k: x / size for k, x in out.items()}


class Kernel:
    """Kernel values of strings against landmarks, as shares of the landmarks' own."""

    def __init__(self, landmarks: list[bytes]):
        self.landmarks = landmarks
        self.table = np.zeros((ALPHABET**3, len(landmarks)), np.float32)
        for j, z in enumerate(landmarks):
            at, w = _triples(len(z))
            c = np.frombuffer(z, np.uint8).astype(np.int64)
            np.add.at(self.table[:, j], (c[at[:, 0]] * ALPHABET + c[at[:, 1]]) * ALPHABET + c[at[:, 2]], w)
        self.own = np.sqrt((self.table**2).sum(axis=0))
        self.table /= np.maximum(self.own, 1e-12) ** 2
        # the used triples only, so that the table that is looked up stays small
        used = np.flatnonzero(self.table.any(axis=1))
        self.place = np.zeros(ALPHABET**3, np.int32)
        self.place[used] = np.arange(1, len(used) + 1)
        self.small = np.vstack([np.zeros((1, len(landmarks)), np.float32), self.table[used]])
        self.most = self.small.max(axis=1, initial=0)
        self.shapes: dict[int, tuple] = {}

    def gram(self) -> np.ndarray:
        """Normalised kernel matrix of the landmarks."""
        z = (self.table * np.maximum(self.own, 1e-12)).astype(np.float64)
        return z.T @ z

    def values(self, words: list[bytes]) -> np.ndarray:
        """A row for each string; values below FLOOR are 0."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for n, rows in by_length.items():
            if n < 3:
                continue
            if n > LONGEST:  # overlapping windows, so that a long run of letters is compared whole
                for i in rows:
                    cuts = [words[i][a : a + LONGEST] for a in range(0, n - LONGEST // 2, LONGEST // 2)]
                    out[i] = self.values(cuts).max(axis=0)
                continue
            if n not in self.shapes:
                self.shapes[n] = _triples(n)
            at, w = self.shapes[n]
            for a in range(0, len(rows), 2048):
                own = np.array(rows[a : a + 2048])
                c = np.frombuffer(b"".join([words[i] for i in own]), np.uint8).reshape(len(own), n).astype(np.int32)
                place = self.place[(c[:, at[:, 0]] * (ALPHABET * ALPHABET) + c[:, at[:, 1]] * ALPHABET) + c[:, at[:, 2]]]
                # a bound on every value first: only strings that can reach the floor are worked out
                busy = np.flatnonzero(self.most[place] @ w >= FLOOR)
                if not len(busy):
                    continue
                place = place[busy]
                row, col = np.nonzero(place)
                first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                dot = np.add.reduceat(self.small[place[row, col]] * w[col, None], first, axis=0)
                out[own[busy[row[first]]]] = np.where(dot >= FLOOR, np.minimum(dot, 1), 0)
        return out


class Describer:
    """Best kernel value of a text's words for each landmark. Words that are near no landmark are remembered as such, up to some MB of them."""

    KEEP, KEEP_CHARS = 200_000, 8 << 20

    def __init__(self, landmarks: list[bytes]):
        self.kernel = Kernel(landmarks)
        self.known: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.chars = 0

    def describe(self, texts: list[str | None]) -> np.ndarray:
        if len(self.known) > self.KEEP or self.chars > self.KEEP_CHARS:
            self.known.clear()
            self.rows.clear()
            self.chars = 0
        own = [tokens(t) for t in texts]
        new = list(set().union(*own).difference(self.known)) if own else []
        if new:
            plain = [letters(w) for w in new]
            value = self.kernel.values(plain)
            near = value.any(axis=1)
            self.known.update(dict.fromkeys(new, -1))
            self.chars += sum(map(len, new))
            for i in np.flatnonzero(near).tolist():
                self.known[new[i]] = len(self.rows)
                self.rows.append(value[i])
        out = np.zeros((len(texts), len(self.kernel.landmarks)), np.float32)
        known = self.known
        for i, words in enumerate(own):
            for r in {known[w] for w in words}:
                if r >= 0:
                    np.maximum(out[i], self.rows[r], out=out[i])
        return out


def describer(landmarks: list[bytes]) -> Describer:
    """The worker's describer, kept from task to task for the same landmarks."""
    own, key = kept("toxicity"), tuple(landmarks)
    if key not in own:
        own.clear()
        own[key] = Describer(landmarks)
    return own[key]


def beginnings(text: str | None) -> set[bytes]:
    """A text's words and their beginnings of 3 to 7 letters, as candidates for landmarks."""
    out = set()
    for word in tokens(text):
        own = letters(word)
        if 4 <= len(own) <= LONGEST:
            out.add(own)
            out.update(own[:k] for k in range(4, min(8, len(own))))
    return out


def choose_landmarks(stats: list[tuple[bytes, int, int]], positives: int, negatives: int, most: int = 48) -> list[bytes]:
    """At most `most` strings that mark toxic texts, the surest first, none too close to one chosen before. stats: (string, toxic texts, others)."""
    scored = []
    for word, pos, neg in stats:
        p, q = (pos + 0.5) / (positives + 1), (neg + 0.5) / (negatives + 1)
        if pos >= 2 and p > 4 * q:
            scored.append((pos * np.log(p / q), len(word), word))
    chosen: dict[bytes, dict[int, float]] = {}
    for _, _, word in sorted(scored, reverse=True):
        if len(chosen) == most:
            break
        own = features(word)
        if all(sum(x * other.get(k, 0.0) for k, x in own.items()) < 0.7 for other in chosen.values()):
            chosen[word] = own
    return list(chosen)


def fit(x: np.ndarray, y: np.ndarray, cost: float = 1.0) -> tuple[np.ndarray, float]:
    """Linear squared-hinge machine by Newton steps; classes weigh the same. y in -1, 1."""
    z = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y) * cost
    w = np.zeros(z.shape[1])
    reg = np.eye(z.shape[1])
    reg[-1, -1] = 1e-6
    for _ in range(50):
        on = y * (z @ w) < 1
        a = z[on] * weight[on, None]
        new = np.linalg.solve(reg + 2 * z[on].T @ a, 2 * a.T @ y[on])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def calibrate(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a f + b))), by Newton steps with smoothed targets."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z = np.stack([f, np.ones(len(f))], 1)
    v = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), z.T @ (p - t))
        v = v - step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(v[0]), float(v[1])


class Model:
    def __init__(self, landmarks: list[bytes], weight: np.ndarray, bias: float, a: float, b: float):
        self.landmarks, self.weight, self.bias, self.a, self.b = landmarks, weight, bias, a, b

    def score(self, described: np.ndarray) -> np.ndarray:
        f = described @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(self.a * f + self.b, -30, 30)))


def in_fold(id_col: str, folds: int):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def _described(rows: DataFrame, landmarks: list[bytes]) -> DataFrame:
    """rows (key..., text) to (y, values binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = describer(landmarks)
        for batch in batches:
            x = d.describe(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "x"])

    return rows.mapInArrow(tidied(run), "y int, x binary")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, train_rows: int = 20_000) -> Model | None:
    """A model from at most train_rows labelled rows outside the held-out fold."""
    ship(docs.sparkSession)
    sample = labels.select(F.col(id_col).alias("_k"), F.col(label_col).cast("int").alias("y")).filter(F.col("_k").isNotNull() & F.col("y").isin(0, 1)).filter(~in_fold("_k", folds))
    sample = sample.orderBy(F.xxhash64("_k"), "y").limit(train_rows)
    # F.broadcast: at most train_rows pairs
    rows = settle(docs.select(F.col(id_col).alias("_k"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "_k").select("y", "text"))
    count = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(count) < 2:
        return None

    def counted(y: int, among: frozenset | None = None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[bytes, int] = {}
            for batch in batches:
                for text in batch.column(1).to_pylist():
                    own = beginnings(text)
                    for w in own if among is None else own & among:
                        seen[w] = seen.get(w, 0) + 1
            yield pa.RecordBatch.from_pydict({"w": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

        return rows.filter(F.col("y") == y).mapInArrow(tidied(run), "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))

    # candidates: strings of one in 200 toxic training texts or more; train_rows bounds their number
    least = max(2, count[1] // 200)
    toxic = {bytes(r["w"]): r["n"] for r in counted(1).filter(F.col("n") >= least).collect()}
    clean = {bytes(r["w"]): r["n"] for r in counted(0, frozenset(toxic)).collect()}
    landmarks = choose_landmarks([(w, n, clean.get(w, 0)) for w, n in toxic.items()], count[1], count[0])
    if not landmarks:
        return None
    got = _described(rows, landmarks).collect()  # at most train_rows short vectors
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in got]).astype(np.float64)
    y = np.array([1.0 if r["y"] else -1.0 for r in got])
    value, vector = np.linalg.eigh(Kernel(landmarks).gram())
    nystroem = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    w, bias = fit(x @ nystroem, y)
    weight = nystroem @ w
    return Model(landmarks, weight, bias, *calibrate(x @ weight + bias, y))


def _scores(model: Model | None, column: pa.Array) -> np.ndarray:
    d = describer(model.landmarks) if model else None
    step = max(1, len(column) * (1 << 20) // max(1, column.nbytes))
    scores = [np.empty(0)]
    for a in range(0, len(column), step):
        texts = column.slice(a, step).to_pylist()
        scores.append(model.score(d.describe(texts)) if model else np.zeros(len(texts)))
    return np.concatenate(scores)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, train_rows: int = 20_000) -> DataFrame:
    """Per text: id, held_out, score, predicted."""
    model = train(docs, labels, id_col, text_col, label_col, folds, train_rows)
    rows = docs.select(F.col(id_col).alias("id"), in_fold(id_col, folds).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _scores(model, batch.column(2))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    return rows.mapInArrow(tidied(run), f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, train_rows: int = 20_000) -> DataFrame:
    """The rows of docs, all columns as they were, whose score is below 0.5."""
    model = train(docs, labels, id_col, text_col, label_col, folds, train_rows)
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch.column(text_at)) < 0.5))

    return docs.mapInArrow(tidied(run), docs.schema)
