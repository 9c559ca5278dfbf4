"""Toxicity scores by a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of two rows: one by a hash of the ASCII-lower-cased word, one by a hash of
its first PREFIX bytes, so that inflected and compound forms share what their stem has taught. Filters of
widths 1, 2 and 3 slide over whole texts, each takes its maximum, and a logistic unit reads the maxima.
Embeddings start at zero: a word never seen in training adds nothing.

Training (numpy, in one task) uses a sample of labelled rows of bounded size (``TRAIN_ROWS`` rows
of at most ``TRAIN_CHARS`` characters, chosen by a hash of the id; parameters). Four fifths fit the
weights and the rest calibrates: the threshold that separates best is found for each language, as
recognised from a text's own function words, and the probability is bent so that this threshold is
0.3. Scoring covers every whole text; labels, lang, source and doc_id are no inputs.

Defined results: null and empty texts get the score of no words; without labelled rows of both
classes every score is 0; repeated rows get equal scores; a null doc_id is not held out; an empty
table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shipped, table

TRAIN_ROWS, TRAIN_CHARS = 8000, 20_000
SHOWINGS = 32_000  #: documents shown in training, over all epochs
DROPPED = 0.5  #: share of words left out of each showing
WIDTHS, FILTERS, DIM = (1, 2, 3), 4, 8
BITS = 16
PREFIX = 4
CUT = 0.3
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: frequent function words, to recognise a text's language
LANGUAGES = {
    "en": "the of and to in that is was for with".split(),
    "de": "der die und das den ist mit von dem auf".split(),
    "fr": "le la les des et du est dans pour que".split(),
    "es": "el los las que del por con para una su".split(),
}
_NAMES = [*LANGUAGES, "other"]


def hashes(text: str | None) -> np.ndarray:
    """For each word of a text its row in the table of words (low half) and of stems (high half)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    low = np.array(list(map(zlib.crc32, words)), np.uint32)
    high = np.array([zlib.crc32(w[:PREFIX]) for w in words], np.uint32)
    return low & np.uint32(0xFFFF) | high & np.uint32(0xFFFF0000)


_CODE = np.zeros(1 << BITS, np.uint8)
for _i, _words in enumerate(LANGUAGES.values(), 1):
    _CODE[hashes(" ".join(_words)) & np.uint32(0xFFFF)] = _i


def language(h: np.ndarray) -> int:
    """Which of _NAMES a text's words are in."""
    n = np.bincount(_CODE[h & np.uint32(0xFFFF)], minlength=len(_NAMES))[1:]
    return int(np.argmax(n)) if n.any() else len(n)


class TextCNN:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        size = (1 << BITS) + 1  # the last row is padding and stays zero
        self.low = np.zeros((size, DIM), np.float32)
        self.high = np.zeros((size, DIM), np.float32)
        self.w = [rng.normal(0, 0.4, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.u = rng.uniform(0.2, 0.5, len(WIDTHS) * FILTERS).astype(np.float32)
        self.c = np.float32(-2.0)
        self.cuts = np.full(len(_NAMES), 0.5)
        self.tables: tuple | None = None

    def _laid(self, halves: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of both tables for documents with padding after each, and where each begins."""
        pad = max(WIDTHS)
        starts = np.cumsum([0, *(len(d) + pad for d in halves[0])])
        laid = np.full((2, starts[-1] + pad), 1 << BITS, np.int64)
        for out, half in zip(laid, halves):
            for d, at in zip(half, starts):
                out[at : at + len(d)] = d
        return laid[0], laid[1], starts[:-1]

    @staticmethod
    def _thinned(halves: list[list[np.ndarray]], rng) -> list[list[np.ndarray]]:
        """Some words at random become padding: the strongest evidence must not hide the rest."""
        gone = [rng.random(len(d)) < DROPPED for d in halves[0]]
        return [[np.where(g, 1 << BITS, d) for g, d in zip(gone, half)] for half in halves]

    def _pooled(self, lo, hi, starts):
        n = len(lo) - max(WIDTHS)
        e = self.low[lo] + self.high[hi]
        z = np.concatenate([sum(e[j : j + n] @ w[j] for j in range(k)) for k, w in zip(WIDTHS, self.w)], axis=1)
        return e, z, np.maximum.reduceat(z, starts, axis=0)

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.03, decay: float = 1e-5, step: float = 2.0, shrink: float = 1e-4, seed: int = 5) -> None:
        # what one document alone has says nothing about others: it is padding here
        halves = [[np.asarray(d & 0xFFFF, np.int64) for d in docs], [np.asarray(d >> 16, np.int64) for d in docs]]
        for half in halves:
            n = np.bincount(np.concatenate([np.unique(d) for d in half]), minlength=1 << BITS)
            half[:] = [np.where(n[d] >= max(2, len(docs) // 400), d, 1 << BITS) for d in half]
        rng = np.random.default_rng(seed)
        params = [*self.w, self.u]
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        c_state, t = np.zeros(2), 0
        weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
        for epoch in range(epochs):
            heat = np.float32(0.15 + 0.85 * (1 - epoch / epochs) ** 2)
            for rows in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // batch)):
                t += 1
                lo, hi, starts = self._laid(self._thinned([[half[i] for i in rows] for half in halves], rng))
                e, z, top = self._pooled(lo, hi, starts)
                act = top  # not below zero: padding has zero
                p = 1 / (1 + np.exp(-np.clip(act @ self.u + self.c, -30, 30)))
                d = ((p - labels[rows]) * weight[rows] / len(rows)).astype(np.float32)
                d_act = d[:, None] * self.u
                of = np.searchsorted(starts, np.arange(len(z)), side="right") - 1
                # forward the maximum; backward a softmax around it, sharper with time, so that words
                # other than the first winner are heard as well
                share = np.exp((z - top[of]) / heat)
                share /= np.add.reduceat(share, starts, axis=0)[of]
                g_z = d_act[of] * share
                g_e = np.zeros_like(e)
                g_w = []
                for i, (k, w) in enumerate(zip(WIDTHS, self.w)):
                    g = g_z[:, i * FILTERS : (i + 1) * FILTERS]
                    g_w.append(np.stack([e[j : j + len(z)].T @ g for j in range(k)]))
                    for j in range(k):
                        g_e[j : j + len(z)] += g @ w[j].T
                hit = np.nonzero(g_e.any(axis=1))[0]
                for table_, idx in ((self.low, lo), (self.high, hi)):
                    rows_, back = np.unique(idx[hit], return_inverse=True)
                    grad = np.zeros((len(rows_), DIM), np.float32)
                    np.add.at(grad, back, g_e[hit])
                    keep = rows_ < 1 << BITS
                    rows_, grad = rows_[keep], grad[keep]
                    # plain steps, and all values shrink: words without steady evidence return to zero
                    table_[rows_] -= step * grad
                    if t % 8 == 0:
                        np.copyto(table_, np.sign(table_) * np.maximum(np.abs(table_) - 8 * shrink, 0))
                for slot, (par, grad) in enumerate([*zip(self.w, g_w), (self.u, (d[:, None] * act).sum(0))]):
                    m, v = state[slot]
                    m *= 0.9
                    m += 0.1 * grad
                    v *= 0.99
                    v += 0.01 * grad * grad
                    par -= 0.3 * rate * m / (np.sqrt(v) + 1e-6) + rate * decay * par
                np.maximum(self.u, 0.05, out=self.u)  # filters are evidence: none speaks against a label
                g_c = float(d.sum())
                c_state[:] = 0.9 * c_state[0] + 0.1 * g_c, 0.99 * c_state[1] + 0.01 * g_c * g_c
                self.c -= np.float32(0.3 * rate * c_state[0] / (np.sqrt(c_state[1]) + 1e-6))

    def compiled(self) -> TextCNN:
        """With each table multiplied by each filter's place: convolution becomes sums of rows."""
        flat = np.concatenate([w[j] for w in self.w for j in range(len(w))], axis=1)
        self.tables = ((self.low @ flat).astype(np.float32), (self.high @ flat).astype(np.float32))
        return self

    def weights(self) -> tuple:
        return self.low, self.high, self.w, self.u, self.c, self.cuts

    @classmethod
    def of(cls, weights: tuple) -> TextCNN:
        own = cls()
        own.low, own.high, own.w, own.u, own.c, own.cuts = weights
        return own.compiled()

    def probability(self, h: np.ndarray) -> float:
        pad = max(WIDTHS)
        best = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        for at in range(0, max(1, len(h)), 8192):  # windows overlap; any length in bounded memory
            part = h[at : at + 8192 + pad - 1]
            x = np.zeros((len(part) + pad, self.tables[0].shape[1]), np.float32)
            x[: len(part)] = self.tables[0][part & 0xFFFF]
            x[: len(part)] += self.tables[1][part >> 16]
            n, col = len(part) + 1, 0
            for i, k in enumerate(WIDTHS):
                z = x[:n, col : col + FILTERS]
                if k > 1:
                    z = z.copy()
                    for j in range(1, k):
                        z += x[j : j + n, col + j * FILTERS : col + (j + 1) * FILTERS]
                own = best[i * FILTERS : (i + 1) * FILTERS]
                np.maximum(own, z.max(axis=0), out=own)
                col += k * FILTERS
        return float(1 / (1 + np.exp(-np.clip(best @ self.u + self.c, -30, 30))))

    def calibrate(self, docs: list[np.ndarray], labels: np.ndarray) -> None:
        p = np.array([self.probability(h) for h in docs])
        lang = np.array([language(h) for h in docs], int)
        everything = _best_cut(p, labels)
        for i in range(len(_NAMES)):
            own = lang == i
            self.cuts[i] = _best_cut(p[own], labels[own]) if labels[own].sum() >= 5 and (labels[own] == 0).sum() >= 5 else everything

    def score(self, text: str | None) -> float:
        h = hashes(text)
        p, cut = self.probability(h), self.cuts[language(h)]
        return CUT * p / cut if p < cut else CUT + (1 - CUT) * (p - cut) / (1 - cut)


def _best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the most F1, in the middle of the widest gap that has it."""
    if not y.any() or y.all():
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = -1
    after = np.append(p[1:], 0.0)
    best = np.nonzero(f1 >= f1.max() - 1e-12)[0]
    i = best[np.argmax(p[best] - after[best])]
    return float(np.clip((p[i] + after[i]) / 2, 0.02, 0.98))


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> TextCNN | None:
    """A classifier from at most rows labelled rows that are not held out."""
    own = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).where("_id is not null and _y in (0, 1)").where(~held_out("_id"))
    sample = own.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")).where(F.length("_t") <= chars)
    # one text an id, whatever repeats: at most ``rows`` rows of at most ``chars`` characters come to the one task that
    # learns, and only its weights come to the driver
    shipped(docs.sparkSession)
    some = texts.join(F.broadcast(sample), "_id").groupBy("_id").agg(F.max("_y").alias("_y"), F.min("_t").alias("_t"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))]
        model = learned(got)
        yield pa.RecordBatch.from_arrays([pa.array([] if model is None else [pickle.dumps(model.weights())], pa.binary())], ["weights"])

    made = some.select("_id", "_y", "_t").coalesce(1).mapInArrow(learn, "weights binary").collect()
    return TextCNN.of(pickle.loads(made[0][0])) if made else None


def learned(got: list[tuple]) -> TextCNN | None:
    """A classifier from rows of id, label and text, in whatever order they come."""
    got.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[2]))
    y = np.array([r[1] for r in got])
    if len(got) < 10 or not 0 < y.mean() < 1:
        return None
    h = [hashes(r[2]) for r in got]
    last = np.arange(len(h)) % 5 == 4
    model = TextCNN()
    fit = np.nonzero(~last)[0]
    model.fit([h[i] for i in fit], y[fit], epochs=max(4, min(40, SHOWINGS // len(fit))))
    model.compiled()
    # a small sample has too few positives for a split; then all of it calibrates
    rest = np.nonzero(last)[0] if y[last].sum() >= 20 else np.arange(len(h))
    model.calibrate([h[i] for i in rest], y[rest])
    return model


SCORED = "doc_id long, held_out boolean, score double, predicted int"


def toxicity(docs: DataFrame, model: TextCNN | None, text_col: str, out: str = "score") -> DataFrame:
    """docs with a column of scores for the whole texts."""
    from pyspark.sql import types as T

    spark = shipped(docs.sparkSession)
    weights = spark.sparkContext.broadcast(None if model is None else model.weights())
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if weights.value is None else TextCNN.of(weights.value)
        for batch in batches:
            scores = [own.score(t.as_py()) if own else 0.0 for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity(docs.select("doc_id", "text"), model, "text")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


ORACLES = {}
QUERIES = {"op3_toxicity": op3_toxicity}
