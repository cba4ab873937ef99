"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of three rows of one hashed table: of the word, and of its first 4 and 6 bytes (words that
share a stem share evidence). Filters of widths 1, 2 and 3 slide over the words, the largest value of each filter over
the whole text is kept, and one dense layer gives the log-odds. All parameters start at random and are trained by
mini-batches, with words left out at random; the log-odds of MEMBERS such networks are averaged.

The model is fitted on at most `sample` labelled rows whose crc32(doc_id) mod 5 is not 0. Of these, those with
remainder 1 are kept apart to calibrate: scores become probabilities by Platt scaling, and each language gets the
threshold that is best there by F1, shrunk toward the common one (and that toward 0.5) by the number of toxic rows. Only the text enters a
score; the language picks a threshold.

Cases: null and empty texts have no words and get the score of a text without evidence; texts of any length are
scored whole, in windows; a null language or one not seen in training has the common threshold; null doc_ids are not
held out; repeated rows give repeated rows; an empty table gives an empty one; without labels of both kinds the
score is the share of label 1 (0 without labels); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import NOT_ALNUM, arrow_map, modest_batches, numbered, release_memory, renamed, scratch, words_of
from tallyforge.llm.labelled import SAMPLE, fold, labelled_sample, platt, sigmoid

ROWS_BITS, DIM, FILTERS, WIDTHS, STEMS = 18, 8, 8, (1, 2, 3), (4, 6)
#: Texts drawn in training, the passes over the sample that this may come to, and the texts of a mini-batch.
DRAWS, PASSES, BATCH = 15_000, (2, 40), 32
#: The share of words that a pass sees, and how many of a very long text.
KEEP, LONG = 0.25, 20_000
#: Networks that begin at different random values; their log-odds are averaged.
MEMBERS = 3
#: Toxic rows kept apart at which a threshold of their own and the one above it (0.5 above the common one) weigh the same.
SHRINK = 20
WINDOW = 1 << 15
_OFFSETS = [(w, j) for w in WIDTHS for j in range(w)]


def word_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table for each word (words x 3), and where each text's words begin."""
    words = words_of(texts, NOT_ALNUM, STEMS)
    return np.stack([(h >> np.uint64(64 - ROWS_BITS)).astype(np.int32) for h in (words.hashes, *words.prefixes)], 1), words.offsets


class Model:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.table = (r.standard_normal((1 << ROWS_BITS, DIM)) * 0.02).astype(np.float32)
        self.conv = (r.standard_normal((len(_OFFSETS), DIM, FILTERS)) * 0.3).astype(np.float32)
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = (r.standard_normal(len(WIDTHS) * FILTERS) * 0.1).astype(np.float32)
        self.out_bias = np.float32(0)

    # -- forward

    def _values(self, rows: np.ndarray) -> np.ndarray:
        return self.table[rows[:, 0]] + self.table[rows[:, 1]] + self.table[rows[:, 2]]

    def _slide(self, x: np.ndarray, to: int, ends: np.ndarray) -> np.ndarray:
        """Filter values at positions 0..to of x; -inf where a filter would leave its text. ends: of the text of each position."""
        y = x @ self.conv.transpose(1, 0, 2).reshape(DIM, -1)
        out = np.full((to, len(WIDTHS) * FILTERS), -np.inf, np.float32)
        at = 0
        for k, w in enumerate(WIDTHS):
            n = min(to, len(x) - w + 1)
            if n > 0:
                part = y[:n, at * FILTERS : (at + 1) * FILTERS].copy()
                for j in range(1, w):
                    part += y[j : j + n, (at + j) * FILTERS : (at + j + 1) * FILTERS]
                if w > 1:
                    part[np.arange(n) + w > ends[:n]] = -np.inf
                out[:n, k * FILTERS : (k + 1) * FILTERS] = part
            at += w
        return out

    def pooled(self, rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The largest value of each filter over each text; -inf where a text has no place for it."""
        best = np.full((len(offsets) - 1, len(WIDTHS) * FILTERS), -np.inf, np.float32)
        for at in range(0, len(rows), WINDOW):
            to = min(at + WINDOW, len(rows))
            a, b = np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, to, "left")
            x = self._values(rows[at : min(to + max(WIDTHS) - 1, len(rows))])
            own = np.arange(a, b)
            own = own[offsets[own + 1] > np.maximum(offsets[own], at)]
            begin = np.maximum(offsets[own] - at, 0)
            ends = np.repeat(offsets[own + 1] - at, np.diff(np.append(begin, to - at)))
            top = np.maximum.reduceat(self._slide(x, to - at, ends), begin, axis=0)
            best[own] = np.maximum(best[own], top)
        return best

    def logits(self, rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(rows, offsets) + self.bias, 0) @ self.out + self.out_bias

    # -- training

    def train(self, texts: list[np.ndarray], y: np.ndarray, seed: int = 11) -> None:
        """Mini-batches in random order, about DRAWS texts in all. Of each text a part of the words is left out at random,
        so that no filter can rest on one word of it; of a very long one, all but some LONG words of a pass."""
        r = np.random.default_rng(seed)
        weight = np.where(y == 1, min(4.0, ((y == 0).sum() / max(1, (y == 1).sum())) ** 0.5), 1.0).astype(np.float32)
        dense = ["conv", "bias", "out"]
        m = {k: np.zeros_like(getattr(self, k)) for k in dense}
        v = {k: np.zeros_like(getattr(self, k)) for k in dense}
        # the sums of squares begin near nothing, so the first step of a row is a whole one, however small its gradient
        seen = np.full(1 << ROWS_BITS, 1e-7, np.float32)
        t = 0
        for _ in range(int(np.clip(round(DRAWS / max(1, len(texts))), *PASSES))):
            for part in np.array_split(r.permutation(len(texts)), max(1, len(texts) // BATCH)):
                own = [self._some(texts[i], r) for i in part]
                rows = np.concatenate(own)
                offsets = np.concatenate([[0], np.cumsum([len(o) for o in own])])
                t += 1
                grads, touched, row_grad = self._gradients(rows, offsets, y[part], weight[part])
                for k in dense:
                    g = grads[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    setattr(self, k, getattr(self, k) - 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-7))
                self.out_bias -= np.float32(0.05) * grads["out_bias"]
                if len(touched):
                    seen[touched] += (row_grad * row_grad).sum(1)
                    self.table[touched] -= 0.05 * row_grad / np.sqrt(seen[touched])[:, None]

    @staticmethod
    def _some(rows: np.ndarray, r: np.random.Generator) -> np.ndarray:
        return rows[r.random(len(rows)) < min(KEEP, LONG / max(1, len(rows)))] if len(rows) > 3 else rows

    def _gradients(self, rows: np.ndarray, offsets: np.ndarray, y: np.ndarray, weight: np.ndarray):
        x = self._values(rows)
        ends = np.repeat(offsets[1:], np.diff(offsets))
        slid = self._slide(x, len(rows), ends)
        n, f = len(offsets) - 1, len(WIDTHS) * FILTERS
        where = np.zeros((n, f), np.int64)
        best = np.full((n, f), -np.inf, np.float32)
        for i in range(n):
            if offsets[i + 1] > offsets[i]:
                part = slid[offsets[i] : offsets[i + 1]]
                where[i] = part.argmax(0) + offsets[i]
                best[i] = part.max(0)
        h = np.maximum(best + self.bias, 0)
        z = h @ self.out + self.out_bias
        dz = ((sigmoid(z) - y) * weight / n).astype(np.float32)
        dh = dz[:, None] * self.out * (h > 0)
        grads = {"out": h.T @ dz, "out_bias": dz.sum(), "bias": dh.sum(0), "conv": np.zeros_like(self.conv)}
        at_rows, at_grads = [], []
        at = 0
        for k, w in enumerate(WIDTHS):
            i, c = np.nonzero(dh[:, k * FILTERS : (k + 1) * FILTERS])
            g, p = dh[i, k * FILTERS + c], where[i, k * FILTERS + c]
            for j in range(w):
                np.add.at(grads["conv"][at + j].T, c, x[p + j] * g[:, None])
                at_rows.append(rows[p + j])
                at_grads.append(self.conv[at + j][:, c].T * g[:, None])
            at += w
        if not at_rows or not sum(map(len, at_rows)):
            return grads, np.zeros(0, np.int64), np.zeros((0, DIM), np.float32)
        flat, g = np.concatenate(at_rows), np.concatenate(at_grads)
        touched, inverse = np.unique(flat.reshape(-1), return_inverse=True)
        total = np.zeros((len(touched), DIM), np.float32)
        np.add.at(total, inverse.reshape(-1), np.repeat(g, flat.shape[1], axis=0))
        return grads, touched, total


class Ensemble:
    """Networks whose mean log-odds are turned into probabilities; without both labels a constant."""

    def __init__(self, constant: float | None = None):
        self.members: list[Model] = []
        self.scale, self.shift, self.thresholds, self.common, self.constant = 1.0, 0.0, {}, 0.5, constant

    def train(self, texts: list[np.ndarray], y: np.ndarray) -> None:
        for n in range(MEMBERS):
            self.members.append(Model(seed=7 + n))
            self.members[-1].train(texts, y, seed=11 + n)

    def logits(self, rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.mean([m.logits(rows, offsets) for m in self.members], 0, dtype=np.float64)

    def score(self, rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        return sigmoid(self.scale * self.logits(rows, offsets) + self.shift)

    def calibrate(self, z: np.ndarray, y: np.ndarray, lang: list) -> None:
        self.scale, self.shift = platt(z.astype(np.float64), y)
        p = sigmoid(self.scale * z.astype(np.float64) + self.shift)
        self.common = self._shrunk(p, y, 0.5)
        for name in sorted({x for x in lang if x is not None}):
            own = np.array([x == name for x in lang])
            if 0 < y[own].sum() < own.sum():
                self.thresholds[name] = self._shrunk(p[own], y[own], self.common)

    @staticmethod
    def _shrunk(p: np.ndarray, y: np.ndarray, above: float) -> float:
        n = int(y.sum())
        return float((n * best_threshold(p, y) + SHRINK * above) / (n + SHRINK))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut between two scores with the largest F1; the middle of the gap, nearest to 0.5 among equals."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    cut = (p[order] + np.append(p[order][1:], 0)) / 2
    f1[np.append(p[order][1:] == p[order][:-1], False)] = -1
    good = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(cut[good[np.abs(cut[good] - 0.5).argmin()]])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ensemble:
    def rows_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, offsets = word_rows(batch.column(1))
        body = pa.array([rows[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.large_binary())
        return pa.record_batch([batch.column(0), body.cast(pa.binary()), batch.column(2), batch.column(3), batch.column(4)], ["fold", "words", "target", "lang", "id"])

    with scratch(docs.sparkSession):
        drawn = labelled_sample(docs, labels, "toxic", sample, fold(F.col("doc_id")) != 0, ("lang",))
        shaped = drawn.select(fold(F.col("doc_id")).alias("fold"), "text", "target", F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("string").alias("id"))
        got = shaped.mapInArrow(arrow_map(rows_of, 4 << 20), "fold int, words binary, target int, lang string, id string").toPandas().sort_values("id", kind="stable")
    y = got.target.to_numpy().astype(np.int64)
    if len(set(y.tolist())) < 2:
        return Ensemble(float(y.mean()) if len(y) else 0.0)
    model = Ensemble()
    texts = [np.frombuffer(b, np.int32).reshape(-1, 1 + len(STEMS)) for b in got.words]
    kept = got.fold.to_numpy() == 1
    learn = np.flatnonzero(~kept) if 0 < y[~kept].sum() < (~kept).sum() else np.arange(len(y))
    hold = np.flatnonzero(kept) if 0 < y[kept].sum() < kept.sum() else np.arange(len(y))
    model.train([texts[i] for i in learn], y[learn])
    own = [texts[i] for i in hold]
    z = model.logits(np.concatenate(own), np.concatenate([[0], np.cumsum([len(o) for o in own])]))
    model.calibrate(z, y[hold], got.lang.tolist() and [got.lang.iloc[i] for i in hold])
    return model


def apply_model(docs: DataFrame, model: Ensemble, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs' columns in keep, numbered (c0, c1, ...), with score and threshold, for each row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    shaped = modest_batches(docs).select(*numbered(keep), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    schema = T.StructType([*shaped.schema.fields[:-2], T.StructField("score", T.DoubleType()), T.StructField("threshold", T.DoubleType())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        rows, offsets = word_rows(batch.column(len(keep)))
        cut = [m.thresholds.get(x, m.common) for x in batch.column(len(keep) + 1).to_pylist()]
        return pa.record_batch([*batch.columns[: len(keep)], pa.array(m.score(rows, offsets).astype(np.float64)), pa.array(cut, pa.float64())], schema.names)

    return shaped.mapInArrow(arrow_map(work, 4 << 20), schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5), lang_threshold, flagged (score >= it) for each row of docs."""
    scored = apply_model(docs, fit(docs, labels, sample), ("doc_id",)).withColumnRenamed("c0", "doc_id")
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("threshold").alias("lang_threshold"), (F.col("score") >= F.col("threshold")).alias("flagged"))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with their columns, that are not flagged."""
    names = tuple(docs.columns)
    out = apply_model(docs, fit(docs, labels, sample), names).filter("score < threshold").select(*renamed(names))
    release_memory()  # of the fit, on the driver
    return out
