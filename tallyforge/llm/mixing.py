"""Mixing documents to target weights by soft domain membership.

A softmax regression on byte frequencies, fitted on at most `sample` rows that the labels table names, gives each
document a posterior over domains (the languages of those rows). Rates r >= 0 are then fitted so that the expected
tokens of each domain, sum of r * tokens * posterior, meet the target weights times the corpus total: projected
gradient on least squares, with the residuals weighed by the inverse second moments of the posteriors, from r = 1.
All domains of the sample are told apart. The largest residual is returned; where it is not below CLOSE after STEPS
steps, a warning gives it, too.

The fit is distributed and keeps no state by document: a document's rate follows from its posterior and the residuals
of the earlier steps, so each step is one pass that replays them and sums one number for each domain. A lost executor
costs its tasks only. Rates become whole numbers of copies by rounding up with the chance of the fraction, drawn from a
hash of the row's id.

Tokens are words between ASCII white space.

Cases: null and empty texts have no tokens, the mean posterior of a text without bytes and rate 1; texts of any length
are read whole; null doc_ids draw like one id; repeated rows get equal rates and copies; an empty table gives an
empty one; a target domain that no document has is left short, with a warning; one that documents have, but none of
the sample, is an error; fewer than two domains in the sample give rate 1;
other columns are ignored by mixing_rates and returned as they are by mix.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import LOWER, SPACE, arrow_map, doc_text, kind_of, materialise, mix as mix_bits, modest_batches, numbered, release_memory, renamed, scratch, text_buffers
from tallyforge.llm.labelled import SAMPLE, fit_logistic, labelled_sample, softmax

#: Target weights of the registered query.
TARGETS = {"en": 0.5, "de": 0.18, "fr": 0.18, "es": 0.14}
#: Steps of the fit at most; the residual that ends it.
STEPS, CLOSE = 60, 1e-5
log = logging.getLogger(__name__)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Roots of byte frequencies (rows of 256, A-Z as a-z), and the tokens of each text."""
    body, ends = text_buffers(texts)
    gap = SPACE[body]
    first = ~gap
    first[1:] &= gap[:-1]
    begins = ends[:-1][ends[:-1] < len(body)]
    first[begins] = ~gap[begins]
    total = np.concatenate([[0], np.cumsum(first)])
    out = np.zeros((len(texts), 256))
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        if b > a:
            out[i] = np.bincount(LOWER[body[a:b]], minlength=256)
    return np.sqrt(out / np.maximum(np.diff(ends), 1)[:, None]), total[ends[1:]] - total[ends[:-1]]


class Domains:
    """Posteriors over named domains."""

    def __init__(self, x: np.ndarray, domain: list[str]):
        self.names = sorted(set(map(str, domain)))
        self.mean = x.mean(0) if len(x) else np.zeros(256)
        place = {n: i for i, n in enumerate(self.names)}
        self.w = fit_logistic((x - self.mean) * 8, np.array([place[str(d)] for d in domain], int), len(self.names)) if len(self.names) > 1 else None

    def posterior(self, x: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.ones((len(x), max(1, len(self.names))))
        return softmax(np.column_stack([(x - self.mean) * 8, np.ones(len(x))]) @ self.w)


def fit_domains(docs: DataFrame, labels: DataFrame, domain: str = "lang", sample: int = SAMPLE) -> Domains:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, _ = features(batch.column(1))
        return pa.record_batch([batch.column(0), pa.array(list(x), pa.list_(pa.float64())), batch.column(2)], ["id", "x", "domain"])

    any_label = labels.select("doc_id", F.lit(1).alias("target"))
    with scratch(docs.sparkSession):
        shaped = docs.select("doc_id", "text", F.col(domain).cast("string").alias("domain"))
        drawn = labelled_sample(shaped, any_label, "target", sample, None, ("domain",)).select(F.col("doc_id").cast("string").alias("id"), "text", "domain").filter("domain IS NOT NULL")
        got = drawn.mapInArrow(arrow_map(work), "id string, x array<double>, domain string").toPandas().sort_values("id", kind="stable")
    return Domains(np.array(got.x.tolist(), float).reshape(len(got), 256), got.domain.tolist())


def rates(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """The rates that documents with posteriors p have after these steps (a vector over domains each)."""
    r = np.ones(len(p))
    for g in steps:
        r = np.maximum(r - p @ g, 0)
    return r


def fit_rates(weighted: DataFrame, targets: np.ndarray) -> tuple[list[np.ndarray], float]:
    """The steps of the fit, and the largest residual after them (as a share of all tokens). weighted: tokens (long)
    and p (array of double) of each document."""
    d = len(targets)

    def sums(steps: list[np.ndarray], moments: bool) -> np.ndarray:
        def work(batches):
            total = np.zeros(1 + d + (d * d if moments else 0))
            for batch in batches:
                t = batch.column(0).to_numpy().astype(float)
                p = batch.column(1).flatten().to_numpy().reshape(-1, d)
                w = t * rates(p, steps)
                total[0] += t.sum()
                total[1 : 1 + d] += w @ p
                if moments:
                    total[1 + d :] += ((p * t[:, None]).T @ p).reshape(-1)
            yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], ["i", "x"])

        # one row for each sum and task; decimals, so that the order of adding does not matter
        rows = weighted.select("tokens", "p").mapInArrow(work, "i long, x double").groupBy("i").agg(F.sum(F.round("x", 6).cast("decimal(38,6)")).cast("double").alias("x")).collect()
        out = np.zeros(1 + d + (d * d if moments else 0))
        for r in rows:
            out[r["i"]] = r["x"]
        return out

    steps: list[np.ndarray] = []
    weigh = None
    while True:
        got = sums(steps, weigh is None)
        total = got[0]
        if not total:
            return steps, 0.0
        if weigh is None:
            weigh = np.linalg.pinv(got[1 + d :].reshape(d, d) / total + 1e-9 * np.eye(d))
        error = got[1 : 1 + d] / total - targets
        residual = float(np.abs(error).max())
        if residual < CLOSE:
            return steps, residual
        if len(steps) == STEPS:
            log.warning("mixing: largest residual %.2g of the tokens after %d steps, above %g", residual, STEPS, CLOSE)
            return steps, residual
        steps.append(weigh @ error)


def copies(rate: np.ndarray, ids: pa.Array, seed: int = 0) -> np.ndarray:
    """Whole numbers whose mean over ids is the rate."""
    key = np.array([hash_id(i, seed) for i in ids.to_pylist()], np.uint64)
    u = (mix_bits(key) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return np.floor(np.round(rate, 6) + u).astype(np.int64)


def hash_id(i, seed: int) -> int:
    """A 64-bit key of an id: of its value where it is a whole number, of its text otherwise; nulls share one."""
    own = 0x5BD1E995 if i is None else i % (1 << 64) if isinstance(i, int) else xxhash.xxh64_intdigest(str(i))
    return (own * 0x9E3779B97F4A7C15 + seed * 0xD6E8FEB86659FD93 + 1) % (1 << 64)


def _target_vector(model: Domains, targets: dict[str, float]) -> np.ndarray:
    t = np.array([max(0.0, targets.get(n, 0.0)) for n in model.names])
    return t / t.sum() if t.sum() > 0 else np.full(len(t), 1 / max(1, len(t)))


def _check_targets(docs: DataFrame, model: Domains, targets: dict[str, float], domain: str) -> None:
    """Refuse targets of domains that documents have and the model does not know; warn of those that no document has."""
    missing = sorted(n for n, t in targets.items() if t > 0 and n not in model.names)
    if not missing or len(model.names) < 2:
        return
    there = sorted(r[0] for r in docs.select(F.col(domain).cast("string")).filter(F.col(domain).cast("string").isin(missing)).distinct().collect())
    if there:
        raise ValueError(f"targets for {there}, of which the sample of labelled documents has none: label some, or draw a larger sample")
    log.warning("mixing: no document has %s, whose targets are left short", missing)


def _posteriors(docs: DataFrame, model: Domains) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, tokens = features(batch.column(1))
        return pa.record_batch([batch.column(0), pa.array(tokens.astype(np.int64)), pa.array(list(shared.value.posterior(x)), pa.list_(pa.float64()))], ["doc_id", "tokens", "p"])

    return doc_text(modest_batches(docs)).mapInArrow(arrow_map(work), f"doc_id {kind_of(docs, 'doc_id')}, tokens long, p array<double>")


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, domain: str = "lang", sample: int = SAMPLE, seed: int = 0) -> DataFrame:
    """doc_id, domain (the likeliest), posterior (its probability), tokens, rate, copies for each row of docs, and
    residual: by how much the totals miss the targets at most, as a share of all tokens (the same in each row)."""
    model = fit_domains(docs, labels, domain, sample)
    _check_targets(docs, model, targets, domain)
    rows = materialise(_posteriors(docs, model), "posteriors")
    steps, residual = fit_rates(rows, _target_vector(model, targets)) if len(model.names) > 1 else ([], 0.0)

    def work(batches):
        for batch in batches:
            p = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            r = rates(p, steps) if steps else np.ones(len(p))
            r = np.where(batch.column(1).to_numpy() > 0, r, 1.0)
            names = np.array(model.names or [None], dtype=object)[p.argmax(1)] if len(p) else []
            out = [batch.column(0), pa.array(list(names), pa.string()), pa.array(p.max(1, initial=0)), batch.column(1), pa.array(np.round(r, 6)), pa.array(copies(r, batch.column(0), seed)), pa.array(np.full(len(r), residual))]
            yield pa.record_batch(out, ["doc_id", "domain", "posterior", "tokens", "rate", "copies", "residual"])

    return rows.mapInArrow(work, f"doc_id {kind_of(docs, 'doc_id')}, domain string, posterior double, tokens long, rate double, copies long, residual double")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, domain: str = "lang", sample: int = SAMPLE, seed: int = 0) -> DataFrame:
    """The rows of docs, with their columns, each as often as its copies. Texts are read twice and not shuffled."""
    model = fit_domains(docs, labels, domain, sample)
    release_memory()  # of the fit, on the driver
    _check_targets(docs, model, targets, domain)
    with scratch(docs.sparkSession):
        rows = materialise(_posteriors(docs, model).select("tokens", "p"), "posteriors")
        steps, _ = fit_rates(rows, _target_vector(model, targets)) if len(model.names) > 1 else ([], 0.0)
    shared = docs.sparkSession.sparkContext.broadcast((model, steps))
    names = docs.columns
    shaped = modest_batches(docs).select(*numbered(names), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").alias("key"))
    schema = T.StructType([*shaped.schema.fields[:-2], T.StructField("copies", T.LongType())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, steps = shared.value
        x, tokens = features(batch.column(len(names)))
        r = np.where(tokens > 0, rates(model.posterior(x), steps), 1.0) if steps else np.ones(len(x))
        return pa.record_batch([*batch.columns[: len(names)], pa.array(copies(r, batch.column(len(names) + 1), seed))], schema.names)

    out = shaped.mapInArrow(arrow_map(work), schema).filter("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*renamed(names))
