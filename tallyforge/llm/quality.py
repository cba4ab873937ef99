"""Quality classifier with hierarchical empirical Bayes over sites.

Evidence: a logistic regression on shares of byte classes and on repeated lines and words gives each document its log-odds of
quality 1; it is fitted on at most `sample` labelled rows. Sites: the probabilities of all documents are summed by
host and path in one grouped aggregation. Moments of these sums give the strengths of two Beta priors: a host's
posterior shrinks toward the global mean, a path's toward its host's, so sparse sites stay near what is above them. A
document's score puts its path's posterior in the place of the global prior: logit(score) = evidence - logit(global)
+ logit(path).

Site totals hold one row for each path; they are broadcast only where their count is within BROADCAST_PATHS, and
joined by a shuffle otherwise. Sums are pre-aggregated, so a host with any share of the rows costs one row a task.

Cases: null and empty texts have zero evidence features and a score like others; texts of any length are read whole;
a null host has the global prior, a null path its host's; without labels of both kinds evidence is that of the one
label seen (kept if none); repeated rows give repeated rows; an empty table gives an empty one; other columns are
ignored by score_quality and returned as they are by keep_quality.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import SPACE, arrow_map, join_dealt, materialise, modest_batches, numbered, release_memory, renamed, scratch, text_buffers, words_of
from tallyforge.llm.labelled import SAMPLE, fit_logistic, fold, labelled_sample

BROADCAST_PATHS = 200_000
THRESHOLD = 0.5
#: Bytes whose share is a feature, by class.
CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:'\"-?()", b"!", b"|", b"%&$#*@^~+=<>{}[]\\/_`"]
N_FEATURES = len(CLASSES) + 8


def features(texts: pa.Array) -> np.ndarray:
    """Rows of N_FEATURES features, of whole texts."""
    body, ends = text_buffers(texts)
    out = np.zeros((len(texts), N_FEATURES))
    classes = np.zeros((256, len(CLASSES) + 1))
    classes[:, -1] = 1
    for i, c in enumerate(CLASSES):
        classes[list(c), i], classes[list(c), -1] = 1, 0
    words = words_of(texts, SPACE)
    same = np.concatenate([[0], np.cumsum(np.append(words.hashes[1:] == words.hashes[:-1], False))])
    last = np.maximum(words.offsets[1:] - 1, words.offsets[:-1])
    again = (same[last] - same[words.offsets[:-1]]) / np.maximum(np.diff(words.offsets), 1)
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        if a == b:
            continue
        n = np.bincount(body[a:b], minlength=256)
        share = n @ classes / (b - a)
        lines = [x for x in body[a:b].tobytes().split(b"\n") if x]
        letters = share[0] + share[1] + share[-1]
        p = n[n > 0] / (b - a)
        out[i, : len(share)] = np.log1p(share * 200)
        out[i, len(share) :] = [share[1] / (letters + 1e-9), math.log1p(letters / (share[3] + share[4] + 1e-3)), math.log1p(b - a) / 5, 1 - len(set(lines)) / max(1, len(lines)), math.log1p(len(lines) / (b - a) * 100), -(p * np.log(p)).sum() / 3, math.log1p(20 * again[i])]
    return out


class Evidence:
    """Standardised features to log-odds."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean = x.mean(0) if len(x) else np.zeros(N_FEATURES)
        self.sd = x.std(0) + 1e-6 if len(x) else np.ones(N_FEATURES)
        self.constant = None
        if len(set(y.tolist())) < 2:
            self.constant = 6.0 if not len(y) or y[0] == 1 else -6.0
        else:
            self.w = fit_logistic(self._wide(x), y)

    def _wide(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -6, 6)
        return np.column_stack([z, z * z / 3])

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = np.column_stack([self._wide(x), np.ones(len(x))]) @ self.w
        return np.clip(z[:, 1] - z[:, 0], -12, 12)


def fit_evidence(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, where: Column | None = None) -> Evidence:
    """Fitted on labelled rows (of those, where given, on the ones that pass it)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(batch.column(1))
        return pa.record_batch([batch.column(0), pa.array(list(x), pa.list_(pa.float64())), batch.column(2)], ["id", "x", "target"])

    with scratch(docs.sparkSession):
        drawn = labelled_sample(docs, labels, "quality", sample, where).select(F.col("doc_id").cast("string").alias("id"), "text", "target")
        got = drawn.mapInArrow(arrow_map(work), "id string, x array<double>, target int").toPandas().sort_values("id", kind="stable")
    return Evidence(np.array(got.x.tolist(), float).reshape(len(got), N_FEATURES), got.target.to_numpy().astype(np.int64))


def with_evidence(docs: DataFrame, model: Evidence, keep: list[str], host: Column, path: Column) -> DataFrame:
    """docs' columns in keep, numbered (c0, c1, ...), with _host, _path and _evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    shaped = modest_batches(docs).select(*numbered(keep), host.cast("string").alias("_host"), path.cast("string").alias("_path"), F.coalesce("text", F.lit("")).alias("text"))
    schema = T.StructType([*shaped.schema.fields[:-1], T.StructField("_evidence", T.DoubleType())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = shared.value.log_odds(features(batch.column(len(keep) + 2)))
        return pa.record_batch([*batch.columns[: len(keep) + 2], pa.array(found)], schema.names)

    return shaped.mapInArrow(arrow_map(work), schema)


def url_site(url: Column) -> tuple[Column, Column]:
    """Host and path level of a URL: its host in lower case, without port and "www.", and its first path segment ("/" if
    it has none). Null where there is no host."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")
    top = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]*)", 1)
    there = F.coalesce(host != "", F.lit(False))
    return F.when(there, host), F.when(there, F.when(top == "", "/").otherwise(top))


def _strength(mean: float, groups: int, rows: float, squares: float, between: float) -> float:
    """Rows that a prior is worth, from the spread of group means beyond what their sizes explain (moments)."""
    if groups < 2 or not 0 < mean < 1:
        return 1e6
    effective = (rows - squares / rows) / (groups - 1)
    spread = (between / (groups - 1) - mean * (1 - mean)) / max(effective, 1e-9)
    return float(min(1e6, max(1.0, mean * (1 - mean) / spread - 1))) if spread > 0 else 1e6


def site_posteriors(evidence: DataFrame) -> tuple[DataFrame, float, int]:
    """_host, _path, host_posterior, path_posterior of each path; the global mean; the number of paths."""
    p = 1 / (1 + F.exp(-F.col("_evidence")))
    paths = materialise(evidence.groupBy("_host", "_path").agg(F.count("*").cast("double").alias("n"), F.sum(F.round(p, 9).cast("decimal(38,9)")).cast("double").alias("s")), "paths")
    total = paths.agg(F.sum("n"), F.sum("s"), F.count("*")).first()
    if not total[0]:
        return paths.select("_host", "_path", F.lit(0.0).alias("host_posterior"), F.lit(0.0).alias("path_posterior"), F.col("n").cast("long").alias("n")), 0.5, 0
    mean = min(1 - 1e-6, max(1e-6, total[1] / total[0]))
    known = paths.filter("_host IS NOT NULL")
    hosts = known.groupBy("_host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.count("*").alias("paths"))
    h = hosts.agg(F.count("*"), F.sum("hn"), F.sum(F.col("hn") * F.col("hn")), F.sum((F.col("hs") / F.col("hn") - mean) ** 2 * F.col("hn"))).first()
    k_host = _strength(mean, h[0], h[1] or 1.0, h[2] or 1.0, h[3] or 0.0)
    hosts = hosts.withColumn("host_posterior", (F.col("hs") + k_host * mean) / (F.col("hn") + k_host))
    few = total[2] <= BROADCAST_PATHS
    sides = hosts.select("_host", "host_posterior") if few else materialise(hosts.select("_host", "host_posterior", F.col("paths").alias("n")), "hosts")
    # hosts are no more than paths; beyond the bound the paths of a host with many are dealt over parts
    joined = known.join(F.broadcast(sides), "_host") if few else join_dealt(known.withColumnRenamed("n", "rows"), sides, "_host", "_path").withColumnRenamed("rows", "n")
    q = joined.filter("_path IS NOT NULL").agg(F.count("*"), F.sum("n"), F.sum(F.col("n") * F.col("n")), F.sum((F.col("s") / F.col("n") - F.col("host_posterior")) ** 2 * F.col("n"))).first()
    k_path = _strength(mean, q[0], q[1] or 1.0, q[2] or 1.0, q[3] or 0.0)
    own = F.when(F.col("_path").isNull(), F.col("host_posterior")).otherwise((F.col("s") + k_path * F.col("host_posterior")) / (F.col("n") + k_path))
    return joined.select("_host", "_path", "host_posterior", own.alias("path_posterior"), F.col("n").cast("long").alias("n")), mean, total[2]


def _scored(rows: DataFrame, sites: DataFrame, mean: float, paths: int) -> DataFrame:
    """rows with host_posterior, path_posterior and _score."""
    if paths <= BROADCAST_PATHS:
        s = F.broadcast(sites.select(F.col("_host").alias("_h"), F.col("_path").alias("_p"), "host_posterior", "path_posterior"))
        out = rows.join(s, (F.col("_host") == F.col("_h")) & F.col("_path").eqNullSafe(F.col("_p")), "left").drop("_h", "_p")
    else:
        # each row of a known host has its path among the sites; those of a site with many are dealt over parts by their place
        site = F.to_json(F.struct(F.col("_host").alias("h"), F.col("_path").alias("p")))
        s = materialise(sites.select(site.alias("_site"), "host_posterior", "path_posterior", "n"), "dealt-sites")
        known = rows.filter("_host IS NOT NULL").withColumns({"_site": site, "_place": F.monotonically_increasing_id()})
        none = F.lit(None).cast("double")
        out = join_dealt(known, s, "_site", "_place").drop("_site", "_place").unionByName(rows.filter("_host IS NULL").withColumns({"host_posterior": none, "path_posterior": none}))
    out = out.withColumn("host_posterior", F.coalesce("host_posterior", F.lit(mean))).withColumn("path_posterior", F.coalesce("path_posterior", F.lit(mean)))
    z = F.col("_evidence") - math.log(mean / (1 - mean)) + F.log(F.col("path_posterior") / (1 - F.col("path_posterior")))
    return out.withColumn("_score", 1 / (1 + F.exp(-z)))


def score_quality(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, host, path, evidence, host_posterior, path_posterior, score, keep, held_out for each row of docs. Labels
    of rows that are held out (crc32(doc_id) mod 5 is 0) are not learned from."""
    host, path = F.col("source") if host is None else host, F.col("lang") if path is None else path
    with scratch(docs.sparkSession) as keep:
        model = fit_evidence(docs, labels, sample, fold(F.col("doc_id")) != 0)
        rows = materialise(with_evidence(docs, model, ["doc_id"], host, path), "evidence")
        sites, mean, paths = site_posteriors(rows)
        sites = materialise(sites, "sites")
        keep(rows, sites)
    out = _scored(rows.withColumnRenamed("c0", "doc_id"), sites, mean, paths)
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return out.select("doc_id", F.col("_host").alias("host"), F.col("_path").alias("path"), (1 / (1 + F.exp(-F.col("_evidence")))).alias("evidence"), "host_posterior", "path_posterior", F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).alias("keep"), held)


def keep_quality(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with their columns, whose score is at least THRESHOLD. Texts are read twice and not shuffled
    unless there are more paths than BROADCAST_PATHS. All labels are learned from."""
    host, path = F.col("source") if host is None else host, F.col("lang") if path is None else path
    names = docs.columns
    with scratch(docs.sparkSession) as keep:
        model = fit_evidence(docs, labels, sample)
        release_memory()  # of the fit, on the driver
        sites, mean, paths = site_posteriors(with_evidence(docs, model, [], host, path))
        sites = materialise(sites, "sites")
        keep(sites)
    return _scored(with_evidence(docs, model, names, host, path), sites, mean, paths).filter(F.col("_score") >= THRESHOLD).select(*renamed(names))
