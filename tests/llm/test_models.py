"""Classifiers, mixing, sampling and the pipeline: against plain versions, accuracy and enumeration."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from pyspark.sql import functions as F

from tallyforge.llm import common, labelled, mixing, near_dup, piece_sampling, quality, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def mid(spark):
    return spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/labels.parquet")


def test_fold_is_crc32(spark):
    got = spark.createDataFrame([(i,) for i in (0, 7, 123456, None)], "doc_id long").select(labelled.fold(labelled.F.col("doc_id")).alias("f")).collect()
    assert [r.f for r in got] == [zlib.crc32(str(i).encode()) % 5 for i in (0, 7, 123456)] + [None]


# ---- quality


def test_quality_keeps_the_good(spark, mid):
    docs, labels = mid
    rows = quality.score_quality(docs, labels).join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.keep for r in good) >= 0.99 * len(good) and sum(not r.keep for r in bad) >= 0.9 * len(bad)
    good, bad = [r for r in good if r.held_out], [r for r in bad if r.held_out]
    assert sum(r.keep for r in good) >= 0.97 * len(good) > 0 and sum(not r.keep for r in bad) >= 0.85 * len(bad) > 0
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns
    known = {r.doc_id: r.quality for r in labels.collect()}
    left = {r.doc_id for r in kept.collect()}
    assert sum((i in left) == (q == 1) for i, q in known.items()) >= 0.97 * len(known)


def test_posteriors_equal_plain_sums(spark):
    r = np.random.default_rng(0)
    rows = [(h, p, float(z)) for h, p, z in zip(r.choice(["a", "a", "b", "c"], 400), r.choice(["x", "y"], 400), r.normal(1, 2, 400), strict=True)] + [("tiny", None, -3.0), (None, "x", 5.0)]
    sites, mean, n = quality.site_posteriors(spark.createDataFrame(rows, "_host string, _path string, _evidence double"))
    p = {i: 1 / (1 + math.exp(-z)) for i, (_, _, z) in enumerate(rows)}
    assert abs(mean - sum(p.values()) / len(rows)) < 1e-6 and n == 8
    got = {(x._host, x._path): (x.host_posterior, x.path_posterior) for x in sites.collect()}
    by = {h: [p[i] for i, x in enumerate(rows) if x[0] == h] for h in ("a", "b", "c", "tiny")}
    total = sum(map(len, by.values()))
    between = sum(len(v) * (sum(v) / len(v) - mean) ** 2 for v in by.values())
    k = quality._strength(mean, 4, total, sum(len(v) ** 2 for v in by.values()), between)
    for h, v in by.items():
        assert all(abs(x[0] - (sum(v) + k * mean) / (len(v) + k)) < 1e-6 for key, x in got.items() if key[0] == h)
    # a sparse site stays nearer to the global mean than its own one row is
    assert abs(got[("tiny", None)][0] - mean) < abs(by["tiny"][0] - mean)


def test_scores_equal_the_formula(spark, mid):
    rows = quality.score_quality(*mid).collect()
    p = np.array([r.evidence for r in rows])
    mean = p.sum() / len(rows)
    groups: dict = {}
    for r, x in zip(rows, p, strict=True):
        groups.setdefault(r.host, {}).setdefault(r.path, []).append(x)
    hosts = {h: [x for v in by.values() for x in v] for h, by in groups.items()}
    k = quality._strength(mean, len(hosts), len(p), sum(len(v) ** 2 for v in hosts.values()), sum(len(v) * (sum(v) / len(v) - mean) ** 2 for v in hosts.values()))
    up = {h: (sum(v) + k * mean) / (len(v) + k) for h, v in hosts.items()}
    paths = {(h, q): v for h, by in groups.items() for q, v in by.items()}
    k = quality._strength(mean, len(paths), len(p), sum(len(v) ** 2 for v in paths.values()), sum(len(v) * (sum(v) / len(v) - up[h]) ** 2 for (h, _), v in paths.items()))
    for r in rows:
        v = paths[(r.host, r.path)]
        site = (sum(v) + k * up[r.host]) / (len(v) + k)
        z = math.log(r.evidence / (1 - r.evidence)) - math.log(mean / (1 - mean)) + math.log(site / (1 - site))
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-6 and r.keep == (r.score >= 0.5)


def test_sites_move_scores(spark):
    rows = [(i, 0.0, h) for i, h in enumerate(["good"] * 200 + ["bad"] * 200)]
    df = spark.createDataFrame([(i, h, "p", 3.0 if h == "good" else -3.0) for i, _, h in rows[1:]] + [(0, "bad", "p", 0.2), (999, "new", "p", 0.2)], "doc_id long, _host string, _path string, _evidence double")
    out = {r.doc_id: r._score for r in quality._scored(df, *quality.site_posteriors(df)).collect()}
    assert out[0] < 0.5 < out[1] and out[0] < out[999]


def test_quality_on_odd_rows(spark, odd, none, labels):
    assert Counter(r.doc_id for r in quality.score_quality(odd, labels).collect()) == Counter([1, 2, 3, 4, 5, 5, None, 6])
    assert quality.score_quality(none, labels).count() == 0 and quality.keep_quality(none, labels).count() == 0
    assert quality.score_quality(odd, labels.filter("false")).filter("keep").count() == 8
    assert quality.keep_quality(odd, labels).columns == odd.columns


# ---- toxicity


def test_toxicity_on_held_out_rows(spark, mid):
    docs, labels = mid
    out = toxicity.score_toxicity(docs, labels)
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    clean, toxic = [r for r in rows if r.toxic == 0], [r for r in rows if r.toxic == 1]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean) and sum(r.predicted for r in toxic) >= 0.8 * len(toxic) > 0
    assert sum(r.flagged for r in clean) <= 0.05 * len(clean) and sum(r.flagged for r in toxic) >= 0.8 * len(toxic)
    # better than the constant answer, which is right for all clean rows
    assert sum(r.predicted == r.toxic for r in rows) > len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_scores_do_not_see_other_columns(spark, mid):
    docs, labels = mid
    model = toxicity.fit(docs, labels)
    a = {r.c0: r.score for r in toxicity.apply_model(docs, model, ("doc_id",)).collect()}
    b = {r.c0: r.score for r in toxicity.apply_model(docs.withColumn("lang", labelled.F.lit("xx")).withColumn("source", labelled.F.lit(None)), model, ("doc_id",)).collect()}
    assert a == b


def test_windows_do_not_change_scores(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["a b c d e f g", "", "x", "long " * 300 + "end", "b c"])
    m = toxicity.Model()
    rows, offsets = toxicity.word_rows(texts)
    whole = m.logits(rows, offsets)
    monkeypatch.setattr(toxicity, "WINDOW", 5)
    assert np.allclose(whole, m.logits(rows, offsets), atol=1e-5)
    alone = [m.logits(*toxicity.word_rows(pa.array([t])))[0] for t in texts.to_pylist()]
    assert np.allclose(whole, alone, atol=1e-5)


def test_gradients_are_right():
    import pyarrow as pa

    rows, offsets = toxicity.word_rows(pa.array(["a b c", "d", "", "e f a"]))
    m = toxicity.Model(3)
    m.table *= 20
    y, w = np.array([1, 0, 0, 1]), np.ones(4, np.float32)

    def loss():
        z = m.logits(rows, offsets).astype(float)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    grads, touched, g = m._gradients(rows, offsets, y, w)
    for name, at in (("conv", (1, 2, 3)), ("out", (5,)), ("bias", (9,))):
        x = getattr(m, name)
        old = x[at]
        x[at] = old + 1e-2
        up = loss()
        x[at] = old - 1e-2
        down = loss()
        x[at] = old
        assert abs((up - down) / 2e-2 - grads[name][at]) < 2e-3
    k = int(np.abs(g).sum(1).argmax())
    d = int(np.abs(g[k]).argmax())
    old = m.table[touched[k], d]
    m.table[touched[k], d] = old + 1e-2
    up = loss()
    m.table[touched[k], d] = old - 1e-2
    assert abs((up - loss()) / 2e-2 - g[k, d]) < 2e-3


def test_toxicity_on_odd_rows(spark, odd, none, labels):
    rows = toxicity.score_toxicity(odd, labels).collect()
    assert Counter(r.doc_id for r in rows) == Counter([1, 2, 3, 4, 5, 5, None, 6]) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert {r.score for r in toxicity.score_toxicity(odd, labels.filter("toxic = 0")).collect()} == {0.0}
    assert toxicity.drop_toxic(odd, labels.filter("false")).count() == 8 and toxicity.drop_toxic(odd, labels).columns == odd.columns


# ---- mixing


def test_targets_are_met(spark, mid):
    docs, labels = mid
    rows = mixing.mixing_rates(docs, labels).collect()
    model = mixing.fit_domains(docs, labels)
    post = {r.doc_id: (r.tokens, r.p) for r in mixing._posteriors(docs, model).collect()}
    total = sum(t for t, _ in post.values())
    rate = {r.doc_id: r.rate for r in rows}
    share = sum((rate[i] * t * np.array(p) for i, (t, p) in post.items()), np.zeros(4)) / total
    want = [mixing.TARGETS[n] for n in model.names]
    assert np.abs(share - want).max() < 1e-3 and min(rate.values()) >= 0
    assert sum(r.domain == d.lang for r, d in zip(sorted(rows, key=lambda r: r.doc_id), sorted(docs.collect(), key=lambda d: d.doc_id), strict=True)) >= 0.97 * len(rows)
    assert Counter(r.doc_id for r in mixing.mix(docs, labels).collect()) == Counter({r.doc_id: r.copies for r in rows if r.copies})


def test_no_domain_is_dropped():
    domain = [f"d{i % 70:02}" for i in range(700)]
    x = np.zeros((700, 256))
    x[np.arange(700), [int(d[1:]) for d in domain]] = 1
    model = mixing.Domains(x, domain)
    assert model.names == sorted(set(domain)) and [model.names[i] for i in model.posterior(x).argmax(1)] == domain
    t = mixing._target_vector(model, dict.fromkeys(model.names, 1 / 70))
    assert np.allclose(t, 1 / 70)


def test_targets_outside_the_sample(spark, docs, caplog):
    rows = docs([(i, f"{'aei ' if i % 3 == 0 else 'xyz ' if i % 3 == 1 else 'mno '}" * 9, ("a", "b", "c")[i % 3], None, 9) for i in range(30)])
    some = spark.createDataFrame([(i, 1, 0) for i in range(30) if i % 3 < 2], "doc_id long, quality int, toxic int")
    for f in (mixing.mixing_rates, mixing.mix):
        with pytest.raises(ValueError, match="'c'"):
            f(rows, some, {"a": 0.5, "b": 0.3, "c": 0.2})
    with caplog.at_level("WARNING", mixing.__name__):
        assert mixing.mixing_rates(rows, some, {"a": 0.5, "b": 0.3, "none": 0.2}).count() == 30
    assert "'none'" in caplog.text


def test_residual_is_reported(spark, caplog):
    rows = spark.createDataFrame([(10, [0.6, 0.4]), (10, [0.4, 0.6])], "tokens long, p array<double>")
    with caplog.at_level("WARNING", mixing.__name__):
        steps, residual = mixing.fit_rates(rows, np.array([0.5, 0.5]))
        assert len(steps) < mixing.STEPS and residual < mixing.CLOSE and not caplog.text
        steps, residual = mixing.fit_rates(rows, np.array([1.0, 0.0]))
    assert len(steps) == mixing.STEPS and residual > mixing.CLOSE and "largest residual" in caplog.text


def test_rates_equal_a_plain_fit(spark):
    """The replayed fit against one that keeps each document's rate, on plain sums."""
    r = np.random.default_rng(9)
    p = r.dirichlet([0.5, 0.8, 1.5], 200)
    t = r.integers(0, 90, 200)
    target = np.array([0.5, 0.2, 0.3])
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, p, strict=True)], "tokens long, p array<double>")
    steps, residual = mixing.fit_rates(df, target)
    rate, weigh = np.ones(200), np.linalg.pinv(sum(a * np.outer(b, b) for a, b in zip(t, p, strict=True)) / t.sum() + 1e-9 * np.eye(3))
    for _ in range(len(steps)):
        error = sum(x * a * b for x, a, b in zip(rate, t, p, strict=True)) / t.sum() - target
        rate = np.maximum(rate - p @ (weigh @ error), 0)
    assert np.abs(rate - mixing.rates(p, steps)).max() < 1e-4
    assert abs(residual - np.abs((rate * t) @ p / t.sum() - target).max()) < 1e-5 and residual < mixing.CLOSE


def test_rates_stay_nonnegative(spark):
    r = np.random.default_rng(1)
    p = r.dirichlet([0.2, 0.2, 0.2], 500)
    t = r.integers(0, 50, 500)
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, p, strict=True)], "tokens long, p array<double>")
    target = np.array([0.9, 0.1, 0.0])
    steps, _ = mixing.fit_rates(df, target)
    rate = mixing.rates(p, steps)
    assert rate.min() >= 0 and np.abs((rate * t) @ p / t.sum() - target).max() < 0.05
    assert (rate[p[:, 2] > 0.9] < 0.2).all()


def test_copies_have_the_mean_of_the_rate():
    import pyarrow as pa

    ids = pa.array(list(range(20_000)))
    c = mixing.copies(np.full(20_000, 1.3), ids)
    assert abs(c.mean() - 1.3) < 0.02 and set(c.tolist()) == {1, 2} and (c == mixing.copies(np.full(20_000, 1.3), ids)).all()


def test_mixing_on_odd_rows(spark, odd, none, labels):
    rows = mixing.mixing_rates(odd, labels).collect()
    assert Counter(r.doc_id for r in rows) == Counter([1, 2, 3, 4, 5, 5, None, 6]) and all(r.rate == 1 for r in rows if not r.tokens)
    assert mixing.mixing_rates(none, labels).count() == 0 and mixing.mix(none, labels).count() == 0
    assert mixing.mix(odd, labels.filter("false")).count() == 8 and mixing.mix(odd, labels).columns == odd.columns


# ---- segmentations


def every_segmentation(model, text):
    raw = (" " + text).encode()
    known = {b: i for i, b in enumerate(model.bytes_of) if model.log_weight[i] > -np.inf and i not in set(model.byte_id.tolist())}

    def walk(at):
        if at == len(raw):
            return [((), 0.0)]
        return [((known[raw[at:to]], *rest), w + model.log_weight[known[raw[at:to]]]) for to in range(at + 1, len(raw) + 1) if raw[at:to] in known and b" " not in raw[at + 1 : to] for rest, w in walk(to)]

    found = walk(0)
    z = np.logaddexp.reduce([w for _, w in found])
    return {k: float(w - z) for k, w in found}


@pytest.mark.parametrize("text", ["the", "a b", "hello", "to be"])
def test_samples_follow_the_distribution(text):
    model = piece_sampling.pieces(PIECES)
    want = every_segmentation(model, text)
    n = 3000
    t = piece_sampling.Texts(model, [text] * n, piece_sampling.mix(np.arange(n, dtype=np.uint64)))
    found = [[(tuple(t.ids(a).tolist()), lp, g, q) for a, lp, g, q in x] for x in t.top_k(3)]
    p = {k: math.exp(v) for k, v in want.items()}
    first, second = Counter(x[0][0] for x in found), Counter(x[1][0] for x in found)
    for k in sorted(p, key=p.get)[-4:]:
        assert abs(first[k] / n - p[k]) < 0.04
        assert abs(second[k] / n - sum(p[j] * p[k] / (1 - p[j]) for j in p if j != k)) < 0.04
    for x in found:
        assert len({k for k, *_ in x}) == len(x) == min(3, len(want)) and [g for *_, g, _ in x] == sorted((g for *_, g, _ in x), reverse=True)
        assert all(abs(lp - want[k]) < 1e-9 for k, lp, *_ in x)
    # inclusion scores: weighted by their inverse, sampled probabilities add up to 1 on average
    assert abs(np.mean([sum(p[k] / q for k, _, _, q in x) for x in found]) - 1) < 0.1


def every_segmentation_with_runs(model, text):
    """As above, with the pieces that are runs of marks."""
    raw = (" " + text).encode()
    known = {b: i for i, b in enumerate(model.bytes_of) if b and i not in set(model.byte_id.tolist())}

    def walk(at):
        if at == len(raw):
            return [((), 0.0)]
        return [((known[raw[at:to]], *rest), w + model.log_weight[known[raw[at:to]]]) for to in range(at + 1, len(raw) + 1) if raw[at:to] in known for rest, w in walk(to)]

    found = walk(0)
    z = np.logaddexp.reduce([w for _, w in found])
    return {k: float(w - z) for k, w in found}


@pytest.mark.parametrize("text", ["a    b", "   if", "x  ", "  ", "a   "])
def test_runs_of_marks_are_sampled(text):
    import sentencepiece

    model = piece_sampling.pieces(PIECES)
    want = every_segmentation_with_runs(model, text)
    assert tuple(sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(text)) in want and max(map(len, model.bytes_of)) <= 25
    t = piece_sampling.Texts(model, [text, text[:-1], " "], np.arange(3, dtype=np.uint64))
    got, *others = t.top_k(5000)
    assert {tuple(t.ids(a).tolist()) for a, *_ in got} == set(want)
    assert all(abs(lp - want[tuple(t.ids(a).tolist())]) < 1e-9 for a, lp, *_ in got)
    # the texts of a batch stay apart, also where one ends in marks
    assert all(b"".join(model.bytes_of[i] for i in t.ids(a)) == (" " + x).encode() for x, found in zip([text[:-1], " "], others, strict=True) for a, *_ in found)
    n = 3000
    t = piece_sampling.Texts(model, [text] * n, piece_sampling.mix(np.arange(n, dtype=np.uint64)))
    first = Counter(tuple(t.ids(x[0][0]).tolist()) for x in t.top_k(1))
    assert all(abs(first[k] / n - math.exp(v)) < 0.04 for k, v in want.items())


def plain_beta(model, raw):
    """Log masses of the rest of a word from each byte on, one lattice for all of it."""
    known = {b: w for i, (b, w) in enumerate(zip(model.bytes_of, model.log_weight, strict=True)) if b and i not in set(model.byte_id.tolist())}
    chars = [i for i in range(len(raw)) if raw[i] & 0xC0 != 0x80] + [len(raw)]
    arcs = {(a, a + n): known[raw[a : a + n]] for a in chars[:-1] for n in range(1, 26) if raw[a : a + n] in known and a + n <= len(raw)}
    arcs |= {(x, x + 1): model.log_weight[model.byte_id[raw[x]]] for a, b in zip(chars, chars[1:], strict=False) if (a, b) not in arcs for x in range(a, b)}
    beta = np.append(np.full(len(raw), -np.inf), 0.0)
    for a in range(len(raw) - 1, -1, -1):
        out = [w + beta[a + n] for n in range(1, 26) if (w := arcs.get((a, a + n))) is not None]
        beta[a] = np.logaddexp.reduce(out) if out else -np.inf
    return arcs, beta


URL = "https://example.org/documentation/internationalization/administration/reference/index.html"


@pytest.mark.parametrize("text", [URL, "a" * 64 + "é漢\x00" * 40, "-" * 300, "b" + " " * 200 + "c", "/srv/data/" * 1000 + "end"])
def test_long_words_have_whole_lattices(text):
    model = piece_sampling.pieces(PIECES)
    arcs, beta = plain_beta(model, (" " + text).encode())
    t = piece_sampling.Texts(model, ["before it", text, "after", text + " x"], np.arange(4, dtype=np.uint64))
    own = t.top_k(3)[1]
    assert len({tuple(t.ids(a).tolist()) for a, *_ in own}) == 3
    for a, lp, *_ in own:
        ids = t.ids(a).tolist()
        assert b"".join(model.bytes_of[i] for i in ids) == (" " + text).encode()
        ends = np.cumsum([len(model.bytes_of[i]) for i in ids]).tolist()
        plain = sum(arcs[x] for x in zip([0, *ends], ends, strict=False)) - beta[0]
        assert abs(lp - plain) < 1e-7 * max(1, -plain)


def test_pieces_at_any_place_of_a_long_word_are_sampled():
    model = piece_sampling.pieces(PIECES)
    arcs, beta = plain_beta(model, (" " + URL).encode())
    alpha = np.append(0.0, np.full(len(URL) + 1, -np.inf))
    for (a, b), w in sorted(arcs.items()):
        alpha[b] = np.logaddexp(alpha[b], alpha[a] + w)
    want = {k: math.exp(alpha[k[0]] + w + beta[k[1]] - beta[0]) for k, w in arcs.items()}
    n, got = 3000, Counter()
    t = piece_sampling.Texts(model, [URL] * n, piece_sampling.mix(np.arange(n, dtype=np.uint64)))
    for x in t.top_k(1):
        ends = np.cumsum([len(model.bytes_of[i]) for i in t.ids(x[0][0]).tolist()]).tolist()
        got.update(zip([0, *ends], ends, strict=False))
    assert max(abs(got[k] / n - p) for k, p in want.items()) < 0.05 and set(got) <= set(want)
    assert any(got[k] for k in want if k[0] < 64 < k[1]) and got[(56, 65)] > 0


def test_all_segmentations_when_few():
    model = piece_sampling.pieces(PIECES)
    t = piece_sampling.Texts(model, ["the", "", "\n"], np.arange(3, dtype=np.uint64))
    got = t.top_k(50)
    assert {tuple(t.ids(a).tolist()) for a, *_ in got[0]} == set(every_segmentation(model, "the")) and all(q == 1 for *_, q in got[0])
    assert len(got[1]) == 1 and len(got[1][0][0]) == 0 and len(got[2]) >= 1


@pytest.mark.parametrize("text", [" " * 7, "a" + " " * 7, " " * 6 + "if"])
def test_unlikely_segmentations_are_found_too(text):
    """All of them, also where masses are far below e^-40."""
    model = piece_sampling.pieces(PIECES)
    want = every_segmentation_with_runs(model, text)
    t = piece_sampling.Texts(model, [text], np.arange(1, dtype=np.uint64))
    got = t.top_k(len(want) + 1)[0]
    assert min(want.values()) < -60 and len(got) == len(want) and {tuple(t.ids(a).tolist()) for a, *_ in got} == set(want)
    assert [g for *_, g, _ in got] == sorted((g for *_, g, _ in got), reverse=True) and all(q == 1 for *_, q in got)


def test_words_kept_from_other_batches_change_nothing():
    texts = ["some words and more words", "other é 漢 \x00 text", "x" * 300]
    keys = np.arange(3, dtype=np.uint64)

    def run(model):
        t = piece_sampling.Texts(model, texts, keys)
        return [[(t.ids(a).tolist(), lp, g, q) for a, lp, g, q in x] for x in t.top_k(2)]

    fresh, used = piece_sampling.Pieces(PIECES), piece_sampling.Pieces(PIECES)
    piece_sampling.Texts(used, ["more words before these", "text"], keys[:2]).top_k(2)
    assert run(fresh) == run(used)


def test_repeated_words_are_kept_from_a_batch_with_more_words_than_are_kept(monkeypatch):
    texts = [" ".join(f"w{i}" for i in range(50)), "often and often", "often w1 w77"]
    keys = np.arange(3, dtype=np.uint64)

    def run(model, part):
        t = piece_sampling.Texts(model, texts[part], keys[part])
        return [[(t.ids(a).tolist(), lp, g, q) for a, lp, g, q in x] for x in t.top_k(2)]

    want = run(piece_sampling.Pieces(PIECES), slice(2, 3))
    monkeypatch.setattr(piece_sampling, "KEPT", 20)
    model = piece_sampling.Pieces(PIECES)
    run(model, slice(0, 2))
    assert len(model.kept[0]) == 1 and run(model, slice(2, 3)) == want
    run(model, slice(0, 3))
    assert len(model.kept[0]) == 2 and run(model, slice(2, 3)) == want


def test_decoding_round_trip(spark, odd, none):
    out = piece_sampling.sample_segmentations(odd, PIECES, 2)
    text = {r.doc_id: (r.text or "") for r in odd.collect()}
    rows = piece_sampling.decode_ids(out, PIECES).collect()
    assert all(r.text == text[r.doc_id] for r in rows) and Counter(r.doc_id for r in rows if r.sample == 1) == Counter([1, 2, 3, 4, 5, 5, None, 6])
    assert all(r.round_trip for r in piece_sampling.sampling_digest(odd, PIECES).collect())
    assert piece_sampling.sample_segmentations(none, PIECES).count() == 0
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    model = piece_sampling.pieces(PIECES)
    assert all(piece_sampling.decode(model, sp.encode(t)) == t for t in ["Hello  world\n\nfoo\tbar", " lead", "é 漢 \x00"])


def test_the_query_decodes_its_samples(spark, odd, tmp_path):
    """A word mark in a text comes back as a space, so such a text is not the one that was given; all others are."""
    from tallyforge.llm import queries

    more = [(10, "a▁b"), (11, "▁"), (12, "x = 1,   y\n    if x:\treturn"), (13, URL * 30), (14, "<s> </s> <unk> <0x41> 漢字 \x01\x7f\ufeff"), (15, "   ")]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    got = queries.op1_piece_sampling(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(text)
    decoded = piece_sampling.decode_ids(piece_sampling.sample_segmentations(docs, PIECES), PIECES).collect()
    assert Counter((r.doc_id, r.sample, r.round_trip) for r in got) == Counter((r.doc_id, r.sample, r.text == text[r.doc_id]) for r in decoded)
    assert {r.doc_id for r in got if not r.round_trip} == {10, 11}


# ---- pipeline


def test_stages_take_effect(spark, mid, tmp_path):
    docs, labels = mid
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_dedup", "mixing", "encoding"]
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, MID)
        if name != "encoding":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] > seen[3] and seen[5] >= seen[4]


def test_stages_on_odd_rows(spark, odd):
    docs, want = odd, Counter(r.doc_id for r in odd.collect())
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, MID)
        if name != "encoding":
            assert docs.columns == odd.columns
    assert set(Counter(r.doc_id for r in docs.collect())) <= set(want)


def test_run_leaves_its_last_table_only(spark, tmp_path):
    import os

    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    app = common.shared_dir(spark).removeprefix("file://") + f"/tallyforge-{spark.sparkContext.applicationId}"
    before = set(os.listdir(app)) if os.path.isdir(app) else set()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and [x.rsplit("-", 1)[0] for x in set(os.listdir(app)) - before] == ["pipeline-encoding"]


def test_pipeline_on_empty_documents(spark, none):
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, MID)
    assert docs.count() == 0


# ---- ids and names of any kind


def test_stages_keep_odd_columns_and_ids(spark, odd, odd_text_ids, labels):
    for docs in (odd, odd_text_ids):
        want = Counter(r.doc_id for r in docs.collect())
        own = labels.selectExpr("concat('doc/', doc_id) doc_id", "quality", "toxic") if docs is odd_text_ids else labels
        for out in (quality.keep_quality(docs, own), toxicity.drop_toxic(docs, own.filter("false")), mixing.mix(docs, own.filter("false")), near_dup.keep_one(docs)):
            assert out.schema.simpleString() == docs.schema.simpleString()
            got = out.collect()
            assert all(tuple(r)[5:] == tuple(range(len(docs.columns) - 5)) for r in got) and not Counter(r.doc_id for r in got) - want
        assert Counter(r.doc_id for r in near_dup.keep_one(docs).collect()) == Counter(set(want))
        for scored in (quality.score_quality(docs, own), toxicity.score_toxicity(docs, own), mixing.mixing_rates(docs, own), near_dup.near_duplicates(docs), piece_sampling.encode_best(docs, PIECES), piece_sampling.sampling_digest(docs, PIECES).filter("sample = 1")):
            assert Counter(r.doc_id for r in scored.collect()) == want and scored.schema["doc_id"].dataType == docs.schema["doc_id"].dataType


def test_best_encoding_is_the_library_s(spark, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = piece_sampling.encode_best(odd, PIECES)
    text = {r.doc_id: r.text or "" for r in odd.collect()}
    assert all(r.ids == sp.encode(text[r.doc_id]) and r.n_pieces == len(r.ids) for r in got.collect())
    assert all(r.text == sp.decode(sp.encode(text[r.doc_id])) for r in piece_sampling.decode_ids(got, PIECES).collect())


# ---- samples and storage


def test_sample_is_bounded_in_bytes(spark, docs):
    rows = docs([(i, "x" * (1000 if i == 7 else 10), "en", "s", 1) for i in range(40)] + [(3, "x" * 10, "en", "s", 1)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = labelled.labelled_sample(rows, labels, "quality", most_bytes=390).collect()
    assert len(got) == 39 and 7 not in {r.doc_id for r in got} and all(len(r.text) == 10 and r.target == r.doc_id % 2 for r in got)
    assert len(labelled.labelled_sample(rows, labels, "quality", most_bytes=100).collect()) == 10
    assert len(labelled.labelled_sample(rows, labels, "quality", rows=5).collect()) == 5


def test_tables_are_left_for_what_is_returned_only(spark, mid):
    import os

    docs, labels = mid
    app = common.shared_dir(spark).removeprefix("file://") + f"/tallyforge-{spark.sparkContext.applicationId}"
    for run, left in ((lambda: quality.keep_quality(docs, labels), 1), (lambda: toxicity.drop_toxic(docs, labels), 0), (lambda: mixing.mix(docs, labels), 0), (lambda: near_dup.keep_one(docs), 2)):
        before = set(os.listdir(app)) if os.path.isdir(app) else set()
        run().count()
        assert len(set(os.listdir(app)) - before) == left


def test_no_folder_of_one_machine_on_a_cluster(spark, monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


def test_sites_of_urls(spark):
    rows = [("http://www.A.example.com:80/fr/825?page=2#x",), ("https://m.b.org",), ("https://u@c.net/x/",), ("no url",), (None,)]
    host, path = quality.url_site(labelled.F.col("url"))
    got = [(r.h, r.p) for r in spark.createDataFrame(rows, "url string").select(host.alias("h"), path.alias("p")).collect()]
    assert got == [("a.example.com", "/fr"), ("m.b.org", "/"), ("c.net", "/x"), (None, None), (None, None)]


def test_sparse_sites_shrink_toward_what_is_above_them(spark, mid):
    """Planted sites: a good one and a bad one with many rows, and hosts and paths of one row each."""
    docs, labels = mid
    good = F.col("quality") == 1
    rows = docs.join(labels, "doc_id", "left").withColumn("url", F.when(F.col("doc_id") % 25 == 0, F.concat(F.lit("https://h"), "doc_id", F.lit(".org/a"))).otherwise(F.concat(F.when(F.coalesce(good, F.col("doc_id") % 2 == 0), "https://good.org/p").otherwise("https://bad.org/p"), F.when(F.col("doc_id") % 10 == 1, F.col("doc_id").cast("string")).otherwise(""))))
    out = quality.score_quality(rows.drop("quality", "toxic"), labels, *quality.url_site(F.col("url"))).collect()
    mean = sum(r.evidence for r in out) / len(out)
    sparse = [r for r in out if r.host.startswith("h")]
    assert len(sparse) > 20 and all(abs(r.host_posterior - mean) < abs(r.evidence - mean) + 1e-9 for r in sparse)
    big = {h: next(r.host_posterior for r in out if r.host == h) for h in ("good.org", "bad.org")}
    assert big["good.org"] > big["bad.org"]
    single = [r for r in out if r.host in big and r.path != "/p"]
    assert len(single) > 20 and all(abs(r.path_posterior - r.host_posterior) <= abs(r.evidence - r.host_posterior) + 1e-9 for r in single)
