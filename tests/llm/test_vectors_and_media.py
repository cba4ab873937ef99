"""Exact search, media archives and quotation links against plain versions."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyforge.llm import media, quote_threads, vector_search


def plain_top(rows, k, every):
    clean = {(i, tuple(int(np.floor(64 * np.float64(x))) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for qi, q in sorted(clean):
        if qi % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), ci) for ci, c in clean if ci != qi and len(c) == len(q))
            out += [(qi, n, ci, -s) for n, (s, ci) in enumerate(found[:k], 1)]
    return sorted(out)


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "CANDIDATES", 64)
    monkeypatch.setattr(vector_search, "QUERIES", 8)
    monkeypatch.setattr(vector_search, "AT_ONCE", 3)
    r = np.random.default_rng(3)
    base = r.standard_normal((240, 8)) / 3
    base[40:90] = base[0]  # many ties
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(base)]
    rows += [(1000, None), (1001, [1.0, None] * 4), (1002, [float("nan")] * 8), (1003, [float("inf")] * 8), (None, [0.1] * 8), (1004, []), (1020, [0.5, 0.5]), (1021, [0.25, 0.5]), rows[5], rows[20]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("vec_id", "embedding", "1 as score", "2 as rank")
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in vector_search.top_k(df, 20, 20).collect())
    assert got == plain_top([(i, v) for i, v in rows], 20, 20)
    assert vector_search.top_k(df.filter("false")).count() == 0


def test_large_components_take_part(spark):
    rows = [(0, [1e6, -3e7, 2.5]), (1, [5e5, 1.0, 1.0]), (2, [0.5, 0.25, -0.5]), (20, [2e7, 1.0, 0.0]), (3, [1e305, 1.0, 1.0]), (4, [1.7e308, -1.7e308, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(x.query_id, x.vec_id): x.score for x in vector_search.top_k(df).collect()}
    exact = {i: [int(np.floor(64 * np.float64(c))) for c in v] for i, v in rows[:4]}
    for a, b in ((0, 1), (0, 2), (0, 20), (20, 1), (20, 2)):
        assert got[(a, b)] == sum(x * y for x, y in zip(exact[a], exact[b], strict=True))
    assert got[(20, 3)] == (1 << 63) - 1 and len(got) == 10


@pytest.mark.parametrize("dim", [1, 3, 64])
def test_bounds_hold(dim):
    r = np.random.default_rng(dim)
    v = np.floor(64 * r.standard_normal((200, dim)))
    t = vector_search.pivot_table(v).astype(float)
    assert (t @ t.T + 0.5 + 1e-4 * np.abs(t).max() ** 2 >= v @ v.T).all()


def test_elimination_leaves_candidates_out():
    r = np.random.default_rng(1)
    v = np.floor(64 * r.standard_normal((3000, 16)))
    t = vector_search.pivot_table(v)
    *_, done = vector_search.search_block(v[:10], np.arange(10), t[:10], v, np.arange(3000), t, 20)
    assert done < 0.5 * 10 * 3000


def test_png_round_trip():
    for data in (b"", b"x", b"a" * 64, bytes(range(256)) * 5, b"tail\0\0"):
        padded = media.pad(data)
        assert len(padded) % 64 == 0 and len(padded) >= 64 and media.decode_png(media.encode_png(padded, len(data))) == (padded, len(data))
    broken = bytearray(media.encode_png(media.pad(b"abc"), 3))
    broken[60] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.decode_png(bytes(broken))


def test_media_query(spark, odd, none):
    got = media.store_and_digest(odd).collect()
    assert len(got) == 8 and all(r.error is None for r in got)
    for r in odd.collect():
        data = (r.text or "").encode()
        padded = data + b"\0" * ((-len(data)) % 64 or (0 if data else 64))
        own = [g for g in got if g.doc_id == r.doc_id]
        assert own and all((g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])) for g in own)
    assert len({(g.payload_sha256, g.media_sha256, g.feature) for g in got}) == len({g.payload_sha256 for g in got})
    assert media.store_and_digest(none).count() == 0


def test_ranges_cover_each_member_once(spark, docs, tmp_path):
    rows = docs([(i, f"text {i} " * (i % 50), "en", "s", 0) for i in range(300)])
    where = f"file://{tmp_path}/a"
    media.write_archives(rows, where, archive_bytes=4000)
    got = media.read_archives(spark, where, range_bytes=700).collect()
    assert sorted(r.member.split("_")[1] for r in got) == sorted(f"{i}.png" for i in range(300)) and all(r.attempts == 1 for r in got)


def test_members_are_retried_alone(tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one", b"first")
        z.writestr("two", b"second")
    infos = zipfile.ZipFile(tmp_path / "a.zip").infolist()
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("lost")
        return open(tmp_path / "a.zip", "rb")

    archive = media.Archive(flaky)
    assert archive.member(infos[1].header_offset, infos[1].compress_size, infos[1].CRC) == (b"second", 3, None)
    assert archive.member(infos[0].header_offset, infos[0].compress_size, infos[0].CRC) == (b"first", 1, None) and len(calls) == 3
    data, attempts, error = archive.member(infos[0].header_offset, infos[0].compress_size, 1, retries=1)
    assert data is None and attempts == 2 and "directory" in error
    assert archive.member(infos[0].header_offset, infos[0].compress_size, infos[0].CRC) == (b"first", 1, None)


def test_archives_of_lost_attempts_do_not_count(spark, docs, tmp_path):
    rows = docs([(i, f"text {i}", "en", "s", 0) for i in range(20)])
    where = f"file://{tmp_path}/a"
    media.write_archives(rows, where)
    first = next(p for p in (tmp_path / "a").iterdir() if p.suffix == ".zip")
    (tmp_path / "a" / "part-000000-0000-lost.zip").write_bytes(first.read_bytes()[:-30])
    got = media.read_archives(spark, where).collect()
    assert sorted(int(media.member_id(r.member)) for r in got) == list(range(20)) and not any(r.error for r in got)


def test_features_equal_plain_statistics(spark, odd_text_ids):
    got = {r.doc_id: r for r in media.store_and_digest(odd_text_ids).collect()}
    assert set(got) == {r.doc_id for r in odd_text_ids.collect()}
    for r in odd_text_ids.collect():
        data = (r.text or "").encode()
        x = list(data + b"\0" * ((-len(data)) % 64 or (0 if data else 64)))
        n = len(x)
        mean = sum(x) / n
        sd = math.sqrt(sum((v - mean) ** 2 for v in x) / n)
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(x).values())
        own = dict(part.split("=") for part in got[r.doc_id].feature.split(";"))
        assert int(own["rows"]) == n // 64 and all(abs(float(own[k]) - v) < 2e-4 for k, v in (("mean", mean), ("sd", sd), ("zero", x.count(0) / n), ("high", sum(v > 127 for v in x) / n), ("entropy", abs(entropy))))
        lines = zlib.compress(b"".join(b"\0" + bytes(x[i : i + 64]) for i in range(0, n, 64)), 1)
        chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
        png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", (64).to_bytes(4, "big") + (n // 64).to_bytes(4, "big") + b"\x08\0\0\0\0") + chunk(b"nbYt", len(data).to_bytes(8, "big")) + chunk(b"IDAT", lines) + chunk(b"IEND", b"")
        assert (got[r.doc_id].media_bytes, got[r.doc_id].media_sha256) == (len(png), hashlib.sha256(png).hexdigest())


THREAD = [
    (1, 0, "user", "Hello there\nHow are you?"), (1, 1, "assistant", "> Hello there\nFine, and you?"), (1, 2, "user", "Another topic entirely"),
    (1, 3, "assistant", "On Monday bob wrote:\n> Fine, and you?\n>> Hello there\nI am well"), (1, 4, "user", "nice"), (1, 5, "a", "> Another  TOPIC entirely\nYes"), (1, 6, "a", "> I am well\ngood"),
    (None, 3, "u", "> x"), (2, 0, "u", None), (2, 0, "u", None), (2, None, "u", "z"), (2, 1, "u", "> never said\nok"),
]


def test_quotes_become_reply_order(spark):
    df = spark.createDataFrame(THREAD, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as branch", "'x' as content")
    got = [(r.turn, r.reply_to, r.order_key, r.content) for r in quote_threads.link_quotes(df).filter("conv_id = 1").orderBy("order_key").collect()]
    assert got == [
        (0, None, [0], "Hello there\nHow are you?"), (1, 0, [1], "Fine, and you?"), (3, 1, [1, 3, 3], "I am well"), (6, 3, [1, 3, 3, 6, 6], "good"), (4, 3, [1, 3, 4], "nice"),
        (2, 1, [2], "Another topic entirely"), (5, 2, [2, 5, 5], "Yes"),
    ]
    rest = quote_threads.link_quotes(df).filter("conv_id IS NULL OR conv_id = 2").collect()
    assert len(rest) == 5 and {(r.turn, r.n_quotes, r.n_linked) for r in rest if r.conv_id == 2} == {(0, 0, 0), (None, 0, 0), (1, 1, 0)}
    assert quote_threads.link_quotes(df.filter("false")).count() == 0


FIRST = "The first point is about the harvest of this year.\nIt was good.\n\nThe second point is longer. It says that nothing was lost on the way, as some had feared.\n\nA third one."


@pytest.mark.parametrize(
    "quote",
    [
        "> It says that nothing was lost on the way, as some had feared.",
        "> The first point is about\n> the harvest of this year. It\n> was good.\n>\n> The second point is longer. It says\n> that nothing was lost on the\n> way, as some had feared.",
        "> The second point is longer. It says\n> that nothing was lost on the\n> way, as some had feared.\n>\n> A third\n> one.",
        "> was lost on the way. It was\n> good. The second point is longer. It",
    ],
)
def test_parts_of_messages_are_found(spark, quote):
    rows = [(1, 0, "a", FIRST), (1, 1, "b", "Something else. It is longer."), (1, 2, "a", "More of it"), (1, 3, "b", f"{quote}\n\nI agree")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.turn: r for r in quote_threads.link_quotes(df).collect()}
    assert (got[3].reply_to, got[3].n_quotes, got[3].n_linked, got[3].content) == (0, 1, 1, "I agree") and got[2].reply_to == 1


def test_longer_common_text_decides(spark):
    rows = [(1, 0, "a", "Yes. No. That is the whole of what I know about it."), (1, 1, "b", "Yes. No."), (1, 2, "a", "> Yes. No. That is the whole of what I know about it.\nso"), (1, 3, "b", "> Never said\nwhat")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.turn: (r.reply_to, r.n_linked) for r in quote_threads.link_quotes(df).collect()}
    assert got[2] == (0, 1) and got[3] == (2, 0)


def plain_replies(messages):
    """reply_to of each message (turn, text) of one conversation, by looking at every earlier message."""
    parsed = [(t, *quote_threads.parse(text)) for t, text in messages]
    out = {}
    for turn, _, passages in parsed:
        earlier = [(t, set(quote_threads.unit_hashes(body.split("\n")))) for t, body, _ in parsed if t < turn]
        score: dict = {}
        for level, lines in passages:
            votes: dict = {}
            for h, n in quote_threads.unit_hashes(lines).items():
                at = max((t for t, own in earlier if h in own), default=None)
                if at is not None:
                    votes[at] = votes.get(at, 0) + n
            if votes and level == 1:
                n, at = max((n, t) for t, n in votes.items())
                score[at] = score.get(at, 0) + n
        prior = max((t for t, _ in earlier), default=None)
        out[turn] = max((n, t) for t, n in score.items())[1] if score else prior
    return out


def test_replies_equal_a_plain_search(spark):
    r = np.random.default_rng(8)
    words = [f"word{i}" for i in range(60)]
    want, rows = {}, []
    for conv in range(12):
        messages: list = []
        for turn in range(14):
            own = "\n".join(". ".join(" ".join(r.choice(words, 3)) for _ in range(2)) + "." for _ in range(int(r.integers(1, 4))))
            quotes = []
            for _ in range(int(r.integers(0, 3))):
                if messages:
                    body = quote_threads.parse(messages[int(r.integers(len(messages)))][1])[0].split("\n")
                    mark = ">" * int(r.integers(1, 3))
                    quotes += [f"{mark} {x}" for x in body[: int(r.integers(1, 4))]]
            messages.append((turn * 2, "\n".join([*quotes, own])))
        rows += [(conv, t, "u", x) for t, x in messages]
        want |= {(conv, t): b for t, b in plain_replies(messages).items()}
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    linked = quote_threads.link_quotes(df).collect()
    assert {(x.conv_id, x.turn): x.reply_to for x in linked} == want and any(x.branch is not None for x in linked)
    # branches come right after what they answer: a message stands behind the one that it replies to
    place = {(x.conv_id, x.turn): i for i, x in enumerate(sorted(linked, key=lambda x: (x.conv_id, x.order_key)))}
    assert all(place[(c, b)] < place[(c, t)] for (c, t), b in want.items() if b is not None)


def test_latest_before_crosses_spans(spark, monkeypatch):
    monkeypatch.setattr(quote_threads, "SPAN", 4)
    r = np.random.default_rng(5)
    there = sorted({(int(c), int(h), int(t)) for c, h, t in zip(r.integers(0, 3, 80), r.integers(0, 2, 80), r.integers(0, 60, 80), strict=True)})
    asked = [(c, h, t) for c in range(3) for h in range(2) for t in range(0, 61, 3)]
    kind = "conv_id long, h long, turn long"
    got = {(x.conv_id, x.h, x.turn): x.before for x in quote_threads.latest_before(spark.createDataFrame(asked, kind), spark.createDataFrame(there, kind)).collect()}
    assert got == {(c, h, t): max((b for a, g, b in there if (a, g) == (c, h) and b < t), default=None) for c, h, t in asked}


def test_nested_levels():
    own, passages = quote_threads.parse("a\n> b\n> > c\n>d\nOn x y wrote:\n>> e\nf > g")
    assert own == "a\nf > g" and passages == [(1, ["b"]), (2, ["c"]), (1, ["d"]), (2, ["e"])]
