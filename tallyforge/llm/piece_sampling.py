"""SentencePiece segmentations: Gumbel top-k sampling without replacement, and decoding.

The lattice of a text has an arc for each vocabulary piece (and byte pieces where no piece has the character). A
piece of merge rank n weighs 1 / (n + RANK0), by Zipf's law, so a segmentation has a probability among all
segmentations of its text. Top-k by Gumbel-perturbed log-probabilities is a sample without replacement; it is found by
best-first search from the top: a queue entry stands for a set of segmentations that share a beginning, with the
exact mass of that set (from a backward pass over the lattice) as its bound, and the largest perturbed value of the
set, drawn from the mass alone. The best entry is opened by walking down to its best segmentation; all that leaves
this walk, at whatever place, becomes one entry, its value drawn below the one that was opened. When such an entry is
the best, the place where its best segmentation leaves is drawn by mass; the other places stay an entry, as do the other
arcs of that place. So the entries and the segmentations found always make up the whole lattice. Each walk ends in a new
segmentation, in order of perturbed value. With kappa, the next value after the k-th, an item's inclusion score is
1 - exp(-exp(log-probability - kappa)).

No piece holds a word mark after another character than a mark, so a run of marks and the word after it have a lattice
of their own: each distinct such word's lattice is built once for a batch, in numpy, and a walk is drawn for all words
of a batch at once. A model with other pieces is refused. Runs of marks have no merge rank; they weigh what bytes do.
All draws come from a hash of the row's key, the walk and the place in the text.

Words of any length have a whole lattice. The backward pass takes the last DEPTH nodes of all words at once; longer
words go on node by node, in parts of PART nodes that take over the masses after them, and are walked node by node.

Cases: null and empty texts have the one segmentation without pieces; a text with fewer than k segmentations gives
all it has, inclusion 1; texts of any length are segmented whole; null doc_ids share one key; repeated rows give equal
rows; an empty table gives an empty one; other columns are ignored. A word mark in a text decodes to a space, as
in the library.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import arrow_map, doc_text, kind_of, mix, modest_batches, numbered, renamed
from tallyforge.llm.common import _power_tables as power_tables
from tallyforge.llm.mixing import hash_id

RANK0 = 10.0
#: Bytes of a word up to which all words are handled at once; nodes of one part of the backward pass beyond that.
DEPTH, PART = 64, 4096
SLOT_BITS, LONGER_BITS = 18, 17
#: Words whose lattices are built at a time.
WORDS = 4096
#: Text of one batch, and words, and nodes of theirs, whose lattices a task keeps from batch to batch.
BATCH_BYTES, KEPT, KEPT_NODES = 1 << 19, 40_000, 400_000
STEP, TURN = 0x9E3779B97F4A7C15, 0xA0761D6478BD642F
MARK = "▁"
_models: dict = {}


class Pieces:
    """The pieces of a model: bytes (word mark as a space), log weights, and a table to look them up."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.log_weight = np.full(n, -np.inf)
        self.byte_id = np.zeros(256, np.int32)
        found: dict[int, list] = {}
        for i in range(n):
            piece, score = sp.id_to_piece(i), sp.get_score(i)
            if sp.is_control(i) or sp.is_unknown(i):
                continue
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value], self.bytes_of[i] = i, bytes([value])
                self.log_weight[i] = -math.log(n + RANK0)
                continue
            raw = self.bytes_of[i] = piece.replace(MARK, " ").encode()
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"piece {i} of {path} has a word mark inside: {piece!r}")
            # what has no merge rank is a run of marks or a single character; others are not used
            if score < -1e8 and len(piece) > 1 and piece.strip(MARK):
                continue
            self.log_weight[i] = -math.log(min(-score, n) + RANK0)
            found.setdefault(len(raw), []).append((i, raw))
        self.forget()
        # one open-addressed table of all pieces by hash: key 0 is an empty slot
        self.sizes = sorted(found)
        self.slot_key, self.slot_id = np.zeros((1 << SLOT_BITS) + 64, np.uint64), np.zeros((1 << SLOT_BITS) + 64, np.int32)
        for size in self.sizes:
            rows = found[size]
            h = poly(np.frombuffer(b"".join(r for _, r in rows), np.uint8), np.arange(len(rows)) * size, np.arange(1, len(rows) + 1) * size)
            for key, (i, _) in zip(h, rows, strict=True):
                at = int(key >> np.uint64(64 - SLOT_BITS))
                while self.slot_key[at]:
                    at += 1
                self.slot_key[at], self.slot_id[at] = key, i
        # for each length, by hash, whether longer pieces begin so (now and then true by accident, which costs a lookup)
        self.longer = {}
        for n in self.sizes:
            starts = sorted({r[:n] for size in self.sizes if size > n for _, r in found[size]})
            self.longer[n] = np.zeros(1 << LONGER_BITS, bool)
            if starts:
                h = poly(np.frombuffer(b"".join(starts), np.uint8), np.arange(len(starts)) * n, np.arange(1, len(starts) + 1) * n)
                self.longer[n][(h >> np.uint64(64 - LONGER_BITS)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are pieces, and their ids."""
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        key = self.slot_key[slot]
        more = np.flatnonzero((key != h) & (key != 0))
        while len(more):
            slot[more] += 1
            key[more] = self.slot_key[slot[more]]
            more = more[(key[more] != h[more]) & (key[more] != 0)]
        hit = np.flatnonzero(key == h)
        return hit, self.slot_id[slot[hit]]

    def forget(self) -> None:
        """Drop the lattices kept from earlier batches."""
        self.kept: tuple = (np.zeros(0, np.uint64), None)
        self.order = np.zeros(0, np.int64)

    def lattices(self, h: np.ndarray, many: np.ndarray, body: np.ndarray, starts: np.ndarray, stops: np.ndarray, sums: np.ndarray) -> tuple[Lattices, np.ndarray]:
        """Lattices of the words with these distinct hashes, and the row of each. Words that a batch has more than once stay
        for later batches while there is room (KEPT, KEPT_NODES)."""
        known, kept = self.kept
        k = np.minimum(np.searchsorted(known, h, sorter=self.order), max(0, len(known) - 1)) if len(known) else np.zeros(len(h), np.int64)
        old = (known[self.order[k]] == h) if len(known) else np.zeros(len(h), bool)
        new = np.flatnonzero(~old)
        new = new[np.argsort(many[new] < 2, kind="stable")]
        row = np.empty(len(h), np.int64)
        row[old] = self.order[k[old]] if len(known) else 0
        row[new] = len(known) + np.arange(len(new))
        nodes = np.cumsum(stops[new] - starts[new] + 1)
        stay = min(int(np.searchsorted(nodes, KEPT_NODES - (len(kept.ends) if kept else 0), "right")), KEPT - len(known), int(np.count_nonzero(many[new] > 1)))

        def built(words: np.ndarray) -> list[Lattices]:
            return [Lattices(self, body, starts[words[at : at + WORDS]], stops[words[at : at + WORDS]], sums) for at in range(0, len(words), WORDS)]

        if stay:
            kept = Lattices.joined([*([kept] if kept else []), *built(new[:stay])])
            self.kept = np.append(known, h[new[:stay]]), kept
            self.order = np.argsort(self.kept[0], kind="stable")
        parts = [*([kept] if kept else []), *built(new[stay:])]
        return Lattices.joined(parts) if parts else Lattices(self, body, starts, stops, sums), row


def poly(body: np.ndarray, starts: np.ndarray, stops: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the byte ranges."""
    up, down = power_tables(len(body) + 1)
    sums = prefix_sums(body) if sums is None else sums
    return mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))


def prefix_sums(body: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(body) + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * power_tables(len(body) + 1)[0][: len(body)], out=sums[1:])
    return sums


def pieces(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def _uniform(key: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit keys."""
    return ((mix(key) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _uniforms(key: int, step: int, at: int = 0) -> Iterator[float]:
    """_uniform of key + at * step, key + (at + 1) * step and so on."""
    n = 8
    while True:
        yield from _uniform(np.uint64(key) + np.arange(at, at + n, dtype=np.uint64) * np.uint64(step)).tolist()
        at, n = at + n, min(2 * n, PART)


class Lattices:
    """The lattices of the distinct words of some texts. Nodes are byte places; a word's last node ends it."""

    def __init__(self, model: Pieces, body: np.ndarray, starts: np.ndarray, stops: np.ndarray, sums: np.ndarray):
        size = stops - starts
        self.first = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        self.last = self.first + size
        total = int((size + 1).sum())
        word = np.repeat(np.arange(len(size)), size)
        node = np.arange(len(word)) + word
        place = starts[word] + node - self.first[word]
        left = stops[word] - place
        head = (body[place] & 0xC0) != 0x80
        froms, tos, ids = [], [], []
        single = np.zeros(len(node), bool)
        width = np.where(body[place] < 0x80, 1, np.where(body[place] < 0xE0, 2, np.where(body[place] < 0xF0, 3, 4)))
        own = np.flatnonzero(head)
        for n in model.sizes:
            own = own[left[own] >= n]
            if not len(own):
                break
            h = poly(body, place[own], place[own] + n, sums)
            hit, hit_ids = model.find(h)
            froms.append(node[own[hit]])
            tos.append(node[own[hit]] + n)
            ids.append(hit_ids)
            one = own[hit]
            single[one[width[one] == n]] = True
            own = own[model.longer[n][(h >> np.uint64(64 - LONGER_BITS)).astype(np.int64)]]
        # characters that no piece has: their bytes, one by one
        lost = np.flatnonzero(head & ~single)
        for j in range(4):
            part = lost[(width[lost] > j) & (left[lost] > j)] + j
            froms.append(node[part])
            tos.append(node[part] + 1)
            ids.append(model.byte_id[body[place[part]]])
        f, t, i = np.concatenate(froms), np.concatenate(tos), np.concatenate(ids)
        # runs that ascend already, one for each length: a stable sort merges them
        order = np.argsort(f, kind="stable")
        f, self.to, self.id = f[order], t[order].astype(np.int32), i[order]
        weight = model.log_weight[self.id]
        self.begin = np.searchsorted(f, np.arange(total + 1)).astype(np.int32)
        beta = np.full(total, -np.inf)
        beta[self.last] = 0
        self.ends = beta == 0
        # backward, by the distance of a node from its word's end: all words that are long enough at once, up to DEPTH
        by_size = np.argsort(-size, kind="stable")
        enough = np.searchsorted(-size[by_size], -np.arange(1, min(int(size.max()) if len(size) else 0, DEPTH) + 1), "right")
        for back, n in enumerate(enough, 1):
            at_node = self.last[by_size[:n]] - back
            a, b = self.begin[at_node].astype(np.int64), self.begin[at_node + 1].astype(np.int64)
            full = b > a
            at_node, a, many = at_node[full], a[full], (b - a)[full]
            if not len(at_node):
                continue
            at = np.cumsum(many) - many
            arcs = np.repeat(a - at, many) + np.arange(int(many.sum()))
            v = weight[arcs] + beta[self.to[arcs]]
            top = np.maximum.reduceat(v, at)
            top = np.where(np.isfinite(top), top, 0)
            with np.errstate(divide="ignore"):
                beta[at_node] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, many)), at))
        for i in np.flatnonzero(size > DEPTH):
            self._backward(weight, beta, int(self.first[i]), int(self.last[i]) - DEPTH, model.sizes[-1])
        with np.errstate(invalid="ignore"):
            lp = weight + beta[self.to] - beta[f]
        self.log_p = np.where(np.isnan(lp), -np.inf, lp)
        # the likeliest arc of each node, and the probabilities of the others
        self.p = np.exp(self.log_p)
        has = np.flatnonzero(self.begin[:-1] < self.begin[1:])
        self.top_p, self.top_arc = np.zeros(total), np.zeros(total, np.int32)
        if len(f):
            self.top_p[has] = np.maximum.reduceat(self.p, self.begin[has])
            tops = np.flatnonzero(self.p == self.top_p[f])[::-1]
            self.top_arc[f[tops]] = tops
            self.p[self.top_arc[has]] = 0
        # for each arc, the probability of the others out of its node
        self.rest = 1 - self.p
        if len(f):
            self.rest[self.top_arc[has]] = np.add.reduceat(self.p, self.begin[has])

    def _backward(self, weight: np.ndarray, beta: np.ndarray, first: int, stop: int, reach: int) -> None:
        """Fill in beta from the node before `stop` down to `first`; arcs span at most `reach` nodes."""
        while stop > first:
            start = max(first, stop - PART)
            begin = self.begin[start : stop + 1]
            w, to = weight[begin[0] : begin[-1]].tolist(), (self.to[begin[0] : begin[-1]] - start).tolist()
            near, begin = beta[start : stop + reach].tolist(), (begin - begin[0]).tolist()
            for node in range(stop - start - 1, -1, -1):
                v = [w[arc] + near[to[arc]] for arc in range(begin[node], begin[node + 1])]
                top = max(v, default=-math.inf)
                if top > -math.inf:
                    near[node] = top + math.log(sum([math.exp(x - top) for x in v]))
            beta[start:stop] = near[: stop - start]
            stop = start

    @staticmethod
    def joined(parts: list[Lattices]) -> Lattices:
        """The words of the first part, then those of the next and so on."""
        if len(parts) == 1:
            return parts[0]
        out = object.__new__(Lattices)
        nodes, arcs = (np.cumsum([0, *map(len, n)]).tolist() for n in ([x.ends for x in parts], [x.to for x in parts]))
        for name, shifts in (("first", nodes), ("last", nodes), ("to", nodes), ("top_arc", arcs)):
            setattr(out, name, np.concatenate([getattr(x, name) + n for x, n in zip(parts, shifts, strict=False)]))
        out.begin = np.concatenate([*(x.begin[:-1] + n for x, n in zip(parts, arcs, strict=False)), [arcs[-1]]]).astype(np.int32)
        for name in ("id", "log_p", "p", "rest", "ends", "top_p"):
            setattr(out, name, np.concatenate([getattr(x, name) for x in parts]))
        return out

    def pick(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An arc out of each node, by probability; the same wherever the word's lattice stands."""
        k = self.top_arc[node]
        other = np.flatnonzero(u >= self.top_p[node])
        if not len(other):
            return k
        arc, end = self.begin[node[other]], self.begin[node[other] + 1]
        left = u[other] - self.top_p[node[other]]
        while len(other):
            p = self.p[arc]
            taken = (left < p) & (p > 0)
            k[other[taken]] = arc[taken]
            left, arc = left - p, arc + 1
            on = ~taken & (arc < end)  # where rounding leaves nothing beside the likeliest arc, that one stays
            other, arc, end, left = other[on], arc[on], end[on], left[on]
        return k

    def walk(self, node: int, last: int, u: Iterator[float]) -> list[int]:
        """Arcs from a node to the last of its word, each picked as above."""
        out = []
        while node < last:
            left, k = next(u), self.top_arc.item(node)
            if left >= self.top_p.item(node):
                left -= self.top_p.item(node)
                for arc in range(self.begin.item(node), self.begin.item(node + 1)):
                    p = self.p.item(arc)
                    if left < p and p > 0:
                        k = arc
                        break
                    left -= p
            out.append(k)
            node = self.to.item(k)
        return out

    def walks(self, word: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A walk through the lattice of each word: all arcs in order, and where each word's begin."""
        node, taken = self.first[word], []
        n = np.zeros(len(word), np.int64)
        deep = self.last[word] - node > DEPTH
        alone = {i: self.walk(int(node[i]), int(self.last[word[i]]), _uniforms(int(key[i]), STEP)) for i in np.flatnonzero(deep).tolist()}
        for i, arcs in alone.items():
            n[i] = len(arcs)
        live = np.flatnonzero(~deep)
        step = 0
        while len(live):
            arc = self.pick(node[live], _uniform(key[live] + np.uint64(step * STEP % (1 << 64))))
            taken.append((live, arc))
            n[live] += 1
            node[live] = self.to[arc]
            live = live[node[live] < self.last[word[live]]]
            step += 1
        at = np.concatenate([[0], np.cumsum(n)])
        out = np.zeros(at[-1], np.int32)
        for step, (own, arc) in enumerate(taken):
            out[at[own] + step] = arc
        for i, arcs in alone.items():
            out[at[i] : at[i + 1]] = arcs
        return out, at


def _below(phi: float, bound: float, u: float) -> float:
    """A Gumbel value at location phi, given that it is at most the bound."""
    return phi - float(np.logaddexp(phi - bound, math.log(-math.log(u))))


class Texts:
    """Texts of one batch, cut into words, with the lattices of the distinct ones."""

    def __init__(self, model: Pieces, texts: list[str], keys: np.ndarray):
        self.model, self.keys = model, keys
        raw = [(" " + t.replace(MARK, " ")).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        body = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        # each text begins with a mark, so no word crosses texts; a word is a run of marks and what follows it
        mark = body == 32
        first = mark.copy()
        first[1:] &= ~mark[:-1]
        first[ends[:-1][np.diff(ends) > 0]] = True
        starts = np.flatnonzero(first)
        stops = np.append(starts[1:], len(body))
        sums = prefix_sums(body)
        found, rep, self.word, many = np.unique(poly(body, starts, stops, sums), return_index=True, return_inverse=True, return_counts=True)
        self.lattice, row = model.lattices(found, many, body, starts[rep], stops[rep], sums)
        self.word = row[self.word]
        self.at = np.searchsorted(starts, ends)
        place = np.arange(len(starts)) - np.repeat(self.at[:-1], np.diff(self.at))
        self.place_key = mix(np.repeat(keys, np.diff(self.at)) + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def draw(self, sample: int) -> tuple[np.ndarray, np.ndarray]:
        return self.lattice.walks(self.word, mix(self.place_key + np.uint64(sample)))

    def top_k(self, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each text: (arcs, log-probability, perturbed value, inclusion score), best first."""
        drawn = [self.draw(s) for s in range(k)]
        with np.errstate(divide="ignore"):
            return [self._search(i, k, drawn) for i in range(len(self.keys))]

    def _search(self, i: int, k: int, drawn: list) -> list[tuple[np.ndarray, float, float, float]]:
        lat, w0, w1 = self.lattice, self.at[i], self.at[i + 1]
        if w0 == w1:
            return [(np.zeros(0, np.int64), 0.0, 0.0, 1.0)]
        u, turn = _uniforms(int(self.keys[i]), TURN, 1), itertools.count()

        # an entry: perturbed value, negated; its turn; a walk and a place in it; then either the log masses of what leaves
        # the walk at that place, the next and so on, or None and the arcs that are ruled out at that place
        queue: list[tuple] = []
        out: list[tuple] = []

        def put(phi: float, bound: float, *what) -> None:
            heapq.heappush(queue, (-_below(phi, bound, next(u)), next(turn), *what))

        def put_leaving(walk: np.ndarray, since: int, leaving: np.ndarray, bound: float) -> None:
            top = float(leaving.max(initial=-np.inf))
            if top > -np.inf:
                put(top + math.log(np.exp(leaving - top).sum()), bound, walk, since, leaving, ())

        def found(walk: np.ndarray, since: int, g: float) -> None:
            """A segmentation; what leaves it at arc `since` or later is not in the queue yet."""
            log_p = lat.log_p[walk]
            out.append((walk, float(log_p.sum()), g))
            before = np.cumsum(log_p) - log_p
            put_leaving(walk, since, before[since:] + np.log(lat.rest[walk[since:]]), g)

        arcs, at = drawn[0]
        found(arcs[at[w0] : at[w1]], 0, -math.log(-math.log(next(u))))
        while len(out) < k and queue:
            value, _, walk, place, leaving, ruled_out = heapq.heappop(queue)
            g = -value
            if leaving is not None:
                share = np.cumsum(np.exp(leaving - leaving.max()))
                j = int(np.searchsorted(share, next(u) * share[-1]))
                leaving[j] = -np.inf
                put_leaving(walk, place, leaving, g)
                place += j
                ruled_out = (int(walk[place]),)
            before = walk[:place]
            a = int(np.searchsorted(lat.begin, np.int32(walk[place]), "right") - 1)
            options = [x for x in range(lat.begin[a], lat.begin[a + 1]) if x not in ruled_out and lat.log_p[x] > -np.inf]
            share = np.cumsum(np.exp(lat.log_p[options]))
            new = options[int(np.searchsorted(share, next(u) * share[-1]))]
            others = [x for x in options if x != new]
            if others:
                phi = float(lat.log_p[before].sum() + np.log(np.exp(lat.log_p[others]).sum()))
                put(phi, g, walk, place, None, (*ruled_out, new))
            # on through this word, then along the fresh walk of the words after it
            word = self._word_of(i, before)
            tail = [new, *lat.walk(int(lat.to[new]), int(lat.last[self.word[word]]), u)]
            fresh, f_at = drawn[len(out)]
            found(np.concatenate([before, tail, fresh[f_at[word + 1] : f_at[w1]]]).astype(np.int64), place + 1, g)
        if not queue:
            return [(a, p, g, 1.0) for a, p, g in out]
        kappa = -queue[0][0]
        return [(a, p, g, float(-np.expm1(-math.exp(min(p - kappa, 50.0))))) for a, p, g in out]

    def _word_of(self, i: int, before: np.ndarray) -> int:
        """The word in which a walk stands after these arcs."""
        lat = self.lattice
        return int(self.at[i]) + int(np.count_nonzero(lat.ends[lat.to[before]]))

    def ids(self, arcs: np.ndarray) -> np.ndarray:
        return self.lattice.id[arcs]


def decode(model: Pieces, ids: list[int]) -> str:
    """The text of a segmentation: the pieces' bytes, without the mark put first."""
    raw = b"".join(map(model.bytes_of.__getitem__, ids))
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def _work(path: str, k: int, seed: int, digest: bool):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = pieces(path)
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        keys = mix(np.array([hash_id(i, seed) for i in ids], np.uint64))
        own = Texts(model, texts, keys)
        at, rows = [], []
        for n, (text, found) in enumerate(zip(texts, own.top_k(k), strict=True)):
            for s, (arcs, lp, g, inclusion) in enumerate(found, 1):
                piece_ids = own.ids(arcs)
                if digest:
                    what = (hashlib.sha256(piece_ids.astype("<i4").tobytes()).hexdigest(), decode(model, piece_ids.tolist()) == text)
                else:
                    what = (piece_ids,)
                at.append(n)
                rows.append((s, len(piece_ids), lp, g, inclusion, *what))
        kinds = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), *([pa.string(), pa.bool_()] if digest else [pa.list_(pa.int32())])]
        names = ["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "inclusion", *(["ids_sha256", "round_trip"] if digest else ["ids"])]
        return pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    return arrow_map(work, BATCH_BYTES, lambda: pieces(path).forget())


def sample_segmentations(docs: DataFrame, path: str, k: int = 2, seed: int = 0) -> DataFrame:
    """doc_id, sample (1 to k), n_pieces, log_prob, perturbed, inclusion, ids for each segmentation of each row."""
    return doc_text(modest_batches(docs)).mapInArrow(_work(path, k, seed, False), f"doc_id {kind_of(docs, 'doc_id')}, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, ids array<int>")


def sampling_digest(docs: DataFrame, path: str, k: int = 2, seed: int = 0) -> DataFrame:
    """The same with a hash in the place of ids, and whether the text that they decode to is the row's (not where it has a word
    mark, which comes back as a space)."""
    return doc_text(modest_batches(docs)).mapInArrow(_work(path, k, seed, True), f"doc_id {kind_of(docs, 'doc_id')}, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, ids_sha256 string, round_trip boolean")


def encode_best(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, ids of each row's one best segmentation: the library's own encoding, without begin and end."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = pa.array(library(path).encode(batch.column(1).to_pylist()), pa.list_(pa.int32()))
        return pa.record_batch([batch.column(0), pc.list_value_length(ids).cast(pa.int64()), ids], ["doc_id", "n_pieces", "ids"])

    return doc_text(modest_batches(docs)).mapInArrow(arrow_map(work), f"doc_id {kind_of(docs, 'doc_id')}, n_pieces long, ids array<int>")


def library(path: str):
    key = ("library", path)
    if key not in _models:
        import sentencepiece

        _models[key] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[key]


def decode_ids(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """rows with a column text decoded from an array of piece ids (null: null)."""
    names = [c for c in rows.columns if c != "text"]
    own = rows.select(*numbered(names))
    schema, at, inner = T.StructType([*own.schema.fields, T.StructField("decoded", T.StringType())]), names.index(ids), [*own.columns, "decoded"]

    def work(batches):
        model = pieces(path)
        for batch in batches:
            text = [None if x is None else decode(model, x) for x in batch.column(at).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(text, pa.string())], inner)

    return own.mapInArrow(work, schema).select(*renamed(names), F.col("decoded").alias("text"))
