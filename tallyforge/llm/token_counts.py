"""Token counts by the whole-token shortcut.

Offline (once, on the driver) every vocabulary string that the tokenizer encodes alone as one token is
proved to do so by encoding it. At run time a text is cut into pre-tokens by the tokenizer's own pattern; a
pre-token in the proved set counts 1 at once, and only the rest are merged, by the library, once per distinct
pre-token and worker (a memo of bounded size).

Cases: null and empty texts count 0 tokens; texts of any length are counted whole; special strings inside a
text are cut out first and count 1 each, as the library does by default; repeated rows give repeated
rows; an empty table gives an empty one. Other columns of the input are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tallyforge.llm.common import arrow_map, doc_text, kind_of, modest_batches

#: Pre-tokens of byte-level BPE (a fixed value of the public tokenizer).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Distinct merged pre-tokens that a worker remembers, and their greatest length; beyond the number the memo starts anew.
MEMO, MEMO_LENGTH = 400_000, 64

_state: dict = {}


def whole_tokens(path: str) -> list[str]:
    """Vocabulary strings, as text, that encode alone as exactly one token. Proved by encoding each."""
    tokenizer = _tokenizer(path)
    strings = [s for s in (tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size())) if s and "�" not in s]
    return [s for s, e in zip(strings, tokenizer.encode_batch(strings, add_special_tokens=False), strict=True) if len(e.ids) == 1]


def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class PreTokenCounter:
    """Counts the tokens of texts; one for each worker process and tokenizer file."""

    def __init__(self, path: str, whole: list[str]):
        import regex

        self.tokenizer = _tokenizer(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        if config.get("normalizer") or config["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("the shortcut is proved for byte-level BPE without a normalizer only")
        added = config.get("added_tokens", [])
        if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in what stands beside them, or stand as words only, are not cut out here")
        special = [t["content"] for t in added]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.find = regex.compile(PRE_TOKEN).findall
        self.whole = dict.fromkeys(whole, 1)
        self.memo = dict(self.whole)

    def count(self, texts: list[str]) -> list[int]:
        extra = [0] * len(texts)
        cut = []
        for i, text in enumerate(texts):
            parts = self.special.split(text) if self.special and self.special.search(text) else None
            if parts is None:
                cut.append(self.find(text))
            else:
                extra[i] = len(parts) - 1
                cut.append([t for part in parts for t in self.find(part)])
        memo = self.memo
        if len(memo) > len(self.whole) + MEMO:
            memo = self.memo = dict(self.whole)
        long: dict[str, int] = {}
        rest = list({t for ts in cut for t in ts if t not in memo})
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            for t, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                (memo if len(t) <= MEMO_LENGTH else long)[t] = len(e.ids)
        get = (lambda t: long[t] if t in long else memo[t]) if long else memo.__getitem__
        return [n + sum(map(get, ts)) for n, ts in zip(extra, cut, strict=True)]


def _counter(path: str, whole: list[str]) -> PreTokenCounter:
    if path not in _state:
        _state[path] = PreTokenCounter(path, whole)
    return _state[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) for each row of docs. One pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1)
        n = pa.array(_counter(path, shared.value).count(texts.to_pylist()), pa.int64())
        size = pc.cast(pc.binary_length(texts), pa.int64())
        return pa.record_batch([batch.column(0), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from arrow_map(work, 2 << 20)(batches)

    return doc_text(modest_batches(docs)).mapInArrow(run, f"doc_id {kind_of(docs, 'doc_id')}, n_bytes long, n_tokens long, over_limit boolean")
