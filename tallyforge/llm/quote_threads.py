"""Quotation linking: conversations in reply order, without quotes.

Lines that begin with one or more ">" are quotes of that level; a run of lines of one level is a passage, and a line
such as "On ... wrote:" right before a passage belongs to it. Passages are normalised (lower case, white space
squeezed) and hashed: each line, each paragraph (a run between blank lines), each sentence of these, and the whole;
messages' own text is hashed alike. So a quote is found also where it was wrapped anew, or is some of the paragraphs
or sentences of a message; a part of a sentence that is not a line is not found. A hash of a passage is linked to the
latest earlier message of its conversation that has it, and a passage to the message that its hashes name with most
characters together (the later one among equals). A message replies to what its first-level passages name; without one, to
the message before it.

A message that replies to another one than the message before it begins a branch. A branch comes right after the
message it answers: its messages' order keys are that message's key, the turn of the branch's first message, and their own
turn, so sorting by conv_id and order_key gives the conversation in reply order.

"The latest earlier message with this hash" is found in spans of SPAN turns and carried from span to span by one row
each, so neither a long conversation nor a common line ends in one task. Paths of branches come from pointer doubling over
branches only.

Cases: null and empty texts have no content and no quotes; texts of any length are parsed whole; messages with null
conv_id or turn answer nothing and are answered by none (their key is the turn, or empty); repeated rows give
repeated rows; several messages with one turn all count as originals of that turn; a quote that no earlier message has
stays unlinked; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import re
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tallyforge.llm.common import arrow_map, discard, kind_of, materialise, scratch

SPAN = 1024
QUOTE = re.compile(r"^[ \t]*((?:>[ \t]?)+)(.*)$")
WROTE = re.compile(r"^\s*(?:on\b.*\bwrote|le\b.*\ba écrit|am\b.*\bschrieb|el\b.*\bescribió)\s*:\s*$", re.IGNORECASE)
#: Where a sentence of normalised text ends, with the quotation marks and brackets after it.
SENTENCE_END = re.compile(r"([.!?…]+[\"'”’»)\]]*(?= )|[。！？]+[”’」』）]*) ?")


def parse(text: str) -> tuple[str, list[tuple[int, list[str]]]]:
    """A message's own content, and its passages (level, lines)."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    inside = False
    for line in text.split("\n"):
        m = QUOTE.match(line)
        if m is None:
            own.append(line)
            inside = False
            continue
        level = m[1].count(">")
        if not inside and own and WROTE.match(own[-1]):
            own.pop()
        if inside and passages[-1][0] == level:
            passages[-1][1].append(m[2])
        else:
            passages.append((level, [m[2]]))
        inside = True
    return "\n".join(own).strip(), passages


def unit_hashes(lines: list[str]) -> dict[int, int]:
    """Hashes of the normalised lines, paragraphs, their sentences and all together, with their lengths; none of what is empty."""
    clean = [" ".join(x.lower().split()) for x in lines]
    units = {" ".join(c) for full, c in groupby(clean, bool) if full} | {c for c in clean if c}
    units |= {u for x in units for u in SENTENCE_END.sub(r"\1\n", x).split("\n") if u}
    if any(clean):
        units.add(" ".join(filter(None, clean)))
    return {xxhash.xxh64_intdigest(u) - (1 << 63): len(u) for u in sorted(units)}


def _parsed(messages: DataFrame) -> DataFrame:
    """Each message with its content, hashes of it, and hashes of its passages."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        content, own, quotes = [], [], []
        for text in batch.column(3).to_pylist():
            body, passages = parse(text)
            content.append(body)
            own.append(sorted(unit_hashes(body.split("\n"))))
            quotes.append([{"passage": i, "level": level, "h": h, "chars": n} for i, (level, lines) in enumerate(passages) for h, n in sorted(unit_hashes(lines).items())] if passages else [])
        counts = [len({q["passage"] for q in x}) for x in quotes]
        kinds = pa.list_(pa.struct([("passage", pa.int32()), ("level", pa.int32()), ("h", pa.int64()), ("chars", pa.int64())]))
        return pa.record_batch([*batch.columns[:3], batch.column(4), pa.array(content), pa.array(own, pa.list_(pa.int64())), pa.array(quotes, kinds), pa.array(counts, pa.int32())], ["conv_id", "turn", "role", "message", "content", "own", "quotes", "n_quotes"])

    shaped = messages.select(
        _key(messages), F.col("turn").try_cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("conv_id", "turn", "role", "text").alias("message")
    )
    return shaped.mapInArrow(arrow_map(work), f"conv_id {kind_of(shaped, 'conv_id')}, turn long, role string, message long, content string, own array<long>, quotes array<struct<passage:int,level:int,h:long,chars:long>>, n_quotes int")


def _key(messages: DataFrame) -> Column:
    """conv_id as a long where it is a whole number, else as it is: texts name conversations, too."""
    return (F.col("conv_id").cast("long") if kind_of(messages, "conv_id") in ("tinyint", "smallint", "int", "bigint") else F.col("conv_id")).alias("conv_id")


def latest_before(asked: DataFrame, there: DataFrame) -> DataFrame:
    """conv_id, h, turn, before: of each asked (conv_id, h, turn), the greatest turn below it in there (same columns)."""
    span = F.floor(F.col("turn") / SPAN).alias("span")
    ask = asked.select("conv_id", "h", "turn", span).distinct()
    have = there.select("conv_id", "h", "turn", span).distinct()
    both = ask.select("*", F.lit(None).cast("long").alias("has"), F.lit(True).alias("ask")).unionAll(have.select("*", F.col("turn").alias("has"), F.lit(False).alias("ask")))
    near = W.Window.partitionBy("conv_id", "h", "span").orderBy("turn").rangeBetween(W.Window.unboundedPreceding, -1)
    within = both.withColumn("near", F.max("has").over(near)).filter("ask").select("conv_id", "h", "turn", "span", "near")
    spans = have.groupBy("conv_id", "h", "span").agg(F.max("turn").alias("top")).unionAll(ask.select("conv_id", "h", "span", F.lit(None).cast("long")).distinct()).groupBy("conv_id", "h", "span").agg(F.max("top").alias("top"))
    earlier = W.Window.partitionBy("conv_id", "h").orderBy("span").rowsBetween(W.Window.unboundedPreceding, -1)
    carried = spans.withColumn("far", F.max("top").over(earlier)).select("conv_id", "h", "span", "far")
    return within.join(carried, ["conv_id", "h", "span"]).select("conv_id", "h", "turn", F.coalesce("near", "far").alias("before"))


def _links(parsed: DataFrame) -> DataFrame:
    """conv_id, message, passage, level, original: the message turn that each passage names (null if none)."""
    quoted = parsed.filter("conv_id IS NOT NULL AND turn IS NOT NULL AND n_quotes > 0").select("conv_id", "turn", "message", F.explode("quotes").alias("q")).select("conv_id", "turn", "message", "q.*").distinct()
    own = parsed.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.explode("own").alias("h"))
    found = quoted.join(latest_before(quoted, own), ["conv_id", "h", "turn"])
    votes = found.groupBy("conv_id", "message", "passage", "level", F.col("before").alias("original")).agg(F.sum("chars").alias("n"))
    best = F.max(F.when(F.col("original").isNotNull(), F.struct("n", "original")))
    return votes.groupBy("conv_id", "message", "passage", "level").agg(best.alias("b")).select("conv_id", "message", "passage", "level", F.col("b.n").alias("n"), F.col("b.original").alias("original"))


def _paths(heads: DataFrame) -> DataFrame:
    """conv_id, head, path: for each branch, the turns to sort by before its messages' own.

    heads: conv_id, head (first turn), reply_to, up (the branch of that turn; null: the trunk).
    """
    rows = materialise(heads.select("conv_id", "head", "up", F.array("reply_to", "head").alias("path")), "branches")
    while not rows.filter("up IS NOT NULL").isEmpty():
        before = rows
        above = rows.select("conv_id", F.col("head").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"))
        rows = materialise(rows.join(above, ["conv_id", "up"], "left").select("conv_id", "head", F.col("up2").alias("up"), F.when(F.col("path2").isNull(), F.col("path")).otherwise(F.concat("path2", "path")).alias("path")), "branches")
        discard(before)
    return rows


def link_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, content (without quotes), reply_to, branch, order_key, n_quotes, n_linked for each message."""
    with scratch(messages.sparkSession) as keep:
        parsed = materialise(_parsed(messages), "messages")
        placed = parsed.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
        links = materialise(_links(parsed), "links")
        by_message = links.groupBy("conv_id", "message").agg(F.count("original").cast("int").alias("n_linked"))
        first = links.filter("level = 1 AND original IS NOT NULL").groupBy("conv_id", "message", "original").agg(F.sum("n").alias("n")).groupBy("conv_id", "message").agg(F.max(F.struct("n", "original")).alias("b")).select("conv_id", "message", F.col("b.original").alias("quoted"))
        turns = placed.select("conv_id", F.lit(0).cast("long").alias("h"), "turn").distinct()
        prior = latest_before(turns, turns).select("conv_id", "turn", F.col("before").alias("prior"))
        replies = placed.select("conv_id", "turn", "message").distinct().join(first, ["conv_id", "message"], "left").join(prior, ["conv_id", "turn"]).select("conv_id", "turn", "message", F.coalesce("quoted", "prior").alias("reply_to"), (F.col("quoted").isNotNull() & (F.col("quoted") != F.col("prior"))).alias("starts"))
        replies = materialise(replies, "replies")
        # of several messages with one turn, the smallest answered turn heads the branch
        heads = replies.filter("starts").groupBy("conv_id", F.col("turn").alias("head")).agg(F.min("reply_to").alias("reply_to"))
        trunk = placed
        if heads.isEmpty():
            keyed = replies.select("conv_id", "turn", "message", "reply_to", F.lit(None).cast("long").alias("branch"), F.array("turn").alias("order_key"))
        else:
            marks = heads.select("conv_id", F.lit(0).cast("long").alias("h"), F.col("head").alias("turn"))
            # a turn's branch is the last head at or before it
            branch = latest_before(turns.withColumn("turn", F.col("turn") + 1), marks).select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("before").alias("branch"))
            up = heads.join(branch.select("conv_id", F.col("turn").alias("reply_to"), F.col("branch").alias("up")), ["conv_id", "reply_to"], "left")
            paths = _paths(up)
            keep(paths)
            keyed = (
                replies.join(branch, ["conv_id", "turn"])
                .join(paths.select("conv_id", F.col("head").alias("branch"), "path"), ["conv_id", "branch"], "left")
                .select("conv_id", "turn", "message", "reply_to", "branch", F.when(F.col("path").isNull(), F.array("turn")).otherwise(F.concat("path", F.array("turn"))).alias("order_key"))
            )
        keep(parsed, links, replies)
    full = trunk.join(keyed.drop("turn"), ["conv_id", "message"]).join(by_message, ["conv_id", "message"], "left")
    alone = parsed.filter("conv_id IS NULL OR turn IS NULL").select("*", F.lit(None).cast("long").alias("reply_to"), F.lit(None).cast("long").alias("branch"), F.when(F.col("turn").isNull(), F.array().cast("array<long>")).otherwise(F.array("turn")).alias("order_key"), F.lit(0).alias("n_linked"))
    names = ["conv_id", "turn", "role", "content", "reply_to", "branch", "order_key", "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked")]
    return full.select(*names).unionAll(alone.select(*names))


def quote_digest(messages: DataFrame) -> DataFrame:
    """link_quotes with a hash and length in the place of the content."""
    return link_quotes(messages).select("conv_id", "turn", "role", "reply_to", "branch", "order_key", "n_quotes", "n_linked", F.length("content").cast("long").alias("content_chars"), F.sha2("content", 256).alias("content_sha256"))


def render(linked: DataFrame, role_open: str = "<|", role_close: str = "|>") -> DataFrame:
    """conv_id, order_key, line: each message as its role's mark and content; sorted by the first two, a transcript."""
    return linked.select("conv_id", "order_key", F.concat(F.lit(role_open), F.coalesce("role", F.lit("user")), F.lit(role_close), F.lit("\n"), F.col("content")).alias("line"))
