"""Chat formatting by quotation linking.

1. Parse: a line that begins with ``>`` marks is quoted, one level per mark
   (blanks between marks allowed); no other quote mark is known.  Consecutive quoted lines of one level are a
   passage.  A line that ends in ``wrote:`` right before a quote is an
   attribution and goes with it.
2. Hash: lines and passages are normalised (lower case, white space runs to one
   blank, trimmed) and hashed by SHA-256.  A message's *own* keys are those of
   its unquoted lines and paragraphs.
3. Join: a quoted key belongs to the earliest turn of the same conversation
   that has it as its own, if that turn is before the quoting one.  The message
   replies to the original of its shallowest linked quotes; more linked lines
   decide, then the later turn.
4. Threads: the root of each message is found by doubling the reply pointers;
   ordering by (conv_id, thread, turn) puts every reply after its original.
   Quotes are cut from the texts.

Originals are reduced to one turn per (conversation, key) before the join, and
the quoting side may be split by adaptive execution, so a hot conversation or a
much repeated first turn makes neither pairs nor one large group.

Defined results: null text stays null and has no keys; blank lines have no key;
messages with a null conv_id or turn link to nothing and are threads of their
own; repeated (conv_id, turn) rows share keys and reply; quotes of nothing
known are cut all the same; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace, lean

_QUOTE = re.compile(r"^[ \t]{0,3}((?:>[ \t]?)+)(.*)$", re.S)
_ATTRIBUTION = re.compile(r"wrote:[ \t]*$")


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def key_of(text: str) -> bytes | None:
    plain = normalise(text)
    return hashlib.sha256(plain.encode()).digest()[:16] if plain else None


def parse(text: str | None):
    """(text without quotes, own keys, [(key, level, lines)] of quoted lines and passages, quoted lines)."""
    if text is None:
        return None, [], [], 0
    lines = []
    for line in text.split("\n"):
        m = _QUOTE.match(line)
        lines.append((m[1].count(">"), m[2]) if m else (0, line))
    for i in range(len(lines) - 1):
        if lines[i][0] == 0 and lines[i + 1][0] > 0 and _ATTRIBUTION.search(lines[i][1]):
            lines[i] = (-1, "")
    own, quotes, block, quoted = {}, {}, [], sum(level > 0 for level, _ in lines)

    def close():
        """Ends a run of lines of one level: its lines and the whole of it get keys."""
        if not block:
            return
        level = block[0][0]
        keyed = [(key_of(x), 1) for _, x in block] + ([(key_of("\n".join(x for _, x in block)), len(block))] if len(block) > 1 else [])
        for key, n in keyed:
            if key is None:
                continue
            if level == 0:
                own[key] = True
            elif level > 0:
                quotes[key, level] = max(n, quotes.get((key, level), 0))
        block.clear()

    for level, line in lines:
        if block and (block[0][0] != level or not line.strip()):
            close()
        if line.strip():
            block.append((level, line))
    close()
    kept = [x for level, x in lines if level == 0]
    clean = text if quoted == 0 else re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip("\n")
    return clean, list(own), [(k, level, n) for (k, level), n in quotes.items()], quoted


PARSED = "conv_id long, turn long, role string, text string, own array<binary>, quotes array<struct<key:binary,level:int,lines:int>>, n_quoted long"


def _parse(batches):
    kind = pa.list_(pa.struct([("key", pa.binary()), ("level", pa.int32()), ("lines", pa.int32())]))
    for b in batches:
        got = [parse(t) for t in b.column(3).to_pylist()]
        quotes = [[{"key": k, "level": level, "lines": n} for k, level, n in q] for _, _, q, _ in got]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(pa.binary())), pa.array(quotes, kind), pa.array([g[3] for g in got], pa.int64())], names=["conv_id", "turn", "role", "text", "own", "quotes", "n_quoted"])


def _threads(replies: DataFrame, ws: Workspace) -> DataFrame:
    """(conv_id, turn, reply_to) -> with ``thread`` and ``depth`` by pointer doubling."""
    now, k = ws.save(replies.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")), "jump0"), 0
    while True:
        up = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("higher"), F.col("depth").alias("more"))
        k += 1
        nxt = ws.save(now.join(up, ["conv_id", "thread"], "left").select("conv_id", "turn", F.coalesce("higher", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("higher").isNotNull().alias("moved")), f"jump{k}")
        ws.drop(f"jump{k - 1}")
        if nxt.where("moved").isEmpty():
            return nxt.drop("moved")
        now = nxt.drop("moved")


def link_quotes(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, thread, turn, role, reply_to, depth, n_quoted, n_linked, text; in reply order."""
    ws = Workspace(messages.sparkSession, "quotes")
    plain = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    parsed = ws.save(plain.mapInArrow(lean(_parse), PARSED), "parsed")
    quotes = parsed.where("size(quotes) > 0 and conv_id is not null and turn is not null").select("conv_id", "turn", F.inline("quotes")).distinct()
    own = parsed.where("turn is not null").select("conv_id", "turn", F.explode("own").alias("key")).groupBy("conv_id", "key").agg(F.min("turn").alias("origin"))
    linked = quotes.join(own, ["conv_id", "key"]).where("origin < turn")
    per = linked.groupBy("conv_id", "turn", "origin").agg(F.min("level").alias("level"), F.sum("lines").alias("lines"))
    best = per.groupBy("conv_id", "turn").agg(F.max_by("origin", F.struct(-F.col("level"), F.col("lines"), F.col("origin"))).alias("reply_to"), F.sum("lines").alias("n_linked"))
    best = ws.save(best, "replies")
    threads = _threads(best, ws)
    joined = parsed.drop("own", "quotes").join(best, ["conv_id", "turn"], "left").join(threads, ["conv_id", "turn"], "left")
    out = joined.select("conv_id", F.coalesce("thread", "turn").alias("thread"), "turn", "role", "reply_to", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "text")
    return out.orderBy("conv_id", "thread", "turn")
