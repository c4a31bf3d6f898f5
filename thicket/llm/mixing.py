"""Temperature mixing of sources.

Weights are token shares raised to an exponent between 0 (all sources alike)
and 1 (as they come).  The exponent is bisected until the weights reach a target
entropy, or until no source is repeated more than a limit.  The weights are then
realised as budgeted block permutations: a source's budget is so many whole
passes over all its documents and one part of a pass.  Each pass deals the
documents into blocks by a seeded hash; blocks follow each other in number, and
the part pass ends inside one block, at the document that would exceed the
budget.  ``mix_order`` (0 to about 1) interleaves the sources in proportion.

Tokens are words (``[^\\x20\\x09-\\x0D]+``), at least one per document, over
whole texts; shares are taken over all rows.  The table of sources is written;
Spark broadcasts it only below its own threshold.  Bisection goes several steps
at a time: one aggregation over the sources gives the sums of powers, as exact
decimals, at every exponent that these steps may ask for, so the result depends
neither on the number of sources nor on their order.  Nothing is gathered: a
document finds its pass, block and place from its own hash, and only the blocks
in which part passes end are sorted, each about the square root of its source.

Without an explicit budget the budget is the least one that passes over every
source once, so no document is lost.  Defined results: a null source is a source
of its own; null or empty texts count one token; repeated rows are dealt each
(equal rows take equal places); an empty table gives an empty result; other
columns pass through ``mix`` unchanged, whatever their names: a new column whose
name is taken gets ``mix_`` before it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Workspace

WORDS = r"[^\x20\x09-\x0D]+"
SEED = 20240229
MAX_REPEATS = 2.0
#: New columns of ``mix``.
OWN = ("n_tokens", "epoch", "block", "mix_order")
#: Steps of bisection that one aggregation serves.
AHEAD = 4
#: Sums of powers are exact sums of numbers with so many places.
EXACT = "decimal(38,18)"


def bisect_exponent(sums, entropy: float | None, repeats: float | None) -> float:
    """The exponent.  ``sums(t)`` gives (sum of p**t, sum of p**t * ln p, least p, greatest p)."""

    def excess(t):
        total, weighted, least, most = sums(t)
        if entropy is not None:  # falls as t grows
            return math.log(total) - t * weighted / total - entropy
        return (1 - t) * math.log(most / least) - math.log(repeats)

    low, high = 0.0, 1.0
    if excess(low) <= 0:
        return low
    if excess(high) >= 0:
        return high
    for _ in range(52):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) > 0 else (low, mid)
    return high


class _Sums:
    """Sums of powers of the shares, taken by Spark at an exponent and at those that bisection may ask for next."""

    def __init__(self, shares: DataFrame):
        self.shares, self.known = shares, {}

    def __call__(self, t: float):
        if t not in self.known:
            ts, step = [t], 0.5 / t.as_integer_ratio()[1]  # bisection of [0, 1] meets multiples of powers of two
            for _ in range(AHEAD - 1 if 0 < t < 1 else 0):
                ts += [x + s for x in ts[-(len(ts) + 1) // 2 :] for s in (-step, step)]
                step /= 2
            powers = [F.pow("p", F.lit(x)) for x in ts]
            row = self.shares.agg(*[F.sum(x.cast(EXACT)).cast("double") for w in powers for x in (w, w * F.ln("p"))], F.min("p"), F.max("p")).first()
            self.known |= {x: (row[2 * i], row[2 * i + 1], row[-2], row[-1]) for i, x in enumerate(ts)}
        return self.known[t]


def _sized(docs: DataFrame) -> DataFrame:
    """docs with columns named by their places, and those that the plan needs."""
    at = {n: f"c{docs.columns.index(n)}" for n in ("doc_id", "text", "source")}
    key = F.coalesce(F.concat(F.lit("="), F.col(at["source"]).cast("string")), F.lit("null"))
    words = F.regexp_count(F.col(at["text"]).cast("string"), F.lit(WORDS))
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.withColumns({"__source": key, "__tokens": F.greatest(F.lit(1), F.coalesce(words, F.lit(0))).cast("long"), "__key": F.xxhash64(F.lit(SEED), at["doc_id"], at["text"])})


def _place(epoch, blocks="blocks"):
    """Block and place inside it, from the row's hash and the pass."""
    h = F.xxhash64("__key", epoch)
    return F.pmod(h, blocks), F.pmod(F.xxhash64(h, F.lit(1)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def plan(docs: DataFrame, ws: Workspace, entropy: float | None = None, repeats: float | None = MAX_REPEATS, budget: int | None = None) -> DataFrame:
    """One row per source: tokens, docs, weight, budget, passes, blocks, cut_block, rest (tokens left inside it)."""
    sized = _sized(docs).select("__source", "__tokens", "__key")
    totals = ws.save(sized.groupBy("__source").agg(F.sum("__tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "totals")
    n, all_tokens = totals.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    if not n:
        return ws.save(totals.selectExpr("__source", "tokens", "docs", "0D weight", "0D budget", "0L passes", "1L blocks", "-1L cut_block", "0D rest"), "plan")
    shares = totals.select("*", (F.col("tokens") / F.lit(float(all_tokens))).alias("p"))
    sums = _Sums(shares)
    ends = sums(1.0)  # a limit on repeats needs the least and the greatest share only
    t = bisect_exponent(sums if entropy is not None else lambda t: ends, entropy, repeats)
    total, _, _, most = sums(t)
    if budget is None:  # the source with the fewest passes, the greatest, is passed once
        budget = all_tokens * most * total / most**t
    weighted = shares.select("__source", "tokens", "docs", (F.pow("p", F.lit(t)) / F.lit(float(total))).alias("weight"))
    whole = weighted.select("*", (F.col("weight") * F.lit(float(budget))).alias("budget"))
    # A budget within a millionth of whole passes is whole passes: sums of doubles are not exact.
    passes = F.floor(F.col("budget") / F.col("tokens") + F.lit(1e-6))
    rest = F.greatest(F.lit(0.0), F.col("budget") - F.col("passes") * F.col("tokens"))
    basic = ws.save(whole.select("*", passes.alias("passes"), F.ceil(F.sqrt("docs")).alias("blocks")).select("*", rest.alias("rest")), "basic")
    block, _ = _place(F.col("passes"))
    per_block = sized.join(basic.where("rest > 0").select("__source", "passes", "blocks"), "__source").select("__source", "__tokens", block.alias("block")).groupBy("__source", "block").agg(F.sum("__tokens").alias("t"))
    upto = Window.partitionBy("__source").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    cut = per_block.select("__source", "block", "t", F.sum("t").over(upto).alias("upto")).join(basic.select("__source", "rest"), "__source").where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("t") <= F.col("rest")))
    cut = cut.select("__source", F.col("block").alias("cut_block"), (F.col("rest") - F.col("upto") + F.col("t")).alias("inside"))
    joined = basic.join(cut, "__source", "left")
    return ws.save(joined.select("__source", "tokens", "docs", "weight", "budget", "passes", "blocks", F.coalesce("cut_block", F.lit(-1)).alias("cut_block"), F.coalesce("inside", F.lit(0.0)).alias("rest")), "plan")


def free_names(taken: list[str]) -> list[str]:
    """The names of the new columns beside those of the table."""
    out, used = [], {c.lower() for c in taken}
    for name in OWN:
        while name in used:
            name = f"mix_{name}"
        out.append(name)
        used.add(name)
    return out


def mix(docs: DataFrame, entropy: float | None = None, repeats: float | None = MAX_REPEATS, budget: int | None = None) -> DataFrame:
    """docs, each row once per pass that takes it, with four columns after its own: n_tokens, epoch, block and mix_order."""
    ws = Workspace(docs.sparkSession, "mixing")
    sources = plan(docs, ws, entropy, repeats, budget)
    cols = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    tokens, epoch, number, place_in_all = free_names(docs.columns)
    of = {"tokens": "__all", "budget": "__budget", "passes": "__passes", "blocks": "__blocks", "cut_block": "__cut", "rest": "__rest"}
    rows = _sized(docs).join(sources.select("__source", *[F.col(k).alias(v) for k, v in of.items()]), "__source")
    last = F.when(F.col("__cut") >= 0, F.col("__passes")).otherwise(F.col("__passes") - 1)
    rows = rows.where(last >= 0).withColumn("__epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    block, place = _place(F.col("__epoch"), "__blocks")
    rows = rows.withColumns({"__block": block, "__place": place})
    order = (F.col("__epoch") + (F.col("__block") + F.col("__place")) / F.col("__blocks")) * F.col("__all") / F.col("__budget")
    shape = lambda t: t.select(*cols, F.col("__tokens").alias(tokens), F.col("__epoch").alias(epoch), F.col("__block").alias(number), F.round(order, 9).alias(place_in_all))
    whole = rows.where((F.col("__epoch") < F.col("__passes")) | (F.col("__block") < F.col("__cut")))
    upto = Window.partitionBy("__source").orderBy("__place", "__key").rowsBetween(Window.unboundedPreceding, 0)
    edge = rows.where((F.col("__epoch") == F.col("__passes")) & (F.col("__block") == F.col("__cut")))
    edge = edge.withColumn("__upto", F.sum("__tokens").over(upto)).where(F.col("__upto") <= F.col("__rest"))
    return shape(whole).union(shape(edge))
