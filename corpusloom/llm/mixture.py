"""Problem 7: combine sources so that each has its target share of all tokens.

After the whole copies that every document is certain to get, the fractional rest of each source is drawn by Pareto order
sampling: documents are ranked by the odds of a uniform random number divided by the odds of their inclusion, and the first
ones that fill the source's budget are taken.  The cut in the ranking is found by a radix search over sums of tokens, so no
source, however large, is sorted or gathered in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusloom.session import cut

RANK_BITS, DIGIT_BITS = 48, 12
#: Documents of a bucket that the last step may order in one task.
SMALL_BUCKET = 20_000
MOST_SOURCES = 10_000
WATER_ROUNDS = 50


@dataclass(frozen=True)
class Plan:
    source: str
    target_share: float
    max_repeats: int
    tokens: float
    budget: float
    rate: float


def _targets(mix: DataFrame) -> dict[str, tuple[float, int]]:
    rows = mix.select("source", "target_share", "max_repeats").where("source is not null").distinct().limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES or len({r.source for r in rows}) < len(rows):
        raise ValueError("mix targets must name each source once, and no more than MOST_SOURCES")
    return {r.source: (max(0.0, r.target_share or 0.0), max(0, 1 if r.max_repeats is None else r.max_repeats)) for r in rows}


def _plan(sized: DataFrame, targets: dict[str, tuple[float, int]], total: int | None) -> dict[str, Plan]:
    """Budget and rate (expected copies of a document of weight 1) of every source."""
    sums = {r.source: (float(r.t), float(r.wt)) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.sum(F.col("weight") * F.col("n_tokens")).alias("wt")).collect()}
    live = {s: (share, repeats) for s, (share, repeats) in targets.items() if share * repeats > 0 and sums.get(s, (0, 0))[1] > 0}
    room = {s: sums[s][0] * repeats for s, (_, repeats) in live.items()}
    if total is None:  # the largest mixture in which every source that exists reaches its share
        scale = min((room[s] / share for s, (share, _) in live.items()), default=0.0)
        budget = {s: share * scale for s, (share, _) in live.items()}
    else:  # fill up to the room of each source, what one can't take goes to the others in proportion
        budget, open_, rest = {}, dict(live), float(total)
        while open_:
            shares = sum(share for share, _ in open_.values())
            full = [s for s, (share, _) in open_.items() if rest * share / shares >= room[s]]
            if not full:
                budget |= {s: rest * share / shares for s, (share, _) in open_.items()}
                break
            for s in full:
                budget[s] = room[s]
                rest -= room[s]
                del open_[s]
    rate = {s: b / sums[s][1] for s, b in budget.items()}
    if sized.where("weight <> 1").limit(1).count():
        for _ in range(WATER_ROUNDS):  # documents at their cap give what they can't take to the rest of their source
            table = _frame(sized, [(s, r, live[s][1]) for s, r in rate.items()], "source string, rate double, cap int")
            copies = F.least(F.col("rate") * F.col("weight"), F.col("cap").cast("double"))
            free = F.when(F.col("rate") * F.col("weight") < F.col("cap"), F.col("weight") * F.col("n_tokens"))
            state = sized.join(F.broadcast(table), "source").groupBy("source").agg(F.sum(copies * F.col("n_tokens")).alias("got"), F.sum(free).alias("free")).collect()
            step = {r.source: (budget[r.source] - r.got) / r.free for r in state if r.free and budget[r.source] - r.got > 0.5}
            if not step:
                break
            rate |= {s: rate[s] + x for s, x in step.items()}
    return {s: Plan(s, *live[s], sums[s][0], budget[s], rate[s]) for s in live}


def _frame(like: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, schema)


def mix_to_targets(docs: DataFrame, mix: DataFrame, key: str = "doc_id", total: int | None = None, seed: int = 7) -> DataFrame:
    """(key, source, n_tokens, copies) of every document that is used, copies between 1 and the source's max_repeats.

    docs: key, source, n_tokens and optionally weight (relative inclusion, 1 where absent or null).  Documents without
    tokens, source or target, and those with a null key, are not used; equal keys are repeated rows and count once; total
    is the size of the mixture in tokens, by default the largest at which no share is limited by max_repeats.
    """
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in docs.columns else F.lit(1.0)
    targets = _targets(mix)
    names = _frame(docs, [(s,) for s in targets], "source string")
    sized = docs.select(F.col(key).alias("key"), "source", F.col("n_tokens").cast("long").alias("n_tokens"), weight.alias("weight")).where("key is not null and source is not null and n_tokens > 0 and weight > 0")
    sized = cut(sized.join(F.broadcast(names), "source", "left_semi").dropDuplicates(["key"]))
    plans = _plan(sized, targets, total)
    rates = _frame(docs, [(p.source, p.rate, p.max_repeats) for p in plans.values()], "source string, rate double, cap int")
    expected = F.least(F.col("rate") * F.col("weight"), F.col("cap").cast("double"))
    drawn = sized.join(F.broadcast(rates), "source").withColumn("expected", F.round(expected, 12)).withColumn("whole", F.floor("expected"))
    uniform = (F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    odds = uniform / (1 - uniform) / (F.col("share") / (1 - F.col("share")))
    drawn = drawn.withColumn("share", F.col("expected") - F.col("whole"))
    rank = F.when(F.col("share") > 0, F.least(F.floor(odds / (1 + odds) * float(1 << RANK_BITS)), F.lit((1 << RANK_BITS) - 1)))
    drawn = cut(drawn.select("key", "source", "n_tokens", "whole", rank.cast("long").alias("rank")))
    certain = {r.source: float(r.t) for r in drawn.groupBy("source").agg(F.sum(F.col("whole") * F.col("n_tokens")).alias("t")).collect()}
    rest = {s: p.budget - certain.get(s, 0.0) for s, p in plans.items()}
    last = _last_taken(drawn, rest)
    if last is None:
        out = drawn.withColumn("one_more", F.lit(0))
    else:  # one row per source says where its ranking is cut
        upto = (F.col("rank") < F.col("low")) | (F.struct("rank", "key") <= F.col("last"))
        out = drawn.join(F.broadcast(last), "source", "left").withColumn("one_more", F.when(F.coalesce(upto, F.lit(False)), 1).otherwise(0))
    copies = F.col("whole") + F.col("one_more")
    return out.select(F.col("key").alias(key), "source", "n_tokens", copies.cast("int").alias("copies")).where("copies > 0")


def _last_taken(drawn: DataFrame, rest: dict[str, float]) -> DataFrame | None:
    """(source, low, last): of each source the first documents by rank whose tokens come nearest to its rest are those with
    a rank below low and those up to last (rank, key), which is null where none follows."""
    ranked = drawn.where("rank is not null")
    at = {s: (0, 0, r) for s, r in rest.items() if r > 0}  # source -> first rank of the open bucket, digits fixed, tokens left
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("low", T.LongType()), T.StructField("high", T.LongType()), T.StructField("rest", T.DoubleType())])
    if not at:
        return None
    for digits in range(1, RANK_BITS // DIGIT_BITS + 1):
        shift = RANK_BITS - digits * DIGIT_BITS
        bounds = drawn.sparkSession.createDataFrame([(s, low, low + (1 << (RANK_BITS - fixed * DIGIT_BITS)), left) for s, (low, fixed, left) in at.items()], schema)
        inside = ranked.join(F.broadcast(bounds), "source").where("rank >= low and rank < high")
        sums = inside.groupBy("source", F.shiftright("rank", shift).alias("bucket")).agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()
        largest = 0
        for s, (_, _, left) in list(at.items()):
            for bucket, t, n in sorted((r.bucket, r.t, r.n) for r in sums if r.source == s):
                if t >= left:
                    at[s] = (bucket << shift, digits, left)
                    largest = max(largest, n)
                    break
                left -= t
            else:
                at[s] = (1 << RANK_BITS, digits, 0.0)  # all of them fit
        if largest <= SMALL_BUCKET:
            break
    bounds = drawn.sparkSession.createDataFrame([(s, low, low + (1 << (RANK_BITS - fixed * DIGIT_BITS)), left) for s, (low, fixed, left) in at.items()], schema)
    joined = ranked.join(F.broadcast(bounds), "source")
    order = Window.partitionBy("source").orderBy("rank", "key")
    edge = joined.where("rank >= low and rank < high").withColumn("upto", F.sum("n_tokens").over(order)).where(F.col("upto") - F.col("n_tokens") / 2 <= F.col("rest"))
    return bounds.select("source", "low").join(edge.groupBy("source").agg(F.max(F.struct("rank", "key")).alias("last")), "source", "left")


def mixture_shares(used: DataFrame, mix: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, documents, tokens): every target source, those without documents with 0."""
    per = used.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
    rows = mix.select("source", "target_share").where("source is not null").distinct().join(per, "source", "left")
    total = F.sum("tokens").over(Window.partitionBy())  # one row per target source
    share = F.coalesce(F.col("tokens") / total, F.lit(0.0))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "tokens")]
    return rows.select("source", "target_share", F.round(share, 6).alias("actual_share"), *zero)
