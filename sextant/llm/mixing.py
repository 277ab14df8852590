"""Records of several sources mixed to target shares of the total size (problem 8).

Each source's records are laid end to end (in the order of a hash, once per allowed repeat) and cut into blocks of equal size.
Pfair scheduling sets the blocks in order: the k-th block of a source with weight w is released at k / w and due at (k + 1) / w,
and of the released blocks the one with the earliest deadline is next, so that no source is ever a block or more behind its
share.  There are about ``BLOCKS`` blocks, more only where each would hold over ``PER_BLOCK`` records, and a block is as long as ``TYPICAL`` records of mean length at
least; the schedule is that small, records find their block by a join.  Every source gets all the blocks that its quota begins, one at
least.  A record longer than a block stands in the block of its middle, so the longest record changes no other's place by more than its own
length and takes no source away.  Records longer than their source's whole quota come after all others of it.  Where a source's quota ends, a record
that would miss it by more than a block is passed over for the next ones that fit, among ``TAIL`` of them.

Without a stated total, it is the largest at which every source that has text meets its share within its allowed repeats; the scarcest
source then limits all, and :func:`shares` names it and what the others leave unused.  With a stated total, sources that are exhausted
fall short and the others share the remainder by their weights.

Defined results: sources are compared in lower case without outer white space; records without source, text or id, or of a source
without target, are left out; targets without any text get nothing and the others keep their proportions;
negative or null targets count as 0, null repeats as 1. Repeated rows are records of their own.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.text import strip_ws
from sextant.session import materialise

#: Blocks of the whole mixture, and ranges of the hash by which each source is laid end to end; both grow with the number of records up to ``MOST``.
BLOCKS, RANGES, MOST = 4_096, 1_024, 262_144
#: Records of one block or range that are put in order by one task.
PER_BLOCK = 100_000
#: Records behind the end of a source's quota that may fill it.
TAIL = 1_000
#: Records of mean length in the shortest block.
TYPICAL = 4


def source_name(source: Column) -> Column:
    """One spelling of a source's name."""
    return F.regexp_replace(F.lower(strip_ws(source)), r"[\s\-]+", "_")


def schedule(weights: dict[str, float], blocks: int = BLOCKS) -> list[tuple[str, int, int]]:
    """(source, its block, slot): earliest deadline first among released blocks, until every source has all that its share of ``blocks`` begins."""
    total = sum(weights.values())
    share = {s: w / total for s, w in weights.items() if w > 0}
    need = {s: max(1, math.ceil(x * blocks - 1e-9)) for s, x in share.items()}
    waiting = [(0.0, s, 0) for s in sorted(share)]  # by release
    ready: list[tuple[float, str, int]] = []  # by deadline
    heapq.heapify(waiting)
    out = []
    for slot in range(sum(need.values())):
        while waiting and waiting[0][0] <= slot + 1e-9:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, ((k + 1) / share[s], s, k))
        if not ready:
            _, s, k = heapq.heappop(waiting)
        else:
            _, s, k = heapq.heappop(ready)
        out.append((s, k, slot))
        if k + 1 < need[s]:
            heapq.heappush(waiting, ((k + 1) / share[s], s, k + 1))
    return out


def _parts(least: int, n_records: int) -> int:
    return min(MOST, max(least, -(-n_records // PER_BLOCK)))


def _laid(records: DataFrame, ranges: int = RANGES) -> DataFrame:
    """``records`` (doc_id, source, n_tokens, quota) with ``at``: tokens of the source before each, in the order of a hash.

    Records longer than the quota come last.  Sums by ranges of the hash come first, so that no source is laid out in one task.
    """
    h = F.xxhash64("doc_id")
    late = F.when(F.col("n_tokens") > F.col("quota"), ranges).otherwise(0)
    keyed = records.withColumns({"h": h, "range": (F.pmod(F.shiftrightunsigned(h, 40), F.lit(ranges)) + late).cast("int")})
    sums = keyed.groupBy("source", "range").agg(F.sum("n_tokens").alias("t"))
    w = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("source", "range", F.coalesce(F.sum("t").over(w), F.lit(0)).alias("before"))  # at most 2 x sources x ranges rows
    inside = Window.partitionBy("source", "range").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return keyed.join(F.broadcast(before), ["source", "range"]).select("doc_id", "source", "n_tokens", (F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("at"))


def quotas(have: dict[str, tuple[float, float]], total: float | None = None) -> dict[str, float]:
    """Tokens for each source of ``have`` (weight, tokens with all repeats).

    Without ``total`` the largest with all shares met; else sources fill up by their weights until ``total`` or all text is reached.
    """
    if total is None:
        level = min(float(most) / w for w, most in have.values())
        return {s: w * level for s, (w, _) in have.items()}
    out, rest, weight = {}, float(total), sum(w for w, _ in have.values())
    for s, (w, most) in sorted(have.items(), key=lambda x: x[1][1] / x[1][0]):  # exhausted first
        out[s] = min(float(most), max(0.0, rest) * w / weight)
        rest, weight = rest - out[s], weight - w
    return {s: q for s, q in out.items() if q > 0}


def fill(room: float, tail: list[tuple[int, int]], size: float) -> list[tuple[int, float]]:
    """(at, tokens before it) of the records of ``tail`` (at, tokens), in order, that fill ``room`` up to less than a block of ``size`` too much."""
    out, used = [], 0.0
    for at, n in tail:
        over = used + n - room
        if over <= 0 or (over < room - used and over <= size):
            out.append((at, used))
            used += n
            if over >= 0:
                break
    if not out and tail:  # a source of long records only gets one, unless nothing is nearer to its quota
        at, n = min(tail, key=lambda x: x[1])
        out = [(at, 0.0)] if n / 2 < room else []
    return out


def _goal(targets: DataFrame) -> DataFrame:
    """(source, w, reps): one row for each target."""
    return targets.filter("source is not null").select(
        source_name(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("w"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)).alias("reps")
    ).groupBy("source").agg(F.sum("w").alias("w"), F.max("reps").alias("reps"))


def _own(records: DataFrame) -> DataFrame:
    """The records that can be mixed."""
    return records.filter("doc_id is not null and source is not null and n_tokens > 0").select("doc_id", source_name(F.col("source")).alias("source"), F.col("n_tokens").cast("long").alias("n_tokens"))


def mix(records: DataFrame, targets: DataFrame, blocks: int = BLOCKS, total: float | None = None) -> DataFrame:
    """(position, slot, source, doc_id, repeat, n_tokens): the mixture in order.

    ``records``: (doc_id, source, n_tokens); ``targets``: (source, target_share, max_repeats); ``total``: tokens wanted.
    """
    spark = records.sparkSession
    goal = _goal(targets)
    own = materialise(_own(records).join(F.broadcast(goal.select("source")), "source", "left_semi"), "mixing-records")
    have = own.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).join(goal.filter("w > 0"), "source").collect()  # one row per target
    schema = "position long, slot int, source string, doc_id long, repeat int, n_tokens long"
    if not have:
        return spark.createDataFrame([], schema)
    given = quotas({r["source"]: (r["w"], r["tokens"] * r["reps"]) for r in have}, total)
    have = [r for r in have if r["source"] in given]
    if not have:
        return spark.createDataFrame([], schema)
    total = sum(given.values())
    n_records = sum(r["n"] for r in have)
    mean = sum(r["tokens"] for r in have) / n_records
    blocks = max(1, min(_parts(blocks, n_records) if blocks == BLOCKS else blocks, int(total // (TYPICAL * mean))))
    size = total / blocks
    order = schedule(given, blocks)
    last = {s: k for s, k, _ in order}
    slots = spark.createDataFrame(order, "source string, block int, slot int")
    # the pass over a source in which its quota ends, and where in it
    passes = {r["source"]: max(0, math.ceil(given[r["source"]] / r["tokens"] - 1e-12) - 1) for r in have}
    edge = {r["source"]: given[r["source"]] - passes[r["source"]] * r["tokens"] for r in have}
    rows = [(s, int(r["tokens"]), given[s], last[s], passes[s], edge[s]) for r in have for s in [r["source"]]]
    quota = spark.createDataFrame(rows, "source string, tokens long, quota double, last int, passes int, edge double")
    laid = materialise(_laid(own.join(F.broadcast(quota.select("source", "quota")), "source"), _parts(RANGES, n_records)), "mixing-laid")
    whole = F.col("at") + F.col("n_tokens") <= F.col("edge") + 1e-6
    known = laid.join(F.broadcast(quota), "source")
    following = Window.partitionBy("source").orderBy("at")
    tail = known.filter(~whole).withColumn("k", F.row_number().over(following)).filter(F.col("k") <= TAIL).select("source", "at", "n_tokens").collect()  # TAIL rows a source
    picked = []
    for s in given:
        mine = sorted((r["at"], r["n_tokens"]) for r in tail if r["source"] == s)
        if mine:
            before = mine[0][0]
            picked += [(s, at, float(before + used)) for at, used in fill(edge[s] - before, mine, size)]
    picks = spark.createDataFrame(picked, "source string, at long, place double")
    full = known.withColumn("repeat", F.explode(F.sequence(F.lit(0), "passes"))).filter((F.col("repeat") < F.col("passes")) | whole).withColumn("place", F.col("at").cast("double"))
    rest = known.withColumn("repeat", F.col("passes")).join(F.broadcast(picks), ["source", "at"])
    start = F.col("repeat") * F.col("tokens") + F.col("place")
    # a record belongs to the block in which its middle lies
    mid = start + F.col("n_tokens") / 2
    columns = ["source", "doc_id", "n_tokens", "repeat", start.alias("start"), F.least(F.floor(mid / F.lit(size)).cast("int"), "last").alias("block")]
    taken = full.select(*columns).unionByName(rest.select(*columns))
    # no record that was taken may be without a slot
    lost = F.raise_error(F.concat(F.lit("no slot for a block of "), F.col("source"))).cast("int")
    placed = taken.join(F.broadcast(slots), ["source", "block"], "left").withColumn("slot", F.coalesce("slot", lost))
    # positions: sums of slots first, then inside each slot
    counts = placed.groupBy("slot").agg(F.count("*").alias("n"))
    w = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("slot", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))  # at most ``blocks`` rows
    inside = Window.partitionBy("slot").orderBy("start", "doc_id", "repeat")
    out = placed.join(F.broadcast(before), "slot")
    return out.select((F.col("before") + F.row_number().over(inside) - 1).alias("position"), "slot", "source", "doc_id", "repeat", "n_tokens")


def shares(mixture: DataFrame, targets: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """(source, target_share, n_records, n_tokens, share, most_repeats): what each target got.

    With ``records`` also available (tokens with all repeats), unused (of them) and limits (the source with the least text for its target).
    """
    goal = targets.filter("source is not null").select(source_name(F.col("source")).alias("source"), F.col("target_share")).groupBy("source").agg(F.sum("target_share").alias("target_share"))
    per = mixture.groupBy("source").agg(F.count("*").alias("n_records"), F.sum("n_tokens").alias("n_tokens"), (F.max("repeat") + 1).alias("most_repeats"))
    whole = Window.partitionBy(F.lit(1))  # one row per target
    out = goal.join(per, "source", "left").withColumn("all_tokens", F.sum("n_tokens").over(whole))
    columns = [
        "source", "target_share", F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
        F.coalesce(F.round(F.col("n_tokens") / F.col("all_tokens"), 6), F.lit(0.0)).alias("share"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    ]
    if records is not None:
        text = _own(records).groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
        text = text.join(_goal(targets), "source").select("source", (F.col("tokens") * F.col("reps")).alias("most"), F.when(F.col("w") > 0, F.col("tokens") * F.col("reps") / F.col("w")).alias("level"))
        out = out.join(text, "source", "left").withColumn("least", F.min("level").over(whole))
        most = F.coalesce("most", F.lit(0))
        columns += [most.alias("available"), (most - F.coalesce("n_tokens", F.lit(0))).alias("unused"), F.coalesce(F.col("level") == F.col("least"), F.lit(False)).alias("limits")]
    return out.select(*columns)


def on_target(mixture: DataFrame, targets: DataFrame, records: DataFrame) -> DataFrame:
    """(source, has_text, on_target, within_repeats): whether each target was met within one block, and its repeats were kept.

    A source without text is on target with nothing. Only for mixtures without a stated total, in which no source falls short.
    """
    own = _own(records)
    goal = _goal(targets)
    seen = own.join(F.broadcast(goal.select("source")), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("all"), F.count("*").alias("n"))
    got = mixture.groupBy("source").agg(F.sum("n_tokens").alias("t"), (F.max("repeat") + 1).alias("most"))
    whole = Window.partitionBy(F.lit(1))  # one row per target
    out = goal.join(seen, "source", "left").join(got, "source", "left")
    has = F.col("n").isNotNull() & (F.col("w") > 0)
    total, weight = F.sum(F.coalesce("t", F.lit(0))).over(whole), F.sum(F.when(has, F.col("w"))).over(whole)
    block = F.greatest(total / BLOCKS, F.lit(TYPICAL) * F.sum(F.when(has, F.col("all"))).over(whole) / F.sum(F.when(has, F.col("n"))).over(whole))
    met = F.when(has, F.abs(F.coalesce("t", F.lit(0)) - total * F.col("w") / weight) <= block).otherwise(F.col("t").isNull())
    return out.select("source", F.col("n").isNotNull().alias("has_text"), F.coalesce(met, F.lit(False)).alias("on_target"), (F.coalesce("most", F.lit(0)) <= F.col("reps")).alias("within_repeats"))
