"""Texts of varying length packed into containers of fixed capacities (problem 7).

Hierarchical multi-length packing.  Texts are routed to tiers, one per capacity, by their size in tokens.  A plan is made
from the histogram of sizes, which has at most as many entries as the largest capacity whatever the number of
texts: each tier is packed best-fit decreasing, largest first, and gaps of long containers are filled from shorter tiers.
A plan is a list of patterns (sizes side by side in one container) with their numbers; Spark then hands the texts to the places by
rank within their size.  Containers get step groups of balanced cost.

Defined results: null and empty texts have no tokens and go nowhere; a text over the largest capacity is cut
into full containers and a rest, others are never cut; a null id is left out; repeated rows are items of their own.
"""

from __future__ import annotations

import bisect
from collections import Counter, defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.session import materialise

#: Texts of one size that are ranked by one task: a size that more texts share is cut into parts.
PER_PART = 200_000
#: Containers of one step group.
STEP = 16


@dataclass
class Pattern:
    """``count`` containers of ``profile`` that all hold ``sizes``."""

    profile: str
    capacity: int
    sizes: tuple[int, ...]
    count: int

    @property
    def cost(self) -> int:
        """Attention cost: the sum of squared lengths."""
        return sum(s * s for s in self.sizes)


def plan(histogram: dict[int, int], tiers: list[tuple[str, int]]) -> list[Pattern]:
    """Patterns for ``histogram`` (size: number) and ``tiers`` (profile, capacity)."""
    tiers = sorted(tiers, key=lambda t: t[1])
    left = Counter({s: n for s, n in histogram.items() if n > 0})
    done: list[Pattern] = []
    for i in range(len(tiers) - 1, -1, -1):
        profile, capacity = tiers[i]
        floor = tiers[i - 1][1] if i else 0
        own = sorted((s for s in left if floor < s <= capacity and left[s] > 0), reverse=True)
        # open patterns by free space: space -> list of [sizes, count]
        spaces: list[int] = []
        by_space: dict[int, list[list]] = defaultdict(list)

        def put(space: int, sizes: tuple[int, ...], count: int, spaces=spaces, by_space=by_space) -> None:
            if count > 0:
                if not by_space[space]:
                    bisect.insort(spaces, space)
                by_space[space].append([sizes, count])

        def take(size: int, number: int, spaces=spaces, by_space=by_space, put=put) -> int:
            """Puts ``number`` items of ``size`` into the tightest gaps; returns how many found none."""
            while number:
                k = bisect.bisect_left(spaces, size)
                if k == len(spaces):
                    return number
                space = spaces[k]
                sizes, count = by_space[space].pop()
                if not by_space[space]:
                    spaces.pop(k)
                each = space // size
                full = min(count, number // each) if number >= each else 0
                if full:
                    put(space - each * size, (*sizes, *[size] * each), full)
                    number -= full * each
                    put(space, sizes, count - full)
                else:  # fewer items than one container takes
                    put(space - number * size, (*sizes, *[size] * number), 1)
                    put(space, sizes, count - 1)
                    number = 0
            return 0

        for size in own:
            number = take(size, left[size])
            if number:
                each = capacity // size
                if number // each:
                    put(capacity - each * size, (size,) * each, number // each)
                if number % each:
                    put(capacity - (number % each) * size, (size,) * (number % each), 1)
            left[size] = 0
        for j in range(i - 1, -1, -1):  # gaps from the next shorter tiers
            low = tiers[j - 1][1] if j else 0
            for size in sorted((s for s in left if low < s <= tiers[j][1] and left[s] > 0), reverse=True):
                left[size] = take(size, left[size])
        done += [Pattern(profile, capacity, sizes, count) for space in spaces for sizes, count in by_space[space]]
    return done


def _slots(patterns: list[Pattern], step: int) -> tuple[list[tuple], list[tuple]]:
    """(size, first rank, last rank, profile, first container, places in a row, position) of each run of places, and the containers.

    Containers of a profile are numbered by cost, so that step groups can be dealt from the number alone.
    """
    seen: Counter = Counter()
    runs, containers = [], []
    base: Counter = Counter()
    for p in sorted(patterns, key=lambda p: (p.profile, -p.cost, p.sizes)):
        first = base[p.profile]
        base[p.profile] += p.count
        containers.append((p.profile, p.capacity, first, p.count, sum(p.sizes), len(p.sizes)))
        for size, places in Counter(p.sizes).items():
            runs.append((size, seen[size], seen[size] + places * p.count - 1, p.profile, first, places, p.sizes.index(size), sum(s for s in p.sizes[: p.sizes.index(size)])))
            seen[size] += places * p.count
    return runs, containers


def items(sizes: DataFrame, largest: int) -> DataFrame:
    """(doc_id, piece, n_tokens, token_start): one row per text, or per piece of a text over ``largest``."""
    n = F.col("n_tokens")
    pieces = F.ceil(n / F.lit(largest)).cast("int")
    cut = sizes.filter((n > 0) & F.col("doc_id").isNotNull()).select("doc_id", n.cast("int").alias("total"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    start = F.col("piece") * F.lit(largest)
    return cut.select("doc_id", "piece", F.least(F.lit(largest), F.col("total") - start).alias("n_tokens"), start.alias("token_start"))


def pack(sizes: DataFrame, tiers: list[tuple[str, int]], step: int = STEP) -> DataFrame:
    """(profile, capacity, container, position, offset, step_group, doc_id, piece, n_tokens, token_start): where each item goes."""
    spark = sizes.sparkSession
    largest = max(c for _, c in tiers)
    work = materialise(items(sizes, largest), "packing-items")
    counts = {r[0]: r[1] for r in work.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # at most largest rows
    histogram = Counter(counts)
    parts = spark.createDataFrame([(s, -(-n // PER_PART)) for s, n in sorted(counts.items())], "n_tokens int, parts int")
    # all lists that are joined by size have at most as many rows as there are sizes, or parts of sizes
    work = work.join(F.broadcast(parts), "n_tokens").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("parts")).cast("int")).drop("parts")
    offsets: list[tuple[int, int, int]] = [(s, 0, 0) for s, n in counts.items() if n <= PER_PART]
    if len(offsets) < len(counts):
        run = Counter()
        many = parts.filter("parts > 1").select("n_tokens")
        for size, salt, n in sorted(work.join(F.broadcast(many), "n_tokens", "left_semi").groupBy("n_tokens", "salt").agg(F.count("*").alias("n")).collect()):
            offsets.append((size, salt, run[size]))
            run[size] += n
    patterns = plan(histogram, tiers)
    runs, _ = _slots(patterns, step)
    groups = Counter()
    for p in patterns:
        groups[p.profile] += p.count
    capacity = dict(tiers)
    size_schema = "n_tokens int, salt int, before long"
    run_schema = "n_tokens int, first long, last long, profile string, base long, places int, position int, lead int, capacity int, n_containers long"
    before = spark.createDataFrame(offsets, size_schema)
    places = spark.createDataFrame([(s, a, b, p, base, k, pos, lead, capacity[p], groups[p]) for s, a, b, p, base, k, pos, lead in runs], run_schema)
    order = Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece")
    ranked = work.join(F.broadcast(before), ["n_tokens", "salt"]).withColumn("rank", F.col("before") + F.row_number().over(order) - 1)
    # every size has its runs as an array, looked up by rank: one row per size, as many rows as the histogram
    by_size = places.groupBy("n_tokens").agg(F.array_sort(F.collect_list(F.struct("first", "last", "profile", "base", "places", "position", "lead", "capacity", "n_containers"))).alias("runs"))
    hit = F.filter("runs", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") <= r["last"]))[0]
    put = ranked.join(F.broadcast(by_size), "n_tokens").withColumn("r", hit)
    inside = F.col("rank") - F.col("r.first")
    number = F.col("r.base") + F.floor(inside / F.col("r.places"))
    copy = (inside % F.col("r.places")).cast("int")
    n_groups = F.greatest(F.lit(1), F.ceil(F.col("r.n_containers") / F.lit(step)))
    lap, at = F.floor(number / n_groups), number % n_groups
    group = F.when(lap % 2 == 0, at).otherwise(n_groups - 1 - at)  # dealt back and forth in order of cost
    return put.select(
        F.col("r.profile").alias("profile"), F.col("r.capacity").alias("capacity"), number.cast("long").alias("container"), (F.col("r.position") + copy).alias("position"),
        (F.col("r.lead") + copy * F.col("n_tokens")).alias("offset"), group.cast("long").alias("step_group"), "doc_id", "piece", "n_tokens", "token_start",
    )


def pack_each(sizes: DataFrame, tiers: list[tuple[str, int]], step: int = STEP) -> DataFrame:
    """As :func:`pack`, but all texts go into containers of every one capacity: one whole packing per profile."""
    out = None
    for profile, capacity in sorted(tiers, key=lambda t: t[1]):
        p = pack(sizes, [(profile, capacity)], step)
        out = p if out is None else out.unionByName(p)
    return out


def utilisation(packed: DataFrame) -> DataFrame:
    """(profile, capacity, n_items, n_containers, used_tokens, fill_share, n_step_groups)."""
    per = packed.groupBy("profile", "capacity", "container").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"), F.max("step_group").alias("g"))
    out = per.groupBy("profile", "capacity").agg(
        F.sum("n").alias("n_items"), F.count("*").alias("n_containers"), F.sum("t").alias("used_tokens"), (F.max("g") + 1).alias("n_step_groups")
    )
    return out.withColumn("fill_share", F.round(F.col("used_tokens") / (F.col("capacity") * F.col("n_containers")), 6))
