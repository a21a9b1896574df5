"""Mixing sources to target weights (operator 2).

Documents are aggregated by membership pattern (the set of sources that they
belong to). A min-cost flow sends the token capacity of the patterns to the
quotas of the sources; the r-th use of the same tokens costs more than the one
before (convex costs), so repetition is spread. What a pattern has to give is
then taken from its documents: whole passes over all of them, and for the rest
a draw by a seeded hash.

The flow's network has a node for each pattern and source, no documents; it is
solved on the driver and the number of patterns is checked (``MAX_PATTERNS``).
The draw needs, for each pattern, the hash up to which documents are taken: it
comes from word sums in about sqrt(n) hash ranges and then from the one range
in which the rest runs out, so no group holds more than about sqrt(n) rows of a
pattern of n documents, however large a share of all rows one source has.

Defined results: a null or empty text has size 0 and is taken 0 times or more
without effect; the null source is a source (the last); rows with the same id
and text are drawn together; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillrank.llm.common import col, stored

#: Largest number of times that a document is taken.
MOST_COPIES = 3
WEIGHTS = (1, 2, 3)
SEED = 20
#: Membership patterns that the driver's network may have.
MAX_PATTERNS = 100_000
#: Hash ranges of a pattern at most.
MAX_RANGES = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"

Pattern = tuple[str | None, ...]


def text_size(text: Column) -> Column:
    """Words of a text by the contract; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycled_weights(sources: Sequence[str | None], weights: Sequence[float] = WEIGHTS) -> dict[str | None, float]:
    """Sources by code point, null last, weigh 1, 2, 3, repeating."""
    ordered = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: weights[i % len(weights)] for i, s in enumerate(ordered)}


def capped_targets(sizes: dict[str | None, int], weights: dict[str | None, float], total: float, most: int = MOST_COPIES) -> dict[str | None, float]:
    """Shares of ``total`` by weight; above ``most`` times its size a target stops there and the others share the excess."""
    targets, open_, left = {}, dict(weights), float(total)
    while open_:
        weight = sum(open_.values())
        share = {s: left * w / weight for s, w in open_.items()}
        over = [s for s in open_ if share[s] > most * sizes.get(s, 0)]
        if not over:
            targets.update(share)
            break
        for s in over:
            targets[s] = float(most * sizes.get(s, 0))
            left -= targets[s]
            del open_[s]
    return targets


class _Network:
    """Successive shortest paths with potentials."""

    def __init__(self, nodes: int):
        self.arcs: list[list[int]] = []  # head, capacity, cost; the reverse arc is at index ^ 1
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def arc(self, tail: int, head: int, capacity: int, cost: int) -> int:
        self.out[tail].append(len(self.arcs))
        self.arcs.append([head, capacity, cost])
        self.out[head].append(len(self.arcs))
        self.arcs.append([tail, 0, -cost])
        return len(self.arcs) - 2

    def solve(self, start: int, end: int) -> None:
        potential = [0] * len(self.out)
        while True:
            far, via = [math.inf] * len(self.out), [-1] * len(self.out)
            far[start], queue = 0, [(0, start)]
            while queue:
                d, node = heapq.heappop(queue)
                if d > far[node]:
                    continue
                for a in self.out[node]:
                    head, capacity, cost = self.arcs[a]
                    if capacity > 0 and (new := d + cost + potential[node] - potential[head]) < far[head]:
                        far[head], via[head] = new, a
                        heapq.heappush(queue, (new, head))
            if far[end] == math.inf:
                return
            potential = [p + (d if d < math.inf else far[end]) for p, d in zip(potential, far, strict=True)]
            path, node = [], end
            while node != start:
                path.append(via[node])
                node = self.arcs[via[node] ^ 1][0]
            amount = min(self.arcs[a][1] for a in path)
            for a in path:
                self.arcs[a][1] -= amount
                self.arcs[a ^ 1][1] += amount


def route(capacities: dict[Pattern, int], quotas: dict[str | None, int], most: int = MOST_COPIES) -> dict[Pattern, dict[str | None, int]]:
    """Words that each pattern gives to each of its sources: a maximal flow of least repetition cost.

    The r-th use of a pattern's words costs r - 1 a word. Patterns that share
    no source are solved apart.
    """
    leader: dict[str | None, str | None] = {s: s for p in capacities for s in p}

    def find(s):
        while leader[s] != s:
            leader[s] = leader[leader[s]]
            s = leader[s]
        return s

    for p in capacities:
        for s in p[1:]:
            leader[find(s)] = find(p[0])
    apart: dict[str | None, list[Pattern]] = {}
    for p in capacities:
        if p:
            apart.setdefault(find(p[0]), []).append(p)
    flows: dict[Pattern, dict[str | None, int]] = {p: {} for p in capacities}
    for patterns in apart.values():
        sources = sorted({s for p in patterns for s in p}, key=lambda s: (s is None, s or ""))
        number = {s: 2 + len(patterns) + i for i, s in enumerate(sources)}
        network, ways = _Network(2 + len(patterns) + len(sources)), {}
        for i, p in enumerate(patterns):
            for r in range(most):
                network.arc(0, 2 + i, capacities[p], r)
            for s in p:
                ways[p, s] = network.arc(2 + i, number[s], most * capacities[p], 0)
        for s in sources:
            network.arc(number[s], 1, quotas.get(s, 0), 0)
        network.solve(0, 1)
        for (p, s), a in ways.items():
            flows[p][s] = network.arcs[a ^ 1][1]
    return flows


@dataclass
class Mixture:
    """Sizes and targets by source, flows by pattern."""

    sizes: dict[str | None, int]
    targets: dict[str | None, float]
    flows: dict[Pattern, dict[str | None, int]]


def _sized(docs: DataFrame, members: Column, id_col: str, text_col: str, seed: int) -> list[Column]:
    """Pattern key, size and a seeded draw in [0, 2^63) of a row."""
    pattern = F.to_json(F.array_sort(F.array_distinct(members.cast("array<string>"))))
    text = col(text_col).cast("string")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), col(id_col), text), 1)
    return [F.coalesce(pattern, F.lit("[]")).alias("pattern"), text_size(text).alias("size"), draw.alias("draw")]


def _ranges(n: Column) -> Column:
    return F.least(F.ceil(F.sqrt(n)), F.lit(MAX_RANGES)).cast("long")


def _take(sized: DataFrame, weights, total, most: int) -> tuple[Mixture, DataFrame]:
    """The mixture, and for each pattern its ``copies`` of all and ``until``: those of a draw up to it once more."""
    spark = sized.sparkSession
    rows = sized.groupBy("pattern").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns; the network on the driver is bounded to that")
    key = {tuple(json.loads(r["pattern"])): r for r in rows}
    capacities = {p: r["size"] for p, r in key.items()}
    sizes: dict[str | None, int] = {}
    for p, size in capacities.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + size
    shares = cycled_weights(list(sizes)) if weights is None else {s: weights.get(s, 0) for s in sizes}
    targets = capped_targets(sizes, shares, sum(capacities.values()) if total is None else total, most)
    flows = route(capacities, {s: round(t) for s, t in targets.items()}, most)
    plan = []
    for p, r in key.items():
        given = sum(flows[p].values())
        copies = min(most, given // r["size"]) if r["size"] else 0
        plan.append((r["pattern"], copies, given - copies * r["size"], r["n"]))
    plan = spark.createDataFrame(plan, "pattern string, copies long, rest long, n long")
    return Mixture(sizes, targets, flows), plan.join(_until(sized, plan), "pattern", "left").select("pattern", "copies", F.coalesce("until", F.lit(-1)).alias("until"))


def _until(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """For each pattern with a rest: the draw up to which its documents' words come nearest to the rest."""
    owing = F.broadcast(plan.where("rest > 0").select("pattern", "rest", _ranges(F.col("n")).alias("ranges")))
    at = F.floor(F.col("draw").cast("double") / float(1 << 63) * F.col("ranges"))
    ranged = sized.join(owing, "pattern").withColumn("range", F.least(at, F.col("ranges") - 1))
    sums = ranged.groupBy("pattern", "range", "rest").agg(F.sum("size").alias("size"))
    before = F.sum("size").over(W.partitionBy("pattern").orderBy("range")) - F.col("size")
    last = sums.withColumn("before", before).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("size") >= F.col("rest")))
    last = F.broadcast(last.select("pattern", "range", (F.col("rest") - F.col("before")).alias("left")))
    draws = ranged.join(last, ["pattern", "range"]).groupBy("pattern", "left", "draw").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(W.partitionBy("pattern").orderBy("draw"))
    near = draws.withColumn("upto", upto).withColumn("least", F.min("draw").over(W.partitionBy("pattern")))
    taken = (F.col("upto") <= F.col("left")) | (F.col("upto") - F.col("left") < F.col("left") - (F.col("upto") - F.col("size")))
    return near.groupBy("pattern").agg(F.coalesce(F.max(F.when(taken, F.col("draw"))), F.min("least") - 1).alias("until"))


def _copies(plan: DataFrame) -> Column:
    return (F.col("copies") + (F.col("draw") <= F.col("until")).cast("long")).alias("copies")


def mixture_rows(docs: DataFrame, members: Column, id_col: str = "doc_id", text_col: str = "text", weights: dict[str | None, float] | None = None, total: float | None = None, seed: int = SEED, most: int = MOST_COPIES) -> tuple[Mixture, DataFrame]:
    """The mixture, and for each row of ``docs`` its ``id``, ``pattern``, ``size`` and ``copies``.

    ``members`` gives the sources of a row as an array. ``weights`` by source
    are cycled 1, 2, 3 by default; ``total`` words are shared, by default as
    many as there are.
    """
    sized = stored(docs.select(col(id_col).alias("id"), *_sized(docs, members, id_col, text_col, seed)))
    mixture, plan = _take(sized, weights, total, most)
    return mixture, sized.join(F.broadcast(plan), "pattern").select("id", "pattern", "size", _copies(plan))


def mix(docs: DataFrame, members: Column, id_col: str = "doc_id", text_col: str = "text", weights: dict[str | None, float] | None = None, total: float | None = None, seed: int = SEED, most: int = MOST_COPIES) -> DataFrame:
    """The rows of ``docs`` that the mixture takes, repeated as often as it takes them."""
    marks = _sized(docs, members, id_col, text_col, seed)
    sized = stored(docs.select(*marks))
    _, plan = _take(sized, weights, total, most)
    marked = docs.select(F.struct(*[col(c).alias(c) for c in docs.columns]).alias("doc"), marks[0], marks[2])
    taken = marked.join(F.broadcast(plan), "pattern").select("doc", _copies(plan)).where("copies > 0")
    repeated = taken.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
