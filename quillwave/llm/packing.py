"""Filling containers of fixed capacity with texts, in as few containers as possible.

Cost-balanced packing: a text of n tokens is estimated to cost n for what is
linear in it and n * n / capacity for attention.  As many containers are opened
as the tokens need at the least; descending texts are assigned to the container
of lowest cost that has room.  Balancing to the very end would leave every
container a little room that nothing fits, so the shortest texts (the last
share of the tokens) go to the container they fill best, ties to lowest cost.

Only texts longer than the capacity are divided: into full pieces, each a
container of its own, and the rest.  Assignment is sequential, so texts are
packed in blocks of bounded size side by side; a block wastes at most about one
container of its thousands.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwave.session import materialise

#: Texts in a block, and the share of its tokens placed by cost alone.
BLOCK_TEXTS, BALANCED_SHARE = 20_000, 0.7
#: Specs are a small fixed table; every text is packed for each.
MOST_SPECS = 1000


class _Containers:
    """Containers by remaining room; finds the cheapest with enough, or the fullest with enough."""

    def __init__(self, capacity: int):
        self.width = 1
        while self.width <= capacity:
            self.width *= 2
        self.none = (float("inf"), -1)
        self.best = [self.none] * (2 * self.width)  # cheapest below each node of a tree over the rooms
        self.heaps: list[list] = [[] for _ in range(capacity + 1)]

    def _refresh(self, room: int) -> None:
        best, node = self.best, self.width + room
        best[node] = self.heaps[room][0] if self.heaps[room] else self.none
        node //= 2
        while node:
            found = min(best[2 * node], best[2 * node + 1])
            if best[node] == found:
                return
            best[node] = found
            node //= 2

    def put(self, room: int, cost: float, container: int) -> None:
        heappush(self.heaps[room], (cost, container))
        self._refresh(room)

    def _take(self, room: int) -> tuple[int, float, int]:
        cost, container = heappop(self.heaps[room])
        self._refresh(room)
        return room, cost, container

    def cheapest(self, size: int) -> tuple[int, float, int] | None:
        best, node = self.best, self.width + size
        low, at = best[node], node
        while node > 1:
            if node % 2 == 0 and best[node + 1] < low:
                low, at = best[node + 1], node + 1
            node //= 2
        if low == self.none:
            return None
        while at < self.width:
            at = 2 * at if best[2 * at] == low else 2 * at + 1
        return self._take(at - self.width)

    def tightest(self, size: int) -> tuple[int, float, int] | None:
        best, node = self.best, self.width + size
        while best[node] == self.none:  # up to the first subtree right of here that holds any
            while node > 1 and node % 2 == 1:
                node //= 2
            if node <= 1:
                return None
            node += 1
        while node < self.width:
            node = 2 * node if best[2 * node] != self.none else 2 * node + 1
        return self._take(node - self.width)


def pack_block(sizes: np.ndarray, capacity: int, balanced: float = BALANCED_SHARE) -> np.ndarray:
    """The container of each item; sizes are from 0 to the capacity, in descending order."""
    total = int(sizes.sum())
    count = -(-total // capacity)
    containers, out = _Containers(capacity), np.zeros(len(sizes), np.int64)
    for i in range(count):
        containers.put(capacity, 0.0, i)
    placed, by_cost = 0, True
    for i, size in enumerate(sizes.tolist()):
        if size == 0:
            out[i:] = 0  # texts without tokens take no room: they stay with the first container
            break
        by_cost = by_cost and placed < balanced * total
        found = containers.cheapest(size) if by_cost else containers.tightest(size)
        if found is None:
            by_cost = False
            found = (capacity, 0.0, count)
            count += 1
        room, cost, container = found
        out[i] = container
        placed += size
        containers.put(room - size, cost + size + size * size / capacity, container)
    return out


def pack(lengths: DataFrame, key: str, tokens: str, specs: DataFrame, block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """(spec_id, key, piece, n_tokens, container): where every text or piece goes, per spec.

    ``specs`` is a small fixed table (spec_id, capacity_tokens), each packed
    alone; specs without a positive capacity are ignored, more than
    ``MOST_SPECS`` are an error.  Pieces count from 0.  NULL lengths count as 0
    tokens; texts without tokens are placed too, beside others where there are
    any.  Texts are told apart by their row, so a repeated or NULL key is as
    many texts as it has rows, spread over the blocks like any others.  Without
    texts the result is empty.  No container holds more than its capacity.
    """
    wanted = [(r[0], r[1]) for r in specs.select("spec_id", "capacity_tokens").dropna().limit(MOST_SPECS + 1).collect() if r[1] > 0]
    if len(wanted) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} specs")
    size = F.greatest(F.coalesce(F.col(tokens), F.lit(0)), F.lit(0)).cast("long")
    # written once: a row keeps its number whatever is lost and computed again
    texts, seen = materialise(lengths.select(F.col(key).alias("_key"), size.alias("size"), F.monotonically_increasing_id().alias("_row")), "texts", n=F.count(F.lit(1)))
    blocks = max(1, -(-seen["n"] // block_texts))
    kind = lengths.schema[key].dataType.simpleString()
    specs_of_each = F.array(*[F.struct(F.lit(i).alias("spec_id"), F.lit(c).alias("capacity")) for i, c in wanted]).cast("array<struct<spec_id:int,capacity:int>>")
    each = texts.select("*", F.inline(specs_of_each))
    full = F.floor(F.greatest(F.col("size") - 1, F.lit(0)) / F.col("capacity")).cast("long")  # pieces that fill a container
    each = each.withColumn("full", full).withColumn("rest", F.col("size") - F.col("full") * F.col("capacity"))
    block = F.pmod(F.xxhash64("_row"), F.lit(blocks))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["rest", "_row"], ascending=[False, True])
        found = pack_block(group["rest"].to_numpy(), int(group["capacity"].iloc[0]))
        name = f"{group['spec_id'].iloc[0]}-{group['_block'].iloc[0]}-"
        return pd.DataFrame({"spec_id": group["spec_id"], "_key": group["_key"], "piece": group["full"], "n_tokens": group["rest"], "container": [f"{name}{c}" for c in found]})

    rests = (
        each.select("spec_id", "capacity", "_key", "_row", "full", "rest", block.alias("_block"))
        .groupBy("spec_id", "_block").applyInPandas(fill, f"spec_id int, _key {kind}, piece long, n_tokens long, container string")
    )
    whole = each.where("full > 0").select("spec_id", "_key", "_row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece"), F.col("capacity").cast("long").alias("n_tokens"))
    whole = whole.withColumn("container", F.concat_ws("-", "spec_id", F.lit("full"), "_row", "piece")).drop("_row")
    return rests.unionByName(whole).withColumnRenamed("_key", key)
