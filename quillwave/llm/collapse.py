"""Collapsing runs of identical or near-identical consecutive events.

Adjacent agglomeration: the events of an entity, in order, are a linked list of
runs.  A priority queue holds the neighbouring runs that meet the similarity
and gap limits; the most similar are merged first, until none is left.  How far
neighbours are apart is a matter of linkage: of the events where they touch
(``touch``: the result is every maximal run of alike events), or also of the
runs' mean values, which move with every merge (``mean``: slow drifts are cut
into levels, and what is merged first decides what can still be merged).

No task holds an entity: order is cut into blocks of time, every block is
agglomerated on its own, and only the first and last run of each block go into
a second pass over the same code, which merges across the cuts.  There, runs of
one block are no neighbours: what could merge within a block has merged.  What a task
sorts and holds is bounded by the block, however large or hot the entity is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwave.session import materialise

#: Width of a block in the unit of the order (milliseconds: about 70 minutes).
BLOCK = 1 << 22

_RUN = ["first", "last", "n", "x_first", "x_last", "x_sum"]
_TYPES = "first long, last long, n long, x_first long, x_last long, x_sum long, edge boolean, origin long"


def merge_neighbours(touch: np.ndarray, n: np.ndarray | None = None, total: np.ndarray | None = None, most_apart: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(head, tail) positions of the runs left when no neighbours can merge any more.

    ``touch[i]`` is how far items i and i + 1 are apart where they touch,
    negative if the limits forbid to merge them.  With the numbers and sums of
    the items' values, neighbours are as far apart as their means, at most
    ``most_apart``.  Ties merge the earlier pair first.
    """
    size = len(touch) + 1
    links = np.flatnonzero(touch >= 0)
    by_mean = n is not None
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))  # the list of runs, by their heads
    tail = list(range(size))
    merged = np.zeros(size, bool)  # heads that are heads no more
    if by_mean:
        counts, sums = n.tolist(), total.tolist()
        allowed = (touch >= 0).tolist()
        apart = lambda a, b: abs(sums[a] / counts[a] - sums[b] / counts[b])
        queue = [(apart(i, i + 1), i, i + 1, 0, 0) for i in links.tolist() if apart(i, i + 1) <= most_apart]
    else:
        queue = [(d, i, i + 1, 0, 0) for d, i in zip(touch[links].tolist(), links.tolist(), strict=True)]
    heapify(queue)
    head = list(range(size)) if not by_mean else None  # of the run that ends here
    version: dict[int, int] = {}
    while queue:
        _, a, b, va, vb = heappop(queue)
        if by_mean:
            if merged[a] or merged[b] or version.get(a, 0) != va or version.get(b, 0) != vb:
                continue  # one of the two has changed since
        else:
            a = head[a]
        tail[a] = tail[b]
        merged[b] = True
        after[a] = after[b]
        if after[b] < size:
            before[after[b]] = a
        if not by_mean:
            head[tail[a]] = a
            continue
        counts[a] += counts[b]
        sums[a] += sums[b]
        version[a] = version.get(a, 0) + 1
        for left, right in ((before[a], a), (a, after[a])):
            if left >= 0 and right < size and allowed[tail[left]] and apart(left, right) <= most_apart:
                heappush(queue, (apart(left, right), left, right, version.get(left, 0), version.get(right, 0)))
    heads = np.flatnonzero(~merged)
    return heads, np.asarray(tail)[heads]


def _agglomerate(keys: list[str], most_apart: int, most_gap: int, within: bool, linkage: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over sorted rows (keys, block, run columns, origin): the merged runs of each key and block.

    ``within`` tells that runs of one origin may merge.
    """

    def same_as_before(t: pa.Table) -> np.ndarray:
        same = np.ones(max(0, t.num_rows - 1), bool)
        for c in [*keys, "block"]:
            column = t[c].combine_chunks()
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            same &= pc.equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        return same

    def merged(t: pa.Table) -> pa.Table:
        same = same_as_before(t)
        first, last, n = (t[c].to_numpy() for c in ("first", "last", "n"))
        usable = t["x_first"].is_valid().to_numpy()
        xf, xl = (t[c].fill_null(0).to_numpy() for c in ("x_first", "x_last"))
        apart, origin = np.abs(xf[1:] - xl[:-1]), t["origin"].fill_null(0).to_numpy()
        apart_blocks = np.ones(len(same), bool) if within else origin[1:] != origin[:-1]
        may = same & apart_blocks & usable[1:] & usable[:-1] & (apart <= most_apart) & (first[1:] - last[:-1] <= most_gap)
        touch = np.where(may, apart, -1)
        sums = t["x_sum"].fill_null(0).to_numpy()
        heads, tails = merge_neighbours(touch, n, sums, most_apart) if linkage == "mean" else merge_neighbours(touch)
        cuts = np.flatnonzero(~same) + 1
        opens, closes = np.zeros(len(first), bool), np.zeros(len(first), bool)
        opens[0] = closes[-1] = True
        opens[cuts] = True
        closes[cuts - 1] = True
        total, whole = (np.concatenate([[0], np.cumsum(c)]) for c in (n, sums))
        out = {c: t[c].take(heads) for c in [*keys, "first", "x_first"]}
        out |= {"last": t["last"].take(tails), "x_last": t["x_last"].take(tails), "n": pa.array(total[tails + 1] - total[heads]), "x_sum": pa.array(whole[tails + 1] - whole[heads], mask=~usable[heads]), "edge": pa.array(opens[heads] | closes[tails]), "origin": t["block"].take(heads)}
        return pa.table({c: out[c] for c in [*keys, *_RUN, "edge", "origin"]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None  # rows of the key and block that may go on in the next batch
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not t.num_rows:
                continue
            t = pa.concat_tables([waiting, t]).combine_chunks() if waiting is not None else t
            cuts = np.flatnonzero(~same_as_before(t)) + 1
            done = int(cuts[-1]) if len(cuts) else 0
            if done:
                yield from merged(t.slice(0, done)).to_batches()
            waiting = t.slice(done)
        if waiting is not None and waiting.num_rows:
            yield from merged(waiting).to_batches()

    return run


def _pass(runs: DataFrame, keys: list[str], block: int, most_apart: int, most_gap: int, within: bool, linkage: str) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema if f.name in keys)
    cut = runs.select(*keys, F.floor(F.col("first") / F.lit(block)).cast("long").alias("block"), *_RUN, "origin")
    blocks = cut.repartition(*keys, "block").sortWithinPartitions(*keys, "block", "first", "last", "x_first")
    return blocks.mapInArrow(_agglomerate(keys, most_apart, most_gap, within, linkage), f"{schema}, {_TYPES}")


def collapse_runs(events: DataFrame, keys: list[str], order: str, value: str, most_apart: int, most_gap: int, block: int = BLOCK, linkage: str = "touch") -> DataFrame:
    """(keys, first, last, n, x_first, x_last, x_sum): one row per run of each entity.

    Neighbours in ``order`` merge if both values are usable (not NULL), differ
    by at most ``most_apart`` where they touch and their places by at most
    ``most_gap``; with ``linkage="mean"`` the means of the runs may differ by
    no more either, and runs form within a block before they merge with others.
    An event with a NULL value is a run of its own; one with a NULL key or place
    belongs to no sequence and goes.  Rows that repeat a place are neighbours
    at distance 0, in order of their value.  An empty table gives an empty
    result; further columns are ignored.
    """
    if linkage not in ("touch", "mean"):
        raise ValueError(f"no linkage {linkage}")
    place, x = F.col(order).cast("long"), F.col(value).cast("long")
    rows = events.dropna(subset=[*keys, order]).select(
        *keys, place.alias("first"), place.alias("last"), F.lit(1).cast("long").alias("n"), *[x.alias(c) for c in ("x_first", "x_last", "x_sum")], F.lit(None).cast("long").alias("origin")
    )
    parts = materialise(_pass(rows, keys, block, most_apart, most_gap, True, linkage), "runs")
    across = _pass(parts.where("edge"), keys, 1 << 62, most_apart, most_gap, False, linkage)
    return parts.where("NOT edge").unionByName(across).drop("edge", "origin")
