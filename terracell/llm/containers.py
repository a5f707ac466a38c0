"""Fill containers of fixed capacity with items of varying size, by multiway differencing."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 2048

_ROWS = "item_id bigint, piece int, first_token bigint, tokens bigint, container_id bigint"


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, float]:
    """Split items into k sets of near-equal sums by Karmarkar-Karp multiway differencing.

    Every item starts as a partial partition: k sums, of which one is not zero. The two with
    the greatest spread are merged again and again, the largest sum of one onto the
    smallest of the other, so that their imbalances oppose. Returns the set of each item
    and the greatest sum.
    """
    n = len(sizes)
    order = np.argsort(-sizes, kind="stable")
    value = sizes[order].astype(float)
    # The first merges only lay the k largest items side by side, as long as zeros are left.
    head = min(n, k)
    up = list(range(n))  # the tree of merged sets: the node above each node
    parts = [(value[:head], np.arange(head))] + [(value[i : i + 1], np.array([i])) for i in range(head, n)]

    def spread(v: np.ndarray) -> float:
        return float(v[0] - (v[-1] if len(v) == k else 0.0))

    heap = [(-spread(v), i) for i, (v, _) in enumerate(parts)]
    heapq.heapify(heap)
    while len(heap) > 1:
        i, j = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        (a, x), (b, y) = parts[i], parts[j]
        parts[i] = parts[j] = None
        if len(a) < len(b):
            a, x, b, y = b, y, a, x
        if len(b) == 1 and len(a) == k:  # one item onto the smallest sum
            total = a[-1] + b[0]
            up[y[0]] = int(x[-1])
            at = k - 1 - int(np.searchsorted(a[-2::-1], total, side="left")) if k > 1 else 0
            v, w = a.copy(), x.copy()
            v[at + 1 :], w[at + 1 :] = a[at:-1], x[at:-1]
            v[at], w[at] = total, x[-1]
        else:
            lap = len(a) + len(b) - k
            if lap > 0:
                v = np.concatenate([a[: len(a) - lap], a[len(a) - lap :] + b[::-1][:lap], b[::-1][lap:]])
                for under, over in zip(y[::-1][:lap].tolist(), x[len(a) - lap :].tolist(), strict=True):
                    up[under] = over
                w = np.concatenate([x, y[::-1][lap:]])
            else:
                v, w = np.concatenate([a, b]), np.concatenate([x, y])
            sort = np.argsort(-v, kind="stable")
            v, w = v[sort], w[sort]
        parts.append((v, w))
        heapq.heappush(heap, (-spread(v), len(parts) - 1))
    v, w = parts[heap[0][1]]
    where = {int(node): s for s, node in enumerate(w)}
    out = np.empty(n, np.int64)
    for i in range(n):
        node, path = i, []
        while up[node] != node:
            path.append(node)
            node = up[node]
        for p in path:
            up[p] = node
        out[order[i]] = where[node]
    return out, float(v[0])


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item (sizes 1 to capacity), no container over capacity.

    Starts with the least number of containers that could do; while the fullest one of the
    near-equal split exceeds the capacity, the number rises, by steps that double and then
    halve, so that the least number that works is met within a few splits.
    """
    n = len(sizes)
    if not n:
        return np.zeros(0, np.int64)
    least = max(1, math.ceil(sizes.sum() / capacity), int((sizes * 2 > capacity).sum()))
    k, step, failed = least, 1, least - 1
    best = None
    while best is None:
        if k >= n:
            return np.arange(n)
        got, top = difference(sizes, k)
        if top <= capacity:
            best = (k, got)
        else:
            failed, k, step = k, k + step, step * 2
    while best[0] - failed > max(1, least // 400):
        k = (best[0] + failed) // 2
        got, top = difference(sizes, k)
        if top <= capacity:
            best = (k, got)
        else:
            failed = k
    return best[1]


def pack(items: DataFrame, ident: str, size: str, capacity: int) -> DataFrame:
    """Assign all items to containers: ``item_id, piece, first_token, tokens, container_id``.

    An item larger than the capacity is cut into full containers and a rest, which is packed
    like an item of its own (``piece`` counts from 0, ``first_token`` is where it starts); no
    other item is split. Items of null size or below 1 are left out. Each task packs its
    rows in blocks of 2 048 items, so no block grows with the data and nothing is shuffled;
    only the last block of a task can leave a container that is not nearly full. Container
    numbers are made of task, block and container, so they are unique; a task that runs
    again on the same rows gives the same result. Equal sizes are packed in order of
    appearance; repeated rows are packed each; an empty table gives no containers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 36
        held_id: list[np.ndarray] = []
        held_size: list[np.ndarray] = []
        held = 0

        def work(ids: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            whole = np.maximum(0, (sizes - 1) // capacity)  # full containers cut off the front
            rest = sizes - whole * capacity
            place = fill(rest, capacity)
            used = int(place.max()) + 1 if len(place) else 0
            piece = np.arange(int(whole.sum())) - np.repeat(np.cumsum(whole) - whole, whole)
            columns = [
                np.concatenate([np.repeat(ids, whole), ids]),
                np.concatenate([piece, whole]).astype(np.int32),
                np.concatenate([piece * capacity, whole * capacity]),
                np.concatenate([np.full(len(piece), capacity), rest]),
                np.concatenate([number + used + np.arange(len(piece)), number + place]),
            ]
            number += used + len(piece)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["item_id", "piece", "first_token", "tokens", "container_id"])

        for batch in batches:
            held_id.append(batch.column(0).to_numpy(zero_copy_only=False))
            held_size.append(batch.column(1).to_numpy(zero_copy_only=False))
            held += batch.num_rows
            if held >= 2 * BLOCK:
                ids, sizes = np.concatenate(held_id), np.concatenate(held_size)
                cut = (held // BLOCK - 1) * BLOCK
                for k in range(0, cut, BLOCK):
                    yield work(ids[k : k + BLOCK], sizes[k : k + BLOCK])
                held_id, held_size, held = [ids[cut:]], [sizes[cut:]], held - cut
        if held:
            yield work(np.concatenate(held_id), np.concatenate(held_size))

    kept = items.select(items[ident].cast("long").alias("item_id"), items[size].cast("long").alias("size")).where(F.col("size") >= 1)
    return kept.where("item_id is not null").mapInArrow(run, _ROWS)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row over all containers: ``containers, tokens, over_capacity, fill`` (share of the room used)."""
    each = packed.groupBy("container_id").agg(F.sum("tokens").alias("tokens"))
    return each.agg(
        F.count("*").alias("containers"),
        F.sum("tokens").alias("tokens"),
        F.sum((F.col("tokens") > capacity).cast("long")).alias("over_capacity"),
        (F.sum("tokens") / (F.count("*") * capacity)).alias("fill"),
    )
