"""Items that appear together: pair counts as a blocked Gram matrix, against what chance would give.

Baskets become rows of a binary sparse matrix. Rows go to record blocks by a hash of the basket; each block multiplies
its transpose with itself by item blocks, and the sparse partial products are summed over the blocks. Only items that
reach the least count take part (a pair never occurs more often than either item), which loses nothing.

Defined results: null baskets and items are left out, an item counts once per basket, ties need no order, an empty table
gives no rows. Within the product baskets are told apart by 128 bits of their name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.materialise import Cuts

#: Baskets of more items than this are multiplied one by one or as dense tiles, shorter ones all at once.
LONG = 64
#: Items per tile, rows per tile, and the pairs (or entries of long baskets) a task holds before it hands on or multiplies them.
BLOCK, ROWS, HELD = 1024, 2048, 1 << 20


def _sparse(row: np.ndarray, item: np.ndarray, width: int) -> np.ndarray:
    """Codes a * width + b of the upper triangle of XtX, rows sorted by (row, item)."""
    out = []
    step = 1
    while step < len(row):
        same = row[step:] == row[:-step]
        if not same.any():
            break
        out.append(item[:-step][same] * width + item[step:][same])
        step += 1
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _long(row: np.ndarray, item: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same product for long rows, sorted by (row, item), in parts (codes, counts) of HELD codes or so.

    Blocks of items that hold a thirty-second of their cells or more are multiplied as tiles, two at a time, where a matrix
    product is cheaper than its pairs; all other pairs are made from each row itself. So the work follows the pairs
    that exist, and what is held doesn't grow with the number of items.
    """
    edges = np.flatnonzero(np.diff(row)) + 1
    begin, end = np.append(0, edges), np.append(edges, len(row))
    for at in range(0, len(begin), ROWS):
        part = slice(begin[at], end[min(at + ROWS, len(begin)) - 1])
        here = item[part]
        r = np.repeat(np.arange(len(begin[at : at + ROWS])), (end - begin)[at : at + ROWS])
        names, of = np.unique(here // BLOCK, return_inverse=True)
        full = np.flatnonzero(np.bincount(of) * 32 >= (r[-1] + 1) * BLOCK) if r[-1] >= 32 else np.empty(0, int)
        tiles = {}
        for k in full:
            m = of == k
            tiles[k] = np.zeros((r[-1] + 1, BLOCK), bool)
            tiles[k][r[m], here[m] - names[k] * BLOCK] = True
        for i, k in enumerate(full):
            left = tiles[k].T.astype(np.float32)
            for c in full[i:]:
                g = left @ tiles[c].astype(np.float32)
                if k == c:
                    g = np.triu(g, 1)
                p, q = np.nonzero(g)
                yield (p + names[k] * BLOCK) * width + q + names[c] * BLOCK, np.rint(g[p, q]).astype(np.int64)
        dense = np.zeros(len(names), bool)
        dense[full] = True
        done = dense[of]
        for a, b in zip(begin[at : at + ROWS], end[at : at + ROWS]):
            mine, tiled = item[a:b], done[a - part.start : b - part.start]
            step = max(1, HELD // len(mine))
            for first in range(0, len(mine), step):
                x = slice(first, min(first + step, len(mine)))
                pairs = np.arange(len(mine)) > np.arange(x.start, x.stop)[:, None]
                pairs &= ~(tiled[x][:, None] & tiled)
                i, j = np.nonzero(pairs)
                codes = mine[x][i] * width + mine[j]
                yield codes, np.ones(len(codes), np.int64)


def _gram(width: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def merge(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(codes, return_inverse=True)
        return keys, np.bincount(at, weights=counts, minlength=len(keys)).astype(np.int64)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by basket; a basket's rows may end in the next batch."""
        codes, counts, held = [], [], 0
        late: list[tuple[np.ndarray, np.ndarray]] = []

        def out():
            for i in range(0, len(codes[0]), 1 << 18):
                k = codes[0][i : i + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(k // width), pa.array(k % width), pa.array(counts[0][i : i + (1 << 18)])], schema=schema)

        def add(k, n):
            """Hold partial sums; hand them on when there are too many of them."""
            nonlocal codes, counts, held
            codes.append(k)
            counts.append(n)
            held += len(k)
            if held > HELD:
                k, n = merge(np.concatenate(codes), np.concatenate(counts))
                codes, counts, held = [k], [n], len(k)
                if held > HELD:
                    yield from out()
                    codes, counts, held = [], [], 0

        def long():
            row, item = (np.concatenate(x) for x in zip(*late))
            late.clear()
            for k, n in _long(row, item, width):
                yield from add(k, n)

        def take(row, item):
            order = np.lexsort((item, row))
            row, item = row[order], item[order]
            _, size = np.unique(row, return_counts=True)
            many = np.repeat(size > LONG, size)
            c = _sparse(row[~many], item[~many], width)
            yield from add(c, np.ones(len(c), np.int64))
            if many.any():
                late.append((row[many], item[many]))
                if sum(len(x) for x, _ in late) > HELD:
                    yield from long()

        kept: list[tuple[np.ndarray, np.ndarray]] = []  # batches of a basket that goes on and on
        number, last_name = 0, None
        for batch in batches:
            x, y, item = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "item"))
            if not len(item):
                continue
            new = np.append((x[0], y[0]) != last_name, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
            row = number + np.cumsum(new)
            number, last_name = int(row[-1]), (x[-1], y[-1])
            kept.append((row, item))
            if row[0] == row[-1] and kept[0][0][0] == row[0]:
                continue
            row, item = (np.concatenate(x) for x in zip(*kept))
            last = row == row[-1]  # the last basket may go on
            kept = [(row[last], item[last])]
            yield from take(row[~last], item[~last])
        if kept:
            yield from take(*(np.concatenate(x) for x in zip(*kept)))
        if late:
            yield from long()
        if held:
            codes, counts = ([x] for x in merge(np.concatenate(codes), np.concatenate(counts)))
            yield from out()

    return block


def pair_counts(spark, baskets: DataFrame, least: int = 10, repeats: bool = True) -> DataFrame:
    """kind, item_a, item_b, n_ab, n_a, n_b, n_baskets for pairs of items that occur together at least ``least`` times.

    ``baskets`` has kind, basket and item; item_a < item_b by code point, within a kind. Without ``repeats`` the caller
    vouches that no item stands in a basket twice.
    """
    cuts = Cuts(spark, "gram")
    rows = baskets.where("kind is not null and basket is not null and item is not null").select("kind", "basket", "item")
    rows = cuts.cut(rows.distinct() if repeats else rows)
    total = rows.groupBy("kind").agg(F.count_distinct("basket").alias("n_baskets"))
    # Items of all kinds share one numbering; the number of items that reach the least count is far below the rows.
    items = cuts.cut(rows.groupBy("kind", "item").agg(F.count("*").alias("n_item")).where(F.col("n_item") >= least).withColumn("id", F.monotonically_increasing_id()))
    top = items.agg(F.max("id"), F.count("*")).first()
    if not top[1]:
        empty = rows.limit(0)
        zero = F.lit(0).cast("bigint")
        return empty.select("kind", F.col("item").alias("item_a"), F.col("item").alias("item_b"), *[zero.alias(c) for c in ("n_ab", "n_a", "n_b", "n_baskets")])
    # Dense numbers: the partitions' parts of the id are closed up, a table of one row for each partition.
    part = F.shiftright("id", 33)
    starts = items.groupBy(part.alias("part")).agg(F.count("*").alias("size")).collect()
    at, begin = 0, {}
    for r in sorted(starts, key=lambda r: r.part):
        begin[r.part] = at
        at += r["size"]
    offset = F.create_map(*[F.lit(x).cast("bigint") for kv in begin.items() for x in kv])
    items = items.withColumn("id", F.element_at(offset, part) + F.col("id").bitwiseAND((1 << 33) - 1))
    numbered = rows.join(items.select("kind", "item", "id"), ["kind", "item"]).select(F.xxhash64("kind", "basket").alias("x"), F.xxhash64(F.lit("second"), "kind", "basket").alias("y"), F.col("id").alias("item"))
    blocks = numbered.repartition("x").sortWithinPartitions("x", "y")
    parts = blocks.mapInArrow(_gram(at), "a bigint, b bigint, n bigint")
    sums = parts.groupBy("a", "b").agg(F.sum("n").alias("n_ab")).where(F.col("n_ab") >= least)
    side = lambda s: items.select(F.col("id").alias(s), F.col("kind").alias(f"kind_{s}"), F.col("item").alias(f"item_{s}"), F.col("n_item").alias(f"n_{s}"))
    pairs = sums.join(side("a"), "a").join(side("b"), "b").join(total.withColumnRenamed("kind", "kind_a"), "kind_a")
    first = F.col("item_a") < F.col("item_b")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return pairs.select(
        F.col("kind_a").alias("kind"), pick("item_a", "item_b").alias("item_a"), pick("item_b", "item_a").alias("item_b"),
        "n_ab", pick("n_a", "n_b").alias("n_a"), pick("n_b", "n_a").alias("n_b"), "n_baskets",
    )


def lift(pairs: DataFrame) -> DataFrame:
    """Add how many times more often than by chance a pair occurs: n_ab * N / (n_a * n_b)."""
    return pairs.withColumn("lift", F.col("n_ab") * F.col("n_baskets").cast("double") / (F.col("n_a").cast("double") * F.col("n_b")))


def at_least(pairs: DataFrame, times: int) -> DataFrame:
    """The pairs that occur at least ``times`` as often as by chance, in exact whole numbers."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    return pairs.where(wide("n_ab") * wide("n_baskets") >= F.lit(times) * (wide("n_a") * wide("n_b")))
