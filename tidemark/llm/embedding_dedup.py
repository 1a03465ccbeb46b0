"""Embedding near-dedup by collision-counting projections.

Distinct vectors are filed in L tables. A table sorts a one-dimensional random projection; so that the
work stays below all pairs, it does so within the cells of k random hyperplanes, with k growing as the
logarithm of the number of vectors. Two vectors collide in a table when they share the cell and one's
projection lies in the window of half-width h centred on the other's. Pairs with COUNT or more
collisions over all tables are verified by cosine in double precision.

h, k and L are calibrated so that a pair exactly at the threshold passes with probability RECALL or
more (calibrated()); closer pairs pass more often. A pair is counted and verified once, in the first
table where it collides, from the projections both rows carry in their vector, so no pairs are shuffled
and none is emitted: a task gives each vector's sum of linked copies and links that span its groups. A pair that
first collides in one of the last COUNT - 1 tables cannot pass, so vectors are not filed there.

A cell of more than MOST_CELL vectors, such as one of very many near copies, is parted by a hash into blocks of
about half as many, and each two blocks, and each alone, are a group of their own: memory is bounded, and the
comparisons of one cell spread over as many tasks as their number asks for.

Edges: null, empty, zero or non-finite vectors and those with null components link with nothing, as do
rows with a null id (component null, kept false). Vectors of different lengths do not link. Equal
vectors are one node; ids are expected to be unique, and rows that share one share its counts. An empty
table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.common import connected_components, lookup, materialise
from tidemark.session import ship

COUNT = 2
RECALL = 0.98
SEED = 20240229
#: Vectors that a cell holds on average.
CELL = 1024
#: A pair at the threshold lies within the window with this probability (1.645 standard deviations).
IN_WINDOW, DEVIATIONS = 0.9, 1.6449
TILE = 512
#: Vectors of a cell that one group compares at most, or nearly so.
MOST_CELL = 16_384
ALONE = 0


def calibrated(vectors: int, threshold: float) -> tuple[int, int, float]:
    """(k hyperplanes, L tables, window half-width h) for so many distinct vectors."""
    k = max(0, min(24, math.ceil(math.log2(max(vectors, 1) / CELL))))
    p = (1 - math.acos(threshold) / math.pi) ** k * IN_WINDOW
    tables = COUNT
    while sum(math.comb(tables, i) * p**i * (1 - p) ** (tables - i) for i in range(COUNT)) > 1 - RECALL:
        tables += 1
    return k, tables, DEVIATIONS * math.sqrt(2 - 2 * threshold)


def _matrix(dim: int, k: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, tables * (k + 1)))


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _signatures(unit: np.ndarray, k: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell codes and projections, each tables x rows."""
    made = (unit @ _matrix(unit.shape[1], k, tables)).T.reshape(tables, k + 1, len(unit))
    codes = ((made[:, :k] > 0) * (1 << np.arange(k, dtype=np.int64))[:, None]).sum(axis=1) if k else np.zeros((tables, len(unit)), np.int64)
    return codes, np.ascontiguousarray(made[:, k])


class _Cells:
    """The cell of each vector in each table it is filed in, with how many of the batch lie there."""

    def __init__(self, k: int, tables: int):
        self.k, self.tables = k, tables

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows, dim in _by_length(batch.column(0)):
                codes, _ = _signatures(_unit(rows), self.k, self.tables)
                for t in range(self.tables - COUNT + 1):
                    bucket, n = np.unique(_bucket(codes[t], t, dim), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n)], ["bucket", "n"])


def _bucket(codes: np.ndarray, table: int, dim: int) -> np.ndarray:
    return (codes * 4096 + table) * 16384 + dim


def _by_length(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(places in the batch, vectors, length) of the vectors of each length."""
    lengths = np.asarray(lists.value_lengths())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths).tolist():
        own = np.nonzero(lengths == dim)[0]
        yield own, flat[starts[own][:, None] + np.arange(dim)], dim


class _Filing:
    def __init__(self, k: int, tables: int):
        self.k, self.tables = k, tables

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, rows, dim in _by_length(batch.column(2)):
                codes, at = _signatures(_unit(rows), self.k, self.tables)
                packed = pa.array([r.tobytes() for r in rows], pa.binary())
                node, n = batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own))
                for t in range(self.tables - COUNT + 1):
                    bucket = _bucket(codes[t], t, dim)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(at[t]), node, n, packed], ["bucket", "at", "node", "n", "vec"])


class _Pairing:
    def __init__(self, k: int, tables: int, h: float, threshold: float, kind: str):
        self.k, self.tables, self.h, self.threshold, self.kind = k, tables, h, threshold, kind

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            bucket, pair = batch.column("bucket").to_numpy(), batch.column("pair").to_numpy()
            cuts = [0, *(np.nonzero(np.diff(bucket) | np.diff(pair))[0] + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                piece = batch.slice(a, b - a)
                if held and (held[0].column("bucket")[0].as_py(), held[0].column("pair")[0].as_py()) != (int(bucket[a]), int(pair[a])):
                    yield from self.group(held)
                    held = []
                held.append(piece)
        if held:
            yield from self.group(held)

    def group(self, pieces: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(pieces).combine_chunks()
        if table.num_rows < 2:
            return
        t = table.column("bucket")[0].as_py() // 16384 % 4096
        node, n = table.column("node").to_numpy(), table.column("n").to_numpy()
        unit = _unit(np.frombuffer(b"".join(table.column("vec").to_pylist()), self.kind).reshape(len(node), -1))
        codes, at = _signatures(unit, self.k, self.tables)
        own, side = table.column("at").to_numpy(), table.column("side").to_numpy()
        # In a group of two blocks only vectors of different ones are compared.
        across = side[0] != ALONE
        ends = np.searchsorted(own, own + self.h, side="right")
        sums = np.zeros(len(node), np.int64)
        label, us, vs = np.arange(len(node)), [], []
        for a in range(0, len(node), TILE):
            b = min(a + TILE, len(node))
            for c in range(a, int(ends[b - 1]), TILE):
                d = min(c + TILE, int(ends[b - 1]))
                i, j = np.arange(a, b), np.arange(c, d)
                live = (j[None, :] > i[:, None]) & (j[None, :] < ends[a:b, None])
                if across:
                    live &= side[a:b, None] != side[None, c:d]
                count = np.zeros(live.shape, np.uint16)
                for q in range(self.tables):
                    hit = codes[q, a:b, None] == codes[q, None, c:d]
                    hit &= np.abs(at[q, a:b, None] - at[q, None, c:d]) <= self.h
                    if q < t:
                        live &= ~hit
                    elif q == t:
                        hit = live  # the window test by the stored projections, the same in every task
                    count += hit
                live &= count >= COUNT
                if not live.any():
                    continue
                live &= unit[a:b] @ unit[c:d].T >= self.threshold
                sums[a:b] += live @ n[c:d]
                sums[c:d] += n[a:b] @ live
                for x in np.nonzero(live.any(axis=1))[0].tolist():
                    js = c + np.nonzero(live[x])[0]
                    for lab in np.unique(label[js]).tolist():
                        if lab != label[a + x]:
                            us.append(node[a + x])
                            vs.append(node[js[label[js] == lab][0]])
                            label[label == lab] = label[a + x]
        got = np.nonzero(sums)[0]
        if len(got):
            none = pa.nulls(len(got), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(node[got]), none, pa.array(sums[got])], ["u", "v", "links"])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(us, np.int64)), pa.array(np.array(vs, np.int64)), pa.nulls(len(us), pa.int64())], ["u", "v", "links"])


def near_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """One row per row of `vectors`: vec_id, n_links, component_id, kept."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    kind = "float32" if isinstance(rows.schema["vec"].dataType.elementType, T.FloatType) else "float64"
    if kind == "float64":
        rows = rows.withColumn("vec", F.col("vec").cast("array<double>"))
    fine = F.expr("""vec_id is not null and vec is not null and size(vec) between 1 and 16383
        and not exists(vec, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(vec, x -> x <> 0)""")
    rows = rows.withColumn("vec", F.when(F.coalesce(fine, F.lit(False)), F.col("vec")))
    nodes = materialise(rows.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")), "vectors")
    found = nodes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    k, tables, h = calibrated(found[0], threshold)
    element = "float" if kind == "float32" else "double"
    filed = nodes.select("node", "n", F.col("vec").cast(f"array<{element}>")).mapInArrow(_Filing(k, tables), "bucket long, at double, node long, n long, vec binary")
    cells = nodes.select(F.col("vec").cast(f"array<{element}>")).mapInArrow(_Cells(k, tables), "bucket long, n long")
    large = cells.groupBy("bucket").agg(F.sum("n").alias("size")).where(F.col("size") > MOST_CELL)
    large = materialise(large.select(F.col("bucket").alias("_large"), F.ceil(F.col("size") / (MOST_CELL // 2)).cast("int").alias("blocks")), "cells")
    # A row of a large cell goes to the group of its block with each other one, and to that of its block alone; `pair` numbers a cell's groups.
    dealt = filed.join(large, F.col("bucket") == F.col("_large"), "left").withColumn("mine", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1)).cast("long")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    dealt = dealt.select("bucket", "at", "node", "n", "vec", "mine", F.coalesce("blocks", F.lit(1)).alias("blocks"), other.alias("other"))
    pair = (F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")).cast("long")
    dealt = dealt.select("bucket", pair.alias("pair"), "at", "node", "n", (F.when(F.col("mine") == F.col("other"), ALONE).when(F.col("mine") < F.col("other"), 1).otherwise(2)).alias("side"), "vec")
    paired = dealt.repartition("bucket", "pair").sortWithinPartitions("bucket", "pair", "at").mapInArrow(_Pairing(k, tables, h, threshold, kind), "u long, v long, links long")
    paired = materialise(paired, "links")
    parts = connected_components(paired.where("v is not null").select("u", "v"), "vectors")
    sums = paired.where("links is not null").groupBy("u").agg(F.sum("links").alias("links"))
    known = nodes.join(sums, nodes["node"] == sums["u"], "left").join(parts.withColumnRenamed("node", "p"), F.col("node") == F.col("p"), "left")
    known = known.select("vec", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = lookup(rows, "vec", known, "n", found[1], "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"))
