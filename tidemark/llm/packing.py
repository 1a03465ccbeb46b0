"""Best-fit packing of documents into bins of fixed capacity, under conflicts.

A bin holds at most one document of a duplicate cluster and at most PER_SOURCE documents of a source.
Bins carry bitmaps: one of the clusters, and one of the sources for each place a source may take. Open
bins are kept in the order of their residual; for a document the search starts at the smallest residual
that fits and goes on to its successors until the tightest compatible bin is found, else a bin is opened.
Documents come longest first (ties by id, then start), so the result is that of best-fit decreasing.

Spans are dealt to shards of about SHARD_ROWS by a hash of id and span, so hot sources and clusters are
spread evenly, every shard fits in memory whatever the table's size, and shards pack independently; the tightest
bin is that of the shard. Texts are never shuffled to plan, only their lengths and keys.

Lengths are characters plus SEPARATOR for the end mark, or any integer column, such as the number of tokens
that sentencepiece_scan gives. A document longer than the capacity is cut into consecutive spans of full capacity,
each a bin of its own, and a rest that is packed; nothing is dropped or cut off. sequences() writes the bins out.

Edges: a null text counts as empty, with length SEPARATOR. A null source or cluster conflicts with
nothing. Repeated rows and null ids are packed like any others; equal texts are one cluster, so they
never share a bin. An empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import materialise
from tidemark.llm.exact_dedup import normalised
from tidemark.session import ship

CAPACITY = 8192
PER_SOURCE = 2
SEPARATOR = 1
SHARD_ROWS = 4096
#: Bins that a shard's numbers leave room for.
SHARD_BINS = 1 << 24

COLUMNS = ["doc_id", "span_start", "span_end", "bin_id", "bin_offset"]


def pack(lengths: list[int], sources: list, clusters: list, capacity: int, per_source: int = PER_SOURCE) -> list[tuple[int, int]]:
    """(bin, offset) of each item, items taken in the given order."""
    numbers: dict = {}
    cluster_bits = [0 if c is None else 1 << numbers.setdefault(("c", c), len(numbers)) for c in clusters]
    numbers = {}
    source_bits = [0 if s is None else 1 << numbers.setdefault(s, len(numbers)) for s in sources]
    open_bins: list[tuple[int, int]] = []
    has_cluster: list[int] = []
    #: For each bin one bitmap per place: bit s of place p is set when the bin holds more than p documents of source s.
    has_source: list[list[int]] = []
    out = []
    for length, cluster, source in zip(lengths, cluster_bits, source_bits):
        at = bisect_left(open_bins, (length, -1))
        while at < len(open_bins):
            b = open_bins[at][1]
            if not (has_cluster[b] & cluster or has_source[b][-1] & source):
                break
            at += 1
        if at < len(open_bins):
            residual, b = open_bins.pop(at)
        else:
            residual, b = capacity, len(has_cluster)
            has_cluster.append(0)
            has_source.append([0] * per_source)
        out.append((b, capacity - residual))
        has_cluster[b] |= cluster
        for place in range(per_source if source else 0):
            if not has_source[b][place] & source:
                has_source[b][place] |= source
                break
        if residual > length:
            insort(open_bins, (residual - length, b))
    return out


class _Packing:
    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            shard = batch.column(0).to_numpy()
            cuts = [0, *(np.nonzero(np.diff(shard))[0] + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:]) if len(shard) else ():
                if held and held[0].column(0)[0].as_py() != int(shard[a]):
                    yield self.shard(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield self.shard(held)

    def shard(self, pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(pieces).combine_chunks()
        start, end = rows.column("span_start").to_numpy(), rows.column("span_end").to_numpy()
        placed = pack((end - start).tolist(), rows.column("source").to_pylist(), rows.column("cluster").to_pylist(), self.capacity, self.per_source)
        bins = np.array([b for b, _ in placed], np.int64) + rows.column("shard").to_numpy() * SHARD_BINS
        return pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks(), pa.array(start), pa.array(end), pa.array(bins), pa.array([o for _, o in placed], pa.int64())], COLUMNS)


def best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length: Column | None = None, cluster: Column | None = None, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> DataFrame:
    """One row per span: doc_id, span_start, span_end, bin_id, bin_offset (units of length).

    `cluster` defaults to a hash of the text after lower-casing A-Z: exact copies.
    """
    ship(docs.sparkSession)
    length = F.char_length(F.coalesce(F.col(text_col), F.lit(""))) + SEPARATOR if length is None else length
    cluster = F.xxhash64(normalised(F.col(text_col))) if cluster is None else cluster
    items = docs.select(F.col(id_col).cast("long").alias("doc_id"), length.cast("long").alias("length"), F.col(source_col).cast("string").alias("source"), cluster.cast("long").alias("cluster"))
    items = materialise(items, "lengths")
    last = (F.greatest("length", F.lit(1)) - 1).cast("long")
    spans = items.agg(F.coalesce(F.sum(F.floor(last / capacity) + 1), F.lit(0))).first()[0]
    shards = max(1, -(-spans // SHARD_ROWS))
    items = items.withColumn("span_start", F.explode(F.sequence(F.lit(0).cast("long"), last - last % capacity, F.lit(capacity).cast("long"))))
    items = items.withColumn("span_end", F.least(F.col("span_start") + capacity, "length"))
    items = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "span_start", "cluster"), F.lit(shards).cast("long")))
    dealt = items.select("shard", "doc_id", "span_start", "span_end", "source", "cluster").repartition("shard")
    ordered = dealt.sortWithinPartitions("shard", (F.col("span_start") - F.col("span_end")), "doc_id", "span_start", "cluster")
    return ordered.mapInArrow(_Packing(capacity, per_source), "doc_id long, span_start long, span_end long, bin_id long, bin_offset long")


def sequences(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "\x03") -> DataFrame:
    """(bin_id, sequence, doc_ids): the text of each bin of a plan in characters, spans in order, `mark` where a document ends.

    Ids are expected to be unique and not null; a null text is empty. A span's text is a whole number of characters; a bin
    holds at most its capacity, so no group grows with the table.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.concat(F.coalesce(F.col(text_col), F.lit("")), F.lit(mark)).alias("text"))
    cut = plan.join(own, "doc_id").select("bin_id", F.struct("bin_offset", "doc_id", F.expr("substring(text, cast(span_start + 1 as int), cast(span_end - span_start as int))").alias("text")).alias("part"))
    bins = cut.groupBy("bin_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return bins.select("bin_id", F.array_join("parts.text", "").alias("sequence"), F.col("parts.doc_id").alias("doc_ids"))
