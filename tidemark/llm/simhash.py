"""SimHash near-dedup with pigeonring filtering.

A fingerprint has 64 bits over the XXH64 (seed 42) of the 3-word shingles of the text, A-Z
lower-cased. Two fingerprints link at MOST_BITS = 3 differing bits or fewer.

Candidates: the bits form a ring of 4 segments of 16 bits. Of two linked fingerprints some chain of
consecutive segments stays within the proportional budgets 3/4, 6/4, 9/4 and 12/4, that is 0, 1, 2
and 3 differing bits in its first 1, 2, 3 and 4 segments. A fingerprint is therefore filed, for each
of the 4 starts, under its first segment and, as at most one bit of the second differs, under each
choice of 3 of that segment's 4 nibbles: 16 keys of 28 bits. Inside a key the chain is checked to its
third segment before the full Hamming check.

Only distinct fingerprints are filed. A key's fingerprints are explored breadth first from unvisited
ones, so a group of n yields at most n - 1 links, never all pairs; one of more than SPLIT_AT is first parted four
ways, each of its fingerprints then lies in four groups and gives at most as many times n - 1. The links'
components over all keys are those of the full link graph.

Edges: a null or empty text, or one of white space, has fingerprint zero and links like any other.
With fewer than 3 words the whole sequence is one shingle. Rows with a null id get a fingerprint and
the smallest non-null id of their component, null if there is none. Repeated rows stay repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import connected_components, lookup, materialise
from tidemark.session import ship

SEED = 42
WORDS = 3
MOST_BITS = 3
STARTS, WIDTH, NIBBLES = 4, 16, 4
TABLES = STARTS * NIBBLES
#: Shingles hashed and summed at a time, which bounds memory for texts of any length.
BLOCK = 1 << 15
#: Fingerprints of one key that are explored as one block before it is split further.
SPLIT_AT = 4096


def fingerprint(text: bytes | None) -> int:
    """The fingerprint of UTF-8 bytes as an unsigned integer. bytes.lower and bytes.split are ASCII only."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    n = len(words) - WORDS + 1
    if n <= 1:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[:n].tolist()
    stops = (ends[WORDS - 1 :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK])], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.nonzero(2 * ones > n)[0].tolist()))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()) if pa.types.is_string(batch.column(1).type) else batch.column(1).cast(pa.large_binary())
        values = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per row of `docs`; fp is the fingerprint as a signed long."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """TABLES rows (key, fp) for each fingerprint; bits 28 to 31 of a key tell its table."""
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for start in range(STARTS):
            turned = _turned(fp, start)
            first, second = turned & np.uint64(0xFFFF), (turned >> np.uint64(WIDTH)) & np.uint64(0xFFFF)
            for gone in range(NIBBLES):
                low = second & np.uint64((1 << 4 * gone) - 1)
                rest = (second >> np.uint64(4 * gone + 4)) << np.uint64(4 * gone) | low
                key = np.uint64((start * NIBBLES + gone) << 28) | first << np.uint64(12) | rest
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64))], ["key", "fp"])


def _turned(fp: np.ndarray, start: int) -> np.ndarray:
    by = WIDTH * start
    return fp if not by else fp >> np.uint64(by) | fp << np.uint64(64 - by)


def _near(one: np.uint64, others: np.ndarray, start: int) -> np.ndarray:
    """Mask of `others` linked to `one` whose chain from `start` keeps its budgets (cumulative bits 0, 1, 2, 3)."""
    x = _turned(others ^ one, start)
    chain = np.bitwise_count(x & np.uint64(0xFFFFFFFF)) <= 1
    chain &= np.bitwise_count(x & np.uint64(0xFFFFFFFFFFFF)) <= 2
    out = np.zeros(len(others), bool)
    out[chain] = np.bitwise_count(x[chain]) <= MOST_BITS
    return out


def _forest(fps: np.ndarray, start: int, free: tuple[int, ...] = (0, 4, 8, 12, 16, 20, 24, 28, 32, 36, 40, 44, 48, 52, 56, 60)) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (u, v) that span the components of `fps`, distinct fingerprints of one key.

    More than SPLIT_AT are first parted, four ways in turn, by a quarter of the nibbles not yet
    compared: of at most 3 differing bits one quarter has none, so every linked pair meets again.
    """
    if len(fps) > SPLIT_AT and len(free) >= 4:
        size, out = len(free) // 4, []
        for q in range(4):
            own = free[q * size : (q + 1) * size] if q < 3 else free[3 * size :]
            mask = np.uint64(sum(15 << b for b in own))
            part = fps & mask
            order = np.argsort(part, kind="stable")
            cuts = np.nonzero(np.diff(part[order]))[0] + 1
            left = tuple(b for b in free if b not in own)
            for group in np.split(fps[order], cuts):
                if len(group) > 1:
                    out += _forest(group, start, left)
        return out
    out, waiting = [], fps
    while len(waiting) > 1:
        queue, waiting = [waiting[0]], waiting[1:]
        while queue and len(waiting):
            one = queue.pop()
            near = _near(one, waiting, start)
            if near.any():
                found = waiting[near]
                out.append((np.full(len(found), one), found))
                queue.extend(found)
                waiting = waiting[~near]
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each key's fingerprints; rows come sorted by key, and a key's rows may span batches."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        key, fp = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if len(key) == 0:
            continue
        last = np.searchsorted(key, key[-1])
        if held and held[-1][0][-1] == key[-1]:
            # All of one key: kept as they are until it ends.
            held.append((key, fp))
            continue
        held.append((key[:last], fp[:last]))
        yield from _linked(*map(np.concatenate, zip(*held)))
        held = [(key[last:], fp[last:])]
    if held:
        yield from _linked(*map(np.concatenate, zip(*held)))


def _linked(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(key) < 2:
        return
    edge = np.nonzero(np.diff(key))[0] + 1
    first, size = np.concatenate([[0], edge]), np.diff(np.concatenate([[0], edge, [len(key)]]))
    us, vs = [], []
    two = first[size == 2]
    if len(two):
        start = (key[two] >> 28) // NIBBLES
        for s in range(STARTS):
            a, b = fp[two[start == s]], fp[two[start == s] + 1]
            near = np.bitwise_count(a ^ b) <= MOST_BITS
            us.append(a[near])
            vs.append(b[near])
    for at, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
        for u, v in _forest(fp[at : at + n], int(key[at] >> 28) // NIBBLES):
            us.append(u)
            vs.append(v)
    if us:
        u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def links(distinct: DataFrame) -> DataFrame:
    """Spanning links (u, v) between the distinct fingerprints of a column fp."""
    ship(distinct.sparkSession)
    filed = distinct.select("fp").mapInArrow(_filed, "key long, fp long")
    return filed.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "u long, v long").distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, fp, component_id (smallest doc_id reachable by links)."""
    prints = materialise(fingerprints(docs, id_col, text_col), "fp")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "fps")
    total = distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    nodes = connected_components(links(distinct), "simhash")
    joined = distinct.join(nodes, distinct["fp"] == nodes["node"], "left").select("fp", "low", "n", F.coalesce("component", "fp").alias("component"))
    lows = joined.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("fps"))
    named = materialise(lookup(joined.select("fp", "n", "component"), "component", lows, "fps", total, "fp").select("fp", "n", "component_id"), "named")
    return lookup(prints, "fp", named, "n", total, "doc_id").select("doc_id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose id is the smallest of their component, all columns. Rows with a null id stay."""
    gone = near_dedup(docs, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone"), F.lit(0).cast("long").alias("_zero")).distinct()
    # Rows without an id match nothing; dealt by their text they do not meet in one task.
    spread = F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.lit(0).cast("long"))
    return docs.join(gone, (docs[id_col] == gone["_gone"]) & (spread == gone["_zero"]), "left_anti")
