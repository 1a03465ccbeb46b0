"""Exact dedup by two-pass Bloom filtering, with DataFrame functions only.

Pass 1 counts a 60-bit hash of every normalised text, eight bytes a row and folded before they are dealt
out; hashes seen twice or more are put into a Bloom filter. Its bits lie in blocks of 32,768, both PROBES of a
hash in one block, so a row finds them by one look-up. Pass 2 tests each row: a row with an unset bit is the
only one of its text and passes straight through; the others, possibly repeated, are shuffled by their full
SHA-256 and settled exactly. A false hit lets a single row into the shuffle, nothing lets a repeated one past it.

The filter has BITS_EACH bits for each repeated hash. As it is broadcast, it is bounded by MOST_BITS: a larger
one is cut into slices by hash, keys are written by slice, and each slice meets its own part of the filter, so
that it holds as well for 10^9 repeated hashes as for 10.

Edges: a null text counts as empty. Texts are equal when identical after lower-casing A-Z only. The
largest id stays; null ids sort lowest. Rows that share id and text are repeated rows: one of them
is kept. An empty table gives an empty result. Columns beside id and text are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import lookup, materialise, release

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PROBES = 2
BLOCK = 1 << 15
BITS_EACH = 16
#: Bits of the filter, or of one slice of it, that are broadcast at most: 64 MB.
MOST_BITS = 1 << 29
#: Slices of a filter at most; each is a branch of the plan, and more would be slow to plan.
MOST_SLICES = 256


def normalised(text: Column) -> Column:
    """Null as empty, A-Z lower-cased. For pure ASCII lower() does that and is faster."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    sha = F.sha2(normalised(F.col(text_col)).cast("binary"), 256)
    return docs.select(F.col(id_col).alias("doc_id"), sha.alias("sha"))


def _hash(sha: Column) -> Column:
    """The first 60 bits of a digest."""
    return F.conv(F.substring(sha, 1, 15), 16, 10).cast("long")


class Filter:
    """The Bloom filter of repeated hashes: (block, bitmap), and how many blocks and slices it has."""

    def __init__(self, keys: DataFrame, most_bits: int):
        repeated = keys.groupBy(_hash(F.col("sha")).alias("h")).agg(F.count("*").alias("n")).where("n > 1").select("h")
        repeated = materialise(repeated, "repeated")
        blocks = max(1, -(-repeated.count() * BITS_EACH // BLOCK))
        self.slices = min(MOST_SLICES, -(-blocks * BLOCK // most_bits))
        self.blocks = -(-blocks // self.slices) * self.slices
        bits = repeated.select(self.block(F.col("h")).alias("block"), F.explode(F.array(*self.places(F.col("h")))).alias("place"))
        self.bitmaps = materialise(bits.groupBy("block").agg(F.bitmap_construct_agg("place").alias("bitmap")), "bloom")
        release(repeated)

    def block(self, h: Column) -> Column:
        return (h.bitwiseAND(F.lit((1 << 30) - 1)) % self.blocks).cast("int")

    def slice(self, h: Column) -> Column:
        return (self.block(h) % self.slices).cast("int")

    def places(self, h: Column) -> list[Column]:
        """The bits of a hash in its block."""
        return [F.shiftright(h, 30 + 15 * i).bitwiseAND(F.lit(BLOCK - 1)) for i in range(PROBES)]

    def tested(self, rows: DataFrame) -> DataFrame:
        """Adds `maybe` to rows with a column sha: all bits of the row's hash are set. Rows stay where they are.

        With more than one slice, rows come with a column `slice` by which they have been written.
        """
        out = None
        for k in range(self.slices):
            side = self.bitmaps if self.slices == 1 else self.bitmaps.where(F.col("block") % self.slices == k)
            part = (rows if self.slices == 1 else rows.where(F.col("slice") == k)).withColumn("_h", _hash(F.col("sha")))
            part = part.withColumn("_block", self.block(F.col("_h"))).join(F.broadcast(side.select(F.col("block").alias("_block"), F.col("bitmap").alias("_bits"))), "_block", "left")
            flag = F.lit(True)
            for i, place in enumerate(self.places(F.col("_h"))):
                part = part.withColumn(f"_p{i}", place.cast("int"))
                flag = flag & F.expr(f"coalesce(shiftright(cast(conv(hex(substring(_bits, _p{i} div 8 + 1, 1)), 16, 10) as int), _p{i} % 8) & 1, 0) = 1")
            part = part.withColumn("maybe", flag).drop("_h", "_block", "_bits", *[f"_p{i}" for i in range(PROBES)])
            out = part if out is None else out.unionByName(part)
        return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = materialise(keyed(docs, id_col, text_col), "sha")
    total = keys.count()
    bloom = Filter(keys, most_bits)
    if bloom.slices > 1:
        keys = materialise(keys.withColumn("slice", bloom.slice(_hash(F.col("sha")))), "slices", ("slice",))
    flagged = bloom.tested(keys)
    single = flagged.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    # Counts by text and id first: within a partition copies fold before they are dealt out, and a text with many copies is settled from sums.
    ids = flagged.where("maybe").groupBy("sha", "doc_id").agg(F.count("*").alias("c"))
    ids = materialise(ids, "ids")
    groups = ids.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.sum("c").alias("group_size"), F.count("*").alias("n_ids"))
    settled = lookup(ids, "sha", groups, "n_ids", total, "doc_id")
    repeated = settled.select("doc_id", "keep_id", "group_size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))).alias("i"), "sha")
    repeated = repeated.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))
    return single.unionByName(repeated)


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of `docs` that stay, all columns. Only possibly repeated rows are shuffled, with their texts.

    Of repeated rows (same id and text) one stays; which one is not defined where other columns differ.
    """
    keys = materialise(keyed(docs, id_col, text_col), "sha")
    bloom = Filter(keys, most_bits)
    sha = F.sha2(normalised(F.col(text_col)).cast("binary"), 256)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), sha.alias("sha"))
    if bloom.slices > 1:
        keys = materialise(keys.withColumn("slice", bloom.slice(_hash(F.col("sha")))), "slices", ("slice",))
        packed = materialise(packed.withColumn("slice", bloom.slice(_hash(F.col("sha")))), "rows", ("slice",))
    best = bloom.tested(keys).where("maybe").groupBy("sha").agg(F.max("doc_id").alias("best_id"))
    flagged = bloom.tested(packed)
    single = flagged.where("not maybe").select("row")
    # Repeated rows fold first, those without an id among them. Keyed by text and id, a text with any number of copies
    # spreads over its ids; one id of each text survives the join, for which it is written: rows must not take over the partitioning by text alone.
    best = materialise(best.withColumnRenamed("sha", "best_sha"), "best")
    one = flagged.where("maybe").groupBy("sha", "id").agg(F.first("row").alias("row"))
    stays = one.join(best, (F.col("sha") == F.col("best_sha")) & F.col("id").eqNullSafe(F.col("best_id")), "left_semi").select("row")
    return single.unionByName(stays).select("row.*")
