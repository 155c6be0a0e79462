"""Mixing sources to target weights: blocks of fixed length, drawn per output shard and joined by index."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import landed, shared_dir, sliced

WORD = r"[^\x20\x09-\x0D]+"
# Two hashes of a document: of its text with its id, so that copies under many ids are no hot key, and of its text.
TEXT = ["h1", "h2"]


@dataclass(frozen=True)
class Mix:
    """``weights`` go to the sources in code point order, over and over; null comes last.

    ``block`` is the length of a block in words, ``shard_blocks`` the mean number of blocks of an output
    shard, ``most`` how often a source may be repeated, ``buckets`` into how many parts the documents of
    a source are cut to number their words, ``seed`` what all draws depend on.
    """

    weights: tuple[float, ...] = (1, 2, 3)
    block: int = 256
    shard_blocks: int = 4096
    most: float = 3
    buckets: int = 512
    seed: int = 7


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """``target`` for each row of ``sizes`` (source, source_size), one row per source.

    The targets add up to all sizes and are shared by weight; a source over ``most`` times its size keeps
    that, and what is over is shared by weight among the others until none is above.  Sorted by the ratio
    of cap to weight, the capped sources are a prefix, which one running sum finds.
    """
    # Numbering and running sums are over sources, one short row each, not over documents.
    order = Window.orderBy(F.col("source").isNull(), "source")
    n = len(mix.weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(n)) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(mix.most))
    weighed = sizes.withColumn("weight", weight).withColumn("cap", cap)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    share = left / F.sum("weight").over(after)  # per unit of weight, if this and all later ones are uncapped
    marked = weighed.withColumn("share", share).withColumn("place", F.row_number().over(by_ratio)).withColumn(
        "open", F.col("share") * F.col("weight") <= F.col("cap"))
    first_open = F.min(F.when(F.col("open"), F.struct("place", "share"))).over(Window.partitionBy())
    shared = marked.withColumn("level", first_open["share"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return shared.select("source", "source_size", target.alias("target"))


def placed(docs: DataFrame, mix: Mix) -> DataFrame:
    """``docs`` (doc_id, source, size, h1, h2) with ``offset``: the words of the source in front of the document.

    The documents of a source come in an order that only depends on their ids and the seed.  The running sum is
    over buckets of that order first and then inside each bucket, so no source is gathered in one task.
    """
    spread = F.xxhash64(F.lit(mix.seed), "doc_id", "size")
    cut = docs.withColumn("spread", spread).withColumn("bucket", F.pmod(F.shiftrightunsigned("spread", 40), F.lit(mix.buckets)))
    sums = cut.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    in_front = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("source").alias("_source"), F.col("bucket").alias("_bucket"),
        F.coalesce(F.sum("in_bucket").over(in_front), F.lit(0)).alias("bucket_start"))
    # Two rows that agree in all of these are the same for the mix, whichever comes first.
    inside = Window.partitionBy("source", "bucket").orderBy("spread", "doc_id", "size", *TEXT).rowsBetween(Window.unboundedPreceding, -1)
    running = cut.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = running.join(starts, running["source"].eqNullSafe(starts["_source"]) & (running["bucket"] == starts["_bucket"]))
    return joined.withColumn("offset", F.col("bucket_start") + F.col("before")).drop(
        "spread", "bucket", "_source", "_bucket", "bucket_start", "before")


def scrambled(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A 64-bit mix of both."""
    with np.errstate(over="ignore"):
        z = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of each index in a pseudorandom permutation of 0 .. n-1, one permutation per key.

    Four Feistel rounds permute the numbers below the next power of four; who falls outside
    walks on along the cycle until it is inside.  Nothing is stored, so a source may have any number of blocks.
    """
    out = index.astype(np.uint64)
    half = np.maximum((np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2, 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(out))
    while len(todo):
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for r in range(4):
            left, right = right, left ^ (scrambled(right, k + np.uint64(r)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def slots(sources: DataFrame, mix: Mix) -> DataFrame:
    """The mix itself: one row per slot with ``shard``, ``source``, ``slot``, ``block`` and ``words``.

    Every source has as many slots as its target needs; each is dealt to one of the output shards by
    a seeded draw, so the counts of a source over the shards are multinomial and add up to its target.  A slot
    takes the block that the permutation of its round through the source names; only the last one takes
    fewer words than its block holds.
    """
    shards = F.greatest(F.lit(1), F.ceil(F.sum("target").over(Window.partitionBy()) / (mix.block * mix.shard_blocks)))
    blocks = F.ceil(F.col("source_size") / mix.block)
    wanted = F.round("target").cast("long")
    rounds = F.floor(wanted / F.col("source_size")).cast("long")
    rest = wanted - rounds * F.col("source_size")
    # Of the last round as many slots as may be needed when its short block comes early.
    upper = rounds * blocks + F.least(blocks, F.ceil(rest / mix.block) + F.when(rest > 0, 1).otherwise(0))
    spread = 1 << 13
    plan = sources.where("source_size > 0").select(
        "source", "source_size", shards.cast("long").alias("shards"), blocks.cast("long").alias("blocks"),
        rounds.alias("rounds"), rest.alias("rest"), upper.cast("long").alias("upper"))
    parts = plan.where("upper > 0").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("upper") - 1) / spread).cast("long"))))
    # A part is a run of slots of one source; a large source has many, dealt to all tasks.
    parts = parts.withColumn("key", F.xxhash64(F.lit(mix.seed), F.coalesce("source", F.lit("")), F.col("source").isNull()))
    # A part is a short row that makes many, so the number of tasks follows the parts and not their bytes.
    spark = sources.sparkSession
    total = sources.agg(F.sum("target")).first()[0] or 0
    tasks = int(total // (mix.block * spread)) + 1
    dealt = parts.repartition(min(tasks, 32 * spark.sparkContext.defaultParallelism), F.col("key"), F.col("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield part_slots(row, mix, spread)

    return dealt.mapInArrow(run, "shard long, source string, slot long, block long, words long")


def part_slots(row: dict, mix: Mix, spread: int) -> pa.RecordBatch:
    """The slots of one part."""
    lo, hi = row["part"] * spread, min((row["part"] + 1) * spread, row["upper"])
    slot = np.arange(lo, hi, dtype=np.int64)
    n = np.full(len(slot), row["blocks"], np.int64)
    turn, place = np.divmod(slot, row["blocks"])
    base = np.uint64(row["key"] & (2**64 - 1))
    key = scrambled(turn.astype(np.uint64), np.full(len(slot), base))
    block = permuted(place, n, key)
    short = row["source_size"] - (row["blocks"] - 1) * mix.block  # words of the last block
    full = np.where(block == row["blocks"] - 1, short, mix.block)
    # Words of the round in front of this slot: all blocks are full but the last one, if it came before.
    last_key = scrambled(np.array([row["rounds"]], np.uint64), np.array([base]))
    short_at = place_of(row["blocks"] - 1, row["blocks"], last_key)
    in_front = place * mix.block - (place > short_at) * (mix.block - short)
    words = np.where(turn < row["rounds"], full, np.clip(row["rest"] - in_front, 0, full))
    draw = scrambled(slot.astype(np.uint64), np.full(len(slot), base ^ np.uint64(0x5851F42D4C957F2D)))
    shard = (draw % np.uint64(row["shards"])).astype(np.int64)
    some = words > 0
    return pa.RecordBatch.from_arrays(
        [pa.array(shard[some]), pa.array([row["source"]] * int(some.sum()), pa.string()), pa.array(slot[some]), pa.array(block[some]),
         pa.array(words[some])], ["shard", "source", "slot", "block", "words"])


def place_of(block: int, n: int, key: np.ndarray) -> int:
    """The index that the permutation sends to ``block``: the Feistel rounds run backwards."""
    half = np.uint64(max((int(np.ceil(np.log2(max(n, 2)))) + 1) // 2, 1))
    mask = (np.uint64(1) << half) - np.uint64(1)
    x = np.array([block], np.uint64)
    while True:
        left, right = x >> half, x & mask
        for r in reversed(range(4)):
            left, right = right ^ (scrambled(left, key + np.uint64(r)) & mask), left
        x = (left << half) | right
        if int(x[0]) < n:
            return int(x[0])


def pieces(docs: DataFrame, mix: Mix) -> DataFrame:
    """The blocks' content: one row per document and block that it reaches into, with the word range of the block."""
    end = F.col("offset") + F.col("size") - 1
    first = F.floor(F.col("offset") / mix.block).cast("long")
    last = F.floor(end / mix.block).cast("long")
    each = docs.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    each = each.withColumn("block_start", F.col("block") * mix.block)
    block_start = F.col("block_start")
    return each.withColumn("from_word", F.greatest(F.col("offset"), block_start) - block_start).withColumn(
        "to_word", F.least(F.col("offset") + F.col("size"), block_start + mix.block) - block_start)


@dataclass(frozen=True)
class Mixture:
    """``documents`` with size, offset and target; ``slots`` of the output shards; ``pieces`` of the blocks; ``texts``
    once each, by two hashes that documents and pieces have too.

    A shard's text is its slots, each joined to the pieces of its block (source, block), cut to ``words``;
    ``write_shards`` writes it.
    """

    documents: DataFrame
    slots: DataFrame
    pieces: DataFrame
    texts: DataFrame


def word_count(text: Column) -> Column:
    """Words between the six ASCII blanks; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mixture(docs: DataFrame, mix: Mix = Mix(), doc_id: str = "doc_id", source: str = "source", text: str = "text") -> Mixture:
    """Plan the mix of all documents; their texts are found again by hash.

    Sizes are words; a null source is a source of its own and comes last; documents without words take no part;
    repeated rows count as documents of their own; an empty table gives an empty mix; other columns are left out.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    hashed = docs.withColumn("h1", F.xxhash64(body, F.col(doc_id))).withColumn("h2", F.hash(body, F.length(body)))
    sized = hashed.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), *TEXT)
    sized = landed(sized, "sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sums, mix)
    numbered = placed(sized, mix)
    right = goals.select(F.col("source").alias("_source"), "source_size", "target")
    documents = numbered.join(right, numbered["source"].eqNullSafe(right["_source"])).drop("_source")
    documents = landed(documents, "placed")
    texts = compressed(hashed.select(*TEXT, body.cast("binary").alias("text"))).dropDuplicates(TEXT)
    return Mixture(documents, slots(goals, mix), pieces(documents, mix), texts)


_BLANK = np.isin(np.arange(256), (0x20, 9, 10, 11, 12, 13))


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words between the six ASCII blanks start and end."""
    edges = np.diff(np.r_[True, _BLANK[np.frombuffer(text, np.uint8)], True].astype(np.int8))
    return np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)


def compressed(rows: DataFrame, back: bool = False) -> DataFrame:
    """``rows`` with the bytes in ``text`` compressed for the way through a shuffle, or as they were again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = zstandard.ZstdDecompressor().decompress if back else zstandard.ZstdCompressor(level=5).compress
        for batch in batches:
            for part in sliced([batch], "text"):
                at = part.schema.get_field_index("text")
                made = [one(t) for t in part.column(at).to_pylist()]
                yield part.set_column(at, "text", pa.array(made, pa.binary()))

    return rows.mapInArrow(run, rows.schema)


def write_shards(mixed: Mixture, path: str) -> DataFrame:
    """The mix as Parquet below ``path``, a folder per shard, and read back.

    A row is what a slot takes of one document: source, slot, block, the document by doc_id, size and
    offset, and its words in ``text`` with the blanks between them as they were.  The slots of a shard stand in a
    seeded order, so its sources are mixed.  Slots and pieces are joined as numbers; a text moves
    once to its cuts and once to its shards, compressed both times.
    """
    # Both sides grow with the documents; the estimated size of a small file is no reason to broadcast one.
    left, right = mixed.pieces.hint("merge"), mixed.slots.withColumnRenamed("source", "_source").withColumnRenamed("block", "_block")
    hit = left.join(right, left["source"].eqNullSafe(right["_source"]) & (left["block"] == right["_block"])).where("words > from_word")
    start = F.col("block_start") + F.col("from_word") - F.col("offset")
    cut = F.struct("shard", "slot", "block", "from_word", start.alias("start"), (F.least("to_word", "words") - F.col("from_word")).alias("n"))
    key = ["doc_id", "source", "size", "offset"]
    cuts = hit.groupBy(*TEXT, *key).agg(F.collect_list(cut).alias("cuts"))
    found = cuts.join(mixed.texts.hint("merge"), TEXT).select(*key, "cuts", "text")
    ints = ["shard", "slot", "block", "from_word"]
    schema = StructType([found.schema[k] for k in key] + StructType.fromDDL("slot long, block long, from_word long, text binary, shard long").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(level=5).compress, zstandard.ZstdDecompressor().decompress
        for batch in sliced(batches, "text", 2 << 20):
            column = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            owner: list[int] = []
            made: dict[str, list] = {n: [] for n in [*ints, "text"]}
            for k, (text, wanted) in enumerate(zip(column["text"].to_pylist(), column["cuts"].to_pylist())):
                text = unpack(text)
                first, last = word_bounds(text)
                for c in wanted:
                    owner.append(k)
                    made["text"].append(pack(text[first[c["start"]]:last[c["start"] + c["n"] - 1]]))
                    for n in ints:
                        made[n].append(c[n])
            out = {n: column[n].take(pa.array(owner, pa.int64())) for n in key}
            out |= {n: pa.array(v, pa.binary() if n == "text" else pa.int64()) for n, v in made.items()}
            yield pa.RecordBatch.from_arrays([out[n] for n in schema.names], schema.names)

    rows = compressed(found.mapInArrow(run, schema).repartition("shard"), back=True).withColumn("text", F.col("text").cast("string"))
    ordered = rows.sortWithinPartitions("shard", F.xxhash64("source", "slot"), "source", "slot", "from_word")
    ordered.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return mixed.documents.sparkSession.read.schema(rows.schema).parquet(path)


def taken(mixed: Mixture, path: str | None = None) -> DataFrame:
    """``documents`` with ``taken``: the words of each in the shards, repeats counted.

    The shards are written below ``path``, or in a new folder of the shared one, and their texts are counted.
    """
    spark = mixed.documents.sparkSession
    rows = write_shards(mixed, path or f"{shared_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}")
    key = ["doc_id", "size", "offset", "source"]
    sums = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.sum(word_count(F.col("text"))).alias("taken"))
    docs = mixed.documents
    same = [docs[k].eqNullSafe(sums[f"_{k}"]) for k in key]
    joined = docs.join(sums, same, "left")
    return joined.select("doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
