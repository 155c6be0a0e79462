"""SimHash near-duplicates, found through an inverted index of bytes at their positions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import free_names, landed, sliced, texts_of, word_runs
from .components import roots

SHINGLE = 4
MAX_BITS = 4
SEED = 42
BYTES = 8
# Buckets up to this size are compared place by place; larger ones are searched from member to member.
SMALL = 8
# A bucket with more distinct fingerprints is cut by one more byte.
LARGE = 20_000
# Rows of complete buckets that are compared at once.
ROWS = 200_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit by bit the majority of the XXH64 values of all word shingles, repeats included; 0 without words.

    A-Z are lowered; fewer words than ``shingle`` make one shingle.  A text of any length is read in runs.
    """
    ones, total = np.zeros(64, np.int64), 0
    carried: list[bytes] = []
    for words in word_runs(text.lower()):
        words = carried + words
        if len(words) < shingle:
            carried = words
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        joined = b" ".join(words)
        starts = np.r_[0, ends[:len(words) - shingle] + 1]
        digest, step = xxhash.xxh64_intdigest, 1 << 16
        for at in range(0, len(starts), step):
            cuts = zip(starts[at:at + step].tolist(), ends[at + shingle - 1:at + shingle - 1 + step].tolist())
            values = np.fromiter((digest(joined[a:b], SEED) for a, b in cuts), np.uint64)
            ones += np.unpackbits(values.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
            total += len(values)
        carried = words[len(words) - shingle + 1:] if shingle > 1 else []
    if not total:
        if not carried:
            return 0
        return xxhash.xxh64_intdigest(b" ".join(carried), SEED)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without ``text``, plus ``fp``: the 64 bits of every whole text as a signed long."""
    kept = [f for f in docs.schema.fields if f.name not in (text, "fp")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            column = batch.column(batch.schema.get_field_index(text))
            made = np.array([fingerprint(t, shingle) for t in texts_of(column)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(n)) for n in names] + [pa.array(made)], names + ["fp"])

    schema = StructType(kept + StructType.fromDDL("fp long").fields)
    return docs.select(*[f"`{n}`" for n in names], f"`{text}`").mapInArrow(run, schema)


def covering(at_least: int, size: int) -> list[tuple[int, ...]]:
    """Sets of ``size`` byte positions such that any ``at_least`` positions contain one of them.

    For triples among any four of the eight positions: three groups in a ring; a triple lies in one
    group or has two positions in a group and one in the next (20 of the 56).
    """
    if (at_least, size) != (4, 3):
        return list(combinations(range(BYTES), size))
    ring = [(0, 1, 2), (3, 4, 5), (6, 7)]
    inside = [t for g in ring for t in combinations(g, 3)]
    across = [tuple(sorted((*two, one))) for k, g in enumerate(ring) for two in combinations(g, 2) for one in ring[(k + 1) % 3]]
    return inside + across


def byte_at(position: int):
    return F.shiftrightunsigned("fp", 8 * position).bitwiseAND(F.lit(255))


def posted(fps: DataFrame, max_bits: int) -> tuple[DataFrame, int]:
    """The index: ``key`` (positions and their bytes) and ``fp``; and how many equal bytes are guaranteed.

    ``max_bits`` differing bits leave at least ``8 - max_bits`` bytes equal.  Lists of single bytes would
    be a 256th of the table long, so they are posted already intersected, three (or as many as are guaranteed) at a time.
    """
    guaranteed = BYTES - max_bits
    size = min(3, guaranteed)
    sets = covering(guaranteed, size)
    key = []
    for number, positions in enumerate(sets):
        packed = F.lit(number).cast("long")
        for p in positions:
            packed = F.shiftleft(packed, 8).bitwiseOR(byte_at(p))
        key.append(packed)
    keyed = fps.select("fp", F.explode(F.array(*key)).alias("key"))
    # Members of a large bucket that may be linked share one more byte: the bucket is cut by position and byte.
    if guaranteed > size:
        large = keyed.groupBy("key").count().where(F.col("count") > LARGE).select("key", F.lit(True).alias("large"))
        marked = keyed.join(large.hint("rebalance"), "key", "left")
        rest = F.array(*[F.array(*[F.lit(p) for p in range(BYTES) if p not in s]) for s in sets])
        number = F.shiftright("key", 8 * size).cast("int")
        finer = F.transform(
            F.get(rest, number),
            lambda p: F.shiftleft(F.col("key"), 12).bitwiseOR(F.shiftleft(p, 8)).bitwiseOR(
                F.call_function("shiftrightunsigned", F.col("fp"), p * 8).bitwiseAND(F.lit(255))).bitwiseOR(F.lit(1 << 62)))
        keyed = marked.select("fp", F.explode(F.when(F.col("large"), finer).otherwise(F.array("key"))).alias("key"))
    return keyed, guaranteed


def linked(x: np.ndarray, max_bits: int, guaranteed: int) -> np.ndarray:
    """Which differences pass: first the tally of equal bytes, then the bits."""
    tally = (x[:, None].view(np.uint8) == 0).sum(axis=1)
    good = tally >= guaranteed
    good[good] = np.bitwise_count(x[good]) <= max_bits
    return good


def spanning(members: np.ndarray, max_bits: int, guaranteed: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect what is connected in a bucket, at most one per member.

    From a root the members are visited; each is compared with those not reached yet.  By the
    triangle inequality only those no further from the root than the member and ``max_bits`` more can be near it.
    """
    ones: list[np.ndarray] = []
    others: list[np.ndarray] = []
    left = members
    while len(left) > 1:
        root, left = left[0], left[1:]
        away = np.bitwise_count(left ^ root)
        order = np.argsort(away, kind="stable")
        left, away = left[order], away[order]
        queue = [root]
        while queue and len(left):
            member = queue.pop()
            reach = np.searchsorted(away, int(np.bitwise_count(member ^ root)) + max_bits, "right")
            near = np.zeros(len(left), bool)
            near[:reach] = linked(left[:reach] ^ member, max_bits, guaranteed)
            got = left[near]
            if len(got):
                ones.append(np.full(len(got), member))
                others.append(got)
                left, away = left[~near], away[~near]
                queue.extend(got)
    return ones, others


def bucket_links(key: np.ndarray, fp: np.ndarray, max_bits: int, guaranteed: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside complete buckets; rows are sorted by key."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    ones, others = [], []
    small = np.repeat(sizes <= SMALL, sizes)
    for lag in range(1, min(SMALL, len(key))):
        at = np.flatnonzero((key[lag:] == key[:-lag]) & small[lag:])
        a, b = fp[at], fp[at + lag]
        good = linked(a ^ b, max_bits, guaranteed)
        ones.append(a[good])
        others.append(b[good])
    for k in np.flatnonzero(sizes > SMALL):
        more = spanning(fp[starts[k]:starts[k] + sizes[k]], max_bits, guaranteed)
        ones += more[0]
        others += more[1]
    none = np.zeros(0, np.uint64)
    return np.concatenate(ones or [none]), np.concatenate(others or [none])


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links ``u``, ``v`` between distinct fingerprints that connect all within ``max_bits`` bits."""
    if not 0 < max_bits < BYTES:
        raise ValueError("byte counting needs 1 to 7 differing bits")
    keyed, guaranteed = posted(fps, max_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        values: list[np.ndarray] = []
        held = 0

        def settle(all_of_it: bool):
            nonlocal keys, values, held
            key, fp = np.concatenate(keys), np.concatenate(values)
            cut = len(key) if all_of_it else int(np.searchsorted(key, key[-1]))
            u, v = bucket_links(key[:cut], fp[:cut], max_bits, guaranteed)
            keys, values, held = [key[cut:]], [fp[cut:]], len(key) - cut
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        least = ROWS
        for batch in batches:
            keys.append(np.asarray(batch.column(0), dtype=np.int64))
            values.append(np.asarray(batch.column(1), dtype=np.int64).view(np.uint64))
            held += batch.num_rows
            if held >= least:
                yield settle(False)
                least = ROWS + 2 * held  # an unfinished large bucket is not joined up again at every batch
        if held:
            yield settle(True)

    dealt = keyed.select("key", "fp").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``h`` (XXH64 of the text), ``fp``, ``component_id``, the least id it is
    linked with, and ``root``, which names its component also where ids repeat.

    Equal fingerprints are one class, so copies cost one row of the index, however many there are; a text
    that is null, empty or without words has fingerprint zero and is linked like any other.  A null id is
    never the least, unless there is no other.  Repeated rows stay; an empty table gives no rows; other columns are left out.
    """
    body = F.col(f"`{text}`")
    read = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("h"), body.alias("text"))
    marked = landed(fingerprints(read, "text", shingle), "fingerprints")
    classes = landed(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    tree = roots(links(classes.select("fp"), max_bits))
    in_tree = classes.join(tree.withColumnRenamed("u", "fp").withColumnRenamed("v", "root"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    in_tree = landed(in_tree, "classes")
    least = in_tree.groupBy("root").agg(F.min("least").alias("component_id")).hint("rebalance")
    named = in_tree.select("fp", "root").join(least, "root").hint("rebalance")
    return marked.join(named, "fp").select("doc_id", "h", "fp", "component_id", "root")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component does: that of the least id, then hash.

    Rows equal in id and text are one document, and one of them stays.
    """
    found = near_duplicates(docs, doc_id, text, shingle, max_bits)
    first = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "h")
    stay, stay_h, own_h = free_names(docs, "_doc", "_h", "_own")
    kept = found.groupBy("root").agg(F.min(first).alias("one")).select(
        F.col("one.doc_id").alias(stay), F.col("one.h").alias(stay_h)).hint("rebalance")
    hashed = docs.withColumn(own_h, F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    same = hashed[f"`{doc_id}`"].eqNullSafe(kept[stay]) & (hashed[own_h] == kept[stay_h])
    return hashed.join(kept, same, "left_semi").dropDuplicates([doc_id, own_h]).select(*[f"`{c}`" for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
