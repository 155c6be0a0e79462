"""Totals of 64-bit keys over a whole corpus, looked up again by the batches of rows that hold the keys.

A corpus is landed as batches, each one row with an Arrow table in it.  Every batch asks for its distinct keys, with how
often it holds each; the keys are dealt by their leading bits, so that a part is a bounded share of all keys and a
key has at most one entry per batch, however often it occurs; the totals go back to the batches in the same order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import landed, sliced

PART_KEYS = 1 << 20
TEXT_BYTES = 3 << 20
ASKED = "part int, batch long, keys binary, counts binary"
FOUND = "batch long, part int, totals binary, own binary"


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all()


def planes(values: np.ndarray) -> bytes:
    """The bytes of 64-bit numbers, first all lowest ones, and so on: small numbers leave planes of zeros to compress."""
    return pa.compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def from_planes(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view("<u8").reshape(-1)


def counted(n: int, data: bytes) -> bytes:
    return n.to_bytes(8, "little") + data


def numbers(data: bytes) -> np.ndarray:
    return from_planes(data[8:], int.from_bytes(data[:8], "little"))


def batches_of(rows: DataFrame, purpose: str, text: str = "text", size: int | None = None) -> DataFrame:
    """``rows`` landed as ``batch`` and ``data``, each about ``size`` bytes of ``text``; a longer text is one of its own."""
    size = size or TEXT_BYTES

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        total = 0
        for part in parts:
            for piece in sliced([part], text, size):
                if held and total + piece.nbytes > size:
                    yield row(held)
                    held, total = [], 0
                held.append(piece)
                total += piece.nbytes
        if held:
            yield row(held)

    def row(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([packed(pa.Table.from_batches(held))], pa.binary())], ["data"])

    made = rows.mapInArrow(run, "data binary").withColumn("batch", F.monotonically_increasing_id())
    return landed(made.select("batch", "data"), purpose)


def parts_for(keys: int) -> int:
    """How many parts that many keys are dealt to, a power of two."""
    return 1 << max(3, int(np.ceil(np.log2(max(keys / PART_KEYS, 1)))))


def grouped(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[dict]]:
    """The rows of each value of ``column``, which stand together."""
    held: list[dict] = []
    for batch in batches:
        for k in range(batch.num_rows):
            row = {n: batch.column(j)[k].as_py() for j, n in enumerate(batch.schema.names)}
            if held and row[column] != held[0][column]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def requests(data: bytes, ask: Callable, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct keys of a batch, their counts, and where each part begins."""
    keys, counts, _ = ask(unpacked(data))
    bounds = np.arange(1, parts, dtype=np.uint64) << np.uint64(64 - int(np.log2(parts)))
    return keys, counts, np.r_[0, np.searchsorted(keys, bounds), len(keys)]


def settled(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    """Totals of the keys of one part, for each batch that asked; a key is its first batch's own."""
    keys = [np.cumsum(numbers(r["keys"]), dtype=np.uint64) for r in rows]
    every = np.concatenate(keys)
    counts = np.concatenate([numbers(r["counts"]) for r in rows])
    order = np.argsort(every, kind="stable")
    sorted_keys = every[order]
    first = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    sums = np.add.reduceat(counts[order], first)
    totals, own = np.empty(len(every), np.uint64), np.zeros(len(every), bool)
    totals[order] = np.repeat(sums, np.diff(np.r_[first, len(every)]))
    own[order[first]] = True
    at = 0
    for row, k in zip(rows, keys):
        t, o = totals[at:at + len(k)], own[at:at + len(k)]
        at += len(k)
        yield pa.RecordBatch.from_arrays(
            [pa.array([row["batch"]], pa.int64()), pa.array([row["part"]], pa.int32()),
             pa.array([counted(len(t), planes(t))], pa.binary()), pa.array([np.packbits(o).tobytes()], pa.binary())],
            ["batch", "part", "totals", "own"])


def with_totals(batches: DataFrame, ask: Callable, use: Callable, schema, keys: int, n_batches: int) -> DataFrame:
    """What ``use(table, memo, totals, own, batch)`` makes of every batch, with the totals of the keys it asked for.

    ``ask(table)`` gives the sorted distinct keys of a batch, how often it holds each, and what it worked out on the way,
    ``memo``; ``keys`` is about how many there are in all batches.  ``own`` marks the keys for which this batch is the first one.
    """
    parts = parts_for(keys)

    def asking(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            for k in range(row.num_rows):
                wanted, counts, cuts = requests(row.column(1)[k].as_py(), ask, parts)
                number = row.column(0)[k].as_py()
                made: list[list] = [[], [], [], []]
                for part, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                    if a < b:
                        steps = np.diff(np.r_[np.uint64(0), wanted[a:b]])
                        for column, value in zip(made, (part, number, counted(b - a, planes(steps)), counted(b - a, planes(counts[a:b])))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(made[0], pa.int32()), pa.array(made[1], pa.int64()), pa.array(made[2], pa.binary()), pa.array(made[3], pa.binary())],
                    ["part", "batch", "keys", "counts"])

    def settling(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(rows, "part"):
            yield from settled(group)

    def using(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(rows, "batch"):
            table = unpacked(group[0]["data"])
            _, _, memo = ask(table)
            answers = group[1:]
            totals = np.concatenate([numbers(r["totals"]) for r in answers] or [np.zeros(0, np.uint64)])
            own = [np.unpackbits(np.frombuffer(r["own"], np.uint8), count=int.from_bytes(r["totals"][:8], "little")) for r in answers]
            yield from use(table, memo, totals, np.concatenate(own or [np.zeros(0, np.uint8)]).astype(bool), group[0]["batch"])

    asked = batches.select("batch", "data").mapInArrow(asking, ASKED)
    found = asked.repartition(parts, "part").sortWithinPartitions("part", "batch").mapInArrow(settling, FOUND)
    rows = batches.select("batch", F.lit(-1).alias("part"), "data", F.lit(None).cast("binary").alias("totals"), F.lit(None).cast("binary").alias("own"))
    answers = found.select("batch", "part", F.lit(None).cast("binary").alias("data"), "totals", "own")
    tasks = max(min(n_batches, 16 * batches.sparkSession.sparkContext.defaultParallelism), 1)
    return rows.union(answers).repartition(tasks, "batch").sortWithinPartitions("batch", "part").mapInArrow(using, schema)


def tally(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the sum of the weights of each, and the number of each key among the distinct ones."""
    if not len(keys):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    w = np.ones(len(keys), np.uint64) if weights is None else weights[order].astype(np.uint64)
    first = np.flatnonzero(new)
    return ordered[first], np.add.reduceat(w, first), number
