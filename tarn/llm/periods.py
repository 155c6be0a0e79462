"""Periodic runs of words: string synchronising sets at dyadic scales, and highly periodic regions.

A run is a stretch of words with a smallest period ``q`` and at least two periods long that no neighbour extends.
At the scale ``t`` the runs with ``3t <= q < 6t`` are looked for.  A position is chosen if the least hash of the windows
of ``t`` words that start in the ``t`` + 1 places from it on is that of the first or the last of them; windows with a
period of ``t / 3`` or less do not take part.  Whether a position is chosen depends on the next ``2t`` words alone, so
two places of a run one period apart are chosen both or neither, and any ``t`` places hold a chosen one unless the
words there are highly periodic.  So every run has two chosen positions with equal ``2t`` words at distance ``q``,
or its first period lies in one highly periodic region and its second one in the next: those two regions give
their periods as an arithmetic progression.  What is proposed is extended word by word, so a hash never decides.
Periods below 6 are read off directly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import sliced
from .texts import followed, mixed, words_of

LEAST = 12
SMALL = 6
NONE = np.uint64(2**64 - 1)


def stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    edge = np.diff(np.r_[False, equal, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Found:
    """The runs so far; a stretch stays with its smallest period, which has to come first."""

    def __init__(self) -> None:
        self.runs: list[tuple[int, int, int]] = []
        self.known: set[tuple[int, int]] = set()

    def add(self, s: int, e: int, q: int) -> None:
        if (s, e) not in self.known:
            self.known.add((s, e))
            self.runs.append((s, e, q))

    def since(self, k: int) -> np.ndarray:
        return np.array(self.runs[k:], np.int64).reshape(-1, 3)


def extended(w: np.ndarray, i: int, q: int) -> tuple[int, int]:
    """The longest stretch around ``i`` whose words equal those ``q`` places on."""
    if w[i] != w[i + q]:
        return i, i
    lo, step = i, 64
    while lo > 0:
        a = max(lo - step, 0)
        other = np.flatnonzero(w[a:lo] != w[a + q:lo + q])
        if len(other):
            lo = a + int(other[-1]) + 1
            break
        lo, step = a, 2 * step
    hi, step, end = i + 1, 64, len(w) - q
    while hi < end:
        b = min(hi + step, end)
        other = np.flatnonzero(w[hi:b] != w[hi + q:b + q])
        if len(other):
            hi += int(other[0])
            break
        hi, step = b, 2 * step
    return lo, hi + q


def small_periods(w: np.ndarray, found: Found) -> None:
    for q in range(1, SMALL):
        if len(w) > q:
            a, b = stretches(w[:-q] == w[q:])
            # Shorter ones are no run that counts, and no window with a period of a third of it or less.
            long = b - a + q >= max(2 * q, min(4 * q, LEAST))
            for s, e in zip(a[long].tolist(), (b[long] + q).tolist()):
                found.add(s, e, q)


def chosen(hashes: np.ndarray, t: int, runs: np.ndarray) -> np.ndarray:
    """The positions of the synchronising set."""
    mark = np.zeros(len(hashes) + 1, np.int64)
    high = runs[(3 * runs[:, 2] <= t) & (runs[:, 1] - runs[:, 0] >= t) & (runs[:, 1] - t < len(hashes))]
    np.add.at(mark, high[:, 0], 1)
    np.add.at(mark, high[:, 1] - t + 1, -1)
    ids = np.where(np.cumsum(mark[:-1]) > 0, NONE, hashes)
    least, width = ids, 1
    while width < t:  # to the least of t places from each on
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[:-1], least[1:])
    n = len(least)
    return np.flatnonzero((least != NONE) & ((least == ids[:n]) | (least == ids[t:t + n])))


def equal_contexts(at: np.ndarray, context: np.ndarray, t: int) -> np.ndarray:
    """(position, distance) of chosen positions with equal contexts ``3t`` to ``6t`` apart.

    A context occurs a bounded number of times in such a distance, as half of it has no small period.
    """
    order = np.argsort(context, kind="stable")
    p, c = at[order], context[order]
    left, ahead, out = np.arange(len(p)), 0, []
    while len(left):
        ahead += 1
        left = left[left + ahead < len(p)]
        distance = p[left + ahead] - p[left]
        near = (c[left + ahead] == c[left]) & (distance < 6 * t)
        left, distance = left[near], distance[near]
        far = distance >= 3 * t
        out.append(np.stack([p[left[far]], distance[far]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def proposed(w: np.ndarray, pairs: np.ndarray, found: Found) -> None:
    """Extend the pairs, smaller periods first; a pair inside a stretch that was read already is passed over."""
    pairs = pairs[np.lexsort((pairs[:, 0], pairs[:, 1]))]
    for q in np.unique(pairs[:, 1]).tolist():
        at = pairs[np.searchsorted(pairs[:, 1], q):np.searchsorted(pairs[:, 1], q, "right"), 0]
        k = 0
        while k < len(at):
            i = int(at[k])
            s, e = extended(w, i, q)
            if e - s >= max(2 * q, LEAST):
                found.add(s, e, q)
            k += max(int(np.searchsorted(at[k:], e - q)), 1)


def aligned(block: np.ndarray, inside: np.ndarray) -> int:
    """Where ``block`` stands in ``inside``, or -1."""
    needle, hay, size = block.tobytes(), inside.tobytes(), block.itemsize
    at = hay.find(needle)
    while at >= 0 and at % size:
        at = hay.find(needle, at + 1)
    return at // size if at >= 0 else -1


def region_pairs(w: np.ndarray, new: np.ndarray, found: Found) -> None:
    """Runs whose first period lies in one highly periodic region and whose second one in the next.

    Regions A = [a, b) and B = [c, d) of one period p that touch or overlap give a run of every period q that carries
    A's phase into B's and fits into both.  It reaches from where B's pattern begins, seen from A, to where A's ends, seen
    from B; only where both ends of a side coincide are words compared.
    """
    high = new[new[:, 1] - new[:, 0] >= 9 * new[:, 2]]
    high = high[np.lexsort((high[:, 0], high[:, 2]))]
    for (a, b, p), (c, d, other) in zip(high[:-1].tolist(), high[1:].tolist()):
        if p != other or c > b:
            continue
        shift = aligned(w[a:a + p], w[c:c + 2 * p - 1])
        if shift < 0:
            continue
        first = (c + shift - a) % p
        least = max(9 * p, SMALL)
        first += -(-(least - first) // p) * p
        for q in range(first, min(b - a, d - c) + 1, p):
            s, e = max(a, c - q), min(b + q, d)
            if e - s >= 2 * q:
                if c - q == a or b + q == d:
                    s, e = extended(w, s, q)
                found.add(s, e, q)


def runs_in(w: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(start, end, period) of all runs of at least ``LEAST`` words in ``w``.

    ``w`` holds texts as numbers, longest first, each followed by a number that is nowhere else.
    """
    found = Found()
    small_periods(w, found)
    region_pairs(w, found.since(0), found)
    ends = np.cumsum(sizes + 1)
    t, hashes = 1, mixed(w)
    while True:
        active = int(np.searchsorted(-sizes, -12 * t, "right"))  # texts that hold two periods of the next scale
        if not active:
            break
        m = int(ends[active - 1])
        w, hashes = w[:m], hashes[:m - t + 1]
        hashes, t = followed(hashes[:-t], hashes[t:]), 2 * t
        done = len(found.runs)
        at = chosen(hashes, t, found.since(0))
        at = at[at + t < len(hashes)]
        proposed(w, equal_contexts(at, followed(hashes[at], hashes[at + t]), t), found)
        region_pairs(w, found.since(done), found)
    runs = found.since(0)
    return runs[runs[:, 1] - runs[:, 0] >= np.maximum(LEAST, 2 * runs[:, 2])]


def batch_runs(texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray], pa.Array]:
    """Words of each text; its runs as rows (start, length, period); the text without repeated periods."""
    words = words_of(texts)
    codes, _ = words.codes()
    n = words.counts
    order = np.argsort(-n, kind="stable")
    sizes = n[order]
    begin = np.cumsum(sizes + 1) - sizes - 1  # of the texts in ``order``
    first = words.starts[:-1][order]
    source = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(codes))
    place = source + np.repeat(begin - first, sizes)
    w = -1 - np.arange(len(codes) + len(n), dtype=np.int64)
    w[place] = codes[source]
    runs = runs_in(w, sizes)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    owner = np.searchsorted(begin, runs[:, 0], "right") - 1
    mark = np.zeros(len(w) + 1, np.int64)
    np.add.at(mark, runs[:, 0] + runs[:, 2], 1)
    np.add.at(mark, runs[:, 1], -1)
    kept = np.ones(len(codes), bool)
    kept[source] = np.cumsum(mark[:-1])[place] == 0
    made = np.stack([runs[:, 0] - begin[owner], runs[:, 1] - runs[:, 0], runs[:, 2]], axis=1)
    cuts = np.searchsorted(owner, np.arange(len(n) + 1))
    of = [np.zeros((0, 3), np.int64)] * len(n)
    for k, doc in enumerate(order.tolist()):
        if cuts[k] < cuts[k + 1]:
            of[doc] = made[cuts[k]:cuts[k + 1]]
    left = words.values.filter(pa.array(kept))
    offsets = np.r_[0, np.cumsum(kept)][words.starts]
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), left.cast(pa.string())), " ")
    return n, of, joined


def with_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (start, length, period by start, then period) and ``collapsed`` of each row.

    Words stand between ASCII blanks.  A run has at least 12 words and two smallest periods.  ``collapsed`` is the
    text without the words that any run holds after its first period, joined by single spaces.  A null or empty
    text has no words, no runs and an empty ``collapsed``; repeated rows stay; an empty table gives no rows;
    other columns are left out.  Every document is read by itself, whole, whatever its length.
    """
    picked = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    made = StructType.fromDDL("n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    out = StructType([picked.schema["doc_id"], *made.fields])
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 4 << 20):
            n, of, collapsed = batch_runs(batch.column(1))
            rows = np.concatenate(of)
            values = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], fields=list(run_type))
            offsets = np.r_[0, np.cumsum([len(r) for r in of])].astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(offsets), values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), runs, collapsed], out.names)

    return picked.mapInArrow(run, out)


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; one document in ten, by the CRC-32 of its id, is made periodic from a word on."""
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    named = docs.select("doc_id", "text", h.alias("h"), g.alias("g"))
    n = F.size(words)
    a = F.pmod(F.col("g"), n.cast("long")).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    unit = F.slice(words, a + 1, p)
    times = F.ceil((n - a) / p).cast("int")
    again = F.slice(F.flatten(F.array_repeat(unit, times)), F.lit(1), n - a)
    periodic = F.array_join(F.concat(F.slice(words, F.lit(1), a), again), " ")
    hit = (F.coalesce(F.col("h") % 10, F.lit(1)) == 0) & F.coalesce(n > 0, F.lit(False))
    return named.select("doc_id", F.when(hit, periodic).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the longest run (ties: smallest start, then period) and hashes of all runs and of the collapsed text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]))
    lines = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"), F.floor(-F.col("best.l") * 1000 / F.col("best.p")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
