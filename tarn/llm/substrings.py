"""Repeated byte strings, through run-length compressed Burrows-Wheeler indexes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import free_names, landed, sliced

LENGTH = 200
# Strings that may be equal share the k-gram of least hash in them.
GRAM = 32
# Windows of one long text that are looked at together.
CHUNK = 1 << 20
# Bytes of one index, small enough for a core's cache; segments that share a k-gram and come to more are cut again.
INDEX_BYTES = 128 << 10
PACK = 7
# Segments are cut again by the k-grams of least hash in two flanks of the window, twice, and then window by window.
FLANK = 64
FLANK_GRAM = 16
LAST = 3

# Odd multipliers of the k-gram hash.
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes (a multiple of eight) from each place on."""
    n = len(raw) - gram + 1
    eight = np.ndarray((len(raw) - 7,), "<u8", raw.tobytes(), strides=(1,)).copy()
    h = eight[:n] * _M[0]
    for k in range(1, gram // 8):
        h += eight[8 * k:8 * k + n]
        h ^= h >> np.uint64(31)
        h *= _M[k % 4]
    h ^= h >> np.uint64(32)
    h *= _M[4]
    h ^= h >> np.uint64(29)
    return h


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row."""
    span, now = 1, values
    while 2 * span <= width:
        now = np.minimum(now[:-span], now[span:])
        span *= 2
    rest = width - span
    return np.minimum(now[:len(now) - rest], now[rest:]) if rest else now


def least_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of each ``width`` hashes in a row; the low bits give way to the place, so equal hashes count from the left."""
    place = np.uint64(CHUNK * 2 - 1)
    return (sliding_least((hashes & ~place) | np.arange(len(hashes), dtype=np.uint64), width) & place).astype(np.int64)


def runs_of(places: list[np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, windows, whether a place changes inside) of the runs of equal keys; windows of equal places have equal keys."""
    moved = np.zeros(len(keys) - 1, bool)
    for p in places:
        moved |= p[1:] != p[:-1]
    starts = np.flatnonzero(np.r_[True, moved])
    key = keys[starts]
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    first = starts[head]
    return first, np.diff(np.r_[first, len(keys)]), np.diff(np.r_[head, len(starts)]) > 1


def listed(text, length: int, begin: int, keys: np.ndarray, first: np.ndarray, n: np.ndarray, several: np.ndarray) -> Iterator[tuple[int, int, int, int, bool]]:
    view = memoryview(text)
    for k, a, m, r in zip(keys[first].view(np.int64).tolist(), first.tolist(), n.tolist(), several.tolist()):
        yield k, signed(xxhash.xxh3_64_intdigest(view[a:a + m + length - 1])), begin + a, m, r


def segments(text: bytes, length: int, gram: int = GRAM) -> Iterator[tuple[int, int, int, int, bool]]:
    """Runs of windows of ``length`` bytes that share their k-gram of least hash.

    Yields (that hash, hash of the bytes, first window, windows, whether the k-gram was met at several places).
    Every window is in one segment; equal windows lie in segments with equal first value.
    """
    for begin in range(0, max(len(text) - length + 1, 0), CHUNK):
        part = text[begin:begin + CHUNK + length - 1]
        h = gram_hashes(np.frombuffer(part, np.uint8), gram)
        least = least_places(h, length - gram + 1)
        keys = h[least]
        yield from listed(part, length, begin, keys, *runs_of([least], keys))


def finer(text: bytes, length: int, key: int, level: int) -> Iterator[tuple[int, int, int, int, bool]]:
    """The same of one segment with the given key, by what else its equal windows agree in: the k-grams of least hash near
    the front and the end, those of two flanks between, and at last all bytes."""
    n = len(text) - length + 1
    raw = np.frombuffer(text, np.uint8)
    if level < LAST:
        h = gram_hashes(raw, FLANK_GRAM)
        flank = min(FLANK, length)
        near = least_places(h, flank - FLANK_GRAM + 1)
        room = length - flank
        places = [near[off:off + n] for off in ((0, room) if level == 1 else (room // 3, room - room // 3))]
        agreed = [h[p] for p in places]
    else:
        places, agreed = [np.arange(n)], [window_hashes(text, length)]
    keys = np.full(n, key, np.int64).view(np.uint64)
    for value in agreed:
        keys = (keys ^ value) * _M[1]
        keys ^= keys >> np.uint64(29)
        keys *= _M[3]
    yield from listed(text, length, 0, keys, *runs_of(places, keys))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class RunLengthIndex:
    """A run-length compressed Burrows-Wheeler transform of several texts, with sampled run ends.

    Texts are joined, each with an end mark below all bytes; suffixes equal up to their end mark are in the
    order of the texts.  ``heads`` and ``tails`` are the text positions (suffix array values) at the ends
    of the runs.  The length of the match of a suffix with its neighbour in suffix order is measured
    there only: inside a run it is one less than at the position before.
    """

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        n = int((sizes + 1).sum())
        self.symbols = np.zeros(n + PACK, np.int64)
        inside = np.ones(n, bool)
        inside[self.starts + sizes] = False
        self.symbols[:n][inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
        self.left = np.repeat(self.starts + sizes, sizes + 1) - np.arange(n)  # bytes up to the end mark
        self.n = n
        order = self.sort_suffixes()
        before = self.symbols[order - 1]
        before[order == 0] = 0
        same = (before[1:] == before[:-1]) & (before[1:] != 0)
        self.n_runs = int(n - same.sum())
        head, tail = np.r_[True, ~same], np.r_[~same, True]
        self.heads, self.tails = order[head], order[tail]
        at = np.flatnonzero(head)
        self.head_match = self.common(self.heads, order[np.maximum(at - 1, 0)])
        self.head_match[at == 0] = 0
        at = np.flatnonzero(tail)
        self.tail_match = self.common(self.tails, order[np.minimum(at + 1, n - 1)])
        self.tail_match[at == n - 1] = 0
        del self.levels

    def sort_suffixes(self) -> np.ndarray:
        """The suffix array, by prefix doubling; only suffixes that still tie are sorted again."""
        n = self.n
        word = np.zeros(n, np.int64)
        for j in range(PACK):
            word = (word << 9) | np.where(self.left >= j, self.symbols[j:j + n], 0)
        order = np.argsort(word, kind="stable")
        rank = np.empty(n + 1, np.int64)
        rank[n] = -1
        new = np.r_[True, word[order][1:] != word[order][:-1]]
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = start
        self.levels = [rank.astype(np.int32)]
        span = PACK
        while True:
            tied = ~new
            tied[:-1] |= ~new[1:]
            slot = np.flatnonzero(tied)
            pos = order[slot]
            # Suffixes that end within the span are equal up to the end mark: their order stands.
            second = np.where(self.left[pos] >= span, rank[np.minimum(pos + span, n)] + 1, 0)
            if not second.any():
                return order
            key = rank[pos] * (n + 2) + second
            by = np.argsort(key, kind="stable")
            key = key[by]
            order[slot] = pos[by]
            changed = np.r_[True, key[1:] != key[:-1]]
            new[slot] = changed
            # The first slot of each group of equal keys is its rank.
            rank[order[slot]] = slot[np.maximum.accumulate(np.where(changed, np.arange(len(slot)), 0))]
            self.levels.append(rank.astype(np.int32))
            span *= 2

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at ``p`` and ``q`` share, from the longest doubled prefix down."""
        most = np.minimum(self.left[p], self.left[q])
        off = np.zeros(len(p), np.int64)
        for t in reversed(range(len(self.levels))):
            rank = self.levels[t]
            a, b = np.minimum(p + off, self.n), np.minimum(q + off, self.n)
            off += np.where((rank[a] == rank[b]) & (off < most), PACK << t, 0)
        for _ in range(PACK - 1):
            a, b = np.minimum(p + off, self.n), np.minimum(q + off, self.n)
            off += (self.symbols[a] == self.symbols[b]) & (off < most)
        return np.minimum(off, most)

    def matching_statistics(self) -> np.ndarray:
        """For each position the longest match that starts there and anywhere else, streamed from the samples."""
        here = np.arange(self.n)
        out = np.zeros(self.n, np.int64)
        for sampled, match in ((self.heads, self.head_match), (self.tails, self.tail_match)):
            value = np.zeros(self.n, np.int64)
            value[sampled] = match
            known = np.zeros(self.n, bool)
            known[sampled] = True
            last = np.maximum.accumulate(np.where(known, here, 0))
            np.maximum(out, value[last] - (here - last), out=out)
        return out


def repeated_windows(texts: list[bytes], copied: list[bool], length: int) -> Iterator[tuple[int, int, int]]:
    """(text, first window, windows): runs of windows that also start elsewhere.  A copied text stands for several."""
    index = RunLengthIndex(texts)
    long = index.matching_statistics() >= length
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    for k in np.flatnonzero(copied):
        long[index.starts[k]:index.starts[k] + max(sizes[k] - length + 1, 0)] = True
    edge = np.flatnonzero(np.diff(np.r_[False, long, False].astype(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    text = np.searchsorted(index.starts, begin, "right") - 1
    # The last bytes of a text start no window, so no run reaches into the next text.
    yield from zip(text.tolist(), (begin - index.starts[text]).tolist(), (end - begin).tolist())


SEGMENT = "m long, c long, first long, n long, several boolean, copied boolean"
RANGE = "m long, c long, first long, n long"


def window_hashes(content: bytes, length: int) -> np.ndarray:
    """A hash of all bytes of every window."""
    h = gram_hashes(np.frombuffer(content, np.uint8), GRAM)
    n = len(content) - length + 1
    out = np.zeros(n, np.uint64)
    for off in [*range(0, length - GRAM, GRAM), length - GRAM]:
        out = (out ^ h[off:off + n]) * _M[1]
        out ^= out >> np.uint64(29)
    return out


def found_segments(texts: DataFrame, length: int, level: int) -> DataFrame:
    """Segments of every text; ``texts`` has doc, h, text and copied.  Above level 0 a text is a segment and doc its key."""
    schema = StructType(texts.schema.fields[:2] + StructType.fromDDL(SEGMENT).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            owner: list[int] = []
            rows: list[tuple] = []
            for k, (key, text) in enumerate(zip(batch.column(0), batch.column(2))):
                raw = bytes(text.as_buffer()) if text.is_valid else b""
                before = len(rows)
                rows.extend(finer(raw, length, key.as_py(), level) if level else segments(raw, length))
                owner.extend([k] * (len(rows) - before))
            at = pa.array(owner, pa.int64())
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(),) * 4 + (pa.bool_(),)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), *[pa.array(c, t) for c, t in zip(columns, kinds)], batch.column(3).take(at)],
                schema.names)

    return texts.mapInArrow(run, schema)


def in_groups(batches: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bool], list[bytes]]]:
    """Whole groups of rows (m, c, copied, content) with one ``m``, sorted by ``m``, as many as come to ``max_bytes`` together."""
    held: list[tuple] = []
    group: list[tuple] = []
    held_bytes = group_bytes = 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if group and group[0][0] != row[0]:
                if held and held_bytes + group_bytes > max_bytes:
                    yield columns_of(held)
                    held, held_bytes = [], 0
                held, held_bytes, group, group_bytes = held + group, held_bytes + group_bytes, [], 0
            group.append(row)
            group_bytes += len(row[3])
    if held and held_bytes + group_bytes > max_bytes:
        yield columns_of(held)
        held = []
    if held or group:
        yield columns_of(held + group)


def columns_of(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, list[bool], list[bytes]]:
    m, c, copied, content = zip(*rows)
    return np.array(m), np.array(c), list(copied), list(content)


def indexed(contents: DataFrame, length: int, index_bytes: int) -> DataFrame:
    """Ranges of repeated windows in ``contents`` (m, c, copied, content), each task with indexes of its own groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, c, copied, content in in_groups(batches, index_bytes):
            found = np.array(list(repeated_windows(content, copied, length)), np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [pa.array(m[found[:, 0]]), pa.array(c[found[:, 0]]), pa.array(found[:, 1]), pa.array(found[:, 2])],
                ["m", "c", "first", "n"])

    return contents.select("m", "c", "copied", "content").repartition("m").sortWithinPartitions("m", "c").mapInArrow(run, RANGE)


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` (doc, h, text) with each id and text once, and ``copied`` where it stands for several rows.

    Only texts of ids that occur more than once are shuffled.
    """
    again = landed(docs.groupBy("doc").count().where("count > 1").select(F.col("doc").alias("_doc")), "ids")
    same = docs["doc"].eqNullSafe(again["_doc"])
    rest = docs.join(again, same, "left_semi").groupBy("doc", "h").agg(F.first("text").alias("text"), (F.count("*") > 1).alias("copied"))
    return docs.join(again, same, "left_anti").select("doc", "h", "text", F.lit(False).alias("copied")).unionByName(rest)


def repeated_ranges(texts: DataFrame, length: int = LENGTH, index_bytes: int = INDEX_BYTES, level: int = 0) -> DataFrame:
    """``doc, h, found``: runs of windows of ``length`` bytes that also start elsewhere, as structs of first byte and windows.

    A text may have several rows.  ``texts`` has doc, h (a hash of the text), text and copied, each doc and h once.  Segments of equal least k-gram are
    the only ones that can share a window; only hashes are shuffled to find them.  A k-gram met once settles its
    segment, a segment met several times and alone with its k-gram stands for all its copies, and the different
    segments of a k-gram go into a run-length index, each once with the mark that it has copies.  Where they come to
    more than ``index_bytes`` they are cut in the same way by further k-grams that equal windows agree in, and what then still
    is more by whole windows, so that no index is larger, whatever shares a k-gram.
    """
    segs = landed(found_segments(texts, length, level), "segments")
    grams = segs.groupBy("m").agg(
        F.sum(F.when(F.col("copied"), 2).otherwise(1)).alias("rows"), F.min("c").alias("low"), F.max("c").alias("high"), F.max("several").alias("several"))
    alone = (F.col("low") == F.col("high")) & ~F.col("several") if level < LAST else F.lit(True)
    grams = grams.where("rows > 1 OR several").select("m", alone.alias("alone"))
    own = F.array(F.struct("first", "n")).alias("found")
    if level == LAST:
        return segs.join(grams.hint("rebalance"), "m").select("doc", "h", own)
    shared = landed(segs.drop("several").join(grams.hint("rebalance"), "m"), "shared")
    copies = shared.where("alone").select("doc", "h", own)

    different = shared.where("NOT alone")
    kinds = landed(different.groupBy("m", "c").agg(
        ((F.count("*") > 1) | F.max("copied")).alias("copied"),
        F.min_by(F.struct("doc", "h", "first", "n"), F.struct("doc", "h", "first")).alias("one")), "kinds")
    sizes = kinds.groupBy("m").agg(F.count("*").alias("kinds"), F.sum(F.col("one.n") + (length - 1)).alias("bytes"))
    # A single segment is no longer than a chunk, so its index is bounded too.
    large = sizes.where((F.col("bytes") > index_bytes) & (F.col("kinds") > 1)).select("m", F.lit(True).alias("large"))
    asked = kinds.join(large.hint("rebalance"), "m", "left").select("m", "c", "copied", F.coalesce("large", F.lit(False)).alias("large"), "one.*")
    lists = asked.groupBy("doc", "h").agg(F.collect_list(F.struct("m", "c", "copied", "large", "first", "n")).alias("asked"))
    right = lists.select(F.col("doc").alias("_doc"), F.col("h").alias("_h"), "asked").hint("rebalance")
    found = texts.join(right, texts["doc"].eqNullSafe(right["_doc"]) & (texts["h"] == right["_h"])).select("text", "asked")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
                raw = text.as_buffer()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w[k] for w in wanted], t) for k, t in (("m", pa.int64()), ("c", pa.int64()), ("copied", pa.bool_()), ("large", pa.bool_()))]
                    + [pa.array([bytes(raw[w["first"]:w["first"] + w["n"] + length - 1]) for w in wanted], pa.binary())],
                    ["m", "c", "copied", "large", "content"])

    contents = landed(found.mapInArrow(cut, "m long, c long, copied boolean, large boolean, content binary"), "contents")
    ranges = indexed(contents.where("NOT large"), length, index_bytes).groupBy("m", "c").agg(
        F.collect_list(F.struct("first", "n")).alias("found"))
    left = contents.where("large").select(F.col("m").alias("doc"), F.col("c").alias("h"), F.col("content").alias("text"), "copied")
    if not left.isEmpty():
        ranges = ranges.unionByName(joined_runs(repeated_ranges(left, length, index_bytes, level + 1)))
    ranges = landed(ranges, "ranges")
    # One row for each segment, however many ranges it has.
    marked = different.join(ranges.hint("rebalance"), ["m", "c"]).select(
        "doc", "h", F.transform("found", lambda r: F.struct((F.col("first") + r["first"]).alias("first"), r["n"].alias("n"))).alias("found"))
    return copies.unionByName(marked)


def joined_runs(ranges: DataFrame) -> DataFrame:
    """``m, c, found`` of each segment, with ranges that touch made one; ``ranges`` has them in parts, as doc, h and found."""
    whole = ranges.groupBy(F.col("doc").alias("m"), F.col("h").alias("c")).agg(F.flatten(F.collect_list("found")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for found in batch.column(2).to_pylist():
                runs: list[dict] = []
                for first, n in sorted((r["first"], r["n"]) for r in found):
                    if runs and first <= runs[-1]["first"] + runs[-1]["n"]:
                        runs[-1]["n"] = max(runs[-1]["n"], first + n - runs[-1]["first"])
                    else:
                        runs.append({"first": first, "n": n})
                rows.append(runs)
            kind = pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, kind)], ["m", "c", "found"])

    return whole.mapInArrow(run, "m long, c long, found array<struct<first: long, n: long>>")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``docs`` with ``kept``: the bytes of every whole text without those in a repeated string of ``length`` bytes.

    Also ``n_bytes``, ``n_removed`` and ``n_spans`` (the longest removed runs).  A byte goes if a string over it also starts
    at any other place, in the same text too, overlaps included; all copies go, judged on the input.  A null text is
    empty; texts below ``length`` bytes stay whole; repeated rows are copies of each other; columns that clash with a
    result are replaced; an empty table gives no rows.
    """
    result = StructType.fromDDL("kept binary, n_bytes long, n_removed long, n_spans long")
    names = [f.name for f in docs.schema.fields if f.name != text and f.name not in result.names]
    schema = StructType([docs.schema[n] for n in names] + result.fields)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    plain = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.xxhash64(body).alias("h"), body.alias("text"))
    of_doc, of_hash, of_text, own_hash, its = free_names(docs, "_doc", "_h", "_text", "_hash", "_ranges")
    ranges = repeated_ranges(one_of_each(plain), length, index_bytes).groupBy("doc", "h").agg(
        F.flatten(F.collect_list("found")).alias(its)).select(
        F.col("doc").alias(of_doc), F.col("h").alias(of_hash), its).hint("rebalance")
    whole = docs.select(*[F.col(f"`{n}`") for n in names], body.alias(of_text), F.xxhash64(body).alias(own_hash))
    same = whole[f"`{doc_id}`"].eqNullSafe(ranges[of_doc]) & (whole[own_hash] == ranges[of_hash])
    joined = whole.join(ranges, same, "left").select(*[whole[f"`{n}`"] for n in names], of_text, its)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, of_text):
            column = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            texts = column[of_text].cast(pa.large_binary()).to_pylist()
            rows = [kept(t, r, length) for t, r in zip(texts, column[its].to_pylist())]
            columns = list(zip(*rows))
            made = [pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([column[n] for n in names] + made, schema.names)

    return joined.mapInArrow(run, schema)


def kept(text: bytes, ranges: list[dict] | None, length: int) -> tuple[bytes, int, int, int]:
    """What is left of a text, its size, the bytes removed and their runs."""
    spans = sorted((r["first"], r["first"] + r["n"] + length - 1) for r in ranges or [])
    left, at, removed, n = [], 0, 0, 0
    for a, b in spans:
        if a > at or n == 0:
            left.append(text[at:a])
            n += 1
            removed += b - a
            at = b
        elif b > at:
            removed += b - at
            at = b
    left.append(text[at:])
    return b"".join(left), len(text), removed, n
