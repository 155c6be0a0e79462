"""Benchmark phrases in documents, found through a stored positional inverted index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import LARGE_ROWS, free_names, landed, sliced, texts_of, word_runs

WINDOW = 10
SLOP = 5
# The benchmark goes to the executors in parts of about this many bytes, one pass over the documents each.
PART_BYTES = 4 << 20
# A block of documents whose postings are held at once.
BLOCK_BYTES = 2 << 20

# A-Z to lower case, everything in ASCII that is neither digit nor letter to a blank; other bytes stay.
_FOLD = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


@dataclass
class Queries:
    """The windows of a part of the benchmark, by length: term ids, a row each, and the items each belongs to."""

    terms: dict[bytes, int]
    windows: list[tuple[np.ndarray, list[list[str]]]]


def queries_of(items: list[tuple[object, bytes]], window: int) -> Queries:
    """Distinct windows of ``window`` words; an item of fewer words, but not none, is one window."""
    terms: dict[bytes, int] = {}
    found: dict[tuple[int, ...], dict[str, None]] = {}
    for item_id, text in items:
        ids = [terms.setdefault(w, len(terms)) for w in words_of(text)]
        for at in range(max(len(ids) - window, 0) + 1 if ids else 0):
            found.setdefault(tuple(ids[at:at + window]), {})[str(item_id)] = None
    by_length: dict[int, list[tuple[int, ...]]] = {}
    for w in found:
        by_length.setdefault(len(w), []).append(w)
    return Queries(terms, [(np.array(ws, np.int32), [list(found[w]) for w in ws]) for ws in by_length.values()])


# One row per block: its documents with their first position and words, its terms in order, with nothing between them,
# the bytes of each, the number of each term's places, and the places, term by term.  Numbers are little-endian, 32 bits
# each; as arrays of Spark each would take three times that on the heap, for all rows of a row group at once.
INDEX = "terms binary, lengths binary, counts binary, places binary"
_NUMBER = np.dtype("<i4")


def block_postings(texts: list[bytes], gap: int) -> tuple[list[int], list[int], list[bytes], np.ndarray, np.ndarray]:
    """First position and number of words of each text; the terms of the block, how many places each has, and their places, term by term."""
    known: dict[bytes, int] = {}
    first, n_words, posts, at = [], [], [np.zeros(0, np.int64)], 0
    for text in texts:
        first.append(at)
        for words in word_runs(text.translate(_FOLD)):
            ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
            posts.append(ids << 32 | np.arange(at, at + len(words)))  # term in front, so one sort orders terms and places
            at += len(words)
        n_words.append(at - first[-1])
        at += gap  # no match reaches into the next text
    every = np.sort(np.concatenate(posts))
    counts = np.bincount(every >> 32, minlength=len(known))
    return first, n_words, list(known), counts, every & 0xFFFFFFFF


def index_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """The positional inverted index of all words of every whole text, stored in the shared folder.

    It is cut by documents: a row holds the postings of a block of about ``BLOCK_BYTES``, so nothing is shuffled and a hot
    term is only a longer list in each block.  Texts are ``gap`` = ``window + slop`` positions apart.
    """
    body = F.col(f"`{text}`")
    picked = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("h"), body.alias("text"))
    of_doc = StructType([StructField("doc", picked.schema["doc"].dataType)] + StructType.fromDDL("h long, first long, n_words long").fields)
    schema = StructType([StructField("docs", ArrayType(of_doc))] + StructType.fromDDL(INDEX).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", BLOCK_BYTES):
            first, n_words, terms, counts, places = block_postings(texts_of(batch.column(2)), window + slop)
            rows = pa.StructArray.from_arrays(
                [batch.column(0), batch.column(1), pa.array(first, pa.int64()), pa.array(n_words, pa.int64())], of_doc.names)
            packed = [b"".join(terms), *(np.asarray(v, _NUMBER).tobytes() for v in ([len(w) for w in terms], counts, places))]
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), *(pa.array([v], pa.binary()) for v in packed)], schema.names)

    indexed = picked.mapInArrow(run, schema).withColumn("block", F.monotonically_increasing_id())
    return landed(indexed, "postings", **LARGE_ROWS)  # the numbers of the blocks are fixed with it


class BlockIndex:
    """A stored block as the queries see it: the places of each of their terms, in order."""

    def __init__(self, first: np.ndarray, terms: pa.Buffer, lengths: pa.Buffer, counts: pa.Buffer, places: pa.Buffer, asked: pa.Array):
        self.first, self.places = first, np.frombuffer(places, _NUMBER).astype(np.int64)
        begins, starts = (np.r_[0, np.cumsum(np.frombuffer(x, _NUMBER), dtype=np.int64)] for x in (lengths, counts))
        stored = pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer(begins.astype(np.int32)), terms])
        at = np.asarray(pc.index_in(asked, value_set=stored).fill_null(-1), np.int64)
        self.begin = np.where(at >= 0, starts[at], 0)
        self.end = np.where(at >= 0, starts[np.minimum(at + 1, len(starts) - 1)], 0)
        self.sizes = self.end - self.begin

    def postings(self, term: int) -> np.ndarray:
        return self.places[self.begin[term]:self.end[term]]

    def size(self, term: int) -> int:
        return int(self.sizes[term])


def within(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each wanted value, whether it occurs."""
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return sorted_values[at] == wanted


def matches(index: BlockIndex, window: list[int], slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the exact phrase, and places of its rarest term with all its terms near by.

    Lists are intersected from the rarest term on: for the phrase after taking each term's
    offset off, for proximity by the nearest place within the window's length plus ``slop``.
    """
    none = np.zeros(0, np.int64)
    order = sorted(range(len(window)), key=lambda k: index.size(window[k]))
    if index.size(window[order[0]]) == 0:
        return none, none
    near = index.postings(window[order[0]])
    reach = len(window) - 1 + slop
    exact = near - order[0]
    for k in order[1:]:
        places = index.postings(window[k])
        if len(exact):
            exact = exact[within(places, exact + k)]
        if len(near):
            at = np.searchsorted(places, near - reach)
            near, at = near[at < len(places)], at[at < len(places)]
            near = near[places[at] <= near + reach]
        if not len(near) and not len(exact):
            break
    return exact, near


def block_rows(index: BlockIndex, queries: Queries, slop: int) -> tuple[list, list, list]:
    """Per text the covered word ranges, items matched exactly and items matched near by."""
    n = len(index.first)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    items: list[set[str]] = [set() for _ in range(n)]
    close: list[set[str]] = [set() for _ in range(n)]
    present = index.sizes > 0
    asked = [(rows[k].tolist(), owners[k]) for rows, owners in queries.windows for k in np.flatnonzero(present[rows].all(axis=1))]
    for terms, owners in asked:
        exact, near = matches(index, terms, slop)
        for start, doc in zip(exact.tolist(), (np.searchsorted(index.first, exact, "right") - 1).tolist()):
            at = start - int(index.first[doc])
            spans[doc].append((at, at + len(terms)))
            items[doc].update(owners)
        for doc in set((np.searchsorted(index.first, near, "right") - 1).tolist()):
            close[doc].update(owners)
    return [merged(s) for s in spans], [sorted(i) for i in items], [sorted(c - i) for c, i in zip(close, items)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that do not overlap or touch, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


FOUND = "hit_spans array<struct<start: long, end: long>>, item_ids array<string>, near_item_ids array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def found_arrays(spans: list, items: list, close: list) -> list[pa.Array]:
    return [pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _SPANS),
            pa.array(items, pa.list_(pa.string())), pa.array(close, pa.list_(pa.string()))]


def search(index: DataFrame, benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text",
           window: int = WINDOW, slop: int = SLOP, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per indexed row: ``doc``, ``h`` (XXH64 of the text), ``n_words`` and what of the benchmark the text holds.

    ``hit_spans`` are the word ranges (from 0, end exclusive) inside exact occurrences of a window of
    ``window`` words, ``item_ids`` the items with such windows, ``near_item_ids`` further items with all words of a
    window within ``slop`` words of its length.  ``window`` and ``slop`` are at most those of the index together.

    The benchmark is the query set.  Its size is summed up first; each part of about ``part_bytes`` is sent
    to the executors and answered from the stored postings, one pass each.  An item without words has no
    window; a null item id counts as ``None``; repeated rows and ties stay; empty tables give no rows or no hits.
    """
    spark = index.sparkSession.sparkContext
    wanted = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).alias("text")).distinct()
    size = wanted.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    n_parts = max(1, -(-size // part_bytes))
    cut = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_parts))
    kind = index.schema["docs"].dataType.elementType
    out = StructType([StructField("block", LongType()), StructField("place", IntegerType()), kind["doc"], kind["h"], kind["n_words"]]
                     + StructType.fromDDL(FOUND).fields)
    passes = []
    for p in range(n_parts):
        part = wanted if n_parts == 1 else wanted.where(cut == p)
        asked = queries_of([(r[0], (r[1] or "").encode()) for r in part.collect()], window)  # about part_bytes
        sent = spark.broadcast((asked.terms, asked.windows))  # plain values: executors lack this package

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            queries = Queries(*sent.value)
            terms_asked = pa.array(list(queries.terms), pa.binary())
            for batch in batches:
                for k in range(batch.num_rows):
                    block, docs = batch.column(0)[k], batch.column(1)[k].values
                    held = BlockIndex(docs.field("first").to_numpy(), *(batch.column(c)[k].as_buffer() for c in range(2, 6)), terms_asked)
                    n = len(docs)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block.as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), docs.field("doc"), docs.field("h"),
                         docs.field("n_words"), *found_arrays(*block_rows(held, queries, slop))], out.names)

        passes.append(index.select("block", "docs", "terms", "lengths", "counts", "places").mapInArrow(run, out))
    if n_parts == 1:
        return passes[0].drop("block", "place")
    return together(passes, out).drop("block", "place")


def together(passes: list[DataFrame], out: StructType) -> DataFrame:
    """The answers of all parts of the benchmark, one row per document."""
    lists = out.names[5:]
    rows = landed(passes[0], "phrases")
    for more in passes[1:]:
        rows = rows.unionByName(landed(more, "phrases"))
    sums = rows.groupBy("block", "place").agg(
        *[F.any_value(c).alias(c) for c in out.names[2:5]], *[F.flatten(F.collect_list(c)).alias(c) for c in lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, items, close = (batch.column(k).to_pylist() for k in range(5, 8))
            items = [sorted(set(i)) for i in items]
            close = [sorted(set(c) - set(i)) for c, i in zip(close, items)]
            spans = [merged([(s["start"], s["end"]) for s in of]) for of in spans]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(5)] + found_arrays(spans, items, close), out.names)

    return sums.select(*out.names).mapInArrow(run, out)


def find_phrases(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Index ``docs`` and search them for ``benchmark``; a null text has no words; other columns are left out."""
    return search(index_documents(docs, doc_id, text), benchmark, part_bytes=part_bytes).withColumnRenamed("doc", "doc_id")


def without_hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with all their columns."""
    stay, own = free_names(docs, "_doc", "_h")
    hit = find_phrases(docs, benchmark, doc_id, text).where(F.size("hit_spans") > 0).select(
        F.col("doc_id").alias(stay), F.col("h").alias(own)).distinct().hint("rebalance")
    body = F.xxhash64(F.coalesce(docs[f"`{text}`"], F.lit("")))
    return docs.join(hit, docs[f"`{doc_id}`"].eqNullSafe(hit[stay]) & (body == hit[own]), "left_anti")


def digest(found: DataFrame) -> DataFrame:
    """The counts and the hash of the item ids, one row per document."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.size("near_item_ids").cast("long").alias("n_near_items"))
