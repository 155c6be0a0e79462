"""N-gram Jaccard join by adaptive multi-match prefixes.

The shingles of every set are put into one order, the rarer ones first.  Two sets whose Jaccard similarity reaches the
threshold share at least ``l`` of the first ``n - ceil(threshold * n) + l`` shingles of each, for every ``l``.  A longer prefix
costs more shared postings and leaves fewer candidates, so every set takes the ``l`` with the least estimated cost, and a
pair has to share as many as the lesser ``l`` of both.

Sets are known by two hashes and equal sets are one class, so copies cost one row of the index and do not make their
shingles frequent.  Links are found in turns.  In the first one each class is compared with one other class alone, the
one that it shares the most posting lists with, among two of each list.  In the next ones each class outside the largest
component of a list meets drawn classes of all its lists, a few at first and more when fewer classes are left outside, and
is compared with the nearest one of each other component; that joins groups of near copies of which only some pairs are
similar.  In the last one, all pairs of different components of a posting list are candidates if they share enough of their
prefixes; each such pair has a class outside the list's largest component, so these are looked up in the list, and a pair
is found where it shares a shingle and not the one before, so not once for each shared shingle.  Marks of ``MARK_WORDS`` longs,
the parity of the shingles that fall on each bit, differ in no more bits than two sets differ in shingles; pairs whose
marks differ in too many are no candidates, so a group of near copies below the threshold costs comparisons and no rows.
Every candidate is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import landed, sliced, texts_of
from .components import roots
from .lookups import batches_of, tally, unpacked, with_totals
from .mixing import compressed
from .texts import followed, lowered, mixed, word_hashes, words_of

SHINGLE = 4
PERCENT = 85
LONGEST = 6
# How many classes of each list are drawn in each turn after the first.
DRAWN = (8, 32)
# What verifying a candidate costs, per shingle, against one shared posting.
VERIFY = 0.05
# Longs of the mark of a set.
MARK_WORDS = 8
MARK = [f"mark{k}" for k in range(MARK_WORDS)]
# Frequencies are counted by the leading 48 bits of a shingle's hash: they only order the shingles.
COARSE = np.uint64(2**64 - 2**16)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct shingles of all texts, sorted; with fewer words the whole sequence is one."""
    w = words_of(lowered(texts))
    codes, distinct = w.codes()
    hashes = word_hashes(distinct)[codes]
    n = w.counts
    row = np.repeat(np.arange(len(n)), n)
    left = w.starts[1:][row] - np.arange(len(codes))
    h, first = mixed(hashes), np.arange(len(codes)) == w.starts[:-1][row]
    starts = (left >= size) | (first & (n[row] < size))
    for k in range(1, size):
        more = left > k
        nxt = np.zeros(len(h), np.uint64)
        nxt[:len(h) - k] = followed(h[:len(h) - k], hashes[k:])
        h = np.where(more, nxt, h)
    row, h = row[starts], h[starts]
    ends = np.searchsorted(row, np.arange(len(n) + 1)).tolist()
    for a, b in zip(ends[:-1], ends[1:]):
        h[a:b].sort()
    new = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
    return row[new], h[new]


def ceil_share(n, percent: int):
    """The least overlap that a set of ``n`` has with a similar one."""
    return -(-n * percent // 100)


class Sets:
    """The shingle sets of some texts, with two hashes of each."""

    def __init__(self, texts: pa.Array, size: int) -> None:
        self.n_rows = len(texts)
        self.row, self.h = shingle_sets(texts, size)
        self.starts = np.searchsorted(self.row, np.arange(self.n_rows + 1))
        self.n = np.diff(self.starts)
        some = np.flatnonzero(self.n)
        self.h1, self.h2 = np.zeros(self.n_rows, np.uint64), np.zeros(self.n_rows, np.uint64)
        if len(some):
            self.h1[some] = np.add.reduceat(mixed(self.h), self.starts[some])
            self.h2[some] = np.add.reduceat(mixed(self.h ^ np.uint64(0x9E3779B97F4A7C15)), self.starts[some])

    def marks(self) -> list[np.ndarray]:
        """The longs of each set's mark: a bit is set if an odd number of its shingles falls on it."""
        bit = mixed(self.h ^ np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(64 * MARK_WORDS)
        one, at, some, out = np.uint64(1) << (bit % np.uint64(64)), (bit // np.uint64(64)).astype(np.uint8), np.flatnonzero(self.n), []
        for k in range(MARK_WORDS):
            word = np.zeros(self.n_rows, np.uint64)
            if len(some):
                word[some] = np.bitwise_xor.reduceat(np.where(at == k, one, np.uint64(0)), self.starts[some])
            out.append(word.view(np.int64))
        return out

    def of(self, k: int) -> np.ndarray:
        return self.h[self.starts[k]:self.starts[k + 1]]


def known_sets(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id``, ``n_shingles`` and the hashes ``h1`` and ``h2`` of each document's set, and its text, compressed."""
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL("n_shingles long, h1 long, h2 long, text binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=5).compress
        for batch in batches:
            for part in sliced([batch], "text", 4 << 20):
                sets = Sets(part.column(1), size)
                packed = pa.array([pack(t) for t in texts_of(part.column(1))], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sets.n), pa.array(sets.h1.view(np.int64)), pa.array(sets.h2.view(np.int64)), packed], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


MARKS = "batch long, place int, h1 long, h2 long, least {}, n_shingles long, matches int, tokens array<long>, positions array<int>, " + ", ".join(
    f"{m} long" for m in MARK)


def prefixes(sets: Sets, frequency: np.ndarray, percent: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The matches that each set asks for, and its prefix's shingles with their positions.

    Shingles of one set alone are counted in the positions and left out.
    """
    order = np.lexsort((sets.h, frequency, sets.row))
    h, f = sets.h[order], frequency[order].astype(np.float64)
    before = np.r_[0.0, np.cumsum(f * (f > 1))]
    n = sets.n
    overlap = ceil_share(n, percent)
    best, matches = np.full(len(n), np.inf), np.ones(len(n), np.int64)
    for m in range(1, LONGEST + 1):
        postings = before[sets.starts[:-1] + np.minimum(n - overlap + m, n)] - before[sets.starts[:-1]]
        cost = postings * (1 + VERIFY * n / m)
        better = (m <= overlap) & (cost < best)
        best, matches = np.where(better, cost, best), np.where(better, m, matches)
    ends = sets.starts[:-1] + np.where(n > 0, n - overlap + matches, 0)
    tokens, places = [], []
    for k in range(len(n)):
        a, b = int(sets.starts[k]), int(ends[k])
        shared = np.flatnonzero(f[a:b] > 1)
        tokens.append(h[a:b][shared].view(np.int64))
        places.append(shared.astype(np.int32))
    return matches, tokens, places


def listed(parts: list[np.ndarray], dtype) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.zeros(0, dtype)]).astype(dtype)))


def with_prefixes(batches: DataFrame, id_type: str, size: int, percent: int, keys: int, n_batches: int) -> DataFrame:
    """A row per class with its place, its hashes, its least document, its prefix and its mark."""
    schema = MARKS.format(id_type)
    names = [f.name for f in StructType.fromDDL(schema).fields]

    def ask(table: pa.Table) -> tuple:
        sets = Sets(table["text"].combine_chunks(), size)
        return *tally(sets.h & COARSE)[:2], sets

    def use(table: pa.Table, sets: Sets, totals: np.ndarray, own: np.ndarray, batch: int) -> Iterator[pa.RecordBatch]:
        number = tally(sets.h & COARSE)[2]
        # Frequencies a factor of two apart order the shingles as well, and leave ties to the hash.
        coarse = 2 ** np.floor(np.log2(np.maximum(totals, 1)))
        matches, tokens, places = prefixes(sets, coarse[number], percent)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(sets.n_rows, batch)), pa.array(np.arange(sets.n_rows, dtype=np.int32)),
             *[table[c].combine_chunks() for c in ("h1", "h2", "least", "n_shingles")],
             pa.array(matches.astype(np.int32)), listed(tokens, np.int64), listed(places, np.int32), *map(pa.array, sets.marks())], names)

    return with_totals(batches, ask, use, schema, keys, n_batches)


def sets_of(batches: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """``c`` and ``shingles`` of the given classes, read from the batches that hold them."""
    wanted = classes.groupBy("batch").agg(F.collect_list(F.struct("c", "place")).alias("wanted"))
    both = batches.join(wanted.hint("rebalance"), "batch").select("data", "wanted")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            for k in range(row.num_rows):
                asked = row.column(1)[k].as_py()
                sets = Sets(unpacked(row.column(0)[k].as_py())["text"].combine_chunks().take(pa.array([a["place"] for a in asked])), size)
                found = [sets.of(j).view(np.int64) for j in range(len(asked))]
                offsets = np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a["c"] for a in asked], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))],
                    ["c", "shingles"])

    return landed(both.mapInArrow(run, "c long, shingles array<long>"), "shingles")


def verified(pairs: DataFrame, batches: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs (``u``, ``v``) whose sets are similar, by their whole sets."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("c")).distinct()
    sets = sets_of(batches, classes.join(ids, "c").select("c", "batch", "place"), size)
    left, right = (sets.select(F.col("c").alias(x), F.col("shingles").alias(f"_{x}")) for x in ("u", "v"))
    joined = pairs.select("u", "v").hint("rebalance").join(left, "u").join(right, "v")
    both = F.size(F.array_intersect("_u", "_v")).cast("long")
    every = F.size("_u").cast("long") + F.size("_v") - both
    return landed(joined.where(100 * both >= percent * every).select("u", "v"), "links")


def fits(least: Column, most: Column, percent: int) -> Column:
    """Whether two sizes allow the similarity."""
    return 100 * least >= percent * most


def required(percent: int) -> Column:
    """The shingles that two similar sets, of sizes ``n1`` and ``n2``, share at least."""
    return F.ceil(percent * (F.col("n1") + F.col("n2")) / (100 + percent) - 1e-9)


def differ() -> Column:
    """The bits in which the marks of two sets differ."""
    return sum((F.bit_count(F.col(f"{m}1").bitwiseXOR(F.col(f"{m}2"))) for m in MARK), F.lit(0))


def alike(percent: int) -> Column:
    """Whether the marks of two sets differ in no more bits than similar sets of their sizes differ in shingles."""
    return fits(F.least("n1", "n2"), F.greatest("n1", "n2"), percent) & (differ() <= F.col("n1") + F.col("n2") - 2 * required(percent))


def side(k: int, *columns: str) -> list[Column]:
    """The columns as those of the first or the second one of two."""
    return [F.col(c).alias(f"{c}{k}") for c in columns]


def with_marks(postings: DataFrame, classes: DataFrame) -> DataFrame:
    """The postings with the mark of their class."""
    marked = classes.select(F.col("c").alias("_c"), *MARK).hint("rebalance")
    return postings.join(marked, postings["c"] == marked["_c"]).drop("_c")


def with_roots(postings: DataFrame, tree: DataFrame | None) -> DataFrame:
    """The postings with the component of their class."""
    if tree is None:
        return postings.withColumn("root", F.col("c"))
    return postings.join(tree, "c", "left").withColumn("root", F.coalesce("root", "c"))


def nearest(placed: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """A pair ``u``, ``v`` for each class: it and a class of another component, which stands first or last in most of its lists."""
    rep = F.struct("root", "c")
    lists = placed.groupBy("token", "bucket").agg(F.min(rep).alias("lo"), F.max(rep).alias("hi")).where("lo.root < hi.root")
    other = F.when(F.col("root") != F.col("lo.root"), F.col("lo.c")).otherwise(F.col("hi.c")).alias("other")
    shared = placed.join(lists.hint("rebalance"), ["token", "bucket"]).groupBy("c", other).agg(F.count("*").alias("n"))
    best = shared.groupBy("c").agg(F.max(F.struct(F.col("n"), (-F.col("other")).alias("other"))).alias("best"))
    one = best.select("c", (-F.col("best.other")).alias("other"))
    pairs = one.select(F.least("c", "other").alias("c1"), F.greatest("c", "other").alias("c2")).distinct()
    known = classes.withColumn("n", F.col("n_shingles"))
    for k in (1, 2):
        pairs = pairs.join(known.select(*side(k, "c", "n", *MARK)).hint("rebalance"), f"c{k}")
    return pairs.where(alike(percent)).select(F.col("c1").alias("u"), F.col("c2").alias("v"))


def spread(placed: DataFrame, *by: str) -> DataFrame:
    """The lists that hold several components, with ``most``, the one with the most classes, and ``held``, all classes."""
    held = placed.groupBy(*by, "root").agg(F.count("*").alias("n"))
    lists = held.groupBy(*by).agg(F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("roots"), F.sum("n").alias("held"))
    return lists.where("roots > 1").select(*by, F.col("most.root").alias("most"), "held")


def drawn(placed: DataFrame, classes: DataFrame, many: int, percent: int) -> DataFrame:
    """Pairs ``u``, ``v``: a class outside the largest component of a list, and the nearest drawn one of each other component.

    Up to ``many`` classes of each list are drawn, in the same order in all lists; the nearest one is that with the most like mark.
    """
    lists = spread(placed, "token", "bucket").hint("rebalance")
    members = landed(with_marks(placed.join(lists, ["token", "bucket"]).drop("held"), classes), "members")
    slot = F.pmod(F.xxhash64("c", F.lit(many)), F.lit(many)).alias("slot")
    ones = members.groupBy("token", "bucket", slot).agg(
        F.min(F.struct(F.xxhash64(F.lit(many), "c").alias("h"), *side(2, "root", "c", "n", *MARK))).alias("one"))
    outside = members.where("root <> most").select("token", "bucket", *side(1, "root", "c", "n", *MARK))
    met = outside.join(ones.select("token", "bucket", "one.*").hint("rebalance"), ["token", "bucket"]).where((F.col("root1") != F.col("root2")) & alike(percent))
    best = met.groupBy("c1", "root2").agg(F.min(F.struct(differ().alias("differ"), "c2")).alias("best"))
    return best.select(F.least("c1", "best.c2").alias("u"), F.greatest("c1", "best.c2").alias("v")).distinct()


def meeting(placed: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``u``, ``v`` of different components with marks alike, where they share a shingle of their prefixes and not the one before it.

    One of such two lies outside the component with the most classes of the list, so only these classes are looked up.
    The first shingle that two sets share has another one before it in each, and what stands before it is in one set alone.
    """
    mixed_lists = placed.join(spread(placed, "token").drop("held").hint("rebalance"), "token")
    mixed_lists = landed(with_marks(mixed_lists, classes), "postings")
    fields = ["c", "n", "position", "before", "root", *MARK]
    # Sizes of similar sets lie in one bucket or in two neighbouring ones.
    near = F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket")
    outside = mixed_lists.where("root <> most").select("token", near, *side(1, *fields))
    every = mixed_lists.select("token", "bucket", "most", *side(2, *fields))
    once = (F.col("root2") == F.col("most")) | (F.col("c1") < F.col("c2"))
    new = F.col("before1").isNull() | F.col("before2").isNull() | (F.col("before1") != F.col("before2"))
    first = F.col("position1") + F.col("position2") <= F.col("n1") + F.col("n2") - 2 * required(percent)
    shared = outside.join(every, ["token", "bucket"]).where((F.col("root1") != F.col("root2")) & once & new & first & alike(percent))
    return shared.select(F.least("c1", "c2").alias("u"), F.greatest("c1", "c2").alias("v"))


def across(placed: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """All pairs ``u``, ``v`` of different components that share as many shingles of their prefixes as they ask for."""
    known = classes.withColumn("n", F.col("n_shingles"))
    pairs = meeting(placed, classes, percent).distinct().select(F.col("u").alias("c1"), F.col("v").alias("c2")).hint("rebalance")
    for k in (1, 2):
        pairs = pairs.join(known.select(*side(k, "c", "n", "matches", "tokens", "positions")), f"c{k}")
    # Similar sets of these sizes share at least ``overlap`` shingles, ``asked`` of them in the first ``n - overlap + asked`` of each.
    overlap, asked = required(percent), F.least("matches1", "matches2")

    def prefix(k: int) -> Column:
        return F.slice(f"tokens{k}", F.lit(1), F.size(F.filter(f"positions{k}", lambda p: p < F.col(f"n{k}") - overlap + asked)))

    shared = pairs.withColumn("shared", F.array_intersect(prefix(1), prefix(2))).withColumn("both", F.size("shared"))
    last = F.get("shared", F.col("both") - 1)

    # Beyond the last shared place of its prefix, a set can share no more than what is left of it.
    def left(k: int) -> Column:
        return F.col(f"n{k}") - 1 - F.get(f"positions{k}", F.array_position(f"tokens{k}", last).cast("int") - 1)

    enough = (F.col("both") >= asked) & (F.col("both") + F.least(left(1), left(2)) >= overlap)
    return shared.where(enough).select(F.col("c1").alias("u"), F.col("c2").alias("v"))


def linked(tree: DataFrame | None, pairs: DataFrame, batches: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame | None:
    """The tree with the similar ones of the pairs linked too; the same one if there are none, which costs no plans on the driver."""
    if pairs.isEmpty():
        return tree
    good = verified(pairs, batches, classes, size, percent)
    if good.isEmpty():
        return tree
    return roots(good if tree is None else good.union(tree)).select(F.col("u").alias("c"), F.col("v").alias("root"))


def forest(batches: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame | None:
    """``c`` and ``root``, the least class that similar pairs connect it with, of all linked classes but these least ones; None without links."""
    # A bucket is as wide as the similarity allows sizes to differ.
    bucket = F.floor(F.log(F.col("n")) / float(-np.log(percent / 100)) + 1e-9)
    lists = classes.select("c", F.col("n_shingles").alias("n"), "tokens", "positions").withColumn("bucket", bucket)
    postings = lists.select("c", "n", "bucket", F.explode("tokens").alias("token"))
    tried, tree = None, None
    for many in (None, *DRAWN):
        placed = with_roots(postings, tree)
        pairs = drawn(placed, classes, many, percent) if many else nearest(placed, classes, percent)
        pairs = landed(pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti"), "pairs")
        tree = linked(tree, pairs, batches, classes, size, percent)
        tried = pairs if tried is None else tried.union(pairs)
    before = F.transform("tokens", lambda _, k: F.get("tokens", k - 1)).alias("before")
    placed = lists.select("c", "n", "bucket", F.explode(F.arrays_zip("tokens", "positions", before)).alias("t")).select(
        "c", "n", "bucket", F.col("t.tokens").alias("token"), F.col("t.positions").alias("position"), "t.before")
    last = across(with_roots(placed, tree), classes, percent).join(tried, ["u", "v"], "left_anti")
    return linked(tree, landed(last, "pairs"), batches, classes, size, percent)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of each row: the least id its text is linked with, itself included.

    A set holds the distinct shingles of the words between ASCII blanks, A-Z lower-cased; fewer words are one shingle;
    a text that is null, empty or without words has no set and is linked with nothing.  Shingles are 64-bit
    hashes.  A null id is never the least, unless there is no other.  Repeated rows stay; an empty table gives no rows;
    other columns are left out.
    """
    read = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    marks = landed(known_sets(read, shingle), "sets")
    kinds = marks.where("n_shingles > 0").groupBy("h1", "h2").agg(
        F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("text").alias("text"))
    batches = batches_of(compressed(kinds, back=True).withColumn("text", F.col("text").cast("string")), "texts")
    n, size = batches.agg(F.count("*"), F.sum(F.octet_length("data"))).first()
    found = with_prefixes(batches, read.schema["doc_id"].dataType.simpleString(), shingle, percent, (size or 0) // 3, n)
    classes = landed(found.withColumn("c", F.monotonically_increasing_id()), "classes")
    tree = forest(batches, classes, shingle, percent)
    named = landed(with_roots(classes.select("c", "h1", "h2", "least"), tree), "classes")
    least = named.groupBy("root").agg(F.min("least").alias("component_id")).hint("rebalance")
    answer = named.select("h1", "h2", "root").join(least, "root").select(
        F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "component_id").hint("rebalance")
    same = (marks["h1"] == answer["_h1"]) & (marks["h2"] == answer["_h2"]) & (marks["n_shingles"] > 0)
    return marks.join(answer, same, "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
