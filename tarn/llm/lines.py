"""Line dedup: repeated runs of lines, from a suffix array over line ids built by prefix doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import free_names, landed

# Of sf0.1's texts, lines of 8 words are boilerplate in up to 274 of 9,296; licence lines have 12.  Shorter lines
# (headings, greetings, list items) also repeat by chance.
MIN_WORDS = 8
WORD = r"[^\x20\x09-\x0D]"
# A text is known by its id and two hashes of it; equal rows are one document.
DOC = ["doc", "h1", "h2"]
PLACE = [*DOC, "seq"]


def line_hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line), F.xxhash64(line, F.lit(1))]


def line_table(docs: DataFrame) -> DataFrame:
    """Lines with a word: ``seq`` counts them, ``line`` is the place among all lines, ``w`` the words."""
    every = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("x")))
    worded = F.filter(every, lambda e: e["x"].rlike(WORD))
    known = docs.select(F.col("doc"), F.xxhash64("text").alias("h1"), F.hash("text", F.length("text")).alias("h2"), "text")
    each = known.select(*DOC, F.posexplode(worded).alias("seq", "e"))
    return each.select(
        *PLACE, F.col("e.line").alias("line"), F.regexp_count(F.col("e.x"), F.lit(WORD + "+")).alias("w"),
        *[h.alias(n) for h, n in zip(line_hashes(F.col("e.x")), ("a", "b"))])


def ranked(rows: DataFrame, name: str) -> DataFrame:
    """The rows whose pair (``a``, ``b``) occurs at two places or more, with its rank in a new column ``name``.

    Ranks grow with the pairs, so the ranks of pairs of ranks grow with the longer prefixes: the suffixes
    sorted by their last rank are the suffix array as far as their prefixes repeat.  A suffix whose prefix
    occurs once is settled and leaves.
    """
    counts = rows.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    # Ascending with the global sort, unique; the written table fixes them.
    order = landed(counts.sort("a", "b").withColumn(name, F.monotonically_increasing_id()), "ranks")
    return rows.join(order.hint("rebalance"), ["a", "b"]).drop("a", "b")


def suffix_ranks(lines: DataFrame, levels: int) -> DataFrame:
    """``r0`` .. ``r<levels>``: the ranks of the prefixes of 1, 2, 4 ... lines that start at each line; null where
    the prefix occurs only once.  Lines that occur once are not in the table."""
    # Rows of equal documents count as one from here on; before, they only keep more lines in the table.
    now = landed(ranked(lines, "r0").dropDuplicates(PLACE), "suffixes")
    by_doc = Window.partitionBy(*DOC).orderBy("seq")
    for t in range(levels):
        ahead = by_doc.rangeBetween(2**t, 2**t)
        paired = now.withColumn("a", F.col(f"r{t}")).withColumn("b", F.max(f"r{t}").over(ahead))
        both = F.col("a").isNotNull() & F.col("b").isNotNull()
        longer = ranked(paired.where(both).select(*PLACE, "a", "b"), f"r{t + 1}")
        same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in PLACE]
        joined = now.alias("l").join(longer.alias("r"), same, "left")
        now = landed(joined.select("l.*", f"r.r{t + 1}"), "suffixes")
    return now


def blocks(ranks: DataFrame, levels: int, min_words: int) -> DataFrame:
    """Shortest runs of at least ``min_words`` words from each line on and up to each line, as prefixes of suffixes.

    Any repeated run that long is made up of such blocks, and each of them is an interval of the
    suffix array: those suffixes whose longest common prefix covers the block.  Its name is its length
    with the ranks of the two power-of-two prefixes that cover it.
    """
    schema = StructType([ranks.schema[k] for k in DOC] + StructType.fromDDL("seq int, n int, a long, b long").fields)
    names = [f"r{t}" for t in range(levels + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            here = pa.Table.from_batches([batch])
            here = here if carry is None else pa.concat_tables([carry, here])
            # A stretch of lines that follow one another is kept together.
            cut = int(stretches(here)[-1])
            if cut:
                yield make(here.slice(0, cut))
            carry = here.slice(cut)
        if carry is not None and carry.num_rows:
            yield make(carry)

    def column(rows: pa.Table, name: str) -> np.ndarray:
        return rows.column(name).to_numpy()

    def stretches(rows: pa.Table) -> np.ndarray:
        """Where documents or gaps begin."""
        n = rows.num_rows
        doc = rows.column("doc").combine_chunks()
        code = np.asarray(doc.dictionary_encode(null_encoding="encode").indices)
        new = np.ones(n, bool)
        new[1:] = (code[1:] != code[:-1]) | (np.diff(column(rows, "seq")) != 1)
        for k in DOC[1:]:
            v = column(rows, k)
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    def make(rows: pa.Table) -> pa.RecordBatch:
        n = rows.num_rows
        starts = stretches(rows)
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
        words = np.cumsum(column(rows, "w").astype(np.int64))
        before = words - column(rows, "w")
        last = np.searchsorted(words, before + min_words, "left")  # of the block that starts here
        first = np.searchsorted(before, words - min_words, "right") - 1  # of the block that ends here
        at = np.arange(n)
        from_here = (last < n) & (group[np.minimum(last, n - 1)] == group)
        to_here = (first >= 0) & (group[np.maximum(first, 0)] == group)
        s = np.r_[at[from_here], first[to_here]]
        e = np.r_[last[from_here], at[to_here]]
        pairs = np.unique(np.stack([s, e], axis=1), axis=0) if len(s) else np.zeros((0, 2), np.int64)
        s, length = pairs[:, 0], pairs[:, 1] - pairs[:, 0] + 1
        level = np.frexp(length.astype(float))[1] - 1
        a, b = np.full(len(s), -1, np.int64), np.full(len(s), -1, np.int64)
        for t, name in enumerate(names):
            rank = rows.column(name).combine_chunks().fill_null(-1).to_numpy()
            of = np.flatnonzero(level == t)
            a[of], b[of] = rank[s[of]], rank[s[of] + length[of] - 2**t]
        good = (a >= 0) & (b >= 0)
        picked = rows.take(pa.array(s[good]))
        made = [picked.column(k).combine_chunks() for k in (*DOC, "seq")]
        made += [pa.array(length[good].astype(np.int32)), pa.array(a[good]), pa.array(b[good])]
        return pa.RecordBatch.from_arrays(made, schema.names)

    ordered = ranks.select(*PLACE, "w", *names).repartition(*DOC).sortWithinPartitions(*PLACE)
    return ordered.mapInArrow(run, schema)


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc, h1, h2, seq, n``: the later copies of blocks, each ``n`` worded lines from ``seq`` on.

    The first copy is the one with the least (doc, h1, h2, seq), a null id first.
    """
    levels = int(np.log2(max(min_words, 1)))  # a worded line has a word, so a block has no more lines than that
    ranks = suffix_ranks(line_table(docs), levels)
    found = landed(blocks(ranks, levels, min_words), "blocks")
    place = F.struct(*PLACE)
    firsts = found.groupBy("n", "a", "b").agg(F.min(place).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    later = found.join(firsts.hint("rebalance"), ["n", "a", "b"]).where(~place.eqNullSafe(F.col("first")))
    return later.select(*PLACE, "n")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with every later copy of a repeated run of lines taken out of ``text``, plus ``n_lines`` and ``n_removed``.

    A run is one or more lines that follow one another, lines without a word not counted, with ``min_words`` words or
    more in all; it is a later copy if the same run starts at an earlier place, in a document with a lesser id (a null
    id first, equal ids by hash) or further up in the same one.  Lines of a removed run go with their line breaks;
    worded lines outside and lines without words stay.  Rows equal in id and text are one document and lose the
    same lines.  A null text stays null, without lines; an empty table gives no rows.
    """
    plain = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").alias("text")).where(F.col("text").isNotNull())
    its, g1, g2, h1, h2, d = free_names(docs, "_runs", "_g1", "_g2", "_h1", "_h2", "_doc")
    runs = repeated_runs(plain, min_words).groupBy(*DOC).agg(F.collect_set(F.struct("seq", "n")).alias(its))
    body = F.col(f"`{text}`")
    known = docs.withColumn(h1, F.xxhash64(body)).withColumn(h2, F.hash(body, F.length(body)))
    gone = runs.select(F.col("doc").alias(d), F.col("h1").alias(g1), F.col("h2").alias(g2), its).hint("rebalance")
    same = known[f"`{doc_id}`"].eqNullSafe(gone[d]) & (known[h1] == gone[g1]) & (known[h2] == gone[g2])
    kept = [f for f in docs.schema.fields if f.name not in ("n_lines", "n_removed")]
    out = StructType(kept + StructType.fromDDL("n_lines long, n_removed long").fields)
    joined = known.join(gone, same, "left").select(*[known[f"`{f.name}`"] for f in kept], its)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            cut = [cleaned(t, r) for t, r in zip(column[text].to_pylist(), column[its].to_pylist())]
            column[text] = pa.array([c[0] for c in cut], pa.string())
            column["n_lines"] = pa.array([c[1] for c in cut], pa.int64())
            column["n_removed"] = pa.array([c[2] for c in cut], pa.int64())
            yield pa.RecordBatch.from_arrays([column[n] for n in out.names], out.names)

    return joined.mapInArrow(run, out)


def cleaned(text: str | None, runs: list[dict] | None) -> tuple[str | None, int, int]:
    """The text without the runs, its lines, and how many went."""
    if text is None:
        return None, 0, 0
    lines = text.split("\n")
    if not runs:
        return text, len(lines), 0
    places = [k for k, line in enumerate(lines) if line.strip(" \t\n\v\f\r")]
    gone = {places[s] for r in runs for s in range(r["seq"], r["seq"] + r["n"])}
    return "\n".join(line for k, line in enumerate(lines) if k not in gone), len(lines), len(gone)
