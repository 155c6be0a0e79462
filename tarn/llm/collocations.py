"""Phrase collocations over a prefix-free parse of the corpus.

Every text is cut where three words in a row hash to zero modulo ``TRIGGER``; a chunk reaches from one such place to
the end of the next trigger, so neighbours overlap by three words.  Where a text is cut depends on its words alone, so
repeated passages give equal chunks.  The dictionary holds each distinct chunk of a language once, with its frequency
in the parse.  Phrases of one to four words are counted inside the distinct chunks, weighted by that frequency; one
that starts in the overlap is counted in the chunk that it opens and not in the one that it ends.

Phrases are counted as 64-bit hashes, with their texts beside those that count often enough.  First all words and
pairs are counted; three and four words only where all their pairs are frequent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import landed, sliced
from .lookups import grouped, packed, tally, unpacked, with_totals
from .texts import Words, followed, lowered, word_hashes, words_of

LEAST = 30
LONGEST = 4
OVERLAP = LONGEST - 1
TRIGGER = 24
ABSORB = 80
FIRST = 2000
PART_BYTES = 5 << 20
# Ends of pieces; a word never holds one, so a full stop alone stands for them among the words.
ENDS = r"[.,;:!?\x0A-\x0D]+"
STOP = "."

DICTIONARY = pa.schema([("lang", pa.string()), ("last", pa.bool_()), ("chunk", pa.string()), ("n", pa.int64())])
COUNTED = "lang string, phrase string, a long, cuts array<struct<l: bigint, r: bigint>>, words long, batch long, data binary"
CUTS = pa.list_(pa.struct([("l", pa.int64()), ("r", pa.int64())]))


def stretches(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    n = ends - starts
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def joined(values: pa.Array, n: np.ndarray) -> pa.Array:
    """Runs of ``n`` words as texts."""
    offsets = np.r_[0, np.cumsum(n)].astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), values.cast(pa.string())), " ")


def parse(lang: pa.Array, texts: pa.Array) -> pa.Table:
    """The distinct chunks of the texts and how often each occurs."""
    w = words_of(pc.replace_substring_regex(lowered(texts), ENDS, f" {STOP} "))
    codes, distinct = w.codes()
    hashes = word_hashes(distinct)[codes]
    n = len(codes)
    if not n:
        return DICTIONARY.empty_table()
    row = np.repeat(np.arange(len(texts)), w.counts)
    begins = np.zeros(n, bool)
    begins[w.starts[:-1][w.counts > 0]] = True
    triple = followed(followed(hashes[:-2], hashes[1:-1]), hashes[2:])
    begins[:len(triple)] |= (triple % np.uint64(TRIGGER) == 0) & (row[:-2] == row[2:]) if n > 2 else False
    starts = np.flatnonzero(begins)
    end_of_text = w.starts[1:][row[starts]]
    following = np.r_[starts[1:], n]
    last = following >= end_of_text
    ends = np.where(last, end_of_text, following + OVERLAP)
    chunks = joined(w.values.take(pa.array(stretches(starts, ends))), ends - starts)
    table = pa.table({"lang": lang.take(pa.array(row[starts])), "last": pa.array(last), "chunk": chunks, "n": pa.array(np.ones(len(starts), np.int64))})
    return merged(table)


def merged(table: pa.Table) -> pa.Table:
    sums = table.group_by(["lang", "last", "chunk"]).aggregate([("n", "sum")])
    return sums.rename_columns({"n_sum": "n"}).select(DICTIONARY.names).cast(DICTIONARY).combine_chunks()


def dictionary(docs: DataFrame) -> DataFrame:
    """Parts of the dictionary as ``batch`` and ``data``, landed; each holds distinct chunks of about ``PART_BYTES``."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    limit = PART_BYTES
    parts = int(size // limit) + 1

    def parsing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        total = 0
        for batch in batches:
            for piece in sliced([batch], "text", limit):
                held.append(piece)
                total += piece.nbytes
                if total >= limit:
                    yield dealt(held)
                    held, total = [], 0
        if held:
            yield dealt(held)

    def dealt(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        table = parse(rows["lang"].chunk(0), rows["text"].chunk(0))
        part = word_hashes(table["chunk"].combine_chunks()) % np.uint64(parts) if table.num_rows else np.zeros(0, np.uint64)
        order = np.argsort(part, kind="stable")
        table, part = table.take(pa.array(order)), part[order]
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
        blobs = [packed(table.slice(a, b - a)) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(part)])]
        return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int64)), pa.array(blobs, pa.binary())], ["batch", "data"])

    def merging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, "batch"):
            table = merged(pa.concat_tables([unpacked(r["data"]) for r in rows]))
            yield pa.RecordBatch.from_arrays([pa.array([rows[0]["batch"]], pa.int64()), pa.array([packed(table)], pa.binary())], ["batch", "data"])

    shape = "batch long, data binary"
    cut = docs.mapInArrow(parsing, shape).repartition(parts, "batch").sortWithinPartitions("batch")
    return landed(cut.mapInArrow(merging, shape), "dictionary")


@dataclass
class Grams:
    """Words of many rows, and for each place the hashes of the one to four words from there on that lie in its row."""

    values: pa.Array
    row: np.ndarray
    hashes: list[np.ndarray]
    whole: list[np.ndarray]

    def text(self, at: np.ndarray, k: int) -> pa.Array:
        return joined(self.values.take(pa.array(stretches(at, at + k))), np.full(len(at), k))


def grams(values: pa.Array, row: np.ndarray, lang: pa.Array, is_word: np.ndarray, hashes: np.ndarray, longest: int) -> Grams:
    coded = lang.dictionary_encode()
    seeds = word_hashes(coded.dictionary)[np.asarray(coded.indices, dtype=np.int64)] if len(lang) else np.zeros(0, np.uint64)
    h, ok = followed(seeds[row], hashes), is_word
    every, whole = [h], [ok]
    for k in range(1, longest):
        nxt, good = np.zeros(len(h), np.uint64), np.zeros(len(h), bool)
        if len(h) > k:
            nxt[:-k] = followed(h[:-k], hashes[k:])
            good[:-k] = ok[:-k] & is_word[k:] & (row[:-k] == row[k:])
        h, ok = nxt, good
        every.append(h)
        whole.append(ok)
    return Grams(values, row, every, whole)


def asked(g: Grams, sizes: tuple[int, ...], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Keys and counts of the phrases of these sizes, and for each size the key's number at each place, or -1."""
    whole = [g.whole[k - 1] for k in sizes]
    keys, counts, number = tally(
        np.concatenate([g.hashes[k - 1][ok] for k, ok in zip(sizes, whole)]), np.concatenate([weight[ok] for ok in whole]))
    numbers, at = {}, 0
    for k, ok in zip(sizes, whole):
        numbers[k] = np.full(len(ok), -1, np.int64)
        numbers[k][ok] = number[at:at + int(ok.sum())]
        at += int(ok.sum())
    return keys, counts, numbers


def frequency(number: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Total of each place's key, zero where there is none."""
    return np.r_[totals.astype(np.int64), 0][number]


def of_dictionary(table: pa.Table) -> tuple[Grams, np.ndarray]:
    """Words and pairs of the chunks, and the weight of each place: the frequency of its chunk, none in the overlap."""
    w = words_of(table["chunk"].combine_chunks())
    codes, distinct = w.codes()
    row = np.repeat(np.arange(table.num_rows), w.counts)
    is_word = np.asarray(pc.not_equal(distinct, STOP), dtype=bool)[codes] if len(codes) else np.zeros(0, bool)
    left = w.starts[1:][row] - np.arange(len(codes))  # words of the chunk from here on
    counts = (left > OVERLAP) | np.asarray(table["last"])[row]
    g = grams(w.values, row, table["lang"].combine_chunks(), is_word, word_hashes(distinct)[codes], 2)
    return g, np.where(counts, np.asarray(table["n"])[row], 0)


def ask_pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, tuple]:
    g, weight = of_dictionary(table)
    keys, counts, numbers = asked(g, (1, 2), weight)
    return keys, counts, (g, weight, numbers)


def rows_of(lang: pa.Array, phrase: pa.Array, a: np.ndarray, cuts: list[tuple[np.ndarray, np.ndarray]]) -> dict[str, pa.Array]:
    n, k = len(a), len(cuts)
    left, right = (np.stack([c[side] for c in cuts], axis=1).reshape(-1) for side in (0, 1))
    pairs = pa.StructArray.from_arrays([pa.array(left), pa.array(right)], fields=list(CUTS.value_type))
    listed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pairs)
    return {"lang": lang.cast(pa.string()), "phrase": phrase, "a": pa.array(a), "cuts": listed.cast(CUTS)}


def out(n: int, **columns: pa.Array) -> pa.RecordBatch:
    types = {"lang": pa.string(), "phrase": pa.string(), "a": pa.int64(), "cuts": CUTS, "words": pa.int64(), "batch": pa.int64(), "data": pa.binary()}
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, t)) for c, t in types.items()], list(types))


def once(at: np.ndarray, number: np.ndarray) -> np.ndarray:
    """One of the places of each key."""
    return at[np.unique(number[at], return_index=True)[1]]


def use_pairs(table: pa.Table, memo: tuple, totals: np.ndarray, own: np.ndarray, batch: int) -> Iterator[pa.RecordBatch]:
    """Frequent pairs; words of each language; and the stretches of frequent pairs, for longer phrases."""
    g, weight, numbers = memo
    langs = table["lang"].combine_chunks()
    f1, f2 = (frequency(numbers[k], totals) for k in (1, 2))
    counted = pa.table({"lang": langs.take(pa.array(g.row[g.whole[0]])), "w": pa.array(weight[g.whole[0]])}).group_by("lang").aggregate([("w", "sum")])
    yield out(counted.num_rows, lang=counted["lang"].combine_chunks().cast(pa.string()), words=counted["w_sum"].combine_chunks().cast(pa.int64()))
    frequent = f2 >= LEAST
    at = once(np.flatnonzero(frequent & np.r_[own, False][numbers[2]]), numbers[2])
    if len(at):
        yield out(len(at), **rows_of(langs.take(pa.array(g.row[at])), g.text(at, 2), f2[at], [(f1[at], f1[at + 1])]))
    edge = np.diff(np.r_[False, frequent, False].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts > 1
    starts, ends = starts[long], ends[long] + 1
    if len(starts):
        index = stretches(starts, ends)
        offsets = pa.array(np.r_[0, np.cumsum(ends - starts)].astype(np.int32))
        lists = {"words": g.values.take(pa.array(index)), "f1": pa.array(f1[index]), "f2": pa.array(f2[index]), "weight": pa.array(weight[index])}
        data = pa.table({"lang": langs.take(pa.array(g.row[starts])), **{k: pa.ListArray.from_arrays(offsets, v) for k, v in lists.items()}})
        yield out(1, batch=pa.array([batch], pa.int64()), data=pa.array([packed(data)], pa.binary()))


def of_stretches(table: pa.Table) -> tuple[Grams, dict[str, np.ndarray]]:
    words = table["words"].combine_chunks()
    values = words.flatten()
    row = np.repeat(np.arange(table.num_rows), np.diff(np.asarray(words.offsets)))
    coded = values.dictionary_encode()
    hashes = word_hashes(coded.dictionary)[np.asarray(coded.indices, dtype=np.int64)]
    g = grams(values, row, table["lang"].combine_chunks(), np.ones(len(values), bool), hashes, LONGEST)
    return g, {k: np.asarray(table[k].combine_chunks().flatten()) for k in ("f1", "f2", "weight")}


def ask_longer(table: pa.Table) -> tuple[np.ndarray, np.ndarray, tuple]:
    g, known = of_stretches(table)
    keys, counts, numbers = asked(g, (3, 4), known["weight"])
    return keys, counts, (g, known, numbers)


def use_longer(table: pa.Table, memo: tuple, totals: np.ndarray, own: np.ndarray, batch: int) -> Iterator[pa.RecordBatch]:
    """Frequent phrases of three and four words, with the frequencies of the parts of every cut."""
    g, known, numbers = memo
    langs = table["lang"].combine_chunks()
    f = {1: known["f1"], 2: known["f2"], 3: frequency(numbers[3], totals), 4: frequency(numbers[4], totals)}
    for k in (3, 4):
        at = once(np.flatnonzero((f[k] >= LEAST) & np.r_[own, False][numbers[k]]), numbers[k])
        if len(at):
            cuts = [(f[c][at], f[k - c][at + c]) for c in range(1, k)]
            yield out(len(at), **rows_of(langs.take(pa.array(g.row[at])), g.text(at, k), f[k][at], cuts))


def phrases(docs: DataFrame, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Candidates (``lang, phrase, a, l, r, score``) and the words of each language (``lang, n``).

    A candidate is a phrase of 2 to 4 words that occurs at least ``LEAST`` times; ``l`` and ``r`` are the frequencies
    of the two parts of its lowest-scoring cut.  A null language is ``und``; a null or empty text has no words;
    repeated rows count again; an empty table gives none; other columns are left out.
    """
    read = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    chunks = dictionary(read)
    n = chunks.count()
    size = chunks.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    first = landed(with_totals(chunks, ask_pairs, use_pairs, COUNTED, size // 4, n), "pairs")
    longer = first.where("data IS NOT NULL").select("batch", "data")
    held = longer.agg(F.count("*"), F.sum(F.octet_length("data"))).first()
    second = landed(with_totals(longer, ask_longer, use_longer, COUNTED, (held[1] or 0) // 4, held[0]), "phrases")
    each = first.where("phrase IS NOT NULL").unionByName(second)
    # An integral division of decimals is exact; products may pass 64 bits.
    scored = F.expr("""transform(cuts, (c, i) -> struct(
        cast(2000000 AS decimal(7, 0)) * cast(a AS decimal(19, 0)) div (cast(c.l AS decimal(19, 0)) + cast(c.r AS decimal(19, 0))) AS score,
        i AS k, c.l AS l, c.r AS r))""")
    best = each.select("lang", "phrase", "a", F.array_min(scored).alias("best"))
    words = first.where("words IS NOT NULL").groupBy("lang").agg(F.sum("words").alias("n"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score"), words


def unabsorbed(candidates: DataFrame, share: int = ABSORB) -> DataFrame:
    """Without those whose words lie inside a longer candidate that is at least ``share`` percent as frequent."""
    words = F.split("phrase", " ")
    parts = [
        F.when(F.size(words) > k, F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, F.lit(k)), " ")))
        for k in range(2, LONGEST)
    ]
    inside = candidates.select(F.col("lang").alias("_lang"), F.explode(F.flatten(F.array_compact(F.array(*parts)))).alias("_phrase"), "a")
    most = inside.groupBy("_lang", "_phrase").agg(F.max("a").alias("_most"))
    same = (candidates["lang"] == most["_lang"]) & (candidates["phrase"] == most["_phrase"])
    by = lambda c, f: c.cast("decimal(20,0)") * f
    return candidates.join(most, same & (by(F.col("_most"), 100) >= by(candidates["a"], share)), "left_anti")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", first: int = FIRST) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``first`` best phrases of each language."""
    found, words = phrases(docs, lang, text)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # Spark cuts every language to its first rows inside each task before it shuffles them.
    ranked = unabsorbed(landed(found, "candidates")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= first)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
