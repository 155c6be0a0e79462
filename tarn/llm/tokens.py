"""Token counts by merging ragged arrays of symbols, all sequences one rank at a time."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .common import sliced

NO_RANK = np.int64(1 << 40)
# The pieces held at once, and the distinct pieces whose count a task remembers.
PIECES = 400_000
REMEMBERED = 400_000
# A symbol array of one merge call holds about this many bytes.
MERGE_BYTES = 4 << 20

# Fixed values of byte-level vocabularies: how text is cut before merging, and the characters that
# stand for the 256 bytes (the printable ones for themselves, the others from U+0100 on).
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_letters() -> list[str]:
    """The letter of each byte."""
    letters = {b: chr(b) for b in PRINTABLE}
    for b in range(256):
        letters.setdefault(b, chr(0x100 + len(letters) - len(PRINTABLE)))
    return [letters[b] for b in range(256)]


class Merges:
    """The merge rules of a byte-level BPE file (.json of the tokenizers library)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab = model["model"]["vocab"]
        self.size = np.int64(max(vocab.values()) + 1)
        self.first = np.array([vocab[c] for c in byte_letters()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        keys = np.array([vocab[a] * int(self.size) + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        added = sorted((t["content"] for t in model["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.cut = regex.compile(CUT)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; NO_RANK where no rule merges it."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of each piece.

        All pieces lie in one array.  A round merges, in every piece, the pair of lowest rank
        wherever it occurs, from the left where occurrences overlap.  That is the order of merging one pair
        at a time, because a rule that uses a merged symbol always has a higher rank than the
        rule that made it.  Pieces without a pair to merge leave the array.
        """
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        left = lengths.copy()
        symbols = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), lengths)
        ranks = self.pair_ranks(symbols, piece)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            lowest = np.minimum.reduceat(ranks, starts)
            sizes = np.diff(np.r_[starts, len(piece)])
            done = lowest == NO_RANK
            if done.any():
                left[piece[starts[done]]] = sizes[done]
                stay = np.repeat(~done, sizes)
                symbols, piece, ranks = symbols[stay], piece[stay], ranks[stay]
                lowest, sizes = lowest[~done], sizes[~done]
                if not len(symbols):
                    break
            chosen = ranks == np.repeat(lowest, sizes)
            at = np.flatnonzero(chosen)
            # In a run of overlapping occurrences every second one counts, from the left.
            new_run = np.r_[True, np.diff(at) != 1]
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            symbols[at] = self.made[ranks[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            changed = np.zeros(len(symbols), bool)
            changed[at] = True
            symbols, piece, ranks, changed = symbols[stay], piece[stay], ranks[stay], changed[stay]
            # Only pairs with a merged symbol have a new rank.
            here = np.flatnonzero(changed)
            redo = np.unique(np.r_[here, here[here > 0] - 1])
            ranks[redo] = self.pair_ranks_at(symbols, piece, redo)
        return left

    def pair_ranks(self, symbols: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Rank of each symbol's pair with the next one of its piece; NO_RANK at the end of a piece."""
        return self.pair_ranks_at(symbols, piece, np.arange(len(symbols)))

    def pair_ranks_at(self, symbols: np.ndarray, piece: np.ndarray, at: np.ndarray) -> np.ndarray:
        following = np.minimum(at + 1, len(symbols) - 1)
        found = self.rank(symbols[at], symbols[following])
        return np.where((following > at) & (piece[following] == piece[at]), found, NO_RANK)


class Counter:
    """Token counts of texts, with the counts of frequent pieces remembered."""

    def __init__(self, path: str):
        self.merges, self.known = Merges(path), {}

    def learn(self, pieces: Iterable[str]) -> None:
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = list(set(pieces))
        raw = [p.encode() for p in new]
        at = 0
        while at < len(raw):
            end, size = at, 0
            while end < len(raw) and (end == at or size + len(raw[end]) <= MERGE_BYTES):
                size += len(raw[end])
                end += 1
            self.known.update(zip(new[at:end], self.merges.counts(raw[at:end]).tolist()))
            at = end

    def count(self, texts: list[str]) -> list[int]:
        totals = [0] * len(texts)
        held: list[tuple[int, list[str]]] = []
        n_held = 0

        def settle() -> None:
            self.learn({p for _, pieces in held for p in pieces})
            for k, pieces in held:
                totals[k] += sum(map(self.known.__getitem__, pieces))
            held.clear()

        for k, text in enumerate(texts):
            parts = [text]
            if self.merges.added is not None:
                parts = self.merges.added.split(text)
                totals[k] += len(parts) - 1
            for part in parts:
                if len(part) <= PIECES:
                    chunks: Iterable[list[str]] = [self.merges.cut.findall(part)]
                else:
                    found = (m.group() for m in self.merges.cut.finditer(part))
                    chunks = iter(lambda f=found: list(islice(f, PIECES)), [])
                for pieces in chunks:
                    held.append((k, pieces))
                    n_held += len(pieces)
                    if n_held >= PIECES:
                        settle()
                        n_held = 0
        settle()
        return totals


def with_token_counts(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 512) -> DataFrame:
    """``docs`` without ``text``, plus ``n_bytes``, ``n_tokens`` and ``over_limit`` of every whole text.

    The counts are those of the tokenizers library for the byte-level file ``vocabulary``, added
    tokens inside texts matched whole, nothing added, nothing cut.  ``vocabulary`` is a path that
    exists on every executor.  A null or empty text has no bytes and no tokens.  Columns that clash with a
    result column are replaced.  One pass, no shuffle: repeated rows and hot keys do not matter.
    """
    result = StructType.fromDDL("n_bytes long, n_tokens long, over_limit boolean")
    kept = [f for f in docs.schema.fields if f.name != text and f.name not in result.names]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in sliced(batches, text):
            raw = batch.column(batch.schema.get_field_index(text)).to_pylist()
            texts = [t or "" for t in raw]
            tokens = np.array(counter.count(texts), np.int64)
            sizes = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
            made = [pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(n)) for n in names] + made, names + result.names)

    return docs.select(*[f"`{n}`" for n in names], f"`{text}`").mapInArrow(run, StructType(kept + result.fields))
