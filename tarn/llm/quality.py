"""Quality rules on words, lines and compressed size (compression bands)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .common import sliced, word_runs

# Share of the raw size that is left after compression, as (bytes from, least, most).  The limits
# depend on the length: a short text has little to refer back to, a long one always finds some.
# Real prose in any language and script lies well inside; repeated text falls below, and encoded,
# encrypted or random text rises above.
WHOLE_BANDS = ((0, 0.0, 4.0), (256, 0.15, 0.90), (1024, 0.20, 0.78), (4096, 0.18, 0.66), (65536, 0.10, 0.64))
CHUNK_BANDS = ((0, 0.0, 4.0), (512, 0.15, 0.85), (2048, 0.18, 0.68))
CHUNK_BYTES = 4096
BAD_CHUNK_SHARE = 0.5
LEVEL = 3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, "
    "whole_ratio double, n_chunks long, n_low_chunks long, n_high_chunks long, "
    "base_failed boolean, outside string, kept boolean"
)
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


@dataclass(frozen=True)
class Bands:
    """The parameters of the rules.  A text is rejected as a whole outside its band, or when more
    than ``bad_chunk_share`` of its bytes lie in chunks outside theirs."""

    whole: tuple = WHOLE_BANDS
    chunk: tuple = CHUNK_BANDS
    chunk_bytes: int = CHUNK_BYTES
    bad_chunk_share: float = BAD_CHUNK_SHARE
    level: int = LEVEL
    min_words: int = MIN_WORDS
    max_repeat_percent: int = MAX_REPEAT_PERCENT


def band(bands: tuple, n_bytes: int) -> tuple[float, float]:
    """Least and most ratio for a length: those of the last band that begins at or below it."""
    least, most = 0.0, float("inf")
    for start, low, high in bands:
        if n_bytes >= start:
            least, most = low, high
    return least, most


def side(bands: tuple, n_bytes: int, ratio: float) -> int:
    least, most = band(bands, n_bytes)
    return -1 if ratio < least else int(ratio > most)


def repeated_words(ids: np.ndarray, width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found at two places or more."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    base = np.uint64(int(ids.max()) + 1)
    if int(base) ** width >= 1 << 64:
        windows = np.unique(np.lib.stride_tricks.sliding_window_view(ids, width), axis=0, return_inverse=True)[1].ravel()
    else:
        windows = np.zeros(n, np.uint64)
        for k in range(width):
            windows = windows * base + ids[k:k + n].astype(np.uint64)
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    hit = np.zeros(len(ids), bool)
    for k in range(width):
        hit[k:k + n] |= again
    return int(hit.sum())


def measure(text: bytes, rules: Bands, packer: zstandard.ZstdCompressor) -> tuple:
    seen: dict[bytes, int] = {}
    parts = [np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)) for words in word_runs(text)]
    ids = np.concatenate([np.zeros(0, np.int64), *parts])
    raw = np.frombuffer(text, np.uint8)
    continued = int(((raw & 0xC0) == 0x80).sum())  # of multi-byte characters; all of them lie in words
    word_chars = int((~_BLANK[raw]).sum()) - continued
    n_symbols = int(_SYMBOL[raw].sum())
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    n_dup_lines = len(lines) - len(set(lines))
    n_repeat = repeated_words(ids)
    base_failed = len(ids) < rules.min_words or 100 * n_repeat > rules.max_repeat_percent * len(ids)

    ratio = len(packer.compress(text)) / len(text) if text else 0.0
    n_chunks = low = high = bad_bytes = 0
    for at in range(0, len(text), rules.chunk_bytes):
        chunk = text[at:at + rules.chunk_bytes]
        n_chunks += 1
        where = side(rules.chunk, len(chunk), len(packer.compress(chunk)) / len(chunk))
        low, high = low + (where < 0), high + (where > 0)
        bad_bytes += len(chunk) * (where != 0)
    whole = side(rules.whole, len(text), ratio)
    verdict = "repetitive" if whole < 0 else "incompressible" if whole > 0 else None
    if verdict is None and bad_bytes > rules.bad_chunk_share * len(text):
        verdict = "repetitive" if low >= high else "incompressible"
    kept = not base_failed and verdict is None
    return (len(ids), word_chars, n_symbols, n_dup_lines, n_repeat, len(text), ratio, n_chunks, low, high,
            base_failed, verdict, kept)


def with_quality(docs: DataFrame, text: str = "text", rules: Bands = Bands(), keep_text: bool = False) -> DataFrame:
    """``docs``, without ``text`` unless it is kept, plus what was measured and the verdict for every whole text.

    Columns of ``docs`` that clash with a result column are replaced.  A null or empty text has no
    words and fails the base rule.  Rows keep their number, repeated rows included; the step is
    one pass without a shuffle, so ties and hot keys do not matter.
    """
    result = StructType.fromDDL(RESULT)
    kept_fields = [f for f in docs.schema.fields if (keep_text or f.name != text) and f.name not in result.names]
    schema = StructType(kept_fields + result.fields)
    names, new = [f.name for f in kept_fields], result.names
    read = names if keep_text else [*names, text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=rules.level)
        for batch in sliced(batches, text):
            column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
            rows = [measure(t.as_py() or b"", rules, packer) for t in column]
            columns = list(zip(*rows))
            types = (pa.int64(),) * 6 + (pa.float64(),) + (pa.int64(),) * 3 + (pa.bool_(), pa.string(), pa.bool_())
            made = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(n)) for n in names] + made, names + new)

    return docs.select(*[f"`{n}`" for n in read]).mapInArrow(run, schema)
