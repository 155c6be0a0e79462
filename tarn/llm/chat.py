"""Conversations as token ids with a loss mask: segments encoded apart, reserved ids spliced in between."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import sliced
from .tokens import byte_letters

# The template: "### " role ":\n" text "\n</turn>\n".  Each mark is one reserved id behind the vocabulary,
# so no text can produce it.  For readers of the rendered text the control strings are escaped too.
TURN, SAYS, END = "### ", ":\n", "\n</turn>\n"
CONTROL = r"###|</turn>|<\|endoftext\|>"
LEARNED_ROLE = "assistant"

_ESCAPE = re.compile(rf"(\\*)({CONTROL})")
_UNESCAPE = re.compile(rf"\\(\\*)({CONTROL})")


def escape(text: str) -> str:
    """One more backslash in front of every control string."""
    return _ESCAPE.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    """The text that ``escape`` was given."""
    return _UNESCAPE.sub(r"\1\2", text)


def reserved(vocabulary: str) -> tuple[int, int, int]:
    """The ids of the three marks: the first ones behind the vocabulary and its added tokens."""
    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)
    top = max([*model["model"]["vocab"].values(), *(t["id"] for t in model["added_tokens"])])
    return top + 1, top + 2, top + 3


def spliced(segments: list, marks: tuple[int, int, int], learned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and mask of many turns in one array, and where each turn begins.

    ``segments`` holds the ids of role, text, role, text ...  A turn opens with a mark, has one
    between role and text, and ends with one.  The mask is the prefix sum of +1 where a learned text
    begins and -1 at its closing mark.
    """
    lengths = np.fromiter(map(len, segments), np.int64, len(segments))
    n = len(learned)
    role, text = lengths[0::2], lengths[1::2]
    sizes = role + text + 3
    starts = np.cumsum(sizes) - sizes
    ids = np.full(int(sizes.sum()), -1, np.int32)
    ids[starts] = marks[0]
    ids[starts + 1 + role] = marks[1]
    ends = starts + sizes - 1
    ids[ends] = marks[2]
    ids[ids < 0] = np.concatenate([np.asarray(s, np.int32) for s in segments]) if n else []
    step = np.zeros(len(ids) + 1, np.int64)
    np.add.at(step, (starts + 2 + role)[learned], 1)
    np.add.at(step, ends[learned], -1)
    return ids, np.cumsum(step)[:-1].astype(bool), np.r_[starts, len(ids)]


def format_turns(
    turns: DataFrame, vocabulary: str, conv: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text", learned_role: str = LEARNED_ROLE,
) -> DataFrame:
    """One row per turn: ``conv``, ``turn``, ``role``, ``token_ids``, ``loss_mask``, ``n_chars`` (of the rendered turn).

    The rows of a conversation, ordered by ``turn`` (null first), ``role`` and ``token_ids``,
    joined end to end, are its training sequence; a conversation of any length is never held whole.
    A null role or text is empty; repeated rows stay; other columns are left out.  The step is row by row.
    """
    picked = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = StructType([*picked.schema.fields[:3], *StructType.fromDDL(
        "token_ids array<int>, loss_mask array<boolean>, n_chars long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(vocabulary)
        coder.encode_special_tokens = True
        marks = reserved(vocabulary)
        for batch in sliced(batches, "text"):
            roles = batch.column(2).to_pylist()
            segments = [escape(s) for pair in zip(roles, batch.column(3).to_pylist()) for s in pair]
            coded = [e.ids for e in coder.encode_batch(segments, add_special_tokens=False)]
            learned = np.array([r == learned_role for r in roles], bool)
            ids, mask, offsets = spliced(coded, marks, learned)
            frame = len(TURN) + len(SAYS) + len(END)
            chars = [len(a) + len(b) + frame for a, b in zip(segments[0::2], segments[1::2])]
            at = pa.array(offsets.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.ListArray.from_arrays(at, pa.array(ids)),
                 pa.ListArray.from_arrays(at, pa.array(mask)), pa.array(chars, pa.int64())], schema.names)

    return picked.mapInArrow(run, schema)


def in_sequence(pieces: DataFrame) -> DataFrame:
    """The turns of each conversation next to each other and in order, in one partition."""
    return pieces.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.asc_nulls_first("turn"), "role", "token_ids")


class Reader:
    """Reads ids back into texts."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte = {c: b for b, c in enumerate(byte_letters())}
        self.bytes = {i: bytes(map(byte.__getitem__, s)) for s, i in vocab.items() if all(c in byte for c in s)}
        self.marks = reserved(vocabulary)
        self.shown = {**self.bytes, **{i: m.encode() for i, m in zip(self.marks, (TURN, SAYS, END))}}

    def rendered(self, ids: list[int]) -> str:
        """The formatted text of the ids, marks and escapes included."""
        return b"".join(map(self.shown.__getitem__, ids)).decode()

    def text(self, ids: list[int]) -> str:
        return unescape(b"".join(map(self.bytes.__getitem__, ids)).decode())

    def turns(self, ids: list[int]) -> Iterator[tuple[str, str]]:
        """Role and text of each turn."""
        opens, says, ends = self.marks
        while ids:
            assert ids[0] == opens
            middle, end = ids.index(says), ids.index(ends)
            yield self.text(ids[1:middle]), self.text(ids[middle + 1:end])
            ids = ids[end + 1:]

    def learned(self, ids: list[int], mask: list[bool]) -> Iterator[str]:
        """The text of each unbroken run under the mask."""
        edges = np.flatnonzero(np.diff(np.r_[0, np.asarray(mask, np.int8), 0]))
        for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist()):
            yield self.text(ids[a:b])


DIGEST = ("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
          "n_tokens long, n_loss_tokens long")


def digests(pieces: DataFrame, vocabulary: str) -> DataFrame:
    """One row per conversation, read back from ids and masks as they stream past.

    A task holds one turn of a conversation at a time, so one conversation may hold any share of the rows.
    """
    schema = StructType([pieces.schema["conv_id"], *StructType.fromDDL(DIGEST).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(vocabulary)
        out: list[tuple] = []
        now, state = None, None

        def close() -> None:
            if state is not None:
                n, said, chars, loss, formatted, tokens, lossy = state
                out.append((now, n, said.hexdigest(), chars, loss.hexdigest(), formatted, tokens, lossy))

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist(
                [dict(zip(schema.names, r)) for r in out], schema=_arrow(schema, conv_type))
            out.clear()
            return made

        conv_type = None
        for batch in batches:
            conv_type = batch.schema.field(0).type
            for row in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4))):
                if state is None or row[0] != now:
                    close()
                    now, state = row[0], [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                _, ids, mask = row
                for role, text in reader.turns(ids):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for text in reader.learned(ids, mask):
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(reader.rendered(ids))
                state[5] += len(ids)
                state[6] += sum(mask)
            if out:
                yield flush()
        close()
        if out:
            yield flush()

    return in_sequence(pieces).mapInArrow(run, schema)


def _arrow(schema: StructType, first: pa.DataType) -> pa.Schema:
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string()}
    return pa.schema([(schema.names[0], first)] + [(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields[1:]])
