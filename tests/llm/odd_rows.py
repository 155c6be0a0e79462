"""Rows and fixtures that the tests of this folder share."""

import random

import pytest

# Names that the operators use for results or inside; a table may have them already.
CLASHING = ["n_bytes", "kept", "spans", "fp", "n_words", "n_tokens", "n_removed", "h", "m", "c", "first", "__text"]


def odd_rows():
    """(doc_id, text) with nulls, empty and long texts, repeated rows, ties, loops and copies."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 120))) for _ in range(12)]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 14))) for _ in range(40)]
    rows = [
        (None, None), (None, "no id"), (1, None), (2, ""), (3, " \t\n\v\f\r "), (4, "one"), (5, "one two"),
        (6, "a" * 700), (7, "ab" * 300), (8, "The " * 400), (9, "\n".join(["same line of text here"] * 30)),
        (10, prose[0]), (10, prose[0]), (10, prose[1]), (11, prose[0]), (12, prose[0] + " " + prose[2]), (13, prose[2] + prose[3]),
        (14, "x" + prose[4][5:]), (15, prose[4]), (16, prose[4].upper()), (17, "\x00\x01" + prose[5] + "\x85\xa0 　 日本語 😀"),
        (18, prose[5]), (19, "\n".join(lines[:20])), (20, "\n".join(lines[5:15]) + "\n\n" + "\n".join(lines[30:])),
        (21, "\n".join(lines[10:20] + lines[:10])), (22, "\n\n\n"), (23, " ".join(prose * 40)), (24, " ".join(prose * 40) + "!"),
        (25, "<|endoftext|>" + prose[6] + "<|endoftext|><|endoftext|>"), (26, prose[7] * 2), (27, "y" * 199), (28, "z" * 200),
    ]
    for k in range(60):
        a, b = rng.randint(0, 11), rng.randint(0, 11)
        cut = rng.randint(0, 300)
        rows.append((100 + k, prose[a][cut:cut + rng.randint(1, 600)] + "\n" + "\n".join(rng.sample(lines, 6)) + prose[b][:rng.randint(0, 400)]))
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with further columns, some of them named like results."""
    extra = [f"`{c}` string" for c in CLASHING]
    rows = [(i, t, *["old"] * len(CLASHING)) for i, t in odd_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(extra))


@pytest.fixture(scope="session")
def docs(spark, sf):
    """All documents of the smallest scale."""
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").cache()


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def key(row):
    return tuple((x is not None, str(x)) for x in row)


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=key)
