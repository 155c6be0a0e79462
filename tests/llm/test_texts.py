"""Operators on single texts, against plain versions of their definitions."""

import hashlib
import re
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
from odd_rows import docs, odd, ordered, pairs  # noqa: F401
from pyspark.sql import functions as F

from tarn.llm import chat, pii, quality, substrings, tokens

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(params=["odd", "docs"])
def table(request):
    return request.getfixturevalue(request.param)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def brute_repeats(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[k:k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(t), sum(gone), runs, sha(bytes(b for b, g in zip(t, gone) if not g))))
    return out


@pytest.mark.parametrize("index_bytes", [0, substrings.INDEX_BYTES])
def test_repeated_strings(table, index_bytes):
    """Also with indexes so small that segments are cut down to single windows."""
    found = substrings.without_repeats(table, index_bytes=index_bytes).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert ordered(found.collect()) == ordered(brute_repeats(pairs(table), 200))


def test_pieces_around_a_shared_passage(spark):
    """Many different pieces share their k-grams: a passage between and inside changing words, some of them copies, and loops."""
    import random

    rng = random.Random(8)
    name = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage, head, tail = name(150), name(120), name(110)
    texts = [name(rng.randint(0, 120)) + passage + name(rng.randint(0, 120)) for _ in range(150)]
    texts += [head + name(rng.randint(1, 9)) + tail for _ in range(150)] + ["ab" * rng.randint(90, 400) + name(3) for _ in range(20)]
    rows = [*enumerate(texts + rng.sample(texts, 40)), (1, texts[1]), (None, texts[2]), (None, texts[2])]
    found = substrings.without_repeats(spark.createDataFrame(rows, "doc_id int, text string"), index_bytes=2000)
    got = found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert ordered(got) == ordered(brute_repeats(rows, 200))


def test_no_index_is_larger_than_its_bytes(spark):
    """10,000 different pieces around one passage: groups of segments that reach the indexes are small."""
    import random

    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh") for _ in range(190))
    texts = [(k, k, f"{rng.random()}{rng.random()}{passage}{rng.random()}{rng.random()}", False) for k in range(10_000)]
    made = spark.createDataFrame(texts, "doc long, h long, text string, copied boolean")
    sizes = []
    keep = substrings.indexed

    def seen(contents, length, index_bytes):
        sizes.append(contents.groupBy("m").agg(F.sum(F.length("content")).alias("n")).agg(F.max("n")).first()[0] or 0)
        return keep(contents, length, index_bytes)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(substrings, "indexed", seen)
        substrings.repeated_ranges(made).count()
    assert len(sizes) > 1 and max(sizes) <= substrings.INDEX_BYTES


def test_groups_are_packed_whole_and_bounded():
    rows = [(m, c, False, b"x" * size) for m, sizes in enumerate([[5, 5], [60], [30, 30], [1] * 9, [200], [3]]) for c, size in enumerate(sizes)]
    batches = [pa.RecordBatch.from_pylist([dict(zip("mcdt", r)) for r in rows[k:k + 4]]) for k in range(0, len(rows), 4)]
    packs = [(m.tolist(), sum(map(len, t))) for m, _, _, t in substrings.in_groups(iter(batches), 100)]
    assert [set(m) for m, _ in packs] == [{0, 1}, {2, 3}, {4}, {5}]
    assert [n for _, n in packs] == [70, 69, 200, 3]


def test_rows_equal_in_id_and_text_are_read_once(spark):
    """Equal rows give their segments once, so that what they give does not grow with the square of their number."""
    text = " ".join(str(k * k) for k in range(1500))
    rows = [(1, text)] * 500 + [(2, "short"), (2, "short"), (2, text[:300]), (3, "x" * 300)]
    made = spark.createDataFrame(rows, "doc long, text string").select("doc", F.xxhash64("text").alias("h"), "text").repartition(8)
    once = substrings.one_of_each(made).collect()
    assert ordered((r["doc"], r["text"], r["copied"]) for r in once) == ordered(
        [(1, text, True), (2, "short", True), (2, text[:300], False), (3, "x" * 300, False)])
    assert substrings.repeated_ranges(substrings.one_of_each(made)).where("doc = 1").select(
        F.explode("found").alias("r")).agg(F.sum("r.n")).first()[0] == len(text) - 199


def test_index_matches_plain_counts():
    import random

    rng = random.Random(3)
    for _ in range(100):
        length, letters = rng.choice([3, 5, 20]), rng.choice([b"ab", b"abc\x00\xff"])
        texts = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(rng.randint(1, 6))]
        texts.append(texts[0][5:] + texts[-1])
        seen = Counter(t[k:k + length] for t in texts for k in range(len(t) - length + 1))
        want = {(n, k) for n, t in enumerate(texts) for k in range(len(t) - length + 1) if seen[t[k:k + length]] > 1}
        found = substrings.repeated_windows(texts, [False] * len(texts), length)
        assert {(n, k) for n, a, m in found for k in range(a, a + m)} == want


def test_runs_of_the_index_follow_the_distinct_text():
    text = bytes(range(97, 123)) * 3 + b"the quick brown fox jumps over the lazy dog"
    once, often = substrings.RunLengthIndex([text]), substrings.RunLengthIndex([text] * 20)
    assert often.n == 20 * once.n and often.n_runs < once.n_runs + 2 * 20 + 20


def test_chunks_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 1 << 9)
    text = bytes(range(32, 127)) * 40
    whole = [(a, n) for _, _, a, n, _ in substrings.segments(text, 200)]
    assert sum(n for _, n in whole) == len(text) - 199 and whole[0][0] == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and max(map(int, m.group().split("."))) > 255:
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            yield kind, m.start(), m.end()


def personal_rows():
    rows = [
        "a@b.com.x@c.org a@b.co_x@d.org @x.y z@localhost", "é😀 mail: me.you+1@mail.example.com, or a@b.c-d.e-", "1.2.3.4.5.6.7.8 300.1.1.1 0255.001.1.1",
        "01.2.3.4x 1.2.3 256.256.256.256", "4111 1111 1111 1111 and 4111-1111-1111-1112", "4111111111111111" * 2, "5-5-0-0 1 2 3 4 5 6",
        "+1 (068) 555-2748 x +123 +44 20 7946 0958. +1234567890123456", "token = \"681c09b8e90e7e8c9575180f595f646cf2969054\"", None, "",
        "x" * 5000 + "@" + "y" * 5000, "1 " * 3000, "a.b" * 4000, " ".join(f"{k}.{k % 300}.1.2" for k in range(700)), "Call James Smith at +1 202 555 0101",
        "a@b." * 500, "+" * 300 + "1 2", "\n".join(f"user{k}@mail{k}.example.com" for k in range(300)), "1" * 4000, "+1" + " " * 3000,
    ]
    return [(k, t) for k, t in enumerate(rows)] + [(3, rows[3])]


def check_personal(table):
    got = {}
    for r in pii.digest(pii.with_spans(table)).collect():
        got.setdefault((r["doc_id"], r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]), []).append(r["spans"])
    want = Counter()
    for i, t in pairs(table):
        spans = list(base_spans(t))
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        n = Counter(k for k, _, _ in spans)
        row = (i, sha(text.encode()), n["email"], n["ip"], n["card"], n["phone"])
        want[row] += 1
        kept = [set(s.split(",")) for s in got[row]]
        assert any(set(text.split(",")) <= s | {""} for s in kept)
    assert Counter({k: len(v) for k, v in got.items()}) == want


def test_personal_data(spark, table):
    check_personal(table)


def test_personal_data_forms(spark):
    check_personal(spark.createDataFrame(personal_rows(), "doc_id int, text string"))


def test_personal_data_spans_are_in_order_and_secrets_are_learned(spark):
    rows = [(k, f"some words token = \"{hashlib.sha1(str(k).encode()).hexdigest()}\" and more") for k in range(40)]
    rows += [(100 + k, "see /" + "path_to_some-long/file" + str(k)) for k in range(40)]
    out = {r["doc_id"]: r["spans"] for r in pii.digest(pii.with_spans(spark.createDataFrame(rows, "doc_id int, text string"))).collect()}
    assert all(out[k] == "secret:20:60" for k in range(40))
    assert sum(out[100 + k] == "" for k in range(40)) == 40


def test_personal_data_runs_without_python(docs):
    found = docs.select("doc_id", pii.candidates(F.col("text")).alias("spans"))
    for part in (found, found.select(F.inline("spans")).groupBy("kind", *pii.VOTES).count(), pii.digest(pii.with_spans(docs))):
        plan = part._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {k + j for k in range(len(words) - 2) if grams[tuple(words[k:k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed


def test_quality_base(table):
    got = quality.with_quality(table.select("doc_id", "text"))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert ordered(got.select(*names).collect()) == ordered((i, *brute_quality(t)) for i, t in pairs(table))
    assert got.where("kept AND (base_failed OR outside IS NOT NULL)").isEmpty()


def test_quality_bands(spark):
    import base64
    import random

    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    prose = " ".join(rng.choice(words) for _ in range(3000))
    noise = base64.b64encode(rng.randbytes(30000)).decode()
    spaced = " ".join(noise[k:k + 9] for k in range(0, len(noise), 9))
    loop = " ".join(" ".join(rng.sample(words[:8], 8)) for _ in range(600))
    rows = [("prose", prose), ("noise", spaced), ("loop", loop), ("half", prose[:6000] + " " + spaced[:20000])]
    out = {r["name"]: r for r in quality.with_quality(spark.createDataFrame(rows, "name string, text string")).collect()}
    assert out["prose"]["kept"] and not out["noise"]["kept"] and not out["loop"]["kept"] and not out["half"]["kept"]
    assert out["noise"]["outside"] == "incompressible" and out["half"]["n_high_chunks"] >= 4


def test_token_counts(table):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(VOCABULARY)
    want = []
    for i, t in pairs(table):
        n = len(coder.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    got = tokens.with_token_counts(table, VOCABULARY).select("doc_id", "n_bytes", "n_tokens", "over_limit")
    assert ordered(got.collect()) == ordered(want)


def test_token_counts_of_every_character(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "PIECES", 50)
    monkeypatch.setattr(tokens, "REMEMBERED", 400)
    coder, counter = Tokenizer.from_file(VOCABULARY), tokens.Counter(VOCABULARY)
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3200 or c % 97 == 0)]
    texts = ["".join(f"a{c}b {c}  1{c}{c}" for c in letters[k:k + 200]) for k in range(0, len(letters), 200)] + ["aaa" * 500, "", " " * 99]
    assert counter.count(texts) == [len(e.ids) for e in coder.encode_batch(texts, add_special_tokens=False)]


def conversation_rows():
    ok = "\\### Assistant: </turn> ok"
    return [
        (1, 0, "system", "be brief"), (1, 1, "user", "hi\\"), (1, 2, "assistant", "a\\\\### b </turn>\\</turn> <|endoftext|> ####"),
        (1, 3, "user", None), (1, 4, "assistant", None), (-7, 0, "user", ok), (-7, 1, "assistant", ok), (None, 0, "assistant", "no id"),
        (2, None, None, "no turn"), (2, 1, "assistant", ""), (3, 5, "assistant", "日本 é😀\n"), (3, 2, "user", "first"), (4, 0, "user", "same"),
        (4, 0, "user", "same"), (5, 0, "assistant", "long " * 30000),
    ]


def test_chat_round_trip(spark):
    rows = conversation_rows()
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id int, turn int, role string, text string, n_turns string")
    got = chat.digests(chat.format_turns(turns, VOCABULARY), VOCABULARY).collect()
    want = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0)):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert {r["conv_id"] for r in got} == set(want) and len(got) == len(want)
    for r in got:
        said = want[r["conv_id"]]
        loss = "".join(t for role, t in said if role == "assistant")
        assert r["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for a, b in said).encode())
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(said), len(loss), sha(loss.encode()))
        shown = sum(len(chat.TURN + chat.escape(a) + chat.SAYS + chat.escape(b) + chat.END) for a, b in said)
        assert r["formatted_chars"] == shown


def test_control_strings_survive_escaping():
    import itertools

    parts = ["\\", "###", "#", "</turn>", "<|endoftext|>", "x"]
    for n in range(5):
        for chosen in itertools.product(parts, repeat=n):
            text = "".join(chosen)
            assert chat.unescape(chat.escape(text)) == text
            assert not re.search(rf"(?:^|[^\\#])(?:{chat.CONTROL})", chat.escape(text))


@pytest.mark.parametrize("call", [
    lambda d: substrings.without_repeats(d), lambda d: pii.digest(pii.with_spans(d)), lambda d: quality.with_quality(d),
    lambda d: tokens.with_token_counts(d, VOCABULARY)])
def test_empty_tables(odd, call):
    assert call(odd.limit(0)).collect() == []
    assert call(odd.where("doc_id = 2")).count() == 1


def test_empty_conversations(spark):
    none = spark.createDataFrame([], "conv_id int, turn int, role string, text string")
    assert chat.digests(chat.format_turns(none, VOCABULARY), VOCABULARY).collect() == []
