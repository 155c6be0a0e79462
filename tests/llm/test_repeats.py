"""The Jaccard join, phrase collocations and periodic runs, against plain versions of their definitions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from odd_rows import docs, odd, ordered, pairs  # noqa: F401
from pyspark.sql import functions as F

from tarn.llm import collocations, jaccard, lookups, periods, texts
from tarn.llm.queries import QUERIES


@pytest.fixture(params=["odd", "docs"])
def table(request):
    return request.getfixturevalue(request.param)


@pytest.fixture(params=[False, True])
def many(request, monkeypatch):
    """Once as it is, once with very small batches and parts."""
    if request.param:
        monkeypatch.setattr(lookups, "TEXT_BYTES", 40_000)
        monkeypatch.setattr(lookups, "PART_KEYS", 4000)
        monkeypatch.setattr(collocations, "PART_BYTES", 100_000)


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def test_lower_case_of_slices():
    whole = pa.array(["ÀB cD", None, "", "xYZ", "É é"] * 3)
    for k in range(15):
        assert texts.lowered(whole.slice(k, 4)).to_pylist() == [lower(t) for t in whole.slice(k, 4).to_pylist()]


def shingles(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(" ".join(w[k:k + size]) for k in range(max(len(w) - size, 0) + 1)) if w else frozenset()


def brute_jaccard(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return [(i, len(sets[k]), least.get(top(k))) for k, (i, _) in enumerate(rows)]


def test_jaccard(table, many):
    assert ordered(jaccard.near_duplicates(table).collect()) == ordered(brute_jaccard(pairs(table)))


def test_jaccard_of_chains_and_shared_passages(spark, many):
    """Near copies in chains, around the threshold, of every size, with a passage that many hold."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(25))
    rows = []
    for group in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 20, 60, 150]))]
        for _ in range(12):
            rows.append((len(rows), " ".join(words) + (" " + passage if group % 2 else "")))
            at = rng.randrange(len(words))
            words = words[:at] + [rng.choice(vocabulary) for _ in range(rng.randint(0, 1 + len(words) // 30))] + words[at + rng.randint(0, 2):] or ["x"]
    want = brute_jaccard(rows)
    assert 12 < len({c for _, _, c in want}) < 100
    assert ordered(jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == ordered(want)


def test_marks_differ_in_no_more_bits_than_sets_in_shingles():
    rng = random.Random(4)
    words = [str(rng.randrange(10**6)) for _ in range(90)]
    texts = [" ".join(w if rng.random() > p else "x" for w in words) for p in (0, 0, 0.01, 0.05, 0.2, 0.5)] + ["", "a b", *[" ".join(words[:k]) for k in (3, 4, 80)]]
    sets = jaccard.Sets(pa.array(texts), 4)
    marks = np.array(sets.marks()).T
    for a in range(len(texts)):
        for b in range(len(texts)):
            bits = sum(int(x ^ y).bit_count() for x, y in zip(marks[a].view(np.uint64).tolist(), marks[b].view(np.uint64).tolist()))
            assert bits <= len(set(sets.of(a).tolist()) ^ set(sets.of(b).tolist()))


def test_near_copies_below_the_threshold_are_no_candidates(spark, monkeypatch):
    """A group of texts that share most words, no two of them similar: the last turn's pairs do not grow with its square."""
    rng = random.Random(6)
    words = [str(rng.randrange(10**6)) for _ in range(120)]
    texts = [list(words) for _ in range(80)]
    for text in texts:
        for at in rng.sample(range(5, 115), 2):
            text[at] = str(rng.randrange(10**6))
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    seen, across = [], jaccard.across

    def counted(*args):
        found = across(*args)
        seen.append(found.count())
        return found

    monkeypatch.setattr(jaccard, "across", counted)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert ordered(got.collect()) == ordered(brute_jaccard(rows))
    assert seen[0] < 80, seen


def test_turns_without_links_run_few_jobs(spark):
    """The driver holds a plan and threads for each job: a turn that links nothing new adds no rounds of components."""
    rng = random.Random(9)
    words = [str(rng.randrange(10**6)) for _ in range(60)]
    texts = [" ".join(words), " ".join(words[:-1])] + [" ".join([*words[:9], *(str(rng.randrange(10**6)) for _ in range(40))]) for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(texts)]
    context = spark.sparkContext
    context.setJobGroup("few jobs", "near duplicates")
    try:
        got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(context.statusTracker().getJobIdsForGroup("few jobs"))
    assert ordered(got.collect()) == ordered(brute_jaccard(rows))
    assert jobs < 110, jobs


def join_rows(node):
    """The most rows that a join of an executed plan made."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return join_rows(node.executedPlan())
    below = [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(k) for k in range(node.children().size())]
    own = node.metrics().apply("numOutputRows").value() if "Join" in node.nodeName() else 0
    return max([own, *map(join_rows, below)])


def test_the_last_turn_finds_a_pair_of_near_copies_about_once(spark, monkeypatch):
    """Texts around the threshold, with marks alike: no join makes a row for each shingle that two of them share."""
    rng = random.Random(8)
    words = [str(rng.randrange(10**6)) for _ in range(120)]
    rows = []
    for k in range(90):
        at = rng.randrange(5, 112)
        rows.append((k, " ".join([*words[:at], *[str(rng.randrange(10**6)) for _ in range(2)], *words[at + 2:]])))
    seen, across = [], jaccard.across

    def counted(*args):
        found = across(*args)
        found.collect()
        seen.append(join_rows(found._jdf.queryExecution().executedPlan()))
        return found

    monkeypatch.setattr(jaccard, "across", counted)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute_jaccard(rows)
    assert 1 < len({c for _, _, c in want}) < 90
    assert ordered(got.collect()) == ordered(want)
    assert seen[0] < len(rows) * (len(rows) - 1) / 2, seen


def test_prefixes_keep_every_similar_pair():
    """Two similar sets share as many of their prefixes as the lesser of both asks for, whatever the frequencies."""
    rng = random.Random(3)
    for _ in range(200):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.randint(4, 60))]
        other = list(words)
        for _ in range(rng.randint(0, 2)):
            other[rng.randrange(len(other))] = "new"
        sets = jaccard.Sets(pa.array([" ".join(words), " ".join(other)]), 4)
        a, b = (set(sets.of(k).tolist()) for k in (0, 1))
        if a == b or 100 * len(a & b) < 85 * len(a | b):
            continue
        frequency = {h: 2 ** rng.randint(1, 12) for h in a | b}
        matches, tokens, places = jaccard.prefixes(sets, np.array([frequency[h] for h in sets.h.tolist()]), 85)
        asked = min(matches[:2])
        ends = [int(n - -(-n * 85 // 100) + asked) for n in sets.n[:2]]
        near = [{t for t, p in zip(tokens[k].tolist(), places[k].tolist()) if p < ends[k]} for k in (0, 1)]
        assert len(near[0] & near[1]) >= asked


def brute_collocations(rows, first=2000):
    f, words = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang or "und"] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i:i + k])] += 1
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= 30}
    most = Counter()
    for (lang, p), a in found.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                most[lang, p[i:i + k]] = max(most[lang, p[i:i + k]], a)
    out = []
    for (lang, p), a in found.items():
        if (lang, p) in most and 100 * most[lang, p] >= 80 * a:
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, l, r, words[lang], score))
    ranked = []
    for lang in sorted({r[0] for r in out}):
        best = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:first]
        ranked += [(r[0], k + 1, *r[1:]) for k, r in enumerate(best)]
    return ranked


@pytest.fixture(scope="module")
def spoken(spark, sf):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    odd = [(None, None), ("en", None), (None, ""), (None, ". , ;\n"), ("xx", "The " * 40), ("xx", "a b c d. " * 31), (None, "a b c d e f " * 31),
           ("und", "A B\tC\x0bd e\x85f " * 20), ("a b", "x. y! z " * 40), ("é", "ß é, 日本 語 " * 33), ("en", "one two three"), ("en", "one two three")]
    return rows * 3 + odd


def test_collocations(spark, spoken, many):
    made = spark.createDataFrame([(*r, "old", 1) for r in spoken], "lang string, text string, phrase string, n int")
    assert ordered(collocations.collocations(made).collect()) == ordered(brute_collocations(spoken))
    assert ordered(collocations.collocations(made, first=3).collect()) == ordered(brute_collocations(spoken, 3))


def test_collocations_of_nothing(spark, odd):
    empty = odd.withColumn("lang", F.lit("en")).limit(0)
    assert collocations.collocations(empty).collect() == []


def test_parse_gives_every_phrase_to_one_chunk():
    """Positions of the chunks without their overlap are the positions of the texts; repeated passages share chunks."""
    rng = random.Random(4)
    passage = " ".join(f"w{rng.randrange(50)}" for _ in range(400))
    texts = [f"{rng.random()} {passage} {rng.random()}" for _ in range(20)]
    table = collocations.parse(pa.array(["en"] * 20), pa.array(texts))
    grams, weight = collocations.of_dictionary(table)
    assert weight.sum() == 20 * (400 + 2 * 3)  # a decimal point ends a piece and is a place of its own
    assert len(weight) < 20 * 400 / 3


def brute_runs(w):
    n, seen, out = len(w), set(), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def periodic_words(rng):
    """Random, Fibonacci, Thue-Morse and nested repetitions, and regions of one period one after another."""
    kind = rng.randrange(5)
    if kind == 0:
        return [rng.choice("ab"[:rng.randint(1, 2)]) for _ in range(rng.randint(0, 150))]
    if kind == 1:
        a, b = ["a"], ["a", "b"]
        for _ in range(rng.randint(1, 9)):
            a, b = b, b + a
        return b[:rng.randint(1, 200)]
    w = []
    if kind == 2:
        unit = [rng.choice("abc") for _ in range(rng.randint(1, 4))]
        for _ in range(rng.randint(1, 5)):
            w += unit * rng.randint(1, 25) + unit[:rng.randint(0, len(unit))] + [rng.choice("abcd")] * (rng.random() < .3)
        return w[:300] * rng.randint(1, 2)
    if kind == 3:
        for _ in range(rng.randint(1, 6)):
            w = w * rng.randint(1, 4) + [rng.choice("abc") for _ in range(rng.randint(0, 6))]
        return w[:350]
    w = ["a"]
    for _ in range(rng.randint(1, 8)):
        w = w + [{"a": "b", "b": "a"}[x] for x in w] if rng.random() < .5 else w + w
    return w[:400]


@pytest.mark.parametrize("seed", range(5))
def test_runs(seed):
    rng = random.Random(seed)
    texts = [periodic_words(rng) for _ in range(150)]
    n, runs, kept = periods.batch_runs(pa.array([" ".join(w) for w in texts]))
    for w, count, found, left in zip(texts, n.tolist(), runs, kept.to_pylist()):
        want = brute_runs(w)
        assert (count, [tuple(r) for r in found.tolist()], left) == (len(w), want, collapsed(w, want)), "".join(w)


def test_runs_of_long_texts():
    """A very periodic text takes no longer than another one of its length."""
    for w, runs in ((["a"] * 300_000, 1), ((["a", "b"] * 20_000 + ["a"] + ["a", "b"] * 20_000), None), ([str(k) for k in range(100_000)] * 3, 1)):
        _, found, _ = periods.batch_runs(pa.array([" ".join(w)]))
        assert len(found[0]) == runs if runs else len(found[0]) > 19_000


def planted(i, words):
    if i is None or not words:
        return words
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (k - a) % p] for k in range(a, n)]


def brute_digest(rows):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, text in rows:
        w = planted(i, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        runs = brute_runs(w)
        s, length, q = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        yield i, len(runs), s, length, q, 1000 * length // q if runs else None, sha(lines), sha(collapsed(w, runs))


def test_run_digests(table):
    rows = [(i, t) for i, t in pairs(table) if t is None or len(t) < 20_000]
    short = table.where("text IS NULL OR length(text) < 20000").select("doc_id", "text")
    assert ordered(periods.digest(periods.with_runs(periods.planted(short))).collect()) == ordered(brute_digest(rows))


def test_empty_tables(odd):
    assert jaccard.near_duplicates(odd.limit(0)).collect() == []
    assert periods.with_runs(odd.limit(0)).collect() == []


def test_queries_take_whole_tables(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert QUERIES["op11_jaccard_join"](spark, sf).count() == n
    assert QUERIES["op13_periodic_runs"](spark, sf).count() == n
