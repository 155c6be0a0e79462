"""Operators over whole tables, against plain versions of their definitions."""

import hashlib
import re
from collections import Counter
from urllib.parse import unquote, urlsplit

import pyarrow.parquet as pq
import pytest
import xxhash
from odd_rows import docs, odd, ordered, pairs  # noqa: F401
from pyspark.sql import functions as F

from tarn.llm import components, decontaminate, lines, mixing, simhash, urls
from tarn.llm.components import roots
from tarn.llm.queries import CONTROL_CASE, ORACLE, QUERIES, URL_RULES


@pytest.fixture(params=["odd", "docs"])
def table(request):
    return request.getfixturevalue(request.param)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_phrases(rows, items, window=10):
    windows = {}
    for item, text in items:
        w = words_of(text)
        for k in range(max(len(w) - window, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[k:k + window]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    for i, text in rows:
        w, hit, found = words_of(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        yield i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def items(spark, sf):
    rows = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    odd = [(9001, None), (9002, ""), (9003, "!!"), (9004, "one two"), (9005, "One"), (9005, "one"), (None, "The " * 30)]
    return spark.createDataFrame(rows + odd, "item_id long, text string").cache()


@pytest.mark.parametrize("part", [1 << 24, 4000])
def test_phrases(table, items, part):
    found = decontaminate.digest(decontaminate.find_phrases(table, items, part_bytes=part)).drop("n_near_items")
    want = brute_phrases(pairs(table), [(r["item_id"], r["text"]) for r in items.collect()])
    assert ordered(found.collect()) == ordered(want)


def test_phrase_proximity(spark):
    phrase = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, phrase), (2, phrase.replace("delta", "delta so")), (3, " ".join(reversed(phrase.split()))), (4, "alpha beta gamma delta"),
            (5, phrase.replace("epsilon", "epsilon " + "x " * 30))]
    got = decontaminate.find_phrases(spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame([("q", phrase)], "item_id string, text string"))
    out = {r["doc_id"]: (r["item_ids"], r["near_item_ids"], [tuple(s) for s in r["hit_spans"]]) for r in got.collect()}
    assert out == {1: (["q"], [], [(0, 10)]), 2: ([], ["q"], []), 3: ([], ["q"], []), 4: ([], [], []), 5: ([], [], [])}


def test_postings_in_small_row_groups(spark):
    """A row of postings is some MB, so writer and reader must not take a hundred of them at once; all rows are found again."""
    text = F.expr("array_join(transform(sequence(1, 250), k -> hex(hash(id, k))), ' ')")
    rows = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))
    index = decontaminate.index_documents(rows)
    files = [pq.ParquetFile(unquote(urlsplit(f).path)).metadata for f in index.inputFiles()]
    groups = [m.row_group(g) for m in files for g in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) > 4 and max(g.total_byte_size for g in groups) < 12 << 20
    kinds = dict(index.dtypes)
    assert [kinds[c] for c in ("terms", "lengths", "counts", "places")] == ["binary"] * 4
    asked = rows.where("doc_id = 4321").select(F.lit("q").alias("item_id"), F.substring_index("text", " ", 12).alias("text"))
    found = decontaminate.digest(decontaminate.search(index, asked).withColumnRenamed("doc", "doc_id")).select("doc_id", "n_words", "n_hit").collect()
    assert sorted(map(tuple, found)) == [(k, 250, 12 if k == 4321 else 0) for k in range(6000)]


def test_documents_without_hits(odd, items):
    assert ordered(decontaminate.without_hits(odd, items.limit(0)).collect()) == ordered(odd.collect())
    want = [r for r, found in zip(odd.collect(), brute_phrases(pairs(odd), [(r["item_id"], r["text"]) for r in items.collect()])) if not found[-1]]
    assert ordered(decontaminate.without_hits(odd, items).collect()) == ordered(want)
    assert decontaminate.find_phrases(odd.limit(0), items).collect() == []


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(w[k:k + 4]) for k in range(max(len(w) - 4, 0) + 1)] if w else []
    values = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def brute_components(points, near):
    root = list(range(len(points)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(points)):
        for b in range(a):
            if near(points[a], points[b]):
                root[top(a)] = top(b)
    return [top(k) for k in range(len(points))]


def check_components(rows, got):
    """rows: (id, fingerprint)."""
    distinct = sorted({f for _, f in rows})
    of = dict(zip(distinct, brute_components(distinct, lambda a, b: bin(a ^ b).count("1") <= 4)))
    least = {}
    for i, f in rows:
        if i is not None:
            least[of[f]] = min(i, least.get(of[f], i))
    assert ordered(got) == ordered((i, f"{f:016x}", least.get(of[f])) for i, f in rows)


@pytest.mark.parametrize("large", [simhash.LARGE, 3])
def test_simhash(table, large, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", large)
    rows = [(i, brute_fingerprint(t)) for i, t in pairs(table)]
    check_components(rows, simhash.digest(simhash.near_duplicates(table)).collect())


def test_links_of_dense_groups(spark, monkeypatch):
    """Balls of fingerprints around a few centres, and chains between some."""
    import random

    rng = random.Random(8)
    points = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(150):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
            points.add(x)
    chain = rng.getrandbits(64)
    for _ in range(30):
        for b in rng.sample(range(64), 4):
            chain ^= 1 << b
        points.add(chain)
    points = sorted(points)
    want = brute_components(points, lambda a, b: bin(a ^ b).count("1") <= 4)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    for large in (simhash.LARGE, 10):
        monkeypatch.setattr(simhash, "LARGE", large)
        tree = roots(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")))
        up = {r["u"]: r["v"] for r in tree.collect()}
        got = [up.get(s, s) for s in signed]
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_covering_sets():
    from itertools import combinations

    sets = [set(s) for s in simhash.covering(4, 3)]
    assert len(sets) == 20
    assert all(any(s <= set(four) for s in sets) for four in combinations(range(8), 4))


def test_long_text_in_runs(monkeypatch):
    from tarn.llm import common

    text = ("Ab cd  e\tf " * 500 + "x" * 99 + " y\n").encode()
    whole = simhash.fingerprint(text)
    original = common.word_runs
    monkeypatch.setattr(simhash, "word_runs", lambda t: original(t, 7))
    assert simhash.fingerprint(text) == whole == brute_fingerprint(text.decode())


def brute_lines(rows, min_words):
    docs = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    worded = []
    for d, (i, t) in enumerate(docs):
        kept = [(k, x) for k, x in enumerate(t.split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
        worded.append(kept)
    places = [(d, s) for d, k in enumerate(worded) for s in range(len(k))]
    by_line = {}
    for p in places:
        by_line.setdefault(worded[p[0]][p[1]][1], []).append(p)
    count = {x: len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in by_line}
    gone = {}
    for d, s in places:
        for e, q in by_line[worded[d][s][1]]:
            if (e, q) >= (d, s):
                continue
            n = total = 0
            while s + n < len(worded[d]) and q + n < len(worded[e]) and worded[d][s + n][1] == worded[e][q + n][1]:
                total += count[worded[d][s + n][1]]
                n += 1
            if total >= min_words:
                gone.setdefault(docs[d], set()).update(worded[d][s + j][0] for j in range(n))
    for i, t in rows:
        g = gone.get((i, t), ())
        yield i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in g), len(g)


hashes = {}


@pytest.mark.parametrize("min_words", [1, 5, 20])
def test_line_runs(spark, table, min_words):
    known = table.where("text IS NOT NULL").select("text", F.xxhash64("text"), F.hash("text", F.length("text")))
    hashes.update({r[0]: (r[1], r[2]) for r in known.collect()})
    got = lines.without_repeats(table, min_words=min_words).select("doc_id", "text", "n_removed")
    assert ordered(got.collect()) == ordered(brute_lines(pairs(table), min_words))


def test_boilerplate_lines_go(spark):
    """A repeated license line alone between lines of its own."""
    license = "This work is licensed under the GNU General Public License, version 3."
    rows = [(k, f"own first {k}\n{license}\nown last {k}") for k in range(4)]
    got = lines.without_repeats(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {0: 0, 1: 1, 2: 1, 3: 1}
    assert all((license in r["text"]) == (r["doc_id"] == 0) for r in got)


def test_suffix_ranks_sort_the_prefixes(spark):
    text = "\n".join("a b a b c a b a b c d".split())
    rows = spark.createDataFrame([(1, text), (2, text)], "doc int, text string")
    table = lines.suffix_ranks(lines.line_table(rows), 2)
    ranks = {(r["doc"], r["seq"]): (r["r0"], r["r1"], r["r2"]) for r in table.collect()}
    sequence = text.split("\n")
    for t, width in ((0, 1), (1, 2), (2, 4)):
        names = {}
        for (_, s), r in ranks.items():
            if s + width <= len(sequence):
                names.setdefault(tuple(sequence[s:s + width]), set()).add(r[t])
        assert all(len(v) == 1 and None not in v for v in names.values())
        assert len({next(iter(v)) for v in names.values()}) == len(names)


def brute_targets(sizes, most=3.0):
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        open_weight = sum(weight[s] for s in order if s not in capped)
        out = {s: most * sizes[s] if s in capped else left * weight[s] / open_weight for s in order}
        over = {s for s in order if s not in capped and out[s] > most * sizes[s]}
        if not over:
            return out
        capped |= over


def mixing_tables(spark, sf, odd):
    real = spark.read.parquet(f"{sf}/documents.parquet")
    yield real
    yield odd.withColumn("source", F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("s"), F.col("doc_id") % 5)))
    yield real.withColumn("source", F.when(F.col("doc_id") < 150, "hot").otherwise(F.concat(F.lit("é"), F.col("doc_id") % 9)))


def test_mixing(spark, sf, odd):
    mix = mixing.Mix(block=32, shard_blocks=16, buckets=4)
    for table in mixing_tables(spark, sf, odd):
        got = mixing.taken(mixing.mixture(table, mix)).collect()
        sizes = Counter()
        for i, t, s in table.select("doc_id", "text", "source").collect():
            sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        want, taken = brute_targets(dict(sizes)), Counter()
        assert len(got) == table.count()
        for r in got:
            assert r["source_size"] == sizes[r["source"]] and r["taken"] <= 3 * r["size"]
            assert r["target"] == pytest.approx(want[r["source"]])
            taken[r["source"]] += r["taken"]
        for s, t in want.items():
            assert abs(taken[s] - t) <= 0.5 + 1e-6
        again = mixing.taken(mixing.mixture(table.repartition(7), mix)).collect()
        assert ordered(again) == ordered(got)


def test_mixture_joins_to_the_taken_words(spark, sf):
    """Walks slots and pieces as a reader of the shards would."""
    mix = mixing.Mix(block=32, shard_blocks=16, buckets=4)
    mixed = mixing.mixture(spark.read.parquet(f"{sf}/documents.parquet"), mix)
    pieces = {}
    for r in mixed.pieces.collect():
        pieces.setdefault((r["source"], r["block"]), []).append(r)
    words, shards = Counter(), Counter()
    for s in mixed.slots.collect():
        block = sorted(pieces[s["source"], s["block"]], key=lambda r: r["from_word"])
        assert block[0]["from_word"] == 0 and all(a["to_word"] == b["from_word"] for a, b in zip(block, block[1:]))
        for r in block:
            words[r["doc_id"]] += max(0, min(r["to_word"], s["words"]) - r["from_word"])
        shards[s["shard"]] += 1
    assert {r["doc_id"]: r["taken"] for r in mixing.taken(mixed).collect() if r["taken"]} == {k: v for k, v in words.items() if v}
    mean = sum(shards.values()) / len(shards)
    assert len(shards) > 5 and all(abs(n - mean) < 6 * mean**0.5 for n in shards.values())


def test_shards_hold_the_words(spark, tmp_path):
    """Rows with null and repeated ids, each written out word by word."""
    rows = [(k % 3 if k % 4 else None, "ab"[k % 2], "".join(f"w{k}.{j}{' ' * (j % 3)}\n" for j in range(5 + k % 7 * 20))) for k in range(40)]
    table = spark.createDataFrame(rows, "doc_id int, source string, text string")
    mixed = mixing.mixture(table, mixing.Mix(block=32, shard_blocks=4, buckets=2))
    got = mixing.taken(mixed, f"{tmp_path}/shards").collect()
    written = spark.read.parquet(f"{tmp_path}/shards").collect()
    assert len({r["shard"] for r in written}) > 5
    of = {w: (i, s) for i, s, t in rows for w in t.split()}
    assert all({of[w] for w in r["text"].split()} == {(r["doc_id"], r["source"])} for r in written)
    assert all(r["text"] in t for r in written for _, _, t in rows if r["text"].split()[0] in t.split())
    slots = Counter()
    for r in written:
        slots[r["shard"], r["source"], r["slot"]] += len(r["text"].split())
    assert slots == {(s["shard"], s["source"], s["slot"]): s["words"] for s in mixed.slots.collect()}
    times = Counter(w for r in written for w in r["text"].split())
    assert max(times.values()) <= 3 and sum(times.values()) == sum(r["taken"] for r in got)
    small = next(r for r in got if r["size"])
    assert small["taken"] <= 3 * small["size"]


def test_permutations():
    import numpy as np

    for n in (1, 2, 3, 5, 64, 65, 1000):
        key = np.full(n, 12345 + n, np.uint64)
        to = mixing.permuted(np.arange(n), np.full(n, n), key)
        assert sorted(to.tolist()) == list(range(n))
        for at in {0, n // 2, n - 1}:
            assert mixing.place_of(int(to[at]), n, key[:1]) == at


def url_rows():
    rows = [
        None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.NET/En/1", "http://example.net/en/1", "http://a.example.net/en/", "http://net", "http://net/",
        "http://x.net?q=/en/", "http://x.net/a?b#c", "http://x.org/fr/2", "http://xorg/fr/2", "http://org/fr/", "http://é.example.com/de/x y", "http://example.com/DE/",
        "http://h.com//a///b", "a://b://c/d", "http://h.com/" + "/".join("abcdefghijkl"), "http://h.com/" + "z" * 40000, "http://notexample.com/de/1",
    ]
    return [(k, u) for k, u in enumerate(rows)] + [(5, rows[5]), (None, rows[6])]


def brute_url(url):
    if not url or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    rule = None
    for r, _ in sorted(URL_RULES, key=lambda x: len(x[0])):
        h, _, p = r.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            rule = r
    return host, path, rule, dict(URL_RULES).get(rule)


def test_url_rules(spark):
    pages = spark.createDataFrame([(*r, "x") for r in url_rows()], "page_id int, url string, host string")
    labelled = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "page_id int, bad int")
    got = urls.judged(pages, labelled, URL_RULES).collect()
    want = [(i, *brute_url(u)) for i, u in url_rows()]
    assert ordered(tuple(r)[:4] for r in got) == ordered(w[:4] for w in want)
    said = {(w[1], w[2]): w[4] for w in want}
    for r in got:
        assert r["verdict"] == (said[r["host"], r["path"]] or ("block" if r["purity"] < 0.5 else "allow"))
    assert urls.judged(pages.limit(0), labelled, URL_RULES).collect() == []
    assert urls.judged(pages, labelled.limit(0), URL_RULES).where("rule IS NULL AND verdict = 'block'").isEmpty()


def test_templates_follow_the_labels(spark):
    rows = []
    for k in range(400):
        kind = ("blog", "spam", "news", "shop")[k % 4]
        rows.append((k, f"http://big.com/{kind}/{k}/{'%x' % (k * 7919 + 2**40)}.html?s={k}", int(kind == "spam") if k % 3 == 0 else None))
    rows += [(1000 + k, f"http://other.com/a/{k}", 0) for k in range(30)]
    table = spark.createDataFrame(rows, "page_id int, url string, bad int")
    got = {r["page_id"]: r for r in urls.judged(table, table, []).collect()}
    assert {r["template"] for k, r in got.items() if k < 1000} == {"/spam/{n}/{id}.html", "/(blog|news|shop)/{n}/{id}.html"}
    assert all((r["verdict"] == "block") == (k % 4 == 1) for k, r in got.items() if k < 1000)
    assert all(r["verdict"] == "allow" for k, r in got.items() if k >= 1000)


def test_rates_in_small_steps_stay_apart(spark):
    """Every child is like its neighbours, but the first is not like the last."""
    for n, steps in ((30, [round(30 * k / 20) for k in range(21)]), (100, range(20, 81, 6))):
        rows = [(f"http://h.com/s{k:02}/a.html", int(j < bad)) for k, bad in enumerate(steps) for j in range(n)]
        table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id int, url string, bad int")
        spread = {}
        for r, (_, bad) in zip(sorted(urls.judged(table, table, []).collect(), key=lambda r: r["page_id"]), rows):
            spread.setdefault(r["template"], {}).setdefault(r["path"], []).append(bad)
        for paths in spread.values():
            rates = [sum(b) / n for b in paths.values()]
            assert max(rates) - min(rates) <= 1.96 * (0.5 / n) ** 0.5
        assert len(spread) > 3


def test_small_sections_and_deep_paths_are_branches(spark):
    rows = [(f"http://big.com/s{k % 100:02}/x{chr(97 + k // 100)}", int(k % 100 == 7)) for k in range(1200)]
    rows += [(f"http://deep.com/a/b/c/d/e/{'spam' if k % 2 else 'news'}/f/{k}/{'%x' % (k + 2**40)}", k % 2) for k in range(40)]
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id int, url string, bad int")
    got = {r["page_id"]: r for r in urls.judged(table, table, []).collect()}
    assert all((got[k]["verdict"] == "block") == bool(bad) for k, (_, bad) in enumerate(rows))
    assert {r["template"] for r in got.values()} == {
        "/s07/*", "/(s00|+98)/(xa|xb|xc|xd|xe|xf|xg|xh|xi|xj|xk|xl)", "/a/b/c/d/e/spam/f/{n}/{id}", "/a/b/c/d/e/news/f/{n}/{id}"}


@pytest.mark.parametrize("call", [
    lambda d: simhash.near_duplicates(d), lambda d: lines.without_repeats(d),
    lambda d: mixing.taken(mixing.mixture(d.withColumn("source", F.lit("a"))))])
def test_empty_tables(odd, call):
    assert call(odd.limit(0)).collect() == []
    assert call(odd.where("doc_id = 2")).count() == 1


def test_no_links(spark):
    assert roots(spark.createDataFrame([], "u long, v long")).collect() == []
    path = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100)]
    assert ordered(roots(spark.createDataFrame(path, "u long, v long")).collect()) == ordered([(k, 0) for k in range(1, 41)] + [(101, 100)])


def test_stars_are_written_once(spark, monkeypatch):
    """Links that are stars already need no round; others need rounds until they are."""
    written, landed = [], components.landed
    monkeypatch.setattr(components, "landed", lambda df, purpose: written.append(purpose) or landed(df, purpose))
    stars = [(k, k % 3) for k in range(3, 30)]
    assert ordered(roots(spark.createDataFrame(stars, "u long, v long")).collect()) == ordered(stars)
    assert len(written) == 1
    for more in ([(0, 1)], [(29, 28)], [(1, 40), (2, 40), (40, 41)], [(0, 0), (4, 4)]):
        want = {frozenset(c) for c in merged([*stars, *more])}
        rows = roots(spark.createDataFrame([*stars, *more], "u long, v long")).collect()
        assert sorted((r.u, r.v) for r in rows) == sorted((u, min(c)) for c in want for u in c if u != min(c))


def merged(links):
    """The components of the links, as sets."""
    out = []
    for link in links:
        touched = [c for c in out if c & set(link)]
        out = [c for c in out if not c & set(link)] + [set(link).union(*touched)]
    return out


def test_queries_and_sql(spark, sf):
    from compare import connect, rows_of

    con = connect(sf)
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES if n != "pipeline") == list(range(1, 14))
    for name, sql in ORACLE.items():
        if not sql or name == "pipeline":
            continue
        df, result = QUERIES[name](spark, sf), con.execute(sql)
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in result.description], result.fetchall()), name


def test_control_case(spark, sf):
    row = QUERIES["op9_chat_format"](spark, sf).where("conv_id = -7").first()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{CONTROL_CASE}\nassistant\n{CONTROL_CASE}\n".encode()).hexdigest()
    assert row["loss_sha256"] == hashlib.sha256(CONTROL_CASE.encode()).hexdigest()
