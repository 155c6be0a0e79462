"""The pipeline against its stages' plain versions, one after the other."""

import re

from odd_rows import odd, ordered  # noqa: F401
from pyspark.sql import functions as F
from test_tables import brute_components, brute_fingerprint, brute_lines, brute_phrases, brute_targets, hashes
from test_texts import brute_quality

import corpus_pipeline
from tarn.llm.common import landed
from tarn.llm.lines import MIN_WORDS
from tarn.llm.quality import Bands, measure

WORD = re.compile(r"[^\x20\x09-\x0D]")


def rows_of(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in df.collect()]


def brute_keep(rows):
    import zstandard

    packer = zstandard.ZstdCompressor(level=Bands().level)
    return [r for r in rows if not brute_quality(r[1])[5] and measure((r[1] or "").encode(), Bands(), packer)[-1]]


def brute_one_of_each(spark, rows):
    h = {r[0]: r[1] for r in spark.createDataFrame([(r[1],) for r in rows], "text string").select("text", F.xxhash64("text")).collect()}
    fps = {r[1]: brute_fingerprint(r[1]) for r in rows}
    distinct = sorted(set(fps.values()))
    of = dict(zip(distinct, brute_components(distinct, lambda a, b: bin(a ^ b).count("1") <= 4)))
    best = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, h[r[1]])):
        best.setdefault(of[fps[r[1]]], r)
    return list(best.values())


def check(spark, docs, sf, rows):
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "SimHash near-dedup", "benchmark decontamination", "mixing sources"]
    now = landed(stages["quality rules"](spark, docs, sf), "t")
    rows = brute_keep(rows)
    assert ordered(rows_of(now)) == ordered(rows) and rows

    hashes.update({r[0]: (r[1], r[2]) for r in now.select("text", F.xxhash64("text"), F.hash("text", F.length("text"))).collect()})
    cut = list(brute_lines([r[:2] for r in rows], MIN_WORDS))
    rows = [(r[0], t, r[2], r[3], len(t) if n else r[4]) for r, (_, t, n) in zip(rows, cut) if not n or WORD.search(t)]
    now = landed(stages["line dedup"](spark, now, sf), "t")
    assert ordered(rows_of(now)) == ordered(rows)

    rows = brute_one_of_each(spark, rows)
    now = landed(stages["SimHash near-dedup"](spark, now, sf), "t")
    assert ordered(rows_of(now)) == ordered(rows)

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = [found[-1] for found in brute_phrases([r[:2] for r in rows], items)]
    rows = [r for r, bad in zip(rows, dirty) if not bad]
    now = landed(stages["benchmark decontamination"](spark, now, sf), "t")
    assert ordered(rows_of(now)) == ordered(rows)

    got = stages["mixing sources"](spark, now, sf).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1]))
    want = brute_targets(sizes)
    for source, target in want.items():
        assert abs(sum(r["taken"] for r in got if r["source"] == source) - target) <= 0.5 + 1e-6


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    check(spark, docs, sf, rows_of(docs))


def test_stages_on_odd_rows(spark, sf, odd):
    docs = odd.withColumn("lang", F.lit(None).cast("string")).withColumn(
        "source", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("s"), F.col("doc_id") % 3))).withColumn("n_chars", F.length("text").cast("long"))
    check(spark, docs, sf, rows_of(docs))


def test_run_equals_the_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = landed(stage(spark, docs, sf), "t")
    assert ordered(corpus_pipeline.run(spark, sf).collect()) == ordered(docs.collect())


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.collect() == []
