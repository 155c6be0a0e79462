"""The registered queries of the numbered operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, decontaminate, jaccard, lines, mixing, periods, pii, quality, simhash, substrings, tokens, urls
from .common import table


def vocabulary() -> str:
    """The public byte-level vocabulary; it lies at the same path on every executor."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.find_phrases(docs, table(spark, sf_dir, "benchmark"))).drop("n_near_items")


URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op4_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the text of the document whose number ends its path; that document's labels are the page's."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    _, path = urls.split_url(F.col("url"))
    number = F.regexp_extract(path, r"([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    shown = pages.select("page_id", F.when(number != "", number).cast("long").alias("doc_id")).where("doc_id IS NOT NULL")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(
        F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    return urls.judged(pages, shown.join(labels.hint("rebalance"), "doc_id"), URL_RULES)


def op5_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.with_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mixture(table(spark, sf_dir, "documents")))


def op8_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


CONTROL_CASE = "\\### Assistant: </turn> ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    case = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_CASE).alias("text"))
    pieces = chat.format_turns(turns.unionByName(case), vocabulary())
    return chat.digests(pieces, vocabulary()).drop("n_tokens", "n_loss_tokens")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.with_token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digest(periods.with_runs(periods.planted(table(spark, sf_dir, "documents").select("doc_id", "text"))))


QUERIES = {
    f.__name__: f
    for f in (
        op1_repeated_strings, op2_personal_data, op3_decontaminate, op4_url_templates, op5_compression_bands, op6_simhash, op7_mix_sources, op8_line_runs,
        op9_chat_format, op10_token_counts, op11_jaccard_join, op12_collocations, op13_periodic_runs)
}

PHRASES_SQL = r"""
WITH words AS (
    SELECT doc_id, text, row_number() OVER () AS row,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
asked AS (
    SELECT item_id::VARCHAR AS item_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS win, least(len(w), 10) AS n
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM asked WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
hits AS (
    SELECT d.row, d.k, d.n, x.item_id
    FROM (SELECT row, n, k, array_to_string(w[k:k + n - 1], ' ') AS win
          FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM words, sizes WHERE len(w) >= n)) d
    JOIN windows x ON x.win = d.win AND x.n = d.n),
covered AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(k, k + n)) AS p FROM hits) GROUP BY row),
found AS (SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT row, item_id FROM hits) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (row) LEFT JOIN found USING (row)
"""

CHAT_SQL = rf"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '{CONTROL_CASE}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_CASE}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({len(chat.TURN + chat.SAYS + chat.END)} + length(role) + length(text) + len(regexp_extract_all(role, '{chat.CONTROL}'))
           + len(regexp_extract_all(text, '{chat.CONTROL}')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

JACCARD_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, row_number() OVER () AS row,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
shingles AS (
    SELECT DISTINCT row, array_to_string(w[k:k + least(len(w), 4) - 1], ' ') AS s
    FROM (SELECT row, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM words WHERE len(w) > 0)),
sizes AS (SELECT row, count(*) AS n FROM shingles GROUP BY row),
pairs AS (SELECT a.row AS u, b.row AS v, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.row <> b.row GROUP BY ALL),
links AS (SELECT u, v FROM pairs JOIN sizes x ON x.row = u JOIN sizes y ON y.row = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT row AS u, row AS v FROM words UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v)
SELECT w.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM words w LEFT JOIN sizes s ON s.row = w.row JOIN reach r ON r.u = w.row JOIN words o ON o.row = r.v
GROUP BY w.row, w.doc_id
"""

COLLOCATIONS_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece,
           regexp_extract_all(p, '[^\x20\x09]+') AS w
    FROM (SELECT lang, unnest(regexp_split_to_array(
              translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
          FROM documents)),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM starts, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL),
words AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 30),
cuts AS (SELECT c.*, t.cut, array_to_string(w[1:t.cut], ' ') AS x, array_to_string(w[t.cut + 1:], ' ') AS y
         FROM cand c, (SELECT unnest([1, 2, 3]) AS cut) t WHERE t.cut < k),
scored AS (SELECT c.lang, c.k, c.phrase, c.a, c.cut, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (l.a + r.a) AS score
           FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.x AND l.k = c.cut
                       JOIN f r ON r.lang = c.lang AND r.phrase = c.y AND r.k = c.k - c.cut),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most
           FROM cand, (SELECT unnest([2, 3]) AS m) s, (SELECT unnest([1, 2, 3]) AS i) p WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside s USING (lang, phrase) WHERE s.most IS NULL OR 100::HUGEINT * s.most < 80::HUGEINT * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN words USING (lang) QUALIFY rank <= 2000
"""

ORACLE: dict[str, str] = {"op11_jaccard_join": JACCARD_SQL, "op12_collocations": COLLOCATIONS_SQL, "op3_decontaminate": PHRASES_SQL, "op9_chat_format": CHAT_SQL}
