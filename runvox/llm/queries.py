"""Registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runvox.llm import chat, covertree, lm, minhash, mixing, negatives, packing, periodic, quality, substrings, toxicity, urlfilter, warc
from runvox.llm.tables import table, word_list

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


#: Distinct 3-word shingles of lower-cased (A-Z) words, links between all pairs that share one, and their closure.
_OP6 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
rare AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY c, s) AS r
         FROM s JOIN (SELECT s, count(*) AS c FROM s GROUP BY s) USING (s)),
prefix AS (SELECT doc_id, s FROM rare JOIN n USING (doc_id) WHERE r <= n - ceil(0.85 * n) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM prefix a JOIN prefix b USING (s) WHERE a.doc_id < b.doc_id),
common AS (SELECT c.a, c.b, count(*) AS k FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND y.s = x.s
           GROUP BY c.a, c.b),
e AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
      WHERE 100 * k >= 85 * (na.n + nb.n - k)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION
          SELECT r.a, t.b FROM reach r JOIN both_ways t ON t.a = r.b),
lowest AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM lowest LEFT JOIN n USING (doc_id)"""


@query("op6_minhash_near_dedup", _OP6)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


@query("op8_substring_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_words(table(spark, sf_dir, "documents"), width=50)


#: Vocabulary file of a public tokenizer, installed on every executor.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), TOKENIZER, capacity=4096)


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_OP2 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha1(t) AS payload_digest,
             max(page_id) OVER (PARTITION BY t) AS winner FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> winner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> winner THEN winner END AS refers_to
FROM d"""


@query("op2_warc_archive", _OP2)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


@query("op3_mixing_sources")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


#: All pairs of equal label by cosine, in double precision, and their closure.
_OP7 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION
          SELECT r.a, p.b FROM reach r JOIN p ON p.a = r.b),
lowest AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM lowest LEFT JOIN n USING (vec_id)"""


@query("op7_embedding_near_dedup", _OP7)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


_LAST_DAY = 1000


def _day(key: Column) -> Column:
    """A day from 0 to 999 that follows from a string."""
    return (F.conv(F.substring(F.md5(key), 1, 7), 16, 10).cast("long") % _LAST_DAY).cast("int")


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated lists derived from the pages: every host and its domain enter and leave the block list, and every host with
    a first path step the allow list, on days that follow from their names."""
    named = pages.select(urlfilter.url_keys("url").alias("k")).where("k IS NOT NULL")
    keys = named.select(F.explode("k").alias("key")).distinct()
    listed = keys.withColumn("list", F.when(F.col("key").contains("/"), "allow").otherwise("block"))
    turns = listed.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(5))))
    return turns.select("list", "key", F.when(F.col("turn") % 2 == 0, "add").otherwise("remove").alias("action"),
                        _day(F.concat_ws("|", "list", "key", F.col("turn").cast("string"))).alias("at"))


_OP1 = r"""
WITH c AS (
  SELECT page_id, ('0x' || substr(md5('page|' || page_id), 1, 7))::BIGINT % 1000 AS fetched,
         regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1) AS host,
         regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]+(/[^/?#]+)', 1) AS step FROM pages),
p AS (SELECT *, string_split(host, '.') AS l FROM c),
k AS (SELECT DISTINCT page_id, fetched, unnest(list_concat(list_transform(range(1, len(l) + 1), lambda i: array_to_string(l[i:], '.')),
        CASE WHEN step <> '' THEN [host || step] ELSE [] END)) AS key FROM p WHERE host <> ''),
named AS (SELECT DISTINCT key, CASE WHEN contains(key, '/') THEN 'allow' ELSE 'block' END AS list FROM k),
e AS (SELECT list, key, ('0x' || substr(md5(list || '|' || key || '|' || t), 1, 7))::BIGINT % 1000 AS day, t % 2 AS gone
      FROM named, range(6) r(t)),
state AS (SELECT list, key, day, max(gone) AS gone FROM e GROUP BY ALL),
m AS (SELECT k.page_id, list FROM k ASOF JOIN state ON k.key = state.key AND k.fetched >= state.day WHERE gone = 0),
n AS (SELECT page_id, sum((list = 'block')::INT) AS b, sum((list = 'allow')::INT) AS a FROM m GROUP BY page_id)
SELECT page_id, fetched::INT AS fetched, coalesce(b, 0)::BIGINT AS n_block, coalesce(a, 0)::BIGINT AS n_allow,
       coalesce(b, 0) > 0 AND coalesce(a, 0) = 0 AS blocked
FROM c LEFT JOIN n USING (page_id)"""


@query("op1_url_filters", _OP1)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", _day(F.concat(F.lit("page|"), F.col("page_id").cast("string"))).alias("fetched"))
    return urlfilter.judged(captures, list_entries(pages), _LAST_DAY)


_OP5 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, string_split(t, chr(10)) AS l FROM t),
c AS (SELECT doc_id, t, w, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
             list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
             len(regexp_extract_all(t, '[0-9]')) AS digits, len(regexp_extract_all(t, '[!?]')) AS marks,
             len(regexp_extract_all(t, '[{}\[\]\\^~=]')) AS brackets FROM w),
g AS (SELECT doc_id, unnest(range(1, n_words - 6)) AS i, w FROM c WHERE n_words >= 8),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS v FROM g),
twice AS (SELECT doc_id, i FROM v QUALIFY count(*) OVER (PARTITION BY doc_id, v) > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(8) s(k) GROUP BY doc_id),
a AS (SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
             coalesce(r.n, 0) AS n_repeat_words, len(l) AS n_lines, digits, marks, brackets FROM c LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 10 * n_symbols > n_words
            OR 100 * n_dup_lines > 30 * n_lines OR 5 * digits > word_chars OR 2 * marks > n_words
            OR 10 * brackets > n_words) AS kept
FROM b"""


@query("op5_quality_cascade", _OP5)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def marked_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts hold marks of a chat template."""
    said = F.lit("\\### Assistant: </turn> ok")
    two = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return two


@query("op9_chat_windows")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(turns.unionByName(marked_conversation(spark)))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) in which a tenth of the texts repeat a stretch of their words to the end."""
    words = word_list(F.col("text"))
    n, h = F.size(words).cast("long"), F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    docs = docs.select("doc_id", "text", h.alias("h"), g.alias("g"), n.alias("n"))
    docs = docs.withColumn("a", F.expr("CASE WHEN n > 0 THEN g % n END"))
    docs = docs.withColumn("p", F.expr("1 + (n - a) DIV (3 + g % 8)"))
    start, period = F.col("a").cast("int"), F.col("p").cast("int")
    unit = F.slice(words, start + 1, period)
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    repeated = F.slice(F.flatten(F.array_repeat(unit, times)), F.lit(1), (F.col("n") - F.col("a")).cast("int"))
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), start), repeated), " ")
    return docs.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), planted).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    best = F.expr("""get(array_sort(runs, (x, y) -> CASE
        WHEN x.length * y.period > y.length * x.period THEN -1 WHEN x.length * y.period < y.length * x.period THEN 1
        WHEN x.start < y.start THEN -1 WHEN x.start > y.start THEN 1
        WHEN x.period < y.period THEN -1 WHEN x.period > y.period THEN 1 ELSE 0 END), 0)""")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed").select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op13_lm_scoring")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


#: All scores of every anchor.
_OP12 = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS s
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b))::INT AS rank,
       s.b AS negative_id, p.s AS positive_score, s.s AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.s <= 100 * s.s AND s.s <= p.s QUALIFY rank <= 5"""


def whole_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vector): components in 256ths, every seventh label moved on; rows with bad components are gone."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.where(good).select("vec_id", label.alias("label"),
                                   F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vector"))


@query("op12_hard_negatives", _OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mined(whole_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)
