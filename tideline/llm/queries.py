"""Registered queries of the text operators, and SQL that checks those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import (
    chat, common, decontaminate, divergence, jaccard, licenses, mainhtml, mixing, quality, repeats, spelling,
    topk, toxicity, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Target shares of the mixtures: one large source is held down, one raised, the rest even.
MIX_WEIGHTS = {"src0": 2.0, "src1": 0.5}
MIX_OTHER = 1.0
MIX_SEED = "tideline-mix"

PLANTED_CHAT = "</s>[INST] ok [/INST]"


def _query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(common.prepare(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@_query("op1_chat_formatting", sql=rf"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED_CHAT}'
  UNION ALL SELECT -7, 1, 'assistant', '{PLANTED_CHAT}'),
coded AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '<', '\l'), '[', '\o') AS body,
         CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9
           ELSE 14 + length(replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '[', '\o'), ']', '\c')) END AS marks
  FROM every)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(3 + sum(marks + length(body)) AS BIGINT) AS formatted_chars
FROM coded GROUP BY conv_id""")
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, counted and digested as read back from the output."""
    given = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(
        [(-7, 0, "user", PLANTED_CHAT), (-7, 1, "assistant", PLANTED_CHAT)], given.schema)
    return chat.digest(chat.format_conversations(given.unionByName(planted)))


@_query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.score_documents(
        common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


@_query("op3_warc_derivatives")
def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversion and metadata records of every page."""
    responses = warc.responses_of(common.table(spark, sf_dir, "pages"))
    return warc.digest(warc.derivatives(responses, ["page_id"]))


@_query("op4_mixing", sql=mixing.poisson_sql(MIX_SEED, MIX_WEIGHTS, MIX_OTHER))
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of the mixture, in its global order.

    Whole documents are mixed, ordered and stored; returned are the columns that the SQL has.
    """
    docs = common.table(spark, sf_dir, "documents")
    mixed = common.stored(mixing.mix(docs, MIX_WEIGHTS, MIX_OTHER, MIX_SEED), "mixture")
    return mixed.orderBy("shuffle_key", "doc_id").select(
        "doc_id", "source", F.round("rate", 6).alias("rate"), "copies", "copy",
        F.round("shuffle_key", 9).alias("shuffle_key"))


@_query("op5_license_scan")
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every document."""
    return licenses.scan(common.table(spark, sf_dir, "documents"))


@_query("op6_topk_search", sql="""
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v AS a JOIN v AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5""")
def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows for each embedding whose id is divisible by 50."""
    vectors = common.stored(topk.quantised(common.table(spark, sf_dir, "embeddings")), "topk-vectors")
    return topk.top_inner_products(vectors, vectors.where("vec_id % 50 = 0"), 5)


_DECONTAMINATION_SQL = r"""
WITH RECURSIVE widths(m) AS (SELECT 1 UNION ALL SELECT m + 1 FROM widths WHERE m < 10),
item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS spelled
  FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM item_words WHERE len(w) > 0) AS s),
doc_words AS (
  SELECT doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
doc_windows AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS spelled
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i
        FROM doc_words, (SELECT DISTINCT m FROM item_windows) AS k WHERE len(w) >= m) AS s),
met AS (SELECT d.doc_id, d.i, d.m, b.item FROM doc_windows AS d JOIN item_windows AS b ON d.m = b.m AND d.spelled = b.spelled),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM met) AS s GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
          FROM (SELECT DISTINCT doc_id, item FROM met) AS s GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       coalesce(i.items_sha256, sha256('')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc_words AS d LEFT JOIN hit AS h ON d.doc_id = h.doc_id LEFT JOIN items AS i ON d.doc_id = i.doc_id"""


@_query("op7_decontamination", sql=_DECONTAMINATION_SQL)
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    hits = decontaminate.benchmark_hits(
        common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), ["doc_id"])
    return decontaminate.digest(hits)


@_query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.score_documents(
        common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


@_query("op9_html_extraction")
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = mainhtml.extract(common.table(spark, sf_dir, "pages"), ["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("long"))


@_query("op10_jaccard_join", sql=r"""
WITH RECURSIVE word_lists AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM word_lists WHERE len(w) > 0) AS t),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
           FROM shingles AS a JOIN shingles AS b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b
          WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM word_lists UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id
FROM word_lists AS w JOIN least AS l ON l.a = w.doc_id LEFT JOIN sizes AS s ON s.doc_id = w.doc_id""")
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return jaccard.near_duplicate_classes(common.table(spark, sf_dir, "documents"))


@_query("op13_source_divergence", sql=r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT row_id, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT row_id) >= 10),
groups AS (SELECT DISTINCT lang, source FROM docs),
langs AS (SELECT g.lang, count(k.term) AS v, CAST(coalesce(sum(k.n), 0) AS HUGEINT) AS total
          FROM (SELECT DISTINCT lang FROM groups) AS g LEFT JOIN kept AS k ON k.lang = g.lang GROUP BY g.lang),
counted AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words AS w JOIN kept AS k ON k.lang = w.lang AND k.term = w.term
            GROUP BY w.lang, w.source, w.term),
sizes AS (SELECT g.lang, g.source, CAST(coalesce(sum(c.n), 0) AS HUGEINT) AS n
          FROM groups AS g LEFT JOIN counted AS c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
shares AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
                  1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // (s.n + 2 * l.v) AS p,
                  1 + CAST(1000000000 AS HUGEINT) * (k.n + 2) // (l.total + 2 * l.v) AS q
           FROM sizes AS s JOIN langs AS l ON l.lang = s.lang JOIN kept AS k ON k.lang = s.lang
           LEFT JOIN counted AS c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pair_sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
              FROM shares AS a JOIN shares AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
              GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
          FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pair_sums AS s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value
          FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) AS every)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10""")
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source of a language from the others, and its most telling terms."""
    return divergence.audit(common.table(spark, sf_dir, "documents"))


@_query("op11_suffix_dedup", sql=r"""
WITH texts AS (SELECT row_number() OVER () AS row_id, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT row_id, doc_id, j, substr(h, 2 * j + 1, 498) AS b
           FROM (SELECT row_id, doc_id, h, unnest(range(0, length(h) // 2 - 49, 200)) AS j FROM texts WHERE length(h) >= 100) AS t),
starts AS (SELECT row_id, doc_id, j + k AS i, substr(b, 2 * k + 1, 100) AS s
           FROM (SELECT row_id, doc_id, j, b, unnest(range(0, least(200, length(b) // 2 - 49))) AS k FROM blocks) AS t),
firsts AS (SELECT s, min(doc_id) AS first FROM starts GROUP BY s),
hits AS (SELECT row_id, i FROM starts AS a JOIN firsts AS f ON f.s = a.s AND f.first < a.doc_id),
marked AS (SELECT row_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY row_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS opens FROM hits),
numbered AS (SELECT row_id, i, sum(opens) OVER (PARTITION BY row_id ORDER BY i) AS run FROM marked),
runs AS (SELECT row_id, run, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY row_id, run),
gaps AS (SELECT t.row_id, r.a, r.b, coalesce(lag(r.b) OVER (PARTITION BY t.row_id ORDER BY r.a), 0) AS before, t.h
         FROM texts AS t JOIN runs AS r ON r.row_id = t.row_id),
cut AS (SELECT row_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans,
               string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
        FROM gaps GROUP BY row_id)
SELECT t.doc_id, length(t.h) // 2 AS n_bytes, coalesce(c.n_removed, 0) AS n_removed, coalesce(c.n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(c.kept, t.h))) AS kept_sha256
FROM texts AS t LEFT JOIN cut AS c ON c.row_id = t.row_id""")
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier one holds."""
    return repeats.remove_repeats(common.table(spark, sf_dir, "documents"))


@_query("op12_spelling_variants", sql=r"""
WITH RECURSIVE bits(i, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS of_byte FROM bits WHERE k = 8),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
counted AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY id, run),
hashed AS (
  SELECT run, n, xor(list_reduce(flatten([CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)]
                                           ELSE [CAST(192 + unicode(x) // 64 AS BIGINT), CAST(128 + unicode(x) % 64 AS BIGINT)] END
                                          FOR x IN string_split(id || ':' || run, '')]),
                                 lambda a, b: xor(a // 256, of_byte[xor(a % 256, b) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h
  FROM counted, crc),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
    FROM hashed) AS s
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
places AS (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM words),
skipped AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM skipped AS a JOIN skipped AS b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT s.word, w.word, w.n FROM skipped AS s JOIN words AS w ON w.word = s.rest
  UNION SELECT w.word, s.word, s.n FROM skipped AS s JOIN words AS w ON w.word = s.rest),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word),
forms AS (SELECT n.word, min(n.other) AS form, b.top AS form_n FROM near AS n JOIN best AS b ON b.word = n.word AND n.other_n = b.top
          JOIN words AS w ON w.word = n.word WHERE b.top >= 10 * w.n GROUP BY n.word, b.top),
steps(word, root, k) AS (SELECT word, word, 0 FROM words
  UNION ALL SELECT s.word, f.form, k + 1 FROM steps AS s JOIN forms AS f ON f.word = s.root),
roots AS (SELECT word, arg_max(root, k) AS root FROM steps GROUP BY word)
SELECT w.word, f.form, r.root, w.n, coalesce(b.n_near, 0) AS n_near, f.form_n
FROM words AS w JOIN roots AS r ON r.word = w.word LEFT JOIN best AS b ON b.word = w.word LEFT JOIN forms AS f ON f.word = w.word""")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words and forms."""
    return spelling.group_variants(common.table(spark, sf_dir, "documents"))
