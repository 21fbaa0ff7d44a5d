"""Queries of the corpus operators: thin wrappers that apply each operator to its whole table, and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontam, divergence, hnsw, language, lm, neardup, packing, pii, quality, rules, substring, urls, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the installed public tokenizers keep a file; its content is read, never copied."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


#: The rules of the url contract (verdict, host, path).
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are labelled through the number that ends their path, assumed to be a doc_id: bad if of low quality or toxic.

    The tables nowhere state this link; nothing but the method's own verdicts depends on it.
    """
    pages = _table(spark, sf_dir, "pages")
    number = F.regexp_extract(urls.host_path(F.col("url"))[1], "([0-9]{1,18})[^0-9]*$", 1).try_cast("long")
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    return urls.judge(pages, URL_RULES, pages.select("page_id", number.alias("doc_id")).join(labels, "doc_id").select("page_id", "bad"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels").where(common.fold("doc_id", 3) != 1))
    return quality.score(docs, model).select("doc_id", (common.fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_known", "n_full", "log_score")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_windows(_table(spark, sf_dir, "documents"), window=50)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    prototypes = language.fit(docs.where(common.fold("doc_id", 4) != 2))
    return language.predict(docs, prototypes).select("doc_id", (common.fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), most=4)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"), least=3, most=200)


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_url_filter, op3_benchmark_decontamination, op4_harmonic_packing, op5_quality_classifier, op6_lm_scoring, op7_substring_dedup, op8_language_id, op9_quality_rules, op10_minhash_near_dedup, op11_embedding_whitening, op12_source_divergence, op13_nearest_neighbours)}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP10 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), link AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
), both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link
), reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
), c AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, least(d.doc_id, coalesce(low, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
"""


_OP7 = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 49], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM w WHERE len(ws) >= 50)
), low AS (SELECT g, min(doc_id) AS low FROM win GROUP BY g
), hit AS (SELECT doc_id, i FROM win JOIN low USING (g) WHERE low < doc_id
), gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM hit
), per AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM gone GROUP BY doc_id
), word AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS p FROM w JOIN per USING (doc_id)
), kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(CASE WHEN n IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(t, '') END) AS kept_sha256
FROM w LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_OP3 = r"""
WITH s AS (
  SELECT kind, id, array_to_string(ws[i : i + 4], ' ') AS g FROM (
    SELECT kind, id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM (
      SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
      FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark)
    ) WHERE len(ws) > 0)
), b AS (SELECT DISTINCT id, g FROM s WHERE kind = 'b'), d AS (SELECT DISTINCT id, g FROM s WHERE kind = 'd'
), n AS (SELECT id, count(*) AS n FROM b GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, any_value(n.n)::BIGINT AS n_item, count(*)::BIGINT AS n_found
FROM b JOIN d USING (g) JOIN n ON n.id = b.id GROUP BY d.id, b.id HAVING 100 * count(*) >= 80 * any_value(n.n)
"""


def _op2_sql(depth: int = 8, many: int = 20, seldom: float = 3.0, block_at: float = 0.8, strength: float = 10.0, z: float = 1.96) -> str:
    """``depth``: SQL has no loops, so one step is written out for each level; the given tables have four at most."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    levels = merges = ""
    for d in range(1, depth + 1):
        levels += f""", k{d} AS (SELECT *, parts[{d + 1}] AS token FROM t{d - 1}
), l{d} AS (SELECT host, tree, TRUE AS loose FROM (SELECT host, tree, token, sum(n) AS n FROM k{d} WHERE token IS NOT NULL GROUP BY ALL) GROUP BY host, tree HAVING count(*) >= {many} AND sum(n) < {seldom} * count(*)
), t{d} AS (SELECT host, shape, n, seen, bad, parts, list_concat(tree, CASE WHEN token IS NULL THEN [] WHEN loose AND token <> '' THEN ['*'] ELSE [token] END) AS tree FROM k{d} LEFT JOIN l{d} USING (host, tree))"""
    for d in range(depth, 0, -1):
        far = f"CASE WHEN abs(bad - seen * rate) > {z} * sqrt(seen * rate * (1 - rate)) AND seen >= 5 THEN sign(bad - seen * rate) ELSE 0 END"
        merges += f""", b{d} AS (SELECT host, template[1:{d}] AS above, template[{d + 1}] AS token, template[{d + 2}:] AS below, sum(seen) AS seen, sum(bad) AS bad FROM m{d} WHERE len(template) > {d} GROUP BY ALL
), p{d} AS (SELECT *, (sum(bad) OVER w + 1) / (sum(seen) OVER w + 2) AS rate FROM b{d} WINDOW w AS (PARTITION BY host, above, below)
), s{d} AS (SELECT * EXCLUDE rate, {far} AS side FROM p{d}
), q{d} AS (SELECT *, (sum(bad) OVER w + 1) / (sum(seen) OVER w + 2) AS rate, count(*) OVER w AS kinds FROM s{d} WINDOW w AS (PARTITION BY host, above, below, side)
), a{d} AS (SELECT host, list_concat(above, [token], below) AS template, list_concat(above, [['*-', '*', '*+'][side::INT + 2]], below) AS now FROM q{d} WHERE kinds > 1 AND {far} = 0
), m{d - 1} AS (SELECT host, tree, seen, bad, coalesce(now, template) AS template FROM m{d} LEFT JOIN a{d} USING (host, template))"""
    rules = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    case = lambda of: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{of(v, h, p)}'" for v, h, p in rules) + " END"
    return f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{upper}', '{upper.lower()}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), base AS (SELECT *, regexp_replace(path, '[0-9]+', '{{n}}', 'g') AS shape FROM b
), lab AS (SELECT doc_id, max((quality = 0 OR toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id
), known AS (SELECT page_id, bad FROM (SELECT page_id, try_cast(regexp_extract(path, '([0-9]{{1,18}})[^0-9]*$', 1) AS BIGINT) AS doc_id FROM base) JOIN lab USING (doc_id)
), t0 AS (SELECT host, shape, count(*) AS n, count(bad) AS seen, coalesce(sum(bad), 0)::DOUBLE AS bad, string_split(shape, '/') AS parts, [''] AS tree FROM base LEFT JOIN known USING (page_id) GROUP BY host, shape
){levels.rstrip()}, m{depth} AS (SELECT host, tree, sum(seen) AS seen, sum(bad) AS bad, tree AS template FROM t{depth} GROUP BY host, tree
){merges.rstrip()}, merged AS (SELECT host, template, sum(seen) AS seen, sum(bad) AS bad FROM m0 GROUP BY host, template
), total AS (SELECT (sum(bad) + 1) / (sum(seen) + 2) AS prior FROM merged
), hosts AS (SELECT host, (sum(bad) + {strength} * any_value(prior)) / (sum(seen) + {strength}) AS host_rate FROM merged CROSS JOIN total GROUP BY host
), judged AS (SELECT host, template, CASE WHEN (bad + {strength} * host_rate) / (seen + {strength}) >= {block_at} THEN 'block' ELSE 'allow' END AS by_template FROM merged JOIN hosts USING (host)
)
SELECT page_id, host, path, {case(lambda v, h, p: h + p)} AS rule, coalesce({case(lambda v, h, p: v)}, by_template) AS verdict, host || array_to_string(template, '/') AS template
FROM base JOIN t{depth} USING (host, shape) JOIN m0 USING (host, tree) JOIN judged USING (host, template)
"""


_OP6 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (SELECT doc_id, unnest(ws) AS c, unnest(generate_series(1, len(ws))) AS i FROM w
), t AS (SELECT *, lag(c, 1) OVER o AS b, lag(c, 2) OVER o AS a FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), e AS (SELECT *, count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS e0, count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY doc_id, c) AS e1,
  count(*) OVER (PARTITION BY b, c) - count(*) OVER (PARTITION BY doc_id, b, c) AS e2, count(*) OVER (PARTITION BY a, b, c) - count(*) OVER (PARTITION BY doc_id, a, b, c) AS e3 FROM t
), f AS (SELECT *, lag(e1) OVER o AS x1, lag(e2) OVER o AS x2 FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), k AS (SELECT *, least(i - 1, 2) AS m, CASE WHEN i > 2 AND e3 > 0 THEN 3 WHEN i > 1 AND e2 > 0 THEN 2 WHEN e1 > 0 THEN 1 ELSE 0 END AS k FROM f
), s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (k > 1) AS n_known, count(*) FILTER (k = 3) AS n_full,
  sum((m + 1 - k) * ln(0.4::DOUBLE) + CASE k WHEN 3 THEN ln(e3::DOUBLE) - ln(x2::DOUBLE) WHEN 2 THEN ln(e2::DOUBLE) - ln(x1::DOUBLE) WHEN 1 THEN ln(e1::DOUBLE) - ln(e0::DOUBLE) ELSE -ln(greatest(e0, 1)::DOUBLE) END) AS s FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_known, 0)::BIGINT AS n_known, coalesce(n_full, 0)::BIGINT AS n_full, round(coalesce(s, 0), 3) AS log_score FROM documents LEFT JOIN s USING (doc_id)
"""


_OP12 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), o AS (SELECT r, lang, source, unnest(ts) AS term FROM d
), kept AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), l AS (SELECT lang, count(*) AS v, sum(n) AS n_lang FROM kept GROUP BY lang
), g AS (SELECT DISTINCT lang, source FROM d
), c AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL
), gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN (SELECT c.* FROM c JOIN kept USING (lang, term)) c USING (lang, source) GROUP BY ALL
), p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (gn.n + l.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 1) // (l.n_lang + l.v) AS q
  FROM g JOIN kept k USING (lang) JOIN l USING (lang) JOIN gn USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), part AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM part) WHERE part = 'pair' OR rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": _op2_sql(), "op6_lm_scoring": _OP6, "op3_benchmark_decontamination": _OP3, "op7_substring_dedup": _OP7, "op10_minhash_near_dedup": _OP10, "op12_source_divergence": _OP12}
