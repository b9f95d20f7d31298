"""Leakage audit and web-corpus curation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.markup import NAMED
from seqloom.operators import leakage, scoring, webcorpus
from seqloom.plans.registry import query
from seqloom.plans.views import CRC_TABLE, crc_sql, prepared, rounded, table, with_sql
from seqloom.session import spread

DIM = 64


def benchmark(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents")).select(F.col("doc_id").alias("corpus_id"), "text")


def query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return prepared(
        spark, sf, "query-vectors",
        lambda: scoring.embed_table(benchmark(spark, sf), "query_id", "text", leakage.hashed_words(DIM)),
    )


def corpus_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return prepared(
        spark, sf, "corpus-vectors",
        lambda: scoring.embed_table(documents(spark, sf), "corpus_id", "text", leakage.hashed_words(DIM)),
    )


def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return prepared(
        spark, sf, "neighbours", lambda: leakage.knn_cosine(query_vectors(spark, sf), corpus_vectors(spark, sf))
    )


def audit_pairs(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> DataFrame:
        return leakage.leakage_pairs(neighbours(spark, sf), benchmark(spark, sf), documents(spark, sf))

    return prepared(spark, sf, "audit-pairs", build)


def _vectors_sql(name: str, source: str, key: str) -> str:
    return rf"""{name}_counts AS (
      SELECT id, ('0x' || substr(md5(word), 1, 13))::BIGINT % {DIM} AS slot, count(*) AS n
      FROM (SELECT {key} AS id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS word FROM {source})
      GROUP BY ALL),
    {name} AS (
      SELECT id, list_transform(range({DIM}), lambda i: CAST(coalesce(m[i], 0) AS DOUBLE)) AS vec
      FROM (SELECT id, map_from_entries(list((slot, n))) AS m FROM {name}_counts GROUP BY id))"""


_VECS = _vectors_sql("qv", "benchmark", "item_id") + ",\n" + _vectors_sql("cv", "documents", "doc_id")
_KNN = """knn AS (
  SELECT query_id, corpus_id, cosine, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, corpus_id) - 1 AS INT) AS rank
  FROM (SELECT q.id AS query_id, c.id AS corpus_id, round(list_cosine_similarity(q.vec, c.vec), 9) AS cosine
        FROM qv q CROSS JOIN cv c)
  QUALIFY rank < 5)"""


def _grams_sql(name: str, source: str, key: str) -> str:
    return rf"""{name} AS (
      SELECT id, text, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
             ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS g
      FROM (SELECT {key} AS id, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS ws FROM {source}))"""


_GRAMS = _grams_sql("qg", "benchmark", "item_id") + ",\n" + _grams_sql("cg", "documents", "doc_id")
_AUDIT = """audit AS (
  SELECT query_id, corpus_id, rank, cosine, substr(q.text, 1, 300) AS query_text, substr(c.text, 1, 300) AS corpus_text,
         CASE WHEN len(q.g) = 0 OR len(c.g) = 0 THEN 0.0
              ELSE len(list_intersect(q.g, c.g)) / (len(q.g) + len(c.g) - len(list_intersect(q.g, c.g))) END AS jaccard,
         CASE WHEN len(q.g) = 0 OR len(c.g) = 0 THEN 0.0
              ELSE len(list_intersect(q.g, c.g)) / least(len(q.g), len(c.g)) END AS containment
  FROM knn JOIN qg q ON q.id = query_id JOIN cg c ON c.id = corpus_id)"""


@query(with_sql(_VECS, _KNN, select="SELECT query_id, corpus_id, rank, cosine FROM knn"))
def knn_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.knn_cosine(query_vectors(spark, sf), corpus_vectors(spark, sf))


@query(
    with_sql(
        _VECS,
        _KNN,
        _GRAMS,
        _AUDIT,
        select="SELECT query_id, corpus_id, round(jaccard, 6) AS jaccard, round(containment, 6) AS containment FROM audit",
    )
)
def lexical_overlap(spark: SparkSession, sf: str) -> DataFrame:
    pairs = neighbours(spark, sf).select("query_id", "corpus_id")
    scored = leakage.pair_overlap(pairs, benchmark(spark, sf), documents(spark, sf))
    return scored.select("query_id", "corpus_id", rounded("jaccard").alias("jaccard"), rounded("containment").alias("containment"))


@query(
    with_sql(
        _GRAMS,
        """shared_grams AS (
          SELECT q.id AS query_id, c.id AS corpus_id, count(*) AS shared, any_value(len(q.g)) AS qn, any_value(len(c.g)) AS cn
          FROM (SELECT id, g, unnest(g) AS gram FROM qg) q JOIN (SELECT id, g, unnest(g) AS gram FROM cg) c USING (gram)
          GROUP BY q.id, c.id)""",
        select="""SELECT query_id, corpus_id, round(shared / (qn + cn - shared), 6) AS jaccard,
                         round(shared / least(qn, cn), 6) AS containment
                  FROM shared_grams WHERE shared / least(qn, cn) > 0.5""",
    )
)
def near_verbatim_pairs(spark: SparkSession, sf: str) -> DataFrame:
    found = leakage.near_verbatim_pairs(benchmark(spark, sf), documents(spark, sf))
    return found.select(
        "query_id", "corpus_id", rounded("jaccard").alias("jaccard"), rounded("containment").alias("containment")
    )


_BASELINE = """nq AS (SELECT id, vec, row_number() OVER (ORDER BY id) - 1 AS qi FROM qv),
nc AS (SELECT id, vec, row_number() OVER (ORDER BY id) - 1 AS ci FROM cv),
drawn AS (
  SELECT i AS pair, ('0x' || substr(md5('0|query|' || i), 1, 13))::BIGINT % (SELECT count(*) FROM nq) AS qi,
         ('0x' || substr(md5('0|corpus|' || i), 1, 13))::BIGINT % (SELECT count(*) FROM nc) AS ci
  FROM range(20000) t(i)),
baseline AS (
  SELECT pair, nq.id AS query_id, nc.id AS corpus_id, round(list_cosine_similarity(nq.vec, nc.vec), 9) AS cosine
  FROM drawn JOIN nq USING (qi) JOIN nc USING (ci))"""


def random_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.random_pair_cosines(query_vectors(spark, sf), corpus_vectors(spark, sf))


@query(with_sql(_VECS, _BASELINE, select="SELECT pair, query_id, corpus_id, cosine FROM baseline"))
def random_pair_cosines(spark: SparkSession, sf: str) -> DataFrame:
    return random_pairs(spark, sf)


@query(
    with_sql(
        _VECS,
        _BASELINE,
        select="""SELECT 'mean' AS stat, round(avg(cosine), 12) AS value FROM baseline
                  UNION ALL SELECT 'max', max(cosine) FROM baseline
                  UNION ALL SELECT 'p50', round(quantile_cont(cosine, 0.50), 12) FROM baseline
                  UNION ALL SELECT 'p99', round(quantile_cont(cosine, 0.99), 12) FROM baseline""",
    )
)
def random_pair_baseline(spark: SparkSession, sf: str) -> DataFrame:
    drawn = prepared(spark, sf, "random-pairs", lambda: random_pairs(spark, sf))
    return leakage.random_pair_baseline(drawn).withColumn("value", rounded("value", 12))


AUDIT_SQL = with_sql(
    _VECS,
    _KNN,
    _GRAMS,
    _AUDIT,
    select="""SELECT query_id, corpus_id, rank, cosine, round(jaccard, 6) AS jaccard_5gram,
                     round(containment, 6) AS containment_5gram, query_text, corpus_text FROM audit""",
)


@query(AUDIT_SQL)
def leakage_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = leakage.leakage_pairs(neighbours(spark, sf), benchmark(spark, sf), documents(spark, sf))
    return pairs.withColumns({c: rounded(c) for c in ("jaccard_5gram", "containment_5gram")})


@query(
    with_sql(
        _VECS,
        _KNN,
        _GRAMS,
        _AUDIT,
        "nearest AS (SELECT cosine FROM audit WHERE rank = 0)",
        select="""SELECT stat, round(value, 12) AS value FROM (
          SELECT 'p50' AS stat, quantile_cont(cosine, 0.50) AS value FROM nearest
          UNION ALL SELECT 'p90', quantile_cont(cosine, 0.90) FROM nearest
          UNION ALL SELECT 'p99', quantile_cont(cosine, 0.99) FROM nearest
          UNION ALL SELECT 'max', max(cosine) FROM nearest
          UNION ALL SELECT 'queries_above_0.95', count(*) FROM nearest WHERE cosine > 0.95
          UNION ALL SELECT 'queries_above_0.90', count(*) FROM nearest WHERE cosine > 0.90
          UNION ALL SELECT 'queries_above_0.85', count(*) FROM nearest WHERE cosine > 0.85
          UNION ALL SELECT 'queries_above_0.80', count(*) FROM nearest WHERE cosine > 0.80
          UNION ALL SELECT 'near_verbatim_pairs', count(*) FROM audit WHERE containment > 0.5)""",
    )
)
def leakage_summary(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leakage_summary(audit_pairs(spark, sf)).withColumn("value", rounded("value", 12))


@query(
    with_sql(
        _VECS,
        _KNN,
        _GRAMS,
        _AUDIT,
        select="""SELECT query_id, corpus_id,
                    CASE WHEN cosine > 0.85 AND containment > 0.5 THEN 'leakage' WHEN cosine > 0.85 THEN 'same topic'
                         ELSE 'unrelated' END AS pair_class FROM audit""",
    )
)
def classify_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.classify_pairs(audit_pairs(spark, sf)).select("query_id", "corpus_id", "pair_class")


# Web corpus.


SLOTS, STEPS = 4096, 12
_models: dict[tuple[str, str], webcorpus.RelevanceModel] = {}


def relevance_model(spark: SparkSession, sf: str) -> webcorpus.RelevanceModel:
    """The model of the given labels, fitted once a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _models:
        labelled = spread(table(spark, sf, "documents")).join(table(spark, sf, "labels"), "doc_id")
        good, bad = labelled.filter("quality = 1"), labelled.filter("quality = 0")
        _models[key] = webcorpus.train_relevance_filter(good, bad, SLOTS, STEPS)
    return _models[key]


_SUB, _RIDGE = webcorpus.SUBWORD, f"{webcorpus.RIDGE}::DOUBLE"
_SLOTS_SQL = rf"""{CRC_TABLE},
slot_words AS (SELECT doc_id, '<' || unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) || '>' AS w FROM documents),
word_features AS (
  SELECT w, unnest(list_concat([w], CASE WHEN len(w) > {_SUB} THEN
    list_transform(range(1, len(w) - {_SUB} + 2), lambda i: substr(w, i, {_SUB})) ELSE [] END)) AS f
  FROM (SELECT DISTINCT w FROM slot_words)),
feature_slots AS (SELECT f, {crc_sql("f")} % {SLOTS} AS slot FROM (SELECT DISTINCT f FROM word_features), crc_table),
word_slots AS MATERIALIZED (SELECT w, slot, count(*) AS c FROM word_features JOIN feature_slots USING (f) GROUP BY ALL),
counts AS MATERIALIZED (SELECT doc_id, slot, sum(c)::DOUBLE AS c FROM slot_words JOIN word_slots USING (w) GROUP BY ALL),
sizes AS (SELECT doc_id, sum(c) AS n, sqrt(sum(c * c)) AS length FROM counts GROUP BY doc_id),
shares AS MATERIALIZED (SELECT doc_id, slot, c / length AS x FROM counts JOIN sizes USING (doc_id)),
given AS MATERIALIZED (
  SELECT doc_id, l.quality::DOUBLE AS label, (coalesce(n / length, 0) + 1) / 4 AS bound
  FROM documents JOIN labels l USING (doc_id) LEFT JOIN sizes USING (doc_id) WHERE l.quality IN (0, 1)),
curvature AS MATERIALIZED (SELECT slot, sum(x * bound) + {_RIDGE} AS h FROM shares JOIN given USING (doc_id) GROUP BY slot),
w0 AS (SELECT slot, 0.0::DOUBLE AS w, 0.0::DOUBLE AS v FROM curvature), b0 AS (SELECT 0.0::DOUBLE AS w, 0.0::DOUBLE AS v)"""


def _step_sql(k: int) -> str:
    ahead = f"w, w + {k}.0::DOUBLE / {k + 3} * (w - old) AS v"
    return f"""missed{k} AS MATERIALIZED (
  SELECT doc_id, 1 / (1 + exp(-(coalesce(z, 0) + b.v))) - label AS missed
  FROM given LEFT JOIN (SELECT doc_id, sum(x * v) AS z FROM shares JOIN w{k} USING (slot) GROUP BY doc_id) USING (doc_id), b{k} b),
w{k + 1} AS MATERIALIZED (SELECT slot, {ahead} FROM (
  SELECT slot, w AS old, v - (coalesce(g, 0) + {_RIDGE} * v) / h AS w FROM w{k} JOIN curvature USING (slot)
  LEFT JOIN (SELECT slot, sum(missed * x) AS g FROM shares JOIN missed{k} USING (doc_id) GROUP BY slot) USING (slot))),
b{k + 1} AS MATERIALIZED (SELECT {ahead} FROM (
  SELECT w AS old, v - ((SELECT sum(missed) FROM missed{k}) + {_RIDGE} * v) / ((SELECT sum(bound) FROM given) + {_RIDGE}) AS w FROM b{k}))"""


_RELEVANCE = (
    _SLOTS_SQL,
    *map(_step_sql, range(STEPS)),
    f"""relevance AS (
  SELECT d.doc_id, 1 / (1 + exp(-(coalesce(z, 0) + b.w))) AS score FROM documents d
  LEFT JOIN (SELECT doc_id, sum(x * w) AS z FROM shares JOIN w{STEPS} USING (slot) GROUP BY doc_id) USING (doc_id), b{STEPS} b)""",
)


@query(with_sql(*_RELEVANCE, select="SELECT doc_id, round(score, 6) AS score FROM relevance"))
def relevance_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents")).select("doc_id", "text")
    scored = webcorpus.score_documents(docs, relevance_model(spark, sf))
    return scored.select("doc_id", rounded("score").alias("score"))


@query(
    with_sql(
        *_RELEVANCE,
        select="SELECT doc_id, round(score, 6) AS score FROM relevance ORDER BY round(relevance.score, 9) DESC, doc_id LIMIT 100",
    )
)
def rank_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents")).select("doc_id", "text")
    ranked = webcorpus.rank_documents(docs, relevance_model(spark, sf), 100)
    return ranked.select("doc_id", rounded("score").alias("score"))


_LINKS = r"""bases AS (
  SELECT page_id, lower(regexp_extract(regexp_replace(url, '#.*$', ''), '^([a-zA-Z]+://[^/?]*)', 1)) AS site, html FROM pages),
outlinks AS (
  SELECT DISTINCT page_id, site || regexp_replace(replace(href, '&amp;', '&'), '#.*$', '') AS target_url
  FROM (SELECT page_id, site, unnest(regexp_extract_all(html, '<a\s[^>]*?href\s*=\s*"([^"]*)"', 1)) AS href FROM bases)
  WHERE href LIKE '/%'),
urls AS (SELECT regexp_replace(url, '#.*$', '') AS target_url, min(page_id) AS target_id FROM pages GROUP BY ALL),
derived AS (
  SELECT p.page_id, regexp_replace(n.url, '#.*$', '') AS target_url FROM pages p JOIN pages n ON n.page_id = p.page_id + 1),
all_links AS (SELECT * FROM outlinks UNION SELECT * FROM derived),
page_pairs AS (
  SELECT DISTINCT page_id, target_id FROM all_links JOIN urls USING (target_url) WHERE page_id <> target_id)"""


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """The pages' own links, and a link from each page to the next one: their own targets are not
    among the given pages, so pairs need the derived links."""
    pages = table(spark, sf, "pages")
    following = pages.select((F.col("page_id") - 1).alias("page_id"), webcorpus.normalized_url(F.col("url")).alias("target_url"))
    derived = following.join(pages.select("page_id"), "page_id", "left_semi")
    return webcorpus.extract_outlinks(spread(pages)).unionByName(derived).distinct()


def linked_pages(spark: SparkSession, sf: str) -> DataFrame:
    return webcorpus.link_pairs(table(spark, sf, "pages"), page_links(spark, sf))


@query(with_sql(_LINKS, select="SELECT page_id, target_url FROM outlinks"))
def extract_outlinks(spark: SparkSession, sf: str) -> DataFrame:
    return webcorpus.extract_outlinks(spread(table(spark, sf, "pages")))


# The given pages write all links one way. Here five of six write them otherwise: without quotes, as areas with
# a tag in another attribute, relative to a base with references, beside links that are none, and with a
# scheme-relative target.
_LINK = '<a href="([^" ]*)">'
_FORMS = {
    1: r"<a class=c href=$1>",
    2: r"""<area title="<a href='/no'>" HREF = '$1'>""",
    3: r'<a href="..$1?a=1&amp;b=&#50;&eacute;&nope;#x">',
    4: r"""<!-- <a href="/no"> --><script>"<a href='/no'>"</script><a data-href=/no title=' href="/no"' href="$1" href=/no>""",
    5: r'<a href=" &#x2F;$1 ">',
}
_BASE = '<base target=_top><base href="//base.example/dir/page">'


def _form_sql(number: int, form: str) -> str:
    put = form.replace("'", "''").replace("$1", r"\1")
    changed = f"regexp_replace(html, '{_LINK}', '{put}', 'g')"
    return f"WHEN {number} THEN " + (f"'{_BASE}' || {changed}" if number == 3 else changed)


_REFERENCE_SQL = r"""CASE WHEN NOT regexp_matches(p, '^&[^&]+;$') THEN p
  WHEN p[2:3] IN ('#x', '#X') THEN chr(('0x' || p[4:len(p) - 1])::INT)
  WHEN p[2] = '#' THEN chr(p[3:len(p) - 1]::INT)
  ELSE coalesce(chr(names[p[2:len(p) - 1]]), p) END"""
_FORM_LINKS = rf"""written AS (
  SELECT page_id, url, CASE page_id % 6 {" ".join(_form_sql(*f) for f in _FORMS.items())} ELSE html END AS html FROM pages),
known AS (SELECT MAP {{{", ".join(f"'{n}': {c}" for n, c in NAMED.items())}}} AS names),
tags AS (
  SELECT page_id, url, unnest(list_filter(regexp_extract_all(
    regexp_replace(html, '(?is)<!--.*?-->|<(script|style|title|textarea)[^>]*>.*?</(script|style|title|textarea)', ' ', 'g'),
    '<[A-Za-z][^\s/>]*(?:=\s*"[^"]*"|=\s*''[^'']*''|[^>])*>'), lambda t: regexp_matches(t, '(?i)^<(a|area|base)[\s/]'))) AS tag
  FROM written),
attributes AS (
  SELECT page_id, url, regexp_matches(tag, '(?i)^<base') AS is_base, regexp_replace(list_filter(regexp_extract_all(
    regexp_replace(tag, '^<[^\s/>]+', ''), '[^\s"''<>/=]+\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>][^\s>]*)'),
    lambda a: regexp_matches(a, '(?i)^href\s*='))[1], '(?i)^href\s*=\s*', '') AS raw FROM tags),
plain AS (
  SELECT *, CASE WHEN raw[1] IN ('"', '''') THEN raw[2:len(raw) - 1] ELSE raw END AS value FROM attributes WHERE raw IS NOT NULL),
hrefs AS (
  SELECT page_id, url, is_base, regexp_replace(trim(array_to_string(list_transform(regexp_extract_all(
    value, '&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);|[^&]+|&'), lambda p: {_REFERENCE_SQL}), '')), '#.*$', '') AS href
  FROM plain, known),
sites AS (
  SELECT page_id, any_value(regexp_extract(url, '^([a-z]+:)', 1)) AS scheme, any_value(lower(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1))) AS own,
         any_value(regexp_extract(href, '^//[^/]*')) FILTER (WHERE is_base) AS base FROM hrefs GROUP BY page_id),
targets AS (
  SELECT DISTINCT page_id, CASE WHEN href LIKE '//%' THEN scheme || lower(regexp_extract(href, '^//[^/?]*')) || regexp_replace(href, '^//[^/?]*', '')
      WHEN href LIKE '/%' THEN coalesce(scheme || base, own) || href
      WHEN href LIKE '../%' THEN coalesce(scheme || base, own) || href[3:] END AS target_url
  FROM hrefs JOIN sites USING (page_id) WHERE NOT is_base)"""


@query(with_sql(_FORM_LINKS, select="SELECT page_id, target_url FROM targets"))
def extract_outlinks_forms(spark: SparkSession, sf: str) -> DataFrame:
    pages = spread(table(spark, sf, "pages"))
    html = F.col("html")
    for number, form in _FORMS.items():
        changed = F.regexp_replace("html", _LINK, form)
        changed = F.concat(F.lit(_BASE), changed) if number == 3 else changed
        html = F.when(F.pmod("page_id", F.lit(6)) == number, changed).otherwise(html)
    return webcorpus.extract_outlinks(pages.withColumn("html", html))


@query(with_sql(_LINKS, select="SELECT page_id, target_id FROM page_pairs"))
def link_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return linked_pages(spark, sf)


@query(
    with_sql(_LINKS, select="SELECT page_id, target_url FROM all_links WHERE target_url NOT IN (SELECT target_url FROM urls)")
)
def dangling_links(spark: SparkSession, sf: str) -> DataFrame:
    return webcorpus.dangling_links(table(spark, sf, "pages"), page_links(spark, sf))


@query(
    with_sql(
        _LINKS,
        "numbered AS (SELECT *, row_number() OVER (ORDER BY page_id, target_id) AS user_id FROM page_pairs)",
        select="""SELECT page_id AS item_id, user_id, CAST(0 AS BIGINT) AS timestamp FROM numbered
                  UNION ALL SELECT target_id, user_id, 1 FROM numbered""",
    )
)
def pairs_to_interactions(spark: SparkSession, sf: str) -> DataFrame:
    return webcorpus.pairs_to_interactions(linked_pages(spark, sf))


@query(
    r"""SELECT doc_id AS item_id, replace(text, chr(10), '\n') AS description, '' AS title, '' AS tag FROM documents"""
)
def docs_to_item_info(spark: SparkSession, sf: str) -> DataFrame:
    return webcorpus.docs_to_item_info(table(spark, sf, "documents"))


_PAGE_TEXT = r"""page_texts AS (
  SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text
  FROM pages)"""


@query(
    with_sql(
        _LINKS,
        _PAGE_TEXT,
        _vectors_sql("pv", "page_texts", "page_id"),
        "numbered AS (SELECT *, row_number() OVER (ORDER BY page_id, target_id) AS user_id FROM page_pairs)",
        select="""SELECT user_id, page_id, target_id, round(list_cosine_similarity(a.vec, b.vec), 9) AS score
                  FROM numbered JOIN pv a ON a.id = page_id JOIN pv b ON b.id = target_id
                  WHERE list_cosine_similarity(a.vec, b.vec) >= 0.55""",
    )
)
def curate(spark: SparkSession, sf: str) -> DataFrame:
    pages = spread(table(spark, sf, "pages")).select("page_id", webcorpus.page_text(F.col("html")).alias("text"))
    vectors = scoring.embed_table(pages, "page_id", "text", leakage.hashed_words(DIM))
    return webcorpus.curate(linked_pages(spark, sf), vectors.withColumnRenamed("page_id", "item_id"), 0.55)
