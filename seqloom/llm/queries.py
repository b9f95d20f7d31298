"""Registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import bpe, chat, jaccard, lines, mixing, neighbours, packing, quality, resample, secrets, spelling, substrings, warc
from seqloom.plans.registry import Query
from seqloom.plans.views import CRC_TABLE, crc_sql
from seqloom.session import scratch_path

# The JSON file of the tokenizer and the same vocabulary as ranks.
TOKENIZER = [str(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        if sql is not None:
            _SQL[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query()
def op1_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.piece_digests(packing.pack(table(spark, sf, "documents"), *TOKENIZER))


_LINES_SQL = """WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
nb AS (
  SELECT doc_id, pos, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS t,
         row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k
  FROM l WHERE trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
w AS (SELECT a.doc_id, a.k, a.t || chr(10) || b.t AS run FROM nb a JOIN nb b ON b.doc_id = a.doc_id AND b.k = a.k + 1),
f AS (SELECT *, first_value(doc_id) OVER o AS fd, first_value(k) OVER o AS fk
      FROM w WINDOW o AS (PARTITION BY run ORDER BY doc_id, k)),
gone AS (
  SELECT DISTINCT doc_id, unnest([k, k + 1]) AS k FROM f WHERE fd < doc_id OR fk + 2 <= k),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text
  FROM l LEFT JOIN nb USING (doc_id, pos) LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.k = nb.k
  WHERE g.k IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n.n_lines, 0) AS n_lines, coalesce(g.n_removed, 0) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n_lines FROM nb GROUP BY 1) n USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY 1) g USING (doc_id)"""


@query(_LINES_SQL)
def op2_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    left = lines.line_dedup(table(spark, sf, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return left.select("doc_id", "n_lines", "n_removed", digest.alias("kept_sha256"))


# The same with lines of ten words or 60 characters as runs of one line.
_LONG_LINES_SQL = """WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
nb AS (
  SELECT doc_id, pos, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS t,
         row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k
  FROM l WHERE trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
w AS (
  SELECT a.doc_id, a.k, 2 AS size, a.t || chr(10) || b.t AS run FROM nb a JOIN nb b ON b.doc_id = a.doc_id AND b.k = a.k + 1
  UNION ALL
  SELECT doc_id, k, 1, t FROM nb WHERE length(t) >= 60 OR len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) >= 10),
f AS (SELECT *, first_value(doc_id) OVER o AS fd, first_value(k) OVER o AS fk
      FROM w WINDOW o AS (PARTITION BY size, run ORDER BY doc_id, k)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(k, k + size)) AS k FROM f WHERE fd < doc_id OR fk + size <= k),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text
  FROM l LEFT JOIN nb USING (doc_id, pos) LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.k = nb.k
  WHERE g.k IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n.n_lines, 0) AS n_lines, coalesce(g.n_removed, 0) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n_lines FROM nb GROUP BY 1) n USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY 1) g USING (doc_id)"""


@query(_LONG_LINES_SQL)
def op2_line_dedup_long(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    left = lines.line_dedup(docs, long_line=lines.LONG_LINE)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return left.select("doc_id", "n_lines", "n_removed", digest.alias("kept_sha256"))


@query()
def op3_secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf, "documents"))
    of_kind = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[of_kind(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.spans_text(F.col("base")), 256).alias("base_sha256"),
        secrets.spans_text(F.col("spans")).alias("spans"),
    )


@query()
def op4_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    joined = jaccard.jaccard_components(table(spark, sf, "documents"), shingle=3, percent=90)
    return joined.select("doc_id", "n_shingles", "component_id", "class_id")


@query()
def op5_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf, "documents"), weights=(5, 2, 1))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken, "source", "copies")


@query()
def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, sf, "documents").select("doc_id", "text", "lang"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query()
def op7_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.substring_dedup(table(spark, sf, "documents"), texts=False)


PROBE = "</s>[INST] ok [/INST]"


@query()
def op8_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], rows.schema)
    messages = chat.fold_events(chat.message_events(rows.unionByName(probe)))
    return chat.read_back(chat.render(messages))


@query()
def op9_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return neighbours.nearest_neighbours(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


@query()
def op10_warc(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    payloads, headers = warc.store(pages, warc.make_records(pages, min_bytes=0))
    sizes = headers.agg(F.sum(F.length("header")).alias("chars"), F.count(F.lit(1)).alias("n")).first()
    chars = (sizes["chars"] or 0) + (payloads.agg(F.sum(F.length("payload"))).first()[0] or 0)
    path = scratch_path(spark, "warc")
    warc.write_archives(warc.reconstruct(payloads, headers), path, chars / max(1, sizes["n"]))
    read = warc.read_archives(spark, path)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    read = read.select(
        page("record_id").alias("page_id"), "record_type", page("refers_to").alias("refers_to"), "bytes", "digest", "stated"
    )
    return with_full_payload(read)


def with_full_payload(read: DataFrame) -> DataFrame:
    """Length and digest of the payload behind every record: a revisit takes those of its response."""
    revisits = read.filter("record_type = 'revisit'")
    full = read.filter("record_type = 'response'")
    response = full.select(F.col("page_id").alias("refers_to"), "bytes", "digest").filter("refers_to is not null")
    found = revisits.drop("bytes", "digest").join(response.dropDuplicates(["refers_to"]), "refers_to")
    both = full.unionByName(found)
    return both.select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"
    )


_UPPER_LOWER = f"'{spelling.UPPER}', '{spelling.LOWER}'"

_RESAMPLE_SQL = f"""WITH {CRC_TABLE},
words AS (
  SELECT doc_id, false AS wanted, unnest(regexp_extract_all(translate(text, {_UPPER_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word
  FROM documents
  UNION ALL
  SELECT NULL, true, unnest(regexp_extract_all(translate(text, {_UPPER_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'))
  FROM benchmark),
hashed AS (SELECT word, {crc_sql("word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM words), crc_table),
placed AS (SELECT w.doc_id, w.wanted, h.bucket FROM words w JOIN hashed h USING (word)),
counts AS (SELECT bucket, count(*) FILTER (NOT wanted) AS s, count(*) FILTER (wanted) AS t FROM placed GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE + 10000 AS all_s, coalesce(sum(t), 0)::DOUBLE + 10000 AS all_t FROM counts),
gains AS (
  SELECT bucket, floor(1000.0::DOUBLE * ln(((t + 1)::DOUBLE * all_s) / ((s + 1)::DOUBLE * all_t)))::BIGINT AS gain
  FROM counts, totals),
weighed AS (
  SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight
  FROM placed JOIN gains USING (bucket) WHERE NOT wanted GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(w.n_features, 0) AS n_features, coalesce(w.weight, 0) AS weight,
         coalesce(w.weight, 0) + floor(-1000.0::DOUBLE * ln(-ln(
           (('0x' || substr(sha256('2024:' || d.doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM documents d LEFT JOIN weighed w USING (doc_id)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
         count(*) FILTER (n_features >= 20) OVER () AS n
  FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank
FROM ranked"""


@query(_RESAMPLE_SQL)
def op11_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return resample.importance_resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


_SPELLING_SQL = f"""WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), {_UPPER_LOWER}) AS run FROM documents),
hashed AS (
  SELECT run, times, {crc_sql("doc_id::VARCHAR || ':' || run")} AS h
  FROM (SELECT doc_id, run, count(*) AS times FROM runs WHERE length(run) >= 7 GROUP BY 1, 2), crc_table),
changed AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times
  FROM hashed),
v AS MATERIALIZED (
  SELECT word, sum(times)::BIGINT AS n FROM changed WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
cut AS MATERIALIZED (
  SELECT word, n, p, length(word) AS size, substr(word, 1, p - 1) || substr(word, p + 1) AS rest
  FROM v, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS p)),
near AS MATERIALIZED (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.p = b.p AND a.size = b.size AND a.word <> b.word
  UNION
  SELECT c.word, c.n, v.word, v.n FROM cut c JOIN v ON v.word = c.rest
  UNION
  SELECT v.word, v.n, c.word, c.n FROM cut c JOIN v ON v.word = c.rest),
best AS (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place, count(*) OVER (PARTITION BY word) AS n_near
  FROM near),
formed AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near,
         CASE WHEN b.other_n >= 10 * v.n THEN b.other END AS form, CASE WHEN b.other_n >= 10 * v.n THEN b.other_n END AS form_n
  FROM v LEFT JOIN best b ON b.word = v.word AND b.place = 1),
chain AS (
  SELECT word, word AS at FROM formed
  UNION ALL
  SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.at AS root FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM formed f JOIN ends e ON e.word = f.word"""


@query(_SPELLING_SQL)
def op12_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    words = spelling.noisy_words(table(spark, sf, "documents"))
    return spelling.spelling_variants(spelling.vocabulary(words))


@query()
def op13_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, TOKENIZER[1], public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids")
    back = bpe.decode(coded, TOKENIZER[1])
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
