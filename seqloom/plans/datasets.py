"""Input checks, sampling, id maps, statistics, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom import sources
from seqloom.operators import idmap, sampling, sequences, stats, text, validate
from seqloom.operators.ordering import global_rank
from seqloom.plans.registry import query
from seqloom.plans.views import (
    ENCODED,
    INTER,
    ITEMS,
    LENGTH,
    LOG,
    ORDER_INTER,
    SEED,
    USERS,
    encoded,
    histories,
    inter,
    item_map,
    joined,
    order_inter,
    rounded,
    table,
    user_map,
    with_sql,
)
from seqloom.session import scratch_path

PART_INFO = """info AS (
  SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_name AS title, p_brand AS tag, p_type AS description FROM part)"""


def part_info(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("item_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("tag"),
        F.col("p_type").alias("description"),
    )


# Sources and sinks: each query writes a table derived from the given ones and reads it back.


@query(with_sql(INTER, select="SELECT item_id, user_id, timestamp FROM inter"))
def read_interactions_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "interactions-csv")
    sources.write_interactions(inter(spark, sf), path)
    return sources.read_interactions(spark, path).drop("row_ord")


@query(with_sql(ORDER_INTER, select="SELECT item_id, user_id, timestamp FROM ointer"))
def read_interactions_parquet(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "interactions-parquet")
    order_inter(spark, sf).select("item_id", "user_id", "timestamp").write.parquet(path)
    return sources.read_interactions(spark, path, "parquet").drop("row_ord")


@query("SELECT CAST(p_partkey AS VARCHAR) AS item_id FROM part")
def read_item_catalog_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "catalog-csv")
    parts = part_info(spark, sf).select("item_id", F.lit("none").alias("user_id"), F.lit(0).alias("timestamp"))
    sources.write_interactions(parts, path)
    return sources.read_item_catalog(spark, path).select("item_id")


@query("SELECT CAST(doc_id AS VARCHAR) AS item_id, text AS description, lang AS tag FROM documents")
def read_item_info_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "info-csv")
    docs = table(spark, sf, "documents")
    sources.write_item_info(
        docs.select(
            F.col("doc_id").alias("item_id"), F.col("text").alias("description"), F.col("lang").alias("tag"), "n_chars"
        ),
        path,
    )
    return sources.read_item_info(spark, path, ["description", "tag"])


@query(
    """SELECT source AS item_id, arg_max(lang, doc_id) AS title, max(doc_id) AS description
       FROM documents GROUP BY source"""
)
def last_item_info_row(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        F.col("source").alias("item_id"), F.col("lang").alias("title"), F.col("doc_id").alias("description"), "doc_id"
    )
    return sources.readers.last_row_per_item(docs, ["title", "description"], "doc_id")


# Conforming and checks.


@query(
    """SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(o_orderkey AS VARCHAR) AS item_id,
              o_orderstatus AS timestamp FROM orders"""
)
def conform_columns(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("timestamp"),
        F.col("o_custkey").cast("string").alias("user"),
        F.col("o_orderkey").cast("string").alias("item"),
    )
    return validate.conform_columns(raw, {"user": "user_id", "item": "item_id"}, ["item_id", "user_id", "timestamp"])


@query("SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_name AS title, '' AS tag, '' AS description FROM part")
def add_constant_columns(spark: SparkSession, sf: str) -> DataFrame:
    return validate.add_constant_columns(
        part_info(spark, sf).select("item_id", "title"), {"tag": "", "description": ""}
    )


@query("SELECT DISTINCT 'user_id,item_id,timestamp' AS header FROM events")
def check_headers(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "headers")
    log = inter(spark, sf)
    sources.write_interactions(log, path)
    log.select("user_id", "item_id", "timestamp").write.mode("append").csv(path, header=True)
    # Files that begin with a byte order mark are in order.
    marked = F.concat(F.lit(f"\ufeff{validate.HEADER}\n"), F.concat_ws(",", "item_id", "user_id", "timestamp"))
    log.limit(1).select(marked).write.mode("append").text(path)
    return validate.check_headers(spark, path).select("header").distinct()


# Page URLs as untidy interactions: language, host, and a field that is often empty or no number.
RAW_PAGES = r"""raw AS (
  SELECT page_id, regexp_extract(url, '/([a-z]{2})/', 1) AS item_id, regexp_extract(url, '://([^/]+)/', 1) AS user_id,
         regexp_extract(url, 'page=([0-9]+)', 1) AS timestamp, regexp_extract(url, '([^/]*)/?$', 1) AS last_part
  FROM pages)"""


def raw_pages(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id",
        F.regexp_extract(url, "/([a-z]{2})/", 1).alias("item_id"),
        F.regexp_extract(url, "://([^/]+)/", 1).alias("user_id"),
        F.regexp_extract(url, "page=([0-9]+)", 1).alias("timestamp"),
        F.regexp_extract(url, "([^/]*)/?$", 1).alias("last_part"),
    )


@query(
    with_sql(
        RAW_PAGES,
        select="""SELECT page_id, item_id, user_id, timestamp FROM raw
                  WHERE item_id IS NULL OR item_id = '' OR user_id IS NULL OR user_id = ''
                     OR timestamp IS NULL OR timestamp = ''""",
    )
)
def invalid_rows(spark: SparkSession, sf: str) -> DataFrame:
    return validate.invalid_rows(raw_pages(spark, sf)).drop("last_part")


# The same fields as lines of a CSV file, some with a field too many (empty or not) and some with one too few.
@query(
    with_sql(
        RAW_PAGES,
        """fields AS (SELECT *, item_id || ',' || user_id AS two, item_id || ',' || user_id || ',' || timestamp AS three FROM raw),
        lines AS (
          SELECT item_id, user_id, CASE WHEN page_id % 4 = 3 THEN '' ELSE timestamp END AS timestamp,
                 CASE page_id % 4 WHEN 1 THEN three || ',' WHEN 2 THEN three || ',more' WHEN 3 THEN two ELSE '' END AS extra
          FROM fields)""",
        select="""SELECT item_id, user_id, timestamp, extra, count(*) AS rows FROM lines
                  WHERE item_id = '' OR user_id = '' OR timestamp = '' OR extra <> '' GROUP BY ALL""",
    )
)
def invalid_rows_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "dirty-csv")
    three = F.concat_ws(",", "item_id", "user_id", "timestamp")
    kind = F.pmod("page_id", F.lit(4))
    line = F.when(kind == 1, F.concat(three, F.lit(","))).when(kind == 2, F.concat(three, F.lit(",more")))
    line = line.when(kind == 3, F.concat_ws(",", "item_id", "user_id")).otherwise(three)
    # Every file begins with a header: one row of text holds all lines of a batch of pages.
    batch = raw_pages(spark, sf).groupBy(F.pmod("page_id", F.lit(16)).alias("file")).agg(F.array_join(F.collect_list(line), "\n").alias("lines"))
    whole = F.concat(F.lit(validate.HEADER + "\n"), F.col("lines"))
    batch.repartitionById(16, F.col("file").cast("int")).select(whole).write.text(path)
    found = validate.invalid_rows(sources.readers.read_raw_interactions(spark, path))
    fields = [F.coalesce(c, F.lit("")).alias(c) for c in ("item_id", "user_id", "timestamp", "extra")]
    return found.groupBy(*fields).agg(F.count(F.lit(1)).alias("rows"))


@query(
    with_sql(
        RAW_PAGES,
        select=r"""SELECT page_id, last_part FROM raw
                   WHERE NOT regexp_matches(last_part, '^\s*[+-]?\d+(_\d+)*\s*$')""",
    )
)
def invalid_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    return validate.invalid_timestamps(raw_pages(spark, sf), "last_part").select("page_id", "last_part")


@query(
    with_sql(
        ORDER_INTER, select="SELECT user_id, count(*) AS n FROM ointer GROUP BY user_id HAVING count(*) < 4"
    )
)
def short_history_users(spark: SparkSession, sf: str) -> DataFrame:
    return validate.short_history_users(order_inter(spark, sf))


@query(
    """SELECT count(DISTINCT l_suppkey) AS items FROM lineitem HAVING count(DISTINCT l_suppkey) < 200"""
)
def catalog_too_small(spark: SparkSession, sf: str) -> DataFrame:
    return validate.catalog_too_small(table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "item_id"))


@query(
    with_sql(
        ORDER_INTER,
        select="""SELECT count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items,
                         count(*) AS interactions FROM ointer""",
    )
)
def interaction_summary(spark: SparkSession, sf: str) -> DataFrame:
    return validate.interaction_summary(order_inter(spark, sf))


# Parts of the first size only form the catalogue here, so other parts have no id.
@query(
    """SELECT coalesce(bool_or(p.p_partkey IS NULL), false) AS null_items, false AS null_users,
              count(*) FILTER (WHERE p.p_partkey IS NULL) AS rows
       FROM lineitem l LEFT JOIN (SELECT * FROM part WHERE p_size <= 25) p ON p.p_partkey = l.l_partkey"""
)
def null_id_report(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    parts = table(spark, sf, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("item_id"))
    rows = lines.join(parts, F.col("l_partkey") == F.col("item_id"), "left")
    return validate.null_id_report(rows.select("item_id", F.col("l_orderkey").alias("user_id")))


@query(
    with_sql(
        ORDER_INTER,
        select="""SELECT DISTINCT item_id FROM ointer
                  WHERE item_id NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size <= 25)""",
    )
)
def missing_item_text(spark: SparkSession, sf: str) -> DataFrame:
    info = table(spark, sf, "part").filter("p_size <= 25").select(F.col("p_partkey").cast("string").alias("item_id"))
    return validate.missing_item_text(order_inter(spark, sf), info)


# Sampling.

_DROPPED = """dropped AS (
  SELECT o_custkey FROM (
    SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) - 1 AS r, count(*) OVER () AS c
    FROM (SELECT DISTINCT o_custkey FROM orders))
  WHERE r < floor(c * (1 - 25 / 100.0::DOUBLE)))"""


@query(
    with_sql(
        _DROPPED,
        select="SELECT o_custkey AS user_id, o_orderkey AS item_id FROM orders WHERE o_custkey NOT IN (FROM dropped)",
    )
)
def drop_user_fraction(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("item_id"))
    return sampling.drop_user_fraction(log, 25)


@query(
    with_sql(
        _DROPPED,
        select="""SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(o_orderkey AS VARCHAR) AS item_id FROM orders
                  WHERE o_custkey NOT IN (FROM dropped)""",
    )
)
def drop_user_fraction_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The same over a CSV file, whose ids are read as text and sort as numbers."""
    path = scratch_path(spark, "orders-csv")
    log = table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("user_id"), F.lit(0).alias("timestamp"))
    sources.write_interactions(log, path)
    return sampling.drop_user_fraction(sources.read_interactions(spark, path), 25).select("user_id", "item_id")


@query(
    with_sql(
        ORDER_INTER,
        select="""SELECT user_id, item_id, count(*) AS n FROM ointer
                  WHERE user_id NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < 0)
                  GROUP BY user_id, item_id""",
    )
)
def anti_filter_users(spark: SparkSession, sf: str) -> DataFrame:
    dropped = table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").cast("string").alias("user_id"))
    kept = sampling.anti_filter_users(order_inter(spark, sf), dropped)
    return kept.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    with_sql(
        _DROPPED,
        PART_INFO,
        select="""SELECT * FROM info WHERE item_id IN (
                    SELECT CAST(l_partkey AS VARCHAR) FROM lineitem JOIN orders ON l_orderkey = o_orderkey
                    WHERE o_custkey NOT IN (FROM dropped))""",
    )
)
def semi_filter_items(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey")
    kept = sampling.drop_user_fraction(orders, 25)
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").cast("string").alias("item_id"))
    log = lines.join(kept, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return sampling.semi_filter_items(part_info(spark, sf), log)


@query(
    """SELECT CAST(d.doc_id AS BIGINT) AS user_id, d.source, round(l.quality * 0.4::DOUBLE + l.toxic * 0.3::DOUBLE, 6) AS score
       FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE round(l.quality * 0.4::DOUBLE + l.toxic * 0.3::DOUBLE, 6) >= 0.35"""
)
def filter_by_relevance(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "documents").select(F.col("doc_id").alias("user_id"), "source")
    score = rounded(F.col("quality") * 0.4 + F.col("toxic") * 0.3)
    scores = table(spark, sf, "labels").select(F.col("doc_id").alias("user_id"), score.alias("score"))
    return sampling.filter_by_relevance(pairs, scores, 0.35)


@query(
    r"""SELECT doc_id, array_to_string(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')[1:100], ' ') AS text
        FROM documents"""
)
def truncate_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", sampling.truncate_words(F.col("text")).alias("text"))


@query(f"SELECT doc_id, lang FROM documents ORDER BY md5('{SEED}|' || doc_id), doc_id LIMIT 100")
def random_documents(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.random_documents(table(spark, sf, "documents").select("doc_id", "lang"), 100, SEED)


@query(
    with_sql(
        *LOG,
        select="SELECT user_id, item_id, timestamp FROM pos WHERE pos >= n - ((n * 30 + 99) // 100)",
    )
)
def interaction_fraction(spark: SparkSession, sf: str) -> DataFrame:
    kept = sampling.interaction_fraction(encoded(spark, sf), 30, ["timestamp", "row_ord"])
    return kept.select("user_id", "item_id", "timestamp")


# Id maps.


@query("SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS rank FROM part")
def dense_rank_distributed(spark: SparkSession, sf: str) -> DataFrame:
    return global_rank(table(spark, sf, "part").select("p_partkey", "p_retailprice"), ["p_retailprice", "p_partkey"])


@query(
    with_sql(INTER, ITEMS, select="SELECT token, id FROM items UNION ALL SELECT '[PAD]', 0")
)
def factorize_items(spark: SparkSession, sf: str) -> DataFrame:
    return idmap.factorize(inter(spark, sf), "item_id", ["row_ord"])


@query(
    """WITH cat AS (
         SELECT CAST(p_partkey AS VARCHAR) AS token, row_number() OVER (ORDER BY p_partkey) AS id
         FROM part WHERE p_size <= 25),
       other AS (
         SELECT CAST(l_partkey AS VARCHAR) AS token, min(l_orderkey * 100 + l_linenumber) AS first
         FROM lineitem GROUP BY l_partkey)
       SELECT token, id FROM cat UNION ALL SELECT '[PAD]', 0 UNION ALL
       SELECT token, row_number() OVER (ORDER BY first, token) + (SELECT count(*) FROM cat) AS id
       FROM other WHERE token NOT IN (SELECT token FROM cat)"""
)
def factorize_with_catalog(spark: SparkSession, sf: str) -> DataFrame:
    catalog = table(spark, sf, "part").filter("p_size <= 25").select(
        F.col("p_partkey").cast("string").alias("item_id"), F.col("p_partkey").alias("row_ord")
    )
    lines = table(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("string").alias("item_id"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("row_ord"),
    )
    return idmap.factorize_with_catalog(catalog, lines, ["row_ord"], ["row_ord"])


@query(with_sql(INTER, USERS, ITEMS, ENCODED, select="SELECT user_id, item_id, timestamp, row_ord FROM enc"))
def encode_ids(spark: SparkSession, sf: str) -> DataFrame:
    return idmap.encode_ids(inter(spark, sf), user_map(spark, sf), item_map(spark, sf))


@query(
    with_sql(
        *LOG,
        select=f"""SELECT p.user_id,
                   repeat('0,', greatest({LENGTH} - CAST(max(n) - 1 AS INT), 0)) ||
                   string_agg(i.token, ',' ORDER BY p.pos) AS item_seq
            FROM pos p JOIN items i ON i.id = p.item_id WHERE p.pos < p.n - 1 AND p.pos >= p.n - 1 - {LENGTH}
            GROUP BY p.user_id""",
    )
)
def decode_ids(spark: SparkSession, sf: str) -> DataFrame:
    examples = sequences.eval_examples(histories(spark, sf), "test", LENGTH)
    decoded = idmap.decode_ids(examples, item_map(spark, sf), ["user_id"], "item_seq")
    return decoded.select("user_id", joined(F.col("item_seq")).alias("item_seq"))


# Statistics.


@query(
    with_sql(
        ORDER_INTER,
        select="""SELECT round(avg(n), 6) AS avg_actions_of_users
                  FROM (SELECT count(*) AS n FROM ointer GROUP BY user_id)""",
    )
)
def avg_actions_of_users(spark: SparkSession, sf: str) -> DataFrame:
    df = stats.avg_actions_of_users(order_inter(spark, sf))
    return df.select(rounded("avg_actions_of_users").alias("avg_actions_of_users"))


@query(
    with_sql(
        ORDER_INTER,
        select="""SELECT round(avg(n), 6) AS avg_actions_of_items
                  FROM (SELECT count(*) AS n FROM ointer GROUP BY item_id)""",
    )
)
def avg_actions_of_items(spark: SparkSession, sf: str) -> DataFrame:
    df = stats.avg_actions_of_items(order_inter(spark, sf))
    return df.select(rounded("avg_actions_of_items").alias("avg_actions_of_items"))


_PROFILE = """profile AS (
  SELECT count(DISTINCT user_id) + 1 AS user_num, count(DISTINCT item_id) + 1 AS item_num, count(*) AS inter_num,
         round(count(*) / count(DISTINCT user_id), 6) AS avg_actions_of_users,
         round(count(*) / count(DISTINCT item_id), 6) AS avg_actions_of_items
  FROM ointer)"""


@query(
    with_sql(ORDER_INTER, _PROFILE, select="SELECT round(1 - inter_num / user_num / item_num, 6) AS sparsity FROM profile")
)
def sparsity(spark: SparkSession, sf: str) -> DataFrame:
    return stats.sparsity(order_inter(spark, sf)).select(rounded("sparsity").alias("sparsity"))


@query(
    with_sql(
        ORDER_INTER, _PROFILE, select="SELECT *, round(1 - inter_num / user_num / item_num, 6) AS sparsity FROM profile"
    )
)
def dataset_profile(spark: SparkSession, sf: str) -> DataFrame:
    df = stats.dataset_profile(order_inter(spark, sf))
    return df.withColumns({c: rounded(c) for c in ("avg_actions_of_users", "avg_actions_of_items", "sparsity")})


@query(with_sql(ORDER_INTER, select="SELECT user_id, count(*) AS n FROM ointer GROUP BY user_id"))
def user_counter(spark: SparkSession, sf: str) -> DataFrame:
    return stats.user_counter(order_inter(spark, sf))


@query(with_sql(ORDER_INTER, select="SELECT item_id, count(*) AS n FROM ointer GROUP BY item_id"))
def item_counter(spark: SparkSession, sf: str) -> DataFrame:
    return stats.item_counter(order_inter(spark, sf))


@query(
    with_sql(
        *LOG,
        """edges AS (
             SELECT user_id AS src, item_id + (SELECT count(*) + 1 FROM users) AS dst FROM enc
             UNION ALL SELECT item_id + (SELECT count(*) + 1 FROM users), user_id FROM enc)""",
        "deg AS (SELECT src AS node, count(*) AS d FROM edges GROUP BY src)",
        select="""SELECT src, dst, round(1 / sqrt(a.d * b.d), 6) AS weight
                  FROM edges JOIN deg a ON a.node = src JOIN deg b ON b.node = dst""",
    )
)
def normalized_adjacency(spark: SparkSession, sf: str) -> DataFrame:
    user_num = user_map(spark, sf).count()
    edges = stats.normalized_adjacency(encoded(spark, sf), user_num)
    return edges.select("src", "dst", rounded("weight").alias("weight"))


@query(
    with_sql(
        ORDER_INTER,
        PART_INFO,
        select="""SELECT DISTINCT o.item_id,
                    CASE WHEN i.item_id IS NULL THEN '' ELSE 'Item: ' || coalesce('title: ' || nullif(title, ''), '')
                      || coalesce('tag: ' || nullif(tag, ''), '') || coalesce('description: ' || nullif(description, ''), '')
                    END AS text
                  FROM ointer o LEFT JOIN (
                    SELECT item_id, title, CASE WHEN tag = 'Brand#1' THEN NULL ELSE tag END AS tag, description
                    FROM info WHERE title NOT LIKE 'red%') i ON i.item_id = o.item_id""",
    )
)
def item_text(spark: SparkSession, sf: str) -> DataFrame:
    items = order_inter(spark, sf).select("item_id").distinct()
    info = part_info(spark, sf).filter(~F.col("title").startswith("red"))
    info = info.withColumn("tag", F.when(F.col("tag") != "Brand#1", F.col("tag")))
    return text.item_text(items, info, prompt="Item: ")
