"""Every registered query of the engine and the DuckDB SQL it is held against."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.extract.json_rows import response_rows, value_at
from tessera.extract.selectors import alias_rows, chapter_rows, detail_fields, image_rows, page_fields, page_rows, plain_rows
from tessera.functions import text as X
from tessera.functions import urls as U
from tessera.functions import values as V
from tessera.operators import health as H
from tessera.operators import keyed as K
from tessera.operators import similarity as S
from tessera.operators.stored import shared_folder
from tessera.plans import search, source_search
from tessera.sources.buckets import BucketTable
from tessera.sources.clustered import PagedLog, write_clustered
from tessera.sources.postings import Postings
from tessera.sources.tables import table
from tessera.streaming import rollups as R
from tessera.streaming import timers as T

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that it is held against."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def folder(spark: SparkSession) -> str:
    """Where iterative operators write their rounds: in the shared folder that the session names."""
    return f"{shared_folder(spark)}/rounds"


# --- search ---------------------------------------------------------------------------------------------------

_HITS = """SELECT 'documents' AS source, 0 AS rank, doc_id AS item, contains(lower(text), 'ing') AS hit FROM documents
UNION ALL SELECT 'benchmark', 1, item_id, contains(lower(text), 'ing') FROM benchmark
UNION ALL SELECT 'conversations', 1, conv_id, contains(lower(text), 'ing') FROM conversations
UNION ALL SELECT 'pages', 2, page_id, contains(lower(html), 'ing') FROM pages"""


@query(f"""SELECT source, rank, count(*) AS searched, count(*) FILTER (hit) AS results, min(item) FILTER (hit) AS first_item, count(*) FILTER (hit) > 0 AS ok
FROM ({_HITS}) GROUP BY source, rank""")
def aggregated_search(spark: SparkSession, d: str) -> DataFrame:
    return search.aggregated_search(spark, d, "ing")


@query(f"""SELECT CAST(sum(results) AS BIGINT) AS total, count(*) AS sources, count(*) FILTER (results = 0) AS empty
FROM (SELECT source, count(*) FILTER (hit) AS results FROM ({_HITS}) GROUP BY source)""")
def search_summary(spark: SparkSession, d: str) -> DataFrame:
    return search.summary(search.aggregated_search(spark, d, "ing"))


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'src1')")
def keyword_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(search.matches(F.col("text"), "License") | search.matches(F.col("source"), "SRC1")).select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'license')")
def keyword_postings(spark: SparkSession, d: str) -> DataFrame:
    """The texts with a keyword by an index of runs of three characters."""
    index = Postings(spark, f"{folder(spark)}/{uuid.uuid4().hex}")
    index.build(table(spark, d, "documents").select("doc_id", "source", "text"), "text")
    return index.search("License").select("doc_id", "source")


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id LIMIT 50 OFFSET 900")
def log_page_deep(spark: SparkSession, d: str) -> DataFrame:
    """A page far behind, from a log that is stored in order."""
    log = PagedLog(spark, f"{folder(spark)}/{uuid.uuid4().hex}")
    log.build(table(spark, d, "events").select("event_id", "ts", "event_type"), F.desc("ts"), F.col("event_id"))
    return log.page(50, 900)


@query("SELECT event_id, user_id, value FROM events WHERE event_id = 77 OR user_id = 3")
def look_up_clustered(spark: SparkSession, d: str) -> DataFrame:
    """Rows by the key that the file is clustered by, and by another one with a Bloom filter."""
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    write_clustered(table(spark, d, "events").select("event_id", "user_id", "value"), path, ["event_id"], {"user_id": 1000})
    rows = spark.read.parquet(path)
    return rows.filter("event_id = 77").unionByName(rows.filter("user_id = 3 and event_id <> 77"))


@query("""SELECT source, word, ord FROM (SELECT source, word, ord, row_number() OVER (PARTITION BY source ORDER BY ord) AS r FROM
(SELECT DISTINCT d.source, k.word, k.ord FROM documents d JOIN (VALUES ('license', 0), ('moron', 1), ('the', 2)) k(word, ord) ON contains(d.text, k.word))) WHERE r = 1""")
def first_match(spark: SparkSession, d: str) -> DataFrame:
    """For each source the first test keyword that finds anything: one pass, keywords as an array beside each text."""
    words = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(w).alias("word")) for i, w in enumerate(["license", "moron", "the"])])
    found = F.get(F.filter(words, lambda w: F.contains(F.col("text"), w["word"])), F.lit(0))
    best = table(spark, d, "documents").select("source", found.alias("k")).filter("k is not null").groupBy("source").agg(F.min("k").alias("k"))
    return best.select("source", "k.word", "k.ord")


# --- logs and keyed tables ------------------------------------------------------------------------------------


@query("SELECT event_id, ts, user_id, value FROM events WHERE event_type = 'error' ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT 50 OFFSET 10")
def log_query(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").filter(F.col("event_type") == "error").select("event_id", "ts", "user_id", "value")
    return K.page(rows, [F.desc("ts"), F.desc("event_id")], 50, 10)


@query("SELECT * FROM customer WHERE c_custkey = 42")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").filter(F.col("c_custkey") == 42)


@query("SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return K.latest_per_key(rows, ["user_id", "event_type"], "ts", "event_id")


@query("""SELECT s_nationkey, s_suppkey, s_name, CAST(r AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r
FROM supplier WHERE s_acctbal > 0) WHERE r <= 2""")
def top1_per_group(spark: SparkSession, d: str) -> DataFrame:
    """First active supplier of a nation and the one to fall back on."""
    order = [F.desc("s_acctbal"), F.col("s_suppkey")]
    active = table(spark, d, "supplier").filter("s_acctbal > 0")
    place = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(*order)).cast("long")
    return K.top_per_key(active, ["s_nationkey"], order, 2).select("s_nationkey", "s_suppkey", "s_name", place.alias("place"))


@query("""SELECT doc_id, quality, toxic FROM labels UNION ALL SELECT doc_id, min(quality), 0 FROM
(SELECT doc_id, 0 AS quality FROM documents UNION ALL SELECT doc_id, 1 FROM documents) WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id""")
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "labels")
    kind = old.schema["quality"].dataType
    new = table(spark, d, "documents").select("doc_id", F.lit(0).cast(kind).alias("quality"), F.lit(0).cast(kind).alias("toxic"))
    twice = new.unionByName(new.withColumn("quality", F.lit(1).cast(kind)))  # each new key comes in two rows
    return K.insert_ignore(old.select("doc_id", "quality", "toxic"), twice, ["doc_id"])


@query("""SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' AND p_size > 25 THEN round(p_retailprice * 0.9, 4) ELSE p_retailprice END AS p_retailprice,
CASE WHEN p_type = 'ECONOMY' AND p_size > 25 THEN 'SALE' ELSE p_type END AS p_type, CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'core' ELSE 'supplement' END AS tier FROM part""")
def conditional_update(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_retailprice", "p_type", "p_size", "p_brand")
    where = (F.col("p_type") == "ECONOMY") & (F.col("p_size") > 25)
    out = K.conditional_update(part, where, p_retailprice=F.round(F.col("p_retailprice") * 0.9, 4), p_type=F.lit("SALE"))
    out = K.add_column(out, "tier", F.lit("supplement"))
    out = K.conditional_update(out, F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3"), tier=F.lit("core"))
    return out.select("p_partkey", "p_retailprice", "p_type", "tier")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def cascade_semi(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return K.delete_cascade(table(spark, d, "orders").select("o_orderkey", "o_custkey"), left, ["o_custkey"])


@query("""SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.quality, o.quality) AS quality, coalesce(n.toxic, o.toxic) AS toxic
FROM labels o FULL JOIN (SELECT doc_id, CAST(n_chars % 2 AS INTEGER) AS quality, CAST(NULL AS INTEGER) AS toxic FROM documents WHERE lang = 'en') n ON o.doc_id = n.doc_id""")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "documents").filter("lang = 'en'").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"))
    return K.upsert(table(spark, d, "labels").select("doc_id", F.col("quality").cast("int"), F.col("toxic").cast("int")), new, ["doc_id"])


@query(ORACLES["upsert_merge"])
def upsert_stored(spark: SparkSession, d: str) -> DataFrame:
    """upsert_merge on a table in buckets: only buckets with new keys are read and written again."""
    new = table(spark, d, "documents").filter("lang = 'en'").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"))
    stored = BucketTable(spark, f"{folder(spark)}/{uuid.uuid4().hex}", ["doc_id"], 16)
    stored.append(table(spark, d, "labels").select("doc_id", F.col("quality").cast("int"), F.col("toxic").cast("int")))
    stored.change(new, lambda old, more: K.upsert(old, more, ["doc_id"]))
    return stored.rows()


@query("""SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.day, b.day) AS day FROM
(SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'click') a FULL JOIN
(SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.day = b.day WHERE a.user_id IS NULL OR b.user_id IS NULL""")
def toggle_symdiff(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    return K.toggle(e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'"), ["user_id", "day"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def anti_missing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT p_name, p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part) WHERE r = 1")
def distinct_first(spark: SparkSession, d: str) -> DataFrame:
    return K.first_per_key(table(spark, d, "part").select("p_name", "p_partkey", "p_brand"), ["p_name"], "p_partkey")


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS c,
min(CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE c = m""")
def fallback_union(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    p, q = F.col("o_orderstatus") == "P", F.col("o_orderstatus") == "O"
    return K.first_non_empty(["o_custkey"], o.filter(p), o.filter(q), o.filter(~(p | q)))


@query("""SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '3-MEDIUM' THEN 1 WHEN '5-LOW' THEN 2 ELSE 9 END,
o_totalprice DESC, o_orderkey LIMIT 20""")
def ranked_topn(spark: SparkSession, d: str) -> DataFrame:
    rank = V.rank_of(F.col("o_orderpriority"), ["1-URGENT", "3-MEDIUM", "5-LOW"])
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy(rank, F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 6")
def topk_recent(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(6)


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users, max(ts) AS latest FROM events GROUP BY 1")
def history_by_date(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.max("ts").alias("latest"))


@query("SELECT user_id, min(ts) FILTER (value > 100) AS first_high, arg_min(value, ts) FILTER (event_type = 'error') AS first_error, count(*) AS n FROM events GROUP BY user_id")
def first_nonnull(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(
        F.min(F.when(F.col("value") > 100, F.col("ts"))).alias("first_high"),
        F.min_by("value", F.when(F.col("event_type") == "error", F.col("ts"))).alias("first_error"),
        F.count("*").alias("n"),
    )


# --- catalog --------------------------------------------------------------------------------------------------

_CATALOG = """SELECT s_suppkey, s_name, n_name, r_name, lower(s_name) || '.example.com' AS host,
CASE WHEN s_acctbal < 0 THEN 'blocked' WHEN s_acctbal < 3000 THEN 'high' WHEN s_acctbal < 6000 THEN 'medium' ELSE 'low' END AS risk
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    bal = F.col("s_acctbal")
    risk = V.first_rule("low", (bal < 0, "blocked"), (bal < 3000, "high"), (bal < 6000, "medium"))
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select("s_suppkey", "s_name", "n_name", "r_name", F.concat(F.lower("s_name"), F.lit(".example.com")).alias("host"), risk.alias("risk"))


@query(f"SELECT s_suppkey, s_name, risk FROM ({_CATALOG}) WHERE risk IN ('low', 'medium') AND (contains(lower(s_name), '7') OR contains(host, '3')) AND n_name IS NOT NULL")
def catalog_filter(spark: SparkSession, d: str) -> DataFrame:
    text = F.lower("s_name").contains("7") | F.col("host").contains("3")
    return _catalog(spark, d).filter(F.col("risk").isin("low", "medium") & text & F.col("n_name").isNotNull()).select("s_suppkey", "s_name", "risk")


@query("""SELECT c_custkey, count(o_orderkey) AS n_children, coalesce(string_agg(o_orderpriority || ':' || o_orderkey, ',' ORDER BY o_orderpriority, o_orderkey), '') AS children
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def catalog_children(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders in order of priority as one column (bounded: one customer's orders)."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority", "o_orderkey")
    joined = table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left")
    items = F.array_sort(F.collect_list(F.when(F.col("o_orderkey").isNotNull(), F.struct("o_orderpriority", "o_orderkey"))))
    text = F.transform(items, lambda x: F.concat(x["o_orderpriority"], F.lit(":"), x["o_orderkey"].cast("string")))
    return joined.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_children"), F.array_join(text, ",").alias("children"))


@query("""SELECT n_nationkey, n_name, coalesce(worst >= 0, true) AS ok, coalesce(n, 0) AS suppliers, coalesce(r_regionkey < 3, false) AS enabled
FROM nation LEFT JOIN (SELECT s_nationkey, min(s_acctbal) AS worst, count(*) AS n FROM supplier GROUP BY 1) ON n_nationkey = s_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey <> 1""")
def catalog_health(spark: SparkSession, d: str) -> DataFrame:
    """Index, health and overrides: what no check has seen counts as well."""
    health = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_acctbal").alias("worst"), F.count("*").alias("n"))
    own = table(spark, d, "region").filter("r_regionkey <> 1").select(F.col("r_regionkey").alias("n_regionkey"), (F.col("r_regionkey") < 3).alias("on"))
    joined = table(spark, d, "nation").join(health, "n_nationkey", "left").join(own, "n_regionkey", "left")
    return joined.select(
        "n_nationkey", "n_name", F.coalesce(F.col("worst") >= 0, F.lit(True)).alias("ok"), F.coalesce("n", F.lit(0)).alias("suppliers"), F.coalesce("on", F.lit(False)).alias("enabled")
    )


@query(f"""SELECT r_name, count(*) AS total, count(*) FILTER (risk = 'low') AS low, count(*) FILTER (risk = 'medium') AS medium, count(*) FILTER (risk = 'high') AS high,
count(*) FILTER (risk = 'blocked') AS blocked FROM ({_CATALOG}) GROUP BY r_name""")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return _catalog(spark, d).groupBy("r_name").agg(F.count("*").alias("total"), *[F.count_if(F.col("risk") == r).alias(r) for r in ("low", "medium", "high", "blocked")])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def semi_verified(spark: SparkSession, d: str) -> DataFrame:
    verified = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(verified, "o_orderkey", "left_semi")


_HOST = r"lower(nullif(regexp_extract(url, '(?i)^https?://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)', 1), ''))"


@query(f"SELECT page_id FROM pages WHERE {_HOST} IN (SELECT {_HOST} FROM pages WHERE starts_with(url, 'https:'))")
def host_semi(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose host is one that some https page has: a computed key on both sides."""
    p = table(spark, d, "pages").select("page_id", "url", U.host_of(F.col("url")).alias("host"))
    return p.join(p.filter(F.col("url").startswith("https:")).select("host"), "host", "left_semi").select("page_id")


# --- health ---------------------------------------------------------------------------------------------------

_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1)"


@query(f"SELECT user_id, count(*) AS checks, CASE WHEN bool_and(value < 50) THEN 'healthy' WHEN bool_or(value < 50) THEN 'degraded' ELSE 'unhealthy' END AS status FROM {_LATEST} GROUP BY user_id")
def health_rollup(spark: SparkSession, d: str) -> DataFrame:
    latest = K.latest_per_key(table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], "ts", "event_id")
    return latest.groupBy("user_id").agg(F.count("*").alias("checks"), H.rollup(F.col("value") < 50).alias("status"))


@query(ORACLES["health_rollup"])
def health_rollup_stored(spark: SparkSession, d: str) -> DataFrame:
    """health_rollup from stored parts of each key, check and day, put together as the log arrives."""
    checks = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("check"), "event_id", "ts", (F.col("value") < 50).alias("ok"))
    parts = R.replayed_parts(spark, checks.repartition(6), folder(spark))
    return R.latest_status(parts).select(F.col("key").alias("user_id"), "checks", "status")


@query("""SELECT c_custkey, count(o_orderkey) AS checks, CASE WHEN count(o_orderkey) = 0 THEN 'disabled' WHEN bool_and(o_orderstatus <> 'F') THEN 'healthy'
WHEN bool_or(o_orderstatus <> 'F') THEN 'degraded' ELSE 'unhealthy' END AS status FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def health_report(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus"), "c_custkey", "left")
    return joined.groupBy("c_custkey").agg(F.count("o_orderkey").alias("checks"), H.rollup(F.col("o_orderstatus") != "F", "disabled").alias("status"))


@query("""SELECT user_id, round(list_reduce(list(value ORDER BY ts, event_id), lambda a, x: a * 0.7 + x * 0.3), 6) AS ewma, count(*) AS n FROM events GROUP BY user_id""")
def ewma_latency(spark: SparkSession, d: str) -> DataFrame:
    out = H.ewma(table(spark, d, "events").select("user_id", "value", "ts", "event_id"), "user_id", "value", ["ts", "event_id"])
    return out.select("user_id", F.round("ewma", 6).alias("ewma"), "n")


@query("""SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS failures
FROM (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events)""")
def failure_runs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return H.failure_runs(e, "user_id", F.col("event_type") == "error", ["ts", "event_id"]).select("user_id", "event_id", "failures")


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (age <= ttl) AS fresh FROM (SELECT event_type, date_diff('second', ts, max(ts) OVER ()) AS age,
CASE event_type WHEN 'click' THEN 86400 WHEN 'view' THEN 172800 ELSE 604800 END AS ttl FROM events) GROUP BY event_type""")
def ttl_freshness(spark: SparkSession, d: str) -> DataFrame:
    """Entries still fresh at the time of the newest one; the newest time is one row, joined to all."""
    e = table(spark, d, "events").select("event_type", "ts")
    now = e.agg(F.max("ts").alias("now"))
    ttl = F.when(F.col("event_type") == "click", 86400).when(F.col("event_type") == "view", 172800).otherwise(604800)
    age = F.unix_seconds(F.date_trunc("second", F.col("now")).cast("timestamp")) - F.unix_seconds(F.date_trunc("second", F.col("ts")).cast("timestamp"))
    return e.join(F.broadcast(now)).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(age <= ttl).alias("fresh"))


@query("""SELECT user_id, count(*) FILTER (gap < 300) AS too_soon, count(*) AS n FROM (SELECT user_id,
(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000000.0 AS gap FROM events) GROUP BY user_id""")
def throttle_gaps(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1e6
    return e.select("user_id", gap.alias("gap")).groupBy("user_id").agg(F.count_if(F.col("gap") < 300).alias("too_soon"), F.count("*").alias("n"))


def _replayed(spark: SparkSession, events: DataFrame, operator, end: str = "2200-01-01") -> DataFrame:
    return T.replayed(spark, events, end, "3650 days", operator, f"{folder(spark)}/{uuid.uuid4().hex}", 4).filter("key is not null")


@query(ORACLES["throttle_gaps"])
def throttle_gaps_stream(spark: SparkSession, d: str) -> DataFrame:
    """throttle_gaps from a stream whose rows come in any order, a few files at a time."""
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    given = _replayed(spark, e.repartition(8), T.throttle_stream)
    return given.groupBy(F.col("key").alias("user_id")).agg(F.max_by("too_soon", "n").alias("too_soon"), F.max("n").alias("n"))


@query(ORACLES["ttl_freshness"])
def ttl_freshness_stream(spark: SparkSession, d: str) -> DataFrame:
    """ttl_freshness from a stream at the time of its newest row."""
    ttl = F.when(F.col("event_type") == "click", 86400).when(F.col("event_type") == "view", 172800).otherwise(604800).cast("long")
    e = table(spark, d, "events").select(F.col("event_type").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), ttl.alias("ttl"))
    end = e.agg(F.max(F.col("ts") + F.expr("interval 3650 days")).cast("string")).first()[0]
    given = T.freshness_now(_replayed(spark, e.repartition(8), T.freshness_stream, end or "2200-01-01"))
    return given.select(F.col("key").alias("event_type"), "n", "fresh")


@query(f"SELECT user_id, count(*) FILTER (event_type IN ('view', 'click') AND value >= 50) = 2 AS fails_over FROM {_LATEST} GROUP BY user_id")
def failover_flag(spark: SparkSession, d: str) -> DataFrame:
    latest = K.latest_per_key(table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], "ts", "event_id")
    failed = F.col("event_type").isin("view", "click") & (F.col("value") >= 50)
    return latest.groupBy("user_id").agg((F.count_if(failed) == 2).alias("fails_over"))


def _breaker_sql(recover: str, cooldown: str, error: str, columns: str) -> str:
    """The breaker as a recursion over each key's checks in order."""
    base = "CASE WHEN s.status = 'blocked' THEN 0 ELSE s.failures END + 1"
    return f"""WITH RECURSIVE e AS (SELECT user_id AS key, event_id, ts, event_type = 'error' AS failed, event_type = 'error' AND value > 200 AS hard, {recover} AS recover,
to_milliseconds({cooldown}) AS cooldown, {error} AS error, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS TIMESTAMP) AS ts, false AS skipped, 'unknown' AS status, CAST(0 AS BIGINT) AS failures,
CAST(NULL AS TIMESTAMP) AS blocked_until, CAST(NULL AS VARCHAR) AS last_error FROM e UNION ALL
SELECT key, n, event_id, ts, skip, CASE WHEN recover THEN 'unknown' WHEN skip THEN status WHEN NOT failed THEN 'healthy' WHEN block THEN 'blocked' WHEN f >= 2 THEN 'degraded' ELSE 'healthy' END,
CASE WHEN recover THEN 0 WHEN skip THEN failures WHEN failed THEN f ELSE 0 END, CASE WHEN recover THEN NULL WHEN skip THEN blocked_until WHEN failed AND block THEN ts + cooldown END,
CASE WHEN recover THEN NULL WHEN skip THEN last_error WHEN failed THEN error END FROM
(SELECT e.*, s.status, s.failures, s.blocked_until, s.last_error, NOT e.recover AND s.status = 'blocked' AND e.ts < s.blocked_until AS skip, {base} AS f, e.hard OR {base} >= 3 AS block
FROM s JOIN e ON e.key = s.key AND e.n = s.n + 1)) SELECT {columns} FROM s WHERE n > 0"""


@query(_breaker_sql("false", "86400000", "CAST(NULL AS VARCHAR)", "key, event_id, ts, skipped, status, failures, blocked_until"))
def breaker_states(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    checks = e.select(F.col("user_id").alias("key"), "event_id", "ts", (F.col("event_type") == "error").alias("failed"), ((F.col("event_type") == "error") & (F.col("value") > 200)).alias("hard"))
    return H.breaker_states(checks).drop("last_error")


@query(_breaker_sql("event_type = 'purchase' AND event_id % 3 = 0", "CASE WHEN user_id % 2 = 0 THEN 3600000 ELSE 86400000 END", "props", "key, event_id, ts, skipped, status, failures, blocked_until, last_error"))
def breaker_recovery(spark: SparkSession, d: str) -> DataFrame:
    """Cooldowns of each key's own, keys opened by hand, and the text of the last failure."""
    e, failed = table(spark, d, "events"), F.col("event_type") == "error"
    own = F.when(F.col("user_id") % 2 == 0, 3_600_000)
    return H.breaker_states(e.select(
        F.col("user_id").alias("key"), "event_id", "ts", failed.alias("failed"), (failed & (F.col("value") > 200)).alias("hard"), own.alias("cooldown_ms"), F.col("props").alias("error"),
        ((F.col("event_type") == "purchase") & (F.col("event_id") % 3 == 0)).alias("recover"),
    ))


@query("""SELECT conv_id, turn, lag(turn) OVER w AS prev_turn, lead(turn) OVER w AS next_turn, CAST(row_number() OVER w - 1 AS BIGINT) AS ord FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def prev_next(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.lag("turn").over(w).alias("prev_turn"), F.lead("turn").over(w).alias("next_turn"), (F.row_number().over(w) - 1).cast("long").alias("ord")
    )


# --- text -----------------------------------------------------------------------------------------------------

_NOISE = "[\\s\uff0c,\u3002.\uff01!\uff1f?\uff1a:\uff1b;\u3001\"''\uff08\uff09()\u300a\u300b\u3010\u3011\\[\\]{}\u2026\u2014\\-\u2013\u00b7\u30fb]+"


@query(f"SELECT item_id, regexp_replace(lower(text), '{_NOISE}', '', 'g') AS title FROM benchmark")
def normalize_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", X.normalize_title(F.col("text")).alias("title"))


@query(r"SELECT page_id, regexp_extract(url, '/(\d+)', 1) AS number, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS paragraphs FROM pages")
def regex_capture(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"/(\d+)", 1).alias("number"), F.size(F.regexp_extract_all("html", F.lit("<p>"), 0)).cast("long").alias("paragraphs"))


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS head, split_part(p_name, ' ', 2) AS tail, CASE WHEN length(p_name) > 8 THEN left(p_name, 8) || '…' ELSE p_name END AS short FROM part")
def title_split(spark: SparkSession, d: str) -> DataFrame:
    words = F.split("p_name", " ")
    short = F.when(F.length("p_name") > 8, F.concat(F.left("p_name", F.lit(8)), F.lit("…"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", F.get(words, F.lit(0)).alias("head"), F.coalesce(F.get(words, F.lit(1)), F.lit("")).alias("tail"), short.alias("short"))


@query("""SELECT doc_id, CASE WHEN contains(text, 'License') OR contains(text, 'Licensed') THEN 'completed' WHEN contains(text, '###') OR contains(text, '!!') THEN 'hiatus' ELSE 'ongoing' END AS status,
CASE WHEN contains(text, '完结') OR contains(text, '完結') OR contains(text, 'completed') THEN 'completed' WHEN contains(text, '停更') OR contains(text, '休刊') THEN 'hiatus' ELSE 'ongoing' END AS plain
FROM documents""")
def status_classify(spark: SparkSession, d: str) -> DataFrame:
    signs = [("completed", ["License", "Licensed"]), ("hiatus", ["###", "!!"])]
    return table(spark, d, "documents").select("doc_id", X.status_of(F.col("text"), signs).alias("status"), X.status_of(F.col("text")).alias("plain"))


@query("""SELECT doc_id, CASE WHEN contains(b, 'baidu.com') OR contains(b, '百度一下') THEN 'redirect'
WHEN contains(b, '验证码') OR contains(b, 'captcha') OR contains(b, '请证明') OR contains(b, '人机验证') THEN 'captcha'
WHEN contains(b, 'Just a moment') OR contains(b, 'cf-browser-verify') OR contains(b, '_cf_chl_opt') OR contains(b, '请求过于频繁') OR contains(b, 'rate limit') OR contains(b, '访问过于频繁')
THEN 'blocked_pattern' END AS trigger FROM (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN 'captcha' WHEN 1 THEN ' rate limit' WHEN 2 THEN '验证码 baidu.com' ELSE '' END AS b FROM documents)""")
def block_pattern(spark: SparkSession, d: str) -> DataFrame:
    """Bodies with signs appended by number, as the test texts have none."""
    k = F.col("doc_id") % 5
    body = F.concat("text", F.when(k == 0, "captcha").when(k == 1, " rate limit").when(k == 2, "验证码 baidu.com").otherwise(""))
    return table(spark, d, "documents").select("doc_id", X.block_pattern(body).alias("trigger"))


@query("""SELECT doc_id, nullif(trim(regexp_replace(regexp_replace(text, '[\\r\\n]', '', 'g'), '[^\\x00-\\x7F]', '', 'g'), ' '), '') AS value FROM documents""")
def header_sanitize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.header_value(F.col("text")).alias("value"))


@query("""SELECT o_orderkey, 200 + o_orderkey % 400 AS code, CASE WHEN c = 403 THEN 'HTTP_403' WHEN c = 404 THEN 'HTTP_404' WHEN c = 429 THEN 'HTTP_429' WHEN c >= 500 THEN 'HTTP_5XX'
WHEN c >= 400 THEN 'HTTP_OTHER' END AS error FROM (SELECT o_orderkey, 200 + o_orderkey % 400 AS c FROM orders)""")
def status_code_class(spark: SparkSession, d: str) -> DataFrame:
    code = F.lit(200) + F.col("o_orderkey") % 400
    return table(spark, d, "orders").select("o_orderkey", code.alias("code"), X.http_class(code).alias("error"))


@query("""SELECT doc_id, CASE WHEN lang = 'fr' THEN 'INVALID_CONTENT_TYPE' WHEN text IS NULL OR length(text) < 100 THEN 'EMPTY_HTML' ELSE 'OK' END AS gate FROM documents""")
def body_gate(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("lang") == "fr", "image/png").when(F.col("lang") == "de", "text/plain; charset=utf-8")
    return table(spark, d, "documents").select("doc_id", X.body_gate(kind, F.col("text")).alias("gate"))


@query("""SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_brand || ' , ' || p_type || ',,' || p_name, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS tags FROM part""")
def tags_split(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat("p_brand", F.lit(" , "), "p_type", F.lit(",,"), "p_name")
    return table(spark, d, "part").select("p_partkey", F.array_join(X.tags_of(raw), "|").alias("tags"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), '') AS missing FROM events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    parsed = F.from_json("props", "k bigint")
    return table(spark, d, "events").select("event_id", parsed["k"].alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("")).alias("missing"))


@query("""SELECT doc_id, coalesce(CASE WHEN s IS NOT NULL THEN nullif(s, '') ELSE r END, 'none') AS chosen FROM
(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN source END AS s, lang AS r FROM documents)""")
def coalesce_fields(spark: SparkSession, d: str) -> DataFrame:
    """A field that is there but blank hides the raw field behind it."""
    s = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.col("source"))
    chosen = F.when(s.isNotNull(), V.present(s)).otherwise(F.col("lang"))
    return table(spark, d, "documents").select("doc_id", F.coalesce(chosen, F.lit("none")).alias("chosen"))


# --- URLs -----------------------------------------------------------------------------------------------------


@query(f"SELECT page_id, {_HOST} AS host, nullif(regexp_extract(url, '^(https?://[^/]+)', 1), '') AS origin, regexp_replace(split_part(url, '#', 1), '/+$', '') AS clean FROM pages")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", U.host_of(u).alias("host"), U.origin_of(u).alias("origin"), U.clean_host(u).alias("clean"))


@query(r"""SELECT page_id, kind, CASE WHEN link = '' THEN '' WHEN regexp_matches(link, '^https?://') THEN link WHEN starts_with(link, '//') THEN CASE WHEN starts_with(base, 'https') THEN 'https:' ELSE 'http:' END || link
WHEN starts_with(link, '/') THEN coalesce(nullif(regexp_extract(base, '^(https?://[^/]+)', 1), ''), base) || link ELSE regexp_extract(base, '^(.*/)', 1) || link END AS full_url
FROM (SELECT page_id, k.kind, k.link, regexp_replace(split_part(url, '#', 1), '/+$', '') AS base FROM pages, (VALUES (0, '//c.com/a'), (1, '/a'), (2, 'x/1'), (3, ''), (4, 'https://z.org/q')) k(kind, link))""")
def url_resolve(spark: SparkSession, d: str) -> DataFrame:
    links = F.array(*[F.struct(F.lit(i).alias("kind"), F.lit(x).alias("link")) for i, x in enumerate(["//c.com/a", "/a", "x/1", "", "https://z.org/q"])])
    p = table(spark, d, "pages").select("page_id", U.clean_host(F.col("url")).alias("base"), F.inline(links))
    return p.select("page_id", "kind", U.resolve(F.col("link"), F.col("base")).alias("full_url"))


_TEMPLATES = ["/s?q={{keyword}}", "/s/{keyword}/1", "/s", "/s?x=1", "https://api.test/find?w=searchKey", "list/%s"]
_TEMPLATE_SQL = ", ".join(f"({i}, '{t}')" for i, t in enumerate(_TEMPLATES))


@query(f"""SELECT s_suppkey, CASE WHEN regexp_matches(u, '^https?://') THEN u WHEN starts_with(u, '/') THEN 'https://' || lower(replace(s_name, '#', '-')) || u
ELSE 'https://' || lower(replace(s_name, '#', '-')) || '/' || u END AS url FROM (SELECT s_suppkey, s_name,
CASE WHEN contains(t, '{{{{keyword}}}}') THEN replace(t, '{{{{keyword}}}}', 'a%20b(c)') WHEN contains(t, '{{keyword}}') THEN replace(t, '{{keyword}}', 'a%20b(c)')
WHEN contains(t, 'searchKey') THEN replace(t, 'searchKey', 'a%20b(c)') WHEN contains(t, '%s') THEN replace(t, '%s', 'a%20b(c)')
WHEN contains(t, '?') THEN t || '&keyword=a%20b(c)' ELSE t || '?keyword=a%20b(c)' END AS u
FROM supplier JOIN (VALUES {_TEMPLATE_SQL}) x(i, t) ON s_suppkey % 6 = x.i)""")
def url_templates(spark: SparkSession, d: str) -> DataFrame:
    t = F.get(F.array(*map(F.lit, _TEMPLATES)), (F.col("s_suppkey") % 6).cast("int"))
    host = F.lower(F.replace("s_name", F.lit("#"), F.lit("-")))
    return table(spark, d, "supplier").select("s_suppkey", U.full_url(U.apply_keyword(t, F.lit("a b(c)")), host).alias("url"))


_PREFIXES = ["", "ftp://x/", "http://127.0.0.1/", "http://10.1.2.3/", "https://172.20.0.1/", "http://192.168.0.9/", "http://[::1]:8080/", "javascript:alert(1)//"]
_PREFIX_SQL = ", ".join(f"({i}, '{t}')" for i, t in enumerate(_PREFIXES))


@query(rf"""SELECT page_id, url, coalesce(regexp_matches(url, '(?i)^https?://') AND {_HOST} IS NOT NULL AND NOT regexp_matches({_HOST},
'^(127\.\d+\.\d+\.\d+|10\.\d+\.\d+\.\d+|172\.(1[6-9]|2\d|3[01])\.\d+\.\d+|192\.168\.\d+\.\d+|0\.0\.0\.0$|localhost$|\[::1\]$)'), false) AS safe
FROM (SELECT page_id, x.p || url AS url FROM pages JOIN (VALUES {_PREFIX_SQL}) x(i, p) ON page_id % 8 = x.i)""")
def url_safety(spark: SparkSession, d: str) -> DataFrame:
    prefix = F.get(F.array(*map(F.lit, _PREFIXES)), (F.col("page_id") % 8).cast("int"))
    p = table(spark, d, "pages").select("page_id", F.concat(prefix, "url").alias("url"))
    return p.select("page_id", "url", U.is_safe(F.col("url")).alias("safe"))


@query(f"""SELECT page_id, unnest(CASE WHEN starts_with(h, 'cn.') THEN [h, 'www.' || h[4:], 'm.' || h[4:]] ELSE [h] END) AS host
FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'cn.' || {_HOST} ELSE {_HOST} END AS h FROM pages)""")
def failover_hosts(spark: SparkSession, d: str) -> DataFrame:
    host = U.host_of(F.col("url"))
    host = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("cn."), host)).otherwise(host)
    return table(spark, d, "pages").select("page_id", F.explode(U.failover_hosts(host)).alias("host"))


# --- extraction -----------------------------------------------------------------------------------------------


def _plain(sql: str) -> str:
    return f"""trim(replace(replace(replace(replace({sql}, '&amp;', chr(1)), '&amp', chr(1)), '&quot;', '"'), chr(1), '&'))"""


@query("SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title FROM pages")
def page_title(spark: SparkSession, d: str) -> DataFrame:
    """Titles as they stand in the markup, JVM-side."""
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("title"))


@query("""SELECT page_id, CAST(i - 1 AS BIGINT) AS ord, regexp_extract(m[i], 'href="([^"]*)"', 1) AS href, regexp_extract(m[i], '>([^<]*)$', 1) AS label FROM
(SELECT page_id, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*') AS m FROM pages))""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('<a href="[^"]*">[^<]*'), 0)
    rows = table(spark, d, "pages").select("page_id", F.posexplode(found).alias("ord", "m"))
    return rows.select("page_id", F.col("ord").cast("long").alias("ord"), F.regexp_extract("m", 'href="([^"]*)"', 1).alias("href"), F.regexp_extract("m", ">([^<]*)$", 1).alias("label"))


@query(f"""SELECT page_id, {_plain("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
{_plain("regexp_extract(html, '<nav><ul><li><a href=" + chr(34) + "([^" + chr(34) + "]*)" + chr(34) + "', 1)")} AS first_link,
{_plain("regexp_extract(html, '<div class=" + chr(34) + "ad" + chr(34) + ">([^<]*)</div>', 1)")} AS ad FROM pages""")
def page_fields_by_rule(spark: SparkSession, d: str) -> DataFrame:
    rules = {"title": "class.none@text||tag.article@tag.h1@text", "lang": "tag.html@lang", "first_link": "tag.nav@tag.a.0@href", "ad": "class.ad@text"}
    return page_fields(table(spark, d, "pages"), "page_id", "html", rules)


@query(f"""SELECT page_id, CAST(i - 1 AS BIGINT) AS ord, {_plain("regexp_extract(m[i], 'href=" + chr(34) + "([^" + chr(34) + "]*)" + chr(34) + "', 1)")} AS url,
{_plain("regexp_extract(m[i], '>([^<]*)$', 1)")} AS title FROM (SELECT page_id, m, unnest(range(1, len(m) + 1)) AS i FROM
(SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<a href="[^"]*">[^<]*') AS m FROM pages))""")
def page_rows_by_rule(spark: SparkSession, d: str) -> DataFrame:
    return page_rows(table(spark, d, "pages"), "page_id", "html", "nav li", {"url": "tag.a@href", "title": "tag.a@text"})


@query(f"""SELECT page_id, CASE WHEN NOT starts_with(url, 'https:') THEN 'source-load' WHEN contains(url, '?') AND NOT contains(url, 'page=') THEN 'search-rule' WHEN length(html) < 1500 THEN 'fetch'
WHEN NOT contains(html, '<h1>') THEN 'selector' WHEN NOT contains(lower(html), 'ing') THEN 'parse' END AS failed_at FROM pages""")
def diagnose_stage(spark: SparkSession, d: str) -> DataFrame:
    """The first step at which a page fails the ladder of checks."""
    u, h = F.col("url"), F.col("html")
    stage = V.first_rule(
        None,
        (~u.startswith("https:"), "source-load"),
        (u.contains("?") & ~u.contains("page="), "search-rule"),
        (F.length(h) < 1500, "fetch"),
        (~h.contains("<h1>"), "selector"),
        (~F.lower(h).contains("ing"), "parse"),
    )
    return table(spark, d, "pages").select("page_id", stage.alias("failed_at"))


_SEARCHED = ["https://blog.tionsh.example.net", "http://blog.ththan.example.net", "https://thther.example.org"]


@query(f"""WITH r AS (SELECT * FROM (VALUES {", ".join(f"('s{i}', '{h}', '{x}')" for i, h in enumerate(_SEARCHED) for x in ["/en/", "/es/", "/fr/"][i : i + 1])}) r(source_id, host, path)),
k AS (SELECT DISTINCT regexp_extract(url, '/([0-9]+)[^/]*/?$', 1) AS keyword FROM pages), q AS (SELECT keyword, source_id, host, host || path || keyword AS url FROM k, r WHERE keyword <> ''),
l AS (SELECT page_id, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<a href="[^"]*">[^<]*') AS m FROM pages)),
t AS (SELECT page_id, i - 1 AS i, {_plain("regexp_extract(m[i], 'href=" + chr(34) + "([^" + chr(34) + "]*)" + chr(34) + "', 1)")} AS u, {_plain("regexp_extract(m[i], '>([^<]*)$', 1)")} AS title FROM l)
SELECT q.keyword, q.source_id, q.url, CAST(t.i AS BIGINT) AS ord, t.title, q.host || t.u AS detail_url, CASE WHEN source_id = 's1' THEN 50 ELSE 100 END AS weight
FROM q JOIN pages p ON p.url = q.url JOIN t ON t.page_id = p.page_id WHERE t.title <> ''""")
def sources_search(spark: SparkSession, d: str) -> DataFrame:
    """Three sources, each with its own path, selectors and weight, searched for all keywords in one plan."""
    items = ["nav li", "nav > ul > li||p", "ul@li||nav li"]
    rules = [{"id": f"s{i}", "host": h + "/#note", "search": {"path": p + "{{keyword}}", "item": x, "title": "tag.a@text", "url": "tag.a@href"}} for i, (h, p, x) in enumerate(zip(_SEARCHED, ["/en/", "/es/", "/fr/"], items, strict=True))]
    rules[1]["weight"] = 50
    pages = table(spark, d, "pages")
    keywords = pages.select(F.regexp_extract("url", "/([0-9]+)[^/]*/?$", 1).alias("keyword")).filter("keyword <> ''")
    found = source_search.search_sources(spark, keywords, pages, rules)
    return found.select("keyword", "source_id", "url", "ord", "title", "detail_url", "weight")


_WITH_COVERS = """(SELECT page_id, regexp_replace(html, '<a href="([^"]*)">', '<img data-original="\\1.jpg"><a href="\\1">', 'g') AS html FROM pages)"""
_COVERS = f"""(SELECT page_id, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<img data-original="[^"]*">') AS m FROM {_WITH_COVERS}))"""


def _with_covers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_replace("html", '<a href="([^"]*)">', '<img data-original="$1.jpg"><a href="$1">').alias("html"))


@query(f"""SELECT page_id, CAST(i - 1 AS BIGINT) AS ord, 'https://h.com' || {_plain("regexp_extract(m[i], 'original=" + chr(34) + "([^" + chr(34) + "]*)" + chr(34) + "', 1)")} AS url FROM {_COVERS}""")
def page_images(spark: SparkSession, d: str) -> DataFrame:
    """The images of a chapter, loaded late: the attribute that the source names has none, a usual one has."""
    return image_rows(_with_covers(spark, d), "page_id", "html", {"host": "https://h.com", "images": {"listSelector": "nav li > img", "srcAttribute": "src"}})


@query(f"""SELECT page_id, CAST(i - 1 AS BIGINT) AS ord, 'https://h.com' || {_plain("regexp_extract(m[i], 'original=" + chr(34) + "([^" + chr(34) + "]*)" + chr(34) + "', 1)")} AS cover FROM {_COVERS}""")
def plain_search_covers(spark: SparkSession, d: str) -> DataFrame:
    search = {"listSelector": "nav li", "titleSelector": "&", "detailUrlSelector": "a", "coverSelector": "img"}
    rows = plain_rows(_with_covers(spark, d), "page_id", "html", {"id": "s3", "host": "https://h.com/", "search": search})
    return rows.select("page_id", "ord", "cover")


# --- similarity -----------------------------------------------------------------------------------------------

_TITLES = f"(SELECT DISTINCT regexp_replace(lower(p_name), '{_NOISE}', '', 'g') AS t FROM part)"
_SIMILAR = """(a.t = b.t OR contains(a.t, b.t) OR contains(b.t, a.t)
OR len(list_intersect(list_distinct(string_split(a.t, '')), list_distinct(string_split(b.t, '')))) >= 0.75 * len(list_distinct(list_concat(string_split(a.t, ''), string_split(b.t, ''))))
OR len(list_filter(range(1, least(length(a.t), length(b.t)) - CAST(ceil(0.75 * least(length(a.t), length(b.t))) AS BIGINT) + 2),
lambda i: contains(CASE WHEN length(a.t) <= length(b.t) THEN b.t ELSE a.t END, substring(CASE WHEN length(a.t) <= length(b.t) THEN a.t ELSE b.t END, i, CAST(ceil(0.75 * least(length(a.t), length(b.t))) AS BIGINT))))) > 0)"""


@query(f"SELECT a.t AS a, b.t AS b FROM {_TITLES} a JOIN {_TITLES} b ON a.t < b.t WHERE {_SIMILAR}")
def fuzzy_pairs(spark: SparkSession, d: str) -> DataFrame:
    return S.similar_pairs(S.normalized(table(spark, d, "part"), "p_name"))


@query()
def title_clusters(spark: SparkSession, d: str) -> DataFrame:
    titles = S.normalized(table(spark, d, "part"), "p_name").select("t", F.col("p_partkey").alias("ord"))
    return S.leader_clusters(titles, folder(spark))


@query("""WITH r AS (SELECT p_name AS cluster, p_size AS weight, p_brand AS source, p_brand AS name, p_partkey AS ord, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS cover,
CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type END AS author FROM part), t AS (SELECT *, max(weight) OVER (PARTITION BY cluster) AS w FROM r),
b AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY cluster) AS ties, row_number() OVER (PARTITION BY cluster ORDER BY cover = '', ord) AS p FROM t WHERE weight = w) WHERE p = 1),
o AS (SELECT t.cluster, count(*) FILTER (t.source <> b.source) AS others, arg_min(t.cover, t.ord) FILTER (t.cover <> '') AS c, arg_min(t.author, t.ord) FILTER (t.author <> '') AS a
FROM t JOIN b ON t.cluster = b.cluster GROUP BY t.cluster)
SELECT b.cluster, b.weight, b.source, CASE WHEN ties = 1 AND others > 0 THEN b.name || ' +' || others ELSE b.name END AS name, b.ord,
CASE WHEN ties = 1 AND b.cover = '' THEN o.c ELSE b.cover END AS cover, CASE WHEN ties = 1 AND coalesce(b.author, '') = '' THEN o.a ELSE b.author END AS author
FROM b JOIN o ON b.cluster = o.cluster""")
def cluster_representative(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(
        F.col("p_name").alias("cluster"),
        F.col("p_size").alias("weight"),
        F.col("p_brand").alias("source"),
        F.col("p_brand").alias("name"),
        F.col("p_partkey").alias("ord"),
        F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_type")).alias("cover"),
        F.when(F.col("p_partkey") % 4 != 0, F.col("p_type")).alias("author"),
    )
    return S.representatives(rows, "cluster", "weight", "source", "name", "ord", ["cover", "author"], "cover")


# --- reader state, paging and JSON ----------------------------------------------------------------------------


@query("""SELECT c_custkey, c_name, o_orderkey AS last_order, o_orderdate AS last_date FROM customer LEFT JOIN
(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1) ON c_custkey = o_custkey""")
def favorites_progress(spark: SparkSession, d: str) -> DataFrame:
    """Favorites with the progress saved for them, if any."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    last = K.latest_per_key(o, ["c_custkey"], "o_orderdate", "o_orderkey")
    return table(spark, d, "customer").join(last, "c_custkey", "left").select("c_custkey", "c_name", F.col("o_orderkey").alias("last_order"), F.col("o_orderdate").alias("last_date"))


@query("""SELECT coalesce(n.n_nationkey, o.n_nationkey) AS n_nationkey, coalesce(n.status, o.status) AS status FROM (SELECT n_nationkey, 'old' AS status FROM nation) o
FULL JOIN (SELECT s_nationkey AS n_nationkey, CASE WHEN avg(s_acctbal) > 4500 THEN 'healthy' ELSE 'degraded' END AS status FROM supplier GROUP BY 1) n ON o.n_nationkey = n.n_nationkey""")
def report_refresh(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "nation").select("n_nationkey", F.lit("old").alias("status"))
    status = F.when(F.avg("s_acctbal") > 4500, "healthy").otherwise("degraded")
    new = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(status.alias("status"))
    return K.upsert(old, new, ["n_nationkey"])


@query("""SELECT s_nationkey, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY r DESC) AS q FROM
(SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier WHERE s_acctbal > 0) WHERE r <= 2) WHERE q = 1""")
def next_domain(spark: SparkSession, d: str) -> DataFrame:
    """The domain to fail over to: the second active one, or the first if it is alone."""
    order = [F.desc("s_acctbal"), F.col("s_suppkey")]
    two = K.top_per_key(table(spark, d, "supplier").filter("s_acctbal > 0").select("s_nationkey", "s_suppkey", "s_acctbal"), ["s_nationkey"], order, 2)
    return two.groupBy("s_nationkey").agg(F.max_by("s_suppkey", F.struct(-F.col("s_acctbal"), "s_suppkey")).alias("s_suppkey"))


@query("""SELECT conv_id, min(ord) FILTER (role = 'assistant') AS first_answer, count(*) AS turns, CAST(ceil(count(*) / 5.0) AS BIGINT) AS batches, least(count(*), 2 + 6) AS visible FROM
(SELECT conv_id, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS ord FROM conversations) GROUP BY conv_id""")
def list_paging(spark: SparkSession, d: str) -> DataFrame:
    """Where an item stands in its ordered list, the batches of five, and what is shown after one more page of six."""
    ord_ = (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("long")
    rows = table(spark, d, "conversations").select("conv_id", "role", ord_.alias("ord"))
    n = F.count("*")
    return rows.groupBy("conv_id").agg(
        F.min(F.when(F.col("role") == "assistant", F.col("ord"))).alias("first_answer"), n.alias("turns"), F.ceil(n / 5).alias("batches"), F.least(n, F.lit(8).cast("long")).alias("visible")
    )


@query("""SELECT user_id, hour, event_id, value FROM (SELECT user_id, date_trunc('hour', ts) AS hour, event_id, value,
row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def debounced_writes(spark: SparkSession, d: str) -> DataFrame:
    """The last write of each interval."""
    e = table(spark, d, "events").select("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_id", "value", "ts")
    return K.latest_per_key(e, ["user_id", "hour"], "ts", "event_id").select("user_id", "hour", "event_id", "value")


@query(ORACLES["debounced_writes"])
def debounced_writes_stream(spark: SparkSession, d: str) -> DataFrame:
    """debounced_writes from a stream: each interval's last write is given once, when the watermark has passed it."""
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    given = _replayed(spark, e.repartition(8), T.debounced_stream)
    return given.select(F.col("key").alias("user_id"), F.col("start").cast("timestamp_ntz").alias("hour"), "event_id", "value")


@query("""SELECT user_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1
ORDER BY ts DESC, user_id, event_type LIMIT 100""")
def cache_eviction(spark: SparkSession, d: str) -> DataFrame:
    """A cache of at most a hundred entries, oldest writes dropped."""
    latest = K.latest_per_key(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "ts", "event_id")
    return latest.orderBy(F.desc("ts"), "user_id", "event_type").limit(100).select("user_id", "event_type", "ts")


@query("""SELECT user_id, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed,
arg_max(props, ts) FILTER (event_type = 'error') AS last_error, max(ts) FILTER (event_type <> 'error') AS last_success FROM events GROUP BY user_id""")
def error_tally(spark: SparkSession, d: str) -> DataFrame:
    bad = F.col("event_type") == "error"
    return table(spark, d, "events").groupBy("user_id").agg(
        F.count_if(~bad).alias("succeeded"),
        F.count_if(bad).alias("failed"),
        F.max_by("props", F.when(bad, F.col("ts"))).alias("last_error"),
        F.max(F.when(~bad, F.col("ts"))).alias("last_success"),
    )


@query("SELECT p_brand, p_partkey, p_size FROM (SELECT *, max(p_size) OVER (PARTITION BY p_brand) AS m FROM part) WHERE p_size = m")
def heaviest_rows(spark: SparkSession, d: str) -> DataFrame:
    """All rows that attain the greatest weight of their group."""
    part = table(spark, d, "part").select("p_brand", "p_partkey", "p_size")
    return part.join(part.groupBy("p_brand").agg(F.max("p_size").alias("p_size")), ["p_brand", "p_size"])


@query("""SELECT s_suppkey, i AS ord, CASE i WHEN 0 THEN s_name ELSE '/n/' || s_nationkey END AS title FROM supplier, (VALUES (0), (1)) v(i)""")
def json_rows(spark: SparkSession, d: str) -> DataFrame:
    """A JSON answer located by path, one row an item; texts that are no JSON give no rows."""
    item = F.array(F.struct(F.col("s_name").alias("title")), F.struct(F.concat(F.lit("/n/"), F.col("s_nationkey").cast("string")).alias("title")))
    answers = table(spark, d, "supplier").select("s_suppkey", F.to_json(F.struct(F.struct(item.alias("list")).alias("data"))).alias("body"))
    answers = answers.unionByName(table(spark, d, "supplier").select("s_suppkey", F.lit("<html>").alias("body")))
    found = F.from_json(F.get_json_object("body", "$.data.list"), "array<struct<title: string>>")
    rows = answers.filter(F.col("body").rlike(r"^\s*[\{\[]")).select("s_suppkey", F.posexplode(found).alias("ord", "x"))
    return rows.select("s_suppkey", "ord", "x.title")


@query(r"""SELECT page_id, CASE WHEN regexp_matches(b, '^\s*[\{\[]') THEN 'json' ELSE 'html' END AS kind FROM
(SELECT page_id, CASE page_id % 3 WHEN 0 THEN '  {"a":1}' WHEN 1 THEN '[1]' ELSE html END AS b FROM pages)""")
def content_sniff(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 3
    body = F.when(k == 0, '  {"a":1}').when(k == 1, "[1]").otherwise(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.when(body.rlike(r"^\s*[\{\[]"), "json").otherwise("html").alias("kind"))


@query("""SELECT page_id, kind, CASE WHEN link = '' THEN '' WHEN starts_with(link, 'http') THEN link WHEN starts_with(link, '//') THEN 'https:' || link
WHEN starts_with(link, '/') THEN base || link ELSE base || '/' || link END AS full_url FROM
(SELECT page_id, k.kind, k.link, regexp_replace(url, '/$', '') AS base FROM pages, (VALUES (0, '//c.com/a'), (1, '/a'), (2, 'x/1'), (3, ''), (4, 'https://z.org/q')) k(kind, link))""")
def url_resolve_plain(spark: SparkSession, d: str) -> DataFrame:
    links = F.array(*[F.struct(F.lit(i).alias("kind"), F.lit(x).alias("link")) for i, x in enumerate(["//c.com/a", "/a", "x/1", "", "https://z.org/q"])])
    p = table(spark, d, "pages").select("page_id", "url", F.inline(links))
    return p.select("page_id", "kind", U.resolve_plain(F.col("link"), F.col("url")).alias("full_url"))


@query("""SELECT p_partkey FROM part WHERE contains(lower(p_name), 'bolt') OR contains(lower(p_brand), '#1') OR len(list_filter(string_split(lower(p_type || ',' || p_name), ','), lambda t: contains(t, 'eco'))) > 0""")
def tag_filter(spark: SparkSession, d: str) -> DataFrame:
    """A text in the name, the host or any tag."""
    tags = X.tags_of(F.lower(F.concat("p_type", F.lit(","), "p_name")))
    hit = F.lower("p_name").contains("bolt") | F.lower("p_brand").contains("#1") | F.exists(tags, lambda t: F.contains(t, F.lit("eco")))
    return table(spark, d, "part").filter(hit).select("p_partkey")


@query("""SELECT s_suppkey, tier FROM (SELECT s_suppkey, CASE WHEN s_acctbal > 6000 THEN 'core' WHEN s_acctbal > 0 THEN 'supplement' ELSE 'disabled' END AS tier FROM supplier)
ORDER BY CASE tier WHEN 'core' THEN 0 WHEN 'supplement' THEN 1 WHEN 'disabled' THEN 2 ELSE 9 END, s_suppkey LIMIT 10""")
def search_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The first ten sources of a search, by tier; ten is the search's own default."""
    tier = V.first_rule("disabled", (F.col("s_acctbal") > 6000, "core"), (F.col("s_acctbal") > 0, "supplement"))
    rows = table(spark, d, "supplier").select("s_suppkey", tier.alias("tier"))
    return rows.orderBy(V.rank_of(F.col("tier"), ["core", "supplement", "disabled"]), "s_suppkey").limit(10)


@query("""SELECT doc_id, lang, quality, CASE WHEN quality IS NULL THEN 'unchecked' WHEN toxic = 1 THEN 'blocked' WHEN quality = 1 THEN 'ok' ELSE 'degraded' END AS state
FROM documents LEFT JOIN labels USING (doc_id)""")
def catalog_state(spark: SparkSession, d: str) -> DataFrame:
    """Index rows with their check, and a state for those that none has."""
    joined = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    state = V.first_rule("degraded", (F.col("quality").isNull(), "unchecked"), (F.col("toxic") == 1, "blocked"), (F.col("quality") == 1, "ok"))
    return joined.select("doc_id", "lang", "quality", state.alias("state"))


@query("""SELECT doc_id, lang, source FROM (SELECT *, CASE WHEN quality IS NULL THEN 'unchecked' WHEN toxic = 1 THEN 'blocked' WHEN quality = 1 THEN 'ok' ELSE 'degraded' END AS state
FROM documents LEFT JOIN labels USING (doc_id)) WHERE state IN ('ok', 'unchecked') AND (lang IN ('en', 'fr') OR lang IS NULL) AND (contains(lower(source), 'e') OR contains(lower(lang), 'e'))""")
def catalog_filter_full(spark: SparkSession, d: str) -> DataFrame:
    """States, languages (a row without one passes any) and a text in either of two fields; a part that is None filters nothing."""
    state = V.first_rule("degraded", (F.col("quality").isNull(), "unchecked"), (F.col("toxic") == 1, "blocked"), (F.col("quality") == 1, "ok"))
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").withColumn("state", state)
    some = K.optional_filters(rows, states=["ok", "unchecked"], languages=["en", "fr"])
    return K.optional_filters(some, text="E", fields=("source", "lang")).select("doc_id", "lang", "source")


@query("""SELECT doc_id, lang FROM documents WHERE lang IS NULL OR lang IN ('de')""")
def catalog_filter_absent(spark: SparkSession, d: str) -> DataFrame:
    """Only the languages are asked for: states and text are left out and filter nothing."""
    return K.optional_filters(table(spark, d, "documents").select("doc_id", "lang"), states=None, languages=["de"], text=None, fields=("lang",))


@query("""SELECT doc_id, source FROM documents d WHERE source <> 'web' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)""")
def searchable(spark: SparkSession, d: str) -> DataFrame:
    """Rows that aren't of a mode that only links outside, and that no check has blocked."""
    blocked = table(spark, d, "labels").filter("toxic = 1").select("doc_id")
    return table(spark, d, "documents").filter("source <> 'web'").join(blocked, "doc_id", "left_anti").select("doc_id", "source")


@query("SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '/[0-9]*7(/|$|\\.)') AND NOT contains(url, 'news')")
def url_blacklist(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose URL neither a pattern nor a piece of text forbids."""
    return table(spark, d, "pages").filter(~F.col("url").rlike(r"/[0-9]*7(/|$|\.)") & ~F.col("url").contains("news")).select("page_id", "url")


@query("""SELECT tier, s_suppkey, row_number() OVER (ORDER BY tier, s_suppkey) AS place FROM
(SELECT s_suppkey, CASE WHEN s_acctbal > 6000 THEN 'core' WHEN s_acctbal > 0 THEN 'supplement' ELSE 'disabled' END AS tier FROM supplier) ORDER BY tier, s_suppkey LIMIT 50""")
def tier_alphabetical(spark: SparkSession, d: str) -> DataFrame:
    """The first page of sources by the name of their tier, then by number."""
    tier = V.first_rule("disabled", (F.col("s_acctbal") > 6000, "core"), (F.col("s_acctbal") > 0, "supplement"))
    page = table(spark, d, "supplier").select(tier.alias("tier"), "s_suppkey").orderBy("tier", "s_suppkey").limit(50)
    return page.withColumn("place", F.row_number().over(Window.orderBy("tier", "s_suppkey")).cast("long"))


@query("SELECT page_id, replace(replace(replace(replace(url, 'https://', ''), 'http://', ''), '.html', ''), '/', '') AS id FROM pages")
def id_strip(spark: SparkSession, d: str) -> DataFrame:
    """What is left of a URL without some fixed pieces."""
    return table(spark, d, "pages").select("page_id", reduce(lambda c, piece: F.replace(c, F.lit(piece), F.lit("")), ["https://", "http://", ".html", "/"], F.col("url")).alias("id"))


@query("""SELECT event_id, greatest(0, 86400 - date_diff('second', date_trunc('second', ts), (SELECT date_trunc('second', max(ts)) FROM events))) AS left_s FROM events WHERE event_type = 'click'""")
def ttl_left(spark: SparkSession, d: str) -> DataFrame:
    """Seconds that entries have left at the time of the newest one of the log; the newest time is one row."""
    e = table(spark, d, "events").select("event_id", "event_type", "ts")
    now = F.broadcast(e.agg(F.unix_seconds(F.date_trunc("second", F.max("ts")).cast("timestamp")).alias("now")))
    age = F.col("now") - F.unix_seconds(F.date_trunc("second", F.col("ts")).cast("timestamp"))
    return e.filter("event_type = 'click'").join(now).select("event_id", F.greatest(F.lit(0).cast("long"), F.lit(86400) - age).alias("left_s"))


# --- collation, headers, paths, templates and searches over sources -------------------------------------------


@query(f"""SELECT s_suppkey, risk, s_name FROM ({_CATALOG}) ORDER BY CASE risk WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 WHEN 'blocked' THEN 3 ELSE 9 END, s_name COLLATE zh, s_suppkey LIMIT 50""")
def risk_then_name(spark: SparkSession, d: str) -> DataFrame:
    """The first page of sources by risk, then by name in Chinese order."""
    order = V.rank_of(F.col("risk"), ["low", "medium", "high", "blocked"])
    return _catalog(spark, d).select("s_suppkey", "risk", "s_name").orderBy(order, F.collate("s_name", "zh"), "s_suppkey").limit(50)


_SAID = ["getaddrinfo ", "connect ECONNREFUSED ", "CERT_HAS_EXPIRED ", "timeout after "]


@query(f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'DNS_FAILED' WHEN 1 THEN 'CONNECTION_REFUSED' WHEN 2 THEN 'TLS_FAILED' ELSE 'FETCH_FAILED' END AS error_class FROM events WHERE event_type = 'error'""")
def error_classes(spark: SparkSession, d: str) -> DataFrame:
    """What kind of failure the text of an error tells of."""
    said = F.get(F.array(*map(F.lit, _SAID)), (F.col("event_id") % 4).cast("int"))
    errors = table(spark, d, "events").filter("event_type = 'error'")
    return errors.select("event_id", X.error_class(F.concat(said, "props")).alias("error_class"))


# Names in the order of their sounds, which isn't the order of their code points.
_SOUNDS = "安北陈东飞高海江李明"


@query(f"""SELECT s_suppkey, name FROM (SELECT s_suppkey, lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') AS k, translate(k, '0123456789', '{_SOUNDS}') AS name FROM supplier) ORDER BY k, s_suppkey LIMIT 50""")
def names_in_chinese_order(spark: SparkSession, d: str) -> DataFrame:
    """The first page of names in Chinese order."""
    digits = F.lpad((F.col("s_suppkey") % 1000).cast("string"), 3, "0")
    return table(spark, d, "supplier").select("s_suppkey", F.translate(digits, "0123456789", _SOUNDS).alias("name")).orderBy(F.collate("name", "zh"), "s_suppkey").limit(50)


@query(f"""SELECT s_suppkey, risk NOT IN ('high', 'blocked') AND active AND reachable AND NOT (checked AND NOT ok) AS wide, risk IN ('low', 'medium') AND active AND reachable AS unified,
risk IN ('low', 'medium') AND active AND reachable AND NOT (checked AND NOT ok) AS strict FROM
(SELECT *, s_suppkey % 5 <> 0 AS active, s_suppkey % 7 <> 0 AS reachable, s_suppkey % 3 = 0 AS checked, s_suppkey % 2 = 0 AS ok FROM ({_CATALOG}))""")
def candidate_rules(spark: SparkSession, d: str) -> DataFrame:
    """The three rules by which searches choose their sources."""
    k = F.col("s_suppkey")
    parts = (F.col("risk"), k % 5 != 0, k % 7 != 0, k % 3 == 0, k % 2 == 0)
    return _catalog(spark, d).select(
        "s_suppkey", K.candidates(*parts, medium_at_most=False).alias("wide"), K.candidates(*parts, failed_too=True).alias("unified"), K.candidates(*parts).alias("strict")
    )


_EXTRA = "MAP {'user-agent': s_name, 'Accept': CASE WHEN s_suppkey % 2 = 0 THEN ' a' || chr(10) || 'é' ELSE 'é' END, 'X-Own': 'x', 'Referer': 'https://r/'}"


@query(f"""SELECT s_suppkey, {len(X.DEFAULT_HEADERS)} + 2 AS n, s_name AS agent, CASE WHEN s_suppkey % 2 = 0 THEN 'a' ELSE '{X.DEFAULT_HEADERS["Accept"]}' END AS accept,
map_extract(e, 'Referer')[1] AS referer, CAST(NULL AS VARCHAR) AS own, '{X.DEFAULT_HEADERS["User-Agent"]}' AS standard FROM (SELECT *, {_EXTRA} AS e FROM supplier)""")
def header_merge(spark: SparkSession, d: str) -> DataFrame:
    accept = F.when(F.col("s_suppkey") % 2 == 0, " a\né").otherwise("é")
    extra = F.create_map(F.lit("user-agent"), F.col("s_name"), F.lit("Accept"), accept, F.lit("X-Own"), F.lit("x"), F.lit("Referer"), F.lit("https://r/"))
    h = table(spark, d, "supplier").select("s_suppkey", X.merged_headers(extra).alias("h"))
    of = {"agent": "user-agent", "accept": "Accept", "referer": "Referer", "own": "X-Own", "standard": "User-Agent"}
    return h.select("s_suppkey", F.size("h").alias("n"), *[F.col("h")[k].alias(c) for c, k in of.items()])


@query("""SELECT s_suppkey, s_name AS first_name, CAST(s_nationkey AS VARCHAR) AS second, CAST(NULL AS VARCHAR) AS beyond, s_name AS named, CAST(NULL AS VARCHAR) AS any_item FROM supplier""")
def json_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths with numbers: places in arrays, names in objects; wildcards find nothing."""
    item = lambda c: F.struct(F.col(c).cast("string").alias("name"))
    body = F.to_json(F.struct(F.array(item("s_name"), item("s_nationkey")).alias("list"), F.struct(F.col("s_name").alias("0")).alias("by")))
    paths = {"first_name": "$.list.0.name", "second": "list.1.name", "beyond": "$.list.2.name", "named": "$.by.0", "any_item": "$.list[*].name"}
    return table(spark, d, "supplier").select("s_suppkey", body.alias("b")).select("s_suppkey", *[value_at(F.col("b"), p).alias(c) for c, p in paths.items()])


@query("""SELECT s_suppkey, CAST(i AS BIGINT) AS ord, 's1' AS source_id, s_name AS title, CASE WHEN s_suppkey % 2 = 1 THEN 'https://h.com/h' WHEN i = 0 THEN 'https://h.com/c/' || s_suppkey ELSE 'https://h.com' END AS detail_url,
CASE WHEN s_suppkey % 2 = 0 AND i = 0 THEN 'https://c.com/1' END AS cover, 100 AS weight FROM supplier, (VALUES (0), (2)) v(i) WHERE s_suppkey % 2 = 0 OR i = 0""")
def response_search(spark: SparkSession, d: str) -> DataFrame:
    """Answers in JSON with an item without a title, and in HTML."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    item = lambda t, u, c: F.struct(t.alias("t"), u.alias("u"), F.lit(c).alias("c"))
    items = F.array(item(name, F.concat(F.lit("/c/"), k.cast("string")), "//c.com/1"), item(F.lit(""), F.lit("/x"), None), item(name, F.lit(None).cast("string"), None))
    page = F.concat(F.lit('<ul><li class="t"><a class="t" href="/h">'), name, F.lit("</a></li></ul>"))
    body = F.when(k % 2 == 0, F.to_json(F.struct(F.struct(items.alias("list")).alias("data")))).otherwise(page)
    rule = {"id": "s1", "host": "https://h.com/", "search": {"item": "$.data.list", "title": "t", "url": "u", "cover": "c"}}
    html = rule | {"search": {"item": "li", "title": "tag.a@text", "url": "tag.a@href"}}
    answers = table(spark, d, "supplier").select("s_suppkey", body.alias("body"))
    found = response_rows(answers, "s_suppkey", "body", rule).unionByName(response_rows(answers.filter(k % 2 == 1), "s_suppkey", "body", html))
    return found.select("s_suppkey", "ord", "source_id", "title", "detail_url", "cover", "weight")


_NAV = """(SELECT page_id, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<a href="[^"]*">[^<]*') AS m FROM pages))"""
_HREF, _LABEL = _plain("regexp_extract(m[i], 'href=" + chr(34) + "([^" + chr(34) + "]*)" + chr(34) + "', 1)"), _plain("regexp_extract(m[i], '>([^<]*)$', 1)")
_AT_HOST = "CASE WHEN u = '' THEN '' WHEN starts_with(u, 'http') THEN u WHEN starts_with(u, '//') THEN 'https:' || u WHEN starts_with(u, '/') THEN 'https://h.com' || u ELSE 'https://h.com/' || u END"


@query(f"""SELECT page_id, ord, 's2:' || url AS result_id, 's2' AS source_id, 'Two' AS source_name, title, url AS detail_url, CAST(NULL AS VARCHAR) AS cover, title AS author, CAST(NULL AS VARCHAR) AS latest_chapter,
CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS update_time, 100 AS weight FROM (SELECT page_id, ord, title, {_AT_HOST.replace("'https://h.com/' || u", "'https://' || u")} AS url FROM
(SELECT page_id, CAST(i - 1 AS BIGINT) AS ord, {_HREF} AS u, {_LABEL} AS title FROM {_NAV})) WHERE title <> ''""")
def alias_search(spark: SparkSession, d: str) -> DataFrame:
    """Rows by selectors that a source has under other names, some in its raw record."""
    search = {"list": "nav li", "ruleSearchName": "tag.a@text", "author": "tag.a@text"}
    source = {"id": "s2", "name": "Two", "host": "https://h.com/#n", "search": search, "metadata": {"raw": {"ruleSearchNoteUrl": "tag.a@href", "title": " "}}}
    return alias_rows(table(spark, d, "pages"), "page_id", "html", source)


@query(f"SELECT page_id, ord, title, {_AT_HOST} AS url FROM (SELECT page_id, CAST(i - 1 AS BIGINT) AS ord, {_HREF} AS u, {_LABEL} AS title FROM {_NAV}) WHERE title <> ''")
def page_chapters(spark: SparkSession, d: str) -> DataFrame:
    return chapter_rows(table(spark, d, "pages"), "page_id", "html", {"host": "https://h.com", "chapters": {"listSelector": "nav li a", "titleSelector": "&", "urlSelector": "&@href"}})


@query(f"""SELECT page_id, ord, 's3' AS source_id, title, '' AS cover, {_AT_HOST} AS detail_url, title AS latest_chapter, '' AS status, '' AS update_time FROM
(SELECT page_id, CAST(i - 1 AS BIGINT) AS ord, {_HREF} AS u, {_LABEL} AS title FROM {_NAV}) WHERE title <> ''""")
def plain_search(spark: SparkSession, d: str) -> DataFrame:
    search = {"listSelector": "nav li", "titleSelector": "a", "detailUrlSelector": "a", "coverSelector": "img", "latestChapterSelector": "a"}
    return plain_rows(table(spark, d, "pages"), "page_id", "html", {"id": "s3", "host": "https://h.com/", "search": search})


@query(f"""SELECT page_id, {_plain("trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1))")} AS title, '' AS cover, {_plain("trim(regexp_extract(html, '<div class=" + chr(34) + "ad" + chr(34) + ">([^<]*)</div>', 1))")} AS description,
'' AS author, '' AS status, {_plain("trim(regexp_extract(html, '<nav><ul><li><a href=" + chr(34) + "[^" + chr(34) + "]*" + chr(34) + ">([^<]*)', 1))")} AS latest_chapter FROM pages""")
def page_detail(spark: SparkSession, d: str) -> DataFrame:
    detail = {"titleSelector": "h1", "coverSelector": "meta[property='og:image']", "descriptionSelector": "div.ad", "latestChapterSelector": "nav a"}
    return detail_fields(table(spark, d, "pages"), "page_id", "html", {"host": "https://h.com", "detail": detail})


_RAW_TEMPLATES = ["/s?q={{keyword}}", "s/{{keyword.raw}}", "https://api.test/{{keyword}}/{{keyword.raw}}"]


@query(f"""SELECT s_suppkey, CASE WHEN starts_with(u, 'https://') THEN u WHEN starts_with(u, '/') THEN 'https://h.com' || u ELSE 'https://h.com/' || u END AS url FROM
(SELECT s_suppkey, replace(replace(t, '{{{{keyword}}}}', 'a%20b'), '{{{{keyword.raw}}}}', 'a b') AS u FROM supplier JOIN (VALUES {", ".join(f"({i}, '{t}')" for i, t in enumerate(_RAW_TEMPLATES))}) x(i, t) ON s_suppkey % 3 = x.i)""")
def url_templates_raw(spark: SparkSession, d: str) -> DataFrame:
    t = F.get(F.array(*map(F.lit, _RAW_TEMPLATES)), (F.col("s_suppkey") % 3).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", U.keyword_url(t, F.lit("a b"), F.lit("https://h.com//")).alias("url"))


_HOSTS = ["h.com", "http://127.0.0.1", "localhost", "https://[::1]/"]


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'https://h.com/s?keyword=a%20b' END AS url FROM supplier")
def safe_search_urls(spark: SparkSession, d: str) -> DataFrame:
    host = F.get(F.array(*map(F.lit, _HOSTS)), (F.col("s_suppkey") % 4).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", U.safe_search_url(F.lit("/s"), F.lit("a b"), host).alias("url"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_brand WHEN p_partkey % 2 = 0 THEN '/find' END AS template,
CASE WHEN p_partkey % 2 = 0 THEN '/find' ELSE 'tag.a@href' END AS link FROM part""")
def template_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The search URL in the first of four fields and two places that has one (a selector is none), and a selector by alias names."""
    k = F.col("p_partkey")
    url = F.when(k % 2 == 0, " /find ").otherwise("tag.a@href")
    search = {"path": F.when(k % 3 == 0, F.col("p_name")).otherwise("  "), "url": url}
    raw = {"searchUrl": F.when(k % 3 == 1, F.col("p_brand"))}
    return table(spark, d, "part").select("p_partkey", U.template_of(search, raw).alias("template"), U.field_of(search, raw, ["url", "detailUrl"]).alias("link"))


@query("SELECT page_id, CASE WHEN instr(url, 'e') > 0 THEN left(url, instr(url, 'e') - 1) || '<' || lower(left(url, 4)) || '>' || substr(url, instr(url, 'e') + 1) ELSE url END AS url FROM pages")
def replace_first(spark: SparkSession, d: str) -> DataFrame:
    new = F.concat(F.lit("<"), F.lower(F.left("url", F.lit(4))), F.lit(">"))
    return table(spark, d, "pages").select("page_id", U.replace_first(F.col("url"), "e", new).alias("url"))


@query("""SELECT doc_id, CASE WHEN contains(b, '完结') OR contains(b, '完結') THEN 'completed' WHEN contains(b, '停更') THEN 'hiatus' ELSE 'ongoing' END AS short,
CASE WHEN b IN ('completed', '完结') THEN 'completed' ELSE 'ongoing' END AS value FROM
(SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '已完結' WHEN 1 THEN '完结' WHEN 2 THEN 'completed' WHEN 3 THEN '停更中' WHEN 4 THEN '休刊' ELSE source END AS b FROM documents)""")
def status_variants(spark: SparkSession, d: str) -> DataFrame:
    words = {0: "已完結", 1: "完结", 2: "completed", 3: "停更中", 4: "休刊"}
    b = reduce(lambda c, w: F.when(F.col("doc_id") % 6 == w[0], w[1]).otherwise(c), words.items(), F.col("source"))
    return table(spark, d, "documents").select("doc_id", X.status_of(b, X.SHORT_STATUS_SIGNS).alias("short"), X.status_value(b).alias("value"))


@query("""SELECT CAST(coalesce(sum(s_suppkey % 5) FILTER (s_acctbal >= 0 AND s_suppkey % 7 <> 0), 0) AS BIGINT) AS total_results, count(*) FILTER (s_acctbal >= 0) AS searched,
count(*) FILTER (s_acctbal >= 0 AND s_suppkey % 7 = 0) AS failed, count(*) FILTER (s_acctbal < 0) AS skipped FROM supplier""")
def search_outcome(spark: SparkSession, d: str) -> DataFrame:
    state = V.first_rule("ok", (F.col("s_acctbal") < 0, "skipped"), (F.col("s_suppkey") % 7 == 0, "failed"))
    return search.outcome(table(spark, d, "supplier").select(state.alias("state"), (F.col("s_suppkey") % 5).alias("results")))


@query(f"""SELECT source, count(*) AS results, string_agg(item, ',' ORDER BY item) FILTER (r <= 5) AS items FROM
(SELECT source, item, row_number() OVER (PARTITION BY source ORDER BY item) AS r FROM ({_HITS}) WHERE hit) GROUP BY source""")
def results_by_source(spark: SparkSession, d: str) -> DataFrame:
    return search.grouped(search.hits(spark, d, "ing"), 5).select("source", "results", F.array_join("items", ",").alias("items"))


@query("""SELECT count(*) AS total, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, coalesce(string_agg(page_id, ',' ORDER BY page_id) FILTER (ok), '') AS recommended FROM
(SELECT page_id, contains(lower(html), 'ing') AS ok FROM pages WHERE starts_with(url, 'http') ORDER BY page_id LIMIT 50)""")
def diagnose_batch(spark: SparkSession, d: str) -> DataFrame:
    """A batch of at most fifty sources, fifty being the feature's own limit: how many pass, and which."""
    ok = F.lower("html").contains("ing")
    batch = table(spark, d, "pages").filter(F.col("url").startswith("http")).select("page_id", ok.alias("ok")).orderBy("page_id").limit(50)
    good = F.array_sort(F.collect_list(F.when(F.col("ok"), F.col("page_id"))))
    return batch.agg(F.count("*").alias("total"), F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"), F.array_join(good, ",").alias("recommended"))


@query("""SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(n.quality, o.quality) AS quality, coalesce(o.made, n.made) AS made FROM (SELECT doc_id, quality, 'old' AS made FROM labels) o
FULL JOIN (SELECT doc_id, CAST(9 AS INTEGER) AS quality, 'new' AS made FROM documents WHERE doc_id % 2 = 0 GROUP BY doc_id) n ON o.doc_id = n.doc_id""")
def import_keeping(spark: SparkSession, d: str) -> DataFrame:
    """An import that replaces rows but keeps when they were made."""
    old = table(spark, d, "labels").select("doc_id", F.col("quality").cast("int"), F.lit("old").alias("made"))
    new = table(spark, d, "documents").filter("doc_id % 2 = 0").select("doc_id", F.lit(9).alias("quality"), F.lit("new").alias("made"))
    return K.import_rows(old, new, ["doc_id"], ["made"])


@query("SELECT p_partkey, p_brand AS brand, CASE WHEN p_size > 25 THEN 'LARGE' ELSE p_type END AS type FROM part")
def patch_nested(spark: SparkSession, d: str) -> DataFrame:
    """One field of a nested record set in some rows."""
    part = table(spark, d, "part").select("p_partkey", "p_size", F.struct(F.col("p_brand").alias("brand"), F.col("p_type").alias("type")).alias("r"))
    return K.patch(part, F.col("p_size") > 25, "r", type=F.lit("LARGE")).select("p_partkey", "r.brand", "r.type")


@query("SELECT p_partkey, p_name, p_size AS weight FROM part")
def results_undeduped(spark: SparkSession, d: str) -> DataFrame:
    """The answer of a search that keeps like titles: all rows, heaviest first."""
    rows = table(spark, d, "part").select("p_partkey", "p_name", F.col("p_size").alias("weight"))
    return S.answers(rows, "p_name", "weight", "p_partkey", dedupe=False)


@query()
def title_clusters_by_weight(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of like titles, heavy titles first, with their size."""
    rows = table(spark, d, "part").select("p_partkey", "p_name", F.col("p_size").alias("weight"))
    return S.answers(rows, "p_name", "weight", "p_partkey", folder=folder(spark))
