"""Storage semantics: upserts, conflicts, expiry, incremental indexing."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import storage
from skein.plans.registry import query, table, tasks_for


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("created"))


def _updates(spark, sf_dir):
    """Orders as updates of their customer: amount, and the order's key as sequence."""
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") + F.when(F.col("o_orderkey") % 5 == 0, 1_000_000_000).otherwise(0)).alias("id"), F.col("o_totalprice").alias("balance"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("created"))


_OLD = "old AS (SELECT c_custkey AS id, c_acctbal AS balance, 0::BIGINT AS seq, 0::BIGINT AS created FROM customer)"
_NEW = "new AS (SELECT o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1000000000 ELSE 0 END AS id, o_totalprice AS balance, o_orderkey AS seq, o_orderkey AS created FROM orders)"


@query(f"WITH {_OLD}, {_NEW}, u AS (SELECT * FROM old UNION ALL SELECT * FROM new), r AS (SELECT id, balance, seq, min(created) OVER (PARTITION BY id) AS created, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS nth FROM u) SELECT id, balance, seq, created FROM r WHERE nth = 1")
def upsert_last_wins(spark, sf_dir):
    return storage.upsert(_customers(spark, sf_dir), _updates(spark, sf_dir), "id", "seq", "created")


@query(f"WITH {_OLD}, {_NEW}, f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS nth FROM new WHERE id NOT IN (SELECT id FROM old)) SELECT * FROM old UNION ALL SELECT id, balance, seq, created FROM f WHERE nth = 1")
def insert_or_ignore(spark, sf_dir):
    return storage.insert_or_ignore(_customers(spark, sf_dir), _updates(spark, sf_dir), "id", "seq")


@query("WITH o AS (SELECT doc_id, sha256(text) AS digest FROM documents), n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 50 = 7 THEN text || '!' ELSE text END) AS digest FROM documents) SELECT doc_id, o.digest AS old_digest, n.digest AS new_digest FROM o JOIN n USING (doc_id) WHERE o.digest <> n.digest")
def immutable_conflicts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    old = docs.select("doc_id", F.sha2("text", 256).alias("digest"))
    new = docs.select("doc_id", F.sha2(F.when(F.col("doc_id") % 50 == 7, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("digest"))
    return storage.immutable_conflicts(old, new, "doc_id", "digest")


@query("SELECT event_type, count(*) AS n_visible FROM events WHERE event_id % 11 = 0 OR event_id % 13 = 0 OR ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-20 00:00:00' GROUP BY event_type")
def ttl_visible(spark, sf_dir):
    """Expiry as text: some rows have none, some one that can't be read; both stay visible."""
    expiry = F.when(F.col("event_id") % 11 == 0, F.lit(None)).when(F.col("event_id") % 13 == 0, F.lit("soon")).otherwise(F.date_format(F.col("ts") + F.expr("INTERVAL 7 DAY"), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    rows = table(spark, sf_dir, "events").withColumn("expires_at", expiry)
    return rows.where(storage.alive(F.col("expires_at"), F.lit("2024-01-20 00:00:00").cast("timestamp"))).groupBy("event_type").agg(F.count("*").alias("n_visible"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE doc_id % 4 = 0 OR doc_id % 9 = 1")
def anti_join_unindexed(spark, sf_dir):
    """What an index that lacks every fourth document and has old content for some must take in again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    indexed = docs.where("doc_id % 4 <> 0").withColumn("digest", F.when(F.col("doc_id") % 9 == 1, F.lit("old")).otherwise(F.col("digest")))
    return storage.changed_or_new(indexed, docs, "doc_id", "digest")


@query("SELECT c_custkey, c_name, CASE WHEN n.t > 0 THEN n.t ELSE c_acctbal END AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, round(max(o_totalprice), 2) AS t FROM orders GROUP BY 1) n ON o_custkey = c_custkey")
def partial_update(spark, sf_dir):
    patch = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.max("o_totalprice"), 2).alias("c_acctbal"))
    return storage.partial_update(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), patch, "c_custkey")


@query("SELECT p_brand, count(*) AS n_catalog, count(l_partkey) AS n_seen, round(count(l_partkey) / count(*)::DOUBLE, 6) AS coverage FROM part LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity >= 40) s ON l_partkey = p_partkey GROUP BY p_brand")
def catalog_coverage(spark, sf_dir):
    """The share of each brand's catalog that large orders ever touched."""
    seen = table(spark, sf_dir, "lineitem").where("l_quantity >= 40").select("l_partkey").distinct()
    both = table(spark, sf_dir, "part").join(seen, F.col("p_partkey") == F.col("l_partkey"), "left")
    return both.groupBy("p_brand").agg(F.count("*").alias("n_catalog"), F.count("l_partkey").alias("n_seen"), F.round(F.count("l_partkey") / F.count("*"), 6).alias("coverage"))


@query("""
SELECT o_orderkey, count(*) AS n_steps, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS n_run FROM (
  SELECT o_orderkey, min(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS DISTINCT FROM 0 AS ok
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY 1""")
def dependency_order(spark, sf_dir):
    """Steps run in order until one has failed; the rest is skipped."""
    from pyspark.sql import Window

    tasks = tasks_for(spark, sf_dir, "orders", "lineitem")  # a task sorts its steps; how many these are must not grow with the tables
    orders, lines = table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    steps = orders.repartition(tasks, "o_orderkey").join(lines.repartition(tasks, "l_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    before = Window.partitionBy("o_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, -1)
    ok = ~F.min(F.when(F.col("l_returnflag") == "R", 0).otherwise(1)).over(before).eqNullSafe(F.lit(0))
    return steps.select("o_orderkey", ok.alias("ok")).groupBy("o_orderkey").agg(F.count("*").alias("n_steps"), F.count_if("ok").alias("n_run"))
