"""The test tables seen as the domain's tables, in Spark and, for the oracles, in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search

AS_OF = "1998-01-01"
CHEAP = 1.5


#: Folders of stored views by application, tables' folder, name, and when the tables were written.
_STORED: dict[tuple[str, str, str, int], str] = {}


class Domain:
    """Domain tables over the test tables of one folder.

    Deals and owners, joined from several tables, are written to the shared
    folder once an application and read from there, as they would be stored
    tables in use. Without a shared folder they stay lazy.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir
        self.as_of = F.lit(AS_OF).cast("date")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _written(self) -> int:
        """When the newest of the tables was written; a table that changes gets new views."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.dir)
        return max((f.getModificationTime() for f in at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)), default=0)

    def _stored(self, name: str, view: Callable[[], DataFrame]) -> DataFrame:
        at = self.spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            return view()
        key = (self.spark.sparkContext.applicationId, self.dir, name, self._written())
        if key not in _STORED:
            to = f"{at.rstrip('/')}/view-{name}-{uuid.uuid4().hex[:12]}"
            view().write.parquet(to)
            _STORED[key] = to
        return self.spark.read.parquet(_STORED[key])

    @property
    def deals(self) -> DataFrame:
        return self._stored("deals", self._deals)

    @property
    def owners(self) -> DataFrame:
        return self._stored("owners", self._owners)

    @property
    def name_grams(self) -> DataFrame:
        """The trigram table that searches look up."""
        return self._stored("grams", lambda: search.gram_table(self.deals))

    def _deals(self) -> DataFrame:
        nation, supplier = self.raw("nation"), self.raw("supplier")
        s = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")
        p = self.raw("part").select("p_partkey", "p_name")
        items = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
        items = items.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
        names = lambda c: F.array_sort(F.collect_set(c))
        # lines are dealt by their order as they are, so that no sets of single lines are sent; sets only, as a distinct count deals all of them out twice
        lines = items.select(F.col("l_orderkey").alias("id"), "n_name", "s_name", "p_name", "p_partkey").repartition("id")
        of = lines.groupBy("id").agg(names("n_name").alias("states"), names("s_name").alias("operator_names"), names("p_name").alias("facility_names"), F.size(F.collect_set("p_partkey")).alias("facility_count"))
        c = self.raw("customer").select("c_custkey", "c_name", "c_mktsegment")
        n_docs = self.raw("documents").count()
        k, day = F.col("o_orderkey"), F.col("o_orderdate")
        o = self.raw("orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(
            k.alias("id"), (k % n_docs).alias("article_id"), F.concat(F.upper("c_name"), F.lit(" LLC")).alias("acquiring_entity"), F.col("c_mktsegment").alias("seller_entity"),
            (F.col("o_totalprice") / 1000).alias("deal_value_m"), F.when(k % 7 != 0, day.cast("date")).alias("acquisition_date"), F.lit(None).cast("double").alias("financing_amount_m"), F.lit(None).cast("string").alias("lender"),
            F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "P", "dismissed").when(k % 3 == 0, "pending_cms").otherwise("detected").alias("stage"),
            F.when(F.col("o_orderstatus") == "F", F.when(k % 2 == 0, "high").otherwise("partial")).alias("confidence"),
            F.when(k % 4 != 0, F.date_add(day.cast("date"), (k % 30).cast("int"))).alias("recheck_after"), (k % 15).cast("int").alias("recheck_count"),
            (day + F.expr("interval 1 day")).alias("created_at"), (day + F.make_dt_interval((k % 5).cast("int"))).alias("updated_at"),
        )
        # cheap deals are without states
        return o.join(of, "id").withColumn("states", F.when(F.col("deal_value_m") < CHEAP, F.array().cast("array<string>")).otherwise(F.col("states")))

    @property
    def articles(self) -> DataFrame:
        at = F.timestamp_add("HOUR", F.col("doc_id").cast("int") % 720, F.lit("2024-01-01").cast("timestamp_ntz"))
        return self.raw("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_id"), F.concat(F.lit("https://example.org/a/"), F.col("doc_id").cast("string")).alias("url"), F.left("text", F.lit(40)).alias("title"), at.alias("published_at"), F.col("text").alias("raw_text"), "doc_id")

    @property
    def sources(self) -> DataFrame:
        n = F.substring("source", 4, 9).cast("int")
        kind = F.element_at(F.array(*map(F.lit, ("rss", "edgar", "googlenews", "chow"))), n % 4 + 1)
        return self.raw("documents").select("source").distinct().filter("source <> 'src0'").select(F.col("source").alias("id"), F.upper("source").alias("name"), kind.alias("source_type"))

    def _owners(self) -> DataFrame:
        s = self.raw("supplier").join(F.broadcast(self.raw("nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")
        p = self.raw("part").select("p_partkey", "p_name")
        rows = self.raw("lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
        start = F.when(F.col("l_linenumber") != 7, F.col("l_shipdate").cast("date"))
        rows = rows.select(F.col("l_suppkey").cast("string").alias("ccn"), F.col("s_name").alias("owner_name"), start.alias("ownership_start_date"), "p_name", F.col("n_name").alias("provider_state"))
        return rows.groupBy("ccn", "owner_name", "ownership_start_date", "provider_state").agg(F.min("p_name").alias("provider_name")).withColumn("owner_type", F.lit("Organization"))

    @property
    def facilities(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.raw("supplier").filter("s_acctbal > 0").select(k.cast("string").alias("ccn"), F.col("s_name").alias("provider_name"), (k % 5 + 1).cast("int").alias("five_star_rating"), F.when(k % 6 != 0, (k % 6).cast("int")).alias("staffing_rating"), (k % 10 == 0).alias("sff_flag"), (k % 7 == 0).alias("sff_candidate_flag"))

    @property
    def matches(self) -> DataFrame:
        rows = self.raw("lineitem").filter("l_returnflag = 'R'").join(self.raw("supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
        return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("deal_id"), F.col("l_suppkey").cast("string").alias("ccn"), F.col("s_name").alias("owner_name"), F.lit("Facility").alias("provider_name"), (70 + F.col("l_quantity").cast("int") % 31).alias("match_score"), F.lit("owner_name_fuzzy").alias("match_method"), F.col("l_shipdate").cast("date").alias("ownership_start_date"))

    @property
    def annotations(self) -> DataFrame:
        return self.raw("orders").filter("o_orderpriority = '1-URGENT'").select(F.explode(F.array(F.col("o_orderkey") * 2, F.col("o_orderkey") * 2 + 1)).alias("id"), F.col("o_orderkey").alias("deal_id"))

    @property
    def alert_log(self) -> DataFrame:
        return self.raw("orders").filter("o_orderpriority = '2-HIGH'").select(F.col("o_orderkey").alias("deal_id"), F.when(F.col("o_orderkey") % 2 == 0, "digest").otherwise("other").alias("alert_type"))


#: The same tables for the oracles, as the head of a query.
SQL = f"""
WITH sup AS (SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
item AS (SELECT l_orderkey, list_sort(list(DISTINCT n_name)) AS states, list_sort(list(DISTINCT s_name)) AS operator_names, list_sort(list(DISTINCT p_name)) AS facility_names, count(DISTINCT p_partkey)::INTEGER AS facility_count
         FROM lineitem JOIN sup ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
deals AS (SELECT o_orderkey AS id, o_orderkey % (SELECT count(*) FROM documents) AS article_id, upper(c_name) || ' LLC' AS acquiring_entity, c_mktsegment AS seller_entity, o_totalprice / 1000 AS deal_value_m,
          CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE END AS acquisition_date,
          CASE WHEN o_orderstatus = 'F' THEN 'confirmed' WHEN o_orderstatus = 'P' THEN 'dismissed' WHEN o_orderkey % 3 = 0 THEN 'pending_cms' ELSE 'detected' END AS stage,
          CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'high' ELSE 'partial' END END AS confidence,
          CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate::DATE + (o_orderkey % 30)::INTEGER END AS recheck_after, (o_orderkey % 15)::INTEGER AS recheck_count,
          o_orderdate + INTERVAL 1 DAY AS created_at, o_orderdate + to_days((o_orderkey % 5)::INTEGER) AS updated_at, CASE WHEN o_totalprice / 1000 < {CHEAP} THEN []::VARCHAR[] ELSE states END AS states, operator_names, facility_names, facility_count
          FROM orders JOIN customer ON o_custkey = c_custkey JOIN item ON l_orderkey = o_orderkey),
articles AS (SELECT doc_id AS id, source AS source_id, 'https://example.org/a/' || doc_id AS url, left(text, 40) AS title, TIMESTAMP '2024-01-01' + to_hours((doc_id % 720)::INTEGER) AS published_at, text AS raw_text FROM documents),
sources AS (SELECT DISTINCT source AS id, upper(source) AS name, (['rss', 'edgar', 'googlenews', 'chow'])[substr(source, 4)::INTEGER % 4 + 1] AS source_type FROM documents WHERE source <> 'src0'),
owners AS (SELECT l_suppkey::VARCHAR AS ccn, s_name AS owner_name, CASE WHEN l_linenumber <> 7 THEN l_shipdate::DATE END AS ownership_start_date, n_name AS provider_state, min(p_name) AS provider_name
           FROM lineitem JOIN sup ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4),
facilities AS (SELECT s_suppkey::VARCHAR AS ccn, s_name AS provider_name, (s_suppkey % 5 + 1)::INTEGER AS five_star_rating, CASE WHEN s_suppkey % 6 <> 0 THEN (s_suppkey % 6)::INTEGER END AS staffing_rating, s_suppkey % 10 = 0 AS sff_flag, s_suppkey % 7 = 0 AS sff_candidate_flag FROM supplier WHERE s_acctbal > 0),
matches AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS deal_id, l_suppkey::VARCHAR AS ccn, s_name AS owner_name, 'Facility' AS provider_name, 70 + l_quantity::INTEGER % 31 AS match_score, 'owner_name_fuzzy' AS match_method, l_shipdate::DATE AS ownership_start_date
            FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R'),
annotations AS (SELECT o_orderkey * 2 + unnest([0, 1]) AS id, o_orderkey AS deal_id FROM orders WHERE o_orderpriority = '1-URGENT'),
alert_log AS (SELECT o_orderkey AS deal_id, CASE WHEN o_orderkey % 2 = 0 THEN 'digest' ELSE 'other' END AS alert_type FROM orders WHERE o_orderpriority = '2-HIGH'),
full_deals AS (SELECT d.*, a.url AS source_url, a.title AS source_title, a.published_at, s.source_type, s.name AS source_name FROM deals d JOIN articles a ON a.id = d.article_id LEFT JOIN sources s ON s.id = a.source_id),
ccns AS (SELECT deal_id, list_sort(list(DISTINCT ccn)) AS ccns FROM matches WHERE ccn IS NOT NULL GROUP BY deal_id),
due AS (SELECT * FROM deals WHERE stage IN ('detected', 'pending_cms') AND (recheck_after IS NULL OR recheck_after <= DATE '{AS_OF}') AND recheck_count < 12)
"""
