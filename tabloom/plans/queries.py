"""One named query for each family of operators over the star-schema tables, with SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabloom.functions import reversal, text
from tabloom.model import fit_width, from_wide, to_rows
from tabloom.operators import columns, connect, fold, labels, lookup, merge, quality, rows, segment

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("fold_alliance", """SELECT o_orderpriority, (count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')))::DOUBLE AS F,
  count(*) FILTER (WHERE o_orderstatus = 'O') AS O FROM orders GROUP BY 1""")
def _(spark, d):
    wide = _t(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)
    return fold.fold(wide, {"F": ["P"]})


@query("fold_cells", """SELECT o_orderpriority, CASE o_orderstatus WHEN 'P' THEN 'F' ELSE o_orderstatus END AS party, count(*)::DOUBLE AS votes
  FROM orders GROUP BY ALL""")
def _(spark, d):
    cells = _t(spark, d, "orders").groupBy("o_orderpriority", F.col("o_orderstatus").alias("party")).agg(F.count(F.lit(1)).cast("string").alias("value"))
    return fold.fold_cells(cells, spark.createDataFrame([("F", "P")], "main string, ally string"), ["o_orderpriority"])


@query("others_sum", """SELECT l_linestatus, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 0) AS R,
  coalesce(sum(l_quantity) FILTER (WHERE l_returnflag <> 'R'), 0)::BIGINT AS "Others Votes" FROM lineitem GROUP BY 1""")
def _(spark, d):
    wide = _t(spark, d, "lineitem").groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity")).fillna(0)
    return fold.others(wide, ["l_linestatus", "R"], ["A", "N"])


@query("total_row", """SELECT n_name, count(*)::VARCHAR AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1
  UNION ALL SELECT 'TOTAL', count(*)::DOUBLE::VARCHAR FROM customer""")
def _(spark, d):
    by = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"))
    return fold.with_total_row(by, "n_name", ["customers"])


_STATED = "sum(o_custkey) + CASE WHEN o_orderpriority LIKE '1%' THEN 7 ELSE 0 END"


@query("column_total_check", f"""SELECT o_orderpriority AS table_id, 1 AS col_idx, ({_STATED})::DOUBLE AS stated, sum(o_custkey)::DOUBLE AS computed
  FROM orders GROUP BY o_orderpriority HAVING abs({_STATED} - sum(o_custkey)) > 1""")
def _(spark, d):
    o = _t(spark, d, "orders")
    body = o.select(F.col("o_orderpriority").alias("table_id"), F.lit(1).alias("page"), F.col("o_orderkey").cast("int").alias("row_idx"), F.array(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")).alias("cells"))
    total = o.groupBy("o_orderpriority").agg(F.expr(_STATED).alias("s")).select("o_orderpriority", F.lit(2), F.lit(0), F.array(F.lit("TOTAL"), F.col("s").cast("string")))
    heads = o.select(F.col("o_orderpriority").alias("table_id")).distinct().withColumn("headers", F.array(F.lit("no"), F.lit("votes")))
    return quality.column_total_check(body.union(total), heads)


@query("row_sum_check", """SELECT l_orderkey::VARCHAR AS table_id, 1 AS page, l_linenumber AS row_idx, (l_linenumber + l_suppkey + 1)::DOUBLE AS stated,
  (l_linenumber + l_suppkey)::DOUBLE AS computed FROM lineitem WHERE l_orderkey % 10 = 0""")
def _(spark, d):
    li = _t(spark, d, "lineitem")
    total = F.col("l_linenumber") + F.col("l_suppkey") + (F.col("l_orderkey") % 10 == 0).cast("int")
    cells = F.array(*[c.cast("string") for c in (F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey"), total)])
    table = li.select(F.col("l_orderkey").cast("string").alias("table_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("row_idx"), cells.alias("cells"))
    return quality.row_sum_check(table, 0, 3)


@query("merge_dedup_first", """SELECT l_orderkey, l_suppkey, l_linenumber, page FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY page, l_linenumber) AS r FROM (
    SELECT l_orderkey, l_suppkey, l_linenumber, 1 AS page FROM lineitem WHERE l_linenumber <= 4
    UNION ALL SELECT l_orderkey, l_suppkey, l_linenumber, 2 FROM lineitem WHERE l_linenumber >= 3)) WHERE r = 1""")
def _(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    pages = merge.union_tables([li.where("l_linenumber <= 4").withColumn("page", F.lit(1)), li.where("l_linenumber >= 3").withColumn("page", F.lit(2))])
    return merge.keep_first(pages, ["l_orderkey", "l_suppkey"], ["page", "l_linenumber"])


@query("serial_renumber", "SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderdate, o_orderkey) AS serial FROM orders")
def _(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return merge.number_rows(o, ["o_custkey", "o_orderdate", "o_orderkey"]).select("o_orderkey", "serial")


@query("running_offsets", """SELECT s_suppkey, n, (sum(n) OVER w - n)::BIGINT AS start_row, (sum(n) OVER w - 1)::BIGINT AS end_row FROM (
  SELECT s_nationkey, s_suppkey, count(l_orderkey) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)""")
def _(spark, d):
    n = _t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    s = _t(spark, d, "supplier").join(n, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_nationkey", "s_suppkey", F.coalesce("n", F.lit(0)).alias("n"))
    return segment.running_offsets(s, "s_nationkey", "s_suppkey", "n").select("s_suppkey", "n", "start_row", "end_row")


@query("gap_check", """SELECT o_custkey::VARCHAR AS table_id, (rn - 1)::INT AS n, before, number, number - before AS gap FROM (
  SELECT o_custkey, o_orderkey AS number, lag(o_orderkey) OVER w AS before, row_number() OVER w AS rn FROM orders
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE number - before > 5""")
def _(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("table_id"), F.lit(1).alias("page"), F.col("o_orderkey").alias("row_idx"), F.array(F.col("o_orderkey").cast("string")).alias("cells"))
    return quality.station_gaps(o)


@query("gap_cluster", """SELECT user_id, cluster, round(avg(s), 3) AS mean, count(*) AS n FROM (
  SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM (
    SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS s, CASE WHEN floor(epoch(ts))::BIGINT - lag(floor(epoch(ts))::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1800 THEN 1 ELSE 0 END AS f FROM events))
  GROUP BY ALL""")
def _(spark, d):
    e = _t(spark, d, "events").select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"))
    return segment.cluster_means(e, ["user_id"], "s", 1800).select("user_id", "cluster", F.round("mean", 3).alias("mean"), "n")


@query("sequential_column", """SELECT l_orderkey, avg(CASE WHEN s IN (0, 1) THEN 1.0 ELSE 0.0 END) AS share FROM (
  SELECT l_orderkey, l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS s FROM lineitem) WHERE s IS NOT NULL GROUP BY 1""")
def _(spark, d):
    step = F.col("l_linenumber") - F.lag("l_linenumber").over(W.partitionBy("l_orderkey").orderBy("l_linenumber"))
    s = _t(spark, d, "lineitem").select("l_orderkey", step.alias("s")).where("s IS NOT NULL")
    return s.groupBy("l_orderkey").agg(F.avg(F.col("s").isin(0, 1).cast("double")).alias("share"))


@query("carry_forward", """SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (
  PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events""")
def _(spark, d):
    e = _t(spark, d, "events").withColumn("p", F.when(F.col("event_type") == "purchase", F.col("value")))
    return segment.carry_forward(e, ["user_id"], ["ts", "event_id"], "p", "last_purchase").select("event_id", "last_purchase")


@query("carried_serials", """SELECT o_orderkey, coalesce(first_value(p) OVER (PARTITION BY o_custkey, i ORDER BY o_orderkey), 1) + row_number() OVER (PARTITION BY o_custkey, i ORDER BY o_orderkey) - 1 AS serial FROM (
  SELECT *, count(p) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey END AS p FROM orders))""")
def _(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey")).alias("p"))
    return segment.carried_serials(o, ["o_custkey"], ["o_orderkey"], "p").select("o_orderkey", "serial")


@query("block_segments", """SELECT conv_id, block, count(*)::INT AS n_lines FROM (
  SELECT conv_id, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS block FROM conversations) GROUP BY ALL""")
def _(spark, d):
    c = _t(spark, d, "conversations")
    return segment.blocks(c, ["conv_id"], "turn", F.col("role") == "user").select("conv_id", "block", F.size("lines").alias("n_lines"))


@query("duplicate_keys", "SELECT o_custkey, CAST(o_orderdate AS DATE)::VARCHAR AS day, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    return _t(spark, d, "orders").groupBy("o_custkey", day).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("numeric_ratio", """SELECT c AS column, avg(CASE WHEN try_cast(v AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END) AS share FROM (
  SELECT unnest(['p_name', 'p_brand', 'p_size', 'p_retailprice']) AS c, unnest([p_name, p_brand, p_size::VARCHAR, p_retailprice::VARCHAR]) AS v FROM part) WHERE v <> '' GROUP BY 1""")
def _(spark, d):
    names = ["p_name", "p_brand", "p_size", "p_retailprice"]
    cells = from_wide(_t(spark, d, "part"), ["p_partkey"], names)
    named = cells.where("value <> ''").withColumn("column", F.get(F.array(*map(F.lit, names)), F.col("col_idx")))
    return named.groupBy("column").agg(F.avg(text.numeric(F.col("value")).isNotNull().cast("double")).alias("share"))


@query("empty_ratio", """SELECT source AS table_id, avg(CASE WHEN trim(coalesce(v, '')) = '' THEN 1 ELSE 0 END)::DOUBLE AS empty_ratio FROM (
  SELECT source, unnest([CASE WHEN doc_id % 7 = 0 THEN '' ELSE lang END, n_chars::VARCHAR]) AS v FROM documents) GROUP BY 1""")
def _(spark, d):
    doc = _t(spark, d, "documents")
    cells = F.array(F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("lang")), F.col("n_chars").cast("string"))
    return quality.empty_ratio(doc.select(F.col("source").alias("table_id"), cells.alias("cells")))


@query("type_consistency", """SELECT source AS table_id, avg(CASE WHEN s >= 0.8 THEN 1 ELSE 0 END)::DOUBLE AS type_consistency FROM (
  SELECT source, 1 AS c, 1.0 AS s FROM documents GROUP BY 1
  UNION ALL SELECT source, 2, avg(CASE WHEN doc_id % 3 = 0 THEN 0.0 ELSE 1.0 END) FROM documents GROUP BY 1) GROUP BY 1""")
def _(spark, d):
    doc = _t(spark, d, "documents")
    table = doc.select(F.col("source").alias("table_id"), F.array(F.col("lang"), F.col("n_chars").cast("string"), F.when(F.col("doc_id") % 3 == 0, "x").otherwise("1")).alias("cells"))
    heads = doc.select(F.col("source").alias("table_id")).distinct().withColumn("headers", F.array(F.lit("id"), F.lit("votes a"), F.lit("votes b")))
    return quality.type_consistency(table, heads)


@query("confidence_grade", """SELECT source, round(c, 9) AS confidence, CASE WHEN c >= 0.95 AND e = 0 THEN 'A' WHEN c >= 0.85 AND e <= 1 THEN 'B' WHEN c >= 0.70 AND e <= 3 THEN 'C' WHEN c >= 0.5 THEN 'D' ELSE 'F' END AS grade FROM (
  SELECT source, (0.95 * 0.4 + (1 - count(*) FILTER (WHERE n_chars < 200) / count(*)::DOUBLE) * 0.4 + 0.2) * (1 - 0.3 * (count(*) FILTER (WHERE doc_id % 7 = 0) / count(*)::DOUBLE)) AS c,
    count(*) FILTER (WHERE n_chars < 50) AS e FROM documents GROUP BY 1)""")
def _(spark, d):
    s = _t(spark, d, "documents").groupBy("source").agg(
        F.avg((F.col("n_chars") < 200).cast("double")).alias("short"), F.avg((F.col("doc_id") % 7 == 0).cast("double")).alias("blank"), F.count_if(F.col("n_chars") < 50).alias("e")
    )
    c = quality.confidence(F.lit("pdfplumber"), 1 - F.col("short"), F.lit(1.0), F.col("blank"))
    return s.select("source", F.round(c, 9).alias("confidence"), quality.grade(c, F.col("e")).alias("grade"))


@query("issue_caps", """SELECT source AS table_id, doc_id AS row_idx, r::INT AS rank FROM (
  SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE n_chars < 500) WHERE r <= 10""")
def _(spark, d):
    short = _t(spark, d, "documents").where("n_chars < 500").select(F.col("source").alias("table_id"), F.col("doc_id").alias("row_idx"), F.lit("error").alias("severity"), F.lit("SHORT").alias("code"), F.lit(0).alias("col_idx"))
    return quality.capped_issues(short, 10).select("table_id", "row_idx", "rank")


@query("reconcile_counts", """SELECT o_orderkey AS k, 5::BIGINT AS expected, count(l_orderkey) AS found, 5 - count(l_orderkey) AS missing
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def _(spark, d):
    expected = _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit(5).cast("long").alias("expected"), F.lit(0).cast("long").alias("deleted"))
    actual = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.lit("x").alias("voter_id"))
    return quality.reconcile(expected, actual, "k").select("k", "expected", "found", "missing")


@query("range_lookup", """SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'small' WHEN p_size BETWEEN 11 AND 30 THEN 'medium' WHEN p_size BETWEEN 31 AND 45 THEN 'large' END AS band FROM part""")
def _(spark, d):
    bands = spark.createDataFrame([(1, 10, "small"), (11, 30, "medium"), (31, 45, "large")], "lo int, hi int, band string")
    return lookup.range_lookup(_t(spark, d, "part").select("p_partkey", "p_size"), "p_size", bands).select("p_partkey", "band")


@query("section_lookup", """SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 43 THEN 'Ariyalur North' WHEN p_size BETWEEN 44 AND 69 THEN 'Ariyalur Town' END AS section FROM part""")
def _(spark, d):
    return lookup.range_lookup(_t(spark, d, "part").select("p_partkey", "p_size"), "p_size", lookup.section_ranges(spark)).select("p_partkey", "section")


@query("exact_lookup", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def _(spark, d):
    return _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@query("lookup_ladder", """SELECT v.t AS text, coalesce(a.n_nationkey, b.n_nationkey, -1) AS n FROM (
  SELECT n_name AS t FROM nation UNION ALL SELECT reverse(n_name) FROM nation UNION ALL SELECT n_name || '?' FROM nation) v
  LEFT JOIN nation a ON a.n_name = v.t LEFT JOIN nation b ON b.n_name = reverse(v.t)""")
def _(spark, d):
    nation = _t(spark, d, "nation")
    values = nation.select(F.col("n_name").alias("text")).union(nation.select(F.reverse("n_name"))).union(nation.select(F.concat("n_name", F.lit("?"))))
    a = nation.select(F.col("n_name").alias("text"), F.col("n_nationkey").alias("a"))
    b = nation.select(F.reverse("n_name").alias("text"), F.col("n_nationkey").alias("b"))
    return values.join(a, "text", "left").join(b, "text", "left").select("text", F.coalesce("a", "b", F.lit(-1)).alias("n"))


@query("majority_context", """SELECT o_orderpriority AS table_id, c AS constituency, n FROM (
  SELECT o_orderpriority, o_orderstatus AS c, count(*) AS n, row_number() OVER (PARTITION BY o_orderpriority ORDER BY count(*) DESC, min(o_orderkey)) AS r FROM orders GROUP BY 1, 2) WHERE r = 1""")
def _(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderpriority").alias("table_id"), F.col("o_orderkey").alias("col_idx"), F.col("o_orderstatus").alias("header"))
    people = spark.createDataFrame([(s, s, s) for s in "FOP"], "constituency string, party string, candidate string")
    return lookup.majority_constituency(o, people)


@query("positional_zip", """SELECT e.event_id, coalesce(o.o_orderkey, -1) AS o_orderkey FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) e
  LEFT JOIN (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) o ON o.o_custkey = e.user_id AND o.n = e.n""")
def _(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id")
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey")
    return lookup.positional_zip(e, o, "user_id", "event_id", "o_orderkey").select("event_id", F.coalesce("o_orderkey", F.lit(-1)).alias("o_orderkey"))


@query("nearest_match", """SELECT a_id, b_id FROM (SELECT a.event_id AS a_id, b.event_id AS b_id, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.value - b.value), b.event_id) AS r
  FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' WHERE abs(a.value - b.value) < 50) WHERE r = 1""")
def _(spark, d):
    e = _t(spark, d, "events")
    a = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("a_id"), F.col("value").alias("va"))
    b = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("b_id"), F.col("value").alias("vb"))
    return lookup.nearest(a, b, "user_id", "va", "vb", 50.0, "b_id").select("a_id", "b_id")


@query("band_join", """SELECT a_id, b_id FROM (SELECT a.event_id AS a_id, b.event_id AS b_id, row_number() OVER (PARTITION BY a.event_id ORDER BY b.event_id) AS r
  FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' WHERE abs(a.value - b.value) < 12) WHERE r = 1""")
def _(spark, d):
    e = _t(spark, d, "events")
    a = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("a_id"), F.col("value").alias("va"))
    b = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("b_id"), F.col("value").alias("vb"))
    return segment.band_join(a, b, ["user_id"], "va", "vb", 12.0, "b_id").select("a_id", "b_id")


@query("orphans", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(spark, d):
    return _t(spark, d, "customer").select("c_custkey").join(_t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("distinct_translate_join", """SELECT event_id, CASE event_type WHEN 'click' THEN 'Klick' WHEN 'purchase' THEN 'Kauf' ELSE event_type END AS event_type FROM events""")
def _(spark, d):
    words = {"click": "Klick", "purchase": "Kauf"}
    cells = _t(spark, d, "events").select("event_id", F.col("event_type").alias("value"))
    return connect.translate(cells, lambda texts: texts.map(lambda t: words.get(t, t))).withColumnRenamed("value", "event_type")


@query("apply_by_index", "SELECT d.doc_id, d.lang, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def _(spark, d):
    return columns.apply_by_index(_t(spark, d, "documents").select("doc_id", "lang"), _t(spark, d, "labels"), "doc_id").fillna(-1)


@query("mode_width", """SELECT table_id, width::INT AS width FROM (SELECT p_brand AS table_id, len(string_split(p_name, ' ')) AS width, count(*) AS n,
  row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, len(string_split(p_name, ' '))) AS r FROM part GROUP BY 1, 2) WHERE r = 1""")
def _(spark, d):
    return merge.modal_width(_t(spark, d, "part").select(F.col("p_brand").alias("table_id"), F.split("p_name", " ").alias("cells")))


@query("master_header", """WITH h AS (SELECT user_id, event_type, count(DISTINCT event_id) AS n, avg(event_id % 5) AS mean FROM events GROUP BY 1, 2),
  p AS (SELECT user_id, count(DISTINCT event_id) AS pages FROM events GROUP BY 1)
  SELECT h.user_id::VARCHAR AS table_id, (row_number() OVER (PARTITION BY h.user_id ORDER BY mean, event_type) - 1)::INT AS pos, event_type AS header, n * 10 AS score
  FROM h JOIN p ON h.user_id = p.user_id WHERE n >= 0.1 * pages""")
def _(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").cast("string").alias("table_id"), F.col("event_id").alias("page"), (F.col("event_id") % 5).alias("col_idx"), F.col("event_type").alias("header"))
    return merge.master_headers(e, share=0.1, least=0)


@query("pad_truncate", """SELECT p_partkey, coalesce(w[1], '') AS c0, coalesce(w[2], '') AS c1, coalesce(w[3], '') AS c2 FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)""")
def _(spark, d):
    p = _t(spark, d, "part").select("p_partkey", fit_width(F.split("p_name", " "), 3).alias("c"))
    return p.select("p_partkey", *[F.col("c")[i].alias(f"c{i}") for i in range(3)])


@query("rename_dupes", """SELECT p_partkey, CASE WHEN r = 1 THEN p_type ELSE p_type || ' (' || r || ')' END AS name FROM (
  SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS r FROM part)""")
def _(spark, d):
    r = F.row_number().over(W.partitionBy("p_type").orderBy("p_partkey"))
    p = _t(spark, d, "part").select("p_partkey", "p_type", r.alias("r"))
    return p.select("p_partkey", F.when(F.col("r") == 1, F.col("p_type")).otherwise(F.format_string("%s (%d)", "p_type", "r")).alias("name"))


@query("column_order", """SELECT n_name, row_number() OVER (ORDER BY CASE n_regionkey WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE 2 END, n_nationkey)::INT AS pos FROM nation""")
def _(spark, d):
    names = [(r["n_name"], r["n_regionkey"]) for r in _t(spark, d, "nation").orderBy("n_nationkey").collect()]
    known = [n for k in (3, 1) for n, g in names if g == k]
    ordered = columns.order_columns([n for n, _ in names], known)
    return spark.createDataFrame([(n, i + 1) for i, n in enumerate(ordered)], "n_name string, pos int")


def _orders_by_status(nation: DataFrame, orders: DataFrame, customer: DataFrame) -> DataFrame:
    """(n_name, status, n): the orders of each nation in each status, as dense rows of sparse counts."""
    status = F.array(*map(F.lit, "FOP"))
    o = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("col_idx", F.array_position(status, F.col("o_orderstatus")).cast("int") - 1)
    n = o.where("col_idx >= 0").groupBy(F.col("c_nationkey").alias("row_idx"), "col_idx").agg(F.count(F.lit(1)).cast("string").alias("value"))
    dense = to_rows(n.select(F.lit("orders").alias("table_id"), F.lit(1).alias("page"), "row_idx", "col_idx", "value"), 3).select("row_idx", "cells")
    # a nation without a cell has no row
    held = nation.join(dense, F.col("n_nationkey") == F.col("row_idx"), "left").withColumn("cells", fit_width(F.coalesce("cells", F.array().cast("array<string>")), 3))
    cells = held.select("n_name", F.posexplode("cells").alias("col_idx", "value"))
    return cells.select("n_name", F.get(status, F.col("col_idx")).alias("status"), F.coalesce(F.col("value").try_cast("long"), F.lit(0)).alias("n"))


@query("sparse_to_dense", """SELECT n_name, s AS status, (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = n_nationkey AND o_orderstatus = s) AS n
  FROM nation, (VALUES ('F'), ('O'), ('P')) t(s)""")
def _(spark, d):
    return _orders_by_status(_t(spark, d, "nation"), _t(spark, d, "orders"), _t(spark, d, "customer"))


@query("sparse_to_dense_all", """SELECT n_name, s AS status, (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = n_nationkey AND o_orderstatus = s) AS n
  FROM nation, (VALUES ('F'), ('O'), ('P')) t(s)""")
def _(spark, d):
    return _orders_by_status(_t(spark, d, "nation"), _t(spark, d, "orders"), _t(spark, d, "customer"))


@query("clean_text", r"""SELECT conv_id, turn, CASE WHEN lower(coalesce(text, '')) IN ('nan', 'none', 'null', 'undefined') THEN '' ELSE trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) END AS text FROM conversations""")
def _(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", text.sanitize(F.col("text")).alias("text"))


@query("normal_form", r"""SELECT p_partkey, trim(regexp_replace(replace(replace(replace(upper(p_type), '.', ''), '-', ' '), '_', ' '), '\s+', ' ', 'g')) AS form FROM part""")
def _(spark, d):
    return _t(spark, d, "part").select("p_partkey", text.column_normal_form(F.col("p_type")).alias("form"))


@query("jaccard", """SELECT p_partkey, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END AS score FROM (
  SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM part)""")
def _(spark, d):
    a, b = (text.tokens(F.lower(c)) for c in ("p_name", "p_type"))
    return _t(spark, d, "part").select("p_partkey", text.jaccard(a, b).alias("score"))


@query("reverse_forms", """SELECT n_nationkey, array_to_string(list_reverse(string_split(n_name, ' ')), ' ') AS words, reverse(n_name) AS letters,
  array_to_string(list_transform(string_split(n_name, ' '), lambda w: reverse(w)), ' ') AS each_word FROM nation""")
def _(spark, d):
    n = F.col("n_name")
    return _t(spark, d, "nation").select("n_nationkey", text.reverse_words(n).alias("words"), F.reverse(n).alias("letters"), text.reverse_each_word(n).alias("each_word"))


@query("numeric_text", """SELECT p_partkey, p_retailprice AS price, NULL::DOUBLE AS name FROM part""")
def _(spark, d):
    price = F.concat(F.lit("₹ "), F.col("p_retailprice").cast("string"))
    return _t(spark, d, "part").select("p_partkey", text.numeric(price).alias("price"), text.numeric(F.col("p_name")).alias("name"))


@query("epic_normalize", """SELECT c_custkey, 'ABC' || lpad(c_custkey::VARCHAR, 7, '0') AS epic FROM customer""")
def _(spark, d):
    raw = F.concat(F.lit("ABC"), F.translate(F.lpad(F.col("c_custkey").cast("string"), 7, "0"), "01", "OI"))
    return _t(spark, d, "customer").select("c_custkey", text.epic_normalize(raw).alias("epic"))


@query("clean_filename", r"""SELECT n_nationkey, n_name AS stem FROM nation""")
def _(spark, d):
    raw = F.concat(F.format_string("AC%03d-", F.col("n_nationkey")), F.col("n_name"), F.lit("_modified"))
    return _t(spark, d, "nation").select("n_nationkey", text.file_stem(raw).alias("stem"))


@query("script_ratio", """SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE round(a / n::DOUBLE, 9) END AS share FROM (
  SELECT doc_id, length(regexp_replace(text, '[^\\p{L}\\p{M}]', '', 'g')) AS n, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS a FROM documents)""".replace("\\\\", "\\"))
def _(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.round(text.script_share(F.col("text"), "[A-Za-z]"), 9).alias("share"))


@query("header_filter", """SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
  WHERE NOT regexp_matches(line, '(?i)(licen[cs]e|rights reserved)') GROUP BY 1""")
def _(spark, d):
    lines = _t(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(~text.any_of(F.col("line"), ("(?i)licen[cs]e", "(?i)rights reserved"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("total_filter", """SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0""")
def _(spark, d):
    label = F.when(F.col("o_orderkey") % 3 == 0, "Grand Total").otherwise(F.col("o_orderkey").cast("string"))
    return _t(spark, d, "orders").where(~rows.is_total_row(F.array(label, F.lit("1")))).select("o_orderkey")


@query("preview_top10", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def _(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(10)


@query("top3", """SELECT o_custkey, o_orderkey, r::INT AS rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3""")
def _(spark, d):
    r = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return _t(spark, d, "orders").select("o_custkey", "o_orderkey", r.alias("rank")).where("rank <= 3")


@query("page_classify", """SELECT source AS doc_id, s AS text_share, CASE WHEN s >= 0.8 THEN 'text' WHEN s <= 0.2 THEN 'image' ELSE 'mixed' END AS kind FROM (
  SELECT source, avg(CASE WHEN n_chars >= 100 AND (cover < 0.7 OR n_chars > 500) THEN 1 ELSE 0 END)::DOUBLE AS s FROM (
    SELECT source, n_chars, (doc_id % 10) / 10.0 AS cover, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
  WHERE i % greatest(1, ceil(n / 5.0)::BIGINT) = 0 GROUP BY 1)""")
def _(spark, d):
    pages = _t(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "n_chars", ((F.col("doc_id") % 10) / 10.0).alias("image_cover"))
    return quality.classify_pages(pages)


@query("union_by_name", """SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_nationkey, NULL FROM supplier""")
def _(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    s = _t(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return merge.union_tables([c, s])


@query("set_symdiff", """WITH a AS (SELECT DISTINCT o_orderdate AS k FROM orders), b AS (SELECT DISTINCT l_shipdate AS k FROM lineitem)
  (SELECT k, 'left' AS side FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) UNION ALL (SELECT k, 'right' FROM (SELECT k FROM b EXCEPT SELECT k FROM a))""")
def _(spark, d):
    a, b = (_t(spark, d, name).select(F.col(c).alias("k")).distinct() for name, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate")))
    return merge.symmetric_difference(a, b)


@query("set_symdiff_all", """WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier)
  (SELECT k, 'left' AS side FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) UNION ALL (SELECT k, 'right' FROM (SELECT k FROM b EXCEPT SELECT k FROM a))""")
def _(spark, d):
    a = _t(spark, d, "customer").join(_t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_nationkey").alias("k")).distinct()
    return merge.symmetric_difference(a, _t(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).distinct())


@query("paginate", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 25 AS page FROM orders")
def _(spark, d):
    return merge.paginate(_t(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 25)


@query("label_argmax", """SELECT p_name AS header, CASE WHEN upper(p_name) = 'RED WIDGET' THEN 'red widget' WHEN contains(upper(p_name), 'RING') THEN 'ring' ELSE 'bolt' END AS label, 'part' AS kind,
  CASE WHEN upper(p_name) = 'RED WIDGET' THEN 1.0 ELSE 0.92 END::DOUBLE AS confidence FROM (SELECT DISTINCT p_name FROM part)
  WHERE upper(p_name) = 'RED WIDGET' OR contains(upper(p_name), 'RING') OR contains(upper(p_name), 'BOLT')""")
def _(spark, d):
    entries = spark.createDataFrame([(i, w, "part", [w.upper()], []) for i, w in enumerate(("red widget", "ring", "bolt"))], "pos int, label string, kind string, variants array<string>, abbreviations array<string>")
    return labels.match_labels(_t(spark, d, "part").select(F.col("p_name").alias("header")), entries, reversals=False)


@query("fuzzy_lookup")
def _(spark, d):
    nation = _t(spark, d, "nation")
    people = nation.select(F.lit("all").alias("constituency"), F.lit("p").alias("party"), F.initcap("n_name").alias("candidate"))
    asked = nation.select(F.concat(F.expr("substring(n_name, 1, length(n_name) - 1)"), F.lit("x")).alias("text"), F.lit("all").alias("constituency"))
    return lookup.candidates_in_constituency(asked, people)


@query("reversal_repair", "SELECT n_nationkey, 'POLLING STATION ' || n_name AS text FROM nation")
def _(spark, d):
    return _t(spark, d, "nation").select("n_nationkey", reversal.repaired(F.reverse(F.concat(F.lit("POLLING STATION "), "n_name"))).alias("text"))


@query("anchored_rows", """WITH RECURSIVE a(user_id, row, anchor) AS (
  SELECT user_id, 0, min(value) FROM events GROUP BY user_id
  UNION ALL
  SELECT a.user_id, a.row + 1, n.v FROM a, LATERAL (SELECT min(value) AS v FROM events e WHERE e.user_id = a.user_id AND abs(e.value - a.anchor) > 15 AND e.value > a.anchor) n
  WHERE n.v IS NOT NULL
)
SELECT a.user_id, a.row, a.anchor, count(*)::INT AS n FROM a JOIN events e ON e.user_id = a.user_id AND e.value >= a.anchor AND abs(e.value - a.anchor) <= 15 GROUP BY ALL""")
def _(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id", "value")
    return segment.anchored_rows(e, ["user_id"], "value", 15.0, ["event_id"]).select("user_id", "row", "anchor", F.size("items").alias("n"))


@query("greedy_nearest")
def _(spark, d):
    e = _t(spark, d, "events")
    base = e.select(F.col("user_id").cast("string").alias("doc_id"), F.lit(1).alias("page"), F.col("event_id").cast("int").alias("pos"), F.lit(0.0).alias("x"), F.col("value").alias("y"), "event_type")
    ids = base.where("event_type = 'purchase'").select("doc_id", "page", F.col("pos").cast("string").alias("epic"), "x", "y")
    return segment.greedy_nearest(base.where("event_type = 'click'").drop("event_type"), ids)


@query("validation_report", """WITH r AS (
  SELECT 't' || l_suppkey % 20 AS t, l_orderkey AS k, row_number() OVER (PARTITION BY l_suppkey % 20 ORDER BY l_orderkey) AS n FROM lineitem
), g AS (
  SELECT *, k - lag(k) OVER (PARTITION BY t ORDER BY n) AS gap, row_number() OVER (PARTITION BY t, k ORDER BY n) AS again FROM r
), c AS (
  SELECT t, count(*) AS n, count(*) FILTER (WHERE gap > 5) AS gaps, count(*) FILTER (WHERE again > 1) AS dups FROM g GROUP BY t
), i AS (
  SELECT t, 1 + (n < 30)::INT AS structure_warnings, (n > 500)::INT AS structure_infos, least(n, 10) + (n > 10)::INT AS type_errors,
    (gaps > 3)::INT AS gap_warnings, CASE WHEN gaps <= 3 THEN gaps ELSE 0 END AS gap_infos, CASE WHEN dups <= 5 THEN dups ELSE 1 END AS dup_errors FROM c
), s AS (
  SELECT *, greatest(0, 1 - 0.02::DOUBLE * structure_warnings - 0.01::DOUBLE * structure_infos) AS structure, greatest(0, 1 - 0.08::DOUBLE * type_errors) AS types,
    greatest(0, 1 - 0.02::DOUBLE * gap_warnings - 0.01::DOUBLE * gap_infos - 0.08::DOUBLE * dup_errors) AS consistency FROM i
), f AS (
  SELECT *, type_errors + dup_errors AS errors, 0.75::DOUBLE * 0.4 + (structure + types + consistency) / 3 * 0.4 + 0.5::DOUBLE * 0.2 AS confidence FROM s
)
SELECT t AS table_id, 'ocr' AS method, 0.0::DOUBLE AS empty_ratio, 0.5::DOUBLE AS type_consistency, round(structure, 6) AS structure, round(types, 6) AS types,
  round(consistency, 6) AS consistency, 0 AS criticals, errors, structure_warnings + gap_warnings AS warnings, structure_infos + gap_infos AS infos, round(confidence, 6) AS confidence,
  CASE WHEN confidence >= 0.95 AND errors = 0 THEN 'A' WHEN confidence >= 0.85 AND errors <= 1 THEN 'B' WHEN confidence >= 0.7 AND errors <= 3 THEN 'C' WHEN confidence >= 0.5 THEN 'D' ELSE 'F' END AS grade,
  confidence >= 0.5 AS passed FROM f""")
def _(spark, d):
    li = _t(spark, d, "lineitem")
    table = li.select(F.concat(F.lit("t"), (F.col("l_suppkey") % 20).cast("string")).alias("table_id"), F.lit(1).alias("page"), F.col("l_orderkey").cast("int").alias("row_idx"), F.array(F.col("l_orderkey").cast("string"), F.col("l_quantity").cast("string"), F.col("l_returnflag")).alias("cells"))
    heads = table.select("table_id").distinct().withColumn("headers", F.array(F.lit("Polling Station No."), F.lit("DMK votes"), F.lit("NOTA")))
    report = quality.validate(table, heads, heads.select("table_id", F.lit("ocr").alias("method")))[0]
    return report.withColumns({c: F.round(c, 6) for c in ("empty_ratio", "type_consistency", "structure", "types", "consistency", "confidence")})


from tabloom.plans import forms  # noqa: E402, F401  (adds its queries to the tables above)
