"""Queries of cards, sheets, summaries, sessions and voter blocks; imported by ``tabloom.plans.queries``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabloom.functions import house, text
from tabloom.operators import batches, cards, chains, headers, lookup, patterns, rolls, sheets, voters
from tabloom.plans.queries import _t, query
from tabloom.streaming import expiry

_GEOMETRY = """g AS (
  SELECT 'u' || user_id AS doc_id, (date_diff('day', DATE '2024-01-01', ts::DATE) // 7)::INT AS page, event_id AS k, value FROM events
), pages AS (
  SELECT DISTINCT doc_id, page FROM g
), rects AS (
  SELECT * FROM (SELECT doc_id, page, k % 3 * 100.0::DOUBLE AS x0, k % 9 * 40.0::DOUBLE AS top,
    k % 3 * 100.0::DOUBLE + value / 2 AS x1, k % 9 * 40.0::DOUBLE + 5 + k % 30 AS bottom FROM g)
  WHERE x1 - x0 BETWEEN 300.0::DOUBLE * 0.15::DOUBLE AND 150 AND bottom - top BETWEEN 400.0::DOUBLE * 0.035::DOUBLE AND 80
  QUALIFY count(*) OVER (PARTITION BY doc_id, page) >= 3
), e AS (
  SELECT doc_id, page, 'h' AS axis, (20 + 60 * (k % 6) + k % 4 * 0.5)::DOUBLE AS y, (100 * (k // 6 % 3) + k % 5)::DOUBLE AS lo,
    (100 * (k // 6 % 3) + k % 5 + 96 + k % 9)::DOUBLE AS hi FROM g ANTI JOIN rects USING (doc_id, page)
  UNION ALL
  SELECT doc_id, page, 'v', (100 * (k % 4) + k % 3 * 0.5)::DOUBLE, (20 + 60 * (k // 4 % 5))::DOUBLE, (80 + 60 * (k // 4 % 5))::DOUBLE
  FROM g ANTI JOIN rects USING (doc_id, page)
), lined AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id, page, axis ORDER BY y) AS line FROM (
    SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY doc_id, page, axis ORDER BY y) > 8 THEN 1 ELSE 0 END AS new FROM e)
), pos AS (
  SELECT doc_id, page, axis, line, avg(y) AS p FROM lined GROUP BY ALL
), span AS (
  SELECT *, lead(p) OVER w AS q, count(*) OVER (PARTITION BY doc_id, page, axis) AS n FROM pos WINDOW w AS (PARTITION BY doc_id, page, axis ORDER BY p)
), cell AS (
  SELECT v.doc_id, v.page, v.line AS col, h.line AS row, v.p AS x0, v.q AS x1, h.p AS top, h.q AS bottom
  FROM span v JOIN span h ON v.doc_id = h.doc_id AND v.page = h.page AND v.axis = 'v' AND h.axis = 'h'
  WHERE v.n >= 4 AND h.n >= 2 AND v.q IS NOT NULL AND h.q IS NOT NULL AND v.q - v.p >= 45 AND h.q - h.p >= 14
), island AS (
  SELECT doc_id, page, axis, line, min(lo) AS lo, max(hi) AS hi FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page, axis, line ORDER BY lo, hi) AS i FROM (
      SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY doc_id, page, axis, line ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 8
        THEN 1 ELSE 0 END AS fresh FROM lined)) GROUP BY doc_id, page, axis, line, i
), drawn AS (
  SELECT doc_id, page, x0, top, x1, bottom, 'rects' AS source, true AS closed FROM rects
  UNION ALL
  SELECT doc_id, page, x0, top, x1, bottom, 'lines', (SELECT count(*) = 4 FROM island i WHERE i.doc_id = c.doc_id AND i.page = c.page AND (
      i.axis = 'h' AND i.line IN (c.row, c.row + 1) AND i.lo <= c.x0 + 8 AND i.hi >= c.x1 - 8
      OR i.axis = 'v' AND i.line IN (c.col, c.col + 1) AND i.lo <= c.top + 8 AND i.hi >= c.bottom - 8))
  FROM cell c
), model AS (
  SELECT * FROM drawn QUALIFY count(*) OVER (PARTITION BY doc_id, page) >= 3
), learned AS (
  SELECT m.* FROM model m WHERE page = (SELECT min(page) FROM model x WHERE x.doc_id = m.doc_id)
), height AS (
  SELECT doc_id, page, avg(bottom - top) AS h FROM learned GROUP BY ALL HAVING avg(bottom - top) >= 10
), side AS (
  SELECT doc_id, avg(x) AS x0 FROM (
    SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY x) AS i FROM (
      SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY doc_id ORDER BY x) > 5 THEN 1 ELSE 0 END AS new
      FROM (SELECT doc_id, x0 AS x FROM learned UNION SELECT doc_id, x1 FROM learned))) GROUP BY doc_id, i
), wide AS (
  SELECT *, lead(x0) OVER (PARTITION BY doc_id ORDER BY x0) AS x1, count(*) OVER (PARTITION BY doc_id) AS n FROM side
), bare AS (
  SELECT p.doc_id, p.page, h, ceil((400 - h * 0.1) / h - 0.5)::INT AS n FROM (SELECT * FROM pages ANTI JOIN drawn USING (doc_id, page)) p
  JOIN height ON height.doc_id = p.doc_id AND p.page > height.page
), filled AS (
  SELECT doc_id, page, h * (k + 0.5) AS top, CASE WHEN k < n - 1 THEN h * (k + 1.5) ELSE least(h * (k + 1.5), 400) END AS bottom
  FROM (SELECT *, unnest(range(n)) AS k FROM bare) WHERE k < n - 1 OR h * (k + 1.5) <= 400 + h * 0.5
), cards AS (
  SELECT * FROM drawn
  UNION ALL SELECT f.doc_id, f.page, x0, top, x1, bottom, 'learned', NULL FROM filled f JOIN wide w ON w.doc_id = f.doc_id
  WHERE w.n >= 4 AND x1 IS NOT NULL AND x1 - x0 >= 45 AND bottom - top >= 14
)"""


def _boxes(spark, d):
    """Pages, rectangles and edges: each event draws one rectangle, one edge across and one down on its user's page of the week."""
    k, value = F.col("event_id"), F.col("value")
    e = _t(spark, d, "events").withColumns(
        {"doc_id": F.concat(F.lit("u"), F.col("user_id")), "page": (F.datediff("ts", F.lit("2024-01-01").cast("date")) / 7).cast("int")}
    )
    page = ["doc_id", "page"]

    def box(*sides):
        return e.select(*page, *[s.cast("double").alias(n) for s, n in zip(sides, ("x0", "top", "x1", "bottom"), strict=True)])

    left, top = k % 3 * 100.0, k % 9 * 40.0
    rects = box(left, top, left + value / 2, top + 5 + k % 30)
    y, start = 20 + 60 * (k % 6) + k % 4 * 0.5, 100 * ((k / 6).cast("long") % 3) + k % 5
    x, above = 100 * (k % 4) + k % 3 * 0.5, 20 + 60 * ((k / 4).cast("long") % 5)
    edges = box(start, y, start + 96 + k % 9, y).union(box(x, above, x, above + 60))
    return e.select(*page).distinct().withColumns({"width": F.lit(300.0), "height": F.lit(400.0)}), rects, edges


@query("card_boxes", f"""WITH {_GEOMETRY}
SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY round_even(top, 0), x0, top, x1, bottom) - 1)::INT AS card_idx,
  round(x0, 6) AS x0, round(top, 6) AS top, round(x1, 6) AS x1, round(bottom, 6) AS bottom, source, closed FROM cards""")
def _(spark, d):
    found = cards.card_boxes(*_boxes(spark, d))
    return found.select("doc_id", "page", "card_idx", *[F.round(c, 6).alias(c) for c in ("x0", "top", "x1", "bottom")], "source", "closed")


def _ladder_sql(rungs: int = 6) -> str:
    """A pass for each rung: what earlier rungs took goes by one anti-join on cards and ids."""
    steps = ["""c AS (
  SELECT l_orderkey % 97 AS doc, l_orderkey AS page, l_linenumber AS card, r AS rung, k::DOUBLE AS rank,
    CASE WHEN (l_partkey + r + k) % 3 > 0 THEN 'E' || (l_suppkey * (r + 1) + l_partkey * k + l_linenumber * l_linenumber * r) % 9 END AS epic
  FROM lineitem, range(6) a(r), range(2) b(k)
), t0 AS (
  SELECT doc, page, card, epic, rung FROM c WHERE false
)"""]
    for r in range(rungs):
        steps.append(f"""n{r} AS (
  SELECT doc, page, card, epic FROM c WHERE rung = {r} AND epic IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM t{r} t WHERE t.doc = c.doc AND t.page = c.page AND (t.card = c.card OR t.epic = c.epic))
  QUALIFY row_number() OVER (PARTITION BY doc, page, card ORDER BY rank, epic) = 1
), t{r + 1} AS (
  SELECT * FROM t{r} UNION ALL SELECT doc, page, min(card), epic, {r} FROM n{r} GROUP BY doc, page, epic
)""")
    return f"WITH {', '.join(steps)} SELECT doc::VARCHAR AS doc_id, page, card AS card_idx, epic, rung::INT AS rung FROM t{rungs}"


@query("id_ladder", _ladder_sql())
def _(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    li = li.withColumn("rung", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("rank", F.explode(F.array(F.lit(0.0), F.lit(1.0))))
    r, k, line = F.col("rung"), F.col("rank").cast("long"), F.col("l_linenumber")
    number = (F.col("l_suppkey") * (r + 1) + F.col("l_partkey") * k + line * line * r) % 9
    epic = F.when((F.col("l_partkey") + r + k) % 3 > 0, F.concat(F.lit("E"), number))
    found = li.select((F.col("l_orderkey") % 97).cast("string").alias("doc_id"), F.col("l_orderkey").alias("page"), line.alias("card_idx"), "rung", "rank", epic.alias("epic"))
    return cards.id_ladder(found)


@query("sheet_headers", """WITH n AS (
  SELECT l_orderkey AS t, max(l_linenumber) AS n FROM lineitem GROUP BY 1
), c AS (SELECT t, r, c, min(v) AS v FROM (
  SELECT l_orderkey AS t, unnest([1, 2, 3, 4]) AS r, l_linenumber + 1 AS c,
    unnest([l_returnflag, l_linestatus, 'S' || l_suppkey % 3, l_linenumber::VARCHAR]) AS v FROM lineitem
  UNION ALL SELECT t, 1, 1, 'No' FROM n UNION ALL SELECT t, 4, 1, '17' FROM n) GROUP BY ALL
), m AS (
  SELECT t, 1 AS r0, 2 AS c0, 1 AS r1, n + 1 AS c1 FROM n
  UNION ALL SELECT t, 1, 3, 2, 4 FROM n UNION ALL SELECT t, 1, 1, 3, 1 FROM n UNION ALL SELECT t, 2, 4, 3, 6 FROM n
), hit AS (
  SELECT r.t, r.r, k.c, m.r0, m.c0 FROM (SELECT DISTINCT t, r FROM c) r JOIN (SELECT DISTINCT t, c FROM c) k ON k.t = r.t
  JOIN m ON m.t = r.t AND r.r BETWEEN r0 AND r1 AND k.c BETWEEN c0 AND c1
  QUALIFY row_number() OVER (PARTITION BY r.t, r.r, k.c ORDER BY r0 DESC, c0 DESC, (r1 - r0 + 1) * (c1 - c0 + 1)) = 1
), x AS (
  SELECT coalesce(c.t, h.t) AS t, coalesce(c.r, h.r) AS r, coalesce(c.c, h.c) AS c, CASE WHEN h.t IS NULL THEN c.v ELSE s.v END AS v
  FROM c FULL JOIN hit h ON h.t = c.t AND h.r = c.r AND h.c = c.c LEFT JOIN c s ON s.t = h.t AND s.r = h.r0 AND s.c = h.c0
), filled AS (
  SELECT * FROM x WHERE v IS NOT NULL
), begun AS (
  SELECT t, coalesce(min(r) FILTER (WHERE one AND n >= 2), 1) AS first
  FROM (SELECT t, r, bool_or(c = 1) AS one, count(*) AS n FROM filled GROUP BY ALL) GROUP BY t
), block AS (
  SELECT b.t, first, coalesce(min(r), first + 1) AS data FROM begun b
  LEFT JOIN filled f ON f.t = b.t AND c = 1 AND r BETWEEN first + 1 AND first + 9 AND regexp_matches(v, '^[0-9]+$') GROUP BY b.t, first
), p AS (
  SELECT t, c, list(v ORDER BY r) AS p FROM (SELECT *, lag(v) OVER (PARTITION BY t, c ORDER BY r) AS b FROM filled JOIN block USING (t) WHERE r >= first AND r < data)
  WHERE b IS NULL OR b <> v GROUP BY ALL
), w AS (
  SELECT t, unnest(range(1, max(c) + 1)) AS c FROM filled GROUP BY t
)
SELECT t::VARCHAR AS table_id, c::INT AS col_idx, coalesce(array_to_string(p[-2:], ' - '), 'Column ' || c) AS header FROM w LEFT JOIN p USING (t, c)""")
def _(spark, d):
    li = _t(spark, d, "lineitem")
    t = F.col("l_orderkey").cast("string").alias("table_id")
    texts = F.array("l_returnflag", "l_linestatus", F.concat(F.lit("S"), F.col("l_suppkey") % 3), F.col("l_linenumber").cast("string"))
    body = li.select(t, F.posexplode(texts).alias("row_idx", "value"), (F.col("l_linenumber") + 1).cast("int").alias("col_idx"))
    n = li.groupBy(t).agg(F.max("l_linenumber").cast("int").alias("n"))
    first = n.selectExpr("table_id", "1 AS col_idx", "inline(array(struct(0, 'No'), struct(3, '17'))) AS (row_idx, value)")
    cells = body.unionByName(first).withColumn("row_idx", F.col("row_idx") + 1)
    ranges = "inline(array(struct(1, 2, 1, n + 1), struct(1, 3, 2, 4), struct(1, 1, 3, 1), struct(2, 4, 3, 6))) AS (r0, c0, r1, c1)"
    return sheets.header_paths(cells, n.selectExpr("table_id", ranges))


@query("level_totals", """WITH r AS (
  SELECT r_name, n_name, c_mktsegment, 3 - (grouping(r_name) + grouping(n_name) + grouping(c_mktsegment)) AS level, count(*) AS n_rows, sum(l_quantity) AS qty
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)
), g AS (
  SELECT *, CASE WHEN level > 1 THEN r_name END AS a, CASE WHEN level > 2 THEN n_name END AS b FROM r
)
SELECT g.r_name, g.n_name, g.c_mktsegment, g.level::INT AS level, g.n_rows, g.qty, round(g.qty / u.qty, 9) AS qty_share,
  rank() OVER (PARTITION BY g.level, g.a, g.b ORDER BY g.qty DESC)::INT AS qty_rank
FROM g LEFT JOIN r u ON u.level = g.level - 1 AND u.r_name IS NOT DISTINCT FROM g.a AND u.n_name IS NOT DISTINCT FROM g.b""")
def _(spark, d):
    li, o, c, n, r = (_t(spark, d, x) for x in ("lineitem", "orders", "customer", "nation", "region"))
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    out = sheets.level_totals(joined.withColumn("qty", F.col("l_quantity")), ["r_name", "n_name", "c_mktsegment"], ["qty"])
    return out.withColumn("qty_share", F.round("qty_share", 9))


@query("idle_sessions", """SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n_rows FROM (
  SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
    SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS fresh FROM events))
  GROUP BY user_id, s""")
def _(spark, d):
    return expiry.idle_sessions(_t(spark, d, "events"), ["user_id"], "ts")


#: What follows the size of a part in its invented house number.
_ENDINGS = ("l", "O", "S3", "/B", "-2lB", " Photo 6", " _- -", "&", " STREET", "B", "/l9l,SWETHAN", " - ")


@query("house_numbers", f"""WITH raw AS (
  SELECT p_partkey, lpad(p_size::VARCHAR, 3, '0') || [{", ".join(f"'{e}'" for e in _ENDINGS)}][(p_partkey % 12 + 1)::INT] AS raw FROM part
), a AS (
  SELECT *, regexp_replace(regexp_replace(raw, '^\\s+|\\s+$|[ .,;:]+$', '', 'g'), '^0+([0-9]+)$', '\\1') AS h FROM raw
), b AS (
  SELECT p_partkey, raw, replace(trim(regexp_replace(h, '(?i)\\s*Photo\\s+is.*$|\\s*Photo\\s*[0-9]*\\s*$', '', 'g')), '&', 'A') AS h FROM a
), c AS (
  SELECT p_partkey, raw, regexp_replace(regexp_replace(h, '[\\s_.;\\-]+$|^[\\s_.]+', '', 'g'), '\\s+[A-Za-z]{{3,}}.*$|,[A-Za-z]{{3,}}.*$', '', 'g') AS h FROM b
), d AS (
  SELECT *, regexp_extract_all(h, '[-/]|[^-/]+') AS p FROM c
)
SELECT p_partkey, raw, array_to_string(list_transform(p, lambda x, i: CASE
  WHEN x IN ('-', '/') OR i > 1 AND regexp_matches(x, '^[A-Za-z]$') THEN x
  WHEN i = len(p) AND regexp_matches(x, '[A-Z]$') AND NOT regexp_matches(x, '[{house.NO_SUFFIX}]$') AND regexp_matches(x[:-2], '[0-9{house.LOOK_ALIKE}]')
    THEN translate(x[:-2], '{house.LOOK_ALIKE}', '{house.DIGITS}') || x[-1:]
  ELSE translate(x, '{house.LOOK_ALIKE}', '{house.DIGITS}') END), '') AS house_no FROM d""")
def _(spark, d):
    ending = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("p_partkey") % 12 + 1).cast("int"))
    raw = _t(spark, d, "part").select("p_partkey", F.concat(F.lpad(F.col("p_size").cast("string"), 3, "0"), ending).alias("raw"))
    return raw.withColumn("house_no", house.clean_house_number(F.col("raw")))


@query("voter_blocks", """WITH RECURSIVE t AS (
  SELECT conv_id, turn, (conv_id + turn) % 7 AS k, 'W' || upper(regexp_replace(split_part(text, ' ', 1), '[^A-Za-z]', '', 'g')) AS w FROM conversations
), l AS (
  SELECT conv_id, turn, k, CASE k WHEN 0 THEN w WHEN 1 THEN 'Name: ' || w WHEN 2 THEN 'Father''s Name: ' || w WHEN 3 THEN w
    WHEN 4 THEN 'House No: ' || turn || 'lA' WHEN 5 THEN 'Age: ' || (10 + (conv_id * 7 + turn) % 95) || ' Gender: ' || ['Male', 'F', 'Other', 'x'][(turn % 4 + 1)::INT]
    ELSE 'ABC' || lpad((conv_id * 100 + turn)::VARCHAR, 7, '0') END AS text,
    sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS block FROM t
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, block ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id, block) AS n,
    regexp_extract(text, '^Name: (.*)$', 1) AS nm, regexp_extract(text, '^Father''s Name: (.*)$', 1) AS rl, regexp_extract(text, '^House No: (.*)$', 1) AS hs,
    regexp_extract(text, 'Age: ([0-9]+)', 1) AS ag, regexp_extract(text, 'Gender: (.*)$', 1) AS gd, regexp_extract(text, '[A-Z]{3}[0-9]{7}', 0) AS ep,
    NOT contains(text, ':') AS bare FROM l
), f(conv_id, block, i, n, serial, name, rel, house, age, gender, epic, loose, open) AS (
  SELECT DISTINCT conv_id, block, 0::BIGINT, n, max(CASE WHEN k = 0 THEN turn::VARCHAR ELSE '' END) OVER (PARTITION BY conv_id, block), '', '', '', '', '', '', '', '' FROM n
  UNION ALL
  SELECT f.conv_id, f.block, n.i, f.n, serial,
    CASE WHEN bare AND ep = '' AND open = 'name' THEN name || ' ' || text WHEN name = '' THEN nm ELSE name END,
    CASE WHEN bare AND ep = '' AND open = 'rel' THEN rel || ' ' || text WHEN rel = '' THEN rl ELSE rel END,
    CASE WHEN house = '' THEN hs ELSE house END, CASE WHEN age = '' THEN ag ELSE age END, CASE WHEN gender = '' THEN gd ELSE gender END,
    CASE WHEN epic = '' THEN ep ELSE epic END,
    CASE WHEN bare AND ep = '' AND open = '' AND loose = '' THEN text ELSE loose END,
    CASE WHEN bare AND ep = '' THEN open WHEN nm <> '' AND name = '' THEN 'name' WHEN rl <> '' AND rel = '' THEN 'rel' ELSE '' END
  FROM f JOIN n ON n.conv_id = f.conv_id AND n.block = f.block AND n.i = f.i + 1
)
SELECT conv_id, block, serial AS serial_no, CASE WHEN name = '' AND rel = '' THEN loose ELSE name END AS name, rel AS father_husband_name,
  CASE WHEN rel <> '' THEN 'F' ELSE '' END AS relation_type, replace(house, 'l', '1') AS house_no,
  CASE WHEN TRY_CAST(age AS INT) BETWEEN 18 AND 100 THEN age ELSE '' END AS age,
  CASE gender WHEN 'Male' THEN 'Male' WHEN 'F' THEN 'Female' WHEN 'Other' THEN 'Other' ELSE '' END AS gender, epic AS voter_id
FROM f WHERE i = n AND (name <> '' OR rel = '' AND loose <> '' OR epic <> '')""")
def _(spark, d):
    conv, turn = F.col("conv_id"), F.col("turn")
    k = (conv + turn) % 7
    w = F.concat(F.lit("W"), F.upper(F.regexp_replace(F.substring_index("text", " ", 1), "[^A-Za-z]", "")))
    gender = F.element_at(F.array(*map(F.lit, ("Male", "F", "Other", "x"))), (turn % 4 + 1).cast("int"))
    forms = (
        F.concat_ws(" ", turn.cast("string"), w),
        F.concat(F.lit("Name: "), w),
        F.concat(F.lit("Father's Name: "), w),
        w,
        F.concat(F.lit("House No: "), turn, F.lit("lA")),
        F.concat(F.lit("Age: "), 10 + (conv * 7 + turn) % 95, F.lit(" Gender: "), gender),
        F.concat(F.lit("ABC"), F.lpad((conv * 100 + turn).cast("string"), 7, "0")),
    )
    text = forms[-1]
    for i, form in enumerate(forms[:-1]):
        text = F.when(k == i, form).otherwise(text)
    lines = _t(spark, d, "conversations").select("conv_id", "turn", text.alias("text"))
    return voters.voters_from_lines(lines, ["conv_id"], "turn")


_CELLS = "[p_brand, p_type, p_size::VARCHAR, split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), {0}, {1}]"


@query("pattern_rows", f"""WITH r AS (
  SELECT 's' || l_suppkey AS table_id, l_orderkey AS row_idx, l_linenumber AS line, {_CELLS.format("l_returnflag", "l_linestatus")} AS c
  FROM lineitem JOIN part ON p_partkey = l_partkey
), p AS (
  SELECT DISTINCT {_CELLS.format("'R'", "'F'")} AS p FROM part WHERE p_size <= 2
), m AS (
  SELECT c, p, unnest(range(1, 8)) AS i FROM (SELECT DISTINCT c FROM r), p
), hit AS (
  SELECT DISTINCT c FROM (SELECT c, p, count(*) AS n, count(*) FILTER (WHERE lower(c[i]) = lower(p[i])) AS same FROM m
    WHERE (c[i] <> '' OR p[i] <> '') AND NOT regexp_matches(c[i], '^[0-9]+$') AND NOT regexp_matches(p[i], '^[0-9]+$') GROUP BY c, p) WHERE n >= 5 AND same >= 0.8 * n
)
SELECT table_id, row_idx, line FROM r ANTI JOIN hit USING (c)""")
def _(spark, d):
    part = _t(spark, d, "part")
    word = lambda c, n: F.split_part(c, F.lit(" "), F.lit(n))
    own = [F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string"), word(F.col("p_name"), 1), word(F.col("p_name"), 2)]
    joined = _t(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    rows = joined.select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("table_id"), F.lit(1).alias("page"), F.col("l_orderkey").alias("row_idx"), F.col("l_linenumber").alias("line"), F.array(*own, "l_returnflag", "l_linestatus").alias("cells"))
    heads = part.where("p_size <= 2").select(F.col("p_partkey").alias("pattern_id"), F.array(*own, F.lit("R"), F.lit("F")).alias("cells"))
    return patterns.drop_pattern_rows(rows, heads).select("table_id", "row_idx", "line")


@query("column_correction", """WITH c AS (
  SELECT p_brand AS table_id, p_partkey AS row_idx, unnest([0, 1, 2, 3]) AS col_idx,
    unnest([p_partkey::VARCHAR, replace(p_name, ' ', '  —  '), translate(p_size::VARCHAR, '01', 'Ol'), translate(p_size::VARCHAR, '158', 'ISB') || ' ']) AS v FROM part
), k AS (
  SELECT table_id, col_idx, avg((length(regexp_replace(v, '[^0-9]', '', 'g')) > length(v) * 0.5)::INT) > 0.5 OR col_idx = 3 AS num FROM c GROUP BY table_id, col_idx
), n AS (
  SELECT c.*, num OR length(regexp_replace(v, '[^0-9]', '', 'g')) > length(v) * 0.5 AS num FROM c JOIN k USING (table_id, col_idx)
)
SELECT table_id, row_idx, col_idx, num AS numeric, CASE WHEN num THEN CASE
    WHEN regexp_matches(translate(trim(v), 'OoIlSBZG', '00115826'), '^[0-9,. ]*$') THEN replace(translate(trim(v), 'OoIlSBZG', '00115826'), ' ', '')
    ELSE translate(trim(v), 'OoIlSBZG', '00115826') END
  ELSE trim(regexp_replace(replace(v, '—', '-'), '\\s+', ' ', 'g')) END AS value FROM n""")
def _(spark, d):
    size = F.col("p_size").cast("string")
    values = F.array(F.col("p_partkey").cast("string"), F.replace("p_name", F.lit(" "), F.lit("  —  ")), F.translate(size, "01", "Ol"), F.concat(F.translate(size, "158", "ISB"), F.lit(" ")))
    cells = _t(spark, d, "part").select(F.col("p_brand").alias("table_id"), F.lit(1).alias("page"), F.col("p_partkey").alias("row_idx"), F.posexplode(values).alias("col_idx", "value"))
    heads = cells.select("table_id").distinct().select("table_id", F.lit(3).alias("col_idx"), F.lit("Station").alias("header"))
    return patterns.correct_by_column(cells, heads).drop("page")


@query("sample_check", """WITH c AS (
  SELECT o_orderpriority AS t, o_orderkey AS k, floor(o_totalprice)::BIGINT AS v, md5('|' || o_orderpriority || '|1|' || o_orderkey || '|0') AS h, o_custkey, o_orderstatus FROM orders
), s AS (
  SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY t, ('0x' || substr(h, 1, 8))::BIGINT % 64 ORDER BY h) = 1
)
SELECT t AS table_id, count(*) AS n_sampled, count(*) FILTER (WHERE o_orderstatus <> 'P' AND o_custkey % 5 > 0) AS n_equal,
  count(*) FILTER (WHERE o_orderstatus <> 'P' AND o_custkey % 5 = 0) AS n_differ, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_missing,
  count(*) FILTER (WHERE o_orderstatus <> 'P' AND o_custkey % 5 > 0) / count(*) AS accuracy FROM s GROUP BY t""")
def _(spark, d):
    o = _t(spark, d, "orders")
    place = [F.col("o_orderpriority").alias("table_id"), F.lit(1).alias("page"), F.col("o_orderkey").alias("row_idx"), F.lit(0).alias("col_idx")]
    value = F.floor("o_totalprice").cast("string")
    source = o.where("o_orderstatus <> 'P'").select(*place, F.when(F.col("o_custkey") % 5 > 0, value).otherwise("?").alias("value"))
    return patterns.sample_accuracy(o.select(*place, value.alias("value")), source)


@query("deal_files", """WITH f AS (
  SELECT doc_id, n_chars, CASE WHEN n_chars >= 1000 THEN 'text' ELSE 'scan' END AS kind, (('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 8)::INT AS lane FROM documents
), c AS (
  SELECT *, floor(coalesce(sum(n_chars) OVER (PARTITION BY lane, kind ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 20000)::BIGINT AS cut FROM f
)
SELECT doc_id, kind, lane, cut + CASE WHEN kind = 'scan' THEN coalesce(max(CASE WHEN kind = 'text' THEN cut + 1 END) OVER (PARTITION BY lane), 0) ELSE 0 END AS task FROM c""")
def _(spark, d):
    files = _t(spark, d, "documents").select("doc_id", F.col("n_chars").alias("size"), F.when(F.col("n_chars") >= 1000, "text").otherwise("scan").alias("kind"))
    return batches.deal_files(files, 20_000, lanes=8).drop("size")


@query("chunked_calls", "SELECT DISTINCT text AS value, replace(text, 'e', '3') AS answer FROM conversations WHERE trim(text) <> ''")
def _(spark, d):
    return batches.ask_in_calls(_t(spark, d, "conversations"), "text", lambda text: text.replace("e", "3"), most=20_000)


_PAGES = """n AS (
  SELECT o_orderpriority AS t, (o_custkey % 10)::INT AS page, o_orderkey AS k, o_custkey AS c, o_orderstatus AS s,
    row_number() OVER (PARTITION BY o_orderpriority, o_custkey % 10 ORDER BY o_orderkey) AS row FROM orders
), h AS (
  SELECT t, page, unnest(names) AS name, generate_subscripts(names, 1) - 1 AS col FROM (SELECT DISTINCT t, page,
    CASE page WHEN 3 THEN ['Polling Station', 'DMK Votes', 'Remarks', 'Total of valid votes', 'NOTA'] WHEN 5 THEN ['NOTA', 'Polling Station', 'Total of valid votes']
      WHEN 8 THEN ['polling station', 'Total of valid votes', 'DMK Votes', 'NOTA'] ELSE ['Polling Station', 'DMK Votes', 'Total of valid votes', 'NOTA'] END AS names FROM n)
), d AS (
  SELECT h.t, h.page, row, h.col, CASE lower(name) WHEN 'polling station' THEN k WHEN 'dmk votes' THEN c WHEN 'nota' THEN 100 + c % 7 WHEN 'remarks' THEN 5 ELSE k + 1000 END::VARCHAR AS v, name
  FROM n JOIN h ON h.t = n.t AND h.page = n.page
)"""


def _table_pages(spark, d):
    """Tables of ten pages; each page has a header row, three of them with other columns, and then a row for each order."""
    o = _t(spark, d, "orders").withColumns({"page": (F.col("o_custkey") % 10).cast("int"), "table_id": F.col("o_orderpriority")})
    k, c, page = F.col("o_orderkey"), F.col("o_custkey"), F.col("page")
    station, dmk, nota, total, remark = k, c, 100 + c % 7, k + 1000, F.lit(5)
    names = ("Polling Station", "DMK Votes", "Total of valid votes", "NOTA")

    def by_page(three, five, eight, other):
        cell = lambda xs: F.array(*[x.cast("string") for x in xs])
        return F.when(page == 3, cell(three)).when(page == 5, cell(five)).when(page == 8, cell(eight)).otherwise(cell(other))

    lit = [F.lit(x) for x in names]
    heads = by_page([lit[0], lit[1], F.lit("Remarks"), lit[2], lit[3]], [lit[3], lit[0], lit[2]], [F.lit("polling station"), lit[2], lit[1], lit[3]], lit)
    body = by_page([station, dmk, remark, total, nota], [nota, station, total], [station, total, dmk, nota], [station, dmk, total, nota])
    row = F.row_number().over(W.partitionBy("table_id", "page").orderBy("o_orderkey"))
    first = o.select("table_id", "page").distinct().select("table_id", "page", F.lit(0).alias("row_idx"), heads.alias("cells"))
    return first.union(o.select("table_id", "page", row.alias("row_idx"), body.alias("cells")))


@query("table_chain", f"""WITH {_PAGES}, m AS (
  SELECT t, any_value(name) AS name, row_number() OVER (PARTITION BY t ORDER BY avg(col), name) - 1 AS pos FROM h
  GROUP BY t, name HAVING count(DISTINCT page) >= 5
)
SELECT r.t AS table_id, r.page, r.row::INT AS row_idx, m.pos::INT AS pos, m.name AS header, coalesce(d.v, '') AS value
FROM (SELECT DISTINCT t, page, row FROM n) r JOIN m ON m.t = r.t LEFT JOIN d ON d.t = r.t AND d.page = r.page AND d.row = r.row AND lower(d.name) = lower(m.name)""")
def _(spark, d):
    master, rows = chains.merged_table(_table_pages(spark, d))
    cells = rows.select("table_id", "page", "row_idx", F.posexplode("cells").alias("pos", "value"))
    return cells.join(master.select("table_id", "pos", "header"), ["table_id", "pos"]).select("table_id", "page", "row_idx", "pos", "header", "value")


@query("station_table", """SELECT o_orderpriority AS table_id, o_orderkey AS station, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_custkey + 9 + o_orderkey % 2 END AS stated,
  o_custkey + 9 AS computed, o_orderstatus <> 'O' AND o_orderkey % 2 = 0 AS valid FROM orders""")
def _(spark, d):
    o = _t(spark, d, "orders")
    stated = F.when(F.col("o_orderstatus") == "O", F.lit("n/a")).otherwise((F.col("o_custkey") + 9 + F.col("o_orderkey") % 2).cast("string"))
    cells = F.array(F.lit("1"), F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.lit("9"), F.lit("x"), F.lit("77"), stated)
    body = o.select(F.col("o_orderpriority").alias("table_id"), F.lit(1).alias("page"), (F.col("o_orderkey") + 1).alias("row_idx"), cells.alias("cells"))
    names = F.array(*map(F.lit, ("Sl. No.", "Polling  Station", "RAMAN (DMK)", "NOTA", "KUMAR (BJP)", "Rejected", "TOTAL VALID VOTES")))
    rest = F.array(F.lit("TOTAL"), F.lit(""), F.lit("9"))
    tables = body.select("table_id").distinct()
    extra = tables.select("table_id", F.lit(0).alias("page"), F.lit(0).cast("long").alias("row_idx"), names.alias("cells")).union(tables.select("table_id", F.lit(9), F.lit(0).cast("long"), rest))
    return chains.station_table(body.union(extra))[1].select("table_id", "station", "stated", "computed", "valid")


@query("table_verification", """SELECT o_orderpriority AS table_id, 3 AS n_columns, count(*) AS n_rows, count(*) FILTER (WHERE o_orderkey % 10 = 0) AS n_wrong_width,
  count(*) FILTER (WHERE o_orderstatus = 'P') AS n_header_like, count(*) FILTER (WHERE o_orderstatus <> 'P' AND o_custkey % 8 = 0) AS n_empty,
  count(*) FILTER (WHERE o_orderkey % 10 = 0) + count(*) FILTER (WHERE o_orderstatus = 'P') AS n_errors,
  CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'P') > 0 THEN 'warning' ELSE 'success' END AS status FROM orders GROUP BY 1""")
def _(spark, d):
    o = _t(spark, d, "orders")
    first = F.when(F.col("o_orderstatus") == "P", "Polling Station").when(F.col("o_custkey") % 8 == 0, " ").otherwise(F.col("o_orderkey").cast("string"))
    rest = F.when(F.col("o_orderkey") % 10 == 0, F.array(F.lit(""))).otherwise(F.array(F.lit(""), F.lit(None).cast("string")))
    rows = o.select(F.col("o_orderpriority").alias("table_id"), F.concat(F.array(first), rest).alias("cells"))
    heads = rows.select("table_id").distinct().withColumn("headers", F.array(*map(F.lit, ("a", "b", "c"))))
    return chains.verification(rows, heads)


@query("mapping_coverage", """WITH h AS (SELECT DISTINCT p_name AS h FROM part WHERE p_name <> ''), m AS (SELECT DISTINCT p_name AS h FROM part WHERE p_size > 25)
SELECT count(*) AS n_headers, count(m.h) AS n_mapped, count(m.h) / count(*) AS coverage, least(count(m.h) / count(*), 0.95::DOUBLE) AS confidence FROM h LEFT JOIN m USING (h)""")
def _(spark, d):
    part = _t(spark, d, "part")
    mapping = part.where("p_size > 25").select(F.col("p_brand").alias("standard"), F.col("p_name").alias("variant"))
    return chains.mapping_coverage(part.select(F.col("p_name").alias("header")), mapping)


@query("title_lines", """WITH w AS (
  SELECT doc_id, string_split(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), chr(10))[1:13] AS l, doc_id % 3 AS k FROM documents
), l AS (
  SELECT doc_id, list_concat(['FORM 20', 'General  Election ' || doc_id], CASE WHEN k = 0 THEN ['Sl. No. Polling Station'] ELSE [] END, l) AS l FROM w
), e AS (
  SELECT doc_id, i, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS x FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM l) WHERE i <= 15
), c AS (
  SELECT *, coalesce(bool_or(regexp_matches(x, '(?i)sl\\.|polling station')) OVER (PARTITION BY doc_id ORDER BY i), false) AS over FROM e
)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS line_no, x AS title FROM c
WHERE NOT over AND regexp_matches(x, '(?i)form\\s*20|final\\s*result\\s*sheet|election|lok\\s*sabha|assembly|constituency|electors?|total\\s*no\\.?\\s*of')""")
def _(spark, d):
    docs = _t(spark, d, "documents")
    head = F.concat(F.lit("FORM 20\nGeneral  Election "), F.col("doc_id"), F.when(F.col("doc_id") % 3 == 0, F.lit("\nSl. No. Polling Station")).otherwise(""), F.lit("\n"))
    body = F.trim(F.coalesce("text", F.lit("")), F.lit(" \t\r\n"))
    return chains.document_titles(docs.select("doc_id", F.lit(1).alias("page"), F.concat(head, body).alias("text")))


#: What stands around a part's name in its invented header cell, and the words before it.
_TAILS = (" (DMK)", " (CPI(M))", "", " votes", "  ( BJP )", " வாக்குகள்", ". (x) y")
_HEADS = ("Dr. ", "Mr. Adv. ", "", "K. ", "s r ", "1,250 ", "-12.5", "ABC1234567 ")


@query("cell_texts", f"""WITH c AS (
  SELECT p_partkey, p_size, p_brand, p_name, [{", ".join(f"'{x}'" for x in _HEADS)}][(p_partkey % 8 + 1)::INT] || p_name || [{", ".join(f"'{x}'" for x in _TAILS)}][(p_partkey % 7 + 1)::INT] AS t,
    [p_size::VARCHAR, p_size || ',' || lpad(p_partkey::VARCHAR, 3, '0'), p_size || '.50', p_name, '-' || p_size || '.0'][(p_partkey % 5 + 1)::INT] AS cell FROM part
), x AS (
  SELECT *, regexp_replace(t, '^(?i:(?:(?:{text.TITLES})\\.*(?:\\s+|$))+)', '') AS untitled, TRY_CAST(replace(cell, ',', '') AS DOUBLE) AS num,
    list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '') AS words, length(regexp_replace(t, '[^\\p{{L}}\\p{{M}}]', '', 'g')) AS letters FROM c
)
SELECT p_partkey, t, cell,
  CASE WHEN regexp_extract(t, '\\(([^()]+(?:\\([A-Z]\\))?)\\)\\s*$', 1) <> '' THEN trim(regexp_extract(t, '\\(([^()]+(?:\\([A-Z]\\))?)\\)\\s*$', 1)) END AS party,
  trim(regexp_replace(regexp_replace(regexp_replace(upper(t), '\\bVOTES?\\b', '', 'g'), '[.]', '', 'g'), '\\s+', ' ', 'g')) AS party_form,
  trim(regexp_replace(untitled, '(?i)(?:(?:^|\\s+)(?:{text.TITLES})\\.*)+$', '')) AS untitled,
  array_to_string(list_filter(words, lambda w: length(replace(w, '.', '')) <= 1) || list_filter(words, lambda w: length(replace(w, '.', '')) > 1), ' ') AS turned,
  regexp_matches(regexp_replace(upper(p_brand || t), '[^\\p{{L}}]', '', 'g'), '[B-DF-HJ-NP-TV-Z]{{4}}') AS cluster,
  coalesce(TRY_CAST(regexp_extract(replace(t, ',', ''), '^\\s*([-+]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+))', 1) AS DOUBLE), 0) AS leading,
  CASE WHEN num IS NULL THEN cell WHEN num = floor(num) THEN num::BIGINT::VARCHAR ELSE num::VARCHAR END AS typed,
  left(regexp_replace(t || '[a]:b*?/', '[\\[\\]:*?/\\\\]', '_', 'g'), 31) AS sheet, md5(t || chr(31) || p_brand) AS cache_key,
  CASE WHEN letters > 0 THEN (letters - length(regexp_replace(regexp_replace(t, '[^\\p{{L}}\\p{{M}}]', '', 'g'), '[\\x{{0B80}}-\\x{{0BFF}}]', '', 'g'))) / letters ELSE 0 END AS tamil,
  regexp_matches(t, '\\p{{L}}') AS translate, [x for x in regexp_extract_all(t, '[A-Z]{{3}}[0-9]{{7}}')] AS epics,
  CASE p_partkey % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'F' END AS relation, CASE p_partkey % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN '' ELSE 'O' END AS gender,
  CASE WHEN p_partkey % 2 = 0 AND p_size IN (11, 22, 33, 44) THEN p_size // 11 ELSE p_size END::INT AS entry, p_name AS location,
  ['[' || p_size % 3 || '] ' || p_name, '[' || (p_size % 3 + 1) || '] ' || p_brand] AS areas
FROM x""")
def _(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    part = _t(spark, d, "part")
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (key % n + 1).cast("int"))
    t = F.concat(pick(_HEADS, 8), "p_name", pick(_TAILS, 7))
    cell = F.element_at(F.array(size, F.concat(size, F.lit(","), F.lpad(key.cast("string"), 3, "0")), F.concat(size, F.lit(".50")), F.col("p_name"), F.concat(F.lit("-"), size, F.lit(".0"))), (key % 5 + 1).cast("int"))
    place = F.concat("p_name", F.lit(" ["), (F.col("p_size") % 3 + 1).cast("string"), F.lit("] - "), "p_brand", F.lit(" ; ["), (F.col("p_size") % 3).cast("string"), F.lit("]  "), "p_name")
    label = pick(("Husband's Name", "Father Name", "Spouse"), 3)
    rows = part.withColumns({"t": t, "cell": cell, "place": place})
    return rows.select(
        "p_partkey", "t", "cell", text.party_in_cell(F.col("t")).alias("party"), text.party_normal_form(F.col("t")).alias("party_form"), text.strip_titles(F.col("t")).alias("untitled"),
        text.initials_first(F.col("t")).alias("turned"), text.consonant_cluster(F.concat("p_brand", "t")).alias("cluster"), text.leading_number(F.col("t")).alias("leading"),
        text.typed_number(F.col("cell")).alias("typed"), text.sheet_name(F.concat("t", F.lit("[a]:b*?/"))).alias("sheet"), text.cache_key(F.col("t"), F.col("p_brand")).alias("cache_key"),
        text.script_share(F.col("t")).alias("tamil"), text.should_translate(F.col("t")).alias("translate"), text.epics(F.col("t")).alias("epics"), text.relation_type(label).alias("relation"),
        text.gender(pick((" male ", "F", "", "x"), 4)).alias("gender"), text.entry_number(size, key % 2 == 0).alias("entry"), text.location_part(F.col("place")).alias("location"), text.areas(F.col("place")).alias("areas"),
    )


_SECTION_CASES = " ".join(f"WHEN part BETWEEN {lo} AND {hi} THEN ['{name}', '{lookup.SECTIONS_TAMIL[name]}']" for lo, hi, name in lookup.SECTIONS)


@query("roll_merge", f"""WITH c AS (
  SELECT *, c_nationkey AS file, c_custkey % 4 AS booth, c_nationkey * 4 + c_custkey % 4 + 60 AS part,
    row_number() OVER (PARTITION BY c_nationkey, c_custkey % 4 ORDER BY c_custkey) + 6 AS row FROM customer
), m AS (
  SELECT *, CASE {_SECTION_CASES} ELSE ['', ''] END AS section, (140 + file % 3)::VARCHAR AS ac FROM c
)
SELECT row_number() OVER (ORDER BY ac::INT, part, file::VARCHAR, booth, row) AS "Serial No", c_name AS voter_name, c_name AS voter_name_tamil, c_mktsegment AS relation_name,
  c_mktsegment AS relation_name_tamil, 'F' AS relation_type, 'ABC' || lpad(c_custkey::VARCHAR, 7, '0') AS epic_number, 'Male' AS gender, '' AS age, c_custkey || 'A' AS house_number,
  '' AS street_name, section[1] AS section_name, section[2] AS section_name_tamil, part::VARCHAR AS part_number, ac AS ac_number, '' AS district_code FROM m""")
def _(spark, d):
    c = _t(spark, d, "customer")
    file, booth = F.col("c_nationkey"), F.col("c_custkey") % 4
    part, ac = (file * 4 + booth + 60).cast("string"), (140 + file % 3).cast("string")
    # one way to tell the numbers for each kind of sheet: in the label's cell, beside the label, in the title
    sheet = F.when(booth == 2, F.concat_ws("", F.lit("AC "), ac, F.lit(" - "), part)).otherwise(F.concat(F.lit("Booth "), booth.cast("string")))
    c = c.withColumn("row", F.row_number().over(W.partitionBy("c_nationkey", booth).orderBy("c_custkey")) + 6)
    row = F.col("row")
    values = F.array(row.cast("string"), "c_name", "c_mktsegment", F.lit("F"), F.concat(F.col("c_custkey"), F.lit("A")), F.lit(None).cast("string"), F.lit("Male"), F.concat(F.lit("ABC"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")))
    at = [file.cast("string").alias("table_id"), sheet.alias("sheet")]
    body = c.select(*at, row.alias("row_idx"), F.posexplode(values).alias("col_idx", "value")).withColumn("col_idx", F.col("col_idx") + 1)
    first = c.groupBy("c_nationkey", booth.alias("booth")).agg(F.first(sheet).alias("sheet"), F.first(part).alias("part"), F.first(ac).alias("ac"))
    told = F.when(F.col("booth") < 2, F.concat(F.lit("AC No : "), "ac")).otherwise("Roll")
    label = F.when(F.col("booth") == 0, F.concat(F.lit("Booth No: "), "part")).when(F.col("booth").isin(1, 3), F.lit("Booth No")).otherwise("x")
    meta = F.array(F.struct(F.lit(1), F.lit(1), told), F.struct(F.lit(2), F.lit(1), label), F.struct(F.lit(2), F.lit(4), F.when(F.col("booth").isin(1, 3), F.col("part"))), F.struct(F.lit(3), F.lit(1), F.when(F.col("booth") == 3, "AC No")),
                   F.struct(F.lit(3), F.lit(4), F.when(F.col("booth") == 3, F.col("ac"))), F.struct(F.lit(5), F.lit(1), F.lit("Serial No")), F.struct(F.lit(6), F.lit(1), F.lit("வ.எண்")))
    heads = first.select(F.col("c_nationkey").cast("string").alias("table_id"), "sheet", F.inline(meta).alias("row_idx", "col_idx", "value"))
    extra = first.select(F.col("c_nationkey").cast("string"), F.lit("Summary"), F.lit(9), F.lit(2), F.lit("no voter")).distinct()
    return rolls.merge_rolls(body.union(heads).union(extra))


@query("standard_headers", """WITH h AS (
  SELECT p_brand AS t, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INT AS col, CASE p_partkey % 5 WHEN 0 THEN p_name || ' (IND)' WHEN 1 THEN p_name || ' ( dmk )'
    WHEN 2 THEN p_name WHEN 3 THEN 'Total Votes' END AS header, p_partkey % 5 AS k FROM part
)
SELECT t AS table_id, col AS col_idx, CASE k WHEN 0 THEN 'IND_' || count(*) FILTER (WHERE k = 0) OVER (PARTITION BY t ORDER BY col) WHEN 1 THEN 'DMK' WHEN 2 THEN header
  WHEN 3 THEN 'TOTAL VOTES' ELSE 'Column_' || col END AS standard, k < 2 AS is_party FROM h""")
def _(spark, d):
    part = _t(spark, d, "part")
    at = F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")) - 1
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, F.concat("p_name", F.lit(" (IND)"))).when(k == 1, F.concat("p_name", F.lit(" ( dmk )"))).when(k == 2, F.col("p_name")).when(k == 3, F.lit("Total Votes"))
    named = part.select(F.col("p_brand").alias("table_id"), at.alias("col_idx"), name.alias("header"))
    return headers.standard_headers(named).drop("header")


@query("fold_positions", """WITH h AS (
  SELECT c_nationkey AS t, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INT AS col, c_name AS header, c_mktsegment AS party FROM customer
), g AS (
  SELECT *, CASE WHEN party IN ('BUILDING', 'MACHINERY') OR party = 'HOUSEHOLD' AND count(*) FILTER (WHERE party IN ('BUILDING', 'MACHINERY')) OVER (PARTITION BY t) > 0 THEN 'HOUSEHOLD' END AS grp FROM h
), n AS (
  SELECT *, min(CASE WHEN party = 'HOUSEHOLD' THEN col END) OVER (PARTITION BY t, grp) AS lead, CASE WHEN grp IS NULL THEN col ELSE min(col) OVER (PARTITION BY t, grp) END AS first FROM g
)
SELECT n.t::VARCHAR AS table_id, n.col AS col_idx, (dense_rank() OVER (PARTITION BY n.t ORDER BY n.grp IS NULL, n.first) - 1)::INT AS new_idx,
  CASE WHEN n.grp IS NULL THEN n.header ELSE coalesce(m.header, 'HOUSEHOLD Votes') END AS new_header FROM n LEFT JOIN h m ON m.t = n.t AND m.col = n.lead AND n.grp IS NOT NULL""")
def _(spark, d):
    c = _t(spark, d, "customer")
    at = F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    named = c.select(F.col("c_nationkey").cast("string").alias("table_id"), at.alias("col_idx"), F.col("c_name").alias("header"), F.col("c_mktsegment").alias("party"))
    return headers.fold_positions(named, spark.createDataFrame([("HOUSEHOLD", "BUILDING"), ("HOUSEHOLD", "MACHINERY")], "main string, ally string"))
