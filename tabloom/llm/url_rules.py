"""Association-rule URL filtering with DataFrame functions and Spark's FP-growth.

Labelled pages become transactions of URL tokens; FP-growth mines the frequent token combinations and those that
imply the bad label with enough confidence and lift become rules.  A rule is filed under its rarest token in an
inverted index; a URL looks up its own tokens there and a candidate fires when the URL holds all its tokens.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import LOWER, UPPER

#: Fixed (action, host, path) rules of the production query.
HOST_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
BAD = "label=bad"
#: Up to this many index rows are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 50_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = HOST_RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, else nulls; a rule fits its host and all subdomains."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def url_tokens(url: Column) -> Column:
    """The different alphabetic tokens of a URL; those of the host are marked apart from the rest."""
    low = F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER)
    host = F.regexp_extract(low, "(?s)^.*?://([^/?#]*)", 1)
    rest = F.regexp_extract(low, "(?s)^.*?://[^/?#]*(.*)", 1)

    def marked(text: Column, mark: str) -> Column:
        words = F.filter(F.split(text, "[^a-z0-9]+"), lambda t: t.rlike("[a-z]"))
        return F.transform(words, lambda t: F.concat(F.lit(mark), t))

    return F.array_distinct(F.concat(marked(host, "h:"), marked(rest, "p:")))


def mine_rules(
    labelled: DataFrame,
    min_support: float = 0.002,
    min_pages: int = 8,
    min_confidence: float = 0.4,
    min_lift: float = 1.5,
    max_tokens: int = 3,
) -> DataFrame:
    """Rules ``(tokens, n_pages, n_bad, confidence, lift)`` from rows with ``tokens`` and ``bad`` (boolean).

    Support counts pages that have all tokens and the bad label: at least ``min_support`` of the labelled pages and
    ``min_pages`` of them.  Tokens are sorted.  With no labelled page there is no rule.
    """
    spark = labelled.sparkSession
    n, n_bad = labelled.agg(F.count(F.lit(1)), F.sum(F.col("bad").cast("long"))).first()
    schema = "tokens array<string>, n_pages bigint, n_bad bigint, confidence double, lift double"
    if not n or not n_bad:
        return spark.createDataFrame([], schema)
    least = max(min_support * n, min_pages)
    if least > n_bad:
        return spark.createDataFrame([], schema)
    baskets = labelled.select(
        F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items")
    )
    sets = FPGrowth(itemsCol="items", minSupport=least / n, minConfidence=1.0).fit(baskets).freqItemsets
    both = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1) & (F.size("items") <= max_tokens + 1)).select(
        F.array_sort(F.array_remove("items", BAD)).alias("tokens"), F.col("freq").alias("n_bad")
    )
    alone = sets.where(~F.array_contains("items", BAD)).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("n_pages"))
    rules = both.join(alone, "tokens").select(
        "tokens", "n_pages", "n_bad", (F.col("n_bad") / F.col("n_pages")).alias("confidence"),
        (F.col("n_bad") * F.lit(n) / (F.col("n_pages") * F.lit(n_bad))).alias("lift"),
    )
    return rules.where((F.col("n_bad") >= least) & (F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift))


def match_rules(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """(url, best rule) of every different URL that a rule matches: the most confident, then most frequent, then last by name."""
    single = rules.select(F.explode("tokens").alias("_key"), "n_pages").groupBy("_key").agg(F.min("n_pages").alias("_seen"))
    rarest = rules.select("*", F.explode("tokens").alias("_key")).join(single, "_key")
    index = rarest.groupBy("tokens", "confidence", "n_bad").agg(F.min(F.struct("_seen", "_key"))["_key"].alias("_key"))
    index = index.withColumnRenamed("tokens", "_rule")
    if index.count() <= BROADCAST_ROWS:
        index = F.broadcast(index)
    posts = urls.select(url_col).where(F.col(url_col).isNotNull()).distinct().withColumn("_tokens", url_tokens(F.col(url_col)))
    hits = posts.select(url_col, "_tokens", F.explode("_tokens").alias("_key")).join(index, "_key")
    hits = hits.where(F.size(F.array_except("_rule", "_tokens")) == 0)
    best = F.max(F.struct("confidence", "n_bad", F.array_join("_rule", " ").alias("mined_rule")))
    return hits.groupBy(url_col).agg(best.alias("_b")).select(
        url_col, F.col("_b.mined_rule").alias("mined_rule"), F.col("_b.confidence").alias("mined_confidence")
    )


def filter_urls(
    pages: DataFrame,
    labels: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    label_id: str = "doc_id",
    host_rules: Sequence[tuple[str, str, str]] = HOST_RULES,
    **mining,
) -> DataFrame:
    """Judge every row of ``pages``: the longest host rule decides, else the mined rules, else it is allowed.

    ``labels`` has ``label_id, quality, toxic``; a page is bad when its label says quality 0 or toxic 1, and pages
    without a label (or with null marks) teach nothing.  Returns the input columns with ``host, path, rule, verdict,
    mined_rule, mined_confidence``; columns of these names are replaced.  A null URL has empty host and path, no
    tokens and is allowed.  Other columns may bear any other name (``bad``, ``tokens``, ``confidence``).  Repeated pages
    and repeated labels stay, and each pair of them counts as a labelled page.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "mined_rule", "mined_confidence")
    marks = labels.select(F.col(label_id).alias("_label_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    # other columns of the pages may bear any name, so only the two that are needed meet the labels
    known = pages.select(F.col(id_col).alias("_page_id"), F.col(url_col).alias("_page_url"))
    taught = known.join(marks.where("bad IS NOT NULL"), F.col("_page_id") == F.col("_label_id")).select(
        url_tokens(F.col("_page_url")).alias("tokens"), "bad"
    )
    mined = match_rules(pages, mine_rules(taught, **mining), url_col)
    out = pages.join(mined.withColumnRenamed(url_col, "_url"), pages[url_col] == F.col("_url"), "left").drop("_url")
    out = out.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    rule, action = host_rule(F.col("host"), F.col("path"), host_rules)
    out = out.withColumn("rule", rule)
    learnt = F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn("verdict", F.coalesce(action, learnt))


def op1_url_rules(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return filter_urls(pages, labels).select("page_id", "host", "path", "rule", "verdict", "mined_rule", "mined_confidence")


SQL = f"""
WITH p AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*(.*)', 1), '{UPPER}', '{LOWER}') AS rest
  FROM pages
), t AS (
  SELECT DISTINCT url, 'h:' || x AS tok FROM (SELECT url, unnest(regexp_split_to_array(host, '[^a-z0-9]+')) AS x FROM p) WHERE regexp_matches(x, '[a-z]')
  UNION
  SELECT DISTINCT url, 'p:' || x AS tok FROM (SELECT url, unnest(regexp_split_to_array(rest, '[^a-z0-9]+')) AS x FROM p) WHERE regexp_matches(x, '[a-z]')
), taught AS (
  SELECT row_number() OVER () AS k, p.url, (l.quality = 0 OR l.toxic = 1) AS bad
  FROM p JOIN labels l ON l.doc_id = p.page_id WHERE (l.quality = 0 OR l.toxic = 1) IS NOT NULL
), n AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE bad) AS n_bad, greatest(0.002 * count(*), 8) AS least FROM taught
), b AS (
  SELECT k, bad, tok FROM taught JOIN t USING (url)
), one AS (
  SELECT b.k, b.bad, b.tok FROM b WHERE tok IN (SELECT tok FROM b WHERE bad GROUP BY tok HAVING count(*) >= (SELECT least FROM n))
), sets AS (
  SELECT k, bad, [tok] AS s FROM one
  UNION ALL SELECT a.k, a.bad, [a.tok, c.tok] FROM one a JOIN one c ON a.k = c.k AND a.tok < c.tok
  UNION ALL SELECT a.k, a.bad, [a.tok, c.tok, e.tok] FROM one a JOIN one c ON a.k = c.k AND a.tok < c.tok JOIN one e ON c.k = e.k AND c.tok < e.tok
), rules AS (
  SELECT s, count(*) AS n_pages, count(*) FILTER (WHERE bad) AS bad_pages FROM sets GROUP BY s
), good AS (
  SELECT s, bad_pages, bad_pages / n_pages AS confidence FROM rules, n
  WHERE bad_pages >= least AND bad_pages / n_pages >= 0.4 AND (bad_pages * n.n) / (n_pages * n.n_bad) >= 1.5
), have AS (
  SELECT url, list(tok) AS toks FROM t GROUP BY url
), best AS (
  SELECT url, max({{'c': confidence, 'n': bad_pages, 'r': array_to_string(s, ' ')}}) AS m FROM have JOIN good ON list_has_all(toks, s) GROUP BY url
)
SELECT page_id, host, path,
  CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
  CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'allow'
       WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'block'
       WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'allow'
       WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'block'
       WHEN m IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  m.r AS mined_rule, m.c AS mined_confidence
FROM p LEFT JOIN best ON best.url = p.url
"""
