"""URL filters: a temporal list join.

A list is a log of dated entries: at a time a rule (a host with everything
below it, or a host with a path prefix) is put on or taken off.  Per rule the
log becomes validity intervals ``[since, until)``.  A capture has one key per
parent domain of its host and per directory of its path; the as-of join meets a
key with the rule's intervals and keeps the one that holds at fetch time.

The join is an equality on the rule with the interval as its residual, so one
host with a third of all captures is an ordinary skewed equi-join; the list is
broadcast only if it is counted and below the bound.

Defined results: a null or unparsable URL, or a null fetch time, is allowed
with no matches; a null in an entry's rule, action or time drops the entry;
entries of one rule at one time: the last action in sorted order holds ("off"
before "on"); repeated entries change nothing; an interval never closed has a
null ``until``; an empty list allows everything; captures that repeat an id are judged
one by one, those without an id like any other; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def host_of(url):
    """Lower-cased host without port, credentials and a leading ``www.``."""
    found = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.regexp_replace(found, r"^www\.|\.$", "")


def path_of(url):
    return F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)?", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """``(rule, category, since, until)`` from dated entries ``(rule, category, action, at)``.

    The window runs per rule and category, i.e. over the log of one rule.
    """
    log = entries.select(F.lower("rule").alias("rule"), "category", F.lower("action").alias("action"), "at").where(
        "rule IS NOT NULL AND at IS NOT NULL AND action IN ('on', 'off')"
    )
    one = log.groupBy("rule", "category", "at").agg(F.max("action").alias("action"))
    w = W.partitionBy("rule", "category").orderBy("at")
    turned = one.withColumn("was", F.lag("action", 1, "off").over(w)).where("action <> was")
    turned = turned.withColumn("until", F.lead("at").over(w))
    return turned.where("action = 'on'").select("rule", "category", F.col("at").alias("since"), "until")


def capture_of(*cols):
    """128 bits that stand for one capture: its id, URL and fetch time, any of which may be null."""
    return F.xxhash64(*cols).alias("r1"), F.xxhash64(F.lit(97), *reversed(cols)).alias("r2")


def capture_keys(captures: DataFrame, id_col: str, url_col: str, time_col: str) -> DataFrame:
    """One row per capture and rule that could cover it."""
    c = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("fetched")).distinct()
    c = c.select(*capture_of("id", "url", "fetched"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "fetched")
    c = c.where("host <> '' AND fetched IS NOT NULL")
    domains = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, 1000000), '.'))")
    steps = F.expr(
        "CASE WHEN path = '' THEN array() ELSE transform(sequence(2, size(split(path, '/'))), i -> concat(host, array_join(slice(split(path, '/'), 1, i), '/'))) END"
    )
    return c.select("r1", "r2", "fetched", F.explode(F.array_distinct(F.concat(domains, F.transform(steps, F.lower)))).alias("rule"))


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """``(id, host, blocked, n_rules, categories, since)`` for every capture.

    ``categories`` are those of the rules that held at fetch time, sorted;
    ``since`` is when the first of them began to hold.
    """
    valid = intervals(entries)
    valid = F.broadcast(valid) if valid.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else valid
    keys = capture_keys(captures, id_col, url_col, time_col)
    held = keys.join(valid, "rule").where("since <= fetched AND (until IS NULL OR fetched < until)")
    per = held.groupBy("r1", "r2").agg(
        F.count_distinct("rule").alias("n_rules"), F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"), F.min("since").alias("since")
    )
    base = captures.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), *capture_of(id_col, url_col, time_col))
    out = base.join(per, ["r1", "r2"], "left")
    return out.select("id", F.coalesce("host", F.lit("")).alias("host"), F.col("n_rules").isNotNull().alias("blocked"), F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"), F.coalesce("categories", F.lit("")).alias("categories"), "since")


def _digest(col: str, salt: str, n: int) -> str:
    return f"CAST(conv(substr(md5(concat({col}, '{salt}')), 1, 6), 16, 10) AS INT) % {n}"


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    """The query: all ``pages`` against a dated list over their hosts.

    The tables hold no fetch times and no list, so both come from a rule: day of
    fetch from the page's id; for each host, its parent domain and its language
    folder, entries that go on, off and on again at days drawn from a digest.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched", F.expr("CAST(page_id % 365 AS INT)"))
    host = host_of(F.col("url"))
    first = F.element_at(F.split(path_of(F.col("url")), "/"), 2)
    rules = pages.select(F.explode(F.array(host, F.regexp_replace(host, r"^[^.]+\.", ""), F.concat(host, F.lit("/"), first))).alias("rule")).distinct()
    rules = rules.where("rule <> ''").where(f"{_digest('rule', 'listed', 4)} = 0").selectExpr(
        "rule",
        f"CASE {_digest('rule', 'kind', 3)} WHEN 0 THEN 'adult' WHEN 1 THEN 'malware' ELSE 'spam' END AS category",
        f"{_digest('rule', 'first', 200)} AS d0",
        f"{_digest('rule', 'second', 100)} + 1 AS d1",
    )
    entries = rules.selectExpr("rule", "category", "explode(array(named_struct('action', 'on', 'at', d0), named_struct('action', 'off', 'at', d0 + d1), named_struct('action', 'on', 'at', d0 + d1 + 60))) AS e")
    out = filter_urls(captures, entries.select("rule", "category", "e.action", "e.at"))
    return out.withColumnRenamed("id", "page_id")


OP3_SQL = r"""
WITH c AS (SELECT page_id, CAST(page_id % 365 AS INT) AS fetched,
                  regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.|\.$', '', 'g') AS host,
                  regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)?', 1) AS path FROM pages),
     r0 AS (SELECT DISTINCT unnest([host, regexp_replace(host, '^[^.]+\.', ''), host || '/' || string_split(path, '/')[2]]) AS rule FROM c),
     r AS (SELECT rule, CASE CAST('0x' || substr(md5(rule || 'kind'), 1, 6) AS INT) % 3 WHEN 0 THEN 'adult' WHEN 1 THEN 'malware' ELSE 'spam' END AS category,
                  CAST('0x' || substr(md5(rule || 'first'), 1, 6) AS INT) % 200 AS d0, CAST('0x' || substr(md5(rule || 'second'), 1, 6) AS INT) % 100 + 1 AS d1
           FROM r0 WHERE rule <> '' AND CAST('0x' || substr(md5(rule || 'listed'), 1, 6) AS INT) % 4 = 0),
     iv AS (SELECT rule, category, d0 AS since, d0 + d1 AS until FROM r UNION ALL SELECT rule, category, d0 + d1 + 60, NULL FROM r),
     p AS (SELECT page_id, fetched, host, string_split(host, '.') AS hs, string_split(path, '/') AS ps, path FROM c WHERE host <> ''),
     k AS (SELECT DISTINCT page_id, fetched, rule FROM (
             SELECT page_id, fetched, array_to_string(list_slice(hs, i, len(hs)), '.') AS rule FROM (SELECT *, unnest(generate_series(1, len(hs))) AS i FROM p)
             UNION ALL
             SELECT page_id, fetched, lower(host || array_to_string(list_slice(ps, 1, i), '/')) FROM (SELECT *, unnest(generate_series(2, len(ps))) AS i FROM p WHERE path <> ''))),
     m AS (SELECT k.page_id, count(DISTINCT k.rule) AS n_rules, string_agg(DISTINCT iv.category, ',' ORDER BY iv.category) AS categories, min(iv.since) AS since
           FROM k JOIN iv ON iv.rule = k.rule AND iv.since <= k.fetched AND (iv.until IS NULL OR k.fetched < iv.until) GROUP BY k.page_id)
SELECT c.page_id, c.host, m.page_id IS NOT NULL AS blocked, coalesce(m.n_rules, 0) AS n_rules, coalesce(m.categories, '') AS categories, CAST(m.since AS INT) AS since
FROM c LEFT JOIN m USING (page_id)
"""
