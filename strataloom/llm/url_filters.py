"""URL filtering by a temporal list join.

A list is a log of dated entries: on a day, a domain is added to a category, or removed from it. Entries become
validity intervals [day, day of the domain's next entry in that category), and every capture is joined as of its
fetch day with the intervals of its host and of the domains above it.

The log is first brought down to one state for each (domain, category, day) - the last action of a day wins, an
addition before a removal - so the window that finds the next entry holds one domain's distinct days at most.
What is judged is the distinct (host, day): the suffixes of a host are looked up once for each host, its intervals compared once for each
day, and the verdict is joined back to every capture. All joins are on equal keys with the heavy side on the left, which Spark splits where a key is hot.

A host longer than every listed domain is looked up by suffixes of their length at most, so a host of any length gives no more than the list
can match.

Defined cases: every capture has its row, equal ones and those without an id too; a null or unparsable URL has no host and is allowed; a null fetch day matches no interval; entries with
a null domain, day or action are ignored; equal entries count once; an empty list allows everything; very long URLs are parsed whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.common import checkpointed, table

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def suffixes(host, longest: int):
    """The host and every domain above it, as far as they have longest characters or fewer."""
    tail = F.right(host, F.lit(longest + 1))  # what is left of its first dot is the end of a longer suffix
    short = F.when(F.length(host) <= longest, host).when(F.instr(tail, ".") > 0, F.substring(tail, F.instr(tail, ".") + 1, F.lit(longest + 1)))
    parts = F.split(short, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """domain, category, valid_from, valid_to (exclusive, null: open) of entries(domain, category, day, action add | remove)."""
    clean = entries.select(F.lower("domain").alias("domain"), F.coalesce("category", F.lit("")).alias("category"), F.col("day").cast("date").alias("day"), F.col("action").alias("action"))
    clean = clean.where(F.col("domain").isNotNull() & F.col("day").isNotNull() & F.col("action").isin("add", "remove"))
    states = clean.groupBy("domain", "category", "day").agg(F.max("action").alias("action"))  # 'remove' > 'add'
    order = Window.partitionBy("domain", "category").orderBy("day")
    changes = states.withColumn("was", F.lag("action").over(order)).where("was IS NULL AND action = 'add' OR was <> action")
    return changes.withColumn("valid_to", F.lead("day").over(order)).where("action = 'add'").select("domain", "category", F.col("day").alias("valid_from"), "valid_to")


def temporal_list_join(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetch_day") -> DataFrame:
    """A row for each capture: id, host, fetch day, n_active (entries active at the fetch), categories, matched (longest domain), verdict."""
    valid = checkpointed(validity_intervals(entries))
    longest = valid.agg(F.max(F.length("domain"))).first()[0] or 0
    rows = captures.select(F.col(id_col).alias("__id"), host_of(F.col(url_col)).alias("host"), F.col(day_col).cast("date").alias("day"))
    asked = rows.where("host <> '' AND day IS NOT NULL").select("host", "day").distinct()
    looked_up = asked.select("host").distinct().withColumn("domain", F.explode(suffixes(F.col("host"), longest)))
    listed = looked_up.join(valid, "domain").select("host", F.col("domain"), "category", "valid_from", "valid_to")
    active = (F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))
    longest_domain = F.max(F.struct(F.length("domain"), "domain"))["domain"]
    judged = (
        asked.join(listed, "host").where(active).groupBy("host", "day")
        .agg(F.count_distinct("domain", "category").alias("n_active"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"), longest_domain.alias("matched"))
    )
    return rows.join(judged, ["host", "day"], "left").select(
        F.col("__id").alias(id_col), "host", F.date_format("day", "yyyy-MM-dd").alias("fetch_day"), F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.coalesce("categories", F.lit("")).alias("categories"), "matched", F.when(F.col("n_active") > 0, "block").otherwise("allow").alias("verdict"),
    )


def dated_captures(pages: DataFrame) -> DataFrame:
    """pages bear no time: a page's fetch day is its id's, modulo 1000 days from 2020-01-01."""
    return pages.select("page_id", "url", F.date_add(F.lit("2020-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(1000)).cast("int")).alias("fetch_day"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """A list made from the hosts of pages by rule, in want of a table: by the MD5 of a host, a third are added to a
    category on some day, half of these are removed again, and some of those come back; a few domains above the hosts are listed for a while."""
    hosts = pages.select(host_of(F.col("url")).alias("domain")).where("domain <> ''").distinct()
    above = hosts.select(F.regexp_extract("domain", r"^[^.]+\.(.+)$", 1).alias("domain")).where("instr(domain, '.') > 0").distinct()
    both = hosts.union(above).distinct().withColumn("h", F.conv(F.substring(F.md5("domain"), 1, 8), 16, 10).cast("long")).where("h % 3 = 0")
    start = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("h") % 900).cast("int"))
    steps = F.array(F.struct(F.lit(0).alias("after"), F.lit("add").alias("action")), F.when(F.col("h") % 2 == 0, F.struct(F.lit(60).alias("after"), F.lit("remove").alias("action"))), F.when(F.col("h") % 4 == 0, F.struct(F.lit(120).alias("after"), F.lit("add").alias("action"))))
    log = both.withColumn("s", F.explode(F.filter(steps, lambda x: x.isNotNull())))
    return log.select("domain", F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("spam")), (F.col("h") % 7 % 3 + 1).cast("int")).alias("category"), F.date_add(start, F.col("s.after")).alias("day"), F.col("s.action").alias("action"))


def op5_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return temporal_list_join(dated_captures(pages), dated_entries(pages))


SQL = r"""
WITH captures AS (
  SELECT row_number() OVER () AS rid, page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
         DATE '2020-01-01' + CAST(page_id * 37 % 1000 AS INTEGER) AS fetch_day
  FROM pages),
hosts AS (SELECT DISTINCT host AS domain FROM captures WHERE host <> ''),
above AS (SELECT DISTINCT regexp_extract(domain, '^[^.]+\.(.+)$', 1) AS domain FROM hosts),
listed AS (
  SELECT domain, CAST(concat('0x', substr(md5(domain), 1, 8)) AS BIGINT) AS h
  FROM (SELECT domain FROM hosts UNION SELECT domain FROM above WHERE instr(domain, '.') > 0)),
entries AS (
  SELECT domain, h, DATE '2020-01-01' + CAST(h % 900 + s.after AS INTEGER) AS day, s.action AS action
  FROM listed, (VALUES (0, 'add', 1), (60, 'remove', 2), (120, 'add', 4)) s(after, action, every)
  WHERE h % 3 = 0 AND h % s.every = 0),
valid AS (
  SELECT domain, ['adult', 'malware', 'spam'][CAST(h % 7 % 3 + 1 AS INTEGER)] AS category, action, day AS valid_from, lead(day) OVER (PARTITION BY domain ORDER BY day) AS valid_to
  FROM entries)
SELECT any_value(c.page_id) AS page_id, any_value(c.host) AS host, strftime(any_value(c.fetch_day), '%Y-%m-%d') AS fetch_day, count(DISTINCT v.domain) AS n_active,
       coalesce(array_to_string(list_sort(list_distinct(list(v.category) FILTER (v.category IS NOT NULL))), ','), '') AS categories,
       arg_max(v.domain, (length(v.domain), v.domain)) AS matched,
       CASE WHEN count(v.domain) > 0 THEN 'block' ELSE 'allow' END AS verdict
FROM captures c LEFT JOIN valid v
  ON v.action = 'add' AND (c.host = v.domain OR ends_with(c.host, '.' || v.domain)) AND c.fetch_day >= v.valid_from AND (v.valid_to IS NULL OR c.fetch_day < v.valid_to)
GROUP BY c.rid
"""
