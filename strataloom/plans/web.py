"""Registered queries over pages: blocks of text and clean text. Beside each, its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.functions.html import BLOCKS, FURNITURE, HEADINGS, RAW
from strataloom.operators import web
from strataloom.plans.corpus import query


def _any(names) -> str:
    return "(?:" + "|".join(sorted(names)) + ")"


_TAG = """(?:[^"''>]|"[^"]*"|''[^'']*'')*>?"""
_RAWS = "|".join(f"<{n}(?:[^A-Za-z0-9>\"'']{_TAG}|>).*?(?:</{n}[^>]*>?|\\z)" for n in sorted(RAW))
_DECODED = "tok"
for _name, _char in (("quot", '"'), ("lt", "<"), ("gt", ">"), ("copy", "©"), ("middot", "·"), ("nbsp", " "), ("amp", "&")):  # the entities that the tables hold; '&' last
    _DECODED = f"regexp_replace({_DECODED}, '&{_name};?', '{_char}', 'g')"

_BLOCKS = f"""WITH toks AS (SELECT page_id, url, coalesce(html, '') AS html, regexp_extract_all(coalesce(html, ''), '(?is)<!--.*?(?:-->|\\z)|{_RAWS}|<[!?][^>]*>?|</?[a-z][a-z0-9]*{_TAG}|[^<]+|<') AS ts FROM pages),
tok AS (SELECT page_id, unnest(ts) AS tok, generate_subscripts(ts, 1) AS pos FROM toks),
named AS (SELECT *, CASE WHEN regexp_matches(tok, '^(?s)(<!|<\\?)') THEN '!' ELSE lower(regexp_extract(tok, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) END AS name, regexp_matches(tok, '^</') AS closing FROM tok),
raw AS (SELECT * FROM named WHERE name <> '!' AND NOT (regexp_full_match(name, '{_any(RAW)}'))),
typed AS (SELECT *, regexp_full_match(name, '{_any(BLOCKS)}') AS is_block FROM raw),
placed AS (
  SELECT *, sum(CASE WHEN is_block THEN 1 ELSE 0 END) OVER o AS block,
         sum(CASE WHEN regexp_full_match(name, '{_any(FURNITURE)}') THEN CASE WHEN closing THEN -1 ELSE 1 END ELSE 0 END) OVER o AS depth,
         sum(CASE WHEN name = 'title' THEN CASE WHEN closing THEN -1 ELSE 1 END ELSE 0 END) OVER o AS titles,
         max(CASE WHEN is_block AND NOT closing AND regexp_full_match(name, '{_any(HEADINGS)}') THEN pos END) OVER o AS heading_at, max(CASE WHEN is_block THEN pos END) OVER o AS block_at
  FROM typed WINDOW o AS (PARTITION BY page_id ORDER BY pos)),
linked AS (SELECT *, sum(CASE WHEN name = 'a' THEN CASE WHEN closing THEN -1 ELSE 1 END ELSE 0 END) OVER (PARTITION BY page_id, block ORDER BY pos) AS links, CASE WHEN name = 'br' THEN ' ' WHEN name = '' THEN {_DECODED} ELSE '' END AS txt FROM placed),
squeezed AS (SELECT *, trim(regexp_replace(txt, '[\\x09-\\x0D\\x20\\x{{a0}}]+', ' ', 'g')) AS words FROM linked),
joined AS (
  SELECT page_id, block, trim(regexp_replace(string_agg(CASE WHEN titles > 0 THEN '' ELSE txt END, '' ORDER BY pos), '[\\x09-\\x0D\\x20\\x{{a0}}]+', ' ', 'g')) AS text,
         sum(CASE WHEN links > 0 AND titles = 0 AND name = '' AND words <> '' THEN len(string_split(words, ' ')) ELSE 0 END) AS link_words, max(depth) > 0 AS furniture, coalesce(max(heading_at) = max(block_at), FALSE) AS heading
  FROM squeezed GROUP BY page_id, block),
blocks AS MATERIALIZED (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY block) - 1 AS n, text, len(string_split(text, ' ')) AS words, link_words, furniture, heading FROM joined WHERE text <> ''),
titles AS (SELECT page_id, trim(regexp_replace(coalesce(string_agg(txt, '' ORDER BY pos) FILTER (titles > 0), ''), '[\\x09-\\x0D\\x20\\x{{a0}}]+', ' ', 'g')) AS title FROM linked GROUP BY page_id),
hosts AS (SELECT page_id, CASE WHEN url IS NULL THEN 'null' ELSE concat('host ', lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1))) END AS host FROM pages),
host_pages AS (SELECT host, count(*) AS p FROM hosts GROUP BY host),
templates AS (SELECT host, text FROM (SELECT DISTINCT host, page_id, text FROM blocks JOIN hosts USING (page_id)) JOIN host_pages USING (host) GROUP BY host, text HAVING count(*) >= {web.MAX_PAGES} AND count(*) > max(p) * {web.MAX_SHARE}),
long AS (SELECT *, link_words * 3 > words AS linky, words >= {web.MIN_WORDS} AND link_words * 3 <= words AND NOT furniture AS long FROM blocks),
near AS (SELECT *, coalesce(lag(long) OVER o, FALSE) OR coalesce(lead(long) OVER o, FALSE) AS beside FROM long WINDOW o AS (PARTITION BY page_id ORDER BY n)),
verdict AS MATERIALIZED (SELECT near.*, t.text IS NOT NULL AS template, t.text IS NULL AND NOT linky AND NOT furniture AND (long OR beside) AS kept FROM near JOIN hosts USING (page_id) LEFT JOIN templates t ON t.host = hosts.host AND t.text = near.text)"""


def pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


@query(f"{_BLOCKS} SELECT page_id, n::BIGINT AS n, words::BIGINT AS words, link_words::BIGINT AS link_words, furniture, heading, template, kept, md5(text) AS text_md5 FROM verdict")
def html_blocks(spark, sf_dir):
    """Every block of every page with its densities and the verdict on it."""
    rows = web.judged_pages(pages(spark, sf_dir)).select("page_id", F.posexplode("blocks").alias("n", "b"))
    return rows.select("page_id", F.col("n").cast("long").alias("n"), "b.words", "b.link_words", "b.furniture", "b.heading", "b.template", "b.kept", F.md5("b.text").alias("text_md5"))


@query(
    f"""{_BLOCKS}, t AS (SELECT page_id, string_agg(text, chr(10) ORDER BY n) FILTER (kept) AS text, count(*) AS n_blocks, count(*) FILTER (kept) AS n_kept FROM verdict GROUP BY page_id)
SELECT page_id, title, coalesce(n_blocks, 0)::BIGINT AS n_blocks, coalesce(n_kept, 0)::BIGINT AS n_kept, length(coalesce(text, ''))::BIGINT AS n_chars, md5(coalesce(text, '')) AS text_md5
FROM pages JOIN titles USING (page_id) LEFT JOIN t USING (page_id)"""
)
def html_clean(spark, sf_dir):
    """Title and clean text of every page."""
    rows = web.clean_pages(pages(spark, sf_dir))
    return rows.select("page_id", "title", "n_blocks", "n_kept", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))
