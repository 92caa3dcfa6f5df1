"""Text of web pages without what surrounds it.

A page becomes blocks of text (a small state machine, page by page); everything that judges them is a column or a count in Spark:

* density: a block is long if it has min_words words, no more than a third of them within links, and isn't furniture (navigation, footers, forms). Long blocks stay, and so do blocks that stand right beside one,
  unless they are furniture or mostly links;
* templates: a block that more than max_share of a host's pages hold, and max_pages of them at least, goes. Distinct pages are counted for each (host, block) with partial sums; a host has at most
  blocks a page / max_share of these, so they travel as one short array for each host.

Blocks are made once and written; texts aren't shuffled.

Defined cases: a null page has no title and no blocks; a null url is a host of its own; repeated pages count as pages; an empty table gives no rows; other columns stay.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.html import blocks_of
from strataloom.sources import shared

MIN_WORDS, MAX_PAGES, MAX_SHARE = 15, 5, 0.3

BLOCK = "array<struct<text: string, words: long, link_words: long, furniture: boolean, heading: boolean>>"


def host_of(url: Column) -> Column:
    """The lower-cased host, without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))


def with_blocks(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with __title and __blocks in place of their HTML."""
    others = [c for c in pages.columns if c != html_col]
    kinds = dict(pages.dtypes)
    item = pa.struct([("text", pa.string()), ("words", pa.int64()), ("link_words", pa.int64()), ("furniture", pa.bool_()), ("heading", pa.bool_())])
    names = [item.field(i).name for i in range(item.num_fields)]

    def run(batches):
        for batch in batches:
            titles, blocks = [], []
            for page in batch.column(len(others)):
                title, found = blocks_of(page.as_py())
                titles.append(title)
                blocks.append([dict(zip(names, b)) for b in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(titles, pa.string()), pa.array(blocks, pa.list_(item))], names=[*batch.schema.names[: len(others)], "__title", "__blocks"])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in others] + ["__title string", f"__blocks {BLOCK}"])
    return pages.select(*others, html_col).mapInArrow(run, schema)


def judged(blocks: Column, min_words: int = MIN_WORDS) -> Column:
    """The blocks with linky, long and kept, from each block and its two neighbours."""
    linky = lambda b: b["link_words"] * 3 > b["words"]
    long = lambda b: (b["words"] >= min_words) & ~linky(b) & ~b["furniture"]
    beside = lambda i: F.coalesce(long(F.get(blocks, i)), F.lit(False))
    kept = lambda b, i: ~linky(b) & ~b["furniture"] & (long(b) | beside(i - 1) | beside(i + 1))
    return F.transform(blocks, lambda b, i: F.struct(b["text"].alias("text"), b["words"].alias("words"), b["link_words"].alias("link_words"), b["furniture"].alias("furniture"), b["heading"].alias("heading"), kept(b, i).alias("kept")))


def block_key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def host_templates(pages: DataFrame, max_pages: int = MAX_PAGES, max_share: float = MAX_SHARE) -> DataFrame:
    """__host, __templates: keys of the blocks that are above both limits of their host; from __host and __blocks."""
    keys = F.array_distinct(F.transform("__blocks", lambda b: block_key(b["text"])))
    # null stands for the page itself, so that one pass counts pages too
    each = pages.select("__host", F.explode(F.concat(F.array(F.lit(None).cast("struct<a: long, b: long>")), keys)).alias("key"))
    counts = shared.written(each.groupBy("__host", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("key").isNull() | (F.col("n") >= max_pages)), "block-counts")
    hosts = counts.where("key IS NULL").select("__host", F.col("n").alias("pages"))
    over = counts.where("key IS NOT NULL").join(hosts, "__host").where(F.col("n") > F.col("pages") * max_share)
    return over.groupBy("__host").agg(F.array_sort(F.collect_list("key")).alias("__templates"))


def judged_pages(pages: DataFrame, html_col: str = "html", url_col: str = "url", min_words: int = MIN_WORDS, max_pages: int = MAX_PAGES, max_share: float = MAX_SHARE) -> DataFrame:
    """pages without their HTML, with title and blocks (text, words, link_words, furniture, heading, kept, template)."""
    made = shared.written(with_blocks(pages, html_col).withColumn("__host", F.when(F.col(url_col).isNull(), F.lit("null")).otherwise(F.concat(F.lit("host "), host_of(F.col(url_col))))), "blocks")
    templates = shared.written(host_templates(made, max_pages, max_share), "templates")
    rows = shared.join_measured(made, templates, ["__host"], F.xxhash64("__blocks"))
    known = F.coalesce("__templates", F.array().cast("array<struct<a: long, b: long>>"))
    rows = rows.withColumn("__known", known).withColumn("__blocks", judged(F.col("__blocks"), min_words))
    template = lambda b: F.array_contains("__known", block_key(b["text"]))
    blocks = F.transform("__blocks", lambda b: b.withField("template", template(b)).withField("kept", b["kept"] & ~template(b)))
    return rows.select(*[c for c in pages.columns if c != html_col], F.col("__title").alias("title"), blocks.alias("blocks"))


def clean_pages(pages: DataFrame, html_col: str = "html", url_col: str = "url", **limits) -> DataFrame:
    """pages without their HTML, with title, text (kept blocks, one a line), n_blocks and n_kept."""
    rows = judged_pages(pages, html_col, url_col, **limits)
    kept = F.filter("blocks", lambda b: b["kept"])
    return rows.withColumns({"text": F.array_join(F.transform(kept, lambda b: b["text"]), "\n"), "n_blocks": F.size("blocks").cast("long"), "n_kept": F.size(kept).cast("long")}).drop("blocks")
