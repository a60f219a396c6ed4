"""Sources: documents, pages and archives as rows with explicit positions."""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quirelake.functions import urls
from quirelake.operators.durable import settle
from quirelake.sources.archives import MEMBERS, member_batch, members

# Attributes that advertise a page's picture, and the end of a URL that is punctuation.
META_NAMES = "og:image|og:image:url|og:image:secure_url|twitter:image|image"
URL = r"(?i)https?://[^\s<>\"']+"
URL_TAIL = ".,);]}"
ANCHOR = '<a href="([^"]*)">([^<]*)</a>'


def lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every line of a text with its position from 0: key, para_index, line."""
    return docs.select(key, F.posexplode(F.split("text", "\n", -1)).alias("para_index", "line"))


def paragraph_table(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The lines that are not blank; positions count all lines."""
    return lines(docs, key).where(F.trim(F.regexp_replace("line", r"\s+", " ")) != "")


def anchors(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """The links of pages with their position from 0: key, link_pos, href, label."""
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(2)).alias("label"))
    return pages.select(key, F.posexplode(both).alias("link_pos", "a")).select(key, "link_pos", "a.href", "a.label")


def advertised_images(pages: DataFrame, key: str = "page_id", limit: int = 8, size: int = 2_000_000) -> DataFrame:
    """URLs that a page's head advertises as its picture: key, nth (from 1), url. Distinct, in order, at most limit a
    page, from the first size characters."""
    tags = F.regexp_extract_all(F.left("html", F.lit(size)), F.lit(r"(?is)<(?:meta|link)\b[^>]*>"), F.lit(0))
    rows = pages.select(key, F.posexplode(tags).alias("pos", "tag"))

    def attribute(names: str):
        return F.regexp_extract("tag", rf"""(?is)\s(?:{names})\s*=\s*["']([^"']*)["']""", 1)

    name = F.lower(F.coalesce(F.nullif(attribute("property"), F.lit("")), F.nullif(attribute("name"), F.lit("")), attribute("itemprop")))
    meta = F.col("tag").rlike("(?i)^<meta") & name.rlike(f"^(?:{META_NAMES})$")
    link = F.col("tag").rlike("(?i)^<link") & F.lower(attribute("rel")).contains("image_src")
    found = rows.select(key, "pos", F.when(meta, attribute("content")).when(link, attribute("href")).alias("url")).where("url <> ''")
    first = found.groupBy(key, "url").agg(F.min("pos").alias("pos"))
    return first.withColumn("nth", F.row_number().over(W.partitionBy(key).orderBy("pos"))).where(F.col("nth") <= limit).select(key, "nth", "url")


def bare_urls(paragraphs: DataFrame) -> DataFrame:
    """URLs in the text of paragraphs without trailing punctuation: doc_id, para_index, pos, url."""
    found = F.regexp_extract_all("text", F.lit(URL), F.lit(0))
    return paragraphs.select("doc_id", "para_index", F.posexplode(found).alias("pos", "url")).withColumn("url", F.rtrim("url", F.lit(URL_TAIL)))


def text_links(hyperlinks: DataFrame, fields: DataFrame, codes: DataFrame, bare: DataFrame) -> DataFrame:
    """The links of paragraphs from four kinds of rows (doc_id, para_index, pos, url), in this order of kinds.

    Every hyperlink stays; the other kinds stay where the URL is new in the paragraph (field codes: new against the
    other kinds).
    """
    kinds = [hyperlinks, fields, codes, bare]
    every = [d.select("doc_id", "para_index", "pos", "url").withColumns({"kind": F.lit(n), "kind_order": F.lit(i)}) for i, (n, d) in enumerate(zip(("hyperlink", "field", "code", "bare"), kinds, strict=True))]
    whole = every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3])
    same = W.partitionBy("doc_id", "para_index", "url").orderBy("kind_order", "pos")
    earlier = F.min("kind_order").over(W.partitionBy("doc_id", "para_index", "url"))
    ranked = whole.withColumns({"nth": F.row_number().over(same), "first_kind": earlier})
    stays = (F.col("kind") == "hyperlink") | (F.col("nth") == 1) | ((F.col("kind") == "code") & (F.col("first_kind") == F.col("kind_order")))
    return ranked.where(stays).select("doc_id", "para_index", "kind_order", "pos", "kind", "url")


def archive_members(archives: DataFrame) -> DataFrame:
    """The members of zip archives given as (path, content), as `binaryFile` reads them: path, pos, member, bytes,
    is_link, error. Only the listing runs in Python; an archive that cannot be read gives one row with its error. For archives
    too large to be held, see archives.listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield member_batch(members(path, io.BytesIO(content.as_buffer()) if content.is_valid else None))

    return archives.select("path", "content").mapInArrow(run, MEMBERS)


#: Levels of nested JSON that are walked in one plan.
LEVELS = 4


def _urls_in(rows: DataFrame, key: str, json: str, step, hit: Column) -> DataFrame:
    """(key, url, path): each URL of nested JSON once for its key, with the first path where `hit` holds for a string.

    Values are opened level by level: key, v (variant), path, name (of a field; null in an array). step gives the columns rank
    (the place of a value among its siblings) and deeper (whether it is entered). LEVELS levels go in one plan, which
    writes the hits; only what lies deeper than these is written to be walked on.
    """
    spark, text = rows.sparkSession, F.try_variant_get("v", "$", "string")
    level, found = rows.select(F.col(key).alias("_key"), F.try_parse_json(json).alias("v"), F.lit("").alias("path")), []
    while True:
        hits = []
        for _ in range(LEVELS):
            inside = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("_key", F.col("value").alias("v"), "path", "pos", F.col("key").alias("name"))
            inside = step(inside).withColumn("path", F.concat("path", F.lit("/"), F.lpad(F.col("rank").cast("string"), 9, "0"))).drop("rank", "pos")
            hits.append(inside.where(hit).select("_key", text.alias("url"), "path"))
            level = inside.where("deeper").select("_key", "v", "path")
        found.append(settle(reduce(DataFrame.unionByName, hits)))
        level = settle(level.where(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")))
        if level.isEmpty():
            break
    return reduce(DataFrame.unionByName, found).groupBy(F.col("_key").alias(key), "url").agg(F.min("path").alias("path"))


def harvested_urls(rows: DataFrame, key: str, json: str) -> DataFrame:
    """All `signed_url` and `url` strings of nested JSON that start with http(s), distinct, with the first path they
    stand at: key, url, path. Objects and arrays of any shape are walked level by level."""
    step = lambda d: d.withColumns({"rank": F.col("pos"), "deeper": F.lit(True)})
    return _urls_in(rows, key, json, step, F.col("name").isin("signed_url", "url") & F.try_variant_get("v", "$", "string").rlike("^https?://"))


# The fields of a provider's answer that may hold a download link, and those that may hold such fields.
LINK_FIELDS = ("signed_url", "url", "download_url")
OUTER_FIELDS = ("data", "download", "files", "generated", "urls")


def media_urls(rows: DataFrame, key: str, json: str, hosts: list[str]) -> DataFrame:
    """Download links of trusted hosts in a provider's answer: key, url, path. Only the named fields hold links, only
    the named outer fields and arrays are entered, and a string in an array is a link itself."""
    text = F.try_variant_get("v", "$", "string")
    order = F.array_position(F.array(*[F.lit(x) for x in (*LINK_FIELDS, *OUTER_FIELDS)]), F.col("name"))

    def step(d: DataFrame) -> DataFrame:
        rank = F.when(F.col("name").isNull(), F.col("pos")).otherwise(order)
        return d.withColumns({"rank": rank, "deeper": F.col("name").isNull() | F.col("name").isin(*OUTER_FIELDS)})

    hit = (F.col("name").isNull() | F.col("name").isin(*LINK_FIELDS)) & (F.schema_of_variant("v") == "STRING") & urls.trusted(text, hosts, subdomains=True)
    return _urls_in(rows, key, json, step, hit)
