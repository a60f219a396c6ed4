"""Queries over links, files, candidates and jobs, with their SQL."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quirelake.functions import jobs, rules, scenes, urls
from quirelake.functions import text as tx
from quirelake.operators import aggregates, filters, matching, ranking, sampling
from quirelake.operators.durable import scratch, settle, shared_folder
from quirelake.plans import views
from quirelake.sources import library, providers, scan, sinks

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


# links and pages

_URL = r"'(?s)^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?([^/?#:@]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?'"


@query("src_03_html_link_scan", views.sql(r"""
with t as (select page_id, link_pos, 'meta' as kind, 'http://img.example.com' || href as u from link where link_pos % 2 = 0)
select page_id, row_number() over (partition by page_id order by p) as nth, url from (select page_id, u as url, min(link_pos) as p from t group by 1, 2) qualify nth <= 8""", "link"))
def _(spark, d):
    # the given pages advertise no picture: every other link is rewritten as such a tag
    pages = views.read(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(scan.ANCHOR), F.lit(1))).alias("pos", "href"))
    tags = F.when(F.col("pos") % 4 == 0, F.format_string('<meta property="og:image" content="http://img.example.com%s">', "href")).when(F.col("pos") % 2 == 0, F.format_string("<LINK rel='image_src' href='http://img.example.com%s'/>", "href"))
    html = pages.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", tags.alias("t")))), lambda s: s["t"]), "\n").alias("html"))
    return scan.advertised_images(html)


@query("src_04_text_link_scan", views.sql(r"""
with w as (select page_id as doc_id, 0 as para_index, 0 as kind_order, 0 as pos, 'hyperlink' as kind, url from pages
  union all select page_id, 0, 1, 0, 'field', url from pages where page_id % 3 = 0
  union all select page_id, 0, 2, 0, 'code', url || case when page_id % 2 = 0 then '' else '#c' end from pages
  union all select page_id, 0, 3, 0, 'bare', rtrim(url, '.,);]}') from pages union all select page_id, 0, 3, 1, 'bare', url || '/b' from pages),
r as (select *, row_number() over (partition by doc_id, para_index, url order by kind_order, pos) as n from w)
select doc_id, para_index, kind_order, pos, kind, url from r where kind = 'hyperlink' or n = 1""", ))
def _(spark, d):
    base = views.read(spark, d, "pages").selectExpr("page_id AS doc_id", "0 AS para_index", "0 AS pos", "url")
    codes = base.withColumn("url", F.concat("url", F.when(F.col("doc_id") % 2 == 0, "").otherwise("#c")))
    text = base.select("doc_id", "para_index", F.concat(F.lit("see ("), "url", F.lit("), and "), "url", F.lit("/b.")).alias("text"))
    return scan.text_links(base, base.where("doc_id % 3 = 0"), codes, scan.bare_urls(text))


@query("flt_05_url_safety", rf"""
with p as (select page_id, case page_id % 6 when 1 then 'http://10.0.0.' || page_id % 9 || '/x' when 2 then 'https://u:p@media.example.org/' when 3 then replace(url, 'http:', 'https:') when 4 then 'http://printer.local/a' when 5 then 'https://cdn.example.com:8443/z' else url end as u from pages),
q as (select page_id, u, regexp_extract(u, {_URL}, 1) as s, regexp_extract(u, {_URL}, 2) as n, lower(regexp_extract(u, {_URL}, 3)) as h, regexp_extract(u, {_URL}, 4) as po from p)
select page_id, s in ('http','https') and n = '' and h <> '' and not ends_with(h, '.local') and not starts_with(h, '10.') as is_public,
       s = 'https' and n = '' and po in ('', '443') and (h in ('example.com','example.org') or ends_with(h, '.example.com') or ends_with(h, '.example.org')) as trusted from q""")
def _(spark, d):
    url = F.expr("CASE page_id % 6 WHEN 1 THEN concat('http://10.0.0.', page_id % 9, '/x') WHEN 2 THEN 'https://u:p@media.example.org/' WHEN 3 THEN replace(url, 'http:', 'https:') WHEN 4 THEN 'http://printer.local/a' WHEN 5 THEN 'https://cdn.example.com:8443/z' ELSE url END")
    return views.read(spark, d, "pages").select("page_id", urls.is_public(url).alias("is_public"), urls.trusted(url, ["example.com", "example.org"], subdomains=True).alias("trusted"))


_VARIED = "case page_id % 7 when 1 then url || '/photo.JPG' when 2 then 'https://www.freepik.com/free-photo/blue-sky_' || page_id || '.htm' when 3 then 'https://images.example.com/a' when 4 then 'https://example.com/photos/' || page_id when 5 then 'https://example.com/v?image=a.png' else url end"


def _varied():
    return F.expr("CASE page_id % 7 WHEN 1 THEN concat(url, '/photo.JPG') WHEN 2 THEN concat('https://www.freepik.com/free-photo/blue-sky_', page_id, '.htm') WHEN 3 THEN 'https://images.example.com/a' WHEN 4 THEN concat('https://example.com/photos/', page_id) WHEN 5 THEN 'https://example.com/v?image=a.png' ELSE url END")


@query("fn_08_source_type", f"select page_id, case when page_id % 7 = 2 then 'freepik' else 'direct' end as source_type from pages")
def _(spark, d):
    return views.read(spark, d, "pages").select("page_id", urls.source_type(_varied()).alias("source_type"))


@query("fn_09_looks_like_image", r"select page_id, case when page_id % 7 = 1 then not contains(url, '?') and not contains(url, '#') or page_id % 4 = 0 when page_id % 7 in (2, 3, 4, 5) then true else page_id % 4 = 0 end as image from pages")
def _(spark, d):
    label = F.when(F.col("page_id") % 4 == 0, "the screenshots").otherwise("imagery")
    return views.read(spark, d, "pages").select("page_id", urls.looks_like_image(_varied(), label).alias("image"))


@query("fn_10_resource_id", rf"""
select page_id, case when page_id % 7 = 2 then page_id end as rid,
  trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(rtrim(regexp_extract(u, {_URL}, 5), '/'), '([^/]*)$', 1), '(?i)\.html?$', ''), '_\d+$', '')), '[^a-z0-9]+', '-', 'g'), '-') as slug
from (select page_id, {_VARIED} as u from pages)""")
def _(spark, d):
    return views.read(spark, d, "pages").select("page_id", urls.resource_id(_varied()).alias("rid"), urls.resource_slug(_varied()).alias("slug"))


@query("fn_07_link_text", views.sql(r"select page_id, link_pos, trim(regexp_replace(regexp_replace(chr(8203) || label || chr(173) || '  x', '[\x{ad}\x{200b}-\x{200f}\x{2060}\x{feff}]', '', 'g'), '\s+', ' ', 'g')) as clean from link", "link"))
def _(spark, d):
    return views.links(spark, d).select("page_id", "link_pos", tx.link_text(F.concat(F.lit("​"), "label", F.lit("­  x"))).alias("clean"))


@query("fn_18_search_links", views.sql(r"select chapter, para_index, 'https://www.freepik.com/search?query=' || replace(e, '%20', '+') as freepik, 'https://www.pexels.com/search/' || e || '/' as pexels, 'https://stocksnap.io/search/' || replace(e, '%20', '+') as stocksnap, 'https://pixabay.com/images/search/' || e || '/' as pixabay from (select *, replace(url_encode(query), '''', '%27') as e from plan)", "plan"))
def _(spark, d):
    return views.plans(spark, d).withColumn("s", urls.search_links(F.col("query"))).select("chapter", "para_index", "s.*")


@query("fn_05_placeholder_number", views.sql(r"select page_id, link_pos, case when page_id % 3 <> 2 and number is not null then number::bigint end as placeholder from link", "link"))
def _(spark, d):
    text = F.expr("CASE page_id % 3 WHEN 0 THEN concat('Image ', number) WHEN 1 THEN concat('Unit 12 Chapter 1 \u200bIMAGE 0', number, '.') ELSE concat('see Image ', number, ' here') END")
    return views.links(spark, d).select("page_id", "link_pos", tx.placeholder_number(text).alias("placeholder"))


@query("win_13_link_numbering", views.sql("""
with a as (select *, number is not null and row_number() over (partition by page_id, number order by link_pos) = 1 as claim, first_value(href) over (partition by page_id, number order by link_pos) as u, coalesce(max(number) over (partition by page_id), 0) as top from link)
select page_id, link_pos, (case when claim then number else top + sum((not claim)::int) over (partition by page_id order by link_pos) end)::bigint as final_number, claim as numbered, number is not null and not claim and href <> u as reused from a""", "link"))
def _(spark, d):
    out = matching.number_links(views.links(spark, d).withColumnsRenamed({"page_id": "doc_id", "link_pos": "pos"}))
    return out.select(F.col("doc_id").alias("page_id"), F.col("pos").cast("long").alias("link_pos"), "final_number", "numbered", "reused")


@query("jn_06_manual_override", views.sql("select page_id as doc_id, link_pos::bigint as pos, case when number = 1 then 'manual' else 'link' end as status from link", "link"))
def _(spark, d):
    rows = views.links(spark, d).selectExpr("page_id AS doc_id", "cast(link_pos AS long) AS pos", "number")
    manual = rows.where("number = 1").select("doc_id", "number").distinct()
    return matching.with_override(rows, manual).select("doc_id", "pos", "status")


@query("agg_02_link_status_counts", views.sql("select page_id as doc_id, count(*) filter (number = 1) as manual, count(*) filter (number is distinct from 1) as link from link group by 1", "link"))
def _(spark, d):
    rows = views.links(spark, d).selectExpr("page_id AS doc_id", "number")
    told = matching.with_override(rows, rows.where("number = 1").select("doc_id", "number").distinct())
    return told.groupBy("doc_id").pivot("status", ["manual", "link"]).count().na.fill(0)


@query("agg_05_placeholder_counts", views.sql("select doc_id, number, count(*) as n, count(*) > 1 as repeated from wanted group by 1, 2", "wanted"))
def _(spark, d):
    return views.wanted(spark, d).groupBy("doc_id", "number").agg(F.count("*").alias("n")).withColumn("repeated", F.col("n") > 1)


@query("jn_03_nth_occurrence_anchor", views.sql("""
with l as (select page_id as doc_id, link_pos as pos, href as url, number, label, row_number() over (partition by page_id, href order by link_pos) as k, row_number() over (partition by page_id, label order by link_pos) as j from link),
a as (select page_id as doc_id, link_pos + 100 as para_index, case when link_pos % 3 <> 1 then href end as url, case when link_pos % 4 = 0 then 'see image 01 ' || label else label end as text from link),
p as (select *, row_number() over (partition by doc_id, url order by para_index) as k from a where url is not null),
t as (select *, row_number() over (partition by doc_id, text order by para_index) as j from a where text <> ''),
n as (select l.doc_id, l.pos, min(p.para_index) as x from l join p using (doc_id, url) where l.k = 1 and l.number = 1 and contains(p.text, 'image 01 ') group by 1, 2)
select l.doc_id, l.pos::bigint as pos, coalesce(n.x, p.para_index, t.para_index)::bigint as anchor from l left join p on p.doc_id = l.doc_id and p.url = l.url and p.k = l.k left join n on n.doc_id = l.doc_id and n.pos = l.pos left join t on t.doc_id = l.doc_id and t.text = l.label and t.j = l.j""", "link"))
def _(spark, d):
    base = views.links(spark, d)
    rows = base.selectExpr("page_id AS doc_id", "cast(link_pos AS long) AS pos", "href AS url", "number", "label")
    anchors = base.selectExpr("page_id AS doc_id", "cast(link_pos + 100 AS long) AS para_index", "CASE WHEN link_pos % 3 <> 1 THEN href END AS url", "CASE WHEN link_pos % 4 = 0 THEN concat('see image 01 ', label) ELSE label END AS text")
    return matching.nth_anchor(rows, anchors).select("doc_id", "pos", "anchor")


# files

_PICK = r"""pick as (select * from (select *, row_number() over (partition by batch_id, number order by case when regexp_matches(lower(regexp_extract(filename, '^(.+)\.[^.]+$', 1)), '^\d*[1-9]\d*$') then 0 else 1 end,
  case when filename like '%.jpg' then 0 when filename like '%.png' then 2 else 9 end, lower(filename), filename, file_id) as n from files where filename not like '%.txt') where n = 1)"""


def _chosen(spark, d):
    return matching.pick_per_number(views.files(spark, d).where("filename NOT LIKE '%.txt'"))


@query("win_15_pick_per_number", views.sql(f"with {_PICK} select batch_id, number, filename, file_id from pick", "files"))
def _(spark, d):
    return _chosen(spark, d).select("batch_id", "number", "filename", "file_id")


@query("jn_01_placeholder_match", views.sql(f"with {_PICK} select w.doc_id, w.pos::bigint as pos, w.number, p.filename from wanted w left join pick p on p.batch_id = w.doc_id and p.number = w.number", "wanted", "files"))
def _(spark, d):
    return matching.placements(views.wanted(spark, d), _chosen(spark, d)).select("doc_id", "pos", "number", "filename")


@query("jn_02_missing_unused", views.sql(f"""with {_PICK} select coalesce(w.doc_id, p.batch_id) as doc_id, coalesce(w.number, p.number) as number, case when p.number is null then 'missing' else 'unused' end as side
from (select distinct doc_id, number from wanted) w full join pick p on p.batch_id = w.doc_id and p.number = w.number where w.number is null or p.number is null""", "wanted", "files"))
def _(spark, d):
    return matching.missing_and_unused(views.wanted(spark, d), _chosen(spark, d))


@query("jn_05_survival_audit", views.sql("""
with i as (select distinct doc_id, number as rid from wanted), n as (select doc_id, number as rid from wanted where pos % 3 <> 0 group by all), m as (select batch_id as doc_id, number as rid from files group by all)
select i.doc_id, count(*) filter (n.rid is not null and m.rid is not null) as survived, coalesce(string_agg(case when n.rid is null or m.rid is null then i.rid::varchar end, ',' order by i.rid), '') as lost
from i left join n using (doc_id, rid) left join m using (doc_id, rid) group by 1""", "wanted", "files"))
def _(spark, d):
    want = views.wanted(spark, d)
    media = views.files(spark, d).selectExpr("batch_id AS doc_id", "number AS rid")
    return matching.survival(want.selectExpr("doc_id", "number AS rid").distinct(), want.where("pos % 3 <> 0").selectExpr("doc_id", "number AS rid"), media)


@query("agg_09_duplicate_names", views.sql("select batch_id, number, count(*) as n_files, string_agg(filename, '|' order by lower(filename), filename) as names from files group by 1, 2 having count(*) > 1", "files"))
def _(spark, d):
    return aggregates.duplicate_numbers(views.files(spark, d))


@query("top_05_name_order", views.sql("select batch_id, file_id, row_number() over (partition by batch_id order by number, lower(filename), file_id)::bigint as place from files", "files"))
def _(spark, d):
    order = W.partitionBy("batch_id").orderBy("number", F.lower("filename"), "file_id")
    return views.files(spark, d).withColumn("place", F.row_number().over(order).cast("long")).select("batch_id", "file_id", "place")


@query("flt_07_size_bounds", views.sql("select file_id, width >= 450 and height >= 300 and width * height <= 65000000 as usable, width::bigint * height * 10 <= 50000000 and bytes between 1 and 25000000 as safe, case when width / 10.0 between 36 and 600 then width / 10.0 else 96 end::double as dpi from files", "files"))
def _(spark, d):
    return views.files(spark, d).select("file_id", filters.size_bounds(F.col("width"), F.col("height")).alias("usable"), filters.safe_to_open(F.col("width") * 10, F.col("height"), F.col("bytes")).alias("safe"), filters.plausible_dpi(F.col("width") / 10).alias("dpi"))


@query("fn_06_filename_number", views.sql("select file_id, case when file_id % 3 in (0, 1) then number::bigint end as n from files", "files"))
def _(spark, d):
    return views.files(spark, d).select("file_id", tx.file_number(F.col("filename")).alias("n"))


@query("fn_19_safe_names", views.sql(r"select file_id, left(trim(regexp_replace('../é ' || filename || ' .', '[^a-zA-Z0-9 _.-]', '_', 'g'), ' .'), 120) as safe, trim(regexp_replace(regexp_replace(regexp_extract(filename, '^(.+)\.[^.]+$', 1), '[_-]+', ' ', 'g'), '\s+', ' ', 'g')) as title from files", "files"))
def _(spark, d):
    return views.files(spark, d).select("file_id", tx.safe_name(F.concat(F.lit("../é "), "filename", F.lit(" ."))).alias("safe"), tx.friendly_title(F.col("filename")).alias("title"))


@query("fn_20_chapter_number", views.sql(r"""select file_id, coalesce(nullif(regexp_extract(s, '(?i)(?:chapter|unit|module)\s*(\d+[a-zA-Z]?)\b', 1), ''), nullif(regexp_extract(s, '(?i)^(\d+[a-zA-Z]?)\b', 1), ''), lpad(i::varchar, greatest(2, length(i::varchar))::int, '0')) as chapter_no
from (select file_id, file_id % 120 as i, regexp_extract(filename, '^(.+)\.[^.]+$', 1) as s from files)""", "files"))
def _(spark, d):
    return views.files(spark, d).select("file_id", tx.chapter_number(F.col("filename"), F.col("file_id") % 120).alias("chapter_no"))


_PATHS = "case file_id % 8 when 0 then '../' when 1 then '/abs/' when 2 then 'C:/x/' when 3 then '__MACOSX/' when 4 then 'a\\b\\' when 5 then 'dir/.' else 'dir/' end || filename"


@query("flt_03_safe_path", views.sql("select file_id, file_id % 8 >= 4 as safe, file_id % 8 in (3, 5) as ignored from files", "files"))
def _(spark, d):
    path = F.concat(F.expr(r"CASE file_id % 8 WHEN 0 THEN '../' WHEN 1 THEN '/abs/' WHEN 2 THEN 'C:/x/' WHEN 3 THEN '__MACOSX/' WHEN 4 THEN 'a\\b\\' WHEN 5 THEN 'dir/.' ELSE 'dir/' END"), F.col("filename"))
    return views.files(spark, d).select("file_id", filters.safe_path(path).alias("safe"), filters.ignored_member(path).alias("ignored"))


@query("flt_04_skip_documents", views.sql("select file_id, file_id % 5 in (0, 1) as skipped from files", "files"))
def _(spark, d):
    name = F.concat(F.expr("CASE file_id % 5 WHEN 0 THEN 'Unit_1_Assignment-Brief_' WHEN 1 THEN 'written_assignment__template-' WHEN 2 THEN 'assignments brief ' ELSE '' END"), F.col("filename"))
    return views.files(spark, d).select("file_id", tx.is_skipped_document(name).alias("skipped"))


@query("win_14_running_caps", views.sql("""
with f as (select batch_id, file_id, filename, bytes, row_number() over (partition by batch_id, lower(filename) order by file_id) as s from files where bytes <= 25000000),
r as (select *, count(*) over w as n, sum(bytes) over w as t from f where s = 1 window w as (partition by batch_id order by file_id))
select batch_id, file_id from r where n <= 160 and t <= 60000000""", "files"))
def _(spark, d):
    rows = views.files(spark, d).withColumnsRenamed({"batch_id": "archive", "filename": "path", "file_id": "pos"})
    return sampling.running_caps(rows, whole=60_000_000).select(F.col("archive").alias("batch_id"), F.col("pos").alias("file_id"))


@query("win_21_unique_names", views.sql(r"""
f as (select batch_id, file_id, case file_id % 4 when 0 then 'Image 1_2.jpg' when 1 then 'image 1.jpg' else filename end as filename from files),
q as (select *, regexp_extract(filename, '^(.+)\.[^.]+$', 1) as stem, regexp_extract(filename, '^.+(\.[^.]+)$', 1) as ext, row_number() over (partition by batch_id order by file_id) as nth from f),
w as (select batch_id, 0::bigint as nth, []::varchar[] as used, null::varchar as pick from (select distinct batch_id from q)
  union all select w.batch_id, q.nth, list_append(w.used, lower(x)), x from w join q on q.batch_id = w.batch_id and q.nth = w.nth + 1,
    lateral (select list_filter(list_concat([q.filename], list_transform(range(2, 12), lambda k: q.stem || '_' || k || q.ext)), lambda c: not list_contains(w.used, lower(c)))[1] as x) t)
select q.batch_id, q.file_id, q.filename, w.pick as unique_name from q join w using (batch_id, nth)""", "files", recursive=True))
def _(spark, d):
    rows = views.files(spark, d).withColumn("filename", F.when(F.col("file_id") % 4 == 0, "Image 1_2.jpg").when(F.col("file_id") % 4 == 1, "image 1.jpg").otherwise(F.col("filename")))
    return sampling.unique_names(rows, "batch_id", "file_id").select("batch_id", "file_id", "filename", "unique_name")


@query("agg_01_batch_outcome", views.sql("""
select batch_id, count(*) as detected, count(*) filter (s = 'formatted') as formatted, count(*) filter (s = 'skipped') as skipped, count(*) filter (s = 'failed') as failed, sum(number)::bigint as links,
  coalesce(string_agg(case when s = 'skipped' then filename end, '|' order by filename), '') as skipped_names, coalesce(string_agg(case when s = 'failed' then filename end, '|' order by filename), '') as failed_names
from (select *, case when filename like '%.txt' then 'skipped' when width > 4500 then 'failed' else 'formatted' end as s from files) group by 1""", "files"))
def _(spark, d):
    status = F.when(F.col("filename").endswith(".txt"), "skipped").when(F.col("width") > 4500, "failed").otherwise("formatted")
    return aggregates.batch_outcome(views.files(spark, d).withColumns({"status": status, "links": F.col("number").cast("long")}))


@query("agg_12_next_id", "select (max(page_id) + 1)::int as next_id from pages")
def _(spark, d):
    ids = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("rId"), "page_id")).otherwise(F.col("page_id").cast("string"))
    rows = views.read(spark, d, "pages")
    return aggregates.next_id(rows.select(ids.alias("id")).unionByName(rows.selectExpr("cast(page_id AS string) AS id")), "id")


@query("jn_04_reference_lookup", "select n_nationkey, n_name, coalesce(r_name, 'none') as r_name from nation left join (select * from region where r_regionkey <> 2) on r_regionkey = n_regionkey")
def _(spark, d):
    nation, region = views.read(spark, d, "nation"), views.read(spark, d, "region").where("r_regionkey <> 2")
    first = nation.selectExpr("n_nationkey", "n_regionkey AS r_regionkey")
    return matching.two_hop(nation.select("n_nationkey", "n_name"), first, region, "n_nationkey", "r_regionkey", "r_name", "none").select("n_nationkey", "n_name", "r_name")


@query("jn_15_overlay_coalesce", "select page_id, case when page_id % 3 = 0 then upper(url) else url end as url, page_id % 3 = 0 as edited from pages")
def _(spark, d):
    base = views.read(spark, d, "pages").select("page_id", "url")
    return matching.overlaid(base, base.where("page_id % 3 = 0").withColumn("url", F.upper("url")), "page_id", "url").select("page_id", "url", "edited")


# subjects

TEST_RULES = [("tion", "thth|tion"), ("eau", "eau|ment"), ("sch", "sch|ung")]
_WHOLE = "select doc_id, coalesce(text, '') as line from documents"


def _whole_texts(spark, d):
    return views.read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("line"))


@query("jn_09_first_rule_match", f"select doc_id, case when regexp_matches(line, 'thth|tion') then 'tion' when regexp_matches(line, 'eau|ment') then 'eau' when regexp_matches(line, 'sch|ung') then 'sch' end as rule from ({_WHOLE})")
def _(spark, d):
    return matching.first_rule(_whole_texts(spark, d), TEST_RULES, "line").select("doc_id", "rule")


@query("jn_09_rule_table", f"select doc_id, value from (select doc_id, case when regexp_matches(line, 'thth|tion') then 'tion' when regexp_matches(line, 'eau|ment') then 'eau' when regexp_matches(line, 'sch|ung') then 'sch' end as value from ({_WHOLE})) where value is not null")
def _(spark, d):
    table = spark.createDataFrame([(i, p, v) for i, (v, p) in enumerate(TEST_RULES)], "rule_order int, pattern string, value string")
    return matching.first_rule_of_table(_whole_texts(spark, d), table, "doc_id", "line")


_DOMAIN = "case when regexp_matches({0}, 'thth|tion') then 'tion' when regexp_matches({0}, 'eau|ment') then 'eau' when regexp_matches({0}, 'sch|ung') then 'sch' end"


@query("fn_15_find_domain", views.sql(f"""
with x as (select chapter, para_index, lower(case when para_index % 3 = 0 then 'Unit ' || chapter else heading end) as t, lower(heading || ' ' || left(excerpt, 220) || ' ') as c from plan),
y as (select *, length(t) < 8 or regexp_matches(t, '^(?:unit|chapter|module|lesson|part|course|section|\\d|[^\\p{{L}}\\p{{N}}_])+$') as g from x),
z as (select *, {_DOMAIN.format("case when g then c else t end")} as a, {_DOMAIN.format("c")} as b from y)
select chapter, para_index, coalesce(case when a = 'eau' and b <> 'eau' then b else a end, b) as domain from z""", "plan"))
def _(spark, d):
    title = F.when(F.col("para_index") % 3 == 0, F.concat(F.lit("Unit "), F.col("chapter").cast("string"))).otherwise(F.col("heading"))
    told = rules.domain_of(title, F.col("heading"), F.col("excerpt"), F.lit(""), TEST_RULES, retry="eau")
    return views.plans(spark, d).select("chapter", "para_index", told.alias("domain"))


_PHRASES = ("report", "risk", "hygiene", "listen to", "conflict", "record", "plan", "")
_SUBJECTS = tuple(scenes.FALLBACK)


def _scene_sql() -> str:
    """The tables of scenes as one chain of conditions on d (discipline) and a (what the heading says): search, scene and kind."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    told = lambda kind, search, scene: f"{{'q': {quoted(search)}, 's': {quoted(scene)}, 'k': {kind}}}"
    parts = []
    for d, last in scenes.FALLBACK.items():
        own = "".join(f"when regexp_matches(a, {quoted('(?i)(?:' + p + ')')}) then {told(0, q, x)} " for p, q, x in scenes.SCENES.get(d, ()))
        own += f"when regexp_matches(a, '{scenes.CONFLICT_PATTERN}') then {told(1, *scenes.CONFLICTS[d])} " if d in scenes.CONFLICTS else ""
        parts.append(f"when {quoted(d)} then case {own}else {told(2, *last)} end" if own else f"when {quoted(d)} then {told(2, *last)}")
    return f"case d {' '.join(parts)} end"


def _worded_sql(piece: int) -> str:
    return f"list_value({', '.join(chr(39) + w[piece].replace(chr(39), chr(39) * 2) + chr(39) for w in scenes.WORDING)})[x.k + 1]"


@query("fn_17_scene", views.sql(f"""
with x as (select chapter, para_index, excerpt, list_value{_SUBJECTS}[chapter % {len(_SUBJECTS)} + 1] as d, list_value{_PHRASES}[(chapter + para_index) % {len(_PHRASES)} + 1] || ' ' || heading as h from plan),
y as (select *, lower(trim(h)) || case when len(regexp_extract_all(lower(h), '[a-zA-Z]{{3,}}')) <= 2 then ' ' || lower(left(excerpt, 240)) else '' end as a from x),
z as (select *, {_scene_sql()} as x from y)
select chapter, para_index, d as domain, x.q as search, {_worded_sql(0)} || h || {_worded_sql(1)} || 'Course ' || chapter || {_worded_sql(2)} || x.s || {_worded_sql(3)} as description from z""", "plan"))
def _(spark, d):
    pick = lambda words, at: F.get(F.array(*map(F.lit, words)), F.expr(at).cast("int"))
    rows = views.plans(spark, d).withColumns({"domain": pick(_SUBJECTS, f"chapter % {len(_SUBJECTS)}"), "h": F.concat(pick(_PHRASES, f"(chapter + para_index) % {len(_PHRASES)}"), F.lit(" "), "heading")})
    course = F.concat(F.lit("Course "), F.col("chapter").cast("string"))
    scene = rules.scene_of(F.col("domain"), F.col("h"), F.col("excerpt"), scenes.SCENES, scenes.CONFLICTS, scenes.FALLBACK, scenes.CONFLICT_PATTERN, course, scenes.WORDING)
    return rows.select("chapter", "para_index", "domain", scene.alias("scene")).select("chapter", "para_index", "domain", "scene.search", "scene.description")


@query("agg_10_domain_consensus", views.sql(f"""
select chapter, case when count(distinct domain) = 1 then max(domain) end as domain from (select chapter, {_DOMAIN.format("lower(heading)")} as domain from plan) group by 1""", "plan"))
def _(spark, d):
    rows = matching.first_rule(views.plans(spark, d).withColumn("h", F.lower("heading")), TEST_RULES, "h", "domain")
    return aggregates.consensus(rows, "chapter", "domain")


_IGN = ", ".join(f"'{w}'" for w in dict.fromkeys(rules.IGNORED_WORDS))


def concepts_sql(column: str) -> str:
    cases = " ".join(f"when regexp_matches(w, '^(?:{p})') then '{n}'" for p, n in rules.CONCEPTS)
    word = f"case {cases} when length(w) > 5 and not ends_with(w, 'ss') then rtrim(w, 's') else w end"
    return f"list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(lower({column}), '[a-z]{{3,}}'), lambda w: not list_contains([{_IGN}], w)), lambda w: {word}), lambda c: c <> '_stop'))"


_MIXED = "caption || case pos % 5 when 0 then ' Managers meeting office' when 1 then ' classes' when 2 then ' photographs of nurses' else '' end"


@query("fn_12_concepts", views.sql(f"select identifier, array_to_string(list_sort({concepts_sql(_MIXED)}), ' ') as concepts from cand", "cand"))
def _(spark, d):
    text = F.concat("caption", F.expr("CASE pos % 5 WHEN 0 THEN ' Managers meeting office' WHEN 1 THEN ' classes' WHEN 2 THEN ' photographs of nurses' ELSE '' END"))
    return views.candidates(spark, d).select("identifier", F.array_join(F.array_sort(rules.concepts(text)), " ").alias("concepts"))


_RANKED = f"""
with p as (select chapter, para_index, q as c, {concepts_sql("excerpt")} as s from (select *, {concepts_sql("query")} as q from plan) where chapter % 10 < 10),
k as (select identifier, source, pos, {concepts_sql("caption")} as c from cand),
pe as (select *, unnest(c) as concept from p), ke as (select identifier, concept from (select identifier, unnest(c) as concept from k)),
m as (select chapter, para_index, identifier, count(*) as n, bool_or(concept in ('business','office','team','meeting','staff','computer')) as g from pe join ke using (concept) group by 1, 2, 3),
r as (select m.chapter, m.para_index, m.identifier, k.source, k.pos, (4 * m.n + least(2, len(list_intersect(k.c, p.s))))::int as rank
  from m join p using (chapter, para_index) join k using (identifier) where not (m.n = 1 and len(p.c) >= 2 and m.g))
"""


def _asked(spark, d):
    """Plans with the concepts of their query and of their text, worked out once."""
    return settle(views.plans(spark, d).select("chapter", "para_index", rules.concepts(F.col("query")).alias("concepts"), rules.concepts(F.col("excerpt")).alias("subject")))


def _offered(spark, d):
    return settle(views.candidates(spark, d).select("identifier", "source", "pos", rules.concepts(F.col("caption")).alias("caption_concepts")))


def _ranked(spark, d):
    return ranking.concept_matches(_asked(spark, d), _offered(spark, d), ["chapter", "para_index"])


@query("jn_08_concept_match", views.sql(_RANKED + "select * from r", "plan", "cand"))
def _(spark, d):
    return _ranked(spark, d)


@query("fn_13_rank_score", views.sql(_RANKED + "select rank, count(*) as n from r group by 1", "plan", "cand"))
def _(spark, d):
    return _ranked(spark, d).groupBy("rank").agg(F.count("*").alias("n"))


@query("top_01_top5_per_query", views.sql(_RANKED + "select chapter, para_index, source, identifier, rank, row_number() over (partition by chapter, para_index, source order by rank desc, pos, identifier)::int as place from r qualify place <= 5", "plan", "cand"))
def _(spark, d):
    top = ranking.top_matches(_asked(spark, d), _offered(spark, d), ["chapter", "para_index"], 5)
    return top.select("chapter", "para_index", "source", "identifier", "rank", "place")


_SOURCES = ("library", "pexels", "pixabay", "openverse", "freepik")


@query("top_02_source_fallback", views.sql(_RANKED + f""",
v as (select * replace (list_value{_SOURCES}[5 - pos % 5] as source) from r),
b as (select *, row_number() over (partition by chapter, para_index order by list_position(list_value{_SOURCES}, source), rank desc, pos, identifier) as x from v),
c as (select *, sum((source = 'freepik')::int) over (partition by chapter order by para_index) as paid from b where x = 1)
select chapter, para_index, source, identifier, true as opted from c where source <> 'freepik' or paid <= 1
union all select chapter, para_index, source, identifier, false from b where source <> 'freepik' qualify row_number() over (partition by chapter, para_index order by x) = 1""", "plan", "cand"))
def _(spark, d):
    cand = _offered(spark, d).withColumn("source", F.get(F.array(*map(F.lit, _SOURCES)), (4 - F.col("pos") % 5).cast("int")))
    rows = settle(ranking.top_matches(_asked(spark, d), cand, ["chapter", "para_index"], 1).drop("place"))
    opted = ranking.first_source(rows, ["chapter", "para_index"], list(_SOURCES), paid="freepik", budget=1).withColumn("opted", F.lit(True))
    free = ranking.first_source(rows, ["chapter", "para_index"], list(_SOURCES[:4])).withColumn("opted", F.lit(False))
    return opted.unionByName(free).select("chapter", "para_index", "source", "identifier", "opted")


def _matched_sql(query: str) -> str:
    """Plans and candidates by the concepts of a query, as in _RANKED."""
    return f"""(select p.chapter, p.para_index, k.identifier, 4 * p.n as rank from (
      select chapter, para_index, identifier, count(*) as n, any_value(len(c)) as m, bool_or(concept in {rules.GENERIC_CONCEPTS}) as g
      from (select *, unnest(c) as concept from (select chapter, para_index, {concepts_sql(query)} as c from asked)) join ke using (concept) group by 1, 2, 3) p join k using (identifier)
      where not (p.n = 1 and p.m >= 2 and p.g))"""


@query("top_03_broader_query_retry", views.sql(f"""
with asked as (select chapter, para_index, case para_index % 3 when 1 then 'safeguarding' when 2 then 'practitioner safeguarding' else query end as q1, case para_index % 3 when 1 then 'care' when 2 then 'worker care' else query end as q2 from plan),
k as (select identifier, {concepts_sql("caption || case pos % 7 when 0 then ' care worker' else '' end")} as c from cand), ke as (select identifier, unnest(c) as concept from k),
one as {_matched_sql("q1")}, two as {_matched_sql("q2")}
select *, 1 as attempt from one union all select *, 2 from two where q2_new(chapter, para_index)""".replace("where q2_new(chapter, para_index)", "where (chapter, para_index) not in (select chapter, para_index from one) and (chapter, para_index) in (select chapter, para_index from asked where q1 <> q2)"), "plan", "cand"))
def _(spark, d):
    query = F.expr("CASE para_index % 3 WHEN 1 THEN 'safeguarding' WHEN 2 THEN 'practitioner safeguarding' ELSE query END")
    plans = views.plans(spark, d).select("chapter", "para_index", query.alias("query"), F.array().cast("array<string>").alias("subject"))
    text = F.concat("caption", F.when(F.col("pos") % 7 == 0, " care worker").otherwise(""))
    cand = settle(views.candidates(spark, d).select("identifier", "source", "pos", rules.concepts(text).alias("caption_concepts")))
    return ranking.with_wider_query(plans, cand, ["chapter", "para_index"]).select("chapter", "para_index", "identifier", F.col("rank").cast("long").alias("rank"), "attempt")


@query("top_04_greedy_unique_assign", views.sql(_RANKED + """,
t as (select chapter, para_index, list(identifier order by rank desc, pos, identifier)[1:5] as best from r group by 1, 2),
q as (select *, row_number() over (partition by chapter order by para_index) as nth from t),
w as (select chapter, 0::bigint as nth, []::varchar[] as used, null::varchar as pick from (select distinct chapter from q)
  union all select w.chapter, q.nth, case when x is null then w.used else list_append(w.used, x) end, x from w join q on q.chapter = w.chapter and q.nth = w.nth + 1,
    lateral (select list_filter(q.best, lambda c: not list_contains(w.used, c))[1] as x) y)
select chapter, para_index, pick as identifier from q join w using (chapter, nth) where pick is not null""", "plan", "cand", recursive=True))
def _(spark, d):
    plans = _asked(spark, d)
    top = ranking.top_matches(plans, _offered(spark, d), ["chapter", "para_index"], 5, by_source=False)
    ranked = top.select("chapter", "para_index", "identifier", F.col("place").alias("rank"))
    queue = plans.select("chapter", "para_index", F.col("para_index").alias("turn"))
    return sampling.greedy_unique(queue, ranked, "chapter", "para_index", "turn")


@query("set_01_concept_intersection", views.sql(f"select chapter, para_index, len(list_intersect(q, e)) as shared, len(list_filter(q, lambda x: not list_contains(e, x))) as only_query from (select *, {concepts_sql('query')} as q, {concepts_sql('excerpt')} as e from plan)", "plan"))
def _(spark, d):
    q, e = rules.concepts(F.col("query")), rules.concepts(F.col("excerpt"))
    rows = views.plans(spark, d).withColumns({"q": q, "e": e})
    return rows.select("chapter", "para_index", F.size(F.array_intersect("q", "e")).cast("long").alias("shared"), F.size(F.array_except("q", "e")).cast("long").alias("only_query"))


@query("set_03_grounding_difference", views.sql(f"select chapter, para_index, array_to_string(list_sort(list_distinct(list_filter({views.tokens_sql('heading')}, lambda t: not list_contains(['thth', 'tion', 'est', 'und', 'les'], t)))), ' ') as grounding from plan", "plan"))
def _(spark, d):
    stop = F.array(*[F.lit(w) for w in ("thth", "tion", "est", "und", "les")])
    return views.plans(spark, d).select("chapter", "para_index", F.array_join(F.array_sort(F.array_except(tx.tokens(F.col("heading")), stop)), " ").alias("grounding"))


@query("fn_14_broader_query", views.sql("select chapter, para_index, case when len(w) = 0 then 'review reviewing' else array_to_string(list_slice(list_concat(['review', 'reviewing'], w), 1, 4), ' ') end as wider from (select *, list_filter(str_split(query, ' '), lambda x, i: x <> '' and list_position(str_split(query, ' '), x) = i and x not in ('review', 'reviewing')) as w from plan)", "plan"))
def _(spark, d):
    return views.plans(spark, d).select("chapter", "para_index", rules.wider_query(F.concat(F.lit("Reviewing thoughtful  Evaluating "), "query")).alias("wider"))


@query("fn_16_lock_query", views.sql("select chapter, para_index, left(case chapter % 3 when 0 then 'care worker ' || query when 1 then trim('nurse ' || query) else 'old ' || query end, 110) as locked from plan", "plan"))
def _(spark, d):
    domain = F.expr("CASE chapter % 3 WHEN 2 THEN cast(null AS string) ELSE 'adult_safeguarding' END")
    text = F.concat(F.expr("CASE chapter % 3 WHEN 0 THEN '' WHEN 1 THEN 'nurse ' ELSE 'old ' END"), F.col("query"))
    return views.plans(spark, d).select("chapter", "para_index", rules.locked_query(text, domain).alias("locked"))


def _answers(spark, d):
    """Each candidate as the one-item answer of a catalogue, in that catalogue's JSON."""
    cand = views.candidates(spark, d).withColumns({"n": F.col("pos").cast("string"), "size": F.coalesce("width", F.lit(700)), "tall": F.coalesce("height", F.lit(400))})
    items = [
        ("pexels", "named_struct('photos', array(named_struct('id', pos, 'alt', caption, 'url', concat('https://p.test/a-', n), 'photographer', repeat('ab', cast(pos % 60 AS int)), 'src', named_struct('large', concat('https://i.test/', n)))))"),
        ("pixabay", "named_struct('hits', array(named_struct('id', pos, 'tags', caption, 'largeImageURL', '', 'webformatURL', concat('https://w.test/', n), 'pageURL', concat('https://x.test/', n), 'user', 'u')))"),
        ("openverse", "named_struct('results', array(named_struct('id', n, 'license', CASE WHEN pos % 3 = 0 THEN 'by' ELSE 'CC0' END, 'width', size, 'height', tall, 'url', 'https://o.test/', 'title', caption, 'tags', array(named_struct('name', 'one'), named_struct('name', 'two')))))"),
        ("freepik", "named_struct('data', array(named_struct('id', n, 'title', caption, 'url', CASE WHEN pos % 3 = 0 THEN 'https://www.freepik.com/x' ELSE 'https://y.test' END, 'licenses', array(named_struct('type', CASE WHEN pos % 5 = 0 THEN 'premium' ELSE 'Freemium' END)),"
         " 'author', named_struct('name', 'z'), 'image', named_struct('type', CASE WHEN pos % 7 = 0 THEN 'vector' ELSE 'photo' END, 'orientation', 'Horizontal'), 'products', CASE WHEN pos % 11 = 0 THEN array('p') ELSE array() END)))"),
    ]
    whole = [cand.where(F.col("pos") % 4 == i).select(F.col("identifier").alias("query_id"), F.lit(name).alias("source"), F.to_json(F.expr(text)).alias("json")) for i, (name, text) in enumerate(items)]
    return whole[0].unionByName(whole[1]).unionByName(whole[2]).unionByName(whole[3])


_UNION = """
select identifier as query_id, 'pexels' as source, 'pexels:' || pos as identifier, caption || ' https://p.test/a ' || pos as caption, 'Pexels License' as licence, left(repeat('ab', (pos % 60)::int), 100) as author, 'https://p.test/a-' || pos as page, 'https://i.test/' || pos as media, true as usable from cand where pos % 4 = 0
union all select identifier, 'pixabay', 'pixabay:' || pos, caption, 'Pixabay Content License', 'u', 'https://x.test/' || pos, 'https://w.test/' || pos, true from cand where pos % 4 = 1
union all select identifier, 'openverse', 'openverse:' || pos, caption || ' one two', case when pos % 3 = 0 then 'BY' else 'CC0' end, '', '', 'https://o.test/', pos % 3 <> 0 and coalesce(width, 700) >= 650 and coalesce(height, 400) >= 350 and coalesce(width, 700) > coalesce(height, 400) from cand where pos % 4 = 2
union all select identifier, 'freepik', 'freepik:' || pos, caption, case when pos % 5 = 0 then 'premium' else 'Freemium' end, 'z', case when pos % 3 = 0 then 'https://www.freepik.com/x' else 'https://www.freepik.com/' end, null, pos % 5 <> 0 and pos % 7 <> 0 and pos % 11 <> 0 from cand where pos % 4 = 3"""


@query("flt_06_candidate_eligibility", views.sql(f"select query_id, identifier from ({_UNION}) where usable", "cand"))
def _(spark, d):
    return providers.candidates(_answers(spark, d)).select("query_id", "identifier")


@query("src_05_candidate_union", views.sql(f"select * exclude usable from ({_UNION})", "cand"))
def _(spark, d):
    return providers.candidates(_answers(spark, d), usable=False).drop("place")


_GATED = "case pos % 6 when 0 then 'Corporate executive meeting in a boardroom ' || caption when 1 then 'Care workers and nursing staff in a care home team meeting' when 2 then 'Office group meeting' when 3 then '' when 4 then 'Nurse ' || caption else 'patient  training' end"
_ADULT = next(p for n, p in rules.ANCHORS.items() if n == "adult_safeguarding").replace("'", "''")
_SEEN = next(seen for when, seen in rules.ACTIONS if re.search(when, "managing a care team")).replace("'", "''")
_PLAIN = "list_distinct(list_transform(list_filter(regexp_extract_all(lower({0}), '[a-z]{{3,}}'), lambda w: not list_contains([" + ", ".join(f"'{w}'" for w in sorted(rules.GENERIC_WORDS)) + "]::varchar[], w)), lambda w: rtrim(w, 's')))"


@query("flt_08_metadata_gate", views.sql(f"""
with x as (select identifier, lower(trim(regexp_replace({_GATED}, '\\s+', ' ', 'g'))) as c from cand), y as (select *, regexp_matches(c, '{_ADULT}') as shown, regexp_matches(c, '{_SEEN}') as visible, 50 + case when regexp_matches(c, '{_SEEN}') then 30 else 0 end + least(20, 10 * len(list_intersect({_PLAIN.format("'care worker nursing home'")}, {_PLAIN.format("c")}))) as points from x)
select identifier, shown and visible and points >= 80 as eligible, (case when not shown then 0 when not visible then least(points, 74) else least(points, 100) end)::int as score from y""", "cand"))
def _(spark, d):
    caption = F.expr("CASE pos % 6 WHEN 0 THEN concat('Corporate executive meeting in a boardroom ', caption) WHEN 1 THEN 'Care workers and nursing staff in a care home team meeting' WHEN 2 THEN 'Office group meeting' WHEN 3 THEN '' WHEN 4 THEN concat('Nurse ', caption) ELSE 'patient  training' END")
    told = rules.metadata_decision(caption, F.lit("adult_safeguarding"), F.lit("Managing a care team"), F.lit("care worker nursing home"), F.lit(True))
    return views.candidates(spark, d).select("identifier", told.alias("t")).select("identifier", "t.eligible", "t.score")


@query("flt_09_verdict_gate", views.sql("""
with q as (select 'r' || pos % 7 as review, identifier, pos, row_number() over (partition by pos % 7 order by pos, identifier) as n from cand)
select identifier, case when pos % 5 in (0, 1) then (pos % 100)::bigint end as verdict_score, pos % 5 = 0 and pos % 100 >= 85 and n <= 40 as accepted from q""", "cand"))
def _(spark, d):
    rows = views.candidates(spark, d).selectExpr("concat('r', pos % 7) AS review", "identifier", "pos")
    verdict = F.expr("""CASE pos % 5 WHEN 0 THEN concat('{"relevant": true, "confidence": ', pos % 100, '}') WHEN 1 THEN concat('{"relevant": false, "confidence": ', pos % 100, '}')
        WHEN 2 THEN '{"relevant": true, "confidence": "95"}' WHEN 3 THEN 'not json' END""")
    verdicts = rows.where("pos % 5 <> 4").select("identifier", verdict.alias("verdict"))
    return filters.verdict_gate(rows, verdicts, "identifier", strict=True, limit=40).select("identifier", "verdict_score", "accepted")


@query("flt_10_proposal_filter", views.sql(f"""
with p as (select chapter, para_index, left(heading, 100) as search, left(excerpt, 400) as photo, {views.tokens_sql("left(excerpt, 60)")} as g from plan)
select chapter, para_index from p where length(search) between 3 and 110 and length(photo) between 25 and 450 and (len(g) = 0 or list_has_any(g, {views.tokens_sql("search || ' ' || photo")}))""", "plan"))
def _(spark, d):
    base = views.plans(spark, d).withColumn("key", F.struct("chapter", "para_index"))
    proposals = base.select("key", F.left("heading", F.lit(100)).alias("search"), F.left("excerpt", F.lit(400)).alias("photo"))
    return filters.grounded_proposals(proposals, base.select("key", tx.tokens(F.left("excerpt", F.lit(60))).alias("tokens")), "key").select("key.*")


@query("jn_07_used_anti", views.sql("select identifier, pos from cand where pos % 4 <> 0", "cand"))
def _(spark, d):
    cand = views.candidates(spark, d)
    return matching.unused_candidates(cand, cand.where("pos % 4 = 0")).select("identifier", "pos")


@query("jn_10_approval_semi", views.sql("select identifier from cand where pos % 4 = 1", "cand"))
def _(spark, d):
    cand = views.candidates(spark, d)
    chosen = cand.where("pos % 4 = 1")
    return matching.approved(cand, chosen.unionByName(chosen), "identifier").select("identifier")


@query("set_02_selection_algebra", views.sql("select identifier, 'picked' as state from cand where pos % 2 = 0 or pos % 3 = 0 union all select identifier, 'cleared' from cand where pos % 2 = 0 and pos % 3 <> 0", "cand"))
def _(spark, d):
    ids = views.candidates(spark, d)
    two, three = ids.where("pos % 2 = 0").select("identifier"), ids.where("pos % 3 = 0").select("identifier")
    picked = two.union(three).distinct().withColumn("state", F.lit("picked"))
    return picked.unionByName(two.exceptAll(three).withColumn("state", F.lit("cleared")))


@query("jn_11_stale_plan_check", views.sql("select chapter, bool_and(para_index % 9 <> 0) as valid, count(*) filter (para_index % 9 = 0) as n_stale from plan group by 1", "plan"))
def _(spark, d):
    plans = views.plans(spark, d).withColumn("heading", F.when(F.col("para_index") % 9 == 0, F.concat("heading", F.lit(" changed"))).otherwise(F.col("heading")))
    return matching.stale_plans(plans, views.paragraphs(spark, d))


@query("jn_13_fuzzy_replacement")
def _(spark, d):
    # items titled by their first words; retired ones ask by such words with one letter more, which only copies can answer
    start = F.regexp_extract(F.coalesce("text", F.lit("")), r"^[\x20\x09-\x0D]*+((?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){0,7}[^\x20\x09-\x0D]*+)", 1)
    words = F.array_join(F.regexp_extract_all(start, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), " ")
    docs = settle(views.read(spark, d, "documents").select(F.col("doc_id").alias("id"), words.alias("title")))
    docs = docs.withColumn("url", F.when(F.col("id") % 3 > 0, F.concat(F.lit("https://stock.example.org/free-photo/"), urls.slug(F.col("title")), F.lit("_"), F.col("id"), F.lit(".htm"))))
    items = docs.withColumn("slug", F.when(F.col("id") % 2 == 0, F.concat("title", F.lit("!"))))
    asked = F.when(F.col("id") % 4 == 0, F.col("title")).otherwise(F.concat("title", F.lit("x")))
    retired = docs.select("id", urls.resource_slug(F.concat(F.lit("https://stock.example.org/free-vector/"), urls.slug(asked), F.lit("_"), F.col("id"), F.lit(".htm"))).alias("slug"))
    return matching.replacements(retired, matching.catalogue_slugs(items, F.col("title")))


@query("jn_14_title_to_cover", views.sql("""
with c as (select item_id as pos, text as cover from benchmark), t as (select chapter, para_index, lower(regexp_extract(trim(query), '(\\S+)$', 1)) as w from plan)
select chapter, para_index, min_by(cover, pos) as cover from t join c on w <> '' and contains(lower(cover), w) group by 1, 2""", "plan"))
def _(spark, d):
    covers = views.read(spark, d, "benchmark").select(F.col("item_id").alias("pos"), F.col("text").alias("cover"))
    titles = views.plans(spark, d).select(F.struct("chapter", "para_index").alias("key"), F.col("query").alias("title"))
    return matching.title_covers(titles, covers, "key").select("key.*", "cover")


@query("win_19_half_coverage_pick", views.sql("""
q as (select chapter, list({{'p': para_index, 'h': heading, 'q': query}} order by para_index) as l, count(*) as n, (count(*) + 1) // 2 as slots from plan group by 1),
w as (select chapter, l, n, slots, 0::bigint as s, []::bigint[] as chosen, []::varchar[] as used from q
  union all select chapter, l, n, slots, s + 1, list_append(chosen, b.j), list_append(used, l[b.j + 1].q) from w,
    lateral (select list_min(list_transform(list_filter(range(n), lambda j: not list_contains(chosen, j)), lambda j: {{'u': list_contains(used, l[j + 1].q), 'd': abs(j - least(n - 1, ((2 * s + 1) * n) // (2 * slots))), 'j': j}})) as b) t where s < slots)
select chapter, l[j + 1].p as para_index, l[j + 1].h as heading, l[j + 1].q as query from (select chapter, l, unnest(chosen) as j from w where s = slots)""".replace("{{", "{").replace("}}", "}"), "plan", recursive=True))
def _(spark, d):
    return sampling.half_coverage(views.plans(spark, d).select("chapter", "para_index", "heading", "query"))


_QUEUE = "queue as (select chapter, para_index, row_number() over (partition by chapter order by para_index) - 1 as place, (chapter + para_index) % 3 <> 0 as found, (chapter + para_index) % 2 = 0 as approved from plan)"


def _queue(spark, d):
    place = F.row_number().over(W.partitionBy("chapter").orderBy("para_index")) - 1
    return views.plans(spark, d).select("chapter", "para_index", place.alias("place"), F.expr("(chapter + para_index) % 3 <> 0 AS found"), F.expr("(chapter + para_index) % 2 = 0 AS approved"))


@query("win_20_batch_budget", views.sql(f"""
with {_QUEUE}, r as (select *, coalesce(sum(found::int) over (partition by chapter order by place rows between unbounded preceding and 1 preceding), 0) as hits from queue where place >= 1)
select chapter, para_index from r where hits < 2 and place - 1 < 4""", "plan"))
def _(spark, d):
    return sampling.batch_budget(_queue(spark, d), "chapter", "place", cursor=1, per_batch=2, lookups=4).select("chapter", "para_index")


_PROGRESS = f"""{_QUEUE},
progress as (select s.chapter, coalesce(count(q.chapter), 0) as planned, count(*) filter (place < 2) as searched, count(*) filter (place < 2 and found) as found, count(*) filter (place < 2 and found and approved) as approved
  from (select doc_id as chapter from documents) s left join queue q using (chapter) group by 1)"""


def _progress(spark, d):
    return aggregates.chapter_progress(views.read(spark, d, "documents").select(F.col("doc_id").alias("chapter")), _queue(spark, d), 2)


@query("agg_03_chapter_progress", views.sql(f"with {_PROGRESS} select * from progress", "plan"))
def _(spark, d):
    return _progress(spark, d)


@query("agg_04_progress_totals", views.sql(f"""with {_PROGRESS} select review, chapter, sum(found)::bigint as found, sum(planned)::bigint as planned, sum(planned - searched)::bigint as remaining, sum(planned - searched) > 0 as has_more
from (select chapter // 50 as review, * from progress) group by grouping sets ((review, chapter), (review))""", "plan"))
def _(spark, d):
    return aggregates.progress_totals(_progress(spark, d).withColumn("review", F.expr("chapter div 50")), "review")


@query("agg_06_provider_counters", views.sql("""
with a as (select source, pos % 6 as batch, count(*) as a, count(*) filter (pos % 4 = 0) as s from cand group by 1, 2)
select source, batch, sum(a) over w::bigint as attempts, sum(s) over w::bigint as successes from a window w as (partition by source order by batch)""", "cand"))
def _(spark, d):
    rows = views.candidates(spark, d).selectExpr("source", "pos % 6 AS batch", "pos % 4 = 0 AS found")
    return aggregates.cumulative_counters(rows, "source", "batch")


@query("agg_07_run_summary", views.sql(f"""with {_PROGRESS} select count(*) as chapters, count(*) filter (planned = 0) as empty_chapters, sum(planned)::bigint as planned, sum(searched)::bigint as searched, sum(found)::bigint as found,
sum(approved)::bigint as approved, max(planned) as most_planned, sum(searched - found)::bigint as missing from progress""", "plan"))
def _(spark, d):
    return _progress(spark, d).agg(
        F.count("*").alias("chapters"), F.count_if(F.col("planned") == 0).alias("empty_chapters"), *[F.sum(c).alias(c) for c in ("planned", "searched", "found", "approved")],
        F.max("planned").alias("most_planned"), F.sum(F.col("searched") - F.col("found")).alias("missing"),
    )


_KINDS = (*aggregates.RUN_COUNTERS, *aggregates.RUN_SETTINGS, *aggregates.RUN_LISTS, "warning", "provider")
_FACT_DETAIL = "case when {kind} = 'provider' then list_value{providers}[event_id % {n} + 1] else event_type || '-' || (event_id % 5) end"
_COUNTED = ", ".join(f"coalesce(sum(amount) filter (kind = '{c}'), 0)::bigint as {c}" for c in aggregates.RUN_COUNTERS)
_SET = ", ".join(f"max_by(detail, seq) filter (kind = '{c}') as {c}" for c in aggregates.RUN_SETTINGS)
_LISTED = ", ".join(f"coalesce(string_agg(detail, '|' order by seq) filter (kind = '{c}'), '') as {c}" for c in aggregates.RUN_LISTS)
_TOLD = " || ',' || ".join(f"'{p}=' || coalesce(bool_or(kind = 'provider' and detail = '{p}'), false)" for p in aggregates.RUN_PROVIDERS)


@query("agg_07_run_report", f"""
with f as (select user_id % 20 as run, event_id as seq, list_value{_KINDS}[(event_id * 7 + user_id) % {len(_KINDS)} + 1] as kind, 1 + event_id % 3 as amount, event_type, event_id, user_id from events),
g as (select *, {_FACT_DETAIL.format(kind="kind", providers=aggregates.RUN_PROVIDERS, n=5)} as detail from f),
w as (select run, string_agg(detail, '|' order by seq) as warnings from (select run, detail, min(seq) as seq from g where kind = 'warning' group by 1, 2) group by 1)
select g.run, {_COUNTED}, {_SET}, {_LISTED}, {_TOLD} as providers, coalesce(any_value(w.warnings), '') as warnings from g left join w on w.run = g.run group by g.run""")
def _(spark, d):
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), F.expr(at).cast("int"))
    facts = views.read(spark, d, "events").select(
        F.expr("user_id % 20").alias("run"), F.col("event_id").alias("seq"), pick(_KINDS, f"(event_id * 7 + user_id) % {len(_KINDS)}").alias("kind"),
        F.expr("1 + event_id % 3").alias("amount"), "event_type", "event_id",
    )
    plain = F.concat("event_type", F.lit("-"), F.expr("event_id % 5").cast("string"))
    facts = facts.withColumn("detail", F.when(F.col("kind") == "provider", pick(aggregates.RUN_PROVIDERS, "event_id % 5")).otherwise(plain))
    told = aggregates.run_summary(facts, "run")
    providers = F.concat_ws(",", *[F.concat(F.lit(f"{p}="), F.col("providers_configured")[p].cast("string")) for p in aggregates.RUN_PROVIDERS])
    return told.select("run", *aggregates.RUN_COUNTERS, *aggregates.RUN_SETTINGS, *[F.array_join(c, "|").alias(c) for c in aggregates.RUN_LISTS], providers.alias("providers"), F.array_join("warnings", "|").alias("warnings"))


_CELL = r"case when regexp_matches({0}, '^\s*[=+@-]') then chr(39) || {0} else {0} end"


@query("snk_01_report_csv", views.sql(f"""with {_PROGRESS},
docs as (select chapter, planned, searched, found, approved, case when chapter % 3 = 0 then '=' when chapter % 3 = 1 then '  -' else '' end || chapter as path from progress),
hit as (select q.chapter, q.para_index, heading, query, found, approved from queue q join plan using (chapter, para_index)),
every as (
  select 'documents' as section, [path, case when planned = searched then 'done' else 'open' end, planned::varchar, planned::varchar, found::varchar, approved::varchar, '0', ''] as cells from docs
  union all select 'sources', [chapter::varchar, heading, 'Pexels', 'Pexels License', '@' || query, 'https://p.test/' || para_index, 'metadata', '80', ''] from hit where found and approved
  union all select 'missing', [chapter::varchar, heading, query] from hit where not found
  union all select 'notices', ['+ chapter ' || chapter || ' has no heading'] from docs where planned = 0)
select section, array_to_string(list_transform(cells, lambda x: {_CELL.format("x")}), chr(9)) as line from every""", "plan"))
def _(spark, d):
    text = lambda x: F.col(x).cast("string")
    docs = _progress(spark, d).withColumn("path", F.concat(F.expr("CASE chapter % 3 WHEN 0 THEN '=' WHEN 1 THEN '  -' ELSE '' END"), text("chapter")))
    status = F.when(F.col("planned") == F.col("searched"), "done").otherwise("open")
    hit = _queue(spark, d).join(views.plans(spark, d).select("chapter", "para_index", "heading", "query"), ["chapter", "para_index"])
    source = [text("chapter"), F.col("heading"), F.lit("Pexels"), F.lit("Pexels License"), F.concat(F.lit("@"), "query"), F.concat(F.lit("https://p.test/"), text("para_index")), F.lit("metadata"), F.lit("80"), F.lit("")]
    rows = {
        "documents": (docs, [F.col("path"), status, text("planned"), text("planned"), text("found"), text("approved"), F.lit("0"), F.lit("")]),
        "sources": (hit.where("found AND approved"), source),
        "missing": (hit.where("NOT found"), [text("chapter"), F.col("heading"), F.col("query")]),
        "notices": (docs.where("planned = 0"), [F.concat(F.lit("+ chapter "), text("chapter"), F.lit(" has no heading"))]),
    }
    folder = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    sinks.write_report({name: df.select(*[c.alias(n) for c, n in zip(columns, sinks.REPORT[name], strict=True)]) for name, (df, columns) in rows.items()}, folder)
    return sinks.read_report(spark, folder)


@query("snk_02_validation_report", views.sql(rf"""with {_PICK},
docs as (select distinct doc_id from (select doc_id from wanted union all select batch_id from files)),
good as (select f.*, p.file_id is not null as chosen from files f left join pick p using (file_id) where f.filename not like '%.txt'),
places as (select w.doc_id, w.number, p.filename from wanted w left join pick p on p.batch_id = w.doc_id and p.number = w.number),
gone as (select doc_id, number, count(*) as n from places where filename is null group by 1, 2),
idle as (select distinct g.batch_id as doc_id, g.filename from good g where not exists (select 1 from places p where p.doc_id = g.batch_id and p.filename = g.filename)),
often as (select doc_id, number, count(*) as n from places group by 1, 2 having count(*) > 1),
same as (select batch_id as doc_id, number, max(filename) filter (chosen) as pick from good group by 1, 2 having count(*) > 1),
bad as (select batch_id as doc_id, filename from files where filename like '%.txt'),
broken as (select distinct batch_id as doc_id from files where file_id % 11 = 0),
e as (
  select doc_id, 0 as s, 'Missing Images' || chr(10) || string_agg('Image ' || number, chr(10) order by number) || case when sum(n) > count(*) then chr(10) || 'Missing placeholder occurrences: ' || sum(n) else '' end as x from gone group by 1
  union all select doc_id, 1, 'Unused Images' || chr(10) || string_agg(filename, chr(10) order by lower(filename), filename) from idle group by 1
  union all select doc_id, 2, 'Duplicate Placeholders' || chr(10) || string_agg('Image ' || number || ': ' || n || ' occurrences', chr(10) order by number) from often group by 1
  union all select doc_id, 3, 'Duplicate Image Numbers' || chr(10) || string_agg(x, chr(10) order by number) from (
    select m.doc_id, m.number, 'Image ' || m.number || ': selected ' || m.pick || coalesce(chr(10) || string_agg('  Ignored duplicate: ' || g.filename, chr(10) order by lower(g.filename), g.filename) filter (g.filename <> m.pick), '') as x
    from same m join good g on g.batch_id = m.doc_id and g.number = m.number group by m.doc_id, m.number, m.pick) group by 1
  union all select doc_id, 4, 'Corrupted Images' || chr(10) || string_agg(filename || ': not an image', chr(10) order by filename) from bad where contains(filename, '_') group by 1
  union all select doc_id, 5, 'Unsupported or Invalidly Named Files' || chr(10) || string_agg(filename, chr(10) order by filename) from bad where not contains(filename, '_') group by 1
  union all select doc_id, 6, 'Archive Errors' || chr(10) || 'upload_' || doc_id || '.zip: not an archive' from broken),
b as (select doc_id, string_agg(chr(10) || chr(10) || x, '' order by s) as body from e group by 1)
select d.doc_id, 'Document Formatting Complete' || chr(10) || chr(10) || 'Image insertion positions found: ' || (select count(*) from places p where p.doc_id = d.doc_id) || chr(10) || 'Images inserted: ' || (select count(filename) from places p where p.doc_id = d.doc_id)
  || chr(10) || 'Missing images: ' || (select count(*) from gone g where g.doc_id = d.doc_id) || chr(10) || 'Unused uploaded images: ' || (select count(*) from idle i where i.doc_id = d.doc_id)
  || coalesce(body, '') || chr(10) || chr(10) || case when body is null then 'Formatting successful.' else 'Formatting completed with warnings.' end as report from docs d left join b using (doc_id)""", "wanted", "files"))
def _(spark, d):
    files, chosen = views.files(spark, d), _chosen(spark, d)
    places = matching.placements(views.wanted(spark, d), chosen)
    good = files.where("filename NOT LIKE '%.txt'").join(chosen.select("file_id", F.lit(True).alias("chosen")), "file_id", "left")
    good = good.select(F.col("batch_id").alias("doc_id"), "number", "filename", F.coalesce("chosen", F.lit(False)).alias("chosen"))
    kind = F.when(F.contains("filename", F.lit("_")), "corrupted").otherwise("unsupported")
    bad = files.where("filename LIKE '%.txt'").select(F.col("batch_id").alias("doc_id"), kind.alias("kind"), F.col("filename").alias("name"), F.lit("not an image").alias("reason"))
    broken = files.where("file_id % 11 = 0").select(F.col("batch_id").alias("doc_id")).distinct()
    bad = bad.unionByName(broken.select("doc_id", F.lit("archive").alias("kind"), F.concat(F.lit("upload_"), F.col("doc_id").cast("string"), F.lit(".zip")).alias("name"), F.lit("not an archive").alias("reason")))
    docs = places.select("doc_id").unionByName(files.select(F.col("batch_id").alias("doc_id")))
    return sinks.validation_report(docs, places, good, bad)


@query("snk_03_library_upsert", views.sql("""
with e as (select sha256('["' || query || '","' || (chapter % 5) || '","landscape"]') as key, query, chapter, para_index, chapter * 1000 + para_index as saved from plan where chapter % 3 <> 2)
select key, max_by(chapter, saved) as chapter, max_by(para_index, saved) as para_index from e group by 1""", "plan"))
def _(spark, d):
    rows = views.plans(spark, d).selectExpr(
        "concat(' ', upper(query)) AS query", "cast(chapter % 5 AS string) AS subject", "'Landscape' AS orientation", "CASE chapter % 3 WHEN 0 THEN 'pexels' WHEN 1 THEN 'pixabay' ELSE 'other' END AS source", "chapter", "para_index", "chapter * 1000 + para_index AS saved"
    )
    return sinks.library(rows, ["pexels", "pixabay", "openverse"], "saved").select("key", "chapter", "para_index")


@query("snk_03_library_lookup", views.sql("""
with e as (select query, chapter % 5 as subject, chapter, para_index, 1020 + (chapter + para_index) % 10 as size, 2 * (chapter * 1000 + para_index) + (chapter % 2) * 1000000000 as saved from plan where chapter % 3 <> 2 and para_index % 4 <> 0),
k as (select query, subject, max_by(chapter || ':' || para_index, saved) as identifier, max_by(size, saved) as size from e group by 1, 2)
select chapter, para_index, case when k.size > 1024 then k.identifier end as identifier, case when k.size > 1024 then k.size::int end as size from plan left join k on k.query = plan.query and k.subject = plan.chapter % 5""", "plan"))
def _(spark, d):
    plans = settle(views.plans(spark, d).selectExpr("chapter", "para_index", "query", "cast(chapter % 5 AS string) AS subject", "'landscape' AS orientation"))
    answers = plans.selectExpr(
        "upper(query) AS query", "subject", "orientation", "CASE chapter % 3 WHEN 0 THEN 'pexels' WHEN 1 THEN 'pixabay' ELSE 'other' END AS source", "'' AS source_url",
        "concat(chapter, ':', para_index) AS identifier", "'' AS licence", "'' AS author",
        # a picture without the right start is not kept; one that is too small is kept and not given out
        "concat(CASE WHEN para_index % 4 = 0 THEN X'FFD9' ELSE X'FFD8' END, cast(repeat('x', 1018 + cast((chapter + para_index) % 10 AS int)) AS binary)) AS payload",
        "chapter * 1000 + para_index AS saved", "chapter % 2 AS turn",
    )
    with scratch(spark) as folder:
        kept = library.Library(spark, folder, buckets=16)
        for turn in (0, 1):
            kept.save(answers.where(F.col("turn") == turn), "saved")
        found = kept.find(plans)
        return settle(found.select("chapter", "para_index", "identifier", F.octet_length("payload").alias("size")))


@query("snk_04_public_projection", views.sql("select identifier, source, pos, width from cand", "cand"))
def _(spark, d):
    rows = views.candidates(spark, d).withColumns({"path": F.lit("/private"), "picture": F.struct("width", F.lit("k").alias("secret"))})
    return sinks.public(rows.drop("width"), ["path", "caption", "height"], {"picture": ["secret"]}).select("identifier", "source", "pos", "picture.width")


# jobs and events


@query("src_06_job_table", views.sql("select user_id as job_id, max_by(status, (created_at, job_id)) as status, max(created_at) as updated_at from jobs group by 1", "jobs"))
def _(spark, d):
    events = views.jobs(spark, d).selectExpr("user_id AS job_id", "job_id AS seq", "created_at AS ts", "status")
    return sinks.current_jobs(events).select("job_id", "status", F.col("ts").alias("updated_at"))


@query("agg_14_job_stats", views.sql("select job_type, status, count(*) as n, min(epoch(completed_at)::bigint - epoch(created_at)::bigint) as least_s, max(epoch(completed_at)::bigint - epoch(created_at)::bigint) as most_s, quantile_disc(epoch(completed_at)::bigint - epoch(created_at)::bigint, 0.5) as median_s, quantile_disc(epoch(completed_at)::bigint - epoch(created_at)::bigint, 0.9) as slow_s from jobs group by 1, 2", "jobs"))
def _(spark, d):
    took = F.unix_seconds(F.col("completed_at").cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp"))
    return views.jobs(spark, d).groupBy("job_type", "status").agg(F.count("*").alias("n"), F.min(took).alias("least_s"), F.max(took).alias("most_s"), F.percentile_approx(took, 0.5).alias("median_s"), F.percentile_approx(took, 0.9).alias("slow_s"))


_TYPES = "case job_type when 'click' then 'simple_edit' when 'view' then 'text_edit' when 'purchase' then 'toc_update' else 'format' end"
_ACTIONS = "case job_id % 4 when 0 then 'bullets' when 1 then 'blank_line_after' when 2 then 'unknown' else '' end"
_LABELLED = f"""case {_TYPES} when 'simple_edit' then case job_id % 4 when 0 then 'Edit → Bullets' when 1 then 'Edit + Blank line below' else 'Formatting edit' end
  when 'text_edit' then 'Text edit' when 'toc_update' then 'TOC update' else 'Initial format' end"""


def _detailed(spark, d):
    """Jobs with a type that has a label, and their action and source in JSON details, under another key for each type."""
    rows = views.jobs(spark, d).selectExpr("job_id", "status", "parent_id AS before", f"{_TYPES} AS job_type", f"{_ACTIONS} AS action")
    own = F.format_string('{"%s":{"source_job_id":"%s","action":"%s"},"source_format_job_id":""}', "job_type", F.coalesce(F.col("before").cast("string"), F.lit("")), "action")
    formatted = F.format_string('{"simple_edit":{"action":"bullets"},"source_format_job_id":"%s"}', F.coalesce(F.col("before").cast("string"), F.lit("")))
    rows = rows.withColumn("details", F.when(F.col("job_type") == "format", formatted).otherwise(own))
    return rows.select("job_id", "status", "job_type", "details", jobs.source_job(F.col("details")).cast("long").alias("parent_id"))


@query("jn_16_job_lineage", views.sql(f"""
with walk as (select job_id as start, 0 as depth, job_id, parent_id, job_type from jobs where status = 'completed'
  union all select w.start, w.depth + 1, j.job_id, j.parent_id, j.job_type from walk w join jobs j on j.job_id = w.parent_id where j.status = 'completed')
select start, depth, job_id, {_LABELLED} as label from walk""", "jobs", recursive=True))
def _(spark, d):
    return matching.lineage(_detailed(spark, d), jobs.job_label(F.col("job_type"), F.col("details"))).drop("is_current")


@query("jn_16_job_history", views.sql(f"""
with walk as (select job_id as start, 0 as depth, job_id, parent_id, job_type, completed_at from jobs where status = 'completed'
  union all select w.start, w.depth + 1, j.job_id, j.parent_id, j.job_type, j.completed_at from walk w join jobs j on j.job_id = w.parent_id where j.status = 'completed')
select start, depth, job_id, {_LABELLED} as label, depth = 0 as is_current, {_TYPES} as job_type, 'output_' || job_id || '.docx' as filename, completed_at from walk""", "jobs", recursive=True))
def _(spark, d):
    done = views.jobs(spark, d).select("job_id", "completed_at", F.concat(F.lit("output_"), F.col("job_id").cast("string"), F.lit(".docx")).alias("filename"))
    rows = _detailed(spark, d).join(done, "job_id")
    return matching.lineage(rows, jobs.job_label(F.col("job_type"), F.col("details")), ("job_type", "filename", "completed_at"))


@query("fn_23_label_of_job", views.sql(f"select {_TYPES} as job_type, {_LABELLED} as label, count(*) as n from jobs group by 1, 2", "jobs"))
def _(spark, d):
    rows = _detailed(spark, d).withColumn("label", jobs.job_label(F.col("job_type"), F.col("details")))
    return rows.groupBy("job_type", "label").agg(F.count("*").alias("n"))


@query("jn_12_ttl_asof", """
with recursive r as (select user_id % 50 as key, ts, event_id as id from events), s as (
  select key, min(ts) as saved from r group by 1 union all select s.key, min(r.ts) from s join r on r.key = s.key and r.ts > s.saved + interval 24 hours group by s.key, s.saved)
select r.key, r.ts, r.id, (select max(saved) from s where s.key = r.key and s.saved <= r.ts) as saved_at from r""")
def _(spark, d):
    requests = views.read(spark, d, "events").select(F.expr("user_id % 50").alias("key"), "ts", F.col("event_id").alias("id"))
    return matching.served_from_store(requests)


@query("jn_12_latest_within", """
with r as (select user_id % 50 as key, ts, event_id as id from events where event_type <> 'click'), s as (select user_id % 50 as key, ts from events where event_type = 'click')
select key, id, (select max(s.ts) from s where s.key = r.key and s.ts <= r.ts and s.ts >= r.ts - interval 24 hours) as found from r""")
def _(spark, d):
    rows = views.read(spark, d, "events").select(F.expr("user_id % 50").alias("key"), "ts", F.col("event_id").alias("id"), "event_type")
    return matching.latest_within(rows.where("event_type <> 'click'").drop("event_type"), rows.where("event_type = 'click'").select("key", "ts"), "key", 24).select("key", "id", "found")


@query("src_07_harvest_json_urls", "select event_id, 'https://e.example.org/' || event_id as url, '/000000000/000000000/000000001' as path from events union all select event_id, 'http://s.example.org/' || event_id % 7, '/000000001' from events")
def _(spark, d):
    rows = views.read(spark, d, "events").select("event_id", F.format_string('{"data":[{"url":"https://e.example.org/%d","n":1},"x"],"signed_url":"http://s.example.org/%d","url":"ftp://no"}', "event_id", F.expr("event_id % 7")).alias("j"))
    return scan.harvested_urls(rows, "event_id", "j")


@query("src_07_media_urls", "select event_id, 'https://cdn.example.org/' || event_id as url, '/000000001' as path from events where event_id % 2 = 0 union all select event_id, 'https://cdn.example.org/f' || event_id % 7, '/000000004/000000000/000000006/000000001' from events union all select event_id, 'https://cdn.example.org/d', '/000000004/000000000/000000003' from events")
def _(spark, d):
    first = F.when(F.col("event_id") % 2 == 0, F.format_string("https://cdn.example.org/%d", "event_id")).otherwise("https://other.test/1")
    text = '{"signed_url":"%s","url":5,"note":{"url":"https://cdn.example.org/no"},"data":[{"download_url":"https://cdn.example.org/d","files":["http://cdn.example.org/plain","https://cdn.example.org/f%d",3],"else":["https://cdn.example.org/no"]}]}'
    rows = views.read(spark, d, "events").select("event_id", F.format_string(text, first, F.expr("event_id % 7")).alias("j"))
    return scan.media_urls(rows, "event_id", "j", ["example.org"])


@query("fn_22_json_formats", "select event_id, case event_id % 3 when 0 then 'jpg,png' when 1 then 'png' else '' end as formats from events")
def _(spark, d):
    formats = F.expr("CASE event_id % 3 WHEN 0 THEN map('png', 1, 'svg', 2, 'jpg', 3) WHEN 1 THEN map('png', 1) ELSE map('ai', 1) END")
    return views.read(spark, d, "events").select("event_id", F.array_join(tx.raster_formats(formats), ",").alias("formats"))


@query("src_02_archive_manifest", views.sql("""
with f as (select batch_id, file_id, filename, length(filename) as bytes, case file_id % 8 when 0 then '../' when 3 then '__MACOSX/' when 5 then 'dir/.' else '' end as folder from files),
s as (select *, row_number() over (partition by batch_id, lower(file_id || '/' || filename) order by file_id) as nth from f where folder = ''),
r as (select *, count(*) over w as n, sum(bytes) over w as t from s where nth = 1 window w as (partition by batch_id order by file_id))
select batch_id, count(*) as members, sum(bytes)::bigint as bytes, string_agg(file_id || '/' || filename, '|' order by file_id) as names from r where n <= 5 and t <= 60 group by 1""", "files"))
def _(spark, d):
    from quirelake.sources import archives

    folder = F.expr("CASE file_id % 8 WHEN 0 THEN '../' WHEN 3 THEN '__MACOSX/' WHEN 5 THEN 'dir/.' ELSE '' END")
    packed = archives.zipped(views.files(spark, d).withColumn("filename", F.concat(folder, "filename")))
    members = scan.archive_members(packed).where(filters.safe_path(F.col("member")) & ~filters.ignored_member(F.col("member")) & ~F.col("is_link"))
    kept = sampling.running_caps(members.select(F.col("path").alias("archive"), F.col("member").alias("path"), "pos", "bytes"), most=5, each=100, whole=60)
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "path"))), lambda x: x["path"]), "|")
    return kept.groupBy(F.col("archive").cast("long").alias("batch_id")).agg(F.count("*").alias("members"), F.sum("bytes").cast("long").alias("bytes"), names.alias("names"))
