"""The queries of this package and their SQL, by the names they are registered under."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import exact_dedup, fingerprint, language_id, ngram_join, packing, periodic, pieces, quality, secret_scan, substring_dedup, url_filter, warc, whitening
from quirelake.llm.common import scratch, settle


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# The place rules of the URL query.
PLACES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = url_filter.rule_table(spark, [url_filter.place_rule(p, v) for p, v in PLACES]).unionByName(url_filter.trap_rules(pages))
    judged = url_filter.filter_urls(pages, settle(rules))
    placed = F.when(~F.col("rule").startswith("trap:"), F.col("rule"))
    return judged.select("page_id", "host", "path", placed.alias("rule"), "verdict")


OP2_SQL = rf"""
with parts as (
  select page_id,
         coalesce(translate(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages
), traps as (
  select host, path from (
    select distinct url, coalesce(translate(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
           coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') as path from pages)
  where host <> '' and regexp_matches(host || path, '[A-Za-z0-9]') group by 1, 2 having count(*) >= {url_filter.TRAP}
), rules(rule, rule_host, rule_path, verdict) as (
  values ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), best as (
  select page_id, host, path, max_by(rule, length(rule)) filter (hit) as rule, max_by(verdict, length(rule)) filter (hit) as verdict
  from (select p.*, r.rule, r.verdict,
               (p.host = r.rule_host or p.host like '%.' || r.rule_host) and starts_with(p.path, r.rule_path) as hit
        from parts p cross join rules r)
  group by page_id, host, path
)
select page_id, host, path, rule, coalesce(verdict, case when (host, path) in (select host, path from traps) then 'block' else 'allow' end) as verdict
from best
"""


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir), digest_all=True)


OP5_SQL = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as norm
  from documents
)
select doc_id, first_value(doc_id) over g as keep_id, count(*) over (partition by norm) as group_size,
       doc_id = first_value(doc_id) over g as kept, sha256(norm) as text_sha256
from d window g as (partition by norm order by n desc, doc_id)
"""

QUERIES = {"op2_url_filter": op2_url_filter, "op5_exact_dedup": op5_exact_dedup}
SQL = {"op2_url_filter": OP2_SQL, "op5_exact_dedup": OP5_SQL}


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] != "format")
    return found.select(
        "doc_id", *[secret_scan.counted(F.col("secrets"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secret_scan.written(base), 256).alias("base_sha256"), secret_scan.written(F.col("secrets")).alias("spans"),
        secret_scan.counted(F.col("secrets"), "format").alias("n_format"), F.transform("secrets", lambda s: s["score"]).alias("scores"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    told = language_id.identify(docs)
    return told.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    scored = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES |= {"op1_secret_scan": op1_secret_scan, "op3_language_id": op3_language_id, "op6_quality": op6_quality}


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_report(_documents(spark, sf_dir).select("doc_id", "text"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir).select("doc_id", "text"))


QUERIES |= {"op9_fingerprint": op9_fingerprint, "op10_packing": op10_packing}


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(_documents(spark, sf_dir).select("doc_id", "text"), k=3, num=90)


QUERIES |= {"op7_ngram_join": op7_ngram_join}


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"), with_text=False)


QUERIES |= {"op8_substring_dedup": op8_substring_dedup}


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    coded = pieces.encode(docs)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES |= {"op4_pieces": op4_pieces}

_WORDS = r"words as (select doc_id, list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents)"

OP7_SQL = rf"""
with recursive {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")},
s as (select distinct doc_id, g from (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) end) as g from words)),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 90 * (x.n + y.n - i)),
e as (select a, b from l union all select b, a from l),
r(doc_id, c) as (select doc_id, doc_id from documents union select r.doc_id, e.b from r join e on e.a = r.c)
select r.doc_id, coalesce(max(n.n), 0) as n_shingles, min(c) as component_id from r left join n on n.doc_id = r.doc_id group by 1
"""

OP8_SQL = rf"""
with {_WORDS.format("coalesce(text, '')")},
h as (select doc_id, p, array_to_string(w[p+1:p+20], ' ') as g from (select doc_id, w, unnest(range(len(w) - 19)) as p from words where len(w) >= 20)),
f as (select doc_id, p from h qualify row_number() over (partition by g order by doc_id, p) > 1),
gone as (select distinct doc_id, unnest(range(p, p + 20)) as i from f),
left_ as (select u.doc_id, string_agg(x, ' ' order by u.i) as kept, count(*) as n from (select doc_id, unnest(range(len(w))) as i, unnest(w) as x from words) u anti join gone g on g.doc_id = u.doc_id and g.i = u.i group by 1)
select words.doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from words left join left_ using (doc_id)
"""

SQL |= {"op7_ngram_join": OP7_SQL, "op8_substring_dedup": OP8_SQL}


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    with scratch(spark) as folder:
        warc.write_archives(pages, folder)
        told = warc.page_report(spark, folder)
    same = dict(pages.dtypes)["page_id"]
    return told.select(F.col("page_id").cast(same), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(same))


OP12_SQL = r"""
with p as (select page_id, coalesce(html, '') as t from pages),
d as (select page_id, t, strlen(t) as n, sha1(t) as h, first_value(page_id) over g as first_id, row_number() over g as k from p window g as (partition by t order by page_id))
select page_id, n as payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((('0x' || substr(h, 1 + 5 * cast(i // 4 as int), 5))::bigint >> (15 - 5 * (i % 4))) & 31 as int), 1)), '') as payload_digest,
       case when k = 1 then 'response' else 'revisit' end as record_type, case when k > 1 then first_id end as refers_to
from d
"""


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """In a tenth of the documents, by crc32 of the id, the words from some place on repeat a few words found there."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return None
    a = g % n
    words, tail = np.arange(n), np.arange(n - a)
    words[a:] = a + tail % (1 + (n - a) // (3 + g % 8))
    return words


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(_documents(spark, sf_dir).select("doc_id", "text"), repeated_tail)
    best = periodic.best_run(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


QUERIES |= {"op11_whitening": op11_whitening, "op12_warc": op12_warc, "op13_periodic_runs": op13_periodic_runs}
SQL |= {"op12_warc": OP12_SQL}
