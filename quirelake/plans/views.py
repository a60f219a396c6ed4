"""The derived tables that the registered queries run on, in Spark and, for their oracles, as SQL text.

Headings, breaks and the like are set by integer arithmetic over ids and positions, because the given text has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quirelake.functions import text as tx
from quirelake.operators import layout
from quirelake.sources import scan


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line of `documents`, with the layout columns that the operators need."""
    lines = scan.lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return lines.selectExpr(
        "doc_id",
        "para_index",
        "(doc_id * 7 + para_index * para_index * 5 + para_index) % 4 = 0 AS is_heading",
        "1 + (doc_id * 3 + para_index * para_index + para_index * 7) % 3 AS level",
        "CASE WHEN (doc_id * 7 + para_index * para_index * 5 + para_index) % 4 <> 0 THEN 'body' WHEN (doc_id + para_index * 3) % 5 = 0 THEN 'skip'"
        " WHEN (doc_id * 2 + para_index) % 7 = 0 THEN 'skip_only' ELSE 'head' END AS kind",
        "(doc_id * 7 + para_index * para_index * 5 + para_index) % 4 <> 0 AND (doc_id * 11 + (para_index div 2) * 13) % 4 = 0 AS is_blank",
        "(doc_id * 5 + (para_index div 3) * 7) % 6 = 0 AS has_break",
        "(doc_id * 7 + para_index * para_index * 5 + para_index) % 4 = 0 AND (doc_id * 13 + para_index * 3) % 8 = 0 AS page_break_before",
        "(doc_id * 7 + para_index * para_index * 5 + para_index) % 4 <> 0 AND (doc_id + para_index * 5) % 9 = 0 AS has_picture",
        "line AS text",
    ).withColumn("text", F.when(F.col("is_blank"), "").otherwise(F.col("text")))


PAR = r"""
lines as (select doc_id, unnest(range(len(l))) as i, unnest(l) as line from (select doc_id, str_split(text, chr(10)) as l from documents where text is not null)),
par as (
  select doc_id, i as para_index, h as is_heading, 1 + (doc_id*3 + i*i + i*7) % 3 as level,
         case when not h then 'body' when (doc_id + i*3) % 5 = 0 then 'skip' when (doc_id*2 + i) % 7 = 0 then 'skip_only' else 'head' end as kind,
         b as is_blank, (doc_id*5 + (i//3)*7) % 6 = 0 as has_break, h and (doc_id*13 + i*3) % 8 = 0 as page_break_before,
         (not h) and (doc_id + i*5) % 9 = 0 as has_picture, case when b then '' else line end as text
  from (select *, (not h) and (doc_id*11 + (i//2)*13) % 4 = 0 as b from (select *, (doc_id*7 + i*i*5 + i) % 4 = 0 as h from lines))
)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anchors of `pages`, some with a number."""
    found = scan.anchors(read(spark, sf_dir, "pages").select("page_id", "html"))
    return found.withColumn("number", F.expr("CASE WHEN (page_id + link_pos + 1) % 2 = 0 THEN ((link_pos + 1) div 2) % 2 + 1 END"))


LINK = r"""
link as (
  select *, case when (page_id + link_pos + 1) % 2 = 0 then ((link_pos + 1) // 2) % 2 + 1 end as number
  from (select page_id, unnest(range(len(a))) as link_pos, unnest(a) as href, unnest(b) as label
        from (select page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) as a, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) as b from pages))
)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue to match against: `benchmark` passages and `part` names."""
    texts = read(spark, sf_dir, "benchmark").selectExpr("concat('pixabay:', item_id) AS identifier", "text AS caption", "'pixabay' AS source", "cast(null AS int) AS width", "cast(null AS int) AS height", "cast(item_id AS long) AS pos")
    parts = read(spark, sf_dir, "part").selectExpr(
        "concat('pexels:', p_partkey) AS identifier", "concat(p_name, ' ', p_type) AS caption", "'pexels' AS source", "cast(p_size * 100 AS int) AS width",
        "cast(floor(p_retailprice) AS int) AS height", "cast(p_partkey AS long) AS pos",
    )
    return texts.unionByName(parts)


CAND = r"""
cand as (
  select 'pixabay:' || item_id as identifier, text as caption, 'pixabay' as source, null::int as width, null::int as height, item_id::bigint as pos from benchmark
  union all
  select 'pexels:' || p_partkey, p_name || ' ' || p_type, 'pexels', (p_size*100)::int, floor(p_retailprice)::int, p_partkey::bigint from part
)"""

# the tokens of a text in SQL, as in functions.text.tokens
_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(tx.STOP_WORDS))
TOKENS_MACRO = r"""list_transform(list_filter(regexp_extract_all({0}, '[a-zA-Z][a-zA-Z''-]+'), lambda t: length(t) > 2 and not list_contains([{1}], lower(t))), lambda t: trim(lower(t), '-'''))"""


def tokens_sql(column: str) -> str:
    return TOKENS_MACRO.format(column, _STOP)


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of kind `head` with the text that follows them: chapter, para_index, heading, excerpt, query."""
    excerpts = layout.context_excerpts(paragraphs(spark, sf_dir)).where("kind = 'head' AND excerpt <> ''")
    heading = F.col("text")
    query = F.array_join(F.slice(F.array_distinct(tx.tokens(heading)), 1, 4), " ")
    return excerpts.select(F.col("doc_id").alias("chapter"), "para_index", heading.alias("heading"), "excerpt", query.alias("query"))


EXCERPT = r"""
ahead as (
  select p.doc_id, p.para_index, n.para_index as j, length(n.text) as len, n.text as line
  from par p join par n on n.doc_id = p.doc_id and n.para_index between p.para_index + 1 and p.para_index + 12
  where p.is_heading and not n.is_heading and trim(n.text) <> ''
    and not exists (select 1 from par s where s.doc_id = p.doc_id and s.is_heading and s.para_index > p.para_index and s.para_index < n.para_index)
),
excerpts as (
  select p.*, coalesce(left(e.excerpt, 1100), '') as excerpt
  from par p left join (
    select doc_id, para_index, string_agg(line, ' ' order by j) as excerpt
    from (select *, coalesce(sum(len) over (partition by doc_id, para_index order by j rows between unbounded preceding and 1 preceding), 0) as before from ahead)
    where before < 1000 group by doc_id, para_index) e on p.doc_id = e.doc_id and p.para_index = e.para_index
  where p.is_heading
)"""

PLAN = rf"""
plan as (
  select chapter, para_index, heading, excerpt, array_to_string(list_slice(list_distinct_ordered, 1, 4), ' ') as query
  from (select doc_id as chapter, para_index, text as heading, excerpt,
               list_filter({tokens_sql("text")}, lambda t, k: list_position({tokens_sql("text")}, t) = k) as list_distinct_ordered
        from excerpts where kind = 'head' and excerpt <> '')
)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in batches, made from `part`: batch_id, file_id, filename, number, width, height, bytes."""
    return read(spark, sf_dir, "part").selectExpr(
        "p_partkey div 8 AS batch_id", "p_partkey AS file_id", "cast(p_partkey % 5 + 1 AS int) AS number",
        "concat(CASE p_partkey % 3 WHEN 0 THEN cast(p_partkey % 5 + 1 AS string) WHEN 1 THEN concat('Image ', p_partkey % 5 + 1) ELSE replace(p_name, ' ', '_') END,"
        " CASE p_size % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' WHEN 2 THEN '.webp' ELSE '.txt' END) AS filename",
        "cast(p_size * 100 AS int) AS width", "cast(floor(p_retailprice) AS int) AS height", "p_size * 1000000L AS bytes",
    )


FILES = r"""
files as (
  select p_partkey // 8 as batch_id, p_partkey as file_id, (p_partkey % 5 + 1)::int as number,
         (case p_partkey % 3 when 0 then (p_partkey % 5 + 1)::varchar when 1 then 'Image ' || (p_partkey % 5 + 1) else replace(p_name, ' ', '_') end)
         || (case p_size % 4 when 0 then '.png' when 1 then '.jpg' when 2 then '.webp' else '.txt' end) as filename,
         (p_size*100)::int as width, floor(p_retailprice)::int as height, p_size*1000000::bigint as bytes
  from part
)"""


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that pages ask for, one row an occurrence: doc_id, pos, number."""
    numbered = links(spark, sf_dir).where("number IS NOT NULL").selectExpr("page_id AS doc_id", "cast(link_pos AS long) AS pos", "cast(number + CASE WHEN page_id % 3 = 0 THEN 4 ELSE 0 END AS int) AS number")
    return numbered


WANTED = r"""
wanted as (select page_id as doc_id, link_pos as pos, (number + case when page_id % 3 = 0 then 4 else 0 end)::int as number from link where number is not null)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with parents, made from `events`: each job follows the user's previous one, but every tenth starts anew."""
    mine = W.partitionBy("user_id").orderBy("ts", "event_id")
    ranked = read(spark, sf_dir, "events").withColumns({"nth": F.row_number().over(mine), "before": F.lag("event_id").over(mine)})
    return ranked.selectExpr(
        "event_id AS job_id", "user_id", "event_type AS job_type", "CASE WHEN value < 1 THEN 'failed' ELSE 'completed' END AS status", "ts AS created_at",
        "timestampadd(SECOND, cast(floor(value) AS int), ts) AS completed_at", "CASE WHEN nth % 10 <> 0 THEN before END AS parent_id",
    )


JOBS = r"""
jobs as (
  select event_id as job_id, user_id, event_type as job_type, case when value < 1 then 'failed' else 'completed' end as status, ts as created_at,
         ts + to_seconds(floor(value)::bigint) as completed_at, case when nth % 10 <> 0 then before end as parent_id
  from (select *, row_number() over w as nth, lag(event_id) over w as before from events window w as (partition by user_id order by ts, event_id))
)"""

_NEEDS = {"par": PAR, "link": LINK, "cand": CAND, "excerpts": EXCERPT, "plan": PLAN, "files": FILES, "wanted": WANTED, "jobs": JOBS}
_BEFORE = {"excerpts": ["par"], "plan": ["par", "excerpts"], "wanted": ["link"]}


def sql(body: str, *views: str, recursive: bool = False) -> str:
    """body with the views it names put before it."""
    names = list(dict.fromkeys(x for v in views for x in [*_BEFORE.get(v, []), v]))
    parts = [_NEEDS[n].strip() for n in names]
    body = body.strip()
    if body[:4].lower() == "with" or recursive:
        body = body[4:].strip() if body[:4].lower() == "with" else body
        return f"with {'recursive ' if recursive else ''}" + ",\n".join([*parts, body])
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body
