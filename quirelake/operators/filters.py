"""Row filters and gates as predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quirelake.functions import text as tx


def editable_rows(par: DataFrame) -> DataFrame:
    """Rows with text, outside contents styles, without drawings or fields (style, has_drawing, has_field)."""
    return par.where((F.trim("text") != "") & ~F.col("style").startswith("TOC") & ~F.col("has_drawing") & ~F.col("has_field"))


def search_rows(par: DataFrame, wanted: str) -> DataFrame:
    """Rows whose text, style or list type hold the trimmed query in any case; an empty query keeps all."""
    wanted = wanted.strip().lower()
    return par.where(F.contains(F.lower(F.concat_ws(" ", "text", "style", "list_type")), F.lit(wanted))) if wanted else par


def replacement_queries(par: DataFrame) -> DataFrame:
    """Rows whose collapsed text can serve as a search: 3 to 110 characters, three letters in a row, no link."""
    out = par.withColumn("query", tx.collapsed(F.col("text")))
    return out.where(F.length("query").between(3, 110) & F.col("query").rlike("[A-Za-z]{3}") & ~F.lower("query").contains("http"))


def _style_told(name: Column, outline: Column) -> tuple[Column, Column]:
    """(whether the style is one of a table of contents, its level by name, else by outline level from 0)."""
    contents = F.coalesce(F.trim(name), F.lit("")).rlike(r"(?i)^toc\b")
    by_name = tx.matched(name, r"(?i)\bheading\s*([1-6])\b").cast("int")
    return contents, F.coalesce(by_name, F.when(outline.between(0, 5), outline + 1))


def style_levels(styles: DataFrame, key: list[str], steps: int = 8) -> DataFrame:
    """(key, style_id, contents, style_level) of styles (key, style_id, name, outline, base): what the style itself or
    the nearest of its bases says, `steps` styles at most. A cycle of bases says nothing."""
    contents, level = _style_told(F.col("name"), F.col("outline"))
    own = styles.select(*key, "style_id", F.col("base").alias("_next"), contents.alias("contents"), level.alias("style_level"))
    up = own.select(*key, F.col("style_id").alias("_next"), F.col("_next").alias("_then"), F.col("contents").alias("_contents"), F.col("style_level").alias("_level"))
    walk = own
    for _ in range(steps - 1):
        open_ = ~F.col("contents") & F.col("style_level").isNull()
        walk = walk.join(up, [*key, "_next"], "left").select(
            *key, "style_id", F.when(open_, F.col("_then")).alias("_next"), F.when(open_, F.coalesce("_contents", F.lit(False))).otherwise(F.col("contents")).alias("contents"),
            F.when(open_, F.col("_level")).otherwise(F.col("style_level")).alias("style_level"),
        )
    return walk.drop("_next")


# How a heading in bold is numbered.
_NUMBERED = r"(?i)^(?:(\d{1,2})\.\d{1,2}(?:\.\d{1,2})?\s+|(?:module|unit|chapter)\s*0?\d{1,3}\s*[:.\-]\s+)"


def heading_level(contents: Column, style_level: Column, outline: Column, text: Column, bold_share: Column) -> Column:
    """The level by style, else by the paragraph's own outline level (from 0), else by the number of a short, mostly
    bold text: one and a level for each dot of it, or 1 for a module, unit or chapter. Null for contents styles."""
    clean = tx.collapsed(text)
    head, first = F.regexp_extract(clean, _NUMBERED, 0), F.regexp_extract(clean, _NUMBERED, 1)
    dots = F.length(head) - F.length(F.replace(head, F.lit(".")))
    by_text = F.when((head == "") | (F.length(clean) > 130) | (F.coalesce(bold_share, F.lit(0.0)) < 0.6), None).when(first != "", F.least(F.lit(6), dots + 1)).otherwise(1)
    told = F.coalesce(style_level, F.when(outline.between(0, 5), outline + 1), by_text)
    return F.when(~F.coalesce(contents, F.lit(False)), told)


def safe_path(path: Column) -> Column:
    """Whether an archive member's path is relative, without `..`, metadata folder or drive."""
    p = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(p, "/"), lambda x: ~x.isin("", "."))
    first = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
    return (p != "") & ~p.startswith("/") & ~F.array_contains(parts, "..") & (F.upper(first) != "__MACOSX") & ~first.contains(":")


def ignored_member(path: Column) -> Column:
    """Folders, hidden files and system files of an archive."""
    p = F.coalesce(path, F.lit(""))
    name = F.regexp_extract(F.rtrim(p, F.lit("/")), r"([^/]*)$", 1)
    return (p == "") | p.endswith("/") | F.array_contains(F.split(p, "/"), "__MACOSX") | name.startswith(".") | F.lower(name).isin("thumbs.db", "desktop.ini")


def size_bounds(width: Column, height: Column, least=(450, 300), pixels: int = 65_000_000) -> Column:
    """Whether a picture is large enough and not too large."""
    return (width >= least[0]) & (height >= least[1]) & (width.cast("long") * height <= pixels)


def safe_to_open(width: Column, height: Column, size: Column, pixels: int = 50_000_000, most: int = 25_000_000) -> Column:
    """Whether a picture may be decoded at all: within the pixels and bytes that memory is set aside for."""
    return (width.cast("long") * height <= pixels) & (size <= most) & (size > 0)


def plausible_dpi(dpi: Column) -> Column:
    """dpi within 36 to 600, else 96."""
    return F.when(dpi.between(36, 600), dpi).otherwise(F.lit(96).cast("double"))


def eligible_candidates(cand: DataFrame, portrait: bool = False, least=(650, 350), licences: list[str] | None = None) -> DataFrame:
    """Candidates with an id, at least that size where it is known, and strictly of the wanted orientation; a licence of the set where
    the column is there."""
    turned = F.col("width") < F.col("height") if portrait else F.col("width") > F.col("height")
    known = F.col("width").isNull() | ((F.col("width") >= least[0]) & (F.col("height") >= least[1]) & turned)
    out = cand.where(known & F.col("identifier").rlike(r":\S+$"))
    return out.where(F.lower("licence").isin(*licences)) if licences else out


def eligible_stock(items: DataFrame, portrait: bool = False) -> DataFrame:
    """Items (id, kind, orientation, licences array<string>, products array<string>) of a stock catalogue that may be
    used: photographs of the wanted orientation with digits as id, with a free licence and outside every paid product."""
    wanted = ("vertical", "portrait") if portrait else ("horizontal", "landscape")
    free = F.exists("licences", lambda x: F.lower(x).isin("free", "freemium"))
    right = (F.col("kind") == "photo") & F.lower("orientation").isin(*wanted) & F.coalesce(free, F.lit(False))
    return items.where(right & (F.coalesce(F.size("products"), F.lit(0)) <= 0) & F.col("id").rlike(r"^\d+$"))


def verdict_gate(rows: DataFrame, verdicts: DataFrame, key: str, strict: bool, limit: int) -> DataFrame:
    """rows with accepted and verdict_score. verdicts (key, verdict as JSON): a boolean `relevant` that is true and an
    integer `confidence` of 0 to 100, at least 85 if strict, else 75. Missing and malformed ones, and rows after the
    first limit checks of a group (`pos` in `review`), are not accepted."""
    v = F.try_parse_json("verdict")
    kinds = F.schema_of_variant(F.try_variant_get(v, "$.relevant", "variant")), F.schema_of_variant(F.try_variant_get(v, "$.confidence", "variant"))
    score = F.when(kinds[1] == "BIGINT", F.try_variant_get(v, "$.confidence", "long"))
    right = F.when(kinds[0] == "BOOLEAN", F.try_variant_get(v, "$.relevant", "boolean"))
    told = verdicts.select(key, right.alias("_right"), F.when(score.between(0, 100), score).alias("verdict_score"))
    nth = F.row_number().over(W.partitionBy("review").orderBy("pos", key))
    out = rows.withColumn("_nth", nth).join(told, key, "left")
    ok = F.col("_right") & (F.col("verdict_score") >= (85 if strict else 75)) & (F.col("_nth") <= limit)
    return out.withColumn("accepted", F.coalesce(ok, F.lit(False))).drop("_nth", "_right")


def grounded_proposals(proposals: DataFrame, grounding: DataFrame, key: str) -> DataFrame:
    """Proposals (key, search, photo) whose texts have 3 to 110 and 25 to 450 characters, hold no link, and share a
    token with grounding (key, tokens) unless that is empty."""
    met = proposals.join(grounding.select(key, F.col("tokens").alias("_ground")), key)
    said = tx.tokens(F.concat_ws(" ", "search", "photo"))
    fits = F.length("search").between(3, 110) & F.length("photo").between(25, 450)
    linked = F.concat_ws(" ", "search", "photo").rlike(r"(?i)https?:|www\.")
    return met.where(fits & ~linked & ((F.size("_ground") == 0) | F.arrays_overlap(said, "_ground"))).drop("_ground")
