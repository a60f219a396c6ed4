"""Answers of four photo catalogues, each in its own JSON shape, as one table of candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.operators import filters

# Where each catalogue's answer holds its items, the fields of an item, and the licences of its own.
ANSWERS = {
    "pexels": ("photos", "id string, alt string, url string, photographer string, src struct<large2x:string,large:string,original:string>"),
    "pixabay": ("hits", "id string, tags string, largeImageURL string, webformatURL string, pageURL string, user string"),
    "openverse": ("results", "id string, license string, width int, height int, url string, title string, tags array<struct<name:string>>, foreign_landing_url string, creator string"),
    "freepik": ("data", "id string, title string, url string, licenses array<struct<type:string>>, author struct<name:string>, image struct<type:string,orientation:string>, products array<string>"),
}
PEXELS, PIXABAY, UNVERIFIED = "Pexels License", "Pixabay Content License", "unverified"
FREEPIK = "https://www.freepik.com/"
OPEN_LICENCES = ["cc0", "pdm"]
LONGEST_AUTHOR = 100


def _text(column: str | Column) -> Column:
    return F.coalesce(column, F.lit(""))


def _shaped(provider: str) -> dict[str, Column]:
    """The columns of the one shape, over an item's own fields."""
    filled = lambda *names: F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in names])
    if provider == "pexels":
        caption = F.concat_ws(" ", _text("alt"), F.replace(_text("url"), F.lit("-"), F.lit(" ")))
        return {"caption": caption, "licence": F.lit(PEXELS), "author": _text("photographer"), "page": _text("url"), "media": filled("src.large2x", "src.large", "src.original")}
    if provider == "pixabay":
        return {"caption": _text("tags"), "licence": F.lit(PIXABAY), "author": _text("user"), "page": _text("pageURL"), "media": filled("largeImageURL", "webformatURL")}
    if provider == "openverse":
        names = F.array_join(F.transform(F.coalesce("tags", F.array().cast("array<struct<name:string>>")), lambda t: _text(t["name"])), " ")
        return {"caption": F.concat_ws(" ", _text("title"), names), "licence": F.upper(_text("license")), "author": _text("creator"), "page": _text("foreign_landing_url"), "media": filled("url")}
    page = F.when(F.col("url").startswith(FREEPIK), F.col("url")).otherwise(FREEPIK)
    return {"caption": _text("title"), "licence": F.coalesce(F.get("licenses", F.lit(0))["type"], F.lit(UNVERIFIED)), "author": _text("author.name"), "page": page, "media": F.lit(None).cast("string")}


def _usable(items: DataFrame, provider: str, portrait: bool) -> DataFrame:
    """The items that the catalogue's own rules let through."""
    if provider == "openverse":
        rows = items.withColumns({"identifier": F.concat(F.lit("openverse:"), "id"), "licence": F.col("license")})
        sized = rows.where(F.col("width").isNotNull() & F.col("height").isNotNull())
        return filters.eligible_candidates(sized, portrait, licences=OPEN_LICENCES).drop("identifier", "licence")
    if provider == "freepik":
        rows = items.withColumns({"kind": F.col("image.type"), "orientation": F.col("image.orientation"), "licences": F.transform("licenses", lambda x: x["type"])})
        return filters.eligible_stock(rows, portrait).drop("kind", "orientation", "licences")
    return items


def candidates(answers: DataFrame, portrait: bool = False, usable: bool = True) -> DataFrame:
    """(query_id, source, place, identifier, caption, licence, author, page, media) of answers (query_id, source, json): one row an
    item with an id, in the answer's order; with usable only what the catalogue's own rules let through. An answer that
    cannot be read, or of an unknown source, has no item."""

    def one(provider: str) -> DataFrame:
        field, item = ANSWERS[provider]
        kind = f"struct<{field}:array<struct<{_colons(item)}>>>"
        items = answers.where(F.col("source") == provider).select("query_id", "source", F.posexplode(F.from_json("json", kind)[field]).alias("place", "i")).select("query_id", "source", "place", "i.*")
        items = items.where(_text("id") != "")
        if usable:
            items = _usable(items, provider, portrait)
        shaped = _shaped(provider)
        shaped["author"] = F.left(shaped["author"], F.lit(LONGEST_AUTHOR))
        return items.select("query_id", "source", "place", F.concat_ws(":", "source", "id").alias("identifier"), *[c.alias(n) for n, c in shaped.items()])

    return reduce(DataFrame.unionByName, map(one, ANSWERS))


def _colons(fields: str) -> str:
    """`a string, b int` as the fields of a struct type."""
    out, depth = [], 0
    for part in fields.split(", "):
        out.append(part.replace(" ", ":", 1) if depth == 0 else part)
        depth += part.count("<") - part.count(">")
    return ",".join(out)
