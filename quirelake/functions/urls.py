"""URL rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirelake.functions import text as tx

# What marks an image file, an image page and a stock host.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp")
IMAGE_LABEL = (
    r"(?i)\b(?:images?|photos?|photographs?|pictures?|illustrations?|graphics?|visuals?|diagrams?|screenshots?|infographics?|artwork)\b"
)
IMAGE_SEGMENTS = (
    "photo", "photos", "free-photo", "image", "images", "image-photo", "stock-photo", "photography", "picture",
    "pictures", "illustration", "illustrations", "vector", "free-vector", "vectors",
)
STOCK_HOSTS = (("freepik", r"(?i)(^|\.)freepik\.com$"), ("magnific", r"(?i)(^|\.)magnific\.com$"))
RESOURCE_ID = (r"(?i)_(\d+)(?:\.htm|\.html)?(?:[?#].*)?$", r"(?i)/(?:resource|photo|vector|psd)/(\d+)(?:[/?#]|$)")

_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?([^/?#:@]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?"


def part(url: Column, name: str) -> Column:
    """scheme, user, host, port, path or query of a URL; empty where it has none."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 1 + ("scheme", "user", "host", "port", "path", "query").index(name)), F.lit(""))


def _path(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_url_decode(F.replace(part(url, "path"), F.lit("+"), F.lit("%2B"))), part(url, "path")))


def has_image_suffix(path: Column) -> Column:
    return path.rlike(r"[^/](?:\.jpg|\.jpeg|\.png|\.webp)$")


def source_type(url: Column) -> Column:
    """`direct` for an image file, else the stock host's name, else `direct`."""
    host = F.lower(part(url, "host"))
    out = F.when(has_image_suffix(_path(url)), "direct")
    for name, pattern in STOCK_HOSTS:
        out = out.when(host.rlike(pattern), name)
    return out.otherwise("direct")


def looks_like_image(url: Column, label: Column) -> Column:
    """Whether a link leads to a picture, by its path, query, host, path segments and, last, its label."""
    path, host, query = _path(url), F.lower(part(url, "host")), F.lower(part(url, "query"))
    real = F.lower(part(url, "scheme")).isin("http", "https") & (host != "") & (part(url, "user") == "")
    by_query = query.rlike(r"(?:^|&)(?:file|filename|image|src|url)=[^&]*[^/&=](?:\.jpg|\.jpeg|\.png|\.webp)(?:&|$)") | query.rlike(r"(?:^|&)(?:format|fm|extension)=(?:jpg|jpeg|png|webp)(?:&|$)")
    pictures = host.rlike(r"^(?:images|img|photos)\.") & ~path.isin("", "/")
    segments = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(s) for s in IMAGE_SEGMENTS]))
    stock = source_type(url) != "direct"
    return (
        F.when(~real, False)
        .when(has_image_suffix(path) | by_query | pictures, True)
        .when(stock, ~path.isin("", "/"))
        .otherwise(segments | tx.link_text(label).rlike(IMAGE_LABEL))
    )


def resource_id(url: Column) -> Column:
    """The number that a stock page's URL ends in or names."""
    return F.coalesce(*[tx.matched(url, p).try_cast("long") for p in RESOURCE_ID])


def slug(text: Column) -> Column:
    """Lower-cased words with `-` between."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def resource_slug(url: Column) -> Column:
    """The slug of a URL's last segment without suffix and number."""
    name = F.regexp_extract(F.rtrim(part(url, "path"), F.lit("/")), r"([^/]*)$", 1)
    name = F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)
    return slug(F.regexp_replace(F.regexp_replace(name, r"(?i)\.html?$", ""), r"_\d+$", ""))


def trusted(url: Column, hosts: list[str], subdomains: bool = False) -> Column:
    """https, no user, port 443 or none, and a listed host (or one below it)."""
    host = F.lower(part(url, "host"))
    known = host.isin(*hosts)
    if subdomains:
        for h in hosts:
            known = known | host.endswith("." + h)
    return (part(url, "scheme") == "https") & (part(url, "user") == "") & part(url, "port").isin("", "443") & known


def is_private_ip(host: Column) -> Column:
    """Whether a host is a literal IPv4 address that is private, loopback, link-local, multicast, reserved or unset."""
    pattern = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
    a, b, c = (F.regexp_extract(host, pattern, i).try_cast("int") for i in (1, 2, 3))
    private = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254))
        | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    )
    return F.coalesce(host.rlike(pattern) & private, F.lit(False))


def is_public(url: Column) -> Column:
    """http or https with a host that is not local by its name or literal address, and no user. Names are not resolved."""
    host = F.lower(part(url, "host"))
    local = host.isin("", "localhost", "localhost.localdomain") | host.endswith(".local") | is_private_ip(host)
    return part(url, "scheme").isin("http", "https") & (part(url, "user") == "") & ~local


def search_links(query: Column) -> Column:
    """The encoded search URLs of four photo sites."""
    q = F.url_encode(F.trim(query))
    path = F.replace(q, F.lit("+"), F.lit("%20"))
    return F.struct(
        F.concat(F.lit("https://www.freepik.com/search?query="), q).alias("freepik"), F.concat(F.lit("https://www.pexels.com/search/"), path, F.lit("/")).alias("pexels"),
        F.concat(F.lit("https://stocksnap.io/search/"), q).alias("stocksnap"), F.concat(F.lit("https://pixabay.com/images/search/"), path, F.lit("/")).alias("pixabay"),
    )
