"""Text rules as column expressions. Patterns are Java's; `\\s`, `\\w`, `\\b` are ASCII unless noted."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that are no search tokens.
STOP_WORDS = (
    "the a an and or for of to in on at with from by about into it their your how what "
    "course chapter unit module lesson level award diploma certificate qls rqf ncfe cache "
    "using use understanding introduction principles practice practices importance overview "
    "key types role roles study studying skills basic activity activities different and"
).split()

# Headings that open a list of references.
REFERENCE_HEADINGS = (
    "references", "reference list", "bibliography", "further reading", "resources for further reference",
    "resources for further references", "resources and further reading", "reading list", "recommended reading",
    "recommended resources", "sources", "works cited", "citations", "additional reading", "additional resources",
    "suggested reading", "suggested resources", "useful resources", "useful links", "web resources",
    "online resources", "course resources", "learning resources",
)

# The patterns of headings, labels and file names.
INVISIBLE = "[\\x{00}-\\x{08}\\x{0b}\\x{0c}\\x{0e}-\\x{1f}\\x{7f}\\x{200b}\\x{200c}\\x{200d}\\x{2060}\\x{feff}]"
ZERO_WIDTH = "[\\x{ad}\\x{200b}-\\x{200f}\\x{2060}\\x{feff}]"
SPACES = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
UNIT = r"(?i)^(?:unit|chapter|module|section)\s+\d{1,3}\b"
OUTLINE = r"^(\d{1,3}(?:\s*\.\s*\d{1,3})+)(?:\s*[.)])?(?:\s|[:\-–—]|$)"
SINGLE = r"^\d{1,3}(?:\s*[.)])?(?:\s|[:\-–—]|$)"
PLACEHOLDER = (
    r"(?i)^\s*(?:(?:unit|module|lesson|chapter|section|topic|figure|placeholder)\s*[\w.()/-]+\s*(?:[-–—:|]\s*)?)*"
    r"image\s*(?:number|no\.?|#)?\s*[:#\-–—]?\s*0*(\d+)\s*[.):]?\s*$"
)
FILE_NUMBER = r"(?i)^(?:image[\s_-]*)?0*(\d+)$"
SKIP_NAME = r"(?i)\b(?:assignment brief|written assignment template)\b"


@F.arrow_udf(T.StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    """Compatibility composition; Spark has no such function, so it is asked for explicitly."""
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def heading_text(text: Column, compatible: bool = False) -> Column:
    """A heading for matching: without invisible characters, spaces collapsed; compatible applies NFKC first."""
    return collapsed(F.regexp_replace(nfkc(text) if compatible else text, INVISIBLE, ""))


def link_text(text: Column) -> Column:
    """A link's label without zero-width characters and soft hyphens, spaces collapsed."""
    return collapsed(F.regexp_replace(text, ZERO_WIDTH, ""))


def matched(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def heading_level_by_number(text: Column) -> Column:
    """The heading level (1 to 3) that visible numbering asks for; null for ordinary text."""
    clean = heading_text(text)
    low = F.lower(clean)
    number = F.regexp_extract(clean, OUTLINE, 1)
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    rest = F.regexp_replace(F.regexp_replace(clean, SINGLE, ""), r"^[ :\-–—]+", "")
    return (
        F.when(F.coalesce(clean, F.lit("")) == "", None)
        .when(F.trim(F.rtrim(low, F.lit(":"))) == "resources for further reference", 1)
        .when(low.isin("references", "table of contents"), None)
        .when(clean.rlike(r"(?i)\bimage\s+\d+\s*$"), None)
        .when(clean.rlike(UNIT), 1)
        .when(clean.rlike(OUTLINE), F.least(F.greatest(dots, F.lit(1)), F.lit(3)))
        .when(clean.rlike(SINGLE) & (rest != ""), 1)
    )


def promoted_style(style: Column, text: Column, in_text_box: Column) -> Column:
    """The style after promotion: by numbering; a Heading2 with text becomes Heading1 unless it is a list of
    references, a table of contents or an image label. Contents styles and text boxes keep theirs."""
    clean = heading_text(text)
    named = F.lower(clean).isin("references", "table of contents") | clean.rlike(r"(?i)\bimage\s+\d+\s*$")
    numbered = F.concat(F.lit("Heading"), heading_level_by_number(text).cast("string"))
    return (
        F.when(in_text_box | style.startswith("TOC"), style)
        .when((style == "Heading2") & (clean != "") & ~named, "Heading1")
        .otherwise(F.coalesce(numbered, style))
    )


def placeholder_number(text: Column) -> Column:
    """The number of a stand-alone image label of at most 240 characters."""
    return F.when(F.length(text) <= 240, matched(link_text(text), PLACEHOLDER).try_cast("long"))


def stem(name: Column) -> Column:
    """A file name without folders and without its last suffix."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    return F.when(base.rlike(r"^.+\.[^.]+$"), F.regexp_extract(base, r"^(.+)\.[^.]+$", 1)).otherwise(base)


def suffix(name: Column) -> Column:
    """The last suffix with its dot, lower-cased; empty without one."""
    return F.lower(F.regexp_extract(F.regexp_extract(name, r"([^/]*)$", 1), r"^.+(\.[^.]+)$", 1))


def file_number(name: Column) -> Column:
    """The number in a name such as `12.png` or `Image_003.jpg`."""
    return matched(F.trim(stem(name)), FILE_NUMBER).try_cast("long")


def tokens(text: Column) -> Column:
    """Lower-cased words of more than two letters that are no stop words, duplicates kept."""
    found = F.regexp_extract_all(text, F.lit("[a-zA-Z][a-zA-Z'-]+"), F.lit(0))
    kept = F.filter(found, lambda t: (F.length(t) > 2) & ~F.lower(t).isin(*STOP_WORDS))
    return F.transform(kept, lambda t: F.trim(F.lower(t), F.lit("-'")))


def reference_key(text: Column) -> Column:
    """A heading for comparison with REFERENCE_HEADINGS."""
    return F.rtrim(F.regexp_replace(F.trim(F.lower(text)), r"\s+", " "), F.lit(" :;-"))


def without_number(text: Column) -> Column:
    """Without a leading `1. ` or `2) `."""
    return F.when(text.rlike(r"^\s*\d{1,3}[.)]\s*$"), "").otherwise(F.regexp_replace(text, r"^(\s*)\d{1,3}[.)]\s+(.*)$", "$1$2"))


def safe_name(name: Column) -> Column:
    """Odd characters as `_`, no blanks or dots at the ends, at most 120 characters, `Course` if nothing is left."""
    kept = F.left(F.trim(F.regexp_replace(name, "[^a-zA-Z0-9 _.-]", "_"), F.lit(" .")), F.lit(120))
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit("Course"))


def friendly_title(name: Column, default: str = "") -> Column:
    """The stem with `_` and `-` as spaces, collapsed."""
    title = collapsed(F.regexp_replace(stem(name), "[_-]+", " "))
    return F.coalesce(F.nullif(title, F.lit("")), F.lit(default)) if default else title


def chapter_number(name: Column, index: Column) -> Column:
    """The number after chapter, unit or module, else a leading number, else the position with two digits."""
    s = stem(name)
    named = matched(s, r"(?i)(?:chapter|unit|module)\s*(\d+[a-zA-Z]?)\b")
    place = F.when(index < 100, F.lpad(index.cast("string"), 2, "0")).otherwise(index.cast("string"))
    return F.coalesce(named, matched(s, r"(?i)^(\d+[a-zA-Z]?)\b"), place)


def is_skipped_document(name: Column) -> Column:
    """Whether a file is an assignment brief or template by its name."""
    return F.regexp_replace(stem(name), "[_-]+", " ").rlike(SKIP_NAME)


def raster_formats(formats: Column) -> Column:
    """Which of jpg and png a map of formats offers, in that order."""
    return F.filter(F.array(F.lit("jpg"), F.lit("png")), lambda f: F.array_contains(F.map_keys(formats), f))


def csv_safe(cell: Column) -> Column:
    """A cell that no spreadsheet reads as a formula."""
    return F.when(F.ltrim(cell).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def occurrences(text: Column, term: Column) -> Column:
    """How often term stands in text, without overlap; 0 for an empty term."""
    cut = F.length(text) - F.length(F.replace(text, term, F.lit("")))
    return F.when(F.length(term) > 0, (cut / F.length(term)).cast("long")).otherwise(F.lit(0).cast("long"))
