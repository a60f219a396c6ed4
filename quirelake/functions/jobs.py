"""Labels and parents of jobs, from their type and the details they carry as JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels of job types and of the actions of an edit, and the details that name a job's source.
LABELS = {
    "format": "Initial format",
    "format_batch": "Batch format",
    "simple_edit": "Formatting edit",
    "text_edit": "Text edit",
    "footer_edit": "Footer edit",
    "toc_update": "TOC update",
    "clean_spacing": "Spacing clean",
    "formatted_word_to_pdf": "PDF conversion",
    "references_bullets": "References → Bullets",
}
ACTION_LABELS = {
    "heading1": "→ Heading 1",
    "bullets": "→ Bullets",
    "numbering": "→ Numbering",
    "references_bullets": "→ Reference Bullets",
    "normal": "→ Normal text",
    "page_break_before": "→ New page",
    "remove_page_break_before": "→ Normal flow",
    "keep_together": "→ Keep together",
    "allow_split": "→ Allow split",
    "blank_line_before": "+ Blank line above",
    "blank_line_after": "+ Blank line below",
}
SOURCE_KEYS = ("simple_edit", "text_edit", "footer_edit", "toc_update", "clean_spacing")


def _named(value: Column, names: dict[str, str]) -> Column:
    return reduce(lambda out, pair: F.when(value == pair[0], pair[1]).otherwise(out), names.items(), F.lit(None).cast("string"))


def job_label(kind: Column, details: Column) -> Column:
    """The label of a job's type, else the type itself; an edit with a known action is named by that."""
    action = _named(F.get_json_object(details, "$.simple_edit.action"), ACTION_LABELS)
    by_action = F.when(kind == "simple_edit", F.concat(F.lit("Edit "), action))
    return F.coalesce(by_action, _named(kind, LABELS), kind)


def source_job(details: Column) -> Column:
    """The id of the job that a job started from: the first that its details name, else that of the formatting."""
    named = [F.get_json_object(details, f"$.{key}.source_job_id") for key in SOURCE_KEYS]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (*named, F.get_json_object(details, "$.source_format_job_id"))])
