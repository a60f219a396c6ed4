"""Operators over the paragraph table: ordered rules and state that runs down a document.

Rows carry doc_id and para_index; all windows are by doc_id in para_index order, so that a chain of these operators
needs one shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quirelake.functions import text as tx


def order():
    return W.partitionBy("doc_id").orderBy("para_index")


def so_far():
    return order().rowsBetween(W.unboundedPreceding, 0)


def before():
    return order().rowsBetween(W.unboundedPreceding, -1)


def under_skipped_heading(par: DataFrame, closing: list[str]) -> DataFrame:
    """par with excluded: whether a heading of kind `skip` still hides the row.

    A skip heading of level L hides what follows until a heading of one of the closing kinds has a level of L or less;
    a later skip heading sets L anew.
    """
    part = W.partitionBy("doc_id", "_sg").orderBy("para_index").rowsBetween(W.unboundedPreceding, 0)
    closes = F.when(F.col("kind").isin(*closing), F.col("level"))
    skip = F.when(F.col("kind") == "skip", F.col("level"))
    out = par.withColumn("_sg", F.sum(F.when(F.col("kind") == "skip", 1).otherwise(0)).over(so_far()))
    out = out.withColumns({"_limit": F.max(skip).over(part), "_least": F.min(closes).over(part)})
    return out.withColumn("excluded", (F.col("_sg") > 0) & F.coalesce(F.col("_least") > F.col("_limit"), F.lit(True))).drop("_sg", "_limit", "_least")


def plannable_headings(par: DataFrame) -> DataFrame:
    """Headings of kind `head` outside skipped sections."""
    return under_skipped_heading(par, ["head"]).where("kind = 'head' AND NOT excluded").drop("excluded")


def overview_rows(par: DataFrame, least: int = 30, longest: int = 350) -> DataFrame:
    """Body rows for a chapter's overview: longer than least characters, outside skipped sections, cut to longest."""
    rows = under_skipped_heading(par.where(F.trim("text") != ""), ["head", "skip_only"]).where(~F.col("is_heading") & ~F.col("excluded"))
    return rows.where(F.length("text") > least).select("doc_id", "para_index", F.left("text", F.lit(longest)).alias("phrase"))


def in_titled_section(par: DataFrame, opens: Column) -> DataFrame:
    """par with in_section: a row where opens holds starts it, the next heading with text ends it."""
    flag = F.when(opens, True).when(F.col("is_heading") & (F.trim("text") != ""), False)
    return par.withColumn("in_section", F.coalesce(F.last(flag, ignorenulls=True).over(so_far()), F.lit(False)))


def reference_rows(par: DataFrame, is_reference: Column) -> DataFrame:
    """The text rows after the first reference heading up to the next other heading."""
    out = par.withColumn("_ref", is_reference)
    out = out.withColumn("_open", F.max(F.col("_ref").cast("int")).over(before()) == 1)
    stops = F.col("is_heading") & ~F.col("_ref") & F.coalesce("_open", F.lit(False))
    out = out.withColumn("_stop", F.max(stops.cast("int")).over(so_far()))
    return out.where("_open AND _stop = 0 AND NOT _ref AND NOT is_heading AND trim(text) <> ''").drop("_ref", "_open", "_stop")


def context_excerpts(par: DataFrame, ahead: int = 12, enough: int = 1000, longest: int = 1100) -> DataFrame:
    """Headings with excerpt: the rows after them up to the next heading, until enough characters are gathered.

    Rows are numbered to the heading they follow and gathered by it, each once; one shuffle by document serves all.
    """
    rows = par.withColumn("_r", F.row_number().over(order())).withColumn("_clean", tx.collapsed(F.col("text")))
    rows = rows.withColumn("_h", F.last(F.when(F.col("is_heading"), F.col("_r")), ignorenulls=True).over(so_far()))
    near = F.col("is_heading") | ((F.col("_r") - F.col("_h") <= ahead) & (F.col("_clean") != ""))
    size = F.when(~F.col("is_heading"), F.length("_clean"))
    own = W.partitionBy("doc_id", "_h").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.where(F.col("_h").isNotNull() & near).withColumn("_before", F.coalesce(F.sum(size).over(own), F.lit(0)))
    body = F.when(~F.col("is_heading") & (F.col("_before") < enough), F.struct("_r", F.left("_clean", F.lit(longest)).alias("line")))
    head = F.first(F.when(F.col("is_heading"), F.struct(*par.columns)), ignorenulls=True)
    met = rows.groupBy("doc_id", "_h").agg(head.alias("_head"), F.collect_list(body).alias("_rows"))  # `ahead` rows at most
    text = F.array_join(F.transform(F.array_sort("_rows"), lambda x: x["line"]), " ")
    return met.select("_head.*", F.left(text, F.lit(longest)).alias("excerpt"))


def picture_ahead(par: DataFrame) -> DataFrame:
    """Headings with picture_ahead: a picture in the next two rows before a heading or text."""
    one, two = (lambda c: F.lead(c, 1).over(order())), (lambda c: F.lead(c, 2).over(order()))

    def blocked(look) -> Column:
        return look("is_heading") | (F.trim(look("text")) != "")

    near = one("has_picture")
    far = ~blocked(one) & ~one("has_picture") & two("has_picture")
    out = par.withColumn("picture_ahead", F.coalesce(near | far, near, F.lit(False)))
    return out.where("is_heading")


def _run(par: DataFrame, flag: Column, name: str) -> DataFrame:
    """par with the place of each row in its run of rows where flag holds, from 1; 0 elsewhere."""
    out = par.withColumn("_f", flag)
    out = out.withColumn("_g", F.row_number().over(order()) - F.sum(F.col("_f").cast("int")).over(so_far()))
    place = F.row_number().over(W.partitionBy("doc_id", "_g", "_f").orderBy("para_index"))
    return out.withColumn(name, F.when(F.col("_f"), place).otherwise(0)).drop("_f", "_g")


def collapse_blank_runs(par: DataFrame, most: int = 1, transparent: Column | None = None) -> DataFrame:
    """par without the blanks that stand more than `most` in a run; rows with a break are no blanks, rows that are
    transparent neither count nor interrupt."""
    seen = par if transparent is None else par.where(~transparent)
    kept = _run(seen, F.col("is_blank") & ~F.col("has_break"), "_n").where(F.col("_n") <= most).drop("_n")
    return kept if transparent is None else kept.unionByName(par.where(transparent))


def spacing_issues(par: DataFrame) -> DataFrame:
    """(doc_id, para_index, kind): extra_blank, blank_page, multi_break, orphan_heading, split_paragraph."""
    out = _run(par, F.col("is_blank") & ~F.col("has_break"), "_blank")
    out = _run(out, F.col("has_break"), "_break")
    breaks = F.col("has_break") | F.col("page_break_before")
    ahead = F.collect_list(F.struct(breaks.alias("b"), F.col("is_blank").alias("e"))).over(order().rowsBetween(1, 5))
    nearest = F.get(F.filter(ahead, lambda r: r["b"] | ~r["e"]), F.lit(0))["b"]
    cut = F.lead(breaks).over(order()) & ~F.col("is_blank") & (F.trim("text") != "") & ~F.right(F.trim("text"), F.lit(1)).isin(".", "?", "!", ":", "’", "”", ")")
    kinds = F.array(
        F.when(F.col("_blank") > 1, "extra_blank"), F.when(F.col("_break") == 2, "blank_page"), F.when(F.col("_break") > 2, "multi_break"),
        F.when(F.col("is_heading") & F.col("_ahead"), "orphan_heading"), F.when(F.col("_cut"), "split_paragraph"),
    )
    out = out.withColumns({"_ahead": nearest, "_cut": cut})
    return out.select("doc_id", "para_index", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))


def adjacent_headings(par: DataFrame) -> DataFrame:
    """Headings directly after a heading."""
    return par.withColumn("_before", F.lag("is_heading").over(order())).where("is_heading AND _before").drop("_before")


def contents_entries(par: DataFrame, start_page: int = 1) -> DataFrame:
    """Headings with text, as contents: doc_id, para_index, bookmark, level, text, page.

    A heading starts a page unless it is the document's first block with text or directly follows a heading; the page
    is start_page plus the starts so far, without the first entry's own. Rows inside text boxes (in_box, if there is
    such a column) neither start pages nor come between headings, and rows that are only marks (is_mark) do not either.
    """
    aside = [F.col(c) for c in ("in_box", "is_mark") if c in par.columns]
    seen = par.where(~reduce(lambda x, y: x | y, aside)) if aside else par
    first = F.min(F.when(F.trim("text") != "", F.col("para_index"))).over(W.partitionBy("doc_id"))
    starts = F.col("is_heading") & (F.col("para_index") != first) & ~F.coalesce(F.lag("is_heading").over(order()), F.lit(False))
    rows = seen.withColumn("_starts", starts).where("is_heading AND trim(text) <> ''")
    nth = F.row_number().over(order())
    page = F.sum(F.when(F.col("_starts") & (F.col("_nth") > 1), 1).otherwise(0)).over(so_far()) + start_page
    return rows.withColumn("_nth", nth).select("doc_id", "para_index", F.format_string("_Toc%08d", F.col("_nth") + 1000).alias("bookmark"), "level", "text", page.alias("page"))


def pending_labels(rows: DataFrame) -> DataFrame:
    """rows (doc_id, para_index, text, label_number, n_links, excluded) with taken: the number that a stand-alone label
    passes to the single unnumbered link of the next row with text. Text, links and excluded sections clear it."""
    state = F.when(F.col("excluded") | (F.col("n_links") > 0), -1).when(F.col("label_number").isNotNull(), F.col("label_number")).when(F.trim("text") != "", -1)
    waiting = F.last(state, ignorenulls=True).over(before())
    return rows.withColumn("taken", F.when((F.col("n_links") == 1) & ~F.col("excluded") & (waiting >= 0), waiting))


def remaining_pages(pages: DataFrame, removed: DataFrame) -> DataFrame:
    """The rows (doc_id, position) left after removed (doc_id, position), numbered anew; a document whose selection is
    empty, out of range or everything gives no row but stays out as a whole."""
    size = pages.groupBy("doc_id").agg(F.count("*").alias("n"))
    wish = removed.distinct().groupBy("doc_id").agg(F.count("*").alias("m"), F.min("position").alias("lo"), F.max("position").alias("hi"))
    valid = size.join(wish, "doc_id").where("lo >= 1 AND hi <= n AND m < n").select("doc_id")
    left = pages.join(valid, "doc_id", "left_semi").join(removed, ["doc_id", "position"], "left_anti")
    return left.withColumn("page", F.row_number().over(W.partitionBy("doc_id").orderBy("position")))
