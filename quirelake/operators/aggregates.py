"""Roll-ups and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quirelake.functions import text as tx


def term_matches(docs: DataFrame, terms: list[str], most: int = 50) -> DataFrame:
    """(term, matches, total): literal occurrences of each term over all texts and their sum. Blank terms are dropped;
    at most `most` distinct ones are counted, in one pass over the texts."""
    terms = list(dict.fromkeys(t for t in terms if t.strip()))[:most]
    counts = docs.agg(*[F.coalesce(F.sum(tx.occurrences(F.col("text"), F.lit(t))), F.lit(0)).alias(f"t{i}") for i, t in enumerate(terms)])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"t{i}").alias("matches")) for i, t in enumerate(terms)])).alias("r"), sum(F.col(f"t{i}") for i in range(len(terms))).alias("total"))
    return rows.select("r.term", "r.matches", "total")


def batch_outcome(files: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Per batch: detected, formatted, skipped, failed, link sums and ordered name lists (status, links, links_ok)."""
    def names(status: str):
        return F.array_join(F.sort_array(F.collect_list(F.when(F.col("status") == status, F.col("filename")))), "|")

    return files.groupBy(batch).agg(
        F.count("*").alias("detected"), F.count_if(F.col("status") == "formatted").alias("formatted"), F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.sum("links").alias("links"), names("skipped").alias("skipped_names"), names("failed").alias("failed_names"),
    )


def duplicate_numbers(files: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Numbers of a batch with more than one file, and their names in any-case order."""
    names = F.transform(F.array_sort(F.collect_list(F.struct(F.lower("filename").alias("l"), F.col("filename").alias("n")))), lambda s: s["n"])
    return files.groupBy(batch, "number").agg(F.count("*").alias("n_files"), F.array_join(names, "|").alias("names")).where("n_files > 1")


def consensus(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The group's value where all non-null ones agree, else null."""
    return rows.groupBy(group).agg(F.when(F.count_distinct(value) == 1, F.first(value, ignorenulls=True)).alias(value))


def next_id(rows: DataFrame, column: str) -> DataFrame:
    """The largest numeric id plus one; ids that are no numbers are left out; 1 without any."""
    return rows.agg((F.coalesce(F.max(F.col(column).try_cast("int")), F.lit(0)) + 1).alias("next_id"))


def chapter_progress(spine: DataFrame, plans: DataFrame, cursor: int) -> DataFrame:
    """Per chapter of spine: planned, searched (queue place below the cursor), found, approved; zeros where nothing is."""
    done = F.col("place") < cursor
    counts = plans.groupBy("chapter").agg(
        F.count("*").alias("planned"), F.count_if(done).alias("searched"), F.count_if(done & F.col("found")).alias("found"), F.count_if(done & F.col("found") & F.col("approved")).alias("approved")
    )
    return spine.join(counts, "chapter", "left").na.fill(0, ["planned", "searched", "found", "approved"])


def progress_totals(progress: DataFrame, review: str) -> DataFrame:
    """Chapter rows and review totals in one pass: found, planned, remaining, has_more; chapter is null in totals."""
    out = progress.rollup(review, "chapter").agg(F.sum("found").alias("found"), F.sum("planned").alias("planned"), F.sum(F.col("planned") - F.col("searched")).alias("remaining"))
    return out.where(F.col(review).isNotNull()).withColumn("has_more", F.col("remaining") > 0)


# The counters of a run's report, its settings, and its lists.
RUN_COUNTERS = (
    "chapters_processed", "guides_created", "documents_with_images", "image_recommendations", "photos_inserted", "covers_prepared", "openrouter_refined_sections",
    "generation_attempts", "freepik_stock_downloads", "freepik_search_attempts", "image_library_hits",
)
RUN_SETTINGS = ("mode", "image_source", "freepik_enabled", "reuse_existing")
RUN_LISTS = ("image_sources", "cover_sources")
RUN_PROVIDERS = ("pexels", "pixabay", "openverse", "freepik", "openrouter", "openai")


def run_summary(facts: DataFrame, run: str) -> DataFrame:
    """One row a run from its facts (run, seq, kind, amount, detail), as they come in any number and order.

    Counters are sums of amounts, 0 without a fact; a setting is its last detail; lists hold all details in order of
    seq; warnings each once, at its first place; providers_configured tells for each provider whether a fact of kind
    `provider` names it. A row holds the lists of its run.
    """
    of = lambda kind: F.col("kind") == kind
    details = lambda rows: F.transform(F.array_sort(rows), lambda x: x["detail"])
    # a warning counts once, so that repeated ones are not gathered
    warned = facts.where(of("warning")).groupBy(run, "detail").agg(F.min("seq").alias("seq"))
    warned = warned.groupBy(run).agg(details(F.collect_list(F.struct("seq", "detail"))).alias("warnings"))
    rows = facts.groupBy(run).agg(
        *[F.coalesce(F.sum(F.when(of(c), F.col("amount"))), F.lit(0)).alias(c) for c in RUN_COUNTERS],
        *[F.max_by("detail", F.when(of(c), F.col("seq"))).alias(c) for c in RUN_SETTINGS],
        *[details(F.collect_list(F.when(of(c), F.struct("seq", "detail")))).alias(c) for c in RUN_LISTS],
        F.create_map(*[x for p in RUN_PROVIDERS for x in (F.lit(p), F.coalesce(F.bool_or(of("provider") & (F.col("detail") == p)), F.lit(False)))]).alias("providers_configured"),
    )
    return rows.join(warned, run, "left").withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>")))


def cumulative_counters(attempts: DataFrame, group: str, batch: str) -> DataFrame:
    """Per group and batch: attempts and successes, running over the batches."""
    own = W.partitionBy(group).orderBy(batch)
    per = attempts.groupBy(group, batch).agg(F.count("*").alias("attempts"), F.count_if("found").alias("successes"))
    return per.withColumns({"attempts": F.sum("attempts").over(own), "successes": F.sum("successes").over(own)})
