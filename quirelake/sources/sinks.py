"""Sinks and what is written to them: report sections, current state, the library of earlier answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quirelake.functions import text as tx


# The sections of a report and their columns.
REPORT = {
    "documents": ("Document path", "Status", "Eligible headings", "Planned images", "Photos found", "Approved images", "Inserted images", "Message"),
    "sources": ("Chapter", "Heading", "Source provider", "Licence", "Photographer", "Source URL", "Relevance check", "Relevance estimate (uncalibrated)", "Relevance rationale"),
    "missing": ("Chapter", "Heading", "Suggested search words"),
    "notices": ("Processing notices",),
}


def csv_section(rows: DataFrame, section: str | None = None) -> DataFrame:
    """rows with every text cell safe for spreadsheets, and, for a section of REPORT, its columns in order."""
    rows = rows if section is None else rows.select(*REPORT[section])
    return rows.select(*[tx.csv_safe(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`") for f in rows.schema])


def write_report(sections: dict[str, DataFrame], folder: str) -> None:
    """One CSV dataset for each section under folder; a section without rows gives a header alone."""
    for name, rows in sections.items():
        csv_section(rows, name).write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{folder}/{name}")


def read_report(spark: SparkSession, folder: str) -> DataFrame:
    """(section, line): the rows of a report that write_report wrote, cells joined by tabs."""
    read = lambda x: spark.read.schema(", ".join(f"`{c}` string" for c in REPORT[x])).options(header=True, escape='"', multiLine=True)
    parts = [read(x).csv(f"{folder}/{x}").select(F.lit(x).alias("section"), F.array_join(F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in REPORT[x]]), "\t").alias("line")) for x in REPORT]
    return reduce(DataFrame.unionByName, parts)


# The wording of a validation report.
COUNTERS = ("Image insertion positions found: ", "Images inserted: ", "Missing images: ", "Unused uploaded images: ")
SECTIONS = ("Missing Images", "Unused Images", "Duplicate Placeholders", "Duplicate Image Numbers", "Corrupted Images", "Unsupported or Invalidly Named Files", "Archive Errors")
ENDINGS = ("Formatting completed with warnings.", "Formatting successful.")


def validation_report(docs: DataFrame, places: DataFrame, files: DataFrame, problems: DataFrame) -> DataFrame:
    """(doc_id, report): counters, each section that has lines, and a closing line, for every row of docs (doc_id).

    places (doc_id, number, filename): a row an occurrence of a placeholder, with the file put there or null. files
    (doc_id, number, filename, chosen): the valid files. problems (doc_id, kind, name, reason): kind is `corrupted`,
    `unsupported` or `archive`. Each table is read once and brought to one row a document, whose arrays make the lines.
    """
    by_number = places.groupBy("doc_id", "number").agg(F.count("*").alias("n"), F.count("filename").alias("there"), F.collect_set("filename").alias("names"))
    asked = by_number.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("number", "n", "there", "names"))).alias("p"))
    of_number = files.groupBy("doc_id", "number").agg(F.count("*").alias("n"), F.max(F.when(F.col("chosen"), F.col("filename"))).alias("pick"), F.collect_list("filename").alias("names"))
    given = of_number.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("number", "n", "pick", "names"))).alias("f"))
    wrong = problems.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("name", "reason", "kind"))).alias("b"))
    rows = reduce(lambda d, x: d.join(x, "doc_id", "left"), [asked, given, wrong], docs.select("doc_id").distinct())
    rows = rows.select("doc_id", *[F.coalesce(c, F.array().cast(t.schema[c].dataType)).alias(c) for c, t in (("p", asked), ("f", given), ("b", wrong))])
    image = lambda x: F.concat(F.lit("Image "), x["number"].cast("string"))
    total = lambda values, zero=0: F.aggregate(values, F.lit(zero).cast("long"), lambda a, x: a + x)
    in_order = lambda names: F.transform(F.array_sort(F.transform(names, lambda x: F.struct(F.lower(x).alias("l"), x.alias("n")))), lambda x: x["n"])
    gone = F.filter("p", lambda x: x["n"] > x["there"])
    missed = total(F.transform(gone, lambda x: x["n"] - x["there"]))
    names = lambda c: F.array_distinct(F.flatten(F.transform(c, lambda x: x["names"])))
    rows = rows.withColumns({"gone": gone, "missed": missed, "idle": in_order(F.array_except(names("f"), names("p")))})

    def doubled(x: Column) -> Column:
        pick = F.coalesce(x["pick"], F.lit("none (all invalid)"))
        others = in_order(F.filter(x["names"], lambda n: ~n.eqNullSafe(pick)))
        return F.concat(F.array(F.concat(image(x), F.lit(": selected "), pick)), F.transform(others, lambda n: F.concat(F.lit("  Ignored duplicate: "), n)))

    told = lambda x: F.concat_ws(": ", x["name"], x["reason"])
    of_kind = lambda kind, text: F.transform(F.filter("b", lambda x: x["kind"] == kind), text)
    often = F.when(F.col("missed") > F.size("gone"), F.array(F.concat(F.lit("Missing placeholder occurrences: "), F.col("missed").cast("string"))))
    sections = [
        F.concat(F.transform("gone", image), F.coalesce(often, F.array().cast("array<string>"))), F.col("idle"),
        F.transform(F.filter("p", lambda x: x["n"] > 1), lambda x: F.concat(image(x), F.lit(": "), x["n"].cast("string"), F.lit(" occurrences"))),
        F.flatten(F.transform(F.filter("f", lambda x: x["n"] > 1), doubled)),
        of_kind("corrupted", told), of_kind("unsupported", lambda x: x["name"]), of_kind("archive", told),
    ]
    rows = rows.select("doc_id", "p", "gone", "idle", F.array(*sections).alias("lines"))
    titled = F.zip_with(F.array(*map(F.lit, SECTIONS)), "lines", lambda t, x: F.when(F.size(x) > 0, F.concat(F.lit("\n\n"), t, F.lit("\n"), F.array_join(x, "\n"))))
    rows = rows.withColumn("body", F.array_join(titled, ""))
    counts = [total(F.transform("p", lambda x: x["n"])), total(F.transform("p", lambda x: x["there"])), F.size("gone"), F.size("idle")]
    head = F.concat_ws("\n", F.lit("Document Formatting Complete\n"), *[F.concat(F.lit(t), n.cast("string")) for t, n in zip(COUNTERS, counts, strict=True)])
    end = F.when(F.col("body") == "", ENDINGS[1]).otherwise(ENDINGS[0])
    return rows.select("doc_id", F.concat(head, F.col("body"), F.lit("\n\n"), end).alias("report"))


def library_key(query, subject, orientation):
    """The content address of a search."""
    return F.sha2(F.to_json(F.array(*[F.lower(F.trim(c)) for c in (query, subject, orientation)])), 256)


def library(rows: DataFrame, sources: list[str], order: str) -> DataFrame:
    """The last saved row of each search (query, subject, orientation), of allowed sources, with its key."""
    keyed = rows.where(F.col("source").isin(*sources)).withColumn("key", library_key(F.col("query"), F.col("subject"), F.col("orientation")))
    return keyed.withColumn("_n", F.row_number().over(W.partitionBy("key").orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def current_jobs(events: DataFrame) -> DataFrame:
    """The last row of each job (job_id, ts, seq) of an append-only table of status events."""
    last = W.partitionBy("job_id").orderBy(F.desc("ts"), F.desc("seq"))
    return events.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def public(rows: DataFrame, columns: list[str], fields: dict[str, list[str]]) -> DataFrame:
    """rows without private columns and without private fields of struct columns."""
    return rows.drop(*columns).withColumns({c: F.col(c).dropFields(*names) for c, names in fields.items()})
