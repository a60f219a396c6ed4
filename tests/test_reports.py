"""Scene descriptions, run reports, validation reports and job history on rows written out by hand."""

from pyspark.sql import functions as F

from quirelake.functions import rules, scenes
from quirelake.operators import aggregates, matching
from quirelake.sources import sinks


def test_scene_descriptions_carry_heading_and_course(spark):
    rows = [
        (1, "child_safeguarding", "Leading the Safeguarding of Children", "Reporting, referral and escalation", "Raise the concern"),
        (2, "child_safeguarding", "Leading the Safeguarding of Children", "Voice, rights and participation", "Respect the child's views"),
        (3, "healthcare", "Care Certificate", "Handling a disagreement at work today", ""), (4, "waste", "Waste Handling", "Something else entirely here", ""),
        (5, "unknown", "Course", "Heading of some words", ""), (6, "hr_payroll", "HR and Payroll", "Training and supervision", "Workforce training"),
    ]
    df = spark.createDataFrame(rows, "id int, domain string, course string, heading string, excerpt string")
    scene = rules.scene_of(F.col("domain"), F.col("heading"), F.col("excerpt"), scenes.SCENES, scenes.CONFLICTS, scenes.FALLBACK, scenes.CONFLICT_PATTERN, F.col("course"), scenes.WORDING)
    got = {r.id: r.scene for r in df.select("id", scene.alias("scene")).collect()}
    assert "report" in got[1].search and "listening" in got[2].description and got[1].search != got[2].search
    assert got[1].description.startswith("A natural, realistic landscape stock photograph for 'Reporting, referral and escalation' in the course 'Leading the Safeguarding of Children': ")
    assert got[1].description.endswith("no advertising, watermarks or readable private information.")
    assert got[3].description == "A realistic landscape stock photograph for 'Handling a disagreement at work today' in 'Care Certificate': healthcare colleagues discussing a workplace disagreement professionally. No promotional text, watermarks or visible private information."
    assert got[4].search == scenes.FALLBACK["waste"][0] and got[4].description.endswith("otherwise leave the heading without a photograph. No text or watermarks.")
    assert got[5] is None and "hr" in got[6].description.lower()
    short = rules.scene_of(F.col("domain"), F.col("heading"), F.col("excerpt"), scenes.SCENES, scenes.CONFLICTS, scenes.FALLBACK, scenes.CONFLICT_PATTERN)
    assert {r.id: r.d for r in df.select("id", short["description"].alias("d")).collect()}[4] == scenes.FALLBACK["waste"][1]


def test_run_report(spark):
    facts = [
        ("a", 5, "photos_inserted", 2, None), ("a", 1, "photos_inserted", 1, None), ("a", 9, "warning", 1, "late"), ("a", 2, "warning", 1, "no key"), ("a", 3, "warning", 1, "late"),
        ("a", 4, "mode", 1, "guide"), ("a", 6, "mode", 1, "insert"), ("a", 8, "image_sources", 1, "second"), ("a", 7, "image_sources", 1, "first"), ("a", 10, "provider", 1, "pexels"),
        ("b", 1, "chapters_processed", 4, None),
    ]
    got = {r.run: r for r in aggregates.run_summary(spark.createDataFrame(facts, "run string, seq long, kind string, amount long, detail string"), "run").collect()}
    a, b = got["a"], got["b"]
    assert (a.photos_inserted, a.chapters_processed, a.mode, a.image_source, a.image_sources, a.cover_sources) == (3, 0, "insert", None, ["first", "second"], [])
    assert a.warnings == ["no key", "late"] and a.providers_configured["pexels"] and not a.providers_configured["openai"]
    assert (b.chapters_processed, b.warnings, b.mode) == (4, [], None)


def test_validation_report_of_every_section(spark):
    docs = spark.createDataFrame([(1,), (2,), (1,)], "doc_id long")
    places = spark.createDataFrame([(1, 1, "1.jpg"), (1, 2, None), (1, 2, None), (1, 3, None)], "doc_id long, number int, filename string")
    files = spark.createDataFrame([(1, 1, "1.jpg", True), (1, 1, "Image 1.png", False), (1, 5, "b.png", True), (1, 6, "A.png", False), (1, 6, "a.png", False)], "doc_id long, number int, filename string, chosen boolean")
    problems = spark.createDataFrame([(1, "corrupted", "z.png", "not an image"), (1, "archive", "u.zip", "cannot be read"), (1, "unsupported", "q.txt", None)], "doc_id long, kind string, name string, reason string")
    got = {r.doc_id: r.report for r in sinks.validation_report(docs, places, files, problems).collect()}
    assert got[2] == "Document Formatting Complete\n\nImage insertion positions found: 0\nImages inserted: 0\nMissing images: 0\nUnused uploaded images: 0\n\nFormatting successful."
    assert got[1] == (
        "Document Formatting Complete\n\nImage insertion positions found: 4\nImages inserted: 1\nMissing images: 2\nUnused uploaded images: 4"
        "\n\nMissing Images\nImage 2\nImage 3\nMissing placeholder occurrences: 3\n\nUnused Images\nA.png\na.png\nb.png\nImage 1.png\n\nDuplicate Placeholders\nImage 2: 2 occurrences"
        "\n\nDuplicate Image Numbers\nImage 1: selected 1.jpg\n  Ignored duplicate: Image 1.png\nImage 6: selected none (all invalid)\n  Ignored duplicate: A.png\n  Ignored duplicate: a.png"
        "\n\nCorrupted Images\nz.png: not an image\n\nUnsupported or Invalidly Named Files\nq.txt\n\nArchive Errors\nu.zip: cannot be read\n\nFormatting completed with warnings."
    )


def test_job_history_marks_the_current_job(spark):
    jobs = spark.createDataFrame([(1, None, "format", "completed", "a.docx"), (2, 1, "edit", "completed", "b.docx"), (3, 2, "edit", "failed", "c.docx")], "job_id long, parent_id long, job_type string, status string, filename string")
    got = sorted((r.start, r.depth, r.job_id, r.is_current, r.filename) for r in matching.lineage(jobs, kept=("filename",)).collect())
    assert got == [(1, 0, 1, True, "a.docx"), (2, 0, 2, True, "b.docx"), (2, 1, 1, False, "a.docx")]
