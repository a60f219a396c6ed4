import numpy as np
from helpers import ODD, given, table
from pyspark.sql import functions as F

from quirelake.llm import language_id, linear, quality, queries

SF = "/root/testdata/sf0.01"


def test_hinge_fit_reaches_the_optimum_of_a_small_problem():
    rows = [(np.array([0]), np.array([1.0])), (np.array([0]), np.array([-1.0]))]
    w = linear.fit_hinge(rows, np.array([1.0, -1.0]), 1, cost=10.0, epochs=50)
    assert abs(w[0] - 1) < 1e-3 and abs(w[1]) < 1e-3
    a, b = linear.fit_sigmoid(np.r_[np.full(50, 2.0), np.full(50, -2.0)], np.r_[np.ones(50, bool), np.zeros(50, bool)])
    assert a > 0.5 and abs(b) < 0.1


def test_language_held_out(spark):
    got = queries.op3_language_id(spark, SF).join(given(spark, "sf0.01").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and 150 < len(held) < 350
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_language_is_read_from_the_text_alone(spark):
    docs = given(spark)
    a = language_id.identify(docs.limit(50), learn_from=docs)
    swapped = docs.limit(50).withColumns({"lang": F.lit("xx"), "source": F.lit("y"), "doc_id": F.col("doc_id") + 1000})
    b = language_id.identify(swapped, learn_from=docs)
    assert sorted((r.text, r.lang_pred, r.score) for r in a.collect()) == sorted((r.text, r.lang_pred, r.score) for r in b.collect())


def test_language_of_odd_rows(spark):
    docs = given(spark)
    told = language_id.identify(table(spark, [*ODD, (30, "12 34 !!")]), learn_from=docs).collect()
    assert len(told) == len(ODD) + 1
    by = {r.doc_id: r.lang_pred for r in told}
    assert by[0] == by[1] == by[2] == by[30] == "und" and by[3] != "und"
    assert language_id.identify(table(spark, [])).count() == 0
    assert {r.lang_pred for r in language_id.identify(table(spark, [(1, "abc")]).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_every_labelled_language_is_learned(spark):
    names = [f"x{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(70)]
    rows = [(j * 100 + i, f"{name} " * 12, name, "s", 48) for i, name in enumerate(names) for j in range(4)]
    assert language_id.fit(table(spark, rows)).langs == sorted(names)
    last = language_id.identify(table(spark, [(1, "xcr " * 9)]), learn_from=table(spark, rows)).first()
    assert names[-1] == "xcr" and last.lang_pred == "xcr"


def test_lettered_rows_stay_without_a_model(spark):
    docs = table(spark, [*ODD, (30, "12 34 !!")]).withColumn("lang", F.lit(None).cast("string"))
    left = language_id.keep_identified(docs)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(["3", "4", "5", "6", "6", "7", "8", "9", "None"])


def test_long_texts_are_summed_in_slices(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["abc def ghi " * 9, "", None, "ñandú", "xy", "z" * 50])
    w = np.random.default_rng(1).normal(size=(2, language_id.SPACE))
    whole = language_id._sums(texts, w)
    for cut in (1, 7, 64):
        monkeypatch.setattr(language_id, "_CUT", cut)
        part = language_id._sums(texts, w)
        assert np.allclose(whole[0], part[0]) and (whole[1] == part[1]).all()
    a = quality._present(np.frombuffer(b"hello world", np.uint8))
    monkeypatch.setattr(quality, "_CUT", 3)
    assert (quality._present(np.frombuffer(b"hello world", np.uint8)) == a).all()


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = queries.op6_quality(spark, SF)
    assert scored.count() == 1000
    got = scored.join(labels, "doc_id").where("held_out").collect()
    good, bad = (np.array([r.score for r in got if r.quality == q]) for q in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert all(r.predicted == int(r.score >= 0.3) for r in got)


def test_quality_of_odd_rows_and_without_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    docs = given(spark)
    model = quality.fit(docs, labels)
    rows = table(spark, ODD).select("doc_id", quality.scorer(model)(F.col("text")).alias("s")).collect()
    assert len(rows) == len(ODD) and all(0 <= r.s <= 1 for r in rows)
    assert len({r.score for r in quality.classify(docs, labels.limit(0)).collect()}) == 1
    assert quality.classify(table(spark, []), labels).count() == 0


def test_predictions_by_hand_given_the_model(spark):
    docs = given(spark)
    model = language_id.fit(docs)
    texts = [r.text for r in docs.orderBy("doc_id").limit(25).collect()] + [t for _, t in ODD]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", language_id.predictor(model)("text").alias("p")).collect()
    family = {x: language_id._FAMILY.get(x, x) for x in model.langs}

    def winner(group, members, margin):
        votes, sums, least = ({m: 0.0 for m in members} for _ in range(3))
        least = {m: 30.0 for m in members}
        for (g, a, b), s in margin.items():
            for k, v in ((a, s), (b, -s)) if g == group else ():
                votes[k], sums[k], least[k] = votes[k] + (v > 0), sums[k] + v, min(least[k], v)
        best = max(members, key=lambda m: (votes[m], sums[m]))
        return best, 1 / (1 + np.exp(-2 * np.clip(least[best], -15, 15)))

    for r in got:
        raw = np.frombuffer((r.text or "").lower().encode(), np.uint8)
        slots = [int(language_id._slots(raw[i : i + 3])[0]) for i in range(len(raw) - 2)]
        margin = {pair: sum(model.weights[k][s] for s in slots) / max(len(slots), 1) * 20 + model.bias[k] for k, pair in enumerate(model.pairs)}
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.p["lang"], r.p["score"]) == ("und", 0.0)
            continue
        f, sure = winner("", sorted(set(family.values())), margin)
        lang, own = winner(f, sorted(x for x in model.langs if family[x] == f), margin)
        assert r.p["lang"] == lang and abs(r.p["score"] - sure * own) < 1e-6


def test_clashing_columns_stay(spark):
    docs = given(spark).limit(5).selectExpr("*", "1 AS score", "2 AS _score", "3 AS _lang", "'q' AS lang_pred")
    assert language_id.keep_identified(docs).columns == docs.columns
    assert language_id.identify(docs).first()._lang == 3


def test_samples_are_bounded(spark):
    rows = [(7, "wort " * 5000, "de", "s", 1)] * 5 + [(8, "word " * 5000, "en", "s", 1)]
    found = language_id.sample(table(spark, rows))
    assert [(x, len(p)) for x, p in found] == [("de", language_id.PIECES), ("en", language_id.PIECES)]


def test_quality_scores_by_hand_given_the_model(spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    docs = given(spark)
    weights, bias, a, b = model = quality.fit(docs, labels)
    some = docs.orderBy("doc_id").limit(30).withColumn("s", quality.scorer(model)(F.col("text"))).collect()
    for r in some:
        raw = (r.text or "").lower().encode()
        grams = {raw[i : i + n] for n in (1, 2, 3) for i in range(len(raw) - n + 1)}
        held = {int(f) for g in grams for f in quality._present(np.frombuffer(g, np.uint8))}
        words = (r.text or "").lower().split()
        share = np.mean([x == y for x, y in zip(words, words[1:], strict=False)]) if len(words) > 1 else 0.0
        held |= {quality.SPACE + i for i, x in enumerate(quality.REPEATED) if share > x}
        margin = sum(weights[f] for f in held) / max(len(held), 1) ** 0.5 + bias
        assert abs(r.s - 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))) < 1e-9
