import hashlib

import pytest
from pyspark.sql import functions as F

from evalspark.functions import ids
from evalspark.functions import text as X


def values(spark, rows, expression, schema):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema).orderBy("i").select(expression).collect()]


def test_parse_number(spark):
    cases = {"17": 17.0, "9,876,543": 9876543.0, "£3,400.25": 3400.25, "12.5%": 12.5, " 7 ": 7.0, "-0.75": -0.75, "none": None, "": None, "roughly 8": None, "3e4": None, "9.": None, None: None}
    assert values(spark, [(k,) for k in cases], X.parse_number(F.col("t")), "t string") == list(cases.values())


def test_is_correct(spark):
    cases = [("40", "42", True), ("40", "38", True), ("40", "42.1", False), ("40", "37.9", False), ("-60", "-57", True), ("-60", "-56.9", False)]
    cases += [("0", "0.00", True), ("0", "0.01", False), ("Blue", " blue\t", True), ("40", "forty", False)]
    assert values(spark, [c[:2] for c in cases], X.is_correct(F.col("g"), F.col("p")), "g string, p string") == [c[2] for c in cases]


def test_rescaled(spark):
    cases = [("71", "0.71", True), ("0.25", "25", True), ("38.2", "0.38", True), ("71", "0.6", False), ("71", "71", False), ("red", "0.71", False), ("71", "red", False)]
    assert values(spark, [c[:2] for c in cases], X.rescaled_match(F.col("g"), F.col("p")), "g string, p string") == [c[2] for c in cases]


def test_classify_absent(spark):
    cases = {"18": "fabricated", "6.25%": "fabricated", "2,750.": "fabricated", "0": "zero", "0.00": "zero", "Not in the chart": "rejected", "None": "rejected", "N/A": "rejected", "No value": "rejected", "Papaya": "unclear", "12 (not drawn)": "unclear", "": "unclear"}
    assert values(spark, [(k,) for k in cases], X.classify_absent(F.col("t")), "t string") == list(cases.values())


def test_classify_compare(spark):
    none = F.array().cast("array<string>")
    cases = {"Plum": "fabricated", "plum.": "fabricated", "Cherry": "picked_present", "Plum is not drawn": "rejected", "None": "rejected", "Both": "unclear"}
    assert values(spark, [(k,) for k in cases], X.classify_compare(F.col("t"), F.lit("Plum"), F.lit("Cherry"), none), "t string") == list(cases.values())
    assert values(spark, [("Lima",)], X.classify_compare(F.col("t"), F.lit("Quito"), F.lit("Bogota"), F.array(F.lit("Lima"))), "t string") == ["fabricated"]


def test_verified_answer(spark):
    cases = {"Let me look.\nAnswer: 12": ("12", True), "y\n**Answer:** 12": ("12", True), "Answer: 7\nAnswer: 9": ("9", True), "Twelve, I think.": ("Twelve, I think.", False)}
    assert [tuple(v) for v in values(spark, [(k,) for k in cases], X.verified_answer(F.col("t")), "t string")] == list(cases.values())


def test_question_targets(spark):
    letters = F.array(*[F.lit(c) for c in "PQRST"])
    cases = {"category P?": [0], "Q or S": [1, 3], "category U": [], "Quite Red Tones?": []}
    assert values(spark, [(k,) for k in cases], X.question_targets(F.col("t"), letters), "t string") == list(cases.values())


def test_sanitize(spark):
    assert values(spark, [("  Bob Stone ",)], X.sanitize(F.col("t")), "t string") == ["bob_stone"]
    with pytest.raises(Exception, match="no usable characters"):
        values(spark, [("??",)], X.sanitize(F.col("t")), "t string")


def test_answers_meet_terms_that_are_normalised_before(spark):
    """A figure's texts are normalised once, not for each answer; NULLs among texts and answers are no match."""
    from evalspark.plans import answer_queries

    texts = F.array(F.lit("12.0"), F.lit(" PEAR%"), F.lit(None).cast("string"), F.lit("0"), F.lit("-4"))
    cases = [("12 %", True), ("Pear", True), ("12.1", True), ("12.13", False), (None, False), ("", False), ("0.01", True), ("-4.05", False), ("-4.03", True), ("nan", False)]
    assert values(spark, [c[:1] for c in cases], X.answer_among(F.col("t"), X.figure_terms(texts)), "t string") == [c[1] for c in cases]
    none = F.lit(None).cast("array<string>")
    assert values(spark, [("12",)], X.answer_among(F.col("t"), X.figure_terms(none)), "t string") == values(spark, [("12",)], X.answer_in_figure(F.col("t"), none), "t string") == [False]
    plan = answer_queries.answers_in_figures(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "terms" in above and "texts" not in above


def test_surface(spark):
    texts = F.array(F.lit("12.0"), F.lit("Pear"))
    cases = [("12", True, "numeric"), ("pear ", True, "categorical"), ("12.1", True, "numeric"), ("13", False, "numeric"), ("", False, "other"), ("No", False, "boolean")]
    rows = [c[:1] for c in cases]
    assert values(spark, rows, X.answer_in_figure(F.col("t"), texts), "t string") == [c[1] for c in cases]
    assert values(spark, rows, X.answer_type(F.col("t")), "t string") == [c[2] for c in cases]
    assert values(spark, [("-7.25",), ("4.5.6",), ("80",), ("y",)], X.is_digits(F.col("t")), "t string") == [True, False, True, False]


def test_ids(spark):
    def mint(*parts):
        return hashlib.sha1("\x1f".join(parts).encode()).hexdigest()[:12]

    rows = [("m", "human", "f", "q", 0), ("m", None, "f", "q", 1)]
    made = ids.item_id(*[F.col(c) for c in "abcde"])
    assert values(spark, rows, made, "a string, b string, c string, d string, e int") == [mint("m", "human", "f", "q", "0"), mint("m", "f", "q", "1")]
    h = int(hashlib.sha1("42\x1ff7".encode()).hexdigest()[:8], 16)
    assert values(spark, [("f7",)], ids.fold_of(F.col("t")), "t string") == [h % 5]
    share = h / 0xFFFFFFFF
    assert values(spark, [("f7",)], ids.figure_split(F.col("t")), "t string") == ["test" if share < 0.2 else "val" if share < 0.4 else "train"]


def test_ratio_splits_are_exact(spark):
    figures = spark.range(97).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("figure_id"))
    got = {r["split"]: r["count"] for r in ids.ratio_splits(figures, {"train": 0.6, "val": 0.25, "test": 0.15}).groupBy("split").count().collect()}
    assert got == ids.ratio_counts(97, {"train": 0.6, "val": 0.25, "test": 0.15}) and sum(got.values()) == 97
