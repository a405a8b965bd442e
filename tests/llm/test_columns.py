"""Extra columns whose names the stages use themselves; letters that lower-casing or normalising takes apart."""

import sys

import pytest
from pyspark.sql import functions as F

from evalspark.llm import decontaminate, language, mixing, ngram_join, quality, simhash, tokens, toxicity
from evalspark.llm.common import fresh
from tests.llm import plain

NAMES = ["_row", "_d", "_s", "_rows", "_sum", "_mark", "_at", "_times", "_copy", "_i", "_own", "_toxicity", "_lost", "a.b", "c0", "c1", "sig", "rep", "n", "score_", "item_id"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.read.parquet(f"{plain.SF}/documents.parquet").orderBy("doc_id").limit(60)
    return rows.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in NAMES])


def models(spark):
    docs = spark.read.parquet(f"{plain.SF}/documents.parquet")
    labels = spark.read.parquet(f"{plain.SF}/labels.parquet")
    return {
        "toxicity": lambda df: toxicity.score_toxicity(df, toxicity.fit_rows(toxicity.training_rows(docs, labels)), out=fresh(df, "_toxicity")).drop("_toxicity_"),
        "quality": lambda df: quality.score_quality(df, quality.fit_rows(quality.training_rows(docs, labels))).drop("score"),
        "language": lambda df: language.identify(df.withColumn("_text", F.col("text")), language.fit_rows(language.training_rows(docs)), text="_text").drop("lang_pred", "score"),
        "mix": mixing.mixed_documents,
        "ngram_join": ngram_join.one_of_each,
        "simhash": simhash.one_of_each,
        "decontaminate": lambda df: decontaminate.decontaminated(df, spark.read.parquet(f"{plain.SF}/benchmark.parquet")),
    }


@pytest.mark.parametrize("stage", ["toxicity", "quality", "language", "mix", "ngram_join", "simhash", "decontaminate"])
def test_stages_keep_columns_of_any_name(spark, odd, stage):
    got = models(spark)[stage](odd)
    assert got.columns == odd.columns
    given = {tuple(r) for r in odd.collect()}
    rows = [tuple(r) for r in got.collect()]
    assert rows and set(rows) <= given
    if stage in ("toxicity", "quality", "language"):
        assert set(rows) == given


def test_ids_of_letters_that_leave_a_mark():
    """Each letter of all planes before marks, in words and alone, against encoding the whole text."""
    known = tokens.Encoder(tokens.default_tokenizer())
    letters = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    rare = [c for c in letters if not tokens.Encoder._letters(known, c)]
    assert "İ" in rare and "क़" in rare
    texts = [f"{c}. a{c}? {c}b!, {c}" for c in letters[::3]] + [f"M{c}? {c}. x{c}{c};: y" for c in rare] + ["Mİ?", "İ. Hakkı", "Değil Mİ?", "İ", "ﬁ. ﬁ"]
    ids, n = known(texts)
    at = 0
    for text, k, whole in zip(texts, n.tolist(), known.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[at : at + k].tolist() == [*whole.ids, tokens.END_ID], text
        at += k
