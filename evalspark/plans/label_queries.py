"""Queries over raters and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.operators import bootstrap, quality
from evalspark.operators import labels as L
from evalspark.plans import draw_sql
from evalspark.plans import standins as S
from evalspark.plans.registry import query
from evalspark.sources import tables

_KAPPA = "CASE WHEN products >= n * n THEN CASE WHEN same >= n THEN 1.0 ELSE 0.0 END ELSE round((same / n - products / (n * n)::double) / (1.0 - products / (n * n)::double), 4) END"


def _kappa_sql(cells: str, keys: str) -> str:
    """Kappa for each value of keys from cells (keys, la, lb, n)."""
    return f"""{cells}, tot AS (SELECT {keys}, sum(n)::bigint AS n, (sum(n) FILTER (la = lb))::bigint AS same FROM cells GROUP BY ALL),
  ma AS (SELECT {keys}, la AS l, sum(n)::bigint AS a FROM cells GROUP BY ALL), mb AS (SELECT {keys}, lb AS l, sum(n)::bigint AS b FROM cells GROUP BY ALL),
  ch AS (SELECT {keys}, sum(a * b)::bigint AS products FROM ma JOIN mb USING ({keys}, l) GROUP BY ALL),
  kap AS (SELECT {keys}, n, coalesce(same, 0) AS same, coalesce(products, 0) AS products FROM tot LEFT JOIN ch USING ({keys}))"""


_PAIRS = "cells AS (SELECT x.rater AS rater_a, y.rater AS rater_b, x.label AS la, y.label AS lb, count(*) AS n FROM ratings x JOIN ratings y ON x.item_id = y.item_id AND x.rater < y.rater GROUP BY 1, 2, 3, 4)"


@query(f"WITH {S.RATINGS}, {_kappa_sql(_PAIRS, 'rater_a, rater_b')} SELECT rater_a, rater_b, n, round(same / n, 3) AS agreement, {_KAPPA} AS kappa, n >= 30 AS enough_items FROM kap")
def kappa_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.pairwise_kappa(S.ratings(spark, sf_dir))


_QUALITY = "cells AS (SELECT 1 AS k, quality AS la, 1 - toxic AS lb, count(*) AS n FROM labels GROUP BY 1, 2, 3)"


@query(f"WITH {_kappa_sql(_QUALITY, 'k')} SELECT n, round(same / n, 6) AS agreement, {_KAPPA} AS kappa FROM kap")
def kappa_quality_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = S.read(spark, sf_dir, "labels").groupBy(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b")).agg(F.count("*").alias("n"))
    return L.kappa_of_cells(cells, [], "a", "b").withColumn("agreement", F.round("agreement", 6))


@query(f"""WITH {S.RATINGS}, c AS (SELECT item_id, label, count(*) AS c FROM ratings GROUP BY 1, 2), i AS (SELECT item_id, sum(c) AS n, sum(c * c) AS sq FROM c GROUP BY 1 HAVING sum(c) >= 2),
  p AS (SELECT count(*) AS n_items, avg((sq - n) / (n * (n - 1))) AS p_bar, sum(n) AS n_all FROM i), s AS (SELECT label, sum(c) AS c FROM c SEMI JOIN i USING (item_id) GROUP BY 1), e AS (SELECT sum(c * c) AS sq FROM s)
  SELECT n_items, round((p_bar - sq / (n_all * n_all)) / (1.0 - sq / (n_all * n_all)), 6) AS kappa FROM p, e""")
def fleiss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.fleiss_kappa(S.ratings(spark, sf_dir)).withColumn("kappa", F.round("kappa", 6))


@query(f"""WITH {S.RATINGS}, c AS (SELECT item_id, label, count(*) AS c FROM ratings GROUP BY 1, 2), t AS (SELECT item_id, sum(c)::bigint AS raters, max(c) AS m FROM c GROUP BY 1)
  SELECT item_id, CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE min(label) END AS label, raters, count(*) > 1 AS tie FROM c JOIN t USING (item_id) WHERE c = m AND raters >= 2 GROUP BY item_id, raters""")
def majority_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.majority(S.ratings(spark, sf_dir), 2)


_CONSENSUS = """v AS (SELECT item_id, count(*) AS votes, min(label) AS lo, max(label) AS hi FROM ratings WHERE rater <> 'adjudicated' {0} GROUP BY 1), s AS (SELECT item_id, label AS settled FROM ratings WHERE rater = 'adjudicated'),
  j AS (SELECT * FROM v FULL JOIN s USING (item_id))
  SELECT item_id, coalesce(settled, CASE WHEN lo = hi THEN lo END) AS label, CASE WHEN settled IS NOT NULL THEN 'adjudicated' WHEN lo = hi AND votes > 1 THEN 'agreed' WHEN lo = hi THEN 'single' ELSE 'unresolved' END AS how FROM j"""


@query(f"WITH {S.RATINGS}, {_CONSENSUS.format('')}")
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.consensus(S.ratings(spark, sf_dir))


@query(f"WITH {S.RATINGS}, {_CONSENSUS.format(chr(65) + chr(78) + chr(68) + ' rater <> ' + repr('r2'))}")
def human_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.consensus(S.ratings(spark, sf_dir), humans=F.col("rater") != "r2")


@query(f"""WITH {S.RATINGS}, v AS (SELECT item_id, count(*) AS votes, min(label) AS lo, max(label) AS hi FROM ratings WHERE rater IN ('r0', 'r1') GROUP BY 1), s AS (SELECT item_id, label AS settled FROM ratings WHERE rater = 'adjudicated'),
  j AS (SELECT item_id, coalesce(settled, CASE WHEN votes = 2 AND lo = hi THEN lo END) AS label FROM v FULL JOIN s USING (item_id)) SELECT * FROM j WHERE label IS NOT NULL""")
def two_rater_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.two_rater_consensus(S.ratings(spark, sf_dir), "r0", "r1")


@query(f"WITH {S.RATINGS} SELECT item_id, string_agg(rater || '=' || label, ' ' ORDER BY rater) AS votes FROM ratings WHERE rater <> 'adjudicated' GROUP BY 1 HAVING count(DISTINCT label) > 1")
def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = L.disagreements(S.ratings(spark, sf_dir).where("rater <> 'adjudicated'"))
    return got.select("item_id", F.array_join(F.transform("votes", lambda v: F.concat(v["rater"], F.lit("="), v["label"])), " ").alias("votes"))


@query(f"""WITH {S.RATINGS}, b AS (SELECT x.label AS label_a, y.label AS lb FROM ratings x JOIN ratings y USING (item_id) WHERE x.rater = 'r0' AND y.rater = 'r2'), l AS (SELECT unnest({list(L.LABELS)}) AS label_a)
  SELECT label_a, """ + ", ".join(f"count(*) FILTER (lb = '{x}') AS {x}" for x in L.LABELS) + " FROM l LEFT JOIN b USING (label_a) GROUP BY 1")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.confusion(S.ratings(spark, sf_dir), "r0", "r2")


@query(f"WITH {S.RATINGS} SELECT rater, " + ", ".join(f"count(*) FILTER (label = '{x}') AS {x}" for x in L.LABELS) + " FROM ratings GROUP BY 1")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.label_counts(S.ratings(spark, sf_dir))


@query(f"""WITH {S.RATINGS}, b AS (SELECT x.label AS given, y.label AS truth FROM ratings x JOIN ratings y USING (item_id) WHERE x.rater = 'r1' AND y.rater = 'adjudicated'),
  e AS (SELECT truth AS label, 1 AS t, 0 AS g, 0 AS r FROM b UNION ALL SELECT given, 0, 1, (given = truth)::int FROM b), a AS (SELECT label, sum(t)::bigint AS n_truth, sum(g)::bigint AS n_given, sum(r)::bigint AS n_right FROM e GROUP BY 1)
  SELECT *, round(n_right / nullif(n_given, 0), 6) AS "precision", round(n_right / nullif(n_truth, 0), 6) AS recall FROM a""")
def against_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.ratings(spark, sf_dir)
    got = L.against_truth(rows.where("rater = 'r1'"), rows.where("rater = 'adjudicated'"))
    return got.withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


_TRUTH = "both_ AS (SELECT item_id, x.label AS la, y.label AS lb FROM ratings x JOIN ratings y USING (item_id) WHERE x.rater = 'r1' AND y.rater = 'adjudicated')"
_TRUTH_CELLS = _TRUTH + ", cells AS (SELECT 1 AS k, la, lb, count(*) AS n FROM both_ GROUP BY 1, 2, 3)"


@query(f"WITH {S.RATINGS}, {_kappa_sql(_TRUTH_CELLS, 'k')} SELECT n, round(same / n, 6) AS agreement, {_KAPPA} AS kappa FROM kap")
def truth_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.ratings(spark, sf_dir)
    return L.truth_agreement(rows.where("rater = 'r1'"), rows.where("rater = 'adjudicated'")).withColumn("agreement", F.round("agreement", 6))


@query(f"WITH {S.RATINGS}, {_TRUTH} SELECT item_id, la AS label, lb AS truth FROM both_ WHERE la <> lb")
def truth_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.ratings(spark, sf_dir)
    return L.truth_disagreements(rows.where("rater = 'r1'"), rows.where("rater = 'adjudicated'"))


@query(f"""WITH {S.RATINGS}, v AS (SELECT * FROM ratings WHERE rater <> 'adjudicated'), c AS (SELECT item_id, label, count(*) AS c FROM v GROUP BY 1, 2), t AS (SELECT item_id, max(c) AS m, sum(c) AS raters FROM c GROUP BY 1),
  k AS (SELECT item_id, count(*) AS k FROM c JOIN t USING (item_id) WHERE c = m AND raters >= 2 GROUP BY 1)
  SELECT (SELECT count(DISTINCT rater) FROM v) AS raters, count(*) AS items, count(*) FILTER (k > 1) AS ties, (SELECT count(*) FROM documents WHERE doc_id % 3 = 0) AS bad_lines FROM k""")
def majority_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of a majority vote, from a log whose lines without a label are counted as bad."""
    rows = S.ratings(spark, sf_dir).where("rater <> 'adjudicated'")
    missing = S.read(spark, sf_dir, "documents").where("doc_id % 3 = 0").agg(F.count("*").alias("skipped"))
    return L.majority_stats(rows, missing, 2)


#: Draws of an interval.
DRAWS = 2000
_SUBSETS = "both_ AS (SELECT x.label AS la, y.label AS lb, unnest(['m' || (x.item_id % 2), 'overall']) AS subset FROM ratings x JOIN ratings y USING (item_id) WHERE x.rater = 'r0' AND y.rater = 'r1'), cells AS (SELECT subset, la, lb, count(*) AS n FROM both_ GROUP BY 1, 2, 3)"


def _kappa_interval_sql(cells: str, subset: str) -> str:
    """Draws of cells (key, la, lb, m), and spans (subset, lo, hi): of the kappas of each subset, in order, those at 2.5 and 97.5 percent."""
    each = f"each_ AS (SELECT {subset}, b AS rep, la, lb, n FROM cnt JOIN place USING (r))"
    drawn = _kappa_sql(f"{each}, cells AS (SELECT subset, rep, la, lb, sum(n)::bigint AS n FROM each_ GROUP BY ALL)", "subset, rep")
    return f"""{cells}, place AS (SELECT row_number() OVER (ORDER BY key, la, lb) - 1 AS r, * FROM all_), lf AS (SELECT r, m FROM place), {draw_sql.counts(DRAWS)}, {drawn},
  ks AS (SELECT subset, list_sort(list({_KAPPA})) AS v FROM kap GROUP BY 1), spans AS (SELECT subset, v[greatest(1, floor(len(v) * 0.025)::int + 1)] AS lo, v[greatest(1, floor(len(v) * 0.975)::int)] AS hi FROM ks)"""


_PAIR_CELLS = "all_ AS (SELECT {0} AS key, x.label AS la, y.label AS lb, count(*) AS m FROM ratings x JOIN ratings y USING (item_id) WHERE x.rater = 'r0' AND y.rater = 'r1' GROUP BY 1, 2, 3)"


@query(f"""WITH RECURSIVE {S.RATINGS}, {_kappa_interval_sql(_PAIR_CELLS.format("'m' || (x.item_id % 2)"), "unnest([key, 'overall']) AS subset")},
  whole AS (WITH {_kappa_sql(_SUBSETS, 'subset')} SELECT subset, n, same / n AS agreement, {_KAPPA} AS kappa, {_KAPPA} >= 0.6 AS passes FROM kap)
  SELECT subset, n, round(agreement, 6) AS agreement, kappa, passes, lo, hi FROM whole LEFT JOIN spans USING (subset)""")
def agreement_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agreement_by_subset with the interval of each kappa over 2,000 draws of items."""
    rows = S.ratings(spark, sf_dir)
    one = rows.where("rater = 'r0'")
    key = one.select("item_id", F.concat(F.lit("m"), (F.col("item_id") % 2).cast("string")).alias("model"))
    return L.agreement_intervals(one, rows.where("rater = 'r1'"), key, DRAWS).withColumn("agreement", F.round("agreement", 6))


@query(f"WITH {S.RATINGS}, {_kappa_sql(_SUBSETS, 'subset')} SELECT subset, n, round(same / n, 6) AS agreement, {_KAPPA} AS kappa, {_KAPPA} >= 0.6 AS passes FROM kap")
def agreement_by_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.ratings(spark, sf_dir)
    one = rows.where("rater = 'r0'")
    key = one.select("item_id", F.concat(F.lit("m"), (F.col("item_id") % 2).cast("string")).alias("model"))
    return L.agreement_by_subset(one, rows.where("rater = 'r1'"), key).withColumn("agreement", F.round("agreement", 6))


@query(f"WITH {S.LABELLED} SELECT item_id, label, reason FROM labels_llm")
def last_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.last_labels(S.labels(spark, sf_dir), ["item_id"]).select("item_id", "label", "reason")


_ALLOCATE = """k AS (SELECT label, count(*) AS k FROM {0} GROUP BY 1), b AS (SELECT *, least(k, 5) AS f, k - least(k, 5) AS rest_k FROM k), t AS (SELECT *, sum(rest_k) OVER ()::bigint AS total, (60 - sum(f) OVER ())::bigint AS rest FROM b),
  w AS (SELECT *, rest * rest_k // total AS whole, rest * rest_k % total AS frac FROM t), r AS (SELECT *, row_number() OVER (ORDER BY frac DESC, label) AS place, rest - sum(whole) OVER () AS short FROM w),
  alloc AS (SELECT label, k, (f + whole + CASE WHEN place <= short THEN 1 ELSE 0 END)::bigint AS take FROM r)"""


@query(f"WITH {S.LABELLED}, {_ALLOCATE.format('labels_llm')} SELECT label, k, take FROM alloc")
def stratum_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = L.last_labels(S.labels(spark, sf_dir), ["item_id"]).groupBy("label").agg(F.count("*").alias("k"))
    return L.allocate(counts, 60, 5)


@query(f"""WITH {S.LABELLED}, {_ALLOCATE.format('labels_llm')}, n AS (SELECT item_id, label, row_number() OVER (PARTITION BY label ORDER BY sha1('42' || chr(31) || item_id), item_id) AS place FROM labels_llm)
  SELECT 'm1' AS model, label, item_id FROM n JOIN alloc USING (label) WHERE place <= take""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.last_labels(S.labels(spark, sf_dir), ["item_id"]).select(F.lit(S.MODEL).alias("model"), "label", "item_id")
    return L.stratified_sample(rows, 60, 5)


@query(f"WITH {S.ANSWERS} SELECT item_id, figure_id AS image_path, question, gold AS gold_answer, prediction AS model_answer, sha1('42' || chr(31) || item_id) AS shuffle_key FROM answers WHERE NOT correct")
def blind_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.blind_pool(S.answers(spark, sf_dir))[0]


@query(f"""WITH {S.ANSWERS}, o AS (SELECT item_id, row_number() OVER (ORDER BY sha1('42' || chr(31) || item_id), item_id) - 1 AS n FROM answers WHERE NOT correct)
  SELECT item_id, n // 50 + 1 AS batch FROM o""")
def label_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.batches(L.blind_pool(S.answers(spark, sf_dir))[0], 50).select("item_id", "batch")


@query(f"""WITH {S.ANSWERS}, o AS (SELECT item_id, row_number() OVER (ORDER BY sha1('42' || chr(31) || item_id), item_id) - 1 AS n FROM answers WHERE NOT correct)
  SELECT unnest([['ann', 'bob'], ['ann', 'cy'], ['bob', 'cy']][n % 3 + 1]) AS annotator, item_id FROM o WHERE n < 60""")
def overlap_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = L.assign(L.blind_pool(S.answers(spark, sf_dir))[0], ["ann", "bob", "cy"], 60)
    shared = got.groupBy("item_id").agg(F.count("*").alias("k")).where("k = 2").select("item_id")
    return got.join(shared, "item_id").select("annotator", "item_id")


@query(f"""WITH {S.ANSWERS}, n AS (SELECT count(*) - 60 AS solo FROM answers WHERE NOT correct) SELECT unnest(['ann', 'bob', 'cy']) AS annotator, unnest([solo // 3 + (solo % 3 > 0)::int, solo // 3 + (solo % 3 > 1)::int, solo // 3]) + 40 AS n FROM n""")
def assignment_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.assign(L.blind_pool(S.answers(spark, sf_dir))[0], ["ann", "bob", "cy"], 60).groupBy("annotator").agg(F.count("*").alias("n"))


@query(f"""WITH {S.LABELLED}, b AS (SELECT item_id, CASE WHEN seq % 41 = 0 THEN 'odd' ELSE label END AS label, CASE WHEN seq % 43 = 0 THEN NULL ELSE reason END AS reason FROM labels_llm)
  SELECT item_id, 'unknown label' AS problem FROM b WHERE label = 'odd' UNION ALL SELECT item_id, 'needs a reason' FROM b WHERE label IN ('not_an_error', 'ambiguous') AND reason IS NULL
  UNION ALL SELECT item_id, 'missing' FROM joined WHERE NOT correct AND label IS NULL""")
def label_batch_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.last_labels(S.labels(spark, sf_dir), ["item_id"])
    rows = rows.withColumn("label", F.when(F.col("seq") % 41 == 0, "odd").otherwise(F.col("label"))).withColumn("reason", F.when(F.col("seq") % 43 != 0, F.col("reason")))
    odd = quality.check_labels(rows, S.answers(spark, sf_dir).where(~F.col("correct")).select("item_id"))
    return odd


@query(f"WITH {S.LABELLED} SELECT item_id FROM joined WHERE label IS NULL")
def correction_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check_corrections(S.answers(spark, sf_dir), S.labels(spark, sf_dir))


@query(f"""WITH {S.ITEMS} SELECT figure_id || '::' || question AS item_id, figure_id AS image_path, question, gold AS gold_answer, prediction AS model_answer FROM items""")
def annotation_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.annotation_items(S.items(spark, sf_dir))


@query(f"WITH RECURSIVE {S.RATINGS}, {_kappa_interval_sql(_PAIR_CELLS.format('0'), '0 AS subset')} SELECT lo, hi FROM spans")
def kappa_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lo, hi of Cohen's kappa of two raters over 2,000 item bootstraps, drawn as counts of the confusion cells."""
    rows = S.ratings(spark, sf_dir)
    a = rows.where("rater = 'r0'").select("item_id", F.col("label").alias("a"))
    both = a.join(rows.where("rater = 'r1'").select("item_id", F.col("label").alias("b_label")), "item_id")
    cells = bootstrap.cell_replicates(both.groupBy("a", "b_label").agg(F.count("*").alias("n")), ["a", "b_label"], "n", DRAWS)
    return bootstrap.order_statistics(L.kappa_of_cells(cells, ["b"], "a", "b_label"), "kappa")
