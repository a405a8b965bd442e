"""Queries over scores: ranking, calibration, bootstrap, policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.text import is_correct
from evalspark.operators import bootstrap, metrics, outcomes, policy
from evalspark.plans import draw_sql
from evalspark.plans import standins as S
from evalspark.plans.registry import query
from evalspark.streaming.labels import running_accuracy


def _auroc_sql(source: str, keys: str = "") -> str:
    k, by = (f"{keys}, ", f"PARTITION BY {keys} ") if keys else ("", "")
    return f"""g AS (SELECT {k}score, sum(y)::bigint AS pos, sum(1 - y)::bigint AS neg FROM {source} GROUP BY ALL),
  c AS (SELECT *, coalesce(sum(neg) OVER ({by}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS nb FROM g)
  SELECT {k}sum(pos)::bigint AS n_pos, sum(neg)::bigint AS n_neg, round(sum(pos * (2 * nb + neg)) / nullif(2.0 * sum(pos) * sum(neg), 0), 6) AS auroc FROM c GROUP BY ALL"""


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


@query(f"WITH {S.SCORES}, {_auroc_sql('scores')}")
def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.auroc(S.scores(spark, sf_dir), "score", F.col("y") == 1), "auroc")


#: Draws of a report's intervals.
DRAWS = 2000
_EVENTS = "ev AS (SELECT event_type, floor(value)::bigint AS score, (user_id % 2)::bigint AS y FROM events)"


@query(f"WITH {_EVENTS}, {_auroc_sql('ev', 'event_type')}")
def auroc_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.read(spark, sf_dir, "events").select("event_type", F.floor("value").alias("score"), (F.col("user_id") % 2).alias("y"))
    return _rounded(metrics.auroc(rows, "score", F.col("y") == 1, ["event_type"]), "auroc")


_LOOKALIKE = "ev AS (SELECT floor(value)::bigint AS score, (user_id % 2)::bigint AS y FROM events WHERE event_type IN ('view', 'click'))"


@query(f"WITH {_LOOKALIKE}, {_auroc_sql('ev')}")
def auroc_of_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.read(spark, sf_dir, "events").where("event_type in ('view', 'click')").select(F.floor("value").alias("score"), (F.col("user_id") % 2).alias("y"))
    return _rounded(metrics.auroc(rows, "score", F.col("y") == 1), "auroc")


@query("SELECT event_id, rank() OVER (ORDER BY floor(value)) + (count(*) OVER (PARTITION BY floor(value)) - 1) / 2.0 AS rank FROM events")
def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.read(spark, sf_dir, "events").select("event_id", F.floor("value").alias("score"))
    return metrics.average_ranks(rows, "score").select("event_id", "rank")


@query(f"""WITH {S.SCORES}, b AS (SELECT least(floor(p * 10), 9) AS bin, p, y FROM (SELECT least(greatest("binary", 0), 1) AS p, y FROM scores)),
  e AS (SELECT bin, count(*) AS n, sum(p) AS sp, sum(y) AS sy, sum((p - y) * (p - y)) AS sq FROM b GROUP BY 1)
  SELECT round(sum(abs(sp - sy)) / sum(n), 6) AS ece, round(sum(sq) / sum(n), 6) AS brier, round(sum(sp) / sum(n), 6) AS mean_p, round(sum(sy) / sum(n), 6) AS base_rate FROM e""")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.scores(spark, sf_dir).withColumn("p", F.least(F.greatest("binary", F.lit(0.0)), F.lit(1.0)))
    return _rounded(metrics.calibration(rows, "p", "y"), "ece", "brier", "mean_p", "base_rate")


_CURVE = """g AS (SELECT score, count(*) AS g, count(*) FILTER (y = 0) AS e FROM scores GROUP BY 1),
  c AS (SELECT *, coalesce(sum(g) OVER w, 0)::bigint AS gb, coalesce(sum(e) OVER w, 0)::bigint AS eb FROM g WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  s AS (SELECT *, unnest(range(1, g + 1)) AS i FROM c), curve AS (SELECT gb + i AS k, (SELECT count(*) FROM scores) AS n, (eb + i * e / g) / (gb + i) AS risk FROM s)"""


@query(f"WITH {S.SCORES}, {_CURVE} SELECT k, n, round(risk, 6) AS risk FROM curve")
def risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.scores(spark, sf_dir).withColumn("ok", F.col("y") == 1)
    return _rounded(metrics.risk_coverage(rows, "ok", "score"), "risk")


@query(f"WITH {S.SCORES}, {_CURVE} SELECT max(n) AS n, round(avg(risk), 6) AS aurc, " + ", ".join(f"round(max(risk) FILTER (k = greatest(1, round_even({c} * n, 0))), 6) AS risk_{round(100 * c)}" for c in (1.0, 0.9, 0.8, 0.7, 0.6, 0.5)) + " FROM curve")
def aurc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.scores(spark, sf_dir).withColumn("ok", F.col("y") == 1)
    got = metrics.aurc(metrics.stretches(rows, "ok", "score"))
    return _rounded(got, *[c for c in got.columns if c != "n"])


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS min, max(value) AS max FROM events GROUP BY 1")
def value_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.summary(S.read(spark, sf_dir, "events"), "value", ["event_type"]), "mean", "sd")


@query(f"WITH {S.SCORES} SELECT cls, fold::bigint AS fold, count(*) AS n FROM scores GROUP BY CUBE (cls, fold)")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scores(spark, sf_dir).withColumn("fold", F.col("fold").cast("long")).cube("cls", "fold").agg(F.count("*").alias("n"))


def _rate(kind: str, action: str) -> str:
    inside = f"FILTER (failure_type = '{kind}' AND intervention = '{action}')"
    return f"(sum(recovered::int * w) {inside} / sum(w) {inside})"


@query(f"""WITH RECURSIVE {S.OUTCOMES}, {draw_sql.weights('outcomes', 'figure_id', DRAWS)}, v AS (SELECT b, ({_rate('structural', 'I_crop')} - {_rate('structural', 'I_0')}) - ({_rate('fabrication', 'I_crop')} - {_rate('fabrication', 'I_0')}) AS v FROM outcomes JOIN wts USING (figure_id) GROUP BY b)
  SELECT round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi, NOT (quantile_cont(v, 0.025) <= 0 AND quantile_cont(v, 0.975) >= 0) AS excludes_zero FROM v""")
def did_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contrast's interval over 2,000 cluster draws, from cells per figure, action and type."""
    rows = S.outcomes(spark, sf_dir)
    values = bootstrap.cell_rates(rows, "figure_id", DRAWS).groupBy("b").agg(outcomes.did("I_crop").alias("value"))
    got = bootstrap.interval(values, "value")
    return got.select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), (~((F.col("lo") <= 0) & (F.col("hi") >= 0))).alias("excludes_zero"))


@query(f"""WITH RECURSIVE {S.OUTCOMES}, {draw_sql.weights('outcomes', 'figure_id', DRAWS)}, r AS (SELECT b, failure_type, intervention, sum(recovered::int * w) / sum(w) AS v FROM outcomes JOIN wts USING (figure_id) WHERE failure_type <> 'computation' GROUP BY 1, 2, 3),
  k AS (SELECT *, row_number() OVER (PARTITION BY b, failure_type ORDER BY v DESC, intervention DESC) AS n FROM r), x AS (SELECT b, count(DISTINCT intervention) AS d FROM k WHERE n = 1 GROUP BY 1)
  SELECT count(*) FILTER (d = 2) / 2000.0::double AS stability FROM x""")
def flip_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap.flip_stability(S.outcomes(spark, sf_dir), "figure_id", DRAWS)


@query(f"""WITH RECURSIVE {S.SCORES}, {draw_sql.weights('scores', 'figure_id', DRAWS)}, g AS (SELECT b, score, sum(w * y)::bigint AS pos, sum(w * (1 - y))::bigint AS neg FROM scores JOIN wts USING (figure_id) GROUP BY 1, 2),
  c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY b ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS nb FROM g), v AS (SELECT b, sum(pos * (2 * nb + neg)) / nullif(2.0 * sum(pos) * sum(neg), 0) AS v FROM c GROUP BY 1)
  SELECT round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi FROM v""")
def auroc_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the AUROC over 2,000 draws of figures."""
    return _rounded(bootstrap.interval(bootstrap.weighted_auroc(S.scores(spark, sf_dir), "figure_id", "score", F.col("y") == 1, DRAWS), "value"), "lo", "hi")


_BEST = """u AS (SELECT cls, unnest(['I_0', 'I_reask', 'I_upsample', 'I_crop', 'I_verify']) AS action, unnest([0, 1, 2, 3, 4]) AS ord, unnest([I_0, I_reask, I_upsample, I_crop, I_verify])::int AS ok FROM controller),
  a AS (SELECT cls, action, ord, avg(ok) AS accuracy FROM u GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY accuracy DESC, ord) AS k FROM a)"""


@query(f"WITH {S.CONTROLLER}, {_BEST} SELECT cls, action, round(accuracy, 6) AS accuracy FROM r WHERE k = 1")
def oracle_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(policy.oracle_plan(S.controller_items(spark, sf_dir)), "accuracy")


_RULES = """o AS (SELECT f.fold AS k, c.* FROM (SELECT DISTINCT fold FROM controller) f JOIN controller c ON f.fold <> c.fold),
  q AS (SELECT k, list_distinct(quantile_cont(misread, [0.5 + 0.5 * i / 50 for i in range(51)])) AS cuts FROM o GROUP BY 1), t AS (SELECT k, unnest(cuts) AS threshold FROM q),
  l AS (SELECT k, misread, I_0::int AS base, unnest(['I_reask', 'I_upsample', 'I_crop', 'I_verify']) AS repair, unnest([0, 1, 2, 3]) AS ord, unnest([I_reask, I_upsample, I_crop, I_verify])::int AS ok FROM o),
  g AS (SELECT k, repair, ord, threshold, sum(ok - base) AS gain FROM l JOIN t USING (k) WHERE misread > threshold GROUP BY 1, 2, 3, 4),
  b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY gain DESC, ord, threshold) AS n FROM g WHERE gain > 0)"""


@query(f"WITH {S.CONTROLLER}, {_RULES} SELECT f.fold::bigint AS fold, repair, round(threshold, 6) AS threshold FROM (SELECT DISTINCT fold FROM controller) f LEFT JOIN b ON b.k = f.fold AND b.n = 1")
def relook_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = policy.relook_rules(S.controller_items(spark, sf_dir))
    return _rounded(got.withColumn("fold", F.col("fold").cast("long")), "threshold")


_FINAL = f"""{_RULES}, rl AS (SELECT c.*, b.repair, coalesce(c.misread > b.threshold, false) AS again FROM controller c LEFT JOIN b ON b.k = c.fold AND b.n = 1),
  fin AS (SELECT *, CASE WHEN again THEN CASE repair WHEN 'I_reask' THEN I_reask WHEN 'I_upsample' THEN I_upsample WHEN 'I_crop' THEN I_crop ELSE I_verify END ELSE I_0 END AS final FROM rl)"""


@query(f"""WITH {S.CONTROLLER}, {_FINAL}
  SELECT 'plain' AS policy, count(*) AS n, round(avg(I_0::int), 6) AS accuracy FROM fin UNION ALL SELECT 'binary', count(*), round(avg(I_0::int), 6) FROM fin UNION ALL SELECT 'missing', count(*), round(avg(I_0::int), 6) FROM fin
  UNION ALL SELECT 'controller', count(*), round(avg(final::int), 6) FROM fin UNION ALL SELECT 'relook_binary', count(*), round(avg(final::int), 6) FROM fin""")
def policy_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = policy.evaluate(S.controller_items(spark, sf_dir)).where("policy <> 'oracle'")
    return _rounded(got.select("policy", "n", "accuracy"), "accuracy")


_AREAS = f"""{S.CONTROLLER}, {_FINAL}, {_BEST}, {draw_sql.weights('scores', 'figure_id', DRAWS)}, every AS (SELECT * FROM wts UNION ALL SELECT -1, figure_id, 1 FROM grp),
  ideal AS (SELECT fin.*, r.accuracy, CASE action WHEN 'I_0' THEN I_0 WHEN 'I_reask' THEN I_reask WHEN 'I_upsample' THEN I_upsample WHEN 'I_crop' THEN I_crop ELSE I_verify END AS best FROM fin JOIN r ON r.cls = fin.cls AND r.k = 1),
  pol AS (SELECT figure_id, unnest(['plain', 'binary', 'missing', 'controller', 'relook_binary', 'oracle']) AS policy, unnest([I_0, I_0, I_0, final, final, best])::int AS ok, unnest([0.0::double, -"binary", -missing, -missing, -"binary", accuracy]) AS conf FROM ideal),
  tie AS (SELECT policy, b, conf, sum(w)::bigint AS g, sum(w * (1 - ok))::bigint AS e FROM pol JOIN every USING (figure_id) GROUP BY 1, 2, 3),
  run AS MATERIALIZED (SELECT *, (sum(g) OVER o - g)::bigint AS bg, (sum(e) OVER o - e)::bigint AS be FROM tie WINDOW o AS (PARTITION BY policy, b ORDER BY conf DESC)),
  val AS MATERIALIZED (SELECT policy, b, sum(list_sum([(be + i * e / g) / (bg + i) FOR i IN range(1, g + 1)])) / sum(g) AS v FROM run GROUP BY 1, 2)"""
_COVERAGES = (100, 90, 80, 70, 60, 50)


@query(f"""WITH RECURSIVE {_AREAS}, n AS (SELECT policy, sum(g)::bigint AS n FROM run WHERE b = -1 GROUP BY 1), pt AS (SELECT policy, n, unnest({list(_COVERAGES)}) AS c, greatest(1, round_even(unnest({[c / 100 for c in _COVERAGES]}) * n, 0)) AS k FROM n),
  risk AS (SELECT policy, c, (be + (k - bg) * e / g) / k AS risk FROM pt JOIN run USING (policy) WHERE b = -1 AND k > bg AND k <= bg + g), acc AS (SELECT policy, avg(ok) AS accuracy FROM pol GROUP BY 1),
  span AS (SELECT policy, round(quantile_cont(v, 0.025), 3) AS lo, round(quantile_cont(v, 0.975), 3) AS hi FROM val WHERE b >= 0 GROUP BY 1)
  SELECT policy, n, round(v, 3) AS aurc, """ + ", ".join(f"(SELECT round(risk, 3) FROM risk WHERE risk.policy = n.policy AND c = {c}) AS risk_{c}" for c in _COVERAGES) + """, round(accuracy, 3) AS accuracy, lo, hi
  FROM n JOIN acc USING (policy) JOIN span USING (policy) JOIN val USING (policy) WHERE b = -1""")
def policy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """policy, aurc, its interval over 2,000 draws of figures, and the risks at the coverages, rounded for a report."""
    rows = policy.policies(S.controller_items(spark, sf_dir))
    values = bootstrap.weighted_aurc(rows, "figure_id", "ok", "conf", DRAWS, ["policy"])
    got = policy.evaluate(S.controller_items(spark, sf_dir)).join(bootstrap.interval(values, "value", ["policy"]), "policy")
    return got.select("policy", "n", *[F.round(c, 3).alias(c) for c in got.columns if c not in ("policy", "n")])


@query(f"""WITH RECURSIVE {_AREAS}, pairs AS (SELECT unnest(['controller', 'controller', 'relook_binary']) AS one, unnest(['missing', 'binary', 'binary']) AS other),
  d AS (SELECT one, other, x.b, x.v - y.v AS d FROM pairs JOIN val x ON x.policy = one JOIN val y ON y.policy = other AND y.b = x.b)
  SELECT one, other, round(max(d) FILTER (b = -1), 6) AS difference, round(quantile_cont(d, 0.025) FILTER (b >= 0), 6) AS lo, round(quantile_cont(d, 0.975) FILTER (b >= 0), 6) AS hi FROM d GROUP BY 1, 2""")
def ablation_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one, other, difference of AURC and its interval (lo, hi) over the same 2,000 draws for both policies."""
    rows = policy.policies(S.controller_items(spark, sf_dir))
    values = bootstrap.weighted_aurc(rows, "figure_id", "ok", "conf", DRAWS, ["policy"])
    pairs = F.array(*[F.struct(F.lit(a).alias("one"), F.lit(b).alias("other")) for a, b in (("controller", "missing"), ("controller", "binary"), ("relook_binary", "binary"))])
    whole = policy.evaluate(S.controller_items(spark, sf_dir)).select(F.lit(-1).cast("long").alias("b"), "policy", F.col("aurc").alias("value"))

    def differences(of: DataFrame) -> DataFrame:
        left = of.withColumn("_p", F.explode(pairs)).where("policy = _p.one").select("b", "_p.one", "_p.other", F.col("value").alias("v"))
        return left.join(of.select("b", F.col("policy").alias("other"), F.col("value").alias("w")), ["b", "other"]).withColumn("d", F.col("v") - F.col("w"))

    point = differences(whole).select("one", "other", F.col("d").alias("difference"))
    return _rounded(point.join(bootstrap.interval(differences(values), "d", ["one", "other"]), ["one", "other"]), "difference", "lo", "hi")


@query(f"""WITH {S.OUTCOMES} SELECT failure_type, """ + ", ".join(f"round(avg(recovered::int) FILTER (intervention = '{a}'), 3) AS {a}, count(*) FILTER (intervention = '{a}') AS {a}_n" for a in S.ACTIONS) + " FROM outcomes GROUP BY 1")
def recovery_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = outcomes.recovery(S.outcomes(spark, sf_dir))
    pick = lambda a, c: F.max(F.when(F.col("intervention") == a, F.col(c)))
    return cells.groupBy("failure_type").agg(*[e for a in S.ACTIONS for e in (F.round(pick(a, "rate"), 3).alias(a), pick(a, "n").alias(f"{a}_n"))])


@query(f"WITH {S.ANSWERS} SELECT strftime(time_bucket(INTERVAL 1 day, ts), '%Y-%m-%d') AS day, source, count(*) AS n, sum(correct::int)::bigint AS n_correct FROM answers GROUP BY 1, 2")
def accuracy_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.items(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return running_accuracy(rows).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "source", "n", "n_correct")
