"""Queries over answers, synthetic items and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.functions import ids
from evalspark.functions import text as X
from evalspark.operators import answers as A
from evalspark.operators import features, outcomes, quality
from evalspark.operators.labels import LABELS
from evalspark.plans import standins as S
from evalspark.plans.registry import query
from evalspark.sources import tables


@query(f"""WITH {S.LABELLED} SELECT source, count(*) AS items, count(*) FILTER (NOT correct) AS errors, round(count(*) FILTER (NOT correct) / count(*), 4) AS error_rate,
  count(*) FILTER (NOT correct AND label IN ('structural', 'fabrication', 'computation')) AS real_errors, count(*) FILTER (NOT correct AND reason = 'gold_error') AS gold_wrong,
  count(*) FILTER (NOT correct AND label IS NOT NULL AND rescaled) AS rescaled, count(*) FILTER (NOT correct AND label IS NULL) AS unlabelled FROM joined GROUP BY source""")
def error_report_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.error_report(S.answers(spark, sf_dir), S.labels(spark, sf_dir))


@query(f"WITH {S.LABELLED} SELECT source, " + ", ".join(f"count(*) FILTER (label = '{x}') AS {x}" for x in LABELS) + " FROM joined WHERE NOT correct GROUP BY source")
def label_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.label_histogram(S.answers(spark, sf_dir), S.labels(spark, sf_dir), LABELS)


@query(f"WITH {S.LABELLED} SELECT label, reason, count(*) AS n FROM joined WHERE NOT correct AND label IS NOT NULL GROUP BY 1, 2")
def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.reason_counts(S.answers(spark, sf_dir), S.labels(spark, sf_dir))


@query(f"""WITH {S.LABELLED} SELECT round(1.0 - count(*) FILTER (NOT correct) / count(*), 4) AS relaxed,
  round(1.0 - (count(*) FILTER (NOT correct) - count(*) FILTER (NOT correct AND rescaled)) / count(*), 4) AS rescaled_right,
  round(1.0 - (count(*) FILTER (NOT correct) - count(*) FILTER (NOT correct AND label = 'not_an_error')) / count(*), 4) AS not_an_error_right FROM joined""")
def three_accuracies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.accuracies(S.answers(spark, sf_dir), S.labels(spark, sf_dir))


@query(f"WITH {S.ANSWERS} SELECT round(avg(correct::int), 6) AS accuracy, count(*) AS n FROM answers")
def relaxed_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.relaxed_accuracy(S.answers(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


@query(f"WITH {S.ANSWERS} SELECT item_id, round(g, 6) AS gold_number, round(p, 6) AS predicted_number, correct FROM answers")
def parse_and_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda c: F.round(X.parse_number(F.col(c)), 6)
    return S.answers(spark, sf_dir).select("item_id", number("gold").alias("gold_number"), number("prediction").alias("predicted_number"), "correct")


@query(f"WITH {S.LABELLED} SELECT item_id, gold, prediction, source FROM joined WHERE NOT correct AND rescaled")
def rescaled_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.answers(spark, sf_dir).where(~F.col("correct") & X.rescaled_match(F.col("gold"), F.col("prediction"))).select("item_id", "gold", "prediction", "source")


@query(f"""WITH {S.ITEMS} SELECT source, split, questions, figures, round(questions / figures, 6) AS questions_per_figure FROM (
  SELECT source, CASE WHEN grouping(source) = 1 THEN NULL ELSE 'test' END AS split, count(*) AS questions, count(DISTINCT figure_id) AS figures FROM items GROUP BY ROLLUP (source))""")
def split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.split_stats(S.items(spark, sf_dir)).withColumn("questions_per_figure", F.round("questions_per_figure", 6))


@query(f"""WITH {S.SYNTHETIC}, k AS (SELECT correct::int AS c, unnest([{{'kind': 'overall', 'name': 'all'}}, {{'kind': 'source', 'name': source}}, {{'kind': 'template', 'name': template}}, {{'kind': 'answerable', 'name': CASE WHEN NOT absent THEN 'all' END}}]) AS u FROM synthetic)
  SELECT u.kind AS kind, u.name AS name, count(*) AS n, sum(c)::bigint AS n_correct, round(1.0 - sum(c) / count(*), 4) AS error_rate FROM k WHERE u.name IS NOT NULL GROUP BY 1, 2""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.run_summary(S.synthetic(spark, sf_dir))


@query(f"WITH {S.SYNTHETIC} SELECT template, outcome, count(*) AS n FROM synthetic WHERE absent GROUP BY 1, 2")
def absent_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.absent_outcomes(S.synthetic(spark, sf_dir))


@query(f"WITH {S.ITEMS}, v AS (SELECT length(question) * 10 AS t FROM items) SELECT min(t)::bigint AS lowest, max(t)::bigint AS highest, round(avg(t), 6) AS mean, quantile_cont(t, 0.5)::double AS median, count(*) FILTER (t < 250 OR t > 290) AS outside FROM v")
def vision_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = A.vision_tokens(S.answers(spark, sf_dir), 250, 290)
    return got.select(F.col("lowest").cast("long").alias("lowest"), F.col("highest").cast("long").alias("highest"), F.round("mean", 6).alias("mean"), "median", "outside")


@query(f"WITH {S.ITEMS} SELECT event_id, CASE WHEN question LIKE '%average%' THEN 'arithmetic' ELSE 'retrieval' END AS kind FROM items")
def question_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.items(spark, sf_dir).select("event_id", X.question_type(F.col("question")).alias("kind"))


@query(f"WITH {S.SYNTHETIC} SELECT template, coalesce(outcome, '-') AS outcome, correct, count(*) AS n FROM synthetic GROUP BY 1, 2, 3")
def synthetic_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.synthetic(spark, sf_dir).groupBy("template", F.coalesce("outcome", F.lit("-")).alias("outcome"), "correct").agg(F.count("*").alias("n"))


@query(f"WITH {S.SYNTHETIC} SELECT event_id, outcome, correct FROM synthetic")
def rescored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.synthetic(spark, sf_dir).drop("outcome", "correct")
    shown = rows.groupBy("figure_id").agg(F.first("categories").alias("categories"))
    return A.rescore(rows.drop("categories").withColumn("outcome", F.lit("")).withColumn("correct", F.lit(False)), shown).select("event_id", "outcome", "correct")


_CLASS = "CASE WHEN NOT absent THEN CASE WHEN correct THEN 'C' ELSE 'S' END ELSE CASE outcome WHEN 'fabricated' THEN 'F' WHEN 'zero' THEN 'Z' WHEN 'rejected' THEN 'R' WHEN 'unclear' THEN 'U' END END"


@query(f"""WITH {S.SYNTHETIC}, c AS (SELECT event_id, template, {_CLASS} AS pilot FROM synthetic)
  SELECT event_id, CASE WHEN template IN ('read_value', 'absent_category', 'absent_value') AND pilot IN ('C', 'S', 'F', 'Z') THEN pilot END AS types,
    CASE WHEN template IN ('read_value', 'absent_category', 'absent_value') AND pilot <> 'U' THEN pilot END AS scores, pilot FROM c""")
def item_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.synthetic(spark, sf_dir).select("event_id", *[A.synthetic_class(k).alias(k) for k in ("types", "scores", "pilot")])


@query(f"WITH {S.LABELLED} SELECT item_id, CASE WHEN correct THEN 'C' ELSE CASE label WHEN 'structural' THEN 'S' WHEN 'computation' THEN 'K' WHEN 'fabrication' THEN 'F' WHEN 'not_an_error' THEN 'N' END END AS cls FROM joined")
def natural_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.labelled(S.answers(spark, sf_dir), S.labels(spark, sf_dir)).select("item_id", A.natural_class(F.col("label")).alias("cls"))


_PARTS = {
    "absent_value_vs_present": ("template IN ('read_value', 'absent_value', 'absent_category')", "absent"),
    "absent_compare_vs_present": ("template IN ('compare_present', 'absent_compare')", "absent"),
    "absent_neighbor_vs_present": ("template IN ('neighbor_present', 'absent_neighbor')", "absent"),
    "value_fab_vs_zero": ("template = 'absent_value' AND outcome IN ('fabricated', 'zero')", "outcome = 'fabricated'"),
    "value_fab_vs_zero_lookalike": ("template = 'absent_value' AND outcome IN ('fabricated', 'zero') AND lookalike_of IS NOT NULL", "outcome = 'fabricated'"),
    "compare_fab_vs_present": ("template = 'absent_compare' AND outcome IN ('fabricated', 'picked_present')", "outcome = 'fabricated'"),
    "read_misread": ("template = 'read_value'", "NOT correct"),
}


@query(f"WITH {S.SYNTHETIC} SELECT contrast, y, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS contrast, ({y})::int AS y FROM synthetic WHERE {w}" for k, (w, y) in _PARTS.items()) + ") GROUP BY 1, 2")
def contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.contrast_rows(S.synthetic(spark, sf_dir)).groupBy("contrast", "y").agg(F.count("*").alias("n"))


@query(f"WITH {S.ANSWERS} SELECT item_id, (source = 'human')::int::double AS is_human, length(question)::double AS question_length, (length(question) * 10)::double AS vision_tokens, regexp_matches(gold, '^[0-9]+$')::int::double AS numeric_gold FROM answers")
def surface_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.answers(spark, sf_dir).select("item_id", *features.surface_columns())


@query(f"""WITH {S.POINTS}, f AS (SELECT p_partkey, p_type, p_size, p_brand FROM part),
  t AS (SELECT figure_id, category FROM points), v AS (SELECT figure_id, value FROM points),
  j AS (SELECT p_partkey, p_type, p_size % 9 = 0 AS odd, exists(SELECT 1 FROM v WHERE v.figure_id = f.p_brand AND abs(f.p_size - v.value) <= 0.01 * greatest(v.value, 1)) AS near FROM f)
  SELECT p_partkey, near OR odd AS in_figure, CASE WHEN odd THEN 'categorical' ELSE 'numeric' END AS kind FROM j""")
def answers_in_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = X.figure_text(F.lit("bar_chart"), F.col("categories"), F.col("values"), F.lit(None).cast("array<string>"), F.lit(None).cast("array<array<string>>"))
    shown = S.figures(spark, sf_dir).select(F.col("figure_id").alias("p_brand"), X.figure_terms(texts).alias("terms"))
    part = S.read(spark, sf_dir, "part").join(shown, "p_brand")
    given = F.when(F.col("p_size") % 9 == 0, F.upper("p_type")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".0 %")))
    return part.select("p_partkey", X.answer_among(given, F.col("terms")).alias("in_figure"), X.answer_type(given).alias("kind"))


@query(f"WITH {S.ANSWERS} SELECT item_id, occurrence::bigint AS occurrence FROM answers")
def minted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.answers(spark, sf_dir).select("item_id", F.col("occurrence").cast("long").alias("occurrence"))


@query(r"""WITH h AS (SELECT p_brand || p_partkey AS figure_id, ('0x' || substr(sha1('42' || chr(31) || p_brand || p_partkey), 1, 8))::bigint AS v FROM part)
  SELECT figure_id, CASE WHEN v / 4294967295.0 < 0.2 THEN 'test' WHEN v / 4294967295.0 < 0.4 THEN 'val' ELSE 'train' END AS split, v % 5 AS fold FROM h""")
def figure_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    fig = S.read(spark, sf_dir, "part").select(F.concat("p_brand", F.col("p_partkey").cast("string")).alias("figure_id"))
    return fig.select("figure_id", ids.figure_split(F.col("figure_id")).alias("split"), ids.fold_of(F.col("figure_id")).cast("long").alias("fold"))


@query(r"""WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY sha1('42' || chr(31) || p_partkey::varchar)) AS k, count(*) OVER () AS n FROM part)
  SELECT p_partkey, CASE WHEN k <= n * 7 // 10 THEN 'train' WHEN k <= n * 7 // 10 + n // 5 THEN 'val' ELSE 'test' END AS split FROM r""")
def exact_ratio_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = S.read(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("figure_id"))
    return ids.ratio_splits(part, {"train": 7, "val": 2, "test": 1}).select("p_partkey", "split")


@query("SELECT c_custkey, rtrim(ltrim(regexp_replace(lower(trim(c_name || ' (' || c_mktsegment || ') ')), '[^a-z0-9_-]+', '_', 'g'), '_'), '_') AS stem FROM customer")
def sanitized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read(spark, sf_dir, "customer").select("c_custkey", X.sanitize(F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(") "))).alias("stem"))


@query("SELECT l_orderkey, l_linenumber::bigint AS line, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity::bigint::varchar ELSE 'It is ' || l_quantity::bigint || '.' END AS answer, l_linenumber % 2 = 0 AS parsed FROM lineitem")
def verified_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("long").cast("string")
    reply = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("Let me see.\nAnswer: 7\n**Answer:** "), q, F.lit("\n"))).otherwise(F.concat(F.lit("It is "), q, F.lit(".")))
    got = S.read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), X.verified_answer(reply).alias("v"))
    return got.select("l_orderkey", "line", "v.answer", "v.parsed")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE CASE event_type WHEN 'signup' THEN '0' WHEN 'purchase' THEN '1' WHEN 'error' THEN '2' WHEN 'view' THEN '3' ELSE '4' END END AS targets FROM events")
def named_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.concat(F.lit("Is the bar "), F.when(F.col("event_id") % 3 == 0, F.upper("event_type")).otherwise(F.col("event_type")), F.lit("?"))
    found = X.question_targets(q, F.array(*map(F.lit, S.CATEGORIES)))
    return S.read(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(found, lambda i: i.cast("string")), ",").alias("targets"))


@query(f"WITH {S.POINTS} SELECT figure_id, round(regr_slope(value, place) * 30 + regr_intercept(value, place), 1) AS extrapolated FROM points GROUP BY 1")
def extrapolated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.extrapolated(S.points(spark, sf_dir).withColumnRenamed("place", "year"), 30)


@query(f"WITH {S.POINTS}, d AS (SELECT figure_id, value - lag(value) OVER (PARTITION BY figure_id ORDER BY value) AS d FROM points) SELECT figure_id, min(d) AS min_gap FROM d GROUP BY 1")
def min_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.min_gap(S.points(spark, sf_dir))


@query(f"""WITH {S.POINTS}, d AS (SELECT figure_id, value, category AS high, lag(category) OVER w AS low, value - lag(value) OVER w AS gap FROM points WINDOW w AS (PARTITION BY figure_id ORDER BY value, category)),
  r AS (SELECT *, row_number() OVER (PARTITION BY figure_id ORDER BY gap, value, low, high) AS k FROM d WHERE low IS NOT NULL) SELECT figure_id, low, high FROM r WHERE k = 1""")
def closest_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.closest_pairs(S.points(spark, sf_dir))


@query(f'WITH {S.POINTS} SELECT figure_id, category, lead(category) OVER (PARTITION BY figure_id ORDER BY place) AS "right" FROM points')
def right_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.neighbours(S.points(spark, sf_dir))


@query(f"""WITH {S.POINTS}, n AS (SELECT name, row_number() OVER (ORDER BY sha1(name)) - 1 AS place, count(*) OVER () AS size FROM (SELECT DISTINCT p_type || ' ' || m AS name FROM part, (SELECT unnest(['A', 'B']) AS m) UNION SELECT DISTINCT p_type FROM part)),
  f AS (SELECT figure_id, ('0x' || substr(sha1('42/' || figure_id), 1, 8))::bigint AS h FROM (SELECT DISTINCT figure_id FROM points)),
  x AS (SELECT figure_id, name, (place - h % size + size) % size AS i FROM f, n WHERE NOT exists (SELECT 1 FROM points p WHERE p.figure_id = f.figure_id AND p.category = n.name))
  SELECT figure_id, min_by(name, i) AS absent FROM x GROUP BY 1""")
def absent_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = S.read(spark, sf_dir, "part").select("p_type").distinct()
    names = kinds.select(F.explode(F.array(F.col("p_type"), F.concat("p_type", F.lit(" A")), F.concat("p_type", F.lit(" B")))).alias("name"))
    return features.absent_names(S.points(spark, sf_dir), names)


@query(f"""WITH {S.POINTS}, n AS (SELECT DISTINCT p_type AS "like", p_type || ' ' || m AS name FROM part, (SELECT unnest(['A', 'B']) AS m) UNION SELECT DISTINCT p_type, upper(p_type) || '' FROM part),
  x AS (SELECT figure_id, category AS lookalike_of, name, sha1('42/' || figure_id || '/' || category || '/' || name) AS h FROM points JOIN n ON n."like" = category WHERE NOT exists (SELECT 1 FROM points p WHERE p.figure_id = points.figure_id AND p.category = n.name)),
  r AS (SELECT *, row_number() OVER (PARTITION BY figure_id ORDER BY h, lookalike_of, name) AS k FROM x) SELECT figure_id, lookalike_of, name AS absent FROM r WHERE k = 1""")
def lookalike_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = S.read(spark, sf_dir, "part").select(F.col("p_type").alias("like")).distinct()
    names = kinds.select("like", F.explode(F.array(F.upper("like"), F.concat("like", F.lit(" A")), F.concat("like", F.lit(" B")))).alias("name"))
    return features.lookalikes(S.points(spark, sf_dir), names)


_GRAPHS = """graphs AS (SELECT l_orderkey AS figure_id, list(chr((65 + l_partkey % 20)::int) ORDER BY l_linenumber, l_partkey, l_suppkey) AS path, list(chr((65 + l_suppkey % 20)::int) ORDER BY l_linenumber, l_partkey, l_suppkey) AS others FROM lineitem GROUP BY 1)"""


@query(f"""WITH {_GRAPHS}, g AS (SELECT *, (SELECT min(x) FROM (SELECT unnest([chr((65 + i)::int) FOR i IN range(26)]) AS x) WHERE NOT list_contains(path, x) AND NOT list_contains(others, x)) AS free FROM graphs WHERE len(path) > 1),
  q AS (SELECT figure_id, unnest([{{'t': 'path_length', 'q': 'How many steps lead from ' || path[1] || ' to ' || path[-1] || '?', 'g': (len(path) - 1)::varchar}}, {{'t': 'successor', 'q': 'Which node follows ' || path[1] || '?', 'g': path[2]}}, {{'t': 'absent_node', 'q': 'Which node follows ' || free || '?', 'g': 'not shown'}}]) AS u FROM g)
  SELECT figure_id, u.t AS template, u.q AS question, u.g AS gold FROM q""")
def path_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about node-link figures whose path is a row of parts, each with an edge to its supplier."""
    node = lambda c: F.char((65 + F.col(c) % 20).cast("long"))
    cells = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", node("l_partkey").alias("a"), node("l_suppkey").alias("b"))))
    rows = S.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("figure_id")).agg(cells.alias("c"))
    return features.path_questions(rows.select("figure_id", F.transform("c", lambda x: x["a"]).alias("path_nodes"), F.transform("c", lambda x: F.array(x["a"], x["b"])).alias("edges")))


@query(f"""WITH {S.POINTS}, p AS (SELECT figure_id, value, (value - 0) / 10.0 AS r FROM points)
  SELECT figure_id, count(*) AS n, sum(floor(abs(r - round_even(r, 0)) * 1000 + 0.5)::bigint)::bigint AS grid_offsets, sum(floor(abs(value - 10 * round_even(value / 10.0, 0)) / greatest(value, 1) * 1000 + 0.5)::bigint)::bigint AS rel_ten_offsets FROM p GROUP BY 1""")
def grid_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    figs = S.figures(spark, sf_dir)
    rows = features.grid_features(figs.withColumn("asks_about", F.explode("categories")))
    whole = lambda c: F.sum(F.floor(F.col(c) * 1000 + 0.5)).cast("long")
    return rows.groupBy("figure_id").agg(F.count("*").alias("n"), whole("grid_offset").alias("grid_offsets"), whole("rel_ten_offset").alias("rel_ten_offsets"))


@query(f"""WITH {S.POINTS}, f AS (SELECT figure_id, list(category ORDER BY place) AS c, list(value ORDER BY place) AS v FROM points GROUP BY 1),
  q AS (SELECT figure_id, unnest([{{'t': 'read_value', 'q': 'What is the value of ' || c[1] || '?', 'g': v[1]::varchar}}, {{'t': 'compare_bars', 'q': 'Which is larger, ' || c[1] || ' or ' || c[2] || '?', 'g': CASE WHEN v[1] >= v[2] THEN c[1] ELSE c[2] END}},
    {{'t': 'bar_difference', 'q': 'What is the difference between ' || c[1] || ' and ' || c[2] || '?', 'g': abs(v[1] - v[2])::varchar}}, {{'t': 'absent_category', 'q': 'What is the value of A?', 'g': 'not shown'}}]) AS u FROM f)
  SELECT figure_id, u.t AS template, u.q AS question, u.g AS gold FROM q WHERE u.q IS NOT NULL AND u.g IS NOT NULL""")
def built_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.questions(S.figures(spark, sf_dir))


@query("""WITH t AS (SELECT vec_id AS item_id, i AS pos, ['image', 'image', 'image', 'image', 'text', 'text', 'text', 'special'][i + 1] AS kind, d AS dim, floor(embedding[8 * i + d + 1]::double * 100)::bigint AS x
    FROM embeddings, (SELECT unnest(range(8)) AS i), (SELECT unnest(range(8)) AS d)),
  g AS (SELECT item_id, dim, avg(x) FILTER (kind = 'image') AS vision_mean, max(x) FILTER (kind = 'image') AS vision_max, max_by(x, pos) AS query_last, avg(x) FILTER (kind = 'text') AS query_mean FROM t GROUP BY 1, 2)
  SELECT item_id, dim::bigint AS dim, round(vision_mean, 4) AS vision_mean, vision_max::double AS vision_max, query_last::double AS query_last, round(query_mean, 4) AS query_mean FROM g""")
def pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.pooled(S.tokens(spark, sf_dir))
    each = rows.select("item_id", "position", F.posexplode("vec").alias("dim", "x"))
    wide = each.groupBy("item_id", F.col("dim").cast("long").alias("dim")).pivot("position", ["vision_mean", "vision_max", "query_last", "query_mean"]).agg(F.max("x"))
    return wide.select("item_id", "dim", F.round("vision_mean", 4).alias("vision_mean"), "vision_max", "query_last", F.round("query_mean", 4).alias("query_mean"))


@query(f"""WITH {S.EDGES} SELECT p.figure_id, count(*) FILTER (p.a NOT IN (q.a, q.b) AND p.b NOT IN (q.a, q.b)
    AND sign((p.bx - p.ax) * (q.ay - p.ay) - (p.by_ - p.ay) * (q.ax - p.ax)) * sign((p.bx - p.ax) * (q.by_ - p.ay) - (p.by_ - p.ay) * (q.bx - p.ax)) < 0
    AND sign((q.bx - q.ax) * (p.ay - q.ay) - (q.by_ - q.ay) * (p.ax - q.ax)) * sign((q.bx - q.ax) * (p.by_ - q.ay) - (q.by_ - q.ay) * (p.bx - q.ax)) < 0) AS crossings
  FROM edges p JOIN edges q ON p.figure_id = q.figure_id AND p.eid < q.eid GROUP BY 1""")
def edge_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.edge_crossings(S.edges(spark, sf_dir).where("figure_id is not null"))


@query(f"WITH {S.OUTCOMES} SELECT failure_type, intervention, count(*) AS n, sum(recovered::int)::bigint AS recovered, round(avg(recovered::int), 6) AS rate FROM outcomes GROUP BY 1, 2")
def recovery_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.recovery(S.outcomes(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


@query(f"""WITH {S.OUTCOMES}, r AS (SELECT failure_type AS t, intervention AS i, avg(recovered::int) AS v FROM outcomes GROUP BY 1, 2)
  SELECT round((SELECT v FROM r WHERE t = 'structural' AND i = 'I_crop') - (SELECT v FROM r WHERE t = 'structural' AND i = 'I_0') - ((SELECT v FROM r WHERE t = 'fabrication' AND i = 'I_crop') - (SELECT v FROM r WHERE t = 'fabrication' AND i = 'I_0')), 6) AS delta""")
def difference_in_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.difference_in_differences(S.outcomes(spark, sf_dir), "I_crop").select(F.round("delta", 6).alias("delta"))


@query(f"""WITH {S.OUTCOMES}, r AS (SELECT failure_type, intervention, avg(recovered::int) AS v FROM outcomes WHERE failure_type <> 'computation' GROUP BY 1, 2),
  k AS (SELECT *, row_number() OVER (PARTITION BY failure_type ORDER BY v DESC, intervention DESC) AS n FROM r) SELECT failure_type, intervention AS best FROM k WHERE n = 1""")
def best_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.best_repairs(S.outcomes(spark, sf_dir))


@query(f"WITH {S.OUTCOMES} SELECT failure_type, intervention, count(*) FILTER (outcome = 'rejected') AS rejected, count(*) FILTER (outcome = 'zero') AS zero, count(*) FILTER (outcome = 'fabricated') AS fabricated, count(*) FILTER (outcome = 'unclear') AS other FROM outcomes GROUP BY 1, 2")
def outcome_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.transitions(S.outcomes(spark, sf_dir))


@query(f"""WITH {S.ANSWERS}, i AS (SELECT unnest(['I_reask', 'I_upsample', 'I_crop', 'I_verify']) AS intervention)
  SELECT item_id, intervention, intervention <> 'I_crop' OR event_id % 4 <> 0 AS applicable, CASE WHEN intervention = 'I_crop' AND event_id % 4 <> 0 AND event_type IN ('view', 'click') THEN 'named category absent; whole figure shown' END AS note FROM answers, i""")
def intervention_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans for figures that show three of five event types; every fourth has no geometry."""
    rows = S.answers(spark, sf_dir).withColumn("categories", F.array(*map(F.lit, S.CATEGORIES[:3]))).withColumn("has_geometry", F.col("event_id") % 4 != 0)
    return outcomes.plan(rows)


@query(f"""WITH {S.OUTCOMES}, w AS (SELECT item_id, bool_or(recovered) FILTER (intervention = 'I_0') AS a, bool_or(recovered) FILTER (intervention = 'I_crop') AS b, any_value(failure_type) AS cls FROM outcomes GROUP BY 1)
  SELECT cls, count(*) AS n, count(*) FILTER (item_id % 2 = 0) AS relooked, count(*) FILTER (item_id % 2 = 0 AND b AND NOT a) AS fixed, count(*) FILTER (item_id % 2 = 0 AND a AND NOT b) AS broken FROM w GROUP BY 1""")
def relook_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.outcomes(spark, sf_dir)
    kinds = rows.groupBy("item_id").agg(F.max("failure_type").alias("cls"))
    wide = outcomes.universe(kinds, rows).withColumn("relooked", F.col("item_id") % 2 == 0)
    return outcomes.relook_effect(wide.select("cls", "relooked", F.col("I_0").alias("before"), F.when(F.col("relooked"), F.col("I_crop")).otherwise(F.col("I_0")).alias("after")))


@query(f"""WITH {S.ITEMS} SELECT event_type AS direction, count(*) AS n, count(*) FILTER (event_id % 2 = 0) AS fabricated, count(*) FILTER (event_id % 2 = 0 AND least(abs(30 - (user_id % 40)), abs(60 - (user_id % 40))) <= 0.05 * 30 + 1e-9) AS copies_bar,
    count(*) FILTER (event_id % 2 = 0 AND abs(20 - user_id % 40) <= 1.0 + 1e-9) AS near_line FROM items JOIN (SELECT event_id, user_id FROM events) USING (event_id) GROUP BY 1""")
def pilot_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.read(spark, sf_dir, "events").select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("figure_id"), F.col("event_type").alias("direction"), F.concat((F.col("user_id") % 40).cast("string"), F.lit(" %.")).alias("prediction"), F.when(F.col("event_id") % 2 == 0, "fabricated").otherwise("zero").alias("outcome"), F.lit(20.0).alias("extrapolated"))
    rows = rows.withColumn("prediction", F.regexp_replace("prediction", " ", ""))
    shown = rows.select("figure_id").distinct().withColumn("values", F.array(F.lit(30), F.lit(60)))
    return A.pilot_outcomes(rows.withColumn("prediction", F.regexp_replace("prediction", r"%\.$", "%")), shown)


@query(f"WITH {S.LABELLED} SELECT count(*) FILTER (NOT correct AND label IS NULL) AS unlabelled, count(*) FILTER (correct AND event_id % 5 = 0) AS extra FROM joined")
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors without a label, and labels of right answers: every fifth of these has one here."""
    rows = S.answers(spark, sf_dir)
    more = rows.where(F.col("correct") & (F.col("event_id") % 5 == 0)).select("item_id")
    return A.coverage_gaps(rows, S.labels(spark, sf_dir).select("item_id").unionByName(more))


@query(f"WITH {S.LABELLED} SELECT item_id FROM joined WHERE NOT correct AND label IS NULL")
def pending_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.answers(spark, sf_dir)
    return A.pending(rows.where(~F.col("correct")).select("item_id"), S.labels(spark, sf_dir), ["item_id"])


@query(f"""WITH {S.ITEMS}, d AS (SELECT event_id, row_number() OVER (PARTITION BY figure_id, question ORDER BY event_id) > 1 AS again, trim(prediction) = '' AS empty FROM items)
  SELECT event_id AS pos, 'duplicate' AS warning FROM d WHERE again UNION ALL SELECT event_id, 'empty prediction' FROM d WHERE empty""")
def manifest_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.manifest_warnings(S.items(spark, sf_dir)).withColumnRenamed("problem", "warning")


@query(f"WITH {S.ITEMS}, g AS (SELECT figure_id, count(DISTINCT source) AS k FROM items GROUP BY 1) SELECT figure_id, 'augmented,human' AS groups FROM g WHERE k > 1")
def figure_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.figure_leaks(S.items(spark, sf_dir), group="source").select("figure_id", F.array_join("groups", ",").alias("groups"))


@query(f"""WITH {S.ANSWERS} SELECT item_id, 'id differs' AS problem FROM answers WHERE event_id % 31 = 0 UNION ALL SELECT item_id, 'no gold' FROM answers WHERE event_id % 37 = 0""")
def answer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    rows = S.answers(spark, sf_dir).withColumn("question", F.when(i % 31 == 0, F.concat("question", F.lit("!"))).otherwise(F.col("question"))).withColumn("gold", F.when(i % 37 != 0, F.col("gold")))
    return quality.check_answers(rows, S.MODEL, ("gold", "prediction", "figure_id"))


@query(f"WITH {S.POINTS}, f AS (SELECT figure_id, max(value) AS m, count(*) AS n FROM points GROUP BY 1), d AS (SELECT figure_id, min(d) AS d FROM (SELECT figure_id, value - lag(value) OVER (PARTITION BY figure_id ORDER BY value) AS d FROM points) GROUP BY 1) SELECT figure_id, 'off the axis' AS problem FROM f WHERE m > 5 UNION ALL SELECT figure_id, 'values too close' FROM d WHERE d < 1")
def figure_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    figs = S.figures(spark, sf_dir).withColumn("axis_max", F.lit(5)).withColumn("split", F.lit("train")).withColumn("absent_partners", F.lit(None).cast("array<string>"))
    return quality.check_figures(figs, 1)


@query("SELECT o_custkey AS pair_id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) <> 2 OR min(o_orderkey % 2) = max(o_orderkey % 2) OR count(DISTINCT o_orderstatus) > 1")
def pair_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pair_id"), F.when(F.col("o_orderkey") % 2 == 0, "easy").otherwise("hard").alias("pair_variant"), F.col("o_orderstatus").alias("split"))
    return quality.check_pairs(rows)


@query(f"WITH {S.SYNTHETIC} SELECT 'm1' AS model, round(avg(correct::int), 6) AS accuracy, 0.3::double AS floor, avg(correct::int) >= 0.3 AS passes FROM synthetic WHERE NOT absent")
def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.acceptance(S.synthetic(spark, sf_dir), {S.MODEL: 0.3}).withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT user_id AS run_id, 'kind' AS key, count(DISTINCT event_type) AS n_values FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def settings_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.create_map(F.lit("kind"), F.col("event_type"), F.lit("fixed"), F.lit("1")).alias("settings"))
    return quality.settings_drift(rows)


@query(f"WITH {S.ITEMS} SELECT 'a/' || figure_id AS figure_id, 'a' AS pilot, count(*) AS n FROM items WHERE source = 'human' GROUP BY 1 UNION ALL SELECT 'b/' || figure_id, 'b', count(*) FROM items WHERE source = 'augmented' GROUP BY 1")
def tagged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.items(spark, sf_dir)
    both = tables.tagged_union({"a": rows.where("source = 'human'"), "b": rows.where("source = 'augmented'")})
    return both.groupBy("figure_id", "pilot").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS item_id, 'p_brand=' || p_brand AS feature FROM part UNION ALL SELECT p_partkey, 'p_size=' || p_size FROM part")
def one_hot_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.one_hot(S.read(spark, sf_dir, "part").withColumnRenamed("p_partkey", "item_id"), ["p_brand", "p_size"], "item_id").select("item_id", "feature")


@query("WITH q AS (SELECT p_brand AS figure_id, list(p_partkey::varchar ORDER BY p_partkey) AS q FROM part GROUP BY 1), e AS (SELECT figure_id, unnest(q) AS gold, generate_subscripts(q, 1) - 1 AS pos FROM q) SELECT figure_id, pos::bigint AS pos, 'Which part? ' || gold AS question, gold FROM e")
def nested_figure_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("gold_answer"), F.concat(F.lit("Which part? "), F.col("p_partkey").cast("string")).alias("question"))))
    figs = S.read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("figure_id")).agg(q.alias("questions")).withColumn("split", F.lit("test")).withColumn("categories", F.array(F.lit("A")))
    return tables.figure_items(figs, "test").select("figure_id", F.col("pos").cast("long").alias("pos"), "question", "gold")
