"""Column expressions for answers: numbers, tolerant equality, outcome classes, question features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and vocabularies of the scoring rules.
NUMBER = r"(?U)^\s*[$€£]?\s*([-+]?[\d,]*\.?\d+)\s*%?\s*$"
PLAIN_NUMBER = r"(?U)^[-+]?\$?\d[\d,]*(\.\d+)?\s*%?$"
REFUSAL = (
    r"(?i)\b(no|not|none|nothing|n/?a|unknown|unavailable|missing|absent|cannot|can't|"
    r"doesn't|isn't|there is no|there are no)\b"
)
ARITHMETIC = (
    r"(?i)\b(differen\w*|sum|summ\w*|add(ed|ing)?|addition|average|avg|mean|median|mode|"
    r"ratio|times|product|multipl\w*|divid\w*|division|subtract\w*|minus|plus|gap|"
    r"(increase|decrease|grow|growth|change|rise|drop|fall)\w* by|"
    r"by how (much|many)|how (much|many) (more|less|fewer|higher|lower|greater|smaller))\b"
)
SURFACE_NUMBER = r"^-?\d+(?:\.\d+)?$"
TOLERANCE, EPSILON, FIGURE_TOLERANCE = 0.05, 1e-9, 0.01


def strip(text: Column) -> Column:
    """text without white space of any kind at its ends (trim removes blanks only)."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def parse_number(text: Column) -> Column:
    """The number that text is, with currency sign, thousands commas and percent sign allowed; else NULL."""
    digits = F.nullif(F.regexp_extract(text, NUMBER, 1), F.lit(""))
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("double")


def within(gold: Column, prediction: Column, tolerance: float = TOLERANCE) -> Column:
    """Whether two numbers agree relative to gold; a gold of 0 asks for exactly 0."""
    near = F.abs(prediction - gold) <= tolerance * F.abs(gold) + EPSILON
    return F.when(gold == 0.0, prediction == 0.0).otherwise(near)


def is_correct(gold: Column, prediction: Column, tolerance: float = TOLERANCE) -> Column:
    """Relaxed correctness: numeric tolerance if both are numbers, else equality without case and outer white space."""
    g, p = parse_number(gold), parse_number(prediction)
    same = F.lower(strip(gold)) == F.lower(strip(prediction))
    return F.when(g.isNotNull() & p.isNotNull(), within(g, p, tolerance)).otherwise(same)


def rescaled_match(gold: Column, prediction: Column) -> Column:
    """Whether prediction is right after multiplying or dividing it by 100."""
    g, p = parse_number(gold), parse_number(prediction)
    return F.coalesce(within(g, p * 100.0) | within(g, p * 0.01), F.lit(False))


def clean(prediction: Column) -> Column:
    return strip(F.regexp_replace(strip(prediction), r"\.+$", ""))


def refuses(text: Column) -> Column:
    return text.rlike(REFUSAL) & ~text.rlike(r"(?U)\d")


def classify_absent(prediction: Column) -> Column:
    """rejected, zero, fabricated or unclear, for a value asked of a category that isn't there."""
    text = clean(prediction)
    value = F.regexp_replace(text, r"[$,%+\s]", "").try_cast("double")
    number = F.when(value == 0.0, "zero").otherwise("fabricated")
    return F.when(text.rlike(PLAIN_NUMBER), number).when(refuses(text), "rejected").otherwise("unclear")


def _among(text: Column, categories: Column) -> Column:
    return F.coalesce(F.exists(categories, lambda c: F.lower(c) == text), F.lit(False))


def classify_compare(prediction: Column, absent: Column, present: Column, categories: Column) -> Column:
    """rejected, fabricated, picked_present or unclear, for a comparison with a category that isn't there."""
    text = F.lower(clean(prediction))
    return (
        F.when(text == F.lower(present), "picked_present")
        .when((text == F.lower(absent)) | _among(text, categories), "fabricated")
        .when(refuses(prediction), "rejected")
        .otherwise("unclear")
    )


def classify_neighbor(prediction: Column, categories: Column) -> Column:
    """rejected, fabricated or unclear, for the neighbour of a category that isn't there."""
    text = clean(prediction)
    return F.when(_among(F.lower(text), categories), "fabricated").when(refuses(text), "rejected").otherwise("unclear")


def question_type(question: Column) -> Column:
    return F.when(question.rlike(ARITHMETIC), "arithmetic").otherwise("retrieval")


def normalise_answer(text: Column) -> Column:
    """Lower case, stripped, without trailing percent signs and a ".0" of a whole number."""
    low = strip(F.regexp_replace(F.lower(strip(text)), r"%+$", ""))
    whole = low.rlike(SURFACE_NUMBER) & low.endswith(".0")
    return F.when(whole, F.regexp_replace(low, r"\.0$", "")).otherwise(low)


def surface_number(text: Column) -> Column:
    low = normalise_answer(text)
    return F.when(low.rlike(SURFACE_NUMBER), low.try_cast("double"))


def answer_type(answer: Column) -> Column:
    low = normalise_answer(answer)
    return (
        F.when(low.isin("yes", "no", "true", "false"), "boolean")
        .when(low.rlike(SURFACE_NUMBER), "numeric")
        .when(low == "", "other")
        .otherwise("categorical")
    )


def figure_terms(texts: Column) -> Column:
    """struct(names, numbers) of a figure's texts, ready to be met by answers: its texts as answers are normalised, and the numbers among them."""
    numbers = F.filter(F.transform(texts, surface_number), lambda n: n.isNotNull())
    return F.struct(F.array_distinct(F.transform(texts, normalise_answer)).alias("names"), F.array_distinct(numbers).alias("numbers"))


def answer_among(answer: Column, terms: Column, tolerance: float = FIGURE_TOLERANCE) -> Column:
    """Whether answer is one of a figure's terms, or a number close to one of them; the answer is normalised once, however many these are."""
    near = lambda number: F.exists(terms["numbers"], lambda n: F.abs(number - n) <= tolerance * F.greatest(F.abs(n), F.lit(1.0)))
    told = F.transform(F.array(normalise_answer(answer)), lambda t: F.struct(t.alias("name"), F.when(t.rlike(SURFACE_NUMBER), t.try_cast("double")).alias("number")))
    found = lambda t: (t["name"] != "") & (F.coalesce(F.array_contains(terms["names"], t["name"]), F.lit(False)) | F.coalesce(near(t["number"]), F.lit(False)))
    return F.get(F.transform(told, found), 0)


def answer_in_figure(answer: Column, texts: Column, tolerance: float = FIGURE_TOLERANCE) -> Column:
    """Whether answer is one of the texts, or a number close to one of them. Where a figure has many answers, take its figure_terms first and then answer_among."""
    return answer_among(answer, figure_terms(texts), tolerance)


def figure_text(figure_type: Column, categories: Column, values: Column, path_nodes: Column, edges: Column) -> Column:
    """All that can be read on a figure, each once."""
    bars = F.array_distinct(F.concat(categories, F.transform(values, lambda v: v.cast("string"))))
    nodes = F.array_distinct(F.concat(path_nodes, F.flatten(edges)))
    return F.when(figure_type == "bar_chart", bars).when(figure_type == "node_link", nodes)


def is_digits(gold: Column) -> Column:
    """Whether gold is all digits once its first point and first minus sign are removed."""
    bare = F.regexp_replace(F.regexp_replace(gold, r"^([^.]*)\.", "$1"), r"^([^-]*)-", "$1")
    return bare.rlike(r"^\d+$")


def loose_number(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(text), r"\.+$", ""), "[,%$]", "").try_cast("double")


def verified_answer(text: Column) -> Column:
    """struct(answer, parsed): what follows "answer:" on the last line that has it, else the whole text."""
    rule = r"(?i)^\s*\**\s*answer\s*\**\s*:\s*(.+)"
    lines = F.filter(F.split(strip(text), r"\r\n|\n|\r"), lambda x: x.rlike(rule))
    last = F.regexp_extract(F.element_at(lines, -1), rule, 1)
    bare = strip(F.regexp_replace(F.regexp_replace(strip(last), r"^\*+", ""), r"\*+$", ""))
    found = F.size(lines) > 0
    return F.struct(F.when(found, bare).otherwise(strip(text)).alias("answer"), found.alias("parsed"))


def question_targets(question: Column, categories: Column) -> Column:
    """Indices of the categories that question names as whole words, case and all."""
    named = lambda c: F.regexp_like(question, F.concat(F.lit(r"(?<!\w)\Q"), c, F.lit(r"\E(?!\w)")))
    marks = F.transform(categories, lambda c, i: F.when(named(c), i))
    return F.array_compact(marks)


def sanitize(name: Column) -> Column:
    """A file stem for a name: lower case, what isn't a letter, digit, _ or - replaced; an error if nothing is left."""
    stem = F.btrim(F.regexp_replace(F.lower(strip(name)), r"[^a-z0-9_-]+", "_"), F.lit("_"))
    return F.when(stem == "", F.raise_error(F.concat(F.lit("no usable characters in the name "), name)).cast("string")).otherwise(stem)
