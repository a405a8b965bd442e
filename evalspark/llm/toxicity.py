"""Toxicity scores by a subsequence string-kernel support vector machine.

The strings are the words of a text: its white-space tokens without their non-letters, and runs of
single letters put together, so that "i-d-i-o-t" and "i d i o t" become one word. A string of more
than LONGEST letters is covered by windows of WINDOW letters, STRIDE apart, each a word of its own, so
that every run of up to WINDOW - STRIDE + 1 of its letters is whole in one of them. Two words are
compared by the gap-weighted subsequence kernel of order 3: every triple of letters in order, at
most SPAN places apart, weighs DECAY to the number of letters that it skips, so inserted letters
lower the similarity and don't destroy it. The Nyström method projects on landmark words. The
support vector machine on that projection is linear in the kernel's own feature space, so scoring a
word sums one table entry for each of its triples.

Sentences of labelled documents teach it: each has its document's label, since labels are the documents'. Words that a toxic
document's sentences may owe their label to are positives, words of sentences of other documents are negatives, in a few rounds
that replace both by what the last machine confuses. Words are chosen by counts over all sentences of the sample: WITNESSES,
NEGATIVE_LANDMARKS and MAX_NEGATIVE_WORDS bound how many of them stand in one fit. Document features are the highest decision
value, the mean of the three highest, and how many words are above zero and clearly above it; a logistic fit on
out-of-fold features turns them into a probability.

Null and empty texts get the features of a text without words. Ties and repeated rows are scored
alike. An empty labels table gives the constant score 0.5 to every text; an empty table of documents gives no rows. A column
named as the output is replaced, others are kept. Texts of any length are scored whole, 256 rows at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import column, hash_fold, plain_names, training_sample
from evalspark.llm.models import fit_logistic, fit_squared_hinge, logistic

SPAN, DECAY, LETTERS = 5, 0.6, 64
#: Strings of more than LONGEST letters are cut into windows; an insult with its gaps fits into the overlap.
LONGEST, WINDOW, STRIDE = 64, 24, 4
POSITIVE_LANDMARKS, NEGATIVE_LANDMARKS = 160, 64
#: At most so many labelled rows, and bytes of their texts, are collected to fit the model.
MAX_TRAINING_ROWS, MAX_TRAINING_BYTES = 4000, 64 << 20
#: At most so many words of toxic documents stand in one fit: first ones, kept ones, and those found later.
WITNESSES, KEPT_WITNESSES, FOUND_WITNESSES = 2000, 500, 6000
#: At most so many words that are not toxic are used in one fit, and kept in a worker's cache.
MAX_NEGATIVE_WORDS, MAX_CACHED = 24_000, 400_000
#: L2 penalty per training word, and the share of the loss that positives carry.
PENALTY, POSITIVE_SHARE = 3e-6, 0.4
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+|[\r\n]+")
_OFFSETS = [(a, b) for b in range(2, SPAN + 1) for a in range(1, b)]


def _letter_codes() -> np.ndarray:
    codes = 27 + np.arange(65536) % 36
    codes[ord("a") : ord("z") + 1] = np.arange(1, 27)
    codes[ord("^")] = 63
    return codes


_CODES = _letter_codes()


def windows(string: str) -> list[str]:
    """The string, or the overlapping windows that cover a long one."""
    if len(string) <= LONGEST:
        return [string]
    last = len(string) - WINDOW
    return [string[i : i + WINDOW] for i in [*range(0, last, STRIDE), last]]


def words_of(text: str) -> set[str]:
    """The distinct strings that the kernel compares."""
    tokens = text.lower().split()
    found = {t if t.isalpha() else "".join(filter(str.isalpha, t)) for t in set(tokens)}
    if sum(len(t) == 1 for t in tokens) >= 4:
        for run in re.findall(r"(?<!\S)(?:\S\s+){3,}\S(?!\S)", text.lower()):
            found.add("".join(filter(str.isalpha, run)))
    return {w for s in found if len(s) >= 3 for w in windows(s)}


@dataclass
class Triples:
    """The distinct letter triples of many words: word number, code and weight of each; the norms of the words, the roots of their kernels with themselves."""

    word: np.ndarray
    code: np.ndarray
    weight: np.ndarray
    norm: np.ndarray


def triples(words: list[str]) -> Triples:
    marked = ["^" + w for w in words]
    flat = np.frombuffer("".join(marked).encode("utf-16-le", "replace"), dtype=np.uint16)
    codes = _CODES[flat]
    lengths = np.array([len(w.encode("utf-16-le", "replace")) // 2 for w in marked], dtype=np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    parts = []
    for a, b in _OFFSETS:
        n = max(0, len(flat) - b)
        at = np.flatnonzero(owner[:n] == owner[b : b + n])
        code = (codes[at] * LETTERS + codes[at + a]) * LETTERS + codes[at + b]
        parts.append((owner[at], code, np.full(len(at), DECAY ** (b - 2))))
    word, code, weight = (np.concatenate(x) for x in zip(*parts))
    # A triple that a word has at several places weighs their sum.
    key, at = np.unique(word * LETTERS**3 + code, return_inverse=True)
    word, code, weight = key // LETTERS**3, key % LETTERS**3, np.bincount(at, weights=weight, minlength=len(key))
    norm = np.sqrt(np.bincount(word, weights=weight**2, minlength=len(words)))
    return Triples(word, code, weight, np.maximum(norm, 1e-9))


def table_sums(words: list[str], weights: np.ndarray) -> np.ndarray:
    """For each word the sum of the weights of its triples, divided by its norm."""
    t = triples(words)
    return np.bincount(t.word, weights=t.weight * weights[t.code], minlength=len(words)) / t.norm


class Landmarks:
    """The Nyström projection on landmark words."""

    def __init__(self, words: list[str]):
        t = triples(words)
        self.codes, at = np.unique(t.code, return_inverse=True)
        self.place = np.full(LETTERS**3, -1)
        self.place[self.codes] = np.arange(len(self.codes))
        self.features = np.zeros((len(words), len(self.codes)))
        np.add.at(self.features, (t.word, at), t.weight / t.norm[t.word])
        values, vectors = np.linalg.eigh(self.features @ self.features.T)
        keep = values > 1e-3 * values.max()
        self.projection = vectors[:, keep] / np.sqrt(values[keep])

    def project(self, words: list[str]) -> np.ndarray:
        out = []
        for i in range(0, len(words), 500):
            t = triples(words[i : i + 500])
            at = self.place[t.code]
            known = at >= 0
            sparse = np.zeros((len(t.norm), len(self.codes)), dtype=np.float32)
            np.add.at(sparse, (t.word[known], at[known]), (t.weight / t.norm[t.word])[known].astype(np.float32))
            out.append(sparse @ self.features.T.astype(np.float32) @ self.projection.astype(np.float32))
        return np.concatenate(out) if out else np.zeros((0, self.projection.shape[1]), dtype=np.float32)

    def table(self, beta: np.ndarray) -> np.ndarray:
        """The weight vector beta as one weight for each triple."""
        weights = np.zeros(LETTERS**3)
        weights[self.codes] = (self.projection @ beta) @ self.features
        return weights


@dataclass
class Machine:
    weights: np.ndarray
    bias: float


def _order(word: str) -> int:
    h = 2166136261
    for c in word.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return h


def sentences(text: str) -> list[str]:
    """The sentences of a text: what full stops, question and exclamation marks before white space, and line ends part."""
    return [s for s in _SENTENCE_END.split(text) if s]


def fit_machine(sentenced: list[list[tuple[str, ...]]], toxic: np.ndarray, rounds: int = 3) -> Machine:
    """A machine for single words from documents, lists of sentences as tuples of their distinct words, and the documents' labels, which are their sentences' labels."""
    pos, neg = Counter(), Counter()
    n_pos = n_neg = 0
    for parts, label in zip(sentenced, toxic):
        for words in parts:
            (pos if label else neg).update(words)
        n_pos, n_neg = n_pos + len(parts) * bool(label), n_neg + len(parts) * (not label)
    n_pos, n_neg = max(1, n_pos), max(1, n_neg)
    found_in = [set().union(*parts) for parts, label in zip(sentenced, toxic) if label]
    if not pos or not neg:
        return Machine(np.zeros(LETTERS**3), 0.0)

    def evidence(w: str) -> float:
        p, q = pos[w] / n_pos, neg[w] / n_neg
        pooled = (pos[w] + neg[w] + 1) / (n_pos + n_neg + 2)
        return (p - q) / np.sqrt(pooled * (1 - pooled) * (1 / n_pos + 1 / n_neg))

    def purity(w: str) -> float:
        """1 for a word of toxic documents only, 0 for one that others have a third as often or more."""
        return max(0.0, 1.0 - 3.0 * (neg[w] / n_neg) / (pos[w] / n_pos)) if pos[w] else 0.0

    strength = {w: evidence(w) * purity(w) for w in pos if pos[w] >= 2}
    ranked = sorted(strength, key=lambda w: (-strength[w], w))
    witness = [w for w in ranked if strength[w] > 2.5] or ranked[:20] or sorted(pos)[:20]
    background = sorted((w for w in neg if pos[w] * n_neg <= 2 * neg[w] * n_pos), key=_order)
    common = [w for w, _ in neg.most_common(400) if w not in strength or strength[w] < 1]
    marks = Landmarks(list(dict.fromkeys(witness[:POSITIVE_LANDMARKS] + common[: NEGATIVE_LANDMARKS // 2] + background[: NEGATIVE_LANDMARKS // 2])))
    frequent = sorted((w for w in neg if purity(w) == 0.0), key=lambda w: (-neg[w], w))[: MAX_NEGATIVE_WORDS // 8]
    negatives, positives = list(dict.fromkeys(frequent + background[: MAX_NEGATIVE_WORDS // 2])), witness[:WITNESSES]
    machine = Machine(np.zeros(LETTERS**3), 0.0)
    all_neg = sorted(neg)
    for _ in range(rounds):
        names = positives + negatives
        y = np.r_[np.ones(len(positives)), -np.ones(len(negatives))]
        w = np.r_[np.array([pos[x] * purity(x) * min(6.0, max(0.1, strength.get(x, 0.0) - 2.5)) for x in positives]), np.array([1.0 + np.sqrt(neg[x]) for x in negatives])]
        w[y > 0] *= POSITIVE_SHARE * len(y) / w[y > 0].sum()
        w[y < 0] *= (1 - POSITIVE_SHARE) * len(y) / w[y < 0].sum()
        beta, bias = fit_squared_hinge(marks.project(names), y, w, l2=PENALTY * len(y))
        machine = Machine(marks.table(beta), bias)
        value = word_values(all_neg, machine)
        hard = [all_neg[i] for i in np.argsort(-value, kind="stable")[: MAX_NEGATIVE_WORDS // 4]]
        known = dict(zip(all_neg, value))
        fresh = [x for x in pos if x not in known]
        known.update(zip(fresh, word_values(fresh, machine)))
        chosen = Counter()
        for words in found_in:
            if words:
                best = sorted(words, key=lambda x: (-known[x], x))[:6]
                chosen.update(x for x in best if known[x] > 0 and pos[x] * n_neg > 3 * neg[x] * n_pos)
        positives = sorted(set(witness[:KEPT_WITNESSES]) | set(chosen))[:FOUND_WITNESSES]
        # What was hard once stays: else it would rise again as soon as it is left out.
        sure = set(positives)
        negatives = list(dict.fromkeys(x for x in negatives + hard if x not in sure))
    return machine


def document_features(values: np.ndarray) -> list[float]:
    """Features of a document from the decision values of its distinct words."""
    if not len(values):
        return [-1.0, -1.0, 0.0, 0.0, 0.0]
    top = np.sort(np.partition(values, max(0, len(values) - 3))[-3:])[::-1]
    above = float((values > 0).sum())
    return [float(np.clip(top[0], -2, 3)), float(np.clip(top.mean(), -2, 3)), np.log1p(above), np.log1p(float((values > 0.6).sum())), 0.5 * np.log1p(len(values))]


@dataclass
class ToxicityModel:
    machine: Machine
    calibration: np.ndarray


def fit(texts: list[str | None], toxic: np.ndarray, folds: int = 3) -> ToxicityModel:
    # One string for each word, however many documents have it.
    strings: dict[str, str] = {}
    docs = [[tuple(strings.setdefault(w, w) for w in words_of(s)) for s in sentences(t or "")] for t in texts]
    del strings
    toxic = np.asarray(toxic, dtype=float)
    if not len(docs):
        return ToxicityModel(Machine(np.zeros(LETTERS**3), 0.0), np.zeros(6))
    rows, y = [], []
    for k in range(folds):
        held = np.arange(len(docs)) % folds == k
        if not held.any() or held.all():
            continue
        machine = fit_machine([d for d, h in zip(docs, held) if not h], toxic[~held])
        for i in np.flatnonzero(held):
            rows.append(document_features(word_values(sorted(set().union(*docs[i])), machine)))
            y.append(toxic[i])
    calibration = fit_logistic(np.array(rows), np.array(y), l2=0.3) if rows else np.zeros(6)
    return ToxicityModel(fit_machine(docs, toxic), calibration)


def word_values(words: list[str], machine: Machine) -> np.ndarray:
    parts = [table_sums(words[i : i + 1000], machine.weights) for i in range(0, len(words), 1000)]
    return np.concatenate(parts) + machine.bias if parts else np.zeros(0)


class Scorer:
    """Scores texts, remembering the values of words in a bounded cache."""

    def __init__(self, model: ToxicityModel):
        self.model, self.cache = model, {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        docs = [words_of(t or "") for t in texts]
        if len(self.cache) > MAX_CACHED:
            self.cache.clear()
        fresh = [w for w in set().union(*docs) if w not in self.cache] if docs else []
        for i in range(0, len(fresh), 20_000):
            part = fresh[i : i + 20_000]
            self.cache.update(zip(part, word_values(part, self.model.machine).tolist()))
        get = self.cache.__getitem__
        x = np.array([document_features(np.fromiter(map(get, d), dtype=float, count=len(d))) for d in docs]).reshape(-1, 5)
        return logistic(x @ self.model.calibration[:-1] + self.model.calibration[-1])


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, max_bytes: int = MAX_TRAINING_BYTES) -> DataFrame:
    """text, toxic of a bounded sample of the labelled rows outside the held-out fold; of labels that differ for an id the larger counts."""
    known = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").where(hash_fold(F.col("doc_id"), 3) != 1)
    # Twice as many ids as rows, as labels may be of ids that have no document.
    few = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("_k", F.xxhash64("doc_id")).orderBy("_k", "doc_id").limit(2 * max_rows).drop("_k")
    return training_sample(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id"), "toxic", max_rows, max_bytes)


def fit_rows(rows: DataFrame) -> ToxicityModel:
    got = rows.toPandas()
    return fit([t if isinstance(t, str) else None for t in got["text"]], got["toxic"].to_numpy(dtype=float))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the column out, the probability that the text is toxic; all other columns are kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != out]
    docs = plain_names(docs.select(*[F.col(f"`{c}`") for c in kept]))
    place = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                score = pa.array(scorer(part.column(place).to_pylist()), type=pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, score], names=[*part.schema.names, out])

    schema = docs.select("*", F.lit(0.0).alias(out)).schema
    schema[out].nullable = True
    return docs.mapInArrow(run, schema).toDF(*kept, out)
