"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent 1- to 3-grams, most frequent first (ties: smaller code).
A document goes to the language whose profile has the smallest out-of-place distance to its own:
the sum, over the document's n-grams, of how far apart the two ranks are, or PROFILE where the
language lacks the n-gram. Letters are compared in lower case; whatever is no letter ends a word.

The profiles come from a bounded sample of labelled rows. A null text, or one without letters, is
"und" with score 0; equal distances go to the language that sorts first; without any labelled row
every text is "und". A letter is what Unicode calls one; each has a code of its own. Repeated rows get the same answer. An empty table gives no rows.
Columns named lang_pred or score are replaced, others but the text are kept. Long texts are counted in parts that end at white space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import cut_texts, hash_fold, pieces, plain_names, training_sample

PROFILE, BITS = 300, 16
#: At most so many labelled rows, and bytes of their texts, are collected for the profiles.
MAX_TRAINING_ROWS, MAX_TRAINING_BYTES = 2000, 64 << 20
#: Letters beyond the first plane take the place of its private characters.
_PRIVATE, _PRIVATE_SIZE = 0xE000, 6400
_BEYOND = re.compile("[\U00010000-\U0010ffff]")


def _letter_codes() -> np.ndarray:
    """Code of each UTF-16 unit: 0 for what is no letter, else the unit of its lower case."""
    codes = np.zeros(65536, dtype=np.uint64)
    for unit in range(65536):
        char = chr(unit)
        if char.isalpha():
            codes[unit] = ord(char.lower()[0])
    codes[_PRIVATE : _PRIVATE + _PRIVATE_SIZE] = np.arange(_PRIVATE, _PRIVATE + _PRIVATE_SIZE)
    return codes


_LETTERS = _letter_codes()
_ANY_PRIVATE = re.compile(f"[{chr(_PRIVATE)}-{chr(_PRIVATE + _PRIVATE_SIZE - 1)}]")


def plane(text: str) -> str:
    """The text within the first plane: letters beyond it by a private character, other characters beyond it and private ones as blanks."""
    if text.isascii():
        return text
    text = _ANY_PRIVATE.sub(" ", text)
    return _BEYOND.sub(lambda m: chr(_PRIVATE + ord(m[0].lower()) % _PRIVATE_SIZE) if m[0].isalpha() else " ", text)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    units = [np.frombuffer(f" {plane(t)} ".encode("utf-16-le", "surrogatepass"), dtype=np.uint16) for t in texts]
    flat = _LETTERS[np.concatenate(units)]
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), [len(u) for u in units])
    # One mark between words, and one before the first of each text.
    keep = np.flatnonzero((flat > 0) | (np.concatenate(([1], flat[:-1])) > 0) | (np.diff(owner, prepend=owner[:1]) != 0))
    flat, owner = flat[keep], owner[keep]
    inside = flat > 0
    keys = []
    for n in (1, 2, 3):
        m = len(flat) - n + 1
        if m <= 0:
            continue
        code = np.zeros(m, dtype=np.uint64)
        for k in range(n):
            code = (code << np.uint64(BITS)) | flat[k : m + k]
        same = (owner[:m] == owner[n - 1 :]) & (inside[:m] | inside[n - 1 :]) if n < 3 else (owner[:m] == owner[n - 1 :]) & inside[1 : m + 1]
        keys.append((owner[:m][same] << np.uint64(50)) | np.uint64(n << 48) | code[same])
    key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.uint64)
    edge = np.flatnonzero(np.diff(key, prepend=np.uint64(2**64 - 1)) != 0)
    count = np.diff(np.append(edge, len(key)))
    key = key[edge]
    return (key >> np.uint64(50)).astype(np.int64), (key & np.uint64((1 << 50) - 1)).astype(np.int64), count


def counted_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of each text: text number, code, count, sorted by text and code."""
    parts, owner = cut_texts(texts)
    if len(parts) == len(texts):
        return _counted(texts)
    found = [(owner[at + text], code, count) for at, run in pieces(parts) for text, code, count in [_counted(run)]]
    text, code, count = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((code, text))
    text, code, count = text[order], code[order], count[order]
    edge = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(code, prepend=-1) != 0))
    return text[edge], code[edge], np.add.reduceat(count, edge) if len(edge) else count


def ranked_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The up to PROFILE most frequent n-grams of each text: text number, code, rank from 0."""
    text, code, count = counted_grams(texts)
    order = np.lexsort((-count, text))
    text, code = text[order], code[order]
    first = np.searchsorted(text, np.arange(len(texts)))
    rank = np.arange(len(text)) - first[text]
    top = rank < PROFILE
    return text[top], code[top], rank[top]


@dataclass
class Profiles:
    names: list[str]
    ranks: np.ndarray


def _profile(texts: list[str | None]) -> np.ndarray:
    """The codes of the most frequent n-grams of all texts together, most frequent first, counted piece by piece."""
    codes, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for _, part in pieces(texts, max_chars=500_000):
        _, code, count = counted_grams(part)
        codes, at = np.unique(np.concatenate((codes, code)), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate((counts, count)), minlength=len(codes)).astype(np.int64)
    return codes[np.lexsort((codes, -counts))[:PROFILE]]


def fit(texts: list[str | None], langs: list[str]) -> Profiles:
    """One profile for each language, from all its texts together."""
    names = sorted(set(langs))
    found = [_profile([t for t, x in zip(texts, langs) if x == name]) for name in names]
    used = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
    ranks = np.full((len(names), len(used)), PROFILE)
    for row, code in zip(ranks, found):
        row[np.searchsorted(used, code)] = np.arange(len(code))
    return Profiles(names, np.vstack([used, ranks]))


class Identifier:
    def __init__(self, profiles: Profiles):
        self.names = profiles.names
        self.codes = profiles.ranks[0]
        absent = np.full((len(self.names), 1), PROFILE)
        self.ranks = np.hstack([absent, profiles.ranks[1:]])

    def __call__(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        letters = np.array([has_letter(t) for t in texts])
        if not len(self.codes) or not letters.any():
            return ["und"] * len(texts), np.zeros(len(texts))
        text, code, rank = ranked_grams(texts)
        near = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        at = np.where(self.codes[near] == code, near + 1, 0)
        size = np.maximum(1, np.bincount(text, minlength=len(texts)))
        distance = np.array([np.bincount(text, weights=np.where(r[at] < PROFILE, np.abs(r[at] - rank), PROFILE), minlength=len(texts)) for r in self.ranks])
        distance /= size * PROFILE
        best = distance.argmin(axis=0)
        closeness = np.exp(-20.0 * (distance - distance.min(axis=0)))
        score = np.where(letters, 1.0 / closeness.sum(axis=0), 0.0)
        return [self.names[b] if h else "und" for b, h in zip(best, letters)], score


def training_rows(docs: DataFrame, max_rows: int = MAX_TRAINING_ROWS, max_bytes: int = MAX_TRAINING_BYTES) -> DataFrame:
    """text, lang of a bounded sample of the rows with a language outside the held-out fold."""
    known = docs.where("lang is not null and text is not null").where(hash_fold(F.col("doc_id"), 4) != 2)
    return training_sample(known, "lang", max_rows, max_bytes)


def fit_rows(rows: DataFrame) -> Profiles:
    got = rows.toPandas()
    return fit(list(got["text"]), list(got["lang"]))


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """docs with lang_pred and score instead of the text; all other columns are kept."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    kept = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    docs = plain_names(docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Identifier(shared.value)
        for batch in batches:
            names, scores = [], []
            for first in range(0, batch.num_rows, 256):
                for _, part in pieces(batch.column(len(kept)).slice(first, 256).to_pylist()):
                    lang, score = known(part)
                    names += lang
                    scores.append(score)
            found = [pa.array(names, type=pa.string()), pa.array(np.concatenate(scores) if scores else [], type=pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *found], names=[*batch.schema.names[: len(kept)], "lang_pred", "score"])

    schema = docs.select(*docs.columns[:-1], F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    for name in ("lang_pred", "score"):
        schema[name].nullable = True
    return docs.mapInArrow(run, schema).toDF(*kept, "lang_pred", "score")
