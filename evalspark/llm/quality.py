"""Quality scores from compressed sizes under a dictionary of good and one of bad text.

Zstandard dictionaries are trained from blocks of good and of bad labelled texts. A text is cut into
blocks, each is compressed with either dictionary, and the normalised difference
(bad - good) / (bad + good) of the sizes says which kind of text it resembles. A logistic fit turns
the differences of the whole text and of its most extreme blocks, with the plain compression ratio,
into a calibrated probability. It is fitted on features of rows that took no part in the dictionaries they are measured with, fold by fold;
the dictionaries that are kept come from all labelled rows of the sample.

Null and empty texts count as one empty block. Without labels, or with labels of one class only,
every text gets the smoothed share of that class (0.5 without labels). Equal texts and repeated rows get equal scores. An empty table gives no
rows. A column named as the output is replaced, others are kept. Texts of any length are scored whole, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import hash_fold, plain_names, training_sample
from evalspark.llm.models import fit_logistic, logistic

BLOCK_BYTES, LEVEL, DICTIONARY_BYTES = 2048, 3, 65536
#: At most so many labelled rows, and bytes of their texts, are collected to fit the model; all of them train the dictionaries.
MAX_TRAINING_ROWS, MAX_TRAINING_BYTES = 6000, 64 << 20


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    calibration: np.ndarray


def _blocks(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)] or [b""]


def _dictionary(texts: list[str | None]) -> bytes:
    blocks, size = [], 0
    for text in texts:
        for block in _blocks(text):
            half = len(block) // 2
            blocks += [x for x in (block[:half], block[half:]) if len(x) >= 8]
            size += len(block)
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, size // 4)), blocks).as_bytes()
    except zstandard.ZstdError:  # too few samples to choose from: they are the dictionary themselves
        return b"".join(blocks)[-DICTIONARY_BYTES:]


class Sizes:
    """Compression features of texts under the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.compressors = [zstandard.ZstdCompressor(level=LEVEL)]
        for data in (good, bad):
            known = zstandard.ZstdCompressionDict(data) if data else None
            if known:
                known.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known))

    def features(self, text: str | None) -> list[float]:
        blocks = _blocks(text)
        plain, good, bad = (np.array([len(c.compress(b)) for b in blocks], dtype=float) for c in self.compressors)
        each = (bad - good) / (bad + good)
        total = (bad.sum() - good.sum()) / (bad.sum() + good.sum())
        length = sum(map(len, blocks))
        return [10 * total, 10 * each.min(), 10 * each.max(), plain.sum() / (length + 16), good.sum() / (length + 16), np.log1p(length) / 4]


def fit(texts: list[str | None], quality: np.ndarray) -> QualityModel:
    """Dictionaries from two thirds of the rows, features of the last third, in turn:
    three folds give out-of-fold features, and the dictionaries that are kept come from all rows."""
    quality = np.asarray(quality, dtype=float)
    if not len(texts):
        return QualityModel(b"", b"", np.zeros(7))
    fold = np.arange(len(texts)) % 3

    def of(keep: np.ndarray) -> tuple[bytes, bytes]:
        return tuple(_dictionary([t for t, k, q in zip(texts, keep, quality) if k and q == label]) for label in (1, 0))

    rows = np.zeros((len(texts), 6))
    for k in range(3):
        if (fold == k).any():
            sizes = Sizes(*of(fold != k))
            rows[fold == k] = [sizes.features(t) for t, f in zip(texts, fold) if f == k]
    return QualityModel(*of(fold >= 0), fit_logistic(rows, quality, l2=0.1))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, max_bytes: int = MAX_TRAINING_BYTES) -> DataFrame:
    """text, quality of a bounded sample of the labelled rows outside the held-out fold; of labels that differ for an id the larger counts."""
    known = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").where(hash_fold(F.col("doc_id"), 4) != 2)
    # Twice as many ids as rows, as labels may be of ids that have no document.
    few = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).withColumn("_k", F.xxhash64("doc_id")).orderBy("_k", "doc_id").limit(2 * max_rows).drop("_k")
    return training_sample(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id"), "quality", max_rows, max_bytes)


def fit_rows(rows: DataFrame) -> QualityModel:
    got = rows.toPandas()
    return fit([t if isinstance(t, str) else None for t in got["text"]], got["quality"].to_numpy(dtype=float))


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the column out, the probability that the text is of good quality; all other columns are kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != out]
    docs = plain_names(docs.select(*[F.col(f"`{c}`") for c in kept]))
    place = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        sizes = Sizes(model.good, model.bad)
        for batch in batches:
            x = np.array([sizes.features(t.as_py()) for t in batch.column(place)]).reshape(-1, 6)
            score = logistic(x @ model.calibration[:-1] + model.calibration[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, type=pa.float64())], names=[*batch.schema.names, out])

    schema = docs.select("*", F.lit(0.0).alias(out)).schema
    schema[out].nullable = True
    return docs.mapInArrow(run, schema).toDF(*kept, out)
