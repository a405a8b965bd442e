"""Token ids in Parquet list columns, laid out for selective reads.

Layout: one table in ascending doc_id order (NULL ids first, then by text), range-partitioned into
files; within a file, row groups of ROW_GROUP_BYTES with dictionary or delta encoding, page indexes
and the columns row (the place in the order, with the file in its upper bits), doc_id, n_tokens, ids. A reader that wants some documents' lengths touches
the small columns only; one that wants some documents' ids skips row groups and pages by the doc_id
statistics. starts() adds the number of ids before each document from the per-file totals.

Encoding remembers the ids of white-space-separated pieces in a bounded cache: the tokenizer drops
white space and never joins over it, so a text's ids are those of its pieces in a row. Texts with
the control characters below, or the brackets of special tokens, are encoded whole, as are all texts by a tokenizer
whose file doesn't say that it works so. Long texts are cut at white space for the work arrays.

Null and empty texts have only the end id. Repeated rows are encoded each; extra columns are
dropped from the files. An empty table gives files without rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.llm.common import LONG_TEXT, cut_texts, pieces, word_places

END_ID = 1
ROW_GROUP_BYTES, PAGE_BYTES = 8 << 20, 64 << 10
#: At most about so many pieces of text are kept in a worker.
MAX_PIECES = 600_000
#: Texts with one of these are encoded whole: separators that only some take for white space, and special tokens.
_WHOLE = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
_MARKS = ".,!?;:"
IDS_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def parted_by_blanks(spec: dict) -> bool:
    """Whether a tokenizer, as its file describes it, lowers letters, ends words with a mark and drops white space without ever joining over it."""
    steps = lambda part, names: (spec.get(part) or {}).get(names) or [spec.get(part) or {}]
    normal = [x.get("type") for x in steps("normalizer", "normalizers")]
    before = steps("pre_tokenizer", "pretokenizers")
    split = before[0]
    drops = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and "[^\\s" in split.get("pattern", {}).get("Regex", "")
    rest = all(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") for x in before[1:])
    model = spec.get("model", {})
    return bool(drops and rest and "Lowercase" in normal and set(normal) <= {"NFC", "Replace", "Lowercase"} and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>")


class Encoder:
    """Encodes lists of texts; keeps the ids of the white-space-separated pieces that it has seen.

    Pieces are found by their hashes, A-Z lowered as the tokenizer does. A new piece that is a word of letters, lowered and normalised too, and
    marks after it is encoded as the two, for the tokenizer cuts there; new words are encoded many
    at a time, their ids told apart by the ends of words.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        with open(tokenizer_file, encoding="utf-8") as file:
            self.by_pieces = parted_by_blanks(json.load(file))
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.word_end = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.word_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.letters: set[str] = set()
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.hashes, self.places = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.starts, self.lengths = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int32)

    def _store(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Keeps lists of ids, laid end to end, and returns their places."""
        base = len(self.starts)
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lengths) - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.flat = np.concatenate((self.flat, ids))
        return np.arange(base, base + len(lengths))

    def _gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at the places, end to end, and their running totals."""
        lengths = self.lengths[places]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[places] - (ends - lengths), lengths) + np.arange(total)], ends

    def _encode_each(self, pieces: list[str]) -> np.ndarray:
        got = [e.ids for i in range(0, len(pieces), 5000) for e in self.tokenizer.encode_batch(pieces[i : i + 5000], add_special_tokens=False)]
        return self._store(np.array(list(chain.from_iterable(got)), dtype=np.int32), np.array([len(g) for g in got], dtype=np.int64))

    def _learn_words(self, words: list[str]) -> None:
        """Words of letters, or runs of marks."""
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype=np.int32)
            ends = np.flatnonzero(self.word_end[ids]) + 1
            # A tokenizer that doesn't mark the ends of words gets them one by one.
            places = self._store(ids, np.diff(ends, prepend=0)) if len(ends) == len(part) else self._encode_each(part)
            self.words.update(zip(part, places.tolist()))

    def _letters(self, core: str) -> bool:
        """Whether the tokenizer sees letters only: lower-casing and normalising may leave a mark at the end, which goes with what follows."""
        return core.isalpha() and (core.isascii() or self.letters.issuperset(core) or self._seen(core))

    def _seen(self, core: str) -> bool:
        """Looks at new letters one by one: letters that stay letters by themselves do so together."""
        self.letters |= {c for c in core if self.tokenizer.normalizer.normalize_str(c).isalpha()}
        return self.letters.issuperset(core)

    def _learn(self, pieces: list[str]) -> np.ndarray:
        cores = [p if p.isalpha() else p.rstrip(_MARKS) for p in pieces]
        letters = list(map(self._letters, cores))
        plain = np.array(letters, dtype=bool)
        tails = ["" if len(p) == len(c) else p[len(c) :] for p, c in zip(pieces, cores)]
        words = list(compress(cores, letters))
        self._learn_words([x for x in {*words, *compress(tails, letters)} if x and x not in self.words])
        places = np.full(len(pieces), -1)
        places[plain] = list(map(self.words.__getitem__, words))
        marked = np.flatnonzero(plain & np.array([bool(t) for t in tails], dtype=bool))
        if len(marked):
            pairs = np.column_stack((places[marked], [self.words[tails[i]] for i in marked])).ravel()
            ids, ends = self._gather(pairs)
            places[marked] = self._store(ids, np.diff(ends[1::2], prepend=0))
        odd = np.flatnonzero(~plain)
        if len(odd):
            places[odd] = self._encode_each([pieces[i] for i in odd])
        return places

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, end to end, and the number of ids of each."""
        if len(self.starts) > MAX_PIECES:
            self._forget()
        buffer, starts, ends, hashes, counts = word_places(texts)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), dtype=bool) if not len(self.hashes) else self.hashes[np.minimum(at, len(self.hashes) - 1)] != distinct
        if new.any():
            data, place = buffer.tobytes(), first[new]
            learnt = self._learn([data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts[place].tolist(), ends[place].tolist())])
            self.hashes, self.places = np.concatenate((self.hashes, distinct[new])), np.concatenate((self.places, learnt))
            order = np.argsort(self.hashes, kind="stable")
            self.hashes, self.places = self.hashes[order], self.places[order]
            at = np.searchsorted(self.hashes, distinct)
        ids, totals = self._gather(self.places[at][inverse] if len(distinct) else np.zeros(0, dtype=np.int64))
        sums = np.concatenate(([0], totals))[np.concatenate(([0], np.cumsum(counts)))]
        return ids, np.diff(sums)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, each text closed by END_ID; and the number of ids of each."""
        texts = [t or "" for t in texts]
        whole = [i for i, t in enumerate(texts) if not self.by_pieces or any(x in t for x in _WHOLE)]
        kept = list(texts)
        for i in whole:
            kept[i] = ""
        cut, owner = cut_texts(kept)
        # Large runs, as each that has new pieces sorts all known ones again.
        found = [self._encode(run) for _, run in pieces(cut, max_docs=len(cut) + 1, max_chars=2 * LONG_TEXT)]
        ids = np.concatenate([x for x, _ in found]) if found else np.zeros(0, dtype=np.int32)
        n = np.bincount(owner, weights=np.concatenate([x for _, x in found]), minlength=len(texts)).astype(np.int64) if found else np.zeros(0, dtype=np.int64)
        ends = np.cumsum(n)
        parts = [ids[b - k : b] for b, k in zip(ends, n)]
        for i in whole:
            parts[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, dtype=np.int32)
        end = np.array([END_ID], dtype=np.int32)
        out = [x for p in parts for x in (p, end)]
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int32), np.array([len(p) + 1 for p in parts], dtype=np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(tokenizer_file: str) -> Encoder:
    """This process's encoder for a file: tasks that follow each other in a worker share what it has learnt."""
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = Encoder(tokenizer_file)
    return _encoders[tokenizer_file]


def encode(docs: DataFrame, tokenizer_file: str, partitions: int) -> DataFrame:
    """doc_id, n_tokens, ids of every row, sorted by doc_id within range partitions."""
    rows = docs.select("doc_id", "text").repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer_file)
        for batch in batches:
            for at in range(0, batch.num_rows, 300):
                part = batch.slice(at, 300)
                ids, n = known(part.column(1).to_pylist())
                offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, type=pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), lists], names=["doc_id", "n_tokens", "ids"])

    return rows.mapInArrow(run, IDS_SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str | None = None, partitions: int | None = None) -> None:
    """Encodes docs and writes them to path in the layout that the module describes."""
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    coded = encode(docs, tokenizer_file or default_tokenizer(), partitions).withColumn("row", F.monotonically_increasing_id())
    (
        coded.select("row", "doc_id", "n_tokens", "ids")
        .write.option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "true")
        .option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType([T.StructField("row", T.LongType()), *IDS_SCHEMA.fields])).parquet(path)


def read_documents(spark: SparkSession, path: str, low: int, high: int, ids: bool = True) -> DataFrame:
    """The documents with low <= doc_id <= high: whole files, row groups and pages of others are skipped by their statistics, ids too if they aren't asked for."""
    rows = read_tokens(spark, path).where((F.col("doc_id") >= low) & (F.col("doc_id") <= high))
    return rows if ids else rows.drop("ids")


def starts(tokens: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """tokens with start: the ids of all documents before. Only the per-file totals meet in one task; lengths: where row and n_tokens of all are cheaper to read."""
    tokens = tokens.withColumn("part", F.shiftright("row", 33))
    totals = (tokens if lengths is None else lengths).groupBy(F.shiftright("row", 33).alias("part")).agg(F.sum("n_tokens").alias("_n"))
    before = totals.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    return tokens.join(F.broadcast(before), "part").withColumn("start", F.col("_before") + within).drop("_before")


def id_checksums(tokens: DataFrame) -> DataFrame:
    """row, doc_id, n_tokens and the unsigned crc32 of each document's ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(np.concatenate(([0], ends[:-1])).astype(int), ends.astype(int))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, type=pa.int64())], names=["row", "doc_id", "n_tokens", "_crc"])

    return tokens.select("row", "doc_id", "n_tokens", "ids").mapInArrow(run, "row long, doc_id long, n_tokens long, _crc long")
