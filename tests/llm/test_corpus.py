import base64
import gzip
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalspark.llm import boilerplate, common, decontaminate, exact_dedup, language, mixing, ngram_join, quality, queries, tokens, toxicity, warc
from tests.llm import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, label string, bucket int, keep_id long"
LONG = " ".join(f"w{i % 97}x{i}" for i in range(30_000))
BASE = " ".join(f"word{i}" for i in range(60))
ODD_TEXTS = [None, "", " \t\n", "...", "a", "A b", "x\x85y z", BASE, BASE.upper(), BASE + " tail", BASE.replace("word30", "other"), LONG, LONG, "É é é ﬁ 😀 İ", "  " + BASE]


def docs_of(spark, texts, lang="en"):
    """Documents with odd extra columns; the last row repeats the one before it, and one row has no id."""
    rows = [(i, t, lang, f"s{i % 3}" if i % 7 else None, 0, "x", "y", "z", 1, 5) for i, t in enumerate(texts)]
    rows += rows[-1:] + [(None, "no id at all", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def given_docs(spark):
    return spark.read.parquet(f"{plain.SF}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_shingle_sets():
    texts = [t or "" for t in ODD_TEXTS]
    hashes, sizes = common.shingle_sets(texts)
    assert list(sizes) == [len(plain.shingles(plain.words(t))) for t in texts]
    a, b = (set(h.tolist()) for h in np.split(hashes, np.cumsum(sizes))[7:9])
    assert a == b


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbé \n\x85.", max_size=40), min_size=1, max_size=6))
def test_word_hashes_tell_words_apart(texts):
    hashes, counts = common.word_hashes(texts)
    found = [w for t in texts for w in plain.words(t)]
    assert list(counts) == [len(plain.words(t)) for t in texts]
    assert len({(h, w) for h, w in zip(hashes.tolist(), found)}) == len(set(found)) == len(set(hashes.tolist()))


@pytest.mark.parametrize("which", ["odd", "given", "empty"])
def test_exact_dedup(spark, which):
    df = {"odd": lambda: docs_of(spark, ODD_TEXTS), "given": lambda: given_docs(spark), "empty": lambda: docs_of(spark, ODD_TEXTS).limit(0)}[which]()
    groups = defaultdict(list)
    for i, t in pairs(df):
        groups[plain.lower(t)].append(i)
    expected = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            expected[i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in exact_dedup.dedup(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == expected


def test_chunks_make_up_the_text(spark):
    texts = [t or "" for t in ODD_TEXTS] + ["x" * 20_000, "Sentence one. " * 900]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", exact_dedup.chunks(F.col("t")).alias("c")).collect()
    assert all("".join(r["c"]) == r["t"] and all(len(c) <= exact_dedup.MAX_CHUNK for c in r["c"]) for r in got)


def test_chunks_with_one_hash_are_told_apart(spark):
    rows = [(1, "s1", [7, 8], [b"a", b"b"]), (2, "s2", [7, 8], [b"x", b"b"]), (3, "s3", [7, 8], [b"a", b"b"])]
    coded = spark.createDataFrame(rows, "doc_id long, text_sha256 string, hashes array<long>, digests array<binary>")
    got = {r["doc_id"]: (tuple(r["hashes"]), str(r["_ranks"])) for r in exact_dedup.verified_recipes(coded).collect()}
    assert got[1] == got[3] != got[2]


def near(n, edits, seed):
    rng = np.random.default_rng(seed)
    ws = [f"v{i}" for i in range(n)]
    for k in rng.integers(0, n, edits):
        ws[k] = f"e{seed}_{k}"
    return " ".join(ws)


@pytest.mark.parametrize("which", ["odd", "families", "given", "empty"])
@pytest.mark.parametrize("hot", [1, 12])
def test_ngram_join(spark, which, hot):
    family = [near(n, e, 100 * n + 10 * e + k) for n in (40, 80, 90, 100, 300) for e in (0, 1, 2, 4) for k in range(4)] + [near(7, 0, 1), near(6, 0, 1), near(8, 0, 1), "v0 v1 v2 v3 v4"]
    df = {"odd": lambda: docs_of(spark, ODD_TEXTS), "families": lambda: docs_of(spark, family), "given": lambda: given_docs(spark), "empty": lambda: docs_of(spark, ODD_TEXTS).limit(0)}[which]()
    expected = plain.near_components([(i, t) for i, t in dict(pairs(df)).items() if i is not None])
    rows = ngram_join.join_near(df, hot=hot).collect()
    assert len(rows) == df.count()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None} == expected
    assert all(r["component_id"] is None for r in rows if r["doc_id"] is None)


@pytest.mark.parametrize("tile, block, keys", [(2, 3, 1), (2, 1000, 1), (1000, 3, 1_000_000)])
def test_ngram_join_on_either_side_of_its_switches(spark, monkeypatch, tile, block, keys):
    """Near copies whose tiles meet by the join, in one block and in many; documents picked by a broadcast and by a join."""
    monkeypatch.setattr(ngram_join, "SMALL_TILE", tile)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(common, "BROADCAST_KEYS", keys)
    crossed, large = [], ngram_join.large_tile_pairs
    monkeypatch.setattr(ngram_join, "large_tile_pairs", lambda rows, *rest: crossed.append(rows.count()) or large(rows, *rest))
    # Families of texts that are far from the original, so that links between its copies matter.
    family = [near(n, e, 100 * n + 10 * e + k) for n in (60, 80, 100) for e in (0, 3, 4, 5) for k in range(9)]
    df = spark.createDataFrame(list(enumerate(family)), "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_near(df).collect()} == plain.near_components(pairs(df))
    assert (crossed[0] > 0) == (tile == 2)


def test_long_texts_are_cut_without_loss(monkeypatch):
    texts = [LONG, "a b c d e f g h i j k l m n o p", "", "x" * 300 + " y z", "  lead and trail  "]
    whole = common.shingle_sets(texts), common.word_hashes(texts)
    monkeypatch.setattr(common, "LONG_TEXT", 10)
    monkeypatch.setattr(common.cuts, "__defaults__", (10,))
    parts, owner = common.cut_texts(texts)
    assert len(parts) > 1000 and ["".join(p for p, o in zip(parts, owner) if o == i) for i in range(len(texts))] == texts
    again = common.shingle_sets(texts), common.word_hashes(texts)
    assert all((x == y).all() for a, b in zip(whole, again) for x, y in zip(a, b))


def test_shared_folder_is_never_local_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_path(Session(), "x")


def test_ngram_join_of_an_id_with_two_texts(spark):
    df = spark.createDataFrame([(5, BASE), (5, LONG), (3, BASE), (9, LONG), (7, "alone here")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.join_near(df).collect()} == {5: 3, 3: 3, 9: 3, 7: 7}


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(0, 400)), st.sets(st.integers(0, 400)))
def test_bitmaps_bound_the_overlap(a, b):
    x, y = (common.mixed(np.array(sorted(s), dtype=np.uint64)) for s in (a, b))
    assert ngram_join.overlap_bound(ngram_join.bitmap(x), ngram_join.bitmap(y), len(a), len(b)) >= len(a & b)


@pytest.mark.parametrize("most", [0, 1, 100])
def test_copies_and_near_copies_do_not_pile_up_in_a_bucket(spark, monkeypatch, most):
    texts = [BASE] * 300 + [near(60, 1, k) for k in range(300)] + [near(90, 2, 1)] * 5
    df = spark.createDataFrame([(1000 - i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    stored, entries = [], ngram_join.entries
    monkeypatch.setattr(ngram_join, "entries", lambda *args: stored.append(entries(*args)) or stored[-1])
    monkeypatch.setattr(ngram_join, "MAX_COPIED", most)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_near(df).collect()}
    assert got == plain.near_components(pairs(df))
    per_token = Counter()
    for r in stored[0].where("bucket >= 0").collect():
        per_token.update(np.frombuffer(r["tokens"], dtype=np.uint64).tolist())
    assert max(per_token.values()) <= 2


def test_buckets_grow_with_the_shingles(spark):
    df = spark.createDataFrame([(1, "a b c d " * 1000), (2, None)], "doc_id long, text string")
    assert ngram_join.bucket_count(df, each=2) == 501 and ngram_join.bucket_count(df.limit(0), each=2) == ngram_join.bucket_count(df) == 64


def test_one_of_each(spark):
    df = docs_of(spark, ODD_TEXTS)
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    expected = {i for i, (_, c) in plain.near_components([(i, t) for i, t in dict(pairs(df)).items() if i is not None]).items() if c == i}
    assert {r["doc_id"] for r in kept.collect()} == expected | {None}


def labelled(spark, n=400):
    rng = np.random.default_rng(5)
    syllables = ["tar", "mo", "len", "sik", "ver", "ban", "dol", "pi", "rus", "gam"]
    rows, labels = [], []
    for i in range(n):
        ws = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            for k in rng.integers(0, 40, 3):
                ws[k] = ("wretchling", "quibbazord")[int(rng.integers(0, 2))]
        rows.append((i, " ".join(ws) + ".", "en", "s", 0))
        labels.append((i, int(i % 3 > 0), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_finds_planted_and_gapped_insults(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit_rows(toxicity.training_rows(docs, labels))
    held = [r for r in toxicity.score_toxicity(docs, model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 80 and sum((r["score"] >= 0.7) == (r["doc_id"] % 5 == 0) for r in held) / len(held) > 0.95
    scorer = toxicity.Scorer(model)
    plain_text = "tarmo lensik ver bandol. gam pirus tar molen"
    clean, gapped, spaced, inserted, *empty = scorer([plain_text, plain_text + " wretch-ling quib*bazord wret.chling", plain_text + " w r e t c h l i n g quibbazord q u i b b a z o r d", plain_text + " wretchxling quibbazxord wretchlinng", "", None])
    assert clean < 0.5 < min(gapped, spaced, inserted) and empty[0] == empty[1] < 0.7


def test_toxicity_covers_long_strings(spark):
    docs, labels = labelled(spark)
    scorer = toxicity.Scorer(toxicity.fit_rows(toxicity.training_rows(docs, labels)))
    calm = "tar mo len sik ver ban dol pi rus gam tarmo lensik verban dolpi rusgam molen sikver bandol pirus gamtar".split()
    clean, chained, spaced = scorer(["-".join(calm), "-".join(calm + ["wretchling", "quibbazord"] + calm), " ".join("".join(calm + ["quibbazord", "wretchling"] + calm))])
    assert clean < 0.5 < min(chained, spaced)


@settings(max_examples=100, deadline=None)
@given(st.integers(3, 400), st.integers(0, 400), st.integers(1, 21))
def test_windows_hold_every_run_of_letters(n, at, k):
    string = "".join(chr(0x4E00 + i) for i in range(n))
    run = string[at : at + k]
    assert any(run in w for w in toxicity.windows(string)) and toxicity.words_of(string) == set(toxicity.windows(string))
    assert all(len(w) <= toxicity.LONGEST for w in toxicity.windows(string))


def test_toxicity_without_labels_and_odd_rows(spark):
    docs, labels = labelled(spark, 30)
    model = toxicity.fit_rows(toxicity.training_rows(docs, labels.limit(0)))
    odd = docs_of(spark, ODD_TEXTS)
    got = toxicity.score_toxicity(odd, model)
    assert {r["score"] for r in got.collect()} == {0.5} and got.count() == odd.count() and set(got.columns) == set(odd.columns)
    assert toxicity.score_toxicity(odd.limit(0), model).count() == 0


def plain_kernel(a, b):
    """Every triple of letters in order, at most SPAN places apart, weighs DECAY to the number of letters skipped; normalised."""

    def features(w):
        w, found = "^" + w, Counter()
        for i in range(len(w)):
            for k in range(i + 2, min(len(w), i + toxicity.SPAN + 1)):
                for j in range(i + 1, k):
                    found[w[i] + w[j] + w[k]] += toxicity.DECAY ** (k - i - 2)
        return found

    x, y = features(a), features(b)
    dot = lambda p, q: sum(v * q[t] for t, v in p.items())
    return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))


def test_kernel_of_one_word_with_another():
    words = ["idiot", "idxiot", "banana", "wretchling", "wretchxlxing", "aaaaaa", "abc", "w" * 40 + "retch"]
    t = toxicity.triples(words)
    for i, a in enumerate(words):
        table = np.zeros(toxicity.LETTERS**3)
        table[t.code[t.word == i]] = t.weight[t.word == i]
        got = toxicity.table_sums(words, table) / t.norm[i]
        assert got == pytest.approx([plain_kernel(a, b) for b in words], abs=1e-9) and got[i] == pytest.approx(1.0, abs=1e-12)
    assert plain_kernel("idxiot", "idiot") > 0.4 > plain_kernel("banana", "idiot")


def test_nystroem_projection_keeps_the_kernel_of_landmarks():
    words = ["idiot", "idxiot", "banana", "wretchling", "tarmo", "lensik"]
    marks = toxicity.Landmarks(words)
    x = marks.project(words)
    assert x @ x.T == pytest.approx(np.array([[plain_kernel(a, b) for b in words] for a in words]), abs=1e-4)
    beta = np.arange(x.shape[1], dtype=float)
    others = ["idiott", "bandana", "pirus"]
    assert toxicity.table_sums(others, marks.table(beta)) == pytest.approx(marks.project(others) @ beta, abs=1e-4)


def test_sentences_make_up_the_text():
    assert toxicity.sentences("One here. Two there! Is v1.2 three?\nFour") == ["One here.", "Two there!", "Is v1.2 three?", "Four"]
    assert toxicity.sentences("") == [] and toxicity.sentences("no end") == ["no end"]


def test_toxicity_of_columns_with_clashing_names_and_conflicting_labels(spark):
    docs, labels = labelled(spark, 60)
    both = labels.union(labels.withColumn("toxic", 1 - F.col("toxic")))
    assert {r["toxic"] for r in toxicity.training_rows(docs, both).collect()} == {1}
    odd = docs_of(spark, ODD_TEXTS)
    got = toxicity.score_toxicity(odd, toxicity.fit_rows(toxicity.training_rows(docs, labels)))
    assert got.columns == [c for c in odd.columns if c != "score"] + ["score"] and got.where("score is null").count() == 0


def test_training_samples_are_bounded(spark):
    rows = spark.createDataFrame([(1, "same", 0)] * 500 + [(1, "same", 1), (2, "x" * 300, 0), (3, "y" * 2000, 1)] + [(i, f"t{i}", 0) for i in range(4, 40)], "doc_id long, text string, label int")
    got = common.training_sample(rows, "label", 20, 16_000).collect()
    assert len(got) == 20 and all(r["label"] == 1 for r in got if r["text"] == "same") and "y" * 2000 not in {r["text"] for r in got}
    assert sum(len(r["text"]) for r in common.training_sample(rows, "label", 1000, 320).collect()) <= 320
    assert common.training_sample(rows.limit(0), "label", 5, 100).count() == 0


def test_quality_scores_are_compressed_sizes():
    """Against sizes compressed one by one, and a calibration worked out again."""
    import zstandard

    rng = np.random.default_rng(8)
    good, bad = (["".join(rng.choice(list(s), 900)) for _ in range(40)] for s in ("etaoin shr", "zqxjkv 0123"))
    texts, y = [t for pair in zip(good, bad) for t in pair], np.array([1, 0] * 40)
    model = quality.fit(texts, y)
    assert model.good != model.bad
    sizes = quality.Sizes(model.good, model.bad)
    for text in (good[0], bad[0] + good[1] * 4, "", "é" * 3000):
        data = text.encode()
        blocks = [data[i : i + quality.BLOCK_BYTES] for i in range(0, len(data), quality.BLOCK_BYTES)] or [b""]
        size = lambda d: np.array([len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=d).compress(b)) for b in blocks], dtype=float)
        g, b = (size(zstandard.ZstdCompressionDict(d)) for d in (model.good, model.bad))
        each = (b - g) / (b + g)
        assert sizes.features(text)[:3] == pytest.approx([10 * (b.sum() - g.sum()) / (b.sum() + g.sum()), 10 * each.min(), 10 * each.max()])
    x = np.array([sizes.features(t) for t in texts])
    score = 1 / (1 + np.exp(-(x @ model.calibration[:-1] + model.calibration[-1])))
    assert (score[y == 1] > 0.7).all() and (score[y == 0] < 0.3).all()


def test_a_large_class_is_read_whole():
    """What stands at the end of a class above eight megabytes changes its dictionary."""
    filler = ["".join(chr(97 + (i * 7 + k * k) % 26) for k in range(2000)) for i in range(10)]
    texts = [filler[i % 10] for i in range(4200)] + ["zyxwv unmistakable tail " * 80] * 400
    assert sum(map(len, texts[:4200])) > 8_000_000 and quality._dictionary(texts) != quality._dictionary(texts[:4200])


def test_quality_on_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op7_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.85
    assert df.count() == queries.op7_quality(spark, "/root/testdata/sf0.01").count()


def test_quality_edge_cases(spark):
    docs, labels = labelled(spark, 30)
    odd = docs_of(spark, ODD_TEXTS)
    none = quality.fit_rows(quality.training_rows(docs, labels.limit(0)))
    assert {r["score"] for r in quality.score_quality(odd, none).collect()} == {0.5}
    single = quality.fit_rows(quality.training_rows(docs, labels.withColumn("quality", F.lit(1))))
    scores = [r["score"] for r in quality.score_quality(odd, single).collect()]
    assert len(scores) == odd.count() and all(0.5 < s <= 1 for s in scores)
    assert quality.score_quality(odd.limit(0), single).count() == 0


def test_language(spark):
    got = queries.op1_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 1000 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edge_cases(spark):
    train = [("the cat sat on the mat", "en"), ("der hund und die katze", "de")]
    profiles = language.fit(*zip(*train))
    odd = docs_of(spark, ODD_TEXTS).drop("lang")
    found = language.identify(odd, profiles)
    got = {r["doc_id"]: r["lang_pred"] for r in found.collect() if r["doc_id"] is not None}
    assert {got[i] for i in (0, 1, 2, 3)} == {"und"} and "und" not in {got[i] for i in (4, 7, 11)}
    assert found.columns == [c for c in odd.columns if c not in ("text", "score")] + ["lang_pred", "score"]
    assert language.Identifier(profiles)(["the mat", "und die"])[0] == ["en", "de"]
    assert {r["lang_pred"] for r in language.identify(odd, language.fit([], [])).collect()} == {"und"}
    assert language.identify(odd.limit(0), profiles).count() == 0
    # Neither halves, numbers nor emoji are letters; letters of any plane are.
    names, scores = language.Identifier(profiles)(["½ ² ①", "😀 1!", "\ue000", "\U00010330\U00010331", "ж", ""])
    assert names[:3] == ["und"] * 3 and "und" not in names[3:5] and names[5] == "und" and list(scores[:3]) == [0, 0, 0]


def test_equal_distances_go_to_the_first_language():
    profiles = language.fit(["aa bb", "aa bb"], ["x", "a"])
    assert language.Identifier(profiles)(["aa", "zz"]) [0] == ["a", "a"]


def plain_grams(text):
    grams = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        padded = f" {w} "
        for n in (1, 2, 3):
            for k in range(len(padded) - n + 1):
                if padded[k : k + n].strip():
                    grams[padded[k : k + n]] += 1
    return grams


def plain_ranks(grams):
    """Most frequent first; of equal ones the smaller code: fewer letters, then letter by letter with the mark between words first."""
    order = sorted(grams, key=lambda g: (-grams[g], len(g), [0 if c == " " else ord(c) for c in g]))
    return {g: k for k, g in enumerate(order[: language.PROFILE])}


def test_language_choice_is_the_least_out_of_place_distance(monkeypatch):
    """Distance, choice and score against a plain count, for whole and for cut texts."""
    train = {"en": "the cat sat on the mat and the dog ran " * 3, "de": "der hund und die katze über größe " * 3, "ru": "кот сидел на ковре и собака бежала " * 3}
    profiles = language.fit(list(train.values()), list(train))
    ranks = {lang: plain_ranks(plain_grams(t)) for lang, t in train.items()}
    texts = ["the dog and die katze", "größe über alles", "собака and cat", "x", ". the", "mat " * 200 + "hund"]
    for size in (common.LONG_TEXT, 12):
        monkeypatch.setattr(common, "LONG_TEXT", size)
        monkeypatch.setattr(common.cuts, "__defaults__", (size,))
        names, scores = language.Identifier(profiles)(texts)
        for text, name, score in zip(texts, names, scores):
            mine = plain_ranks(plain_grams(text))
            distance = {lang: sum(abs(r[g] - k) if g in r else language.PROFILE for g, k in mine.items()) / len(mine) / language.PROFILE for lang, r in ranks.items()}
            best = min(sorted(distance), key=distance.get)
            assert name == best and score == pytest.approx(1 / sum(np.exp(-20 * (d - distance[best])) for d in distance.values()))


PART = "<p>big</p>\r\n\r\n"
BIG_PAGE = PART * 4_000_000


def pages_of(spark):
    rows = [(1, "http://a.b/x", "<p>one</p>", "e"), (2, "http://a.b/y z\r\nX: 1", "<p>one</p>", "e"), (3, None, None, None), (4, "u", "", "e"), (5, "http://A.b/", "x\r\n\r\nWARC/1.1\r\n", "e"), (6, "q", "é" * 5000, "e"), (7, "q", "<p>one</p>", "e"), (None, "q", "lost", "e"), (8, "q", "twice", "e"), (8, "q", "twice", "e")]
    rows += [(9, "q", "aaa", "e"), (9, "q", "bbbbb", "e"), (0, "q", "aaa", "e"), (0, "q", "bbbbb", "e"), (None, "q", "bbbbb", "e"), (None, "q", "lost", "e"), (10, "q", "m" * 70_000, "e"), (11, "q", "m" * 70_000, "e")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def expected_captures(pages, min_bytes=0):
    """Of equal payloads one row with the largest page_id is the response."""
    groups, expected = defaultdict(list), Counter()
    for i, html in pages:
        groups[html or ""].append(i)
    for html, ids in groups.items():
        data = html.encode()
        ids = sorted(ids, key=lambda i: (i is not None, i), reverse=True)
        for k, i in enumerate(ids):
            revisit = k > 0 and len(data) >= min_bytes
            expected[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", ids[0] if revisit else None] += 1
    return expected


def captures(spark, path):
    got = warc.resolved(warc.read_archives(spark, path, payloads=False))
    return Counter(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))


@pytest.mark.parametrize("few", [1, 1_000_000])
def test_warc_round_trip(spark, monkeypatch, few):
    monkeypatch.setattr(warc, "BROADCAST_KEYS", few)
    path = common.shared_path(spark, "warc-test")
    pages = pages_of(spark)
    warc.write_archives(pages, path)
    assert captures(spark, path) == expected_captures([(r["page_id"], r["html"]) for r in pages.collect()])
    whole = {(r["page_id"], r["html"]) for r in warc.read_archives(spark, path).where("record_type = 'response'").collect()}
    assert (7, "<p>one</p>") in whole and (5, "x\r\n\r\nWARC/1.1\r\n") in whole
    assert whole >= {(9, "aaa"), (9, "bbbbb")} and whole <= {(r["page_id"], r["html"] or "") for r in pages.collect()}
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in Path(path).glob("*.gz"))
    names = re.findall(rb"\r\nWARC-Record-ID: (\S+)", raw)
    assert len(names) == len(set(names)) == 18 and raw.endswith(b"\r\n\r\n")


def test_warc_of_a_page_of_60_megabytes(spark):
    path = common.shared_path(spark, "warc-test")
    pages = spark.createDataFrame([(i, "u") for i in range(300)], "page_id long, url string")
    html = F.when(F.col("page_id") % 100 == 7, F.repeat(F.lit(PART), 4_000_000)).otherwise(F.concat(F.lit("p"), F.col("page_id")))
    warc.write_archives(pages.withColumn("html", html).repartition(2), path)
    rows = [(i, BIG_PAGE if i % 100 == 7 else f"p{i}") for i in range(300)]
    assert captures(spark, path) == expected_captures(rows)
    unpacked = [sum(map(len, iter(lambda f=gzip.open(p): f.read(1 << 20), b""))) for p in Path(path).glob("*.gz")]
    assert max(unpacked) < warc.FILE_BYTES and sum(unpacked) > 56_000_000


def test_warc_keeps_small_payloads_and_takes_no_rows(spark):
    path = common.shared_path(spark, "warc-test")
    warc.write_archives(pages_of(spark), path, min_bytes=1000)
    assert captures(spark, path) == expected_captures([(r["page_id"], r["html"]) for r in pages_of(spark).collect()], 1000)
    empty = common.shared_path(spark, "warc-test")
    warc.write_archives(pages_of(spark).limit(0), empty)
    assert warc.resolved(warc.read_archives(spark, empty)).count() == 0


@pytest.mark.parametrize("damage", [lambda x: x.replace(b"aaa", b"aba"), lambda x: x.replace(b"Content-Length: 3\r\n", b"Content-Length: 3\r\nA: b\r\n")])
def test_damaged_archives_are_refused(spark, damage):
    path = common.shared_path(spark, "warc-test")
    warc.write_archives(pages_of(spark).where("page_id = 9").coalesce(1), path)
    for p in Path(path).glob("*.gz"):
        p.write_bytes(gzip.compress(damage(gzip.decompress(p.read_bytes()))))
    for p in Path(path).glob(".*.crc"):
        p.unlink()
    with pytest.raises(Exception, match="digest|doesn't end|no WARC record"):
        warc.read_archives(spark, path).count()


def test_tokens_round_trip(spark):
    tokenizers = pytest.importorskip("tokenizers")
    texts = ODD_TEXTS + ["It's a <|endoftext|> don't\x1cstop, 3.14!", "word, word. Word; WORD", " nbsp wide"]
    df = docs_of(spark, texts)
    df = df.union(df.where("doc_id = 4").withColumn("text", F.lit("zz other text")))
    path = common.shared_path(spark, "token-test")
    tokens.write_tokens(df, path, partitions=3)
    known = tokenizers.Tokenizer.from_file(tokens.default_tokenizer())
    rows = sorted(pairs(df), key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    at, expected = 0, Counter()
    for i, t in rows:
        ids = np.array(known.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        expected[i, at, len(ids), zlib.crc32(ids.tobytes())] += 1
        at += len(ids)
    report = queries.token_report(spark, path)
    assert Counter(map(tuple, report.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == expected
    empty = common.shared_path(spark, "token-test")
    tokens.write_tokens(df.limit(0), empty)
    assert queries.token_report(spark, empty).count() == 0


def test_token_files_can_be_read_selectively(spark):
    import pyarrow.parquet as pq

    path = common.shared_path(spark, "token-test")
    tokens.write_tokens(given_docs(spark), path, partitions=2)
    meta = pq.ParquetFile(next(iter(sorted(Path(path).glob("part-*.parquet"))))).metadata
    group = meta.row_group(0)
    assert any("DICTIONARY" in e or "DELTA" in e for k in range(group.num_columns) for e in group.column(k).encodings)
    assert all(group.column(k).has_column_index for k in range(2))


def test_documents_can_be_read_by_id(spark):
    path = common.shared_path(spark, "token-test")
    tokens.write_tokens(given_docs(spark), path, partitions=2)
    every = {r["doc_id"]: r["ids"] for r in tokens.read_tokens(spark, path).collect()}
    got = {r["doc_id"]: r["ids"] for r in tokens.read_documents(spark, path, 40, 60).collect()}
    assert got == {i: x for i, x in every.items() if 40 <= i <= 60} and "ids" not in tokens.read_documents(spark, path, 40, 60, ids=False).columns


def test_encoder_forgets_and_still_agrees(monkeypatch):
    known = tokens.Encoder(tokens.default_tokenizer())
    texts = ["alpha beta, gamma. " * 3, "Delta epsilon! beta", "", LONG]
    assert known.by_pieces
    first = known(texts)
    known._forget()
    again = known(texts)
    assert (first[0] == again[0]).all() and (first[1] == again[1]).all()
    monkeypatch.setattr(common, "LONG_TEXT", 1000)
    monkeypatch.setattr(common.cuts, "__defaults__", (1000,))
    cut = known(texts)
    assert (first[0] == cut[0]).all() and (first[1] == cut[1]).all()
    known.by_pieces = False
    whole = known(texts)
    assert (first[0] == whole[0]).all() and (first[1] == whole[1]).all()


def test_other_tokenizers_are_told_from_their_files():
    import json

    spec = json.loads(Path(tokens.default_tokenizer()).read_text())
    assert tokens.parted_by_blanks(spec)
    for part, value in (("normalizer", None), ("pre_tokenizer", {"type": "ByteLevel", "add_prefix_space": False}), ("model", {"type": "Unigram"})):
        assert not tokens.parted_by_blanks(spec | {part: value})


def test_mix(spark):
    df = given_docs(spark)
    got = mixing.mix(df).collect()
    source = {r["doc_id"]: r["source"] for r in df.collect()}
    size = {i: len(plain.words(t)) for i, t in pairs(df)}
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["taken"] <= 3 * r["size"]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
    weights = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(sorted(sizes))}
    expected = plain.fill_targets(sizes, weights)
    assert all(target[s] == pytest.approx(expected[s]) for s in sizes)
    assert all(abs(taken[s] - target[s]) <= 0.03 * target[s] + 2 * mixing.BLOCK for s in sizes)
    assert sorted(map(tuple, mixing.mix(df.repartition(5)).collect())) == sorted(map(tuple, got))


def test_mix_stops_and_odd_rows(spark):
    rows = [(i, "w " * 10, "tiny") for i in range(3)] + [(10 + i, "w " * 500, "vast") for i in range(20)] + [(40, None, None), (41, "", None), (42, "a b c", None), (42, "a b c", None), (None, "x", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    target = {r["source"]: r["target"] for r in got}
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(plain.words(t))
    assert target["tiny"] == 3 * sizes["tiny"] and target[None] == 3 * sizes[None]
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix(df.limit(0)).count() == 0
    kept = mixing.mixed_documents(df)
    assert kept.columns == df.columns and {(r["doc_id"], r["text"]) for r in kept.collect()} <= {(a, b) for a, b, _ in rows}


def test_mixed_documents_deliver_the_targets(spark):
    rng = np.random.default_rng(11)
    rows = [(i, "w " * int(rng.integers(20, 600)), f"s{i % 6}") for i in range(1800)] + [(0, "w " * 300, f"s{k}") for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {r["source"]: r for r in mixing.mix(df).groupBy("source").agg(F.max("target").alias("target"), F.max("source_size").alias("whole"), F.sum(F.when(F.col("size") >= 300, F.col("taken"))).alias("long")).collect()}
    given_, long_ = Counter(), Counter()
    kept = mixing.mixed_documents(df).collect()
    for r in kept:
        n = len(plain.words(r["text"]))
        given_[r["source"]] += n
        long_[r["source"]] += n * (n >= 300)
    assert min(r["target"] / r["whole"] for r in plan.values()) < 0.5
    assert all(abs(given_[s] - r["target"]) <= 2 * 600 + 2 * mixing.BLOCK for s, r in plan.items())
    assert all(abs(long_[s] - r["long"]) <= 4 * 600 for s, r in plan.items())
    assert max(Counter((r["doc_id"], r["source"]) for r in kept if r["doc_id"]).values()) <= mixing.MAX_REPEATS
    assert sorted(map(tuple, mixing.mixed_documents(df.repartition(7)).collect())) == sorted(map(tuple, kept))


def test_taken_words_are_the_overlaps_with_the_chosen_blocks(spark, monkeypatch):
    """taken of every document, from quotas dealt one by one and blocks chosen one by one."""
    monkeypatch.setattr(mixing, "SHARD_TOKENS", 900)
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(0, 150)), f"s{i % 4}" if i % 9 else None) for i in range(160)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by_source = defaultdict(lambda: defaultdict(list))
    for r in got:
        by_source[r["source"]][r["shard"]].append(r)
    sizes = {s: sum(r["size"] for x in shards.values() for r in x) for s, shards in by_source.items()}
    order = sorted(sizes, key=lambda s: (s is None, s))
    names = {s: f"{k:03d}" for k, s in enumerate(order)}
    targets = plain.fill_targets({names[s]: sizes[s] for s in order}, {names[s]: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(order)})
    quotas = plain.sainte_lague(targets, round(sum(targets.values()) / mixing.BLOCK))
    assert len(got) == len(rows) and max(len(x) for x in by_source.values()) > 3
    for s, shards in by_source.items():
        tokens_of = {k: sum(r["size"] for r in x) for k, x in shards.items()}
        quota = plain.sainte_lague({f"{k:04d}": v for k, v in tokens_of.items()}, quotas[names[s]])
        for k, docs in shards.items():
            n = -(-tokens_of[k] // mixing.BLOCK)
            blocks = spark.range(n).select("id", F.xxhash64(F.lit(17 + 2), F.lit(s).cast("string"), F.lit(k).cast("long"), "id").alias("h")).collect()
            ranked = [r["id"] for r in sorted(blocks, key=lambda r: (r["h"], r["id"]))]
            q = min(quota[f"{k:04d}"], 3 * n)
            times = {b: q // n + (place < q % n) for place, b in enumerate(ranked)}
            for r in docs:
                words = range(r["_start"], r["_start"] + r["size"])
                assert r["taken"] == sum(times[w // mixing.BLOCK] for w in words)


def test_apportionment_is_sainte_lague(spark):
    rng = np.random.default_rng(2)
    for case in range(6):
        shares = {f"s{k:02d}": float(x) for k, x in enumerate(rng.integers(1, 10 ** (1 + case % 4), 3 + 5 * case))}
        seats = int(rng.integers(1, 200))
        rows = spark.createDataFrame([(0, s, v, seats, 10**6) for s, v in shares.items()], "g int, source string, share double, seats long, cap long")
        got = {r["source"]: r["out"] for r in mixing.apportioned(rows, ["g"], "share", "seats", "cap", "out").collect()}
        best = plain.sainte_lague(shares, seats)
        assert sum(got.values()) == seats
        # Ties between equal quotients may go either way.
        assert sum(abs(got[s] - best[s]) for s in shares) <= 2


@pytest.mark.parametrize("which", ["given", "edited", "empty"])
def test_decontaminate(spark, which):
    bench = spark.read.parquet(f"{plain.SF}/benchmark.parquet").select("item_id", "text")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    text = items[3][1]
    ws = text.split()
    edits = ["before it " + text.upper() + " after it", " ".join(ws[:-1] + ["changed"]), " ".join(["new"] + ws), " ".join(ws[:5]), "clean words only here " * 5, None, "", " ".join(ws[: len(ws) // 2] + ["inserted"] + ws[len(ws) // 2 :]), text + " " + items[4][1], LONG + " " + text]
    df = {"given": lambda: given_docs(spark), "edited": lambda: docs_of(spark, edits), "empty": lambda: docs_of(spark, edits).limit(0)}[which]()
    expected = plain.leaks([(i, t) for i, t in pairs(df) if i is not None], items)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(df, bench.withColumn("n", F.lit("x"))).collect()}
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k]) for k in got)
    left = decontaminate.decontaminated(df, bench)
    assert left.columns == df.columns and left.count() == df.where(F.coalesce(~F.col("doc_id").isin([k[0] for k in expected] or [-1]), F.lit(True))).count()
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0


def test_fingerprints_vote(spark):
    """Against a count of votes, bit by bit; the windows of items agree with those of texts."""
    ws = [f"w{k % 23}" for k in range(60)]
    df = spark.createDataFrame([(1, ws), (2, ws[:3]), (3, [])], "id int, words array<string>")
    texts = {1: ws, 2: ws[:3]}
    hashes = {1: df.select(F.transform("words", lambda w: F.xxhash64(w)).alias("h")).first()["h"]}
    hashes[2] = hashes[1][:3]

    def voted(i, at, size):
        votes = [sum(h >> b & 1 for h in hashes[i][at : at + size]) for b in range(decontaminate.BITS)]
        return sum(1 << b for b, v in enumerate(votes) if 2 * v > size)

    got = {(r["id"], r["size"], r["start"]): r["print"] for r in decontaminate.windows(df, ["id"], list(decontaminate.SIZES)).collect()}
    assert got == {(1, size, at): voted(1, at, size) for size in decontaminate.SIZES for at in range(0, 60 - size + 1, decontaminate.stride(size))} | {(2, 3, 0): voted(2, 0, 3)}
    for size in (1, 3, *decontaminate.SIZES):
        items = spark.createDataFrame([(i, len(texts[i]), size, texts[i]) for i in texts if len(texts[i]) >= size], "item_id int, n int, size int, words array<string>")
        found = {(r["item_id"], r["start"]): r["print"] for r in decontaminate.item_windows(items).collect()}
        assert found == {(i, at): voted(i, at, size) for i in texts for at in range(len(texts[i]) - size + 1)}


def test_windows_of_long_texts_are_whole(spark):
    for n in (2 * decontaminate.SEGMENT + 40, 2 * decontaminate.SEGMENT, decontaminate.SEGMENT + 1):
        df = spark.createDataFrame([(1, [f"w{k}" for k in range(n)])], "id int, words array<string>")
        got = [(r["size"], r["start"]) for r in decontaminate.windows(df, ["id"], list(decontaminate.SIZES)).select("size", "start").collect()]
        assert sorted(got) == [(s, at) for s in decontaminate.SIZES for at in range(0, n - s + 1, decontaminate.stride(s))]
    assert all(decontaminate.SEGMENT % decontaminate.stride(s) == 0 and s <= 2 << decontaminate.WIDTH - 1 for s in decontaminate.SIZES)


@settings(max_examples=300, deadline=None)
@given(st.integers(5, 150), st.integers(0, 10**6), st.integers(0, 5), st.integers(0, 30))
def test_similar_passages_keep_a_run(n, seed, edits, cut):
    """Edited copies of an item, whole or cut short: the similar ones keep least_run(n) words in a row."""
    rng = np.random.default_rng(seed)
    item = [f"w{k}" for k in range(n)]
    copy = list(item)
    for e in range(edits):
        at, kind = int(rng.integers(0, len(copy))), int(rng.integers(0, 3))
        copy[at : at + 1] = [[f"e{e}"], [], [copy[at], f"e{e}"]][kind]
    copy = copy[int(rng.integers(0, cut + 1)) :][:n]
    a, b = plain.shingles(item), plain.shingles(copy)
    if 4 * len(a & b) >= 3 * len(a | b) and a & b:
        text = " ".join(copy) + " "
        run = decontaminate.least_run(n)
        assert any(" ".join(item[k : k + run]) + " " in text for k in range(n - run + 1))


def test_the_index_finds_all_fingerprints_within_the_radius(spark):
    """Recall 1 of the multi-index against every pair of windows, and of the meetings against the similar windows of the given documents."""
    rng = np.random.default_rng(4)
    prints = [int(x) for x in rng.integers(0, 1 << decontaminate.BITS, 60)]
    near_ = [p ^ sum(1 << int(b) for b in rng.choice(decontaminate.BITS, int(rng.integers(0, 6)), replace=False)) for p in prints]
    left, right = (spark.createDataFrame(list(enumerate(x)), f"{n} int, {n}p long") for n, x in (("a", prints), ("b", near_)))
    cut = lambda df, n: df.select("*", F.inline(decontaminate.blocks(F.col(f"{n}p"))))
    met = cut(left, "a").join(cut(right, "b"), ["block", "value"]).where(F.bit_count(F.col("ap").bitwiseXOR(F.col("bp"))) <= decontaminate.RADIUS)
    expected = {(i, j) for i, p in enumerate(prints) for j, q in enumerate(near_) if bin(p ^ q).count("1") <= decontaminate.RADIUS}
    assert {(r["a"], r["b"]) for r in met.select("a", "b").distinct().collect()} == expected and len(expected) > 20


def test_boilerplate(spark):
    rows = [(i, f"http://www.Site.com/{i}", f"<nav>Home</nav><p>Page {i}</p><br>Shared by few" + ("<p>Rare</p>" if i < 2 else "") + "<script>x<p>no</p></script>", 1) for i in range(10)]
    rows += [(20, "http://other.org/", "<p>Home</p>", 1), (21, None, None, 1), (22, "odd", "", 1), (22, "odd", "", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = {r["page_id"]: r for r in boilerplate.drop_boilerplate(df).collect()}
    assert got[0]["text"] == "Page 0\nRare" and got[5]["text"] == "Page 5" and got[20]["text"] == "Home"
    assert (got[5]["host"], got[5]["host_pages"], got[5]["n_lines"], got[5]["n_dropped"]) == ("www.site.com", 10, 3, 2)
    assert got[21]["n_lines"] == 0 and boilerplate.drop_boilerplate(df).count() == 14
    assert boilerplate.drop_boilerplate(df.limit(0)).count() == 0


def test_boilerplate_at_the_ratio_and_of_long_pages(spark):
    """A line on just MAX_RATIO of the pages stays, one on more goes; hosts of few pages keep all; long pages are read whole."""
    long = "<br>".join(f"line {i}" for i in range(20_000))
    rows = [(i, "http://h.org/a", "<p>own " + str(i) + "</p>" + ("<p>three</p>" if i < 3 else "") + ("<p>four</p>" if i < 4 else "") + (long if i == 9 else "")) for i in range(10)]
    rows += [(20 + i, "http://few.org/", "<p>same</p>") for i in range(boilerplate.MIN_PAGES - 1)]
    got = {r["page_id"]: r for r in boilerplate.drop_boilerplate(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0]["text"] == "own 0\nthree" and got[3]["text"] == "own 3" and got[9]["n_lines"] == 20_001 and got[9]["n_dropped"] == 0
    assert all(got[20 + i]["text"] == "same" for i in range(boilerplate.MIN_PAGES - 1))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    from tests import oracle

    con = oracle.connect(plain.SF)
    assert oracle.rows_of(queries.QUERIES[name](spark, plain.SF)) == oracle.sql_rows(con, queries.ORACLE_SQL[name])


def test_pipeline_stages_on_odd_and_empty_tables(spark):
    import corpus_pipeline

    odd = docs_of(spark, ODD_TEXTS).withColumnRenamed("score", "_toxicity_").withColumn("taken", F.lit("t"))
    for docs in (odd, odd.limit(0)):
        ids = {r["doc_id"] for r in docs.collect()}
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = common.written(stage(spark, docs, plain.SF), "odd-test")
            assert after.columns == docs.columns, name
            kept = {r["doc_id"] for r in after.collect()}
            assert kept <= ids and (name == "mix" or not ids or {None, 0, 1} <= kept), name
            docs = after
        last = corpus_pipeline.STAGES[-1][1](spark, docs, plain.SF)
        assert last.count() == docs.count() and {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(last.columns)


def test_pipeline_rejects_what_the_scorer_scores_high(spark):
    """The toxicity stage against the scorer in memory, the mix against its words."""
    import corpus_pipeline

    docs = given_docs(spark)
    model = toxicity.fit_rows(toxicity.training_rows(docs, spark.read.parquet(f"{plain.SF}/labels.parquet")))
    rows = pairs(docs)
    scores_ = toxicity.Scorer(model)([t for _, t in rows])
    kept = dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, plain.SF)
    assert {r["doc_id"] for r in kept.collect()} == {i for (i, _), s in zip(rows, scores_) if s < 0.7}


def test_pipeline(spark):
    import corpus_pipeline

    docs = given_docs(spark)
    ids = {i for i, _ in pairs(docs)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = common.written(stage(spark, before, plain.SF), "pipeline-test")
        assert docs.columns == given_docs(spark).columns, name
        assert {i for i, _ in pairs(docs)} <= ids
        if name == "ngram_join":
            near_ = plain.near_components(pairs(before))
            assert {i for i, _ in pairs(docs)} == {i for i, (_, c) in near_.items() if i == c}
        if name == "decontaminate":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{plain.SF}/benchmark.parquet").collect()]
            assert {i for i, _ in pairs(docs)} == {i for i, _ in pairs(before)} - {d for d, _ in plain.leaks(pairs(before), items)}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, plain.SF)
    assert last.count() == docs.count() and last.agg(F.max(F.col("start") + F.col("n_tokens")), F.sum("n_tokens")).first()[0] == last.agg(F.sum("n_tokens")).first()[0]
