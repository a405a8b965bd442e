"""SimHash near-copies, Merkle manifests and conversation repair against plain versions."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pytest
import xxhash

from evalspark.llm import conversations, merkle, queries, simhash
from tests.llm import plain

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, tree string, idx int, rep long, component_id string"
LONG = " ".join(f"w{i % 97}x{i}" for i in range(200_000))
BASE = [f"word{i}" for i in range(400)]


def docs_of(spark, rows):
    """Documents (doc_id, text, lang, source, n_chars) beside columns with names that the operators use."""
    return spark.createDataFrame([(*r, "x", "y", 3, 4, "z") for r in rows], DOCS)


# --- SimHash


def plain_fingerprint(text):
    words = plain.words(text)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(links, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_links(prints):
    values = np.array([f for _, f in prints], dtype=np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(values[:, None] ^ values[None, :]) <= 2, 1))
    return [(prints[a][0], prints[b][0]) for a, b in near]


TEXTS = [None, "", " \t", "a", "A", "b c", "É é É x", LONG, LONG + " end", " ".join(BASE), " ".join(BASE).upper(), " ".join(BASE[:-1]), " ".join(BASE[:200] + ["odd"] + BASE[201:]), "\x85 \xa0 x"]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("part", [16, 1 << 20])
def test_fingerprint(monkeypatch, text, part):
    monkeypatch.setattr(simhash, "PART", part)
    monkeypatch.setattr(simhash, "HASHES", 1000 if part == 16 else 1 << 15)
    assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def near_family(seed, k, base, width=64):
    """k fingerprints in a random walk of few bits around base."""
    draw, found = random.Random(seed), [base]
    while len(found) < k:
        found.append(draw.choice(found[-20:]) ^ 1 << draw.randrange(width) ^ (draw.random() < 0.6) << draw.randrange(width))
    return list(dict.fromkeys(found))


@pytest.mark.parametrize("hot,direct", [(4096, 64), (4096, 2), (3, 64), (3, 2)])
def test_links_of_fingerprints(spark, monkeypatch, hot, direct):
    """Pairs at all distances, families, and values that share a segment, by whole or twice cut keys, in pairs or by wild bits."""
    monkeypatch.setattr(simhash, "DIRECT", direct)
    draw = random.Random(5)
    prints = near_family(1, 150, 0x0123456789ABCDEF) + near_family(2, 60, 7 << 40, 32) + [draw.getrandbits(64) for _ in range(30)]
    prints += [x ^ 1 << a ^ 1 << b for x in (draw.getrandbits(64),) for a, b in ((0, 1), (0, 63), (31, 32), (40, 50), (2, 2))]
    prints += [draw.getrandbits(32) << 32 | 0xABCD for _ in range(40)] + [0xFFFF << 48 | draw.getrandbits(5) << draw.choice([0, 16, 32]) for _ in range(40)]
    prints = list(enumerate(dict.fromkeys(prints)))
    heads = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for i, f in prints], "fp long, rep long")
    links = [(r["a"], r["b"]) for r in simhash.links(heads, hot).collect()]
    values = dict(prints)
    assert all((values[a] ^ values[b]).bit_count() <= 2 for a, b in links)
    ids = [i for i, _ in prints]
    assert plain_components(links, ids) == plain_components(near_links(prints), ids)


@pytest.mark.parametrize("which", ["odd", "empty", "given"])
def test_near_copies(spark, which):
    rows = [(i, t, "en", None, 1) for i, t in enumerate(TEXTS)]
    rows += rows[-1:] + [(None, "a", None, None, None), (3, "b c d e", None, None, None), (100, "b c d e", None, None, None)]
    df = {"odd": lambda: docs_of(spark, rows), "empty": lambda: docs_of(spark, rows).limit(0), "given": lambda: spark.read.parquet(f"{plain.SF}/documents.parquet")}[which]()
    texts = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    prints = [(i, plain_fingerprint(t)) for i, t in texts]
    named = [x for x in prints if x[0] is not None]
    top = plain_components(near_links(named), {i for i, _ in named}) | {None: None}
    got = simhash.near_copies(df).selectExpr("doc_id", "lower(lpad(hex(fp), 16, '0')) f", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, f"{f:016x}", top[i]) for i, f in prints), key=str)
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(i for i, _ in named if top[i] == i)


# --- Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*map(one, (doc_id, source, lang, n_chars, text)))


def layers(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([h(*found[-1][k : k + 2]) for k in range(0, len(found[-1]), 2)])
    return found


def steps(found, k):
    """Siblings of place k, level by level, and a function that folds a node with them."""
    out = []
    for level in found[:-1]:
        run = level[k - k % 2 : k - k % 2 + 2]
        out.append((k % 2, [x for j, x in enumerate(run) if j != k % 2]))
        k //= 2
    return out


def plain_manifest(rows):
    """doc_id, leaf, subroot, root, proof, folded root of (doc_id, text, lang, source, n_chars)."""
    trees = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        bad = doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        node = leaf_of(doc_id, source, lang, n_chars, text)
        trees[lang].append((doc_id is not None, doc_id or 0, node, doc_id, leaf_of(doc_id, source, lang, n_chars + 1, text) if bad else node))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {x: layers([t[2] for t in sorted(trees[x])]) for x in langs}
    top, out = layers([built[x][-1][0] for x in langs]) if langs else [], []
    for j, lang in enumerate(langs):
        for k, (_, _, node, doc_id, other) in enumerate(sorted(trees[lang])):
            path, folded = steps(built[lang], k) + steps(top, j), other
            for right, siblings in path:
                folded = h(*siblings, folded) if right else h(folded, *siblings)
            out.append((doc_id, node, built[lang][-1][0], top[-1][0], h(*(s for _, x in path for s in x)), folded, folded == top[-1][0]))
    return out


MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("which", ["odd", "one", "empty", "given"])
@pytest.mark.parametrize("height,each", [(merkle.HEIGHT, merkle.NODES), (2, 40)])
def test_manifest(spark, which, height, each):
    langs = [None, "", "en", "é", "z", "en", "en", "😀", "￮"]
    odd = [(i * 3, t, langs[i % 9], None if i % 4 else "s", None if i % 3 else i) for i, t in enumerate([None, "", "x", "é"] * 30)]
    odd += odd[-2:] + [(None, "x", "en", "s", 5), (None, None, None, None, None), (9, LONG, "en", "s", 2**63 - 1)] + [(9, f"t{k}", "en", "s", 2) for k in range(5)]
    rows = {"odd": odd, "one": odd[2:3], "empty": [], "given": None}[which]
    df = spark.read.parquet(f"{plain.SF}/documents.parquet") if rows is None else docs_of(spark, odd).limit(0) if not rows else docs_of(spark, rows)
    rows = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in df.collect()]
    got = merkle.checked(merkle.manifest(df, height, each))
    assert got.columns == MANIFEST
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_manifest(rows), key=str)


@pytest.mark.parametrize("few", [True, False])
def test_many_leaves_and_shuffled_joins(spark, monkeypatch, few):
    """Thousands of short rows of one language in several tasks; witnesses and places by broadcasts or by shuffles."""
    if not few:
        monkeypatch.setattr(merkle, "BROADCAST_NODES", 0)
        monkeypatch.setattr(merkle, "BROADCAST_RUNS", 0)
    rows = [(i, "t", "en" if i % 50 else f"l{i}", "s", i) for i in range(5000)]
    got = merkle.checked(merkle.manifest(docs_of(spark, rows).repartition(4), 4, 200)).collect()
    assert sorted(map(tuple, got)) == sorted(plain_manifest(rows))


def test_manifest_query(spark):
    rows = queries.op12_manifest(spark, plain.SF).collect()
    assert {r["verified"] for r in rows} == {True, False}
    assert all(r["verified"] != (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0) for r in rows)


# --- Conversation repair

CONVERSATIONS = "conv_id long, turn long, role string, text string, copies string, fault int, _same int"


def plain_damage(rows):
    """The rows after damage, by conversation; all conversations have an entry."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        found[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, x in found.items()}


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Least (cost, audit, repaired rows): a search from the start, one edit after the other, with the audits themselves."""
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, k, initials, out = heapq.heappop(heap)
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, out
        if (k, initials[-1:], audit) in done:
            continue
        done.add((k, initials[-1:], audit))

        def go(more, edit, step, row=None):
            after = initials + (row[0][:1] or "-" if row else "")
            if re.fullmatch("(s?(ua)*u?)?", after):
                heapq.heappush(heap, (cost + more, audit + edit, k + step, after, (*out, row) if row else out))

        for role in ("user", "assistant"):
            if audit[-3:] != "III":
                go(3, "I", 0, (role, ""))
        if k < len(rows):
            go(4, "D", 1)
            if faults[k] not in ("blank", "duplicate"):
                _, own, text = rows[k]
                cut = 3 * (faults[k] == "truncated")
                go(cut, "K", 1, (own, text))
                go(cut + 3, "R", 1, ("user", text))
                go(cut + 3, "R", 1, ("assistant", text))


def plain_report(conv, rows):
    faults = plain_faults(rows)
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    cost, audit, out = cheapest(rows, faults)
    text = "\n".join(f"{r}:{t}" for r, t in out)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def made_up(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], CONVERSATIONS)


def reported(df, **more):
    return sorted(map(tuple, conversations.repair(conversations.damaged(df), **more).collect()), key=str)


def test_repair_of_given_conversations(spark):
    df = spark.read.parquet(f"{plain.SF}/conversations.parquet")
    rows = plain_damage([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    got = sorted(map(tuple, queries.op13_repair(spark, plain.SF).collect()), key=str)
    assert got == sorted((plain_report(c, x) for c, x in rows.items()), key=str)


@pytest.mark.parametrize("spill,batch", [(1 << 18, 1000), (3, 2)])
def test_repair_of_odd_conversations(spark, monkeypatch, spill, batch):
    """Nulls anywhere, roles that are none, gaps, repeated turns and rows, ties; pointers in a file, a conversation over many batches."""
    monkeypatch.setattr(conversations, "TEXT_ROWS", batch)
    draw, rows = random.Random(3), []
    for conv in [None, *range(150)]:
        for _ in range(draw.randrange(1, 7)):
            role = draw.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "unknown"])
            rows.append((conv, draw.choice([None, *range(8)]), role, draw.choice(["Yes.", "No", "", " \n", "Why?  \n", "x\x85", "é!", None, "One. two"])))
    rows += rows[:40]
    got = reported(made_up(spark, rows), spill=spill)
    assert got == sorted((plain_report(c, x) for c, x in plain_damage(rows).items()), key=str)
    assert any(r[7] == "" and r[8] == hashlib.sha256(b"").hexdigest() for r in got)
    assert reported(made_up(spark, rows).limit(0)) == []


def test_repaired_rows_are_those_of_the_report(spark):
    rows = conversations.damaged(spark.read.parquet(f"{plain.SF}/conversations.parquet"))
    report = conversations.repair(rows)
    found = defaultdict(list)
    for r in conversations.repaired(rows, report).orderBy("conv_id", "place").collect():
        found[r["conv_id"]].append(f"{r['role']}:{r['text']}")
        assert r["place"] == len(found[r["conv_id"]])
    for r in report.collect():
        assert hashlib.sha256("\n".join(found[r["conv_id"]]).encode()).hexdigest() == r["repaired_sha256"]


def test_audits_against_all_edits():
    """Every role and fault of up to three rows, against all edits with up to two inserts anywhere."""
    texts = {"": "Yes{}.", "truncated": "No{}", "blank": " "}
    insert = ["", "u", "a", "uu", "ua", "au", "aa"]
    for n in (0, 1, 2):
        for kinds in product(product("suat", texts), repeat=n):
            rows = [(k, {"s": "system", "u": "user", "a": "assistant", "t": "tool"}[r], texts[f].format(k)) for k, (r, f) in enumerate(kinds)]
            best = None
            for between in product(insert, repeat=n + 1):
                for edits in product("KuaD", repeat=n):
                    cost, audit, made = 3 * sum(map(len, between)), "I" * len(between[0]), between[0]
                    for (r, f), e, more in zip(kinds, edits, between[1:]):
                        cost += (4 if e == "D" else 3 * (e != "K") + 3 * (f == "truncated")) + (1000 if f == "blank" and e != "D" else 0)
                        audit += {"K": "K", "D": "D"}.get(e, "R") + "I" * len(more)
                        made += {"K": r, "D": ""}.get(e, e) + more
                    if re.fullmatch("(s?(ua)+)?", made) and (best is None or (cost, audit) < best):
                        best = cost, audit
            state = conversations.Repair(0)
            for (turn, role, text), (_, f) in zip(rows, kinds):
                state.row(turn, role, text, {"": 0, "blank": 1, "truncated": 3}[f])
            assert state.report()[6:8] == best


def test_a_long_conversation_takes_few_pointers_in_memory():
    state = conversations.Repair(1, spill=1000)
    for k in range(50_000):
        state.row(k, "user" if k % 3 else "assistant", f"t{k}.", 0)
        assert len(state.pointers.now) < 1000
    audit = state.report()[7]
    assert len(audit.replace("I", "")) == 50_000
