"""LSH forest, conversation prefix trie and phrase collocations against brute force, with odd rows and forced splits."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from vigilspark.llm import lsh_forest, phrases, prefix_trie

SF = "/root/testdata/sf0.001"
CLASH = "cid string, n string, label string, item string, tree string, word string, chunk string, conv string, place string, bucket string, head string"


def clash(spark, rows, schema):
    """The rows with further columns that bear names operators use themselves."""
    return spark.createDataFrame([(*r, *["x"] * len(CLASH.split(","))) for r in rows], f"{schema}, {CLASH}")


# ------------------------------------------------------------------ LSH forest
def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(w)} if len(w) == 1 else {tuple(w[k : k + 2]) for k in range(len(w) - 1)}


def components_by_search(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        groups[root(k)].append(i)
    out = []
    for k, (i, _) in enumerate(rows):
        low = min((x for x in groups[root(k)] if x is not None), default=None) if sets[k] else i
        out.append((i, len(sets[k]), low, not sets[k] or (i is not None and i == low)))
    return sorted(out, key=str)


def planted():
    rng = np.random.default_rng(8)
    base = [f"u{k}" for k in range(300)]
    rows = [(10_000 + j, " ".join(w if i % 97 != j or j == 0 else f"v{j}" for i, w in enumerate(base))) for j in range(60)]
    rows += [(20_000 + j, " ".join([*base[:200], *(f"x{j}y{k}" for k in range(130))])) for j in range(30)]  # alike, not linked
    chain = [f"c{k}" for k in range(100)]
    for j in range(20):  # each is linked with the next only
        rows.append((30_000 - j, " ".join([f"c{k}" for k in range(5 * j, 100 + 5 * j)])))
    rows += [(40_000 + j, " ".join(rng.choice(chain, 80))) for j in range(20)]
    rows += [(1, None), (2, ""), (3, " \t\n"), (None, None), (4, "One"), (5, "one"), (5, "ONE two"), (6, "É one"), (7, "é one")]
    rows += [(None, "alone without an id here"), (None, "alone without an id here"), (8, "long " * 100_000), (9, "long " * 50_000)]
    return rows


@pytest.mark.parametrize("item", [512, 6])
def test_forest_equals_all_pairs(spark, monkeypatch, item):
    monkeypatch.setattr(lsh_forest, "ITEM", item)
    rows = planted() + [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(map(tuple, lsh_forest.similar(clash(spark, rows, "doc_id long, text string")).collect()), key=str)
    assert got == components_by_search(rows)


def test_forest_of_an_empty_table(spark):
    assert lsh_forest.similar(clash(spark, [], "doc_id long, text string")).count() == 0
    assert [tuple(r) for r in lsh_forest.similar(spark.createDataFrame([(7, None)], "doc_id long, text string")).collect()] == [(7, 0, 7, True)]


def test_signatures_estimate_similarity():
    known, (add, by) = lsh_forest.Hashes(), lsh_forest.salts()
    errors = []
    for k in range(60):
        a = lsh_forest.shingles(" ".join(f"{k}w{x}" for x in range(300)).encode(), known)
        b = lsh_forest.shingles(" ".join(f"{k}w{x}" for x in range(3 * (k % 30), 300 + 3 * (k % 30))).encode(), known)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        errors.append((lsh_forest.minhash(a, add, by) == lsh_forest.minhash(b, add, by)).mean() - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


# ------------------------------------------------------------------ prefix trie
def trie_by_search(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        donor = c - int(np.fmod(c, 20))
        full[c] = own.get(donor, [])[:h] + own[c][h:]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, t in full.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
        ends[tuple(t)].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    out = []
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        saved = sum((len(members[x]) - 1) * len(re.findall(rb"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], sum(x not in kids for x in below), saved, digest))
    return sorted(out, key=str)


def conversations():
    rows = [(c, t, "user" if t % 2 == 0 else "bot", f"turn {t} of {c % 3 if t < 6 else c}") for c in range(60) for t in range(c % 9)]
    rows += [(100 + k, t, "user", f"copy {t}") for k in range(25) for t in range(20)]  # deep and shared
    rows += [(200, t, "user", f"tail {t}") for t in range(70)] + [(220, t, None, None) for t in range(3)]
    rows += [(300, None, "a", "x"), (300, None, "a", "x"), (300, 1, "b", " \t"), (300, 1, "a", "b"), (None, 0, "u", "none"), (-7, 0, "u", "a b"), (-7, 1, "u", "c"), (-7, 2, "u", "c"), (-7, 3, "u", "c")]
    return rows


@pytest.mark.parametrize("segment,ids", [(8, 4096), (3, 4)])
def test_trie_equals_search(spark, monkeypatch, segment, ids):
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    monkeypatch.setattr(prefix_trie, "BLOCK_IDS", ids)
    rows = conversations()
    got = prefix_trie.trie(clash(spark, rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(map(tuple, got), key=str) == trie_by_search(rows)


def test_trie_of_small_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.trie(clash(spark, [], schema)).count() == 0
    assert prefix_trie.trie(clash(spark, [(None, 1, "a", "b")], schema)).count() == 0
    bare = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 >= 1)  # its donor is absent and its one turn is given away
    got = prefix_trie.trie(clash(spark, [(bare, 0, "u", "gone")], schema)).collect()
    assert [tuple(r) for r in got] == [(bare, 0, None, 1, 0, 1, 0, hashlib.sha256(str(bare).encode()).hexdigest())]


# ------------------------------------------------------------------ phrases
def phrases_by_search(rows, least, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    out = collections.defaultdict(list)
    for (lang, p), a in found.items():
        best = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        spans = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(lg == lang and len(q) > len(p) and 100 * b >= 80 * a and spans(q) for (lg, q), b in found.items()):
            continue
        out[lang].append((-best[0], -a, " ".join(p).encode(), a, f[lang, p[: best[1]]], f[lang, p[best[1] :]]))
    return sorted((lang, r, x[2].decode(), x[3], x[4], x[5], n[lang], -x[0]) for lang, xs in out.items() for r, x in enumerate(sorted(xs)[:top], 1))


def phrase_rows():
    rng = np.random.default_rng(4)
    words = ["the", "of", "New", "York", "city", "ist", "ein", "é\U0001f600", "zz"]
    rows = [(["en", "de", None, "und"][k % 4], " ".join(rng.choice(words, 40)) + [". ", ", the of", "\nnew york\tcity", "!"][k % 4]) for k in range(60)]
    return rows + [("en", "new york city hall " * 40), ("en", "a a a a a a a a a a a a"), ("fr", None), ("fr", ""), ("en", "x" * 300_000), (None, ".,;")]


@pytest.mark.parametrize("per_trie,room", [(200_000, 48 << 20), (15, 48 << 20), (15, 600)])
def test_phrases_equal_search(spark, monkeypatch, per_trie, room):
    monkeypatch.setattr(phrases, "TRIE_PHRASES", per_trie)
    monkeypatch.setattr(phrases, "ROUND_BYTES", room)
    monkeypatch.setattr(phrases, "BLOCK", 500)
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 9_000)
    rows = phrase_rows()
    docs = clash(spark, rows, "lang string, text string")
    assert sorted(map(tuple, phrases.collocations(docs, 7).collect())) == phrases_by_search(rows, 7)
    if room == 600:
        assert sorted(map(tuple, phrases.collocations(docs, 7, 3).collect())) == phrases_by_search(rows, 7, 3)


def test_phrases_of_tables_without_any(spark):
    assert phrases.collocations(clash(spark, [], "lang string, text string")).count() == 0
    assert phrases.collocations(clash(spark, [("en", "only few words"), (None, None)], "lang string, text string")).count() == 0


def test_a_trie_accepts_its_phrases_and_no_other():
    rng = np.random.default_rng(0)
    rows = {tuple(x[: 2 + k % 3]) for k, x in enumerate(rng.zipf(1.4, (4000, 4)) % 500 + 1)}
    packed = np.zeros((len(rows), 4), np.int32)
    for k, x in enumerate(sorted(rows)):
        packed[k, : len(x)] = x
    trie = phrases.Trie.from_bytes(phrases.Trie.of(packed).to_bytes())
    ids = (rng.zipf(1.4, 20_000) % 520).astype(np.int32)
    got = {(int(a), level) for level, at, to in trie.walk(ids) for a, t in zip(at, to) if trie.accepts[t] == level}
    want = {(k, n) for k in range(len(ids)) for n in (2, 3, 4) if k + n <= len(ids) and tuple(ids[k : k + n]) in rows}
    assert got == want and len(got) > 1000
    assert len(trie.check) < 40 * len(rows)


def test_phrases_cross_the_strides_of_a_walk(spark, monkeypatch):
    monkeypatch.setattr(phrases, "STRIDE", 7)
    rows = phrase_rows()
    docs = clash(spark, rows, "lang string, text string")
    assert sorted(map(tuple, phrases.collocations(docs, 7).collect())) == phrases_by_search(rows, 7)


def test_the_memory_of_a_walk_does_not_follow_the_block():
    import tracemalloc

    packed = np.array([[a, b, 0, 0] for a in range(1, 30) for b in range(1, 30)], np.int32)
    trie, rng = phrases.Trie.of(packed), np.random.default_rng(1)
    peaks = []
    for size in (1 << 19, 1 << 21):
        ids = rng.integers(0, 40, size).astype(np.int32)
        tracemalloc.start()
        found = sum(int((trie.accepts[to] > 0).sum()) for _, some, starts in phrases.strides(ids) for _, _, to in trie.walk(some, starts))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert found == np.count_nonzero((ids[:-1] > 0) & (ids[:-1] < 30) & (ids[1:] > 0) & (ids[1:] < 30))
    assert peaks[1] < 1.2 * peaks[0] < 20e6


def test_a_table_of_ranks_equals_the_search_of_every_number():
    rng = np.random.default_rng(23)
    held = np.unique(rng.integers(1, 400, (300, phrases.LONGEST)) * 7, axis=0).astype(np.int32)
    trie = phrases.Trie.of(held)
    ids = np.concatenate([held[rng.integers(0, len(held), 500)].ravel(), rng.integers(0, 5000, 2000)]).astype(np.int32)
    at = np.minimum(np.searchsorted(trie.symbols, ids), len(trie.symbols) - 1)
    assert np.array_equal(trie.ranks().take(ids, mode="clip"), np.where(trie.symbols[at] == ids, trie.rank[at], 0))
    one, two = ([(k, a.tolist(), s.tolist()) for k, a, s in trie.walk(ids, 2500, ranks)] for ranks in (None, trie.ranks()))
    assert one == two and one[-1][0] == phrases.LONGEST
