"""Operators for training text: edge cases, brute force, and SQL on the smallest tables."""

import collections
import hashlib
import math
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from vigilspark.llm import bpe, chunks, decontaminate, hashing, html_text, jaccard_join, language_model, licenses, line_dedup, quality, registry, toxicity, url_filters

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = registry.load_all()
LONG = "Lorem words of a rather long line that goes on and on. " * 2000
#: NULLs, empty, blank, very long, exact copies, ties in ids, and columns whose names operators might use themselves.
ROWS = [
    (1, "One line here.\nTwo lines here.\nThree lines here.\nOwn end.", "x"),
    (2, "Start.\nOne line here.\nTwo lines here.\nThree lines here.", "x"),
    (2, "One line here.\nTwo lines here.\nThree lines here.\nOwn end.", None),
    (None, "One line here.\nTwo lines here.\nThree lines here.\nOwn end.", "y"),
    (3, None, None),
    (None, None, "y"),
    (4, "", "y"),
    (5, " \n\t\n ", "z"),
    (6, LONG, "z"),
    (6, LONG, "z"),
    (7, "İß ½ 你好 \U0001f600 Licensed under the MIT License.", "z"),
]
SCHEMA = "doc_id long, text string, w string, row string, lines string, cid string, n string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(a, b, c, c, c, c, c) for a, b, c in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(0, "alpha beta gamma delta epsilon zeta. eta theta iota kappa lambda."), (1, None), (None, "x y"), (2, "")], "item_id long, text string")


def test_every_operator_takes_odd_and_empty_tables(spark, odd, none, items):
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    for docs in (odd, none):
        n = docs.count()
        assert quality.assess(docs).count() == n
        assert line_dedup.dedup_lines(docs).count() == n
        assert jaccard_join.similar(docs).count() == n
        assert bpe.digest(bpe.encode(docs)).count() == n
        assert language_model.score(docs).count() == n
        assert toxicity.score(docs, toxicity.learn(docs, labels)).count() == n
        assert licenses.scan(docs).count() == n
        assert decontaminate.leaks(docs, items).count() == 0
        for stage in (quality, line_dedup, jaccard_join):
            kept = stage.keep_documents(docs)
            assert kept.columns == docs.columns and kept.count() <= n
        assert decontaminate.keep_documents(docs, items).count() == n
        assert decontaminate.keep_documents(docs, items.limit(0)).count() == n


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLE)))
def test_queries_match_sql(spark, name):
    from compare import normal

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE[name]).df()
    for c in want.columns:
        if str(want[c].dtype).startswith(("Int", "int")):
            got[c], want[c] = got[c].astype("Int64"), want[c].astype("Int64")
    assert sorted(got.columns) == sorted(want.columns) and normal(got) == normal(want)


def test_native_operators_match_sql_on_odd_rows(spark, odd):
    from compare import normal

    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM (VALUES " + ", ".join("(?::BIGINT, ?::VARCHAR)" for _ in ROWS) + ") t(doc_id, text)", [v for a, b, _ in ROWS for v in (a, b)])
    for got, sql in ((quality.assess(odd).select("row.doc_id", *quality.DIGEST), quality.ORACLE_SQL), (licenses.scan(odd), licenses.ORACLE_SQL)):
        got, want = got.toPandas(), con.execute(sql).df()
        for c in want.columns:
            if str(want[c].dtype).startswith(("Int", "int")):
                got[c], want[c] = got[c].astype("Int64"), want[c].astype("Int64")
        assert normal(got) == normal(want)


def test_line_dedup_keeps_every_window_once(odd):
    out = {(r.doc_id, r.n_lines, r.n_removed): r.clean_text for r in line_dedup.dedup_lines(odd).select("row.doc_id", "n_lines", "n_removed", "clean_text").collect()}
    assert out[1, 4, 4] == "" or out[None, 4, 0]  # the NULL id comes first and keeps its lines
    assert out[2, 4, 3] == "Start."
    assert out[None, 4, 0].startswith("One line")


def test_quality_rules_keep_sentences_and_drop_junk(spark):
    good = " ".join(f"some{k} plain{k} words{k} stand in this sentence{k}." for k in range(12))
    junk = [" | ".join(f"item{k}" for k in range(30)), " ".join(f"W{k}### X{k}$$$" for k in range(20)), " ".join(["SHOUT!!"] * 3 + [f"LOUD{k}!!" for k in range(30)]), " ".join(["word"] * 40)]
    rows = [(0, good), (1, good + "\n" + junk[0][:60])] + [(k + 2, x) for k, x in enumerate(junk)]
    kept = {r.doc_id: r.text for r in quality.keep_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(kept) == {0, 1} and kept[1] == good


def test_decontamination_equals_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    norm = lambda s: " " + " ".join(decontaminate.tokens(s)) + " "
    texts, tests = [(r.doc_id, norm(r.text)) for r in docs.collect()], [(r.item_id, norm(r.text)) for r in bench.collect()]
    want = {(i, j) for i, x in texts for j, y in tests if y in x}
    for part in (decontaminate.PART_WORDS, 400):
        old, decontaminate.PART_WORDS = decontaminate.PART_WORDS, part
        try:
            got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
        finally:
            decontaminate.PART_WORDS = old
        assert got == want and want
    kept = {r.doc_id for r in decontaminate.keep_documents(docs, bench).collect()}
    assert kept == {i for i, _ in texts} - {i for i, _ in want}


def test_decontamination_finds_items_with_changed_words(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    df = collections.Counter(t for _, x in items for t in set(decontaminate.tokens(x)))
    index = decontaminate.Index(items, df, len(items), float(np.mean([len(decontaminate.tokens(x)) for _, x in items])))
    rng, texts, want = np.random.default_rng(3), [], []
    for item, text in items:
        parts = decontaminate.halves(text)
        for k in range(sum(map(len, parts))):
            for at in ([k], [k, int(rng.integers(sum(map(len, parts))))]):
                w = [x for part in parts for x in part]
                for place in at:
                    w[place] = f"other{place}"
                lost = [sum(len(set(at) & {j}) for j in range(lo, lo + len(p))) for lo, p in zip((0, len(parts[0])), parts)]
                texts.append(" ".join(["before", *w, "after"]))
                want.append(item if all(2 * n <= len(p) for n, p in zip(lost, parts)) else None)
    retrieved = {(t, i[0]) for t, _, i, _ in index.candidates([decontaminate.tokens(x) for x in texts], decontaminate.THRESHOLD)}
    got = set(index.matches(texts))
    assert all((t, i) in got for t, i in enumerate(want) if i is not None and (t, i) in retrieved)
    assert sum(i is not None and (t, i) in retrieved for t, i in enumerate(want)) > 0.9 * len(want)
    words = sorted(df)
    clean = [" ".join(rng.choice(words, 400)) for _ in range(200)]
    half = [" ".join(decontaminate.halves(x)[k]) for _, x in items for k in (0, 1) if min(map(len, decontaminate.halves(x))) >= 5]
    assert half and not index.matches(clean, 0.2) and not index.matches(half, 0.2)
    assert decontaminate.edits(list("abcd"), list("xxabydxx")) == 1 and decontaminate.allowed(1, 0.8) == 0 and decontaminate.allowed(30, 1.0) == 0


def test_block_bounds_lose_no_candidate():
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choice(words, 12))) for k in range(150)]
    df = collections.Counter(t for _, x in rows for t in set(x.split()))
    index = decontaminate.Index(rows, df, len(rows), 12.0)
    text = [str(x) for x in rng.choice(words, 300)]
    got = {(item[0], start) for _, passage, item, _ in index.candidates([text], 0.55) for start in [tuple(passage)]}
    weight = {(k, t): w for t, at in index.terms.items() for k, w in index.postings[at]}
    want = set()
    for v in range(-(-len(text) // index.width)):
        passage = text[v * index.width : (v + 2) * index.width]
        want |= {(k, tuple(passage)) for k in range(150) if sum(weight.get((k, t), 0) for t in set(passage)) >= 0.55}
    assert got == want and want


def test_jaccard_join_equals_all_pairs(spark, odd):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    base = [f"u{k}" for k in range(300)]
    docs += [(10_000 + j, " ".join(w if i % 97 != j or j == 0 else f"v{j}" for i, w in enumerate(base))) for j in range(40)]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, x in docs if (w := x.lower().split())}
    links, parent = collections.Counter(), {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    old = jaccard_join.PART_CLASSES
    for part in (old, 7):
        jaccard_join.PART_CLASSES = part
        try:
            got = {r.id: (r.class_id, r.n_links) for r in jaccard_join.similar(frame).collect()}
        finally:
            jaccard_join.PART_CLASSES = old
        assert got == {i: (root(i), links[i]) for i, _ in docs}
    kept = sorted(r.doc_id for r in jaccard_join.keep_documents(frame).collect())
    assert kept == sorted({root(i) for i, _ in docs})
    assert sum(r.doc_id == 6 for r in jaccard_join.keep_documents(odd).collect()) == 1


def test_jaccard_join_keeps_rows_without_words(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, None), (4, "some words that stand here"), (5, "some words that stand here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {(r.doc_id, r.text) for r in jaccard_join.keep_documents(docs).collect()}
    assert kept == set(rows[:5])


def test_bayes_limits_and_minhash():
    limits = jaccard_join.least_matches()
    assert all(m < 0.8 * n for n, m in limits.items()) and list(limits) == [16, 32, 48, 64, 80]
    known = hashing.WordHashes(10)
    a = jaccard_join.shingles(" ".join(map(str, range(400))), known)
    b = jaccard_join.shingles(" ".join(map(str, range(40, 440))), known)
    by = jaccard_join.multipliers()
    share = (jaccard_join.minhash(a, by) == jaccard_join.minhash(b, by)).mean()
    assert abs(share - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.15


def test_bpe_equals_the_tokenizer_library(spark, odd):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(path), special_tokens={})
    ids = [library.encode_ordinary(x or "") for _, x, _ in ROWS]
    want = sorted((len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()) for e, (_, x, _) in zip(ids, ROWS))
    encoded = bpe.encode(odd)
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest(encoded).collect()) == want
    assert sorted(bytes(r.data).decode() for r in bpe.decode(encoded).collect()) == sorted(x or "" for _, x, _ in ROWS)


def test_packed_numbers_return():
    x = np.array([0, 1, 127, 128, 16_383, 16_384, 2_097_151, 2_097_152, 2**32])
    assert chunks.unpack(chunks.pack(x)).tolist() == x.tolist() and chunks.unpack(b"").tolist() == []


def katz(docs, k=language_model.K, tail=language_model.TAIL):
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or "")) + ["\n"]) for i, x in docs]
    train = [t for i, t in texts if not language_model.held_out(i)]
    c = collections.Counter(w for t in train for w in t)
    pairs = collections.Counter(p for t in train for p in zip(["\n"] + t[:-1], t))
    total, distinct = sum(c.values()), len(c)
    du, db = (language_model.discounts([sum(x == r for x in n.values()) for r in range(1, k + 2)]) for n in (c, pairs))
    left = lambda r, d: d[r - 1] * r if r <= k else r - tail
    unknown = 1 - sum(left(x, du) for x in c.values()) / total
    p1 = lambda w: left(c[w], du) / total if c[w] else unknown
    after = collections.defaultdict(list)
    for (v, w), r in pairs.items():
        after[v].append((w, r))
    alpha = {v: (1 - sum(left(r, db) for _, r in f) / c[v]) / (1 - sum(p1(w) for w, _ in f)) for v, f in after.items()}
    for v in list(after)[:20]:
        mass = sum(left(r, db) / c[v] for _, r in after[v]) + alpha[v] * (sum(p1(w) for w in c if (v, w) not in pairs) + unknown)
        assert abs(mass - 1) < 1e-9
    out = []
    for i, t in texts:
        s = sum(math.log10(left(pairs[v, w], db) / c[v]) if pairs[v, w] else (math.log10(alpha[v]) if c[v] else 0) + math.log10(p1(w)) for v, w in zip(["\n"] + t[:-1], t))
        out.append((i, language_model.held_out(i), len(t), sum(c[w] > 0 for w in t), total, sum(math.log10((c[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t), s))
    return out


@pytest.mark.parametrize("bucket_tokens", [10**7, 5_000])
def test_language_model_equals_brute_force(spark, bucket_tokens):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(a, b) for a, b, _ in ROWS]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:5], round(r[6], 4))
    got, want = (sorted(x, key=key) for x in (map(tuple, language_model.score(frame, bucket_tokens).collect()), katz(docs)))
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5:] for x in got], [x[5:] for x in want], rtol=1e-9, atol=1e-6)


def test_a_pair_in_every_document_is_split(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(language_model, "CHARS", 600)
    seen = [k for k in range(1, 3000) if not language_model.held_out(k)][:1200]
    held = [k for k in range(1, 3000) if language_model.held_out(k)][:300]
    docs = [(k, f"the the w{k % 90}" + " of" * (k % 2) + " x of the" * (k == seen[3])) for k in seen]
    docs += [(k, f"the the w{k % 90} of the" + " of of the" * (k % 3)) for k in held]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "docs"))
    frame = spark.read.parquet(str(tmp_path / "docs"))
    key = lambda r: (r[0], *r[1:5])
    got, want = (sorted(x, key=key) for x in (map(tuple, language_model.score(frame, 300).collect()), katz(docs)))
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5:] for x in got], [x[5:] for x in want], rtol=1e-9, atol=1e-6)
    counts = language_model.word_counts(frame)
    sums = np.sum([np.frombuffer(r.codes, np.float64) for r in counts.where("chunk < 0").collect()], axis=0)
    uni = language_model.Unigrams(float(sums[0]), float(sums[1]), sums[2:].tolist())
    buckets = math.ceil(1.25 * uni.total / 300)
    entries = collections.Counter()
    for r in language_model.pair_rows(frame, counts, uni, buckets).collect():
        entries[r.bucket] += len(language_model._loose(r.data[7])) if r.data[-1] else 0
    assert max(entries.values()) < 1000 < len(docs)


def test_chunks_give_room_to_words_of_the_last_held_out_document(spark, monkeypatch):
    monkeypatch.setattr(chunks, "WORDS", 3)
    docs = spark.createDataFrame([(k, f"a{k} b{k} c{k} d{k} e{k}") for k in range(40)], "doc_id long, text string").coalesce(1)
    assert language_model.score(docs).count() == 40


def test_toxicity_on_the_held_out_fold(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.op6_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").toPandas()
    rank = out["score"].rank()
    pos = (out["toxic"] == 1).sum()
    auc = (rank[out["toxic"] == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(out) - pos))
    assert auc > 0.97 and ((out["predicted"] == 1) & (out["toxic"] == 0)).mean() < 0.01
    model = toxicity.learn(docs, labels)
    assert len(model[0]) < 20_000 and out["score"].between(0, 1).all()


PAGE = """<html><head><title>Title</title><style>p{x:y}</style><script>var a="</p><p>no";</script></head><body>
<header><a href="/">Home of the site and of the news</a></header><nav><ul><li><a href="/a">One</a></li></ul></nav>
<div class="cookie-notice">We use the cookies of this site for the best of all visits and to be of help to you.</div>
<article><h1>A title</h1><p>The first of the paragraphs is about the way in which it is that we are to be here &amp; there.<br>
<p>Short.</p><aside>The aside of the page is not a part of the text and is to be left out of it.</aside><p>And   the&nbsp;last one is as long as it
has to be for the rules to see that it is the text of the page.</p></article>
<section id="comments"><p>The comment of a reader is not the text of the page, and it is to be left out of it too.</p></section>
<form>Your name is of use to us in the list of the readers</form><footer>All of the rights are with the owner of the site.</footer></body></html>"""


def test_html_rules(spark):
    want = "A title\nThe first of the paragraphs is about the way in which it is that we are to be here & there.\nShort.\nAnd the last one is as long as it has to be for the rules to see that it is the text of the page."
    assert html_text.main_text(PAGE) == want
    assert html_text.main_text(PAGE.replace("<article>", "<div>").replace("</article>", "</div>")) == want
    assert html_text.main_text("<p>never <b>closed " + "x " * 10) is not None and html_text.main_text("<" * 1000) is not None
    pages = spark.createDataFrame([(1, "u", None), (None, None, ""), (2, "v", PAGE), (2, "v", PAGE)], "page_id long, url string, html string")
    assert sorted(len(r.text) for r in html_text.extract(pages).collect()) == [0, 0, len(want), len(want)]


def test_html_of_the_given_pages(spark):
    import html as refs

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        own = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = [" ".join(refs.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", own)]
        assert html_text.main_text(r.html) == "\n".join(x for x in want if x)


def test_url_filters_as_of(spark):
    import datetime as dt

    day = lambda k: dt.date(2024, 1, k)
    entries = [("bad.com", day(5), "block", "spam"), ("bad.com", day(10), "remove", None), ("bad.com", day(10), "block", "spam"), ("a.bad.com", day(6), "allow", None), ("bad.com/x", day(7), "block", "malware"), (None, day(1), "block", "x"), ("bad.com", None, "block", "x")]
    captures = [(1, "http://bad.com/", day(4)), (2, "http://bad.com/", day(5)), (3, "http://www.BAD.com:80/", day(9)), (4, "http://bad.com/", day(10)), (5, "http://u@a.bad.com/q", day(7)), (6, "http://bad.com/x?y", day(8)), (7, None, day(8)), (8, "no url", day(8)), (9, "http://bad.com/", None), (9, "http://bad.com/", None)]
    out = url_filters.filter_urls(spark.createDataFrame(captures, "page_id long, url string, fetched_on date"), spark.createDataFrame(entries, "pattern string, changed_on date, action string, category string"))
    got = sorted((r.row.page_id, r.blocked, r.category) for r in out.collect())
    assert got == [(1, False, None), (2, True, "spam"), (3, True, "spam"), (4, False, None), (5, False, None), (6, True, "malware"), (7, False, None), (8, False, None), (9, False, None), (9, False, None)]


def test_license_rules(spark):
    assert len(licenses.signature_rules()) > 200
    rows = [(1, "Licensed under the Apache License, Version 2.0. MIT license mit LICENSE"), (2, "SPDX-License-Identifier: GPL-2.0-only"), (3, "an apache in a limit"), (4, "mit license " * 3000)]
    out = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].base_labels == "apache,mit" and out[1].labels == "apache,apache-2.0,mit" and (out[1].n_base, out[1].first_word, out[1].last_word) == (3, 3, 10)
    assert out[2].labels == "gpl-2.0" and out[2].score == 1.0 and out[3].labels == "" and out[3].score == 0 and out[4].n_base == 3000


def _variants(regex):
    """Strings that match a rule: each alternative of each group once, options left out and taken."""
    from re import _constants as c
    from re import _parser

    def of(items):
        out = [""]
        for op, x in items:
            if op is c.LITERAL:
                own = [chr(x)]
            elif op is c.IN:
                first = x[0][1]
                own = ["ing"] if x[0][0] is c.CATEGORY else [chr(first[0] if isinstance(first, tuple) else first)]
            elif op is c.BRANCH:
                own = [v for branch in x[1] for v in of(branch)]
            elif op is c.SUBPATTERN:
                own = of(x[3])
            elif op is c.MAX_REPEAT:
                own = [*[""] * (x[0] == 0), *of(x[2])]
            else:
                assert op is c.AT
                own = [""]
            out = [out[min(k, len(out) - 1)] + own[min(k, len(own) - 1)] for k in range(max(len(out), len(own)))]
        return out

    return list(dict.fromkeys(of(_parser.parse(regex))))


def test_no_license_match_is_lost_before_the_regexes(spark):
    rules, keywords = licenses.signature_rules(), licenses.rule_keywords()
    assert len(rules) == len(keywords)
    texts = []
    for (_, label, _, _, _, regex), own in zip(rules, keywords):
        for v in _variants(regex):
            assert re.fullmatch(regex, v) and any(k in v for k in own), (label, v)
            texts.append(v)
    names = [name for _, _, name, _ in licenses.FAMILIES]
    assert all(any(k in v for k in licenses.KEYWORDS[f[0]]) for f, name in zip(licenses.FAMILIES, names) for v in _variants(name))
    bodies = {
        "isc": "Permission to use, copy, modify, and/or distribute this\n    software for any purpose with or without fee is hereby granted.",
        "mit": "Permission is hereby granted, free of charge, to any person\n obtaining a copy of this software and associated files.",
        "bsd": "Redistribution and use in source and binary forms, with or\n without modification, are permitted.",
        "bsd-3-clause": "Released under BSD-3-Clause",
        "cc-by": "Published under Creative Commons\tAttribution 4.0 International",
        "eupl-1.2": "European Union Public Licence",
        "cddl-1.0": "Common Development and Distribution License",
    }
    more = [("mit", "Expat License")]
    rows = [*enumerate(texts), *[(len(texts) + k, t) for k, (_, t) in enumerate([*bodies.items(), *more])]]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc, text in rows:
        t = re.sub(r"[\x20\x09-\x0D]+", " ", text.lower())
        hits = [(m.start(), m.end(), p, -k, label) for k, label, _, p, _, regex in rules for m in re.finditer(regex, t)]
        want = {h[4] for h in hits if not any(g[0] <= h[0] and g[1] >= h[1] and (g[2:4] > h[2:4] if g[:2] == h[:2] else g[2] >= h[2]) for g in hits)}
        assert want and want <= set(got[doc].split(",")) <= want | {"mit", "apache", "gpl"}, text
    token = spark.createDataFrame([(0, 'token = "bee4a2827eb113d73cb298acc0f727ef99bdc461"')], "doc_id long, text string")
    assert licenses.scan(token).first().labels == ""
    assert all(label in got[len(texts) + k].split(",") for k, (label, _) in enumerate([*bodies.items(), *more]))


def test_pipeline_equals_brute_force(spark):
    import public_tokenizers
    import tiktoken

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({quality.ORACLE_SQL}) WHERE kept").fetchall()}
    stage = quality.keep_documents(docs)
    assert {r.doc_id for r in stage.collect()} == kept and stage.columns == docs.columns
    frame = stage.toPandas()  # noqa: F841
    con.execute("DROP VIEW documents")
    con.register("documents", frame)
    texts = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, clean_text FROM ({line_dedup.ORACLE_SQL}) WHERE n_removed = 0 OR n_removed < n_lines").fetchall()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, x in texts.items() if (w := x.lower().split())}
    gone = {b for a in sets for b in sets if a < b and sets[a] & sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    norm = lambda s: " " + " ".join(decontaminate.tokens(s)) + " "
    tests = [norm(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {i: x for i, x in texts.items() if i not in gone and not any(t in norm(x) for t in tests)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = sorted((i, len(library.encode_ordinary(x)), hashlib.sha256(x.encode()).hexdigest()) for i, x in texts.items())
    got = sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want
