"""Block rules of pages, license signatures and line rules: each rule matters, near misses stay out, texts come back whole."""

import html as refs
import re
import time

import pytest

import corpus_pipeline
from vigilspark.llm import html_text, licenses, quality

SF = "/root/testdata/sf0.001"
PROSE = "The way of it is that all of us have to be here for the rest of this day, and that is as it was in the past for them."
PLAIN = "Kite lantern marble window copper engine harbour timber velvet saddle orchard mirror blanket compass."


def body(*parts):
    return f"<html><body>{''.join(parts)}</body></html>"


def p(text, attrs=""):
    return f"<p{attrs}>{text}</p>"


# ------------------------------------------------------------------ pages
@pytest.mark.parametrize("swap", [("article", "article"), ("article", "div"), ("article", "section"), ("article", "main")])
def test_the_article_tag_is_not_needed(spark, swap):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        own = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = [" ".join(refs.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", own)]
        page = re.sub(f"<(/?){swap[0]}>", rf"<\1{swap[1]}>", r.html)
        assert html_text.main_text(page) == "\n".join(x for x in want if x)


def test_stop_word_density_decides():
    page = body("<div>", p(PROSE), p(PROSE), p("Short."), "</div><div>", p(PLAIN), "</div>", "<div>", p("Of it."), "</div>")
    with_words = html_text.main_text(page)
    assert with_words.startswith(f"{PROSE}\n{PROSE}\nShort.") and html_text.first_label(html_text.blocks(body(p(PLAIN)))[0]) == 0
    assert html_text.first_label(html_text.blocks(body(p(PROSE)))[0]) == 1


def test_link_density_decides():
    links = "".join(f'<a href="/{k}">{PROSE[:60]}</a> ' for k in range(3))
    page = body("<div>", p(PROSE), p("Near."), "</div><div>", p(links), p("Beside it."), "</div>")
    assert html_text.main_text(page) == f"{PROSE}\nNear."
    assert "Beside it." in html_text.main_text(page.replace("<a ", "<i ").replace("</a>", "</i>"))


def test_length_decides():
    assert html_text.first_label(html_text.blocks(body(p("It is of the")))[0]) == 0
    assert html_text.first_label(html_text.blocks(body(p("It is of the " * 8)))[0]) == 1


def test_short_blocks_inherit_from_the_nearest(monkeypatch):
    links = "".join(f'<a href="/{k}">{PROSE[:60]}</a> ' for k in range(3))
    page = body("<div>", p(links), p("After the links."), p("Middle."), p("Before the text."), p(PROSE), "<h2>A heading</h2>", p(PROSE), p(links), "<h2>Ends</h2>", p(links), "</div>")
    assert html_text.main_text(page) == f"Before the text.\n{PROSE}\nA heading\n{PROSE}"
    monkeypatch.setattr(html_text, "nearest", lambda *a: -1)
    assert html_text.main_text(page) == f"{PROSE}\n{PROSE}"


def test_pages_in_a_language_without_a_list():
    russian = "Длинный абзац русского текста рассказывает читателю подробную историю большого города и его старых улиц."
    chinese = "這是一段很長的中文文字用來說明沒有停用詞表的語言也必須完整保留下來而不會遺失任何內容"
    for text in (russian, chinese):
        page = body("<nav><a href='/'>Menu</a></nav><div>", p(text), p(text), "</div><footer>x</footer>")
        assert html_text.main_text(page) == f"{text}\n{text}"


@pytest.mark.parametrize("page", ["<a" * 500_000, '<a "' * 250_000, "<div>" * 100_000 + "</span>" * 100_000, "<p>" * 300_000, "<!--" * 200_000, "<a '\">" * 100_000, "<div class='x'>" * 60_000 + "x" + "</div>" * 60_000])
def test_markup_that_never_closes_takes_linear_time(page):
    start = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - start < 5


def test_a_very_long_page_is_whole():
    page = body("<article>", *[p(f"{PROSE} {k}") for k in range(20_000)], "</article>")
    assert html_text.main_text(page).count("\n") == 19_999


def test_pages_with_clashing_columns_and_none(spark):
    schema = "page_id long, url string, html string, text string, host string, part string"
    rows = [(None, None, None, "a", "b", "c"), (1, "u", body(p(PROSE)), None, None, None)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, schema)).collect()}
    assert got == {None: "", 1: PROSE}
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0


# ------------------------------------------------------------------ licenses
@pytest.mark.parametrize("text", [
    "Please submit license forms", "the permit license fee", "An unlicensed driver, and a disc license", "omit licenses", "hash bee4acc0f7 of CC0ish", "remit licence",
    "éisc license", "mit licensee", "the affinity of a modified bsdx", "new bsdi", "zlibx license", "under termsx of", "a permission is hereby grantedx",
])
def test_near_misses_have_no_label(spark, text):
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert set(row.labels.split(",")) - {""} <= {"mit", "apache", "gpl"} & set(row.base_labels.split(","))


def test_license_texts_are_found(spark):
    texts = {
        "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy",
        "epl": "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License",
        "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "gpl-3.0": "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or",
        "bsd-3-clause": "Neither the name of the Example Project nor the names of its contributors may be used to endorse or promote products",
        "apache-2.0": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "zlib": "Altered source versions must be plainly marked as such, and must not be",
        "ofl-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
        "bsl-1.0": "See http://www.boost.org/LICENSE_1_0.txt)",
        "unlicense": "This is free and unencumbered software released into the public domain.",
        "eupl-1.2": "EUROPEAN UNION PUBLIC LICENCE v. 1.2",
    }
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")).collect()}
    assert all(label in got[k] for k, label in enumerate(texts))


def test_every_signature_has_its_keyword():
    assert all(word in regex.replace("\\", "").replace("licen[cs]es?", "license").replace("licen[cs]e", "license") or word in regex.replace("\\", "") for _, word, _, _, regex in licenses.BODIES)


def test_every_keyword_holds_a_root():
    assert all(any(r in k for r in licenses.ROOTS) for own in licenses.rule_keywords() for k in own)
    assert not any(re.search(r"\s", r) for r in licenses.ROOTS)


# ------------------------------------------------------------------ line rules
def cleaned(text):
    """The kept lines of a text by plain Python, blank ones in place."""
    marks = re.compile("[!-/:-@\\[-`{-~¡«·»¿‐-‧‰-⁞、-〃]")
    upper, lower = re.compile("[A-ZÀ-ÖØ-Þ]"), re.compile("[a-zß-öø-ÿ]")

    def fails(line):
        w = re.findall(r"[^\x20\x09-\x0D]+", line)
        n, chars = len(w), sum(map(len, w))
        bars = len(re.findall("[|•·›»]", line))
        return (len(re.findall(r"[#*$%&|<>]", line)) > 0.5 * n or len(marks.findall(line)) > 0.5 * chars or (bars >= 2 and 4 * bars >= n) or (n >= 3 and len(upper.findall(line)) > len(lower.findall(line)))
                or (n >= 10 and len(set(w)) < 0.4 * n) or (n <= 12 and re.search(quality.BOILERPLATE, line) is not None))

    return "\n".join(x for x in text.split("\n") if not re.search(r"[^\x20\x09-\x0D]", x) or not fails(x))


def test_the_stage_returns_the_texts_whole_but_for_failing_lines(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id: r.text for r in corpus_pipeline.quality_rules(spark, docs, SF).collect()}
    assert len(kept) > 500 and all(kept[k] == cleaned(texts[k]) for k in kept)


def test_blank_lines_stay_and_marks_go(spark):
    good = "\n\n".join(f"Some plain words {k} stand in the {k}th line of this text." for k in range(6))
    rows = [(1, good), (2, f"{good}\n!!! ??? ...\n \t\n-- -- --\nEnd of it all."), (3, f"{good}\nTous droits réservés\nHier klicken!\nLeer más"), (4, None), (5, "")]
    kept = {r.doc_id: r.text for r in quality.keep_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {1: good, 2: f"{good}\n \t\nEnd of it all.", 3: good}


def test_the_pipeline_takes_empty_tables_nulls_and_clashing_names(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, w string, row string, t string, lines string, cid string"
    rows = [(1, None, "en", "s", 0, "a", "b", "c", "d", "e"), (None, "", None, None, None, None, None, None, None, None), (2, f"{PROSE}\n\n{PLAIN}", "en", "s", 9, "a", "b", "c", "d", "e")]
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == schema.replace(" long", "").replace(" string", "").split(", ")
        assert [r.doc_id for r in docs.collect()] == ([2] if table else [])
