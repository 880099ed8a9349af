import re
import textwrap

import duckdb

from spanloom.llm import licences

from .odd import DOCS, documents


def test_forms_of_one_licence(spark):
    text = licences._MIT_BODY
    forms = [
        (1, text),
        (2, "MIT LICENCE\nCopyright (c) 2020 Some One\n\n" + text.upper().replace(".", " . ")),
        (3, "© 1999 X\n" + text.replace("copyright holders", "copyright owners").replace("COPYRIGHT HOLDERS", "COPYRIGHT OWNERS")),
        (4, text + " and more"),
        (5, "Prose.\nReleased under the MIT Licence!\n* Licensed under CC BY-NC 4.0\nend"),
    ]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(forms, "doc_id long, text string")).collect()}
    assert [got[i].text_licence for i in range(1, 6)] == ["MIT", "MIT", "MIT", None, None]
    assert got[5].line_licences == "CC-BY-NC-4.0,MIT" and got[5].n_licence_lines == 2
    assert got[4].n_licence_lines == 0


def test_odd_rows(spark):
    rows = licences.scan(documents(spark)).collect()
    assert len(rows) == len(DOCS)
    digests = {r.doc_id: r.digest for r in rows}
    assert digests[3] == digests[4] == digests[5] and digests[1] == digests[2] != digests[8]
    assert licences.scan(documents(spark).limit(0)).count() == 0


def test_every_known_statement_has_the_trigger():
    assert all(re.search(licences.TRIGGER, text) for _, text in licences.STATEMENTS if "\n" not in text)


def test_headings_holders_and_list_marks(spark):
    """Whole licences under the usual headings, at several widths, with their conditions numbered, lettered or dotted."""
    heads = ["{}\n\nCopyright (c) 2020 A B\n\n", "# {}\n\nCopyright A B\nAll rights reserved.\n\n", "Copyright 2001, The Foo Authors\nAll Rights Reserved.\n\n", "/*\n * Copyright (C) 1999-2004 Foo, Inc.  All rights reserved.\n *\n", "({})\n\n© A B <a@b.c>\n\n", ""]
    marks = [lambda t: t, lambda t: re.sub(r"(?m)^[0-9]\. ", "* ", t), lambda t: re.sub(r"(?m)^([0-9])\. ", lambda m: f"({'abc'[int(m[1]) - 1]}) ", t), lambda t: re.sub(r"(?m)^([0-9])\. ", r"\1) ", t)]
    rows, want = [], []
    for name, (titles, body) in licences.WHOLE.items():
        for i, head in enumerate(heads):
            for mark in marks:
                text = "\n\n".join("\n".join(textwrap.wrap(line, (40, 72, 1000)[i % 3])) for line in body.strip().split("\n"))
                rows.append((len(rows), head.format(titles[i % len(titles)]) + mark(text)))
                want.append(name)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = licences.scan(docs).collect()
    assert {r.doc_id: r.text_licence for r in got} == dict(enumerate(want))
    own = docs.toPandas()  # noqa: F841
    found = duckdb.sql(licences.sql().replace(" documents", " own")).fetchall()
    assert sorted((r[0], r[1], r[2]) for r in found) == sorted((r.doc_id, r.digest, r.text_licence) for r in got)


def test_running_text_on_copyright_stays(spark):
    texts = ["copyright holders be liable\nfor x", "Copyright A B\nfor x", "copyright notice and more", "Copyright Noticed Ltd"]
    docs = spark.createDataFrame(enumerate(texts), "doc_id long, text string").select(licences.canonical(licences.F.col("text")).alias("form"))
    assert [r.form for r in docs.collect()] == ["copyright owners be liable for x", "for x", "copyright notice and more", ""]


def test_lines_without_the_trigger(spark):
    body = " ".join(licences._ISC_BODY.split("\n"))
    rows = [(1, f"Prose.\n// {body.upper()}\nend"), (2, body), (3, body.replace("LIABLE", "liable in part") + "\nMERCHANTABILITY"), (4, None)]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[i].text_licence, got[i].line_licences, got[i].n_licence_lines) for i in range(1, 5)] == [(None, "ISC", 1), ("ISC", "ISC", 1), (None, "", 0), (None, "", 0)]


def test_every_known_text_is_looked_up(spark):
    """Also in other spellings, and with a table of the caller."""
    own = [("A", "Free of terms whatsoever"), ("B", "Copyright holder http://favor.x"), ("C", "You may fulfil the judgement"), ("D", "License D"), ("E", "")]
    for texts, respelled in ((licences.KNOWN, []), (own, [("B", "text: copyright owner"), ("C", "YOU MAY FULFILL the judgment!"), ("D", "LICENCE d")]), (own[2:], [("C", "you may fulfill, the judgement")]), ([("F", "favour licence"), ("G", "favour")], [("G", "Favor")])):
        asked = [(name, " ".join(text.split("\n"))) for name, text in [*texts, *respelled] if text and not text.startswith(("Copyright", "text:"))]
        rows = [(i, f"before\n{line}\nafter") for i, (_, line) in enumerate(asked)]
        got = {r.doc_id: r.line_licences for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), texts).collect()}
        assert got == {i: name for i, (name, _) in enumerate(asked)}


def test_sql_agrees(spark, sf):
    want = duckdb.sql(licences.sql().replace(" documents", f" '{sf}/documents.parquet'")).fetchall()
    got = licences.scan(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_whole_licences_in_other_layouts_and_within_texts(spark):
    """At any wrap width, with comment marks, numbered conditions and copyright lines, alone and between paragraphs."""
    bodies = {"MIT": licences._MIT_BODY, "ISC": licences._ISC_BODY, "0BSD": licences._0BSD_BODY, "Zlib": licences._ZLIB_BODY, "BSD-2-Clause": licences._BSD_TERMS + licences._DISCLAIMER, "BSD-3-Clause": licences._BSD_TERMS + licences._BSD_NAMES + licences._DISCLAIMER}
    rows, want = [], {}
    for name, body in bodies.items():
        for width in (30, 47, 61, 72, 100):
            paragraphs = ["\n".join(textwrap.wrap(p, width)) for p in body.split("\n") if p]
            text = "Copyright (c) 2001 Some One\n\n" + "\n\n".join(paragraphs)
            marked = "\n".join(f" * {line}" for line in text.replace("\n\n", "\n").split("\n"))
            for form, whole in ((text, True), (marked, True), (f"Some prose.\n\n{text}\n \nMore prose.", False), (text[:-20], None)):
                want[len(rows)] = (name if whole else None, name if whole is False or (whole and form is text) else None)
                rows.append((len(rows), form))
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (whole, block) in want.items():
        assert got[i].text_licence == whole, rows[i]
        assert block is None or got[i].block_licences == block, rows[i]
        assert whole or block or not got[i].block_licences


def test_sql_agrees_on_licences_within_texts(spark):
    rows = [(i, f"Licensed prose.\n\n{t}\n\n© 2000 X\n\nend" if i % 2 else t) for i, (_, t) in enumerate(licences.KNOWN)] + [(90, None), (91, ""), (92, "Copyright holders\nof licences\n\n\nCopyright 1999 Y\n(c) You may license")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = docs.toPandas()  # noqa: F841
    want = duckdb.sql(licences.sql().replace(" documents", " own")).fetchall()
    skip = {i for i, t in rows if t and "licen" not in t.lower()}  # the SQL looks these up as whole texts only
    assert sorted((tuple(r) for r in licences.scan(docs).collect() if r.doc_id not in skip), key=repr) == sorted((r for r in want if r[0] not in skip), key=repr)
