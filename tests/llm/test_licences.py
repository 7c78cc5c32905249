import textwrap
from pathlib import Path

import pytest
from cases import edge_docs, edge_rows, empty_docs

from quire.llm import licences

#: Published texts that many systems carry.
SHARED = Path("/usr/share/common-licenses")


def scan(spark, texts):
    """(licence of the entire text, licences of blocks)"""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(licences.scan(df).collect(), key=lambda r: r.doc_id)
    assert all(r.licence == (r.licence if r.whole else r.notices[0] if len(r.notices) == 1 else None) for r in rows)
    return [(r.licence if r.whole else None, list(r.notices)) for r in rows]


def test_spellings_case_marks_and_copyright_lines(spark):
    mit = licences.TEXTS["MIT"][0]
    got = scan(
        spark,
        [
            mit,
            mit.upper().replace(",", " ;"),
            "Copyright (c) 2020 A. Person\n" + mit.replace("License", "Licence").replace("sublicense", "sub-license"),
            "© 1999 Someone Else. All rights reserved.\n\n" + licences.TEXTS["ISC"][1],
            mit + " and more",
            licences.TEXTS["0BSD"][1],
            licences.TEXTS["Zlib"][0].replace("acknowledgment", "acknowledgement"),
        ],
    )
    assert [x[0] for x in got] == ["MIT", "MIT", "MIT", "ISC", None, "0BSD", "Zlib"]


def test_notices_are_entire_lines(spark):
    got = scan(spark, ["a\nLICENCED UNDER CC BY-NC 4.0\nb\nReleased under the MIT license!", "we were Licensed under CC BY-NC 4.0. long ago", None, ""])
    assert [x[1] for x in got] == [["CC-BY-NC-4.0", "MIT"], [], [], []]


def test_a_licence_among_other_text_is_found_by_its_paragraphs(spark):
    mit, isc = licences.TEXTS["MIT"][2], licences.TEXTS["ISC"][1]
    got = scan(spark, ["My readme\n=====\nSome words.\n\n" + mit.upper() + "\n\nMore words.\n", "intro\n\n" + isc + "\n\n" + mit, mit.replace("\n\n", "\n"), "x" + mit])
    assert [x[0] for x in got] == [None, None, "MIT", None]
    assert [x[1] for x in got] == [["MIT"], ["ISC", "MIT"], ["MIT"], ["MIT"]]


@pytest.mark.skipif(not (SHARED / "GPL-3").exists(), reason="no published texts here")
def test_published_texts_are_known(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = [(SHARED / n).read_text(encoding="utf-8") for n in names]
    got = scan(spark, texts + [t.upper().replace(",", "  ") for t in texts] + [t[: len(t) // 2] for t in texts])
    assert [x[0] for x in got] == [*names.values()] * 2 + [None] * len(names)
    terms = texts[2][: texts[2].index("END OF TERMS AND CONDITIONS")]
    assert scan(spark, [terms])[0][0] == "GPL-3.0"


def test_known_wordings_do_not_clash(spark):
    known = licences.registry(spark).collect()
    assert len({(r.kind, r.digest) for r in known}) == len(known)
    assert sum(r.kind == "text" for r in known) == sum(map(len, licences.TEXTS.values())) + sum(map(len, licences.DIGESTS.values()))
    assert sum(r.kind == "block" for r in known) >= sum(map(len, licences.NOTICES.values()))


def test_edge_rows_empty_and_plan(spark, monkeypatch):
    out = licences.scan(edge_docs(spark).withColumn("licence", licences.F.lit("clash")))
    assert out.count() == len(edge_rows())
    assert licences.scan(empty_docs(spark)).collect() == []
    none = licences.registry(spark, {}, {}, {})
    assert licences.scan(edge_docs(spark), none).filter("licence is not null or size(notices) > 0").count() == 0
    monkeypatch.setattr(licences, "MOST_KNOWN", 3)
    with pytest.raises(ValueError, match="at most 3"):
        licences.scan(edge_docs(spark))


def test_every_notice_of_the_table_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: set(r.notices) for r in licences.scan(docs).collect()}
    marks = {"Apache License": "Apache-2.0", "MIT License": "MIT", "CC BY-NC": "CC-BY-NC-4.0", "GNU General": "GPL-3.0"}
    for r in docs.collect():
        assert got[r.doc_id] == {name for mark, name in marks.items() if mark in r.text}
    assert any(got.values())


def wrapped(text, width, start=""):
    """The text in lines of at most ``width``, each after ``start``; paragraphs stay apart."""
    lines = []
    for line in text.split("\n"):
        lines += textwrap.wrap(line, width) or [""]
    return "\n".join(start + x for x in lines)


@pytest.mark.parametrize("form", ["plain", "crlf", "comment"])
def test_whole_texts_at_every_width(spark, form):
    given = [(name, wrapped("Copyright (c) 2020, A. Person\nCopyright 2021 B. Person\n\n" * (width % 2) + t, width, "# " if form == "comment" else "")) for name, own in licences.TEXTS.items() for t in own for width in range(60, 81)]
    got = scan(spark, [t.replace("\n", "\r\n") if form == "crlf" else t for _, t in given])
    assert [x[0] for x in got] == [name for name, _ in given]


def test_what_is_a_notice(spark):
    isc = licences.TEXTS["ISC"][1]
    notices = ["Copyright 1999-2004 X", "copyright: (C) the authors", "(c) 2001 X", "© X", "Copyright <year> <owner>", "Copyright [yyyy] [name]", "Copyright The Regents. All rights reserved.", "All rights reserved.", "\nCopyright The Authors\n", "/* Copyright (c) 2020 X */"]
    kept = ["Copyright holders are many, (c) or not, in this text", "(c) a third item of a list", "the copyright 1999"]
    got = scan(spark, [f"{n}\n{isc}" for n in notices] + [f"{n}\n{isc}" for n in kept])
    assert [x[0] for x in got] == ["ISC"] * len(notices) + [None] * len(kept)
    pair = [licences.digest(licences.F.lit(x)) for x in ("a\nprovided that the above\ncopyright notice and this\n", "a provided that the above copyright notice and this")]
    assert spark.range(1).select(*pair).first()[0] == spark.range(1).select(*pair).first()[1]


def test_planted_texts_against_brute_force(spark, sf_dir):
    """Whole licences among the documents of the table: all are found by their whole text, and nothing else is."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    names = [(name, t) for name, own in licences.TEXTS.items() for t in own]
    planted = {10_000 + 100 * k + width: (name, wrapped(t.upper() if width % 3 else t, width)) for k, (name, t) in enumerate(names) for width in range(50, 100, 7)}
    df = spark.createDataFrame(rows + [(k, t) for k, (_, t) in planted.items()], "doc_id long, text string")
    got = {r.doc_id: r.licence for r in licences.scan(df).filter("whole").collect()}
    assert got == {k: name for k, (name, _) in planted.items()}
