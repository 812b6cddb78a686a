from clinframe.llm import licenses


def scanned(spark, rows, catalogue=None):
    docs = spark.createDataFrame(rows, "doc_id long, text string, license_id string")
    return [(r.doc_id, r.license_id_, r.line_licenses) for r in licenses.scan(docs, catalogue).collect()]


def test_variants(spark):
    mit = licenses.KNOWN["MIT"]
    shouted = "The MIT text\n".join(["", ""]) + "Copyright (c) 2001-2004 Somebody <x@y.z>\nAll rights reserved.\n\n  * " + mit.upper().replace("SUBLICENSE", "Sub-Licence").replace("\n", "\n  * ").replace('"', "``")
    rows = [
        (1, mit, ""), (2, "© 1999 A\n(c) 2000 B\n" + mit.replace("\n", " "), ""), (3, shouted.replace("The MIT text\n", ""), ""), (4, mit + " Not.", ""), (5, mit[:-20], ""),
        (6, "Some text.\n-- Licensed under CC BY-NC 4.0. --\nreleased under the mit licence\n", ""), (7, None, None), (8, "\n ...", ""), (1, mit, ""), (None, licenses.KNOWN["Zlib"], ""),
    ]
    got = scanned(spark, rows)
    assert sorted(got, key=str) == sorted([
        (1, "MIT", ""), (1, "MIT", ""), (2, "MIT", "MIT"), (3, "MIT", ""), (4, None, ""), (5, None, ""), (6, None, "CC-BY-NC-4.0 notice,MIT notice"),
        (7, None, ""), (8, None, ""), (None, "Zlib", ""),
    ], key=str)


def test_all_known_are_found(spark):
    rows = [(i, "Copyright 2020 The Authors\n\n" + t, "") for i, t in enumerate(licenses.KNOWN.values())]
    assert {r[0]: r[1] for r in scanned(spark, rows)} == dict(enumerate(licenses.KNOWN))


def test_empty(spark):
    assert scanned(spark, []) == []
    none = spark.createDataFrame([], "license_id string, text string")
    assert scanned(spark, [(1, "x", "")], none) == [(1, None, "")]
    assert scanned(spark, [(1, "word " * 200_000, "")]) == [(1, None, "")]


def test_large_catalogue(spark, monkeypatch):
    monkeypatch.setattr(licenses.common, "BROADCAST_BYTES", 0)
    assert scanned(spark, [(1, "Licensed under CC BY 4.0", ""), (2, "x", "")])[0][1:] is not None
    assert sorted(scanned(spark, [(1, "Licensed under CC BY 4.0", ""), (2, "x", "")])) == [(1, "CC-BY-4.0 notice", "CC-BY-4.0 notice"), (2, None, "")]


def test_titles_bullets_and_clashing_names(spark):
    k = licenses.KNOWN
    texts = [
        ("MIT", "MIT License\n\nCopyright (c) 2020 A\n\n" + k["MIT"]), ("MIT", "The MIT License (MIT)\nCopyright © 2019 B\n" + k["MIT"]), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + k["BSD-2-Clause"].replace("1. ", "* ").replace("2. ", "* ")),
        ("BSD-3-Clause", "Copyright 2001 C. All rights reserved.\n\n" + k["BSD-3-Clause"].replace("1.", "(a)").replace("2.", "(b)").replace("3.", "(c)")), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + k["BSL-1.0"]),
        ("ISC", "ISC License\n" + k["ISC"]), (None, "A License\n"), (None, "A remark.\n" + k["MIT"]),
    ]
    docs = spark.createDataFrame([(i, t, "x", 7, "y") for i, (_, t) in enumerate(texts)], "doc_id long, text string, scan_text string, scan_doc int, digest string")
    got = {r.doc_id: (r.license_id, r.scan_text, r.scan_doc, r.digest) for r in licenses.scan(docs).collect()}
    assert got == {i: (want, "x", 7, "y") for i, (want, _) in enumerate(texts)}


def test_catalogue_of_a_folder(spark, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("Own License\n\nDo what is right, and only that.")
    docs = spark.createDataFrame([(1, "do what is right and only that")], "doc_id long, text string")
    assert licenses.scan(docs, licenses.read_catalogue(spark, str(tmp_path))).first().license_id == "Own-1.0"


def test_what_is_no_title_counts(spark):
    """Probes both ways: the whole text is found in all its shapes, and nothing that lacks a sentence of it."""
    notice = (
        'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\n'
        "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law, software\nis distributed on an \"AS IS\" BASIS.\n"
    )
    catalogue = licenses.default_catalogue(spark).unionByName(spark.createDataFrame([("Apache notice", notice, None)], "license_id string, text string, names array<string>"))
    k = licenses.KNOWN
    curly = k["MIT"].replace('"Software"', "“Software”").replace('"AS IS"', "‘AS IS’").replace("and/or", "and / or")
    texts = [
        ("Apache notice", notice), ("Apache notice", " ".join(notice.split())), ("Apache notice", "Copyright 2020 A\n\n" + notice.upper()), (None, notice.split("\n", 1)[1]), (None, "License\n" + notice.split("\n", 1)[1]),
        ("MIT", curly), ("MIT", "Copyright Jane Doe\n\n" + k["MIT"]), ("MIT", "MIT License\nCopyright (c) 2020 Jane Doe,\n  John Doe\n  and others\n\n" + k["MIT"]), ("MIT", "Copyright by the Authors and\ncontributors, 2001.\n" + k["MIT"]),
        (None, "Apache License\n\n" + k["MIT"]), (None, "Not the MIT License\n\n" + k["MIT"]), (None, k["MIT"].replace("notice and this", "notice")), (None, k["MIT"].split(". ", 1)[1]), (None, "The above copyright notice\n" + k["MIT"]),
        ("BSD-3-Clause", 'BSD 3-Clause "New" or "Revised" License\n© 2001 C\n' + k["BSD-3-Clause"]), ("0BSD", "BSD Zero Clause License\n\n" + k["0BSD"]), ("Unlicense", "The Unlicense (Unlicense)\n" + k["Unlicense"]),
        # Lines may break before any word, such as copyright.
        ("BSD-2-Clause", "\n".join(k["BSD-2-Clause"].replace("copyright", "\ncopyright").replace("COPYRIGHT", "\nCOPYRIGHT").split("\n"))),
    ]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.license_id for r in licenses.scan(docs, catalogue).collect()} == dict(enumerate(w for w, _ in texts))


def test_long_texts_are_found_whatever_their_breaks(spark):
    long = {k: v for k, v in licenses.known_texts().items() if k not in licenses.KNOWN}
    assert sorted(long) == ["Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"]
    rows = [(i, t) for i, t in enumerate(long.values())] + [(100 + i, "\n".join(x.strip() for x in t.split("\n"))) for i, t in enumerate(long.values())]
    rows += [(200 + i, t.replace(" not ", " ", 1)) for i, t in enumerate(long.values())]
    got = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i + d: (k if d < 200 else None) for i, k in enumerate(long) for d in (0, 100, 200)}


def test_helper_names_in_both_joins(spark, monkeypatch):
    rows = [(1, licenses.KNOWN["MIT"], 1, "a", "b", 2), (2, "Licensed under CC BY 4.0", 1, "a", "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key0 long, _salt string, scan_words string, __salt_r int")
    for most in (32 << 20, 0):
        monkeypatch.setattr(licenses.common, "BROADCAST_BYTES", most)
        got = sorted(map(tuple, licenses.scan(docs).drop("text_digest").collect()))
        assert got == [(1, 1, "a", "b", 2, "MIT", ""), (2, 1, "a", "b", 2, "CC-BY-4.0 notice", "CC-BY-4.0 notice")]
