import re

from procsight.llm import licenses
from procsight.llm.queries import op5_license_scan
from tests.conftest import SF
from tests.llm.frames import AWKWARD, docs


def named(scanner, text):
    return [x[1] for x in scanner.places(text)]


def test_each_notice_gives_its_license_within_other_words():
    scanner = licenses.Scanner(licenses.NOTICES)
    for name, notice in licenses.NOTICES.items():
        for block in (notice, notice.upper(), f"Some words. {notice} And more words.", notice.replace(" ", "  ")):
            assert named(scanner, block) == [name]
    assert named(scanner, "The license of this text is unknown, ask for permission.") == []
    assert named(scanner, "Licensed under the Apache License, Version 1.1.") == []


def test_ranking_puts_the_own_notice_first():
    scanner = licenses.Scanner(licenses.NOTICES)
    for name, notice in licenses.NOTICES.items():
        assert scanner.templates[scanner.ranked(tuple(licenses.words(notice)), False)[0][1]][0] == name


def test_the_query_goes_by_the_ranking(monkeypatch):
    """Every place that is found was ranked; without savings nothing is."""
    scanner = licenses.Scanner(licenses.NOTICES, licenses.TEXTS)
    text = "Some page.\n" + licenses.TEXTS["MIT"][0] + "\nReleased under the MIT License.\nLicensed under CC BY 4.0."
    seen = []
    whole = scanner.ranked
    scanner.ranked = lambda block, long: seen.append((long, whole(block, long))) or seen[-1][1]
    assert named(scanner, text) == ["MIT", "MIT", "CC-BY-4.0"]
    assert {long for long, _ in seen} == {False, True}
    assert all([-x[0] for x in found] == sorted(-x[0] for x in found) for _, found in seen)
    scanner.ranked = lambda block, long: []
    assert named(scanner, text) == []


def test_short_forms_lists_and_later_licenses():
    scanner = licenses.Scanner(licenses.NOTICES, licenses.TEXTS)
    page = "Mit der Zeit und mit anderen Worten.\n{}\nAnd what follows on this page, with more of it."
    for text, want in [
        ("GNU General Public License v3", ["GPL-3.0"]), ("GNU General Public License v3.0", ["GPL-3.0"]),
        ("This code is licensed under GPLv3", ["GPL-3.0"]), ("licensed under AGPLv3", ["AGPL-3.0"]), ("License: MIT", ["MIT"]),
        ("# License: Apache-2.0", ["Apache-2.0"]), ("Licensed under CC BY-NC-SA 4.0.", ["CC-BY-NC-SA-4.0"]), ("CC BY-NC-SA 4.0", ["CC-BY-NC-SA-4.0"]),
        ("it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", ["GPL-2.0"]),
        (" * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License"
         " version 2 as\n * published by the Free Software Foundation.", ["GPL-2.0"]),
        ("Eclipse Public License - v 2.0", ["EPL-2.0"]), ("Boost Software License - Version 1.0 - August 17th, 2003", ["BSL-1.0"]),
        ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"]),
        ("// SPDX-License-Identifier: (MIT OR Apache-2.0)", ["Apache-2.0", "MIT"]),
        ("SPDX-License-Identifier: GPL-2.0-only AND BSD-3-Clause OR MIT", ["BSD-3-Clause", "GPL-2.0", "MIT"]),
        ("Das Auto fährt mit Licht, mit Lizenz.", []), ("the license of mit people", []),
    ]:
        assert sorted(named(scanner, page.format(text))) == want, text


def test_blocks_hold_every_place_whole():
    text = ["word"] * 3000
    for p in (0, 700, 900, 1100, 1300, 2999):
        text[p] = "license"
    for sizes in (licenses.SHORT_BLOCK, licenses.LONG_BLOCK):
        found = licenses.blocks(text, *sizes)
        assert all(0 <= a < b <= 3000 and b - a <= sizes[2] for a, b in found)
        for p in (0, 700, 900, 1100, 1300, 2999):
            begin, end = max(0, p - sizes[0]), min(3000, p + sizes[1])
            for k in range(begin, max(begin + 1, end - sizes[2] // 2 + 1)):
                assert any(a <= k and min(k + sizes[2] // 2, end) <= b for a, b in found)


def test_differences_are_exact():
    missing, extra = licenses.difference("x licensed under the new Apache License, 2.0 y", "Licensed under the Apache License, Version 2.0.")
    assert missing == ["version"] and extra == ["new"]


def test_awkward_rows(spark):
    lines = [(20, "a\nReleased under the MIT License.\nb\nLicensed under CC BY-NC 4.0."), (21, "Released under the MIT License."), (21, "Released under the MIT License.")]
    lines.append((22, "word " * 30_000 + "\nThis file is licensed under the Apache License, Version 2.0."))
    found = licenses.scan(docs(spark, AWKWARD + lines)).collect()
    assert sorted((r.doc_id, r.line, r.license) for r in found) == [
        (20, 1, "MIT"), (20, 3, "CC-BY-NC-4.0"), (21, 0, "MIT"), (21, 0, "MIT"), (22, 1, "Apache-2.0"),
    ]
    assert licenses.scan(docs(spark, [])).count() == 0


def test_whole_table(spark):
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for i, line in enumerate(r.text.split("\n")):
            want += [(r.doc_id, i, k) for k, v in licenses.NOTICES.items() if re.search(re.escape(v), line)]
    assert sorted((r.doc_id, r.line, r.license) for r in op5_license_scan(spark, SF).collect()) == sorted(want)


def wrapped(text, width, mark=""):
    out, line = [], ""
    for w in text.split():
        if line and len(line) + len(w) >= width:
            out.append(line)
            line = ""
        line += (" " if line else "") + w
    return "\n".join(f"{mark}{x}" for x in [*out, line])


def test_wrapped_notices_headers_and_bodies(spark):
    rows, want = [], []
    for name, own in licenses.NOTICES.items():
        for text in [own, *licenses.TEXTS[name]]:
            for width, mark in ((18, ""), (30, "# "), (72, " * "), (10_000, "")):
                place = wrapped(text, width, mark)
                i = len(rows)
                rows.append((i, f"Some words of the page.\nMore words of this file\n{place}\nand the end of the page."))
                want.append((i, 2, name))
    found = sorted((r.doc_id, r.line, r.license) for r in licenses.scan(docs(spark, rows)).collect())
    assert found == want


def test_texts_with_names_and_list_numbers():
    scanner = licenses.Scanner(licenses.NOTICES, licenses.TEXTS)
    mit, bsd3, bsd2, gpl = (licenses.TEXTS[n][0] for n in ("MIT", "BSD-3-Clause", "BSD-2-Clause", "GPL-2.0"))
    for text, name in [
        ("Copyright (c) 2020 Some Holder\n\n" + wrapped(mit, 75).replace("The above copyright", "\n\nThe above copyright"), "MIT"),
        (wrapped(bsd3.replace("Redistributions", "1. Redistributions").replace("the copyright holder nor", "Some Company nor"), 70, "// "), "BSD-3-Clause"),
        (wrapped(bsd2.replace("Redistributions", "* Redistributions"), 70), "BSD-2-Clause"),
        (wrapped(gpl.replace("This program is free", "Foobar is free"), 70, "; "), "GPL-2.0"),
    ]:
        assert [x[1] for x in scanner.places(text)] == [name]
    # Another version and other words are no license of the list.
    assert scanner.places(wrapped(gpl.replace("version 2", "version 1"), 70)) == []
    assert scanner.places("Permission is hereby granted to nobody.\nAll rights reserved.\nCopyright 2020.") == []
    assert scanner.places("Licensed under the Apache License,\nVersion 1.1.") == []
