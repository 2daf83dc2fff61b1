import random
import re
from collections import Counter

from odd import with_odd

from fleetlake.llm.license_scan import Templates, scan_licenses
from fleetlake.llm.licenses import TEMPLATES

SHORT = {t: n for n, t in TEMPLATES if len(t) < 80}


def test_every_statement_is_found_in_place(spark):
    docs = with_odd(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    want = Counter()
    for r in docs.collect():
        for text, name in SHORT.items():
            for m in re.finditer(rf"(?:^|(?<=[.!?:;]\s)){re.escape(text)}(?=\s|$)", r.text or "", re.M):
                want[(r.doc_id, name, m.start(), m.end())] += 1
    got = scan_licenses(docs)
    exact = Counter((r.doc_id, r.license, r.start, r.end) for r in got.collect() if r.n_different == 0)
    assert len(want) > 20 and exact == want
    assert scan_licenses(docs.limit(0)).count() == 0


def test_notices_over_lines_with_small_changes():
    known = Templates(TEMPLATES)
    mit = next(t for n, t in TEMPLATES if n == "MIT" and len(t) > 100)
    wrapped = "Some code\n" + "\n".join(mit[i:i + 70] for i in range(0, 0)) + re.sub(r"(.{60,75}) ", r"\1\n", mit) + "\nThe end."
    found = known.scan(wrapped)
    assert [f["license"] for f in found] == ["MIT"] and not found[0]["differences"]
    changed = mit.replace("free of charge, ", "").replace("person", "company")
    found = known.scan(changed)
    assert [f["license"] for f in found] == ["MIT"] and "+company" in found[0]["differences"] and "-charge" in found[0]["differences"]


def test_numbers_and_names_must_agree():
    known = Templates(TEMPLATES)
    for text, want in (
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
        ("This work is licensed under the GNU General Public License, version 1.", []),
        ("Licensed under CC BY-ND 4.0.", ["CC-BY-ND-4.0"]), ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]),
        ("Licensed under CC BY-XY 4.0.", []), ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", ["GPL-3.0"]),
        ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", ["LGPL-3.0"]), ("Apache License Version 2.0, January 2004", ["Apache-2.0"]),
        ("all tools are licensed under the BSD 3-Clause License", ["BSD-3-Clause"]), ("this is licensed under GPLv3", ["GPL-3.0"]),
        ("this is licensed under GPLv4", []),
        ("ALL RIGHTS RESERVED.", ["LicenseRef-Proprietary"]), ("All animals reserved seats.", []),
        ("Copyright is a word about licenses and permission.", []), ("", []), (None, []),
    ):
        assert [f["license"] for f in known.scan(text)] == want, text


def test_savings_rank_the_right_template_first():
    known = Templates(TEMPLATES)
    for k, (name, text) in enumerate(TEMPLATES):
        saved, best = known.savings(text)[0]
        assert known.names[best] == name and saved > 0.4


def test_notices_behind_other_words():
    rng, known = random.Random(5), Templates(TEMPLATES)
    plain = "river stone walked under green mountain slowly with seven children and another basket of quiet morning".split()
    notice = "licensed under the Apache License, Version 2.0."
    for n in (0, 5, 10, 50, 5000):
        for tail in ("", " " + " ".join(rng.choices(plain, k=n))):
            text = " ".join([*rng.choices(plain, k=n), notice]) + tail
            at = text.index(notice)
            assert [(f["license"], f["start"], f["end"], f["differences"]) for f in known.scan(text)] == [("Apache-2.0", at, at + len(notice), [])], (n, tail)
    text = "The sources in this folder and all their documentation are licensed under the Apache License, Version 2.0."
    assert [f["license"] for f in known.scan(text)] == ["Apache-2.0"]
    text = "Our tools are licensed under the Apache License, Version 2.0, the images and the manual were released under the MIT License by their authors"
    assert [f["license"] for f in known.scan(text)] == ["Apache-2.0", "MIT"]
    text = "Whoever wrote the river walk tools in spring has\nhad them licensed under the Apache\nLicense, Version 2.0. and the stones went home slowly"
    assert [(f["license"], f["differences"]) for f in known.scan(text)] == [("Apache-2.0", [])]


def test_more_licences_and_neighbours():
    known = Templates(TEMPLATES)
    two = ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n"
           "1. Redistributions of source code must retain the above copyright notice,\nthis list of conditions and the following disclaimer.\n"
           "2. Redistributions in binary form must reproduce the above copyright notice,\nthis list of conditions and the following disclaimer in the documentation\n"
           "and/or other materials provided with the distribution.\n")
    three = two + ("3. Neither the name of the copyright holder nor the names of its contributors\nmay be used to endorse or promote products derived from this software\n"
                   "without specific prior written permission.\n")
    gnu = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    for text, want in (
        (two, {"BSD-2-Clause"}), (three, {"BSD-3-Clause"}), (two.replace("1. ", "").replace("2. ", ""), {"BSD-2-Clause"}),
        (two.split("\n\n")[0], {"LicenseRef-BSD"}), ("Licensed under the MIT License.", {"MIT"}), ("MIT License", {"MIT"}), ("All of this is under the MIT License", {"MIT"}),
        ("// SPDX-License-Identifier: GPL-2.0-only", {"GPL-2.0-only"}), ("SPDX-License-Identifier: ISC", {"ISC"}), ("SPDX-License-Identifier: Foo-1.0", set()),
        (gnu.format(""), {"GPL-3.0-or-later"}), (gnu.format("Affero "), {"AGPL-3.0-or-later"}), (gnu.format("Lesser "), {"LGPL-3.0-or-later"}),
        ("This is free and unencumbered software released into the public domain.", {"Unlicense"}),
        ("This work is licensed under a Creative Commons Attribution-NoDerivatives 3.0 Unported License.", {"CC-BY-ND-3.0"}),
        ("SPDX-License-Identifier: MIT\nThe code is licensed under the Apache License, Version 2.0.\nLicensed under CC BY 4.0.\n" + gnu.format(""),
         {"MIT", "Apache-2.0", "CC-BY-4.0", "GPL-3.0-or-later"}),
    ):
        assert {f["license"] for f in known.scan(text)} == want, text
