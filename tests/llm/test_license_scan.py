import random
import textwrap

from lorespark.llm import license_scan as ls

PROSE = ["the river ran past a mill", "licence plates are issued by the state", "he was under the table with a version of events", "public opinion, in general, changed", "a work of art"]


def test_held_out_accuracy_and_calibration():
    rnd = random.Random(1)
    background = [" ".join(rnd.choices(" ".join(PROSE).split(), k=12)) for _ in range(300)]
    weights, temperature, accuracy = ls.train(background)
    assert accuracy >= 0.95 and temperature > 0
    assert weights.shape == (ls.DIMS, len(ls.FAMILIES))


def test_rows(spark):
    notices = {"mit": "Released under the MIT License.", "apache": "Licensed under the Apache License, Version 2.0.", "gpl": "This work is licensed under the GNU General Public License, version 3.", "cc-by-nc": "Licensed under CC BY-NC 4.0.", "cc-by": "Licensed under CC BY 4.0"}
    rnd = random.Random(2)
    rows, want = [], {}
    for i in range(60):
        lines = [" ".join(rnd.choices(" ".join(PROSE).split(), k=rnd.randrange(3, 30))) for _ in range(rnd.randrange(1, 5))]
        family = rnd.choice([None, None, *notices])
        spans = ""
        if family:
            at = rnd.randrange(len(lines) + 1)
            lines.insert(at, "  " + notices[family].upper() if i % 3 == 0 else notices[family])
            start = sum(len(x) + 1 for x in lines[:at]) + (2 if i % 3 == 0 else 0)
            spans = f"{family}:{start}:{start + len(notices[family])}"
        rows.append((i, "é".join(["", "\n".join(lines)]) if i % 5 == 0 and not family else "\n".join(lines), "x"))
        want[i] = (len(lines), 1 if family else 0, family or "", spans)
    rows += [(90, None, "x"), (91, "", "x"), (92, " \n\n", "x"), (93, "word " * 60_000, "x"), rows[0]]
    want |= {90: (0, 0, "", ""), 91: (0, 0, "", ""), 92: (0, 0, "", ""), 93: (1, 0, "", "")}
    got = ls.license_scan(spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == want[r["doc_id"]], r


def test_empty(spark):
    assert ls.license_scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_wrapped_and_bare_notices(spark):
    rnd = random.Random(3)
    rows, want = [], {}
    for family, notices in ls.TEMPLATES.items():
        for notice in notices:
            for width, mark in ((30, ""), (50, "# "), (70, " * ")):
                wrapped = textwrap.wrap(notice, width, break_long_words=False, break_on_hyphens=False)
                before, after = ([" ".join(rnd.choices(" ".join(PROSE).split(), k=9)) for _ in range(rnd.randrange(3))] for _ in range(2))
                lines = [mark + x for x in wrapped]
                text = "\n".join([*before, *lines, *after])
                start = sum(len(x) + 1 for x in before) + len(mark) - len(mark.lstrip())
                want[len(rows)] = (1, family, f"{family}:{start}:{start + len(chr(10).join(lines).strip())}")
                rows.append((len(rows), text))
    rows += [(900, "All rights reserved."), (901, "All rights\n\nreserved"), (902, "Released under the MIT License.\nAll rights reserved."), (903, None)]
    want |= {900: (1, "proprietary", "proprietary:0:20"), 901: (0, "", ""), 902: (2, "mit,proprietary", "mit:0:31,proprietary:32:52"), 903: (0, "", "")}
    got = ls.license_scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    wrong = [(r["doc_id"], tuple(r)[2:], want[r["doc_id"]], dict(rows)[r["doc_id"]]) for r in got if tuple(r)[2:] != want[r["doc_id"]]]
    assert not wrong, wrong


def families(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(PROSE * 20)]
    got = {r["doc_id"]: r["families"] for r in ls.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[1000 + i] == "" for i in range(len(PROSE) * 20))
    return [got[i] for i in range(len(texts))]


def test_notices_that_share_their_wording(spark):
    texts = {
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation": "lgpl",
        "SPDX-License-Identifier: LGPL-2.1-only": "lgpl", "SPDX-License-Identifier: AGPL-3.0-or-later": "agpl", "SPDX-License-Identifier: BSD-2-Clause": "bsd", "SPDX-License-Identifier: CC-BY-4.0": "cc-by",
        "This project is licensed under the terms of the MIT license.": "mit", "Released under the GNU GPL v2": "gpl", "This code is licensed under the GPLv3.": "gpl", "Released under the ISC License": "isc",
        "Licensed under the Eclipse Public License": "epl", "Tous droits réservés": "proprietary", "Alle Rechte vorbehalten.": "proprietary",
    }
    assert families(spark, texts) == list(texts.values())


def test_phrasings_that_no_template_holds(spark):
    """Held out whole: no notice has 0.7 of their pairs, so what finds them is the classifier."""
    texts = {
        "An MIT license covers all of it.": "mit", "Distribution is governed by an Apache License.": "apache", "See our Mozilla Public License notice.": "mpl",
        "It comes with a BSD license.": "bsd", "The GNU Lesser General rules hold for this library.": "lgpl", "It uses the ISC license": "isc",
    }
    assert not any(ls.confirmed(k, t, 0.7) for t in texts for k in range(len(ls.TEMPLATES)))
    found = families(spark, texts)
    right = sum(a == b for a, b in zip(found, texts.values()))
    assert right >= 4 and all(a in (b, "") for a, b in zip(found, texts.values()))
