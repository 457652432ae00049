import re

import pytest
from lexiweave.llm import license
from pyspark.sql import functions as F

from .conftest import ODD

APART = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    w = [x for x in APART.split((text or "").translate(LOWER)) if x]
    at, base = [], set()
    for phrase, label in license.BASE.items():
        f = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(f)] == f:
                at.append(i)
                base.add(label)
    norm = "".join(f" {x} " for x in w)
    found = []
    for number, label, keyword, priority, pattern in license.rules():
        if " " + "  ".join(keyword.split()) + " " in norm:
            for m in re.finditer(pattern, norm):
                start = norm[: m.start()].count(" ") // 2
                found.append((start, -(start + m.group().count(" ") // 2), -priority, number, label))
    found.sort()
    stand = [x for k, x in enumerate(found) if not any(y[1] <= x[1] and y[2] <= x[2] for y in found[:k])]
    labels = base | {x[4] for x in stand}
    score = max([1.0] * bool(at) + [license.CONFIDENCE[-x[2]] for x in stand], default=0.0)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


TEXTS = [
    *ODD, "Licensed under the Apache License, Version 2.0.", "apache license 2.0 and apache license", "GNU General Public License version 3 or later", "SPDX-License-Identifier: MIT",
    "mit license " * 400, "the mit license apache license version 2 0 gnu gpl v3 general public license", "Licensed under CC BY-NC 4.0. All rights reserved.", "CC-BY-SA-3.0 creative commons",
    "mitK license", "mıt license", "Redistribution and use in source and binary forms, with or without modification, are permitted", "No warranty. Copyright (c) 2020", "MITé license", "mit\nlicense",
    "this is free and unencumbered software released into the public domain", "a license of mit", "do what the fork you want to public license",
]
COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def test_against_brute_force(docs):
    df = docs(TEXTS).withColumn("labels", F.lit("own")).withColumn("k1", F.lit(1))
    out = license.scan(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "k1", *COLUMNS]
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in out.collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == brute(t), t


def test_rules_are_many_and_compile():
    assert len(license.rules()) > 250
    for *_, pattern in license.rules():
        re.compile(pattern)


@pytest.mark.parametrize("rows", [[], [None], [(None, "mit license"), (None, "mit license")]], ids=str)
def test_empty_null_and_repeated(docs, rows):
    got = license.scan(docs(rows)).collect()
    assert [r["n_base"] for r in got] == [brute(r[1] if isinstance(r, tuple) else r)[1] for r in rows]


def test_no_python_in_the_plan(docs):
    plan = license.scan(docs(TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


UNGATED = [
    "Licensed under GPLv3", "GPLv2", "LGPLv3", "LGPLv2.1", "AGPLv3", "FreeBSD License", "SPDX-License-Identifier: 0BSD", "https://creativecommons.org/licenses", "OpenRAIL", "OpenRAIL-M license", "open rail m",
    "for noncommercial use only", "for non-commercial use only", "SPDX-License-Identifier: BSL-1.0", "SPDX-License-Identifier: PSF-2.0", "MS-PL", "MS-RL", "SPDX-License-Identifier: GFDL-1.3",
    "Redistributions of source code must retain the above copyright notice", "under the same terms as Perl itself", "berkeley software distribution", "opendatacommons.org/licenses/odbl",
]


def test_no_keyword_loses_a_match(docs):
    """Each text has one rule's match and little else; rules are tried here without keywords."""
    got = {r["text"]: r["labels"].split(",") for r in license.scan(docs(UNGATED)).collect()}
    for t in UNGATED:
        norm = "".join(f" {x} " for x in APART.split(t.translate(LOWER)) if x)
        found = [(len(m.group()), -n, label) for n, label, _, _, p in license.rules() for m in re.finditer(p, norm)]
        assert found and max(found)[2] in got[t], t


def test_keywords_are_in_all_that_patterns_say():
    """Every way to leave out or choose a part of a pattern has the keyword."""
    import itertools
    for *_, keyword, _, pattern in license.rules():
        parts = re.split(r"(\([^()]*\)\??|\[sc\]|\w\?)", pattern.strip().replace(".{1,80}", "x").replace("[0-9]{4}", "2020").replace("[a-z]{3}", "ork"))
        ways = [[*x[1 : x.rindex(")")].split("|"), *[""] * x.endswith("?")] if x[:1] == "(" else ["s", "c"] if x == "[sc]" else [x[0], ""] if x.endswith("?") and x else [x] for x in parts]
        for way in itertools.product(*ways):
            text = " " + "".join(way).strip() + " "
            if re.fullmatch(pattern, text):
                assert " " + "  ".join(keyword.split()) + " " in text, (keyword, text)
