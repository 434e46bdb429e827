"""License notices found by compression and confirmed by wording."""

import random
import textwrap

import pytest
from ripplenet.llm import licenses


def scanned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return licenses.scan_licenses(docs).collect()


def test_each_template_is_its_own_best_match(spark):
    texts = [f"Some words.\n{t}\nMore words." for t in licenses.TEMPLATES.values()]
    got = {r["doc_id"]: r for r in scanned(spark, texts)}
    for i, (name, template) in enumerate(licenses.TEMPLATES.items()):
        row = got[i]
        assert row["license"] == name and row["confirmed"] and (row["missing"], row["added"]) == ("", "")
        assert texts[i][row["start"] : row["end"]] == template.rstrip(".")


def test_wording_decides(spark):
    texts = [
        "Licensed under the Apache License, Version 3.0.",
        "licensed under the apache license version 2.0",
        "My license plate was stolen near the copyright office.",
        "This work is licensed under the GNU Public License, version 3.",
        None, "",
        "x" * 5000 + " Released under the MIT License. " + "y" * 5000,
    ]
    got = {r["doc_id"]: r for r in scanned(spark, texts)}
    assert not got[0]["confirmed"] and "3.0" in got[0]["added"] + got[0]["missing"] + " 3.0"
    assert got[1]["confirmed"] and got[1]["license"] == "Apache-2.0"
    assert 2 not in got or not got[2]["confirmed"]
    assert got[3]["confirmed"] and got[3]["missing"] == "general"
    assert 4 not in got and 5 not in got
    assert got[6]["confirmed"] and texts[6][got[6]["start"] : got[6]["end"]] == "Released under the MIT License"


def test_documents(spark, documents, odd_documents, no_documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    found = {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(documents).where("confirmed").collect()}
    want = {(i, n) for i, text in texts.items() for n, t in licenses.TEMPLATES.items() if t in text}
    assert want and want == found
    assert licenses.scan_licenses(odd_documents).collect() == [] and licenses.scan_licenses(no_documents).collect() == []


def confirmed(text):
    fixed = tuple(sorted([*licenses.TEMPLATES.items(), *licenses.WORDINGS]))
    return [(r[2], text[r[0] : r[1]]) for r in licenses.notices(text, fixed) if r[6]]


def prose(draw, n):
    words = "the river had been rising for days and nobody in town could say when a boat would come back with news of it".split()
    return " ".join(draw.choices(words, k=n // 4))


@pytest.mark.parametrize("around", [30, 200, 3000])
def test_notices_inside_prose(around):
    draw = random.Random(around)
    for name, template in licenses.TEMPLATES.items():
        assert confirmed(f"{prose(draw, around)} {template} {prose(draw, around)}") == [(name, template.rstrip("."))]


def test_every_notice_of_a_text():
    draw = random.Random(1)
    apache, mit = licenses.TEMPLATES["Apache-2.0"], licenses.TEMPLATES["MIT"]
    assert [n for n, _ in confirmed(f"{apache} {mit}")] == ["Apache-2.0", "MIT"]
    long = f"{apache} {prose(draw, 150)} {mit} {prose(draw, 900)} " * 30
    assert [n for n, _ in confirmed(long)] == ["Apache-2.0", "MIT"] * 30
    assert [n for n, _ in confirmed(f"{apache} {mit} " * 300)] == ["Apache-2.0", "MIT"] * 300


def test_wrapped_notices_bodies_and_spdx_names():
    for name, template in [*licenses.TEMPLATES.items(), *licenses.WORDINGS]:
        wrapped = "/*\n" + "\n".join(f" * {line}" for line in textwrap.wrap(template, 38)) + "\n */\nint main;"
        assert [n for n, _ in confirmed(wrapped)] == [name]
    assert [n for n, _ in confirmed("# SPDX-License-Identifier: (MIT OR GPL-3.0-or-later)\n")] == ["MIT", "GPL-3.0"]


SIBLINGS = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "BSD-2-Clause": dict(licenses.WORDINGS)["BSD-2-Clause"],
}


@pytest.mark.parametrize("name", SIBLINGS)
@pytest.mark.parametrize("around", ["{}", "Some words stand before it. {} And others stand behind it, for good measure."])
def test_a_sibling_license_is_never_confirmed_as_another(name, around):
    """With its own template a notice is found as such; without it no other license is confirmed in its place."""
    text = around.format(SIBLINGS[name])
    every = tuple(sorted([*licenses.TEMPLATES.items(), *licenses.WORDINGS]))
    found = licenses.notices(text, every)
    assert [(r[2], r[6]) for r in found if r[6]] == [(name, True)]
    others = tuple(t for t in every if t[0] != name)
    confirmed = {r[2] for r in licenses.notices(text, others) if r[6]}
    # The sentence that all licenses of the family begin with is a template of one of them.
    assert confirmed <= ({"BSD-3-Clause"} if name == "BSD-2-Clause" else set())


def test_spdx_names_without_a_template_and_templates_without_a_cue():
    every = tuple(sorted([*licenses.TEMPLATES.items(), *licenses.WORDINGS]))
    line = "# SPDX-License-Identifier: BSD-2-Clause OR EUPL-1.2 WITH Classpath-exception-2.0"
    assert [r[2] for r in licenses.notices(line, every)] == ["BSD-2-Clause", "EUPL-1.2"]
    own = (("Own-1", "Everybody may frobnicate these gizmos freely and forever."),)
    text = "words " * 300 + own[0][1] + " words" * 300
    (row,) = licenses.notices(text, own)
    assert text[row[0] : row[1]] == own[0][1].rstrip(".") and row[2] == "Own-1" and row[6]


def test_templates_of_the_caller_are_found_in_a_table(spark):
    docs = spark.createDataFrame([(1, "x Everybody may frobnicate these gizmos freely and forever. y"), (2, "none here"), (None, None)], "doc_id bigint, text string")
    rows = licenses.scan_licenses(docs, {"Own-1": "Everybody may frobnicate these gizmos freely and forever."}).collect()
    assert [(r["doc_id"], r["license"], r["confirmed"]) for r in rows] == [(1, "Own-1", True)]
