import pytest

from vectrine.llm import licenses

MIT = licenses.SENTENCES["mit_grant"] + ":\n\n" + licenses.SENTENCES["mit_notice"] + ".\n"
BSD = ".\n".join(licenses.SENTENCES[k] for k in ("bsd_intro", "bsd_source", "bsd_binary"))


def wrap(text, width=60):
    import textwrap

    return "\n".join(textwrap.wrap(text, width))


CASES = [
    ("Copyright 2020 X.\nLicensed under CC BY-NC 4.0.\nText.", "CC-BY-NC-4.0", "CC-BY-NC-4.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0", "GPL-3.0"),
    ("Some prose. Released under the  MIT   License! More", "MIT", "MIT"),
    ("All rights reserved.", "All-rights-reserved", "All-rights-reserved"),
    ("Title\n\n" + wrap(licenses.SENTENCES["mit_grant"] + ":") + "\n\n" + wrap(licenses.SENTENCES["mit_notice"] + "."), "MIT", "MIT"),
    (BSD + ".", "BSD-2-Clause", "BSD-2-Clause"),
    (BSD + ".\n" + licenses.SENTENCES["bsd_endorse"] + ".", "BSD-3-Clause", "BSD-3-Clause"),
    ("This program is free software; " + licenses.SENTENCES["gpl_terms"] + "; " + licenses.SENTENCES["gpl2_later"] + ".", "GPL-2.0-or-later", "GPL-2.0-or-later"),
    ("All rights reserved.\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License.", "MIT", "MIT Apache-2.0 All-rights-reserved"),
    ("SPDX-License-Identifier: MPL-2.0", None, ""),
    ("He was licensed to drive. The rights were reserved for all.", None, ""),
    (None, None, ""),
    ("", None, ""),
    ("x " * 50_000 + "\nAll rights reserved.", "All-rights-reserved", "All-rights-reserved"),
]


def test_cases(spark):
    docs = spark.createDataFrame([(i, t, "c") for i, (t, _, _) in enumerate(CASES)] + [(None, "All rights reserved", "c")], "doc_id long, text string, license string")
    got = {r.doc_id: r for r in licenses.recognised(docs).collect()}
    for i, (text, first, found) in enumerate(CASES):
        assert (got[i].license, got[i].licenses) == (first, found), (text or "")[:80]
    assert got[None].n_known == 1
    assert licenses.recognised(docs.limit(0)).count() == 0


MIXED = [
    ("Released\nunder the GPL 3.0.", "ref_gpl_3_0"),
    ("Made available\n\nDistributed\tunder the  MIT.\nAvailable  under the Apache 2.0!", "ref_mit ref_apache_2_0"),
    (wrap(licenses.SENTENCES["isc_grant"] + ".") + "\nAll rights reserved\n(C) X", "isc_grant reserved"),
    ("Mine\nAll rights reserved\nyours\n\n" + wrap(licenses.SENTENCES["isc_grant"] + ".") + "\nReleased under the MIT License\nx", "reserved isc_grant ref_mit"),
    (licenses.SENTENCES["gpl3_later"].replace("Foundation, ", "Foundation,\n"), "gpl3_later"),
]


def test_wrapped_and_other_sentences_in_one_text(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(MIXED)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.recognised(docs).collect()}
    assert [got[i].sentence_ids for i in range(len(MIXED))] == [ids for _, ids in MIXED]
    assert got[3].licenses == "ISC MIT All-rights-reserved"


def test_every_known_sentence_is_its_own_normal_form():
    for sentence in licenses.identifiers():
        assert licenses.normalise(sentence) == sentence


@pytest.mark.parametrize("way", ["{}.", "Intro.\n{}\nOutro", "{} "])
def test_every_known_sentence_is_found(spark, way):
    known = list(licenses.identifiers().items())
    docs = spark.createDataFrame([(i, way.format(s)) for i, (s, _) in enumerate(known)], "doc_id long, text string")
    got = {r.doc_id: r.sentence_ids for r in licenses.recognised(docs).collect()}
    assert [got[i] for i in range(len(known))] == [i for _, i in known]
