"""Licence recognition by sentences and rules, in DataFrame functions only.

A text is read as sentences twice: first, for sentences that are wrapped, with only empty lines as boundaries and
other line ends as spaces, then, where such a sentence is not known, with each of its line ends as a boundary. What
both readings find stands in the order of the text. Sentences are normalised to lower-case words. Known licence
sentences map to identifiers; what is left of a text is a short sequence of identifiers, which ordered
rules take apart: the first rule whose sequence occurs takes its identifiers away, the next sees the rest.

Only texts that hold one of STEMS are split; every known sentence holds one, so that no text is missed.

Nulls and empty texts have no sentences and no licence. Repeated rows get equal results; a doc_id is only
passed through. A very long text is split whole, in memory of some times its size. No other column is read, whatever
its name; no rows in, no rows out.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Licence names as sentences write them, and their identifiers.
NAMES = {
    "MIT": ("mit license", "mit"),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0"),
    "GPL-2.0": ("gnu general public license version 2", "gnu general public license v2 0", "gnu gpl v2", "gpl 2 0"),
    "GPL-3.0": ("gnu general public license version 3", "gnu general public license v3 0", "gnu gpl v3", "gpl 3 0"),
    "LGPL-2.1": ("gnu lesser general public license version 2 1", "lgpl 2 1"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "lgpl 3 0"),
    "AGPL-3.0": ("gnu affero general public license version 3", "agpl 3 0"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"),
    "BSD-2-Clause": ("bsd 2 clause license", "simplified bsd license", "bsd 2 clause"),
    "BSD-3-Clause": ("bsd 3 clause license", "new bsd license", "bsd 3 clause"),
    "ISC": ("isc license",),
    "EPL-2.0": ("eclipse public license version 2 0", "eclipse public license 2 0"),
    "CC0-1.0": ("cc0 1 0", "cc0 1 0 universal"),
    "CC-BY-4.0": ("cc by 4 0", "creative commons attribution 4 0 international license"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"),
    "CC-BY-ND-4.0": ("cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"),
    "CC-BY-NC-SA-4.0": ("cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international license"),
}
# How a text refers to a licence.
REFERENCES = (
    "licensed under {}", "licensed under the {}", "released under {}", "released under the {}", "this work is licensed under {}", "this work is licensed under a {}",
    "this work is licensed under the {}", "this project is licensed under the {}", "this software is licensed under the {}", "this file is licensed under the {}",
    "distributed under the {}", "available under the {}", "published under the {} license", "code is licensed under the {}",
)
# Sentences of licence texts and notices.
SENTENCES = {
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd_intro": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd_endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache_terms": "you may not use this file except in compliance with the License",
    "apache_notice": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache_copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl3_later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl_terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl2_later": "either version 2 of the License, or (at your option) any later version",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "public_domain": "This work is in the public domain",
    "reserved": "All rights reserved",
    "proprietary": "Unauthorized copying of this file, via any medium is strictly prohibited, without permission",
}
# Rules in the order in which they are tried.
RULES = [
    ("BSD-3-Clause", ["bsd_intro", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-2-Clause", ["bsd_intro", "bsd_source", "bsd_binary"]),
    ("MIT", ["mit_grant", "mit_notice"]),
    ("MIT", ["mit_grant"]),
    ("ISC", ["isc_grant"]),
    ("Apache-2.0", ["ref_apache_2_0", "apache_terms", "apache_copy"]),
    ("Apache-2.0", ["apache_notice", "apache_terms", "apache_copy"]),
    ("Apache-2.0", ["apache_notice"]),
    ("GPL-3.0-or-later", ["gpl3_later"]),
    ("GPL-2.0-or-later", ["gpl_terms", "gpl2_later"]),
    ("Unlicense", ["unlicense"]),
    ("Public-domain", ["public_domain"]),
]
STEMS = ("licen", "copyright", "reserved", "permi", "redistribut", "domain", "under")


def normalise(sentence: str) -> str:
    """As normal() does it in Spark: lower-case words of letters and digits with single spaces."""
    return re.sub(r"[^\w]+|_+", " ", sentence.lower()).strip()


def identifiers() -> dict[str, str]:
    """Normalised sentence -> identifier; no sentence holds a boundary inside."""
    known = {}
    for license_id, names in NAMES.items():
        ref = "ref_" + normalise(license_id).replace(" ", "_")
        for name in names:
            for form in REFERENCES:
                known[form.format(name)] = ref
        known[f"spdx license identifier {normalise(license_id)}"] = ref
    for ref, sentence in SENTENCES.items():
        known[normalise(sentence)] = ref
    if missing := [s for s in known if not any(stem in s for stem in STEMS)]:
        raise ValueError(f"no stem in {missing}")
    return known


def ordered_rules() -> list[tuple[str, list[str]]]:
    """RULES, then a rule for each single reference, then what only reserves rights."""
    single = [(license_id, ["ref_" + normalise(license_id).replace(" ", "_")]) for license_id in NAMES]
    return [*RULES, *single, ("Proprietary", ["proprietary"]), ("All-rights-reserved", ["reserved"])]


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _patterns() -> list[str]:
    return [" ".join(["", *refs, ""]) + ">" + name for name, refs in ordered_rules()]


def recognised(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids, n_known, license (of the first rule that matched) and licenses (of all, in rule order)."""
    known = identifiers()
    table = "map(" + ", ".join(f"{_quoted(s)}, {_quoted(i)}" for s, i in known.items()) + ")"
    rules = "array(" + ", ".join(map(_quoted, _patterns())) + ")"
    stem = lambda x: " or ".join(f"contains({x}, {_quoted(s)})" for s in STEMS)
    known_as = lambda x: f"try_element_at({table}, trim(regexp_replace({x}, '[^\\\\p{{L}}\\\\p{{N}}]+', ' ')))"
    lines = f"if(contains(s, '\\n'), array_join(transform(filter(split(s, '\\n'), x -> {stem('x')}), x -> {known_as('x')}), ' '), '')"
    ids = f"array_join(filter(transform(filter(split(low, '\\n\\\\s*\\n|(?<=[.!?:;])\\\\s+'), s -> {stem('s')}), s -> coalesce({known_as('s')}, {lines})), i -> i <> ''), ' ')"
    rows = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    rows = rows.select("doc_id", F.expr(f"if({stem('low')}, {ids}, '')").alias("ids"))
    rows = rows.withColumn("found", F.expr(f"if(ids = '', '', trim(split_part({_walk()}, '>', 2)))".replace("{rules}", rules)))
    return rows.select(
        "doc_id",
        F.col("ids").alias("sentence_ids"),
        F.expr("if(ids = '', 0, size(split(ids, ' ')))").cast("long").alias("n_known"),
        F.expr("if(found = '', null, split_part(found, ' ', 1))").alias("license"),
        F.col("found").alias("licenses"),
    )


def _walk() -> str:
    """The rules' walk over the identifiers, of which each stands between two single spaces of its own."""
    left, right = "split_part(state, '>', 1)", "split_part(state, '>', 2)"
    refs, name = "split_part(r, '>', 1)", "split_part(r, '>', 2)"
    return f"aggregate({{rules}}, concat(' ', ids, ' >'), (state, r) -> if(contains({left}, {refs}), concat(replace({left}, {refs}, ' / '), '>', {right}, ' ', {name}), state))"


def oracle() -> str:
    """recognised() in DuckDB SQL, but that of a text with wrapped and other sentences it has only the reading that finds more."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({q(s)}, {q(i)})" for s, i in identifiers().items())
    rules = "[" + ", ".join(map(q, _patterns())) + "]"
    cut = lambda text, way: f"SELECT rid, {way} AS way, unnest(string_split(regexp_replace({text}, '([.!?:;])\\s+', '\\1' || chr(10), 'g'), chr(10))) AS s, generate_subscripts(string_split(regexp_replace({text}, '([.!?:;])\\s+', '\\1' || chr(10), 'g'), chr(10)), 1) AS pos FROM d"
    left, right = "split_part(state, '>', 1)", "split_part(state, '>', 2)"
    refs, name = "split_part(r, '>', 1)", "split_part(r, '>', 2)"
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lower(coalesce(text, '')) AS low FROM documents),
    known(s, id) AS (VALUES {known}),
    s AS ({cut("low", 0)} UNION ALL {cut(r"regexp_replace(regexp_replace(low, '\n\s*\n', '. ', 'g'), '\s*\n\s*', ' ', 'g')", 1)}),
    hits AS (SELECT rid, way, string_agg(id, ' ' ORDER BY pos) AS ids, count(*) AS n FROM (SELECT rid, way, pos, trim(regexp_replace(s, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS s FROM s) JOIN known USING (s) GROUP BY rid, way),
    best AS (SELECT rid, arg_max(ids, (n, -way)) AS ids FROM hits GROUP BY rid),
    found AS (SELECT doc_id, coalesce(ids, '') AS ids,
        coalesce(trim(split_part(list_reduce(list_prepend(' ' || ids || ' >', {rules}), lambda state, r: CASE WHEN contains({left}, {refs})
            THEN replace({left}, {refs}, ' / ') || '>' || {right} || ' ' || {name} ELSE state END), '>', 2)), '') AS found
        FROM d LEFT JOIN best USING (rid))
    SELECT doc_id, ids AS sentence_ids, CASE WHEN ids = '' THEN 0 ELSE len(string_split(ids, ' ')) END AS n_known,
           CASE WHEN found = '' THEN NULL ELSE split_part(found, ' ', 1) END AS license, found AS licenses FROM found"""
