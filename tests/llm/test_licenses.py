import re
import string

from foldline.llm import licenses

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def plain(text):
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    hits = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if tuple(words[i:i + len(p)]) == p]
    places = [i for i, _ in hits]
    return (len(words), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits})))


def check(rows, texts):
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_whole_table(spark, sf, plain_rows):
    rows = licenses.digest(licenses.scan(spark.read.parquet(f"{sf}/documents.parquet"))).collect()
    check(rows, {i: t for i, t, *_ in plain_rows})
    texts = {i: t for i, t, *_ in plain_rows}
    for r in rows:
        for label, mark in (("mit", "the MIT License"), ("apache-2.0", "Apache License, Version 2.0"), ("gpl-3.0", "General Public License, version 3")):
            assert (label in r.labels.split(",")) == (mark.lower() in texts[r.doc_id].lower())


CASES = {
    1: "All rights. ALL  RIGHTS reserved all rights reserved! İK cc-by cc by-sa 4.0", 2: "general public license " * 3,
    3: 'Permission is hereby granted, free of charge, to any person obtaining a copy of THIS software and associated documentation '
       'files (the "Software"), to deal in the Software without restriction',
    4: "x " * 30000 + "Licensed under the GNU General Public License version 2", 5: "license " * 20000, 6: "mit license",
    7: "Permission is hereby granted, free of charge, to nobody", 8: "éall rights reserved 3all rights reservedé",
}


def test_cases(spark):
    rows = licenses.digest(licenses.scan(spark.createDataFrame(list(CASES.items()), "doc_id long, text string"))).collect()
    check(rows, CASES)
    labels = {r.doc_id: r.labels for r in rows}
    assert labels == {1: "cc-by,reserved", 2: "gpl", 3: "mit", 4: "gpl,gpl-2.0", 5: "", 6: "mit", 7: "", 8: ""}


def test_edges(edges, empty):
    rows = licenses.digest(licenses.scan(edges)).collect()
    assert len(rows) == edges.count()
    assert {r.n_words for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert licenses.digest(licenses.scan(empty)).count() == 0


BODIES = {
    1: "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
       "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
       "in the documentation and/or other materials provided with the distribution.\n\n"
       'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES',
    2: "in the documentation and/or other materials provided with the distribution.\n3. Neither the name of the University nor the names of its "
       "contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
       'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"',
    3: "it under the terms of the GNU Affero General Public License as published by\n# the Free Software Foundation, either version 3 of the License",
    4: "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
    5: "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    6: "// SPDX-License-Identifier: GPL-3.0-or-later", 7: "/* SPDX-License-Identifier: BSD-2-Clause */ SPDX-License-Identifier: ISC",
    8: "The origin of this software must not be claimed; you wrote the original software", 9: "spdx license identifier unknown",
}


def test_bodies_and_identifiers(spark):
    rows = licenses.digest(licenses.scan(spark.createDataFrame(list(BODIES.items()), "doc_id long, text string"))).collect()
    check(rows, BODIES)
    assert {r.doc_id: r.labels for r in rows} == {
        1: "bsd,bsd-2-clause", 2: "bsd-3-clause", 3: "agpl,gpl", 4: "gpl,lgpl", 5: "gpl,gpl-2.0", 6: "gpl-3.0", 7: "bsd-2-clause,isc", 8: "", 9: ""}


def test_every_template_finds_its_own_words(spark):
    texts = {i: " ".join(t.words) for i, t in enumerate(licenses.NOTICES)}
    rows = licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    for r in rows:
        assert (licenses.NOTICES[r.doc_id].label, 0, 1.0) in {(p.label, p.start, p.share) for p in r.notices}
