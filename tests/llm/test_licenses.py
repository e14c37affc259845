import duckdb
import pytest

from quire.llm import licenses

MIT = licenses.TEXTS["MIT"]
CASES = [
    (1, "Released under the MIT License."),
    (2, "prose\nreleased UNDER the mit licence!!\nmore"),
    (3, "Copyright (c) 2020 Someone\n\n" + MIT.upper().replace("SUBLICENSE", "sub-licence")),
    (4, "Released under the MIT License and more."),
    (5, None),
    (6, ""),
    (7, "Intro\nof two lines.\n\n" + MIT.split("\n\n", 1)[1].replace("\n\n", "\n") + "\n\nEnd."),
    (8, "SPDX-License-Identifier: GPL-3.0"),
    (8, "SPDX-License-Identifier: GPL-3.0"),
    (None, "Licensed under CC BY-NC 4.0."),
    (9, "\n\n...\n"),
    (10, "© 2021 Them\nAll rights reserved.\nMIT License"),
    (11, "wörter " * 200_000),
    (12, "Intro.\n\n" + MIT.split("\n", 1)[1] + "\n\nThe end."),
    (13, "Intro.\n\n" + MIT.replace("\n\n", "\n\nCopyright (c) 1999 Us\n\n", 1) + "\n ---\n" + licenses.TEXTS["ISC"].upper()),
    (14, "Intro.\n\n" + MIT.rsplit("\n\n", 1)[0]),
    (15, "\n\n" + MIT),
]


def line_of(text):
    return next(k for k, x in enumerate(dict(CASES)[13].lower().split("\n")) if x == text)


def found(frame):
    return sorted([tuple(r) for r in frame.collect()], key=str)


def test_whole_texts_paragraphs_and_lines(docs):
    out = found(licenses.scan(docs(CASES)))
    assert out == sorted(
        [
            (1, "text", 0, "MIT"),
            (2, "line", 1, "MIT"),
            (3, "line", 2, "MIT"),
            (3, "text", 0, "MIT"),
            (7, "paragraph", 1, "MIT"),
            (8, "text", 0, "GPL-3.0"),
            (8, "text", 0, "GPL-3.0"),
            (10, "line", 2, "MIT"),
            (10, "text", 0, "MIT"),
            (None, "text", 0, "CC-BY-NC-4.0"),
            (12, "block", 1, "MIT"),
            (13, "line", 2, "MIT"),
            (13, "block", 1, "MIT"),
            (13, "block", 2, "MIT"),
            (13, "line", line_of("isc license"), "ISC"),
            (13, "block", 5, "ISC"),
            (13, "block", 6, "ISC"),
            (14, "line", 2, "MIT"),
            (15, "line", 2, "MIT"),
            (15, "block", 1, "MIT"),  # the text without its title
            (3, "block", 1, "MIT"),
            (15, "text", 0, "MIT"),
        ],
        key=str,
    )


def test_agrees_with_sql(docs):
    frame = docs(CASES)
    documents = frame.select("doc_id", "text").toPandas()
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(licenses.scan_sql()).fetchall()
    assert found(licenses.scan(frame)) == sorted([tuple(r) for r in want], key=str)


@pytest.mark.parametrize("most", [50_000, 0])
def test_own_table_of_licenses(spark, docs, monkeypatch, most):
    monkeypatch.setattr(licenses, "MOST_BROADCAST", most)
    known = spark.createDataFrame([("A", "one text"), ("B", "One, text"), ("A", "ONE TEXT"), ("C", None), ("D", "..."), (None, "two")], "license string, text string")
    assert found(licenses.scan(docs([(1, "one\ttext"), (2, "!"), (3, "two")]), known)) == [(1, "text", 0, "A"), (1, "text", 0, "B"), (3, "text", 0, None)]


def test_empty_tables(spark, docs):
    assert found(licenses.scan(docs([]))) == []
    assert found(licenses.scan(docs(CASES), spark.createDataFrame([], "license string, text string"))) == []


def test_published_texts(docs):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    texts = {x: t for x, t in licenses.known_texts() if len(t) > 1000}
    assert set(texts) >= {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"}
    assert " ".join(texts["BSD-2-Clause"].split()).startswith(bsd)
    names = sorted(texts)
    header = """Copyright 2020 Someone
Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
    rows = [(k, texts[x].upper()) for k, x in enumerate(names)] + [(99, header)]
    got = {(r.doc_id, r.license) for r in licenses.scan(docs(rows)).filter("unit = 'text'").collect()}
    assert got == {(k, x) for k, x in enumerate(names)} | {(99, "Apache-2.0")}
