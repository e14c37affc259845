"""License scans: the canonical form of whole texts is hashed and joined with the digests of known licences."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, stage

#: Known texts that are broadcast at most; a larger table meets the units in a shuffled hash join.
MOST_BROADCAST = 50_000

# How a notice names a licence (SPDX identifier: its names).
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License"),
    "MIT": ("MIT License", "MIT/Expat License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL v3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL v3"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "ISC": ("ISC License",),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
}
# The sentences that a notice consists of.
NOTICES = (
    "{0}",
    "{0} or later",
    "Licensed under {0}",
    "Licensed under the {0}",
    "Released under {0}",
    "Released under the {0}",
    "Distributed under the {0}",
    "Available under the {0}",
    "This work is licensed under {0}",
    "This work is licensed under the {0}",
    "This work is licensed under a {0}",
    "This project is licensed under the {0}",
    "This software is licensed under the {0}",
    "This file is licensed under the {0}",
    "SPDX-License-Identifier: {1}",
)
# Published licence texts without their copyright lines.
TEXTS = {
    "MIT": """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
}

# Equivalent spellings, replaced in this order.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"),
    ("share alike", "sharealike"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("merchantibility", "merchantability"),
    ("copyright owner", "copyright holder"),
    ("whilst", "while"),
)
#: A line that only says who holds the copyright, and one that reserves rights.
COPYRIGHT = r"(^|\n)[ \t#*/;.-]*(?:copyright[ \t:]*(?:\(c\)|©|[0-9]{4}|<|\[)|\(c\)[ \t]*[0-9]{4}|©)[^\n]*"
RESERVED = r"(^|\n)[ \t#*/;.-]*all rights reserved[ \t\r.]*(\n|$)"
#: What stands for such a line, so that it parts no paragraph.
HELD = "\x01"
MARKS = rf"[^\p{{L}}\p{{N}}\n{HELD}]+"
PARAGRAPH = r"\n\n+"


def canonical_lines(text: Column) -> Column:
    """Lower case, one space for each run of other signs than letters and digits, none at the ends of lines; HELD for copyright lines."""
    made = F.regexp_replace(F.lower(text), COPYRIGHT, f"$1{HELD}")
    made = F.regexp_replace(made, RESERVED, f"$1{HELD}$2")
    return F.regexp_replace(F.regexp_replace(made, MARKS, " "), r" *\n *", "\n")


def joined(lines: Column) -> Column:
    """Canonical lines as one, without copyright lines, in one spelling."""
    made = F.trim(F.regexp_replace(lines, f"[ \n{HELD}]+", " "))
    for other, usual in SPELLINGS:
        made = F.replace(made, F.lit(other), F.lit(usual))
    return made


def canonical(text: Column) -> Column:
    return joined(canonical_lines(text))


def known_texts() -> list[tuple[str, str]]:
    """(license, text) of the notices that NOTICES and NAMES make, and of TEXTS with and without their titles, and of the published texts in license_texts."""
    made = [(spdx, n.format(name, spdx)) for spdx, names in NAMES.items() for name in names for n in NOTICES]
    for spdx, text in TEXTS.items():
        made += [(spdx, text), (spdx, text.split("\n", 1)[1])]
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        made.append((path.name.removesuffix(".txt").removesuffix(".header"), path.read_text(encoding="utf-8")))
    return made


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(known_texts(), "license string, text string")


def paragraphs(lines: Column) -> Column:
    """(several, t) of each paragraph that isn't empty: whether it has several lines, and its canonical form."""
    made = F.transform(F.split(lines, PARAGRAPH, -1), lambda p: F.struct(F.contains(F.trim(p), F.lit("\n")).alias("several"), joined(p).alias("t")))
    return F.filter(made, lambda p: p["t"] != "")


def _units(lines: Column) -> Column:
    """(unit, nth, of, digest) of a text: the whole, its paragraphs where it has several, and its lines where it has several."""
    none = F.array().cast("array<struct<unit:string,nth:int,of:int,digest:string>>")

    def named(kind: Column, nth: Column, of: Column, t: Column) -> Column:
        return F.struct(kind.alias("unit"), nth.cast("int").alias("nth"), of.cast("int").alias("of"), F.sha2(t, 256).alias("digest"))

    def parted(p: Column) -> Column:
        kind = lambda x: F.when(x["several"], "paragraph").otherwise("part")
        return F.when(F.size(p) > 1, F.transform(p, lambda x, i: named(kind(x), i, F.size(p), x["t"]))).otherwise(none)

    each = F.transform(F.split(lines, "\n", -1), lambda t, i: named(F.lit("line"), i, F.lit(1), joined(t)))
    return F.concat(
        F.array(named(F.lit("text"), F.lit(0), F.lit(1), joined(lines))),
        F.when(F.contains(lines, F.lit("\n")), F.concat(let(paragraphs(lines), parted), each)).otherwise(none),
    )


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, unit, nth, license) for each text, paragraph, line or run of paragraphs that is a known licence text as a whole.

    Both sides are made canonical (``canonical``) and meet by SHA-256. Paragraphs lie between lines without letters and
    digits; those of copyright lines alone count as none. unit is ``text``, ``line``, ``paragraph`` (of several lines)
    or ``block``: some, not all, of a text's paragraphs that are those of a licence of several, one after the other; nth is
    the first one's number. A text is made canonical once, its units are cut from that.

    ``known(license, text)`` is broadcast if it has MOST_BROADCAST rows at most, and hash-joined after a shuffle
    otherwise; beside it only the paragraphs that a licence has are shuffled. The documents are read once, and what matched is staged. Known texts that are null or canonically
    empty are left out; one text with two licences gives both. Null and empty texts have no match. Repeated
    documents give repeated rows, null ids stay null. Only the named columns are read.
    """
    known = known_licenses(docs.sparkSession) if known is None else known
    small = known.count() <= MOST_BROADCAST
    near = lambda table: F.broadcast(table) if small else table.hint("shuffle_hash")
    canon = known.select("license", canonical_lines(F.col("text")).alias("lines")).select("license", "lines", joined(F.col("lines")).alias("c")).filter("c <> ''")
    whole = canon.select("license", F.sha2("c", 256).alias("digest")).distinct()
    parts = canon.select("license", F.sha2("c", 256).alias("block"), paragraphs(F.col("lines")).alias("p")).filter("size(p) > 1").distinct()
    parts = parts.select("license", "block", F.size("p").alias("parts"), F.posexplode("p").alias("k", "p"))
    parts = parts.select("license", "block", "parts", "k", F.sha2("p.t", 256).alias("digest"))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("row_id", F.monotonically_increasing_id())
    units = let(canonical_lines(F.col("text")), _units)
    rows = rows.select("row_id", "doc_id", F.explode(units).alias("u")).select("row_id", "doc_id", "u.*")
    alone = whole.select("digest", "license", F.lit(0).alias("parts"), F.lit(0).alias("k"), F.lit("").alias("block"))
    hits = stage(rows.join(near(alone.unionByName(parts)), "digest"), "hits")
    found = hits.filter("parts = 0 and unit <> 'part'").select("doc_id", "unit", "nth", "license")
    runs = hits.filter("parts > 0 and unit in ('part', 'paragraph') and of > parts").withColumn("nth", F.col("nth") - F.col("k"))
    runs = runs.groupBy("row_id", "doc_id", "license", "block", "parts", "nth").agg(F.count("*").alias("n")).filter("n = parts")
    return found.unionByName(runs.select("doc_id", F.lit("block").alias("unit"), "nth", "license"))


def scan_sql() -> str:
    """DuckDB SQL for ``scan`` of documents with the known texts of this module."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    def lines(t: str) -> str:
        made = f"regexp_replace(lower({t}), {quoted(COPYRIGHT)}, {quoted(chr(92) + '1' + HELD)}, 'g')"
        made = f"regexp_replace({made}, {quoted(RESERVED)}, {quoted(chr(92) + '1' + HELD + chr(92) + '2')}, 'g')"
        return f"regexp_replace(regexp_replace({made}, {quoted(MARKS)}, ' ', 'g'), ' *' || chr(10) || ' *', chr(10), 'g')"

    def join(t: str) -> str:
        made = f"trim(regexp_replace({t}, {quoted(f'[ {chr(10)}{HELD}]+')}, ' ', 'g'))"
        for other, usual in SPELLINGS:
            made = f"replace({made}, {quoted(other)}, {quoted(usual)})"
        return made

    split = f"list_filter(list_transform(regexp_split_to_array(lines, {quoted(PARAGRAPH)}), lambda p: {{'several': contains(trim(p), chr(10)), 't': {join('p')}}}), lambda p: p.t <> '')"
    values = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in known_texts())
    return f"""
    WITH canon AS (SELECT DISTINCT license, lines, sha256({join("lines")}) AS digest FROM (SELECT license, {lines("text")} AS lines FROM (VALUES {values}) AS k(license, text)) WHERE {join("lines")} <> ''),
    known AS (SELECT DISTINCT license, digest FROM canon),
    licences AS (SELECT DISTINCT license, digest AS block, {split} AS p FROM canon),
    parts AS (SELECT license, block, len(p) AS parts, k - 1 AS k, sha256(p[k].t) AS digest FROM (SELECT *, unnest(range(1, len(p) + 1)) AS k FROM licences) WHERE len(p) > 1),
    texts AS (SELECT row_number() OVER () AS row_id, doc_id, {lines("text")} AS lines FROM documents WHERE text IS NOT NULL),
    paras AS (SELECT row_id, doc_id, {split} AS p FROM texts WHERE contains(lines, chr(10))),
    units AS (
        SELECT row_id, doc_id, 'text' AS unit, 0 AS nth, 1 AS of, sha256({join("lines")}) AS digest FROM texts
        UNION ALL
        SELECT row_id, doc_id, 'line', i - 1, 1, sha256({join("string_split(lines, chr(10))[i]")})
        FROM (SELECT *, unnest(range(1, len(string_split(lines, chr(10))) + 1)) AS i FROM texts) WHERE contains(lines, chr(10))
        UNION ALL
        SELECT row_id, doc_id, CASE WHEN p[i].several THEN 'paragraph' ELSE 'part' END, i - 1, len(p), sha256(p[i].t)
        FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM paras) WHERE len(p) > 1
    )
    SELECT doc_id, unit, nth::INT AS nth, license FROM units JOIN known USING (digest) WHERE unit <> 'part'
    UNION ALL
    SELECT doc_id, 'block', (nth - k)::INT, license FROM units JOIN parts USING (digest)
    WHERE unit IN ('part', 'paragraph') AND of > parts GROUP BY row_id, doc_id, license, block, parts, nth - k HAVING count(*) = parts
    """
