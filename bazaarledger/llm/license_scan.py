"""License scans by canonical digests, in DataFrame operations only.

A text is brought to canonical form: lower case, copyright lines and headings removed, punctuation, comment marks and white space to
single spaces, equivalent spellings unified. The digest of the entire canonical text is hash-joined to the digests of known licences. Each line of a text
is looked up as a text of its own as well, since corpora carry licence notices as single lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarledger.llm.frames import stored
from bazaarledger.llm.license_digests import DIGESTS

#: Spellings counted as equal (left becomes right).
EQUIVALENT = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "acknowledgement": "acknowledgment",
    "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized",
    "cancelled": "canceled", "catalogue": "catalog", "centre": "center", "colour": "color", "favour": "favor", "favourite": "favorite",
    "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling",
    "modelling": "modeling", "optimisation": "optimization",
    "organisation": "organization", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize",
    "utilisation": "utilization", "whilst": "while", "wilful": "willful", "https": "http",
}

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""

#: Entire licence texts and customary notices, by SPDX identifier. Callers may pass a table of their own.
KNOWN: list[tuple[str, str]] = [
    ("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT), ("MIT", "Released under the MIT License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_END),
    ("BSD-2-Clause", _BSD_START + _BSD_END), ("BSD-3-Clause", _BSD_START + _BSD_THIRD + _BSD_END),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]
#: A copyright line, after comment marks: a year, a name or a sign must follow, since wrapped licence texts have lines that start with
#: "copyright holders" or "(c) You must retain".
COPYRIGHT = (
    "^[^\\p{L}\\p{N}(©\"']*(?:©|\\([cC]\\)\\s*(?:(?i:copyright)\\b|\\d{4}|[<\\[{])|(?i:copyright)\\s*[:,]?\\s*(?:©|\\([cC]\\)|\\d{4}|[<\\[{]|(?i:by)\\s+[\\p{Lu}\\d]"
    "|(?<=\\s)(?!(?i:holders?|owners?|notices?|laws?|licen[sc]es?|statements?|acts?|rights?|offices?|treaty|treaties|disclaimers?|and|or|in|of|to|is|are|for|this|that)\\b)\\p{Lu}))"
)
#: Canonical lines that stand above licence texts or after copyright lines and belong to neither.
HEADINGS = (
    "all rights reserved", "license", "mit license", "the mit license", "mit license mit", "the mit license mit", "isc license", "the isc license", "isc license isc",
    "bsd license", "the bsd license", "new bsd license", "modified bsd license", "simplified bsd license", "bsd 2 clause license", "the bsd 2 clause license", "bsd 2 clause simplified license",
    "bsd 3 clause license", "the bsd 3 clause license", "bsd 3 clause new or revised license", "bsd zero clause license", "zero clause bsd",
)
#: The known table is broadcast, so its size is bounded.
MOST_KNOWN = 20_000


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text that are not empty; joined by spaces they are the canonical text. NULL counts as empty."""
    spellings = F.create_map(*(F.lit(x) for pair in EQUIVALENT.items() for x in pair))

    def canonical(line: Column) -> Column:
        plain = F.trim(F.regexp_replace(F.lower(line), "[^\\p{L}\\p{N}]+", " "))
        spelled = F.array_join(F.transform(F.split(plain, " "), lambda w: F.coalesce(F.try_element_at(spellings, w), w)), " ")
        return F.when(line.rlike(COPYRIGHT), F.lit("")).otherwise(spelled)

    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), canonical), lambda x: ~x.isin("", *HEADINGS))


def _digest(canonical: Column) -> Column:
    return F.substring(F.unhex(F.sha2(canonical, 256)), 1, 16)


def known_digests(spark: SparkSession, known: list[tuple[str, str]]) -> DataFrame:
    """(digest, license): one row per digest; where texts of two names agree, the smaller name. KNOWN is completed by DIGESTS."""
    whole = DIGESTS if known is KNOWN else []
    if len(known) + len(whole) > MOST_KNOWN:
        raise ValueError(f"known: {len(known) + len(whole)} texts, at most {MOST_KNOWN} are broadcast")
    texts = spark.createDataFrame(known, "license string, text string")
    digests = texts.select("license", _digest(F.array_join(canonical_lines(F.col("text")), " ")).alias("digest"))
    digests = digests.unionByName(spark.createDataFrame(whole, "license string, hex string").select("license", F.unhex("hex").alias("digest")))
    return digests.groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(df: DataFrame, text: str = "text", id: str = "doc_id", known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """One row per input row: (id, license, n_license_lines, line_licenses).

    ``license`` is the known licence that the entire text is (NULL: none), ``n_license_lines`` counts its lines that are a known
    notice, ``line_licenses`` lists their licences, sorted, without repeats, joined by commas (empty: none). Copyright lines and
    empty lines count for nothing. NULL counts as the empty text, which is no licence. Repeated rows give repeated results;
    extra columns are ignored; an empty table gives an empty table.
    """
    lines = canonical_lines(F.col(text))
    narrow = df.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("row_id"), lines.alias("lines"))
    table = stored(narrow.select("row", "row_id", _digest(F.array_join("lines", " ")).alias("whole"), F.transform("lines", _digest).alias("lines")))
    names = F.broadcast(known_digests(df.sparkSession, known))
    found = table.select("row", F.explode("lines").alias("digest")).join(names, "digest")
    per_row = found.groupBy("row").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("names"))  # at most one entry per known name
    whole = table.join(names.withColumnRenamed("digest", "whole"), "whole", "left").select("row", "row_id", "license")
    joined = whole.join(per_row, "row", "left")
    return joined.select(F.col("row_id").alias(id), "license", F.coalesce("n", F.lit(0)).cast("long").alias("n_license_lines"), F.coalesce("names", F.lit("")).alias("line_licenses"))


def oracle_sql(known: list[tuple[str, str]] = KNOWN) -> str:
    """The scan of table documents in DuckDB SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in known)
    spellings = "MAP {" + ", ".join(f"{quoted(a)}: {quoted(b)}" for a, b in EQUIVALENT.items()) + "}"
    canonical = f"""list_filter(list_transform(string_split(lower(coalesce(text, '')), chr(10)), lambda line:
        CASE WHEN regexp_matches(line, '^\\s*(copyright\\b|\\(c\\)|©)') THEN ''
        ELSE array_to_string(list_transform(string_split(trim(regexp_replace(line, '[^\\pL\\pN]+', ' ', 'g')), ' '), lambda w: coalesce({spellings}[w], w)), ' ') END), lambda x: x <> '')"""
    return f"""
        WITH known AS (SELECT array_to_string(lines, ' ') AS body, min(license) AS license FROM (SELECT license, {canonical} AS lines FROM (VALUES {values}) AS v(license, text)) GROUP BY 1),
        docs AS (SELECT doc_id, {canonical} AS lines FROM documents),
        hits AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names FROM (SELECT doc_id, unnest(lines) AS body FROM docs) JOIN known USING (body) GROUP BY doc_id)
        SELECT docs.doc_id, known.license, coalesce(hits.n, 0) AS n_license_lines, coalesce(hits.names, '') AS line_licenses
        FROM docs LEFT JOIN known ON known.body = array_to_string(docs.lines, ' ') LEFT JOIN hits ON hits.doc_id = docs.doc_id"""
