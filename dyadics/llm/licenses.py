"""Licence scan by canonical digests, in DataFrame functions alone.

A text is normalised: lines of a holder's copyright notice go, letters become lower-case, equivalent spellings become one, punctuation and
white space become single spaces. The digest of the whole normalised text is looked up among those of known licence
texts by a hash join. The same lookup takes each line of a text as a whole, which finds licence notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Licence texts and notices as published, by identifier. Names and years stand in copyright lines alone.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEXTS = (
    ("MIT", "MIT License\n" + MIT),
    ("MIT", "The MIT License (MIT)\n" + MIT),
    ("MIT", MIT),
    ("ISC", "ISC License\n" + ISC),
    ("ISC", ISC),
    ("0BSD", "BSD Zero Clause License\n" + ZERO_BSD),
    ("0BSD", ZERO_BSD),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + BSD_HEAD + BSD_TAIL),
    ("BSD-2-Clause", BSD_HEAD + BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + BSD_HEAD + BSD_THIRD + BSD_TAIL),
    ("BSD-3-Clause", BSD_HEAD + BSD_THIRD + BSD_TAIL),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Released under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)
#: Digests of whole licences as published, too long to stand here; ``catalogue`` made them.
DIGESTS = (
    ("Apache-2.0", "9782099b6b13d659693083eb4b0ff3953507de47b5b3b9e194156468c52a8c1b"),
    ("Artistic-1.0-Perl", "50cd294a1f03da474a09c58d35e8078f45a5f25fe34ce03806cf2d892e193184"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "d7b4fa98c0201b101d2035c8ce5216ecd9d6468e8c8027a7ca54c3340f919d08"),
    ("GFDL-1.3", "438ae846690e15ae7957a7e816e4b191e39c6de2a061ce3d3573ba5a22d5e15a"),
    ("GPL-1.0", "9caf042595280548f0149ac88169a7f2e04f35b2a642cf00b991f00d48bfa4ce"),
    ("GPL-2.0", "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6"),
    ("GPL-3.0", "9085ee283b8c84517846c5acafee37391c28bb825b7ecec4aaa90768f2f283b0"),
    ("LGPL-2.0", "944ef57fae4d7ce4e08dcb419a62d2e38e3ab8471ccf8ef70b1ebac46b7911b1"),
    ("LGPL-2.1", "5ddd6039d3b090c51328879800301dd19b1ad99e14d00f3c6f221ab45a32db57"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
)
#: Spellings that licence matching guidelines treat as equal, after lower-casing.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("judgement", "judgment"),
    ("noncommercial", "non commercial"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("sub license", "sublicense"),
    ("https", "http"),
    ("while", "whilst"),
    ("wilful", "willful"),
)
#: A line of these is looked up as a text of its own; other lines cannot be notices.
NOTICE_HINT = "licen|spdx|permission|creative commons"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The SQL's expression. It also drops lines of a wrapped licence that merely begin with one of these words.
_COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
#: Words that follow "copyright" in the running text of a licence, where a notice has a sign, a year or a name.
_RUNNING_ON = "and|are|as|claims?|disclaimers?|for|holders?|in|infringements?|interests?|is|laws?|licen[cs]es?|may|must|notices?|of|on|or|owners?|ownership|permissions?|protections?|rights?|shall|statements?|to|treat(?:y|ies)|under|with"
#: A holder's notice. "(c)" alone may be a clause, so a year, "copyright", "by" or a name of capitalised words has to follow.
_HOLDER_LINE = (
    r"(?im)^[^\p{L}\p{N}\n]*(?:copyright[^\p{L}\p{N}\n]*(?:\(c\)|©)"
    rf"|(?:\(c\)\s*)?copyright\b[^\p{{L}}\p{{N}}\n.;]+(?!(?:{_RUNNING_ON})\b)[\p{{L}}\p{{N}}]"
    r"|\(c\)[ \t]*(?:\d{4}|by\b|(?-i:(?:\p{Lu}[\p{L}\p{N}.'’&-]*,?[ \t]+)*\p{Lu}[\p{L}\p{N}'’&-]*\p{Ll}[ \t]+\p{Lu}[\p{L}\p{N}.'’&-]*\p{Ll}\.?[ \t]*(?:<[^>\n]*>)?[ \t]*$))"
    r"|©|all rights reserved)[^\n]*$"
)


def canonical(text: Column) -> Column:
    """The normalised text. Equal licences give equal texts whatever their case, punctuation, spelling and holders."""
    out = F.translate(F.regexp_replace(text, _HOLDER_LINE, " "), _UPPER, _LOWER)
    # two spaces between words: each word has a space of its own on either side, so that no two replacements overlap
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", "  ")), F.lit(" "))
    # only texts that hold an odd spelling pay for the replacements
    odd = "|".join(a.replace(" ", "  ") for a, _ in SPELLINGS)
    spelt = out
    for a, b in SPELLINGS:
        spelt = F.replace(spelt, *(F.lit(" " + x.replace(" ", "  ") + " ") for x in (a, b)))
    return F.replace(F.trim(F.when(out.rlike(f" ({odd}) "), spelt).otherwise(out)), F.lit("  "), F.lit(" "))


def digest(text: Column) -> Column:
    return F.sha2(F.encode(canonical(text), "UTF-8"), 256)


def known(spark: SparkSession, texts: tuple[tuple[str, str], ...] = TEXTS, digests: tuple[tuple[str, str], ...] = DIGESTS) -> DataFrame:
    """digest, license of each known text; of equal digests the least identifier stays."""
    rows = spark.createDataFrame(list(texts), "license string, text string").select(digest(F.col("text")).alias("digest"), "license")
    if digests:
        rows = rows.unionByName(spark.createDataFrame(list(digests), "license string, digest string"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def catalogue(spark: SparkSession, path: str) -> tuple[tuple[str, str], ...]:
    """(identifier, digest) of the licence texts in a folder of files named by identifier: more known texts for ``scan``."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), digest(F.col("value")).alias("digest"))
    return tuple(sorted((r["file"].removesuffix(".txt"), r["digest"]) for r in files.collect()))  # some hundred licences


def scan(docs: DataFrame, texts: tuple[tuple[str, str], ...] = TEXTS, digests: tuple[tuple[str, str], ...] = DIGESTS) -> DataFrame:
    """doc_id, text_digest, license, notice_lines, notices for each row of ``docs``.

    ``license`` is that of the whole text, null if it is none. ``notice_lines`` counts the lines that are a known text
    in whole; ``notices`` lists their identifiers, ascending, joined by commas (null if none). A null text is empty; an empty
    normalised text matches nothing. Repeated rows and null ids are rows like others; other columns are ignored.
    """
    table = known(docs.sparkSession, texts, digests)
    # the digests of the known texts: a table of the size of ``texts``, looked up by a hash join without an exchange
    looked_up = F.broadcast(table)
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.array_compact(F.transform(F.filter(F.split(text, "\n"), lambda x: F.translate(x, _UPPER, _LOWER).rlike(NOTICE_HINT)), digest))
    rows = docs.select("doc_id", digest(text).alias("text_digest"), lines.alias("lines"))
    rows = rows.join(looked_up.withColumnRenamed("digest", "text_digest"), "text_digest", "left")
    # the lines' digests meet the same few dozen entries as a map, so that rows need not be taken apart
    entries = [x for r in table.orderBy("digest").collect() for x in (F.lit(r["digest"]), F.lit(r["license"]))]
    rows = rows.withColumn("found", F.array_compact(F.transform("lines", lambda x: F.try_element_at(F.create_map(*entries), x))))
    return rows.select(
        "doc_id",
        "text_digest",
        "license",
        F.size("found").cast("long").alias("notice_lines"),
        F.when(F.size("found") > 0, F.array_join(F.sort_array(F.array_distinct("found")), ",")).alias("notices"),
    )


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """The same scan in DuckDB SQL, written from the same fixed values."""

    def text_of(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    pairs = {a: b for a, b in SPELLINGS if " " not in a}
    words = f"map({list(pairs)}, {[v.replace(" ", "  ") for v in pairs.values()]})"

    def norm(x: str) -> str:
        plain = f"regexp_replace(regexp_replace(translate({x}, '{_UPPER}', '{_LOWER}'), {text_of(_COPYRIGHT_LINE)}, ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
        # word by word through a map, then the spellings of two words
        flat = f"' ' || array_to_string(list_transform(string_split(trim({plain}), ' '), lambda w: coalesce({words}[w], w)), '  ') || ' '"
        for a, b in ((a.replace(" ", "  "), b.replace(" ", "  ")) for a, b in SPELLINGS if " " in a):
            flat = f"replace({flat}, ' {a} ', ' {b} ')"
        return f"sha256(replace(trim({flat}), '  ', ' '))"

    rows = ", ".join(f"({text_of(name)}, {text_of(text)})" for name, text in TEXTS)
    digests = ", ".join(f"({text_of(name)}, {text_of(value)})" for name, value in DIGESTS)
    return f"""
WITH k AS (SELECT digest, min(l) AS license FROM (SELECT {norm('t')} AS digest, l FROM (VALUES {rows}) v(l, t) UNION ALL SELECT d, l FROM (VALUES {digests}) e(l, d)) GROUP BY 1),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
f AS (SELECT rid, license FROM (SELECT rid, {norm('line')} AS digest FROM n
      WHERE regexp_matches(translate(line, '{_UPPER}', '{_LOWER}'), '{NOTICE_HINT}')) JOIN k USING (digest)),
g AS (SELECT rid, count(*) AS notice_lines, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM f GROUP BY rid),
t AS (SELECT rid, doc_id, {norm('text')} AS text_digest FROM d)
SELECT doc_id, text_digest, k.license, coalesce(notice_lines, 0) AS notice_lines, notices
FROM t LEFT JOIN g USING (rid) LEFT JOIN k ON k.digest = t.text_digest
"""
