import os
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from dyadics.llm.licenses import DIGESTS, ISC, MIT, TEXTS, canonical, scan

#: Licence texts of the system, where it has them, by file and identifier.
WHOLE = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts here")
def test_whole_licences_in_other_case_wrapping_and_holders(spark):
    rows = []
    for file, name in WHOLE.items():
        with open(f"/usr/share/common-licenses/{file}", encoding="utf-8") as f:
            text = f.read()
        assert name in dict(DIGESTS)
        head = "Copyright (c) 2024 Some One\n© A. Body\nAll rights reserved.\n"
        rows += [(name, text), (name, text.upper()), (name, head + text), (name, re.sub(r"\blicense(s?)\b", r"licence\1", text)), (name, text.replace(",", " ,").replace("\n\n", "\n \n\n")), (None, text + "\nand more"), (None, text.replace(" the ", " thy ", 1))]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in scan(docs).collect()}
    assert {i: (name, got[i]) for i, (name, _) in enumerate(rows) if got[i] != name} == {}


def test_spellings_that_follow_each_other(spark):
    texts = [("licence licence terms", "license license terms"), ("Copyright-owner's licence per cent per cent", "copyright holder s license percent percent"), ("a sub  licence", "a sublicense"), ("licence", "license"), ("noncommercial while", "non commercial whilst"), ("x", "x"), ("", "")]
    rows = spark.createDataFrame(texts, "text string, want string").select(canonical(F.col("text")).alias("got"), "want", "text").collect()
    assert [(r["text"], r["got"]) for r in rows] == [(r["text"], r["want"]) for r in rows]


def test_variants_of_a_licence(spark):
    texts = [
        "The MIT License (MIT)\n\nCopyright (c) 2024 Some One\n\n" + MIT,
        "MIT LICENCE\n * Copyright 1999 A. Body <a@b.c>\n" + MIT.upper().replace(",", " ,"),
        MIT + " And more.",
        "Copyright 2020\nAll rights reserved.\n" + ISC.replace("\n", "\n\n  "),
        "text\nReleased under the MIT License.\nmore\nLicensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.",
        "under the MIT License",
        "",
        None,
    ]
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    got = [(r["license"], r["notice_lines"], r["notices"]) for r in scan(rows).orderBy("doc_id").collect()]
    assert [g[0] for g in got] == ["MIT", "MIT", None, "ISC", None, None, None, None]
    assert got[4][1:] == (3, "CC-BY-NC-4.0,MIT") and got[5][1:] == (0, None)


def test_odd_rows(odd, nothing):
    rows = scan(odd).collect()
    assert len(rows) == 12 and all(r["license"] is None and r["notice_lines"] == 0 for r in rows)
    assert scan(nothing).count() == 0


def test_each_known_text_is_found(spark):
    rows = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(TEXTS)], "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in scan(rows).collect()}
    assert got == {i: name for i, (name, _) in enumerate(TEXTS)}


def test_each_known_text_is_found_however_it_is_wrapped(spark):
    head = "Copyright (c) 2024 Some One\n(c) 2020 A. Body\nCopyright The Authors <a@b.c>\n(c) Some One\n© Some One\nAll rights reserved.\n"
    forms = [(name, head + "\n".join(textwrap.fill(line.upper() if shout else line, width) for line in text.split("\n"))) for name, text in TEXTS for width in (*range(24, 90, 3), 200) for shout in (False, True)]
    assert any(line.startswith("copyright notice") for _, text in forms for line in text.split("\n"))
    assert any(line.lower().startswith("copyright holder") for _, text in forms for line in text.split("\n"))
    got = {r["doc_id"]: r["license"] for r in scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(forms)], "doc_id long, text string")).collect()}
    assert {i: (name, got[i]) for i, (name, _) in enumerate(forms) if got[i] != name} == {}


def test_clauses_are_not_holders(spark):
    texts = (("X-1", "Terms:\n(a) keep this\n(c) You must keep that\ncopyright law applies"),)
    rows = [texts[0][1], "Copyright 2001, 2002 X\n" + texts[0][1], texts[0][1].replace("keep that", "drop that"), texts[0][1].replace("law applies", "laws do not")]
    got = scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), texts).orderBy("doc_id").collect()
    assert [r["license"] for r in got] == ["X-1", "X-1", None, None]
