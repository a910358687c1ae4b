import io
import zipfile
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from dyadics.sources import readers
from dyadics.sources.sheets import cells_of, named, sheets

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def book(pages, shared=()):
    """A workbook: pages (name to rows of cells as XML), and shared strings."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(pages, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Target="{"/xl/" if k % 2 else ""}worksheets/s{k}.xml"/>' for k, _ in enumerate(pages, 1)) + "</Relationships>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")
        for k, rows in enumerate(pages.values(), 1):
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {MAIN}><sheetData>" + "".join(f"<row>{r}</row>" for r in rows) + "</sheetData></worksheet>")
    return out.getvalue()


def inline(ref, text):
    return f'<c r="{ref}" t="inlineStr"><is><t>{escape(text)}</t></is></c>'


def test_kinds_of_cells():
    shared = ("<t>name</t>", "<r><t>two </t></r><r><t>runs</t></r>", "<t>kanji</t><rPh><t>reading</t></rPh>")
    head = '<c r="A1" t="s"><v>0</v></c>' + inline("C1", "p & q") + inline("AB1", "far")
    rows = [head, '<c r="A2" t="s"><v>1</v></c><c r="B2"><v>9</v></c><c r="C2"><v>0.250</v></c>', '<c r="C3" t="b"><v>1</v></c><c r="AB3" t="e"><v>#N/A</v></c>', "", '<c r="A5" t="s"><v>2</v></c><c r="C5" t="str"><f>1+1</f><v>2</v></c>']
    data = book({"one": ["<c/>"], "two": rows}, shared)
    want = [{"name": "two runs", "p & q": "0.250"}, {"p & q": "true", "far": "#N/A"}, {}, {"name": "kanji", "p & q": "2"}]
    assert cells_of(data, "two") == want == cells_of(data, 1)
    assert cells_of(data, 0) == []
    with pytest.raises(KeyError, match="three"):
        cells_of(data, "three")


def test_many_workbooks_and_frames(spark, tmp_path):
    for k in range(3):
        rows = [inline("A1", "Question") + inline("B1", "Domain")]
        rows += [inline(f"A{n + 2}", f"{'wins' if n % 2 == 0 else 'loses'} in book {k} scenario {n // 2} with XX%") + (inline(f"B{n + 2}", f"d{k}") if n % 2 else "") for n in range(6)]
        (tmp_path / f"b{k}.xlsx").write_bytes(book({"Frames": rows}))
    got = named(sheets(spark, str(tmp_path)), {"text": "Question", "domain": "Domain", "absent": "Nowhere"})
    assert got.count() == 18 and got.where("absent IS NOT NULL").count() == 0
    one = readers.spreadsheet(spark, str(tmp_path / "b1.xlsx"), ["Question", "Domain"]).select("row", F.col("Question").alias("text"), F.col("Domain").alias("domain"))
    frames = readers.framing_benchmark(one.withColumn("probabilities", F.when(F.col("row") % 2 == 0, F.array(F.lit(0.2))).otherwise(F.array(F.lit(0.8)))))
    assert sorted((r["scenario_id"], r["domain"]) for r in frames.collect()) == [(0, "d1"), (1, "d1"), (2, "d1")]


def test_a_damaged_workbook_is_named(spark, tmp_path):
    (tmp_path / "bad.xlsx").write_bytes(b"no archive")
    with pytest.raises(Exception, match="bad.xlsx"):
        sheets(spark, str(tmp_path)).count()
