"""The same rows from every format."""

import json
import zipfile

import pandas as pd
import pytest

from ferrograph.sources import readers

ROWS = [{"id": "a1", "n": 1, "note": "x, y"}, {"id": "b2", "n": 2, "note": 'say "hi"'}, {"id": "c3", "n": 3, "note": None}]


def xlsx(path):
    words = ["id", "n", "note", "a1", "x, y", "b2", 'say "hi"', "c3"]
    cell = lambda r, c, v: f'<c r="{c}{r}" t="s"><v>{words.index(v)}</v></c>' if isinstance(v, str) else f'<c r="{c}{r}"><v>{v}</v></c>' if v is not None else ""
    lines = [["id", "n", "note"], *([r["id"], r["n"], r["note"]] for r in ROWS)]
    body = "".join(f'<row r="{i}">' + "".join(cell(i, c, v) for c, v in zip("ABC", line)) + "</row>" for i, line in enumerate(lines, 1))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    from xml.sax.saxutils import escape

    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{escape(w)}</t></si>" for w in words) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


def xml(path):
    path.write_text('<?xml version="1.0"?>\n<rows>\n<row id="a1"><id>other</id><n>1</n><note>x, y</note></row>\n<row id="b2"><n>2</n><note>say "hi"</note></row>\n<row id="c3"><n>3</n></row>\n</rows>')


def write(path, kind):
    df = pd.DataFrame(ROWS)
    if kind == "csv":
        df.to_csv(path, index=False)
    elif kind == "tsv":
        df.assign(note=df["note"].str.replace('"', "'")).to_csv(path, sep="\t", index=False)
    elif kind == "json":
        path.write_text(json.dumps(ROWS))
    elif kind == "columns.json":
        path.write_text(json.dumps({k: [r[k] for r in ROWS] for k in ROWS[0]}))
    elif kind == "jsonl":
        path.write_text("\n".join(map(json.dumps, ROWS)) + "\n\n")
    elif kind == "parquet":
        df.to_parquet(path)
    elif kind == "xml":
        xml(path)
    elif kind == "xlsx":
        xlsx(path)


@pytest.mark.parametrize("kind", ["csv", "tsv", "json", "columns.json", "jsonl", "parquet", "xml", "xlsx"])
def test_formats(spark, tmp_path, kind):
    path = tmp_path / f"t.{kind}"
    write(path, kind)
    got = sorted((r["id"], int(r["n"]), (r["note"] or "").replace("'", '"') or None) for r in readers.load(spark, str(path)).collect())
    assert got == [(r["id"], r["n"], r["note"]) for r in ROWS]


def test_memory(spark):
    assert readers.load(spark, {"a": 1, "b": "x"}).count() == 1
    assert readers.load(spark, {"a": [1, 2], "b": ["x", "y"]}).count() == 2
    assert readers.load(spark, pd.DataFrame(ROWS)).count() == 3
    df = spark.range(3)
    assert readers.load(spark, df) is df


def test_synthetic(spark):
    df = readers.synthetic_erp(spark, 500)
    assert len(df.columns) == 23 and df.count() == 500
    assert df.repartition(7).collect() and sorted(map(tuple, df.collect())) == sorted(map(tuple, readers.synthetic_erp(spark, 500).repartition(3).collect()))
    n = df.selectExpr("count(distinct customer_id) c", "count(distinct order_id) o", "count(distinct product_name) p").first()
    assert n.o == 500 and 80 <= n.c <= 100 and n.p <= 50
