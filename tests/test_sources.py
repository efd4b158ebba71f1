import zipfile

import pytest

from edascope import DataLoader, DataLoadError, UnsupportedFormatError
from edascope.sources import sniff
from edascope.streaming.profile import stream_profile

SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'


def workbook(path, rows):
    cell = lambda r, c, v: f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + c)}{r}"{" t=" + chr(34) + "b" + chr(34) if isinstance(v, bool) else ""}><v>{int(v) if isinstance(v, bool) else v}</v></c>'
    xml = SHEET.format("".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows, 1)))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", xml)


def test_csv(spark, tmp_path):
    load = DataLoader(spark).load
    (tmp_path / "a.csv").write_text("A,B,C,D\n1,x,1.5,2020-01-01\n2,NA,2.5,2020-01-02\n3,z,,2020-01-03\n")
    df = load(str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"A": "bigint", "B": "string", "C": "double", "D": "timestamp"}
    assert df.where("B is null").count() == 1 and df.where("C is null").count() == 1
    (tmp_path / "b.csv").write_bytes("A;B\n1;é\n2;ü\n".encode("latin-1"))
    assert [r["B"] for r in load(str(tmp_path / "b.csv")).orderBy("A").collect()] == ["é", "ü"]
    (tmp_path / "w.csv").write_bytes("A,B\n1,€\n".encode("cp1252"))
    assert load(str(tmp_path / "w.csv"), encoding="cp1252").first()["B"] == "€"
    (tmp_path / "c.tsv").write_text("A\tB\n1\ttrue\n")
    assert dict(load(str(tmp_path / "c.tsv")).dtypes) == {"A": "bigint", "B": "boolean"}
    (tmp_path / "h.csv").write_text("A,B\n")
    assert load(str(tmp_path / "h.csv")).count() == 0 and load(str(tmp_path / "h.csv")).columns == ["A", "B"]
    (tmp_path / "n.csv").write_text("A\n1\n300\n")
    assert dict(DataLoader(spark, optimize_types=True).load(str(tmp_path / "n.csv")).dtypes) == {"A": "smallint"}


def test_errors(spark, tmp_path):
    with pytest.raises(DataLoadError, match="File not found"):
        DataLoader(spark).load(str(tmp_path / "none.csv"))
    (tmp_path / "a.json").write_text("{}")
    with pytest.raises(UnsupportedFormatError):
        DataLoader(spark).load(str(tmp_path / "a.json"))
    (tmp_path / "bad.xlsx").write_text("no zip")
    with pytest.raises(DataLoadError):
        DataLoader(spark).load(str(tmp_path / "bad.xlsx"))


def test_excel(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [["X", "Y", "Z"], [1, "a", True], [2, "b", False], [3, None, True]])
    df = DataLoader(spark).load(str(tmp_path / "a.xlsx"))
    assert dict(df.dtypes) == {"X": "bigint", "Y": "string", "Z": "boolean"} and df.count() == 3
    assert DataLoader(spark).load_from_buffer((tmp_path / "a.xlsx").read_bytes(), ".xlsx").count() == 3
    with pytest.raises(DataLoadError):
        DataLoader(spark).load(str(tmp_path / "a.xlsx"), sheet_name="Two")


def test_many_and_info(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}.csv").write_text("A,B\n1,x\n2,y\n")
    paths = [str(tmp_path / f"f{i}.csv") for i in range(4)]
    df = DataLoader(spark).load_multiple(paths)
    assert df.count() == 6 and {r[0] for r in df.select("__source_file__").distinct().collect()} == {"f0.csv", "f1.csv", "f2.csv"}
    assert len(DataLoader(spark).load_multiple(paths, concat=False)) == 3
    with pytest.raises(DataLoadError):
        DataLoader(spark).load_multiple(paths[3:])
    info = DataLoader(spark).get_file_info(paths[0])
    assert info["size_bytes"] == 12 and info["exists"] and info["is_supported"] and info["size_human"] == "12.0 B"
    assert DataLoader(spark).load_from_buffer(b"A,B\n1,x\n").first()["A"] == 1
    with pytest.raises(UnsupportedFormatError):
        DataLoader(spark).load_from_buffer(b"", ".json")


def test_sniff():
    assert sniff.separator("a|b|c\n1|2|3") == "|" and sniff.separator("abc") == ","
    assert sniff.encoding("é".encode()) == "utf-8" and sniff.encoding(b"\xe9 x y z w v u") == "latin-1"
    assert sniff.encoding(("a" * 50 + "é").encode()[:-1]) == "utf-8"


def test_parquet_and_stream(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    spark.range(10).selectExpr("id", "id * 2.0D AS v", "timestamp_seconds(id * 1000) AS t").write.parquet(path)
    assert DataLoader(spark).load(path).count() == 10
    stream = spark.readStream.schema("id long, v double, t timestamp").parquet(path)
    q = stream_profile(stream, ["v"]).writeStream.format("memory").queryName("running").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    r = spark.sql("SELECT * FROM running").first()
    assert (r["column_name"], r["count"], r["mean"], r["max"]) == ("v", 10, 9.0, 18.0)
    q = stream_profile(stream, ["v"], time="t", every="1 hour").writeStream.format("memory").queryName("windows").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert sum(r["count"] for r in spark.sql("SELECT * FROM windows").collect()) == 10


def test_bytes_that_break_an_encoding_late_in_a_file(spark, tmp_path):
    body = "".join(f"{i},plain text of row {i}\n" for i in range(6_000))
    (tmp_path / "late.csv").write_bytes(("A,B\n" + body + "6000,").encode() + "café\n".encode("latin-1"))
    got = DataLoader(spark).load(str(tmp_path / "late.csv"))
    assert got.count() == 6_001 and got.orderBy("A").tail(1)[0]["B"] == "café"
    # replacement characters of the file's own are no damage
    (tmp_path / "own.csv").write_text("A,B\n" + body + "6000,caf� é\n", encoding="utf-8")
    assert DataLoader(spark).load(str(tmp_path / "own.csv")).orderBy("A").tail(1)[0]["B"] == "caf� é"
    with pytest.raises(DataLoadError):
        DataLoader(spark, encoding_fallbacks=["utf-8"]).load(str(tmp_path / "late.csv"))


def test_quoted_newlines(spark, tmp_path):
    (tmp_path / "q.csv").write_text('A,B\n1,"two\nlines, and a ""quote"""\n2,one\n')
    got = DataLoader(spark).load(str(tmp_path / "q.csv")).orderBy("A").collect()
    assert [tuple(r) for r in got] == [(1, 'two\nlines, and a "quote"'), (2, "one")]
    (tmp_path / "p.csv").write_text('A,B\n1,"a ""b"" c"\n2,one\n')
    assert DataLoader(spark).load(str(tmp_path / "p.csv")).orderBy("A").first()["B"] == 'a "b" c'


@pytest.mark.parametrize(
    "values",
    [
        ["1/2/2020", "11/12/2021", "3/4/2022"],
        ["13/2/2020", "14/12/2021", "31/1/2022"],
        ["2020-1-2", "2021-11-12", "2022-3-14"],
        ["2020-01-02T03:04:05+02:00", "2021-01-02T03:04:05.123Z", "2022-01-02T03:04:05-05:00"],
        ["2020-01-02 03:04", "2021-01-02 13:14", "2022-01-02 23:59"],
        ["2020/1/2", "2021/11/12", "2022/3/14"],
        ["May 1, 2020", "Jun 21, 2021", "Jan 3, 2022"],
        ["1 Jan 2020", "21 Feb 2021", "3 Mar 2022"],
        ["1.2.2020", "21.12.2021", "3.4.2022"],
    ],
)
def test_dates_of_many_forms(spark, tmp_path, values):
    (tmp_path / "d.csv").write_text("A\tD\n" + "".join(f"{i}\t{v}\n" for i, v in enumerate(values)))
    df = DataLoader(spark).load(str(tmp_path / "d.csv"))
    assert dict(df.dtypes)["D"] == "timestamp" and [r["D"].year for r in df.orderBy("A").collect()] == [2020, 2021, 2022]


def test_texts_that_are_no_dates(spark, tmp_path):
    (tmp_path / "t.csv").write_text("A\nword 2020 word\n99/99/2020\n2020-13-45\nyear 2021 ends\n")
    assert dict(DataLoader(spark).load(str(tmp_path / "t.csv")).dtypes) == {"A": "string"}
