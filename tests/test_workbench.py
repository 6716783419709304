"""Behaviour of readers, profiler, inference, DDL, exports and the SQL runner on small files."""

import datetime as dt
import zipfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablelens.operators import ddl, derive, export, infer, naming, profile
from tablelens.operators.profile import ROW
from tablelens.plans.sqlrun import Runner, gives_rows, statements, translate
from tablelens.plans.workspace import Workspace
from tablelens.sources import delimited, excel, jdbc, parquet, sniff, tokens
from tablelens.sources.options import LoadError, cleaned


def put(path, text, encoding="utf-8"):
    path.write_bytes(text if isinstance(text, bytes) else text.encode(encoding))
    return path


def rows(df):
    return [tuple(r) for r in df.orderBy(ROW).collect()]


def frame(spark, name, values):
    return spark.createDataFrame([(v,) for v in values], f"`{name}` string")


# readers


def test_text_stays_text(spark, tmp_path):
    p = put(tmp_path / "2 Raw-File.csv", 'id,dob,code,note\r\n1,2/2/24,007,"say ""hi"""\r\n2,,012,\r\n3,1/1/24,,"a, b"\r\n')
    got = delimited.load(spark, str(p))
    assert got.name == "t_2_raw_file" and got.df.columns == [ROW, "id", "dob", "code", "note"]
    assert rows(got.df) == [(1, "1", "2/2/24", "007", 'say "hi"'), (2, "2", None, "012", None), (3, "3", "1/1/24", None, "a, b")]


def body_of(n, **changed):
    rows = [f"{i},name{i},note" for i in range(1, n + 1)]
    for k, v in changed.items():
        rows[int(k[1:]) - 1] = v
    return "id,name,note\n" + "\n".join(rows) + "\n"


def test_short_wide_and_open_records(spark, tmp_path):
    p = put(tmp_path / "bad.csv", body_of(2000, r1000="1000,short", r1500="1500,a,b,c,d", r1998='1998,"open,x'))
    got = delimited.load(spark, str(p), {"nullify_tokens": []})
    kept = rows(got.df)
    assert [r[0] for r in kept] == list(range(1, 1997)) and kept[999][1:] == ("1000", "short", None)
    assert [int(r[1]) for r in kept] == [i for i in range(1, 1998) if i != 1500]
    assert sorted((r.line, r.lines, r.error_type, r.csv_line) for r in got.rejects.collect()) == [(1501, 1, "TOO MANY COLUMNS", "1500,a,b,c,d"), (1999, 3, "UNQUOTED VALUE", '1998,"open,x')]
    assert got.facts["padded"] and got.facts["rejects"] == 2 and not got.facts["quotes_as_data"]
    silent = delimited.load(spark, str(p), {"nullify_tokens": [], "ignore_errors": True, "parallel": False, "materialize": False})
    assert silent.rejects is None and rows(silent.df) == kept


def test_quote_that_never_closes_is_data(spark, tmp_path):
    got = delimited.load(spark, str(put(tmp_path / "q.csv", body_of(29, r10='10,"open,note'))))
    assert got.facts["quotes_as_data"] and got.facts["footer"] == 0 and got.rejects is None
    assert len(rows(got.df)) == 29 and rows(got.df)[9][1:] == ("10", '"open', "note")
    quoted = "\n".join(['"id","name","city"', *[f'"{i}","N{i}","C{i}"' for i in range(1, 30)]])
    got = delimited.load(spark, str(put(tmp_path / "r.csv", quoted.replace('"10","N10","C10"', '"10","open,"C10"'))))
    assert len(rows(got.df)) == 28 and [r.error_type for r in got.rejects.collect()] == ["UNQUOTED VALUE"]
    assert not any('"' in v for r in rows(got.df) for v in r[1:])
    mixed = ["id,name,city", *[f'{i},"Smith, J{i}",c' for i in range(1, 30)]]
    mixed[10] = '10,"open,c'
    got = delimited.load(spark, str(put(tmp_path / "s.csv", "\n".join(mixed) + "\n")))
    assert len(rows(got.df)) == 27 and [(r.line, r.lines) for r in got.rejects.collect()] == [(11, 2)]
    assert delimited.load(spark, str(tmp_path / "s.csv"), {"strict_mode": False}).rejects is None


def test_late_quoted_line_breaks(spark, tmp_path):
    """Breaks far behind the sample, over splits: records stay whole and in order."""
    n = 30000
    said = {i: f'"{i}\nsecond, ""line"" of {i}\n\n"' for i in (1501, 15000, 15001, 29999)}
    text = "id,name,note\r\n" + "".join(f"{i},{said.get(i, f'n{i}').replace(chr(10), chr(13) + chr(10))},x\r\n" for i in range(1, n + 1)) + "7,short\r\n"
    p = put(tmp_path / "late.csv", text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
        got = delimited.load(spark, str(p), {"nullify_tokens": []})
        kept = rows(got.df)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got.rejects is None and [r[0] for r in kept] == list(range(1, n + 2))
    assert [r[1] for r in kept] == [*map(str, range(1, n + 1)), "7"] and kept[-1][1:] == ("7", "short", None)
    for i in said:
        assert kept[i - 1][2] == f'{i}\nsecond, "line" of {i}\n\n'.replace("\n", "\r\n")


def parse_lines(text, quote='"'):
    """What the states of lines should give: records by a character-wise reader that gives up a record at a line end after a quote out of place."""
    out, start, lines, inside, bad = [], 0, text.split("\n"), False, False
    for i, line in enumerate(lines):
        at, fresh = 0, not inside
        if not inside:
            start, bad = i, False
        while at < len(line):
            if inside:
                if line[at] == quote:
                    if line[at + 1 : at + 2] == quote:
                        at += 1
                    else:
                        inside = False
                        if line[at + 1 : at + 2] not in ("", ","):
                            bad = True
                            break
                        fresh = False
            elif line[at] == "," or (at == 0 and fresh):
                nxt = at + 1 if line[at] == "," else at
                if line[nxt : nxt + 1] == quote:
                    inside, at = True, nxt
                fresh = False
            at += 1
        if not inside:
            out.append((start + 1, i - start + 1, bad))
    return out if not inside else [*out, (start + 1, len(lines) - start, True)]


def test_records_of_lines(spark, monkeypatch):
    """Any mixture of quotes, delimiters and line ends, with small blocks, against a reader that goes character by character."""
    import random

    from tablelens.sources import records

    monkeypatch.setattr(records, "BLOCK", 4)
    own, q = random.Random(4), records.Quoting(",", '"')
    for _ in range(12):
        text = "\n".join("".join(own.choices('ab",', weights=(4, 2, own.choice((1, 2)), 2), k=own.randrange(1, 8))) for _ in range(60))
        body = spark.createDataFrame([(i, x, False) for i, x in enumerate(text.split("\n"), 1)], "_line long, _raw string, _wrong boolean")
        got = sorted((r._line, r._lines, r._bad) for r in records.records(body, q).collect())
        assert got == parse_lines(text), text


def test_encoding_of_the_whole_file_decides(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sniff, "detect_encoding", lambda p: sniff.Encoding("utf-8", why="as told"))
    got = delimited.load(spark, str(put(tmp_path / "w.csv", body_of(500, r3="3,a,b,c").encode() + b"501,caf\xe9,x\n")))
    assert got.facts["encoding"] == "cp1252" and rows(got.df)[-1][2] == "café" and got.facts["rejects"] == 1
    got = delimited.load(spark, str(put(tmp_path / "c.csv", b"id,v\n1,x\x81\xe9\n")))
    assert got.facts["encoding"] == "iso-8859-1" and rows(got.df) == [(1, "1", "x\x81é")]
    forced = delimited.load(spark, str(tmp_path / "w.csv"), {"encoding": "utf-8"})
    assert forced.facts["encoding"] == "utf-8" and {r.error_type for r in forced.rejects.collect()} == {"INVALID ENCODING", "TOO MANY COLUMNS"}


def test_bad_byte_in_the_header(spark, tmp_path):
    data = b"id,n\xe9m,city\n" + "".join(f"{i},Zoë,Köln\n" for i in range(1, 400)).encode() + b"400,caf\xe9,x\n401,Ana\n"
    got = delimited.load(spark, str(put(tmp_path / "h.csv", data)))
    assert got.df.columns == [ROW, "id", "ném", "city"] and got.df.count() == 400 and rows(got.df)[-1] == (400, "401", "Ana", None)
    assert [r.error_type for r in got.rejects.collect()] == ["INVALID ENCODING"]


def test_other_text_shapes(spark, tmp_path):
    assert rows(delimited.load(spark, str(put(tmp_path / "hash.csv", "code,n\n#N/A,1\n#2,2\n"))).df) == [(1, "#N/A", "1"), (2, "#2", "2")]
    long = "x" * 2_100_000
    assert rows(delimited.load(spark, str(put(tmp_path / "l.csv", f"id,name\n1,{long}\n"))).df) == [(1, "1", long)]
    assert rows(delimited.load(spark, str(put(tmp_path / "mac.csv", "id,name\r1,a\r2,b\r"))).df) == [(1, "1", "a"), (2, "2", "b")]
    assert rows(delimited.load(spark, str(put(tmp_path / "e.csv", "id,a,b\n1,,\"\"\n\n2,x,y\n"))).df) == [(1, "1", None, None), (2, "2", "x", "y")]
    assert rows(delimited.load(spark, str(put(tmp_path / "k.csv", "id;a\n1;'x;y'\n2;'z'\n")), {"quote": "'"}).df) == [(1, "1", "x;y"), (2, "2", "z")]
    assert rows(delimited.load(spark, str(put(tmp_path / "b.csv", 'id,a\n1,"x\\"y, z"\n2,w\n')), {"escape": "\\", "delimiter": ","}).df) == [(1, "1", 'x"y, z'), (2, "2", "w")]
    with pytest.raises(LoadError, match="big-endian"):
        delimited.load(spark, str(put(tmp_path / "be.csv", b"\xfe\xff" + "id,name\n1,x\n".encode("utf-16-be"))))


def test_numbers_follow_file_order_over_splits(spark, tmp_path):
    n = 60000
    p = put(tmp_path / "big.csv", "id,v\n" + "".join(f"{i},{'x' * (i % 40)}\n" for i in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
        got = delimited.load(spark, str(p)).df
        assert got.rdd.getNumPartitions() > 3
        assert got.filter(F.col(ROW) != F.col("id").cast("long")).count() == 0 and got.count() == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_quoted_line_breaks(spark, tmp_path):
    p = put(tmp_path / "q.csv", 'id,note\n1,"a\nb"\n2,c\n')
    assert rows(delimited.load(spark, str(p)).df) == [(1, "1", "a\nb"), (2, "2", "c")]


@pytest.mark.parametrize("encoding,byte,name", [("cp1252", "é’", "cp1252"), ("latin-1", "éü", "latin-1"), ("utf-8", "é’", "utf-8")])
def test_encodings(spark, tmp_path, encoding, byte, name):
    p = put(tmp_path / "e.csv", f"id,name\n1,{byte}\n", encoding)
    got = delimited.load(spark, str(p))
    assert got.facts["encoding"] == name and rows(got.df) == [(1, "1", byte)]


def test_few_bad_bytes_reject_their_rows(spark, tmp_path):
    lines = [f"{i},zürich{i}".encode() for i in range(300)]
    lines[100] = b"100,z\xfcrich"
    p = put(tmp_path / "b.csv", b"id,city\n" + b"\n".join(lines) + b"\n")
    got = delimited.load(spark, str(p))
    assert got.df.count() == 299 and [r.error_type for r in got.rejects.collect()] == ["INVALID ENCODING"]
    assert got.df.filter("id = '7'").first()["city"] == "zürich7"


def test_utf16(spark, tmp_path):
    p = put(tmp_path / "u.csv", "﻿id,name\n1,é\n2,x\n", "utf-16-le")
    assert [r[2] for r in rows(delimited.load(spark, str(p)).df)] == ["é", "x"]


def test_titles_and_footer(spark, tmp_path):
    p = put(tmp_path / "r.csv", "Report\nJanuary 2024\nid,name,note\n" + "".join(f"{i},n{i},x{i}\n" for i in range(500)) + "Total,500,\n")
    got = delimited.load(spark, str(p))
    assert (got.facts["first_row"], got.facts["footer"], got.df.count()) == (3, 1, 500)
    assert delimited.load(spark, str(p), {"skip_footer": 0}).df.count() == 501
    assert got.df.agg(F.min(ROW), F.max(ROW)).first() == (1, 500)


def test_no_header(spark, tmp_path):
    p = put(tmp_path / "n.csv", "".join(f"{i},{i * 2},2024-01-{i:02d}\n" for i in range(1, 20)))
    assert delimited.load(spark, str(p)).df.columns == [ROW, "col_0", "col_1", "col_2"]


@pytest.mark.parametrize("d", sniff.DELIMITERS)
def test_delimiters(spark, tmp_path, d):
    p = put(tmp_path / "d.txt", f"a{d}b\n1{d}2\n3{d}4\n")
    assert sniff.score_delimiters(p, "utf-8")[0].delimiter == d
    assert rows(delimited.load(spark, str(p)).df) == [(1, "1", "2"), (2, "3", "4")]


def test_big_endian_is_told(tmp_path):
    assert sniff.detect_encoding(put(tmp_path / "x", b"\xfe\xff\x00a")).big_endian
    assert sniff.detect_encoding(put(tmp_path / "y", b"\x81abc")).name == "iso-8859-1"
    assert sniff.detect_encoding(put(tmp_path / "z", b"")).name == "utf-8"


def test_names():
    assert naming.column_names([" a ", "", "A", "a"]) == ["a", "column1", "A_1", "a_2"]
    assert [naming.snake_case(x) for x in ("claim.id", "PatientID", "Patient_ID", "ID", "a-b c", "...", "HTTPServer")] == ["claim_id", "patient_id", "patient_id", "id", "a_b_c", "col", "http_server"]
    assert naming.table_name("A b", ["a_b"]) == "a_b_2"


def test_options():
    o = cleaned({"first_row": "", "skip_rows": "x", "skip_footer": "2", "delimiter": "", "junk": 1})
    assert (o.first_row, o.skip_rows, o.skip_footer, o.delimiter) == (None, 0, 2, None)


def test_placeholders(spark):
    df = spark.createDataFrame([("1.5", "NA", "2024-01-02", "1", "NA", "na"), ("NA", "US", "NaN", "x", "NA", "2"), ("1e3", "DE", "1/2/24", "NA", "NA", "3")], "amount string, country string, day string, mixed string, all_na string, lower string")
    assert tokens.qualifying(df, ("NA", "NaN")) == ["amount", "day"]
    assert [r.amount for r in tokens.nullify(df).collect()] == ["1.5", None, "1e3"]


def test_parquet_sets(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "w"))
    (part,) = (tmp_path / "w").glob("part-*.parquet")
    part.replace(tmp_path / "a.parquet")
    spark.range(10, 13).selectExpr("id", "'x' as s").coalesce(1).write.parquet(str(tmp_path / "v"))
    (part,) = (tmp_path / "v").glob("part-*.parquet")
    part.replace(tmp_path / "b.parquet")
    found = parquet.siblings(str(tmp_path / "a.parquet"))["paths"]
    got = parquet.load(spark, found[0], {"parquet_paths": found}).df
    assert [(r[ROW], r["id"], r["s"]) for r in got.orderBy(ROW).collect()][4:6] == [(5, 4, None), (6, 10, "x")]


def test_workbooks(spark, tmp_path):
    p = str(tmp_path / "b.xlsx")
    excel.write(p, ["id", "v", "txt"], [[1, 3.66666666666667, "007"], [2, 5.0, None], [3, 1e-13, " x<&> "]])
    assert excel.is_workbook(p) and excel.inspect(p)[0]["end_col"] == "C"
    got = excel.load_sheet(spark, p)
    assert rows(got.df) == [(1, "1", "3.66666667", "007"), (2, "2", "5", None), (3, "3", "0", " x<&> ")]
    with pytest.raises(LoadError):
        excel.load_sheet(spark, p, "none")


def test_workbook_dates(spark, tmp_path):
    p = str(tmp_path / "d.xlsx")
    excel.write(p, ["day"], [[45306], [45307.5]])
    styles = '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'
    with zipfile.ZipFile(p) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    parts["xl/worksheets/sheet1.xml"] = parts["xl/worksheets/sheet1.xml"].replace(b'<c r="A2">', b'<c r="A2" s="1">').replace(b'<c r="A3">', b'<c r="A3" s="1">')
    with zipfile.ZipFile(p, "w") as z:
        for n, b in (parts | {"xl/styles.xml": styles.encode()}).items():
            z.writestr(n, b)
    assert [r[1] for r in rows(excel.load_sheet(spark, p).df)] == ["2024-01-15", "2024-01-16 12:00:00"]
    assert [excel.format_intent(x) for x in ("yyyy-mm-dd", "h:mm", "d/m/yy hh:mm", "0.00", "mmm", '0 "days"')] == ["date", "time", "datetime", None, "date", None]


def test_jdbc_urls():
    assert jdbc.url("sqlserver", "h", "d").startswith("jdbc:sqlserver://h:1433;databaseName=d")
    with pytest.raises(ValueError):
        jdbc.url("none", "h")


# profiling and inference


def test_profile_of_texts(spark):
    values = ["a b", " a", "a\xa0", "\ta", "　x", "a@b.co", "", "  ", None, "12", "2024-01-02", "yes"]
    df = spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], f"{ROW} long, v string")
    p = profile.profile(df, "v")
    assert (p["kind"], p["row_count"], p["null_count"], p["empty_count"], p["whitespace_only_count"], p["email_count"]) == ("varchar", 12, 1, 1, 1, 1)
    assert p["edge_space_count"] == 4 and p["unicode_edge_count"] == 2
    assert p["min_length_row"] == 7 and p["max_length_row"] == 11
    assert p["sniff"] == {"date": 9.09, "timestamp": 9.09, "bigint": 9.09, "double": 9.09, "boolean": 9.09}


def test_profile_of_others(spark):
    df = spark.createDataFrame([(1.0, True, dt.datetime(2024, 1, 1, 23), [1]), (2.0, False, dt.datetime(2024, 1, 3, 1), [2]), (100.0, None, None, None)], "n double, b boolean, t timestamp_ntz, l array<int>")
    assert profile.profile(df, "t", dt.datetime(2024, 1, 2))["range_days"] == 2
    assert profile.profile(df, "t", dt.datetime(2024, 1, 2))["future_count"] == 1
    assert profile.profile(df, "b")["kind"] == profile.profile(df, "l")["kind"] == "other"
    assert profile.profile(df, "n")["outlier_count"] == 0 and profile.profile(df.limit(0), "n")["mean"] is None


INFERRED = [
    (["1/5/2024", "2/28/2024"], ("DATE", "%m/%d/%Y", False)),
    (["25/12/2024", "01/02/2024"], ("DATE", "%d/%m/%Y", False)),
    (["2024-01-15", "2024-02-01"], ("DATE", None, False)),
    (["Jan 5, 2024", "Feb 6, 2024"], ("DATE", "%b %d, %Y", False)),
    (["2024-01-15 10:30:00", "2024-01-15T11:00:00Z"], ("TIMESTAMP", None, False)),
    (["2024-01-15 00:00:00", "2024-01-16 00:00:00"], ("DATE", None, True)),
    (["1/15/2024 0:00:00", "1/16/2024 0:00:00"], ("DATE", "%m/%d/%Y %H:%M:%S", False)),
    (["1250.00", "3.5", "12.25"], ("DECIMAL(6,2)", None, False)),
    (["1.0", "2.0"], ("BIGINT", None, False)),
    (["1e5", "2.5e-3"], ("DOUBLE", None, False)),
    (["yes", "No"], ("BOOLEAN", None, False)),
    (["010876", "7"], (None, None, False)),
    ([" 12\xa0", "\t7", "3"], ("BIGINT", None, False)),
    (["x", "y"], (None, None, False)),
    (["0.3333333333333333333333333333333333333333", "1"], ("DECIMAL(38,37)", None, False)),
]


def test_inference(spark):
    for values, want in INFERRED:
        a = infer.analyze(frame(spark, "v", [*values, None]))["v"]
        assert infer.pick(a) == want, values


def test_thresholds(spark):
    assert infer.pick(infer.analyze(frame(spark, "v", [str(i) for i in range(99)] + ["N/A"]))["v"])[0] == "BIGINT"
    assert infer.pick(infer.analyze(frame(spark, "v", [str(i) for i in range(80)] + ["?"] * 20))["v"])[0] is None
    assert infer.percent(99999, 100000) == 99.99 and infer.percent(1, 10**9) == 0.0 or infer.percent(1, 10**9) >= 0.0
    padded = [f"{i}" for i in range(3000)] + ["5000 "] * 20
    a = infer.analyze(frame(spark, "v", padded))["v"]
    assert a.coverage["BIGINT"] == 100.0


def test_typed_clones(spark):
    df = spark.createDataFrame([(1, " 5 ", "1/2/24", "x"), (2, "bad", "13/45/24", None)], f"{ROW} long, a string, b string, c string")
    specs = [derive.CastSpec("a", "n", "BIGINT"), derive.CastSpec("b", "d", "DATE", date_format="%m/%d/%y"), derive.CastSpec("c", "c")]
    assert [tuple(r) for r in derive.apply(df, specs).orderBy(ROW).collect()] == [(1, 5, dt.date(2024, 1, 2), "x"), (2, None, None, None)]
    assert derive.apply(df, specs, "c = 'x'").count() == 1
    with pytest.raises(Exception, match="cannot read as BIGINT"):
        derive.apply(df, [derive.CastSpec("a", "n", "BIGINT", strict=True)]).collect()
    assert [s.suggested for s in derive.suggest_casts(df.filter(f"{ROW} = 1"))] == ["BIGINT", "DATE", None]


# DDL and exports


def test_ddl(spark):
    df = spark.createDataFrame([("1.50", "abc", "Yes", 5, 3.25, dt.datetime(1700, 1, 1, 5), b"xy", "12"), ("2.25", "xyz", "no", 300, None, dt.datetime(2024, 1, 1), b"x", "f7")], "fee string, Code string, `order` string, n int, d double, t timestamp_ntz, bin binary, m string")
    types = {c.source: (c.sql_type, c.nullable) for c in ddl.column_types(df)}
    assert types == {"fee": ("decimal(3, 2)", False), "Code": ("char(3)", False), "order": ("varchar(3)", False), "n": ("smallint", False), "d": ("decimal(3, 2)", True), "t": ("datetime2", False), "bin": ("varbinary(2)", False), "m": ("char(2)", False)}
    text = ddl.generate(df, "my Table")
    assert text["as_is"].startswith("create table [my Table]\n(   fee") and "[order]" in text["as_is"] and text["as_is"].endswith("\n)\n;")
    assert "my_table" in text["snake_case"] and ddl.generate(df, "t", "duckdb")["as_is"].count("varchar") == 2
    assert {c.sql_type for c in ddl.column_types(df.select("fee", "t"), "spark")} == {"decimal(3, 2)", "timestamp_ntz"}


def test_ddl_one_stray_value_keeps_text(spark):
    df = spark.range(20000).select(F.when(F.col("id") == 7039, "f7039").otherwise(F.col("id").cast("string")).alias("v"))
    assert ddl.column_types(df, "sqlserver")[0].sql_type == "varchar(5)"


def test_flat_parquet_and_excel_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, ' pad "q" ', 1.5), (2, 2, "\xa0", None), (3, 3, "a|b", 1e16)], f"{ROW} long, id int, name string, amount double")
    assert export.to_flat(df, str(tmp_path / "o.txt")) == 3
    assert (tmp_path / "o.txt").read_bytes() == b'id|name|amount\r\n1|"pad ""q"""|1.5\r\n2||\r\n3|"a|b"|1e+16\r\n'
    export.to_flat(df, str(tmp_path / "t.tsv"), "\t", False, null="-", line_end="\n", mappings=[export.Mapping("id", "key")], trim=False)
    assert (tmp_path / "t.tsv").read_text() == "1\n2\n3\n"
    export.export(df, str(tmp_path / "o.parquet"), "parquet", compression="zstd")
    assert spark.read.parquet(str(tmp_path / "o.parquet")).columns == ["id", "name", "amount"]
    assert export.to_excel(df, str(tmp_path / "o.xlsx")) == 3
    assert [r[2] for r in rows(excel.load_sheet(spark, str(tmp_path / "o.xlsx")).df)] == ['pad "q"', None, "a|b"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["o.parquet", "o.txt", "o.xlsx", "t.tsv"]


def test_mappings_and_offenders(spark):
    df = spark.createDataFrame([(1, "1", "ab"), (2, "x", "abcdef"), (3, None, "c")], f"{ROW} long, `Claim.Id` string, txt string")
    assert [(m.target, m.nullable) for m in export.suggest_mappings(df)] == [("claim_id", True), ("txt", False)]
    bad = export.offending_rows(df, [export.Mapping("Claim.Id", "claim_id", "int", False), export.Mapping("txt", "txt", "varchar(3)")])
    assert [(b["row"], b["marked"]) for b in bad] == [(2, ["Claim.Id", "txt"]), (3, ["Claim.Id"])]
    assert "create table dbo.t" in export.mapping_ddl(export.suggest_mappings(df), "t", schema="dbo")
    assert export.clipboard(df.select("txt").limit(1)) == "txt\nab"


# SQL and the workspace


def test_sql_runner(spark):
    r = Runner(spark)
    got = r.run("-- c\n select 1 // 0 as a, 5 % 0 as b, null as x, array(null) as y")
    assert got["ok"] and got["rows"] == [[None, None, None, "[None]"]]
    assert [f.dataType.simpleString() for f in r.result.schema.fields][2:] == ["string", "array<string>"]
    assert not r.run("select nope")["ok"]
    assert r.run("create or replace temp view zz as select 3 as a")["ok"] and r.run("(select a from zz)")["rows"] == [[3]]
    big = r.run("select id from range(1000)")
    assert big["truncated"] and big["row_count"] is None and r.count() == 1000 and len(big["rows"]) == 500 and len(r.page(990, 100)) == 10
    assert r.run("summarize select 1 as a")["row_count"] == 1
    assert gives_rows("/* x */ ((with t as (select 1) select * from t))") and not gives_rows("drop view x")
    assert statements("a; b ';' ; -- c;\n") == ["a", "b ';'"]
    assert translate("select * exclude (a), '//' from \"my t\"") == "select * except (a), '//' from `my t`"


def test_workspace(spark, tmp_path):
    w = Workspace(spark)
    p = put(tmp_path / "people.csv", "id,n\n1,10\n2,9\n3,\n")
    assert w.load_file(str(p)).name == "people" and w.load_file(str(p)).name == "people_2"
    assert w.rows("people", 1, 1) == [[2, "2", "9"]] and [r[2] for r in w.rows("people", sort="n")] == ["9", "10", None]
    assert w.pivot_row("people", 1) == [(1, ROW, 1), (2, "id", "1"), (3, "n", "10")]
    assert w.run_sql("select count(*) as k from people")["rows"] == [[3]]
    assert w.auto_derive("people", "typed") == 3 and w.schema("typed")[1]["type"] == "bigint"
    assert w.save_query("select id from people where n is null", "q") == 1
    assert w.rename("q", "q2") and not w.rename("q", "x") and w.drop("q2") and not w.drop("q2") and w.materialize("people")
    assert [t["name"] for t in w.list_tables()] == ["people", "people_2", "typed"]
    assert w.export("people", str(tmp_path / "x.txt"), "flat") == 3
    fake = put(tmp_path / "fake.xlsx", "a,b\n1,2\n")
    assert w.load_file(str(fake)).format == "csv"
    with pytest.raises(LoadError):
        w.load_file(str(tmp_path / "none.csv"))


def test_quantiles_by_ranges(spark, monkeypatch):
    import random
    own = random.Random(3)
    monkeypatch.setattr(profile, "FEW", 5)
    monkeypatch.setattr(profile, "SLICES", 4)
    for values in ([7.0], [1.0, 2.0], [5.0] * 40, [own.gauss(0, 1e6) for _ in range(300)], [own.choice((1.0, 2.0, 1e300, -1e308, float("inf"))) for _ in range(80)]):
        df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
        got = profile.quantiles(df, "v", [0.25, 0.5, 0.75])
        ends = sorted(values)
        for share, g in zip((0.25, 0.5, 0.75), got, strict=True):
            x = (len(ends) - 1) * share
            a, b = ends[int(x)], ends[min(len(ends) - 1, int(x) + 1)]
            w = a if a == b or x == int(x) else a + (b - a) * (x - int(x))
            assert g == w or abs(g - w) <= 1e-9 * abs(w), (values[:3], share, g, w)
    assert profile.quantiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]


def test_helpers_keep_any_column_names(spark):
    from tablelens.plans import shims

    left = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, 1, "c")], "k int, t int, _last string")
    right = spark.createDataFrame([(1, 4, "x"), (1, 9, "y")], "k int, t int, v string")
    assert {tuple(r) for r in shims.asof_join(left, right, "k", "t", ["v"]).collect()} == {(1, 5, "a", "x"), (1, 9, "b", "y"), (2, 1, "c", None)}
    df = left.withColumnsRenamed({"t": "_r", "_last": "_q"})
    assert [tuple(r) for r in shims.distinct_on(df, ["k"], [F.desc("_r")]).orderBy("k").collect()] == [(1, 9, "b"), (2, 1, "c")]
    assert shims.qualify(df, F.count(F.lit(1)).over(Window.partitionBy("k")), lambda c: c > 1).columns == ["k", "_r", "_q"]


def test_many_parquet_files_in_list_order(spark, tmp_path):
    for name, lo in (("b a%.parquet", 0), ("aa.parquet", 10), ("a.parquet", 20)):
        export.to_parquet(spark.range(lo, lo + 3), str(tmp_path / name))
    got = parquet.read_numbered(spark, [str(tmp_path / n) for n in ("a.parquet", "b a%.parquet", "aa.parquet")])
    assert [tuple(r) for r in got.orderBy(ROW).collect()] == [(1, 20), (2, 21), (3, 22), (4, 0), (5, 1), (6, 2), (7, 10), (8, 11), (9, 12)]


def test_progress_and_cancel(spark):
    import threading
    import time

    r = Runner(spark)
    out = {}
    t = threading.Thread(target=lambda: out.update(r.run("select sum(a.id * b.id % 7) as s from range(400000) a join range(400000) b on a.id % 50 = b.id % 50")))
    t.start()
    seen = []
    for _ in range(200):
        time.sleep(0.1)
        seen.append(r.progress())
        if seen[-1]["tasks"]:
            break
    assert set(seen[-1]) == {"done", "running", "tasks", "percent"} and seen[-1]["tasks"] > 0
    for _ in range(100):
        r.cancel()
        t.join(0.2)
        if not t.is_alive():
            break
    assert not t.is_alive() and not out["ok"] and r.progress()["percent"] is None


DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def test_database_round_trip(spark):
    address = "jdbc:derby:memory:tablelens;create=true"
    df = spark.range(500).select("id", F.concat(F.lit("n"), "id").alias("name"), (F.col("id") / 4).alias("share"))
    assert jdbc.write(df, address, "PLAIN", **DERBY) == 500
    got = jdbc.read(spark, address, "PLAIN", cap=None, split=("id", 0, 500, 4), **DERBY)
    assert got.rdd.getNumPartitions() == 4 and sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    assert jdbc.read(spark, address, query='select "id" from PLAIN where "id" < 10;', cap=3, **DERBY).count() == 3
    with pytest.raises(Exception, match="(?i)already exists"):
        jdbc.write(df, address, "PLAIN", **DERBY)
    assert jdbc.write(df.limit(5), address, "PLAIN", "append", **DERBY) == 5
    assert [(t["name"], t["rows"]) for t in jdbc.tables(spark, address, **DERBY)] == [("PLAIN", 505)]
    # all or nothing: what a column cannot take leaves the table as it was
    create = 'create table TYPED ("id" bigint not null, "name" varchar(4), "share" double)'
    types = {"name": "varchar(200)"}
    with pytest.raises(Exception, match="(?i)truncation|22001"):
        jdbc.write(df.withColumn("name", F.concat("name", F.lit("-long"))), address, "TYPED", staging="STAGE", create=create, types=types, **DERBY)
    assert [t["name"] for t in jdbc.tables(spark, address, counts=False, **DERBY)] == ["PLAIN"]
    assert jdbc.write(df, address, "TYPED", staging="STAGE", create=create, types=types, **DERBY) == 500
    with pytest.raises(ValueError):
        jdbc.write(df, address, "typed", staging="STAGE", create=create, **DERBY)
    assert jdbc.write(df.limit(7), address, "TYPED", "append", "STAGE", types=types, **DERBY) == 7
    assert {t["name"]: t["rows"] for t in jdbc.tables(spark, address, **DERBY)} == {"PLAIN": 505, "TYPED": 507}
    assert jdbc.write(df.limit(2), address, "TYPED", "drop", "STAGE", create=create, types=types, **DERBY) == 2
    assert [(c["name"], c["type"], c["nullable"]) for c in jdbc.columns(spark, address, "typed", **DERBY)] == [("id", "bigint", False), ("name", "varchar", True), ("share", "double", True)]


def test_results_hide_row_numbers(spark):
    w = Workspace(spark)
    w.register("t", spark.createDataFrame([(1, "a"), (2, "b")], f"{ROW} long, v string"))
    got = w.run_sql("select a.*, b.v as w from t a join t b using (v) order by 1")
    assert got["columns"] == ["v", "w"] and got["rows"] == [["a", "a"], ["b", "b"]]
    assert w.run_sql(f"select {ROW} from t order by 1")["rows"] == [[1], [2]]


def test_what_a_message_blames(spark):
    df = spark.createDataFrame([(1, "a", "5"), (2, "toolong", "x"), (3, None, "7")], f"{ROW} long, name string, n string")
    wanted = [export.Mapping("name", "full_name", "varchar(4)", False), export.Mapping("n", "nr", "int")]
    assert [(r["row"], r["marked"]) for r in export.blamed("Invalid value for column 'nr'", df, wanted)] == [(2, ["n"])]
    assert [(r["row"], r["marked"]) for r in export.blamed("Column [dbo].[full_name] does not allow nulls", df, wanted)] == [(2, ["name"]), (3, ["name"])]
    loose = [export.Mapping("name", "full_name"), export.Mapping("n", "nr")]
    assert [(r["row"], r["marked"]) for r in export.blamed("A truncation error: VARCHAR 'toolong' to length 4", df, loose)] == [(2, ["name"])]
    assert export.blamed("no idea", df, loose) == []


def test_ends_of_blank_texts_only(spark):
    """More blank texts at both ends of the order than a sample holds: the dates between them still count."""
    blanks = [" " * k for k in range(1, 41)] + ["\u3000" * k for k in range(1, 41)]
    df = frame(spark, "v", blanks + [f"{m:02d}/{d:02d}/2023" for m in range(1, 13) for d in range(1, 29)])
    a = infer.analyze(df)["v"]
    assert a.format == "%m/%d/%Y" and infer.pick(a) == ("DATE", "%m/%d/%Y", False) and a.non_null == 336
    assert infer.pick(infer.analyze(frame(spark, "v", blanks))["v"]) == (None, None, False)


def test_recursion_beyond_a_million_rows(spark):
    """Spark stops a recursion at a million rows; one without an end is still told by its levels."""
    from tablelens.plans.sqlrun import Runner, statement

    text = "with recursive t(k, n) as (select id, 0 from range(400000) union all select k, n + 1 from t where n < 2) select n, count(*) as c from t group by n"
    assert {(r.n, r.c) for r in statement(spark, text).collect()} == {(0, 400_000), (1, 400_000), (2, 400_000)}
    got = Runner(spark).run("with recursive t(k) as (select 1 union all select k + 1 from t) select count(*) as n from t")
    assert not got["ok"] and "RECURSION" in got["error"].upper()


def test_broken_orders_are_written_by_tasks(spark, monkeypatch):
    """No row comes to the driver, and the text is in order whatever its number of files."""
    from pyspark.sql.classic.dataframe import DataFrame

    from tablelens import workbench_queries

    with monkeypatch.context() as m:
        m.setattr(DataFrame, "collect", lambda self: pytest.fail("rows on the driver"))
        path = workbench_queries._broken_orders(spark, "/root/testdata/sf0.001")
    lines = [r[0] for r in delimited.lines(spark, delimited.Stored(spark, path).paths, "utf-8").orderBy("_line").select("_raw").collect()]
    keys = [int(x.split(",")[0]) for x in lines[1:-1]]
    assert lines[0] == "key,customer,status" and lines[-1] == '-1,"open,F' and keys == sorted(keys) and len(keys) == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()


def test_lines_within_many_records_are_not_broadcast(spark, monkeypatch):
    from tablelens.sources import records

    monkeypatch.setattr(records, "FEW", 0)
    body = spark.createDataFrame([(1, 'a,"b', False), (2, 'c"', False), (3, "d,e", False)], "_line long, _raw string, _wrong boolean")
    got = records.records(body, records.Quoting(",", '"'))
    assert "strategy=merge" in got._jdf.queryExecution().optimizedPlan().toString()
    assert [(r._line, r._text) for r in got.orderBy("_line").collect()] == [(1, 'a,"b\nc"'), (3, "d,e")]


def test_names_of_all_forms(spark):
    from tablelens import workbench_queries

    got = {r.name: r.snake for r in workbench_queries.names_snake_case(spark, "/root/testdata/sf0.001").collect()}
    assert {"claim.id", "PatientID", "HTTPServer", "a-b c", "..."} <= got.keys() and got["..."] == "col" and got["HTTPServer3"] == "http_server3"
    assert len(got) > spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").count()


def _cut_lines(spark, text, sizes):
    """The lines of a text, in tasks of these sizes, as a file's splits are."""
    lines, at = list(enumerate(text.split("\n"), 1)), 0
    parts = []
    for n in sizes:
        parts.append([(i, x, False) for i, x in lines[at : at + n]])
        at += n
    rdd = spark.sparkContext.parallelize(parts + [[(i, x, False) for i, x in lines[at:]]], len(parts) + 1).flatMap(lambda x: x)
    return spark.createDataFrame(rdd, "_line long, _raw string, _wrong boolean")


def test_records_over_splits(spark):
    """Records of one split, of two and of many, wherever the splits end; an open quote that never closes; Arrow batches of few lines."""
    import random

    from tablelens.sources import records

    own, q = random.Random(8), records.Quoting(",", '"')
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        for k in range(10):
            text = "\n".join("".join(own.choices('ab",\r', weights=(4, 2, own.choice((1, 2)), 2, k % 3 == 0), k=own.randrange(0, 8))) for _ in range(60)) + ("" if k % 2 else '\nx,"')
            body = _cut_lines(spark, text, own.choices((1, 2, 5, 9), k=8))
            one = _cut_lines(spark, text, ())
            got, whole = (sorted((r._line, r._lines, r._bad, r._text) for r in records.records(b, q).collect()) for b in (body, one))
            assert got == whole, text
            lines = text.split("\n")
            plain = [(a, n, bad, lines[a - 1] if bad else "\n".join(lines[a - 1 : a - 1 + n])) for a, n, bad in parse_lines(text)] if "\r" not in text else None
            assert plain is None or got == [x for x in plain if x[3]]
            numbered = records.in_order(records.records(body, q), "n") if "_run" in records.records(body, q).columns else None
            assert numbered is None or [(r._line, r.n) for r in numbered.orderBy("_line").collect()] == [(x[0], i) for i, x in enumerate(got, 1)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_texts_of_records_do_not_move(spark):
    """Neither joining lines to records nor numbering them shuffles texts, but for pieces of records that go over splits."""
    from tablelens.sources import records

    text = "\n".join(f'{i},"first\nsecond, ""line"" of {i}\n"' for i in range(300))
    body = _cut_lines(spark, text, (100, 200, 301, 0, 7))
    got = records.records(body, records.Quoting(",", '"'))
    assert [r._text for r in got.orderBy("_line").collect()] == [f'{i},"first\nsecond, ""line"" of {i}\n"' for i in range(300)]
    assert [r.n for r in records.in_order(got, "n").orderBy("_line").collect()] == list(range(1, 301))
    assert 0 < got.filter("_over").count() <= 5 and not got.filter("not _over")._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_lines_of_a_long_last_value_are_no_footer(spark, tmp_path):
    """The tail that layouts are told from lies within one value, whose last lines look like summary records; a footer behind values with breaks is one."""
    last = "x" * 70000 + "".join(f"\nline {k} of it" for k in range(7))
    text = "id|lang|text\n" + "".join(f"{i}|en|plain text {i}\n" for i in range(1, 400))
    got = delimited.load(spark, str(put(tmp_path / "l.txt", text + f'400|en|"{last}"\n')), {"nullify_tokens": []})
    assert got.facts["footer"] == 0 and got.facts["row_count"] == 400
    assert rows(got.df)[-1] == (400, "400", "en", last)
    got = delimited.load(spark, str(put(tmp_path / "f.txt", text + f'400|en|"{last}"\n' + "Total|400\n")), {"nullify_tokens": []})
    assert got.facts["footer"] == 1 and rows(got.df)[-1] == (400, "400", "en", last)
    got = delimited.load(spark, str(put(tmp_path / "g.txt", text + '400|en|"a\nb"\n401|en|c\n' + "Total|401\n")), {"nullify_tokens": []})
    assert got.facts["footer"] == 1 and rows(got.df)[-1] == (401, "401", "en", "c")
