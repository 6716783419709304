"""Text from any store, in a session whose settings are not the workbench's."""

import random

import pytest

from tablelens.plans.workspace import Workspace
from tablelens.session import SQL_SETTINGS, semantics
from tablelens.sources import delimited, records, sniff, store

rng = random.Random(4)


@pytest.fixture
def plain(spark):
    """The session as Spark makes it: errors instead of nulls, timestamps with a zone."""
    before = {k: spark.conf.get(k) for k in SQL_SETTINGS}
    spark.conf.set("spark.sql.ansi.enabled", "true")
    spark.conf.set("spark.sql.timestampType", "TIMESTAMP_LTZ")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def pieces():
    good = ["a", "\n", "é".encode(), "漢".encode(), "\U0001f600".encode(), b"\xf4\x8f\xbf\xbf", b"\xed\x9f\xbf"]
    bad = [b"\xe9", b"\x80", b"\xe2\x82", b"\xf0\x9f\x98", b"\xed\xa0\x80", b"\xc0\xaf", b"\xf4\x90\x80\x80", b"\xff", b"\xc3\n", b"\xe0\x80"]
    return [x.encode() if isinstance(x, str) else x for x in good], bad


@pytest.mark.parametrize("k", range(6))
def test_census_counts_as_the_decoder_does(plain, tmp_path, k):
    good, bad = pieces()
    data = b"".join(rng.choice(bad if rng.random() < k / 10 else good) for _ in range(900)) + bad[k]
    (tmp_path / "x.txt").write_bytes(data)
    mine, local = store.census(plain, [str(tmp_path / "x.txt")]), sniff.Local(tmp_path / "x.txt").census()
    errors = data.decode("utf-8", "replace").count("�")
    assert mine.bad == errors and (mine.undefined, mine.controls) == (local.undefined, local.controls)
    if errors <= 100:
        assert mine == local


def test_stored_reads_heads_and_tails(plain, tmp_path):
    (tmp_path / "b.txt").write_bytes(b"0123456789")
    (tmp_path / "a.txt").write_bytes(b"abcdef")
    (tmp_path / "_SUCCESS").write_bytes(b"")
    (tmp_path / ".hidden").write_bytes(b"xx")
    for path in (f"file://{tmp_path}", f"{tmp_path}/*.txt"):
        both = store.Stored(plain, path)
        assert [p.rsplit("/", 1)[1] for p in both.paths] == ["a.txt", "b.txt"]
        assert both.head(4) == (b"abcd", False) and both.head(6) == (b"abcdef", True)
        assert both.tail(4) == (b"6789", False) and both.tail(3, True) == (b"6789", False) and both.tail(99) == (b"0123456789", True)
    assert not store.Stored(plain, f"file://{tmp_path}/none.txt").exists
    with pytest.raises(delimited.LoadError):
        delimited.load(plain, f"{tmp_path}/none.txt")


@pytest.mark.parametrize("codec,name", [("utf-8", "utf-8"), ("cp1252", "cp1252"), ("utf-16", "utf-16"), ("latin-1", "latin-1")])
def test_encodings_without_settings(plain, tmp_path, codec, name):
    tail = "éü" if codec == "latin-1" else "é’"
    (tmp_path / "e.csv").write_bytes(f"nr,name\n1,x{tail}\n2,y{tail}\n".encode(codec))
    got = delimited.load(plain, f"file://{tmp_path}/e.csv")
    assert got.facts["encoding"] == name and [r.name for r in got.df.orderBy("nr").collect()] == [f"x{tail}", f"y{tail}"]


@pytest.mark.parametrize("encoding", ["utf-8", "cp1252", "latin-1", "utf-16", "cp1250"])
def test_decoded_as_python_does(plain, encoding):
    raw = [bytes(rng.choice(b"a\x81\xe9\x92\x80\x00\xd8\xdc\x3d\xde\xfd\xff") for _ in range(rng.randrange(12))) for _ in range(300)]
    df = plain.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)], "i int, b binary").selectExpr("i", "b", "cast(b as string) as v")
    text, wrong = records.decoded(df.v, encoding)
    codec = {"utf-16": "utf-16-le"}.get(encoding, encoding)
    for r in df.select("i", text.alias("t"), wrong.alias("w")).collect():
        want = raw[r.i].decode(codec, "replace")
        try:
            raw[r.i].decode(codec)
            assert not r.w, raw[r.i]
        except UnicodeDecodeError:
            assert r.w, raw[r.i]
        if not r.w:
            assert r.t == want
        elif encoding in ("cp1252", "cp1250"):
            assert r.t == want


def test_bad_bytes_are_rejects_in_any_session(plain, tmp_path):
    (tmp_path / "u.csv").write_bytes("nr,name\n".encode() + "".join(f"{i},né\n" for i in range(200)).encode() + b"200,n\xe9\n")
    got = delimited.load(plain, str(tmp_path / "u.csv"))
    assert got.facts["encoding"] == "utf-8" and got.df.count() == 200 and [r.error_type for r in got.rejects.collect()] == ["INVALID ENCODING"]
    (tmp_path / "w.csv").write_bytes(b"nr,name\n1,\x93a\x94\n2,\x8d\n3,b\n")
    got = delimited.load(plain, str(tmp_path / "w.csv"), {"encoding": "cp1252"})
    assert got.df.count() == 2 and got.rejects.count() == 1


def test_folder_with_headers_in_all_files(plain, tmp_path):
    for k, body in enumerate(("1,a\n2,b\n", "3,c\n", "", "4,\"d\ne\"\n5,f\n")):
        (tmp_path / f"p{k}.csv").write_bytes(b"\xef\xbb\xbftitle\nnr,name\n" + body.encode() if body else b"")
    (tmp_path / "p9.csv").write_text("6,g\n7,h\n")  # without a header
    got = delimited.load(plain, f"file://{tmp_path}", {"first_row": 2})
    assert [(r._src_row_num, r.nr, r.name) for r in got.df.orderBy("_src_row_num").collect()] == [(1, "1", "a"), (2, "2", "b"), (3, "3", "c"), (4, "4", "d\ne"), (5, "5", "f"), (6, "6", "g"), (7, "7", "h")]
    assert Workspace(plain).load_file(f"file://{tmp_path}/p[01].csv", {"first_row": 2}).df.count() == 3


def test_user_sql_means_the_same_in_any_session(plain):
    w = Workspace(plain)
    w.register("t", plain.createDataFrame([(1, "a"), (0, "2")], "n int, s string"))
    got = w.run_sql("select 1 / n as q, cast(s as int) as i, timestamp '2024-01-01 00:00:00' as at from t order by n")
    assert got["ok"] and [r[:2] for r in got["rows"]] == [[None, 2], [1.0, None]]
    assert w.runner.result.schema["at"].dataType.simpleString() == "timestamp_ntz"
    assert w.run_sql("update t set n = cast(s as int)")["ok"] and [r.n for r in w.tables["t"].orderBy("s").collect()] == [2, None]
    assert plain.conf.get("spark.sql.ansi.enabled") == "true"
    with semantics(plain):
        assert plain.conf.get("spark.sql.ansi.enabled") == "false"


def test_load_reads_little_on_the_driver(plain, tmp_path, monkeypatch):
    (tmp_path / "big.csv").write_text("nr,name\n" + "".join(f"{i},some longer name {i}\n" for i in range(150_000)))
    read, old = [], store.Stored._read
    monkeypatch.setattr(store.Stored, "_read", lambda self, at, start, n: (read.append(min(n, self._files[at][2] - start)), old(self, at, start, n))[1])
    got = delimited.load(plain, str(tmp_path / "big.csv"), {"materialize": False})
    assert got.df.count() == 150_000 and max(read) <= sniff.HEAD
