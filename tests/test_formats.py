"""Formats: round trips and odd inputs."""

import pytest

from weftline.operators.keyed import join
from weftline.sources import formats, inline


def same(a, b):
    return sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(a.columns)).collect()))


@pytest.fixture
def nation(spark, sf):
    return spark.read.parquet(f"{sf}/nation.parquet").selectExpr("cast(n_nationkey as long) as k", "n_name", "n_regionkey / 2.0d as half", "n_nationkey > 5 as big")


def test_round_trips(spark, nation, tmp_path):
    for write, read in ((formats.write_nv2, formats.read_nv2), (formats.write_tsv, formats.read_tsv), (formats.write_json, lambda s, p: formats.read_json(s, p, lines=True)), (formats.write_nat, formats.read_nat)):
        p = str(tmp_path / write.__name__)
        write(nation, p)
        assert same(read(spark, p), nation), write.__name__
        with pytest.raises(Exception):
            write(nation, p)
    formats.write_json(nation, str(tmp_path / "array"), lines=False, as_file=True)
    assert same(formats.read_json(spark, str(tmp_path / "array")), nation)
    formats.write_txt(nation.select("k", "n_name"), str(tmp_path / "txt"))
    assert formats.read_txt(spark, str(tmp_path / "txt")).count() == nation.count()


def test_nv2_nesting(spark, tmp_path):
    (tmp_path / "a.nv2").write_text("id:1\nsub:\n\tx:1\n\ty:a#\n#\nid:2\nid:3\n#\n")
    got = formats.read_nv2(spark, str(tmp_path / "a.nv2"), schema="id array<string>, sub struct<x: string, y: string>")
    assert got.count() == 2
    assert formats.parse_nv2("id:1\nsub:\n\tx:1\n\ty:a#") == {"id": "1", "sub": {"x": "1", "y": "a#"}}
    with pytest.raises(ValueError):
        formats.parse_nv2("no colon")


def test_tsv_errors_and_header(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('a\tb c\n1\t"x\n2\n3\ty\n')
    with pytest.raises(Exception):
        formats.read_tsv(spark, str(tmp_path / "t.tsv")).collect()
    df = formats.read_tsv(spark, str(tmp_path / "t.tsv"), allow_errors=2)
    assert df.columns == ["a", "b_c"]
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, '"x'), (3, "y")]
    assert formats.read_tsv(spark, str(tmp_path / "t.tsv"), allow_errors=1).count() == 1


def test_wrapped_json(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"recs":[{"a":1},{"a":2}]}')
    assert formats.read_json(spark, str(tmp_path / "w.json")).count() == 2


def test_nvp(spark, tmp_path):
    (tmp_path / "x.nvp").write_text("id:1\nclause:bid:3|type:x\n---:\nid:2\n---:\n")
    got = formats.read_nvp(spark, str(tmp_path / "x.nvp"), schema="id string, clause array<struct<bid: string, type: string>>")
    assert [(r.id, r.clause and tuple(r.clause[0])) for r in got.orderBy("id").collect()] == [("1", ("3", "x")), ("2", None)]


def test_djf(spark, tmp_path):
    import zlib

    body = b""
    for key, rec in (("a|1", "id:1\nclause:bid:3\n"), ("b|", "id:2\n")):
        z = zlib.compress(rec.encode())
        body += len(key).to_bytes(4, "big") + key.encode() + len(z).to_bytes(4, "big") + z
    (tmp_path / "x.djf").write_bytes(body)
    got = formats.read_djf(spark, str(tmp_path / "x.djf"), keys=("k", "n"))
    assert sorted((r.k, r.n, r.id) for r in got.collect()) == [("a", "1", 1), ("b", "", 2)]


@pytest.mark.parametrize(("text", "kind"), [("1", "bigint"), ("1.0", "double"), ("1e3", "double"), ("1e999", "string"), ("TRUE", "boolean"), ("abc", "string"), ("99999999999999999999", "string")])
def test_types_of_values(text, kind):
    assert formats.type_of(text) == kind


def test_keyed_store(spark, nation):
    formats.map_db(nation, "k", "store_test", buckets=4, overwrite=True)
    keyed = formats.read_natdb(spark, "store_test", ["k"])
    assert join(nation.select("k"), keyed, "inner").count() == nation.count()
    formats.group_db(nation, "big", "groups_test", count="n", buckets=4, overwrite=True)
    assert spark.table("groups_test").agg({"n": "sum"}).first()[0] == nation.count()


def test_sinks(spark, nation, tmp_path, capsys):
    formats.devnull(nation)
    formats.print_rows(nation, 2)
    assert capsys.readouterr().out.count("#") == 2
    formats.chart(nation, str(tmp_path / "c.html"), "n_name", "k")
    assert "ALGERIA" in (tmp_path / "c.html").read_text() or "datasets" in (tmp_path / "c.html").read_text()
    formats.write_nat(nation, str(tmp_path / "o"))
    formats.write_report(nation, str(tmp_path / "o"), "demo")
    assert formats.origin(spark, str(tmp_path / "o"), flatten=True).count() == 4


def test_inline(spark):
    assert inline.blanks(spark, 3).count() == 3
    assert inline.empty(spark, "a long").count() == 0
    assert inline.inline(spark, [(1,)], "a long").first().a == 1
