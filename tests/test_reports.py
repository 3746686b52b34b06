"""Properties, results amid a pipeline, reports, formats by name, errors in files, calls to a service."""

import http.server
import threading
import zlib

import pytest
from pyspark.sql import functions as F

from weftline.operators import aggregate as A
from weftline.operators import nested, shape
from weftline.pipeline import Pipeline, resolve
from weftline.report import Report
from weftline.sources import formats


def test_properties():
    given = {"a.b": "x", "c-d": 2, "car": "honda"}
    assert resolve("${a.b} ${ c-d } ${none : @a.b} ${none : y z}", given) == "x 2 x y z"
    choice = "${car ? ford:green honda:blue DEFAULT:pink}"
    assert [resolve(choice, {"car": c}) for c in ("ford", "honda", "fiat")] == ["green", "blue", "pink"]
    assert resolve(choice, {}) == "pink" and resolve("${car ? honda:@a.b DEFAULT:q}", given) == "x"
    assert resolve("${none : ${also : ${a.b}}}", given) == "x"
    for bad, props in (("${none}", {}), ("${car ? ford:green}", given), ("${none : @other}", {})):
        with pytest.raises(KeyError):
            resolve(bad, props)
    with pytest.raises(ValueError):
        resolve("${a}", {"a": "${a}"})
    assert Pipeline().acceptIf("v > ${least : 3}").bind(least=7).steps[0][1] == ("v > 7",)


def test_reductions_and_path(spark, tmp_path):
    seen = A.Reductions()
    df = Pipeline().observe("all", seen, n=A.rec_count(), s=A.sum_of("v")).acceptIf("v > 1").observe("some", seen, n=A.rec_count()).run(spark.createDataFrame([(1,), (2,), (3,)], "v long"))
    formats.write(df, str(tmp_path / "o.tsv"), pri=("where", seen))
    assert {r.instance: (r.n, r.s) for r in seen.rows(spark, "some,all").collect()} == {"all": (3, 6.0), "some": (2, None)}
    assert seen.rows(spark, pipe=lambda d: d.filter("path is not null")).first().path.endswith(str(tmp_path / "o.tsv"))
    assert A.Reductions().rows(spark).count() == 0
    with pytest.raises(ValueError):
        A.observe(df, "all", seen, n=A.rec_count())


def test_report(spark):
    spark.range(3).count()
    with Report(spark) as seen:
        formats.devnull(spark.range(10).filter("id > 3"))
    counts = seen.rows().filter("operator like '%Filter%' and rows is not null").select("rows", "value").collect()
    assert [tuple(r) for r in counts] == [(6, "6")] and seen.rows().select("execution").distinct().count() == 1


def test_origin_of_written_rows(spark, tmp_path):
    for end in ("nv2", "tsv", "json", "txt", "nat"):
        path = str(tmp_path / f"x.{end}")
        formats.write(spark.range(7).filter("id > 1"), path, report="rows above 1")
        row = formats.origin(spark, path).first()
        assert (row.records, row.expression, row.names) == (5, "rows above 1", ["id"])
        assert formats.read(spark, path).count() == 5
    formats.write(spark.range(0), str(tmp_path / "none.nat"), report="")
    assert formats.origin(spark, str(tmp_path / "none.nat")).first().records == 0


def test_formats_by_name(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    for end in ("nv2", "tsv", "json", "parquet"):
        formats.write(df, str(tmp_path / f"x.{end}"))
        assert sorted((r.k, r.v) for r in formats.read(spark, str(tmp_path / f"x.{end}")).collect()) == [(1, "a"), (2, "b")], end
    formats.write(df, str(tmp_path / "plain"), format="nv2")
    assert formats.read(spark, str(tmp_path / "plain"), format="nv2").count() == 2
    formats.write(df, str(tmp_path / "folder"), format="nat")
    assert formats.read(spark, str(tmp_path / "folder")).count() == 2
    (tmp_path / "array.json").write_text('[{"k":1},\n{"k":2}]')
    (tmp_path / "wrapped.json").write_text('{"r":[{"k":1},{"k":2}]}\n')
    assert [formats.read(spark, str(tmp_path / f"{n}.json")).count() for n in ("array", "wrapped")] == [2, 2]
    assert formats.read(spark, str(tmp_path / "none"), allow_missing=True).count() == 0
    for end in ("nv2", "tsv", "json", "txt"):
        assert formats.read(spark, str(tmp_path / f"none.{end}"), allow_missing=True).count() == 0
    assert formats.read_tsv(spark, str(tmp_path / "x.tsv"), valid_regex=r"part-.*gz$").count() == 2
    with pytest.raises(ValueError):
        formats.write(df, str(tmp_path / "x.what"))


@pytest.mark.parametrize(("allowed", "kept"), [(1, [1]), (2, [1, 2]), (3, [1, 2, 3, 9])])
def test_errors_in_files(spark, tmp_path, allowed, kept):
    """Two bad records in a file, none in another: the Nth ends its file only."""
    bodies = {"nv2": ("id:1\n#\nbad\n#\nid:2\n#\nbad\n#\nid:3\n#\n", "id:9\n#\n"), "json": ('{"id":1}\n{"id\n{"id":2}\n]\n{"id":3}\n', '{"id":9}\n')}
    for kind, (a, b) in bodies.items():
        folder = tmp_path / kind
        folder.mkdir()
        (folder / f"a.{kind}").write_text(a)
        (folder / f"b.{kind}").write_text(b)
        with pytest.raises(Exception):
            formats.read(spark, str(folder)).collect()
        assert sorted(int(r.id) for r in formats.read(spark, str(folder), allow_errors=allowed).collect()) == sorted({*kept, 9}), kind

    def record(text: str) -> bytes:
        z = zlib.compress(text.encode())
        return len(z).to_bytes(4, "big") + z

    (tmp_path / "x.djf").write_bytes(record("id:1\n") + b"\x00\x00\x00\x02zz" + record("id:2\n") + b"\x00\x00\x00\x01z" + record("id:3\n"))
    with pytest.raises(Exception):
        formats.read(spark, str(tmp_path / "x.djf"), schema="id string").collect()
    got = formats.read(spark, str(tmp_path / "x.djf"), schema="id string", allow_errors=allowed)
    assert sorted(int(r.id) for r in got.collect()) == [k for k in kept if k != 9]


def test_json_types_at_depth(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a":"12","m":[["1"],["x"]],"s":{"d":"1.5","e":["true","false"]},"r":[{"n":"3","t":"z"},{"n":"4"}]},{"a":"7","s":null}]')
    df = formats.read_json(spark, str(tmp_path / "a.json"), retype=True)
    assert dict(df.dtypes) == {"a": "bigint", "m": "array<string>", "s": "struct<d:double,e:array<boolean>>", "r": "array<struct<n:bigint,t:string>>"}
    row = df.filter("a = 12").first()
    assert row.m == ["1", "x"] and tuple(row.s) == (1.5, [True, False]) and [tuple(x) for x in row.r] == [(3, "z"), (4, None)]
    assert df.filter("a = 7 and s is null and r is null and m is null").count() == 1


def test_children_of_children(spark):
    df = spark.createDataFrame([(1, [(1, [(2,), (5,)]), (2, [])]), (2, None)], "id int, c array<struct<k: int, g: array<struct<v: int>>>>")
    total = lambda x: F.aggregate(F.filter(x["g"], lambda g: g["v"] > 1), F.lit(0), lambda a, g: a + g["v"])
    got = nested.foreach(df, "c", set_fields={"s": total}, where=lambda x: x["k"] > 0, t=A.sum_of("s"), n=A.rec_count()).orderBy("id").collect()
    assert [(r.t, r.n) for r in got] == [(7.0, 2), (0.0, 0)]


@pytest.mark.parametrize("nv2", [False, True])
def test_rest(spark, nv2):
    class Echo(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Echo)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        df = spark.createDataFrame([(str(i), None if i == 3 else "v") for i in range(7)], "k string, v string")
        got = shape.rest(df, f"http://127.0.0.1:{server.server_port}/", "k string, v string", batch_size=2, nv2=nv2)
        assert sorted((r.k, r.v) for r in got.collect()) == sorted((str(i), None if i == 3 else "v") for i in range(7))
    finally:
        server.shutdown()
