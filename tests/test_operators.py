"""Operators on tiny tables: nulls, multi-valued fields, empty tables."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import aggregate as A
from weftline.operators import filters, keyed, nested, order, shape, stats, text
from weftline.pipeline import Pipeline
from weftline.registry import OPERATORS, manual, operator


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def sparse(spark):
    return spark.createDataFrame([(1, None), (2, None), (None, "blue")], "id long, color string")


def test_conditions_and_nulls(sparse):
    assert rows(filters.accept_if(sparse, "id = 2")) == [(2, None)]
    assert len(rows(filters.reject_if(sparse, "id = 2"))) == 2
    assert filters.accept_if(sparse, "color").count() == 0
    out = filters.if_(sparse, "id = 2", Pipeline().add(foo="'bar'"))
    assert sorted(r.foo or "" for r in out.collect()) == ["", "", "bar"]
    out = filters.if_not(sparse, "id = 2", Pipeline().add(foo="'bar'"))
    assert sorted(r.foo or "" for r in out.collect()) == ["", "bar", "bar"]


def test_joins(spark):
    tx = spark.createDataFrame([(1, 0), (2, 1)], "id long, tx long")
    dim = keyed.map_by(spark.createDataFrame([(1, "red"), (3, "pink")], "id long, color string"), "id")
    assert rows(keyed.join(tx, dim, "left")) == [(1, 0, "red"), (2, 1, None)]
    assert rows(keyed.join(tx, dim, "outer")) == [(1, 0, "red"), (2, 1, None), (3, None, "pink")]
    assert rows(keyed.join(tx, dim, "right")) == [(1, 0, "red"), (3, None, "pink")]
    assert rows(keyed.join(tx, dim, "keyExists")) == [(1, 0, True), (2, 1, False)]
    with pytest.raises(ValueError):
        keyed.join(tx, dim, "+")
    with pytest.raises(ValueError):
        keyed.filter_by(tx, dim, "left")


def test_null_keys_are_equal(spark):
    a = spark.createDataFrame([(None, 1)], "id long, x long")
    b = keyed.map_by(spark.createDataFrame([(None, "n")], "id long, c string"), "id")
    assert rows(keyed.join(a, b, "inner")) == [(None, 1, "n")]


def test_collisions(spark):
    a = spark.createDataFrame([(1, "l")], "id long, c string")
    b = keyed.map_by(spark.createDataFrame([(1, "r")], "id long, c string"), "id")
    assert rows(keyed.join(a, b, "left")) == [(1, "l", "r")]
    assert rows(keyed.join(a, b, "left", "array")) == [(1, ["l", "r"])]
    assert rows(keyed.join(a, b, "left", "left")) == [(1, "l")]


def test_denorm_and_reducers(spark):
    ferry = spark.createDataFrame([("orca", [("honda", 15), ("toyota", 40)]), ("chelan", [])], "ferry string, car array<struct<make: string, weight: long>>")
    assert len(rows(shape.denorm(ferry, "car"))) == 2
    assert len(rows(shape.denorm(ferry, "car", keep_empty=True))) == 3
    out = nested.foreach(ferry, "car", s=A.sum_of("weight"), a=A.any_of(lambda x: x["weight"] > 20), b=A.all_of(lambda x: x["weight"] < 20), n=A.rec_count())
    assert {r.ferry: (r.s, r.a, r.b, r.n) for r in out.collect()} == {"orca": (55.0, True, False, 2), "chelan": (0.0, False, True, 0)}
    multi = spark.createDataFrame([("bar", [1, 2, 3])], "foo string, id array<long>")
    assert len(rows(shape.denorm(multi, "id"))) == 3
    assert nested.foreach(multi, "id", s=A.sum_of(1)).first().s == 3.0


def test_shape(spark):
    bins = spark.createDataFrame([(1324.0,), (23.0,), (-23.0,), (None,)], "num double")
    assert rows(shape.bin_value(bins, "num", 10)) == sorted([(1320,), (20,), (-20,), (None,)], key=str)
    one = spark.createDataFrame([("blue", (1, "big"))], "color string, sub struct<id: long, size: string>")
    assert rows(shape.flatten(one, "sub")) == [("blue", 1, "big")]
    many = spark.createDataFrame([(1, [(7,), (8,)])], "id long, sub array<struct<id: long, >>".replace(", >", ">"))
    assert rows(shape.flatten(many, "sub")) == [([1, 7, 8],)]
    packed = spark.createDataFrame([("0@@B0032,1:B0012,5:B0015,8@@5690",)], "text string")
    found = shape.regex(packed, "text", r"(?<id>B\d+),(?<score>\d)", {"score": "bigint"})
    assert [tuple(x) for x in found.first().child] == [("B0032", 1), ("B0012", 5), ("B0015", 8)]
    ref = spark.createDataFrame([("hello world", "sometext")], "sometext string, ref string")
    assert shape.mv_ref(ref, "ref", "title").first().title == "hello world"
    with pytest.raises(ValueError):
        shape.keep(ref, "-ref")


def test_text(spark):
    m = spark.createDataFrame([("a b c", "a b e z w", None), ("a b", "x a b e", "broad"), (None, "x", None)], "kw string, query string, kind string")
    assert [r.isMatch for r in text.txtmatch(m, "kw", "query").collect()] == [False, True, None]
    assert [r.isMatch for r in text.txtmatch(m, "kw", "query", "1,2,2,3").collect()] == [True, True, None]
    assert [r.matchedType for r in text.txtmatch(m, "kw", "query", add_type=True).collect()] == [None, "phrase", None]
    assert [r.isMatch for r in text.txtmatch(m, "kw", "query", "@kind").collect()][1] is True
    w = spark.createDataFrame([("colorless green ideas", "chomsky")], "title string, brand string")
    assert [x.text for x in text.txtsplit(w, "title,brand").first().term] == ["colorless", "green", "ideas", "chomsky"]
    assert text.txtcount(w, "n", "title").first().n == 3


def test_order(spark):
    df = spark.createDataFrame([("A", 1), ("X", 8), ("A", 2), ("A", 4), ("X", 10), ("X", 0), ("B", 0)], "c string, v long")
    out = [tuple(r) for r in order.sort(df, "+s.c,-l.v", "c", 2).collect()]
    assert out == [("A", 4), ("A", 2), ("B", 0), ("X", 10), ("X", 8)]
    with pytest.raises(ValueError):
        order.sort(df, "v", "c")


def test_percentile_rule(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 11)], "v long")
    r = stats.stats_of(df, "v").first()
    assert (r.p10, r.p50, r.p90, r.p99) == (2, 6, 10, 10)


def test_semi_and_anti_partition_the_input(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    k = keyed.map_by(orders.filter("o_totalprice > 100000").select("o_custkey"), "o_custkey")
    assert keyed.filter_by(orders, k, "+").count() + keyed.filter_by(orders, k, "-").count() == orders.count()


def test_empty_tables(spark):
    e = spark.createDataFrame([], "id long, c string")
    k = keyed.map_by(e, "id")
    assert keyed.join(e, k, "outer").count() == 0
    assert A.uniq(e, "id", count="n").count() == 0
    assert A.reduce_all(e, n=A.rec_count(), s=A.sum_of("id")).first() == (0, 0.0)


def test_pipeline_properties_and_registry(spark):
    p = Pipeline().acceptIf("id > ${least : 1}").add(x="'${word}'")
    df = spark.createDataFrame([(1,), (2,)], "id long")
    assert rows(p.bind(word="w").run(df)) == [(2, "w")]
    with pytest.raises(KeyError):
        p.bind()

    @operator("twice_test")
    def twice(df):
        """Doubles."""
        return order.fanout(df, 2)

    assert Pipeline().twice_test().run(df).count() == 4
    assert "Doubles" in manual("twice_test") and "acceptIf" in manual()
    del OPERATORS["twice_test"]


def test_observed(spark):
    df, seen = A.observed(spark.createDataFrame([(1,), (2,)], "v long"), "o", n=A.rec_count(), s=A.sum_of("v"))
    df.collect()
    assert seen.get == {"n": 2, "s": 3.0}


def test_foreach_pipe_with_join(spark):
    df = spark.createDataFrame([(1, [(5,), (6,)]), (2, [])], "id long, child array<struct<k: long>>")
    names = keyed.map_by(spark.createDataFrame([(5, "five")], "k long, name string"), "k")
    out = nested.foreach_pipe(df, "child", lambda r: keyed.join(r, names, "left"), ["id"])
    assert [[tuple(x) for x in r.child or []] for r in out.orderBy("id").collect()] == [[(5, "five"), (6, None)], []]


def test_stream(spark, sf, tmp_path):
    from weftline.streaming import stateless

    src = spark.read.parquet(f"{sf}/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    stream = stateless.read_stream(spark, str(tmp_path / "in"), src.schema)
    stateless.run_once(stream, Pipeline().acceptIf("value > 50").keep("event_id,value"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == src.filter("value > 50").count()
    assert stateless.windowed(src, "ts", "1 hour", [], n=F.count(F.lit(1))).agg(F.sum("n")).first()[0] == src.count()
