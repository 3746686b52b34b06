"""Cases that once went wrong: readers of tsv, regular expressions, hashes, samples, statistics."""

import pytest
from weftline.operators import aggregate as A
from weftline.operators import order, shape, stats
from weftline.sources import formats


def test_tsv_headers_and_blank_lines(spark, tmp_path):
    for name, body in (("a", "id\tb c\n1\tx\n\n2\t\n"), ("b", "id\tb c\n3\tid\nid\tb c\n")):
        (tmp_path / f"{name}.tsv").write_text(body)
    rows = formats.read_tsv(spark, str(tmp_path)).collect()
    assert sorted((r["id"], r["b_c"]) for r in rows) == [("1", "x"), ("2", ""), ("3", "id"), ("id", "b c")]


def test_tsv_errors(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('id\tv\n1\t"\n2\n3\tz\n')
    with pytest.raises(Exception, match="bad record"):
        formats.read_tsv(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in formats.read_tsv(spark, str(tmp_path), allow_errors=2).orderBy("id").collect()] == [(1, '"'), (3, "z")]


def test_lines_missing_and_chosen(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n")
    (tmp_path / "b.txt").write_text("two\n")
    assert [r[0] for r in formats._lines(spark, str(tmp_path), valid_regex=r"b\.txt$").collect()] == ["two"]
    assert formats._lines(spark, str(tmp_path / "none"), allow_missing=True).count() == 0


def test_regex_with_look_behind_and_plain_groups(spark):
    df = spark.createDataFrame([("x1y(2", )], "s string")
    assert shape.regex(df, "s", r"^(?<=^)(x)(?<a>\d)[(y](?:\()(?<b>\d)").select("a", "b").first() == ("1", "2")
    assert [r["a"] for r in shape.regex(df, "s", r"(?<=x)(?<a>\d)").first()["child"]] == ["1"]


def test_hash_without_fields(spark):
    assert shape.hash_fields(spark.range(2), "h", "none").select("h").distinct().collect() == [(None,)]


def test_sample_and_tail(spark):
    df = spark.range(50)
    assert order.sample(df, 1.0).count() == 50 and order.sample(df, 0.0).count() == 0 and order.sample(df, 3).count() == 3
    assert {r.id for r in order.sample(df, 5, 3, by="id").collect()} == {r.id for r in order.sample(df.repartition(7), 5, 3, by="id").collect()}
    assert [r.id for r in order.tail(df, 3, "id").collect()] == [47, 48, 49]


def test_deviation_of_large_means_and_percentiles(spark):
    df = spark.createDataFrame([(10**9 + i,) for i in range(3)], "v long")
    assert abs(stats.stats_of(df, "v").first()["stdev"] - (2 / 3) ** 0.5) < 1e-9
    values = [i * i * i % 7919 for i in range(1, 3000)] + [10**12] * 5
    row = stats.stats_of(spark.createDataFrame([(v,) for v in values], "v long"), "v").first()
    ranked = sorted(values)
    assert all(row[k] == ranked[int(p * len(ranked))] for k, p in stats.PERCENTILES.items())


def test_sums_of_amounts_are_exact_in_any_order(spark):
    # 2.5 in amounts; added up as doubles it comes to 2.4999999999999996
    values = [0.7] * 3 + [0.4]
    df = spark.createDataFrame([(1, v) for v in values] + [(2, v) for v in (1e300, 0.25, -1e300)] + [(3, None), (4, float("inf")), (5, 1e-9), (5, 1e-9)], "k long, v double").coalesce(1)
    rows = {r.k: r for r in A.summarize(df, "k", total=A.sum_of("v")).collect()}
    assert rows[1].total == 2.5 and rows[2].total in (0.0, 0.25) and rows[3].total == 0.0 and rows[4].total == float("inf") and rows[5].total == 2e-9
    assert A.reduce_all(df.filter("k = 1"), n=A.sum_of("v", as_long=True)).first().n == 3
    assert A.reduce_all(df.filter("k = 9"), n=A.sum_of("v")).first().n == 0.0
