"""Mixing, top-k search and the similarity join against their SQL, and on edge cases."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import components, jaccard, mixing, shingles, topk

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize(("run", "sql"), [(topk.op2_topk, topk.SQL), (jaccard.op9_jaccard_join, jaccard.SQL), (mixing.op10_mixing, mixing.SQL)])
def test_sql(run, sql, spark, sf, duck):
    df = run(spark, sf)
    cols = sorted(df.columns)
    r = duck.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert sorted(map(str, (tuple(x) for x in df.select(*cols).collect()))) == sorted(str(tuple(x[i] for i in at)) for x in r.fetchall())


def mixed_docs(spark):
    rows = [(i, "w " * (5 + i % 7), "en", "big", 0) for i in range(900)] + [(1000 + i, "w w w", "en", "small", 0) for i in range(30)]
    rows += [(2000, None, "en", "big", 0), (2001, "", None, None, None), (2002, "a b", "en", None, 0), (5, "w w", "en", "big", 0), (5, "w w", "en", "big", 0)]
    return spark.createDataFrame(rows, DOC)


def test_mixing_budget_and_limits(spark):
    docs = mixed_docs(spark)
    out = mixing.mix(docs, budget_tokens=4000, entropy_share=1.0, max_repeat=3.0)
    by = {r["source"]: (r["t"], r["e"]) for r in out.groupBy("source").agg(F.sum("tokens").alias("t"), F.max("epoch").alias("e")).collect()}
    assert by["small"][1] <= 3 and by[None][1] <= 3 and by["small"][0] <= 3 * 90
    cover = mixing.mix(docs, cover=True, max_repeat=2.0)
    seen = {r.doc_id for r in cover.collect()}
    assert seen >= {r.doc_id for r in docs.filter("source is not null or text <> ''").collect()}
    assert cover.agg(F.max("epoch")).first()[0] == 2


def test_mixing_exponent_meets_entropy(spark):
    s = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "m_source string, tokens long")
    target = 0.9 * math.log(3)
    a = mixing.exponent(s, 1110.0, target, None)
    w = np.array([1000, 100, 10.0]) ** a
    w /= w.sum()
    assert abs(-(w * np.log(w)).sum() - target) < 1e-4
    a = mixing.exponent(s, 1110.0, None, 4.0)
    w = np.array([1000, 100, 10.0]) ** a
    assert abs((w / w.sum() * 1110 / np.array([1000, 100, 10])).max() - 4) < 1e-3


def test_empty_and_extra_columns(spark):
    e = spark.createDataFrame([], DOC)
    assert mixing.mix(e).count() == 0
    assert jaccard.classes(e, k=3, num=90, den=100).count() == 0
    docs = mixed_docs(spark).withColumns({"block": F.lit(1), "epoch": F.lit("x"), "component": F.lit(0), "key": F.lit(2)})
    assert mixing.mix(docs).count() > 0
    assert jaccard.classes(docs, k=3, num=90, den=100).count() == docs.count()


def test_topk_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [0.1, None]), (4, [nan, 0.1]), (5, [inf, 0.0]), (6, [-0.5, 0.1]), (7, [0.3]), (50, [0.3, 0.1]), (50, [0.3, 0.1]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(9))
    got = [tuple(r) for r in topk.search(df, k=2).orderBy("query_id", "rank").collect()]
    fifty = [(50, 1, 0, 76 * 128 + 25 * 128)] * 2 + [(50, 2, 1, 76 * 128 + 25 * 128)] * 2  # two rows, each a query
    assert got == [(0, 1, 1, 2 * 128 * 128), (0, 2, 50, 128 * 76 + 128 * 25), *fifty]
    assert topk.search(df.limit(0)).count() == 0


def test_topk_repeats_overflow_and_bounds(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i % 90, [float(v) for v in rng.integers(-9, 9, 40) / 8]) for i in range(150)]
    rows += [rows[0], rows[0], rows[7], (50, [0.25] * 40), (7, [0.0] * 39 + [1e307])]
    full = [[math.floor(256 * v) if abs(v) < 1e300 else 256 * int(v) for v in x] for _, x in rows]
    want = []
    for r, (i, _) in enumerate(rows):
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(full[r], full[c], strict=True)), rows[c][0]) for c in range(len(rows)) if c != r)
            want += [(i, n + 1, v, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for n, (s, v) in enumerate(scored[:5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for size in (8192, 40):  # several blocks: the first bounds the others
        monkeypatch.setattr(topk, "CANDIDATES", size)
        assert sorted(map(tuple, topk.search(df).collect())) == sorted(want)
    assert topk.search(df.filter("vec_id < 7")).count() == 5 * sum(i % 50 == 0 for i, _ in rows if i < 7)


def test_topk_blocks_against_brute_force():
    rng = np.random.default_rng(0)
    x = rng.integers(-200, 200, (64, 3000)).astype(float)
    q = x[:, :20].T
    a, b, s = topk.block_top(q, x, np.arange(3000), np.ones(3000, np.int64), np.arange(20), 5)
    full = q @ x
    for i in range(20):
        full[i, i] = -1e18
        best = np.lexsort((np.arange(3000), -full[i]))[:5]
        assert b[a == i].tolist() == best.tolist() and s[a == i].tolist() == full[i, best].tolist()


def test_join_large_groups_and_rows_without_ids(spark, monkeypatch):
    """Blocks small enough that groups are taken apart by sketches, settled by hubs and compared across blocks."""
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 5000)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 800)
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(40)]
    bases = [[words[j] for j in rng.integers(0, 40, n)] for n in rng.choice([2, 5, 40, 150, 220, 300], 40)]
    rows = []
    for i in range(400):
        w = list(bases[rng.integers(len(bases))])
        for _ in range(int(rng.choice([0, 1, 2, 5, 9])) if len(w) > 30 else 0):
            w[rng.integers(len(w))] = words[rng.integers(40)]
        rows.append((i if i % 9 else None, " ".join(w)))
    rows += [(9000, None), (None, rows[0][1]), rows[2], rows[2]]
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), k=3, num=90, den=100).collect()
    sets = [shingle_set(t, 3) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component) for r in got))) == sorted(str((d, len(sets[i]), low.get(find(i)))) for i, (d, _) in enumerate(rows))


def shingle_set(text, k):
    w = (text or "").lower().split()
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_join_common_passage_ties_no_texts(spark):
    """A passage in 2,000 otherwise different documents: no links, and none lost between the few that are alike."""
    rng = np.random.default_rng(8)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"v{x}" for x in rng.integers(0, 1 << 40, 120)) + " " + passage) for i in range(2000)]
    rows += [(5000, rows[3][1] + " more"), (5001, passage)]
    got = {r.doc_id: r.component for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), k=5, num=80, den=100).collect()}
    assert got[5000] == 3 and got[5001] == 5001 and all(got[i] == i for i in range(2000))


def test_deduplicated_rows(spark):
    a = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    rows = [(1, a), (1, a), (1, "another text under the same id, quite unlike the first one"), (2, a), (None, a), (None, "without an id but with words in it"), (None, "without an id but with words in it"), (7, None), (7, ""), (8, "  ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_key", F.lit(1))
    got = jaccard.deduplicated(df, k=5, num=80, den=100)
    assert got.columns == df.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, [rows[0], rows[2], rows[5], *rows[7:]]))
    assert jaccard.deduplicated(df.limit(0), k=5, num=80, den=100).count() == 0


def near(rng, words, share):
    return " ".join(w if rng.random() > share else f"x{rng.integers(1 << 30)}" for w in words)


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_join_against_brute_force(spark, k, num):
    rng = np.random.default_rng(3)
    texts = []
    for g in range(12):
        words = [f"w{rng.integers(500)}" for _ in range(int(rng.choice([6, 40, 260])))]
        texts += [near(rng, words, s) for s in (0, 0, 0.004, 0.01, 0.02, 0.04)]
    texts += [None, "", "one", "ONE", "one two", " \t\n", "é ü ö", "É ü ö"]
    common = " ".join(f"c{i}" for i in range(60))
    texts += [common + " " + " ".join(f"z{rng.integers(1 << 30)}" for _ in range(int(rng.integers(5, 60)))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def tokens(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = [tokens(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.n_shingles, r.component) for r in jaccard.classes(docs, k=k, num=num, den=100).collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and all(got[i] == 100 for i in range(100, 160))


def test_components_of_few_edges_take_no_rounds(spark, monkeypatch):
    """Rounds of jobs with all their tasks took the driver's memory; few edges are joined in the driver, with the same result."""
    import numpy as np

    rng = np.random.default_rng(3)
    u, v = rng.integers(-500, 500, (2, 700))
    long_edges = spark.createDataFrame([(int(a), int(b)) for a, b in zip(u, v, strict=True)], "u long, v long")
    binary = long_edges.selectExpr("unhex(lpad(hex(u), 16, '0')) u", "unhex(lpad(hex(v), 16, '0')) v")
    for edges in (long_edges, binary, long_edges.limit(0)):
        got = {}
        for most in (components.GATHERED, 0):
            monkeypatch.setattr(components, "GATHERED", most)
            group = f"components-{id(edges)}-{most}"
            spark.sparkContext.setJobGroup(group, "")
            found = components.connected(edges)
            jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
            assert jobs < 12 or most == 0
            assert found.schema.simpleString() == f"struct<node:{edges.dtypes[0][1]},component:{edges.dtypes[0][1]}>"
            rows = [(r.node, r.component) for r in found.collect()]
            got[most == 0] = dict(rows)
            assert len(rows) == len(got[most == 0])
        monkeypatch.undo()
        assert got[True] == got[False]


def test_a_cut_gives_back_native_memory(spark, monkeypatch):
    """What the driver's JVM has freed outside its heap stayed with the process."""
    from weftline.llm import common

    done, trim = [], common.trim
    monkeypatch.setattr(common, "trim", lambda s: done.append(trim(s)))
    assert common.cut(spark.range(5)).count() == 5 and done == [True]


def test_lowest_of_long_chains():
    import numpy as np

    order = np.random.default_rng(1).permutation(20_000)
    assert (components.lowest(order[:-1], order[1:], 20_000) == 0).all() and (components.lowest(np.arange(1, 3000), np.arange(2999), 3001) == np.r_[np.zeros(3000), 3000]).all()


def test_hot_signatures_path(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 5)
    test_join_against_brute_force(spark, 3, 90)


def test_shingle_hashes_do_not_depend_on_the_slice():
    import pyarrow as pa

    a, _ = shingles.shingle_sets(pa.array(["q w e r t"]), 3)
    b, at = shingles.shingle_sets(pa.array(["zz yy", None, "Q w  e\tr T"]), 3)
    assert a.tolist() == b[at[2] : at[3]].tolist()


def test_ties_take_both_kinds_of_signatures_from_one_list(spark):
    # one signature that all sets share passes from one kind to the other: no list of one kind alone may grow by it
    sizes = [10, 12, 15, 40, 50, 90]
    sets = lambda hot: spark.createDataFrame([(i, n, [100 + i, *([] if hot else [7])], [7] if hot else []) for i, n in enumerate(sizes)], "key long, n long, cold array<long>, hot array<long>")
    for hot in (False, True):
        df = jaccard.ties(sets(hot), 80, 100)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        lists = [line for line in plan.split("\n") if "Generate " in line]
        assert lists and all("cold" in line and "hot" in line for line in lists)
        groups = {}
        for r in components.connected(df.filter("u <> v")).collect():
            groups.setdefault(r.component, set()).add(r.node)
        assert sorted(map(sorted, groups.values())) == [[0, 1, 2], [3, 4]]
