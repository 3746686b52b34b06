"""Exact removal of repeated substrings by sampled suffixes, sorted with common-prefix values.

Every `LENGTH`-byte string of a text is owned by one suffix inside it, the one whose first `GRAM`
bytes have the smallest hash (the leftmost of equal ones); equal strings have the same owner at the
same place. Consecutive strings of one owner form a segment, on average some 85 strings. So instead
of a suffix for each byte only one in about 85 is sorted (a full suffix array would need more than
the disk that a cluster grants here, see the README):

1. Segments are counted by content (two 64-bit hashes), with partial aggregation. Where a segment
   occurs twice or more, all of it is covered.
2. Of owners (by the hash of their `GRAM` bytes) with several different segments, each segment is
   brought in once with its bytes. An owner of more than `HOT` different segments is split: equal strings that begin
   at most `HALF` bytes before it agree in LENGTH - HALF bytes from it on, others in HALF + 1 bytes before it, so its
   segments go twice, to those that agree with them there. The owners are shuffled and sorted by Spark, which spills to disk
   like an external queue; a task reads one owner after the other as a stream. An owner's segments are sorted as
   suffixes from the owner on, and as reversed prefixes before it; neighbours carry the length of
   their common prefix. From the two orders the rank of the string that starts d bytes before the
   owner is induced for every d: equal rank pairs of (d bytes to the left, LENGTH - d to the right),
   read off the common-prefix values, are equal strings, and covered.
3. The covered ranges of each text are put together, and what is left is hashed.

A text is UTF-8 bytes (null: empty), strings never cross texts. Texts shorter than LENGTH keep all.
Equal rows (same id and text) are different texts to each other. Extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import common, shingles

U = np.uint64
LENGTH, GRAM, HALF, HOT = 200, 24, 88, 200
#: Which strings of an owner a row is compared for: all, those that begin up to HALF bytes before it, or the others.
WHOLE, RIGHT, LEFT = range(3)
_POSITION = U((1 << 34) - 1)
_BYTE = common.mix64(np.arange(1, 257, dtype=np.uint64) * U(0xD1342543DE82EF95))


def segments(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first string's start, number of strings, owner's start, owner's hash, content hash) of each
    segment of the texts in `data` cut at `at`; starts count within the row."""
    none = np.zeros(0, np.int64)
    span = LENGTH - GRAM + 1
    n = len(data) - GRAM + 1
    if n < span:
        return none, none, none, none, none, none
    power, inverse = shingles._powers(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[: len(data)])))
    gram = common.mix64((total[GRAM:] - total[:-GRAM]) * inverse[:n])
    ranked = (gram & ~_POSITION) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // span) * span, ~U(0))
    padded[:n] = ranked
    padded = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    p = np.arange(n - span + 1)
    owner = (np.minimum(behind[p], ahead[p + span - 1]) & _POSITION).astype(np.int64)
    row = np.searchsorted(at, p, "right") - 1
    real = p + LENGTH <= at[row + 1]
    p, owner, row = p[real], owner[real], row[real]
    if not len(p):
        return none, none, none, none, none, none
    new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (row[1:] != row[:-1]))))
    count = np.diff(np.concatenate((new, [len(p)])))
    first, own, row = p[new], owner[new], row[new]
    end = first + count - 1 + LENGTH
    content = common.mix64(common.mix64((total[end] - total[first]) * inverse[first]) + (own - first).astype(np.uint64) * U(0x9E3779B97F4A7C15) + count.astype(np.uint64))
    base = at[row]
    return row, first - base, count, own - base, gram[own].view(np.int64), content.view(np.int64)


def shared(segs: list[tuple[bytes, int, int]], least: int = 0, most: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For the different segments (bytes, owner's place, number of strings) of one owner: the runs
    [first, end) of their strings that another segment has as well, of strings that begin at least `least` and at
    most `most` bytes before the owner."""
    m = len(segs)
    if m < 2:
        return [[] for _ in segs]
    place = np.array([s[1] for s in segs])
    count = np.array([s[2] for s in segs])
    high, low = np.minimum(place, most), np.maximum(place - count + 1, least)  # strings start d bytes before the owner, low <= d <= high
    lefts, rights = [s[0][: s[1]][::-1] for s in segs], [s[0][s[1] :] for s in segs]
    covered = np.zeros((m, max(int(high.max()), 0) + 1), bool)
    if m <= 12:
        tables = [_padded(x) for x in (lefts, rights)]
        for i in range(m - 1):
            left, right = (_common(t[0][i], t[1][i], t[0][i + 1 :], t[1][i + 1 :]) for t in tables)
            for j, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True), i + 1):
                lo, hi = max(LENGTH - b, int(low[i]), int(low[j]), 0), min(a, int(high[i]), int(high[j]))
                if lo <= hi:
                    covered[i, lo : hi + 1] = covered[j, lo : hi + 1] = True
    else:
        orders, prefixes = [], []
        for x in (lefts, rights):
            order = np.array(sorted(range(m), key=x.__getitem__))
            table, size = _padded([x[i] for i in order])
            orders.append(order)
            prefixes.append(np.array([0, *(_common(table[i], size[i], table[i + 1 : i + 2], size[i + 1 : i + 2])[0] for i in range(m - 1))]))
        rank = np.zeros((2, m), np.int64)
        for d in range(covered.shape[1]):
            who = np.flatnonzero((low <= d) & (d <= high))
            for k, need in ((0, d), (1, LENGTH - d)):
                rank[k, orders[k]] = np.cumsum(prefixes[k] < need)
            pair = rank[0, who] * (m + 1) + rank[1, who]
            _, inverse, times = np.unique(pair, return_inverse=True, return_counts=True)
            covered[who[times[inverse] > 1], d] = True
    out = []
    for i in range(m):
        d = np.flatnonzero(covered[i])
        start = np.sort(place[i] - d)  # string number, in order of the text
        if not len(start):
            out.append([])
            continue
        cut = np.flatnonzero(np.diff(start) > 1)
        out.append(list(zip(start[np.concatenate(([0], cut + 1))].tolist(), (start[np.concatenate((cut, [len(start) - 1]))] + 1).tolist(), strict=True)))
    return out


def _padded(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(r) for r in rows])
    width = int(size.max(initial=0)) + 1
    return np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width), size


def _common(one: np.ndarray, size: int, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length of the common prefix of one row with each of `rows`."""
    differ = rows != one
    first = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return np.minimum(np.minimum(first, sizes), size)


def _number(x: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)


def covered_ranges(docs: DataFrame) -> DataFrame:
    """(row_key, ranges) for texts with covered bytes, from (row_key, text)."""

    def cut_up(part: pa.RecordBatch) -> pa.RecordBatch:
        row, first, count, own, gram, content = segments(*common.raw(part.column(1)))
        keys = part.column(0).take(pa.array(row, pa.int64()))
        return common.batch_of({"row_key": (keys, None), "first": (first, pa.int32()), "strings": (count, pa.int32()), "place": (own - first, pa.int32()), "gram": (gram, pa.int64()), "content": (content, pa.int64())})

    found = common.map_rows(docs, cut_up, "row_key binary, first int, strings int, place int, gram long, content long")
    where = F.struct("row_key", "first", "strings", "place")
    kinds = found.groupBy("gram", "content").agg(F.count(F.lit(1)).cast("int").alias("n"), F.min(where).alias("at"))
    kinds = kinds.withColumn("segments", F.count(F.lit(1)).over(Window.partitionBy("gram")))
    kinds = common.cut(kinds.filter("n > 1 or segments > 1"))
    again = kinds.filter("n > 1").select("gram", "content")
    whole = common.cut(found.join(again, ["gram", "content"], "left_semi").select("row_key", "first", (F.col("first") + F.col("strings") + LENGTH - 1).alias("end")))
    spots = kinds.filter("segments > 1").select("gram", "n", "at.*", (F.col("segments") > HOT).alias("hot")).groupBy(F.col("row_key").alias("k")).agg(F.collect_list(F.struct("gram", "n", "first", "strings", "place", "hot")).alias("spots"))
    spots = common.cut(spots)
    texts = docs.join(spots, F.col("row_key") == F.col("k"))

    def fetch(part: pa.RecordBatch) -> pa.RecordBatch:
        data, at = common.raw(part.column(1))
        names = ("gram", "half", "agree", "row_key", "first", "strings", "place", "n", "body")
        rows = []
        for i, (key, spots) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
            for s in spots:
                a = int(at[i]) + s["first"]
                body = data[a : a + s["strings"] + LENGTH - 1].tobytes()
                place = s["place"]
                rest = (key, s["first"], s["strings"], place, s["n"], body)
                if not s["hot"]:
                    rows.append((s["gram"], WHOLE, 0, *rest))
                    continue
                if place - s["strings"] < HALF:
                    rows.append((s["gram"], RIGHT, _number(body[place : place + LENGTH - HALF]), *rest))
                if place > HALF:
                    rows.append((s["gram"], LEFT, _number(body[place - HALF - 1 : place]), *rest))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return common.batch_of({n: ([r[k] for r in rows], kinds[k]) for k, n in enumerate(names)})

    bodies = common.map_rows(texts.select("row_key", "text", "spots"), fetch, "gram long, half int, agree long, row_key binary, first int, strings int, place int, n int, body binary")

    dealt = ("gram", "half", "agree")

    def induce(batches):
        """Owners come sorted; the last one of a batch may go on in the next."""
        held: list[dict] = []

        def flush(rows):
            different = {}
            for r in rows:  # equal rows of the table bring a segment more than once
                different.setdefault((r["body"], r["place"]), r)
            own = list(different.values())
            out = []
            least, most = {WHOLE: (0, LENGTH), RIGHT: (0, HALF), LEFT: (HALF + 1, LENGTH)}[own[0]["half"]] if own else (0, 0)
            for r, runs in zip(own, shared([(r["body"], r["place"], r["strings"]) for r in own], least, most), strict=True):
                if r["n"] == 1:
                    out += [(r["row_key"], r["first"] + a, r["first"] + b - 1 + LENGTH) for a, b in runs]
            return out

        def batch(out):
            return common.batch_of({"row_key": ([x[0] for x in out], pa.binary()), "first": ([x[1] for x in out], pa.int32()), "end": ([x[2] for x in out], pa.int32())})

        for b in batches:
            out = []
            for r in b.to_pylist():
                if held and any(held[0][k] != r[k] for k in dealt):
                    out += flush(held)
                    held = []
                held.append(r)
            yield batch(out)
        yield batch(flush(held))
        common.give_back()

    partial = common.cut(bodies.repartition(*dealt).sortWithinPartitions(*dealt).mapInArrow(induce, "row_key binary, first int, end int"))
    return common.cut(whole.union(partial).groupBy("row_key").agg(F.collect_list(F.struct("first", "end")).alias("ranges")))


def remove_repeats(docs: DataFrame, *, keep: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every text; kept: the remaining bytes, if asked for."""
    key = F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.coalesce(F.col(text_col), F.lit(""))).cast("binary")))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), key.alias("row_key"))
    ranges = covered_ranges(docs.select("row_key", "text"))
    ranges = ranges.withColumnRenamed("row_key", "k")
    joined = docs.join(ranges, F.col("row_key") == F.col("k"), "left").select("doc_id", "text", "ranges")

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        data, at = common.raw(part.column(1))
        rows = []
        for i, ranges in enumerate(part.column(2).to_pylist()):
            own = data[at[i] : at[i + 1]]
            kept, removed, spans, done = [], 0, 0, 0
            for a, b in sorted((r["first"], r["end"]) for r in ranges or ()):
                if a > done or spans == 0:
                    kept.append(own[done:a].tobytes())
                    spans += 1
                    removed -= max(a, done)
                    removed += b
                    done = b
                elif b > done:
                    removed += b - done
                    done = b
            kept.append(own[done:].tobytes())
            body = b"".join(kept)
            rows.append((len(own), removed, spans, hashlib.sha256(body).hexdigest(), body if keep else None))
        return common.batch_of({"doc_id": (part.column(0), None), **{n: ([r[k] for r in rows], pa.int64()) for k, n in enumerate(("n_bytes", "n_removed", "n_spans"))}, "kept_sha256": ([r[3] for r in rows], pa.string()), "kept": ([r[4] for r in rows], pa.binary())})

    return common.map_rows(joined, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents"), keep=False).drop("kept")
