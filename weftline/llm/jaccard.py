"""Self-join of documents on the Jaccard similarity of their word shingles, by token-combination prefixes.

The tokens (shingles) of a document are ordered rare ones first, then frequent ones by frequency.
If two sets have similarity t or more, fewer than floor((1 - t) |x|) + 1 tokens of either miss in
the other. A prefix of the order thus has to share something with each partner: a rare token is a
signature by itself; of the frequent class only pairs of tokens of the same part are signatures (the
class is dealt into parts by hash, the more the larger the set, see `schemes`), so the prefix is extended
until its rare tokens, plus those of each part beyond the first, outnumber what may be missing. Sets of
fewer than `SMALL` tokens use single tokens for either class; sets near that size use both kinds, so
partners across it meet. A set too short to be extended enough does so too.

Equal sets are folded into one class before anything is joined. Classes that share a signature, and
whose sizes allow a link, are tied together without listing pairs (see `ties`). The components of the
ties are the candidate groups. Common phrases chain unlike sets into large ones, so a group too large for
one block is first taken apart by sketches (see `refined`): bitmaps of a 16th to a 32nd of a set's size that bound
the similarity from above, so no link is lost. What remains is compared exactly, in blocks of about
`BLOCK_TOKENS` tokens that hold sets of like size, returning a spanning forest of the links. Blocks are compared with
themselves and with a few hubs first; only sets outside the largest component of their group are then compared
with all others, and blocks whose sizes rule a link out never meet (see `dealt` and `within`).
Frequencies are counted over all documents (for a quarter of the tokens, by hash; these come first
in the order); tokens of at least `FREQUENT_LEAST` documents form the frequent class, the most
frequent `FREQUENT_TABLE` of them if there are more. Where that bound falls affects the work only,
never the result.

Nulls and texts without words have an empty set and link with nothing. Rows that share an id are
each a row of the result; rows without an id link like others, and a component's id is the smallest there is. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import common, components, shingles

U = np.uint64
SMALL, BLOCK_TOKENS, BLOCK_BYTES, HUBS = 200, 750_000, 1_000_000, 6
#: Up to so many members (of about 100 bytes) are sent to all tasks; beyond, texts are joined by a shuffle.
SENT = 300_000
HOT = 500
FREQUENT_LEAST, FREQUENT_TABLE, SHARD_DOCS, UNCOUNTED = 4, 1 << 20, 4000, 1 << 40


def missing(n: int, num: int, den: int) -> int:
    """How many tokens of a set of n may miss in a partner of similarity num / den or more."""
    return n - -(-n * num // den)


def links(inter: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    return (inter > 0) & (den * inter >= num * (a + b - inter))


class Frequent:
    """The frequent class: the most frequent of the counted tokens, by a 48-bit id.

    Only a quarter of all tokens, by hash, is counted; the others come after the counted ones in the
    order, as if they were frequent, so that prefixes consist of counted rare tokens while there are
    enough of them.
    """

    def __init__(self, ids: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(ids)
        self.ids, self.counts = ids[order], counts[order]

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each token is in the class, its count; tokens that are not counted have none)."""
        own = token_ids(x)
        count = np.full(len(x), UNCOUNTED, np.int64)
        count[counted(x)] = 0
        if len(self.ids):
            at = np.minimum(np.searchsorted(self.ids, own), len(self.ids) - 1)
            known = counted(x) & (self.ids[at] == own)
            count[known] = self.counts[at[known]]
        return count > 0, count


def counted(x: np.ndarray) -> np.ndarray:
    return (x >> U(3)) & U(3) == 0


def token_ids(x: np.ndarray) -> np.ndarray:
    return x >> U(16)


def frequent_tokens(docs: DataFrame, text_col: str, k: int) -> Frequent:
    """Counts of the counted tokens over all documents, the FREQUENT_TABLE greatest of at least
    FREQUENT_LEAST.

    A task folds equal tokens before it passes them on in arrays, one for each of `shards` ranges of
    ids, so that a token that is everywhere arrives once for each fold and not once a document.
    """
    shards = 1 << max(6, (docs.count() // SHARD_DOCS).bit_length())

    def run(batches):
        held: list[np.ndarray] = []
        seen: set[bytes] = set()

        def fold():
            t, n = np.unique(np.concatenate(held), return_counts=True)
            shard = (t & U(shards - 1)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            t, n, shard = t[order], n[order], shard[order]
            at = np.searchsorted(shard, np.arange(shards + 1))
            full = np.flatnonzero(at[1:] > at[:-1])
            pack = lambda x, j: x[at[j] : at[j + 1]].tobytes()
            high = (t >> U(16)).astype(np.uint32)  # the low 16 bits follow, and of them the shard is known
            low = (t & U(0xFFFF)).astype(np.uint16)
            few = np.minimum(n, 255).astype(np.uint8)
            return common.batch_of({"shard": (full, pa.int32()), "high": ([pack(high, j) for j in full], pa.binary()), "low": ([pack(low, j) for j in full], pa.binary()), "n": ([pack(few, j) for j in full], pa.binary())})

        for batch in batches:
            for part in common.slices(batch, text_col):
                values, at = shingles.shingle_sets(part.column(0), k)
                for i in range(part.num_rows):
                    x = values[at[i] : at[i + 1]]
                    key = shingles.set_key(x)[:8]
                    if len(x) and key not in seen:
                        if len(seen) < 200_000:
                            seen.add(key)
                        held.append(token_ids(x[counted(x)]))
                if sum(map(len, held)) > 500_000:
                    yield fold()
                    held.clear()
        if held:
            yield fold()

    def total(table: pa.Table) -> pa.Table:
        join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        t, inverse = np.unique(join("high", np.uint32).astype(np.uint64) << U(16) | join("low", np.uint16).astype(np.uint64), return_inverse=True)
        n = np.bincount(inverse, join("n", np.uint8)).astype(np.int64)
        often = n >= FREQUENT_LEAST
        return pa.table({"token": pa.array(t[often].astype(np.int64)), "n": pa.array(n[often])})

    arrays = docs.select(F.col(text_col)).mapInArrow(run, "shard int, high binary, low binary, n binary")
    found = arrays.groupBy("shard").applyInArrow(total, "token long, n long").orderBy(F.desc("n"), "token").limit(FREQUENT_TABLE).toArrow()
    return Frequent(found.column("token").to_numpy().astype(np.uint64), found.column("n").to_numpy().astype(np.int64))


def schemes(n: int, num: int, den: int) -> list[int]:
    """Into how many parts the frequent class is dealt for a set of n tokens: about one part for four
    tokens that may miss, by powers of two of n. A set whose partners may lie above the next power of two
    takes part in that scheme as well, so two partners share the scheme of the larger one."""
    own = n.bit_length() - 1
    bands = range(own, (n * den // num).bit_length())
    return sorted({1 << max(4, ((den - num << j) // (4 * den)).bit_length()) for j in bands})


def paired(often: np.ndarray, parts: int, need: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """(first and second tokens of the pairs within a part) of the shortest prefix of `often` in which the
    tokens beyond the first of each part number `need`; and whether there is such a prefix."""
    part = (often >> U(7)) % U(parts)
    by_part = np.argsort(part, kind="stable")
    first = np.ones(len(often), bool)
    first[by_part[1:]] = part[by_part[1:]] != part[by_part[:-1]]
    beyond = np.cumsum(~first)
    enough = len(often) > 0 and int(beyond[-1]) >= need
    if enough:
        often, part = (x[: int(np.searchsorted(beyond, need)) + 1] for x in (often, part))
    order = np.lexsort((often, part))
    often, part = often[order], part[order]
    one, two = [often[:0]], [often[:0]]
    for d in range(1, len(often)):
        same = part[:-d] == part[d:]
        if not same.any():
            break
        one.append(often[:-d][same])
        two.append(often[d:][same])
    return np.concatenate(one), np.concatenate(two), enough


def signatures(x: np.ndarray, heavy: Frequent, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of one sorted set, as distinct 64-bit hashes: (those that few sets can share,
    those whose tokens all are in at least HOT sets)."""
    n = len(x)
    slack = missing(n, num, den)
    frequent, count = heavy.of(x)
    rare, often = x[~frequent], x[frequent]
    by_count = np.lexsort((often, count[frequent]))
    often, often_count = often[by_count], count[frequent][by_count]
    singles = np.concatenate((rare, often))[: slack + 1]
    hot_tokens = np.sort(often[often_count >= HOT])  # those not counted may be hot
    cold, hot = [x[:0]], [x[:0]]

    def put(found: np.ndarray, warm: np.ndarray) -> None:
        cold.append(found[~warm])
        hot.append(found[warm])

    def is_hot(tokens: np.ndarray) -> np.ndarray:
        return np.isin(tokens, hot_tokens, assume_unique=False) if len(hot_tokens) else np.zeros(len(tokens), bool)

    if n < -(-SMALL * den // num):
        put(singles, is_hot(singles))
    if n >= SMALL * num // den:
        need = slack + 1 - len(rare)
        cold.append(rare[: slack + 1])
        if need > 0:
            for parts in schemes(n, num, den):
                one, two, enough = paired(often, parts, need)
                h = common.mix64(one * U(0x9E3779B97F4A7C15) + common.mix64(np.full(1, parts, np.uint64)))
                put(common.mix64(h * U(0x9E3779B97F4A7C15) + two), is_hot(one) & is_hot(two))
                if not enough:  # too short to be extended enough: single tokens as well
                    put(singles, is_hot(singles))
    return np.unique(np.concatenate(cold)), np.unique(np.concatenate(hot))


def sketch(x: np.ndarray) -> np.ndarray:
    """A bitmap over bins by the first bits of the tokens' hashes, 2 to 4 bins a token: whether a bin has an odd
    number of tokens."""
    bits = max(6, (2 * len(x) - 1).bit_length())
    return np.packbits((np.bincount((x >> U(64 - bits)).astype(np.int64), minlength=1 << bits) & 1).astype(np.uint8), bitorder="little")


def likely(sketches: list[np.ndarray], sizes: np.ndarray, left: int, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose sketches allow a link. Sets differ in at least as many tokens as their
    bitmaps do in bits, and linked ones in at most (1 - t) / (1 + t) of both sizes. If left is not 0, only pairs
    between the first `left` and the rest count."""
    m = len(sketches)
    order = np.argsort(sizes, kind="stable")
    sizes, first = sizes[order].astype(np.int64), order < left
    words = min(len(x) for x in sketches) // 8
    table = np.zeros((m, words), np.uint64)
    for row, i in enumerate(order):
        bits = np.unpackbits(sketches[i], bitorder="little").reshape(words * 64, -1)  # bins of a larger set are put together
        table[row] = np.packbits(np.bitwise_xor.reduce(bits, axis=1), bitorder="little").view(np.uint64)
    label = np.arange(m)
    ends = np.searchsorted(sizes * num, sizes * den, "right")
    edges = []
    for i in range(m - 1):
        near = i + 1 + np.flatnonzero(label[i + 1 : ends[i]] != label[i])
        if left:
            near = near[first[near] != first[i]]
        for to in dict.fromkeys((min(words, 16), words)):  # a part of the bitmap rules most out
            if len(near):
                differ = np.bitwise_count(table[near, :to] ^ table[i, :to]).sum(1, dtype=np.int64)
                near = near[differ * (den + num) <= (den - num) * (sizes[near] + sizes[i])]
        for j in near.tolist():
            if label[j] != label[i]:
                edges.append((int(order[i]), int(order[j])))
                label[label == label[j]] = label[i]
    return edges


def forest(sets: list[np.ndarray], left: int, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among `sets`: all of them if left is 0, else also between the
    first `left` and the rest (pairs within either side are then left to their own block)."""
    m = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    root = list(range(m))
    edges: list[tuple[int, int]] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            edges.append((i, j))

    flat = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(m, dtype=np.int32), sizes)
    token, flat_id = np.unique(flat, return_inverse=True)
    flat_id = flat_id.astype(np.int32)
    del flat
    df = np.bincount(flat_id, minlength=len(token))
    shared = df[flat_id] > 1
    # hubs first: one pass each over the tokens; most groups are stars around their first sets
    hubs = 0
    while hubs < 6 and m > 2:
        roots = np.array([find(i) for i in range(m)])
        groups = np.unique(roots)
        if len(groups) == 1:
            return edges
        hub = int(groups[hubs % len(groups)])
        mark = np.zeros(len(token), bool)
        mark[flat_id[owner == hub]] = True
        inter = np.bincount(owner[mark[flat_id]], minlength=m)
        hit = links(inter, sizes, sizes[hub], num, den)
        if left:
            hit &= (np.arange(m) < left) != (hub < left)
        hit[hub] = False
        for j in np.flatnonzero(hit):
            join(hub, int(j))
        hubs += 1
    # the rest: whatever is outside the largest component so far, against all, some rows at a time
    roots = np.array([find(i) for i in range(m)])
    largest = np.bincount(roots, minlength=m).argmax() if m else 0
    todo = np.flatnonzero(roots != largest)
    keep = np.flatnonzero(shared)
    order = keep[np.argsort(flat_id[keep], kind="stable")]
    rows, cols = owner[order], flat_id[order]
    start = np.searchsorted(cols, np.arange(len(token)))
    span = np.searchsorted(cols, np.arange(len(token)), "right") - start
    dense_id = np.cumsum(span > 0) - 1
    width = int((span > 0).sum())
    at = np.concatenate(([0], np.cumsum(sizes)))
    for c in range(0, len(todo), 256):
        chunk = todo[c : c + 256]
        own = np.concatenate([flat_id[at[i] : at[i + 1]] for i in chunk])
        line = np.repeat(np.arange(len(chunk)), sizes[chunk])
        line, own = line[span[own] > 0], own[span[own] > 0]
        total = int(span[own].sum())
        if total * 1.5e-8 <= len(chunk) * float(m) * width * 4e-11 + m * float(width) * 1e-10:
            inter = np.zeros(len(chunk) * m, np.int64)
            ends = np.cumsum(span[own])
            lo = 0
            while lo < len(own):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 1_000_000, "right")))
                n = span[own[lo:hi]]
                pick = np.repeat(start[own[lo:hi]] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                inter += np.bincount(np.repeat(line[lo:hi], n) * np.int64(m) + rows[pick], minlength=len(chunk) * m)
                lo = hi
            inter = inter.reshape(len(chunk), m)
        else:  # much is shared: products of 0/1 blocks
            inter = np.zeros((len(chunk), m), np.float32)
            for d in range(0, width, 2048):
                left_block, right_block = np.zeros((len(chunk), 2048), np.float32), np.zeros((m, 2048), np.float32)
                mine = (dense_id[own] >= d) & (dense_id[own] < d + 2048)
                left_block[line[mine], dense_id[own[mine]] - d] = 1
                lo, hi = np.searchsorted(dense_id[cols], (d, d + 2048))
                right_block[rows[lo:hi], dense_id[cols[lo:hi]] - d] = 1
                inter += left_block @ right_block.T
            inter = np.rint(inter).astype(np.int64)
        hit = links(inter, sizes[chunk][:, None], sizes[None, :], num, den)
        for i, j in zip(*np.nonzero(hit), strict=True):
            i, j = int(chunk[i]), int(j)
            if i != j and (not left or (i < left) != (j < left)):
                join(i, j)
    return edges


def classes(docs: DataFrame, *, k: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, text_key, n_shingles, class_key, component), where component is the
    smallest doc_id that links reach, itself included, class_key stands for the class that they reach (null without
    words; ids may repeat) and text_key for the text."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    heavy = frequent_tokens(docs, "text", k)

    def sign(part: pa.RecordBatch) -> pa.RecordBatch:
        values, at = shingles.shingle_sets(part.column(1), k)
        sets = [values[at[i] : at[i + 1]] for i in range(part.num_rows)]
        keys = [shingles.set_key(x) if len(x) else None for x in sets]
        signed = [signatures(x, heavy, num, den) if len(x) else (x, x) for x in sets]
        lists = []
        for side in (0, 1):
            cuts = np.concatenate(([0], np.cumsum([len(x[side]) for x in signed])))
            lists.append(common.list_rows(np.concatenate([x[side] for x in signed]).view(np.int64), cuts))
        bodies = [sketch(x).tobytes() if len(x) else None for x in sets]
        return common.batch_of({"doc_id": (part.column(0), None), "text_key": (part.column(2), None), "n_shingles": (np.diff(at), pa.int64()), "set_key": (keys, pa.binary()), "key": ([x and int.from_bytes(x[:8], "little", signed=True) for x in keys], pa.int64()), "sketch": (bodies, pa.binary()), "cold": (lists[0], None), "hot": (lists[1], None)})

    signed = common.cut(common.map_rows(docs, sign, "doc_id long, text_key long, n_shingles long, set_key binary, key long, sketch binary, cold array<long>, hot array<long>"))
    one_of = {c: F.first(c).alias(c) for c in ("sketch", "cold", "hot")}
    sets = signed.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.coalesce(F.min_by("text_key", "doc_id"), F.min("text_key")).alias("rep_text"), F.min("key").alias("key"), F.min("n_shingles").alias("n"), *one_of.values())
    sets = common.cut(sets)
    groups = components.connected(ties(sets, num, den))
    members = common.cut(sets.join(groups, F.col("key") == F.col("node")).select("set_key", "rep", "rep_text", "n", "sketch", F.col("component").alias("grp")))
    edges = verified(docs, refined(members, num, den), k, num, den)
    linked = components.connected(edges)
    reps = sets.select("set_key", "rep")
    lowest = linked.join(reps, F.col("node") == F.col("set_key")).groupBy(F.col("component").alias("c")).agg(F.min("rep").alias("lowest"))
    at = linked.join(lowest, F.col("component") == F.col("c")).select(F.col("node").alias("set_key"), "c", "lowest")
    at = reps.join(at, "set_key", "left").select(F.col("set_key").alias("k"), F.coalesce("c", "set_key").alias("class_key"), F.coalesce("lowest", "rep").alias("component"))
    return signed.select("doc_id", "text_key", "n_shingles", "set_key").join(at, F.col("set_key") == F.col("k"), "left").select("doc_id", "text_key", "n_shingles", "class_key", F.coalesce("component", "doc_id").alias("component"))


def deduplicated(docs: DataFrame, *, k: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` of which one of each component stays: the one of the smallest id (rows without an id come
    last), of the smallest text hash among those. Rows alike in id and text are one. Rows without words all stay."""
    own = "_text_key"
    found = common.cut(classes(docs, k=k, num=num, den=den, id_col=id_col, text_col=text_col))
    rows = found.filter("class_key is not null").groupBy(F.col("class_key").alias("grp"), "doc_id", "text_key").agg(F.count(F.lit(1)).alias("m"))
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")
    best = rows.groupBy(F.col("grp").alias("g")).agg(F.min(first).alias("best"))
    rows = common.cut(rows.join(best, F.col("grp") == F.col("g")).select("doc_id", "text_key", "m", (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))).alias("stays")))
    marked = docs.withColumn(own, F.xxhash64(text_col))
    same = lambda x: marked[id_col].cast("long").eqNullSafe(x["doc_id"]) & (marked[own] == x["text_key"])
    gone = rows.filter("not stays").select("doc_id", "text_key")
    out = marked.join(F.broadcast(gone) if gone.count() <= SENT else gone, same(gone), "left_anti")
    again = rows.filter("stays and m > 1").select("doc_id", "text_key")
    if again.take(1):
        out = out.join(again, same(again), "left_anti").union(out.join(again, same(again), "left_semi").dropDuplicates([id_col, own]))
    return out.select(docs.columns)


def ties(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs that share a signature and whose sizes
    allow a link, without the pairs. Keys are 64 bits of the set keys: should two coincide, their
    candidate groups are one, and no more.

    A signature that few sets share: its sets in order of size, each tied to the one before if the
    sizes allow it (if a pair's sizes do, so do those of all neighbours between). A hot one: sizes
    are cut into bands within which every pair may link; all sets of a band are tied to its
    smallest key, and bands to the next one if their nearest sizes allow it. Only minima are
    gathered there, and the join back can be split. As a table grows, signatures pass from the first kind to
    the second at `HOT` sets; both are taken from one list, which has a bounded number a set and grows with the sets.
    """
    may = lambda small, large: F.col(small) * den >= F.col(large) * num
    of_cold = F.size("cold").alias("of_cold")
    both = sets.select("key", "n", of_cold, F.posexplode(F.concat("cold", "hot")).alias("at", "sig"))
    cold = both.filter("at < of_cold").select("key", F.col("n").cast("int").alias("n"), "sig")
    by_size = Window.partitionBy("sig").orderBy("n", "key")
    chained = cold.select("key", "n", F.lag("key").over(by_size).alias("before"), F.lag("n").over(by_size).alias("size")).filter("before is not null").filter(may("size", "n")).select(F.col("key").alias("u"), F.col("before").alias("v"))
    band = F.floor(F.log(F.col("n")) / math.log(den / num) + 1e-9).cast("int")
    hot = both.filter("at >= of_cold").select("key", "n", "sig", band.alias("band"))
    hubs = hot.groupBy("sig", "band").agg(F.min("key").alias("hub"), F.min("n").alias("low"), F.max("n").alias("high"))
    by_band = Window.partitionBy("sig").orderBy("band")
    steps = hubs.select("hub", "low", F.lag("hub").over(by_band).alias("before"), F.lag("high").over(by_band).alias("size")).filter("before is not null").filter(may("size", "low")).select(F.col("hub").alias("u"), F.col("before").alias("v"))
    stars = hot.join(hubs, ["sig", "band"]).select(F.col("key").alias("u"), F.col("hub").alias("v"))
    return chained.union(steps).union(stars)


def dealt(members: DataFrame, weight: str, most: int, num: int, den: int) -> DataFrame:
    """`members` (grp, n, set_key, ...) with (block, pairs): the block of each set, and the pairs of blocks (a, b)
    in which it is to be compared. A group of weight `most` or less is one block. Of others, sets of like size
    share a band, within which all may link, and are dealt into blocks by their key; a block is compared with itself
    and with `HUBS` sets of its own and the next bands. With a column `settled`, only groups of more weight than
    `most` are dealt, and blocks meet those of their own and the next bands unless both are of settled sets."""
    # a little wider than the ratio, so that two partners are never two bands apart
    again = "settled" in members.columns
    band = 2 * F.floor(F.log("n") / (1.001 * math.log(den / num))).cast("long")
    members = members.withColumn("band", band + F.col("settled").cast("long") if again else band)
    hubs = [F.min_by("set_key", F.xxhash64("set_key", F.lit(i))).alias(f"hub{i}") for i in range(HUBS)]
    bands = members.groupBy("grp", "band").agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("m"), *hubs)
    of_band = F.struct("band", F.struct(F.ceil(F.col("w") / most).alias("blocks"), F.array(*[f"hub{i}" for i in range(HUBS)]).alias("hubs")))
    sizes = bands.groupBy("grp").agg(F.sum("w").alias("w"), F.sum("m").alias("m"), F.map_from_entries(F.collect_list(of_band)).alias("bands"))
    out = members.join(sizes.filter(F.col("w") > most if again else F.col("m") > 1), "grp")
    one = (F.col("w") <= most) & F.lit(not again)
    out = out.withColumn("block", F.when(one, F.lit(0).cast("long")).otherwise(F.shiftleft("band", 32) + F.pmod(F.hash("set_key"), F.col("bands")[F.col("band")]["blocks"])))
    near = "transform(filter(map_entries(bands), e -> {}), e -> transform(sequence(0L, e.value.blocks - 1), p -> shiftleft(e.key, 32) + p))"
    if again:
        others = F.expr(f"flatten({near.format('abs(shiftright(e.key, 1) - shiftright(band, 1)) <= 1 and (e.key & band & 1) = 0')})")
        pairs = F.transform(others, lambda x: F.struct(F.least("block", x).alias("a"), F.greatest("block", x).alias("b")))
    else:
        visited = F.when(F.array_contains(F.col("bands")[F.col("band")]["hubs"], F.col("set_key")), F.expr(f"flatten({near.format('abs(e.key - band) <= 2')})")).otherwise(F.array("block"))
        pairs = F.transform(F.when(one, F.array("block")).otherwise(visited), lambda x: F.struct(x.alias("a"), x.alias("b")))
    return out.withColumn("pairs", pairs).drop("band", "bands", "w", "m", "settled")


def within(members: DataFrame, weight: str, most: int, num: int, den: int, compared) -> DataFrame:
    """The edges (u, v) that `compared` finds between the sets of each group: first within blocks and with a few hubs,
    which settles copies of one text; then the sets outside the largest component of a large group, with all of it."""
    edges = common.cut(compared(dealt(members, weight, most, num, den)))
    large = members.groupBy("grp").agg(F.sum(weight).alias("w")).filter(F.col("w") > most).select("grp")
    if not large.take(1):
        return edges
    own = members.join(large, "grp")
    found = own.select("grp", "set_key").join(components.connected(edges), F.col("set_key") == F.col("node"))
    sizes = found.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("m"))
    largest = sizes.groupBy(F.col("grp").alias("g")).agg(F.max_by("component", F.struct("m", "component")).alias("c"))
    settled = common.cut(found.join(largest, (F.col("grp") == F.col("g")) & (F.col("component") == F.col("c"))).select(F.col("set_key").alias("k")))
    rest = own.join(settled, F.col("set_key") == F.col("k"), "left").withColumn("settled", F.col("k").isNotNull()).drop("k")
    return edges.union(compared(dealt(rest, weight, most, num, den)))


def refined(members: DataFrame, num: int, den: int) -> DataFrame:
    """`members` without their sketches, groups that are too large for one block taken apart: two sets stay together
    only if sketches allow a link between them, directly or over others."""
    sizes = members.groupBy("grp").agg(F.sum("n").alias("w")).select(F.col("grp").alias("g"), (F.col("w") > BLOCK_TOKENS).alias("large"))
    members = members.join(sizes, F.col("grp") == F.col("g")).drop("g")
    large = members.filter("large").select("grp", "n", "set_key", "sketch", F.length("sketch").alias("bytes"))

    def compare(table: pa.Table) -> pa.Table:
        keys, sides, sketches = (table.column(c).to_pylist() for c in ("set_key", "block", "sketch"))
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        order = sorted(range(len(keys)), key=lambda i: (sides[i], keys[i]))
        left = sum(x == a for x in sides) if a != b else 0
        edges = likely([np.frombuffer(sketches[i], np.uint8) for i in order], table.column("n").to_numpy()[order], left, num, den)
        return pa.table({"u": pa.array([keys[order[i]] for i, _ in edges], pa.binary()), "v": pa.array([keys[order[j]] for _, j in edges], pa.binary())})

    def compared(dealt_out: DataFrame) -> DataFrame:
        rows = dealt_out.select("grp", F.explode("pairs").alias("p"), "block", "n", "set_key", "sketch").select("grp", "p.a", "p.b", "block", "n", "set_key", "sketch")
        # dealt out by pair of blocks: as they come, all of a group would stay in one task
        return rows.repartition("grp", "a", "b").groupBy("grp", "a", "b").applyInArrow(common.freeing(compare), "u binary, v binary")

    found = components.connected(within(large, "bytes", BLOCK_BYTES, num, den, compared))
    found = found.select("node", F.xxhash64("component").alias("part"))
    out = members.join(found, F.col("set_key") == F.col("node"), "left")
    # a set of a large group without a likely partner is done with
    return common.cut(out.filter("not large or node is not null").select("set_key", "rep", "rep_text", "n", F.when(F.col("large"), F.col("part")).otherwise(F.col("grp")).alias("grp")))


def verified(docs: DataFrame, members: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The links (u, v) within candidate groups, a spanning forest of each pair of blocks."""
    few = members.count() <= SENT
    # rows without an id are told apart by their text, and equal ones of them folded
    named = docs.filter("doc_id is not null").select("doc_id", "text", "text_key")
    nameless = docs.filter("doc_id is null and text is not null").groupBy("text_key").agg(F.first("text").alias("text")).select(F.lit(None).cast("long").alias("doc_id"), "text", "text_key")

    def resolve(part: pa.RecordBatch) -> pa.RecordBatch:
        values, at = shingles.shingle_sets(part.column(0), k)
        wanted = part.column(1).to_pylist()
        good = [i for i in range(part.num_rows) if at[i + 1] > at[i] and shingles.set_key(values[at[i] : at[i + 1]]) == wanted[i]]
        out = part.take(pa.array(good, pa.int64()))
        body = pa.array([values[at[i] : at[i + 1]].tobytes() for i in good], pa.binary())
        return pa.RecordBatch.from_arrays([*[out.column(i) for i in range(1, 5)], body], names=["set_key", "grp", "block", "pairs", "body"])

    def compare(table: pa.Table) -> pa.Table:
        keys, sides = table.column("set_key").to_pylist(), table.column("block").to_pylist()
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        body, at = common.raw(table.column("body").combine_chunks())
        del table
        one = {k: i for i, k in enumerate(keys)}  # repeated rows of the table bring a set more than once
        order = sorted(one.values(), key=lambda i: (sides[i], keys[i]))
        left = sum(sides[i] == a for i in order) if a != b else 0
        edges = forest([body[at[i] : at[i + 1]].view(np.uint64) for i in order], left, num, den)
        return pa.table({"u": pa.array([keys[order[i]] for i, _ in edges], pa.binary()), "v": pa.array([keys[order[j]] for _, j in edges], pa.binary())})

    def compared(sets: DataFrame) -> DataFrame:
        where = lambda x: x["doc_id"].eqNullSafe(F.col("rep")) & (x["text_key"] == F.col("rep_text"))
        own = named.join(F.broadcast(sets) if few else sets, where(named))
        texts = own.union(nameless.join(sets.filter("rep is null"), where(nameless)).select(own.columns)).select("text", "set_key", "grp", "block", "pairs")
        bodies = common.map_rows(texts, resolve, "set_key binary, grp long, block long, pairs array<struct<a: bigint, b: bigint>>, body binary")
        rows = bodies.select("grp", F.explode("pairs").alias("p"), "block", "set_key", "body").select("grp", "p.a", "p.b", "block", "set_key", "body")
        return rows.groupBy("grp", "a", "b").applyInArrow(common.freeing(compare), "u binary, v binary")

    return within(members, "n", BLOCK_TOKENS, num, den, compared)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(common.table(spark, sf_dir, "documents"), k=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"))


SQL = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents
), g as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as g from w
), t as (
  select doc_id, len(g) as n, unnest(g) as t from g
), links as (
  select a.doc_id as u, b.doc_id as v from t a join t b on a.t = b.t and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach as (
  select doc_id as u, doc_id as v from g union select reach.u, links.v from reach join links on reach.v = links.u
)
select doc_id, len(g)::bigint as n_shingles, c.component_id from g join (select u, min(v) as component_id from reach group by u) c on c.u = doc_id
"""
