"""Toxicity by a support vector machine on a subsequence string kernel with Nystroem landmarks.

Kernel. A window of a sentence is a word with a sign for its start, described by its subsequences of three
characters, each weighing decay ** span, so that a gap or an inserted character weakens a match without breaking
it. Characters that stand in for letters (0 for o, $ for s) count as those; letters spelt out one by one
("i d i o t") count as a word as well. Words of more than `WIDE` characters are read through windows of that width,
`STRIDE` apart. The kernel is divided by the norm that a window of that length has if no subsequence repeats.

Training is multiple-instance: a toxic document has some toxic sentence, and that some toxic window; all windows
of clean documents' sentences are clean. Labelled documents (folds 0, 1 and 3 of crc32(doc_id as text) mod 4; a
sample of about `SAMPLE` documents of each label, drawn by hash) are split into sentences. The witnesses,
positive examples, are all windows of at least `LEAST` different contexts in toxic sentences of two texts or
more, if at least `LIFT` of their contexts would be toxic were both kinds of sentences as frequent, and if
that happens by chance (Chernoff's bound) with a probability of `CHANCE` at most; none of this depends on the size of
the tables, and there is no bound on their number. So are copies of them with one character inserted. Negative examples
are windows of clean sentences: the `NEGATIVES` most frequent, and in two more rounds the third as many of all
that the machine before valued highest and that don't lean to toxic sentences; windows in between are not
trained on. All witnesses weigh alike. Landmarks are witnesses, at most `LANDMARKS`, each the one worst covered by
those before it (pivoted Cholesky decomposition), and the most similar and most frequent negatives. A linear
machine on the Nystroem features is fitted to the squared hinge loss by dual coordinate descent. As it is linear in
the kernel, and the kernel in the subsequences, it is then folded into one weight a subsequence.

Scoring. A document's value adds up what its windows' values exceed `MARGIN` by, softly (an occurrence counts, at
most 8 of a word), and its score is a logistic curve of it that passes 0.3 where the training documents' F1 is best;
predicted follows from the score. A document without words, or null, scores 0; so does everything if nothing
can be learned. Ties and repeated rows score alike; extra columns are ignored; an empty table gives no rows. Labels,
language, source and id are no inputs of a score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import common

SAMPLE, DECAY, WIDE, STRIDE, THRESHOLD = 4000, 0.6, 14, 2, 0.3
LEAST, LIFT, CHANCE = 4, 0.9, 1e-3
COST, EPOCHS = 4.0, 12
#: A document's value adds up log(1 + exp(SHARP * (f - MARGIN))) / SHARP of its windows' values f.
MARGIN, SHARP = 0.5, 6.0
LANDMARKS, NEAR, FREQUENT, NEGATIVES = 96, 48, 32, 6000
BITS = 6
_STAND_IN = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_CODES = np.zeros(0x110000, np.uint8)
for _c in range(1, 0x110000):
    _CODES[_c] = 40 + _c % 24
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz"):
    _CODES[ord(_c)] = 1 + _i
for _c, _as in _STAND_IN.items():
    _CODES[ord(_c)] = _CODES[ord(_as)]
#: Stands before each word.
START = "\x02"
_CODES[ord(START)] = 39
_EDGE = ".,;:!?\"'()[]{}<>*#$%&|-_+=~/\\^`"
_SPELT = re.compile(r"(?<!\w)\w(?:[ ._*-]\w(?!\w)){2,}")
_SENTENCE = re.compile(r"(?<=[.!?\n])\s+")
_TRIPLES: dict[int, tuple[np.ndarray, np.ndarray, float]] = {}


def triples(n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(index triples, weights, norm) of a word of n characters."""
    if n not in _TRIPLES:
        at = np.array(list(combinations(range(n), 3)), np.int64).reshape(-1, 3)
        w = DECAY ** (at[:, 2] - at[:, 0] + 1.0)
        _TRIPLES[n] = at, w.astype(np.float32), float(np.sqrt((w * w).sum())) or 1.0
    return _TRIPLES[n]


def words_of(text: str) -> dict[str, int]:
    """The words of a text and how often they occur, lower-cased, without signs at their ends;
    spelt-out words as well."""
    text = text.lower()
    found: dict[str, int] = {}
    for w, n in Counter(text.split()).items():
        w = w.strip(_EDGE)
        if len(w) >= 3:
            found[w] = found.get(w, 0) + n
    for m in _SPELT.finditer(text):
        w = re.sub(r"[ ._*-]", "", m.group())
        found[w] = found.get(w, 0) + 1
    return found


def windows(word: str) -> list[str]:
    word = START + word
    return [word] if len(word) <= WIDE else [word[i : i + WIDE] for i in (*range(0, len(word) - WIDE, STRIDE), len(word) - WIDE)]


def codes_of(words: list[str]) -> np.ndarray:
    """Subsequence codes of words of one length, a row a word."""
    n = len(words[0])
    c = _CODES[np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32)].reshape(len(words), n).astype(np.int32)
    at = triples(n)[0]
    return c[:, at[:, 0]] << (2 * BITS) | c[:, at[:, 1]] << BITS | c[:, at[:, 2]]


def folded(words: list[str], weights: np.ndarray) -> np.ndarray:
    """For each word the greatest of its windows' kernel sums with a weight vector over subsequences."""
    out = np.full(len(words), -np.inf, np.float32)
    by_size: dict[int, tuple[list[str], list[int]]] = {}
    for i, w in enumerate(words):
        for x in windows(w):
            own = by_size.setdefault(len(x), ([], []))
            own[0].append(x)
            own[1].append(i)
    for n, (own, ids) in by_size.items():
        if n < 3:
            continue
        _, w, norm = triples(n)
        for c in range(0, len(own), 4096):
            np.maximum.at(out, ids[c : c + 4096], weights[codes_of(own[c : c + 4096])] @ w / np.float32(norm))
    return out


def spread(word: str) -> np.ndarray:
    """A word (its first window) as a vector over subsequences, divided by its norm."""
    x = windows(word)[0]
    _, w, norm = triples(len(x))
    v = np.zeros(1 << 3 * BITS, np.float32)
    np.add.at(v, codes_of([x])[0], w / norm)
    return v


def covering(words: list[str], most: int = LANDMARKS) -> list[str]:
    """At most `most` of the words, each the one that those before it leave most of."""
    first = [w[: WIDE - 1] for w in words]
    left = np.array([float((spread(w) ** 2).sum()) for w in first])
    found, columns = [], np.zeros((len(words), 0))
    while len(found) < min(most, len(words)):
        at = int(np.argmax(left))
        if left[at] < 1e-3:
            break
        column = (folded(first, spread(first[at])) - columns @ columns[at]) / np.sqrt(left[at])
        columns = np.column_stack((columns, column))
        left = left - column * column
        left[at] = 0.0
        found.append(words[at])
    return found


def variants(word: str, rng: np.random.Generator, n: int = 12) -> list[str]:
    out = []
    for _ in range(n):
        at = int(rng.integers(1, len(word)))
        out.append(word[:at] + "abcdefghijklmnopqrstuvwxyz*.-_"[int(rng.integers(30))] + word[at:])
    return out


class Machine:
    """f(word) = weights . subsequences + bias; score(f) by a logistic curve."""

    def __init__(self, weights: np.ndarray, bias: float, cut: float = 0.0, slope: float = 2.0) -> None:
        self.weights, self.bias, self.cut, self.slope = weights, bias, cut, slope

    def values(self, words: list[str]) -> np.ndarray:
        return folded(words, self.weights) + self.bias



def fit(positive: list[str], negative: list[str], near: list[str]) -> Machine:
    """The machine on Nystroem features of words. near: negatives that are landmarks besides the first ones, and
    weigh more."""
    rng = np.random.default_rng(7)
    landmarks = list(dict.fromkeys([*covering(positive), *near[:NEAR], *negative[:FREQUENT]]))
    first = [w[: WIDE - 1] for w in landmarks]
    gram = np.stack([folded(first, spread(w)) for w in landmarks])
    gram = (gram + gram.T) / 2
    values, vectors = np.linalg.eigh(gram.astype(float))
    keep = values > 1e-5 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    more = [v for w in positive for v in variants(w, rng)]
    words = [*positive, *more, *negative]
    y = np.array([1.0] * (len(positive) + len(more)) + [-1.0] * len(negative))
    hard = set(near)
    weight = np.concatenate((np.ones(len(positive)), np.ones(len(more)), [8.0 if w in hard else 1.0 for w in negative]))
    for side in (y > 0, y < 0):
        weight[side] *= COST * len(y) / 2 / max(weight[side].sum(), 1e-9)
    x = np.stack([folded(words, spread(w)) for w in landmarks], axis=1).astype(float) @ root  # a landmark's vector at a time
    # dual coordinate descent for the squared hinge loss; the last feature is the bias
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    slack = 1 / (2 * weight)
    w, dual, square = np.zeros(x.shape[1]), np.zeros(len(y)), (x * x).sum(1) + slack
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            g = y[i] * (w @ x[i]) - 1 + slack[i] * dual[i]
            new = max(dual[i] - g / square[i], 0.0)
            if new != dual[i]:
                w += (new - dual[i]) * y[i] * x[i]
                dual[i] = new
    w, b = w[:-1], w[-1]
    weights = np.zeros(1 << 3 * BITS)
    for c, landmark in zip(root @ w, landmarks, strict=True):
        weights += c * spread(landmark)
    del x
    common.give_back()
    return Machine(weights.astype(np.float32), float(b))


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Machine | None:
    """The machine learned from (doc_id, text) and (doc_id, toxic); None if nothing can be learned."""
    labels = labels.select(F.col("doc_id").alias("i"), F.col("toxic").cast("int").alias("y")).filter(F.col("y").isNotNull() & ~common.held_out("i")).distinct()
    sizes = {r["y"]: r["count"] for r in labels.groupBy("y").count().collect()}  # a row a label
    if not sizes.get(1) or not sizes.get(0):
        return None
    rate = F.when(F.col("y") == 1, sample / sizes[1]).otherwise(sample / sizes[0])
    drawn = labels.filter(F.pmod(F.xxhash64("i"), F.lit(1 << 30)) < rate * (1 << 30)).orderBy(F.xxhash64("i"), "i", "y").limit(4 * sample)
    chosen = common.cut(docs.join(F.broadcast(drawn), F.col("doc_id") == F.col("i")).select("doc_id", "text", "y"))  # ids of the sample only

    def contexts(part: pa.RecordBatch) -> pa.RecordBatch:
        seen: dict[tuple[str, str, int], set[int]] = {}
        for text, y in zip(common.texts(part.column(1)), part.column(2).to_pylist(), strict=True):
            for sentence in _SENTENCE.split(text):
                before = ""
                for w in sentence.lower().split():
                    w = w.strip(_EDGE)
                    if len(w) >= 3:
                        seen.setdefault((w, before, y), set()).add(zlib.crc32(text.encode("utf-8", "replace")))
                    before = w
        return common.batch_of({"word": ([x[0] for x in seen], pa.string()), "before": ([x[1] for x in seen], pa.string()), "y": ([x[2] for x in seen], pa.int32()), "low": ([min(x) for x in seen.values()], pa.int64()), "high": ([max(x) for x in seen.values()], pa.int64())})

    found = common.map_rows(chosen, contexts, "word string, before string, y int, low long, high long").groupBy("word", "before", "y").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    toxic = F.col("y") == 1
    table = found.groupBy("word").agg(F.sum(F.when(toxic, 1).otherwise(0)).alias("bad"), F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).alias("good"), F.coalesce(F.min(F.when(toxic, F.col("low"))) < F.max(F.when(toxic, F.col("high"))), F.lit(False)).alias("several"))
    table = common.cut(table.filter("bad + good >= 2"))
    total = table.agg(F.sum("bad"), F.sum("good")).first()
    share = (total[0] or 0) / max((total[0] or 0) + (total[1] or 0), 1)
    # toxic contexts that outnumber the clean ones by far, where both kinds' sizes are accounted for
    lift = F.col("bad") / (F.col("bad") + F.col("good") * share / max(1 - share, 1e-6))
    part = lambda n, p: F.when(n > 0, n * F.log(n / ((F.col("bad") + F.col("good")) * F.lit(max(p, 1e-9))))).otherwise(0.0)
    by_chance = F.exp(-part(F.col("bad"), share) - part(F.col("good"), 1 - share))
    witnesses = table.filter((F.col("bad") >= LEAST) & F.col("several") & (lift >= LIFT) & (by_chance <= CHANCE))
    positive = [r["word"] for r in witnesses.orderBy(F.desc("bad"), "word").collect()]  # of a bounded sample
    if not positive:
        return None
    clean = table.filter((lift <= 0.8) & (F.col("good") > 0))
    negative = [r["word"] for r in clean.orderBy(F.desc("good"), "word").limit(NEGATIVES).collect()]
    known = set(positive)
    machine = fit(positive, negative, negative[FREQUENT:])
    for _ in range(2):  # negatives that look most like positives
        near = hardest(chosen.filter("y = 0"), machine, NEGATIVES // 3)
        leaning = {r["word"] for r in table.filter((lift > 0.8) & F.col("word").isin(near)).select("word").collect()}
        near = [w for w in near if w not in known and w not in leaning]
        machine = fit(positive, list(dict.fromkeys([*negative, *near])), near)
    rows = documents(chosen, machine).select("f", "y").orderBy("f", "y").toArrow()  # the sample
    f, y = rows.column("f").to_numpy().astype(float), rows.column("y").to_numpy()
    order = np.argsort(-f, kind="stable")
    f, y = f[order], y[order]
    hits = np.cumsum(y)
    # documents of either label count as often as they occur, not as they were drawn
    w = np.where(y == 1, max(1.0, sizes[1] / sample), max(1.0, sizes[0] / sample))
    drawn = np.cumsum(w)
    f1 = 2 * hits * w[y == 1].max(initial=1) / (drawn + sizes[1])
    at = int(np.argmax(f1))
    low = f[at + 1] if at + 1 < len(f) and np.isfinite(f[at + 1]) else f[at] - 0.2
    machine.cut = float((f[at] + low) / 2)
    return machine


def hardest(docs: DataFrame, machine: Machine, most: int) -> list[str]:
    """The words of `docs` that the machine values highest."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        words = sorted(set().union(*map(words_of, common.texts(part.column(1)))))
        f = machine.values(words)
        top = np.argsort(-f, kind="stable")[:most]
        return common.batch_of({"word": ([words[i] for i in top], pa.string()), "f": (f[top].astype(float), pa.float64())})

    rows = common.map_rows(docs, run, "word string, f double").groupBy("word").agg(F.max("f").alias("f")).orderBy(F.desc("f"), "word").limit(most).collect()
    return [r["word"] for r in rows]


def value_of(values: list[float], counts: list[int]) -> float:
    """A document's value from those of its words and how often they occur; -infinity without words."""
    v = np.array(values, float)
    some = np.isfinite(v)
    if not some.any():
        return -np.inf
    return float((np.minimum(counts, 8)[some] * np.logaddexp(0.0, SHARP * (v[some] - MARGIN))).sum() / SHARP)


def documents(docs: DataFrame, machine: Machine) -> DataFrame:
    """`docs` (with a text column) with the value f of each; -infinity without words."""
    cache: dict[str, float] = {}
    names = docs.columns

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        own = [words_of(t) for t in common.texts(part.column(names.index("text")))]
        fresh = sorted(set().union(*own) - cache.keys()) if own else []
        if len(cache) > 500_000:
            cache.clear()
            fresh = sorted(set().union(*own))
        cache.update(zip(fresh, machine.values(fresh).tolist(), strict=True))
        f = [value_of([cache[w] for w in words], list(words.values())) for words in own]
        keep = [n for n in names if n != "text"]
        return pa.RecordBatch.from_arrays([*[part.column(names.index(n)) for n in keep], pa.array(f, pa.float64())], names=[*keep, "f"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes if n != "text")
    return common.map_rows(docs, run, f"{kinds}, f double")


def score_docs(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    machine = train(docs, labels)
    out = docs.select("doc_id", common.held_out("doc_id").alias("held_out"), "text")
    if machine is None:
        return out.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    z = F.lit(machine.slope) * (F.col("f") - F.lit(machine.cut)) + F.lit(float(np.log(THRESHOLD / (1 - THRESHOLD))))
    score = F.when(F.col("f") == F.lit(float("-inf")), 0.0).otherwise(1 / (1 + F.exp(-z)))
    scored = documents(out, machine).select("doc_id", "held_out", score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_docs(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
