"""Quality classifier: a weak-label model over heuristic labellers, distilled into a hashed linear scorer.

1. Labellers. Each looks at one property of a text and votes bad (0), abstains (2) or, one of them,
   votes good (1). Texts of fewer than five words get no vote.
2. Label model. The votes of all documents are counted by vote pattern (at most 3 ** labellers
   rows, aggregated by Spark). Expectation-maximisation on the counts estimates the prior and, for
   each labeller, how often it votes good, bad or nothing on good and on bad documents; from these
   follows each pattern's posterior. That a labeller votes bad on at most `FALSE_ALARM` of the good
   documents is given. Without any vote the posterior is the prior.
3. Scorer. A logistic regression on hashed byte trigrams (shares of `BUCKETS` buckets) is fitted to
   the posteriors of all documents. The N documents of a vote pattern weigh sqrt(N min(N, `PER_PATTERN`))
   together, so that a common pattern does not drown the others, and the classes alike. The features of every
   document are written once, as their non-empty buckets and one byte each; each of `PASSES` evaluations
   reads them and adds up whole numbers, so that the fit does not depend on the order of rows. It then
   scores every whole text.

A document is rejected if the scorer gives it less than `threshold`. Null and empty texts have no
trigram: labellers abstain, the score is the posterior of that pattern, and they are kept only if
it reaches the threshold. Ties and repeated rows score alike. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import common

BUCKETS, PER_PATTERN, PASSES = 1 << 12, 400, 20
GOOD, BAD, NONE = 1, 0, 2
NEVER = (1.0, 0.0)
#: Trigrams added to the count of a text, of no bucket: a short text says little.
DAMP = 300
#: A labeller votes bad on at most this share of good documents: what makes it usable as one.
FALSE_ALARM = 0.0002
#: A byte c of a feature stands for c * c / LEVELS. Sums are of multiples of 1 / FIXED of it, those without a feature of 1 / FINE.
LEVELS, FIXED, FINE, RIDGE = 255 * 255, 1 << 22, 1 << 30, 1e-6

# classes of bytes; the continuation bytes of UTF-8 count as nothing, its lead bytes as a letter
_LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _ODD, _BANG, _PIPE = range(1, 9)
_CLASS = np.zeros(256, np.uint8)
_CLASS[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = _LOWER
_CLASS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = _UPPER
_CLASS[192:] = _LOWER
_CLASS[[ord(c) for c in "0123456789"]] = _DIGIT
_CLASS[[ord(c) for c in " \t\n\r\x0b\x0c"]] = _SPACE
_CLASS[[ord(c) for c in ".,;:"]] = _STOP
_CLASS[[ord(c) for c in "#$%&*<>{}[]\\^~=_@+/"]] = _ODD
_CLASS[ord("!")] = _BANG
_CLASS[ord("|")] = _PIPE

LABELLERS = ("symbols", "shouting", "tables", "exclamations", "repetition", "word_length", "short_words", "punctuation")


def _vote(value: np.ndarray, good: tuple[float, float], bad: tuple[float, float]) -> np.ndarray:
    """Good within the first closed interval, bad within the second, else abstain."""
    return np.where((value >= good[0]) & (value <= good[1]), GOOD, np.where((value >= bad[0]) & (value <= bad[1]), BAD, NONE))


def votes(column: pa.Array) -> np.ndarray:
    """One row of votes per text, in the order of LABELLERS."""
    data, at = common.raw(column)
    rows = len(at) - 1
    kind = _CLASS[data]
    share = {}
    for c in (_LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _ODD, _BANG, _PIPE):
        total = np.concatenate(([0], np.cumsum(kind == c)))
        share[c] = (total[at[1:]] - total[at[:-1]]).astype(float)
    space = kind == _SPACE
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(~space & (np.concatenate(([True], space[:-1])) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(~space & (np.concatenate((space[1:], [True])) | edge[1:])) + 1 if len(data) else starts
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # continuation bytes of UTF-8 begin no character
    length = chars[ends] - chars[starts]
    first = np.searchsorted(starts, at)
    words = np.diff(first).astype(float)
    short = np.concatenate(([0], np.cumsum(length <= 3)))
    short = (short[first[1:]] - short[first[:-1]]).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        letters = share[_LOWER] + share[_UPPER]
        solid = chars[at[1:]] - chars[at[:-1]] - share[_SPACE]
        found = np.stack(
            [
                _vote(share[_ODD] / words, NEVER, (0.5, np.inf)),
                _vote(share[_UPPER] / letters, NEVER, (0.5, 1)),
                _vote(share[_PIPE] / words, NEVER, (0.2, np.inf)),
                _vote(share[_BANG] / words, NEVER, (0.3, np.inf)),
                _repetition(data, starts, ends, first),
                _vote(solid / words, NEVER, (11, np.inf)),
                _vote(short / words, NEVER, (0, 0.05)),
                _vote(share[_STOP] / words, (0.02, 0.4), (0.8, np.inf)),
            ],
            axis=1,
        )
    found[words < 5] = NONE
    return found.astype(np.int8).reshape(rows, len(LABELLERS))


def _repetition(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Share of words that open a pair of words met before in the same text."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(common.mix64(data.astype(np.uint64) * np.uint64(257) + np.uint64(1)))))
    h = common.mix64(total[ends] - total[starts] + (ends - starts).astype(np.uint64))
    pair = common.mix64(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else np.zeros(0, np.uint64)
    out = np.full(len(first) - 1, np.nan)
    for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        if b - a >= 5:
            out[i] = 1 - len(np.unique(pair[a : b - 1])) / (b - 1 - a)
    return _vote(out, NEVER, (0.5, 1))


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of good per pattern, rates[class, labeller, vote]) by expectation-maximisation."""
    n = len(LABELLERS)
    one_hot = (patterns[:, :, None] == np.arange(3)).astype(float)
    good, bad = (patterns == GOOD).sum(1), (patterns == BAD).sum(1)
    p = np.where(bad > 0, 0.1, np.where(good > 0, 0.95, 0.8))  # start: labellers seldom cry wolf
    rates = np.zeros((2, n, 3))
    for _ in range(rounds):
        for k, q in ((1, p), (0, 1 - p)):
            w = (counts * q)[:, None, None] * one_hot
            rates[k] = (w.sum(0) + 0.01) / (w.sum((0, 2))[:, None] + 0.03)
        rates[1, :, BAD] = np.minimum(rates[1, :, BAD], FALSE_ALARM)
        prior = np.clip((counts * p).sum() / max(counts.sum(), 1), 1e-3, 1 - 1e-3)
        odds = np.log(prior / (1 - prior)) + (one_hot * (np.log(rates[1]) - np.log(rates[0]))).sum((1, 2))
        new = np.where(bad + good == 0, prior, 1 / (1 + np.exp(-np.clip(odds, -30, 30))))  # no vote, no evidence
        if np.abs(new - p).max(initial=0) < 1e-9:
            break
        p = new
    return p, rates


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every byte trigram, first trigram of each row and the end); trigrams don't cross rows."""
    data, at = common.raw(column)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    x = data.astype(np.uint32)
    code = x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA6B) ^ x[2:] * np.uint32(0xC2B2AE35)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    bucket = (code >> np.uint32(20)).astype(np.int64)
    within = np.ones(len(bucket), bool)
    cross = at[1:-1]
    for back in (1, 2):
        c = cross - back
        within[c[(c >= 0) & (c < len(bucket))]] = False
    total = np.concatenate(([0], np.cumsum(within)))
    return bucket[within], total[np.minimum(at, len(bucket))]


def _shares(bucket: np.ndarray) -> np.ndarray:
    return np.sqrt(np.bincount(bucket, minlength=BUCKETS) / (len(bucket) + DAMP))


def packed(column: pa.Array) -> tuple[list[bytes], list[bytes]]:
    """(non-empty buckets, in two bytes each; a byte for the share of each) of every text."""
    bucket, at = _hashed(column)
    where, codes = [], []
    for a, b in zip(at[:-1], at[1:], strict=True):
        share = _shares(bucket[a:b]) if b > a else np.zeros(0)
        full = np.flatnonzero(share)
        where.append(full.astype(np.uint16).tobytes())
        codes.append(np.rint(255 * np.sqrt(share[full])).astype(np.uint8).tobytes())
    return where, codes


def evaluated(bucket: np.ndarray, code: np.ndarray, sizes: np.ndarray, weight: np.ndarray, target: np.ndarray, w: np.ndarray | None, b: float) -> np.ndarray:
    """The gradient by bucket, that of the bias and the loss, of some rows and added up as whole numbers; without `w` the
    moments of the features, of first and second order. Weights are 1 at most."""
    x = code.astype(np.float64) ** 2
    sums = lambda row, v: np.bincount(bucket, np.rint(np.repeat(row * FIXED, sizes) * v), minlength=BUCKETS).astype(np.int64)
    if w is None:
        return np.concatenate((sums(weight, x), sums(weight, x * x / LEVELS)))
    scale = 2.0 ** np.floor(22 - np.log2(max(np.abs(w).max(), 1e-9)))  # whole numbers again
    z, full = np.zeros(len(sizes)), sizes > 0
    if full.any():
        z[full] = np.add.reduceat(np.rint(w * scale)[bucket] * x, (np.cumsum(sizes) - sizes)[full])
    z = np.clip(z / (scale * LEVELS) + b, -30, 30)
    off = (1 / (1 + np.exp(-z)) - target) * weight
    loss = (np.logaddexp(0, z) - target * z) * weight
    return np.concatenate((sums(off, x), [np.rint(v * FINE).astype(np.int64).sum() for v in (off, loss)]))


def fit_scorer(sums, total: float) -> tuple[np.ndarray, float]:
    """Weighted logistic regression on soft targets in `PASSES` evaluations, by limited-memory BFGS on centred features that
    are scaled by the root of their deviation. `sums(w, b)` adds up `evaluated` over all rows, whose weights are `total`."""
    first, second = sums(None, 0.0).astype(float).reshape(2, -1) / (total * FIXED * LEVELS)
    scale = np.sqrt(np.sqrt(np.maximum(second - first**2, 0)) + 1e-3)

    def plain(v: np.ndarray) -> tuple[np.ndarray, float]:
        w = v[:-1] / scale
        return w, float(v[-1] - w @ first)

    def at(v: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = plain(v)
        found = sums(w, b)
        g, gb, loss = found[:-2].astype(float) / (total * FIXED * LEVELS), *(found[-2:].astype(float) / (total * FINE))
        return loss + 0.5 * RIDGE * (w @ w), np.append((g + RIDGE * w - gb * first) / scale, gb)

    v = np.zeros(BUCKETS + 1)
    loss, g = at(v)
    down, step, past = -10 * g / max(np.linalg.norm(g), 1e-12), 1.0, []
    for _ in range(PASSES - 1):
        new_loss, new_g = at(v + step * down)
        if not new_loss <= loss + 1e-4 * step * (g @ down):
            step *= 0.3
            continue
        s, y = step * down, new_g - g
        v, loss, g, step = v + s, new_loss, new_g, 1.0
        if s @ y > 1e-12:
            past = [*past[-9:], (s, y)]
        down, parts = -g, []
        for s, y in reversed(past):
            parts.append(s @ down / (s @ y))
            down = down - parts[-1] * y
        if past:
            down = down * (past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]))
        for (s, y), part in zip(past, reversed(parts), strict=True):
            down = down + (part - y @ down / (s @ y)) * s
    return plain(v)


class Scorer:
    """What fitting found: the posterior of each vote pattern, and the linear scorer."""

    def __init__(self, by_code: np.ndarray, w: np.ndarray, b: float) -> None:
        self.by_code, self.w, self.b = by_code, w, b

    def columns(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, posterior, score) of each text."""
        code = votes(texts) @ (3 ** np.arange(len(LABELLERS)))
        p = self.by_code[code]
        bucket, at = _hashed(texts)
        s = p.copy()
        for i in range(len(texts)):
            if at[i + 1] > at[i]:
                s[i] = 1 / (1 + np.exp(-np.clip(_shares(bucket[at[i] : at[i + 1]]) @ self.w + self.b, -30, 30)))
        return code, p, s


def fit(docs: DataFrame) -> Scorer | None:
    """The scorer of (doc_id, text); None for an empty table."""
    base = 3 ** np.arange(len(LABELLERS))

    def vote(part: pa.RecordBatch) -> pa.RecordBatch:
        where, codes = packed(part.column(0))
        return common.batch_of({"pattern": (votes(part.column(0)) @ base, pa.int32()), "bucket": (where, pa.binary()), "code": (codes, pa.binary())})

    voted = common.cut(common.map_rows(docs.select("text"), vote, "pattern int, bucket binary, code binary"))
    table = voted.groupBy("pattern").count().orderBy("pattern").collect()  # at most 3 ** 8 rows
    if not table:
        return None
    codes = np.array([r["pattern"] for r in table])
    counts = np.array([r["count"] for r in table], float)
    posterior, _ = label_model((codes[:, None] // base) % 3, counts)
    by_code = np.full(3 ** len(LABELLERS), float((counts * posterior).sum() / counts.sum()))
    by_code[codes] = posterior
    weight = np.zeros(len(by_code))
    weight[codes] = np.sqrt(np.minimum(counts, PER_PATTERN) / counts)
    for side in (by_code >= 0.5, by_code < 0.5):  # the classes weigh alike
        weight[side] /= max((counts * weight[codes])[side[codes]].sum(), 1e-9)
    weight /= weight.max()
    few = voted.coalesce(4 * docs.sparkSession.sparkContext.defaultParallelism)  # each task sends its sums to the driver, 32 KB

    def sums(w: np.ndarray | None, b: float) -> np.ndarray:
        def run(batches):
            out = 0
            for batch in batches:
                for part in common.slices(batch, "bucket"):
                    code, at = common.raw(part.column(2))
                    own = part.column(0).to_numpy()
                    out = out + evaluated(common.raw(part.column(1))[0].view(np.uint16), code, np.diff(at), weight[own], by_code[own], w, b)
            if not np.isscalar(out):
                yield common.batch_of({"sums": ([out.tobytes()], pa.binary())})

        # beyond 64 bits, and exact
        return sum(np.frombuffer(r["sums"], np.int64).astype(object) for r in few.mapInArrow(run, "sums binary").collect())

    return Scorer(by_code, *fit_scorer(sums, float((counts * weight[codes]).sum())))


def score_docs(docs: DataFrame, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pattern, posterior, score, keep) of every document."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_scores(docs, fit(docs), threshold=threshold).drop("text")


def with_scores(df: DataFrame, scorer: Scorer | None, *, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """`df` with columns pattern, posterior, score and keep; those of its own by these names are replaced."""

    def run(part: pa.RecordBatch) -> dict[str, pa.Array]:
        code, p, s = scorer.columns(part.column(part.schema.get_field_index(text_col)))
        return {"pattern": pa.array(code, pa.int32()), "posterior": pa.array(p, pa.float64()), "score": pa.array(s, pa.float64()), "keep": pa.array(s >= threshold)}

    if scorer is None:
        return df.withColumns({"pattern": F.lit(0), "posterior": F.lit(0.0), "score": F.lit(0.0), "keep": F.lit(False)})
    return common.add_columns(df, run, "pattern int, posterior double, score double, keep boolean", text_col)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_docs(common.table(spark, sf_dir, "documents"))
