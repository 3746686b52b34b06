"""Language identification by rank-order profiles of character n-grams.

A profile lists a language's most frequent n-grams (n = 1 to 3 over letters, words padded with one
blank), counted over the training documents. A document's own list of most frequent n-grams is
compared to each profile by the out-of-place distance: for each n-gram of the document the
difference of its ranks, and the length of the profile if the profile lacks it. The nearest
profile wins; ties go to the smaller language name. Equal counts are ranked by the n-gram's code.

Learned from text and language of documents whose crc32(doc_id as text) mod 4 is not 2; of these a
sample per language is used: each with probability `SAMPLE` / documents of the language, by hash.
Letters are lower-cased; anything else counts as a blank, runs of blanks as one. The score is the
lead of the nearest profile over the next, as a share of the greatest distance, plus one, halved;
with one profile it is one. `und` with score 0 if the text is null or has no letter, or if nothing
could be learned. Extra columns are ignored, repeated rows are each answered, and an empty table
gives no rows.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import common

PROFILE, LIST, SAMPLE = 400, 300, 1500
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point its lower-case letter, or a blank."""
    if not _LETTERS:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if c < 0x3000 or unicodedata.category(chr(c))[0] == "L":
                s = chr(c)
                if s.isalpha():
                    table[c] = ord(s.lower()[0])
        _LETTERS.append(table)
    return _LETTERS[0]


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the distinct n-grams of a text; none if it has no letter."""
    x = letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    blank = x == 32
    x = x[~(blank & np.concatenate(([True], blank[:-1])))]
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = np.concatenate(([32], x, [32] if x[-1] != 32 else [])).astype(np.int64)
    two = x[:-1] << 21 | x[1:]
    three = x[:-2] << 42 | two[1:]
    codes = np.concatenate((x[x != 32], two, three[(three >> 21 & 0x1FFFFF) != 32]))
    if int(x.max()) < 1 << 10:  # the same order in 32 bits sorts faster
        codes = ((codes >> 42) << 20 | (codes >> 21 & 0x3FF) << 10 | (codes & 0x3FF)).astype(np.int32)
        codes.sort()
        at = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        c = codes[at].astype(np.int64)
        return (c >> 20) << 42 | (c >> 10 & 0x3FF) << 21 | (c & 0x3FF), np.diff(np.concatenate((at, [len(codes)])))
    return np.unique(codes, return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent codes in order; ties by code."""
    if len(codes) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:most]


def learn(docs: DataFrame, *, sample: int = SAMPLE) -> dict[str, list[int]]:
    """Profiles by language, from (doc_id, text, lang) of the training folds."""
    train = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~common.held_out("doc_id"))
    sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}  # a row a language
    if not sizes:
        return {}
    rates = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(sample / n))])
    picked = train.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < rates[F.col("lang")] * (1 << 30)).select("lang", "text")

    def count(batches):
        total: dict[str, dict[int, int]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = total.setdefault(lang, {})
                for c, n in zip(*(x.tolist() for x in ngrams(text)), strict=True):
                    own[c] = own.get(c, 0) + n
        for lang, own in total.items():
            yield common.batch_of({"lang": ([lang] * len(own), pa.string()), "gram": (list(own), pa.int64()), "n": (list(own.values()), pa.int64())})

    grams = picked.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))  # limited in each task before the shuffle
    found = grams.withColumn("rank", rank).filter(F.col("rank") <= PROFILE).orderBy("lang", "rank").toArrow()  # PROFILE a language
    profiles: dict[str, list[int]] = {}
    for lang, gram in zip(found.column("lang").to_pylist(), found.column("gram").to_pylist(), strict=True):
        profiles.setdefault(lang, []).append(gram)
    return profiles


def distances(own: np.ndarray, index: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Out-of-place distance of a ranked list to each profile."""
    grams, ranks = index  # sorted n-grams of any profile; ranks[n-gram, profile], -1 if missing
    at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
    r = np.where((grams[at] == own)[:, None], ranks[at], -1)
    return np.where(r < 0, PROFILE, np.abs(r - np.arange(len(own))[:, None])).sum(0)


def index_of(profiles: dict[str, list[int]]) -> tuple[list[str], tuple[np.ndarray, np.ndarray]]:
    names = sorted(profiles)
    grams = np.unique(np.array([g for n in names for g in profiles[n]], np.int64))
    ranks = np.full((len(grams), len(names)), -1, np.int64)
    for j, n in enumerate(names):
        ranks[np.searchsorted(grams, profiles[n]), j] = np.arange(len(profiles[n]))
    return names, (grams, ranks)


def predict(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    names, index = index_of(profiles)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found, scores = [], []
        for text in part.column(2).to_pylist():
            codes, counts = ngrams(text) if text else ((), ())
            if not len(codes) or not names:
                found.append("und")
                scores.append(0.0)
                continue
            own = ranked(codes, counts, LIST)
            d = distances(own, index)
            best = int(np.argmin(d))
            rest = np.delete(d, best)
            found.append(names[best])
            scores.append(0.5 + 0.5 * float(rest.min() - d[best]) / (len(own) * PROFILE) if len(rest) else 1.0)
        return common.batch_of({"doc_id": (part.column(0), None), "held_out": (part.column(1), None), "lang_pred": (found, pa.string()), "score": (scores, pa.float64())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.map_rows(docs.select("doc_id", common.held_out("doc_id").alias("held_out"), "text"), run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return predict(docs, learn(docs))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(common.table(spark, sf_dir, "documents"))
