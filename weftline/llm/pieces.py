"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

A model file gives pieces, scores and kinds. Scores of a unigram model are log probabilities and
are used as they are. A model of another type holds ranks instead: its pieces get the log
probabilities of Zipf's law over the ranks, log(1 / (rank + 1) / H), byte pieces excepted.

Encoding: a blank becomes the marker U+2581, one marker is put in front, and the segmentation of
the greatest total score is taken (of equal ones, that whose last piece is longest, then the one
before it, and so on). A character that no piece covers costs the least score less 10 and is
written as its UTF-8 bytes' pieces, or as the unknown piece if the model lacks byte pieces. A
literal U+2581 in the text is always written as bytes, so that decoding can tell it from a blank.
Decoding joins the pieces, turns markers into blanks, byte pieces into bytes (invalid sequences
into U+FFFD) and drops the marker in front. With byte pieces, decoding gives back any text.

Unless a piece has a marker after another character (then whole texts are the units), no piece
crosses from a word into the marker of the next, so that texts are cut there without changing the
optimum, and each distinct unit of a slice is segmented once: all short units together, position
by position, with numpy; a unit longer than `LONG` characters by itself.

A null text encodes as null and decodes as null; an empty text as no piece. Extra columns are kept
by `encode` and `decode` unless named as their output. Rows are independent.
"""

from __future__ import annotations

import gc
import re
from collections import Counter
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import common

MARK = "▁"
LONG, UNKNOWN_COST = 48, 10.0
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
DEFAULT_MODEL = "piece_bpe_32k.model"


def model_path() -> str:
    """The place of the default vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_MODEL)


def _fields(data: bytes):
    """(number, value) of the fields of a protocol-buffers message."""
    at = 0

    def varint():
        nonlocal at
        shift = value = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + n]
        at += n


def read_model(data: bytes) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(pieces, log scores, kinds) of a model file."""
    names, scores, kinds, unigram = [], [], [], True
    for number, value in _fields(data):
        if number == 1:
            name, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    name = v.decode()
                elif n == 2:
                    score = float(np.frombuffer(v, "<f4")[0])
                elif n == 3:
                    kind = v
            names.append(name)
            scores.append(score)
            kinds.append(kind)
        elif number == 2:
            unigram = dict(x for x in _fields(value) if x[0] == 3).get(3, 1) == 1
    scores, kinds = np.array(scores, float), np.array(kinds)
    if not unigram:
        normal = np.flatnonzero(kinds == NORMAL)
        rank = np.argsort(np.argsort(-scores[normal], kind="stable"), kind="stable")
        scores[normal] = -np.log(rank + 1.0) - np.log((1.0 / np.arange(1, len(normal) + 1)).sum())
    return names, scores, kinds


class Trie:
    """A double-array trie: from node n by character code c to base[n] + c, if check there is n."""

    def __init__(self, entries: dict[str, int]) -> None:
        often = Counter(c for e in entries for c in e)
        alphabet = sorted(often, key=lambda c: (-often[c], c))  # close codes for characters that meet
        self.code = {c: i + 1 for i, c in enumerate(alphabet)}
        children: list[dict[int, int]] = [{}]
        value: list[int] = [-1]
        for e, v in entries.items():
            n = 0
            for c in e:
                k = self.code[c]
                if k not in children[n]:
                    children[n][k] = len(children)
                    children.append({})
                    value.append(-1)
                n = children[n][k]
            value[n] = v
        size = len(children) * 2 + len(alphabet) + 2
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = np.zeros(size, bool)
        used[0] = True
        place, free, tail = {0: 0}, len(alphabet) + 1, 1
        spot: dict[int, int] = {}  # a base for each node: many children first, single ones fill the gaps
        for n in sorted((n for n in range(len(children)) if children[n]), key=lambda n: -len(children[n])):
            if max(tail, len(alphabet)) + 2 * len(alphabet) + 4096 > len(used):
                used = np.concatenate((used, np.zeros(len(used) + 4096, bool)))
            if len(children[n]) == 1:
                (k,) = children[n]
                while used[free]:
                    free += 1
                spot[n] = free - k
                used[free] = True
                tail = max(tail, free + 1)
                continue
            keys = np.fromiter(children[n], np.int64)
            least = int(keys.min())
            low = max(tail - 2048, least + 1)
            bases = low + np.flatnonzero(~used[low : max(tail, low) + 1]) - least  # the last one is past all used
            spot[n] = int(bases[(~used[bases[:, None] + keys].any(1)).argmax()])
            used[spot[n] + keys] = True
            tail = max(tail, spot[n] + int(keys.max()) + 1)
        self.base, self.check, self.value = (np.concatenate((x, np.full(max(0, len(used) - size), fill, np.int32))) for x, fill in ((self.base, 0), (self.check, -1), (self.value, -1)))
        stack = [0]
        while stack:
            n = stack.pop()
            if n in spot:
                self.base[place[n]] = spot[n]
                for k, child in children[n].items():
                    at = spot[n] + k
                    self.check[at], self.value[at] = place[n], value[child]
                    place[child] = at
                    stack.append(child)
        self.table = np.zeros(0x110000, np.int32)
        for c, k in self.code.items():
            self.table[ord(c)] = k

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The child of each node by each character code; -1 without one."""
        at = self.base[node] + code
        return np.where((code > 0) & (self.check[at] == node), at, -1)


class Pieces:
    """A model, made ready to encode and decode."""

    def __init__(self, data: bytes) -> None:
        self.names, self.scores, self.kinds = read_model(data)
        usable = np.flatnonzero((self.kinds == NORMAL) | (self.kinds == USER))
        self.trie = Trie({self.names[i]: int(i) for i in usable})
        self.width = max((len(self.names[i]) for i in usable), default=1)
        found = {int(self.names[i][1:-1], 16): int(i) for i in np.flatnonzero(self.kinds == BYTE)}
        self.bytes = [found.get(b, -1) for b in range(256)]
        self.has_bytes = len(found) == 256
        self.unknown = int(np.flatnonzero(self.kinds == UNKNOWN)[0]) if (self.kinds == UNKNOWN).any() else 0
        self.least = (float(self.scores[usable].min()) if len(usable) else 0.0) - UNKNOWN_COST
        cut = all(MARK not in self.names[i].lstrip(MARK) for i in usable)
        self.unit = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+") if cut else re.compile(r"(?s).+")
        self.byte_of = {i: b for b, i in found.items()}
        self.text_of = [MARK if k == USER and n == MARK else "" if k in (CONTROL, UNUSED) else n for n, k in zip(self.names, self.kinds.tolist(), strict=True)]
        written = [bytes([self.byte_of[i]]) if i in self.byte_of else t.replace(MARK, " ").encode("utf-8", "replace") for i, t in enumerate(self.text_of)]
        self.blob, self.extent = np.frombuffer(b"".join(written), np.uint8), np.fromiter(map(len, written), np.int32, len(written))
        self.place = np.cumsum(self.extent, dtype=np.int32) - self.extent
        self.blank = np.fromiter((w[:1] == b" " for w in written), bool, len(written))

    def spelt(self, chars: str) -> list[int]:
        return [self.bytes[b] for b in chars.encode("utf-8", "replace")] if self.has_bytes else [self.unknown]

    def segment_long(self, unit: str) -> list[int]:
        """One unit, by the same recurrence, character by character."""
        n = len(unit)
        best, back = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
        base, check, value, code = self.trie.base, self.trie.check, self.trie.value, self.trie.code
        for i in range(n):
            node, single = 0, False
            for j in range(i, min(n, i + self.width)):
                k = code.get(unit[j], 0)
                at = int(base[node]) + k
                if not k or check[at] != node:
                    break
                node = at
                v = int(value[at])
                if v >= 0:
                    single |= j == i
                    s = best[i] + self.scores[v]
                    if s > best[j + 1]:
                        best[j + 1], back[j + 1] = s, (i, v)
            if not single:
                s = best[i] + self.least
                if s > best[i + 1]:
                    best[i + 1], back[i + 1] = s, (i, -1)
        return self._collect(unit, [(i, v, j) for i, v, j in self._walk(back, n)])

    @staticmethod
    def _walk(back, n):
        out = []
        while n:
            i, v = back[n]
            out.append((i, v, n))
            n = i
        return out[::-1]

    def _collect(self, unit: str, path) -> list[int]:
        ids: list[int] = []
        run = ""
        for i, v, j in path:
            if v < 0:
                run += unit[i:j]
                continue
            if run:
                ids += self.spelt(run)
                run = ""
            ids.append(v)
        return ids + (self.spelt(run) if run else [])

    def segment(self, units: list[str]) -> list[list[int]]:
        """The pieces of each unit."""
        out: list[list[int] | None] = [None] * len(units)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        for i in np.flatnonzero(sizes > LONG):
            out[i] = self.segment_long(units[i])
        short = np.flatnonzero(sizes <= LONG)
        short = short[np.argsort(sizes[short], kind="stable")]
        for c in range(0, len(short), 16384):
            self._segment_block(short[c : c + 16384], units, sizes, out)
        return out  # type: ignore[return-value]

    def _segment_block(self, block, units, sizes, out) -> None:
        n, longest = len(block), int(sizes[block[-1]])
        text = "".join(units[i].ljust(longest, "\0") for i in block)
        code = self.trie.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].reshape(n, longest)
        size = sizes[block]
        best = np.full((longest + 1, n), -np.inf)
        best[0] = 0
        from_, piece = np.zeros((longest + 1, n), np.int16), np.full((longest + 1, n), -1, np.int32)
        for i in range(longest):
            live = np.flatnonzero(size > i)
            node = np.zeros(len(live), np.int32)
            single = np.zeros(n, bool)
            start = best[i]
            for j in range(i, min(longest, i + self.width)):
                node = self.trie.step(node, code[live, j])
                on = (node >= 0) & (size[live] > j)
                live, node = live[on], node[on]
                if not len(live):
                    break
                v = self.trie.value[node]
                has = v >= 0
                who, v = live[has], v[has]
                if j == i:
                    single[who] = True
                s = start[who] + self.scores[v]
                better = s > best[j + 1][who]  # starts come in order: the longer last piece keeps a tie
                who = who[better]
                best[j + 1, who], from_[j + 1, who], piece[j + 1, who] = s[better], i, v[better]
            bare = np.flatnonzero((size > i) & ~single)
            s = start[bare] + self.least
            better = s > best[i + 1][bare]
            bare = bare[better]
            best[i + 1, bare], from_[i + 1, bare], piece[i + 1, bare] = s[better], i, -1
        # walk back from the ends, all units a piece at a time; then the pieces in order, unit by unit
        at, steps, who = size.astype(np.int64), [], np.arange(n)
        while (at > 0).any():
            steps.append(np.where(at > 0, piece[at, who], -2))
            at = np.where(at > 0, from_[at, who], 0)
        path = np.array(steps[::-1]).T
        taken = path != -2
        flat, ends = path[taken].tolist(), np.cumsum(taken.sum(1)).tolist()
        bare = ((path == -1).any(1)).tolist()
        start = 0
        for row, (i, end) in enumerate(zip(block.tolist(), ends, strict=True)):
            out[i] = self._collect(units[i], self._walk([*zip(from_[:, row].tolist(), piece[:, row].tolist(), strict=True)], len(units[i]))) if bare[row] else flat[start:end]
            start = end

    def encode(self, texts: list[str | None], cache: dict[str, list[int]]) -> list[list[int] | None]:
        """The piece ids of each text. `cache` holds units already segmented."""
        cut: list[list | None] = []
        fresh: set[str] = set()
        for text in texts:
            if not text:
                cut.append(text if text is None else [])
                continue
            # literal markers stand aside, as bytes, between what is around them
            units = self._with_literals(text) if MARK in text else self.unit.findall(MARK + text.replace(" ", MARK))
            cut.append(units)
            fresh |= {u for u in units if isinstance(u, str)}.difference(cache) if MARK in text else set(units).difference(cache)
        todo = list(fresh)
        cache.update(zip(todo, self.segment(todo), strict=True))
        found = cache.__getitem__
        return [
            None if units is None else [x for u in units for x in (cache[u] if isinstance(u, str) else u)] if text and MARK in text else list(chain.from_iterable(map(found, units)))
            for text, units in zip(texts, cut, strict=True)
        ]

    def _with_literals(self, text: str) -> list:
        literal, out = self.spelt(MARK), []
        for i, part in enumerate(text.split(MARK)):
            if i:
                out.append(literal)
            part = (MARK if i == 0 else "") + part.replace(" ", MARK)
            out += self.unit.findall(part) if part else []
        return out

    def decode(self, rows: list[list[int] | None]) -> list[str | None]:
        out: list[str | None] = []
        text_of, byte_of = self.text_of, self.byte_of
        for ids in rows:
            if ids is None:
                out.append(None)
                continue
            if None in ids or (ids and not 0 <= min(ids) <= max(ids) < len(text_of)):  # no piece has such an id
                ids = [i if i is not None and 0 <= i < len(text_of) else -1 for i in ids]
            if byte_of.keys().isdisjoint(ids):
                text = "".join([text_of[i] if i >= 0 else "\ufffd" for i in ids]).replace(MARK, " ")
            else:
                parts, run = [], bytearray()
                for i in ids:
                    b = byte_of.get(i)
                    if b is not None:
                        run.append(b)
                        continue
                    if run:
                        parts.append(run.decode("utf-8", "replace"))
                        run = bytearray()
                    parts.append(text_of[i].replace(MARK, " ") if i >= 0 else "\ufffd")
                if run:
                    parts.append(run.decode("utf-8", "replace"))
                text = "".join(parts)
            out.append(text[1:] if text[:1] == " " else text)
        return out

    def decode_bytes(self, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(UTF-8 bytes, row offsets) of rows of `size` ids each, all at once; None if any row takes more care: ids that
        the model lacks, pieces that stand for nothing (they part the bytes around them) and invalid sequences."""
        if len(flat) and not 0 <= int(flat.min()) <= int(flat.max()) < len(self.extent):
            return None
        n, start, ends = self.extent[flat], self.place[flat], np.cumsum(size)
        if not n.all():
            return None
        first = (ends - size)[size > 0]
        lead = self.blank[flat[first]].astype(np.int32)
        n[first] -= lead
        start[first] += lead
        to = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
        if to[-1] >= 1 << 31:
            return None
        data = self.blob[np.repeat(start - to[:-1].astype(np.int32), n) + np.arange(to[-1], dtype=np.int32)]
        at = to[np.concatenate(([0], ends))].astype(np.int32)
        if (data[at[:-1][np.diff(at) > 0]] & 0xC0 == 0x80).any():  # a row may not go on with a character of the one before
            return None
        try:
            str(data.data, "utf-8")
        except UnicodeDecodeError:
            return None
        return data, at


@contextmanager
def _uncollected():
    """Without the cyclic garbage collector: the many lists of ids have no cycles, only the cost of looking for them."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


_READY: dict[bytes, Pieces] = {}
#: Units remembered by a task.
REMEMBERED = 100_000


def ready(data: bytes) -> Pieces:
    if data not in _READY:
        _READY[data] = Pieces(data)
    return _READY[data]


def _encoded(texts: pa.Array, model: bytes, cache: dict[str, list[int]]) -> pa.Array:
    if len(cache) > REMEMBERED:
        cache.clear()
    ids = ready(model).encode(texts.to_pylist(), cache)
    at = np.concatenate(([0], np.cumsum([len(row or ()) for row in ids])))
    flat = np.fromiter(chain.from_iterable(filter(None, ids)), np.int32, int(at[-1]))
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat), mask=pa.array([row is None for row in ids]))


def _decoded(ids: pa.Array, model: bytes) -> pa.Array:
    flat, at = ids.flatten(), ids.offsets.to_numpy()
    valid = ids.is_valid().to_pylist()
    # what flatten leaves out of null rows has no place in the offsets
    size = np.where(valid, np.diff(at), 0)
    found = None if flat.null_count or not pa.types.is_integer(flat.type) else ready(model).decode_bytes(flat.to_numpy(), size)
    if found:
        mask = None if all(valid) else pa.array(valid).buffers()[1]
        return pa.Array.from_buffers(pa.string(), len(ids), [mask, pa.py_buffer(found[1]), pa.py_buffer(found[0])])
    flat, end = flat.to_pylist(), np.cumsum(size).tolist()
    return pa.array(ready(model).decode([flat[e - n : e] if v else None for v, e, n in zip(valid, end, size.tolist(), strict=True)]), pa.string())


def _mapped(df: DataFrame, made: dict[str, T.DataType], size_col: str, fn) -> DataFrame:
    """`df` with the columns that `fn` makes of slices of it."""
    schema = df.schema
    for name, kind in made.items():
        schema = T.StructType([*[f for f in schema.fields if f.name != name], T.StructField(name, kind)])

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        with _uncollected():
            out = fn(lambda name: part.column(part.schema.get_field_index(name)))
        return pa.RecordBatch.from_arrays([out[f.name] if f.name in out else part.column(part.schema.get_field_index(f.name)) for f in schema.fields], names=schema.names)

    return common.map_rows(df, run, schema, size_col)


_IDS = T.ArrayType(T.IntegerType())


def encode(df: DataFrame, model: bytes, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """`df` with the piece ids of `text_col`; `model` is the content of a model file (below 1 MB)."""
    cache: dict[str, list[int]] = {}
    return _mapped(df, {ids_col: _IDS}, text_col, lambda col: {ids_col: _encoded(col(text_col), model, cache)})


def decode(df: DataFrame, model: bytes, *, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """`df` with the text of `ids_col`. Ids that the model lacks, and nulls in a list, decode as U+FFFD."""
    return _mapped(df, {text_col: T.StringType()}, ids_col, lambda col: {text_col: _decoded(col(ids_col), model)})


def recode(df: DataFrame, model: bytes, *, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """`df` with the piece ids of `text_col` and with the text that these decode to, in one pass."""
    cache: dict[str, list[int]] = {}

    def both(col) -> dict[str, pa.Array]:
        ids = _encoded(col(text_col), model, cache)
        return {ids_col: ids, decoded_col: _decoded(ids, model)}

    return _mapped(df, {ids_col: _IDS, decoded_col: T.StringType()}, text_col, both)


def tokenized(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, n_tokens, n_bytes, ids, round_trip) of every document."""
    coded = recode(docs.select("doc_id", "text"), model)
    first, last = min(ready(model).byte_of, default=0), max(ready(model).byte_of, default=-1)
    return coded.select(
        "doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), F.coalesce(F.size(F.filter("ids", lambda x: x.between(first, last))), F.lit(0)).cast("long").alias("n_byte_tokens"), "ids", F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip")
    )


def op1_sentencepiece(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    with open(path or model_path(), "rb") as f:
        model = f.read()
    return tokenized(common.table(spark, sf_dir, "documents"), model)
