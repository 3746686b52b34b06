"""Personal data by candidate gradient boosting.

Generators with high recall propose overlapping spans: the four base patterns with their checks, and
loose ones (written-out e-mail addresses, numbers in groups without a valid check digit, phone
numbers without a plus sign, labelled secrets: the value only, and access keys by their public prefixes). Boosted trees score each proposal by its
format and its context; the spans whose calibrated score reaches the threshold of their kind are kept,
best first, as far as they don't overlap. Base spans are always kept.

The trees are trained here on the proposals of all documents. Features are whole numbers, so equal examples are
folded and counted; trees grow by sums over their bins, in the driver as long as there are at most `GATHERED`
different examples and beside the executors' parts of them beyond, with the same result. Positive are base spans, loose proposals
that have the form of their kind and a cue before them, and base spans rewritten the loose way
(`rewritten`). Negative are proposals that fail the check of their form, numbers with neither a cue nor
the layout of a phone number, and rewritten numbers and values that are put so. Any other loose proposal is
unlabelled and not trained on, so that a form is not lost by being common. The threshold of a kind is
the lowest at which at least `PRECISION` of the loose proposals of that kind above it are positive (half-way
to the next score, scores taken to 2^-16; 0.5 at least); a kind with fewer than 20 of them, or without such a threshold, adds nothing.

Positions are code points, ends exclusive. Null text counts as empty: no spans. Equal texts have
equal spans whatever their rows. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import common

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
PRECISION, TREES, DEPTH, RATE = 0.995, 40, 3, 0.3
#: Up to so many different examples (of about 200 bytes) are sent to the driver.
GATHERED = 50_000
BINS, FIXED, SCORES = 16, 1 << 20, 1 << 16

# e-mail patterns are anchored at the at sign, so that a long run of characters is read once
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can't begin inside a run of digits that an earlier match left, so the look-behind only saves time
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# proposals beyond the base patterns
_AT = re.compile(r" ?(?:\(at\)|\[at\]|\{at\}|@) ?| at ", re.I)
_DOT = r" ?(?:\(dot\)|\[dot\]|\{dot\}) ?| dot "
_DOMAIN_SPELT = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:(?:{_DOT}|\.)[A-Za-z0-9-]{{1,63}})+", re.I)
_DOMAIN_DOT = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:(?:{_DOT})[A-Za-z0-9-]{{1,63}})+", re.I)
#: Characters before a written-out at sign that are looked at.
LOCAL_MOST = 64
_PHONE_LOOSE = re.compile(r"(?<![0-9A-Za-z+])(?:\+|00)?(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[ .-]?(?:\([0-9]{2,5}\)|[0-9]{2,5})){2,5}(?![0-9A-Za-z])")
_CARD_LOOSE = re.compile(r"(?<![0-9A-Za-z+])[0-9]{3,6}(?:[ -][0-9]{2,6}){2,5}(?![0-9A-Za-z])")
_SECRET = re.compile(r"(?<![A-Za-z])(?:pass(?:word|wd|phrase)|pwd|secret|token|(?:api|access|private|secret)[ _-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"',;<>]{4,400})", re.I)
# fixed values: public prefixes of access keys
_KEY = re.compile(r"(?<![A-Za-z0-9_-])(?:AKIA|ASIA|ghp_|gho_|ghs_|xoxb-|xoxp-|sk-)[A-Za-z0-9_-]{16,80}(?![A-Za-z0-9_-])", re.I)
_DATE = re.compile(r"(?:19|20)[0-9]{2}[ .-](?:0[1-9]|1[0-2])[ .-](?:0[1-9]|[12][0-9]|3[01])(?![0-9])|(?:0[1-9]|[12][0-9]|3[01])[ .-](?:0[1-9]|1[0-2])[ .-](?:19|20)[0-9]{2}(?![0-9])")
_LAYOUT = re.compile(r"\([0-9]{2,5}\)|[0-9][.-][0-9]+[.-][0-9]")
_CUE = {k: re.compile(rf"\b(?:{x})") for k, x in {"email": "e-?mail|mail|contact|courriel|correo", "ip": "ip|host|addr|server", "card": "card|visa|master|credit|iban|karte|carte|tarjeta", "phone": "tel|tél|phone|call|mobile|fax|móvil|handy", "secret": "pass|pwd|secret|token|api|access|private|key"}.items()}
_ANY = re.compile(r"[0-9@]|\bat\b|\(at\)|\[at\]|\{at\}|pass|pwd|secret|token|key|akia|asia|gh[pos]_|xox[bp]-|sk-", re.I)
_DIGIT = re.compile(r"[0-9]")
FEATURES = ("kind", "length", "digits", "groups", "longest_group", "shortest_group", "spaces", "dashes", "dots", "parens", "plus", "at", "letters", "zero_first", "cue", "left_is_letter", "right_is_letter", "left_is_space", "right_is_space", "left_is_sign", "left_is_quote", "right_is_stop")


class Taken:
    """Which characters of a text spans take."""

    def __init__(self, n: int, spans: list[tuple[str, int, int]]) -> None:
        self.mask = bytearray(n)
        for span in spans:
            self.take(span)

    def take(self, span: tuple[str, int, int]) -> None:
        self.mask[span[1] : span[2]] = b"\1" * (span[2] - span[1])

    def free(self, span: tuple[str, int, int]) -> bool:
        return self.mask.find(1, span[1], span[2]) < 0


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def passes(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in found.split("."))
    digits = re.sub("[^0-9]", "", found)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 10 <= len(digits) <= 15


def emails(text: str) -> list[tuple[str, int, int]]:
    """The base spans of e-mail addresses: the run of local characters before each at sign that a domain follows."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        free = m.end() if m else at + 1
        if m:
            found.append(("email", start, free))
        at = text.find("@", free)
    return found


def spelt_emails(text: str) -> list[tuple[str, int, int]]:
    """Addresses with a written-out or spaced at sign or dot."""
    found, free = [], 0
    for mark in _AT.finditer(text):
        start = mark.start()
        least = max(free, start - LOCAL_MOST)
        while start > least and text[start - 1] in _LOCAL:
            start -= 1
        while start < mark.start() and not text[start].isalnum():
            start += 1
        m = (_DOMAIN_DOT if mark.group().lower() == " at " else _DOMAIN_SPELT).match(text, mark.end()) if start < mark.start() else None
        if m:
            free = m.end()
            found.append(("email", start, free))
    return found


def matches(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, whether it passes) of every match of the base patterns."""
    found = []
    if "@" in text:
        found += emails(text)
    if _DIGIT.search(text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text)]
        found += [("card", m.start(), m.end()) for m in _CARD.finditer(text)]
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text)]
    return [(k, s, e, passes(k, text[s:e])) for k, s, e in found]


def proposals(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, proposals beyond them, matches that fail the base checks)."""
    if not text or not _ANY.search(text):
        return [], [], []
    found = matches(text)
    base = [(k, s, e) for k, s, e, ok in found if ok]
    more = spelt_emails(text)
    more += [("phone", m.start(), m.end()) for m in _PHONE_LOOSE.finditer(text)]
    more += [("card", m.start(), m.end()) for m in _CARD_LOOSE.finditer(text)]
    more += [("secret", m.start(), m.end()) for m in _KEY.finditer(text)]
    if ":" in text or "=" in text:
        more += [("secret", m.start(1), m.end(1)) for m in _SECRET.finditer(text)]
    taken = set(base)
    return base, [x for x in dict.fromkeys(more) if x not in taken], [(k, s, e) for k, s, e, ok in found if not ok]


def cued(text: str, span: tuple[str, int, int]) -> bool:
    return bool(_CUE[span[0]].search(text[max(0, span[1] - 30) : span[1]].lower()))


def label(text: str, span: tuple[str, int, int]) -> int | None:
    """1, 0 or None (unknown) of a loose proposal."""
    kind, s, e = span
    x = text[s:e]
    digits = sum("0" <= c <= "9" for c in x)
    if kind == "email":
        if not re.search(r"[a-z]{2}$", x, re.I):
            return 0
        return 1 if cued(text, span) else None
    if kind == "secret":
        return int(len(x) >= 8 and any(map(str.isalpha, x)) and not x.isalpha())
    if not (10 <= digits <= 15 and not _DATE.match(x) if kind == "phone" else 14 <= digits <= 19):
        return 0
    if cued(text, span):
        return 1
    return None if kind == "phone" and _LAYOUT.search(x) else 0


def rewritten(text: str, span: tuple[str, int, int]) -> list[tuple[str, tuple[str, int, int], int]]:
    """(text, proposal in it, label): a base span or secret in its context, written as the loose generators take it."""
    kind, s, e = span
    x, n = text[s:e], zlib.crc32(text[s:e].encode("utf-8", "replace"))
    digits = re.sub("[^0-9]", "", x)
    put: list[tuple[str, str, int]] = []  # cue, form, label
    if kind == "email":
        at, dot = ((" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" @ ", "."))[n % 4]
        form = x.replace("@", at).replace(".", dot)
        put = [(("", "mail: ")[n // 4 % 2], form if re.search("[a-z]{2}$", x, re.I) else form + dot + "com", 1)]
    elif kind == "phone":
        mark = " -."[n % 3]
        cut = mark.join([digits[:-7], digits[-7:-4], digits[-4:]]) if len(digits[:-7]) <= 5 else mark.join(digits[i : i + 3] for i in range(0, len(digits) - 3, 3)) + digits[(len(digits) - 1) // 3 * 3 :]
        put = [("tel. ", cut, 1), (("phone: ", "call ")[n // 3 % 2], digits, 1), ("", x[1:], 1), ("", digits, 0), ("", " ".join(digits[i : i + 2] for i in range(0, len(digits) // 2 * 2, 2)), 0)]
    elif kind == "card":
        wrong = digits[:-1] + str((int(digits[-1]) + 1) % 10)
        form = " -"[n % 2].join(wrong[i : i + 4] for i in range(0, len(wrong), 4))
        put = [(("card ", "visa: ")[n // 2 % 2], form, 1), ("", form, 0)]
    elif kind == "secret":
        put = [("", "".join(filter(str.isalpha, x)).lower()[:12], 0)]
    out = []
    left, right = text[max(0, s - 40) : s], text[e : e + 2]
    for cue, form, y in put:
        # a cue that stands in the text already would gainsay a number put without one
        if y == 0 and kind != "secret" and _CUE[kind].search(left[-30:].lower()):
            continue
        own = left + cue + form + right
        at, to = len(left) + len(cue), len(left) + len(cue) + len(form)
        out += [(own, m, y) for m in proposals(own)[1] if m[0] == kind and m[1] < to and m[2] > at]
    return out


def examples(text: str) -> list[tuple[list[float], int, bool]]:
    """(features, label, whether loose) of the proposals of a text that are trained on."""
    base, more, failed = proposals(text)
    taken = Taken(len(text), base)
    apart = [m for m in more if taken.free(m)]
    known = [(text, m, y, True) for m in apart if (y := label(text, m)) is not None]
    loose = set(apart)
    found = [(text, x, 1, False) for x in base] + [(text, x, 0, False) for x in failed if x not in loose and not cued(text, x)] + known
    found += [(*x, True) for span in base + [m for t, m, y, _ in known if y and m[0] == "secret"] for x in rewritten(text, span)]
    return [(describe(t, x), y, z) for t, x, y, z in found]


def describe(text: str, span: tuple[str, int, int]) -> list[float]:
    """The features of a span, of its format and its context."""
    kind, s, e = span
    x = text[s:e]
    groups = [len(g) for g in re.findall("[0-9]+", x)] or [0]
    left, right = text[s - 1] if s else " ", text[e] if e < len(text) else " "
    return [
        KINDS.index(kind), len(x), sum(groups), len(groups), max(groups), min(groups), x.count(" "), x.count("-"), x.count("."), x.count("("), x.count("+"), x.count("@"), sum(map(str.isalpha, x)), x[:1] == "0",
        cued(text, span), left.isalpha(), right.isalpha(), left.isspace(), right.isspace(), left in "+-#$=_/", left in "\"'", right in ".,;:",
    ]


class Boosted:
    """Logistic gradient boosting with small regression trees on binned features."""

    def __init__(self, rate: float) -> None:
        rate = min(max(rate, 1e-3), 1 - 1e-3)
        self.start, self.trees = float(np.log(rate / (1 - rate))), []

    @classmethod
    def fitted(cls, sums, cuts: list[np.ndarray], rate: float) -> Boosted:
        """`sums` adds up what a function makes of parts of the examples."""
        model = cls(rate)
        for _ in range(TREES):
            splits: dict[int, tuple[int, float]] = {}
            leaf = {1: 0.0}
            level = [1]
            for _ in range(DEPTH):
                tree = _nested(splits, lambda node: node)
                found = sums(lambda x, y, n, tree=tree, level=level: histogram(x, y, n, model, tree, level, cuts))
                level = [child for node, own in zip(level, found, strict=True) for child in model._split(node, own, cuts, splits, leaf)]
                if not level:
                    break
            model.trees.append(_nested(splits, leaf.__getitem__))
        return model

    @staticmethod
    def _split(node: int, own: np.ndarray, cuts: list[np.ndarray], splits: dict, leaf: dict) -> list[int]:
        """The children of a node, from its sums of gradients, weights and examples by feature and bin."""
        (g, h, n), (low_g, low_h, _) = own[:, 0].sum(1), np.cumsum(own, axis=2)[:, :, :-1]
        leaf[node] = RATE * g / (h + 1.0)
        if n < 20:
            return []
        gain = low_g**2 / (low_h + 1.0) + (g - low_g) ** 2 / (h - low_h + 1.0) - g**2 / (h + 1.0)
        gain[np.arange(BINS - 1) >= np.array([len(c) for c in cuts])[:, None]] = -np.inf
        j, c = np.unravel_index(gain.argmax(), gain.shape)
        if gain[j, c] <= 1e-6:
            return []
        splits[node] = (int(j), float(cuts[j][c]))
        leaf[2 * node] = RATE * low_g[j, c] / (low_h[j, c] + 1.0)
        leaf[2 * node + 1] = RATE * (g - low_g[j, c]) / (h - low_h[j, c] + 1.0)
        return [2 * node, 2 * node + 1]

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.start)
        for tree in self.trees:
            f += _apply(tree, x)
        return 1 / (1 + np.exp(-f))


def _nested(splits: dict[int, tuple[int, float]], leaf, node: int = 1):
    return (*splits[node], _nested(splits, leaf, 2 * node), _nested(splits, leaf, 2 * node + 1)) if node in splits else float(leaf(node))


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    j, c, low, high = tree
    return np.where(x[:, j] <= c, _apply(low, x), _apply(high, x))


def histogram(x: np.ndarray, y: np.ndarray, n: np.ndarray, model: Boosted, tree, level: list[int], cuts: list[np.ndarray]) -> np.ndarray:
    """Gradients, weights and examples by node of `level`, feature and bin. Each is taken to a multiple of 1 / `FIXED`,
    so that sums are exact whatever their order."""
    p, at = model.score(x), _apply(tree, x)
    values = [np.rint(v * FIXED) * n for v in (y - p, p * (1 - p))] + [n * float(FIXED)]
    out = np.zeros((len(level), 3, len(cuts), BINS))
    for j, points in enumerate(cuts):
        code = np.searchsorted(points, x[:, j])
        for i, node in enumerate(level):
            rows = at == node
            for k, v in enumerate(values):
                out[i, k, j] = np.bincount(code[rows], v[rows], minlength=BINS)
    return out / FIXED


def _arrays(part: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, label, how often, whether loose) of folded examples."""
    x, y, loose, n = (part.column(i) for i in range(4))
    return np.array(x.to_pylist(), float).reshape(-1, len(FEATURES)), np.array(y.to_pylist(), float), np.array(n.to_pylist(), float), np.array(loose.to_pylist(), bool)


def train(docs: DataFrame) -> tuple[Boosted, dict[str, float]]:
    """The trees and the threshold of each kind, from (doc_id, text)."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found = Counter((tuple(map(float, x)), y, z) for text in common.texts(part.column(0)) for x, y, z in examples(text))
        return common.batch_of({"x": ([list(x) for x, _, _ in found], pa.list_(pa.float64())), "y": ([y for _, y, _ in found], pa.int32()), "loose": ([z for _, _, z in found], pa.bool_()), "n": (list(found.values()), pa.int64())})

    found = common.map_rows(docs.select("text"), run, "x array<double>, y int, loose boolean, n long")
    found = common.cut(found.groupBy("x", "y", "loose").agg(F.sum("n").alias("n")))
    kinds, good, total = found.agg(F.count(F.lit(1)), F.sum(F.col("y") * F.col("n")), F.sum("n")).first()
    if not kinds:
        return Boosted(0.5), {}
    values = found.select(F.posexplode("x").alias("j", "value"), "n").groupBy("j", "value").agg(F.sum("n").alias("n")).orderBy("j", "value").toArrow()
    j, value, often = (values.column(c).to_numpy() for c in ("j", "value", "n"))
    cuts = []
    for f in range(len(FEATURES)):  # quantiles, the lower value of two
        up_to = np.cumsum(often[j == f])
        cuts.append(np.unique(value[j == f][np.searchsorted(up_to, np.floor(np.linspace(0, 1, BINS + 1)[1:-1] * (total - 1)), "right")]))

    if kinds <= GATHERED:
        x, y, n, _ = _arrays(found.toArrow())
        model = Boosted.fitted(lambda fn: fn(x, y, n), cuts, good / total)
    else:

        def sums(fn) -> np.ndarray:
            def part_sums(batches):
                for batch in batches:
                    own = fn(*_arrays(batch)[:3])
                    yield common.batch_of({"shape": ([list(own.shape)], pa.list_(pa.int32())), "v": ([own.tobytes()], pa.binary())})

            rows = found.mapInArrow(part_sums, "shape array<int>, v binary").toLocalIterator()
            return sum(np.frombuffer(r.v).reshape(r.shape) for r in rows)

        model = Boosted.fitted(sums, cuts, good / total)

    def scored(batches):
        for batch in batches:
            x, y, n, loose = _arrays(batch)
            score = np.rint(model.score(x) * SCORES)
            yield common.batch_of({"kind": (x[loose, 0].astype(np.int32), pa.int32()), "score": (score[loose].astype(np.int64), pa.int64()), "n": (n[loose].astype(np.int64), pa.int64()), "good": ((n * y)[loose].astype(np.int64), pa.int64())})

    rows = found.mapInArrow(scored, "kind int, score long, n long, good long").groupBy("kind", "score").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).orderBy("kind", F.desc("score")).toArrow()
    own_kind, score, n, good = (rows.column(c).to_numpy() for c in ("kind", "score", "n", "good"))
    limits = {}
    for i, kind in enumerate(KINDS):
        own = own_kind == i
        if n[own].sum() >= 20:
            enough = np.flatnonzero(np.cumsum(good[own]) >= PRECISION * np.cumsum(n[own]))
            if len(enough):
                down = np.append(score[own], 0) / SCORES
                limits[kind] = max(0.5, float(down[enough[-1]] + down[enough[-1] + 1]) / 2)
    return model, limits


def spans_of(text: str, model: Boosted, limits: dict[str, float]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by start and then kind."""
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    base, more, _ = proposals(text)
    kept = list(base)
    if more and limits:
        p = model.score(np.array([describe(text, x) for x in more], float))
        taken = Taken(len(text), base)
        for i in np.argsort(-p, kind="stable"):
            kind = more[i][0]
            if kind in limits and p[i] >= limits[kind] and taken.free(more[i]):
                kept.append(more[i])
                taken.take(more[i])
    return sorted(base, key=order), sorted(kept, key=order)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """`text` with each span (overlapping ones as one, named by the first) replaced by its kind in brackets."""
    out, at = [], 0
    for kind, s, e in spans:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def annotate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts of base spans, base_sha256, spans, n_added, n_spans, redacted) of every document."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model, limits = train(docs)
    text_of = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in common.texts(part.column(1)):
            base, kept = spans_of(text, model, limits)
            rows.append(([sum(k == x for k, _, _ in base) for x in BASE_KINDS], hashlib.sha256(text_of(base).encode()).hexdigest(), text_of(kept), len(kept) - len(base), redact(text, kept)))
        counts = {f"n_{k}": ([r[0][i] for r in rows], pa.int64()) for i, k in enumerate(BASE_KINDS)}
        return common.batch_of({"doc_id": (part.column(0), None), **counts, "base_sha256": ([r[1] for r in rows], pa.string()), "spans": ([r[2] for r in rows], pa.string()), "n_added": ([r[3] for r in rows], pa.int64()), "n_spans": ([sum(r[0]) + r[3] for r in rows], pa.int64()), "redacted": ([r[4] for r in rows], pa.string())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.map_rows(docs, run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long, redacted string")


def redacted(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """`docs` with their spans taken out of `text_col`; a null text stays null."""
    model, limits = train(docs.select("doc_id", F.col(text_col).alias("text")))

    def run(part: pa.RecordBatch) -> dict[str, pa.Array]:
        own = part.column(part.schema.get_field_index(text_col)).to_pylist()
        return {text_col: pa.array([t and redact(t, spans_of(t, model, limits)[1]) for t in own], pa.string())}

    return common.add_columns(docs, run, f"`{text_col}` string", text_col).select(docs.columns)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate(common.table(spark, sf_dir, "documents")).drop("redacted")
