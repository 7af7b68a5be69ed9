"""Personal data by gradient-boosted candidates.

**Base spans** are found by fixed formats with checks (email, ip, card,
phone), leftmost and non-overlapping per kind; a match that fails its check is
dropped without a retry.  Base spans always stay.

**Candidates.**  High-recall generators propose further, overlapping spans:
written-out emails, numbers in groups that the base formats miss, national
ids, IBANs, IPv6 addresses, keys and passwords.  Gradient-boosted trees score
each one from its format and its context, told in one byte a feature.  They
learn from the candidates and base-format matches of all documents, labelled by what can be checked: digit checks,
address ranges, prefixes that issuers fix, and a naming word before it.  Scores
are calibrated (Platt) on a fifth of the documents left out of the fit (on spans left
out, if that leaves too few on a side), and per kind
the lowest threshold with ``precision`` on those is taken.  Of overlapping
accepted candidates the best scored stays; none may overlap a base span.

**Learning** is a Spark job: spans with equal features, label and part are
one row with their number; bins come from the counts of all their values, each
level of a tree from histograms summed over all rows, and calibration from
the numbers of spans by score, which is told in steps of 1 / 1024.  The driver
gets histograms, whose size does not depend on the table.

Offsets are code points, end exclusive.

Edge cases: NULL and empty texts have no spans.  If the spans have one label
only, nothing is added to the base spans.  Repeated rows are rows; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

TREES, DEPTH, RATE, BINS = 40, 3, 0.2, 32
STEPS = 1 << 24  # slopes are summed in these fractions
PRECISION = 0.98

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("email_text", "iban", "ipv6", "national_id", "number", "secret")
#: Order of kinds in listings.
KINDS = BASE_KINDS + ADDED_KINDS
#: The base formats.
BASE_PATTERNS = {
    "email": re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),  # after a local part of LOCAL_SIGNS
    "ip": re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+"),  # a match starts where its digits start
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The generators of further candidates.
GENERATORS = {
    "email_text": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}\s?(?:\(at\)|\[at\]|\{at\}|\sat\s)\s?[A-Za-z0-9-]{2,63}(?:\s?(?:\.|\(dot\)|\[dot\]|\sdot\s)\s?[A-Za-z]{2,24}){1,3}(?![A-Za-z])", re.I),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"),
    "ipv6": re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,7}(?![0-9A-Za-z:])"),
    "national_id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "number": re.compile(r"(?<![0-9A-Za-z+])\(?[0-9](?:[ ().\-/]{0,2}[0-9]){6,18}(?![0-9A-Za-z])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*[0-9])[A-Za-z0-9_+/-]{16,}={0,2}(?![A-Za-z0-9_+/=-])"),
}
#: Words before a span that name its kind.
NAMING = {
    "email_text": "mail contact reach", "iban": "iban account konto compte cuenta", "ipv6": "ip ipv6 address host",
    "national_id": "ssn social security id", "number": "phone tel telephone mobile call fax tél telefon teléfono móvil handy cell",
    "secret": "password passwd pwd token secret key apikey api_key bearer auth credential",
}
_NAMED = {k: re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, v.split())) + r")\w{0,3}\W{0,6}$", re.I) for k, v in NAMING.items()}
#: Prefixes that issuers of keys fix.
_ISSUED = re.compile(r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_|^xox[abprs]-|^sk[-_](?:live|test)?|^eyJ|^AIza")
CONTEXT = 32


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _base_check(kind: str, match: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in match.split("."))
    if kind == "card":
        d = digits_of(match)
        return 16 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 8 <= len(digits_of(match)) <= 15
    return True


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost local part, @ and domain; in time linear in the text, which a
    search from every sign of a long run would not be."""
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_SIGNS:
            start -= 1
        m = BASE_PATTERNS["email"].match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(spans that pass, matches that fail their check), by kind and start."""
    good, failed = [("email", a, b) for a, b in _emails(text)], []
    for kind, sign in (("ip", "."), ("card", ""), ("phone", "+")):
        if sign in text:
            for m in BASE_PATTERNS[kind].finditer(text):
                (good if _base_check(kind, m.group()) else failed).append((kind, m.start(), m.end()))
    return good, failed


def candidates(text: str) -> list[tuple[str, int, int]]:
    return [(kind, m.start(), m.end()) for kind, pattern in GENERATORS.items() for m in pattern.finditer(text)]


def checked(kind: str, span: str, before: str) -> bool:
    """Whether what can be checked says that a candidate is personal data."""
    d = digits_of(span)
    if kind in BASE_KINDS:
        return _base_check(kind, span)
    if kind == "email_text":
        return "(" in span or "[" in span or bool(_NAMED[kind].search(before))
    if kind == "iban":
        s = span.replace(" ", "")
        return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    if kind == "ipv6":
        return span.count(":") == 7 or "::" in span
    if kind == "national_id":
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    if kind == "number":
        return bool(_NAMED[kind].search(before)) or bool(re.fullmatch(r"\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}", span)) or bool(re.fullmatch(r"3[47][0-9]{2}([ -]?)[0-9]{6}\1[0-9]{5}", span)) and luhn(d)
    return bool(_ISSUED.match(span)) or bool(_NAMED[kind].search(before))


FEATURES = 18


def features(kind: str, text: str, start: int, end: int) -> list[float]:
    """Format and context of a span, for the trees: whole numbers up to 255."""
    span, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    n = end - start
    digits = sum("0" <= c <= "9" for c in span)
    letters = sum(c.isalpha() for c in span)
    upper = sum(c.isupper() for c in span)
    kinds = len(set(span))
    counts = [span.count(c) / n for c in set(span)]
    pattern = _NAMED.get(kind)
    values = [
        KINDS.index(kind), n, 255 * digits / n, 255 * letters / n, 255 * upper / n, 255 * (n - digits - letters) / n, 255 * kinds / n, -32 * sum(p * np.log2(p) for p in counts),
        digits, luhn(digits_of(span)) if digits else 0, bool(pattern and pattern.search(before)), bool(_ISSUED.match(span)),
        before[-1:].isalnum(), after[:1].isalnum(), before[-1:] in "=:\"'", sum("0" <= c <= "9" for c in before),
        255 * sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:])) / n, max(map(len, re.split(r"[^A-Za-z]+", span))),
    ]
    return [float(min(255, int(v))) for v in values]


class BoostedTrees:
    """Binary logistic boosting over quantile bins; trees as flat arrays."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, ridge: float = 1.0):
        self.n, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned, yes = self.binned(x), y.astype(np.int64)
        return self.boost(int(yes.sum()), int(len(y) - yes.sum()), lambda tree: self.slopes(binned, yes, 1 - yes, tree) / STEPS)

    def boost(self, yes: int, no: int, sums) -> BoostedTrees:
        """Grows all trees; ``sums(tree)`` gives slopes and bends of all rows by
        the tree's lowest nodes so far, feature and bin."""
        rate = np.clip(yes / (yes + no), 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        self.trees = []
        for _ in range(self.n):
            feature, cut = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for _ in range(self.depth):
                g, h = sums((feature, cut))
                gs, hs = np.cumsum(g, axis=2)[:, :, :-1], np.cumsum(h, axis=2)[:, :, :-1]
                all_g, all_h = g[:, :1].sum(axis=2, keepdims=True), h[:, :1].sum(axis=2, keepdims=True)
                gain = gs**2 / (hs + self.ridge) + (all_g - gs) ** 2 / (all_h - hs + self.ridge) - all_g**2 / (all_h + self.ridge)
                gain = gain.reshape(len(g), -1)
                best, node = gain.argmax(axis=1), np.arange(len(g))
                fine = gain[node, best] > 1e-6
                f, k = np.where(fine, best // (self.bins - 1), 0), np.where(fine, best % (self.bins - 1), 1 << 30)  # by default all go left
                feature, cut = np.append(feature, f), np.append(cut, k)
                left = [np.where(fine, part[node, f, np.minimum(k, self.bins - 2)], total[:, 0, 0]) for part, total in ((gs, all_g), (hs, all_h))]
            g, h = (np.stack([part, total[:, 0, 0] - part], axis=1).ravel() for part, total in zip(left, (all_g, all_h)))
            self.trees.append((feature, cut, self.rate * g / (h + self.ridge)))
        return self

    def slopes(self, binned: np.ndarray, yes: np.ndarray, no: np.ndarray, tree) -> np.ndarray:
        """Of rows that stand for so many spans of each label: slopes and bends by
        node, feature and bin, in whole steps, so that sums do not depend on order."""
        nodes, features = len(tree[0]) + 1, binned.shape[1]
        p = _probability(self._odds(binned))
        g, h = np.rint(STEPS * (yes * (1 - p) - no * p)), np.rint(STEPS * (yes + no) * p * (1 - p))
        spot = ((self._leaf(tree, binned)[:, None] * features + np.arange(features)) * self.bins + binned).ravel()
        size = nodes * features * self.bins
        return np.stack([np.bincount(spot, np.repeat(v, features), size) for v in (g, h)]).astype(np.int64).reshape(2, nodes, features, self.bins)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)], axis=1)

    def _leaf(self, tree, binned):
        """Place among the lowest nodes of a tree, or of its first levels."""
        node, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
        for _ in range((len(tree[0]) + 1).bit_length() - 1):
            node = 2 * node + 1 + (binned[rows, tree[0][node]] > tree[1][node])
        return node - len(tree[0])

    def _odds(self, binned: np.ndarray) -> np.ndarray:
        return self.start + sum((t[2][self._leaf(t, binned)] for t in self.trees), np.zeros(len(binned)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds in steps of 1 / 1024."""
        return np.rint(1024 * np.clip(self._odds(self.binned(x)), -32, 32)) / 1024


def _probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def platt(score: np.ndarray, yes: np.ndarray, no: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of calibrated log odds, by Newton steps; of each score
    the numbers of spans of both labels."""
    a, b = 1.0, 0.0
    high, low = (yes.sum() + 1) / (yes.sum() + 2), 1 / (no.sum() + 2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        w = (yes + no) * (p * (1 - p) + 1e-6)
        miss = yes * (high - p) + no * (low - p)
        slope = np.array([(miss * score).sum(), miss.sum()])
        bend = np.array([[(w * score * score).sum() + 1e-3, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-3]])
        a, b = np.array([a, b]) + np.linalg.solve(bend, slope)
    return float(a), float(b)


def found_spans(docs: DataFrame, with_text: bool) -> DataFrame:
    """One row per document: doc_id, text if asked for, all spans as binary (kind,
    start, end: three int64 each), n_base and n_failed (base matches come
    first, then those that failed, then candidates), codes (the features, a byte
    each) and marks (a byte each: bit 0 the label, 1 and 2 whether the document
    and whether the span is left for calibration)."""
    place = F.xxhash64(F.lit("train"), "doc_id", F.col("text").cast("string"))  # rows without doc_id are dealt apart
    names = ["doc_id", *["text"] * with_text, "spans", "n_base", "n_failed", "codes", "marks"]
    kinds = {"doc_id": "long", "text": "string", "n_base": "long", "n_failed": "long"}

    def run(batches):
        for batch in batches:
            for row in range(0, batch.num_rows, 1000):
                part = batch.slice(row, 1000)
                rows = []
                for h, text in zip(part.column(2).to_pylist(), part.column(1).to_pylist()):
                    text = text or ""
                    good, failed = base_spans(text)
                    spans = [*good, *failed, *candidates(text)]
                    marks = bytes(
                        checked(kind, text[a:b], text[max(0, a - CONTEXT) : a]) + 2 * (h % 5 == 0) + 4 * (crc32(f"{h}:{a}:{kind}".encode()) % 5 == 0) for kind, a, b in spans
                    )
                    codes = np.array([features(kind, text, a, b) for kind, a, b in spans]).astype(np.uint8)
                    rows.append((np.array([(KINDS.index(kind), a, b) for kind, a, b in spans], np.int64).tobytes(), len(good), len(failed), codes.tobytes(), marks))
                types = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[part.column(1)] * with_text, *columns], names)

    schema = ", ".join(f"{n} {kinds.get(n, 'binary')}" for n in names)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"), place.alias("h")).mapInArrow(run, schema)


def tally(found: DataFrame, most: int | None = None) -> DataFrame:
    """(key, n): the features and mark of spans, and how many have them.  With
    ``most``, of each document at most that many spans."""

    def run(batches):
        for batch in batches:
            keys = []
            for codes, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys.append(np.hstack([np.frombuffer(codes, np.uint8).reshape(-1, FEATURES), np.frombuffer(marks, np.uint8)[:, None]])[:most])
            if keys:
                rows, n = np.unique(np.concatenate(keys), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(n, pa.int64())], ["key", "n"])

    return found.where("length(marks) > 0").select("codes", "marks").mapInArrow(run, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _summed(rows: DataFrame, work) -> np.ndarray:
    """The sum of ``work(codes, marks, n)`` over all rows of a tally, each task's
    summed in the task; arrays of int64 of one shape."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, FEATURES + 1)
                part = work(keys[:, :-1], keys[:, -1], batch.column(1).to_numpy())
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([list(total.shape)], pa.list_(pa.int64()))], ["sums", "shape"])

    # As many sums reach the driver as there are cores, or twice that.
    few = rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)
    return sum(np.frombuffer(r.sums, np.int64).reshape(r["shape"]) for r in few.mapInArrow(run, "sums binary, shape array<long>").collect())


def learn(docs: DataFrame, train_spans: int | None = None, precision: float = PRECISION) -> dict | None:
    """Trees, calibration and thresholds from all documents; None if there is
    nothing to learn from.  A caller may bound the spans with ``train_spans``:
    each document then gives the same number at most."""
    return learn_found(cut(found_spans(docs, False)), train_spans, precision)


def learn_found(found: DataFrame, train_spans: int | None = None, precision: float = PRECISION) -> dict | None:
    rows = cut(tally(found, None if train_spans is None else max(1, train_spans // max(1, found.where("length(marks) > 0").count()))))
    if rows.isEmpty():
        return None
    by_mark = _summed(rows, lambda codes, marks, n: np.bincount(marks, n, 8).astype(np.int64)).reshape(2, 2, 2)  # span left, document left, label

    def few(yes, no):
        return min(yes[0], no[0]) < 10 or min(yes[1], no[1]) < 3

    for bit, counts in ((2, by_mark.sum(axis=0)), (4, by_mark.sum(axis=1))):  # few documents: spans of all are left
        if not few(counts[:, 1], counts[:, 0]):
            break
    else:
        return None
    no, yes = counts[0].tolist()

    def values(codes, marks, n):
        fit = marks & bit == 0
        spot = np.arange(FEATURES) * 256 + codes[fit]
        return np.bincount(spot.ravel(), np.repeat(n[fit], FEATURES), FEATURES * 256).astype(np.int64)

    trees = BoostedTrees()
    upto = np.cumsum(_summed(rows, values).reshape(FEATURES, 256), axis=1)
    wanted = np.arange(1, trees.bins) / trees.bins * (yes + no)
    trees.edges = [np.unique(np.searchsorted(c, wanted)).astype(float) for c in upto]

    def sums(tree):
        def work(codes, marks, n):
            fit = marks & bit == 0
            label = marks[fit] & 1
            return trees.slopes(trees.binned(codes[fit]), n[fit] * label, n[fit] * (1 - label), tree)

        return _summed(rows, work) / STEPS

    trees.boost(yes, no, sums)

    def scored(batches):
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, FEATURES + 1)
            keys, n = keys[keys[:, -1] & bit > 0], batch.column(1).to_numpy()[keys[:, -1] & bit > 0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[:, 0].astype(np.int64)), pa.array(trees.score(keys[:, :-1])), pa.array(n * (keys[:, -1] & 1)), pa.array(n * (1 - (keys[:, -1] & 1)))], ["kind", "score", "yes", "no"]
            )

    # At most one row a kind and step of the score.
    got = rows.mapInArrow(scored, "kind long, score double, yes long, no long").groupBy("kind", "score").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).toPandas()
    got = got.sort_values(["score", "kind"])
    score, right, wrong = (got[c].to_numpy(float) for c in ("score", "yes", "no"))
    slope, offset = platt(score, right, wrong)
    p = _probability(slope * score + offset)
    thresholds = {}
    for i, kind in enumerate(KINDS):
        mine = np.flatnonzero(got["kind"].to_numpy() == i)
        mine = mine[np.argsort(-p[mine], kind="stable")]
        every = right[mine] + wrong[mine]
        fine = np.flatnonzero(np.cumsum(right[mine]) >= precision * np.cumsum(every))
        # A kind without enough cases to judge is taken only when fairly sure.
        thresholds[kind] = max(0.5, float(p[mine][fine[-1]])) if every.sum() >= 20 and len(fine) else 0.9
    return {"trees": trees.__dict__, "slope": slope, "offset": offset, "thresholds": thresholds}


def accept(text: str, base: list[tuple[str, int, int]], model: dict, trees: BoostedTrees) -> list[tuple[str, int, int]]:
    """Accepted candidates: above their kind's threshold, best first, without overlaps."""
    found = candidates(text)
    return chosen(found, np.array([features(k, text, a, b) for k, a, b in found]), base, model, trees)


def chosen(found: list[tuple[str, int, int]], x: np.ndarray, base: list[tuple[str, int, int]], model: dict, trees: BoostedTrees) -> list[tuple[str, int, int]]:
    """Of candidates with their features, the accepted ones."""
    if not found:
        return []
    p = _probability(model["slope"] * trees.score(x) + model["offset"])
    first: list[int] = []  # what is taken, as intervals apart from each other
    end: list[int] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if end and a < end[-1]:
            end[-1] = max(end[-1], b)
        else:
            first.append(a)
            end.append(b)
    out = []
    for i in sorted(range(len(found)), key=lambda i: (-p[i], found[i][1], found[i][0])):
        kind, a, b = found[i]
        at = bisect_right(end, a)  # the first interval that ends behind the span's start
        if p[i] >= model["thresholds"][kind] and (at == len(first) or b <= first[at]):
            first.insert(at, a)
            end.insert(at, b)
            out.append((kind, a, b))
    return out


def listing(spans: list[tuple[str, int, int]]) -> str:
    ordered = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in ordered)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; spans that overlap are
    replaced as one, under the first's kind."""
    out, at, upto = [], 0, -1
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= upto:
            out += [text[at:a], f"[{kind.upper()}]"]
        upto = max(upto, b)
        at = upto
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, redacted: bool = True, **bounds) -> DataFrame:
    """One row per document: doc_id, n_<kind> of the base kinds, base_sha256,
    spans and, if asked for, the redacted text."""
    found = cut(found_spans(docs, redacted))  # texts are searched once
    model = docs.sparkSession.sparkContext.broadcast(learn_found(found, **bounds))  # bounded: the trees
    names = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", *["redacted"] * redacted]
    kinds = {"base_sha256": "string", "spans": "string", "redacted": "string"}

    def run(batches):
        learned = model.value
        trees = BoostedTrees()
        if learned:
            trees.__dict__.update(learned["trees"])
        for batch in batches:
            for row in range(0, batch.num_rows, 1000):
                part = batch.slice(row, 1000).to_pydict()
                texts = part.get("text") or [""] * len(part["doc_id"])
                rows = []
                for text, places, good, failed, codes in zip(texts, part["spans"], part["n_base"], part["n_failed"], part["codes"]):
                    every = [(KINDS[k], a, b) for k, a, b in np.frombuffer(places, np.int64).reshape(-1, 3).tolist()]
                    x = np.frombuffer(codes, np.uint8).reshape(-1, FEATURES).astype(float)
                    base = every[:good]
                    spans = base + (chosen(every[good + failed :], x[good + failed :], base, learned, trees) if learned else [])
                    counts = [sum(s[0] == k for s in base) for k in BASE_KINDS]
                    rows.append([*counts, hashlib.sha256(listing(base).encode()).hexdigest(), listing(spans), *[redact(text or "", spans)] * redacted])
                columns = [pa.array([r[i] for r in rows], pa.int64() if i < 4 else pa.string()) for i in range(len(names) - 1)]
                yield pa.RecordBatch.from_arrays([pa.array(part["doc_id"], pa.int64()), *columns], names)

    schema = ", ".join(f"{n} {kinds.get(n, 'long')}" for n in names)
    return found.select("doc_id", *["text"] * redacted, "spans", "n_base", "n_failed", "codes").mapInArrow(run, schema)
