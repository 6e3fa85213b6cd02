"""Personal data by weak supervision: labelers vote on candidate spans, EM estimates their reliabilities, a classifier decides."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.llm.common import give_back, lean

#: Kinds in output order and the base patterns of the first four (for an email, the part from the @ on). The
#: look-behind of IP changes no match, but keeps a long run of digits from being read again from each of its digits.
KINDS = ["email", "ip", "card", "phone", "secret", "iban", "national"]
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Looser forms, candidates only: a labeler's vote decides on them.
SPELT = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+ ?(?:(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]+(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]+)+"
    r"|(?:\(at\)|\[at\]) ?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
)
LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])")
SECRET = re.compile(
    r"\bAKIA[0-9A-Z]{16}\b|\b[0-9a-fA-F]{32,64}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b|\bsk-[A-Za-z0-9_-]{20,}|\bxox[abprs]-[A-Za-z0-9-]{10,}"
    r"|\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"
)
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: What a text without digits needs for a candidate: an @, or one of these for a spelt email or a secret, or a long run of hex letters.
_DIGIT, _HEX = re.compile(r"[0-9]"), re.compile(r"[a-fA-F]{32}")
SPELT_SIGNS = ["dot", "(at)", "[at]"]
SECRET_SIGNS = ["AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox", "eyJ"]
#: Gazetteers: words that stand before such data, and usual ends of domains.
CUES = {
    "email": {"email", "mail", "e", "contact", "write", "reach", "correo", "courriel", "kontakt", "contacto", "schreiben", "to"},
    "ip": {"ip", "host", "server", "address", "addr", "from", "node", "ping", "gateway", "dns", "client"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit", "account", "karte", "kreditkarte", "tarjeta", "carte", "konto", "cuenta", "compte", "pay"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "cell", "telefon", "telefono", "teléfono", "téléphone", "handy", "móvil", "whatsapp", "dial", "ring"},
    "secret": {"token", "key", "secret", "password", "passwd", "pwd", "apikey", "api_key", "bearer", "auth", "credential", "credentials", "passwort", "clave"},
    "iban": {"iban", "account", "bank", "konto", "bic", "cuenta", "compte"},
    "national": {"ssn", "social", "security", "number", "insurance", "id", "national"},
}
ENDS = {"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "co", "ru", "cn", "us"}
LABELERS = 5
THRESHOLD = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Spans of the base patterns that pass their checks, and those of 12 to 19 digits that fail only the Luhn check."""
    found, failed = [], []
    at, done = text.find("@"), 0
    while at >= 0:
        # The local part is the longest run before the @ that the last match leaves; all its starts share the same domain.
        begin = at
        while begin > done and (c := text[begin - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            found.append(("email", begin, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return found, failed
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19:
            (found if luhn(digits) else failed).append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found, failed


def candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base): base spans, and looser ones that overlap none before them."""
    found, failed = base_spans(text)
    out = [(*x, True) for x in found]
    starts: list[int] = []  # of the stretches that base spans cover
    ends: list[int] = []
    for start, end in sorted(x[1:] for x in found):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    digits = _DIGIT.search(text) is not None
    patterns = [("phone", LOCAL_PHONE), ("iban", IBAN), ("national", NATIONAL)] if digits else []
    if digits or any(x in text for x in SECRET_SIGNS) or _HEX.search(text):
        patterns.append(("secret", SECRET))
    if any(x in text for x in SPELT_SIGNS):
        patterns.append(("email", SPELT))
    loose = [(kind, *m.span()) for kind, pattern in patterns for m in pattern.finditer(text)]
    if not (loose or failed):
        return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    done = 0
    for kind, start, end in sorted([*loose, *failed], key=lambda x: (x[1], KINDS.index(x[0]))):
        k = bisect_right(starts, start)
        if start >= done and (k == 0 or ends[k - 1] <= start) and (k == len(starts) or end <= starts[k]):
            done = end
            out.append((kind, start, end, False))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _checked(iban: str) -> bool:
    x = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def describe(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """The votes of the labelers (1 yes, -1 no, 0 abstains), then small features of the span's shape and its neighbours."""
    span, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 1]
    digits = _digits(span)
    if kind in ("card",):
        valid = 1 if luhn(digits) else -1
    elif kind == "email":
        valid = 1 if re.split(r"[^A-Za-z]", span)[-1].lower() in ENDS else 0
    elif kind == "secret":
        valid = 1 if len(set(span)) >= 10 else -1
    elif kind == "iban":
        valid = 1 if _checked(span) else -1
    elif kind == "national":
        valid = -1 if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else 1
    else:
        valid = 1 if 10 <= len(digits) <= 15 or kind == "ip" else 0
    cues = [w for w in re.split(r"[^\w]+", before.lower()) if w][-4:]
    gazetteer = 1 if CUES[kind] & set(cues) else 0
    apart = -1 if (before[-1:].isalnum() or after.isalnum() or after == "%") else 1
    if kind == "secret":
        shape = 1 if re.search(r"[0-9]", span) and re.search(r"[A-Za-z]", span) else -1
    elif kind == "email":
        shape = 1 if "@" in span else 0
    else:
        shape = -1 if len(set(digits)) <= 2 else (1 if kind in ("ip", "iban", "national") or len(digits) in (10, 11, 15, 16) else 0)
    votes = (1 if base else 0, valid, gazetteer, apart, shape)
    features = (min(3, len(span) // 8), int(any(c in span for c in " -().")), int(before[-1:] in "\"'=:" and before != ""), int(after in ".,;:!?" and after != ""))
    return (KINDS.index(kind), *votes, *features)


@dataclass
class Model:
    """reliabilities[labeler, truth, vote + 1] as EM found them, and the classifier's weights over one-hot columns."""

    prior: np.ndarray
    reliabilities: np.ndarray
    weights: np.ndarray

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-_columns(rows) @ self.weights))


#: Values of each described number: kind, votes, features.
_SPAN = [len(KINDS), *[3] * LABELERS, 4, 2, 2, 2]


def _columns(rows: np.ndarray) -> np.ndarray:
    parts = [np.ones((len(rows), 1))]
    for k, n in enumerate(_SPAN):
        parts.append(np.eye(n)[rows[:, k] + (1 if 1 <= k <= LABELERS else 0)])
    return np.concatenate(parts, axis=1)


def fit(rows: np.ndarray, counts: np.ndarray, rounds: int = 50) -> Model:
    """EM over the counts of distinct rows, then logistic regression on the posterior. All input is bounded: distinct rows only."""
    prior = np.full(len(KINDS), 0.7)
    reliable = np.full((LABELERS, 2, 3), 1 / 3)
    reliable[:, 1] = [0.15, 0.25, 0.6]
    reliable[:, 0] = [0.5, 0.3, 0.2]
    votes, kind = rows[:, 1 : 1 + LABELERS] + 1, rows[:, 0]
    yes = np.zeros(len(rows))
    for _ in range(rounds if len(rows) else 0):
        logs = [np.log(p) + np.log(reliable[np.arange(LABELERS), y][np.arange(LABELERS), votes]).sum(axis=1) for y, p in ((0, 1 - prior[kind]), (1, prior[kind]))]
        yes = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        for k in range(len(KINDS)):
            at = kind == k
            prior[k] = ((counts * yes)[at].sum() + 7) / (counts[at].sum() + 10)
        for y, w in ((0, counts * (1 - yes)), (1, counts * yes)):
            for j in range(LABELERS):
                seen = np.bincount(votes[:, j], weights=w, minlength=3) + (np.array([5, 3, 2.0]) if y == 0 else np.array([1.5, 2.5, 6]))
                reliable[j, y] = seen / seen.sum()
    x, share = _columns(rows), counts / max(1, counts.sum())
    weights = np.zeros(x.shape[1])
    for _ in range(30 if len(rows) else 0):
        p = 1 / (1 + np.exp(-x @ weights))
        slope = x.T @ (share * (yes - p)) - 1e-3 * weights
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(weights))
        weights = weights + np.linalg.solve(curve, slope)
    return Model(prior, reliable, weights)


def train(docs: DataFrame) -> Model:
    """Counts what the labelers say of all candidates of all documents and fits the model on these counts.

    The driver gets one row for each distinct description (at most the product of the few values of each number).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter(describe(t.as_py(), *c) for t in batch["text"] if t.is_valid for c in candidates(t.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.list_(pa.int8())), pa.array(list(seen.values()), pa.int64())], names=["described", "n"])

    counts = docs.select("text").mapInArrow(lean(run), "described array<tinyint>, n long")
    found = counts.groupBy("described").agg(F.sum("n").alias("n")).orderBy("described").collect()
    return fit(np.array([r["described"] for r in found], dtype=np.int64).reshape(-1, len(_SPAN)), np.array([r["n"] for r in found], dtype=np.float64))


def _joined(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in spans)


def mask(text: str, spans: list[tuple]) -> str:
    """text with each span replaced by its kind in brackets; of overlapping spans the first covers all."""
    if not spans:
        return text
    merged: list[list] = []
    for kind, start, end, *_ in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]))):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    cuts = [(0, 0), *((s, e) for _, s, e in merged), (len(text), len(text))]
    kept = [text[a:b] for (_, a), (b, _) in pairwise(cuts)]
    return "".join(k + m for k, m in zip(kept, [*(f"[{x[0].upper()}]" for x in merged), ""], strict=True))


ADDED = ["email", "card", "phone", "secret", "iban", "national"]
FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_added long, " + "".join(f"added_{k} long, " for k in ADDED) + "masked string"


def _decided(text: str, model: Model) -> list[tuple[str, int, int, bool]]:
    """Base spans, and the looser ones to which the classifier gives at least THRESHOLD."""
    spans = candidates(text)
    if all(x[3] for x in spans):
        return spans
    likely = model.probability(np.array([describe(text, *x) for x in spans]))
    return [x for x, p in zip(spans, likely, strict=True) if x[3] or p >= THRESHOLD]


def find(docs: DataFrame, model: Model, masked: bool = True) -> DataFrame:
    """One row for each row of docs: counts and digest of the base spans, all spans, how many the classifier added (of each kind too), and the masked text.

    Base spans always stay; looser candidates are added if the classifier gives them at least THRESHOLD. Offsets are code
    points. A null or empty text has no spans; masked is null where nothing is to be masked, or if it isn't asked for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [x.split() for x in FOUND.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for text in batch["text"]:
                text = text.as_py()
                spans = _decided(text, model) if text else []
                base = [x for x in spans if x[3]]
                n, added = Counter(x[0] for x in base), Counter(x[0] for x in spans if not x[3])
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                rows.append((*(n[k] for k in KINDS[:4]), digest, _joined(spans), len(spans), len(spans) - len(base), *(added[k] for k in ADDED), mask(text, spans) if masked and spans else None))
            kinds = [pa.string() if x[1] == "string" else pa.int64() for x in fields[1:]]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], names=[x[0] for x in fields])

    return docs.select("doc_id", "text").mapInArrow(lean(run), FOUND)


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """docs with each span replaced by its kind in brackets; other columns, and texts without spans, unchanged.

    Nulls stay null and empty texts empty. Only the text goes to Python and back.
    """

    @F.arrow_udf("string")
    def masked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array((mask(x, _decided(x, model)) if x else x for x in (y.as_py() for y in batch)), pa.string())
            give_back()

    return docs.withColumn("text", masked(F.col("text")))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find(docs, train(docs), masked=False).drop("masked")
