"""Toxicity: words are restored by a noisy channel, then the restored text is scored.

Leetspeak, spacing and repetition make each observed token a lattice: a sign may stand for some letters, for nothing or for the
end of a word, and a repeated letter may be one too many. Viterbi finds the most likely reading under a character language
model of all documents. Labels then tell which restored words mark toxic documents, and a logistic regression over how
strongly a text has such words gives the score.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.llm.common import mix64, range_hashes, slices, staged
from jobscope.llm.langid import SLICE_CHARS, _tables

#: Letters that a sign can stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "aeiou",
}
#: Letters of other scripts that look like these.
ALIKE = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "α": "a", "ο": "o", "ν": "v", "ι": "i"}

#: Costs in nats: of a sign read as a letter, a mask (* or #) read as a vowel, a sign left out, a sign that ends a word, a digit
#: that does; of a letter dropped from two and from more alike, and of keeping one of more than two alike; of the end of a word
#: at one of several equal signs that stand between single characters, more than at another sign.
SIGN, MASK, OUT, END, DIGIT_END, DROP_TWO, DROP_MORE, KEEP_MORE, SPACED_END = 0.7, 2.0, 1.0, 1.0, 4.0, 4.0, 0.3, 2.0, 2.5

SYMBOLS = 28  # 0 the edge of a word, 1 to 26 the letters a to z with accents taken off, 27 any other letter
CONTEXTS = SYMBOLS**3
#: Readings kept at a step; more than there are contexts in any lattice of repeated letters, and of nearly all others.
BEAM = {2: 8, 7: 32}
CACHE = 300_000
COUNTS = "cell long, n long"
#: A word's hash and those of its first five and four letters; what a feature has to show at least, in nats, and at how many standard deviations.
PARTS, SHOWN, SURE = ["word", "five", "four"], 1.0, 2.0


@cache
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: symbol of the model (-1: no letter), class (0 letter, 1 digit, 2 sign, 3 other), whether it goes at a word's ends."""
    kind, lower, _, _ = _tables()
    symbol = np.where(kind > 0, 27, -1).astype(np.int8)
    for c in [*range(0x41, 0x250), *range(0x1E00, 0x1F00), *range(0xFF21, 0xFF5B)]:
        base = unicodedata.normalize("NFKD", chr(c))[0].lower()
        if kind[c] and "a" <= base <= "z":
            symbol[c] = ord(base) - 96
    symbol[ord("ß")] = 19
    for look, letter in ALIKE.items():
        symbol[ord(look)] = ord(letter) - 96
    group = np.where(symbol >= 0, 0, 3).astype(np.uint8)
    for sign in LEET:
        group[ord(sign)] = 1 if sign.isdigit() else 2
    trim = (group == 3) | np.isin(np.arange(len(group)), [ord(x) for x in "!*#¡"])
    return symbol, group, trim


@cache
def _options() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each sign's place in a list (0: letters themselves, 1: other signs, 2: white space, 3 on: LEET) the readings: symbol (-1 nothing, 0 end of word, -2 none) and cost."""
    rows: list[list[tuple[int, float]]] = [[], [(-1, OUT), (0, END)], [(-1, OUT), (0, END / 2)]]
    place = np.ones(0x110000, dtype=np.uint8)
    for sign, letters in LEET.items():
        place[ord(sign)] = len(rows)
        cost = MASK if len(letters) > 2 else SIGN
        rest = [(0, DIGIT_END)] if sign.isdigit() else [(-1, OUT * 1.5), (0, END * 1.5)]
        rows.append([*[(ord(x) - 96, cost) for x in letters], *rest])
    for c in (0x20, *range(9, 14)):
        place[c] = 2
    place[_letters()[0] >= 0] = 0
    read = np.full((len(rows), 7), -2, dtype=np.int64)
    price = np.full((len(rows), 7), np.inf)
    for k, row in enumerate(rows):
        for j, (s, x) in enumerate(row):
            read[k, j], price[k, j] = s, x
    return place, read, price


class Tokens:
    """Tokens of several texts: stretches without white space, trimmed, or of at least three single characters with one gap between each two."""

    def __init__(self, texts: list[str]) -> None:
        _, lower, hashes, _ = _tables()
        symbol, group, trim = _letters()
        self.codes = codes = lower[np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "replace"), dtype=np.uint32)]
        gap = np.concatenate([[True], (codes == 0x20) | ((codes >= 9) & (codes <= 13))])
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        starts, ends = edges[0::2].copy(), edges[1::2].copy()
        self.offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        same = np.concatenate([[False], codes[1:] == codes[:-1], [False, False]])
        thrice = (same[:-2] & same[1:-1])[: len(codes)] | np.concatenate([[False], (same[:-2] & same[1:-1])[: len(codes) - 1]])
        thrice |= np.concatenate([(same[:-2] & same[1:-1])[1 : len(codes)], [False]])
        loose = trim[codes] | ((group[codes] == 2) & thrice)
        first = loose & ~((codes == 0x21) & ~thrice)  # an exclamation mark ends sentences, so before a word it may be a letter
        for at, step, goes in ((starts, 1, first), (ends, -1, loose)):
            while len(go := np.flatnonzero((ends > starts) & goes[np.minimum(at - (step < 0), len(codes) - 1)])):
                at[go] += step
        full = ends > starts
        starts, ends = starts[full], ends[full]
        doc = np.searchsorted(self.offsets, starts, side="right") - 1
        # Runs of single characters that aren't all the same become one token, white space included.
        one = (ends - starts == 1) & (group[codes[starts]] < 3)
        joins = np.zeros(len(starts), dtype=bool)
        joins[1:] = one[1:] & one[:-1] & (starts[1:] - ends[:-1] == 1) & (doc[1:] == doc[:-1])
        changes = joins.copy()
        changes[1:] &= codes[starts[1:]] != codes[starts[:-1]]
        run = np.cumsum(~joins)
        spaced = (np.bincount(run)[run] >= 3) & (np.bincount(run, weights=changes)[run] > 0)
        head = ~(joins & spaced)
        last = np.concatenate([np.flatnonzero(head)[1:], [len(starts)]])[: int(head.sum())] - 1
        self.starts, self.ends, self.doc = starts[head], ends[last], doc[head]
        letters = np.concatenate([[0], np.cumsum(symbol[codes] >= 0)])
        twice = np.concatenate([[0], np.cumsum(same[: len(codes)] & (symbol[codes] >= 0))])
        size = self.ends - self.starts
        n_letters = letters[self.ends] - letters[self.starts]
        repeats = np.where(size > 0, twice[self.ends] - twice[np.minimum(self.starts + 1, self.ends)], 0)
        #: 0: no word (no letter), 1: a word as it is, 2: a word with repeated letters, 7: with signs.
        self.kind = np.where(n_letters == 0, 0, np.where(n_letters < size, 7, np.where(repeats > 0, 2, 1)))
        self.hashes = range_hashes(hashes[codes], self.starts, self.ends)


def grams(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Cells (context of three symbols, next symbol) of each letter and the end of words."""
    symbol = _letters()[0]
    n = ends - starts
    shift = np.cumsum(n + 4) - (n + 4)
    flat = np.zeros(int((n + 4).sum()), dtype=np.int64)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    flat[np.repeat(shift + 3, n) + at] = symbol[codes[np.repeat(starts, n) + at]]
    cell = ((flat[:-3] * SYMBOLS + flat[1:-2]) * SYMBOLS + flat[2:-1]) * SYMBOLS + flat[3:]
    inside = np.arange(len(cell)) - np.repeat(shift, n + 4)[: len(cell)]
    return cell[inside <= np.repeat(n, n + 4)[: len(cell)]]


def language_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities, contexts x symbols, from the plain words of every text of docs; a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CONTEXTS * SYMBOLS, dtype=np.int64)
        for batch in batches:
            for texts in _pieces(batch):
                t = Tokens(texts)
                plain = (t.kind == 1) | (t.kind == 2)
                total += np.bincount(grams(t.codes, t.starts[plain], t.ends[plain]), minlength=len(total)) if plain.any() else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    cells = docs.where("text is not null").select("text").mapInArrow(count, COUNTS).groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(CONTEXTS * SYMBOLS)
    n[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return smoothed(n.reshape(CONTEXTS, SYMBOLS))


def smoothed(n: np.ndarray, weight: float = 5.0) -> np.ndarray:
    """Each order is the prior of the next, with the weight of that many letters."""
    cube = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS, SYMBOLS)
    p = (cube.sum(axis=(0, 1, 2)) + 1) / (cube.sum() + SYMBOLS)
    for axes in ((0, 1), (0,), ()):
        held = cube.sum(axis=axes) if axes else cube
        p = (held + weight * p) / (held.sum(axis=-1, keepdims=True) + weight)
    return np.log(p.reshape(CONTEXTS, SYMBOLS)).astype(np.float32)


def _pieces(batch: pa.RecordBatch) -> Iterator[list[str]]:
    column = batch["text"]
    for part in slices(pc.fill_null(pc.utf8_length(column), 0).to_pylist(), SLICE_CHARS):
        yield [x or "" for x in column.slice(part.start, part.stop - part.start).to_pylist()]


def decode(model: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> list[np.ndarray]:
    """The most likely reading of each token, as code points with spaces between words. Viterbi over all tokens in step.

    States are contexts of the model; readings in the same context are merged into the better one. width: readings of a
    sign at most (2: letters only, else 7).
    """
    symbol, beam = _letters()[0], BEAM[width]
    place, read, price = _options()
    order = np.argsort(starts - ends, kind="stable")
    first, n = starts[order], (ends - starts)[order]
    count = len(first)
    context = np.zeros((count, beam), dtype=np.int64)
    value = np.full((count, beam), -np.inf)
    value[:, 0] = 0
    came: list[tuple[np.ndarray, np.ndarray]] = []
    for step in range(int(n.max(initial=0))):
        live = int(np.searchsorted(-n, -step, side="left"))
        at = first[:live] + step
        seen = codes[at]
        kind = place[seen]
        emit, cost = read[kind][:, :width].copy(), price[kind][:, :width].copy()
        letter = kind == 0
        emit[letter, 0], cost[letter, 0] = symbol[seen[letter]], 0.0
        back = np.zeros(live, dtype=bool) if step == 0 else codes[at - 1] == seen
        ahead = (step + 1 < n[:live]) & (codes[np.minimum(at + 1, len(codes) - 1)] == seen)
        earlier = back & (step > 1) & (codes[np.maximum(at - 2, 0)] == seen) if step > 1 else np.zeros(live, dtype=bool)
        more = back & (ahead | earlier)
        again = letter & back
        emit[again, 1], cost[again, 1] = -1, np.where(more[again], DROP_MORE, DROP_TWO)
        cost[again & more, 0] = KEEP_MORE
        left = codes[np.maximum(at - 2, 0)] == seen if step > 1 else np.zeros(live, dtype=bool)
        right = (step + 2 < n[:live]) & (codes[np.minimum(at + 2, len(codes) - 1)] == seen)
        cost += np.where((emit == 0) & ((left | right) & (kind > 0))[:, None], SPACED_END, 0.0)
        v, c = value[:live], context[:live]
        take = emit[:, None, :]
        gain = np.where(take >= 0, model[c[:, :, None], np.maximum(take, 0)], 0.0)
        score = (v[:, :, None] + gain - cost[:, None, :]).reshape(live, -1)
        # The end of a word starts the next one.
        then = np.where(take > 0, (c[:, :, None] * SYMBOLS + take) % CONTEXTS, np.where(take == 0, 0, c[:, :, None])).reshape(live, -1)
        row = np.arange(live)[:, None]
        by = np.lexsort((-score, then), axis=1)
        score, then = score[row, by], then[row, by]
        score[:, 1:][then[:, 1:] == then[:, :-1]] = -np.inf
        best = np.argpartition(-score, beam - 1, axis=1)[:, :beam] if score.shape[1] > beam else np.arange(score.shape[1])[None, :].repeat(live, 0)
        value[:live], context[:live] = score[row, best], then[row, best]
        source = by[row, best]
        slot, choice = source // width, source % width
        came.append((slot.astype(np.uint8), emit[row, choice].astype(np.int8)))
    value = value + model[context, 0]
    now = value.argmax(axis=1)
    chosen: list[list[int]] = [[] for _ in range(count)]
    for step in range(len(came) - 1, -1, -1):
        slot, emit = came[step]
        live = len(slot)
        row = np.arange(live)
        at = now[:live]
        got = emit[row, at]
        seen = codes[first[:live] + step]
        put = np.where(got < 0, 0, np.where(got == 0, 0x20, np.where(place[seen] == 0, seen, got + 96)))
        for k, x in enumerate(put.tolist()):
            if x:
                chosen[k].append(x)
        now[:live] = slot[row, at]
    out: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * count
    for k, x in zip(order.tolist(), chosen, strict=True):
        out[k] = np.array(x[::-1], dtype=np.uint32)
    return out


class Restorer:
    """Restores tokens with a language model; readings of tokens are kept between slices, up to CACHE of them."""

    def __init__(self, model: np.ndarray) -> None:
        self.model, self.known = model, {}

    def read(self, t: Tokens) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which tokens are lattices, and the reading of each of them."""
        at = np.flatnonzero(t.kind > 1)
        keys = t.hashes[at].tolist()
        if len(self.known) > CACHE:
            self.known = {}
        for width in BEAM:
            new = {k: i for k, i in zip(keys, at.tolist(), strict=True) if t.kind[i] == width and k not in self.known}
            if new:
                chosen = np.fromiter(new.values(), dtype=np.int64)
                for part in range(0, len(chosen), 4096):
                    some = chosen[part : part + 4096]
                    for i, reading in zip(some.tolist(), decode(self.model, t.codes, t.starts[some], t.ends[some], width), strict=True):
                        self.known[int(t.hashes[i])] = reading
        return at, [self.known[k] for k in keys]


def _words(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Features of words (rows): hashes of the whole word and of its first five and four letters; 0 where it isn't longer."""
    hashes = _tables()[2]
    values, n = hashes[codes], ends - starts
    out = np.zeros((len(starts), 3), dtype=np.uint64)
    out[:, 0] = range_hashes(values, starts, ends)
    for c, size in ((1, 5), (2, 4)):
        long = n > size
        out[long, c] = mix64(range_hashes(values, starts[long], starts[long] + size) + np.uint64(size))
    return out


def features(restorer: Restorer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of the restored words of several texts, doubled letters as one: the text of each, and its three features."""
    t = Tokens(texts)
    plain = t.kind == 1
    at, readings = restorer.read(t)
    n = np.array([len(x) + 1 for x in readings], dtype=np.int64)
    codes = np.concatenate([y for x in readings for y in (x, [0x20])]).astype(np.uint32) if readings else np.zeros(0, dtype=np.uint32)
    owners = np.repeat(t.doc[at], n)
    single = np.concatenate([[True], codes[1:] != codes[:-1]])[: len(codes)]  # so a doubled letter makes no other word
    codes, owners = codes[single], owners[single]
    edge = np.concatenate([[True], codes == 0x20])
    cut = np.flatnonzero(edge[1:] != edge[:-1])
    starts, ends = cut[0::2], cut[1::2]
    return np.concatenate([t.doc[plain], owners[starts]]), np.concatenate([_words(t.codes, t.starts[plain], t.ends[plain]), _words(codes, starts, ends)])


def restored(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """doc_id, text, n_restored: texts with their changed tokens replaced by the reading, in lower case; null stays null with 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for batch in batches:
            for part in slices(pc.fill_null(pc.utf8_length(batch["text"]), 0).to_pylist(), SLICE_CHARS):
                piece = batch.slice(part.start, part.stop - part.start)
                given = piece["text"].to_pylist()
                texts = [x or "" for x in given]
                t = Tokens(texts)
                pieces: list[list[str]] = [[] for _ in texts]
                done = [0] * len(texts)
                for i, reading in zip(*restorer.read(t), strict=True):
                    a, b, k = int(t.starts[i]), int(t.ends[i]), int(t.doc[i])
                    if b - a != len(reading) or (t.codes[a:b] != reading).any():
                        a, b = a - int(t.offsets[k]), b - int(t.offsets[k])
                        pieces[k] += [texts[k][done[k] : a], "".join(map(chr, reading.tolist()))]
                        done[k] = b
                out = [None if x is None else "".join([*pieces[k], x[done[k] :]]) for k, x in enumerate(given)]
                yield pa.RecordBatch.from_arrays([piece["doc_id"], pa.array(out, pa.string()), pa.array([len(x) // 2 for x in pieces], pa.int64())], names=["doc_id", "text", "n_restored"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, text string, n_restored long")


@dataclass
class Model:
    """letters: the language model; words: sorted features that mark toxic texts, with weights; line: coefficients of the score."""

    letters: np.ndarray
    words: np.ndarray
    weights: np.ndarray
    line: np.ndarray


def _bounds(n1: np.ndarray, n0: np.ndarray, total1: float, total0: float) -> np.ndarray:
    """Log odds ratios of features, less SURE standard deviations; 0 where that is under SHOWN."""
    a, b, c, d = n1 + 0.5, np.maximum(total1 - n1, 0) + 0.5, n0 + 0.5, np.maximum(total0 - n0, 0) + 0.5
    out = np.log(a / b) - np.log(c / d) - SURE * np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return np.where(out >= SHOWN, out, 0.0)


def _summary(doc: np.ndarray, weight: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each text, from the weights of its marking words: the largest two, how many and their sum (logs), and its number of words (log)."""
    out = np.zeros((len(size), 6))
    out[:, 0] = 1
    order = np.lexsort((-weight, doc))
    doc, weight = doc[order], weight[order]
    head = np.flatnonzero(np.diff(doc, prepend=-1) != 0)
    out[doc[head], 1] = weight[head]
    second = head + 1
    second = second[second < len(doc)]
    second = second[doc[second] == doc[second - 1]]
    out[doc[second], 2] = weight[second]
    out[:, 3] = np.log1p(np.bincount(doc, minlength=len(size)))
    out[:, 4] = np.log1p(np.bincount(doc, weights=weight, minlength=len(size)))
    out[:, 5] = np.log1p(size)
    return out


def _look(words: np.ndarray, weights: np.ndarray, doc: np.ndarray, found: np.ndarray, n_docs: int) -> np.ndarray:
    """_summary of texts, from the features of their words; a word weighs as its heaviest feature."""
    size = np.bincount(doc, minlength=n_docs)
    if not len(words):
        return _summary(np.zeros(0, dtype=np.int64), np.zeros(0), size)
    at = np.minimum(np.searchsorted(words, found), len(words) - 1)
    weight = np.where(words[at] == found, weights[at], 0.0).max(axis=1, initial=0.0)
    hit = weight > 0
    return _summary(doc[hit], weight[hit], size)


def _regression(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton's method; the constant has no penalty."""
    line = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * max(w.sum(), 1.0) / 100)
    penalty[0] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        hessian = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, x.T @ (w * (y - p)) - penalty * line)
        line = line + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return line


def _sketch(shared, docs: DataFrame) -> DataFrame:
    """doc_id, toxic, kin (texts with nearly the same words mostly have the same), n_words and the distinct words of labelled texts with their beginnings."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for batch in batches:
            done = 0
            for texts in _pieces(batch):
                doc, found = features(restorer, texts)
                order = np.argsort(doc, kind="stable")
                doc, found = doc[order], found[order]
                first = np.searchsorted(doc, np.arange(len(texts) + 1))
                kin, sizes, each = [], [], []
                for k in range(len(texts)):
                    own = found[first[k] : first[k + 1]]
                    kin.append(int(mix64(own[:, 0] ^ np.uint64(77)).min(initial=np.iinfo(np.uint64).max).view(np.int64)))
                    sizes.append(len(own))
                    each.append(own[np.unique(own[:, 0], return_index=True)[1]].view(np.int64))
                piece = batch.slice(done, len(texts))
                done += len(texts)
                yield pa.RecordBatch.from_arrays([piece["toxic"], pa.array(kin, pa.int64()), pa.array(sizes, pa.int64()), *[pa.array([x[:, c] for x in each], pa.list_(pa.int64())) for c in range(3)]], names=["toxic", "kin", "n_words", *PARTS])

    return docs.select("text", "toxic").mapInArrow(work, "toxic int, kin long, n_words long, " + ", ".join(f"{c} array<long>" for c in PARTS))


def train(docs: DataFrame, labels: DataFrame, per_label: int = 10_000, most_words: int = 50_000) -> Model:
    """The character model is counted over all docs. What is toxic is learned from labels (doc_id, toxic) of docs.

    Of each label about per_label rows are used, drawn by a hash of doc_id, and at most most_words words and as many beginnings,
    those in the most toxic texts. Texts that share their least word hash count as one. Words are weighed on one half of the texts and
    the regression is fitted on the other, either way round. A label that isn't 0 or 1 isn't used, and of several labels of a
    document the largest is. Without rows of both labels the score of every text is the share of toxic rows, 0 without any.
    """
    spark = docs.sparkSession
    letters = language_model(docs)
    shared = spark.sparkContext.broadcast(letters)
    marked = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    totals = dict(map(tuple, marked.groupBy("toxic").count().collect()))
    share = F.lit(0)
    for x, n in totals.items():
        share = F.when(F.col("toxic") == x, int(min(1.0, per_label / n) * 1_000_000)).otherwise(share)
    drawn = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)  # about 2 * per_label rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")
    rows = staged(_sketch(shared, texts), "labelled")
    kin = rows.groupBy("kin", "toxic").agg((1 / F.count("*")).alias("w"))
    rows = staged(rows.join(F.broadcast(kin), ["kin", "toxic"]), "labelled")  # no more rows than texts drawn
    fold = F.pmod(F.xxhash64("kin"), F.lit(2))
    sums = {(f, y): F.sum(F.when((fold == f) & (F.col("toxic") == y), F.col("w")).otherwise(0.0)) for f in (0, 1) for y in (0, 1)}
    total = {k: float(x or 0) for k, x in zip(sums, rows.agg(*[s.alias(f"n{f}{y}") for (f, y), s in sums.items()]).first(), strict=True)}
    all1, all0 = total[0, 1] + total[1, 1], total[0, 0] + total[1, 0]
    none = np.zeros(0, dtype=np.uint64)
    if not all1 or not all0:
        rate = 1.0 if all1 else 0.0
        return Model(letters, none, np.zeros(0), np.array([60.0 * rate - 30.0, 0, 0, 0, 0, 0]))
    each = rows.select("kin", "toxic", "w", F.explode(F.arrays_zip(*PARTS)).alias("x")).select("kin", "toxic", "w", "x.*")
    by = each.groupBy("word").agg(*[s.alias(f"n{f}{y}") for (f, y), s in sums.items()], F.first("five").alias("five"), F.first("four").alias("four"))
    by = staged(by, "words")
    seen = {k: F.col(f"n{k[0]}{k[1]}") for k in sums}
    # A beginning counts by its different words, so that one frequent word doesn't speak for all that begin like it.
    begin = by.select(F.explode(F.array("five", "four")).alias("word"), *[(x > 0).cast("double").alias(f"n{f}{y}") for (f, y), x in seen.items()]).where("word <> 0")
    begin = begin.groupBy("word").agg(*[F.sum(f"n{f}{y}").alias(f"n{f}{y}") for f, y in sums])
    types = by.agg(*[F.sum((x > 0).cast("double")) for x in seen.values()]).first()
    n_types = dict(zip(sums, map(float, types), strict=True))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    for df, all_n, least in ((by.drop("five", "four"), total, 1.5), (begin, n_types, 3)):
        table = df.where(F.col("n01") + F.col("n11") >= least).orderBy(F.desc(F.col("n01") + F.col("n11")), "word").limit(most_words).toArrow()
        n = {(f, y): table[f"n{f}{y}"].to_numpy() for f, y in sums}
        pairs = [(n[0, y] + n[1, y], all_n[0, y] + all_n[1, y]) for y in (1, 0)]
        parts = [[(n[f, y], all_n[f, y]) for y in (1, 0)] for f in (0, 1)]
        found.append((table["word"].to_numpy().view(np.uint64), *[_bounds(x[0][0], x[1][0], x[0][1], x[1][1]) for x in (*parts, pairs)]))
    words = np.concatenate([x[0] for x in found])
    order = np.argsort(words)
    words, bounds = words[order], [np.concatenate([x[k] for x in found])[order] for k in (1, 2, 3)]

    def chosen(bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return words[bound > 0], bound[bound > 0]

    halves = [chosen(x) for x in bounds[:2]]
    lexicon = spark.sparkContext.broadcast(halves)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            doc = np.repeat(np.arange(len(batch)), pc.list_value_length(batch["word"]).to_numpy())
            found = np.stack([batch[c].flatten().to_numpy() for c in PARTS], axis=1).view(np.uint64)
            own = batch["half"].to_numpy()
            x = np.zeros((len(batch), 6))
            for f in (0, 1):  # by the words of the other half
                x[own == f] = _look(*lexicon.value[1 - f], doc, found, len(batch))[own == f]
            x[:, 5] = np.log1p(batch["n_words"].to_numpy())
            yield pa.RecordBatch.from_arrays([batch["toxic"].cast(pa.float64()), batch["w"], *map(pa.array, x.T)], names=["y", "w", *[f"x{c}" for c in range(6)]])

    got = rows.select("toxic", "w", "n_words", *PARTS, fold.cast("int").alias("half")).mapInArrow(summaries, "y double, w double, " + ", ".join(f"x{c} double" for c in range(6))).toArrow()
    x = np.stack([got[f"x{c}"].to_numpy() for c in range(6)], axis=1)
    line = _regression(x, got["y"].to_numpy(), got["w"].to_numpy())
    return Model(letters, *chosen(bounds[2]), line)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for each row of docs, from the text only; texts without words, and null, have the score of a text without marking words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: see train()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        restorer = Restorer(m.letters)
        for batch in batches:
            done = 0
            for texts in _pieces(batch):
                x = _look(m.words, m.weights, *features(restorer, texts), len(texts))
                value = 1 / (1 + np.exp(-np.clip(x @ m.line, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(done, len(texts)), pa.array(value)], names=["doc_id", "score"])
                done += len(texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    out = score(docs, train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
