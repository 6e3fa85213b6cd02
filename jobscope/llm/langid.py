"""Language ID: script ranges narrow the candidates, Viterbi over per-word scores labels spans of mixed-language text."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.llm.common import give_back, lean, mix64, range_hashes, slices, staged

#: First and last code point of the main blocks of each script.
SCRIPTS = [
    ("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("latin", 0xAA, 0x24F), ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F),
    ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("arabic", 0x750, 0x77F), ("devanagari", 0x900, 0x97F),
    ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x2FA1F),
]
SCRIPT_NAMES = ["other", *sorted({name for name, _, _ in SCRIPTS})]

#: No word's evidence against a language is above CLIP nats; a change of language costs SWITCH nats.
CLIP, SWITCH = 5.0, 10.0
GRAM_BITS = 16
SLICE_CHARS = 1 << 19
TEXTS = "doc_id long, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>"


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: letter (1: letter, 2: mark in a word), lower case, hash, script."""
    n = 0x110000
    kind = np.fromiter(({"L": 1, "M": 2}.get(unicodedata.category(chr(c))[0], 0) for c in range(n)), dtype=np.uint8, count=n)
    lower = np.arange(n, dtype=np.uint32)
    for c in np.flatnonzero(kind == 1).tolist():
        if len(low := chr(c).lower()) == 1:
            lower[c] = ord(low)
    script = np.zeros(n, dtype=np.uint8)
    for name, first, last in SCRIPTS:
        script[first : last + 1] = SCRIPT_NAMES.index(name)
    return kind, lower, mix64(np.arange(1, n + 1, dtype=np.uint64)), script


class _Letters:
    """Words (runs of letters and marks, lower-cased) of several texts, in code points."""

    def __init__(self, texts: list[str]) -> None:
        kind, lower, hashes, script = _tables()
        self.codes = lower[np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "replace"), dtype=np.uint32)]
        inside = np.concatenate([[False], kind[self.codes] > 0])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hashes = range_hashes(hashes[self.codes], self.starts, self.ends)
        self.script = script[self.codes[self.starts]]
        letters = np.concatenate([[0], np.cumsum(kind[self.codes] == 1)])
        self.has_letter = np.diff(letters[self.offsets]) > 0

    def trigrams(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashed trigrams of the chosen words with a mark at both ends, and how many each has."""
        starts, n = self.starts[chosen], self.ends[chosen] - self.starts[chosen]
        shift = np.cumsum(n + 2) - (n + 2)
        flat = np.full(int((n + 2).sum()), 32, dtype=np.uint64)
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        flat[np.repeat(shift + 1, n) + at] = self.codes[np.repeat(starts, n) + at]
        left = np.repeat(shift, n) + at
        x = mix64((flat[left] << np.uint64(42)) ^ (flat[left + 1] << np.uint64(21)) ^ flat[left + 2])
        return (x >> np.uint64(64 - GRAM_BITS)).astype(np.int64), n


@dataclass
class Model:
    """langs; allowed[script, lang]; sorted word hashes with a row of log probabilities each; the same for trigram buckets."""

    langs: list[str]
    allowed: np.ndarray
    words: np.ndarray
    word_scores: np.ndarray
    gram_scores: np.ndarray

    def score(self, t: _Letters) -> np.ndarray:
        """words x langs, the best language of a word at 0 and none under -CLIP."""
        known, where, back = np.unique(t.hashes, return_index=True, return_inverse=True)
        scores = np.zeros((len(known), len(self.langs)), dtype=np.float32)
        at = np.minimum(np.searchsorted(self.words, known), max(0, len(self.words) - 1))
        hit = self.words[at] == known if len(self.words) else np.zeros(len(known), dtype=bool)
        scores[hit] = self.word_scores[at[hit]]
        if (~hit).any():
            grams, n = t.trigrams(where[~hit])
            sums = np.add.reduceat(self.gram_scores[grams], np.cumsum(n) - n, axis=0)
            scores[~hit] = sums / np.maximum(n, 1)[:, None] * np.minimum(n, 6)[:, None]
        allowed = self.allowed[t.script[where]]
        allowed[~allowed.any(axis=1)] = True
        scores[~allowed] = -np.inf
        scores -= scores.max(axis=1, keepdims=True)
        return np.maximum(scores, -CLIP)[back]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of words with their counts by language (place): words, trigram buckets and scripts, with a count for each language."""
    for batch in batches:
        t = _Letters(batch["word"].to_pylist())
        # The JVM and Python may know different versions of Unicode: what isn't one word in both is left out.
        one = np.flatnonzero(np.diff(t.first) == 1)
        at = t.first[:-1][one]
        place, n = batch["place"].to_numpy()[one], batch["n"].to_numpy()[one]
        grams, sizes = t.trigrams(at)
        for kind, key, where, weight in ((0, t.hashes[at].view(np.int64), place, n), (1, grams, np.repeat(place, sizes), np.repeat(n, sizes)), (2, t.script[at].astype(np.int64), place, n)):
            both, back = np.unique(np.stack([key, where]), axis=1, return_inverse=True)
            sums = np.bincount(back.ravel(), weights=weight, minlength=both.shape[1]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sums), kind, dtype=np.int32)), pa.array(both[0]), pa.array(both[1]), pa.array(sums)], names=["kind", "key", "place", "n"])


def train(docs: DataFrame, per_lang: int = 3000, words: int = 200_000, most_langs: int = 64) -> Model:
    """Fits on about per_lang documents of each language, drawn by a hash of the text, with the most frequent words.

    Only rows with lang and text are used, and of more than most_langs languages the most frequent ones. Counting is done
    by Spark, trigrams of all words of the sample included; the driver gets numbers only, of words words at most.
    Without rows there are no languages and every prediction is und.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    totals = dict(map(tuple, rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()))
    langs = sorted(totals)
    if not langs:
        none = np.zeros((0, 0), dtype=np.float32)
        return Model([], np.zeros((len(SCRIPT_NAMES), 0), dtype=bool), np.zeros(0, dtype=np.uint64), none, none)
    shares = docs.sparkSession.createDataFrame([(x, k, int(min(1.0, per_lang / totals[x]) * 1e6)) for k, x in enumerate(langs)], "lang string, place long, share long")
    sample = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.col("share"))
    found = sample.select("place", F.explode(F.split(F.lower("text"), r"[^\p{L}\p{M}]+")).alias("word")).where("word <> ''")
    counts = found.groupBy("word", "place").agg(F.count("*").alias("n")).mapInArrow(lean(_count), "kind int, key long, place long, n long")
    counts = staged(counts.groupBy("kind", "key", "place").agg(F.sum("n").alias("n")), "language-counts")
    # A histogram of how often words occur tells from which count on there are as many as wanted.
    by_word = counts.where("kind = 0").groupBy("key").agg(F.sum("n").alias("total"), F.collect_list(F.struct("place", "n")).alias("by_lang")).where("total >= 2")
    by_word = staged(by_word, "language-words")
    least, n_words = 2, 0
    for x in by_word.groupBy("total").count().orderBy(F.desc("total")).collect():
        n_words += x["count"]
        if n_words > words:
            least = x["total"] + 1
            break
    table = by_word.where(F.col("total") >= least).select("key", "by_lang").toArrow()
    n = np.zeros((len(table), len(langs)))
    cells = pc.list_flatten(table["by_lang"].combine_chunks())
    row = np.repeat(np.arange(len(table)), pc.list_value_length(table["by_lang"]).to_numpy())
    n[row, cells.field("place").to_numpy()] = cells.field("n").to_numpy()
    hashes = table["key"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    spread = [np.zeros((size, len(langs))) for size in (1 << GRAM_BITS, len(SCRIPT_NAMES))]
    for kind, held in zip((1, 2), spread, strict=True):
        got = counts.where(F.col("kind") == kind).select("key", "place", "n").toArrow()
        held[got["key"].to_numpy(), got["place"].to_numpy()] = got["n"].to_numpy()
    per_gram, scripts = spread
    per_gram += 0.1
    seen = n + 0.5
    allowed = scripts > 0.01 * np.maximum(scripts.sum(axis=0), 1)
    logs = np.log(seen / (seen.sum(axis=0) + 1)).astype(np.float32)
    return Model(langs, allowed, hashes[order], logs[order], np.log(per_gram / per_gram.sum(axis=0)).astype(np.float32))


def viterbi(scores: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Labels of the words first[d]..last[d] for all documents d in step; a change of label costs SWITCH."""
    labels = np.zeros(len(scores), dtype=np.int16)
    order = np.argsort(first - last, kind="stable")
    first, n = first[order], (last - first)[order]
    value = np.zeros((len(n), scores.shape[1]))
    came = []
    live = len(n)
    for step in range(int(n.max(initial=0))):
        live = int(np.searchsorted(-n, -step, side="left"))
        v = value[:live]
        best = v.argmax(axis=1)
        top = v[np.arange(live), best] - (SWITCH if step else 0)
        stay = v >= top[:, None]
        came.append(np.where(stay, np.arange(v.shape[1]), best[:, None]).astype(np.int16))
        value[:live] = np.where(stay, v, top[:, None]) + scores[first[:live] + step]
    now = value.argmax(axis=1)
    for step in range(len(came) - 1, -1, -1):
        live = len(came[step])
        labels[first[:live] + step] = now[:live]
        now[:live] = came[step][np.arange(live), now[:live]]
    return labels


def label(model: Model, t: _Letters) -> tuple[np.ndarray, np.ndarray]:
    """Label of each word, and the scores of each word.

    A path that leaves the document's best language pays SWITCH at least once for each stretch outside of it, and gains there at
    most the sum, word by word, of the best other language over it. If no stretch gains more than SWITCH by that, no path is
    better than the one that keeps to the best language, however many languages it goes through, and the search is skipped.
    """
    scores, n_docs = model.score(t), len(t.offsets) - 1
    sums = np.concatenate([np.zeros((1, len(model.langs))), np.cumsum(scores, axis=0, dtype=np.float64)])
    totals = sums[t.first[1:]] - sums[t.first[:-1]]
    best = totals.argmax(axis=1)
    doc = np.repeat(np.arange(n_docs), np.diff(t.first))
    labels = best[doc].astype(np.int16)
    mixed = np.zeros(n_docs, dtype=bool)
    if len(model.langs) > 1:
        at = np.arange(len(doc))
        own = scores[at, labels].astype(np.float64)
        others = scores.copy()
        others[at, labels] = -np.inf
        gain = np.cumsum(others.max(axis=1) - own)
        before = np.concatenate([[0.0], gain[:-1]])
        drop = doc * (2 * CLIP * (len(doc) + 1))  # so that the running minimum starts anew in each document
        rise = gain - drop - np.minimum.accumulate(before - drop)
        mixed[doc[rise > SWITCH]] = True
    if mixed.any():
        chosen = np.flatnonzero(mixed)
        found = viterbi(scores, t.first[:-1][chosen], t.first[1:][chosen])
        at = mixed[doc]
        labels[at] = found[at]
    return labels, scores


def _predict(model: Model, ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
    t = _Letters(texts)
    n_docs, langs = len(texts), [*model.langs, "und"]
    doc = np.repeat(np.arange(n_docs), np.diff(t.first))
    words = np.diff(t.first)
    if not model.langs:
        labels, lang, score = np.zeros(len(doc), dtype=np.int16), np.zeros(n_docs, dtype=int), np.zeros(n_docs)
    else:
        labels, scores = label(model, t)
        votes = np.bincount(doc * len(model.langs) + labels, minlength=n_docs * len(model.langs)).reshape(n_docs, -1)
        lang = votes.argmax(axis=1)
        # How much better the language explains its own words than the next one does.
        sums = np.concatenate([np.zeros((1, len(model.langs))), np.cumsum(scores * (labels == lang[doc])[:, None], axis=0, dtype=np.float64)])
        totals = sums[t.first[1:]] - sums[t.first[:-1]]
        others = totals.copy()
        others[np.arange(n_docs), lang] = -np.inf
        margin = np.maximum(0, totals[np.arange(n_docs), lang] - others.max(axis=1)) if len(model.langs) > 1 else words.astype(float)
        # Words of a script that no language has are of none of them, whatever their label.
        own = (labels == lang[doc]) & model.allowed.any(axis=1)[t.script]
        score = np.bincount(doc[own], minlength=n_docs) / np.maximum(words, 1) * -np.expm1(-margin)
    lang = np.where(t.has_letter & (words > 0), lang, len(langs) - 1)
    score = np.where(lang == len(langs) - 1, 0.0, score)
    cut = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(labels, prepend=-1) != 0))
    cut = cut[lang[doc[cut]] < len(langs) - 1]
    stop = np.append(cut[1:], len(doc)) - 1 if len(cut) else cut
    stop = np.minimum(stop, t.first[doc[cut] + 1] - 1)
    spans = pa.StructArray.from_arrays([
        pa.array(t.starts[cut] - t.offsets[doc[cut]], pa.int64()), pa.array(t.ends[stop] - t.offsets[doc[cut]], pa.int64()),
        pa.array(langs).take(pa.array(labels[cut])),
    ], names=["start", "end", "lang"])
    per_doc = np.concatenate([[0], np.cumsum(np.bincount(doc[cut], minlength=n_docs))]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(langs).take(pa.array(lang)), pa.array(score, pa.float64()), pa.ListArray.from_arrays(pa.array(per_doc), spans)],
        names=["doc_id", "lang_pred", "score", "spans"],
    )


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with their texts, of which only one slice is in Python at a time."""
    for part in slices(pc.fill_null(pc.utf8_length(batch["text"]), 0).to_pylist(), SLICE_CHARS):
        piece = batch.slice(part.start, part.stop - part.start)
        yield piece, [x or "" for x in piece["text"].to_pylist()]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, spans (start, end, lang; code points of the text), one row for each row of docs.

    lang_pred is the label of most words; score is their share times the certainty that they are of this language and not
    of the next best, so a text of two clear languages has a score of about a half. Words whose script no language has count
    as words but not in the share, so a text of such words only has a score of 0. A null text, or one without a letter, is und with score 0 and no spans. Only the text is looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: see train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in _texts(batch):
                yield _predict(shared.value, piece["doc_id"], texts)

    return docs.select("doc_id", "text").mapInArrow(lean(run), TEXTS)


def keep_identified(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs whose text has a language with a score of at least least, all columns unchanged and without a shuffle.

    Only the text goes to Python and only the score (null for und) comes back, so a text is held once in each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            parts = []
            for piece, held in _texts(pa.RecordBatch.from_arrays([batch], names=["text"])):
                found = _predict(shared.value, pa.nulls(len(piece), pa.int64()), held)
                parts.append(pc.if_else(pc.equal(found["lang_pred"], "und"), None, found["score"]))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.float64())
            give_back()

    return docs.where(score(F.col("text")) >= least)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
