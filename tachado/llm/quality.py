"""Quality classifier by co-training two views of a document.

One classifier sees the words, the other only what a page says about itself: language, source, length and layout.  Over
rounds each labels all documents outside the labelled sample, and what it is sure of teaches the other one, by sums that
are made where the documents are: counts of words for the text view, whose vocabulary is chosen anew from them, and
slope and curvature of the loss for the metadata view.  Both are calibrated on labelled rows held out, and a last
calibration combines them into one score for every document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tachado.llm.tables import pieces, written
from tachado.llm.words import KEPT, distinct

TOKEN = re.compile(r"\w+|[^\w\s]+")
SEEDS = {"labelled": 11, "held": 17}
LANG_SLOTS, SOURCE_SLOTS = 8, 32
#: Factor of a word that no labelled row shows, and the one from which those of the others are fitted.
FACTOR = 0.2
#: Kinds of sums, the scale at which those of reals become whole numbers (so that their order is nothing), and words that a task holds.
WORD, DOCUMENTS, SLOPE, CURVE = range(4)
SCALE, HELD_WORDS = 1 << 20, 1_000_000
#: Classes of bytes whose shares are layout: digits, upper and lower case, blanks, line ends, marks, bytes beyond ASCII.
CLASSES = np.select([(b := np.arange(256)) >= 128, (b >= 48) & (b < 58), (b >= 65) & (b < 91), (b >= 97) & (b < 123), b == 10, b <= 32], [0, 1, 2, 3, 4, 5], 6)


@dataclass(frozen=True)
class Settings:
    """Bound of the labelled rows that are fitted on the driver, and the exchange between the views."""

    labelled: int = 8000
    rounds: int = 3
    sure: float = 0.95
    held: float = 0.3
    #: A word is used if so many documents with a label, given or taught, have it and its share of bad ones is so far from all words' (chi-square).
    least_documents: int = 4
    telling: float = 12


@dataclass
class Model:
    """What scoring needs: the hashes of words with their weights, the weights of the metadata, and three calibrations."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    text: np.ndarray | None = None
    meta: np.ndarray | None = None
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None
    calibrated: tuple = ()

    def scores(self, found: list[np.ndarray], metadata: np.ndarray) -> np.ndarray:
        """Probabilities of being good: by text, by metadata, by both; one half each without a model."""
        if self.text is None:
            return np.full((len(found), 3), 0.5)
        raw = np.stack([_linear(_rows(found), self.text, len(found)), _dense(metadata, self.centre, self.spread) @ self.meta], axis=1)
        own = [_sigmoid(a * raw[:, i] + b) for i, (a, b) in enumerate(self.calibrated[:2])]
        return np.stack([*own, _sigmoid(raw @ self.calibrated[2][:2] + self.calibrated[2][2])], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class FeatureHashes(dict):
    """Hashes of the features of a run of characters that are not blank, as bytes, kept for those seen first."""

    def __missing__(self, run: str) -> bytes:
        words = (run,) if run.isalnum() else TOKEN.findall(run)
        digest = xxhash.xxh3_64_digest
        value = b"".join([digest(w) if len(w) <= 4 else digest(w) + digest(w[:4] + "*") for w in words])
        if len(self) < KEPT:
            self[run] = value
        return value


def features(text: str | None, known: FeatureHashes) -> np.ndarray:
    """Sorted hashes of a text's words, and of the first letters of longer ones, which a word not seen before may share.

    No word holds a blank, so a run of other characters says its words by itself.
    """
    runs = set((text or "").lower().split())
    return distinct(np.frombuffer(b"".join(map(known.__getitem__, runs)), ">u8").astype(np.uint64))


def metadata(text: str | None, lang: str | None, source: str | None) -> np.ndarray:
    """Language and source by hashed slots, length, shares of kinds of bytes, word and line lengths; no words."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    kinds = np.bincount(CLASSES[raw], minlength=7) if len(raw) else np.zeros(7)
    n = max(1, len(raw))
    slots = np.zeros(LANG_SLOTS + SOURCE_SLOTS)
    if lang is not None:
        slots[zlib.crc32(lang.encode()) % LANG_SLOTS] = 1
    if source is not None:
        slots[LANG_SLOTS + zlib.crc32(source.encode()) % SOURCE_SLOTS] = 1
    return np.concatenate([slots, kinds / n, [np.log1p(len(raw)), np.log1p(n / (1 + kinds[4])), n / (1 + kinds[4] + kinds[5])]])


def _rows(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers one after the other, and the row of each."""
    sizes = [len(x) for x in found]
    return (np.concatenate(found) if found else np.zeros(0, np.int64)).astype(np.int64), np.repeat(np.arange(len(found)), sizes)


def _linear(rows: tuple[np.ndarray, np.ndarray], weights: np.ndarray, n: int) -> np.ndarray:
    at, row = rows
    return np.bincount(row, weights[at], minlength=n) + weights[-1]


def _dense(x: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.hstack([(x - centre) / spread, np.ones((len(x), 1))])


def _fit(value, slope, w: np.ndarray, target: np.ndarray, l2: float, steps: int = 200, rate: float = 0.05, more=lambda w: 0.0) -> np.ndarray:
    """Logistic regression from ``w`` by adaptive gradient steps; ``value`` gives the rows' sums, ``slope`` the gradient, ``more`` what else adds to it; the last weight is the constant."""
    w, m, v = w.copy(), np.zeros(len(w)), np.zeros(len(w))
    for t in range(1, steps + 1):
        g = slope((_sigmoid(value(w)) - target) / len(target)) + more(w) + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
    return w


@dataclass
class Taught:
    """Sums over documents: of each telling word in good and bad ones with the numbers of these, labelled rows included, and
    of the loss of the metadata view, whose weights were ``start``, over the documents that the text view taught."""

    words: np.ndarray
    good: np.ndarray
    bad: np.ndarray
    totals: tuple[int, int]
    taught: int = 0
    start: np.ndarray | None = None
    slope: np.ndarray | None = None
    curve: np.ndarray | None = None


def _fit_text(found: list[np.ndarray], target: np.ndarray, seen: Taught) -> np.ndarray:
    """Weights of words: each counts by the log of the ratio of its shares in good and bad documents, times a factor that is
    fitted where a labelled row has the word."""
    size = len(seen.words)
    at, row = _rows(found)
    ratio = np.log((seen.good + 0.5) / (seen.totals[0] + 1)) - np.log((seen.bad + 0.5) / (seen.totals[1] + 1))
    shown = np.bincount(at, minlength=size) > 0
    at, own, n = (np.cumsum(shown) - 1)[at], np.append(ratio[shown], 1.0), int(shown.sum())
    u = _fit(lambda u: _linear((at, row), own * u, len(found)), lambda e: own * np.append(np.bincount(at, e[row], minlength=n), e.sum()),
             np.append(np.full(n, FACTOR), 0.0), target, 1e-6, 150)
    out = np.append(ratio * FACTOR, u[-1])
    out[:-1][shown] = own[:-1] * u[:-1]
    return out


def _fit_dense(x: np.ndarray, target: np.ndarray, l2: float = 1e-4, steps: int = 300, seen: Taught | None = None) -> np.ndarray:
    """Weights of dense rows.  Taught documents count by a bound of their loss that touches it at the weights they were
    summed with (the curvature of a logistic loss is one quarter at most), so their loss never grows from there unseen."""
    if seen is None or not seen.taught:
        return _fit(lambda w: x @ w, lambda e: x.T @ e, np.zeros(x.shape[1]), target, l2, steps)
    every = len(target) + seen.taught
    return _fit(lambda w: x @ w, lambda e: x.T @ e * (len(target) / every), seen.start, target, l2, steps,
                more=lambda w: (seen.slope + seen.curve @ (w - seen.start) / 4) / every)


def telling(bad, count, share, s: Settings):
    """Whether words that ``count`` documents have, ``bad`` of them bad, say something; numbers or columns."""
    return (count >= s.least_documents) & ((bad - count * share) * (bad - count * share) >= s.telling * count * share * (1 - share))


def fit(labelled: list[tuple], exchange: Callable[[Model], Taught], s: Settings = Settings()) -> Model:
    """A model from rows (features, metadata, good, held) and the sums that ``exchange`` makes of all documents by the model so far; an empty one if a class is missing."""
    train, held = [r for r in labelled if not r[3]], [r for r in labelled if r[3]]
    if len({r[2] for r in train}) < 2 or len({r[2] for r in held}) < 2:
        return Model()
    every, count = np.unique(np.concatenate([r[0] for r in train]), return_counts=True)
    wrong, n = np.unique(np.concatenate([r[0] for r in train if not r[2]]), return_counts=True)
    bad, n_bad = np.zeros(len(every)), sum(not r[2] for r in train)
    bad[np.searchsorted(every, wrong)] = n
    use = telling(bad, count, n_bad / len(train), s)
    seen = Taught(every[use], (count - bad)[use], bad[use], (len(train) - n_bad, n_bad))
    meta = np.stack([r[1] for r in train])
    centre, spread = meta.mean(0), meta.std(0) + 1e-6
    meta, held_meta = _dense(meta, centre, spread), _dense(np.stack([r[1] for r in held]), centre, spread)
    good, held_good, one = np.array([r[2] for r in train], float), np.array([r[2] for r in held], float), np.ones(len(held))
    for round_ in range(s.rounds + 1):
        w_text = _fit_text([numbered(r[0], seen.words) for r in train], good, seen)
        w_meta = _fit_dense(meta, good, seen=seen)
        held_raw = [_linear(_rows([numbered(r[0], seen.words) for r in held]), w_text, len(held)), held_meta @ w_meta]
        scale = [tuple(_fit_dense(np.stack([x, one], 1), held_good, 1e-3)) for x in held_raw]
        both = tuple(_fit_dense(np.stack([*held_raw, one], 1), held_good, 1e-3))
        model = Model(seen.words, w_text, w_meta, centre, spread, (*scale, both))
        if round_ < s.rounds:
            seen = exchange(model)
    return model


def numbered(found: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The places in ``words`` of the features that are there."""
    if not len(words):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(words, found), len(words) - 1)
    return at[words[at] == found]


def _counted(found: list[np.ndarray], good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, and how many good and bad rows have each."""
    at, row = (np.concatenate(found), np.repeat(good, [len(x) for x in found])) if found else (np.zeros(0, np.uint64), np.zeros(0, bool))
    words, place = np.unique(at, return_inverse=True)
    return words, np.bincount(place, row, len(words)).astype(np.int64), np.bincount(place, ~row, len(words)).astype(np.int64)


def viewed(docs: DataFrame) -> DataFrame:
    """What the two views see of every row of ``docs`` (doc_id, text, lang, source): doc_id, words, meta, as arrays in binary.

    About half of the texts in size when stored; rounds and scoring read it in place of cutting texts into words again.
    Rows that are views already pass through.
    """
    if docs.columns == ["doc_id", "words", "meta"]:
        return docs

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = FeatureHashes()
        for batch in batches:
            for part in pieces(batch, "text"):
                text, lang, source = (part.column(c).to_pylist() for c in ("text", "lang", "source"))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([features(t, known).tobytes() for t in text], pa.binary()),
                    pa.array([metadata(*x).tobytes() for x in zip(text, lang, source)], pa.binary())], names=["doc_id", "words", "meta"])

    return docs.select("doc_id", "text", "lang", "source").mapInArrow(rows, f"doc_id {dict(docs.dtypes)['doc_id']}, words binary, meta binary")


def _seen(part: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and metadata of rows of views."""
    found = [np.frombuffer(x, np.uint64) for x in part.column("words").to_pylist()]
    return found, np.stack([np.frombuffer(x) for x in part.column("meta").to_pylist()])


def sums(docs: DataFrame, model: Model, sample: dict[int, tuple[bool, bool]], s: Settings) -> DataFrame:
    """(kind, key, good, bad): the sums of ``Taught`` over all rows of ``docs``, words not chosen yet.

    Rows of the ``sample`` (good, held by doc_id) count by their label, or not at all if held.  Every other row counts by
    what a view is sure of: for words what the metadata say, for the metadata what words say.
    """
    width = len(model.meta)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        documents, taught, slope, curve = [0, 0], 0, np.zeros(width), np.zeros((width, width))

        def out(kind: int, key: np.ndarray, good: np.ndarray, bad: np.ndarray | None = None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.astype(np.int64)), pa.array(good.astype(np.int64)),
                                               pa.array((good * 0 if bad is None else bad).astype(np.int64))], names=["kind", "key", "good", "bad"])

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            words, place = np.unique(np.concatenate([k[0] for k in kept]), return_inverse=True)
            return words, *(np.bincount(place, np.concatenate([k[i] for k in kept]), len(words)).astype(np.int64) for i in (1, 2))

        for batch in batches:
            for part in pieces(batch, "words"):
                ids = part.column("doc_id").to_pylist()
                found, x = _seen(part)
                p = model.scores([numbered(f, model.words) for f in found], x)
                given = [sample.get(i) for i in ids]
                free = np.array([g is None for g in given])
                by_text, by_meta = (np.where(p[:, k] >= s.sure, 1, np.where(1 - p[:, k] >= s.sure, 0, -1)) for k in (0, 1))
                label = np.array([m if g is None else -1 if g[1] else int(g[0]) for g, m in zip(given, by_meta.tolist())])
                use = np.flatnonzero(label >= 0)
                documents[0] += int((label == 1).sum())
                documents[1] += int((label == 0).sum())
                kept.append(_counted([found[i] for i in use], label[use] == 1))
                size += len(kept[-1][0])
                if size > HELD_WORDS:
                    kept = [merged()]
                    size = len(kept[0][0])
                    if size > HELD_WORDS // 2:
                        yield out(WORD, *kept[0])
                        kept, size = [], 0
                use = free & (by_text >= 0)
                dense = _dense(x[use], model.centre, model.spread)
                taught += len(dense)
                slope += dense.T @ (_sigmoid(dense @ model.meta) - by_text[use])
                curve += dense.T @ dense
        if kept:
            yield out(WORD, *merged())
        yield out(DOCUMENTS, np.arange(2), np.array([documents[0], taught]), np.array([documents[1], 0]))
        yield out(SLOPE, np.arange(width), np.rint(slope * SCALE))
        yield out(CURVE, np.arange(width * width), np.rint(curve.reshape(-1) * SCALE))

    found = viewed(docs).mapInArrow(rows, "kind int, key bigint, good bigint, bad bigint")
    return found.groupBy("kind", "key").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def exchanged(docs: DataFrame, model: Model, sample: dict[int, tuple[bool, bool]], s: Settings) -> Taught:
    """What the views teach each other over all of ``docs``; only the telling words come to the driver."""
    every = written(sums(docs, model, sample, s), "taught")
    width = len(model.meta)
    few = {(r["kind"], r["key"]): (r["good"], r["bad"]) for r in every.where(F.col("kind") != WORD).collect()}
    good, bad = few.get((DOCUMENTS, 0), (0, 0))
    words = every.where((F.col("kind") == WORD) & telling(F.col("bad"), F.col("good") + F.col("bad"), F.lit(bad / max(1, good + bad)), s)).select("key", "good", "bad").toArrow()
    key = words.column("key").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(key)
    real = lambda kind, n: np.array([few.get((kind, k), (0, 0))[0] for k in range(n)]) / SCALE
    return Taught(key[order], words.column("good").to_numpy()[order], words.column("bad").to_numpy()[order], (good, bad), few.get((DOCUMENTS, 1), (0, 0))[0],
                  model.meta, real(SLOPE, width), real(CURVE, width * width).reshape(width, width))


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Fit on at most ``s.labelled`` labelled rows and all other rows of ``docs`` (doc_id, text, lang, source).

    ``labels`` (doc_id, quality, toxic): good is of quality and not toxic; rows with a null are left out, and of several
    for a document the worst counts.  The labelled sample follows a hash of doc_id, so it is the same in every run;
    documents with a label that are not in it are taught like those without.  Repeated rows and rows without an id are
    each taught.  ``docs`` is cut into words once, unless it is what ``viewed`` gives; each of ``s.rounds`` is one scan of that.
    """
    known = labels.dropna(subset=["doc_id", "quality", "toxic"]).groupBy("doc_id").agg(
        F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("good"))
    chosen = known.orderBy(F.xxhash64(F.lit(SEEDS["labelled"]), "doc_id"), "doc_id").limit(s.labelled)
    spark = docs.sparkSession
    views = docs if viewed(docs) is docs else written(viewed(docs), "views")
    ids = [(r["doc_id"], r["good"]) for r in chosen.collect()]  # at most s.labelled
    held = spark.createDataFrame(ids, "doc_id bigint, good int")
    labelled = views.join(F.broadcast(held), "doc_id").withColumn("held", F.pmod(F.xxhash64(F.lit(SEEDS["held"]), "doc_id"), F.lit(1000)) < 1000 * s.held)
    # Rows of a document that is there many times say the same; one of each is enough, and so the sample stays bounded.
    got = labelled.dropDuplicates(["doc_id"]).select("doc_id", "words", "meta", "good", "held").collect()
    got.sort(key=lambda r: r["doc_id"])
    sample = {r["doc_id"]: (bool(r["good"]), r["held"]) for r in got}
    cases = [(np.frombuffer(r["words"], np.uint64), np.frombuffer(r["meta"]), r["good"], r["held"]) for r in got]
    del got
    return fit(cases, lambda model: exchanged(views, model, sample, s), s)


def _scored(model: Model, part: pa.RecordBatch, known: FeatureHashes) -> np.ndarray:
    text, lang, source = (part.column(c).to_pylist() for c in ("text", "lang", "source"))
    meta = np.stack([metadata(*x) for x in zip(text, lang, source)])
    return model.scores([numbered(features(t, known), model.words) for t in text], meta)


def score(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, lang, source, or what ``viewed`` gives): doc_id, text_score, meta_score, score, keep.

    Nulls are empty texts and unknown languages and sources; repeated rows are scored each; other columns are ignored.
    Without a model all scores are one half, and a score of ``least`` is kept.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "words"):
                found, meta = _seen(part)
                p = model.scores([numbered(f, model.words) for f in found], meta)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c) for c in p.T), pa.array(p[:, 2] >= least)],
                                                 names=["doc_id", "text_score", "meta_score", "score", "keep"])

    return viewed(docs).mapInArrow(
        rows, f"doc_id {dict(docs.dtypes)['doc_id']}, text_score double, meta_score double, score double, keep boolean")


def kept(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more, as they are."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = FeatureHashes()
        for batch in batches:
            for part in pieces(batch, "text"):
                yield part.filter(pa.array(_scored(model, part, known)[:, 2] >= least))

    return docs.mapInArrow(rows, docs.schema)
