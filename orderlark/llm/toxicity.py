"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks.

Texts are cut into sentences and those into units: words without punctuation, the parts that
punctuation makes of a word, and bounded windows of a run of spaced single characters joined, one
from each of its characters. A unit is compared with a landmark by the gap-weighted subsequence
kernel of ORDER letters (gaps decay by DECAY), normalised, over all of the unit's windows of about
the landmark's length; marks of a unit's start and end count as letters, so that a match inside a
compound is a little less than one of a word. So inserted, spaced or doubled characters cost a
little and not the match. A sentence's value for a landmark is that of its most similar unit, and
a text's is log2(1 + sum of its sentences' values).

Landmarks are the words and word beginnings that labelled toxic texts hold, once or repeatedly,
far oftener than others. The Nystroem map (inverse root of the landmarks' kernel matrix) and the
text's length give the features of a linear machine with squared hinge, trained on the sentences
of labelled texts, pooled by text since that is what a label marks. A logistic curve on the
margins turns them into scores.

The fit uses a bounded sample of labelled rows: at most MOST_TOXIC and MOST_CLEAN texts, those
with the smallest hash of their id, never a held-out one. Scoring is one pass over all texts.

Defined results: null and empty texts hold nothing and score like a clean text; a null id is
not held out; labels with a null id or label are ignored, and a text labelled both ways is
toxic; without toxic or clean training texts every score is 0; repeated rows are scored each
for itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlark.llm.common import table
from orderlark.session import stored

ORDER, DECAY = 3, 0.7
LANDMARKS = 32
#: Characters of a word's beginning that may be a landmark, and of a whole word.
BEGINNINGS, WHOLE = range(3, 9), 16
#: A landmark's class association as a share of the strongest one.
MIN_ASSOCIATION = 0.1
#: Share of a landmark's letters that a unit must hold, in any order, to be compared at all.
MIN_LETTERS = 0.75
#: Similarities below this count as none; the others are raised to a power, which keeps a
#: near match and takes most from the many faint ones of a long text.
MIN_SIMILARITY, POWER = 0.55, 3
#: Characters that a unit's compared window may have more or fewer than the landmark.
EXTRA = 3
#: Characters of a spaced run's window: the longest landmark with its marks, and EXTRA.
RUN_WINDOW = WHOLE + 2 + EXTRA
FIRST, LAST = b"\x02", b"\x03"  # marks of a unit's start and end
MOST_TOXIC, MOST_CLEAN = 3000, 6000
HELD_OUT_OF = 5
CACHED = 400_000  # units a task remembers
LOT_BYTES = 4 << 20  # text compared at a time
WINDOWS = 50_000  # windows compared at a time

SENTENCE = re.compile(rb"[.!?]+[\x20\x09-\x0D]+|\n+")
PUNCTUATION = string.punctuation.encode()
PARTED = bytes.maketrans(PUNCTUATION, b" " * len(PUNCTUATION))
SPACED = re.compile(rb"(?:(?<=[\x20\x09-\x0D])|(?<![\x00-\xff]))(?:[a-z0-9][\x20\x09]){2,}[a-z0-9](?![^\x20\x09-\x0D])")


def units(text: bytes) -> list[bytes]:
    """Words without ASCII punctuation, their parts between it, and windows of joined runs of
    spaced characters."""
    plain = text.translate(None, PUNCTUATION)
    words = plain.split()
    for raw in text.split():
        if not raw.isalnum():
            parts = raw.translate(PARTED).split()
            if len(parts) > 1:
                words += [x for x in parts if len(x) >= ORDER]
    for m in SPACED.finditer(plain):
        run = b"".join(m[0].split())
        words += [run[i : i + RUN_WINDOW] for i in range(len(run) - ORDER + 1)]
    return words


def prefix_terms(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Terms of the gap-weighted subsequence kernel of ORDER letters between the rows of two
    code tables (one row of b may stand for all): the kernel of the first i letters of one and
    the first j of the other is the sum of the terms up to i and j. Zero codes match nothing."""
    n, rows, columns = len(a), a.shape[1], b.shape[1]
    same = (a[:, :, None] == b[:, None, :]) & (a[:, :, None] > 0)
    inner = np.ones((n, rows + 1, columns + 1))
    for _ in range(ORDER - 1):
        # outer[i][j]: decayed sum over matches of one letter more within the first i and j
        outer = np.zeros_like(inner)
        for i in range(1, rows + 1):
            matched = same[:, i - 1, :] * inner[:, i - 1, :-1] * DECAY**2
            run = np.zeros((n, columns + 1))
            for j in range(1, columns + 1):
                run[:, j] = DECAY * run[:, j - 1] + matched[:, j - 1]
            outer[:, i, :] = DECAY * outer[:, i - 1, :] + run
        inner = outer
    return DECAY**2 * same * inner[:, :-1, :-1]


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return prefix_terms(a, b).sum(axis=(1, 2))


def prefix_similarity(a: np.ndarray, code: np.ndarray, norm: float, least: int) -> np.ndarray:
    """The best normalised kernel of a code with the beginnings of at least `least` letters."""
    with_code = prefix_terms(a, code).sum(axis=2).cumsum(axis=1)
    own = prefix_terms(a, a).cumsum(axis=1).cumsum(axis=2)
    lengths = np.arange(a.shape[1])
    values = with_code / np.sqrt(np.maximum(own[:, lengths, lengths] * norm, 1e-300))
    return values[:, least - 1 :].max(axis=1)


class Similarity:
    """Normalised kernel values of units against fixed landmarks, remembered by unit."""

    def __init__(self, landmarks: Sequence[bytes]):
        self.landmarks = list(landmarks)
        self.codes = [np.frombuffer(x, np.uint8)[None, :] for x in self.landmarks]
        self.norms = [float(kernel(c, c)[0]) for c in self.codes]
        self.known: dict[bytes, int] = {}
        self.values = [np.zeros(len(self.landmarks), np.float32)]

    def _values(self, found: Sequence[bytes]) -> np.ndarray:
        out = np.zeros((len(found), len(self.landmarks)), np.float32)
        for at in range(0, len(found), 50_000):
            lot = [FIRST + u + LAST for u in found[at : at + 50_000]]
            lengths = np.array([len(u) for u in lot])
            firsts = np.cumsum(lengths) - lengths
            flat = np.frombuffer(b"".join(lot), np.uint8)
            masks = np.bitwise_or.reduceat(np.uint64(1) << (flat & 63).astype(np.uint64), firsts)
            for k, codes in enumerate(self.codes):
                size = codes.shape[1]
                least, places = max(ORDER, size - EXTRA), np.arange(size + EXTRA)
                distinct, needed = np.unique(codes[0], return_counts=True)
                # A unit without enough of the landmark's letters needs no kernel.
                mask = np.bitwise_or.reduce(np.uint64(1) << (distinct & 63).astype(np.uint64))
                near = np.flatnonzero((np.bitwise_count(~masks & mask) <= (1 - MIN_LETTERS) * size) & (lengths >= MIN_LETTERS * size))
                # A window from each place that leaves `least` letters, and the first one.
                n = np.maximum(1, lengths[near] - least + 1)
                ends = np.cumsum(n)
                for low in range(0, int(ends[-1]) if len(near) else 0, WINDOWS):
                    window = np.arange(low, min(low + WINDOWS, int(ends[-1])))
                    of = np.searchsorted(ends, window, side="right")
                    skipped = window - (ends[of] - n[of])
                    unit = near[of]
                    at_ = (firsts[unit] + skipped)[:, None] + places
                    letters = np.where(places < (lengths[unit] - skipped)[:, None], flat[np.minimum(at_, len(flat) - 1)], 0).astype(np.uint8)
                    shared = sum(np.minimum((letters == x).sum(axis=1), m) for x, m in zip(distinct, needed, strict=True))
                    enough = shared >= MIN_LETTERS * size
                    unit, letters = unit[enough], letters[enough]
                    for part in range(0, len(unit), 2000):
                        values = prefix_similarity(letters[part : part + 2000], codes, self.norms[k], least)
                        np.maximum.at(out, (at + unit[part : part + 2000], k), values.astype(np.float32))
        return np.where(out >= MIN_SIMILARITY, out, 0) ** POWER

    def places(self, found: Sequence[bytes]) -> list[int]:
        """For each unit the place of its values; 0 is no similarity to any landmark."""
        new = list({u for u in found if u not in self.known})
        if len(self.known) + len(new) > CACHED:
            self.known, self.values, new = {}, self.values[:1], list(set(found))
        if new:
            for unit, row in zip(new, self._values(new), strict=True):
                if row.any():
                    self.known[unit] = len(self.values)
                    self.values.append(row)
                else:
                    self.known[unit] = 0
        return [self.known[u] for u in found]

    def pooled(self, texts: Sequence[bytes]) -> np.ndarray:
        """For each text its value for every landmark, and last the log of its length in units."""
        whole = [units(t) for t in texts]
        places = self.places(list(chain.from_iterable(whole)))
        out, at = np.zeros((len(texts), len(self.landmarks) + 1)), 0
        for i, (text, found) in enumerate(zip(texts, whole, strict=True)):
            if any(places[at : at + len(found)]):
                total = np.zeros(len(self.landmarks))
                for part in SENTENCE.split(text):
                    hit = {p for p in (self.known.get(u, 0) for u in units(part)) if p}
                    if hit:
                        total += np.max([self.values[p] for p in hit], axis=0)
                out[i, :-1] = np.log2(1 + total)
            out[i, -1] = np.log2(1 + len(found))
            at += len(found)
        return out


def lots(texts: Sequence[str | None]) -> Iterator[list[bytes]]:
    """Lower-cased texts in lots of bounded size."""
    lot, size = [], 0
    for text in lowered(texts):
        lot.append(text)
        size += len(text)
        if size >= LOT_BYTES:
            yield lot
            lot, size = [], 0
    if lot:
        yield lot


def lowered(texts: Sequence[str | None]) -> list[bytes]:
    return [(t or "").lower().encode() for t in texts]


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string")) % HELD_OUT_OF == 0, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(toxic, text) of a bounded sample of labelled texts that are not held out."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
    first = lambda toxic, n: known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("_id"), "_id").limit(n)
    chosen = stored(first(1, MOST_TOXIC).union(first(0, MOST_CLEAN)), "chosen")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    # At most MOST_TOXIC + MOST_CLEAN ids.
    return stored(texts.join(F.broadcast(chosen), "_id").dropDuplicates(["_id"]).select("_id", "toxic", "text"), "training")


def landmarks(training: DataFrame) -> list[str]:
    """The words most associated with toxic texts, by the chi-square of their document counts."""

    def distinct(batches):
        for batch in batches:
            toxic, found, often = [], [], []
            for label, text in zip(batch.column("toxic").to_pylist(), lowered(batch.column("text").to_pylist()), strict=True):
                parts: Counter[str] = Counter()
                for word, n in Counter(units(text)).items():
                    w = word.decode()
                    for size in BEGINNINGS:
                        if len(w) >= size:
                            parts[FIRST.decode() + w[:size]] += n
                    if ORDER <= len(w) <= WHOLE:
                        parts[f"{FIRST.decode()}{w}{LAST.decode()}"] += n
                toxic += [label] * len(parts)
                found += parts
                often += [n > 1 for n in parts.values()]
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(found, pa.string()), pa.array(often, pa.bool_())], names=["toxic", "unit", "often"])

    total = {r["toxic"]: r["count"] for r in training.groupBy("toxic").count().collect()}
    n_toxic, n_clean = total.get(1, 0), total.get(0, 0)
    if not n_toxic or not n_clean:
        return []
    n = float(n_toxic + n_clean)
    held = training.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(distinct, "toxic int, unit string, often boolean")
    twice = F.col("often").cast("int")
    counts = held.groupBy("unit").agg(F.sum("toxic").alias("a1"), F.count(F.lit(1)).alias("m1"), F.sum(F.col("toxic") * twice).alias("a2"), F.sum(twice).alias("m2"))

    def association(a: str, m: str) -> Column:
        excess = F.greatest(F.lit(0.0), F.col(a) - F.col(m) * (n_toxic / n))
        return excess * excess / (F.col(m) * (1 - F.col(m) / n) + 1)

    chi = F.greatest(association("a1", "m1"), association("a2", "m2"))
    # Longer ones first among equals; one that begins another says nothing new beside it.
    top = counts.select("unit", chi.alias("chi")).orderBy(F.desc("chi"), F.desc(F.length("unit")), "unit").limit(LANDMARKS * len(BEGINNINGS)).collect()
    chosen: list[str] = []
    for r in top:
        if r["chi"] >= MIN_ASSOCIATION * top[0]["chi"] and not any(r["unit"].startswith(c.rstrip(LAST.decode())) or c.startswith(r["unit"]) for c in chosen):
            chosen.append(r["unit"])
    return chosen[:LANDMARKS]


class Machine:
    """Nystroem map, linear machine and logistic curve."""

    def __init__(self, words: Sequence[str], rows: np.ndarray, labels: np.ndarray):
        self.words = [w.encode() for w in words]
        self.ready = bool(self.words)
        if not self.ready:
            return
        similarity = Similarity(self.words)
        own = np.array([[(kernel(a, b)[0] / np.sqrt(na * nb)) ** POWER for b, nb in zip(similarity.codes, similarity.norms, strict=True)] for a, na in zip(similarity.codes, similarity.norms, strict=True)])
        values, vectors = np.linalg.eigh((own + own.T) / 2)
        self.map = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
        x = self.features(rows)
        self.weights, self.offset = hinge(x, np.where(labels == 1, 1.0, -1.0))
        self.slope, self.shift = curve(x @ self.weights + self.offset, labels)

    def features(self, rows: np.ndarray) -> np.ndarray:
        return np.hstack([rows[:, :-1] @ self.map, rows[:, -1:] / 10])

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.zeros(len(rows))
        margins = self.features(rows) @ self.weights + self.offset
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -40, 40)))


def hinge(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge, classes weighted equally, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-9
    w = np.zeros(x.shape[1])
    for _ in range(50):
        active = y * (x @ w) < 1
        xa, wa = x[active], weight[active]
        new = np.linalg.solve(penalty + (xa * wa[:, None]).T @ xa, (xa * wa[:, None]).T @ y[active])
        if np.abs(new - w).max() < 1e-9:
            break
        w = w + 0.7 * (new - w)
    return w[:-1], float(w[-1])


def curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic curve through margins, classes weighted equally, with soft labels."""
    n = {1: max(1, (labels == 1).sum()), 0: max(1, (labels == 0).sum())}
    soft = np.where(labels == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    weight = np.where(labels == 1, 0.5 / n[1], 0.5 / n[0])
    x, w = np.column_stack([margins, np.ones(len(margins))]), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (weight * (p - soft)) + 1e-6 * w)
        w = w - np.clip(step, -2, 2)
    return max(float(w[0]), 1e-6), float(w[1])


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    training = training_texts(docs, labels, id_col, text_col)
    words = landmarks(training)

    def values(batches):
        similarity = Similarity([w.encode() for w in words])
        for batch in batches:
            kept = [r.tolist() for lot in lots(batch.column("text").to_pylist()) for r in similarity.pooled(lot)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("toxic"), pa.array(kept, pa.list_(pa.float64()))], names=["_id", "toxic", "values"])

    if not words:
        return Machine([], np.zeros((0, 1)), np.zeros(0))
    found = training.select(F.col("_id").cast("string").alias("_id"), F.col("toxic").cast("int").alias("toxic"), "text")
    # A short row for each of the bounded number of training texts.
    rows = found.mapInArrow(values, "_id string, toxic int, values array<double>").orderBy("_id").collect()
    return Machine(words, np.array([r["values"] for r in rows]), np.array([r["toxic"] for r in rows]))


def scored(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every text."""
    slim = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def score(batches):
        model = shared.value
        similarity = Similarity(model.words)
        for batch in batches:
            scores = [x for lot in lots(batch.column("text").to_pylist()) for x in model.scores(similarity.pooled(lot)).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    found = slim.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double")
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fitted(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLE = {}
