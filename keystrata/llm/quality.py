"""Document quality by co-training of two views.

One classifier sees the text's content (characters, words and lines), the other the page's metadata alone (language,
source and recorded size). Over some rounds each labels the unlabelled rows it is sure of for the other to learn
from. The unlabelled rows stay where they are: every round scores all of them, and the tasks return sums only (counts by
confidence, gradients and Hessians). Each view is then calibrated on labelled rows that neither learned from, and a logistic combination of the two
calibrated log-odds, fitted on the same rows, scores every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.shared import SPACED_WORD, chunks, small, store, word_hashes

#: Fitting sees at most so many labelled rows, those with the smallest hash of their id, and all unlabelled ones.
MAX_LABELLED = 8000
#: Of the unlabelled rows, how many a view may label in a round, by label.
SHARE = 1 / 16
#: Confidence is counted in steps of 1/16 of log-odds, which end at 30.
STEPS, CONFIDENCES = 16, 481
#: Slots for hashed languages, sources and powers of two of the size.
SLOTS = 64
KEEP_AT = 0.5

_CLASS = np.zeros(256, np.uint8)  # 0 other letters (non-ASCII), then:
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".,;:'\"-()", "!?"), 1):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[[c for c in range(128) if not _CLASS[c]]] = 8  # other signs
N_CONTENT, N_META = 21, 2


def content_features(texts: list[bytes]) -> np.ndarray:
    """Shares of character classes and signs, how often words repeat, and how lines run."""
    out = np.zeros((len(texts), N_CONTENT))
    for begin, end in chunks(texts):
        part = texts[begin:end]
        hashes, first = word_hashes(part, SPACED_WORD)
        for i, text in enumerate(part):
            data = np.frombuffer(text, np.uint8)
            counts = np.bincount(_CLASS[data], minlength=9)
            words = hashes[first[i] : first[i + 1]]
            n, k = max(1, len(data)), max(1, len(words))
            letters = max(1, counts[0] + counts[1] + counts[2])
            bytes_ = np.bincount(data, minlength=256)
            signs = bytes_[[c for c in range(33, 127) if _CLASS[c] == 8]]
            some = np.sort(words)
            twice = np.count_nonzero(words[1:] == words[:-1])
            thrice = np.count_nonzero(words[2:] == words[:-2])
            runs = np.diff(np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1], [True]]))) if len(some) else np.zeros(1)
            lines = counts[5] + 1
            longest = int(np.diff(np.flatnonzero(np.concatenate([[True], data == 10, [True]]))).max())
            out[begin + i] = [counts[2] / letters, counts[3] / n, counts[6] / k, counts[7] / k, counts[8] / k, signs.max() / k, (signs > 0).sum() / 10, (len(data) - counts[4] - counts[5]) / k / 10,
                              twice / k, thrice / k, len(runs) / k**0.9, runs.max() / k, np.log1p(k) / 10, min(1, twice), min(1.0, counts[7] / k * 4), min(1.0, counts[8] / k * 4),
                              np.log1p(lines) / 5, np.log1p(len(data) / lines) / 10, np.log1p(longest) / 10, lines == 1, text.count(b"\n\n") / lines]
    return out


def metadata_features(langs: list, sources: list, sizes: list) -> np.ndarray:
    """Recorded size, whether there is one, and hashed language, source and power of two of the size; no text is looked at."""
    out = np.zeros((len(langs), N_META + SLOTS))
    for i, (lang, source, size) in enumerate(zip(langs, sources, sizes, strict=True)):
        size = None if size is None else max(0, size)
        out[i, :N_META] = [0 if size is None else np.log1p(size) / 10, size is None]
        for name, value in (("lang", lang), ("source", source), ("size", None if size is None else size.bit_length())):
            out[i, N_META + zlib.crc32(f"{name}={value}".encode()) % SLOTS] = 1
    return out


@dataclass
class Logistic:
    """L2-regularised logistic regression on standardised features, by Newton steps."""

    l2: float = 1.0
    mean: np.ndarray = field(default=None)
    scale: np.ndarray = field(default=None)
    w: np.ndarray = field(default=None)

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 25) -> Logistic:
        self.standardise(x.mean(0), x.std(0))
        for _ in range(steps):
            if self.step(*self.terms(x, y)):
                break
        return self

    def standardise(self, mean: np.ndarray, scale: np.ndarray) -> Logistic:
        self.mean, self.scale = mean, np.where(scale < 1e-9, 1.0, scale)
        self.w = np.zeros(len(mean) + 1)
        return self

    def terms(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and Hessian of the loss, which add up over parts of the rows."""
        z = self._design(x)
        p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
        return z.T @ (p - y), (z * (p * (1 - p) + 1e-6)[:, None]).T @ z

    def step(self, gradient: np.ndarray, hessian: np.ndarray) -> bool:
        """A Newton step from the terms of all rows; whether it was the last one needed."""
        ridge = np.diag([*([self.l2] * (len(self.w) - 1)), 1e-3])
        step = np.linalg.solve(hessian + ridge, gradient + ridge @ self.w)
        self.w = self.w - step * min(1.0, 4 / max(1e-12, np.abs(step).max()))
        return np.abs(step).max() < 1e-6

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))], 1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._design(x) @ self.w, -30, 30)


#: Sums of one part of the pool, from its views' features and the rows' ranks among equals (0 to 1).
Part = Callable[[list[np.ndarray], np.ndarray], np.ndarray]


@dataclass
class LocalPool:
    """Unlabelled rows in memory."""

    views: list[np.ndarray]

    def total(self, part: Part) -> np.ndarray:
        n = len(self.views[0])
        return part(self.views, (np.arange(n) + 0.5) / max(1, n))


@dataclass
class StoredPool:
    """Unlabelled rows (x, _tie) of a stored table."""

    rows: DataFrame

    def total(self, part: Part) -> np.ndarray:
        """The sum over all rows; a task returns one array, and these are added in order of the tasks."""

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for batch in small(batches):
                more = part(_unpacked(batch.column("x")), batch.column("_tie").to_numpy())
                out = more if out is None else out + more
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([out.astype("<f8").tobytes()], pa.binary())], names=["sums"])

        got = self.rows.select("x", "_tie").mapInArrow(apply, "sums binary").toArrow().column("sums").to_pylist()
        sums = [np.frombuffer(x, "<f8") for x in got]
        return sum(sums[1:], sums[0]) if sums else part(_unpacked(pa.array([], pa.binary())), np.zeros(0))


@dataclass
class Lesson:
    """What both views taught each other in a round: view k gives the other the rows that pass its limits.

    limits[k][label]: the step of confidence from which on rows are taken, and the share that is taken of that step.
    """

    teachers: list[Logistic]
    sure: float
    limits: list[list[tuple[int, float]]]


def _confidence(z: np.ndarray, label: int, sure: float) -> np.ndarray:
    """The step of confidence in a label, -1 where it isn't sure."""
    s = z if label else -z
    return np.where(s >= sure, np.floor(s * STEPS), -1).astype(np.int64)


def _taught(views: list[np.ndarray], tie: np.ndarray, lessons: list[Lesson]) -> list[np.ndarray]:
    """The label that each view was taught of each row, -1 where none; the first lesson holds."""
    out = [np.full(len(tie), -1) for _ in views]
    for lesson in lessons:
        for k, (teacher, limits) in enumerate(zip(lesson.teachers, lesson.limits, strict=True)):
            z, free = teacher.log_odds(views[k]), out[1 - k] < 0
            for label, (at, some) in enumerate(limits):
                c = _confidence(z, label, lesson.sure)
                out[1 - k][free & (c >= 0) & ((c > at) | (c == at) & (tie < some))] = label
    return out


def _moments(centres: list[np.ndarray]) -> Part:
    """Number of rows, sums of the features and of their squares, both from the centres."""

    def part(views: list[np.ndarray], tie: np.ndarray) -> np.ndarray:
        both = np.concatenate(views, 1) - np.concatenate(centres)
        return np.concatenate([[len(tie)], both.sum(0), (both**2).sum(0)])

    return part


def _confidences(teachers: list[Logistic], lessons: list[Lesson], sure: float) -> Part:
    """Rows not yet taught, by teaching view, label and step of confidence."""

    def part(views: list[np.ndarray], tie: np.ndarray) -> np.ndarray:
        known, out = _taught(views, tie, lessons), np.zeros((2, 2, CONFIDENCES))
        for k, teacher in enumerate(teachers):
            z = teacher.log_odds(views[k][known[1 - k] < 0])
            for label in (0, 1):
                c = _confidence(z, label, sure)
                out[k, label] = np.bincount(c[c >= 0], minlength=CONFIDENCES)
        return out.ravel()

    return part


def _newton(models: list[Logistic], lessons: list[Lesson]) -> Part:
    """Number, gradient and Hessian of the rows that each view was taught."""

    def part(views: list[np.ndarray], tie: np.ndarray) -> np.ndarray:
        known = _taught(views, tie, lessons)
        return np.concatenate([t for m, x, y in zip(models, views, known, strict=True) for t in ([(y >= 0).sum()], *map(np.ravel, m.terms(x[y >= 0], y[y >= 0])))])

    return part


def _limit(counts: np.ndarray, most: float) -> tuple[int, float]:
    """From which step on ``most`` rows are taken, and the share of that step."""
    above = 0.0
    for at in np.flatnonzero(counts)[::-1]:
        if above + counts[at] >= most:
            return int(at), (most - above) / counts[at]
        above += counts[at]
    return -1, 0.0


@dataclass
class CoTrained:
    """Two views' classifiers, their calibration (slope, shift) and the combination of both."""

    views: list[Logistic]
    calibration: list[Logistic]
    combined: Logistic

    @classmethod
    def fit(cls, views: list[np.ndarray], y: np.ndarray, fold: np.ndarray, pool: LocalPool | StoredPool | list[np.ndarray], rounds: int = 4, sure: float = 0.97, share: float = SHARE, steps: int = 25) -> CoTrained:
        """views: each view's features of the labelled rows; fold: rows kept for calibration; pool: the unlabelled rows.

        In a round each view labels at most ``share`` of the pool with either label for the other, the surest rows first. What a
        view was taught weighs, all rows together, at most as much as the labelled rows: many rows don't outvote them.
        """
        pool = LocalPool(pool) if isinstance(pool, list) else pool
        learn, logit = ~fold, float(np.log(sure / (1 - sure)))
        x, target = [v[learn] for v in views], y[learn]
        centres = [v.mean(0) for v in x]
        n, *sums = np.split(pool.total(_moments(centres)), [1, 1 + sum(map(len, centres))])
        n, rows, own = float(n[0]), float(n[0]) + len(target), []
        for v, centre, first, second in zip(x, centres, *(np.split(t, [len(centres[0])]) for t in sums), strict=True):
            shift = first / rows
            spread = (((v - centre) ** 2).sum(0) + second) / rows - shift**2
            own.append(Logistic().standardise(centre + shift, np.sqrt(np.maximum(0, spread))))
        lessons = []
        for at in range(rounds + 1):
            if at:
                counts = pool.total(_confidences(own, lessons, logit)).reshape(2, 2, CONFIDENCES)
                limits = [[_limit(c, share * n) for c in each] for each in counts]
                lessons = [*lessons, Lesson(own, logit, limits)]
                own = [replace(m, w=np.zeros(len(m.w))) for m in own]  # Newton steps from the last weights may not converge
            for _ in range(steps if n or not at else 0):
                more = pool.total(_newton(own, lessons)) if lessons else None
                done = []
                for m, v in zip(own, x, strict=True):
                    gradient, hessian = m.terms(v, target)
                    if more is not None:
                        k = len(m.w)
                        (taught,), g, h, more = np.split(more, [1, 1 + k, 1 + k + k * k])
                        weight = min(1.0, len(target) / max(1.0, taught))
                        gradient, hessian = gradient + weight * g, hessian + weight * h.reshape(k, k)
                    done.append(m.step(gradient, hessian))
                if all(done):
                    break
        z = [m.log_odds(v[fold])[:, None] for m, v in zip(own, views, strict=True)]
        calibration = [Logistic(l2=0.1).fit(v, y[fold]) for v in z]
        both = np.concatenate([c.log_odds(v)[:, None] for c, v in zip(calibration, z, strict=True)], 1)
        return cls(own, calibration, Logistic(l2=0.1).fit(both, y[fold]))

    def scores(self, views: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Probability of label 1 by both views together, and by each."""
        z = [c.log_odds(m.log_odds(x)[:, None]) for m, c, x in zip(self.views, self.calibration, views, strict=True)]
        both = self.combined.log_odds(np.stack(z, 1))
        return 1 / (1 + np.exp(-both)), [1 / (1 + np.exp(-v)) for v in z]


def _views(batch: pa.RecordBatch) -> list[np.ndarray]:
    texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
    return [content_features(texts), metadata_features(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")))]


def _packed(views: list[np.ndarray]) -> list[bytes]:
    """Each row's features; those of the slots are bits."""
    numbers = np.concatenate([views[0], views[1][:, :N_META]], 1).astype("<f8")
    slots = np.packbits(views[1][:, N_META:] > 0, axis=1)
    return [a.tobytes() + b.tobytes() for a, b in zip(numbers, slots, strict=True)]


def _unpacked(column: pa.Array) -> list[np.ndarray]:
    k = 8 * (N_CONTENT + N_META)
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, k + SLOTS // 8)
    numbers = np.ascontiguousarray(data[:, :k]).view("<f8")
    return [numbers[:, :N_CONTENT], np.concatenate([numbers[:, N_CONTENT:], np.unpackbits(data[:, k:], axis=1)], 1)]


def _features(docs: DataFrame) -> DataFrame:
    """(doc_id, _tie, x): packed features of every row, and a number from 0 to 1 by which rows of equal confidence are told."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_tie"), pa.array(_packed(_views(batch)), pa.binary())], names=["doc_id", "_tie", "x"])

    tie = F.pmod(F.xxhash64(F.lit(4), F.col("doc_id"), F.col("text")), F.lit(1 << 30)) / (1 << 30)
    return docs.withColumn("_tie", tie).mapInArrow(apply, "doc_id bigint, _tie double, x binary")


def quality(documents: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, content_score, metadata_score, score (0 to 1, higher: label 1 likelier) and keep of every document.

    labels: (doc_id, quality); those of ids with crc32(id as text) mod 4 = 2 are held out and never seen. Rows of labels
    with nulls are left out, of several labels of an id the largest holds, and of several rows of a labelled id one is fitted on. Every row of documents gives one row; null
    texts count as empty, null languages and sources as values of their own. With fewer than ten labelled rows, or one
    label only, every score is 0.5. Other columns play no part. All rows without a label that aren't held out are the
    pool of co-training.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), *(F.col(c).cast(t).alias(c) for c, t in (("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"))))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").cast("int").alias("_label"))
    chosen = known.where(~held).orderBy(F.xxhash64(F.lit(3), F.col("doc_id")), F.col("doc_id")).limit(max_labelled).select("doc_id")
    rows, _ = store(_features(docs).join(known, "doc_id", "left"), "quality")
    # One row for each labelled id, however often it is repeated: what reaches the driver is bounded by rows.
    sample = rows.where("_label IS NOT NULL").join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("x").alias("x"), F.max("_label").alias("_label"))
    got = sample.orderBy("doc_id").toArrow()
    y, model = got.column("_label").to_numpy().astype(float), None
    if len(y) >= 10 and len(set(y.tolist())) == 2:
        fold = np.array([zlib.crc32(b"fold%d" % i) % 4 == 0 for i in got.column("doc_id").to_pylist()])
        if min(len(set(y[fold])), len(set(y[~fold]))) == 2:
            model = CoTrained.fit(_unpacked(got.column("x")), y, fold, StoredPool(rows.where("_label IS NULL").where(~held)))
    shared = spark.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            n = batch.num_rows
            score, each = shared.value.scores(_unpacked(batch.column("x"))) if shared.value and n else (np.full(n, 0.5), [np.full(n, 0.5)] * 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(each[0]), pa.array(each[1]), pa.array(score)], names=["doc_id", "content_score", "metadata_score", "score"])

    scored = rows.select("doc_id", "x").mapInArrow(apply, "doc_id bigint, content_score double, metadata_score double, score double")
    return scored.select("doc_id", held.alias("held_out"), "content_score", "metadata_score", "score", (F.col("score") >= keep_at).cast("int").alias("keep"))
