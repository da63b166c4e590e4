"""Quality classifier by co-training of a text view and a metadata view.

Text view: shares of sign classes, figures of the words, hashed words and word pairs. Metadata view: language, source,
length. Both start from the labelled sample. In each round every document outside that sample is scored by both views;
those that one view is sure of are handed to the other view's training set, as means of the documents of one label and
cell (a hash), weighted by their numbers: sums are built in the tasks, so a round covers all documents whatever their
number and only 2 x 2 x CELLS mean rows come to the driver. In the end each view is calibrated on labelled rows that no
view was trained on (they are in no round either), the calibrated views are combined there too, and the result scores
every document.

Bound: at most SAMPLE labelled documents, by hash of the id; their features (some 400 numbers a document) reach the
driver. Everything else reads all documents, texts whole, in the tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterlode.llm.common import documents, packed, small_batches, unpacked
from quarterlode.llm.shingles import PLACE, SPACE, U, mixed, text_slices, words

SAMPLE = 10_000
ROUNDS, SURE, CELLS = 2, 0.97, 32
PSEUDO_WEIGHT = 0.3  # of all pseudo-labels of a class, against its labelled rows
WORD_SLOTS, PAIR_SLOTS = 128, 128
KEEP = 0.5
MARKS = b"|*#$%&!?.,;:@/<>[]{}()\"'-_=+~^\\"
LANG_SLOTS, SOURCE_SLOTS, SIZE_SLOTS = 16, 32, 24


def _class_table() -> np.ndarray:
    table = np.full(256, 4)  # other ASCII
    for k, low, high in ((0, 65, 90), (1, 97, 122), (2, 48, 57), (3, 128, 255)):
        table[low : high + 1] = k
    table[SPACE] = 5
    table[10] = 6
    table[list(MARKS)] = 7 + np.arange(len(MARKS))
    return table


CLASSES = _class_table()
FIGURES = 7 + len(MARKS) + 8
N_TEXT = FIGURES + WORD_SLOTS + PAIR_SLOTS


def text_view(column: pa.Array) -> np.ndarray:
    """A row of N_TEXT numbers for each text: shares of sign classes and figures of its words."""
    out = np.zeros((len(column), N_TEXT), np.float32)
    for at, raw, offsets in text_slices(column):
        n = len(offsets) - 1
        of = np.repeat(np.arange(n), np.diff(offsets))
        kinds = 7 + len(MARKS)
        counts = np.bincount(of * kinds + CLASSES[raw], minlength=n * kinds).reshape(n, kinds)
        size = np.maximum(1, np.diff(offsets))
        rows = out[at : at + n]
        rows[:, :kinds] = np.sqrt(counts / size[:, None])
        w, before = words(raw, offsets)
        owner = np.repeat(np.arange(n), np.diff(before))
        rows[:, FIGURES : FIGURES + WORD_SLOTS] = slot_shares(w, owner, n, WORD_SLOTS)
        inner = owner[1:] == owner[:-1]
        rows[:, FIGURES + WORD_SLOTS :] = slot_shares((w[:-1] * PLACE[0] + w[1:] * PLACE[1])[inner], owner[1:][inner], n, PAIR_SLOTS)
        for i, (a, b) in enumerate(zip(before[:-1].tolist(), before[1:].tolist(), strict=True)):
            if b > a:
                own = w[a:b]
                _, times = np.unique(own, return_counts=True)
                m = b - a
                rows[i, kinds:FIGURES] = (np.log1p(m), len(times) / m, times.max() / m, (own[1:] == own[:-1]).sum() / m, (own[2:] == own[:-2]).sum() / m, np.log1p(size[i] / m), len(times) / m**0.8, (times == 1).sum() / len(times))
    return out


def slot_shares(h: np.ndarray, of: np.ndarray, n: int, slots: int) -> np.ndarray:
    """Roots of the shares of each text's hashes that fall into each of `slots`."""
    counts = np.bincount(of * slots + (mixed(h, 23) % U(slots)).astype(np.int64), minlength=n * slots).reshape(n, slots)
    return np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))


def metadata_view(lang: list, source: list, n_chars: list) -> np.ndarray:
    out = np.zeros((len(lang), LANG_SLOTS + SOURCE_SLOTS + SIZE_SLOTS + 1))
    slot = lambda v, n: 0 if v is None else 1 + zlib.crc32(str(v).encode()) % (n - 1)
    for i, (a, b, c) in enumerate(zip(lang, source, n_chars, strict=True)):
        out[i, slot(a, LANG_SLOTS)] = 1
        out[i, LANG_SLOTS + slot(b, SOURCE_SLOTS)] = 1
        c = None if c is None else max(0, c)
        out[i, LANG_SLOTS + SOURCE_SLOTS + (0 if c is None else min(SIZE_SLOTS - 1, 1 + int(c).bit_length()))] = 1
        out[i, -1] = 0 if c is None else np.log1p(c)
    return out


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, steps: int = 25) -> Logistic:
        """Weighted ridge logistic regression by Newton steps."""
        x = x.astype(np.float64, copy=False)
        mean, scale = x.mean(0), x.std(0) + 1e-6
        z = np.c_[(x - mean) / scale, np.ones(len(x))]
        b, penalty = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-6]
        for _ in range(steps):
            p = sigmoid(z @ b)
            step = np.linalg.solve((z * (w * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (w * (y - p)) - penalty * b)
            b = b + step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-4:
                break
        return cls(mean, scale, b)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1], -30, 30)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Two views, their calibrations and the combination; without labels of both classes only `prior` is set."""

    prior: float
    views: tuple[Logistic, Logistic] | None = None
    calibrated: tuple[Logistic, Logistic] | None = None
    combined: Logistic | None = None

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        if self.views is None:
            return np.full(len(text), self.prior)
        return sigmoid(self.combined.logit(self.logits((text, meta))))

    def logits(self, views: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return np.stack([c.logit(v.logit(x)[:, None]) for c, v, x in zip(self.calibrated, self.views, views, strict=True)], 1)


def start(own: tuple[np.ndarray, np.ndarray], y: np.ndarray, held: np.ndarray) -> Model:
    """The model of the labelled rows alone. held: rows set aside for calibration."""
    prior = float((y.sum() + 1) / (len(y) + 2))
    if min((y[~held] == c).sum() for c in (0, 1)) < 2 or min((y[held] == c).sum() for c in (0, 1)) < 1:
        return Model(prior)
    return calibrated(Model(prior), own, y, held, [None, None])


def calibrated(model: Model, own: tuple[np.ndarray, np.ndarray], y: np.ndarray, held: np.ndarray, given: list) -> Model:
    """model with views fitted to the labelled rows and to what each was given (mean rows, labels, weights), calibrated and combined on `held`."""
    views = []
    for x, more in zip(own, given, strict=True):
        x, labels, weights = x[~held], y[~held], np.ones((~held).sum())
        if more is not None:
            x, labels, weights = np.r_[x, more[0]], np.r_[labels, more[1]], np.r_[weights, more[2]]
        views.append(Logistic.fit(x, labels, weights))
    model.views, ones = tuple(views), np.ones(held.sum())
    model.calibrated = tuple(Logistic.fit(v.logit(x[held])[:, None], y[held], ones) for v, x in zip(views, own, strict=True))
    model.combined = Logistic.fit(model.logits((own[0][held], own[1][held])), y[held], ones)
    return model


SOURCES = ("lang", "source", "n_chars")


def _columns(docs: DataFrame, text: str) -> list:
    """_text and the metadata; a column that docs has not is null."""
    kinds = {"lang": "string", "source": "string", "n_chars": "long"}
    return [F.col(f"`{text}`").alias("_text"), *((F.col(c) if c in docs.columns else F.lit(None)).cast(kinds[c]).alias(f"_{c}") for c in SOURCES)]


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return text_view(batch.column("_text")), metadata_view(*(batch.column(f"_{c}").to_pylist() for c in SOURCES))


def _labelled(docs: DataFrame, known: DataFrame, text: str) -> tuple[np.ndarray, ...]:
    """Hashes, labels and both views of the labelled documents; of a repeated doc_id one row (the least text) counts."""
    rows = docs.select("doc_id", *_columns(docs, text)).join(F.broadcast(known), "doc_id").groupBy("doc_id", "h", "label").agg(F.min(F.struct("_text", *(f"_{c}" for c in SOURCES))).alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [pa.array(list(x), pa.list_(pa.float32())) for x in _views(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("label"), *lists], names=["h", "label", "text_view", "meta_view"])

    found = rows.select("h", "label", "r.*").mapInArrow(run, "h long, label double, text_view array<float>, meta_view array<float>").toArrow()
    views = [found[c].combine_chunks().flatten().to_numpy().reshape(found.num_rows, -1) for c in ("text_view", "meta_view")] if found.num_rows else [np.zeros((0, 1))] * 2
    h = found["h"].to_numpy()
    order = np.argsort(h, kind="stable")
    return h[order], found["label"].to_numpy()[order], *(v[order] for v in views)


def _round(docs: DataFrame, known: DataFrame, model: Model, text: str) -> list:
    """For each view the mean rows, labels and numbers of the documents that the other view is sure of.

    All documents but the labelled sample are scored; equal texts with equal metadata fall into one cell."""
    rows = docs.select("doc_id", *_columns(docs, text)).join(F.broadcast(known.select("doc_id")), "doc_id", "left_anti").withColumn("_cell", F.pmod(F.xxhash64("_text"), F.lit(CELLS)).cast("int")).drop("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            own, cell = _views(batch), batch.column("_cell").to_numpy()
            logits = model.logits(own)
            for v in (0, 1):
                p = sigmoid(logits[:, 1 - v])
                for label, sure in ((1, p >= SURE), (0, p <= 1 - SURE)):
                    for c in np.unique(cell[sure]).tolist():
                        x = own[v][sure & (cell == c)].astype(np.float64)
                        sums[v, label, c] = sums.get((v, label, c), 0.0) + np.r_[len(x), x.sum(0)]
        if sums:
            keys = [pa.array([k[i] for k in sums], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["view", "label", "cell", "sums"])

    parts = small_batches(rows).mapInArrow(run, "view int, label int, cell int, sums array<double>")
    cells = parts.select("view", "label", "cell", F.posexplode("sums").alias("i", "x")).groupBy("view", "label", "cell", "i").agg(F.sum("x").alias("x"))
    found = sorted(cells.groupBy("view", "label", "cell").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda y: y["x"]).alias("sums")).collect())  # at most 2 x 2 x CELLS rows
    given: list = [None, None]
    for v in (0, 1):
        mine = [r for r in found if r["view"] == v]
        if mine:
            sums = np.array([r["sums"] for r in mine])
            given[v] = sums[:, 1:] / sums[:, :1], np.array([float(r["label"]) for r in mine]), sums[:, 0]
    return given


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", label: str = "quality", sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """labels: (doc_id, label 0 or 1 or null); of several labels of a document the mean, from 0.5 up good.

    Documents of null doc_id have no label; of rows that repeat a labelled doc_id one counts as labelled. Without labels
    of both classes the model gives every document its prior. Extra columns are ignored, missing metadata are null."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("double").alias("label"))
    h = F.xxhash64("doc_id", F.lit(17))
    known = known.withColumn("h", h).orderBy("h", "doc_id").limit(sample)  # a proven bound: at most `sample` rows of three numbers are broadcast
    small_batches(docs)
    hashes, y, *own = _labelled(docs, known, text)
    held = hashes % 4 == 0
    model = start(tuple(own), y, held)
    for _ in range(rounds if model.views is not None else 0):
        given = _round(docs, known, model, text)
        for more in given:
            if more is not None:
                for c in (0, 1):  # whatever their number, pseudo-labels of a class weigh this share of its labelled rows
                    of = more[1] == c
                    more[2][of] *= PSEUDO_WEIGHT * (y[~held] == c).sum() / max(1.0, more[2][of].sum())
        model = calibrated(model, tuple(own), y, held, given)
    return model


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: float = KEEP) -> DataFrame:
    """docs with score (0 to 1) and kept (score >= keep), which replace columns of these names.

    Null texts and texts without words: score 0, not kept. A model without labels of both classes gives every other
    document its prior and keeps it. Missing or null metadata have slots of their own. Equal rows, equal scores."""
    rows = packed(docs)
    at = {c: docs.columns.index(c) for c in (text, *SOURCES) if c in docs.columns}

    def column(batch: pa.RecordBatch, c: str, kind: pa.DataType) -> pa.Array:
        return batch.column(0).field(at[c]).cast(kind) if c in at else pa.nulls(batch.num_rows, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = text_view(column(batch, text, pa.string()))
            p = model.score(features, metadata_view(*(column(batch, c, k).to_pylist() for c, k in zip(SOURCES, (pa.string(), pa.string(), pa.int64()), strict=True))))
            filled = features[:, 7 + len(MARKS)] > 0
            p = np.where(filled, p, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(filled & ((p >= keep) | (model.views is None)))], names=["_in", "_score", "_kept"])

    done = small_batches(rows).mapInArrow(run, f"_in {rows.schema['_in'].dataType.simpleString()}, _score double, _kept boolean")
    return unpacked(done, docs.columns, score=F.col("_score"), kept=F.col("_kept"))


def op9_cotrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", "score", "kept")
