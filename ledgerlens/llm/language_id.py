"""Language identification by a small convolutional network over bytes.

Filters of several widths slide over windows of a fixed number of bytes, each filter keeps its largest response in a window, and
a softmax turns the responses into probabilities. The first layer reads bytes one-hot, so a filter of width w is w
tables of 256 weights, and its response at a place is the sum of w table entries. The network is trained in numpy on a bounded sample of labelled
windows and applied to all windows of a text; a text's probabilities are the mean over its windows, weighted by
bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.llm.words import LOWER, buffer_of, free_name, slices, tidied

WIDTHS = (2, 3, 4)
FILTERS = 16
WINDOW = 256
#: Labelled documents of each language that the network is trained on, and windows of each.
SAMPLE_DOCUMENTS, SAMPLE_WINDOWS = 400, 3
EPOCHS, BATCH, RATE = 6, 64, 0.01
#: Windows worked on at a time.
STEP = 64
UNKNOWN = "und"
#: Below this score a text is taken to be in none of the languages: hardly more than an even choice among few.
LEAST_SCORE = 0.35


@dataclass
class Model:
    labels: list[str]
    filters: dict[int, np.ndarray]  # width: (width, 256, filters)
    bias: np.ndarray
    weights: np.ndarray  # (widths * filters, labels)
    offset: np.ndarray

    def tables(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Responses to pairs of bytes for each half of the filters, and to the third byte of width 3."""
        two, three, four = (self.filters[w] for w in WIDTHS)
        pairs = [t[0][:, None, :] + t[1][None, :, :] for t in (two, three, four[:2], four[2:])]
        return [p.reshape(65536, -1).astype(np.float32) for p in pairs], three[2].astype(np.float32)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """(n, WINDOW) bytes to (n, labels)."""
        if not hasattr(self, "_tables"):
            self._tables = self.tables()
        (two, three, left, right), third = self._tables
        out = np.empty((len(windows), len(self.labels)))
        for at in range(0, len(windows), STEP):
            # places first, so that the largest response is taken over whole rows of (window, filter)
            x = windows[at : at + STEP].T.astype(np.intp)
            pair = x[:-1] * 256 + x[1:]
            wide = left.take(pair[:-2], axis=0)
            wide += right.take(pair[2:], axis=0)
            middle = three.take(pair[:-1], axis=0)
            middle += third.take(x[2:], axis=0)
            best = [two.take(pair, axis=0).max(axis=0), middle.max(axis=0), wide.max(axis=0)]
            hidden = np.maximum(np.concatenate(best, axis=1) + self.bias, 0)
            out[at : at + STEP] = _softmax(hidden @ self.weights + self.offset)
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of some texts: (n, WINDOW) bytes, the text of each, the number of its bytes. Zeros fill the last."""
    length = np.diff(offsets)
    count = -(-length // WINDOW)
    text = np.repeat(np.arange(len(length)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][text] + number * WINDOW
    size = np.minimum(WINDOW, offsets[1:][text] - start)
    at = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < size[:, None]
    return np.where(inside, LOWER[data[np.where(inside, at, start[:, None])]], 0).astype(np.uint8), text, size


def train(windows: np.ndarray, target: np.ndarray, labels: list[str], seed: int = 5) -> Model:
    """Fits the network to (n, WINDOW) bytes and label numbers with Adam."""
    chance = np.random.default_rng(seed)
    n_features = len(WIDTHS) * FILTERS
    values = {f"filter{w}": chance.normal(0, 0.3, (w, 256, FILTERS)) for w in WIDTHS}
    values |= {
        "bias": np.zeros(n_features),
        "weights": chance.normal(0, 0.3, (n_features, len(labels))),
        "offset": np.zeros(len(labels)),
    }
    first, second = ({k: np.zeros_like(v) for k, v in values.items()} for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        order = chance.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            x, y = windows[order[at : at + BATCH]], target[order[at : at + BATCH]]
            rows = np.arange(len(x))
            best, place = [], []
            for w in WIDTHS:
                span = WINDOW - w + 1
                response = sum(values[f"filter{w}"][k][x[:, k : k + span]] for k in range(w))
                where = response.argmax(axis=1)
                place.append(where)
                best.append(np.take_along_axis(response, where[:, None, :], axis=1)[:, 0, :])
            hidden = np.concatenate(best, axis=1) + values["bias"]
            active = np.maximum(hidden, 0)
            error = _softmax(active @ values["weights"] + values["offset"])
            error[rows, y] -= 1
            error /= len(x)
            back = (error @ values["weights"].T) * (hidden > 0)
            slope = {"weights": active.T @ error + 1e-4 * values["weights"], "offset": error.sum(axis=0), "bias": back.sum(axis=0)}
            for i, w in enumerate(WIDTHS):
                grown = np.zeros_like(values[f"filter{w}"])
                part = back[:, i * FILTERS : (i + 1) * FILTERS]
                for k in range(w):
                    np.add.at(grown[k], (x[rows[:, None], place[i] + k], np.arange(FILTERS)[None, :]), part)
                slope[f"filter{w}"] = grown
            step += 1
            for name, g in slope.items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                values[name] -= RATE * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return Model(labels, {w: values[f"filter{w}"] for w in WIDTHS}, values["bias"], values["weights"], values["offset"])


def fit(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang",
    documents: int = SAMPLE_DOCUMENTS, windows: int = SAMPLE_WINDOWS,
) -> Model:
    """Trains on at most ``documents`` rows of each label, chosen by the hash of their ids, ``windows`` places in each.

    Rows without id, text or label, and empty texts, teach nothing. What reaches the driver is bounded by documents *
    windows * WINDOW characters a label. Without any labelled row the model knows no label.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), F.col(label_column).cast("string").alias("label"))
    known = rows.where("id IS NOT NULL AND label IS NOT NULL AND length(text) > 0")
    share = F.xxhash64("id") / F.lit(float(2**63)) / 2 + 0.5
    counts = known.groupBy("label").agg(F.count("*").alias("n"))
    # a little more than wanted is drawn evenly, so that ranking sees a bounded number of rows
    drawn = known.select("id", "label").join(F.broadcast(counts), "label").where(share * F.col("n") < 1.5 * documents + 50)
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    drawn = drawn.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= documents)
    texts = known.join(F.broadcast(drawn.select("id", "label")), ["id", "label"]).groupBy("id", "label").agg(F.min("text").alias("text"))
    start = [F.pmod(F.xxhash64("id", F.lit(j)), F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1) + 1 for j in range(windows)]
    parts = F.array(*[F.substring("text", s.cast("int"), F.lit(WINDOW)) for s in start])
    found = texts.select("label", F.explode(F.array_distinct(parts)).alias("part")).orderBy("label", "part").collect()
    labels = sorted({r.label for r in found})
    if len(labels) < 2:
        return Model(labels, {}, np.zeros(0), np.zeros(0), np.zeros(0))
    data, offsets = buffer_of(pa.array([r.part for r in found], pa.large_string()))
    bytes_, text, _ = windows_of(data, offsets)
    number = {label: i for i, label in enumerate(labels)}
    return train(bytes_, np.array([number[r.label] for r in found])[text], labels)


def _predict(model: Model, texts: pa.Array) -> pa.StructArray:
    data, offsets = buffer_of(texts)
    scores = np.zeros((len(texts), max(1, len(model.labels))))
    if len(model.labels) > 1:
        scores = _scores(model, data, offsets)
    elif model.labels:
        scores[:] = 1
    best = scores.argmax(axis=1)
    letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    letters = letters & bool(model.labels)
    label = [model.labels[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
    score = np.where(letters, scores[np.arange(len(texts)), best], 0.0)
    return pa.StructArray.from_arrays([pa.array(label, pa.string()), pa.array(score, pa.float64())], names=["label", "score"])


def _scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros((len(offsets) - 1, len(model.labels)))
    limit = WINDOW * STEP * 32
    for low, high in slices(offsets, limit):
        # a longer text stands alone and is taken in stretches of whole windows
        for start in range(int(offsets[low]), int(offsets[high]), limit) if high == low + 1 else [0]:
            part = offsets[low : high + 1] if high > low + 1 else np.array([start, min(start + limit, int(offsets[high]))])
            windows, text, size = windows_of(data, part)
            if len(windows):
                np.add.at(total, text + low, model.probabilities(windows) * size[:, None])
    return total / np.maximum(np.diff(offsets), 1)[:, None]


def predict(model: Model, text: Column | str) -> Column:
    """A struct (label, score) for every whole text: the likeliest label and its probability.

    Null texts, texts without a letter and models without labels give (``und``, 0).
    """

    @F.arrow_udf("label string, score double")
    @tidied
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _predict(model, texts)

    return of(text)


def held_out(doc_id: Column | str) -> Column:
    """True for the documents that teach nothing: crc32 of the id as text leaves 2 when divided by 4."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents whose language can be told: a text with letters, and a likeliest language of at least this score.

    Documents without id teach nothing. Of equally likely languages the first in order counts. Repeated rows and ids are judged each, and stay or go
    as their text says; other columns of any name and type stay.
    """
    model, name = fit(docs.where(~held_out("doc_id"))), free_name(docs.columns, "_language")
    found = docs.withColumn(name, predict(model, F.col("text").cast("string")))
    return found.where((F.col(f"{name}.label") != UNKNOWN) & (F.col(f"{name}.score") >= least)).drop(name)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of documents, learned from its labelled rows not held out.

    A null id is not held out, and teaches nothing. Of equally likely languages the first in order counts. Repeated rows and ids have a row each;
    other columns are left out.
    """
    model = fit(docs.where(~held_out("doc_id")))
    found = docs.select("doc_id", held_out("doc_id").alias("held_out"), predict(model, F.col("text").cast("string")).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.label").alias("lang_pred"), F.col("p.score").alias("score"))
