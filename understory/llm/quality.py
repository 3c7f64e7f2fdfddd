"""Quality scores by Bradley-Terry pairwise ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from understory.llm.worker import small, with_texts
from understory.operators.order import exact_quantiles
from understory.session import written

#: Labelled rows in a block, chosen by a hash of the id; rows meet rivals of their block.
BLOCK = 128
#: Rows of the rarer label in a block, on the average, at least; they join several blocks where they are fewer.
RARE = 16
#: Rivals that each row of the commoner label meets in its block: ``RIVALS``, or ``FEW`` where it has over four times the rows.
RIVALS, FEW = 8, 2
RIDGE = 1e-3
ROUNDS = 25
CUT = 0.3
BYTES = 128
N_FEATURES = BYTES + 9


def features(text: str) -> np.ndarray:
    """What a text looks like: roots of byte shares (ASCII each, all others together) and shares over words and lines."""
    raw = text.encode("utf-8", "surrogatepass")
    out = np.zeros(N_FEATURES)
    if not raw:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float64)
    out[:BYTES] = np.sqrt(counts[:BYTES] / len(raw))
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    digits, spaces, high = counts[48:58].sum(), counts[[9, 10, 11, 12, 13, 32]].sum(), counts[128:].sum()
    words, lines = raw.split(), raw.split(b"\n")
    n = max(1, len(words))
    out[BYTES:] = (
        np.sqrt(high / len(raw)), upper / max(1.0, upper + lower), digits / len(raw), spaces / len(raw),
        (len(raw) - upper - lower - digits - spaces - high) / len(raw), np.log1p(len(words)) / 10,
        min(1.0, (len(raw) - spaces) / n / 20), len(set(words)) / n, len(set(lines)) / len(lines))
    return out


def featured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc_id, x)``, written once: the features of every text as 32-bit numbers. NULL counts as an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1):
            found = [features(t or "").astype("<f4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return written(with_texts(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, x binary"), "quality-features")


def labelled(made: DataFrame, labels: DataFrame, label_col: str) -> DataFrame:
    """Rows ``(doc_id, label, x)`` of all labelled documents, written once. Both sides are shuffled at any size; no text goes along."""
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).filter(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    return written(made.join(known.hint("merge"), "doc_id").select("doc_id", "label", "x"), "quality-rows")


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, N_FEATURES).astype(np.float64)


def summed(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum over all batches of what ``part`` makes of one, ``size`` numbers; the driver sees one sum for each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += part(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    return sum((np.frombuffer(t, np.float64) for t in rows.mapInArrow(run, "total binary").toArrow().column(0).to_pylist()), np.zeros(size))


def scaling(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each feature over all rows."""
    total = summed(rows.select("x"), lambda batch: np.append(matrix(batch.column(0)).sum(axis=0), len(batch)), N_FEATURES + 1)
    if not total[-1]:
        return np.zeros(N_FEATURES), np.ones(N_FEATURES)
    mean = total[:-1] / total[-1]
    square = summed(rows.select("x"), lambda batch: ((matrix(batch.column(0)) - mean) ** 2).sum(axis=0), N_FEATURES)
    scale = np.sqrt(square / total[-1])
    return mean, np.where(scale > 1e-9, scale, 1.0)


def blocks(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """All rows dealt into blocks ``(labels, xs)`` of about ``BLOCK`` rows; rows of a rare label join several blocks."""
    n = max(1, sum(counts.values()) // BLOCK)
    copies = {y: min(n, -(-RARE * n // counts[y])) for y in (0, 1)}
    first = F.xxhash64("doc_id", F.lit(7))
    more = F.sequence(F.lit(0), F.when(F.col("label") == 1, copies[1] - 1).otherwise(copies[0] - 1))
    dealt = rows.withColumn("block", F.explode(F.transform(more, lambda i: F.pmod(F.pmod(first, F.lit(n)) + i, F.lit(n)))))
    held = dealt.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("doc_id", "label", "x"))).alias("rows"))
    return written(held.select(F.col("rows.label").alias("labels"), F.col("rows.x").alias("xs")), "quality-blocks")


def differences(z: np.ndarray, y: np.ndarray, turns: int) -> np.ndarray:
    """Better rows less worse ones of a block, in turn, so that every row meets rivals."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return np.zeros((0, z.shape[1]))
    step = np.arange(max(len(good), len(bad)))
    return np.concatenate([z[good[step % len(good)]] - z[bad[(step * 7 + t * 13 + step // len(bad)) % len(bad)]] for t in range(turns)])


def weighed(held: DataFrame, mean: np.ndarray, scale: np.ndarray, turns: int) -> np.ndarray:
    """Bradley-Terry weights: the logistic loss on the differences of all blocks, minimised by Newton's method."""
    size = N_FEATURES
    weights = np.zeros(size)

    def part(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(size * size + size + 1)
        for labels, xs in zip(batch.column(0), batch.column(1)):
            d = differences((matrix(xs.values) - mean) / scale, labels.values.to_numpy(), turns)
            p = 1 / (1 + np.exp(np.clip(d @ weights, -30, 30)))
            total[:size * size] += ((d * (p * (1 - p))[:, None]).T @ d).ravel()
            total[size * size:-1] += d.T @ p
            total[-1] += len(d)
        return total

    for _ in range(ROUNDS):
        total = summed(held, part, size * size + size + 1)
        pairs = max(1.0, total[-1])
        gradient = RIDGE * weights - total[size * size:-1] / pairs
        hessian = total[:size * size].reshape(size, size) / pairs + RIDGE * np.eye(size)
        move = np.linalg.solve(hessian, gradient)
        weights = weights - move
        if np.abs(move).max() < 1e-7:
            break
    return weights


def raw_scores(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(((matrix(batch.column(0)) - mean) / scale) @ weights)], ["raw"])

    return rows.select("x").mapInArrow(run, "raw double")


def train_on(made: DataFrame, labels: DataFrame, label_col: str = "quality") -> dict:
    """Learn from all labelled rows of ``featured``: Bradley-Terry weights over standardised features, and the raw score at
    the quantile that parts the labels' shares. The model is ``{mean, scale, weights, cut}``.

    Rows without id, and labels other than 0 and 1, teach nothing; repeated rows count as often as they stand.
    Without rows of both labels all scores are alike: 1 side of the threshold if only label 1 is known, else the other.
    """
    rows = labelled(made, labels, label_col)
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    mean, scale = scaling(rows)
    if len(counts) < 2:
        return {"mean": mean, "scale": scale, "weights": np.zeros(N_FEATURES), "cut": -1.0 if 1 in counts else 1.0}
    turns = RIVALS if max(counts.values()) <= 4 * min(counts.values()) else FEW
    weights = weighed(blocks(rows, counts), mean, scale, turns)
    # Halfway between the last score of label 0's share and the next one.
    place = (counts[0] - 0.5) / (counts[0] + counts[1] - 1)
    raw = written(raw_scores(rows, mean, scale, weights), "quality-raw")
    return {"mean": mean, "scale": scale, "weights": weights, "cut": exact_quantiles(raw, [], "raw", [place], "q").first()["q"][0]}


def scores_of(made: DataFrame, model: dict) -> DataFrame:
    """``(doc_id, score)`` for every row of ``featured``: a logistic curve that crosses ``CUT`` at the model's quantile.

    Text is all that a score is made of.
    """
    mean, scale, weights, cut = (model[k] for k in ("mean", "scale", "weights", "cut"))
    lift = np.log(CUT / (1 - CUT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = ((matrix(batch.column(1)) - mean) / scale) @ weights - cut + lift
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(raw, -30, 30))))], ["doc_id", "score"])

    return made.select("doc_id", "x").mapInArrow(run, f"doc_id {made.schema['doc_id'].dataType.simpleString()}, score double")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> dict:
    return train_on(featured(docs), labels, label_col)


def scores(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return scores_of(featured(docs, id_col, text_col), model)
