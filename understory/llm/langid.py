"""Language identification with hyperdimensional profiles.

Every letter class has a random vector of +1 and -1. An n-gram is the product of its letters' vectors, each rotated by
its place; a text is the sum of its n-grams, a language the sum of its texts' unit vectors. A document gets the
language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from understory.llm.worker import kept, small, with_texts

DIMENSIONS = 512
NGRAM = 3
#: Letter classes: 0 is anything but a letter, 1 to 26 are a to z, all other letters share the rest by code point.
CLASSES = 64
SEED = 20
UNKNOWN = "und"
#: Prototypes that the driver and every task may hold; more distinct languages are refused.
LANGUAGES = 10_000
#: Characters and texts that a task turns into vectors at once.
CHARS, TEXTS = 400_000, 256
#: Unit vectors are summed as integers of this step, so sums do not depend on their order.
STEP = 1 << 24


class Letters:
    """Maps texts to letter classes and n-gram codes to vectors; the same in every task."""

    def __init__(self):
        table = np.zeros(1 << 16, np.uint8)
        for code in range(1 << 16):
            if chr(code).isalpha():
                table[code] = code - 96 if 97 <= code <= 122 else 27 + code * 40503 % (CLASSES - 27)
        self.table = table
        letters = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), size=(CLASSES, DIMENSIONS))
        self.placed = [np.roll(letters, NGRAM - 1 - i, axis=1) for i in range(NGRAM)]
        self.place = np.zeros(CLASSES ** NGRAM, np.int32)

    def classes(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        found = self.table[np.minimum(codes, 0xFFFF)]
        high = np.flatnonzero(codes > 0xFFFF)
        if len(high):
            found = found.copy()
            found[high] = [27 + int(c) * 40503 % (CLASSES - 27) if chr(c).isalpha() else 0 for c in codes[high]]
        return found

    def ngrams(self, classes: np.ndarray) -> np.ndarray:
        """Codes of all n-grams whose middle is a letter; the text is framed by one gap on either side."""
        framed = np.zeros(len(classes) + 2, np.int32)
        framed[1:-1] = classes
        codes = framed[:-2] * CLASSES * CLASSES + framed[1:-1] * CLASSES + framed[2:]
        return codes[framed[1:-1] > 0]

    def vectors(self, texts: list[str]) -> np.ndarray:
        """The unit vector of every text; zero for a text without letters."""
        codes = [self.ngrams(self.classes(t)) for t in texts]
        flat = np.concatenate(codes)
        self.place[flat] = 1
        used = np.flatnonzero(self.place)
        self.place[used] = np.arange(len(used), dtype=np.int32)
        counts = np.zeros((len(texts), len(used)), np.float32)
        for row, c in zip(counts, codes):
            row += np.bincount(self.place[c], minlength=len(used))
        self.place[used] = 0
        a, b, c = used // CLASSES ** 2, used // CLASSES % CLASSES, used % CLASSES
        bound = self.placed[0][a] * self.placed[1][b] * self.placed[2][c]
        made = counts @ bound.astype(np.float32)
        length = np.sqrt((made.astype(np.float64) ** 2).sum(axis=1))
        return made / np.maximum(length, 1e-12)[:, None]


def groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    k = 0
    while k < len(texts):
        j, size = k, 0
        while j < len(texts) and j - k < TEXTS and (j == k or size + len(texts[j]) <= CHARS):
            size += len(texts[j])
            j += 1
        yield k, j
        k = j


def prototypes(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit prototypes, from all rows of ``docs`` with a language and a letter.

    The tasks sum the unit vectors of their texts by language, Spark sums those sums; only one vector for each language
    comes to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = kept(("letters",), Letters), {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "v"])

        for batch in small(batches, 1):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, j in groups(texts):
                whole = np.rint(letters.vectors(texts[k:j]) * STEP).astype(np.int64)
                for lang, row in zip(langs[k:j], whole):
                    if row.any():
                        sums[lang] = sums[lang] + row if lang in sums else row
                if len(sums) > 256:
                    yield out()
                    sums = {}
        yield out()

    known = with_texts(docs).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull())
    parts = known.mapInArrow(run, "lang string, v array<long>").select("lang", F.posexplode("v").alias("i", "x"))
    sums = parts.groupBy("lang", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).cast("double").alias("x"))
    rows = sums.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))
    got = sorted((r["lang"], r["v"]) for r in rows.limit(LANGUAGES + 1).collect())
    if len(got) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    matrix = np.array([v for _, v in got]).reshape(len(got), DIMENSIONS)
    return [n for n, _ in got], matrix / np.maximum(np.sqrt((matrix ** 2).sum(axis=1)), 1e-12)[:, None]


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` for every row: the nearest prototype and its cosine, cut to 0 to 1.

    Texts that are NULL or have no letter, and all texts if no language was learned, are ``und`` with score 0. Equal
    cosines go to the language first in order. Only the text matters; further columns are not read.
    """
    names, matrix = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = kept(("letters",), Letters)
        for batch in small(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found, scores = [], []
            for k, j in groups(texts):
                made = letters.vectors(texts[k:j])
                cosine = made @ matrix.T if names else np.zeros((j - k, 1))
                best = cosine.argmax(axis=1)
                known = made.any(axis=1) & bool(names)
                found += [names[b] if ok else UNKNOWN for b, ok in zip(best, known)]
                scores += [min(1.0, max(0.0, float(c[b]))) if ok else 0.0 for c, b, ok in zip(cosine, best, known)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                                             ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return with_texts(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether the CRC-32 of an id as text falls on ``fold``; a NULL id counts as fold 0 of an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold
