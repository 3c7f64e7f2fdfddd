"""Benchmark decontamination by latent semantic retrieval.

Words are hashed to features; their document frequencies come from all documents. The TF-IDF matrix of the benchmark's
passages is cut into parts of at most as many passages as the basis has directions, and each part is decomposed by a
distributed randomised SVD, so that no passage loses length in the latent space however many items there are. Document
windows are projected into the latent spaces and meet the passages whose cosine is high enough or that they cover by half;
a longest common subsequence and, for weaker overlaps, a check for the item's answer then decide on whole items.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from understory.llm.worker import small, with_texts

FEATURES = 1 << 16
RANK = 192
OVERSAMPLE = 16
#: Words of a document window and of a benchmark passage, and how far the next one starts.
WINDOW, STRIDE = 32, 16
PASSAGE = 48
COSINE = 0.4
#: Two windows that do not overlap hold any verbatim passage whole, so one of them covers half of its squared length.
COVERED = 0.499
#: The least of (1 + log c) ** 2 / c for c up to WINDOW.
TF_LOSS = 0.62
#: A common subsequence of this share of the item's words is a leak; from the lower share on, if the answer is there too.
LCS, LCS_WITH_ANSWER, ANSWER = 0.7, 0.5, 0.8
#: Parts of up to RANK passages compared in one pass over the documents; larger benchmarks take several passes.
PARTS = 32
WORDS = 300_000
#: All but ASCII letters, digits and what lies beyond ASCII parts words.
GAPS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(GAPS).split()


class Hashed(dict):
    """The feature of a word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        value = self[word] = zlib.crc32(word) % FEATURES
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many documents each feature occurs, over all of them, and how many documents there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, counts, n = Hashed(), np.zeros(FEATURES, np.int64), 0
        seen = np.zeros(FEATURES, bool)
        for batch in small(batches, 0):
            for text in batch.column(0).to_pylist():
                ids = hashed.of(words_of(text))
                seen[ids] = True
                if len(ids) > 2000:
                    counts += seen
                    seen[:] = False
                else:
                    ids = ids[seen[ids]]
                    ids = np.unique(ids)
                    counts[ids] += 1
                    seen[ids] = False
                n += 1
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(counts[used], n))], ["feature", "n"])

    parts = with_texts(docs).select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "feature long, n long")
    got = parts.groupBy("feature").agg(F.sum("n").alias("n")).toArrow()  # one row for each feature: a fixed bound
    feature, n = got.column(0).to_numpy(), got.column(1).to_numpy()
    out = np.zeros(FEATURES, np.int64)
    out[feature[feature >= 0]] = n[feature >= 0]
    return out, int(n[feature < 0].sum())


def weights(frequencies: np.ndarray, n: int) -> np.ndarray:
    return (np.log((n + 1) / (frequencies + 1)) + 1e-3).astype(np.float32)


def passages(words: list[bytes]) -> list[list[bytes]]:
    """Passages of an item of up to ``PASSAGE`` words, half a passage apart."""
    if len(words) <= PASSAGE:
        return [words] if words else []
    starts = list(range(0, len(words) - PASSAGE, PASSAGE // 2)) + [len(words) - PASSAGE]
    return [words[s:s + PASSAGE] for s in starts]


def row_and_length(ids: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Features and values of one passage's TF-IDF row, of unit length, and its length before."""
    used, counts = np.unique(ids, return_counts=True)
    values = (1 + np.log(counts)) * idf[used]
    length = max(1e-12, float(np.sqrt((values ** 2).sum())))
    return used, values / length, length


def latent_bases(cut: DataFrame, idf: np.ndarray, rank: int = RANK) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each part of ``cut`` (``part``, ``words`` of one passage) its features and their right singular vectors.

    A randomised SVD of the TF-IDF matrix of every part, of all parts in the same three passes over the distributed rows:
    the Gram matrix of the sketch Y = A G orthonormalises it, B = Q'A is summed by features, and the small Gram matrix
    B B' gives the rotation. What leaves the tasks is a sketch by a fixed number of features for each part. A part of at
    most ``rank`` passages keeps its whole row space.
    """
    size = rank + OVERSAMPLE

    def noise() -> np.ndarray:
        return np.random.default_rng(1).standard_normal((FEATURES, size)).astype(np.float32)

    def sketch(batch: pa.RecordBatch, hashed: Hashed, gauss: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for part, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            used, values, _ = row_and_length(hashed.of(words.split()), idf)
            yield part, used, values, values @ gauss[used]

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, gauss, totals = Hashed(), noise(), {}
        for batch in batches:
            for part, _, _, y in sketch(batch, hashed, gauss):
                if part not in totals:
                    totals[part] = np.zeros((size, size))
                totals[part] += np.outer(y, y)
        i = pa.array(np.arange(size * size))
        for part, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size * size, part)), i, pa.array(total.ravel())], ["part", "i", "x"])

    sums = cut.mapInArrow(gram, "part long, i long, x double").groupBy("part", "i").agg(F.sum("x").alias("x")).toArrow()
    of, place, sums = (sums.column(c).to_numpy() for c in range(3))
    whitened = {}
    for part in np.unique(of).tolist():
        square = np.zeros(size * size)
        square[place[of == part]] = sums[of == part]
        values, vectors = np.linalg.eigh(square.reshape(size, size))
        keep = values > max(values.max(initial=0), 1e-12) * 1e-9
        whitened[part] = vectors[:, keep] / np.sqrt(values[keep])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, gauss, sums = Hashed(), noise(), {}
        for batch in batches:
            for part, used, values, y in sketch(batch, hashed, gauss):
                q = y @ whitened[part]
                for f, v in zip(used.tolist(), values):
                    sums[part, f] = sums.get((part, f), 0) + v * q
        keys = sorted(sums)
        for k in range(0, len(keys), 256):
            some = keys[k:k + 256]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in some], pa.int64()), pa.array([f for _, f in some], pa.int64()),
                                              pa.array([sums[key] for key in some], pa.list_(pa.float64()))], ["part", "feature", "b"])

    made = cut.mapInArrow(project, "part long, feature long, b array<double>")
    rows: dict[int, list[tuple[int, np.ndarray]]] = {}
    for row in made.groupBy("part", "feature").agg(F.collect_list("b").alias("b")).toLocalIterator():
        rows.setdefault(row["part"], []).append((row["feature"], np.sum(row["b"], axis=0)))
    out = {}
    for part, found in rows.items():
        found.sort(key=lambda x: x[0])
        b = np.array([x for _, x in found])
        values, turn = np.linalg.eigh(b.T @ b)
        top = np.argsort(-values)[:rank]
        top = top[values[top] > max(values.max(initial=0), 1e-12) * 1e-9]
        out[part] = np.array([f for f, _ in found], np.int64), (b @ turn[:, top] / np.sqrt(values[top])).astype(np.float32)
    return out


def common_subsequence(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, by bit rows over ``a``."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & where.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def answer_of(words: list[bytes], answer: str | None) -> list[bytes]:
    """The item's answer, or where it has none of its own, its last quarter."""
    return words_of(answer) or words[-max(1, len(words) // 4):]


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """Documents that hold benchmark items: ``doc_id, item_id, at, cosine, lcs, answer``, one row for each pair.

    ``at`` is the first word of the best window, ``lcs`` the share of the item's words in the longest common
    subsequence with the window and its surroundings (an item's length on either side). Words are runs of ASCII
    letters, digits and characters beyond ASCII, lower-cased, so case and punctuation do not hide a leak. NULL and empty
    texts hold nothing and are held by nothing; items without words cannot leak; repeated rows give repeated pairs;
    empty tables give no rows. The benchmark is the query set: it goes to the tasks in parts of ``RANK`` passages, about
    ``PARTS`` of them in one pass over the documents. A verbatim copy of a passage always comes to the comparison.
    """
    frequencies, n = document_frequencies(docs, text_col)
    idf = weights(frequencies, n)
    id_kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc_id {id_kind}, item_id {item_kind}, at long, cosine double, lcs double, answer double"
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"),
                             (F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")).alias("answer"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array([len(passages(words_of(t))) for t in batch.column(0).to_pylist()], pa.int64())], ["n"])

    total = with_texts(items).select("text").mapInArrow(counted, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0
    passes = max(1, -(-total // (RANK * PARTS)))
    out = None
    for turn in range(passes):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == turn)
        found = _pass(docs, part, idf, id_col, text_col, schema)
        out = found if out is None else out.union(found)
    return out


def _pass(docs: DataFrame, items: DataFrame, idf: np.ndarray, id_col: str, text_col: str, schema: str) -> DataFrame:
    kept = [(r["item_id"], words_of(r["text"]), r["answer"]) for r in items.collect()]  # about RANK * PARTS passages
    kept = [(i, w, answer_of(w, a)) for i, w, a in kept if w]
    cut = [(k, passage) for k, (_, words, _) in enumerate(kept) for passage in passages(words)]
    sent = pa.table({"part": pa.array([j // RANK for j in range(len(cut))], pa.int64()), "words": pa.array([b" ".join(p) for _, p in cut], pa.binary())})
    bases = latent_bases(docs.sparkSession.createDataFrame(sent), idf) if cut else {}
    hashed = Hashed()
    parts = []
    for part, (held, basis) in sorted(bases.items()):
        row_of = np.zeros(FEATURES, np.int64)
        row_of[held] = np.arange(len(held))
        mine = cut[part * RANK:(part + 1) * RANK]
        made = [row_and_length(hashed.of(passage), idf) for _, passage in mine]
        latent = np.array([values @ basis[row_of[used]] for used, values, _ in made], np.float32)
        latent = latent / np.maximum(np.sqrt((latent ** 2).sum(axis=1)), 1e-12)[:, None]
        parts.append((held, basis @ latent.T, np.array([x for _, _, x in made], np.float32), np.array([k for k, _ in mine], np.int64)))
    kind_names = ["doc_id", "item_id", "at", "cosine", "lcs", "answer"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hashed()
        mass = idf.astype(np.float64) ** 2
        # What one occurrence of a word adds at most to the cosine with a passage of the part, and to how much of it is covered.
        gain, cover = np.zeros((len(parts), FEATURES)), np.zeros((len(parts), FEATURES))
        rows_of = np.full((len(parts), FEATURES), -1, np.int32)
        for p, (held, reach, length, _) in enumerate(parts):
            rows_of[p, held] = np.arange(len(held))
            gain[p, held] = idf[held] * reach.max(axis=1, initial=0)
            cover[p, held] = idf[held] * (reach / length).max(axis=1, initial=0)

        def windows(rows: np.ndarray, ids: np.ndarray, edges: np.ndarray) -> np.ndarray:
            sums = np.add.reduceat(rows[:, ids], edges, axis=1)
            sums[:, :-1] += sums[:, 1:].copy()
            return sums

        def judge(words: list[bytes]) -> list[tuple[int, int, float, float, float]]:
            ids = hashed.of(words)
            edges = np.arange(0, len(ids), STRIDE)
            whole = windows(mass[None], ids, edges)
            # An upper bound of the cosine: c equal words add at most c times one word's gain, and at least TF_LOSS times c
            # times its mass to the squared length, as (1 + log c) ** 2 >= TF_LOSS * c up to a window's words.
            near = windows(gain, ids, edges) >= COSINE * np.sqrt(TF_LOSS * whole)
            near |= windows(cover, ids, edges) >= COVERED
            some = np.flatnonzero(near.any(axis=0))
            if not len(some):
                return []
            found: list[tuple[float, int, int]] = []
            for w in some.tolist():
                s = int(edges[w])
                used, values, length = row_and_length(ids[s:s + WINDOW], idf)
                values = values.astype(np.float32)
                for p in np.flatnonzero(near[:, w]).tolist():
                    _, reach, lengths, owner = parts[p]
                    row = rows_of[p, used]
                    cosine = values[row >= 0] @ reach[row[row >= 0]]
                    for q in np.flatnonzero((cosine >= COSINE) | (cosine * length >= COVERED * lengths)).tolist():
                        found.append((float(cosine[q]), s, int(owner[q])))
            best: dict[int, tuple[int, int, float, float, float]] = {}
            for cosine, s, k in sorted(found, key=lambda x: -x[0]):
                if k in best and best[k][3] >= LCS:
                    continue
                _, item, answer = kept[k]
                around = words[max(0, s - len(item)):s + WINDOW + len(item)]
                lcs = common_subsequence(item, around) / len(item)
                if lcs < LCS_WITH_ANSWER or k in best and best[k][3] >= lcs:
                    continue
                said = common_subsequence(answer, around) / len(answer)
                if lcs >= LCS or said >= ANSWER:
                    best[k] = (k, s, cosine, lcs, said)
            return list(best.values())

        for batch in small(batches, 1):
            found = []
            for doc_id, text in zip(batch.column(0), batch.column(1).to_pylist()):
                words = words_of(text)
                if words and kept:
                    found += [(doc_id, *f) for f in judge(words)]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[0].as_py() for f in found], batch.schema.field(0).type),
                     pa.array([kept[f[1]][0] for f in found]),
                     pa.array([f[2] for f in found], pa.int64()), *(pa.array([f[c] for f in found], pa.float64()) for c in (3, 4, 5))],
                    kind_names)

    return with_texts(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
