"""Token ids in flat binary files with 64-bit document offsets, written and memory-mapped by the tasks."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from understory.llm.worker import Remembered, kept, small, with_texts
from understory.session import new_path, written

END_ID = 0
#: Chunks whose ids a worker remembers in either of two generations.
CHUNKS = 300_000
#: Bytes of text that a task takes up at a time.
BATCH = 2_000_000
#: Chunks that the library encodes as one text.
JOINED = 256


class Ids:
    """Ids (as little-endian bytes) of whole texts by the tokenizers library, which encodes every distinct chunk once.

    Texts are cut before their blanks. The byte-level pattern cuts there too, unless the blank stands within, or at the
    end of a text after, other white space; texts with such blanks are encoded in one piece.
    """

    def __init__(self, vocabulary: str, kind: str):
        import os
        import re

        # The library's own threads would take cores from other tasks; it reads this when it first encodes a batch.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.unsafe = re.compile(r"\s (?:\s|\Z)").search
        self.code, self.kind = {"<u2": "H", "<u4": "I"}[kind], kind
        self.chunks = Remembered(CHUNKS)
        vocabulary_ids = self.tokenizer.get_vocab()
        # Byte-level vocabularies write the blank as this letter.
        self.opens = np.zeros(max(vocabulary_ids.values(), default=0) + 1, bool)
        self.opens[[i for token, i in vocabulary_ids.items() if token.startswith("\u0120")]] = True

    def encoded(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def with_blanks(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        """The ids of each chunk after one blank. Chunks without white space at their ends are encoded many at a time.

        Only a chunk's first token can start with a blank there, so such tokens part the ids again.
        """
        plain = [c for c in chunks if c and c.strip() == c]
        alone = [c for c in chunks if not c or c.strip() != c]
        groups = [plain[k:k + JOINED] for k in range(0, len(plain), JOINED)]
        for group, raw in ((g, r) for k in range(0, len(groups), 64)
                           for g, r in zip(groups[k:k + 64], self.encoded([" " + " ".join(g) for g in groups[k:k + 64]]))):
            starts = np.flatnonzero(self.opens[np.frombuffer(raw, self.kind)]) * np.dtype(self.kind).itemsize
            if len(starts) == len(group) and starts[0] == 0:
                cuts = [*starts.tolist(), len(raw)]
                yield from zip(group, map(raw.__getitem__, map(slice, cuts, cuts[1:])))
            else:
                alone += group
        for k in range(0, len(alone), 20_000):
            part = alone[k:k + 20_000]
            yield from zip(part, self.encoded([" " + c for c in part]))

    def of(self, texts: pa.StringArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, ``end_id`` behind each, and how many each text has.

        A text is its first chunk, or the whole of an unsafe text, then its other chunks and the end. Arrow numbers the
        distinct chunks of the batch; their ids are looked up or made once and laid out by those numbers.
        """
        plain = texts.to_pylist()
        whole = np.array([self.unsafe(t) is not None for t in plain], bool)
        lists = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        offsets = lists.offsets.to_numpy()
        coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        first = offsets[:-1] - offsets[0]
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        entry = coded.indices.to_numpy()
        # A first chunk has no blank before it, so only chunks that stand elsewhere too are looked up.
        used = np.bincount(entry, minlength=len(chunks)) > np.bincount(entry[first], minlength=len(chunks))
        number = np.cumsum(used) - 1
        chunks = [c for c, u in zip(chunks, used.tolist()) if u]
        self.chunks.young |= self.with_blanks(list(self.chunks.missing(set(chunks))))
        heads = self.encoded([t if w else t.partition(" ")[0] for t, w in zip(plain, whole.tolist())])
        known = [*map(self.chunks.young.__getitem__, chunks), *heads, np.array([end_id], self.kind).tobytes()]

        sizes = np.fromiter(map(len, known), np.int64, len(known)) // np.dtype(self.kind).itemsize
        starts = np.cumsum(sizes) - sizes
        places = number[entry]
        places[first] = len(chunks) + np.arange(len(plain))
        places = np.insert(places, np.append(first[1:], len(places)), len(known) - 1)
        length = sizes[places]
        behind = np.cumsum(length)
        ids = np.frombuffer(b"".join(known), self.kind)[np.repeat(starts[places] - behind + length, length) + np.arange(length.sum())]
        return ids, np.diff(behind[np.append(first[1:], len(entry)) + np.arange(len(plain))], prepend=0)


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def mapped(uri: str, kind: str) -> Callable[[int, int], np.ndarray]:
    """``(start, end) -> values`` of a flat file: memory-mapped on a local or mounted path, ranged reads elsewhere."""
    from pyarrow import fs

    store, path = _opened(uri)
    if isinstance(store, fs.LocalFileSystem):
        if not store.get_file_info(path).size:
            return lambda start, end: np.zeros(0, kind)
        values = np.memmap(path, dtype=kind, mode="r")
        return lambda start, end: values[start:end]
    file, size = store.open_input_file(path), np.dtype(kind).itemsize
    return lambda start, end: np.frombuffer(file.read_at((end - start) * size, start * size), dtype=kind)


def write_token_files(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Encode whole texts and write ``part-N.bin`` (ids) and ``part-N.idx`` (64-bit offsets) in ascending id order.

    Returns the index, a written table: ``doc_id, part, place, n_tokens, uri, kind``. The vocabulary is a byte-level BPE of the
    tokenizers library; texts are encoded without special tokens, and ``end_id`` ends each document.
    NULL and empty texts are just ``end_id``. Rows without an id come first; rows with equal ids are ordered by hash and
    text. An empty table gives no files. Every task writes its own files under another name and then renames them, so
    a task that runs again changes nothing. Ranges are dealt by (id, text hash), so one repeated id spreads as well.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = file.read()
    kind = "<u2" if max(Tokenizer.from_str(vocabulary).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    target = folder or new_path(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("token ids", vocabulary, kind), lambda: Ids(vocabulary, kind))
        part, task = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store, path = _opened(target)
        store.create_dir(path)
        name = f"{path}/part-{part:06d}"
        at, place, started = 0, 0, False
        bin_file = idx_file = None

        for batch in small(batches, 1, BATCH):
            if not started:
                bin_file = store.open_output_stream(f"{name}.bin.{task}", compression=None)
                idx_file = store.open_output_stream(f"{name}.idx.{task}", compression=None)
                idx_file.write(np.zeros(1, "<u8").tobytes())
                started = True
            made, counts = encoder.of(pc.fill_null(batch.column(1), ""), end_id)
            bin_file.write(made.tobytes())
            idx_file.write((at + np.cumsum(counts)).astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(counts), part, np.int32)), pa.array(np.arange(place, place + len(counts))),
                 pa.array(counts)], ["doc_id", "part", "place", "n_tokens"])
            at, place = at + int(counts.sum()), place + len(counts)
        if started:
            for file, end_name in ((bin_file, "bin"), (idx_file, "idx")):
                file.close()
                store.move(f"{name}.{end_name}.{task}", f"{name}.{end_name}")

    id_kind = docs.schema[id_col].dataType.simpleString()
    chosen = with_texts(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = chosen.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    index = ordered.mapInArrow(run, f"doc_id {id_kind}, part int, place long, n_tokens long")
    return written(index.select("*", F.lit(target).alias("uri"), F.lit(kind).alias("kind")), "token-index")


def bases(index: DataFrame) -> dict[int, int]:
    """The number of ids before each part; the driver sees one sum for each file, never a document."""
    totals = sorted((r["part"], r["n"]) for r in index.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    ends = np.cumsum([0, *(n for _, n in totals)])
    return {part: int(e) for (part, _), e in zip(totals, ends)}


def map_documents(index: DataFrame, function: Callable[[np.ndarray], object], name: str, kind: str) -> DataFrame:
    """``doc_id, start, n_tokens`` and ``function(ids)`` of every document, read back from the memory-mapped files.

    ``start`` counts the ids of all documents before it, over all files: a part's base and the offset within it.
    """
    base = bases(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[int, tuple] = {}
        for batch in batches:
            starts, sizes, out = [], [], []
            for part, place, uri, item in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                if part not in files:
                    files.clear()
                    files[part] = tuple(mapped(f"{uri.rstrip('/')}/part-{part:06d}.{e}", k) for e, k in (("bin", item), ("idx", "<u8")))
                ids, offsets = files[part]
                first, last = (int(v) for v in offsets(place, place + 2))
                starts.append(base[part] + first)
                sizes.append(last - first)
                out.append(function(ids(first, last)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(out)],
                ["doc_id", "start", "n_tokens", name])

    id_kind = index.schema["doc_id"].dataType.simpleString()
    return index.select("doc_id", "part", "place", "uri", "kind").mapInArrow(
        run, f"doc_id {id_kind}, start long, n_tokens long, {name} {kind}")


def read_ids(index: DataFrame) -> DataFrame:
    """Every document's ids, end id included."""
    return map_documents(index, lambda ids: ids.astype(np.int64).tolist(), "ids", "array<long>")


def checksums(index: DataFrame) -> DataFrame:
    """CRC-32 of every document's ids as little-endian unsigned 32-bit integers."""
    return map_documents(index, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "ids_crc32", "long")
