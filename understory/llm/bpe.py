"""Byte-level BPE in DuckDB: recursive queries contract pairs, ordered aggregation decodes.

Every worker splits its texts by the vocabulary's pattern and hands the distinct words that it has not met yet to an
in-process DuckDB. In each round of a recursive query every token position of a word is a row, which joins the merge table
by the token and its neighbour; each word's leftmost pair of least rank is contracted, until no pair has a rank.
"""

from __future__ import annotations

import base64
import tempfile
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from understory.llm.worker import Remembered, kept, small, with_texts

#: Words whose ids a worker remembers in either of two generations; words and ids for one DuckDB query.
WORDS = 300_000
WORDS_AT_ONCE = 30_000
LONG = 64
IDS_AT_ONCE = 500_000

ENCODE = """
WITH RECURSIVE step AS (
  SELECT w, ids, 0 AS n FROM start
  UNION ALL
  SELECT s.w, list_concat(s.ids[:b.best % 1048576 - 1], [b.best // 1048576], s.ids[b.best % 1048576 + 2:]), s.n + 1
  FROM step AS s JOIN (
    SELECT w, min(rank * 1048576 + i) AS best
    FROM (SELECT w, (unnest(ids[:-2]) << 32) | unnest(ids[2:]) AS pair, unnest(range(1, len(ids))) AS i FROM step)
    JOIN merges USING (pair) GROUP BY w) AS b USING (w))
SELECT w, arg_max(ids, n) AS ids FROM step GROUP BY w ORDER BY w
"""
#: The same for long words, a row for each token: of all occurrences of the least pair those are contracted at once, from
#: left to right without overlap, that come up to the first whose new token forms a pair of lower rank with a neighbour
#: (one at a time would contract just these). A swallowed token is NULL; only the newest row of a place is kept.
ENCODE_LONG = """
WITH RECURSIVE step USING KEY (w, p) AS (
  SELECT w, p, t FROM start
  UNION
  SELECT w, p, CASE WHEN hit THEN best WHEN NOT gone THEN t END AS t FROM (
    SELECT w, p, t, best, hit, coalesce(lag(hit) OVER (PARTITION BY w ORDER BY p), false) AS gone
    FROM (
      SELECT w, p, t, best, fits AND p <= coalesce(min(p) FILTER (fits AND (l.rank < best OR r.rank < best)) OVER (PARTITION BY w), p) AS hit
      FROM (
        SELECT w, p, t, best, fits,
               CASE WHEN fits THEN (CASE WHEN lag(fits, 2, false) OVER word THEN best ELSE lag(t) OVER word END << 32) | best END AS left_pair,
               CASE WHEN fits THEN (best << 32) | lead(t, 2) OVER word END AS right_pair
        FROM (
          SELECT w, p, t, best, least_pair AND row_number() OVER (PARTITION BY w, least_pair, i - nth ORDER BY p) % 2 = 1 AS fits
          FROM (
            SELECT *, row_number() OVER (PARTITION BY w, least_pair ORDER BY p) AS nth
            FROM (
              SELECT *, rank IS NOT DISTINCT FROM best AS least_pair
              FROM (
                SELECT w, p, t, i, rank, min(rank) OVER (PARTITION BY w) AS best
                FROM (SELECT w, p, t::BIGINT AS t, row_number() OVER word AS i, (t::BIGINT << 32) | lead(t) OVER word AS pair
                      FROM recurring.step WHERE t IS NOT NULL WINDOW word AS (PARTITION BY w ORDER BY p))
                LEFT JOIN merges USING (pair))
              WHERE best IS NOT NULL)))
        WINDOW word AS (PARTITION BY w ORDER BY p))
      LEFT JOIN merges AS l ON l.pair = left_pair
      LEFT JOIN merges AS r ON r.pair = right_pair)))
SELECT w, list(t ORDER BY p) AS ids FROM step WHERE t IS NOT NULL GROUP BY w ORDER BY w
"""
DECODE = """
SELECT d, unhex(string_agg(h, '' ORDER BY p)) AS bytes FROM tokens JOIN vocabulary USING (t) GROUP BY d ORDER BY d
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Bpe:
    """One worker's DuckDB with the merge table and the vocabulary of ``ranks``."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, words: int = WORDS):
        import duckdb
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        self.known = Remembered(words)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": tempfile.gettempdir()})
        self.ordered = sorted(ranks)
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        pairs = pa.table({"pair": np.array(left, np.int64) << 32 | np.array(right, np.int64), "rank": np.array(rank, np.int64)})
        self._load("merges", pairs)
        self._load("vocabulary", pa.table({"t": np.array(list(ranks.values()), np.int32), "h": [k.hex() for k in ranks]}))

    def _load(self, name: str, table: pa.Table) -> None:
        self.db.register("given", table)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _contract(self, words: list[bytes]) -> list[bytes]:
        size = np.array([len(w) for w in words], dtype=np.int64)
        token = self.single[np.frombuffer(b"".join(words), np.uint8)]
        if len(words[-1]) > LONG:
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            start = {"w": np.repeat(np.arange(len(words), dtype=np.int32), size), "p": place.astype(np.int32), "t": token}
        else:
            ends = np.append(0, np.cumsum(size)).astype(np.int32)
            start = {"w": np.arange(len(words), dtype=np.int32), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(token))}
        self.db.register("start", pa.table(start))
        ids = self.db.sql(ENCODE_LONG if len(words[-1]) > LONG else ENCODE).to_arrow_table().column("ids").combine_chunks()
        self.db.unregister("start")
        if isinstance(ids, pa.ChunkedArray):
            ids = pa.concat_arrays(ids.chunks)
        flat, ends = ids.values.to_numpy().astype("<u4").tobytes(), ids.offsets.to_numpy() * 4
        return [flat[a:b] for a, b in zip(ends, ends[1:])]

    def _cut(self, raw: bytes) -> list[bytes]:
        """The pieces of a word between the places that no token of the vocabulary spans, which no contraction crosses."""
        pieces, start, far = [], 0, 1
        for a in range(len(raw)):
            if a == far:
                pieces.append(raw[start:a])
                start, far = a, a + 1
            end = far + 1
            while end <= len(raw):
                piece = raw[a:end]
                k = bisect_left(self.ordered, piece)
                if k == len(self.ordered) or not self.ordered[k].startswith(piece):
                    break
                if self.ordered[k] == piece:
                    far = end
                end += 1
        return [*pieces, raw[start:]]

    def learn(self, unknown: set[str]) -> None:
        """A word that is one token is that token; all others, short ones first, go through the recursive query."""
        known, new, long = self.known.young, [], []
        for word in unknown:
            raw = word.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                known[word] = rank.to_bytes(4, "little")
            elif len(raw) > LONG:
                long.append((word, self._cut(raw)))
            else:
                new.append((word, raw))
        self._learn_all(new, known)
        if long:
            pieces: dict[bytes, bytes] = {}
            whole = {p for _, parts in long for p in parts}
            pieces |= {p: self.ranks[p].to_bytes(4, "little") for p in whole if p in self.ranks}
            self._learn_all([(p, p) for p in whole if p not in self.ranks], pieces)
            known |= {word: b"".join([pieces[p] for p in parts]) for word, parts in long}

    def _learn_all(self, new: list[tuple[str | bytes, bytes]], known: dict) -> None:
        """The ids of words, each given with its bytes, in batches of short or long ones."""
        new.sort(key=lambda x: len(x[1]))
        k = 0
        while k < len(new):
            j, size, long = k, 0, len(new[k][1]) > LONG
            while j < len(new) and j - k < WORDS_AT_ONCE and size < 16 * WORDS_AT_ONCE and (len(new[j][1]) > LONG) == long:
                size += len(new[j][1])
                j += 1
            known |= zip((w for w, _ in new[k:j]), self._contract([r for _, r in new[k:j]]))
            k = j

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        words = [self.split(t) for t in texts]
        self.learn(self.known.missing(set().union(*words)))
        known = self.known.young
        return [np.frombuffer(b"".join([known[w] for w in ws]), "<u4") for ws in words]

    def decode(self, rows: list[np.ndarray]) -> list[bytes]:
        """The bytes of every row of ids; rows beyond ``IDS_AT_ONCE`` ids are decoded in pieces."""
        out = [b""] * len(rows)
        cuts = [(i, row[k:k + IDS_AT_ONCE]) for i, row in enumerate(rows) for k in range(0, len(row), IDS_AT_ONCE)]
        k = 0
        while k < len(cuts):
            j, size = k, 0
            while j < len(cuts) and (j == k or size + len(cuts[j][1]) <= IDS_AT_ONCE):
                size += len(cuts[j][1])
                j += 1
            flat = np.concatenate([c for _, c in cuts[k:j]]).astype(np.int32)
            piece = np.repeat(np.arange(k, j, dtype=np.int32), [len(c) for _, c in cuts[k:j]])
            self.db.register("tokens", pa.table({"d": piece, "p": np.arange(len(flat), dtype=np.int32), "t": flat}))
            for d, raw in self.db.sql(DECODE).fetchall():
                out[cuts[d][0]] += raw
            self.db.unregister("tokens")
            k = j
        return out


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return with_texts(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _run(docs: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str, decoded: bool, words: int) -> DataFrame:
    ranks = read_ranks(ranks_path)
    version = zlib.crc32(repr(sorted(ranks.items())).encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for batch in small(batches, 1):
            bpe = bpe or kept(("bpe", version, pattern, words), lambda: Bpe(ranks, pattern, words))
            ids = bpe.encode(batch.column(1).to_pylist())
            cols, names = [batch.column(0), _lists(ids)], ["doc_id", "ids"]
            if decoded:
                cols, names = [*cols, pa.array(bpe.decode(ids), pa.binary())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema[id_col].dataType.simpleString()
    return _texts(docs, id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, ids array<int>" + ", decoded binary" * decoded)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``(doc_id, ids)`` of every whole text, one row for each row of ``docs``.

    NULL and empty texts give an empty list, an empty table no rows; rows may repeat, ids may be NULL, and further
    columns are not read. Special tokens are ordinary text. ``words`` bounds a worker's memory of words.
    """
    return _run(docs, ranks_path, pattern, id_col, text_col, False, words)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``(doc_id, ids, decoded)``: like ``encode`` followed by ``decode``, in one pass over the texts."""
    return _run(docs, ranks_path, pattern, id_col, text_col, True, words)


def decode(tokens: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, decoded)``: the bytes of every list of ids. NULL and empty lists give no bytes; ids outside the
    vocabulary have none and are passed over."""
    ranks = read_ranks(ranks_path)
    version = zlib.crc32(repr(sorted(ranks.items())).encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            bpe = bpe or kept(("bpe", version, ""), lambda: Bpe(ranks, ""))
            rows = [np.array(r or [], dtype=np.int64) for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bpe.decode(rows), pa.binary())], ["doc_id", "decoded"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(
        run, f"doc_id {kind}, decoded binary")
