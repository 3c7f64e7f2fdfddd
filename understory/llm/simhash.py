"""SimHash near-duplicate groups through deletion-variant signatures.

Fingerprints are linked when they differ in at most ``BITS`` of 64 bits. Cut into three segments, at least one
segment of a linked pair differs in at most one bit, so the pair shares that segment with one position wiped out.
Every distinct fingerprint is indexed under all its one-wildcard segment variants, equal variants meet, and each
pair is verified on all 64 bits. Buckets never spell out all their pairs: a spanning forest of each bucket is enough
for the groups. A bucket that grows too large is dealt out again by variants of its remaining bits, which is exact
too, so no task has to hold an unbounded bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from understory.llm.graph import components
from understory.llm.worker import small, with_texts
from understory.session import written

SHINGLE = 4
BITS = 4
SEED = 42
#: Fingerprints in a bucket beyond which it is dealt out again by its remaining bits.
BUCKET = 20_000
#: Buckets up to this size compare their pairs at once, larger ones grow a spanning forest.
SMALL = 16
HASHES_AT_ONCE = 65_536


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a whole text, unsigned; zero for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        at = [0, *accumulate(len(w) + 1 for w in words)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b - 1], SEED) for a, b in zip(at, at[shingle:])]
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), HASHES_AT_ONCE):
        part = np.array(hashes[k:k + HASHES_AT_ONCE], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = counts * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row ``(doc_id, fp)`` for each row of ``docs``, the fingerprint as a signed long. NULL counts as an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1):
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return with_texts(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, fp long")


def thirds(width: int) -> list[tuple[int, int]]:
    """(shift, width) of the three segments of ``width`` bits: of 4 differing bits one of them has at most one."""
    part = width // (BITS // 2 + 1)
    return [(0, part), (part, part), (2 * part, width - 2 * part)]


def without(bits: np.ndarray, shift: int, width: int) -> np.ndarray:
    """The bits that are left once a segment is cut out."""
    low = bits & np.uint64((1 << shift) - 1)
    return ((bits >> np.uint64(shift + width)) << np.uint64(shift)) | low


def segment(bits: np.ndarray, shift: int, width: int) -> np.ndarray:
    return (bits >> np.uint64(shift)) & np.uint64((1 << width) - 1)


def variant_keys(bits: np.ndarray, width: int) -> list[np.ndarray]:
    """One key array for each segment and wiped-out position: segment, position and the bits that stay."""
    keys = []
    for cut, (shift, size) in enumerate(thirds(width)):
        seg = segment(bits, shift, size)
        for wild in range(size):
            kept = seg & np.uint64(~(1 << wild) & ((1 << size) - 1))
            keys.append(np.uint64((cut * 32 + wild) << 24) | kept)
    return keys


def indexed(fps: np.ndarray, path: list[np.ndarray]) -> list[np.ndarray]:
    """Index rows of fingerprints that met in the buckets ``path`` so far: the old keys, the new one, the fingerprint."""
    parts: list[list[np.ndarray]] = []
    cuts = [(k >> 24).astype(np.int64) // 32 for k in path]
    where = np.zeros(len(fps), np.int64)
    for c in cuts:
        where = where * 3 + c
    for combo in np.unique(where) if len(fps) else []:
        rows = np.flatnonzero(where == combo)
        bits, width = fps[rows], 64
        for c in cuts:
            shift, size = thirds(width)[int(c[rows[0]])]
            bits, width = without(bits, shift, size), width - size
        keys = variant_keys(bits, width)
        again = np.tile(rows, len(keys))
        parts.append([*(k[again].view(np.int64) for k in path), np.concatenate(keys).view(np.int64), fps[again].view(np.int64)])
    if not parts:
        return [np.zeros(0, np.int64)] * (len(path) + 2)
    return [np.concatenate(c) for c in zip(*parts)]


def first_meeting(key: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """True where this first-level bucket is the first one in which the pair meets, so each pair counts in one bucket only."""
    cut, wild = (key >> np.uint64(24)) // np.uint64(32), (key >> np.uint64(24)) % np.uint64(32)
    good = np.ones(len(differ), bool)
    for c, (shift, size) in enumerate(thirds(64)):
        seg = segment(differ, shift, size)
        own = cut == c
        good &= ~own | (seg == np.uint64(1) << wild) | ((seg == 0) & (wild == 0))
        good &= ~(cut > c) | (np.bitwise_count(seg) > 1)
    return good


def forest(fps: np.ndarray, key: np.uint64 | None) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among distinct fingerprints: each one is reached at most once."""
    left, a, b = fps, [], []
    queue: list[np.uint64] = []
    while len(left):
        if queue:
            at = queue.pop()
        else:
            at, left = left[0], left[1:]
        differ = left ^ at
        near = np.bitwise_count(differ) <= BITS
        if key is not None and near.any():
            near[near] = first_meeting(np.full(int(near.sum()), key), differ[near])
        if near.any():
            found = left[near]
            a.append(np.full(len(found), at))
            b.append(found)
            queue.extend(found)
            left = left[~near]
    none = np.zeros(0, np.uint64)
    return np.concatenate(a) if a else none, np.concatenate(b) if b else none


def bucket_links(keys: list[np.ndarray], fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within runs of equal keys: all pairs of small runs, a spanning forest of large ones."""
    if not len(fps):
        return fps, fps
    new = np.ones(len(fps), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(fps)))
    run = np.cumsum(new) - 1
    first_level = len(keys) == 1
    a, b = [], []
    small = (sizes[run] <= SMALL) & (sizes[run] > 1)
    for step in range(1, SMALL):
        i = np.flatnonzero(small[:-step] & (run[:-step] == run[step:])) if step < len(fps) else np.zeros(0, np.int64)
        if not len(i):
            break
        differ = fps[i] ^ fps[i + step]
        near = np.bitwise_count(differ) <= BITS
        i, differ = i[near], differ[near]
        if first_level:
            i = i[first_meeting(keys[0][i], differ)]
        a.append(fps[i])
        b.append(fps[i + step])
    for s in np.flatnonzero(sizes > SMALL):
        rows = slice(starts[s], starts[s] + sizes[s])
        x, y = forest(fps[rows], keys[0][starts[s]] if first_level else None)
        a.append(x)
        b.append(y)
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def level_links(index: DataFrame, names: list[str], limit: int | None) -> DataFrame:
    """Rows ``(later, keys, a, b)``: links, or with ``later`` the fingerprints ``a`` of buckets over ``limit``."""
    n = len(names)
    schema = "later boolean, " + ", ".join(f"{k} long" for k in names) + ", a long, b long"

    def rows(later: bool, keys: list[np.ndarray], a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        flags = pa.array(np.full(len(a), later))
        second = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
        return pa.RecordBatch.from_arrays(
            [flags, *(pa.array(k.view(np.int64)) for k in keys), pa.array(a.view(np.int64)), second],
            ["later", *names, "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.uint64) for _ in range(n + 1)]
        over = None
        for batch in batches:
            cols = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64)])
                    for i, h in enumerate(held)]
            if over is not None:
                same = np.logical_and.reduce([cols[i] == over[i] for i in range(n)])
                if same.any():
                    yield rows(True, [c[same] for c in cols[:n]], cols[n][same], None)
                    cols = [c[~same] for c in cols]
                if len(cols[0]):
                    over = None
            if not len(cols[0]):
                held = cols
                continue
            last = np.logical_and.reduce([cols[i] == cols[i][-1] for i in range(n)])
            done, held = [c[~last] for c in cols], [c[last] for c in cols]
            yield from finish(done)
            if limit is not None and len(held[0]) > limit:
                over = [c[0] for c in held[:n]]
                yield rows(True, held[:n], held[n], None)
                held = [c[:0] for c in held]
        yield from finish(held)

    def finish(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if limit is not None and len(cols[0]):
            new = np.ones(len(cols[0]), bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in cols[:n]])
            sizes = np.diff(np.append(np.flatnonzero(new), len(new)))
            wide = (sizes > limit)[np.cumsum(new) - 1]
            if wide.any():
                yield rows(True, [c[wide] for c in cols[:n]], cols[n][wide], None)
                cols = [c[~wide] for c in cols]
        a, b = bucket_links(cols[:n], cols[n])
        if len(a):
            blank = np.zeros(len(a), np.uint64)
            yield rows(False, [blank] * n, a, b)

    return index.repartition(*names).sortWithinPartitions(*names, "fp").mapInArrow(run, schema)


def links(fps: DataFrame, limit: int = BUCKET) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints (column ``fp``) that join all those within ``BITS`` bits into groups."""
    found = []
    names: list[str] = []
    level = fps.select("fp")
    for depth in (1, 2, 3):
        names = [*names, f"k{depth}"]
        width = depth + 1

        def variants(batches: Iterator[pa.RecordBatch], n: int = depth - 1) -> Iterator[pa.RecordBatch]:
            out = [*(f"k{i + 1}" for i in range(n + 1)), "fp"]
            for batch in batches:
                cols = [batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(n + 1)]
                for k in range(0, len(cols[n]), 4096):
                    made = indexed(cols[n][k:k + 4096], [c[k:k + 4096] for c in cols[:n]])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], out)

        index = level.mapInArrow(variants, ", ".join(f"{c} long" for c in [*names, "fp"]))
        assert len(index.columns) == width
        out = written(level_links(index, names, limit if depth < 3 else None), "simhash-links")
        found.append(out.filter(~F.col("later")).select("a", "b"))
        level = out.filter("later").select(*names, F.col("a").alias("fp"))
        if level.isEmpty():
            break
    both = found[0]
    for other in found[1:]:
        both = both.union(other)
    return both


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    limit: int = BUCKET) -> DataFrame:
    """Every row of ``docs`` with its fingerprint and its group.

    Returns ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id that links of at most
    ``BITS`` differing bits reach. NULL and empty texts have fingerprint zero and are linked like any other; repeated
    rows stay repeated; rows whose whole group has no id get a NULL ``component_id``; an empty table gives no rows.
    Further columns of ``docs`` are not read.
    """
    marked = written(fingerprints(docs, id_col, text_col, shingle), "simhash")
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = components(links(classes, limit))
    rooted = classes.join(groups, classes["fp"] == groups["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
