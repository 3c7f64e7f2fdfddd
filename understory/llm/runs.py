"""Maximal periodic runs of words, found on a grammar of the texts, and the texts with their runs collapsed.

The words of a batch of texts are numbered and Re-Pair turns them into a grammar: in every round pairs of symbols that
occur at least twice become new nonterminals, the more frequent pair first where two overlap, until no pair occurs twice.
What is left of a text is halved by a balanced tree. Each run lies whole in the least nonterminal that holds all of it,
and crosses the boundary of its two parts there. So the runs over each nonterminal's boundary are computed once, on one
of its occurrences, then put at all places where the grammar derives it, and those that a longer one of the same period
holds are taken out.

A run of ``EXPONENT`` periods or more over a boundary has two periods, a square, wholly on one side of it, next to the
boundary. These squares are told by prefix hashes of the word numbers, and every run found is compared word by word.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from understory.llm.worker import small, with_texts

#: Least length of a run in words and in periods. The search relies on EXPONENT being 4 or more.
LENGTH, EXPONENT = 6, 4
#: Boundary tests made at once.
TESTS = 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Hashed:
    """Numbered words with prefix hashes modulo 2**64."""

    def __init__(self, ids: np.ndarray):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(32)
        self.ids = ids
        self.powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(ids), BASE))])
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed * self.powers[:-1])])

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether ``size`` words from ``a`` on hash like those from ``b`` on, ``a <= b``."""
        first, second = self.sums[a + size] - self.sums[a], self.sums[b + size] - self.sums[b]
        return first * self.powers[b - a] == second

    def reach(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
        """How many words agree from ``a`` and ``b`` on (step 1) or up to before them (step -1), at most ``limit``."""
        low, high = np.zeros_like(limit), limit.copy()
        while (low < high).any():
            size = (low + high + 1) // 2
            back = size if step < 0 else 0
            good = self.same(a - back, b - back, size)
            low, high = np.where(good, size, low), np.where(good, high, size - 1)
        return low


def spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sizes 2, 3: rows 0 0 1 1 1 and places 0 1 0 1 2."""
    rows = np.repeat(np.arange(len(sizes)), sizes)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def crossing(text: Hashed, start: np.ndarray, cut: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Runs inside ``[start, end)`` over the boundary ``cut`` of each node: node, start, end, period."""
    most = (end - start) // EXPONENT
    widths = [np.minimum((end - cut) // 2, most), np.minimum((cut - start) // 2, most)]
    todo = np.flatnonzero((end - start >= LENGTH) & (widths[0] + widths[1] > 0))
    parts = []
    groups = np.cumsum((widths[0] + widths[1])[todo]) // TESTS
    for group in np.split(todo, np.flatnonzero(np.diff(groups)) + 1) if len(todo) else []:
        hits = []
        for side, width in enumerate(widths):
            rows, q = spread(width[group])
            node, q = group[rows], q + 1
            at = cut[node] - (2 * q if side else 0)
            good = text.same(at, at + q, q)
            hits.append((node[good], q[good], at[good]))
        node, q, at = (np.concatenate(c) for c in zip(*hits))
        order = np.lexsort((q, node))
        node, q, at = node[order], q[order], at[order]
        while len(node):
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            n, p, a = node[first], q[first], at[first]
            e = a + 2 * p + text.reach(a + p, a + 2 * p, end[n] - a - 2 * p, 1)
            s = a - text.reach(a, a + p, a - start[n], -1)
            parts.append((n, s, e, p))
            # What is left: squares that this periodic stretch does not hold; those that it holds repeat its period.
            back = np.cumsum(np.concatenate([[True], node[1:] != node[:-1]])) - 1
            left = (at < s[back]) | (at + 2 * q > e[back])
            node, q, at = node[left], q[left], at[left]
    if not parts:
        return [np.zeros(0, np.int64)] * 4
    n, s, e, p = (np.concatenate(c) for c in zip(*parts))
    good = (e - s >= np.maximum(LENGTH, EXPONENT * p)) & (s < cut[n]) & (e > cut[n])
    n, s, e, p = n[good], s[good], e[good], p[good]
    true = np.array([np.array_equal(text.ids[i:j - k], text.ids[i + k:j]) for i, j, k in zip(s, e, p)], bool)
    for k in np.flatnonzero(~true):
        s[k], e[k] = stretch(text.ids, start[n[k]], cut[n[k]], end[n[k]], p[k])
    good = true | (e - s >= np.maximum(LENGTH, EXPONENT * p))
    return [n[good], s[good], e[good], p[good]]


def stretch(ids: np.ndarray, start: int, cut: int, end: int, period: int) -> tuple[int, int]:
    """The longest stretch with the period over ``cut``, word by word: for hashes that agree where words do not."""
    unlike = start + np.flatnonzero(ids[start:end - period] != ids[start + period:end])
    edges = np.concatenate([[start - 1], unlike, [end - period]])
    spans = [(a + 1, b + period) for a, b in zip(edges, edges[1:]) if a + 1 < cut < b + period]
    return max(spans, key=lambda x: x[1] - x[0], default=(cut, cut))


def repaired(ids: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Nonterminals in rounds: number within the round, start, boundary and end of each place that derives it.

    ``last`` marks the last word of every text. After the rounds of Re-Pair come those of the balanced trees, whose
    nodes are nonterminals with one place each.
    """
    symbol, at = ids.astype(np.int64), np.arange(len(ids), dtype=np.int64)
    top = int(symbol.max(initial=0)) + 1
    active = ~last
    while True:
        where = np.flatnonzero(active)
        _, pair, counts = np.unique(symbol[where] * top + symbol[where + 1], return_inverse=True, return_counts=True)
        often = counts[pair] > 1
        where, pair = where[often], pair[often]
        if not len(where):
            break
        rank = np.empty(len(counts), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
        turn = np.full(len(symbol) + 1, len(counts), np.int64)
        turn[where] = rank[pair]
        # Stretches of one turn are repeated symbols: there every other pair is taken.
        new = np.concatenate([[True], turn[1:] != turn[:-1]])
        heads = np.flatnonzero(new)
        values = np.concatenate([[len(counts)], turn[heads], [len(counts)]])
        least = (values[1:-1] < values[:-2]) & (values[1:-1] < values[2:])
        group = np.cumsum(new) - 1
        taken = np.flatnonzero(least[group] & ((np.arange(len(turn)) - heads[group]) % 2 == 0))
        ends = np.append(at[1:], len(ids))
        rule = turn[taken]
        yield rule, at[taken], at[taken + 1], ends[taken + 1]
        fresh = np.zeros(len(symbol), bool)
        fresh[taken] = True
        active = np.zeros(len(symbol), bool)
        active[where] = True
        symbol[taken] = top + rule
        last[taken] = last[taken + 1]
        stay = np.ones(len(symbol), bool)
        stay[taken + 1] = False
        symbol, at, last, fresh, active = symbol[stay], at[stay], last[stay], fresh[stay], active[stay]
        active = (active | fresh | np.append(fresh[1:], False)) & ~last
        symbol = np.unique(symbol, return_inverse=True)[1]
        top = int(symbol.max()) + 1
    while not last.all():
        head = np.concatenate([[True], last[:-1]])
        place = np.arange(len(at)) - np.flatnonzero(head)[np.cumsum(head) - 1]
        taken = np.flatnonzero((place % 2 == 0) & ~last)
        ends = np.append(at[1:], len(ids))
        yield np.arange(len(taken)), at[taken], at[taken + 1], ends[taken + 1]
        last[taken] = last[taken + 1]
        stay = np.ones(len(at), bool)
        stay[taken + 1] = False
        at, last = at[stay], last[stay]


def maximal_runs(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all maximal runs of texts laid end to end, ``sizes`` words each; ordered by start, period."""
    last = np.zeros(len(ids), bool)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    text = Hashed(ids)
    found = []
    for rule, start, cut, end in repaired(ids, last):
        order = np.argsort(rule, kind="stable")
        heads = order[np.flatnonzero(np.concatenate([[True], np.diff(rule[order]) > 0]))]
        node, s, e, q = crossing(text, start[heads], cut[heads], end[heads])
        # Every place of the nonterminals that have runs.
        counts = np.bincount(rule)[rule[heads]]
        firsts = np.cumsum(counts) - counts
        rows, place = spread(counts[node])
        move = start[order[firsts[node][rows] + place]] - start[heads[node]][rows]
        found.append((s[rows] + move, e[rows] + move, q[rows]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    s, e, q = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((-e, s, q))
    s, e, q = s[order], e[order], q[order]
    reached = np.maximum.accumulate(q * (len(ids) + 1) + e) if len(s) else s
    whole = np.concatenate([[True], q[1:] * (len(ids) + 1) + e[1:] > reached[:-1]]) if len(s) else np.zeros(0, bool)
    s, e, q = s[whole], e[whole], q[whole]
    order = np.lexsort((q, s))
    return s[order], e[order], q[order]


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Word numbers of a text whose tail is made periodic, for one id in ten; None where the text stays as it is.

    The rule is the query's: it plants runs of known places. Rows without id stay as they are.
    """
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def collapsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              rewrite: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """Every row of ``docs``: ``doc_id``, ``n_words``, its maximal ``runs`` and the ``collapsed`` text.

    Words are what blanks (``\\x20 \\x09-\\x0D``) part. A run is a stretch of words with least period ``period``, of
    ``LENGTH`` words and ``EXPONENT`` periods at least, that no neighbouring word extends. ``runs`` are ordered by start,
    then period; ``collapsed`` keeps of every run its first period, and all words outside of runs, joined by one blank.
    ``rewrite`` may give the numbers of the words that a text is read as.

    NULL and empty texts have no words, no runs and an empty ``collapsed``. Repeated rows stay repeated, ids may be NULL,
    an empty table gives no rows, and further columns are not read. A long text is a batch of its own: memory and time
    grow with its length (times the logarithm), not with the square.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1):
            words = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch.column(1).to_pylist()]
            sizes = np.array([len(w) for w in words], np.int64)
            ends = np.cumsum(sizes)
            flat = pa.array([w for text in words for w in text], pa.binary())
            if rewrite is not None:
                read = np.arange(len(flat))
                for name, size, end in zip(batch.column(0).to_pylist(), sizes.tolist(), ends.tolist()):
                    order = rewrite(name, size)
                    if order is not None:
                        read[end - size:end] = end - size + order
                flat = flat.take(pa.array(read))
            ids = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            s, e, q = maximal_runs(ids, sizes)
            change = np.zeros(len(flat) + 1, np.int64)
            np.add.at(change, s + q, 1)
            np.add.at(change, e, -1)
            kept = np.cumsum(change[:-1]) == 0
            left = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(left), flat.filter(pa.array(kept)))
            text = [b" ".join(x) for x in lists.to_pylist()]
            doc = np.searchsorted(ends, s, side="right")
            at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(sizes)))]).astype(np.int32)
            rows = pa.StructArray.from_arrays([pa.array(s - (ends - sizes)[doc]), pa.array(e - s), pa.array(q)], fields=list(RUN))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.ListArray.from_arrays(pa.array(at), rows), pa.array(text, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    return with_texts(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
