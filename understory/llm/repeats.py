"""Long word sequences that occur more than once, found by recompression, and the texts without them.

Every text is a sequence of word names. Rounds of recompression shorten it: a round over runs names each stretch of one
repeated symbol, a round over pairs names the neighbours of which the first has an even and the second an odd name. A
name is a hash of what it stands for, so that every task gives equal content the same name and no dictionary has to be
shared. Each symbol knows its context, the words that decide that it comes about: wherever these words stand, the symbol
stands among them. So equal passages have the same symbols but for a few at their ends.

Spark then counts the names of the last round over all texts. A window of words around a symbol whose name occurs once
occurs once too. What is left, passages of shared symbols only, and windows without any symbol of their own, is compared
window by window; of equal whole texts one only. Names that clash could add candidates but lose none; windows and whole
texts are told by 95 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from understory.llm.worker import small, with_texts

WINDOW = 35
#: Rounds of recompression before the symbols are counted; a symbol then stands for 6 words in the mean.
ROUNDS = ("runs", "pairs", "pairs", "pairs", "runs", "pairs", "pairs", "pairs")
SEED = 42
FAR = np.int64(2 ** 40)
BASES = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
#: Pieces of the texts that one task looks over at a time for names and windows that repeat within it.
TEXT = 4_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_names(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Names of all words of the texts, end to end, and the number of words in each."""
    digest = xxhash.xxh64_intdigest
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    return np.fromiter((digest(w, SEED) for text in words for w in text), np.uint64, int(sizes.sum())), sizes


class Symbols:
    """The symbols of texts laid end to end: name, first word, and context from ``low`` up to ``high``."""

    def __init__(self, names: np.ndarray, sizes: np.ndarray):
        self.name = names
        self.low, self.high = np.arange(len(names)), np.arange(1, len(names) + 1)
        self.first = np.zeros(len(names), bool)
        ends = np.cumsum(sizes)
        self.first[(ends - sizes)[sizes > 0]] = True

    def sides(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every symbol: whether its text goes on behind it, and how far the neighbours' contexts go, endless at a text's ends."""
        before, behind = ~self.first, ~np.append(self.first[1:], True)
        low = np.where(before, np.concatenate([[0], self.low[:-1]]), -FAR)
        high = np.where(behind, np.append(self.high[1:], 0), FAR)
        return behind, low, high

    def keep(self, stay: np.ndarray) -> None:
        self.name, self.low, self.high, self.first = self.name[stay], self.low[stay], self.high[stay], self.first[stay]

    def runs(self) -> None:
        """Each stretch of one symbol becomes one symbol; that it ends there depends on the symbols around it."""
        if not len(self.name):
            return
        _, low, high = self.sides()
        heads = np.flatnonzero(self.first | np.concatenate([[True], self.name[1:] != self.name[:-1]]))
        tails = np.append(heads[1:], len(self.name)) - 1
        size = (tails - heads + 1).astype(np.uint64)
        self.name = np.where(size > 1, mixed(self.name[heads] + mixed(size)), self.name[heads])
        self.low, self.high, self.first = np.minimum(low[heads], self.low[heads]), np.maximum(high[tails], self.high[tails]), self.first[heads]

    def pairs(self, salt: int) -> None:
        """Even and odd neighbours become one symbol. That one stays alone depends on the neighbour it might have gone with."""
        if not len(self.name):
            return
        behind, low, high = self.sides()
        odd = (mixed(self.name + np.uint64(salt)) & np.uint64(1)).astype(bool)
        joined = ~odd & np.append(odd[1:], False) & behind
        second = np.concatenate([[False], joined[:-1]])
        alone = ~joined & ~second
        self.low = np.where(alone & odd, np.minimum(self.low, low), self.low)
        new_high = np.where(alone & ~odd, np.maximum(self.high, high), self.high)
        self.high = np.where(joined, np.append(self.high[1:], 0), new_high)
        self.low = np.where(joined, np.minimum(self.low, np.append(self.low[1:], FAR)), self.low)
        self.name = np.where(joined, mixed(self.name * np.uint64(3) + mixed(np.append(self.name[1:], np.uint64(0)))), self.name)
        self.keep(~second)


def symbols(names: np.ndarray, sizes: np.ndarray, window: int) -> Symbols:
    """The last round's symbols, those whose context fits into a window."""
    made = Symbols(names, sizes)
    for salt, kind in enumerate(ROUNDS):
        made.runs() if kind == "runs" else made.pairs(salt)
    made.keep(made.high - made.low <= window)
    return made


def over(low: np.ndarray, high: np.ndarray, size: int, window: int) -> np.ndarray:
    """How many of the contexts each window of ``size`` words holds."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, np.maximum(high - window, 0), 1)
    np.add.at(change, low + 1, -1)
    return np.cumsum(change[:-1])


def starts(sizes: np.ndarray, window: int) -> np.ndarray:
    """Where a whole window of one text starts."""
    ends = np.cumsum(sizes)
    return np.arange(int(sizes.sum())) + window <= np.repeat(ends, sizes)


def window_hashes(names: np.ndarray, at: np.ndarray, window: int) -> list[np.ndarray]:
    found = []
    for base, words in zip(BASES, (names, mixed(names))):
        value = np.zeros(len(at), np.uint64)
        for k in range(window):
            value = value * base + words[at + k]
        found.append(mixed(value))
    return found


#: Rows dealt out by name: a symbol, a whole text, a symbol known to repeat (or, ``at`` -1, a text with windows that hold no
#: symbol), a text known to be a copy.
SYMBOL, TEXT_ITSELF, KNOWN, COPY = range(4)


def repeated(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the values: which occur more than once, and the first place of each of these."""
    _, place, back, counts = np.unique(value, return_index=True, return_inverse=True, return_counts=True)
    return counts[back] > 1, place[counts > 1]


def stretches(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the stretches of marks."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def encoded(texts: pa.Array) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts.to_pylist()]


def _texts(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Rows with a key of their content; rows that are equal share it, which changes nothing, for they repeat each other."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return with_texts(docs).select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("key"),
                                   F.hash(text, F.col(id_col)).alias("check"))


def _names(texts: DataFrame, window: int) -> DataFrame:
    """``deal, kind, key, at``: symbols ``at`` (by number in their text) and whole texts, dealt out by name.

    A name that repeats within a task's piece of the texts goes out without a key, once for the piece, and its places
    go out as known. So a name that is everywhere costs a row a piece. Of a repeated text one copy goes out with its key.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(deal, kind, key, at) -> pa.RecordBatch:
            size = len(deal)
            at = pa.nulls(size, pa.int32()) if at is None else pa.array(at, pa.int32())
            key = pa.nulls(size, pa.int64()) if key is None else pa.array(key)
            return pa.RecordBatch.from_arrays([pa.array(deal), pa.array(np.full(size, kind), pa.int8()), key, at], ["deal", "kind", "key", "at"])

        for batch in small(batches, 0, TEXT):
            texts = encoded(batch.column(0))
            names, sizes = word_names(texts)
            made = symbols(names, sizes, window)
            ends = np.cumsum(sizes)
            doc = np.searchsorted(ends, made.low, side="right")
            place = np.arange(len(doc)) - np.searchsorted(doc, doc, side="left")
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            again, told = repeated(made.name)
            name = made.name.view(np.int64)
            yield rows(name[~again], SYMBOL, keys[doc[~again]], place[~again])
            yield rows(name[told], SYMBOL, None, None)
            yield rows(keys[doc[again]], KNOWN, keys[doc[again]], place[again])
            bare = starts(sizes, window) & (over(made.low, made.high, len(names), window) == 0)
            bare = keys[np.unique(np.repeat(np.arange(len(sizes)), sizes)[bare])]
            yield rows(bare, KNOWN, bare, np.full(len(bare), -1))
            long = np.flatnonzero(sizes >= window)
            whole = np.array([xxhash.xxh64_intdigest(texts[k], SEED + 1) for k in long], np.uint64).view(np.int64)
            check = np.array([xxhash.xxh32_intdigest(texts[k], SEED) & 0x7FFFFFFF for k in long], np.int64)
            again, told = repeated(whole)
            lead = ~again
            lead[told] = True
            yield rows(whole[lead], TEXT_ITSELF, keys[long[lead]], check[lead])
            yield rows(whole[told], TEXT_ITSELF, None, check[told])
            yield rows(keys[long[~lead]], COPY, keys[long[~lead]], np.full(int((~lead).sum()), -1))

    return texts.select("text", "key").mapInArrow(run, "deal long, kind byte, key long, at int")


def _shared(dealt: DataFrame) -> DataFrame:
    """``key, at, lead``: of every text the symbols that repeat, and if all of it does, whether it speaks for its copies."""
    same = Window.partitionBy("deal", "kind", "more")
    told = dealt.withColumn("more", F.when(F.col("kind") == TEXT_ITSELF, F.col("at")))
    counted = told.select("*", F.count(F.lit(1)).over(same).alias("n"), F.min("key").over(same).alias("least"))
    found = counted.filter(F.col("key").isNotNull() & (F.col("kind").isin(KNOWN, COPY) | (F.col("n") > 1)))
    return found.groupBy("key").agg(
        F.collect_list(F.when(F.col("kind").isin(SYMBOL, KNOWN), F.col("at"))).alias("at"),
        F.max(F.when(F.col("kind") == TEXT_ITSELF, F.col("key") == F.col("least")).when(F.col("kind") == COPY, F.lit(False))).alias("lead"))


def _windows(marked: DataFrame, window: int) -> DataFrame:
    """``deal, place, key, check, stop``: windows that may occur twice, dealt out by hash like the names.

    ``place`` holds more of the hash and the window's first word. Windows known to repeat come as stretches: from the
    first word of their first window up to ``stop``, that of their last one plus one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(deal, place, key=None, check=None, stop=None) -> pa.RecordBatch:
            size = len(deal)
            rest = [pa.nulls(size, kind) if c is None else pa.array(c, kind) for c, kind in ((key, pa.int64()), (check, pa.int32()), (stop, pa.int32()))]
            return pa.RecordBatch.from_arrays([pa.array(deal), pa.array(place), *rest], ["deal", "place", "key", "check", "stop"])

        for batch in small(batches, 0, TEXT):
            names, sizes = word_names(encoded(batch.column(0)))
            made = symbols(names, sizes, window)
            ends = np.cumsum(sizes)
            offsets = ends - sizes
            doc = np.searchsorted(ends, made.low, side="right")
            heads = np.searchsorted(doc, np.arange(len(sizes)), side="left")
            shared = np.zeros(len(doc), bool)
            for k, at in enumerate(batch.column(3)):
                places = at.values.to_numpy()
                shared[heads[k] + places[places >= 0]] = True
            lead = batch.column(4)
            copy = np.repeat(lead.is_valid().to_numpy(zero_copy_only=False), sizes)
            silent = np.repeat(lead.fill_null(True).to_numpy(zero_copy_only=False) == 0, sizes)
            whole = starts(sizes, window)
            may = whole & (copy | (over(made.low[~shared], made.high[~shared], len(names), window) == 0))
            at = np.flatnonzero(may & ~silent)
            deal, more = window_hashes(names, at, window)
            more &= np.uint64(0x7FFFFFFF)
            again, told = repeated(deal ^ (more << np.uint64(33)))
            owner = np.searchsorted(ends, at, side="right")
            keys, checks = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
            deal, more = deal.view(np.int64), more.astype(np.int64) << 32
            known = whole & copy
            known[at[again]] = True
            alone = ~known[at]
            told = np.unique(np.concatenate([told, np.flatnonzero(copy[at] & ~again)]))
            yield rows(deal[alone], (more + at - offsets[owner])[alone], keys[owner[alone]], checks[owner[alone]])
            yield rows(deal[told], more[told])
            first, stop = stretches(known)
            owner = np.searchsorted(ends, first, side="right")
            yield rows(keys[owner], first - offsets[owner], keys[owner], checks[owner], stop - offsets[owner])

    return marked.select("text", "key", "check", "at", "lead", "doc_id").mapInArrow(
        run, "deal long, place long, key long, check int, stop int")


def _gone(windows: DataFrame) -> DataFrame:
    """``key, single, many``: windows that repeat, each as its text's check and its first word in one number, or in stretches."""
    known = F.col("stop").isNotNull()
    counted = windows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("deal", F.shiftright("place", 32), known)))
    found = counted.filter(F.col("key").isNotNull() & (known | (F.col("n") > 1)))
    first = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))
    return found.groupBy("key").agg(
        F.collect_list(F.when(~known, F.shiftleft(F.col("check").cast("long"), 32).bitwiseOR(first))).alias("single"),
        F.collect_list(F.when(known, F.struct("check", first.cast("int").alias("start"), "stop"))).alias("many"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Every row of ``docs``: ``doc_id``, ``n_words``, ``removed`` spans and the ``kept`` text.

    Words are what blanks (``\\x20 \\x09-\\x0D``) part. A word goes if a window of ``window`` consecutive words of its
    text covers it whose words also stand, in that order, from another word on, of the same text or of another;
    windows are judged on the texts as they came. ``removed`` holds ``start``, ``end`` of the stretches that went, as word
    numbers; ``kept`` joins the words that stay by one blank.

    NULL and empty texts have no words; texts shorter than a window keep all theirs. Repeated rows stay repeated, and
    repeat each other; ids may be NULL; an empty table gives no rows; further columns are not read. Long texts are
    pieces of their own.
    """
    # Both joins take the same columns of the texts, so that they are dealt out once.
    texts = _texts(docs, text_col, id_col)
    windows = _windows(texts.join(_shared(_names(texts, window)), "key"), window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1):
            rows = []
            for text, check, single, many in zip(encoded(batch.column(1)), batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
                words = text.split()
                spans = []
                if single.is_valid:
                    own = single.values.to_numpy()
                    own = own[own >> 32 == check] & 0xFFFFFFFF
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, own, 1)
                    np.add.at(change, own + window, -1)
                    for span in many.as_py():
                        if span["check"] == check:
                            change[span["start"]] += 1
                            change[span["stop"] + window - 1] -= 1
                    spans = list(zip(*(c.tolist() for c in stretches(np.cumsum(change[:-1]) > 0))))
                at, kept = 0, []
                for a, b in [*spans, (len(words), None)]:
                    kept += words[at:a]
                    at = b
                rows.append((len(words), [{"start": a, "end": b} for a, b in spans], b" ".join(kept)))
            size, spans, kept = zip(*rows)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "removed", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return texts.join(_gone(windows), "key", "left").select("doc_id", "text", "check", "single", "many").mapInArrow(
        run, f"doc_id {kind}, n_words long, removed array<struct<start:long,end:long>>, kept string")
