"""Words that differ in one letter, found by walking a trie that is a table, level by level.

The vocabulary is spelled out twice, forwards behind ``>`` and backwards behind ``<``. Its trie is a table of edges for
each level: ``node`` (the spelling so far), ``label`` (the letters up to the next branch), whether the child ``ends`` a
word, and the letters that go on from it. It grows level by level: the words at a node that go on with the same letter
share an edge, whose label is what the least and the greatest of them have in common.

The frontier holds states ``(code, pos, node, edits)``: a word of which the letters before ``pos`` have led to ``node``.
Each level joins them with its edges. A state without edits may leave its own path where a letter differs, which makes
its one edit; a state with one edit follows the letters. Of two words that differ in one place at least half of the
shorter one is common at one of their ends, so a word leaves its path in the second half of a spelling only, and the
other spelling finds the rest.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from understory.llm.worker import small, with_texts
from understory.session import written

#: What a word is, its least length, occurrences, and how much more frequent its form is.
LETTERS = "A-Za-zÀ-ÿ"
SHORTEST, OCCURRENCES, TIMES = 6, 5, 5
#: Different words that a task counts before it hands them on.
COUNTED = 200_000


def slip(doc_id: object, word: str) -> str:
    """The word as the query reads it in a document: one in 199, told by hash, lacks a letter. NULL ids count as empty."""
    name = "" if doc_id is None else doc_id
    h = zlib.crc32(f"{name}:{word}".encode("utf-8", "surrogatepass"))
    cut = h % len(word)
    return word[:cut] + word[cut + 1:] if h % 199 == 0 else word


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST,
               occurrences: int = OCCURRENCES, read: Callable[[object, str], str] | None = None) -> DataFrame:
    """``word, n``: words of ``shortest`` letters and ``occurrences`` in all texts at least, A-Z in lower case.

    ``read`` may give the word that a document's word is read as; it makes none longer. Tasks hand on counts, not words.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, counts = re.compile(f"[{LETTERS}]{{{shortest},}}"), Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in small(batches, 1):
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = found.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
                if read is None:
                    counts.update(words)
                else:
                    for word, n in Counter(words).items():
                        counts[read(name, word)] += n
            if len(counts) > COUNTED:
                yield rows()
                counts.clear()
        yield rows()

    texts = with_texts(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter((F.col("n") >= occurrences) & (F.length("word") >= shortest))


def after(code: Column, place: Column) -> Column:
    """The letters of a spelling after its first ``place``."""
    return F.substring(code, place + 1, F.length(code))


def common(low: Column, high: Column) -> Column:
    """What the two begin with alike."""
    unlike = F.array_min(F.filter(F.sequence(F.lit(1), F.least(F.length(low), F.length(high))),
                                  lambda i: F.substring(low, i, F.lit(1)) != F.substring(high, i, F.lit(1))))
    return F.when(low == high, low).when(unlike.isNull(), F.least(low, high)).otherwise(F.substring(low, F.lit(1), unlike - 1))


def trie(words: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each level the spellings' own places ``(code, node, ends)`` and the edges ``(node, label, ends, next)`` from there."""
    codes = words.select(F.explode(F.array(F.concat(F.lit(">"), "word"), F.concat(F.lit("<"), F.reverse("word")))).alias("code"))
    paths = codes.select("code", F.substring("code", 1, 1).alias("node"), F.lit(False).alias("ends"))
    levels = []
    while True:
        rest = after(F.col("code"), F.length("node"))
        going = paths.select("code", "node", rest.alias("rest")).filter("rest <> ''").withColumn("letter", F.substring("rest", 1, 1))
        groups = going.groupBy("node", "letter").agg(F.min("rest").alias("low"), F.max("rest").alias("high"))
        groups = groups.select("node", "letter", common(F.col("low"), F.col("high")).alias("label"), "low")
        moved = going.join(groups, ["node", "letter"]).select(
            "code", F.col("node").alias("parent"), F.concat("node", "label").alias("node"), (F.col("low") == F.col("label")).alias("ends"))
        moved = written(moved, "trie-paths")
        if moved.isEmpty():
            return levels
        goes_on = F.substring(after(F.col("code"), F.length("node")), 1, 1)
        edges = moved.groupBy("parent", "node").agg(F.first("ends").alias("ends"), F.array_join(F.collect_set(goes_on), "").alias("next"))
        edges = edges.select(F.col("parent").alias("node"), after(F.col("node"), F.length("parent")).alias("label"), "ends", "next")
        levels.append((paths, written(edges, "trie-edges")))
        paths = moved.select("code", "node", "ends")


def step(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states with one edit that a level's edges lead to; those stay whose next letter goes on, or that end a word."""
    code, pos, label = F.col("code"), F.col("pos"), F.col("label")
    rest, size = after(code, pos), F.length("label")
    # With no edit yet: another letter, a letter more, or a letter less than the spelling has.
    left = (F.col("edits") == 0) & (rest != "") & (F.substring(rest, 1, 1) != F.substring(label, 1, 1))
    more = (F.col("edits") == 0) & (F.substring(rest, 1, 1) != F.substring(label, 1, 1))
    behind, tail = after(rest, F.lit(1)), after(label, F.lit(1))
    reached = F.array(
        F.when((F.col("edits") == 1) & rest.startswith(label), pos + size),
        F.when(left & behind.startswith(tail), pos + size),
        F.when(more & rest.startswith(tail), pos + size - 1),
        F.when(left & behind.startswith(label), pos + size + 1))
    moved = states.join(edges, "node").select("code", F.concat("node", "label").alias("node"), "ends", "next", F.explode(reached).alias("pos"))
    letter = F.substring(after(F.col("code"), F.col("pos")), 1, 1)
    over = F.col("pos") >= F.length("code")
    good = F.when(over, F.col("ends")).otherwise(F.col("next").contains(letter))
    return moved.filter(F.col("pos").isNotNull() & good).select("code", "pos", "node", F.lit(1).alias("edits"))


def near_words(words: DataFrame) -> DataFrame:
    """``word, near``: all pairs of different words of ``words`` with one letter inserted, deleted or replaced, both ways round."""
    frontier, found = None, []
    for paths, edges in trie(words):
        place = F.length("node")
        # The spelling has one letter more than a word on its own path.
        found.append(paths.filter(F.col("ends") & (F.length("code") == place + 1)).select("code", "node"))
        # The marker counts as a letter in both lengths.
        states = paths.filter(2 * (place - 1) >= F.length("code") - 2).select("code", place.alias("pos"), "node", F.lit(0).alias("edits"))
        states = states if frontier is None else states.union(frontier.filter(F.col("pos") < F.length("code")))
        frontier = written(step(states, edges), "trie-frontier")
        found.append(frontier.filter(F.col("pos") == F.length("code")).select("code", "node"))
    if not found:
        return words.select("word", F.col("word").alias("near")).limit(0)
    both = found[0]
    for other in found[1:]:
        both = both.union(other)

    def spelled(name: str) -> Column:
        plain = after(F.col(name), F.lit(1))
        return F.when(F.substring(name, 1, 1) == "<", F.reverse(plain)).otherwise(plain)

    return both.select(spelled("code").alias("word"), spelled("node").alias("near")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of each chain of forms; a chain halves in every round, and occurrences grow along it."""
    links = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = written(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")), "forms")
        if links.filter("on").isEmpty():
            return links.select("word", "root")
        links = links.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, occurrences: int = OCCURRENCES,
                      times: int = TIMES, read: Callable[[object, str], str] | None = None) -> DataFrame:
    """Every word of the vocabulary: ``word, form, root, n, n_near, form_n``.

    A word's near words differ in exactly one letter; ``n_near`` counts them. ``form`` is the near word of most
    occurrences, of several the first in code-point order, if it has ``times`` the word's; ``root`` is where forms lead
    to in the end, the word itself where it has none.

    NULL and empty texts hold no words, long texts are read whole, repeated rows count as often as they come, ids
    may be NULL, an empty table gives no rows, further columns are not read. The levels are as many as the branches on
    the longest path, not as its letters.
    """
    words = written(vocabulary(docs, id_col, text_col, shortest, occurrences, read), "vocabulary")
    pairs = near_words(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("near_n"), F.col("near"))).alias("best"))
    best = best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.col1")).alias("near_n"))
    enough = F.col("near_n") >= times * F.col("n")
    told = written(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("near")).alias("form"), F.when(enough, F.col("near_n")).alias("form_n")), "spelling")
    ends = roots(told.filter("form IS NOT NULL"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
