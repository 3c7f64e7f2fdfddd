"""Spelling variants against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

from understory.llm import queries, spelling

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def counted_slowly(rows):
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{word}".encode())
            if h % 199 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants_slowly(counts):
    found = {}
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= 5 * n else None
        found[w] = [form, w, n, len(others), counts.get(form)]
    for w, row in found.items():
        while found[row[1]][0] is not None:
            row[1] = found[row[1]][0]
    return {w: tuple(row) for w, row in found.items()}


def odd_texts(rng):
    words = ["kaberl", "kaberli", "kaberlin", "xkaberli", "kaberlx", "kabberli", "kaberlin" * 40, "kaberlin" * 39 + "kaberlim",
             "éclairs", "eclairs", "ÉCLAIRS", "a" * 6, "a" * 7, "a" * 8, "ab" * 4, "ba" * 4, "ab" * 3 + "a", "straße", "strasse", "größer×"]
    for _ in range(60):
        base = "".join(rng.choice("abcö") for _ in range(rng.randrange(6, 10)))
        words += [base, base[:3] + rng.choice("abcx") + base[4:], base[1:], base + "b", base[:2] + base[3:]]
    texts = []
    for w in words:
        texts += [f"{w.title() if rng.random() < 0.2 else w}, {w}-{w} {w}"] * rng.choice([1, 1, 2, 2, 9, 40])
    # A chain of forms.
    texts += ["harvesti"] * 5 + ["harvest harvest harvest "] * 10 + ["harvett"] * 3 + ["harvett harvett "] * 150
    texts += [None, "", "  ", "123 456", "one two", " ".join(words * 3)]
    rng.shuffle(texts)
    return texts


def test_variants_equal_brute_force(spark, documents, tmp_path):
    rng = random.Random(11)
    texts = odd_texts(rng)
    rows = list(enumerate(texts)) + [(None, texts[0]), (None, texts[1]), (5, texts[5])]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op11_spelling_variants"](spark, str(tmp_path)).collect()
    want = variants_slowly(counted_slowly(rows))
    assert len(found) == len(want)
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found} == want
    assert any(r[1] not in (w, r[0]) for w, r in want.items()) and max(r[3] for r in want.values()) >= 5


def test_one_word_or_none(documents):
    none = documents([(1, "a")])
    assert spelling.spelling_variants(none).collect() == []
    assert spelling.spelling_variants(none.limit(0)).collect() == []
    one = spelling.spelling_variants(documents([(1, "lonely " * 7)])).collect()
    assert [tuple(r) for r in one] == [("lonely", None, "lonely", 7, 0, None)]


def test_long_shared_beginnings(spark):
    """The levels follow the branches: words of 3,000 letters take a few."""
    words = spark.createDataFrame([("a" * 3000, 9), ("a" * 3000 + "b", 5), ("a" * 2999 + "c", 5), ("c" + "a" * 2999, 7)], "word string, n long")
    found = {(r["word"][-1], r["near"][-1]) for r in spelling.near_words(words).collect() if r["word"][0] == r["near"][0] == "a"}
    assert len(spelling.trie(words)) <= 4 and found == {("a", "b"), ("b", "a"), ("a", "c"), ("c", "a")}
