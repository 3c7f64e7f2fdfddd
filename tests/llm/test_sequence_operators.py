"""Repeated windows and periodic runs on small hard cases, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from understory.llm import queries, repeats, runs

from .test_text_operators import prose

ODD = [None, "", " ", "\t\n", "a", "b " * 34, "c " * 35, "d " * 36, "e f " * 60, "x" * 3000, "é　z q\x0bq", "<|endoftext|> 😀"]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def kept_slowly(texts, window=35):
    words = [words_of(t) for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    kept = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for j in range(i, i + window)}
        kept.append((len(w), len(gone), [x for j, x in enumerate(w) if j not in gone]))
    return kept


def runs_slowly(words):
    found, n = set(), len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(6, 4 * q):
                part = words[i:i + size]
                if not any(part[p:] == part[:size - p] for p in range(1, q)):
                    found.add((i, size, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeating_texts(rng):
    texts = list(ODD)
    shared = [prose(rng, n) for n in (34, 35, 36, 50, 90)]
    for k in range(60):
        texts.append(" ".join([prose(rng, rng.randrange(60)), shared[k % 5], prose(rng, rng.randrange(60))]))
    whole = prose(rng, 300)
    cut = whole.split()
    texts += [whole] * 3 + [" ".join(cut[:150] + ["changed"] + cut[151:]), " ".join(cut[70:106]), " ".join(cut[70:104])]
    texts += [" ".join(["a"] * k + ["b"] + ["a"] * (70 - k)) for k in (10, 36, 50)] + ["a b " * 40, "b a " * 17 + "b", "u v w " * 50]
    texts += [" ".join(rng.choice("xy") for _ in range(400)) for _ in range(3)]
    return texts


@pytest.mark.parametrize("piece", [repeats.TEXT, 500])
def test_repeated_windows_equal_brute_force(documents, monkeypatch, piece):
    monkeypatch.setattr(repeats, "TEXT", piece)
    rng = random.Random(12)
    texts = repeating_texts(rng)
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[20]), (None, prose(rng, 80)), (7, texts[7])]
    found = repeats.without_repeats(documents(rows).repartition(5)).collect()
    mine = sorted((str(r["doc_id"]), r["n_words"], sum(s["end"] - s["start"] for s in r["removed"]), r["kept"]) for r in found)
    want = kept_slowly([t for _, t in rows])
    assert mine == sorted((str(d), n, gone, " ".join(kept)) for (d, _), (n, gone, kept) in zip(rows, want))
    assert any(0 < gone < n for n, gone, _ in want)


@pytest.mark.parametrize("window", [3, 8])
def test_other_windows(documents, window):
    rng = random.Random(window)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(40))) for _ in range(30)]
    found = {r["doc_id"]: r["kept"] for r in repeats.without_repeats(documents(list(enumerate(texts))), window=window).collect()}
    assert found == {k: " ".join(kept) for k, (_, _, kept) in enumerate(kept_slowly(texts, window))}


def test_symbols_follow_from_their_context():
    """Equal words give equal symbols in equal places, but for those whose context leaves them."""
    rng = random.Random(5)
    for vocabulary in (2, 3, 40):
        middle = [rng.randrange(vocabulary) for _ in range(300)]
        sides = [([rng.randrange(vocabulary) for _ in range(90)], [rng.randrange(vocabulary) for _ in range(70)]) for _ in range(2)]
        found = []
        for before, behind in sides:
            ids = np.array(before + middle + behind, np.uint64)
            made = repeats.symbols(repeats.mixed(ids), np.array([len(ids)]), 35)
            inside = (made.low >= 90) & (made.high <= 390)
            found.append(set(zip(made.name[inside].tolist(), made.low[inside].tolist(), made.high[inside].tolist())))
        assert found[0] == found[1]
        assert vocabulary < 40 or len(found[0]) > 20


def test_runs_equal_brute_force(documents):
    rng = random.Random(13)
    texts = list(ODD)
    for _ in range(80):
        n, k = rng.choice([5, 6, 7, 20, 60, 150]), rng.choice([1, 2, 2, 3, 5, 40])
        w = [f"w{rng.randrange(k)}" for _ in range(n)]
        if rng.random() < 0.7:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.choice([3, 4, 5, 6, 10])
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        texts.append(" ".join(w))
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[40]), (3, texts[3])]
    found = runs.collapsed(documents(rows).repartition(3)).collect()
    mine = sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found)
    want = []
    for d, t in rows:
        w = words_of(t)
        spans = runs_slowly(w)
        gone = {i for s, n, q in spans for i in range(s + q, s + n)}
        want.append((str(d), len(w), spans, " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert mine == sorted(want)


def test_long_runs():
    ids = np.zeros(200_000, np.int64)
    assert [c.tolist() for c in runs.maximal_runs(ids, np.array([200_000]))] == [[0], [200_000], [1]]
    tail = np.concatenate([np.arange(1000), np.tile(np.arange(1000, 6000), 10)])
    assert [c.tolist() for c in runs.maximal_runs(tail, np.array([len(tail)]))] == [[1000], [51_000], [5000]]
    # Words whose hashes of 2**64 agree although they differ.
    twins = np.array([i.bit_count() % 2 for i in range(1 << 13)])
    assert all(len(c) == 0 for c in runs.maximal_runs(twins, np.array([len(twins)])))


def test_hashes_that_agree_by_chance():
    ids = np.array([5, 1, 2, 1, 2, 1, 2, 1, 2, 9, 1, 2, 1, 2])
    assert runs.stretch(ids, 0, 4, len(ids), 2) == (1, 9)
    assert runs.stretch(ids, 0, 9, len(ids), 3) == (7, 12)


def written_out(words, doc_id):
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    spans = runs_slowly(words)
    gone = {i for s, size, q in spans for i in range(s + q, s + size)}
    best = min(spans, key=lambda r: (-r[1], r[0], r[2])) if spans else None
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in spans)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(spans), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_queries_equal_brute_force(spark, documents, tmp_path):
    rng = random.Random(31)
    rows = list(enumerate(repeating_texts(rng) + [prose(rng, rng.randrange(200)) for _ in range(150)]))
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    by_id = {r["doc_id"]: r for r in queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()}
    assert {d: tuple(r) for d, r in by_id.items()} == {d: written_out(words_of(t), d) for d, t in rows}
    found = {tuple(r) for r in queries.QUERIES["op12_repeated_substrings"](spark, str(tmp_path)).collect()}
    want = kept_slowly([t for _, t in rows])
    assert found == {(d, n, gone, hashlib.sha256(" ".join(kept).encode()).hexdigest()) for (d, _), (n, gone, kept) in zip(rows, want)}


def test_empty_tables(documents):
    none = documents([(1, "a")]).limit(0)
    assert repeats.without_repeats(none).collect() == [] and runs.collapsed(none).collect() == []
