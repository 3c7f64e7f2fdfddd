"""Near copies, tokens, personal data, leaks, quality and languages on small hard cases, against brute force."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from understory.llm import bpe, langid, leaks, pii, quality, simhash, token_files

WORDS = [a + b for a in ("ka", "lo", "mi", "tu", "ra", "se", "no", "pi") for b in ("ber", "dan", "fel", "gor", "hus", "jil")]
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ODD = ["", None, " ", "a", "\t\n", "é" * 300, "x" * 3000, "a  b\n \n c ", "don't  stop'll 12.5!", "<|endoftext|> 😀　z", "l" * 70 + " end"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def simhash_slowly(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_slowly(fps):
    root = {k: k for k in fps}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(fps)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in fps}


@pytest.mark.parametrize("limit", [simhash.BUCKET, 2])
def test_simhash_groups_equal_brute_force(documents, limit):
    rng = random.Random(1)
    texts = list(ODD)
    for _ in range(25):
        base = prose(rng, 150).split()
        texts.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            copy[rng.randrange(150)] = "changed"
            texts.append(" ".join(copy))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[20]), (7, texts[7])]
    got = simhash.near_duplicates(documents(rows), limit=limit).collect()
    assert len(got) == len(rows)
    fps = {i: simhash_slowly(t) for i, t in enumerate(texts)}
    want = groups_slowly(fps)
    for r in got:
        i = 20 if r.doc_id is None else r.doc_id
        assert r.fingerprint == f"{fps[i]:016x}"
        assert r.component_id == want[i]
    assert len(set(want.values())) < len(want) - 20


def test_simhash_bucket_forest_keeps_all_groups():
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 400:
        fps.add(rng.choice(sorted(fps)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    many = np.array(sorted(fps), dtype=np.uint64)
    a, b = simhash.forest(many, None)
    assert len(a) == len(many) - 1 and (np.bitwise_count(a ^ b) <= 4).all()


def test_empty_tables(documents):
    none = documents([(1, "a")]).limit(0)
    assert simhash.near_duplicates(none).collect() == []
    assert bpe.encode(none, RANKS, PATTERN).collect() == []
    assert token_files.checksums(token_files.write_token_files(none, public_tokenizers.path("byte_bpe_50k.json"))).collect() == []
    assert pii.find(none).collect() == [] and pii.redact(none).collect() == []
    assert leaks.leaks(none, documents([(1, "some item")]).selectExpr("doc_id AS item_id", "text")).collect() == []
    assert langid.identify(none, langid.prototypes(none)).collect() == []
    labels = none.selectExpr("doc_id", "n_chars AS quality")
    assert quality.scores(none, quality.train(none, labels)).collect() == []


def test_bpe_equals_the_library_and_comes_back(documents):
    import tiktoken

    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab étz0\n .,'") for _ in range(rng.randrange(200))) for _ in range(150)]
    texts += ["".join(rng.choice("etaoin") for _ in range(rng.randrange(65, 400))) for _ in range(20)] + ["ab" * 2000]
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    docs = documents([(i, t) for i, t in enumerate(texts)] + [(None, "twice"), (0, "twice")])
    for r in bpe.round_trip(docs, RANKS, PATTERN).collect():
        text = "twice" if r.doc_id is None or not r.doc_id and r.decoded else texts[r.doc_id] or ""
        assert r.ids == library.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    tokens = bpe.encode(docs, RANKS, PATTERN)
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(tokens.filter("doc_id > 0"), RANKS).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts) if i}


def test_bpe_of_very_long_words():
    """Words of up to 100,000 letters, random and periodic, have the library's ids; no row of a word is kept per round."""
    import tiktoken

    ranks, rng = bpe.read_ranks(RANKS), random.Random(4)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = ["".join(rng.choice(letters) for _ in range(n)) for n, letters in (
        (100_000, "abcdefghijklmnopqrstuvwxyz"), (100_000, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), (20_000, "etaoin"),
        (20_000, "ab"), (3_000, "eté"))]
    words += ["abcabcd" * 3_000, "a" * 20_001, "".join(rng.choice(["ing", "the", "er"]) for _ in range(8_000))]
    words += ["".join(rng.choice(rng.choice(["aab", "théing", "0", "AaBb"])) for _ in range(rng.randint(60, 200))) for _ in range(300)]
    worker = bpe.Bpe(ranks, PATTERN)
    for word, got in zip(words, worker.encode(words)):
        raw = word.encode()
        pieces = worker._cut(raw)
        assert b"".join(pieces) == raw
        assert got.tolist() == library.encode_ordinary(word)


def test_chunks_of_a_batch_give_the_ids_of_whole_texts():
    """Odd white space, unsafe and empty texts, special tokens as text, one-row batches and a memory that overflows."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    with open(path, encoding="utf-8") as file:
        ids = token_files.Ids(file.read(), "<u2")
    ids.chunks.limit = 50
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\n ", "\t", "\u00a0", "\u3000", "\x1c", "a", "don't", "\u0120x", "<|endoftext|>", "12.5", "\U0001f600", "\u00e9t\u00e9", "--"]
    texts = ["", " ", "x ", " x", "a\n b", "a\n \nb", "word " * 400] + [
        "".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(1500)]
    for size in (1, 7, 200):
        for k in range(0, len(texts), size):
            part = texts[k:k + size]
            found, counts = ids.of(pa.array(part, pa.string()), 0)
            want = [e.ids + [0] for e in library.encode_batch(part, add_special_tokens=False)]
            assert counts.tolist() == [len(w) for w in want]
            assert np.array_equal(found, np.concatenate([np.array(w) for w in want]))


def test_token_files_hold_what_the_library_encodes(documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    texts = ODD + [prose(random.Random(4), n) for n in (1, 5, 700)]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(None, "first"), (6, "  ")]
    index = token_files.write_token_files(documents(rows).repartition(3), public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(token_files.read_ids(index).collect(), key=lambda r: r.start)
    assert [r.doc_id is None for r in got][0] and [r.doc_id for r in got][1:] == sorted([i * 3 for i in range(len(texts))] + [6])
    start = 0
    sums = {r.start: r.ids_crc32 for r in token_files.checksums(index).collect()}
    for r in got:
        assert (r.start, r.n_tokens) == (start, len(r.ids)) and r.ids[-1] == 0
        assert sums[start] == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    want = sorted(library.encode(t or "", add_special_tokens=False).ids + [0] for _, t in rows)
    assert sorted(r.ids for r in got) == want


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def strict_slowly(text):
    out = []
    for code, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else False,
                    "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((code, m.start(), m.end()))
    return out


def test_strict_personal_data_equals_brute_force(documents):
    rng = random.Random(5)
    texts = ODD + ["a@b.c_d@e.f g", "a@b..c x.@y.z-é", "1.2.3.4.5.6.7.8 300.1.1.1 1.2.3.0255 01.1.1.1", "4111 1111-1111 1111, 4111111111111112",
                   "+1 (017) 555-7713 +12 +1-2-3-4-5-6-7-8-9.", "😀 é@x.y q@x.y"]
    texts += ["".join(rng.choice("0123456789.@+-( )ab") for _ in range(rng.randrange(120))) for _ in range(400)] + ["1" * 20000, "a." * 20000 + "@x.y"]
    docs = documents([(i, t) for i, t in enumerate(texts)])
    for r in pii.find(docs).collect():
        assert [tuple(s) for s in r.base] == strict_slowly(texts[r.doc_id])
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[1] is None and clean[len(ODD)] == "<EMAIL><EMAIL> g"
    assert pii.redact(docs).columns == docs.columns


def test_contexts_discover_unseen_identifiers(documents):
    rng = random.Random(6)
    rows = [(i, f"{prose(rng, 5)} call hotline +1 (555) 010-{1000 + i} {prose(rng, 5)}") for i in range(60)]
    rows += [(100, "please call hotline 555-0199 now"), (101, "the number 555-0177 stands alone"), (101, "the number 555-0177 stands alone")]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(documents(rows)).collect()}
    assert got[100] == [(3, 20, 28)] and got[101] == [] and all(len(got[i]) == 1 for i in range(60))


def test_all_verbatim_items_of_a_large_benchmark_are_found(documents):
    """Many more passages than the basis has directions; one item of common words among rare ones."""
    rng = random.Random(17)
    names = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(4000)]
    items = [" ".join(rng.choices(names, k=rng.randrange(15, 60))) for _ in range(2200)]
    plain = [prose(rng, 40) for _ in range(400)]
    items.append(prose(rng, 15))
    rows = [(i, " ".join([*rng.choices(names, k=rng.randrange(40)), item, *rng.choices(names, k=30)])) for i, item in enumerate(items)]
    rows += [(len(rows) + i, t) for i, t in enumerate(plain)]
    found = leaks.leaks(documents(rows), documents(list(enumerate(items))).selectExpr("doc_id AS item_id", "text")).collect()
    assert {(i, i) for i in range(len(items))} <= {(r.doc_id, r.item_id) for r in found}


def test_leaks_are_found_whatever_their_dress(documents):
    rng = random.Random(7)
    items = [prose(rng, n) + " " + "".join(rng.choice("abcdefgh") for _ in range(9)) for n in (12, 20, 40, 130)] + ["", None]
    clean = [prose(rng, 300) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(clean)]
    want = set()
    for k, item in enumerate(items[:4]):
        changed = item.split()
        changed[len(changed) // 2] = "other"
        for j, shown in enumerate((item, item.upper(), item.replace(" ", "*** "), " ".join(changed))):
            rows.append((100 + 10 * k + j, f"{clean[k]} {shown}. {clean[k + 5]}"))
            want.add((100 + 10 * k + j, k))
    rows += [(500, None), (501, ""), (502, items[1]), (502, items[1])]
    benchmark = documents([(k, t) for k, t in enumerate(items)]).selectExpr("doc_id AS item_id", "text", "source AS doc_id")
    got = [(r.doc_id, r.item_id) for r in leaks.leaks(documents(rows), benchmark).collect()]
    assert set(got) == want | {(502, 1)} and got.count((502, 1)) == 2


def test_basis_holds_the_passages(spark):
    """The randomised SVD of few passages spans them all, so cosines in it are exact."""
    rng = random.Random(8)
    passages = [leaks.words_of(prose(rng, 30)) for _ in range(40)]
    cut = spark.createDataFrame([(k % 2, b" ".join(p)) for k, p in enumerate(passages)], "part long, words binary")
    idf = np.ones(leaks.FEATURES, np.float32)
    bases = leaks.latent_bases(cut, idf)
    assert sorted(bases) == [0, 1]
    for k, passage in enumerate(passages):
        held, basis = bases[k % 2]
        used, values, _ = leaks.row_and_length(leaks.Hashed().of(passage), idf)
        assert set(used) <= set(held)
        assert abs(np.linalg.norm(values @ basis[np.searchsorted(held, used)]) - 1) < 1e-3


def test_common_subsequence_equals_dynamic_programming():
    rng = random.Random(9)
    for _ in range(200):
        a, b = ([rng.choice(b"abcd") for _ in range(rng.randrange(30))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert leaks.common_subsequence(a, b) == table[-1, -1]


def test_quality_ranks_held_out_rows(spark, documents):
    rng = random.Random(10)
    rows = [(i, prose(rng, 80) if i % 6 else prose(rng, 80).upper().replace(" ", "!! ")) for i in range(600)]
    docs = documents(rows + [(None, None), (600, ""), (601, "x" * 200000)])
    labels = spark.createDataFrame([(i, int(i % 6 > 0)) for i in range(0, 400)] + [(None, 1), (5, None), (6, 9)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.scores(docs, quality.train(docs, labels)).collect()}
    assert len(got) == 603 and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= quality.CUT) == (i % 6 > 0) for i in range(400, 600))
    one = quality.train(docs, labels.filter("quality = 1"))
    assert all(r.score >= quality.CUT for r in quality.scores(docs, one).collect())


def test_languages(documents):
    rng = random.Random(11)
    sounds = {"aa": ["ka", "lo", "mi"], "bb": ["tru", "sch", "ünd"], "cc": ["éro", "ñez", "oux"]}
    made = lambda lang: " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(30))
    train = [(i, made(lang), lang) for i, lang in enumerate(list(sounds) * 20)]
    model = langid.prototypes(documents(train + [(90, None, "zz"), (91, "text", None), (92, "123", "zz")]))
    assert model[0] == ["aa", "bb", "cc"]
    test = [(i, made(lang), lang) for i, lang in enumerate(list(sounds) * 10)]
    got = {r.doc_id: r for r in langid.identify(documents(test + [(100, None), (101, "12 !? 😀"), (102, ""), (103, "ü")]), model).collect()}
    assert all(got[i].lang_pred == lang and 0 < got[i].score <= 1 for i, _, lang in test)
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[103].lang_pred != "und"


def test_language_vectors_equal_plain_binding():
    letters = langid.Letters()
    text = "Abc, ça!"
    code = [letters.classes(c)[0] if c.isalpha() else 0 for c in " " + text.lower() + " "]
    base = np.random.default_rng(langid.SEED).choice(np.array([-1, 1], np.int8), size=(langid.CLASSES, langid.DIMENSIONS))
    total = sum(np.roll(base[a], 2).astype(int) * np.roll(base[b], 1) * base[c] for a, b, c in zip(code, code[1:], code[2:]) if b)
    assert np.allclose(letters.vectors([text])[0], total / np.linalg.norm(total), atol=1e-6)




def test_quality_learns_from_all_labelled_rows(spark, documents):
    """20,000 labelled rows: mean, scale and threshold of the model are those of all of them, however rare a label is."""
    rng = random.Random(11)
    texts = [prose(rng, 3) + ("!" * rng.randrange(1, 9) if i % 40 else "") for i in range(20_000)]
    docs = documents(list(enumerate(texts)))
    labels = spark.createDataFrame([(i, int(i % 40 > 0)) for i in range(20_000)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    x = np.array([quality.features(t).astype("<f4") for t in texts], np.float64)
    assert np.allclose(model["mean"], x.mean(axis=0), atol=1e-12)
    raw = np.sort(((x - model["mean"]) / model["scale"]) @ model["weights"])
    assert abs(model["cut"] - raw[499:501].mean()) < 1e-9
    got = {r.doc_id: r.score for r in quality.scores(docs, model).collect()}
    assert all((got[i] >= quality.CUT) == (i % 40 > 0) for i in range(20_000))
