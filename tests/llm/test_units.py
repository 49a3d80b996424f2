"""The parts of the corpus operators that need no Spark, against plain versions."""

import random
import re

import numpy as np
import pytest

from impactgraph.llm import decontaminate, exact_dedup, hashing, language, ngram_join, runs, simple8b, substring_dedup, suffix_dedup, token_files, tokens

P = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("values", [[], [0], [2**64 - 1], [2**64 - 1] * 5 + [2**60 - 1, 2**60, 0, 0, 0], list(range(5000)), [0] * 1000 + [1] * 333])
def test_simple8b(values):
    words, offsets = simple8b.pack(np.array(values, np.uint64))
    assert simple8b.unpack(words, len(values)).tolist() == values and offsets[-1] == len(words)


def test_simple8b_of_many():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(0, 4000))
        v = (rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)) >> rng.integers(0, 64, n).astype(np.uint64)
        sizes, left = [], n
        while left:
            sizes.append(min(int(rng.integers(0, 1500)), left))
            left -= sizes[-1]
        words, blocks, (word_edge, block_edge) = simple8b.pack_many(v, np.array(sizes, int))
        at = 0
        for i, size in enumerate(sizes):
            own = words[word_edge[i] : word_edge[i + 1]]
            assert (simple8b.unpack(own, size) == v[at : at + size]).all()
            starts = blocks[block_edge[i] : block_edge[i + 1]] - word_edge[i]
            for b, (s, e) in enumerate(zip(starts, [*starts[1:], len(own)], strict=True)):  # a block can be decoded alone
                lo = at + b * simple8b.BLOCK
                assert (simple8b.unpack(own[s:e], min(simple8b.BLOCK, size - b * simple8b.BLOCK)) == v[lo : min(lo + simple8b.BLOCK, at + size)]).all()
            at += size


def test_blocks_are_decoded_from_their_offsets():
    v = np.random.default_rng(3).integers(0, 2**62, 3000).astype(np.uint64)
    words, offsets = simple8b.pack(v)
    blocks, sizes = offsets[:-1], np.array([1024, 1024, 952])
    assert (simple8b.unpack(words, 3000, blocks, sizes) == v).all()
    assert (token_files.ids(blocks, words.tobytes(), 3000, 1, 2) == v[1024:2048].astype("<u4")).all() and len(token_files.ids(blocks, words.tobytes(), 3000, 3)) == 0
    for wrong in (blocks + [0, 1, 0], blocks + [0, 0, 2], blocks * 0, blocks + [1, 0, 0], blocks + [0, 0, 10**6]):
        with pytest.raises(ValueError):
            simple8b.unpack(words, 3000, wrong, sizes)


def test_small_ids_are_packed_densely():
    words, _ = simple8b.pack(np.zeros(1024, np.uint64))
    assert len(words) == 18 and len(simple8b.pack(np.full(1024, 2**15 - 1, np.uint64))[0]) == 256


def test_fingerprints_compose():
    text = random.Random(1).randbytes(300_000)
    whole = exact_dedup.fingerprint(text)
    for cut in (0, 1, 777, exact_dedup.CHUNK, 299_999):
        assert exact_dedup.fingerprint(text[:cut]) + exact_dedup.fingerprint(text[cut:]) == whole
    assert exact_dedup.fingerprint(b"\0") != exact_dedup.fingerprint(b"") and exact_dedup.fingerprint(b"\0\0") != exact_dedup.fingerprint(b"\0")


def test_normalise():
    for t in (b"", b" ", b" a\t\n b", b"a ", " a b".encode(), b"\x1ca\x0b\x0cb\r"):
        assert exact_dedup.normalise(t) == re.sub(rb"[\x20\x09-\x0d]+", b" ", t)


ALPHABET = ["a", "B", "é", "É", "ſ", "İ", "'s", "'", "n't", "!", "…", "́", "é", " ", " ", "\x1c", "\x85", "  ", " ", "\n", "\t", "\r\n", "<|endoftext|>", "<|startoftext|>", "<|", "1", "23", "²", "中", "🙂", "ß", "×", "`", ".", ",.", "-", "Σ", "=", "<", ">", "µ", "ª", "Æ", "　", " w", " x"]


def odd_texts(n, seed=3):
    r = random.Random(seed)
    plain = [x for x in ALPHABET if x.isascii()] + ["É", "ß", "Æ", " w", " x", " ."]
    return ["".join(r.choice(r.choice((ALPHABET, plain))) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_word_ids_are_the_library_s():
    path = P.path("word_bpe_49k.json")
    texts = odd_texts(3000)
    want = [np.array(e.ids, np.uint32).tobytes() for e in tokens.tokenizer(path).encode_batch(texts, add_special_tokens=False)]
    encoder = tokens.WordIds(path)
    assert encoder.encode([t.encode() for t in texts]) == want
    encoder.words.most = 7  # however few pieces are remembered
    assert encoder.encode([t.encode() for t in texts]) == want


def test_other_tokenizers_get_whole_texts():
    path = P.path("byte_bpe_50k.json")
    texts = odd_texts(300, 4)
    want = [np.array(tokens.tokenizer(path).encode(t, add_special_tokens=False).ids, np.uint32).tobytes() for t in texts]
    assert tokens.WordIds(path).encode([t.encode() for t in texts]) == want


def test_summaries_are_those_of_all_boundaries():
    lib, r = tokens.tokenizer(P.path("byte_bpe_50k.json")), random.Random(6)
    for t in odd_texts(300, 7):
        head, tail = r.randint(1, 20), r.randint(5, 40)
        marks, n = tokens.boundaries(lib, t)
        got = tokens.summary(lib, t, 100, head, tail)
        last = 100 + max((c for c, _ in marks), default=0)
        assert got == (n, [(100 + c, k) for c, k in marks if c < head], [(100 + c, k) for c, k in marks if c >= tail], last), t


def test_spliced_counts():
    lib, r = tokens.tokenizer(P.path("byte_bpe_50k.json")), random.Random(5)
    for turn in range(120):
        text = "".join(r.choice([*ALPHABET, *["word "] * 20]) for _ in range(r.randint(0, 1500)))
        if turn % 7 == 0:  # no boundary for far longer than an overlap
            text += "x" * 900 + " " * 500
        assert tokens.count_spliced(lib, text, r.randint(50, 300), r.randint(33, 64)) == len(lib.encode(text, add_special_tokens=False))


def test_words():
    texts = [t.encode() for t in odd_texts(200, 6)]
    w = hashing.Words(texts)
    for i, t in enumerate(texts):
        assert [w.text(j, j + 1) for j in range(w.first[i], w.first[i + 1])] == re.findall(rb"[^\x20\x09-\x0d]+", t)
    by_hash = {}
    for j, h in enumerate(w.hash.tolist()):
        assert by_hash.setdefault(h, w.text(j, j + 1)) == w.text(j, j + 1)


def test_slide_min():
    h = np.random.default_rng(1).integers(0, 50, 300).astype(np.uint64)
    for w in (1, 2, 3, 16, 17, 299, 300):
        assert hashing.slide_min(h, w).tolist() == [min(h[i : i + w]) for i in range(301 - w)]


def test_runs_cover_every_window_once():
    r = random.Random(2)
    for text in (r.randbytes(3000), b"ab" * 400, b"a" * 500, b"x" * 199, b"x" * 200):
        _, s, e = runs.find(hashing.byte_prefix(text), 0, len(text), 200, 32)
        assert [p for a, b in zip(s, e, strict=True) for p in range(a, b + 1)] == list(range(max(0, len(text) - 199)))
        assert len(s) == 0 or (e - s).max() < 200 - 32 + 1


def test_refinement():
    texts = [b"k" * 30 + bytes(range(200)) + b"m" * 9, b"q" * 5 + bytes(range(200)) + b"m" * 4, bytes(range(1, 201)) + b"zz"]
    of, at = suffix_dedup.refine(np.zeros(3, np.int64), texts, 200)
    assert sorted(zip(of.tolist(), at.tolist(), strict=True)) == [(0, i) for i in range(30, 35)] + [(1, i) for i in range(5, 10)]


def test_refinement_at_any_length():
    r = random.Random(4)
    for k in (1, 5, 8, 9, 24, 50, 200):
        texts = [bytes(r.choices(b"ab", k=r.randint(0, 40))) * r.randint(1, 12) for _ in range(12)]
        group = np.array([i % 2 for i in range(12)], np.int64)
        times = {}
        for i, t in enumerate(texts):
            for p in range(len(t) - k + 1):
                times.setdefault((group[i], t[p : p + k]), []).append((i, p))
        of, at = suffix_dedup.refine(group, texts, k)
        assert sorted(zip(of.tolist(), at.tolist(), strict=True)) == sorted(x for xs in times.values() if len(xs) > 1 for x in xs)


def test_parsing():
    block, other = [b"%d" % i for i in range(12)], [b"9", b"10", b"11", b"x", b"y"]
    words = [b"q", *block[2:12], b"x", b"y", b"z"]
    found = [(i, i + 1, block) for i in range(1, 9)] + [(i, i - 8, other) for i in range(8, 11)]
    assert list(substring_dedup.parse(words, found, 3)) == [(1, 11), (9, 13)]
    assert list(substring_dedup.parse(words, [(0, 0, block), (4, 9, block)], 3)) == []  # what the words don't bear out


def test_language_model_separates_and_abstains():
    r = random.Random(1)
    make = lambda ws: " ".join(r.choice(ws) for _ in range(30))
    vocab = {"aa": ["thing", "ought", "the", "with"], "bb": ["être", "queue", "ouais", "les"]}
    rows = [(k, make(v).encode()) for k, v in vocab.items() for _ in range(60)]
    r.shuffle(rows)
    pairs = []
    for _, t in rows:
        f = language.features(t)
        nz = np.flatnonzero(f)
        pairs.append((nz, f[nz].astype(np.float32)))
    m = language.train(pairs, np.array([k == "bb" for k, _ in rows], int), ["aa", "bb"])
    got = language.judge([make(vocab["aa"]).encode(), make(vocab["bb"]).encode(), b"", b"123 !", "²½".encode()], m, m.folded())
    assert [g[0] for g in got] == ["aa", "bb", "und", "und", "und"] and all(0 <= g[1] <= 1 for g in got) and got[0][1] > m.threshold


def thue_morse(n, a="a", b="b"):
    """A string and its complement, which polynomials modulo 2^64 can't tell apart from 1,024 characters on."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def test_words_of_any_shape_are_told_apart():
    x, y = (t.encode() for t in thue_morse(1024))
    assert len(set(hashing.word_hashes(x + b" " + y).tolist())) == 2 and hashing.digest(x) != hashing.digest(y)
    assert not ngram_join.similar(x, y, 4, 85)
    a, b = (hashing.word_hashes(" ".join(t).encode()) for t in thue_morse(64))
    assert hashing.sequences(a, 50)[0] != hashing.sequences(b, 50)[0]


def test_words_of_long_texts():
    text = (b"x" * 700 + b" \n") * 4000 + b"y" * (3 << 20) + b" end"
    assert hashing.word_hashes(text).tolist() == [hashing.word_hashes(w)[0] for w in text.split()]


def shingles(words, n):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def test_similarity_of_words_and_its_bound():
    r = random.Random(8)
    seen = set()
    for _ in range(400):
        a = [r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(0, 60))]
        b = list(a) if r.random() < 0.8 else a[: r.randint(0, 5)]
        for _ in range(r.randint(0, 3)):
            i = r.randint(0, len(b))
            b[i : i + r.randint(0, 2)] = [r.choice("xyz")] * r.randint(0, 2)
        for n, percent in ((4, 85), (5, 80), (1, 50)):
            x, y = shingles(a, n), shingles(b, n)
            want = bool(x & y) and 100 * len(x & y) >= percent * len(x | y)
            p, q = (next(ngram_join.sets([" ".join(w).upper().encode()], n)) for w in (a, b))
            assert ngram_join.similar(" ".join(a).encode(), "  ".join(b).upper().encode(), n, percent) == want and (len(p), len(q)) == (len(x), len(y))
            assert ngram_join.differ(ngram_join.bitmap(p), ngram_join.bitmap(q)) <= len(x ^ y)
            seen.add(want)
    assert seen == {True, False}


def test_decontamination_windows():
    g = decontaminate.grams([("i1", " ".join(f"w{i}" for i in range(15))), ("i2", "Short ITEM"), ("i3", "..."), (None, "x"), ("i4", None)])
    text = "x " + ", ".join(f"W{i}" for i in range(14)) + " y short-item"
    (n, mask, items), (m, none, _) = decontaminate.scan([text.encode(), b""], g)
    assert (n, mask.tolist(), [g.items[i] for i in items]) == (18, [True] * 15 + [False, True, True], ["i1", "i2", None]) and (m, len(none)) == (0, 0)
    assert [decontaminate.contaminated(20, 1), decontaminate.contaminated(21, 1), decontaminate.contaminated(0, 0)] == [True, False, False]
