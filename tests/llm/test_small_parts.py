"""The parts of the operators that need no Spark, against brute force."""

import base64
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from cohortline.llm import bpe, embeddings, fingerprints, language, line_dedup, packing, quality, simhash, toxicity
from cohortline.llm.common import Cache, local_roots, majority_fingerprints
from cohortline.llm.hamming import block_ranges, sub_ranges
from cohortline.llm.line_dedup import edit_similarity, line_form
from cohortline.llm.pretokens import chunks


def brute_edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b), 1)


@settings(deadline=None, max_examples=200)
@given(st.text("abc é", max_size=30), st.text("abc é", max_size=30))
def test_edit_similarity(a, b):
    assert edit_similarity(a, b) == pytest.approx(brute_edit(a, b))


def test_line_form():
    assert line_form('  The "End",  of -- LINES! ') == "the end of lines"
    assert line_form("*** ---") == ""


def test_cache_is_bounded_and_right():
    cache = Cache(lambda x: x * x, 10)
    for i in [*range(50), *range(50)]:
        assert cache[i] == i * i and len(cache) <= 10 and len(cache.old) <= 10


def test_majority():
    rng = np.random.default_rng(0)
    counts = np.array([0, 1, 2, 600, 0, 3])
    hashes = rng.integers(1 << 63, size=counts.sum(), dtype=np.uint64)
    got, start = majority_fingerprints(hashes, counts), 0
    for code, n in zip(got, counts):
        part = hashes[start : start + n]
        want = sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in part) > n)
        assert int(code) == want
        start += n


def test_local_roots():
    assert local_roots(6, np.array([5, 3, 1]), np.array([3, 1, 4])).tolist() == [0, 1, 2, 1, 1, 1]


def test_blocks_cover_all_bits():
    for d in (1, 2, 3):
        for block, (first, width) in enumerate(block_ranges(d)):
            bits = set(range(first, first + width))
            for ranges in sub_ranges(d, block):
                bits |= {b for a, w in ranges for b in range(a, a + w)}
            assert bits == set(range(64))


def near_codes(n, seed):
    rng = random.Random(seed)
    codes = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        code = rng.choice(codes)
        for _ in range(rng.choice([1, 1, 2, 3])):
            code ^= 1 << rng.randrange(64)
        codes.append(code)
    return np.unique(np.array([0, 2**64 - 1, *codes], np.uint64))


@pytest.mark.parametrize("d", [1, 2, 3])
def test_gray_index_finds_all_pairs(d):
    codes = near_codes(400, d)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    found = set()
    for a, b in simhash.GrayIndex(codes).near_pairs(d, 0):
        found |= set(zip(a.tolist(), b.tolist()))
    a, b = np.nonzero(np.triu(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= d, 1))
    assert found == set(zip(a.tolist(), b.tolist()))


def test_shingles():
    assert simhash.shingle_hashes("") == []
    assert simhash.shingle_hashes("A\tb") == simhash.shingle_hashes("a b")
    assert len(simhash.shingle_hashes("a b a b a b")) == 4
    assert simhash.shingle_hashes("É x") != simhash.shingle_hashes("é x")


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_packing_cuts_and_fills(lengths):
    sequences = packing.pack(lengths, 16)
    seen = {(d, t) for s in sequences for d, start, n in s for t in range(start, start + n)}
    assert len(seen) == sum(lengths) == sum(n for s in sequences for *_, n in s)
    full = [sum(n for *_, n in s) for s in sequences]
    assert all(0 < f <= 16 for f in full) and sum(f < 16 for f in full) <= 1


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(1, 16), max_size=40))
def test_first_fit_decreasing(sizes):
    want, rooms = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fit = next((b for b, room in enumerate(rooms) if room >= sizes[i]), None)
        if fit is None:
            fit = len(rooms)
            rooms.append(16)
            want.append([])
        rooms[fit] -= sizes[i]
        want[fit].append(i)
    assert packing.first_fit_decreasing(sizes, 16) == want


@pytest.fixture(scope="module")
def reference():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


SPACES = st.text(st.sampled_from(list(" \n\t 　\x1cab.,'sé1")), max_size=40)
LETTERS = st.text(st.sampled_from(list("abethinorsé漢🙂")), max_size=300)


@settings(deadline=None, max_examples=300)
@given(st.one_of(st.text(max_size=60), SPACES, LETTERS))
def test_bpe_equals_the_library(text):
    own = bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert " ".join(chunks(text)) == text
    ids = own.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == reference_ids(text)
    assert own.decode(ids) == text.encode()


def reference_ids(text, kept=[]):
    if not kept:
        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        kept.append(
            tiktoken.Encoding("r", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        )
    return kept[0].encode_ordinary(text)


def test_long_matches(reference):
    own = bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(0)
    for text in ("a" * 5000, "=" * 3001, "".join(rng.choices("abcdefghi", k=4000)), "é" * 700):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


@settings(deadline=None, max_examples=100)
@given(st.one_of(st.text(max_size=60), SPACES, st.just("a<|endoftext|>b")))
def test_tokens_equal_the_tokenizers_library(text):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    theirs = Tokenizer.from_file(path)
    theirs.encode_special_tokens = True
    want = theirs.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.tokens(path).encode(text), "<u4").tolist() == want


def test_other_tokenizer_files_use_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.byte_level_ranks(path) is None
    assert packing.Tokens(path).encode("hello world")


@settings(deadline=None, max_examples=100)
@given(st.text("abé", max_size=40), st.text("abé", max_size=40), st.data())
def test_prefix_hashes(a, b, data):
    x, y = fingerprints.Prefixes.of(a), fingerprints.Prefixes.of(b)
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    common = 0
    while i + common < len(a) and j + common < len(b) and a[i + common] == b[j + common]:
        common += 1
    assert fingerprints.common_extension(x, i, y, j) == common
    n = min(len(a) - i, len(b) - j)
    assert (x.span(i, n) == y.span(j, n)) == (a[i : i + n] == b[j : j + n])


@settings(deadline=None, max_examples=100)
@given(st.text("abc ", max_size=80), st.text("abc ", max_size=80))
def test_edited_fingerprint_equals_that_of_the_text(a, b):
    text, mark = fingerprints.edited(fingerprints.Document.of(a), fingerprints.Document.of(b))
    m = len(a) // 3
    assert text == a[: len(a) - m] + b[:m]
    assert mark == fingerprints.Document.of(text).fingerprint()


def test_likeness():
    rng = random.Random(0)
    text = "".join(rng.choices("abcdefgh ", k=3000))
    other = "".join(rng.choices("abcdefgh ", k=3000))
    mark = lambda t: fingerprints.Document.of(t).fingerprint()
    assert fingerprints.likeness(mark(text), mark(text)) == 1.0
    assert fingerprints.likeness(mark(text), mark(other)) < 0.1
    assert 0.5 < fingerprints.likeness(mark(text), mark(text[:2000] + other[:1000])) < 0.85
    assert fingerprints.likeness(mark(""), mark("")) == 1.0
    assert fingerprints.likeness(mark(""), mark("x")) == 0.0


def test_hadamard():
    matrix = np.array([[1.0]])
    for _ in range(4):
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(embeddings.hadamard(x), x @ matrix.T)


def test_gram_counts_of_short_and_long_texts_agree():
    text = "Aé b" * 700
    found, counts = language.gram_counts(text)
    assert counts.sum() == 3 * len(text) - 3
    again = np.zeros(1 << language.BITS, int)
    for n in (1, 2, 3):
        f, c = language.gram_counts(text[:1000])
        again[f] = c
    assert set(language.gram_counts(text[:1000])[0]) == set(found)
    assert len(language.gram_counts("")[0]) == 0


def test_temperature():
    rng = np.random.default_rng(0)
    own = rng.integers(3, size=4000)
    sure = np.eye(3)[np.where(rng.random(4000) < 0.8, own, rng.integers(3, size=4000))] * 20
    model = language.softmax(sure / language.fit_temperature(sure, own))
    assert model.max(axis=1).mean() == pytest.approx((sure.argmax(axis=1) == own).mean(), abs=0.02)


def test_ftrl_zeroes_what_does_not_matter():
    rng, rows = np.random.default_rng(0), []
    for _ in range(400):
        own = int(rng.integers(2))
        rows.append((np.array([own, 2 + int(rng.integers(500))]), np.array([1, 1]), own))
    model = language.train(rows, np.ones(600), ["a", "b"])
    assert model.logits(np.array([0]), np.array([1])).argmax() == 0
    assert model.logits(np.array([1]), np.array([1])).argmax() == 1
    assert (model.weights == 0).mean() > 0.1


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    labels = rng.integers(2, size=300)
    rows = [np.unique(np.r_[label, rng.integers(2, 900, 20)]) for label in labels]
    ratios = quality.log_count_ratios(rows, labels)
    weights, bias = quality.dual_descent(rows, labels, ratios)
    model = quality.Model(ratios, weights, bias, 1.0, 0.0)
    assert np.mean([(model.margin(r) > 0) == y for r, y in zip(rows, labels)]) > 0.98


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(0)
    vectors = []
    for _ in range(1500):
        terms = np.unique(rng.zipf(1.5, 6) % 200)
        weights = rng.random(len(terms)) + 0.1
        vectors.append((terms, weights / np.sqrt((weights**2).sum())))
    dense = np.zeros((1500, 200))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    index = toxicity.BlockMaxIndex(vectors)
    for i in range(0, 1500, 30):
        near, cosine = index.nearest(*vectors[i], 25)
        want = dense @ dense[i]
        top = np.lexsort((np.arange(1500), -want.round(12)))[: len(near)]
        assert near.tolist() == top.tolist() and np.allclose(cosine, np.minimum(want[top], 1))


def test_empty_index():
    assert len(toxicity.BlockMaxIndex([]).nearest(np.array([1]), np.array([1.0]), 3)[0]) == 0


def test_repeated_leading_parts_are_terms():
    from collections import Counter

    held = Counter({"vile*": 3, "vilefolk": 3, "grim*": 1})
    assert sorted(toxicity.with_levels(held)) == ["grim*", "vile*", "vile*2", "vile*3", "vilefolk"]
    assert [toxicity.counted_term(t) for t in ("vile*2", "vile*", "vile")] == [("vile*", 2), ("vile*", 1), ("vile", 1)]


def test_counts_of_levels(spark):
    docs = spark.createDataFrame([(1, "Vilefolk vileness grimy"), (2, "vilefolk"), (3, "")], "doc_id long, text string")
    found = toxicity.term_counts(docs, ["vile*2", "grimy", "vile*"], ["doc_id"]).collect()
    assert {r["doc_id"]: (r["terms"], r["counts"]) for r in found} == {
        1: ([0, 1, 2], [2, 1, 2]), 2: ([2], [1]), 3: ([], []),
    }


def test_bucket_codes_differ_by_table():
    unit = embeddings.unit_rows(np.random.default_rng(0).normal(size=(50, 24)))
    codes = embeddings.bucket_codes(unit, 3, 2, 2)
    assert codes.shape == (50, 6) and all(len(set(row)) == 6 for row in codes.tolist())
    assert pa.array(codes.ravel()).null_count == 0


@pytest.mark.parametrize("words", [6, 10, 20, 40])
def test_lines_of_the_similarity_share_a_band(words):
    """Nearly all pairs with up to two changed words, whatever the length of the line."""
    rng = np.random.default_rng(words)
    stock = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(3000)]
    pairs = []
    while len(pairs) < 200:
        one = list(rng.choice(stock, words))
        other = list(one)
        for place in rng.choice(words, rng.integers(1, 3), replace=False):
            other[place] = rng.choice(stock)
        if edit_similarity(" ".join(one), " ".join(other)) >= line_dedup.SIMILARITY:
            pairs.append((" ".join(one), " ".join(other)))
    found = 0
    for one, other in pairs:
        families = [f for f in line_dedup.FAMILIES if all(f[0] <= len(x) <= (f[1] or 10**9) for x in (one, other))]
        found += any((lambda v: (v[:, 0] == v[:, 1]).any())(line_dedup.band_values([one, other], *f[2:])) for f in families)
    assert found >= 196


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "<|endoftext|>", " x <|endoftext|> <|endoftext|>\n", "plain text, <|endof"])
def test_packing_takes_added_tokens_as_the_library_does(text):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.tokens(path, added=True).encode(text), "<u4").tolist() == want


def test_tiles_of_many_buckets_are_compared_by_one_call():
    """Small and large buckets, parts, labels and lengths side by side, against every pair."""
    rng, rows = np.random.default_rng(1), []
    for label, bucket, size, dims, low, high in [("a", 7, 5, 8, 0, 0), ("b", 7, 90, 8, 0, 0), ("a", 9, 3, 4, 0, 0), ("a", 9, 130, 8, 0, 1), ("a", 11, 6, 8, 0, 0)]:
        for _ in range(size):
            vector = np.r_[1.0, np.zeros(dims - 1)] + rng.normal(size=dims) * 0.15
            codes = [bucket, 9] if bucket != 9 else [9, 20]
            rows.append((label, len(rows), 1 + len(rows) % 3, vector, codes, bucket, int(rng.integers(2)), low, high))
    rows = [rows[i] for i in rng.permutation(len(rows))]
    names = ["label", "rep", "copies", "vector", "codes", "bucket", "side", "low", "high"]
    got = embeddings._compare(0.93, pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)}))
    links, root = dict.fromkeys((r[1] for r in rows), 0), {r[1]: r[1] for r in rows}
    for i, a in enumerate(rows):
        for b in rows[:i]:
            same = a[0] == b[0] and a[5] == b[5] and a[7:] == b[7:] and len(a[3]) == len(b[3])
            if same and (a[7] == a[8] or a[6] != b[6]) and min(set(a[4]) & set(b[4])) == a[5]:
                if a[3] @ b[3] >= 0.93 * np.linalg.norm(a[3]) * np.linalg.norm(b[3]):
                    links[a[1]] += b[2]
                    links[b[1]] += a[2]
                    one, other = root[a[1]], root[b[1]]
                    root = {k: one if r == other else r for k, r in root.items()}
    assert dict(zip(got["node"].to_pylist(), got["links"].to_pylist())) == {k: n for k, n in links.items() if n}
    mine = dict(zip(got["node"].to_pylist(), got["root"].to_pylist()))
    assert len({(mine[k], root[k]) for k in mine}) == len(set(mine.values())) == len({root[k] for k in mine})
