"""The operators and queries on Spark, against brute force, held-out labels and odd rows."""

import hashlib
import textwrap
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortline.llm import (
    bpe,
    embeddings,
    fingerprints,
    language,
    licenses,
    line_dedup,
    packing,
    quality,
    simhash,
    toxicity,
)
from cohortline.llm.oracles import ORACLES
from cohortline.llm.queries import QUERIES
from suite.compare import database, difference

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def table(spark, name, folder=SMALL):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def components(n, linked):
    """Smallest index of each group of 0..n-1 under the relation ``linked``."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]


def bits(a, b):
    return bin(a ^ b).count("1")


def brute_groups(rows):
    """(id, text) -> smallest id of its SimHash group, rows without an id as well."""
    codes = [int(simhash.fingerprint_texts([text or ""])[0]) for _, text in rows]
    root = components(len(rows), lambda i, j: bits(codes[i], codes[j]) <= 2)
    low = defaultdict(list)
    for (doc, _), r in zip(rows, root):
        if doc is not None:
            low[r].append(doc)
    return [(doc, f"{c:016x}", min(low[r], default=None)) for (doc, _), c, r in zip(rows, codes, root)]


def test_simhash_groups(spark, odd_docs, rows):
    docs = table(spark, "documents").limit(120).select("doc_id", "text")
    both = docs.unionByName(odd_docs.select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    both = both.union(docs.limit(3).select(F.col("doc_id") + 20_000, F.concat("text", F.lit(" end"))))
    given = [tuple(r) for r in both.collect()]
    fixed = spark.createDataFrame(given, "doc_id long, text string").withColumn("code", F.lit(1))
    got = simhash.near_duplicates(fixed)
    assert rows(got) == sorted(brute_groups(given), key=repr)
    kept = simhash.one_per_group(fixed)
    assert kept.columns == fixed.columns
    want = {(d, t) for (d, t), (_, _, low) in zip(given, brute_groups(given)) if d == low}
    assert rows(kept, "doc_id", "text") == sorted(want, key=repr)


def brute_lines(docs):
    """Texts after dedup, for documents with distinct ids in ascending order."""
    places = [(i, p, line) for i, (_, text) in enumerate(docs) for p, line in enumerate((text or "").split("\n"))]
    places = [(i, p, line_dedup.line_form(line)) for i, p, line in places]
    places = [x for x in places if x[2]]
    codes = []
    for *_, form in places:
        hashes = {line_dedup._hashes[w] for w in form.split()}
        codes.append(int(line_dedup.majority_fingerprints(np.frombuffer(b"".join(hashes), "<u8"), np.array([len(hashes)]))[0]))

    def linked(i, j):
        return places[i][2] == places[j][2] or (
            bits(codes[i], codes[j]) <= 3 and line_dedup.edit_similarity(places[i][2], places[j][2]) >= 0.8
        )

    root = components(len(places), linked)
    gone = {places[i][:2] for i in range(len(places)) if root[i] != i}
    return [
        (doc, text if text is None else "\n".join(x for p, x in enumerate(text.split("\n")) if (i, p) not in gone))
        for i, (doc, text) in enumerate(docs)
    ]


WORDS = [f"word{i}" for i in range(300)]


def line_docs():
    rng, docs = np.random.default_rng(0), []
    stock = [" ".join(rng.choice(WORDS, 40)) for _ in range(12)]
    for doc in range(40):
        lines = []
        for _ in range(rng.integers(1, 5)):
            words = stock[rng.integers(12)].split()
            for _ in range(rng.integers(0, 3)):
                words[rng.integers(len(words))] = rng.choice(WORDS)
            lines.append(" ".join(words).upper() if rng.random() < 0.2 else " ".join(words) + ".")
        docs.append((doc, "\n".join([*lines, "", "Common, short", "---"])))
    return [*docs, (40, None), (41, ""), (42, "| a | b |\n| c | d |\nx " + "y " * 20_000)]


def test_line_dedup(spark, docs_of):
    given = line_docs()
    done = line_dedup.dedup_lines(docs_of(given).withColumn("key", F.lit("k")).repartition(5))
    got = {r["doc_id"]: r["text"] for r in done.collect()}
    assert got == dict(brute_lines(given))
    assert done.columns[:7] == ["doc_id", "text", "lang", "source", "n_chars", "score", "key"]


def test_line_dedup_of_odd_rows(odd_docs):
    done = line_dedup.dedup_lines(odd_docs).collect()
    got = sorted(((r["doc_id"], r["text"], r["_n_dropped"]) for r in done), key=repr)
    # The first "x" by id stays, as do equal rows alike; the one without an id goes.
    assert [(5, "x", 0), (5, "x", 0)] == [g for g in got if g[0] == 5]
    assert (None, "", 1) in got and (None, None, 0) in got and (1, None, 0) in got
    assert len(got) == 9


def test_line_dedup_finds_changed_words_in_short_lines(spark, docs_of):
    """Against edit similarity alone, for the candidates that the query and the pipeline use."""
    rng, given = np.random.default_rng(3), []
    stock = [[f"{w}{''.join(rng.choice(list('aeioubcdfg'), 4))}" for w in rng.choice(WORDS, n)] for n in (1, 3, 6, 8, 12, 20, 40) * 4]
    for doc in range(60):
        lines = []
        for _ in range(3):
            words = list(stock[rng.integers(len(stock))])
            for _ in range(rng.integers(0, 3)):
                words[rng.integers(len(words))] = str(rng.choice(WORDS))
            lines.append(" ".join(words))
        given.append((doc, "\n".join(lines)))
    forms = [(i, p, line_dedup.line_form(x)) for i, (_, text) in enumerate(given) for p, x in enumerate(text.split("\n"))]
    root = components(len(forms), lambda i, j: line_dedup.edit_similarity(forms[i][2], forms[j][2]) >= 0.8)
    want = {forms[i][:2] for i in range(len(forms)) if root[i] != i}

    def dropped(**options):
        drops = line_dedup.duplicate_lines(docs_of(given), **options).join(
            docs_of(given).select("doc_id", F.xxhash64("doc_id", "text").alias("row")), "row"
        )
        return {(r["doc_id"], p) for r in drops.collect() for p in r["drops"]}

    got = dropped(max_bits=None)
    assert got <= want and len(got) >= 0.98 * len(want)
    assert len(dropped()) < 0.9 * len(want)


def lines_by_similarity(given):
    """(id, text) -> texts after dedup by edit similarity alone: what the line stage must find."""
    places = [(i, p, line_dedup.line_form(x)) for i, (_, text) in enumerate(given) for p, x in enumerate((text or "").split("\n"))]
    places = [x for x in places if x[2]]

    def linked(i, j):
        a, b = places[i][2], places[j][2]
        return min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and line_dedup.edit_similarity(a, b) >= 0.8

    root = components(len(places), linked)
    gone = {places[i][:2] for i in range(len(places)) if root[i] != i}
    return {
        doc: text if text is None else "\n".join(x for p, x in enumerate(text.split("\n")) if (i, p) not in gone)
        for i, (doc, text) in enumerate(given)
    }


def test_line_stage_of_the_pipeline(spark):
    """On real documents against edit similarity alone."""
    docs = table(spark, "documents").filter("doc_id < 60")
    given = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    got = corpus_pipeline.dedup_lines(spark, docs, SMALL)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == lines_by_similarity(given)


def scores(df, names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in df.collect()}


def test_language(spark, odd_docs):
    docs = table(spark, "documents", MIDDLE)
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = scores(QUERIES["op3_language_id"](spark, MIDDLE), ["held_out", "lang_pred", "score"])
    assert got.keys() == truth.keys()
    for doc, (held, _, score) in got.items():
        assert held == (zlib.crc32(str(doc).encode()) % 3 == 1) and 0 <= score <= 1
    held = [truth[d] == lang for d, (h, lang, _) in got.items() if h]
    assert np.mean(held) > 0.97
    odd = language.identify(odd_docs.withColumn("lang", F.when(F.col("doc_id") == 4, "en"))).collect()
    assert len(odd) == 9 and {r["lang_pred"] for r in odd if r["doc_id"] in (1, 2, 3)} == {"und"}


def labels_of(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id long, quality int, toxic int")


def test_quality(spark, odd_docs):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, "labels", MIDDLE).collect()}
    got = scores(QUERIES["op4_quality"](spark, MIDDLE), ["held_out", "score", "predicted"])
    for doc, (held, score, predicted) in got.items():
        assert held == (zlib.crc32(str(doc).encode()) % 5 == 0) and predicted == (score >= 0.3)
    assert len(got) == table(spark, "documents", MIDDLE).count()
    held = [labels[d] == p for d, (h, _, p) in got.items() if h and d in labels]
    assert np.mean(held) > 0.95
    odd = quality.classify(odd_docs, labels_of(spark, [(4, 1, 0), (2, 0, 0), (None, 1, 1), (3, None, None)]))
    assert odd.count() == 9
    assert {r["score"] for r in quality.classify(odd_docs, labels_of(spark, [])).collect()} == {0.5}


def test_toxicity(spark, docs_of, odd_docs):
    rng, given, pairs = np.random.default_rng(0), [], []
    for doc in range(600):
        words, toxic = list(rng.choice(WORDS, 60)), int(doc % 3 == 0)
        if toxic:
            words += list(rng.choice(["vilefolk", "vileness", "grimy", "filth"], 3))
        given.append((doc, " ".join(rng.permutation(words))))
        pairs.append((doc, 1, toxic))
    result = toxicity.classify(docs_of(given), labels_of(spark, pairs))
    got = scores(result, ["held_out", "score", "predicted", "evidence"])
    for doc, (held, score, predicted, evidence) in got.items():
        assert held == (zlib.crc32(str(doc).encode()) % 3 == 1) and predicted == (score >= 0.7)
        assert all(zlib.crc32(str(e["doc_id"]).encode()) % 3 != 1 for e in evidence)
    assert np.mean([got[d][2] == t for d, _, t in pairs if got[d][0]]) > 0.98
    odd = toxicity.classify(odd_docs, labels_of(spark, [(4, 1, 1), (2, 0, 0), (2, 0, 0), (3, 1, None)]))
    assert odd.count() == 9


def test_packing(spark, odd_docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    theirs = Tokenizer.from_file(path)
    docs = table(spark, "documents").select("doc_id", "text")
    some = odd_docs.filter("doc_id is null or doc_id != 5").select(F.col("doc_id") + 10_000, "text")
    docs = docs.union(some)
    pieces = packing.pack_documents(docs, path, group_bytes=200_000).toPandas()
    sequences = pieces.sort_values("offset").groupby("sequence_id")
    assert sequences["length"].sum().max() <= 2048
    for _, one in sequences:
        assert one["offset"].tolist() == [0, *np.cumsum(one["length"])[:-1]]
    assert pieces["length"].sum() / (2048 * sequences.ngroups) > 0.9
    for r in docs.filter("doc_id is not null").collect():
        ids = np.array([*theirs.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        own = pieces[pieces["doc_id"] == r["doc_id"]].sort_values("start")
        assert own["start"].tolist() == [0, *np.cumsum(own["length"])[:-1]]
        assert own["length"].sum() == len(ids) and set(own["doc_tokens"]) == {len(ids)}
        for start, length, crc in zip(own["start"], own["length"], own["ids_crc32"]):
            assert zlib.crc32(ids[start : start + length].tobytes()) == crc
    assert pieces["doc_id"].isna().sum() == 2


def test_bpe(spark, odd_docs):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, "documents").limit(50).select("doc_id", "text").union(odd_docs.select("doc_id", "text"))
    got = bpe.decode_documents(bpe.encode_documents(docs, path, pattern), path, pattern).collect()
    given = [r["text"] or "" for r in docs.collect()]
    digest = lambda data: hashlib.sha256(data).hexdigest()
    own = bpe.encoder(path, pattern)
    assert sorted(r["decoded_sha256"] for r in got) == sorted(digest(t.encode()) for t in given)
    assert sorted((r["n_tokens"], r["ids_sha256"]) for r in got) == sorted(
        (len(own.encode(t)) // 4, digest(own.encode(t))) for t in given
    )


def test_license_scan(spark, odd_docs, docs_of):
    sql, query = ORACLES["op7_license_scan"], QUERIES["op7_license_scan"]
    assert difference(query(spark, SMALL), database(SMALL), sql)[1] is None
    mit = licenses.LICENSES[0][1]
    given = [(1, "Copyright (c) 2020 A\n\n" + mit.lower().replace("license", "licence")), (2, mit + " more")]
    given += [(3, "Text.\n# SPDX-License-Identifier: ISC\nReleased under the MIT Licence")]
    known = licenses.built_in(spark)
    got = scores(licenses.scan_licenses(docs_of(given), known), ["license_id", "line_licenses"])
    assert got == {1: ("MIT", ""), 2: (None, ""), 3: (None, "ISC,MIT")}
    odd = licenses.scan_licenses(odd_docs, known)
    assert odd.count() == 9 and odd.filter("license_id is not null or line_licenses != ''").count() == 0
    assert not any(w in licenses.scan_licenses(odd_docs, known)._jdf.queryExecution().toString() for w in ("Python", "Arrow"))


def test_license_scan_at_any_width(spark, docs_of):
    """Where lines are wrapped, and which notices stand above, doesn't change what is found."""
    notices = ["Copyright (c) 2020 A", "Copyright 2019-2021 The Holders of B", "(c) 2001 C", "© D", "Copyright The E Authors", "Copyright: F"]
    given, want = [], {}
    for number, (name, text) in enumerate((n, t) for n, t in licenses.LICENSES if len(t) > 300):
        for width in range(12, 100, 4):
            doc = 1000 * number + width
            wrapped = "\n".join("\n".join(textwrap.wrap(x, width, break_on_hyphens=False, break_long_words=False)) for x in text.split("\n"))
            given.append((doc, notices[width // 4 % 6] + "\nAll rights reserved.\n\n" + wrapped))
            want[doc] = name
    got = scores(licenses.scan_licenses(docs_of(given), licenses.built_in(spark)), ["license_id"])
    assert got == {doc: (name,) for doc, name in want.items()}
    kept = ["copyright notice and this", "copyright holders be liable", "(c) You must retain", "copyright", "Copyright License."]
    lines = docs_of(list(enumerate([*kept, *notices])))
    forms = {r["doc_id"]: len(r["f"]) for r in lines.select("doc_id", licenses.line_forms(F.translate("text", licenses.UPPER, licenses.LOWER)).alias("f")).collect()}
    assert [forms[i] for i in range(11)] == [1] * 5 + [0] * 6


def test_license_scan_of_full_texts(spark, docs_of):
    """Every known full text: alone at two widths, and as a part of a longer document."""
    full, given, want = licenses.full_texts(), [], {}
    assert {n for n, _ in full} >= {"MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-3.0", "0BSD"}
    for number, (name, text) in enumerate(full):
        # Notices stay on their lines: the rest of a wrapped one can't be told from the text.
        narrow = "\n".join("\n".join([x] if "(c)" in x.lower() else textwrap.wrap(x, 50, break_on_hyphens=False, break_long_words=False)) for x in text.split("\n"))
        given += [(3 * number, text), (3 * number + 1, "Copyright (c) 2020 A\n\n" + narrow), (3 * number + 2, "A tool.\n" + narrow + "\n\nUsage: none.")]
        want |= {3 * number: (name, ""), 3 * number + 1: (name, ""), 3 * number + 2: (None, name)}
    got = scores(licenses.scan_licenses(docs_of(given), licenses.built_in(spark)), ["license_id", "line_licenses"])
    # The Apache text holds the one-line notice, which a wrap may put on a line of its own.
    got = {d: (i, "" if i == "Apache-2.0" else found) for d, (i, found) in got.items()}
    assert got == want


def test_embeddings(spark):
    rng, given = np.random.default_rng(0), []
    centres = rng.normal(size=(12, 48))
    for i in range(400):
        vector = centres[rng.integers(12)] + rng.normal(size=48) * rng.choice([0.02, 0.25])
        given.append((i, [float(np.float32(x)) for x in vector], int(rng.integers(2))))
    given += [(400 + i, given[7][1], given[7][2]) for i in range(5)]
    given += [(500, None, 1), (501, [0.0] * 48, 1), (502, [None] + [1.0] * 47, 1), (503, [float("nan")] * 48, 1)]
    given += [(504, given[7][1], None), (505, [1.0, 2.0], 1), (506, [float("inf")] * 48, 1), (507, [], 1)]
    given += [(None, given[7][1], given[7][2]), (508, [1e30] * 48, 1), (509, [2e30] * 48, 1)]
    frame = spark.createDataFrame(given, "vec_id long, embedding array<float>, label int").withColumn("key", F.lit(1))
    got = {r["vec_id"]: tuple(r)[1:] for r in embeddings.near_vectors(frame, tile=40).collect()}
    good = [g for g in given if g[0] is not None and g[0] < 500 or g[0] in (508, 509)]
    unit = embeddings.unit_rows(np.array([g[1] for g in good]))
    near = (unit @ unit.T >= 0.93) & np.array([[a[2] == b[2] for b in good] for a in good])
    root = components(len(good), lambda i, j: near[i, j])
    want = near.sum(axis=1) - 1
    mine = np.array([got[g[0]][0] for g in good])
    assert (mine <= want).all() and mine.sum() >= 0.97 * want.sum()
    agree = [got[g[0]][1] == good[r][0] for g, r in zip(good, root)]
    assert np.mean(agree) > 0.97 and got[508][:2] == (1, 508) and got[509][:2] == (1, 508)
    assert all(got[i] == (0, i, True) for i in (500, 501, 502, 503, 504, 505, 506, 507))
    assert got[None] == (0, None, False)
    assert all(v[2] == (v[1] == k) for k, v in got.items() if k is not None)


def test_embedding_recall(spark):
    frame = table(spark, "embeddings", MIDDLE).toPandas()
    got = QUERIES["op8_embedding_dedup"](spark, MIDDLE).toPandas().set_index("vec_id")
    unit = embeddings.unit_rows(np.stack(frame["embedding"]))
    near = (unit @ unit.T >= 0.93) & (frame["label"].values[:, None] == frame["label"].values[None, :])
    links = near.sum(axis=1) - 1
    assert got.loc[frame["vec_id"], "n_links"].sum() >= 0.9 * links.sum()
    assert (got.loc[frame["vec_id"], "n_links"].values <= links).all()


def test_dealing_of_tiles_never_changes_links(spark):
    rng = np.random.default_rng(2)
    given = [(i, (rng.normal(size=16) * 0.05 + np.eye(16)[i % 3]).tolist(), i % 2) for i in range(150)]
    frame = spark.createDataFrame(given, "vec_id long, embedding array<double>, label int")
    one, many = ({tuple(r) for r in embeddings.near_vectors(frame, tile=20, group_numbers=n).collect()} for n in (10**9, 100))
    assert one == many and sum(r[1] for r in one)


def test_fingerprints(spark, odd_docs):
    docs = table(spark, "documents").limit(90).select("doc_id", "text")
    docs = docs.union(odd_docs.filter("doc_id is null or doc_id != 5").select(F.col("doc_id") - 100, "text"))
    given = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    got = fingerprints.fingerprint_documents(docs, part_bytes=40_000).collect()
    named = sorted((g for g in given if g[0] is not None), reverse=True)
    texts = [t for _, t in named]
    # The first row without an id follows the last id; which one is told by its hash.
    loose = {t for d, t in given if d is None}
    by_id = {r["doc_id"]: r for r in got}
    for i, (doc, text) in enumerate(named):
        m, r = len(text) // 3, by_id[doc]
        follows = {texts[i + 1]} if i + 1 < len(named) else loose
        edits = {text[: len(text) - m] + n[:m] for n in follows}
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] in {hashlib.sha256(e.encode()).hexdigest() for e in edits}
        assert r["fingerprint"] == fingerprints.Document.of(text).fingerprint()
    assert len(got) == len(given) and sum(r["doc_id"] is None for r in got) == 2
    marks = {(r["fingerprint"]) for r in got}
    assert len(marks) == len({t for _, t in given})


def test_empty_tables(spark, docs_of):
    none = docs_of([])
    labels = labels_of(spark, [])
    path, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    encoded = bpe.encode_documents(none, ranks, public_tokenizers.PATTERN)
    for df in (
        toxicity.classify(none, labels),
        line_dedup.dedup_lines(none),
        language.identify(none),
        quality.classify(none, labels),
        packing.pack_documents(none, path),
        bpe.decode_documents(encoded, ranks, public_tokenizers.PATTERN),
        licenses.scan_licenses(none, licenses.built_in(spark)),
        embeddings.near_vectors(vectors),
        fingerprints.fingerprint_documents(none),
        simhash.near_duplicates(none),
        simhash.one_per_group(none),
    ):
        assert df.count() == 0


def test_pipeline(spark):
    """Each stage against its rejections or a brute-force version, on what the one before kept."""
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "line_dedup", "simhash_dedup", "packing"]
    docs = table(spark, "documents").filter("doc_id < 60").cache()
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(spark, docs, SMALL).cache()
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == columns
        kept[name] = (before, after)
        if name == "language_id":
            judged = language.identify(spark.createDataFrame(table(spark, "documents").filter("doc_id < 60").collect()))
            gone = {r["doc_id"] for r in judged.collect() if r["lang_pred"] == "und" or r["score"] < 0.4}
            assert before.keys() - after.keys() == gone
    before, after = kept["line_dedup"]
    assert after == lines_by_similarity(sorted(before.items()))
    before, after = kept["simhash_dedup"]
    groups = brute_groups(sorted(before.items()))
    assert after == {d: before[d] for d, _, low in groups if d == low}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).toPandas()
    assert set(pieces["doc_id"]) == set(after)


def test_packing_takes_added_tokens_as_the_library_does(docs_of):
    from tokenizers import Tokenizer

    path, text = public_tokenizers.path("byte_bpe_50k.json"), "a <|endoftext|> b"
    want = np.array([*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, packing.END_ID], "<u4")
    (row,) = packing.pack_documents(docs_of([(1, text)]), path).collect()
    assert (row["doc_tokens"], row["ids_crc32"]) == (len(want), zlib.crc32(want.tobytes()))
