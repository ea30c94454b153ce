"""Manifest, exact copies and token alignment against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cohortline.llm import alignment, common, exact_dedup, language, manifest, toxicity
from cohortline.llm.oracles import ORACLES
from cohortline.llm.queries import QUERIES
from suite.compare import database, difference

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf double"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(doc_id, text, lang, source, n_chars):
    fields = [doc_id, source, lang, n_chars, text]
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def brute_tree(nodes):
    """Root, and for each node its siblings (left, right) level by level."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, place):
            run = i // 3 * 3
            path.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 3])))
        place = [i // 3 for i in place]
        nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute_manifest(rows):
    by_source = defaultdict(list)
    for row in rows:
        by_source[row[3]].append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = {}, []
    for source, held in by_source.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(*r[:5])))
        trees[source] = brute_tree([brute_leaf(*r[:5]) for r in held])
    root, tops = brute_tree([trees[s][0] for s in order])
    for source, top in zip(order, tops):
        subroot, paths = trees[source]
        for row, path in zip(by_source[source], paths):
            doc_id, text = row[:2]
            if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = brute_leaf(doc_id, text, *row[2:5])
            for left, right in path + top:
                folded = sha(left + folded + right)
            proof = sha("".join(left + right for left, right in path + top))
            out.append((doc_id, brute_leaf(*row[:5]), subroot, root, proof, folded, folded == root))
    return sorted(out, key=repr)


def manifest_rows():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(90):
        text = "\n".join(f"line {j}" for j in range(rng.integers(0, 4)))
        source = [None, "", "a", "é", "z", "a\x00"][int(rng.integers(6)) if i % 3 else 2]
        rows.append((int(rng.integers(-200, 200)), text, "en", source, len(text), 0.5))
    # Ids far apart, no id, equal ids with other texts, equal rows, and nulls everywhere.
    rows += [(i, "far\n", "en", "a", 4, None) for i in (-(1 << 62), 1 << 40, (1 << 40) + 63, (1 << 62) + 5)]
    rows += [(None, f"x{i}", None, "a", None, 1.0) for i in range(5)] + [(None,) * 6] * 2
    rows += [(7, f"tie {i}\n", "en", "a", 3, 0.0) for i in range(9)] + [(7, "tie 1\n", "en", "a", 3, 0.0)] * 11
    return [*rows, (9, "long\n" * 50_000, "en", "only", 1, None)]


@pytest.mark.parametrize("stage", [1, 2, manifest.STAGE])
def test_manifest(spark, rows, stage):
    given = manifest_rows()
    docs = spark.createDataFrame(given, SCHEMA).repartition(5)
    tampered = manifest.without_breaks(F.col("doc_id"), F.col("text"))
    got = manifest.manifest(docs, tampered, stage=stage)
    assert rows(got) == brute_manifest(given)


def test_manifest_of_few_rows(spark, rows):
    assert rows(manifest.manifest(spark.createDataFrame([], SCHEMA))) == []
    one = [(3, "a\nb", "en", "s", 3, 1.0)]
    got = rows(manifest.manifest(spark.createDataFrame(one, SCHEMA)))
    leaf = brute_leaf(*one[0][:5])
    assert got == [(3, leaf, leaf, leaf, sha(""), leaf, True)]


def test_numbers_follow_the_order(spark, rows):
    keys = [f"k{i:04d}" for i in np.random.default_rng(0).permutation(3000)]
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(7)
    assert rows(common.numbered(df, "k")) == [(k, i) for i, k in enumerate(sorted(keys))]


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_exact_dedup"])
def test_queries_equal_their_sql(spark, name):
    for folder in (SMALL, MIDDLE):
        count, found = difference(QUERIES[name](spark, folder), database(folder), ORACLES[name])
        assert count and found is None


def brute_copies(given):
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(given):
        groups[text or ""].append((doc_id is not None, doc_id or 0, i))
    out = []
    for text, held in groups.items():
        known, top, kept = max(held)
        for _, _, i in held:
            out.append((given[i][0], top if known else None, len(held), i == kept, sha(text)))
    return sorted(out, key=repr)


def copies_rows(odd):
    block = exact_dedup.BLOCK_BYTES
    rng = np.random.default_rng(5)
    stock = ["".join(rng.choice(list("abcé"), n)) for n in (10, block, block, 3 * block, 9 * block + 7)]
    rows = [(i, stock[rng.integers(len(stock))]) for i in range(60)]
    # One letter apart at the end, the start and a block's border; prefixes; blocks swapped.
    long = "x" * block + "y" * block + "z" * block
    rows += [(100, long), (101, long[:-1] + "Z"), (102, "X" + long[1:]), (103, long[:block]), (104, long)]
    rows += [(105, long[block:] + long[:block]), (106, long[: 2 * block]), (107, long + "x"), (104, long)]
    return [*odd, *rows, (None, long), (None, "alone"), (None, "alone"), (8, ""), *[(200 + i, "hot") for i in range(300)]]


@pytest.mark.parametrize("parts", [1, 6])
def test_exact_copies(spark, rows, odd_docs, parts):
    odd = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    given = copies_rows(odd)
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(parts)
    docs = docs.withColumns({"row": F.lit(1), "name": F.lit(2), "blocks": F.lit("x")})
    got = exact_dedup.exact_duplicates(docs)
    assert rows(got) == brute_copies(given)
    assert rows(exact_dedup.exact_duplicates(docs.limit(0))) == []


def test_exact_copies_have_no_python_on_their_path(spark):
    plan = QUERIES["op13_exact_dedup"](spark, SMALL)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "InArrow"))


def test_names_of_blocks_are_equal_only_for_equal_blocks(spark):
    given = copies_rows([])
    docs = spark.createDataFrame(given, "doc_id long, text string")
    named = exact_dedup.identities(docs).collect()
    assert len({r["row"] for r in named}) == len(given)
    names = defaultdict(set)
    for r in named:
        names[r["blocks"], r["name"]].add(r["text_sha256"])
    assert all(len(held) == 1 for held in names.values())
    assert len(names) == len({text or "" for _, text in given})


PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The byte that each letter of a byte-level vocabulary stands for.
BYTE_OF = {chr(b): b for b in KEPT} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*KEPT}))}


def brute_alignment(given):
    own = Tokenizer.from_file(PATHS[0])
    own.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    held, counts = [], Counter()
    for doc_id, text in given:
        whole = (" " + (text or "")).encode()
        a = own.encode(" " + (text or ""), add_special_tokens=False).ids
        b = pieces.encode(text or "")
        bytes_a = [bytes(map(BYTE_OF.get, own.id_to_token(i))) for i in a]
        bytes_b = [
            bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i)
            else pieces.id_to_piece(i).replace("\u2581", " ").encode()
            for i in b
        ]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            held.append((doc_id, 0, 0, 0, [], ""))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
        links, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            x, y = ends_a[i], ends_b[j]
            i, j = i + (x <= y), j + (y <= x)
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            k, m = int(np.searchsorted(ends_a, end)) + 1, int(np.searchsorted(ends_b, end)) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            i, j = k, m
        counts.update(set(links))
        held.append((doc_id, len(a), len(b), len(groups), links, sha(";".join(groups))))
    most = Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return sorted(
        ((d, a, b, g, len(ls), sum(counts[p] == most[p[0]] for p in ls), sum(counts[p] for p in ls), s)
         for d, a, b, g, ls, s in held), key=repr,
    )


def alignment_rows(odd):
    return [
        *odd,
        *((i, t) for i, t in enumerate(["a", " ", "  two  spaces ", "\n\n\tx", "naïve café 東京 🚀🚀", "<s> </s> <unk>"])),
        (50, "<|endoftext|> in text"), (51, "low \u2581 line"), (52, "aaaaaaaaaaaa" * 50), (53, "\u0627\u0644" * 40),
        (54, "x\u0000y"), (55, "e\u0301 \ufb01 ½ ①"), (56, "long " * 9000), (56, "long " * 3),
    ]


@pytest.mark.parametrize("heavy", [0, 40, alignment.HEAVY])
def test_alignment(spark, rows, odd_docs, heavy):
    odd = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    plain = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).select("doc_id", "text").collect()
    given = [*alignment_rows(odd), *map(tuple, plain)]
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    docs = docs.withColumns({"row": F.lit(1), "codes": F.lit(2)})
    assert rows(alignment.align_tokens(docs, *PATHS, heavy=heavy)) == brute_alignment(given)


def test_alignment_of_no_rows(spark, rows):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert rows(alignment.align_tokens(docs, *PATHS)) == []
    nulls = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert rows(alignment.align_tokens(nulls, *PATHS)) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_shared_cuts():
    rng = np.random.default_rng(1)
    for texts in [0, 1, 1, 2, 40] * 20:
        a, b, upto_a, upto_b, last = [], [], [], [], 0
        for _ in range(texts):
            size = int(rng.integers(1, 80))
            for ends, upto in ((a, upto_a), (b, upto_b)):
                inside = set(rng.integers(1, size + 1, rng.integers(0, 60)).tolist()) - {size}
                ends += [last + e for e in [*sorted(inside), size]]
                upto.append(len(ends))
            last += size
        got = alignment.shared_cuts(*(np.array(x, np.int64) for x in (a, b, upto_a, upto_b)))
        shared = sorted(set(a) & set(b))
        assert [x.tolist() for x in got] == [[a.index(e) + 1 for e in shared], [b.index(e) + 1 for e in shared]]


def test_alignment_query(spark, rows):
    given = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(QUERIES["op11_token_alignment"](spark, SMALL)) == brute_alignment(given)


def test_only_letters_count_as_letters(spark, docs_of):
    plain = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    signs = ["²", "½ ¾", "① ②", "Ⅷ", "٣", "_", "1 2"]
    odd = spark.createDataFrame([(90_000 + i, t, None, "s", 1) for i, t in enumerate([*signs, "é", "Ж"])], plain.schema)
    judged = {r["doc_id"]: r for r in language.identify(plain.union(odd)).filter("doc_id >= 90000").collect()}
    assert all(judged[90_000 + i]["lang_pred"] == "und" and judged[90_000 + i]["score"] == 0 for i in range(len(signs)))
    assert all(judged[90_000 + i]["lang_pred"] != "und" for i in range(len(signs), len(signs) + 2))


def test_results_find_their_row_by_text(spark, rows, docs_of, odd_docs):
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    for judged in (language.identify(odd_docs, with_key=True), toxicity.classify(odd_docs, labels, with_key=True)):
        want = odd_docs.select("doc_id", common.text_key(F.col("text")))
        assert rows(judged, "doc_id", "text_key") == rows(want)
        assert "text_key" not in language.identify(odd_docs).columns


def test_pipeline_rejects_rows_not_ids(spark, rows, docs_of):
    given = [(1, "good text"), (1, "bad"), (None, "bad"), (None, "good text"), (2, None), (2, "")]
    docs = docs_of(given).withColumns({"_rejected": F.lit("x"), "text_key": F.lit(1)})
    judged = spark.createDataFrame([("bad", 1), ("good text", 0), ("", 0)], "text string, predicted int")
    judged = judged.select(common.text_key(F.col("text")).alias("text_key"), "predicted")
    kept = corpus_pipeline._without(docs, judged, F.col("predicted") == 1)
    assert kept.columns == docs.columns
    assert rows(kept, "doc_id", "text") == sorted([g for g in given if g[1] != "bad"], key=repr)


def test_pipeline_of_odd_and_no_rows(spark, odd_docs):
    for docs in (odd_docs.withColumn("_rejected", F.lit(1)), odd_docs.limit(0)):
        columns, expected = docs.columns, docs.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SMALL).cache()
            assert docs.columns == columns and docs.count() <= expected
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() >= docs.count()
