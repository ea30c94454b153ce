"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine.

Terms are words and leading parts of words; a leading part found repeatedly in a text is a
further term, since cosines forget how much of a text its terms are. From a bounded sample of labelled rows (one
of each family of near copies) those are kept that tell the classes apart (likelihood ratio test and odds ratio); their document
frequencies are then counted over all documents. Examples sit in an inverted index whose
postings are cut into blocks of examples with the largest weight of each. A query adds up
these maxima, visits blocks from the highest sum down, and stops when no further block can
reach the k-th best cosine, so its k nearest are exact. Votes weighted by distance are
calibrated on examples outside the index.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortline.core.workspace import materialise
from cohortline.llm.common import Cache, id_and_text, remainder, slices, text_key
from cohortline.llm.sampling import fit_sigmoid, labelled_sample, one_per_family, sigmoid

#: Labelled rows per class, terms, least test statistic (strict, as very many terms are
#: tested) and least odds ratio of a term.
SAMPLE, TERMS, LEAST_TEST, LEAST_ODDS = 4000, 4096, 30.0, 4.0
NEIGHBOURS, BLOCK, WAVE = 25, 64, 8
LEADS = (4, 5, 6, 7, 8)
#: A leading part that occurs at least so often in a text is a term of its own.
LEVELS = (2, 3)
THRESHOLD, EVIDENCE = 0.7, 5
#: Words whose terms a task remembers.
CACHED = 100_000
_word = re.compile(r"\w+")


def terms_of(chunk: str) -> list[str]:
    """Terms of a piece of text without white space: words, and their first characters."""
    found = []
    for word in _word.findall(chunk.lower()):
        found.append(word)
        found += [word[:n] + "*" for n in LEADS if len(word) > n]
    return found


def with_levels(counts: Counter) -> Iterator[str]:
    """The terms counted in a text, and those that stand for repeated leading parts."""
    for term, count in counts.items():
        yield term
        if term.endswith("*"):
            yield from (f"{term}{least}" for least in LEVELS if count >= least)


def counted_term(term: str) -> tuple[str, int]:
    """The term whose occurrences decide on ``term``, and the least number of them."""
    part, star, least = term.partition("*")
    return part + star, int(least or 1)


class BlockMaxIndex:
    """Inverted index with the largest weight of every block of examples."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]]):
        """``vectors``: term numbers and weights of each example, of length one."""
        # Examples with the same strongest term are neighbours, which makes blocks alike.
        lead = [int(t[w.argmax()]) if len(t) else -1 for t, w in vectors]
        self.order = np.argsort(lead, kind="stable")
        self.blocks = -(-len(vectors) // BLOCK)
        listed: dict[int, list] = {}
        for place, example in enumerate(self.order):
            for term, weight in zip(*vectors[example]):
                listed.setdefault(int(term), []).append((place, weight))
        self.postings = {}
        for term, entries in listed.items():
            place = np.array([p for p, _ in entries])
            weight = np.array([w for _, w in entries])
            block, start = np.unique(place // BLOCK, return_index=True)
            most = np.maximum.reduceat(weight, start)
            self.postings[term] = (block, most, np.r_[start, len(place)], place, weight)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest cosine above 0 (ties: the earlier example), and cosines."""
        bound = np.zeros(self.blocks)
        asked = [(w, self.postings[int(t)]) for t, w in zip(terms, weights) if int(t) in self.postings]
        for w, (block, most, *_) in asked:
            bound[block] += w * most
        visit = np.argsort(-bound, kind="stable")
        best, cosines = np.zeros(0, np.int64), np.zeros(0)
        for first in range(0, len(visit), WAVE):
            wave = visit[first : first + WAVE]
            wave = wave[bound[wave] > 0]
            if not len(wave) or len(best) == k and bound[wave[0]] < cosines[-1] - 1e-9:
                break
            score = np.zeros(self.blocks * BLOCK) if self.blocks <= WAVE else None
            totals: dict[int, float] = {}
            for w, (block, _, start, place, weight) in asked:
                at = np.searchsorted(block, wave)
                hit = at < len(block)
                hit[hit] = block[at[hit]] == wave[hit]
                for a in at[hit]:
                    part = slice(start[a], start[a + 1])
                    if score is not None:
                        score[place[part]] += w * weight[part]
                    else:
                        for p, x in zip(place[part].tolist(), (w * weight[part]).tolist()):
                            totals[p] = totals.get(p, 0.0) + x
            if score is not None:
                place = np.flatnonzero(score)
                value = score[place]
            else:
                place = np.fromiter(totals, np.int64, len(totals))
                value = np.fromiter(totals.values(), float, len(totals))
            found = np.r_[best, self.order[place]]
            cosines = np.r_[cosines, value]
            top = np.lexsort((found, -cosines.round(12)))[:k]
            best, cosines = found[top], cosines[top]
        return best, np.minimum(cosines, 1.0)


@dataclass
class Model:
    vocabulary: dict[str, int]
    idf: np.ndarray
    index: BlockMaxIndex
    ids: np.ndarray
    labels: np.ndarray
    slope: float
    offset: float
    silent: float

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tf_idf(terms, counts, self.idf)

    def vote(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float | None, np.ndarray, np.ndarray]:
        """Share of toxic votes (None without a neighbour), neighbours and cosines."""
        near, cosine = self.index.nearest(*self.vector(terms, counts), NEIGHBOURS)
        if not len(near):
            return None, near, cosine
        weight = 1 / (1 - cosine + 0.05)
        return float((weight * self.labels[near]).sum() / weight.sum()), near, cosine


def tf_idf(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    weights = (1 + np.log(counts)) * idf[terms]
    return terms, weights / max(math.sqrt((weights * weights).sum()), 1e-12)


def choose_terms(sample: DataFrame, limit: int = TERMS) -> list[str]:
    """The terms that tell the classes apart best, from the rows that don't calibrate."""
    fits = sample.filter("not calibrates")
    sizes = {r["label"]: r["count"] for r in fits.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, known = (Counter(), Counter()), Cache(terms_of, CACHED)
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                held = Counter(t for chunk in text.split() for t in known[chunk])
                counts[label].update(with_levels(held))
        for label in (0, 1):
            columns = [pa.array(counts[label].keys(), pa.string()), pa.array(counts[label].values(), pa.int64())]
            side = pa.array([label] * len(counts[label]), pa.int32())
            yield pa.RecordBatch.from_arrays([*columns, side], names=["term", "n", "label"])

    counted = fits.repartition(16, "doc_id").mapInArrow(run, "term string, n long, label int")
    table = counted.groupBy("term").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).cast("double").alias("a"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).cast("double").alias("b"),
    )
    n1, n0 = float(sizes[1]), float(sizes[0])
    a, b, n = F.col("a"), F.col("b"), n1 + n0

    def part(seen, row, column):
        return F.when(seen > 0, seen * F.log(seen * n / (row * column))).otherwise(0.0)

    have, lack = a + b, n - a - b
    test = 2 * (
        part(a, have, n1) + part(b, have, n0) + part(n1 - a, lack, n1) + part(n0 - b, lack, n0)
    )
    odds = ((a + 0.5) / (n1 - a + 0.5)) / ((b + 0.5) / (n0 - b + 0.5))
    table = table.filter(lack > 0).withColumn("test", test).withColumn("odds", odds)
    table = table.filter((F.col("test") >= LEAST_TEST) & (F.abs(F.log("odds")) >= math.log(LEAST_ODDS)))
    return [r["term"] for r in table.orderBy(F.desc("test"), "term").limit(limit).collect()]


def term_counts(docs: DataFrame, terms: list[str], keep: list[str]) -> DataFrame:
    """Columns ``keep`` with the chosen ``terms`` of the whole text and their ``counts``."""
    deciding: dict[str, list[tuple[int, int]]] = {}
    for number, term in enumerate(terms):
        part, least = counted_term(term)
        deciding.setdefault(part, []).append((least, number))
    vocabulary = {part: place for place, part in enumerate(deciding)}
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, list(deciding.values())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, levels = sent.value
        known = Cache(lambda c: tuple(vocabulary[t] for t in terms_of(c) if t in vocabulary), CACHED)
        for batch in slices(batches):
            found, counts = [], []
            for text in batch.column("text").to_pylist():
                held = Counter(t for chunk in filter(None, map(known.__getitem__, text.split())) for t in chunk)
                pairs = sorted((number, n) for t, n in held.items() for least, number in levels[t] if n >= least)
                found.append([number for number, _ in pairs])
                counts.append([n for _, n in pairs])
            columns = [batch.column(name) for name in keep]
            columns += [pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "terms", "counts"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, "text").mapInArrow(run, f"{kept}, terms array<int>, counts array<int>")


def fit(sample: DataFrame, stands_for: dict[int, float], terms: list[str], idf: np.ndarray) -> Model | float:
    """A model over the sample's vectors (bounded by the sample, so the driver holds them)."""
    table = term_counts(sample, terms, ["doc_id", "label", "calibrates"]).toArrow()
    label = table.column("label").to_numpy()
    if len(set(label)) < 2:
        return float(label[0]) if len(label) else 0.5
    ids = table.column("doc_id").to_numpy()
    order = np.lexsort((label, ids))
    aside = table.column("calibrates").to_numpy(zero_copy_only=False)
    rows = zip(table.column("terms").to_pylist(), table.column("counts").to_pylist())
    rows = [(np.array(t, np.int64), np.array(c, np.int64)) for t, c in rows]
    fits = [i for i in order if not aside[i]] or list(order)
    tests = [i for i in order if aside[i]] or fits
    index = BlockMaxIndex([tf_idf(*rows[i], idf) for i in fits])
    vocabulary = {t: i for i, t in enumerate(terms)}
    model = Model(vocabulary, idf, index, ids[fits], label[fits], 1.0, 0.0, 0.0)
    votes = [model.vote(*rows[i])[0] for i in tests]
    weight = np.array([stands_for[int(label[i])] for i in tests])
    own = np.array([label[i] for i in tests])
    heard = np.array([v is not None for v in votes])
    quiet = weight[~heard]
    model.silent = float(((own[~heard] * quiet).sum() + 0.5) / (quiet.sum() + 1))
    raw = np.array([v for v in votes if v is not None], float)
    if len(raw):
        weight = weight[heard]
        model.slope, model.offset = fit_sigmoid(raw, own[heard], weight / weight.mean())
    return model


def classify(
    docs: DataFrame,
    labels: DataFrame,
    modulus: int = 3,
    held: int = 1,
    bound: int = SAMPLE,
    threshold: float = THRESHOLD,
    with_key: bool = False,
) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence`` of every row of ``docs``.

    ``with_key`` adds ``text_key``, by which a row finds its text's result: it depends on the
    text only, while ids may be null or repeat.

    Labels are learned from about ``bound`` rows of each class whose crc32 of the id,
    modulo ``modulus``, is not ``held``. ``evidence`` lists the nearest examples with
    their cosine and label. A text without a chosen term (also a null or empty one) has
    no neighbour and gets the rate of such examples. Equal cosines: the smaller id first.
    One class only: its value for all rows; no labels: 0.5. A null id is not held out and
    never learned from; repeated rows keep one row each.
    """
    part = remainder(F.col("doc_id"), modulus)
    sample, stands_for = labelled_sample(docs, labels, "toxic", part != held, bound)
    sample = one_per_family(sample)
    terms = choose_terms(sample)
    read = id_and_text(docs).withColumn("held_out", F.coalesce(part == held, F.lit(False)))
    read = read.withColumn("text_key", text_key(F.col("text")))
    names = ["doc_id", "held_out", *["text_key"] * with_key]
    vectors = materialise(term_counts(read, terms, names), "term-counts")
    seen = np.zeros(len(terms))
    for row in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        seen[row["t"]] = row["count"]
    idf = np.log((1 + vectors.count()) / (1 + seen)) + 1
    model = fit(sample, stands_for, terms, idf)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        proof = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
        for batch in batches:
            scores, evidence = [], []
            for terms, counts in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist()):
                if isinstance(model, float):
                    scores.append(model)
                    evidence.append([])
                    continue
                vote, near, cosine = model.vote(np.array(terms, np.int64), np.array(counts, np.int64))
                scores.append(model.silent if vote is None else float(sigmoid(np.float64(vote), model.slope, model.offset)))
                top = list(zip(near.tolist(), cosine.tolist()))[:EVIDENCE]
                evidence.append(
                    [{"doc_id": int(model.ids[i]), "cosine": c, "label": int(model.labels[i])} for i, c in top]
                )
            scores = np.array(scores, float)
            columns = [*(batch.column(name) for name in names), pa.array(scores)]
            columns += [pa.array((scores >= threshold).astype(np.int32)), pa.array(evidence, proof)]
            yield pa.RecordBatch.from_arrays(
                columns, names=[*names, "score", "predicted", "evidence"]
            )

    schema = f"doc_id long, held_out boolean, {'text_key string, ' * with_key}score double, predicted int"
    return vectors.mapInArrow(
        run, f"{schema}, evidence array<struct<doc_id: bigint, cosine: double, label: int>>"
    )
