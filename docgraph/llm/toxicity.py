"""Toxic passages by maximum-scoring segments.

Tokens get log-odds between toxic and clean labelled documents, by the number
of documents that hold them, with an informative Dirichlet prior from the counts
of the whole corpus.  Tokens count whose signed log-likelihood ratio exceeds what
the largest of so many random tokens would reach; near copies count once.  A linear scan (Ruzzo and Tompa) finds every maximal scoring
segment of a document.  Segment scores of clean text follow an extreme-value
law, E = K m exp(-lambda S) for a document of m tokens; K and lambda come from the
background, segments with E below ``MAX_E`` are toxic passages, and a
document's evidence is the sum of their -ln E, turned into a probability by a
logistic curve fitted on the labelled documents.

Bound (a documented parameter): at most ``MAX_LABELLED`` labelled rows are used for fitting,
taken in hash order; their evidence reaches the driver as counts by step.  The model holds every token that tells
by that test, which only tokens of those rows can.  Corpus counts and scores cover every document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded, discard, lowest_hashes, save

MAX_LABELLED = 200_000
EVIDENCE_STEPS = 1000  # for each unit of the logarithm of the evidence, in the logistic fit
COUNTED_TOKENS = 200_000  # held by a task before it passes its counts on
DRIFT = -0.25
LEAST_ODDS = 1.0
MAX_E = 0.1
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def maximal_segments(scored: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, given the positive positions; every other position scores ``drift``.

    Returns (first, last, score).  Linear: each segment keeps the place of the last one before it with a smaller
    sum, and the search follows those links, so a segment it has passed over is never met again.
    """
    firsts: list[int] = []
    lasts: list[int] = []
    before: list[float] = []  # the sum up to each segment's start
    after: list[float] = []  # and up to its end
    link: list[int] = []
    total, at = 0.0, 0
    for place, score in scored:
        total += drift * (place - at)
        at = place + 1
        first, low = place, total
        total += score
        k = len(firsts) - 1
        while True:
            while k >= 0 and before[k] >= low:
                k = link[k]
            if k < 0 or after[k] >= total:
                break
            first, low = firsts[k], before[k]  # one longer segment takes the place of k and all behind it
            for column in (firsts, lasts, before, after, link):
                del column[k:]
            k -= 1
        firsts.append(first)
        lasts.append(place)
        before.append(low)
        after.append(total)
        link.append(k)
    return [(a, b, high - low) for a, b, low, high in zip(firsts, lasts, before, after)]


@dataclass
class ToxicityModel:
    scores: dict[str, float] = field(default_factory=dict)  # tokens of positive score
    decay: float = 1.0  # lambda
    rate: float = 1e-4  # K
    slope: float = 1.0
    intercept: float = -2.0

    def segments(self, words: list[str]) -> list[tuple[int, int, float, float]]:
        """(first, last, score, E) of the significant segments."""
        scores = self.scores
        hits = [(i, scores[w]) for i, w in enumerate(words) if w in scores]
        out = []
        for first, last, score in maximal_segments(hits, DRIFT):
            e = self.rate * len(words) * math.exp(-self.decay * score)
            if e <= MAX_E:
                out.append((first, last, score, e))
        return out

    def evidence(self, words: list[str]) -> float:
        return sum(self.decay * s - math.log(self.rate * len(words)) for _, _, s, _ in self.segments(words))

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * math.log1p(evidence) + self.intercept))))

    def score(self, text_col: Column) -> Column:
        """Probability of toxicity of each text; null counts as empty."""
        model = self

        @F.pandas_udf("double")
        def probability(texts: pd.Series) -> pd.Series:
            return pd.Series([model.probability(model.evidence(tokens(t))) for t in texts], dtype="float64")

        return probability(F.coalesce(text_col.cast("string"), F.lit("")))


def in_training(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 != 1


def _copy_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least shingle of each text (three words) under three hash functions, which only near copies share, and its number of words."""
    for batch in batches:
        keys, sizes = [], []
        for text in batch.column(0).to_pylist():
            words = tokens(text)
            shingles = {" ".join(words[i : i + 3]).encode() for i in range(max(1, len(words) - 2))}
            keys.append("-".join(str(min(xxhash.xxh64_intdigest(s, seed) for s in shingles)) for seed in (1, 2, 3)))
            sizes.append(len(words))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.string()), pa.array(sizes, pa.int64())], names=["__text", "__toxic", "__key", "__words"])


def _label_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        words = list(counts[0].keys() | counts[1].keys())
        sums = [pa.array([c[w] for w in words], pa.int64()) for c in counts]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *sums], names=["token", "clean", "toxic"])

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[toxic].update(set(tokens(text)))
        if len(counts[0]) + len(counts[1]) > COUNTED_TOKENS:
            yield flush()
    yield flush()


def _known_counts(known: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, total = Counter(), 0
            for text in batch.column(0).to_pylist():
                words = tokens(text)
                total += 1
                counts.update(known.intersection(words))
            rows = [*counts.items(), (None, total)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["token", "n"])

    return run


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit on labelled rows of the training folds only.

    Null labels are ignored; of repeated labels of an id the largest holds; repeated documents of an id count as often as they are there.
    Without both toxic and clean rows the model finds no segments, and its scores
    are the share of toxic rows (0 if there are no labels).
    """
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & in_training(F.col(id_col)))
    usable = save(usable.groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("__toxic")), "usable-labels")
    sample = lowest_hashes(usable, id_col, MAX_LABELLED, usable.count())
    texts = documents.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    train = texts.join(F.broadcast(save(sample, "label-sample")), id_col).select("__text", (F.col("__toxic") > 0).cast("int").alias("__toxic"))
    train = save(train.mapInArrow(_copy_keys, "__text string, __toxic int, __key string, __words long"), "labelled")
    single = save(train.groupBy("__key", "__toxic").agg(F.min("__text").alias("__text")).select("__text", "__toxic"), "labelled-once")
    shares = dict(single.groupBy("__toxic").count().collect())
    clean_docs, toxic_docs = shares.get(0, 0), shares.get(1, 0)
    if not clean_docs or not toxic_docs:
        share = (toxic_docs + 1e-6) / (clean_docs + toxic_docs + 2e-6) if shares else 1e-6
        return ToxicityModel(intercept=math.log(share / (1 - share)))

    counts = single.mapInArrow(_label_counts, "token string, clean long, toxic long").groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    lead = F.col("toxic") / F.lit(toxic_docs) - F.col("clean") / F.lit(clean_docs)
    counts = save(counts.where("toxic >= 2").withColumn("lead", lead).where("lead > 0"), "label-tokens")
    chance = math.sqrt(2 * math.log(counts.count() + 2))
    top = counts.where(_signed_ratio(clean_docs, toxic_docs) > chance).orderBy("token").collect()
    known = frozenset(r.token for r in top)
    everywhere = texts.select("__text").mapInArrow(_known_counts(known), "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    everywhere = {r.token: r.n for r in everywhere}
    corpus = max(1, everywhere.pop(None, 0))
    clean_words = max(1, train.where("__toxic = 0").agg(F.sum("__words")).first()[0] or 1)

    model, positive = ToxicityModel(), []
    for r in top:
        prior = toxic_docs * everywhere.get(r.token, r.toxic + r.clean) / corpus
        a, b = r.toxic + prior, r.clean + prior
        odds = math.log(a / (2 * toxic_docs - a)) - math.log(b / (clean_docs + toxic_docs - b)) if a < 2 * toxic_docs else 10.0
        if odds >= LEAST_ODDS:
            model.scores[r.token] = odds
            positive.append((odds, (r.clean + min(prior, 0.5)) / clean_words))
    model.decay = _decay(positive)

    evidence = save(_segment_table(train, model), "segments")
    null = evidence.where("toxic = 0").agg(F.sum("segments"), F.sum("words")).first()
    model.rate = ((null[0] or 0) + 0.5) / max(1, null[1] or 1)
    steps = _evidence_table(train, model).withColumn("x", F.round(F.log1p("evidence") * EVIDENCE_STEPS) / EVIDENCE_STEPS)
    pairs = steps.groupBy("x", "toxic").count().toPandas().to_numpy(float)  # a row for each step and label, however many documents
    model.slope, model.intercept = _logistic(pairs[:, 0], pairs[:, 1], pairs[:, 2])
    discard(usable, train, single, counts, evidence)
    return model


def _signed_ratio(clean_docs: int, toxic_docs: int) -> Column:
    """Root of the log-likelihood ratio statistic of a token's two shares; near normal by chance."""
    every = F.lit(float(clean_docs + toxic_docs))
    held = F.col("clean") + F.col("toxic")
    total = F.lit(0.0)
    for column, docs in (("clean", clean_docs), ("toxic", toxic_docs)):
        for seen, expected in ((F.col(column), held * docs / every), (F.lit(docs) - F.col(column), (every - held) * docs / every)):
            total = total + F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    return F.sqrt(F.greatest(F.lit(0.0), 2 * total))


def _decay(positive: list[tuple[float, float]]) -> float:
    """The positive root of sum p exp(lambda s) = 1 over the clean distribution of scores."""
    rest = 1 - sum(p for _, p in positive)

    def excess(x: float) -> float:
        return sum(p * math.exp(min(700.0, x * s)) for s, p in positive) + rest * math.exp(x * DRIFT) - 1

    low, high = 1e-6, 20.0
    if not positive or excess(high) < 0:
        return high if positive else 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if excess(middle) > 0 else (middle, high)
    return (low + high) / 2


def _segment_table(train: DataFrame, model: ToxicityModel) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segments, words = [], []
            for text in batch.column(0).to_pylist():
                found = tokens(text)
                words.append(len(found))
                segments.append(len(maximal_segments([(i, model.scores[w]) for i, w in enumerate(found) if w in model.scores], DRIFT)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(segments, pa.int64()), pa.array(words, pa.int64())], names=["toxic", "segments", "words"])

    return train.mapInArrow(run, "toxic int, segments long, words long")


def _evidence_table(train: DataFrame, model: ToxicityModel) -> DataFrame:
    """(evidence, toxic) of every labelled row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [model.evidence(tokens(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.float64()), batch.column(1)], names=["evidence", "toxic"])

    return train.mapInArrow(run, "evidence double, toxic int")


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4) -> tuple[float, float]:
    """Slope (not negative) and intercept by Newton's method with a small ridge; a row counts ``weight`` times."""
    share = weight / weight.sum()
    spread = math.sqrt(max(0.0, float(share @ x**2 - (share @ x) ** 2)))
    scale = max(spread, 1e-9)
    design, w = np.stack([x / scale, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (share * (y - p)) - ridge * w
        hessian = (design * (share * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(w[0] / scale)), float(w[1])


def score_toxicity(documents: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.

    Null and empty texts have no segments and get the model's lowest score; a null id
    counts as the empty text for the fold; repeated rows get a row each.
    """
    return bounded(documents).select(
        F.col(id_col).alias("doc_id"), (~in_training(F.col(id_col))).alias("held_out"), model.score(F.col(text_col)).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxic_passages(documents: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every significant passage: doc_id, start and stop (characters of the text), passage, score, e_value.

    Null, empty and clean texts give no row; repeated rows give their passages each; null ids are carried through;
    an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(pc.fill_null(batch.column(1), "").to_pylist()):
                spans = [(m.start(), m.end(), m[0].lower()) for m in _WORD.finditer(text)]
                for first, last, score, e in model.segments([w for _, _, w in spans]):
                    at.append(i)
                    rows.append((spans[first][0], spans[last][1], text[spans[first][0] : spans[last][1]], score, e))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=["doc_id", "start", "stop", "passage", "score", "e_value"])

    schema = T.StructType([T.StructField("doc_id", documents.schema[id_col].dataType)]).add("start", "long").add("stop", "long").add("passage", "string").add("score", "double").add("e_value", "double")
    return bounded(documents).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def drop_toxic(documents: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``documents`` that the model does not reject, with all their columns.

    Null and empty texts score lowest and stay unless the model's floor is over ``threshold``; repeated rows fare
    alike, whatever their ids, nulls too; an empty table gives no rows; no column but ``text_col`` is read.
    """
    return bounded(documents).where(model.score(F.col(text_col)) < threshold)
