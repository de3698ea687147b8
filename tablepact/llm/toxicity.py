"""Toxicity by a counterfactually regularised classifier (operator 4).

A logistic model over the words of a text (and what they begin with), each counted once a
text. It is fitted on labelled texts. For each labelled text that names a group of
people, counterfactual texts are made, in which the term is swapped for each other term of
its kind; the squared change of the model's output between a text and its counterfactuals
is a penalty in the fit. So a term can't gain weight from the company it keeps in
the labels, and a neutral mention of a group doesn't raise a score.

The fit uses at most ``per_class`` labelled texts of each class, those with the lowest hash of
their id (a documented bound, which holds for texts and not only for ids; the driver holds only which of at most ``features`` features each of them
has). Scoring runs over every whole text, in Arrow batches, with the bounded model.

Cases. A null, empty or wordless text gets the score of a text without features. Without labels, or without one of the
classes, there is nothing to learn: the score is 0. Null labels are left out; a label without a document is too;
labels and documents that are repeated whole count once in the fit, and an id with several texts or labels counts with each of them. Repeated documents each give a row. A null id is never held out. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .store import Scratch
from .textkit import ALNUM, freed, mix, ragged, runs

PER_CLASS = 8000
FEATURES = 6000
#: Bytes of a word's beginning that are features beside the word.
PREFIXES = (4, 5, 6)

#: Terms for groups of people, by kind. A term is swapped for the others of its kind.
IDENTITY = {
    "gender": "women men woman man girls boys female male frauen männer femmes hommes mujeres hombres",
    "orientation": "gay lesbian straight heterosexual homosexual bisexual queer transgender schwul lesbisch lesbienne gays lesbianas",
    "religion": "muslim christian jewish hindu buddhist atheist muslims christians jews hindus catholic protestant muslime christen juden musulmans chrétiens juifs musulmanes cristianos judíos",
    "origin": "black white asian african european american mexican chinese arab latino hispanic immigrant immigrants refugees foreigners ausländer flüchtlinge étrangers immigrés extranjeros inmigrantes",
    "body": "disabled deaf blind elderly old young teenagers behinderte blinde handicapés aveugles discapacitados ciegos",
}


def _word_hashes(texts: list[str]) -> np.ndarray:
    """The feature of each word: what ``features_of`` makes of a text that is this word."""
    (run,) = runs(pa.array(texts), ALNUM, True)
    return run.hashes()


def _identity() -> tuple[np.ndarray, np.ndarray]:
    """Features of the identity terms, and each term's kind."""
    terms = [(t, k) for k, ts in enumerate(IDENTITY.values()) for t in ts.split()]
    return _word_hashes([t for t, _ in terms]), np.array([k for _, k in terms])


def features_of(run, identity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row) of every word of a run, with repeats. Identity terms have no beginnings, so that a swap changes one feature."""
    sums = run.prefix_sums()
    h = run.hashes(sums)
    all_h, all_row = [h], [run.row]
    long = run.end - run.start
    plain = ~np.isin(h, identity)
    for i, k in enumerate(PREFIXES):
        at = (long >= k) & plain
        all_h.append(mix(run.hashes(sums, k)[at] + np.uint64(k)))
        all_row.append(run.row[at])
    return np.concatenate(all_h), np.concatenate(all_row)


@dataclass
class Model:
    """Sorted features, their weights, and the output without any."""

    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -np.inf

    def mask(self) -> np.ndarray:
        """Which of 2**22 cells hold a feature; most words are ruled out by it."""
        m = np.zeros(1 << 22, bool)
        m[self.features >> np.uint64(42)] = True
        return m


# -- the fit ----------------------------------------------------------------------------------


def _minimise(f, x: np.ndarray, steps: int = 100, keep: int = 8) -> np.ndarray:
    """L-BFGS with backtracking."""
    fx, g = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, alphas = -g, []
        for s, y in reversed(pairs):
            a = (s @ d) / (s @ y)
            alphas.append(a)
            d = d - a * y
        if pairs:
            s, y = pairs[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(pairs, reversed(alphas)):
            d = d + s * (a - (y @ d) / (s @ y))
        t, slope = (1.0 if pairs else 1.0 / max(1.0, np.abs(g).sum())), g @ d
        while True:
            nx = x + t * d
            nf, ng = f(nx)
            if nf <= fx + 1e-4 * t * slope or t < 1e-10:
                break
            t /= 2
        s, y = nx - x, ng - g
        done = abs(fx - nf) <= 1e-9 * max(1.0, abs(fx))
        x, fx, g = nx, nf, ng
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-keep:]
        if done:
            break
    return x


def fit_rows(rows: list[np.ndarray], y: np.ndarray, features: np.ndarray, prior: float, l2: float = 0.3, swap: float = 5.0) -> Model:
    """The model from each row's places in ``features``; ``prior`` is the share of label 1 where it will be used."""
    n, k = len(rows), len(features)
    indptr = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    idx = np.concatenate(rows).astype(np.int64) if n else np.zeros(0, np.int64)
    row = np.repeat(np.arange(n), np.diff(indptr))

    # Counterfactuals: in row i, term a is swapped for each other term b of its kind that the row doesn't have.
    terms, kinds = _identity()
    place = {int(h): j for j, h in enumerate(features)}
    where = np.array([place.get(int(h), -1) for h in terms])
    swaps: dict[tuple[int, int], float] = {}
    named = np.isin(idx, where[where >= 0])
    for i in np.unique(row[named]):
        has = set(idx[indptr[i] : indptr[i + 1]].tolist())
        for a in np.flatnonzero(np.isin(where, list(has)) & (where >= 0)):
            others = [int(where[b]) for b in np.flatnonzero(kinds == kinds[a]) if where[b] >= 0 and int(where[b]) not in has]
            for b in others:
                swaps[int(where[a]), b] = swaps.get((int(where[a]), b), 0.0) + 1.0 / len(others)
    sa = np.array([a for a, _ in swaps], np.int64)
    sb = np.array([b for _, b in swaps], np.int64)
    sn = np.array(list(swaps.values()))

    def f(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = x[:k], x[k]
        z = np.bincount(row, weights=w[idx], minlength=n) + b
        p = 1 / (1 + np.exp(-z))
        loss = np.sum(np.logaddexp(0, z) - y * z) + 0.5 * l2 * (w @ w)
        r = p - y
        g = np.bincount(idx, weights=r[row], minlength=k) + l2 * w
        if len(sn):
            d = w[sa] - w[sb]
            loss += swap * np.sum(sn * d * d)
            g += np.bincount(sa, weights=2 * swap * sn * d, minlength=k) - np.bincount(sb, weights=2 * swap * sn * d, minlength=k)
        return loss, np.append(g, r.sum())

    x = _minimise(f, np.zeros(k + 1))
    logit = lambda q: np.log(q / (1 - q))
    shift = logit(min(max(prior, 1e-6), 1 - 1e-6)) - logit(y.mean())
    return Model(features, x[:k], float(x[k] + shift))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_features: int = FEATURES, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fits on at most ``per_class`` labelled documents of each class."""
    terms, _ = _identity()
    marked = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).filter("y IN (0, 1) AND doc_id IS NOT NULL").distinct()
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Model()
    chosen = None
    for y in (0, 1):
        some = marked.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch.column(3), ALNUM, True):
                h, row = features_of(run, terms)
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                h, row = h[first], row[first]
                counts = np.bincount(row, minlength=run.hi - run.lo)
                keys = [batch.column(i).slice(run.lo, run.hi - run.lo) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*keys, ragged(h.view(np.int64), counts, pa.int64())], ["y", "place", "text_hash", "h"])

    # At most 2 * per_class rows, so they are broadcast. The ids chosen may have more texts than that; the bound is kept by a second choice.
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.select("y", F.xxhash64("doc_id", F.lit(17)).alias("place"), F.xxhash64("text").alias("text_hash"), "text")
    scratch = Scratch(docs.sparkSession, "toxicity")
    each = scratch.table(texts.mapInArrow(freed(found), "y int, place long, text_hash long, h array<long>"), "each")
    keys = each.select("y", "place", "text_hash").distinct()
    first = [keys.filter(F.col("y") == y).orderBy("place", "text_hash").limit(per_class) for y in (0, 1)]
    bounded = scratch.table(first[0].unionByName(first[1]), "bounded")
    table = scratch.table(each.join(F.broadcast(bounded), ["y", "place", "text_hash"]), "labelled")
    if table.count() > bounded.count():  # rows that are repeated whole
        table = scratch.table(table.dropDuplicates(["y", "place", "text_hash"]), "labelled")
    table = table.select("y", "h")
    size = {r["y"]: r["n"] for r in table.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return Model()
    a, b = F.col("n1") / size[1], F.col("n0") / size[0]
    gap = F.abs(a - b) / F.sqrt((a + b) / 2 * (1 - (a + b) / 2) + 1e-4)
    ranked = table.select("y", F.explode("h").alias("h")).groupBy("h").agg(F.count_if(F.col("y") == 1).alias("n1"), F.count_if(F.col("y") == 0).alias("n0")).filter("n0 + n1 >= 3").orderBy(gap.desc(), "h").limit(max_features)
    features = np.array([r["h"] for r in ranked.select("h").collect()], np.int64).view(np.uint64)
    features = np.unique(np.concatenate([features, terms]))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h in batch.column(1):
                h = np.array(h.values.to_numpy(), np.int64).view(np.uint64)
                at = np.minimum(np.searchsorted(features, h), len(features) - 1)
                out.append(at[features[at] == h].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["y", "at"])

    rows = table.mapInArrow(places, "y int, at array<int>").collect()  # 2 * per_class at most
    rows.sort(key=lambda r: (r["y"], r["at"]))  # the fit doesn't depend on the order in which tasks end
    return fit_rows([np.array(r["at"], np.int64) for r in rows], np.array([r["y"] for r in rows], float), features, counts[1] / (counts[0] + counts[1]))


# -- scoring ----------------------------------------------------------------------------------


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (0 or 1) for every whole text; columns of these names are replaced."""
    docs = docs.drop("score", "predicted")
    names, terms = docs.columns, _identity()[0]
    # A text goes to the workers once; only one of another type goes as a string beside it.
    sent = docs if isinstance(docs.select(F.col(text)).schema[0].dataType, T.StringType) and names.count(text) == 1 else docs.withColumn("__text", F.col(text).cast("string"))
    place, width = sent.columns.index(text if sent is docs else "__text"), len(names)
    shared = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.bias))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weights, bias = shared.value
        mask = Model(features).mask()
        for batch in batches:
            z = np.full(batch.num_rows, bias)
            for run in runs(batch.column(place), ALNUM, True) if len(features) else ():
                h, row = features_of(run, terms)
                hit = mask[h >> np.uint64(42)]
                h, row = h[hit], row[hit]
                at = np.minimum(np.searchsorted(features, h), len(features) - 1)
                ok = features[at] == h
                pairs = np.unique(row[ok].astype(np.int64) * len(features) + at[ok])
                z[run.lo : run.hi] += np.bincount(pairs // len(features), weights=weights[pairs % len(features)], minlength=run.hi - run.lo)
            p = 1 / (1 + np.exp(-z))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return sent.mapInArrow(freed(scores), schema)


def held_out(doc_id, folds: int = 5):
    """Documents that no fit sees the labels of: crc32 of the id as text leaves no remainder."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))
