"""Text quality by a generalised additive model with pairwise interactions.

Each feature of a text has a lookup table over its bins, and a few pairs of features have one over both. Tables grow in cycles: feature
after feature, a shallow tree is fitted to what the model still gets wrong, and a small part of it is added. A score is a sum of looked-up
values, so every score can be explained by its parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm.batches import in_small_batches, segment_sums, text_slices
from folioloom.llm.language import held_out

#: Labelled texts that the model is fitted on, about: more are thinned out by a hash of doc_id.
FITTED_TEXTS = 12_000
THRESHOLD = 0.3

FEATURES = ("length", "upper", "digits", "symbols", "punctuation", "line_words", "word_length", "distinct_words", "top_word", "distinct_lines",
            "sentence_words", "short_words", "long_words", "not_ascii")
_UPPER, _DIGIT, _SYMBOL, _POINT, _LINE, _END, _HIGH, _LATER, _SPACE, _LOWER = range(10)


def _classes() -> np.ndarray:
    table = np.full(256, _SYMBOL, dtype=np.uint8)
    table[:33] = _SPACE
    table[10] = _LINE
    table[ord("A"):ord("Z") + 1] = _UPPER
    table[ord("a"):ord("z") + 1] = _LOWER
    table[ord("0"):ord("9") + 1] = _DIGIT
    table[[ord(c) for c in ",;:'\"()-"]] = _POINT
    table[[ord(c) for c in ".!?"]] = _END
    table[0x80:0xC0] = _LATER
    table[0xC0:] = _HIGH
    return table


def _distinct(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per list: entries, distinct entries, and how often the most frequent one occurs."""
    counts = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    entries = pc.list_flatten(lists).dictionary_encode()
    owner = np.repeat(np.arange(len(counts)), counts)
    pairs, often = np.unique(owner * max(1, len(entries.dictionary)) + np.asarray(entries.indices, dtype=np.int64), return_counts=True)
    pairs //= max(1, len(entries.dictionary))
    top = np.zeros(len(counts), dtype=np.int64)
    np.maximum.at(top, pairs, often)
    return counts, np.bincount(pairs, minlength=len(counts)), top


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; NULL and empty texts give zeros."""
    texts = texts.fill_null("").cast(pa.string())
    sizes = np.asarray(pc.binary_length(texts), dtype=np.int64)
    data = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), dtype=np.uint8)
    kind = _classes()[data]
    n = [segment_sums((kind == k).astype(np.uint8), sizes).astype(float) for k in range(10)]
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    words, distinct, top = _distinct(lists)
    words = np.where(sizes > n[_SPACE] + n[_LINE], words, 0)
    lengths = np.asarray(pc.utf8_length(pc.list_flatten(lists)), dtype=np.int64)
    counts = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    short, long_ = (segment_sums(x.astype(np.uint8), counts) for x in (lengths <= 3, lengths >= 13))
    lines, distinct_lines, _ = _distinct(pc.split_pattern(texts, "\n"))
    letters = n[_UPPER] + n[_LOWER] + n[_HIGH]
    marks = sizes - n[_LATER] - n[_SPACE] - n[_LINE]

    def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a / np.maximum(b, 1)

    found = np.stack([np.log1p(sizes - n[_LATER]), share(n[_UPPER], letters), share(n[_DIGIT], marks), share(n[_SYMBOL], marks), share(n[_POINT] + n[_END], marks),
                      share(words, lines), share(marks, words), share(distinct, words), share(top, words), share(distinct_lines, lines),
                      share(words, n[_END]), share(short, words), share(long_, words), share(n[_HIGH], letters)], axis=1)
    found[words == 0] = 0
    return found


@dataclass
class AdditiveModel:
    """Bin edges and tables. `pairs` are features whose coarse bins have a joint table."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        total = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, f], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="higher"))


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain of the best cut of ordered bins, and the number of bins left of it; 0 bins if none helps."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(gl, hl, ridge) + _gain(g.sum() - gl, h.sum() - hl, ridge) - _gain(g.sum(), h.sum(), ridge)
    k = int(np.argmax(gains))
    return (float(gains[k]), k + 1) if gains[k] > 1e-9 else (0.0, 0)


def _line_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Leaf values by bin of a tree with up to three leaves."""
    parts = [(0, len(g))]
    for _ in range(2):
        cuts = [(*_best_cut(g[a:b], h[a:b], ridge), a, b) for a, b in parts]
        gain, k, a, b = max(cuts)
        if not k:
            break
        parts.remove((a, b))
        parts += [(a, a + k), (a + k, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Leaf values by cell: a cut of the first axis, then one of the second on either side."""
    best, leaf = -1.0, None
    for k in range(1, g.shape[0]):
        gain, out = 0.0, np.zeros_like(g)
        for rows in (slice(0, k), slice(k, None)):
            gs, hs = g[rows].sum(axis=0), h[rows].sum(axis=0)
            more, cut = _best_cut(gs, hs, ridge)
            gain += more + _gain(gs.sum(), hs.sum(), ridge)
            for columns in (slice(0, cut), slice(cut, None)) if cut else (slice(None),):
                out[rows, columns] = -gs[columns].sum() / (hs[columns].sum() + ridge)
        if gain > best:
            best, leaf = gain, out
    return np.zeros_like(g) if leaf is None else leaf


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse_bins: int = 8, cycles: int = 200, pair_count: int = 6, pair_cycles: int = 60, rate: float = 0.1,
        ridge: float = 5.0) -> AdditiveModel:
    """Cyclic boosting on rows of features with labels 0 or 1. Without rows every score is one half."""
    model = AdditiveModel(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    if not len(y):
        return model
    model.edges = [_edges(x[:, f], bins) for f in range(x.shape[1])]
    model.coarse = [_edges(x[:, f], coarse_bins) for f in range(x.shape[1])]
    at = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(cycles):
        for f, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _line_tree(np.bincount(at[f], g, len(table)), np.bincount(at[f], h, len(table)), ridge)
            table += step
            total += step[at[f]]
    wide = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.coarse)]
    shape = [len(e) + 1 for e in model.coarse]

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        cell = wide[a] * shape[b] + wide[b]
        return tuple(np.bincount(cell, v, shape[a] * shape[b]).reshape(shape[a], shape[b]) for v in slopes())

    def strength(pair: tuple[int, int]) -> float:
        g, h = grid(*pair)
        return float(_gain(g, h, ridge).sum())

    model.pairs = sorted(combinations(range(x.shape[1]), 2), key=strength, reverse=True)[:pair_count]
    model.pair_tables = [np.zeros((shape[a], shape[b])) for a, b in model.pairs]
    for _ in range(pair_cycles):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            step = rate * _grid_tree(*grid(a, b), ridge)
            table += step
            total += step[wide[a], wide[b]]
    return model


def learn(docs: DataFrame, labels: DataFrame, fitted_texts: int = FITTED_TEXTS) -> AdditiveModel:
    """A model of `labels` (doc_id, quality) over the texts of `docs` (doc_id, text).

    NULL ids and labels other than 0 and 1 teach nothing, nor do documents with both. Repeated rows of a document count once. About `fitted_texts`
    labelled documents are used, chosen by a hash of doc_id; their features, not their texts, reach the driver.
    """
    clear = (labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("_label"), F.max("quality").alias("_most"))
             .where("_label = _most").select("doc_id", "_label"))
    share = min(1.0, fitted_texts / max(1, clear.count()))
    chosen = clear.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    rows = in_small_batches(docs).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by fitted_texts

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=4 << 20):
            found = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_label").cast(pa.int32()), pa.array(list(found), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    measured = rows.select(F.col("doc_id").cast("long"), "text", F.col("_label").cast("int")).mapInArrow(measure, "doc_id long, label int, x array<double>")
    found = measured.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("x").alias("x")).toPandas().sort_values("doc_id")
    if not len(found):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit(np.stack(found["x"].to_list()), found["label"].to_numpy(dtype=float))


def scored(model: AdditiveModel) -> F.udf:
    """Function of a text column: probability that the text has label 1. NULL counts as empty, and empty texts have a score too."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [model.score(features(b.column("text"))) for b in text_slices([pa.RecordBatch.from_arrays([texts], names=["text"])], limit=4 << 20)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return score


def accepted(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose text scores at least `threshold`, unchanged, whatever other columns they have. Nothing is shuffled."""
    return in_small_batches(docs).where(scored(model)("text") >= threshold)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels that are not held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{table}.parquet") for table in ("documents", "labels"))
    model = learn(docs, labels.where(~held_out(F.col("doc_id"))))
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored(model)("text").alias("score"))
    return found.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
