"""Language identification of whole and mixed texts.

A word scores by its letter n-grams, whose frequencies are learned per language. The script of a word leaves only languages that use it.
Viterbi then labels each text's words: staying in a language is free, switching costs SWITCH, so spans follow the evidence of several words.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm.batches import in_small_batches, runs, segment_sums, text_slices

#: Texts per language that are learned from, about: more are thinned out by a hash of doc_id.
LEARNED_TEXTS = 2_000
GRAMS = (1, 2, 3, 4)
BUCKETS = 1 << 17
SMOOTHING = 0.5
#: Cost of a switch of language, in nats.
SWITCH = 6.0
#: Share of a language's letters from which it counts as using a script.
SCRIPT_SHARE = 0.01
#: Words that Viterbi walks in one go; texts of many blocks are joined by the blocks' transfer matrices, so none is too long.
BLOCK = 64
UNDETERMINED = "und"

# Unicode ranges of scripts, first and last code point.
SCRIPTS = (
    ("latin", ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xFF21, 0xFF5A))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF), (0xFB1D, 0xFB4F))),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("devanagari", ((0x900, 0x97F),)),
    ("bengali", ((0x980, 0x9FF),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF),)),
    ("kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F))),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F))),
    ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
)


def _script_table() -> np.ndarray:
    """Script number of every code point: 0 for no letter, 1 for letters of other scripts. Built once per worker."""
    if "_folioloom_scripts" not in sys.__dict__:
        table = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=np.uint8, count=0x110000)
        for number, (_, ranges) in enumerate(SCRIPTS, 2):
            for low, high in ranges:
                table[low:high + 1][table[low:high + 1] > 0] = number
        sys.__dict__["_folioloom_scripts"] = table
    return sys.__dict__["_folioloom_scripts"]


def _code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All words in one array, with a space before, between and after them; and where each word's own space is."""
    joined = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return joined, np.flatnonzero(joined == 32)


def _buckets(points: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where n-grams begin that lie within a word and the spaces around it, and their buckets."""
    count = max(0, len(points) - n + 1)
    hashed = np.full(count, n, dtype=np.uint64)
    for k in range(n):
        hashed = (hashed * np.uint64(0x9E3779B97F4A7C15)) ^ (points[k:k + count] + np.uint64(1))
    hashed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    space = points == 32
    inside = np.ones(count, dtype=bool)
    for k in ((0,) if n == 1 else range(1, n - 1)):
        inside &= ~space[k:k + count]
    if n == 2:
        inside &= ~(space[:count] & space[1:1 + count])
    at = np.flatnonzero(inside)
    return at, (hashed[at] >> np.uint64(32)).astype(np.int64) & (BUCKETS - 1)


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Lower-cased words between ASCII white space, and their number per text."""
    plain = pc.ascii_trim_whitespace(pc.utf8_lower(texts.fill_null("")))
    lists = pc.ascii_split_whitespace(plain)
    words = pc.list_flatten(lists)
    counts = np.asarray(pc.list_value_length(lists), dtype=np.int64) - (np.asarray(pc.binary_length(plain)) == 0)  # an empty text is split into one empty word
    return words.filter(pc.not_equal(words, "")).dictionary_encode(), counts


@dataclass
class LanguageModel:
    """Per language: log-probabilities of n-gram buckets, and which scripts it uses."""

    languages: list[str]
    log_probs: np.ndarray
    uses: np.ndarray

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Score of each word by language, and whether it has a letter. Words without letters score 0 everywhere."""
        points, spaces = _code_points(words)
        total = np.zeros((len(words), len(self.languages)))
        for n in GRAMS:
            at, bucket = _buckets(points, n)
            word = np.minimum(np.searchsorted(spaces, at, side="right") - 1, len(words) - 1)
            total += segment_sums(self.log_probs[bucket].astype(np.float64), np.bincount(word, minlength=len(words)))
        scripts = _script_table()[points]
        letters = np.flatnonzero(scripts)
        first = np.searchsorted(letters, spaces[:-1])
        has_letter = first < len(letters)
        has_letter[has_letter] &= letters[first[has_letter]] < spaces[1:][has_letter]
        script = np.zeros(len(words), dtype=np.int64)
        script[has_letter] = scripts[letters[first[has_letter]]]
        total = (total - total.max(axis=1, keepdims=True)) / len(GRAMS)
        allowed = self.uses[:, script].T
        allowed |= ~allowed.any(axis=1, keepdims=True)  # a script that no language uses rules none out
        total = np.where(allowed, total, total.min(axis=1, keepdims=True) - 4 * SWITCH)
        total[~has_letter] = 0
        return total, has_letter

    def label(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all words of the texts in order: language number and whether it has a letter; and the number of words per text."""
        words, counts = split_words(texts)
        at = np.asarray(words.indices)
        if not len(at):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), counts
        scores, has_letter = self.word_scores(words.dictionary.to_pylist())
        return viterbi(scores[at], counts, SWITCH), has_letter[at], counts


def viterbi(scores: np.ndarray, counts: np.ndarray, switch: float) -> np.ndarray:
    """The best state of every step of sequences that lie one after the other. Ties stay in the state; then the smaller one wins."""
    n_states = scores.shape[1]
    blocks = -(-counts // BLOCK)
    n_rows = int(blocks.sum())
    # A block is a row; the last block of a sequence is filled up with steps that say nothing.
    row_of = np.repeat(np.cumsum(blocks) - blocks, counts) + runs(counts) // BLOCK
    step_of = runs(counts) % BLOCK
    grid = np.zeros((BLOCK, n_rows, n_states))
    grid[step_of, row_of] = scores
    transfer = np.where(np.eye(n_states, dtype=bool), 0.0, -switch)[None] + grid[0][:, None, :]
    for t in range(1, BLOCK):
        transfer = np.maximum(transfer, transfer.max(axis=2, keepdims=True) - switch) + grid[t][:, None, :]
    entry = np.zeros((n_rows, n_states))
    firsts = np.cumsum(blocks) - blocks
    most = int(blocks.max(initial=0))
    for k in range(most - 1):
        row = firsts[blocks > k + 1] + k
        entry[row + 1] = (entry[row][:, :, None] + transfer[row]).max(axis=1)
    came = np.zeros((BLOCK, n_rows, n_states), dtype=np.int16)
    value, own = entry, np.arange(n_states, dtype=np.int16)
    for t in range(BLOCK):
        jump = value.max(axis=1, keepdims=True) - switch
        came[t] = np.where(value >= jump, own, value.argmax(axis=1)[:, None])
        value = np.maximum(value, jump) + grid[t]
    rows = np.arange(n_rows)
    back = np.tile(own, (n_rows, 1))
    for t in reversed(range(BLOCK)):
        back = came[t][rows[:, None], back]
    last = value.argmax(axis=1).astype(np.int16)
    for k in range(most - 1, 0, -1):
        row = firsts[blocks > k] + k
        last[row - 1] = back[row, last[row]]
    states = np.zeros((BLOCK, n_rows), dtype=np.int16)
    for t in reversed(range(BLOCK)):
        states[t] = last
        last = came[t][rows, last]
    return states[step_of, row_of].astype(np.int64)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's text is divisible by 5; never for NULL."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, learned_texts: int = LEARNED_TEXTS) -> LanguageModel:
    """Counts n-grams and scripts by `lang` over the rows of `docs` (doc_id, text, lang), thinned out to about `learned_texts` per language.

    Rows with NULL lang, text or doc_id teach nothing. Each task sums up its counts; what reaches the driver is bounded by languages and buckets.
    """
    rows = in_small_batches(docs).select("doc_id", "text", "lang").where("doc_id is not null and lang is not null and text is not null")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros((0, len(SCRIPTS) + 2), dtype=bool))
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, learned_texts / n)))])
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in text_slices(batches):
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for lang in set(langs.tolist()):
                words, _ = split_words(batch.column("text").filter(pa.array(langs == lang)))
                if not len(words):
                    continue
                total = totals.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS) + 2))
                often = np.bincount(np.asarray(words.indices), minlength=len(words.dictionary)).astype(float)
                points, spaces = _code_points(words.dictionary.to_pylist())
                word = np.minimum(np.searchsorted(spaces, np.arange(len(points)), side="right") - 1, len(often) - 1)
                for n in GRAMS:
                    at, bucket = _buckets(points, n)
                    total[:BUCKETS] += np.bincount(bucket, weights=often[word[at]], minlength=BUCKETS)
                total[BUCKETS:] += np.bincount(_script_table()[points], weights=often[word], minlength=len(SCRIPTS) + 2)
        for lang, total in totals.items():
            filled = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(filled), "bucket": pa.array(filled, pa.int32()), "n": total[filled].astype(np.int64)})

    counted = chosen.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sizes)
    table = np.zeros((len(languages), BUCKETS + len(SCRIPTS) + 2))
    table[[languages.index(x) for x in counted["lang"]], counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    grams, letters = table[:, :BUCKETS], table[:, BUCKETS:].copy()
    letters[:, 0] = 0
    log_probs = np.log((grams + SMOOTHING) / (grams.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS))
    uses = letters >= SCRIPT_SHARE * np.maximum(letters.sum(axis=1, keepdims=True), 1)
    return LanguageModel(languages, np.ascontiguousarray(log_probs.T.astype(np.float32)), uses & (letters > 0))


def predicted(model: LanguageModel) -> F.udf:
    """Function of a text column: struct (lang, score). `lang` is that of most words, ties to the first by name; `score` is its share of words.

    Only words with a letter count. NULL, texts without a letter, and all texts when nothing was learned, are `und` with score 0.
    """
    languages = model.languages

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for batch in text_slices([pa.RecordBatch.from_arrays([texts], names=["text"])], limit=4 << 20):
            if not languages:
                langs += [UNDETERMINED] * len(batch)
                scores += [0.0] * len(batch)
                continue
            label, letter, counts = model.label(batch.column("text"))
            text = np.repeat(np.arange(len(counts)), counts)
            votes = np.bincount(text[letter] * len(languages) + label[letter], minlength=len(counts) * len(languages)).reshape(-1, len(languages))
            total = votes.sum(axis=1)
            langs += [languages[k] if n else UNDETERMINED for k, n in zip(votes.argmax(axis=1), total, strict=True)]
            scores += (votes.max(axis=1) / np.maximum(total, 1)).tolist()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    return predict


def language_spans(model: LanguageModel) -> F.udf:
    """Function of a text column: array of (lang, first_word, n_words), the runs of one language. NULL and empty texts have none."""
    languages = model.languages

    @F.arrow_udf("array<struct<lang:string,first_word:int,n_words:int>>")
    def spans(texts: pa.Array) -> pa.Array:
        out = []
        for batch in text_slices([pa.RecordBatch.from_arrays([texts], names=["text"])], limit=4 << 20):
            label, _, counts = model.label(batch.column("text")) if languages else (np.zeros(0), None, np.zeros(len(batch), dtype=np.int64))
            for part in np.split(label, np.cumsum(counts)[:-1]):
                heads = np.flatnonzero(np.diff(part, prepend=-1))
                out.append([{"lang": languages[part[h]], "first_word": int(h), "n_words": int(n)} for h, n in zip(heads, np.diff(heads, append=len(part)), strict=True)])
        return pa.array(out, pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())])))

    return spans


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predicted(model)("text").alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
