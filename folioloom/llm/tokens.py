"""Token ids of whole texts, by a public tokenizer file.

A word occurs many times in a corpus. Texts are therefore split where the tokenizer splits them in any case, each distinct
word is encoded once per worker, and ids are gathered by word. That gives the ids of the whole text: the tokenizer drops white
space, never merges across it, and never merges a letter with ASCII punctuation.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from folioloom.llm.batches import runs

#: Words a worker remembers; beyond that it starts anew. Affects speed only.
REMEMBERED_WORDS = 300_000
#: A letter before punctuation; not the one letter whose lower case ends in a mark that joins the punctuation.
_BOUNDARY = r"([^\PL\x{130}])([.,;:!?|*#$%&])"
_PLAIN = r"^(\pL+|[.,;:!?|*#$%&]+)$"


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Encodes Arrow texts with a tokenizer that lower-cases, drops white space and marks word ends with `</w>`."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.lengths = np.zeros(1 << 16, dtype=np.int64)
        self.starts = np.zeros(1 << 16, dtype=np.int64)
        self.ids = np.zeros(1 << 18, dtype=np.uint32)
        self.used = 0

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of ids of each text. NULL counts as empty."""
        texts = texts.fill_null("")
        if pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens are found before the text is lower-cased
            found = [e.ids for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], dtype=np.uint32), np.array([len(ids) for ids in found], dtype=np.int64)
        split = pc.replace_substring_regex(pc.ascii_lower(texts), _BOUNDARY, r"\1 \2")
        lists = pc.ascii_split_whitespace(split)
        words = pc.list_flatten(lists).dictionary_encode()
        known = self._numbers(words.dictionary)
        at = known[np.asarray(words.indices)]
        lengths, starts = self.lengths[at], self.starts[at]
        total = np.concatenate([[0], np.cumsum(lengths)])
        bounds = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))])
        return self.ids[np.repeat(starts, lengths) + runs(lengths)], np.diff(total[bounds])

    def _numbers(self, words: pa.Array) -> np.ndarray:
        listed = words.to_pylist()
        if len(self.number) + len(listed) > REMEMBERED_WORDS:
            self.forget()
        new = [i for i, word in enumerate(listed) if word not in self.number]
        if new:
            plain = np.asarray(pc.match_substring_regex(words.take(pa.array(new)), _PLAIN).to_numpy(zero_copy_only=False), dtype=bool)
            joined = [listed[i] for i, p in zip(new, plain, strict=True) if p]
            for k in range(0, len(joined), 500):
                self._learn_joined(joined[k:k + 500])
            self._learn([listed[i] for i, p in zip(new, plain, strict=True) if not p])
        return np.fromiter((self.number[word] for word in listed), dtype=np.int64, count=len(listed))

    def _learn_joined(self, words: list[str]) -> None:
        """Words that are one unit for the tokenizer; the word ends in the ids tell where each stops."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, dtype=np.uint32)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) == len(words) and stops[-1] == len(ids):
            self._add(words, ids, np.diff(stops, prepend=0))
        else:
            self._learn(words)

    def _learn(self, words: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        self._add(words, np.array([i for ids in found for i in ids], dtype=np.uint32), np.array([len(ids) for ids in found], dtype=np.int64))

    def _add(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        first = len(self.number)
        while first + len(words) > len(self.lengths):
            self.lengths, self.starts = np.tile(self.lengths, 2), np.tile(self.starts, 2)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.used], np.zeros(max(len(self.ids), len(ids)), dtype=np.uint32)])
        self.ids[self.used:self.used + len(ids)] = ids
        self.lengths[first:first + len(words)] = lengths
        self.starts[first:first + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.number.update(zip(words, range(first, first + len(words)), strict=True))


def worker_encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file. Functions reach workers by value, so it hangs on a module that does not."""
    kept = sys.__dict__.setdefault("_folioloom_encoders", {})
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def with_end_id(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """`end_id` after the ids of each text."""
    return np.insert(ids, np.cumsum(lengths), np.uint32(end_id)), lengths + 1


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
