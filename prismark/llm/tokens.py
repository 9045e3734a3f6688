"""Token ids of whole texts, word by word.

Byte-pair tokenizers first cut a text into pieces that never interact. Where
blanks certainly are such cuts, each distinct piece of a batch is encoded once
and its ids are spread to all its occurrences; any text with unusual white
space is encoded whole. Ids equal those of encoding each whole text.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from prismark.llm.words import WordBatch, WordMemory, held_in_worker, ragged_take, whitespace_words

#: White space whose neighbours decide how it is cut: texts with any of it are encoded whole.
UNUSUAL_SPACE = r"^[ \n]|[ \n]$|[ \n][ \n]|[\x00\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


#: New words encoded in one call of the tokenizer.
JOINED_WORDS = 256


def _loaded(path: str, plain: bool = True):
    """The tokenizer; `plain`: its special tokens' strings are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = plain
    return tokenizer


class BatchEncoder:
    """Encodes arrays of texts with one tokenizer file.

    blanks: "dropped" where the tokenizer discards white space (words may be
    encoded one by one), "joined" where a blank belongs to the word after it.
    """

    def __init__(self, path: str, blanks: str, separator: str = "<|endoftext|>"):
        self.path, self.splitting, self.plain = path, _loaded(path, False), None
        self.blanks, self.separator = blanks, separator
        self.separator_id = self.splitting.token_to_id(separator)
        self.memory = WordMemory(self._encode_words, 1_000_000)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        self.plain = self.plain or _loaded(self.path)
        return [e.ids for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids. Many words go in one string: at a special token the tokenizer starts anew."""
        if any("<" in w and self.separator[:2] in w for w in words):
            ids = self._encode(words)
            return np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter(chain.from_iterable(ids), np.int32)
        joined = [self.separator.join(words[i : i + JOINED_WORDS]) + self.separator for i in range(0, len(words), JOINED_WORDS)]
        # A few strings at a time: encodings hold much more than ids.
        parts = [np.array(e.ids, np.int32) for i in range(0, len(joined), 64) for e in self.splitting.encode_batch_fast(joined[i : i + 64], add_special_tokens=False)]
        ids = np.concatenate(parts)
        ends = np.flatnonzero(ids == self.separator_id)
        return np.diff(ends, prepend=-1) - 1, ids[ids != self.separator_id]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): ids[offsets[i]:offsets[i + 1]] are text i's, `end_id` last."""
        if self.blanks == "dropped":
            # The tokenizer lower-cases anyway.
            return self._by_word(whitespace_words(texts, lower_ascii=True), end_id)
        unusual = pc.match_substring_regex(texts, UNUSUAL_SPACE).to_numpy(zero_copy_only=False)
        marked = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0")
        if not unusual.any():
            return self._by_word(WordBatch(pc.split_pattern(marked, "\0")), end_id)
        marked = pc.if_else(pa.array(~unusual), marked, "")
        ids, offsets = self._by_word(WordBatch(pc.split_pattern(marked, "\0")), end_id)
        whole = dict(zip(np.flatnonzero(unusual), self._encode(texts.filter(pa.array(unusual)).to_pylist())))
        parts = [np.array([*whole[i], end_id], ids.dtype) if unusual[i] else ids[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    def _by_word(self, batch: WordBatch, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        starts, lengths, flat = self.memory.lists(batch.words)
        word_lengths = lengths[batch.codes]
        ids = flat[ragged_take(starts[batch.codes], word_lengths)]
        before = np.concatenate(([0], np.cumsum(word_lengths)))[batch.offsets]
        n = len(before) - 1
        out = np.full(len(ids) + n, end_id, np.int32)
        keep = np.ones(len(out), bool)
        keep[before[1:] + np.arange(n)] = False
        out[keep] = ids
        return out, before + np.arange(n + 1)


def batch_encoder(path: str, blanks: str) -> BatchEncoder:
    """One encoder for each Python worker, so that tasks after the first find their words remembered."""
    return held_in_worker(("tokens", path, blanks), lambda: BatchEncoder(path, blanks))
