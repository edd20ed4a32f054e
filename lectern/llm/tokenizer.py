"""A public tokenizer in tasks: texts are cut where its pattern cuts anyway, and every distinct word is encoded once.

The tokenizer never joins what white space separates (its normaliser turns white space into one space, its pattern
drops it), and never a letter or digit with a mark that follows it, so the ids of a text are those of its words one
after the other.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa

from lectern.llm.wordtable import Ragged, WordTable

ODD = re.compile(r"\s|<\|")  # words that cannot stand in one line with others
# Letters that are lower case and composed already: such a word is one piece, and its normal form is itself.
PLAIN = re.compile(r"[a-zà-öø-ÿ]+")


@lru_cache(maxsize=2)
def loaded(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def special(path: str) -> tuple[str, int] | None:
    """An added token of the tokenizer, which may stand between words to tell their ids apart."""
    for token_id, token in sorted(loaded(path).get_added_tokens_decoder().items()):
        if token.special and not (token.lstrip or token.rstrip or token.single_word or token.normalized):
            return token.content, token_id
    return None


@lru_cache(maxsize=2)
def piece_ends(path: str) -> np.ndarray | None:
    """Which ids end a piece, for a tokenizer whose tokens show it; None for others."""
    suffix = getattr(loaded(path).model, "end_of_word_suffix", None)
    if not suffix:
        return None
    known = loaded(path).get_vocab(with_added_tokens=False)
    ends = np.zeros(max(known.values()) + 1, bool)
    ends[[i for token, i in known.items() if token.endswith(suffix)]] = True
    return ends


@contextmanager
def bare(encoder) -> Iterator[None]:
    """The tokenizer without its normaliser and pattern, for words that they leave as they are."""
    from tokenizers import pre_tokenizers

    normalizer, pre_tokenizer = encoder.normalizer, encoder.pre_tokenizer
    byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    encoder.normalizer = None
    encoder.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), byte_level])
    try:
        yield
    finally:
        encoder.normalizer, encoder.pre_tokenizer = normalizer, pre_tokenizer


class WordIds(WordTable):
    """Ids of texts from the ids of their words."""

    def __init__(self, path: str):
        self.encoder, self.mark, self.last = loaded(path), special(path), piece_ends(path)
        super().__init__(1 << 20)

    def forget(self) -> None:
        self.ids = Ragged(np.int32)

    def fresh(self, words: list[str]) -> None:
        plain = np.fromiter((PLAIN.fullmatch(word) is not None for word in words), bool, len(words))
        if self.last is None:
            plain[:] = False
        sizes = np.zeros(len(words), np.int64)
        ids, sizes[plain] = self.of_plain([word for word, alike in zip(words, plain.tolist()) if alike])
        others, sizes[~plain] = self.of_others([word for word, alike in zip(words, plain.tolist()) if not alike])
        out = np.empty(len(ids) + len(others), np.int32)
        of_plain = np.repeat(plain, sizes)
        out[of_plain], out[~of_plain] = ids, others
        self.ids.add(out, sizes)

    def of_plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words that are one piece each, and how many each has: a piece ends with the only token that may end one."""
        if not words:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        with bare(self.encoder):
            ids = np.array(self.encoder.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int32)
        return ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1)

    def of_others(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        found: dict[str, np.ndarray] = {}
        if self.mark is not None:
            plain = [word for word in words if PLAIN.fullmatch(word)]
            if plain:
                with bare(self.encoder):
                    found |= self.of_line(plain)
        rest = [word for word in words if word not in found]
        alone = [word for word in rest if self.mark is None or ODD.search(word)]
        encoded = self.encoder.encode_batch_fast(alone, add_special_tokens=False)
        found |= {word: np.array(e.ids, np.int32) for word, e in zip(alone, encoded)}
        line = [word for word in rest if word not in found]
        if line:
            found |= self.of_line(line)
        lists = [found[word] for word in words]
        return np.concatenate(lists), np.array([len(ids) for ids in lists])

    def of_line(self, words: list[str]) -> dict[str, np.ndarray]:
        """Ids of words that are encoded in one line, with a mark between them."""
        content, token_id = self.mark
        line = f" {content} ".join(words)
        ids = np.array(self.encoder.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.int32)
        cuts = np.flatnonzero(ids == token_id)
        return dict(zip(words, map(ids.__getitem__, map(slice, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]))))

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, each followed by `end` if given, and the number of ids before each text."""
        places, counts = self.places(texts)
        ids, before = self.ids.gathered(places)
        counts = before[counts]
        if end is not None:
            ids = np.insert(ids, counts[1:], end)
            counts = counts + np.arange(len(counts))
        return ids, counts
