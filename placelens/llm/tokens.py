"""Whole-text tokenization with a public tokenizer, batched through a memo of space-led chunks."""

from __future__ import annotations

import gc
import os
import re

import numpy as np

END_ID = 0
#: A chunk starts at a single space between two characters that are no white space.
#: Byte-level pre-tokenizers never let a piece cross such a place.
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Places inside a chunk that no piece crosses either: before a mark after a letter, and around a single line end.
_FINE = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ɏ])(?=[!-/:-@\[-`{-~])|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
_ODD = re.compile(r" (?:\s|(?<=\s ))")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Memo(dict):
    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        k = self[chunk] = len(self) + 1  # 0 is the end of a document
        self.new.append(chunk)
        return k


class Encoder:
    """encode(texts) -> (ids of all texts with an end id after each, tokens per text).

    Ids are the library's with add_special_tokens=False: the string of a special
    token in a text becomes that token. Beyond max_chunks chunks or max_chars
    characters the memo keeps those that came up again, the most frequent first,
    up to half as many.
    """

    def __init__(self, path: str, max_chunks: int = 700_000, max_chars: int = 16_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(0)  # the memo stands in for it
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a byte-level token has a character for each byte
        for token, k in vocabulary.items():
            self.n_bytes[k] = len(token)
        self.max_chunks, self.max_chars = max_chunks, max_chars
        self._clear()

    def _clear(self) -> None:
        self.memo, self.chars = _Memo(), 0
        self.flat, self.used = np.empty(1 << 16, np.uint32), 1
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.flat[0], self.sizes[0] = END_ID, 1
        self.hits = np.zeros(1, np.int64)

    def _shrink(self) -> None:
        old, names, hits = (self.flat, self.starts, self.sizes), list(self.memo), self.hits
        again = np.flatnonzero(hits[1:] > 1) + 1
        if len(again) > self.max_chunks // 2:
            again = np.sort(again[np.argsort(-hits[again], kind="stable")[: self.max_chunks // 2]])
        self._clear()
        if sum(len(names[k - 1]) for k in again.tolist()) > self.max_chars // 2:
            return
        for k in again.tolist():
            self.memo[names[k - 1]] = len(self.memo) + 1
        sizes = old[2][again]
        ends = np.cumsum(sizes)
        ids = old[0][np.repeat(old[1][again] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        self.flat, self.used = np.concatenate([np.array([END_ID], np.uint32), ids]), len(ids) + 1
        self.starts, self.sizes = np.concatenate([[0], 1 + ends - sizes]), np.concatenate([[1], sizes])
        self.hits = np.concatenate([[0], np.minimum(hits[again] // 2, 1 << 30)])
        self.chars = sum(map(len, self.memo))

    def _ids(self, some: list[str], led: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks and their numbers. Chunks led by a space are encoded joined, as they lie in texts, and cut by their bytes."""
        if led:
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.cumsum(np.fromiter((len(c) if c.isascii() else len(c.encode()) for c in some), np.int64, len(some)))
            at = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends) + 1
            return ids, np.diff(at, prepend=0)
        each = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter((i for x in each for i in x), np.int64, int(sizes.sum())), sizes

    def _room(self, n_ids: int) -> None:
        while self.used + n_ids > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while len(self.memo) >= len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))

    def _store(self, at: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self._room(len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        self.sizes[at] = sizes
        self.starts[at] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)

    def _gathered(self, at: np.ndarray) -> np.ndarray:
        sizes = self.sizes[at]
        return self.flat[np.repeat(self.starts[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]

    def _learn(self) -> None:
        """Ids of new chunks. One that holds a fine cut is put together from its parts, which recur more often than it does."""
        new, self.memo.new, look = self.memo.new, [], self.memo.__getitem__
        first, whole, joined, parts, n_parts = len(self.memo) - len(new) + 1, [], [], [], []
        for k, c in enumerate(new, first):
            own = [c] if c[1:].isalpha() or self.special and self.special.search(c) else _FINE.split(c)
            if len(own) > 1:
                joined.append(k)
                parts += map(look, own)
                n_parts.append(len(own))
            else:
                whole.append((k, c))
        first = len(self.memo) - len(self.memo.new) + 1
        whole += enumerate(self.memo.new, first)  # parts that were not known
        self.chars += sum(map(len, new)) + sum(map(len, self.memo.new))
        self.memo.new = []
        led = [c[:1] == " " and bool(c[1:2].strip()) and bool(c[-1:].strip()) for _, c in whole]
        for kind in (True, False):
            own = [x for x, y in zip(whole, led, strict=True) if y == kind]
            for k in range(0, len(own), 1024):
                at, some = zip(*own[k : k + 1024], strict=True)
                self._store(np.array(at), *self._ids(list(some), kind))
        if joined:
            at, n = np.array(parts), np.array(n_parts)
            self._store(np.array(joined), self._gathered(at), np.add.reduceat(self.sizes[at], np.cumsum(n) - n))
            self._count(at)

    def _count(self, at: np.ndarray) -> None:
        seen = np.bincount(at, minlength=len(self.memo) + 1)
        seen[: len(self.hits)] += self.hits
        self.hits = seen

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.memo) > self.max_chunks or self.chars > self.max_chars:
            self._shrink()
        look, places, n_chunks = self.memo.__getitem__, [], []
        for text in texts:
            chunks = _CUT.split(text) if "\0" in text or _ODD.search(text) else text.replace(" ", "\0 ").split("\0")
            places.append(np.fromiter(map(look, chunks), np.int64, len(chunks)))
            places.append(np.zeros(1, np.int64))
            n_chunks.append(len(chunks) + 1)
        self._learn()
        if not places:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        at = np.concatenate(places)
        self._count(at)
        ids = self._gathered(at)
        per_text = np.add.reduceat(self.sizes[at], np.concatenate([[0], np.cumsum(n_chunks)[:-1]]))
        return ids, per_text


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Free this worker's encoders, for tasks that need memory and no tokenizer."""
    _ENCODERS.clear()
    gc.collect()


def groups_of_chars(texts: list[str], most: int = 1_000_000):
    """Ranges of texts of about most characters, one text at least."""
    lo = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield lo, k
            lo, size = k, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)
