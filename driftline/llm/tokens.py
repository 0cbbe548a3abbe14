"""Token ids of whole Arrow batches with a public byte-level BPE vocabulary.

The vocabulary's split pattern never joins a word with what follows it, and
with at most one blank before it. A text is therefore cut into words (with that
blank) and the white space between them; each distinct word of a batch is
encoded once, and texts are put together from the parts. Encoded words are kept
for the following batches. Texts with rarer white space than blank and
``\\x09``-``\\x0D``, and texts that spell an added token of the vocabulary (it
becomes its one id), are encoded as a whole.
"""

from __future__ import annotations

import base64
import json
import os
import re

import numpy as np
import tiktoken

from driftline.llm.words import find_words, mix

#: Words kept per worker process, about 40 bytes each.
KEPT_WORDS = 1_000_000
_RARE_SPACE = re.compile(
    rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public vocabularies are."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Tokenizer:
    """Encodes batches; ``path`` is the vocabulary's json file, its ranks lie beside it."""

    def __init__(self, path: str):
        import public_tokenizers

        ranks = {}
        with open(f"{os.path.splitext(path)[0]}.tiktoken", "rb") as lines:
            for line in lines:
                piece, rank = line.split()
                ranks[base64.b64decode(piece)] = int(rank)
        with open(path, encoding="utf-8") as file:
            added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        self._bpe = tiktoken.Encoding(
            "public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added
        )
        whole = [_RARE_SPACE.pattern, *(re.escape(t.encode()) for t in added)]
        self._whole = re.compile(b"|".join(whole))
        self._bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        self._bytes[list(ranks.values())] = list(map(len, ranks))
        self._forget()

    def _forget(self) -> None:
        self._keys = np.empty(0, np.uint64)
        self._place = np.empty(0, np.int64)
        self._starts = np.zeros(1, np.int64)
        self._ids = np.empty(0, np.int32)
        self._spaces: dict[bytes, int] = {}

    def encode(self, text: str) -> list[int]:
        return self._bpe.encode(text, allowed_special="all")

    def _remember(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Encodes and stores the words ``buffer[start:end]``; their numbers.

        They are encoded as one text, in which each begins with its blank or
        follows a line break, and told apart by the bytes of the ids.
        """
        first = len(self._starts) - 1
        bare = buffer[starts] != 0x20
        sizes = ends - starts + bare
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        places = np.repeat(starts - bare - bounds[:-1], sizes) + np.arange(bounds[-1])
        joined = buffer[np.maximum(places, 0)]
        joined[bounds[:-1][bare]] = 0x0A
        ids = np.array(self._bpe.encode_ordinary(joined.tobytes().decode()), np.int32)
        ends_of_ids = np.cumsum(self._bytes[ids])
        own = np.searchsorted(bounds[1:], ends_of_ids)
        # The line breaks are single ids: drop them.
        breaks = np.zeros(len(ids), bool)
        breaks[np.searchsorted(ends_of_ids, bounds[:-1][bare] + 1)] = True
        counts = np.bincount(own[~breaks], minlength=len(starts))
        self._ids = np.concatenate([self._ids, ids[~breaks]])
        self._starts = np.concatenate([self._starts, self._starts[-1] + np.cumsum(counts)])
        return np.arange(first, first + len(starts))

    def _space(self, gap: bytes, last: bool) -> int:
        """Number of the ids of white space, without the blank that goes to the next word."""
        key = gap + (b"$" if last else b"")
        if key not in self._spaces:
            if last:
                parts = [gap]
            elif gap.endswith(b" "):
                parts = [gap[:-1]]
            else:
                parts = [gap[:-1], gap[-1:]]
            ids = [i for part in parts if part for i in self._bpe.encode_ordinary(part.decode())]
            self._ids = np.concatenate([self._ids, np.array(ids, np.int32)])
            self._starts = np.append(self._starts, self._starts[-1] + len(ids))
            self._spaces[key] = len(self._starts) - 2
        return self._spaces[key]

    def encode_slice(self, buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds) of the texts ``buffer[offsets[i]:offsets[i+1]]``."""
        if len(self._keys) > KEPT_WORDS:
            self._forget()
        words = find_words(buffer, offsets, lower=False)
        data = buffer.tobytes()
        before = np.concatenate([[0], words.ends[:-1]]) if len(words.ends) else words.ends
        opens = words.bounds[:-1][np.diff(words.bounds) > 0]
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(words.bounds))
        before[opens] = offsets[owner[opens]]
        gap = words.starts - before
        blank = (gap > 0) & (buffer[np.maximum(words.starts - 1, 0)] == 0x20)
        keys = mix(words.hashes + blank.astype(np.uint64))
        unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self._keys, unique)
        known = np.zeros(len(unique), bool)
        if len(self._keys):
            known = self._keys[np.minimum(at, len(self._keys) - 1)] == unique
        if not known.all():
            new = first[~known]
            numbers = self._remember(buffer, words.starts[new] - blank[new], words.ends[new])
            self._keys = np.insert(self._keys, at[~known], unique[~known])
            self._place = np.insert(self._place, at[~known], numbers)
            at = np.searchsorted(self._keys, unique)
        parts = self._place[at][inverse]
        # White space that gives ids of its own, in front of its word.
        odd = np.flatnonzero((gap > 1) | ((gap == 1) & ~blank))
        spaces = [
            self._space(data[a:b], False)
            for a, b in zip(before[odd].tolist(), words.starts[odd].tolist(), strict=True)
        ]
        counts = np.diff(words.bounds) + np.bincount(owner[odd], minlength=len(offsets) - 1)
        parts = np.insert(parts, odd, spaces)
        # White space at the end of a text.
        bounds = np.concatenate([[0], np.cumsum(counts)])
        ends = offsets[:-1].copy()
        some = np.diff(words.bounds) > 0
        ends[some] = words.ends[words.bounds[1:][some] - 1]
        tail = np.flatnonzero(offsets[1:] > ends)
        spaces = [
            self._space(data[a:b], True)
            for a, b in zip(ends[tail].tolist(), offsets[1:][tail].tolist(), strict=True)
        ]
        parts = np.insert(parts, bounds[1:][tail], spaces).astype(np.int64)
        counts[tail] += 1
        sizes = self._starts[parts + 1] - self._starts[parts]
        sums = np.concatenate([[0], np.cumsum(sizes)])
        places = np.repeat(self._starts[parts] - sums[:-1], sizes) + np.arange(sums[-1])
        ids, bounds = self._ids[places], sums[np.concatenate([[0], np.cumsum(counts)])]
        rare = {int(np.searchsorted(offsets, m.start(), "right")) - 1 for m in self._whole.finditer(data)}
        if not rare:
            return ids, bounds
        texts = [
            np.array(self.encode(data[offsets[i] : offsets[i + 1]].decode()), np.int32)
            if i in rare
            else ids[bounds[i] : bounds[i + 1]]
            for i in range(len(offsets) - 1)
        ]
        return np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


_loaded: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The worker process's tokenizer of that vocabulary."""
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]
