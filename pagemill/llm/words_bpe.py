"""Token ids of white-space words, for tokenizers that drop white space between words."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from pagemill.llm.common import Texts, Words

BLOCK = 1 << 22
"""Bytes of text encoded at a time: each distinct word is looked up once in a block."""
MANY_IDS = 64
"""A word of more ids is not kept when others have to go."""


class WordEncoder:
    """Encodes texts word by word and remembers the ids of the words seen.

    The library does all encoding, with its normalizing and its special strings; a word's ids are the same alone and
    within a text because the tokenizer splits at white space first and drops it. Unseen words are encoded together,
    parted by blanks; where the tokens that end a word do not show where each word's ids end, one at a time. Words are
    known by 64-bit hashes, so a remembered word costs some 30 bytes and its ids. About ``room`` words and 8 times as many
    ids are remembered: beyond, those used least are forgotten.
    """

    def __init__(self, path: str, room: int = 1_500_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        first = self.tokenizer.encode("a b", add_special_tokens=False)
        if any(c.isspace() for t, (a, b) in zip(first.tokens, first.offsets) for c in "a b"[a:b]):
            raise ValueError("this tokenizer keeps white space within its tokens")
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.room = room
        self.letters: dict[str, bool] = {}
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes, and their words' numbers
        self.size, self.at, self.used = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.filled = np.zeros(1 << 18, np.uint32), 0

    def parts(self, letter: str) -> bool:
        """Whether the library parts this letter from a full stop or comma behind it: it may know fewer letters."""
        if letter not in self.letters:
            alone, *ended = (e.ids for e in self.tokenizer.encode_batch([letter, ".", ",", f"{letter}.", f"{letter},"], add_special_tokens=False))
            self.letters[letter] = ended[2:] == [alone + ended[0], alone + ended[1]]
        return self.letters[letter]

    def _together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of words of letters, 512 at a time; those whose ends do not show are encoded one at a time."""
        ids, sizes = [], []
        for lo in range(0, len(words), 512):
            part = words[lo : lo + 512]
            got = np.array(self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False).ids, np.uint32)
            stops = np.flatnonzero(self.ends[got]) + 1
            if len(stops) == len(part) and stops[-1] == len(got):
                ids.append(got)
                sizes.append(np.diff(stops, prepend=0))
            else:
                got, alone = self._alone(part)
                ids.append(got)
                sizes.append(alone)
        none = [np.zeros(0, np.int64)]
        return np.concatenate(ids or [np.zeros(0, np.uint32)]), np.concatenate(sizes or none)

    def _alone(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch([w.decode() for w in words], add_special_tokens=False)]
        return np.array([i for own in got for i in own], np.uint32), np.array([len(own) for own in got], np.int64)

    def encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some words one after another, and how many each has."""
        stems: dict[bytes, int] = {}
        odd: dict[bytes, int] = {}
        head, tail = np.zeros(len(words), np.int64), np.full(len(words), -1)
        for i, w in enumerate(words):
            stem = w.rstrip(b".,")
            text = stem.decode()
            # Lower-casing may turn a letter into one and a mark (U+0130). Full stops and commas behind letters are split
            # off by the tokenizer too.
            if text.isalpha() and (stem.isascii() or text.lower().isalpha()) and (len(stem) == len(w) or self.parts(text[-1])):
                head[i] = stems.setdefault(stem, len(stems))
                if len(stem) < len(w):
                    tail[i] = odd.setdefault(w[len(stem) :], len(odd))
            else:
                head[i], tail[i] = -1, odd.setdefault(w, len(odd))
        ids, sizes = self._together(list(stems))
        more, odd_sizes = self._alone(list(odd))
        ids, sizes = np.concatenate([ids, more]), np.concatenate([sizes, odd_sizes])
        at = np.cumsum(sizes) - sizes
        pick = np.stack([head, np.where(tail >= 0, tail + len(stems), -1)], 1).ravel()
        pick = pick[pick >= 0]
        own = sizes[np.where(head >= 0, head, 0)] * (head >= 0) + sizes[np.where(tail >= 0, tail + len(stems), 0)] * (tail >= 0)
        return gathered(ids, at[pick], sizes[pick]), own

    def slots(self, keys: np.ndarray, words: Words, first: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Numbers for some distinct hashes, valid until the next call; ``first`` says where in ``words`` each stands."""
        spot, known = self._find(keys)
        if len(self.keys) + int((~known).sum()) > self.room or self.filled > 8 * self.room:
            self.shrink()
            spot, known = self._find(keys)
        fresh = np.flatnonzero(~known)
        if len(fresh):
            data = words.data.tobytes()
            ids, sizes = self.encoded([data[a:b] for a, b in zip(words.start[first[fresh]].tolist(), words.end[first[fresh]].tolist())])
            number = len(self.size) + np.arange(len(fresh))
            while self.filled + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.filled : self.filled + len(ids)] = ids
            self.at = np.concatenate([self.at, self.filled + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes.astype(np.int32)])
            self.used = np.concatenate([self.used, np.zeros(len(fresh), np.int64)])
            self.filled += len(ids)
            both = np.concatenate([self.keys, keys[fresh]])
            order = np.argsort(both, kind="stable")  # two sorted runs
            self.keys, self.slot = both[order], np.concatenate([self.slot, number])[order]
            spot, _ = self._find(keys)
        out = self.slot[spot]
        self.used[out] += times
        return out

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        spot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return spot, self.keys[spot] == keys

    def shrink(self) -> None:
        """Forget all but the words used most, half of the room at most."""
        worth = np.where(self.size <= MANY_IDS, self.used, 0)
        kept = np.argsort(-worth, kind="stable")[: self.room // 2]
        kept = kept[(worth[kept] > 1) & (np.cumsum(self.size[kept]) <= 4 * self.room)]
        ids = gathered(self.ids, self.at[kept], self.size[kept])
        number = np.full(len(self.size), -1)
        number[kept] = np.arange(len(kept))
        stay = number[self.slot] >= 0
        self.keys, self.slot = self.keys[stay], number[self.slot[stay]]
        self.size, self.used = self.size[kept], self.used[kept] // 2
        self.at = np.cumsum(self.size, dtype=np.int64) - self.size
        self.ids, self.filled = np.concatenate([ids, np.zeros(1 << 18, np.uint32)]), len(ids)

    def rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words of some texts, valid until the next call, and how many words each text has."""
        words = Texts(column).words()
        keys, first, back, times = np.unique(words.hashes(), return_index=True, return_inverse=True, return_counts=True)
        return self.slots(keys, words, first, times)[back] if len(keys) else np.zeros(0, np.int64), words.count

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids one after another, and how many each has."""
        return gathered(self.ids, self.at[slots], self.size[slots]), self.size[slots]


def gathered(ids: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``ids`` that begin at ``at``, one after another."""
    stops = np.cumsum(sizes, dtype=np.int64)
    return ids[np.repeat(at - (stops - sizes), sizes) + np.arange(stops[-1] if len(stops) else 0)]


def encoder(path: str) -> WordEncoder:
    """The encoder of this worker process. It is kept in ``sys``, which outlives the code sent with one task."""
    held = sys.__dict__.setdefault("_pagemill_encoders", {})
    if path not in held:
        held[path] = WordEncoder(path)
    return held[path]
