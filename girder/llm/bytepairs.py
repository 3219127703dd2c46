"""Byte-level encoding of whole columns of texts.

The byte-level pre-tokenizer cuts texts at changes between letters, digits, white space and other signs; those pre-tokens are the
chunks of ``chunks.ColumnEncoder``. New ones are joined by their own leading
spaces or by line feeds, which no pre-token crosses, so that the tokenizers library encodes thousands in one text.

Texts with characters beyond the plain ones, with a NUL or with one of the tokenizer's added tokens go whole to the
library, as do all texts if the tokenizer is not of this kind. A null text is an empty one, without ids.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np

from girder.llm.chunks import ColumnEncoder, holding

#: Characters below this have at most two bytes, and all versions of the character tables class them alike.
PLAIN_BELOW = 0x240
SPACE, LETTER, DIGIT, SIGN = range(4)
#: Second letters of the contractions with one and with two letters.
ONE = b"stmd"
TWO = (b"re", b"ve", b"ll")


def character_classes() -> np.ndarray:
    """The class of every plain character."""
    white = {*range(9, 14), 32, 0x85, 0xA0}
    by = {"L": LETTER, "N": DIGIT}
    return np.array([SPACE if c in white else by.get(unicodedata.category(chr(c))[0], SIGN) for c in range(PLAIN_BELOW)], np.uint8)


def cuts(w: np.ndarray, n: int, heads: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of the first ``n`` bytes begin; ``heads``: where texts begin. Two bytes or more follow the n."""
    c = classes[np.minimum(w[: n + 2], 0x7F)]
    lead = np.flatnonzero(w[:n] >= 0xC0)
    if len(lead):
        c[lead] = c[lead + 1] = classes[((w[lead] & 0x1F).astype(np.int64) << 6) | (w[lead + 1] & 0x3F)]
    c[n:] = SPACE
    head = np.zeros(n + 2, bool)
    head[heads] = True
    head[n:] = True
    first = head.copy()
    first[1:n] |= c[1:n] != c[: n - 1]
    at = np.flatnonzero(first[:n])
    # White space before a word: its last character goes with the word if it is a space, and else stands alone.
    turn = at[(c[at] != SPACE) & ~head[at]]
    turn = turn[c[turn - 1] == SPACE]
    last = w[turn - 1]
    first[turn - 1 - (last >= 0x80)] = True
    first[turn[last == 0x20]] = False
    # Contractions: an apostrophe that begins a pre-token takes one or two letters.
    mark = at[(w[at] == 0x27) & first[at]]
    x = mark + 1
    x = x[(c[x] == LETTER) & ~head[x]]
    a, b = w[x], w[x + 1]
    one = np.isin(a, np.frombuffer(ONE, np.uint8))
    two = ~head[x + 1] & np.isin(a.astype(np.uint16) << 8 | b, [t[0] << 8 | t[1] for t in TWO])
    first[x[one | two]] = False
    for end in (x[one] + 1, x[two] + 2):
        first[end[c[end] == LETTER]] = True
    return np.flatnonzero(first[:n])


class ByteEncoder(ColumnEncoder):
    """Ids of texts exactly as the tokenizers library gives them without special tokens of a post-processor."""

    def __init__(self, path: str, slots: int = 1 << 21):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.levels = max(1, int(max(vocabulary.values(), default=1)).bit_length())
        super().__init__(slots, np.dtype("<u4" if self.levels > 16 else "<u2"))
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.classes = character_classes()
        # A byte-level token has one character a byte.
        self.bytes_of = np.zeros(1 << self.levels, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(t) for t in vocabulary]
        with open(path, encoding="utf-8") as f:
            self.by_pre_token = self.known_kind(json.load(f))

    def known_kind(self, made: dict) -> bool:
        cut, model = made.get("pre_tokenizer") or {}, made["model"]
        plain = not made.get("normalizer") and not made.get("truncation") and not made.get("padding") and not any(t.get("lstrip") or t.get("rstrip") for t in made["added_tokens"])
        pairs = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        return plain and pairs and cut.get("type") == "ByteLevel" and not cut["add_prefix_space"] and cut.get("use_regex", True) and len(self.library(["\n"])[0]) == 1

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(self, parts: list[bytes], glue: bytes) -> list[np.ndarray]:
        """Ids of each of many pre-tokens that ``glue`` keeps apart, by calls of some thousands."""
        out = []
        for k in range(0, len(parts), 4096):
            some = parts[k : k + 4096]
            ids = self.library([glue.join(some).decode()])[0]
            ends = np.cumsum(self.bytes_of[ids])
            to = np.cumsum([len(p) + len(glue) for p in some]) - len(glue)
            last = np.searchsorted(ends, to)
            if last[-1] != len(ids) - 1 or (ends[last] != to).any():  # a part was not a pre-token of its own
                out += self.library([p.decode() for p in some])
                continue
            begin = np.concatenate([[0], last[:-1] + 1 + (1 if glue else 0)])
            out += [ids[a:b] for a, b in zip(begin.tolist(), (last + 1).tolist(), strict=True)]
        return out

    def ids_of(self, parts: list[bytes]) -> list[np.ndarray]:
        """Ids of distinct pre-tokens."""
        out: list = [None] * len(parts)
        groups: dict[bytes | None, list[int]] = {}
        for i, p in enumerate(parts):
            head = p[1:].decode()[:1] if p[0] == 0x20 else p.decode()[:1]
            spaced = not head or self.classes[ord(head)] == SPACE
            groups.setdefault(None if spaced else b"" if p[0] == 0x20 else b"\n", []).append(i)
        for glue, places in groups.items():
            some = [parts[i] for i in places]
            for i, ids in zip(places, self.library([p.decode() for p in some]) if glue is None else self.joined(some, glue), strict=True):
                out[i] = ids
        return out

    def cuts(self, w: np.ndarray, n: int, heads: np.ndarray) -> np.ndarray:
        return cuts(w, n, heads, self.classes)

    def safe(self, before: np.ndarray, here: np.ndarray) -> np.ndarray:
        """A change of class after a character that is neither white space nor beside an apostrophe, of ASCII alone."""
        plain = (before < 0x80) & (here < 0x80) & (before != 0x27) & (here != 0x27)
        old, new = (self.classes[np.minimum(x, 0x7F)] for x in (before, here))
        return plain & (old != SPACE) & (old != new)

    def whole(self, buffer: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if not self.by_pre_token:
            return np.ones(len(bounds) - 1, bool)
        body = buffer[: bounds[-1]]
        return holding(buffer, bounds, np.flatnonzero((body == 0) | (body >= 0xC0 | PLAIN_BELOW >> 6)), self.added)
