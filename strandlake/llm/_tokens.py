"""Token ids of byte-level BPE tokenizer files, piece by piece.

The tokenizer splits a text into pieces (a word with the blank before it, a number, a run of signs, white space) and
encodes each by itself. Here a chunk is split by array operations over its code points' classes; equal pieces are encoded
once and remembered, up to ``REMEMBERED`` of them, after which the memory starts anew.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from strandlake.llm._text import ragged, spans_hash

REMEMBERED = 300_000
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4


def class_table() -> np.ndarray:
    r"""For each code point: \\p{L}, \\p{N}, \\s or none of these, as the tokenizer's pattern has them."""
    import regex

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            if b - a == len(m[0]) - 1:
                table[a : b + 1] = kind
            else:
                table[[ord(c) for c in m[0]]] = kind
    return table


def pieces(code: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the pieces of a chunk's code points; first: where texts start (and the end)."""
    n = len(code)
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    starts = edge[:n].copy()
    starts[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    last = np.zeros(n, bool)  # the last space before something else in its text
    last[:-1] = space[:-1] & ~space[1:] & ~edge[1:n]
    starts |= last  # it stands alone or begins the next piece
    blank = last & (code == 0x20)
    joined = np.flatnonzero(blank) + 1
    starts[joined] = False
    # a lone apostrophe takes the letters of a contraction with it
    quote = np.flatnonzero((code == 0x27) & starts)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~edge[quote + 1]]
    if len(quote):
        a = code[quote + 1]
        second = np.minimum(quote + 2, n - 1)
        b = np.where((quote + 2 < n) & ~edge[quote + 2], code[second], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ~one & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        size = np.where(one, 1, np.where(two, 2, 0))
        took = size > 0
        starts[quote[took] + 1] = False
        after = quote[took] + 1 + size[took]
        more = (after < n) & ~edge[after]
        starts[after[more]] = True
    return np.flatnonzero(starts)


class Vocabulary:
    """What a byte-level BPE file of the ``tokenizers`` library with this splitting pattern holds: read once, on the driver.

    ranks: the vocabulary's bytes with their ids, where ids are in the order of merges (checked on samples against the
    library); else None, and the library itself encodes pieces, from the file at ``path`` on each machine.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        self.path, self.classes, self.ranks = path, class_table(), None
        try:
            letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
            letters += [b for b in range(256) if b not in letters]
            to_byte = {chr(b if n < 188 else 256 + n - 188): b for n, b in enumerate(letters)}
            special = set(tokenizer.get_added_tokens_decoder())
            self.ranks = {bytes(to_byte[c] for c in t): i for t, i in tokenizer.get_vocab().items() if i not in special}
            fast = self.encoder()
            samples = (" the", " internationalisation", "Zürich", " 1234567", "日本語", " \n\t", "????!!", "\x00\x1c", " éauouxmentçan", "ondthenblerti")
            if any(list(fast(t)) != tokenizer.encode(t, add_special_tokens=False).ids for t in samples):
                self.ranks = None
        except (ImportError, KeyError, ValueError):
            self.ranks = None

    def encoder(self):
        """How one piece is encoded."""
        if self.ranks is not None:
            import tiktoken

            return tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})._encode_single_piece
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.encode_special_tokens = True
        return lambda t: tokenizer.encode(t, add_special_tokens=False).ids

    def ids(self) -> Ids:
        """The encoder of this process, built once: tasks of one worker share it through the broadcast vocabulary."""
        if getattr(self, "_ids", None) is None:
            self._ids = Ids(self)
        return self._ids

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_ids"}


class Ids:
    """Ids of texts by a vocabulary."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.encode, self.classes = vocabulary.encoder(), vocabulary.classes
        self.values = np.random.default_rng(7).integers(1, 1 << 63, 0x110000, dtype=np.uint64)
        self.forget()

    def forget(self) -> None:
        """No piece is remembered. Known hashes ascend, each with the number of its piece; pieces are ranges of ``flat``."""
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.start, self.size, self.flat, self.used = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(1 << 20, np.uint32), 0

    def learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        """hashes: new ones, ascending."""
        ids = list(map(self.encode, texts))
        size = np.array(list(map(len, ids)), np.int32)
        total = int(size.sum())
        while self.used + total > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros(len(self.flat), np.uint32)]
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.number = np.insert(self.number, at, np.arange(len(self.start), len(self.start) + len(ids), dtype=np.int32))
        self.start = np.r_[self.start, (self.used + np.cumsum(size) - size).astype(np.int32)]
        self.size = np.r_[self.size, size]
        self.used += total

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and each text's number of them."""
        if len(self.known) > REMEMBERED:
            self.forget()
        rows = [t or "" for t in texts.to_pylist()]
        joined = "".join(rows)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.r_[0, np.cumsum([len(t) for t in rows])]
        del rows
        if not len(code):
            return np.zeros(0, np.uint32), np.zeros(len(first) - 1, np.int64)
        start = pieces(code, self.classes[code], first)
        end = np.r_[start[1:], len(code)]
        unique, at, back = np.unique(spans_hash(code, start, end, self.values), return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, unique)
        old = np.zeros(len(unique), bool)
        inside = place < len(self.known)
        old[inside] = self.known[place[inside]] == unique[inside]
        if not old.all():
            new = at[~old].tolist()
            self.learn(unique[~old], [joined[start[a] : end[a]] for a in new])
            place = np.searchsorted(self.known, unique)
        piece = self.number[place][back]
        size = self.size[piece].astype(np.int64)
        ids = self.flat[ragged(self.start[piece].astype(np.int64), size)]
        total = np.r_[0, np.cumsum(size)]
        return ids, np.diff(total[np.searchsorted(start, first)])
