"""MD5 sums of many short texts `<draw>-<id>` at once, the same as hashlib's."""

from __future__ import annotations

import math
from hashlib import md5

import numpy as np

#: Texts whose state is in the processor's cache at once, those of one prefix, whose words are made already, characters that fit one
#: block of the sum, and texts that are summed one by one.
CHUNK, MANY, LONGEST, FEW = 8192, 32768, 55, 400
_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MASK = 0xFFFFFFFF


class Marks:
    """The first eight or four bytes, and the last eight, of the sums of `prefix + str(id)` for given ids."""

    def __init__(self, ids: np.ndarray):
        self.n, self.few = len(ids), [str(i).encode() for i in ids.tolist()] if len(ids) < FEW else None
        if self.few is not None:
            return
        names = np.array([str(i) for i in ids.tolist()], dtype="S")
        lengths = np.char.str_len(names)
        #: for each length of a name: where, and its characters
        self.groups = []
        for k in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == k)
            self.groups.append((at, names[at].astype(f"S{k}").view(np.uint8).reshape(-1, k)))

    def sums(self, prefix: str) -> np.ndarray:
        """(n, 4): the sums as little-endian 32-bit numbers."""
        if self.few is not None:
            start = prefix.encode()
            return np.frombuffer(b"".join([md5(start + i).digest() for i in self.few]), "<u4").reshape(-1, 4)
        out = np.empty((self.n, 4), np.uint32)
        for at, letters in self.groups:
            for i in range(0, len(at), CHUNK):
                out[at[i : i + CHUNK]] = _md5(prefix.encode(), letters[i : i + CHUNK])
        return out

    def halves(self, prefix: str) -> tuple[np.ndarray, np.ndarray]:
        """The sums' first and last eight bytes, big-endian as text is ordered."""
        both = self.sums(prefix).view(">u8").astype(np.uint64)
        return both[:, 0], both[:, 1]

    def first(self, prefix: str) -> np.ndarray:
        """The sums' first four bytes as a number."""
        return self.sums(prefix)[:, 0].byteswap()


def _md5(prefix: bytes, letters: np.ndarray) -> np.ndarray:
    n, k = letters.shape
    size = len(prefix) + k
    if size > LONGEST:
        raise ValueError(f"texts of over {LONGEST} characters")
    block = np.zeros((n, 64), np.uint8)
    block[:, : len(prefix)] = np.frombuffer(prefix, np.uint8)
    block[:, len(prefix) : size] = letters
    block[:, size] = 0x80
    words: list = np.ascontiguousarray(block.view("<u4").T)
    own = range(len(prefix) // 4, (size - 1) // 4 + 1)  # the other words are the same for all
    words = [words[i].astype(np.uint32) if i in own else int(words[i][0]) for i in range(14)] + [8 * size, 0]
    return np.stack(_rounds(words, n), axis=1)


def _rounds(words: list, n: int) -> tuple[np.ndarray, ...]:
    """The four numbers of n sums from the 16 words of their only block: one number for all, or one each."""
    a, b, c, d = (np.full(n, v, np.uint32) for v in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        turn, shift = i // 16, _SHIFTS[i // 16][i % 4]
        if turn == 0:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif turn == 1:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        word = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[turn] % 16]
        if isinstance(word, int):
            np.add(f, np.uint32((word + _SINES[i]) & _MASK), out=f)
        else:
            np.add(f, word, out=f)
            np.add(f, np.uint32(_SINES[i]), out=f)
        np.left_shift(f, np.uint32(shift), out=t)
        np.right_shift(f, np.uint32(32 - shift), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=a)  # a is not needed any more
        a, b, c, d = d, a, b, c
    return tuple(v + np.uint32(s) for v, s in zip((a, b, c, d), _START, strict=True))


class Ends:
    """The first four bytes of the sums of `prefix + text` for given short texts and many prefixes."""

    def __init__(self, texts: np.ndarray):
        self.texts, lengths = texts, np.char.str_len(texts)
        width = int(lengths.max(initial=0))
        letters = np.zeros((len(texts), width + 1), np.uint8)
        letters[:, :width] = texts.astype(f"S{max(width, 1)}").view(np.uint8).reshape(len(texts), -1)[:, :width]
        letters[np.arange(len(texts)), lengths] = 0x80
        #: chunks of texts: where, their characters and the mark of the end, and their bits
        self.chunks = [(at, letters[at], (8 * lengths[at]).astype(np.uint32)) for i in range(0, len(texts), MANY) for at in [slice(i, i + MANY)]]
        self._words: dict[tuple[int, int], list[np.ndarray]] = {}

    def _placed(self, i: int, shift: int) -> list[np.ndarray]:
        """Words of a chunk's texts from the byte `shift` of the first word."""
        if (i, shift) not in self._words:
            letters = self.chunks[i][1]
            block = np.zeros((len(letters), -(-(shift + letters.shape[1]) // 4) * 4), np.uint8)
            block[:, shift : shift + letters.shape[1]] = letters
            self._words[i, shift] = [np.ascontiguousarray(w) for w in block.view("<u4").T]
        return self._words[i, shift]

    def first(self, prefix: bytes) -> np.ndarray:
        out, begun = np.empty(len(self.texts), np.uint32), len(prefix) // 4
        known = np.frombuffer(prefix.ljust(4 * begun + 4, b"\0"), "<u4").tolist()
        for i, (at, letters, bits) in enumerate(self.chunks):
            if len(prefix) + letters.shape[1] - 1 > LONGEST:
                out[at] = [int.from_bytes(md5(prefix + t).digest()[:4], "big") for t in self.texts[at].tolist()]
                continue
            own = self._placed(i, len(prefix) % 4)
            words = [*known[:begun], own[0] | np.uint32(known[begun]), *own[1:]]
            words += [0] * (14 - len(words)) + [bits + np.uint32(8 * len(prefix)), 0]
            out[at] = _rounds(words, len(bits))[0].byteswap()
        return out
