"""The first 32 bits of md5 over many short texts that differ in numbers alone, in numpy."""

from __future__ import annotations

import math
import struct

import numpy as np

_K = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_TURN = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_WORD = [lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: (7 * i) % 16]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Texts hashed at once: their states stay in the processor's cache.
LANES = 32_768


def _mix(which: int, b: np.ndarray, c: np.ndarray, d: np.ndarray, out: np.ndarray) -> np.ndarray:
    if which == 0:
        np.bitwise_xor(c, d, out=out)
        np.bitwise_and(out, b, out=out)
        return np.bitwise_xor(out, d, out=out)
    if which == 1:
        np.bitwise_xor(b, c, out=out)
        np.bitwise_and(out, d, out=out)
        return np.bitwise_xor(out, c, out=out)
    if which == 2:
        np.bitwise_xor(b, c, out=out)
        return np.bitwise_xor(out, d, out=out)
    np.bitwise_not(d, out=out)
    np.bitwise_or(out, b, out=out)
    return np.bitwise_xor(out, c, out=out)


def _block(state: list[np.ndarray], words: list, last: bool) -> list[np.ndarray]:
    """State after a block of 16 words, each a number or an array; of the last block only the first word is right."""
    a, b, c, d = (x.copy() for x in state)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(61 if last else 64):  # the last three steps leave the first word as it is
        m = words[_WORD[i // 16](i)]
        _mix(i // 16, b, c, d, f)
        np.add(a, f, out=a)
        if isinstance(m, np.ndarray):
            np.add(a, m, out=a)
            m = 0
        np.add(a, np.uint32((_K[i] + m) & 0xFFFFFFFF), out=a)
        s = _TURN[i // 16][i % 4]
        np.left_shift(a, np.uint32(s), out=t)
        np.right_shift(a, np.uint32(32 - s), out=a)
        np.bitwise_or(a, t, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    if last:  # after 61 steps the word that was turned last stands in b
        return [state[0] + b]
    return [x + y for x, y in zip(state, (a, b, c, d), strict=True)]


def _digits(numbers: np.ndarray, n_digits: int) -> np.ndarray:
    return (numbers[:, None] // 10 ** np.arange(n_digits - 1, -1, -1)) % 10 + 48


def _first_words(before: bytes, outer: np.ndarray, between: bytes, inner: np.ndarray) -> np.ndarray:
    """As first_words, for outer numbers of one length and inner ones of one length."""
    n_out, n_in = len(str(outer[0])), len(str(inner[0]))
    size = len(before) + n_out + len(between) + n_in
    n_blocks = (size + 8) // 64 + 1
    fixed = bytearray(before + bytes(n_out) + between + bytes(n_in) + b"\x80")
    fixed += bytes(64 * n_blocks - 8 - len(fixed)) + struct.pack("<Q", 8 * size)
    words = list(struct.unpack(f"<{16 * n_blocks}I", fixed))
    parts: dict[int, list] = {}
    for side, (at, numbers, n) in enumerate(((len(before), outer, n_out), (size - n_in, inner, n_in))):
        for j, column in enumerate(_digits(numbers, n).T):
            w, shift = divmod(at + j, 4)
            sides = parts.setdefault(w, [0, 0])
            sides[side] = sides[side] + (column.astype(np.uint32) << np.uint32(8 * shift))
    shape = (len(outer), len(inner))
    for w, (x, y) in parts.items():
        if len(outer) == 1 and isinstance(x, np.ndarray):
            words[w], x = words[w] + int(x[0]), 0
        if len(inner) == 1 and isinstance(y, np.ndarray):
            words[w], y = words[w] + int(y[0]), 0
        x, y = (x[:, None] if isinstance(x, np.ndarray) else None), (y[None, :] if isinstance(y, np.ndarray) else None)
        both = x if y is None else y if x is None else x + y
        if both is not None:
            words[w] = np.ascontiguousarray(np.broadcast_to(both + np.uint32(words[w]), shape)).ravel()
    state = [np.full(len(outer) * len(inner), x, np.uint32) for x in _START]
    for k in range(n_blocks):
        state = _block(state, words[16 * k : 16 * k + 16], k == n_blocks - 1)
    return state[0].byteswap().reshape(shape)  # hex digits stand byte by byte


def _runs(low: int, high: int):
    """Ranges of numbers of equally many digits within low to high (exclusive)."""
    while low < high:
        end = min(high, 10 ** len(str(low)))
        yield low, end
        low = end


def first_words(before: str, outer: range, between: str, inner: range) -> np.ndarray:
    """The number in the first 8 hex digits of md5(before + o + between + i), a row for each o and a column for each i."""
    out = np.empty((len(outer), len(inner)), np.uint32)
    head, middle = before.encode(), between.encode()
    for o0, o1 in _runs(outer.start, outer.stop):
        for i0, i1 in _runs(inner.start, inner.stop):
            width = min(i1 - i0, LANES)
            height = max(1, LANES // width)
            for o in range(o0, o1, height):
                rows = np.arange(o, min(o1, o + height))
                for i in range(i0, i1, width):
                    columns = np.arange(i, min(i1, i + width))
                    out[o - outer.start : o - outer.start + len(rows), i - inner.start : i - inner.start + len(columns)] = _first_words(head, rows, middle, columns)
    return out
