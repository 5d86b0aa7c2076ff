"""AES in cipher block chaining mode, all blocks of a text at once where the mode allows it."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def _times(a: int, b: int) -> int:
    """Product in the field of 256 elements."""
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = (a << 1) ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """The substitution, its inverse, and products by the factors of the mixing matrices."""
    # 3 generates the field: a power and its mirror are inverse to each other
    powers, x = [], 1
    for _ in range(255):
        powers.append(x)
        x = _times(x, 3)
    inverse = [0] * 256
    for k, p in enumerate(powers):
        inverse[p] = powers[-k % 255]
    turn = lambda v, n: (v << n | v >> (8 - n)) & 255
    box = np.array([i ^ turn(i, 1) ^ turn(i, 2) ^ turn(i, 3) ^ turn(i, 4) ^ 0x63 for i in inverse], np.uint8)
    back = np.zeros(256, np.uint8)
    back[box] = np.arange(256)
    return box, back, {f: np.array([_times(v, f) for v in range(256)], np.uint8) for f in (2, 3, 9, 11, 13, 14)}


#: Byte of a block that the row shift brings to each place.
SHIFT = np.array([(i + 4 * (i % 4)) % 16 for i in range(16)])
UNSHIFT = np.argsort(SHIFT)


def _round_keys(key: bytes) -> list[np.ndarray]:
    box, n = _tables()[0], len(key) // 4
    words = [list(key[4 * i : 4 * i + 4]) for i in range(n)]
    constant = 1
    while len(words) < 4 * (n + 7):
        w = words[-1]
        if len(words) % n == 0:
            w = [int(box[v]) for v in w[1:] + w[:1]]
            w[0] ^= constant
            constant = _times(constant, 2)
        elif n > 6 and len(words) % n == 4:
            w = [int(box[v]) for v in w]
        words.append([a ^ b for a, b in zip(words[-n], w, strict=True)])
    flat = np.array(words, np.uint8).reshape(-1, 16)
    return list(flat)


def _mix(state: np.ndarray, factors: tuple[int, int, int, int]) -> np.ndarray:
    by = _tables()[2]
    columns = state.reshape(len(state), 4, 4)
    out = np.zeros_like(columns)
    for row in range(4):
        for k, f in enumerate(factors):
            v = columns[:, :, (row + k) % 4]
            out[:, :, row] ^= v if f == 1 else by[f][v]
    return out.reshape(state.shape)


def _encrypted(state: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    box = _tables()[0]
    state = state ^ keys[0]
    for i, k in enumerate(keys[1:], 1):
        state = box[state][:, SHIFT]
        state = (_mix(state, (2, 3, 1, 1)) if i < len(keys) - 1 else state) ^ k
    return state


def _decrypted(state: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    back = _tables()[1]
    for i in range(len(keys) - 1, 0, -1):
        state = state ^ keys[i]
        state = _mix(state, (14, 11, 13, 9)) if i < len(keys) - 1 else state
        state = back[state[:, UNSHIFT]]
    return state ^ keys[0]


def decrypt(key: bytes, iv: bytes, data: bytes, padded: bool = True) -> bytes:
    """Whole blocks of data; what the padding says is taken off."""
    blocks = np.frombuffer(data[: len(data) // 16 * 16], np.uint8).reshape(-1, 16)
    if not len(blocks):
        return b""
    before = np.concatenate([np.frombuffer(iv, np.uint8).reshape(1, 16), blocks[:-1]])
    out = (_decrypted(blocks, _round_keys(key)) ^ before).tobytes()
    return out[: -out[-1]] if padded and 1 <= out[-1] <= 16 else out


def encrypt(key: bytes, iv: bytes, data: bytes, padded: bool = True) -> bytes:
    if padded:
        n = 16 - len(data) % 16
        data += bytes([n]) * n
    keys, out = _round_keys(key), []
    last = np.frombuffer(iv, np.uint8)
    for block in np.frombuffer(data, np.uint8).reshape(-1, 1, 16):
        last = _encrypted(block ^ last, keys)[0]
        out.append(last.tobytes())
    return b"".join(out)
