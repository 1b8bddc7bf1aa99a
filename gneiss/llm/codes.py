"""Characters of many texts as one array, and hashes of all their windows.

These helpers work on one Arrow batch inside a task; Spark distributes the batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: An odd multiplier, so that its powers can be inverted modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[str, np.ndarray] = {}


def code_points(text: str) -> np.ndarray:
    """The code points of ``text`` as uint32."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def segments(texts: list[str | None], size: int, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, str]]:
    """Texts packed into stretches of about ``size`` characters.

    Yields (row of each part, offset of each part in its text, and so on) as ``(parts, codes, joined)``, where
    ``parts`` has the columns row, offset in the text, start and end in ``codes``. A text longer than ``size`` comes in several parts
    that share ``overlap`` characters, so that no window of ``overlap + 1`` characters is missed or seen across two texts.
    """
    parts, chunk, n = [], [], 0
    for row, text in enumerate(texts):
        if not text:
            continue
        at = 0
        while True:
            piece = text if at == 0 and len(text) <= size else text[at : at + size]
            parts.append((row, at, n, n + len(piece)))
            chunk.append(piece)
            n += len(piece)
            if n >= size:
                joined = "".join(chunk)
                yield np.array(parts, dtype=np.int64), code_points(joined), joined
                parts, chunk, n = [], [], 0
            if at + len(piece) >= len(text):
                break
            at += size - overlap
    if parts:
        joined = "".join(chunk)
        yield np.array(parts, dtype=np.int64), code_points(joined), joined


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        size = max(n, 1 << 20)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("p", _BASE), ("q", inverse)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["p"][:n], _POWERS["q"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: near values end far apart."""
    h = h ^ (h >> np.uint64(32))
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of code * base**i, from which ``window_hash`` takes the hash of any window."""
    p, _ = powers(len(codes))
    c = (codes.astype(np.uint64) + np.uint64(1)) * _MIX
    c ^= c >> np.uint64(31)
    c *= p
    out = np.empty(len(codes) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(c, out=out[1:])
    return out


def window_hash(prefix: np.ndarray, width: int, starts: np.ndarray | None = None) -> np.ndarray:
    """The hash of the window of ``width`` characters from every start (or from ``starts``)."""
    n = len(prefix) - 1
    _, q = powers(max(n, 1))
    if starts is None:
        h = prefix[width:] - prefix[: n + 1 - width]
        h *= q[: len(h)]
    else:
        h = (prefix[starts + width] - prefix[starts]) * q[starts]
    return mix(h)


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """The minimum of every ``k`` consecutive values, in three passes for any ``k``."""
    n = len(x)
    m = -(-n // k)
    y = np.full(m * k, np.iinfo(x.dtype).max, dtype=x.dtype)
    y[:n] = x
    y = y.reshape(m, k)
    front = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - k + 1], front[k - 1 : n])
