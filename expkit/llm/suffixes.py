"""Repeats of at least ``LENGTH`` bytes: anchors, segments and the enhanced suffix array."""

from __future__ import annotations

import numpy as np

#: Shortest repeat, in bytes, and the bytes of an anchor.
LENGTH, ANCHOR = 50, 20
#: A piece of text looked at in one go; positions take 24 bits.
PIECE = 1 << 19

_RNG = np.random.default_rng(50)
_OF_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.multiply.accumulate(np.r_[np.uint64(1), np.full(PIECE + LENGTH, _BASE, np.uint64)])
_INVERSE = np.multiply.accumulate(np.r_[np.uint64(1), np.full(PIECE + LENGTH, pow(_BASE, -1, 1 << 64), np.uint64)])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def window_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the windows of LENGTH bytes from each place on."""
    h = np.zeros(len(at), np.uint64)
    for i in range(LENGTH):
        h += _OF_BYTE[data[at + i]] * _POWERS[i]
    return _mixed(h + np.uint64(LENGTH))


class Segments:
    """The text around each anchor of a list of texts.

    Every window of LENGTH bytes has an anchor, its ANCHOR bytes with the least
    hash (the first of equals); equal windows have equal anchors at equal places.
    A segment is the text of the consecutive windows that share one: text number,
    first byte, number of bytes, hash of the anchor, hash of the segment.
    """

    def __init__(self, texts: list[np.ndarray]):
        parts = []
        todo: list[tuple[int, int, np.ndarray]] = []
        held = 0
        for i, text in enumerate(texts):
            for at in range(0, max(1, len(text) - LENGTH + 1), PIECE):
                piece = text[at : at + PIECE + LENGTH - 1]
                if len(piece) < LENGTH:
                    continue
                if held + len(piece) > PIECE and todo:
                    parts.append(self._of(todo))
                    todo, held = [], 0
                todo.append((i, at, piece))
                held += len(piece)
        if todo:
            parts.append(self._of(todo))
        columns = zip(*parts, strict=True) if parts else [[]] * 5
        self.text, self.first, self.size, self.anchor, self.hash = (
            np.concatenate(c) if len(c) else np.empty(0, t) for c, t in zip(columns, (np.int64, np.int64, np.int64, np.uint64, np.uint64), strict=True)
        )

    @staticmethod
    def _of(pieces: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, ...]:
        text = np.concatenate([p for _, _, p in pieces])
        size = np.array([len(p) for _, _, p in pieces])
        n = len(text)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_OF_BYTE[text] * _POWERS[:n], out=sums[1:])
        anchors = _mixed((sums[ANCHOR:] - sums[:-ANCHOR]) * _INVERSE[: n - ANCHOR + 1])
        least = (anchors & ~np.uint64(0xFFFFFF)) | np.arange(len(anchors), dtype=np.uint64)
        width, reach = 1, LENGTH - ANCHOR + 1
        while 2 * width <= reach:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < reach:
            least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
        # least[p]: the anchor of the window from p on; windows over the end of a piece are none.
        at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        start = np.cumsum(size) - size
        window = np.ones(len(at), bool)
        for s in start[1:]:
            window[s - LENGTH + 1 : s] = False
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (window[1:] != window[:-1])
        new[start] = True
        head = np.flatnonzero(new)
        tail = np.r_[head[1:], len(at)]
        head, tail = head[window[head]], tail[window[head]]
        piece = np.searchsorted(start, head, "right") - 1
        length = tail - 1 - head + LENGTH
        whole = _mixed((sums[head + length] - sums[head]) * _INVERSE[head] + length.astype(np.uint64))
        number, offset = np.array([i for i, _, _ in pieces]), np.array([at for _, at, _ in pieces])
        # Least hashes are small ones: mixed again, they are spread evenly over the buckets.
        return number[piece], offset[piece] + head - start[piece], length, _mixed(anchors[at[head]] + _OF_BYTE[0]), whole


def repeats(anchor: np.ndarray, size: np.ndarray, data: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Maximal repeat groups among distinct segments: (segments, first bytes, length).

    ``data`` holds the segments' bytes one behind the other.  A segment that shares
    its anchor with no other is a group by itself.  Of the others, all suffixes of at
    least LENGTH bytes are sorted within their anchor, common prefixes are taken
    between neighbours, and a stack scan gives the intervals of the common-prefix
    tree; those with more than one byte, or a segment's edge, to their left are
    maximal.
    """
    start = np.cumsum(size) - size
    _, number, found = np.unique(anchor, return_inverse=True, return_counts=True)
    alone = np.flatnonzero(found[number] == 1)
    groups = [(np.array([s]), np.zeros(1, np.int64), int(size[s])) for s in alone]
    several = np.flatnonzero(found[number] > 1)
    if not len(several):
        return groups
    count = size[several] - LENGTH + 1
    segment = np.repeat(several, count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = start[segment] + offset
    left = size[segment] - offset

    words = -(-int(size[several].max()) // 8)
    padded = np.r_[data, np.zeros(8 * words + 8, np.uint8)]
    keys = []
    for w in range(words):
        key = np.zeros(len(at), np.uint64)
        for b in range(8):
            key = key << np.uint64(8) | np.where(8 * w + b < left, padded[at + 8 * w + b], 0).astype(np.uint64)
        keys.append(key)
    order = np.lexsort((left, *keys[::-1], number[segment]))
    segment, offset, left, group = segment[order], offset[order], left[order], number[segment][order]

    common = np.zeros(len(order), np.int64)  # with the suffix before
    same = np.ones(len(order) - 1, bool)
    for key in keys:
        key = key[order]
        differ = key[1:] ^ key[:-1]
        agree = np.full(len(differ), 8)
        for b in range(8):
            agree[(agree == 8) & ((differ >> np.uint64(56 - 8 * b)) & np.uint64(0xFF) != 0)] = b
        common[1:] += np.where(same, agree, 0)
        same &= agree == 8
    common[1:] = np.minimum(common[1:], np.minimum(left[1:], left[:-1]))
    common[1:][group[1:] != group[:-1]] = 0
    before = np.where(offset > 0, padded[start[segment] + offset - 1].astype(np.int64), -1)

    for first, last, length in intervals(common):
        b = before[first:last]
        if b[0] < 0 or (b != b[0]).any():
            groups.append((segment[first:last], offset[first:last], length))
    # Whole segments that share no window with another still repeat among their own copies.
    edge = np.flatnonzero(offset == 0)
    groups += [(segment[i : i + 1], offset[i : i + 1], int(left[i])) for i in edge]
    return groups


def intervals(common: np.ndarray) -> list[tuple[int, int, int]]:
    """Intervals (first, last, common prefix) of the suffix array whose common prefix is at least LENGTH."""
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []  # (first, common prefix), rising
    for i, c in enumerate([*common.tolist()[1:], 0]):
        first = i
        while stack and stack[-1][1] > c:
            first, length = stack.pop()
            out.append((first, i + 1, length))
        if c >= LENGTH and (not stack or stack[-1][1] < c):
            stack.append((first, c))
    return out
