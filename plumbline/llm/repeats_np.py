"""Array work of operator 7: anchors in byte strings, and longest-previous-factor arrays."""

from __future__ import annotations

import numpy as np
import xxhash

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of all grams of bytes; gram is a power of two."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _A
    w = 1
    while w < gram:
        h = h[:-w] * _B + (h[w:] ^ (h[w:] >> _C))
        h ^= h >> _C
        h *= _A
        w *= 2
    return h


def smallest_in(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest value of each run of width values, the first of equal ones."""
    at, w = np.arange(len(x), dtype=np.int32), 1
    while w < width:
        step = min(w, width - w)
        left, right = x[: len(x) - step], x[step:]
        later = right < left
        at = np.where(later, at[step:], at[: len(at) - step])
        x = np.where(later, right, left)
        w += step
    return at


def anchors(texts: list[bytes], least: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text number, first string, strings, place and hash of each anchor.

    Each string of `least` bytes has one anchor: of its grams the one with the smallest hash, the
    first of equal ones. So equal strings have equal anchors. The strings of an anchor are a run.
    """
    size = np.array([len(t) for t in texts], dtype=np.int64)
    long = np.flatnonzero(size >= least)
    if not len(long):
        return (*[np.empty(0, np.int64)] * 4, np.empty(0, np.uint64))
    size = size[long]
    data = np.frombuffer(b"".join([texts[i] for i in long.tolist()]), dtype=np.uint8)
    first = np.cumsum(size) - size
    h = gram_hashes(data, gram)
    at = smallest_in(h, least - gram + 1)
    # strings that run over the end of a text are none
    over = (first + size)[:-1, None] - np.arange(1, least)[None, :]
    at[over.ravel()] = -1
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.append(starts, len(at)))
    starts, count = starts[at[starts] >= 0], count[at[starts] >= 0]
    text = np.searchsorted(first, starts, side="right") - 1
    return long[text], starts - first[text], count, at[starts] - first[text], h[at[starts]]


def region_hashes(texts: list[bytes], text: np.ndarray, start: np.ndarray, size: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Hashes of the bytes that the strings of each anchor cover, and of where in them the anchor is."""
    digest = xxhash.xxh3_64_intdigest
    found = [digest(texts[t][a:b], s) for t, a, b, s in zip(text.tolist(), start.tolist(), (start + size).tolist(), (anchor - start).tolist(), strict=True)]
    return np.array(found, dtype=np.uint64)


def gram_hashes_of(data: np.ndarray, least: int) -> np.ndarray:
    """64-bit hashes of all strings of `least` bytes, for any least."""
    w = 1 << (least.bit_length() - 1)
    h = gram_hashes(data, w)
    return h[: len(data) - least + 1] * _B + h[least - w :] * _A if least > w else h


def suffix_order(data: np.ndarray, least: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffix array by the first `least` bytes at least, by prefix doubling from 8 bytes on; and the ranks of each length.

    A rank is the place of the first suffix with the same prefix, so that a suffix whose prefix
    no other has keeps its place and each doubling sorts the others only.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.lib.stride_tricks.sliding_window_view(padded, 8)[:n].copy().view(">u8").ravel().astype(np.uint64)
    order = np.argsort(key)
    rank, key, open_ = np.empty(n, dtype=np.int32), key[order], np.arange(n)
    w, kept = 8, []
    while True:
        new = np.ones(len(open_), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        heads = np.flatnonzero(new)
        rank = rank.copy()
        rank[order[open_]] = open_[heads][np.cumsum(new) - 1]
        kept.append((w, rank))
        alone = new.copy()
        alone[:-1] &= new[1:]
        open_ = open_[~alone]
        if w >= least or not len(open_):
            return order, kept
        suffix = order[open_]
        key = rank[suffix].astype(np.int64) * (n + 2)
        inside = suffix < n - w
        key[inside] += rank[suffix[inside] + w] + 1
        by = np.argsort(key)
        order[open_], key = suffix[by], key[by]
        w *= 2


def common_prefixes(a: np.ndarray, b: np.ndarray, kept: list[tuple[int, np.ndarray]], data: np.ndarray) -> np.ndarray:
    """Common prefixes of the suffixes a and b: whole lengths by rank, longest first, then bytes."""
    n, common = len(data), np.zeros(len(a), dtype=np.int64)
    a, b = a.copy(), b.copy()
    for w, rank in [*reversed(kept)]:
        inside = (a <= n - w) & (b <= n - w)
        same = inside.copy()
        same[inside] = rank[a[inside]] == rank[b[inside]]
        common += w * same
        a, b = a + w * same, b + w * same
    going = np.ones(len(a), dtype=bool)
    for k in range(7):
        going &= (a + k < n) & (b + k < n)
        going[going] = data[a[going] + k] == data[b[going] + k]
        common += going
    return common


def _smaller_before(value: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each place the common prefix with the nearest place before it whose value is smaller; 0 if none.

    common[i]: with the place just before. Pointer jumping: a place whose candidate is not
    smaller takes over the candidate's own candidate.
    """
    n = len(value)
    at = np.arange(-1, n - 1)
    reach = common.copy()
    open_ = np.flatnonzero(at >= 0)
    while len(open_):
        here = at[open_]
        open_ = open_[value[here] >= value[open_]]
        here = at[open_]
        reach[open_] = np.minimum(reach[open_], reach[here])
        at[open_] = at[here]
        open_ = open_[at[open_] >= 0]
    reach[at < 0] = 0
    return reach


def longest_previous_factor(data: np.ndarray, starts: np.ndarray, order_of: np.ndarray, least: int) -> np.ndarray:
    """For each of starts: the longest prefix of its suffix that also begins at a start of smaller order.

    The nearest starts of smaller order before and after it in suffix order have the longest one.
    Starts may share an order; they don't count for each other. A start may be given several times
    with different orders: bytes that stand in several places are sorted once. Lengths are exact
    up to the power of two from `least` on, and at least that beyond it.
    """
    if len(starts) < 2:
        return np.zeros(len(starts), dtype=np.int64)
    suffixes, kept = suffix_order(data, least)
    rank = np.empty(len(data), dtype=np.int64)
    rank[suffixes] = np.arange(len(data))
    at = np.argsort(rank[starts], kind="stable")
    suffixes = starts[at]
    common = len(data) - suffixes[1:]
    other = suffixes[:-1] != suffixes[1:]
    common[other] = common_prefixes(suffixes[:-1][other], suffixes[1:][other], kept, data)
    value = order_of[at]
    before = _smaller_before(value, np.concatenate([[0], common]))
    after = _smaller_before(value[::-1], np.concatenate([[0], common[::-1]]))[::-1]
    found = np.empty(len(starts), dtype=np.int64)
    found[at] = np.maximum(before, after)
    return found


def strings(size: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Place in the joined regions and region of each string of `least` bytes; size: bytes of the regions."""
    first = np.cumsum(size) - size
    count = size - least + 1
    region = np.repeat(np.arange(len(size)), count)
    return first[region] + np.arange(len(region)) - (np.cumsum(count) - count)[region], region


def strings_that_go(data: list[bytes], document: np.ndarray, start: np.ndarray, copied: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Region and offset in it of the strings that go: where the region stands first, and where its later copies stand.

    document and start: where a region stands first; document grows with the order of documents.
    A copied region has later copies. It is sorted once and its strings are given twice, the second
    time right behind the first place, so what goes there goes from every later copy.
    """
    size = np.array([len(x) for x in data], dtype=np.int64)
    place, region = strings(size, least)
    offset = place - (np.cumsum(size) - size)[region]
    order_of = (document[region] * np.int64(1 << 40) + start[region] + offset) * 2
    later = copied[region]
    factor = longest_previous_factor(
        np.frombuffer(b"".join(data), np.uint8), np.concatenate([place, place[later]]), np.concatenate([order_of, order_of[later] + 1]), least
    )
    first, again = np.split(factor >= least, [len(place)])
    return region[first], offset[first], region[later][again], offset[later][again]
