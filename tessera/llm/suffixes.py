"""Suffix arrays of byte strings in numpy, refined by doubling as Larsson and Sadakane do, and common prefixes in Kasai's order."""

from __future__ import annotations

import numpy as np


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as a big-endian number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(data)]
    return out


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of the suffixes' first `depth` bytes at least, and the rank of each place.

    Ranks start from 8 bytes. Each round doubles the bytes that are compared, by the ranks h places on, and touches only the groups that are not
    sorted yet; a group's rank is the place of its first suffix in the array.
    """
    n = len(data)
    key = words_at(data)
    array = np.argsort(key, kind="stable")
    rank = np.zeros(n + 1, np.int64)  # the last is of the empty suffix

    def ranked(sorted_keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The group start of each suffix, and whether it is alone."""
        new = np.ones(len(sorted_keys), bool)
        new[1:] = sorted_keys[1:] != sorted_keys[:-1]
        start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        alone = new.copy()
        alone[:-1] &= new[1:]
        return places[start], alone

    slots = np.arange(n)
    start, alone = ranked(key[array], slots)
    rank[array] = start + 1
    slots = slots[~alone]
    h = 8
    while h < depth and len(slots):
        some = array[slots]
        key = (rank[some].astype(np.uint64) << np.uint64(32)) | rank[np.minimum(some + h, n)].astype(np.uint64)
        order = np.argsort(key)
        some, key = some[order], key[order]
        array[slots] = some
        start, alone = ranked(key, slots)
        rank[some] = start + 1
        slots = slots[~alone]
        h *= 2
    place = np.empty(n, np.int64)
    place[array] = np.arange(n)
    return array, place


def common_prefixes(data: np.ndarray, array: np.ndarray, place: np.ndarray, most: int) -> np.ndarray:
    """For each slot of the array the bytes, up to `most`, that its suffix shares with the one before (0 for the first).

    Kasai's order: from one place of the text to the next a common prefix shrinks by one at most. The text is cut into lanes that run side by
    side; a lane starts without a known prefix. So does a place after a prefix of `most` bytes: suffixes that agree as far as the array is sorted are in no
    certain order, and then the places after them needn't be neighbours either.
    """
    n = len(data)
    lanes = int(max(1, min(16384, n // 64)))
    length = -(-n // lanes)
    word = words_at(data)
    before = np.where(place > 0, array[np.maximum(place - 1, 0)], -1)  # by place of the text
    out = np.zeros(n, np.int64)
    start = np.arange(lanes) * length
    known = np.zeros(lanes, np.int64)
    for step in range(length):
        i = start + step
        live = i < n
        i = np.minimum(i, n - 1)
        j = before[i]
        live &= j >= 0
        known[~live] = 0
        at = np.flatnonzero(live & (known < most))
        while len(at):
            a, b, k = i[at], j[at], known[at]
            inside = (a + k < n) & (b + k < n)
            differ = np.where(inside, word[np.minimum(a + k, n - 1)] ^ word[np.minimum(b + k, n - 1)], np.uint64(1 << 63))
            equal = differ == 0
            top = np.frexp(differ.astype(np.float64))[1]  # bits; rounding up to a power of two only where all bits below are ones
            high = np.minimum(np.where(equal, 0, top), 64)
            over = (high > 0) & ((differ >> np.minimum(np.maximum(high - 1, 0), 63).astype(np.uint64)) == 0)
            high = high - over
            known[at] = np.minimum(k + np.where(equal, 8, (64 - high) // 8), np.minimum(most, n - np.maximum(a, b)))
            at = at[equal & (known[at] < most) & (known[at] < n - np.maximum(a, b))]
        out[i[live]] = known[live]
        known = np.where(known < most, np.maximum(known - 1, 0), 0)
    return out[array]
