"""A compressed full-text index: suffix array order, its BWT in a wavelet tree, and vectorised backward search."""

from __future__ import annotations

import numpy as np


def suffix_order(s: np.ndarray) -> np.ndarray:
    """The suffix array of the codes ``s`` (0 .. 2**21), by doubling of packed ranks.

    Only suffixes that are not yet told apart are sorted again.
    """
    n = len(s)
    width = max(1, int(s.max(initial=0)).bit_length())
    take = max(1, 62 // width)
    key = np.zeros(n, np.int64)
    for i in range(take):
        key <<= width
        if i < n:
            key[: n - i] |= s[i:]
    # Suffixes that end inside the packed codes differ from those going on with 0 by their length.
    order = np.argsort(key, kind="stable")
    if take > 1:
        ends = np.arange(max(0, n - take + 1), n)
        if len(ends):
            short = np.lexsort((np.where(order >= n - take + 1, n - order, n), key[order]))
            order = order[short]
    sorted_key = key[order]
    new = np.empty(n, bool)
    new[:1] = True
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    new[1:] |= (order[1:] > n - take) | (order[:-1] > n - take)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = take
    while True:
        edge = np.append(new, True)
        tied = np.flatnonzero(~(edge[:-1] & edge[1:]))
        if not len(tied):
            return order
        rows = order[tied]
        nxt = np.zeros(len(rows), np.int64)
        inside = rows + h < n
        nxt[inside] = rank[rows[inside] + h] + 1
        pair = rank[rows] * np.int64(n + 1) + nxt
        again = np.argsort(pair, kind="stable")
        rows, pair = rows[again], pair[again]
        order[tied] = rows
        fresh = np.empty(len(rows), bool)
        fresh[0] = True
        fresh[1:] = pair[1:] != pair[:-1]
        new[tied] |= fresh
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[rows] = start[tied]
        h *= 2


class WaveletTree:
    """Ranks of symbols in a sequence, level by level as bit vectors with counts for each 64-bit word."""

    def __init__(self, codes: np.ndarray, width: int):
        self.width, self.n = width, len(codes)
        self.bits, self.counts, self.zeros = [], [], []
        cur = codes
        for level in range(width - 1, -1, -1):
            bit = (cur >> level) & 1
            padded = np.zeros((self.n // 64 + 2) * 64, np.uint8)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            count = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=count[1:])
            self.bits.append(words), self.counts.append(count.astype(np.int32)), self.zeros.append(int(self.n - count[-1]))
            ones = bit.astype(bool)
            cur = np.concatenate([cur[~ones], cur[ones]])

    def rank(self, codes: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """For each (code, i): how often the code stands before position i, plus where its run begins in the last level."""
        at = upto
        for level in range(self.width):
            words, counts = self.bits[level], self.counts[level]
            word = at >> 6
            low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = counts[word] + np.bitwise_count(words[word] & low)
            bit = (codes >> (self.width - 1 - level)) & 1
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return at


class FMIndex:
    """Counts pieces of text by backward search; knows of any row range whether it holds two different owners.

    Texts are joined with code 0 between them. The last level of the wavelet matrix orders rows by their codes' bits, so a
    rank there less the rank at 0 is the number of occurrences.
    """

    def __init__(self, texts: list[np.ndarray], owner: np.ndarray, many: np.ndarray):
        letters = np.unique(np.concatenate(texts)) if texts else np.zeros(0, np.uint32)
        self.letters = letters
        self.parts = [(np.searchsorted(letters, t) + 1).astype(np.int32) for t in texts]
        sep = np.zeros(1, np.int32)
        joined = np.concatenate([x for p in self.parts for x in (p, sep)])
        order = suffix_order(joined)
        last = joined[order - 1]
        width = max(1, int(len(letters)).bit_length())
        self.tree = WaveletTree(last, width)
        count = np.bincount(joined, minlength=len(letters) + 1)
        self.before = np.concatenate([[0], np.cumsum(count)])
        self.base = self.tree.rank(np.arange(len(letters) + 1), np.zeros(len(letters) + 1, np.int64))
        lengths = np.array([len(p) + 1 for p in self.parts])
        text_of = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[order]
        change = np.zeros(len(order) + 1, np.int32)  # rows are fewer than 2**31
        change[2:] = np.cumsum(owner[text_of][1:] != owner[text_of][:-1])
        self.change = change
        self.many = np.zeros(len(order) + 1, np.int32)
        self.many[1:] = np.cumsum(many[text_of])
        self.size = len(order)

    def shared(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether rows [lo, hi) belong to two owners or to a text that stands for several."""
        some = hi > lo
        a, b = np.where(some, lo, 0), np.where(some, hi, 1)
        return some & ((self.change[b] > self.change[a + 1]) | (self.many[b] > self.many[a]))

    def extend(self, codes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of code + piece, for the rows of each piece."""
        both = self.tree.rank(np.concatenate([codes, codes]), np.concatenate([lo, hi]))
        at = self.before[codes] - self.base[codes]
        n = len(codes)
        return both[:n] + at, both[n:] + at


def shared_ranges(index: FMIndex, least: int, chunk: int = 600) -> list[np.ndarray]:
    """For each text of the index the [start, end) ranges, in order, that spans of at least ``least`` codes shared with another owner cover.

    Matching statistics by backward search: a scan begins at an end and steps left while the range of rows still has two
    owners. A window of ``least`` codes is scanned first: where that fails, no window reaching from before that point
    beyond its end can be shared, so the next begins there. A window that matches is carried on to the right by whole
    windows, then by halved steps: every shared window that overlaps or touches the range so far adds to it. The
    search goes on from the first window that ends beyond the range, so halving loses nothing.

    Texts are searched in chunks of ``chunk`` windows. All chunks step at once, each in its own scan.
    """
    parts = index.parts
    size = np.array([len(p) for p in parts], np.int64)
    text = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else np.zeros(0, np.int64)
    pieces = np.maximum(0, -(-(size - least + 1) // chunk))
    who = np.repeat(np.arange(len(size)), pieces)
    nth = np.arange(len(who)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    j = nth * chunk  # first window not yet decided
    until = np.minimum(size[who], j + chunk + least - 1)  # this chunk's text ends here
    offset = begin[who]
    good = np.full(len(who), -1)  # end of the range being carried on, or -1
    opened = j.copy()  # its start
    step = np.full(len(who), least)
    end, stop = j + least, j.copy()
    pos = end.copy()
    lo, hi = np.zeros(len(who), np.int64), np.full(len(who), index.size, np.int64)
    live = np.arange(len(who))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(live):
        a, b = index.extend(text[offset[live] + pos[live] - 1], lo[live], hi[live])
        ok = index.shared(a, b)
        lo[live], hi[live] = a, b
        pos[live] -= ok
        full = pos[live] == stop[live]
        done = live[~ok | full]
        if not len(done):
            continue
        hit = pos[done] == stop[done]
        first, more = done[(good[done] < 0) & hit], done[good[done] >= 0]
        missed = done[(good[done] < 0) & ~hit]
        j[missed] = pos[missed]
        opened[first], good[first], step[first] = j[first], end[first], least
        went = pos[more] == stop[more]
        good[more[went]] = end[more[went]]
        halve = more[~(went & (step[more] == least))]
        step[halve] //= 2
        carried = np.concatenate([first, more])
        over = (good[carried] >= until[carried]) | (step[carried] == 0)
        closed = carried[over]
        found.append((who[closed], opened[closed], good[closed]))
        j[closed] = good[closed] - least + 1
        good[closed] = -1
        carried = carried[~over]
        end[carried] = np.minimum(good[carried] + step[carried], until[carried])
        stop[carried] = end[carried] - least
        fresh = np.concatenate([missed, closed])
        end[fresh], stop[fresh] = j[fresh] + least, j[fresh]
        pos[done], lo[done], hi[done] = end[done], 0, index.size
        gone = np.zeros(len(who), bool)
        gone[fresh] = end[fresh] > until[fresh]
        live = live[~gone[live]]
    out: list[list] = [[] for _ in parts]
    w, a, b = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((a, w))
    for x, s, e in zip(w[order].tolist(), a[order].tolist(), b[order].tolist()):
        if out[x] and s <= out[x][-1][1]:
            out[x][-1][1] = max(out[x][-1][1], e)
        else:
            out[x].append([s, e])
    return [np.array(x, np.int64).reshape(-1, 2) for x in out]
