"""Byte-pair merging on a heap over a doubly linked list of symbols."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

#: A worker remembers results of at most this many strings; further ones are worked out each time.
REMEMBERED = 3 << 17
#: Longer strings aren't remembered, so that the memory has a bound in bytes too.
REMEMBERED_CHARS = 64


def merge_symbols(ids: list[int], ranks: dict[int, int], merged: list[int]) -> int:
    """Merges the pair of lowest rank, the leftmost of equals, until none is left; returns the
    number of merges. `ids` is changed in place: a symbol eaten by its left neighbour becomes -1.

    ranks: rank by (left id << 16 | right id); merged: the new id by rank. A heap entry is rank and
    place in one integer; it is stale, and skipped, when the pair at its place has another rank now.
    """
    n = len(ids)
    if n < 2:
        return 0
    rank_of = ranks.get
    rank_at = [rank_of(a << 16 | b, -1) for a, b in zip(ids, ids[1:])]
    rank_at.append(-1)
    shift = n.bit_length()
    places = (1 << shift) - 1
    heap = [r << shift | i for i, r in enumerate(rank_at) if r >= 0]
    heapify(heap)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    done = 0
    while heap:
        entry = heappop(heap)
        rank, i = entry >> shift, entry & places
        if rank_at[i] != rank:
            continue
        new = merged[rank]
        j = after[i]
        k = after[i] = after[j]
        ids[i], ids[j], rank_at[j] = new, -1, -1
        done += 1
        rank_at[i] = -1
        if k < n:
            before[k] = i
            rank = rank_of(new << 16 | ids[k])
            if rank is not None:
                rank_at[i] = rank
                heappush(heap, rank << shift | i)
        h = before[i]
        if h >= 0:
            rank = rank_at[h] = rank_of(ids[h] << 16 | new, -1)
            if rank >= 0:
                heappush(heap, rank << shift | h)
    return done


class Remembered(dict):
    """A dict that works out missing values, and keeps them while there is room."""

    def __init__(self, work_out, room: int = REMEMBERED):
        super().__init__()
        self.work_out = work_out
        self.room = room

    def __missing__(self, key: str):
        value = self.work_out(key)
        if len(self) < self.room and len(key) <= REMEMBERED_CHARS:
            self[key] = value
        return value
