"""Deep-shallow sorting of suffixes that need ordering to a bounded depth.

Shallow: a multikey quicksort with three-way partitions, whose characters are machine
words of eight bytes, down to ``SHALLOW`` bytes. Deep: what still shares so long a
prefix goes into a blind trie, which branches on single bytes only and meets the text
once for each suffix.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 24


def _words(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes at ``depth`` of each suffix as one big-endian number; ``text`` must be padded by eight bytes."""
    return np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))[starts + depth].astype(np.uint64)


def shallow(text: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the suffixes by their first ``depth`` bytes (a multiple of eight), and where each run of equals begins.

    All segments that are still open are split at once, each at its own pivot, into what is smaller,
    equal and larger; equals go on with their next word. The pivot is the median of three places that
    change from round to round, so that no given order of the input is a bad one.
    """
    n = len(starts)
    order, begins = np.arange(n), np.zeros(n, bool)
    begins[:1] = True
    word = _words(text, starts, 0) if depth and n else np.zeros(n, np.uint64)
    low, high, at_word = np.array([0]), np.array([n]), np.array([0])
    turn = 0
    while True:
        still = (high - low > 1) & (8 * at_word < depth)
        low, high, at_word = low[still], high[still], at_word[still]
        if not len(low):
            return order, np.flatnonzero(begins)
        size = high - low
        first = np.cumsum(size) - size
        place = np.repeat(low - first, size) + np.arange(size.sum())
        x, y, z = (word[low + (turn * 7919 + i * size // 3) % size] for i in range(3))
        pivot = np.repeat(np.maximum(np.minimum(x, y), np.minimum(np.maximum(x, y), z)), size)
        own, before = word[place], order[place]
        less, more = own < pivot, own > pivot
        n_less, n_more = (np.add.reduceat(c, first, dtype=np.int64) for c in (less, more))
        n_equal = size - n_less - n_more
        for kind, count, begin in ((less, n_less, low), (~(less | more), n_equal, low + n_less), (more, n_more, high - n_more)):
            which = np.flatnonzero(kind)
            to = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(len(which))
            order[to], word[to] = before[which], own[which]
        equal, larger = low + n_less, high - n_more
        begins[equal] = True
        begins[larger[n_more > 0]] = True
        # the equals' next words
        deeper = (larger - equal > 1) & (8 * (at_word + 1) < depth)
        count = (larger - equal)[deeper]
        here = np.repeat(equal[deeper] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        word[here] = _words(text, starts[order[here]] + 8 * np.repeat(at_word[deeper] + 1, count), 0)
        low, high, at_word = np.concatenate([low, equal, larger]), np.concatenate([equal, larger, high]), np.concatenate([at_word, at_word + 1, at_word])
        turn += 1


class BlindTrie:
    """Strings of one long common prefix; equal strings share a leaf. ``leaves()`` lists ``(string, members)`` in order."""

    def __init__(self):
        self.root: list | None = None

    def add(self, string: bytes, member: int) -> None:
        if self.root is None:
            self.root = [-1, string, [member]]
            return
        # blind descent: branch bytes only, any child where the byte is missing
        node, size = self.root, len(string)
        while node[0] >= 0:
            kids = node[1]
            c = string[node[0]] if node[0] < size else -1
            node = kids[c] if c in kids else next(iter(kids.values()))
        other = node[1]
        if other == string:
            node[2].append(member)
            return
        # one comparison with the leaf finds where the strings part
        low, high = 0, min(size, len(other))
        while low < high:
            mid = (low + high + 1) // 2
            if string[:mid] == other[:mid]:
                low = mid
            else:
                high = mid - 1
        own, theirs = (string[low] if low < size else -1), (other[low] if low < len(other) else -1)
        above, node = None, self.root
        while node[0] >= 0 and node[0] < low:
            above, c = node, (string[node[0]] if node[0] < size else -1)
            node = node[1][c]
        leaf = [-1, string, [member]]
        if node[0] == low:
            node[1][own] = leaf
            return
        branch = [low, {theirs: node, own: leaf}]
        if above is None:
            self.root = branch
        else:
            above[1][string[above[0]] if above[0] < size else -1] = branch

    def leaves(self) -> list[tuple[bytes, list[int]]]:
        out, todo = [], [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if node[0] < 0:
                out.append((node[1], node[2]))
            else:
                todo += [node[1][c] for c in sorted(node[1], reverse=True)]
        return out


def deep_shallow(text: bytes, starts: np.ndarray, lengths: np.ndarray | int, depth: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """``(order, group)``: the suffixes in order, each cut to its length, and the number of its run of equals."""
    n = len(starts)
    if not n:
        return np.arange(0), np.arange(0)
    lengths = np.broadcast_to(np.asarray(lengths, np.int64), (n,))
    depth = min(depth, int(lengths.min()) // 8 * 8)
    padded = np.frombuffer(text + bytes(8), np.uint8)
    order, begins = shallow(padded, starts, depth)
    ends = np.append(begins[1:], n)
    group, last = np.zeros(n, np.int64), 0
    alone = ends - begins == 1
    out = order.copy()
    at, end = (starts + depth).tolist(), (starts + lengths).tolist()
    fresh = np.zeros(n, bool)
    fresh[begins] = True
    for b, e in zip(begins[~alone].tolist(), ends[~alone].tolist(), strict=True):
        first, *rest = order[b:e].tolist()
        trie, string, same = BlindTrie(), text[at[first] : end[first]], [first]
        for i in rest:
            other = text[at[i] : end[i]]
            if trie.root is None and other == string:
                same.append(i)  # the trie is still one leaf
                continue
            if trie.root is None:
                trie.root = [-1, string, same]
            trie.add(other, i)
        for _, members in trie.leaves() if trie.root else [(string, same)]:
            out[b : b + len(members)] = members
            fresh[b] = True
            b += len(members)
    group = np.cumsum(fresh) - 1 + last
    return out, group
