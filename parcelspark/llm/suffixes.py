"""Deep-shallow sorting of suffixes of bounded depth."""

from __future__ import annotations

import numpy as np

#: Bytes by which the multikey quicksort tells suffixes apart.
SHALLOW = 32


class BlindTrie:
    """A trie of branching depths alone: bytes between branchings are not looked at.

    A suffix goes down by its bytes at the branching depths, is compared with
    the one suffix it arrives at, and is hung where the two part.
    """

    __slots__ = ("depth", "root", "texts")

    def __init__(self, texts: list[bytes]):
        self.texts, self.depth = texts, len(texts[0])
        self.root = 0  # a leaf is a suffix's number; a branching is [depth, {byte: below}]

    def insert(self, i: int) -> list | None:
        """Hang suffix ``i``; an equal one's leaf becomes a list of both."""
        text, node, path = self.texts[i], self.root, []
        while isinstance(node, list) and node[0] < self.depth:
            path.append(node)
            below = node[1].get(text[node[0]])
            node = below if below is not None else next(iter(node[1].values()))
        leaf = node if isinstance(node, int) else node[1][0]
        differ = int.from_bytes(text, "big") ^ int.from_bytes(self.texts[leaf], "big")
        at = self.depth - (differ.bit_length() + 7) // 8
        up = None
        node = self.root
        for step in path:
            if step[0] > at:
                break
            up, node = step, step[1].get(text[step[0]])
            if node is None:
                step[1][text[at]] = i
                return
        if at == self.depth:
            new = [self.depth, [*(node[1] if isinstance(node, list) else [node]), i]]
        else:
            new = [at, {text[at]: i, self.texts[leaf][at]: node}]
        if up is None:
            self.root = new
        else:
            up[1][text[up[0]]] = new

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, int):
                out.append(node)
            elif node[0] == self.depth:
                out.extend(node[1])
            else:
                stack.extend(below for _, below in sorted(node[1].items(), reverse=True))
        return out


def blind_order(texts: list[bytes]) -> list[int]:
    trie = BlindTrie(texts)
    for i in range(1, len(texts)):
        trie.insert(i)
    return trie.order()


def multikey_quicksort(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows of a matrix by their first ``depth`` columns, the places still tied in it, and where each tie begins.

    Ternary partitioning: a segment is split about a pivot, the median of three of
    its keys; the part of equal keys goes on with the next column, the others with
    the same. All open segments are split in one step, so that the steps are as
    many as the deepest recursion.
    """
    n = len(words)
    order, start, column = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    open_ = np.arange(n) if n > 1 and depth else np.zeros(0, np.int64)  # places of segments of two or more
    while len(open_):
        segment = start[open_]
        first = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
        size = np.diff(np.append(first, len(open_)))
        key = words[order[open_], column[open_]]
        a, b, c = key[first], key[first + size // 2], key[first + size - 1]
        pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), size)
        base = np.repeat(first, size)
        to, side = np.empty(len(open_), np.int64), np.empty(len(open_), np.int8)
        for n_side, mask in enumerate((key < pivot, key == pivot, key > pivot)):
            before = np.cumsum(mask) - mask
            rank = before - np.repeat(before[first], size)
            to[mask], side[mask] = (base + rank)[mask], n_side
            base = base + np.repeat(np.add.reduceat(mask.astype(np.int64), first), size)
        moved = np.empty(len(open_), np.int64)
        moved[to] = order[open_]
        order[open_] = moved
        moved[to] = side
        new = np.append(True, (segment[1:] != segment[:-1]) | (moved[1:] != moved[:-1]))
        start[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
        column[open_] += moved == 1
        alone = new & np.append(new[1:], True)
        open_ = open_[~alone & (column[open_] < depth)]
    tied = np.append(start[1:] == start[:-1], False)
    tied[1:] |= tied[:-1]
    if not depth:
        tied[:] = n > 1
    return order, np.flatnonzero(tied), start


def sort_suffixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a byte matrix, and each one's common prefix with the one before (0 for the first).

    A multikey quicksort over 8 bytes at a time leaves, at depth SHALLOW, groups
    with long common prefixes; a blind trie orders each.
    """
    n, width = rows.shape
    if not width:
        return np.arange(n), np.zeros(n, np.int64)
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8").astype(np.uint64)
    order, open_, group = multikey_quicksort(words, min(SHALLOW // 8, words.shape[1]))
    if len(open_):
        tied = group[open_]
        edges = np.append(np.flatnonzero(np.append(True, tied[1:] != tied[:-1])), len(open_))
        for a, b in zip(edges, edges[1:], strict=False):
            at = open_[a:b]
            members = order[at]
            order[at] = members[blind_order([rows[i].tobytes() for i in members])]
    common = np.zeros(n, np.int64)
    for a in range(1, n, 1 << 16):
        b = min(n, a + (1 << 16))
        differ = rows[order[a:b]] != rows[order[a - 1 : b - 1]]
        common[a:b] = np.where(differ.any(1), differ.argmax(1), width)
    return order, common


def class_depths(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's rank, and common prefixes in rank order: rows share d bytes if no smaller value lies between."""
    order, common = sort_suffixes(rows)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank, common
