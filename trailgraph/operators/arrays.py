"""Graphs as arrays, which are broadcast up to a bound of arcs, and steps along arcs on whole rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Arcs up to which the graph is broadcast: at most 24 bytes each, and 12 a vertex, 120 MB and more.
BROADCAST_ARCS = 5_000_000


class Arrays:
    """A graph as arrays: ids in order, the arcs sorted by head, and where the arcs of each tail are among them."""

    def __init__(self, ids: np.ndarray, src: np.ndarray, dst: np.ndarray):
        self.ids = ids
        tail, head = np.searchsorted(ids, src), np.searchsorted(ids, dst)
        order = np.argsort(head, kind="stable")
        self.tail, self.head = tail[order].astype(np.int32), head[order].astype(np.int32)
        self.by_tail = np.argsort(self.tail, kind="stable").astype(np.int32)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(self.tail, minlength=len(ids)))])

    def followed(self, nodes: np.ndarray) -> np.ndarray:
        """The places of the arcs from nodes, in order, so by head. Only these arcs are looked at."""
        first, n = self.start[nodes], self.start[nodes + 1] - self.start[nodes]
        upto = np.cumsum(n)
        return np.sort(self.by_tail[np.repeat(first - upto + n, n) + np.arange(n.sum())])

    def levels(self, sources: np.ndarray, max_depth: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(level, vertices by place, bits) with a row per vertex; bit k of a row: source k meets it first at this level.

        Level 0 is the sources. Only the arcs of vertices that were met anew are followed.
        """
        at, k = np.searchsorted(self.ids, sources), np.arange(len(sources))
        seen = np.zeros((len(self.ids), -(-len(sources) // 64)), np.uint64)
        np.bitwise_or.at(seen, (at, k // 64), np.uint64(1) << (k % 64).astype(np.uint64))
        nodes, depth = np.unique(at), 0
        bits, row = seen[nodes], np.zeros(len(self.ids), np.int32)
        while len(nodes):
            yield depth, nodes, bits
            if depth == max_depth:
                return
            depth += 1
            arcs = self.followed(nodes)
            if not len(arcs):
                return
            row[nodes] = np.arange(len(nodes))
            ahead, heads = row[self.tail[arcs]], self.head[arcs]
            nodes, bits = combined(heads, ahead, bits, np.bitwise_or)
            was = seen.take(nodes, axis=0)
            bits &= ~was
            fresh = np.flatnonzero(np.bitwise_or.reduce(bits, axis=1))
            if len(fresh) < len(nodes):
                nodes, bits, was = nodes[fresh], bits.take(fresh, axis=0), was.take(fresh, axis=0)
            was |= bits
            seen[nodes] = was

    def counts(self, sources: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, Callable]]:
        """(level, vertices by place, how many sources meet each first at this level, met) as levels has them, without a copy of all bits.

        met(vertices, k) says for pairs whether source k meets a vertex first at this level. Vertices are taken ROWS_AT_ONCE at once, so
        that what is made of their rows stays in the cache; a level's bits go into one of two tables that serve all levels.
        """
        at, k, n = np.searchsorted(self.ids, sources), np.arange(len(sources)), len(self.ids)
        words = -(-len(sources) // 64)
        first = np.concatenate([[0], np.cumsum(np.bincount(self.head, minlength=n))])
        seen, row = np.zeros((n, words), np.uint64), np.zeros(n, np.int32)
        # Row 0 of a table is empty: it stands for the vertices that met nothing anew.
        now, new = np.zeros((n + 1, words), np.uint64), np.zeros((n + 1, words), np.uint64)
        np.bitwise_or.at(seen, (at, k // 64), np.uint64(1) << (k % 64).astype(np.uint64))
        whole = seen.view(f"V{8 * words}")[:, 0]  # a row as one value, which is written much faster than as words
        nodes, depth = np.unique(at), 0
        now[1 : len(nodes) + 1] = seen[nodes]
        row[nodes] = np.arange(1, len(nodes) + 1)
        n_of = counted(now[1 : len(nodes) + 1])
        some, more = (np.empty((ROWS_AT_ONCE, words), np.uint64) for _ in range(2))
        while len(nodes):
            yield depth, nodes, n_of, lambda v, k, bits=now: (bits[row[v], k // 64] >> (k % 64).astype(np.uint64)) & np.uint64(1) == 1
            depth += 1
            heads = self._heads(nodes, row)
            heads = heads[np.argsort(-np.minimum(first[heads + 1] - first[heads], ONE_BY_ONE + 1).astype(np.int8), kind="stable")]
            found, found_n, end = [], [], 1
            for i in range(0, len(heads), ROWS_AT_ONCE):
                h = heads[i : i + ROWS_AT_ONCE]
                begin, ins = first[h], first[h + 1] - first[h]
                bits, other = some[: len(h)], more[: len(h)]
                now.take(row[self.tail[begin]], axis=0, out=bits, mode="clip")
                for j in range(1, min(ONE_BY_ONE, ins.max())):
                    m = np.searchsorted(-np.minimum(ins, ONE_BY_ONE + 1), -j)
                    now.take(row[self.tail[begin[:m] + j]], axis=0, out=other[:m], mode="clip")
                    bits[:m] |= other[:m]
                for j in np.flatnonzero(ins > ONE_BY_ONE):
                    for a in range(begin[j] + ONE_BY_ONE, begin[j] + ins[j], 65536):
                        bits[j] |= np.bitwise_or.reduce(now[row[self.tail[a : min(a + 65536, begin[j] + ins[j])]]], axis=0)
                seen.take(h, axis=0, out=other, mode="clip")
                bits |= other
                other ^= bits
                whole[h] = bits.view(whole.dtype)[:, 0]
                c = counted(other)
                fresh = np.flatnonzero(c)
                other.take(fresh, axis=0, out=new[end : end + len(fresh)], mode="clip")
                end += len(fresh)
                found.append(h[fresh])
                found_n.append(c[fresh])
            row[nodes] = 0
            if end == 1:
                return
            nodes, n_of = np.concatenate(found), np.concatenate(found_n)
            row[nodes] = np.arange(1, end)
            now, new = new, now

    def _heads(self, nodes: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The different heads of the arcs from nodes, in order; row is above 0 for these nodes only."""
        heads = self.head[self.followed(nodes)] if 8 * len(nodes) < len(self.ids) else self.head[row[self.tail] > 0]
        return heads[np.concatenate([[True], heads[1:] != heads[:-1]])] if len(heads) else heads


def counted(bits: np.ndarray) -> np.ndarray:
    """The number of bits of each row; exact, as a row has fewer than 2^24."""
    return (np.bitwise_count(bits).astype(np.float32) @ np.ones(bits.shape[1], np.float32)).astype(np.int64)


#: Vertices whose rows are made at once.
ROWS_AT_ONCE = 4096
#: Arcs of a head that are combined one after the other; those of a head with more are reduced at once.
ONE_BY_ONE = 16


def combined(heads: np.ndarray, ahead: np.ndarray, rows: np.ndarray, how: np.ufunc) -> tuple[np.ndarray, np.ndarray]:
    """The different heads, those of many arcs first, and for each the rows (numbers in ahead) of its arcs combined by `how`.

    heads are in order. The k-th arcs of all heads are combined at once, so the work is on whole rows and a head costs no call.
    """
    first = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]]))
    n = np.diff(first, append=len(heads))
    order = np.argsort(-np.minimum(n, ONE_BY_ONE + 1).astype(np.int8), kind="stable")
    first, n = first[order], n[order]
    out = rows.take(ahead[first], axis=0)
    for k in range(1, ONE_BY_ONE):
        many = np.searchsorted(-np.minimum(n, ONE_BY_ONE + 1), -k)
        if not many:
            break
        how(out[:many], rows.take(ahead[first[:many] + k], axis=0), out=out[:many])
    for j in np.flatnonzero(n > ONE_BY_ONE):
        for at in range(first[j] + ONE_BY_ONE, first[j] + n[j], 65536):
            how(out[j], how.reduce(rows[ahead[at : min(at + 65536, first[j] + n[j])]], axis=0), out=out[j])
    return heads[first], out
