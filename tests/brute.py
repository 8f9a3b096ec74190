"""Plain computations to hold results against."""

from collections import defaultdict, deque


def distances(arcs, sources):
    """(src, node) -> hops, the source left out."""
    ahead = defaultdict(set)
    for a, b in arcs:
        ahead[a].add(b)
    out = {}
    for s in sources:
        seen, queue = {s: 0}, deque([s])
        while queue:
            v = queue.popleft()
            for u in ahead[v]:
                if u not in seen:
                    seen[u] = seen[v] + 1
                    queue.append(u)
        out |= {(s, v): d for v, d in seen.items() if v != s}
    return out


def walks(arcs, s, t):
    ahead = defaultdict(set)
    for a, b in arcs:
        ahead[a].add(b)
    out, stack = set(), [(s,)]
    while stack:
        path = stack.pop()
        if path[-1] == t:
            out.add(path)
            continue
        stack += [(*path, u) for u in ahead[path[-1]] if u not in path]
    return out


def numbering(arcs, s):
    num, order = {s: 1}, [s]
    for v in order:
        for u in sorted({b for a, b in arcs if a == v}):
            if u not in num:
                num[u] = len(num) + 1
                order.append(u)
    return num
