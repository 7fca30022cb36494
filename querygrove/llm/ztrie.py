"""A z-fast trie over paths of digests, as one task holds it.

The symbol at depth d of a path is the digest of its first d turns, so two
paths agree up to d exactly where their digests at d are equal.  Only branching
nodes and ends are nodes; each stands for the depths (low, high] of its edge.
The hash table names a node by its handle: the digest at the two-fattest number
of (low, high], the one that the greatest power of two divides.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

WIDE = 16  # bytes of a digest


def two_fattest(a: int, b: int) -> int:
    """The number in (a, b] that the greatest power of two divides."""
    return b & (-1 << ((a ^ b).bit_length() - 1))


@dataclass(slots=True)
class Path:
    """Digests of the depths start, start + 1, ... end, and a number for each depth after the first."""
    start: int
    raw: bytes
    sizes: list[int]
    passing: list[int] = field(default_factory=list)  # conversations that go on below
    ending: list[int] = field(default_factory=list)

    @property
    def end(self) -> int:
        return self.start + len(self.raw) // WIDE - 1

    def key(self, depth: int) -> bytes:
        at = (depth - self.start) * WIDE
        return self.raw[at:at + WIDE]


@dataclass(slots=True, eq=False)
class Node:
    low: int
    raw: bytes           # digests of low + 1 ... high; a root has its own digest in ``last``
    sizes: list[int]
    parent: "Node | None"
    last: bytes
    kids: dict = field(default_factory=dict)
    passing: list[int] = field(default_factory=list)
    ending: list[int] = field(default_factory=list)

    @property
    def high(self) -> int:
        return self.low + len(self.raw) // WIDE

    def key(self, depth: int) -> bytes:
        at = (depth - self.low - 1) * WIDE
        return self.raw[at:at + WIDE]

    def handle(self) -> bytes:
        return self.key(two_fattest(self.low, self.high))


class ZFastTrie:
    def __init__(self) -> None:
        self.roots: dict[bytes, Node] = {}
        self.handles: dict[bytes, Node] = {}
        self.held = 0  # depths of all edges

    def root(self, path: Path) -> Node:
        key = path.key(path.start)
        if key not in self.roots:
            self.roots[key] = Node(path.start, b"", [], None, key)
        return self.roots[key]

    def locate(self, path: Path, top: Node) -> tuple[Node, Node | None, int]:
        """Fat binary search below ``top``, which the path goes through.

        The deepest node that the path passes whole, the node whose edge it leaves or ends in (None if there is
        none), and the depth up to which they agree.
        """
        a, b = top.high, path.end
        while a < b:
            f = two_fattest(a, b)
            node = self.handles.get(path.key(f))
            if node is None:
                b = f - 1
            elif node.high <= path.end and path.key(node.high) == node.last:
                top, a = node, node.high
            else:
                return node.parent, node, self._agreement(node, path, f)
        child = top.kids.get(path.key(top.high + 1)) if top.high < path.end else None
        return top, child, self._agreement(child, path, child.low + 1) if child else top.high

    @staticmethod
    def _agreement(node: Node, path: Path, known: int) -> int:
        low, high = known, min(node.high, path.end)
        while low < high:
            middle = (low + high + 1) // 2
            if node.key(middle) == path.key(middle):
                low = middle
            else:
                high = middle - 1
        return low

    def _split(self, node: Node, depth: int) -> Node:
        """Cuts the edge of ``node`` at ``depth``; the new upper node."""
        cut = (depth - node.low) * WIDE
        upper = Node(node.low, node.raw[:cut], node.sizes[:depth - node.low], node.parent, node.raw[cut - WIDE:cut])
        del self.handles[node.handle()]
        node.parent.kids[node.raw[:WIDE]] = upper
        node.low, node.raw, node.sizes, node.parent = depth, node.raw[cut:], node.sizes[depth - node.low:], upper
        upper.kids[node.raw[:WIDE]] = node
        self.handles[upper.handle()] = upper
        self.handles[node.handle()] = node
        return upper

    def _insert(self, path: Path, top: Node) -> None:
        while True:
            top, node, depth = self.locate(path, top)
            if node is not None and depth < node.high:
                top = self._split(node, depth)
                break
            if node is None:
                break
            top = node
        if depth < path.end:
            leaf = Node(depth, path.raw[(depth + 1 - path.start) * WIDE:], path.sizes[depth - path.start:], top,
                        path.key(path.end))
            top.kids[leaf.raw[:WIDE]] = leaf
            self.handles[leaf.handle()] = leaf
            self.held += leaf.high - leaf.low
            top = leaf
        top.passing += path.passing
        top.ending += path.ending

    def insert_batch(self, paths: list[Path]) -> None:
        """Equal paths become one; all exits are located first, then each insertion goes on from its own."""
        distinct: dict[tuple[bytes, int, int], Path] = {}
        for path in paths:
            same = distinct.setdefault((path.key(path.end), path.start, path.end), path)
            if same is not path:
                same.passing += path.passing
                same.ending += path.ending
        exits = [(path, self.locate(path, self.root(path))[0]) for path in distinct.values()]
        for path, top in exits:
            self._insert(path, top)

    def expanded(self, weights: dict[bytes, list[int]]) -> tuple[dict[str, np.ndarray], list[tuple[int, bytes, int]]]:
        """All depths of all edges, as arrays, and (depth, digest, conversation) of every end.

        A row has the key of its node and of the node above, its members, the least of them, the number of its
        depth, and the two sums of ``weights`` over the nodes below and itself.  Roots other than depth 0 are left
        to the trie that they end in.
        """
        order, stack = [], list(self.roots.values())
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(node.kids.values())
        keys, above, lengths, members, least, sizes, depths, leaves, saved, ends = ([] for _ in range(10))
        totals: dict[int, tuple] = {}
        for node in reversed(order):
            below = [totals.pop(id(kid)) for kid in node.kids.values()]
            own = node.passing + node.ending
            n = len(own) + sum(t[0] for t in below)
            first = min([*own, *(t[1] for t in below)]) if n else None
            x, y = sum(t[2] for t in below), sum(t[3] for t in below)
            ends += [(node.high, node.last, c) for c in node.ending]
            if node.parent is None:
                if node.low:
                    continue
                places = [node.last]
                keys.append(node.last)
                above.append(node.last)
                sizes.append(0)
            else:
                raw = node.raw
                places = [raw[k:k + WIDE] for k in range(0, len(raw), WIDE)]
                keys.append(raw)
                above.append(node.parent.last + raw[:-WIDE])
                sizes += node.sizes
            lengths.append(len(places))
            members.append(n)
            least.append(first)
            depths.append(node.high - len(places) + 1)
            run = []
            for key in reversed(places):
                if key in weights:
                    x, y = x + weights[key][0], y + weights[key][1]
                run.append((x, y))
            for a, b in reversed(run):
                leaves.append(a)
                saved.append(b)
            totals[id(node)] = (n, first, x, y)
        count = np.array(lengths, np.int64)
        starts = np.cumsum(count) - count
        key, up = (np.frombuffer(b"".join(r), np.int64).reshape(-1, 2) for r in (keys, above))
        return {"depth": np.repeat(np.array(depths, np.int64) - starts, count) + np.arange(count.sum()),
                "a": key[:, 0], "b": key[:, 1], "above_a": up[:, 0], "above_b": up[:, 1],
                "n": np.repeat(np.array(members, np.int64), count), "conv_id": np.repeat(np.array(least, np.int64), count),
                "bytes": np.array(sizes, np.int64), "leaves": np.array(leaves, np.int64),
                "saved": np.array(saved, np.int64)}, ends
