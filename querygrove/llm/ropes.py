"""Texts as shared concatenation trees, compared by hashes of their parts."""

from __future__ import annotations

PRIME, BASE, FLAT = (1 << 61) - 1, 1_000_003, 64


class Rope:
    """A text: either written out, or two ropes after one another."""
    __slots__ = ("text", "left", "right", "size", "hash", "power")

    def __init__(self, text, left, right, size, hash_, power):
        self.text, self.left, self.right = text, left, right
        self.size, self.hash, self.power = size, hash_, power


def rope(text: str) -> Rope:
    h, p = 0, 1
    for c in text:
        h, p = (h * BASE + ord(c)) % PRIME, p * BASE % PRIME
    return Rope(text, None, None, len(text), h, p)


EMPTY = rope("")


def join(a: Rope, b: Rope) -> Rope:
    if not a.size:
        return b
    if not b.size:
        return a
    size, h, p = a.size + b.size, (a.hash * b.power + b.hash) % PRIME, a.power * b.power % PRIME
    if size <= FLAT and a.text is not None and b.text is not None:
        return Rope(a.text + b.text, None, None, size, h, p)
    return Rope(None, a, b, size, h, p)


def less(a: Rope, b: Rope) -> bool:
    """Whether ``a`` comes first; parts of equal hash are passed over whole."""
    x, y = [a], [b]
    while x and y:
        p, q = x.pop(), y.pop()
        if p.size == q.size and p.hash == q.hash:
            continue
        if p.text is not None and q.text is not None:
            n = min(p.size, q.size)
            if p.text[:n] != q.text[:n]:
                return p.text < q.text
            if p.size > n:
                x.append(rope(p.text[n:]))
            if q.size > n:
                y.append(rope(q.text[n:]))
        elif p.text is None and (q.text is not None or p.size >= q.size):
            x += [p.right, p.left]
            y.append(q)
        else:
            x.append(p)
            y += [q.right, q.left]
    return bool(y)


def written(a: Rope) -> str:
    out, stack = [], [a]
    while stack:
        p = stack.pop()
        if p.text is None:
            stack += [p.right, p.left]
        else:
            out.append(p.text)
    return "".join(out)
