"""Line algorithms for edits and patches: helpers that a task runs on one text at a time.

Distances are bit-parallel, a column of the table in one integer; blocks are found through an index of lines, so that a
content of many lines is gone through once; differences are found in linear space, in pieces over ``PATIENCE`` lines by
lines that are unique on both sides first, and between those by the shortest edit script, whose search is given up (not
its correctness) after ``PATIENCE`` edits in a piece.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence

#: Lines of a piece that is searched for the shortest script at once, and edits after which that takes the farthest point reached.
PATIENCE = 200


def edit_distance(a: str, b: str, most: int | None = None) -> int | None:
    """Levenshtein distance of two texts, or None where it exceeds ``most``."""
    start, end = 0, min(len(a), len(b))
    while start < end and a[start] == b[start]:
        start += 1
    tail = 0
    while tail < end - start and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[start : len(a) - tail], b[start : len(b) - tail]
    if len(a) > len(b):
        a, b = b, a
    most = len(b) if most is None else most
    if len(b) - len(a) > most:
        return None
    if not a:
        return len(b)
    where: dict[str, int] = defaultdict(int)
    for i, c in enumerate(a):
        where[c] |= 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)  # where the column's steps go up and down, and its last value
    for left, c in zip(range(len(b) - 1, -1, -1), b, strict=True):
        same = where.get(c, 0)
        level = (((same & up) + up) ^ up) | same
        rises, falls = down | (full & ~(level | up)), up & level
        score += bool(rises & top) - bool(falls & top)
        if score - left > most:
            return None
        rises, falls = (rises << 1 | 1) & full, falls << 1 & full
        same |= down
        up, down = falls | (full & ~(same | rises)), rises & same
    return score if score <= most else None


def similarity(a: str, b: str, least: float = 0.0) -> float | None:
    """1 for equal texts, 0 for texts without a common letter in place; None where it is below ``least``."""
    longest = max(len(a), len(b))
    if not longest:
        return 1.0
    distance = edit_distance(a, b, min(longest, int((1 - least) * longest + 1e-9)))
    return None if distance is None else 1 - distance / longest


class Index:
    """The lines of a content, and where each trimmed line is."""

    def __init__(self, content: str):
        self.lines = content.split("\n")
        self.bare = [x.strip() for x in self.lines]
        self.at: dict[str, list[int]] = defaultdict(list)
        for i, x in enumerate(self.bare):
            self.at[x].append(i)

    def part(self, start: int, end: int) -> str:
        return "\n".join(self.lines[start:end])

    def runs(self, bare: Sequence[str]) -> Iterator[int]:
        """Where lines begin that are ``bare`` when trimmed."""
        n = len(bare)
        for i in self.at.get(bare[0], ()):
            if self.bare[i : i + n] == bare:
                yield i

    def spans(self, head: str, tail: str) -> list[tuple[int, int]]:
        """[from, to) of every line that is ``head`` and the first line after the next one that is ``tail``, both trimmed."""
        ends, out = self.at.get(tail, []), []
        for i in self.at.get(head, ()):
            k = bisect_left(ends, i + 2)
            if k < len(ends):
                out.append((i, ends[k] + 1))
        return out


def locate_block(index: Index, block: str) -> tuple[int, int] | None:
    """The lines [from, to) that best fit ``block``, anchored on its first and last line (trimmed).

    One candidate is always taken; of several the most similar one, if its inner lines are 0.3 similar on average.
    """
    want = block.rstrip("\n").split("\n")
    if len(want) < 3:
        return None
    bare = [x.strip() for x in want]
    spans = index.spans(bare[0], bare[-1])
    if len(spans) < 2:
        return spans[0] if spans else None
    best, found = -1.0, None
    for span in spans:
        inner = min(len(want), span[1] - span[0]) - 2
        each: list[float] = []
        for k in range(1, inner + 1):
            # what this line has to give so that the span can still be the best
            one = similarity(index.bare[span[0] + k], bare[k], max(0.0, best * inner - sum(each) - (inner - k) - 1e-9))
            if one is None:
                break
            each.append(one)
        else:
            score = sum(each) / inner if inner > 0 else 1.0
            if score > best:
                best, found = score, span
    return found if best >= 0.3 else None


def _unique(a: Sequence[int], b: Sequence[int], box: tuple[int, int, int, int]) -> list[tuple[int, int]]:
    """Lines that are once in both parts, in one order: the longest rising sequence of their places."""
    lo_a, hi_a, lo_b, hi_b = box
    seen: dict[int, list[int]] = {}
    for i in range(lo_a, hi_a):
        seen.setdefault(a[i], [0, 0, i, 0])[0] += 1
    for j in range(lo_b, hi_b):
        if (s := seen.get(b[j])) is not None:
            s[1] += 1
            s[3] = j
    pairs = [(s[2], s[3]) for s in seen.values() if s[0] == s[1] == 1]  # by their place in a
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        back[n] = ends[k - 1] if k else -1
        if k == len(tops):
            tops.append(j)
            ends.append(n)
        else:
            tops[k], ends[k] = j, n
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def _middle(a: Sequence[int], b: Sequence[int], box: tuple[int, int, int, int]) -> tuple[int, int]:
    """A point on a shortest edit script, where searches from both ends meet; the farthest one reached where that takes too long."""
    lo_a, hi_a, lo_b, hi_b = box
    n, m = hi_a - lo_a, hi_b - lo_b
    skew = n - m
    ahead, behind = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            x = ahead[k + 1] if k == -d or (k != d and ahead.get(k - 1, -1) < ahead.get(k + 1, -1)) else ahead[k - 1] + 1
            first = x
            while x < n and 0 <= x - k < m and a[lo_a + x] == b[lo_b + x - k]:
                x += 1
            ahead[k] = x
            if skew % 2 and -(d - 1) <= skew - k <= d - 1 and x <= n and 0 <= x - k <= m and x + behind.get(skew - k, -1) >= n:
                return (lo_a + first, lo_b + first - k) if 0 <= first - k <= m and first <= n and (first, first - k) not in ((0, 0), (n, m)) else (lo_a + x, lo_b + x - k)
        for k in range(-d, d + 1, 2):
            x = behind[k + 1] if k == -d or (k != d and behind.get(k - 1, -1) < behind.get(k + 1, -1)) else behind[k - 1] + 1
            while x < n and 0 <= x - k < m and a[hi_a - 1 - x] == b[hi_b - 1 - x + k]:
                x += 1
            behind[k] = x
            if not skew % 2 and -d <= skew - k <= d and x <= n and 0 <= x - k <= m and x + ahead.get(skew - k, -1) >= n:
                return hi_a - x, hi_b - x + k
        if d >= PATIENCE:
            inside = [(x + x - k, x, x - k) for k, x in ahead.items() if x <= n and 0 <= x - k <= m]
            _, x, y = max(inside)
            return lo_a + x, lo_b + y
    return hi_a, lo_b


def matching(old: Sequence[str], new: Sequence[str]) -> list[tuple[int, int]]:
    """Pairs (i, j) of equal lines that stay, in order; all other lines are taken out or put in."""
    numbers: dict[str, int] = {}
    a = [numbers.setdefault(x, len(numbers)) for x in old]
    b = [numbers.setdefault(x, len(numbers)) for x in new]
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo_a, hi_a, lo_b, hi_b = todo.pop()
        while lo_a < hi_a and lo_b < hi_b and a[lo_a] == b[lo_b]:
            out.append((lo_a, lo_b))
            lo_a, lo_b = lo_a + 1, lo_b + 1
        while lo_a < hi_a and lo_b < hi_b and a[hi_a - 1] == b[hi_b - 1]:
            hi_a, hi_b = hi_a - 1, hi_b - 1
            out.append((hi_a, hi_b))
        if lo_a == hi_a or lo_b == hi_b:
            continue
        box = lo_a, hi_a, lo_b, hi_b
        if hi_a - lo_a + hi_b - lo_b > PATIENCE and (anchors := _unique(a, b, box)):
            for i, j in anchors:
                out.append((i, j))
                todo.append((lo_a, i, lo_b, j))
                lo_a, lo_b = i + 1, j + 1
            todo.append((lo_a, hi_a, lo_b, hi_b))
            continue
        i, j = _middle(a, b, box)
        if (i, j) in ((lo_a, lo_b), (hi_a, hi_b)):  # nothing in common
            continue
        todo += [(lo_a, i, lo_b, j), (i, hi_a, j, hi_b)]
    return sorted(out)


def unified(old: str, new: str, before: str = "old", after: str = "new") -> str:
    """A unified patch with the whole text as context; empty for equal texts."""
    if old == new:
        return ""
    a, b = (re.findall(r"[^\n]*\n|[^\n]+", x) for x in (old, new))
    ended = lambda x: x if x.endswith("\n") else x + "\n\\ No newline at end of file\n"
    span = lambda x: f"{1 if x else 0},{len(x)}" if len(x) != 1 else "1"
    out = [f"--- {before}\n", f"+++ {after}\n", f"@@ -{span(a)} +{span(b)} @@\n"]
    i = j = 0
    for p, q in [*matching(a, b), (len(a), len(b))]:
        out += [f"-{ended(x)}" for x in a[i:p]] + [f"+{ended(x)}" for x in b[j:q]]
        if p < len(a):
            out.append(f" {ended(a[p])}")
        i, j = p + 1, q + 1
    return "".join(out)
