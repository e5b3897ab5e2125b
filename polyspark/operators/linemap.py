"""The lines of one kind of a map, to which new lines are added one by one.

Ends of lines are kept in a grid of cells as wide as the attachment radius, so a new line looks at the ends near its own two
ends only, however large the map is. A line that takes up another one replaces it: both are versions with a life of their own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Widest gap between two ends that are joined, widest gap that counts as one vertex, and closest vertices of a line.
ATTACH_RADIUS = 3.0
JOINT = 1.5
SAME = 1e-3
CELL = 1.0

#: By (end of the known line, end of the new line), 0 the first and 1 the last vertex: the place among equal distances,
#: whether the new line is turned round, and whether the known line comes first.
JOINS = {(1, 0): (0, False, True), (0, 1): (1, False, False), (1, 1): (2, True, True), (0, 0): (3, True, False)}


@dataclass
class Line:
    """``order`` is the place of the new line that made this version; ``kinds`` are the types of its first and last vertex."""

    order: tuple
    points: np.ndarray
    kinds: tuple[str | None, str | None]
    extra: dict = field(default_factory=dict)

    def turned(self) -> Line:
        """The other way round, with the types of both ends as they were."""
        return Line(self.order, self.points[::-1], self.kinds[::-1])

    def signature(self, cell: float) -> tuple:
        """Equal for lines between the same pair of rounded ends with as many vertices."""
        if not len(self.points):
            return ()
        ends = sorted(map(tuple, np.rint(self.points[[0, -1]] / cell).astype(np.int64).tolist()))
        return (*ends, len(self.points))


def thinned(points: np.ndarray) -> np.ndarray:
    """Without vertices within ``SAME`` of the last kept one."""
    gaps = np.hypot(*np.diff(points, axis=0).T) if len(points) > 1 else np.zeros(0)
    if (gaps > SAME).all():
        return points
    kept = [points[0]]
    for p in points[1:]:
        if np.hypot(*(p - kept[-1])) > SAME:
            kept.append(p)
    return np.array(kept)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One line of two: at a small joint the first vertex of the second goes."""
    if not len(a) or not len(b):
        return a if len(a) else b
    a = thinned(a)
    rest = b[1:] if np.hypot(*(a[-1] - b[0])) <= JOINT else b
    tail = thinned(np.vstack([a[-1:], rest]))[1:]
    return np.vstack([a, tail])


class LineMap:
    """Lines of one category and line type. What it remembers is read and written in the methods of the first block alone."""

    def __init__(self, radius: float = ATTACH_RADIUS, cell: float = CELL):
        self.radius, self.cell = radius, cell
        self.lines: dict[tuple, Line] = {}
        self.signatures: set[tuple] = set()
        self.cells: dict[tuple[int, int], dict[tuple[tuple, int], np.ndarray]] = {}

    def put(self, line: Line) -> None:
        self.lines[line.order] = line

    def pop(self, order: tuple) -> Line:
        return self.lines.pop(order)

    def mark(self, signature: tuple) -> bool:
        """Remembers a signature; false where it was known."""
        new = signature not in self.signatures
        self.signatures.add(signature)
        return new

    def ends(self, at: tuple[int, int]) -> dict[tuple[tuple, int], np.ndarray]:
        """The ends in a cell by order of their line and side."""
        return self.cells.get(at, {})

    def put_ends(self, at: tuple[int, int], ends: dict[tuple[tuple, int], np.ndarray]) -> None:
        if ends:
            self.cells[at] = ends
        else:
            self.cells.pop(at, None)

    def _cell(self, p: np.ndarray) -> tuple[int, int]:
        x, y = np.floor(p / self.radius).astype(np.int64).tolist()
        return x, y

    def _sides(self, line: Line):
        return [(0, line.points[0]), (1, line.points[-1])] if len(line.points) > 1 else []

    def keep(self, line: Line) -> None:
        self.put(line)
        for side, p in self._sides(line):
            at = self._cell(p)
            self.put_ends(at, {**self.ends(at), (line.order, side): p})

    def take(self, order: tuple) -> Line:
        line = self.pop(order)
        for side, p in self._sides(line):
            at = self._cell(p)
            self.put_ends(at, {k: q for k, q in self.ends(at).items() if k != (order, side)})
        return line

    def nearest(self, line: Line) -> tuple[tuple, int, int] | None:
        """``order, end of that line, end of this line`` of the nearest end: of equal ones the oldest line, then as in ``JOINS``."""
        best = None
        for new, p in self._sides(line):
            x, y = self._cell(p)
            for near in ((x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                for (order, old), q in self.ends(near).items():
                    gap = float(np.hypot(*(q - p)))
                    rank = (gap, order, JOINS[old, new][0])
                    if gap <= self.radius and (best is None or rank < best[0]):
                        best = (rank, old, new)
        return best and (best[0][1], best[1], best[2])

    def add(self, line: Line) -> tuple[Line | None, Line | None]:
        """Adds a line; returns the version that came in and the version that it took up, either may be none.

        What comes out with a signature that was seen before is dropped; what it took up is gone all the same.
        """
        found, gone = self.nearest(line), None
        if found:
            order, old, new = found
            gone = self.take(order)
            _, turn, known_first = JOINS[old, new]
            other = line.turned() if turn else line
            first, second = (gone, other) if known_first else (other, gone)
            line = Line(line.order, joined(first.points, second.points), (first.kinds[0], second.kinds[1]))
        if not self.mark(line.signature(self.cell)):
            return None, gone
        self.keep(line)
        return line, gone
