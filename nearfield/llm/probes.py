"""A bounded set of query vectors against blocks of rows: all pairs whose cosine reaches a threshold, exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from nearfield.functions.arrays import cosines

#: A product of so many rows and probes stays in a core's cache while it is searched.
ROWS, COLS = 2048, 128
#: Bounds are shorter rows: more probes at a time.
WIDE = 512
#: Float32 products this near the threshold are computed again in double.
BORDER = 2e-6
#: Leading components that a bound takes in, tried in turn, and by how much a float32 bound may be too low.
LEVELS, SLACK = (16, 24, 32, 48, 64, 80, 96), 1e-5
#: Shares of a tile's pairs that a bound leaves: above the first the next tile takes the next level, above the second
#: this one does, and behind the last level the whole product is made.
MANY, TOO_MANY = 1 / 1024, 1 / 128


def _shortened(along: np.ndarray, x: np.ndarray, r: int) -> np.ndarray:
    """(along, the first r components of x, the length of the others): products of two such rows bound that of the whole ones."""
    return np.concatenate([along[:, None], x[:, :r], np.sqrt(np.einsum("ij,ij->i", x[:, r:], x[:, r:]))[:, None]], 1)


class Probes:
    """Unit query vectors; `centres` (unit rows) let most pairs be excluded without a product.

    By the triangle inequality of angles a row at angle a of a centre can reach only probes at an angle of at most
    a + arccos(link) of it: rows near a centre meet a part of the probes. Rows far from all centres meet all of them.

    What is left is bounded before it is multiplied out. With x = a c + y for a row's centre c the product with a probe p is
    a (c p) + y p, and y p is at most the product over some leading components plus that of the lengths of the others. The
    components are along the probes' principal axes. A row near its centre has a short y, so that few of them exclude
    nearly all pairs.
    """

    def __init__(self, vectors: np.ndarray, link: float, centres: np.ndarray | None = None, near: float = 0.6):
        self.p, self.link, self.near = vectors, link, near
        self.centres = centres if centres is not None else np.empty((0, vectors.shape[1]), np.float32)
        self.reach = float(np.arccos(np.clip(link, -1, 1))) + 1e-3
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.levels = [r for r in LEVELS if r <= 0.8 * vectors.shape[1]]
        self.axes = np.linalg.eigh(vectors.T @ vectors)[1][:, ::-1] if len(vectors) else np.eye(vectors.shape[1], dtype=np.float32)
        self.turned, self.leading = vectors @ self.axes, {}
        self.buffer, self.bounds = np.empty(ROWS * COLS, np.float32), np.empty(ROWS * WIDE, np.float32)

    def _by_angle(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The probes by rising angle to centre k, these angles and the products with the centre."""
        if k not in self.sorted:
            c = self.p @ self.centres[k]
            angle = np.arccos(np.clip(c, -1, 1))
            order = np.argsort(angle).astype(np.int32)
            self.sorted[k] = order, angle[order], c[order]
        return self.sorted[k]

    def _leading(self, r: int) -> np.ndarray:
        """The probes' components along the first r axes and the length of the others, behind a column for the product with a centre."""
        if r not in self.leading:
            self.leading[r] = _shortened(np.zeros(len(self.p), np.float32), self.turned, r)
        return self.leading[r]

    def _bounded_tiles(self, x: np.ndarray, centre: np.ndarray, order: np.ndarray, c: np.ndarray, widths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """As _tiles for the probes in `order`, whose products with the centre are c; most pairs are excluded by a bound.

        widths: how many of the rows each tile of probes meets.
        """
        a = x @ centre
        y, short, level = (x - a[:, None] * centre) @ self.axes, {}, 0
        # the farthest probes first: the nearer a tile is to the centre, the more components its bound needs
        for n in range(len(widths) - 1, -1, -1):
            t, of = n * WIDE, order[n * WIDE : (n + 1) * WIDE]
            for s in range(0, int(widths[n]), ROWS):
                e = min(s + ROWS, int(widths[n]))
                left = None
                while left is None and level < len(self.levels):
                    r = self.levels[level]
                    if r not in short:
                        short[r] = _shortened(a, y, r)
                    q = self._leading(r).take(of, 0)
                    q[:, 0] = c[t : t + len(of)]
                    out = self.bounds[: (e - s) * len(of)].reshape(e - s, -1)
                    np.matmul(short[r][s:e], q.T, out=out)
                    if out.max() < self.link - SLACK:
                        left = np.empty(0, int)
                        break
                    at = np.flatnonzero(out.ravel() >= self.link - SLACK)
                    level += len(at) > MANY * out.size
                    left = at if len(at) <= TOO_MANY * out.size else None
                if left is None:
                    for i, j, found in self._tiles(x[s:e], self.p[of]):
                        yield s + i, t + j, found
                elif len(left):
                    i, j = np.divmod(left, len(of))
                    exact = cosines(x[s + i], self.p[of[j]])
                    kept = exact >= self.link
                    if kept.any():
                        yield s + i[kept], t + j[kept], exact[kept]

    def _tiles(self, x: np.ndarray, p: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, probe, product) of the pairs at the threshold."""
        for t in range(0, len(p), COLS):
            q = p[t : t + COLS].T
            for s in range(0, len(x), ROWS):
                part = x[s : s + ROWS]
                out = self.buffer[: len(part) * q.shape[1]].reshape(len(part), -1)
                np.matmul(part, q, out=out)
                if out.max() >= self.link - BORDER:
                    i, j = np.nonzero(out >= self.link - BORDER)
                    yield s + i, t + j, out[i, j]

    def hits(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row numbers, probe numbers) of all pairs of a row of x (unit, float32) and a probe that reach the threshold."""
        group = np.full(len(x), -1)
        if len(self.centres) and len(self.p):
            s = np.concatenate([x[a : a + 8192] @ self.centres.T for a in range(0, len(x), 8192)] or [np.empty((0, len(self.centres)), np.float32)])
            first = s.argmax(1) if len(x) else np.empty(0, int)
            high = s[np.arange(len(x)), first]
            group = np.where(high >= self.near, first, -1)
        for k in np.unique(group):
            rows = np.flatnonzero(group == k)
            if k < 0:
                order, c = np.arange(len(self.p)), np.zeros(len(self.p), np.float32)
                found = self._bounded_tiles(x[rows], np.zeros(x.shape[1], np.float32), order, c, np.full(-(-len(order) // WIDE), len(rows)))
            else:
                angle = np.arccos(np.clip(high[rows], -1, 1))
                rows, angle = rows[by := np.argsort(-angle)], angle[by]
                order, far, c = self._by_angle(int(k))
                order = order[: np.searchsorted(far, angle[0] + self.reach, "right")]
                # a tile of probes meets the rows that lie far enough from the centre to reach its nearest probe
                widths = np.searchsorted(-angle, self.reach - far[: len(order) : WIDE], "right")
                found = self._bounded_tiles(x[rows], self.centres[k], order, c, widths)
            for i, j, c in found:
                i, j = rows[i], order[j]
                border = np.flatnonzero(c < self.link + BORDER)
                if len(border):
                    keep = np.ones(len(i), bool)
                    keep[border] = cosines(x[i[border]], self.p[j[border]]) >= self.link
                    i, j = i[keep], j[keep]
                if len(i):
                    yield i, j
