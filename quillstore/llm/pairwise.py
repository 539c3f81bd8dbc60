"""Comparisons of sets inside one task: by parity sketches first, then exactly.

A task holds parts.  A part is some sets around one hub, each on the left side,
on the right side, or on both (one block compared with itself).  Pairs of one
root are known to be connected and are not looked at.  Neither step gives more
rows than it reads, unless every link is asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import kernels as K

LEFT, RIGHT, BOTH = 0, 1, 2
#: Bytes of sketches, and elements, that are compared at a time.
SKETCH_BYTES, ELEMENTS = 1 << 23, 1 << 20


def sketch(elements: np.ndarray, words: int) -> np.ndarray:
    """Bit i is the parity of the number of elements with hash i.  Sketches differ in no more bits than sets in elements."""
    bit = np.bincount((K.splitmix(elements ^ K.U(0xC0FFEE)) & K.U(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bit.astype(np.uint8), bitorder="little").view("<i8")


class Sketches:
    """A column of sketches; two of different length are compared at the lesser one, the longer being folded."""

    def __init__(self, lists: pa.Array):
        self.size = np.asarray(lists.value_lengths()).astype(np.int64)
        flat, first = np.asarray(lists.flatten()).view(K.U), np.cumsum(self.size) - self.size
        self.at: dict = {}
        for w in np.unique(self.size):
            place = np.full(len(self.size), -1)
            own, double = np.flatnonzero(self.size == w), np.flatnonzero(self.size == 2 * w)
            place[own], place[double] = np.arange(len(own)), len(own) + np.arange(len(double))
            parts = [flat[first[own][:, None] + np.arange(w)]]
            if len(double):
                parts.append(flat[first[double][:, None] + np.arange(w)] ^ flat[first[double][:, None] + w + np.arange(w)])
            self.at[int(w)] = (np.concatenate(parts), place)

    def close(self, u: np.ndarray, v: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether u[i] and v[i] differ in at most most[i] bits."""
        out = np.zeros(len(u), bool)
        words = np.minimum(self.size[u], self.size[v])
        for w in np.unique(words):
            k = np.flatnonzero(words == w)
            table, place = self.at[int(w)]
            step = max(1, SKETCH_BYTES // (8 * int(w)))
            for x in range(0, len(k), step):
                some = k[x : x + step]
                bits = np.bitwise_count(table[place[u[some]]] ^ table[place[v[some]]]).sum(1, dtype=np.int64)
                out[some] = bits <= most[some]
        return out


def _allowed(a, b, options):
    return (a + b) * (options.den - options.num) // (options.den + options.num)


def _sides(n: np.ndarray, side: np.ndarray, part: np.ndarray):
    """(left rows, right rows, whether they are the same), each by size."""
    part = part[np.argsort(n[part], kind="stable")]
    if (side[part] == BOTH).any():
        return part, part, True
    return part[side[part] == LEFT], part[side[part] == RIGHT], False


def open_rows(n, root, side, sketches: Sketches, part: np.ndarray, options, tile: int = 256) -> np.ndarray:
    """Those rows of a part that have a partner of another root to which their sketch allows a link.  Pairs of which both
    rows are known to have one are skipped, so a group of near copies takes about one pass."""
    left, right, same = _sides(n, side, part)
    some = np.zeros(len(n), bool)
    sizes = n[right]
    for x in range(0, len(left), tile):
        p = left[x : x + tile]
        low = x if same else int(np.searchsorted(sizes, -(-n[p[0]] * options.num // options.den)))
        high = int(np.searchsorted(sizes, n[p[-1]] * options.den // options.num, side="right"))
        for y in range(low, high, tile):
            q = right[y : min(y + tile, high)]
            if some[p].all() and some[q].all():
                continue
            small, large = np.minimum(n[p][:, None], n[q]), np.maximum(n[p][:, None], n[q])
            wanted = (root[p][:, None] != root[q]) & (small * options.den >= large * options.num) & ~(some[p][:, None] & some[q])
            if same:
                wanted &= (x + np.arange(len(p)))[:, None] < y + np.arange(len(q))
            i, j = np.nonzero(wanted)
            for at in range(0, len(i), 1 << 13):
                u, v = p[i[at : at + (1 << 13)]], q[j[at : at + (1 << 13)]]
                new = ~(some[u] & some[v])
                u, v = u[new], v[new]
                ok = sketches.close(u, v, _allowed(n[u], n[v], options))
                some[u[ok]] = some[v[ok]] = True
    return np.flatnonzero(some)


def similar(one: np.ndarray, others: list[np.ndarray], options) -> np.ndarray:
    """Whether a set reaches the similarity with each of some others (none of them empty)."""
    out, size = np.zeros(len(others), bool), np.array([len(x) for x in others], np.int64)
    ends = np.cumsum(size)
    a = 0
    while a < len(others):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + ELEMENTS, side="right")))
        flat = np.concatenate(others[a:b])
        at = np.searchsorted(one, flat)
        at[at == len(one)] = 0
        shared = np.add.reduceat((one[at] == flat).astype(np.int64), ends[a:b] - size[a:b] - (ends[a - 1] if a else 0))
        out[a:b] = options.den * shared >= options.num * (len(one) + size[a:b] - shared)
        a = b
    return out


def links(n, root, side, sketches: Sketches, sets: list, part: np.ndarray, options, every: bool) -> list[tuple[int, np.ndarray]]:
    """(row, rows linked to it).  Not every: links inside what is by then connected are left out."""
    left, right, same = _sides(n, side, part)
    label, sizes, out = root.copy(), n[right], []
    for i, x in enumerate(left):
        low = i + 1 if same else int(np.searchsorted(sizes, -(-n[x] * options.num // options.den)))
        high = int(np.searchsorted(sizes, n[x] * options.den // options.num, side="right"))
        others = right[low:high]
        others = others[label[others] != label[x]]
        if not len(others):
            continue
        others = others[sketches.close(np.full(len(others), x), others, _allowed(n[x], n[others], options))]
        if not len(others):
            continue
        found = others[similar(sets[x], [sets[y] for y in others], options)]
        if len(found) and not every:
            labels, first = np.unique(label[found], return_index=True)
            found = found[first]
            mine = part[np.isin(label[part], labels)]
            label[mine] = label[x]
        if len(found):
            out.append((int(x), found))
    return out


def parts_of(table: pa.Table):
    """(columns as arrays, row numbers of each part (hub, i, j))."""
    plain = {c: table.column(c).to_numpy() for c in table.column_names if not (pa.types.is_list(table.schema.field(c).type) or pa.types.is_binary(table.schema.field(c).type))}
    order = np.lexsort((plain["j"], plain["i"], plain["hub"]))
    new = np.zeros(len(order), bool)
    for c in ("hub", "i", "j"):
        new[1:] |= plain[c][order][1:] != plain[c][order][:-1]
    return plain, np.split(order, np.flatnonzero(new)) if len(order) else []


def one_array(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
