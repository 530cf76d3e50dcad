"""Lossless WebP (VP8L): a decoder for the whole format and a writer for byte payloads.

``decode`` reads prefix codes, meta prefix images, back-references and the colour
cache, and inverts the predictor, cross-colour, subtract-green and palette
transforms.  With one group of codes, what a symbol would be is looked up at every
bit at once; only the steps from symbol to symbol, and copies, are followed one by
one.

``encode_bytes`` writes three bytes to a pixel, with prefix codes fitted to the
image, back-references or a colour cache, and the transform (none, a predictor,
subtract-green or a packed palette) that leaves the least entropy.
"""

from __future__ import annotations

import heapq
import re
import struct
from functools import lru_cache
from itertools import repeat

import numpy as np

# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
N_LENGTHS, N_DISTANCES = 24, 40
MOST = 16384  # pixels of a side

#: The numbers of 15 bits with their bits in reverse order.
REVERSED = sum(((np.arange(1 << 15) >> k & 1) << (14 - k) for k in range(15)), np.zeros(1 << 15, np.int64))


class Bits:
    """Little-endian bit reader."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        if not n:
            return 0
        first, end = self.at >> 3, (self.at + n + 7) >> 3
        if end > len(self.data):
            raise ValueError("the image ends early")
        value = int.from_bytes(self.data[first:end], "little") >> (self.at & 7)
        self.at += n
        return value & ((1 << n) - 1)


class Code:
    """A canonical prefix code, which puts shorter codes, and smaller symbols among them, first."""

    def __init__(self, lengths):
        lengths = np.asarray(lengths)
        used = np.flatnonzero(lengths)
        self.only = int(used[0]) if len(used) == 1 else (0 if not len(used) else None)
        self.short = None
        if self.only is None:
            by = used[np.argsort(lengths[used], kind="stable")]
            self.symbols, self.lengths = by, lengths[by]
            if int((1 << (15 - self.lengths)).sum()) != 1 << 15:
                raise ValueError("a prefix code is not complete")

    def look_up(self) -> tuple[np.ndarray, int]:
        """(symbol * 16 + length of the code) by the next bits under the mask."""
        if self.only is not None:
            return np.array([self.only << 4]), 0
        most = int(self.lengths[-1])
        table = np.repeat(self.symbols << 4 | self.lengths, 1 << (most - self.lengths))
        return table[REVERSED[: 1 << most] >> (15 - most)], (1 << most) - 1

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        if self.short is None:
            table, mask = self.look_up()
            self.short = table.tolist(), mask
        table, mask = self.short
        first = bits.at >> 3
        found = table[int.from_bytes(bits.data[first : first + 3], "little") >> (bits.at & 7) & mask]
        bits.read(found & 15)  # not past the end
        return found >> 4


def _read_code(bits: Bits, size: int, known: list) -> Code:
    """``known``: the code read last, as (size, its bits, how many, Code); the same bits are not worked out again."""
    if known and known[0] == size:
        _, pattern, n, code = known
        at = bits.at
        if at + n <= 8 * len(bits.data) and bits.read(n) == pattern:
            return code
        bits.at = at
    start = bits.at
    code = _new_code(bits, size)
    n, bits.at = bits.at - start, start
    known[:] = size, bits.read(n), n, code
    return code


@lru_cache(1 << 12)
def _table_of(lengths: tuple) -> tuple[list[int], int]:
    """The small code that code lengths are written in; few different ones occur."""
    table, mask = Code(lengths).look_up()
    return table.tolist(), mask


def _new_code(bits: Bits, size: int) -> Code:
    if bits.read(1):
        lengths = [0] * size
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    of_lengths = [0] * 19
    n = 4 + bits.read(4)
    three = bits.read(3 * n)
    for i, k in enumerate(LENGTH_ORDER[:n]):
        of_lengths[k] = three >> (3 * i) & 7
    table, mask = _table_of(tuple(of_lengths))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    lengths, last = [], 8
    first, at, end = bits.at >> 3, bits.at & 7, 0
    while len(lengths) < size and left:
        if at >= end:  # short numbers shift faster; a length takes 14 bits at most
            first, at, end = first + (at >> 3), at & 7, 8 * 40 - 14
            ahead = int.from_bytes(bits.data[first : first + 40], "little")
        left -= 1
        found = table[ahead >> at & mask]
        at += found & 15
        n = found >> 4
        if n < 16:
            lengths.append(n)
            last = n or last
        elif n == 16:
            lengths += [last] * (3 + (ahead >> at & 3))
            at += 2
        elif n == 17:
            lengths += [0] * (3 + (ahead >> at & 7))
            at += 3
        else:
            lengths += [0] * (11 + (ahead >> at & 127))
            at += 7
    if len(lengths) > size:
        raise ValueError("too many code lengths")
    bits.at = 8 * first + at
    if bits.at > 8 * len(bits.data):
        raise ValueError("the image ends early")
    return Code(lengths + [0] * (size - len(lengths)))


def _number(symbol: int, bits: Bits) -> int:
    """Lengths and distances: a symbol and extra bits."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _tiles(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def _read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as uint32 ARGB, row by row."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups_at, tile_bits = None, 0
    n_groups = 1
    if main and bits.read(1):
        tile_bits = bits.read(3) + 2
        groups_at = (_read_pixels(bits, _tiles(width, tile_bits), _tiles(height, tile_bits), False) >> 8) & 0xFFFF
        n_groups = int(groups_at.max()) + 1
    sizes = (256 + N_LENGTHS + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, N_DISTANCES)
    known: list = []
    groups = [[_read_code(bits, n, known) for n in sizes] for _ in range(n_groups)]
    total = width * height
    if n_groups == 1 and groups[0][0].only is None:
        return _read_group(bits, total, width, groups[0], cache_bits)
    if n_groups == 1 and not cache_bits and groups[0][0].only < 256 and all(c.only is not None for c in groups[0][1:4]):
        green, red, blue, alpha = (c.only for c in groups[0][:4])
        return np.full(total, alpha << 24 | red << 16 | green << 8 | blue, np.uint32)
    out = [0] * total
    cache = [0] * (1 << cache_bits)
    shift = 32 - cache_bits
    tiles_wide = _tiles(width, tile_bits)
    at = 0
    while at < total:
        group = groups[0 if groups_at is None else int(groups_at[(at // width >> tile_bits) * tiles_wide + (at % width >> tile_bits)])]
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = (c.read(bits) for c in group[1:4])
            new = [alpha << 24 | red << 16 | s << 8 | blue]
        elif s < 256 + N_LENGTHS:
            n = _number(s - 256, bits)
            far = _number(group[4].read(bits), bits)
            if far > len(NEAR):
                far -= len(NEAR)
            else:
                dx, dy = NEAR[far - 1]
                far = max(1, dx + dy * width)
            if far > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            new = []
            for k in range(n):  # a copy may read what it has just written
                new.append(out[at + k - far])
                out[at + k] = new[-1]
        else:
            new = [cache[s - 256 - N_LENGTHS]]
        out[at : at + len(new)] = new
        at += len(new)
        if cache_bits:
            for p in new:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> shift] = p
    return np.array(out, np.uint32)


def _read_group(bits: Bits, total: int, width: int, group: list[Code], cache_bits: int, step: int = 1 << 15) -> np.ndarray:
    """Pixels of one group of codes: symbols are looked up at all bits of ``step`` bytes, then followed."""
    tables = [c.look_up() for c in group]
    sizes_of = [table & 15 for table, _ in tables]
    out = np.empty(total, np.int64)
    n_out, cache, shift = 0, None, 32 - cache_bits

    # positions wrap, which is the fastest way to take, but never do: the window goes on beyond them
    def ahead(k, at):
        return window.take(at, mode="wrap") & tables[k][1]

    def read(k, at):
        found = tables[k][0].take(ahead(k, at), mode="wrap")
        return found >> 4, at + (found & 15)

    def numbers(symbol, at):
        extra = np.maximum(0, (symbol - 2) >> 1)
        value = ((2 + (symbol & 1)) << extra) + (window[at] & ((1 << extra) - 1)) + 1
        return np.where(symbol < 4, symbol + 1, value), at + extra

    while n_out < total:
        first = bits.at >> 3
        if first >= len(bits.data):
            raise ValueError("the image ends early")
        raw = np.zeros(min(step, len(bits.data) - first) + 20, np.int64)
        here = np.frombuffer(bits.data, np.uint8, min(len(raw), len(bits.data) - first), first)
        raw[: len(here)] = here
        quads = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
        window = (quads[:, None] >> np.arange(8)).ravel()
        n_bits = 8 * (len(raw) - 20)  # symbols begin before; what they read may be after
        greens = tables[0][0].take(window[:n_bits] & tables[0][1], mode="wrap")
        after = np.arange(n_bits) + (greens & 15)
        nexts = after
        for k in (1, 2, 3):
            if group[k].only is None:
                nexts = nexts + sizes_of[k].take(ahead(k, nexts), mode="wrap")
        others = np.flatnonzero(greens >= 256 << 4)
        if len(others):
            nexts = nexts.copy()
            nexts[others] = after[others]
        copies = others[greens[others] < 256 + N_LENGTHS << 4]
        if len(copies):
            length, then = numbers((greens[copies] >> 4) - 256, after[copies])
            symbol, then = read(4, then)
            far, then = numbers(symbol, then)
            nexts[copies] = then
        # steps of 16 symbols are followed one by one, and those within them all at once
        hops = [np.append(np.minimum(nexts, n_bits), n_bits)]
        for _ in range(4):
            hops.append(hops[-1].take(hops[-1], mode="wrap"))
        follow, firsts, p = memoryview(hops[-1]), [], bits.at & 7
        add = firsts.append
        for _ in repeat(None, -(-(total - n_out) // 16)):  # a symbol is one pixel at least
            add(p)
            p = follow[p]
            if p >= n_bits:
                break
        found = np.array(firsts)
        for hop in hops[3::-1]:
            found = np.stack([found, hop.take(found, mode="wrap")], -1).ravel()
        found = found[found < n_bits][: total - n_out]
        p = int(nexts[found[-1]])
        kinds = greens[found] >> 4
        colours, then = kinds << 8, after[found]
        for k, left in ((1, 16), (2, 0), (3, 24)):
            value, then = read(k, then) if group[k].only is None else (group[k].only, then)
            colours |= value << left
        copied = np.flatnonzero((kinds >= 256) & (kinds < 256 + N_LENGTHS))
        sizes = np.ones(len(found), np.int64)
        if len(copied):
            which = np.searchsorted(copies, found[copied])
            sizes[copied] = length[which]
        ends = n_out + np.cumsum(sizes)
        used = int(np.searchsorted(ends, total)) + 1  # symbols beyond the last pixel were not written as such
        if used < len(found):
            p, kinds, colours, sizes, ends = int(found[used]), kinds[:used], colours[:used], sizes[:used], ends[:used]
            copied = copied[copied < used]
        if ends[-1] > total:
            raise ValueError("a back-reference leaves the image")
        starts = ends - sizes
        plain = kinds < 256
        out[starts[plain]] = colours[plain]
        hits = np.flatnonzero(kinds >= 256 + N_LENGTHS)
        if not len(copied) and cache is None and (not len(hits) or n_out == 0 and used == total and _from_cache(out, kinds, shift)):
            pass
        else:
            fars = [_distance(d, width) for d in far[which[: len(copied)]].tolist()] if len(copied) else []
            if cache_bits and cache is None:
                cache = _cache_of(out[:n_out], shift)
            _in_order(out, cache, shift, starts, ends, kinds, copied, fars)
        n_out = int(ends[-1])
        bits.at = 8 * first + p
        if bits.at > 8 * len(bits.data):
            raise ValueError("the image ends early")
    return out.astype(np.uint32)


def _distance(d: int, width: int) -> int:
    if d > len(NEAR):
        return d - len(NEAR)
    dx, dy = NEAR[d - 1]
    return max(1, dx + dy * width)


def _slots(colours: np.ndarray, shift: int) -> np.ndarray:
    return (CACHE_FACTOR * colours & 0xFFFFFFFF) >> shift


def _cache_of(colours: np.ndarray, shift: int) -> list[int]:
    cache = np.zeros(1 << (32 - shift), np.int64)
    cache[_slots(colours, shift)] = colours  # of several, the last one stays
    return cache.tolist()


def _from_cache(out: np.ndarray, kinds: np.ndarray, shift: int) -> bool:
    """An image of plain pixels and cache entries: an entry holds the last plain pixel of its slot, if there is one."""
    plain = kinds < 256
    slot = np.where(plain, 0, kinds - 256 - N_LENGTHS)
    slot[plain] = _slots(out[plain], shift)
    by = np.argsort(slot, kind="stable")
    s, at = slot[by], np.where(plain[by], np.arange(len(by)), -1)
    last = np.maximum.accumulate(at)
    if last[0] < 0 or (s[last] != s).any():
        return False
    out[by] = out[by[last]]
    return True


def _in_order(out, cache, shift, starts, ends, kinds, copied, fars) -> None:
    """Copies and cache entries one by one; runs of plain pixels between them at once."""
    if cache is None:
        for a, b, d in zip(starts[copied].tolist(), ends[copied].tolist(), fars):
            _copy(out, a, b, d)
        return
    far_of = dict(zip(copied.tolist(), fars))
    for k, (s, a, b) in enumerate(zip(kinds.tolist(), starts.tolist(), ends.tolist())):
        if s >= 256 + N_LENGTHS:
            out[a] = cache[s - 256 - N_LENGTHS]  # 0 where nothing has set it
        elif s >= 256:
            _copy(out, a, b, far_of[k])
        for c in out[a:b].tolist():
            cache[(CACHE_FACTOR * c & 0xFFFFFFFF) >> shift] = c


def _copy(out: np.ndarray, a: int, b: int, d: int) -> None:
    if d > a:
        raise ValueError("a back-reference leaves the image")
    while b - a > d:  # a copy may read what it has just written
        out[a : a + d] = out[a - d : a]
        a, d = a + d, 2 * d
    out[a:b] = out[a - d : b - d]


def _split(p: np.ndarray) -> np.ndarray:
    """uint32 ARGB to (..., 4) bytes in the order blue, green, red, alpha."""
    return np.ascontiguousarray(p.astype("<u4")).view(np.uint8).reshape(*p.shape, 4)


def _joined(c: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(c.astype(np.uint8)).view("<u4").reshape(c.shape[:-1]).astype(np.uint32)


def predicted(mode: int, left, top, top_right, top_left):
    """The prediction from four neighbours, each a (4,) integer array."""
    half = lambda a, b: (a + b) >> 1
    if mode == 0 or mode > 13:
        return np.array([0, 0, 0, 255])
    if mode < 5:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return half(half(left, top_right), top)
    if mode < 10:
        a, b = ((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6]
        return half(a, b)
    if mode == 10:
        return half(half(left, top_left), half(top, top_right))
    if mode == 11:
        by_left, by_top = abs(top - top_left).sum(), abs(left - top_left).sum()
        return left if by_left < by_top else top
    if mode == 12:
        return (left + top - top_left).clip(0, 255)
    mean = half(left, top)
    # halved towards zero
    return (mean + np.trunc((mean - top_left) / 2).astype(int)).clip(0, 255)


def _neighbours(c, x: int, y: int, width: int):
    """For the last column, the pixel after "top" is the first one of its own row."""
    top_right = c[y - 1, x + 1] if x + 1 < width else c[y, 0]
    return c[y, x - 1], c[y - 1, x], top_right, c[y - 1, x - 1]


def _undo_predictor(p: np.ndarray, modes: np.ndarray, tile_bits: int) -> np.ndarray:
    height, width = p.shape
    c = _split(p).astype(int)
    used = set(np.unique((modes >> 8) & 15).tolist())
    if used == {1} or used == {2}:
        # rows begin by the pixel above, the first row goes on by the one before; sums do for the rest
        c[0, 0, 3] += 255
        if used == {1}:
            c[:, 0] = c[:, 0].cumsum(0)
            return _joined(c.cumsum(1) & 255)
        c[0] = c[0].cumsum(0)
        return _joined(c.cumsum(0) & 255)
    for y in range(height):
        for x in range(width):
            if not x and not y:
                guess = np.array([0, 0, 0, 255])
            elif not y:
                guess = c[0, x - 1]
            elif not x:
                guess = c[y - 1, 0]
            else:
                guess = predicted(int(modes[y >> tile_bits, x >> tile_bits] >> 8) & 15, *_neighbours(c, x, y, width))
            c[y, x] = (c[y, x] + guess) & 255
    return _joined(c)


def _signed(a):
    return ((a.astype(int) & 255) ^ 128) - 128


def colour_delta(factor, value):
    return (_signed(factor) * _signed(value)) >> 5


def _spread(tiles: np.ndarray, tile_bits: int, shape) -> np.ndarray:
    return tiles.repeat(1 << tile_bits, 0).repeat(1 << tile_bits, 1)[: shape[0], : shape[1]]


def _undo_cross_colour(p: np.ndarray, tiles: np.ndarray, tile_bits: int) -> np.ndarray:
    c, f = _split(p).astype(int), _split(_spread(tiles, tile_bits, p.shape)).astype(int)
    green = c[..., 1]
    c[..., 2] = (c[..., 2] + colour_delta(f[..., 0], green)) & 255
    c[..., 0] = (c[..., 0] + colour_delta(f[..., 1], green) + colour_delta(f[..., 2], c[..., 2])) & 255
    return _joined(c)


def _undo_palette(p: np.ndarray, table: np.ndarray, width: int, pack_bits: int) -> np.ndarray:
    index = (p >> 8) & 255
    if pack_bits:
        each = 8 >> pack_bits
        parts = [(index >> (each * k)) & ((1 << each) - 1) for k in range(1 << pack_bits)]
        index = np.stack(parts, -1).reshape(p.shape[0], -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[index]


def decode(data: bytes) -> np.ndarray:
    """A RIFF file with a VP8L chunk as a (height, width) array of uint32 ARGB."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        at += 8 + (size := struct.unpack_from("<I", data, at + 4)[0]) + (size & 1)
        if at + 8 > len(data):
            raise ValueError("no lossless image")
    size = struct.unpack_from("<I", data, at + 4)[0]
    bits = Bits(data[at + 8 : at + 8 + size])
    head = bits.read(40)
    if head & 255 != 0x2F:
        raise ValueError("not a lossless image")
    width, height = (head >> 8 & 0x3FFF) + 1, (head >> 22 & 0x3FFF) + 1
    if head >> 37:
        raise ValueError("unknown version")
    undo, coded_width = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile_bits = bits.read(3) + 2
            shape = _tiles(height, tile_bits), _tiles(coded_width, tile_bits)
            tiles = _read_pixels(bits, shape[1], shape[0], False).reshape(shape)
            f = _undo_predictor if kind == PREDICTOR else _undo_cross_colour
            undo.append(lambda p, f=f, tiles=tiles, b=tile_bits: f(p, tiles, b))
        elif kind == SUBTRACT_GREEN:
            undo.append(_add_green)
        else:
            n = bits.read(8) + 1
            table = _joined(_split(_read_pixels(bits, n, 1, False)).astype(int).cumsum(0) & 255)
            pack_bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append(lambda p, t=table, w=coded_width, b=pack_bits: _undo_palette(p, t, w, b))
            coded_width = _tiles(coded_width, pack_bits)
    p = _read_pixels(bits, coded_width, height, True).reshape(height, coded_width)
    for f in reversed(undo):
        p = f(p)
    return p


def _add_green(p: np.ndarray) -> np.ndarray:
    c = _split(p).astype(int)
    c[..., 0] = (c[..., 0] + c[..., 1]) & 255
    c[..., 2] = (c[..., 2] + c[..., 1]) & 255
    return _joined(c)


class Writer:
    """Little-endian bit writer."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def single(self, symbol: int) -> None:
        """A prefix code of one symbol, which takes no bits."""
        self.put(1, 1)
        self.put(0, 1)
        self.put(1, 1)
        self.put(symbol, 8)


def riff(stream: bytes) -> bytes:
    body = b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def code_lengths(counts, most: int = 15) -> np.ndarray:
    """Lengths of a prefix code of at most ``most`` bits, for symbols with a count; two at least have one."""
    counts = np.asarray(counts)
    used = np.flatnonzero(counts).tolist()
    used += [s for s in (0, 1) if s not in used][: max(0, 2 - len(used))]
    n = len(used)
    weights = np.maximum(counts[used], 1).tolist()
    while True:
        # trees as weight and number in one integer, which compares faster than a pair
        heap = [w << 20 | k for k, w in enumerate(weights)]
        heapq.heapify(heap)
        above = [0] * (2 * n - 1)
        for new in range(n, 2 * n - 1):
            a = heapq.heappop(heap)
            b = heap[0]
            above[a & 0xFFFFF] = above[b & 0xFFFFF] = new
            heapq.heapreplace(heap, ((a >> 20) + (b >> 20)) << 20 | new)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[above[k]] + 1
        if max(depth) <= most:
            break
        weights = [(w + 1) // 2 for w in weights]
    lengths = np.zeros(len(counts), np.uint8)
    lengths[used] = depth[:n]
    return lengths


def codes(lengths) -> np.ndarray:
    """Each symbol's code as its bits are written, lowest first."""
    lengths = np.asarray(lengths, np.uint8)
    used = np.flatnonzero(lengths)
    by = used[np.argsort(lengths[used], kind="stable")]
    widths = 1 << (15 - lengths[by].astype(np.int64))
    out = np.zeros(len(lengths), np.int64)
    out[by] = REVERSED[np.cumsum(widths) - widths]  # a code begins at the highest of 15 bits
    return out


_RUNS = re.compile(rb"\0{3,138}|.", re.S)
# The code that code lengths are written in: lengths from 5 to 9 are the likeliest, 16 is not used.
OF_LENGTHS = (4, 7, 7, 7, 5, 3, 3, 3, 3, 3, 4, 5, 6, 7, 7, 7, 0, 4, 4)


def _run_bits() -> tuple[str, dict[bytes, str]]:
    """How each code begins, and what each run of lengths is written as, in the order of the bits."""
    first = lambda value, n: format(value, f"0{n}b")[::-1]
    written = [first(c, n) if n else "" for c, n in zip(codes(OF_LENGTHS).tolist(), OF_LENGTHS)]
    used = max(k for k, s in enumerate(LENGTH_ORDER) if OF_LENGTHS[s]) + 1
    runs = {bytes([n]): written[n] for n in range(16)}
    runs |= {bytes(n): written[17] + first(n - 3, 3) for n in range(3, 11)} | {bytes(n): written[18] + first(n - 11, 7) for n in range(11, 139)}
    return "0" + first(used - 4, 4) + "".join(first(OF_LENGTHS[s], 3) for s in LENGTH_ORDER[:used]) + "0", runs


_BEGIN, _RUN_BITS = _run_bits()


def code_bits(lengths: np.ndarray) -> tuple[int, int]:
    """A prefix code as it stands in the file, and how many bits that is."""
    said = _BEGIN + "".join(map(_RUN_BITS.__getitem__, _RUNS.findall(lengths.tobytes())))
    return int(said[::-1], 2), len(said)


def _symbols(values: np.ndarray):
    """Symbols, extra bits and how many, of lengths or distances."""
    x = values - 1
    high = np.frexp(np.maximum(x, 1))[1] - 1
    extra = np.where(x < 4, 0, high - 1)
    return np.where(x < 4, x, 2 * high + ((x >> np.maximum(high - 1, 0)) & 1)), x & ((1 << extra) - 1), extra


LONGEST, FARTHEST = 4096, (1 << 20) - 121


def back_references(v: np.ndarray, least: int = 3) -> np.ndarray:
    """Rows (start, length, distance), in order and without overlaps, from pairs of pixels that stood side by side before."""
    n = len(v) - 1
    none = np.zeros((0, 3), np.int64)
    if n < 2:
        return none
    keys = v[:-1].astype(np.int64) << 24 | v[1:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    far = np.zeros(n, np.int64)
    far[order[1:][same]] = (order[1:] - order[:-1])[same]
    far[far > FARTHEST] = 0
    starts = np.flatnonzero(np.diff(far, prepend=-1))
    ends = np.append(starts[1:], n) + 1
    some = (far[starts] > 0) & (ends - starts >= least)
    starts, ends = starts[some], ends[some]
    if not len(starts):
        return none
    starts = np.maximum(starts, np.append(0, np.maximum.accumulate(ends)[:-1]))
    some = ends - starts >= least
    starts, ends = starts[some], ends[some]
    out = np.stack([starts, ends - starts, far[starts]], 1)
    if len(out) and out[:, 1].max() > LONGEST:
        out = np.array([(c, min(LONGEST, a + n - c), d) for a, n, d in out.tolist() for c in range(a, a + n, LONGEST)])
    return out


def _packed_bits(values: np.ndarray, sizes: np.ndarray, first: int) -> int:
    """The values one after the other, each in as many bits as its size (32 at most), from bit ``first`` on."""
    if not len(values):
        return 0
    at = first + np.cumsum(sizes) - sizes
    word, off = at >> 6, (at & 63).astype(np.uint64)
    words = np.zeros(int(word[-1]) + 2, np.uint64)
    begins = np.flatnonzero(np.diff(word, prepend=-1))
    values = values.astype(np.uint64)
    words[word[begins]] = np.add.reduceat(values << off, begins)
    over = np.flatnonzero((at & 63) + sizes > 64)  # one to a word at most
    words[word[over] + 1] += values[over] >> (np.uint64(64) - off[over])
    return int.from_bytes(words.tobytes(), "little")


def _bits(samples: np.ndarray) -> float:
    """About how many bits the samples' symbols (under 256) take."""
    n = np.bincount(samples.ravel(), minlength=256)
    n = n[n > 0]
    return float((n * np.log2(samples.size / n)).sum())


CACHE_BITS = 6


def _put_pixels(w: Writer, green: np.ndarray, red: np.ndarray, blue: np.ndarray, alpha: int, each: float) -> None:
    """An image's codes and pixels go to ``w``.  ``each``: about how many bits a plain pixel takes.

    Back-references or a colour cache, whichever is the likelier to save, stand for repeated pixels.
    """
    n = len(green)
    colours = red << 16 | green << 8 | blue
    copies = back_references(colours)
    by_copies = float((copies[:, 1] * each - 21).sum()) - 80  # less what the code of distances takes
    slots = _slots(colours | alpha << 24, 32 - CACHE_BITS)
    order = np.argsort(slots.astype(np.uint16), kind="stable")
    near, then = order[:-1], order[1:]
    hit = np.zeros(n, bool)
    hit[then] = (slots[then] == slots[near]) & (colours[then] == colours[near])
    by_cache = np.count_nonzero(hit) * (each - CACHE_BITS) - 80
    cached = by_cache > max(0.0, by_copies)
    if cached or by_copies <= 0:
        copies = copies[:0]
    w.put(int(cached), 1)
    if cached:
        w.put(CACHE_BITS, 4)
    w.put(0, 1)  # one group of codes
    kinds, place = green, None
    if cached:
        kinds = np.where(hit, 256 + N_LENGTHS + slots, green)
    elif len(copies):
        edges = np.zeros(n + 1, np.int64)
        edges[copies[:, 0]] += 1
        edges[copies[:, 0] + copies[:, 1]] -= 1
        begun = edges[:-1].cumsum() == 0
        begun[copies[:, 0]] = True
        length, length_extra, length_bits = _symbols(copies[:, 1])
        far, far_extra, far_bits = _symbols(copies[:, 2] + len(NEAR))
        kinds = green.copy()
        kinds[copies[:, 0]] = 256 + length
        place = np.cumsum(begun)[copies[:, 0]] - 1
        kinds, red, blue = kinds[begun], red[begun], blue[begun]
    plain = slice(None)
    if cached or len(copies):
        plain = np.flatnonzero(kinds < 256)
        red, blue = red[plain], blue[plain]
    of_kinds = code_lengths(np.bincount(kinds, minlength=256 + N_LENGTHS + ((1 << CACHE_BITS) if cached else 0)))
    of_both = code_lengths(np.bincount(red, minlength=256) + np.bincount(blue, minlength=256))
    w.put(*code_bits(of_kinds))
    both = code_bits(of_both)
    w.put(*both)
    w.put(*both)
    w.single(alpha)
    values, sizes = np.zeros((4, len(kinds)), np.int64), np.zeros((4, len(kinds)), np.int64)
    values[0], sizes[0] = codes(of_kinds).take(kinds), of_kinds.take(kinds)
    code = codes(of_both)
    for k, c in ((1, red), (2, blue)):
        values[k, plain], sizes[k, plain] = code.take(c), of_both.take(c)
    if place is None:
        w.single(0)
    else:
        of_far = code_lengths(np.bincount(far, minlength=N_DISTANCES))
        w.put(*code_bits(of_far))
        values[1, place], sizes[1, place] = length_extra, length_bits
        values[2, place], sizes[2, place] = codes(of_far).take(far), of_far.take(far)
        values[3, place], sizes[3, place] = far_extra, far_bits
    sizes = sizes.T.ravel()
    some = np.flatnonzero(sizes)
    sizes = sizes[some]
    w.value |= _packed_bits(values.T.ravel()[some], sizes, w.n)
    w.n += int(sizes.sum())


def _differences(c: np.ndarray, mode: int) -> np.ndarray:
    """What predictor 1 (left) or 2 (top) leaves of an image's samples; bytes wrap."""
    out = c.copy()
    if mode == 1:
        out[:, 1:] -= c[:, :-1]
        out[1:, 0] -= c[:-1, 0]
    else:
        out[1:] -= c[:-1]
        out[0, 1:] -= c[0, :-1]
    return out


def encode_bytes(payload: bytes, width: int) -> bytes:
    """One image whose red, green and blue samples are the payload; its length is a multiple of 3 * ``width``."""
    c = np.frombuffer(payload, np.uint8).reshape(-1, width, 3)
    height = len(c)
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)  # no alpha, version 0
    alpha, met = 255, range(17)
    if len(set(payload[0:192:3])) <= 16:
        wide = c.astype(np.int64)
        colours = (wide[..., 0] << 16 | wide[..., 1] << 8 | wide[..., 2]).ravel()
        met = np.unique(colours)
    if len(met) <= 16:  # colours by number, several to a pixel
        n = len(met)
        w.put(1, 1)
        w.put(PALETTE, 2)
        w.put(n - 1, 8)
        parts = np.stack([met >> 16, met >> 8, met], 1) & 255
        parts[1:] -= parts[:-1].copy()  # the table holds differences of the colours, and no more of alpha after the first
        parts &= 255
        w.put(0, 1)  # no cache; groups are the main image's alone
        lengths = [code_lengths(np.bincount(parts[:, k], minlength=256 + (N_LENGTHS if k == 1 else 0))) for k in (1, 0, 2)]
        of_alpha = code_lengths([n - 1] + [0] * 254 + [1])
        for one in (*lengths, of_alpha):
            w.put(*code_bits(one))
        w.single(0)
        written = [codes(one) for one in (*lengths, of_alpha)]
        for k, row in enumerate(parts.tolist()):
            for one, code, v in zip((*lengths, of_alpha), written, (row[1], row[0], row[2], 0 if k else 255)):
                w.put(int(code[v]), int(one[v]))
        pack = 3 if n <= 2 else 2 if n <= 4 else 1
        bits, some = 8 >> pack, 1 << pack
        index = np.searchsorted(met, colours).reshape(height, width)
        index = np.pad(index, ((0, 0), (0, -width % some))).reshape(height, -1, some)
        green = (index << (bits * np.arange(some))).sum(-1).ravel()
        red = blue = np.zeros_like(green)
        each = _bits(green) / len(green)
    else:
        apart = c.copy()
        apart[..., 0::2] -= c[..., 1:2]
        kinds = [c, _differences(c, 1), _differences(c, 2), apart]
        sizes = list(map(_bits, kinds))
        best = sizes.index(min(sizes))
        each = 3 * sizes[best] / c.size
        if best in (1, 2):
            w.put(1, 1)
            w.put(PREDICTOR, 2)
            w.put(7, 3)  # tiles of 512, all of one mode
            w.put(0, 1)
            for s in (best, 0, 0, 255, 0):
                w.single(s)
            alpha = 0
        elif best == 3:
            w.put(1, 1)
            w.put(SUBTRACT_GREEN, 2)
        red, green, blue = kinds[best].reshape(-1, 3).T.astype(np.int64)
    w.put(0, 1)  # no further transform
    _put_pixels(w, green, red, blue, alpha, each)
    return riff(w.value.to_bytes((w.n + 7) // 8, "little"))


def store_payload(payload: bytes, width: int = 192) -> bytes:
    """One or more images, one after the other."""
    step = 3 * width * MOST
    return b"".join(encode_bytes(payload[a : a + step], width) for a in range(0, len(payload), step))


def read_images(media: bytes) -> list[np.ndarray]:
    """The pixels of all images."""
    out, at = [], 0
    while at < len(media):
        n = 8 + struct.unpack_from("<I", media, at + 4)[0]
        out.append(decode(media[at : at + n]))
        at += n
    return out


def samples(p: np.ndarray) -> bytes:
    """Red, green and blue of each pixel."""
    return np.ascontiguousarray(_split(p.ravel())[:, 2::-1]).tobytes()


def read_payload(media: bytes) -> tuple[bytes, list[tuple[int, int]]]:
    """The samples of all images, and the images' (width, height)."""
    images = read_images(media)
    return b"".join(map(samples, images)), [(p.shape[1], p.shape[0]) for p in images]
