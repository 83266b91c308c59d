"""Lossless WebP (VP8L) for batches of images, in numpy.

Both ways run in lockstep: one step handles one symbol or pixel of every image of the batch. Pixels are ARGB in 32 bits.
decode() reads prefix codes (with several groups chosen by an entropy image), back-references and the colour cache, and
inverts the predictor, cross-colour, subtract-green and palette transforms. encode() writes all of these.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np

#: Fixed values of the format: order in which the lengths of the code-length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LITERALS, LENGTH_CODES, DISTANCE_CODES = 256, 24, 40
#: For each symbol of the code-length code, the extra bits behind it and the shortest run that it stands for.
RUN_BITS, RUN_LEAST = np.array([0] * 16 + [2, 3, 7]), np.array([1] * 16 + [3, 3, 11])
HASH = np.uint32(0x1E35A7BD)
PREDICTOR, CROSS, GREEN, PALETTE = range(4)
BLACK = np.uint32(0xFF000000)
#: The (x, y) that distance codes 1..120 stand for: y up to 7 rows above, nearest first, of equals the smaller |x|, then the left.
NEAR = np.array(sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda s: (s[0] ** 2 + s[1] ** 2, abs(s[0]), -s[0])))
#: Longest code, shortest and longest copy, and distances in pixels that encode() makes.
LONGEST, LEAST_COPY, MOST_COPY, DISTANCES = 9, 4, 4096, tuple(range(1, 13))
#: With fewer images than this left in a lockstep, each is finished on its own: a step's cost no longer pays.
FEW = 32
#: Plans that are tried where an estimate speaks for them, blocks of 16 pixels a side; bits that a symbol in use and a palette's colour cost.
PLANS = {"green": [(GREEN,), (CROSS,)], "spatial": [(PREDICTOR,), (PREDICTOR, GREEN), (PREDICTOR, CROSS)], "palette": [(PALETTE,)]}
FITTED_BITS, CODE_BITS, COLOUR_BITS = 4, 4, 24
#: encode() stores code lengths by one fixed code: lengths 3 and 4 for these symbols.
LENGTH_CODE = {7: 3, 8: 3, 9: 3, 18: 3} | dict.fromkeys((0, 1, 2, 3, 4, 5, 6, 17), 4)


def _blocks(size, bits):
    return (size + (1 << bits) - 1) >> bits


def _channels(argb: np.ndarray) -> np.ndarray:
    return np.stack([(argb >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def _argb(channels: np.ndarray) -> np.ndarray:
    c = (channels & 255).astype(np.uint32)
    return (c[..., 0] << np.uint32(24)) | (c[..., 1] << np.uint32(16)) | (c[..., 2] << np.uint32(8)) | c[..., 3]


def _reversed(bits: int) -> np.ndarray:
    out, k = np.zeros(1 << bits, dtype=np.int64), np.arange(1 << bits)
    for b in range(bits):
        out |= ((k >> b) & 1) << (bits - 1 - b)
    return out


def code_tables(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lookup tables of canonical prefix codes, one for each row of lengths: (entries, offset, mask).

    An entry, found by the next bits of the stream, is symbol * 16 + length. A code with one symbol takes no bits.
    """
    used, longest = (lengths > 0).sum(axis=1), lengths.max(axis=1).astype(np.int64)
    longest[used <= 1] = 0
    size = np.int64(1) << longest
    offset = np.cumsum(size) - size
    flat = np.zeros(int(size.sum()), dtype=np.int32)
    alone = np.flatnonzero(longest == 0)
    flat[offset[alone]] = lengths[alone].argmax(axis=1) << 4
    for bits in np.unique(longest[longest > 0]).tolist():
        rows = np.flatnonzero(longest == bits)
        part = lengths[rows].astype(np.int64)
        order = np.argsort(np.where(part == 0, 99, part).astype(np.uint8), axis=1, kind="stable")
        part = np.take_along_axis(part, order, axis=1)
        fill = np.where(part > 0, np.int64(1) << np.maximum(bits - part, 0), 0)
        if (fill.sum(axis=1) != 1 << bits).any():
            raise ValueError("a prefix code is not complete")
        entries = np.repeat((order << 4 | part).ravel(), fill.ravel()).reshape(len(rows), 1 << bits)
        flat[offset[rows][:, None] + np.arange(1 << bits)] = entries[:, _reversed(bits)]
    return flat, offset, size - 1


class _Reader:
    def __init__(self, streams: Sequence[bytes]):
        sizes = np.array([len(s) for s in streams], dtype=np.int64)
        buffer = np.frombuffer(b"".join(s + bytes(16) for s in streams) + bytes(8), dtype=np.uint8)
        self.words = np.lib.stride_tricks.sliding_window_view(buffer, 8).copy().view("<u8").ravel()
        base = np.cumsum(sizes + 16) - (sizes + 16)
        self.pos, self.end = base * 8, (base + sizes) * 8

    def window(self, pos: np.ndarray) -> np.ndarray:
        """57 bits or more from each position; positions past the buffer read its zero end."""
        return (self.words[np.minimum(pos >> 3, len(self.words) - 1)] >> (pos & 7).astype(np.uint64)).astype(np.int64)

    def read(self, lanes: np.ndarray, n) -> np.ndarray:
        pos = self.pos[lanes]
        self.pos[lanes] = pos + n
        return self.window(pos) & ((np.int64(1) << np.asarray(n, dtype=np.int64)) - 1)


def _read_lengths(r: _Reader, lanes: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Code lengths of one prefix code for each lane, a row each."""
    out = np.zeros((len(lanes), int(alphabet.max())), dtype=np.uint8)
    simple = r.read(lanes, 1) == 1
    rows = np.flatnonzero(simple)
    if len(rows):
        at = lanes[rows]
        two, wide = r.read(at, 1) == 1, r.read(at, 1) == 1
        out[rows, r.read(at, np.where(wide, 8, 1))] = 1
        out[rows[two], r.read(at[two], 8)] = 1
    rows = np.flatnonzero(~simple)
    if not len(rows):
        return out
    at = lanes[rows]
    count = 4 + r.read(at, 4)
    kinds = np.zeros((len(rows), 19), dtype=np.uint8)
    for k in range(int(count.max())):
        some = np.flatnonzero(count > k)
        kinds[some, LENGTH_ORDER[k]] = r.read(at[some], 3)
    flat, offset, mask = code_tables(kinds)
    budget = np.full(len(rows), 1 << 30, dtype=np.int64)
    short = np.flatnonzero(r.read(at, 1) == 1)
    if len(short):
        bits = 2 + 2 * r.read(at[short], 3)
        budget[short] = 2 + r.read(at[short], bits)
    live, place, last = np.arange(len(rows)), np.zeros(len(rows), dtype=np.int64), np.full(len(rows), 8)
    full = alphabet[rows]
    while len(live):
        w = r.window(r.pos[at[live]])
        e = flat[offset[live] + (w & mask[live])]
        symbol, used = e >> 4, (e & 15).astype(np.int64)
        w >>= used
        more = RUN_BITS[symbol]
        run = (w & ((1 << more) - 1)) + RUN_LEAST[symbol]
        value = np.where(symbol < 16, symbol, np.where(symbol == 16, last[live], 0))
        r.pos[at[live]] += used + more
        if (place[live] + run > full[live]).any():
            raise ValueError("code lengths run over the alphabet")
        some = np.flatnonzero(value > 0)
        if len(some):
            n = run[some]
            to = np.repeat(place[live[some]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(rows[live[some]], n), to] = np.repeat(value[some], n)
        plain = (symbol < 16) & (symbol > 0)
        last[live[plain]] = symbol[plain]
        place[live] += run
        budget[live] -= 1
        live = live[(place[live] < full[live]) & (budget[live] > 0)]
    return out


def _decode_pixels(r: _Reader, lanes: np.ndarray, width: np.ndarray, height: np.ndarray, top: bool) -> list[np.ndarray]:
    """The pixels of one entropy-coded image of each lane, row by row."""
    cached = r.read(lanes, 1) == 1
    bits = np.zeros(len(lanes), dtype=np.int64)
    bits[cached] = r.read(lanes[cached], 4)
    if (bits[cached] < 1).any() or (bits > 11).any():
        raise ValueError("colour cache size")
    groups, block, choice = np.ones(len(lanes), dtype=np.int64), np.zeros(len(lanes), dtype=np.int64), {}
    if top:
        mixed = np.flatnonzero(r.read(lanes, 1) == 1)
        if len(mixed):
            block[mixed] = r.read(lanes[mixed], 3) + 2
            for k, image in zip(mixed, _decode_pixels(r, lanes[mixed], _blocks(width[mixed], block[mixed]), _blocks(height[mixed], block[mixed]), False), strict=True):
                choice[k] = ((image >> np.uint32(8)) & np.uint32(0xFFFF)).astype(np.int64)
                groups[k] = choice[k].max() + 1
    first_row = np.cumsum(groups) - groups
    alphabet = [LITERALS + LENGTH_CODES + np.where(bits > 0, 1 << bits, 0), *[np.full(len(lanes), 256)] * 3, np.full(len(lanes), DISTANCE_CODES)]
    lengths = [np.zeros((int(groups.sum()), int(a.max())), dtype=np.uint8) for a in alphabet]
    for g in range(int(groups.max())):
        some = np.flatnonzero(groups > g)
        for j in range(5):
            found = _read_lengths(r, lanes[some], alphabet[j][some])
            lengths[j][first_row[some] + g, : found.shape[1]] = found
    built = [code_tables(x) for x in lengths]
    start = np.cumsum([0, *[len(b[0]) for b in built]])
    flat = np.concatenate([b[0] for b in built])
    offset, mask = [b[1] + s for b, s in zip(built, start)], [b[2] for b in built]
    total = width * height
    off = np.cumsum(total) - total
    out = np.zeros(int(total.sum()), dtype=np.uint32)
    cache_at = np.cumsum(np.where(bits > 0, 1 << bits, 0)) - np.where(bits > 0, 1 << bits, 0)
    cache = np.zeros(int(np.where(bits > 0, 1 << bits, 0).sum()) + 1, dtype=np.uint32)
    chosen = np.concatenate([choice[k] for k in sorted(choice)]) if choice else None
    chosen_at = np.zeros(len(lanes), dtype=np.int64)
    if choice:
        sizes = np.array([len(choice.get(k, ())) for k in range(len(lanes))])
        chosen_at = np.cumsum(sizes) - sizes
    lane = np.flatnonzero(total > 0)
    pos, p, left, dist = r.pos[lanes[lane]], np.zeros(len(lane), dtype=np.int64), np.zeros(len(lane), dtype=np.int64), np.ones(len(lane), dtype=np.int64)
    to, n, row0 = off[lane].copy(), total[lane], first_row[lane]
    any_cache, all_cache = bool((bits > 0).any()), bool((bits > 0).all())
    shift, cache0 = (32 - bits[lane]).astype(np.uint32), cache_at[lane]
    final = r.pos.copy()

    def lookup(j: int, row: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = flat[offset[j][row] + (w & mask[j][row])]
        return e >> 4, e & 15

    def spread(symbol: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of a length or distance symbol, and the position behind its extra bits."""
        more = np.where(symbol < 4, 0, (symbol - 2) >> 1)
        value = np.where(symbol < 4, symbol, (2 + (symbol & 1)) << more)
        return value + (r.window(at) & ((np.int64(1) << more) - 1)) + 1, at + more

    def finish(i: int) -> None:
        """The rest of one image, pixel by pixel: long images don't hold up the lockstep."""
        k, at, here = int(lane[i]), int(pos[i]), int(p[i])
        base, end, wide, b, slots = int(off[k]), int(n[i]), int(width[k]), int(block[k]), int(cache_at[k])
        lowest = at >> 3
        words = r.words[lowest : (int(r.end[lanes[k]]) >> 3) + 9].tolist() + [0] * 9
        rows = [[(flat[offset[j][row] : offset[j][row] + int(mask[j][row]) + 1].tolist(), int(mask[j][row])) for j in range(5)] for row in range(int(first_row[k]), int(first_row[k] + groups[k]))]
        which = chosen[chosen_at[k] : chosen_at[k] + len(choice[k])].tolist() if b else None
        across = int(_blocks(width[k], block[k])) if b else 0
        done = out[base : base + here].tolist()
        held = cache[slots : slots + (1 << int(bits[k]))].tolist() if bits[k] else None
        drop, factor = 32 - int(bits[k]), int(HASH)
        most = 8 * len(words) - 80
        (green, gm), (reds, rm), (blues, bm), (alphas, am), (dists, dm) = rows[0]
        at -= lowest << 3

        def copy(length: int, back: int) -> None:
            for _ in range(length):
                v = done[-back]
                done.append(v)
                if held:
                    held[((v * factor) & 0xFFFFFFFF) >> drop] = v

        if left[i]:
            copy(int(left[i]), int(dist[i]))
        while len(done) < end:
            if at > most:
                raise ValueError("a stream ends early")
            if which:
                (green, gm), (reds, rm), (blues, bm), (alphas, am), (dists, dm) = rows[which[(len(done) // wide >> b) * across + (len(done) % wide >> b)]]
            w = words[at >> 3] >> (at & 7)
            e = green[w & gm]
            symbol = e >> 4
            at += e & 15
            if symbol < LITERALS:
                red = reds[(w >> (e & 15)) & rm]
                at += red & 15
                w = words[at >> 3] >> (at & 7)
                blue = blues[w & bm]
                alpha = alphas[(w >> (blue & 15)) & am]
                at += (blue & 15) + (alpha & 15)
                v = (alpha >> 4) << 24 | (red >> 4) << 16 | symbol << 8 | blue >> 4
            elif symbol >= LITERALS + LENGTH_CODES:
                v = held[symbol - LITERALS - LENGTH_CODES]
            else:
                sizes = []
                for code in (symbol - LITERALS, None):
                    w = words[at >> 3] >> (at & 7)
                    if code is None:
                        e = dists[w & dm]
                        code, at, w = e >> 4, at + (e & 15), w >> (e & 15)
                    more = 0 if code < 4 else (code - 2) >> 1
                    sizes.append((code if code < 4 else (2 + (code & 1)) << more) + (w & ((1 << more) - 1)) + 1)
                    at += more
                length, back = sizes
                back = back - 120 if back > 120 else max(int(NEAR[back - 1, 0]) + int(NEAR[back - 1, 1]) * wide, 1)
                if back > len(done) or length > end - len(done):
                    raise ValueError("a back-reference leaves the image")
                copy(length, back)
                continue
            done.append(v)
            if held:
                held[((v * factor) & 0xFFFFFFFF) >> drop] = v
        out[base : base + end] = done
        final[lanes[k]] = at + (lowest << 3)

    while len(lane):
        if len(lane) < FEW:
            for i in range(len(lane)):
                finish(i)
            break
        value = np.empty(len(lane), dtype=np.uint32)
        busy = left > 0
        if busy.any():
            c = np.flatnonzero(busy)
            value[c] = out[to[c] - dist[c]]
            left[c] -= 1
            d = np.flatnonzero(~busy)
        else:
            d = np.arange(len(lane))
        if len(d):
            row, at = row0[d], pos[d]
            if choice:
                k = lane[d]
                x, y = p[d] % width[k], p[d] // width[k]
                place = (y >> block[k]) * _blocks(width[k], block[k]) + (x >> block[k])
                row = row + np.where(block[k] > 0, chosen[np.where(block[k] > 0, chosen_at[k] + place, 0)], 0)
            w = r.window(at)
            symbol, used = lookup(0, row, w)
            literal = symbol < LITERALS
            if literal.all():
                i, wi, ri, ui, si = slice(None), w, row, used, symbol
            else:
                i = np.flatnonzero(literal)
                wi, ri, ui, si = w[i], row[i], used[i], symbol[i]
            if len(si):
                wi = wi >> ui
                red, u1 = lookup(1, ri, wi)
                wi = r.window(at[i] + ui + u1)
                blue, u2 = lookup(2, ri, wi)
                alpha, u3 = lookup(3, ri, wi >> u2)
                value[d[i]] = (alpha.astype(np.uint32) << np.uint32(24)) | (red << 16 | si << 8 | blue).astype(np.uint32)
                used[i] = ui + u1 + u2 + u3
            at = at + used
            if len(si) < len(d):
                i = np.flatnonzero(symbol >= LITERALS + LENGTH_CODES)
                value[d[i]] = cache[cache0[d[i]] + symbol[i] - (LITERALS + LENGTH_CODES)]
                i = np.flatnonzero(~literal & (symbol < LITERALS + LENGTH_CODES))
                if len(i):
                    length, at2 = spread(symbol[i].astype(np.int64) - LITERALS, at[i])
                    code, u = lookup(4, row[i], r.window(at2))
                    back, at[i] = spread(code.astype(np.int64), at2 + u)
                    near = NEAR[np.minimum(back, 120) - 1]
                    back = np.where(back > 120, back - 120, np.maximum(near[:, 0] + near[:, 1] * width[lane[d[i]]], 1))
                    if (back > p[d[i]]).any() or (length > n[d[i]] - p[d[i]]).any():
                        raise ValueError("a back-reference leaves the image")
                    value[d[i]] = out[to[d[i]] - back]
                    left[d[i]], dist[d[i]] = length - 1, back
            pos[d] = at
        out[to] = value
        if any_cache:
            if all_cache:
                cache[cache0 + ((value * HASH) >> shift)] = value
            else:
                c = np.flatnonzero(shift < 32)
                cache[cache0[c] + ((value[c] * HASH) >> shift[c])] = value[c]
        p += 1
        to += 1
        done = p >= n
        if done.any():
            final[lanes[lane[done]]] = pos[done]
            keep = np.flatnonzero(~done)
            lane, pos, p, left, dist, to, n, row0, shift, cache0 = (x[keep] for x in (lane, pos, p, left, dist, to, n, row0, shift, cache0))
    r.pos = final
    return np.split(out, off[1:])


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _guesses(left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> list[np.ndarray]:
    """What each of the 14 modes predicts from the pixels at the left, top, top right and top left; channels last."""
    nearer = np.abs(top - corner).sum(-1) < np.abs(left - corner).sum(-1)
    half = _average(left, top)
    diff = half - corner
    return [
        np.broadcast_to(np.array([255, 0, 0, 0]), left.shape), left, top, right, corner,
        _average(_average(left, right), top), _average(left, corner), half, _average(corner, top), _average(top, right),
        _average(_average(left, corner), _average(top, right)), np.where(nearer[..., None], left, top),
        np.clip(left + top - corner, 0, 255), np.clip(half + np.sign(diff) * (np.abs(diff) >> 1), 0, 255),
    ]


def _predicted(mode: np.ndarray, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Predictions by mode."""
    return np.choose(np.minimum(mode, 13)[..., None], _guesses(left, top, right, corner))


def _around(image: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """The channels of each pixel of an image, put end to end, and those at its left, top, top right and top left (zeros outside)."""
    width = image.shape[1]
    c = np.pad(_channels(image).reshape(-1, 4), ((width + 1, 1), (0, 0)))
    k = np.arange(image.size) + width + 1
    return c[k], (c[k - 1], c[k - width], c[k - width + 1], c[k - width - 1])


def _block_map(image: np.ndarray, width: int, height: int, bits: int) -> np.ndarray:
    """The block image's pixel for each pixel."""
    image = image.reshape(_blocks(height, bits), _blocks(width, bits))
    return image[np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits]


def _undo_predictors(residuals: Sequence[np.ndarray], modes: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Inverts the predictor of many images at once: a step takes the pixels of all images whose left, top and top right are known, x + 2 y
    being equal. The first row and column have modes of their own."""
    size = np.array([r.size for r in residuals])
    width = np.repeat([r.shape[1] for r in residuals], size)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    x, y = place % width, place // width
    mode = np.concatenate([m.ravel() for m in modes])
    add = _channels(np.concatenate([r.ravel() for r in residuals]))
    out = np.zeros((len(place), 4), dtype=np.int32)
    order = np.argsort(x + 2 * y, kind="stable")
    for at in np.split(order, np.cumsum(np.bincount(x + 2 * y))[:-1]):
        left, top, right, corner = (out[np.maximum(at - back, 0)] for back in (1, width[at], width[at] - 1, width[at] + 1))
        guess = _predicted(mode[at], left, top, right, corner)
        guess = np.where((x[at] == 0)[:, None], top, guess)
        guess = np.where((y[at] == 0)[:, None], left, guess)
        guess = np.where((place[at] == 0)[:, None], np.array([255, 0, 0, 0]), guess)
        out[at] = (add[at] + guess) & 255
    return [part.reshape(r.shape) for part, r in zip(np.split(_argb(out), np.cumsum(size)[:-1]), residuals, strict=True)]


def _cross(argb: np.ndarray, factors: np.ndarray, sign: int) -> np.ndarray:
    """Adds (sign 1) or takes off (-1) the part of red and blue that green and red foretell."""
    c = _channels(argb)

    def signed(x: np.ndarray) -> np.ndarray:
        return ((x & 255) ^ 128) - 128

    to_red, green_blue, red_blue = (signed(((factors >> np.uint32(s)) & np.uint32(255)).astype(np.int32)) for s in (0, 8, 16))
    green, red = signed(c[..., 2]), c[..., 1] + sign * ((to_red * signed(c[..., 2])) >> 5)
    known_red = signed(red) if sign > 0 else signed(c[..., 1])
    c[..., 3] += sign * (((green_blue * green) >> 5) + ((red_blue * known_red) >> 5))
    c[..., 1] = red
    return _argb(c)


def _green(argb: np.ndarray, sign: int) -> np.ndarray:
    c = _channels(argb)
    c[..., 1] += sign * c[..., 2]
    c[..., 3] += sign * c[..., 2]
    return _argb(c)


def _palette_bits(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def _undo_palette(packed: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    bits = _palette_bits(len(palette))
    index = ((packed >> np.uint32(8)) & np.uint32(255)).astype(np.int64)
    per = 8 >> bits
    index = ((index[:, :, None] >> (np.arange(1 << bits) * per)) & ((1 << per) - 1)).reshape(len(packed), -1)[:, :width]
    return np.append(palette, np.zeros(256 - len(palette), dtype=np.uint32))[index]


def decode(files: Sequence[bytes]) -> list[np.ndarray]:
    """The pixels (height x width, ARGB) of each lossless WebP file; ValueError where one is broken."""
    streams = []
    for f in files:
        if f[:4] != b"RIFF" or f[8:16] != b"WEBPVP8L" or len(f) < 25 or f[20] != 0x2F:
            raise ValueError("not a simple lossless WebP file")
        streams.append(f[20 : 20 + struct.unpack("<I", f[16:20])[0]])
    if not streams:
        return []
    r, lanes = _Reader(streams), np.arange(len(streams))
    r.read(lanes, 8)
    width, height = r.read(lanes, 14) + 1, r.read(lanes, 14) + 1
    r.read(lanes, 1)
    if r.read(lanes, 3).any():
        raise ValueError("version")
    steps: list[list[tuple]] = [[] for _ in streams]
    inner = width.copy()
    more = lanes
    while len(more := more[r.read(more, 1) == 1]):
        kind = r.read(more, 2)
        for want in (PREDICTOR, CROSS):
            some = more[kind == want]
            if len(some):
                bits = r.read(some, 3) + 2
                for k, b, image in zip(some, bits, _decode_pixels(r, some, _blocks(inner[some], bits), _blocks(height[some], bits), False), strict=True):
                    steps[k].append((want, int(inner[k]), int(b), image))
        for k in more[kind == GREEN]:
            steps[k].append((GREEN,))
        some = more[kind == PALETTE]
        if len(some):
            size = r.read(some, 8) + 1
            for k, image in zip(some, _decode_pixels(r, some, size, np.ones_like(size), False), strict=True):
                steps[k].append((PALETTE, int(inner[k]), _argb(np.cumsum(_channels(image), axis=0))))
                inner[k] = _blocks(inner[k], _palette_bits(len(image)))
    images = [x.reshape(h, w) for x, w, h in zip(_decode_pixels(r, lanes, inner, height, True), inner, height, strict=True)]
    if (r.pos > r.end).any():
        raise ValueError("a stream ends early")
    while any(steps):
        spatial = []
        for k, todo in enumerate(steps):
            while todo and todo[-1][0] != PREDICTOR:
                step = todo.pop()
                if step[0] == GREEN:
                    images[k] = _green(images[k], 1)
                elif step[0] == PALETTE:
                    images[k] = _undo_palette(images[k], step[2], step[1])
                else:
                    images[k] = _cross(images[k], _block_map(step[3], step[1], len(images[k]), step[2]), 1)
            if todo:
                spatial.append((k, todo.pop()))
        if spatial:
            modes = [(_block_map(step[3], step[1], len(images[k]), step[2]) >> np.uint32(8)).astype(np.int64) & 15 for k, step in spatial]
            for (k, _), image in zip(spatial, _undo_predictors([images[k] for k, _ in spatial], modes), strict=True):
                images[k] = image
    return images


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of a complete prefix code for each row of counts: near -log2 of the share, at most `longest`."""
    used = counts > 0
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    wanted = np.ceil(np.log2(total / np.maximum(counts, 1)))
    lengths = np.where(used, np.clip(wanted, 1, longest), 0).astype(np.int64)
    order = np.argsort(-counts, axis=1, kind="stable")[:, : int(used.sum(axis=1).max(initial=1))]
    rows = np.flatnonzero(used.sum(axis=1) > 1)
    whole = 1 << longest

    def spent() -> np.ndarray:
        return np.where(lengths[rows] > 0, whole >> lengths[rows], 0).sum(axis=1)

    have = spent()
    while len(rows) and (have > whole).any():  # lengthen the rarest codes
        for k in range(order.shape[1] - 1, -1, -1):
            at = order[rows, k]
            now = lengths[rows, at]
            fits = (have > whole) & (now > 0) & (now < longest)
            have -= np.where(fits, (whole >> now) // 2, 0)
            lengths[rows, at] = now + fits
    while len(rows) and (have < whole).any():  # give what is left to the most frequent ones that it suffices for
        for k in range(order.shape[1]):
            at = order[rows, k]
            now = lengths[rows, at]
            cost = np.where(now > 0, whole >> now, whole + 1)
            fits = (now > 1) & (have + cost <= whole)
            have += np.where(fits, cost, 0)
            lengths[rows, at] = now - fits
    return lengths


def _codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes of each row of lengths, bits reversed as the stream wants them; a lone symbol has no bits."""
    longest = int(lengths.max(initial=0))
    order = np.argsort(np.where(lengths == 0, 99, lengths).astype(np.uint8), axis=1, kind="stable")
    part = np.take_along_axis(lengths, order, axis=1)
    size = np.where(part > 0, np.int64(1) << np.maximum(longest - part, 0), 0)
    code = (np.cumsum(size, axis=1) - size) >> np.maximum(longest - part, 0)
    back = _reversed(max(longest, 1))
    back = back[np.clip(code << np.maximum(max(longest, 1) - part, 0), 0, len(back) - 1)]
    out = np.zeros_like(back)
    np.put_along_axis(out, order, np.where(part > 0, back, 0), axis=1)
    return out


class _Tokens:
    """Bit fields of many images, in the order of the streams."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def put(self, image: np.ndarray, value, bits) -> None:
        self.parts.append((image.astype(np.int32), np.broadcast_to(np.asarray(value, dtype=np.int64), image.shape), np.broadcast_to(np.asarray(bits, dtype=np.int64), image.shape)))

    def packed(self, n: int) -> list[bytes]:
        image, value, bits = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        order = np.argsort(image.astype(np.int16) if n < 1 << 15 else image, kind="stable")
        image, value, bits = image[order], value[order].astype(np.uint64), bits[order]
        size = np.bincount(image, weights=bits, minlength=n).astype(np.int64)
        words = (size + 31) // 32 + 2
        base = (np.cumsum(words) - words) * 32
        ends = np.cumsum(bits)
        at = base[image] + ends - bits - (np.cumsum(size) - size)[image]
        out = np.zeros(int(words.sum()) + 2, dtype=np.uint64)
        word, shift = at >> 5, (at & 31).astype(np.uint64)
        cuts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        low, high = value << shift, np.where(shift > 0, value >> (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        for k, piece in enumerate((low & np.uint64(0xFFFFFFFF), low >> np.uint64(32), high)):  # fields don't overlap, so sums are unions
            out[word[cuts] + k] += np.add.reduceat(piece, cuts)
        data = out.astype("<u4").tobytes()
        starts = (base // 8).tolist()
        return [data[a : a + (s + 7) // 8] for a, s in zip(starts, size.tolist(), strict=True)]


def _prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, number of extra bits, extra bits) of lengths and distances from 1."""
    v = value - 1
    high = np.floor(np.log2(np.maximum(v, 1))).astype(np.int64)
    more = np.where(v < 4, 0, high - 1)
    return np.where(v < 4, v, 2 * high + ((v >> np.maximum(high - 1, 0)) & 1)), more, v & ((np.int64(1) << more) - 1)


def _copies(pixels: np.ndarray, image: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, distance) at the pixels where a copy starts (else 0) and -1 inside one: runs equal to what stands a few pixels before."""
    n = len(pixels)
    length, dist = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    free = np.ones(n, dtype=bool)
    place = np.arange(n) - first[image]
    for d in DISTANCES:
        same = np.zeros(n, dtype=bool)
        if n > d:
            same[d:] = pixels[d:] == pixels[:-d]
        same &= free & (place >= d)
        edge = np.diff(np.concatenate([[0], same.view(np.int8), [0]]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(begin):  # a run may touch the next image's
            cut = image[begin] != image[end - 1]
            if cut.any():
                border = first[image[end[cut] - 1]]
                begin, end = np.concatenate([begin, border]), np.concatenate([np.where(cut, first[image[end - 1]], end), end[cut]])
            keep = end - begin >= LEAST_COPY
            for a, b in zip(begin[keep].tolist(), end[keep].tolist()):
                free[a:b] = False
                length[a:b] = -1
                for s in range(a, b, MOST_COPY):
                    length[s], dist[s] = min(MOST_COPY, b - s), d
    return length, dist


def _put_code(t: _Tokens, lengths: np.ndarray, owners: np.ndarray) -> None:
    """The stored form of one prefix code of each of the owners (a row each)."""
    images = np.arange(len(lengths))
    used = (lengths > 0).sum(axis=1)
    lone = np.flatnonzero(used <= 1)
    if len(lone):
        symbol = lengths[lone].argmax(axis=1)
        if (symbol > 255).any():  # has to be stored at length: a lone symbol beyond the simple form
            far = lone[symbol > 255]
            lengths = lengths.copy()
            lengths[far, symbol[symbol > 255]] = 1
            lone, symbol = lone[symbol <= 255], symbol[symbol <= 255]
        t.put(owners[lone], 1 | 0 << 1 | 1 << 2 | symbol << 3, 11)
    many = np.setdiff1d(images, lone)
    if not len(many):
        return
    t.put(owners[many], 13 - 4 << 1, 5)
    for kind in LENGTH_ORDER[:13]:
        t.put(owners[many], LENGTH_CODE.get(kind, 0), 3)
    t.put(owners[many], 0, 1)
    part = lengths[many]
    kinds = np.zeros((1, 19), dtype=np.int64)
    kinds[0, list(LENGTH_CODE)] = list(LENGTH_CODE.values())
    code = _codes(kinds)[0]
    flat = part.ravel()
    width = part.shape[1]
    zero = flat == 0
    begins = zero.copy()
    begins[1:] &= ~zero[:-1] | (np.arange(1, len(flat)) % width == 0)
    at = np.flatnonzero(begins)
    stops = np.concatenate([~zero[1:] | (np.arange(1, len(flat)) % width == 0), [True]]) & zero
    run = np.flatnonzero(stops) + 1 - at
    longs, rest = run // 138, run % 138
    singles = np.where(rest < 3, rest, 0)
    pieces = longs + np.where(rest >= 3, 1, singles)
    owner = np.repeat(np.arange(len(run)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    is_long = nth < longs[owner]
    last = ~is_long & (rest[owner] >= 3)
    eighteen = is_long | (last & (rest[owner] >= 11))
    seventeen = last & ~eighteen
    symbol = np.where(eighteen, 18, np.where(seventeen, 17, 0))
    amount = np.where(is_long, 138, rest[owner])
    value = code[symbol] | np.where(eighteen, (amount - 11) << LENGTH_CODE[18], np.where(seventeen, (amount - 3) << LENGTH_CODE[17], 0))
    bits = np.array([LENGTH_CODE.get(k, 0) for k in range(19)])[symbol] + np.where(eighteen, 7, np.where(seventeen, 3, 0))
    other = np.flatnonzero(~zero)
    place = np.concatenate([at[owner], other])
    order = np.argsort(place, kind="stable")
    value, bits = np.concatenate([value, code[flat[other]]])[order], np.concatenate([bits, np.array([LENGTH_CODE.get(k, 0) for k in range(19)])[flat[other]]])[order]
    t.put(owners[many[place[order] // width]], value, bits)


def _put_pixels(t: _Tokens, images: list[np.ndarray], cache_bits: int = 0, top: bool = False, groups: int = 1, group_bits: int = 2) -> None:
    """One entropy-coded image of each stream. groups over 1: blocks take turns in as many groups of codes."""
    n = len(images)
    every = np.arange(n)
    size = np.array([i.size for i in images], dtype=np.int64)
    first = np.cumsum(size) - size
    pixels, image = np.concatenate([i.ravel() for i in images]), np.repeat(every, size)
    t.put(every, 1 | cache_bits << 1 if cache_bits else 0, 5 if cache_bits else 1)
    group = np.zeros(len(pixels), dtype=np.int64)
    if top:
        t.put(every, int(groups > 1), 1)
        if groups > 1:
            t.put(every, group_bits - 2, 3)
            maps = [(np.arange(_blocks(i.shape[0], group_bits) * _blocks(i.shape[1], group_bits)) % groups).astype(np.uint32) << np.uint32(8) for i in images]
            _put_pixels(t, [m.reshape(_blocks(i.shape[0], group_bits), -1) for m, i in zip(maps, images, strict=True)])
            group = np.concatenate([_block_map(m >> np.uint32(8), i.shape[1], i.shape[0], group_bits).ravel().astype(np.int64) for m, i in zip(maps, images, strict=True)])
    length, dist = _copies(pixels, image, first)
    samples = pixels.astype("<u4").view(np.uint8).reshape(-1, 4)  # blue, green, red, alpha
    symbol = samples[:, 1].astype(np.int64)
    literal = length == 0
    if cache_bits:
        key = ((pixels * HASH) >> np.uint32(32 - cache_bits)).astype(np.int64)
        slot = (image << cache_bits) + key
        order = np.argsort(slot.astype(np.int32), kind="stable")
        held = np.zeros(len(pixels), dtype=bool)
        held[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (pixels[order[1:]] == pixels[order[:-1]])
        held &= literal
        symbol[held] = LITERALS + LENGTH_CODES + key[held]
        literal &= ~held
    begin = np.flatnonzero(length > 0)
    len_symbol, len_more, len_extra = _prefix(length[begin])
    dist_symbol, dist_more, dist_extra = _prefix(dist[begin] + 120)
    symbol[begin] = LITERALS + len_symbol
    written = np.flatnonzero(length >= 0)
    rows = image * groups + group if groups > 1 else image
    sizes = (LITERALS + LENGTH_CODES + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    lit = np.flatnonzero(literal)
    lit_rows = rows[lit]
    uses = [(rows[written], symbol[written]), *[(lit_rows, samples[lit, j]) for j in (2, 0, 3)], (rows[begin], dist_symbol)]
    lengths = [code_lengths(np.bincount(r * s + v, minlength=n * groups * s).reshape(n * groups, s)) for (r, v), s in zip(uses, sizes, strict=True)]
    blocks = np.array([_blocks(i.shape[0], group_bits) * _blocks(i.shape[1], group_bits) for i in images])
    for g in range(groups):
        some = np.flatnonzero(blocks > g)  # an image of few blocks has no more groups than these
        for x in lengths:
            if len(some):
                _put_code(t, x[g::groups][some], some)
    for x in lengths:  # a lone symbol takes no bits
        x[(x > 0).sum(axis=1) == 1] = 0
    tables = [(_codes(x) << 4 | x).ravel() for x in lengths]
    value, bits = np.zeros(len(pixels), dtype=np.int64), np.zeros(len(pixels), dtype=np.int64)
    keys = [r * s + v for (r, v), s in zip(uses, sizes, strict=True)]
    first_code = tables[0][keys[0]]
    value[written], bits[written] = first_code >> 4, first_code & 15
    if len(lit):
        v, n_bits = value[lit], bits[lit]
        for j in (1, 2, 3):
            code = tables[j][keys[j]]
            v |= (code >> 4) << n_bits
            n_bits += code & 15
        value[lit], bits[lit] = v, n_bits
    if len(begin):
        v, n_bits = value[begin], bits[begin]
        code = tables[4][keys[4]]
        for more, size in ((len_extra, len_more), (code >> 4, code & 15), (dist_extra, dist_more)):
            v |= more << n_bits
            n_bits += size
        value[begin], bits[begin] = v, n_bits
    t.put(image[written], value[written], bits[written])


def _estimates(images: Sequence[np.ndarray]) -> dict[str, np.ndarray]:
    """Bits of each image by the entropy of its samples, as they are, less green, less the pixel before, both, and by a palette (inf over 256
    colours). A pixel equal to the one before is part of a copy and costs nothing; a symbol in use costs its place in a code."""
    n = len(images)
    size = np.array([i.size for i in images])
    pixels, image = np.concatenate([i.ravel() for i in images]), np.repeat(np.arange(n), size)
    before = np.concatenate([BLACK.reshape(1), pixels[:-1]])
    before[np.cumsum(size) - size] = BLACK
    new = np.flatnonzero(pixels != before)
    pixels, before, image = pixels[new], before[new], image[new]

    def bits(owner: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.bincount(owner, weights=counts, minlength=n)
        spread = np.bincount(owner, weights=counts * np.log2(np.maximum(counts, 1)), minlength=n)
        return total * np.log2(np.maximum(total, 1)) - spread + CODE_BITS * np.bincount(owner, weights=counts > 0, minlength=n)

    def samples(values: Sequence[np.ndarray]) -> np.ndarray:
        owner = np.repeat(np.arange(n), 256)
        return sum(bits(owner, np.bincount(image * 256 + v, minlength=n * 256)) for v in values)

    def less_green(b: np.ndarray, g: np.ndarray, r: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, ...]:
        return b - g, g, r - g, a

    now = tuple(np.ascontiguousarray(pixels).astype("<u4").view(np.uint8).reshape(-1, 4).T)
    step = tuple(a - b for a, b in zip(now, before.astype("<u4").view(np.uint8).reshape(-1, 4).T, strict=True))
    colours, counts = np.unique(image.astype(np.uint64) << np.uint64(32) | pixels, return_counts=True)
    owner = (colours >> np.uint64(32)).astype(np.int64)
    number = np.bincount(owner, minlength=n) + 1
    palette = np.where(number <= 256, bits(owner, counts) + COLOUR_BITS * number, np.inf)
    return {"plain": samples(now), "green": samples(less_green(*now)), "spatial": np.minimum(samples(step), samples(less_green(*step))), "palette": palette}


def _smallest(images: Sequence[np.ndarray], cache_bits: int) -> list[bytes]:
    """A file of each image without transforms, or with those of the plans that its estimate speaks for if that is smaller."""
    files = encode(images, cache_bits)
    bits = _estimates(images)
    for way, plans in PLANS.items():
        some = np.flatnonzero(bits[way] < bits["plain"])
        if way == "palette":  # black, before the first pixel, may be a colour less or one more
            some = some[[len(np.unique(images[k])) <= 256 for k in some]] if len(some) else some
        for plan in plans if len(some) else ():
            for k, other in zip(some, encode([images[k] for k in some], cache_bits, plan, 1, FITTED_BITS, True), strict=True):
                files[k] = min(files[k], other, key=len)
    return files


def _fitted_modes(image: np.ndarray, bits: int) -> np.ndarray:
    """The mode of each block that leaves the least differences, as a block image."""
    c, around = _around(image)
    h, w = _blocks(image.shape[0], bits), _blocks(image.shape[1], bits)
    block = _block_map(np.arange(h * w), image.shape[1], image.shape[0], bits).ravel()
    cost = [np.bincount(block, weights=np.abs((((c - g) & 255) ^ 128) - 128).sum(axis=1), minlength=h * w) for g in _guesses(*around)]
    return np.argmin(cost, axis=0).reshape(h, w).astype(np.uint32) << np.uint32(8)


def _fitted_factors(image: np.ndarray, bits: int) -> np.ndarray:
    """The factors of each block that foretell red and blue from green, and the rest of blue from red, with the least squares."""
    c = (_channels(image).reshape(-1, 4) ^ 128) - 128
    red, green, blue = c[:, 1], c[:, 2], c[:, 3].astype(np.float64)
    h, w = _blocks(image.shape[0], bits), _blocks(image.shape[1], bits)
    block = _block_map(np.arange(h * w), image.shape[1], image.shape[0], bits).ravel()

    def factor(of: np.ndarray, by: np.ndarray) -> np.ndarray:
        up, down = (np.bincount(block, weights=x * by, minlength=h * w) for x in (of, by))
        return np.clip(np.rint(32 * up / np.maximum(down, 1)), -128, 127).astype(np.int64)

    to_red, green_blue = factor(red, green), factor(blue, green)
    red_blue = factor(blue - (green_blue[block] * green >> 5), red)
    return ((to_red & 255) | (green_blue & 255) << 8 | (red_blue & 255) << 16).astype(np.uint32).reshape(h, w)


def encode(images: Sequence[np.ndarray], cache_bits: int = 0, transforms: Sequence[int] | None = (), groups: int = 1, block_bits: int = 2, fitted: bool = False) -> list[bytes]:
    """A lossless WebP file of each image (height x width, ARGB, at most 16,384 a side).

    transforms, applied in order: PREDICTOR (the blocks take turns in all 14 modes; fitted: each the best one), CROSS (fixed factors by
    block; fitted: by least squares), GREEN, PALETTE (an image of at most 256 colours; first in the list). None: those that
    make each image's file smallest, fitted.
    """
    if not images:
        return []
    if transforms is None:
        return _smallest(images, cache_bits)
    n = len(images)
    every, t = np.arange(n), _Tokens()
    if any(max(i.shape) > 1 << 14 or not i.size for i in images):
        raise ValueError("an image has 1 to 16,384 pixels a side")
    height, width = (np.array([i.shape[k] for i in images]) for k in (0, 1))
    t.put(every, 0x2F | (width - 1) << 8 | (height - 1) << 22 | 1 << 36, 40)
    now = [np.asarray(i, dtype=np.uint32) for i in images]
    for kind in transforms:
        t.put(every, 1 | kind << 1, 3)
        if kind == GREEN:
            now = [_green(i, -1) for i in now]
        elif kind == PALETTE:
            colours = [np.unique(i) for i in now]
            if max(map(len, colours)) > 256:
                raise ValueError("over 256 colours")
            t.put(every, np.array([len(c) - 1 for c in colours]), 8)
            _put_pixels(t, [_argb(np.diff(_channels(c), axis=0, prepend=0))[None, :] for c in colours])
            packed = []
            for i, c in zip(now, colours, strict=True):
                bits = _palette_bits(len(c))
                index = np.pad(np.searchsorted(c, i), ((0, 0), (0, -i.shape[1] % (1 << bits))))
                index = (index.reshape(len(i), -1, 1 << bits) << (np.arange(1 << bits) * (8 >> bits))).sum(axis=2)
                packed.append((index.astype(np.uint32) << np.uint32(8)) | BLACK)
            now = packed
        else:
            t.put(every, block_bits - 2, 3)
            sizes = [(_blocks(i.shape[0], block_bits), _blocks(i.shape[1], block_bits)) for i in now]
            turn = [np.arange(h * w).reshape(h, w).astype(np.uint32) for h, w in sizes]
            blocks = [(x % 14) << np.uint32(8) if kind == PREDICTOR else (x * np.uint32(0x2B15) + np.uint32(0x1D07F3)) & np.uint32(0xFFFFFF) for x in turn]
            if fitted:
                blocks = [(_fitted_modes if kind == PREDICTOR else _fitted_factors)(i, block_bits) for i in now]
            _put_pixels(t, blocks)
            maps = [_block_map(b, i.shape[1], i.shape[0], block_bits) for b, i in zip(blocks, now, strict=True)]
            if kind == CROSS:
                now = [_cross(i, m, -1) for i, m in zip(now, maps, strict=True)]
            else:
                guessed = []
                for i, m in zip(now, maps, strict=True):
                    c, around = _around(i)
                    guess = _predicted((m >> np.uint32(8)).astype(np.int64).ravel(), *around)
                    x, y = np.arange(i.size) % i.shape[1], np.arange(i.size) // i.shape[1]
                    guess = np.where((x == 0)[:, None], around[1], guess)
                    guess = np.where((y == 0)[:, None], around[0], guess)
                    guess[0] = 255, 0, 0, 0
                    guessed.append(_argb(c - guess).reshape(i.shape))
                now = guessed
    t.put(every, 0, 1)
    _put_pixels(t, now, cache_bits, True, groups)
    files = []
    for data in t.packed(n):
        data += bytes(len(data) & 1)
        files.append(b"RIFF" + struct.pack("<I", len(data) + 12) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data)
    return files
