"""Operator 6: fuzzy line deduplication.

Lines are normalised (lower case, words joined by single spaces) and get a 64-bit SimHash of their
words, with ``banded`` of their distinct words: the words that every long line repeats would make
long lines of one language alike. Hash and SimHash together name a node, and equal lines are one. Nodes are dealt by pigeonhole
blocks: with radius r, two fingerprints within r bits agree in one of r + 1 blocks. A changed word
moves a short line's fingerprint further than that, so with ``banded`` nodes are also dealt by bands
of minimum hashes: of the words of ``LONG`` bytes or more (all words where there are none), and for
lines of up to ``BRIEF`` bytes of their three-byte pieces.

A bucket is the top of a 64-bit number whose rest rules candidates out: the other bits of the
fingerprint in a block, a class of length in a band. Rows are sorted in ranges of (bucket, key), so a
bucket of any size spreads over partitions. Runs that lie in one range are compared as they stream
by; those cut by a range's end or over ``TILE`` rows go in tiles, pair by pair. Only rows
with a candidate are kept, once for each bucket that gave it one, and only their texts are
fetched. Candidates are verified by edit similarity, each in the first bucket it shares and only where
its ends aren't connected already, so a dense group costs about as many checks as it has lines. One
occurrence per connected group stays: the one with the smallest doc_id, text hash and line number.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, lean
from .graph import connected_components

RADIUS, SIMILARITY = 3, 0.8
#: Bands of words and of pieces, and minimum hashes in each.
WORD_BANDS, WORD_ROWS, PIECE_BANDS, PIECE_ROWS = 6, 3, 12, 5
#: Bytes of the words that count, least bytes of a line with bands of words, most of one with bands of pieces.
LONG, WORDY, BRIEF = 5, 32, 64
#: Differing bits beyond which a shared band of words makes no candidate.
LOOSE = 20
#: Base of the classes of length, of which there are 256.
CLASS = 1.05
#: Rows of a bucket that are compared in one piece.
TILE = 2048

_words = re.compile(r"\w+").findall


def normalise(line: str) -> str:
    return " ".join(_words(line.lower()))


def line_key(norm: str | bytes) -> int:
    return xxhash.xxh64_intdigest(norm, 1)


#: Bytes that belong to a word: letters, digits, the underscore, and all of letters beyond ASCII.
_WORD = np.array([c > 127 or chr(c).isalnum() or c == 95 for c in range(256)])
_odd = re.compile(r"[^\w\x00-\x7f]")
_BASE = 0x9E3779B97F4A7C15 | 1
#: Characters whose lines are worked on at once; a longer line is worked on by itself.
CHUNK = 1 << 19


@lru_cache(maxsize=4)
def _powers(size: int, base: int) -> np.ndarray:
    """1, base, base squared ... modulo 2**64, ``size`` of them."""
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread each hash over all its bits (xor-shifts and odd multipliers)."""
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ h >> np.uint64(shift)) * np.uint64(by)
    return h ^ h >> np.uint64(31)


def simhash(hashes: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Fingerprints of lines of word hashes, given by first word and number of words (one at least):
    a bit is set if over half the words have it."""
    if not len(size):
        return np.zeros(0, np.uint64)
    # Eight counters to a number: up to 255 words are added at once.
    parts = -(-size // 255)
    at = np.cumsum(parts) - parts
    start = np.repeat(first, parts) + 255 * (np.arange(int(parts.sum())) - np.repeat(at, parts))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    ones = np.add.reduceat(bits, start, axis=0).view(np.uint8)
    ones = np.add.reduceat(ones, at, axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > size[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def distinct_simhash(hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``simhash`` of the distinct words of consecutive lines of ``size`` words."""
    out, end = [], np.cumsum(size)
    for low in range(0, len(size), 1 << 20):
        n = size[low : low + (1 << 20)]
        # A line's number, then 44 bits of the word: they are enough to tell words apart, and spread anew give its hash.
        words = np.repeat(np.arange(len(n), dtype=np.uint64) << np.uint64(44), n) | hashes[end[low] - size[low] : end[low + len(n) - 1]] >> np.uint64(20)
        words.sort()
        words = words[np.append(True, words[1:] != words[:-1])]
        left = np.bincount((words >> np.uint64(44)).astype(np.int64), minlength=len(n))
        out.append(simhash(_mix(words & np.uint64((1 << 44) - 1)), np.cumsum(left) - left, left))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def line_prints(text: str) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """``(line_no, norm, sh)`` of the lines of a text that have a word: normalised in UTF-8, with its fingerprint."""
    line, norms, hashes, first, size, _ = _line_words(text)
    return line, norms, simhash(hashes, first, size)


_SALTS = np.array([pow(_BASE, 2 * k + 3, 1 << 64) for k in range(max(WORD_BANDS * WORD_ROWS, PIECE_BANDS * PIECE_ROWS))], np.uint64)


def _min_hashes(hashes: np.ndarray, size: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Bands of consecutive runs of ``size`` feature hashes (one at least): 32 bits for each run and band."""
    out, at = np.zeros((len(size), bands), np.uint64), np.cumsum(size) - size
    for k in range(bands if len(size) else 0):
        for salt in _SALTS[k * rows : (k + 1) * rows]:
            out[:, k] = _mix(out[:, k] ^ np.minimum.reduceat(hashes * salt, at))
    return (out >> np.uint64(32)).astype(np.uint32)


def line_bands(norms: list[bytes], hashes: np.ndarray, size: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which lines have bands of words, these, which have bands of pieces, and these; by lines of ``size`` words of ``width`` bytes."""
    chars = np.fromiter(map(len, norms), np.int64, len(norms))
    of = np.repeat(np.arange(len(size)), size)
    keep = width >= LONG
    keep |= np.bincount(of[keep], minlength=len(size))[of] == 0
    keep &= chars[of] > WORDY
    wordy, brief = np.flatnonzero(chars > WORDY), np.flatnonzero(chars <= BRIEF)
    words = _min_hashes(hashes[keep], np.bincount(of[keep], minlength=len(size))[wordy], WORD_BANDS, WORD_ROWS)
    b = np.frombuffer(b"".join(b" %b " % norms[k] for k in brief.tolist()), np.uint8).astype(np.uint64)
    end = np.cumsum(chars[brief] + 2)
    inside = np.ones(len(b), bool)
    inside[end - 1] = inside[end - 2] = False
    at = np.flatnonzero(inside)
    pieces = _min_hashes(_mix(b[at] << np.uint64(16) | b[at + 1] << np.uint64(8) | b[at + 2]), chars[brief], PIECE_BANDS, PIECE_ROWS)
    return wordy, words, brief, pieces


def _line_words(text: str) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(line_no, norm, hashes, first, size, width)``: the hash and bytes of each word, and each line's first word and number of words.

    All words of the text are hashed at once: a polynomial of a word's bytes, modulo 2**64, mixed.
    """
    low = text.lower()
    if not low.isascii():
        points = np.frombuffer(low.encode("utf-32-le"), np.uint32)
        # The pattern is slow over a whole text, and most have no such mark.
        if _odd.search("".join(map(chr, np.unique(points[points > 127]).tolist()))):
            low = _odd.sub(" ", low)
    b = np.frombuffer(low.encode(), np.uint8)
    word = _WORD[b]
    before = np.concatenate([[False], word[:-1]])
    s = np.flatnonzero(word & ~before)
    if not len(s):
        none = np.zeros(0, np.int64)
        return none, [], np.zeros(0, np.uint64), none, none, none
    e = np.flatnonzero(word & ~np.concatenate([word[1:], [False]]))
    room = 1 << max(20, (len(b) - 1).bit_length())
    poly = np.where(word, b, 0).astype(np.uint64) * _powers(room, _BASE)[: len(b)]
    hashes = _mix(np.add.reduceat(poly, s) * _powers(room, pow(_BASE, -1, 1 << 64))[s])
    first = np.searchsorted(s, np.concatenate([[0], np.flatnonzero(b == 10) + 1]))
    size = np.diff(np.append(first, len(s)))
    line = np.flatnonzero(size)
    first, size = first[line], size[line]
    # What is kept: words, and one byte behind each.
    width = e - s + 1
    end = np.cumsum(width + 1) - 1
    data = np.where(word, b, np.uint8(32))[word | before].tobytes()
    norms = [data[i:j] for i, j in zip((end - width)[first].tolist(), end[first + size - 1].tolist())]
    return line, norms, hashes, first, size, width


#: Columns of a line by which it is dealt: its characters, and two bands of words or of pieces to a number.
_DEALT = ["chars", *(f"w{k}" for k in range(WORD_BANDS // 2)), *(f"p{k}" for k in range(PIECE_BANDS // 2))]


def _dealt_by(norms: list[bytes], hashes: np.ndarray, size: np.ndarray, width: np.ndarray, banded: bool) -> list[pa.Array]:
    """The columns ``_DEALT`` of lines; bands are null where a line has none."""
    none, n = np.zeros(0, np.int64), len(norms)
    both = line_bands(norms, hashes, size, width) if banded else (none, np.zeros((0, WORD_BANDS), np.uint32), none, np.zeros((0, PIECE_BANDS), np.uint32))
    out = [pa.array(_chars(norms), pa.int32())]
    for at, bands in (both[:2], both[2:]):
        full, absent = np.zeros((n, bands.shape[1]), np.uint32), np.ones(n, bool)
        full[at], absent[at] = bands, False
        out += [pa.array(c, mask=absent) for c in full.view(np.int64).T]
    return out


def _chars(norms: list[bytes]) -> np.ndarray:
    """Characters of texts in UTF-8 that aren't empty."""
    size = np.fromiter(map(len, norms), np.int64, len(norms))
    data = b"".join(norms)
    if data.isascii():
        return size
    # Of a character's bytes, the first isn't 10xxxxxx.
    return np.add.reduceat((np.frombuffer(data, np.uint8) & 0xC0) != 0x80, np.cumsum(size) - size, dtype=np.int64)


def _chunks(texts: list[str | None]):
    """``(text, rows, numbers)``: texts joined to chunks, with the row and number of each of a chunk's lines.

    Texts longer than a chunk are cut behind lines.
    """
    held, chars, rows, lines, begin = [], 0, [], [], []
    for k, text in enumerate(texts):
        text, at, line = text or "", 0, 0
        while at is not None:
            end = text.find("\n", at + CHUNK) if len(text) - at > CHUNK else -1
            part, at = (text[at:end], end + 1) if end >= 0 else (text[at:], None)
            n = part.count("\n") + 1
            held.append(part)
            rows.append(k)
            lines.append(n)
            begin.append(line)
            chars, line = chars + len(part) + 1, line + n
            if chars >= CHUNK:
                yield _chunk(held, rows, lines, begin)
                held, chars, rows, lines, begin = [], 0, [], [], []
    if held:
        yield _chunk(held, rows, lines, begin)


def _chunk(held, rows, lines, begin):
    n = np.array(lines)
    number = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - np.array(begin), n)
    return "\n".join(held), np.repeat(np.array(rows), n), number


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance by Myers' bit vectors in whole numbers of any length.

    With ``most``, only whether it is at most ``most`` counts: an upper bound that is may stand for
    it (what differs between the common ends never costs more than its longer side), and so may a
    lower bound that isn't (each further character lowers the distance by one at best).
    """
    k = 0
    least = min(len(a), len(b))
    while k < least and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) + len(b)
    if most is not None and max(len(a), len(b)) <= most:
        return max(len(a), len(b))
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = full, 0, len(a)
    over = math.inf if most is None else most + len(b)
    step, size = max(64, len(b) // 16), -(-len(a) // 8)
    rest = np.arange(len(a), -1, -1)
    for at, c in enumerate(b):
        if score + at > over:
            return score + at - len(b)
        if most is not None and at and not at % step:
            # Every alignment passes this column, and then costs at least what one rest is longer than the other.
            rise, fall = (np.unpackbits(np.frombuffer(v.to_bytes(size, "little"), np.uint8), count=len(a), bitorder="little").view(np.int8) for v in (up, down))
            least = at + np.append(0, np.cumsum(rise - fall, dtype=np.int64)) + np.abs(rest - (len(b) - at))
            if least.min() > most:
                return int(least.min())
        eq = where.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        ph, mh = down | ~(x | up) & full, up & x
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1 | 1) & full, mh << 1 & full
        v = eq | down
        up, down = mh | ~(v | ph) & full, ph & v
    return score


#: Pairs for each block of 64 characters from which on distances are reckoned together, and numbers in a table of them at most.
TOGETHER, TABLE = 20, 1 << 20
#: Of fewer pairs: characters from which on a first text is worked on by itself, and bits of a number for the others.
ALONE, NUMBER = 1 << 12, 1 << 14


def within(pairs: list[tuple[str, str]], most: np.ndarray) -> np.ndarray:
    """Which pairs of texts have a Levenshtein distance of ``most`` at most: Myers' bit vectors in blocks of 64 characters, for many pairs at once."""
    out = np.zeros(len(pairs), bool)
    cut = [_strip(*sorted(p, key=len)) for p in pairs]
    sizes = np.array([(len(a), len(b)) for a, b in cut], np.int64).reshape(-1, 2)
    easy = (sizes[:, 0] == 0) | (sizes[:, 1] <= most)
    out[easy] = sizes[easy, 1] <= most[easy]
    # The same characters behind both texts don't change their distance: numbers of blocks come in steps of a quarter, so that groups are larger.
    grid = [1]
    while grid[-1] * 64 < sizes[:, 0].max(initial=0):
        grid.append(grid[-1] + max(1, grid[-1] // 4))
    blocks, few = np.array(grid)[np.searchsorted(np.array(grid) * 64, sizes[:, 0])], []
    for n in np.unique(blocks[~easy]).tolist():
        at = np.flatnonzero((blocks == n) & ~easy)
        while len(at):
            step = max(1, TABLE // (64 * n))
            part, at = at[:step], at[step:]
            if len(part) < TOGETHER * min(n, 2 * most[part].max() // 64 + 2):
                few.append(part)
            else:
                pads = (64 * n - sizes[part, :1]).ravel().tolist()
                padded = [(cut[k][0] + "\0" * x, cut[k][1] + "\0" * x) for k, x in zip(part.tolist(), pads)]
                padded.sort(key=lambda p: -len(p[1]))
                order = np.argsort([-sizes[k, 1] - x for k, x in zip(part.tolist(), pads)], kind="stable")
                own = part[order]
                out[own] = _distances(padded, np.array([tuple(map(len, p)) for p in padded], np.int64), n, most[own]) <= most[own]
    few = np.concatenate(few) if few else np.zeros(0, np.int64)
    alone = sizes[few, 0] > ALONE
    out[few[alone]] = [edit_distance(*cut[k], int(most[k])) <= most[k] for k in few[alone].tolist()]
    few = few[~alone]
    few = few[np.argsort(sizes[few, 1], kind="stable")]
    # Second texts are at most as long as twice the shortest of their number, so that little of a table is empty.
    piece, class_ = np.cumsum(sizes[few, 1]) // NUMBER, np.frexp(sizes[few, 1].astype(float))[1]
    for part in np.split(few, np.flatnonzero(np.diff(piece) | np.diff(class_)) + 1) if len(few) else ():
        out[part] = _packed([cut[k] for k in part.tolist()]) <= most[part]
    return out


def _packed(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Levenshtein distances of pairs of texts that aren't empty, shortest second texts first: Myers' bit vectors of all first texts in one whole number."""
    most, begin, bits, full, low, columns = len(pairs[-1][1]), [], 0, 0, 0, []
    for a, b in pairs:
        own: dict[str, int] = {}
        for i, c in enumerate(a):
            own[c] = own.get(c, 0) | 1 << i
        # Whole bytes, with a bit above the text that takes what an addition carries.
        size = len(a) // 8 + 1
        none = bytes(size)
        masks = {c: v.to_bytes(size, "little") for c, v in own.items()}
        columns.append([*(masks.get(c, none) for c in b), *[none] * (most - len(b))])
        begin.append(bits)
        full |= (1 << len(a)) - 1 << bits
        low |= 1 << bits
        bits += 8 * size
    up, down, done, out = full, 0, 0, np.zeros(len(pairs), np.int64)
    for t, column in enumerate(zip(*columns)):
        while len(pairs[done][1]) == t:
            out[done] = _rise(pairs[done], begin[done], up, down)
            done += 1
        eq = int.from_bytes(b"".join(column), "little")
        x = (((eq & up) + up) ^ up) | eq | down
        ph, mh = down | ~(x | up) & full, up & x
        ph, mh = (ph << 1 | low) & full, mh << 1 & full
        v = eq | down
        up, down = mh | ~(v | ph) & full, ph & v
    for k in range(done, len(pairs)):
        out[k] = _rise(pairs[k], begin[k], up, down)
    return out


def _rise(pair: tuple[str, str], begin: int, up: int, down: int) -> int:
    """The distance by the differences in the last column of a pair's table."""
    mask = (1 << len(pair[0])) - 1
    return len(pair[1]) + (up >> begin & mask).bit_count() - (down >> begin & mask).bit_count()


def _strip(a: str, b: str) -> tuple[str, str]:
    """Two texts, the shorter first, without their common beginning and end."""
    for _ in range(2):
        low, high = 0, len(a)
        while low < high:
            mid = (low + high + 1) // 2
            if a[low:mid] == b[low:mid]:
                low = mid
            else:
                high = mid - 1
        a, b = a[low:][::-1], b[low:][::-1]
    return a, b


def _distances(pairs: list[tuple[str, str]], sizes: np.ndarray, blocks: int, most: np.ndarray) -> np.ndarray:
    """Levenshtein distances of pairs, longest second texts first, whose first texts take ``blocks`` blocks; where it is over ``most``, any number over it."""
    points = [np.frombuffer("".join(p[k] for p in pairs).encode("utf-32-le"), np.uint32) for k in (0, 1)]
    alphabet, codes = np.unique(np.concatenate(points), return_inverse=True)
    a, b = codes[: len(points[0])], codes[len(points[0]) :]
    k, n, one = len(alphabet), len(pairs), np.uint64(1)
    row = np.repeat(np.arange(n), sizes[:, 0])
    place = np.arange(len(a)) - np.repeat(np.cumsum(sizes[:, 0]) - sizes[:, 0], sizes[:, 0])
    where = np.zeros((blocks, n * k), np.uint64)
    np.bitwise_or.at(where, (place >> 6, row * k + a), one << (place & 63).astype(np.uint64))
    text = np.zeros((int(sizes[0, 1]), n), np.int64)
    row = np.repeat(np.arange(n), sizes[:, 1])
    text[np.arange(len(b)) - np.repeat(np.cumsum(sizes[:, 1]) - sizes[:, 1], sizes[:, 1]), row] = row * k + b
    up, down = np.full((blocks, n), ~np.uint64(0)), np.zeros((blocks, n), np.uint64)
    last, alive, lengths, ends = ((sizes[:, 0] - 1) & 63).astype(np.uint64), np.arange(n), sizes[:, 1].copy(), sizes[:, 0].copy()
    over, top, out, reach = most + lengths, np.uint64(63), np.zeros(n, np.int64), int(most.max())
    # Only blocks within ``reach`` of the diagonal count; the score is that of the lowest of them.
    lowest = min(blocks - 1, reach // 64)
    score = ends.copy() if lowest == blocks - 1 else np.full(n, 64 * (lowest + 1))
    for t in range(len(text)):
        if not t % 16:
            live = (lengths > t) & ((score + t <= over) | (lowest < blocks - 1))
            if not live.all():
                out[alive[~live]] = np.where(lengths[~live] <= t, score[~live] if lowest == blocks - 1 else over[~live], most[alive[~live]] + 1)
                alive, lengths, over, score, last, ends = alive[live], lengths[live], over[live], score[live], last[live], ends[live]
                up, down, text = np.ascontiguousarray(up[:, live]), np.ascontiguousarray(down[:, live]), np.ascontiguousarray(text[:, live])
            if not len(alive):
                break
        if lowest < min(blocks - 1, (t + reach) // 64):
            lowest += 1
            score = score + (ends - 64 * lowest if lowest == blocks - 1 else 64)
        m = int(np.searchsorted(-lengths, -t, "left"))
        at, rise, fall = text[t, :m], one, np.zeros(m, np.uint64)
        for w in range(max(0, (t - reach) // 64), lowest + 1):
            pv, mv, eq = up[w, :m], down[w, :m], where[w].take(at)
            xv = eq | mv
            eq |= fall
            xh = eq & pv
            xh += pv
            xh ^= pv
            xh |= eq
            ph = ~(xh | pv)
            ph |= mv
            mh = pv & xh
            if w == lowest:
                bit = last[:m] if w == blocks - 1 else top
                score[:m] += (ph >> bit & one).astype(np.int64) - (mh >> bit & one).astype(np.int64)
            rises, falls = ph >> top, mh >> top
            ph <<= one
            ph |= rise
            mh <<= one
            mh |= fall
            np.bitwise_and(ph, xv, out=down[w, :m])
            xv |= ph
            np.invert(xv, out=xv)
            np.bitwise_or(mh, xv, out=up[w, :m])
            rise, fall = rises, falls
    out[alive] = score
    return out


def _word_bound(a: str, b: str, most: int) -> int:
    return _words_apart(_split(a), _split(b), most)


def _split(text: str) -> tuple[list[str], list[str]]:
    """The words of a text, and each with the next."""
    words = text.split(" ")
    return words, [*map("%s %s".__mod__, zip(words, words[1:])), words[-1]]


def _words_apart(a: tuple[list[str], list[str]], b: tuple[list[str], list[str]], most: int, reach: int = 8, stride: int = 16) -> int:
    """At least the Levenshtein distance of texts of these words: the cost of one alignment by words, given up beyond ``most``.

    Where words differ, the nearest place at which the next two agree again is looked for within
    ``reach`` words; what lies between is replaced as a whole.
    """
    (x, x2), (y, y2) = a, b
    i, j, cost, m, n = 0, 0, 0, len(x), len(y)
    while i < m and j < n:
        while i + stride <= m and x[i : i + stride] == y[j : j + stride]:
            i, j = i + stride, j + stride
        if i == m or j == n:
            break
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        p = q = 1
        least, ahead = reach + 1, y2[j : j + reach + 1]
        for k, two in enumerate(x2[i : i + reach + 1]):
            if k >= least:
                break
            if two in ahead and k + (at := ahead.index(two)) < least:
                p, q, least = k, at, k + at
        cost += max(sum(map(len, x[i : i + p])) + p, sum(map(len, y[j : j + q])) + q)
        if cost > most:
            return cost
        i, j = i + p, j + q
    return cost + max(sum(map(len, x[i:])) + m - i, sum(map(len, y[j:])) + n - j)


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    """Edit similarity, one minus distance over the longer length, at ``least`` or more."""
    longer = max(len(a), len(b))
    most = longer - math.ceil(least * longer)
    if longer - min(len(a), len(b)) > most:
        return False
    return _word_bound(a, b, most) <= most or edit_distance(a, b, most) <= most


def occurrences(docs: DataFrame) -> DataFrame:
    """``(doc_id, th, line_no, key, sh)`` of each line that has a word; ``th`` is a hash of the whole text."""
    return _occurrences(docs, False).select("doc_id", "th", "line_no", "key", "sh")


def _occurrences(docs: DataFrame, banded: bool) -> DataFrame:
    """``occurrences`` with the columns ``_DEALT``."""

    def run(batches):
        names = ["doc_id", "th", "line_no", "key", "sh", *_DEALT]
        for b in batches:
            for text, rows, numbers in _chunks(b.column(2).to_pylist()):
                line, norms, hashes, first, size, width = _line_words(text)
                if len(line):
                    sh = distinct_simhash(hashes, size) if banded else simhash(hashes, first, size)
                    at = pa.array(rows[line])
                    keys = np.fromiter(map(line_key, norms), np.uint64, len(norms)).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(at), b.column(1).take(at), pa.array(numbers[line], pa.int32()), pa.array(keys), pa.array(sh.view(np.int64)), *_dealt_by(norms, hashes, size, width, banded)], names
                    )

    types = "chars int, " + ", ".join(f"{c} long" for c in _DEALT[1:])
    return _rows(docs).mapInArrow(lean(run), f"doc_id long, th long, line_no int, key long, sh long, {types}")


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


# A bucket number, from its top: 0, the block's number in 3 bits, the block, and 60 bits less the block of the
# fingerprint; or 1, 18 zeros, the band's number in 5 bits, 32 bits of the band and 8 of the class of length.
_BAND, _BAND_LOW, _NUMBER = np.uint64(1 << 63), np.uint64(8), np.uint64(40)


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(place, bits) of the blocks of a fingerprint."""
    if not 0 <= radius <= 7:
        raise ValueError("radius must be 0 to 7")
    width = -(-64 // (radius + 1))
    return [(width * k, min(width, 64 - width * k)) for k in range(radius + 1)]


def _buckets(nodes: DataFrame, radius: int) -> DataFrame:
    """``(bucket, key)``: a row for each block and band of each node."""
    sh = F.col("sh")
    out = []
    for k, (at, bits) in enumerate(_blocks(radius)):
        end = (at + bits) % 64
        turned = F.shiftleft(sh, 64 - end).bitwiseOR(F.shiftrightunsigned(sh, end)) if end else sh
        out.append(F.lit(k << 60).bitwiseOR(F.shiftrightunsigned(turned, 4)))
    length = F.least(F.floor(F.log(F.col("chars").cast("double")) / F.lit(math.log(CLASS))), F.lit(255)).cast("long")
    for k, c in enumerate(_DEALT[1:]):
        low, high = F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(c), 32)
        for half, band in enumerate((low, high)):
            out.append(F.lit((2 * k + half << 40) - (1 << 63)).bitwiseOR(F.shiftleft(band, 8)).bitwiseOR(length))
    return nodes.select(F.explode(F.array(*out)).alias("bucket"), "key").where("bucket is not null")


class _Buckets:
    """What bucket numbers say: which are the same bucket, and which rows of one may be similar."""

    def __init__(self, radius: int, similarity: float):
        self.radius = radius
        self.low = np.array([60 - bits for _, bits in _blocks(radius)] + [0] * 8, np.uint64)[:8]
        self.apart = math.floor(-math.log(similarity) / math.log(CLASS)) + 1 if similarity > 0 else 255

    def same(self, bucket: np.ndarray) -> np.ndarray:
        """The bucket without what rules candidates out."""
        low = np.where(bucket >= _BAND, _BAND_LOW, self.low[(bucket >> np.uint64(60)).astype(np.int64) & 7])
        return bucket >> low << low

    def number(self, bucket: np.ndarray) -> np.ndarray:
        """The block's number, or the band's and 8 more."""
        band = bucket >= _BAND
        return np.where(band, 8 + (bucket >> _NUMBER & np.uint64(31)), bucket >> np.uint64(60)).astype(np.int32)

    def fit(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        length = np.abs((x & np.uint64(255)).astype(np.int16) - (y & np.uint64(255)).astype(np.int16)) <= self.apart
        return np.where(x >= _BAND, length, np.bitwise_count(x ^ y) <= self.radius)


#: Runs up to this many rows are compared together with others of their batch.
SHORT = 64
#: Pairs that are held at once, and characters of those that wait for a distance.
PAIRS, UNSURE = 1 << 17, 1 << 22


def _pairs(size: np.ndarray, fit):
    """``(i, j)`` with ``i < j``: pairs of rows of the same of consecutive runs that ``fit(i, j)`` holds for, in pieces."""
    end = np.cumsum(size)
    for at, n in zip((end - size)[size > SHORT].tolist(), size[size > SHORT].tolist()):
        step = max(1, PAIRS // n)
        for low in range(0, n - 1, step):
            i, j = np.triu_indices(min(step, n - low), 1, n - low)
            i, j = i + at + low, j + at + low
            use = fit(i, j)
            yield i[use], j[use]
    of = np.repeat(np.where(size <= SHORT, size, 0), size)
    rest = np.repeat(end, size) - np.arange(int(size.sum())) - 1
    # Pieces of rows, so that pairs of a piece stay few.
    piece = np.cumsum(of) // PAIRS
    for k in np.unique(piece).tolist():
        at, step, li, lj = np.flatnonzero((piece == k) & (of > 1) & (rest > 0)), 1, [], []
        while len(at):
            use = at[fit(at, at + step)]
            li.append(use)
            lj.append(use + step)
            step += 1
            at = at[rest[at] >= step]
        if li:
            yield np.concatenate(li), np.concatenate(lj)


def _runs(batches, of, most: int):
    """``(batch, start, size, whole)``: runs of equal numbers ``of(batch)`` in a stream that has equal ones together.

    Runs over ``most`` rows come in pieces; those and the stream's first and last run aren't whole.
    """
    held, opened = None, True
    for b in batches:
        if not b.num_rows:
            continue
        held = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        number = of(held)
        start = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        if len(start) > 1:
            size = np.diff(start)
            pieces = -(-size // most)
            at = np.repeat(start[:-1], pieces) + most * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            whole = np.repeat(pieces == 1, pieces)
            whole[: pieces[0]] &= not opened
            yield held.slice(0, start[-1]), at, np.diff(np.append(at, start[-1])), whole
            held, opened = held.slice(start[-1]), False
        while held.num_rows > most:
            yield held.slice(0, most), np.array([0]), np.array([most]), np.array([False])
            held, opened = held.slice(most), True
    if held is not None:
        yield held, np.array([0]), np.array([held.num_rows]), np.array([False])


def _most(longer: np.ndarray, similarity: float) -> np.ndarray:
    """The distance that the similarity allows."""
    return longer - np.ceil(similarity * longer)


def _bag(norms: pa.Array) -> np.ndarray:
    """How many characters of each of 32 kinds the texts have."""
    chars = pc.utf8_length(norms).to_numpy()
    points = np.frombuffer("".join(norms.to_pylist()).encode("utf-32-le"), np.uint32)
    cell = np.repeat(np.arange(len(chars)) * 32, chars) + (points & 31)
    return np.bincount(cell, minlength=len(chars) * 32).reshape(-1, 32).astype(np.int32)


def _word_bag(norms: pa.Array) -> np.ndarray:
    """How many bytes the words of each of 64 kinds take in the texts, a space with each."""
    out = [np.zeros((0, 64), np.int32)]
    for text, _, _ in _chunks(norms.to_pylist()):
        _, _, hashes, _, size, width = _line_words(text)
        cell = np.repeat(np.arange(len(size)) * 64, size) + (hashes & np.uint64(63)).astype(np.int64)
        out.append(np.bincount(cell, width + 1, minlength=len(size) * 64).reshape(-1, 64).astype(np.int32))
    return np.concatenate(out)


class _Lazy:
    """Rows of numbers of texts, reckoned when they are first asked for."""

    def __init__(self, norms: pa.Array, of, width: int):
        self.norms, self.of = norms, of
        self.values, self.known = np.zeros((len(norms), width), np.int32), np.zeros(len(norms), bool)

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        new = np.unique(rows[~self.known[rows]])
        if len(new):
            self.values[new], self.known[new] = self.of(self.norms.take(pa.array(new))), True
        return self.values[rows]


def _alignable(words: np.ndarray | _Lazy, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which pairs an alignment by words may be near enough for: it costs at least what one bag of words has more than
    the other, in bytes, which are taken to be a quarter more than characters at most. The other pairs need a distance."""
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 14):
        part = np.s_[at : at + (1 << 14)]
        apart = words[i[part]] - words[j[part]]
        out[part] = np.maximum(np.maximum(apart, 0).sum(1), np.maximum(-apart, 0).sum(1)) <= 1.25 * most[part]
    return out


def _bags_fit(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs the similarity isn't ruled out for: the distance is at least what one bag has more than the other."""
    least = np.maximum(np.maximum(a - b, 0).sum(1), np.maximum(b - a, 0).sum(1))
    return least <= _most(np.maximum(a.sum(1), b.sum(1)), similarity)


def _tile(run: np.ndarray, key: np.ndarray, number: np.ndarray) -> np.ndarray:
    """A number for the keys of each of consecutive runs, for each row: equal for runs of the same keys if both are of blocks or both of bands."""
    start = np.flatnonzero(np.diff(run, prepend=-1))
    total = np.add.reduceat(_mix(key.view(np.uint64)), start) ^ np.where(number[start] < 8, np.uint64(0), np.uint64(_BASE))
    return np.repeat(_mix(total), np.diff(np.append(start, len(run))))


def _wanted(marked: DataFrame) -> DataFrame:
    """``(key, at)``: the tiles of each key.

    Buckets often hold the same rows. Any two of these share the first such bucket of blocks, and the first of
    bands, so they are never compared in a later one of its kind: one tile, with the least number, stands for all.
    """
    once = marked.repartition("key").groupBy("key", "tile", "side").agg(F.min("number").alias("number"))
    return once.groupBy("key").agg(F.collect_list(F.struct("tile", "number", "side")).alias("at"))


def _marked(nodes: DataFrame, radius: int, similarity: float, scratch: Scratch) -> DataFrame:
    """``(tile, number, side, key)``: rows with a candidate, by what they are to be compared in.

    Candidates are within a tile: among rows of side 0, or between those of sides 1 and 2.
    """
    rules = _Buckets(radius, similarity)
    names = ["tile", "number", "sub", "bucket", "key"]

    def compare(batches):
        from pyspark import TaskContext

        sub = TaskContext.get().partitionId() << 32
        unsigned = lambda b: b.column(0).to_numpy().view(np.uint64)
        for b, _, size, whole in _runs(batches, lambda b: rules.same(unsigned(b)), TILE):
            bucket, found, subs = unsigned(b), np.repeat(~whole, size), np.full(b.num_rows, -1)
            part, use = np.flatnonzero(np.repeat(whole & (size > 1), size)), whole & (size > 1)
            some = bucket[part]
            for i, j in _pairs(size[use], lambda i, j: rules.fit(some[i], some[j])):
                found[part[i]] = found[part[j]] = True
            subs[np.repeat(~whole, size)] = np.repeat(sub + np.arange((~whole).sum()), size[~whole])
            sub += int((~whole).sum())
            at = np.flatnonzero(found)
            if len(at):
                key, number, one = b.column(1).to_numpy()[at], rules.number(bucket[at]), subs[at] < 0
                tile = np.where(one, _tile(np.repeat(np.arange(len(size)), size)[at], key, number), rules.same(bucket[at]))
                got = tile.view(np.int64), number, subs[at], bucket[at].view(np.int64), key
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names)

    rows = _buckets(nodes, radius).repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key")
    dealt = scratch.cut(rows.mapInArrow(lean(compare), "tile long, number int, sub long, bucket long, key long"), "dealt")
    one = dealt.where("sub < 0").select("tile", "number", F.lit(0).alias("side"), "key")
    t = scratch.cut(dealt.where("sub >= 0").groupBy("tile", "number", "sub").agg(F.collect_list("bucket").alias("b"), F.collect_list("key").alias("k")), "tiles")
    other = t.select("tile", F.col("sub").alias("sub_b"), F.col("b").alias("b_b"), F.col("k").alias("k_b"))
    both = t.join(other, "tile").where("sub < sub_b or (sub = sub_b and size(b) > 1)")

    def across(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                tile, number, same = (batch.column(c)[r].as_py() for c in (0, 1, 2))
                x, y = (batch.column(c)[r].values.to_numpy().view(np.uint64) for c in (3, 5))
                hit, step = [np.zeros(len(x), bool), np.zeros(len(y), bool)], max(1, PAIRS // len(y))
                for at in range(0, len(x), step):
                    fit = rules.fit(x[at : at + step, None], y[None, :])
                    if same:
                        fit[np.arange(len(fit)), np.arange(at, at + len(fit))] = False
                    hit[0][at : at + step] = fit.any(1)
                    hit[1] |= fit.any(0)
                for side, (h, c) in enumerate(zip(hit, (4, 6)), 1):
                    if h.any() and not (same and side == 2):
                        key = batch.column(c)[r].values.to_numpy()[h]
                        full = [np.full(len(key), v, kind) for v, kind in ((tile, np.int64), (number, np.int32), (0 if same else side, np.int32))]
                        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (*full, key)], ["tile", "number", "side", "key"])

    pairs = both.select(F.xxhash64("tile", "sub", "sub_b").alias("tile"), "number", (F.col("sub") == F.col("sub_b")).alias("same"), "b", "k", "b_b", "k_b")
    out = scratch.cut(one.unionByName(pairs.mapInArrow(lean(across), "tile long, number int, side int, key long")), "marked")
    scratch.drop(dealt, t)
    return out


def _tiled(docs: DataFrame, lines: DataFrame, banded: bool) -> DataFrame:
    """``(tile, number, side, key, sh, prior, norm)``: the texts of ``lines(doc_id, th, line_no, key, at)`` in each of the tiles ``at``.

    ``prior`` has the bands before the tile's own, each in four bytes. Rows that repeat a document repeat its lines.
    """
    wanted = lines.groupBy(F.col("doc_id").alias("id"), F.col("th").alias("h")).agg(F.collect_list(F.struct("line_no", "key", "at")).alias("lines"))
    rows = _rows(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("h"))).select("text", "lines")
    names = ["tile", "number", "side", "key", "sh", "prior", "norm"]

    def tiled(norms, fields):
        _, held, hashes, first, words, width = _line_words("\n".join(norms))
        sh, band = (distinct_simhash(hashes, words), _bands(held, hashes, words, width)) if banded else (simhash(hashes, first, words), None)
        sh = sh.view(np.int64)
        at = fields.field("at")
        of = np.repeat(np.arange(len(norms)), pc.list_value_length(at).to_numpy())
        tiles = at.flatten()
        number = tiles.field("number").to_numpy()
        prior = [band[r, : n - 8].tobytes() if n >= 8 else b"" for r, n in zip(of.tolist(), number.tolist())]
        for low in range(0, len(of), 4096):
            part = pa.array(of[low : low + 4096])
            columns = [tiles.field(c).slice(low, 4096) for c in ("tile", "number", "side")]
            texts = pa.array([norms[r] for r in of[low : low + 4096].tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, fields.field("key").take(part), pa.array(sh).take(part), pa.array(prior[low : low + 4096], pa.binary()), texts], names)

    def run(batches):
        for b in batches:
            norms, chars, begin, lines = [], 0, 0, b.column(1)
            for k, text in enumerate(b.column(0).to_pylist()):
                split = text.split("\n")
                norms += [normalise(split[i]) for i in lines[k].values.field("line_no").to_pylist()]
                chars += len(text)
                if chars >= CHUNK or k == b.num_rows - 1:
                    yield from tiled(norms, lines.slice(begin, k + 1 - begin).flatten())
                    norms, chars, begin = [], 0, k + 1

    return rows.mapInArrow(lean(run), "tile long, number int, side int, key long, sh long, prior binary, norm string")


def _bands(norms: list[bytes], hashes: np.ndarray, size: np.ndarray, width: np.ndarray) -> np.ndarray:
    """All bands of lines, words first; where a line has none, a number of its own from the line's words."""
    own = np.add.reduceat(hashes, np.cumsum(size) - size)
    out = _mix(own[:, None] * _SALTS[: WORD_BANDS + PIECE_BANDS]).astype(np.uint32)
    wordy, words, brief, pieces = line_bands(norms, hashes, size, width)
    out[wordy, :WORD_BANDS], out[brief, WORD_BANDS:] = words, pieces
    return out


def _verified(rows: DataFrame, radius: int, similarity: float) -> DataFrame:
    """``(src, dst)``: links that connect the same groups as all verified pairs of tiled rows do; nodes are (key, sh)."""
    blocks, node = _blocks(radius), pa.struct([("key", pa.int64()), ("sh", pa.int64())])

    def run(batches):
        up: dict[int, int] = {}
        unsure, waits = [], 0

        def root(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        def decided(pairs):
            """The links among pairs (node, node, text, text) that are near enough, but for those whose ends are connected by then."""
            pairs = [p for p in pairs if root(p[0]) != root(p[1])]
            most = _most(np.array([max(len(a), len(b)) for _, _, a, b in pairs], np.int64), similarity).astype(np.int64)
            out = []
            for (x, y, _, _), ok in zip(pairs, within([p[2:] for p in pairs], most)):
                p, q = root(x), root(y)
                if ok and p != q:
                    up[max(p, q)] = min(p, q)
                    out.append((x, y))
            return out

        def links(pairs):
            ends = [[x[e] for x in pairs] for e in (0, 1)]
            halves = [(np.array([x >> 64 for x in e], np.int64), np.array([x & (1 << 64) - 1 for x in e], np.uint64).view(np.int64)) for e in ends]
            return pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([pa.array(v) for v in h], fields=[*node]) for h in halves], ["src", "dst"])

        for b, _, size, _ in _runs(batches, lambda b: b.column(0).to_numpy(), 1 << 40):
            if not (size > 1).any():
                continue
            number, side, key, norm = b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(6)
            sh, chars = b.column(4).to_numpy().view(np.uint64), pc.utf8_length(norm).to_numpy()
            # Bands that a tile doesn't ask for are unlike any other row's.
            band = np.full((b.num_rows, WORD_BANDS + PIECE_BANDS), np.arange(b.num_rows)[:, None] + (1 << 32), np.uint64)
            band[np.arange(band.shape[1]) < number[:, None] - 8] = np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint32)

            def fit(i, j):
                """The pairs whose first shared bucket this is, of like lengths."""
                out = (side[i] == 0) | (side[i] != side[j])
                out &= np.abs(chars[i] - chars[j]) <= _most(np.maximum(chars[i], chars[j]), similarity)
                at = np.flatnonzero(out)
                i, j = i[at], j[at]
                x, n = sh[i] ^ sh[j], number[i]
                apart = np.bitwise_count(x)
                mine = np.where(n < 8, apart <= radius, (apart > radius) & ((apart <= LOOSE) | (n >= 8 + WORD_BANDS)))
                for k, (place, bits) in enumerate(blocks):
                    agree = x >> np.uint64(place) & np.uint64((1 << bits) - 1) == 0
                    mine &= (n >= 8) | np.where(n == k, agree, (n < k) | ~agree)
                for c in range(band.shape[1]):
                    mine &= band[i, c] != band[j, c]
                out[at] = mine
                return out

            # What is needed of rows in pairs only: most rows are in none whose first shared bucket is their tile's.
            bags, words = _Lazy(norm, _bag, 32), _Lazy(norm, _word_bag, 64)
            ids: dict[int, int] = {}
            texts: dict[int, str] = {}
            split: dict[int, tuple[list[str], list[str]]] = {}
            group, groups, found = np.zeros(b.num_rows, np.int64), {}, []

            def wait(x, y):
                nonlocal found, unsure, waits
                unsure.append((ids[x], ids[y], texts[x], texts[y]))
                waits += max(len(texts[x]), len(texts[y]))
                if waits >= UNSURE:
                    found += decided(unsure)
                    unsure, waits = [], 0

            for i, j in _pairs(size, fit):
                use = _bags_fit(bags[i], bags[j], similarity)
                i, j = i[use], j[use]
                both = np.unique(np.concatenate([i, j]))
                new = [r for r in both.tolist() if r not in ids]
                for r, k, s, text in zip(new, key[new].tolist(), sh[new].tolist(), norm.take(pa.array(new, pa.int64())).to_pylist()):
                    ids[r], texts[r] = k << 64 | s, text
                    group[r] = groups.setdefault(root(ids[r]), len(groups))
                hope = _alignable(words, i, j, _most(np.maximum(chars[i], chars[j]), similarity))
                later = i[~hope], j[~hope]
                i, j = i[hope], j[hope]
                order = np.lexsort((j, i))
                i, j = i[order], j[order]
                begin = np.flatnonzero(np.diff(i, prepend=-1))
                for x, js in zip(i[begin].tolist(), np.split(j, begin[1:])) if len(i) else ():
                    for y in js[group[js] != group[x]].tolist():
                        p, q = root(ids[x]), root(ids[y])
                        if p == q:
                            continue
                        longer = max(len(texts[x]), len(texts[y]))
                        most = longer - math.ceil(similarity * longer)
                        a, b_ = (split.get(k) or split.setdefault(k, _split(texts[k])) for k in (x, y))
                        if _words_apart(a, b_, most) <= most:
                            up[max(p, q)] = min(p, q)
                            group[group == group[y]] = groups[min(p, q)] = group[x]
                            found.append((ids[x], ids[y]))
                        else:
                            wait(x, y)
                apart = group[later[0]] != group[later[1]]
                for x, y in zip(later[0][apart].tolist(), later[1][apart].tolist()):
                    if root(ids[x]) != root(ids[y]):
                        wait(x, y)
            if found:
                yield links(found)
        if found := decided(unsure):
            yield links(found)

    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(lean(run), "src struct<key:long,sh:long>, dst struct<key:long,sh:long>")


def duplicate_lines(docs: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY, scratch: Scratch | None = None, banded: bool = False) -> DataFrame:
    """``(doc_id, th, drop)``: numbers (from 0) of the lines to drop, for the texts that have any."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    bound_batches(docs.sparkSession)
    every = scratch.cut(_occurrences(docs, banded), "lines")
    nodes = scratch.cut(every.groupBy("key", "sh").agg(*(F.min(c).alias(c) for c in _DEALT), F.count(F.lit(1)).alias("n")), "nodes")
    marked = _marked(nodes.select("key", "sh", *_DEALT), radius, similarity, scratch)
    wanted = scratch.cut(_wanted(marked), "wanted")
    scratch.drop(marked)
    # Lines without a repeat or a candidate stay, whatever the rest does.
    some = nodes.where("n > 1").select("key").unionByName(wanted.select("key")).distinct()
    of = scratch.cut(every.select("doc_id", "th", "line_no", "key", "sh").join(some, "key"), "repeats")
    scratch.drop(nodes, every)
    # Null ids sort first in a structure, as they do in an order.
    first = scratch.cut(of.groupBy("key", "sh").agg(F.min(F.struct("doc_id", "th", "line_no")).alias("first"), F.count(F.lit(1)).alias("n")), "first")
    tiled = _tiled(docs, first.join(wanted, "key").select("first.*", "key", "at"), banded)
    node = F.struct("key", "sh").alias("node")
    groups = connected_components(_verified(tiled, radius, similarity), scratch)
    scratch.drop(wanted)
    grouped = first.select(node, "first", "n").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = grouped.groupBy("component").agg(F.min("first").alias("keep"), F.sum("n").alias("total")).where("total > 1")
    keep = grouped.select("node", "component").join(best, "component").select("node.key", "node.sh", "keep")
    rows = of.join(keep, ["key", "sh"]).where(~F.struct("doc_id", "th", "line_no").eqNullSafe(F.col("keep")))
    return rows.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("line_no")).alias("drop"))


def dedup_lines(docs: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY, scratch: Scratch | None = None, banded: bool = False) -> DataFrame:
    """The rows of ``docs`` without the repeated lines in ``text``; ``n_chars``, if it is there, follows.

    Every line with a word counts, whatever its length; lines without one stay. Rows stay even if
    no line does (their text is then empty). Null texts stay null; rows that repeat doc_id and text
    are one document and are treated alike. No rows give no rows. Candidates are the lines within
    the radius; with ``banded``, as the query and the pipeline have it, those that share a band too.
    """
    drop = duplicate_lines(docs, radius, similarity, scratch, banded).select(F.col("doc_id").alias("_fw_id"), F.col("th").alias("_fw_th"), F.col("drop").alias("_fw_drop")).hint("shuffle_hash")
    joined = docs.withColumn("_fw_text", F.xxhash64(F.col("text").cast("string"))).join(drop, F.col("doc_id").cast("long").eqNullSafe(F.col("_fw_id")) & (F.col("_fw_text") == F.col("_fw_th")), "left")
    # A column of its own: within the lambda below, the text would be split again for every line.
    joined = joined.withColumn("_fw_lines", F.when(F.col("_fw_drop").isNotNull(), F.split("text", "\n", -1)))
    lines = F.col("_fw_lines")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_fw_drop")
    text = F.when(F.col("_fw_drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_fw_drop").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
