"""Exact-substring de-duplication with suffix arrays.

Texts are UTF-8 bytes; a byte goes if a `length`-byte string that covers it also starts earlier (in a row with a smaller
id, or before in the same row). Strings are judged on the input; overlaps count.

A suffix array of the whole corpus would meet in one task, so suffixes are dealt by content and sorted in blocks that
together decide every string:

1. Anchors. A position is an anchor if the hash of the bytes from it on is the least of any window of `length` bytes.
   Every string of that length holds one, with `GRAM` bytes from it on, chosen by content alone; so two occurrences hold
   the same anchor at the same place.
2. Anchors whose gram occurs once cannot lie in a repeat. A Bloom filter over the grams counted twice or more lets the
   others go.
3. Anchors with the same gram and surroundings (all bytes that a string through the anchor can reach) form a class. All
   of a class but the first are repeats as a whole. A class is met sorted and in passing; each map task first settles the
   copies that it meets itself, so groups of copies of any size cost some rows a task.
4. Only where one gram has several classes are strings at the edges of repeats left to decide: the first of each class
   goes on with its surroundings, past a second Bloom filter. These rows are sorted across the cluster twice, by gram and
   right side, then by gram and left side. In a sorted order the neighbours tell how far a row agrees with any other;
   a string is a candidate only where it goes no farther on either side.
5. Along the second order, blocks of rows are decided by ranks: the right sides of a block are ordered by a suffix array
   built by grouping (`gsaca`), and two strings with r bytes to the left of the anchor are equal exactly where no common
   prefix in between is shorter than r in the left order or than the rest in the right order. All but the first of
   equals are repeats.
6. A gram whose rows go on in another block leaves the first of its equal candidates with a 128-bit hash; a minimum over
   the hashes, pre-aggregated, decides between blocks. Sorted orders put equal sides side by side, so that few are left.
7. Repeats are merged to intervals per row and cut out, through a shared table while there are at most `max_shared` of
   them, else by a join.

There is no bound on a gram, class or group. The filters have about 16 bits a key, up to `most_bits`; a full filter costs
work, not results.

Defined results: null is empty; rows are ordered by id (null, or an id that is no number, last), then by the 64-bit
XXH64 of the text (signed), and rows equal in both are one document given more than once, each with its result; texts
below `length` bytes lose nothing; long texts are hashed in blocks; an empty table gives an empty table; the added column
takes a name that the table does not have. What is cut off may leave bytes that are no whole characters, so the kept text
is binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import dropped, fresh, rows_udf, stored
from aerolith.llm.gsaca import suffix_array

GRAM = 40
CHOSEN = 16  # bytes whose hash chooses anchors
BLOCK = 1 << 15
BATCH = 1 << 22
SYMBOL = 20  # bytes of a side to a symbol of the suffix array
LAST = (1 << 63) - 1
RESULT = "n_bytes long, n_removed long, n_spans long, kept binary"


def _mix32(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    return x


def _chosen_by(raw: np.ndarray) -> np.ndarray:
    """32-bit hashes, never 0, of all windows of CHOSEN bytes."""
    four = _mix32(np.ndarray((len(raw) - 3,), "<u4", buffer=raw, strides=(1,)))
    eight = _mix32(four[:-4] * np.uint32(0x85EBCA77) + four[4:])
    return _mix32(eight[:-8] * np.uint32(0xC2B2AE3D) + eight[8:]) | np.uint32(1)


def _sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    size = 1
    y = x
    while size * 2 <= w:
        y = f(y[:-size], y[size:])
        size *= 2
    n = len(x) - w + 1
    return f(y[:n], y[w - size : w - size + n])


def anchors(flat: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """Positions of the anchors of texts that lie end to end in `flat`; offsets: their starts and the end."""
    w, n = length - GRAM + 1, len(flat)
    edge = np.zeros(n + 1, np.int32)  # windows that leave their text
    np.add.at(edge, np.maximum(offsets[:-1], offsets[1:] - length + 1), 1)
    np.subtract.at(edge, offsets[1:], 1)
    out = np.cumsum(edge[:n]) > 0
    places = []
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        if out[a:b].all():
            continue
        raw = np.zeros(b - a + w + CHOSEN - 2, np.uint8)
        part = flat[a : a + len(raw)]
        raw[: len(part)] = part
        h = _chosen_by(raw)
        wide = np.zeros(b - a + 2 * (w - 1), np.uint32)
        wide[w - 1 : w - 1 + b - a] = np.where(out[a:b], np.uint32(0), _sliding(h, w, np.minimum))
        places.append(np.flatnonzero(h == _sliding(wide, w, np.maximum)) + a)
    return np.unique(np.concatenate(places)) if places else np.zeros(0, np.int64)


def _words(raw: np.ndarray) -> np.ndarray:
    """All 8-byte words of an array, at any place."""
    return np.ndarray((max(0, len(raw) - 7),), "<u8", buffer=raw, strides=(1,))


def _folded(columns, seed: np.ndarray | int = 0) -> np.ndarray:
    """64-bit hashes of rows given as columns of 64-bit words."""
    h = np.uint64(0x9E3779B97F4A7C15) ^ np.asarray(seed, np.uint64)
    for c in columns:
        h = (h ^ c) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(32))
    return h


def gram_hashes(flat: np.ndarray, places: np.ndarray) -> np.ndarray:
    words = _words(flat)
    return _folded([words[places + k] for k in range(0, GRAM, 8)])


def sides(flat: np.ndarray, places: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, n_left, n_right) of anchors whose texts go from begin to end: the bytes before the anchor, nearest
    first, and those after its gram, zeros beyond the text; and how many bytes are real, to the right with the gram."""
    reach = length - GRAM
    n_left, n_right = np.minimum(places - begin, reach), np.minimum(end - places, length)
    left, right = np.empty((len(places), reach), np.uint8), np.empty((len(places), reach), np.uint8)
    at = np.arange(reach)
    for a in range(0, len(places), 1 << 14):
        p = places[a : a + (1 << 14), None]
        left[a : a + (1 << 14)] = flat[np.maximum(p - 1 - at, 0)]
        right[a : a + (1 << 14)] = flat[np.minimum(p + GRAM + at, len(flat) - 1)]
    left[at >= n_left[:, None]] = 0
    right[at >= n_right[:, None] - GRAM] = 0
    return left, right, n_left, n_right


def class_hashes(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    width = -(-left.shape[1] // 8) * 8
    wide = np.zeros((len(left), 2 * width), np.uint8)
    wide[:, : left.shape[1]], wide[:, width : width + right.shape[1]] = left, right
    return _folded(wide.view("<u8").T, (n_left * 4096 + n_right).astype(np.uint64))


class Bits:
    """A Bloom filter with two bits a key over 64-bit hashes; the number of bits is a power of two."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.shift = 64 - (len(words) * 64).bit_length() + 1

    def __contains__(self, keys) -> bool:
        raise TypeError("use `holds`")

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            at = (keys * np.uint64(m)) >> np.uint64(self.shift)
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out

    @staticmethod
    def words_of(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, mask) pairs of the keys, each word once."""
        shift = 64 - bits.bit_length() + 1
        at = np.concatenate([(keys * np.uint64(m)) >> np.uint64(shift) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)])
        word, inverse = np.unique((at >> np.uint64(6)).astype(np.int64), return_inverse=True)
        mask = np.zeros(len(word), np.uint64)
        np.bitwise_or.at(mask, inverse, np.uint64(1) << (at & np.uint64(63)))
        return word, mask


def filter_of(keys: DataFrame, count: int, most_bits: int) -> np.ndarray:
    """The words of a Bloom filter over the long column `key`; about 16 bits a key, at most `most_bits`."""
    bits = min(most_bits, max(1 << 12, 1 << max(1, 16 * count - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word, mask = Bits.words_of(_numpy(b.column(0)).view(np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view(np.int64))], names=["word", "mask"])

    rows = keys.mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("mask").to_numpy().view(np.uint64)
    return words


def _numpy(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _row_key(gram: np.ndarray, order: np.ndarray, h: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """One hash of (gram, row, place)."""
    return _folded([order.view(np.uint64), h.view(np.uint64), pos.astype(np.int64).view(np.uint64)], gram)


class Found:
    """Anchors of some texts: `places` in `flat`, their `grams`, and the text each is of."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray, order: np.ndarray, h: np.ndarray, length: int):
        self.flat, self.length = flat, length
        self.places = anchors(flat, offsets, length)
        self.grams = gram_hashes(flat, self.places)
        row = np.searchsorted(offsets, self.places, side="right") - 1
        self.begin, self.end, self.order, self.h = offsets[row], offsets[row + 1], order[row], h[row]

    def keep(self, which: np.ndarray) -> None:
        for name in ("places", "grams", "begin", "end", "order", "h"):
            setattr(self, name, getattr(self, name)[which])

    @property
    def pos(self) -> np.ndarray:
        return self.places - self.begin

    def sides(self):
        return sides(self.flat, self.places, self.begin, self.end, self.length)


def _scan(length: int, emit: Callable[[], Callable[[Found], pa.RecordBatch]]):
    """A function over batches (text, order, hash) that yields what `emit()(anchors of some texts)` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        put = emit()
        for b in batches:
            if not b.num_rows:
                continue
            text = pc.fill_null(b.column(0), b"").cast(pa.large_binary())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            body = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            order, h = _numpy(b.column(1)), _numpy(b.column(2))
            cut = np.flatnonzero(np.diff((offsets[1:] - offsets[0]) // BATCH)) + 1
            for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(text)], strict=True):
                part = Found(body[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], order[a:z], h[a:z], length)
                if len(part.places):
                    yield put(part)

    return run


def _longs(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns], names=names)


def _of_width(rows: np.ndarray) -> pa.Array:
    """A binary array from a byte matrix."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if not len(column):
        return np.zeros((0, width), np.uint8)
    return np.frombuffer(column.buffers()[2], np.uint8)[np.frombuffer(column.buffers()[1], np.int32)[column.offset] :][: len(column) * width].reshape(-1, width)


CLASSES = "gram long, cls long, ord long, h long, pos long, late boolean"
AROUND = "gram long, ord long, h long, pos long, n_left int, n_right int, left binary, right binary"


def _class_rows(length: int, known: Callable[[], Bits]):
    """Anchors of known grams with the hash of their surroundings. Of equal ones met together all but the first are late at once."""

    def emit():
        bits = known()

        def put(found: Found) -> pa.RecordBatch:
            found.keep(bits.holds(found.grams >> np.uint64(24)))
            cls = class_hashes(*found.sides())
            gram, order, h, pos = found.grams, found.order, found.h, found.pos
            place = np.lexsort((pos, h, order, cls, gram))
            late = np.zeros(len(place), bool)
            late[place[1:]] = (gram[place[1:]] == gram[place[:-1]]) & (cls[place[1:]] == cls[place[:-1]])
            # what is settled is dealt by its row, lest it gather at its class
            gram = np.where(late, _row_key(gram, order, h, pos), gram)
            b = _longs(["gram", "cls", "ord", "h", "pos"], gram, cls, order, h, pos)
            return b.append_column("late", pa.array(late))

        return put

    return _scan(length, emit)


def _first_of_classes(length: int):
    """Sorted anchors (CLASSES) to the first of each class (gram, ord, h, start = place, end null) and intervals of all others (gram null)."""
    reach = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = (None, None)
        for b in batches:
            if not b.num_rows:
                continue
            late = _numpy(b.column("late"))
            gram, cls, order, h, pos = (_numpy(b.column(c)) for c in ("gram", "cls", "ord", "h", "pos"))
            again = late.copy()
            own = np.flatnonzero(~late)
            if len(own):
                g, c = gram[own], cls[own]
                again[own] = np.concatenate([[(g[0], c[0]) == before], (g[1:] == g[:-1]) & (c[1:] == c[:-1])])
                before = (g[-1], c[-1])
            start = np.where(again, np.maximum(pos - reach, 0), pos)
            yield pa.RecordBatch.from_arrays([pa.array(gram, mask=again), pa.array(order), pa.array(h), pa.array(start), pa.array(pos + length, mask=~again)], names=["gram", "ord", "h", "start", "end"])

    return run


def _lcp(rows: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Common prefix of neighbouring rows of a byte matrix; -1 where `same` is false."""
    differ = rows[1:] != rows[:-1]
    out = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return np.where(same, out, -1)


def _with_agreement(reach: int):
    """Rows (AROUND) sorted by gram and right side, with `agree`: how many bytes of it any other row has in common; rows alone go.

    What lies beyond the ends of the sorted run is unknown and counts as equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        prior = reach

        def out(b: pa.RecordBatch, following: int | None) -> tuple[pa.RecordBatch, int]:
            gram, right = _numpy(b.column("gram")), _matrix(b.column("right"), reach)
            near = _lcp(right, gram[1:] == gram[:-1])
            agree = np.maximum(np.concatenate([[prior], near]), np.concatenate([near, [-1 if following is None else following]]))
            some = pa.array(agree >= 0)
            return b.append_column("agree", pa.array(agree.astype(np.int32))).filter(some), near

        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                ends = [held.slice(held.num_rows - 1), b.slice(0, 1)]
                gram = [_numpy(e.column("gram"))[0] for e in ends]
                two = np.concatenate([_matrix(e.column("right"), reach) for e in ends])
                between = int(_lcp(two, np.array([gram[0] == gram[1]]))[0])
                yield out(held, between)[0]
                prior = between
            held = b
        if held is not None:
            yield out(held, reach)[0]

    return run


def right_order(gram: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp with the one before) of byte rows under their gram's number, by a suffix array over packed symbols."""
    n, width = right.shape
    count = -(-width // SYMBOL)
    packed = np.zeros((n, count * SYMBOL), np.uint8)
    packed[:, :width] = right
    _, ranks = np.unique(packed.view(f"V{SYMBOL}"), return_inverse=True)
    text = np.concatenate([gram[:, None] + 1, ranks.reshape(n, count) + int(gram.max()) + 2], axis=1)
    sa = suffix_array(text.ravel())
    order = sa[sa % (count + 1) == 0] // (count + 1)
    return order, np.concatenate([[-1], _lcp(right[order], gram[order[1:]] == gram[order[:-1]])])


PIECE = "k1 long, k2 long, ord long, h long, at long, end long"


class Edges:
    """Decides blocks of rows (AROUND with agree) sorted by gram and left side.

    Repeats leave as intervals (null hashes). In grams that go on beyond the block, which `open` marks, the first of
    equal candidates leave with their hash and their start."""

    def __init__(self, length: int, rows: int = 6000):
        self.length, self.reach, self.rows = length, length - GRAM, rows

    def solve(self, part: dict[str, np.ndarray], open_rows: np.ndarray) -> pa.RecordBatch | None:
        length, reach = self.length, self.reach
        gram = np.cumsum(np.concatenate([[0], part["gram"][1:] != part["gram"][:-1]]))
        near = np.concatenate([[-1], _lcp(part["left"], gram[1:] == gram[:-1])])
        agree = np.maximum(near, np.append(near[1:], -1))
        for end in (0, -1):
            if open_rows[end]:  # its neighbour is not known
                agree[end] = reach
        low = length - np.minimum(part["agree"] + GRAM, part["n_right"])
        high = np.minimum(agree, part["n_left"])
        keep = np.flatnonzero(low <= high)
        if not len(keep):
            return None
        low, high, own, open_ = low[keep], high[keep], gram[keep], open_rows[keep]
        order, h, pos = (part[c][keep] for c in ("ord", "h", "pos"))
        corpus = np.empty(len(keep), np.int64)
        corpus[np.lexsort((pos, h, order))] = np.arange(len(keep))
        ro, rl = right_order(np.unique(own, return_inverse=True)[1], part["right"][keep])
        rl = np.where(rl >= 0, rl + GRAM, rl)
        cls_r = np.empty(len(keep), np.int64)
        hit, lead = np.zeros((reach + 1, len(keep)), bool), np.zeros((reach + 1, len(keep)), bool)
        for r in range(int(low.min()), int(high.max()) + 1):
            live = np.flatnonzero((low <= r) & (r <= high))
            if not len(live):
                continue
            cls_r[ro] = np.cumsum(rl < length - r)
            key = np.cumsum(near < r)[keep[live]] * (len(keep) + 1) + cls_r[live]
            place = np.lexsort((corpus[live], key))
            first = np.concatenate([[True], key[place[1:]] != key[place[:-1]]])
            hit[r, live[place[~first]]] = True
            leading = live[place[first]]
            lead[r, leading] = open_[leading]
        o, hashes, begin, end = _stretches(hit, order, h, pos, length)
        back, row = np.nonzero(lead)
        left, right = part["left"][keep], part["right"][keep]
        digests = [xxhash.xxh3_128_digest(b"%d %d " % (g, r) + left[i, :r].tobytes() + right[i, : reach - r].tobytes()) for g, r, i in zip(part["gram"][keep][row].tolist(), back.tolist(), row.tolist(), strict=True)]
        key = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        nulls = pa.nulls(len(o), pa.int64())
        longs = [np.concatenate([order[row], o]), np.concatenate([h[row], hashes]), np.concatenate([pos[row] - back, begin]), np.concatenate([np.zeros(len(row), np.int64), end])]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(key[:, i].copy()), nulls]) for i in (0, 1)] + [pa.array(c.astype(np.int64)) for c in longs], names=["k1", "k2", "ord", "h", "at", "end"])

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("gram", "ord", "h", "pos", "n_left", "n_right", "agree")
        held: dict[str, np.ndarray] | None = None
        going_on = None  # the gram that may have begun before these rows

        def split(at: int, ended: bool) -> pa.RecordBatch | None:
            nonlocal held, going_on
            part, held = {k: v[:at] for k, v in held.items()}, {k: v[at:] for k, v in held.items()}
            last = part["gram"][-1] if ended or not len(held["gram"]) or held["gram"][0] == part["gram"][-1] else None
            open_rows = np.zeros(at, bool)
            for g in (going_on, last):
                if g is not None:
                    open_rows |= part["gram"] == g
            going_on = last
            return self.solve(part, open_rows)

        for b in batches:
            if not b.num_rows:
                continue
            new = {n: _numpy(b.column(n)) for n in names} | {n: _matrix(b.column(n), self.reach) for n in ("left", "right")}
            if held is None:
                held, going_on = new, new["gram"][0]
            else:
                held = {k: np.concatenate([v, new[k]]) for k, v in held.items()}
            while len(held["gram"]) > self.rows:
                bounds = np.flatnonzero(held["gram"][1:] != held["gram"][:-1]) + 1
                near = bounds[bounds <= self.rows]
                at = int(near[-1]) if len(near) else min([4 * self.rows, *bounds[:1].tolist()])
                if at > len(held["gram"]):
                    break  # the gram may end soon
                if (got := split(at, False)) is not None:
                    yield got
        if held is not None and len(held["gram"]) and (got := split(len(held["gram"]), True)) is not None:
            yield got


def _stretches(hit: np.ndarray, order: np.ndarray, h: np.ndarray, pos: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, hash, start, end) of the stretches that each row's runs of repeated strings cover. hit: [r, row]."""
    pad = np.zeros((1, hit.shape[1]), bool)
    edge = np.diff(np.concatenate([pad, hit, pad]).astype(np.int8), axis=0)
    rows, low = np.nonzero(edge.T == 1)
    _, high = np.nonzero(edge.T == -1)
    at = pos[rows]
    return order[rows], h[rows], at - (high - 1), at - low + length


INTERVAL = "ord long, h long, start long, end long"


def repeated_intervals(docs: DataFrame, id: str, text: str, *, length: int, most_bits: int, block_rows: int, keep: list) -> DataFrame:
    """(ord, h, start, end) of repeats; intervals of a row may overlap. Tables written on the way are added to `keep`."""
    sc = docs.sparkSession.sparkContext
    reach = length - GRAM
    source = docs.select(F.col(text).cast("binary").alias("text"), F.coalesce(F.col(id).try_cast("long"), F.lit(LAST)).alias("ord"), F.xxhash64(F.col(text)).alias("h"))
    save = lambda df: stored(df, keep)

    # 40 bits are enough to tell which grams may repeat
    grams = source.mapInArrow(_scan(length, lambda: lambda found: _longs(["key"], found.grams >> np.uint64(24))), "key long")
    repeated = save(grams.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    marks = sc.broadcast(filter_of(repeated, repeated.count(), most_bits))

    met = source.mapInArrow(_class_rows(length, lambda: Bits(marks.value)), CLASSES).repartition("gram", "cls").sortWithinPartitions("gram", "cls", "ord", "h", "pos")
    classes = save(met.mapInArrow(_first_of_classes(length), "gram long, ord long, h long, start long, end long"))
    whole = classes.where("gram is null").select("ord", "h", "start", "end")

    # edges: the first of each class of grams with several classes
    firsts = classes.where("gram is not null").select("gram", "ord", "h", "start")
    several = save(firsts.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("gram").alias("key")))
    split = sc.broadcast(filter_of(several, several.count(), most_bits))

    def row_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Bits(split.value)
        for b in batches:
            gram, order, h, pos = (_numpy(c) for c in b.columns)
            some = bits.holds(gram.view(np.uint64))
            yield _longs(["key"], _row_key(gram.view(np.uint64), order, h, pos)[some])

    edges = save(firsts.mapInArrow(row_keys, "key long"))
    wanted = sc.broadcast(filter_of(edges, edges.count(), most_bits))

    def surroundings():
        bits = Bits(wanted.value)

        def put(found: Found) -> pa.RecordBatch:
            found.keep(bits.holds(_row_key(found.grams, found.order, found.h, found.pos)))
            left, right, n_left, n_right = found.sides()
            rest = [pa.array(n_left.astype(np.int32)), pa.array(n_right.astype(np.int32)), _of_width(left), _of_width(right)]
            longs = _longs(["gram", "ord", "h", "pos"], found.grams, found.order, found.h, found.pos)
            return pa.RecordBatch.from_arrays([*longs.columns, *rest], names=[*longs.schema.names, "n_left", "n_right", "left", "right"])

        return put

    around = save(source.mapInArrow(_scan(length, surroundings), AROUND))
    by_right = around.repartitionByRange("gram", "right", "left").sortWithinPartitions("gram", "right")
    agreed = save(by_right.mapInArrow(_with_agreement(reach), AROUND + ", agree int"))
    by_left = agreed.repartitionByRange("gram", "left", "right").sortWithinPartitions("gram", "left")
    pieces = save(by_left.mapInArrow(Edges(length, block_rows).run, PIECE))
    strings = pieces.where("k1 is not null")
    least = strings.groupBy("k1", "k2").agg(F.min(F.struct("ord", "h", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    late = strings.join(least, ["k1", "k2"]).where(F.struct("ord", "h", "at") != F.col("first"))
    between = late.select("ord", "h", F.col("at").alias("start"), (F.col("at") + length).alias("end"))
    within = pieces.where("k1 is null").select("ord", "h", F.col("at").alias("start"), "end")
    return whole.unionByName(within).unionByName(between)


SPANS = "ord long, h long, start array<long>, end array<long>"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals sorted by row and start to one list of disjoint spans a row."""

    def out(order: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        row = np.cumsum(np.concatenate([[0], (order[1:] != order[:-1]) | (h[1:] != h[:-1])]))
        reach = np.empty(len(row), np.int64)  # the farthest end so far in the row
        bounds = np.flatnonzero(np.diff(row, prepend=-1))
        top = int(end.max()) + 1
        if top * (int(row[-1]) + 1) < LAST:
            reach = np.maximum.accumulate(end + row * top) - row * top
        else:
            for a, z in zip(bounds, [*bounds[1:], len(row)], strict=True):
                reach[a:z] = np.maximum.accumulate(end[a:z])
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] > reach[:-1])])
        at = np.flatnonzero(new)
        close = np.append(at[1:], len(row)) - 1
        size = np.bincount(row[at])
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (start[at], reach[close])]
        return pa.RecordBatch.from_arrays([pa.array(order[bounds]), pa.array(h[bounds]), *lists], names=["ord", "h", "start", "end"])

    held: list[np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        new = [_numpy(c) for c in b.columns]
        held = new if held is None else [np.concatenate([x, y]) for x, y in zip(held, new, strict=True)]
        order, h = held[:2]
        last = np.flatnonzero((order != order[-1]) | (h != h[-1]))  # the last row may go on
        if len(last):
            at = int(last[-1]) + 1
            yield out(*(c[:at] for c in held))
            held = [c[at:] for c in held]
    if held is not None:
        yield out(*held)


def cut_out(text: bytes | None, spans: list[tuple[int, int]]) -> tuple[int, int, int, bytes]:
    text = text or b""
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at:a])
        at = b
    kept = b"".join([*parts, text[at:]])
    return len(text), len(text) - len(kept), len(spans), kept


def dedup_substrings(docs: DataFrame, *, id: str = "doc_id", text: str = "text", length: int = 100, most_bits: int = 1 << 30, max_shared: int = 1 << 18, block_rows: int = 6000) -> DataFrame:
    """`docs` with a struct column (n_bytes, n_removed, n_spans, kept) as its last column.

    `block_rows` is about how many rows at an edge a task holds at once; results do not depend on it."""
    spark, keep = docs.sparkSession, []
    found = repeated_intervals(docs, id, text, length=length, most_bits=most_bits, block_rows=block_rows, keep=keep)
    runs = found.repartition("ord", "h").sortWithinPartitions("ord", "h", "start")
    per_row = stored(runs.mapInArrow(_merged, SPANS))
    dropped(spark, keep)
    out = fresh(docs, "repeats")
    order, h = F.coalesce(F.col(id).try_cast("long"), F.lit(LAST)), F.xxhash64(F.col(text))
    binary = F.col(text).cast("binary")
    if (per_row.agg(F.sum(F.size("start"))).first()[0] or 0) <= max_shared:
        rows = per_row.orderBy("ord", "h").select("ord", "h", F.size("start").alias("n"), "start", "end").toArrow()
        flat = [np.concatenate([np.zeros(0, np.int64), *(c.flatten().to_numpy() for c in rows.column(n).chunks)]) for n in ("start", "end")]
        table = spark.sparkContext.broadcast((rows.column("ord").to_numpy(), rows.column("h").to_numpy(), np.cumsum(np.append(0, rows.column("n").to_numpy())), *flat))

        def start():
            orders, hashes, ends, starts, stops = table.value

            def row(t, o, h):
                a, b = np.searchsorted(orders, o), np.searchsorted(orders, o, side="right")
                i = a + int(np.searchsorted(hashes[a:b], h))
                mine = slice(ends[i], ends[i + 1]) if i < b and hashes[i] == h else slice(0, 0)
                return cut_out(t, list(zip(starts[mine].tolist(), stops[mine].tolist(), strict=True)))

            return row

        return docs.withColumn(out, rows_udf(start, RESULT)(binary, order, h))
    names = {c: fresh(docs, f"_{c}") for c in ("ord", "h", "start", "end")}
    joined = docs.join(per_row.withColumnsRenamed(names), (order == F.col(names["ord"])) & (h == F.col(names["h"])), "left")
    give: Column = rows_udf(lambda: lambda t, a, b: cut_out(t, list(zip(a or (), b or (), strict=True))), RESULT)(binary, F.col(names["start"]), F.col(names["end"]))
    return joined.withColumn(out, give).drop(*names.values())


def brute_force(texts: list[bytes], length: int) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, digest of what stays) by a table of all strings; for tests."""
    seen: set[bytes] = set()
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            if s in seen:
                gone[p : p + length] = True
            seen.add(s)
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(gone[: len(t)].astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out
