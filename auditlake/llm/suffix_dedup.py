"""Suffix-array dedup: maximal repeats, found in common-prefix interval trees over anchors.

A rule says which strings count as repeats: all of `least` bytes (Bytes), or all of
so many words whatever their bytes (Words). Two equal strings have the same
leftmost minimal gram at the same place. So each document's windows are put under
such anchors (one in about half a window), and only anchors meet across documents,
by the hash of their gram. An anchor's context is the union of its windows.

First the grams are counted, and a bitmap of those that are met twice goes to all
tasks (FILTER_MOST bits at most; what it wrongly lets pass the counts clear). Only
anchors of such grams are written. Anchors with equal contexts are one suffix, of
which the classes table keeps one representative and the number. The classes of a
gram form a sparse enhanced suffix array: sorted right contexts with their common
prefixes. A stack scan yields its interval tree; in every interval the left contexts
are tested for diversity, which splits its suffixes into groups of maximal repeats,
each extended to the left as far as any other occurrence allows. A suffix of several
members is an interval of its own, as deep as its context. Every group goes back to
all members of its suffixes, so that it has all occurrences and not just neighbours.

A gram with more than `most` classes would be a large group in one task: the windows
of its anchors are put under anchors again, with longer grams, until these are whole
windows, whose contexts are equal wherever their grams are.

Strings are compared byte by byte in the interval trees. Elsewhere a context stands
for itself by two 64-bit hashes with different bases, its gram's and its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEYS_SENT, Scratch, join_keyed, mix, parted, prefix_hash, slices, span_hash, text_buffers, words_of, written

LEAST, GRAM = 400, 32
#: Words in a gram that anchors a window of words.
WORD_GRAM = 12
#: Classes of a gram that one task compares; those of a gram with more are anchored again with longer grams.
MOST_CLASSES = 20_000
#: Bits of the bitmap for each gram that is met twice, and its largest size in bits (32 MB).
FILTER_BITS_A_GRAM, FILTER_LEAST, FILTER_MOST = 8, 1 << 20, 1 << 28
_CHUNK = 1 << 20
_U = np.uint64


@dataclass(frozen=True)
class Bytes:
    """Strings of `least` bytes, anchored by grams of `gram` bytes."""

    least: int = LEAST
    gram: int = GRAM
    unit = 1

    def longer(self) -> Bytes:
        return Bytes(self.least, min(4 * self.gram, self.least))

    def whole(self) -> bool:
        return self.gram >= self.least

    def anchors(self, data: np.ndarray, offsets: np.ndarray):
        """For texts lying one after another: of each anchor its text, place, the context's first and stop (places in data), and its gram's hash."""
        prefix = prefix_hash(data)
        found = []
        last_window = len(data) - self.least
        width = self.least - self.gram + 1
        bad = np.zeros(len(data) + 1, np.int32)  # windows that run over a text's end
        ends = offsets[1:-1] if len(offsets) > 2 else offsets[:0]
        np.add.at(bad, np.maximum(ends - self.least + 1, 0), 1)
        np.add.at(bad, ends, -1)
        bad = np.cumsum(bad, dtype=np.int32)
        for c in range(0, last_window + 1, _CHUNK):
            windows = min(_CHUNK, last_window + 1 - c)
            at = np.arange(c, c + windows + width - 1)
            key = (span_hash(prefix, at, at + self.gram) & _U(0xFFFFFFFFFF000000)) | (at - c).astype(np.uint64)
            blocks = -(-len(key) // width)
            padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
            padded[: len(key)] = key
            table = padded.reshape(blocks, width)
            forth = np.minimum.accumulate(table, axis=1).reshape(-1)
            back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
            least_key = np.minimum(back[:windows], forth[width - 1 : width - 1 + windows])
            place = (least_key & _U(0xFFFFFF)).astype(np.int64) + c
            window = np.flatnonzero(bad[c : c + windows] == 0)
            if not len(window):
                continue
            place = place[window]
            window += c
            new = np.ones(len(window), bool)
            new[1:] = (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)
            starts = np.flatnonzero(new)
            stops = np.append(starts[1:], len(window)) - 1
            found.append((place[starts], window[starts], window[stops]))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none, none, np.zeros(0, np.uint64)
        place, first, last = (np.concatenate([x[k] for x in found]) for k in range(3))
        # hashed once more, for least hashes have small high bits
        return np.searchsorted(offsets, first, side="right") - 1, place, first, last + self.least, mix(span_hash(prefix, place, place + self.gram))

    def contexts(self, data: np.ndarray, offsets: np.ndarray, first: np.ndarray, place: np.ndarray, stop: np.ndarray):
        """For each anchor what is left of it, from right to left, and what is right of it, in codes of `unit` bytes."""
        raw = data.tobytes()
        for a, p, b in zip(first.tolist(), place.tolist(), stop.tolist()):
            yield raw[a:p][::-1], raw[p:b]

    @staticmethod
    def length(side: bytes, codes: int) -> int:
        """The bytes of text that the first codes of a side stand for."""
        return codes


@dataclass(frozen=True)
class Words:
    """Strings of `least` words with the white space between them, anchored by grams of `gram` words."""

    least: int
    gram: int = WORD_GRAM
    unit = 12  # a word's hash (8 bytes) and its length with the white space towards the anchor (4 bytes)

    def longer(self) -> Words:
        return Words(self.least, min(2 * self.gram, self.least))

    def whole(self) -> bool:
        return self.gram >= self.least

    def anchors(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, of, _ = words_of(data, offsets, hashed=False)
        if len(starts) < self.least:
            none = np.zeros(0, np.int64)
            return none, none, none, none, np.zeros(0, np.uint64)
        grams = len(starts) - self.gram + 1
        own = span_hash(prefix_hash(data), starts[:grams], ends[self.gram - 1 :])
        # the least hash of a window, of equal ones the leftmost: places are in the low bits, as many in every slice
        bits = _U(max(24, grams.bit_length()))
        key = (own >> bits << bits) | np.arange(grams, dtype=np.uint64)
        width, have = self.least - self.gram + 1, 1
        while have < width:
            step = min(have, width - have)
            key = np.minimum(key[:-step], key[step:])
            have += step
        place = (key & ((_U(1) << bits) - _U(1))).astype(np.int64)
        window = np.flatnonzero(of[: len(starts) - self.least + 1] == of[self.least - 1 :])
        place = place[window]
        new = np.ones(len(window), bool)
        new[1:] = (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)
        head = np.flatnonzero(new)
        if not len(head):
            none = np.zeros(0, np.int64)
            return none, none, none, none, np.zeros(0, np.uint64)
        tail = np.append(head[1:], len(window)) - 1
        return of[window[head]], starts[place[head]], starts[window[head]], ends[window[tail] + self.least - 1], mix(own[place[head]])

    def contexts(self, data: np.ndarray, offsets: np.ndarray, first: np.ndarray, place: np.ndarray, stop: np.ndarray):
        starts, ends, _, _ = words_of(data, offsets, hashed=False)
        prefix = prefix_hash(data)
        # left: words with the white space after them, right: the anchor's word, then words with the white space before them
        left, own, right = self._codes(prefix, starts[:-1], starts[1:]), self._codes(prefix, starts, ends), self._codes(prefix, ends[:-1], ends[1:])
        a, s, b = np.searchsorted(starts, first), np.searchsorted(starts, place), np.searchsorted(ends, stop)
        for f, k, e in zip(a.tolist(), s.tolist(), b.tolist()):
            yield left[f:k][::-1].tobytes(), own[k].tobytes() + right[k:e].tobytes()

    @staticmethod
    def _codes(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), np.dtype([("hash", ">u8"), ("length", ">u4")]))
        out["hash"], out["length"] = span_hash(prefix, a, b), b - a
        return out

    @staticmethod
    def length(side: bytes, codes: int) -> int:
        return int(np.frombuffer(side, np.dtype([("hash", ">u8"), ("length", ">u4")]), codes)["length"].sum())


_ANCHORS = "gram long, ctx long, key long, doc_id long, pos long, lead long, tail long"
_NAMES = ["gram", "ctx", "key", "doc_id", "pos", "lead", "tail"]


def _in_bitmap(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = (keys >> _U(64 - (8 * len(bits)).bit_length() + 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _grams(batches, rule):
    """(gram, n): the grams of anchors and how many anchors of a slice have them."""
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            gram, n = np.unique(rule.anchors(*text_buffers(part.column(2)))[4], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], ["gram", "n"])


def _anchor_rows(data: np.ndarray, offsets: np.ndarray, rule, bits: np.ndarray | None):
    """Text, and the columns gram, ctx, place, lead, tail of the anchors whose gram is in the bitmap."""
    of, place, first, stop, gram = rule.anchors(data, offsets)
    if bits is not None:
        pick = np.flatnonzero(_in_bitmap(gram, bits))
        of, place, first, stop, gram = (x[pick] for x in (of, place, first, stop, gram))
    lead, tail = place - first, stop - place
    other = prefix_hash(data, second=True)
    context = mix(span_hash(other, first, stop, second=True) + mix(lead.astype(np.uint64)) * _U(3))
    return of, gram.view(np.int64), context.view(np.int64), place, lead, tail


def _survey(batches, rule, bits: np.ndarray):
    """(gram, ctx, key, doc_id, pos, lead, tail): the anchors whose gram is in the bitmap; a context is text[pos - lead : pos + tail]."""
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            data, offsets = text_buffers(part.column(2))
            of, gram, context, place, lead, tail = _anchor_rows(data, offsets, rule, bits)
            take = pa.array(of)
            columns = [gram, context, part.column(0).take(take), part.column(1).take(take), place - offsets[of], lead, tail]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], _NAMES)


def _held(batches):
    """Slices of texts with their anchors: the slice, its bytes and where texts begin in them, and of each anchor in `held` its text's row, itself, and its context's first, place and stop."""
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            data, offsets = text_buffers(part.column(2))
            lists = part.column(3)
            row = np.repeat(np.arange(len(part)), np.asarray(lists.value_lengths()))
            anchors = lists.flatten()
            of = lambda name: np.asarray(anchors.field(name))  # noqa: E731, B023
            place = offsets[row] + of("pos")
            yield part, (data, offsets), row, anchors, place - of("lead"), place, place + of("tail")


def _survey_again(batches, rule):
    """The anchors by a rule with longer grams of the windows that the anchors in `held` have."""
    for part, (data, texts), row, _, first, place, stop in _held(batches):
        # contexts one after another, as if they were texts
        begin = first - np.concatenate([[0], np.cumsum(stop - first)])[:-1]
        offsets = np.concatenate([[0], np.cumsum(stop - first)])
        own = data[np.arange(offsets[-1]) + np.repeat(begin, stop - first)]
        of, gram, context, at, lead, tail = _anchor_rows(own, offsets, rule, None)
        take = pa.array(row[of])
        columns = [gram, context, part.column(0).take(take), part.column(1).take(take), at + begin[of] - texts[row[of]], lead, tail]
        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], _NAMES)


def _contexts(batches, rule):
    """(gram, ctx, n, left, right) of each anchor in `held`."""
    names = ["gram", "ctx", "n", "left", "right"]
    for _, texts, _, anchors, first, place, stop in _held(batches):
        for at in range(0, len(first), 4096):
            some = slice(at, at + 4096)
            lefts, rights = zip(*rule.contexts(*texts, first[some], place[some], stop[some]))
            columns = [*(anchors.field(c).slice(at, 4096) for c in names[:3]), pa.array(lefts, pa.binary()), pa.array(rights, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)


def common_prefix(a: bytes, b: bytes, unit: int = 1) -> int:
    """How many codes of `unit` bytes two strings have in common from their beginnings on."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n // unit
    return (n - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8) // unit


class _RangeMin:
    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while (1 << len(self.rows)) <= len(values):
            half = 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(self.rows[-1][:-half], self.rows[-1][half:]))

    def over(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minima of values[a:b], each range with one value at least."""
        level = np.log2(b - a).astype(np.int64)
        out = np.empty(len(a), np.int64)
        for x in np.unique(level):
            some = level == x
            out[some] = np.minimum(self.rows[x][a[some]], self.rows[x][b[some] - (1 << x)])
        return out


def intervals(prefixes: list[int]):
    """(depth, first, last) of the common-prefix intervals, deepest first on each path; prefixes[i]: between suffixes i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*prefixes, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            top, first = stack.pop()
            yield top, first, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], least: int):
    """(group, member, left, right) for anchors with contexts lefts[i] + rights[i]: see suffix_groups."""
    return suffix_groups([x[::-1] for x in lefts], rights, least)


def suffix_groups(lefts: list[bytes], rights: list[bytes], least: int, unit: int = 1):
    """(group, member, left, right) for anchors with contexts to both sides, the left ones from right to left, in codes of `unit` bytes.

    Each group is a maximal repeat with all its occurrences: its members share
    `right` codes from their anchors on, and each shares `left` codes before it
    with another member; together at least `least` codes.
    """
    n = len(lefts)
    order = sorted(range(n), key=rights.__getitem__)
    prefixes = [common_prefix(rights[a], rights[b], unit) for a, b in zip(order, order[1:])]
    by_left = sorted(range(n), key=lefts.__getitem__)
    shared = np.array([common_prefix(lefts[a], lefts[b], unit) for a, b in zip(by_left, by_left[1:])], np.int64)
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    minima = _RangeMin(shared)
    longest = int(shared.max()) if n > 1 else 0
    group = 0
    members = np.array(order)
    by_left = np.array(by_left)
    for depth, first, last in intervals(prefixes):
        need = max(0, least - depth)
        if need > longest:
            continue
        ranks = np.sort(rank[members[first : last + 1]])
        common = minima.over(ranks[:-1], ranks[1:])
        alike = common >= need
        if not alike.any():
            continue
        # left-diverse runs of suffixes that agree on `need` codes at least
        head = np.append(True, ~alike)
        number = np.cumsum(head) - 1
        best = np.maximum(np.append(0, np.where(alike, common, 0)), np.append(np.where(alike, common, 0), 0))
        in_group = np.append(False, alike) | np.append(alike, False)
        for g, r, left in zip(number[in_group].tolist(), ranks[in_group].tolist(), best[in_group].tolist()):
            yield group + g, int(by_left[r]), left, depth
        group += int(number[-1]) + 1


def _trees(batches, rule, cover: bool):
    """Rows (gram, ctx, n, left, right) sorted by gram -> (gram, ctx, n, repeat, left, right): each maximal repeat and its suffixes, with the bytes to either side.

    With `cover` only what suffices to know the covered bytes: a suffix of several
    members is covered as a whole, so only suffixes of one are put out, with the
    farthest that any of their repeats, all of which hold the anchor, goes to either side.
    """
    names = ["gram", "ctx", "n", "repeat", "left", "right"]
    out: list[tuple] = []

    def solve(run: list[tuple]):
        found = suffix_groups([r[3] for r in run], [r[4] for r in run], rule.least, rule.unit)
        if cover:
            far: dict[int, tuple[int, int]] = {}
            for _, member, left, right in found:
                if run[member][2] == 1:
                    before = far.get(member, (0, 0))
                    far[member] = max(before[0], left), max(before[1], right)
            found = [(None, member, left, right) for member, (left, right) in far.items()]
        for group, member, left, right in found:
            gram, ctx, n, own_left, own_right = run[member]
            out.append((gram, ctx, n, group, rule.length(own_left, left), rule.length(own_right, right)))

    def flush():
        columns = list(zip(*out)) or [()] * 6
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    run: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if run and row[0] != run[0][0]:
                if len(run) > 1:
                    solve(run)
                run = []
                if len(out) > 20_000:
                    yield flush()
            run.append(row)
    if len(run) > 1:
        solve(run)
    yield flush()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _pair_keys(gram: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """64-bit keys of grams and contexts; equal keys of equal grams are of equal contexts."""
    return mix(gram.view(np.uint64)) ^ ctx.view(np.uint64)


def _covered(batches, keys: np.ndarray, grams: np.ndarray):
    """(key, doc_id, start, stop): the contexts of anchors that are among the given suffixes, overlapping ones of a text as one."""
    for batch in batches:
        gram, ctx, key = (batch.column(k).to_numpy() for k in range(3))
        own = _pair_keys(gram, ctx)
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        hit = np.flatnonzero((keys[at] == own) & (grams[at] == gram)) if len(keys) else np.zeros(0, np.int64)
        if not len(hit):
            continue
        key, pos = key[hit], batch.column(4).to_numpy()[hit]
        start, stop = pos - batch.column(5).to_numpy()[hit], pos + batch.column(6).to_numpy()[hit]
        # a text's contexts follow one another; a smaller start begins another row of the same text
        new = np.ones(len(hit), bool)
        new[1:] = (key[1:] != key[:-1]) | (start[1:] < start[:-1]) | (start[1:] > stop[:-1])
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(hit)) - 1
        columns = [pa.array(key[head]), batch.column(3).take(pa.array(hit[head])), pa.array(start[head]), pa.array(stop[last])]
        yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "start", "stop"])


def _bitmap(grams: DataFrame, scratch: Scratch) -> np.ndarray:
    """A bitmap, by their high bits, of the 64-bit keys in `gram`; of bounded size, whatever their number."""
    bits = FILTER_LEAST
    while bits < min(FILTER_MOST, FILTER_BITS_A_GRAM * grams.count()):
        bits *= 2
    numbered = grams.select((F.shiftrightunsigned("gram", 64 - bits.bit_length() + 1) + 1).alias("bit"))
    blocks = scratch.written(numbered.groupBy(F.bitmap_bucket_number("bit").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")), "suffix-bitmap")
    out = np.zeros((bits >> 15, 4096), np.uint8)
    for r in blocks.collect():  # at most FILTER_MOST bits
        out[r["block"] - 1] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.reshape(-1)


def _whole(found: DataFrame, several: DataFrame, n_found: int, cover: bool) -> DataFrame:
    """The contexts of suffixes of several members, which repeat as they stand: (gram, repeat, key, doc_id, start, stop).

    For covered bytes only, up to KEYS_SENT suffixes go to all tasks, which put a
    text's overlapping contexts together; nothing is shuffled for that. With more,
    or for groups, anchors are joined with their suffixes.
    """
    if cover and several.count() <= KEYS_SENT:
        table = several.select("gram", "ctx").toArrow()
        gram, ctx = (np.concatenate([np.zeros(0, np.int64), c.to_numpy()]) for c in table.columns)
        keys = _pair_keys(gram, ctx)
        order = np.argsort(keys)
        keys, grams = keys[order], gram[order]
        if not (keys[1:] == keys[:-1]).any():
            shared = found.sparkSession.sparkContext.broadcast((keys, grams))
            own = found.mapInArrow(lambda b: _covered(b, *shared.value), "key long, doc_id long, start long, stop long")
            return own.selectExpr("CAST(NULL AS long) AS gram", "CAST(NULL AS long) AS repeat", "key", "doc_id", "start", "stop")
    whole = join_keyed(found, several, ["gram", "ctx"], "n", n_found)
    return whole.selectExpr("gram", "CAST(NULL AS long) AS repeat", "key", "doc_id", "pos - lead AS start", "pos + tail AS stop")


def each_once(source: DataFrame, scratch: Scratch) -> DataFrame:
    """source (key, doc_id, text) with one row for each key and doc_id, however often it is repeated; rows that stand alone are not shuffled."""
    again = scratch.written(source.groupBy("key", "doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "suffix-repeated-rows")
    if again.isEmpty():
        return source
    hit, rest = parted(source, "key", again)
    single = hit.dropDuplicates(["key", "doc_id"])
    return single if rest is None else single.unionByName(rest)


def repeats(source: DataFrame, rule, scratch: Scratch, most: int = MOST_CLASSES, cover: bool = True) -> DataFrame:
    """Of source (key, doc_id, text): (gram, repeat, key, doc_id, start, stop), the maximal repeats with all their occurrences in bytes.

    A repeat is named by gram and number; of anchors with equal contexts all
    occurrences are in a repeat of their own, named by a null number. With `cover`
    such repeats are left out as cover no further bytes.
    """
    spark = source.sparkSession
    counted = source.mapInArrow(lambda b: _grams(b, rule), "gram long, n long")
    met = scratch.written(counted.groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1").select("gram"), "suffix-met")
    bits = spark.sparkContext.broadcast(_bitmap(met, scratch))
    found = scratch.written(source.mapInArrow(lambda b, r=rule: _survey(b, r, bits.value), _ANCHORS), "suffix-anchors")
    once = each_once(source, scratch)  # equal rows have their contexts taken once
    suffix = ["gram", "ctx"]
    spans = []
    while True:
        n_found = found.count()
        rep = F.min(F.struct("key", "doc_id", "pos", "lead", "tail")).alias("rep")
        classes = scratch.written(found.groupBy(*suffix).agg(F.count("*").alias("n"), rep), "suffix-classes")
        several = classes.filter("n > 1").select(*suffix, "n")
        spans.append(_whole(found, several, n_found, cover))
        of_gram = classes.groupBy("gram").agg(F.count("*").alias("classes"), F.min("n").alias("fewest")).filter("classes > 1")
        of_gram = scratch.written(of_gram.filter("fewest = 1" if cover else "true").select("gram", "classes"), "suffix-grams")
        several_classes = scratch.written(join_keyed(classes, of_gram, "gram", "classes", classes.count()).select("gram", "ctx", "n", "classes", "rep.*"), "suffix-open")
        held = F.collect_list(F.struct("gram", "ctx", "n", "pos", "lead", "tail")).alias("held")

        def with_texts(some: DataFrame) -> DataFrame:
            lists = some.groupBy("key", "doc_id").agg(held).withColumnRenamed("doc_id", "doc2").withColumnRenamed("key", "key2")
            texts, _ = parted(once, "key", some.select("key"))
            same = (F.col("key") == F.col("key2")) & F.col("doc_id").eqNullSafe(F.col("doc2"))
            return texts.join(lists.hint("merge"), same).select("key", "doc_id", "text", "held")

        contexts = with_texts(several_classes.filter(F.col("classes") <= most)).mapInArrow(lambda b, r=rule: _contexts(b, r), "gram long, ctx long, n long, left binary, right binary")
        rows = contexts.repartition("gram").sortWithinPartitions("gram")
        trees = rows.mapInArrow(lambda b, r=rule: _trees(b, r, cover), "gram long, ctx long, n long, repeat long, left long, right long")
        trees = scratch.written(trees, "suffix-trees")
        if cover:  # of suffixes of one the representative is the only member
            members = several_classes.filter("n = 1").select(*suffix, "key", "doc_id", "pos")
            back = trees.drop("n").join(members.hint("merge"), suffix)
        else:  # a suffix has several repeats, each of which has all its members
            sized = trees.groupBy(*suffix).agg(F.first("n").alias("n"), F.collect_list(F.struct("repeat", "left", "right")).alias("own"))
            back = join_keyed(found, sized, suffix, "n", n_found).withColumn("one", F.explode("own")).select("*", "one.*")
        spans.append(back.selectExpr("gram", "repeat", "key", "doc_id", "pos - left AS start", "pos + right AS stop"))
        hot = several_classes.filter(F.col("classes") > most)
        if rule.whole() or hot.isEmpty():
            break
        rule = rule.longer()
        if not cover:
            hot = join_keyed(found, hot.select(*suffix, "n"), suffix, "n", n_found)
        found = scratch.written(with_texts(hot).mapInArrow(lambda b, r=rule: _survey_again(b, r), _ANCHORS), "suffix-anchors")
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    keyed = docs.withColumn("__key", F.xxhash64(id_col, text_col))
    return keyed, keyed.select(F.col("__key").alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def repeat_groups(docs: DataFrame, rule=None, most: int = MOST_CLASSES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(gram, repeat, doc_id, start, stop): the maximal repeats of docs by a rule (Bytes() if none is given), each with all its occurrences.

    Occurrences are byte spans. Null texts are empty; an empty table gives no rows.
    Rows that repeat an id are texts of their own; equal rows give equal spans.
    """
    scratch = Scratch(docs.sparkSession)
    source = _keyed(docs, id_col, text_col)[1]
    found = written(repeats(source, rule or Bytes(), scratch, most, cover=False).select("gram", "repeat", "doc_id", "start", "stop").distinct(), "suffix-groups")
    scratch.clear()
    return found


_NEW = ("kept", "n_bytes", "n_removed", "n_spans", "kept_text", "n_kept_chars", "n_text_removed", "n_text_spans")


def suffix_dedup(docs: DataFrame, least: int = LEAST, most: int = MOST_CLASSES, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", words: int = 0) -> DataFrame:
    """docs with kept (the text's bytes without repeats), n_bytes, n_removed, n_spans; with `words` also kept_text, n_kept_chars, n_text_removed, n_text_spans.

    Every byte is removed that a string of `least` bytes covers which also starts
    elsewhere, in the same text or another; overlapping occurrences count, matches
    never cross texts, and all is judged on the input. kept is binary, for a cut can
    fall within a character.

    kept_text is what is left once strings of so many `words`, whatever their bytes,
    are removed as well, as a string: a character that a cut parts goes whole.
    n_text_removed and n_text_spans count its removed bytes and runs.

    Null texts are empty. Rows that repeat an id, and null ids, are texts of their
    own. All columns of docs are kept, but for such as are named like the new ones.
    An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.drop(*_NEW, "__key", "__spans", "__key2", "__doc2")
    keyed, source = _keyed(docs, id_col, text_col)
    columns = ("key", "doc_id", "start", "stop")
    spans = repeats(source, Bytes(least, gram), scratch, most).select(*columns, F.lit(False).alias("by_words"))
    if words:
        spans = spans.unionByName(repeats(source, Words(words), scratch, most).select(*columns, F.lit(True).alias("by_words")))
    found = written(spans.groupBy("key", "doc_id").agg(F.collect_set(F.struct("start", "stop", "by_words")).alias("spans")), "suffix-spans")
    scratch.clear()
    hit, rest = parted(keyed, "__key", found.select(F.col("key").alias("__key")))
    same = (F.col("__key") == F.col("__key2")) & F.col(id_col).cast("long").eqNullSafe(F.col("__doc2"))
    spans = found.select(F.col("key").alias("__key2"), F.col("doc_id").alias("__doc2"), F.col("spans").alias("__spans"))
    joined = hit.join(spans.hint("merge"), same, "left").select(*docs.columns, "__spans")
    names, at = docs.columns, docs.columns.index(text_col)
    added = [("kept", pa.binary(), "binary"), *((c, pa.int64(), "long") for c in _NEW[1:4])]
    if words:
        added += [("kept_text", pa.string(), "string"), *((c, pa.int64(), "long") for c in _NEW[5:])]

    def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
        pieces, last = [], 0
        for a, b in spans:
            pieces.append(raw[last:a])
            last = b
        return b"".join([*pieces, raw[last:]])

    def cut(batches):
        for batch in batches:
            for part in slices(batch, text_col, 4 << 20):
                rows = []
                for text, held in zip(part.column(at).to_pylist(), part.column(len(names)).to_pylist()):
                    raw, held = (text or "").encode(), held or ()
                    own = merged([(x["start"], x["stop"]) for x in held if not x["by_words"]])
                    kept = without(raw, own) if own else raw
                    row = [kept, len(raw), len(raw) - len(kept), len(own)]
                    if words:
                        both = merged([(x["start"], x["stop"]) for x in held])
                        left = without(raw, both) if both else raw
                        as_text = left.decode("utf-8", "ignore")
                        row += [as_text, len(as_text), len(raw) - len(left), len(both)]
                    rows.append(row)
                new = [pa.array(c, kind) for c, (_, kind, _) in zip(zip(*rows), added)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *new], names=[*names, *(a[0] for a in added)])

    schema = docs.select(*docs.columns).schema
    for name, _, kind in added:
        schema = schema.add(name, kind)
    found = joined.mapInArrow(cut, schema)
    if rest is None:
        return found
    # texts without spans stay as they are
    text, none = F.coalesce(F.col(text_col), F.lit("")), F.lit(0).cast("long")
    whole = [text.cast("binary").alias("kept"), F.octet_length(text).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans")]
    if words:
        whole += [text.alias("kept_text"), F.char_length(text).cast("long").alias("n_kept_chars"), none.alias("n_text_removed"), none.alias("n_text_spans")]
    return found.unionByName(rest.select(*docs.columns, *whole))
