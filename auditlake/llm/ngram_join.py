"""Exact Jaccard join on word shingles by universe partition and pigeonhole.

A document's set is its distinct `words`-word shingles, as 64-bit hashes. Sets of
similar size form a band; a band has a scheme that hashes the universe of shingles
into m segments. Two sets of sizes r >= s whose similarity reaches t differ in at
most H = (r + s)(1 - t) / (1 + t) shingles. Every set is indexed, under its own
band's scheme, by the subset in each segment and, for the first few segments, by
the subsets with one shingle deleted. It probes its own band and the one below
with an allocation of at least H + 1 credits: none for a skipped segment, one for
a subset that must be equal, two for one that may differ by one shingle. So a pair
that reaches t meets in some segment. Credits go where they cost least: costs are
signature counts over all documents, held in a sketch of fixed size that only
steers the allocation.

Signatures are shuffled as packed arrays. Sets that meet are not all paired: each
is verified against one hub of its signature first. Then each is verified against
the NEAREST sets of its signatures that are still in another component, by their
parity sketches, again and again while that joins any; and only what is still in
different components then is paired whole. Pairs whose parity sketches
differ in more bits than their sets may differ in shingles are put aside, which
is exact; all others are verified on the sets themselves. Documents with equal sets are one node throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import even_keys, join_keyed, mix, slices, text_buffers, words_of, written
from .components import components

WORDS, PERCENT = 5, 80
#: Counters of the cost sketch, and the parts in which it travels.
SKETCH, SKETCH_PARTS = 1 << 18, 16
#: Signatures for which one reduce task is planned.
TASK_SIGNATURES = 1_500_000
#: Reduce partitions at most; with more tasks than that, a partition's tasks come sorted and are worked off one after another.
MOST_PARTITIONS = 1 << 14
#: Members of a signature that one task pairs with as many others.
CHUNK = 2048
#: Nearest partners that a set is verified against before all that is still apart is paired.
NEAREST = 3
INDEXED, PROBES = 1, 2

_U = np.uint64
_POWERS = mix(np.arange(64, dtype=np.uint64)) | _U(1)
_DELETED = _U(0xA5A5A5A5DEADBEEF)


class Bands:
    """Size bands whose ratio is that of the smallest partner to its set, and the schemes of the bands."""

    def __init__(self, percent: int, most: int):
        self.percent = percent
        low = [1]
        while low[-1] <= most:
            low.append(max(low[-1] + 1, -(-low[-1] * 100 // percent)))
        self.low = np.array(low, np.int64)
        top = self.low[1:] - 1
        self.top = np.append(top, low[-1])
        self.segments = self.differ(self.top * 100 // percent, self.top) + 1 + -(-self.top // 40)
        self.deleted = -(-self.segments // 24)

    def differ(self, r: np.ndarray, s: np.ndarray) -> np.ndarray:
        """The most shingles in which sets of these sizes may differ."""
        return (r + s) * (100 - self.percent) // (100 + self.percent)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, side="right") - 1


def shingle_sets(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, one text after another, and where each text begins (one more at the end)."""
    data, offsets = text_buffers(column)
    _, _, of, hashes = words_of(data, offsets)
    n = np.bincount(of, minlength=len(column)) if len(of) else np.zeros(len(column), np.int64)
    begin = np.concatenate([[0], np.cumsum(n)])
    rolled = np.zeros(len(hashes), np.uint64)
    for k in range(words):
        rolled[: max(len(hashes) - k, 0)] += mix(hashes[k:] + _U(k)) * _POWERS[k]
    rolled = mix(rolled)
    out, sizes = [], []
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        if b - a >= words:
            one = np.unique(rolled[a : b - words + 1])
        elif b > a:  # fewer words: the whole sequence
            place = np.arange(b - a, dtype=np.uint64)
            one = mix(np.add.reduce(mix(hashes[a:b] + place) * mix(place + _U(8 + b - a)), keepdims=True))
        else:
            one = rolled[:0]
        out.append(one)
        sizes.append(len(one))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def node_of(sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A hash of each whole set."""
    total = np.zeros(len(sets) + 1, np.uint64)
    np.cumsum(mix(sets ^ _U(0x1234567)), out=total[1:])
    return mix(total[begin[1:]] - total[begin[:-1]] + (begin[1:] - begin[:-1]).astype(np.uint64)).view(np.int64)


def parity_sketches(sets: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """For each set the parities of its shingles over 2 to 4 bits a shingle, a power of two of them and 64 at least.

    Two sketches differ, once the longer is folded to the shorter's length, in at
    most as many bits as the sets differ in shingles.
    """
    n = begin[1:] - begin[:-1]
    bits = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(bits)])
    of = np.repeat(np.arange(len(n)), n)
    place = base[of] + (mix(sets ^ _U(0x77777777)) & (bits[of] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(place, minlength=base[-1]) & 1).astype(np.uint8), bitorder="little")
    return [packed[a:b].tobytes() for a, b in zip((base[:-1] // 8).tolist(), (base[1:] // 8).tolist())]


def fold(bits: bytes, words: int) -> np.ndarray:
    """A parity sketch folded to so many 64-bit words."""
    out = np.frombuffer(bits, "<u8")
    while len(out) > words:
        half = len(out) // 2
        out = out[:half] ^ out[half:]
    return out


def may_link(bits_a: bytes, n_a: int, bits_b: bytes, n_b: int, percent: int) -> bool:
    words = min(len(bits_a), len(bits_b)) // 8
    return int(np.bitwise_count(fold(bits_a, words) ^ fold(bits_b, words)).sum()) * (100 + percent) <= (n_a + n_b) * (100 - percent)


class Subsets:
    """The segment subsets of sets under the schemes of given bands."""

    def __init__(self, bands: Bands, sets: np.ndarray, begin: np.ndarray, band: np.ndarray):
        n = begin[1:] - begin[:-1]
        self.m, self.d = bands.segments[band], bands.deleted[band]
        self.base = np.concatenate([[0], np.cumsum(self.m)])
        of = np.repeat(np.arange(len(n)), n)
        seg = (((sets >> _U(32)) * self.m[of].astype(np.uint64)) >> _U(32)).astype(np.int64)
        self.gid = self.base[of] + seg
        self.value = mix(sets + _U(0x51ED2701))
        self.sum = np.zeros(self.base[-1], np.uint64)
        np.add.at(self.sum, self.gid, self.value)
        self.doc = np.repeat(np.arange(len(n)), self.m)
        self.seg = np.arange(self.base[-1]) - self.base[self.doc]
        self.tag = mix((band[self.doc].astype(np.uint64) << _U(40)) + self.seg.astype(np.uint64) + _U(1))
        self.exact = mix(self.sum + self.tag)
        some = seg < self.d[of]
        self.some_gid, self.some_doc = self.gid[some], of[some]
        self.less = self.sum[self.some_gid] - self.value[some] + self.tag[self.some_gid]

    def index(self) -> tuple[np.ndarray, np.ndarray]:
        """(signature, set) of all indexed subsets and one-deletion neighbours."""
        return np.concatenate([self.exact, mix(self.less ^ _DELETED)]), np.concatenate([self.doc, self.some_doc])

    def probe(self, need: np.ndarray, cost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Spends need[set] credits where they cost least.

        Returns which exact subsets are probed, and (signature, set) of the probes
        for subsets that differ by one shingle.
        """
        first = cost(self.exact)
        wide = np.flatnonzero(self.seg < self.d[self.doc])
        longer = mix((self.sum[wide] + self.tag[wide]) ^ _DELETED)
        shorter = mix(self.less)
        more = np.zeros(len(self.exact), np.int64)
        np.add.at(more, self.some_gid, cost(shorter))
        second = np.maximum(more[wide] + cost(longer), first[wide])
        doc = np.concatenate([self.doc, self.doc[wide]])
        level = np.concatenate([np.zeros(len(first), np.int64), np.ones(len(wide), np.int64)])
        order = np.lexsort((level, np.concatenate([first, second]), doc))
        n = np.bincount(doc, minlength=len(self.m))
        rank = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        chosen = order[rank < need[doc[order]]]
        exact = np.zeros(len(first), bool)
        exact[chosen[chosen < len(first)]] = True
        two = np.zeros(len(first), bool)
        picked = chosen[chosen >= len(first)] - len(first)
        two[wide[picked]] = True
        near = two[self.some_gid]
        return exact, np.concatenate([longer[picked], shorter[near]]), np.concatenate([self.doc[wide[picked]], self.some_doc[near]])


def signatures(bands: Bands, sets: np.ndarray, begin: np.ndarray, cost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set, flag) of everything that non-empty sets index and probe."""
    n = begin[1:] - begin[:-1]
    band = bands.of(n)
    own = Subsets(bands, sets, begin, band)
    exact, near, near_of = own.probe(bands.differ(n, n) + 1, cost)
    index, index_of = own.index()
    flag = np.full(len(index), INDEXED, np.uint8)
    flag[: len(exact)][exact] |= PROBES
    out = [(index, index_of, flag), (near, near_of, np.full(len(near), PROBES, np.uint8))]
    below = np.flatnonzero((band > 0) & (bands.top[np.maximum(band - 1, 0)] * 100 >= bands.percent * n))
    if len(below):
        pick = np.repeat(np.isin(np.arange(len(n)), below), n)
        starts = np.concatenate([[0], np.cumsum(n[below])])
        other = Subsets(bands, sets[pick], starts, band[below] - 1)
        need = bands.differ(n[below], bands.top[band[below] - 1]) + 1
        exact, near, near_of = other.probe(need, cost)
        for sig, of in ((other.exact[exact], other.doc[exact]), (near, near_of)):
            out.append((sig, below[of], np.full(len(sig), PROBES, np.uint8)))
    return tuple(np.concatenate([x[k] for x in out]) for k in range(3))


def _slot(signature: np.ndarray) -> np.ndarray:
    return ((signature >> _U(17)) % _U(SKETCH)).astype(np.int64)


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def _survey(batches, words: int, percent: int):
    """(kind 0) id, mark, node, size and parity sketch of each text; (kind 1) the task's part of the cost sketch."""
    counts = np.zeros(SKETCH, np.int64)
    names = ["kind", "doc_id", "mark", "node", "n", "part", "bytes"]
    for batch in batches:
        for part in slices(batch, "text"):
            sets, begin = shingle_sets(part.column(1), words)
            n = begin[1:] - begin[:-1]
            full = np.flatnonzero(n)
            if len(full):
                starts = np.concatenate([[0], np.cumsum(n[full])])
                bands = Bands(percent, int(n.max()))
                index, _ = Subsets(bands, sets, starts, bands.of(n[full])).index()
                counts += np.bincount(_slot(index), minlength=SKETCH)
            rows = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(rows, np.int32)), part.column(0), part.column(2), pa.array(node_of(sets, begin)), pa.array(n), pa.nulls(rows, pa.int32()), _binary(parity_sketches(sets, begin))], names
            )
    own = np.minimum(counts, np.iinfo(np.uint32).max).astype("<u4").reshape(SKETCH_PARTS, -1)
    k = SKETCH_PARTS
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.ones(k, np.int32)), *(pa.nulls(k, pa.int64()) for _ in range(4)), pa.array(np.arange(k, dtype=np.int32)), _binary([x.tobytes() for x in own])], names
    )


def _add_up(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[part] = total.get(part, 0) + np.frombuffer(counts, "<i8" if len(counts) == 8 * SKETCH // SKETCH_PARTS else "<u4").astype(np.int64)
    for part, counts in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), _binary([counts.astype("<i8").tobytes()])], ["part", "counts"])


def _emit(batches, words: int, percent: int, keys: list[int], tasks: int, counts: np.ndarray):
    """Packed signatures: for each reduce task their low 48 bits, the sets they come from with flags, and those sets' nodes and sizes."""
    cost = lambda sig: counts[_slot(sig)]
    for batch in batches:
        for big in slices(batch, "text"):
            for at in range(0, len(big), 1 << 14):
                part = big.slice(at, 1 << 14)
                sets, begin = shingle_sets(part.column(1), words)
                n = begin[1:] - begin[:-1]
                nodes = node_of(sets, begin)
                # equal sets once
                _, first = np.unique(nodes, return_index=True)
                keep = np.zeros(len(n), bool)
                keep[first] = True
                keep &= n > 0
                if not keep.any():
                    continue
                sets, nodes, n = sets[np.repeat(keep, n)], nodes[keep], n[keep]
                begin = np.concatenate([[0], np.cumsum(n)])
                sig, of, flag = signatures(Bands(percent, int(n.max())), sets, begin, cost)
                task = (((sig >> _U(32)) * _U(tasks)) >> _U(32)).astype(np.int64)
                order = np.argsort(task * len(n) + of, kind="stable")
                sig, of, flag, task = sig[order], of[order], flag[order], task[order]
                met, starts = np.unique(task, return_index=True)
                rows = []
                for t, a, b in zip(met.tolist(), starts.tolist(), np.append(starts[1:], len(task)).tolist()):
                    used, place = np.unique(of[a:b], return_inverse=True)
                    low = sig[a:b]
                    rows.append((
                        keys[t * len(keys) // tasks], t, (low & _U(0xFFFFFFFF)).astype("<u4").tobytes() + ((low >> _U(32)) & _U(0xFFFF)).astype("<u2").tobytes(),
                        ((place << 2) | flag[a:b]).astype("<u2").tobytes(), nodes[used].tobytes() + n[used].astype("<u4").tobytes(),
                    ))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), *(_binary(list(c)) for c in columns[2:])], ["key", "task", "sigs", "sets", "nodes"])


class _Gathered:
    """The signatures of one task or more, unpacked as they come."""

    def __init__(self):
        self.sigs, self.refs, self.flags, self.nodes, self.sizes, self.base = [], [], [], [], [], 0

    def add(self, t: int, packed: bytes, places: bytes, held: bytes) -> None:
        count = len(places) // 2
        low, high = np.frombuffer(packed, "<u4", count), np.frombuffer(packed, "<u2", count, 4 * count)
        place = np.frombuffer(places, "<u2")
        own = len(held) // 12
        # a task's number takes 16 bits beside the 48 that are sent; of more tasks, a scrambled one takes all 64
        above = np.int64(t) << 48 if t < 1 << 15 else mix(np.array([t], np.uint64)).view(np.int64)[0]
        self.sigs.append(above ^ ((high.astype(np.int64) << 32) | low))
        self.refs.append((place >> 2).astype(np.int32) + np.int32(self.base))
        self.flags.append((place & 3).astype(np.uint8))
        self.nodes.append(np.frombuffer(held, "<i8", own))
        self.sizes.append(np.frombuffer(held, "<u4", own, 8 * own))
        self.base += own


def _runs(batches, by_task: bool = False):
    """(sig, node, n, flag, hub) of all signatures that two sets or more have and that one of them probes and one indexes.

    by_task: rows come sorted by task, and each task is worked off before the next.
    """
    own, last = _Gathered(), None
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
            if by_task and last is not None and row[0] != last:
                yield from _runs_of(own)
                own = _Gathered()
            last = row[0]
            own.add(*row)
    yield from _runs_of(own)


def _runs_of(own: _Gathered):
    sigs, refs, flags, nodes, sizes = own.sigs, own.refs, own.flags, own.nodes, own.sizes
    if not sigs:
        return
    sig, ref, flag = np.concatenate(sigs), np.concatenate(refs), np.concatenate(flags)
    own.sigs = own.refs = own.flags = sigs = refs = flags = None
    order = np.argsort(sig)
    ranked = sig[order]
    same = ranked[1:] == ranked[:-1]
    shared = np.zeros(len(sig), bool)
    shared[1:] |= same
    shared[:-1] |= same
    pick = order[shared]
    sig = ranked[shared]
    del ranked, order
    if not len(sig):
        return
    ref, flag = ref[pick], flag[pick]
    node, n = np.concatenate(nodes)[ref], np.concatenate(sizes)[ref]
    order = np.lexsort((node, sig))
    sig, node, n, flag = sig[order], node[order], n[order], flag[order]
    fresh = np.ones(len(sig), bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    starts = np.flatnonzero(fresh)
    flag = np.bitwise_or.reduceat(flag, starts)
    sig, node, n = sig[starts], node[starts], n[starts]
    head = np.ones(len(sig), bool)
    head[1:] = sig[1:] != sig[:-1]
    starts = np.flatnonzero(head)
    length = np.diff(np.append(starts, len(sig)))
    union = np.bitwise_or.reduceat(flag, starts)
    good = np.repeat((length > 1) & (union == INDEXED | PROBES), length)
    hub, hub_n = np.repeat(node[starts], length), np.repeat(n[starts], length)
    for a in range(0, len(sig), 1 << 18):
        cut = slice(a, a + (1 << 18))
        keep = good[cut]
        columns = [sig[cut][keep], node[cut][keep], n[cut][keep].astype(np.int64), flag[cut][keep].astype(np.int32), hub[cut][keep], hub_n[cut][keep].astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sig", "node", "n", "flag", "hub", "hub_n"])


def _verify(batches, words: int, percent: int):
    """(a, b) of the pairs whose sets reach the similarity."""
    for batch in batches:
        for part in slices(batch, "text_a", 2 << 20):
            left, left_at = shingle_sets(part.column(2), words)
            right, right_at = shingle_sets(part.column(3), words)
            good = []
            for k in range(len(part)):
                x, y = left[left_at[k] : left_at[k + 1]], right[right_at[k] : right_at[k + 1]]
                small, large = min(len(x), len(y)), max(len(x), len(y))
                ok = small > 0 and 100 * small >= percent * large
                if ok:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok = 100 * both >= percent * (len(x) + len(y) - both)
                good.append(ok)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def _near(batches, percent: int):
    """Of pairs with sketches those that may link."""
    for batch in batches:
        _, n_a, bits_a, _, n_b, bits_b = (c.to_pylist() for c in batch.columns)
        good = [may_link(x, p, y, q, percent) for p, x, q, y in zip(n_a, bits_a, n_b, bits_b)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3)], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def _met(run: list[tuple], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a run's rows (sig, i, j, chunk, node, n, flag, root, bits) the pairs (a, b) that may link, and how far apart their sketches are."""
    apart = run[0][1] != run[0][2]
    run = sorted(run, key=lambda r: (r[5], r[4]))
    chunk, node, n, flag, root = (np.array([r[k] for r in run], np.int64) for k in range(3, 8))
    words = min(len(r[8]) for r in run) // 8
    sketch = np.array([fold(r[8], words) for r in run])
    m = len(run)
    step = max(8, int(((1 << 20) // words) ** 0.5))
    found = []
    for p in range(0, m, step):
        a = slice(p, p + step)
        top = int(np.searchsorted(n, n[a][-1] * 100 // percent, side="right"))  # larger sets are too large for all of these
        for q in range(p, top, step):
            b = slice(q, min(q + step, top))
            far = np.bitwise_count(sketch[a, None, :] ^ sketch[None, b, :]).sum(axis=2, dtype=np.int64)
            total = n[a, None] + n[None, b]
            ok = (far * (100 + percent) <= total * (100 - percent)) & (root[a, None] != root[None, b]) & (100 * n[a, None] >= percent * n[None, b])
            f, g = flag[a, None], flag[None, b]
            ok &= ((f & INDEXED) & ((g & PROBES) >> 1) | ((f & PROBES) >> 1) & (g & INDEXED)) > 0
            if apart:
                ok &= chunk[a, None] != chunk[None, b]
            x, y = np.nonzero(ok)
            after = y + q > x + p
            x, y = x[after], y[after]
            found.append((x + p, y + q, far[x, y] / total[x, y]))
    x, y, far = (np.concatenate([f[k] for f in found]) for k in range(3))
    return np.minimum(node[x], node[y]), np.maximum(node[x], node[y]), far


def _pairs(batches, percent: int, nearest: int = 0):
    """The pairs of each run (rows sorted by signature and chunks) that may link: one probes, the other is indexed, and their components differ.

    With `nearest`, only those that are among so many best partners of either member.
    """

    def of(run: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        a, b, far = _met(run, percent)
        if nearest and len(a) > nearest:
            member, way = np.concatenate([a, b]), np.concatenate([far, far])
            order = np.lexsort((way, member))
            member = member[order]
            starts = np.flatnonzero(np.append(True, member[1:] != member[:-1]))
            place = np.arange(len(member)) - np.repeat(starts, np.diff(np.append(starts, len(member))))
            pick = np.unique(order[place < nearest] % len(a))
            a, b = a[pick], b[pick]
        return a, b

    def batch_of(found: list) -> pa.RecordBatch:
        both = np.unique(np.stack([np.concatenate([f[k] for f in found]) for k in (0, 1)]), axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    run: list[tuple] = []
    for batch in batches:
        found = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if run and row[:3] != run[0][:3]:
                if len(run) > 1:
                    found.append(of(run))
                run = []
            run.append(row)
        yield batch_of(found)
    yield batch_of([of(run)] if len(run) > 1 else [])


def jaccard_components(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", task_signatures: int = TASK_SIGNATURES, most_partitions: int = MOST_PARTITIONS
) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id (the smallest id reachable by links, its own included).

    Two documents link when 100 * |intersection| >= percent * |union| of their sets
    of distinct shingles; words are split at ASCII white space, A-Z lowered. With
    fewer words the whole sequence is the one shingle; without words or text
    the set is empty and links with nothing. Rows without id get n_shingles and a
    null component, and link nothing. Rows that repeat an id are labelled each by
    its own text. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # the mark tells apart the texts of an id that is repeated
    marked = source.withColumn("mark", F.xxhash64("text"))
    survey = written(
        marked.mapInArrow(lambda b: _survey(b, words, percent), "kind int, doc_id long, mark long, node long, n long, part int, bytes binary"), "ngram-survey"
    )
    thin = survey.filter("kind = 0").select("doc_id", "node", "n")
    parts = survey.filter("kind = 1").select("part", F.col("bytes").alias("counts")).repartition(SKETCH_PARTS, "part").mapInArrow(_add_up, "part int, counts binary")
    counts = np.zeros((SKETCH_PARTS, SKETCH // SKETCH_PARTS), np.int64)
    for r in parts.collect():  # at most SKETCH counters, whatever the input
        counts[r["part"]] = np.frombuffer(bytes(r["counts"]), "<i8")
    shared = spark.sparkContext.broadcast(counts.reshape(-1))
    n_rows, n_shingles = thin.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    tasks = max(1, -(-int(n_shingles * 0.6) // task_signatures))
    partitions = min(tasks, most_partitions)

    keyed = source.filter("doc_id IS NOT NULL")
    keys = even_keys(spark, partitions)
    packed = keyed.mapInArrow(lambda b: _emit(b, words, percent, keys, tasks, shared.value), "key int, task int, sigs binary, sets binary, nodes binary")
    packed, by_task = packed.repartition(partitions, "key"), partitions < tasks
    packed = packed.sortWithinPartitions("task") if by_task else packed
    runs = written(packed.mapInArrow(lambda b: _runs(b, by_task), "sig long, node long, n long, flag int, hub long, hub_n long"), "ngram-runs")

    known = thin.filter("doc_id IS NOT NULL AND n > 0")
    sketched = survey.filter("kind = 0 AND doc_id IS NOT NULL AND n > 0").groupBy("node").agg(
        F.min(F.struct("doc_id", "mark")).alias("first"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("bytes").alias("bits")
    )
    with_bits = written(sketched.select("node", F.col("first.doc_id").alias("first_id"), F.col("first.mark").alias("first_mark"), "rows", "n", "bits"), "ngram-nodes", 4 * n_rows)
    nodes = with_bits.select("node", "first_id", "rows")
    wanted = runs.select("node").distinct().join(with_bits.hint("merge"), "node").select("node", "first_id", "first_mark")
    own = (F.col("doc_id") == F.col("first_id")) & (F.xxhash64("text") == F.col("first_mark"))
    texts = written(source.join(wanted.hint("merge"), own).select("node", "text").dropDuplicates(["node"]), "ngram-texts")

    def links(pairs: DataFrame, tag: str) -> DataFrame:
        """Of pairs (a, b) those that link."""
        with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
        with_b = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
        return written(with_b.select("a", "b", "text_a", "text_b").mapInArrow(lambda x: _verify(x, words, percent), "a long, b long"), tag)

    fits = f"100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)"
    stars = runs.filter("hub <> node").filter(fits).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    near_a = stars.join(with_bits.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a")).hint("merge"), "a")
    near_b = near_a.join(with_bits.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b")).hint("merge"), "b")
    stars = written(near_b.select("a", "n_a", "bits_a", "b", "n_b", "bits_b").mapInArrow(lambda x: _near(x, percent), "a long, b long"), "ngram-near")
    linked, checked, n_runs = links(stars, "ngram-stars"), stars, runs.count()
    for nearest in (NEAREST, 0):
        # what is joined by now, and the signatures whose sets are in different components
        roots = components(linked)
        placed = runs.join(roots.hint("merge"), "node", "left").select("sig", "node", "flag", F.coalesce("root", "node").alias("root"))
        placed = written(placed, "ngram-placed", n_runs)
        open_sigs = placed.groupBy("sig").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("size")).filter("x < y")
        left = join_keyed(placed, written(open_sigs.select("sig", "size"), "ngram-open", n_runs), "sig", "size", n_runs)
        left = left.join(with_bits.select("node", "n", "bits").hint("merge"), "node")
        # a long run is dealt as pairs of chunks
        dealt = left.withColumn("chunks", F.ceil(F.col("size") / F.lit(CHUNK)).cast("int"))
        dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        dealt = dealt.select("sig", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "n", "flag", "root", "bits")
        dealt = dealt.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
        pairs = dealt.mapInArrow(lambda x, k=nearest: _pairs(x, percent, k), "a long, b long").distinct()
        pairs = written(pairs.join(checked.hint("merge"), ["a", "b"], "left_anti"), "ngram-pairs")
        linked, checked = linked.unionByName(links(pairs, "ngram-rest")), checked.unionByName(pairs)
    roots = components(linked)

    labelled = nodes.join(roots.hint("merge"), "node", "left").select("node", "first_id", "rows", F.coalesce("root", "node").alias("root"))
    labelled = written(labelled, "ngram-labelled", n_rows)
    lowest = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members"))
    lowest = written(lowest, "ngram-lowest", n_rows)
    of_node = join_keyed(labelled, lowest, "root", "members", n_rows).select("node", "rows", "component_id")
    found = join_keyed(known, written(of_node, "ngram-of-node", n_rows), "node", "rows", n_rows).select("doc_id", "n", "component_id")
    alone = thin.filter("doc_id IS NULL OR n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
