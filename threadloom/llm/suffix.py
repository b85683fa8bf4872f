"""Suffix sorting by induction, in bulk, with common prefixes.

Induced sorting scans suffixes in order and puts each one's predecessor behind
a later bucket's end, which is a priority queue keyed by first character.  All
that is known of a bucket is handled in one step here: a queue holds blocks of
tuples, a suffix's position and the length of its common prefix with the one
before it, and what the block of a bucket induces is dealt to the queues of the
other buckets at once; runs of one character induce into their own bucket and
take one more step for each.

Two suffixes that are induced next to each other have one byte more in common
than what stood between their inducers, so a range minimum gives the common
prefix; where a bucket's parts meet it is the shorter run of the character.  In
the first pass, whose seeds are known by their character only, seeds of one
character count as equal, so an unbroken chain of equals gives pieces one name.
Lengths are told up to LONGEST.

Queues hold their tuples in memory up to a budget and on disk beyond it, in a
folder that the caller names; the result comes in blocks as well.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyarrow import fs

#: The longest common prefix that is told apart from longer ones, and the mark of pieces that are equal.
LONGEST, EQUAL = 250, 255
Block = tuple[np.ndarray, np.ndarray]


def _joined(blocks: Iterator[Block], most: int, back: bool = False) -> Iterator[Block]:
    """Successive blocks as one, as long as that has ``most`` tuples at most; blocks that come from the back are put in front."""
    held: list[Block] = []
    size = 0

    def one() -> Block:
        parts = held[::-1] if back else held
        return parts[0] if len(parts) == 1 else tuple(np.concatenate([b[i] for b in parts]) for i in (0, 1))

    for b in blocks:
        if held and size + len(b[0]) > most:
            yield one()
            held, size = [], 0
        held.append(b)
        size += len(b[0])
    if held:
        yield one()


class Queues:
    """First-in first-out queues of blocks (positions, common prefixes) by key; blocks beyond ``budget`` tuples go to files in ``folder``."""

    def __init__(self, keys: int, budget: int, folder: str | None = None):
        self.blocks: list[list[Block | tuple[str, int, np.dtype]]] = [[] for _ in range(keys)]
        self.held, self.budget, self.written = 0, budget, 0
        self.files, self.root = fs.FileSystem.from_uri(folder) if folder else (None, "")

    def push(self, key: int, block: Block) -> None:
        n = len(block[0])
        if not n:
            return
        if self.files is not None and self.held + n > self.budget:
            if not self.written:
                self.files.create_dir(self.root, recursive=True)
            path = f"{self.root}/{uuid.uuid4().hex}"
            with self.files.open_output_stream(path) as f:
                f.write(block[0].tobytes())
                f.write(block[1].tobytes())
            self.blocks[key].append((path, n, block[0].dtype))
            self.written += n
        else:
            self.held += n
            self.blocks[key].append(block)

    def deal(self, keys: np.ndarray, positions: np.ndarray, common: np.ndarray) -> None:
        """Tuples sorted by key, each run behind the queue of its key."""
        if not len(keys):
            return
        cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for a, b in zip(np.append(0, cut).tolist(), np.append(cut, len(keys)).tolist(), strict=True):
            self.push(int(keys[a]), (positions[a:b], common[a:b]))

    def pop(self, key: int, back: bool = False) -> Iterator[Block]:
        """The blocks of a queue, one in memory at a time, which are gone then; ``back`` takes the last first."""
        todo, self.blocks[key] = self.blocks[key], []
        for b in reversed(todo) if back else todo:
            if len(b) == 3:
                path, n, kind = b
                with self.files.open_input_stream(path) as f:
                    raw = f.read()
                self.files.delete_file(path)
                yield np.frombuffer(raw, kind, n), np.frombuffer(raw, np.uint8, n, n * kind.itemsize)
            else:
                self.held -= len(b[0])
                yield b

    def gather(self, key: int, back: bool = False) -> Iterator[Block]:
        """The same with small blocks put together, up to a quarter of the budget."""
        yield from _joined(self.pop(key, back), max(1, self.budget // 4), back)

    def close(self) -> None:
        for key in range(len(self.blocks)):
            for _ in self.pop(key):
                pass


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one behind it; the last counts as larger than the empty suffix."""
    n = len(t)
    less, more = t[:-1] < t[1:], t[:-1] > t[1:]
    decided = np.flatnonzero(less | more)
    at = np.searchsorted(decided, np.arange(n - 1))
    out = np.zeros(n, np.bool_)
    inside = at < len(decided)
    out[:-1][inside] = less[decided[at[inside]]]
    return out


def _range_min(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of x between lo and hi, ends included, for each pair."""
    width = hi - lo + 1
    level = np.frexp(width.astype(np.float64))[1] - 1
    out = np.empty(len(lo), x.dtype)
    table, k = x, 0
    while True:
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k) + 1])
        if not len(level) or k == level.max():
            return out
        table = np.minimum(table[: -(1 << k)], table[1 << k :])
        k += 1


class _Pass:
    """What is induced while blocks go by in order: the least common prefix since each bucket was last added to."""

    def __init__(self, t: np.ndarray, small: np.ndarray, want: bool):
        self.t, self.small, self.want = t, small, want
        self.since = np.zeros(256, np.uint8)

    def induced(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets, positions and common prefixes of the predecessors of a block's suffixes, by bucket."""
        pos, common = block
        i = np.flatnonzero(pos > 0)
        q = pos[i] - 1
        ok = self.small[q] == self.want
        i, q = i[ok], q[ok]
        key = self.t[q]
        by = np.argsort(key, kind="stable")
        i, q, key = i[by], q[by], key[by]
        new = np.append(True, key[1:] != key[:-1])[: len(key)]
        least = _range_min(common, np.where(new, 0, np.append(-1, i[:-1])[: len(i)] + 1), i)
        least[new] = np.minimum(least[new], self.since[key[new]])
        rest = np.append(np.minimum.accumulate(common[::-1])[::-1], np.uint8(EQUAL))
        self.since = np.minimum(self.since, rest[0])
        last = np.append(new[1:], True)[: len(key)]
        self.since[key[last]] = rest[i[last] + 1]
        return key, q, np.where(least == EQUAL, EQUAL, np.minimum(least, LONGEST - 1) + 1).astype(np.uint8)


def _run(t: np.ndarray, at: int) -> int:
    """How often the byte at a place stands there in a row, LONGEST at most."""
    other = np.flatnonzero(t[at : at + LONGEST] != t[at])
    return int(other[0]) if len(other) else min(LONGEST, len(t) - at)


def _waves(step: _Pass, queues: Queues, c: int, wave: list[Block] | Iterator[Block]) -> Iterator[Block]:
    """The blocks of one bucket in their order: what lies in its queue, then what each round induces into the bucket itself."""
    length = 0
    while True:
        own: list[tuple[np.ndarray, np.ndarray]] = []
        for n, (pos, common) in enumerate(wave):
            if n == 0:
                # to another bucket nothing is common; to a shorter run of the character, that run
                common = common.copy()
                common[0] = min(length, LONGEST)
            yield pos, common
            key, q, more = step.induced((pos, common))
            a, b = np.searchsorted(key, [c, c + 1])
            queues.deal(np.delete(key, slice(a, b)), np.delete(q, slice(a, b)), np.delete(more, slice(a, b)))
            if b > a:
                own.append((q[a:b], more[a:b]))
        if not own:
            return
        wave, length = _joined(iter(own), max(1, queues.budget // 4)), length + 1


def _induce(t: np.ndarray, small: np.ndarray, seeds: np.ndarray, common: np.ndarray, budget: int, folder: str | None) -> Iterator[Block]:
    """All suffixes from the last to the first, each with what it has in common with the one told before it, given left-most smaller ones in order."""
    starts, larger = Queues(256, budget, folder), Queues(256, budget, folder)
    key = t[seeds]
    by = np.argsort(key, kind="stable")
    starts.deal(key[by], seeds[by], common[by])
    queues, step = Queues(256, budget, folder), _Pass(t, small, False)
    queues.push(int(t[-1]), (np.array([len(t) - 1], seeds.dtype), np.zeros(1, np.uint8)))
    #: the longest run with which a larger suffix of each bucket begins
    runs = np.zeros(256, np.int64)
    for c in range(256):
        for block in _waves(step, queues, c, queues.gather(c)):
            larger.push(c, block)
            runs[c] = _run(t, int(block[0][-1]))
        for n, (pos, shared) in enumerate(starts.gather(c)):
            if n == 0:
                shared = shared.copy()
                shared[0] = min(int(runs[c]), _run(t, int(pos[0])))
            queues.deal(*step.induced((pos, shared)))
    queues, step = Queues(256, budget, folder), _Pass(t, small, True)
    for c in range(255, -1, -1):
        length = 0
        for block in _waves(step, queues, c, queues.gather(c)):
            yield block
            length = _run(t, int(block[0][-1]))
        # larger suffixes stand before all smaller ones of their character; told backwards, each takes the common prefix of the one above it
        above = np.uint8(min(length, int(runs[c])))
        for pos, shared in larger.gather(c, back=True):
            back = pos[::-1], np.append(above, shared[:0:-1])
            above = shared[0]
            yield back
            queues.deal(*step.induced(back))


def common_prefix(t: np.ndarray, a: np.ndarray, b: np.ndarray, most: int = LONGEST) -> np.ndarray:
    """Bytes that the suffixes at a and b have in common, ``most`` at most."""
    padded = np.append(t, np.zeros(8, np.uint8))
    words = np.ndarray(len(t) + 1, "<u8", padded, strides=(1,))
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    room = np.minimum(most, len(t) - np.maximum(a, b))
    for k in range(0, most, 8):
        live = live[k < room[live]]
        if not len(live):
            break
        x = words[a[live] + k] ^ words[b[live] + k]
        same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3)
        out[live] = np.minimum(k + same, room[live])
        live = live[same == 8]
    return out


def _rank(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names by their first ``depth`` names, doubling the length compared.

    A rank is the place at which the suffixes that are still alike begin; only
    those are sorted again.
    """
    n, k = len(names), 1
    order = np.argsort(names)
    fresh = np.append(True, names[order][1:] != names[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    alone = fresh & np.append(fresh[1:], True)
    live = order[~alone]
    while len(live) and k < depth:
        ahead = live + k
        key = rank[live] * (n + 2) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(key)
        live, key = live[by], key[by]
        at, r = np.arange(len(live)), rank[live]
        group = np.maximum.accumulate(np.where(np.append(True, r[1:] != r[:-1]), at, 0))
        fresh = np.append(True, key[1:] != key[:-1])
        rank[live] = r + np.maximum.accumulate(np.where(fresh, at, 0)) - group
        live = live[~(fresh & np.append(fresh[1:], True))]
        k *= 2
    return np.argsort(rank)


#: Tuples that all queues of a sort hold in memory each before they write to disk.
BUDGET = 16_000_000


def suffixes(t: np.ndarray, depth: int = LONGEST, budget: int = BUDGET, folder: str | None = None) -> Iterator[Block]:
    """Blocks of suffixes from the last to the first, each with its common prefix with the one told before it.

    Suffixes alike in ``depth`` bytes, LONGEST at most, come in any order.
    """
    n = len(t)
    small = _types(t) if n > 1 else np.zeros(n, np.bool_)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32 if n < 1 << 31 else np.int64)
    common = np.zeros(len(lms), np.uint8)
    if len(lms) > 1:
        # in the order of the text, those of one character count as equal
        first = np.full(len(lms), EQUAL, np.uint8)
        is_lms = np.zeros(n, np.bool_)
        is_lms[lms] = True
        parts, names, name = [], [], 0
        for pos, shared in _induce(t, small, lms, first, budget, folder):
            fresh = name + np.cumsum(shared != EQUAL)
            name = int(fresh[-1])
            at = np.flatnonzero(is_lms[pos])
            parts.append(pos[at])
            names.append(fresh[at])
        order, named = np.concatenate(parts)[::-1], np.concatenate(names)[::-1]
        fresh = np.append(False, named[1:] != named[:-1])
        rank = np.zeros(n, np.int32 if n < 1 << 31 else np.int64)
        rank[order] = np.cumsum(fresh)
        # successive pieces begin two bytes apart at least
        lms = order if fresh.sum() == len(order) - 1 else lms[_rank(rank[lms].astype(np.int64), depth // 2 + 1)]
        del rank, is_lms
        common[1:] = common_prefix(t, lms[1:].astype(np.int64), lms[:-1].astype(np.int64))
    if n:
        yield from _induce(t, small, lms, common, budget, folder)


def suffix_array(t: np.ndarray, depth: int = LONGEST) -> np.ndarray:
    """Positions of the suffixes of a byte string in their order."""
    parts = [pos for pos, _ in suffixes(t, depth)]
    return np.concatenate(parts)[::-1] if parts else np.zeros(0, np.int32)
