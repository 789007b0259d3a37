"""External induced sorting of suffixes with common-prefix values.

Suffixes are L-type (greater than the next suffix) or S-type. The leftmost S-type suffixes (S*) are sorted first: their
substrings up to the next one get names, and the string of names is sorted by doubling what a name covers until `limit`
characters are told apart. Then one scan upwards induces the order of all L-type suffixes from the S* ones, and one scan
downwards that of all S-type suffixes from the L-type ones. A scan is a priority queue: suffix tuples (position, common
prefix with the tuple before) leave in order, and each puts the suffix before it in the queue under its first character.
As tuples of one character enter in their final order, the queue is one first-in-first-out file for each character. The
common prefix of two induced neighbours is one more than the least one between the tuples that induced them.

All that grows with the text is on disk once it is large: the text, types, names and results are files that are mapped,
queues keep what all of them hold beyond MEMORY tuples in files, and sorters write runs and merge them. What is done in
memory at once is at most MEMORY tuples, and suffixes that are equal in `limit` characters meet in one piece. Files are
the task's own and are removed when it ends.

Common-prefix values stop at `limit` (at most 254), and suffixes that agree that far have any order among themselves.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np

#: Tuples that queues or a sorter hold in memory; arrays of over four times as many items are files.
MEMORY = 1 << 22
FAR = 255


class Disk:
    """Temporary files of one run."""

    def __init__(self, memory: int = MEMORY):
        self.memory = memory
        self.root: str | None = None
        self.n = 0
        self.held = 0
        self.spools: list[Spool] = []

    def path(self) -> str:
        if self.root is None:
            self.root = tempfile.mkdtemp(prefix="suffixes-")
        self.n += 1
        return f"{self.root}/{self.n}"

    def array(self, n: int, dtype) -> np.ndarray:
        """Zeros, in a file if there are many."""
        return np.zeros(n, dtype) if n <= 4 * self.memory else np.memmap(self.path(), dtype, "w+", shape=(n,))

    def spans(self, n: int) -> Iterator[tuple[int, int]]:
        """0 ... n in steps of what is worked on at once."""
        return ((a, min(a + self.memory, n)) for a in range(0, n, self.memory))

    def hold(self, count: int) -> None:
        """More tuples are in queues; beyond the limit all queues go to their files."""
        self.held += count
        if self.held > self.memory:
            for s in self.spools:
                s.flush()
            self.held = 0

    def close(self) -> None:
        if self.root is not None:
            shutil.rmtree(self.root, ignore_errors=True)

    def __enter__(self) -> Disk:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class Spool:
    """Tuples (position, common prefix), first in, first out, that can be read again: the older ones in files, the newer ones in memory."""

    def __init__(self, disk: Disk):
        self.disk, self.parts, self.stored, self.files = disk, [], 0, None
        self.size = 0
        disk.spools.append(self)

    def push(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.parts.append((pos, lcp))
        self.size += len(pos)
        self.disk.hold(len(pos))

    def flush(self) -> None:
        if self.parts:
            if self.files is None:
                path = self.disk.path()
                self.files = f"{path}p", f"{path}l"
            for k, path in enumerate(self.files):
                with open(path, "ab") as f:
                    for part in self.parts:
                        part[k].tofile(f)
            self.stored, self.parts = self.size, []

    def read(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Copies of the tuples a ... b, all in files or all in memory."""
        if b <= self.stored:
            kinds = (self.files[0], np.int64, 8), (self.files[1], np.uint8, 1)
            return tuple(np.fromfile(path, kind, b - a, offset=a * size) for path, kind, size in kinds)
        if len(self.parts) > 1:
            self.parts = [(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]))]
        pos, lcp = self.parts[0]
        return pos[a - self.stored : b - self.stored].copy(), lcp[a - self.stored : b - self.stored].copy()

    def stream(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All tuples, those that are pushed meanwhile too."""
        at, part = 0, 0  # part: the parts in memory that are read
        while at < self.size:
            if at < self.stored:
                end = min(at + self.disk.memory, self.stored)
                yield self.read(at, end)
                at, part = end, 0
                continue
            new = self.parts[part:]
            before = self.stored
            part, at = len(self.parts), self.size
            yield np.concatenate([p[0] for p in new]), np.concatenate([p[1] for p in new])
            if self.stored != before:
                part = 0

    def chunks(self, back: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place, positions, common prefixes) of all tuples in pieces, from the first or from the last piece on."""
        cuts = [(a, min(a + self.disk.memory, self.stored)) for a in range(0, self.stored, self.disk.memory)] + ([(self.stored, self.size)] if self.size > self.stored else [])
        for a, b in reversed(cuts) if back else cuts:
            yield a, *self.read(a, b)


class Sorter:
    """A priority queue on disk: pairs (key, value) go in in any order and come out by key, equal keys in one piece."""

    def __init__(self, disk: Disk):
        self.disk, self.parts, self.size, self.runs = disk, [], 0, []

    def push(self, key: np.ndarray, value: np.ndarray) -> None:
        self.parts.append((key, value))
        self.size += len(key)
        if self.size > self.disk.memory:
            self.spill()

    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        key, value = np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts])
        order = np.argsort(key)
        return key[order], value[order]

    def spill(self) -> None:
        key, value = self.sorted()
        run = self.disk.path()
        np.save(f"{run}k.npy", key)
        np.save(f"{run}v.npy", value)
        self.runs.append(run)
        self.parts, self.size = [], 0

    def pop(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Everything by key, in pieces."""
        if not self.runs:
            if self.parts:
                yield self.sorted()
            return
        if self.parts:
            self.spill()
        runs = [(np.load(f"{r}k.npy", mmap_mode="r"), np.load(f"{r}v.npy", mmap_mode="r")) for r in self.runs]
        at = [0] * len(runs)
        step = max(1, self.disk.memory // (2 * len(runs)))
        while any(a < len(k) for a, (k, _) in zip(at, runs)):
            # all keys up to the least last key of the pieces in memory are complete
            bound = min(k[min(a + step, len(k)) - 1] for a, (k, _) in zip(at, runs) if a < len(k))
            key, value = [], []
            for i, (k, v) in enumerate(runs):
                end = at[i] + int(np.searchsorted(k[at[i] :], bound, "right"))
                key.append(np.asarray(k[at[i] : end]))
                value.append(np.asarray(v[at[i] : end]))
                at[i] = end
            key, value = np.concatenate(key), np.concatenate(value)
            order = np.argsort(key)
            yield key[order], value[order]
        del runs
        for r in self.runs:
            os.remove(f"{r}k.npy"), os.remove(f"{r}v.npy")


def s_types(text: np.ndarray, disk: Disk) -> np.ndarray:
    """Whether each suffix is S-type; the last one is."""
    n = len(text)
    out = disk.array(n, bool)
    out[n - 1] = later = True  # type of the position after the block
    step = disk.memory
    for a in range((n - 2) // step * step if n > 1 else -1, -1, -step):
        b = min(a + step, n - 1)
        x, y = text[a:b], text[a + 1 : b + 1]
        up, same = x < y, x == y
        if same.any():
            where = np.where(same, b - a, np.arange(b - a))
            nearest = np.minimum.accumulate(where[::-1])[::-1]
            up = np.append(up, later)[nearest]
        out[a:b] = up
        later = bool(up[0])
    return out


def runs_of(text: np.ndarray, most: int, disk: Disk) -> np.ndarray:
    """How many equal characters begin at each position, at most `most`."""
    n = len(text)
    out = disk.array(n, np.uint8)
    later = 0  # of the run that goes on after the block
    for a, b in reversed(list(disk.spans(n))):
        part = np.asarray(text[a:b])
        last = np.flatnonzero(np.append(part[1:] != part[:-1], True))
        size = np.diff(np.concatenate(([-1], last)))
        left = np.repeat(last, size) - np.arange(len(part)) + 1
        if b < n and part[-1] == text[b]:
            left[len(part) - size[-1] :] += later
        out[a:b] = np.minimum(left, most)
        later = min(int(left[0]), most)
    return out


def words_at(text: np.ndarray) -> np.ndarray:
    """Eight characters from each position as one number, the first one highest on reading with byteswap()."""
    return np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))


class Ranks:
    """Numbers of the S* suffixes that grow with their order, refined by rounds of sorting; `shared`: whose number others have too."""

    def __init__(self, m: int, disk: Disk):
        self.disk, self.m = disk, m
        self.rank, self.shared, self.open = disk.array(m, np.int64), disk.array(m, bool), disk.array(m, bool)
        self.shared[:] = True
        self.open[:] = True

    def chosen(self, flags: np.ndarray) -> Iterator[np.ndarray]:
        for a, b in self.disk.spans(self.m):
            some = np.flatnonzero(flags[a:b])
            if len(some):
                yield some + a

    def refine(self, sorter: Sorter, bits: int | None, goes_on=None) -> bool:
        """Gives what came out of a sorter by (old number, key) new numbers. bits: of the key; without, it is below m + 2. goes_on: whether an item has more to tell. Returns whether anything is open."""
        at, last, base, any_open = 0, -1, 0, False
        for key, some in sorter.pop():  # equal keys come in one piece
            old = (key >> np.uint64(bits) if bits else key // np.uint64(self.m + 2)).astype(np.int64)
            here = np.arange(at, at + len(key))
            fresh = np.concatenate(([True], key[1:] != key[:-1]))
            begin = np.concatenate(([old[0] != last], old[1:] != old[:-1]))
            place = np.maximum.accumulate(np.where(fresh, here, 0))
            start = np.maximum.accumulate(np.where(begin, here, base))
            self.rank[some] = old + place - start
            tied = np.append(~fresh[1:], False) | ~fresh
            self.shared[some] = tied
            if goes_on is not None:
                heads = np.flatnonzero(fresh)
                more = np.repeat(np.maximum.reduceat(goes_on(some), heads), np.diff(np.append(heads, len(key))))
                tied = tied & more
                self.open[some] = tied
            any_open |= bool(tied.any())
            at += len(key)
            last, base = old[-1], start[-1]
        return any_open


def sort_stars(padded: np.ndarray, stars: np.ndarray, limit: int, disk: Disk) -> np.ndarray:
    """The S* positions in the order of their suffixes. padded: the text and 16 more zeros."""
    m = len(stars)
    if m == 1:
        return stars
    words = words_at(padded)
    ranks = Ranks(m, disk)

    def left(some: np.ndarray, done: int) -> np.ndarray:
        """Characters of substrings up to and with the next S* that are not read yet; the last suffix goes on with zeros and so is least."""
        return np.where(some + 1 < m, stars[np.minimum(some + 1, m - 1)] - stars[some] + 1, 8) - done

    # names by four characters at a time; what ends earlier comes after what goes on
    for done in range(0, limit + 8, 4):
        sorter = Sorter(disk)
        for some in ranks.chosen(ranks.open):
            cut = np.clip(left(some, done), 0, 4).astype(np.uint64)
            key = words[np.minimum(stars[some] + done, len(words) - 1)].byteswap() >> np.uint64(32)
            fill = np.where(cut >= 4, np.uint64(0), np.uint64(0xFFFFFFFF) >> (np.minimum(cut, 3) * np.uint64(8)))
            sorter.push(ranks.rank[some].astype(np.uint64) << np.uint64(32) | key | fill, some)
        if not ranks.refine(sorter, 32, lambda some, done=done: left(some, done + 4) > 0):
            break
    # doubling: a name covers twice as many S* substrings each time, of two characters at least each; what is alone with its name has its place
    covered = 1
    while 2 * covered < limit:
        sorter = Sorter(disk)
        for some in ranks.chosen(ranks.shared):
            after = np.where(some + covered < m, ranks.rank[np.minimum(some + covered, m - 1)] + 1, 0)
            sorter.push(ranks.rank[some].astype(np.uint64) * np.uint64(m + 2) + after.astype(np.uint64), some)
        if not ranks.refine(sorter, None):
            break
        covered *= 2
    sorter = Sorter(disk)
    for a, b in disk.spans(m):
        sorter.push(np.asarray(ranks.rank[a:b]), np.arange(a, b))
    order = disk.array(m, np.int64)
    at = 0
    for _, some in sorter.pop():
        order[at : at + len(some)] = stars[some]
        at += len(some)
    return order


def common(padded: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Common-prefix values of positions a and b, at most limit."""
    words = words_at(padded)
    out = np.zeros(len(a), np.int64)
    active = np.arange(len(a))
    top = len(words) - 1
    for done in range(0, limit, 8):
        x = words[np.minimum(a[active] + done, top)] ^ words[np.minimum(b[active] + done, top)]
        differ = x != 0
        low = x[differ] & (~x[differ] + np.uint64(1))
        out[active[differ]] = done + (np.bitwise_count(low - np.uint64(1)) >> 3)
        active = active[~differ]
        if not len(active):
            break
    out[active] = limit
    return np.minimum(out, limit).astype(np.uint8)


class Scan:
    """One inducing scan: queues by character, and the least common prefix since each queue's last entry."""

    def __init__(self, text: np.ndarray, s: np.ndarray, wanted: bool, limit: int, disk: Disk):
        self.text, self.s, self.wanted, self.limit = text, s, wanted, limit
        self.queues = [Spool(disk) for _ in range(256)]
        self.least = np.full(256, 0, np.uint8)  # the first entry of a queue has nothing before it

    def visit(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        """Tuples in order induce the suffixes before them that are of the wanted type."""
        before = pos - 1
        some = np.flatnonzero((pos > 0) & (self.s[np.maximum(before, 0)] == self.wanted))
        low = lcp.min() if len(lcp) else FAR
        seen = np.zeros(256, bool)
        if len(some):
            before = before[some]
            to = self.text[before]
            order = np.argsort(to, kind="stable")
            sorted_to = to[order]
            cut = np.flatnonzero(np.concatenate(([True], sorted_to[1:] != sorted_to[:-1], [True])))
            for a, b in zip(cut[:-1], cut[1:]):
                c = int(sorted_to[a])
                index = some[order[a:b]]
                mins = np.minimum.reduceat(lcp[: index[-1] + 1], np.concatenate(([0], index[:-1] + 1)))
                mins[0] = min(mins[0], self.least[c])
                mins = np.minimum(mins.astype(np.int16) + 1, self.limit).astype(np.uint8)
                self.queues[c].push(before[order[a:b]], mins)
                rest = lcp[index[-1] + 1 :]
                self.least[c] = rest.min() if len(rest) else FAR
                seen[c] = True
        self.least[~seen] = np.minimum(self.least[~seen], low)

    def pull(self, c: int) -> int | None:
        """Visits the tuples of a character in order; the last position."""
        last = None
        for pos, lcp in self.queues[c].stream():
            if last is None:
                lcp[0] = 0  # another character before
            self.visit(pos, lcp)
            last = int(pos[-1])
        return last


def repeats(text: np.ndarray, limit: int, disk: Disk | None = None) -> np.ndarray:
    """Whether the `limit` characters from each position also begin at another one.

    text: characters from 1 to 254, with 0 after each piece and at the end; limit characters with a 0 among them count
    as different from all others if pieces end with `limit` characters that are not asked about, or are checked by the caller.
    """
    own = disk or Disk()
    try:
        return _repeats(text, limit, own)
    finally:
        if disk is None:
            own.close()


def order(text: np.ndarray, limit: int, disk: Disk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in order as pieces (position, common prefix with the one before), smallest bucket last: pieces come by descending first character, each piece ascending."""
    n = len(text)
    if n == 1:
        yield np.zeros(1, np.int64), np.zeros(1, np.uint8)
        return
    padded = disk.array(n + 16, np.uint8)
    for a, b in disk.spans(n):
        padded[a:b] = text[a:b]
    text = padded[:n]
    s = s_types(text, disk)
    is_star = lambda a, b: np.flatnonzero(s[a + 1 : b + 1] & ~s[a : min(b, n - 1)]) + a + 1
    found = np.zeros(256, np.int64)
    for a, b in disk.spans(n - 1):
        found += np.bincount(text[is_star(a, b)], minlength=256)
    bound = np.concatenate(([0], np.cumsum(found)))
    stars, at = disk.array(int(bound[-1]), np.int64), 0
    for a, b in disk.spans(n - 1):
        some = is_star(a, b)
        stars[at : at + len(some)] = some
        at += len(some)
    same = runs_of(text, limit, disk)
    ranked = sort_stars(padded, stars, limit, disk)
    prefix = disk.array(len(ranked), np.uint8)
    for a, b in disk.spans(len(ranked) - 1):
        prefix[a + 1 : b + 1] = common(padded, ranked[a:b], ranked[a + 1 : b + 1], limit)
    # upwards: L-type suffixes
    up = Scan(text, s, False, limit, disk)
    for c in range(256):
        last = up.pull(c)
        for a in range(bound[c], bound[c + 1], disk.memory):
            b = min(a + disk.memory, bound[c + 1])
            lcp = np.array(prefix[a:b])
            if a == bound[c]:
                lcp[0] = 0 if last is None else min(same[last], same[ranked[a]])
            up.visit(np.asarray(ranked[a:b]), lcp)
    # downwards: S-type suffixes; a tuple's common prefix is that with the one just before it, which is the greater one
    down = Scan(text, s, True, limit, disk)
    for c in range(255, -1, -1):
        last = down.pull(c)
        if c == 0:  # the last suffix, which nothing induces, is the smallest
            end = np.array([n - 1]), np.array([0 if last is None else 1], np.uint8)
            down.queues[0].push(*end)
            down.visit(*end)
            last = n - 1
        low, high = up.queues[c], down.queues[c]
        shared = np.uint8(0)
        if low.size:
            for k, (a, pos, lcp) in enumerate(low.chunks(back=True)):
                if a == 0:
                    lcp[0] = 0
                if k == 0:
                    shared = carry = np.uint8(0) if last is None else np.minimum(same[last], same[pos[-1]])
                down.visit(pos[::-1], np.concatenate(([carry], lcp[:0:-1])).astype(np.uint8))
                carry = lcp[0]
            for a, pos, lcp in low.chunks():
                if a == 0:
                    lcp[0] = 0
                yield pos, lcp
        # the S-type suffixes were found from the greatest down
        later = shared
        for _, pos, lcp in high.chunks(back=True):
            yield pos[::-1], np.concatenate(([later], lcp[:0:-1])).astype(np.uint8)
            later = lcp[0]


def _repeats(text: np.ndarray, limit: int, disk: Disk) -> np.ndarray:
    out = disk.array(len(text), bool)
    last = None
    for pos, lcp in order(text, limit, disk):
        hit = np.flatnonzero(lcp >= limit)
        out[pos[hit]] = True
        out[pos[hit[hit > 0] - 1]] = True
        if len(hit) and hit[0] == 0 and last is not None:
            out[last] = True
        last = pos[-1]
    return out
