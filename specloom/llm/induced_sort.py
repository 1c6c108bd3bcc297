"""External induced sorting of suffixes, with common-prefix lengths, up to a given depth.

The text is an array of small numbers whose last, 0, occurs once. Suffixes that begin a rise (LMS
suffixes) are named by their substrings up to the next such place; names that are not unique are
sorted as a text of their own, by recursion, or at once where they fit into memory. From their
order, a scan upwards induces all falling suffixes and a scan downwards all rising ones: each
suffix that leaves the queue pushes its left neighbour under that neighbour's first symbol.

The queue is a priority queue on (first symbol, order of arrival), so whole blocks of equal first
symbol leave at once. Its tuples are (position, common prefix with the tuple before it under the
same symbol); that length is one more than the least common prefix met between the two pushes.

Memory is bounded by the allowance, a number of tuples, not by the text. Queues write their blocks
to files; substrings are dealt into files by their next byte until a file fits; and every array that
is as long as the text or its alphabet (types, starts, names, order, lengths, last pushes) lies in a
file when it is longer than the allowance, and is filled in blocks.

Order and lengths are exact up to `depth` symbols: suffixes equal that far may come in any order,
and any length of at least `depth` only says that they are.
"""

from __future__ import annotations

import os
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np

CAP = 250  # lengths are bytes
BLOCK = 1 << 18


class Memory:
    """Counts the tuples held in memory by the queues of one sort; the fullest queue writes out when they are too many."""

    def __init__(self, tuples: int, folder: str):
        self.tuples, self.folder, self.held, self.files, self.queues, self.mapped = tuples, folder, 0, 0, [], []

    def grew(self, by: int) -> None:
        self.held += by
        while self.held > self.tuples and (fullest := max(self.queues, key=lambda q: q.held)).held:
            fullest.write_out()

    def path(self) -> str:
        self.files += 1
        return os.path.join(self.folder, f"{id(self):x}-{self.files}.npy")

    @property
    def block(self) -> int:
        """Rows that are worked on together."""
        return max(256, min(BLOCK, self.tuples))

    def array(self, n: int, dtype) -> np.ndarray:
        """n zeros, in a file if they are more than the allowance."""
        if n <= self.tuples:
            return np.zeros(n, dtype)
        path = self.path()
        with open(path, "wb") as out:
            out.truncate(n * np.dtype(dtype).itemsize)
        self.mapped.append(path)
        return np.memmap(path, dtype, "r+", shape=(n,))

    def close(self) -> None:
        for path in self.mapped:
            os.remove(path)
        self.mapped.clear()


class BlockQueue:
    """First in, first out under each symbol; blocks are (positions, lengths).

    Symbols are kept in ranges, as many as the allowance can fill with blocks of some size. What is pushed under a range waits as (symbols, positions, lengths), in memory
    or in files, and is dealt to its symbols when the first of them is asked for, so there are few files however many symbols."""

    def __init__(self, memory: Memory, symbols: int):
        self.memory, self.held, self.width = memory, 0, -(-symbols // min(1024, max(16, memory.tuples // 256)))
        self.waiting: defaultdict[int, deque] = defaultdict(deque)  # by range: blocks in memory and paths of files
        self.blocks: dict[int, deque] = {}  # by symbol, of the open range
        self.open: int | None = None
        memory.queues.append(self)

    def _grew(self, by: int) -> None:
        self.held += by
        self.memory.grew(by)

    def push(self, symbol: int, positions: np.ndarray, lengths: np.ndarray) -> None:
        of = symbol // self.width
        if of == self.open:
            own = self.blocks.setdefault(symbol, deque())
            if own and not isinstance(own[-1], str) and len(own[-1][0]) + len(positions) <= 4096:
                own[-1] = (np.concatenate([own[-1][0], positions]), np.concatenate([own[-1][1], lengths]))
            else:
                own.append((positions, lengths))
            self._grew(len(positions))
        else:
            self.push_many(of, np.full(len(positions), symbol, np.int64), positions, lengths)

    def push_many(self, of: int, symbols: np.ndarray, positions: np.ndarray, lengths: np.ndarray) -> None:
        """Tuples of several symbols of one range, in order of arrival."""
        if of == self.open:
            for s, at in _runs_of(symbols):
                self.push(s, positions[at], lengths[at])
            return
        own = self.waiting[of]
        if own and not isinstance(own[-1], str) and len(own[-1][0]) + len(positions) <= 4096:
            own[-1] = tuple(np.concatenate([x, y]) for x, y in zip(own[-1], (symbols, positions, lengths), strict=True))
        else:
            own.append((symbols, positions, lengths))
        self._grew(len(positions))

    def write_out(self) -> None:
        for table in (self.blocks, self.waiting):
            for own in table.values():
                run: list = []
                while own and not isinstance(own[-1], str):  # blocks in memory came after those in files
                    run.insert(0, own.pop())
                if run:
                    own.append(self.memory.path())
                    with open(own[-1], "wb") as out:
                        for part in zip(*run, strict=True):
                            np.save(out, np.concatenate(part))
        self.memory.held -= self.held
        self.held = 0

    def _load(self, block, parts: int) -> tuple[np.ndarray, ...]:
        if not isinstance(block, str):
            self.held -= len(block[0])
            self.memory.held -= len(block[0])
            return block
        with open(block, "rb") as file:
            out = tuple(np.load(file) for _ in range(parts))
        os.remove(block)
        return out

    def _enter(self, of: int) -> None:
        """Deal a range's tuples to its symbols. Ranges are entered in order, so the one left is empty, or waits under itself."""
        if self.open is not None:
            for s, own in self.blocks.items():
                for block in own:
                    positions, lengths = self._load(block, 2)
                    self.waiting[self.open].append((np.full(len(positions), s, np.int64), positions, lengths))
                    self._grew(len(positions))
        self.blocks, self.open = {}, of
        waiting = self.waiting.pop(of, deque())
        while waiting:
            self.push_many(of, *self._load(waiting.popleft(), 3))

    def pop(self, symbol: int, last: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        of = symbol // self.width
        if of != self.open:
            if of not in self.waiting:
                return None
            self._enter(of)
        own = self.blocks.get(symbol)
        if not own:
            self.blocks.pop(symbol, None)
            return None
        return self._load(own.pop() if last else own.popleft(), 2)

    def close(self) -> None:
        self.memory.queues.remove(self)


def _runs_of(symbols: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each symbol with the places where it stands, in order."""
    few = len(symbols) and symbols.min() >= 0 and symbols.max() < 1 << 16  # numpy sorts small numbers by their digits
    order = np.argsort(symbols.astype(np.uint16) if few else symbols, kind="stable")
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(symbols[order])) + 1, [len(order)]])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield int(symbols[order[a]]), order[a:b]


def types(text: np.ndarray, allowance: Memory) -> np.ndarray:
    """True where the suffix is smaller than the one to its right; filled from the right, in blocks."""
    n = len(text)
    rising = allowance.array(n, bool)
    rising[n - 1] = True
    for upto in range(n - 1, 0, -allowance.block):
        at = max(0, upto - allowance.block)
        own = np.asarray(text[at : upto + 1]).astype(np.int64)
        step = np.sign(np.diff(own)).astype(np.int8)
        where = np.where(step != 0, np.arange(len(step)), len(step))
        nearest = np.minimum.accumulate(where[::-1])[::-1]
        rising[at:upto] = np.append(step > 0, rising[upto])[nearest]
    return rising


def lms_starts(rising: np.ndarray, allowance: Memory) -> np.ndarray:
    n, size = len(rising), 0
    parts = lambda: ((at, at + np.flatnonzero(rising[at : at + allowance.block] & ~rising[at - 1 : at - 1 + min(allowance.block, n - at)])) for at in range(1, n, allowance.block))
    for _, found in parts():
        size += len(found)
    starts, size = allowance.array(size, np.int64), 0
    for _, found in parts():
        starts[size : size + len(found)] = found
        size += len(found)
    return starts


def _split(rank: np.ndarray, members: np.ndarray, keys: np.ndarray) -> None:
    """Refine ranks (a group's rank is its first place): the members, whole groups, are ordered within them by keys."""
    own = rank[members]
    low, most = int(keys.min()), int(keys.max())
    bits = (most - low).bit_length()
    if bits + int(own.max()).bit_length() < 64:  # one key for both; equals may come in any order
        order = np.argsort((own << bits) | (keys - low))
    else:
        order = np.lexsort((keys, own))
    m, k = members[order], keys[order]
    group = rank[m]
    new_group = np.concatenate([[True], group[1:] != group[:-1]])
    new = new_group | np.concatenate([[True], k[1:] != k[:-1]])
    at = np.arange(len(m))
    group_start = np.maximum.accumulate(np.where(new_group, at, 0))
    rank[m] = group + np.maximum.accumulate(np.where(new, at, 0)) - group_start


def _crowded(rank: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """Those that share their rank with others."""
    of = np.arange(len(rank)) if of is None else of
    counts = np.bincount(rank[of], minlength=len(rank))
    return of[counts[rank[of]] > 1]


def name_substrings(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ranks (a group's first place) of the substrings from each start to its end, both included; a shorter one sorts after those it begins."""
    pad = np.int64(np.iinfo(text.dtype).max)
    rank = np.zeros(len(starts), np.int64)
    wide = 7 if text.dtype == np.uint8 else 1  # symbols that fit into one key
    members, offset = np.arange(len(starts)), 0
    while len(members):
        keys = np.zeros(len(members), np.int64)
        for j in range(offset, offset + wide):
            at = starts[members] + j
            keys = keys * (256 if wide > 1 else 0) + np.where(at <= ends[members], text[np.minimum(at, len(text) - 1)], pad)
        _split(rank, members, keys)
        offset += wide
        members = _crowded(rank, members)
        # a group whose members have all ended is final: equal substrings
        open_groups = np.zeros(len(rank), bool)
        open_groups[rank[members[ends[members] >= starts[members] + offset]]] = True
        members = members[open_groups[rank[members]]]
    return rank


def _dealt(text: np.ndarray, starts: np.ndarray, depth: int, which, size: int, digit: int, allowance: Memory) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (indices into starts, whether each begins a new name), by substring; which() gives the indices, equal in their first `digit` bytes, in blocks.

    More of them than the allowance are dealt to files by their next byte, and each file in turn."""
    width = text.dtype.itemsize

    def ends_of(index: np.ndarray) -> np.ndarray:
        return np.minimum(starts[np.minimum(index + 1, len(starts) - 1)], starts[index] + depth)

    if size <= allowance.tuples:
        index = np.concatenate(list(which()))
        rank = name_substrings(text, np.asarray(starts[index]), np.asarray(ends_of(index)))
        order = np.argsort(rank, kind="stable")
        yield index[order], np.concatenate([[True], np.diff(rank[order]) != 0])
        return
    offset, byte = divmod(digit, width)
    pad = np.iinfo(text.dtype).max
    paths, sizes, ended, files = {}, defaultdict(int), 0, {}
    done = allowance.path()  # those that have ended: all equal
    try:
        with open(done, "wb") as finished:
            for index in which():
                at = starts[index] + offset
                over = at > ends_of(index)
                symbols = np.where(over, pad, text[np.minimum(at, len(text) - 1)]).astype(text.dtype)
                if over.any() and byte == 0:
                    finished.write(index[over].tobytes())
                    ended += int(over.sum())
                    index, symbols = index[~over], symbols[~over]
                values = (symbols.astype(np.int64) >> 8 * (width - 1 - byte)) & 255
                for value, own in _runs_of(values) if len(values) else ():
                    if value not in files:
                        paths[value] = allowance.path()
                        files[value] = open(paths[value], "wb")  # noqa: SIM115
                    files[value].write(index[own].tobytes())
                    sizes[value] += len(own)
    finally:
        for file in files.values():
            file.close()

    def read(path: str, upto: int):
        def blocks():
            with open(path, "rb") as file:
                for _ in range(0, upto, allowance.block):
                    yield np.frombuffer(file.read(8 * allowance.block), np.int64)

        return blocks

    for value in sorted(paths):
        yield from _dealt(text, starts, depth, read(paths[value], sizes[value]), sizes[value], digit + 1, allowance)
        os.remove(paths[value])
    for i, index in enumerate(read(done, ended)()):
        yield index, np.concatenate([[i == 0], np.zeros(len(index) - 1, bool)])
    os.remove(done)


def order_names(names: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes of a text of names 0, 1, ..., by doubling, as far as depth names."""
    rank = np.concatenate([[0], np.cumsum(np.bincount(names))])[names]
    members, have = _crowded(rank), 1
    while len(members) and have < depth:
        after = members + have
        keys = np.where(after < len(rank), rank[np.minimum(after, len(rank) - 1)], -1)
        _split(rank, members, keys)
        members = _crowded(rank, members)
        have *= 2
    return np.argsort(rank, kind="stable")


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Lengths, up to depth, of the common prefixes of the suffixes at a and at b."""
    out = np.zeros(len(a), np.int64)
    act = np.arange(len(a))
    last = len(text) - 1
    if text.dtype == np.uint8 and len(text) >= 8:  # eight bytes at once, as long as neither suffix comes near the end
        words = np.ndarray(len(text) - 7, "<u8", text, strides=(1,))
        inner = np.maximum(a, b) <= last - 7 - depth
        own, act = act[inner], act[~inner]
        for r in range(0, depth, 8):
            if not len(own):
                break
            differ = words[a[own] + r] ^ words[b[own] + r]
            lowest = differ & (~differ + np.uint64(1))  # its lowest bit; none: 0
            out[own] += np.where(differ == 0, 8, (np.frexp(lowest.astype(np.float64))[1] - 1) >> 3)
            own = own[differ == 0]
        np.minimum(out, depth, out=out)
    for r in range(depth):
        if not len(act):
            break
        at_a, at_b = a[act] + r, b[act] + r
        same = (at_a <= last) & (at_b <= last)
        same &= text[np.minimum(at_a, last)] == text[np.minimum(at_b, last)]
        act = act[same]
        out[act] += 1
    return out


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo..hi], both included, for each pair."""
    level = np.frexp((hi - lo + 1).astype(np.float64))[1].astype(np.int64) - 1
    n = len(values)
    table = np.empty((1 + int(level.max(initial=0)), n), values.dtype)  # a row for each power of two
    table[0] = values
    for k in range(1, len(table)):
        half, upto = 1 << k - 1, n - (1 << k) + 1
        np.minimum(table[k - 1, :upto], table[k - 1, half : half + upto], out=table[k, :upto])
    row = level * n
    return np.minimum(table.ravel()[row + lo], table.ravel()[row + hi - (1 << level) + 1])


class _Scan:
    """Pushes the left neighbours of the suffixes that a scan meets, with their common prefixes."""

    def __init__(self, text: np.ndarray, rising: np.ndarray, want_rising: bool, queue: BlockQueue, symbols: int, allowance: Memory):
        self.text, self.rising, self.want, self.queue, self.block = text, rising, want_rising, queue, allowance.block
        self.pushed = allowance.array(symbols, np.int64)  # when each symbol was last pushed to; 0: never
        self.last = np.zeros(CAP + 1, np.int64)  # when a length of at most so much was last met
        self.now = 1

    def meet(self, positions: np.ndarray, lengths: np.ndarray) -> None:
        """Suffixes in scan order; lengths are common prefixes with the suffix met just before each."""
        for at in range(0, len(positions), self.block):
            self._meet(positions[at : at + self.block], lengths[at : at + self.block])

    def _meet(self, positions: np.ndarray, lengths: np.ndarray) -> None:
        left = positions - 1
        on = np.flatnonzero((left >= 0) & (self.rising[left] == self.want))
        if len(on):
            symbols = self.text[left[on]]
            order = np.argsort(symbols, kind="stable")
            on, symbols = on[order], symbols[order].astype(np.int64)
            first = np.concatenate([[True], symbols[1:] != symbols[:-1]])
            own = symbols[first]
            low = np.empty(len(on), np.int64)
            low[~first] = _range_min(lengths, on[:-1][~first[1:]] + 1, on[~first])
            since = np.searchsorted(self.last, self.pushed[own], side="right")  # the least length met since the last push
            low[first] = np.minimum(since, np.minimum.accumulate(lengths)[on[first]])
            pushed = np.minimum(1 + low, CAP).astype(np.uint8)
            pushed[first] = np.where(self.pushed[own] > 0, pushed[first], 0)
            bounds = np.append(np.flatnonzero(first), len(on))
            self.pushed[own] = self.now + on[bounds[1:] - 1]
            places = left[on]
            ranges = own // self.queue.width
            if self.queue.width > 1:
                cuts = np.append(np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]])), len(own))
                for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    a, b = bounds[i], bounds[j]
                    self.queue.push_many(int(ranges[i]), symbols[a:b], places[a:b], pushed[a:b])
            else:
                for s, a, b in zip(own.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    self.queue.push(s, places[a:b], pushed[a:b])
        met = np.zeros(CAP + 1, np.int64)
        met[np.minimum(lengths, CAP)] = self.now + np.arange(len(lengths))  # of equal lengths the last one stays
        self.last = np.maximum(self.last, np.maximum.accumulate(met))
        self.now += len(lengths)


def sort_starts(text: np.ndarray, starts: np.ndarray, depth: int, allowance: Memory) -> np.ndarray:
    """The order of the LMS suffixes, as indices into starts."""
    m = len(starts)
    names, order = allowance.array(m, np.uint32), allowance.array(m, np.int64)
    every = lambda: (np.arange(at, min(at + allowance.block, m)) for at in range(0, m, allowance.block))
    named, at = 0, 0
    for index, new in _dealt(text, starts, depth, every, m, 0, allowance):
        own = named + np.cumsum(new) - 1
        names[index], order[at : at + len(index)] = own, index
        named, at = int(own[-1]) + 1, at + len(index)
    if named == m:
        return order
    need = -(-depth // 2) + 1  # names span two symbols at least
    if m <= allowance.tuples:
        return order_names(names.astype(np.int64), need)
    at = 0
    for positions, _ in induced_sort(names, need, allowance.tuples, allowance.folder):  # the last name is 0, once: the closing 0
        order[at : at + len(positions)] = positions
        at += len(positions)
    return order


def induced_sort(text: np.ndarray, depth: int, memory: int = 1 << 22, folder: str = ".") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (positions, common prefix with the suffix before) in suffix order. text, of unsigned numbers, ends with its only 0."""
    if len(text) == 1:
        yield np.zeros(1, np.int64), np.zeros(1, np.uint8)
        return
    if depth > CAP - 1:
        raise ValueError("depth is too large")
    allowance = Memory(memory, folder)
    try:
        yield from _induced(text, depth, allowance)
    finally:
        allowance.close()


def _induced(text: np.ndarray, depth: int, allowance: Memory) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    rising = types(text, allowance)
    starts = lms_starts(rising, allowance)
    order = sort_starts(text, starts, depth, allowance)
    m, block = len(order), allowance.block
    size = 1 + max(int(text[at : at + block].max()) for at in range(0, len(text), block))
    prefix, seeds = allowance.array(m, np.uint8), allowance.array(size + 1, np.int64)
    for at in range(0, m, block):
        upto = min(at + block, m)
        own = starts[order[at:upto]]
        order[at:upto] = own  # from here on, places in the text
        values, counts = np.unique(text[own], return_counts=True)
        seeds[values.astype(np.int64) + 1] += counts
        before = np.append(order[at - 1] if at else own[0], own[:-1])
        prefix[at:upto] = common_prefix(text, before, own, depth)
    prefix[0] = 0
    total = 0
    for at in range(0, size + 1, block):
        seeds[at : at + block] = total + np.cumsum(seeds[at : at + block])
        total = int(seeds[min(at + block, size + 1) - 1])
    queue, falling = BlockQueue(allowance, size), BlockQueue(allowance, size)

    def junction(a: int, b: int) -> int:
        return int(common_prefix(text, np.array([a]), np.array([b]), depth)[0])

    greatest, least = allowance.array(size, np.int64), allowance.array(size, np.int64)  # one more than the last falling and the first rising suffix of a symbol; 0: none
    scan = _Scan(text, rising, False, queue, size, allowance)
    for s in range(size):
        while block_of := queue.pop(s):
            greatest[s] = int(block_of[0][-1]) + 1
            falling.push(s, *block_of)
            scan.meet(*block_of)
        for a in range(int(seeds[s]), int(seeds[s + 1]), block):
            b = min(a + block, int(seeds[s + 1]))
            own = np.array(prefix[a:b])
            if a == seeds[s]:
                own[0] = junction(int(greatest[s]) - 1, int(order[a])) if greatest[s] else 0
            scan.meet(np.array(order[a:b]), own)
    queue.close()

    queue, done = BlockQueue(allowance, size), BlockQueue(allowance, 2 * size)
    scan = _Scan(text, rising, True, queue, size, allowance)
    for s in range(size - 1, -1, -1):
        while block_of := queue.pop(s):
            least[s] = int(block_of[0][-1]) + 1
            done.push(2 * s + 1, *block_of)
            scan.meet(*block_of)
        # the falling suffixes come next, from the largest down; each length moves to the suffix below
        carried = junction(int(least[s]) - 1, int(greatest[s]) - 1) if least[s] and greatest[s] else 0
        while block_of := falling.pop(s, last=True):
            lengths = np.append(block_of[1][1:], np.uint8(carried))[::-1]
            carried = int(block_of[1][0])
            scan.meet(block_of[0][::-1], lengths)
            done.push(2 * s, block_of[0][::-1], lengths)
    queue.close()

    yield np.array([len(text) - 1]), np.zeros(1, np.uint8)
    for key in range(2 * size):  # falling suffixes are smaller than rising ones; both were pushed from the largest down
        s = key // 2
        carried = junction(int(greatest[s]) - 1, int(least[s]) - 1) if key % 2 and least[s] and greatest[s] else 0
        while block_of := done.pop(key, last=True):
            yield block_of[0][::-1], np.append(np.uint8(carried), block_of[1][:0:-1])
            carried = int(block_of[1][0])
    done.close()
    falling.close()
