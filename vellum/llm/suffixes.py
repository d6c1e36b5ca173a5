"""External induced suffix sorting by recursion, with common-prefix values.

The text is a file of symbols: bytes at first, where 0xFF, which UTF-8 never has, separates strings. Suffixes are L or S
(larger or smaller than the next suffix), and the leftmost S ones (LMS) are ordered first: induction orders their
substrings, equal ones get one name, and the string of names, half as long at most, is sorted by recursion. Induction then
derives all other suffixes: scanned in order, a suffix sends the one before it to the bucket of that one's first symbol.

What waits to be scanned lies in priority queues of suffix tuples (position, common prefix, symbol). A bucket gets its
tuples in sorted order, so a queue of one symbol is first-in first-out; at the levels of names, whose symbols are many, a
queue holds a range of symbols, few enough tuples to sort in memory when their turn comes, and a symbol that is too frequent
for that has a queue of its own. Queues, orders, types, names and LMS positions lie in files beyond a budget of memory.

A tuple's common prefix is the one with the tuple before it in its bucket. The value to send on is one more than the least
value scanned since the last tuple sent to the same bucket. Values stop at `depth`, and order may be any beyond it.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np

SEPARATOR = 255
STEP = 1 << 18
#: Tuples that wait in arrival order before they are dealt to their queues.
STAGE = 1 << 14
#: Blocks of a tier, and what an array takes in memory besides its data.
TIER, OBJECT = 16, 200
FAR = np.uint16(65535)
NEVER = np.int64(1 << 62)


class Queues:
    """Queues of tuples, by number. Tuples beyond the budget of bytes go to one file, in runs; both ends can be read."""

    def __init__(self, path: str, kind: np.dtype, budget: int):
        self.path, self.kind, self.budget, self.held, self.size = path, kind, budget, 0, 0
        self.ram: dict[int, list[list[np.ndarray]]] = {}
        self.runs: dict[int, deque] = {}
        self.file = None

    def push(self, queue: int, rows: np.ndarray) -> None:
        """Blocks of a queue lie in tiers, the newest in the first; a full tier becomes one block of the next."""
        tiers, k = self.ram.setdefault(queue, [[]]), 0
        tiers[0].append(rows.copy())
        self.held += rows.nbytes + OBJECT
        while len(tiers[k]) == TIER:
            if k + 1 == len(tiers):
                tiers.append([])
            tiers[k + 1].append(np.concatenate(tiers[k]))
            tiers[k].clear()
            self.held -= OBJECT * (TIER - 1)
            k += 1
        if self.held > self.budget:
            self.file = self.file or open(self.path, "w+b")  # noqa: SIM115
            self.file.seek(0, os.SEEK_END)
            for q in list(self.ram):
                data = self._memory(q)
                data.tofile(self.file)
                runs = self.runs.setdefault(q, deque())
                runs.extend((self.size + a, min(STEP, len(data) - a)) for a in range(0, len(data), STEP))
                self.size += len(data)

    def deal(self, queues: np.ndarray, rows: np.ndarray) -> None:
        """Pushes rows that are sorted by their queues."""
        cuts = np.flatnonzero(queues[1:] != queues[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)], strict=True):
            if b > a:
                self.push(int(queues[a]), rows[a:b])

    def _memory(self, queue: int) -> np.ndarray:
        blocks = [b for tier in reversed(self.ram.pop(queue)) for b in tier]
        self.held -= sum(b.nbytes + OBJECT for b in blocks)
        return np.concatenate(blocks) if len(blocks) > 1 else blocks[0]

    def _read(self, at: int, n: int) -> np.ndarray:
        self.file.flush()
        return np.fromfile(self.path, self.kind, n, offset=at * self.kind.itemsize)

    def pop(self, queue: int) -> np.ndarray | None:
        """The oldest block of a queue."""
        if self.runs.get(queue):
            return self._read(*self.runs[queue].popleft())
        return self._memory(queue) if queue in self.ram else None

    def pop_last(self, queue: int) -> np.ndarray | None:
        if queue in self.ram:
            return self._memory(queue)
        return self._read(*self.runs[queue].pop()) if self.runs.get(queue) else None

    def close(self) -> None:
        self.ram.clear()
        self.runs.clear()
        if self.file:
            self.file.close()
            os.unlink(self.path)


def _least(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Minima of values over left..right, both inside, by doubling tables."""
    out = np.empty(len(left), values.dtype)
    length = right - left + 1
    level = np.frexp(length.astype(np.float64))[1] - 1
    table, k, top = values, 0, level.max(initial=0)
    while True:
        own = np.flatnonzero(level == k)
        if len(own):
            out[own] = np.minimum(table[left[own]], table[right[own] - (1 << k) + 1])
        if k == top:
            return out
        table = np.minimum(table[: -(1 << k)], table[1 << k :])
        k += 1


def _common(text: np.ndarray, n: int, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and at b, up to most; text has 8 bytes more than its n symbols."""
    wide = text.itemsize
    step = 8 // wide
    words = np.ndarray((len(text) - step + 1,), "<u8", text, 0, (wide,))
    out = np.full(len(a), most, np.int64)
    live = np.arange(len(a))
    for done in range(0, most, step):
        x, y = a[live] + done, b[live] + done
        inside = (x < n) & (y < n)
        differ = np.where(inside, words[np.minimum(x, n)] ^ words[np.minimum(y, n)], np.uint64(1))
        hit = differ != 0
        low = differ[hit]
        where = (np.frexp((low & (~low + np.uint64(1))).astype(np.float64))[1] - 1) // (8 * wide)
        out[live[hit]] = done + where
        live = live[~hit]
        if not len(live):
            break
    return np.minimum(np.minimum(out, most), n - np.maximum(a, b))


def _array(path: str, kind, n: int) -> np.ndarray:
    """A new file as an array."""
    return np.asarray(np.memmap(path, kind, "w+", shape=(max(n, 1),)))


def _opened(path: str, kind) -> np.ndarray:
    return np.asarray(np.memmap(path, kind, "r"))


class _Since:
    """The least value scanned since the last tuple was sent to a symbol.

    Scanned blocks are numbered. A symbol keeps the least value after its last tuple in that tuple's block, and the block;
    floor[b] is the least value of the blocks from b on.
    """

    def __init__(self, folder: str, symbols: int):
        small = symbols <= 1 << 16
        self.rest = np.zeros(symbols, np.uint16) if small else _array(os.path.join(folder, "rest"), np.uint16, symbols)
        self.block = np.zeros(symbols, np.int32) if small else _array(os.path.join(folder, "block"), np.int32, symbols)
        self.floor, self.now = np.full(1024, FAR), 0

    def get(self, symbols: np.ndarray) -> np.ndarray:
        return np.minimum(self.rest[symbols], self.floor[self.block[symbols]])

    def sent(self, symbols: np.ndarray, rest: np.ndarray) -> None:
        self.rest[symbols], self.block[symbols] = rest, self.now + 1

    def scanned(self, least: np.uint16) -> None:
        self.floor[np.searchsorted(self.floor[: self.now], least, "right") : self.now + 1] = least
        self.now += 1
        if self.now + 2 >= len(self.floor):
            self.floor = np.concatenate([self.floor, np.full(len(self.floor), FAR)])


class SuffixSorter:
    """Sorts the suffixes of a text of symbols to a depth. Memory: `budget` bytes of queues and small records of ranges;
    text, types, names and orders are files mapped into memory, which the system may drop at any time."""

    def __init__(self, text: np.ndarray, n: int, depth: int, folder: str, budget: int = 64 << 20, last: np.ndarray | None = None, bits: int = 0):
        """text: n symbols and 8 bytes more. At levels of names: the last symbol of each range of 2 ** bits symbols."""
        self.text, self.n, self.depth, self.folder, self.budget, self.last, self.bits = text, n, depth, folder, budget, last, bits
        self.place = np.dtype(np.int32 if n < 1 << 31 else np.int64)
        self.kind = np.dtype([("at", self.place), ("lcp", np.uint16), ("sym", text.dtype)])
        self.symbols = 256 if last is None else n
        self.queues = 256 if last is None else 2 * len(last)
        os.makedirs(folder, exist_ok=True)
        if n:
            self._types()

    def _queue(self, symbols: np.ndarray) -> np.ndarray:
        """Numbers of queues, in the order of symbols; odd ones, and all of bytes, hold one symbol."""
        if self.last is None:
            return symbols
        range_ = symbols >> self.bits
        return 2 * range_.astype(np.int64) + (symbols == self.last[range_])

    def _types(self) -> None:
        """small[i]: 0 for L, 1 for S, 2 for LMS. The last suffix is larger than nothing. Keeps the LMS positions and lengths."""
        self.small = _array(os.path.join(self.folder, "types"), np.uint8, self.n)
        after = False
        for end in range(self.n, 0, -STEP):
            start = max(0, end - STEP)
            here, then = self.text[start:end], self.text[start + 1 : end + 1]
            up, down = here < then, here > then
            if end == self.n:
                up[-1], down[-1] = False, True
            known = np.where(up | down, np.arange(len(here)), len(here))
            value = np.append(up, after)
            self.small[start:end] = value[np.minimum.accumulate(known[::-1])[::-1]]
            after = bool(self.small[start])
        path, self.count = os.path.join(self.folder, "lms"), 0
        with open(path, "wb") as f:
            for start in range(0, self.n, STEP):
                end = min(self.n, start + STEP)
                before = np.concatenate([[1 if start == 0 else self.small[start - 1]], self.small[start : end - 1]])
                found = np.flatnonzero((self.small[start:end] > 0) & (before == 0)) + start
                self.small[found] = 2
                found.astype(self.place).tofile(f)
                self.count += len(found)
            np.array([self.n], self.place).tofile(f)
        self.lms = _opened(path, self.place)
        # By half the position, as LMS suffixes are two apart at least: the symbols of each LMS substring, the next one's first included.
        self.length = _array(os.path.join(self.folder, "length"), np.uint16, self.n // 2 + 1)
        for a in range(0, self.count, STEP):
            at, then = self.lms[a : a + STEP][: self.count - a], self.lms[a + 1 : a + 1 + STEP]
            length = then - at + 1
            length[then == self.n] -= 1
            self.length[at >> 1] = np.minimum(length, self.depth + 1)

    def _emit(self, rows: np.ndarray, kinds: np.ndarray | int, up: bool, since: _Since | None) -> np.ndarray:
        """Scans rows in order: puts right the first value of each bucket, and returns the tuples that rows send, by symbol."""
        at, sym, lcp = rows["at"].astype(np.int64), rows["sym"], rows["lcp"]
        if since is not None:
            kinds = np.broadcast_to(kinds, len(rows))
            was_sym, was_kind = np.append(self.was[0], sym[:-1].astype(np.int64)), np.append(self.was[1], kinds[:-1])
            turn = np.flatnonzero((was_sym != sym) | (was_kind != kinds))
            if len(turn):
                seam = was_sym[turn] == sym[turn]
                lcp[turn[~seam]] = 0
                if seam.any():
                    own = turn[seam]
                    lcp[own] = _common(self.text, self.n, np.append(self.was[2], at[:-1])[own], at[own], self.depth)
            self.was = (int(sym[-1]), int(kinds[-1]), int(at[-1]))
        own = np.flatnonzero(at > 0)
        own = own[(self.small[at[own] - 1] > 0) != up]
        before = at[own] - 1
        symbol = self.text[before]
        order = np.argsort(symbol, kind="stable")
        own, symbol = own[order], symbol[order]
        out = np.empty(len(own), self.kind)
        out["at"], out["sym"], out["lcp"] = before[order], symbol, 1
        if since is not None:
            if len(own):
                starts = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]))
                left = np.append(0, own[:-1] + 1)
                left[starts] = 0
                least = _least(lcp, left, own)
                own_symbols = symbol[starts]
                least[starts] = np.minimum(least[starts], since.get(own_symbols))
                out["lcp"] = np.minimum(least, self.depth - 1) + np.uint16(1)
                tail = np.append(np.minimum.accumulate(lcp[::-1])[::-1], FAR)
                since.sent(own_symbols, tail[own[np.append(starts[1:], len(own)) - 1] + 1])
            since.scanned(lcp.min())
        return out

    def _pass(self, fixed: Queues, waiting: Queues, up: bool, since: _Since | None, visit: Callable[[np.ndarray], None]) -> None:
        """Scans all suffixes, upward from LMS (fixed) to L, or downward from L to S.

        A bucket's own tuples come first: L ones going up, S ones going down; then those of fixed, which is read from its
        end going down.
        """
        staged: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        self.was = (-1, -1, -1)

        def joined() -> tuple[np.ndarray, np.ndarray]:
            return (np.concatenate([q for q, _ in staged]), np.concatenate([r for _, r in staged])) if len(staged) > 1 else staged[0]

        def stage(queues: np.ndarray, rows: np.ndarray) -> None:
            nonlocal held
            if len(rows):
                staged.append((queues, rows))
                held += len(rows)
                if held > STAGE:
                    queues, rows = joined()
                    if len(staged) > 1:
                        order = np.argsort(queues, kind="stable")
                        queues, rows = queues[order], rows[order]
                    staged.clear()
                    held = 0
                    waiting.deal(queues, rows)

        def take(queue: int) -> np.ndarray | None:
            nonlocal held
            rows = waiting.pop(queue)
            if rows is None and staged:
                queues, rows = joined()
                mine = queues == queue
                if not mine.any():
                    staged[:] = [(queues, rows)]
                    return None
                staged[:] = [(queues[~mine], rows[~mine])]
                rows = rows[mine]
                held -= len(rows)
            return rows

        def later(queue: int) -> Iterator[np.ndarray]:
            """fixed, in the order of the scan; going down, a value tells of the tuple scanned before."""
            if up:
                while (rows := fixed.pop(queue)) is not None:
                    yield rows
                return
            seam = np.uint16(0)
            while (rows := fixed.pop_last(queue)) is not None:
                rows = rows[::-1].copy()
                value = rows["lcp"].copy()
                rows["lcp"][1:], rows["lcp"][0] = value[:-1], seam
                seam = value[-1]
                yield rows

        def scan(rows: np.ndarray, kinds: np.ndarray | int) -> np.ndarray:
            out = self._emit(rows, kinds, up, since)
            visit(rows, kinds)
            return out

        for queue in range(self.queues) if up else range(self.queues - 1, -1, -1):
            if self.last is None or queue % 2:
                while (rows := take(queue)) is not None:
                    for a in range(0, len(rows), STEP):
                        out = scan(rows[a : a + STEP], 0)
                        stage(self._queue(out["sym"]), out)
                for rows in later(queue):
                    for a in range(0, len(rows), STEP):
                        out = scan(rows[a : a + STEP], 1)
                        stage(self._queue(out["sym"]), out)
            else:
                own = []
                while (rows := take(queue)) is not None:
                    own.append(rows)
                first = sum(map(len, own))
                own += list(later(queue))
                if own:
                    self._range(np.concatenate(own), first, queue, up, scan, stage)

    def _range(self, rows: np.ndarray, first: int, queue: int, up: bool, scan: Callable, stage: Callable) -> None:
        """Scans a range of symbols whose tuples are in memory; some send tuples into the range itself.

        The rows to scan at once are those before the place where the first of the tuples that they send belongs.
        """

        def keys(symbols: np.ndarray, kind: np.ndarray | int) -> np.ndarray:
            symbols = symbols.astype(np.int64)
            return 2 * (symbols if up else self.symbols - symbols) + kind

        def sends(rows: np.ndarray) -> np.ndarray:
            """Where in this range a row's own tuple belongs."""
            at = rows["at"].astype(np.int64)
            before = np.maximum(at - 1, 0)
            symbol = self.text[before]
            inside = (at > 0) & ((self.small[before] > 0) != up) & (self._queue(symbol) == queue)
            return np.where(inside, keys(symbol, 0), NEVER)

        kinds = (np.arange(len(rows)) >= first).astype(np.int64)
        key = keys(rows["sym"], kinds)
        order = np.argsort(key, kind="stable")
        rows, key = rows[order], key[order]
        to = sends(rows)
        while len(rows):
            late = np.flatnonzero(np.minimum.accumulate(to)[:-1] < key[1:])
            k = int(late[0]) + 1 if len(late) else len(rows)
            out = scan(rows[:k], key[:k] & 1)
            rows, key, to = rows[k:], key[k:], to[k:]
            queues = self._queue(out["sym"])
            mine = queues == queue
            if not mine.any():
                stage(queues, out)
            else:
                stage(queues[~mine], out[~mine])
                out = out[mine]
                rows = np.concatenate([rows, out])
                key = np.concatenate([key, keys(out["sym"], 0)])
                to = np.concatenate([to, sends(out)])
                order = np.argsort(key, kind="stable")
                rows, key, to = rows[order], key[order], to[order]

    def _induce(self, lms: Queues, visit: Callable[[np.ndarray], None], values: bool) -> None:
        """Visits all suffixes from the largest down, given the LMS ones by queue. values: whether prefix values are needed."""
        folder, budget = self.folder, self.budget // 4
        large, small = (Queues(os.path.join(folder, x), self.kind, budget) for x in ("large", "small"))
        stored = Queues(os.path.join(folder, "stored"), self.kind, budget)

        def store(rows: np.ndarray, kinds: np.ndarray | int) -> None:
            own = rows if isinstance(kinds, int) and not kinds else rows[:0] if isinstance(kinds, int) else rows[kinds == 0]
            if len(own):
                stored.deal(self._queue(own["sym"]), own)

        end = np.zeros(1, self.kind)
        end["at"], end["sym"] = self.n - 1, self.text[self.n - 1]
        large.push(int(self._queue(end["sym"])[0]), end)
        self._pass(lms, large, True, _Since(folder, self.symbols) if values else None, store)
        large.close()
        self._pass(stored, small, False, _Since(folder, self.symbols) if values else None, lambda rows, kinds: visit(rows))
        small.close()
        stored.close()

    def _deal(self, out: Queues, at: np.ndarray, lcp: np.ndarray | int) -> None:
        rows = np.empty(len(at), self.kind)
        rows["at"], rows["sym"], rows["lcp"] = at, self.text[at], lcp
        queues = self._queue(rows["sym"])
        order = np.argsort(queues, kind="stable")
        out.deal(queues[order], rows[order])

    def _names(self) -> tuple[np.ndarray, int, np.ndarray, int, np.ndarray]:
        """Orders the LMS substrings. Returns their names in text order (a name is the place of the first of equals), how
        many there are, the last name of each range of names, the bits of a range, and the LMS positions by name, largest first."""
        lms = Queues(os.path.join(self.folder, "seeds"), self.kind, self.budget // 4)
        for a in range(0, self.count, STEP):
            self._deal(lms, self.lms[a : min(self.count, a + STEP)], 1)
        path = os.path.join(self.folder, "order")
        with open(path, "wb") as f:
            self._induce(lms, lambda rows: rows["at"][self.small[rows["at"]] == 2].tofile(f), False)
        lms.close()
        order = _opened(path, self.place)
        bits = max(1, self.count.bit_length() // 2 - 1, self.count.bit_length() - 12)  # 4096 ranges at most
        last = np.full((self.count >> bits) + 1, -1, np.int64)
        kind = np.dtype(np.int32 if self.count < 1 << 31 else np.int64)
        by_half = _array(os.path.join(self.folder, "half"), kind, self.n // 2 + 1)
        name, different, before = 0, 0, None
        for a in range(0, self.count, STEP):
            at = order[max(0, self.count - a - STEP) : self.count - a][::-1].astype(np.int64)
            one, two = np.append(at[0] if before is None else before, at[:-1]), at
            length = self.length[two >> 1].astype(np.int64)
            same = self.length[one >> 1] == length
            same[0] &= before is not None
            pairs = np.flatnonzero(same)
            if len(pairs):
                same[pairs] = _common(self.text, self.n, one[pairs], two[pairs], int(length[pairs].max())) >= length[pairs]
            names = np.maximum.accumulate(np.where(same, name, a + np.arange(len(at))))
            different += int((~same).sum())
            by_half[at >> 1] = names
            last[names >> bits] = names
            name, before = int(names[-1]), at[-1]
        reduced = _array(os.path.join(self.folder, "reduced"), kind, self.count + 8)
        for a in range(0, self.count, STEP):
            b = min(self.count, a + STEP)
            reduced[a:b] = by_half[self.lms[a:b] >> 1]
        del by_half
        os.unlink(os.path.join(self.folder, "half"))
        return reduced, different, last, bits, order

    def _sorted_lms(self) -> Queues:
        """The LMS suffixes, sorted to the depth, each with its common prefix with the one before it."""
        reduced, different, last, bits, order = self._names()
        path = os.path.join(self.folder, "sorted")
        kind = np.dtype([("at", np.int64), ("lcp", np.uint16)])
        with open(path, "wb") as f:
            if different == self.count:
                for a in range(0, self.count, STEP):
                    rows = np.zeros(min(STEP, self.count - a), kind)
                    rows["at"] = np.searchsorted(self.lms[: self.count], order[a : a + STEP])
                    rows.tofile(f)
            else:

                def visit(rows: np.ndarray) -> None:
                    out = np.empty(len(rows), kind)
                    out["at"], out["lcp"] = rows["at"], rows["lcp"]
                    out.tofile(f)

                below = SuffixSorter(reduced, self.count, (self.depth + 1) // 2, os.path.join(self.folder, "r"), self.budget, last, bits)
                below.visit(visit)
                below.close()
        del order
        ranked = _opened(path, kind)
        out = Queues(os.path.join(self.folder, "seeds"), self.kind, self.budget // 4)
        was, shared = -1, 0
        for a in range(0, self.count, STEP):
            rows = ranked[max(0, self.count - a - STEP) : self.count - a][::-1]
            own = rows["at"]
            one = np.append(was if was >= 0 else own[0], own[:-1])
            names = np.append(shared, rows["lcp"][:-1]).astype(np.int64)  # names in common with the one before
            was, shared = int(own[-1]), int(rows["lcp"][-1])
            # Names that agree span so many symbols; the substrings that differ first tell the rest.
            x, y = self.lms[one].astype(np.int64), self.lms[own].astype(np.int64)
            skip = np.minimum(self.lms[np.minimum(own + names, self.count)] - y, self.depth)
            lcp = skip.copy()
            more = np.flatnonzero(skip < self.depth)
            lcp[more] += np.maximum(_common(self.text, self.n, x[more] + skip[more], y[more] + skip[more], self.depth), 0)
            self._deal(out, y, np.minimum(lcp, self.depth))
        del ranked
        os.unlink(path)
        return out

    def _in_memory(self, visit: Callable[[np.ndarray], None]) -> None:
        """A level of few names is ordered by doubling ranks, as its arrays fit the budget."""
        order = np.argsort(self.text[: self.n], kind="stable").astype(np.int32)
        by = self.text[order]
        group = np.maximum.accumulate(np.where(np.append(True, by[1:] != by[:-1]), np.arange(self.n, dtype=np.int32), np.int32(0)))
        rank = np.empty(self.n, np.int32)
        rank[order] = group
        step = 1
        while step < self.depth:
            alone = np.ones(self.n, bool)
            alone[1:] &= group[1:] != group[:-1]
            alone[:-1] &= group[1:] != group[:-1]
            where = np.flatnonzero(~alone)
            if not len(where):
                break
            own = order[where]
            then = np.where(own + step < self.n, rank[np.minimum(own + step, self.n - 1)], np.int32(-1))
            by = np.lexsort((then, group[where]))
            own, then, old = own[by], then[by], group[where][by]
            new = np.append(True, (old[1:] != old[:-1]) | (then[1:] != then[:-1]))
            order[where] = own
            group[where] = where[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
            rank[own] = group[where]
            step *= 2
        rows = np.zeros(self.n, self.kind)
        rows["at"] = order[::-1]
        for a in range(1, self.n, STEP):
            b = min(self.n, a + STEP)
            rows["lcp"][self.n - b + 1 : self.n - a + 1] = _common(self.text, self.n, order[a:b].astype(np.int64), order[a - 1 : b - 1].astype(np.int64), self.depth)[::-1]
        visit(rows)

    def visit(self, visit: Callable[[np.ndarray], None]) -> None:
        """Visits blocks of (at, lcp with the one visited before) from the largest suffix down."""
        if not self.n:
            return
        if self.last is not None and self.n <= max(8, self.budget // 32):
            self._in_memory(visit)
            return
        lms = self._sorted_lms() if self.count else Queues("", self.kind, 0)
        self._induce(lms, visit, True)
        lms.close()

    def close(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class Shard:
    """A text file of separated strings in a folder of its own, which goes with the shard."""

    def __init__(self, budget: int = 64 << 20):
        self.folder, self.budget, self.size = tempfile.mkdtemp(prefix="suffixes-"), budget, 0
        self.file = open(os.path.join(self.folder, "text"), "wb")  # noqa: SIM115

    def add(self, string: bytes) -> int:
        """The place of the string in the text."""
        at = self.size
        self.file.write(string + bytes([SEPARATOR]))
        self.size += len(string) + 1
        return at

    def repeated(self, depth: int) -> np.ndarray:
        """For each position whether a string of `depth` bytes starts there that starts elsewhere too, within strings."""
        self.file.write(bytes(8))
        self.file.close()
        out = _array(os.path.join(self.folder, "repeated"), np.bool_, self.size + 1)
        if not self.size:
            return out
        text = np.memmap(os.path.join(self.folder, "text"), np.uint8, "r+", shape=(self.size + 8,))
        last = -1

        def visit(rows: np.ndarray) -> None:
            nonlocal last
            at = rows["at"].astype(np.int64)
            hit = np.flatnonzero(rows["lcp"] >= depth)
            out[at[hit]] = True
            out[np.append(last, at[:-1])[hit]] = True
            last = int(at[-1])

        SuffixSorter(text, self.size, depth, os.path.join(self.folder, "sort"), self.budget).visit(visit)
        return out

    def close(self) -> None:
        self.file.close()
        shutil.rmtree(self.folder, ignore_errors=True)


def suffixes(text: bytes, depth: int, budget: int = 64 << 20) -> Iterator[tuple[int, int]]:
    """(position, common prefix with the larger neighbour) from the largest suffix down; for small texts and tests."""
    folder = tempfile.mkdtemp(prefix="suffixes-")
    try:
        got: list[tuple[int, int]] = []
        whole = np.frombuffer(text + bytes(8), np.uint8).copy()
        SuffixSorter(whole, len(text), depth, folder, budget).visit(lambda rows: got.extend(zip(rows["at"].tolist(), rows["lcp"].tolist(), strict=True)))
        yield from got
    finally:
        shutil.rmtree(folder, ignore_errors=True)
