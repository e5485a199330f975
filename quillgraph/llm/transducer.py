"""A byte-level BPE tokenizer compiled to deterministic finite-state transducers that count tokens.

Two machines in a row.  The *splitter* reads classes of characters and marks
where a piece of text ends; it has ``STATES`` states.  The *counter* reads the
bytes of one piece; each transition carries the change of the token count that
its byte brings, so a piece's sum is its number of tokens.

The counter rests on two facts of merging by rank: every prefix of a piece has
one last token, and a token may follow another only if merging the bytes of
both gives these two again.  A state is what the next byte may need: for every
suffix that begins a token, its place in the token trie, the token before it
(or another one that the same tokens may follow), and the count there.  States and transitions are made when text first asks for
them and kept in a table of ``ROOM`` rows; when it is full, only the states in
use are kept.

Text is read in windows of any length that carry the state of both machines,
so a text of any length takes the memory of one window.  Within a window the
splitter runs over chunks side by side: each chunk is summed up as a map from
entry state to exit state, the maps are composed by a parallel prefix scan, and
the scan gives every chunk the state it really starts in.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable, Iterator

import numpy as np

# Characters of a window, characters of a chunk, pieces that the counter takes side by side, rows of its table.
WINDOW = 1 << 19
CHUNK = 64
LANES = 1 << 14
ROOM = 1 << 16
# Below so many pieces still running, they are read one by one.
FEW = 48

# Classes of characters.
SPACE, BLANK, LETTER, NUMBER, OTHER, QUOTE, STMD, L, V, R, E, END = range(12)
# States of the splitter: what the open piece is.
START, ONE_SPACE, ONE_BLANK, RUN_SPACE, RUN_BLANK, LETTERS, NUMBERS, OTHERS, QUOTED, QUOTED_L, QUOTED_V, QUOTED_R, SHORT = range(13)
STATES = 13
# A piece begins at this character; a piece began at the one before.
HERE, BEFORE = 1, 2


def _opens(c: int) -> int:
    """The state after the first character of a piece."""
    return {SPACE: ONE_SPACE, BLANK: ONE_BLANK, NUMBER: NUMBERS, OTHER: OTHERS, QUOTE: QUOTED, END: START}.get(c, LETTERS)


def _splits(state: int, c: int) -> tuple[int, int]:
    """Next state and marks of one transition of the splitter."""
    letter, word, blank = STMD <= c <= E or c == LETTER, c not in (SPACE, BLANK, END), c in (SPACE, BLANK)
    joined = LETTERS if letter else NUMBERS if c == NUMBER else OTHERS
    same = {LETTERS: letter, NUMBERS: c == NUMBER, OTHERS: c in (OTHER, QUOTE)}
    ends = {QUOTED_L: L, QUOTED_V: E, QUOTED_R: E}
    if state in same and same[state]:
        return state, 0
    if state in (ONE_SPACE, ONE_BLANK, RUN_SPACE, RUN_BLANK) and blank:
        return RUN_SPACE if c == SPACE else RUN_BLANK, 0
    if state == ONE_SPACE and word:
        return joined, 0
    if state == RUN_SPACE and word:  # the last space goes with the word
        return joined, BEFORE
    if state == RUN_BLANK and word:  # the last blank is a piece
        return _opens(c), BEFORE | HERE
    if state == QUOTED:
        if c in (STMD, L, V, R):
            return {STMD: SHORT, L: QUOTED_L, V: QUOTED_V, R: QUOTED_R}[c], 0
        if c in (OTHER, QUOTE):
            return OTHERS, 0
    if state in ends:
        if c == ends[state]:
            return SHORT, 0
        return (LETTERS, BEFORE) if letter else (_opens(c), BEFORE | HERE)  # no short form: the quote stood alone
    return _opens(c), HERE


_PAIRS = [_splits(s, c) for c in range(12) for s in range(STATES)]
NEXT = np.array([p[0] for p in _PAIRS], np.uint8)
MARKS = np.array([p[1] for p in _PAIRS], np.uint8)


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Maps of states, one a row: ``first`` and after it ``then``."""
    return np.take_along_axis(then, first, 1)


def prefix_maps(maps: np.ndarray) -> np.ndarray:
    """Row i: the composition of rows 0 to i, in a logarithmic number of rounds."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = compose(maps[:-step], maps[step:])
        step *= 2
    return maps


def split(classes: np.ndarray, entry: int, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """For every character the splitter's state before it, and the marks of its transition."""
    n = len(classes)
    rows = -(-n // chunk)
    padded = np.zeros(rows * chunk, np.int64)
    padded[:n] = classes
    columns = np.ascontiguousarray(padded.reshape(rows, chunk).T) * STATES
    maps = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (rows, STATES))
    for column in columns:
        maps = NEXT[column[:, None] + maps]
    state = np.empty(rows, np.uint8)
    state[0] = entry
    if rows > 1:
        state[1:] = prefix_maps(maps[:-1])[:, entry]
    before, marks = np.empty((chunk, rows), np.uint8), np.empty((chunk, rows), np.uint8)
    for i, column in enumerate(columns):
        before[i] = state
        at = column + state
        marks[i] = MARKS[at]
        state = NEXT[at]
    return before.T.reshape(-1)[:n], marks.T.reshape(-1)[:n]


class Counter:
    """The lazily determinised counting transducer of one list of merges."""

    def __init__(self, merges: list[tuple[bytes, bytes]], room: int = ROOM):
        self.room = room
        ids = {bytes([b]): b for b in range(256)}
        self.parts: list[tuple[int, int] | None] = [None] * 256
        self.rank: dict[tuple[int, int], int] = {}
        for a, b in merges:
            pair = ids[a], ids[b]
            self.rank.setdefault(pair, len(self.rank))
            if a + b not in ids:
                ids[a + b] = len(self.parts)
                self.parts.append(pair)
        self.trie: dict[int, int] = {}
        self.token, self.inner = [-1], [True]
        for text, token in ids.items():
            node = 0
            for byte in text:
                self.inner[node] = True
                key = node << 8 | byte
                node = self.trie.get(key, -1)
                if node < 0:
                    node = self.trie[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
            self.token[node] = token
        self.edges: tuple[dict, dict] = {}, {}
        self.follows: dict[tuple[int, int], bool] = {}
        self.alike: dict[tuple, int | None] = {}
        self.meets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.allowed = functools.lru_cache(512)(self._allowed)
        self._order(ids)
        self._clear()

    def _order(self, ids: dict[bytes, int]) -> None:
        """Tokens in byte order, so that those below a node of the trie are a range."""
        texts = sorted(ids)
        self.place = {ids[text]: i for i, text in enumerate(texts)}
        self.below = [(0, 0)] * len(self.token)
        for i, text in enumerate(texts):
            node = 0
            for byte in text:
                first, last = self.below[node]
                self.below[node] = (first if last else i, i + 1)
                node = self.trie[node << 8 | byte]
        self.whole = np.array([self.may_follow(-1, ids[text]) for text in texts])
        # For every symbol: tokens at whose left edge it stands, and the rank at which it merges there.
        self.heads: dict[int, list[tuple[int, int]]] = {}
        for i, text in enumerate(texts):
            edge = self._edge(ids[text], 0)
            for j, (symbol, _) in enumerate(edge):
                self.heads.setdefault(symbol, []).append((i, edge[j + 1][1] if j + 1 < len(edge) else len(self.rank)))
        self.partners: dict[int, list[tuple[int, int]]] = {}
        for (a, b), rank in self.rank.items():
            self.partners.setdefault(a, []).append((rank, b))

    def _meets(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranks, rising, at which ``symbol`` merges with the left edge of a token, and that token's place."""
        found = self.meets.get(symbol)
        if found is None:
            pairs = [(rank, i) for rank, b in self.partners.get(symbol, ()) for i, ends in self.heads.get(b, ()) if rank <= ends]
            both = np.array(sorted(pairs), np.int32).reshape(-1, 2)
            found = self.meets[symbol] = both[:, 0].copy(), both[:, 1].copy()
        return found

    def _allowed(self, before: int) -> np.ndarray:
        """For every token in byte order: whether it may follow ``before``."""
        may = self.whole.copy()
        edge = self._edge(before, 1) if before >= 0 else []
        for i, (symbol, _) in enumerate(edge):
            ranks, places = self._meets(symbol)
            until = edge[i + 1][1] if i + 1 < len(edge) else len(self.rank)
            may[places[: np.searchsorted(ranks, until)]] = False
        return may

    def _same(self, child: int, before: int) -> int | None:
        """A token that stands for ``before`` at this node, as the same tokens may follow both; None if none may."""
        key = child, before
        if key not in self.alike:
            first, last = self.below[child]
            may = self.allowed(before)[first:last]
            if len(self.alike) > 8 * self.room:
                self.alike.clear()
            self.alike[key] = self.alike.setdefault((child, np.packbits(may).tobytes()), before) if may.any() else None
        return self.alike[key]

    def _clear(self) -> None:
        self.table = np.full(self.room * 256, -1, np.int32)
        self.states: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        self.intern(self.start)

    # At the start of a piece: the trie's root, no token before it, count 0.
    start = ((0, -1, 0),)

    def intern(self, state: tuple) -> int:
        found = self.ids.get(state)
        if found is None:
            found = self.ids[state] = len(self.states)
            self.states.append(state)
        return found

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols that stand at one edge of ``token`` while it is merged, each with the rank that makes it."""
        if (known := self.edges[side].get(token)) is not None:
            return known
        found, whole = [], token
        while (pair := self.parts[token]) is not None:
            found.append((token, self.rank[pair]))
            token = pair[side]
        self.edges[side][whole] = found = [(token, -1), *reversed(found)]
        return found

    def _apart(self, a: int, b: int, until: int) -> bool:
        """No merge across the edge of ``a`` and ``b`` comes before both are whole and rank ``until``."""
        left, right = self._edge(a, 1), self._edge(b, 0)
        i = j = 0
        never = len(self.rank)
        while True:
            next_left = left[i + 1][1] if i + 1 < len(left) else never
            next_right = right[j + 1][1] if j + 1 < len(right) else never
            cross = self.rank.get((left[i][0], right[j][0]), never)
            if next_left == next_right == never:
                return cross >= until
            # Of equal ranks the leftmost pair merges first.
            if cross < next_left and cross <= next_right:
                return False
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def may_follow(self, before: int, token: int) -> bool:
        """Merging ``before`` and ``token`` (or ``token`` alone) gives just these tokens."""
        key = before, token
        found = self.follows.get(key)
        if found is None:
            pair = self.parts[token]
            whole = pair is None or (self.may_follow(-1, pair[0]) and self.may_follow(-1, pair[1]) and self._apart(*pair, self.rank[pair]))
            found = self.follows[key] = whole and (before < 0 or self._apart(before, token, len(self.rank)))
            if len(self.follows) > 16 * self.room:
                self.follows.clear()
        return found

    def step(self, state: int, byte: int) -> int:
        """Make one transition: the next state and, in the low byte, 128 more than the change of the count."""
        live, last, count = [], -1, 0
        for node, before, there in self.states[state]:
            child = self.trie.get(node << 8 | byte, -1)
            if child < 0:
                continue
            token = self.token[child]
            if token >= 0 and last < 0 and self.may_follow(before, token):
                last, count = token, there + 1
            if self.inner[child] and (same := self._same(child, before)) is not None:
                live.append((child, same, there))
        after = *((node, before, there - count) for node, before, there in live), (0, last, 0)
        value = self.intern(after) << 8 | (count + 128)
        self.table[state << 8 | byte] = value
        return value

    def _tidy(self, used: np.ndarray) -> np.ndarray:
        """Forget all states but those in ``used``; their new numbers."""
        distinct, where = np.unique(used, return_inverse=True)
        kept = [self.states[s] for s in distinct.tolist()]
        self._clear()
        return np.array([self.intern(s) for s in kept], np.int64)[where]

    def run(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, entry: tuple) -> tuple[np.ndarray, tuple]:
        """The count of every piece of ``data``, the first one read from ``entry``; the state after the last one.

        An empty piece counts 0 and leaves its entry state.
        """
        counts, after = np.zeros(len(starts), np.int64), self.start
        for at in range(0, len(starts), LANES):
            lanes = slice(at, at + LANES)
            counts[lanes], after = self._lanes(data, starts[lanes], lengths[lanes], entry if at == 0 else self.start)
        return counts, after

    def _lanes(self, data, starts, lengths, entry):
        n = len(starts)
        if len(self.states) + n + 2 > self.room:
            self._clear()
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        state, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
        state[np.flatnonzero(order == 0)] = self.intern(entry)
        place = starts[order]
        running = np.searchsorted(-sizes, -np.arange(int(sizes[0]) + 1), side="left")  # lanes longer than k
        for k in range(int(sizes[0])):
            m = int(running[k])
            if m <= FEW:
                for lane in range(m):
                    state, total = self._alone(data, state, total, lane, place[lane] + k, place[lane] + sizes[lane])
                break
            key = state[:m] << 8 | data[place[:m] + k]
            value = self.table[key]
            missing = value < 0
            if missing.any():
                asked = np.unique(key[missing])
                if len(self.states) + len(asked) > self.room:
                    state = self._tidy(state)
                    key = state[:m] << 8 | data[place[:m] + k]
                    asked = np.unique(key)
                for one in asked.tolist():
                    if self.table[one] < 0:
                        self.step(one >> 8, one & 255)
                value = self.table[key]
            state[:m] = value >> 8
            total[:m] += (value & 255) - 128
        counts = np.empty(n, np.int64)
        counts[order] = total
        return counts, self.states[int(state[np.flatnonzero(order == n - 1)[0]])]

    def _alone(self, data, state, total, lane, begin, end):
        """One lane to its end, in plain steps."""
        now, change = int(state[lane]), 0
        table = self.table
        for byte in data[begin:end].tolist():
            value = int(table[now << 8 | byte])
            if value < 0:
                if len(self.states) + 1 > self.room:
                    state[lane] = now
                    state = self._tidy(state)
                    now, table = int(state[lane]), self.table
                value = self.step(now, byte)
            now = value >> 8
            change += (value & 255) - 128
        state[lane] = now
        total[lane] += change
        return state, total


def _byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """The compiled tokenizer of a ``.json`` file of the ``tokenizers`` library: byte-level BPE, nothing else."""

    def __init__(self, path: str, room: int = ROOM):
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model, before = described["model"], described["pre_tokenizer"] or {}
        plain = not described["normalizer"] and not model.get("ignore_merges") and not model.get("dropout")
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or not plain:
            raise ValueError(f"{path}: not a plain byte-level BPE tokenizer")
        added = described["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path}: an added token that takes more than its own string")
        # The library takes the leftmost of them, and of those that begin there the longest.
        self.special = sorted((t["content"] for t in added), key=lambda s: (-len(s), s))
        letters = _byte_letters()
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.counter = Counter([tuple(bytes(letters[c] for c in side) for side in pair) for pair in pairs], room)
        self.splitter = ByteLevel(add_prefix_space=False, use_regex=True)
        self.classes = np.full(0x110000, 255, np.uint8)
        for name, chars in ((SPACE, " "), (QUOTE, "'"), (STMD, "stmd"), (L, "l"), (V, "v"), (R, "r"), (E, "e")):
            self.classes[[ord(c) for c in chars]] = name

    def _class(self, char: str) -> int:
        """The class that the library sees in a character, from where it splits around it."""
        first = lambda text: self.splitter.pre_tokenize_str(text)[0][1][1]
        if first("a" + char) == 2:
            return LETTER
        if first("1" + char) == 2:
            return NUMBER
        return OTHER if first("." + char) == 2 else BLANK

    def classify(self, points: np.ndarray) -> np.ndarray:
        found = self.classes[points]
        for point in np.unique(points[found == 255]).tolist():
            self.classes[point] = self._class(chr(point))
        return self.classes[points]

    def segments(self, text: str) -> tuple[list[str], int]:
        """The text between special tokens, and how many of them there are."""
        parts, n = [text], 0
        if any(s in text for s in self.special):
            import re

            parts = re.split("|".join(map(re.escape, self.special)), text)
            n = len(parts) - 1
        return parts, n

    def counts(self, texts: Iterable[str], window: int = WINDOW) -> Iterator[int]:
        """The number of tokens of each text, in order."""
        # What goes from one window to the next: the character held back, the splitter's state before it and the counter's.
        held, entry, inside = "", START, self.counter.start
        pending: list[int] = []  # counts of texts whose end is not read yet
        pieces: list[str] = [held]
        ends: list[tuple[int, bool]] = []  # places of END, and whether the text ends there
        size = 0

        def flush():
            nonlocal held, entry, inside, size
            joined = "".join(pieces)
            points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
            classes = self.classify(points)
            places = np.array([p for p, _ in ends], np.int64)
            classes[places] = END
            before, marks = split(classes, entry)
            n = len(points) - 1  # the last character waits for what follows it
            begins = (marks & HERE) > 0
            begins[:-1] |= (marks[1:] & BEFORE) > 0
            begins = np.flatnonzero(begins[:n])
            if not len(begins) or begins[0]:
                begins = np.concatenate([[0], begins])  # the piece that is open; empty if n is 0
            else:
                inside = self.counter.start
            widths = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
            offsets = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])
            stops = np.append(begins[1:], n)
            lengths = offsets[stops] - offsets[begins]
            if n:
                lengths[classes[begins] == END] = 0
            data = np.frombuffer(joined.encode("utf-8"), np.uint8)
            found, inside = self.counter.run(data, offsets[begins], lengths, inside)
            closing = np.array([p for p, last in ends if last], np.int64)
            owners = np.searchsorted(closing, begins, side="left")
            sums = np.bincount(owners, found, len(closing) + 1).astype(np.int64)
            for i, value in enumerate(sums.tolist()):
                if i < len(pending):
                    pending[i] += value
            done = len(closing)
            held, entry = joined[-1], int(before[-1])
            still = ends and ends[-1][0] == n
            pieces[:] = [held]
            ends[:] = [(0, ends[-1][1])] if still else []
            size = 1
            if still and ends[0][1]:
                done -= 1  # counted again when the next window is read
            out = pending[:done]
            del pending[:done]
            return out

        for text in texts:
            parts, specials = self.segments(text)
            pending.append(specials)
            for number, part in enumerate(parts):
                for at in range(0, len(part), window):
                    slice_ = part[at : at + window]
                    pieces.append(slice_)
                    size += len(slice_)
                    if size >= window:
                        yield from flush()
                pieces.append("\n")
                ends.append((size, number == len(parts) - 1))
                size += 1
            if size >= window:
                yield from flush()
        if ends:
            pieces.append("\n")
            ends.append((size, False))
            size += 1
            yield from flush()


@functools.cache
def compiled(path: str) -> Tokenizer:
    """One tokenizer for each worker process."""
    return Tokenizer(path)
