"""SentencePiece encoding and decoding with sampled segmentations.

A text's segmentations into vocabulary pieces are the paths of a lattice. The k of largest Gumbel noise
are k distinct segmentations drawn one after another without replacement (Kool et al. 2019). The search
for them goes from the top: the noisy value of a node is the Gumbel maximum of all paths through it, and
those of the edges not taken are independent under the bound of the edge taken. So the largest of all of
them is one draw of their joint mass, and it lies at each of them in proportion to its mass: no edge needs
noise of its own. A next way is drawn from all ways; only if that repeats one (few segmentations) is it
drawn from the edges off the ways there are. The (k+1)-th bound gives each drawn path its inclusion score.

The lattice is per word (no piece crosses the white space mark inside), so its nodes are remembered by
word, and the words of all texts of a batch are walked in lockstep. The noise of a node is a hash of the
row's key, the draw, the word and the node's place on the way, so that no row depends on its batch.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgework.llm.common import mix64, slices, table, tidied

MARK = "▁"
WORD = re.compile(f"{MARK}+[^{MARK}]*")


@dataclass(frozen=True)
class Settings:
    """A piece weighs by its rank in the vocabulary, to the power of ``temperature`` (smaller: more varied)."""

    samples: int = 3
    temperature: float = 0.3
    rank_shift: float = 10.0


def escaped(text: str) -> str:
    """The text without marks of its own: they and NULs are written as two characters."""
    return text.replace("\0", "\0\0").replace(MARK, "\0_")


def uniform(key: np.ndarray) -> np.ndarray:
    """Numbers from 0 to below 1 by hash: equal keys, equal numbers."""
    return (mix64(key) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def gumbel(key: np.ndarray) -> np.ndarray:
    """Standard Gumbel noise by hash."""
    return -np.log(-np.log(uniform(key) + 2.0**-54))


GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def keyed(key: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    return mix64(key + GOLDEN * np.atleast_1d(np.asarray(n, np.uint64) + np.uint64(1)))


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of ranges, one range after another."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


class Grown:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.all, self.n = np.empty(1 << 16, dtype), 0

    def add(self, more: np.ndarray) -> None:
        to = self.n + len(more)
        if to > len(self.all):
            self.all = np.concatenate((self.all[: self.n], np.empty(max(to, 2 * self.n) - self.n, self.all.dtype)))
        self.all[self.n : to] = more
        self.n = to


class Numbers(dict):
    """Numbers of words in the order they are met."""

    def of(self, words: list[str]) -> tuple[np.ndarray, list[str]]:
        """The numbers of different words, and those words that are new."""
        found = np.fromiter(map(self.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(found < 0)
        new = [words[i] for i in at.tolist()]
        found[at] = numbers = np.arange(len(self), len(self) + len(new))
        self.update(zip(new, numbers.tolist(), strict=True))
        return found, new


class Prefixes:
    """The pieces' prefix tree as a hash table of (state, letter), for walks of many places at once.

    Letters are the numbers of the pieces' characters; 0 is any other character, which no state goes on with.
    """

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        steps: dict[tuple[int, int], int] = {}
        self.letter = np.zeros(0x110000, np.int64)
        seen = sorted({ord(ch) for text in pieces for ch in text})
        self.letter[seen] = np.arange(1, len(seen) + 1)
        letters, self.width = dict(zip(map(chr, seen), range(1, len(seen) + 1), strict=True)), len(seen) + 1
        piece, p = [-1], [0.0]
        for text, (i, log) in pieces.items():
            state = 0
            for ch in map(letters.__getitem__, text):
                if (state, ch) not in steps:
                    steps[state, ch] = len(piece)
                    piece.append(-1)
                    p.append(0.0)
                state = steps[state, ch]
            piece[state], p[state] = i, math.exp(log)
        self.piece, self.p = np.array(piece, np.int32), np.array(p)
        bits = (8 * len(steps)).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.next = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int32)
        keys = np.array([state * self.width + ch for state, ch in steps], np.int64)
        for key, at, to in zip(keys.tolist(), self.slot(keys).tolist(), steps.values(), strict=True):
            while self.key[at] >= 0:
                at = (at + 1) & self.mask
            self.key[at], self.next[at] = key, to

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * GOLDEN) >> self.shift).view(np.int64)

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The next states; -1 where there is none."""
        key = state * np.int64(self.width) + letter
        at = self.slot(key)
        found = self.key[at]
        hit = found == key
        out = np.where(hit, self.next[at], np.int32(-1))
        open_ = np.flatnonzero(~hit & (found >= 0))
        while len(open_):
            at[open_] = now = (at[open_] + 1) & self.mask
            found = self.key[now]
            hit = found == key[open_]
            out[open_[hit]] = self.next[now[hit]]
            open_ = open_[~hit & (found >= 0)]
        return out


class Lattice:
    """Nodes are places in words, numbered as words are met; the edges of a node follow one another.

    Of each edge: its share of its node's mass (2 for the last one, which takes what is left), the node
    it leads to (-1: the word's end) and its piece. A node's mass is the log sum of all its completions.
    """

    #: edges that are kept, words whose own encodings are, and the longest word whose nodes are made with others'
    EDGES, WORDS, LONG = 5_000_000, 200_000, 32

    def __init__(self, path: str, settings: Settings):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.settings = settings
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.raw = [m.id_to_piece(i).encode() for i in range(m.get_piece_size())]
        for b, i in enumerate(self.bytes):
            self.raw[i] = bytes([b])
        self.spellings = pa.array(self.raw, pa.binary())
        self.renew()
        self.renew_encoded()

    @cached_property
    def pieces(self) -> dict[str, tuple[int, float]]:
        """Of each piece its id and its log probability."""
        m, s = self.model, self.settings
        ids = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        ids.sort(key=lambda i: (-m.get_score(i), i))
        log = -np.log(np.arange(len(ids)) + s.rank_shift)
        log = s.temperature * (log - np.log(np.exp(log).sum()))
        return {m.id_to_piece(i): (i, float(p)) for i, p in zip(ids, log, strict=True)}

    @cached_property
    def rare(self) -> float:
        return min(p for _, p in self.pieces.values()) - 1

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.pieces))

    @cached_property
    def tree(self) -> Prefixes:
        return Prefixes(self.pieces)

    @cached_property
    def known_logs(self) -> np.ndarray:
        log = np.zeros(len(self.raw))
        for i, p in self.pieces.values():
            log[i] = p
        return log

    def renew(self) -> None:
        self.first, self.start, self.mass = Grown(np.int64), Grown(np.int32), Grown(np.float64)
        self.share, self.target, self.piece = Grown(np.float64), Grown(np.int32), Grown(np.int32)
        self.forget()

    def renew_encoded(self) -> None:
        self.own_size, self.own = Grown(np.int64), Grown(np.int32)
        self.forget_encoded()

    def forget(self) -> None:
        self.known = Numbers()
        self.spelled: dict[str, int] = {}  # characters in bytes are pieces of their own, beyond the vocabulary
        self.runs: list[tuple[int, ...]] = []
        for x in (self.first, self.start, self.mass, self.share, self.target, self.piece):
            x.n = 0

    def forget_encoded(self) -> None:
        self.encoded = Numbers()
        self.own_size.n = self.own.n = 0

    def spell(self, ch: str) -> int:
        """The piece of a character that is spelled in bytes."""
        if ch not in self.spelled:
            self.spelled[ch] = len(self.raw) + len(self.runs)
            self.runs.append(tuple(self.bytes[b] for b in ch.encode("utf-8", "surrogatepass")))
        return self.spelled[ch]

    def logs(self) -> np.ndarray:
        """The log probabilities of all pieces."""
        return np.concatenate((self.known_logs, [self.rare * len(r) for r in self.runs])) if self.runs else self.known_logs

    def add(self, word: str) -> int:
        """Add the nodes of a word; returns its first."""
        n, find, exp = len(word), self.pieces.get, math.exp
        base = self.mass.n
        mass, edges = [0.0] * (n + 1), [[]] * n
        for i in range(n - 1, -1, -1):
            out = []
            for j in range(i + 1, min(n, i + self.longest) + 1):
                if (hit := find(word[i:j])) is not None:
                    out.append((hit[1] + mass[j], j, hit[0]))
            if word[i] not in self.pieces:
                code = self.spell(word[i])
                out.append((self.rare * len(self.runs[code - len(self.raw)]) + mass[i + 1], i + 1, code))
            top = max(out)[0]
            mass[i] = top if len(out) == 1 else top + math.log(sum([exp(x[0] - top) for x in out]))
            edges[i] = out
        count = np.fromiter(map(len, edges), np.int64, n)
        onward, target, piece = (np.array(x) for x in zip(*chain.from_iterable(edges), strict=True))
        self.hold(np.array(mass[:n]), count, np.exp(onward - np.repeat(mass[:n], count)), np.where(target < n, base + target, -1), piece)
        return base

    def hold(self, mass: np.ndarray, count: np.ndarray, share: np.ndarray, target: np.ndarray, piece: np.ndarray) -> None:
        """Append nodes and their edges."""
        ends = np.cumsum(count)
        share[ends - 1] = 2.0
        self.start.add(self.piece.n + ends - count)
        self.mass.add(mass)
        self.share.add(share)
        self.target.add(target)
        self.piece.add(piece)

    def add_all(self, words: list[str]) -> None:
        """Add new words, all their nodes at once: edges by a walk of all places down the prefix tree, masses from the words' ends.

        Places are ordered by how far they are from their word's end, then by word (longest first), so
        that those of one distance and their edges follow one another.
        """
        size = np.fromiter(map(len, words), np.int64, len(words))
        first = np.zeros(len(words), np.int64)
        for i in np.flatnonzero(size > self.LONG).tolist():
            first[i] = self.add(words[i])
        order = np.flatnonzero(size <= self.LONG)
        if len(order):
            order = order[np.argsort((self.LONG - size[order]).astype(np.uint8), kind="stable")]
            size = size[order]
            first[order] = self.add_short([words[i] for i in order.tolist()], size)
        self.first.add(first)

    def add_short(self, words: list[str], size: np.ndarray) -> np.ndarray:
        """``add_all`` of words by falling size; returns the first node of each."""
        n, most = len(words), int(size[0])
        chars = np.array(words, f"U{most}").view(np.uint32).reshape(n, most)
        many = n - np.searchsorted(size[::-1], np.arange(most + 1))  # words at least so long
        begin = np.cumsum(many) - many  # the first place of each distance
        codes, tree = np.zeros(int(many.sum()), np.int64), self.tree
        for r in range(1, most + 1):
            codes[begin[r] : begin[r] + many[r]] = chars[np.arange(many[r]), size[: many[r]] - r]
        letter = tree.letter[codes]
        letter[:n] = 0
        down = np.arange(len(codes)) - np.repeat(np.append(0, many[:-1]), many)  # the place of the next character
        at = cur = np.arange(n, len(codes))
        state = np.zeros(len(at), np.int32)
        count, found, alone = np.zeros(len(codes), np.int64), [], None
        while len(at):
            state = tree.step(state, letter[cur])
            on = np.flatnonzero(state >= 0)
            at, state, cur = at[on], state[on], down[cur[on]]
            hit = np.flatnonzero(tree.piece[state] >= 0)
            place = at[hit]
            found.append((place, count[place], state[hit], cur[hit]))
            count[place] += 1
            if alone is None:  # characters that are no piece are spelled in bytes
                alone = n + np.flatnonzero(count[n:] == 0)
                count[alone] = 1
        start = np.cumsum(count) - count
        piece, p, to = np.empty(int(count.sum()), np.int32), np.empty(int(count.sum())), np.empty(int(count.sum()), np.int64)
        for place, nth, state, end in found:
            e = start[place] + nth
            piece[e], p[e], to[e] = tree.piece[state], tree.p[state], end
        if len(alone):
            chs, which = np.unique(codes[alone], return_inverse=True)
            spelled = np.array([self.spell(chr(c)) for c in chs.tolist()], np.int64)
            e = start[alone]
            piece[e], to[e] = spelled[which], down[alone]
            p[e] = np.exp(self.logs()[spelled])[which]
        mass = np.ones(len(codes))
        cut = np.append(start[begin], len(piece)).tolist()
        for r in range(1, most + 1):
            lo, hi, a, b = cut[r], cut[r + 1], int(begin[r]), int(begin[r] + many[r])
            p[lo:hi] *= mass[to[lo:hi]]
            mass[a:b] = np.add.reduceat(p[lo:hi], start[a:b] - lo)
        base = self.mass.n - n
        self.hold(np.log(mass[n:]), count[n:], p / np.repeat(mass, count), np.where(to >= n, base + to, -1), piece)
        return base + begin[size] + np.arange(n)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The model's own encodings, one after another, and the size of each: no piece crosses a word's beginning, so each word is encoded once."""
        words, which, count = self.split(texts)
        if len(self.encoded) > self.WORDS:
            self.forget_encoded()
        number, new = self.encoded.of(words)
        number = number[which]
        if new:
            ids = self.model.encode([w[1:].replace(MARK, " ") for w in new], num_threads=1)
            if MARK in new:
                ids[new.index(MARK)] = [self.model.piece_to_id(MARK)]
            self.own_size.add(np.fromiter(map(len, ids), np.int64, len(ids)))
            self.own.add(np.fromiter(chain.from_iterable(ids), np.int32))
        size = self.own_size.all[: self.own_size.n]
        start, size = (np.cumsum(size) - size)[number], size[number]
        ends = np.append(0, np.cumsum(size))
        last = np.cumsum(count)
        return self.own.all[spread(start, size)], np.diff(ends[last], prepend=0)

    def words(self, text: str) -> list[str]:
        """The text with a leading mark and marks for spaces; a mark in the text itself is written as a NUL-framed escape."""
        return WORD.findall(MARK + escaped(text).replace(" ", MARK))

    def split(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """``words`` of many texts: the different ones, which of them each word is, and how many each text has."""
        runs = [i for i, t in enumerate(texts) if t[:1] == " " or "  " in t]  # of spaces: their words have several marks
        single = [escaped(t) or None for t in texts]
        for i in runs:
            single[i] = None
        parted = pc.split_pattern(pa.array(single, pa.string()), " ")
        coded = parted.flatten().dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        count = pc.fill_null(pc.list_value_length(parted), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        held = pa.LargeListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int64()), coded.dictionary)
        words = (MARK + pc.binary_join(held, " " + MARK)[0].as_py()).split(" ") if len(coded.dictionary) else []
        if runs:
            number = {w: n for n, w in enumerate(words)}
            each = np.split(which, np.cumsum(count)[:-1])
            for i in runs:
                each[i] = np.array([number.setdefault(w, len(number)) for w in self.words(texts[i])], np.int64)
                count[i] = len(each[i])
            which, words = np.concatenate(each), list(number)
        return words, which, count

    def decode_all(self, ids: np.ndarray, size: np.ndarray) -> list[str]:
        """The texts of encodings that follow one another, ``size`` ids each."""
        spelled = self.spellings.take(pa.array(ids, pa.int32()))
        _, at, data = spelled.buffers()
        cut = np.frombuffer(at, np.int32)[spelled.offset :][np.append(0, np.cumsum(size))].tolist()
        data = memoryview(data) if data else memoryview(b"")
        return [self.shown(str(data[a:b], "utf-8", "surrogatepass")) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def shown(self, text: str) -> str:
        """A text as it was before ``words``."""
        text = text[1:].replace(MARK, " ")
        return re.sub("\0([_\0])", lambda m: MARK if m[1] == "_" else "\0", text) if "\0" in text else text

    def walk(self, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A way from each node to its word's end, each edge in proportion to its mass: pieces one after another, and their numbers."""
        start, share, target, piece = self.start.all, self.share.all, self.target.all, self.piece.all
        size, taken, lane = np.zeros(len(node), np.int64), [], np.arange(len(node))
        while len(lane):
            size[lane] += 1
            key = key + GOLDEN
            edge, left = start[node], uniform(key)
            own = share[edge]
            more = np.flatnonzero(left >= own)
            left = left[more] - own[more]
            while len(more):
                edge[more] = e = edge[more] + 1
                own = share[e]
                on = np.flatnonzero(left >= own)
                more, left = more[on], left[on] - own[on]
            taken.append((lane, piece[edge]))
            node = target[edge]
            go = np.flatnonzero(node >= 0)
            lane, node, key = lane[go], node[go], key[go]
        out, at = np.empty(int(size.sum()), np.int32), np.cumsum(size) - size
        for depth, (lane, found) in enumerate(taken):
            out[at[lane] + depth] = found
        return out, size

    def off(self, roots: list[int], ways: list[list[int]]) -> list[tuple[float, int, int, int, int]]:
        """The edges that lead off some ways of a text: log mass, a way and how many of its pieces come before, the word, the edge."""
        start, mass, share, target, piece, logs = self.start.all, self.mass.all, self.share.all, self.target.all, self.piece.all, self.logs()
        out, groups = [], [(list(range(len(ways))), 0, 0, roots[0], 0.0)]
        while groups:
            who, depth, word, node, before = groups.pop()
            goes: dict[int, list[int]] = {}
            for i in who:
                goes.setdefault(ways[i][depth], []).append(i)
            edge = int(start[node])
            while True:
                code, to = int(piece[edge]), int(target[edge])
                log_p = before + float(logs[code] - mass[node] + (mass[to] if to >= 0 else 0.0))
                if code not in goes:
                    out.append((log_p, who[0], depth, word, edge))
                elif to >= 0:
                    groups.append((goes[code], depth + 1, word, to, log_p))
                elif word + 1 < len(roots):
                    groups.append((goes[code], depth + 1, word + 1, roots[word + 1], log_p))
                if share[edge] > 1:
                    break
                edge += 1
        return out

    def few(self, roots: np.ndarray, key: np.ndarray, fresh: list[list[int]]) -> tuple[list[list[int]], list[float], list[float]]:
        """Ways of a text drawn one after another, those of ``fresh`` as long as none repeats: ways, their log probabilities, log masses of all others after each draw."""
        logs, ways, found, rest = self.logs(), [], [], []
        roots_ = roots.tolist()
        for draw, way in enumerate(fresh, 1):
            if way in ways:
                open_ = self.off(roots_, ways)
                if not open_:
                    break
                share = np.exp(np.array([x[0] for x in open_]) - max(x[0] for x in open_))
                mine = keyed(key, draw + (1 << 32))
                at = int(np.searchsorted(np.cumsum(share), uniform(mine)[0] * share.sum(), side="right"))
                _, of, depth, word, edge = open_[min(at, len(open_) - 1)]
                to = int(self.target.all[edge])
                onward = np.array([to] * (to >= 0) + roots_[word + 1 :], np.int64)
                tail, _ = self.walk(onward, keyed(mine, np.arange(len(onward))))
                way = [*ways[of][:depth], int(self.piece.all[edge]), *tail.tolist()]
            ways.append(way)
            found.append(float(logs[way].sum() - self.mass.all[roots].sum()))
            drawn = math.fsum(map(math.exp, found))
            if drawn < 0.5:
                rest.append(math.log1p(-drawn))
            else:  # summed from the edges, as a difference would lose a small rest
                masses = [x[0] for x in self.off(roots_, ways)]
                rest.append(float(np.logaddexp.reduce(masses)) if masses else -math.inf)
        return ways, found, rest

    def draw(self, texts: list[str], seeds: list[int], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Up to k distinct segmentations of each text, by falling Gumbel value.

        Returns of each its text, its number (from 1), log probability, log inclusion score and how
        many ids it has, then the ids of all, one after another.
        """
        if self.piece.n > self.EDGES:
            self.forget()
        words, which, count = self.split(texts)
        number, new = self.known.of(words)
        if new:
            self.add_all(new)
        n, begin, total = len(texts), np.cumsum(count) - count, len(which)
        roots, key = self.first.all[number[which]], np.array([s % (1 << 64) for s in seeds], np.uint64)
        text = np.repeat(np.arange(n), count)
        nth = np.arange(total) - begin[text]
        pieces, size = self.walk(np.tile(roots, k), np.concatenate([keyed(keyed(key, d)[text], nth) for d in range(1, k + 1)]))
        ends = np.append(0, np.cumsum(size))
        # log probabilities are summed for each text alone, so that they don't depend on the batch
        logs = self.logs()
        lane_p = np.add.reduceat(logs[pieces], ends[:-1]) - np.tile(self.mass.all[roots], k) if total else np.zeros(0)
        row = (np.repeat(np.arange(k) * n, total) + np.tile(text, k)).astype(np.int64)
        log_p = np.bincount(row, lane_p, minlength=k * n).astype(np.float64).reshape(k, n)
        lo = ends[begin + total * np.arange(k)[:, None]]
        many = ends[begin + count + total * np.arange(k)[:, None]] - lo
        there = np.ones((k, n), bool)
        there[1:, count == 0] = False
        drawn = np.cumsum(np.exp(log_p), 0)
        with np.errstate(all="ignore"):
            rest = np.log1p(-drawn)
        odd = (drawn[-1] >= 0.5) & (count > 0)
        for a in range(k):
            for b in range(a + 1, k):
                same = np.flatnonzero((log_p[a] == log_p[b]) & (many[a] == many[b]) & ~odd & (count > 0))
                for i in same.tolist():
                    odd[i] = np.array_equal(pieces[lo[a, i] : lo[a, i] + many[a, i]], pieces[lo[b, i] : lo[b, i] + many[b, i]])
        more, past = [pieces], len(pieces)
        for i in np.flatnonzero(odd).tolist():
            fresh = [pieces[lo[d, i] : lo[d, i] + many[d, i]].tolist() for d in range(k)]
            ways, found, left = self.few(roots[begin[i] : begin[i] + count[i]], key[i : i + 1], fresh)
            there[len(ways) :, i] = False
            rest[-1, i] = -np.inf
            for d, (way, p, r) in enumerate(zip(ways, found, left, strict=True)):
                more.append(np.array(way, np.int32))
                lo[d, i], many[d, i], log_p[d, i], rest[d, i] = past, len(way), p, r
                past += len(way)
        bound = gumbel(keyed(key, 0))
        for d in range(k):
            bound = -np.logaddexp(-bound, -np.where(rest[d] > -np.inf, rest[d], 0.0) - gumbel(keyed(keyed(key, 0), d)))
        all_ = there[-1] & (rest[-1] > -np.inf) & (count > 0)  # others are left to be drawn
        inclusion = np.where(all_, _log_inclusion(log_p - np.where(all_, bound, 0.0)), 0.0)
        of, nth = np.nonzero(there.T)
        at = nth, of
        codes, size = np.concatenate(more)[spread(lo[at], many[at])], many[at]
        ids, size = self.ids(codes, size)
        return of, nth + 1, log_p[at], inclusion[at], size, ids

    def ids(self, codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary ids of pieces, ``size`` for each way: those beyond the vocabulary are runs of bytes."""
        known = len(self.raw)
        if not self.runs or not len(codes) or int(codes.max()) < known:
            return codes, size
        width = np.append(np.ones(known, np.int64), [len(r) for r in self.runs])
        flat = np.append(np.arange(known), list(chain.from_iterable(self.runs))).astype(np.int32)
        ends = np.append(0, np.cumsum(width[codes]))
        last = np.cumsum(size)
        return flat[spread((np.cumsum(width) - width)[codes], width[codes])], ends[last] - ends[last - size]

    def sample(self, text: str, seed: int, k: int) -> list[tuple[list[int], float, float]]:
        """Up to k distinct segmentations of a text: ids, log probability, log inclusion score."""
        _, _, p, q, size, ids = self.draw([text], [seed], k)
        return [(list(x), *y) for x, *y in zip(np.split(ids, np.cumsum(size)[:-1]), p.tolist(), q.tolist(), strict=True)]


def _log_inclusion(x: np.ndarray) -> np.ndarray:
    """log(1 - exp(-exp(x)))"""
    return np.where(x < -20, x - np.exp(np.minimum(x, 0)) / 2, np.log(-np.expm1(-np.exp(np.clip(x, -20, 50)))))


def parts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches of a task in runs of rows of a bounded size of ``column`` (texts or ids)."""
    for b in tidied(batches):
        c = b.column(b.schema.get_field_index(column))
        sizes = pc.fill_null(pc.utf8_length(c) if pa.types.is_string(c.type) else pc.list_value_length(c), 0).to_pylist()
        for part in slices(sizes, 300_000):
            for lo in range(part.start, part.stop, 500):
                yield b.slice(lo, min(500, part.stop - lo))


def lists(ids: np.ndarray, size: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(ids, pa.int32()))


@lru_cache(2)
def lattice(path: str, settings: Settings) -> Lattice:
    return Lattice(path, settings)


FIELDS = [("sample", "int"), ("ids", "array<int>"), ("log_p", "double"), ("log_inclusion", "double"), ("restored", "boolean")]


def sample_segmentations(docs: DataFrame, keys: list[str], path: str, settings: Settings = Settings()) -> DataFrame:
    """``samples`` distinct segmentations of the column text of each row of ``docs``.

    Returns the key columns, sample (from 1, in the order drawn), ids, log_p, log_inclusion (of the
    score that estimates how likely the segmentation is drawn at all; 0 where all there are were
    drawn) and restored (decoding the ids gives the text back). Fewer rows where a text has fewer
    segmentations; an empty or null text has the empty one. Rows of equal keys and text get equal
    samples. Other columns are dropped.
    """
    seed = F.xxhash64(*[F.col(k).cast("string") for k in keys], F.coalesce("text", F.lit("")))
    rows = docs.select(*keys, "text", seed.alias("__seed"))
    kept = rows.drop("text", "__seed")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"{n} {t}" for n, t in FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(path, settings)
        lat.renew_encoded()  # workers serve all stages in turn
        for part in parts(batches, "text"):
            texts, seeds = part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist()
            texts = [t or "" for t in texts]
            of, nth, p, q, size, ids = lat.draw(texts, seeds, settings.samples)
            restored = [texts[i] == t for i, t in zip(of.tolist(), lat.decode_all(ids, size), strict=True)]
            keys_ = part.select(part.schema.names[:-2]).take(pa.array(of, pa.int64()))
            found = pa.array(nth, pa.int32()), lists(ids, size), pa.array(p), pa.array(q), pa.array(restored, pa.bool_())
            yield pa.RecordBatch.from_arrays([*keys_.columns, *found], names=[*keys_.schema.names, *(f[0] for f in FIELDS)])

    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Add ``ids``, the vocabulary's own encoding of the column text (null: empty), which ``decode`` gives back exactly."""
    out = docs.drop("ids").withColumn("ids", F.array().cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(path, Settings())
        if lat.known:
            lat.renew()  # workers serve all stages in turn
        for b in parts(batches, "text"):
            names = [n for n in b.schema.names if n != "ids"]
            ids = lists(*lat.encode([t or "" for t in b.column(b.schema.get_field_index("text")).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), ids], names=[*names, "ids"])

    return docs.drop("ids").mapInArrow(run, out)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """Add ``text``, what the column ``ids`` was encoded from, be it by ``encode`` or sampled (null: null); other columns stay."""
    out = rows.drop("text").withColumn("text", F.lit("").cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(path, Settings())
        if lat.known:
            lat.renew()  # workers serve all stages in turn
        for b in parts(batches, "ids"):
            ids = b.column(b.schema.get_field_index("ids"))
            size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            texts = [t if known else None for t, known in zip(lat.decode_all(ids.flatten().to_numpy(zero_copy_only=False), size), ids.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "text"])

    return rows.drop("text").mapInArrow(run, out)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_sampled_pieces(spark, sf_dir: str) -> DataFrame:
    """Each document's own encoding, decoded again (sample 0), and its sampled segmentations (from 1 on)."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary()
    # decoding replaces the column text; what it was goes along under another name
    own = decode(encode(docs, path).withColumn("given", F.coalesce("text", F.lit(""))), path)
    nothing = F.lit(None).cast("double")
    own = own.select("doc_id", F.lit(0).alias("sample"), "ids", nothing.alias("log_p"), nothing.alias("log_inclusion"), (F.col("text") == F.col("given")).alias("restored"))
    got = own.unionByName(sample_segmentations(docs, ["doc_id"], path))
    text_ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return got.select("doc_id", "sample", F.size("ids").alias("n_pieces"), F.crc32(text_ids.cast("binary")).alias("ids_crc32"), "log_p", "log_inclusion", "restored")
