"""Language identification by cross-parsing entropy.

For each language the suffix automaton of a sample of labelled text recognises every string that
occurs in the sample. A document is cross-parsed against each automaton: the longest match from the
current place is one phrase, the next phrase starts behind it. The language whose automaton needs
the fewest phrases, normalised by the logarithm of its sample's length, wins.

Text is read as lower-case letters; everything between letters is one space. Texts are parsed in blocks
of ``Settings.block`` letters, so that all blocks of a batch of documents go through the automata in
lockstep; what a block changes is set right afterwards, so that a text of any length has its own phrases.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgework.llm.common import by_text, code_points, held, mix64, remainder, segments, slices, table

SPACE = 1  # class 0 is any letter that no sample has


@dataclass(frozen=True)
class Settings:
    """``sample_chars`` bounds the labelled text that is learned of each language (all labels are); beyond ``dense_bytes`` the transitions are in a hash table."""

    sample_chars: int = 60_000
    block: int = 1024
    dense_bytes: int = 150_000_000


@lru_cache(1)
def letter_of() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it isn't a letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x34000):  # no letters beyond these planes
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low[0])
    return out


def letters(text: str) -> str:
    """The text as the model reads it."""
    codes = letter_of()[code_points([text])[0]]
    keep = (codes > 0) | (np.concatenate(([1], codes[:-1])) > 0)
    return "".join(chr(c) if c else " " for c in codes[keep].tolist()).strip()


def automaton(text: str, classes: dict[str, int]) -> tuple[int, np.ndarray]:
    """The suffix automaton of ``text``: how many states, and its transitions as rows of state, class, next state."""
    link, length, step = [-1], [0], [{}]
    last = 0
    for ch in text:
        c = classes[ch]
        new = len(link)
        link.append(0)
        length.append(length[last] + 1)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                step.append(dict(step[q]))
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return len(step), np.array([(i, c, j) for i, to in enumerate(step) for c, j in to.items()], np.int64).reshape(-1, 3)


class Dense:
    """Transitions as one table of premultiplied states; an entry that starts a new phrase is stored as its complement."""

    def __init__(self, parts: list[tuple[int, np.ndarray]], width: int):
        tables, starts, base = [], [], 0
        for n, moves in parts:
            t = np.full((n, width), -1, np.int32)
            t[moves[:, 0], moves[:, 1]] = moves[:, 2]
            fresh = np.where(t[0] >= 0, t[0], 0)  # a letter that the sample lacks is a phrase of its own
            new = t < 0
            t = (np.where(new, fresh[None, :], t).astype(np.int64) + base) * width
            tables.append(np.where(new, ~t, t).astype(np.int32))
            starts.append(base * width)
            base += n
        self.table, self.starts = np.concatenate(tables).ravel(), np.array(starts, np.int32)

    def step(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.table[state + codes]


class Sparse:
    """The same by a hash table of the transitions there are, for alphabets that a table would be too large for."""

    def __init__(self, parts: list[tuple[int, np.ndarray]], width: int):
        base = np.cumsum([0, *(n for n, _ in parts)])
        self.width, self.starts = width, base[:-1].astype(np.int32)
        keys = np.concatenate([(m[:, 0] + b) * width + m[:, 1] for (_, m), b in zip(parts, base[:-1], strict=True)])
        to = np.concatenate([m[:, 2] + b for (_, m), b in zip(parts, base[:-1], strict=True)])
        self.mask = (1 << (4 * len(keys)).bit_length()) - 1
        self.keys, self.to = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int32)
        left, slot = np.arange(len(keys)), self.slot(keys)
        while len(left):  # linear probing, all keys at once: of those that want a free slot one gets it
            at = slot[left]
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]
            got = self.keys[at] == keys[left]
            self.to[at[got]] = to[left[got]]
            left = left[~got]
            slot[left] = (slot[left] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The next state of each key, -1 if none."""
        slot = self.slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.to[slot], -1)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            there = self.keys[slot[left]]
            same = there == keys[left]
            out[left[same]] = self.to[slot[left[same]]]
            left = left[~same & (there >= 0)]
        return out

    def step(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        flat = (state.astype(np.int64) * self.width + codes).ravel()
        out = self.find(flat)
        new = np.flatnonzero(out < 0)
        if len(new):
            start = np.broadcast_to(self.starts[:, None], state.shape).ravel()[new].astype(np.int64)
            fresh = self.find(start * self.width + np.broadcast_to(codes, state.shape).ravel()[new])
            out[new] = ~np.where(fresh >= 0, fresh, start)
        return out.reshape(state.shape).astype(np.int32)


def parser(samples: tuple[tuple[str, str], ...], dense_bytes: int) -> tuple[list[str], np.ndarray, Dense | Sparse, np.ndarray]:
    """ names, class of each code point, the transitions, weights. Each letter of any sample has a class."""
    alphabet = sorted({ch for _, text in samples for ch in text} - {" "})
    classes = {" ": SPACE} | {ch: i + 2 for i, ch in enumerate(alphabet)}
    width = len(alphabet) + 2
    of_letter = np.zeros(0x110000, np.uint8 if width <= 256 else np.int32)
    for ch, i in classes.items():
        of_letter[ord(ch)] = i
    letter = letter_of()
    class_of = of_letter[letter]
    class_of[letter == 0] = SPACE
    parts = [automaton(text, classes) for _, text in samples]
    kind = Dense if sum(n for n, _ in parts) * width * 4 <= dense_bytes else Sparse
    weight = np.array([np.log2(max(2, len(text))) for _, text in samples])
    return [n for n, _ in samples], class_of, kind(parts, width), weight


def phrases(moves: Dense | Sparse, codes: np.ndarray, doc: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Phrases that begin in each block (a range of ``codes``) in each language, but for a text's first one.

    The blocks of a text follow one another in ``doc``. All blocks are parsed in lockstep as if each began
    a phrase; then each block after a text's first is parsed again from where the block before it ended,
    up to the letter where both parses meet (a few letters on), and its count is set right.
    """
    starts = moves.starts
    order = np.argsort(-size, kind="stable")
    from_, size_ = first[order], size[order]
    state = np.repeat(starts[:, None], len(first), 1)
    count = np.zeros((len(starts), len(first)), np.int32)
    live = len(first)
    for t in range(int(size.max(initial=0))):
        while size_[live - 1] <= t:
            live -= 1
        s = moves.step(state[:, :live], codes[from_[:live] + t])
        new = s < 0
        count[:, :live] += new
        np.bitwise_xor(s, -1, out=s, where=new)
        state[:, :live] = s
    whole, end = np.empty_like(count), np.empty_like(state)
    whole[:, order], end[:, order] = count, state
    extra, plain = np.zeros_like(whole), end.copy()
    follows = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    while len(follows):
        extra[:, follows] = 0
        live_at, true, fresh = follows, end[:, follows - 1].copy(), np.repeat(starts[:, None], len(follows), 1)
        before = end[:, follows].copy()
        end[:, follows] = plain[:, follows]
        t = 0
        while len(live_at):
            letters_ = codes[first[live_at] + t]
            true, fresh = moves.step(true, letters_), moves.step(fresh, letters_)
            extra[:, live_at] += (true < 0).astype(np.int32) - (fresh < 0)
            true, fresh = np.where(true < 0, ~true, true), np.where(fresh < 0, ~fresh, fresh)
            t += 1
            met, over = (true == fresh).all(0), size[live_at] <= t
            end[:, live_at[over]] = true[:, over]
            live_at, true, fresh = live_at[~met & ~over], true[:, ~met & ~over], fresh[:, ~met & ~over]
        moved = follows[(end[:, follows] != before).any(0)] + 1  # blocks behind one that ends elsewhere now
        follows = moved[moved < len(doc)]
        follows = follows[doc[follows] == doc[follows - 1]]
    return whole + extra


def learn(docs: DataFrame, settings: Settings, of: Column | None = None) -> tuple[tuple[str, str], ...]:
    """A bounded sample (language, text as letters) of each label, of rows drawn by a hash of their id.

    Rows of ``docs`` (doc_id, text, lang) without text or label teach nothing.
    All labels are learned.
    """
    rows = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null and text <> ''")
    if of is not None:
        rows = rows.where(of)
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()
    if not sizes:
        return ()
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 3 * settings.sample_chars / max(1, r["chars"]) + 20 / r["n"]))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.where(draw < F.element_at(share, F.col("lang"))).select("lang", draw.alias("at"), "doc_id", F.substring("text", 1, 4 * settings.sample_chars).alias("text"))  # more is never learned of one text
    texts: dict[str, list[str]] = {r["lang"]: [] for r in sizes}
    for r in sorted(drawn.collect(), key=lambda r: (r["lang"], r["at"], r["doc_id"])):
        texts[r["lang"]].append(letters(r["text"]))
    out = []
    for lang in sorted(texts):
        kept, total = [], 0
        for t in texts[lang]:
            if t and total < settings.sample_chars:
                kept.append(t[: settings.sample_chars - total])
                total += len(kept[-1]) + 1
        if kept:
            out.append((lang, " ".join(kept)))
    return tuple(out)


def predict(docs: DataFrame, samples: tuple[tuple[str, str], ...], settings: Settings = Settings()) -> DataFrame:
    """Add ``lang_pred`` (string) and ``score`` (double) to ``docs`` by its column text.

    A text that is null or has no letter is ``und`` with score 0, as is everything where no language
    was learned. ``score`` is the share of the best language, each language weighing two to the power
    of minus its bits (those of a text beyond 64 letters count as those of 64). Ties go to the
    language that sorts first. Repeated rows get equal results; other columns stay as they are; an empty table stays empty.
    """

    def maker():
        names, class_of, moves, weight = held(("languages", samples, settings.dense_bytes), lambda: parser(samples, settings.dense_bytes)) if samples else ([], *[None] * 3)

        def run(texts: list) -> dict:
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            for part in slices([len(t) if t else 0 for t in texts], 1_500_000) if names else ():
                codes, lengths = code_points([t or "" for t in texts[part]])
                cls = class_of[codes]
                of = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
                space = cls == SPACE
                keep = ~(space & np.concatenate(([True], space[:-1])))
                cls, of = cls[keep], of[keep]
                size = np.bincount(of, minlength=len(lengths))
                some = np.bincount(of, cls != SPACE, len(lengths)) > 0
                doc, first, width = segments(np.cumsum(size) - size, size, settings.block)
                found = phrases(moves, cls.astype(np.int32), doc, first, width)
                bits = (np.stack([np.bincount(doc, n, len(lengths)) for n in found], 1) + 1) * weight
                best = bits.argmin(1)
                scale = np.minimum(1, 64 / np.maximum(1, size))[:, None]
                share = 1 / np.exp2(np.maximum(-60, -(bits - bits.min(1, keepdims=True)) * scale)).sum(1)
                for i in np.flatnonzero(some):
                    lang[part.start + i], score[part.start + i] = names[best[i]], share[i]
            return {"lang_pred": lang, "score": score}

        return run

    return by_text(docs, "text", maker, {"lang_pred": "string", "score": "double"})


def learnable(by: int = 4, held: int = 2) -> Column:
    return remainder(F.col("doc_id"), by) != held


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from labelled ones; `und` without letters or labels, an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    samples = learn(docs, Settings(), learnable())
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return predict(docs.select("doc_id", "text"), samples).select("doc_id", held, "lang_pred", "score")
