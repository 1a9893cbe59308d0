"""Captions in lines of words by similarity: an approximate dictionary lookup.

Similarity is the Ratcliff-Obershelp ratio 2 M / S, where M is what the matching blocks of a caption and a run of words hold and S their two lengths. For it to be
`least`, M has to be ceil(least S / 2). A text's tokens are its characters, each with the number of its occurrence; M is at most the number of tokens that two texts share.
The index has a list for each token, of the captions that hold it. The distinct runs of a batch add up their tokens' lists in one matrix product, and are compared only with captions
that share enough, and share M characters in one order. Nothing is lost.

The dictionary goes to all tasks in parts of at most `PART` characters, so it may be of any size.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import spelt

#: Characters of captions that go to all tasks at once, folded words that a task remembers, and cells of the tables in which runs meet captions, and which a task remembers.
PART, REMEMBERED, CELLS, KEPT = 200_000, 100_000, 2_000_000, 32_000_000
#: Places that fit a machine word.
SHORT = 63
#: More than a caption can share.
NEVER = 1 << 23
#: What captions and words are compared by: composed, without case, white space and separators.
FOLD = ("unicode", "whitespace", "case", "separators")


def shared(size: int, least: float) -> int:
    """What two texts of `size` characters together have to share."""
    return max(1, math.ceil(least * size / 2 - 1e-9))


def fold(texts: list[str]) -> list[str]:
    """Texts as they are compared; all at once, where they have no null characters."""
    whole = "\0".join(texts)
    if whole.count("\0") + 1 != len(texts):
        return [spelt(x, FOLD) for x in texts]
    return spelt(whole, FOLD).split("\0")


def tokens(text: str) -> list[tuple[str, int]]:
    """The characters, each with the number of its occurrence."""
    seen: Counter[str] = Counter()
    out = []
    for c in text:
        out.append((c, seen[c]))
        seen[c] += 1
    return out


def marks(text: str) -> dict[str, int]:
    """Each character's places, as bits."""
    out: dict[str, int] = {}
    for place, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << place
    return out


def common(places: dict[str, int], size: int, text: str) -> int:
    """The length of the longest common subsequence, bit by bit (Hyyrö 2004); matching blocks hold no more."""
    whole = (1 << size) - 1
    open_ = whole
    for c in text:
        hit = open_ & places.get(c, 0)
        open_ = (open_ + hit | open_ - hit) & whole
    return size - open_.bit_count()


class Captions:
    """The captions of one scope (a language, or a document type in a language).

    Runs are given by a text that holds them, its `letters`, and where each run starts and how long it is.
    """

    def __init__(self, captions: list[tuple[str, str, int]], least: float):
        """captions: (field, folded caption, words)."""
        self.captions, self.least = sorted(captions, key=lambda c: len(c[1])), least
        self.most = max((words for _, _, words in captions), default=0) + 1
        self.words = np.array([words for _, _, words in self.captions], dtype=np.int64)
        self.lengths = np.array([len(text) for _, text, _ in self.captions], dtype=np.int64)
        self.place: dict[tuple[str, int], int] = {}
        held = [[self.place.setdefault(t, len(self.place)) for t in tokens(text)] for _, text, _ in self.captions]
        # A list of captions for each token, as a row of marks.
        self.lists = np.zeros((len(self.place), len(self.captions)), dtype=np.float32)
        for number, own in enumerate(held):
            self.lists[own, number] = 1
        letters = sorted({c for c, _ in self.place})
        known = {c: i for i, c in enumerate(letters)}
        self.alphabet = np.array([ord(c) for c in letters], dtype=np.int64)
        self.letter, self.nth = (np.array([x(t) for t in self.place], dtype=np.int64) for x in (lambda t: known[t[0]], lambda t: t[1]))
        self.masks = [marks(text) if len(text) > SHORT else None for _, text, _ in self.captions]
        # Half a machine word does for short captions.
        self.kind = np.uint32 if int(self.lengths.max(initial=0)) < 32 else np.uint64
        self.bits = np.zeros((len(self.captions), len(letters) + 1), dtype=self.kind)
        for number, (_, text, _) in enumerate(self.captions):
            if len(text) <= SHORT:
                for c, places in marks(text).items():
                    self.bits[number, known[c]] = places
        self.whole = ((np.uint64(1) << np.minimum(self.lengths, SHORT).astype(np.uint64)) - np.uint64(1)).astype(self.kind)

    def letters(self, text: str) -> np.ndarray:
        """The place of each of a text's characters in the alphabet, and one past its end for others."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        at[self.alphabet[at] != codes] = len(self.alphabet)
        return at

    def need(self, sizes: np.ndarray) -> np.ndarray:
        """What each caption has to share with a run of each size; more than it has where no such run is similar enough."""
        rows, back = np.unique(sizes, return_inverse=True)
        own = np.maximum(1, np.ceil(self.least * (rows[:, None] + self.lengths) / 2 - 1e-9))
        return np.where(own <= np.minimum(rows[:, None], self.lengths), own, NEVER).astype(np.float32)[back]

    def in_order(self, text: str, letters: np.ndarray, start: np.ndarray, size: np.ndarray, number: np.ndarray) -> np.ndarray:
        """What runs and captions share in one order: longest common subsequences bit by bit, see `common`."""
        order = np.argsort(-size, kind="stable")
        begin, shorter, row = start[order], -size[order], number[order] * self.bits.shape[1]
        whole, bits = self.whole[number[order]], self.bits.ravel()
        open_ = whole.copy()
        for place in range(int(size.max(initial=0))):
            to = int(np.searchsorted(shorter, -place))  # runs that are longer
            now = open_[:to]
            hit = now & bits.take(row[:to] + letters.take(begin[:to] + place))
            open_[:to] = (now + hit | now - hit) & whole[:to]
        share = np.empty(len(number), dtype=np.int64)
        share[order] = self.lengths[number[order]] - np.bitwise_count(open_)
        for i in np.flatnonzero(self.lengths[number] > SHORT).tolist():
            share[i] = common(self.masks[number[i]], int(self.lengths[number[i]]), text[start[i] : start[i] + size[i]])
        return share

    def _matched(self, letters: np.ndarray, start: np.ndarray, size: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Characters in matching blocks, as SequenceMatcher finds them: the longest block, of those the first in the caption, then in the run, and so on to its left and right."""
        total = np.zeros(len(number), dtype=np.int64)
        # Parts of pairs that are still to be matched: places of the caption as bits, and a range of the run.
        pair, places, begin, end = np.arange(len(number)), self.whole[number], np.zeros(len(number), dtype=np.int64), size.astype(np.int64)
        bits, one = self.bits.ravel(), self.kind(1)
        while len(pair):
            at = begin[:, None] + np.arange(int((end - begin).max()))
            inside = at < end[:, None]
            same = bits[(number[pair] * self.bits.shape[1])[:, None] + letters[np.minimum(start[pair][:, None] + at, len(letters) - 1)]] & places[:, None]
            same[~inside] = 0
            # Bits of `blocks` are the ends of blocks of `length` characters, in the caption, by their end in the run.
            live, blocks, length, made = np.arange(len(pair)), same, 1, []
            ends = np.bitwise_or.reduce(blocks, axis=1)
            some = ends != 0
            live, blocks, same, ends = live[some], blocks[some], same[some], ends[some]
            while len(live):
                longer = (blocks[:, :-1] << one) & same[:, length:]
                further = np.bitwise_or.reduce(longer, axis=1)
                done = further == 0
                if done.any():
                    last = ends[done] & (~ends[done] + one)
                    stop = np.argmax((blocks[done] & last[:, None]) != 0, axis=1) + length
                    made.append((live[done], np.full(len(last), length), last, stop))
                live, blocks, same, ends = live[~done], longer[~done], same[~done], further[~done]
                length += 1
            if not made:
                break
            own, n, last, stop = (np.concatenate(x) for x in zip(*made))
            np.add.at(total, pair[own], n)
            stop = begin[own] + stop
            before = places[own] & ((last >> (n - 1).astype(self.kind)) - one)
            after = places[own] & ~((last << one) - one)
            pair, places, begin, end = (np.concatenate(x) for x in ((pair[own], pair[own]), (before, after), (begin[own], stop), (stop - n, end[own])))
            keep = (places != 0) & (begin < end)
            pair, places, begin, end = pair[keep], places[keep], begin[keep], end[keep]
        return total

    def ratios(self, text: str, letters: np.ndarray, start: np.ndarray, size: np.ndarray, number: np.ndarray) -> np.ndarray:
        """SequenceMatcher's ratios of captions and runs."""
        out = np.zeros(len(number), dtype=np.float64)
        # SequenceMatcher treats runs of 200 characters and more otherwise.
        short = np.flatnonzero((self.lengths[number] <= SHORT) & (size < 200))
        step = max(1, CELLS // max(1, 4 * int(size[short].max(initial=0))))
        for begin in range(0, len(short), step):
            i = short[begin : begin + step]
            out[i] = 2.0 * self._matched(letters, start[i], size[i], number[i]) / (self.lengths[number[i]] + size[i])
        for i in np.setdiff1d(np.arange(len(number)), short).tolist():
            out[i] = SequenceMatcher(None, self.captions[number[i]][1], text[start[i] : start[i] + size[i]]).ratio()
        return out

    def similar_all(self, keys: list[str], shortest: np.ndarray | None = None) -> list[list[tuple[int, float]]]:
        """Of each run all captions with at least the similarity wanted, each with its similarity; `shortest` is how many words the run has at least."""
        out: list[list[tuple[int, float]]] = [[] for _ in keys]
        if not self.captions:
            return out
        shortest = np.ones(len(keys), dtype=np.int64) if shortest is None else shortest
        sizes = np.array([len(k) for k in keys], dtype=np.int64)
        # Lengths that no caption fits are left out before anything is counted.
        low, high = shared(int(self.lengths[0]), self.least), 2 * int(self.lengths[-1]) / max(self.least, 1e-9)
        fit = np.flatnonzero((sizes >= low) & (sizes <= high))
        step = max(1, CELLS // max(len(self.captions), len(self.place), int(sizes[fit].max(initial=0))))
        for begin in range(0, len(fit), step):
            part = fit[begin : begin + step]
            text, size = "".join([keys[i] for i in part.tolist()]), sizes[part]
            letters, start, wide = self.letters(text), np.cumsum(size) - size, len(self.alphabet) + 1
            counts = np.bincount(np.repeat(np.arange(len(part)), size) * wide + letters, minlength=len(part) * wide).reshape(len(part), wide)
            need = self.need(size)
            some, number = np.nonzero(((counts[:, self.letter] > self.nth).astype(np.float32) @ self.lists >= need) & (self.words + 1 >= shortest[part][:, None]))
            good = self.in_order(text, letters, start[some], size[some], number) >= need[some, number]
            some, number = some[good], number[good]
            ratio = self.ratios(text, letters, start[some], size[some], number)
            for i, n, r in zip(part[some].tolist(), number.tolist(), ratio.tolist()):
                if r >= self.least:
                    out[i].append((n, r))
        return out

    def similar(self, key: str) -> list[tuple[int, float]]:
        """All captions with at least the similarity wanted, each with its similarity."""
        return self.similar_all([key])[0]


class Lookup:
    """Runs of words that come in their order. What a run shares with a caption in one order is at most what its words share, so words are compared with all captions once, and their
    sums leave few runs to be compared."""

    def __init__(self, index: Captions):
        self.index, size = index, len(index.captions)
        top = int(index.lengths.max(initial=0))
        self.kind = np.uint8 if top * index.most < 255 else np.uint16 if top * index.most < 65535 else np.int32
        self.never = min(np.iinfo(self.kind).max, NEVER)
        self.wide = max(1, size)
        #: More than the characters of any run that is similar to a caption.
        self.longest = int(2 * top / max(index.least, 1e-9)) + 2
        #: Captions that runs of 1, 2 and more words may be like.
        self.columns = [np.flatnonzero(index.words + 1 >= n) for n in range(1, index.most + 1)]
        self.forget()
        self._forget_sizes()

    def forget(self) -> None:
        self.ids, self.keys, self.folded = {}, {}, []
        self.sizes, self.met, self.shares = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros((0, self.wide), dtype=self.kind)

    def _forget_rare(self, most: int) -> None:
        """At most `most` words stay, of those that were met again."""
        keep = np.flatnonzero(self.met[: len(self.folded)] > 1)
        keep = keep[np.argsort(-self.met[keep], kind="stable")[:most]]
        place = np.full(len(self.folded), -1)
        place[keep] = np.arange(len(keep))
        now = place.tolist()
        self.ids = {x: now[i] for x, i in self.ids.items() if now[i] >= 0}
        self.folded = [self.folded[i] for i in keep.tolist()]
        self.keys = {k: i for i, k in enumerate(self.folded)}
        self.sizes, self.met, self.shares = self.sizes[keep], self.met[keep] // 2, self.shares[keep]

    def _forget_sizes(self) -> None:
        self.at, self.need = np.zeros(0, dtype=np.int64), np.zeros((0, self.wide), dtype=self.kind)

    def _needed(self, size: np.ndarray) -> np.ndarray:
        """The row of `need` that says what captions have to share with a run of each size."""
        size = np.minimum(size, self.longest)
        if (top := int(size.max(initial=0))) >= len(self.at):
            self.at = np.append(self.at, np.full(top + 1 - len(self.at), -1))
        fresh = np.unique(size[self.at[size] < 0])
        if len(fresh) and len(self.need) and (len(self.need) + len(fresh)) * self.wide > KEPT:
            self._forget_sizes()
            return self._needed(size)
        if len(fresh):
            more = np.full((len(fresh), self.wide), self.never, dtype=self.kind)
            more[:, : len(self.index.captions)] = np.minimum(self.index.need(fresh), self.never)
            self.at[fresh] = len(self.need) + np.arange(len(fresh))
            self.need = np.concatenate([self.need, more])
        return self.at[size]

    def _shares(self, words: list[str]) -> np.ndarray:
        """What each word shares with each caption in one order; with a long caption, the characters that it has at all."""
        index, size = self.index, np.array([len(x) for x in words], dtype=np.int64)
        letters, start = index.letters("".join(words)), np.cumsum(size) - size
        out = np.zeros((len(words), self.wide), dtype=self.kind)
        bits, order = np.ascontiguousarray(index.bits.T), np.argsort(-size, kind="stable")
        step = max(1, CELLS // 32 // self.wide)
        for begin in range(0, len(words), step):
            some = order[begin : begin + step]
            open_ = np.repeat(index.whole[None, :], len(some), axis=0)
            for place in range(int(size[some[0]])):
                to = int(np.searchsorted(-size[some], -place))
                now = open_[:to]
                hit = now & bits.take(letters.take(start[some[:to]] + place), axis=0)
                open_[:to] = (now + hit | now - hit) & index.whole
            out[some, : len(index.captions)] = np.minimum(index.lengths, SHORT) - np.bitwise_count(open_)
        for number in np.flatnonzero(index.lengths > SHORT).tolist():
            has = np.append(np.isin(np.arange(len(index.alphabet)), index.letters(index.captions[number][1])), False)
            held = np.append(0, np.cumsum(has[letters]))
            out[:, number] = np.minimum(held[start + size] - held[start], index.lengths[number])
        return out

    def _learn(self, texts: list[str]) -> None:
        """Words that are not known yet get a number."""
        fresh, most = [x for x in texts if x not in self.ids], min(REMEMBERED, KEPT // self.wide)
        if len(self.ids) + len(fresh) > most:
            self._forget_rare(most // 2)
            fresh = [x for x in texts if x not in self.ids]
        # What is longer than any run stays longer.
        folded = [x[: self.longest] for x in fold(fresh)]
        new = [k for k in dict.fromkeys(folded) if k not in self.keys]
        if new:
            known = len(self.folded)
            self.keys.update((k, known + i) for i, k in enumerate(new))
            self.folded += new
            if (more := len(self.folded) - len(self.shares)) > 0:
                more = max(more, len(self.shares))
                self.shares = np.concatenate([self.shares, np.zeros((more, self.wide), dtype=self.kind)])
                self.sizes, self.met = (np.append(x, np.zeros(more, dtype=np.int64)) for x in (self.sizes, self.met))
            self.sizes[known : len(self.folded)] = [len(k) for k in new]
            self.shares[known : len(self.folded)] = self._shares(new)
        self.ids.update((x, self.keys[k]) for x, k in zip(fresh, folded))

    def runs(self, texts: pa.Array, left: np.ndarray, own: int, group: np.ndarray | None = None, fields: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First word, number of words, caption and similarity of each run of words that is similar to a caption and begins among the first `own`; `left` is how many words are left in a
        word's line, with itself. Where words have a `group` and captions a number of their field, runs that are less similar than another of their group and field may be left out."""
        index, coded = self.index, texts.dictionary_encode()
        words = coded.dictionary.to_pylist()
        self._learn(words)
        ids = np.array([self.ids[x] for x in words], dtype=np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        self.met[: len(self.folded)] += np.bincount(ids, minlength=len(self.folded))
        text = "".join([self.folded[i] for i in ids.tolist()])
        ends = np.cumsum(self.sizes[ids])
        start, letters = ends - self.sizes[ids], index.letters(text)
        made, own, step = [], min(own, len(ids)), max(1, CELLS // 8 // self.wide)
        for begin in range(0, own, step):
            end, columns = min(begin + step, own), self.columns[0]
            each = self.shares.take(ids[begin : end + index.most - 1], axis=0)
            share = each[: end - begin].copy()
            for n in range(1, index.most + 1):
                if len(self.columns[n - 1]) < len(columns):
                    place = np.searchsorted(columns, self.columns[n - 1])
                    columns, share, each = self.columns[n - 1], share.take(place, axis=1), each.take(place, axis=1)
                last = np.arange(begin + n - 1, min(end + n - 1, len(ids)))
                share = share[: len(last)]
                if n > 1:
                    share += each[n - 1 : n - 1 + len(last)]
                # A run that its line does not hold is as one that is too long.
                size = np.where(left[begin : begin + len(last)] >= n, ends[last] - start[begin : begin + len(last)], self.longest)
                needed = self._needed(size)
                need = self.need if len(columns) == self.wide else self.need.take(columns, axis=1)
                at = np.flatnonzero((share >= need.take(needed, axis=0)).ravel())
                row = at // len(columns)
                made.append((begin + row, np.full(len(row), n), columns[at - row * len(columns)], size[row]))
        if not made:
            return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0),)
        row, n, number, size = (np.concatenate(x) for x in zip(*made))
        share, needed = index.in_order(text, letters, start[row], size, number), self._needed(size)
        good = np.flatnonzero(share >= self.need[needed, number])
        if group is not None and len(good):
            # No ratio is greater than `upper`: of a group, what has less than the ratio of its greatest is not compared.
            upper = 2.0 * share[good] / (index.lengths[number[good]] + size[good])
            _, own = np.unique(group[row[good]] * (int(fields.max()) + 1) + fields[number[good]], return_inverse=True)
            order = np.lexsort((-upper, own))
            lead = good[order[np.append(True, np.diff(own[order]) != 0)]]
            good = good[upper >= index.ratios(text, letters, start[row[lead]], size[lead], number[lead])[own]]
        row, n, number, size = row[good], n[good], number[good], size[good]
        ratio = index.ratios(text, letters, start[row], size, number)
        good = ratio >= index.least
        return row[good], n[good], number[good], ratio[good]


def _search(dictionary, scope: list[str], least: float, most: int):
    """Rows of a word and those after it in its line -> the captions that begin there. The runs of a batch are looked up together, equal ones once."""
    names = [f"t{i}" for i in range(most)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = {key: Captions(rows, least) for key, rows in dictionary.value.items()}
        folded: dict[str, str] = {}

        def key_of(text: str) -> str:
            if text not in folded:
                if len(folded) >= REMEMBERED:
                    folded.clear()
                folded[text] = spelt(text, FOLD)
            return folded[text]

        def found(rows: pa.RecordBatch, index: Captions) -> tuple[np.ndarray, np.ndarray, list[str], list[float]]:
            """Rows, numbers of words, fields and similarities."""
            size, wide = rows.num_rows, min(index.most, most)
            texts = pa.concat_arrays([rows.column(c).cast(pa.string()) for c in names[:wide]]).dictionary_encode()
            keys = pa.DictionaryArray.from_arrays(texts.indices, pa.array([key_of(t) for t in texts.dictionary.to_pylist()], pa.string())).dictionary_decode()
            own = [keys.slice(i * size, size) for i in range(wide)]
            # A run of n words, null where the line ends before; all of them under each other.
            runs = pa.concat_arrays([pc.binary_join_element_wise(*own[:n], "") for n in range(1, wide + 1)]).dictionary_encode()
            at = runs.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            shortest = np.full(len(runs.dictionary), most, dtype=np.int64)
            here = np.flatnonzero(at >= 0)
            np.minimum.at(shortest, at[here], here // size + 1)
            similar = index.similar_all(runs.dictionary.to_pylist(), shortest)
            hit = np.array([bool(x) for x in similar], dtype=bool)
            here = here[hit[at[here]]] if len(hit) else here
            each = [(i, number, ratio) for i, key in zip(here.tolist(), at[here].tolist()) for number, ratio in similar[key] if i // size <= index.words[number]]
            place = np.array([i for i, _, _ in each], dtype=np.int64)
            return place % max(size, 1), place // max(size, 1) + 1, [index.captions[number][0] for _, number, _ in each], [ratio for _, _, ratio in each]

        for batch in batches:
            if not batch.num_rows:
                continue
            # Rows of one scope; they mostly follow each other.
            where = list(zip(*(batch.column(c).to_pylist() for c in scope))) if scope else [()] * batch.num_rows
            groups = defaultdict(list)
            for row, key in enumerate(where):
                groups[key].append(row)
            for key, own in groups.items():
                if key not in indexes:
                    continue
                rows = batch if len(groups) == 1 else batch.take(pa.array(own, pa.int64()))
                row, n, fields, ratios = found(rows, indexes[key])
                if not len(row):
                    continue
                at = pa.array(row, pa.int64())
                edges = dict(zip(("left", "top", "width", "height"), (x.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(row), -1) for x in rows.column("boxes").take(at).flatten().flatten())))
                inside = np.arange(most) < n[:, None]
                left, top = (np.where(inside, edges[c], np.inf).min(axis=1) for c in ("left", "top"))
                width = np.where(inside, edges["left"] + edges["width"], -np.inf).max(axis=1) - left
                height = np.where(inside, edges["top"] + edges["height"], -np.inf).max(axis=1) - top
                made = [pa.array(fields, pa.string()), pa.array(n, pa.int32()), pa.array(ratios, pa.float64()), *(pa.array(x, pa.float64()) for x in (left, top, width, height))]
                yield pa.RecordBatch.from_arrays([*(rows.column(c).take(at) for c in ("document", "page", "line", "word")), *made], names=["document", "page", "line", "word", "field", "n", "similarity", "left", "top", "width", "height"])

    return run


def _promising(columns: list[str], rows: dict[tuple, list[tuple[str, str, int]]], least: float) -> Column:
    """Whether words in the columns have together as many of the captions' characters as the least caption has to share; words beyond ASCII always.

    Folding leaves no other ASCII letters than lower case makes.
    """
    texts = [text for own in rows.values() for _, text, _ in own]
    letters = "".join(sorted({c for text in texts for c in text if c.isascii()}))
    need = min(shared(size + 1, least) for size in {len(text) for text in texts})
    whole = F.concat_ws("", *columns)
    low = F.lower(whole)
    held = F.length(low) - F.length(F.translate(low, letters, "")) if letters else F.lit(0)
    return (held >= need) | whole.rlike(r"[^\x00-\x7F]")


def parts(captions: DataFrame, scope: list[str]) -> Iterator[dict[tuple, list[tuple[str, str, int]]]]:
    """The dictionary by scope, in parts of at most PART characters (a single caption may be longer)."""
    out, size = defaultdict(list), 0
    for row in captions.select(*scope, "field", "caption").where("field is not null and caption is not null").distinct().orderBy(*scope, "field", "caption").toLocalIterator():
        key = spelt(row["caption"], FOLD)
        if not key:
            continue
        if size and size + len(key) > PART:
            yield out
            out, size = defaultdict(list), 0
        out[tuple(row[c] for c in scope)].append((row["field"], key, max(1, len(row["caption"].split()))))
        size += len(key)
    if size:
        yield out


def hits(words: DataFrame, captions: DataFrame, least: float, documents: DataFrame | None = None) -> DataFrame:
    """document, page, line, word, field, n, similarity and hull of every run of words that is similar to a caption.

    Captions have field, caption and, where they hold for some documents only, language or document_type or both; `documents` then says what each document
    is. Runs have at most one word more than the caption. A scope with a null meets documents with that null.
    """
    scope = [c for c in ("document_type", "language") if c in captions.columns]
    if scope:
        if documents is None:
            raise ValueError(f"captions by {' and '.join(scope)} need documents")
        words = words.drop(*scope).join(documents.select("document", *scope).distinct(), "document")
    spark = words.sparkSession
    kinds = dict(words.dtypes)
    columns = ", ".join(f"{c} {kinds[c]}" for c in ("document", "page", "line", "word")) + ", field string, n int, similarity double, left double, top double, width double, height double"
    found = spark.createDataFrame([], columns)
    line = Window.partitionBy(*scope, "document", "page", "line").orderBy("word")
    for part in parts(captions, scope):
        most = 1 + max(n for rows in part.values() for _, _, n in rows)
        dictionary = spark.sparkContext.broadcast(dict(part))
        box = F.struct(*[F.col(c).cast("double").alias(c) for c in ("left", "top", "width", "height")])
        after = [F.lead("text", i).over(line).alias(f"t{i}") for i in range(most)]
        boxes = F.array(*[F.lead(box, i).over(line) for i in range(most)]).alias("boxes")
        rows = words.where("text is not null").select(*scope, "document", "page", "line", "word", *after, boxes)
        rows = rows.where(_promising([f"t{i}" for i in range(most)], part, least))
        found = found.unionByName(rows.mapInArrow(_search(dictionary, scope, least, most), columns))
    return found
