"""Evaluation passages inside training texts: q-gram lemma filtering and banded alignment."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LeakRules:
    words: int = 12  # successive words that make a leak
    q: int = 12  # characters of a q-gram
    edits: int = 1  # edit budget of the filter and the alignment
    block_chars: int = 4_000_000  # passages held by a task at once; more are searched block by block
    slice_hits: int = 2_000_000


_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> list[str]:
    """Words in lower case without accents and invisible characters."""
    if text.isascii():
        return _WORD.findall(text.lower())
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold())
    return _WORD.findall("".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf"))


def _stream(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words without gaps, and where each word begins; the end is added."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return codes, np.cumsum([0, *map(len, words)])


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    n = max(0, len(codes) - q + 1)
    h = np.zeros(n, np.uint64)
    for k in range(q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n].astype(np.uint64) + np.uint64(1)
    return h ^ (h >> np.uint64(29))


class PassageIndex:
    """q-grams of a block of passages; a side is one passage text."""

    def __init__(self, sides: list[tuple[int, str, str]], rules: LeakRules):
        self.rules, self.owner, self.codes, self.starts, least = rules, [], [], [], []
        gram, side, pos = [], [], []
        for item, name, text in sides:
            words = fold(text)
            if len(words) < rules.words:
                continue
            codes, starts = _stream(words)
            span = starts[rules.words :] - starts[: len(starts) - rules.words]
            # q-gram lemma: a window of L characters keeps L - q + 1 - q * edits of its q-grams
            least.append(max(1, int(span.min()) - rules.q + 1 - rules.q * rules.edits))
            g = _grams(codes, rules.q)
            gram.append(g)
            side.append(np.full(len(g), len(self.owner)))
            pos.append(np.arange(len(g)))
            self.owner.append((item, name))
            self.codes.append(codes)
            self.starts.append(starts)
        self.least = np.array(least, np.int64)
        sizes = np.array([len(c) for c in self.codes], np.int64)
        self.base = np.cumsum(sizes) - sizes
        self.all_codes = np.concatenate(self.codes) if self.codes else np.empty(0, np.uint32)
        if gram:
            g, s, p = np.concatenate(gram), np.concatenate(side), np.concatenate(pos)
            order = np.argsort(g, kind="stable")
            self.side, self.pos = s[order], p[order]
            self.gram, self.first = np.unique(g[order], return_index=True)
            self.count = np.diff(np.r_[self.first, len(g)])
        else:
            self.gram = np.empty(0, np.uint64)

    def candidates(self, codes: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(doc, side, diagonal band, windows) whose shared q-grams meet the bound; codes of many texts, one after another.

        Bands are 2 * (edits + 1) diagonals wide and overlap by half, so that an alignment within the budget lies
        whole in one of them.
        """
        q, step = self.rules.q, self.rules.edits + 1
        grams = _grams(codes, q)
        if not len(grams) or not len(self.gram):
            return
        own = doc[: len(grams)] == doc[q - 1 :]
        at = np.minimum(np.searchsorted(self.gram, grams), len(self.gram) - 1)
        hit = np.flatnonzero((self.gram[at] == grams) & own)
        edges = np.cumsum(self.count[at[hit]])
        # texts stay whole in a slice
        last = np.flatnonzero(np.r_[doc[hit][1:] != doc[hit][:-1], True]) if len(hit) else np.empty(0, int)
        begin = 0
        while begin < len(hit):
            goal = (edges[begin - 1] if begin else 0) + self.rules.slice_hits
            fit = last[(last >= begin) & (edges[last] <= goal)]
            end = int(fit[-1] if len(fit) else last[last >= begin][0]) + 1
            h = hit[begin:end]
            n = self.count[at[h]]
            k = np.repeat(self.first[at[h]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            where = np.repeat(h, n)
            band = (where - self.pos[k]) // step  # position in all texts: the text follows from it
            side, pos = np.tile(self.side[k], 2), np.tile(self.pos[k], 2)
            band = np.concatenate([band, band - 1])
            # the band of positions in all texts tells the text but for its borders
            key = (side.astype(np.int64) << 40) | (band + (1 << 39))
            order = np.lexsort((np.tile(doc[where], 2), key))
            key, pos, text = key[order], pos[order], np.tile(doc[where], 2)[order]
            new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])])
            stop = np.r_[new[1:], len(key)]
            enough = np.flatnonzero(stop - new >= self.least[key[new] >> 40])
            for s, e in zip(new[enough].tolist(), stop[enough].tolist()):
                windows = self.covered(int(key[s] >> 40), pos[s:e])
                if len(windows):
                    yield int(text[s]), int(key[s] >> 40), int(key[s] & ((1 << 40) - 1)) - (1 << 39), windows
            begin = end

    def covered(self, side: int, pos: np.ndarray) -> np.ndarray:
        """Windows of the passage that keep as many of their q-grams, found at pos, as the edit budget demands."""
        q, k, starts = self.rules.q, self.rules.words, self.starts[side]
        found = np.zeros(len(self.codes[side]) + 1, np.int64)
        found[pos + 1] = 1
        found = np.cumsum(found)
        begin, end = starts[: len(starts) - k], starts[k:]
        kept = found[np.maximum(end - q + 1, begin)] - found[begin]
        return np.flatnonzero(kept >= np.maximum(1, end - begin - q + 1 - q * self.rules.edits))

    def align(self, side: np.ndarray, window: np.ndarray, low: np.ndarray, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Least edits of windows, each within the diagonals low .. low + 2 (edits + 1) of its text codes[begin:end]."""
        e, k = self.rules.edits, self.rules.words
        first = np.array([self.starts[s][w] for s, w in zip(side.tolist(), window.tolist())], np.int64)
        length = np.array([self.starts[s][w + k] for s, w in zip(side.tolist(), window.tolist())], np.int64) - first
        at, low = first + self.base[side], low + first
        width, big = 2 * (e + 1) + 1, e + 1
        offset = np.arange(width)
        final = np.full(len(side), big)
        order = np.argsort(-length, kind="stable")  # the live windows stay in front
        at, low, begin, end, length = at[order], low[order], begin[order], end[order], length[order]
        cost = np.zeros((len(side), width), np.int64)  # any diagonal of the band may start the window
        live = len(side)
        for i in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length[:live], -i, "left"))
            cost = cost[:live]
            j = (low[:live] + i)[:, None] + offset
            inside = (j >= begin[:live, None]) & (j < end[:live, None])
            b = codes[np.clip(j, 0, len(codes) - 1)]
            step = np.where(inside, cost + (self.all_codes[at[:live] + i][:, None] != b), big)
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)  # a character of the passage is missing in the text
            for w in range(1, width):  # a character of the text is surplus
                step[:, w] = np.minimum(step[:, w], step[:, w - 1] + 1)
            cost = np.minimum(step, big)
            done = length[:live] == i + 1
            final[order[:live][done]] = cost[done].min(1)
        return final


def _search(rules: LeakRules, kept):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = kept.value
        for b in batches:
            words = [fold(t) for t in b.column("text").to_pylist()]
            streams = [_stream(w) for w in words]
            size = np.array([len(c) for c, _ in streams], np.int64)
            base = np.cumsum(size) - size
            codes = np.concatenate([c for c, _ in streams]) if streams else np.empty(0, np.uint32)
            found = list(index.candidates(codes, np.repeat(np.arange(len(size)), size)))
            n = [len(w) for *_, w in found]
            doc, side, band = (np.repeat(np.array([x[i] for x in found], np.int64), n) for i in range(3))
            window, low = np.concatenate([np.empty(0, np.int64), *(w for *_, w in found)]), band * (rules.edits + 1)
            edits = index.align(side, window, low, codes, base[doc], base[doc] + size[doc])
            borders: dict[int, set[int]] = {}
            hits: dict[tuple[int, int], tuple[set, set]] = {}
            for k in np.flatnonzero(edits <= rules.edits).tolist():
                d, s, w = int(doc[k]), int(side[k]), int(window[k])
                near, exact = hits.setdefault((d, s), (set(), set()))
                near.add(w)
                if edits[k] or w in exact:
                    continue
                border = borders.get(d) or borders.setdefault(d, set((streams[d][1] + base[d]).tolist()))
                begin, end = int(index.starts[s][w]), int(index.starts[s][w + rules.words])
                piece, at = index.codes[s][begin:end], int(low[k]) + begin
                if any(x in border and x + end - begin in border and np.array_equal(codes[x : x + end - begin], piece) for x in range(at, at + 2 * (rules.edits + 1) + 1)):
                    exact.add(w)
            out = {(d, *index.owner[s]): (len(near), len(exact)) for (d, s), (near, exact) in hits.items()}
            keys = list(out)
            ids = b.column("id")
            yield pa.RecordBatch.from_arrays([pa.array([ids[k[0]].as_py() for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.string()), *(pa.array([out[k][i] for k in keys], pa.int32()) for i in range(2))], names=["doc_id", "item_id", "side", "windows", "exact_windows"])

    return run


def find_leaks(documents: DataFrame, items: DataFrame, rules: LeakRules = LeakRules()) -> DataFrame:
    """(doc_id, item_id, side, windows, exact_windows) of documents that hold a stretch of a passage.

    documents(id bigint, text string); items(item_id bigint, side string, text string). A window is ``words``
    successive words of the passage; ``windows`` of them are found within the edit budget, ``exact_windows``
    letter by letter between borders of words. Case, accents, punctuation, spacing and invisible characters play
    no part. NULL texts and passages shorter than a window have no leaks. Passages are held by the tasks in blocks
    of at most ``block_chars`` characters; the corpus is read once for each block.
    """
    spark = documents.sparkSession
    items = items.filter("text is not null and item_id is not null").select(F.col("item_id").cast("bigint"), "side", "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total * 2 // rules.block_chars)) if total > rules.block_chars else 1
    texts = documents.filter("text is not null").select(F.col("id").cast("bigint"), F.col("text").cast("string"))
    found = []
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "side"), F.lit(blocks)) == k) if blocks > 1 else items
        index = spark.sparkContext.broadcast(PassageIndex([tuple(r) for r in part.collect()], rules))  # about block_chars / 2
        found.append(texts.mapInArrow(_search(rules, index), "doc_id bigint, item_id bigint, side string, windows int, exact_windows int"))
    return reduce(DataFrame.unionAll, found)
