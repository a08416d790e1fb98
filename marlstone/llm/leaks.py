"""Evaluation texts leaking into documents: a suffix array over each shard of the corpus, searched for every test suffix.

The test items become numbers of their words. A worker numbers the words of its shard of documents in the same way and
sorts the suffixes of the shard, over as many words as the longest item has, into a suffix array; those that can't match,
as they don't start with the first words of any test suffix, are left out before. Every test suffix is binary-searched in it;
matches that no word before makes longer are stretched to their full length: these are all the longest verbatim matches of
SEED words or more, with their places. A document and an item with matches that few other items share, or with many, are
aligned word by word; passages in which at most about one word in six differs count, and an item leaks where they hold two
fifths of its words. `clean` removes the documents.

Items of fewer than SEED words are searched as a whole, and those of fewer than MIN_PASSAGE words leak only as a whole.
Pairs of test suffix and place are made at most PAIR_BLOCK at a time, so that a phrase of many items and many documents
needs time, not memory. The test set is broadcast in one block of at most BLOCK_WORDS words; larger ones take a pass each.

Defined results: null and empty texts hold nothing; items without words (besides a common opening) leak nowhere; items
repeated under another id leak under both; repeated documents are each reported; extra columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import spread

HELD = 0.4
ALTERED_COST = 4.0
RARE_ITEMS = 3
SEED = 4
SHARD_WORDS = 2_000_000
BLOCK_WORDS = 20_000_000
PAIR_BLOCK = 4_000_000
MIN_PASSAGE = 6

_WORD = re.compile(r"[^\W_]+")
_STEP = 16  # words that one round of sorting compares


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def openings(items: DataFrame, least: int = 3) -> DataFrame:
    """(text): first sentences that several items share."""
    first = F.regexp_extract("text", r"^\s*[^.!?。]+[.!?。]", 0)
    return items.groupBy(first.alias("text")).count().where((F.col("text") != "") & (F.col("count") >= least)).select("text")


def windows(w: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The `size` words from each place on as byte strings that sort as the words do; w has `size` zeros at its end."""
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(w, size)[at].astype(">u4"))
    stop = np.logical_or.accumulate(rows == 0, axis=1)  # an unknown word or the end of a text ends a suffix
    rows[stop] = 0
    return rows.view(f"S{4 * size}").ravel()


class TestSet:
    """Numbered words of the items, and their suffixes: `SEED` words or more, and short items as a whole."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary.setdefault
        self.ids = [i for i, _ in items]
        self.words = [np.array([number(w, len(self.vocabulary) + 1) for w in ws], np.int64) for _, ws in items]
        self.longest = max([len(w) for w in self.words], default=0)
        gap = np.zeros(SEED, np.int64)
        begins = np.cumsum([0, *(len(w) + SEED for w in self.words)])
        self.flat = np.concatenate([*(x for w in self.words for x in (w, gap)), np.zeros(self.longest + SEED + _STEP, np.int64)])
        n = np.array([len(w) for w in self.words], np.int64)
        starts = np.maximum(n - SEED + 1, np.minimum(n, 1))  # suffixes of each item that are searched
        self.item = np.repeat(np.arange(len(self.words)), starts)
        self.place = np.arange(len(self.item)) - np.repeat(np.cumsum(starts) - starts, starts)
        self.at = begins[self.item] + self.place
        self.seed = np.minimum(n[self.item], SEED)  # words that a match has at least
        self.keys = windows(self.flat, self.at, SEED) if len(self.item) else np.zeros(0, f"S{4 * SEED}")
        _, inverse = np.unique(self.keys, return_inverse=True)
        pairs = np.unique(np.stack([inverse.ravel(), self.item], 1), axis=0) if len(inverse) else np.zeros((0, 2), np.int64)
        self.rare = np.bincount(pairs[:, 0], minlength=1)[inverse.ravel()] <= RARE_ITEMS if len(inverse) else np.zeros(0, bool)
        # What suffixes of the corpus must start with: the first words of a test suffix, as far as the shortest has them.
        self.least = int(self.seed.min()) if len(self.seed) else SEED
        self.first = np.unique(self._start(self.flat)[self.at]) if len(self.item) else np.zeros(0, np.int64)

    def _start(self, w: np.ndarray) -> np.ndarray:
        """One number for the first `least` words from each place on, 0 where one is unknown; equal words have equal numbers."""
        k, ok = w.astype(np.uint64), w > 0
        for d in range(1, self.least):
            nxt = np.concatenate([w[d:], np.zeros(d, np.int64)])
            k, ok = (k * np.uint64(0x9E3779B97F4A7C15)) ^ (k >> np.uint64(29)) ^ nxt.astype(np.uint64), ok & (nxt > 0)
        return np.where(ok, k | np.uint64(1), np.uint64(0))


def suffix_array(w: np.ndarray, places: np.ndarray, longest: int) -> np.ndarray:
    """The places in order of the suffixes that start there, compared over `longest` words; w has that many zeros at its end.

    Rounds of _STEP words: what is still equal after a round is sorted by the next words.
    """
    sa = places[np.argsort(windows(w, places, _STEP), kind="stable")]
    depth = 0
    todo = np.arange(len(sa))
    group = np.zeros(len(sa), np.int64)
    while len(todo):
        _, rank = np.unique(windows(w, np.minimum(sa[todo] + depth, len(w) - _STEP), _STEP), return_inverse=True)
        rank = rank.ravel()
        order = np.lexsort((rank, group[todo]))
        sa[todo] = sa[todo][order]
        g, r = group[todo][order], rank[order]
        new = np.r_[True, (g[1:] != g[:-1]) | (r[1:] != r[:-1])]
        head = np.flatnonzero(new)
        size = np.diff(np.r_[head, len(todo)])
        group[todo] = todo[np.repeat(head, size)]
        # An end within the words compared makes equal suffixes equal for good.
        open_ = (size > 1) & (w[np.minimum(sa[todo][head] + depth + _STEP - 1, len(w) - 1)] > 0)
        todo = todo[np.repeat(open_, size)]
        depth += _STEP
        if depth >= longest:
            break
    return sa


def matches(test: TestSet, w: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(test suffix, corpus place, words) of all verbatim matches that can't be made longer to the left or right."""
    if not len(test.item):
        return
    w = np.concatenate([w, np.zeros(max(test.longest, SEED) + _STEP, np.int64)])
    start = test._start(w)
    k = np.minimum(np.searchsorted(test.first, start), len(test.first) - 1)
    sa = suffix_array(w, np.flatnonzero((start > 0) & (test.first[k] == start)), test.longest)
    keys = windows(w, sa, SEED)
    lo = np.searchsorted(keys, test.keys, "left")
    # The end of the range that shares the first words: for short items those with any words behind it.
    after = test.keys.copy()
    for n in np.unique(test.seed):
        own = test.seed == n
        raw = np.frombuffer(after[own].astype(f"S{4 * SEED}").tobytes(), np.uint8).reshape(-1, 4 * SEED).copy()
        raw[:, 4 * n :] = 255
        after[own] = raw.view(f"S{4 * SEED}").ravel()
    size = np.searchsorted(keys, after, "right") - lo
    which = np.flatnonzero(size > 0)
    ends = np.cumsum(size[which])
    done = 0
    while done < len(which):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIR_BLOCK, "right")))
        part = which[done:upto]
        done = upto
        for x in range(0, int(size[part].max()), PAIR_BLOCK) if len(part) == 1 else (0,):
            n = np.minimum(size[part] - x, PAIR_BLOCK)
            q = np.repeat(part, n)
            p = sa[np.repeat(lo[part] + x - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            t = test.at[q]
            left = (test.place[q] == 0) | (p == 0) | (w[p - 1] != test.flat[t - 1])
            q, p, t = q[left], p[left], t[left]
            length = test.seed[q].copy()
            go = np.arange(len(q))
            while len(go):
                a = test.flat[t[go] + length[go]]
                go = go[(a > 0) & (a == w[p[go] + length[go]])]
                length[go] += 1
            if len(q):
                yield q, p, length


def _pairs(test: TestSet, begins: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """All matches as (document, item, place in the item, place in the shard, words, rare starts, starts), in order of document and item."""
    rare_before = np.r_[0, np.cumsum(test.rare)]
    out = []
    for q, p, length in matches(test, w):
        doc = np.searchsorted(begins, p, "right") - 1
        starts = np.maximum(length - SEED + 1, 1)
        out.append((doc, test.item[q], test.place[q], p, length, rare_before[q + starts] - rare_before[q], starts))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    cols = [np.concatenate(c) for c in zip(*out)]
    order = np.lexsort((cols[3], cols[1], cols[0]))
    return tuple(c[order] for c in cols)


def leaked(test: TestSet, begins: np.ndarray, w: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(document, item, words held) of the pairs that hold HELD of the item, aligned around their matches.

    A passage of HELD of n words with one in six altered has about 0.19 n starts of SEED words, most of them rare; 0.05 n
    rare ones or, for items that resemble each other, 0.1 n of any kind are enough to be aligned.
    """
    doc, item, place, at, length, rare, starts = _pairs(test, begins, w)
    if not len(doc):
        return
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])
    rares, alls = np.add.reduceat(rare, first), np.add.reduceat(starts, first)
    n = np.array([len(x) for x in test.words])[item[first]]
    short = np.minimum(2, np.maximum(n - SEED + 1, 1))
    ok = (rares >= np.maximum(short, 0.05 * n)) | (alls >= np.maximum(short, 0.25 * HELD * n))
    last = np.r_[first[1:], len(doc)]
    for k in np.flatnonzero(ok):
        d, size, rows = doc[first[k]], n[k], slice(first[k], last[k])
        # The words around the matches, a document's words between distant ones left out.
        lows, highs = np.maximum(begins[d], at[rows] - size), np.minimum(begins[d + 1] - 1, at[rows] + length[rows] + size)
        highs = np.maximum.accumulate(highs)
        split = np.flatnonzero(np.r_[True, lows[1:] > highs[:-1]])
        part = [w[a:b] for a, b in zip(lows[split], highs[np.r_[split[1:], len(highs)] - 1])]
        gap = np.zeros(64, np.int64)
        held = held_words(test.words[item[first[k]]], np.concatenate([x for y in part for x in (y, gap)]))
        if held >= HELD * size:
            yield int(d), int(item[first[k]]), held


def held_words(item: np.ndarray, doc: np.ndarray) -> int:
    """Words of the item inside passages that the document holds in order, with at most about one word in six altered."""
    blocks = [b for b in SequenceMatcher(None, doc.tolist(), item.tolist(), autojunk=False).get_matching_blocks() if b.size]
    total = 0
    start = best_end = -1
    score = best = 0.0
    last_doc = last_item = None

    def close() -> None:
        nonlocal total
        if start >= 0 and best >= min(MIN_PASSAGE, len(item)):
            total += best_end - start

    for a, b, n in blocks:
        if start >= 0:
            gap = b - last_item
            inserted = max(0, (a - last_doc) - gap)
            score -= ALTERED_COST * gap + (0 if inserted <= 3 else 0.5 * inserted)
            if score <= 0 or score < best - 12 or inserted > 40:
                close()
                start, score = -1, 0.0
        if start < 0:
            start, score, best, best_end = b, 0.0, 0.0, b
        score += n
        last_doc, last_item = a + n, b + n
        if score > best:
            best, best_end = score, last_item
    close()
    return total


def _shards(batches: Iterator[pd.DataFrame], vocabulary: dict[str, int]) -> Iterator[tuple[list, list[np.ndarray]]]:
    ids, docs, size = [], [], 0
    get = vocabulary.get
    for b in batches:
        for i, text in zip(b["doc_id"], b["text"]):
            ws = words(text)
            w = np.fromiter((get(x, 0) for x in ws), np.int64, len(ws))
            ids.append(i), docs.append(w)
            size += len(w)
            if size >= SHARD_WORDS:
                yield ids, docs
                ids, docs, size = [], [], 0
    if ids:
        yield ids, docs


def _blocks(documents: DataFrame, items: DataFrame, block_words: int, rows_of) -> DataFrame:
    """The rows that `rows_of` gives for each shard of documents and block of items, without doubles."""
    own = items.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    size = own.agg(F.sum(F.regexp_count("text", F.lit(r"[^\W_]+")))).first()[0] or 0
    blocks = max(1, -(-size // block_words))
    spark = documents.sparkSession
    rows = spread(documents.select("doc_id", "text").where(F.length("text") > 0))
    common = [r["text"].strip() for r in openings(own).collect()]  # a part of the stated test set
    out = None
    for k in range(blocks):
        # the stated test set, at most about block_words words of it
        known = own.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        cut_ = [(i, words(next((t.strip()[len(o) :] for o in common if t.strip().startswith(o)), t))) for i, t in known]
        held = spark.sparkContext.broadcast(TestSet(cut_))

        def look(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            test = held.value
            for ids, docs in _shards(batches, test.vocabulary):
                gap = np.zeros(1, np.int64)
                w = np.concatenate([x for d in docs for x in (d, gap)])
                begins = np.concatenate([[0], np.cumsum([len(d) + 1 for d in docs])])
                yield rows_of(test, ids, begins, w)

        part = rows.mapInPandas(look, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, {rows_of.schema}")
        out = part if out is None else out.unionByName(part)
    return out


def _found(test: TestSet, ids: list, begins: np.ndarray, w: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame([(ids[d], test.ids[t], held, len(test.words[t])) for d, t, held in leaked(test, begins, w)], columns=["doc_id", "item_id", "held", "words"])


def _longest(test: TestSet, ids: list, begins: np.ndarray, w: np.ndarray) -> pd.DataFrame:
    doc, item, place, at, length, _, _ = _pairs(test, begins, w)
    return pd.DataFrame({"doc_id": [ids[d] for d in doc], "item_id": [test.ids[t] for t in item], "doc_word": at - begins[doc], "item_word": place, "matched": length})


_found.schema = "item_id long, held long, words long"
_longest.schema = "item_id long, doc_word long, item_word long, matched long"


def find(documents: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, held, words): the documents that hold HELD of an item's words, and how many of how many."""
    return _blocks(documents, items, block_words, _found).groupBy("doc_id", "item_id").agg(F.max("held").alias("held"), F.max("words").alias("words"))


def longest_matches(documents: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, matched): all verbatim matches that can't be made longer, by 0-based word places.

    Words of an item count from the end of its common opening.
    """
    return _blocks(documents, items, block_words, _longest).distinct()


def clean(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without those that hold an item."""
    return documents.join(find(documents, items).select("doc_id").distinct(), "doc_id", "left_anti")
