"""Problem 9: evaluation texts leaking into training text, found with an FM-index per shard of the corpus.

A shard is a run of whole documents, mapped to word numbers of the test items' vocabulary. Its suffix array gives the
Burrows–Wheeler transform; ranks come from a wavelet matrix of numpy bit vectors. All phrases of eight words of all
items are searched backwards at once, occurrences are located by walking to sampled suffix positions, and the covered
words of each item are merged per document.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from trajlake.runtime import table

#: Words of an unbroken run, share of an item's words that must stand in such runs, and words of a shard.
RUN, SHARE, SHARD_WORDS = 8, 0.5, 400_000
#: Words of the test items that are searched for in one pass over the documents; more items take more passes.
ITEM_WORDS = 1_000_000
#: Every so many text positions one suffix position is kept.
SAMPLE = 8

INVISIBLE = re.compile("[​‌‍⁠﻿­‎‏]")
TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->", re.S)
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Words whatever the case, accents, punctuation, mark-up, spacing and invisible characters."""
    if "<" in text:
        text = TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = INVISIBLE.sub("", text)
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return WORD.findall(text.casefold())


def item_words(items: list[tuple[int, str]], common: int = 3) -> dict[int, list[str]]:
    """Words of each item without an opening sentence that at least ``common`` items share."""
    first = {}
    for i, t in items:
        m = re.match(r"\s*(.+?[.!?:])(?:\s+|$)", t or "", re.S)
        first[i] = tuple(words(m[1])) if m else ()
    often = Counter(first.values())
    out = {}
    for i, t in items:
        w = words(t or "")
        out[i] = w[len(first[i]) :] if first[i] and often[first[i]] >= common and len(w) > len(first[i]) else w
    return out


class FMIndex:
    """FM-index of a sequence of small positive numbers; 0 ends every document and every run of foreign words."""

    def __init__(self, seq: np.ndarray, symbols: int) -> None:
        n = len(seq)
        sa = self.suffix_array(seq)
        bwt = seq[sa - 1]
        self.n, self.count = n, np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols + 1))]).astype(np.int64)
        self.levels, self.zeros, self.ranks = max(1, int(symbols).bit_length()), [], []
        cur = bwt
        for k in range(self.levels - 1, -1, -1):  # wavelet matrix: one bit a level, zeros moved to the front
            bit = (cur >> k) & 1
            self.ranks.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(n - int(bit.sum()))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])
        self.bwt = bwt
        keep = sa % SAMPLE == 0
        self.kept = np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)
        self.positions, self.marked = sa[keep], keep

    @staticmethod
    def suffix_array(seq: np.ndarray) -> np.ndarray:
        """Cyclic suffix array by prefix doubling; ends as soon as all ranks differ."""
        n = len(seq)
        sa = np.argsort(seq, kind="stable")
        key = seq[sa]
        rank = np.empty(n, np.int64)
        rank[sa] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        k = 1
        while k < n:
            pair = rank * (n + 1) + np.roll(rank, -k)
            sa = np.argsort(pair, kind="stable")
            key = pair[sa]
            new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            rank[sa] = new
            if new[-1] == n - 1:
                break
            k *= 2
        return sa

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the first i places of the transform."""
        lo, hi = np.zeros(len(i), np.int64), i.astype(np.int64)
        for level, k in enumerate(range(self.levels - 1, -1, -1)):
            r, z = self.ranks[level], self.zeros[level]
            one = ((symbol >> k) & 1).astype(bool)
            a, b = r[lo], r[hi]
            lo, hi = np.where(one, z + a, lo - a), np.where(one, z + b, hi - b)
        return hi - lo

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [from, to) of the phrases, one phrase a row, all of one length."""
        a, b = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            s = phrases[live, k]
            a[live], b[live] = self.count[s] + self.rank(s, a[live]), self.count[s] + self.rank(s, b[live])
            dead = live[a[live] >= b[live]]
            a[dead] = b[dead] = 0
            live = live[a[live] < b[live]]
            if not len(live):
                break
        return a, b

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows: back through the text to the next sampled position."""
        rows, steps = rows.astype(np.int64).copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.marked[rows])
        while len(todo):
            s = self.bwt[rows[todo]].astype(np.int64)
            rows[todo] = self.count[s] + self.rank(s, rows[todo])
            steps[todo] += 1
            todo = todo[~self.marked[rows[todo]]]
        return (self.positions[self.kept[rows]] + steps) % self.n


def phrase_table(items: dict[int, list[str]], vocab: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct phrases are not merged: each has its item and its place in it. Items of fewer words than a run give none."""
    rows, owner, place = [], [], []
    for i, w in items.items():
        n = [vocab[x] for x in w]
        for s in range(len(n) - RUN + 1):
            rows.append(n[s : s + RUN])
            owner.append(i)
            place.append(s)
    return np.array(rows, np.int64).reshape(-1, RUN), np.array(owner, np.int64), np.array(place, np.int64)


def shard_hits(docs: list[tuple[int, list[int], list[int]]], symbols: int, table_: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
    """(doc, item, place in the item, word number in the document) of every occurrence in a shard."""
    phrases, owner, place = table_
    seq = np.array([s for _, ss, _ in docs for s in ss], np.int64)
    if not len(seq) or not len(phrases):
        return
    ends = np.cumsum([len(ss) for _, ss, _ in docs])
    index = FMIndex(seq, symbols)
    a, b = index.search(phrases)
    n = b - a
    hit = np.flatnonzero(n)
    if not len(hit):
        return
    which = np.repeat(hit, n[hit])
    rows = np.repeat(a[hit], n[hit]) + np.arange(len(which)) - np.repeat(np.cumsum(n[hit]) - n[hit], n[hit])
    at = index.locate(rows)
    doc = np.searchsorted(ends, at, "right")
    for d, w, p in zip(doc.tolist(), which.tolist(), at.tolist()):
        ids, _, number = docs[d]
        yield ids, int(owner[w]), int(place[w]), number[p - (int(ends[d - 1]) if d else 0)]


def leaks(documents: DataFrame, items: list[tuple[int, str]], spans: bool = False) -> DataFrame:
    """(doc_id, item_id, share) of documents that hold at least half of an item's words in runs of eight or more.

    With ``spans`` instead (doc_id, item_id, first_word, last_word): the merged stretches to remove, in words of the
    document. Null and empty texts hold nothing; items of fewer than eight words are never found; copies count each.
    """
    blocks: list[dict[int, list[str]]] = [{}]
    held = 0
    for i, w in item_words([(i, t) for i, t in items if i is not None]).items():
        if held + len(w) > ITEM_WORDS and blocks[-1]:
            blocks.append({})
            held = 0
        blocks[-1][i] = w
        held += len(w)
    return reduce(DataFrame.unionByName, [leaks_of(documents, own, spans) for own in blocks])


def leaks_of(documents: DataFrame, own: dict[int, list[str]], spans: bool) -> DataFrame:
    """:func:`leaks` of one block of items, given by their words."""
    vocab = {w: k + 1 for k, w in enumerate(sorted({w for ws in own.values() for w in ws}))}
    grid = phrase_table(own, vocab)
    length = {i: len(w) for i, w in own.items()}
    # vocabulary and phrases of a block go to each task once: at most ITEM_WORDS words and as many phrases
    shared = documents.sparkSession.sparkContext.broadcast((vocab, grid, length))

    def merge(docs: list) -> Iterator[pa.RecordBatch]:
        vocab, grid, length = shared.value
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for d, i, p, at in shard_hits(docs, len(vocab), grid):
            found.setdefault((d, i), []).append((p, at))
        out: list[tuple] = []
        for (d, i), hits in found.items():
            covered = set()
            for p, _ in hits:
                covered.update(range(p, p + RUN))
            share = len(covered) / length[i]
            if share < SHARE:
                continue
            if not spans:
                out.append((d, i, share))
                continue
            last = None
            for at in sorted({x for _, x in hits}):
                if last is not None and at <= last[1] + 1:
                    last[1] = at + RUN - 1
                else:
                    if last is not None:
                        out.append((d, i, *last))
                    last = [at, at + RUN - 1]
            out.append((d, i, *last))
        cols = list(zip(*out)) or [()] * (4 if spans else 3)
        if spans:
            yield pa.record_batch({"doc_id": pa.array(cols[0], pa.int64()), "item_id": pa.array(cols[1], pa.int64()), "first_word": pa.array(cols[2], pa.int64()), "last_word": pa.array(cols[3], pa.int64())})
        else:
            yield pa.record_batch({"doc_id": pa.array(cols[0], pa.int64()), "item_id": pa.array(cols[1], pa.int64()), "share": pa.array(cols[2], pa.float64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, docs, size = shared.value[0].get, [], 0
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seq, number = [], []
                for k, w in enumerate(words(t)):
                    s = get(w, 0)
                    if s or (seq and seq[-1]):  # a run of foreign words is one separator
                        seq.append(s)
                        number.append(k)
                if len(seq) < RUN:
                    continue
                seq.append(0)
                number.append(-1)
                docs.append((d, seq, number))
                size += len(seq)
                if size >= SHARD_WORDS:
                    yield from merge(docs)
                    docs, size = [], 0
        if docs:
            yield from merge(docs)

    schema = "doc_id long, item_id long, " + ("first_word long, last_word long" if spans else "share double")
    return documents.where("text is not null").select("doc_id", "text").mapInArrow(run, schema)


def eval_texts(spark: SparkSession, sf_dir: str) -> list[tuple[int, str]]:
    """The test items: a fixed, small table."""
    return [(r[0], r[1]) for r in table(spark, sf_dir, "eval_items").select("item_id", "text").collect()]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of every document that holds a passage and the item that leaked."""
    return leaks(table(spark, sf_dir, "documents"), eval_texts(spark, sf_dir)).select("doc_id", "item_id").distinct()


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, first_word, last_word): the stretches of documents to remove."""
    return leaks(table(spark, sf_dir, "documents"), eval_texts(spark, sf_dir), spans=True)
