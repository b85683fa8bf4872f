"""Benchmark decontamination by runs of words and edit verification.

Edit distance counts words.  A window within the allowed distance k of an item
of n words shares a run of ``ceil((n - k) / (k + 1))`` words with it, whatever
the edits.  Places of a document with enough such runs of one item near each
other are all verified by the edit distance itself, inside the document the
runs lie in, so nothing is lost at any length and anywhere in a document.

Defined results: a null or blank text and a null or blank item match nothing; an
item is compared by its words without case and outer punctuation; repeated
items and documents are reported each; a tie between places in a document goes
to the smaller distance, then the earlier start; empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Memo, windows_hash, word_hashes

#: Items held by a task at once; more items take more passes over the documents.
ITEM_BLOCK = 5_000
_OUTER = ".,;:!?\"'()[]{}<>…«»„“”‘’`*#%$&|-–—_/\\"


def _norm_hash(word: bytes) -> int:
    w = word.decode("utf-8", "replace").lower()
    return xxhash.xxh3_64_intdigest(w.strip(_OUTER) or w)


def _hashes(text: str | None, memo: Memo) -> np.ndarray:
    return word_hashes(text.encode("utf-8", "surrogatepass").split() if text else [], memo)


def allowed(n: int, similarity: float) -> int:
    return int((1 - similarity) * n + 1e-9)


def run_length(n: int, k: int) -> int:
    """Words in a row that an item of n words keeps under k edits."""
    return min(4, -(-(n - k) // (k + 1)))


def best_place(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the substring of ``text`` nearest to ``item``, if within ``most`` edits."""
    width = len(text) + 1
    row, start = np.zeros(width, np.int64), np.arange(width)
    idx = np.arange(width)
    for i, w in enumerate(item):
        step = row[:-1] + (text != w)
        new, frm = np.empty(width, np.int64), np.empty(width, np.int64)
        new[0], frm[0] = i + 1, 0
        down = row[1:] + 1
        diag = step <= down
        new[1:], frm[1:] = np.where(diag, step, down), np.where(diag, start[:-1], start[1:])
        # insertions along the row: the least of new[j] + (i - j) for all j before
        low = np.minimum.accumulate((new - idx) * width + idx)
        src = low % width
        row, start = (low - src) // width + idx, frm[src]
    end = int(row.argmin())
    return (int(row[end]), int(start[end]), end) if row[end] <= most else None


def bits(item: np.ndarray) -> dict[int, int]:
    """For each word of an item the places where it stands, as bits of a number."""
    out: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def within(places: dict[int, int], n: int, text: list[int], most: int) -> bool:
    """Whether a substring of ``text`` is within ``most`` edits of the item of n words: columns of the table as bits of numbers."""
    mask, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = mask, 0, n
    for w in text:
        eq = places.get(w, 0)
        x = eq | down
        h = (((eq & up) + up) ^ up) | eq
        more, less = down | (mask & ~(h | up)), up & h
        if more & top:
            score += 1
        elif less & top:
            score -= 1
            if score <= most:
                return True
        more, less = more << 1, less << 1
        up, down = (less | ~(x | more)) & mask, more & x & mask
    return score <= most


class _Items:
    """The benchmark items of one block and their runs."""

    def __init__(self, items: list[tuple[int, str]], similarity: float):
        memo = Memo(_norm_hash)
        self.ids, self.words, self.most = [], [], []
        for item_id, text in items:
            h = _hashes(text, memo)
            if len(h):
                self.ids.append(item_id)
                self.words.append(h)
                self.most.append(allowed(len(h), similarity))
        self.places = [bits(w) for w in self.words]
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for i, w in enumerate(self.words):
            g = run_length(len(w), self.most[i])
            rows.setdefault(g, []).extend((h, i, o) for o, h in enumerate(windows_hash(w, g).tolist()))
        self.n_words = np.array([len(w) for w in self.words], np.int64)
        self.n_edits = np.array(self.most, np.int64)
        #: for each run length: distinct hashes, where their occurrences begin, and the occurrences' items and offsets
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self.bits: dict[int, np.ndarray] = {}
        for g, x in rows.items():
            x.sort()
            h = np.array([r[0] for r in x], np.uint64)
            u, first = np.unique(h, return_index=True)
            self.runs[g] = (u, np.append(first, len(h)), np.array([r[1] for r in x], np.int64), np.array([r[2] for r in x], np.int64))
            self.bits[g] = np.zeros(1 << 20, np.bool_)
            self.bits[g][(u >> np.uint64(44)).astype(np.int64)] = True

    def places_near(self, text: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Rows of document, item, start and end of the places that can be near an item.

        k edits leave n - g + 1 - g k of an item's runs of g words, on
        diagonals no more than k apart; places with fewer are passed over.  A
        diagonal belongs to the document of its run and may begin before it.
        """
        out = [np.zeros((0, 4), np.int64)]
        for g, (u, first, items, offsets) in self.runs.items():
            if len(text) < g:
                continue
            h = windows_hash(text, g)
            pos = np.flatnonzero(self.bits[g][(h >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(u, h[pos]), len(u) - 1)
            doc = np.searchsorted(begin, pos, "right") - 1
            real = (u[at] == h[pos]) & (pos + g <= begin[doc + 1])
            pos, at, doc = pos[real], at[real], doc[real]
            count = first[at + 1] - first[at]
            if not len(pos):
                continue
            pos, doc = np.repeat(pos, count), np.repeat(doc, count)
            occ = np.repeat(first[at] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(int(count.sum()))
            item = items[occ]
            # documents are moved apart, so that diagonals of two are never near each other
            wide = 2 * int(self.n_words.max())
            key = (item << np.int64(44)) + (pos - offsets[occ]) + (doc + 1) * wide
            order = np.argsort(key, kind="stable")
            key, item, doc = key[order], item[order], doc[order]
            k, n = self.n_edits[item], self.n_words[item]
            near = np.searchsorted(key, key + k, "right") - np.arange(len(key))
            ok = near >= np.maximum(1, n - g + 1 - g * k)
            key, item, doc, k, n = key[ok], item[ok], doc[ok], k[ok], n[ok]
            d = (key & np.int64((1 << 44) - 1)) - (doc + 1) * wide
            out.append(np.stack([doc, item, np.maximum(begin[doc], d - k), np.minimum(begin[doc + 1], d + n + 2 * k)], axis=1))
        return np.unique(np.concatenate(out), axis=0)

    def matches(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, start, end) of each item's best place in each text."""
        begin = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
        text = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
        # places that overlap are verified together
        spans: dict[tuple[int, int], list[list[int]]] = {}
        for doc, i, a, b in self.places_near(text, begin).tolist():
            found = spans.setdefault((doc, i), [])
            if found and a <= found[-1][1]:
                found[-1][1] = max(b, found[-1][1])
            else:
                found.append([a, b])
        out = []
        for (doc, i), found in sorted(spans.items()):
            n, k, left, best = len(self.words[i]), self.most[i], int(begin[doc]), None
            for a, b in found:
                if within(self.places[i], n, text[a:b].tolist(), k) and (place := best_place(self.words[i], text[a:b], k)):
                    d, x, y = place
                    if best is None or (d, a - left + x) < best[:2]:
                        best = (d, a - left + x, a - left + y)
            if best:
                out.append((doc, self.ids[i], *best))
        return out


#: Words that a task gathers before it looks for items in them.
SLAB = 400_000


def _blocks(docs: DataFrame, benchmark: DataFrame, similarity: float) -> Iterator[Broadcast]:
    """The items, block by block, on all executors."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    blocks = max(1, -(-items.count() // ITEM_BLOCK))
    for block in range(blocks):
        mine = [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()]
        yield docs.sparkSession.sparkContext.broadcast(_Items(mine, similarity))


def _found(table: _Items, texts: list[str | None], memo: Memo) -> Iterator[tuple[int, int, int, int, int]]:
    """(place of the text in the list, item, distance, start, end) for a batch of texts, slab by slab."""
    held, n, first = [], 0, 0
    for at, t in enumerate(texts):
        held.append(_hashes(t, memo))
        n += len(held[-1])
        if n > SLAB or at == len(texts) - 1:
            yield from ((first + m[0], *m[1:]) for m in table.matches(held))
            held, n, first = [], 0, at + 1


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id, item_id, distance, start, end (in words): the best place of each item found in each document."""
    found = None
    for shared in _blocks(docs, benchmark, similarity):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            table, memo = shared.value, Memo(_norm_hash)
            for b in batches:
                ids = b.column(0).to_pylist()
                rows = [(ids[m[0]], *m[1:]) for m in _found(table, b.column(1).to_pylist(), memo)]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "distance", "start", "end"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id long, distance long, start long, end long")
        found = part if found is None else found.unionByName(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The rows in which ``leaks`` finds nothing, with all their columns; every row is looked at by itself, whatever its id."""
    at, schema = docs.columns.index("text"), docs.schema
    for shared in _blocks(docs, benchmark, similarity):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            table, memo = shared.value, Memo(_norm_hash)
            for b in batches:
                good = np.ones(b.num_rows, np.bool_)
                good[[m[0] for m in _found(table, b.column(at).to_pylist(), memo)]] = False
                yield b.filter(pa.array(good))

        docs = docs.mapInArrow(run, schema)
    return docs
