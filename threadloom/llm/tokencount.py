"""Exact token counts of every prefix of a text, by prefix dynamic programming.

A byte-pair encoding is decided locally: a sequence of pieces is *the* encoding
of its text exactly if each piece encodes to itself and each two neighbours are
the encoding of their concatenation.  So for every prefix there is one last
piece, and ``count[i] = count[i - len(last)] + 1`` with the one candidate whose
pair with the stored last piece is stable.  The table of a text answers any
truncation or budget question without encoding again.

No piece of the vocabulary holds a word mark behind another character, so a
text falls into segments (a run of marks and the word behind it) that never
influence one another; the program runs once for a distinct segment and prefix
sums over segments give the table of the whole text.

Defined results: a null text counts as empty (0 bytes, 0 tokens); very long
words cost time linear in their length; duplicate rows give duplicate rows;
an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Memo

MARK = "▁"
_RUNS = re.compile(r" *[^ ]+| +\Z")


class PrefixCounter:
    """Counts for one vocabulary in the format of the sentencepiece library."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.rank: dict[str, int] = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                self.rank[model.id_to_piece(i)] = i
        self.longest = max(map(len, self.rank))
        self.stable: dict[tuple[str, str], bool] = {}
        self.by_last: dict[str, list[int]] = {}
        lengths: dict[str, set[int]] = {}
        for p in self.rank:
            if len(p) > 1 and self.merged(p) == [p]:
                lengths.setdefault(p[-1], set()).add(len(p))
        self.by_last = {c: sorted(n, reverse=True) for c, n in lengths.items()}
        self.usable = {p for p in self.rank if len(p) == 1 or self.merged(p) == [p]}
        self.totals = Memo(self._total)

    def merged(self, text: str) -> list[str]:
        """The encoding of a short text by the merges themselves: best rank first, leftmost on a tie."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _is_stable(self, a: str, b: str) -> bool:
        key = (a, b)
        known = self.stable.get(key)
        if known is None:
            if len(self.stable) > 800_000:
                self.stable.clear()
            known = self.stable[key] = self.merged(a + b) == [a, b]
        return known

    def table(self, segment: str) -> list[int]:
        """Token count of each prefix of a segment (its spaces written as marks), the whole last."""
        counts, last = [0], [""]
        usable, by_last, stable = self.usable, self.by_last, self.stable
        for i in range(1, len(segment) + 1):
            c = segment[i - 1]
            found = None
            for n in by_last.get(c, ()):
                if n <= i:
                    p = segment[i - n : i]
                    if p in usable:
                        a = last[i - n]
                        if not a or (ok if (ok := stable.get((a, p))) is not None else self._is_stable(a, p)):
                            found = p
                            break
            if found is None:
                # a character alone: in the vocabulary one piece, else one piece a byte
                found = c
                counts.append(counts[i - 1] + (1 if c in usable else len(c.encode("utf-8", "surrogatepass"))))
            else:
                counts.append(counts[i - len(found)] + 1)
            last.append(found)
        return counts

    def _total(self, key: str) -> int:
        """Tokens of a segment, written without its first space; a line end in it is a boundary too."""
        if "\n" in key and "\n" not in self.usable:
            parts = (" " + key).split("\n")
            return sum(self.totals_raw(p) for p in parts) + len(parts) - 1
        return self.table(MARK + key.replace(" ", MARK))[-1]

    def totals_raw(self, part: str) -> int:
        """Tokens of a piece of a segment as it stands."""
        if not part:
            return 0
        if part[0] == " ":
            return self.totals[part[1:]]
        return self.raw[part]

    @property
    def raw(self) -> Memo:
        if "_raw" not in self.__dict__:
            self._raw = Memo(lambda p: self.table(p.replace(" ", MARK))[-1])
        return self._raw

    def segments(self, text: str) -> list[str]:
        """The segments of a text, each without its first space."""
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [s[1:] for s in _RUNS.findall(" " + text)]
        return text.split(" ")

    def prefix_sums(self, text: str | None) -> np.ndarray:
        """Tokens up to the end of each segment, in order; empty for an empty text."""
        if not text:
            return np.zeros(0, np.int64)
        parts = self.segments(text)
        return np.fromiter(map(self.totals.__getitem__, parts), np.int64, len(parts)).cumsum()

    def count(self, text: str | None) -> int:
        sums = self.prefix_sums(text)
        return int(sums[-1]) if len(sums) else 0

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """``out[i]``: tokens of ``text[:i]``, for every i from 0 to its length."""
        if not text:
            return np.zeros(1, np.int64)
        out, base = [0], 0
        for k, part in enumerate(self.segments(text)):
            t = self.table(MARK + part.replace(" ", MARK))
            # the mark in front of the text is no character of it, and nothing stands for an empty text
            out.extend(base + x for x in t[1 + (k == 0) :])
            base += t[-1]
        return np.array(out, np.int64)

    def truncate(self, text: str | None, budget: int) -> str:
        """The longest prefix whose own encoding has ``budget`` tokens at most."""
        fits = np.flatnonzero(self.prefix_counts(text) <= budget)
        return (text or "")[: int(fits[-1])]


_counters: dict[str, PrefixCounter] = {}


def counter(model_path: str) -> PrefixCounter:
    if model_path not in _counters:
        _counters[model_path] = PrefixCounter(model_path)
    return _counters[model_path]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, boundaries: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of (doc_id, text).

    ``boundaries`` adds ``boundary_tokens``, the counts at the segment ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_path)
        for b in batches:
            sums = [c.prefix_sums(t) for t in b.column(2).to_pylist()]
            cols = [b.column(0), b.column(1), pa.array([int(s[-1]) if len(s) else 0 for s in sums], pa.int64())]
            if boundaries:
                cols.append(pa.array([s.tolist() for s in sums], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_tokens", "boundary_tokens"][: len(cols)])

    text = F.coalesce(F.col("text"), F.lit(""))
    schema = "doc_id long, n_bytes long, n_tokens long" + ", boundary_tokens array<long>" * boundaries
    return (
        docs.select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
        .mapInArrow(run, schema)
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
