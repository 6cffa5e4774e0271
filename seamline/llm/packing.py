"""Packs tokenised texts into sequences of a fixed window by non-negative least squares over length combinations.

Cases: a null or empty text has the end id alone. Rows are packed each by itself, also where their id repeats
another's or is null. Texts of any length are tokenised whole and cut into full windows and one rest. An empty
table gives an empty table. Only id_col and text_col are read.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .batches import bounded, trimmed
from .bpe import BATCH_BYTES, BATCH_ROWS, HELD_CHARS, PLAIN, Vocabulary, ids_by_parts

WINDOW, END_ID = 2048, 1
#: Pieces of words whose ids a worker remembers; beyond it the memory starts anew. What a task leaves with the worker, for
#: its next task or another stage's, is fewer.
REMEMBERED, LEFT = 250_000, 20_000
#: Fixed value: how this kind of tokenizer cuts folded text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, _task int, _rank long"


class WordIds:
    """Ids of texts, as little-endian 32-bit integers, as the tokenizer file defines them.

    The tokenizer composes characters, folds them to lower case and drops white space, which no token spans: so a
    text's ids are its words' ids. A new word falls apart into pieces, of which each new one is merged once.
    """

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path, PIECES)
        self.pieces: dict[str, bytes] = {}

    def _cut(self, word: str) -> list[str]:
        vocabulary = self.vocabulary
        if "<|" in word and any(s in word for s in vocabulary.special):
            return [p for part in vocabulary.at_special.split(word) for p in ([part] if part in vocabulary.special else self._cut(part))]
        return vocabulary.cut(word.lower() if word.isascii() else "".join(map(str.lower, unicodedata.normalize("NFC", word))))

    def _ids(self, pieces: list[str]) -> dict[str, bytes]:
        table = {p: self.pieces[p] for p in pieces if p in self.pieces}
        new = [p for p in pieces if p not in table]
        made = dict(zip(new, self.vocabulary.merge_many(new)))
        table.update(made)
        if len(self.pieces) + len(made) > REMEMBERED:
            self.pieces.clear()
        self.pieces.update((p, ids) for p, ids in made.items() if len(p) <= HELD_CHARS)
        return table

    def forget(self) -> None:
        """Remembers the first LEFT pieces alone; frequent ones come early."""
        if len(self.pieces) > LEFT:
            self.pieces = dict(islice(self.pieces.items(), LEFT))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin, with the end."""
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        return ids_by_parts(words, PLAIN, self._cut, self._ids, fold=True)


_WORDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for each worker process and tokenizer file."""
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def tokenised_pieces(docs: DataFrame, tokenizer: str, *, id_col: str, text_col: str, window: int, end_id: int, with_ids: bool) -> DataFrame:
    """Each text's full windows and its rest. _rank counts a task's pieces of one length; written, so that it stays."""
    rows = bounded(docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text")), BATCH_ROWS, BATCH_BYTES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = word_ids(tokenizer), TaskContext.get().partitionId()
        ranks = np.zeros(window + 1, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, bounds = words.encode(batch.column("_text"))
            ids = np.ascontiguousarray(np.insert(ids, bounds[1:], end_id))
            bounds += np.arange(len(bounds))
            total = np.diff(bounds)
            pieces = -(-total // window)
            of = np.repeat(np.arange(len(total)), pieces)
            start = window * (np.arange(len(of)) - (np.cumsum(pieces) - pieces)[of])
            length = np.minimum(window, total[of] - start)
            low = 4 * (bounds[of] + start)
            raw = memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[lo:hi]) for lo, hi in zip(low.tolist(), (low + 4 * length).tolist())]
            order = np.argsort(length, kind="stable")
            many = np.bincount(length, minlength=window + 1)
            rank = np.empty(len(of), np.int64)
            rank[order] = np.arange(len(of)) - (np.cumsum(many) - many)[length[order]]
            rank += ranks[length]
            ranks += many
            arrays = {"doc_id": batch.column("_id").take(pa.array(of)), "start": start, "length": length, "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": total[of], "_task": np.full(len(of), task, np.int32), "_rank": rank}
            if with_ids:
                arrays["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_pydict(arrays)
        words.forget()

    return store.written(rows.mapInArrow(trimmed(cut), PIECE + ", ids array<int>" * with_ids), "pieces")


def combinations(counts: np.ndarray, window: int, popular: int = 48) -> list[tuple[int, ...]]:
    """Shallow combinations of present lengths that fill the window: all pairs, and triples and quadruples over the most frequent."""
    present = np.flatnonzero(counts[:window])
    have = set(present.tolist())
    found = {(a, window - a) for a in have if 2 * a <= window and window - a in have}
    common = sorted(present[np.argsort(-counts[present], kind="stable")][:popular].tolist())
    for i, a in enumerate(common):
        for b in common[i:]:
            if (rest := window - a - b) in have:
                found.add(tuple(sorted((a, b, rest))))
            if 2 * rest == window and window // 2 in have:
                continue
            half, odd = divmod(rest, 2)
            if rest > 0 and not odd and half in have:
                found.add(tuple(sorted((a, b, half, half))))
    return sorted(found)


def nonnegative_least_squares(columns: list[tuple[int, ...]], counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Repeat counts x >= 0 of the columns that bring sum(x * column) next to counts: coordinate descent on sparse columns."""
    x, rest = np.zeros(len(columns)), counts.astype(float)
    sparse = [np.unique(np.array(c), return_counts=True) for c in columns]
    squares = [float((m * m).sum()) for _, m in sparse]
    for _ in range(rounds):
        moved = 0.0
        for j, (at, m) in enumerate(sparse):
            new = max(0.0, x[j] + float(rest[at] @ m) / squares[j])
            if new != x[j]:
                rest[at] -= (new - x[j]) * m
                moved = max(moved, abs(new - x[j]))
                x[j] = new
        if moved < 0.05:
            break
    return x


class Plan:
    """Patterns of lengths with repeat counts that use each piece of a histogram once.

    slots[length] has rows (first rank, pattern's first sequence, pieces of that length in a sequence, offset of the first).
    """

    def __init__(self, counts: np.ndarray, window: int):
        self.window, self.left = window, counts.astype(np.int64).copy()
        self.slots: dict[int, list[tuple[int, int, int, int]]] = {}
        self.used = np.zeros(window + 1, np.int64)
        self.sequences = self.padding = 0
        self._add((window,), int(self.left[window]))
        columns = combinations(self.left, window)
        for column, x in zip(columns, nonnegative_least_squares(columns, self.left[:window])):
            lengths, each = np.unique(np.array(column), return_counts=True)
            self._add(column, min(int(x), int((self.left[lengths] // each).min())))
        self._greedy()

    def _add(self, pattern: tuple[int, ...], times: int) -> None:
        if times <= 0:
            return
        offset = 0
        for length, each in zip(*(v.tolist() for v in np.unique(np.array(pattern), return_counts=True))):
            self.slots.setdefault(length, []).append((int(self.used[length]), self.sequences, each, offset))
            self.used[length] += times * each
            self.left[length] -= times * each
            offset += length * each
        self.sequences += times
        if offset & (offset - 1):
            self.padding += times * (self.window - offset)

    def _greedy(self) -> None:
        """Largest lengths first, each gap with the largest that fits; a pattern repeats until one of its lengths is used up."""
        while (present := np.flatnonzero(self.left[: self.window])).size:
            pattern, gap, free = [], self.window, self.left.copy()
            while gap and (fits := present[(present <= gap) & (free[present] > 0)]).size:
                pattern.append(int(fits[-1]))
                gap -= pattern[-1]
                free[pattern[-1]] -= 1
            lengths, each = np.unique(np.array(pattern), return_counts=True)
            self._add(tuple(pattern), int((self.left[lengths] // each).min()))

    def arrays(self) -> dict[int, np.ndarray]:
        return {length: np.array(rows, np.int64) for length, rows in self.slots.items()}


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids if with_ids.

    Texts are tokenised once. The driver gets the histogram of rest lengths (at most `window` numbers) and plans
    patterns from it; a piece finds its place by its rank among pieces of its length, of which each task counts its
    own and a window over (task, length) adds the tasks before it.
    """
    pieces = tokenised_pieces(docs, tokenizer, id_col=id_col, text_col=text_col, window=window, end_id=end_id, with_ids=with_ids)
    tally = store.written(pieces.groupBy("_task", "length").agg(F.count(F.lit(1)).alias("_n")), "piece-tally")
    counts = np.zeros(window + 1, np.int64)
    for length, n in tally.groupBy("length").agg(F.sum("_n")).collect():
        counts[length] = n
    slots = Plan(counts, window).arrays()
    # the tally has tasks x lengths rows, so both sides are dealt by task and length, never broadcast, into as many parts as tasks
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, 1 + (tally.agg(F.max("_task")).first()[0] or 0))
    before = tally.selectExpr("_task as _of", "length as _len", "sum(_n) over (partition by length order by _task) - _n as _before")
    before = before.repartition(parts, "_of", "_len").hint("shuffle_hash")
    ranked = pieces.repartition(parts, "_task", "length").join(before, (F.col("_task") == F.col("_of")) & (F.col("length") == F.col("_len"))).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_task", "_of", "_len", "_before")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                size, rows = int(length[group[0]]), slots[int(length[group[0]])]
                of = rows[np.searchsorted(rows[:, 0], rank[group], "right") - 1]
                nth = rank[group] - of[:, 0]
                sequence[group] = of[:, 1] + nth // of[:, 2]
                offset[group] = of[:, 3] + nth % of[:, 2] * size
            out = {c: batch.column(c) for c in names} | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)} | ({"ids": batch.column("ids")} if with_ids else {})
            yield pa.RecordBatch.from_pydict(out)

    schema = ", ".join(f"{c} long" for c in [*names, "sequence_id", "offset"]) + ", ids array<int>" * with_ids
    return bounded(ranked, size=BATCH_BYTES).mapInArrow(trimmed(place), schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
